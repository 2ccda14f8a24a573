"""Code text: hashes, tokens, lines and metrics as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.normalize import strip

# What tokens, identifiers, terms and line ends are.
#: Word characters as Unicode letters and numbers: Java's \w is ASCII only.
_WORD = r"\p{L}\p{N}_"
_BLANK = r"\s\x1c-\x1f\x85\p{Z}"
TOKEN = rf"[A-Za-z_][{_WORD}]*|\p{{Nd}}+|[^{_WORD}{_BLANK}]"
IDENTIFIER = rf"[A-Za-z_][{_WORD}]*"
#: Tokens of the term vectors: identifiers of two or more characters.
TERM = rf"[A-Za-z_][{_WORD}]+|\p{{Nd}}+|[^{_WORD}{_BLANK}]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"

# Names of functions that take, move or release memory, run commands or read input.
DANGEROUS_CALLS = (
    "strcpy", "strcat", "sprintf", "vsprintf", "gets", "scanf", "sscanf", "memcpy", "memmove", "memset", "alloca", "malloc", "calloc", "realloc",
    "free", "strncpy", "strncat", "snprintf", "system", "popen", "exec", "execl", "execlp", "execle", "execv", "execvp", "fscanf", "vscanf",
)
SOURCE_TERMS = ("recv", "read", "scanf", "argv", "getenv", "fgets", "gets")
SINK_TERMS = ("memcpy", "strcpy", "strcat", "sprintf", "system", "free", "malloc", "memmove", "alloca")


def exact_hash(code: Column) -> Column:
    return F.sha2(F.coalesce(code, F.lit("")), 256)


def normalize_code(code: Column) -> Column:
    """Comments become a space, white space runs one space, ends stripped; case stays."""
    c = F.regexp_replace(F.coalesce(code, F.lit("")), r"(?s)/\*.*?\*/", " ")
    c = F.regexp_replace(c, r"//[^\n]*", " ")
    return strip(F.regexp_replace(c, rf"[{_BLANK}]+", " "))


def normalized_hash(code: Column) -> Column:
    return F.sha2(normalize_code(code), 256)


def tokens(code: Column, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(pattern), F.lit(0))


def code_lines(code: Column) -> Column:
    """Lines without their ends; one trailing line end adds no empty line, and empty text has none."""
    c = F.coalesce(code, F.lit(""))
    parts = F.split(c, LINE_END, -1)
    closed = F.element_at(parts, -1) == ""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.when(closed, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def truncate_lines(lines: Column, max_lines: int | None = None, max_chars: int | None = None) -> Column:
    """The first lines within the limits; a line end counts between kept lines, and the first overflow stops."""
    out = lines if max_lines is None else F.slice(lines, 1, max_lines)
    if max_chars is None:
        return out
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept"), F.lit(False).alias("full"))

    def step(acc: Column, line: Column) -> Column:
        used = acc["used"] + F.length(line) + F.when(acc["kept"] > 0, 1).otherwise(0)
        full = acc["full"] | (used > max_chars)
        return F.struct(F.when(full, acc["used"]).otherwise(used).alias("used"), (acc["kept"] + F.when(full, 0).otherwise(1)).alias("kept"), full.alias("full"))

    return F.slice(out, F.lit(1), F.aggregate(out, start, step)["kept"])


def contains_any(c: Column, terms: tuple[str, ...], fold: bool = True) -> Column:
    text = F.lower(F.coalesce(c, F.lit(""))) if fold else F.coalesce(c, F.lit(""))
    out = F.contains(text, F.lit(terms[0]))
    for t in terms[1:]:
        out = out | F.contains(text, F.lit(t))
    return out


def count_of(code: Column, piece: str) -> Column:
    c = F.coalesce(code, F.lit(""))
    return ((F.length(c) - F.length(F.replace(c, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def code_metrics(code: Column) -> dict[str, Column]:
    """The nine metrics of a body, as doubles. Tokens are cut once; identifiers are those that begin like one."""
    c = F.coalesce(code, F.lit(""))

    def counts(t: Column) -> Column:
        among = lambda *words: F.size(F.filter(t, lambda x: x.isin(*words)))
        return F.struct(F.size(t).alias("tokens"), among(*DANGEROUS_CALLS).alias("calls"), among("for", "while").alias("loops"), among("if").alias("ifs"), among("return").alias("returns"))

    n = F.transform(F.array(tokens(c)), counts)[0]  # one expression for all columns, so that it is evaluated once
    out = {
        "line_count": F.when(c == "", 0).otherwise(count_of(c, "\n") + 1),
        "char_count": F.length(c),
        "token_count": n["tokens"],
        "dangerous_api_count": n["calls"],
        "pointer_operator_count": count_of(c, "->") + count_of(c, "*") + count_of(c, "&"),
        "array_access_count": count_of(c, "["),
        "loop_count": n["loops"],
        "if_count": n["ifs"],
        "return_count": n["returns"],
    }
    return {k: v.cast("double") for k, v in out.items()}


def strip_fence(c: Column) -> Column:
    """Text inside one surrounding fence of three backticks (a json tag may follow the first), stripped."""
    pattern = r"(?is)^\s*```(?:json)?\s*(.*?)\s*```\s*$"
    return strip(F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise(c))


def crc_bucket(c: Column, n: int) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(c, F.lit("")), "UTF-8")), F.lit(n)).cast("int")


def numbered(lines: Column, start: Column) -> Column:
    """array<struct(line, text)> with absolute line numbers."""
    return F.transform(lines, lambda x, i: F.struct((start + i).cast("int").alias("line"), x.alias("text")))


def matching_lines(lines: Column, terms: tuple[str, ...]) -> Column:
    """Line numbers of numbered lines that contain any of the terms, case-sensitively."""
    return F.transform(F.filter(lines, lambda x: contains_any(x["text"], terms, fold=False)), lambda x: x["line"])


def excerpt(lines: Column, code: Column, most: int = 200) -> Column:
    """The lines joined, cut after `most` with a mark; the raw code if there are no lines."""
    cut = F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.lit("\n... [truncated]"))
    return F.when(F.coalesce(F.size(lines), F.lit(0)) <= 0, code).when(F.size(lines) <= most, F.array_join(lines, "\n")).otherwise(cut)
