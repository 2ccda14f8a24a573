"""Information-theoretic sanitisation of personal data.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. Of each value the corpus is asked which words
disclose it: with N documents, n(e) that hold the value, n(t) the word, n(e, t) both, the disclosure is PMI / IC =
log(N n(e,t) / (n(e) n(t))) / log(N / n(e)), 1 for a word that stands only with the value, anywhere in its documents.
Words above `generalise` are replaced by a general term (the class that their form shows: a
number, a code, a name or another term), above `remove` they go, in all documents. Words within values
are not counted. A word passes only if n(t) <= N ** (1 - generalise) * n(e) ** generalise, as n(e, t) <= n(e); this leaves
out pairs before they are counted. A value in fewer than `support` documents discloses nothing by count. Values that stand in the same documents are counted as one, and so are words.

Defined cases: null texts are empty and have no spans; repeated rows are judged alike, and count each in n but once for the
support; null ids are allowed; texts of any length are taken whole, as one value of a task; equal disclosures are no tie, as each word
is judged for itself; empty tables give no rows; offsets are in code points, the end exclusive; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import alnum_words, ascii_lower, free_names, small, stage

# Each pattern finds the leftmost, longest matches in one pass: runs start where the class starts (or at the end of the
# match before), and quantifiers are possessive or bounded, so no text makes a search quadratic or deep.
_MAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone")
#: What a text must hold before a pattern is tried on it.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": "+"}
_PATTERNS = {"email": _MAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}
TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "gone": ""}


def general(v: Column) -> Column:
    """The general term of a word: the class that its form shows."""
    return F.when(v.rlike(r"^[0-9]+$"), "[NUMBER]").when(v.rlike(r"[0-9]"), "[CODE]").when(v.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digit string passes the Luhn check."""
    d = F.split(F.reverse(digits), "")
    each = F.transform(F.filter(d, lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") < 5, x.cast("int") * 2).otherwise(x.cast("int") * 2 - 9)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return luhn(_digits(v))
    if kind == "phone":
        return F.length(_digits(v)).between(10, 15)
    return F.lit(True)


def _cuts(text: Column, pattern: Column | str, kind: str, order: int) -> Column:
    """array<struct(s, o, e, kind, v)> of a pattern's matches, from the pieces between them and the matches themselves."""
    pat = F.lit(pattern) if isinstance(pattern, str) else pattern
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pat, F.lit(0))
    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("a"), found.alias("v"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,o:int,e:int,kind:string,v:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["a"])
        e = s + F.length(x["v"])
        one = F.struct(s.alias("s"), F.lit(order).alias("o"), e.alias("e"), F.lit(kind).alias("kind"), x["v"].alias("v"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(pairs, start, step)["out"]


def _checked(cuts: Column, kind: str) -> Column:
    return F.filter(cuts, lambda x: _valid(kind, x["v"]))


def base_spans(text: Column) -> Column:
    """array<struct(s, o, e, kind, v)> of the valid base matches, by start, then kind."""
    none = F.array().cast("array<struct<s:int,o:int,e:int,kind:string,v:string>>")
    found = []
    for o, kind in enumerate(KINDS):
        hint = F.contains(text, F.lit(_HINTS[kind])) if len(_HINTS[kind]) == 1 else text.rlike(_HINTS[kind])
        found.append(F.when(hint, _checked(_cuts(text, _PATTERNS[kind], kind, o), kind)).otherwise(none))
    return F.array_sort(F.concat(*found))


def _own_words(text: Column, spans: Column) -> Column:
    """Distinct words outside of the spans."""
    return F.array_distinct(alnum_words(redact(text, spans, F.lit(" "))))


def disclosing_terms(found: DataFrame, docs: DataFrame, *, generalise: float = 0.85, remove: float = 0.95, support: int = 3) -> DataFrame:
    """(term, disclosure, action): words that disclose a protected value, with the highest disclosure of any.

    found: (k, text, spans), the rows with spans; docs: (k, text). Counts are over all rows; a pair needs `support` documents.
    """
    n_all = docs.count()
    n = F.lit(float(n_all))
    once = stage(found.groupBy("k").agg(F.count("*").alias("m"), F.first("spans").alias("spans"), F.first("text").alias("text")))
    held = once.select("k", "m", F.explode(F.array_distinct("spans.v")).alias("v"))
    mark = F.bit_xor(F.xxhash64("k"))  # the same for what stands in the same documents
    values = held.groupBy("v").agg(F.sum("m").alias("n_e"), F.count("*").alias("n_d"), mark.alias("x")).where((F.col("n_d") >= support) & (F.col("n_e") < n_all))
    most = F.pow(n, F.lit(1 - generalise)) * F.pow("n_e", F.lit(generalise)) * (1 + 1e-9)
    values = stage(values.select("v", "n_e", F.xxhash64("x", "n_d").alias("e"), most.alias("most")))
    held = stage(held.join(small(values), "v").select("k", "m", "e", "n_e", "most").distinct())
    reach = held.groupBy("k").agg(F.max("most").alias("most"))
    told = stage(once.join(small(reach), "k", "left").select("k", "m", "most", F.explode(_own_words(F.col("text"), F.col("spans"))).alias("term")))
    by = F.col("most").isNotNull()
    terms = told.groupBy("term").agg(F.sum("m").alias("n_h"), F.count_if(by).alias("n_d"), F.bit_xor(F.when(by, F.xxhash64("k"))).alias("x"), F.max("most").alias("most"))
    terms = stage(terms.where((F.col("n_d") >= support) & (F.col("n_h") <= F.col("most"))))
    if terms.isEmpty():
        return terms.select("term", F.lit(0.0).alias("disclosure"), F.lit("").alias("action")).where("false")
    bare = docs.where(F.size(base_spans(F.col("text"))) == 0).select(F.explode(F.array_distinct(alnum_words(F.col("text")))).alias("term"))
    bare = bare.join(small(terms.select("term")), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_f"))
    n_t = F.col("n_h") + F.coalesce("n_f", F.lit(0))
    terms = terms.join(bare, "term", "left").withColumn("n_t", n_t).where(F.col("n_t") <= F.col("most"))
    terms = stage(terms.select("term", "n_t", F.xxhash64("x", "n_d", "n_t").alias("t")))
    stands = told.where(by).join(small(terms), "term").select("k", "t", "n_t").distinct()
    pairs = held.join(stands, "k").where(F.col("n_t") <= F.col("most")).groupBy("e", "t").agg(F.sum("m").alias("n_et"), F.count("*").alias("n_d"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    pmi, ic = F.ln(n * F.col("n_et") / (F.col("n_e") * F.col("n_t"))), F.ln(n / F.col("n_e"))
    best = pairs.where(F.col("n_d") >= support).groupBy("t").agg(F.max(pmi / ic).alias("disclosure")).where(F.col("disclosure") >= generalise)
    action = F.when(F.col("disclosure") >= remove, "gone").otherwise("term")
    return terms.join(best, "t").select("term", "disclosure", action.alias("action"))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """(k, doc_id, text, spans, extra): spans by the base patterns; extra, those of disclosing words, kinds term and gone."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.xxhash64(F.col(id_col), text).alias("k"), F.col(id_col).alias("doc_id"), text.alias("text"))
    held = stage(d.select("k", "doc_id", "text", base_spans(F.col("text")).alias("spans")).where("size(spans) > 0"))
    terms = stage(disclosing_terms(held, d, **kw))
    words = d.select("k", F.explode(F.array_distinct(alnum_words(F.col("text")))).alias("term"))
    # a document's own terms are gathered: sets, so that repeated rows add nothing
    by_doc = words.join(small(terms), "term").groupBy("k").agg(F.collect_set("term").alias("terms"), F.collect_set(F.when(F.col("action") == "gone", F.col("term"))).alias("gone"))
    some = held.select("k", "spans").distinct().join(stage(by_doc), "k", "full").withColumnRenamed("k", "s_k")
    out = d.join(stage(some).hint("merge"), F.col("k") == F.col("s_k"), "left")  # a twentieth of the documents or more: too large to broadcast
    none = F.array().cast("array<struct<s:int,o:int,e:int,kind:string,v:string>>")
    word = F.concat(F.lit(r"(?<![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?i:"), F.array_join("terms", "|"), F.lit(r")(?![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"))
    out = out.withColumn("spans", F.coalesce("spans", none)).withColumn("pattern", word)
    cuts = F.transform(_cuts(F.col("text"), F.col("pattern"), "term", len(KINDS)), lambda x: x.withField("kind", F.when(F.array_contains("gone", ascii_lower(x["v"])), "gone").otherwise("term")))
    free = F.filter(cuts, lambda x: ~F.exists("spans", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    extra = F.when(F.col("terms").isNotNull(), F.array_sort(free)).otherwise(none)
    return out.select("k", "doc_id", "text", "spans", extra.alias("extra"))


def render(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def redact(text: Column, spans: Column, by: Column | None = None) -> Column:
    """text with each span replaced by its kind's tag, a term by its general one, or all by `by`; overlapping spans become one, tagged as the first."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    tag = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        piece = F.substring(text, acc["at"] + 1, x["s"] - acc["at"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(piece, by if by is not None else F.when(x["kind"] == "term", general(x["v"])).otherwise(F.element_at(tag, x["kind"]))))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(F.array_sort(spans), start, step)
    return F.transform(F.array(done), lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, d["at"] + 1, F.length(text))))[0]


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs with the text sanitised; all rows and columns kept, null texts stay null."""
    key, clean = free_names(docs, "safe_key", "safe_text")
    f = find(docs, id_col=id_col, text_col=text_col, **kw).where("size(spans) > 0 or size(extra) > 0").select(F.col("k").alias(key), redact(F.col("text"), F.concat("spans", "extra")).alias(clean)).dropDuplicates([key])
    text = F.col(text_col)
    out = docs.join(stage(f), F.xxhash64(F.col(id_col), F.coalesce(text, F.lit(""))) == F.col(key), "left")
    return out.withColumn(text_col, F.coalesce(clean, text_col)).drop(clean, key)
