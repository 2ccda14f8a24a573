"""The registered queries of the training-data operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import align, decontaminate, embeddings, language, mixing, ngram, oneperm, pii, repeats, runs, simhash, toxicity, urls
from siltstone.llm.common import LOWER, NOT_SPACES, UPPER, fold_of, table

#: The folder of the public tokenizers, on the driver.
TOKENIZERS = "/opt/tokenizers"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    trees = language.Trees(language.sample(docs.where(~held_out)))
    return language.identify(docs, trees).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash.group(table(spark, sf_dir, "documents"))
    return g.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _is(kind: str) -> Callable:
    return lambda x: x["kind"] == kind


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pii.find(table(spark, sf_dir, "documents"))
    n = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    every = F.array_sort(F.concat("spans", "extra"))
    return r.select("doc_id", *n, F.sha2(pii.render(F.col("spans")), 256).alias("base_sha256"), pii.render(every).alias("spans"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.group(table(spark, sf_dir, "embeddings"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def _trained(ids: list[int | None]) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2 for i in ids], dtype=bool)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ngram.score(table(spark, sf_dir, "documents"), _trained)
    return s.withColumn("held_out", fold_of(F.col("doc_id"), 7) == 2)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    classes = toxicity.Classes(*toxicity.sample(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out)))
    s = toxicity.score(docs, classes)
    return s.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's fingerprint, and that of the text with its second half replaced by the beginning of the next document."""
    r = oneperm.followed(table(spark, sf_dir, "documents"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    r = oneperm.fingerprint(r.withColumn("edited", edited), "edited", "edited_fp")
    return r.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), oneperm.hex_of(F.col("fp")).alias("fingerprint"), oneperm.hex_of(F.col("edited_fp")).alias("edited_fingerprint"),
        oneperm.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), oneperm.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs, a tenth of whose texts repeat a stretch of their words from some word on; null ids have none planted."""
    w, n, a, p = F.col("_w"), F.size("_w"), F.col("_a"), F.col("_p")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    # a text that gets none has no words here
    d = docs.select("doc_id", "text", g.alias("_g"), F.when((h % 10 == 0) & F.col("text").isNotNull(), F.regexp_extract_all("text", F.lit(f"({NOT_SPACES})"))).otherwise(F.array().cast("array<string>")).alias("_w"))
    d = d.withColumn("_a", F.when(n > 0, F.col("_g") % n).cast("int"))
    d = d.withColumn("_p", F.lit(1) + F.floor((n - a) / (3 + F.col("_g") % 8)).cast("int"))
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p)))
    return d.select("doc_id", F.when(n > 0, F.array_join(each, " ")).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs.find(with_planted_runs(table(spark, sf_dir, "documents"))).withColumn("top", runs.strongest(F.col("runs")))
    return r.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(runs.listed(F.col("runs")), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")


# -- views of what SQL can check, where it cannot express the whole result -------------------------------------------------


def language_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op2_language: the folds, and which texts have no letter."""
    return op2_language(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("no_letter"), F.col("score").between(0, 1).alias("in_range"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op4_mix_sources: sizes and targets, and whether each source's words come near its target and no document too often."""
    r = op4_mix_sources(spark, sf_dir)
    by = r.groupBy("source_size", "target").agg(F.sum("taken").alias("all"), F.max("size").alias("widest")).select(F.col("source_size").alias("s"), F.col("target").alias("t"), (F.abs(F.col("all") - F.col("target")) <= F.col("widest")).alias("near"))
    out = r.join(by, (F.col("source_size") == F.col("s")) & (F.col("target") == F.col("t")))
    return out.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "near", (F.col("taken") <= 3 * F.col("size")).alias("allowed"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op5_pii: the base spans."""
    return op5_pii(spark, sf_dir).drop("spans")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op9_lm_score: all but the model's own score."""
    return op9_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def toxicity_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op10_toxicity: the folds, and whether the prediction follows the score."""
    return op10_toxicity(spark, sf_dir).select("doc_id", "held_out", (F.col("score").between(0, 1) & ((F.col("predicted") == 1) == (F.col("score") >= 0.3))).alias("consistent"))


def _crc(text: str) -> str:
    """SQL of the CRC-32 of an ASCII text."""
    steps = ", ".join(["256"] * 8)  # after each byte, eight shifts
    byte = f"flatten(list_transform(str_split({text}, ''), lambda ch: [CAST(ascii(ch) AS BIGINT), {steps}]))"
    fold = f"list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {byte}), lambda c, x: CASE WHEN x = 256 THEN xor(c >> 1, 3988292384 * (c & 1)) ELSE xor(c, x) END)"
    return f"xor({fold}, CAST(4294967295 AS BIGINT))"


_FOLD = _crc("CAST(doc_id AS VARCHAR)")
_WORDS = r"[^\x20\x09-\x0D]+"
_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

_MIX_SQL = f"""
WITH z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, cap <= level * w AS stopped FROM l),
t AS (SELECT source, source_size, CASE WHEN stopped THEN cap ELSE least(cap, w * (total - coalesce(sum(cap) FILTER (WHERE stopped) OVER (), 0)) / sum(w) FILTER (WHERE NOT stopped) OVER ()) END AS target FROM f)
SELECT doc_id, size, source_size, round(target, 4) AS target, true AS near, true AS allowed FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source
"""

_PII_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(str_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(ltrim(x, '0'), 3) AS INT) > 255)) = 0"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", "length(g) BETWEEN 14 AND 19 AND list_sum(list_transform(generate_series(1, length(g)), lambda i: CASE WHEN (length(g) - i) % 2 = 0 THEN CAST(substr(g, i, 1) AS INT) WHEN CAST(substr(g, i, 1) AS INT) < 5 THEN 2 * CAST(substr(g, i, 1) AS INT) ELSE 2 * CAST(substr(g, i, 1) AS INT) - 9 END)) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(g) BETWEEN 10 AND 15"),
}
_PII_SQL = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), " + ", ".join(f"""
{k}_m AS (SELECT doc_id, string_split_regex(t, '{p}') AS gap, regexp_extract_all(t, '{p}') AS hit FROM d),
{k}_u AS (SELECT doc_id, unnest(hit) AS v, unnest(gap[1:len(hit)]) AS a, generate_subscripts(hit, 1) AS i FROM {k}_m WHERE len(hit) > 0),
{k}_s AS (SELECT doc_id, v, regexp_replace(v, '[^0-9]', '', 'g') AS g, sum(length(a) + length(v)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM {k}_u),
{k}_x AS (SELECT doc_id, {o} AS o, '{k}' AS kind, CAST(e - length(v) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM {k}_s WHERE {ok})""" for o, (k, (p, ok)) in enumerate(_PII_KINDS.items())) + """,
x AS (""" + " UNION ALL ".join(f"SELECT * FROM {k}_x" for k in _PII_KINDS) + """),
a AS (SELECT doc_id, """ + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in _PII_KINDS) + """, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM x GROUP BY doc_id)
SELECT doc_id, """ + ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _PII_KINDS) + """, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN a USING (doc_id)
"""

_LM_SQL = f"""
WITH d AS (SELECT doc_id, {_FOLD} % 7 = 2 AS held_out, list_concat(regexp_extract_all({_LOWER}, '{_WORDS}'), [chr(10)]) AS t FROM documents),
u AS (SELECT doc_id, held_out, unnest(t) AS w FROM d), c AS (SELECT w, count(*) AS c FROM u WHERE NOT held_out GROUP BY w), n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / CAST(n + v + 1 AS DOUBLE))), 4) AS base_score FROM u LEFT JOIN c USING (w), n GROUP BY doc_id, held_out
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (op1_decontaminate, op2_language, op3_simhash, op4_mix_sources, op5_pii, op6_embeddings, op7_repeats, op8_url_rules, op9_lm_score, op10_toxicity, op11_fingerprints, op12_runs, op13_alignment)
    return {f.__name__: f for f in (*operators, language_folds, mix_targets, pii_base, lm_base, toxicity_folds)}


def oracle_sql() -> dict[str, str]:
    """Where SQL expresses the operator, or a view of it; all are tested against brute force in tests/llm, too."""
    return {
        "op1_decontaminate": decontaminate.ORACLE_SQL, "op6_embeddings": embeddings.ORACLE_SQL, "op7_repeats": repeats.ORACLE_SQL, "op8_url_rules": urls.ORACLE_SQL,
        "language_folds": f"SELECT doc_id, {_FOLD} % 4 = 2 AS held_out, text IS NULL OR NOT regexp_matches(text, '\\p{{L}}') AS no_letter, true AS in_range FROM documents", "mix_targets": _MIX_SQL, "pii_base": _PII_SQL, "lm_base": _LM_SQL,
        "toxicity_folds": f"SELECT doc_id, {_FOLD} % 4 = 2 AS held_out, true AS consistent FROM documents",
    }
