"""Benchmark decontamination over a distributed positional inverted index.

Test texts are cut into windows of 13 words. The index stores, for the rarest terms of the windows, the postings
(document, position) of the training tokens, and each document's length. A window's rarest list, shifted by the term's
offset in the window, is intersected with the shifted list of its next rarest term; what survives is compared with the
window word by word. Proximity matches (`slop`) are checked alike: each word of the window must stand within `slop`
words of its place.

Defined cases: null or empty texts have no words; texts of any length are taken whole, as one row of a task; terms of equal
frequency are taken by their offset, which changes no result; repeated rows are judged each on its own and alike; rows that share
an id but not the text are kept apart; null ids are allowed; an item of fewer words than a window is one window, an item
without words none; empty tables give no hits; other columns of either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import alnum_words, free_names, is_small, small, stage


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, text): id and content hash identify a document, so repeated ids with other texts stay apart."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"), text.alias("text"))


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = 13) -> DataFrame:
    """(item_id, phrase): the distinct word windows of each item, phrase being the words joined by a space."""
    w = items.select(F.col(id_col).alias("item_id"), alnum_words(F.col(text_col)).alias("w")).where("size(w) > 0")
    cut = F.expr(f"transform(sequence(1, greatest(1, size(w) - {n - 1})), i -> array_join(slice(w, i, {n}), ' '))")
    return w.select("item_id", F.explode(cut).alias("phrase")).distinct()


#: Stands after a document's last word, so that its posting tells the length; no word has this character.
LENGTH = "\0"


def tokens(keyed_docs: DataFrame) -> DataFrame:
    return keyed_docs.select("doc_id", "h", F.posexplode(alnum_words(F.col("text"))).alias("pos", "term"))


def anchors(keyed_docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, n, rare): for each phrase whose words all occur in the corpus, its two rarest (term, offset)."""
    terms = phrases.select("phrase", F.posexplode(F.split("phrase", " ")).alias("off", "term"))
    vocabulary = stage(terms.select("term").distinct())
    if is_small(vocabulary):
        freq = tokens(keyed_docs).join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").count()
    else:  # count first: partial counts are merged before anything meets by term
        freq = tokens(keyed_docs).groupBy("term").count().join(vocabulary, "term", "left_semi")
    ranked = terms.join(small(stage(freq)), "term", "left").groupBy("phrase").agg(
        F.count("*").cast("int").alias("n"),
        F.count("count").alias("known"),
        F.sort_array(F.collect_list(F.struct("count", "off", "term"))).alias("rare"),  # at most a window's words
    )
    return ranked.where("known = n").select("phrase", "n", F.slice("rare", 1, 2).alias("rare"))


def index(keyed_docs: DataFrame, anchor: DataFrame) -> DataFrame:
    """The stored postings (term, doc_id, h, pos) of every anchor term, sorted by term within each file, and a posting of
    LENGTH at every document's end: one pass over the texts gives both."""
    mark = keyed_docs.sparkSession.range(1).select(F.lit(LENGTH).alias("i_term"))
    terms = stage(anchor.select(F.explode("rare.term").alias("i_term")).distinct().union(mark))
    words = F.concat(alnum_words(F.col("text")), F.array(F.lit(LENGTH)))
    every = keyed_docs.select("doc_id", "h", F.posexplode(words).alias("pos", "term"))
    return stage(every.join(small(terms), F.col("term") == F.col("i_term")).select("term", "doc_id", "h", "pos").sortWithinPartitions("term", "doc_id", "h", "pos"))


def intersect(postings: DataFrame, anchor: DataFrame, slop: int = 0) -> DataFrame:
    """(phrase, n, doc_id, h, start): places where the two rarest terms of a phrase stand at their offsets.

    slop > 0: the second term may be up to `slop` words from its place; these are candidates for proximity matches.
    """
    a = anchor.select("phrase", "n", F.col("rare")[0].alias("r"), F.get("rare", F.lit(1)).alias("q"))
    first = postings.join(small(a), F.col("term") == F.col("r.term")).select(
        "phrase", "n", "doc_id", "h", (F.col("pos") - F.col("r.off")).alias("start"), "q"
    ).where(F.col("start") >= -slop)
    alone = first.where("q is null").select("phrase", "n", "doc_id", "h", "start")
    shift = F.explode(F.sequence(F.lit(-slop), F.lit(slop))) if slop else F.lit(0)
    wanted = first.where("q is not null").select(
        "phrase", "n", "doc_id", "h", "start", F.col("q.term").alias("term"), (F.col("start") + F.col("q.off")).alias("place"), shift.alias("shift")
    ).select("phrase", "n", "doc_id", "h", "start", "term", (F.col("place") + F.col("shift")).alias("pos"))
    p = postings.select("term", F.col("doc_id").alias("p_id"), F.col("h").alias("p_h"), F.col("pos").alias("p_pos"))
    on = F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("h") == F.col("p_h")) & (F.col("pos") == F.col("p_pos"))
    w = wanted.withColumnRenamed("term", "w_term")
    both = w.join(p, on & (F.col("w_term") == F.col("term")), "left_semi").select("phrase", "n", "doc_id", "h", "start")
    return both.union(alone).distinct()


def phrase_matches(keyed_docs: DataFrame, found: DataFrame, slop: int = 0) -> DataFrame:
    """Those of the candidate places where the phrase stands word by word; slop > 0: where each of its words stands up to
    `slop` words from its place, seen from the rarest word."""
    ids = small(stage(found.select("doc_id", "h").distinct())).withColumnsRenamed({"doc_id": "c_id", "h": "c_h"})
    text = keyed_docs.join(ids, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h")), "left_semi").distinct()
    words = text.select(F.col("doc_id").alias("t_id"), F.col("h").alias("t_h"), alnum_words(F.col("text")).alias("w"))
    on = F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("h") == F.col("t_h"))
    if slop:
        near = lambda x, i: F.array_contains(F.slice("w", F.greatest(F.lit(1), F.col("start") + i + 1 - slop), F.greatest(F.lit(0), F.least(F.col("start") + i + 1 + slop, F.lit(2 * slop + 1)))), x)
        good = F.forall(F.transform(F.split("phrase", " "), near), lambda b: b)
    else:
        good = F.array_join(F.slice("w", F.col("start") + 1, F.col("n")), " ") == F.col("phrase")
    return words.join(found, on).where(good).select("phrase", "n", "doc_id", "h", "start")


def _search(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, n: int, slop: int) -> tuple[DataFrame, DataFrame]:
    """The matches, and the postings that they were found in."""
    k = keyed(docs, id_col, text_col)
    win = stage(windows(items, item_col, item_text, n))
    anchor = stage(anchors(k, win.select("phrase").distinct()))
    postings = index(k, anchor)
    found = stage(intersect(postings.where(F.col("term") != LENGTH), anchor, slop))
    return win.join(phrase_matches(k, found, slop), "phrase"), postings


def find(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 13, slop: int = 0) -> DataFrame:
    """(item_id, phrase, n, doc_id, h, start) of every occurrence of an item's window; with slop, of proximity matches, whose
    start is where the window would begin as seen from its rarest word (-slop or more)."""
    return _search(docs, items, id_col, text_col, item_col, item_text, n, slop)[0]


def report(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 13, slop: int = 0, share: int = 20) -> DataFrame:
    """A row per document: n_words, n_hit, n_items, items (ids as sorted strings), contaminated (share * n_hit >= n_words).

    With slop, the n words from a proximity match's start on count as hit, as far as the document has them.
    """
    matches, postings = _search(docs, items, id_col, text_col, item_col, item_text, n, slop)
    found = stage(matches.select("item_id", "n", "doc_id", "h", "start"))
    every = postings.where(F.col("term") == LENGTH).select("doc_id", "h", F.col("pos").cast("long").alias("n_words"))
    spots = found.select("doc_id", "h", "start", "n").distinct()
    hit = spots.select("doc_id", "h", F.explode(F.expr("sequence(start, start + n - 1)")).alias("p")).distinct()
    if slop:
        ends = every.distinct().withColumnsRenamed({"doc_id": "e_id", "h": "e_h"})
        hit = hit.join(ends, F.col("doc_id").eqNullSafe(F.col("e_id")) & (F.col("h") == F.col("e_h"))).where("p >= 0 and p < n_words")
    hit = hit.groupBy("doc_id", "h").agg(F.count("*").alias("n_hit"))
    # an item list per document is what the report returns; it is no longer than the benchmark
    which = found.select("doc_id", "h", "item_id").distinct().groupBy("doc_id", "h").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    hits = hit.join(which, hit.doc_id.eqNullSafe(which.doc_id) & (hit.h == which.h)).select(hit.doc_id.alias("f_id"), hit.h.alias("f_h"), "n_hit", "n_items", "items")
    out = every.join(small(stage(hits)), every.doc_id.eqNullSafe(F.col("f_id")) & (every.h == F.col("f_h")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id", "h", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs without the contaminated ones, all columns kept."""
    i, h = free_names(docs, "bad_id", "bad_h")
    bad = report(docs, items, id_col=id_col, text_col=text_col, **kw).where("contaminated").select(F.col("doc_id").alias(i), F.col("h").alias(h)).distinct()
    bad = small(stage(bad))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(i)) & (F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)) == F.col(h)), "left_anti")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10ffff}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10ffff}]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + 12], ' ') AS phrase FROM bs),
ns AS (SELECT DISTINCT n FROM win),
ds AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, ns WHERE len(w) >= n),
occ AS (SELECT DISTINCT ds.doc_id, win.item_id, ds.s, ds.n FROM ds JOIN win ON ds.n = win.n AND array_to_string(ds.w[ds.s:ds.s + ds.n - 1], ' ') = win.phrase),
pos AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM occ),
hit AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM occ GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
