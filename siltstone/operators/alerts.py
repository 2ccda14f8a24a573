"""Static alerts: grouping, summaries, mapping to samples by containment or overlap, wrapping into batch files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.lines import covered
from siltstone.functions.normalize import SEVERITY_WEIGHTS, UNKNOWN_WEIGHT, clamp, severity_rank, severity_weight, tidy_path
from siltstone.functions.scores import ALERT_BASE, TRACE_BONUS
from siltstone.operators.common import cut, small

# Severities that count as high, bodies of a batch file and the lines of its header.
HIGH = ("error", "critical", "high")
BATCH, HEADER = 50, 6


def grouped(alerts: DataFrame, order: str, sample_id: str = "sample_id") -> DataFrame:
    """(sample_id, alerts): each sample's alerts as an array in their order."""
    rest = [c for c in alerts.columns if c not in (sample_id, order)]
    rows = alerts.groupBy(sample_id).agg(F.sort_array(F.collect_list(F.struct(F.col(order), F.struct(*rest).alias("a")))).alias("_x"))
    return rows.select(sample_id, F.transform("_x", lambda x: x["a"]).alias("alerts"))


def static_summary(alerts: DataFrame, sample_id: str = "sample_id") -> DataFrame:
    """Per sample: alerts, distinct trace lines and queries, tool flag, highest severity; partial sums before the shuffle."""
    a = alerts.withColumn("_s", severity_rank(F.col("severity")))
    base = a.groupBy(sample_id).agg(
        F.count("*").alias("alert_count"), F.count_distinct("query_id").alias("unique_query_count"),
        F.max((F.col("tool") == "codeql").cast("int")).alias("has_codeql_alert"), F.max("_s").alias("max_severity_score"),
    )
    lines = a.select(sample_id, F.explode("trace_lines").alias("_t")).groupBy(sample_id).agg(F.count_distinct("_t").alias("trace_line_count"))
    return base.join(lines, sample_id, "left").withColumn("trace_line_count", F.coalesce("trace_line_count", F.lit(0)))


def ranker_features(alerts: DataFrame, sample_id: str = "sample_id") -> DataFrame:
    """Per sample, as doubles: alerts, any alert, high ones, distinct queries and weakness ids, trace lines with repeats."""
    base = alerts.groupBy(sample_id).agg(
        F.count("*").alias("alert_count"), F.count_if(F.lower("severity").isin(*HIGH)).alias("high_severity_count"),
        F.count_distinct("query_id").alias("unique_query_count"), F.sum(F.coalesce(F.size("trace_lines"), F.lit(0))).alias("trace_line_count"),
    )
    cwes = alerts.select(sample_id, F.explode("cwe").alias("_c")).groupBy(sample_id).agg(F.count_distinct("_c").alias("cwe_count"))
    out = base.join(cwes, sample_id, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c)
    return out.select(sample_id, n("alert_count"), F.lit(1.0).alias("has_codeql_alert"), n("high_severity_count"), n("unique_query_count"), n("cwe_count"), n("trace_line_count"))


def static_scores(alerts: DataFrame, sample_id: str = "sample_id") -> DataFrame:
    """(sample_id, static_score): the score of scores.static_score without an array a sample.

    Alerts are counted by the weight of their severity, so the sum does not depend on their order.
    """
    weights = sorted({*SEVERITY_WEIGHTS.values(), UNKNOWN_WEIGHT})
    w = severity_weight(F.col("severity"))
    a = alerts.groupBy(sample_id).agg(*[F.count_if(w == x).alias(f"w{i}") for i, x in enumerate(weights)], F.max(F.coalesce(F.size("trace_lines"), F.lit(0))).alias("traces"))
    total = F.lit(0.0)
    for i, x in enumerate(weights):
        total = total + F.lit(ALERT_BASE * x) * F.col(f"w{i}")
    return a.select(sample_id, clamp(total + F.when(F.col("traces") > 0, F.lit(TRACE_BONUS)).otherwise(0.0)).alias("static_score"))


def line_unions(alerts: DataFrame, sample_id: str = "sample_id") -> DataFrame:
    """(sample_id, alert_lines, trace_lines): sorted distinct lines."""
    a = alerts.groupBy(sample_id).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(covered(F.col("start_line"), F.col("end_line")))))).alias("alert_lines"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("trace_lines")))).alias("trace_lines"))
    return a


def cwe_mode(alerts: DataFrame, sample_id: str = "sample_id") -> DataFrame:
    """(sample_id, cwe, n): the most frequent known weakness id of each sample, the smaller among equals."""
    from siltstone.functions.normalize import unknown_cwe

    n = alerts.select(sample_id, F.explode("cwe").alias("cwe")).where(~unknown_cwe(F.col("cwe"))).groupBy(sample_id, "cwe").count()
    return n.groupBy(sample_id).agg(F.min(F.struct((-F.col("count")).alias("k"), "cwe")).alias("b")).select(sample_id, "b.cwe", (-F.col("b.k")).alias("n"))


def counters(alerts: DataFrame, sample_id: str = "sample_id") -> DataFrame:
    """(kind, key, n): alerts by query, weakness ids, and samples covered."""
    q = alerts.groupBy("query_id").count().select(F.lit("query").alias("kind"), F.col("query_id").alias("key"), F.col("count").alias("n"))
    c = alerts.select(F.explode("cwe").alias("key")).groupBy("key").count().select(F.lit("cwe").alias("kind"), "key", F.col("count").alias("n"))
    s = alerts.agg(F.count_distinct(sample_id).alias("n")).select(F.lit("samples").alias("kind"), F.lit("covered").alias("key"), "n")
    return q.union(c).union(s)


def _levels(width: Column, bin_size: int) -> Column:
    """Level of a span: its bins are bin_size * 4 ** level long, no shorter than the span, so that it touches two at most."""
    return F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(width, F.lit(1)) / F.lit(float(bin_size))))).cast("int")


def _bins(start: Column, end: Column, level: Column, bin_size: int) -> Column:
    size = F.lit(float(bin_size)) * F.pow(F.lit(4.0), level)
    return F.sequence(F.floor(start / size), F.floor(end / size))


def in_spans(points: DataFrame, spans: DataFrame, *, key: str, line: str, ids: str, bin_size: int = 1000, how: str = "left") -> DataFrame:
    """Each point with the narrowest span of its key that holds its line, the first among equals.

    spans: key, start_line, end_line, ord and others. The containment becomes an equi-join on key, level and line bin: a
    span stands in the two bins at most that it touches on the level of its width, a point in one bin of each level in
    use. Only ids, keys and lines of the points are dealt to the bins, and only hits are aggregated to the best of each point,
    which meets the point by its id. Ids that repeat or are null are an error.
    """
    s = spans.withColumnsRenamed({key: "_k", "start_line": "span_start", "end_line": "span_end", "ord": "span_ord"}).where("span_end >= span_start")
    s = s.withColumn("_l", _levels(F.col("span_end") - F.col("span_start"), bin_size))
    levels = [r[0] for r in s.select("_l").distinct().collect()]  # a row for each power of four of widths
    s = s.withColumn("_b", F.explode(_bins(F.col("span_start"), F.col("span_end"), F.col("_l"), bin_size)))
    p = points.select(F.col(ids).alias("_i"), F.col(key).alias("_pk"), F.col(line).alias("_at"), F.explode(F.array(*[F.lit(x) for x in levels or [0]])).alias("_pl"))
    p = p.withColumn("_pb", F.get(_bins(F.col("_at"), F.col("_at"), F.col("_pl"), bin_size), F.lit(0)))
    on = (F.col("_pk") == F.col("_k")) & (F.col("_pl") == F.col("_l")) & (F.col("_pb") == F.col("_b")) & F.col("_at").between(F.col("span_start"), F.col("span_end"))
    width = F.col("span_end") - F.col("span_start")
    rest = [c for c in s.columns if c not in ("_k", "_l", "_b")]
    best = p.join(s, on).groupBy("_i").agg(F.min_by(F.struct(*rest), F.when(F.col("span_ord").isNotNull(), F.struct(width, "span_ord"))).alias("_s"))
    nth = points.withColumn("_n", F.row_number().over(W.partitionBy(ids).orderBy(ids)))
    wrong = F.when(F.col(ids).isNull(), F.raise_error(F.lit(f"{ids} is null"))).when(F.col("_n") > 1, F.raise_error(F.lit(f"{ids} repeats"))).otherwise(True)
    own = [c for c in points.columns if c != ids]
    return nth.where(wrong).join(best, F.col(ids) == F.col("_i"), how).select(ids, *own, *[F.col(f"_s.{c}").alias(c) for c in rest])


#: A key of more alerts than this is dealt to slices of as many.
HEAVY = 100_000


def suffixes(path: Column) -> Column:
    """A path, forward slashes and none before it, and what follows each of its slashes."""
    parts = F.split(tidy_path(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def map_to_samples(alerts: DataFrame, samples: DataFrame, ids: str = "ord", bin_size: int = 200, heavy: int = HEAVY) -> DataFrame:
    """Alerts with sample_id of the narrowest sample span that they overlap on a matching path; null if there is none.

    Paths match if one is the other or ends with it after a slash, so the shorter, whole, equals a suffix of the longer: the
    join is one on (path, level, line bin), once with the suffixes of the samples' paths, once with those of the alerts'.
    Of samples with the same path and span only the first can be the best, and alerts with the same path and lines have the same
    best sample, so different ones alone are joined. A path that many of these alerts name is salted: they are dealt to slices,
    its spans stand in each. The best sample is an aggregate, which the alerts meet by path and lines.
    """
    s = samples.groupBy(tidy_path(F.col("span.file")).alias("s_file"), F.col("span.start_line").alias("s_start"), F.col("span.end_line").alias("s_end")).agg(F.min("sample_id").alias("sample_id"))
    s = cut(s.withColumn("_l", _levels(F.col("s_end") - F.col("s_start"), bin_size)))
    levels = [r[0] for r in s.select("_l").distinct().collect() if r[0] is not None]  # a row for each power of four of widths
    s = s.withColumn("_b", F.explode(_bins(F.col("s_start"), F.col("s_end"), F.col("_l"), bin_size)))
    a, place = alerts.drop("sample_id"), ["file", "start_line", "end_line"]
    narrow = cut(a.select(*place).distinct()).select(*place, F.explode(F.array(*[F.lit(x) for x in levels or [0]])).alias("_al"))
    narrow = narrow.withColumn("_ab", F.explode(_bins(F.col("start_line"), F.greatest("start_line", "end_line"), F.col("_al"), bin_size)))

    def met(of_alert: Column, of_sample: Column) -> DataFrame:
        left, right = narrow.withColumn("_a", of_alert), s.withColumn("_s", of_sample)
        many = cut(left.groupBy(F.col("_a").alias("_h")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > heavy).select("_h", F.ceil(F.col("_n") / heavy).cast("int").alias("_w")))
        few = small(many)
        left = left.join(few, F.col("_a") == F.col("_h"), "left").withColumn("_salt", F.when(F.col("_w").isNotNull(), F.pmod(F.xxhash64(*place), F.col("_w"))).otherwise(0)).drop("_h", "_w")
        right = right.join(few, F.col("_s") == F.col("_h"), "left").withColumn("_slot", F.explode(F.sequence(F.lit(0), F.coalesce("_w", F.lit(1)) - 1)))
        on = (F.col("_a") == F.col("_s")) & (F.col("_al") == F.col("_l")) & (F.col("_ab") == F.col("_b")) & (F.col("_salt") == F.col("_slot"))
        return left.join(right, on & (F.col("start_line") <= F.col("s_end")) & (F.col("end_line") >= F.col("s_start"))).select(*place, "sample_id", "s_start", "s_end")

    hits = met(tidy_path(F.col("file")), F.explode(suffixes(F.col("s_file")))).union(met(F.explode(suffixes(F.col("file"))), tidy_path(F.col("s_file"))))
    best = cut(hits.groupBy(*[F.col(c).alias(f"_{c}") for c in place]).agg(F.min_by("sample_id", F.struct(F.col("s_end") - F.col("s_start"), F.col("sample_id"))).alias("sample_id")))
    on = (F.col("file") == F.col("_file")) & (F.col("start_line") == F.col("_start_line")) & (F.col("end_line") == F.col("_end_line"))
    return a.join(small(best), on, "left").drop(*[f"_{c}" for c in place])


def wrap(samples: DataFrame, code: Column, order: str, sample_id: str = "sample_id", batch: int = BATCH, header: int = HEADER) -> DataFrame:
    """(sample_id, batch_file, start_line, end_line): places of the bodies in batch files; empty and one-line bodies are skipped.

    Bodies are numbered by a global rank, those without an order last; running offsets need only the bodies of one batch together.
    """
    from siltstone.functions.text import code_lines
    from siltstone.operators.relational import global_rank

    c = F.coalesce(code, F.lit(""))
    body = F.when(F.endswith(c, F.lit("\n")), c).otherwise(F.concat(c, F.lit("\n")))
    n = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))
    usable = samples.where(c.rlike(r"[^\t\n\f\r\p{Zs}]") & (F.size(code_lines(c)) >= 2)).select(F.col(sample_id), F.col(order).alias("_o"), n.alias("_n"))
    placed = global_rank(usable, F.col("_o").asc_nulls_last(), name="_r").withColumn("_b", F.floor((F.col("_r") - 1) / batch))
    w = W.partitionBy("_b").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    start = F.lit(header) + F.coalesce(F.sum(F.col("_n") + 2).over(w), F.lit(0)) + 2
    return placed.withColumn("start_line", start).select(sample_id, F.format_string("batch_%03d.c", "_b").alias("batch_file"), "start_line", (F.col("start_line") + F.col("_n") - 1).alias("end_line"))


def rebase(alerts: DataFrame) -> DataFrame:
    """Alerts of batch files (with span_start, span_end of their function) in lines of the function; outside traces go."""
    start, end = F.greatest(F.lit(1), F.col("start_line") - F.col("span_start") + 1), F.col("end_line") - F.col("span_start") + 1
    trace = F.transform(F.filter("trace_lines", lambda t: t.between(F.col("span_start"), F.col("span_end"))), lambda t: (t - F.col("span_start") + 1).cast("int"))
    return alerts.withColumns({"start_line": start.cast("int"), "end_line": F.greatest(start, end).cast("int"), "trace_lines": trace})
