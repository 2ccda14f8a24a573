"""The per-sample functions on streams: they keep no state, so batch and stream share them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scores import final_score, label_of, static_score, verdict_score
from siltstone.functions.text import code_metrics, normalized_hash
from siltstone.schemas import validate


def enrich(samples: DataFrame, code: str = "code") -> DataFrame:
    """Samples of a stream or a batch with digest and code metrics."""
    return samples.withColumns({"digest": normalized_hash(F.col(code)), **code_metrics(F.col(code))})


def score(signals: DataFrame, threshold: float = 0.5) -> DataFrame:
    """signals (alerts, rank_score, verdict, confidence) with the scores and the label."""
    s = signals.withColumns({"static_score": static_score(F.col("alerts")), "llm_score": verdict_score(F.col("verdict"), F.col("confidence"))})
    s = s.withColumn("final_score", final_score(F.col("static_score"), F.coalesce("rank_score", F.lit(0.0)), F.col("llm_score")))
    return s.withColumn("final_label", label_of(F.col("final_score"), threshold))


def accept(records: DataFrame, kind: str) -> DataFrame:
    """Valid records only."""
    return validate(records, kind).where("valid").drop("valid", "reasons")


def first_seen(samples: DataFrame, time: str, delay: str = "1 hour", code: str = "code") -> DataFrame:
    """Samples of a stream without later copies that come within the delay; state is bounded by the watermark."""
    return samples.withColumn("digest", normalized_hash(F.col(code))).withWatermark(time, delay).dropDuplicatesWithinWatermark(["digest"])
