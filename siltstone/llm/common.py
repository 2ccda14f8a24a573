"""Shared helpers of the training-data operators: staging tables, text columns, size-checked joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters between words: ASCII space and the controls \t \n \v \f \r.
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACES = r"[^\x20\x09-\x0D]+"
#: ASCII that is neither letter nor digit; all of it separates alphanumeric words.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ALNUM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A side of a join is broadcast only after its rows and bytes were counted and are no more than these.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, it is one of our own in local mode (tests), an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="siltstone-"))
    return sc.getCheckpointDir()


def stage(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def n_staged() -> int:
    """Tables staged so far, for sweep()."""
    return len(_made)


def sweep(since: int) -> None:
    """Delete the tables staged after the first `since`, but for the latest, which must not read the others any more."""
    for spark, path in _made[since:-1]:
        _delete(spark, path)
    _made[since:-1] = []


@atexit.register
def release() -> None:
    """Delete the staged tables; results that still read them must have been written before."""
    while _made:
        try:
            _delete(*_made.pop())
        except Exception:  # the session may be gone by the time the interpreter exits
            return


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has no more than `rows` rows and `size` bytes, by counting both."""
    wide = [F.octet_length(F.col(f"`{c}`").cast("string")) for c, t in df.dtypes if t in ("string", "binary") or "<" in t]
    width = F.lit(16 * len(df.columns))
    for w in wide:
        width = width + F.coalesce(w, F.lit(0))
    n, held = df.agg(F.count(F.lit(1)), F.sum(width)).first()
    return n <= rows and (held or 0) <= size


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if counts prove it small; else df as it is (shuffle join)."""
    return F.broadcast(df) if is_small(df, rows, size) else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that df has (names do not differ by case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
        taken.add(n.lower())
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the byte-wise path, the rest a character map."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def alnum_words(c: Column) -> Column:
    """Lower-cased words of letters, digits and non-ASCII characters; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), NOT_ALNUM), "")


def n_spaced_words(c: Column) -> Column:
    """Number of words between ASCII white space; null has 0."""
    return F.coalesce(F.regexp_count(c, F.lit(NOT_SPACES)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def sample_ids(rows: DataFrame, n: int) -> DataFrame:
    """(label, i): of each label the n distinct ids (not null) with the smallest hash, from rows (label, i).

    A sketch of each label's distinct ids gives a hash below which some 2 n ids lie, so repeated rows change nothing and
    what meets in a window does not grow with the table.
    """
    rows = rows.where("i is not null and label is not null")
    count = stage(rows.groupBy("label").agg(F.approx_count_distinct("i").alias("_c"))).withColumnRenamed("label", "_l")
    r = F.pmod(F.xxhash64("i"), F.lit(1 << 40)) / float(1 << 40)
    near = rows.join(small(count), F.col("label") == F.col("_l")).withColumn("_r", r).where(F.col("_r") * F.col("_c") <= 2 * n + 100).select("label", "i", "_r").distinct()
    order = W.partitionBy("label").orderBy("_r", "i")
    return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).select("label", "i")


def sample_texts(rows: DataFrame, n: int, labelled: DataFrame | None = None) -> dict:
    """label to whole texts: of each label n ids at most, one text an id, in order of the ids.

    rows (label, i, t), or rows (i, t) with labelled (label, i). Ids only meet; of the chosen ones the smallest text an id is
    fetched, so that repeated rows bring one text to the driver, which holds n texts a label.
    """
    own = labelled is None
    chosen = stage(sample_ids(rows.select("label", "i") if own else labelled, n)).withColumnsRenamed({"label": "c_label", "i": "c_i"})
    on = (F.col("i") == F.col("c_i")) & (F.col("label") == F.col("c_label")) if own else F.col("i") == F.col("c_i")
    near = rows.join(small(chosen), on).select(F.col("c_label").alias("label"), "i", "t")
    out: dict = {}
    for label, _, t in near.groupBy("label", "i").agg(F.min("t").alias("t")).orderBy("i").collect():
        out.setdefault(label, []).append(t)
    return out
