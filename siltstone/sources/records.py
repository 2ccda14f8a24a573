"""JSON-lines, CSV and raw dataset readers. Schemas are always given; `ord` numbers rows in file order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.normalize import coerce_cwe, coerce_cwe_list, coerce_label, first_present, span, split_name, stable_id
from siltstone.schemas import validate
from siltstone.sources.ranges import read_csv_ranges, read_json_members, read_json_ranges


def read_jsonl(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    """Rows of a JSON-lines file with ord; blank lines are skipped, malformed ones are an error."""
    return spark.read.schema(schema).option("mode", mode).json(path).withColumn("ord", F.monotonically_increasing_id())


def read_records(spark: SparkSession, path: str, schema: str, kind: str, strict: bool = True) -> DataFrame:
    """read_jsonl with the row checks of a record kind; strict fails at the first bad row, else valid and reasons tell."""
    return validate(read_jsonl(spark, path, schema), kind, strict)


def read_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of a JSON-lines file."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).where(F.trim("value") != "")
    parsed = lines.withColumn("_j", F.try_parse_json("value"))
    ok = F.col("_j").isNotNull() & F.trim("value").startswith("{")
    return parsed.where(ok).select(F.from_json("value", schema).alias("r"), "ord").select("r.*", "ord"), parsed.where(~ok).select("ord", "value")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, quoted cells over several lines and doubled quotes, read by byte ranges; ord in file order. Without a schema all columns are text."""
    return read_csv_ranges(spark, path, schema)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON array, read by byte ranges, with ord, the place in the array; elements that are no objects are dropped."""
    return read_json_ranges(spark, path, schema)


@dataclass(frozen=True)
class Dataset:
    """How a raw dataset names its fields: the first alias that is present counts."""

    name: str
    code: tuple[str, ...]
    ids: tuple[str, ...]
    label: tuple[str, ...]
    function: tuple[str, ...] = ()
    after: tuple[str, ...] = ()

    def fields(self) -> list[str]:
        own = [*self.code, *self.ids, *self.label, *self.function, *self.after, "file", "file_name", "project", "repo", "commit_id", "commit_before", "cwe", "split"]
        return list(dict.fromkeys(own))

    def schema(self) -> str:
        """All fields as text: arrays arrive as JSON, numbers as written."""
        return ", ".join(f"`{f}` string" for f in self.fields())


DEVIGN = Dataset("devign", ("func", "function", "function_code"), ("idx", "id"), ("target", "label", "vulnerable"))
BIGVUL = Dataset("bigvul", ("func_before", "before", "func", "function"), ("id",), ("vulnerable", "target", "label"), ("function_name", "func_name"), ("after_commit", "commit_after"))
DIVERSEVUL = Dataset("diversevul", ("func", "function", "function_code"), ("id", "idx"), ("target", "label", "vulnerable"), ("function_name", "func_name"))
DATASETS = {d.name: d for d in (DEVIGN, BIGVUL, DIVERSEVUL)}


def _cwe(c: Column) -> Column:
    """Text, or an array as JSON text."""
    return F.when(F.trim(c).startswith("["), coerce_cwe_list(F.from_json(c, "array<string>"))).otherwise(coerce_cwe(c))


def normalise(rows: DataFrame, d: Dataset) -> DataFrame:
    """Sample records with code and ord, from raw rows that have the dataset's fields as text."""
    have = set(rows.columns)
    first = lambda names: first_present(*[F.col(f"`{n}`") for n in names if n in have], F.lit(None).cast("string"))
    code, file = first(d.code), F.coalesce(first(("file", "file_name")), F.lit("unknown"))
    own = F.coalesce(first(d.ids), stable_id(file, F.coalesce(code, F.lit(""))))
    raw = lambda n: F.col(f"`{n}`") if n in have else F.lit(None).cast("string")
    return rows.select(
        F.concat(F.lit(f"{d.name}_"), own).alias("sample_id"), F.lit(d.name).alias("dataset"), F.lit("c").alias("language"), first(("project", "repo")).alias("repo"),
        first(("commit_id", "commit_before")).alias("commit_before"), first(d.after).alias("commit_after"), file.alias("file"), first(d.function).alias("function"),
        span(file, code).alias("span"), coerce_label(first(d.label)).alias("label"), _cwe(raw("cwe")).alias("cwe"), split_name(raw("split")).alias("split"), code.alias("code"), "ord",
    )


def load_dataset(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A dataset file (JSON lines, or CSV for bigvul) as sample records."""
    d = DATASETS[name]
    if name == "bigvul":
        return normalise(read_csv(spark, path), d)
    return normalise(read_jsonl(spark, path, d.schema()), d)


def load_raw(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(samples, rejects) of a raw release file: a JSON array, a CSV with other column names, or JSON lines with bad ones."""
    from siltstone.operators.relational import reject_stream

    d = DATASETS[name]
    bad = None
    if name == "devign":
        rows = read_json_array(spark, path, d.schema()).withColumn("idx", F.coalesce("idx", F.col("ord").cast("string")))
    elif name == "bigvul":
        rows = read_csv(spark, path)
        header = set(rows.columns)
        get = lambda c: F.col(f"`{c}`") if c in header else F.lit(None).cast("string")
        cwe = F.trim(get("CWE ID"))
        rows = rows.withColumns({"id": F.coalesce(F.nullif(get("index"), F.lit("")), F.col("ord").cast("string")), "cwe": F.when(F.lower(cwe) != "none", F.nullif(cwe, F.lit(""))), "func_before": F.coalesce(F.nullif(get("func_before"), F.lit("")), get("processed_func"))})
    else:
        rows, bad = read_tolerant(spark, path, d.schema())
        rows = rows.withColumn("idx", F.coalesce("idx", F.col("ord").cast("string")))
    marked = reject_stream(normalise(rows, d), "code", "sample_id", "ord")
    rejects = marked.where("reason is not null").select("ord", "sample_id", "reason")
    if bad is not None:
        rejects = rejects.union(bad.select("ord", F.lit(None).cast("string"), F.lit("malformed")))
    return marked.where("reason is null").drop("reason"), rejects


def code_files(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id, code): files <sample_id>.* or files in folders sample_id=..., the first by path for each id."""
    f = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("p"))
    stem = F.regexp_replace(F.regexp_extract("p", r"([^/]*)$", 1), r"\.[^.]*$", "")
    stem = F.coalesce(F.nullif(F.regexp_extract("p", r"/sample_id=([^/]+)/[^/]*$", 1), F.lit("")), stem)
    return f.groupBy(stem.alias("sample_id")).agg(F.min_by("value", "p").alias("code"))


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, evidence): a JSON object by sample id, values as JSON text, read by byte ranges."""
    return read_json_members(spark, path).select(F.col("key").alias("sample_id"), F.col("value").alias("evidence"))
