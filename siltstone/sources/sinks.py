"""Writers of records, metric tables and reports."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> int:
    """Overwrites path with JSON lines, null fields kept, and returns the number of rows, counted in what was written.

    An observation would count while writing, but its manager stays with the session and keeps models from being sent to tasks.
    """
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return df.sparkSession.read.text(path).count()


def write_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """The columns in order; doubles with six decimals, null as empty."""
    kinds = dict(df.dtypes)
    df.select(*[(F.when(F.col(c).isNotNull(), F.format_string("%.6f", c)) if kinds[c] == "double" else F.col(c)).alias(c) for c in columns]).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def concat(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that one lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def case_file(df: DataFrame, path: str) -> int:
    """The verified cases with their fixed fields."""
    return write_jsonl(df.select("sample_id", "rank", "rank_score", "label", "verdict", "confidence", "predicted_cwe", "vulnerable_lines", "evidence", "patch_hint"), path)


def write_joined(rows: DataFrame, order: str, column: str, path: str, head: str, tail: str) -> None:
    """One text file: head, the column of the rows by order (unique) with commas between them, tail.

    Tasks write the sorted rows as parts, which the file system then joins: by reference where it can (HDFS), else by copying
    bytes from part to file. No row passes the driver, and the file appears under its name when it is whole.
    """
    spark = rows.sparkSession
    last = rows.agg(F.max(order)).first()[0]
    text = F.concat(column, F.when(F.col(order) == F.lit(last), "").otherwise(","))
    parts = f"{path}.parts"
    rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order).select(text.alias("value")).write.mode("overwrite").text(parts)
    put_text(spark, f"{parts}/_head", head + "\n")
    put_text(spark, f"{parts}/_tail", tail + "\n")
    join_files(spark, [f"{parts}/_head", *part_files(spark, parts), f"{parts}/_tail"], path)
    _path(spark, parts)[1].delete(_path(spark, parts)[0], True)


def _path(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """A Hadoop path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def part_files(spark: SparkSession, folder: str) -> list[str]:
    """A written table's files in the order of the tasks that wrote them."""
    p, fs = _path(spark, folder)
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-") and s.getLen())


def join_files(spark: SparkSession, files: list[str], path: str) -> None:
    """The files' bytes, one after the other, as a file at path; the files may be used up."""
    first, fs = _path(spark, files[0])
    to = _path(spark, path)[0]
    rest = [_path(spark, f)[0] for f in files[1:]]
    if rest:
        try:
            array = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(rest))
            for i, r in enumerate(rest):
                array[i] = r
            fs.concat(first, array)
        except Exception as e:  # a file system without it says so
            if "UnsupportedOperation" not in f"{type(e).__name__} {e}":
                raise
            joined = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.joined")
            out = fs.create(joined, True)
            try:
                for f in (first, *rest):
                    source = fs.open(f)
                    try:
                        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                    finally:
                        source.close()
            finally:
                out.close()
            first = joined
    fs.delete(to, False)
    if not fs.rename(first, to):
        raise OSError(f"cannot write {path}")


def write_report(totals: DataFrame, rows: DataFrame, path: str, metadata: dict[str, Any] | None = None) -> int:
    """One JSON file of findings, by id (unique), with metadata, total and vulnerable_count; returns the total."""
    t = totals.first().asDict()
    head = {"metadata": metadata or {}} | t
    write_joined(rows, "sample_id", "json", path, json.dumps(head, ensure_ascii=False)[:-1] + ', "findings": [', "]}")
    return int(t["total"])


def write_sarif(rules: DataFrame, results: DataFrame, path: str, tool: str = "siltstone") -> None:
    """One SARIF 2.1.0 file, results by ord (unique); the rules are few."""
    ids = [{"id": r[0]} for r in rules.orderBy("ord", "rule").select("rule").collect()]
    head = {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json"}
    write_joined(results, "ord", "json", path, json.dumps(head)[:-1] + ', "runs": [{"tool": {"driver": ' + json.dumps({"name": tool, "rules": ids}) + '}, "results": [', "]}]}")


def flatten(metrics: dict[str, Any], prefix: str = "") -> dict[str, Any]:
    """Nested metrics with dotted keys."""
    out: dict[str, Any] = {}
    for k, v in metrics.items():
        out |= flatten(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def show(v: Any) -> str:
    """A metric for display."""
    return "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file at any path that Spark can write."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_metrics(metrics: dict[str, Any], folder: str, spark: SparkSession | None = None) -> list[str]:
    """Metric files of one evaluation: a JSON file a block, all of them, a CSV and a Markdown summary. Driver-sized.

    With a session the folder may be anywhere that Spark writes, else it is a local one.
    """
    out = Path(folder)
    if spark is None:
        out.mkdir(parents=True, exist_ok=True)
    put = (lambda name, text: put_text(spark, f"{folder}/{name}", text)) if spark is not None else (lambda name, text: (out / name).write_text(text, encoding="utf-8"))
    files = {f"{k}_metrics.json": v for k, v in metrics.items() if isinstance(v, dict)} | {"metrics.json": metrics}
    for name, v in files.items():
        put(name, json.dumps(v, indent=2, ensure_ascii=False))
    flat = flatten(metrics)
    put("summary.csv", "metric,value\n" + "".join(f"{k},{'' if v is None else v}\n" for k, v in flat.items()))
    put("summary.md", "# Evaluation\n\n| metric | value |\n|---|---|\n" + "".join(f"| {k} | {show(v)} |\n" for k, v in flat.items()))
    return sorted([*files, "summary.csv", "summary.md"])


def load_config(*paths: str, spark: SparkSession | None = None) -> dict[str, Any]:
    """Shallow merge of JSON config files, later ones win; YAML if a parser is installed. With a session, from anywhere that Spark reads."""
    out: dict[str, Any] = {}
    for p in paths:
        text = spark.read.text(p, wholetext=True).first()[0] if spark is not None else Path(p).read_text(encoding="utf-8")
        if p.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise RuntimeError("reading YAML needs the yaml package") from e
            out |= yaml.safe_load(text) or {}
        else:
            out |= json.loads(text)
    return out
