"""What the containment and mapping joins move."""

import pytest
from pyspark.errors import PySparkException

from siltstone.operators import alerts as A


def test_equal_alerts_and_spans_are_joined_once(spark, monkeypatch):
    samples = [(i, (["/src/a.c", "src/a.c", "b.c"][i % 3], 1 + i % 2, 9 + i % 2)) for i in range(600)]
    alerts = [(i, ["a.c", "x/b.c", None][i % 3], 3, 4 + i % 2) for i in range(900)]
    s = spark.createDataFrame(samples, "sample_id long, span struct<file:string,start_line:int,end_line:int>")
    a = spark.createDataFrame(alerts, "ord long, file string, start_line int, end_line int")
    held = []
    monkeypatch.setattr(A, "cut", lambda df, own=A.cut: (out := own(df), held.append(out.count()))[0])
    got = {r["ord"]: r["sample_id"] for r in A.map_to_samples(a, s).collect()}
    assert got == {i: {"a.c": 0, "x/b.c": 2, None: None}[f] for i, f, *_ in alerts}
    assert held and max(held) <= 6


def test_repeated_points_are_an_error_even_if_ids_are_not_asked_for(spark):
    spans = spark.createDataFrame([("k", 1, 9, 1), ("k", 2, 3, 2)], "k string, start_line int, end_line int, ord int")
    points = spark.createDataFrame([(1, "k", 2), (1, "k", 2)], "p int, k string, line int")
    with pytest.raises(PySparkException, match="p repeats"):
        A.in_spans(points, spans, key="k", line="line", ids="p").select("span_ord").collect()
    with pytest.raises(PySparkException, match="p is null"):
        A.in_spans(spark.createDataFrame([(None, "k", 2)], points.schema), spans, key="k", line="line", ids="p").collect()


def test_batch_files_after_the_thousandth_keep_their_own_names(spark):
    from pyspark.sql import functions as F

    df = spark.range(1102).select(F.col("id").alias("sample_id"), F.lit("a\nb\n").alias("c"))
    got = {r["sample_id"]: r["batch_file"] for r in A.wrap(df, F.col("c"), "sample_id", batch=1).collect()}
    assert got[100] == "batch_100.c" and got[1000] == "batch_1000.c" and len(set(got.values())) == 1102


def test_bodies_of_blanks_are_skipped_as_in_sql(spark):
    from pyspark.sql import functions as F

    texts = ["a\nb", " \n\t\n", " \n ", " \n \n", "\x0b\n\x0b", None, "", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "sample_id int, c string")
    assert sorted(r["sample_id"] for r in A.wrap(df, F.col("c"), "sample_id").collect()) == [0, 4]


def test_bodies_without_an_order_come_last_as_in_sql(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(2, "a\nb"), (None, "a\nb\nc\nd"), (1, "a\nb\nc"), (-3, "a\nb")], "sample_id int, c string")
    got = {r["sample_id"]: (r["batch_file"], r["start_line"], r["end_line"]) for r in A.wrap(df, F.col("c"), "sample_id", batch=3).collect()}
    assert got == {-3: ("batch_000.c", 8, 9), 1: ("batch_000.c", 12, 14), 2: ("batch_000.c", 17, 18), None: ("batch_001.c", 8, 11)}
