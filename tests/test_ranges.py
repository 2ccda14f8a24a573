"""Readers by byte ranges against readers of whole files."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from siltstone.sources import ranges as R


@pytest.fixture
def tiny(spark):
    """Ranges of some bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def to(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield to
    for k, v in old.items():
        spark.conf.set(k, v)


def table(rng, n, end):
    bits = ["int f() {", "\n", "\r\n", '"', ",", "return 1;", "é漢", "", " ", '""', "}", "x" * 60]
    rows = [["".join(rng.choice(bits) for _ in range(rng.randint(0, 7))).strip("\r\n") + "z" for _ in range(4)] for _ in range(n)]
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL)
    w.writerows([["id", "CWE ID", "func_before", "d"], *rows])
    return rows, out.getvalue()


@pytest.mark.parametrize("size,end", [(90, "\n"), (250, "\r\n"), (1 << 20, "\n")])
def test_csv(spark, tmp_path, tiny, size, end):
    rng = random.Random(size)
    rows, text = table(rng, 40, end)
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode())
    whole = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(str(path)).collect()
    tiny(size)
    got = R.read_csv_ranges(spark, str(path)).orderBy("ord")
    assert got.columns == ["id", "CWE ID", "func_before", "d", "ord"]
    data = got.collect()
    assert [tuple(r)[:4] for r in data] == [tuple(r) for r in rows]
    # Spark's reader of whole files turns the file's line ends into line feeds within cells, too
    assert [tuple(c.replace(end, "\n") for c in r) for r in rows] == [tuple(r) for r in whole]
    assert [r["ord"] for r in data] == list(range(40))
    if size < 1000:
        assert R._segments(spark, str(path), "\n").select("place").distinct().count() > 10


def test_csv_of_odd_files(spark, tmp_path, tiny):
    tiny(20)
    for name, text in {"empty": "", "head": "a,b\n", "stray": 'a,b\n5" pipe,6" pipe\n"x\ny",2\n\n"long ' + "line\n" * 50 + '",9\nlast,"z"'}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    read = lambda n: [tuple(r) for r in R.read_csv_ranges(spark, str(tmp_path / f"{n}.csv")).orderBy("ord").collect()]
    assert read("empty") == [] and read("head") == []
    assert [r[:2] for r in read("stray")] == [('5" pipe', '6" pipe'), ("x\ny", "2"), ("long " + "line\n" * 50, "9"), ("last", "z")]
    (tmp_path / "two").mkdir()
    for n in "ab":
        (tmp_path / "two" / f"{n}.csv").write_text(f'k,v\n{n}1,"1\n2"\n{n}2,3\n')
    got = R.read_csv_ranges(spark, str(tmp_path / "two")).orderBy("ord").collect()
    assert [(r["k"], r["v"]) for r in got] == [("a1", "1\n2"), ("a2", "3"), ("b1", "1\n2"), ("b2", "3")] and len({r["ord"] for r in got}) == 4


def value(rng, depth=0):
    pick = rng.randrange(7 if depth < 3 else 4)
    if pick == 0:
        return rng.choice([None, True, 1.5, -3])
    if pick < 4:
        return "".join(rng.choice(['"', "\\", ",", "{", "}", "[", "]", "a", "é", "\n", " ", "\\\\"]) for _ in range(rng.randint(0, 12)))
    if pick == 4:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {f"k{i},": value(rng, depth + 1) for i in range(rng.randint(0, 3))}


@pytest.mark.parametrize("size,indent", [(70, None), (250, 2), (1 << 20, None)])
def test_json_arrays_and_objects(spark, tmp_path, tiny, size, indent):
    rng = random.Random(size)
    items = [value(rng) for _ in range(40)] + [{"func": "f, \"x\" }", "idx": i} for i in range(10)]
    rng.shuffle(items)
    (tmp_path / "a.json").write_text(json.dumps(items, indent=indent, ensure_ascii=False))
    members = {f"s{i}": v for i, v in enumerate(items)}
    (tmp_path / "m.json").write_text(json.dumps(members, indent=indent))
    tiny(size)
    got = R.json_records(spark, str(tmp_path / "a.json")).orderBy("ord").collect()
    assert [r["ord"] for r in got] == list(range(50))
    assert [json.loads(r["text"]) for r in got] == items
    rows = R.read_json_ranges(spark, str(tmp_path / "a.json"), "func string, idx long").where("func is not null").orderBy("ord").collect()
    assert [(r["func"], r["idx"], r["ord"]) for r in rows] == [(x["func"], x["idx"], i) for i, x in enumerate(items) if isinstance(x, dict) and "func" in x]
    both = {r["key"]: r["value"] for r in R.read_json_members(spark, str(tmp_path / "m.json")).collect()}
    assert both.keys() == members.keys()
    assert all(json.loads(both[k]) == v for k, v in members.items() if isinstance(v, dict | list))
    for n, text in (("e", "[]"), ("o", " { } "), ("n", ""), ("one", '[{"a": 1}]')):
        (tmp_path / f"{n}.json").write_text(text)
    assert [R.json_records(spark, str(tmp_path / f"{n}.json")).count() for n in ("e", "o", "n", "one")] == [0, 0, 0, 1]


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path, tiny):
    with open(tmp_path / "big.csv", "w") as out:
        out.write("id,code\n")
        for i in range(30000):
            out.write(f'{i},"line {i}\nnext ""quoted"", {i}"\n')
    with open(tmp_path / "big.json", "w") as out:
        out.write(json.dumps([{"id": i, "code": f'a, "{i}" }}'} for i in range(30000)]))
    tiny(100_000)
    rows = R.read_csv_ranges(spark, str(tmp_path / "big.csv"), "id long, code string")
    assert rows.agg(F.count("*"), F.sum("id"), F.max("ord"), F.count_if(F.col("code") == F.format_string('line %d\nnext "quoted", %d', "id", "id"))).first() == (30000, 30000 * 29999 // 2, 29999, 30000)
    items = R.read_json_ranges(spark, str(tmp_path / "big.json"), "id long, code string")
    assert items.agg(F.count("*"), F.sum("id"), F.count_if(F.col("ord") == F.col("id"))).first() == (30000, 30000 * 29999 // 2, 30000)
    assert R._segments(spark, str(tmp_path / "big.json"), ",").rdd.getNumPartitions() > 8
