"""How often files read by byte ranges are scanned, and batches of their segments."""

import pyarrow as pa

from siltstone.sources import ranges


def test_segments_of_a_range_stay_together():
    b = [pa.RecordBatch.from_pydict({"v": ["a", "", "c"], "file": ["x", "x", "x"], "place": [0, 0, 9]}), pa.RecordBatch.from_pydict({"v": ["d", "e"], "file": ["x", "y"], "place": [9, 9]}), pa.RecordBatch.from_pydict({"v": [], "file": [], "place": []})]
    got = [(k, b"".join(ranges._joined(v) for v in parts)) for k, parts in ranges._ranges(iter(b))]
    assert got == [(("x", 0), b"a,,"), (("x", 9), b"c,d,"), (("y", 9), b"e,")]


def test_records_are_cut_once(spark, tmp_path, monkeypatch):
    for n in range(3):
        (tmp_path / f"{n}.json").write_text("[" + ", ".join(f'{{"a": "{n}, {i}\\""}}' for i in range(50)) + "]")
    got = ranges.read_json_ranges(spark, str(tmp_path), "a string")
    assert not any("0.json" in f for f in got.inputFiles())  # the plan reads the records, not the files again
    rows = sorted(got.collect(), key=lambda r: r["ord"])
    assert [r["a"] for r in rows] == [f'{n}, {i}"' for n in range(3) for i in range(50)]
