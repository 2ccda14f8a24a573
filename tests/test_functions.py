import pytest
from pyspark.sql import functions as F

from siltstone.functions import lines as L
from siltstone.functions import normalize as N
from siltstone.functions import scores as S
from siltstone.functions import text as T
from siltstone.functions.vectors import node_vector


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_labels(spark):
    rows = [("1",), (" TRUE ",), ("no",), ("",), ("0.5",), ("2",), ("-3",), ("x",), (None,), ("vul",)]
    assert [v for (v,) in values(spark, rows, "s string", N.coerce_label(F.col("s")))] == [1, 1, 0, 0, 0, 1, 1, 0, 0, 1]


def test_cwe_and_split(spark):
    got = values(spark, [("CWE-1, CWE-2;",), ("",), (None,), ("CWE-9",)], "s string", N.coerce_cwe(F.col("s")))
    assert [v for (v,) in got] == [["CWE-1", "CWE-2"], [], [], ["CWE-9"]]
    got = values(spark, [("Training",), ("dev",), ("odd",), (None,)], "s string", N.split_name(F.col("s")))
    assert [v for (v,) in got] == ["train", "valid", "unknown", "unknown"]


def test_paths(spark):
    rows = [("a/b.c", "b.c"), ("b.c", "/x/b.c"), ("xb.c", "b.c"), ("a\\b.c", "a/b.c"), (None, "b.c"), ("b.c", "b.c")]
    assert [v for (v,) in values(spark, rows, "a string, b string", N.paths_match(F.col("a"), F.col("b")))] == [True, True, False, True, False, True]


def test_tokens_follow_unicode(spark):
    rows = [("x²",), ("a½b",), ("a‿b",), ("a\x1cb",), ("p->q[0] += 10;",)]
    assert [v for (v,) in values(spark, rows, "s string", T.tokens(F.col("s")))] == [["x²"], ["a½b"], ["a", "‿", "b"], ["a", "b"], ["p", "-", ">", "q", "[", "0", "]", "+", "=", "10", ";"]]


def test_lines(spark):
    rows = [("a\r\nb\n",), ("",), ("a\n\n",), ("x",), ("a b",), (None,)]
    assert [v for (v,) in values(spark, rows, "s string", T.code_lines(F.col("s")))] == [["a", "b"], [], ["a", ""], ["x"], ["a", "b"], []]


@pytest.mark.parametrize("budget", range(15))
def test_truncate(spark, budget):
    lines, kept, used = ["abc", "", "de", "fghi"], [], 0
    for line in lines:
        used += len(line) + bool(kept)
        if used > budget:
            break
        kept.append(line)
    assert values(spark, [(lines,)], "l array<string>", T.truncate_lines(F.col("l"), None, budget)) == [(kept,)]


def test_metrics(spark):
    code = "int f(char *p) {\n  for (;;) { if (p->x) memcpy(a[0], p, 3); }\n  return strcpy(a, &b);\n}"
    m = values(spark, [(code,)], "c string", *T.code_metrics(F.col("c")).values())[0]
    assert m == (4.0, float(len(code)), m[2], 2.0, 3.0, 1.0, 1.0, 1.0, 1.0)
    assert values(spark, [(None,)], "c string", *T.code_metrics(F.col("c")).values())[0] == (0.0,) * 9


def test_normalised_hash_ignores_comments(spark):
    rows = [("int a; // x\n/* y\n */ b",), ("int  a;  b",), ("int A; b",)]
    h = [v for (v,) in values(spark, rows, "s string", T.normalized_hash(F.col("s")))]
    assert h[0] == h[1] != h[2]


def test_severities_differ_by_use(spark):
    rows = [(" ERROR ",), ("moderate",), ("info",), (None,), ("odd",)]
    assert values(spark, rows, "s string", N.severity_rank(F.col("s")), N.severity_weight(F.col("s"))) == [(3, 1.0), (0, 0.7), (1, 0.3), (0, 0.3), (0, 0.3)]


def test_verdict_scores(spark):
    rows = [("uncertain", 0.0), ("uncertain", 0.4), ("uncertain", 0.6), ("benign", 0.5), ("benign", 0.9), ("vulnerable", 0.93), (None, None)]
    got = [round(v, 9) for (v,) in values(spark, rows, "v string, c double", S.verdict_score(F.col("v"), F.col("c")))]
    assert got == [0.3, 0.2, 0.3, 0.3, 0.1, 0.93, 0.0]


def test_lines_and_masks(spark):
    assert values(spark, [([3, 5], 2, 6)], "l array<int>, s int, e int", L.mask(F.col("l"), F.col("s"), F.col("e")), L.to_relative(F.lit(4), F.col("s"), F.col("e")), L.covered(F.lit(5), F.lit(4))) == [([0, 1, 0, 1, 0], 3, [])]
    assert values(spark, [([1, 2], [2, 3]), ([], []), (None, [1])], "p array<int>, t array<int>", L.iou(F.col("p"), F.col("t")), L.hit(F.col("p"), F.col("t"), 1)) == [(1 / 3, 0), (0.0, 0), (0.0, 0)]


def test_top_lines(spark):
    s = S.line_scores(F.col("a"), F.col("t"), F.col("v"), F.col("g"))
    assert values(spark, [([4, 5], [2], [4, 9], [])], "a array<int>, t array<int>, v array<int>, g array<int>", S.top_lines(s, 3)) == [([4, 5, 9],)]
    assert values(spark, [([4], [], [], [])], "a array<int>, t array<int>, v array<int>, g array<int>", S.top_lines(s, 0)) == [([],)]


def test_node_vector(spark):
    rows = [("CALL", "memcpy(a, b)", 150, {"is_sink_like": 1.0}), (None, "", None, {})]
    a, b = (v for (v,) in values(spark, rows, "t string, c string, l int, f map<string,double>", node_vector(F.col("t"), F.col("c"), F.col("l"), F.col("f"))))
    assert len(a) == len(b) == 37 and a[16] == 1.0 and a[20] == 1.0 and abs(sum(a[21:]) - 1) < 1e-9 and sum(b[16:]) == 0


def test_fence(spark):
    rows = [('```json\n{"a": 1}\n```',), ("```\nx\n```",), (" plain ",)]
    assert [v for (v,) in values(spark, rows, "s string", T.strip_fence(F.col("s")))] == ['{"a": 1}', "x", "plain"]
