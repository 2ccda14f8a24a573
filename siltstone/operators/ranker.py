"""Term vectors, scaling and two rankers (linear, forest), all as DataFrame plans; the learners are Spark's."""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from siltstone.functions.normalize import number_or_zero
from siltstone.functions.text import code_metrics
from siltstone.functions.vectors import STATIC_KEYS
from siltstone.operators.alerts import ranker_features
from siltstone.operators.common import shared_path
from siltstone.operators.newton import logistic

# The number columns in order.
CODE = ("line_count", "char_count", "token_count", "dangerous_api_count", "pointer_operator_count", "array_access_count", "loop_count", "if_count", "return_count")
ALERT = ("alert_count", "has_codeql_alert", "high_severity_count", "unique_query_count", "cwe_count", "trace_line_count")
RECORD = tuple(f"rec_{k}" for k in STATIC_KEYS)
NUMBERS = (*CODE, *ALERT, *RECORD)
MODELS = ("logistic_regression", "random_forest")


def numeric_rows(samples: DataFrame, alerts: DataFrame, code: str = "code", sample_id: str = "sample_id", static: str = "static_features") -> DataFrame:
    """(sample_id, label, 24 doubles): code metrics, alert features, and the record's own static features (a map); what is
    missing or no number is 0."""
    own = lambda k: number_or_zero(F.try_element_at(static, F.lit(k))) if static in samples.columns else F.lit(0.0)
    m = samples.select(sample_id, "label", *[v.alias(k) for k, v in code_metrics(F.col(code)).items()], *[own(k).alias(f"rec_{k}") for k in STATIC_KEYS])
    a = ranker_features(alerts, sample_id)
    return m.join(a, sample_id, "left").select(sample_id, "label", *CODE, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ALERT], *RECORD)


#: The pattern TERM as Python writes it: its word characters are letters, numbers and the underscore, its blanks Java's and Z.
_TERM = re.compile(r"[A-Za-z_]\w+|\d+|[^\w\s]")
#: Terms that a task counts before it hands the counts on, and words that may stand in a pair of the vocabulary.
HELD, WORDS = 250_000, 200_000


def ngrams(samples: DataFrame, code: str = "code", sample_id: str = "sample_id", vocab: DataFrame | None = None) -> DataFrame:
    """(sample_id, term, tf): one- and two-grams of each sample with their counts, case kept; with vocab (bounded by its limit) of
    its terms alone, so that others are dropped before the shuffle."""
    known = None if vocab is None else {tuple(r[0].split(" ")) for r in vocab.select("term").collect()}
    words = None if known is None else {t[0] for t in known if len(t) == 1}

    def grams(text: str | None) -> Counter[str]:
        t = _TERM.findall(text or "")
        pairs = zip(t, t[1:])  # noqa: B905  the second is one shorter
        if known is None:
            return Counter([*t, *map(" ".join, pairs)])
        return Counter([*(x for x in t if x in words), *(" ".join(p) for p in pairs if p in known)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                few = b.slice(at, 256)
                each = [grams(x) for x in few.column(1).to_pylist()]
                who = few.column(0).take(pa.array(np.repeat(np.arange(len(each)), [len(g) for g in each]), pa.int64()))
                terms, n = [t for g in each for t in g], [n for g in each for n in g.values()]
                yield pa.RecordBatch.from_arrays([who, pa.array(terms, pa.string()), pa.array(n, pa.int64())], [sample_id, "term", "tf"])

    rows = samples.select(sample_id, code)
    kind = StructType([rows.schema[0], StructField("term", StringType()), StructField("tf", LongType())])
    return rows.mapInArrow(run, kind).groupBy(sample_id, "term").agg(F.sum("tf").alias("tf"))


def _told(df: Counter, total: Counter) -> pa.RecordBatch:
    """The counts so far, which begin anew."""
    names = [t if isinstance(t, str) else " ".join(t) for t in total]
    out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([df[t] for t in total], pa.int64()), pa.array(list(total.values()), pa.int64())], ["term", "df", "total"])
    df.clear()
    total.clear()
    return out


def _counts(texts: DataFrame, terms: Callable[[list[str]], list]) -> DataFrame:
    """(term, df, total) of the terms that a text's words give. Tasks count their rows and hand counts on when they hold HELD
    terms; one aggregation by term adds them, so nothing is shuffled by document and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        total: Counter = Counter()

        for b in batches:
            for text in b.column(0).to_pylist():
                own = terms(_TERM.findall(text or ""))
                total.update(own)
                df.update(set(own))
                if len(total) >= HELD:
                    yield _told(df, total)
        yield _told(df, total)

    return texts.mapInArrow(run, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def vocabulary(samples: DataFrame, n_docs: int, limit: int = 20_000, code: str = "code") -> DataFrame:
    """(term, df, total, idf): the terms with the highest counts, smaller terms first among equals; idf is smoothed, plus 1.

    Words are counted first. A pair is no more frequent than either of its words, so one that is among the first `limit` terms
    has two words as frequent as the word of that place: only such pairs are counted (all, if these words are more than WORDS).
    """
    texts = samples.select(code)
    return _chosen(_counts(texts, lambda t: t), lambda chosen: _counts(texts, lambda t: [p for p in zip(t, t[1:]) if chosen is None or (p[0] in chosen and p[1] in chosen)]), n_docs, limit)  # noqa: B905


def _chosen(counts: DataFrame, pairs: Callable[[set[str] | None], DataFrame], n_docs: int, limit: int) -> DataFrame:
    """The vocabulary, of the counts of words and of the pairs of chosen words."""
    spark = counts.sparkSession
    path = shared_path(spark, "words")
    counts.write.parquet(path)
    words = spark.read.schema("term string, df long, total long").parquet(path)
    least = words.select("total").orderBy(F.col("total").desc()).limit(limit).agg(F.when(F.count(F.lit(1)) >= limit, F.min("total")).otherwise(0)).first()[0]
    often = words.where(F.col("total") >= F.lit(least))
    known = {r[0] for r in often.select("term").limit(WORDS + 1).collect()}
    v = often.union(pairs(known if len(known) <= WORDS else None).where(F.col("total") >= F.lit(least)))
    return v.orderBy(F.col("total").desc(), "term").limit(limit).withColumn("idf", F.ln((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1)


#: Words and texts of a block of cut texts at most, unless one text has more.
CUT, TEXTS = 1 << 18, 4096


def cut_texts(samples: DataFrame, train: DataFrame | None = None, code: str = "code", sample_id: str = "sample_id") -> DataFrame:
    """Staged blocks of texts that are cut into words once: the ids, whether train has the id, the numbers of words, the
    block's different words, and each word's place among these."""
    names = ("who", "own", "length", "words", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, own, cuts, n, index = [], [], [], 0, defaultdict()
        index.default_factory = index.__len__

        def block() -> pa.RecordBatch:
            nonlocal n
            ids = pa.concat_arrays(who)
            place = np.concatenate([*cuts, np.empty(0, np.int32)])
            out = [
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([np.array(own, np.uint8).tobytes()], pa.binary()), pa.array([np.array([len(x) for x in cuts], np.int32).tobytes()], pa.binary()),
                pa.array([list(index)], pa.list_(pa.string())), pa.array([place.tobytes()], pa.binary()),
            ]
            n = 0
            for x in (who, own, cuts, index):
                x.clear()
            return pa.RecordBatch.from_arrays(out, list(names))

        for b in batches:
            for i, (mine, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                who.append(b.column(0).slice(i, 1))
                own.append(bool(mine))
                cuts.append(np.fromiter(map(index.__getitem__, _TERM.findall(text or "")), np.int32))
                n += len(cuts[-1])
                if n >= CUT or len(cuts) >= TEXTS:
                    yield block()
        if cuts:
            yield block()

    spark = samples.sparkSession
    rows = samples.select(sample_id, code)
    known = None if train is None else train.select(sample_id).distinct().withColumn("_own", F.lit(True))
    rows = rows.withColumn("_own", F.lit(False)) if known is None else rows.join(known, sample_id, "left")
    kind = StructType([StructField("who", ArrayType(rows.schema[sample_id].dataType)), StructField("own", BinaryType()), StructField("length", BinaryType()), StructField("words", ArrayType(StringType())), StructField("place", BinaryType())])
    path = shared_path(spark, "cut")
    rows.select(sample_id, "_own", code).mapInArrow(run, kind).write.parquet(path)
    return spark.read.schema(kind).parquet(path)


class _Cut:
    """A block: its words, their number k, and of each word in the texts its place among these and its text."""

    def __init__(self, b: pa.RecordBatch, i: int):
        at = lambda c, kind: np.frombuffer(b.column(c)[i].as_buffer(), kind)
        self.who, self.words = b.column("who")[i].values, b.column("words")[i].values
        self.k, self.place, length = len(self.words), at("place", np.int32).astype(np.int64), at("length", np.int32)
        self.text = np.repeat(np.arange(len(length)), length)
        self.own = at("own", np.uint8).astype(bool)[self.text]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a word and the next are of one text, and a number of the two words."""
        return self.text[:-1] == self.text[1:], self.place[:-1] * self.k + self.place[1:]


def _cut_counts(blocks: DataFrame, terms: Callable[[_Cut], tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], pa.Array]]]) -> DataFrame:
    """(term, df, total) as _counts gives them; terms: of a block the texts and numbers of what is counted, and the terms of numbers.
    A block's counts are handed on at once, so what a task holds does not grow with its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text, number, named = terms(_Cut(b, i))
                if not len(number):
                    continue
                order = np.argsort(number, kind="stable")  # a number's texts stay in order
                number, text = number[order], text[order]
                first = np.append(True, number[1:] != number[:-1])
                at = np.flatnonzero(first)
                texts = np.add.reduceat((first | np.append(True, text[1:] != text[:-1])).astype(np.int64), at)
                yield pa.RecordBatch.from_arrays([named(number[at]), pa.array(texts), pa.array(np.diff(np.append(at, len(number))))], ["term", "df", "total"])

    return blocks.mapInArrow(run, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def vocabulary_of(blocks: DataFrame, n_docs: int, limit: int = 20_000) -> DataFrame:
    """The vocabulary of the texts whose ids train has, from cut texts."""

    def words(b: _Cut) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], pa.Array]]:
        return b.text[b.own], b.place[b.own], b.words.take

    def pairs(chosen: set[str] | None) -> DataFrame:
        def of(b: _Cut) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], pa.Array]]:
            one, number = b.pairs()
            among = np.ones(b.k, bool) if chosen is None else pc.is_in(b.words, value_set=pa.array(chosen, pa.string())).to_numpy(zero_copy_only=False)
            keep = one & b.own[:-1] & among[b.place[:-1]] & among[b.place[1:]]
            return b.text[:-1][keep], number[keep], lambda found: pc.binary_join_element_wise(b.words.take(found // b.k), b.words.take(found % b.k), " ")

        return _cut_counts(blocks, of)

    return _chosen(_cut_counts(blocks, words), pairs, n_docs, limit)


def term_vectors(blocks: DataFrame, vocab: DataFrame, sample_id: str = "sample_id") -> DataFrame:
    """(sample_id, i, weight): the weights of tfidf as arrays, i the places of the terms in their order; from cut texts.

    Only terms of the vocabulary are counted, and an id's counts meet once; texts of one id count together.
    """
    ordered = sorted(vocab.select("term", "idf").collect())  # no longer than the vocabulary's limit
    size, idf = len(ordered), np.array([r[1] for r in ordered], float)
    single = [(r[0], i) for i, r in enumerate(ordered) if " " not in r[0]]
    double = [(*r[0].split(" "), i) for i, r in enumerate(ordered) if " " in r[0]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                b = _Cut(batch, row)
                where = lambda terms: pc.fill_null(pc.index_in(pa.array(terms, pa.string()), value_set=b.words), -1).to_numpy()  # noqa: B023, E731
                of_word = np.full(b.k + 1, -1)
                of_word[where([t for t, _ in single])] = [i for _, i in single]
                of_word[-1] = -1
                ones = of_word[b.place]
                left, right = where([t for t, _, _ in double]).astype(np.int64), where([t for _, t, _ in double])
                numbers = sorted((int(x * b.k + y), i) for x, y, (_, _, i) in zip(left, right, double, strict=True) if x >= 0 and y >= 0)
                text, place = [b.text[ones >= 0]], [ones[ones >= 0]]
                if numbers:
                    known, to = np.array(numbers, np.int64).T
                    one, number = b.pairs()
                    at = np.minimum(np.searchsorted(known, number), len(known) - 1)
                    hit = one & (known[at] == number)
                    text.append(b.text[:-1][hit])
                    place.append(to[at[hit]])
                found, n = np.unique(np.concatenate(text) * max(size, 1) + np.concatenate(place), return_counts=True)
                ends = pa.array(np.append(0, np.cumsum(np.bincount(found // max(size, 1), minlength=len(b.who)))), pa.int32())
                yield pa.RecordBatch.from_arrays([b.who, pa.ListArray.from_arrays(ends, pa.array(found % max(size, 1), pa.int32())), pa.ListArray.from_arrays(ends, pa.array(n, pa.int64()))], [sample_id, "i", "tf"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            few = b.column(1).flatten()  # the texts of all ids
            of = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy(zero_copy_only=False))
            i, tf = few.field("i"), few.field("tf")
            of = np.repeat(of, i.value_lengths().to_numpy(zero_copy_only=False))
            found, at = np.unique(of * max(size, 1) + i.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            place, row = found % max(size, 1), found // max(size, 1)
            w = (1.0 + np.log(np.bincount(at, tf.flatten().to_numpy(zero_copy_only=False), minlength=len(found)))) * idf[place]
            w = w / np.sqrt(np.bincount(row, w * w, minlength=b.num_rows))[row]
            ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=b.num_rows))), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(place, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(w))], [sample_id, "i", "weight"])

    who = StructField(sample_id, blocks.schema["who"].dataType.elementType)
    kind = lambda *more: StructType([who, *(StructField(n, t) for n, t in more)])
    counted = blocks.mapInArrow(count, kind(("i", ArrayType(IntegerType())), ("tf", ArrayType(LongType()))))
    return counted.groupBy(sample_id).agg(F.collect_list(F.struct("i", "tf")).alias("t")).mapInArrow(weigh, kind(("i", ArrayType(IntegerType())), ("weight", ArrayType(DoubleType()))))


def tfidf(terms: DataFrame, vocab: DataFrame, sample_id: str = "sample_id") -> DataFrame:
    """(sample_id, term, weight): (1 + ln tf) idf, each sample scaled to length 1. The vocabulary is bounded by its limit."""
    w = terms.join(F.broadcast(vocab.select("term", "idf")), "term").withColumn("w", (F.lit(1.0) + F.ln("tf")) * F.col("idf"))
    norm = w.groupBy(sample_id).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, sample_id).select(sample_id, "term", (F.col("w") / F.col("norm")).alias("weight"))


def scaler(rows: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """Population standard deviations, 1 for constant columns."""
    r = rows.agg(*[F.stddev_pop(c).alias(c) for c in names]).first()
    return {c: float(r[c]) if r[c] else 1.0 for c in names}


def scale(rows: DataFrame, deviations: dict[str, float]) -> DataFrame:
    return rows.withColumns({c: F.col(c) / F.lit(d) for c, d in deviations.items()})


def assemble(rows: DataFrame, names: Sequence[str], vectors: DataFrame | None = None, size: int = 0, sample_id: str = "sample_id") -> DataFrame:
    """rows with features: term weights (sparse, of size terms), then the scaled numbers.

    Catalyst has no constructor of vectors; their storage form is written as a table in the shared folder, which the learner
    reads again and again, and read back as vectors.
    """
    numbers = F.array(*[F.col(c).cast("double") for c in names])
    own = [F.array().cast("array<int>").alias("_i"), F.array().cast("array<double>").alias("_v")]
    out = rows.select("*", *own)
    if vectors is not None:
        out = rows.join(vectors.select(sample_id, F.col("i").alias("_i"), F.col("weight").alias("_v")), sample_id, "left")
        out = out.withColumns({c: F.coalesce(c, F.array().cast(k)) for c, k in (("_i", "array<int>"), ("_v", "array<double>"))})
    indices = F.concat("_i", F.transform(numbers, lambda _, j: F.lit(size) + j))
    values = F.concat("_v", numbers)
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size + len(names)).alias("size"), indices.alias("indices"), values.alias("values"))
    spark = rows.sparkSession
    path = shared_path(spark, "features")
    out.withColumn("features", vector).drop("_i", "_v").write.parquet(path)
    return spark.read.schema(StructType([*rows.schema.fields, StructField("features", VectorUDT())])).parquet(path)


def fit(train: DataFrame, label: str = "label", c: float = 1.0, model: str = "logistic_regression", seed: int = 42, trees: int = 300) -> Model:
    """Balanced L2 logistic regression with a penalised intercept, or a balanced random forest; both classes are needed.

    The forest's trees end at depth 30, the deepest that Spark grows.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}, expected one of {MODELS}")
    n = {r[0]: r[1] for r in train.groupBy(label).count().collect()}  # two rows
    if len(n) < 2:
        raise ValueError("training rows of both classes are needed")
    total = sum(n.values())
    w = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, total / (len(n) * v))])
    rows = train.withColumn("_w", F.element_at(w, F.col(label))).withColumn("_y", F.col(label).cast("double"))
    if model == "random_forest":
        fitted = RandomForestClassifier(featuresCol="features", labelCol="_y", weightCol="_w", numTrees=trees, maxDepth=30, featureSubsetStrategy="sqrt", seed=seed).fit(rows)
    else:
        return _linear(rows, c)
    if fitted.hasSummary:  # it holds the session, which must not travel with the model
        fitted._java_obj.setSummary(train.sparkSession._jvm.scala.Option.empty())
    return fitted


def _linear(rows: DataFrame, c: float) -> LogisticRegressionModel:
    """The regression's weights as a model of Spark's, which scores, is saved and is read like any other."""
    spark = rows.sparkSession
    size = len(rows.select("features").first()[0])
    path = shared_path(spark, "entries")
    rows.select("features", F.col("_y").alias("y"), F.col("_w").alias("w")).write.parquet(path)
    # what a vector is stored as: its entries, places left out if it is dense
    stored = spark.read.schema("features struct<type:tinyint,size:int,indices:array<int>,values:array<double>>, y double, w double").parquet(path)
    places = F.coalesce("features.indices", F.transform("features.values", lambda _, i: i))
    w = logistic(stored.select(places.alias("index"), F.col("features.values").alias("value"), "y", "w"), size, c)
    weights = _py2java(spark.sparkContext, DenseVector(w[:-1]))
    return LogisticRegressionModel(spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(f"logistic-{uuid.uuid4().hex[:12]}", weights, float(w[-1])))


def predict(model: Model, rows: DataFrame) -> DataFrame:
    """rows with rank_score, the probability of label 1."""
    return model.transform(rows).withColumn("rank_score", F.get(vector_to_array("probability"), F.lit(1))).drop("rawPrediction", "probability", "prediction")


def importances(model: Model, names: Sequence[str]) -> list[tuple[str, float]]:
    """Weights, or a forest's importances, by falling size; names first give the terms, then the numbers."""
    weights = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    return sorted(zip(names, weights.toArray().tolist(), strict=False), key=lambda x: (-abs(x[1]), x[0]))

