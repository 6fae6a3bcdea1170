"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features of a document are its words and their beginnings of four to six bytes (A-Z lower-cased), with the value
log(1 + occurrences).  The model has one weight per feature, shared by all grades, and ordered thresholds:
``P(grade > k) = sigmoid(weights . features - threshold_k)``.  The expected severity is the sum of these over k.

Fitting reads a sample of at most about ``SAMPLE`` graded rows, drawn by a hash of the id; features are counted in Spark.
Every feature that tells toxic rows by ``LEAST_GAP`` is taken, whatever its rank, so that the words of one language do not
push out those of another; these features and the sparse rows of the sample reach the driver.  Scoring takes whole texts
of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberscope.llm.common import fresh, ByteHashes, mix, saved, text_slices, utf8, words

SAMPLE = 20_000
LEAST_ROWS = 5
#: Standard deviations by which a feature has to be more frequent in toxic rows.  Among n texts a feature that tells
#: them apart without fail has sqrt(n), so of few texts the share ``LEAST_SHARE`` of that is asked for.
LEAST_GAP, LEAST_SHARE = 4.0, 0.75
BEGINNINGS = (4, 5, 6)
#: Rejected: probability of any toxic grade above this.
REJECT = 0.5
_ROUNDS, _RATE, _PRIOR = 400, 0.1, 6.0


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and feature hashes of all occurrences; words are runs of letters, digits and non-ASCII bytes."""
    raw, offsets = utf8(texts)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    letter = (raw >= 128) | ((raw >= 48) & (raw <= 57)) | ((raw >= 65) & (raw <= 90)) | ((raw >= 97) & (raw <= 122))
    starts, ends, edge = words(~letter, offsets)
    owner = np.repeat(np.arange(len(texts)), np.diff(edge))
    hashes = ByteHashes(raw)
    found, owners = [hashes.of(starts, ends)], [owner]
    for size in BEGINNINGS:
        longer = ends - starts > size
        found.append(mix(hashes.of(starts[longer], starts[longer] + size) + np.uint64(size)))
        owners.append(owner[longer])
    return np.concatenate(owners), np.concatenate(found)


@dataclass
class Model:
    """Sorted feature hashes, their weights, and the thresholds in ascending order."""

    names: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.array([np.inf]))

    def __post_init__(self):
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.names >> np.uint64(48)).astype(np.int64)] = True

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, feature number and value of what the texts have of the features."""
        owner, found = features(texts)
        some = self.gate[(found >> np.uint64(48)).astype(np.int64)]
        owner, found = owner[some], found[some]
        place = np.searchsorted(self.names, found)
        some = place < len(self.names)
        some[some] = self.names[place[some]] == found[some]
        cell, times = np.unique(owner[some] * max(1, len(self.names)) + place[some], return_counts=True)
        return cell // max(1, len(self.names)), cell % max(1, len(self.names)), np.log1p(times)

    def above(self, texts: pa.Array) -> np.ndarray:
        """``P(grade > k)`` for each text and each threshold k."""
        owner, place, value = self.rows(texts)
        score = np.bincount(owner, self.weights[place] * value, len(texts)) if len(owner) else np.zeros(len(texts))
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Sparse:
    """A matrix by its cells that are not zero; products with vectors only."""

    shape: tuple[int, int]
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray

    @property
    def T(self) -> Sparse:  # noqa: N802
        return Sparse(self.shape[::-1], self.column, self.row, self.value)

    def __matmul__(self, vector: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * vector[self.column], self.shape[0])


def fit_ordinal(x: np.ndarray | Sparse, grade: np.ndarray, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch gradient descent (Adam) on the mean log-likelihood of ``grade`` in 0..grades.

    Clean and toxic rows count half each, however rare toxic ones are.  The weights have a normal prior, which counts
    the less the more rows there are.
    """
    n, d = x.shape
    toxic = (grade > 0).mean()
    mass = np.where(grade > 0, 0.5 / toxic, 0.5 / (1 - toxic)) / n
    share = np.array([mass[grade > k].sum() for k in range(grades)])
    start = -np.log(share / (1 - share))
    # thresholds as the first one and the logarithms of the steps, so that they stay in order
    raw = np.concatenate([np.zeros(d), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    first, second = np.zeros_like(raw), np.zeros_like(raw)
    for i in range(1, _ROUNDS + 1):
        steps = np.exp(raw[d + 1 :])
        theta = raw[d] + np.concatenate([[0], np.cumsum(steps)])
        above = _sigmoid((x @ raw[:d])[:, None] - theta[None, :])
        edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        slope = edge * (1 - edge)
        p = np.maximum(edge[np.arange(n), grade] - edge[np.arange(n), grade + 1], 1e-12)
        by_score = (slope[np.arange(n), grade] - slope[np.arange(n), grade + 1]) / p
        by_theta = np.zeros((n, grades + 2))
        by_theta[np.arange(n), grade] -= slope[np.arange(n), grade] / p
        by_theta[np.arange(n), grade + 1] += slope[np.arange(n), grade + 1] / p
        by_theta = mass @ by_theta[:, 1:-1]
        later = np.cumsum(by_theta[::-1])[::-1]
        gradient = -np.concatenate([x.T @ (mass * by_score) - _PRIOR / n * raw[:d], later[:1], later[1:] * steps])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        raw -= _RATE * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.999**i)) + 1e-8)
    return raw[:d], raw[d] + np.concatenate([[0], np.cumsum(np.exp(raw[d + 1 :]))])


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each feature of each text once, with the grade of the text."""
    for batch in text_slices(batches, "text"):
        owner, found = features(batch.column("text"))
        order = np.lexsort((found, owner))
        owner, found = owner[order], found[order]
        new = np.append(True, (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])) if len(owner) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found[new].view(np.int64)), batch.column("toxic").take(pa.array(owner[new]))], names=["feature", "toxic"]
        )


def fit(documents: DataFrame, graded: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on ``graded(doc_id, grade)``, grades 0, 1, ... with 0 for clean rows.

    Null grades are left out; of several grades of an id the highest counts; equal texts count once.  If there is only
    one grade above 0, its rows are spread over three grades by how many of the most telling features they have.  Under 29
    different texts the gap a feature needs falls with their number.  Without rows of both kinds, or if no feature reaches
    the gap, the model rejects nothing.
    """
    ids = graded.where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    share = min(1.0, sample / max(1, ids.count()))
    drawn = ids.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000))
    # bounded: about ``sample`` rows of an id and a grade
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(drawn), "doc_id")
    rows = saved(rows.groupBy(F.xxhash64("text").alias("fp")).agg(F.max("grade").alias("grade"), F.any_value("text").alias("text")))
    size = rows.agg(F.count("*").alias("n"), F.sum((F.col("grade") > 0).cast("long")).alias("toxic")).first()
    if not size.n or not size.toxic or size.toxic == size.n:
        return Model()
    seen = rows.select("text", (F.col("grade") > 0).cast("int").alias("toxic")).mapInArrow(_present, "feature long, toxic int")
    counts = seen.groupBy("feature").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    a, b, n = F.col("a"), F.col("n") - F.col("a"), F.col("n") / size.n
    gap = a / size.toxic - b / (size.n - size.toxic)
    z = gap / F.sqrt(n * (1 - n) * (1 / size.toxic + 1 / (size.n - size.toxic)) + F.lit(1e-12))
    least = max(1, min(LEAST_ROWS, size.toxic // 4), size.toxic // 100)
    needed = min(LEAST_GAP, LEAST_SHARE * size.n**0.5)
    best = counts.where((F.col("a") >= least) & (z >= needed)).select("feature", z.alias("z")).orderBy(F.desc("z"), "feature").collect()
    if not best:
        return Model()
    names = np.array([r.feature for r in best], np.int64).view(np.uint64)
    telling = np.array([r.z for r in best])[np.argsort(names)] >= best[0].z / 3
    names = np.sort(names)
    model = Model(names, np.zeros(len(names)))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            owner, place, value = model.rows(batch.column("text"))
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("grade"), pa.ListArray.from_arrays(cuts, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(value))],
                names=["grade", "place", "value"],
            )

    taught = rows.orderBy("fp").select("grade", "text").mapInArrow(sparse, "grade int, place array<int>, value array<double>").collect()
    owner = np.repeat(np.arange(len(taught)), [len(r.place) for r in taught])
    place, value = (np.fromiter((v for r in taught for v in r[k]), kind, len(owner)) for k, kind in (("place", np.int64), ("value", float)))
    x = Sparse((len(taught), len(names)), owner, place, value)
    grade = np.array([r.grade for r in taught])
    if len(np.unique(grade)) == 2:
        marks = np.bincount(owner[telling[place]], minlength=len(taught))
        cuts = np.quantile(marks[grade > 0], [1 / 3, 2 / 3])
        grade = np.where(grade > 0, 1 + (marks[:, None] > cuts[None, :]).sum(axis=1), 0)
    grade = np.unique(grade, return_inverse=True)[1]
    weights, thresholds = fit_ordinal(x, grade, int(grade.max()))
    return Model(names, weights, thresholds)


def grades_of_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.col("toxic").cast("int").alias("grade"))


def scored(documents: DataFrame, model: Model, columns: list[str], reject: float = REJECT) -> DataFrame:
    """The columns asked for, and ``severity`` (expected grade), ``p_toxic`` and ``rejected``; one row per input row.

    A null or empty text has no features; what it is then told by the thresholds alone.
    """
    return _scored(documents, model, columns, ("severity", "p_toxic", "rejected"), reject)


def _scored(documents: DataFrame, model: Model, columns: list[str], added: tuple[str, str, str], reject: float = REJECT) -> DataFrame:
    body = fresh("text")
    source = documents.select(*columns, F.col("text").cast("string").alias(body))
    schema = T.StructType([*documents.select(*columns).schema.fields])
    for name, kind in zip(added, ("double", "double", "boolean")):
        schema = schema.add(name, kind)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, body):
            above = model.above(batch.column(body))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(columns))), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(above[:, 0] > reject)],
                names=[*columns, *added],
            )

    return source.mapInArrow(score, schema)


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not reject, all columns as they are."""
    columns = documents.columns
    model = fit(documents, grades_of_labels(labels))
    added = (fresh("severity"), fresh("p_toxic"), fresh("rejected"))
    return _scored(documents, model, columns, added).where(~F.col(added[2])).select(columns)
