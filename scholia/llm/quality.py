"""A quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, texts, written

#: Features, kernel width in standard deviations of a statistic (times the root of their number), ridge weight.
FEATURES, WIDTH, RIDGE, SEED = 384, 1.0, 1e-3, 2
#: At most so many labelled rows are learnt from, chosen by a hash of doc_id; every row is scored.
LABELLED = 200_000
#: Classes of bytes whose shares are statistics: letters, digits, then marks.
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t", b".", b",", b"|", b"#$%&*", b"@/\\_", b"!?;:'\"", b"()[]{}<>=+-^~`", bytes(range(128, 256))]
_kind = np.full(256, len(CLASSES), np.uint8)
for _i, _c in enumerate(CLASSES):
    _kind[list(_c)] = _i
N_STATS = len(CLASSES) + 1 + 15


def statistics(text: str) -> list[float]:
    """Numbers of one whole text; an empty text gives zeros."""
    data = text.encode()
    if not data:
        return [0.0] * N_STATS
    n = len(data)
    shares = np.bincount(_kind[np.frombuffer(data, np.uint8)], minlength=len(CLASSES) + 1) / n
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_words = len(words) or 1
    counts, line_counts = Counter(words), Counter(lines)
    twice = sum(a == b for a, b in zip(words, words[1:]))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    folded = len({w.strip(b".,").lower() for w in counts}) or 1
    top = counts.most_common(1)[0][1] if counts else 0
    bare = sum(c for w, c in counts.items() if not any(65 <= b <= 90 or 97 <= b <= 122 or b > 127 for b in w))
    marked = sum(c for w, c in counts.items() if len(w) > 1 and w[-1:] in b"#$%&*|@")
    caps = sum(c for w, c in counts.items() if len(w) > 2 and w.isupper())
    return [
        *shares.tolist(),
        np.log1p(n) / 10,
        np.log1p(n_words) / 10,
        sizes.mean() / 10,
        sizes.std() / 10,
        len(counts) / n_words,
        folded / n_words,
        np.log1p(n_words) * (1 - folded / n_words) / 10,
        top / n_words,
        twice / n_words,
        bare / n_words,
        marked / n_words,
        caps / n_words,
        len(line_counts) / max(1, len(lines)),
        max(line_counts.values(), default=0) / max(1, len(lines)),
        n / max(1, len(lines)) / 1000 if len(lines) < 2 else np.log1p(n / len(lines)) / 10,
    ]


def statistics_table(docs: DataFrame) -> DataFrame:
    """doc_id and stats (array of N_STATS doubles) of every whole text (null: empty), in one map."""
    prepare(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(x) for x in batch.column("text").to_pylist()], float).reshape(-1, N_STATS)
            at = np.arange(0, rows.size + 1, N_STATS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(rows.ravel()))], ["doc_id", "stats"])

    return texts(docs).mapInArrow(run, "doc_id long, stats array<double>")


@dataclass
class Model:
    """Standardisation, random projection, ridge weights and the calibration's steps."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.omega + self.phase) * np.sqrt(2.0 / len(self.phase))
        return np.hstack([z, x, np.ones((len(x), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(stats), self.values[0])
        return np.interp(self.features(stats) @ self.weights, self.knots, self.values)


def pool_adjacent(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of y on x: the knots' places and rising values.

    A row of the mean is put at either end before pooling, so that values of few rows aren't quite 0 or 1. Rows of
    equal x are pooled at once.
    """
    places, at = np.unique(x, return_inverse=True)
    rows = np.column_stack([np.bincount(at), np.bincount(at) * places, np.bincount(at, y)]).astype(float)
    ends = np.array([[1.0, place, y.mean()] for place in (places[0], places[-1])])
    blocks: list[np.ndarray] = []  # weight, sum of x, sum of y
    for row in np.vstack([ends[:1], rows, ends[1:]]):
        blocks.append(row)
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][0] >= blocks[-1][2] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = blocks[-1] + last
    # A block's own place may lie beside its neighbours' where the ends' rows count for most of it.
    return np.maximum.accumulate([b[1] / b[0] for b in blocks]), np.array([b[2] / b[0] for b in blocks])


def _summed(rows: DataFrame, make, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over partitions of make(stats, labels), one small array each; their number is bounded by the caller."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                stats = batch.column("stats")
                total += make(stats.values.to_numpy().reshape(-1, N_STATS), batch.column("y").to_numpy(zero_copy_only=False).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    total = np.zeros(shape)
    for row in rows.mapInArrow(run, "sum binary").toLocalIterator():
        total += np.frombuffer(row[0]).reshape(shape)
    return total


def learnable(labels: DataFrame, learn: F.Column, seed: int = SEED) -> DataFrame:
    """doc_id and y of about LABELLED rows of labels (doc_id, y) at most, of those where learn holds.

    Rows without an id or a label are left out; one doc_id with several labels counts once, with the mean rounded.
    """
    labels = labels.where(learn & F.col("y").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.round(F.avg("y")).alias("y"))
    share = min(1.0, LABELLED / max(1, labels.count()))
    unit = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    return labels.where(unit < share)


def fit(stats: DataFrame, labels: DataFrame, seed: int = SEED) -> Model:
    """Learn from the rows of stats that labels (learnable) has.

    A fifth of them, by a hash, calibrates; the others give the normal equations. Labels without a document are left
    out. Without any label the score is 0.5, with labels of one kind their share.
    """
    rows = stats.join(F.broadcast(labels), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "stats", "y")
    rows = written(rows.coalesce(32), "quality-labelled")
    for_fit = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(5)) > 0
    moments = _summed(rows, lambda x, y: np.vstack([x.sum(0), (x * x).sum(0), np.full(N_STATS, len(x)), np.full(N_STATS, y.sum())]), (4, N_STATS))
    count, positive = moments[2, 0], moments[3, 0]
    mean = moments[0] / max(1, count)
    scale = np.maximum(np.sqrt(np.maximum(moments[1] / max(1, count) - mean**2, 0)), 1e-6)
    rng = np.random.default_rng(seed)
    omega = rng.standard_normal((N_STATS, FEATURES)) / (WIDTH * np.sqrt(N_STATS))
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    empty = np.zeros(0)
    model = Model(mean, scale, omega, phase, empty, np.zeros(1), np.array([positive / count if count else 0.5]))
    if not 0 < positive < count:
        return model
    size = FEATURES + N_STATS + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])

    equations = _summed(rows.where(for_fit), normal, (size, size + 1))
    weights = np.linalg.solve(equations[:, :size] + RIDGE * max(1.0, count) / size * np.eye(size), equations[:, size])
    held = rows.where(~for_fit).select("stats", "y").toPandas()  # at most a fifth of LABELLED
    fitted = Model(mean, scale, omega, phase, weights, np.zeros(1), np.array([positive / count]))
    if len(held):
        fitted.knots, fitted.values = pool_adjacent(fitted.features(np.array(held["stats"].tolist())) @ weights, held["y"].to_numpy(float))
    return fitted


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row of stats."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(batch.column("stats").values.to_numpy().reshape(-1, N_STATS)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(score, 0, 1))], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def fold() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def _labels(labels: DataFrame) -> DataFrame:
    return learnable(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y")), fold() != 0)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (null text: empty).

    A null doc_id is not held out and never learnt from; rows of one doc_id are scored each by its own text. No rows
    give no rows; labels without rows give 0.5 for all.
    """
    stats = written(statistics_table(docs), "quality-stats")
    model = fit(stats, _labels(labels))
    held = F.coalesce(fold() == 0, F.lit(False))
    return scored(stats, model).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs with a score of threshold or more, with the same columns: one map once the model is there.

    Null and empty texts are scored as empty, repeated rows and rows with null ids each by their text; no rows give no
    rows.
    """
    prepare(docs.sparkSession)
    known = _labels(labels)
    model = fit(statistics_table(docs.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")), known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(x or "") for x in batch.column("text").to_pylist()], float).reshape(-1, N_STATS)
            yield batch.filter(pa.array(model.score(rows) >= threshold)) if batch.num_rows else batch

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from labels.quality outside the held-out fold."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
