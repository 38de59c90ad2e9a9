"""Quality scores of documents: random Fourier features, ridge regression, isotonic calibration.

Cosines of random projections approximate a Gaussian kernel over document statistics. Tasks sum
their part of the normal equations, the driver solves one system of fixed size, and raw scores
become probabilities through an isotonic fit over a fixed grid of scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHARS_AT_ONCE, arrow_of, bounded, discard, id_fold, rows_out, scratch, type_of, whole_texts

#: Random features, kernel width in standard deviations, ridge weight per row, seed.
FEATURES, WIDTH, RIDGE, SEED = 256, 3.0, 1e-4, 20_240
#: Steps of the grid of raw scores that the calibration is fitted on.
GRID = 1000
#: Labelled rows that one task sums into equations, about; folds that the calibration is fitted across.
ROWS_A_SUM, FOLDS = 20_000, 3

STATISTICS = (
    "log_words", "word_bytes", "upper", "digits", "marks", "commas", "exclaims", "bars", "symbols", "lines",
    "high_bytes", "entropy", "distinct_words", "repeat_next", "repeat_lines", "capital_words",
)


def _among(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8)).astype(float)


_CLASSES = np.stack([_among(bytes(range(65, 91))), _among(b"0123456789"), _among(b".?;:"), _among(b","), _among(b"!"), _among(b"|"), _among(b"#*$%&<>~^_=+@\\/"), _among(b"\n"), (np.arange(256) > 127).astype(float)], 1)


def statistics(text: str | None) -> np.ndarray:
    """Statistics of one text, all finite; a text without words gives zeros."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return np.zeros(len(STATISTICS))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts / len(data)
    held = share[share > 0]
    lines = [x for x in data.split(b"\n") if x.strip()]
    n = len(words)
    classes = counts @ _CLASSES
    per_byte, per_word = classes / len(data), classes / n
    return np.array(
        [
            np.log1p(n), (len(data) - n) / n, per_byte[0], per_byte[1], per_word[2], per_word[3], per_word[4], per_word[5], per_word[6], per_word[7], per_byte[8],
            -(held * np.log2(held)).sum(), len(set(words)) / n**0.8, sum(map(bytes.__eq__, words, words[1:])) / n, 1 - len(set(lines)) / max(1, len(lines)), sum(1 for w in words if w[:1].isupper()) / n,
        ]
    )


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    fold_weights: list[np.ndarray]
    steps: np.ndarray
    levels: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return lifted(x, self.mean, self.scale, self.directions, self.phases)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lifted(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1."""
        return np.interp(self.raw(x), self.steps, self.levels)


def lifted(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -8, 8)
    return np.hstack([np.sqrt(2 / len(phases)) * np.cos(z @ directions + phases), np.ones((len(x), 1))])


def document_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<double>) of every row."""
    source = whole_texts(docs, id_col, text_col)
    ddl = f"doc_id {type_of(source, 'doc_id')}, x array<double>"
    schema = arrow_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, limit=CHARS_AT_ONCE // 4):
            yield rows_out(schema, [batch.column("doc_id"), [statistics(t) for t in batch.column("text").to_pylist()]])

    return source.mapInArrow(run, ddl)


def train(stats: DataFrame, labels: DataFrame, *, usable: Column | None = None, label_col: str = "quality", id_col: str = "doc_id", seed: int = SEED, rows_a_sum: int = ROWS_A_SUM) -> QualityModel:
    """Fit on the rows of ``stats`` (doc_id, x) that ``labels`` marks and ``usable`` allows.

    A document with several labels gets their majority and none at a tie. With no labelled row
    every text scores 0.5. What reaches the driver has a fixed size: a square system for each of FOLDS
    folds and one row a grid step. A fold's rows are calibrated on scores of a fit without them.
    """
    width = len(STATISTICS)
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).filter("y is not null and doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.avg("y").alias("y")).filter("y <> 0.5").select("doc_id", F.when(F.col("y") > 0.5, 1.0).otherwise(0.0).alias("y"))
    rows = stats.join(marks, "doc_id")
    rows = rows.filter(usable) if usable is not None else rows
    rows = scratch(rows.withColumn("fold", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(FOLDS)).cast("int")), "labelled")
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *(f(F.get("x", F.lit(i))).alias(f"{name}{i}") for name, f in (("mean", F.avg), ("scale", F.stddev_pop)) for i in range(width))).first()
    rng = np.random.default_rng(seed)
    directions, phases = rng.normal(size=(width, FEATURES)) / WIDTH / np.sqrt(width) * 2, rng.uniform(0, 2 * np.pi, FEATURES)
    if not sums["n"]:
        return QualityModel(np.zeros(width), np.ones(width), directions, phases, np.zeros(FEATURES + 1), [np.zeros(FEATURES + 1)] * FOLDS, np.zeros(1), np.full(1, 0.5))
    mean, scale = (np.array([sums[f"{name}{i}"] for i in range(width)]) for name in ("mean", "scale"))
    scale = np.where(scale > 1e-9, scale, 1.0)

    def equations(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for start in range(0, len(frame), 4096):
                for fold, part in frame.iloc[start : start + 4096].groupby("fold"):
                    z = lifted(np.stack(part["x"].to_numpy()), mean, scale, directions, phases)
                    total[fold] = total.get(fold, 0.0) + z.T @ np.column_stack([z, part["y"].to_numpy()])
        for fold, sums in total.items():
            yield pd.DataFrame({"fold": fold, "i": np.arange(len(sums)), "part": list(sums)})

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.iloc[:1].assign(part=[np.sum(np.stack(frame["part"].to_numpy()), axis=0)])

    # as many tasks as the labelled rows need; their sums, one row an equation, are added in two rounds
    parts, ddl = math.ceil(sums["n"] / rows_a_sum), "fold int, i int, part array<double>"
    partial = rows.select("fold", "x", "y").repartition(parts).mapInPandas(equations, ddl).withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(math.isqrt(parts) + 1)))
    system = partial.groupBy("fold", "i", "slot").applyInPandas(added, ddl + ", slot int").drop("slot").groupBy("fold", "i").applyInPandas(added, ddl).orderBy("fold", "i").toPandas()
    by_fold = {fold: np.stack(part["part"].to_numpy()) for fold, part in system.groupby("fold")}
    total = sum(by_fold.values())

    def solved(both: np.ndarray) -> np.ndarray:
        """The ridge solution; a last entry of the right side that is all zeros leaves all weights zero."""
        return np.linalg.solve(both[:, :-1] + RIDGE * max(1.0, both[-1, -2]) * np.eye(len(both)), both[:, -1])

    model = QualityModel(mean, scale, directions, phases, solved(total), [solved(total - by_fold.get(k, 0.0)) for k in range(FOLDS)], np.zeros(1), np.full(1, 0.5))
    model = calibrated(model, rows)
    discard(rows)
    return model


def calibrated(model: QualityModel, rows: DataFrame) -> QualityModel:
    """The model with an isotonic fit of labels on raw scores, pooled over a fixed grid from -0.5 to 1.5.

    Each row of ``rows`` (fold, x, y) is scored by the weights of the other folds.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def grid(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, good = np.zeros(2 * GRID + 1), np.zeros(2 * GRID + 1)
        for frame in frames:
            for fold, part in frame.groupby("fold"):
                raw = shipped.value.lifted(np.stack(part["x"].to_numpy())) @ shipped.value.fold_weights[fold]
                at = np.rint((np.clip(raw, -0.5, 1.5) + 0.5) * GRID).astype(int)
                np.add.at(n, at, 1)
                np.add.at(good, at, part["y"].to_numpy())
        held = np.flatnonzero(n)
        yield pd.DataFrame({"step": held, "n": n[held], "good": good[held]})

    found = rows.select("fold", "x", "y").mapInPandas(grid, "step int, n double, good double").groupBy("step").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).orderBy("step").toPandas()
    blocks: list[list[float]] = []  # pool adjacent violators: first step, last step, rows, good rows
    for step, n, good in found.itertuples(index=False):
        blocks.append([step, step, n, good])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, last, n, good = blocks.pop()
            blocks[-1][1], blocks[-1][2], blocks[-1][3] = last, blocks[-1][2] + n, blocks[-1][3] + good
    steps = np.array([s / GRID - 0.5 for b in blocks for s in (b[0], b[1] + 1e-6)])
    levels = np.array([(b[3] + 0.5) / (b[2] + 1.0) for b in blocks for _ in (0, 1)])
    model.steps, model.levels = steps, np.maximum.accumulate(levels)
    return model


def scored(stats: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score, predicted) from (doc_id, x) rows."""
    shipped = stats.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                score = shipped.value.score(np.stack(frame["x"].to_numpy()))
                yield pd.DataFrame({"doc_id": frame["doc_id"], "score": score, "predicted": (score >= 0.5).astype("int32")})

    return stats.mapInPandas(run, f"doc_id {type_of(stats, 'doc_id')}, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame, *, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every document by a model trained on ``labels``.

    Null and empty texts have all-zero statistics and are scored like any other; repeated rows
    score alike; an empty table gives no rows. Texts are read once: statistics are kept as a
    narrow table that training and scoring share.
    """
    stats = scratch(document_statistics(docs, id_col=id_col, text_col=text_col), "statistics")
    return scored(stats, train(stats, labels, usable=usable))


def keep_good(docs: DataFrame, model: QualityModel, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score at least ``least``.

    Null, empty and blank texts have all-zero statistics and are scored like any other, long texts are
    read whole, repeated rows share their fate, and an empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, at, CHARS_AT_ONCE // 4):
            x = [statistics(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(shipped.value.score(np.stack(x)) >= least))

    return docs.mapInArrow(run, docs.schema)


def training_rows(id_col: str = "doc_id") -> Column:
    """Rows that the registered query and the pipeline may learn from; the rest is held out."""
    return id_fold(id_col, 3) != 1
