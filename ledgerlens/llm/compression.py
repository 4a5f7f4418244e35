"""Quality classifier by compression (operator 11).

Two zstandard dictionaries are built, one from texts labelled good and one from
texts labelled bad. A text is compressed with each, in pieces of ``PIECE`` bytes
so that the dictionary, not the text's own beginning, decides what is short. It
is like good texts if the good dictionary shortens it more:

    difference = (bytes with the bad dictionary - bytes with the good one) / bytes of the text

A logistic curve, fitted on labelled texts that gave no dictionary, turns the
difference into a score (probability of label 1).

Fitting reads a bounded sample: of the training labels of each class, half (by
a hash of the id) are for the dictionaries and half for the curve, at most
``LABELLED`` rows each, those with the smallest hash. A dictionary text gives at
most ``PIECES_A_TEXT`` pieces of ``SAMPLE_PIECE`` bytes spread evenly over it, a
class at most ``SAMPLE_PIECES`` of them (8 MB). The curve weighs each class by
its number of training labels. Labels are joined by id; ids, sources and
languages are no inputs of a score. All texts are scored, whole.

Defined cases: a null or empty text has difference 0 and is scored like others;
ids labelled both good and bad, and null labels, do not train; repeated rows
are scored each; where the labels have one class only, every score is that
class (1 or 0), without labels 0.5; a class too small to train a dictionary on
uses its pieces as they are; extra columns pass through ``classify`` and output
columns replace input columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, check_columns, schema_with, slices, text_bytes, with_columns

PIECE = 512
LEVEL = 3
DICTIONARY_BYTES = 256 << 10
LABELLED = 4000
SAMPLE_PIECE = 2048
SAMPLE_PIECES = 4096
PIECES_A_TEXT = 64
SEED = 11


@dataclass
class Model:
    """Dictionary contents (good and bad; none where a class is missing) and
    the curve: score = 1 / (1 + exp(-(slope * difference + shift)))."""
    good: bytes | None
    bad: bytes | None
    slope: float = 0.0
    shift: float = 0.0
    constant: float | None = None


class Sizes:
    """Compressed sizes with one dictionary."""

    def __init__(self, content: bytes):
        made = zstandard.ZstdCompressionDict(content)
        made.precompute_compress(level=LEVEL)
        self.one = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=False,
                                            write_content_size=False, write_dict_id=False)

    def __call__(self, text: bytes) -> int:
        compress = self.one.compress
        return sum(len(compress(text[i:i + PIECE])) for i in range(0, len(text), PIECE))


def dictionary(pieces: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on the pieces, or the pieces themselves where they
    are too few to train on."""
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:] or b"\n" * 8


def difference(text: bytes, good: Sizes, bad: Sizes) -> float:
    return (bad(text) - good(text)) / len(text) if text else 0.0


def sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-z))) if z >= 0 else float(np.exp(z) / (1 + np.exp(z)))


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the weighted logistic fit, by Newton's method. The
    targets are drawn in a little (Platt), so that the fit is finite where the
    classes are apart."""
    up, down = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    scale = max(float(np.abs(x).max()), 1e-9)
    z = np.column_stack([x / scale, np.ones(len(x))])
    beta = np.zeros(2)

    def loss(b):
        t = z @ b
        return float((weight * (np.logaddexp(0, t) - target * t)).sum())

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -500, 500)))
        slope = z.T @ (weight * (p - target))
        bend = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-9 * np.eye(2)
        move, rate = np.linalg.solve(bend, slope), 1.0
        while rate > 1e-6 and loss(beta - rate * move) > loss(beta):
            rate /= 2
        beta = beta - rate * move
        if np.abs(rate * move).max() < 1e-10:
            break
    return float(beta[0] / scale), float(beta[1])


def _differences(df: DataFrame, text_col: str, model: Model) -> DataFrame:
    """The frame with the column ``difference`` for its texts."""

    def run(batches):
        good, bad = Sizes(model.good), Sizes(model.bad)
        for whole in batches:
            for batch in slices(whole, text_col):
                made = [difference(t, good, bad) for t in text_bytes(batch.column(text_col))]
                yield with_columns(batch, {"difference": pa.array(made, pa.float64())})

    return df.mapInArrow(run, schema_with(df, "difference double"))


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED) -> Model:
    """Learns from the labels (1 good, 0 bad) of ids for which ``train``, a
    condition on ``id_col``, holds."""
    check_columns(docs, id_col, text_col)
    check_columns(labels, id_col, label_col)
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    usable = usable if train is None else usable.where(train)
    usable = (usable.groupBy(F.col(id_col).alias("__id")).agg(
        F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("__most"))
        .where(F.col("label") == F.col("__most")).select("__id", "label"))
    counts = {r[0]: r[1] for r in usable.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Model(None, None, constant=float(next(iter(counts), 0.5)))
    draw = F.xxhash64("__id", F.lit(SEED))
    # at most 4 * labelled rows: the hash decides which, whatever the partitions
    picked = None
    for label in (0, 1):
        for half in (0, 1):
            one = (usable.where((F.col("label") == label) & (F.pmod(draw, F.lit(2)) == half))
                   .orderBy(draw, "__id").limit(labelled).withColumn("half", F.lit(half)))
            picked = one if picked is None else picked.unionAll(one)
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(
        F.broadcast(picked), "__id")

    def cut(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                label, at, piece = [], [], []
                for one, text in zip(batch.column("label").to_pylist(), text_bytes(batch.column("text"))):
                    starts = range(0, len(text), SAMPLE_PIECE)
                    for i in range(min(len(starts), PIECES_A_TEXT)):
                        j = starts[i * len(starts) // min(len(starts), PIECES_A_TEXT)]
                        label.append(one)
                        at.append(j)
                        piece.append(text[j:j + SAMPLE_PIECE])
                yield pa.RecordBatch.from_pydict({"label": pa.array(label, pa.int32()), "at": pa.array(at, pa.int64()),
                                                  "piece": pa.array(piece, pa.binary())})

    pieces = sample.where("half = 0").select("label", "text").mapInArrow(cut, "label int, at long, piece binary")
    order = [F.xxhash64("piece", "at"), "piece"]
    content = [[bytes(r[0]) for r in pieces.where(F.col("label") == label).select("piece").orderBy(*order)
                .limit(SAMPLE_PIECES).collect()] for label in (0, 1)]
    model = Model(dictionary(content[1]), dictionary(content[0]))
    # in one order, so that sums do not depend on the partitions
    got = sorted(_differences(sample.where("half = 1").select("label", "text"), "text", model).select(
        "label", "difference").collect())
    y, x = np.array([r[0] for r in got], int), np.array([r[1] for r in got], float)
    if len(set(y.tolist())) < 2:
        share = counts[1] / (counts[0] + counts[1])
        model.shift = float(np.log(share / (1 - share)))
        return model
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    model.slope, model.shift = curve(x, y, weight)
    return model


def classify(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= threshold, else 0)."""
    check_columns(df, text_col)
    bounded_batches(df.sparkSession)

    def run(batches):
        sizes = (Sizes(model.good), Sizes(model.bad)) if model.constant is None else None
        for whole in batches:
            for batch in slices(whole, text_col):
                made = [model.constant if sizes is None else
                        sigmoid(model.slope * difference(t, *sizes) + model.shift)
                        for t in text_bytes(batch.column(text_col))]
                yield with_columns(batch, {"score": pa.array(made, pa.float64()),
                                           "predicted": pa.array([int(s >= threshold) for s in made], pa.int32())})

    return df.mapInArrow(run, schema_with(df, "score double, predicted int"))
