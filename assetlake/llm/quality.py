"""Quality scores by logistic regression over hashed word n-grams.

Features are the words of a text and pairs of neighbours, each also by its shape (runs of lower
case, upper case and digits count as one sign each) and by whether a word repeats the one before.
Weights are learnt with follow-the-regularised-leader updates, one example after the other, from
a bounded sample of labelled assets; a text's score is a sparse dot product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, gram_hashes, in_fold, text_bytes, word_hashes

DIMENSIONS = 1 << 18
#: Labelled assets that are learnt from, at most: those with the smallest hashes of their ids.
SAMPLE = 12_000
PASSES = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-4
THRESHOLD = 0.7

#: Signs of a word's shape.
SHAPE = bytes(
    97 if c >= 128 or 97 <= c <= 122 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c
    for c in range(256)
)
RUNS = re.compile(rb"a{2,}|A{2,}|0{2,}")
KINDS = 5
FEATURES = "asset_id long, label int, places binary, amounts binary"
SCORED = pa.schema(
    [
        ("asset_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("score", pa.float64()),
        ("predicted", pa.int32()),
    ]
)
SCORED_DDL = "asset_id long, held_out boolean, score double, predicted int"


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct places, amounts): logarithms of counts, scaled to length 1 per kind."""
    words = word_hashes(text.translate(LOWER).split())
    if not len(words):
        return np.empty(0, np.uint32), np.empty(0)
    shapes = word_hashes(RUNS.sub(lambda m: m[0][:1], text.translate(SHAPE)).split())
    again = np.full(int((words[1:] == words[:-1]).sum()), np.uint64(1))
    places, amounts = [], []
    kinds = (words, gram_hashes(words, 2), shapes, gram_hashes(shapes, 2), again)
    for kind, hashes in enumerate(kinds):
        if len(hashes):
            salt = np.uint64((kind + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
            bucket = ((hashes ^ salt) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(46)
            place, count = np.unique(bucket, return_counts=True)
            amount = np.log1p(count)
            share = len(hashes) / len(words) if kind == KINDS - 1 else 1.0
            places.append(place)
            amounts.append(amount * share / np.sqrt((amount**2).sum()))
    place, where = np.unique(np.concatenate(places), return_inverse=True)
    return place.astype(np.uint32), np.bincount(where, weights=np.concatenate(amounts))


class Leader:
    """Follow-the-regularised-leader with per-coordinate rates; the last place is the bias."""

    def __init__(self):
        self.z = np.zeros(DIMENSIONS + 1)
        self.n = np.zeros(DIMENSIONS + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - rate * w
        self.n[at] += g * g


def _featured(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in tables:
        rows = [features(t) for t in table.column("text").to_pylist()]
        yield pa.record_batch(
            {
                "asset_id": table.column("asset_id"),
                "label": table.column("label"),
                "places": pa.array([p.tobytes() for p, _ in rows], pa.binary()),
                "amounts": pa.array([a.astype(np.float32).tobytes() for _, a in rows], pa.binary()),
            }
        )


def _trained(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [row for t in tables for row in zip(*(t.column(c).to_pylist() for c in t.schema.names))]
    leader = Leader()
    examples = [
        (
            np.append(np.frombuffer(places, np.uint32), DIMENSIONS),
            np.append(np.frombuffer(amounts, np.float32), 1.0).astype(float),
            label,
        )
        for _, label, places, amounts in sorted(rows, key=lambda r: r[1:])
    ]
    rng = np.random.default_rng(0)
    for _ in range(PASSES):
        for i in rng.permutation(len(examples)):
            leader.learn(*examples[i])
    weights = leader.weights().astype(np.float32).tobytes()
    yield pa.record_batch({"weights": pa.array([weights], pa.binary())})


def _scored(weights: np.ndarray, threshold: float):
    def score(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            margin = np.full(table.num_rows, weights[-1], float)
            for i, text in enumerate(table.column("text").to_pylist()):
                places, amounts = features(text)
                margin[i] += weights[places] @ amounts
            scores = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
            columns = [
                table.column("asset_id"),
                table.column("held_out"),
                pa.array(scores),
                pa.array((scores >= threshold).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=SCORED)

    return score


def score_quality(
    assets: DataFrame,
    labels: DataFrame,
    held_out_modulus: int = 4,
    held_out_remainder: int = 2,
    sample: int = SAMPLE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """How likely each asset's text is of good quality.

    assets: `asset_id`, `text`. labels: `asset_id`, `quality` (1 good, 0 bad, null ignored).
    Other columns are ignored and nothing but the text is an input of a score. Learnt from the
    `sample` labelled assets with the smallest hashes of their ids, leaving out those whose
    crc32(asset_id as text) leaves `held_out_remainder` on division by `held_out_modulus`. That
    bound holds at every size of the corpus; all assets are scored.

    Returns one row per row of assets: `asset_id`, `held_out`, `score` (0 to 1, higher means
    label 1 is likelier), `predicted` (1 if the score is at least `threshold`, else 0).

    Null or empty text: the score of the bias alone. No labels: 0.5 throughout. Null ids are
    scored, never learnt from. Repeated rows are scored each; repeated labels count each. Empty
    table: no rows.
    """
    held_out = in_fold(F.col("asset_id"), held_out_modulus, held_out_remainder)
    chosen = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("asset_id").isNotNull() & ~held_out)
        .select(F.col("asset_id").cast("long").alias("asset_id"), F.col("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("asset_id"), "asset_id", "label")
        .limit(sample)
    )
    docs = assets.select(
        F.col("asset_id").cast("long").alias("asset_id"),
        text_bytes(F.col("text")).alias("text"),
        held_out.alias("held_out"),
    )
    # at most `sample` rows of an id and a label
    learnt = docs.drop("held_out").join(F.broadcast(chosen), "asset_id")
    model = (
        learnt.select("asset_id", "label", "text")
        .mapInArrow(_featured, FEATURES)
        .repartition(1)
        .mapInArrow(_trained, "weights binary")
        .first()
    )
    weights = np.frombuffer(model["weights"], np.float32) if model else np.zeros(DIMENSIONS + 1)
    return docs.mapInArrow(_scored(weights.astype(float), threshold), SCORED_DDL)
