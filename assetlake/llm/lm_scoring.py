"""Language-model scoring with a weighted backoff automaton.

States are contexts of up to `order` - 1 words, plus the root state without context. A state h
with word arc w carries log10((c(hw) + K p(w)) / (c(h) + K)), p being the probability in the state
without h's first word; where the arc is missing, the failure arc to that state costs
log10(K / (c(h) + K)) and what it gives follows, down to the root's arc, add-one smoothed over the
known words and one unknown word. The probabilities of a state sum to one over those words.

The counts of all learning assets decide the model, so it grows with them and is never held
whole: texts are dealt into batches, every batch adds up its n-grams and asks the shards for the
totals, and so gets the part of the automaton that its own texts can reach. One left-to-right
traversal then carries the state over the words of the batch and adds up each text's logarithms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import (
    REQUEST,
    blank_words,
    chunks,
    combine,
    dealt,
    gram_hashes,
    in_fold,
    partitions,
    requests,
    rows_of,
    scrambled,
    sums_of,
    text_bytes,
    unpack_keys,
    unpack_values,
    word_hashes,
)

#: Weight of the root's distribution in every state, in words.
BACKOFF_WEIGHT = 300.0
END = np.uint64(0x7F4A7C15F39CC060)
#: Counts of one batch and of all.
COUNT, TOTAL = "uint32", "int64"
#: Distinct words that a task gathers before it sends their counts on.
FLUSH = 1 << 21

SCORED = pa.schema(
    [
        ("asset_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("train_tokens", pa.int64()),
        ("base_score", pa.float64()),
        ("score", pa.float64()),
    ]
)
SCORED_DDL = (
    "asset_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double"
)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with one END behind each text, tokens per text)."""
    parts, sizes = [], []
    for a, b in chunks(texts):
        for text in texts[a:b]:
            words = blank_words(text)
            parts.append(word_hashes(words))
            parts.append(np.array([END]))
            sizes.append(len(words) + 1)
    return scrambled(np.concatenate(parts)), np.array(sizes)


def _places(sizes: np.ndarray) -> np.ndarray:
    """Number of each token in its text, from 0."""
    first = (np.cumsum(sizes) - sizes).astype(np.int32)
    return np.arange(sizes.sum(), dtype=np.int32) - np.repeat(first, sizes)


def _arcs(tokens: np.ndarray, places: np.ndarray, order: int) -> np.ndarray:
    """Key of the `order` tokens that end at each token; 0 where a text has fewer up to there."""
    arcs = np.concatenate((np.zeros(order - 1, np.uint64), gram_hashes(tokens, order)))
    arcs = arcs[: len(tokens)]
    arcs[places < order - 1] = 0
    return arcs


def _word_requests(shards: int):
    """Counts of the words of learning texts, by shard."""

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def flush():
            k, place = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(place, weights=np.concatenate(counts)).astype(TOTAL)
            keys.clear()
            counts.clear()
            yield from requests(0, k, n, shards).to_batches()

        for table in tables:
            if table.num_rows:
                tokens, _ = _tokens(table.column("text").to_pylist())
                k, n = np.unique(tokens, return_counts=True)
                keys.append(k)
                counts.append(n)
                held += len(k)
                if held > FLUSH:
                    yield from flush()
                    held = 0
        if keys:
            yield from flush()

    return count


def _shard_totals(table: pa.Table) -> pa.Table:
    keys = np.concatenate([unpack_keys(b) for b in table["keys"].to_pylist()])
    counts = np.concatenate([unpack_values(b, TOTAL) for b in table["vals"].to_pylist()])
    return pa.table({"n": [int(counts.sum())], "v": [len(np.unique(keys))]})


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, place of each value among them)."""
    keys, place = np.unique(values, return_inverse=True)
    return keys, place.astype(np.int32)


def _ask(order: int, shards: int):
    def ask(table: pa.Table) -> pa.Table:
        batch, table = rows_of(table)
        tokens, sizes = _tokens(table["text"].to_pylist())
        weight = np.repeat(~table["held_out"].to_numpy(), sizes).astype(np.float32)
        places = _places(sizes)
        keys, counts = [], []
        for n in range(1, order + 1):
            k, place = _distinct(_arcs(tokens, places, n))
            keys.append(k)
            counts.append(np.bincount(place, weights=weight).astype(COUNT))
        return requests(batch, np.concatenate(keys), np.concatenate(counts), shards)

    return ask


def _score(n: int, v: int, weight: float, order: int, shards: int):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return SCORED.empty_table()
        _, docs = rows_of(docs)
        tokens, sizes = _tokens(docs["text"].to_pylist())
        places = _places(sizes)
        keys, at = zip(*(_distinct(_arcs(tokens, places, k)) for k in range(1, order + 1)))
        del tokens
        ends = np.cumsum([len(k) for k in keys])
        counts = np.split(sums_of(answers, np.concatenate(keys), shards), ends[:-1])
        del keys
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        known = seen = counts[0][at[0]].astype(float)
        root = step = np.log10((known + 1) / (n + v + 1))
        for k in range(1, order):
            state = np.concatenate(([0.0], seen[:-1]))
            seen = counts[k][at[k]].astype(float)
            state[places < k] = seen[places < k] = 0
            failure = np.log10(weight / (state + weight))
            arc = np.log10((seen + weight * 10**step) / (state + weight))
            step = np.where(seen > 0, arc, failure + step)
        return pa.table(
            {
                "asset_id": docs["asset_id"],
                "held_out": docs["held_out"],
                "n_tokens": sizes.astype(np.int64),
                "n_known": np.add.reduceat((known > 0).astype(np.int64), first),
                "train_tokens": np.full(len(sizes), n, np.int64),
                "base_score": np.add.reduceat(root, first),
                "score": np.add.reduceat(step, first),
            }
        ).cast(SCORED)

    return score


def lm_score(
    assets: DataFrame,
    held_out_modulus: int = 7,
    held_out_remainder: int = 2,
    weight: float = BACKOFF_WEIGHT,
    order: int = 2,
) -> DataFrame:
    """Log10 probability of every asset's text under a model of the learning assets.

    assets: `asset_id`, `text`; other columns are ignored. Assets whose crc32(asset_id as text)
    leaves `held_out_remainder` on division by `held_out_modulus` are scored but not learnt from.
    Tokens are the words between white space, A-Z lower-cased, and one end per text. A state holds
    up to `order` - 1 of them.

    Returns one row per input row: `asset_id`, `held_out`, `n_tokens`, `n_known` (tokens that the
    learning texts hold), `train_tokens`, `base_score` (root alone), `score` (the automaton).

    Null or empty text: the end alone. Null id: learnt from. Repeated rows count and are scored
    each on its own. Empty table: no rows. No learning text: every token is unknown.
    """
    spark, shards = assets.sparkSession, partitions(assets.sparkSession)
    docs = assets.select(
        F.col("asset_id").cast("long").alias("asset_id"),
        text_bytes(F.col("text")).alias("text"),
        in_fold(F.col("asset_id"), held_out_modulus, held_out_remainder).alias("held_out"),
    )
    totals = (
        docs.filter(~F.col("held_out"))
        .select("text")
        .mapInArrow(_word_requests(shards), REQUEST)
        .groupBy("shard")
        .applyInArrow(_shard_totals, "n long, v long")
        .agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
        .first()
    )
    n, v = totals["n"] or 0, totals["v"] or 0
    batches = dealt(docs, "asset_id", "text")
    answers = combine(batches.applyInArrow(_ask(order, shards), REQUEST), "sum", COUNT, only_many=False)
    return batches.cogroup(answers.groupBy("batch")).applyInArrow(
        _score(n, v, weight, order, shards), SCORED_DDL
    )
