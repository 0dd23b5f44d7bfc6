"""Language spans of mixed texts by Viterbi over word scores.

A language is known by the three-byte runs of its words, counted over all labelled assets in a
table of fixed size. The script of a word, told by the lead bytes of its UTF-8 characters, leaves
only languages that were seen in that script. Each word then has a score per language, and the
best labelling of a text's words is found by dynamic programming, where every change of language
costs a penalty. Texts of like length are walked together, one word of each at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks, give_back, in_fold, text_bytes

UNKNOWN = "und"
BUCKETS = 1 << 15
SLICES = 16
#: What a change of language costs, in natural logarithms.
SWITCH_PENALTY = 8.0
#: A word counts against a language by no more than this.
WORD_LIMIT = 6.0
#: A language is tried in a script that holds this share of its words.
SCRIPT_SHARE = 0.001
#: Texts that are walked together.
TOGETHER = 512

#: First lead byte of each script's range. UTF-8 blocks by lead byte.
SCRIPTS = [
    (0x00, "none"), (0x41, "latin"), (0x5B, "none"), (0x61, "latin"), (0x7B, "none"),
    (0xC3, "latin"), (0xCD, "greek"), (0xD0, "cyrillic"), (0xD4, "armenian"), (0xD7, "hebrew"),
    (0xD8, "arabic"), (0xDC, "syriac"), (0xE0, "indic"), (0xE1, "southeast"), (0xE2, "none"),
    (0xE3, "cjk"), (0xEA, "hangul"), (0xEE, "none"),
]
NAMES = sorted({name for _, name in SCRIPTS if name != "none"})


def _script_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for start, name in SCRIPTS:
        table[start:] = 0 if name == "none" else NAMES.index(name) + 1
    return table


SCRIPT_OF = _script_table()
COUNTS = "lang string, slice int, counts binary"
SPAN = pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())])
LABELLED = pa.schema(
    [
        ("asset_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("lang_pred", pa.string()),
        ("score", pa.float64()),
        ("spans", pa.list_(SPAN)),
    ]
)
LABELLED_DDL = (
    "asset_id long, held_out boolean, lang_pred string, score double, "
    "spans array<struct<lang:string,first_word:long,n_words:long>>"
)


class Words:
    """Words between white space of several texts, as one row of bytes with blanks between."""

    def __init__(self, texts: list[bytes]):
        plain = [t.decode("utf-8", "replace") for t in texts]
        #: Whether each text has a letter at all; scripts are told by lead bytes, so roughly.
        self.letters = np.array([any(map(str.isalpha, t)) for t in plain], bool)
        words = [t.lower().encode().split() for t in plain]
        self.sizes = np.array([len(w) for w in words])
        joined = b" " + b" ".join(b" ".join(w) for w in words if w) + b" "
        self.bytes = np.frombuffer(joined, np.uint8)
        blank = np.flatnonzero(self.bytes == 32)
        self.starts = blank[:-1] if self.sizes.sum() else np.empty(0, np.int64)

    def grams(self) -> np.ndarray:
        """Bucket of the three bytes from each byte on, for words with their blanks."""
        b = self.bytes.astype(np.uint32)
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        return (code * np.uint32(0x9E3779B1)) >> np.uint32(17)

    def scripts(self) -> np.ndarray:
        """Script of each word: of its first letter; 0 where it has none."""
        if not len(self.starts):
            return np.empty(0, np.uint8)
        script = SCRIPT_OF[self.bytes]
        letters = np.flatnonzero(script)
        if not len(letters):
            return np.zeros(len(self.starts), np.uint8)
        first = np.minimum(np.searchsorted(letters, self.starts), len(letters) - 1)
        at = letters[first]
        ends = np.append(self.starts[1:], len(self.bytes) - 1)
        return np.where((at >= self.starts) & (at < ends), script[at], 0)


def _counts(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of gram buckets, then of words per script, by language."""
    held: dict[str, np.ndarray] = {}
    for table in tables:
        langs = np.array(table.column("lang").to_pylist(), object)
        texts = table.column("text").to_pylist()
        for lang in sorted(set(langs)):
            mine = [texts[i] for i in np.flatnonzero(langs == lang)]
            total = held.setdefault(lang, np.zeros(BUCKETS + SLICES * 2, np.int64))
            for a, b in chunks(mine, 1 << 20):
                words = Words(mine[a:b])
                scripts = words.scripts()
                total[:BUCKETS] += np.bincount(words.grams(), minlength=BUCKETS)
                total[BUCKETS:] += np.bincount(scripts, minlength=SLICES * 2)
    for lang, total in held.items():
        parts = total[:BUCKETS].reshape(SLICES, -1), total[BUCKETS:].reshape(SLICES, -1)
        blobs = [np.concatenate(p).tobytes() for p in zip(*parts)]
        yield pa.record_batch(
            {
                "lang": pa.array([lang] * SLICES),
                "slice": pa.array(range(SLICES), pa.int32()),
                "counts": pa.array(blobs, pa.binary()),
            }
        )


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, np.int64) for b in table["counts"].to_pylist())
    return table.slice(0, 1).select(["lang", "slice"]).append_column(
        "counts", pa.array([total.tobytes()], pa.binary())
    )


class Model:
    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = np.array(sorted(counts), object)
        if not counts:
            return
        rows = np.stack([counts[lang].reshape(SLICES, -1) for lang in self.langs])
        size = BUCKETS // SLICES
        grams = rows[:, :, :size].reshape(len(rows), -1)
        scripts = rows[:, :, size:].reshape(len(rows), -1)
        share = (grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
        self.gram_scores = np.log(share).T.astype(np.float32)
        # the most words learnt decide where nothing else does
        self.fallback = int(np.argmax(scripts.sum(axis=1)))
        words = np.maximum(1, scripts[:, 1:].sum(axis=1, keepdims=True))
        self.tried = (scripts / words >= SCRIPT_SHARE).T
        self.tried[~self.tried.any(axis=1)] = True

    def word_scores(self, words: Words, scripts: np.ndarray) -> np.ndarray:
        """Score of each word for each language, at most 0."""
        if not len(words.starts):
            return np.empty((0, len(self.langs)), np.float32)
        # grams that begin at a word's last byte reach into the next word and do not count
        grams = words.grams()
        scores = self.gram_scores[grams]
        scores[words.bytes[1:-1] == 32] = 0
        scores = np.add.reduceat(scores, np.minimum(words.starts, len(scores) - 1), axis=0)
        tried = self.tried[scripts]
        scores[~tried] = -np.inf
        top = scores.max(axis=1, keepdims=True)
        scores -= top + np.log(np.exp(scores - top).sum(axis=1, keepdims=True))
        scores = np.maximum(scores, -WORD_LIMIT)
        scores[scripts == 0] = 0
        return scores


def best_path(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word; words of a text follow one another, `sizes` per text."""
    path = np.zeros(len(scores), np.int16)
    came = np.empty(scores.shape, np.int16)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    own = np.arange(scores.shape[1], dtype=np.int16)
    for k in range(0, len(order), TOGETHER):
        texts = order[k : k + TOGETHER]
        start, length = starts[texts], sizes[texts]
        total = scores[start].copy()
        still = np.searchsorted(-length, -np.arange(length[0]), side="left")
        for t in range(1, length[0]):
            n = still[t]
            stay = total[:n]
            best = stay.argmax(axis=1)
            switch = stay[np.arange(n), best] - penalty
            change = switch[:, None] > stay
            came[start[:n] + t] = np.where(change, best[:, None], own)
            total[:n] = np.where(change, switch[:, None], stay) + scores[start[:n] + t]
        state = total.argmax(axis=1)
        for t in range(length[0] - 1, 0, -1):
            n = still[t]
            at = start[:n] + t
            path[at] = state[:n]
            state[:n] = came[at, state[:n]]
        path[start] = state
    return path


def _label(model: Model, penalty: float):
    def one(table: pa.Table) -> pa.Table:
        texts = table["text"].to_pylist()
        words = Words(texts)
        scripts = words.scripts()
        path = best_path(model.word_scores(words, scripts), words.sizes, penalty)
        text = np.repeat(np.arange(len(texts)), words.sizes)
        count = len(model.langs)
        lettered = scripts > 0
        votes = np.bincount(
            text[lettered] * count + path[lettered], minlength=len(texts) * count
        ).reshape(len(texts), count)
        best, all_ = votes.argmax(axis=1), votes.sum(axis=1)
        best = np.where(all_ > 0, best, model.fallback)
        letters = words.letters
        share = votes[np.arange(len(texts)), best] / np.maximum(1, all_)
        new = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (text[1:] != text[:-1])][: len(path)])
        first = np.cumsum(words.sizes) - words.sizes
        runs = pa.StructArray.from_arrays(
            [
                pa.array(model.langs[path[new]], pa.string()),
                pa.array(new - first[text[new]], pa.int64()),
                pa.array(np.diff(np.append(new, len(path))), pa.int64()),
            ],
            ["lang", "first_word", "n_words"],
        )
        offsets = np.r_[0, np.cumsum(np.bincount(text[new], minlength=len(texts)))]
        return pa.table(
            [
                table["asset_id"],
                table["held_out"],
                pa.array(np.where(letters, model.langs[best], UNKNOWN), pa.string()),
                pa.array(np.where(letters, share, 0.0)),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs),
            ],
            schema=LABELLED,
        )

    def label(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables:
            table = pa.Table.from_batches([batch])
            for a, b in chunks(table["text"].to_pylist(), (1 << 22) // len(model.langs)):
                yield from one(table.slice(a, b - a)).combine_chunks().to_batches()
            give_back()

    return label


def label_language(
    assets: DataFrame,
    held_out_modulus: int = 5,
    held_out_remainder: int = 0,
    penalty: float = SWITCH_PENALTY,
) -> DataFrame:
    """The language of every asset's text, and the spans of languages within it.

    assets: `asset_id`, `text`, `lang` (null where unknown); other columns are ignored. Learnt
    from all texts with a language, but for assets whose crc32(asset_id as text) leaves
    `held_out_remainder` on division by `held_out_modulus`. `lang` is no input of a prediction.

    Returns one row per input row: `asset_id`, `held_out`, `lang_pred`, `score` (share of the
    words with letters that are labelled `lang_pred`) and `spans` (language, first word and
    number of words of each run; words stand between white space).

    Null or empty text, and text without a letter: `und`, score 0. Nothing to learn from: `und`
    throughout. Letters, but of no script that is known here: the language learnt from most.
    Repeated rows are learnt from and labelled each. Null id: learnt from. Empty table: no rows.
    The model has a fixed size for each language; its total is broadcast.
    """
    docs = assets.select(
        F.col("asset_id").cast("long").alias("asset_id"),
        text_bytes(F.col("text")).alias("text"),
        "lang",
        in_fold(F.col("asset_id"), held_out_modulus, held_out_remainder).alias("held_out"),
    )
    counts = (
        docs.filter(~F.col("held_out") & F.col("lang").isNotNull())
        .select("lang", "text")
        .mapInArrow(_counts, COUNTS)
        .groupBy("lang", "slice")
        .applyInArrow(_added, COUNTS)
        .orderBy("lang", "slice")
        .toArrow()
    )
    blobs: dict[str, list[bytes]] = {}
    for lang, blob in zip(counts["lang"].to_pylist(), counts["counts"].to_pylist()):
        blobs.setdefault(lang, []).append(blob)
    model = Model({k: np.frombuffer(b"".join(v), np.int64) for k, v in blobs.items()})
    if not blobs:
        empty = F.array().cast("array<struct<lang:string,first_word:long,n_words:long>>")
        return docs.select(
            "asset_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"),
            F.lit(0.0).alias("score"), empty.alias("spans"),
        )
    return docs.select("asset_id", "held_out", "text").mapInArrow(
        _label(model, penalty), LABELLED_DDL
    )
