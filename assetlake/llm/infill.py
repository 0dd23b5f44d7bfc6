"""Fill-in-middle samples: texts cut at two unit borders and put together in another order.

A unit is a run of the letters A-Z and a-z or any other single code point. Borders are found on the
UTF-8 bytes of a whole chunk of texts at once, eight bytes to a uint64 word: arithmetic on the words
marks each byte that ends a unit in that byte's top bit, `bitwise_count` gives the marks per word,
a search in their running total finds the word that holds the k-th mark, and clearing lowest marks
finds the byte within that word. No text is walked character by character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import chunks, text_bytes

#: Fixed marks in front of the three parts. A text that holds one of them stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Hundredths of the texts that are cut, and hundredths of those with the suffix first.
RATE, SPM_RATE = 90, 20

TOP = np.uint64(0x8080808080808080)
LOW7 = ~TOP
_CASE = np.uint64(0x2020202020202020)
#: Added to a byte under 128, these set its top bit from `a` on, and from behind `z` on.
_FROM_A, _BEHIND_Z = np.uint64(0x1F1F1F1F1F1F1F1F), np.uint64(0x0505050505050505)
_ONE, _BYTE, _SEVEN = np.uint64(1), np.uint64(8), np.uint64(56)

CUT = (
    "asset_id long, n_units long, form string, prefix_chars long, middle_chars long, output binary"
)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each text and the end, bytes of each text); texts start on words."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum((sizes + 7) // 8)])
    padded = b"".join(t + bytes(-len(t) % 8) for t in texts)
    return np.frombuffer(padded, "<u8"), first, sizes


def _within(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per word, the top bits of the bytes that belong to a text and not to the padding."""
    inside = np.full(first[-1], TOP)
    short = np.flatnonzero(sizes % 8)
    bits = (sizes[short] % 8 * 8).astype(np.uint64)
    inside[first[short + 1] - 1] &= (_ONE << bits) - _ONE
    return inside


def unit_ends(words: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per word, the top bit of each byte that ends a unit."""
    lower = (words | _CASE) & LOW7
    letter = (lower + _FROM_A) & ~(lower + _BEHIND_Z) & ~words & TOP
    going_on = words & ~(words << _ONE) & TOP  # bytes 10xxxxxx continue a code point
    inside = _within(first, sizes)

    def of_next(marks: np.ndarray) -> np.ndarray:
        """The mark of each byte's successor; nothing follows the last byte of a text."""
        after = np.zeros_like(marks)
        after[:-1] = marks[1:]
        after[first[1:][sizes > 0] - 1] = 0
        return (marks >> _BYTE) | (after << _SEVEN)

    inner = (letter & of_next(letter)) | (~letter & of_next(going_on))
    return ~inner & inside


def char_starts(words: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per word, the top bit of each byte that starts a code point."""
    return ~(words & ~(words << _ONE)) & _within(first, sizes)


def totals(marks: np.ndarray) -> np.ndarray:
    """Marks before each word, and all of them."""
    return np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])


def select(marks: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Byte offset just behind the k-th mark, k from 1, counted over all words."""
    word = np.searchsorted(before, k, side="left") - 1
    rest, value = k - before[word], marks[word].copy()
    for _ in range(7):
        more = rest > 1
        if not more.any():
            break
        value[more] &= value[more] - _ONE
        rest = rest - more
    lowest = value & (~value + _ONE)
    return word * 8 + (np.bitwise_count(lowest - _ONE).astype(np.int64) + 1) // 8


def _rank(marks: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Marks in front of byte offset `at`, counted over all words."""
    word, bits = at // 8, (at % 8 * 8).astype(np.uint64)
    padded = np.append(marks, np.uint64(0))
    return before[word] + np.bitwise_count(padded[word] & ((_ONE << bits) - _ONE))


def cut(texts: list[bytes], draws: np.ndarray, rate: int, spm_rate: int) -> dict[str, pa.Array]:
    """Columns of CUT but the id, for texts and four draws each."""
    words, first, sizes = words_of(texts)
    ends = unit_ends(words, first, sizes)
    before = totals(ends)
    n = before[first[1:]] - before[first[:-1]]
    a, b = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
    start = first[:-1] * 8

    def offset(k: np.ndarray) -> np.ndarray:
        """Bytes of each text in its first k units."""
        out, some = np.zeros(len(k), np.int64), k > 0
        out[some] = select(ends, before, (before[first[:-1]] + k)[some]) - start[some]
        return out

    low, high = offset(np.minimum(a, b)), offset(np.maximum(a, b))
    starts = char_starts(words, first, sizes)
    counted = totals(starts)
    chars = [_rank(starts, counted, start + at) - counted[first[:-1]] for at in (low, high)]
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    plain = (sizes == 0) | (draws[:, 2] % 100 >= rate)
    plain |= np.fromiter((any(m in t for m in marks) for t in texts), bool, len(texts))
    spm = draws[:, 3] % 100 < spm_rate
    p, s, m = marks
    output = [
        t if q else s + t[y:] + p + t[:x] + m + t[x:y] if f else p + t[:x] + s + t[y:] + m + t[x:y]
        for t, q, f, x, y in zip(texts, plain.tolist(), spm.tolist(), low.tolist(), high.tolist())
    ]
    return {
        "n_units": pa.array(n, pa.int64()),
        "form": pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string()),
        "prefix_chars": pa.array(chars[0], pa.int64(), mask=plain),
        "middle_chars": pa.array(chars[1] - chars[0], pa.int64(), mask=plain),
        "output": pa.array(output, pa.binary()),
    }


def infill(assets: DataFrame, seed: str = "1", rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Cut each asset's text into prefix, middle and suffix and put the middle last.

    assets: `asset_id` and `text`; other columns are ignored, whatever their names. The draws are
    the first four groups of eight hexadecimal digits of the sha256 of `seed`, `:` and the id: the
    prefix ends after the smaller of the first two modulo (units + 1) units, the middle after the
    larger; the third modulo 100 decides by `rate` whether a text is cut, the fourth by `spm_rate`
    whether the suffix comes first.

    Returns one row per input row: asset_id, n_units, form (plain, psm or spm), prefix_chars and
    middle_chars (code points, null if plain), output. psm is `<P>`prefix`<S>`suffix`<M>`middle, spm
    is `<S>`suffix`<P>`prefix`<M>`middle; `restored` gives the text back.

    A null text counts as empty. Empty texts and texts that hold one of the three marks are plain.
    A null id draws as an empty one. Repeated rows are cut alike, ties cannot arise. Texts of any
    length are cut whole; a task holds one Arrow batch of them. An empty table gives no rows.
    """
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("asset_id").cast("string"), F.lit("")))
    drawn = assets.select(
        F.col("asset_id").cast("long").alias("asset_id"),
        text_bytes(F.col("text")).alias("text"),
        F.unhex(F.substring(F.sha2(key, 256), 1, 32)).alias("draws"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch["text"].to_pylist(), batch["asset_id"]
            raw = b"".join(batch["draws"].to_pylist())
            draws = np.frombuffer(raw, ">u4").astype(np.int64).reshape(-1, 4)
            for a, b in chunks(texts):
                columns = cut(texts[a:b], draws[a:b], rate, spm_rate)
                yield pa.record_batch({"asset_id": ids.slice(a, b - a)} | columns)

    return drawn.mapInArrow(run, CUT).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that `infill` made this output of."""
    middle = F.substring_index(output, MIDDLE, -1)
    front = F.substring_index(output, MIDDLE, 1)

    def parts(first: str, second: str) -> tuple[Column, Column]:
        second_part = F.substring_index(front, second, -1)
        first_part = F.substring_index(F.substring_index(front, second, 1), first, -1)
        return first_part, second_part

    prefix, suffix = parts(PREFIX, SUFFIX)
    late_suffix, late_prefix = parts(SUFFIX, PREFIX)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(prefix, middle, suffix))
        .otherwise(F.concat(late_prefix, middle, late_suffix))
    )
