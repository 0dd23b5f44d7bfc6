"""License notices in asset texts, exact and with a few errors.

Texts become words joined by single blanks. Exact notices are found as byte strings. For a notice
that may be off by up to k characters, the pigeonhole principle gives seeds: cut into k + 1
pieces, at least one piece stands unchanged. A seed's place bounds where the notice may begin and
end. Every span of whole words between those bounds that holds the words that tell one license
from another is given to the regular expression library, which counts its errors within the bound.
Of spans of a notice that overlap, the one with the fewest errors is its match.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import alnum_words, text_bytes


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: str
    errors: int = 0
    #: Words that a match must hold unchanged.
    keys: tuple[str, ...] = ()
    base: bool = False
    text: bytes = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "text", b" " + b" ".join(alnum_words(self.phrase.encode())) + b" ")


#: Notices that are found exactly, then those that may have errors.
NOTICES = (
    Notice("mit", "under the mit license", base=True),
    Notice("apache-2", "apache license version 2", base=True),
    Notice("cc-by-nc", "cc by nc", base=True),
    Notice("mit", "under the mit license", 3, ("mit",)),
    Notice("apache-2", "apache license version 2", 4, ("apache", "2")),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 5, ("commons",)),
    Notice("gpl-3", "gnu general public license version 3", 5, ("gnu", "3")),
    Notice("gpl-2", "gnu general public license version 2", 5, ("gnu", "2")),
    Notice("bsd", "under the bsd license", 3, ("bsd",)),
    Notice("mpl-2", "mozilla public license version 2", 5, ("mozilla", "2")),
    # one error may also be in the word that tells licenses apart, but in no number
    Notice("mit", "under the mit license", 1),
    Notice("apache-2", "apache license version 2", 1, ("2",)),
    Notice("gpl-3", "gnu general public license version 3", 1, ("3",)),
    Notice("gpl-2", "gnu general public license version 2", 1, ("2",)),
    Notice("bsd", "under the bsd license", 1),
    Notice("mpl-2", "mozilla public license version 2", 1, ("2",)),
)

SPAN = pa.struct(
    [
        ("label", pa.string()),
        ("first_word", pa.int64()),
        ("n_words", pa.int64()),
        ("errors", pa.int64()),
        ("base", pa.bool_()),
    ]
)
SCANNED = pa.schema(
    [("asset_id", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(SPAN))]
)
SCANNED_DDL = (
    "asset_id long, n_words long, score double, "
    "spans array<struct<label:string,first_word:long,n_words:long,errors:long,base:boolean>>"
)


def seeds(notice: Notice) -> list[tuple[int, bytes]]:
    """(offset, piece): errors + 1 pieces that make up the notice between its outer blanks."""
    body, parts = notice.text[1:-1], notice.errors + 1
    cuts = [len(body) * i // parts for i in range(parts + 1)]
    return [(a, body[a:b]) for a, b in zip(cuts, cuts[1:])]


def _places(text: bytes, piece: bytes) -> Iterator[int]:
    at = text.find(piece)
    while at >= 0:
        yield at
        at = text.find(piece, at + 1)


class Scanner:
    def __init__(self, notices: Sequence[Notice]):
        self.exact = [n for n in notices if n.base]
        self.fuzzy = []
        for n in notices:
            if n.base:
                continue
            body = regex.escape(n.text[1:-1], literal_spaces=True)
            pattern = rb"(?b)(?:" + body + rb"){e<=" + str(n.errors).encode() + rb"}"
            self.fuzzy.append((n, seeds(n), regex.compile(pattern)))

    def matches(self, text: bytes) -> list[tuple[int, int, int, Notice]]:
        """(begin, end, errors, notice) in text that begins and ends with a blank."""
        found = {
            (at + 1, at + len(n.text) - 1, 0, n) for n in self.exact for at in _places(text, n.text)
        }
        for notice, pieces, pattern in self.fuzzy:
            # a text without the words that must stand needs no seeds
            if not all(b" " + k.encode() + b" " in text for k in notice.keys):
                continue
            spans = []
            for begin, end in _spans(text, notice, pieces):
                words = text[begin:end].split()
                if all(w.encode() in words for w in notice.keys):
                    if m := pattern.fullmatch(text, begin, end):
                        spans.append((sum(m.fuzzy_counts), begin, end))
            taken: list[tuple[int, int]] = []
            for errors, begin, end in sorted(spans):
                at = bisect_left(taken, (end, 0))
                if not at or taken[at - 1][1] <= begin:
                    insort(taken, (begin, end))
                    found.add((begin, end, errors, notice))
        return sorted(found, key=lambda f: (f[0], not f[3].base, f[2], f[1], f[3].label))


def _spans(text: bytes, notice: Notice, pieces: list[tuple[int, bytes]]) -> set[tuple[int, int]]:
    """(begin, end) of all spans of whole words where some seed lets the notice be."""
    size, k = len(notice.text) - 2, notice.errors
    out = set()
    for offset, piece in pieces:
        for at in _places(text, piece):
            low, high = max(1, at - offset - k), min(len(text), at - offset + size + k + 1)
            blanks = [i for i in range(low - 1, high) if text[i] == 32]
            out.update(
                (a + 1, b)
                for a in blanks
                if a < at - offset + k
                for b in blanks
                if abs(b - a - 1 - size) <= k
            )
    return out


def scan_text(scanner: Scanner, data: bytes) -> tuple[int, float, list[dict]]:
    """(words, score, spans) of one text."""
    words = alnum_words(data)
    text = b" " + b" ".join(words) + b" "
    spans, score, at, word = [], 0.0, 0, 0
    ends: dict[str, int] = {}  # behind the last word that a span of the label covers
    for begin, end, errors, notice in scanner.matches(text):
        word += text.count(b" ", at, begin) - (at == 0)
        at = begin
        if notice.base or word >= ends.get(notice.label, 0):
            n_words = text.count(b" ", begin, end) + 1
            ends[notice.label] = max(word + n_words, ends.get(notice.label, 0))
            spans.append(
                {
                    "label": notice.label,
                    "first_word": word,
                    "n_words": n_words,
                    "errors": errors,
                    "base": notice.base,
                }
            )
        score = max(score, 1 - errors / (len(notice.text) - 2))
    return len(words), score, spans


def _scan(notices: Sequence[Notice]):
    def scan(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for table in tables:
            rows = [scan_text(scanner, t) for t in table.column("text").to_pylist()]
            n_words, score, spans = zip(*rows) if rows else ((), (), ())
            columns = [table.column("asset_id"), *(
                pa.array(c, t) for c, t in zip((n_words, score, spans), SCANNED.types[1:])
            )]
            yield pa.RecordBatch.from_arrays(columns, schema=SCANNED)

    return scan


def scan_licenses(assets: DataFrame, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """License notices in every asset's text.

    assets: `asset_id`, `text`; other columns are ignored. Words are runs of ASCII letters and
    digits and all non-ASCII characters, A-Z lower-cased. Base notices must stand word for word;
    the others may be off by `errors` characters but hold their `keys` unchanged.

    Returns one row per input row: `asset_id`, `n_words`, `score` (share of the best match's
    characters that are right; 0 without a match) and `spans` (label, first word from 0, number
    of words, errors, and whether it is a base notice). Base places are listed all; another match
    is left out where it overlaps one of its label before it.

    Null or empty text: no words, score 0, no spans. Repeated rows are scanned each. Null id:
    kept. Empty table: no rows.
    """
    return assets.select(
        F.col("asset_id").cast("long").alias("asset_id"), text_bytes(F.col("text")).alias("text")
    ).mapInArrow(_scan(tuple(notices)), SCANNED_DDL)


def license_summary(scanned: DataFrame) -> DataFrame:
    """Per asset: number and extreme places of base notices, and the labels found."""
    base = F.filter("spans", lambda s: s["base"])
    place = F.transform(base, lambda s: s["first_word"])
    names = lambda spans: F.array_join(
        F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ","
    )
    return scanned.select(
        "asset_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(place).alias("first_word"),
        F.array_max(place).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        "score",
    )
