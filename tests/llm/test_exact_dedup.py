"""Exact copies against grouping whole texts in Python."""

import random
import re

import pytest

from assetlake.llm import exact_dedup
from assetlake.llm.exact_dedup import drop_copies


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows):
    groups = {}
    for asset_id, text in rows:
        groups.setdefault(lower(text), []).append(asset_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        stays = ids.index(keep)
        out += [(i, keep, len(ids), n == stays, text) for n, i in enumerate(ids)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def texts(rng):
    """Texts that part late, end at the borders of levels, or differ in case only."""
    long = "".join(rng.choice("abcé") for _ in range(400))
    out = ["", None, "A", "a", "É", "é", "İ", "\x00", "\x00\x00"]
    for n in (7, 8, 9, 63, 64, 65, 200):
        out += [long[:n], long[:n].upper(), long[:n] + "x"]
    out += [long[:k] + "|" + long[k:] for k in (3, 70, 399)]
    return out + ["x" * 3000 + end for end in ("", "y", "Y", "yy")]


@pytest.mark.parametrize("ends", [exact_dedup.LEVEL_ENDS, (1, 8, 64, 4096)])
def test_as_brute_force(spark, assets, monkeypatch, ends):
    monkeypatch.setattr(exact_dedup, "SLICE_ROWS", 4)
    rng = random.Random(3)
    some = texts(rng)
    rows = [(rng.choice([None, rng.randint(0, 400)]), rng.choice(some)) for _ in range(300)]
    rows = [(None if i is None else n * 1000 + i, t) for n, (i, t) in enumerate(rows)]
    df = drop_copies(assets(rows), ends)
    assert df.columns == ["asset_id", "keep_id", "group_size", "kept", "text"]
    want = brute(rows)
    keep = {(t, i) for i, _, _, k, t in want if k and i is not None}
    have = got(df)
    assert [r[:3] + r[4:] for r in have] == [r[:3] + r[4:] for r in want]
    assert sum(r[3] for r in have) == len({r[4] for r in want})
    assert {(t, i) for i, _, _, k, t in have if k and i is not None} == keep


@pytest.mark.parametrize("few", [exact_dedup.BROADCAST_ROWS, 0])
def test_a_third_of_all_rows_alike(spark, assets, monkeypatch, few):
    """With joins that broadcast what is left, and with joins that shuffle it."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", few)
    rows = [(n, "Same " * 100 if n % 3 else f"{n}") for n in range(600)]
    assert got(drop_copies(assets(rows, partitions=5))) == brute(rows)


def test_repeated_rows_and_null_ids(spark, assets):
    rows = [(1, "a"), (1, "a"), (1, "A"), (None, "b"), (None, "B"), (None, None), (5, "")]
    have = got(drop_copies(assets(rows)))
    assert [r[:3] for r in have] == [r[:3] for r in brute(rows)]
    assert sum(r[3] for r in have) == 3
    assert {r[4]: r[1] for r in have} == {"a": 1, "b": None, "": 5}


def test_very_long_texts(spark, assets):
    body = "0123456789" * 300_000
    rows = [(1, body), (2, body), (3, body + "x"), (4, body[:-1] + "x"), (5, "y" + body[1:])]
    sizes = {r.asset_id: (r.keep_id, r.group_size) for r in drop_copies(assets(rows)).collect()}
    assert sizes == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1)}


def test_empty_table(spark, assets):
    assert drop_copies(assets([])).collect() == []


def test_a_text_beyond_the_last_level(spark, assets):
    with pytest.raises(ValueError, match="longer than 8 bytes"):
        drop_copies(assets([(1, "0123456789"), (2, "0123456789")]), (4, 8))
