"""Cuts against a walk over the units of each text, and exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from assetlake.llm import infill as I

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)


def draws(asset_id, seed="1"):
    key = f"{seed}:{'' if asset_id is None else asset_id}"
    digits = hashlib.sha256(key.encode()).hexdigest()
    return [int(digits[k : k + 8], 16) for k in (0, 8, 16, 24)]


def brute(asset_id, text, rate=90, spm_rate=20):
    text, (h1, h2, h3, h4) = text or "", draws(asset_id)
    units = UNIT.findall(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return asset_id, len(units), "plain", None, None, text
    if h4 % 100 < spm_rate:
        return asset_id, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return asset_id, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


PIECES = ["a", "Z", "abcdefgh", "é", "ß", "漢", "😀", " ", "\n", "\r\n", "9", "@", "[", "`", "{", "\x00", "\x7f",
          "<", "<P", "S>", "M", ">", "́", "�", "Ａ"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES) | st.characters(codec="utf-8"), max_size=25), max_size=12))
def test_units_as_a_walk(lists):
    texts = ["".join(x).encode() for x in lists]
    words, first, sizes = I.words_of(texts)
    ends = I.unit_ends(words, first, sizes)
    before = I.totals(ends)
    starts = I.totals(I.char_starts(words, first, sizes))
    for n, text in enumerate(texts):
        units = [u.encode() for u in UNIT.findall(text.decode())]
        assert before[first[n + 1]] - before[first[n]] == len(units)
        assert starts[first[n + 1]] - starts[first[n]] == len(text.decode())
        k = np.arange(1, len(units) + 1)
        at = I.select(ends, before, before[first[n]] + k) - first[n] * 8
        assert at.tolist() == np.cumsum([len(u) for u in units], dtype=int).tolist()


def rows_of(n, seed):
    rng = random.Random(seed)
    rows = [(k, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60)))) for k in range(n)]
    return rows + [(n, None), (n + 1, ""), (None, "no id"), (n + 2, "x<P>y"), (n + 3, "one"), (n + 3, "one")]


@pytest.mark.parametrize("rate, spm_rate", [(90, 20), (100, 50), (0, 0)])
def test_as_brute_force(spark, assets, rate, spm_rate):
    rows = rows_of(300, rate)
    df = I.infill(assets(rows), rate=rate, spm_rate=spm_rate)
    assert df.columns == ["asset_id", "n_units", "form", "prefix_chars", "middle_chars", "output"]
    want = sorted((brute(*row, rate, spm_rate) for row in rows), key=str)
    assert sorted((tuple(r) for r in df.collect()), key=str) == want
    back = df.withColumn("text", I.restored(F.col("output"), F.col("form"))).collect()
    texts = {i: t or "" for i, t in rows}
    assert all(r.text == texts[r.asset_id] for r in back)


def test_very_long_texts_and_many_batches(spark, assets):
    rows = [(1, "ab é" * 800_000), (2, "a" * 3_000_000), (3, "漢" * 1_000_001)] + [(k, "x y") for k in range(4, 400)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.asset_id: tuple(r) for r in I.infill(assets(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert all(got[i] == brute(i, t) for i, t in rows)


def test_empty_table(spark, assets):
    assert I.infill(assets([])).collect() == []
