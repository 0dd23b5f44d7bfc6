"""Manifests and proofs against trees built and climbed in Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from assetlake.llm import manifest as M

ROW = "asset_id long, batch_id string, lang string, n_chars long, text string, tree int, level string, proof int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def built(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[k : k + 8]) for k in range(0, len(below), 8)])
    return levels


def brute(rows, claimed):
    groups = {}
    for row, claim in zip(rows, claimed):
        groups.setdefault(row[2], []).append((row, claim))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for name in names:
        groups[name].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, leaf(x[0]), leaf(x[1])))
    trees = {name: built([leaf(row) for row, _ in groups[name]]) for name in names}
    top = built([trees[name][-1][0] for name in names])
    out = []
    for rank, name in enumerate(names):
        for place, (row, claim) in enumerate(groups[name]):
            folded, proof = leaf(claim), ""
            for levels, k in ((trees[name], place), (top, rank)):
                for nodes in levels[:-1]:
                    run, at = nodes[k // 8 * 8 : k // 8 * 8 + 8], k % 8
                    proof += "".join(run[:at] + run[at + 1 :])
                    folded = H(*run[:at], folded, *run[at + 1 :])
                    k //= 8
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[name][-1][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def rows_of(n, langs, seed=1):
    rng = random.Random(seed)
    ids = [None, *range(3 * n)]
    return [
        (rng.choice(ids), rng.choice(["s", None]), rng.choice(langs), rng.choice([1, None]),
         rng.choice([None, "", "Ab é", "abc", "XYZ" * 5]), 1, "x", 2)
        for _ in range(n)
    ]


@pytest.mark.parametrize(
    "n, langs",
    [(0, ["a"]), (1, ["a"]), (9, ["a"]), (40, ["a", "b", None]),
     (4700, ["a"] * 9 + [None, "b", "c", "é", "Z"]), (150, [f"l{k}" for k in range(120)])],
)
def test_as_brute_force(spark, n, langs):
    rows = rows_of(n, langs)
    claim = F.when(F.col("asset_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))
    df = M.audit_assets(spark.createDataFrame(rows, ROW).repartition(3), {"text": claim})
    assert df.columns == ["asset_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
    claimed = [
        (*r[:4], r[4] and r[4].lower()) if r[0] is not None and r[0] % 3 == 0 else r for r in rows
    ]
    assert sorted((tuple(r) for r in df.collect()), key=str) == brute(rows, claimed)


def test_copies_of_high_nodes(spark, monkeypatch):
    """With blocks of one run, every level above the first is told apart by blocks."""
    monkeypatch.setattr(M, "SHARED", 1)
    rows = rows_of(700, ["a", "a", "a", "b"], 2)
    df = M.audit_assets(spark.createDataFrame(rows, ROW))
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got == brute(rows, rows) and all(r[-1] for r in got)


def test_repeated_rows_long_texts_and_other_fields(spark):
    long = "Ü" * 1_000_000
    rows = [(7, "s", "a", 1, long, 0, "", 0)] * 20 + [(8, "s", None, 1, long[1:], 0, "", 0)]
    df = spark.createDataFrame(rows, ROW)
    got = M.audit_assets(df, {"text": F.lower("text")}).collect()
    assert len(got) == 21 and not any(r.verified for r in got)
    assert len({r.leaf for r in got if r.asset_id == 7}) == 1
    only = M.audit_assets(df, {"text": F.lower("text")}, fields=["asset_id", "lang"]).collect()
    assert all(r.verified for r in only)
    before = spark.conf.get(M.ROW_LIMIT, None)
    assert before is None or before != "-1"
