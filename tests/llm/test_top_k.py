import math
import random

import pytest

from assetlake.llm import top_k as tk


def brute(rows, k, modulus):
    fine = [
        (i, [math.floor(64 * x) for x in v])
        for i, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (i, q) in enumerate(fine):
        if i is None or i % modulus:
            continue
        scores = sorted(
            (-sum(x * y for x, y in zip(q, v)), (1, 0) if j is None else (0, j))
            for b, (j, v) in enumerate(fine)
            if a != b and len(v) == len(q)
        )
        out += [(i, r + 1, None if j[0] else j[1], -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def frame(spark, rows):
    rows = [(i, v, "clash", n) for n, (i, v) in enumerate(rows)]
    return spark.createDataFrame(rows, "asset_id long, vector array<double>, score string, uid long").repartition(3)


@pytest.mark.parametrize("block", [7, 4096])
@pytest.mark.parametrize("k", [3, 20])
def test_against_brute_force(spark, monkeypatch, block, k):
    monkeypatch.setattr(tk, "BLOCK", block)
    rng = random.Random(k)
    vec = lambda n=6, s=1.0: [rng.gauss(0, s) for _ in range(n)]
    same = vec()
    rows = [(i, vec()) for i in range(60)] + [(i, same) for i in range(100, 140)]
    rows += [(200, [0.0] * 6), (201, None), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [math.nan] * 6),
             (204, [math.inf] * 6), (220, vec(3)), (221, vec(3)), (240, []), (241, []), (260, vec(2)),
             (280, vec(6, 1e4)), (-20, vec()), (None, vec()), (None, same), (0, same), (0, same)]
    got = tk.top_k(frame(spark, rows), k=k, modulus=20).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, k, 20)


def test_wide_scores_and_empty_table(spark):
    rng = random.Random(0)
    rows = [(i, [rng.gauss(0, 1) * 10 ** rng.randint(0, 6) for _ in range(5)]) for i in range(50)]
    got = tk.top_k(frame(spark, rows), k=5, modulus=10).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, 5, 10)
    assert tk.top_k(frame(spark, rows).limit(0)).count() == 0
