import random

import pytest

from assetlake.llm.mixing import mix_batches

SCHEMA = "asset_id long, batch_id string, text string, size string, place long"


def targets(sizes, weights=(5, 2, 1), limit=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(limit * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        got = {s: limit * sizes[s] if s in full else left * weight[s] / share for s in order}
        over = {s for s in order if s not in full and got[s] > limit * sizes[s]}
        if not over:
            return got
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_takes(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "B", "é", "src10", "src2", "z", "hot"]
    rows = []
    for i in range(300):
        name = "hot" if i % 3 == 0 else rng.choice(names[: 3 + 2 * seed])
        n = rng.choice([0, 1, 5, 40, 2000 if seed == 2 else 60])
        rows.append((i, name, " ".join(["w"] * n) + " \t\n", "clash", 1))
    rows += [(900, "a", None, "", 1), (None, "z", "x y", "", 1), (901, "null only", "", "", 1)]
    rows += [(7, "a", "x y z", "", 1)] * 5 + [(950, "tiny", "one", "", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = mix_batches(df).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, name, text, *_ in rows:
        sizes[name] = sizes.get(name, 0) + len((text or "").split())
    want = targets(sizes)
    taken, parts = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for r in out:
        assert r.source_size == sizes[r.batch_id]
        assert r.target == pytest.approx(want[r.batch_id], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        if r.size:
            assert r.rate == pytest.approx(want[r.batch_id] / sizes[r.batch_id], rel=1e-9)
            assert abs(r.taken - r.rate * r.size) <= r.size
            parts[r.batch_id] += r.taken % r.size > 0
        taken[r.batch_id] += r.taken
    for name, words in taken.items():
        assert abs(words - want[name]) <= 0.5 + 1e-6
        assert parts[name] <= 1
    again = mix_batches(df.repartition(2)).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_empty(spark):
    assert mix_batches(spark.createDataFrame([], SCHEMA)).count() == 0
    out = mix_batches(spark.createDataFrame([(1, "a", None, "", 1), (2, None, " ", "", 1)], SCHEMA))
    assert {(r.taken, r.target) for r in out.collect()} == {(0, 0.0)}
