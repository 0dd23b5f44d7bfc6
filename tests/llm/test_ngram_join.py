import random
import re

import numpy as np
import pyarrow as pa
import pytest

from assetlake.llm import ngram_join as nj


def brute(rows, size, num, den):
    sets = []
    for _, text in rows:
        low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        k = min(size, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) * den >= num * len(a | b):
                root[top(i)] = top(j)
    last = float("inf")
    least = {}
    for i, (asset_id, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), last), last if asset_id is None else asset_id)
    out = [
        (rows[i][0], len(sets[i]), None if least[top(i)] == last else least[top(i)])
        for i in range(len(rows))
    ]
    return sorted(out, key=repr)


def corpus(rng):
    words = [f"W{n}" if n % 9 == 0 else f"w{n}" for n in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows = [(0, ""), (1, None), (2, "  \n"), (3, "one two"), (4, "ONE two"), (5, "one  two three")]
    rows.append((6, "one two"))
    for n in (8, 13, 30, 61, 150, 400):
        base = text(n)
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = text(rng.randint(0, 1))
            rows.append((len(rows), " ".join(copy)))
    shared = text(60)  # a passage in many assets, alike in nothing else
    rows += [(len(rows) + k, " ".join(text(30) + shared + text(30))) for k in range(15)]
    chain = text(80)  # each linked with the next, the ends not with each other
    for k in range(12):
        chain = chain[2:] + text(2)
        rows.append((len(rows) + 40, " ".join(chain)))
    return rows


@pytest.mark.parametrize(("size", "num", "den"), [(4, 85, 100), (5, 4, 5), (1, 1, 2), (1, 1, 3)])
def test_against_brute_force(assets, size, num, den):
    rows = corpus(random.Random(size))
    rows += [(900, rows[20][1]), (900, rows[20][1]), (900, rows[50][1]), (None, rows[30][1]), (None, "lone words here")]
    got = nj.ngram_join(assets(rows), size, num, den).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, size, num, den)


def test_sets_of_very_different_sizes(assets):
    """At 1/3 a set is linked with one three times as large that holds it, and with none larger."""
    words = [f"w{n}" for n in range(300)]
    rows = [(k, " ".join(words[: 30 + 15 * k])) for k in range(10)]
    rows.append((20, " ".join(f"v{n}" for n in range(40))))
    rows.append((21, " ".join(f"v{n}" for n in range(120))))
    rows.append((22, " ".join(f"v{n}" for n in range(361))))
    got = nj.ngram_join(assets(rows), 1, 1, 3).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, 1, 1, 3)


def test_tiles_compared_in_full(assets, monkeypatch):
    """Blocks of three, and the extreme members of tiles seldom linked."""
    monkeypatch.setattr(nj, "BLOCK", 3)
    rng = random.Random(3)
    base = [f"t{n}" for n in range(70)]
    rows = []
    for k in range(60):
        copy = list(base)
        for at in rng.sample(range(70), 3):
            copy[at] = f"x{rng.randrange(40)}"
        rows.append((k, " ".join(copy)))
    got = nj.ngram_join(assets(rows), 1, 9, 10).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, 1, 9, 10)


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(1)
    for n, m in ((3, 3), (40, 47), (300, 340), (5000, 4200)):
        pool = np.unique(rng.integers(0, 2**63, 6000).astype(np.uint64))
        a, b = (np.sort(rng.choice(pool, k, replace=False)) for k in (n, m))
        both = len(np.intersect1d(a, b))
        bound = nj.overlap_bound(nj._bitmap(a), nj._bitmap(b), n, m)
        assert both <= bound <= min(n, m)


@pytest.mark.parametrize(("num", "den"), [(85, 100), (4, 5), (1, 2), (1, 3), (1, 5)])
def test_linked_sets_share_a_tile(num, den):
    rng = np.random.default_rng(2)
    for n in list(range(1, 60)) + [200, 1000, 4000]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            both = int(rng.integers(1, len(a) + 1))
            least = -(-num * len(a) // den)
            both = max(both, least)
            extra = (both * den - num * len(a)) // num
            b = np.unique(np.r_[a[:both], rng.integers(0, 2**64, max(0, extra), dtype=np.uint64)])
            inter = len(np.intersect1d(a, b))
            if den * inter >= num * (len(a) + len(b) - inter):
                x, y = nj._tile_keys(a, num, den), nj._tile_keys(b, num, den)
                assert len(np.intersect1d(x, y))


@pytest.mark.parametrize(("num", "den"), [(85, 100), (4, 5), (1, 2), (1, 3)])
def test_linked_sets_keep_a_common_tile(num, den):
    """However often other sets have the tiles."""
    rng = np.random.default_rng(4)
    for n in [*range(1, 40), 100, 146, 219, 700, 2500]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            both = int(rng.integers(-(-num * len(a) // den), len(a) + 1))
            extra = int(rng.integers(0, (both * den - num * len(a)) // num + 1))
            b = np.unique(np.r_[a[:both], rng.integers(0, 2**64, extra, dtype=np.uint64)])
            x, y = nj._tile_keys(a, num, den), nj._tile_keys(b, num, den)
            shared = np.unique(np.r_[np.intersect1d(x, y), x[::3], y[::4]])
            held = rng.integers(2, 9, len(shared)).astype(np.uint8)
            x, y = (nj._kept_tiles(s, num, den, shared, held) for s in (a, b))
            assert len(np.intersect1d(x, y))


def test_common_words_make_no_tiles(assets, monkeypatch):
    """Sets that have few hashes in common are not brought together by these."""
    rows, counts, write = [], {}, nj.settled

    def counted(df, label, *more):
        out = write(df, label, *more)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(nj, "settled", counted)
    for k in range(60):
        rows.append((k, " ".join([f"c{n}" for n in range(60)] + [f"u{k}x{n}" for n in range(90)])))
    rows.append((99, rows[7][1] + " more"))
    got = nj.ngram_join(assets(rows), 1, 4, 5).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, 1, 4, 5)
    # the two copies have at most all their tiles, in two bands, in common
    assert counts["tiles"] <= 2 * 2 * 100


def test_blocks_are_judged_by_whole_bitmaps():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 900).astype(np.uint64)
    sets = [np.sort(np.r_[base[:640], rng.integers(0, 2**63, 100).astype(np.uint64)]) for _ in range(9)]
    bits = [nj._bitmap(s) for s in sets]
    sketch = [nj._folded(b, nj._sketch_bytes(len(b)) // 8).tobytes() for b in bits]
    one = [1] * len(sets)
    run = pa.table(
        {"tile": one, "low": one, "high": one, "block": one, "label": range(9), "node": range(9)}
        | {"n": [len(s) for s in sets], "mine": [[1]] * 9, "bits": bits, "sketch": sketch}
    )
    allowed = [
        (i, j)
        for i in range(9)
        for j in range(i)
        if nj.overlap_bound(bits[i], bits[j], 740, 740) * 185 >= 85 * 1480
    ]
    rough = nj.overlap_bound(sketch[0], sketch[1], 740, 740) * 185 >= 85 * 1480
    assert rough and not allowed and not list(nj._compared(run, 85, 100))


def test_empty_table(assets):
    assert nj.ngram_join(assets([])).count() == 0
