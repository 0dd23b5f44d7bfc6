import random
import tracemalloc

import numpy as np
import pyarrow as pa

from assetlake.llm import common, suffix_dedup
from assetlake.llm.suffix_dedup import remove_repeats


def brute(rows, length=50):
    order = lambda i: (1, 0) if i is None else (0, i)
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            first[w] = min(first.get(w, (2, 0)), order(i))
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for s in range(len(data) - length + 1):
            if first[data[s : s + length]] < order(i):
                gone[s : s + length] = [True] * length
        spans, prev = [], False
        for k, g in enumerate(gone):
            if g and not prev:
                spans.append([k, 0])
            if g:
                spans[-1][1] += 1
            prev = g
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), len(spans), kept, tuple(map(tuple, spans))))
    return sorted(out, key=repr)


def got(df):
    return sorted(
        (
            (r.asset_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept),
             tuple((s.start, s.length) for s in r.spans))
            for r in df.collect()
        ),
        key=repr,
    )


def test_against_brute_force(assets):
    rng = random.Random(5)
    words = ["layer", "path", "é", "mask", "fill-rule", "x", "gradient", "größe", "\n"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(20) for _ in range(4)]
    rows = [(0, ""), (1, None), (2, "short"), (None, shared[0]), (3, shared[0][:49])]
    for i in range(4, 60):
        parts = [text(rng.randint(0, 12)), rng.choice(shared), text(rng.randint(0, 12))]
        if rng.random() < 0.4:
            parts[1] = parts[1][rng.randint(0, 30) :]
        rows.append((i, " ".join(parts)))
    rows += [(70, rows[20][1]), (71, rows[20][1]), (5, rows[9][1]), (5, rows[9][1])]
    rows += [(80, "ab" * 200), (81, "a" * 300), (82, "ab" * 40), (83, "a" * 51), (-7, "a" * 50)]
    rows.append((90, "\0" * 120))
    rows.append((91, "\0" * 60))
    assert got(remove_repeats(assets(rows))) == brute(rows)


def test_long_text_and_empty_table(assets):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_500_000))
    rows = [(1, long), (2, "head " + long[700_000:900_000] + " tail")]
    kept = {r.asset_id: bytes(r.kept) for r in remove_repeats(assets(rows)).collect()}
    assert kept[1] == long.encode() and kept[2] in (b"head  tail", b"head tail", b"head  tai", b"head tail")
    assert len(kept[2]) <= 10
    assert remove_repeats(assets([])).count() == 0


def test_covered_window_is_still_a_source(assets):
    """In id 3 other windows cover all of w, yet id 4 must lose it."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = []
    for k in range(0, 100, 5):  # anchors fall differently each time
        u, v = text(200), text(200)
        rows += [(k + 1, u + v[:24]), (k + 2, u[-24:] + v), (k + 3, u + v)]
        rows.append((k + 4, text(80) + u[-25:] + v[:25] + text(80)))
    out = got(remove_repeats(assets(rows)))
    assert out == brute(rows)
    assert all(n >= 50 for i, _, n, *_ in out if i % 5 == 4)


def test_hashes_of_a_part_of_a_batch_are_held_at_once():
    """4 MB of texts take less than 40 MB; with the hashes of 1 MB of them at once it was 92 MB."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 123, 2_000, np.uint8).tobytes() for _ in range(2_000)]
    columns = {"batch": np.zeros(2_000, np.int32), "asset_id": np.arange(2_000), "text": texts}
    dealt = pa.Table.from_batches(list(common._deal(iter([pa.record_batch(columns)]))))
    tracemalloc.start()
    try:
        suffix_dedup._first_ranks(50, 8)(dealt)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40_000_000


def test_freed_memory_is_given_back_after_each_group(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    group = pa.table({"shard": [0], "batch": [0], "keys": [b""], "vals": [None]})
    assert common.lean(lambda table: table)(group) is group and len(given) == 1
    assert common.lean(lambda docs, answers: answers)(None, group) is group and len(given) == 2
