import random
import re

from assetlake.llm.decontaminate import decontaminate


def words_of(text):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, size=10):
    windows = set()
    for i, text in items:
        w = words_of(text)
        k = min(size, len(w))
        windows |= {(i, tuple(w[s : s + k])) for s in range(len(w) - k + 1) if k}
    out = []
    for i, text in docs:
        w, hit, named = words_of(text), set(), set()
        for item, win in windows:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    named.add(item)
        ids = sorted(str(x) for x in named if x is not None)
        out.append((i, len(w), len(hit), len(ids), ids))
    return sorted(out, key=repr)


def run(spark, assets, docs, items):
    table = spark.createDataFrame(
        [(i, t, "x", 1) for i, t in items], "item_id long, text string, window string, size int"
    )
    return sorted((tuple(r) for r in decontaminate(assets(docs), table).collect()), key=repr)


def test_against_brute_force(spark, assets):
    rng = random.Random(8)
    pool = ["Alpha", "b2", "é", "path", "fill", "mask", "x", "über"]
    text = lambda n: " ".join(rng.choice(pool) + rng.choice(["", ",", "-"]) for _ in range(n))
    items = [(k, text(rng.randint(10, 25))) for k in range(12)]
    items += [(20, None), (21, " ?! "), (22, "rare words here only"), (23, "unseen"), (24, "two words")]
    items += [(3, items[3][1]), (None, items[2][1]), (30, "x x x x x x x x x x"), (100, items[1][1])]
    docs = [(0, ""), (1, None), (2, "?"), (None, items[0][1]), (3, "rare, WORDS here\x00only!")]
    docs += [(4, "say two words twice: two words"), (5, "x " * 40), (6, "rare words here")]
    for i in range(10, 60):
        parts = [text(rng.randint(0, 15)) for _ in range(2)]
        if i % 3:
            source = rng.choice(items)[1] or ""
            parts.insert(1, source[rng.randint(0, 4) :] if i % 2 else source)
        docs.append((i, " ".join(parts)))
    docs += [(11, docs[12][1]), (70, docs[12][1]), (70, docs[12][1])]
    assert run(spark, assets, docs, items) == brute(docs, items)


def test_empty_tables(spark, assets):
    docs = [(1, "some words"), (2, None)]
    assert run(spark, assets, docs, []) == brute(docs, [])
    assert run(spark, assets, docs, [(1, "")]) == brute(docs, [])
    assert run(spark, assets, [], [(1, "some words")]) == []
