import math
import random
import re
import zlib
from collections import Counter

from assetlake.llm.lm_scoring import lm_score


def brute(rows, weight):
    def tokens(text):
        low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]

    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    words, arcs = Counter(), Counter()
    for (_, text), out in zip(rows, held):
        if not out:
            t = tokens(text)
            words.update(t)
            arcs.update(zip(t, t[1:]))
    n, v = sum(words.values()), len(words)
    result = []
    for (i, text), out in zip(rows, held):
        t, base, score = tokens(text), 0.0, 0.0
        for before, w in zip(["", *t], t):
            p = (words[w] + 1) / (n + v + 1)
            base += math.log10(p)
            state = words[before] if before != "" else 0
            score += math.log10((arcs[before, w] + weight * p) / (state + weight))
        known = sum(words[w] > 0 for w in t)
        result.append((i, out, len(t), known, n, round(base, 6), round(score, 6)))
    return sorted(result, key=repr)


def test_against_brute_force(assets):
    rng = random.Random(1)
    words = ["Layer", "path", "é", "mask", "x", "STROKE", "größe", "\n", "a b"]
    rows = [(0, ""), (1, None), (2, " \n "), (None, "path path"), (5, "onlyhere")]
    rows += [
        (i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(6, 90)
    ]
    rows += [(9, rows[8][1]), (9, rows[8][1]), (95, "word " * 60000)]
    got = [
        (*tuple(r)[:5], round(r.base_score, 6), round(r.score, 6))
        for r in lm_score(assets(rows), weight=30.0).collect()
    ]
    assert sorted(got, key=repr) == brute(rows, 30.0)


def test_probabilities_of_a_state_sum_to_one(assets):
    text = "fill stroke fill mask fill stroke fill"
    rows = [(0, text)]
    ends = [w for w in ("fill", "stroke", "mask", "unknown")]
    scored = [*rows, *[(k, f"fill {w}") for k, w in zip((29, 44, 57, 60), ends)]]
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:5]
    scored = [rows[0], *[(i, t) for i, t in zip(held, ["fill", *[f"fill {w}" for w in ends]])]]
    out = {r.asset_id: 10**r.score for r in lm_score(assets(scored), weight=2.0).collect()}
    first = out[held[0]]  # p(fill) p(end | fill)
    total = first
    after = {"fill": 4, "stroke": 2, "mask": 1}
    for i, w in zip(held[1:], ends):
        p_end = {k: v for k, v in (("n", 8), ("v", 4))}
        root_end = 2 / (p_end["n"] + p_end["v"] + 1)
        arc = 1 if w == "fill" else 0
        total += out[i] / ((arc + 2.0 * root_end) / (after.get(w, 0) + 2.0))
    p_fill = 5 / 13
    assert abs(total - p_fill) < 1e-9


def test_nothing_to_learn_from_and_empty_table(assets):
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm_score(assets([(held, "a b")])).first()
    assert (row.n_known, row.train_tokens, row.base_score) == (0, 0, 0.0)
    assert lm_score(assets([])).count() == 0


def test_longer_contexts(assets):
    """States of two and three words, down to the root one failure arc at a time."""
    rng = random.Random(4)
    words = ["layer", "path", "mask", "x"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows.append((61, "never seen path mask"))
    tokens = [[*t.split(), None] for _, t in rows]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    grams = Counter()
    for t, out in zip(tokens, held):
        if not out:
            grams.update(tuple(t[a:b]) for b in range(1, len(t) + 1) for a in range(b))
    n = sum(c for g, c in grams.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in grams)

    def p(context, w):
        if not context:
            return (grams[(w,)] + 1) / (n + v + 1)
        return (grams[(*context, w)] + 5 * p(context[1:], w)) / (grams[context] + 5)

    for order in (1, 3, 4):
        out = {r.asset_id: r.score for r in lm_score(assets(rows), weight=5.0, order=order).collect()}
        for (i, _), t in zip(rows, tokens):
            want = sum(math.log10(p(tuple(t[max(0, k - order + 1) : k]), w)) for k, w in enumerate(t))
            assert abs(out[i] - want) < 1e-6
