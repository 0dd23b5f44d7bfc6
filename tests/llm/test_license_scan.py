import random
import re

from assetlake.llm.license_scan import (
    NOTICES,
    Notice,
    Scanner,
    license_summary,
    scan_licenses,
    scan_text,
)

BASE = {
    "mit": ["under", "the", "mit", "license"],
    "apache-2": ["apache", "license", "version", "2"],
    "cc-by-nc": ["cc", "by", "nc"],
}


def words_of(text):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    words = words_of(text)
    at = [
        (i, label)
        for label, phrase in BASE.items()
        for i in range(len(words))
        if words[i : i + len(phrase)] == phrase
    ]
    places = [i for i, _ in at]
    return (
        len(words), len(at), min(places, default=None), max(places, default=None),
        ",".join(sorted({label for _, label in at})),
    )


def test_base_against_brute_force(assets):
    rng = random.Random(3)
    bits = ["Under the", "MIT", "license", "licensE,", "Apache License, Version", "2.0", "2", "CC",
            "by-NC", "cc by nc", "é", "mit", "under", "the", "x_y", "\n", "version2"]
    rows = [(0, ""), (1, None), (2, "!!"), (None, "CC BY-NC 4.0"), (3, "under the mit license " * 9000)]
    rows += [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(1, 60)))) for i in range(4, 200)]
    rows += [(9, rows[12][1])] * 2
    got = license_summary(scan_licenses(assets(rows))).collect()
    keys = [(r.asset_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got]
    assert sorted(keys, key=repr) == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    for r in got:
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1 or not r.n_base)
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))


def test_errors_and_spans(assets):
    rows = [
        (1, "Published under the MIT licence."), (2, "apache licens version 2"), (3, "under the mpl license"),
        (4, "gnu general pubic licence, version 3"), (5, "apache license version 1"),
        (6, "underthe mit license"), (7, "on top of the mit building"), (8, "under the bsd licence"),
        (10, "under the mjt license"), (11, "apache license version 2"), (12, "apache license version 3"),
        (9, "GNU general public license version 2 and GNU general public license version 3"),
    ]
    out = {r.asset_id: r for r in scan_licenses(assets(rows)).collect()}
    labels = {i: sorted({s.label for s in r.spans}) for i, r in out.items()}
    assert labels == {
        1: ["mit"], 2: ["apache-2"], 3: [], 4: ["gpl-3"], 5: [], 6: ["mit"], 7: [], 8: ["bsd"],
        9: ["gpl-2", "gpl-3"], 10: ["mit"], 11: ["apache-2"], 12: [],
    }
    span = out[1].spans[0]
    assert (span.first_word, span.n_words, span.errors, span.base) == (1, 4, 1, False)
    assert scan_licenses(assets([])).count() == 0


def test_seeds_miss_no_match():
    """Any text within the bound of errors holds a seed at its place."""
    rng = random.Random(7)
    notice = Notice("mit", "under the mit license", 3)
    scanner = Scanner([notice])
    for _ in range(300):
        text = list("under the mit license")
        for _ in range(rng.randint(0, 3)):
            at, how = rng.randrange(len(text)), rng.randrange(3)
            text[at : at + (how < 2)] = ["z"] * (how > 0)
        noisy = "so it is " + "".join(text).strip() + " here"
        assert scanner.matches(b" " + " ".join(noisy.split()).encode() + b" ")


def test_notices_are_told_apart():
    assert {n.label for n in NOTICES if n.base} == set(BASE)


def test_adjacent_notices(assets):
    """A better match that lacks the license's own words must not hide a worse one before it."""
    two, three = "gnu general public license version 2", "gnu genral publc license version 3"
    rows = [(1, f"the {three} and {two} here"), (2, f"the {two} and {three} here")]
    rows.append((3, "gnu genral public license version 3 gnu general public license version 3"))
    out = {r.asset_id: r.spans for r in scan_licenses(assets(rows)).collect()}
    assert [(s.label, s.first_word) for s in out[1]] == [("gpl-3", 1), ("gpl-2", 8)]
    assert [(s.label, s.first_word) for s in out[2]] == [("gpl-2", 1), ("gpl-3", 8)]
    assert [(s.first_word, s.errors) for s in out[3] if s.label == "gpl-3"] == [(0, 1), (6, 0)]


def test_overlap_with_a_span_far_back():
    """A span counts against later ones of its label, however many other labels stand between."""
    notices = [Notice("long", "a b c d e f g h", base=True), *(
        Notice(f"n{k}", x, base=True) for k, x in enumerate("bcdefg")
    ), Notice("long", "g h i jkl", 1)]
    spans = scan_text(Scanner(notices), b"a b c d e f g h i jkm")[2]
    assert [(s["label"], s["first_word"]) for s in spans] == [("long", 0)] + [
        (f"n{k}", k + 1) for k in range(6)
    ]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_spans_against_brute_force():
    """All spans of whole words, judged by edit distance."""
    rng = random.Random(9)
    notices = [n for n in NOTICES if not n.base]
    for _ in range(150):
        n, parts = rng.choice(notices), []
        for _ in range(rng.randint(1, 3)):
            near = list(rng.choice([n, rng.choice(notices)]).phrase)
            for _ in range(rng.randint(0, n.errors + 1)):
                at, how = rng.randrange(len(near)), rng.randrange(3)
                near[at : at + (how < 2)] = rng.choice("aez 23") * (how > 0)
            parts += ["".join(near), *rng.choices(["and", "2", "gnu", "license", ""], k=2)]
        text = f" {' '.join(' '.join(parts).split())} "
        cuts = [i for i, c in enumerate(text) if c == " "]
        spans = sorted(
            (distance(text[a + 1 : b], n.phrase), a + 1, b)
            for a in cuts
            for b in cuts
            if abs(b - a - 1 - len(n.phrase)) <= n.errors
            and set(n.keys) <= set(text[a + 1 : b].split())
        )
        want = []
        for errors, a, b in spans:
            if errors <= n.errors and all(b <= c or d <= a for c, d, _ in want):
                want.append((a, b, errors))
        got = [f[:3] for f in Scanner([n]).matches(text.encode())]
        assert got == sorted(want), (n, text)
