import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlake.llm.language_id import best_path, label_language

WORDS = {
    "en": "the layer with stroke and fill width under path shadow".split(),
    "de": "die ebene mit strich und füllung breite unter pfad schatten".split(),
    "el": "το επίπεδο με γραμμή και γέμισμα πλάτος κάτω".split(),
}


def corpus(spark, extra=()):
    rng = random.Random(4)
    rows = []
    for i in range(90):
        lang = sorted(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 60))), lang))
    rows += extra
    return spark.createDataFrame(rows, "asset_id long, text string, lang string").withColumn(
        "held_out", F.lit("clash")
    )


def test_held_out_and_edges(spark):
    mixed = " ".join(WORDS["en"] * 2 + WORDS["de"] * 2 + ["12", "-"] + WORDS["en"])
    extra = [
        (900, None, "en"), (901, "", None), (902, "12 34 !?", "de"), (903, "½ ² ✓", None),
        (904, mixed, None), (904, mixed, None), (None, "the fill", "en"), (905, "ደብዳቤ", None),
        (906, "🙂🙂", None), (907, "𐐀", None), (908, "the layer " * 30000, None),
        (910, "× ÷ 。、", None), (909, "κάτω γραμμή fill", None),
    ]
    rows = label_language(corpus(spark, extra)).collect()
    assert len(rows) == 90 + len(extra)
    for r in rows:
        assert 0 <= r.score <= 1
        assert r.held_out == (
            r.asset_id is not None and zlib.crc32(str(r.asset_id).encode()) % 5 == 0
        )
        if r.asset_id is not None and r.asset_id < 90:
            assert r.lang_pred == sorted(WORDS)[r.asset_id % 3]
    by_id = {r.asset_id: r for r in rows}
    for i in (900, 901, 902, 903, 906, 910):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[905].lang_pred in WORDS and by_id[907].lang_pred in WORDS
    assert by_id[908].lang_pred == "en" and by_id[908].score == 1.0
    assert by_id[909].lang_pred == "el"
    spans = [(s.lang, s.first_word, s.n_words) for s in by_id[904].spans]
    assert [s[0] for s in spans] == ["en", "de", "en"]
    assert abs(spans[1][1] - 20) <= 1 and spans[2][1] + spans[2][2] == 52


def test_lang_is_no_input(spark):
    docs = corpus(spark)
    held = docs.filter(F.pmod(F.crc32(F.col("asset_id").cast("string").cast("binary")), F.lit(5)) == 0)
    wrong = docs.exceptAll(held).unionByName(held.withColumn("lang", F.lit("de")))
    one, two = ({tuple(r)[:4] for r in label_language(d).collect()} for d in (docs, wrong))
    assert one == two


def test_nothing_to_learn_from(spark):
    docs = corpus(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in label_language(docs).collect()} == {"und"}
    assert label_language(docs.limit(0)).count() == 0


@pytest.mark.parametrize("penalty", [0.0, 0.7, 3.0])
def test_best_path_is_the_best_of_all(penalty):
    rng = np.random.default_rng(int(penalty * 10))
    sizes = np.array([0, 5, 1, 7, 0, 3])
    scores = rng.normal(size=(sizes.sum(), 3)).astype(np.float32)
    path = best_path(scores, sizes, penalty)

    def value(labels, at):
        steps = sum(scores[at + i, k] for i, k in enumerate(labels))
        return steps - penalty * sum(a != b for a, b in zip(labels, labels[1:]))

    for start, size in zip(np.cumsum(sizes) - sizes, sizes):
        if size:
            best = max(value(c, start) for c in itertools.product(range(3), repeat=size))
            assert abs(value(path[start : start + size], start) - best) < 1e-4
