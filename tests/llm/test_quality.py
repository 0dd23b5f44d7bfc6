import random
import zlib

from pyspark.sql import functions as F

from assetlake.llm.quality import features, score_quality

GOOD = "the layer holds a path with stroke and fill under a mask".split()


def corpus(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        words = [rng.choice(GOOD) for _ in range(rng.randint(5, 40))]
        bad = i % 4 == 0
        if bad:
            how = i // 4 % 3
            words = [[w + "%%%" for w in words], [w.upper() + "!!" for w in words],
                     [w for w in words for _ in range(4)]][how]
        rows.append((i, " ".join(words), int(not bad)))
    df = spark.createDataFrame(rows, "asset_id long, text string, quality int")
    return df.withColumn("label", F.lit("clash")), df.select("asset_id", "quality")


def test_held_out_accuracy_and_no_leak(spark):
    assets, labels = corpus(spark)
    rows = score_quality(assets, labels).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.asset_id).encode()) % 4 == 2) for r in rows)
    right = sum(r.predicted == int(r.asset_id % 4 != 0) for r in held)
    assert right >= 0.95 * len(held) > 50
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    turned = F.pmod(F.crc32(F.col("asset_id").cast("string").cast("binary")), F.lit(4)) == 2
    changed = labels.withColumn("quality", F.when(turned, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {tuple(r) for r in score_quality(assets.withColumn("quality", F.lit(0)), changed).collect()}
    assert again == {tuple(r) for r in rows}


def test_edges(spark):
    assets, labels = corpus(spark)
    extra = spark.createDataFrame(
        [(900, None, 1, "x"), (901, "", 1, "x"), (None, "the path", 1, "x"), (902, "word " * 50000, 1, "x"),
         (903, "the path", 1, "x"), (903, "the path", 1, "x")],
        "asset_id long, text string, quality int, label string",
    )
    more = spark.createDataFrame([(1, None), (None, 1), (1, 7), (777, 1)], "asset_id long, quality int")
    rows = {r.asset_id: r for r in score_quality(assets.unionByName(extra), labels.unionByName(more)).collect()}
    assert rows[900].score == rows[901].score and 0 < rows[900].score < 1
    assert rows[None].score == rows[903].score
    none = score_quality(assets, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert score_quality(assets.limit(0), labels).count() == 0
    assert score_quality(assets, labels, sample=10).count() == 400


def test_features_are_bounded():
    places, amounts = features(("Größe 12 %% " * 1000).encode())
    assert places.max() < 1 << 18 and len(places) < 40 and amounts.max() < 6
    assert len(features(b"")[0]) == 0
