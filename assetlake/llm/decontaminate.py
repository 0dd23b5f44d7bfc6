"""Words of assets that stand in a benchmark, by a prefix-filtered set join.

A window of an item is a set of shingles, all of which an asset must hold for the window to occur
in it. Shingles are ordered by rarity, counted over all assets, and only the rarest of a window,
its necessary prefix, is joined. Its place in the asset and in the window says where the window
would begin; windows that would stick out at either end go, the others are compared word for word.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import broadcast_if_small, settled

WINDOW = 10
SHINGLE = 3

_UPPER = "".join(map(chr, range(65, 91)))
_OTHER = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def words_of(text: Column) -> Column:
    """Words of ASCII letters, digits and all non-ASCII characters, A-Z lower-cased."""
    plain = F.translate(
        F.coalesce(text, F.lit("")), _UPPER + _OTHER, _UPPER.lower() + " " * len(_OTHER)
    )
    return F.array_remove(F.split(plain, " "), "")


def _shingles(size: int) -> Column:
    """Hashes of the runs of `size` words of the column `words`, in their order."""
    at = F.sequence(F.lit(0), F.size("words") - size)
    hashes = F.transform(at, lambda i: F.xxhash64(*(F.col("words")[i + k] for k in range(size))))
    return F.when(F.size("words") >= size, hashes).otherwise(F.array().cast("array<bigint>"))


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, window, size) for each window of each item; `window` is its words in a row."""
    words = items.select("item_id", words_of(F.col("text")).alias("words")).filter(
        F.size("words") > 0
    )
    size = F.least(F.size("words"), F.lit(window))
    starts = F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size")))
    return (
        words.withColumn("size", size)
        .select("*", starts.alias("start"))
        .select(
            "item_id",
            F.slice("words", F.col("start") + 1, F.col("size")).alias("words"),
            "size",
        )
        .withColumn("window", F.array_join("words", " "))
        .distinct()
    )


def decontaminate(assets: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Which words of each asset lie in an occurrence of a benchmark window.

    assets: `asset_id`, `text`. items: `item_id`, `text`. Other columns are ignored. A window is
    `window` consecutive words of an item; an item of fewer words, but not none, is one window.

    Returns one row per row of assets: `asset_id`, `n_words`, `n_hit` (words in an occurrence of
    a window), `n_items` (items with occurring windows), `items` (their ids as text, sorted).

    Null text has no words and no windows. Items without an id hit words but are not listed.
    Repeated items count once, repeated rows of assets come out alike. Null asset ids are kept.
    Empty assets: no rows; empty items: nothing is hit.
    """
    docs = assets.select(
        F.col("asset_id").cast("long").alias("asset_id"),
        "text",
        F.xxhash64("asset_id", "text").alias("row_key"),
    )
    windows = settled(_windows(items, window), "windows")
    distinct = windows.select("window", "words", "size").distinct()
    # few sizes: all windows of SHINGLE words or more share one
    sizes = [
        row[0]
        for row in distinct.select(F.least("size", F.lit(SHINGLE)).alias("s")).distinct().collect()
    ]
    tokens = None
    for size in sorted(sizes):
        whole = F.col("size") == size if size < SHINGLE else F.col("size") >= size
        some = distinct.filter(whole).select(
            "window",
            "size",
            F.lit(size).alias("shingle"),
            F.posexplode(_shingles(size)).alias("offset", "token"),
        )
        tokens = some if tokens is None else tokens.unionByName(some)
    base = docs.select("row_key", "asset_id", words_of(F.col("text")).alias("words"))
    if tokens is None:
        return base.select(
            "asset_id",
            F.size("words").cast("long").alias("n_words"),
            F.lit(0).cast("long").alias("n_hit"),
            F.lit(0).cast("long").alias("n_items"),
            F.array().cast("array<string>").alias("items"),
        )
    tokens = settled(tokens, "tokens")
    wanted = broadcast_if_small(tokens.select("shingle", "token").distinct())
    places = None
    for size in sorted(sizes):
        runs = base.select("row_key", F.posexplode(_shingles(size)).alias("place", "token"))
        runs = runs.withColumn("shingle", F.lit(size))
        places = runs if places is None else places.unionByName(runs)
    places = settled(places.join(wanted, ["shingle", "token"]), "places")
    rarity = places.groupBy("shingle", "token").agg(F.count("*").alias("held"))
    # a window with a token that no asset holds occurs nowhere
    ranked = tokens.join(rarity, ["shingle", "token"], "left")
    prefix = (
        ranked.groupBy("window", "size")
        .agg(
            F.min_by(
                F.struct("shingle", "token", "offset"), F.struct(F.coalesce("held", F.lit(0)), "offset")
            ).alias("p"),
            F.min(F.coalesce("held", F.lit(0))).alias("held"),
        )
        .filter("held > 0")
        .select("window", "size", "p.*")
    )
    begins = F.col("place") - F.col("offset")
    candidates = (
        places.join(broadcast_if_small(prefix), ["shingle", "token"])
        .filter(begins >= 0)
        .groupBy("row_key")
        .agg(F.collect_set(F.struct(begins.alias("start"), "size", "window")).alias("candidates"))
    )
    stands = lambda c: (
        (c["start"] + c["size"] <= F.size("words"))
        & (F.array_join(F.slice("words", c["start"] + 1, c["size"]), " ") == c["window"])
    )
    none = F.array().cast("array<struct<start:int,size:int,window:string>>")
    found = (
        docs.join(candidates, "row_key", "left")
        .select(
            "row_key",
            "asset_id",
            words_of(F.col("text")).alias("words"),
            F.coalesce("candidates", none).alias("candidates"),
        )
        .select(
            "row_key",
            "asset_id",
            F.size("words").cast("long").alias("n_words"),
            F.filter("candidates", stands).alias("hits"),
        )
    )
    spans = F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))
    found = settled(
        found.select(
            "row_key",
            "asset_id",
            "n_words",
            F.size(F.array_distinct(F.flatten(spans))).cast("long").alias("n_hit"),
            F.array_distinct(F.transform("hits", lambda h: h["window"])).alias("windows"),
        ),
        "hits",
    )
    listed = windows.filter("item_id is not null").select(
        "window", F.col("item_id").cast("string").alias("item")
    )
    named = (
        found.select("row_key", F.explode("windows").alias("window"))
        .distinct()
        .join(broadcast_if_small(listed), "window")
        .groupBy("row_key")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return found.join(named, "row_key", "left").select(
        "asset_id",
        "n_words",
        "n_hit",
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
