"""Ordered operators give the same rows however the groups are cut."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

from assetlake.operators import naming
from assetlake.operators.naming import unique_names
from assetlake.operators.packing import greedy_pack
from assetlake.operators.ranking import next_task, priority_rank
from assetlake.plans.ordered import first_per_group, previous_values, running_totals

SLICED = dict(slices=20)


@pytest.fixture(scope="module")
def rows(spark):
    group = F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 5)
    return spark.range(2000).select(
        group.alias("g"), "id", (F.hash("id") % 50).cast("bigint").alias("v"),
        F.when(F.col("id") % 4 == 0, F.col("id")).alias("sparse"),
    ).cache()


def same(a, b):
    assert a.count() == b.count()
    assert a.exceptAll(b.select(a.columns)).isEmpty()


def test_running_totals(rows):
    totals = {"n": F.lit(1).cast("bigint"), "s": F.col("v"), "q": F.col("sparse")}
    order = [F.col("v").desc(), F.col("id")]
    frame = Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    plain = rows.withColumns({name: F.sum(value).over(frame) for name, value in totals.items()})
    for slices in (None, 1, 20):  # 20: a group spans several slices
        same(plain, running_totals(rows, ["g"], order, totals, slices))


def test_previous_values(rows):
    names = {"before": "v", "gap": "sparse"}
    frame = Window.partitionBy("g").orderBy("v", "id")
    plain = rows.withColumns({new: F.lag(c).over(frame) for new, c in names.items()})
    for slices in (None, 1, 20):
        same(plain, previous_values(rows, ["g"], ["v", "id"], names, slices))


def test_first_per_group(rows):
    top = first_per_group(rows, ["g"], [F.col("v"), F.col("id")], 7, salts=3)
    ranked = running_totals(rows, ["g"], [F.col("v"), F.col("id")], {"n": F.lit(1)})
    same(top, ranked.filter("n <= 7").drop("n"))


def walk(rows, max_files, max_bytes):
    taken, files, used = set(), {}, {}
    for batch, at, size in rows:
        n, total = files.get(batch, 0), used.get(batch, 0)
        if n >= max_files or total >= max_bytes or total + size > max_bytes:
            continue
        files[batch], used[batch] = n + 1, total + size
        taken.add((batch, at, size, n + 1, total + size))
    return taken


@pytest.mark.parametrize("caps", [(200, 3000, 20), (1000, 9000, 100), (30, 100000, 200), (5, 0, 9)])
def test_greedy_pack(spark, caps):
    random.seed(sum(caps))
    rows = [(random.choice("aaab"), i, random.choice([0, 1, 5, 50, 200, 900])) for i in range(2000)]
    df = spark.createDataFrame(rows, "batch_id string, ordinal int, size bigint")
    packed = greedy_pack(df.withColumn("status", F.lit("success")), ["ordinal"], *caps)
    assert {tuple(r) for r in packed.collect()} == walk(rows, *caps[:2])


def names_one_by_one(rows):
    used, out = set(), {}
    for batch, at, base, ext in sorted(rows, key=lambda r: r[1]):
        n, name = 1, f"{base}.{ext}"
        while (batch, name) in used:
            n += 1
            name = f"{base}-{n}.{ext}"
        used.add((batch, name))
        out[at] = name
    return out


BASES = ["a", "a-2", "a-3", "a-2-2", "a-4", "b", "b-2", "a-02", "c-1", "", "-2", "a-2-3", "a-5", "a-6"]


def check_names(spark, rows, **limits):
    df = spark.createDataFrame(rows, "batch_id string, ordinal int, base string, ext string")
    named = unique_names(df, **limits).collect()
    assert {r.ordinal: r.export_name for r in named} == names_one_by_one(rows)


@settings(max_examples=6, deadline=None)
@given(
    st.lists(
        st.tuples(st.sampled_from("xy"), st.sampled_from(BASES), st.sampled_from(["png", "jpg"])),
        min_size=1, max_size=150,
    )
)
def test_unique_names(spark, picks):
    check_names(spark, [(b, i, base, ext) for i, (b, base, ext) in enumerate(picks)])


def test_unique_names_sliced(spark):
    random.seed(3)
    rows = [("x", i, random.choice(BASES), "png") for i in range(400)]
    check_names(spark, rows, slices=7)


@pytest.mark.parametrize("depth", [8, 64])
def test_chains_of_suffixes(spark, monkeypatch, depth):
    """Whether a-2-2-2 gets its own name hangs on a-2-2, and so on: rounds grow with the logarithm."""
    checkpoints = []
    real = naming.durable
    monkeypatch.setattr(naming, "durable", lambda df: checkpoints.append(1) or real(df))
    rng = random.Random(depth)
    chain = ["a" + "-2" * k for k in range(depth)]
    rows = []
    for batch in ("down", "up", "twice", "mixed"):
        picks = {"down": chain, "up": chain[::-1], "twice": sorted(chain * 2, key=len)}.get(batch)
        for base in picks or [rng.choice(chain) for _ in range(3 * depth)]:
            rows.append((batch, len(rows), base, "png"))
    check_names(spark, rows)
    assert len(checkpoints) <= 9 + depth.bit_length()


def test_many_numbered_names(spark):
    """The pattern of the registered query: one base and many that look like its numbers."""
    rows = []
    for i in range(600):
        key = i % 40
        base = "img" if key < 20 else "img-2-2" if key < 25 else f"img-{i // 40}"
        rows.append(("x", i, base, "png"))
    check_names(spark, rows)


def test_priority(spark):
    items = spark.createDataFrame(
        [("b", 1, 50, True, "pending"), ("b", 2, 10, False, "pending"), ("b", 3, 40, True, "pending"),
         ("b", 4, 40, True, "pending"), ("b", 5, 1, True, "error")],
        "batch_id string, ordinal int, original_size bigint, visible boolean, status string",
    )
    ranks = {r.ordinal: r.queue_rank for r in priority_rank(items).collect()}
    assert ranks == {3: 1, 4: 2, 1: 3, 2: 4}
    assert {r.ordinal: r.queue_rank for r in priority_rank(items, **SLICED).collect()} == ranks
    by_order = {r.ordinal: r.queue_rank for r in priority_rank(items, small_first=False).collect()}
    assert by_order == {1: 1, 3: 2, 4: 3, 2: 4}
    assert next_task(items).first()["ordinal"] == 3
