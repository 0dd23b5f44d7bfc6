"""Merkle manifest of a set of assets, and proofs that climb it in a recursive query.

Each asset is a leaf: a digest of some of its fields. The leaves of a group (a language, by default)
are ordered by id; runs of eight consecutive nodes become their parent, level by level, up to one
subroot per group. The subroots, ordered by group, grow into the root of the manifest the same way.

Built levels are stored as node rows that are linked to their parents by key: (tree, level, block).
Up to level `SHARED` a block is the place of a node in its level. Above it a node has one row for
each block of that level below it, so that no row is the parent of more than `FAN**SHARED` leaves and
the climb has no hot key at the top of a tree. A recursive query ascends from the leaves: each step
meets the row of its node, appends its siblings to the proof and folds them with the hash that
came up. The leaves of one run share every sibling but those among themselves and climb in one row;
each leaf's hash is folded on its own. A node without a row is the root, where the climb ends.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.ordered import ranked
from .common import broadcast_if_small, settled

FIELDS = ("asset_id", "batch_id", "lang", "n_chars", "text")
#: Children of a node.
FAN = 8
#: Level whose nodes tell the copies of higher nodes apart.
SHARED = 3
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"

_CLIMB = """
WITH RECURSIVE climb (leaves, tree, level, block, folded, proof, subroot, ended) AS (
  SELECT leaves, tree, level, block, folded, CAST(X'' AS BINARY), CAST(NULL AS BINARY), ended
  FROM {runs}
  UNION ALL
  SELECT c.leaves, c.tree, c.level + 1,
    CASE WHEN c.level < {shared} THEN c.block DIV {fan} ELSE c.block END,
    transform(c.folded, f -> unhex(sha2(concat(lower(hex(n.left)), lower(hex(f)), lower(hex(n.right))), 256))),
    concat(c.proof, n.left, n.right), coalesce(c.subroot, n.subroot), n.ended
  FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.level = n.level AND c.block = n.block
)
SELECT leaves, folded, proof, subroot FROM climb WHERE ended
"""


def digest(text: Column) -> Column:
    """sha256 in lower-case hexadecimal digits."""
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(values: Sequence[Column]) -> Column:
    """Digest of field values: `-` for null, else the UTF-8 bytes' count, `:` and the value."""
    texts = [v.cast("string") for v in values]
    parts = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return digest(F.concat(*(F.coalesce(part, F.lit("-")) for part in parts)))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _joined(digests: Column) -> Column:
    """Digests one after the other, as text."""
    return F.array_join(F.transform(digests, _hex), "")


def _without(values: Column, pos: Column) -> tuple[Column, Column]:
    """What stands in front of and behind a place of an array."""
    return F.slice(values, 1, pos), F.slice(values, pos + 2, FAN)


def _run(*names: str) -> Column:
    """Nodes of a run, in order."""
    return F.array_sort(F.collect_list(F.struct("place", *names)))


def _closed(runs: DataFrame) -> DataFrame:
    """Add `digest` of the run and `done`, which marks the sole node of a level."""
    return runs.withColumns(
        {
            "digest": F.unhex(digest(_joined(F.col("kids")["digest"]))),
            "done": (F.col("run") == 0) & (F.size("kids") == 1),  # else run 0 has two or more
        }
    )


def _levels(nodes: DataFrame, *carry: str) -> list[DataFrame]:
    """Runs of each level of trees, from (tree, place, digest): (tree, run, kids, digest, done).

    The runs of the last level are all done. `carry` names columns that the first level keeps.
    """
    levels: list[DataFrame] = []
    while True:
        run = F.expr(f"place DIV {FAN}").alias("run")
        runs = nodes.groupBy("tree", run).agg(_run("digest", *(() if levels else carry)).alias("kids"))
        runs = settled(_closed(runs), f"runs-{len(levels)}")
        levels.append(runs)
        up = runs.filter("NOT done")
        if up.isEmpty():
            return levels
        nodes = up.select("tree", F.col("run").alias("place"), "digest")


def _siblings(levels: Sequence[DataFrame]) -> DataFrame:
    """(tree, level, place, left, right) of nodes that have a parent: the digests beside them."""

    def of(level: int, runs: DataFrame) -> DataFrame:
        kids = runs.filter("NOT done").select("tree", "run", "kids", F.posexplode("kids"))
        left, right = _without(F.col("kids")["digest"], F.col("pos"))
        return kids.select(
            "tree",
            F.lit(level).alias("level"),
            (F.col("run") * FAN + F.col("pos")).alias("place"),
            F.unhex(_joined(left)).alias("left"),
            F.unhex(_joined(right)).alias("right"),
        )

    return reduce(DataFrame.unionByName, [of(k, runs) for k, runs in enumerate(levels)])


def _subroots(levels: Sequence[DataFrame]) -> DataFrame:
    """(tree, height, digest) of the sole node at the top of each tree."""
    return reduce(
        DataFrame.unionByName,
        [
            runs.filter("done").select(
                "tree", F.lit(k).alias("height"), F.col("kids")[0]["digest"].alias("digest")
            )
            for k, runs in enumerate(levels)
        ],
    )


def _nodes(levels: list[DataFrame], trees: DataFrame, tops: list[DataFrame]) -> DataFrame:
    """Node rows above the leaves: (tree, level, block, left, right, subroot, ended).

    levels: of the trees of the groups. trees: (tree, height, digest, rank). tops: levels of the
    tree that grows from their subroots. `ended` marks rows whose parent is the root; the row of a
    subroot holds its digest.
    """
    climbs = len(tops) - 1  # levels from a subroot to the root
    own = _siblings(levels).filter("level > 0").withColumns(
        {
            "subroot": F.lit(None).cast("binary"),
            "ended": F.lit(not climbs) & (F.col("level") == len(levels) - 2),
        }
    )
    low = own.filter(f"level <= {SHARED}").withColumn("block", F.col("place"))
    below = F.pow(F.lit(FAN), F.col("level") - SHARED).cast("long")
    blocks = F.sequence(F.col("place") * below, (F.col("place") + 1) * below - 1)
    high = own.filter(f"level > {SHARED}").withColumn("block", F.explode(blocks))
    columns = ["tree", "level", "block", "left", "right", "subroot", "ended"]
    nodes = low.select(columns).unionByName(high.select(columns))
    if not climbs:
        return nodes
    # the upper tree, from each subroot on
    up = F.explode(F.sequence(F.lit(0), F.lit(climbs - 1))).alias("up")
    way = trees.select("tree", "height", "digest", "rank", up).withColumn(
        "top", F.floor(F.col("rank") / F.pow(F.lit(FAN), F.col("up"))).cast("long")
    )
    above = _siblings(tops).select(
        F.col("level").alias("up"), F.col("place").alias("top"), "left", "right"
    )
    way = way.join(broadcast_if_small(above), ["up", "top"])
    if len(levels) > SHARED:
        last = levels[SHARED - 1].groupBy("tree").agg(F.max("run").alias("last"))
        way = way.join(last, "tree", "left")
    else:
        way = way.withColumn("last", F.lit(0).cast("long"))
    blocks = F.sequence(F.lit(0).cast("long"), F.coalesce("last", F.lit(0).cast("long")))
    way = way.withColumns(
        {
            "level": F.col("height") + F.col("up"),
            "subroot": F.when(F.col("up") == 0, F.col("digest")),
            "ended": F.col("up") == climbs - 1,
            "block": F.explode(blocks),
        }
    )
    return nodes.unionByName(way.select(columns))


def _starts(runs: DataFrame, ended: bool) -> DataFrame:
    """First rows of the climb: the runs of leaves, each leaf folded with the others of its run."""
    digests = F.col("kids")["digest"]

    def fold(kid: Column, i: Column) -> Column:
        left, right = _without(digests, i)
        return F.unhex(digest(F.concat(_joined(left), _hex(kid["claimed"]), _joined(right))))

    alone = F.col("done")
    return runs.select(
        F.col("kids").alias("leaves"),
        "tree",
        F.when(alone, 0).otherwise(1).alias("level"),
        F.col("run").alias("block"),
        F.when(alone, F.col("kids")["claimed"]).otherwise(F.transform("kids", fold)).alias("folded"),
        F.lit(ended).alias("ended"),
    )


@contextmanager
def _any_number_of_rows(spark: SparkSession) -> Iterator[None]:
    """Spark ends a recursive query beyond a number of rows, which a manifest may exceed."""
    before = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ROW_LIMIT)
        else:
            spark.conf.set(ROW_LIMIT, before)


def audit_assets(
    assets: DataFrame,
    claims: Mapping[str, Column] | None = None,
    fields: Sequence[str] = FIELDS,
    group: str = "lang",
) -> DataFrame:
    """Build the manifest of assets and fold each asset's claimed state up to its root.

    assets: `asset_id`, the `group` column and all `fields`; other columns are ignored, whatever
    their names. claims: the values of fields that are held against the manifest, where they differ
    from those it was built of; without any, every asset is verified as it is.

    A leaf is `leaf_digest` of the fields. Per group, leaves ascend by asset_id; while several nodes
    remain, every eight (the last run: fewer, even one) become the digest of their digests, as
    text. Subroots ascend by group, null first, else by UTF-8 bytes, and become the root likewise.

    Returns one row per input row: asset_id, leaf, subroot, root, proof (the digests of all
    siblings, as text, level by level up to the root), folded_root (from the claimed leaf and the
    siblings), verified (folded_root equals root). The rows are written to the shared folder.

    Null fields count as `-` in a leaf, empty texts as a value of no bytes. A null asset_id comes
    first in its group; repeated ids ascend by leaf, so repeated rows have equal leaves side by
    side. A tree of one leaf is that leaf. Texts of any length are hashed whole, in the tasks
    that read them. An empty table gives no rows.
    """
    spark = assets.sparkSession
    claims = claims or {}
    values = [F.col(name) for name in fields]
    claimed = [claims.get(name, F.col(name)) for name in fields]
    same = reduce(lambda a, b: a & b, [a.eqNullSafe(b) for a, b in zip(values, claimed)], F.lit(True))
    leaf = leaf_digest(values)
    # a group's name as text that sorts like the groups; null has none
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = assets.select(
        F.col("asset_id").cast("long").alias("asset_id"),
        tree.alias("tree"),
        F.unhex(leaf).alias("digest"),
        F.unhex(F.when(same, leaf).otherwise(leaf_digest(claimed))).alias("claimed"),
    )
    order = [F.col("asset_id").asc_nulls_first(), F.col("digest"), F.col("claimed")]
    leaves = settled(leaves, "leaves")  # ranking reads them twice
    placed = ranked(leaves, ["tree"], order, "place").withColumn("place", F.col("place") - 1)
    levels = _levels(placed, "claimed", "asset_id")
    trees = ranked(_subroots(levels), [], [F.col("tree")], "rank")
    trees = settled(trees.withColumn("rank", F.col("rank") - 1), "trees")
    tops = _levels(trees.select(F.lit("").alias("tree"), F.col("rank").alias("place"), "digest"))
    top = _subroots(tops).first()
    root = F.lit(top["digest"].hex() if top else None).cast("string")
    nodes = settled(_nodes(levels, trees, tops), "nodes")
    starts = _starts(levels[0], ended=len(tops) == 1 and len(levels) <= 2)
    with _any_number_of_rows(spark):
        climbed = spark.sql(_CLIMB, runs=starts, nodes=nodes, shared=SHARED, fan=FAN)
        climbed = settled(climbed, "climbed", keep=True)
    each = climbed.select("*", F.posexplode("leaves").alias("pos", "kid"))
    left, right = _without(F.col("leaves")["digest"], F.col("pos"))
    folded = _hex(F.col("folded")[F.col("pos")])
    return each.select(
        "kid.asset_id",
        _hex(F.col("kid.digest")).alias("leaf"),
        F.coalesce(_hex(F.col("subroot")), root).alias("subroot"),
        root.alias("root"),
        F.concat(_joined(left), _joined(right), _hex(F.col("proof"))).alias("proof"),
        folded.alias("folded_root"),
        (folded == root).alias("verified"),
    )
