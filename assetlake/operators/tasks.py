"""Queue tables: items, their tasks per format, and results folded back in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import columns as C, constants as K


def expand_tasks(
    items: DataFrame,
    formats: Column,
    use_original: bool | Column = True,
    include_original: bool | Column = False,
    override: str | None = None,
) -> DataFrame:
    """One row per (item, format) in format order. Items in error get no tasks.

    `override` names an array column of formats that replaces the list where it is set.
    """
    wanted = C.format_list(F.col("original_format"), formats, use_original, include_original)
    if override:
        wanted = F.coalesce(F.array_distinct(F.col(override)), wanted)
    return items.filter(F.col("status") != K.ERROR).select(
        *items.columns, F.posexplode(wanted).alias("task_ordinal", "format")
    )


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.PRESETS, K.PRESET_COLUMNS)


def codecs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.CODECS, K.CODEC_COLUMNS)


def preset_lookup(tasks: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Encoder parameters by (content class, format), and `error` where the table has none.

    The default table is the fixed 16-row dimension and is broadcast; Spark sizes any other.
    """
    if table is None:
        table = F.broadcast(presets(tasks.sparkSession))
    known = table.withColumn("_known", F.lit(True))
    return (
        tasks.join(known, ["preset", "format"], "left")
        .withColumn("error", F.when(F.col("_known").isNull(), K.ERR_NO_PRESET))
        .drop("_known")
    )


def encode_plan(
    tasks: DataFrame, table: DataFrame | None = None, vector_safe: bool = False
) -> DataFrame:
    """Parameters an encoder would run with. Needs preset, format, has_alpha, small_transparent.

    A format without an encoder of its own is encoded as webp but keeps its requested name.
    """
    small = F.col("small_transparent")
    rows = tasks.withColumnRenamed("format", "requested_format").withColumn(
        "format", F.when(F.col("requested_format").isin(K.RASTER_FORMATS), F.col("requested_format"))
        .otherwise("webp")
    )
    known = F.col("requested_format").isin(K.RASTER_FORMATS)
    mild_webp = (F.col("format") == "webp") & known & small & F.lit(not vector_safe)
    mild_png = (F.col("format") == "png") & small & (F.col("preset") == "photo")
    return preset_lookup(rows, table).withColumns(
        {
            "quality": F.when(mild_webp, K.WEBP_QUALITY_TRANSPARENT)
            .when(mild_png, K.PNG_MILD_MIN)
            .otherwise(F.col("quality")),
            "quality_max": F.when(mild_png, K.PNG_MILD_MAX).otherwise(F.col("quality_max")),
            "flatten_alpha": (F.col("format") == "jpeg") & F.col("has_alpha"),
            "fallback_preset": F.when(F.col("preset") == "graphic", F.lit("photo")),
        }
    ).withColumnRenamed("format", "encoder")


def pick_codec(formats: DataFrame, registrations: DataFrame) -> DataFrame:
    """First-registered encoder per format.

    Registering an id again keeps its place but replaces its row. Both steps are grouped
    minima and maxima, so only one row per id and per format is shuffled per map task. Any
    format may be registered; Spark sizes the join.
    """
    row = [c for c in registrations.columns if c not in ("seq", "id")]
    current = registrations.groupBy("id").agg(
        F.min("seq").alias("position"), F.max(F.struct("seq", *row)).alias("row")
    )
    chosen = (
        current.filter(F.col("row.encode"))
        .groupBy(F.col("row.format").alias("format"))
        .agg(F.min_by(F.struct("id", "position"), F.struct("position", "id")).alias("codec"))
        .select("format", F.col("codec.id").alias("codec_id"), "codec.position")
    )
    return formats.join(chosen, "format", "left")


def pending_only(items: DataFrame, pending: DataFrame) -> DataFrame:
    return items.join(pending.select("asset_id"), "asset_id", "left_semi")


def remove_items(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(ids.select("asset_id"), "asset_id", "left_anti")


def clear_finished(items: DataFrame) -> DataFrame:
    return items.filter(F.col("status").isin(K.PENDING, K.PROCESSING))


def flag_visible(items: DataFrame, visible: DataFrame) -> DataFrame:
    """Add a boolean: is the item in the visible set?"""
    ids = visible.select("asset_id").distinct().withColumn("_seen", F.lit(True))
    flag = F.coalesce(F.col("_seen"), F.lit(False))
    return items.join(ids, "asset_id", "left").withColumn("visible", flag).drop("_seen")


def merge_outcomes(responses: DataFrame, errors: DataFrame) -> DataFrame:
    """Responses and task errors as one ordered feed; errors come after all responses."""
    ok = F.col("type") == "RESULT"
    first = responses.select(
        "asset_id", "format", "seq", F.lit(0).alias("phase"),
        F.when(ok, K.SUCCESS).otherwise(K.ERROR).alias("status"),
        F.when(ok, F.col("size")).alias("size"),
        F.when(ok, F.col("label")).alias("label"),
        F.when(~ok, F.col("error")).alias("error"),
    )
    second = errors.select(
        "asset_id", "format", "seq", F.lit(1).alias("phase"),
        F.lit(K.ERROR).alias("status"),
        F.lit(None).cast("bigint").alias("size"),
        F.lit(None).cast("string").alias("label"),
        F.lit(K.ERR_WORKER).alias("error"),
    )
    return first.unionByName(second)


def fold_outcomes(outcomes: DataFrame) -> DataFrame:
    """One change per (item, format): the last status, size, label and error that were set.

    Aggregated before the shuffle, so a task that reports very often is still one row.
    """
    status = F.col("status")

    def last(*names: str, where: Column | None = None) -> Column:
        row = F.struct("phase", "seq", *names)
        return F.max(row if where is None else F.when(where, row))

    return (
        outcomes.groupBy("asset_id", "format")
        .agg(
            last("status").alias("any"),
            last("size", "label", where=status == K.SUCCESS).alias("good"),
            last("error", where=status == K.ERROR).alias("bad"),
        )
        .select(
            "asset_id",
            "format",
            F.col("any.status").alias("new_status"),
            F.col("good.size").alias("new_size"),
            F.col("good.label").alias("new_label"),
            F.col("bad.error").alias("new_error"),
        )
    )


def apply_results(results: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Fold outcomes into the results table. Unknown items and formats are ignored."""
    joined = results.join(fold_outcomes(outcomes), ["asset_id", "format"], "left")
    names = ["status", "size", "label", "error"]
    updated = {c: F.coalesce(F.col(f"new_{c}"), F.col(c)) for c in names}
    return joined.withColumns(updated).select(*results.columns)


def latest_result(results: DataFrame, order: list[str]) -> DataFrame:
    """Last write per (item, format); `order` must decide every tie.

    Spark keeps only the last row of each key per map task before it shuffles, so a key that is
    written very often stays small.
    """
    frame = Window.partitionBy("asset_id", "format").orderBy(*[F.col(c).desc() for c in order])
    ranked = results.withColumn("_rn", F.row_number().over(frame))
    return ranked.filter("_rn = 1").drop("_rn")


def result_flags(results: DataFrame) -> DataFrame:
    """Per item: does anything run, did anything fail, bytes of all successful results."""
    status = F.col("status")
    return results.groupBy("asset_id").agg(
        F.bool_or(status.isin(K.PENDING, K.PROCESSING)).alias("any_open"),
        F.bool_or(status == K.ERROR).alias("any_error"),
        F.sum(F.when(status == K.SUCCESS, F.col("size"))).alias("optimized_size"),
    )


def item_status(items: DataFrame, results: DataFrame) -> DataFrame:
    """Item status from its results; unchanged while any is open or none exist."""
    done = ~F.coalesce(F.col("any_open"), F.lit(True))
    status = (
        F.when(~done, F.col("status"))
        .when(F.col("any_error"), F.lit(K.ERROR))
        .otherwise(F.lit(K.SUCCESS))
    )
    progress = F.when(done, F.lit(100)).otherwise(F.col("progress"))
    return (
        items.join(result_flags(results), "asset_id", "left")
        .withColumns({"progress": progress, "status": status})
        .select(*items.columns, F.coalesce("optimized_size", F.lit(0)).alias("optimized_size"))
    )


def reapply_options(
    items: DataFrame,
    results: DataFrame,
    formats: Column,
    use_original: bool = True,
    include_original: bool = False,
    force_all: bool = False,
    ids: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """New options: reset pending and processing items (or all, or the given ids).

    Returns the items and the results. Reset items lose their results and get one pending
    result per format; all others keep theirs.
    """
    if ids is not None:
        chosen = flag_visible(items, ids).withColumnRenamed("visible", "reset")
    elif force_all:
        chosen = items.withColumn("reset", F.lit(True))
    else:
        chosen = items.withColumn("reset", F.col("status").isin(K.PENDING, K.PROCESSING))
    new_items = chosen.withColumns(
        {
            "status": F.when(F.col("reset"), K.PENDING).otherwise(F.col("status")),
            "progress": F.when(F.col("reset"), 0).otherwise(F.col("progress")),
        }
    )
    wanted = C.format_list(F.col("original_format"), formats, use_original, include_original)
    fresh = new_items.filter("reset").select(
        "asset_id", F.explode(wanted).alias("format"), F.lit(K.PENDING).alias("status")
    )
    if force_all and ids is None:
        kept = results.filter(F.lit(False))
    else:
        kept = results.join(chosen.filter("reset").select("asset_id"), "asset_id", "left_anti")
    return new_items.select(*items.columns), kept.unionByName(fresh, allowMissingColumns=True)


def nested_results(results: DataFrame) -> DataFrame:
    """Results as one map per item: format -> struct.

    One row per item holds at most one entry per output format, a short fixed list.
    """
    rest = [c for c in results.columns if c not in ("asset_id", "format")]
    entry = F.struct("format", F.struct(*rest).alias("result"))
    return results.groupBy("asset_id").agg(
        F.map_from_entries(F.collect_list(entry)).alias("results")
    )
