"""Commented JSON configuration: size baselines, overrides, quality thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import parse_size


def strip_comments(text: Column) -> Column:
    """Drop `//` and `/* */` comments, then collapse white space.

    Like the measured system, `//` counts inside strings too, so values cannot hold URLs.
    """
    lines = F.regexp_replace(text, r"//[^\n]*", "")
    blocks = F.regexp_replace(lines, r"(?s)/\*.*?\*/", "")
    return F.trim(F.regexp_replace(blocks, r"\s+", " "))


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """Whole files; these are hand-written and small."""
    return spark.read.text(path, wholetext=True)


def _entries(configs: DataFrame, text: str) -> DataFrame:
    """(file, body) per top-level key; a malformed text has no entries.

    Of a key that a text repeats, the last entry counts, as in any JSON object.
    """
    table = F.from_json(strip_comments(F.col(text)), "map<string,string>", {"mode": "PERMISSIVE"})
    texts = configs.select(F.monotonically_increasing_id().alias("_text"), table.alias("_table"))
    every = texts.select("_text", F.posexplode("_table"))
    last = every.groupBy("_text", F.col("key").alias("file")).agg(F.max_by("value", "pos").alias("body"))
    return last.select("file", "body")


def _last_of_each(table: Column) -> Column:
    """Entries of a small map, of repeated keys the last."""
    entries = F.map_entries(table)
    keys = F.map_keys(table)
    return F.filter(
        entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"])
    )


def baselines_from(configs: DataFrame, text: str = "value") -> DataFrame:
    """(file, format, size_bytes). A bare string stands for format svg."""
    by_format = F.from_json("body", "map<string,string>")
    bare = F.create_map(F.lit("svg"), F.col("body"))
    table = F.when(F.startswith("body", F.lit("{")), by_format).otherwise(bare)
    return (
        _entries(configs, text)
        .select("file", F.inline(_last_of_each(table)).alias("format", "size"))
        .select("file", "format", parse_size(F.col("size")).alias("size_bytes"))
    )


def overrides_from(configs: DataFrame, text: str = "value") -> DataFrame:
    """(file, format, tolerance)."""
    table = F.from_json("body", "map<string,double>")
    return _entries(configs, text).select(
        "file", F.inline(_last_of_each(table)).alias("format", "tolerance")
    )


def thresholds_from(configs: DataFrame, text: str = "value") -> DataFrame:
    """(file, format or NULL, ssim_min, psnr_min); keys starting with `_` are dropped."""
    limit = "ssimMin: double, psnrMin: double"
    schema = f"struct<ssimMin: double, psnrMin: double, formats: map<string, struct<{limit}>>>"
    rows = (
        _entries(configs, text)
        .filter(~F.startswith("file", F.lit("_")) & F.startswith("body", F.lit("{")))
        .select("file", F.from_json("body", schema).alias("t"))
    )
    # One list per file: its own limits first, then those of each format.
    own = F.array(
        F.struct(
            F.lit(None).cast("string").alias("format"),
            F.col("t.ssimMin").alias("ssim_min"),
            F.col("t.psnrMin").alias("psnr_min"),
        )
    )
    each = F.transform(
        _last_of_each(F.col("t.formats")),
        lambda e: F.struct(
            e["key"].alias("format"),
            e["value"]["ssimMin"].alias("ssim_min"),
            e["value"]["psnrMin"].alias("psnr_min"),
        ),
    )
    listed = rows.select("file", F.inline(F.when(each.isNull(), own).otherwise(F.concat(own, each))))
    return listed.filter("format is not null or ssim_min is not null or psnr_min is not null")


def load_baselines(spark: SparkSession, path: str) -> DataFrame:
    return baselines_from(read_configs(spark, path))


def load_overrides(spark: SparkSession, path: str) -> DataFrame:
    return overrides_from(read_configs(spark, path))


def load_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return thresholds_from(read_configs(spark, path))
