"""Quality and size gates over (original, output) pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as C, constants as K
from ..plans.session import stored
from . import pixels as P


def pair_outputs(
    originals: DataFrame, outputs: DataFrame, by: Sequence[str] = ("batch_id",)
) -> DataFrame:
    """Join outputs to originals of their batch on the name without extension.

    Raster files only. `by` names the columns that hold one folder of either side together; a
    name alone would pair every `image-1` with all others of the corpus.
    """
    raster = ["png", "jpg", "jpeg", "webp", "avif"]
    by = list(by)

    def side(df: DataFrame, role: str) -> DataFrame:
        kept = df.filter(C.file_extension(F.col("name")).isin(raster))
        return kept.select(
            *by,
            C.stem(F.col("name")).alias("base"),
            F.col("asset_id").alias(f"{role}_id"),
            F.col("name").alias(f"{role}_name"),
        )

    joined = side(originals, "original").join(side(outputs, "output"), [*by, "base"])
    return joined.withColumn("format", C.file_extension(F.col("output_name")))


def resolve_thresholds(
    pairs: DataFrame,
    thresholds: DataFrame,
    ssim_default: float = K.SSIM_DEFAULT,
    psnr_default: float = K.PSNR_DEFAULT,
) -> DataFrame:
    """Per-format override, else per-file, else default; a full-name entry hides a base one.

    `thresholds`: file, format (NULL for the whole file), ssim_min, psnr_min. The table grows with
    the corpus and its maps are many times larger than the files they are read from, from which
    Spark guesses their size; so it is merged with the distinct names of the pairs and never
    broadcast. What it has for these names goes to the pairs as Spark sizes it.
    """
    limits = F.struct(F.col("ssim_min").alias("ssim"), F.col("psnr_min").alias("psnr"))
    once = thresholds.groupBy("file", "format").agg(
        F.max("ssim_min").alias("ssim_min"), F.max("psnr_min").alias("psnr_min")
    )
    # One row per file; its map has at most one entry per output format.
    per_file = once.groupBy("file").agg(
        F.max(F.when(F.col("format").isNull(), limits)).alias("whole"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("format").isNotNull(), F.struct("format", limits)))
        ).alias("each"),
    ).select("file", F.struct("whole", "each").alias("limits"))
    names = F.struct("original_name", "base")
    asked = pairs.select(names.alias("_names")).distinct().select(
        "_names",
        F.posexplode(F.array("_names.original_name", "_names.base")).alias("place", "file"),
    )
    # The full name comes first.
    found = asked.join(per_file.hint("merge"), "file").groupBy("_names").agg(
        F.min_by("limits", "place").alias("limits")
    )
    joined = pairs.withColumn("_names", names).join(found, "_names", "left")
    own = F.try_element_at(F.col("limits.each"), F.col("format"))
    return joined.select(
        *pairs.columns,
        F.coalesce(own["ssim"], F.col("limits.whole.ssim"), F.lit(ssim_default)).alias("ssim_min"),
        F.coalesce(own["psnr"], F.col("limits.whole.psnr"), F.lit(psnr_default)).alias("psnr_min"),
    )


def size_gate(
    results: DataFrame,
    baselines: DataFrame,
    overrides: DataFrame | None = None,
    tolerance: float = K.SIZE_TOLERANCE,
) -> DataFrame:
    """Size ceiling per (file, format). No baseline, or one of 0 bytes, skips the check.

    The size compared is the displayed one: KB with one decimal. Of baselines or overrides that
    repeat a (file, format), the last counts if the table says by `ordinal` in which order they
    stand; else the largest does. Configuration texts are read with the last entry of a key.
    """
    key = ["file", "format"]

    def last(table: DataFrame, value: str) -> DataFrame:
        order = "ordinal" if "ordinal" in table.columns else value
        return table.groupBy(*key).agg(F.max_by(value, order).alias(value))

    once = last(baselines, "size_bytes")
    joined = results.join(once, key, "left")
    if overrides is not None:
        joined = joined.join(last(overrides, "tolerance"), key, "left")
    else:
        joined = joined.withColumn("tolerance", F.lit(None).cast("double"))
    ceiling = F.col("size_bytes") * F.coalesce("tolerance", F.lit(tolerance))
    shown = C.size_kb(F.col("size")) * K.BYTES_PER_KB
    skipped = F.coalesce(F.col("size_bytes") <= 0, F.lit(True))
    verdict = F.when(skipped, "skipped").when(shown <= ceiling, "pass").otherwise("fail")
    return joined.select(*results.columns, F.round(ceiling, 2).alias("ceiling"),
                         verdict.alias("verdict"))


def measure_pairs(
    pairs: DataFrame,
    originals: DataFrame,
    outputs: DataFrame,
    window: int = 8,
    cap: int | None = None,
) -> DataFrame:
    """Everything `raster_gate` needs, for all pairs in one job.

    `pairs`: pair_id, original_id, output_id, format, plus columns to keep. Outputs are brought
    to the size of their original, once, in the shared folder. Originals are flattened on black
    where the output is a jpeg, both for the metrics and for their colours. Pairs of which a side
    could not be read keep their row, with null measures. Every pixel counts unless a `cap` asks
    for a sample of the colours.
    """
    jpeg = F.col("format").isin("jpg", "jpeg")
    originals, outputs = P.packed_lines(originals), P.packed_lines(outputs)
    wanted = pairs.select("pair_id", "original_id", "output_id", "format")
    fitted = stored(P.fitted_outputs(wanted, originals, outputs), "fitted")
    sides = P.pair_lines(fitted, originals)
    output_colours = P.line_colors(fitted.withColumnRenamed("pair_id", "asset_id"), cap)
    output_colours = output_colours.withColumnsRenamed(
        {"asset_id": "pair_id", "unique_colors": "output_colors"}
    )
    of_original = P.colour_facts(originals, cap, P.BLACK).drop("luma").withColumnRenamed(
        "asset_id", "original_id"
    )
    return (
        pairs.join(P.quality(sides, window, jpeg), "pair_id", "left")
        .join(output_colours, "pair_id", "left")
        .join(of_original, "original_id", "left")
        .withColumns(
            {
                "original_colors": F.when(jpeg, F.col("flat_colors")).otherwise(F.col("raw_colors")),
                # A flattened original has no transparency left.
                "has_alpha": F.col("has_alpha") & ~jpeg,
            }
        )
        .drop("raw_colors", "flat_colors")
    )


def measure_vector_pairs(
    pairs: DataFrame, originals: DataFrame, outputs: DataFrame, window: int = 8
) -> DataFrame:
    """Everything `svg_gate` needs: similarity and sharpness at the size of the reference.

    Pairs of which a side could not be read keep their row, with null measures.
    """
    originals, outputs = P.packed_lines(originals), P.packed_lines(outputs)
    wanted = pairs.select("pair_id", "original_id", "output_id")
    fitted = stored(P.fitted_outputs(wanted, originals, outputs), "fitted")
    energy = P.edge_energy(fitted.withColumnRenamed("pair_id", "asset_id"))
    sharpness = P.sharpness_ratio(
        wanted.select("pair_id", "original_id", F.col("pair_id").alias("output_id")),
        P.edge_energy(originals),
        energy,
    )
    return pairs.join(
        P.ssim(P.pair_lines(fitted, originals), window), "pair_id", "left"
    ).join(sharpness, "pair_id", "left")


def judged(measured: DataFrame, passed: Column, measures: Sequence[str]) -> DataFrame:
    """Add `passed`, false where a measure is missing, and `error`, which says so."""
    missing = reduce(or_, [F.col(m).isNull() for m in measures])
    return measured.withColumns(
        {
            "passed": F.coalesce(passed, F.lit(False)),
            "error": F.when(missing, K.UNMEASURED_PAIR),
        }
    )


def relaxed(
    minimum: str,
    palette: float,
    transparent: float,
) -> Column:
    """Lower one threshold for palette outputs and for transparent originals sent to webp."""
    paletted = (F.col("original_colors") > K.PALETTE_COLOURS) & (
        F.col("output_colors") <= K.PALETTE_COLOURS
    )
    base = F.when(paletted, F.least(F.col(minimum), F.lit(palette))).otherwise(F.col(minimum))
    see_through = F.coalesce(F.col("has_alpha"), F.lit(False)) & (F.col("format") == "webp")
    return F.when(see_through, F.least(base, F.lit(transparent))).otherwise(base)


def raster_gate(measured: DataFrame) -> DataFrame:
    """Both metrics must reach their (possibly relaxed) minimum; a pair without them fails.

    `measured`: format, ssim, psnr, ssim_min, psnr_min, original_colors, output_colors,
    has_alpha of the original.
    """
    return measured.withColumns(
        {
            "ssim_min": relaxed("ssim_min", K.PALETTE_SSIM, K.TRANSPARENT_SSIM),
            "psnr_min": relaxed("psnr_min", K.PALETTE_PSNR, K.TRANSPARENT_PSNR),
        }
    ).transform(
        judged,
        (F.col("ssim") >= F.col("ssim_min")) & (F.col("psnr") >= F.col("psnr_min")),
        ["ssim", "psnr"],
    )


def svg_gate(
    measured: DataFrame,
    ssim_min: float = K.VECTOR_SSIM,
    sharpness_min: float = K.VECTOR_SHARPNESS,
) -> DataFrame:
    """Both measures must reach their minimum; a pair without them fails."""
    return judged(
        measured,
        (F.col("ssim") >= ssim_min) & (F.col("sharpness_ratio") >= sharpness_min),
        ["ssim", "sharpness_ratio"],
    )


def gate_summary(gates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pairs, failures and the verdict; no pairs at all means the gate is skipped."""
    failures = F.count_if(~F.col("passed"))
    verdict = (
        F.when(F.count("*") == 0, "skipped").when(failures > 0, "failed").otherwise("passed")
    )
    return gates.groupBy(*(by or [])).agg(
        F.count("*").alias("pairs"), failures.alias("failures"), verdict.alias("verdict")
    )
