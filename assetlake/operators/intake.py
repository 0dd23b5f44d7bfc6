"""From files and archive members to queue items."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as C, constants as K


def with_names(assets: DataFrame, name: str = "name") -> DataFrame:
    """Add extension and MIME type."""
    extension = C.file_extension(F.col(name))
    return assets.withColumns({"extension": extension, "mime": C.mime_type(extension)})


def supported_only(assets: DataFrame, name: str = "name") -> DataFrame:
    """Drop (not flag) files whose extension is not accepted."""
    return assets.filter(C.is_supported(C.file_extension(F.col(name))))


def mime_prefix_filter(assets: DataFrame, prefix: str = "image/", mime: str = "mime") -> DataFrame:
    return assets.filter(C.has_mime_prefix(F.col(mime), prefix))


def size_limit(
    assets: DataFrame, max_bytes: int = K.MAX_FILE_BYTES, max_zip_bytes: int = K.MAX_ZIP_BYTES
) -> DataFrame:
    error = C.size_error(F.col("size"), C.is_archive(F.col("name")), max_bytes, max_zip_bytes)
    return assets.withColumn("error", error)


def intake_verdict(
    assets: DataFrame,
    content: str = "content",
    max_bytes: int = K.MAX_FILE_BYTES,
    extended_magic: bool = False,
) -> DataFrame:
    """Drop unsupported files, then give every other one a status and perhaps an error.

    Name and size are checked before the content column is looked at. `extended_magic` accepts
    more kinds of files by their leading bytes, HEIC among them.
    """
    extension = C.file_extension(F.col("name"))
    rows = assets.withColumn("extension", extension).filter(C.is_supported(F.col("extension")))
    magic = C.magic_match(F.col(content), F.col("extension"), extended=extended_magic)
    error = C.intake_error(F.col("size"), F.col("extension"), magic, max_bytes, extended_magic)
    return rows.withColumn("error", error).withColumn(
        "status", F.when(F.col("error").isNull(), K.PENDING).otherwise(K.ERROR)
    )


def member_verdict(
    members: DataFrame,
    content: str = "content",
    max_bytes: int = K.MAX_FILE_BYTES,
    whole: str | None = None,
) -> DataFrame:
    """The checks for archive members, which differ from those for loose files.

    Empty and `__MACOSX` members go; over-long ones become errors before their type is
    looked at; members of unknown type go; wrong leading bytes become errors. Error rows
    lose their content and have size 0. A row with an error in the column `whole` stands for an
    archive and passes unchecked.
    """
    archive = F.col(whole).isNotNull() if whole else F.lit(False)
    rows = members.filter(
        archive | ((F.col("size") > 0) & ~F.col("member_path").contains("__MACOSX"))
    )
    rows = rows.withColumn("name", F.substring_index("member_path", "/", -1))
    extension = C.file_extension(F.col("name"))
    known = C.mime_type(extension) != K.DEFAULT_MIME
    too_long = F.col("size") > max_bytes
    rows = rows.filter(archive | too_long | known)
    error = F.when(archive, None).when(too_long, F.lit(K.ERR_FILE_LIMIT)).when(
        ~C.magic_match(F.col(content), extension), F.lit(K.ERR_INVALID)
    )
    rows = rows.withColumns({"extension": extension, "error": error})
    bad = F.col("error").isNotNull()
    changed = {
        "status": F.when(bad, K.ERROR).otherwise(K.PENDING),
        "size": F.when(bad, F.lit(0).cast("bigint")).otherwise(F.col("size")),
        content: F.when(~bad, F.col(content)),
    }
    return rows.withColumns(changed)


def archive_totals(members: DataFrame, archive: str = "archive_path") -> DataFrame:
    """Members and bytes per archive, counted before any member is skipped."""
    return members.groupBy(archive).agg(
        F.count("*").alias("members"), F.sum("size").alias("expanded_bytes")
    )


def archive_limits(
    members: DataFrame,
    archive: str = "archive_path",
    max_members: int = K.MAX_ZIP_MEMBERS,
    max_bytes: int = K.MAX_ZIP_EXPANDED_BYTES,
    tie: str = K.ERR_ZIP_COUNT,
) -> tuple[DataFrame, DataFrame]:
    """(members of archives within the limits, one error row per other archive).

    Members have a `position` from 0 in their archive. Of two limits that are exceeded, the one
    names the error that the members cross first, in their order; where one member crosses both,
    `tie` does. The totals are pre-aggregated per map task and joined back, so an archive with a
    huge number of members is never gathered in one task.
    """
    last = max_members - 1 if tie == K.ERR_ZIP_COUNT else max_members
    within = F.when(F.col("position") <= last, F.col("size"))
    totals = members.groupBy(archive).agg(
        F.count("*").alias("members"),
        F.sum("size").alias("expanded_bytes"),
        F.sum(within).alias("bytes_before"),
    )
    over = (F.col("members") > max_members) | (F.col("expanded_bytes") > max_bytes)
    kept = members.join(totals.filter(~over).select(archive), archive, "left_semi")
    before = F.coalesce("bytes_before", F.lit(0))
    by_count = (F.col("members") > max_members) & (before <= max_bytes)
    message = F.when(by_count, K.ERR_ZIP_COUNT).otherwise(K.ERR_ZIP_BYTES)
    rejected = totals.filter(over).select(
        archive,
        "members",
        "expanded_bytes",
        F.lit(K.ERROR).alias("status"),
        F.concat(F.lit(K.ERR_ZIP_PREFIX), message).alias("error"),
    )
    return kept, rejected


def union_intake(*parts: DataFrame) -> DataFrame:
    """Items from files, folders and archives in one frame, error rows included."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first


def pixel_guard(images: DataFrame, max_pixels: int = K.MAX_PIXELS) -> DataFrame:
    """Mark images over the pixel limit; keep an earlier error."""
    found = C.pixel_error(F.col("width"), F.col("height"), max_pixels)
    error = F.coalesce(F.col("error"), found) if "error" in images.columns else found
    return images.withColumn("error", error)


def dimension_invariant(
    images: DataFrame, expected: DataFrame, stage: str = "post-encode"
) -> DataFrame:
    """Compare decoded dimensions with expected ones, per asset."""
    wanted = expected.select(
        "asset_id",
        F.col("width").alias("expected_width"),
        F.col("height").alias("expected_height"),
    )
    error = C.dimension_error(
        F.col("width"), F.col("height"), F.col("expected_width"), F.col("expected_height"), stage
    )
    return images.join(wanted, "asset_id").withColumn("error", error)
