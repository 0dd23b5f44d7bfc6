"""Decoded images as rows and as scan lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import columns as C, constants as K

LINES = (
    "asset_id string, width int, height int, channels int, y int, samples array<int>"
)


def scan_images(
    spark: SparkSession, roots: str | Iterable[str], max_pixels: int = K.MAX_PIXELS
) -> DataFrame:
    """Decoded images; an undecodable or oversized one is an error row, not a failed job."""
    reader = spark.read.format("image").option("recursiveFileLookup", "true")
    images = reader.load([roots] if isinstance(roots, str) else list(roots)).select("image.*")
    undecodable = F.when(F.col("width") < 0, F.lit(K.ERR_DECODE))
    return images.select(
        F.col("origin").alias("asset_id"),
        "width",
        "height",
        F.col("nChannels").alias("channels"),
        "data",
        F.coalesce(undecodable, C.pixel_error(F.col("width"), F.col("height"), max_pixels))
        .alias("error"),
    )


def image_lines(images: DataFrame, pixels_per_batch: int = 1_000_000) -> DataFrame:
    """RGBA scan lines of the images that decoded and pass the pixel limit."""
    usable = images.filter(F.col("error").isNull()).select(
        "asset_id", "width", "height", "channels", "data"
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                asset, width, height, channels, data = (
                    batch.column(i)[row].as_py() for i in range(5)
                )
                rgba = to_rgba(np.frombuffer(data, np.uint8), width, height, channels)
                step = max(1, pixels_per_batch // width)
                for start in range(0, height, step):
                    part = rgba[start : start + step]
                    count = len(part)
                    offsets = np.arange(count + 1, dtype=np.int32) * (width * 4)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([asset] * count, pa.string()),
                            pa.array(np.full(count, width, np.int32)),
                            pa.array(np.full(count, height, np.int32)),
                            pa.array(np.full(count, 4, np.int32)),
                            pa.array(np.arange(start, start + count, dtype=np.int32)),
                            pa.ListArray.from_arrays(
                                pa.array(offsets), pa.array(part.reshape(-1).astype(np.int32))
                            ),
                        ],
                        names=["asset_id", "width", "height", "channels", "y", "samples"],
                    )

    return usable.mapInArrow(split, LINES)


def to_rgba(flat: np.ndarray, width: int, height: int, channels: int) -> np.ndarray:
    """Spark decodes to grey, BGR or BGRA; give RGBA."""
    pixels = flat.reshape(height, width, channels)
    rgba = np.full((height, width, 4), 255, np.uint8)
    rgba[..., :3] = pixels[..., [0, 0, 0]] if channels == 1 else pixels[..., 2::-1]
    if channels == 4:
        rgba[..., 3] = pixels[..., 3]
    return rgba
