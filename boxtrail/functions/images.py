"""Quality of gray images held as pixel bytes (the layout of Spark's image source)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from boxtrail.session import ship_package

# Gray weights of blue, green, red; limits of clipped pixels; smallest share left by the clip penalty.
GRAY_WEIGHTS = np.array([0.114, 0.587, 0.299])
DARK, BRIGHT, FLOOR = 4, 251, 0.1

QUALITY = "brightness double, contrast double, sharpness double, clipped_dark double, clipped_bright double, score double"


def _laplacian(gray: np.ndarray) -> np.ndarray:
    """Sum of the four neighbours minus four times the pixel; the border mirrors without repeating its edge."""
    p = np.pad(gray, 1, mode="reflect")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * gray


def _one(width: int, height: int, channels: int, data: bytes) -> tuple:
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype(float)
    gray = pixels[..., 0] if channels == 1 else np.rint(pixels[..., :3] @ GRAY_WEIGHTS)
    sharp = float(_laplacian(gray).var()) if min(gray.shape) > 1 else 0.0
    dark, bright = float((gray <= DARK).mean()), float((gray >= BRIGHT).mean())
    return float(gray.mean()), float(gray.std()), sharp, dark, bright, sharp * max(FLOOR, 1.0 - dark - bright)


def image_quality(width: Column, height: Column, channels: Column, data: Column) -> Column:
    """A struct of brightness, contrast, sharpness (Laplacian variance), clipped shares and the quality score."""

    @pandas_udf(QUALITY)
    def quality(w: pd.Series, h: pd.Series, c: pd.Series, pixels: pd.Series) -> pd.DataFrame:
        rows = [_one(*r) for r in zip(w, h, c, pixels)]
        return pd.DataFrame(rows, columns=["brightness", "contrast", "sharpness", "clipped_dark", "clipped_bright", "score"])

    ship_package(SparkSession.getActiveSession())
    return quality(width, height, channels, data)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images of a folder with their quality; one image is one row, whatever the folder holds."""
    img = spark.read.format("image").option("dropInvalid", True).load(path)
    q = image_quality(*(F.col(f"image.{c}") for c in ("width", "height", "nChannels", "data")))
    return img.select(F.col("image.origin").alias("file"), "image.width", "image.height", q.alias("q")).select(
        "file", "width", "height", "q.*"
    )
