"""Target sizes of images: pure arithmetic over width and height."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: preferred resolutions (width, height) -----------------------------
PREFERRED = (
    (672, 1568), (688, 1504), (720, 1456), (752, 1392), (800, 1328), (832, 1248), (880, 1184), (944, 1104), (1024, 1024),
    (1104, 944), (1184, 880), (1248, 832), (1328, 800), (1392, 752), (1456, 720), (1504, 688), (1568, 672),
)
# -------------------------------------------------------------------------------------


def nearest_resolution(rows: DataFrame, candidates: tuple[tuple[int, int], ...] = PREFERRED) -> DataFrame:
    """Adds target_width and target_height: the candidate whose aspect ratio is nearest, ties by the
    smaller width, then height. Rows without a positive size get nulls."""
    ratio = F.col("width").cast("double") / F.nullif(F.col("height").cast("double"), F.lit(0.0))
    options = F.array(*[F.struct(F.abs(ratio - w / h).alias("gap"), F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in candidates])
    best = F.when(ratio > 0, F.array_min(options))
    return rows.withColumn("__b", best).withColumn("target_width", F.col("__b.w")).withColumn("target_height", F.col("__b.h")).drop("__b")


def fit_long_side(width: Column, height: Column, longest: int) -> tuple[Column, Column]:
    """Size scaled down so that the long side is at most ``longest``; smaller images stay."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    known = width.isNotNull() & height.isNotNull()
    side = lambda v: F.when(known, F.greatest(F.lit(1), F.round(v * scale).cast("int")))
    return side(width), side(height)
