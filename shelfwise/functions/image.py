"""Features of luma grids: the hash as a column expression, the rest in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = "asset_id long, w int, h int, mean double, variance double, mean_square double, tiles array<double>, face_variance double"


def dhash(px: Column) -> Column:
    """64 bits over a 9 x 8 grid: bit row * 8 + col is set when a pixel is darker than its right neighbour."""
    bit = lambda i: F.get(px, (F.floor(i / 8) * 9 + i % 8).cast("int")) < F.get(px, (F.floor(i / 8) * 9 + i % 8 + 1).cast("int"))
    one = F.lit(1).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda h, i: F.when(bit(i), h.bitwiseOR(F.call_function("shiftleft", one, i))).otherwise(h))


def mean(px: Column) -> Column:
    return F.aggregate(px, F.lit(0.0), lambda s, x: s + x) / F.size(px)


def luma_bt709(r: Column, g: Column, b: Column) -> Column:
    """Brightness of red, green and blue in [0, 1]."""
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def eye_aspect(points: Column) -> Column:
    """Height to width of an eye's landmark points (structs x, y); 1 for fewer than four or a width of 0.01 or less."""
    span = lambda k: F.array_max(F.transform(points, lambda p: p[k])) - F.array_min(F.transform(points, lambda p: p[k]))
    return F.when((F.coalesce(F.size(points), F.lit(0)) >= 4) & (span("x") > 0.01), span("y") / span("x")).otherwise(1.0)


def face_rect(box: Column, w: Column, h: Column) -> Column:
    """A normalized box counted from the bottom left as pixels counted from the top left."""
    return F.struct((box["x"] * w).alias("x"), ((1.0 - box["y"] - box["h"]) * h).alias("y"), (box["w"] * w).alias("w"), (box["h"] * h).alias("h"))


def laplacian(grid: np.ndarray) -> np.ndarray:
    """4-neighbour Laplacian of the interior; row y, column x of it belong to pixel (y + 1, x + 1)."""
    return 4 * grid[1:-1, 1:-1] - grid[:-2, 1:-1] - grid[2:, 1:-1] - grid[1:-1, :-2] - grid[1:-1, 2:]


def region_variance(lap: np.ndarray, w: int, h: int, x0: float, y0: float, x1: float, y1: float) -> float | None:
    """Variance over a region clipped to [1, w - 2) x [1, h - 2); none for sides of two or less."""
    a, b, c, d = max(1, int(x0)), max(1, int(y0)), min(w - 2, int(x1)), min(h - 2, int(y1))
    return float(lap[b - 1 : d - 1, a - 1 : c - 1].var()) if c > a + 2 and d > b + 2 else None


def pixel_features(luma: DataFrame, grid: int = 4) -> DataFrame:
    """Sharpness features of each picture: whole, by tile, and the sharpest face.

    ``luma`` has asset_id, w, h, px and, if faces are known, ``faces`` with normalized boxes counted from the
    bottom left. Pictures with sides of two pixels or less have variance 0 and no tiles.
    """
    faces = "faces" in luma.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                w, h = batch.column("w")[i].as_py(), batch.column("h")[i].as_py()
                px = batch.column("px")[i].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(h, w)
                lap = laplacian(px) if w > 2 and h > 2 else np.zeros((0, 0))
                tw, th = w // grid, h // grid
                tiles = [region_variance(lap, w, h, c * tw, r * th, min(c * tw + tw, w), min(r * th + th, h)) for r in range(grid) for c in range(grid)] if lap.size else []
                boxes = (batch.column("faces")[i].as_py() or []) if faces else []
                seen = [region_variance(lap, w, h, f["x"] * w, (1 - f["y"] - f["h"]) * h, f["x"] * w + f["w"] * w, (1 - f["y"] - f["h"]) * h + f["h"] * h) for f in boxes] if lap.size else []
                seen = [v for v in seen if v is not None]
                variance = float(lap.var()) if lap.size else 0.0
                rows.append((w, h, float(px.mean()) if px.size else 128.0, variance, float((lap**2).mean()) if lap.size else None, sorted(v for v in tiles if v is not None), (max(seen) if seen else variance) if boxes else None))
            names = ("w", "h", "mean", "variance", "mean_square", "tiles", "face_variance")
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.float64())
            yield pa.RecordBatch.from_pydict({"asset_id": batch.column("asset_id")} | {n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})

    return luma.select("asset_id", "w", "h", "px", *(["faces"] if faces else [])).mapInArrow(scan, FEATURES)


def percentile_nearest(ordered: Column, p: float) -> Column:
    """Nearest-rank percentile of a sorted array."""
    i = F.floor(F.lit(p / 100) * (F.size(ordered) - 1) + 0.5).cast("int")
    return F.get(ordered, F.greatest(F.lit(0), F.least(F.size(ordered) - 1, i)))


def is_blurry() -> Column:
    """Over :func:`pixel_features`: limits follow the brightness; one sharp region or a wide spread is enough not to be."""
    s = 0.33 + 0.67 * F.col("mean") / 255.0
    p10, p50, p90 = (percentile_nearest(F.col("tiles"), p) for p in (10, 50, 90))
    return (
        F.when((F.col("w") <= 8) | (F.col("h") <= 8), False).when(F.col("variance") <= 8.0 * s, False)
        .when(F.col("face_variance").isNotNull(), F.col("face_variance") < 55.0 * s).when(F.size("tiles") < 4, F.col("variance") < 80.0 * s)
        .when(p90 > 420.0, False).when((p10 > 1.0) & (p90 / p10 >= 4.0), False).when(p90 < 260.0 * s, True).otherwise(p50 < 120.0 * s)
    )


def is_blurry_simple() -> Column:
    return F.coalesce(F.col("mean_square") < 80.0 * (0.33 + 0.67 * F.col("mean") / 255.0), F.lit(False))
