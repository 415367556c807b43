"""Structural and spectral likeness of images, many images to a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side and deviation of the usual Gaussian window, and the stabilising shares of the data range.
WINDOW, SIGMA = 11, 1.5
K1, K2 = 0.01, 0.03
#: Cells worked on at once.
MOST_CELLS = 1_000_000


def image_arrays(cells: DataFrame, key: str, values: list[str], py: str = "py", px: str = "px") -> DataFrame:
    """Images of cells(key, py, px, values) as arrays, row after row: key, height, width, values.

    An image has a cell at every place from (0, 0) on, once; others, and
    images with a null cell, are left out. One image is one row.
    """
    kept = F.array_sort(F.collect_list(F.struct(F.col(py).alias("y"), F.col(px).alias("x"), *[F.col(v).cast("double").alias(v) for v in values])))
    made = cells.groupBy(key).agg(kept.alias("c"), (F.max(py) + 1).cast("int").alias("height"), (F.max(px) + 1).cast("int").alias("width"), F.min(F.least(F.col(py), F.col(px))).alias("least"))
    whole = F.forall("c", lambda c: F.coalesce(*[F.when(c[v].isNull(), F.lit(False)) for v in values], F.lit(True)))
    placed = F.forall(F.transform("c", lambda c, i: (c["y"] * F.col("width") + c["x"]) == i), lambda b: b)
    fitting = (F.size("c") == F.col("height") * F.col("width")) & (F.col("least") == 0) & placed & whole
    return made.where(fitting).select(key, "height", "width", *[F.col(f"c.`{v}`").alias(v) for v in values])


def _windowed(images: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sums over all windows that lie inside images[n, h, w], one axis after the other."""
    for axis in (1, 2):
        size = images.shape[axis] - len(weights) + 1
        images = sum(w * images.take(range(k, k + size), axis) for k, w in enumerate(weights))
    return images


def _box_sums(images: np.ndarray, size: int) -> np.ndarray:
    """Plain sums over all windows, by integral images: four corners a window, whatever its size."""
    summed = np.zeros((len(images), images.shape[1] + 1, images.shape[2] + 1))
    summed[:, 1:, 1:] = images.cumsum(1).cumsum(2)
    return summed[:, size:, size:] - summed[:, :-size, size:] - summed[:, size:, :-size] + summed[:, :-size, :-size]


def ssim(x: np.ndarray, y: np.ndarray, window: int = WINDOW, sigma: float | None = SIGMA, data_range: float = 1.0) -> np.ndarray:
    """Mean structural similarity of each pair of images[n, h, w]; a Gaussian window, or an even one without sigma."""
    if sigma is None:
        mean = lambda a: _box_sums(a, window) / window**2
    else:
        weights = np.exp(-((np.arange(window) - window // 2) ** 2) / (2 * sigma**2))
        weights /= weights.sum()
        mean = lambda a: _windowed(a, weights)
    # Taken about each image's own level, where integral images lose no digits.
    level = (x.mean((1, 2)) + y.mean((1, 2)))[:, None, None] / 2
    u, v = x - level, y - level
    mu, mv = mean(u), mean(v)
    uu, vv, uv = mean(u * u) - mu * mu, mean(v * v) - mv * mv, mean(u * v) - mu * mv
    mu, mv = mu + level, mv + level
    c1, c2 = (K1 * data_range) ** 2, (K2 * data_range) ** 2
    return ((2 * mu * mv + c1) * (2 * uv + c2) / ((mu * mu + mv * mv + c1) * (uu + vv + c2))).mean((1, 2))


def spectral_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Mean absolute difference of the real Fourier transforms of each pair of images[n, h, w]."""
    return np.abs(np.fft.rfft2(x - y)).mean((1, 2))


def structural_losses(images: DataFrame, key: str, pred: str, target: str, window: int = WINDOW, sigma: float | None = SIGMA, data_range: float = 1.0) -> DataFrame:
    """ssim_loss (1 - similarity) and spectral_loss of images(key, height, width, pred, target): key, ssim_loss, spectral_loss.

    Images of one size are worked on together. An image smaller than the
    window has no similarity, and a null loss.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (h, w), same in pdf.groupby(["h", "w"]):
                step = max(1, MOST_CELLS // (h * w))
                for i in range(0, len(same), step):
                    some = same.iloc[i : i + step]
                    x, y = (np.stack([np.asarray(v, np.float64) for v in some[c]]).reshape(-1, h, w) for c in ("p", "t"))
                    alike = 1 - ssim(x, y, window, sigma, data_range) if min(h, w) >= window else None
                    yield pd.DataFrame({"k": some["k"].array, "ssim_loss": alike, "spectral_loss": spectral_distance(x, y)}).astype({"ssim_loss": float})

    kind = images.schema[key].dataType.simpleString()
    slim = images.select(F.col(key).alias("k"), F.col("height").alias("h"), F.col("width").alias("w"), F.col(pred).alias("p"), F.col(target).alias("t"))
    return slim.mapInPandas(work, f"k {kind}, ssim_loss double, spectral_loss double").select(F.col("k").alias(key), F.nanvl("ssim_loss", F.lit(None)).alias("ssim_loss"), "spectral_loss")
