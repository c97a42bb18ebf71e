"""Sizes of images to render or send, as Columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def limited(w: Column, h: Column, longest: int | None) -> tuple[Column, Column]:
    """At most ``longest`` on the longer edge; never enlarged."""
    if longest is None:
        return w, h
    ratio = F.lit(float(longest)) / F.greatest(w, h)
    return tuple(F.when(ratio < 1, (c * ratio).cast("int")).otherwise(c) for c in (w, h))


def rendered(points: Column, dpi: Column | float) -> Column:
    """Pixels of a length in points."""
    return points * (dpi / 72)


def ceiling(a: Column, places: int) -> Column:
    """a plus half a unit, rounded half to even after scaling by a power of ten, as NumPy and DuckDB do.

    ``bround`` rounds the shortest decimal form instead: of 3.3499999999999996 it makes 3.3, not 3.4.
    """
    unit = F.lit(10.0**places)
    return F.rint((a + 0.5 * 10.0**-places) * unit) / unit


def reduced_dpi(dpi: Column, pixels: Column, limit: Column) -> Column:
    """The resolution for a second try on a page that has too many pixels."""
    return F.floor(dpi / ceiling(pixels / limit, 1))


def fitted(w: Column, h: Column, most: tuple[int, int] = (3072, 2048), least: tuple[int, int] = (28, 28)) -> tuple[Column, Column]:
    """Scaled into a pixel budget: rounded down when it shrinks, up when it grows."""
    pixels = w * h
    top, bottom = most[0] * most[1], least[0] * least[1]
    shrink, grow = F.sqrt(F.lit(float(top)) / pixels), F.sqrt(F.lit(float(bottom)) / pixels)
    return tuple(F.when(pixels > top, F.floor(c * shrink)).when(pixels < bottom, F.ceil(c * grow)).otherwise(c).cast("int") for c in (w, h))


def smart(w: Column, h: Column, factor: int = 28, least: int = 3136, most: int = 11_289_600, aspect: float = 200.0, guard: bool = True) -> tuple[Column, Column]:
    """Multiples of ``factor`` within a pixel budget; null beyond ``aspect`` where guarded."""
    near = [F.bround(c / factor) * factor for c in (h, w)]
    if guard:
        near = [F.greatest(F.lit(float(factor)), c) for c in near]
    beta_down, beta_up = F.sqrt(h * w / F.lit(float(most))), F.sqrt(F.lit(float(least)) / (h * w))
    down = [F.floor(c / beta_down / factor) * factor for c in (h, w)]
    if guard:
        down = [F.greatest(F.lit(factor), c) for c in down]
    up = [F.ceil(c * beta_up / factor) * factor for c in (h, w)]
    size = near[0] * near[1]
    hh, ww = (F.when(size > most, d).when(size < least, u).otherwise(n).cast("int") for n, d, u in zip(near, down, up, strict=True))
    if not guard:
        return ww, hh
    ok = F.greatest(h, w) / F.least(h, w) <= aspect
    return F.when(ok, ww), F.when(ok, hh)


def grid_fit(w: np.ndarray, h: np.ndarray, step: int = 28, most: int = 3072 * 2048, least: int = 1792 * 28) -> tuple[np.ndarray, np.ndarray]:
    """Nearest multiples of ``step`` for many images at once, then cells taken off until the budget holds.

    What is over the budget loses a row or a column a turn, whichever keeps the shape closer.
    """
    w, h = np.asarray(w, dtype=np.float64), np.asarray(h, dtype=np.float64)
    ok = (w > 0) & (h > 0)
    shape, pixels = np.where(ok, w / np.where(ok, h, 1), 1.0), np.where(ok, w * h, 1.0)
    scale = np.sqrt(np.where(pixels > most, most / pixels, np.where(pixels < least, least / pixels, 1.0)))
    cols, rows = (np.maximum(1, np.rint(c * scale / step)) for c in (w, h))
    while True:
        over = ok & (cols * rows * step * step > most) & ((cols > 1) | (rows > 1))
        if not over.any():
            break
        with np.errstate(divide="ignore"):
            lose_col = np.where(cols > 1, np.abs((cols - 1) / rows - shape), np.inf)
            lose_row = np.where(rows > 1, np.abs(cols / (rows - 1) - shape), np.inf)
        by_col = lose_col < lose_row
        cols, rows = cols - (over & by_col), rows - (over & ~by_col)
    return np.where(ok, cols * step, w).astype(np.int64), np.where(ok, rows * step, h).astype(np.int64)
