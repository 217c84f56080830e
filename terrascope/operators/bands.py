"""Neighbourhood operators and bilinear resampling on bands of packed rows.

A pixel table is dealt out as *tiles*: bands of ``BAND`` image rows (cut at ``SPAN``
columns, for very wide images) with a halo of the pixels that a window reads
beyond the band.  One exchange ships every pixel to its tile, and pixels of a halo
to the neighbours as well; inside a task the rows of a tile form a small dense
canvas, on which an operator is a few shifted numpy operations.  A task holds
the tiles of about ``CHUNK`` pixels at a time, whatever the size of an image, and
consecutive bands of one image go to different tasks.

Pixels that a table lacks, and null values, take part in no window; a cell inside
the image has a result if any pixel of its window is present.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascope.session import ship

BAND, SPAN = 16, 16384
CHUNK = 1 << 19


def _deal(df: DataFrame, spread: Column, order: Sequence[str]) -> DataFrame:
    """Rows with equal ``order`` columns next to each other in one task; ``spread`` numbers
    the tasks, so that neighbouring bands of an image do not meet in one."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionById(tasks, F.pmod(spread, F.lit(tasks)).cast("int")).sortWithinPartitions(*order)


def whole_groups(batches, keys: int, chunk: int = CHUNK):
    """Sorted Arrow batches, regrouped: record batches of about ``chunk`` rows in which no
    run of equal first ``keys`` columns is cut."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < chunk:
            continue
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        start = group_starts(table, keys)[-1]
        if start:
            yield table.slice(0, start)
        held, rows = [table.slice(start)], table.num_rows - start
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def group_starts(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """First rows of the runs of equal first ``keys`` columns."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for j in range(keys):
        column = batch.column(j)
        codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


class Canvas:
    """Tiles of one chunk as dense arrays ``(tile, row, column)`` with the halo around them.

    Tiles start every ``band`` rows and every ``step`` columns; ``span``: columns of the canvas.
    ``value[j]``: the values (0 where absent), ``there[j]``: which are present; ``y``, ``x``:
    image coordinates of the canvas rows ``(tile, row)`` and columns ``(tile, column)``."""

    def __init__(self, batch: pa.RecordBatch, starts: np.ndarray, ends: np.ndarray, values: int, radius: int,
                 band: int, step: int, span: int):
        take = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)])
        tile = np.repeat(np.arange(len(starts)), ends - starts)
        column = [batch.column(j).to_numpy(zero_copy_only=False) for j in range(1, 7)]
        ty, tx, self.h, self.w = (column[j][starts].astype(np.int64) for j in (0, 1, 4, 5))
        self.radius, self.first = radius, starts
        self.y = (ty * band - radius)[:, None] + np.arange(band + 2 * radius)
        self.x = (tx * step - radius)[:, None] + np.arange(span + 2 * radius)
        row, col = column[2][take] - self.y[tile, 0], column[3][take] - self.x[tile, 0]
        shape = (len(starts), band + 2 * radius, span + 2 * radius)
        self.value, self.there = [], []
        for j in range(values):
            raw = batch.column(7 + j)
            known = raw.is_valid().to_numpy(zero_copy_only=False)[take]
            number = raw.fill_null(0).to_numpy(zero_copy_only=False)[take].astype(np.float64)
            value, there = np.zeros(shape), np.zeros(shape, bool)
            value[tile, row, col], there[tile, row, col] = np.where(known, number, 0.0), known
            self.value.append(value)
            self.there.append(there)

    def inside(self) -> np.ndarray:
        """Cells of the canvas that lie in the image."""
        return (((self.y >= 0) & (self.y < self.h[:, None]))[:, :, None]
                & ((self.x >= 0) & (self.x < self.w[:, None]))[:, None, :])

    def core(self, a: np.ndarray) -> np.ndarray:
        """A canvas array without its halo."""
        r = self.radius
        return a[:, r:a.shape[1] - r, r:a.shape[2] - r]


def shifted(a: np.ndarray, dy: int, dx: int, margin: int) -> np.ndarray:
    """The array moved by ``(dy, dx)``, cut by ``margin`` on all sides."""
    return a[:, margin + dy:a.shape[1] - margin + dy, margin + dx:a.shape[2] - margin + dx]


def tile_map(pixels: DataFrame, values: Sequence[str], radius: int, out: Sequence[tuple[str, str]],
             operator: Callable, sizes: bool = False) -> DataFrame:
    """``image_id, y, x[, height, width]`` and the columns ``out`` (name, type), computed tile by tile.

    ``operator(canvas)`` returns, for the cells without the halo, which have a result and the arrays
    of ``out``."""
    ship(pixels.sparkSession)
    band, step, chunk = BAND, SPAN, CHUNK
    reach = []
    for coord, size, unit in (("y", "height", band), ("x", "width", step)):
        at = F.col(coord)
        low = F.greatest(F.floor((at - radius) / unit), F.lit(0))
        high = F.least(F.floor((at + radius) / unit), F.floor((F.col(size) - 1) / unit))
        reach.append(F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    cells = ["y", "x", "height", "width", *values]
    dealt = (pixels.where((F.col("y") >= 0) & (F.col("y") < F.col("height")) & (F.col("x") >= 0) & (F.col("x") < F.col("width")))
             .select("image_id", *cells, reach[0].alias("_ty")).select("image_id", "_ty", *cells, reach[1].alias("_tx"))
             .select("image_id", "_ty", "_tx", *cells))
    dealt = _deal(dealt, F.xxhash64("image_id") + F.col("_ty") + F.lit(31) * F.col("_tx"), ["image_id", "_ty", "_tx"])
    image_type = dict(pixels.dtypes)["image_id"]
    names = ["image_id", "y", "x"] + (["height", "width"] if sizes else []) + [n for n, _ in out]
    kinds = {"int": pa.int32(), "double": pa.float64(), "bigint": pa.int64()}
    n = len(values)

    def run(batches):
        for batch in whole_groups(batches, 3, chunk):
            starts = group_starts(batch, 3)
            ends = np.append(starts[1:], batch.num_rows)
            # canvases of like widths, so that a narrow tile is not stored as a wide one
            width = np.minimum(batch.column(6).to_numpy()[starts], step)
            spans = 1 << np.ceil(np.log2(np.maximum(width, 1))).astype(int)
            for span in np.unique(spans):
                some = np.flatnonzero(spans == span)
                most = max(1, chunk // int(span * band))
                for a in range(0, len(some), most):
                    part = some[a:a + most]
                    canvas = Canvas(batch, starts[part], ends[part], n, radius, band, step, int(span))
                    has, arrays = operator(canvas)
                    tile, row, col = np.nonzero(has & canvas.core(canvas.inside()))
                    y, x = canvas.y[tile, row + radius], canvas.x[tile, col + radius]
                    columns = [batch.column(0).take(pa.array(canvas.first[tile])), pa.array(y.astype(np.int32)),
                               pa.array(x.astype(np.int32))]
                    if sizes:
                        columns += [pa.array(canvas.h[tile].astype(np.int32)), pa.array(canvas.w[tile].astype(np.int32))]
                    columns += [pa.array(v[tile, row, col]).cast(kinds[kind]) for v, (_, kind) in zip(arrays, out)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = [f"image_id {image_type}", "y int", "x int"] + (["height int", "width int"] if sizes else [])
    return dealt.mapInArrow(run, ", ".join(schema + [f"{name} {kind}" for name, kind in out]))


# --- operators ------------------------------------------------------------------

def window_stats(radius: int):
    """Mean and population std of every value over the window (two passes, no cancellation)."""
    def operator(canvas: Canvas):
        window = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]
        has, arrays = False, []
        for value, there in zip(canvas.value, canvas.there):
            count = sum(shifted(there, dy, dx, radius).astype(np.float64) for dy, dx in window)
            # as when no value of a window is known: the cell has no mean
            share = np.where(count > 0, count, np.nan)
            mean = sum(shifted(value, dy, dx, radius) for dy, dx in window) / share
            square = sum(np.where(shifted(there, dy, dx, radius), (shifted(value, dy, dx, radius) - mean) ** 2, 0.0)
                         for dy, dx in window) / share
            has = has | (count > 0)
            arrays += [mean, np.sqrt(square)]
        return has, arrays
    return operator


def _extreme(a: np.ndarray, halves: dict[int, int], radius: int, best) -> np.ndarray:
    """Maximum (or minimum) over a kernel given by the half width of each of its rows; the
    running extreme of a row is taken once per width."""
    runs = {half: None for half in halves.values()}
    width = a.shape[2] - 2 * radius
    for half in runs:
        run = a[:, :, radius - half:radius - half + width]
        for dx in range(-half + 1, half + 1):
            run = best(run, a[:, :, radius + dx:radius + dx + width])
        runs[half] = run
    out = None
    for dy, half in halves.items():
        row = runs[half][:, radius + dy:a.shape[1] - radius + dy]
        out = row if out is None else best(out, row)
    return out


def morphology(offsets: Sequence[tuple[int, int]], steps: Sequence[str]):
    """``(radius, operator)`` of dilations ('max') and erosions ('min') in a row, in one pass."""
    halves = {dy: max(dx for y, dx in offsets if y == dy) for dy in sorted({dy for dy, _ in offsets})}
    if {(dy, dx) for dy, half in halves.items() for dx in range(-half, half + 1)} != set(offsets):
        raise ValueError("a kernel is made of rows that are symmetric and without gaps")
    radius = max(max(abs(dy), half) for dy, half in halves.items())

    def operator(canvas: Canvas):
        value, there, inside = canvas.value[0], canvas.there[0], canvas.inside()
        for step in steps:
            best, absent = (np.maximum, -np.inf) if step == "max" else (np.minimum, np.inf)
            value = _extreme(np.where(there & inside, value, absent), halves, radius, best)
            there = value != absent
            inside = inside[:, radius:inside.shape[1] - radius, radius:inside.shape[2] - radius]
        return there, [np.where(there, value, 0.0)]
    return radius * len(steps), operator


def weighted_window(weights: Sequence[float], radius: int):
    """Separable weights, the border reflected without repeating the edge; rounded half up."""
    def reflected(at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = size[:, None]
        back = np.where(at < 0, -at, np.where(at >= size, 2 * (size - 1) - at, at))
        place = back - at[:, :1]
        fine = (back >= 0) & (back < size) & (place >= 0) & (place < at.shape[1])
        return np.where(fine, place, 0), fine

    def operator(canvas: Canvas):
        row, row_fine = reflected(canvas.y, canvas.h)
        col, col_fine = reflected(canvas.x, canvas.w)
        tile = np.arange(len(row))[:, None, None]
        fine = row_fine[:, :, None] & col_fine[:, None, :]
        has, arrays = False, []
        for value, there in zip(canvas.value, canvas.there):
            padded = np.where(fine, value[tile, row[:, :, None], col[:, None, :]], 0.0)
            known = fine & there[tile, row[:, :, None], col[:, None, :]]
            total = sum(weights[dy + radius] * weights[dx + radius] * shifted(padded, dy, dx, radius)
                        for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1))
            has = has | np.logical_or.reduce([shifted(known, dy, dx, radius) for dy in range(-radius, radius + 1)
                                              for dx in range(-radius, radius + 1)])
            arrays.append(np.floor(total + 0.5))
        return has, arrays
    return operator


# --- bilinear resampling ----------------------------------------------------------

def _axis(t: np.ndarray, n: int, o: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Output coordinates -> ``(s0, s1, fraction)``; clamped at both edges."""
    f = (t + 0.5) * n / float(o) - 0.5
    s0 = np.floor(f)
    frac = np.where((s0 < 0) | (s0 >= n - 1), 0.0, f - s0)
    s0 = np.clip(s0, 0, n - 1).astype(np.int64)
    return s0, np.minimum(s0 + 1, n - 1), frac


def _readers(s: Column, n: Column, o: int) -> tuple[Column, Column]:
    """First and last output coordinate that may read source coordinate ``s``."""
    scale = F.lit(float(o)) / n
    low = F.ceil((s - F.lit(0.5)) * scale - F.lit(0.5) - F.lit(1e-6))
    high = F.floor((s + F.lit(1.5)) * scale - F.lit(0.5) + F.lit(1e-6))
    low = F.when(s <= 0, F.lit(0)).otherwise(F.greatest(F.lit(0), low))
    high = F.when(s >= n - 1, F.lit(o - 1)).otherwise(F.least(F.lit(o - 1), high))
    return low.cast("int"), high.cast("int")


def _present(places: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
    return at, places[at] == wanted


def resize_bilinear(pixels: DataFrame, out_h: int, out_w: int, values: Sequence[str], source_size: bool = False) -> DataFrame:
    """R6 in two 1-D passes: columns of every source row, then rows.

    Pixels that no output reads stay in the map task (a reduced image ships at most four
    pixels an output cell); the others go to the bands of output rows that read them."""
    ship(pixels.sparkSession)
    band = max(1, min(out_h, (CHUNK // 2) // max(out_w, 1)))
    y0, y1 = _readers(F.col("y"), F.col("height"), out_h)
    x0, x1 = _readers(F.col("x"), F.col("width"), out_w)
    cells = ["y", "x", "height", "width", *values]
    used = (pixels.select("image_id", *cells, y0.alias("_y0"), y1.alias("_y1"), x0.alias("_x0"), x1.alias("_x1"))
            .where((F.col("_y0") <= F.col("_y1")) & (F.col("_x0") <= F.col("_x1"))))
    dealt = used.select("image_id", F.explode(F.sequence(F.expr(f"_y0 div {band}").cast("int"),
                                                         F.expr(f"_y1 div {band}").cast("int"))).alias("_band"), *cells)
    dealt = _deal(dealt, F.xxhash64("image_id") + F.col("_band"), ["image_id", "_band"])
    image_type = dict(pixels.dtypes)["image_id"]
    names = ["image_id", "y", "x", *values] + (["src_height", "src_width"] if source_size else []) + ["height", "width"]
    n = len(values)

    def resize(batch: pa.RecordBatch, a: int, b: int):
        number, h, w = (batch.column(j)[a].as_py() for j in (1, 4, 5))
        y, x = (batch.column(j).slice(a, b - a).to_numpy() for j in (2, 3))
        rows, ry = np.unique(y, return_inverse=True)
        cols, rx = np.unique(x, return_inverse=True)
        t = np.arange(number * band, min(out_h, (number + 1) * band))
        s0, s1, fy = _axis(t, h, out_h)
        c0, c1, fx = _axis(np.arange(out_w), w, out_w)
        (p0, k0), (p1, k1) = _present(cols, c0), _present(cols, c1)
        (q0, m0), (q1, m1) = _present(rows, s0), _present(rows, s1)
        has, arrays = False, []
        for j in range(n):
            raw = batch.column(6 + j).slice(a, b - a)
            known = raw.is_valid().to_numpy(zero_copy_only=False)
            value, there = np.zeros((len(rows), len(cols))), np.zeros((len(rows), len(cols)), bool)
            value[ry, rx], there[ry, rx] = raw.fill_null(0).to_numpy(zero_copy_only=False), known
            across = value[:, p0] * (k0 * (1.0 - fx)) + value[:, p1] * (k1 * fx)
            met = (there[:, p0] & k0) | (there[:, p1] & k1 & (fx > 0))
            total = across[q0] * (m0 * (1.0 - fy))[:, None] + across[q1] * (m1 * fy)[:, None]
            has = has | (met[q0] & m0[:, None]) | (met[q1] & (m1 & (fy > 0))[:, None])
            arrays.append(np.clip(np.floor(total + 0.5), 0, 255).astype(np.int32))
        row, col = np.nonzero(has)
        fixed = lambda v: pa.array(np.full(len(row), v, np.int32))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(np.full(len(row), a))), pa.array(t[row].astype(np.int32)), pa.array(col.astype(np.int32)),
             *[pa.array(v[row, col]) for v in arrays], *([fixed(h), fixed(w)] if source_size else []),
             fixed(out_h), fixed(out_w)], names=names)

    def run(batches):
        for batch in whole_groups(batches, 2):
            starts = group_starts(batch, 2)
            for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
                yield resize(batch, int(a), int(b))

    kinds = [f"image_id {image_type}"] + [f"{name} int" for name in names[1:]]
    return dealt.mapInArrow(run, ", ".join(kinds))
