"""Large windows on blocks: pictures as rows (image, block, bytes), each block getting what lies around it from its neighbours.

A block moves once as a whole and once as the strips that its up to eight neighbours need, so that the rows moved are nine a
block, whatever the window; a pixel table would move a row for each pixel and tap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = "image_id"
SCHEMA = "image_id long, bx int, by int, width int, height int, channels int, data binary"


def blocks_of(pixels: DataFrame, side: int = 64, channels: tuple = ("v",)) -> DataFrame:
    """(image_id, bx, by, width, height, channels, data): squares of ``side``, narrower at the far edges; a byte a channel, row by row.

    width and height are the picture's, which has a pixel at every point of it.
    """
    sizes = pixels.groupBy(KEY).agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        x0, y0 = int(first.bx) * side, int(first.by) * side
        out = np.zeros((min(side, first.height - y0), min(side, first.width - x0), len(channels)), np.uint8)
        out[pdf.y.to_numpy() - y0, pdf.x.to_numpy() - x0] = pdf[list(channels)].to_numpy()
        return pd.DataFrame([(first[KEY], first.bx, first.by, first.width, first.height, len(channels), out.tobytes())], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    at = pixels.select(KEY, "x", "y", *channels).withColumns({"bx": F.floor(F.col("x") / side).cast("int"), "by": F.floor(F.col("y") / side).cast("int")}).join(sizes, KEY)
    return at.groupBy(KEY, "bx", "by").applyInPandas(pack, SCHEMA)


def pixels_of(blocks: DataFrame, side: int = 64, channels: tuple = ("v",)) -> DataFrame:
    """The pixel table of blocks."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                img = _array(r, side)
                y, x = np.indices(img.shape[:2])
                yield pd.DataFrame({KEY: r.image_id, "x": x.ravel() + r.bx * side, "y": y.ravel() + r.by * side, **{c: img[..., k].ravel().astype(int) for k, c in enumerate(channels)}})

    return blocks.mapInPandas(unpack, f"{KEY} long, x int, y int, " + ", ".join(f"{c} int" for c in channels))


def _array(r, side: int) -> np.ndarray:
    return np.frombuffer(r.data, np.uint8).reshape(min(side, r.height - r.by * side), min(side, r.width - r.bx * side), r.channels)


def on_windows(blocks: DataFrame, side: int, halo: int, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """f over every block with ``halo`` more pixels on all sides (the picture's edge repeated beyond it), giving the block alone."""
    if not 0 <= halo <= side:
        raise ValueError("halo: 0 to the side of a block")

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                img = _array(r, side)
                h, w = img.shape[:2]
                last = (r.width - 1) // side, (r.height - 1) // side
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        if not (0 <= r.bx + dx <= last[0] and 0 <= r.by + dy <= last[1]):
                            continue
                        rows = slice(0, halo) if dy < 0 else slice(max(0, h - halo), h) if dy > 0 else slice(0, h)
                        cols = slice(0, halo) if dx < 0 else slice(max(0, w - halo), w) if dx > 0 else slice(0, w)
                        piece = img[rows, cols]
                        if piece.size:
                            out.append((r.image_id, r.bx + dx, r.by + dy, r.width, r.height, r.channels, -dx, -dy, piece.shape[0], piece.shape[1], np.ascontiguousarray(piece).tobytes()))
            yield pd.DataFrame(out, columns=[*(c.split()[0] for c in SCHEMA.split(", ")[:-1]), "dx", "dy", "h", "w", "data"])

    def assemble(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        h, w = min(side, r.height - r.by * side), min(side, r.width - r.bx * side)
        left, top = halo if r.bx else 0, halo if r.by else 0
        full = np.zeros((top + h + halo, left + w + halo, r.channels), np.uint8)
        bottom = right = 0
        for p in pdf.itertuples():
            y = 0 if p.dy < 0 else top + h if p.dy > 0 else top
            x = 0 if p.dx < 0 else left + w if p.dx > 0 else left
            full[y : y + p.h, x : x + p.w] = np.frombuffer(p.data, np.uint8).reshape(p.h, p.w, r.channels)
            bottom, right = max(bottom, y + p.h), max(right, x + p.w)
        full = full[:bottom, :right]
        around = ((halo - top, max(0, top + h + halo - bottom)), (halo - left, max(0, left + w + halo - right)), (0, 0))
        data = np.ascontiguousarray(f(np.pad(full, around, "edge")), np.uint8)
        return pd.DataFrame([(r[KEY], r.bx, r.by, r.width, r.height, data.shape[2], data.tobytes())], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    pieces = blocks.mapInPandas(send, SCHEMA.rsplit(", ", 1)[0] + ", dx int, dy int, h int, w int, data binary")
    return pieces.groupBy(KEY, "bx", "by").applyInPandas(assemble, SCHEMA)


def median_of(padded: np.ndarray, w: int, h: int, halo: int) -> np.ndarray:
    """The upper median of w by h windows, by channel: counts of all 256 values over a rectangle come from four corners of their
    running sums, so that the work doesn't grow with the window."""
    rows, cols = padded.shape[0] - 2 * halo, padded.shape[1] - 2 * halo
    out = np.zeros((rows, cols, padded.shape[2]), np.uint8)
    top, left, most = halo - h // 2, halo - w // 2, w * h // 2
    for k in range(padded.shape[2]):
        part = padded[top : top + rows + h - 1, left : left + cols + w - 1, k]
        step = max(1, (1 << 22) // (256 * (cols + w)))  # rows at a time: bounded memory
        for y in range(0, rows, step):
            n = min(step, rows - y)
            seen = part[y : y + n + h - 1]
            sums = np.zeros((seen.shape[0] + 1, seen.shape[1] + 1, 256), np.int32)
            np.put_along_axis(sums[1:, 1:], seen[..., None].astype(np.int64), 1, 2)
            sums = sums.cumsum(0).cumsum(1)
            counts = sums[h : h + n, w : w + cols] - sums[:n, w : w + cols] - sums[h : h + n, :cols] + sums[:n, :cols]
            out[y : y + n, :, k] = (counts.cumsum(2) > most).argmax(2)
    return out


def convolved(padded: np.ndarray, kernel: np.ndarray, halo: int, divisor: int | None = None, bias: int = 0) -> np.ndarray:
    """``neighbors.convolve`` of r, g, b, a on a padded block: transparent neighbours count for alpha alone."""
    h, w = kernel.shape
    rows, cols = padded.shape[0] - 2 * halo, padded.shape[1] - 2 * halo
    total = divisor or int(kernel.sum()) or 1
    sums, off = np.zeros((rows, cols, 4), np.int64), np.zeros((rows, cols), np.int64)
    for i, j in zip(*np.nonzero(kernel), strict=True):
        weight, at = int(kernel[i, j]), padded[halo - h // 2 + i :, halo - w // 2 + j :][:rows, :cols].astype(np.int64)
        seen = at[..., 3] > 0
        off += np.where(seen, 0, weight)
        sums[..., 3] += at[..., 3] * weight
        sums[..., :3] += np.where(seen[..., None], at[..., :3] * weight, 0)
    part = (total - off)[..., None]
    colors = np.where(part != 0, np.trunc(sums[..., :3] / np.where(part != 0, part, 1)), 0)
    return np.clip(np.concatenate([colors, np.trunc(sums[..., 3:] / total)], 2) + bias, 0, 255).astype(np.uint8)


def median_blocks(blocks: DataFrame, w: int, h: int, side: int = 64) -> DataFrame:
    halo = max(w, h) // 2
    return on_windows(blocks, side, halo, lambda img: median_of(img, w, h, halo))


def convolve_blocks(blocks: DataFrame, kernel: list[list[int]], side: int = 64, divisor: int | None = None, bias: int = 0) -> DataFrame:
    weights = np.array(kernel)
    halo = max(weights.shape) // 2
    return on_windows(blocks, side, halo, lambda img: convolved(img, weights, halo, divisor, bias))
