"""Native grids of enlarged pixel art: pitch and phase of both axes, cells of a fractional grid, and how well a grid fits.

A cell of a grid with pitch p and phase o is the pixels whose centres lie between o + k p and o + (k + 1) p.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spritespark.operators.joins import shuffled

KEYS = ("image_id",)
#: An axis with fewer peaks has no grid.
PEAKS = 6
#: Peaks farther apart, counted in peaks, make no hypothesis; nor do more cells between two peaks.
REACH = 8


def enlarge(pixels: DataFrame, pitch: float | Column, x0: float | Column = 0, y0: float | Column = 0) -> DataFrame:
    """Every pixel as the block of pixels that it covers after scaling by a pitch of any size and moving by (x0, y0)."""
    pitch, x0, y0 = (v if isinstance(v, Column) else F.lit(float(v)) for v in (pitch, x0, y0))
    edge = lambda c, o: F.floor(c * pitch + o + 0.5).cast("int")
    block = lambda c, o: F.explode(F.sequence(edge(F.col(c), o), edge(F.col(c) + 1, o) - 1))
    return pixels.withColumn("__x", block("x", x0)).withColumn("__y", block("y", y0)).drop("x", "y").withColumnsRenamed({"__x": "x", "__y": "y"})


def peaks_of(signal: np.ndarray) -> np.ndarray:
    """Places of the local maxima that stand out from the mean of the part that has any signal."""
    some = np.flatnonzero(signal > 0.1 * signal.max(initial=0.0))
    if not len(some):
        return some
    level = 1.5 * signal[some[0] : some[-1] + 1].mean()
    s = np.r_[-1.0, signal, -1.0]
    return np.flatnonzero((signal > level) & (signal > s[:-2]) & (signal >= s[2:]))


def hypotheses(peaks: np.ndarray, low: float, high: float, most: int = 16) -> np.ndarray:
    """The pitches for which most pairs of nearby peaks vote, each pair for its distance over 1 to REACH cells."""
    votes = [(peaks[k:] - peaks[:-k]) / m for k in range(1, min(REACH, len(peaks) - 1) + 1) for m in range(1, REACH + 1)]
    votes = np.concatenate(votes) if votes else np.zeros(0)
    votes = votes[(votes >= low) & (votes <= high)]
    if not len(votes):
        return votes
    kind = np.round(np.log(votes) / 0.01).astype(np.int64)  # classes of one per cent
    kinds, at, n = np.unique(kind, return_inverse=True, return_counts=True)
    means = np.bincount(at, votes) / n
    return means[np.argsort(-n, kind="stable")[:most]]


def circular_phase(peaks: np.ndarray, pitch: float) -> float:
    """The phase about which the peaks lie, as the direction of their mean on a circle of one pitch."""
    return float(np.angle(np.exp(2j * np.pi * peaks / pitch).mean()) * pitch / (2 * np.pi)) % pitch


def fitted(peaks: np.ndarray, pitch: float) -> tuple[float, float, float]:
    """(fit, pitch, phase): a line through the peaks by their number of cells, without those that lie off it.

    The first numbers come from the peaks' distances one by one, so that a hypothesis that is a little off keeps count
    across the image. fit weighs the share of peaks on the line and the share of its cells' edges that have a peak.
    """
    number = np.r_[0, np.cumsum(np.round(np.diff(peaks) / pitch))]
    off = max(0.75, min(1.2, 0.12 * pitch))
    on = np.ones(len(peaks), bool)
    for turn in range(12):
        if on.sum() < 3 or number[on][-1] == number[on][0]:
            return 0.0, pitch, 0.0
        slope, start = np.polyfit(number[on], peaks[on], 1)
        if slope < 1.8:
            return 0.0, pitch, 0.0
        number = np.round((peaks - start) / slope)
        miss = np.abs(peaks - start - number * slope)
        inside = miss <= (off if turn > 3 else 2 * off)
        if turn > 4 and (inside == on).all():
            break
        on = inside
    cells = np.unique(number[on])
    share, teeth = on.mean(), len(cells) / (cells[-1] - cells[0] + 1) if len(cells) else 0.0
    return float(2 * share * teeth / max(1e-9, share + teeth)), float(slope), float(start % slope)


def pitch_of(signal: np.ndarray, low: float = 3.0, high: float = 64.0) -> tuple[float, float, float]:
    """(fit, pitch, phase) of one axis; a fit of 0 where there is no grid. Of equal fits the widest pitch counts."""
    peaks = peaks_of(signal)
    if len(peaks) < PEAKS:
        return 0.0, 1.0, 0.0
    found = [f for p in hypotheses(peaks, low, high) if low * 0.98 <= (f := fitted(peaks, p))[1] <= high * 1.02]
    fit, pitch, phase = max(found, key=lambda f: (round(f[0], 2), f[1]), default=(0.0, 1.0, 0.0))
    return (fit, pitch, phase) if fit else (0.0, 1.0, circular_phase(peaks, 1.0))


def native_grid(signal: DataFrame, low: float = 3.0, high: float = 64.0, least: float = 0.5, keys: tuple = KEYS) -> DataFrame:
    """signal: keys, axis ('x', 'y'), at, signal, as ``edge_signal`` gives it. (keys, pitch_x, pitch_y, phase_x, phase_y, fit).

    The pixels of an enlarged picture are square: the axis that fits better leads, and the other is looked for again within six per
    cent of its pitch. Pitch 1 and phase 0 where either axis fits less than ``least``. A group is two short vectors.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        axes = {}
        for axis in "xy":
            own = pdf[pdf.axis == axis]
            axes[axis] = np.zeros(int(own["at"].max()) + 1 if len(own) else 0)
            axes[axis][own["at"].to_numpy()] = own.signal.to_numpy()
        best = {a: pitch_of(s, low, high) for a, s in axes.items()}
        lead, other = ("x", "y") if best["x"][0] >= best["y"][0] else ("y", "x")
        if best[lead][0] >= least:
            p = best[lead][1]
            again = pitch_of(axes[other], 0.94 * p, 1.06 * p)
            if again[0] >= 0.4 and (again[0] >= best[other][0] or abs(best[other][1] - p) > 0.06 * p):
                best[other] = again
        fit = min(best["x"][0], best["y"][0])
        if fit < least:
            best = {a: (fit, 1.0, 0.0) for a in "xy"}
        return pd.DataFrame([(*(pdf[k].iloc[0] for k in keys), *(best[a][i] for i in (1, 2) for a in "xy"), fit)], columns=[*keys, "pitch_x", "pitch_y", "phase_x", "phase_y", "fit"])

    kinds = ", ".join(f"{k} {signal.schema[k].dataType.simpleString()}" for k in keys)
    return signal.select(*keys, "axis", "at", "signal").groupBy(*keys).applyInPandas(run, f"{kinds}, pitch_x double, pitch_y double, phase_x double, phase_y double, fit double")


def in_cells(pixels: DataFrame) -> DataFrame:
    """pixels with pitch_x, pitch_y, phase_x, phase_y -> with their cell (u, w) and the place in it (fx, fy), 0 to 1."""
    place = {a: (F.col(a) + 0.5 - F.col(f"phase_{a}")) / F.col(f"pitch_{a}") for a in "xy"}
    return pixels.withColumns({"u": F.floor(place["x"]).cast("int"), "w": F.floor(place["y"]).cast("int"), "fx": place["x"] - F.floor(place["x"]), "fy": place["y"] - F.floor(place["y"])})


def native_cells(pixels: DataFrame, grids: DataFrame, least: float = 0.45, margin: float = 0.22, keys: tuple = KEYS, alpha: str | None = "a", channels: tuple = ("r", "g", "b")) -> DataFrame:
    """(keys, u, w, channels): a cell's medians of the visible pixels inside its margins, rounded down.

    Cells of which less than ``least`` is visible are none. Margins hold what scaling has mixed; a cell with no visible pixel inside them
    takes all its visible ones.
    """
    seen = F.col(alpha) > 127 if alpha else F.lit(True)
    inner = seen & F.col("fx").between(margin, 1 - margin) & F.col("fy").between(margin, 1 - margin)
    at = in_cells(shuffled(pixels).join(grids.select(*keys, "pitch_x", "pitch_y", "phase_x", "phase_y"), list(keys))).withColumns({"__seen": seen, "__in": inner})
    both = at.groupBy(*keys, "u", "w").agg(F.avg(F.col("__seen").cast("int")).alias("__share"), *(F.coalesce(F.median(F.when(F.col("__in"), F.col(c))), F.median(F.when(F.col("__seen"), F.col(c)))).alias(c) for c in channels))
    return both.filter(F.col("__share") >= least).select(*keys, "u", "w", *(F.floor(c).cast("int").alias(c) for c in channels))


def grid_candidates(grids: DataFrame, pitches: list[float], phases: list[float], axes: str = "xy", keys: tuple = KEYS) -> DataFrame:
    """Each grid with its pitch and phase along each of ``axes`` moved by each of the given steps; numbered by image."""
    steps = lambda a, name: F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(o).alias("o")) for p in pitches for o in phases))).alias(name)
    out = grids.select(*keys, "pitch_x", "pitch_y", "phase_x", "phase_y")
    for a in axes:
        out = out.select("*", steps(a, "__s")).withColumns({f"pitch_{a}": F.round(F.col(f"pitch_{a}") + F.col("__s.p"), 6), f"phase_{a}": F.round(F.col(f"phase_{a}") + F.col("__s.o"), 6)}).drop("__s")
    return out.filter("pitch_x > 1 AND pitch_y > 1").dropDuplicates()


GRID = ("pitch_x", "pitch_y", "phase_x", "phase_y")


def compactness(pixels: DataFrame, grids: DataFrame, modes: int = 10, bin_: int = 6, keys: tuple = KEYS, alpha: str | None = "a", channels: tuple = ("r", "g", "b")) -> DataFrame:
    """(keys, pitch_x, pitch_y, phase_x, phase_y, compactness, cells): several grids an image, each with the mean distance of its cells'
    colours to the nearest of their ``modes`` most frequent ones, which are counted in bins. Least where cells are the picture's own.

    The pixels meet each candidate once; the cells, far fewer, are what is compared.
    """
    seen = F.col(alpha) > 127 if alpha else F.lit(True)
    each = in_cells(pixels.filter(seen).join(grids.select(*keys, *GRID), list(keys)))
    each = each.filter(F.col("fx").between(0.22, 0.78) & F.col("fy").between(0.22, 0.78))
    cells = each.groupBy(*keys, *GRID, "u", "w").agg(*(F.floor(F.median(c)).cast("int").alias(c) for c in channels))
    binned = cells.groupBy(*keys, *GRID, *((F.floor(F.col(c) / bin_) * bin_ + bin_ // 2).cast("int").alias(f"m{c}") for c in channels)).agg(F.count("*").alias("n"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), *(f"m{c}" for c in channels)))), 1, modes)
    modal = binned.groupBy(*keys, *GRID).agg(top.alias("modes"))  # one struct a colour bin of one image: bounded by its cells
    apart = F.array_min(F.transform("modes", lambda m: F.sqrt(sum(((F.col(c) - m[f"m{c}"]) * (F.col(c) - m[f"m{c}"])).cast("double") for c in channels))))
    return cells.join(modal, [*keys, *GRID]).groupBy(*keys, *GRID).agg(F.round(F.avg(apart), 6).alias("compactness"), F.count("*").alias("cells"))


def most_compact(scores: DataFrame, keys: tuple = KEYS) -> DataFrame:
    """Each image's grid of the least compactness; of equal ones that of the smallest pitches, then phases."""
    return scores.groupBy(*keys).agg(F.min(F.struct("compactness", *GRID, "cells")).alias("g")).select(*keys, "g.*")


def refined_grid(pixels: DataFrame, grids: DataFrame, rounds: tuple = ((0.06, 1.0), (0.02, 0.25)), keys: tuple = KEYS, alpha: str | None = "a", channels: tuple = ("r", "g", "b")) -> DataFrame:
    """Coarse to fine: each round moves pitch and phase by one step either way, one axis after the other, and keeps the most compact grid."""
    own = grids.select(*keys, *GRID)
    for pitch, phase in rounds:
        for axis in "xy":
            own = most_compact(compactness(pixels, grid_candidates(own, [-pitch, 0.0, pitch], [-phase, 0.0, phase], axis, keys), keys=keys, alpha=alpha, channels=channels), keys)
    return own
