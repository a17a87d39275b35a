"""Palettes made of pictures, and pictures made to fit palettes: cuts, clusters a sprite, carried errors, colour maps, packed sheets' rectangles.

Whatever compares colours compares distinct colours of one sprite with one palette; helpers see one sprite's bins or one picture.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spritespark.functions.color import oklab
from spritespark.operators.grouped import batch_rows, row_batches, whole_sheets
from spritespark.operators.lookups import weighted_distance
from spritespark.sources.files import stored

SPRITE = "sprite_id"
RGBA = ("r", "g", "b", "a")
#: Entries of a palette, at most.
ENTRIES = 256
#: Bits of a channel in the bins of a cut.
BITS = (5, 6, 5, 5)


def small_palette(palette: DataFrame) -> DataFrame:
    """The palette, to be broadcast: counted first, and refused beyond ENTRIES rows."""
    if palette.limit(ENTRIES + 1).count() > ENTRIES:
        raise ValueError(f"a palette has at most {ENTRIES} entries")
    return F.broadcast(palette)


def cut_boxes(bins: np.ndarray, counts: np.ndarray, colors: int) -> list[tuple[int, ...]]:
    """Median cut of bins (r, g, b, a; counts their pixels) into at most ``colors`` mean colours.

    The box of the largest volume is next, of equal ones the first made. It shrinks to what it holds and is cut along its longest
    side, the first of equal ones, where its first part comes to hold more than half; one that can't be cut is a colour.
    """
    full = [(1 << b) - 1 for b in BITS]
    queue, made, done = [], 0, []

    def add(inside: np.ndarray, low: list[int], high: list[int]) -> None:
        nonlocal made
        volume = int(np.prod([b - a + 1 for a, b in zip(low, high, strict=True)]))
        heapq.heappush(queue, (-volume, made, inside, low, high))
        made += 1

    def mean(inside: np.ndarray) -> tuple[int, ...]:
        n = counts[inside]
        return tuple(int(255 * (int((bins[inside, c] * n).sum()) // int(n.sum())) // full[c]) for c in range(4))

    add(np.arange(len(bins)), [0] * 4, list(full))
    while queue and len(queue) < colors:
        inside, low, high = heapq.heappop(queue)[2:]
        low, high = bins[inside].min(0).tolist(), bins[inside].max(0).tolist()
        side = max(range(4), key=lambda c: (high[c] - low[c], -c))
        upto = np.bincount(bins[inside, side] - low[side], counts[inside]).cumsum()
        at = int(np.argmax(2 * upto > upto[-1]))  # places from low to here hold more than half
        if upto[at] == upto[-1]:
            at -= 1
        if at < 0 or upto[at] == 0:
            if len(done) < colors:
                done.append(mean(inside))
                continue
            return done
        edge = low[side] + at
        first = bins[inside, side] <= edge
        add(inside[first], low, [edge if c == side else v for c, v in enumerate(high)])
        add(inside[~first], [edge + 1 if c == side else v for c, v in enumerate(low)], high)
    while queue and len(done) < colors:
        done.append(mean(heapq.heappop(queue)[2]))
    return done


def optimized_palettes(pixels: DataFrame, colors: int, order: tuple, mask_index: int | None = None, keys: tuple = (SPRITE,)) -> DataFrame:
    """(keys, idx, r, g, b, a): each sprite's colours in the order in which they come first, if it has at most ``colors`` of them, else a
    median cut on bins of 5, 6, 5 and 5 bits. ``order``: the columns that number pixels.

    Transparent pixels count for nothing. A mask index takes one of the colours' places and is (0, 0, 0, 0).
    """
    most = colors - (mask_index is not None)
    seen = stored(pixels.filter("a > 0").groupBy(*keys, *RGBA).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first")), "colors")
    many = seen.groupBy(*keys).agg((F.count("*") > min(most, ENTRIES)).alias("many"))
    both = seen.join(many, list(keys))
    place = F.transform(F.array_sort(F.collect_list(F.struct("first", *RGBA))), lambda e, i: F.struct(i.cast("int").alias("idx"), *(e[c].cast("int").alias(c) for c in RGBA)))
    exact = both.filter("NOT many").groupBy(*keys).agg(place.alias("e")).select(*keys, F.inline("e"))  # at most ENTRIES a sprite
    bins = both.filter("many").groupBy(*keys, *(F.shiftright(c, 8 - b).alias(c) for c, b in zip(RGBA, BITS, strict=True))).agg(F.sum("n").alias("n"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        found = cut_boxes(pdf[list(RGBA)].to_numpy(np.int64), pdf.n.to_numpy(np.int64), most)
        return pd.DataFrame([(*(pdf[k].iloc[0] for k in keys), i, *c) for i, c in enumerate(found)], columns=[*keys, "idx", *RGBA])

    kinds = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys)
    out = exact.unionByName(bins.groupBy(*keys).applyInPandas(cut, f"{kinds}, idx int, r int, g int, b int, a int"))
    if mask_index is None:
        return out
    moved = out.withColumn("idx", F.when(F.col("idx") >= mask_index, F.col("idx") + 1).otherwise(F.col("idx")))
    mask = out.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= mask_index).select(*keys, F.lit(mask_index).alias("idx"), *(F.lit(0).alias(c) for c in RGBA))
    return moved.unionByName(mask)


def mapped_by_cells(pixels: DataFrame, palette: DataFrame, order: tuple, mask_index: int) -> DataFrame:
    """pixels with idx: the first colour seen in a cell of 5, 5, 5 and 3 bits decides the entry of all colours of that cell.

    ``order`` numbers the pixels of the whole corpus. 65,536 cells at most meet the palette, and the map is broadcast back.
    """
    cell = F.shiftleft(F.shiftright("r", 3), 13) + F.shiftleft(F.shiftright("g", 3), 8) + F.shiftleft(F.shiftright("b", 3), 3) + F.shiftright("a", 5)
    firsts = pixels.groupBy(cell.alias("cell")).agg(F.min(F.struct(*order, *RGBA)).alias("f")).select("cell", *(F.col(f"f.{c}").alias(c) for c in RGBA))
    entries = small_palette(palette.filter(F.col("idx") != mask_index).select("idx", *(F.col(c).alias(f"p{c}") for c in RGBA)))
    near = firsts.join(entries, how="cross").groupBy("cell", *RGBA).agg(F.min(F.struct(weighted_distance(), "idx")).alias("m"))  # 65,536 cells by 256 entries at most
    cells = near.select("cell", F.when(F.shiftright("a", 3) == 0, mask_index).otherwise(F.col("m.idx")).alias("idx"))
    return pixels.withColumn("cell", cell).join(F.broadcast(cells), "cell").drop("cell")


def diffused(pixels: DataFrame, palette: DataFrame, mask_index: int, factor: int = 100, key: str = "image_id") -> DataFrame:
    """(key, x, y, idx): rows in turning direction, each pixel's whole-number rest carried on in sixteenths: 7 ahead, 3, 5 and 1 below.

    The nearest entry is looked for by the weights of ``weighted_distance`` and remembered by colour; a pixel that takes the mask index or a
    transparent entry leaves its alpha alone as the rest. factor: per cent of the rest that is carried.
    """
    entries = [tuple(r) for r in palette.select("idx", *RGBA).orderBy("idx").limit(ENTRIES + 1).collect()]
    if len(entries) > ENTRIES:
        raise ValueError(f"a palette has at most {ENTRIES} entries")
    usable = [e for e in entries if e[0] != mask_index]
    table = np.array([e[1:] for e in usable], np.int64).reshape(-1, 4) >> 3
    weights = np.array([30, 59, 11, 8], np.int64) ** 2
    by_idx = {e[0]: e[1:] for e in entries}
    part = lambda v, n, of: -(-v * n // of) if v < 0 else v * n // of

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, h = int(pdf.x.max()) + 1, int(pdf.y.max()) + 1
        img = np.zeros((h, w, 4), np.int64)
        img[pdf.y.to_numpy(), pdf.x.to_numpy()] = pdf[list(RGBA)].to_numpy()
        known: dict[tuple, int] = {}
        below = [[0] * 4 for _ in range(w + 2)]
        out = np.zeros((h, w), np.int64)
        for y, row in enumerate(img.tolist()):
            now, below = below, [[0] * 4 for _ in range(w + 2)]
            step = -1 if y % 2 else 1
            for x in range(w)[::step]:
                v = tuple(min(255, max(0, c + e)) for c, e in zip(row[x], now[x + 1], strict=True))
                idx = known.get(v)
                if idx is None:
                    if v[3] >> 3 == 0 or not usable:
                        idx = mask_index
                    else:
                        idx = usable[int((((table - (np.array(v) >> 3)) ** 2) * weights).sum(1).argmin())][0]
                    known[v] = idx
                out[y, x] = idx
                own = by_idx.get(idx)
                if idx == mask_index or own is None or own[3] == 0:
                    own = (*row[x][:3], 0)
                for c in range(4):
                    if rest := part(v[c] - own[c], factor, 100):
                        now[x + 1 + step][c] += part(rest, 7, 16)
                        below[x + 1 - step][c] += part(rest, 3, 16)
                        below[x + 1][c] += part(rest, 5, 16)
                        below[x + 1 + step][c] += part(rest, 1, 16)
        y, x = np.indices(out.shape)
        return pd.DataFrame({key: pdf[key].iloc[0], "x": x.ravel(), "y": y.ravel(), "idx": out.ravel()})

    return pixels.select(key, "x", "y", *RGBA).groupBy(key).applyInPandas(run, f"{key} long, x int, y int, idx int")


def _apart(one: str, two: str) -> Column:
    return sum(((F.col(f"{one}{i}") - F.col(f"{two}{i}")) * (F.col(f"{one}{i}") - F.col(f"{two}{i}")) for i in range(3)), F.lit(0.0))


def first_centres(colors: DataFrame, k: int, seed: int | None = None, key: str = SPRITE) -> DataFrame:
    """(key, idx, m0, m1, m2): k colours a sprite. Without a seed the most frequent ones; else k-means++: each next one is drawn in proportion to its
    pixels and its squared distance from those before, by an exponential race of hashes, an aggregate a draw for all sprites at once."""
    if seed is None:
        top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), *"rgb", "c0", "c1", "c2"))), 1, k)  # one sprite's colours
        return colors.groupBy(key).agg(top.alias("t")).select(key, F.posexplode("t").alias("idx", "t")).select(key, "idx", *(F.col(f"t.c{i}").alias(f"m{i}") for i in range(3)))
    chosen, far = None, colors.withColumn("d", F.lit(1.0))
    for j in range(k):
        chance = (F.pmod(F.xxhash64(key, *"rgb", F.lit(seed + j)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        race = F.when(F.col("d") > 0, -F.log(chance) / (F.col("d") * F.col("n")))
        drawn = stored(far.groupBy(key).agg(F.min_by(F.struct(*(F.col(f"c{i}").alias(f"m{i}") for i in range(3))), F.struct(race, *"rgb")).alias("m"), F.max("d").alias("left")).filter("left > 0").select(key, F.lit(j).alias("idx"), "m.*"), "drawn")
        chosen = drawn if chosen is None else chosen.unionByName(drawn)
        new = far.join(drawn, key, "left").withColumn("d", F.least(F.col("d") if j else F.lit(float("inf")), F.coalesce(_apart("c", "m"), F.col("d")))).drop("idx", "m0", "m1", "m2")
        far = stored(new, "distances")
    return chosen


def kmeans_palettes(histogram: DataFrame, k: int, rounds: int = 25, seed: int | None = 0, key: str = SPRITE) -> tuple[DataFrame, DataFrame]:
    """One palette of k colours a sprite by Lloyd's rounds in OKLab over (key, r, g, b, n), all sprites at once.

    ((key, idx, m0, m1, m2, colors, n), (key, round, cost)): the centres with their colours and pixels, and the sum of squared distances by
    pixel before each round. A centre that no colour is nearest to moves to the colour that is farthest from its own centre.
    """
    colors = stored(histogram.select(key, *"rgb", "n").withColumns({f"c{i}": c for i, c in enumerate(oklab())}), "colors")
    centres, costs = stored(first_centres(colors, k, seed, key), "centres"), None
    for turn in range(rounds):
        near = stored(colors.join(centres, key).groupBy(key, *"rgb", "n", "c0", "c1", "c2").agg(F.min(F.struct(_apart("c", "m").alias("d"), "idx")).alias("m")).select(key, *"rgb", "n", "c0", "c1", "c2", "m.d", "m.idx"), "nearest")
        cost = near.groupBy(key).agg(F.sum(F.col("d") * F.col("n")).alias("cost")).select(key, F.lit(turn).alias("round"), "cost")
        costs = cost if costs is None else costs.unionByName(cost)
        means = near.groupBy(key, "idx").agg(*((F.sum(F.col(f"c{i}") * F.col("n")) / F.sum("n")).alias(f"m{i}") for i in range(3)))
        empty = centres.select(key, "idx").join(means, [key, "idx"], "left_anti").groupBy(key).agg(F.array_sort(F.collect_set("idx")).alias("free"))  # at most k
        far = near.join(empty, key).groupBy(key, "free").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("d")).alias("less"), *"rgb", "c0", "c1", "c2"))), 1, k).alias("l"))
        refilled = far.select(key, F.explode(F.arrays_zip("free", F.slice("l", 1, F.size("free")).alias("l"))).alias("e")).filter("e.free IS NOT NULL AND e.l.less < 0").select(key, F.col("e.free").alias("idx"), *(F.col(f"e.l.c{i}").alias(f"m{i}") for i in range(3)))
        centres = stored(means.unionByName(refilled), "centres")
    last = colors.join(centres, key).groupBy(key, *"rgb", "n").agg(F.min(F.struct(_apart("c", "m").alias("d"), "idx")).alias("m"))
    sums = last.groupBy(key, F.col("m.idx").alias("idx")).agg(F.count("*").alias("colors"), F.sum("n").alias("n"))
    return centres.join(sums, [key, "idx"], "left").fillna(0, ["colors", "n"]), costs


def free_rectangles(sizes: list[tuple[int, int]], width: int, most: int | None = None) -> tuple[list[tuple[int, int]], int] | None:
    """Places of the sizes (w, h), given in the order of placing, and the height used, on a strip of this width; None where it passes ``most``.

    Free rectangles overlap and are each as large as can be. A size goes to the one whose top is highest, then the leftmost; what it covers is cut out
    of all of them, and those inside others go.
    """
    deep = sum(h for _, h in sizes) + 1
    free, places, bottom = [(0, 0, width, deep)], [], 0
    for w, h in sizes:
        fit = min(((y, x) for x, y, fw, fh in free if w <= fw and h <= fh), default=None)
        if fit is None:
            return None
        y, x = fit
        places.append((x, y))
        bottom = max(bottom, y + h)
        if most is not None and bottom > most:
            return None
        cut = []
        for fx, fy, fw, fh in free:
            if x >= fx + fw or x + w <= fx or y >= fy + fh or y + h <= fy:
                cut.append((fx, fy, fw, fh))
                continue
            cut += [r for r in ((fx, fy, x - fx, fh), (x + w, fy, fx + fw - x - w, fh), (fx, fy, fw, y - fy), (fx, y + h, fw, fy + fh - y - h)) if r[2] > 0 and r[3] > 0]
        cut = sorted(set(cut), key=lambda r: (-r[2] * r[3], r))
        free = []
        for r in cut:
            if not any(r[0] >= o[0] and r[1] >= o[1] and r[0] + r[2] <= o[0] + o[2] and r[1] + r[3] <= o[1] + o[3] for o in free):
                free.append(r)
    return places, bottom


def packed_sheets(samples: DataFrame, padding: int = 0, border: int = 0, sheet: str = "sheet", order: str = "item", content: str | None = None) -> DataFrame:
    """(sheet, item, x, y, w, h, width, height): samples on the smallest sheet found; samples of equal ``content`` share one place.

    Widths from the widest sample to that of a square and a half are tried in twelve steps, the highest samples first. One sheet's samples are in memory at a time.
    """

    def packed(rows: list[tuple]) -> list[tuple]:
        leads: dict = {}  # of each content, the first item, rows being in their order
        for r in rows:
            leads.setdefault(r[4] if content else r[1], r)
        own = sorted(leads.values(), key=lambda r: (-r[3], -r[2], r[1]))
        sizes = [(r[2] + padding, r[3] + padding) for r in own]
        widest, area = max(w for w, _ in sizes), sum(w * h for w, h in sizes)
        ideal = max(widest, int(np.ceil(1.5 * np.sqrt(area))))
        best = None
        for width in sorted({widest + (ideal - widest) * k // 11 for k in range(12)}):
            found = free_rectangles(sizes, width, None if best is None else (best[0] - 1) // width)
            if found:
                used = max(x + w for (x, _), (w, _) in zip(found[0], sizes, strict=True))
                if best is None or (used * found[1], used) < best[:2]:
                    best = (used * found[1], used, found)
        _, used, (places, bottom) = best
        at = {(r[4] if content else r[1]): place for r, place in zip(own, places, strict=True)}
        x, y = zip(*(at[r[4] if content else r[1]] for r in rows), strict=True)
        return [(*r[:2], i + border, j + border, *r[2:4], used - padding + 2 * border, bottom - padding + 2 * border) for r, i, j in zip(rows, x, y, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sheets = (list(rows) for _, rows in groupby(batch_rows(batches), key=lambda r: r[0]))
        return row_batches((r for rows in sheets for r in packed(rows)), [sheet, order, "x", "y", "w", "h", "width", "height"])

    columns = [sheet, order, "w", "h", *([content] if content else [])]
    return whole_sheets(samples.select(*columns), sheet, order).mapInArrow(run, f"{sheet} long, {order} int, x int, y int, w int, h int, width int, height int")
