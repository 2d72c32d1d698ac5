"""Windowed sums, structural similarity and edges of pixel tables, by neighbours along rows and columns.

A pixel meets its neighbours in two steps, along its row and then along its column, so that no image has to fit into a
task and no halo has to be copied: each step deals the pixels to rows or columns of one case.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canopy.operators.core import components, local_roots, runs, written


def gray(p: str = "") -> Column:
    """Lightness of a pixel as a whole number: 0.299 r + 0.587 g + 0.114 b in steps of 2^-14, rounded."""
    return F.floor((F.col(p + "r") * 4899 + F.col(p + "g") * 9617 + F.col(p + "b") * 1868 + 8192) / 16384).cast("long")


def _along(axis: str) -> tuple[str, str]:
    return ("y", "x") if axis == "x" else ("x", "y")


def window_sums(pixels: DataFrame, values: dict[str, Column], size: int = 7) -> DataFrame:
    """(case_id, x, y, values...): sums over the square window about each pixel whose window lies in the image whole."""
    half, df = size // 2, pixels.select("case_id", "x", "y", *[v.alias(n) for n, v in values.items()]).withColumn("_n", F.lit(1))
    for axis in ("x", "y"):
        line, at = _along(axis)
        over = W.partitionBy("case_id", line).orderBy(at).rangeBetween(-half, half)
        df = df.select("case_id", "x", "y", *[F.sum(n).over(over).alias(n) for n in [*values, "_n"]])
    return df.where(F.col("_n") == size * size).drop("_n")


def ssim_map(pixels: DataFrame, size: int = 7, peak: float = 255.0) -> DataFrame:
    """(case_id, x, y, ssim) of the two sides' lightness in square windows, with sample covariances."""
    a, b, n = gray("a"), gray("b"), size * size
    s = window_sums(pixels, {"a": a, "b": b, "aa": a * a, "bb": b * b, "ab": a * b}, size)
    mean = lambda c: F.col(c) / n
    spread = lambda c, d: (mean(c + d) - mean(c) * mean(d)) * (n / (n - 1))
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    top = (2 * mean("a") * mean("b") + c1) * (2 * spread("a", "b") + c2)
    return s.select("case_id", "x", "y", (top / ((mean("a") * mean("a") + mean("b") * mean("b") + c1) * (spread("a", "a") + spread("b", "b") + c2))).alias("ssim"))


def ssim(pixels: DataFrame, size: int = 7) -> DataFrame:
    """(case_id, windows, ssim): mean over all whole windows; 1 where the image holds none."""
    m = ssim_map(pixels, size).groupBy("case_id").agg(F.count("*").alias("windows"), F.avg("ssim").alias("ssim"))
    return pixels.select("case_id").distinct().join(m, "case_id", "left").select("case_id", F.coalesce("windows", F.lit(0)).alias("windows"), F.coalesce("ssim", F.lit(1.0)).alias("ssim"))


def tile_ssim(pixels: DataFrame, tile: int = 8, size: int = 7) -> DataFrame:
    """(case_id, i, j, n, ssim, worst) of half-overlapping square tiles, over the windows centred in each."""
    half = tile // 2
    two = lambda c: F.explode(F.array(F.floor(F.col(c) / half) - 1, F.floor(F.col(c) / half)))
    m = ssim_map(pixels, size).withColumn("i", two("x")).withColumn("j", two("y")).where("i >= 0 AND j >= 0")
    return m.groupBy("case_id", "i", "j").agg(F.count("*").alias("n"), F.avg("ssim").alias("ssim"), F.min("ssim").alias("worst"))


def _beside(value: str, axis: str, step: int) -> Column:
    """The neighbour's value ``step`` pixels on along an axis; null outside the image."""
    line, at = _along(axis)
    return F.max(value).over(W.partitionBy("case_id", line).orderBy(at).rangeBetween(step, step))


def gradients(pixels: DataFrame, value: Column) -> DataFrame:
    """(case_id, x, y, gx, gy): Sobel gradients; beyond a border the border's own values count."""
    p = pixels.select("case_id", "x", "y", value.alias("v"))
    before, after = F.coalesce(_beside("v", "x", -1), "v"), F.coalesce(_beside("v", "x", 1), "v")
    p = p.select("case_id", "x", "y", (after - before).alias("d"), (before + 2 * F.col("v") + after).alias("s"))
    up, down = (lambda c: F.coalesce(_beside(c, "y", -1), c)), (lambda c: F.coalesce(_beside(c, "y", 1), c))
    return p.select("case_id", "x", "y", (up("d") + 2 * F.col("d") + down("d")).alias("gx"), (down("s") - up("s")).alias("gy"))


#: Tangent of 22.5 degrees in steps of 2^-15 (fixed value).
_TAN = 13573


def _aslant(value: str, line: Column, step: int) -> Column:
    """The neighbour's value ``step`` pixels on along a diagonal (x and y change by one a step); null outside the image."""
    return F.max(value).over(W.partitionBy("case_id", line).orderBy("x").rangeBetween(step, step))


def thin_ridges(g: DataFrame, low: int = 0) -> DataFrame:
    """(case_id, x, y, m): pixels whose magnitude |gx| + |gy| is above ``low`` and the largest across their edge's direction.

    Each of the eight neighbours is looked up along a line through both pixels, so that none is missed where an image's
    rows end at different columns. Pixels of ``low`` or less never outdo one above it and are left out first.
    """
    g = g.withColumn("m", F.abs("gx") + F.abs("gy")).where(F.col("m") > low)
    g = g.withColumns({"left": _beside("m", "x", -1), "right": _beside("m", "x", 1)}).withColumns({"up": _beside("m", "y", -1), "down": _beside("m", "y", 1)})
    falling_line, rising_line = F.col("x") - F.col("y"), F.col("x") + F.col("y")
    g = g.withColumns({"left_up": _aslant("m", falling_line, -1), "right_down": _aslant("m", falling_line, 1)})
    g = g.withColumns({"left_down": _aslant("m", rising_line, -1), "right_up": _aslant("m", rising_line, 1)})
    of = lambda side: F.coalesce(F.col(side), F.lit(0))
    ax, ay, m = F.abs("gx"), F.abs("gy") * 32768, F.col("m")
    flat, steep = ay < ax * _TAN, ay > ax * _TAN + ax * 65536
    falling = (F.col("gx") < 0) != (F.col("gy") < 0)
    slant = F.when(falling, (m > of("right_up")) & (m > of("left_down"))).otherwise((m > of("left_up")) & (m > of("right_down")))
    keep = F.when(flat, (m > of("left")) & (m >= of("right"))).when(steep, (m > of("up")) & (m >= of("down"))).otherwise(slant)
    return g.where(keep).select("case_id", "x", "y", "m")


def _sorted(df: DataFrame) -> DataFrame:
    """``df`` to be met by a sort-merge join: sides of pixels pack so well that by their shuffled size they would be broadcast
    through the driver, where they take many times that."""
    return df.hint("merge")


#: Pixels a side of what a task holds at once of an image, and how far beyond it a ridge is read.
TILE, HALO = 128, 2


def edges(pixels: DataFrame, value: Column | None = None, low: int = 40, high: int = 120) -> DataFrame:
    """(case_id, x, y) of edge pixels (P10): thin ridges above ``low`` that hang together with one above ``high``.

    Ridge pixels are linked to their eight neighbours; a connected part without a strong pixel is left out.
    """
    return side_edges(pixels, {"": gray() if value is None else value}, low, high).drop("side")


def side_edges(pixels: DataFrame, values: dict[str, Column], low: int = 40, high: int = 120, tile: int = TILE) -> DataFrame:
    """(case_id, x, y, side): ``edges`` of each of several values of one image.

    Pixels are dealt once, to square tiles with those up to ``HALO`` beyond, which is as far as a ridge sees; parts that lie in one tile
    are settled there, and only those that go on in another one are linked across tiles. Pixels without a case hang together with none.
    """
    kind = dict(pixels.dtypes)["case_id"]
    p = pixels.select("case_id", "x", "y", *[v.cast("double").alias(f"v{k}") for k, v in enumerate(values.values())]).where("x IS NOT NULL AND y IS NOT NULL")
    near = lambda c: F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + o) / tile) for o in (-HALO, HALO)])))
    t = p.withColumn("i", near("x")).withColumn("j", near("y")).withColumns({"_none": F.col("case_id").isNull().cast("int"), "_case": F.coalesce("case_id", F.lit(0).cast(kind))})
    t = t.repartition("_none", "_case", "i", "j").sortWithinPartitions("_none", "_case", "i", "j")
    own = ", ".join(f"{c} {k}" for c, k in pixels.select("case_id", "x", "y").dtypes)
    parts = written(t.mapInArrow(_tile_ridges(list(values), low, high, tile), f"{own}, side string, open boolean, strong boolean, px long, py long"))
    at = ["case_id", "side", "x", "y"]
    across = parts.where("open")
    settled = parts.where("NOT open").select("case_id", "x", "y", "side")
    if across.isEmpty():
        return settled
    ridge = across.withColumn("v", F.xxhash64("case_id", "side", "px", "py"))
    rim = ridge.where(f"pmod(x, {tile}) IN (0, {tile - 1}) OR pmod(y, {tile}) IN (0, {tile - 1})")
    forward = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1))])
    to = rim.select("case_id", "side", "x", "y", F.col("v").alias("a"), F.explode(forward).alias("o")).select("case_id", "side", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "a")
    part = components(to.join(_sorted(rim.select(*at, F.col("v").alias("b"))), at).where("a <> b").select("a", "b"))
    named = ridge.join(_sorted(part), "v", "left").withColumn("c", F.coalesce("component", "v"))
    strong = named.where("strong").select("c").distinct()
    return settled.unionByName(named.join(_sorted(strong), "c", "left_semi").select("case_id", "x", "y", "side"))


def _tile_ridges(sides: list[str], low: int, high: int, tile: int):
    """Maps tiles of pixels to their ridges' parts: (case_id, x, y, side, open, strong, px, py), p the part's first pixel.

    ``open``: some pixel of the part has one beyond the tile beside it. Of other parts only strong ones are returned.
    """

    def ridges(x: np.ndarray, y: np.ndarray, v: np.ndarray):
        """m of each pixel, nan where it is no ridge; a value that is not known is nan."""
        wide = x.max() - x.min() + 3
        at = (y - y.min() + 1) * wide + x - x.min() + 1
        once = len(np.unique(at)) == len(at)

        def spread(values: np.ndarray) -> np.ndarray:
            grid = np.full(wide * (y.max() - y.min() + 3), np.nan)
            if once:
                grid[at] = values
            else:  # of pixels of one place the largest
                np.fmax.at(grid, at, values)
            return grid

        beside = lambda grid, dx, dy: grid[at + dy * wide + dx]
        known = lambda a, b: np.where(np.isnan(a), b, a)
        g = spread(v)
        before, after = known(beside(g, -1, 0), v), known(beside(g, 1, 0), v)
        d, s = after - before, before + 2 * v + after
        gd, gs = spread(d), spread(s)
        gx = known(beside(gd, 0, -1), d) + 2 * d + known(beside(gd, 0, 1), d)
        gy = known(beside(gs, 0, 1), s) - known(beside(gs, 0, -1), s)
        m = np.abs(gx) + np.abs(gy)
        m[~(m > low)] = np.nan
        gm = spread(m)
        of = lambda dx, dy: known(beside(gm, dx, dy), 0.0)
        ax, ay = np.abs(gx), np.abs(gy) * 32768
        flat, steep, falling = ay < ax * _TAN, ay > ax * _TAN + ax * 65536, (gx < 0) != (gy < 0)
        slant = np.where(falling, (m > of(1, -1)) & (m > of(-1, 1)), (m > of(-1, -1)) & (m > of(1, 1)))
        keep = np.where(flat, (m > of(-1, 0)) & (m >= of(1, 0)), np.where(steep, (m > of(0, -1)) & (m >= of(0, 1)), slant))
        return np.where(keep, m, np.nan)

    def parts(x: np.ndarray, y: np.ndarray, inner: np.ndarray, m: np.ndarray, linked: bool):
        """Rows of ridge pixels of the tile itself that are returned, and their open, strong and first row."""
        rows = np.flatnonzero(inner & ~np.isnan(m))
        wide = x.max() - x.min() + 3
        at = (y - y.min() + 1) * wide + x - x.min() + 1
        beyond = np.zeros(wide * (y.max() - y.min() + 3), bool)
        beyond[at[~inner]] = True
        here = at[rows]
        root, edge = np.arange(len(rows)), np.zeros(len(rows), bool)
        if linked:
            place = np.full(len(beyond), -1)
            place[here] = np.arange(len(rows))
            # rows of one pixel, then its neighbours
            links = [(np.arange(len(rows)), place[here])]
            for step in (1, wide - 1, wide, wide + 1):
                to = place[here + step]
                links.append((np.flatnonzero(to >= 0), to[to >= 0]))
                edge |= beyond[here + step] | beyond[here - step]
            root = local_roots(len(rows), *(np.concatenate(z) for z in zip(*links, strict=True)))
        is_open, is_strong = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
        np.logical_or.at(is_open, root, edge)
        np.logical_or.at(is_strong, root, m[rows] > high)
        is_open, is_strong = is_open[root], is_strong[root]
        keep = is_open | is_strong
        return rows[keep], is_open[keep], is_strong[keep], rows[root[keep]]

    def run(batches):
        for table, marks in runs(batches, ["_none", "_case", "i", "j"]):
            xs, ys = (table[c].to_numpy().astype(np.int64) for c in "xy")
            inner = (xs // tile == table["i"].to_numpy()) & (ys // tile == table["j"].to_numpy())
            linked, found = table["_none"].to_numpy() == 0, []
            for k in range(len(sides)):
                v = table[f"v{k}"].to_numpy(zero_copy_only=False).astype(float)
                for a, b in pairwise(marks):
                    with np.errstate(invalid="ignore"):
                        m = ridges(xs[a:b], ys[a:b], v[a:b])
                    rows, is_open, is_strong, first = parts(xs[a:b], ys[a:b], inner[a:b], m, bool(linked[a]))
                    if len(rows):
                        found.append((rows + a, is_open, is_strong, first + a, np.full(len(rows), k)))
            if found:
                rows, is_open, is_strong, first, side = (np.concatenate(z) for z in zip(*found, strict=True))
                own = table.select(["case_id", "x", "y"]).take(pa.array(rows))
                names = pa.array(sides).take(pa.array(side))
                for name, column in {"side": names, "open": pa.array(is_open), "strong": pa.array(is_strong), "px": pa.array(xs[first]), "py": pa.array(ys[first])}.items():
                    own = own.append_column(name, column)
                yield from own.combine_chunks().to_batches()

    return run


FEATURES = [
    "log_area", "log_aspect", "page_frac", "de_mean", "de_p90", "dl_share", "d_chroma", "tex_t", "tex_c", "edge_t", "edge_c", "ink_balance", "text_frac", "icon_frac", "shift_gain", "colour_gain",
]


def region_features(pixels: DataFrame, boxes: DataFrame, contents: DataFrame, reach: int = 3, ink: float = 10.0, low: int = 40, high: int = 120) -> DataFrame:
    """(case_id, node) and the 16 features of each box of two pixels or more a side, cut to its image.

    Pixels: both sides' colours; boxes: case_id, node, x, y, w, h; contents: case_id, kind (text or icon), x, y, w, h. An image
    reaches to its last row and column. Ink is what differs by more than ``ink`` from its side's median colour on the
    box's border (corners count twice). ``shift_gain``: what the best whole shift of up to ``reach`` pixels saves of
    the difference, over shifts that keep the box in the image; ``colour_gain``: what an affine map of each Lab channel saves.
    """
    from canopy.functions import color as C

    lab = lambda s: C.lab(*[F.col(s + c) for c in "rgb"])
    cover = lambda kind: _cells(contents.where(F.col("kind") == kind)).withColumn(kind, F.lit(True))
    coloured = lambda df: df.select(*[c for c in df.columns if c not in colours], *[v.alias(f"{s}{n}") for s, t in (("t", lab("a")), ("c", lab("b"))) for n, v in zip("lab", t, strict=True)])
    at, colours = ["case_id", "x", "y"], [s + c for s in "ab" for c in "rgb"]
    # dealt as they are; a colour in Lab takes many times the bytes
    p = pixels.select(*at, *colours)
    found = side_edges(pixels, {"et": gray("a"), "ec": gray("b")}, low, high)
    marks = [found.where(F.col("side") == c).select(*at, F.lit(True).alias(c)) for c in ("et", "ec")] + [cover("text"), cover("icon")]
    for mark in marks:
        p = p.join(_sorted(mark), at, "left")
    p = written(p)
    size = p.groupBy("case_id").agg((F.max("x") + 1).alias("pw"), (F.max("y") + 1).alias("ph"))
    b = boxes.join(_sorted(size), "case_id").select("case_id", "node", F.greatest("x", F.lit(0)).alias("x0"), F.greatest("y", F.lit(0)).alias("y0"), F.least(F.col("x") + F.col("w"), "pw").alias("x1"), F.least(F.col("y") + F.col("h"), "ph").alias("y1"), "pw", "ph")
    b = written(b.where("x1 - x0 >= 2 AND y1 - y0 >= 2"))
    rows = b.withColumn("y", F.explode(F.sequence("y0", F.col("y1") - 1)))
    key = ["case_id", "node"]
    # a box's pixels are dealt to it once, for all that is computed of them
    inside = coloured(written(p.join(_sorted(rows), ["case_id", "y"]).where("x >= x0 AND x < x1")).repartition(*key))
    gap = lambda one, two: F.sqrt(sum((F.col(one + n) - (F.col(two + n) if isinstance(two, str) else two[n])) ** 2 for n in "lab"))
    on_border = F.when((F.col("x") == F.col("x0")) | (F.col("x") == F.col("x1") - 1), 1).otherwise(0) + F.when((F.col("y") == F.col("y0")) | (F.col("y") == F.col("y1") - 1), 1).otherwise(0)
    medians = inside.withColumn("k", on_border).where("k > 0").groupBy(*key).agg(*[F.percentile(f"{s}{n}", 0.5, F.col("k")).alias(f"m{s}{n}") for s in "tc" for n in "lab"])
    fits = [f for n in "lab" for f in (F.regr_slope(f"t{n}", f"c{n}").alias(f"s{n}"), F.avg(f"t{n}").alias(f"at{n}"), F.avg(f"c{n}").alias(f"ac{n}"))]
    models = medians.join(_sorted(inside.groupBy(*key).agg(*fits)), key)
    q = inside.join(_sorted(models), key)
    fitted = {n: F.coalesce(F.col(f"s{n}"), F.lit(0.0)) * (F.col(f"c{n}") - F.col(f"ac{n}")) + F.col(f"at{n}") for n in "lab"}
    chroma = lambda s: F.sqrt(F.col(f"{s}a") ** 2 + F.col(f"{s}b") ** 2)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    g = q.withColumn("de", gap("t", "c")).groupBy(*key, "x0", "y0", "x1", "y1", "pw", "ph").agg(
        F.count("*").alias("n"), F.sum("de").alias("total"), F.avg("de").alias("de_mean"), F.percentile("de", 0.9).alias("de_p90"), F.avg(F.col("tl") - F.col("cl")).alias("dl"), F.avg(chroma("t") - chroma("c")).alias("d_chroma"),
        F.stddev_pop("tl").alias("tex_t"), F.stddev_pop("cl").alias("tex_c"), share(F.col("et")).alias("edge_t"), share(F.col("ec")).alias("edge_c"), share(gap("t", "mt") > ink).alias("it"), share(gap("c", "mc") > ink).alias("ic"),
        share(F.col("text")).alias("text_frac"), share(F.col("icon")).alias("icon_frac"), F.sum(gap("t", fitted)).alias("unfit"))
    tiles = lambda low, high: F.explode(F.sequence(F.floor(low / TILE), F.floor(high / TILE)))
    around = p.where("case_id IS NOT NULL").select(*at, *colours).withColumn("i", tiles(F.col("x") - reach, F.col("x") + reach)).withColumn("j", tiles(F.col("y") - reach, F.col("y") + reach))
    # boxes of one name are counted together, so none of them is whole where it lies
    met = b.withColumn("alone", F.count("*").over(W.partitionBy(*key)) == 1).withColumn("i", tiles(F.col("x0"), F.col("x1") - 1)).withColumn("j", tiles(F.col("y0"), F.col("y1") - 1))
    deal = ["case_id", "i", "j"]
    own = ", ".join(f"{c} {k}" for c, k in b.select(*key).dtypes)
    errors = written(around.groupBy(*deal).cogroup(met.groupBy(*deal)).applyInArrow(_tile_shifts(reach, TILE), f"{own}, whole boolean, dx int, dy int, e double, k long"))
    parts = errors.where("NOT whole").groupBy(*key, "dx", "dy").agg(F.sum("e").alias("e"), F.sum("k").alias("k"))
    best = parts.join(_sorted(g.select(*key, "n")), key).where("k = n").groupBy(*key).agg(F.min("e").alias("best"))
    best = best.unionByName(errors.where("whole").select(*key, F.col("e").alias("best")))
    f = g.join(_sorted(best), key, "left")
    gain = lambda left: F.greatest(F.lit(0.0), 1 - F.col(left) / (F.col("total") + 1e-6))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return f.select(
        *key, F.log10(w * h).alias("log_area"), F.log(w / h).alias("log_aspect"), (w * h / (F.col("pw") * F.col("ph"))).alias("page_frac"), "de_mean", "de_p90", (F.col("dl") / F.greatest("de_mean", F.lit(1e-3))).alias("dl_share"), "d_chroma",
        "tex_t", "tex_c", "edge_t", "edge_c", ((F.col("it") - F.col("ic")) / (F.col("it") + F.col("ic") + 1e-6)).alias("ink_balance"), "text_frac", "icon_frac", gain("best").alias("shift_gain"), gain("unfit").alias("colour_gain"))


def _tile_shifts(reach: int, tile: int):
    """Maps one tile's pixels, with those up to ``reach`` beyond, and its boxes to the boxes' differences under every shift that keeps
    them in the image: (case_id, node, whole, dx, dy, e, k), k pixels with a partner and e the sum over them.

    Of a box that lies in the tile ``whole`` only the least sum over all its pixels is returned.
    """
    steps = np.arange(-reach, reach + 1)
    dx, dy = (z.ravel() for z in np.meshgrid(steps, steps))

    def lab(table: pa.Table, side: str) -> np.ndarray:
        rgb = [table[side + c].to_numpy(zero_copy_only=False).astype(float) / 255 for c in "rgb"]
        r, g, b = (np.where(u <= 0.04045, u / 12.92, ((u + 0.055) / 1.055) ** 2.4) for u in rgb)
        curve = lambda t: np.where(t > 216 / 24389, np.cbrt(t), (t * (24389 / 27) + 16) / 116)
        fx, fy, fz = curve((r * 0.4124564 + g * 0.3575761 + b * 0.1804375) / 0.95047), curve(r * 0.2126729 + g * 0.7151522 + b * 0.0721750), curve((r * 0.0193339 + g * 0.1191920 + b * 0.9503041) / 1.08883)
        return np.stack([fy * 116 - 16, (fx - fy) * 500, (fy - fz) * 200])

    def run(pixels: pa.Table, boxes: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("case_id", "node", "whole", "dx", "dy", "e", "k")}
        if pixels.num_rows and boxes.num_rows:
            x, y = (pixels[c].to_numpy().astype(np.int64) for c in "xy")
            # a margin of ``reach`` all round, so that every shift stays in the grid
            left, top = x.min() - reach, y.min() - reach
            wide, high = x.max() - left + reach + 1, y.max() - top + reach + 1
            place = (y - top) * wide + x - left
            target, render = lab(pixels, "a"), lab(pixels, "b")
            order = np.argsort(place, kind="stable")
            first = np.append(True, place[order][1:] != place[order][:-1])
            # the candidate's pixels of one place, one below the other
            nth = np.empty(len(x), np.int64)
            nth[order] = np.arange(len(x)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            layers = []
            for n in range(nth.max() + 1):
                there, grid = np.zeros(wide * high, bool), np.full((3, wide * high), np.nan)
                there[place[nth == n]], grid[:, place[nth == n]] = True, render[:, nth == n]
                layers.append((there, grid))
            i, j = pixels["i"][0].as_py(), pixels["j"][0].as_py()
            inner = (x // tile == i) & (y // tile == j)
            off = dy * wide + dx
            for box in boxes.to_pylist():
                rows = np.flatnonzero(inner & (x >= box["x0"]) & (x < box["x1"]) & (y >= box["y0"]) & (y < box["y1"]))
                stays = (box["x0"] + dx >= 0) & (box["y0"] + dy >= 0) & (box["x1"] + dx <= box["pw"]) & (box["y1"] + dy <= box["ph"])
                if not len(rows):
                    continue
                to = place[rows][:, None] + off[stays]
                e, k, known = (np.zeros(to.shape[1]) for _ in range(3))
                for there, grid in layers:
                    gap = np.sqrt(((target[:, rows][:, :, None] - grid[:, to]) ** 2).sum(axis=0))
                    e, k, known = e + np.nansum(gap, axis=0), k + there[to].sum(axis=0), known + (~np.isnan(gap)).sum(axis=0)
                e = np.where(known > 0, e, np.nan)
                whole = box["alone"] and box["x0"] // tile == (box["x1"] - 1) // tile and box["y0"] // tile == (box["y1"] - 1) // tile
                if whole:
                    full = e[(k == len(rows)) & ~np.isnan(e)]
                    found = [(None, None, full.min(), len(rows))] if len(full) else []
                else:
                    found = [(a, b, None if np.isnan(s) else s, n) for a, b, s, n in zip(dx[stays], dy[stays], e, k, strict=True) if n]
                for row in found:
                    for c, z in zip(out, (box["case_id"], box["node"], whole, *row), strict=True):
                        out[c].append(z)
        kinds = {"case_id": boxes.schema.field("case_id").type, "node": boxes.schema.field("node").type, "whole": pa.bool_(), "dx": pa.int32(), "dy": pa.int32(), "e": pa.float64(), "k": pa.int64()}
        return pa.table({c: pa.array([int(n) for n in v] if c == "k" else v, kinds[c]) for c, v in out.items()})

    return run


def _cells(boxes: DataFrame) -> DataFrame:
    """(case_id, x, y): the pixels that boxes cover, once each."""
    b = boxes.where("w > 0 AND h > 0")
    rows = b.withColumn("_y", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1)))
    return rows.select("case_id", F.explode(F.sequence(F.col("x"), F.col("x") + F.col("w") - 1)).alias("x"), F.col("_y").alias("y")).distinct()
