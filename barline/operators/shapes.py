"""Chart shapes that need a whole window of closes: kernel-smoothed extrema and cup-with-handle.

Windows are arrays over the last rows of a ticker. A cheap gate, a few products with rows of the smoothing matrix,
decides which windows are looked at whole; about one in seventeen is.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import densify

ROWS, BANDWIDTH, LAG = 38, 2.5, 3
EQUAL, FLAT, APART = 0.015, 0.0075, 22
CUP_ROWS, HANDLES = 60, (5, 8, 12, 15)
CUP_DEPTH, RIM_GAP, FIT = (0.12, 0.35), 0.03, 0.5


def smoother(rows: int = ROWS, bandwidth: float = BANDWIDTH) -> list[list[float]]:
    """The Gaussian kernel regression matrix: each row's weights add up to one."""
    out = []
    for i in range(rows):
        w = [math.exp(-0.5 * ((i - j) / bandwidth) ** 2) for j in range(rows)]
        out.append([x / sum(w) for x in w])
    return out


def _dot(values: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(values, weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def _numbers(xs) -> Column:
    return F.array(*(F.lit(float(x)) for x in xs))


def _up(a: Column, b: Column) -> Column:
    return b >= a  # level counts as up


def _near(a: Column, b: Column, tol: float) -> Column:
    middle = (a + b) / 2
    return (F.abs(a - middle) <= tol * middle) & (F.abs(b - middle) <= tol * middle)


def extrema_shapes(panel: DataFrame) -> DataFrame:
    """date, ticker, family, signal, direction, strength, horizon of the ten shapes made of extrema.

    A shape is complete when the last extremum of the smoothed window is LAG rows before its end. Levels are the closes
    where the smoothed ones turn. Triangles and rectangles take the direction in which the close leaves them.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    dense = densify(panel)
    rows = dense.select("date", "ticker", "present", "close", F.collect_list("close").over(w.rowsBetween(-(ROWS - 1), 0)).alias("w"), F.row_number().over(w).alias("_rn"), F.count(F.lit(1)).over(Window.partitionBy("ticker")).alias("_n"))
    rows = rows.where((F.size("w") == ROWS) & (F.col("_n") >= ROWS + 5) & F.col("present"))
    matrix = smoother()
    last = ROWS - 1 - LAG
    ends = {i: _dot(F.col("w"), _numbers(matrix[i])) for i in range(last - 1, ROWS)}
    rows = rows.withColumns({f"_s{i}": x for i, x in ends.items()})
    turned = _up(F.col(f"_s{last - 1}"), F.col(f"_s{last}")) != _up(F.col(f"_s{last}"), F.col(f"_s{last + 1}"))
    steady = [_up(F.col(f"_s{i - 1}"), F.col(f"_s{i}")) == _up(F.col(f"_s{i}"), F.col(f"_s{i + 1}")) for i in range(last + 1, ROWS - 1)]
    rows = rows.where(turned & steady[0] & steady[1])
    smooth = F.transform(F.array(*(_numbers(r) for r in matrix)), lambda r: _dot(F.col("w"), r))
    rows = rows.withColumn("s", smooth)
    s = lambda i: F.get(F.col("s"), i)
    turns = F.filter(F.sequence(F.lit(1), F.lit(ROWS - 2)), lambda i: _up(s(i - 1), s(i)) != _up(s(i), s(i + 1)))
    rows = rows.withColumn("at", turns).where(F.size("at") >= 3)
    top = lambda i: _up(s(i - 1), s(i))
    close_at = lambda i: F.get(F.col("w"), i)
    rows = rows.withColumn("tops", F.transform(F.filter("at", top), close_at)).withColumn("bottoms", F.transform(F.filter("at", lambda i: ~top(i)), close_at))
    from_end = lambda n: F.element_at("at", -n)
    five = F.when(F.size("at") >= 5, F.array(*(close_at(from_end(n)) for n in (5, 4, 3, 2, 1))))
    rows = rows.withColumn("e", five).withColumn("first_top", F.when(F.size("at") >= 5, top(from_end(5))))
    rows = rows.withColumn("e3", F.array(*(close_at(from_end(n)) for n in (3, 2, 1)))).withColumn("wide", from_end(1) - from_end(3) >= APART).withColumn("last_top", top(from_end(1)))
    e1, e2, e3, e4, e5 = (F.get("e", F.lit(i)) for i in range(5))
    a, b, c = (F.get("e3", F.lit(i)) for i in range(3))
    odd, even = (e1, e3, e5), (e2, e4)
    flat = _near(F.least(*odd), F.greatest(*odd), FLAT) & _near(F.least(*even), F.greatest(*even), FLAT)
    mean3, mean2 = (e1 + e3 + e5) / 3, (e2 + e4) / 2
    pairs = _near(e1, e5, EQUAL) & _near(e2, e4, EQUAL)
    is_top, is_bottom = F.col("first_top"), ~F.col("first_top")
    leaves = F.when(F.col("close") > F.array_min("tops"), 1).when(F.col("close") < F.array_max("bottoms"), -1)
    shapes = {
        "head_shoulders": (is_top & (e3 > e1) & (e3 > e5) & pairs, F.lit(-1), e3 / ((e1 + e5) / 2) - 1),
        "broadening_top": (is_top & (e1 < e3) & (e3 < e5) & (e2 > e4), F.lit(-1), (e5 - e1) / e1),
        "triangle_top": (is_top & (e1 > e3) & (e3 > e5) & (e2 < e4), leaves, (e1 - e5) / e1),
        "rectangle_top": (is_top & flat & (F.least(*odd) > F.greatest(*even)), leaves, (mean3 - mean2) / mean2),
        "inv_head_shoulders": (is_bottom & (e3 < e1) & (e3 < e5) & pairs, F.lit(1), 1 - e3 / ((e1 + e5) / 2)),
        "broadening_bottom": (is_bottom & (e1 > e3) & (e3 > e5) & (e2 < e4), F.lit(1), (e1 - e5) / e5),
        "triangle_bottom": (is_bottom & (e1 < e3) & (e3 < e5) & (e2 > e4), leaves, (e5 - e1) / e1),
        "rectangle_bottom": (is_bottom & flat & (F.least(*even) > F.greatest(*odd)), leaves, (mean2 - mean3) / mean3),
        "double_top": (F.col("last_top") & F.col("wide") & _near(a, c, EQUAL) & (b < F.least(a, c)), F.lit(-1), 1 - b / a),
        "double_bottom": (~F.col("last_top") & F.col("wide") & _near(a, c, EQUAL) & (b > F.greatest(a, c)), F.lit(1), b / a - 1),
    }
    made = [F.when(mask & way.isNotNull(), F.struct(F.lit("lmw").alias("family"), F.lit(name).alias("signal"), way.cast("int").alias("direction"), size.cast("double").alias("strength"), F.lit(10).alias("horizon"))) for name, (mask, way, size) in shapes.items()]
    return rows.select("date", "ticker", F.inline(F.filter(F.array(*made), lambda x: x.isNotNull())))


def cup_handle(panel: DataFrame) -> DataFrame:
    """A close over its rim after a rounded base and a shallow handle; the shortest handle that fits counts."""
    w = Window.partitionBy("ticker").orderBy("date")
    most = CUP_ROWS + max(HANDLES)
    prior = w.rowsBetween(-CUP_ROWS, -1)
    rows = densify(panel).select(
        "date", "ticker", "present", "close",
        F.when(F.count("close").over(prior) == CUP_ROWS, F.max("close").over(prior)).alias("_top"),
        F.collect_list(F.coalesce("close", F.lit(float("nan")))).over(w.rowsBetween(-most, -1)).alias("h"),
    ).where("present AND close > _top")
    tt = np.arange(CUP_ROWS)
    design = np.vstack([tt**2, tt, np.ones_like(tt)]).T.astype(float)
    solve = np.linalg.pinv(design)
    found = None
    for n in HANDLES:
        base = F.size("h") - n - CUP_ROWS
        seg, handle = F.slice("h", F.greatest(base, F.lit(0)) + 1, CUP_ROWS), F.slice("h", F.size("h") - n + 1, n)
        name = f"_cup{n}"
        rows = rows.withColumn(name, F.when(base >= 0, F.struct(seg.alias("seg"), handle.alias("handle"))))
        seg, handle = F.col(f"{name}.seg"), F.col(f"{name}.handle")
        k2, k1, k0 = (_dot(seg, _numbers(r)) for r in solve)
        rows = rows.withColumn(f"{name}_k", F.when(F.col(name).isNotNull(), F.array(k2, k1, k0)))
        k = [F.get(f"{name}_k", F.lit(i)) for i in range(3)]
        miss = F.aggregate(F.transform(seg, lambda x, i: F.pow(x - (k[0] * i * i + k[1] * i + k[2]), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
        mean = F.aggregate(seg, F.lit(0.0), lambda s, x: s + x) / CUP_ROWS
        spread = F.aggregate(F.transform(seg, lambda x: F.pow(x - mean, F.lit(2.0))), F.lit(1e-12), lambda s, x: s + x)
        first, final, low = F.element_at(seg, 1), F.element_at(seg, -1), F.array_min(seg)
        rim = F.greatest(first, final)
        depth = 1 - low / rim
        whole = ~F.exists(seg, lambda x: F.isnan(x))
        good = (
            F.col(name).isNotNull() & whole & (k[0] > 0) & (1 - miss / spread >= FIT) & depth.between(*CUP_DEPTH) & (F.abs(first - final) / rim <= RIM_GAP)
            & (F.array_min(handle) >= low + 0.5 * (rim - low)) & ((rim - F.array_min(handle)) / rim <= depth / 3) & (F.col("close") > rim)
        )
        hit = F.when(good, depth)
        found = hit if found is None else F.coalesce(found, hit)
    rows = rows.withColumn("strength", found).where("strength IS NOT NULL")
    return rows.select("date", "ticker", F.lit("lmw").alias("family"), F.lit("cup_handle").alias("signal"), F.lit(1).alias("direction"), "strength", F.lit(20).alias("horizon"))
