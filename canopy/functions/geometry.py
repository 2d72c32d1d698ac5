"""Box algebra as Column expressions. A box is four columns ``<p>x, <p>y, <p>w, <p>h`` (prefix p)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges(p: str = "") -> tuple[Column, Column, Column, Column]:
    x, y, w, h = (F.col(p + c) for c in "xywh")
    return x, y, x + w, y + h


def area(p: str = "") -> Column:
    return F.greatest(F.col(p + "w"), F.lit(0)) * F.greatest(F.col(p + "h"), F.lit(0))


def overlap(a: str, b: str) -> Column:
    """Area of the intersection, 0 where the boxes do not meet."""
    ax, ay, ax2, ay2 = edges(a)
    bx, by, bx2, by2 = edges(b)
    wide = F.greatest(F.least(ax2, bx2) - F.greatest(ax, bx), F.lit(0))
    high = F.greatest(F.least(ay2, by2) - F.greatest(ay, by), F.lit(0))
    return wide * high


def union_area(a: str, b: str) -> Column:
    return area(a) + area(b) - overlap(a, b)


def iou(a: str, b: str) -> Column:
    """Overlap over union; 0 for boxes without area."""
    both = union_area(a, b)
    return F.when(both > 0, overlap(a, b) / both).otherwise(F.lit(0.0))


def contains(a: str, b: str, tol: float = 0.5) -> Column:
    """a holds b, edges included, with a tolerance."""
    ax, ay, ax2, ay2 = edges(a)
    bx, by, bx2, by2 = edges(b)
    return (bx >= ax - tol) & (by >= ay - tol) & (bx2 <= ax2 + tol) & (by2 <= ay2 + tol)


def contains_centre(a: str, b: str) -> Column:
    """The centre of b lies in a (left and top edges included, right and bottom not)."""
    ax, ay, ax2, ay2 = edges(a)
    cx, cy = F.col(b + "x") + F.col(b + "w") / 2, F.col(b + "y") + F.col(b + "h") / 2
    return (cx >= ax) & (cx < ax2) & (cy >= ay) & (cy < ay2)


def soft_range(value: Column, low: Column, high: Column, tol: Column) -> Column:
    """1 in [low, high], falling to 0 at a distance of ``tol`` outside."""
    outside = F.greatest(low - value, value - high, F.lit(0.0))
    return F.greatest(F.lit(0.0), 1 - outside / F.greatest(tol, F.lit(1e-6)))


def size_bucket(area_: Column) -> Column:
    """xs below 400 px², s below 4,000, m below 40,000, else l."""
    return F.when(area_ < 400, "xs").when(area_ < 4000, "s").when(area_ < 40000, "m").otherwise("l")
