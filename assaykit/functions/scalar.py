"""Column expressions: guarded arithmetic, boxes, bins, calibration maps, bit strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-15


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` as double; NULL where undefined."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def number(text: Column) -> Column:
    """A saved number: blanks, unreadable and non-finite text are NULL."""
    return finite(F.nullif(F.trim(text), F.lit("")).try_cast("double"))


def overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(hi1, hi2) - F.greatest(lo1, lo2))


def box_iou(a: str, b: str) -> Column:
    """Intersection over union of boxes in columns ``{a}x1 .. {a}y2`` and ``{b}x1 .. {b}y2``; 0 without any area."""
    c = lambda s, k: F.col(f"{s}{k}")
    both = overlap(c(a, "x1"), c(a, "x2"), c(b, "x1"), c(b, "x2")) * overlap(c(a, "y1"), c(a, "y2"), c(b, "y1"), c(b, "y2"))
    area = lambda s: (c(s, "x2") - c(s, "x1")) * (c(s, "y2") - c(s, "y1"))
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def bin_of(x: Column, edges: tuple[float, ...]) -> Column:
    """0-based half-open bin, counting the edges at or below ``x``; the last bin is closed, NULL outside."""
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= x)) - 1
    return F.when((x >= edges[0]) & (x <= edges[-1]), F.least(at, F.lit(len(edges) - 2)))


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))


def log_loss(p: Column, y: Column) -> Column:
    q = clipped(p)
    return F.when(y == 1, -F.log(q)).otherwise(-F.log1p(-q))


def logit(p: Column) -> Column:
    q = clipped(p)
    return F.log(q) - F.log1p(-q)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def beta_map(p: Column, a: Column, b: Column, c: Column) -> Column:
    """Beta calibration: ``sigmoid(a ln p - b ln(1 - p) + c)``."""
    q = clipped(p)
    return sigmoid(a * F.log(q) - b * F.log1p(-q) + c)


def interpolated(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through the knots, constant beyond them; the knots are one array, searched by halving."""
    n = len(xs)
    knots = F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in zip(xs, ys)))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(n.bit_length()))))
    # How many knots lie below ``x``.
    below = F.aggregate(steps, F.lit(0), lambda k, step: F.when((k + step <= n) & (F.get(knots, k + step - 1)["x"] < x), k + step).otherwise(k))

    def at(k: Column) -> Column:
        a, b = F.get(knots, F.greatest(k - 1, F.lit(0))), F.get(knots, F.least(k, F.lit(n - 1)))
        return F.when(a["x"] == b["x"], a["y"]).otherwise(a["y"] + (x - a["x"]) * ((b["y"] - a["y"]) / (b["x"] - a["x"])))

    return F.when(x.isNotNull(), F.element_at(F.transform(F.array(below), at), 1))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def median_bits(values: Column) -> Column:
    """64 values as a BIGINT: bit ``i`` is set where value ``i`` exceeds the median of values 1 to 63; bit 0 never is."""
    middle = F.element_at(F.array_sort(F.slice(values, 2, 63)), 32)
    bit = lambda x, i: F.when((i > 0) & (x > middle), F.expr("1L")).otherwise(F.expr("0L"))
    return F.aggregate(F.transform(values, lambda x, i: F.struct(bit(x, i).alias("b"), i.alias("i"))), F.expr("0L"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", x["b"], x["i"])))


def image_path_ok(path: Column) -> Column:
    """Whether a path is ``images/<train or val>/<name>`` without separators, drives or parent steps."""
    return path.rlike(r"^images/(train|val)/[^/\\:]+$") & ~path.contains("..")


def label_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^images/", "labels/"), r"\.[^.]+$", ".txt")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")
