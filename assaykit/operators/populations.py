"""Checks of whole populations before they are analysed, and lookups that have to succeed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.scalar import finite


def included(df: DataFrame, confidence: str = "confidence", least: float = 0.01) -> DataFrame:
    """Rows at or above the inclusion threshold; what stays out has been validated like the rest."""
    return df.where(F.col(confidence) >= least)


def _counted(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, p in parts.items():
        one = p.agg(F.lit(name).alias("problem"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.union(one)
    return out


def population_problems(
    rows: DataFrame,
    images: DataFrame,
    signals: tuple[str, ...],
    label: str = "correct",
    identity: str = "prediction_id",
    confidence: str | None = "raw_confidence",
    least: float = 0.01,
    aliases: dict[str, str] | None = None,
    expected: dict[str, int] | None = None,
) -> DataFrame:
    """``problem, n`` of a scored population; all zero for a good one.

    Counted are repeated and missing identities, rows of images outside ``images``, repeated images, signals outside [0, 1]
    or not finite, labels that are not 0 or 1, confidences below inclusion, columns that should repeat another
    (``aliases``) and differ, and how far the numbers of rows and images are from ``expected``.
    """
    c = F.col
    bad_signal = F.lit(False)
    for s in (*signals, *([confidence] if confidence else [])):
        x = finite(c(s).cast("double"))
        bad_signal = bad_signal | ~F.coalesce(x.between(0, 1), F.lit(False))
    parts = {
        "missing_identity": rows.where(c(identity).isNull() | (c(identity).cast("string") == "")),
        "repeated_identity": rows.where(c(identity).isNotNull()).groupBy(identity).agg(F.count(F.lit(1)).alias("k")).where("k > 1"),
        "foreign_image": rows.join(images.select("image").distinct(), "image", "left_anti"),
        "repeated_image": images.groupBy("image").agg(F.count(F.lit(1)).alias("k")).where("k > 1"),
        "signal_outside_unit_interval": rows.where(bad_signal),
        "label_not_binary": rows.where(~F.coalesce(c(label).isin(0, 1), F.lit(False))),
    }
    if confidence:
        parts["below_inclusion"] = rows.where(c(confidence) < least)
    for a, b in (aliases or {}).items():
        parts[f"{a}_differs_from_{b}"] = rows.where(~c(a).eqNullSafe(c(b)))
    out = _counted(parts)
    for name, df in (("rows", rows), ("images", images)):
        if expected and name in expected:
            one = df.agg(F.lit(f"{name}_not_as_expected").alias("problem"), F.abs(F.count(F.lit(1)) - expected[name]).alias("n"))
            out = out.union(one)
    return out


def view_problems(views: DataFrame, references: DataFrame, transforms: tuple[str, ...], most: int = 300, classes: int = 9) -> DataFrame:
    """``problem, n`` of detections in transformed views.

    ``views`` has a row per detection: ``image, transform_id, width, height, class_id, confidence, x1..y2``; a view without
    detections has one row whose ``class_id`` is null. ``references`` are the untransformed boxes ``image, x1..y2``.
    """
    c = F.col
    d = views.where("class_id IS NOT NULL")
    sizes = views.groupBy("image").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.min("width").alias("w0"), F.min("height").alias("h0"))
    number = lambda k: finite(c(k).cast("double"))
    inside = (number("x1") >= 0) & (number("y1") >= 0) & (number("x2") > number("x1")) & (number("y2") > number("y1")) & (number("x2") <= c("width")) & (number("y2") <= c("height"))
    return _counted({
        "foreign_transform": views.where(~c("transform_id").isin(*transforms)),
        "missing_view": views.select("image", "transform_id").distinct().groupBy("image").agg(F.count(F.lit(1)).alias("k")).where(c("k") != len(transforms)),
        "too_many_detections": d.groupBy("image", "transform_id").agg(F.count(F.lit(1)).alias("k")).where(c("k") > most),
        "no_size": views.where(~F.coalesce((c("width") > 0) & (c("height") > 0), F.lit(False))),
        "sizes_of_views_differ": sizes.where("width <> w0 OR height <> h0"),
        "box_outside_view": d.where(~F.coalesce(inside, F.lit(False))),
        "class_or_confidence": d.where(~F.coalesce(c("class_id").between(0, classes - 1) & number("confidence").between(0, 1), F.lit(False))),
        "reference_outside_image": references.select("image", "x2", "y2").join(sizes, "image").where((c("x2") > c("width")) | (c("y2") > c("height"))),
    })


def require(problems: DataFrame, what: str) -> None:
    """Fail, naming the problems that occur."""
    found = [f"{r['problem']}: {r['n']}" for r in problems.where("n > 0").orderBy("problem").collect()]
    if found:
        raise ValueError(f"{what}: {', '.join(found)}")


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``rows`` with ``values`` of ``table`` by ``keys``; a key that ``table`` lacks or repeats fails the job."""
    t = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), *(F.first(v).alias(v) for v in values))
    found = rows.join(t, keys, "left")
    problem = F.when(F.col("_k").isNull(), "no row").when(F.col("_k") > 1, "more than one row")
    named = F.concat(problem, F.lit(" for "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys)))
    checked = F.when(problem.isNotNull(), F.raise_error(named).cast("long")).otherwise(F.col("_k"))
    return found.withColumn("_k", checked).where("_k = 1").drop("_k")


def aligned(tables: dict[str, DataFrame], position: str, equal: list[str]) -> DataFrame:
    """``problem, n`` of tables that should hold the same rows in the same order: positions that one lacks, and values
    that differ at a position from those of the first table."""
    (first, base), *rest = tables.items()
    parts = {}
    for name, df in rest:
        other = df.select(F.col(position).alias("_p"), *(F.col(c).alias(f"_{c}") for c in equal))
        both = base.join(other, F.col(position) == F.col("_p"), "full")
        parts[f"{name}_lacks_rows"] = both.where(F.col("_p").isNull())
        parts[f"{name}_has_more_rows"] = both.where(F.col(position).isNull())
        for c in equal:
            parts[f"{name}_{c}_differs_from_{first}"] = both.where(F.col("_p").isNotNull() & F.col(position).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")))
    return _counted(parts)


def fit_leaks(fits: DataFrame, folds: DataFrame, cluster: str = "image") -> DataFrame:
    """``problem, n``: rows that were scored by a model fitted on their own fold, and clusters on both sides of a fit.

    ``fits`` has ``image, scored_by_fold`` (the fold left out of the model's fit); ``folds`` has ``image, fold_id``.
    """
    joined = fits.join(folds.select(cluster, "fold_id"), cluster, "left")
    twice = folds.groupBy(cluster).agg(F.count_distinct("fold_id").alias("k")).where("k > 1")
    return _counted({"scored_by_own_fit": joined.where(~F.col("scored_by_fold").eqNullSafe(F.col("fold_id"))), "cluster_in_two_folds": twice})


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, n``: distinct values, without null, of each column; each is counted by a shuffle of its values."""
    out = None
    for c in columns:
        one = df.select(c).where(F.col(c).isNotNull()).distinct().agg(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.union(one)
    return out


def exact_sum(x: Column, scale: int = 18) -> Column:
    """The sum of decimal copies of a double column: no order of rows changes it, to ``scale`` places."""
    return F.sum(x.cast(f"decimal(38,{scale})")).cast("double")


def same_setting(column: Column, wanted: object) -> Column:
    """Whether a recorded setting, a text, says what is wanted: numbers by value, booleans and none by name."""
    text = F.lower(F.trim(column))
    if wanted is None:
        return column.isNull() | text.isin("", "none", "null")
    if isinstance(wanted, bool):
        return F.coalesce(text.isin(*(("true", "1") if wanted else ("false", "0"))), F.lit(False))
    if isinstance(wanted, (int, float)):
        return F.coalesce(text.try_cast("double") == float(wanted), F.lit(False))
    return F.coalesce(F.trim(column) == wanted, F.lit(False))
