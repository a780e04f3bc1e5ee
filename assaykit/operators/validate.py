"""Declared expectations: counted, or enforced by failing the job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.scalar import finite, image_path_ok


@dataclass(frozen=True)
class Expectation:
    name: str
    holds: Column


def prediction_expectations(classes: int = 9, least: float = 0.001) -> list[Expectation]:
    ok = lambda c: finite(F.col(c)).isNotNull()
    return [
        Expectation("image_path", image_path_ok(F.col("image"))),
        Expectation("class_id", F.col("class_id").between(0, classes - 1)),
        Expectation("finite", ok("confidence") & ok("x1") & ok("y1") & ok("x2") & ok("y2")),
        Expectation("confidence", F.col("confidence").between(least, 1.0)),
        Expectation("box", (F.col("x1") >= 0) & (F.col("y1") >= 0) & (F.col("x2") >= F.col("x1")) & (F.col("y2") >= F.col("y1"))),
    ]


def first_failure(expectations: list[Expectation]) -> Column:
    """The name of the first expectation a row fails, NULL for a good row; an undefined outcome is a failure."""
    return F.coalesce(*(F.when(~F.coalesce(e.holds, F.lit(False)), F.lit(e.name)) for e in expectations))


def audit(df: DataFrame, expectations: list[Expectation]) -> DataFrame:
    """``expectation, failures``, counted in one pass."""
    row = df.agg(*(F.count_if(~F.coalesce(e.holds, F.lit(False))).alias(e.name) for e in expectations))
    return row.select(F.explode(F.array(*(F.struct(F.lit(e.name).alias("expectation"), F.col(e.name).alias("failures")) for e in expectations))).alias("x")).select("x.*")


def enforce(df: DataFrame, expectations: list[Expectation]) -> DataFrame:
    """``df``, whose evaluation fails at the first row that breaks an expectation."""
    bad = first_failure(expectations)
    return df.withColumn("_ok", F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("expectation failed: "), bad))).otherwise(F.lit(True).cast("string"))).where("_ok = 'true'").drop("_ok")


#: First failing check of a text annotation line, in checking order.
def annotation_issue(line: Column, classes: int) -> Column:
    f = F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != "")
    n = lambda i: F.try_element_at(f, F.lit(i)).try_cast("double")
    numeric = n(1).isNotNull() & n(2).isNotNull() & n(3).isNotNull() & n(4).isNotNull() & n(5).isNotNull()
    return (
        F.when(F.trim(line) == "", "empty_line")
        .when(F.size(f) != 5, F.concat(F.lit("expected_5_values_got_"), F.size(f).cast("string")))
        .when(~numeric, "non_numeric")
        .when((n(1) != F.floor(n(1))) | (n(1) < 0) | (n(1) >= classes), "non_integer_class")
        .when((n(4) <= 0) | (n(5) <= 0), "non_positive_box_size")
        .when(~n(2).between(0, 1) | ~n(3).between(0, 1), "center_outside_normalized_range")
        .when((n(4) > 1) | (n(5) > 1), "size_outside_normalized_range")
    )


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, repeats counted: ``side`` and the columns of ``a``."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))
