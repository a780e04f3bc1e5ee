"""Audit tables and run planning."""

import pytest
from pyspark.sql import functions as F

from assaykit.operators import audit
from assaykit.plans import runs


def test_run_matrix(spark):
    plan = runs.run_matrix(spark, ["02092026", "1"], ["supplied", "similarity_aware"])
    assert [r["run_id"] for r in plan.orderBy("position").collect()] == ["supplied/seed_02092026", "similarity_aware/seed_02092026", "supplied/seed_1", "similarity_aware/seed_1"]
    assert runs.select_runs(plan, seed="02092026", split="supplied").count() == 1
    ledger = spark.createDataFrame([("supplied/seed_1", "complete"), ("similarity_aware/seed_1", "running")], "experiment string, status string")
    assert runs.select_runs(plan, ledger, remaining=True).count() == 3
    with pytest.raises(ValueError):
        runs.select_runs(plan, ledger, seed="1", remaining=True)


def test_measure_takes_turns(spark):
    ticks, order = iter(range(100)), []
    out = runs.measure({"a": lambda: order.append("a") or 10, "b": lambda: order.append("b") or 10}, 2, lambda: next(ticks))
    assert "".join(order) == "ab" + "ab" + "ba" and all(r["seconds"] == 1 for r in out)
    s = {r["pipeline"]: r for r in runs.timing_summary(spark.createDataFrame(out), "a").collect()}
    assert s["b"]["overhead_ratio"] == 1 and s["a"]["throughput_crops_per_second"] == 10


def test_audit_tables(spark):
    d = spark.createDataFrame([(0.1,), (0.5,), (float("nan"),)], "x double")
    assert [tuple(r) for r in audit.threshold_counts(d, "x", (0.1, 1.0)).collect()] == [(0.1, 1), (1.0, 2)]
    one = spark.range(1).select(audit.boundary_overflow(F.lit(0.95), F.lit(0.5), F.lit(0.2), F.lit(1.0), F.lit(100), F.lit(50)))
    assert one.first()[0] == pytest.approx(5)
    own = spark.createDataFrame([(0, 1, 2, 3), (1, 1, 2, 3), (2, 5, 5, 10)], "class_id int, train int, val int, total int")
    pub = spark.createDataFrame([("A", 1, 2, 3), ("B", 5, 5, 10)], "name string, train int, val int, total int")
    assert [tuple(r) for r in audit.published_names(own, pub).collect()] == [(2, "B")]
