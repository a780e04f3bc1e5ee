"""Ranking, calibration and review on the values that the reference's own tests fix."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators import bootstrap, calibration, ranking, review, risk
from assaykit.protocol import Protocol


def scored(spark, scores, labels, weights=None):
    return spark.createDataFrame([(s, y, w) for s, y, w in zip(scores, labels, weights or [1] * len(scores))], "s double, y int, w int")


@pytest.mark.parametrize(
    ("scores", "labels", "auroc", "ap"),
    [([0.9, 0.1], [1, 0], 1, 1), ([0.1, 0.9], [1, 0], 0, 0.5), ([0.5, 0.5], [1, 0], 0.5, 0.5), ([0.9, 0.8, 0.7, 0.6], [1, 0, 1, 0], 0.75, (1 + 2 / 3) / 2), ([0.1, 0.2], [0, 0], None, None), ([0.1, 0.2], [1, 1], None, 1)],
)
def test_auroc_ap(spark, scores, labels, auroc, ap):
    r = ranking.auroc_ap(scored(spark, scores, labels), [], "s", "y").first()
    assert (r["auroc"], r["ap"]) == (pytest.approx(auroc), pytest.approx(ap))


def test_weights_equal_repeated_rows(spark):
    r = ranking.auroc_ap(scored(spark, [0.8, 0.8, 0.2], [1, 0, 0], [3, 2, 4]), [], "s", "y", "w").first()
    assert (r["auroc"], r["ap"]) == (pytest.approx(5 / 6), pytest.approx(3 / 5))
    assert ranking.auroc_ap(scored(spark, [], []), ["s"], "s", "y").count() == 0


def test_interval_and_descriptives(spark):
    d = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3, "nan")], "v double")
    r = bootstrap.interval(d, [], "v").first()
    assert (r["valid_replicates"], r["invalid_replicates"], r["lower_95"], r["upper_95"]) == (4, 1, pytest.approx(0.075), pytest.approx(2.925))
    q = ranking.descriptives(spark.createDataFrame([(0.2,), (0.4,), (0.5,), (0.7,)], "x double"), [], "x").first()
    assert q["mean"] == pytest.approx(0.45) and q["median"] == pytest.approx(0.45)


def test_spearman_of_a_constant_is_null(spark):
    assert ranking.spearman(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b").first()["rho"] is None
    assert ranking.spearman(spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 9.0)], "a double, b double"), "a", "b").first()["rho"] == pytest.approx(1)


def test_draw_digest():
    assert bootstrap.draw_digest(821, 10_000, 24209199).startswith("f4812819")


def test_draw_table_is_one_stream(spark):
    images = spark.createDataFrame([(f"i{k:02}",) for k in range(7)], "image string")
    got = {(r["replicate"], r["image"]): r["multiplicity"] for r in bootstrap.draw_table(images, 200, 5).collect()}
    import numpy as np

    for rep, row in enumerate(np.concatenate(list(bootstrap.draw_indices(7, 200, 5)))):
        for k in range(7):
            assert got.get((rep, f"i{k:02}"), 0) == int((row == k).sum())


def test_kernel_equals_relational_bootstrap(spark):
    rows = spark.createDataFrame([("a", 0.2, 0), ("b", 0.4, 1), ("b", 0.7, 0), ("b", 0.9, 1), ("c", 0.4, 0)], "image string, p double, y int")
    images = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "image string")
    fast = {r["replicate"]: (r["auroc"], r["ap"]) for r in bootstrap.ranking_bootstrap(rows, spark, images, ["p"], "y", 150, 3).collect()}
    slow = {r["replicate"]: (r["auroc"], r["ap"]) for r in ranking.auroc_ap(bootstrap.resampled(rows, bootstrap.draw_table(images, 150, 3)), ["replicate"], "p", "y", "multiplicity").collect()}
    assert len(fast) == 150
    for k, v in fast.items():
        assert slow.get(k, (None, None)) == (pytest.approx(v[0]), pytest.approx(v[1]))


def test_eight_risks(spark):
    d = spark.createDataFrame([("x", 0.2, 0.4, 0.7, 0.9)], "id string, raw_confidence double, calibrated_confidence double, class_consistency double, localisation_stability double")
    got = {r["method"]: r["risk"] for r in risk.risk_scores(d, ["id"], None).collect()}
    assert [got[k] for k in ("raw_risk", "calibrated_risk", "class_risk", "localisation_risk", "calibrated_class_risk", "calibrated_localisation_risk", "class_localisation_risk", "equal_risk")] == pytest.approx([0.8, 0.6, 0.3, 0.1, 0.45, 0.35, 0.2, 1 / 3])


def test_grid(spark):
    g = risk.weight_grid(spark)
    assert g.count() == 5151
    assert g.agg(F.min(F.struct("conf", "cls", "loc"))).first()[0] == (0, 0, 100)


def test_selection_breaks_ties_by_distance(spark):
    d = spark.createDataFrame([(100, 0, 0, 0.9, 0.8, 60000), (34, 33, 33, 0.9 - 1e-13, 0.8, 6), (33, 34, 33, 0.9, 0.8, 6), (0, 0, 100, 0.7, 0.9, 60000)], "conf int, cls int, loc int, mean_ap double, mean_auroc double, distance long")
    assert tuple(risk.select_weights(d).first())[:3] == (33, 34, 33)


def test_aurc_keeps_tie_groups_whole(spark):
    d = spark.createDataFrame([(0.1, 0), (0.1, 1), (0.5, 1)], "r double, y int").withColumn("m", F.lit("x"))
    c = review.coverage_curve(d, ["m"], "r", "y")
    assert review.aurc(c, ["m"]).first()["aurc"] == pytest.approx(2 / 3 * 0.5 + 1 / 3 * 2 / 3)


def test_threshold_leaves_ties_out(spark):
    risks = [0.9, 0.8, 0.8, 0.7] + [None] * 16
    d = spark.createDataFrame([(i, "m", r) for i, r in enumerate(risks)], "image int, method string, crop_risk double")
    r = review.review_thresholds(d, ["method"], (10, 50)).orderBy("budget_percent").collect()
    assert (r[0]["nominal_crops"], r[0]["threshold"]) == (2, 0.8)
    assert r[1]["threshold"] == -1


def test_referral(spark):
    crops = spark.createDataFrame([("a", "m", 2, 2, 0.9), ("b", "m", 3, 1, 0.5), ("c", "m", 0, 0, None), ("d", "m", 1, 0, 0.1)], "image string, method string, predictions long, errors long, crop_risk double")
    t = spark.createDataFrame([("m", 20, 0.5)], "method string, budget_percent int, threshold double")
    r = review.referral_metrics(crops, t, ["method"]).first()
    assert (r["referred_crops"], r["captured_errors"]) == (1, 2)
    assert r["error_capture"] == pytest.approx(2 / 3) and r["automatic_error_rate"] == pytest.approx(1 / 4)
    none = review.referral_metrics(crops.where("image = 'c'"), t, ["method"]).first()
    assert none["error_capture"] is None and none["crop_workload"] == 0


def test_calibration_metrics(spark):
    r = calibration.calibration_metrics(spark.createDataFrame([(0.2, 0), (0.8, 1)], "p double, y int"), [], "p", "y").first()
    assert (r["brier"], r["nll"], r["ece"]) == (pytest.approx(0.04), pytest.approx(-math.log(0.8)), pytest.approx(0.2))
    assert calibration.reliability_bins(spark.createDataFrame([(1.0, 1), (0.3, 0)], "p double, y int"), [], "p", "y").orderBy("bin").select("bin").collect() == [(3,), (9,)]


def test_isotonic_and_bounds(spark):
    d = spark.createDataFrame([(0.2, 0), (0.2, 1), (0.5, 0), (0.8, 1)], "p double, y int")
    f = calibration.fit_calibrator(d, "p", "y", "isotonic")
    got = [r[0] for r in d.select(f.apply(F.col("p"))).collect()]
    assert got == pytest.approx([1 / 3, 1 / 3, 1 / 3, 1])
    up = spark.createDataFrame([(p, y) for p, y in zip([0.1, 0.1, 0.3, 0.3, 0.6, 0.6, 0.9, 0.9], [0, 1, 0, 0, 0, 1, 1, 1])], "p double, y int")
    for m in ("temperature", "platt", "beta"):
        g = calibration.fit_calibrator(up, "p", "y", m)
        out = [r[0] for r in up.orderBy("p").select(g.apply(F.col("p"))).collect()]
        assert out == sorted(out)
    assert calibration.fit_calibrator(up, "p", "y", "beta").parameters[0] == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError):
        calibration.fit_calibrator(up.where("y = 1"), "p", "y", "platt")


def test_protocol_is_checked():
    with pytest.raises(ValueError):
        Protocol(weights=(50, 40, 20))


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(x)) for k in ("a", "b") for x in rng.integers(0, 30, 41 if k == "a" else 8)] + [("a", None), ("a", float("nan")), ("c", None), (None, 2.5)]
    d = spark.createDataFrame(rows, "k string, x double")
    probs = (0.0, 0.025, 0.5, 0.975, 1.0)
    got = {r["k"]: [r[f"q{i}"] for i in range(5)] for r in ranking.quantiles(d, ["k"], "x", probs).collect()}
    for k in ("a", "b", None):
        x = [v for g, v in rows if g == k and v is not None and v == v]
        assert got[k] == pytest.approx([float(q) for q in np.quantile(x, probs)])
    assert set(got) == {"a", "b", None}
    s = {r["k"]: r for r in ranking.descriptives(d.where("x IS NULL OR NOT isnan(x)"), ["k"], "x").collect()}
    assert s["c"]["n"] == 0 and s["c"]["median"] is None and s[None]["median"] == 2.5


def test_calibrators_beyond_the_driver_agree(spark):
    rng = np.random.default_rng(6)
    p = np.round(rng.random(600), 3)
    d = spark.createDataFrame([(float(a), int(rng.random() < a**1.5)) for a in p], "p double, y int")
    counts = calibration.score_counts(d, "p", "y").repartition(5).cache()
    near, far = calibration.fit_counts(counts), calibration.fit_counts(counts, most_scores=10)
    for m in ("temperature", "platt", "beta"):
        assert far[m].parameters == pytest.approx(near[m].parameters, abs=1e-6)
    assert far["isotonic"].x == near["isotonic"].x and far["isotonic"].y == pytest.approx(near["isotonic"].y)
    folded = d.withColumn("fold", (F.col("p") * 1000).cast("int") % 3)
    a, b = (calibration.cross_fit(folded, "p", "y", "fold", 3, most_scores=n).orderBy("method", "p", "y").collect() for n in (5_000_000, 10))
    assert [r["probability"] for r in a] == pytest.approx([r["probability"] for r in b], abs=1e-6)
    x, y = near["isotonic"].x, near["isotonic"].y
    at = sorted({-1.0, 0.0, 0.3141, 0.5, 2.0, *x})
    got = [r[0] for r in spark.createDataFrame([(v,) for v in at], "x double").orderBy("x").select(near["isotonic"].apply(F.col("x"))).collect()]
    assert got == pytest.approx(np.interp(at, x, y).tolist())


def test_bootstrap_blocks_and_the_relational_way(spark):
    states = bootstrap.generator_states(7, 300, 5)
    whole = np.concatenate(list(bootstrap.draw_indices(7, 300, 5)))
    drawn = np.concatenate([bootstrap.draw_block(s, 7, min(128, 300 - 128 * i)) for i, s in enumerate(states)])
    assert drawn.tolist() == [np.bincount(r, minlength=7).tolist() for r in whole]
    rng = np.random.default_rng(8)
    d = spark.createDataFrame([(f"i{k % 6}", int(rng.random() < 0.5), float(rng.integers(0, 5)), float(rng.random())) for k in range(40)], "image string, y int, a double, b double")
    images = spark.createDataFrame([(f"i{k}",) for k in range(7)], "image string")
    ways = [{(r["replicate"], r["method"]): (r["auroc"], r["ap"]) for r in bootstrap.ranking_bootstrap(d, spark, images, ["a", "b"], "y", 20, 3, most_rows=n).collect()} for n in (1_000, 0)]
    assert set(ways[0]) == set(ways[1]) and len(ways[0]) == 40
    for k, v in ways[0].items():
        assert v == pytest.approx(ways[1][k])


def test_grid_without_broadcast_agrees(spark):
    rng = np.random.default_rng(9)
    rows = [(k % 3, int(rng.random() < 0.4), *(float(x) for x in rng.integers(0, 6, 3) / 6)) for k in range(60)]
    d = spark.createDataFrame(rows, "fold_id int, incorrect int, calibrated_confidence double, class_consistency double, localisation_stability double")
    grid = risk.weight_grid(spark, 25)
    a, b = ({(r["conf"], r["cls"]): (r["mean_ap"], r["mean_auroc"], r["distance"]) for r in risk.evaluate_grid(d, grid, most_rows=n).collect()} for n in (1_000, 0))
    assert set(a) == set(b) and all(a[k] == pytest.approx(b[k]) for k in a)
