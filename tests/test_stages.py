"""Stages from entry to tables on small populations; validators, scans, images, sinks and governance."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators import bootstrap, evaluation, populations, review, splits, stability
from assaykit.plans import ledger, stages
from assaykit.protocol import Protocol
from assaykit.sources import images as pictures
from assaykit.sources import scans, sinks

P = Protocol(replicates=40)


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        y = int(rng.random() < 0.6)
        raw = round(float(np.clip(rng.normal(0.35 + 0.3 * y, 0.2), 0.02, 0.99)), 2)
        rows.append((f"i{i % 30:02}", f"i{i % 30:02}#{i}", i % 3, raw, raw, float(rng.integers(0, 12) / 11), round(float(rng.random()), 3), y, int(rng.random() < 0.5)))
    population = spark.createDataFrame(rows, "image string, prediction_id string, class_id int, raw_confidence double, calibrated_confidence double, class_consistency double, localisation_stability double, correct int, correct_secondary int")
    images = spark.createDataFrame([(f"i{i:02}",) for i in range(32)], "image string")
    return {"population": population.withColumn("fold_id", F.xxhash64("image") % 5), "images": images}


def test_calibrators_from_choice_to_held_out_review(spark, study, tmp_path):
    root = str(tmp_path)
    groups = study["images"].select("image", F.when(F.col("image") < "i04", "i00").otherwise(F.col("image")).alias("component"))
    made = stages.run(spark, "calibrator_comparison", study | {"groups": groups}, root, P)
    assert made["out_of_fold"].count() == 5 * 120 and made["differences"].count() == 20 * 2
    assert made["folds"].where("image < 'i04'").select("fold_id").distinct().count() == 1
    final = stages.run(spark, "final_calibrator", study | {"choice": made["choice"]}, root, P)
    fit = stages.saved_calibrator(final["calibrator"])
    assert fit.method == made["choice"].first()["method"]
    reviewed = stages.run(spark, "selective_review", study | {"population": final["calibrated"]}, root, P)
    assert reviewed["thresholds"].count() == 15 and reviewed["crops"].count() == 5 * 32
    assert reviewed["intervals"].count() == 15 * len(review.REFERRAL) + 5 and reviewed["differences"].count() == 2 * (3 * 2 + 1)
    frozen = reviewed["thresholds"].withColumn("threshold", F.lit(0.5))
    held = stages.run(spark, "final_evaluation", study | {"thresholds": frozen, "calibrator": final["calibrator"]}, root, P)
    assert held["referral"].select("threshold").distinct().collect() == [(0.5,)]
    with pytest.raises(RuntimeError, match="in the ledger already"):
        stages.run(spark, "selective_review", study, root, P)
    assert stages.outputs(spark, "selective_review", root, ("aurc",))["aurc"].count() == 5
    with pytest.raises(ValueError, match="is not complete"):
        stages.outputs(spark, "risk_evaluation", root, ("methods",))
    with pytest.raises(ValueError, match="not those of the methods"):
        stages.run(spark, "final_evaluation", study | {"thresholds": frozen.limit(3), "calibrator": final["calibrator"]}, str(tmp_path / "other"), P)


def test_risk_evaluation_and_fusion(spark, study, tmp_path):
    made = stages.run(spark, "risk_evaluation", study, str(tmp_path), P)
    assert made["methods"].count() == 8 * 2 and made["differences"].count() == 8 * 7 and made["correlations"].count() == 3
    assert {r["status"] for r in made["by_class"].collect()} == {"defined"}
    r = made["methods"].where("metric = 'auroc'").first()
    assert r["lower_95"] <= r["observed"] <= r["upper_95"] and r["valid_replicates"] + r["invalid_replicates"] == 40
    fused = stages.run(spark, "weighted_fusion", study, str(tmp_path), P)
    assert fused["grid"].count() == 5151 and fused["weights"].count() == 1
    assert {(r["target"], r["method"]) for r in fused["methods"].collect()} == {(t, m) for t in ("primary", "secondary") for m in ("calibrated_risk", "equal_risk", "weighted_risk")}
    bad = study["population"].withColumn("class_consistency", F.lit(1.5))
    with pytest.raises(ValueError, match="signal_outside_unit_interval: 120"):
        stages.run(spark, "risk_evaluation", study | {"population": bad}, str(tmp_path / "bad"), P)


def test_referral_bootstrap_ways_agree(spark):
    rng = np.random.default_rng(5)
    rows = [(f"i{i}", m, int(n), int(rng.integers(0, n + 1)), float(rng.random()) if n else None) for i in range(9) for m in ("a", "b") for n in [rng.integers(0, 4)]]
    crops = spark.createDataFrame(rows, "image string, method string, predictions long, errors long, crop_risk double")
    images, t = crops.select("image").distinct(), review.review_thresholds(crops, ["method"], (20, 50))
    key = lambda df: {(r["replicate"], r["method"], r["budget_percent"]): r for r in df.collect()}
    near = key(review.referral_bootstrap(crops, t, "method", images, 30, 4))
    far = key(review.referral_bootstrap(crops, t, "method", images, 30, 4, most_rows=0))
    draws = {}
    for r in bootstrap.draw_table(images, 30, 4).collect():
        draws.setdefault(r["replicate"], {})[r["image"]] = r["multiplicity"]
    at = {(r["method"], r["budget_percent"]): r["threshold"] for r in t.collect()}
    assert set(near) == set(far) and len(near) == 30 * 4
    for (k, m, b), r in near.items():
        assert all(r[c] == pytest.approx(far[k, m, b][c]) if r[c] is not None else far[k, m, b][c] is None for c in review.REFERRAL)
        own = [(draws[k].get(x[0], 0), x[2], x[3], x[2] > 0 and x[4] > at[m, b]) for x in rows if x[1] == m]
        errors, full, sent = sum(w * e for w, _, e, _ in own), sum(w for w, n, _, _ in own if n), sum(w for w, _, _, s in own if s)
        assert r["crop_workload"] == pytest.approx(sent / 9)
        if errors:
            assert r["error_capture"] == pytest.approx(sum(w * e for w, _, e, s in own if s) / errors) and r["random_capture"] == pytest.approx(sent / full)


def test_aurc_of_resamples(spark):
    rows = spark.createDataFrame([("a", 0.2, 0), ("b", 0.4, 1), ("b", 0.7, 0), ("c", 0.4, 1), ("c", 0.9, 0)], "image string, p double, y int")
    images = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "image string")
    fast = {r["replicate"]: r["aurc"] for r in bootstrap.ranking_bootstrap(rows, spark, images, ["p"], "y", 60, 3).collect()}
    slow = {r["replicate"]: r["aurc"] for r in bootstrap.ranking_bootstrap(rows, spark, images, ["p"], "y", 60, 3, most_rows=0).collect()}
    assert len(fast) == 60 and all(v == pytest.approx(slow[k]) if v is not None else slow.get(k) is None for k, v in fast.items())
    for k, draw in enumerate(bootstrap.draw_indices(4, 60, 3).__next__()):
        w = np.bincount(draw, minlength=4)
        kept = wrong = area = 0.0
        total = w[0] + 2 * w[1] + 2 * w[2]
        for risk in (0.2, 0.4, 0.7, 0.9):
            own = [(w["abc".index(i)], y) for i, p, y in rows.collect() if p == risk]
            n, e = sum(x for x, _ in own), sum(x * y for x, y in own)
            kept, wrong = kept + n, wrong + e
            area += n / total * wrong / kept if n else 0
        assert fast[k] == (pytest.approx(area) if total else None)


def test_populations(spark):
    rows = spark.createDataFrame([("a", "1", 0.5, 0.5, 1), ("a", "1", 0.5, 0.4, 0), ("z", None, 0.001, float("nan"), 2)], "image string, prediction_id string, raw_confidence double, s double, correct int")
    images = spark.createDataFrame([("a",), ("b",), ("b",)], "image string")
    got = {r["problem"]: r["n"] for r in populations.population_problems(rows, images, ("s",), aliases={"s": "raw_confidence"}, expected={"rows": 5, "images": 3}).collect()}
    assert got == {"missing_identity": 1, "repeated_identity": 1, "foreign_image": 1, "repeated_image": 1, "signal_outside_unit_interval": 1, "label_not_binary": 1, "below_inclusion": 1, "s_differs_from_raw_confidence": 2, "rows_not_as_expected": 2, "images_not_as_expected": 0}
    assert populations.included(rows, "raw_confidence").count() == 2
    t = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "image string, v int")
    assert populations.looked_up(rows.where("image = 'a'"), t, ["image"], ["v"]).select("v").distinct().collect() == [(1,)]
    for image, what in (("b", "more than one row for b"), ("z", "no row for z")):
        with pytest.raises(Exception, match=what):
            populations.looked_up(spark.createDataFrame([(image,)], "image string"), t, ["image"], ["v"]).collect()
    a, b = (spark.createDataFrame(x, "i int, v string") for x in ([(0, "x"), (1, "y"), (2, "z")], [(0, "x"), (1, "w"), (3, "z")]))
    assert {r["problem"]: r["n"] for r in populations.aligned({"a": a, "b": b}, "i", ["v"]).collect()} == {"b_lacks_rows": 1, "b_has_more_rows": 1, "b_v_differs_from_a": 1}
    fits, folds = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "image string, scored_by_fold int"), spark.createDataFrame([("a", 0), ("b", 0), ("b", 1)], "image string, fold_id int")
    assert {r["problem"]: r["n"] for r in populations.fit_leaks(fits, folds).collect()} == {"scored_by_own_fit": 2, "cluster_in_two_folds": 1}
    values = spark.createDataFrame([(0.1,)] * 10 + [(1e9,), (-1e9,)], "x double")
    assert values.select(populations.exact_sum(F.col("x"))).first()[0] == 1.0
    said = spark.createDataFrame([("0",), (" 0.0 ",), ("cpu",), ("False",), (None,)], "s string")
    check = lambda w: [r[0] for r in said.select(populations.same_setting(F.col("s"), w)).collect()]
    assert check(0) == [True, True, False, False, False] and check("cpu") == [False, False, True, False, False] and check(False)[3] and check(None)[4]
    assert {r["column"]: r["n"] for r in populations.distinct_counts(rows, ["image", "prediction_id"]).collect()} == {"image": 2, "prediction_id": 1}


def test_view_problems(spark):
    names = tuple(v["id"] for v in stability.VIEWS)
    good = [("i", v, 10, 10, 1, 0.5, 0.0, 0.0, 5.0, 5.0) for v in names]
    schema = "image string, transform_id string, width int, height int, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double"
    refs = spark.createDataFrame([("i", 0.0, 0.0, 9.0, 9.0)], "image string, x1 double, y1 double, x2 double, y2 double")
    populations.require(populations.view_problems(spark.createDataFrame(good, schema), refs, names), "views")
    bad = [*good[1:], ("i", "mirror", 10, 10, 1, 0.5, 0.0, 0.0, 11.0, 5.0), ("j", "blur", 0, 10, None, None, None, None, None, None)]
    got = {r["problem"]: r["n"] for r in populations.view_problems(spark.createDataFrame(bad, schema), refs.union(spark.createDataFrame([("i", 0.0, 0.0, 12.0, 9.0)], refs.schema)), names).collect()}
    assert got == {"foreign_transform": 1, "missing_view": 1, "too_many_detections": 0, "no_size": 1, "sizes_of_views_differ": 0, "box_outside_view": 1, "class_or_confidence": 0, "reference_outside_image": 1}


def test_evaluation_tables(spark):
    samples = spark.createDataFrame([(k, m, float(k) + (m == "b"), None if k == 3 else 1.0) for k in range(5) for m in "ab"], "replicate long, method string, x double, y double")
    observed = spark.createDataFrame([("a", 2.0, 1.0), ("b", 3.5, None)], "method string, x double, y double")
    t = {(r["method"], r["metric"]): r for r in evaluation.evaluation_table(observed, samples, ["method"], ["x", "y"]).collect()}
    assert t["a", "x"]["bootstrap_mean"] == 2 and t["b", "x"]["lower_95"] == pytest.approx(1.1) and t["a", "y"]["invalid_replicates"] == 1
    d = {(r["metric"], r["method_a"], r["method_b"]): r for r in evaluation.paired_differences(observed, samples, [], "method", ["x", "y"]).collect()}
    assert len(d) == 4 and d["x", "b", "a"]["observed_difference"] == 1.5 and d["x", "b", "a"]["upper_95"] == 1 and d["y", "a", "b"]["observed_difference"] is None
    assert evaluation.paired_differences(observed, samples, [], "method", ["x"], [("b", "a")]).count() == 1
    assert evaluation.unique_row(observed, method="a")["x"] == 2.0
    with pytest.raises(ValueError, match="no row"):
        evaluation.unique_row(observed, method="q")


def test_strict_scans(spark, tmp_path):
    folder = tmp_path / "labels" / "train"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_text("1 0.5 0.5 0.2 0.2\n\n2 0.5 0.5 1 1\n")
    images = spark.createDataFrame([("a", "images/train/a.jpg", 20, 10)], "stem string, image string, width int, height int")
    lines = lambda: scans.annotation_lines(spark, str(folder))
    truth = scans.strict_boxes(lines(), images)
    assert truth.count() == 2
    assert sorted((r["area"], r["area_share"]) for r in scans.box_records(truth, images).collect()) == [(pytest.approx(8.0), pytest.approx(0.04)), (200.0, 1.0)]
    assert sorted((r["class_id"], r["n"]) for r in scans.lenient_classes(lines()).collect()) == [(1, 1), (2, 1)]
    for line in ("1.0 0.5 0.5 0.2 0.2", "9 0.5 0.5 0.2 0.2", "1 0.5 0.5 0 0.2", "1 nan 0.5 0.2 0.2", "1 0.5 0.5 0.2", "1 0.5 1.5 0.2 0.2", "x 1 1 1 1"):
        (folder / "a.txt").write_text(f"1 0.5 0.5 0.2 0.2\n{line}\n")
        with pytest.raises(Exception, match="bad annotation at train/a.txt:2"):
            scans.strict_boxes(lines(), images).collect()
    (folder / "b.txt").write_text("\n")  # an empty file is no row of a text scan
    with pytest.raises(ValueError, match="no image for label file train/b.txt"):
        scans.strict_boxes(lines(), images)
    m = tmp_path / "m.txt"
    m.write_text("images/train/a.jpg\nimages/train/b.jpg\n")
    digest = scans.manifest_digest(spark, str(m))
    assert scans.frozen_manifest(spark, str(m), digest, 2).count() == 2
    for d, n in ((digest, 3), ("0" * 64, 2)):
        with pytest.raises(ValueError):
            scans.frozen_manifest(spark, str(m), d, n)
    (tmp_path / "log.csv").write_text("epoch,m\n1,0.10\n2,0.70\n3,0.7\n")
    assert scans.selected_epoch(spark, str(tmp_path / "log.csv"), 3, "m")[0] == 2
    with pytest.raises(ValueError):
        scans.selected_epoch(spark, str(tmp_path / "log.csv"), 4, "m")
    (tmp_path / "o.json").write_text('{"a": 1}')
    (tmp_path / "l.json").write_text("[1]")
    (tmp_path / "c.yaml").write_text("lr: 0.1\nseed: 3\n")
    assert scans.json_object(spark, str(tmp_path / "o.json")) == {"a": 1} and scans.yaml_object(spark, str(tmp_path / "c.yaml"), {"lr", "seed"}) == {"lr": 0.1, "seed": 3}
    with pytest.raises(ValueError, match="no JSON object"):
        scans.json_object(spark, str(tmp_path / "l.json"))
    with pytest.raises(ValueError, match="unknown settings"):
        scans.yaml_object(spark, str(tmp_path / "c.yaml"), {"lr"})
    files = spark.createDataFrame([("b", "2"), ("a", "1")], "file string, value string")
    assert scans.label_inventory_digest(files) == scans.label_inventory_digest(files.orderBy("file"))


def test_dataset_problems(spark):
    images = spark.createDataFrame([("train", "t/a", "a"), ("val", "v/a", "a"), ("val", "v/b", "b")], "split string, image string, stem string")
    labels = spark.createDataFrame([("train", "a"), ("val", "a"), ("val", "c")], "split string, stem string")
    listed = spark.createDataFrame([("t/a",), ("t/a",), ("v/q",), ("v/a",)], "image string")
    got = {r["problem"]: r["n"] for r in scans.dataset_problems(images, labels, listed, ["x"], ["y"]).collect()}
    assert got == {"image_without_label": 1, "label_without_image": 1, "listed_without_image": 1, "not_listed": 1, "listed_twice": 1, "stem_in_two_splits": 1, "class_names_differ": 1}


def png(image, rule):
    h, w, c = image.shape
    flat, lines = image.reshape(h, w * c).astype(int), b""
    for y in range(h):
        up = flat[y - 1] if y else np.zeros(w * c, int)
        left = np.concatenate([np.zeros(c, int), flat[y][:-c]])
        corner = np.concatenate([np.zeros(c, int), up[:-c]])
        p = left + up - corner
        near = np.argmin([abs(p - left), abs(p - up), abs(p - corner)], axis=0)
        guess = [np.zeros(w * c, int), left, up, (left + up) // 2, np.choose(near, [left, up, corner])][rule]
        lines += bytes([rule]) + bytes(((flat[y] - guess) % 256).tolist())
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_images_from_bytes_to_shortlist(spark):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (7, 5, 3)).astype(np.uint8)
    assert all((pictures.decode(png(image, rule)) == image).all() for rule in range(5))
    assert (pictures.decode(png(image[:, :, :1], 4)) == image[:, :, :1]).all()
    assert (pictures.decode(b"P6\n# made here\n5 7\n255\n" + image.tobytes()) == image).all()
    smooth = [np.kron(rng.integers(0, 256, (8, 8)), np.ones((16, 16)))[:, :, None].astype(np.uint8) for _ in range(6)]
    moved = [np.roll(s, 2, axis=1) for s in smooth]
    files = lambda xs: spark.createDataFrame([(f"{i}.png", bytearray(png(x, 1))) for i, x in enumerate(xs)] + [("broken.png", bytearray(b"no"))], "path string, content binary")
    left, right = pictures.scanned(files(smooth)).cache(), pictures.scanned(files(moved)).cache()
    assert left.where("readable").count() == 6 and left.where("NOT readable").first()["phash"] is None
    found = pictures.near_duplicate_cascade(left, right, Protocol().tiers)
    best = {(r["left_id"], r["right_id"]): r for r in found["compared"].collect()}
    assert {(f"{i}.png", f"{i}.png") for i in range(6)} <= set(best)
    assert all(abs(best[f"{i}.png", f"{i}.png"]["best_dx"]) == 1 and best[f"{i}.png", f"{i}.png"]["aligned_mae"] < best[f"{i}.png", f"{i}.png"]["original_mae"] for i in range(6))
    same = pictures.near_duplicate_cascade(left, left.withColumn("path", F.concat(F.lit("copy-"), "path")), Protocol().tiers)
    assert same["shortlist"].count() == 6 and same["compared"].where("tier_A").count() == 6
    blob = spark.createDataFrame([(bytearray(b"hello\r\n"),)], "c binary")
    assert blob.select(pictures.git_blob_id(F.col("c")), pictures.text_blob_id(F.col("c"))).first()[1] == "ce013625030ba8dba906f756967f9e9ca394464a"


def test_detected_views(spark):
    image = np.zeros((20, 20, 1), np.uint8)
    image[5:10, 5:10] = 200

    def predictor(x):
        yy, xx = np.nonzero(x[:, :, 0] > 150)
        return [(0, 0.9, float(xx.min()), float(yy.min()), float(xx.max() + 1), float(yy.max() + 1))] if len(xx) else []

    files = spark.createDataFrame([("a.png", bytearray(png(image, 0))), ("b.png", bytearray(png(image * 0, 0)))], "path string, content binary")
    seen = pictures.detected(files, predictor, stability.VIEWS).cache()
    assert seen.count() == 2 * 12 and seen.where("image = 'b.png' AND class_id IS NULL").count() == 12
    plain = seen.where("image = 'a.png' AND transform_id = 'original'").first()
    assert (plain["x1"], plain["y1"], plain["x2"], plain["y2"]) == (5.0, 5.0, 10.0, 10.0)
    refs = seen.where("transform_id = 'original' AND class_id IS NOT NULL").select("image", "width", "height", F.lit("a#1").alias("prediction_id"), "class_id", "x1", "y1", "x2", "y2")
    means = stability.two_level_means(stability.match_views(refs, seen.where("transform_id <> 'original' AND class_id IS NOT NULL")), expected=11).first()
    assert means["class_consistency_value"] == 1 and means["localisation_stability_value"] > 0.7


def test_allocation_overshoots_and_exchanges_sizes():
    found = {}
    inside, _ = splits.allocate([("a", (3, 1)), ("b", (3, 1)), ("c", (3, 1))], 4, 0.4, diagnostics=found)
    assert len(inside) == 1 and found["ended"]  # 3 is nearer to 4 than 6
    inside, _ = splits.allocate([("a", (5, 1)), ("b", (5, 1))], 4, 0.4, diagnostics=found)
    assert len(inside) == 1 and found["size"] == 5
    rng = np.random.default_rng(3)
    vectors = [(f"g{i:03}", (int(s), int(rng.integers(0, s + 1)), int(rng.integers(0, 4)))) for i, s in enumerate(rng.integers(1, 5, 60))]
    total = sum(v[0] for _, v in vectors)
    inside, history = splits.allocate(vectors, total // 5, 0.2, diagnostics=found)
    assert abs(sum(v[0] for n, v in vectors if n in inside) - total // 5) == 0 and history[-1] <= history[0] and found["ended"]
    part = np.sum([v for n, v in vectors if n in inside], axis=0)
    assert history[-1] == pytest.approx(splits.balance_score(part[1:], np.sum([v for _, v in vectors], axis=0)[1:], 0.2))
    assert splits.allocate([], 3, 0.5)[0] == set()


def test_sinks_of_single_files(spark, tmp_path):
    sinks.strict_json({"b": 1, "a": [1.5]}, str(tmp_path / "x.json"))
    assert list(json.loads((tmp_path / "x.json").read_text())) == ["a", "b"]
    with pytest.raises(FileExistsError):
        sinks.strict_json({}, str(tmp_path / "x.json"))
    with pytest.raises(ValueError):
        sinks.strict_json({"a": float("nan")}, str(tmp_path / "y.json"))
    d = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    for _ in range(2):
        sinks.replaced_csv(d, str(tmp_path / "t.csv"), ["k"])
    assert (tmp_path / "t.csv").read_bytes() == b"k,v\r\n1,a\r\n2,b\r\n"
    made = sinks.runtime_files({"lr": 0.1}, {"train": ["images/a.png"]}, str(tmp_path), str(tmp_path))
    assert str(tmp_path) in (tmp_path / "train.txt").read_text() and sinks.runtime_files({"lr": 0.1}, {"train": ["images/a.png"]}, str(tmp_path), str(tmp_path)) == made
    with pytest.raises(FileExistsError):
        sinks.runtime_files({"lr": 0.2}, {"train": ["images/a.png"]}, str(tmp_path), str(tmp_path))
    with pytest.raises(ValueError, match="outside"):
        sinks.runtime_files({}, {"val": ["../a.png"]}, str(tmp_path), str(tmp_path))
    sinks.reporting_copies([str(tmp_path / "x.json"), str(tmp_path / "t.csv")], str(tmp_path / "report"), {"t.csv": "by hand"})
    assert sinks.reporting_problems(str(tmp_path / "report"), origins=True) == []
    (tmp_path / "x.json").write_text("{}")
    (tmp_path / "report" / "t.csv").write_text("")
    (tmp_path / "report" / "new").write_text("")
    assert sinks.reporting_problems(str(tmp_path / "report"), origins=True) == ["not listed: new", "changed: t.csv", "origin differs: x.json"]
    assert not list(tmp_path.glob(".*"))


def test_plot_frames(spark):
    curve = spark.createDataFrame([("m", i / 1000, i / 2000) for i in range(1, 1001)], "method string, coverage double, selective_risk double")
    rows = sinks.curve_frame(curve, ["method"], "coverage", "selective_risk", 50).collect()
    assert len(rows) == 50 and max(r["coverage"] for r in rows) == 1.0
    bins = spark.createDataFrame([("m", 0, 30, 0.05, 0.1), ("m", 1, 10, 0.15, 0.1)], "method string, bin int, n long, mean_confidence double, accuracy double")
    assert sorted((r["bin"], round(r["gap"], 6), r["share"]) for r in sinks.reliability_frame(bins, ["method"]).collect()) == [(0, 0.05, 0.75), (1, -0.05, 0.25)]
    table = spark.createDataFrame([("m", 0.5, 0.4, 0.7)], "method string, observed double, lower_95 double, upper_95 double")
    r = sinks.interval_frame(table, ["method"]).first()
    assert (r["below"], r["above"]) == (pytest.approx(0.1), pytest.approx(0.2))


def test_governance(tmp_path):
    import subprocess

    git = lambda *w: subprocess.run(["git", "-C", str(tmp_path), *w], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a").write_text("1")
    git("add", "a")
    git("-c", "user.name=t", "-c", "user.email=t@example.org", "commit", "-qm", "a")
    assert not ledger.require_clean(str(tmp_path))["dirty"]
    (tmp_path / "a").write_text("2")
    with pytest.raises(RuntimeError, match="commit or put away"):
        ledger.require_clean(str(tmp_path))
    digest = sinks.file_digest(str(tmp_path / "a"))
    record = {"status": "complete", "input_sha256": {"i": "1"}, "output_sha256": {"a": digest}}
    assert ledger.bound_artifacts(record, str(tmp_path), ["a"], {"i": "1"}) == {"a": digest}
    for change in ({"status": "running"}, {"input_sha256": {}}, {"output_sha256": {"a": "0"}}, {"output_sha256": {}}):
        with pytest.raises(ValueError):
            ledger.bound_artifacts(record | change, str(tmp_path), ["a"], {"i": "1"})
    with pytest.raises(ValueError, match="no file name"):
        ledger.bound_artifacts(record, str(tmp_path), ["../a"])
    places = {"x": ["new/x", "old/x"]}
    assert ledger.resolved("x", places, lambda p: p == "old/x") == "old/x"
    with pytest.raises(FileNotFoundError):
        ledger.resolved("x", places, lambda p: False)
    with pytest.raises(ValueError, match="several"):
        ledger.resolved("x", places, lambda p: True)
    ledger.refuse_historical("new/x", places)
    with pytest.raises(ValueError, match="historical"):
        ledger.refuse_historical("old/x/", places)
    assert ledger.model_identity(str(tmp_path / "a"), digest)["bytes"] == 1
    with pytest.raises(ValueError, match="not the model"):
        ledger.model_identity(str(tmp_path / "a"), "0")
    done = lambda record, *made: ledger.completion(record, ["p", "q"], lambda p: p in made)
    assert [done(None), done(None, "p"), done({"status": "complete"}, "p", "q"), done({"status": "complete"}, "p"), done({"status": "running"})] == ["new", "blocked", "complete", "blocked", "blocked"]
    ledger.same_draws({"seed": 1, "replicates": 2, "draw_indices_sha256": "d"}, {"seed": 1, "replicates": 2, "draw_indices_sha256": "d"})
    with pytest.raises(ValueError, match="differ in seed"):
        ledger.same_draws({"seed": 1}, {"seed": 2})
    lock, log = str(tmp_path / "lock"), str(tmp_path / "log")
    assert ledger.run_in_turn([["true"], ["false"], ["true"]], lock, {"A": "1"}, log) == [0, 1]
    with ledger.locked(lock), pytest.raises(RuntimeError, match="another run"), ledger.locked(lock):
        pass
    assert not (tmp_path / "lock").exists() and ledger.seeded(5)["PYTHONHASHSEED"] == "5"


def test_crop_reliability(spark):
    image = np.zeros((40, 40, 1), np.uint8)
    image[10:20, 12:24] = 200

    def predictor(x):
        yy, xx = np.nonzero(x[:, :, 0] > 150)
        return [(0, 0.9, float(xx.min()), float(yy.min()), float(xx.max() + 1), float(yy.max() + 1)), (1, 0.005, 0.0, 0.0, 1.0, 1.0)] if len(xx) else []

    files = spark.createDataFrame([("a.png", bytearray(png(image, 0))), ("b.png", bytearray(png(image * 0, 0)))], "path string, content binary")
    made = stages.crop_reliability(files, predictor, stages.calibration.Calibrator("raw"))
    crops = {r["image"]: r for r in made["crops"].collect()}
    assert crops["b.png"]["predictions"] == 0 and crops["b.png"]["crop_risk"] is None
    r = made["predictions"].collect()
    assert len(r) == 1 and r[0]["class_consistency"] == 1 and crops["a.png"]["crop_risk"] == r[0]["risk"]
    want = (89 * 0.1 + 0 + 10 * (1 - r[0]["localisation_stability"])) / 100
    assert r[0]["risk"] == pytest.approx(want) and 0.8 < r[0]["localisation_stability"] <= 1


def test_t_quantiles_and_reporting(spark, tmp_path):
    known = {(0.975, 4): 2.7764451051977987, (0.975, 1): 12.706204736432095, (0.95, 30): 1.697260886593957, (0.025, 9): -2.262157162740992}
    assert all(evaluation.t_quantile(p, n) == pytest.approx(t, rel=1e-9) for (p, n), t in known.items())
    rows = [(k, s, "m", v) for k, pair in enumerate([(1.0, 2.0), (2.0, 2.5), (3.0, 5.0)]) for s, v in zip(("supplied", "similarity_aware"), pair)] + [(0, "supplied", "q", 1.0)]
    made = stages.run(spark, "reporting", {"results": spark.createDataFrame(rows, "seed int, split string, metric string, value double")}, str(tmp_path))
    got = {(r["split"], r["metric"]): (r["seeds"], r["mean"], r["std"]) for r in made["aggregate"].collect()}
    assert got["supplied", "m"] == (3, 2.0, 1.0) and got["supplied", "q"] == (1, 1.0, None)
    d = made["differences"].where("metric = 'm'").first()
    deltas = np.array([1.0, 0.5, 2.0])
    half = evaluation.t_quantile(0.975, 2) * deltas.std(ddof=1) / 3**0.5
    assert (d["n"], d["mean"], d["lower"], d["upper"]) == (3, pytest.approx(deltas.mean()), pytest.approx(deltas.mean() - half), pytest.approx(deltas.mean() + half))


def test_protocol_refuses_what_no_study_can_mean():
    for wrong in ({"weights": (50, 50, 1)}, {"edges": (0.1, 0.1)}, {"budgets": (5, 5)}, {"inclusion": 2.0}, {"folds": 1}, {"replicates": 0}, {"signals": ("a", "b")}, {"tiers": {"A": (2.0, 0.9, None)}}):
        with pytest.raises(ValueError):
            Protocol(**wrong)
