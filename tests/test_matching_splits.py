"""Boxes, matching, stability, groups, splits, near duplicates, sources and ledger."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assaykit.functions import geometry as g
from assaykit.functions.scalar import median_bits, number
from assaykit.operators import matching, neardup, splits, stability, validate
from assaykit.operators.graph import connected_components
from assaykit.plans import ledger
from assaykit.sources import scans, sinks
from assaykit.streaming import incremental

_P = "image string, class_id int, source_row long, confidence double, x1 double, y1 double, x2 double, y2 double"
_T = "image string, class_id int, gt_id string, line long, x1 double, y1 double, x2 double, y2 double"


def test_greedy_cases(spark):
    p = spark.createDataFrame([("d", 0, 1, 0.2, 0.0, 0.0, 4.0, 1.0), ("d", 0, 2, 0.9, 0.0, 0.0, 4.0, 1.0), ("b", 0, 1, 0.5, 0.0, 0.0, 4.0, 1.0), ("c", 1, 1, 0.5, 0.0, 0.0, 4.0, 1.0), ("i", 0, 1, 0.9, 0.0, 0.0, 8.0, 1.0), ("i", 0, 2, 0.8, 0.0, 0.0, 4.0, 1.0)], _P)
    t = spark.createDataFrame([("d", 0, "d1", 1, 0.0, 0.0, 4.0, 1.0), ("b", 0, "b1", 1, 0.0, 0.0, 2.0, 1.0), ("b", 0, "b2", 2, 2.0, 0.0, 4.0, 1.0), ("c", 0, "c1", 1, 0.0, 0.0, 4.0, 1.0), ("i", 0, "i1", 1, 0.0, 0.0, 4.0, 1.0)], _T)
    r = {(x["image"], x["source_row"], x["theta"]): x for x in matching.greedy_match(p, t).collect()}
    assert r["d", 2, 0.5]["status"] == "matched" and r["d", 1, 0.5]["status"] == "duplicate"
    assert r["b", 1, 0.5]["gt_id"] == "b1" and r["b", 1, 0.75]["status"] == "unmatched"
    assert r["c", 1, 0.5]["status"] == "unmatched" and r["c", 1, 0.5]["best_same_class_iou"] == 0 == r["c", 1, 0.5]["best_unused_iou"]
    assert [r["i", k, th]["correct"] for th in (0.5, 0.75) for k in (1, 2)] == [1, 0, 0, 1]


@pytest.mark.parametrize(("iou", "want"), [([[1, 0.5], [0.5, 0.49]], {0: 1, 1: 0}), ([[0.7, 0.8], [0.9, 0.6]], {0: 1, 1: 0}), ([[0.4]], {})])
def test_assignment(iou, want):
    assert matching.assign(np.array(iou, float)) == want


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.randoms(use_true_random=False))
def test_assignment_is_optimal(rows, cols, rnd):
    from itertools import permutations

    iou = np.array([[rnd.choice([0, 0.3, 0.5, 0.6, 0.8, 1]) for _ in range(cols)] for _ in range(rows)], float)
    got = matching.assign(iou)
    best = max((sum(iou[i, j] >= 0.5 for i, j in enumerate(p) if i < rows and j < cols), sum(iou[i, j] for i, j in enumerate(p) if i < rows and j < cols and iou[i, j] >= 0.5)) for p in permutations(range(max(rows, cols))))
    assert (len(got), pytest.approx(sum(iou[i, j] for i, j in got.items()))) == best


def test_polygons():
    assert g.polygon_iou(g.corners((0, 0, 2, 2)), g.corners((1, 1, 3, 3))) == pytest.approx(1 / 7)
    turned = g.map_points(g.corners((0, 0, 2, 2)), g.view_matrix(2, 2, 45))
    assert g.polygon_iou(g.corners((0, 0, 2, 2)), turned) == pytest.approx(1 / np.sqrt(2))
    assert g.polygon_iou(g.corners((0, 0, 10, 10)), g.corners((1, 1, 3, 3))[::-1]) == pytest.approx(0.04)
    assert g.polygon_iou(g.corners((0, 0, 0, 1)), g.corners((0, 0, 1, 1))) == 0


def test_images():
    rng = np.random.default_rng(1)
    a = rng.random((20, 20))
    moved = np.roll(a, 2, axis=1)
    best = g.best_shift(moved, a, 3, 0.8)
    assert (best["dx"], best["dy"], best["overlap"]) == (2, 0, pytest.approx(0.9))
    assert g.similarity(np.ones(4), np.arange(4))[1] is None
    image = rng.integers(0, 255, (9, 11, 3)).astype(np.uint8)
    assert (g.warp(image, g.view_matrix(11, 9)) == image).all()
    assert (g.brightness(image, 1.0) == image).all() and (g.contrast(image, 1.0) == image).all()
    assert g.blur(np.full((5, 5), 7, np.uint8)).tolist() == [[7] * 5] * 5
    assert g.dct_hash(rng.random((32, 32))) & 1 == 0


def test_two_level_means(spark):
    fam = ["brightness"] * 2 + ["contrast"] * 2 + ["blur"] + ["rotation"] * 2 + ["translation"] * 4
    rows = [("p", f, True, 1 if f == "translation" else 0) for f in fam] + [("q", f, f != "rotation", 1 if f == "translation" else 0) for f in fam]
    a = spark.createDataFrame(rows, "prediction_id string, family string, evaluable boolean, v int")
    got = {r["prediction_id"]: r["v"] for r in stability.two_level_means(a, ("v",), 11).collect()}
    assert got == {"p": pytest.approx(0.2), "q": pytest.approx(0.25)}


def test_match_views(spark):
    refs = spark.createDataFrame([("i", 100, 100, "i#1", 3, 20.0, 20.0, 40.0, 40.0), ("i", 100, 100, "i#2", 3, 0.0, 0.0, 5.0, 5.0)], "image string, width int, height int, prediction_id string, class_id int, x1 double, y1 double, x2 double, y2 double")
    dets = spark.createDataFrame([("i", "blur", 4, 20.0, 20.0, 40.0, 40.0), ("i", "translation_right", 3, 22.0, 20.0, 42.0, 40.0)], "image string, transform_id string, class_id int, x1 double, y1 double, x2 double, y2 double")
    r = {(x["prediction_id"], x["transform_id"]): x for x in stability.match_views(refs, dets).collect()}
    assert len(r) == 22
    assert r["i#1", "blur"]["status"] == "matched" and r["i#1", "blur"]["class_consistency_value"] == 0
    assert r["i#1", "translation_right"]["localisation_stability_value"] == pytest.approx(1)
    assert r["i#2", "translation_left"]["status"] == "not_evaluable" and r["i#2", "blur"]["status"] == "unmatched"


def test_components(spark):
    e = spark.createDataFrame([("c", "b"), ("a", "b"), ("y", "z"), ("a", "b"), ("q", "q"), (None, "a")], "u string, v string")
    assert sorted(map(tuple, connected_components(e).collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("y", "y"), ("z", "y")]
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    assert connected_components(chain).where("component = 0").count() == 61
    assert connected_components(chain.limit(0)).count() == 0


def test_groups_folds_and_allocation(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdefgh"], "image string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "left string, right string")
    groups = splits.groups_of(nodes, edges)
    folds = {r["image"]: r["fold_id"] for r in splits.grouped_folds(groups, 3, 7).collect()}
    assert folds["a"] == folds["b"] == folds["c"] and len(folds) == 8 and set(folds.values()) == {0, 1, 2}
    with pytest.raises(ValueError):
        splits.groups_of(nodes, spark.createDataFrame([("a", "zz")], "left string, right string"))
    inside, history = splits.allocate([("a", (1, 4)), ("b", (1, 0)), ("c", (1, 4)), ("d", (1, 0))], 2, 0.5)
    assert len(inside) == 2 and history == sorted(history, reverse=True)
    best = splits.best_allocation(spark, [(5, 1), (1, 5), (3, 3)], (1,)).first()
    assert best["mask"] == 4 and best["mean_difference"] == pytest.approx(0)


def test_near_duplicates(spark):
    rng = np.random.default_rng(0)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 40)]
    other = [b ^ (1 << int(k)) ^ (1 << int(k + 7)) for b, k in zip(base, rng.integers(0, 50, 40))]
    left, right = (spark.createDataFrame([(i, h) for i, h in enumerate(x)], "id long, hash long") for x in (base, other))
    want = {(i, j) for i, a in enumerate(base) for j, b in enumerate(other) if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    got = [(r["left_id"], r["right_id"]) for r in neardup.hamming_pairs(left, right, 3).collect()]
    assert set(got) == want and len(got) == len(want)
    e = spark.createDataFrame([(list(map(float, range(64))),)], "e array<double>").select(median_bits(F.col("e"))).first()[0]
    assert e & (2**64 - 1) == sum(1 << i for i in range(33, 64))
    pairs = spark.createDataFrame([(0.01, 0.99, 3), (0.01, float("nan"), 3), (0.02, 0.98, 7)], "original_mae double, original_pearson double, phash_distance int")
    assert [tuple(r)[3:] for r in neardup.tiers(pairs, {"A": (0.01, 0.99, None), "B": (0.02, 0.98, 6)}).collect()] == [(True, True), (False, False), (False, False)]


def test_validation(spark):
    lines = ["", "1 2", "a 0 0 1 1", "1.5 0 0 1 1", "1 0.5 0.5 0 1", "1 2 0 1 1", "1 0.5 0.5 2 1", "1 0.5  0.5 1 1"]
    d = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, line string").orderBy("i")
    got = [r[0] for r in d.select(validate.annotation_issue(F.col("line"), 9)).collect()]
    assert got == ["empty_line", "expected_5_values_got_2", "non_numeric", "non_integer_class", "non_positive_box_size", "center_outside_normalized_range", "size_outside_normalized_range", None]
    assert [r[0] for r in spark.createDataFrame([(" ",), ("1.5",), ("nan",), ("x",)], "t string").select(number(F.col("t"))).collect()] == [None, 1.5, None, None]
    with pytest.raises(Exception, match="expectation failed: small"):
        validate.enforce(spark.range(3), [validate.Expectation("small", F.col("id") < 2)]).collect()
    assert validate.enforce(spark.range(2), [validate.Expectation("small", F.col("id") < 2)]).count() == 2


def test_sources_and_sinks(spark, tmp_path):
    for s in ("train", "val"):
        (tmp_path / "images" / s).mkdir(parents=True)
        (tmp_path / "images" / s / f"{s}1.JPG").write_bytes(b"x")
        (tmp_path / "images" / s / "note.txt").write_bytes(b"x")
    assert sorted(r["image"] for r in scans.inventory(spark, str(tmp_path)).collect()) == ["images/train/train1.JPG", "images/val/val1.JPG"]
    (tmp_path / "m.txt").write_bytes(b"images/train/a.jpg\r\nimages/../b.jpg\n")
    assert [(r["pos"], r["ok"]) for r in scans.manifest(spark, str(tmp_path / "m.txt")).collect()] == [(0, True), (1, False)]
    (tmp_path / "labels" / "train").mkdir(parents=True)
    (tmp_path / "labels" / "train" / "a.txt").write_text("1 0.5 0.5 0.2 0.2\n\n2 0.5 0.5 1 1\n")
    images = spark.createDataFrame([("a", "images/train/a.jpg", 20, 10)], "stem string, image string, width int, height int")
    b = scans.boxes(scans.annotation_lines(spark, str(tmp_path / "labels" / "train")), images).orderBy("line").collect()
    assert [(r["gt_id"], r["x1"], r["y2"]) for r in b] == [("labels/train/a.txt:1", 8.0, 6.0), ("labels/train/a.txt:3", 0.0, 10.0)]
    (tmp_path / "log.csv").write_text(" epoch, mAP \n1, 0.5\n2, 0.7\n3, 0.7\n")
    log = scans.training_log(spark, str(tmp_path / "log.csv"), ["mAP"])
    from assaykit.operators.ranking import best_row

    assert scans.contiguous(log, 3) and best_row(log, [], "mAP", "epoch").first()["epoch"] == 2
    d = spark.createDataFrame([("b", 2.0, None), ("a", 1.0, "02092026")], "k string, v double, s string")
    sinks.exclusive_csv(d, str(tmp_path / "out"), ["k"])
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_bytes().startswith(b"k,v,s\r\na,1.0,02092026\r\n")
    assert scans.text_csv(spark, str(tmp_path / "out")).orderBy("k").first()["s"] == "02092026"
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.exclusive_csv(d, str(tmp_path / "out"), ["k"])
    sinks.sorted_json(d.withColumn("v", F.lit(float("nan"))), str(tmp_path / "j"))
    assert '"v":null' in "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))


def test_ledger_blocks_a_second_run(spark, tmp_path):
    d = spark.range(5)
    out = ledger.recorded(spark, str(tmp_path / "l"), "x", {"seed": 1}, {"in": d}, lambda: {"out": d.where("id > 2")})
    assert out["out"].count() == 2
    with pytest.raises(RuntimeError):
        ledger.recorded(spark, str(tmp_path / "l"), "x", {"seed": 1}, {"in": d}, dict)
    with pytest.raises(ZeroDivisionError):
        ledger.recorded(spark, str(tmp_path / "l"), "y", {}, {"in": d}, lambda: {"a": 1 / 0})
    states = {(r["experiment"], r["status"]) for r in spark.read.parquet(str(tmp_path / "l")).collect()}
    assert states == {("x", "running"), ("x", "complete"), ("y", "running"), ("y", "incomplete")}


def test_running_best_and_dual_sink(spark, tmp_path):
    src = str(tmp_path / "src")
    d = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.7), ("a", 3, 0.7), ("b", 1, 0.1)], "k string, epoch long, m double")
    d.write.parquet(src)
    stream = spark.readStream.schema(d.schema).parquet(src)
    q = incremental.running_best(stream, "k", "epoch", "m").writeStream.format("memory").queryName("best").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.sql("SELECT * FROM best").collect())) == [("a", 2, 0.7), ("b", 1, 0.1)]
    incremental.dual_sink(stream, (lambda b: b.where("m > 0.5"), str(tmp_path / "hi")), (lambda b: b.groupBy("k").count(), str(tmp_path / "n")), str(tmp_path / "c2")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "hi")).count() == 2 and spark.read.parquet(str(tmp_path / "n")).count() == 2


def test_match_views_breaks_ties_by_arrival(spark):
    refs = spark.createDataFrame([("i", 100, 100, "i#1", 5, 20.0, 20.0, 40.0, 40.0)], "image string, width int, height int, prediction_id string, class_id int, x1 double, y1 double, x2 double, y2 double")
    dets = spark.createDataFrame([("i", "blur", 5, 20.0, 20.0, 40.0, 40.0, 0), ("i", "blur", 3, 20.0, 20.0, 40.0, 40.0, 1)], "image string, transform_id string, class_id int, x1 double, y1 double, x2 double, y2 double, detection_index int")
    for d in (dets, dets.orderBy(F.desc("detection_index"))):
        (r,) = stability.match_views(refs, d).where("transform_id = 'blur'").collect()
        assert (r["class_consistency_value"], r["detection_id"]) == (1, 0)


def test_hamming_pairs_at_ten_compare_few(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 400)]
    other = [b ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 14), replace=False)) - (0) for b in base]
    other = [(x + 2**63) % 2**64 - 2**63 for x in other]
    left, right = (spark.createDataFrame([(i, h) for i, h in enumerate(x)], "id long, hash long") for x in (base, other))
    far = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    want = {(i, j, far(a, b)) for i, a in enumerate(base) for j, b in enumerate(other) if far(a, b) <= 10}
    got = [tuple(r) for r in neardup.hamming_pairs(left, right, 10).collect()]
    assert len(want) > 200 and set(got) == want and len(got) == len(want)
    assert neardup.hamming_candidates(left, right, 10).count() < 0.05 * 400 * 400
    for distance in (0, 1, 18):
        assert {tuple(r)[:2] for r in neardup.hamming_pairs(left, right, distance).collect()} == {(i, j) for i, a in enumerate(base) for j, b in enumerate(other) if far(a, b) <= distance}


def test_folds_are_even_seeded_and_checked(spark):
    rng = np.random.default_rng(2)
    groups, at = [], 0
    for size in [9, 4, 4, 3, 3, 3, 2, 2, *[1] * 50]:
        groups += [(f"n{at + i:03}", f"n{at:03}") for i in range(size)]
        at += size
    df = spark.createDataFrame([groups[i] for i in rng.permutation(len(groups))], "image string, component string")
    dealt = {s: splits.grouped_folds(df, 5, s) for s in (1, 2)}
    place = {s: {r["image"]: r["fold_id"] for r in d.collect()} for s, d in dealt.items()}
    assert place[1] != place[2] and place[1] == {r["image"]: r["fold_id"] for r in splits.grouped_folds(df.repartition(7), 5, 1).collect()}
    sizes = [list(place[1].values()).count(f) for f in range(5)]
    assert max(sizes) - min(sizes) <= 1 and all(place[1][i] == place[1][c] for i, c in groups)
    rows = spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(groups)] + [("stranger", 1)], "image string, y int")
    found = {r["problem"]: r["n"] for r in splits.fold_problems(dealt[1], rows, 5, "y").collect()}
    assert found == {"without_fold": 1, "in_two_folds": 0, "group_cut": 0, "empty_folds": 0, "folds_of_one_label": 0}


def test_component_digests_of_large_groups(spark, monkeypatch):
    names = [f"x{i:02}" for i in range(25)]
    df = spark.createDataFrame([(n, "x00") for n in names] + [("z", "z")], "image string, component string")
    line = lambda x: splits.digest_of(list(x))
    assert {r["component"]: (r["size"], r["component_id"]) for r in splits.component_ids(df).collect()} == {"x00": (25, line(names)), "z": (1, line(["z"]))}
    monkeypatch.setattr(splits, "DIGEST_PART", 10)
    want = line([line(names[:10]), line(names[10:20]), line(names[20:])])
    assert {r["component"]: r["component_id"] for r in splits.component_ids(df).collect()} == {"x00": want, "z": line(["z"])}


def test_only_polygons_that_may_match_are_clipped(monkeypatch):
    clipped = []
    monkeypatch.setattr(stability, "polygon_iou", lambda a, b, f=stability.polygon_iou: clipped.append(1) or f(a, b))
    view = next(v for v in stability.VIEWS if v["id"] == "rotation_plus")
    boxes = [[30.0, 30.0, 40.0, 50.0], [38.0, 30.0, 48.0, 50.0], [30.0, 46.0, 40.0, 66.0]]  # neighbours overlap a little
    m = stability.matrix_of(view, 80, 100)
    own = [{"width": 80.0, "height": 100.0, "prediction_id": str(i), "class_id": 0, "box": b} for i, b in enumerate(boxes)]
    seen = []
    for b in boxes:
        q = stability.map_points(stability.corners(b), m)
        seen.append({"class_id": 0, "box": [*q.min(0).tolist(), *q.max(0).tolist()]})
    rows = stability._match_view("i", own, seen, view, 0.5, False, {})
    assert [r[6] for r in rows] == [0, 1, 2] and all(r[9] > 0.5 and r[10] is None for r in rows) and len(clipped) == 3


def test_views_of_many_images_match_as_one_by_one(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        w, h = (64.0, 80.0) if i % 3 else (50.0, 60.0)
        for k in range(int(rng.integers(1, 7))):
            x, y = rng.integers(0, 12, 2) if i % 2 else rng.integers(0, 40, 2)  # every other image is crowded
            rows.append((f"i{i:03}" if i else None, w, h, f"i{i:03}#{k}", int(rng.integers(0, 3)), float(x), float(y), float(x + rng.integers(1, 20)), float(y + rng.integers(1, 20)), bool(rng.random() < 0.7), k))
    rows.append(("i009", 70.0, 80.0, "i009#9", 1, 3.0, 3.0, 9.0, 9.0, True, 9))
    d = spark.createDataFrame(rows, "image string, width double, height double, prediction_id string, class_id int, x1 double, y1 double, x2 double, y2 double, seen boolean, arrival int")
    dets = d.where("seen").select("image", "class_id", "x1", "y1", "x2", "y2", F.col("arrival").alias("detection_index"), F.explode(F.array(*(F.lit(v["id"]) for v in stability.VIEWS))).alias("transform_id"))
    key = lambda df: {r["prediction_id"]: tuple(r[c] for c in ("evaluable_views", "evaluable_families", "class_consistency_value", "localisation_stability_value")) for r in df.collect()}
    want = key(stability.two_level_means(stability.match_views(d, dets, polygons=False), expected=11))
    got = key(stability.view_means(d.repartition(3)))
    assert set(got) == set(want) and len(got) == len(rows)
    assert all(a == pytest.approx(b, abs=1e-7) for p in got for a, b in zip(got[p], want[p]))


def test_polygons_meet_boxes_all_at_once():
    rng = np.random.default_rng(5)
    polygons, boxes = [], []
    for degrees in (2.0, -2.0, 30.0, 90.0, 180.0):
        for _ in range(60):
            box = lambda: (lambda p, q: [*p, *(p + q)])(rng.integers(0, 8, 2).astype(float), rng.integers(0, 9, 2).astype(float))
            polygons.append(g.map_points(g.corners(box()), g.view_matrix(16, 16, degrees)))
            boxes.append(box())
    got = g.polygon_box_ious(np.array(polygons), np.array(boxes))
    assert np.abs(got - [g.polygon_iou(g.corners(b), p) for p, b in zip(polygons, boxes)]).max() < 2e-7
