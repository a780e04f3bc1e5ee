"""Entry points of a study's stages: each checks its inputs, runs under the ledger and writes its tables once.

A stage is a function from named tables to named tables. ``run`` gives it what an earlier stage wrote (or the caller has),
validates, records inputs and outputs in the ledger, and writes every result as Parquet under ``<root>/<stage>/<table>``. A
stage that has run is not run again; one that began and failed blocks until a person clears it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions.scalar import bin_of
from assaykit.lineage import cut
from assaykit.operators import audit, bootstrap, calibration, evaluation, matching, neardup, populations, ranking, review, risk, splits, stability, validate
from assaykit.plans import ledger, runs
from assaykit.protocol import Protocol
from assaykit.sources import scans, sinks
from assaykit.sources.images import detected

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    """A named step: the tables it needs, and the function that makes its own."""

    name: str
    needs: tuple[str, ...]
    make: Callable[[SparkSession, Tables, Protocol], Tables]


STAGES: dict[str, Stage] = {}


def stage(*needs: str) -> Callable:
    def add(f: Callable[[SparkSession, Tables, Protocol], Tables]) -> Callable:
        STAGES[f.__name__] = Stage(f.__name__, needs, f)
        return f

    return add


def run(spark: SparkSession, name: str, inputs: Tables, root: str, protocol: Protocol = Protocol()) -> Tables:
    """Run one stage and return its tables, reread from where they have been written."""
    s = STAGES[name]
    if lost := [n for n in s.needs if n not in inputs]:
        raise ValueError(f"{name} needs {', '.join(lost)}")
    own = {n: inputs[n] for n in s.needs}

    def make() -> Tables:
        out = {}
        for table, df in s.make(spark, own, protocol).items():
            sinks.exclusive_parquet(df, f"{root}/{name}/{table}")
            out[table] = spark.read.parquet(f"{root}/{name}/{table}")
        return out

    return ledger.recorded(spark, f"{root}/ledger", name, protocol, own, make)


def outputs(spark: SparkSession, name: str, root: str, tables: tuple[str, ...]) -> Tables:
    """What a stage that is complete in the ledger has written; the tables must still be as they were recorded."""
    rows = spark.read.parquet(f"{root}/ledger").where((F.col("experiment") == name) & (F.col("status") == "complete")).collect()
    if len(rows) != 1:
        raise ValueError(f"{name} is not complete")
    out = {}
    for t in tables:
        df = spark.read.parquet(f"{root}/{name}/{t}")
        if rows[0]["outputs"].get(t) != ledger.fingerprint(df):
            raise ValueError(f"{name}/{t} is not what the stage wrote")
        out[t] = df
    return out


def _chosen(p: Protocol) -> tuple[str, ...]:
    """The methods that selective review compares: single signals and the fusion."""
    return ("raw_risk", "calibrated_risk", "class_risk", "localisation_risk", "weighted_risk")


@stage("images", "labels", "manifests")
def dataset_verification(spark, t, p):
    """Images, labels and manifests against each other."""
    problems = scans.dataset_problems(t["images"], t["labels"], t["manifests"], [], [])
    populations.require(problems, "data set")
    return {"problems": problems}


@stage("truth", "images", "annotation_lines")
def dataset_audit(spark, t, p):
    """What the annotations hold: issues, class counts, boxes, image sizes."""
    issues = t["annotation_lines"].groupBy(validate.annotation_issue(F.col("value"), p.classes).alias("issue")).agg(F.count(F.lit(1)).alias("n"))
    records = cut(scans.box_records(t["truth"], t["images"]))
    return {
        "issues": issues.where("issue IS NOT NULL"),
        "classes": t["truth"].groupBy("class_id").agg(F.count(F.lit(1)).alias("boxes"), F.count_distinct("image").alias("images")),
        "boxes": audit.describe(records, ["class_id"], "area"),
        "sizes": audit.sizes(t["images"]),
        "imbalance": audit.imbalance(t["truth"], "class_id"),
    }


@stage("candidates", "decisions")
def near_duplicates(spark, t, p):
    """Tiers and shortlist of compared pairs, and those that a person confirmed."""
    tiered = cut(neardup.tiers(t["candidates"], p.tiers))
    short = cut(neardup.shortlist(tiered))
    return {"tiers": tiered, "shortlist": short, "confirmed": neardup.confirmed(short, t["decisions"])}


@stage("images", "confirmed", "truth")
def similarity_split(spark, t, p):
    """Groups of confirmed pairs, and a split that keeps them whole and mirrors the classes."""
    groups = cut(splits.groups_of(t["images"], t["confirmed"].select(F.col("train_file").alias("left"), F.col("val_file").alias("right"))))
    boxes = t["truth"].select("image", "class_id")
    vectors = splits.group_vectors(groups, boxes, p.classes).orderBy("component").collect()
    total, found = sum(r["size"] for r in vectors), {}
    share = 0.2
    inside, _ = splits.allocate([(str(r["component"]), tuple(r[1:])) for r in vectors], round(share * total), share, diagnostics=found)
    chosen = spark.createDataFrame([(i,) for i in sorted(inside)], "component string")
    part = groups.join(chosen.withColumn("inside", F.lit(True)), "component", "left")
    split = part.select("image", "component", F.when(F.col("inside"), "val").otherwise("train").alias("split"))
    report = spark.createDataFrame([(found["size"], found["target"], found["exchanges"], found["ended"], found["scores"])], "size long, target long, exchanges int, ended boolean, scores array<double>")
    return {"split": split, "report": report, "problems": splits.split_problems(split, t["images"], groups)}


@stage("predictions", "images")
def confidence_distribution(spark, t, p):
    """Validated predictions, how many there are for each image, and where their confidences lie."""
    rows = cut(validate.enforce(t["predictions"], validate.prediction_expectations(p.classes)))
    per = t["images"].join(rows.groupBy("image").agg(F.count(F.lit(1)).alias("n")), "image", "left").fillna(0, ["n"])
    whole = per.agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("n") == 0).alias("empty"), F.min("n").alias("low"), F.avg("n").alias("mean"), F.max("n").alias("high"))
    bins = rows.select(bin_of(F.col("confidence"), p.edges).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    kept = rows.agg(*(F.count_if(F.col("confidence") >= e).alias(f"from_{i}") for i, e in enumerate(p.edges)))
    return {"per_image": per, "summary": ranking.with_quantiles(whole, per, [], "n", {"median": 0.5}), "histogram": bins, "retained": kept}


@stage("predictions", "truth")
def calibration_analysis(spark, t, p):
    """Included predictions matched with the truth, and how their confidences are calibrated, as a whole and by class."""
    rows = scans.numbered(t["predictions"], ["image"], ["x1", "y1", "x2", "y2", "class_id", "confidence"])
    kept = populations.included(rows, "confidence", p.inclusion).withColumn("source_row", F.col("source_row").cast("long"))
    matched = cut(matching.greedy_match(kept, t["truth"], p.iou_thresholds).join(kept.select("image", "source_row", "prediction_id", "confidence"), ["image", "source_row"]))
    whole = calibration.calibration_metrics(matched, ["theta"], "confidence", "correct")
    by_class = calibration.calibration_metrics(matched, ["theta", "class_id"], "confidence", "correct")
    return {"matches": matched, "metrics": whole, "by_class": by_class, "bins": calibration.reliability_bins(matched, ["theta"], "confidence", "correct")}


@stage("population", "groups")
def calibrator_comparison(spark, t, p):
    """Calibrators cross-fitted on folds that keep groups whole, their metrics, intervals and the choice among them."""
    rows, methods = t["population"].drop("fold_id"), ("raw", *calibration.METHODS)
    folds = cut(splits.grouped_folds(t["groups"], p.folds, p.seed))
    problems = cut(splits.fold_problems(folds, rows, p.folds, "correct"))
    populations.require(problems, "folds")
    joined = populations.looked_up(rows, folds, ["image"], ["fold_id"])
    oof = cut(calibration.cross_fit(joined, "raw_confidence", "correct", "fold_id", p.folds))
    metrics = cut(calibration.calibration_metrics(oof, ["method"], "probability", "correct"))
    draws = cut(bootstrap.draw_table(t["groups"].select("image").distinct(), p.replicates, p.seed))
    samples = cut(bootstrap.loss_bootstrap(calibration.add_losses(oof, "probability", "correct"), draws, ["method"], ["nll", "brier"]))
    pairs = cut(evaluation.paired_differences(metrics, samples, [], "method", ["nll", "brier"]))
    intervals = {(r["method_a"], r["method_b"], r["metric"]): (r["lower_95"], r["upper_95"]) for r in pairs.collect()}
    observed = {(r["method"], m): r[m] for r in metrics.collect() for m in ("nll", "brier")}
    choice = calibration.choose_method(intervals, observed)
    return {
        "folds": folds, "out_of_fold": oof, "metrics": metrics, "differences": pairs,
        "intervals": evaluation.evaluation_table(metrics, samples, ["method"], ["nll", "brier"]),
        "choice": spark.createDataFrame([(choice, len(methods))], "method string, compared int"),
    }


@stage("population", "choice")
def final_calibrator(spark, t, p):
    """The chosen calibrator fitted on the whole population, and the population with its probabilities."""
    method = t["choice"].first()["method"]
    fit = calibration.fit_calibrator(t["population"], "raw_confidence", "correct", method)
    rows = [(fit.method, list(fit.parameters), list(fit.x), list(fit.y))]
    return {
        "calibrator": spark.createDataFrame(rows, "method string, parameters array<double>, x array<double>, y array<double>"),
        "calibrated": t["population"].withColumn("calibrated_confidence", fit.apply(F.col("raw_confidence"))),
    }


def saved_calibrator(df: DataFrame) -> calibration.Calibrator:
    """A calibrator as ``final_calibrator`` wrote it."""
    r = evaluation.unique_row(df)
    return calibration.Calibrator(r["method"], tuple(r["parameters"]), tuple(r["x"]), tuple(r["y"]))


@stage("references", "views")
def transformation_stability(spark, t, p):
    """Checked views matched back to their references, and the two-level means of each prediction."""
    names = tuple(v["id"] for v in stability.VIEWS)
    problems = cut(populations.view_problems(t["views"], t["references"], names, p.max_detections, p.classes))
    populations.require(problems, "views")
    matched = cut(stability.match_views(t["references"], t["views"].where("class_id IS NOT NULL")))
    means = stability.two_level_means(matched, expected=len(names))
    families = stability.family_scores(matched, "localisation_stability_value", sorted({v["family"] for v in stability.VIEWS}))
    return {"matches": matched, "means": means, "families": families}


def _evaluated(spark, rows: DataFrame, images: DataFrame, p: Protocol, names: list[str]) -> Tables:
    wide = cut(rows.select("image", "incorrect", *(risk.risk_columns(p.weights)[n].alias(n) for n in names)))
    long_ = wide.unpivot(["image", "incorrect"], names, "method", "risk")
    observed = cut(ranking.auroc_ap(long_, ["method"], "risk", "incorrect").select("method", "auroc", "ap"))
    samples = cut(bootstrap.ranking_bootstrap(wide, spark, images, names, "incorrect", p.replicates, p.seed))
    return {
        "methods": evaluation.evaluation_table(observed, samples, ["method"], ["auroc", "ap"]),
        "differences": evaluation.paired_differences(observed, samples, [], "method", ["auroc"]),
    }


def _checked(t: Tables, p: Protocol) -> DataFrame:
    populations.require(populations.population_problems(t["population"], t["images"], p.signals, "correct", least=p.inclusion), "population")
    return t["population"].withColumn("incorrect", 1 - F.col("correct"))


@stage("population", "images")
def risk_evaluation(spark, t, p):
    """Eight risk scores: ranking quality with intervals, all paired differences, signals by correctness and correlation."""
    rows = _checked(t, p)
    long_ = rows.unpivot("correct", list(p.signals), "signal", "x")
    out = _evaluated(spark, rows, t["images"], p, [n for n in risk.risk_columns() if n != "weighted_risk"])
    correlations = None
    for i, a in enumerate(p.signals):
        for b in p.signals[i + 1 :]:
            one = evaluation.labelled(ranking.spearman(rows, a, b), signal_a=a, signal_b=b)
            correlations = one if correlations is None else correlations.union(one)
    by_class = ranking.auroc_ap(risk.risk_scores(rows, ["class_id", "incorrect"], None), ["method", "class_id"], "risk", "incorrect")
    status = F.when(F.col("auroc").isNotNull(), "defined").when(F.col("n_pos") == 0, "no_incorrect").otherwise("no_correct")
    return out | {"descriptives": ranking.descriptives(long_, ["correct", "signal"], "x"), "correlations": correlations, "by_class": by_class.withColumn("status", status)}


@stage("population", "images")
def weighted_fusion(spark, t, p):
    """The weight triple with the best ranking over folds, and how the fusion does beside its parts on two targets."""
    rows = _checked(t, p)
    evaluated = cut(risk.evaluate_grid(rows, risk.weight_grid(spark)))
    chosen = cut(risk.select_weights(evaluated))
    w = chosen.first()
    own = Protocol(weights=(w["conf"], w["cls"], w["loc"]), replicates=p.replicates, seed=p.seed)
    names = ["calibrated_risk", "equal_risk", "weighted_risk"]
    out = _evaluated(spark, rows, t["images"], own, names)
    tables = {k: evaluation.labelled(v, target="primary") for k, v in out.items()}
    if "correct_secondary" in rows.columns:
        other = _evaluated(spark, rows.withColumn("incorrect", 1 - F.col("correct_secondary")), t["images"], own, names)
        tables = {k: v.union(evaluation.labelled(other[k], target="secondary")) for k, v in tables.items()}
    return tables | {"grid": evaluated, "weights": chosen}


def _reviewed(spark, t: Tables, p: Protocol, thresholds: DataFrame | None) -> Tables:
    rows = _checked(t, p)
    names = list(_chosen(p))
    wide = cut(rows.select("image", "incorrect", *(risk.risk_columns(p.weights)[n].alias(n) for n in names)))
    long_ = cut(wide.unpivot(["image", "incorrect"], names, "method", "risk"))
    crops = cut(review.crop_risks(t["images"], long_, ["method"], "risk", "incorrect"))
    if thresholds is None:
        thresholds = cut(review.review_thresholds(crops, ["method"], p.budgets))
    curve = cut(review.coverage_curve(long_, ["method"], "risk", "incorrect"))
    areas = cut(review.aurc(curve, ["method"]))
    referral = cut(review.referral_metrics(crops, thresholds, ["method"]))
    sampled = cut(review.referral_bootstrap(crops, thresholds, "method", t["images"], p.replicates, p.seed))
    ranked = cut(bootstrap.ranking_bootstrap(wide, spark, t["images"], names, "incorrect", p.replicates, p.seed))
    pairs = [("weighted_risk", "raw_risk"), ("weighted_risk", "calibrated_risk")]
    compared = ["error_capture", "automatic_error_rate"]
    whole = F.lit(None).cast("int").alias("budget_percent")
    intervals = evaluation.evaluation_table(referral, sampled, ["method", "budget_percent"], list(review.REFERRAL))
    area_rows = evaluation.evaluation_table(areas, ranked, ["method"], ["aurc"])
    differences = evaluation.paired_differences(referral, sampled, ["budget_percent"], "method", compared, pairs)
    area_pairs = evaluation.paired_differences(areas, ranked, [], "method", ["aurc"], pairs)
    return {
        "curve": curve, "aurc": areas, "thresholds": thresholds, "crops": crops, "referral": referral,
        "intervals": intervals.unionByName(area_rows.select("*", whole)),
        "differences": differences.unionByName(area_pairs.select("*", whole)),
    }


@stage("population", "images")
def selective_review(spark, t, p):
    """Risk-coverage curves, thresholds for the budgets, what referral achieves, intervals and paired differences."""
    return _reviewed(spark, t, p, None)


@stage("population", "images", "thresholds", "calibrator")
def final_evaluation(spark, t, p):
    """The same on a population that was held out: calibrator and thresholds are applied as they were frozen."""
    fit = saved_calibrator(t["calibrator"])
    own = t | {"population": t["population"].withColumn("calibrated_confidence", fit.apply(F.col("raw_confidence")))}
    missing = t["thresholds"].groupBy("method").agg(F.sort_array(F.collect_set("budget_percent")).alias("b"))
    frozen = {r["method"]: tuple(r["b"]) for r in missing.collect()}
    if frozen != dict.fromkeys(_chosen(p), tuple(sorted(p.budgets))):
        raise ValueError("the frozen thresholds are not those of the methods and budgets")
    return _reviewed(spark, own, p, t["thresholds"].select("method", "budget_percent", "threshold"))


@stage("timings")
def computational_efficiency(spark, t, p):
    """Mean times, latency, throughput and overhead of measured pipelines."""
    return {"summary": runs.timing_summary(t["timings"], "baseline")}


@stage("results")
def reporting(spark, t, p):
    """Repeated runs: mean and sample deviation of each metric, blank unless all seeds are there."""
    seeds = t["results"].select("seed").distinct().count()
    a, b = (t["results"].where(F.col("split") == s).select("seed", "metric", F.col("value").alias(s)) for s in ("supplied", "similarity_aware"))
    deltas = a.join(b, ["seed", "metric"]).withColumn("delta", F.col("similarity_aware") - F.col("supplied"))
    return {"aggregate": evaluation.seed_aggregate(t["results"], ["split", "metric"], "value", seeds), "differences": evaluation.paired_summary(deltas, ["metric"], "delta")}


def crop_reliability(files: DataFrame, predictor: Callable, fit: calibration.Calibrator, protocol: Protocol = Protocol()) -> Tables:
    """From image files to crop risks with an injected detector: plain and transformed views, matching back, two-level
    means, calibration, fusion, and the largest risk of each crop. Crops without predictions keep a NULL risk."""
    seen = cut(detected(files, predictor, stability.VIEWS))
    plain = seen.where("transform_id = 'original' AND class_id IS NOT NULL AND confidence >= " + repr(protocol.inclusion))
    refs = plain.withColumn("prediction_id", F.concat_ws("#", "image", F.col("detection_index").cast("string")))
    refs = cut(refs.select("image", "width", "height", "prediction_id", "class_id", "x1", "y1", "x2", "y2", F.col("confidence").alias("raw_confidence")))
    views = seen.where("transform_id <> 'original'")
    populations.require(populations.view_problems(views, refs, tuple(v["id"] for v in stability.VIEWS), protocol.max_detections, protocol.classes), "views")
    means = stability.two_level_means(stability.match_views(refs.drop("raw_confidence"), views.where("class_id IS NOT NULL")), expected=len(stability.VIEWS))
    scored = refs.join(means, "prediction_id").withColumn("calibrated_confidence", fit.apply(F.col("raw_confidence")))
    scored = scored.withColumnsRenamed({"class_consistency_value": "class_consistency", "localisation_stability_value": "localisation_stability"})
    scored = cut(scored.withColumn("risk", risk.weighted_risk(*map(F.lit, protocol.weights))))
    crops = files.select(F.col("path").alias("image")).join(scored.groupBy("image").agg(F.count(F.lit(1)).alias("predictions"), F.max("risk").alias("crop_risk")), "image", "left")
    return {"predictions": scored, "crops": crops.fillna(0, ["predictions"])}
