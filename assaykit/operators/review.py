"""Selective review: risk-coverage curves, thresholds for review budgets, and what referral achieves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.scalar import ratio
from assaykit.lineage import cut, drop
from assaykit.operators.bootstrap import BATCH, CELLS, PART, SHARE, block_starts, cell_counts, cell_parts, draw_table, numbered_clusters, parts_of, read_part, resampled, weight_blocks, with_cells
from assaykit.operators.ranking import tie_groups
from assaykit.operators.scan import running_totals


def coverage_curve(df: DataFrame, by: list[str], risk: str, label: str, weight: str | None = None) -> DataFrame:
    """``by, threshold, retained, incorrect, coverage, selective_risk``: keeping predictions from the lowest risk up, tie groups whole."""
    g = running_totals(tie_groups(df, by, risk, label, weight), by, "score", ["pos", "neg"])
    kept = F.col("cum_pos") + F.col("cum_neg")
    total = F.col("all_pos") + F.col("all_neg")
    return g.select(
        *by, F.col("score").alias("threshold"), (F.col("pos") + F.col("neg")).alias("added"), kept.alias("retained"), F.col("cum_pos").alias("incorrect"),
        ratio(kept, total).alias("coverage"), ratio(F.col("cum_pos"), kept).alias("selective_risk"), total.alias("total"),
    )


def aurc(curve: DataFrame, by: list[str]) -> DataFrame:
    """Area under the curve as right-end steps; a group without predictions has none."""
    return curve.groupBy(*by).agg(F.sum(ratio(F.col("added"), F.col("total")) * F.col("selective_risk")).alias("aurc"))


def crop_risks(images: DataFrame, scores: DataFrame, by: list[str], risk: str, label: str) -> DataFrame:
    """A row per image and group: ``image, by, predictions, errors, crop_risk``; empty images keep a NULL risk.

    ``by`` values come from the scores; images without predictions meet each of these few (more than 1,000 are an error).
    A plan estimates long scores at the size of their predictions, so it is never left to that estimate whether their sums
    are broadcast.
    """
    values = scores.select(*by).distinct().limit(1_001).collect()
    if len(values) > 1_000:
        raise ValueError("more than 1,000 groups of scores")
    groups = scores.sparkSession.createDataFrame(values, scores.select(*by).schema)
    agg = scores.groupBy("image", *by).agg(F.count(F.lit(1)).alias("predictions"), F.sum(label).alias("errors"), F.max(risk).alias("crop_risk"))
    return images.select("image").join(F.broadcast(groups)).join(agg.hint("merge"), ["image", *by], "left").fillna(0, ["predictions", "errors"])


def crop_risks_of_columns(images: DataFrame, rows: DataFrame, risks: dict[str, Column], label: str) -> DataFrame:
    """As ``crop_risks`` by ``method``, for risks of the same rows: an image meets its sums once, and methods part afterwards."""
    names = {} if rows.isEmpty() else risks  # methods come from the rows
    agg = rows.groupBy("image").agg(F.count(F.lit(1)).alias("predictions"), F.sum(label).alias("errors"), *(F.max(v).alias(f"_{k}") for k, v in names.items()))
    d = images.select("image").join(agg.hint("merge"), "image", "left").fillna(0, ["predictions", "errors"])
    if not names:
        return d.select("image", F.lit("").alias("method"), "predictions", "errors", F.lit(None).cast("double").alias("crop_risk")).where("false")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("method"), F.col(f"_{k}").alias("crop_risk")) for k in names)))
    return d.select("image", each.alias("p"), "predictions", "errors").select("image", "p.method", "predictions", "errors", "p.crop_risk")


def review_thresholds(crops: DataFrame, by: list[str], budgets: tuple[int, ...]) -> DataFrame:
    """``by, budget_percent, nominal_crops, threshold``: the highest crop risk that a budget leaves out.

    With ``k = floor(n * budget / 100)`` of all ``n`` crops, the threshold is the ``k``-th (from 0) of the finite risks from the top,
    or -1 if there are no more than ``k``. Referral is strictly above it, so ties at the threshold stay out.
    """
    sizes = crops.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("crop_risk").alias("finite"))
    wanted = sizes.withColumn("budget_percent", F.explode(F.array(*map(F.lit, budgets)))).withColumn("nominal_crops", F.floor(F.col("n") * F.col("budget_percent") / 100))
    ties = running_totals(crops.where("crop_risk IS NOT NULL").groupBy(*by, "crop_risk").agg(F.count(F.lit(1)).alias("k")), by, "crop_risk", ["k"])
    # Crops above a risk: the rest of the running count.
    ties = ties.select(*by, "crop_risk", (F.col("all_k") - F.col("cum_k")).alias("above"), (F.col("all_k") - F.col("cum_k") + F.col("k")).alias("reach"))
    at = ties.join(F.broadcast(wanted), by).where((F.col("above") <= F.col("nominal_crops")) & (F.col("nominal_crops") < F.col("reach")))
    return wanted.select(*by, "budget_percent", "nominal_crops").join(at.select(*by, "budget_percent", F.col("crop_risk").alias("threshold")), [*by, "budget_percent"], "left").fillna(-1.0, ["threshold"])


#: What is summed over crops, with their multiplicity, for referral metrics: name and whether only referred crops count.
_SUMS = {
    "crops": ("1", False), "nonempty_crops": ("has", False), "predictions": ("predictions", False), "errors": ("errors", False),
    "referred_crops": ("1", True), "referred_predictions": ("predictions", True), "captured_errors": ("errors", True),
}


def _referral_sums(crops: DataFrame, thresholds: DataFrame, by: list[str], keys: list[str], draws: DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``keys`` and a column for each of ``_SUMS``; with draws, crops count as often as their image was drawn.

    Budgets differ only in what they refer. Crops are summed by the highest threshold below their risk, so a drawn crop
    counts once, and budgets meet the few sums.
    """
    limits = thresholds.groupBy(*by).agg(F.collect_list("threshold").alias("_limits"))
    below = F.array_max(F.filter("_limits", lambda t: F.col("crop_risk") > t))
    d = crops.join(F.broadcast(limits), by).select("image", *by, "predictions", "errors", F.when(F.col("predictions") > 0, below).alias("_reach"))
    w = F.lit(1)
    if draws is not None:
        d, w = resampled(d, draws), F.col("multiplicity")
    own = [k for k in keys if k not in thresholds.columns or k in by]
    parts = {"1": F.lit(1), "has": (F.col("predictions") > 0).cast("int"), "predictions": F.col("predictions"), "errors": F.col("errors")}
    d = d.groupBy(*own, "_reach").agg(*(F.sum(w * v.cast("double")).alias(f"_{k}") for k, v in parts.items()))
    sent = F.coalesce(F.col("threshold") <= F.col("_reach"), F.lit(False))
    d = d.join(thresholds.select(*by, "budget_percent", "threshold").hint("merge"), by)
    return d.groupBy(*keys).agg(*(F.sum(F.when(sent, F.col(f"_{c}")).otherwise(F.lit(0.0)) if only else F.col(f"_{c}")).alias(name) for name, (c, only) in _SUMS.items()))


def _referral_ratios() -> dict[str, Column]:
    """Metrics of the sums: workloads, capture, error rates with and without referral, and what random referral of as many
    crops that have predictions would do."""
    c = F.col
    kept, missed = c("predictions") - c("referred_predictions"), c("errors") - c("captured_errors")
    share = F.coalesce(ratio(c("referred_crops"), c("nonempty_crops")), F.lit(0.0))
    rate, left = ratio(c("errors"), c("predictions")), ratio(missed, kept)
    return {
        "crop_workload": ratio(c("referred_crops"), c("crops")), "prediction_workload": ratio(c("referred_predictions"), c("predictions")),
        "error_capture": ratio(c("captured_errors"), c("errors")), "review_precision": ratio(c("captured_errors"), c("referred_predictions")),
        "automatic_predictions": kept, "automatic_errors": missed, "no_referral_error_rate": rate, "automatic_error_rate": left, "error_rate_reduction": rate - left,
        "random_capture": F.when(c("errors") > 0, share), "random_errors": share * c("errors"), "random_predictions": share * c("predictions"),
    }


REFERRAL = ("crop_workload", "prediction_workload", "error_capture", "review_precision", "automatic_error_rate", "error_rate_reduction", "random_capture")


def referral_metrics(crops: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    """What sending every crop above its threshold to review achieves; thresholds may stem from another population.

    Undefined ratios are NULL.
    """
    m = _referral_sums(crops, thresholds, by, [*by, "budget_percent", "threshold"])
    return m.select("*", *(v.alias(k) for k, v in _referral_ratios().items()))


def referral_resampled(crops: DataFrame, thresholds: DataFrame, by: list[str], draws: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``replicate, by, budget_percent`` and referral metrics of resampled crops; thresholds stay as they are."""
    m = _referral_sums(crops, thresholds, by, ["replicate", *by, "budget_percent"], draws)
    return m.select("replicate", *by, "budget_percent", *(v.alias(k) for k, v in _referral_ratios().items()))


def referral_bootstrap(crops: DataFrame, thresholds: DataFrame, method: str, images: DataFrame, replicates: int, seed: int, most_rows: int | None = None, cells: int = CELLS) -> DataFrame:
    """``replicate, <method>, budget_percent`` and referral metrics on the generator's draws of images.

    Images whose crops have the same predictions, errors and thresholds below their risk, method by method, make up a cell; a
    kernel counts the drawn images of each cell, and sums come from these counts. With more than ``cells`` cells, more than
    one crop of an image and method, or numbers that are no counts, crops are written by method and image, and blocks of draws
    are multiplied with the files. Either way files are read one after another, so neither the driver nor a task holds all
    crops. Beyond ``most_rows`` crop rows, if given, draws are
    joined with crops instead.
    """
    spark = crops.sparkSession
    if most_rows is not None and crops.count() > most_rows:
        return referral_resampled(crops, thresholds, [method], draw_table(images, replicates, seed))
    names, n = numbered_clusters(images, "image")
    limits: dict = {}  # a few budgets of each method
    for r in thresholds.select(method, "budget_percent", "threshold").collect():
        limits.setdefault(r[0], []).append((int(r[1]), float("nan") if r[2] is None else float(r[2])))
    kinds = sorted(limits, key=str)
    kind = crops.schema[method].dataType.simpleString()
    celled = _image_cells(crops, method, limits, kinds, names, cells)
    if celled:
        parts = cell_parts(celled[0])
        drop(names)
        m = _sums_of_cells(spark, parts, celled[1], method, kind, limits, kinds, n, replicates, seed)
        return m.select("replicate", method, "budget_percent", *(v.alias(k) for k, v in _referral_ratios().items()))
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col(method)) if kinds else F.lit(None).cast("long")
    own = crops.join(names.hint("merge"), "image").select((place - 1).cast("int").alias("m"), "at", *(F.col(c).cast("double").alias(c) for c in ("predictions", "errors", "crop_risk"))).where("m >= 0")
    own = cut(own)
    files = max(1, -(-own.count() // PART))
    dealt = cut(own.repartitionByRange(files, "m", "at").sortWithinPartitions("m", "at"))
    parts = parts_of(dealt)
    drop(own, names)
    starts = block_starts(spark, n, replicates, seed)

    def kernel(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (b for ids in blocks for b in ids["id"].tolist()):
            for first, w in weight_blocks(n, seed, starts[b], min(BATCH, replicates - b * BATCH)):
                yield from summed(b * BATCH + first, w)

    def summed(first: int, w: np.ndarray) -> Iterator[pd.DataFrame]:
        out: dict = {}
        for path in parts:
            t = read_part(path, ["m", "at", "predictions", "errors", "crop_risk"])
            ends = [0, *(np.flatnonzero(np.diff(t["m"])) + 1).tolist(), len(t["m"])]
            # Rows of one method, few enough for their weights as doubles.
            for lo, hi in ((i, min(i + 16_384, b)) for a, b in zip(ends[:-1], ends[1:]) for i in range(a, b, 16_384)):
                k, at, p, e, risk = int(t["m"][lo]), t["at"][lo:hi], t["predictions"][lo:hi], t["errors"][lo:hi], t["crop_risk"][lo:hi]
                here = [np.ones(len(at)), p > 0, p, e]
                for _, limit in limits[kinds[k]]:
                    sent = (p > 0) & (risk > limit)
                    here += [sent, p * sent, e * sent]
                out[k] = out.get(k, 0) + w[:, at].astype(float) @ np.stack(here, axis=1).astype(float)
        for k, sums in out.items():
            for j, (budget, _) in enumerate(limits[kinds[k]]):
                columns = np.concatenate([sums[:, :4], sums[:, 4 + 3 * j : 7 + 3 * j]], axis=1)
                yield pd.DataFrame(columns, columns=list(_SUMS)).assign(**{"replicate": first + np.arange(len(w)), method: kinds[k], "budget_percent": budget})

    blocks = spark.range(0, len(starts), 1, min(64, len(starts)))
    m = blocks.mapInPandas(kernel, ", ".join(f"{k} double" for k in _SUMS) + f", replicate long, {method} {kind}, budget_percent int")
    return m.select("replicate", method, "budget_percent", *(v.alias(k) for k, v in _referral_ratios().items()))


#: Parts of a crop's code: predictions, errors (24 bits each) and how many different thresholds lie below its risk.
_LIMITS = 15


def _image_cells(crops: DataFrame, method: str, limits: dict, kinds: list, names: DataFrame, most: int) -> tuple[DataFrame, list] | None:
    """``cell, at`` of images and the codes of each cell's crops by method; None where crops have no such codes."""
    steps = {k: sorted({t for _, t in limits[k] if t == t}) for k in kinds}
    if not kinds or len(kinds) > 64 or None in kinds or max(map(len, steps.values())) > _LIMITS:
        return None
    p, e, r = F.col("predictions"), F.col("errors"), F.nanvl(F.col("crop_risk").cast("double"), F.lit(None))
    counted = lambda c: F.coalesce((c >= 0) & (c < 2**24) & (c == F.floor(c)), F.lit(False))

    def code(k):
        level = sum((F.coalesce((r > t) & (p > 0), F.lit(False)).cast("long") for t in steps[k]), F.lit(0).cast("long"))
        return F.shiftleft(p.cast("long"), 28) + F.shiftleft(e.cast("long"), 4) + level

    own = crops.where(F.col(method).isin(kinds))
    codes = own.groupBy("image").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(~(counted(p) & counted(e))).alias("_odd"),
        *(F.max(F.when(F.col(method) == k, code(k))).alias(f"c{i}") for i, k in enumerate(kinds)),
    )
    known = sum((F.col(f"c{i}").isNotNull().cast("long") for i in range(len(kinds))), F.lit(0))
    images = cut(codes.join(names.hint("merge"), "image").select("at", ((F.col("_odd") > 0) | (F.col("_n") != known)).alias("odd"), *(f"c{i}" for i in range(len(kinds)))))
    found = None if not images.where("odd").isEmpty() else with_cells(images, [f"c{i}" for i in range(len(kinds))], most)
    if found is None or not found[1]:
        drop(images)
        return None
    return found


def _sums_of_cells(spark, parts: list[str], cells: list, method: str, kind: str, limits: dict, kinds: list, n: int, replicates: int, seed: int) -> DataFrame:
    """What ``_SUMS`` names by ``replicate, <method>, budget_percent``, from counts of cells."""
    codes = np.array([[-1 if c is None else c for c in r] for r in cells], np.int64)
    starts = block_starts(spark, n, replicates, seed, batch=SHARE)
    held: dict = {}  # by task

    def features() -> np.ndarray:
        """A row per cell: for every method and budget the seven numbers."""
        out = []
        for i, k in enumerate(kinds):
            c = codes[:, i]
            there, level = c >= 0, c & 15
            p, e = (np.where(there, x, 0) for x in (c >> 28, (c >> 4) & (2**24 - 1)))
            steps = sorted({t for _, t in limits[k] if t == t})
            for _, limit in limits[k]:
                sent = there & (level > steps.index(limit)) if limit == limit else np.zeros(len(c), bool)
                out += [there, there & (p > 0), p, e, sent, p * sent, e * sent]
        return np.stack(out, axis=1).astype(float)

    def kernel(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (b for ids in blocks for b in ids["id"].tolist()):
            if not held:
                held["x"] = features()
            for first, counts in cell_counts(parts, len(codes), n, seed, starts[b], min(SHARE, replicates - b * SHARE)):
                sums = counts.astype(float) @ held["x"]
                for j, (k, budget) in enumerate((k, budget) for k in kinds for budget, _ in limits[k]):
                    if (codes[:, kinds.index(k)] < 0).all():
                        continue  # a method without crops has no sums
                    yield pd.DataFrame(sums[:, 7 * j : 7 * j + 7], columns=list(_SUMS)).assign(**{"replicate": b * SHARE + first + np.arange(len(sums)), method: k, "budget_percent": budget})

    return spark.range(0, len(starts), 1, len(starts)).mapInPandas(kernel, ", ".join(f"{k} double" for k in _SUMS) + f", replicate long, {method} {kind}, budget_percent int")
