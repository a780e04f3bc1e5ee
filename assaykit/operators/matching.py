"""Matching predicted boxes to true ones: greedy by confidence, and optimal by cardinality then overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.geometry import iou_matrix

_MATCH = "image string, class_id int, source_row long, theta double, correct int, status string, gt_id string, matched_iou double, best_unused_iou double, best_same_class_iou double"


_KINDS = (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64())


def _greedy(image: str, cls: int, pred: list[dict], truth: list[dict], thetas: tuple[float, ...]) -> list[tuple]:
    pred = sorted(pred, key=lambda r: (-r["confidence"], r["source_row"]))
    box = lambda rows: np.array([[r["x1"], r["y1"], r["x2"], r["y2"]] for r in rows], float).reshape(-1, 4)
    ious = iou_matrix(box(pred), box(truth)).tolist()
    out = []
    for theta in thetas:
        free = list(range(len(truth)))
        for r, row in zip(pred, ious):
            best = max(row, default=0.0)
            top = max(free, key=lambda j: row[j], default=None)  # noqa: B023
            unused = 0.0 if top is None else row[top]
            hit = top is not None and unused >= theta
            if hit:
                free.remove(top)
            status = "matched" if hit else "duplicate" if best >= theta else "unmatched"
            out.append((image, cls, r["source_row"], theta, int(hit), status, truth[top]["gt_id"] if hit else None, unused if hit else None, unused, best))
    return out


def paired_lists(left: DataFrame, right: DataFrame, keys: list[str], own: list[str], other: list[str]) -> DataFrame:
    """``keys, own, other``: both sides' rows of each key of ``left`` as arrays of structs; ``other`` may be null."""
    a = left.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*own))).alias("own"))
    b = right.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*other))).alias("other"))
    return a.join(b, keys, "left")


def greedy_match(predictions: DataFrame, truth: DataFrame, thetas: tuple[float, ...] = (0.5, 0.75)) -> DataFrame:
    """One row per prediction and threshold.

    Within an image and class, predictions come by confidence (ties by ``source_row``); each takes the free true box with
    the largest overlap (ties: the first ``line``) and is correct if that reaches the threshold. A prediction whose
    best box is taken is a duplicate. Thresholds are judged apart. Images without truth leave all unmatched, with overlaps of 0. The boxes
    of one image and class meet in one row; a task works through Arrow batches of such rows.
    """
    own = ["source_row", "confidence", "x1", "y1", "x2", "y2"]
    d = paired_lists(predictions, truth, ["image", "class_id"], own, ["line", "gt_id", "x1", "y1", "x2", "y2"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for image, cls, p, t in zip(*(c.to_pylist() for c in batch.columns)):
                out += _greedy(image, cls, p, t or [], thetas)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(_KINDS)], [c.split()[0] for c in _MATCH.split(", ")])

    return d.select("image", "class_id", "own", "other").mapInArrow(kernel, _MATCH)


def overlap_pairs(predictions: DataFrame, truth: DataFrame, iou, least: float = 0.0) -> DataFrame:
    """Same-image, same-class pairs with their overlap; predictions without any stay with NULL."""
    pairs = predictions.join(truth, ["image", "class_id"], "left").withColumn("iou", iou)
    return pairs.where(F.col("iou").isNull() | (F.col("iou") >= least))


def assign(iou: np.ndarray, least: float = 0.5) -> dict[int, int]:
    """Row to column: as many pairs with ``iou >= least`` as can be, then the largest total overlap.

    Shortest augmenting paths (with potentials) on costs in which one more pair outweighs any sum of overlaps.
    """
    rows, cols = iou.shape
    if not rows or not cols:
        return {}
    could = iou >= least
    if (could.sum(0) <= 1).all() and (could.sum(1) <= 1).all():  # no two compete
        return dict(zip(*(k.tolist() for k in np.nonzero(could))))
    n = rows + cols
    bonus = min(rows, cols) + 1.0
    cost = np.zeros((rows, n))
    cost[:, :cols] = np.where(iou >= least, -(bonus + iou), 1.0)
    u, v = np.zeros(rows + 1), np.zeros(n + 1)
    owner = np.zeros(n + 1, int)
    for i in range(1, rows + 1):
        owner[0], j0 = i, 0
        low, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            reduced = cost[owner[j0] - 1] - u[owner[j0]] - v[1:]
            better = ~used[1:] & (reduced < low[1:])
            low[1:][better], way[1:][better] = reduced[better], j0
            j1 = 1 + int(np.argmin(np.where(used[1:], np.inf, low[1:])))
            delta = low[j1]
            u[owner[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if not owner[j0]:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    return {int(owner[j]) - 1: j - 1 for j in range(1, cols + 1) if owner[j] and iou[owner[j] - 1, j - 1] >= least}
