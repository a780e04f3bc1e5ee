"""Suffix-array dedup: removing long byte strings that occur more than once.

Positions are first dealt to *anchors*: in every ``length``-byte string the gram with the smallest hash (rightmost, if
several) is its anchor, so equal strings have equal anchors at equal offsets, and there is one anchor for about every
``length / 2`` bytes. An anchor's context is all that strings through it can cover. Equal contexts repeat as a whole.
Contexts that share an anchor gram but differ are sorted as suffixes, to the right of the anchor and to the left: a
mergesort whose comparisons find by prefix polynomial hashes and binary search how far two of them agree. Neighbours in
the finished order are verified on the bytes, their order and their agreement; where a hash misled, bytes sort instead.
Smallest agreements between places in both orders tell how far each context repeats.

A group of more contexts than a task should hold is not sorted: its strings meet their equals by digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.lineage import cut, drop
from assaykit.llm.common import among, runs_of, small_batches, trimmed
from assaykit.llm.wordhash import mix, string_buffer

_U = np.uint64
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of an anchor gram. Positions in a piece of text fit 20 bits.
GRAM, PIECE = 64, (1 << 20) - 4096
#: Contexts of one group that are sorted in one task at most (a few MB), and contexts of small groups that are sorted in one go.
LOCAL, BATCH = 4_096, 1_500
_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, PIECE + 8192), base, dtype=_U)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=_U)
    return _powers[base]


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """``p`` with ``(p[b] - p[a]) * base**-a`` the polynomial hash of ``raw[a:b]``, modulo 2**64."""
    out = np.zeros(len(raw) + 1, _U)
    np.cumsum(_VALUE[raw] * _power(_BASE, len(raw) + 1)[: len(raw)], out=out[1:])
    return out


def _hash(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (p[b] - p[a]) * _power(_INVERSE, len(p) + 1)[a]


def _anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``text, position, gram hash`` of all anchors, piece by piece; texts never run together.

    Anchors never step back from one window to the next, so the last one of a piece is all that the next can repeat.
    """
    span = length - GRAM + 1
    end, last = len(raw), -1
    for a in range(0, end, PIECE):
        lo, hi = a, min(end, a + PIECE + length)
        part = raw[lo:hi]
        n = len(part)
        if n < length:
            continue
        p = prefix_hashes(part)
        at = np.arange(n - GRAM + 1)
        gram = mix(_hash(p, at, at + GRAM))
        key = (gram & _U(~0xFFFFF & (2**64 - 1))) | (_U(0xFFFFF) - at.astype(_U))
        # Sliding minimum: of the rest of this block and the beginning of the next.
        full = -(-len(key) // span) * span
        padded = np.full(full, _U(2**64 - 1))
        padded[: len(key)] = key
        blocks = padded.reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = np.arange(min(a + PIECE, end) - lo)
        starts = starts[starts + length <= n]
        text = np.searchsorted(offsets, starts + lo, side="right") - 1
        starts = starts[starts + lo + length <= offsets[text + 1]]
        if not len(starts):
            continue
        least = np.minimum(back[starts], ahead[starts + span - 1])
        pos = np.unique(0xFFFFF - (least & _U(0xFFFFF)).astype(np.int64))
        pos = pos[pos + lo > last]
        if not len(pos):
            continue
        last = int(pos[-1]) + lo
        text = np.searchsorted(offsets, pos + lo, side="right") - 1
        yield text, pos + lo - offsets[text], gram[pos]


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """``h, c, d, t, n, pos``: gram hash and context digest of every anchor of every text (named by hash and size)."""
    span = length - GRAM

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw, offsets = string_buffer(batch.column(2))
            view = memoryview(raw)
            for text, pos, h in _anchors(raw, offsets, length):
                at = pos + offsets[text]
                bounds = zip(np.maximum(offsets[text], at - span).tolist(), np.minimum(offsets[text + 1], at + length).tolist())
                digest = np.frombuffer(b"".join(blake2b(view[a:b], digest_size=16).digest() for a, b in bounds), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(t[text]), pa.array(n[text].astype(np.int32)), pa.array(pos.astype(np.int32))], ["h", "c", "d", "t", "n", "pos"])

    return docs.where(F.col("n") >= length).select("t", "n", "text").mapInArrow(trimmed(kernel), "h long, c long, d long, t long, n int, pos int")


class _Side:
    """Strings that run away from their anchors, end to end, with prefix hashes for comparison."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(strings) + b"\0", np.uint8)
        self.hashes = prefix_hashes(self.raw)
        self.down = _power(_INVERSE, len(self.hashes) + 1)

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the strings of each pair agree, by hash and binary search."""
        a, b, p, down = self.start[i], self.start[j], self.hashes, self.down
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        pa_, pb, da, db = p[a], p[b], down[a], down[b]
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = (p[a + mid] - pa_) * da == (p[b + mid] - pb) * db
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def order(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Negative where string ``i`` comes before string ``j``; an end comes before every byte."""
        n = self.agree(i, j)
        after = lambda k: np.where(n < self.size[k], self.raw[self.start[k] + np.minimum(n, np.maximum(self.size[k] - 1, 0))].astype(np.int64), -1)
        return after(i) - after(j)

    def common(self, i: int, j: int, n: int) -> int:
        """How far two strings agree, verified on the bytes; ``n`` is what their hashes say."""
        x, y = self.strings[i], self.strings[j]
        return n if x[:n] == y[:n] else next(k for k, (u, v) in enumerate(zip(x, y)) if u != v)


def suffix_sort(side: _Side, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings of each group, and how far each in that order agrees with the next one.

    Group ``k`` is the strings ``first[k]`` to ``first[k + 1]``; all groups are mergesorted at once. Every place in the
    merged run is found by binary search in the other run.
    """
    m = int(first[-1])
    at = np.arange(m)
    begin, end = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
    order, width = at.copy(), 1
    while width < (end - begin).max(initial=0):
        run = (at - begin) // width
        other = begin + (run ^ 1) * width
        lo, hi = other.copy(), np.maximum(other, np.minimum(other + width, end))
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            c = side.order(order[mid], order[live])
            before = np.where(run[live] % 2 == 0, c < 0, c <= 0)  # equal ones keep their order
            lo[live] = np.where(before, mid + 1, lo[live])
            hi[live] = np.where(before, hi[live], mid)
            live = live[lo[live] < hi[live]]
        merged = np.empty_like(order)
        merged[begin + np.minimum(run, run ^ 1) * width + (at - begin - run * width) + lo - other] = order
        order, width = merged, 2 * width
    near = _neighbours(side, order, first)
    if near is None:  # a collision of hashes: bytes decide
        order = np.concatenate([sorted(range(a, b), key=side.strings.__getitem__) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]).astype(np.int64)
        near = _neighbours(side, order, first)
    return order, near


def _neighbours(side: _Side, order: np.ndarray, first: np.ndarray) -> np.ndarray | None:
    """Verified agreement of each string with the next in its group; none, if the order does not hold on the bytes."""
    out = np.zeros(len(order), np.int64)
    inner = np.ones(len(order), bool)
    inner[first[1:] - 1] = False
    k = np.flatnonzero(inner)
    said = side.agree(order[k], order[k + 1])
    for q, i, j, n in zip(k.tolist(), order[k].tolist(), order[k + 1].tolist(), said.tolist()):
        n = side.common(i, j, n)
        if side.strings[i][n : n + 1] > side.strings[j][n : n + 1]:
            return None
        out[q] = n
    return out


def _between(place: np.ndarray, near: np.ndarray) -> np.ndarray:
    """``[i, b]``: the smallest of ``near`` between places ``place[i]`` and ``b``; at its own place 0."""
    m, most = len(near) + 1, np.int64(1) << 40
    k = np.arange(m - 1)[None, :]
    up = np.minimum.accumulate(np.where(k >= place[:, None], near[None, :], most), axis=1)
    down = np.minimum.accumulate(np.where(k < place[:, None], near[None, :], most)[:, ::-1], axis=1)[:, ::-1]
    out = np.zeros((len(place), m), np.int64)
    out[:, 1:] = np.where(k >= place[:, None], up, 0)
    out[:, :-1] += np.where(k < place[:, None], down, 0)
    return out


def extents(lefts: list[bytes], rights: list[bytes], first: np.ndarray, alone: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far each context repeats to the left and right of its anchor, within its group; 0, 0 where it does not.

    All strings of a context that repeat cover the anchor, so they make up one run: the farthest agreements, to either
    side, with contexts that agree over ``length`` bytes in all. Only contexts ``alone`` are asked about.
    """
    (by_left, near_left), (by_right, near_right) = (suffix_sort(_Side(s), first) for s in (lefts, rights))
    m = len(lefts)
    out = np.zeros((2, m), np.int64)
    # Groups of two, the most frequent ones, all at once.
    two = first[:-1][np.diff(first) == 2]
    ok = two[near_left[two] + near_right[two] >= length]
    for k in (0, 1):
        out[0, ok + k], out[1, ok + k] = near_left[ok], near_right[ok]
    place = np.empty((2, m), np.int64)
    place[0, by_left], place[1, by_right] = np.arange(m), np.arange(m)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a < 3:
            continue
        asked = np.flatnonzero(alone[a:b]) + a
        for part in (asked[i : i + 128] for i in range(0, len(asked), 128)):
            left, right = np.empty((2, len(part), b - a), np.int64)
            left[:, by_left[a:b] - a] = _between(place[0, part] - a, near_left[a : b - 1])
            right[:, by_right[a:b] - a] = _between(place[1, part] - a, near_right[a : b - 1])
            long_ = left + right >= length
            out[0, part], out[1, part] = (left * long_).max(axis=1), (right * long_).max(axis=1)
    out[:, ~alone] = 0
    return out[0], out[1]


def _solve(length: int):
    """Over rows sorted by group: the repeated extents around each context that stands alone."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            rows = pa.concat_batches(held)
            first = np.cumsum([0, *(h.num_rows for h in held)])
            t, n, pos = (rows.column(i).to_numpy() for i in (1, 2, 3))
            left, right = extents(rows.column(5).to_pylist(), rows.column(6).to_pylist(), first, rows.column(4).to_numpy(zero_copy_only=False), length)
            k = np.flatnonzero(left + right)
            return pa.RecordBatch.from_arrays([pa.array(t[k]), pa.array(n[k]), pa.array(pos[k] - left[k]), pa.array(pos[k] + right[k])], ["t", "n", "a", "b"])

        for group in runs_of(batches, 1):
            if group.num_rows > 1:
                held.append(group)
            if sum(h.num_rows for h in held) > BATCH:
                yield flush()
                held = []
        if held:
            yield flush()

    return kernel


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``g, t, n, pos, alone, left, right``: the bytes that run away from each wanted anchor to the left and right."""
    span = length - GRAM

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                rows: list[tuple] = []
                for t, n, text, at in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns)):
                    raw = text.encode()
                    rows += ((x["h"], t, n, x["pos"], x["alone"], raw[max(0, x["pos"] - span) : x["pos"]][::-1], raw[x["pos"] : x["pos"] + length]) for x in at)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["g", "t", "n", "pos", "alone", "left", "right"])

    wanted = wanted.groupBy("t", "n").agg(F.collect_list(F.struct("h", "pos", "alone")).alias("at"))
    texts = among(docs.where(F.col("n") >= length).select("t", "n", "text"), "t", wanted.select("t"))
    # Equal texts need one copy: any of them will do.
    texts = texts.join(wanted, ["t", "n"]).dropDuplicates(["t", "n"]).select("t", "n", "text", "at")
    return texts.mapInArrow(trimmed(kernel), "g long, t long, n int, pos int, alone boolean, left binary, right binary")


def _by_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same extents for groups that no task should hold: each string through an anchor meets its equals by digest.

    Work and rows grow with the members, not with their pairs. The digest, 128 bits of BLAKE2, is of the bytes.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            digests, starts, counts = [], [], []
            for pos, left, right in zip(*(batch.column(i).to_pylist() for i in (3, 5, 6))):
                raw = memoryview(left[::-1] + right)
                s = range(max(0, len(left) + GRAM - length), min(len(left), len(raw) - length) + 1)
                digests += (blake2b(raw[i : i + length], digest_size=16).digest() for i in s)
                starts.append(np.array(s, np.int64) + pos - len(left))
                counts.append(len(s))
            key = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            rows = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            yield pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), *(batch.column(i).take(rows) for i in (1, 2, 3, 4)), pa.array(np.concatenate(starts))], ["x", "y", "t", "n", "pos", "alone", "a"])

    w = cut(contexts.mapInArrow(trimmed(kernel), "x long, y long, t long, n int, pos int, alone boolean, a long"))
    start = F.struct("t", "n", "a")  # a string can hold several anchors, so it may be listed more than once
    # Written first, so that a string that very many share can be dealt out again at the join.
    twice = cut(w.groupBy("x", "y").agg(F.min(start).alias("lo"), F.max(start).alias("hi")).where("lo <> hi").select("x", "y"))
    found = cut(w.where("alone").join(twice, ["x", "y"]).groupBy("t", "n", "pos").agg(F.min("a").alias("a"), (F.max("a") + length).alias("b")).select("t", "n", "a", "b"))
    drop(w, twice)
    return found


def repeated_extents(docs: DataFrame, length: int = 400) -> DataFrame:
    """``t, n, spans``: for every text with repeats, sorted ``(a, b)`` byte runs covered by strings that also start elsewhere.

    ``docs`` has ``t, n, text``: a hash of the text, its size in bytes, and the text.
    """
    spark = docs.sparkSession
    rows = cut(_anchor_rows(docs, length))
    context = F.struct("c", "d")
    grams = cut(rows.groupBy("h").agg(F.count(F.lit(1)).alias("k"), (F.min(context) != F.max(context)).alias("mixed")).where("k > 1").select("h", "mixed"))
    # Equal contexts: all of each is covered, if it holds a whole string.
    # Those of very many copies come down to one row before they travel.
    shared = among(rows, "h", grams.select("h"), 24).groupBy("h", "c", "d").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("t", "n", "pos")).alias("at"))
    shared = cut(shared.join(grams, "h"))
    drop(grams)
    equal = shared.where("k > 1").select("h", "c", "d")
    span = length - GRAM
    lo, hi = F.greatest(F.col("pos") - span, F.lit(0)), F.least(F.col("pos") + length, F.col("n"))
    whole = among(rows, "c", equal.select("c"), 24).join(equal, ["h", "c", "d"]).select("t", "n", lo.cast("long").alias("a"), hi.cast("long").alias("b")).where(F.col("b") - F.col("a") >= length)
    whole = cut(whole.groupBy("t", "n").agg(F.collect_set(F.struct("a", "b")).alias("spans")))
    drop(rows)
    # Different contexts around one gram, where at least one stands alone.
    mixed = shared.where("mixed")
    sizes = mixed.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.min("k").alias("least")).where("least = 1").select("h", "size")
    wanted = cut(mixed.join(sizes, "h").select("h", "at.t", "at.n", "at.pos", (F.col("k") == 1).alias("alone"), "size"))
    drop(shared)
    contexts = _contexts(docs, wanted.where(F.col("size") <= LOCAL).drop("size"), length)
    # A fixed number of tasks: the work follows the rows, not their bytes.
    runs = contexts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "g").sortWithinPartitions("g", "t", "pos").mapInArrow(trimmed(_solve(length)), "t long, n int, a long, b long")
    large = wanted.where(F.col("size") > LOCAL).drop("size")
    if not large.isEmpty():
        runs = runs.union(_by_windows(_contexts(docs, large, length), length))
    each = runs.groupBy("t", "n").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    spans = cut(each.union(whole).groupBy("t", "n").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")))
    del contexts, runs, large, each, mixed, sizes, equal
    drop(whole, wanted)
    return spans


def remove_repeats(docs: DataFrame, length: int = 400, keep: bool = True) -> DataFrame:
    """A row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if wanted, ``kept``.

    Every byte of a ``length``-byte string that also starts anywhere else in the table, the same text included, is
    removed; strings are judged on the input. Null and empty texts have no bytes; texts shorter than ``length`` lose
    nothing; a row that repeats another loses all, if long enough. ``kept`` is the remaining bytes. Columns but
    ``doc_id`` and ``text`` are ignored; an empty table gives none. Long texts are hashed in pieces of a megabyte; a task
    holds a text whole. Texts are told apart by a 64-bit hash and size, equal contexts by 128 bits of BLAKE2; where
    contexts differ, what polynomial hashes say is verified on the bytes.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text")).withColumn("n", F.octet_length("text").cast("int"))
    with small_batches(docs.sparkSession):
        spans = repeated_extents(d.select("t", "n", "text"), length)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            removed, runs, digest, kept = [], [], [], []
            raws = batch.column(1).cast(pa.binary())
            for raw, found in zip(raws.to_pylist(), batch.column(2).to_pylist()):
                at = gone = k = 0
                state, parts = sha256(), []
                for a, b in ((s["a"], s["b"]) for s in found or ()):
                    if a > at or not k:
                        state.update(raw[at:a])
                        parts.append((at, a))
                        k += 1
                        at = a
                    if b > at:
                        gone += b - at
                        at = b
                state.update(raw[at:])
                removed.append(gone)
                runs.append(k)
                digest.append(state.hexdigest())
                if keep:
                    kept.append(b"".join([*(raw[a:b] for a, b in parts), raw[at:]]))
            arrays = [batch.column(0), pa.array(np.diff(string_buffer(raws)[1])), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), *([pa.array(kept, pa.binary())] if keep else [])]
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep else [])]
    # Only texts that may have spans travel; the others are digested where they are.
    some = among(d, "t", spans.select("t")).join(spans, ["t", "n"], "left").select("doc_id", "text", "spans")
    none = among(d, "t", spans.select("t"), others=True).select("doc_id", "text", F.lit(None).cast(some.schema["spans"].dataType).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep
    return some.mapInArrow(kernel, schema).union(none.mapInArrow(kernel, schema))
