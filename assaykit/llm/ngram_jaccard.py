"""N-gram Jaccard join by set-relation skipping.

Index lists (shingle -> sets whose prefix holds it) carry each set's position in a global rare-first order. Two
relations spare work. *Index skipping*: a list is grouped into blocks of equal size class and position, and a block
pair is skipped as a whole when its best size and position already exclude the threshold. *Answer skipping*: in each
list the set with the smallest position answers first; a set that links to it takes over its component, so only sets
that are still in different components are looked up further. Identical sets share one answer at once.

Every link lies within a component. There, a set's answers are derived from those of a highly similar one: with ``A`` the
lead of a block of a component, ``|B & C| = |A & C| - |(A - B) & C| + |(B - A) & C|``, so only what sets lack of the lead
or add to it is compared. The links are counted where they are found and not sent as rows of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.lineage import cut, drop
from assaykit.llm.common import among, runs_of, small_batches, trimmed
from assaykit.llm.wordhash import shingle_sets
from assaykit.operators.graph import connected_components

#: Counters of the shingle-frequency sketch. It only orders shingles; its size is fixed, 4 MB as int32.
SKETCH_BITS = 20
_CHUNK = 1 << 12
#: Bits of a set's parity map: each shingle flips one of them, so two sets differ in at least as many shingles as bits.
MAP_BITS = 1 << 10
#: Bits of the filter that keeps index entries without a partner from travelling twice: 262,144 rows at most.
ENTRY_FILTER_BITS = 24
#: A component is dealt in blocks of about so many sets and so many shingles, two of which meet in a task; pairs with one
#: lead in parts of about so many.
BLOCK_SETS, BLOCK_SHINGLES = 1 << 10, 1 << 20


def _frequency_sketch(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    """How many texts hold a shingle of each hash bucket, over all texts; ``2**bits`` counters in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int64)
        waiting, held = [], 0
        for batch in batches:
            for s in shingle_sets(batch.column(0), n):
                waiting.append(s & np.uint64((1 << bits) - 1))
                held += len(s)
                if held > 1 << 20:
                    total += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=1 << bits)
                    waiting, held = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=1 << bits)
        parts = [(i, c) for i in range(0, 1 << bits, _CHUNK) if (c := total[i : i + _CHUNK]).any()]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([i for i, _ in parts], pa.int32()), "counts": pa.array([np.minimum(c, 2**31 - 1).astype("<i4").tobytes() for _, c in parts], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(c, "<i4").astype(np.int64)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "counts": pa.array([np.minimum(c, 2**31 - 1).astype("<i4").tobytes() for c in sums.values()], pa.binary())})

    schema = "chunk int, counts binary"
    sketch = np.zeros(1 << bits, dtype=np.int32)
    for row in docs.select("text").mapInArrow(trimmed(count), schema).repartition("chunk").mapInArrow(add, schema).collect():
        sketch[row["chunk"] : row["chunk"] + _CHUNK] = np.frombuffer(row["counts"], "<i4")
    return sketch


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    both = np.array([s.sum(dtype=np.uint64), ((s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ s).sum(dtype=np.uint64)], np.uint64).view(np.int64)
    return int(both[0]), int(both[1])


def _prefixes(docs: DataFrame, n: int, bits: int, sketch: np.ndarray, t: Fraction) -> DataFrame:
    """``doc_id, n, s1, s2, map, prefix``: set size, a 128-bit signature, parity map, and rarest shingles in global order."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, words = shared.value, MAP_BITS // 64
        for batch in batches:
            sizes, signs, maps, prefixes = [], [], [], []
            for s in shingle_sets(batch.column(1), n):
                k = len(s)
                sizes.append(k)
                signs.append(_signature(s))
                maps.append(np.packbits(np.bincount((s >> np.uint64(40)).astype(np.int64) % MAP_BITS, minlength=MAP_BITS) & 1 == 1))
                keep = k - -(-t.numerator * k // t.denominator) + 1 if k else 0
                key = (frequency[(s & np.uint64((1 << bits) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (s >> np.uint64(32))
                if keep < k // 2:
                    near = np.flatnonzero(key <= np.partition(key, keep)[keep])
                    order = near[np.argsort(key[near], kind="stable")][:keep]
                else:
                    order = np.argsort(key, kind="stable")[:keep]
                prefixes.append(s[order])
            ends = np.cumsum([0, *map(len, prefixes)])
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(sizes, np.int64)), *(pa.array([x[i] for x in signs], pa.int64()) for i in (0, 1)), pa.ListArray.from_arrays(pa.array(np.arange(0, len(maps) * words + 1, words), pa.int32()), pa.array(np.concatenate(maps).view(np.int64) if maps else np.zeros(0, np.int64))), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_signed(flat)))],
                ["doc_id", "n", "s1", "s2", "map", "prefix"],
            )

    return docs.select("doc_id", "text").mapInArrow(trimmed(kernel), "doc_id long, n long, s1 long, s2 long, map array<long>, prefix array<long>")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, texts``: the different texts of the rows with these ids; rows that repeat both count once, before they travel."""
    return among(docs.where("doc_id IS NOT NULL"), "doc_id", ids).groupBy("doc_id").agg(F.collect_set("text").alias("texts"))


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, t: Fraction) -> DataFrame:
    """The pairs ``a, b`` whose whole shingle sets reach the threshold.

    Parity maps first rule out pairs that differ in too many shingles. For the rest texts travel, not expanded sets: each
    ``b`` once for each pair, and ``a`` once for every few hundred pairs that it leads.
    """
    num, den = t.numerator, t.denominator

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, heads = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            keys = zip(*(batch.column(i).to_pylist() for i in range(4)))
            for (a, salt, second, b), s in zip(keys, shingle_sets(batch.column(4), n)):
                if lead != (a, salt):
                    lead, heads = (a, salt), []
                if not second:  # an id that is repeated can have several texts
                    heads.append(s)
                    continue
                for h in heads:
                    both = len(np.intersect1d(h, s, assume_unique=True))
                    if both and den * both >= num * (len(h) + len(s) - both):
                        found.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    pairs = cut(pairs)
    maps = reps.select("rep", "n", "map")
    maps = cut(among(maps, "rep", pairs.select("a").union(pairs.select("b"))))
    side = lambda s: maps.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("map").alias(f"map_{s}"))
    apart = F.expr("aggregate(zip_with(map_a, map_b, (x, y) -> bit_count(x ^ y)), 0L, (s, x) -> s + x)")
    near = pairs.join(side("b"), "b").join(side("a"), "a").where(apart * (den + num) <= (F.col("n_a") + F.col("n_b")) * (den - num))
    near = cut(near.select("a", "b").distinct())
    # The side with more pairs leads, so that no text travels once for each of very many leads.
    degree = near.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("pairs"))
    count = lambda c: degree.select(F.col("node").alias(c), F.col("pairs").alias(f"pairs_{c}"))
    turned = near.join(count("a"), "a").join(count("b"), "b")
    turn = F.col("pairs_a") < F.col("pairs_b")
    oriented = cut(turned.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b")))
    drop(near)
    near = oriented
    leads = near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("salts"))
    heads = leads.select("a", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.lit(0).alias("second"), F.col("a").alias("b"))
    rows = near.join(leads, "a").select("a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.lit(1).alias("second"), "b").union(heads)
    rows = rows.join(_texts(docs, rows.select("b")), F.col("b") == F.col("doc_id")).select("a", "salt", "second", "b", F.explode("texts").alias("text"))
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "second")
    found = cut(rows.mapInArrow(trimmed(kernel), "a long, b long").distinct())
    drop(pairs, maps, near)
    return found


def _bound(n_a: Column, i: Column, n_b: Column, j: Column, t: Fraction) -> Column:
    """Whether sets of these sizes that first meet at these positions can still reach the threshold."""
    p, q = t.numerator, t.denominator
    need = p * (n_a + n_b)
    return ((p + q) * (n_a - i) >= need) & ((p + q) * (n_b - j) >= need)


def _shared(row: np.ndarray, token: np.ndarray, m: int) -> np.ndarray:
    """How many tokens each two of ``m`` rows have in common: long token lists by matrix products, short ones pair by pair."""
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    start = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(token)))
    out = np.zeros((m, m))
    long_ = np.flatnonzero(size > 32)
    for part in (long_[at : at + 2_048] for at in range(0, len(long_), 2_048)):
        held = np.zeros((m, len(part)), np.float32)
        entry = np.repeat(start[part] - np.cumsum(size[part]) + size[part], size[part]) + np.arange(size[part].sum())
        held[row[entry], np.repeat(np.arange(len(part)), size[part])] = 1
        out += held @ held.T
    short = np.flatnonzero((size > 1) & (size <= 32))
    chunk = np.cumsum(size[short] ** 2) >> 22
    for part in (short[chunk == c] for c in np.unique(chunk)):
        # Every entry of a list meets every entry of it.
        k, p = np.repeat(part, size[part] ** 2), np.repeat(size[part], size[part] ** 2)
        place = np.arange(len(k)) - np.repeat(np.cumsum(size[part] ** 2) - size[part] ** 2, size[part] ** 2)
        out += np.bincount(row[start[k] + place // p] * m + row[start[k] + place % p], minlength=m * m).reshape(m, m)
    return out


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """``[i, j]``: common elements of any two different sets, derived from what they share with the smallest set, the lead."""
    m, size = len(sets), np.array([len(s) for s in sets], np.int64)
    tokens, ids = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), size)
    lead = int(size.argmin())
    place = np.full(len(tokens), -1)
    place[ids[row == lead]] = np.arange(size[lead])
    added = place[ids] < 0
    lacks = np.ones((m, size[lead]), bool)
    lacks[row[~added], place[ids[~added]]] = False
    missing = lacks.sum(1)
    both = size[lead] - missing[:, None] - missing[None, :] + _shared(*np.nonzero(lacks), m)
    return (both + _shared(row[added], ids[added], m)).astype(np.int64)


def _decided(members: DataFrame, docs: DataFrame, n: int, t: Fraction, pairs: bool) -> DataFrame:
    """All links within components, of ``members (s1, s2, n, rep, copies, component)``.

    With ``pairs``, the linked pairs ``a, b`` by id; else ``s1, s2, n, near``: how many rows the links of each set lead to.
    """
    num, den = t.numerator, t.denominator
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("shingles"), F.sum("copies").alias("all"))
    m = members.join(sizes, "component")
    # Two sets in a component are linked; nothing needs to be compared.
    if pairs:
        two = m.where("k = 2").groupBy("component").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).select("a", "b")
    else:
        two = m.where("k = 2").select("s1", "s2", "n", (F.col("all") - F.col("copies")).alias("near"))
    blocks = F.greatest(F.ceil(F.col("k") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    m = cut(m.where("k > 2").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("s1", "s2"), "blocks").cast("int")))
    units = m.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "s1", "s2", "n", "rep", "copies")
    units = units.join(_texts(docs, m.select("rep")), F.col("rep") == F.col("doc_id")).select("component", "lo", "hi", "block", "s1", "s2", "rep", "copies", F.explode("texts").alias("text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        for unit in runs_of(batches, 3):
            lo, hi = unit.column(1)[0].as_py(), unit.column(2)[0].as_py()
            block, s1, s2, rep, copies = (unit.column(i).to_numpy() for i in (3, 4, 5, 6, 7))
            sets = list(shingle_sets(unit.column(8), n))
            signs = np.array([_signature(s) for s in sets], np.int64).reshape(-1, 2)
            # A row whose id is repeated may hold another text than the set's; equal sets come once.
            own = np.flatnonzero((signs[:, 0] == s1) & (signs[:, 1] == s2))
            own = own[np.unique(signs[own], axis=0, return_index=True)[1]]
            sets, block, s1, s2, rep, copies = [sets[i] for i in own], block[own], s1[own], s2[own], rep[own], copies[own]
            if len(sets) < 2:
                continue
            size = np.array([len(s) for s in sets], np.int64)
            both = overlaps(sets)
            linked = (both > 0) & ((num + den) * both >= num * (size[:, None] + size[None, :]))
            if lo != hi:
                linked &= block[:, None] != block[None, :]
            np.fill_diagonal(linked, False)
            if pairs:
                i, j = np.nonzero(np.triu(linked))
                i, j = i[rep[i] != rep[j]], j[rep[i] != rep[j]]
                out.append((np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])))
            else:
                out.append((s1, s2, size, linked @ copies))
            if sum(len(o[0]) for o in out) > 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names)

    names = two.columns
    found = units.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi").mapInArrow(trimmed(kernel), ", ".join(f"{c} long" for c in names))
    return found.union(two).distinct() if pairs else found.groupBy("s1", "s2", "n").agg(F.sum("near").alias("near")).union(two)


def jaccard_components(docs: DataFrame, n: int = 3, threshold: Fraction = Fraction(9, 10), sketch_bits: int = SKETCH_BITS, every: bool = True) -> tuple[DataFrame, DataFrame]:
    """``members, links`` of the self join of ``docs (doc_id, text)`` on word ``n``-gram sets.

    ``members`` has a row per input row: ``doc_id, n_shingles, component_id, n_links``. ``links`` holds all verified
    pairs ``a, b`` of different sets, each named by its smallest id; it is worked out only when it is read, and has as
    many rows as there are pairs. ``n_links`` counts the other rows with an id whose sets link with the row's, equal
    ones included; it is null where ``component_id`` is. Without ``every``, ``links`` only spans the components, and
    ``n_links`` is left out.

    Words are the runs of anything but ASCII white space, with A-Z lower-cased. Fewer words than ``n`` make one
    shingle; a null, empty or blank text has an empty set and links with nothing. Equal sets always link, ties need
    no order. Rows that repeat an id are further members of the same node; rows without an id get the component of
    the equal sets that have one, else null. An empty table gives empty results; further columns are ignored. Texts are
    read whole and may be long: a task holds one text and slices of a few MB at a time.
    Sets are compared by 64-bit hashes of their shingles and recognised as equal by size and 128 bits.
    """
    with small_batches(docs.sparkSession):
        return _jaccard(docs.select("doc_id", "text"), n, Fraction(threshold), sketch_bits, every)


def _jaccard(docs: DataFrame, n: int, t: Fraction, sketch_bits: int, every: bool) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    sketch = _frequency_sketch(docs, n, sketch_bits)
    sets = cut(_prefixes(docs, n, sketch_bits, sketch, t))
    # Equal sets: one answer for all of them.
    reps = cut(sets.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count("doc_id").alias("copies"), F.first("map").alias("map"), F.first("prefix").alias("prefix")))
    wide, sets = sets, cut(sets.select("doc_id", "n", "s1", "s2"))
    drop(wide)
    entries = reps.where("rep IS NOT NULL").select("rep", "n", F.posexplode("prefix").alias("pos", "shingle"))
    leads = cut(entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("pos", "n", "rep")).alias("lead")).where("c > 1").select("shingle", "lead"))
    shared = cut(among(entries, "shingle", leads.select("shingle"), ENTRY_FILTER_BITS).join(leads, "shingle"))
    drop(leads)
    first = shared.where(F.col("rep") != F.col("lead.rep")).where(_bound(F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos"), t)).select(F.col("lead.rep").alias("a"), F.col("rep").alias("b")).distinct()
    first = _verified(first, reps, docs, n, t)
    comps = connected_components(first, "a", "b")
    open_ = shared.drop("lead").join(comps, F.col("rep") == F.col("node"), "left").select("shingle", "pos", "n", "rep", F.coalesce("component", "rep").alias("comp"))
    # What no first answer settles, block by block: lists that still hold several components.
    mixed = open_.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("shingle")
    ratio = log(t.denominator / t.numerator) if t < 1 else 1.0
    open_ = cut(open_.join(mixed, "shingle").withColumn("band", F.floor(F.log(F.col("n")) / ratio)))
    blocks = open_.groupBy("shingle", "band", "pos").agg(F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.min("comp").alias("c_lo"), F.max("comp").alias("c_hi"))
    left, right = (blocks.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("band", "pos", "n_lo", "n_hi", "c_lo", "c_hi"))) for s in "xy")
    p, q = t.numerator, t.denominator
    reach = lambda hi, pos, lo: (p + q) * (F.col(hi) - F.col(pos)) >= p * (F.col(hi) + F.col(lo))
    kept = left.join(right, "shingle").where((F.struct("band_x", "pos_x") <= F.struct("band_y", "pos_y")) & (F.col("band_y") - F.col("band_x") <= 1))
    kept = kept.where(reach("n_hi_x", "pos_x", "n_lo_y") & reach("n_hi_y", "pos_y", "n_lo_x"))
    kept = kept.where(~((F.col("c_lo_x") == F.col("c_hi_x")) & (F.col("c_lo_x") == F.col("c_lo_y")) & (F.col("c_lo_y") == F.col("c_hi_y")))).select("shingle", "band_x", "pos_x", "band_y", "pos_y")
    side = lambda s: open_.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("band", "pos", "n", "rep", "comp")))
    rest = kept.join(side("x"), ["shingle", "band_x", "pos_x"]).join(side("y"), ["shingle", "band_y", "pos_y"])
    # Within one block a pair meets in both orders.
    rest = rest.where("comp_x <> comp_y AND (rep_x < rep_y OR band_x <> band_y OR pos_x <> pos_y)").where(_bound(F.col("n_x"), F.col("pos_x"), F.col("n_y"), F.col("pos_y"), t))
    rest = rest.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct()
    links = cut(first.union(_verified(rest, reps, docs, n, t)))
    wide, reps = reps, cut(reps.select("s1", "s2", "n", "rep", "copies"))
    drop(wide, shared, open_, first)

    comps = connected_components(links, "a", "b")
    named = cut(reps.join(comps, F.col("rep") == F.col("node"), "left").select("s1", "s2", "n", "rep", "copies", "component"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id")]
    if every:
        linked = named.where("component IS NOT NULL")
        near = cut(_decided(linked, docs, n, t, pairs=False)).select(*(F.col(c).alias(f"near_{c}") for c in ("s1", "s2", "n")), "near")
        links = _decided(linked, docs, n, t, pairs=True)
        found = named.join(near, (F.col("s1") == F.col("near_s1")) & (F.col("s2") == F.col("near_s2")) & (F.col("n") == F.col("near_n")), "left")
        # Written, so that the rows of a set that very many share can be dealt out again when they meet its answer.
        named = cut(found.drop("near_s1", "near_s2", "near_n"))
        others = F.col("copies") - F.col("doc_id").isNotNull().cast("int") + F.coalesce("near", F.lit(0))
        columns.append(F.when(F.col("rep").isNotNull(), others).when(F.col("doc_id").isNotNull(), F.lit(0)).alias("n_links"))
    return sets.join(named, ["s1", "s2", "n"], "left").select(*columns), links
