"""Near-duplicate screening of images: hash distance, similarity tiers, shortlist, confirmed pairs."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions.scalar import hamming


def _parts(width: int, distance: int, most_keys: int) -> list[tuple[int, int, int]]:
    """``first bit, bits, flips`` of substrings such that hashes within ``distance`` agree in one up to its flips.

    ``m`` substrings share ``distance`` flipped bits, so the ``i``-th of them has at most ``(distance - i) // m`` or a later
    one has less. Of the numbers of substrings whose keys are few enough the most selective is taken.
    """
    best = None
    for m in range(1, distance + 2):
        sizes = [width // m + (i < width % m) for i in range(m)]
        flips = [(distance - i) // m for i in range(m)]
        keys = [sum(comb(s, f) for f in range(r + 1)) for s, r in zip(sizes, flips)]
        share = sum(k / 2**s for k, s in zip(keys, sizes))
        if sum(keys) <= most_keys and (best is None or share < best[0]):
            first = [sum(sizes[:i]) for i in range(m)]
            best = (share, [p for p in zip(first, sizes, flips) if p[2] >= 0])
    return best[1]


def hamming_pairs(left: DataFrame, right: DataFrame, distance: int, key: str = "id", bits: str = "hash", width: int = 64, most_keys: int = 640) -> DataFrame:
    """``left_id, right_id, distance`` of all pairs within ``distance``, by substrings that nearly agree instead of all pairs.

    Hashes are cut into substrings of even size; two hashes within ``distance`` have one in which few bits differ, so the
    left side looks up each substring with every choice of so many bits flipped, in an equi-join. A pair is
    reported by the first substring in which it can meet, which saves a later duplicate removal.
    """
    return hamming_candidates(left, right, distance, key, bits, width, most_keys).where(F.col("distance") <= distance).select("left_id", "right_id", "distance")


def hamming_candidates(left: DataFrame, right: DataFrame, distance: int, key: str = "id", bits: str = "hash", width: int = 64, most_keys: int = 640) -> DataFrame:
    """``left_id, right_id, distance`` of the pairs that are compared: each pair that meets in a substring, once."""
    parts = _parts(width, distance, most_keys)
    piece = lambda h, first, size: F.shiftrightunsigned(h, first).bitwiseAND((1 << size) - 1) if size < 64 else F.col(h)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x

    def masks(size: int, flips: int) -> list[int]:
        return [signed(sum(1 << i for i in chosen)) for f in range(flips + 1) for chosen in combinations(range(size), f)]

    spark = left.sparkSession
    flips = F.broadcast(spark.createDataFrame([(i, m) for i, (_, size, r) in enumerate(parts) for m in masks(size, r)], "part int, mask long"))
    cut_ = lambda h: F.posexplode(F.array(*(piece(h, first, size) for first, size, _ in parts)))
    a = left.select(F.col(key).alias("left_id"), F.col(bits).alias("left_hash")).where("left_hash IS NOT NULL").select("left_id", "left_hash", cut_("left_hash").alias("part", "own"))
    a = a.join(flips, "part").select("left_id", "left_hash", "part", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
    b = right.select(F.col(key).alias("right_id"), F.col(bits).alias("right_hash")).where("right_hash IS NOT NULL").select("right_id", "right_hash", cut_("right_hash").alias("part", "value"))
    pairs = a.join(b, ["part", "value"])
    first = F.lit(len(parts))
    for i, (at, size, r) in reversed(list(enumerate(parts))):
        first = F.when(F.bit_count(piece("left_hash", at, size).bitwiseXOR(piece("right_hash", at, size))) <= r, F.lit(i)).otherwise(first)
    return pairs.where(F.col("part") == first).select("left_id", "right_id", hamming(F.col("left_hash"), F.col("right_hash")).alias("distance"))


def nearest(pairs: DataFrame, by: str, other: str, distance: str = "distance") -> DataFrame:
    """The closest partner of every ``by``; ties to the smaller partner."""
    return pairs.groupBy(by).agg(F.min(F.struct(distance, other)).alias("n")).select(by, f"n.{other}", f"n.{distance}")


def tier_predicate(mae: Column, r: Column, ham: Column, most_mae: float, least_r: float, most_ham: int | None) -> Column:
    """Both similarities, and the hash distance where the tier asks; an undefined correlation fails every tier."""
    ok = (mae <= most_mae) & (F.nanvl(r, F.lit(-2.0)) >= least_r)
    return F.coalesce(ok & (ham <= most_ham) if most_ham is not None else ok, F.lit(False))


def tiers(pairs: DataFrame, rules: dict[str, tuple[float, float, int | None]], mae: str = "original_mae", r: str = "original_pearson", ham: str = "phash_distance") -> DataFrame:
    """``pairs`` with one boolean column ``tier_<name>`` per rule."""
    return pairs.select("*", *(tier_predicate(F.col(mae), F.col(r), F.col(ham), *rule).alias(f"tier_{name}") for name, rule in rules.items()))


def shortlist(pairs: DataFrame, most_mae: float = 0.015, least_r: float = 0.985, mae: str = "aligned_mae", r: str = "aligned_pearson") -> DataFrame:
    """Pairs worth a person's look, best first, with derived shift and improvement."""
    d = pairs.where(tier_predicate(F.col(mae), F.col(r), F.lit(0), most_mae, least_r, None))
    if "best_dx" in pairs.columns:
        d = d.withColumn("shift_magnitude", F.sqrt(F.col("best_dx") ** 2 + F.col("best_dy") ** 2)).withColumn("mae_improvement", F.col("original_mae") - F.col(mae))
    return d.orderBy(F.asc(mae), F.desc_nulls_last(r))


def confirmed(short: DataFrame, decisions: DataFrame, keys: tuple[str, str] = ("train_file", "val_file")) -> DataFrame:
    """Shortlisted pairs that a person labelled ``A``, numbered from 1; every pair needs exactly one decision A or B."""
    d = decisions.select(*keys, "manual_label")
    lost = short.join(d, [*keys], "left_anti").count() + d.join(short, [*keys], "left_anti").count()
    if lost or d.groupBy(*keys).count().where("count > 1").count() or d.where("manual_label IS NULL OR manual_label NOT IN ('A', 'B')").count():
        raise ValueError("each shortlisted pair needs exactly one decision A or B")
    return short.drop("manual_label").join(d, [*keys]).where("manual_label = 'A'").withColumn("pair_id", F.row_number().over(Window.orderBy(*keys)))  # what a person decided is few


def exact_duplicates(files: DataFrame, digest: str = "digest", split: str = "split") -> DataFrame:
    """``digest, files, kind`` of digests that occur more than once: within one split, or across."""
    g = files.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count(F.lit(1)).alias("files"), F.min(split).alias("lo"), F.max(split).alias("hi"))
    return g.where("files > 1").select(digest, "files", F.when(F.col("lo") == F.col("hi"), F.concat(F.lit("within_"), "lo")).otherwise(F.lit("cross_split")).alias("kind"))
