"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame and SQL functions only.

The mix is a sequence of slots, each one block of equal token count. Slot ``j`` takes the golden-ratio point
``frac(j / phi)``, in whole numbers of ``2**64`` parts, through the cumulative slot weights of the sources, so every stretch of the mix is close to
the target proportions. The slots of a source are ranked in order; rank ``r`` takes block ``r`` of the source's
documents, which are shuffled by a hash and laid end to end, starting over when they run out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.lineage import cut

#: ``2**64`` over the golden ratio, made odd; multiples of it modulo ``2**64`` are the points, exact for any number of slots.
GOLDEN = 0x9E3779B97F4A7C15
#: Cells of the unit interval that turn the point-in-interval join into an equi-join.
CELLS = 1024
#: Hash ranges into which each source, and runs into which the slots, are cut for two-level running sums.
PARTS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, size``: weighted shares of the total, none above ``most`` times its source.

    Sources by code point, null last, weigh ``weights`` in turn. With sources ordered by how soon they fill up, the
    first ``k`` stand at their limit where the level left for the rest stays below the next one's limit (water filling).
    The windows run over one row per source, never over documents.
    """
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("limit", (F.col("source_size") * most).cast("long")).withColumn("ratio", F.col("limit") / F.col("weight"))
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    s = s.withColumn("full", F.coalesce(F.sum("limit").over(before), F.lit(0))).withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", (F.sum("source_size").over(all_) - F.col("full")).cast("double") / (F.sum("weight").over(all_) - F.col("used")).cast("double"))
    s = s.withColumn("open", F.col("level") <= F.col("ratio"))
    # The level of the first source that does not fill up holds for all after it.
    s = s.withColumn("shared", F.min(F.when(F.col("open"), F.struct("ratio", F.struct(F.col("source").isNull(), "source").alias("s"), "level"))).over(all_)["level"])
    s = s.withColumn("rank", F.row_number().over(fill)).withColumn("first_open", F.min(F.when(F.col("open"), F.col("rank"))).over(all_))
    share = F.when(F.col("rank") >= F.col("first_open"), F.col("weight") * F.col("shared")).otherwise(F.col("limit").cast("double"))
    return s.select("source", "source_size", share.alias("target"))


def _laid_out(docs: DataFrame, seed: str) -> DataFrame:
    """Each document's first token in its source's shuffled stream: running sums within hash ranges, then over them."""
    d = docs.withColumn("key", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    d = d.withColumn("part", F.conv(F.substring("key", 1, 4), 16, 10).cast("int") % PARTS)
    ranges = d.groupBy("source", "part").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("r_source"), F.col("part").alias("r_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inner = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    d = d.join(ranges, d["source"].eqNullSafe(F.col("r_source")) & (F.col("part") == F.col("r_part")))
    return d.withColumn("at", F.col("base") + F.col("inner")).drop("key", "part", "r_source", "r_part", "base", "inner")


def schedule(goals: DataFrame, block: int) -> DataFrame:
    """``slot, source_no, rank`` of the mix: which source each slot takes, and its how-manieth block that is.

    ``goals`` has ``source_no`` and ``wanted`` tokens. A source gets ``ceil(wanted / block)`` slots; where the points
    reach it less often (by a few, the discrepancy), its last slots stand at the end of the mix.
    """
    g = goals.where("wanted > 0").withColumn("need", F.ceil(F.col("wanted") / F.lit(block)).cast("long"))
    w = Window.orderBy("source_no")
    g = g.withColumn("hi", F.sum("need").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("need").over(Window.partitionBy()))
    g = cut(g.select("source_no", "need", (F.col("hi") - F.col("need")).alias("lo"), "hi", "total"))
    spark = goals.sparkSession
    total = g.agg(F.max("total")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], "slot long, source_no long, rank long")
    x = F.col("point")
    share = f"CAST((CAST(id AS decimal(17,0)) * CAST({GOLDEN} AS decimal(20,0))) % CAST({1 << 64} AS decimal(20,0)) AS decimal(20,0))"
    slots = spark.range(total).select(F.col("id").alias("slot"), F.expr(f"CAST({share} * CAST({total} AS decimal(17,0)) div CAST({1 << 64} AS decimal(20,0)) AS bigint)").alias("point"))
    slots = slots.withColumn("cell", F.floor(x * CELLS / total))
    spans = g.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS / total), F.floor((F.col("hi") - 1) * CELLS / total))))
    hits = slots.join(spans, "cell").where((x >= F.col("lo")) & (x < F.col("hi"))).select("slot", "source_no", "need")
    run = F.floor(F.col("slot") * PARTS / total)
    hits = hits.withColumn("run", run)
    counts = hits.groupBy("source_no", "run").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = hits.join(counts.select("source_no", "run", "base"), ["source_no", "run"])
    ranked = ranked.withColumn("rank", F.col("base") + F.row_number().over(Window.partitionBy("source_no", "run").orderBy("slot")) - 1)
    got = counts.groupBy("source_no").agg(F.sum("n").alias("got"))
    short = g.join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    tail = short.select((F.lit(total) + F.col("lo")).alias("first"), "source_no", F.explode(F.sequence("got", F.col("need") - 1)).alias("rank"))
    tail = tail.select((F.col("first") + F.col("rank")).alias("slot"), "source_no", "rank")
    return ranked.where("rank < need").select("slot", "source_no", "rank").union(tail)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = 1024, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """``taken, schedule``: what the mix takes of every document, and the slots that take it.

    ``docs`` needs ``doc_id, text, source``; further columns are ignored. ``taken`` has a row per input row: ``doc_id,
    source, size, source_size, target, taken, first_slot``, the last being the first slot of the mix that takes words of
    the document, null where none does. A source yields exactly its target, rounded to a whole token; a
    document is passed over at most ``most`` times. Null texts and blank ones have size 0 and are never taken; null
    is a source of its own; rows that repeat an id are laid end to end like any others; an empty table gives none.
    Long texts are counted whole. The order within a source is that of ``md5(seed + doc_id)``, so reruns agree.
    """
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    goals = targets(sized, weights, most)
    goals = goals.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")).withColumn("wanted", F.round("target").cast("long"))
    goals = cut(goals.withColumnRenamed("source", "s"))
    slots = schedule(goals, block)
    laid = _laid_out(sized, seed)
    laid = cut(laid.join(goals, laid["source"].eqNullSafe(goals["s"])).drop("s"))
    # A document stands at ``at`` in each pass over its source; it meets the blocks that it overlaps there.
    passes = laid.where("size > 0 AND wanted > 0").select("doc_id", "source_no", "size", "at", "wanted", F.explode(F.expr("transform(sequence(0L, (wanted - 1) div source_size), p -> p * source_size + at)")).alias("begin")).where("begin < wanted")
    end = F.least(F.col("begin") + F.col("size"), F.col("wanted"))
    parts = passes.withColumn("end", end).withColumn("rank", F.explode(F.expr(f"sequence(begin div {block}, (end - 1) div {block})")))
    parts = parts.withColumn("n", F.least("end", (F.col("rank") + 1) * block) - F.greatest("begin", F.col("rank") * block))
    used = parts.join(slots, ["source_no", "rank"]).groupBy("source_no", "at", "doc_id", "size").agg(F.sum("n").alias("n"), F.min("slot").alias("slot"))
    used = used.select(*(F.col(c).alias(f"u_{c}") for c in used.columns))
    whole = laid.join(used, (laid["source_no"] == F.col("u_source_no")) & (laid["at"] == F.col("u_at")) & laid["doc_id"].eqNullSafe(F.col("u_doc_id")) & (laid["size"] == F.col("u_size")), "left")
    return whole.select("doc_id", "source", "size", "source_size", "target", F.coalesce("u_n", F.lit(0)).cast("long").alias("taken"), F.col("u_slot").alias("first_slot")), slots
