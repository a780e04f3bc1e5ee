"""Benchmark decontamination by winnowing. DataFrame and SQL functions only.

Every text is fingerprinted by the smallest hash of its ``k``-word grams in each sliding window of ``window - k + 1``
grams, so two texts that share ``window`` consecutive words share a fingerprint. Document and benchmark fingerprints
are joined, and every joint occurrence is extended word by word, at most ``window - k`` words to either side: the
words of the extension are hit when it is at least ``window`` long. Each window of a benchmark item lies within the
extension of a fingerprint it holds, so exactly the words in such windows are hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.lineage import cut

#: Once A-Z is lower-cased, the runs between these are words: digits, a-z and everything beyond ASCII.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the filter over benchmark fingerprints that stands before the join: 64 for each, within these bounds.
FILTER_BITS = (14, 19)
#: The benchmark's fingerprints are broadcast up to this many (each a hash, an id and the words within reach, 15 for
#: windows of 10); beyond, both sides shuffle.
BROADCAST_ROWS = 50_000


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; where every character is ASCII, the plain function does the same faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), SEPARATOR, -1), "")


def _grams(k: int, w: str = "w", n: str = "n") -> str:
    """Hashes of the ``k``-word grams; element ``i`` starts at word ``i`` (from 1)."""
    return f"IF({n} >= {k}, transform(sequence(1, {n} - {k} + 1), i -> xxhash64(slice({w}, i, {k}))), CAST(array() AS array<bigint>))"


def _winnowed(grams: str, span: int) -> str:
    """The distinct minima of each ``span`` consecutive gram hashes (of all, if fewer)."""
    return f"array_distinct(transform(sequence(1, greatest(1, size({grams}) - {span - 1})), i -> array_min(slice({grams}, i, {span}))))"


def _around(w: str, p: str, reach: int, most: int) -> str:
    """The words from ``reach`` before place ``p`` to ``most + reach`` after it."""
    return f"slice({w}, greatest(1, {p} - {reach}), least({p} - 1, {reach}) + {most + reach})"


def _place(p: str, reach: int) -> str:
    """Where the word at place ``p`` stands in what ``_around`` gives."""
    return f"least({p}, {reach + 1})"


def _fingerprints(benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """``item_id, m, h, iw, q``: each joinable gram of each item, with the words within reach and the gram's place in them.

    Items of ``window`` words or more are winnowed (``m`` is ``k``); a shorter one is a single window, found by its
    first gram of ``m = min(k, words)`` words.
    """
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("iw")).distinct()
    items = items.withColumn("c", F.size("iw")).where("c > 0")
    long_ = items.where(F.col("c") >= window).withColumn("g", F.expr(_grams(k, "iw", "c"))).withColumn("f", F.expr(_winnowed("g", window - k + 1)))
    long_ = long_.withColumn("q", F.explode(F.expr("filter(sequence(1, size(g)), i -> array_contains(f, g[i - 1]))")))
    long_ = long_.select("item_id", F.lit(k).alias("m"), F.expr("g[q - 1]").alias("h"), F.expr(_around("iw", "q", window - k, k)).alias("iw"), F.expr(_place("q", window - k)).alias("q"), F.lit(window).alias("least"))
    long_ = long_.select("item_id", "m", "h", "iw", F.size("iw").alias("c"), "q", "least")
    short = items.where(F.col("c") < window).withColumn("m", F.least("c", F.lit(k)))
    short = short.select("item_id", "m", F.expr("xxhash64(slice(iw, 1, m))").alias("h"), "iw", "c", F.lit(1).alias("q"), F.col("c").alias("least"))
    return long_.union(short)


def _filter_bits(fps: DataFrame, where: str, bits: int) -> str:
    """A foldable SQL array of longs with the bit of every fingerprint set; at most ``2**bits`` bits reach the driver."""
    at = f"(h & {(1 << bits) - 1})"
    found = fps.where(where).groupBy(F.expr(f"CAST({at} >> 6 AS int)").alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({at} & 63 AS int))")).alias("bits")).collect()
    longs = [0] * (1 << (bits - 6))
    for row in found:
        longs[row["slot"]] = row["bits"]
    return f"from_json('{longs}', 'array<bigint>')"


def _passes(value: str, name: str, bits: int) -> str:
    at = f"({value} & {(1 << bits) - 1})"
    return f"getbit(element_at({name}, CAST({at} >> 6 AS int) + 1), CAST({at} & 63 AS int)) = 1"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """``marked, spans``: what of each document occurs in the benchmark, and where.

    ``docs`` needs ``doc_id, text``, ``benchmark`` needs ``item_id, text``; further columns are ignored. ``marked`` has
    a row per input row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``. ``spans`` has the hit word
    runs: ``doc_id, row, item_id, first, last`` (words from 1, both included).

    Null, empty and word-free texts have no words and no hits; an item without words or without an id takes no part;
    items that repeat count once; rows that repeat a document id are marked each for itself; empty tables give no
    rows, an empty benchmark no hits. Long texts are searched whole, as one array of words.
    """
    fps = cut(_fingerprints(benchmark.select("item_id", "text"), window, k))
    kinds = {(r["m"], r["least"] < window): r["n"] for r in fps.groupBy("m", "least").count().withColumnRenamed("count", "n").collect()}
    count = sum(kinds.values())
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (64 * max(count, 1) - 1).bit_length()))

    d = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    d = d.withColumn("g", F.expr(_grams(k)))
    found = []
    if (k, False) in kinds:
        d = d.withColumn("f", F.expr(_winnowed("g", window - k + 1)))
        found.append(("f", f"filter(f, h -> {_passes('h', _filter_bits(fps, f'm = {k} AND least = {window}', bits), bits)})", k, "g"))
    for m in sorted({m for m, small in kinds if small}):
        # A short item has no guarantee of a winnowed gram: all grams of its length are looked up.
        source = "g" if m == k else f"g{m}"
        if m != k:
            d = d.withColumn(source, F.expr(_grams(m)))
        found.append((source, f"array_distinct(filter({source}, h -> {_passes('h', _filter_bits(fps, f'm = {m} AND least < {window}', bits), bits)}))", m, source))
    hits = "CAST(array() AS array<struct<m:int,h:bigint,p:int>>)"
    for i, (_, chosen, m, source) in enumerate(found):
        d = d.withColumn(f"c{i}", F.expr(chosen))
        hits = f"concat({hits}, IF(size(c{i}) = 0, CAST(array() AS array<struct<m:int,h:bigint,p:int>>), transform(filter(sequence(1, size({source})), j -> array_contains(c{i}, {source}[j - 1])), j -> named_struct('m', {m}, 'h', {source}[j - 1], 'p', j))))"
    d = d.withColumn("hit", F.expr(f"array_distinct({hits})")).select("doc_id", "row", "n", F.when(F.size("hit") > 0, F.col("w")).alias("w"), "hit")
    d = d.select("doc_id", "row", "n", "w", F.explode_outer("hit").alias("t")).select("doc_id", "row", "n", "w", "t.m", "t.h", "t.p")
    # Only the words within reach go on to the join.
    d = d.select("doc_id", "row", F.col("n").alias("n_words"), "m", "h", F.col("p").alias("at"), F.expr(_around("w", "p", window - k, window)).alias("w"), F.expr(_place("p", window - k)).alias("p")).withColumn("n", F.size("w"))
    side = F.broadcast(fps) if count <= BROADCAST_ROWS else fps
    d = d.join(side, ["m", "h"], "left")
    reach = window - k
    equal = lambda step: f"(w[p - 1 + {step}] <=> iw[q - 1 + {step}])"
    # Words that agree to the right of the gram's first word and to the left of it, until the first that does not.
    right = f"coalesce(array_min(filter(sequence(0, {reach} + m - 1), s -> p + s > n OR q + s > c OR w[least(p + s, n) - 1] IS DISTINCT FROM iw[least(q + s, c) - 1])), {reach} + m)"
    left = f"coalesce(array_min(filter(sequence(1, {reach}), s -> p - s < 1 OR q - s < 1 OR w[greatest(p - s, 1) - 1] IS DISTINCT FROM iw[greatest(q - s, 1) - 1])), {reach + 1}) - 1"
    d = d.withColumn("r", F.expr(f"IF(item_id IS NULL, 0, IF(least < {window}, IF(slice(w, p, c) = iw, c, 0), {right}))")).withColumn("l", F.expr(f"IF(item_id IS NULL OR least < {window}, 0, {left})"))
    ok = (F.col("item_id").isNotNull()) & (F.col("l") + F.col("r") >= F.col("least")) & (F.col("r") > 0)
    # One row per document survives without a span; equal spans meet before they travel.
    spans = d.select("doc_id", "row", F.col("n_words").alias("n"), F.when(ok, F.col("item_id")).alias("item_id"), F.when(ok, F.col("at") - F.col("l")).alias("first"), F.when(ok, F.col("at") + F.col("r") - 1).alias("last")).distinct()
    spans = cut(spans)
    per = Window.partitionBy("row").orderBy(F.col("first").asc_nulls_last(), "last")
    reached = F.coalesce(F.max("last").over(per.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = spans.withColumn("fresh", F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, reached)))
    items = F.collect_set("item_id")
    marked = each.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n").cast("long").alias("n_words"), F.coalesce(F.sum("fresh"), F.lit(0)).cast("long").alias("n_hit"), items.alias("items"))
    marked = marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
    return marked, spans.where("item_id IS NOT NULL").select("doc_id", "row", "item_id", "first", "last")
