"""Token counts by separator scan over flat token streams.

A token file is a bare sequence of token ids, documents one after the other, each closed by an end-of-document id;
there is no index. The stream is cut into blocks of a fixed number of ids regardless of documents. Every block is
searched for separators at once (vectorised), and gives the lengths between them plus its open head and tail; a prefix
scan over block summaries then stitches documents that cross blocks: a document's head count is the number of ids
since the last separator in any earlier block.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaykit.lineage import cut

#: Ids in a block, and blocks in a run: the scan goes within runs and then over runs.
BLOCK, RUN = 1 << 16, 1 << 10
EOD = 50_256


def _encoder(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Splits text before byte pairs are merged (the public pattern of this vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenize_flat(docs: DataFrame, vocabulary: str, eod: int = EOD, block: int = BLOCK, pattern: str = PATTERN) -> DataFrame:
    """Flat token streams of ``docs (doc_id, text)``: ``file, block, ids, docs``.

    Each partition becomes one stream of little-endian uint16 ids, cut every ``block`` ids. ``docs`` names, in order, the
    documents whose separator lies in the block; it takes no part in counting. ``vocabulary`` is a file of ranks
    that every executor can open. A null text is an empty document.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, cache = _encoder(vocabulary, pattern), []
        names: list[int | None] = []
        waiting: list[np.ndarray] = []
        held, number = 0, 0
        from pyspark import TaskContext

        file = TaskContext.get().partitionId()

        def out(ids: np.ndarray, named: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([ids.astype("<u2").tobytes()], pa.binary()), pa.array([named], pa.list_(pa.int64()))], ["file", "block", "ids", "docs"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encoder.encode_ordinary(text or ""), eod], dtype=np.uint16)
                waiting.append(ids)
                names.append(doc)
                held += len(ids)
                if held >= block:
                    flat = np.concatenate(waiting)
                    while len(flat) >= block:
                        n = int((flat[:block] == eod).sum())
                        yield out(flat[:block], names[:n])
                        flat, names, number = flat[block:], names[n:], number + 1
                    waiting, held = [flat], len(flat)
        flat = np.concatenate(waiting) if waiting else np.zeros(0, np.uint16)
        if len(flat):
            yield out(flat, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(kernel, "file long, block long, ids binary, docs array<long>")


def read_flat_files(spark: SparkSession, path: str, block: int = BLOCK, dtype: str = "<u2") -> DataFrame:
    """``file, block, ids`` of the flat token files under ``path`` (each of a size that one task can hold)."""
    step = block * np.dtype(dtype).itemsize

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i in range(0, len(data), step):
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([i // step], pa.int64()), pa.array([data[i : i + step]], pa.binary())], ["file", "block", "ids"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(kernel, "file string, block long, ids binary")


def separator_scan(blocks: DataFrame, eod: int = EOD, dtype: str = "<u2") -> DataFrame:
    """``file, place, n_tokens`` (and ``doc_id``, where ``blocks`` has ``docs``) of every document in flat streams.

    ``place`` counts a file's documents from 0; ids after a file's last separator are no document and give no row. The
    separator itself is not counted. Blocks of a file may have any sizes; an empty table gives no rows.
    """
    named = "docs" in blocks.columns
    kind = blocks.schema["file"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(2).to_pylist():
                ids = np.frombuffer(data or b"", dtype=dtype)
                at = np.flatnonzero(ids == eod)
                out.append((len(ids), len(at), np.diff(at, prepend=-1) - 1, len(ids) - 1 - (at[-1] if len(at) else -1)))
            arrays = [batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int64())), pa.array([int(o[3]) for o in out], pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, *batch.columns[3:]], ["file", "block", "n", "ends", "lengths", "tail", *(["docs"] if named else [])])

    extra = ", docs array<long>" if named else ""
    # The summaries are read twice, the blocks (and whatever makes them) once.
    b = cut(blocks.select("file", "block", "ids", *(["docs"] if named else [])).mapInArrow(kernel, f"file {kind}, block long, n long, ends long, lengths array<long>, tail long{extra}"))
    b = b.withColumn("run", F.floor(F.col("block") / RUN))
    inner = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Within a run: ids before the block, documents before it, and ids up to the last separator before it.
    b = b.withColumn("ids_before", F.coalesce(F.sum("n").over(inner), F.lit(0))).withColumn("docs_before", F.coalesce(F.sum("ends").over(inner), F.lit(0)))
    b = b.withColumn("mark", F.when(F.col("ends") > 0, F.col("ids_before") + F.col("n") - F.col("tail")))
    b = b.withColumn("mark_before", F.max("mark").over(inner))
    runs = b.groupBy("file", "run").agg(F.sum("n").alias("run_n"), F.sum("ends").alias("run_ends"), F.max("mark").alias("run_mark"))
    outer = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("base", F.coalesce(F.sum("run_n").over(outer), F.lit(0))).withColumn("doc_base", F.coalesce(F.sum("run_ends").over(outer), F.lit(0)))
    runs = runs.withColumn("mark_base", F.coalesce(F.max(F.col("base") + F.col("run_mark")).over(outer), F.lit(0)))
    b = b.where("ends > 0").join(runs.select("file", "run", "base", "doc_base", "mark_base"), ["file", "run"])
    head = F.col("base") + F.col("ids_before") - F.coalesce(F.col("base") + F.col("mark_before"), F.col("mark_base"))
    b = b.select("file", (F.col("doc_base") + F.col("docs_before")).alias("first"), head.alias("head"), F.posexplode(F.arrays_zip("lengths", "docs") if named else F.transform("lengths", lambda x: F.struct(x.alias("lengths")))).alias("i", "x"))
    n = F.col("x.lengths") + F.when(F.col("i") == 0, F.col("head")).otherwise(F.lit(0))
    return b.select("file", (F.col("first") + F.col("i")).alias("place"), *([F.col("x.docs").alias("doc_id")] if named else []), n.cast("long").alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_tokens`` of whole texts, by scanning their flat token streams; a row per input row.

    Null and empty texts have no tokens; rows that repeat an id, or have none, are counted each for itself; an empty
    table gives none; columns but ``doc_id`` and ``text`` are ignored. A task holds one text's tokens beside a block.
    """
    return separator_scan(tokenize_flat(docs, vocabulary, block=block)).select("doc_id", "n_tokens")
