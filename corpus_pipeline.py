"""A corpus pipeline of five stages, each over all that the one before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``documents``.
Benchmark and labels come from ``sf_dir``; the stages read documents only from ``docs``.

Stages judge rows by their texts, so ids may be null or repeated. Further columns pass through unchanged, whatever their
names; a null or empty text is clean; an empty table gives none. Long texts are judged whole.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.lineage import cut, delete, shared_folder
from assaykit.llm.common import among, free_names
from assaykit.llm.decontaminate import decontaminate
from assaykit.llm.mixing import mix_sources
from assaykit.llm.ngram_jaccard import jaccard_components
from assaykit.llm.secrets import redact
from assaykit.llm.toxicity import toxicity

#: No SQL: the first stage is a fitted model.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    names = free_names(docs, "held_out", "score", "predicted")
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), names=names)
    return scored.where(F.col(names[2]) == 0).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by five-word shingle similarity of 0.8 or more, one row stays.

    That is the row with the smallest id (null counts as largest); of rows that repeat id and text, the first by their
    further columns. Rows of one id with texts that are not linked all stay, and so do texts without words.
    """
    key, best_id, best_key, best, salt = free_names(docs, "text_key", "best_id", "best_key", "best", "salt")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    ids = keyed.groupBy(key, "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    # The operator's node is a text.
    members, _ = jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text"), n=5, threshold=Fraction(4, 5), every=False)
    members = members.where("n_shingles > 0").select(F.col("doc_id").alias("node"), "component_id").distinct()
    each = cut(ids.join(members, F.col(key) == F.col("node")).select(key, "doc_id", "rows", "component_id"))
    groups = each.groupBy("component_id").agg(F.sum("rows").alias("rows"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("key"))).alias("best")).where("rows > 1")
    ruled = cut(each.select(key, "component_id").distinct().join(groups, "component_id").select(F.col(key).alias(best_key), F.col("best.doc_id").alias(best_id), (F.col("best.key") == F.col(key)).alias(best)))
    # Texts that are alone stay where they are; of the others, rows that are not their group's best go first.
    alone = among(keyed, key, ruled.select(best_key), others=True)
    near = among(keyed, key, ruled.select(best_key)).join(ruled, F.col(key) == F.col(best_key), "left")
    near = near.where(F.col(best_key).isNull() | (F.col(best) & F.col("doc_id").eqNullSafe(F.col(best_id))))
    # Rows that repeat the best one's id and text count once; a text that the filter let pass by chance is on its own.
    further = F.to_json(F.struct(F.lit(1).alias(salt), *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text"))))
    near = near.withColumn(salt, F.when(F.col(best_key).isNull(), F.monotonically_increasing_id()).otherwise(-1))
    kept = near.groupBy(key, salt).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), further).alias(best)).select(f"{best}.*")
    return alone.select(*docs.columns).union(kept)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    key, gone_key = free_names(docs, "text_key", "gone_key")
    keyed = docs.withColumn(key, F.sha2("text", 256))
    marked, _ = decontaminate(keyed.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = cut(marked.where("contaminated").select(F.col("doc_id").alias(gone_key)).distinct())
    # Only texts that may be gone meet the list. (An anti join would be moved below the filter, and meet all texts.)
    clean = among(keyed, key, gone, others=True)
    rest = among(keyed, key, gone).join(gone, F.col(key) == F.col(gone_key), "left").where(F.col(gone_key).isNull())
    return clean.select(*docs.columns).union(rest.select(*docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: ``doc_id, source, size, source_size, target, taken, first_slot``."""
    return mix_sources(docs)[0]


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each result written as Parquet in the shared folder and reread.

    A stage's table goes when the next one has been written, the last one at the driver's end.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.mode("append").parquet(folder)
        docs = spark.read.schema(docs.schema).parquet(folder)
        if before:
            delete(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
