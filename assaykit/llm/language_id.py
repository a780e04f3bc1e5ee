"""Language identification by Bayesian evidence fusion.

A page's language is judged from its text (a naive Bayes model over words and word beginnings, counted over all
labelled documents), from the language its markup declares, and from where it stands: the languages of its host,
smoothed towards those of its address suffix, smoothed towards all pages. How far a declaration can be trusted, and the
priors, are grouped aggregates of the text's verdicts over all pages; a page's own verdict is taken out of its priors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.lineage import cut
from assaykit.llm.toxicity import SEPARATORS
from assaykit.llm.wordhash import string_buffer, words_and_prefixes

BITS, BEGINNINGS = 16, (2, 3, 4)
#: Every word counts once, with up to so many features of its own: each feature carries that part of the evidence.
EVIDENCE = 1 / (1 + len(BEGINNINGS))
#: Pseudo-counts of the next wider level in a host's and a suffix's prior, and of a declaration being right (a tenth: wrong).
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 5.0, 20.0, 1.0
SALTS = 32
#: Parts of a page that are not its own text.
BOILERPLATE = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<aside\b.*?</aside>|<footer\b.*?</footer>|<div class=\"ad\">.*?</div>|<!--.*?-->|<[^>]*>|&[a-zA-Z#0-9]+;"


def _buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``text, bucket`` of every feature of every whole text."""
    lowered = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    hashes, numbers, first = words_and_prefixes(*string_buffer(lowered), SEPARATORS, BEGINNINGS)
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.concatenate([text_of[n] for n in numbers]), (np.concatenate(hashes) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def fit_text_model(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and log-likelihoods ``[language, bucket]`` from all rows of ``labelled (text, lang)``.

    Counts are summed in Spark; one table of ``2**16`` counts per language reaches the driver (512 KB; labels are taken to
    be languages, of which there are at most some hundreds). Rows without a text or language are left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                langs = part.column(1).to_pylist()
                text, bucket = _buckets(part.column(0))
                names = sorted(set(langs))
                code = np.array([names.index(x) for x in langs])
                for i, name in enumerate(names):
                    totals[name] = totals.get(name, 0) + np.bincount(bucket[code[text] == i], minlength=1 << BITS)
        yield from out(totals)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                totals[name] = totals.get(name, 0) + np.frombuffer(counts, "<i8")
        yield from out(totals)

    def out(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, counts in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([counts.astype("<i8").tobytes()], pa.binary())], ["lang", "counts"])

    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, counts binary")
    # Two steps: a share of the tasks' tables each, then those shares.
    rows = rows.repartition(32).mapInArrow(add, "lang string, counts binary").repartition("lang").mapInArrow(add, "lang string, counts binary").collect()
    rows.sort(key=lambda r: r["lang"])
    if not rows:
        return [], np.zeros((0, 1 << BITS))
    counts = np.stack([np.frombuffer(r["counts"], "<i8") for r in rows]).astype(float) + 0.1
    return [r["lang"] for r in rows], np.log(counts / counts.sum(1, keepdims=True))


def identify(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """A row per page: ``page_id, lang, probability, text_lang, declared, n_features``.

    ``pages`` has ``page_id, url, html``; further columns are ignored. Without a text, declaration or address the other
    evidence decides; with none at all, the overall prior does. Ties go to the language first by name; ``text_lang`` is
    null without text. Null urls share one empty host. Without labelled rows ``lang`` is null and the probability 0.
    Repeated rows get a row each; an empty table gives none. Labels may hold any characters. Long pages are read whole.
    """
    langs, model = fit_text_model(labelled)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    k = len(langs)
    if not k:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"), F.lit(0).cast("long").alias("n_features"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                html = pc.fill_null(part.column(1).cast(pa.large_string()), "")
                text, bucket = _buckets(pc.replace_substring_regex(html, BOILERPLATE, " "))
                n = np.bincount(text, minlength=part.num_rows)
                ll = np.stack([np.bincount(text, weights=table[i][bucket], minlength=part.num_rows) for i in range(k)], axis=1).astype(float)
                ll = EVIDENCE * (ll - ll.max(1, keepdims=True))
                ends = pa.array(np.arange(0, len(n) * k + 1, k), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), part.column(4), pa.array(n), pa.ListArray.from_arrays(ends, pa.array(ll.ravel()))], ["page_id", "host", "suffix", "declared", "n", "ll"])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"""(?i)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*["']?([a-zA-Z]{2,3})""", 1))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "html", host.alias("host"), F.substring_index(host, ".", -1).alias("suffix"), F.when(declared != "", declared).alias("declared"))
    p = cut(p.mapInArrow(judge, "page_id long, host string, suffix string, declared string, n long, ll array<double>"))
    parts = [F.exp(F.col("ll")[i]) for i in range(k)]
    whole = parts[0]
    for x in parts[1:]:
        whole = whole + x
    p = p.select("*", *(F.when(F.col("n") > 0, parts[i] / whole).otherwise(0.0).alias(f"t{i}") for i in range(k)))
    # Languages by place: sums of the text's verdicts, by suffix and host; overall sums are one row.
    sums = lambda prefix: [F.sum(f"t{i}").alias(f"{prefix}{i}") for i in range(k)]
    by_host = cut(p.groupBy("host", "suffix").agg(*sums("h")))
    by_suffix = by_host.groupBy(F.col("suffix").alias("s_suffix")).agg(*(F.sum(f"h{i}").alias(f"s{i}") for i in range(k)))
    total = [float(x or 0) for x in by_host.agg(*(F.sum(f"h{i}") for i in range(k))).first()]
    world = [(x + 1) / (sum(total) + k) for x in total]
    by_declared = p.where("declared IS NOT NULL").groupBy("declared").agg(*sums("d")).withColumnRenamed("declared", "d_declared")
    places = by_host.join(by_suffix, by_host["suffix"] == F.col("s_suffix")).drop("s_suffix", "suffix").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("host", "p_host")
    salt = F.pmod(F.xxhash64("page_id", "n"), F.lit(SALTS)).cast("int")
    q = p.withColumn("own_salt", salt).join(places, (F.col("host") == F.col("p_host")) & (F.col("own_salt") == F.col("salt")))
    said = by_declared.withColumn("d_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    q = q.join(said, (F.col("declared") == F.col("d_declared")) & (F.col("own_salt") == F.col("d_salt")), "left")
    rest = lambda p, i: F.greatest(F.lit(0.0), F.col(f"{p}{i}") - F.col(f"t{i}"))  # noqa: E731  without the page itself
    total_of = lambda p: F.aggregate(F.array(*(F.col(f"{p}{i}") - F.col(f"t{i}") for i in range(k))), F.lit(0.0), lambda a, x: a + x)
    q = q.withColumns({"s_all": F.greatest(F.lit(0.0), total_of("s")), "h_all": F.greatest(F.lit(0.0), total_of("h"))})
    scores = []
    for i, lang in enumerate(langs):
        suffix = (rest("s", i) + SUFFIX_WEIGHT * world[i]) / (F.col("s_all") + SUFFIX_WEIGHT)
        place = (rest("h", i) + HOST_WEIGHT * suffix) / (F.col("h_all") + HOST_WEIGHT)
        # How often pages of this language declare what this one declares, against pages of any.
        right = F.when(F.col("declared") == F.lit(lang.lower()), DECLARED_WEIGHT).otherwise(DECLARED_WEIGHT / 10)
        record = F.when(F.col(f"d{i}").isNull(), 0.0).otherwise(F.log((rest("d", i) + right) / (total[i] + 2 * DECLARED_WEIGHT)))
        scores.append(F.struct((F.col("ll")[i] + F.log(place) + record).alias("v"), F.lit(-i).alias("o"), F.lit(lang).alias("lang")))
    q = q.withColumn("all", F.array(*scores)).withColumn("best", F.array_max("all"))
    text = F.expr("array_max(transform(ll, (x, i) -> named_struct('v', x, 'o', -i)))")["o"]
    names = F.array(*(F.lit(x) for x in langs))
    return q.select("page_id", F.col("best.lang").alias("lang"), F.expr("1D / aggregate(all, 0D, (a, x) -> a + exp(x.v - best.v))").alias("probability"), F.when(F.col("n") > 0, F.element_at(names, (-text + 1).cast("int"))).alias("text_lang"), "declared", F.col("n").alias("n_features"))
