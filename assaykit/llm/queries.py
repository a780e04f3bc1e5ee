"""The queries of this subpackage, each over its whole table, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assaykit.llm.chat import format_chats, read_back
from assaykit.llm.decontaminate import decontaminate
from assaykit.llm.language_id import identify
from assaykit.llm.mixing import mix_sources
from assaykit.llm.ngram_jaccard import jaccard_components
from assaykit.llm.secrets import scan_secrets
from assaykit.llm.suffix_dedup import remove_repeats
from assaykit.llm.token_counts import token_counts
from assaykit.llm.topk import top_k
from assaykit.llm.toxicity import toxicity

#: A public byte-level BPE vocabulary, as a file of ranks on every machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct 3-word shingle sets of all documents, linked at a Jaccard similarity of 0.9: set size, component, number of links."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed shapes and entropy spans of every document: counts, digest of the fixed ones, all spans, and parts beside them."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "parts")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest whole-number inner products for every fiftieth vector against all others."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, by separator scan of flat token streams."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), VOCABULARY)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document within a 10-word window of a benchmark item, and which items."""
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))[0]


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document within a 400-byte string that occurs more than once, and what is left without them."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=False)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and words taken of every document, and the first slot of the mix that takes some."""
    taken, _ = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return taken.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page from its text, declaration and place, with a model counted over all labelled documents."""
    return identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, formatted and read back."""
    told = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(format_chats(rows.union(own)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold, score and prediction of every document."""
    scored = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "held_out", "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_secret_scans": op2_secret_scans,
    "op3_exact_topk": op3_exact_topk,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_mixing": op7_mixing,
    "op8_language_id": op8_language_id,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_toxicity": op10_toxicity,
}

_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix' || coalesce(doc_id::VARCHAR, '')) AS key FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
r AS (SELECT *, 3 * source_size AS lim, (3 * source_size)::DOUBLE / weight::DOUBLE AS ratio FROM w),
f AS (SELECT *, row_number() OVER v AS rank,
        (sum(source_size) OVER () - coalesce(sum(lim) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(weight) OVER () - coalesce(sum(weight) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
      FROM r WINDOW v AS (ORDER BY ratio, source NULLS LAST)),
o AS (SELECT min(rank) AS rank FROM f WHERE level <= ratio),
g AS (SELECT f.source, f.source_size, CASE WHEN f.rank >= o.rank THEN f.weight * l.level ELSE f.lim::DOUBLE END AS target
      FROM f, o LEFT JOIN f l ON l.rank = o.rank),
t AS (SELECT *, round(target)::BIGINT AS wanted, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM g),
a AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.wanted, t.no,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY ('0x' || substr(d.key, 1, 4))::INT % 1024, d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
need AS (SELECT no, (wanted + 1023) // 1024 AS need, (sum((wanted + 1023) // 1024) OVER (ORDER BY no))::BIGINT AS hi FROM t WHERE wanted > 0),
total AS (SELECT coalesce(max(hi), 0)::BIGINT AS total FROM need),
point AS (SELECT j AS slot, (((j::HUGEINT * 11400714819323198485) % 18446744073709551616) * total // 18446744073709551616)::BIGINT AS point FROM total, range((SELECT total FROM total)) r(j)),
hit AS (SELECT no, need, slot, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS rank FROM point JOIN need ON point >= hi - need AND point < hi),
got AS (SELECT no, count(*) AS got FROM hit GROUP BY no),
slots AS (SELECT no, rank, slot FROM hit WHERE rank < need UNION ALL
          SELECT no, r.k, total + hi - need + r.k FROM need LEFT JOIN got USING (no), total, LATERAL (SELECT unnest(range(coalesce(got, 0), need)) AS k) r),
pass AS (SELECT doc_id, size, start_at, no, wanted, unnest(range((wanted + source_size - 1) // source_size)) * source_size + start_at AS b FROM a WHERE size > 0 AND wanted > 0),
part AS (SELECT DISTINCT doc_id, size, start_at, no, unnest(range(b // 1024, (least(b + size, wanted) - 1) // 1024 + 1)) AS rank FROM pass WHERE b < wanted),
first_ AS (SELECT doc_id, size, start_at, no, min(slot) AS first_slot FROM part JOIN slots USING (no, rank) GROUP BY ALL)
SELECT a.doc_id, a.size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (wanted // source_size) * a.size + greatest(0, least(a.start_at + a.size, wanted % source_size) - a.start_at) END::BIGINT AS taken, first_slot::BIGINT AS first_slot
FROM a LEFT JOIN first_ f ON f.doc_id IS NOT DISTINCT FROM a.doc_id AND f.size = a.size AND f.start_at = a.start_at AND f.no = a.no"""

_TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS z FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.z, c.z)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_JACCARD_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT row, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT row, count(*) AS n FROM g GROUP BY row),
b AS (SELECT x.row AS x, y.row AS y, count(*) AS both_ FROM g x JOIN g y USING (g) WHERE x.row <> y.row GROUP BY ALL),
l AS (SELECT x, y, a.doc_id AS i, o.doc_id AS j FROM b JOIN n p ON p.row = x JOIN n q ON q.row = y JOIN w a ON a.row = x JOIN w o ON o.row = y WHERE 100 * both_ >= 90 * (p.n + q.n - both_)),
e AS (SELECT DISTINCT i, j FROM l WHERE i <> j),
r(node, seen) AS (SELECT DISTINCT i, i FROM e UNION SELECT r.node, e.j FROM r JOIN e ON e.i = r.seen),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, w.doc_id)::BIGINT AS component_id, (SELECT count(*) FROM l WHERE l.x = w.row)::BIGINT AS n_links
FROM w LEFT JOIN n USING (row) LEFT JOIN c ON node = w.doc_id"""

_LEAKS_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS k FROM b WHERE len(w) > 0),
s AS (SELECT DISTINCT m FROM v),
o AS (SELECT row, m, unnest(range(1, len(w) - m + 2)) AS p, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS k FROM d, s WHERE len(w) >= m),
h AS (SELECT row, item_id, p, o.m FROM o JOIN v ON o.k = v.k AND o.m = v.m),
n AS (SELECT row, count(DISTINCT q) AS n FROM (SELECT DISTINCT row, unnest(range(p, p + m)) AS q FROM h) GROUP BY row),
t AS (SELECT row, count(*) AS items, string_agg(item_id, ',' ORDER BY item_id) AS named FROM (SELECT DISTINCT row, item_id FROM h) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(items, 0)::BIGINT AS n_items, sha256(coalesce(named, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (row) LEFT JOIN t USING (row)"""

_REPEATS_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS row, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT row, i, md5(b[i:i + 399]) AS h FROM (SELECT row, b, unnest(range(1, n - 398)) AS i FROM d WHERE n >= 400)),
s AS (SELECT row, i, lag(i) OVER (PARTITION BY row ORDER BY i) AS before FROM p SEMI JOIN (SELECT h FROM p GROUP BY h HAVING count(*) > 1) USING (h)),
g AS (SELECT row, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY i) AS g FROM s),
r AS (SELECT row, min(i) AS a, max(i) + 399 AS z FROM g GROUP BY row, g),
k AS (SELECT row, a, coalesce(lag(z) OVER (PARTITION BY row ORDER BY a), 0) AS from_ FROM r UNION ALL SELECT row, n + 1, coalesce(max(z), 0) FROM d LEFT JOIN r USING (row) GROUP BY row, n),
t AS (SELECT row, string_agg(CASE WHEN a - 1 > from_ THEN hex(b[from_ + 1:a - 1]) ELSE '' END, '' ORDER BY a) AS kept FROM k JOIN d USING (row) GROUP BY row)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (row) LEFT JOIN (SELECT row, sum(z - a + 1) AS gone, count(*) AS spans FROM r GROUP BY row) USING (row)"""

_CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _escaped(column: str) -> str:
    sql = f"replace({column}, '\\', '\\\\')"
    for c in _CONTROLS:
        sql = f"replace({sql}, '{c}', '{c[0]}\\{c[1:]}')"
    return sql


_CHAT_SQL = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|' || {_escaped("role")} || '|>' || chr(10) || {_escaped("text")} || '</s>' || chr(10)))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id"""

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": _JACCARD_SQL,
    "op5_decontamination": _LEAKS_SQL,
    "op6_suffix_dedup": _REPEATS_SQL,
    "op9_chat_formatting": _CHAT_SQL,
    "op3_exact_topk": _TOPK_SQL,
    "op7_mixing": _MIX_SQL.format(docs="documents"),
}
