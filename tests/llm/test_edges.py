"""Every operator and stage on nulls in any column, repeated rows, ties, clashing names, empty tables and very long texts."""

import re
from collections import Counter
from fractions import Fraction

import corpus_pipeline
import pytest
from assaykit.llm import chat, language_id, mixing, ngram_jaccard, secrets, suffix_dedup, token_counts, topk, toxicity
from assaykit.llm.decontaminate import decontaminate
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, found int, predicted int, `row` int, best int, text_key int, component_id int, size int, h int, k int"
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
LONG = " ".join(f"w{i % 9973}x{i % 13}" for i in range(280_000))  # about 2.7 MB
ROWS = [
    (1, "one two three four five six seven", "en", "a"),
    (1, "one two three four five six seven", "en", "a"),
    (1, "quite another text with the same id", "en", "a"),
    (None, "one two three four five six seven", "en", None),
    (None, "password=hunter2222 without an id", None, "a"),
    (None, "nothing secret without an id here", None, "a"),
    (7, "token: abcdef123456 first", "de", "b"),
    (7, "clean text of id seven", "de", "b"),
    (8, "x " + PASSAGE + " y", "fr", "b"),
    (None, PASSAGE.upper(), "fr", "b"),
    (9, None, None, None),
    (9, "", "en", ""),
    (10, " \t\n", "en", "c"),
    (11, LONG, "en", "c"),
    (12, LONG + " secret=abcdefgh99", "en", "c"),
    (13, "you idiot", "en", "c"),
    (None, None, None, None),
    (None, None, None, None),
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(*r, len(r[1] or ""), "mine", 1, 0, i % 2, None, 2, 3, 4, 5, 6) for i, r in enumerate(ROWS)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    yield df
    df.unpersist()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, PASSAGE), (2, None), (None, "a b")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def kept(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


@pytest.mark.parametrize("k", range(5))
def test_stage_of_an_empty_table(spark, table, folder, k):
    out = corpus_pipeline.STAGES[k][1](spark, table.limit(0), folder)
    assert out.count() == 0 and (k == 4 or out.columns == table.columns)


def test_toxicity_stage(spark, table, folder):
    out = corpus_pipeline.drop_toxic(spark, table, folder)
    assert out.columns == table.columns and kept(table) - kept(out) == Counter({(13, "you idiot"): 1})
    assert {(r["score"], r["predicted"]) for r in out.collect()} == {("mine", 0)}


def test_near_copies_stage(spark, table, folder):
    out = corpus_pipeline.drop_near_copies(spark, table, folder)
    gone = Counter({(1, ROWS[0][1]): 1, (None, ROWS[0][1]): 1, (12, ROWS[14][1]): 1, (None, ROWS[9][1]): 1})  # the last shares 8 of 10 shingles
    assert out.columns == table.columns and kept(table) - kept(out) == gone and not kept(out) - kept(table)
    # Reruns keep the same rows, the first by their further columns.
    again = corpus_pipeline.drop_near_copies(spark, table.repartition(5), folder)
    assert sorted(map(str, again.where("doc_id < 9").collect())) == sorted(map(str, out.where("doc_id < 9").collect()))


def test_decontamination_stage(spark, table, folder):
    out = corpus_pipeline.drop_contaminated(spark, table, folder)
    assert out.columns == table.columns and kept(table) - kept(out) == Counter({(8, ROWS[8][1]): 1, (None, ROWS[9][1]): 1})


def test_secrets_stage(spark, table, folder):
    out = corpus_pipeline.redact_secrets(spark, table, folder)
    mask = {4: "[REDACTED] without an id", 6: "[REDACTED] first", 14: LONG + " [REDACTED]"}
    assert out.columns == table.columns and kept(out) == Counter((r[0], mask.get(i, r[1])) for i, r in enumerate(ROWS))
    assert all(r["n_chars"] == len(r["text"] or "") and r["found"] == 1 for r in out.collect())


def test_mixing_stage(spark, table, folder):
    out = corpus_pipeline.mix(spark, table, folder).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in ROWS) and all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    assert sorted(r["size"] for r in out) == sorted(len((r[1] or "").split()) for r in ROWS)


def test_pipeline_as_a_whole(spark, table, folder):
    table.write.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r["doc_id"] for r in out) == Counter({1: 2, None: 4, 7: 2, 9: 2, 10: 1, 11: 1})


def test_operators_on_the_same_table(spark, table, folder):
    members, links = ngram_jaccard.jaccard_components(table)
    assert members.count() == len(ROWS) and sorted(map(tuple, links.collect())) == [(11, 12)]
    assert {r["n_shingles"] for r in members.where("doc_id = 9").collect()} == {0}
    found = secrets.scan_secrets(table).collect()
    assert len(found) == len(ROWS) and sum(r["n_assign"] for r in found) == 3
    assert [r["spans"] for r in found if r["doc_id"] == 12] == [f"assign:{len(LONG) + 1}:{len(LONG) + 18}"]
    marked, _ = decontaminate(table, spark.read.parquet(f"{folder}/benchmark.parquet"))
    words = lambda t: len([w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w])
    assert Counter((r["doc_id"], r["n_words"]) for r in marked.collect()) == Counter((r[0], words(r[1])) for r in ROWS)
    assert marked.where("contaminated").count() == 2
    rows = suffix_dedup.remove_repeats(table, keep=False).collect()
    size = {11: len(LONG), 12: len(LONG) + len(" secret=abcdefgh99")}
    assert len(rows) == len(ROWS) and {r["doc_id"]: r["n_bytes"] - r["n_removed"] for r in rows if r["doc_id"] in size} == {11: 0, 12: len("secret=abcdefgh99")}  # the blank before it stands within LONG as well
    tokens = token_counts.token_counts(table.where("text IS NULL OR length(text) < 100"), "/opt/tokenizers/byte_bpe_50k.tiktoken")
    assert tokens.count() == len(ROWS) - 2 and tokens.where("n_tokens = 0").count() == 4
    taken, _ = mixing.mix_sources(table)
    assert taken.count() == len(ROWS)
    scored = toxicity.toxicity(table, spark.read.parquet(f"{folder}/labels.parquet"))
    assert scored.count() == len(ROWS) and scored.where("predicted = 1").select("doc_id").collect() == [(13,)]


def test_equal_vectors_zero_vectors_and_clashing_names(spark):
    rows = [(i, [0.0, 0.0]) for i in range(60)] + [(100, [1.0, 2.0]), (100, [1.0, 2.0]), (150, [1.0, 2.0]), (151, None), (None, [1.0, 1.0]), (152, []), (200, [float("inf"), 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cell", "2 AS block", "3 AS q", "4 AS z", "5 AS home")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(d).collect()}
    five = 256**2 * 5
    assert [got[150, r] for r in range(1, 6)] == [(100, five), (100, five), (0, 0), (1, 0), (2, 0)]
    assert [got[0, r][0] for r in range(1, 6)] == [1, 2, 3, 4, 5] and [got[100, 1][0], got[100, 2][0]] == [150, 0]
    assert topk.top_k(spark.createDataFrame([(0, [0.0])], "vec_id long, embedding array<double>")).count() == 0


def test_pages_and_chats_with_nulls_repeats_and_long_texts(spark):
    page = (1, "http://h.org/a", "<html lang=en>" + "the cat and the dog " * 60_000)
    pages = spark.createDataFrame([page, page, (None, None, None), (2, "", "")], "page_id long, url string, html string").selectExpr("*", "1 AS s_all", "2 AS best", "3 AS host", "'x' AS lang")
    labelled = spark.createDataFrame([("the cat and the dog", "e'n"), ("le chat et le chien", "fr"), (None, None)], "text string, lang string")
    got = language_id.identify(pages, labelled).collect()
    assert Counter((r["page_id"], r["text_lang"]) for r in got) == Counter({(1, "e'n"): 2, (None, None): 1, (2, None): 1})
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", LONG + "</s>"), (1, 1, "assistant", LONG + "</s>"), (2, None, None, None), (None, 0, "assistant", "a")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted", "2 AS loss_from")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(chats)).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in got.items()} == {1: (3, 2 * len(LONG) + 8), 2: (1, 0), None: (1, 1)}


def test_whole_texts_decide(spark):
    """What differs only at the end of a very long text is found there."""
    texts = [LONG + " " + "tail one two", LONG + " " + "tail one three"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ngram_jaccard.jaccard_components(d, threshold=Fraction(1))[0].select("component_id").distinct().count()
    assert got == 2 and d.select(F.max(F.length("text"))).first()[0] > 2_000_000
