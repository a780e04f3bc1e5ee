"""Toxicity by weak supervision.

Many voters (fixed lexicons and patterns, and words and word beginnings that labelled training texts tie to toxicity)
each speak or are silent on a text. A generative label model with a binary latent label says how often each voter
speaks in either class, given whether the voter that it is most correlated with speaks: accuracies and correlations
are parameters, estimated by expectation maximisation over the vote patterns of all texts, anchored by the labelled ones.
It turns every pattern into a posterior. A logistic regression over words and word beginnings then learns the
posteriors of a sample of texts, labelled or not, whose own labels it never sees; it also scores texts on which no
voter speaks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from assaykit.lineage import cut
from assaykit.llm.common import small_batches, trimmed
from assaykit.llm.wordhash import string_buffer, words, words_and_prefixes

_U = np.uint64
# Common insults, vulgarities and threats, one lexicon voter for each line (English, German, French, Spanish).
LEXICONS = (
    "idiot moron imbecile dimwit fool stupid dumb brainless",
    "loser pathetic worthless useless failure nobody",
    "scum trash garbage filth vermin parasite",
    "disgusting vile repulsive revolting gross nasty",
    "clown joke laughingstock buffoon",
    "hate despise loathe detest",
    "kill die murder hang strangle",
    "bitch bastard asshole whore slut",
    "fuck fucking shit crap damn",
    "ugly fat freak creep pig",
    "idiot dummkopf trottel vollidiot arschloch abschaum widerlich erbärmlich wertlos versager",
    "idiot imbécile crétin abruti connard ordure dégoûtant pathétique minable raté",
    "idiota imbécil estúpido cretino basura asqueroso patético inútil fracasado gilipollas",
)
#: Pattern voters, on the lower-cased text: an insult after an address, two curt commands, rows of exclamation marks.
PATTERNS = (r"\byou(?:'re| are)? (?:an? )?(?:\w+ )?(?:idiot|moron|loser|clown|fool|joke|disgrace)", r"\bshut up\b", r"\bgo (?:to hell|die|away)\b", r"!{3,}")
#: Word separators: everything in ASCII but letters and digits.
SEPARATORS = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])
#: Bytes of the word beginnings that are features beside whole words; they catch inflected and compound forms.
BEGINNINGS = (4, 5, 6, 7)
_FIXED = len(LEXICONS) + len(PATTERNS)
#: Learnt words of toxic texts in tiers, the most telling ones first, and numbers of a tier's words from which voters speak.
TIERS, STEPS = (20, 60, 150), (1, 3)
#: One of so many labelled rows tells the voters' accuracies; their words come from the others.
JUDGED = 4
_TABLE_BITS = 22


class Vocabulary:
    """Exact lookup of feature hashes behind a bit table of fixed size."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[(self.hashes & _U((1 << _TABLE_BITS) - 1)).astype(np.int64)] = True

    def find(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``text, feature``: the distinct features of each text, by place in ``hashes``, over whole texts."""
        hashes, numbers, first = words_and_prefixes(*string_buffer(column), SEPARATORS, BEGINNINGS)
        text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        found = []
        for h, n in zip(hashes, numbers):
            near = np.flatnonzero(self.table[(h & _U((1 << _TABLE_BITS) - 1)).astype(np.int64)])
            at = np.searchsorted(self.hashes, h[near])
            hit = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == h[near]) if len(self.hashes) else at[:0]
            found.append(text_of[n[near[hit]]] * len(self.hashes) + at[hit])
        both = np.unique(np.concatenate(found))
        return both // max(1, len(self.hashes)), both % max(1, len(self.hashes))


@dataclass(frozen=True)
class Model:
    """The linear classifier: feature hashes (sorted), their weights, and the bias."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether ``crc32(doc_id as text) mod folds`` is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _training(docs: DataFrame, labels: DataFrame, folds: int, sample: int) -> DataFrame:
    """``text, y, judged`` of at most ``sample`` labelled rows outside the held-out fold; conflicting labels: their majority.

    Of rows that repeat an id, one counts.
    """
    y = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"), folds)).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    y = y.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    return _once(docs.select("doc_id", "text").join(F.broadcast(y), "doc_id"), "y").select("text", "y", (F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 9, 4), 16, 10) % JUDGED == 0).alias("judged"))


def _once(rows: DataFrame, *more: str) -> DataFrame:
    return rows.groupBy("doc_id", *more).agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x")).select("doc_id", *more, "x.text")


def _pupils(docs: DataFrame, folds: int, sample: int) -> DataFrame:
    """``text`` of at most ``sample`` rows outside the held-out fold, labelled or not, smallest by ``md5(doc_id)``."""
    ids = docs.where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id"), folds)).select("doc_id")
    ids = ids.withColumn("place", F.md5(F.col("doc_id").cast("string"))).groupBy("place", "doc_id").agg(F.count(F.lit(1)).alias("n")).orderBy("place", "doc_id").limit(sample)
    return _once(docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id")), "doc_id")).select("text")


def _associations(train: DataFrame, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features by how strongly training labels tie them to a class: hashes, log-odds and strengths, at most ``2 * most``.

    Counted in Spark over all training rows; only the strongest features of either class reach the driver.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                y = np.array(part.column(1).to_pylist(), np.int64)
                hashes, numbers, first = words_and_prefixes(*string_buffer(_lowered(part.column(0))), SEPARATORS, BEGINNINGS)
                text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
                h, text = np.concatenate(hashes), np.concatenate([text_of[n] for n in numbers])
                order = np.lexsort((text, h))
                h, text = h[order], text[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                h, text = h[new], text[new]
                u, start = np.unique(h, return_index=True)
                n = np.diff(np.append(start, len(h)))
                t = np.add.reduceat(y[text], start) if len(h) else n
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(t), pa.array(n - t)], ["h", "t", "c"])

    totals = train.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    n_t, n_c = totals["t"], totals["n"] - totals["t"]
    if not n_t or not n_c:
        return np.zeros(0, _U), np.zeros(0), np.zeros(0)
    counts = train.mapInArrow(trimmed(kernel), "h long, t long, c long").groupBy("h").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(F.col("t") + F.col("c") >= least)
    odds = F.log((F.col("t") + 0.5) / (n_t + 1.0)) - F.log((F.col("c") + 0.5) / (n_c + 1.0))
    counts = cut(counts.withColumn("odds", odds).withColumn("z", F.col("odds") * F.sqrt(F.when(F.col("odds") > 0, F.col("t")).otherwise(F.col("c") * F.lit(n_t / n_c)))))
    rows = counts.where("odds > 0").orderBy(F.desc("z"), "h").limit(most).union(counts.where("odds < 0").orderBy("z", "h").limit(most)).select("h", "odds", "z").collect()
    return np.array([r["h"] for r in rows], np.int64).view(_U), np.array([r["odds"] for r in rows]), np.array([r["z"] for r in rows])


class _Voters:
    """Fixed and learnt voters; a text's votes as the bits of one number."""

    def __init__(self, hashes: np.ndarray, odds: np.ndarray, z: np.ndarray, tiers: tuple[int, ...] = TIERS):
        toxic = [h for _, h in sorted((-s, int(h)) for h, o, s in zip(hashes, odds, z) if o > 2.0)]
        lexicon = [(int(h), i) for i, line in enumerate(LEXICONS) for h in words(*string_buffer(pa.array(line.split(), pa.large_string())), SEPARATORS)[0]]
        self.vocabulary = Vocabulary(np.array([*toxic[: tiers[-1]], *(h for h, _ in lexicon)], _U))
        where = {int(h): i for i, h in enumerate(self.vocabulary.hashes)}
        self.lexicon = np.full(len(where), -1)
        for h, i in lexicon:
            self.lexicon[where[h]] = i
        self.tiers = np.zeros((len(tiers), len(where)))
        for k, (a, b) in enumerate(zip((0, *tiers), tiers)):
            self.tiers[k, [where[h] for h in toxic[a:b]]] = 1

    def votes(self, column: pa.Array) -> np.ndarray:
        column = _lowered(column)
        n = len(column)
        text, feature = self.vocabulary.find(column)
        out = np.zeros(n, np.int64)
        for i in range(len(LEXICONS)):
            out[np.unique(text[self.lexicon[feature] == i])] |= 1 << i
        for i, p in enumerate(PATTERNS):
            out[pc.match_substring_regex(column, p).to_numpy(zero_copy_only=False)] |= 1 << (len(LEXICONS) + i)
        for k, tier in enumerate(self.tiers):
            said = np.bincount(text, weights=tier[feature], minlength=n)
            for i, least in enumerate(STEPS):
                out |= (said >= least).astype(np.int64) << (_FIXED + k * len(STEPS) + i)
        return out

    @staticmethod
    def matrix(votes: np.ndarray) -> np.ndarray:
        """One column for each fixed voter, and for "at least one, three learnt words" of each tier."""
        return (votes[:, None] >> np.arange(_FIXED + len(TIERS) * len(STEPS))) & 1


@dataclass(frozen=True)
class LabelModel:
    """``rates[y, v, i]``: how often voter ``i`` speaks in class ``y`` when its parent says ``v``; the root's parent is silent."""

    parent: np.ndarray
    rates: np.ndarray
    share: float

    def posterior(self, matrix: np.ndarray) -> np.ndarray:
        """The chance of class 1 for each row of votes."""
        said = np.where(self.parent >= 0, matrix[:, self.parent], 0)
        p = self.rates[:, said, np.arange(matrix.shape[1])]
        ll = np.where(matrix == 1, np.log(p), np.log(1 - p)).sum(axis=2)
        return _sigmoid(np.log(self.share / (1 - self.share)) + ll[1] - ll[0])


def _tables(matrix: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``[u, v, i, j]``: the weight of rows in which voter ``i`` says ``u`` and voter ``j`` says ``v``."""
    sides = (1 - matrix, matrix)
    return np.array([[(x * weight[:, None]).T @ y for y in sides] for x in sides])


def _dependences(tables: np.ndarray) -> np.ndarray:
    """Conditional mutual information of every two voters given the class, from ``tables[y]``."""
    out = np.zeros(tables.shape[-2:])
    for t in tables:
        own, other = t.sum(axis=1, keepdims=True), t.sum(axis=0, keepdims=True)
        out += (t * np.log(np.maximum(t * t.sum(axis=(0, 1)), 1e-300) / np.maximum(own * other, 1e-300))).sum(axis=(0, 1))
    return out


def _tree(strength: np.ndarray) -> np.ndarray:
    """The parent of each voter in the spanning tree of greatest strength, from voter 0 on; -1 for the root."""
    m = len(strength)
    parent = np.full(m, -1)
    best, by = strength[0].copy(), np.zeros(m, np.int64)
    open_ = np.arange(m) > 0
    while open_.any():
        i = int(np.argmax(np.where(open_, best, -np.inf)))
        parent[i], open_[i] = by[i], False
        near = open_ & (strength[i] > best)
        best[near], by[near] = strength[i][near], i
    return parent


def _estimate(tables: np.ndarray) -> LabelModel:
    """The model that ``tables[y]``, of weight 1 in all, make most likely; rates lean a little towards the voter's own."""
    mass = tables[:, :, :, 0, 0].sum(axis=(1, 2))
    parent, m = _tree(_dependences(tables)), tables.shape[-1]
    i = np.arange(m)
    speaks = tables[:, 1, :, i, i].sum(axis=2).T  # [y, i]
    overall = np.clip(speaks.sum(axis=0), 1e-6, 1 - 1e-6)
    rates = np.empty((2, 2, m))
    for v in (0, 1):
        joint = np.array([t[1, v, i, np.maximum(parent, 0)] for t in tables])
        seen = np.array([t[:, v, i, np.maximum(parent, 0)].sum(axis=0) for t in tables])
        lean = 1e-3 * mass[:, None]
        own = (speaks + lean * overall) / (mass[:, None] + lean)
        rates[:, v] = np.where(parent >= 0, (joint + lean * own) / (seen + lean), own)
    return LabelModel(parent, np.clip(rates, 1e-6, 1 - 1e-6), float(np.clip(mass[1] / mass.sum(), 1e-4, 1 - 1e-4)))


def label_model(matrix: np.ndarray, counts: np.ndarray, told: np.ndarray, y: np.ndarray, rounds: int = 60) -> LabelModel:
    """Accuracies and correlations of voters by expectation maximisation.

    ``matrix`` holds the distinct vote patterns, ``counts`` how many texts show each; ``told`` the votes on labelled texts
    and ``y`` their labels. Either side has half the say at every size, and the share of classes is that of all texts.
    """
    labelled = np.array([_tables(told, (y == k) / len(y)) for k in (0, 1)])
    model, before = _estimate(labelled), None
    for _ in range(rounds):
        post = model.posterior(matrix)
        if before is not None and np.abs(post - before).max() < 1e-6:
            break
        before = post
        share = float(np.clip((counts * post).sum() / counts.sum(), 1e-4, 1 - 1e-4))
        found = np.array([_tables(matrix, counts * p / counts.sum()) for p in (1 - post, post)])
        scale = np.array([1 - share, share]) / np.maximum([(y == 0).mean(), (y == 1).mean()], 1e-9)
        model = _estimate((found + labelled * scale[:, None, None, None, None]) / 2)
    return model


def _logistic(text: np.ndarray, feature: np.ndarray, n: int, size: int, target: np.ndarray, rounds: int = 600, rate: float = 0.05, ridge: float = 2e-5) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the cross entropy with soft targets over distinct-feature indicators."""
    share = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    w = np.zeros(size + 1)
    w[size] = np.log(share / (1 - share))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        e = (_sigmoid(np.bincount(text, weights=w[feature], minlength=n) + w[size]) - target) / n
        g = np.append(np.bincount(feature, weights=e[text], minlength=size) + ridge * w[:size], e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:size], float(w[size])


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = 8_000, features: int = 2_000, least: int = 6) -> Model:
    """Fit voters, label model and classifier on ``docs (doc_id, text)`` and ``labels (doc_id, toxic)``.

    Bounds, the same at every input size: ``sample`` for the labelled rows that make voters and start the label model, and
    again for the texts that the classifier learns (both those smallest by ``md5(doc_id)`` outside the held-out
    fold); ``TIERS`` for learnt words, ``features`` for the classifier's words of either class, those most strongly
    tied to it, in at least ``least`` texts. The label model's parameters rest on the vote patterns of *all*
    texts, counted in Spark; in practice there are a few thousand patterns. Where training rows lack one of the
    classes (or there are none), the fixed lexicons alone decide.
    """
    train = cut(_training(docs, labels, folds, sample))
    hashes, odds, z = _associations(train.where("NOT judged").select("text", "y"), least, features)
    judge = _Voters(hashes, odds, z)
    if not len(hashes):
        h = judge.vocabulary.hashes
        return Model(h, np.full(len(h), 4.0), -2.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for v, n in zip(*(x.tolist() for x in np.unique(judge.votes(batch.column(0).slice(at, 512)), return_counts=True))):
                    seen[v] = seen.get(v, 0) + n
        yield pa.RecordBatch.from_pydict({"v": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

    table = docs.select("text").mapInArrow(trimmed(count), "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).collect()
    table.sort(key=lambda r: r["v"])
    vocabulary = Vocabulary(hashes)

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                column = batch.column(0).slice(at, 512)
                text, feature = vocabulary.find(_lowered(column))
                parts = np.split(feature.astype(np.int32), np.searchsorted(text, np.arange(1, len(column))))
                yield pa.RecordBatch.from_arrays([pa.array(judge.votes(column)), pa.array(parts, pa.list_(pa.int32()))], ["v", "f"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, 512), pa.array(judge.votes(batch.column(0).slice(at, 512)))], ["y", "v"])

    known = train.where("judged").select("text", "y").mapInArrow(told, "y int, v long").collect()
    if len({r["y"] for r in known}) < 2:  # too few labels to judge by
        known = train.select("text", "y").mapInArrow(told, "y int, v long").collect()
    matrix = lambda rows: judge.matrix(np.array([r["v"] for r in rows], np.int64))
    model = label_model(matrix(table), np.array([r["n"] for r in table], float), matrix(known), np.array([r["y"] for r in known]))
    rows = _pupils(docs, folds, sample).mapInArrow(show, "v long, f array<int>").toArrow()
    lists = rows.column(1).combine_chunks()
    text = np.repeat(np.arange(len(lists)), np.array(pc.list_value_length(lists).to_pylist(), np.int64))
    feature = np.array(pc.list_flatten(lists).to_numpy(zero_copy_only=False), np.int64)
    target = model.posterior(judge.matrix(np.array(rows.column(0).to_pylist(), np.int64)))
    weights, bias = _logistic(text, feature, len(lists), len(vocabulary.hashes), target)
    return Model(vocabulary.hashes, weights, bias)


def score_toxicity(docs: DataFrame, model: Model, folds: int = 5, names: tuple[str, str, str] = ("held_out", "score", "predicted")) -> DataFrame:
    """``docs`` with the fold, the score and the prediction appended as ``names`` (replaced, where so named).

    Only ``text`` enters the score, whole; ``doc_id`` tells the fold. Null, empty and word-free texts get the score
    of a text without features. One row per input row, in any order; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.hashes, model.weights, model.bias))
    fields = [f for f in docs.schema.fields if f.name.lower() not in names]
    kept = [f.name for f in fields]
    where = kept.index("text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weights, bias = shared.value
        vocabulary = Vocabulary(hashes)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                text, feature = vocabulary.find(_lowered(part.column(where)))
                score = _sigmoid(np.bincount(text, weights=weights[feature] if len(weights) else None, minlength=part.num_rows) + bias)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*kept, names[1]])

    scored = docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(trimmed(kernel), StructType([*fields, StructField(names[1], DoubleType())]))
    return scored.withColumn(names[0], held_out(F.col("doc_id"), folds)).withColumn(names[2], (F.col(names[1]) >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, names: tuple[str, str, str] = ("held_out", "score", "predicted")) -> DataFrame:
    """Fit on ``docs``, part of them labelled, and score all of them."""
    with small_batches(docs.sparkSession):
        model = fit_toxicity(docs, labels, folds)
    return score_toxicity(docs, model, folds, names)
