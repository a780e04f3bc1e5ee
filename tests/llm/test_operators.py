"""Corpus operators against brute force, round trips and defined edge cases."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from assaykit.llm import chat, language_id, mixing, ngram_jaccard, secrets, suffix_dedup, token_counts, topk, toxicity, wordhash
from assaykit.llm.decontaminate import decontaminate

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RND = random.Random(11)


def say(n, letters="abcdeé"):
    return " ".join("".join(RND.choice(letters) for _ in range(RND.randint(2, 7))) for _ in range(n))


def docs(spark, texts, ids=None, extra=False):
    ids = ids or list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'x' AS n", "1 AS t", "'s' AS source", "2 AS rep", "3 AS row", "4 AS size") if extra else df


EDGES = [None, "", " \t\n", "one", "One two", "a b c", "A b\tc", "ü Ü"]


# Words


def test_words_at_piece_and_text_edges(monkeypatch):
    monkeypatch.setattr(wordhash, "PIECE", 16)
    texts = ["ab  cd", "", "efgh" * 20 + " ij", " ", None, "kl", "mn\x0bop"]
    h, first = wordhash.words(*wordhash.string_buffer(pa.array(texts)))
    want = [w for t in texts for w in (t or "").split()]
    assert np.diff(first).tolist() == [len((t or "").split()) for t in texts]
    one, _ = wordhash.words(*wordhash.string_buffer(pa.array(want)))
    assert h.tolist() == one.tolist() and len(set(h.tolist())) == len(want)
    up, _ = wordhash.words(*wordhash.string_buffer(pa.array([w.upper() for w in want])))
    assert up.tolist() == h.tolist()


# 1


def brute_components(texts, n, t):
    sets = {}
    for i, x in texts:
        w = (x or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and both >= t * len(sets[a] | sets[b]):
                lo, hi = sorted((comp[a], comp[b]))
                comp = {k: lo if v == hi else v for k, v in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize(("n", "t"), [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_jaccard_components(spark, n, t):
    texts = list(EDGES)
    for size in (12, 40, 90, 300):
        base = say(size).split()
        for k in range(8):
            w = list(base)
            for _ in range(k):
                w[RND.randrange(size)] = "zz" + str(RND.randrange(99))
            texts.append(" ".join(w + [f"e{j}" for j in range(RND.randrange(3))]))
    texts += [texts[-1], texts[-1].upper(), say(60) + " " + texts[10], say(60) + " " + texts[10]]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(docs(spark, texts, extra=True), n, t)[0].collect()}
    assert got == brute_components(list(enumerate(texts)), n, t)


@pytest.mark.parametrize(("n", "t"), [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_jaccard_links_within_components(spark, n, t):
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    texts = list(EDGES)
    for size in (60, 300):
        base = [word() for _ in range(size)]
        for k in range(14):
            w = list(base)
            for _ in range(k % 4):
                w[rnd.randrange(size)] = word()
            texts.append(" ".join(w))
    texts += [texts[9], texts[9].upper(), texts[-1]]
    sets = []
    for x in texts:
        w = (x or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset({tuple(w)} if w else ()))
    near = lambda a, b: bool(a & b) and len(a & b) >= t * len(a | b)
    rep = {s: i for i, s in reversed(list(enumerate(sets)))}
    want = {(a, b) for x, a in rep.items() for y, b in rep.items() if a < b and near(x, y)}
    members, links = ngram_jaccard.jaccard_components(docs(spark, texts, extra=True), n, t)
    got = [tuple(sorted(r)) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r["doc_id"]: r["n_links"] for r in members.collect()} == {i: sum(near(s, o) for j, o in enumerate(sets) if j != i) for i, s in enumerate(sets)}
    components = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(docs(spark, texts), n, t, every=False)[0].collect()}
    assert components == brute_components(list(enumerate(texts)), n, t)
    lone = {(r["doc_id"], r["n_links"]) for r in ngram_jaccard.jaccard_components(docs(spark, ["a b c d", "a b c d", "a b c d", "x y", None], [5, 6, None, None, 7]))[0].collect()}
    assert lone == {(5, 1), (6, 1), (None, 2), (None, None), (7, 0)}


def test_jaccard_rows_without_or_with_repeated_ids(spark):
    d = docs(spark, ["a b c d", "a b c d", "a b c d", "x y z", None], [5, 5, None, None, 7])
    got = sorted([(str(r["doc_id"]), r["component_id"]) for r in ngram_jaccard.jaccard_components(d)[0].collect()], key=str)
    assert got == [("5", 5), ("5", 5), ("7", 7), ("None", 5), ("None", None)]
    members, links = ngram_jaccard.jaccard_components(d.limit(0))
    assert members.count() == links.count() == 0


# 2


def brute_secrets(text):
    text, found = text or "", []
    for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[1]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    for o, kind, p, least in ((1, "access", "AKIA[A-Z0-9]+", 20), (2, "hex", "[0-9a-f]+", 24)):
        found += [(m.start(), o, kind, m.end()) for m in re.finditer(p, text) if len(m[0]) >= least]
    base, more = sorted(found), []
    for o, c in enumerate(secrets.CLASSES):
        for m in re.finditer(c.pattern, text):
            if not re.search(c.must, m[0]) or any(re.search(a, m[0]) for a in secrets.ALLOW):
                continue
            runs = []
            for i in range(len(m[0]) - c.window + 1):
                if -sum(v / c.window * math.log2(v / c.window) for v in Counter(m[0][i : i + c.window]).values()) >= c.bits - 1e-12:
                    if runs and i <= runs[-1][1]:
                        runs[-1][1] = i + c.window
                    else:
                        runs.append([i, i + c.window])
            more += [(m.start() + a, 3 + o, c.kind, m.start() + b) for a, b in runs]
    kept = list(base)
    for x in sorted(more):
        if not any(y[0] < x[3] and x[0] < y[3] for y in kept):
            kept.append(x)
    said = lambda z: ",".join(f"{k}:{s}:{e}" for s, _, k, e in z)
    return (*(sum(y[1] == o for y in base) for o in range(3)), hashlib.sha256(said(base).encode()).hexdigest(), said(sorted(kept)))


def test_secrets(spark):
    pick = lambda letters, n: "".join(RND.choice(letters) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = [*EDGES, "secret=token : abcdefgh", "é Secret:abcdef; PASSWORD\": \"x=y/z1\" token=abc", "AKIA" + pick("ABC123", 16) + " AKIAAKIAX", "ü " + pick("0123456789abcdef", 24) + " " + pick("0123456789abcdef", 23)]
    texts += ["x " + pick(b64, 40) + " y " + pick("0123456789ABCDEF", 40), "a" * 90 + pick(b64, 30) + "b" * 60 + pick(b64, 28) + "1", "123e4567-e89b-12d3-a456-426614174000", "abcdefghijklmnopqrstuvwxyz0123456789ABC", "token=" + pick(b64, 40) + " " + pick(b64, 50) + "." + pick(b64, 30)]
    d = docs(spark, texts + texts, list(range(len(texts))) * 2, extra=True)
    got = sorted((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) for r in secrets.scan_secrets(d).collect())
    assert got == sorted([(i, *brute_secrets(t)) for i, t in enumerate(texts)] * 2)
    red = {r["doc_id"]: r["text"] for r in secrets.redact(docs(spark, texts)).collect()}
    assert red[8] == texts[8] and red[9] == 'é [REDACTED]; [REDACTED]" token=abc' and red[0] is None
    assert secrets.scan_secrets(d.limit(0)).count() == 0


def test_secrets_beside_fixed_shapes(spark):
    rnd = random.Random(4)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "aZ7" + "".join(rnd.sample(b64, n - 3))
    fixed = lambda: "AKIA" + "".join(rnd.sample("ABCDEFGHJKLMNPQR", 16))
    lower = "".join(rnd.sample("0123456789abcdef", 12) + rnd.sample("0123456789abcdef", 12))
    texts = [f"é {fixed()}{c}{key(40)} z" for c in "/=-_"] + [f"é {key(40)}_{fixed()}", f"{key(30)}/{lower}/{key(30)}", f"password={key(20)}.{key(40)}", "0123ABCDE9F876" + "D5A1C2B3E4F6" + "/" + key(40), "plain", None]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(docs(spark, texts)).collect()}

    def spans(i):
        named = [tuple(map(int, x.split(":")[1:])) for x in got[i]["spans"].split(",") if x]
        return named, [tuple(map(int, x.split(":"))) for x in got[i]["parts"].split(",") if x]

    def entropy(t):
        for c in secrets.CLASSES:
            for m in re.finditer(c.pattern, t):
                if re.search(c.must, m[0]) and not any(re.search(a, m[0]) for a in secrets.ALLOW):
                    for i in range(len(m[0]) - c.window + 1):
                        if -sum(v / c.window * math.log2(v / c.window) for v in Counter(m[0][i : i + c.window]).values()) >= c.bits - 1e-12:
                            yield from range(m.start() + i, m.start() + i + c.window)

    for i, t in enumerate(texts):
        named, parts = spans(i)
        inside = {k for a, b in named for k in range(a, b)}
        assert [k for a, b in parts for k in range(a, b)] == sorted(set(entropy(t or "")) - inside)
        assert all(b < c for (_, b), (c, _) in zip(parts, parts[1:]))
    assert all(got[i]["n_access"] == 1 and spans(i)[1] for i in range(5)) and spans(8) == ([], [])
    red = {r["doc_id"]: r["text"] for r in secrets.redact(docs(spark, texts)).collect()}
    assert all(not re.search(r"[A-Za-z0-9]{12}", re.sub("REDACTED", "", red[i])) for i in range(6)) and red[8] == "plain"


def test_redact_rows_without_or_with_repeated_ids(spark):
    texts = ["password=abcdef1 x", "long clean text of another row", "yyyy token: zzzzzz9", None, "", "password=abcdef1 x", "clean", "secret=qqqqqqq and"]
    want = ["[REDACTED] x", texts[1], "yyyy [REDACTED]", None, "", "[REDACTED] x", "clean", "[REDACTED] and"]
    d = spark.createDataFrame([(None if i < 6 else 7, t, i, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, found int, n_chars long")
    got = sorted((r["found"], r["text"], r["n_chars"]) for r in secrets.redact(d).collect())
    assert got == [(i, t, len(t or "")) for i, t in enumerate(want)]


# 3


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(2_300, 8)).round(1)
    v[100:900] = v[50]
    rows = [(i, [float(x) for x in e]) for i, e in enumerate(v)] + [(9000, None), (9050, [1.0, None] + [0.0] * 6), (9100, [float("nan")] * 8), (None, [1.0] * 8), (9150, [2.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cell", "2 AS q_part")
    z = {i: [math.floor(256 * x) for x in e] + [0] * (8 - len(e)) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    m, ids = np.array(list(z.values())), np.array(list(z))
    want = set()
    for q in (i for i in z if i % 50 == 0):
        s = m @ np.array(z[q])
        order = sorted((int(-a), int(b)) for a, b in zip(s, ids) if b != q)[:5]
        want |= {(q, r + 1, b, -a) for r, (a, b) in enumerate(order)}
    got = [tuple(r) for r in topk.top_k(d, block=256).collect()]
    assert set(got) == want and len(got) == len(want)
    assert topk.top_k(d.limit(0)).count() == 0
    assert topk._scores(np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 1.0]])).tolist() == [[2**60 + 1]]


def test_top_k_sends_only_what_blocks_can_use(spark):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(20, 16))
    v = np.concatenate([c + 0.05 * rng.normal(size=(200, 16)) for c in centre])
    d = spark.createDataFrame([(i, [float(x) for x in e]) for i, e in enumerate(v)], "vec_id long, embedding array<double>")
    answers, sent = topk._top_k(d, 5, 50, 256, topk.PIVOTS, 8)
    blocks = sent.select("block").distinct().count()
    assert blocks >= 8 and sent.count() < 0.5 * blocks * len(v)
    z = np.floor(256 * v).astype(np.int64)
    got = {}
    for r in answers.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert len(got) == 80
    for q, found in got.items():
        s = z @ z[q]
        want = sorted((-int(x), i) for i, x in enumerate(s) if i != q)[:5]
        assert sorted(found) == [(r + 1, i, -x) for r, (x, i) in enumerate(want)]


# 4


def test_token_counts(spark, tmp_path):
    texts = [*EDGES, say(900), "x" * 5000, "<|endoftext|>"]
    d = docs(spark, texts, extra=True)
    encoder = token_counts._encoder(VOCABULARY, token_counts.PATTERN)
    want = sorted((i, len(encoder.encode_ordinary(t or ""))) for i, t in enumerate(texts))
    for block in (7, 512):
        assert sorted(map(tuple, token_counts.token_counts(d, VOCABULARY, block).collect())) == want
    assert token_counts.token_counts(d.limit(0), VOCABULARY).count() == 0
    ids = np.array([1, 2, 50256, 50256, 3, 50256, 4], "<u2")
    ids.tofile(tmp_path / "a.bin")
    for block in (1, 2, 100):
        got = sorted((r["place"], r["n_tokens"]) for r in token_counts.separator_scan(token_counts.read_flat_files(spark, str(tmp_path), block)).collect())
        assert got == [(0, 2), (1, 0), (2, 1)]


# 5


def brute_windows(texts, items, window=10):
    split = lambda t: [x for x in re.split(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower()) if x]
    windows = {}
    for i, t in items:
        w = split(t)
        for a in range(max(1, len(w) - window + 1)) if w and i is not None else ():
            windows.setdefault(tuple(w[a : a + window]), set()).add(str(i))
    out = []
    for i, t in texts:
        w, hit, names = split(t), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                if found := windows.get(tuple(w[a : a + size])):
                    hit |= set(range(a, a + size))
                    names |= found
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark):
    long_, tens = say(60), " ".join(f"w{i}" for i in range(10))
    items = [(1, long_), (2, tens), (2, tens), (10, "the end"), (None, "a b"), (4, None), (5, "a b c d e f g"), (6, "b c d e f g a b c d e f"), (7, long_[: len(long_) // 2])]
    texts = [*EDGES, "x The END y the end", long_.upper(), say(30) + " " + " ".join(long_.split()[20:31]) + " " + say(3), tens.replace("w3", "q"), "0 " + tens + " 1", "a b c d e f g a b c d e f g h", say(40)]
    d, b = docs(spark, texts + texts[:12], list(range(len(texts))) + [None] * 12, extra=True), spark.createDataFrame(items, "item_id long, text string")
    marked, spans = decontaminate(d, b)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(map(tuple, marked.collect()), key=key) == sorted(brute_windows(list(enumerate(texts)) + [(None, t) for t in texts[:12]], items), key=key)
    assert spans.where("doc_id = 12 AND item_id = '2'").select("first", "last").collect() == [(2, 11)]
    assert decontaminate(d, b.limit(0))[0].where("contaminated").count() == 0 and decontaminate(d.limit(0), b)[0].count() == 0


# 6


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        yield len(r), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(r) else 0)), hashlib.sha256(bytes(b for b, x in zip(r, gone) if not x)).hexdigest()


def test_suffix_dedup(spark):
    rnd = random.Random(3)
    w = lambda n: " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(n))
    passages = [w(100) for _ in range(3)]
    texts = [*EDGES, "x" * 1000, "x" * 399, "ab" * 900, w(200)]
    texts += [w(rnd.randint(0, 60)) + rnd.choice(passages)[rnd.randint(0, 60) :] + w(rnd.randint(0, 40)) + rnd.choice(["", passages[0][:430]]) for _ in range(30)]
    base = w(300)
    for _ in range(16):
        q = base.split()
        q[rnd.randrange(300)] = "zz"
        texts.append(" ".join(q))
    texts += [texts[13], texts[13], passages[1] + passages[1]]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs(spark, texts, extra=True)).collect())
    assert got == [(i, *x) for i, x in enumerate(brute_repeats(texts, 400))]


@pytest.mark.parametrize("piece", [50, 1_000, 3_001])
def test_suffix_dedup_anchors_once_across_pieces(monkeypatch, piece):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abcd ") for _ in range(n)) for n in (9_000, 400, 399, 2_500, 0)] + ["x" * 1500]
    texts += texts[:1]
    buffer = suffix_dedup.string_buffer(pa.array(texts))
    anchors = lambda: [x for part in suffix_dedup._anchors(*buffer, 400) for x in zip(*(c.tolist() for c in part))]
    whole = anchors()
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    got = anchors()
    assert len(set(got)) == len(got) and got == whole


def test_suffix_dedup_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LOCAL", 12)
    rnd = random.Random(6)
    w = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(n))
    passage = w(110)
    texts = [w(rnd.randint(0, 30)) + passage[: rnd.randint(380, 460)] + rnd.choice(["x", "xy", "z", ""]) + w(rnd.randint(0, 30)) for _ in range(36)]
    texts += [passage[70:] + w(9), texts[3]]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs(spark, texts, extra=True)).collect())
    assert got == [(i, *x) for i, x in enumerate(brute_repeats(texts, 400))]


@pytest.mark.parametrize("hashes", ["good", "pairs of letters collide", "all collide"])
def test_suffix_sort_and_extents(monkeypatch, hashes):
    values = suffix_dedup._VALUE.copy()
    if hashes == "pairs of letters collide":
        values[ord("b")] = values[ord("a")]
    if hashes == "all collide":
        values[:] = 0
    monkeypatch.setattr(suffix_dedup, "_VALUE", values)
    rnd = random.Random(5)
    strings, first = [], [0]
    for size in (2, 1, 2, 9, 40, 3, 2, 150):
        base = "".join(rnd.choice("ab") for _ in range(30))
        group = {(base[: rnd.randrange(20, 30)] + "".join(rnd.choice("abc") for _ in range(rnd.randrange(6)))).encode() for _ in range(size)}
        strings += sorted(group, key=lambda x: rnd.random())
        first.append(len(strings))
    first = np.array(first)
    order, near = suffix_dedup.suffix_sort(suffix_dedup._Side(strings), first)
    agree = lambda x, y: next((k for k, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
    for a, b in zip(first[:-1], first[1:]):
        assert [strings[i] for i in order[a:b]] == sorted(strings[a:b])
        assert near[a : b - 1].tolist() == [agree(strings[i], strings[j]) for i, j in zip(order[a:b], order[a + 1 : b])]
    lefts = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(9))).encode() for _ in strings]
    alone = np.array([rnd.random() < 0.7 for _ in strings])
    left, right = suffix_dedup.extents(lefts, strings, first, alone, 26)
    for a, b in zip(first[:-1], first[1:]):
        for i in range(a, b):
            far = [(agree(lefts[i], lefts[j]), agree(strings[i], strings[j])) for j in range(a, b) if j != i]
            far = [x for x in far if sum(x) >= 26 and alone[i]]
            assert (left[i], right[i]) == (max((x for x, _ in far), default=0), max((y for _, y in far), default=0))


def test_suffix_dedup_beyond_one_piece(spark):
    rnd = random.Random(9)
    w = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(9)) for _ in range(n))
    passage, one = w(60), [w(120_000), w(40_000), w(90_000)]
    texts = [one[0] + "-" + passage + "-" + one[1], one[2] + "+" + passage + "+"]
    assert len(texts[0]) > suffix_dedup.PIECE
    got = sorted((r["doc_id"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs(spark, texts)).collect())
    assert got == [(i, len(passage), 1, hashlib.sha256(t.replace(passage, "").encode()).hexdigest()) for i, t in enumerate(texts)]


def test_suffix_dedup_of_nothing(spark):
    assert suffix_dedup.remove_repeats(docs(spark, ["a"]).limit(0)).count() == 0


# 7


def test_mixing(spark):
    rows = [(i, say(RND.randrange(1, 60)) if i % 7 else None, s) for i, s in enumerate(["b"] * 40 + ["a"] * 3 + [None] * 20 + ["c"] * 9 + ["é"])]
    d = spark.createDataFrame([*rows, rows[1]], "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS at", "3 AS n")
    taken, slots = mixing.mix_sources(d, block=16)
    got = [tuple(r) for r in taken.select("doc_id", "source", "size", "source_size", "target", "taken").collect()]
    assert len(got) == len(rows) + 1 and sorted(got, key=str) == sorted(map(tuple, mixing.mix_sources(d, block=16)[0].select("doc_id", "source", "size", "source_size", "target", "taken").collect()), key=str)
    total = sum(r[2] for r in got)
    by = {}
    for r in got:
        assert 0 <= r[5] <= 3 * r[2]
        by.setdefault(r[1], []).append(r)
    assert sum(v[0][4] for v in by.values()) == pytest.approx(total)
    for i, s in enumerate(sorted((k for k in by if k is not None), key=lambda s: s.encode()) + [None]):
        v = by[s]
        assert v[0][3] == sum(r[2] for r in v) and abs(sum(r[5] for r in v) - v[0][4]) <= 0.5
        share = [w[0][4] / (1, 2, 3)[j % 3] for j, w in enumerate(by[k] for k in sorted((k for k in by if k is not None), key=lambda s: s.encode()) + [None])]
        assert v[0][4] == pytest.approx(3 * v[0][3]) or share[i] == pytest.approx(max(share))
    order = [r["source_no"] for r in slots.orderBy("slot").collect()]
    half = Counter(order[: len(order) // 2])
    assert all(abs(half[k] - n / 2) <= 3 for k, n in Counter(order).items())
    assert mixing.mix_sources(d.limit(0))[0].count() == 0


# 8


def test_language_id(spark):
    texts = {"en": "the cat and the house were with that which is", "de": "der hund und das haus waren nicht mit dem", "fr": "le chien et la maison étaient avec les que"}
    labelled = spark.createDataFrame([(" ".join(RND.sample(t.split(), 6)), k) for k, t in texts.items() for _ in range(20)] + [(None, "en"), ("x", None)], "text string, lang string")
    page = lambda i, lang, body, host="h.org": (i, f"http://{host}/x", f"<html lang='{lang}'><script>the and that</script><p>{body}</p>" if lang else f"<p>{body}</p>")
    pages = [page(i, k, t, f"{k}.example.{k}") for i, (k, t) in enumerate(list(texts.items()) * 5)] + [page(50, "de", ""), page(51, None, "", "de.example.de"), (None, None, None), page(53, "de-DE", "zzz"), page(54, None, texts["fr"])]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS n", "2 AS host")
    got = {r["page_id"]: r for r in language_id.identify(d, labelled).collect()}
    assert len(got) == len(pages) and all(got[i]["lang"] == list(texts)[i % 3] for i in range(15))
    assert [got[i]["lang"] for i in (50, 51, 53, 54)] == ["de", "de", "de", "fr"]
    assert got[None]["text_lang"] is None and 0 < got[None]["probability"] < 1 and got[53]["declared"] == "de"
    assert language_id.identify(d.limit(0), labelled).count() == 0 and language_id.identify(d, labelled.limit(0)).first()["lang"] is None


def test_language_id_against_plain_bayes(spark):
    sf = "/root/testdata/sf0.01"
    pages = [r.asDict() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()][:200]
    pages += [{"page_id": 9_000, "url": pages[0]["url"], "html": None}, {"page_id": 9_001, "url": None, "html": "<html lang=fr>'"}, dict(pages[3])]
    labelled = [(r["text"], "o'" + r["lang"] if r["lang"] == "es" else r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r["text"] and r["lang"]]

    def buckets(text):
        return language_id._buckets(pa.array([text]))[1].tolist()

    langs = sorted({k for _, k in labelled})
    counts = {k: Counter() for k in langs}
    for t, k in labelled:
        counts[k].update(buckets(t))
    size = {k: sum(counts[k].values()) + 0.1 * 2**16 for k in langs}
    boiler = re.compile(language_id.BOILERPLATE)
    seen = []
    for p in pages:
        html, url = p["html"] or "", p["url"] or ""
        found = buckets(boiler.sub(" ", html))
        ll = [sum(math.log((counts[k][b] + 0.1) / size[k]) for b in found) / 4 for k in langs]
        ll = [x - max(ll) for x in ll]
        own = [math.exp(x) / sum(map(math.exp, ll)) if found else 0.0 for x in ll]
        m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url)
        host = m[1].lower() if m else ""
        d = re.search(r"""<html\b[^>]*?\s(?:xml:)?lang\s*=\s*["']?([a-zA-Z]{2,3})""", html, re.I)
        seen.append((p["page_id"], host, host.split(".")[-1], d[1].lower() if d else None, ll, own))
    total = [sum(s[5][i] for s in seen) for i in range(len(langs))]
    world = [(x + 1) / (sum(total) + len(langs)) for x in total]
    want = []
    for page, host, suffix, declared, ll, own in seen:
        at = lambda f: [max(0, sum(s[5][i] for s in seen if f(s)) - own[i]) for i in range(len(langs))]
        h, z, d = at(lambda s: s[1] == host), at(lambda s: s[2] == suffix), at(lambda s: s[3] == declared)
        score = []
        for i, k in enumerate(langs):
            wide = (z[i] + 20 * world[i]) / (sum(z) + 20)
            prior = (h[i] + 5 * wide) / (sum(h) + 5)
            record = math.log((d[i] + (1 if declared == k else 0.1)) / (total[i] + 2)) if declared else 0
            score.append(ll[i] + math.log(prior) + record)
        best = max(range(len(langs)), key=lambda i: (score[i], -i))
        want.append((page, langs[best], 1 / sum(math.exp(s - score[best]) for s in score)))
    d = spark.createDataFrame([(p["page_id"], p["url"], p["html"]) for p in pages], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["lang"], r["probability"]) for r in language_id.identify(d, spark.createDataFrame(labelled, "text string, lang string")).collect())
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in sorted(want)], abs=1e-6)


# 9


def test_chat(spark):
    told = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", told), (-7, 1, "assistant", told), (1, 0, "assist<|ant|>\n", "\\<|x|></s\\>"), (1, 1, "assistant", None), (1, 1, "assistant", "é\\"), (None, 1, None, "<"), (None, None, "assistant", "a")]
    rows += [(c, t, RND.choice(["user", "assistant", "system"]), RND.choice(["", "\\\\<s>", "<", "|>", "[/INST]</s>", say(5)])) for c in range(2, 60) for t in range(RND.randrange(1, 6))]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(d)).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), (r is not None, r or ""), (x is not None, x or "")))
    assert set(got) == set(by)
    for c, v in by.items():
        v.sort()
        whole, loss = "".join(f"{r[1]}\n{x[1]}\n" for _, r, x in v), "".join(x[1] for _, r, x in v if r[1] == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(v), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    text = chat.format_chats(d.where("conv_id = -7")).first()["formatted"]
    assert all(text.count(c) == n for c, n in (("[INST]", 0), ("[/INST]", 0), ("</s>", 2), ("<|", 2)))
    assert chat.format_chats(d.limit(0)).count() == 0


# 10


def test_toxicity(spark):
    rnd = random.Random(2)
    clean = lambda: " ".join(rnd.choice("alpha beta gamma delta omega sigma".split()) for _ in range(30))
    rows, labels = [], []
    for i in range(600):
        bad = rnd.random() < 0.2
        rows.append((i, clean() + (rnd.choice([" you idiot scum", " zorkling zorkest"]) if bad else "") + " " + clean()))
        if i % 2:
            labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "idiot"), (0, rows[0][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "'a' AS y")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    r = toxicity.toxicity(d, lab).collect()
    assert len(r) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in r)
    import zlib

    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in r if x["doc_id"] is not None)
    wrong = [x["doc_id"] for x in r if x["doc_id"] is not None and x["doc_id"] < 600 and x["predicted"] != int("idiot" in x["text"] or "zork" in x["text"])]
    assert len(wrong) <= 6
    assert [x["predicted"] for x in r if x["doc_id"] in (1000, 1001)] == [0, 0]
    alone = toxicity.toxicity(docs(spark, ["you idiot", "fine"]), lab.limit(0)).orderBy("doc_id").collect()
    assert [x["predicted"] for x in alone] == [1, 0]
    assert toxicity.toxicity(d.limit(0), lab).count() == 0


def brute_label_model(rows, told, y, rounds):
    """The same steps in plain Python: tree of greatest conditional information, rates by counting, posteriors by products."""
    m = len(rows[0][0])

    def estimate(cells):  # (class, votes) -> weight
        mass = [sum(w for (k, _), w in cells.items() if k == c) for c in (0, 1)]
        info = {}
        for i in range(m):
            for j in range(m):
                info[i, j] = 0.0
                for c in (0, 1):
                    t = Counter()
                    for (k, v), w in cells.items():
                        if k == c:
                            t[v[i], v[j]] += w
                    for (a, b), w in t.items():
                        own, other = sum(x for (p, _), x in t.items() if p == a), sum(x for (_, q), x in t.items() if q == b)
                        info[i, j] += w * math.log(w * mass[c] / (own * other)) if w else 0
        parent, inside = {0: None}, [0]
        while len(inside) < m:
            i, j = max(((i, j) for i in inside for j in range(m) if j not in inside), key=lambda e: info[e])
            parent[j] = i
            inside.append(j)
        rates = {}
        for c in (0, 1):
            for i in range(m):
                overall = min(max(sum(w for (_, v), w in cells.items() if v[i]), 1e-6), 1 - 1e-6)
                lean = 1e-3 * mass[c]
                own = (sum(w for (k, v), w in cells.items() if k == c and v[i]) + lean * overall) / (mass[c] + lean)
                for u in (0, 1):
                    if parent[i] is None:
                        rate = own
                    else:
                        seen = sum(w for (k, v), w in cells.items() if k == c and v[parent[i]] == u)
                        rate = (sum(w for (k, v), w in cells.items() if k == c and v[i] and v[parent[i]] == u) + lean * own) / (seen + lean)
                    rates[c, i, u] = min(max(rate, 1e-6), 1 - 1e-6)
        return parent, rates, min(max(mass[1] / sum(mass), 1e-4), 1 - 1e-4)

    def posterior(model, v):
        parent, rates, share = model
        p = [1 - share, share]
        for c in (0, 1):
            for i in range(m):
                r = rates[c, i, v[parent[i]] if parent[i] is not None else 0]
                p[c] *= r if v[i] else 1 - r
        return p[1] / sum(p)

    labelled = Counter()
    for v, k in zip(told, y):
        labelled[k, v] += 1 / len(y)
    model, n = estimate(labelled), sum(w for _, w in rows)
    for _ in range(rounds):
        post = [posterior(model, v) for v, _ in rows]
        share = sum(w * p for (_, w), p in zip(rows, post)) / n
        cells = Counter()
        for (v, w), p in zip(rows, post):
            cells[0, v] += w * (1 - p) / n / 2
            cells[1, v] += w * p / n / 2
        for (k, v), w in labelled.items():
            cells[k, v] += w * (share if k else 1 - share) / (sum(x == k for x in y) / len(y)) / 2
        model = estimate(cells)
    return model, [posterior(model, v) for v, _ in rows]


def test_label_model_against_plain_python():
    rnd = random.Random(12)

    def votes(k):
        a = int(rnd.random() < (0.8 if k else 0.1))
        b = a if rnd.random() < 0.9 else int(rnd.random() < 0.5)  # says the same thing again
        c = int(rnd.random() < (0.6 if k else 0.05))
        return a, b, c, int(rnd.random() < 0.3)

    texts = [(int(rnd.random() < 0.25),) for _ in range(3_000)]
    texts = [(k, votes(k)) for (k,) in texts]
    rows = sorted(Counter(v for _, v in texts[400:]).items())
    told, y = [v for _, v in texts[:400]], [k for k, _ in texts[:400]]
    model = toxicity.label_model(np.array([v for v, _ in rows]), np.array([float(w) for _, w in rows]), np.array(told), np.array(y), rounds=5)
    plain, post = brute_label_model(rows, told, y, 5)
    assert model.parent.tolist() == [-1 if plain[0][i] is None else plain[0][i] for i in range(4)]
    assert model.share == pytest.approx(plain[2]) and model.parent[1] == 0
    assert [model.rates[k, u, i] for k in (0, 1) for i in range(4) for u in (0, 1)] == pytest.approx([plain[1][k, i, u] for k in (0, 1) for i in range(4) for u in (0, 1)])
    assert model.posterior(np.array([v for v, _ in rows])).tolist() == pytest.approx(post)
    # What the second voter repeats adds little to what the first one says.
    one, both = model.posterior(np.array([[1, 0, 0, 0], [1, 1, 0, 0]]))
    assert abs(both - one) < 0.4 and 0.15 < model.share < 0.35


def test_toxicity_keeps_columns_that_are_named_alike(spark):
    d = docs(spark, ["you idiot", "fine"]).selectExpr("*", "'mine' AS score", "2 AS predicted")
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(d, lab, names=("held_out", "score_", "predicted_")).orderBy("doc_id").collect()
    assert [(r["score"], r["predicted"], r["predicted_"]) for r in got] == [("mine", 2, 1), ("mine", 2, 0)]
