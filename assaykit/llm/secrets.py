"""Secret scans: fixed shapes and sliding-window Shannon entropy. DataFrame and SQL functions only.

Three fixed shapes (assignments to telling names, access key ids, long hex) are always reported. Beyond them, every
long enough run of a character class is a candidate: a window slides over it, its character counts change by the one
character that enters and the one that leaves, and with them the sum that gives the window's Shannon entropy. Windows
at or above the class's threshold are joined into spans; candidates on the allow-list are left out. Of spans that
overlap one of the fixed shapes or an earlier span, the parts outside are reported apart.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.lineage import cut
from assaykit.llm.common import among, free_names

# The shapes that are always reported, in reporting order.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}


@dataclass(frozen=True)
class CharClass:
    """Candidates of one alphabet: ``least`` characters or more, scanned with ``window`` at ``bits`` of entropy."""

    kind: str
    alphabet: str
    pattern: str
    window: int = 24
    bits: float = 3.0
    must: str = r"^(?=.*[0-9])(?=.*[A-Za-z])"


CLASSES = (
    CharClass("entropy_hex", "0123456789ABCDEFabcdef", r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{24,}(?![0-9A-Fa-f])", bits=3.0),
    CharClass("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}", bits=3.9, must=r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"),
)
#: Candidates that are no secrets: identifiers in the common dashed form, alphabets and digit rows, placeholders.
ALLOW = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)abcdefghijklmnop|0123456789",
    r"(?i)example|placeholder|changeme|your[-_]|dummy|redacted",
    r"^(.)\1*$",
)


def _text(pattern: str) -> str:
    """A SQL string literal without escapes of its own."""
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _entropy_spans(x: str, c: CharClass) -> str:
    """SQL for the array of ``(s, e)`` offsets in ``x`` covered by windows of high entropy, by incremental counts."""
    f = "array(" + ",".join(f"{n * log2(n) if n else 0.0!r}D" for n in range(c.window + 2)) + ")"
    codes = f"transform(split({x}, ''), z -> instr('{c.alphabet}', z) - 1)"
    w = c.window
    enter, leave = "t.d[i - 1]", f"t.d[i - 1 - {w}]"
    step = f"""IF(i > {w} AND {enter} = {leave}, named_struct('c', a.c, 's', a.s), named_struct(
        'c', transform(a.c, (v, k) -> v + IF(k = {enter}, 1, 0) - IF(i > {w} AND k = {leave}, 1, 0)),
        's', a.s + t.f[a.c[{enter}] + 1] - t.f[a.c[{enter}]] + IF(i > {w}, t.f[a.c[{leave}] - 1] - t.f[a.c[{leave}]], 0D)))"""
    # Entropy of a window: log2(w) - sum(n log2 n) / w.
    high = f"i >= {w} AND {log2(w)!r}D - u.s / {w} >= {c.bits!r}D"
    keep = f"""named_struct('c', u.c, 's', u.s,
        'lo', IF({high} AND i - {w} > a.hi, i - {w}, a.lo), 'hi', IF({high}, i, a.hi),
        'out', IF({high} AND i - {w} > a.hi AND a.hi > 0, concat(a.out, array(named_struct('s', a.lo, 'e', a.hi))), a.out))"""
    start = f"named_struct('c', array_repeat(0, {len(c.alphabet)}), 's', 0D, 'lo', 0, 'hi', -1, 'out', CAST(array() AS array<struct<s:int,e:int>>))"
    scan = f"aggregate(sequence(1, size(t.d)), {start}, (a, i) -> element_at(transform(array({step}), u -> {keep}), 1), a -> IF(a.hi > 0, concat(a.out, array(named_struct('s', a.lo, 'e', a.hi))), a.out))"
    return f"element_at(transform(array(named_struct('d', {codes}, 'f', {f})), t -> {scan}), 1)"


def _pieces(kind: str, order: int, pattern: str, found: str, sub: str) -> str:
    """SQL for an array of matches: their place in order, the characters before each since the last, and sub-spans."""
    none = "CAST(array() AS array<struct<o:int,kind:string,k:int,gap:int,len:int,sub:array<struct<s:int,e:int>>>>)"
    p = _text(pattern)
    gaps = f"split(text, {p}, -1)"
    cut = f"transform({found}, (x, k) -> named_struct('o', {order}, 'kind', '{kind}', 'k', k, 'gap', length(g[k]), 'len', length(x.m), 'sub', {sub}))"
    return f"IF(text IS NULL OR NOT text RLIKE {p}, {none}, element_at(transform(array({gaps}), g -> {cut}), 1))"


def scan_spans(docs: DataFrame, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``row, doc_id, o, kind, start, end, over``: the spans found, and one row with null ``kind`` for a text without any.

    Code points, end exclusive. ``row`` tells rows apart that repeat an id. ``over`` marks entropy spans that overlap a
    fixed shape or an entropy span before them; their ``kind`` is null.
    """
    whole = "CAST(array(named_struct('s', 0, 'e', length(x.m))) AS array<struct<s:int,e:int>>)"
    none = "CAST(array() AS array<struct<s:int,e:int>>)"
    all_ = lambda p: f"transform(regexp_extract_all(text, {_text(p)}, 0), z -> named_struct('m', z))"
    pair = f"zip_with(regexp_extract_all(text, {_text(ASSIGN)}, 0), regexp_extract_all(text, {_text(ASSIGN)}, 1), (y, z) -> named_struct('m', y, 'v', z))"
    # Runs shorter than the least length are no match either way, so they need not be cut out.
    shapes = [
        _pieces("assign", 0, ASSIGN, pair, f"IF(length(x.v) >= {LEAST['assign']}, {whole}, {none})"),
        _pieces("access", 1, ACCESS.replace("+", f"{{{LEAST['access'] - 4},}}"), all_(ACCESS.replace("+", f"{{{LEAST['access'] - 4},}}")), whole),
        _pieces("hex", 2, HEX.replace("+", f"{{{LEAST['hex']},}}"), all_(HEX.replace("+", f"{{{LEAST['hex']},}}")), whole),
    ]
    for i, c in enumerate(classes):
        allowed = " OR ".join(f"x.m RLIKE {_text(a)}" for a in allow) or "false"
        shapes.append(_pieces(c.kind, 3 + i, c.pattern, all_(c.pattern), f"IF(NOT x.m RLIKE {_text(c.must)} OR {allowed}, {none}, {_entropy_spans('x.m', c)})"))
    d = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.expr(f"concat({','.join(shapes)})").alias("found"))
    d = d.select("doc_id", "row", F.explode_outer("found").alias("x")).select("doc_id", "row", "x.*")
    in_kind = Window.partitionBy("row", "o").orderBy("k")
    before = F.coalesce(F.sum("len").over(in_kind.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("at", F.sum("gap").over(in_kind.rowsBetween(Window.unboundedPreceding, 0)) + before)
    d = d.select("doc_id", "row", "o", "kind", "at", F.explode_outer("sub").alias("z"))
    d = d.select("doc_id", "row", "o", F.when(F.col("z").isNotNull(), F.col("kind")).alias("kind"), (F.col("at") + F.col("z.s")).alias("start"), (F.col("at") + F.col("z.e")).alias("end"))
    # Entropy spans that touch a fixed shape, or an entropy span before them, are no spans of their own.
    order = Window.partitionBy("row").orderBy(F.col("start").asc_nulls_last(), "o", "end")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    fixed = F.col("o") < 3
    touched = (F.coalesce(F.max(F.when(fixed, F.col("end"))).over(back), F.lit(-1)) > F.col("start")) | (F.coalesce(F.min(F.when(fixed, F.col("start"))).over(ahead), F.col("end")) < F.col("end"))
    d = d.withColumn("touched", ~fixed & touched)
    seen = F.coalesce(F.max(F.when(~F.col("touched"), F.col("end"))).over(back), F.lit(-1)) > F.col("start")
    d = d.withColumn("over", F.coalesce(F.col("touched") | (~fixed & seen), F.lit(False)))
    return d.withColumn("kind", F.when(~F.col("over"), F.col("kind"))).select("row", "doc_id", "o", "kind", "start", "end", "over")


def _outside() -> str:
    """SQL for the parts of the spans in ``hidden`` that no span in ``found`` covers, joined where they meet."""
    # One sweep over starts and ends in order; ``s`` and ``h`` count the open spans of either array.
    edge = lambda a, s, h: f"transform({a}, x -> named_struct('p', x.start, 's', {s}, 'h', {h})), transform({a}, x -> named_struct('p', x.end, 's', -{s}, 'h', -{h}))"
    part = "named_struct('s', a.at, 'e', e.p)"
    joined = f"IF(size(a.out) > 0 AND element_at(a.out, -1).e = a.at, concat(slice(a.out, 1, size(a.out) - 1), array(named_struct('s', element_at(a.out, -1).s, 'e', e.p))), concat(a.out, array({part})))"
    step = f"named_struct('at', e.p, 's', a.s + e.s, 'h', a.h + e.h, 'out', IF(a.h > 0 AND a.s = 0 AND e.p > a.at, {joined}, a.out))"
    start = "named_struct('at', 0L, 's', 0, 'h', 0, 'out', CAST(array() AS array<struct<s:bigint,e:bigint>>))"
    return f"IF(size(hidden) = 0, {start}.out, aggregate(array_sort(concat({edge('found', 1, 0)}, {edge('hidden', 0, 1)})), {start}, (a, e) -> {step}, a -> a.out))"


def scan_secrets(docs: DataFrame, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """A row per input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, parts, found, rest``.

    ``found`` is the sorted array of ``start, o, kind, end`` from which ``spans`` derives. ``parts`` has, as
    ``start:end``, what entropy spans that overlap those cover beside them; both together are all that was found, and
    ``rest`` is the array of ``parts``. Null, empty and clean
    texts have zero counts, the digest of the empty string and no spans. Rows that repeat an id are scanned each for
    itself; an empty table gives no rows; columns but ``doc_id`` and ``text`` are ignored. Long texts are scanned whole.
    """
    spans = scan_spans(docs.select("doc_id", "text"), classes, allow)
    item = F.when(F.col("kind").isNotNull(), F.struct("start", "o", "kind", "end"))
    hidden = F.when(F.col("over"), F.struct("start", "end"))
    d = spans.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(item)).alias("found"), F.collect_list(hidden).alias("hidden"))
    d = d.withColumn("rest", F.expr(_outside()))
    count = lambda o: F.size(F.filter("found", lambda x: x["o"] == o)).cast("long")
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["o"] < 3)
    parts = F.array_join(F.transform("rest", lambda x: F.concat_ws(":", x["s"].cast("string"), x["e"].cast("string"))), ",")
    return d.select("row", "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"), parts.alias("parts"), "found", "rest")


def redact(docs: DataFrame, mask: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every secret replaced by ``mask``, all columns kept; ``n_chars``, if there, follows the new text.

    Spans depend on the text alone, and rows meet them by its SHA-256: ids may be null or repeated, and further columns
    may have any names. Texts without secrets, null and empty ones stay as they are, and all but a few of them where
    they are: only texts that a filter lets pass travel.
    """
    key, secret_key, spans = free_names(docs, "text_key", "secret_key", "secret_spans")
    keyed = docs.withColumn(key, F.sha2("text", 256))
    every = F.array_sort(F.concat(F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), F.transform("rest", lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end")))))
    found = scan_secrets(keyed.select(F.col(key).alias("doc_id"), "text")).withColumn("found", every).where(F.size("found") > 0)
    found = cut(found.groupBy(F.col("doc_id").alias(secret_key)).agg(F.first("found").alias(spans)))
    kept = f"aggregate({spans}, named_struct('t', CAST(array() AS array<string>), 'at', 0L), (a, x) -> IF(x.end <= a.at, a, named_struct('t', concat(a.t, array(substring(text, CAST(a.at + 1 AS int), CAST(greatest(0L, x.start - a.at) AS int)), '{mask}')), 'at', CAST(x.end AS bigint))), a -> concat(array_join(a.t, ''), substring(text, CAST(a.at + 1 AS int))))"
    near = among(keyed, key, found.select(secret_key)).join(found, F.col(key) == F.col(secret_key), "left")
    near = near.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.expr(kept)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        near = near.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return among(keyed, key, found.select(secret_key), others=True).select(*docs.columns).union(near.select(*docs.columns))
