"""Personal data: fixed patterns, and bootstrapped extraction from context.

Base kinds (email, ip, card, phone) are found by pattern and always reported. They are also the seeds: the words around a
seed make lexical patterns (two words before; one before and one after; two after; one before; one after). Tokens that look
like identifiers but match no base kind are candidates. Spark joins patterns and instances (seeds and candidates) as a graph and scores it in
rounds: each round admits the patterns that enough trusted instances stand in, seeds or candidates found before, so what is
found leads to new patterns. A pattern is as reliable as the share of trusted instances among these and the tokens in its
place that don't look like identifiers; candidates that are not decided yet speak neither for it nor against it, since they are
what it is to find. A candidate is as reliable as the patterns around it make it together. Candidates above a threshold are reported.

How often a pattern stands around any other token at all comes from a second pass over all texts, in which a token is cut as
candidates are: outer punctuation belongs to its context, and what touches a seed or candidate counts as that instance. A
filter of fixed size tells tasks which patterns matter; the exact join afterwards removes what it lets pass. Patterns with
fewer instances of any sort than a pattern needs trusted ones could never be admitted and are left out of the graph.

Defined results: null text counts as empty; spans of one kind never overlap; equal rows give equal spans; equal scores are
equal decisions; an empty table gives an empty table; other columns are not looked at. Rows are told apart by a 64-bit hash of
doc_id and text, so two different rows share spans at a chance of n^2 / 2^65.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.anchors import mixed
from lacuna.llm.common import id_text, numbered
from lacuna.llm.repeats import Filter, _filter
from lacuna.operators.lineage import written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "context")
ROUNDS, LEAST_SEEDS, LEAST_PATTERN, LEAST_INSTANCE = 3, 3, 0.5, 0.8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TAIL, _LEAD = ".,;:!?)]}>\"'", "([{<\"'"
_CANDIDATE = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
#: What may be an identifier: so many characters and, without an @, so many digits.
LEAST_CHARS, LEAST_DIGITS = 5, 4


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str):
    """Leftmost, non-overlapping: a match starts where the run of local characters before an @ starts, after the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, stop) by kind, then start; places are code points."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((3, *m.span()))
    return found


def candidates(text: str, base: list[tuple[int, int, int]]):
    """Tokens with an @ or ``LEAST_DIGITS`` digits, however long, without outer punctuation, that touch no base span."""
    taken = sorted((a, b) for _, a, b in base)
    k = 0
    for m in _CANDIDATE.finditer(text):
        token = m[0].rstrip(_TAIL)
        lead = len(token) - len(token.lstrip(_LEAD))
        token, start = token[lead:], m.start() + lead
        if len(token) < LEAST_CHARS or "@" not in token and sum(map(token.count, "0123456789")) < LEAST_DIGITS:
            continue
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k == len(taken) or taken[k][0] >= start + len(token):
            yield start, start + len(token)


def _word(w: bytes) -> int:
    return zlib.crc32(w.lower())


def _pair(a, b, shape: int):
    """Hash of a pattern: two words and how they stand around the token."""
    a, b = np.asarray(a, np.uint64), np.asarray(b, np.uint64)
    return mixed((a << np.uint64(32) | b) ^ np.uint64(0x9E3779B97F4A7C15 * (shape + 1) & 0xFFFFFFFFFFFFFFFF))


def patterns(text: str, start: int, stop: int) -> list[int]:
    """Hashes of the patterns around a span; words are cut at white space and are whole, however long."""
    near, before, after = 0, [], []
    while len(before) < 3 and near < start:
        near = 2 * near or 200
        before = text[max(0, start - near) : start].encode().split()
    near = 0
    while len(after) < 3 and near < len(text) - stop:
        near = 2 * near or 200
        after = text[stop : stop + near].encode().split()
    before, after = before[-2:], after[:2]
    b, a = [_word(w) for w in before], [_word(w) for w in after]
    out = []
    if len(b) == 2:
        out.append(_pair([b[0]], [b[1]], 0))
    if b and a:
        out.append(_pair([b[-1]], [a[0]], 1))
    if len(a) == 2:
        out.append(_pair([a[0]], [a[1]], 2))
    if b:
        out.append(_pair([b[-1]], [b[-1]], 3))
    if a:
        out.append(_pair([a[0]], [a[0]], 4))
    return [int(x.view(np.int64)[0]) for x in out]


EDGE = "row long, start long, stop long, seed boolean, instance long, patterns array<long>"


def _edges(docs: DataFrame) -> DataFrame:
    """A row for each seed and candidate: where it is, what it says (hashed) and the patterns around it."""

    def run(batches):
        for batch in batches:
            out = []
            for row, x in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
                text = x.as_py()
                base = base_spans(text)
                for seed, a, b in [(True, a, b) for _, a, b in base] + [(False, a, b) for a, b in candidates(text, base)]:
                    said = text[a:b].lower().encode()
                    instance = (zlib.crc32(said) << 32 | zlib.crc32(said[::-1])) - (1 << 63)
                    out.append({"row": row, "start": a, "stop": b, "seed": seed, "instance": instance, "patterns": patterns(text, a, b)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("row", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("seed", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))

    return docs.select("row", "text").mapInArrow(run, EDGE)


_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\f"))
_IN_TAIL, _IN_LEAD = (np.isin(np.arange(256), list(x.encode())) for x in (_TAIL, _LEAD))


def _contexts(text: str) -> list[np.ndarray]:
    """By shape: hashes of the patterns around each token that touches no base span and no candidate."""
    raw = text.encode()
    words = raw.lower().split()
    if not words:
        return []
    space = _SPACE[np.frombuffer(raw, np.uint8)]
    starts = np.flatnonzero(~space & np.append(True, space[:-1]))
    stops = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    base = base_spans(text)
    free = np.ones(len(words), bool)
    place = (lambda k: k) if text.isascii() else (lambda k: len(text[:k].encode()))
    for a, b in [(a, b) for _, a, b in base] + list(candidates(text, base)):
        free[np.searchsorted(stops, place(a), "right") : np.searchsorted(starts, place(b))] = False
    h = np.zeros(len(words) + 4, np.uint64)
    h[2:-2] = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    there = np.zeros(len(h), bool)
    there[2:-2] = True
    (b2, b1, a1, a2), (has_b2, has_b1, has_a1, has_a2) = ([x[k : k + len(words)].copy() for k in (0, 1, 3, 4)] for x in (h, there))
    data = np.frombuffer(raw, np.uint8)
    for i in np.flatnonzero((_IN_TAIL[data[stops - 1]] | _IN_LEAD[data[starts]]) & free):
        word = words[i]
        front = word.rstrip(_TAIL.encode())
        core = front.lstrip(_LEAD.encode())
        if not core:
            continue
        if lead := front[: len(front) - len(core)]:
            b2[i], has_b2[i], b1[i], has_b1[i] = b1[i], has_b1[i], zlib.crc32(lead), True
        if tail := word[len(front) :]:
            a2[i], has_a2[i], a1[i], has_a1[i] = a1[i], has_a1[i], zlib.crc32(tail), True
    shapes = ((b2, b1, has_b2 & has_b1), (b1, a1, has_b1 & has_a1), (a1, a2, has_a1 & has_a2), (b1, b1, has_b1), (a1, a1, has_a1))
    return [_pair(x[good & free], y[good & free], k) for k, (x, y, good) in enumerate(shapes)]


def _occurrences(docs: DataFrame, wanted) -> DataFrame:
    """pattern, n: how often patterns that pass the filter stand around tokens that are no instance."""

    def run(batches):
        known = Filter(wanted.value)
        for batch in batches:
            parts = []
            for x in batch.column("text"):
                parts += [p[known.has(p)] for p in _contexts(x.as_py())]
            seen, n = np.unique(np.concatenate(parts) if parts else np.array([], np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n.astype(np.int64))], ["pattern", "n"])

    return docs.select("text").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def discovered(docs: DataFrame, rounds: int = ROUNDS, least_pattern: float = LEAST_PATTERN, least_instance: float = LEAST_INSTANCE) -> DataFrame:
    """row, start, stop of candidates that context shows to be identifiers; ``docs`` has row and text."""
    edges = written(_edges(docs))
    graph = edges.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.count("*").alias("times"), F.max("seed").alias("seed"))
    graph = written(graph)
    useful = written(graph.groupBy("pattern").agg(F.count("*").alias("instances")).filter(F.col("instances") >= LEAST_SEEDS).select("pattern"))
    if useful.isEmpty():
        return edges.filter("false").select("row", "start", "stop")
    wanted = docs.sparkSession.sparkContext.broadcast(_filter(useful, "pattern").words)
    totals = useful.join(_occurrences(docs, wanted), "pattern", "left").select("pattern", F.coalesce("n", F.lit(0)).alias("others"))
    graph = written(graph.join(totals, "pattern"))
    trusted = graph.select("instance", "seed").groupBy("instance").agg(F.max("seed").cast("double").alias("trust"))
    for _ in range(rounds):
        backing = F.count_if(F.col("trust") >= least_instance).alias("backing")
        times = F.sum(F.col("times") * F.col("trust"))
        score = graph.join(trusted, "instance").groupBy("pattern").agg((times / (times + F.max("others") + 1)).alias("score"), backing)
        good = score.filter((F.col("score") >= least_pattern) & (F.col("backing") >= LEAST_SEEDS)).select("pattern", "score")
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.coalesce("score", F.lit(0.0))))))
        trusted = written(graph.join(good, "pattern", "left").groupBy("instance").agg(F.when(F.max("seed"), 1.0).otherwise(1 - doubt).alias("trust")))
    sure = trusted.filter(F.col("trust") >= least_instance).select("instance")
    return edges.filter("not seed").join(sure, "instance").select("row", "start", "stop").distinct()


def find(docs: DataFrame) -> DataFrame:
    """doc_id, row, base spans and all spans (kind number, start, stop) by kind and start, for every row."""
    rows = id_text(docs).withColumn("row", F.xxhash64("doc_id", "text"))
    more = discovered(rows).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("more"))

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            found = [[{"kind": k, "start": a, "stop": b} for k, a, b in base_spans(x.as_py())] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(found, kind)], ["doc_id", "row", "base"])

    base = rows.mapInArrow(run, "doc_id long, row long, base array<struct<kind:int,start:long,stop:long>>")
    added = F.transform(F.coalesce("more", F.array().cast("array<struct<start:bigint,stop:bigint>>")), lambda x: F.struct(F.lit(len(BASE)).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    return base.join(written(more), "row", "left").select("doc_id", "row", "base", F.concat("base", added).alias("spans"))


def _is(kind: int):
    return lambda x: x["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))
    told = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["stop"])))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """All documents with each span of personal data replaced by its kind in brackets; overlapping spans become one.

    Only what context shows is joined to the texts, as a table whose size the planner knows; base spans are found in passing.
    """
    rows, (doc_id, text), named = numbered(docs, "doc_id", "text")
    keyed = rows.withColumn("row", F.xxhash64(doc_id.cast("long"), F.coalesce(text, F.lit(""))))
    more = discovered(keyed.select("row", F.coalesce(text, F.lit("")).alias("text"))).groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("more"))
    joined = keyed.join(written(more), "row", "left")

    @F.arrow_udf("string")
    def cut(text: pa.Array, more: pa.Array) -> pa.Array:
        return pa.array([_cut(t.as_py(), m) for t, m in zip(text, more.to_pylist(), strict=True)], pa.string())

    return joined.select(*[cut(text, "more").alias(old) if old == "text" else c for c, old in zip(named, docs.columns, strict=True)])


def _cut(text, more):
    if text is None:
        return text
    spans = [(a, b, k) for k, a, b in base_spans(text)] + [(s["start"], s["stop"], len(BASE)) for s in (() if more is None else more)]
    out, at = [], 0
    for start, stop, kind in sorted(spans):
        if start >= at:
            out += (text[at:start], f"[{KINDS[kind]}]")
        at = max(at, stop)
    return "".join((*out, text[at:]))
