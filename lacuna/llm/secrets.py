"""Secret scans with multipart credential linking, in DataFrame operations only.

Base kinds are reported wherever they stand. Weaker parts (identifiers, secret-like tokens, endpoints) are reported only
where parts of complementary roles lie within one scope: an interval join pairs each weak part with parts whose places
fall into one of its own or a neighbouring scope-sized bin of the same text, and keeps it if one of another role is near enough.

Places come from the texts between matches: split() and regexp_extract_all() cut a text at the same matches, so a match
starts after all gaps up to it and all matches before it; the running sums are windows over the matches of one text.

Defined results: null text counts as empty; texts without matches have counts 0 and empty span lists; repeated rows give
repeated rows; ties in place are ordered by kind; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import id_text
from lacuna.operators.lineage import written

SCOPE = 300
#: Kind, role and pattern, base kinds first. Greedy runs of at least n are what passes among maximal runs.
KINDS = (
    ("assign", "secret", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    ("access", "identifier", r"AKIA[A-Z0-9]{16,}"),
    ("hex", "secret", r"[0-9a-f]{24,}"),
    ("weak_id", "identifier", r"(?i:client_id|access_key_id|account|username|user|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{3,}"),
    ("weak_secret", "secret", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}+={0,2}"),
    ("endpoint", "endpoint", r"https?://[^\x20\x09-\x0D\"'<>]+"),
)
BASE = 3
LEAST_VALUE = 6


def _piece(kind: int):
    return lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["n"].alias("n"), x["value"].alias("value"))


def _is(kind: int):
    return lambda x: x["kind"] == kind


def parts(rows: DataFrame) -> DataFrame:
    """row, kind (number), start, stop (code points) of every match of every kind in ``rows`` (row, text)."""
    found = rows
    for k, (_, _, pattern) in enumerate(KINDS):
        found = found.withColumn(f"m{k}", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    found = found.filter(" or ".join(f"size(m{k}) > 0" for k in range(len(KINDS))))
    values = F.transform(F.regexp_extract_all("text", F.lit(KINDS[0][2]), F.lit(1)), F.char_length)
    pieces = []
    for k, (_, _, pattern) in enumerate(KINDS):
        gaps = F.when(F.size(f"m{k}") > 0, F.split("text", pattern, -1)).otherwise(F.array())
        zipped = F.arrays_zip(F.transform(gaps, F.char_length).alias("gap"), F.transform(F.col(f"m{k}"), F.char_length).alias("n"), (values if k == 0 else F.array().cast("array<int>")).alias("value"))
        pieces.append(F.transform(zipped, _piece(k)))
    one = found.select("row", F.explode(F.flatten(F.array(*pieces))).alias("x")).select("row", "x.*").filter("n is not null").distinct()
    so_far = Window.partitionBy("row", "kind").orderBy("i")
    stop = F.sum(F.col("gap") + F.col("n")).over(so_far.rowsBetween(Window.unboundedPreceding, 0))
    placed = one.select("row", "kind", "value", "n", stop.alias("stop"))
    return placed.filter((F.col("kind") > 0) | (F.col("value") >= LEAST_VALUE)).select("row", "kind", (F.col("stop") - F.col("n")).cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Base parts, and those weak parts that no base part overlaps and that have a part of another role within the scope."""
    roles = F.element_at(F.array(*[F.lit(role) for _, role, _ in KINDS]), F.col("kind") + 1)
    all_parts = found.withColumn("role", roles).withColumn("bin", F.floor(F.col("start") / scope))
    weak = all_parts.filter(F.col("kind") >= BASE).withColumn("bin", F.explode(F.sequence("bin", F.floor(F.col("stop") / scope))))
    near = all_parts.select("row", F.col("kind").alias("k2"), F.col("start").alias("s2"), F.col("stop").alias("e2"), F.col("role").alias("r2"), F.explode(F.sequence(F.col("bin") - 1, F.floor(F.col("stop") / scope) + 1)).alias("bin"))
    met = weak.join(near, ["row", "bin"])
    overlap = (F.col("k2") < BASE) & (F.col("s2") < F.col("stop")) & (F.col("start") < F.col("e2"))
    apart = F.greatest(F.col("s2") - F.col("stop"), F.col("start") - F.col("e2"))
    complement = (F.col("r2") != F.col("role")) & (apart >= 0) & (apart <= scope)
    kept = met.groupBy("row", "kind", "start", "stop").agg(F.max(overlap).alias("covered"), F.max(complement).alias("paired")).filter("paired and not covered")
    return found.filter(F.col("kind") < BASE).union(kept.select("row", "kind", "start", "stop"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id and spans (kind, start, stop), by start and kind, for every row."""
    rows = id_text(docs).withColumn("row", F.xxhash64("doc_id", "text"))
    spans = linked(written(parts(rows.select("row", "text"))), scope)
    lists = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("spans"))
    return rows.select("doc_id", "row").join(lists, "row", "left").select("doc_id", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")).alias("spans"))


def digest(spans: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(k) for k, _, _ in KINDS])
    told = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["stop"])))
    base = F.filter("spans", lambda x: x["kind"] < BASE)
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{KINDS[k][0]}") for k in range(BASE)]
    return spans.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
