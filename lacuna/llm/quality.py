"""Quality classifier from weak labels.

Heuristic labellers look at every text and vote good, bad or nothing. The corpus is counted by combination of votes (at
most 3 to the power of the number of labellers), and expectation-maximisation on these counts estimates how often texts
are good and how accurate each labeller is. The posterior of a text's votes is its label; the labels of about ``TRAIN_DOCS``
whole texts, at most twice as many and at most ``SAMPLE_BYTES`` of features, chosen by a hash of the row (equal rows count once), train a linear logistic scorer on
hashed byte 4-grams, which then scores every whole text. A row is kept if the scorer gives ``KEEP`` or more, or if the
labellers that spoke are ``SURE`` that it is good (posterior), whatever the scorer says.

Defined results: null text counts as empty; a text of fewer than 4 bytes has no grams and gets the scorer's prior; equal
texts get equal scores; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import id_text
from lacuna.operators.lineage import written

GRAM_BITS, TRAIN_DOCS, SEED = 15, 2_000, 11
#: Bytes of features that the driver gets to train on, the first by hash.
SAMPLE_BYTES = 96 << 20
EM_ROUNDS, EPOCHS, RATE, DECAY = 50, 12, 0.5, 1e-4
#: A text is kept if the scorer says so, or if the labellers that spoke are as sure as this.
KEEP, SURE = 0.5, 0.9
_PLAIN = frozenset(b" \t\r\n.,;:'\"()-?")
_ODD_LIST = [not (chr(b).isalnum() or b in _PLAIN or b >= 128) for b in range(256)]
_ODD = np.array(_ODD_LIST)
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 for b in range(256)])
LABELLERS = ("symbols", "tails", "capitals", "runs", "top_word", "tables", "shouts", "triples", "repeats")


def votes(text: str) -> list[int]:
    """1 good, -1 bad, 0 nothing, by labeller."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    words = raw.split()
    n, size = len(words), max(1, len(data))
    counts = np.bincount(data, minlength=256)
    odd, upper, lower = counts[_ODD].sum() / size, counts[_UPPER].sum(), counts[_LOWER].sum()
    tails = sum(_ODD_LIST[w[-1]] for w in words) / n if n else 0.0
    runs = sum(map(bytes.__eq__, words, words[1:])) / n if n else 0.0
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) / (n - 2) if n > 2 else 0.0
    top = 0
    if n:
        seen: dict[bytes, int] = {}
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        top = max(seen.values()) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    spread = lambda bad, good: -1 if bad else int(good)
    return [
        spread(odd > 0.03, odd < 0.01),
        spread(n >= 5 and tails > 0.3, n >= 5 and tails < 0.1),
        spread(upper > lower, upper < 0.15 * max(1, lower)),
        spread(n >= 20 and runs > 0.2, n >= 20 and runs < 0.05),
        spread(n >= 20 and top > 0.3, n >= 20 and top < 0.15),
        spread(n >= 10 and counts[124] > 0.2 * n, n >= 10 and counts[124] == 0),
        spread(n >= 5 and raw.count(b"!!") > 0.2 * n, n >= 5 and raw.count(b"!!") == 0),
        spread(n >= 20 and triples < 0.8, n >= 20 and triples > 0.95),
        spread(len(lines) >= 5 and len(set(lines)) < 0.5 * len(lines), len(lines) >= 5 and len(set(lines)) > 0.9 * len(lines)),
    ]


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[float, np.ndarray]:
    """Share of good texts, and for each labeller the chance that a vote it casts is bad or good given a bad and a good
    text (2, m, 2). Silence says nothing. Starts from taking texts with any bad vote for bad."""
    good = np.where((patterns < 0).any(1), 0.1, 0.9)
    one_hot = np.stack([patterns == v for v in (-1, 1)], 2)
    for _ in range(rounds):
        weight = np.stack([1 - good, good]) * counts
        table = np.einsum("cp,pmv->cmv", weight, one_hot) + 1.0
        table /= table.sum(2, keepdims=True)
        prior = float((weight[1].sum() + 1) / (weight.sum() + 2))
        good = posterior(patterns, prior, table)
    return prior, table


def posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    said = np.log(table)
    chosen = np.where(patterns < 0, said[:, None, :, 0], np.where(patterns > 0, said[:, None, :, 1], 0.0)).sum(2)
    return 1 / (1 + np.exp(np.clip(chosen[0] - chosen[1] + np.log(1 - prior) - np.log(prior), -50, 50)))


def hashed(raw: bytes) -> np.ndarray:
    """Bucket of every 4-gram of bytes."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 4:
        return np.array([], np.uint32)
    return ((b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24) * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Logistic regression on relative frequencies of buckets against posterior labels, by AdaGrad."""
    rng, w, b = np.random.default_rng(SEED), np.zeros(1 << GRAM_BITS), 0.0
    seen, seen_b = np.full(1 << GRAM_BITS, 1e-8), 1e-8
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            i, x, y = rows[k]
            g = 1 / (1 + np.exp(-np.clip(w[i] @ x + b, -30, 30))) - y
            slope = g * x + DECAY * w[i]
            seen[i] += slope * slope
            seen_b += g * g
            w[i] -= RATE * slope / np.sqrt(seen[i])
            b -= RATE * g / np.sqrt(seen_b)
    return w, b


def _features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    i, n = np.unique(hashed(raw), return_counts=True)
    return i, n / max(1.0, np.sqrt((n.astype(float) ** 2).sum()))


def voted(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [votes(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(found, pa.list_(pa.int8()))], ["doc_id", "text", "votes"])

    return id_text(docs).mapInArrow(run, "doc_id long, text string, votes array<tinyint>")


def classify(docs: DataFrame, train_docs: int = TRAIN_DOCS, keep: float = KEEP) -> DataFrame:
    """doc_id, votes, posterior (from the labellers), score (from the scorer) and keep, for every row."""
    context = docs.sparkSession.sparkContext
    counted = voted(docs).groupBy("votes").count().collect()
    if not counted:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("").alias("votes"), F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(True).alias("keep"))
    patterns = np.array([r["votes"] for r in counted])
    counts = np.array([r["count"] for r in counted], float)
    order = np.lexsort(patterns.T)
    prior, labellers = fit_labellers(patterns[order], counts[order])
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(SEED)), 11) / float(1 << 53)

    def described(batches):
        for batch in batches:
            raw = [x.as_py().encode() for x in batch.column("text")]
            good = posterior(np.array([votes(x.as_py()) for x in batch.column("text")]).reshape(-1, len(LABELLERS)), prior, labellers)
            found = [_features(r) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("draw"), pa.array([f[0].astype("<u2").tobytes() for f in found], pa.binary()), pa.array([f[1].astype("<f4").tobytes() for f in found], pa.binary()), pa.array(good, pa.float64())], ["draw", "i", "x", "y"])

    drawn = id_text(docs).withColumn("draw", draw).filter(F.col("draw") < min(1.0, train_docs / counts.sum()))
    sample = written(drawn.select("draw", "text").dropDuplicates(["draw"]).mapInArrow(described, "draw double, i binary, x binary, y double"))
    sizes = sample.select("draw", (F.length("i") + F.length("x")).alias("size")).orderBy("draw").limit(2 * train_docs).toPandas()
    within = sizes["draw"][sizes["size"].cumsum() <= SAMPLE_BYTES]
    rows = sample.filter(F.col("draw") <= float(within.max() if len(within) else -1)).orderBy("draw").toArrow()
    scorer = context.broadcast(fit_scorer([(np.frombuffer(i, "<u2"), np.frombuffer(x, "<f4"), y) for i, x, y in zip(*(rows.column(c).to_pylist() for c in ("i", "x", "y")), strict=True)]))

    def scored(batches):
        w, b = scorer.value
        for batch in batches:
            said, scores = [], []
            for x in batch.column("text"):
                text = x.as_py()
                said.append(votes(text))
                n = np.bincount(hashed(text.encode()), minlength=1 << GRAM_BITS)
                size = np.sqrt(float(n @ n))
                scores.append(1 / (1 + np.exp(-np.clip(float(w @ n) / max(1.0, size) + b, -30, 30))))
            good = posterior(np.array(said).reshape(-1, len(LABELLERS)), prior, labellers)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(["".join("-0+"[v + 1] for v in s) for s in said], pa.string()), pa.array(good, pa.float64()), pa.array(scores, pa.float64()), pa.array([s >= keep or g >= SURE for s, g in zip(scores, good, strict=True)], pa.bool_())],
                ["doc_id", "votes", "posterior", "score", "keep"],
            )

    return id_text(docs).mapInArrow(scored, "doc_id long, votes string, posterior double, score double, keep boolean")
