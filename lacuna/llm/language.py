"""Language identification with a byte convolutional network, trained in numpy.

Texts are cut into windows of ``WINDOW`` bytes. Filters of several widths slide over one-hot bytes (a filter is a table of
256 values for each place it covers), each keeps its maximum over the window, and a dense layer with softmax gives the
languages. A text's score is the softmax of the mean of its windows' log-probabilities, over all of its windows.

Training rows: those whose crc32(doc_id as text) mod 3 is not 1 and whose lang is not null. The network is fitted on about
``TRAIN_DOCS`` of them, chosen by a hash of the row, evenly over the languages (equal rows count once). Their whole texts are
cut into windows by the tasks; the driver gets all of these, or the ``TRAIN_WINDOWS`` with the smallest hash if there are more,
so any part of any text may be among them. Each of ``STEPS`` steps draws ``BATCH``. These bounds are the only things about the
network that do not grow with the corpus. All languages are learned.

``identified_documents`` fits on four fifths of the training rows; on all of the others it takes the lowest score of a text
whose language is found, and rejects texts that are more than twice as far from 1 as that one, so that clean texts a little
under it stay. With fewer than ``LEAST_SPARE`` such texts there is no such bound.

Defined results: null text, or text without a letter, is ``und`` with score 0; so is all text if nothing can be learned;
repeated rows give repeated rows; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 128
WIDTHS, FILTERS = (2, 3, 4), 16
TRAIN_DOCS = 3_000
#: Windows that the driver gets, 128 bytes each.
TRAIN_WINDOWS = 150_000
LEAST_SPARE = 50
STEPS, BATCH, RATE, SEED = 800, 64, 0.01, 7
CHUNK = 512
UNDETERMINED = "und"
_PLAIN_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    """Whether a character of the text is a letter by its Unicode category; fractions and raised digits are none."""
    return bool(_PLAIN_LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text))


def windows(raw: bytes) -> np.ndarray:
    """All bytes in windows of fixed length, the last padded with 0."""
    n = -(-len(raw) // WINDOW)
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class Network:
    def __init__(self, filters: list[np.ndarray], bias: np.ndarray, dense: np.ndarray, offset: np.ndarray):
        self.filters, self.bias, self.dense, self.offset = filters, bias, dense, offset



class Scorer:
    """A network with tables by byte pairs, so that a filter takes one look-up for two bytes; a task makes it and drops it."""

    def __init__(self, net: Network):
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(1 << 16, FILTERS)
        self.tables = [[pair(f[t], f[t + 1]) if t + 1 < len(f) else f[t] for t in range(0, len(f), 2)] for f in net.filters]
        self.bias, self.dense, self.offset = net.bias, net.dense, net.offset

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        pairs = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        pooled = []
        for width, tables in zip(WIDTHS, self.tables, strict=True):
            n = WINDOW - width + 1
            total = None
            for t, table in zip(range(0, width, 2), tables, strict=True):
                part = table.take(pairs[:, t : t + n] if len(table) > 256 else x[:, t : t + n], axis=0)
                total = part if total is None else np.add(total, part, out=total)
            pooled.append(total.max(1))
        hidden = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
        logits = hidden @ self.dense + self.offset
        logits -= logits.max(1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def train(x: np.ndarray, y: np.ndarray, classes: int) -> Network:
    """Adam on cross entropy; the gradient of a maximum goes to the place that had it."""
    rng = np.random.default_rng(SEED)
    net = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    net += [np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)).astype(np.float32), np.zeros(classes, np.float32)]
    first, second = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net]
    rows = np.arange(BATCH)
    for step in range(1, STEPS + 1):
        take = rng.integers(0, len(x), BATCH)
        b = x[take]
        pooled, places = [], []
        for k, width in enumerate(WIDTHS):
            n = WINDOW - width + 1
            conv = sum(net[k][t][b[:, t : t + n]] for t in range(width))
            places.append(conv.argmax(1))
            pooled.append(conv.max(1))
        before = np.concatenate(pooled, 1) + net[-3]
        hidden = np.maximum(before, 0)
        logits = hidden @ net[-2] + net[-1]
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[rows, y[take]] -= 1
        p /= BATCH
        back = (p @ net[-2].T) * (before > 0)
        slopes = []
        for k, width in enumerate(WIDTHS):
            g = np.zeros_like(net[k])
            part = back[:, k * FILTERS : (k + 1) * FILTERS]
            for t in range(width):
                np.add.at(g[t], (b[rows[:, None], places[k] + t], np.arange(FILTERS)[None, :]), part)
            slopes.append(g)
        slopes += [back.sum(0), hidden.T @ p, p.sum(0)]
        for q, m, v, g in zip(net, first, second, slopes, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(net[:-3], *net[-3:])


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def _draw(seed: int):
    """A number from 0 to 1 by the row, so rows that share doc_id, or have none, are drawn one by one."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11) / float(1 << 53)


def _training(docs: DataFrame, spare: bool | None = None) -> DataFrame:
    """doc_id, text and lang of training rows: all, or those spared from fitting, or the others."""
    labelled = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    return labelled if spare is None else labelled.filter((_draw(SEED + 1) < 0.2) == F.lit(spare))


def _drawn_windows(chosen: DataFrame, most: int) -> DataFrame:
    """draw, lang, place and window of all windows of the texts, or of the ``most`` with the smallest hash."""

    def cut(batches):
        for batch in batches:
            for draw, lang, text in zip(batch.column("draw").to_pylist(), batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                found = windows(text.as_py().encode())
                for at in range(0, len(found), CHUNK):
                    part = found[at : at + CHUNK]
                    columns = [pa.array([draw] * len(part), pa.float64()), pa.array([lang] * len(part), pa.string()), pa.array(np.arange(at, at + len(part)), pa.int64()), pa.array([w.tobytes() for w in part], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["draw", "lang", "place", "window"])

    every = chosen.select("draw", "lang", "text").mapInArrow(cut, "draw double, lang string, place long, window binary")
    return every.orderBy(F.xxhash64("draw", "lang", "place"), "draw", "lang", "place").limit(most)


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, spare: bool = False, max_windows: int = TRAIN_WINDOWS) -> tuple[list[str], Network] | None:
    """Languages and network, or None where nothing is labelled; with ``spare``, rows are left for calibration."""
    labelled = _training(docs, False if spare else None)
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return None
    langs = sorted(r["lang"] for r in counts)
    each = -(-train_docs // len(langs))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["count"])) for r in counts], "lang string, share double")
    drawn = labelled.withColumn("draw", _draw(SEED)).join(F.broadcast(shares), "lang").filter("draw < share")
    chosen = drawn.select("draw", "text", "lang").dropDuplicates(["draw", "lang"])
    rows = _drawn_windows(chosen, max_windows).toArrow().sort_by([("draw", "ascending"), ("lang", "ascending"), ("place", "ascending")])
    held = rows.column("window").combine_chunks()
    x = np.frombuffer(held.buffers()[2], np.uint8, len(held) * WINDOW).reshape(-1, WINDOW) if len(held) else np.zeros((0, WINDOW), np.uint8)
    place = {lang: k for k, lang in enumerate(langs)}
    y = np.array([place[lang] for lang in rows.column("lang").to_pylist()], np.int64)
    return (langs, train(x, y, len(langs))) if len(x) else None


def _scorer(model: tuple[list[str], Network] | None) -> tuple[list[str], Scorer] | None:
    return (model[0], Scorer(model[1])) if model else None


def _labelled(model: tuple[list[str], Scorer] | None, texts) -> tuple[list[str], list[float]]:
    langs, net = model or ([], None)
    names, scores = [], []
    for x in texts:
        text = x.as_py()
        if net is None or text is None or not has_letter(text):
            names.append(UNDETERMINED)
            scores.append(0.0)
            continue
        w = windows(text.encode())
        total = sum(net.log_probabilities(w[i : i + CHUNK]).sum(0, dtype=np.float64) for i in range(0, len(w), CHUNK)) / len(w)
        p = np.exp(total - total.max())
        k = int(p.argmax())
        names.append(langs[k])
        scores.append(float(p[k] / p.sum()))
    return names, scores


def predict(docs: DataFrame, model: tuple[list[str], Network] | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = _scorer(shared.value)
        for batch in batches:
            names, scores = _labelled(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows of ``docs`` and predict all of its rows."""
    return predict(docs, learn(docs))


def calibrated(docs: DataFrame, model: tuple[list[str], Network] | None) -> float:
    """The bound on scores by all spared training texts whose language is found, or 0 with too few of them."""
    if model is None:
        return 0.0
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = _scorer(shared.value)
        for batch in batches:
            names, scores = _labelled(model, batch.column("text"))
            good = [s for n, s, lang in zip(names, scores, batch.column("lang").to_pylist(), strict=True) if n == lang]
            yield pa.RecordBatch.from_arrays([pa.array(good, pa.float64())], ["score"])

    found = _training(docs, True).select("text", "lang").mapInArrow(run, "score double").agg(F.count("*").alias("n"), F.min("score").alias("low")).first()
    return max(0.0, 1 - 2 * (1 - found["low"])) if found["n"] >= LEAST_SPARE else 0.0


def identified_documents(docs: DataFrame, least_score: float | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that are in a learned language with at least the score, by default the calibrated
    one. No row moves or is joined.

    If nothing can be learned, rows go on that have a letter.
    """
    model = learn(docs, spare=True)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if least_score is None:
        least_score = calibrated(docs, model)

    @F.arrow_udf("boolean")
    def good(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _scorer(shared.value)
        for texts in batches:
            if model:
                names, scores = _labelled(model, texts)
                yield pa.array([n != UNDETERMINED and s >= least_score for n, s in zip(names, scores, strict=True)], pa.bool_())
            else:
                yield pa.array([x.is_valid and has_letter(x.as_py()) for x in texts], pa.bool_())

    # only texts go to Python and only decisions come back
    return docs.filter(good("text"))
