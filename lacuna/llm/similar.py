"""SimHash near duplicates, verified by Jaccard similarity of word shingles, and completed so that no pair is lost to the sketch.

Candidates come first from the operator's byte-position index over fingerprints (``simhash.links``): texts whose fingerprints
differ in 2 bits or fewer. Similarity of ``SIMILARITY`` over 5-word shingles leaves about 10 of 64 bits different, more bits
than there are byte positions, so the index alone can't guarantee such pairs. The rest is found by the same kind of count
filter on the shingles themselves. Of two sets with similarity 4/5 or more, each has a common element among its first
n - ceil(4n/5) + 1 ones in whatever order all sets share. Shingles are ordered by how often a sample of fixed size holds them
(rare ones first), then by hash, so the sample decides on the work and never on the result. Texts with the same words are one
form; an inverted index from the first shingles to forms gives candidates, of which lengths and places in the order leave
those that can reach the similarity and whose fingerprints are within ``RADIUS`` bits (the chance that this loses a pair is
given there; every other step is exact).

Candidates are taken in passes: those of the fingerprints and each form with the smallest one of each posting; then, while large
postings hold rows outside their most frequent group, each such row with one row of that group, another one each turn; at last
all that stands in one posting and is not connected yet. So large groups of near copies are not expanded into pairs, and the
last pass loses no pair; of its pairs, the parities of both sets' hashes leave out those that differ in too many elements (an
exact bound). Each candidate is verified on the hashes of all its shingles.

Defined results: words are cut at white space and lower-cased in ASCII; a text of fewer words than a shingle has is one
shingle; null and wordless texts are one form. Of each group exactly one row is kept, whatever doc_ids repeat: the one with
the smallest doc_id, rows without doc_id last, then by a hash of all columns. Forms, shingles and rows are told apart by
64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import simhash
from lacuna.llm.common import arrow_batches, numbered
from lacuna.llm.repeats import Filter, _filter
from lacuna.operators.components import connected_components
from lacuna.operators.lineage import written
from lacuna.operators.skew import HOT, join_per_key

WORDS, SIMILARITY = 5, (4, 5)
SAMPLE, LEAST_HELD, MOST_HOT = 4_000, 3, 100_000
#: Forms that a task remembers, so as not to describe copies again; bounds memory, not results.
MET = 200_000
#: A posting is large if its rows outside the most frequent group make more pairs with all of its rows. Decides on the order of
#: the work, not on its result.
LARGE = 1_024
#: Turns are taken while large postings hold more pairs for each posting. Decides on the order of the work, not on its result.
PAIRS_EACH = 1
#: Forms on either side of a tile of pairs, on average at most.
TILE = 256
#: Candidates whose fingerprints differ in more bits are not similar: at a similarity of 0.8, 9.7 of 64 bits differ on average,
#: and more than this at a chance of 3 in a million. Fingerprints here are of distinct shingles, so lines that a text repeats do
#: not move them. Sets of fewer shingles are not judged by their fingerprints.
RADIUS, LEAST_FOR_RADIUS = 24, 40
#: Words of 64 bits of a form's parities: bit b says whether an odd number of its shingles has hash b in this range.
PARITIES = 4
#: Rows that go to Python at once.
BATCH = 2_000
#: Pairs that a task keeps to leave out repeats. Bounds memory, not results.
PAIRS_KEPT = 1_000_000


def shingles(text: str | None, words_each: int = WORDS) -> set[bytes]:
    """The set of shingles of a text."""
    words = (text or "").encode().lower().split()
    n = max(1, len(words) - words_each + 1) if words else 0
    return {b" ".join(words[i : i + words_each]) for i in range(n)}


def similar(a: set, b: set) -> bool:
    num, den = SIMILARITY
    return den * (both := len(a & b)) >= num * (len(a) + len(b) - both)


def _form(text: str | None) -> int:
    """Of the words of a text, in their order."""
    import xxhash

    form = xxhash.xxh64_intdigest(b" ".join((text or "").encode().lower().split()), simhash.SEED)
    return form - (form >> 63 << 64)


def _can_reach(n, pos, n2, pos2):
    """Whether sets of these sizes whose first common element is at these places can be similar; for columns.

    Similar sets pass at their first common element, and what they share after it need not pass again.
    """
    num, den = SIMILARITY
    most = 1 + F.least(n - pos - 1, n2 - pos2 - 1)
    return (den * n >= num * n2) & (den * n2 >= num * n) & ((num + den) * most >= num * (n + n2))


def _parities(hashes: np.ndarray, words: int = PARITIES) -> np.ndarray:
    """Whether an odd number of the hashes falls on each bit, as signed words. Two sets differ in as many elements at least as
    their parities differ in bits, since elements of both sets cancel out."""
    odd = np.bincount((hashes % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sketch(hashes: np.ndarray) -> bytes:
    """The number of hashes and their parities, about a bit or two for each hash: a large set needs more bits than a small one."""
    words = max(PARITIES, 1 << max(0, len(hashes) - 1).bit_length() >> 6)
    return len(hashes).to_bytes(8, "little") + _parities(hashes, words).tobytes()


def _sketches_allow(a: bytes, b: bytes) -> bool:
    """Whether sketches leave it open that two sets are similar (an exact bound, see ``_differ_little``)."""
    x, y = (np.frombuffer(v, np.uint64, offset=8) for v in (a, b))
    while len(x) != len(y):  # bits that coincide under fewer words cancel out
        x, y = (v.reshape(2, -1)[0] ^ v.reshape(2, -1)[1] if len(v) == max(len(x), len(y)) else v for v in (x, y))
    num, den = SIMILARITY
    n = int.from_bytes(a[:8], "little") + int.from_bytes(b[:8], "little")
    return (den + num) * int(np.bitwise_count(x ^ y).sum()) <= (den - num) * n


def _sets_similar(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    common = len(np.intersect1d(x, y, assume_unique=True))
    num, den = SIMILARITY
    return den * common >= num * (len(x) + len(y) - common)


def _keyed(docs: DataFrame) -> tuple[DataFrame, list]:
    """The rows under names that no step uses, with doc_id, text and a key of the whole row; and their columns as they were."""
    rows, (doc_id, text), named = numbered(docs, "doc_id", "text")
    key = F.xxhash64(*[x for c in rows.columns for x in (F.col(c), F.col(c).isNull())])
    return rows.withColumns({"__key": key, "doc_id": doc_id, "text": text}), named


def _often(keyed: DataFrame, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (hashes, sorted) that several texts of the sample hold, with their number of texts."""
    share = SAMPLE / max(1, keyed.count())
    sample = keyed.filter(F.pmod("__key", F.lit(1 << 20)) < F.lit(share * (1 << 20)))

    def run(batches):
        for batch in batches:
            parts = [np.unique(simhash.shingle_hashes(x.as_py() or "", words_each)) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64) if parts else [], pa.int64())], ["hash"])

    held = sample.select("text").mapInArrow(run, "hash long").groupBy("hash").count().filter(F.col("count") >= LEAST_HELD)
    got = held.orderBy(F.desc("count"), "hash").limit(MOST_HOT).toArrow()
    hashes, n = got.column("hash").to_numpy().view(np.uint64), got.column("count").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def _marks(keyed: DataFrame, words_each: int) -> DataFrame:
    """key, doc_id, form, n (shingles) for every row; fingerprint, parities, sketch and first shingles of each form once in a task at least."""
    shared = keyed.sparkSession.sparkContext.broadcast(_often(keyed, words_each))
    num, den = SIMILARITY

    def run(batches):
        hot, held = shared.value
        met = set()
        for batch in batches:
            forms, sizes, prints, odd, sketches, firsts = [], [], [], [], [], []
            for x in batch.column("text"):
                text = x.as_py() or ""
                form, every = _form(text), simhash.shingle_hashes(text, words_each)
                found = np.unique(every)
                n = len(found)
                forms.append(form)
                sizes.append(n)
                if form in met or not n:
                    prints.append(None)
                    odd.append(None)
                    sketches.append(None)
                    firsts.append(None)
                    continue
                if len(met) >= MET:
                    met.clear()
                met.add(form)
                prints.append(simhash.majority(found))
                odd.append(_parities(found))
                sketches.append(_sketch(found))
                often = np.zeros(n, np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
                    often = np.where(hot[at] == found, held[at], 0)
                firsts.append(found[np.lexsort((found, often))][: n - -(-num * n // den) + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("doc_id"), pa.array(forms, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(odd, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))], ["key", "doc_id", "form", "n", "fp", "odd", "sketch", "firsts"])

    rows = keyed.select("__key", F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = written(rows.mapInArrow(run, "key long, doc_id long, form long, n long, fp long, odd array<long>, sketch binary, firsts array<long>"))
    shared.destroy()
    return marks


def _hot(counted: DataFrame) -> np.ndarray:
    """The hashes (at most ``HOT``, sorted) of postings that hold more than one in ``HOT`` of all rows."""
    total = counted.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    return np.sort(counted.filter(F.col("count") * HOT > max(total, HOT)).select("hash").toArrow().column("hash").to_numpy())


def _postings(marks: DataFrame) -> DataFrame:
    """form, n, fp, and hashes with pos: a form's first shingles that other forms have among theirs (a few others may stay), a
    row for the hot ones and one for the others. Lists of a form are shuffled with what belongs to it once, rows are not.

    First only the hashes are counted; a filter of fixed size then keeps the other postings from any shuffle.
    """
    counted = written(marks.select(F.explode("firsts").alias("hash")).groupBy("hash").count().filter("count > 1"))
    known = marks.sparkSession.sparkContext.broadcast((_filter(counted, "hash").words, _hot(counted)))

    def run(batches):
        words, hottest = known.value
        shared = Filter(words)
        for batch in batches:
            lists = batch.column("firsts")
            sizes, hashes = np.diff(lists.offsets.to_numpy()), lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            stays, hot = shared.has(hashes.view(np.uint64)), np.isin(hashes, hottest)
            for kind in (True, False):
                at = np.flatnonzero(stays & (hot == kind))
                has, n = np.unique(row[at], return_counts=True)
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                of = [batch.column(c).to_numpy()[has] for c in ("form", "n", "fp")]
                held = [pa.ListArray.from_arrays(ends, pa.array(x[at])) for x in (hashes, pos)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(has), kind)), *map(pa.array, of), *held], ["hot", "form", "n", "fp", "hashes", "places"])

    described = marks.filter("firsts is not null").select("form", "n", "fp", "firsts")
    found = written(described.mapInArrow(run, "hot boolean, form long, n long, fp long, hashes array<long>, places array<long>"))
    known.destroy()
    return found


def _rows(lists: DataFrame, hot: bool) -> DataFrame:
    """hash, form, n, pos, fp (and the label) of these postings."""
    more = [c for c in lists.columns if c == "label"]
    each = lists.filter(F.col("hot") == hot).select("form", "n", "fp", *more, F.explode(F.arrays_zip("hashes", "places")).alias("x"))
    return each.select(F.col("x.hashes").alias("hash"), "form", "n", F.col("x.places").alias("pos"), "fp", *more)


def _whole_postings(batches, columns: list[str]):
    """Arrays of the columns for as many whole postings as there are in rows sorted by hash."""
    held = None
    for batch in batches:
        if batch.num_rows:
            rows = {c: batch.column(c).to_numpy() for c in columns}
            rows = rows if held is None else {c: np.concatenate([held[c], rows[c]]) for c in columns}
            last = int(np.searchsorted(rows["hash"], rows["hash"][-1]))
            held = {c: x[last:] for c, x in rows.items()}
            if last:
                yield {c: x[:last] for c, x in rows.items()}
    if held is not None:
        yield held


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _are_able(rows: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As ``_able``, for rows at places x and y of these arrays."""
    num, den = SIMILARITY
    (n, pos, fp), (n2, pos2, fp2) = ([rows[c][at] for c in ("n", "pos", "fp")] for at in (x, y))
    most = 1 + np.minimum(n - pos - 1, n2 - pos2 - 1)
    near = np.bitwise_count((fp ^ fp2).view(np.uint64)) <= RADIUS
    return (den * n >= num * n2) & (den * n2 >= num * n) & ((num + den) * most >= num * (n + n2)) & (near | (np.minimum(n, n2) < LEAST_FOR_RADIUS))


def _able(x: str, y: str):
    """Whether two postings (prefixes of their columns) of one hash may belong to similar forms."""
    n, n2 = F.col(f"{x}n"), F.col(f"{y}n")
    near = F.bit_count(F.col(f"{x}fp").bitwiseXOR(F.col(f"{y}fp"))) <= RADIUS
    return _can_reach(n, F.col(f"{x}pos"), n2, F.col(f"{y}pos")) & (near | (F.least(n, n2) < LEAST_FOR_RADIUS))


def _stars(postings: DataFrame) -> DataFrame:
    """Candidates (a, b, g): the smallest form of each posting with each other one, and the posting."""
    head = F.min(F.struct("form", "n", "pos", "fp")).alias("first")
    heads = postings.groupBy("hash").agg(head, F.max("form").alias("last"), F.count("*").alias("rows")).filter("first.form < last")
    heads = heads.select("hash", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("form", "n", "pos", "fp")], "rows")
    met = join_per_key(postings, heads, "hash", postings.count(), "rows")
    return met.filter((F.col("form") != F.col("first_form")) & _able("", "first_")).select(F.col("first_form").alias("a"), F.col("form").alias("b"), F.col("hash").alias("g"))


def _stars_dealt(postings: DataFrame) -> DataFrame:
    """As ``_stars``, for postings none of which is hot: each is dealt to a task whole, once."""

    def run(batches):
        for rows in _whole_postings(batches, ["hash", "form", "n", "pos", "fp"]):
            starts, form = _starts(rows["hash"]), rows["form"]
            head = np.repeat(starts, np.diff(np.append(starts, len(form))))
            at = np.flatnonzero((form != form[head]) & _are_able(rows, head, np.arange(len(form))))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (form[head[at]], form[at], rows["hash"][at])], ["a", "b", "g"])

    return postings.repartition("hash").sortWithinPartitions("hash", "form").mapInArrow(run, "a long, b long, g long")


def _labelled(lists: DataFrame, links: DataFrame) -> DataFrame:
    """The lists with the group that each form belongs to by the links so far."""
    label = connected_components(links)
    rows = lists.join(label, lists.form == label.node, "left")
    return written(rows.select("hot", "form", "n", "fp", F.coalesce("component", "form").alias("label"), "hashes", "places"))


def _mixed_dealt(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For postings none of which is hot, each dealt to a task whole, once: candidates (a, b, g) of different groups in those
    that are not large, of each row outside the most frequent group with all rows; and as ``_mixed`` the rows of large ones."""
    names, most_pairs = ["hash", "form", "n", "pos", "fp", "label", "most", "size", "outside", "other"], LARGE
    schema = pa.schema([(c, pa.int64()) for c in names])

    def pairs_of(found: list[tuple]) -> pa.RecordBatch:
        a, b, g = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((b, a))
        at = order[_starts(a[order], b[order])] if len(a) else order
        got = {"hash": g[at], "form": a[at], "other": b[at]}
        return pa.RecordBatch.from_arrays([pa.array(got[c]) if c in got else pa.nulls(len(at), pa.int64()) for c in names], schema=schema)

    def run(batches):
        found, kept = [], 0
        for rows in _whole_postings(batches, names[:6]):
            hashes, form, label = rows["hash"], rows["form"], rows["label"]
            starts, of_label = _starts(hashes), _starts(hashes, label)
            held, first = np.diff(np.append(of_label, len(form))), np.searchsorted(of_label, starts)
            size, top, labels = np.diff(np.append(starts, len(form))), np.maximum.reduceat(held, first), np.diff(np.append(first, len(held)))
            is_top = np.flatnonzero(held == np.repeat(top, labels))
            most = label[of_label[is_top[np.searchsorted(is_top, first)]]]
            outside, post = size - top, np.repeat(np.arange(len(starts)), size)
            large = (labels > 1) & (outside * size > most_pairs)
            x = np.flatnonzero((label != most[post]) & ~large[post])
            each = size[post[x]]
            y = np.arange(each.sum()) + np.repeat(starts[post[x]] - np.cumsum(each) + each, each)
            x = np.repeat(x, each)
            at = np.flatnonzero(label[x] != label[y])
            at = at[_are_able(rows, x[at], y[at])]
            found.append((np.minimum(form[x[at]], form[y[at]]), np.maximum(form[x[at]], form[y[at]]), hashes[x[at]]))
            kept += len(at)
            if kept >= PAIRS_KEPT:
                yield pairs_of(found)
                found, kept = [], 0
            at = np.flatnonzero(large[post])
            if len(at):
                more = [most[post[at]], size[post[at]], outside[post[at]]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in [rows[c][at] for c in names[:6]] + more] + [pa.nulls(len(at), pa.int64())], schema=schema)
        if kept:
            yield pairs_of(found)

    dealt = _rows(labelled, False).repartition("hash").sortWithinPartitions("hash", "label")
    found = written(dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names)))
    pairs = found.filter("other is not null").groupBy(F.col("form").alias("a"), F.col("other").alias("b")).agg(F.min("hash").alias("g"))
    return written(pairs), found.filter("other is null").drop("other")


def _mixed(labelled: DataFrame, total: int) -> DataFrame:
    """The rows of postings of several groups, with the posting's most frequent one, its number of rows and of those outside it."""
    per = labelled.groupBy("hash", "label").agg(F.count("*").alias("held")).groupBy("hash")
    mixed = per.agg(F.max_by("label", "held").alias("most"), F.max("held").alias("top"), F.count("*").alias("labels"), F.sum("held").alias("rows"))
    mixed = written(mixed.filter("labels > 1").select("hash", "most", "rows", F.col("rows").alias("size"), (F.col("rows") - F.col("top")).alias("outside")))
    return written(join_per_key(labelled.select("hash", "form", "n", "pos", "fp", "label"), mixed, "hash", total, "rows"))


def _is_large():
    """Of rows of mixed postings: by the pairs of rows outside the most frequent group with all rows."""
    return F.col("outside") * F.col("size") > LARGE


def _tied(rows: DataFrame, links: DataFrame) -> DataFrame:
    """node, component: the groups that links of forms among these rows make of their groups so far."""
    of = rows.select("form", "label").distinct()
    ends = links.join(of.select(F.col("form").alias("a"), F.col("label").alias("x")), "a").join(of.select(F.col("form").alias("b"), F.col("label").alias("y")), "b")
    return written(connected_components(ends.select("x", "y"), "x", "y"))


def _regrouped(rows: DataFrame, groups: DataFrame, *labels: str) -> DataFrame:
    """The rows with what became of the groups in these columns."""
    for c in labels:
        rows = rows.join(groups.select(F.col("node").alias(c), "component"), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
    return rows


def _turn(large: DataFrame, turn: int, total: int) -> DataFrame:
    """Candidates (a, b, g) of large postings: each row outside the most frequent group with one row of it, by the turn."""
    head = F.min_by(F.struct("form", "n", "pos", "fp"), F.xxhash64("form", "hash", F.lit(turn))).alias("first")
    heads = large.filter("label = most").groupBy("hash").agg(head, F.first("size").alias("rows"))
    heads = heads.select("hash", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("form", "n", "pos", "fp")], "rows")
    met = join_per_key(large.filter("label <> most"), heads, "hash", total, "rows").filter(_able("", "first_"))
    ends = met.select(F.least("form", "first_form").alias("a"), F.greatest("form", "first_form").alias("b"), "hash")
    return ends.groupBy("a", "b").agg(F.min("hash").alias("g"))


def _differ_little(x: str, y: str):
    """Whether parities (prefixes of columns) leave it open that two forms are similar: sets of similarity 4/5 and sizes n and
    n2 differ in (n + n2) / 9 elements at most."""
    num, den = SIMILARITY
    bits = sum((F.bit_count(F.col(f"{x}odd{i}").bitwiseXOR(F.col(f"{y}odd{i}"))) for i in range(PARITIES)), F.lit(0))
    return (den + num) * bits <= (den - num) * (F.col(f"{x}n") + F.col(f"{y}n"))


def _between(mixed: DataFrame, parities: DataFrame) -> DataFrame:
    """Candidates (a, b, g) that stand in one posting under different labels, and the largest such posting.

    Of a posting, only the rows outside its most frequent label are joined with all rows, so a large group that is connected
    already is never paired with itself.
    """
    rows = written(mixed.join(parities, "form"))
    columns = ("form", "n", "pos", "fp", "label", *parities.columns[1:])
    x = rows.filter("label <> most").select("hash", "size", *[F.col(c).alias(f"x_{c}") for c in columns])
    y = rows.select("hash", *[F.col(c).alias(f"y_{c}") for c in columns])
    met = x.join(y, (x["hash"] == y["hash"]) & (F.col("x_label") != F.col("y_label")) & _able("x_", "y_") & _differ_little("x_", "y_"))
    met = met.select(F.least("x_form", "y_form").alias("a"), F.greatest("x_form", "y_form").alias("b"), F.struct(-F.col("size"), x["hash"].alias("hash")).alias("of"))
    return met.groupBy("a", "b").agg(F.min("of").alias("of")).select("a", "b", F.col("of.hash").alias("g"))


def _linked(lists: DataFrame, stars: DataFrame, keyed: DataFrame, marks: DataFrame, firsts: DataFrame, parities: DataFrame, words_each: int) -> DataFrame:
    """Verified links (a, b) that connect all similar forms, from the first candidates on.

    Turns go on while the pairs left in large postings outnumber the postings and a turn took a quarter of them or more. A turn
    reads and joins the rows of large postings only; those of the others just learn what became of their groups, and pairs of
    those that are not hot are known before the first turn.
    """
    total, tried, turn, before = lists.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0], stars.select("a", "b"), 0, None
    links = _verified(stars, keyed, marks, firsts, words_each)
    labelled = _labelled(lists, links)
    pairs_left, dealt = _mixed_dealt(labelled)
    rows = _mixed(_rows(labelled, True), total).unionByName(dealt)
    small, large = rows.filter(~_is_large()), rows.filter(_is_large())
    while True:
        pairs = large.filter(_is_large()).agg(F.coalesce(F.sum("outside"), F.lit(0))).first()[0]
        if pairs <= PAIRS_EACH * total or (before is not None and 4 * pairs > 3 * before):
            break
        found = written(_turn(large.filter(_is_large()), turn, total).join(tried, ["a", "b"], "left_anti"))
        more = _verified(found, keyed, marks, firsts, words_each)
        groups = _tied(large, more)
        small, large = _regrouped(small, groups, "label", "most"), _mixed(written(_regrouped(large, groups, "label")), total)
        links, tried, turn, before = links.union(more), tried.union(found.select("a", "b")), turn + 1, pairs
    if turn:
        pairs_left = _apart(pairs_left, connected_components(links))
    every = _between(small.unionByName(large), parities).union(pairs_left).groupBy("a", "b").agg(F.min("g").alias("g"))
    rest = written(every.join(tried, ["a", "b"], "left_anti"))
    return links.union(_verified(rest, keyed, marks, firsts, words_each))


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b, g) whose ends are not in one group."""
    for c in ("a", "b"):
        pairs = pairs.join(groups.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")), c, "left")
    return pairs.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b", "g")


def _tiled(pairs: DataFrame) -> DataFrame:
    """The pairs with their tile: about ``TILE`` forms of a group on either side, so that a tile's sets fit a task."""
    sizes = pairs.groupBy("g").agg(F.count_distinct("a").alias("a_forms"), F.count_distinct("b").alias("b_forms"), F.count("*").alias("n"))
    met = join_per_key(pairs, sizes, "g", pairs.count())
    part = lambda c: F.pmod(F.xxhash64(c), F.ceil(F.col(f"{c}_forms") / TILE))
    return met.select("a", "b", F.xxhash64("g", part("a"), part("b")).alias("tile"))


def _compared(held: DataFrame, tiled: DataFrame, good) -> DataFrame:
    """Those of the pairs (tile, a, b) for which ``good`` is true of both forms' data, held as (tile, form, data): a form's data
    go once to each tile that has pairs of it, and a task reads tile after tile, first the data and then the pairs."""
    no_data, no_form = F.lit(None).cast("binary").alias("data"), F.lit(0).cast("long").alias("b")
    both = held.select("tile", F.lit(0).alias("kind"), F.col("form").alias("a"), no_form, "data").union(tiled.select("tile", F.lit(1), "a", "b", no_data))

    def run(batches):
        of, known = None, {}
        for batch in batches:
            found, data = [], batch.column("data")
            for i, (tile, kind, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tile", "kind", "a", "b")), strict=True)):
                if tile != of:
                    of, known = tile, {}
                if kind == 0:
                    known[a] = data[i].as_py()
                elif good(known[a], known[b]):
                    found.append((tile, a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], ["tile", "a", "b"])

    return written(both.repartition("tile").sortWithinPartitions("tile", "kind").mapInArrow(run, "tile long, a long, b long"))


def _needed(tiled: DataFrame) -> DataFrame:
    """tile and form, for both ends of the pairs."""
    return tiled.select("tile", F.col("a").alias("form")).union(tiled.select("tile", "b")).distinct()


def _verified(pairs: DataFrame, keyed: DataFrame, marks: DataFrame, firsts: DataFrame, words_each: int) -> DataFrame:
    """Those of the pairs that are similar, by all their shingles.

    Sketches come first, a sixty-fourth of a set or two: most pairs that are not similar differ in more bits than similar ones
    can, so their sets stay where they are. Filters of fixed size keep other sketches and texts from the joins.
    """
    context = keyed.sparkSession.sparkContext
    tiled = written(_tiled(pairs))
    need = _needed(tiled)
    known = context.broadcast(_filter(need.select("form").distinct(), "form").words)

    def asked(batches):
        forms = Filter(known.value)
        for batch in batches:
            yield batch.filter(pa.array(forms.has(batch.column("form").to_numpy().view(np.uint64))))

    sketches = marks.filter("sketch is not null").select("form", F.col("sketch").alias("data")).mapInArrow(asked, "form long, data binary")
    tiled = _compared(sketches.join(need, "form"), tiled, _sketches_allow)
    known.destroy()

    need = _needed(tiled)
    wanted = need.select("form").distinct().join(firsts, "form").select(F.col("first.key").alias("__key"))
    known = context.broadcast(_filter(wanted, "__key").words)

    def sieve(batches):
        known_keys, met = Filter(known.value), set()
        for batch in batches:
            keys = batch.column("__key").to_numpy()
            at = [i for i in np.flatnonzero(known_keys.has(keys.view(np.uint64))).tolist() if keys[i] not in met]
            if len(met) > MET:
                met.clear()
            met.update(keys[at].tolist())
            texts = [batch.column("text")[i].as_py() or "" for i in at]
            found = [np.unique(simhash.shingle_hashes(x, words_each)).tobytes() for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array([_form(x) for x in texts], pa.int64()), pa.array(found, pa.binary())], ["form", "data"])

    # What the filter lets pass besides the first row of each form that is needed only repeats a form, or meets no tile.
    held = keyed.select("__key", "text").mapInArrow(sieve, "form long, data binary")
    found = _compared(held.join(need, "form"), tiled, _sets_similar)
    known.destroy()
    return found.select("a", "b")


def _by_fingerprint(marks: DataFrame) -> DataFrame:
    """Candidates (a, b, g): forms with the smallest form of their fingerprint, and these where fingerprints are linked."""
    prints = marks.filter("fp is not null").select("fp", "form").distinct()
    least = written(prints.groupBy("fp").agg(F.min("form").alias("least"), F.count("*").alias("n")))
    same = join_per_key(prints, least, "fp", prints.count()).select(F.col("least").alias("a"), F.col("form").alias("b"))
    linked = simhash.links(least.select("fp").repartition(int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp"))
    ends = linked.join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    return same.union(ends.select("x", "y")).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("a").alias("g"))


def _doubtful(keyed: DataFrame, words_each: int) -> DataFrame:
    """__key of the rows that go (stays: null) and of those that are repeated whole; all other rows stay where they are."""
    marks = _marks(keyed, words_each)
    firsts = marks.groupBy("form").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    lists = _postings(marks)
    stars = written(_stars(_rows(lists, True)).union(_stars_dealt(_rows(lists, False))).union(_by_fingerprint(marks)).groupBy("a", "b").agg(F.min("g").alias("g")))
    parities = marks.filter("odd is not null").groupBy("form").agg(F.first("odd").alias("odd")).select("form", *[F.col("odd")[i].alias(f"odd{i}") for i in range(PARITIES)])
    parts = connected_components(_linked(lists, stars, keyed, marks, firsts, parities, words_each))
    rooted = firsts.join(parts, firsts.form == parts.node, "left").select("first", F.coalesce("component", "form").alias("root"))
    chosen = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("key"))
    rows = marks.groupBy("key").agg(F.count("*").alias("n")).join(chosen.withColumn("stays", F.lit(True)), "key", "left")
    return written(rows.filter("stays is null or n > 1").select(F.col("key").alias("__key"), "stays"))


def kept(docs: DataFrame, words_each: int = WORDS) -> DataFrame:
    """Exactly one row of each group of similar documents, all columns as they are."""
    keyed, named = _keyed(docs)
    with arrow_batches(docs.sparkSession, BATCH):
        doubtful = _doubtful(keyed, words_each)
    known = docs.sparkSession.sparkContext.broadcast(_filter(doubtful, "__key").words)

    @F.arrow_udf("boolean")
    def doubted(keys: pa.Array) -> pa.Array:
        return pa.array(Filter(known.value).has(keys.to_numpy().view(np.uint64)))

    # only keys go to Python, the rows stay where they are
    unsure = keyed.filter(doubted("__key")).join(doubtful.withColumn("__in", F.lit(True)), "__key", "left")
    sure, once = unsure.filter("__in is null"), unsure.filter("stays").dropDuplicates(["__key"])
    return keyed.filter(~doubted("__key")).unionByName(sure.drop("stays", "__in")).unionByName(once.drop("stays", "__in")).select(*named)
