"""Named queries of choice and naming: covers, claims in order, best folders, names in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import allocation, naming
from lacuna.plans.catalogue import query, t


@query("""WITH RECURSIVE o AS (SELECT DISTINCT p_brand, l_suppkey, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT p_brand, 0 AS step, NULL::BIGINT AS l_suppkey, 0::BIGINT AS n_filled, []::BIGINT[] AS done FROM o GROUP BY 1
    UNION ALL SELECT p_brand, step, l_suppkey, n_filled, done FROM (
        SELECT c.p_brand, c.step + 1 AS step, o.l_suppkey, count(*) AS n_filled, list_concat(any_value(c.done), list(o.l_partkey)) AS done,
            row_number() OVER (PARTITION BY c.p_brand ORDER BY count(*) DESC, o.l_suppkey) AS r
        FROM c JOIN o ON o.p_brand = c.p_brand AND NOT list_contains(c.done, o.l_partkey) GROUP BY c.p_brand, c.step, o.l_suppkey) WHERE r = 1)
SELECT p_brand, step, l_suppkey, n_filled FROM c WHERE step > 0""")
def supplier_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each brand, supplier after supplier, each time the one with most of the parts that are left."""
    lines = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    offers = lines.join(t(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("l_partkey")), "l_partkey")
    return allocation.cover(offers, "p_brand", "l_suppkey", "l_partkey").select("p_brand", "step", "l_suppkey", "n_filled").distinct()


@query("""WITH RECURSIVE o AS (SELECT l_suppkey, l_orderkey, max(l_extendedprice) AS worth FROM lineitem GROUP BY ALL),
s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS turn FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM o)),
c AS (SELECT 0::BIGINT AS turn, NULL::BIGINT AS s_suppkey, NULL::BIGINT AS l_orderkey, NULL::DOUBLE AS worth, []::BIGINT[] AS used
    UNION ALL SELECT turn, s_suppkey, l_orderkey, worth, CASE WHEN l_orderkey IS NULL THEN used ELSE list_append(used, l_orderkey) END FROM (
        SELECT s.turn, s.s_suppkey, o.l_orderkey, o.worth, c.used, row_number() OVER (ORDER BY o.worth DESC NULLS LAST, o.l_orderkey) AS r
        FROM c JOIN s ON s.turn = c.turn + 1 LEFT JOIN o ON o.l_suppkey = s.s_suppkey AND NOT list_contains(c.used, o.l_orderkey)) WHERE r = 1)
SELECT s_suppkey, l_orderkey, worth FROM c WHERE l_orderkey IS NOT NULL""")
def supplier_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By falling balance, each supplier in its turn claims the order with its dearest line that no other has claimed."""
    lines = t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.max("l_extendedprice").alias("worth"))
    offers = lines.join(t(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), F.col("l_suppkey") == F.col("s_suppkey"))
    order = [-F.col("s_acctbal"), F.col("s_suppkey"), -F.col("worth"), F.col("l_orderkey")]
    return allocation.allocate(offers, ["s_suppkey"], ["l_orderkey"], order).select("s_suppkey", "l_orderkey", "worth")


@query("""WITH o AS (SELECT p_brand AS release, l_partkey AS song, l_suppkey::VARCHAR AS peer, l_returnflag || l_linestatus AS folder, l_orderkey * 8 + l_linenumber AS file,
    l_discount >= 0.095 AS ctx, l_quantity >= 40 AS preferred, l_linenumber = 1 AS placed, l_quantity::BIGINT AS quality, l_suppkey % 3 AS health FROM lineitem JOIN part ON l_partkey = p_partkey),
b AS (SELECT DISTINCT ON (release, peer, folder, song) * FROM o ORDER BY release, peer, folder, song, file),
k AS (SELECT release, count(DISTINCT song) AS known FROM o GROUP BY 1),
f AS (SELECT release, peer, folder, bool_or(ctx) AS ctx, count(*) FILTER (preferred) AS preferred, count(*) AS n, count(*) FILTER (placed) AS placed, min(health) AS health, sum(quality) AS quality FROM b GROUP BY ALL),
r AS (SELECT release, peer, folder, row_number() OVER (PARTITION BY release ORDER BY ctx DESC, preferred DESC, n DESC, CASE WHEN known > 1 OR ctx THEN placed ELSE 0 END DESC, health, quality DESC, peer, folder) AS place FROM f JOIN k USING (release))
SELECT release, song, peer, folder, file FROM b JOIN r USING (release, peer, folder) QUALIFY row_number() OVER (PARTITION BY release, song ORDER BY place) = 1""")
def best_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part of a brand from the first folder (a supplier's lines of one status) that has it, folders ordered as a whole."""
    lines = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("l_partkey")), "l_partkey")
    file = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    offers = lines.select(
        F.col("p_brand").alias("release"), F.col("l_partkey").alias("song"), F.col("l_partkey").alias("song_order"), F.col("l_suppkey").cast("string").alias("peer"),
        F.concat("l_returnflag", "l_linestatus").alias("folder"), file.alias("file"), file.alias("rank"), (F.col("l_discount") >= 0.095).cast("int").alias("context"),
        (F.col("l_quantity") >= 40).alias("preferred"), (F.col("l_linenumber") == 1).alias("placed"), (F.col("l_suppkey") % 3).alias("health"), F.col("l_quantity").cast("long").alias("quality"),
    )
    return allocation.best_folders(offers)


KEY = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH d AS (SELECT doc_id, ' ' || {KEY} || ' ' AS key FROM documents), b AS (SELECT item_id, string_split({KEY}, ' ') AS w FROM benchmark),
n AS (SELECT item_id * 4 + k AS name_id, array_to_string(CASE WHEN k = 3 THEN w ELSE w[1 + k:3 + 3 * k] END, ' ') AS name, len(CASE WHEN k = 3 THEN w ELSE w[1 + k:3 + 3 * k] END) AS n_words FROM b, range(4) r(k)),
m AS (SELECT doc_id, name_id, name, n_words FROM d JOIN n ON n_words > 0 AND contains(d.key, ' ' || n.name || ' '))
SELECT doc_id, name_id, n_words FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.doc_id = m.doc_id AND o.n_words > m.n_words AND contains(' ' || o.name || ' ', ' ' || m.name || ' '))""")
def names_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names (parts of 3, 5 and 7 words of benchmark items, and whole ones) stand in which documents, the longest of them."""
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    texts = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), words.alias("words"))
    items = t(spark, sf_dir, "benchmark").select("item_id", words.alias("w"), F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    cut = F.when(F.col("k") == 3, F.col("w")).otherwise(F.slice("w", F.col("k") + 1, 2 * F.col("k") + 3))
    names = items.select((F.col("item_id") * 4 + F.col("k")).alias("name_id"), cut.alias("words"))
    sizes = names.select("name_id", F.size("words").cast("long").alias("n_words"))
    found = naming.longest(naming.find_names(texts, names), names)
    return found.join(sizes, "name_id").select(F.col("text_id").alias("doc_id"), "name_id", "n_words")
