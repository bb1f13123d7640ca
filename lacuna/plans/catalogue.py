"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.functions import text as titles
from lacuna.operators import gaps, matching, ranking
from lacuna.operators.components import shared_components
from lacuna.operators.likeness import like_pairs
from lacuna.operators.lineage import shared_folder
from lacuna.streaming import state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_quantity >= 48)")
def parts_without_large_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no line of 48 pieces or more holds."""
    part, lines = t(spark, sf_dir, "part"), t(spark, sf_dir, "lineitem").filter("l_quantity >= 48")
    return part.join(lines, part.p_partkey == lines.l_partkey, "left_anti").select("p_partkey", "p_name")


@query("""SELECT coalesce(u.k, f.k) AS custkey, CASE WHEN u.k IS NOT NULL AND f.k IS NOT NULL THEN 'found' WHEN u.k IS NOT NULL THEN 'missing' ELSE 'extra' END AS status
FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') u FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') f ON u.k = f.k""")
def urgent_against_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with urgent orders against customers with filled ones: all three statuses occur."""
    orders = t(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey")
    return gaps.reconciled(orders.filter("o_orderpriority = '1-URGENT'").select("custkey"), orders.filter("o_orderstatus = 'F'").select("custkey"), "custkey")


@query("""SELECT custkey FROM ((SELECT o_custkey AS custkey FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')
UNION (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'))""")
def urgent_or_low_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with urgent or low orders, but not both."""
    orders = t(spark, sf_dir, "orders")
    urgent, low = (orders.filter(F.col("o_orderpriority") == p).select(F.col("o_custkey").alias("custkey")) for p in ("1-URGENT", "5-LOW"))
    return urgent.subtract(low).union(low.subtract(urgent))


LINE_ORDER = ["l_quantity", "l_extendedprice", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
SQL_LINE_ORDER = "l_quantity, l_extendedprice, l_partkey, l_suppkey, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query("""SELECT k.l_orderkey, n.i::INT AS l_linenumber FROM (SELECT l_orderkey, max(l_linenumber) AS top FROM lineitem GROUP BY 1) k, LATERAL (SELECT unnest(range(1, k.top + 1)) AS i) n
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = k.l_orderkey AND l.l_linenumber = n.i)""")
def missing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.missing_numbers(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, count(DISTINCT l_linenumber) FILTER (l_linenumber >= 1) AS held, max(l_linenumber)::BIGINT AS expected, greatest(expected - held, 0)::BIGINT AS missing, held * 100 / expected::DOUBLE AS percent,
CASE WHEN held >= expected THEN 'complete' WHEN held > 0 THEN 'partial' ELSE 'missing' END AS status FROM lineitem GROUP BY 1""")
def completion_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.completion(t(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("""SELECT coalesce(c.k, o.k) AS custkey, CASE WHEN c.k IS NOT NULL AND o.k IS NOT NULL THEN 'found' WHEN c.k IS NOT NULL THEN 'missing' ELSE 'extra' END AS status
FROM (SELECT DISTINCT c_custkey AS k FROM customer) c FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c.k = o.k""")
def held_missing_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.reconciled(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")), t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey")), "custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@query(f"""SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_extendedprice DESC, {SQL_LINE_ORDER}) = 1""")
def best_row_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("l_quantity"), F.desc("l_extendedprice"), *LINE_ORDER]
    return ranking.top_rows(t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey", "l_suppkey")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("e"))
    return rows.select("user_id", "e.*")


@query("""SELECT key, min(doc_id) AS doc_id, count(*) AS n_copies FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS key FROM (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)) GROUP BY 1""")
def dedupe_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    return t(spark, sf_dir, "documents").groupBy(key.alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


@query("""SELECT o_custkey, o_orderpriority AS priority, n AS n_votes FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1""")
def edition_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = t(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n_votes"))
    return ranking.top_rows(votes, ["o_custkey"], [F.desc("n_votes"), F.col("o_orderpriority")]).select("o_custkey", F.col("o_orderpriority").alias("priority"), "n_votes")


@query("""SELECT l_orderkey, l_suppkey, n AS n_lines, 2 * n > total AS majority FROM (SELECT l_orderkey, l_suppkey, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_orderkey) AS total FROM lineitem GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_suppkey) = 1""")
def dominant_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n_lines"))
    per = per.withColumn("total", F.sum("n_lines").over(Window.partitionBy("l_orderkey")))
    return ranking.top_rows(per, ["l_orderkey"], [F.desc("n_lines"), F.col("l_suppkey")]).select("l_orderkey", "l_suppkey", "n_lines", (2 * F.col("n_lines") > F.col("total")).alias("majority"))


@query("""SELECT l_orderkey, count(*) AS n_nations, max(n) AS most, sum(n)::BIGINT AS total FROM (SELECT l_orderkey, s_nationkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 1 AND 2 * max(n) <= sum(n)""")
def majority_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, suppliers = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    per = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).groupBy("l_orderkey", "s_nationkey").agg(F.count("*").alias("n"))
    return per.groupBy("l_orderkey").agg(F.count("*").alias("n_nations"), F.max("n").alias("most"), F.sum("n").alias("total")).filter("n_nations > 1 and 2 * most <= total")


@query("""SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types, bool_and(p_size > 0) AS all_sized, min(p_size) AS least, max(p_size) AS most, count(*) AS n_parts FROM part GROUP BY 1""")
def grouped_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").groupBy("p_brand").agg(F.concat_ws("|", F.array_sort(F.collect_set("p_type"))).alias("types"), F.bool_and(F.col("p_size") > 0).alias("all_sized"), F.min("p_size").alias("least"), F.max("p_size").alias("most"), F.count("*").alias("n_parts"))


@query("SELECT p_brand, count(DISTINCT p_type) AS n_types FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def inconsistent_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").groupBy("p_brand").agg(F.countDistinct("p_type").alias("n_types")).filter("n_types > 1")


@query("""SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '|' || p_brand END AS natural_key FROM part JOIN (SELECT p_name, count(DISTINCT p_brand) AS n FROM part GROUP BY 1) USING (p_name)""")
def natural_key_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    brands = part.groupBy("p_name").agg(F.countDistinct("p_brand").alias("n"))
    return part.join(brands, "p_name").select("p_partkey", F.when(F.col("n") == 1, F.col("p_name")).otherwise(F.concat_ws("|", "p_name", "p_brand")).alias("natural_key"))


@query("""SELECT user_id, island::BIGINT AS island, count(*) AS n_events, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM
(SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 14400000000 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY 1, 2 HAVING count(*) >= 3""")
def bulk_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.bursts(t(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "ts", 4 * 3600, 3, "event_id")


@query(f"""SELECT l_orderkey, l_linenumber, l_quantity, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {SQL_LINE_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS running FROM lineitem""")
def running_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.running_offset(t(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col("l_linenumber"), *LINE_ORDER], "l_quantity", "running").select("l_orderkey", "l_linenumber", "l_quantity", F.col("running").cast("double").alias("running"))


@query("SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey)::INT AS occurrence FROM part")
def occurrence_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.occurrence(t(spark, sf_dir, "part"), ["p_brand", "p_name"], [F.col("p_partkey")]).select("p_partkey", "p_brand", "occurrence")


@query("SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_name, p_partkey)::INT AS place FROM part QUALIFY place <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_rows(t(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_name"), F.col("p_partkey")], 3, "place").select("p_brand", "p_partkey", "p_name", "place")


@query("""SELECT s_nationkey, s_suppkey, CASE WHEN s_acctbal >= 5000 THEN 0 WHEN s_acctbal >= 0 THEN 1 ELSE 2 END AS bucket, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_acctbal >= 5000 THEN 0 WHEN s_acctbal >= 0 THEN 1 ELSE 2 END, s_suppkey)::INT AS place FROM supplier""")
def bucketed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "supplier").withColumn("bucket", F.when(F.col("s_acctbal") >= 5000, 0).when(F.col("s_acctbal") >= 0, 1).otherwise(2))
    return ranking.occurrence(s, ["s_nationkey"], [F.col("bucket"), F.col("s_suppkey")], "place").select("s_nationkey", "s_suppkey", "bucket", "place")


@query(f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_discount DESC, l_quantity DESC, p_retailprice, p_name, l_partkey, l_linenumber, {SQL_LINE_ORDER}) = 1""")
def rank_seven_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, part = t(spark, sf_dir, "lineitem"), t(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_name")
    order = [F.col("l_returnflag"), F.desc("l_discount"), F.desc("l_quantity"), F.col("p_retailprice"), F.col("p_name"), F.col("l_partkey"), F.col("l_linenumber"), *LINE_ORDER]
    return ranking.top_rows(lines.join(part, lines.l_partkey == part.p_partkey), ["l_orderkey"], order).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("""SELECT p_brand, string_agg(p_name, '|' ORDER BY p_name) FILTER (r <= 3) AS first_names, greatest(count(*) - 3, 0)::BIGINT AS n_more FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS r FROM (SELECT DISTINCT p_brand, p_name FROM part)) GROUP BY 1""")
def limit_with_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.first_names(t(spark, sf_dir, "part"), "p_brand", "p_name", 3)


@query("""SELECT nationkey, name, side FROM (SELECT c_nationkey AS nationkey, c_name AS name, 'customer' AS side FROM customer UNION ALL SELECT s_nationkey, s_name, 'supplier' FROM supplier) QUALIFY row_number() OVER (PARTITION BY nationkey, name ORDER BY side) = 1""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_name").alias("name"), F.lit("customer").alias("side"))
    s = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name"), F.lit("supplier").alias("side"))
    return c.unionByName(s).groupBy("nationkey", "name").agg(F.min("side").alias("side"))


@query("""SELECT nationkey FROM ((SELECT c_nationkey AS nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer))""")
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")), t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return c.subtract(s).union(s.subtract(c))


TOKENS = "(SELECT DISTINCT {key}, unnest(regexp_split_to_array(lower({text}), '[^a-z0-9]+')) AS token FROM {table})"
PART_TOKENS = TOKENS.format(key="p_partkey", text="p_name", table="part")


@query(f"SELECT token, count(*) AS n_rows FROM {PART_TOKENS} WHERE token <> '' GROUP BY 1")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.index_sizes(t(spark, sf_dir, "part"), "p_partkey", "p_name")


@query("""SELECT DISTINCT a.s_suppkey AS left_key, b.s_suppkey AS right_key FROM (SELECT s_suppkey, unnest(list_distinct([s_nationkey::VARCHAR || ':' || (s_suppkey % 7)::VARCHAR, 'b' || floor(s_acctbal / 10)::BIGINT::VARCHAR])) AS k FROM supplier) a JOIN (SELECT s_suppkey, unnest(list_distinct([s_nationkey::VARCHAR || ':' || (s_suppkey % 7)::VARCHAR, 'b' || floor(s_acctbal / 10)::BIGINT::VARCHAR])) AS k FROM supplier) b ON a.k = b.k AND a.s_suppkey < b.s_suppkey""")
def key_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array(F.concat_ws(":", F.col("s_nationkey").cast("string"), (F.col("s_suppkey") % 7).cast("string")), F.concat(F.lit("b"), F.floor(F.col("s_acctbal") / 10).cast("string")))
    rows = t(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array_distinct(keys)).alias("k"))
    return matching.sharing_pairs(rows, "s_suppkey", "k")


ITEM_TOKENS, DOC_TOKENS = TOKENS.format(key="item_id", text="text", table="benchmark"), TOKENS.format(key="doc_id", text="text", table="documents")


@query(f"""WITH d AS (SELECT * FROM {DOC_TOKENS} WHERE token <> ''), i AS (SELECT * FROM {ITEM_TOKENS} WHERE token <> ''), rare AS (SELECT token FROM d GROUP BY 1 HAVING count(*) <= 0.01 * (SELECT count(*) FROM documents))
SELECT item_id, doc_id, count(*) AS n_shared FROM i JOIN rare USING (token) JOIN d USING (token) GROUP BY 1, 2 HAVING count(*) >= 2""")
def blocked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.blocked_candidates(t(spark, sf_dir, "benchmark"), t(spark, sf_dir, "documents"), "item_id", "doc_id", "text", 0.01, 2)


@query(f"""WITH d AS (SELECT * FROM {DOC_TOKENS} WHERE token <> ''), i AS (SELECT * FROM {ITEM_TOKENS} WHERE token <> ''), s AS (SELECT item_id, count(*) AS n_tokens FROM i GROUP BY 1 HAVING count(*) >= 4)
SELECT item_id, doc_id, n_tokens, count(*) AS n_held FROM i JOIN s USING (item_id) JOIN d USING (token) GROUP BY 1, 2, 3 HAVING count(*) >= n_tokens * 0.9""")
def coverage_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.coverage(t(spark, sf_dir, "benchmark"), t(spark, sf_dir, "documents"), "item_id", "doc_id", "text", 4, 0.9)


@query("""SELECT a.o_custkey, a.o_orderkey AS left_id, b.o_orderkey AS right_id FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
WHERE abs(date_diff('day', a.o_orderdate::DATE, b.o_orderdate::DATE)) <= 30 AND abs(a.o_totalprice - b.o_totalprice) <= 0.05 * greatest(a.o_totalprice, b.o_totalprice)""")
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.band_join(t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", 30, 0.05)


@query()
def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of part names with a ratio of 0.85 or more."""
    names = t(spark, sf_dir, "part").select(F.col("p_name").alias("key"))
    return like_pairs(names, names, 0.85).filter("a < b")


@query()
def assignment_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("score"))
    return matching.greedy_assignment(lines, "l_partkey", "l_suppkey", "score")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
l AS (SELECT DISTINCT o, o AS label, 0 AS r FROM e UNION ALL SELECT o, min(m) AS label, any_value(r) + 1 AS r FROM
    (SELECT e.o, min(l.label) OVER (PARTITION BY e.p) AS m, l.r FROM l JOIN e ON e.o = l.o WHERE l.r < 16) GROUP BY o)
SELECT o AS node, label AS component FROM l WHERE r = 16""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that share a part, directly or through others."""
    return shared_components(t(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key FROM part")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles.with_key(t(spark, sf_dir, "part"), "p_name", "key").select("p_partkey", "key")


@query(f"SELECT p_partkey, count(*) AS n_tokens FROM {PART_TOKENS} WHERE token <> '' GROUP BY 1")
def tokens_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_partkey", F.size(matching.ascii_tokens(F.col("p_name"))).cast("long").alias("n_tokens"))


@query()
def title_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = t(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(" mix) [feat. "), F.col("p_brand"), F.lit("]")).alias("title"))
    return named.withColumn("x", titles.title_parts_col("title")).select("p_partkey", "x.*")


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS leaf FROM pages""")
def path_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda p: F.regexp_extract("url", p, 1)
    return t(spark, sf_dir, "pages").select("page_id", part("^[a-z]+://([^/]+)").alias("host"), part("^[a-z]+://[^/]+(/[^?#]*)").alias("path"), part("([^/?#]*)(?:[?#].*)?$").alias("leaf"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(-1)).alias("k"))


CLASS = "CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'done' WHEN event_type IN ('click', 'view') THEN 'open' ELSE 'other' END"


@query(f"SELECT user_id, CASE WHEN bool_or(c = 'done') THEN 'done' WHEN bool_or(c = 'failed') THEN 'failed' WHEN bool_or(c = 'open') THEN 'open' ELSE 'other' END AS outcome, count(*) AS n_events FROM (SELECT user_id, {CLASS} AS c FROM events) GROUP BY 1")
def classify_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").select("user_id", F.expr(CLASS).alias("c"))
    any_ = lambda c: F.bool_or(F.col("c") == c)
    return rows.groupBy("user_id").agg(F.when(any_("done"), "done").when(any_("failed"), "failed").when(any_("open"), "open").otherwise("other").alias("outcome"), F.count("*").alias("n_events"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' AND epoch_us(ts) > epoch_us(TIMESTAMP '2024-01-20 00:00:00') - 6 * 3600 * 1000000::BIGINT AND ts <= TIMESTAMP '2024-01-20 00:00:00'")
def ttl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = "timestamp_ntz'2024-01-20 00:00:00'"
    return t(spark, sf_dir, "events").filter(f"event_type = 'error' and cast(ts as timestamp_ntz) > {now} - interval 6 hours and cast(ts as timestamp_ntz) <= {now}").select("event_id", "user_id")


@query("SELECT user_id, max(event_id) AS last_id FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-31 18:00:00'")
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("last_id"), F.max(F.col("ts").cast("timestamp_ntz")).alias("ts")).filter("ts < timestamp_ntz'2024-01-31 18:00:00'").select("user_id", "last_id")


FOLD = """SELECT user_id, count(*) AS n_seen, count(*) FILTER (event_type = 'error') AS n_failed, max(event_id) AS last_id, coalesce(arg_max(event_type, event_id) FILTER (event_type IN ('error', 'purchase')) = 'error', false) AS blocked FROM events GROUP BY 1"""


@query(FOLD)
def state_fold_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.fold(t(spark, sf_dir, "events"))


@query(FOLD)
def state_fold_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    return state.run_stream(spark, sf_dir, f"fold-{uuid.uuid4().hex}", shared_folder(t(spark, sf_dir, "events")))


@query("""SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND coalesce(l.toxic, 0) <> 1""")
def label_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = t(spark, sf_dir, "labels").filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1))
    return t(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id").select("doc_id", "quality")


@query("""SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS n_missing, bool_and(alternates) AS alternates FROM (SELECT conv_id, turn, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) <> role, true) AS alternates FROM conversations) GROUP BY 1""")
def turn_sequence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.lag("role").over(w) != F.col("role"), F.lit(True)).alias("alternates"))
    return rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("n_missing"), F.bool_and("alternates").alias("alternates"))
