"""The queries that apply each operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import bpe, filter_audit, language, mixing, mpeg_audio, packing, phrases, pii, quality, repeats, secrets, simhash, topk
from lacuna.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.media_features(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), from_files=True)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_quality, op2_mpeg_audio, op3_bpe, op4_pii, op5_mixing, op6_simhash, op7_topk, op8_secrets, op9_language, op10_repeats,
            op11_packing, op12_filter_audit, op13_phrases,
        )
    }


OP7 = """WITH p AS (SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.v, b.v)::BIGINT AS score,
  row_number() OVER (PARTITION BY a.r ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id)::INT AS rank
  FROM p a JOIN p b ON a.vec_id % 20 = 0 AND a.r <> b.r AND len(a.v) = len(b.v)) WHERE rank <= 20"""


OP12 = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY ALL),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, map {'A': (len(w) < 200)::INT, 'B': (100 * len(list_distinct(w)) < 50 * len(w))::INT,
    'C': (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT, 'D': regexp_matches(text, '[#$%&*|]')::INT,
    'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT} AS fails FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS c, filter_order[1:step - 1] AS earlier FROM o, range(1, 6) r(step)),
m AS (SELECT part, filter_order, step, c, n, good, bad, fails[c] AS here, fails['A'] + fails['B'] + fails['C'] + fails['D'] + fails['E'] AS every,
    CASE WHEN contains(earlier, 'A') THEN fails['A'] ELSE 0 END + CASE WHEN contains(earlier, 'B') THEN fails['B'] ELSE 0 END + CASE WHEN contains(earlier, 'C') THEN fails['C'] ELSE 0 END
    + CASE WHEN contains(earlier, 'D') THEN fails['D'] ELSE 0 END + CASE WHEN contains(earlier, 'E') THEN fails['E'] ELSE 0 END AS gone FROM g, s),
r AS (SELECT part, filter_order, step, c, sum(CASE WHEN gone = 0 AND here = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN gone = 0 AND here = 1 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN gone > 0 AND here = 1 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN here = 1 AND every = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN gone = 0 AND here = 1 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN gone = 0 AND here = 1 THEN bad ELSE 0 END)::BIGINT AS toxic_lost FROM m GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, c)::BIGINT AS shapley FROM r"""


OP13 = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, w[i:i + m - 1] AS x, count(*) AS f FROM (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 6) r(m)) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT g.lang, g.m, g.x, g.f AS a, k, h.f AS l, r.f AS r, n, ((1000 * g.f::HUGEINT * n) // (h.f::HUGEINT * r.f))::BIGINT AS score FROM g JOIN t USING (lang) JOIN range(1, 5) q(k) ON k < g.m
    JOIN g h ON h.lang = g.lang AND h.x = g.x[1:k] JOIN g r ON r.lang = g.lang AND r.x = g.x[k + 1:]),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, k) = 1),
d AS (SELECT lang, array_to_string(x, ' ') AS phrase, a, l, r, n::BIGINT AS n, score FROM b WHERE NOT EXISTS (SELECT 1 FROM g o WHERE o.lang = b.lang AND o.m > b.m AND 100 * o.f >= 100 * b.a
    AND contains(' ' || array_to_string(o.x, ' ') || ' ', ' ' || array_to_string(b.x, ' ') || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM d QUALIFY rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express within a test's time; op7's sums are exact while they are under 2^53."""
    return {"op7_topk": OP7, "op12_filter_audit": OP12, "op13_phrases": OP13}
