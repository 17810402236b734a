"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitgauge.llm import align, bpe, decontaminate, ego_join, minhash, mixing, packing, pii, quality_cnn, runs, token_counts, toxicity, url_filter
from pitgauge.llm.labelled import labelled_sample, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_token_counts")
def op2_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE, 1024, keep=["doc_id"])


@query("op9_bpe_round_trip")
def op9_bpe_round_trip(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)


@query("op7_minhash_near_duplicates")
def op7_minhash_near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


@query("op6_quality_cnn")
def op6_quality_cnn(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    network = quality_cnn.learn(*labelled_sample(docs, labels, "quality", remainder(3) != 1, per_class=900, max_chars=12_000))
    scored = quality_cnn.score_quality(docs, network, keep=["doc_id"])
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


def fitted_lexicon(docs, labels):
    return toxicity.learn(*labelled_sample(docs, labels, "toxic", remainder(5) != 0, per_class=3_000, max_chars=20_000))


@query("op8_toxicity_lexicon")
def op8_toxicity_lexicon(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score_toxicity(docs, fitted_lexicon(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted", "n_hits")


@query("op3_ego_join")
def op3_ego_join(spark, sf_dir):
    return ego_join.epsilon_join(table(spark, sf_dir, "embeddings"), 0.93)


@query("op4_decontamination")
def op4_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_personal_data")
def op10_personal_data(spark, sf_dir):
    return pii.digest_personal_data(table(spark, sf_dir, "documents"), pii.learn())


RULES = [url_filter.Rule("net", "/", "block"), url_filter.Rule("example.net", "/en/", "allow"), url_filter.Rule("example.com", "/de/", "block"), url_filter.Rule("org", "/fr/", "allow")]


def level_sql(name: str, groups: str) -> str:
    """Prior strength of a level, as one row."""
    lo, hi = url_filter.STRENGTHS
    return f"""{name} AS (
  SELECT CASE WHEN coalesce(sum(n), 0) = 0 OR sum(n) = count(*) THEN 1e0
              WHEN sum(n * pow(bad / n - m, 2) / (m * (1 - m))) <= count(*) THEN {hi}e0
              ELSE least({hi}e0, greatest({lo}e0, (sum(n) - count(*)) / (sum(n * pow(bad / n - m, 2) / (m * (1 - m))) - count(*)) - 1)) END AS s
  FROM {groups} WHERE n > 0)"""


OP1_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
placed AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host,
                  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
known AS (SELECT doc_id, count(*) AS n, sum(CAST(quality = 0 OR toxic = 1 AS BIGINT)) AS bad FROM labels WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, CAST(coalesce(sum(n), 0) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad
          FROM placed LEFT JOIN known ON doc_id = page_id GROUP BY 1, 2),
domains AS (SELECT domain, string_split(domain, '.')[-1] AS suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT *, (sum(bad) OVER () + 0.5e0) / (sum(n) OVER () + 1e0) AS m FROM (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY 1)),
{level_sql("s1", "suffixes")},
domains2 AS (SELECT d.*, (f.bad + s * f.m) / (f.n + s) AS m FROM domains d JOIN suffixes f USING (suffix), s1),
{level_sql("s2", "domains2")},
hosts2 AS (SELECT h.*, (d.bad + s * d.m) / (d.n + s) AS m FROM hosts h JOIN domains2 d USING (domain), s2),
{level_sql("s3", "hosts2")},
post AS (SELECT host, n, s, (bad + s * m) / (n + s) AS mean FROM hosts2, s3),
ruled AS (SELECT p.*, CAST(n AS BIGINT) AS n_labelled, mean - {url_filter.Z}e0 * sqrt(mean * (1 - mean) / (n + s + 1)) AS bound,
                 CASE WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/' WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                      WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/' WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
          FROM placed p JOIN post USING (host))
SELECT page_id, host, path, rule, n_labelled,
       CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bound > {url_filter.LIMIT}e0 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""


@query("op1_url_reputation", OP1_SQL)
def op1_url_reputation(spark, sf_dir):
    """Outcomes: the labels whose id is the page's; a page is bad if it is of poor quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes, RULES).select("page_id", "host", "path", "rule", "verdict", "n_labelled")


@query("op5_packing")
def op5_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark, sf_dir):
    return runs.digest_runs(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH judged AS (SELECT doc_id AS judged_id, 0.25e0 + 0.75e0 * coalesce(avg(quality), 0.5e0) AS w FROM labels GROUP BY 1),
rows AS (SELECT doc_id, source, coalesce(length(translate(regexp_replace(text, '[^\x20\x09-\x0D]+', 'w', 'g'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')), 0) AS size,
                -ln((CAST('0x' || substring(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0) / coalesce(w, 0.625e0) AS draw
         FROM documents LEFT JOIN judged ON judged_id = doc_id),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY 1),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sizes),
weighed AS (SELECT *, (place - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM placed),
filled AS (SELECT *, most / CAST(weight AS DOUBLE) AS share,
                  CAST(sum(source_size) OVER () - (sum(most) OVER o - most) AS DOUBLE) / CAST(sum(weight) OVER () - (sum(weight) OVER o - weight) AS DOUBLE) AS level
           FROM weighed WINDOW o AS (ORDER BY most / CAST(weight AS DOUBLE), place ROWS UNBOUNDED PRECEDING)),
found AS (SELECT coalesce((SELECT level FROM filled WHERE level <= share ORDER BY share, place LIMIT 1), 0) AS at_level),
targets AS (SELECT source, place, source_size, least(CAST(most AS DOUBLE), at_level * weight) AS target FROM filled, found),
reached AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
                   CAST(sum(size) OVER (PARTITION BY place ORDER BY draw, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS ahead
            FROM rows JOIN targets ON rows.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, epochs * size + least(greatest(CAST(floor(target - epochs * source_size) AS BIGINT) - ahead, 0), size) AS taken FROM reached"""


@query("op12_source_mixing", OP12_SQL)
def op12_source_mixing(spark, sf_dir):
    """Quality weights: a quarter for documents labelled poor, 1 for good ones, between the two where nothing is known."""
    judged = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("judged_id")).agg((0.25 + 0.75 * F.coalesce(F.avg("quality"), F.lit(0.5))).alias("w"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("words")).join(judged, F.col("judged_id") == F.col("doc_id"), "left")
    return mixing.plan_mix(docs, F.col("words"), F.coalesce("w", F.lit(0.625))).select("doc_id", "size", "source_size", "target", "taken")


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark, sf_dir):
    return align.align_documents(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)
