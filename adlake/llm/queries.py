"""The registered corpus queries: thin digests of the operators, each over its whole table."""

import public_tokenizers
from pyspark.sql import functions as F

from adlake.llm import bloom_lm
from adlake.llm.ball_tree import search
from adlake.llm.decontaminate import contaminated
from adlake.llm.exact_dedup import deduplicate
from adlake.llm.importance import resample
from adlake.llm.line_dedup import dedup_lines
from adlake.llm.minhash_dedup import near_duplicates
from adlake.llm.order_minhash import edited_likeness
from adlake.llm.packing import pack
from adlake.llm.quality import held_out_fold, score, train
from adlake.llm.sharding import shuffle_into_shards
from adlake.llm.substring_dedup import repeated_passages
from adlake.llm.tables import read
from adlake.llm.url_filter import judge

QUERIES = {}
SQL = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


@_query
def op7_line_dedup(spark, folder):
    out = dedup_lines(read(spark, folder, "documents"), min_docs=10, min_chars=1, keep_first=False)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped",
                      F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


SQL["op7_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM common)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (SELECT key FROM common)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id"""


@_query
def op10_quality(spark, folder):
    docs = read(spark, folder, "documents")
    out = score(docs, train(docs, read(spark, folder, "labels")))
    return out.select(F.col("row.doc_id").alias("doc_id"), F.coalesce(held_out_fold("row.doc_id"), F.lit(False)).alias("held_out"),
                      "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@_query
def op1_near_dedup(spark, folder):
    out = near_duplicates(read(spark, folder, "documents"), words_per_shingle=4, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


@_query
def op3_decontamination(spark, folder):
    out = contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return out.select("doc_id", "item_id", "n_item", "n_shared", F.round(F.col("n_shared") / F.col("n_item"), 6).alias("containment"))


def _shingles_sql(table, key, size):
    """Distinct runs of ``size`` words of a table's texts, as text."""
    return f"""
  SELECT DISTINCT {key}, array_to_string(list_slice(w, i, i + {size - 1}), ' ') AS s FROM (
    SELECT {key}, w, unnest(generate_series(1, greatest(len(w) - {size - 1}, least(len(w), 1)))) AS i FROM (
      SELECT {key}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\\x20\\x09-\\x0D]+') AS w FROM {table}))"""


SQL["op3_decontamination"] = f"""
WITH i AS ({_shingles_sql('benchmark', 'item_id', 5)}), d AS ({_shingles_sql('documents', 'doc_id', 5)}),
sizes AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, round(n_shared / n_item, 6) AS containment
FROM shared JOIN sizes USING (item_id) WHERE 100 * n_shared >= 80 * n_item"""


@_query
def op6_packing(spark, folder):
    out = pack(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


@_query
def op8_sharding(spark, folder):
    text = F.coalesce("row.text", F.lit(""))
    return shuffle_into_shards(read(spark, folder, "documents"), shards=8).select(
        F.col("row.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op9_order_minhash(spark, folder):
    return edited_likeness(read(spark, folder, "documents")).drop("row_key")


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@_query
def op4_url_filter(spark, folder):
    return judge(read(spark, folder, "pages"), URL_RULES)


@_query
def op5_lm_scoring(spark, folder):
    docs = read(spark, folder, "documents")
    out = bloom_lm.score(docs, bloom_lm.train(docs.where(~bloom_lm.held_out_fold())))
    return out.select("doc_id", bloom_lm.held_out_fold().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op2_substring_dedup(spark, folder):
    out = repeated_passages(read(spark, folder, "documents"))
    return out.select("doc_id", F.col("start").alias("start_word"), F.col("size").alias("n_words"), "source_id",
                      F.col("source_start").alias("source_start_word"), F.col("source_size").alias("source_n_words"), "similarity")


@_query
def op11_ranked_search(spark, folder):
    out = search(read(spark, folder, "documents"), read(spark, folder, "benchmark"), k=10)
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _terms_sql(table, key):
    return (f"SELECT {key}, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            rf"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM {table}")


SQL["op11_ranked_search"] = f"""
WITH d AS ({_terms_sql('documents', 'doc_id')}), i AS ({_terms_sql('benchmark', 'item_id')}),
tf AS (SELECT doc_id, w, count(*) AS tf FROM d GROUP BY doc_id, w),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM len),
weights AS (SELECT w, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, whole GROUP BY w, n_docs),
m AS (SELECT doc_id, 25 + (75 * n * n_docs) // n_terms AS m FROM len, whole),
hits AS (
  SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM (SELECT item_id, w, count(*) AS times FROM i GROUP BY item_id, w) JOIN tf USING (w) JOIN weights USING (w) JOIN m USING (doc_id)
  GROUP BY item_id, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM hits WHERE score > 0) WHERE rank <= 10"""


@_query
def op12_importance(spark, folder):
    out = resample(read(spark, folder, "documents"), read(spark, folder, "benchmark"), percent=25, least_words=20, buckets=10_000, seed=7)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


@_query
def op13_exact_dedup(spark, folder):
    out = deduplicate(spark, f"{folder}/documents.parquet")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


SQL["op13_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS whole FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(whole) AS text_sha256
FROM t WINDOW same AS (PARTITION BY whole)"""
