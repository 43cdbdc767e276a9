"""The corpus pipeline: quality, line dedup, near-dedup, benchmark decontamination, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame and sees all that the one before has kept, written as Parquet and read
again. All but the last return the columns of ``documents``; no decision is expressible in SQL end to end (the
classifier is trained), so ORACLE_SQL is None and the tests hold the stages against brute force.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from adlake.llm.decontaminate import decontaminate
from adlake.llm.line_dedup import LINE_ENDS, dedup_lines
from adlake.llm.minhash_dedup import near_duplicates
from adlake.llm.packing import pack
from adlake.llm.quality import score, train
from adlake.llm.tables import read, row_key, written

# A document goes if its quality score is below this.
LEAST_QUALITY = 0.3
# A line found in so many documents stays where it comes first.
LINE_DOCUMENTS = 10
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is high enough; the model learns from the labelled ones among them.

    Without labels the model's score is one half for all and nothing goes.
    """
    model = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).where(F.col("score") >= LEAST_QUALITY).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents stay in the first of them; n_chars follows the text.

    A document goes only if it loses lines and none but empty ones are left: all it says stands in earlier documents.
    One that keeps a line of its own, or the first occurrence of a common one, stays with what is left. Documents that
    lose no line are returned as they are, null and empty texts included.
    """
    out = dedup_lines(docs, min_docs=LINE_DOCUMENTS, keep_first=True)
    changed = F.col("n_dropped") > 0
    left = F.char_length("kept_text")
    kept = out.where(~changed | (F.col("n_first") > 0) | (F.btrim("kept_text", F.lit(LINE_ENDS)) != ""))
    replaced = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("row.text")),
                "n_chars": F.when(changed, left.cast("long")).otherwise(F.col("row.n_chars"))}
    return kept.select(*[replaced.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id. Texts without words all stay.

    Of rows that repeat a document (doc_id and text) one stays.
    """
    groups = near_duplicates(docs, words_per_shingle=5, percent=80)
    gone = written(groups.where(~F.col("chosen")).select("row_key", F.col("doc_id").alias("_id")).distinct())
    repeated = written(groups.groupBy("row_key", F.col("doc_id").alias("_id")).count().where("count > 1").select("row_key", "_id"))
    rows = docs.select(F.struct("*").alias("row"), row_key("doc_id", "text").alias("_key"))
    same = (F.col("_key") == F.col("row_key")) & F.col("row.doc_id").eqNullSafe(F.col("_id"))
    kept = rows.join(gone, same, "left_anti")
    once = kept.join(repeated, same, "left_anti").select("row.*")
    # Few rows in practice; first() of a struct keeps one row whole.
    again = kept.join(repeated, same, "left_semi").groupBy("_key", F.col("row.doc_id")).agg(F.first("row").alias("row"))
    return once.unionByName(again.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"), words_per_shingle=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, as pieces placed in sequences of 4096 token ids; ``ids`` are little-endian 32-bit."""
    out = pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1, with_ids=True, remember=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
