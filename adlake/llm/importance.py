"""Importance resampling towards a target: hashed n-gram weights, Gumbel keys, and an exact selection of the best.

Counts per bucket of hashed features are taken over all texts of the corpus and of the target, and their log ratios
are one array that scores every text. The winners are those above an exact cutoff key, which a weighted median of
medians finds: each task gives the median of its remaining keys, the median of these (weighted by what remains) has at
least a quarter of the remaining keys on either side, and one side goes. No sample and no sketch decides.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from adlake.llm.sharding import prefix_sums
from adlake.llm.tables import needs, send_code, written
from adlake.llm.terms import crc_of_terms, terms
from adlake.llm.words import longs, slices

# Keys that are sorted at once, on the driver: 24 bytes each.
AT_ONCE = 4096
_KEYS = "row bigint, doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"


def _features(column: pa.Array, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, row of each feature, words per row): single terms, and with ``longest`` 2 neighbours too."""
    raw, starts, ends, at = terms(column)
    one, two = crc_of_terms(raw, starts, ends)
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    if longest == 1:
        return one % np.uint32(buckets), row, n
    inner = np.ones(len(starts), dtype=bool)
    inner[at[1:][n > 0] - 1] = False  # the last term of a row begins no pair
    return np.concatenate([one, two[inner]]) % np.uint32(buckets), np.concatenate([row, row[inner]]), n


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = 10_000, longest: int = 2) -> DataFrame:
    """(bucket, n) over all texts; a task adds up its own before it gives them away."""
    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, text):
                total += np.bincount(_features(part.column(0), buckets, longest)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([longs(held), longs(total[held])], names=["bucket", "n"])

    send_code(texts.sparkSession)
    counted = needs(texts, text).mapInArrow(count, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 2) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed bucket shares), one per bucket: a fixed-size array on the driver."""
    both = []
    for texts in (corpus, target):
        counts = np.zeros(buckets, dtype=np.int64)
        for r in bucket_counts(texts, buckets=buckets, longest=longest).collect():  # one row a bucket
            counts[r.bucket] = r.n
        both.append(counts)
    s, t = both
    all_s, all_t = float(s.sum()) + buckets, float(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((int(b) + 1) * all_s / ((int(a) + 1) * all_t))) for a, b in zip(s, t)], dtype=np.int64)


def _noise(seed: int, doc_id: int | None) -> int:
    """floor(1000 * a Gumbel value) that the seed and the id decide; a null id counts as no characters."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = 7, longest: int = 2) -> DataFrame:
    """Every document's row number, id, words, features, weight and score, written out so that row numbers are settled."""
    array = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                bucket, row, n = _features(part.column("text"), buckets, longest)
                features = np.bincount(row, minlength=len(n))
                # Sums of 64-bit integers: doubles would round from 2^53 on.
                total = np.zeros(len(n), dtype=np.int64)
                np.add.at(total, row, array.value[bucket])
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                noise = np.array([_noise(seed, i) for i in part.column("doc_id").to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), longs(n.astype(np.int64)), longs(features.astype(np.int64)), longs(weight), longs(weight + noise)],
                    names=["doc_id", "n_words", "n_features", "weight", "score"])

    send_code(docs.sparkSession)
    out = needs(docs, "doc_id", "text").mapInArrow(run, _KEYS.removeprefix("row bigint, "))
    return written(out.select(F.monotonically_increasing_id().alias("row"), "*"))


# --- selection -------------------------------------------------------------------

def _best_first() -> list[Column]:
    """A key as it sorts: higher score, then smaller doc_id (nulls last), then smaller row number."""
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]


def _tuple(score, doc_id, row) -> tuple:
    return -score, doc_id is None, 0 if doc_id is None else doc_id, row


def _before(key: tuple) -> Column:
    """Whether a row's key sorts before the given one."""
    score, lost, doc_id, row = -key[0], key[1], key[2], key[3]
    null, same = F.col("doc_id").isNull(), F.col("doc_id") == doc_id
    smaller = (~null if lost else ~null & (F.col("doc_id") < doc_id)) | ((null if lost else ~null & same) & (F.col("row") < row))
    return (F.col("score") > score) | ((F.col("score") == score) & smaller)


def _median_of_task(batches):
    """The median key of a task's rows and their number."""
    rows = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if rows is None:
        return
    ids = rows.column("doc_id")
    lost, ids = ids.is_null().to_numpy(), ids.fill_null(0).to_numpy()
    score, row, middle = -rows.column("score").to_numpy(), rows.column("row").to_numpy(), (len(rows) - 1) // 2
    value = np.partition(score, middle)[middle]
    ties = np.flatnonzero(score == value)
    at = ties[np.lexsort((row[ties], ids[ties], lost[ties]))[middle - np.count_nonzero(score < value)]]
    yield pa.RecordBatch.from_pydict({"score": [int(-score[at])], "doc_id": [None if lost[at] else int(ids[at])], "row": [int(row[at])], "n": [len(rows)]},
                                     schema=pa.schema([(c, pa.int64()) for c in ("score", "doc_id", "row", "n")]))


def cutoff(keys: DataFrame, wanted: int, at_once: int = AT_ONCE) -> tuple | None:
    """The key of the ``wanted``-th row in order, best first; None where nothing is wanted or there are fewer rows.

    ``keys`` is a written table with score, doc_id and a row number that is unique. Each round takes one row a task to
    the driver and drops at least a quarter of the remaining keys.
    """
    remaining, left = keys.select("score", "doc_id", "row"), keys.count()
    if not 0 < wanted <= left:
        return None
    while left > at_once:
        medians = remaining.mapInArrow(_median_of_task, "score bigint, doc_id bigint, row bigint, n bigint").collect()
        medians = sorted((_tuple(m.score, m.doc_id, m.row), m.n) for m in medians)
        half, passed = left / 2, 0
        for pivot, n in medians:
            passed += n
            if passed >= half:
                break
        better = remaining.where(_before(pivot)).count()
        if better + 1 == wanted:
            return pivot
        if wanted <= better:
            remaining, left = remaining.where(_before(pivot)), better
        else:
            worse = ~_before(pivot) & (F.col("row") != pivot[3])
            remaining, left, wanted = remaining.where(worse), left - better - 1, wanted - better - 1
    return sorted(_tuple(*r) for r in remaining.collect())[wanted - 1]


def ranked(winners: DataFrame) -> DataFrame:
    """Rows in global order with ``rank`` from 1: range partitions, sorted and numbered each on from where it begins."""
    order = winners.repartitionByRange(*_best_first()).sortWithinPartitions(*_best_first())
    number = F.monotonically_increasing_id()  # partition above 33 bits of place
    placed = written(order.withColumn("_at", number).withColumns({
        "part": F.shiftrightunsigned("_at", 33), "place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at"))
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return placed.join(prefix_sums(counts, "part", "n"), "part").withColumn("rank", F.col("before") + F.col("place") + 1).drop("part", "place", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, longest: int = 2,
             seed: int = 7, at_once: int = AT_ONCE) -> DataFrame:
    """All documents with n_words, n_features, weight, score and rank; rank is null where a document is not drawn.

    ``docs`` has doc_id and text, ``target`` text. A null or wordless text has no features, weight 0 and too few words
    to be drawn unless ``least_words`` is 0; a null doc_id draws as an empty one and loses ties. Repeated rows are
    rows of their own. An empty corpus gives no rows, an empty target an even one. Very long texts are counted whole.
    """
    keys = scored(docs, gains(docs, target, buckets, longest), seed, longest)
    able = keys.where(F.col("n_words") >= least_words)
    wanted = percent * able.count() // 100
    last = cutoff(able, wanted, at_once)
    columns = ["row", "doc_id", "n_words", "n_features", "weight", "score"]
    if last is None:
        return keys.select(*columns, F.lit(None).cast("long").alias("rank")).drop("row")
    drawn = (F.col("n_words") >= least_words) & (_before(last) | (F.col("row") == last[3]))
    losers = keys.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank"))
    return losers.unionByName(ranked(keys.where(drawn)).select(*columns, "rank")).drop("row")
