"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item in a long document has a tiny resemblance to the whole of it, so sizes are matched first: items fall into
classes by powers of two of their number of shingles, and for a class of size S a document is seen as windows of 2 S
shingles, one every S, so that any stretch of an item's length lies within one window. Items and windows have one-
permutation min-hashes of ``BINS`` bins; an item is a candidate where it agrees with a window in any bin. Of an item of ``FEW``
shingles or less one bin can decide, so any of its shingles makes it a candidate. Candidates are verified by exact containment of the item's shingles in the whole document.

The benchmark is the stated query set. It goes to the workers in blocks of about ``block_bytes`` of text, each searched
in all documents, so no broadcast grows with either table.
"""

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adlake.llm.tables import needs, row_key, send_code, written
from adlake.llm.words import U, distinct, mix, shingles, slices, words

BINS = 256
FEW = 8
_FULL = np.iinfo(np.uint64).max


def _bins(values: np.ndarray) -> np.ndarray:
    return (values & U(BINS - 1)).astype(np.int64)


def _ranks(values: np.ndarray) -> np.ndarray:
    """The permutation that min-hashes are taken under."""
    return mix(values, 41)


def index_items(texts: list, k: int) -> dict:
    """Shingle sets of items, their size classes, and by min-hash the items it belongs to."""
    values, at = distinct(*shingles(*words(pa.array(texts, pa.large_string())), k))
    sets = [_ranks(values[a:b]) for a, b in zip(at[:-1], at[1:])]
    owners = defaultdict(list)
    for i, own in enumerate(sets):
        if len(own):
            size = 1 << max(0, int(len(own) - 1).bit_length())
            least = np.full(BINS, _FULL)
            np.minimum.at(least, _bins(own), own)
            for x in (own if len(own) <= FEW else least[least != _FULL]).tolist():
                owners[x].append((size, i))
    return {"sets": sets, "owners": dict(owners), "minima": np.sort(np.fromiter(owners, np.uint64, len(owners)))}


def _within(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), dtype=bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def candidates(index: dict, ranks: np.ndarray, hits: np.ndarray) -> set:
    """Items that agree with some window of their size class in some bin; ``hits`` are places of items' min-hashes."""
    found = {i for p in hits for _, i in index["owners"][int(ranks[p])] if len(index["sets"][i]) <= FEW}
    owned = [(int(p), size, i) for p in hits for size, i in index["owners"][int(ranks[p])] if i not in found]
    for size in {s for _, s, _ in owned}:
        mine = [(p, i) for p, s, i in owned if s == size and i not in found]
        if not mine:
            continue
        at = np.array([p for p, _ in mine])
        windows = np.unique(np.concatenate([at // size, np.maximum(at // size - 1, 0)]))
        places = windows[:, None] * size + np.arange(2 * size)
        inside = places < len(ranks)
        values = np.where(inside, ranks[np.minimum(places, len(ranks) - 1)], _FULL)
        least = np.full((len(windows), BINS), _FULL)
        np.minimum.at(least, (np.arange(len(windows))[:, None], _bins(values)), values)
        for p, i in mine:
            if i not in found:
                for w in {p // size, max(p // size - 1, 0)}:
                    if least[np.searchsorted(windows, w), _bins(ranks[p:p + 1])[0]] == ranks[p]:
                        found.add(i)
    return found


def _search(sent, k: int, percent: int):
    def run(batches):
        index = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                values, at = shingles(*words(part.column(0)), k)
                ranks = _ranks(values)
                hits = np.flatnonzero(_within(index["minima"], ranks))
                rows, items, shared = [], [], []
                for row in np.unique(np.searchsorted(at, hits, "right") - 1):
                    low, high = at[row], at[row + 1]
                    own = ranks[low:high]
                    kinds = np.unique(own)
                    for i in sorted(candidates(index, own, hits[(hits >= low) & (hits < high)] - low)):
                        both = int(_within(kinds, index["sets"][i]).sum())
                        if 100 * both >= percent * len(index["sets"][i]):
                            rows.append(row)
                            items.append(i)
                            shared.append(both)
                sizes = [len(index["sets"][i]) for i in items]
                yield pa.RecordBatch.from_arrays(
                    [part.column(1).take(pa.array(rows, pa.int64())), pa.array([index["ids"][i] for i in items], pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array(shared, pa.int64())], names=["_key", "item_id", "n_item", "n_shared"])
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, words_per_shingle: int = 5, percent: int = 80,
                 block_bytes: int = 4 << 20) -> DataFrame:
    """Pairs of document and benchmark item with 100 * shared shingles >= percent * the item's: doc_id, row_key, item_id,
    n_item, n_shared.

    Shingles are distinct runs of words, A-Z lower-cased; a text of fewer words has its whole sequence as one, so a very
    short item matches only a document that consists of it. Null and empty texts match nothing. Each distinct
    (item_id, text) and each row of docs is judged; ids may be null or repeat. An empty table gives no pairs.
    """
    send_code(docs.sparkSession)
    spark = docs.sparkSession
    items = needs(benchmark, "item_id", "text").where("text is not null").distinct()
    size = F.octet_length("text")
    blocks = -(-(items.agg(F.sum(size)).first()[0] or 0) // block_bytes)
    rows = needs(docs, "doc_id", "text").where("text is not null").select(
        "text", F.struct("doc_id", row_key("doc_id", "text").alias("row_key")).alias("_key"))
    schema = "_key struct<doc_id:bigint,row_key:bigint>, item_id bigint, n_item bigint, n_shared bigint"
    found = spark.createDataFrame([], schema)
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        index = index_items([r["text"] for r in own], words_per_shingle) | {"ids": [r["item_id"] for r in own]}
        found = found.union(rows.mapInArrow(_search(spark.sparkContext.broadcast(index), words_per_shingle, percent), schema))
    return found.select("_key.doc_id", "_key.row_key", "item_id", "n_item", "n_shared")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with their columns, that hold no benchmark item."""
    bad = written(contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_bad")).distinct())
    rows = docs.select(F.struct("*").alias("row"), row_key("doc_id", "text").alias("_key"))
    clean = rows.join(bad, (F.col("_key") == F.col("_bad")) & F.col("row.doc_id").eqNullSafe(F.col("_id")), "left_anti")
    return clean.select(*[F.col(f"row.`{c}`") for c in docs.columns])
