"""Near-duplicate documents by SuperMinHash signatures, banding, verification on full sets and union-find grouping.

Every shingle has ranks under correlated permutations: it visits the slots of the signature in an order of its own, and
the j-th slot it visits gets the value j + r with a fresh fraction r. A slot keeps its least value, so layers are worked
off in turn and a document stops at the first layer after which no slot is empty (about m ln m / n layers for n
shingles). The order is slot = (a j + b) mod m for prime m: for any two slots the ranks of a shingle are distributed
as under a random permutation, and the variance of the estimate depends on no more than pairs of slots.

Equal sets are one class before banding, so exact copies cost one row each. Within a bucket each class is compared
with the bucket's least class, not with all others; what is then still in different components meets the next least
one, and only what is left after that meets the rest of its bucket. No pair leaves the join of a bucket that a parity
bitmap rules out: a set's bitmap has the parity of its shingles per hash bit, so two bitmaps differ in no more bits than
the sets have shingles apart. That bound is exact; it drops no link.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adlake.llm.components import components
from adlake.llm.tables import needs, row_key, send_code, written
from adlake.llm.words import U, blobs, distinct, long_lists, longs, mix, row_sums, shingles, slices, words

SLOTS, BANDS, ROWS = 193, 32, 6  # a link of 0.8 shares no band with probability (1 - 0.8 ** 6) ** 32 < 6e-5
PARITY = 8  # 64-bit words of the parity bitmap
_BITMAP = [f"p{i}" for i in range(PARITY)]
_EMPTY = np.iinfo(np.uint64).max


def signatures(values: np.ndarray, at: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures of the sets in rows of ``values``, one row of ``slots`` numbers each (``slots`` prime)."""
    n_rows = len(at) - 1
    table = np.full(n_rows * slots, _EMPTY, dtype=np.uint64)
    sizes = np.diff(at)
    row, x = np.repeat(np.arange(n_rows), sizes), mix(values, 21)
    step = (x % U(slots - 1)).astype(np.int64) + 1
    place = (mix(x, 22) % U(slots)).astype(np.int64)
    open_rows = sizes > 0
    for layer in range(slots):
        live = open_rows[row]
        if not live.all():
            row, x, step, place = row[live], x[live], step[live], place[live]
        if not len(row):
            break
        value = (mix(x, 100 + layer) >> U(8)) | U(layer << 56)
        np.minimum.at(table, row * slots + place, value)
        place = (place + step) % slots
        open_rows &= (table.reshape(n_rows, slots) == _EMPTY).any(axis=1)
    return table.reshape(n_rows, slots)


def _sets(texts: pa.Array, k: int):
    """Distinct shingles of each row with a 128-bit hash of the set."""
    values, at = distinct(*shingles(*words(texts), k))
    first, second = row_sums(mix(values, 31), at), row_sums(mix(values, 32), at)
    names = np.stack([mix(first, 1), mix(second ^ np.diff(at).astype(np.uint64), 2)], axis=1)
    return values, at, blobs(names.ravel(), np.arange(len(at)) * 2)


def parities(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the sets in rows, as ``PARITY`` integers each."""
    rows, bits = len(at) - 1, 64 * PARITY
    cell = np.repeat(np.arange(rows), np.diff(at)) * bits + (mix(values, 71) % U(bits)).astype(np.int64)
    odd = (np.bincount(cell, minlength=rows * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(rows, bits), axis=1, bitorder="little").view(np.int64)


def _signed(k: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                values, at, name = _sets(part.column(0), k)
                sizes = np.diff(at)
                table = signatures(values, at)[:, :BANDS * ROWS].reshape(-1, BANDS, ROWS)
                bands = np.zeros(table.shape[:2], dtype=np.uint64)
                for i in range(ROWS):
                    bands = mix(bands ^ table[:, :, i], i)
                parity = parities(values, at)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), longs(sizes), name, long_lists(bands.ravel(), np.arange(len(at)) * BANDS),
                     *[longs(parity[:, i].copy()) for i in range(PARITY)]], names=["_key", "n_shingles", "set_name", "bands", *_BITMAP])
    return run


def _full_sets(k: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                values, at, name = _sets(part.column(0), k)
                yield pa.RecordBatch.from_arrays([name, blobs(values, at)], names=["set_name", "set"])
    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(c[i].as_buffer(), dtype=np.uint64) for c in (left, right))
                if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                    if len(a) > len(b):
                        a, b = b, a
                    spot = np.minimum(np.searchsorted(b, a), len(b) - 1)
                    both = int((b[spot] == a).sum())
                    keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))
    return run


def near_duplicates(docs: DataFrame, words_per_shingle: int = 5, percent: int = 80, star_rounds: int = 2) -> DataFrame:
    """Every row of ``docs`` with its group: doc_id, row_key, n_shingles, component_id, chosen, kept.

    Two documents are linked if 100 * shared shingles >= percent * all shingles of both, confirmed on the full sets of
    64-bit shingle hashes. ``component_id`` is the least doc_id reachable by links (null if all are null) and ``kept``
    says that it is the row's own. ``chosen`` marks the content to keep of each group: the least (doc_id, row_key), a
    null doc_id last; rows that repeat doc_id and text share it. A null or empty text, or one of white space, has no
    shingles and is a group of its own; one with fewer words than a shingle has its whole sequence as one. No rows, no
    result. Other columns are not read.
    """
    send_code(docs.sparkSession)
    k = words_per_shingle
    rows = needs(docs, "doc_id", "text").select("text", row_key("doc_id", "text").alias("_key"), "doc_id")
    signed = rows.select("text", F.struct("doc_id", "_key").alias("_key")).mapInArrow(
        _signed(k), "_key struct<doc_id:bigint,_key:bigint>, n_shingles bigint, set_name binary, bands array<bigint>, "
        + ", ".join(f"{p} bigint" for p in _BITMAP))
    signed = written(signed.select(F.col("_key.doc_id").alias("doc_id"), F.col("_key._key").alias("row_key"),
                                   "n_shingles", "set_name", "bands", *_BITMAP))
    classes = written(signed.where("n_shingles > 0").groupBy("set_name").agg(
        F.min("row_key").alias("row_key"), F.first("bands").alias("bands"), F.min("n_shingles").alias("size"),
        *[F.min(p).alias(p) for p in _BITMAP]))
    members = classes.select("set_name", "size", *_BITMAP, F.posexplode("bands").alias("band", "bucket"))
    shared = members.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = written(members.join(shared, ["band", "bucket"], "left_semi"))

    # The full sets of the classes that share a bucket at all.
    involved = members.select("set_name").distinct().join(classes.select("set_name", "row_key"), "set_name")
    texts = rows.join(involved.select(F.col("row_key").alias("_key")).distinct(), "_key", "left_semi").select("text")
    sets = written(texts.mapInArrow(_full_sets(k), "set_name binary, set binary").dropDuplicates(["set_name"]))

    links, grouped = None, members.withColumn("component", F.col("set_name"))
    for last in [False] * star_rounds + [True]:
        # What is not in the component of its bucket's lead is open.
        lead = grouped.groupBy("band", "bucket").agg(F.min(F.struct("component", "set_name")).alias("lead"))
        if links is None:
            one = grouped.join(lead, ["band", "bucket"]).where("set_name = lead.set_name").drop("lead")
        else:
            one = grouped.join(lead, ["band", "bucket"]).where("component != lead.component").drop("lead")
            if not last:
                one = one.groupBy("band", "bucket").agg(F.min(F.struct("set_name", "component", "size", *_BITMAP)).alias("x")).select(
                    "band", "bucket", "x.*")
        found = _verified(_possible(one, grouped, percent).distinct(), sets, percent)
        links = written(found if links is None else links.union(found))
        if not last:
            named = components(links)
            grouped = written(members.join(named.withColumnRenamed("node", "set_name"), "set_name", "left")
                              .withColumn("component", F.coalesce("component", "set_name")))

    named = components(links).select(F.col("node").alias("set_name"), F.col("component"))
    own = signed.select("doc_id", "row_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_name")).alias("set_name"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key"))
    least = own.where("set_name is not null").groupBy("set_name").agg(first.alias("least"))
    least = least.join(named, "set_name", "left").withColumn("component", F.coalesce("component", "set_name"))
    groups = least.groupBy("component").agg(F.min("least").alias("least"))
    names = least.select("set_name", "component").join(groups, "component").select("set_name", "least")
    grouped = F.col("least").isNotNull()
    return own.join(names, "set_name", "left").select(
        "doc_id", "row_key", "n_shingles",
        F.when(grouped, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(grouped, F.col("row_key") == F.col("least.row_key")).otherwise(True).alias("chosen"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _possible(some: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``some`` and their buckets' members in other components that sizes and bitmaps do not rule out."""
    x, y = some.alias("x"), members.alias("y")
    size = F.col("x.size") + F.col("y.size")
    apart = sum((F.bit_count(F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}"))) for p in _BITMAP), F.lit(0))
    near = ((F.col("x.band") == F.col("y.band")) & (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") != F.col("y.component"))
            & (100 * F.least("x.size", "y.size") >= percent * F.greatest("x.size", "y.size")) & (apart * (100 + percent) <= size * (100 - percent)))
    return x.join(y, near).select(F.least("x.set_name", "y.set_name").alias("a"), F.greatest("x.set_name", "y.set_name").alias("b"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("set_name").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("set_name").alias("b"), F.col("set").alias("set_b"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(_confirm(percent), "a binary, b binary")
