"""Ranked lexical search as exact inner-product search in ball trees over sparse document vectors.

A document is the vector of its saturated term frequencies, a query that of its term weights, and the score is their
inner product in integers. Documents with similar terms are put next to each other, and every few thousand of them
become one tree of balls: a node has a centre (its mean, cut to the largest coordinates) and a radius that holds all its
documents, so <q, d> <= <q, c> + |q| r. A search takes the nodes of many trees best bound first, leaves out whole
subtrees that cannot reach the k-th best score so far, and scores what is left of the leaves in 64-bit integers. Bounds
are rounded upwards by more than the error of their floating-point sums, so no result is lost.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from adlake.llm.tables import needs, send_code, written
from adlake.llm.terms import hashes, runs_of, terms
from adlake.llm.words import blobs, longs, mix, slices

# Documents and (document, term) entries of one tree; documents of a leaf; coordinates of a centre.
TREE_DOCS, TREE_ENTRIES, LEAF, CENTRE = 4096, 1 << 20, 64, 512
# Entries of the trees that one task searches together, and bytes of queries that meet them at once.
CELL_ENTRIES, QUERY_BYTES = 1 << 20, 4 << 20
# Query terms that are shipped to the tasks, 8 bytes each; beyond it documents are indexed with all their terms.
MOST_TERMS = 1_000_000

_VECTORS = "doc_id bigint, n bigint, lead bigint, size bigint, term binary, tf binary"
_TREE = ("id binary, row binary, at binary, column binary, value binary, term binary, low binary, high binary, left binary, radius binary, "
         "centre_at binary, centre_column binary, centre_value binary, entries bigint")


def _vectors(vocabulary: np.ndarray | None):
    """Batches of (doc_id, text) to term counts: n counts all terms, term and tf hold those of the vocabulary."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                raw, starts, ends, at = terms(part.column("text"))
                value, n = hashes(raw, starts, ends), np.diff(at)
                if vocabulary is not None and len(vocabulary):
                    known = vocabulary[np.minimum(np.searchsorted(vocabulary, value), len(vocabulary) - 1)] == value
                    value, at = value[known], np.concatenate([[0], np.cumsum(known)])[at]
                term, tf, at = runs_of(value, at)
                size = np.diff(at)
                lead = np.zeros(len(size), dtype=np.uint64)  # the least scrambled term: similar documents often share it
                if len(term):
                    lead[size > 0] = np.minimum.reduceat(mix(term, 31), at[:-1][size > 0])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), longs(n), longs(lead), longs(size), blobs(term, at), blobs(tf.astype(np.int64), at)],
                    names=["doc_id", "n", "lead", "size", "term", "tf"])
    return run


def _term_rows(batches):
    """(term, df) of the vectors of a task."""
    for batch in batches:
        held, count = np.unique(np.frombuffer(b"".join(batch.column("term").to_pylist()), dtype=np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([longs(held), longs(count)], names=["term", "df"])


# --- building ----------------------------------------------------------------------


def _dots(at: np.ndarray, column: np.ndarray, value: np.ndarray, dense: np.ndarray, low: int, high: int) -> np.ndarray:
    """Inner products of the rows low..high (none empty) of a sparse matrix with a dense vector."""
    a, b = at[low], at[high]
    return np.add.reduceat(value[a:b] * dense[column[a:b]], at[low:high] - a)


def _rows_in(order: np.ndarray, at: np.ndarray, column: np.ndarray, value: np.ndarray):
    size = np.diff(at)[order]
    out = np.zeros(len(order) + 1, dtype=np.int64)
    np.cumsum(size, out=out[1:])
    take = np.arange(out[-1]) + np.repeat(at[order] - out[:-1], size)
    return out, column[take], value[take]


def build_tree(doc_id: np.ndarray, row: np.ndarray, at: np.ndarray, term: np.ndarray, value: np.ndarray, leaf: int = LEAF, centre: int = CENTRE) -> dict:
    """Arrays of a ball tree. Node 0 is the root; node i holds documents low[i]..high[i], left[i] is its first child (or -1)."""
    known, column = np.unique(term, return_inverse=True)
    weight, n, width = value.astype(np.float64), len(doc_id), len(known)
    place = np.arange(n)
    low, high, left, radius, c_at, c_column, c_value = [0], [n], [-1], [0.0], [0], [], []
    node = 0
    while node < len(low):
        a, b = low[node], high[node]
        x, y = at[a], at[b]
        mean = np.bincount(column[x:y], weights=weight[x:y], minlength=width) / (b - a)
        kept = np.flatnonzero(mean) if mean.any() else np.zeros(1, np.int64)
        if len(kept) > centre:
            kept = np.sort(kept[np.argpartition(-mean[kept], centre)[:centre]])
        middle = np.zeros(width)
        middle[kept] = mean[kept]
        norm = np.add.reduceat(weight[x:y] ** 2, at[a:b] - x)
        own = float(np.dot(middle, middle))
        apart = norm - 2 * _dots(at, column, weight, middle, a, b) + own
        # Each of the three sums is off by less than its number of terms times 2^-52 of the sizes added up.
        slack = (norm + own) * (4 * (width + 8) * 2.0**-52)
        radius[node] = float(np.sqrt(np.max(np.maximum(apart, 0) + slack)) * (1 + 2.0**-40))
        c_column.append(kept)
        c_value.append(mean[kept])
        c_at.append(c_at[-1] + len(kept))
        if b - a > leaf:
            # Two far documents, and the halves of all by how much nearer they are to the one or the other.
            side = np.zeros(width)
            one = a + int(np.argmax(apart))
            side[column[at[one]:at[one + 1]]] = weight[at[one]:at[one + 1]]
            two = a + int(np.argmax(norm - 2 * _dots(at, column, weight, side, a, b)))
            side[column[at[two]:at[two + 1]]] -= weight[at[two]:at[two + 1]]
            order = np.argsort(_dots(at, column, weight, side, a, b), kind="stable") + a
            place[a:b] = place[order]
            inner, column[x:y], weight[x:y] = _rows_in(order, at, column, weight)
            at[a:b + 1] = inner + x
            half = a + (b - a + 1) // 2
            left[node] = len(low)
            low += [a, half]
            high += [half, b]
            left += [-1, -1]
            radius += [0.0, 0.0]
        node += 1
    return {"id": doc_id[place], "row": row[place], "at": at, "column": column.astype(np.int32), "value": weight.astype(np.int64).astype(np.int32),
            "term": known, "low": np.array(low, np.int32), "high": np.array(high, np.int32), "left": np.array(left, np.int32), "radius": np.array(radius),
            "centre_at": np.array(c_at, np.int64), "centre_column": np.concatenate(c_column).astype(np.int32), "centre_value": np.concatenate(c_value),
            "entries": len(column)}


_KINDS = {"id": np.int64, "row": np.int64, "at": np.int64, "column": np.int32, "value": np.int32, "term": np.uint64, "low": np.int32, "high": np.int32,
          "left": np.int32, "radius": np.float64, "centre_at": np.int64, "centre_column": np.int32, "centre_value": np.float64}
# A null doc_id sorts behind all others.
_LOST = np.iinfo(np.int64).max


def _trees(tree_docs: int, tree_entries: int, leaf: int, centre: int):
    def one(held):
        doc_id, row, m, size, term, tf = (np.concatenate(x) for x in zip(*held))
        at = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(size, out=at[1:])
        value = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, size))
        tree = build_tree(doc_id, row, at, term, value, leaf, centre)
        return pa.RecordBatch.from_arrays(
            [pa.array([tree[c].tobytes()], pa.binary()) for c in _KINDS] + [longs(np.array([tree["entries"]]))], names=[*_KINDS, "entries"])

    def run(batches):
        held, docs, entries = [], 0, 0
        for batch in batches:
            size = batch.column("size").to_numpy()
            low = 0
            while low < len(size):
                room = np.searchsorted(np.cumsum(size[low:]), tree_entries - entries, "right")
                high = min(low + max(int(room), 0 if docs else 1), low + tree_docs - docs, len(size))
                part = batch.slice(low, high - low)
                if high > low:
                    held.append((part.column("doc_id").fill_null(_LOST).to_numpy(), part.column("row").to_numpy(), part.column("m").to_numpy(), size[low:high],
                                 np.frombuffer(b"".join(part.column("term").to_pylist()), np.uint64), np.frombuffer(b"".join(part.column("tf").to_pylist()), np.int64)))
                    docs, entries = docs + high - low, entries + int(size[low:high].sum())
                if docs and (high < len(size) or docs >= tree_docs or entries >= tree_entries):
                    yield one(held)
                    held, docs, entries = [], 0, 0
                low = high
        if held:
            yield one(held)
    return run


# --- searching ---------------------------------------------------------------------


class _Tree:
    def __init__(self, blobs_of: dict):
        for name, kind in _KINDS.items():
            setattr(self, name, np.frombuffer(blobs_of[name], kind))

    def query(self, term: np.ndarray, weight: np.ndarray):
        """The query on the tree's own terms, as integers and as doubles, and its length."""
        at = np.minimum(np.searchsorted(self.term, term), len(self.term) - 1)
        known = self.term[at] == term
        if not known.any():
            return None
        dense = np.zeros(len(self.term), dtype=np.int64)
        dense[at[known]] = weight[known]
        return dense, dense.astype(np.float64), float(np.sqrt(np.sum(weight[known].astype(np.float64) ** 2)))

    def bounds(self, first: int, last: int, exact: np.ndarray, length: float) -> np.ndarray:
        """No document of the nodes first..last-1 scores more."""
        a, b = self.centre_at[first], self.centre_at[last]
        middle = np.add.reduceat(self.centre_value[a:b] * exact[self.centre_column[a:b]], self.centre_at[first:last] - a)
        return (middle + length * self.radius[first:last]) * (1 + 2.0**-32) + 1

    def scores(self, node: int, dense: np.ndarray) -> np.ndarray:
        return _dots(self.at, self.column, self.value, dense, self.low[node], self.high[node])


def search_trees(trees: list[_Tree], term: np.ndarray, weight: np.ndarray, k: int, seen: list | None = None) -> list[tuple[int, int, int]]:
    """The k best (score, doc_id, row) with a score above 0 over all the trees: higher scores, then smaller doc_ids and rows."""
    asked = [t.query(term, weight) for t in trees]
    heap = [(-t.bounds(0, 1, q[1], q[2])[0], i, 0) for i, (t, q) in enumerate(zip(trees, asked)) if q is not None]
    heapq.heapify(heap)
    best: list[tuple[int, int, int]] = []  # (score, -doc_id, -row), the worst on top
    while heap:
        bound, i, node = heapq.heappop(heap)
        if len(best) == k and -bound < best[0][0]:  # an equal score may still win by its doc_id
            break
        tree, (dense, exact, length) = trees[i], asked[i]
        child = int(tree.left[node])
        if child >= 0:
            for j, b in enumerate(tree.bounds(child, child + 2, exact, length)):
                if len(best) < k or b >= best[0][0]:
                    heapq.heappush(heap, (-b, i, child + j))
            continue
        score = tree.scores(node, dense)
        if seen is not None:
            seen[0] += len(score)
        able = np.flatnonzero(score >= (best[0][0] if len(best) == k else 1))
        if len(able) > k:
            at = tree.low[node] + able
            able = able[np.lexsort((tree.row[at], tree.id[at], -score[able]))[:k]]
        for d in able:
            found = (int(score[d]), -int(tree.id[tree.low[node] + d]), -int(tree.row[tree.low[node] + d]))
            if len(best) < k:
                heapq.heappush(best, found)
            elif found > best[0]:
                heapq.heapreplace(best, found)
    return [(s, -d, -r) for s, d, r in best]


_HITS = "item bigint, score bigint, doc_id bigint, row bigint"


def _search(k: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        trees = [_Tree(dict(zip(_KINDS, parts))) for parts in zip(*[index.column(c).to_pylist() for c in _KINDS])]
        found = []
        if trees:
            for item, term, weight in zip(*[queries.column(c).to_pylist() for c in ("item", "term", "weight")]):
                hits = search_trees(trees, np.frombuffer(term, np.uint64), np.frombuffer(weight, np.int64), k)
                found += [(item, s, None if d == _LOST else d, r) for s, d, r in hits]
        columns = list(zip(*found)) or [[], [], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("item", "score", "doc_id", "row"), columns)})
    return run


# --- the jobs ----------------------------------------------------------------------


def _numbered(rows: DataFrame) -> DataFrame:
    return written(rows.withColumn("row", F.monotonically_increasing_id()))


def _packed(batches):
    """Rows (item, [(term, weight)]) to sorted 64-bit arrays."""
    for batch in batches:
        out = []
        for item, pairs in zip(batch.column("item").to_pylist(), batch.column("pairs").to_pylist()):
            pairs = sorted((p["term"] % 2**64, p["weight"]) for p in pairs)
            out.append((item, np.array([t for t, _ in pairs], np.uint64).tobytes(), np.array([w for _, w in pairs], np.int64).tobytes()))
        columns = list(zip(*out)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())],
                                         names=["item", "term", "weight"])


def _item_terms(batches):
    for batch in batches:
        term = [np.frombuffer(t, np.int64) for t in batch.column("term").to_pylist()]
        tf = [np.frombuffer(t, np.int64) for t in batch.column("tf").to_pylist()]
        size = [len(t) for t in term]
        flat = [np.concatenate([*x, np.zeros(0, np.int64)]) for x in (term, tf)]
        yield pa.RecordBatch.from_arrays([longs(np.repeat(batch.column("row").to_numpy(), size)), longs(flat[0]), longs(flat[1])], names=["item", "term", "tf"])


class Index:
    """Ball trees over documents for the terms of some queries, the documents' term frequencies, and their number."""

    def __init__(self, trees: DataFrame, frequencies: DataFrame, documents: int):
        self.trees, self.frequencies, self.documents = trees, frequencies, documents


def build_index(docs: DataFrame, asked: DataFrame, tree_docs: int = TREE_DOCS, tree_entries: int = TREE_ENTRIES, leaf: int = LEAF,
                centre: int = CENTRE, most_terms: int = MOST_TERMS) -> Index:
    """Index every document on the terms in ``asked``: others add nothing to a score of these queries.

    Where the queries have more terms than may be shipped, documents are indexed on all of theirs, with equal results.
    """
    vocabulary = written(asked.select("term").distinct())
    known = None
    if vocabulary.count() <= most_terms:
        known = np.sort(vocabulary.toArrow().column("term").to_numpy().view(np.uint64))
    vectors = _numbered(needs(docs, "doc_id", "text").mapInArrow(_vectors(known), _VECTORS))
    total = vectors.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    frequencies = vectors.where("size > 0").select("term").mapInArrow(_term_rows, "term bigint, df bigint")
    frequencies = written(frequencies.groupBy("term").agg(F.sum("df").alias("df")).join(vocabulary, "term", "left_semi"))
    # In decimals: 75 n N passes 64 bits where a very large corpus holds a very long text.
    length = F.expr(f"25 + (cast({75 * total.docs} as decimal(20, 0)) * cast(n as decimal(18, 0))) div cast({total.terms or 1} as decimal(20, 0))")
    placed = vectors.where("size > 0").withColumn("m", length).repartitionByRange("lead", "row").sortWithinPartitions("lead", "row")
    trees = placed.select("doc_id", "row", "m", "size", "term", "tf").mapInArrow(_trees(tree_docs, tree_entries, leaf, centre), _TREE)
    # A tree's own number; ``row`` is taken by the documents' numbers.
    return Index(written(trees.withColumn("tree", F.monotonically_increasing_id())), frequencies, total.docs)


def _dealt(index: Index, queries: DataFrame, cell_entries: int, query_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Trees by cell and queries by block, each pair of cell and block once: all queries meet all trees, a few at a time."""
    held = index.trees.agg(F.count(F.lit(1)).alias("trees"), F.sum("entries").alias("entries")).first()
    cells = max(1, min(held.trees, -(-(held.entries or 0) // cell_entries)))
    size = queries.agg(F.sum(F.octet_length("term") + F.octet_length("weight"))).first()[0] or 0
    blocks = max(1, -(-size // query_bytes))
    trees = index.trees.withColumns({"cell": F.pmod(F.xxhash64("tree"), F.lit(cells)), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    asked = queries.withColumns({"block": F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"), "cell": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long")))})
    return trees, asked


def search(docs: DataFrame, items: DataFrame, k: int = 10, cell_entries: int = CELL_ENTRIES, query_bytes: int = QUERY_BYTES, **options) -> DataFrame:
    """The ``k`` best documents (doc_id, text) of each item (item_id, text): item, item_id, rank, row, doc_id, score.

    Equal scores rank by doc_id (nulls last), then by row number, so repeated rows have ranks of their own; so have
    repeated items, whose ``item`` numbers differ. A null or wordless text has no terms: as a document it is never
    found, as an item it finds nothing. Only scores above 0 rank. Very long texts are indexed and asked whole. An
    empty table on either side gives no rows. Other columns are not read. ``options`` are those of build_index.
    """
    send_code(docs.sparkSession)
    asked = _numbered(needs(items, "item_id", "text").withColumnRenamed("item_id", "doc_id").mapInArrow(_vectors(None), _VECTORS))
    item_terms = written(asked.where("size > 0").select("row", "term", "tf").mapInArrow(_item_terms, "item bigint, term bigint, tf bigint"))
    index = build_index(docs, item_terms, **options)
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * index.documents + 2.0) / (2.0 * F.col("df") + 1.0)))
    weighted = item_terms.join(index.frequencies, "term").select("item", "term", (weight * F.col("tf")).alias("weight")).where("weight > 0")
    queries = written(weighted.groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("pairs"))
                      .mapInArrow(_packed, "item bigint, term binary, weight binary"))
    trees, dealt = _dealt(index, queries, cell_entries, query_bytes)
    found = trees.groupBy("cell", "block").cogroup(dealt.groupBy("cell", "block")).applyInArrow(_search(k), _HITS)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = asked.select(F.col("row").alias("item"), F.col("doc_id").alias("item_id"))
    return best.join(names, "item").select("item", "item_id", "rank", "row", "doc_id", "score")
