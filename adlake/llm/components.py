"""Connected components of a link table by union-find in parts and star contraction between them."""

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adlake.llm.tables import send_code, written


def _forest(batches):
    """Union-find over the links of one task: a link to its root for every node met."""
    parent = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def out():
        links = [(x, root(x)) for x in parent if parent[x] != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.binary()),
                                           pa.array([r for _, r in links], pa.binary())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 500_000:  # a bounded table per task
            yield out()
            parent = {}
    yield out()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b), binary ids; a component is named by its smallest node.

    Rounds of large-star and small-star until the links stay the same; each round is written to the shared folder.
    No links, no rows; repeated links and links of a node to itself do no harm.
    """
    send_code(links.sparkSession)
    edges = written(links.select("a", "b").mapInArrow(_forest, "a binary, b binary").distinct())
    before = None
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(seen) == before or not seen[0]:
            break
        before = tuple(seen)
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        edges = written(small.where("a != b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b")).distinct()
