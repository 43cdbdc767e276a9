"""Order MinHash fingerprints in the DataFrame API.

A k-mer is a pair of neighbouring words (the last one ends with the text's end), numbered by its occurrence, so that
repeats count. Each of ``SIGNATURES`` hash functions selects two minimal k-mers, one from either half of the k-mers by
a hash bit; they are put in the order in which the text has them, and the pair is hashed. Moving a passage changes such
pairs even where the set of k-mers stays, so agreement follows edit distance rather than common words.

Texts are dealt out once, as texts; k-mers arise, are numbered and reduced to minima within the task that has the text.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from adlake.llm.tables import needs, row_key, written

SIGNATURES = 32
_POSITION_BITS = 28
_SPACE = "[\\x20\\x09-\\x0D]+"


def _kmers(text: Column) -> Column:
    words = F.filter(F.split(text, _SPACE, -1), lambda w: w != "")
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def minima(kmers: DataFrame, *key: str) -> DataFrame:
    """(key, fingerprint) from rows (key, h array of k-mer hashes). Rows of a key must be in one partition already.

    Rows that repeat a key and its k-mers change nothing. No k-mers, no row.
    """
    each = kmers.select(*key, F.posexplode("h").alias("pos", "h"))
    number = F.dense_rank().over(Window.partitionBy("h", *key).orderBy("pos"))
    named = each.select(*key, "pos", F.xxhash64("h", number).alias("g"))
    place = F.least("pos", F.lit(2**_POSITION_BITS - 1)).cast("long")

    def packed(j):
        high = F.shiftleft(F.shiftright(F.xxhash64("g", F.lit(j)), _POSITION_BITS), _POSITION_BITS)
        return F.min(high.bitwiseOR(place)).alias(f"m{j}")

    halves = named.groupBy(*key, F.col("g").bitwiseAND(1).alias("half")).agg(*[packed(j) for j in range(SIGNATURES)])
    both = halves.groupBy(*key).agg(*[F.max(F.when(F.col("half") == half, F.col(f"m{j}"))).alias(f"m{j}_{half}")
                                      for j in range(SIGNATURES) for half in (0, 1)])

    def component(j):
        a, b = F.col(f"m{j}_0"), F.col(f"m{j}_1")
        mask = F.lit(2**_POSITION_BITS - 1)
        first = F.coalesce(a.bitwiseAND(mask) <= b.bitwiseAND(mask), F.lit(True))
        a, b = F.shiftright(a, _POSITION_BITS), F.shiftright(b, _POSITION_BITS)
        pair = F.when(first, F.xxhash64(a, b, F.lit(1))).otherwise(F.xxhash64(b, a, F.lit(2)))
        return F.lpad(F.hex(pair.bitwiseAND(0xFFFFFFFF)), 8, "0")

    return both.select(*key, F.concat(*[component(j) for j in range(SIGNATURES)]).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components, from 0 to 1; empty fingerprints are like each other and like no other."""
    def parts(x):
        return F.regexp_extract_all(x, F.lit("(.{8})"), F.lit(1))

    same = F.aggregate(F.zip_with(parts(a), parts(b), lambda x, y: (x == y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(same / SIGNATURES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, fingerprint (8 hex digits per signature) of every distinct (doc_id, text).

    A null text is empty; a text without words has the empty fingerprint. Equal texts have equal fingerprints.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = needs(docs, "doc_id", "text").select("doc_id", row_key("doc_id", "text").alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    found = minima(rows.repartition(2 * n, "row_key").select("row_key", _kmers(F.col("text")).alias("h")), "row_key")
    return rows.select("doc_id", "row_key").distinct().join(found, "row_key", "left").withColumn(
        "fingerprint", F.coalesce("fingerprint", F.lit("")))


def _stretch(column: Column, bounds: list) -> Column:
    """The number of bounds below a value, found in two steps of about the square root of their number."""
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    if not blocks:
        return F.lit(0)
    lasts = F.array(*[F.lit(b[-1]) for b in blocks])
    block = F.size(F.filter(lasts, lambda x: x < column))
    inner = F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks], F.array().cast("array<bigint>"))
    return block * step + F.size(F.filter(F.get(inner, F.least(block, F.lit(len(blocks)))), lambda x: x < column))


def with_next(docs: DataFrame) -> DataFrame:
    """Each distinct (doc_id, text) with the text that follows by falling doc_id, after the last the first.

    Columns part, doc_id, row_key, text, next_part, next_key, next_text; ties of doc_id go by row_key, a null doc_id
    comes last. Texts are dealt out once, by stretches of doc_id; each stretch also gets the first row of the next one.
    Stretches are cut at quantiles of doc_id; null ids are cut by row_key. All rows of one part are in one partition.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = needs(docs, "doc_id", "text").select("doc_id", row_key("doc_id", "text").alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / (8 * n) for i in range(1, 8 * n)]
    bounds = sorted({int(x) for x in ids.select("doc_id").approxQuantile("doc_id", shares, 1 / (32 * n)) or []})
    # Parts count downwards like doc_id: known ids first, then null ids by falling row_key.
    unknown = F.floor((F.lit(2.0**63) - F.col("row_key").cast("double")) / F.lit(2.0**64 / n))
    part = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1) + unknown).otherwise(F.lit(len(bounds)) - _stretch(F.col("doc_id"), bounds))
    rows = ids.withColumn("part", part.cast("long"))
    # One row per part: bounded by the number of parts.
    first = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row_key"))
    heads = [(r["part"], r["x"]["row_key"]) for r in rows.groupBy("part").agg(first.alias("x")).orderBy("part").collect()]
    moved = [(part, key, heads[i - 1][0]) for i, (part, key) in enumerate(heads)]
    guests = spark.createDataFrame(moved, "own_part bigint, guest bigint, host bigint")
    lent = rows.join(F.broadcast(guests), (F.col("row_key") == F.col("guest")) & (F.col("part") == F.col("own_part")))
    lent = lent.select("doc_id", "row_key", "text", F.col("host").alias("part"), "own_part", F.lit(1).alias("lent"))
    all_rows = rows.select("doc_id", "row_key", "text", "part", F.col("part").alias("own_part"), F.lit(0).alias("lent")).union(lent)
    dealt = all_rows.repartition(2 * n, "part")
    order = [F.col("lent"), F.col("doc_id").desc_nulls_last(), F.col("row_key").desc()]
    follows = Window.partitionBy("part").orderBy(*order)
    # Rows that repeat a document follow each other; one of them is enough.
    repeats = F.lag(F.struct("lent", "row_key")).over(follows) == F.struct("lent", "row_key")
    once = dealt.withColumn("again", F.coalesce(repeats, F.lit(False))).where("not again")
    out = once.select("*", *[F.lead(c).over(follows).alias(name) for c, name in
                             (("text", "next_text"), ("row_key", "next_key"), ("own_part", "next_part"))])
    return out.where("lent = 0").select("part", "doc_id", "row_key", "text", "next_part", "next_key", "next_text")


def edited_likeness(docs: DataFrame, share: int = 3) -> DataFrame:
    """Each distinct (doc_id, text) beside its edited text: the last 1/share of its code points replaced by as many of
    the next document's first (or all).

    doc_id, row_key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. With a single
    document the next is the document itself. Null texts are empty.
    """
    n_chars = F.char_length("text")
    cut = F.floor(n_chars / share).cast("int")
    rows = with_next(docs)
    edited = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n_chars - cut),
                                                F.substring(F.col("next_text"), F.lit(1), cut)))

    def key(which, column="row_key"):
        return F.xxhash64(column, F.lit(which))

    digests = written(edited.select("part", "doc_id", "row_key", "next_part", "next_key", n_chars.cast("long").alias("n_chars"),
                                    F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256")))
    texts = F.explode(F.array(F.struct(key(0).alias("key"), F.col("text")), F.struct(key(1).alias("key"), F.col("edited").alias("text"))))
    kmers = edited.select("part", texts.alias("x")).select("part", F.col("x.key").alias("key"), _kmers(F.col("x.text")).alias("h"))
    prints = written(minima(kmers, "part", "key"))

    def look(df, part, which, column, name):
        found = prints.select(F.col("part").alias("_part"), F.col("key").alias("_key"), F.col("fingerprint").alias(name))
        joined = df.join(found, (F.col(part) == F.col("_part")) & (key(which, column) == F.col("_key")), "left")
        return joined.drop("_part", "_key").withColumn(name, F.coalesce(name, F.lit("")))

    out = look(look(look(digests, "part", 0, "row_key", "fingerprint"), "part", 1, "row_key", "edited_fingerprint"),
               "next_part", 0, "next_key", "next_fingerprint")
    return out.select("doc_id", "row_key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                      likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                      likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
