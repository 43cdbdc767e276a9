"""Lookups of any size as tables (N5, N6, X10): indexed joins instead of an array that each row walks through."""

from pyspark.sql import Column, DataFrame, functions as F

from adlake import fixed_values as fv
from adlake.functions.place import place_columns
from adlake.functions.text import folded, whole_word, words_of

# The largest gram; the others are the powers of two below it.
GRAM = 16


def _sizes(gram: int) -> list[int]:
    return [1 << i for i in range(gram.bit_length()) if 1 << i < gram] + [gram]


def _grams(text: Column, size: Column | int) -> Column:
    """All distinct substrings of one length."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.length(text) - size + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, size)))


def contained_keys(texts: DataFrame, keys: DataFrame, gram: int = GRAM) -> DataFrame:
    """(text, *columns of keys) for every distinct text and key with the key inside the text.

    ``texts`` has a distinct column ``text``, ``keys`` a column ``key``; both are compared as they are. A key is indexed
    by the one of its grams that fewest keys have, of the largest size in ``_sizes`` that it has, so that a gram is at least
    half of a key of less than two grams and the keys that share one stay few as the lookup grows. A text asks with all of
    its grams of these sizes, and candidates are then verified. Empty keys are in every text and are given to none.

    A key costs what its rows cost, so callers give each key once. Both sides may be large and pack well: they are merged,
    as a side that is small when packed is not small in the driver that would have to broadcast it.
    """
    sizes = _sizes(gram)
    length, own = F.length("key"), F.lit(1)
    for size in sizes[1:]:
        own = F.when(length >= size, F.lit(size)).otherwise(own)
    keyed = keys.where(length > 0).withColumn("_gram", F.explode(_grams(F.col("key"), own)))
    common = keyed.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = keyed.select("key", "_gram").join(common.hint("merge"), "_gram").groupBy("key").agg(
        F.min(F.struct("_n", "_gram"))["_gram"].alias("_gram"))
    index = keys.join(rarest.hint("merge"), "key")
    asked = texts.select("text", F.explode(F.flatten(F.array(*[_grams(F.col("text"), n) for n in sizes]))).alias("_gram"))
    return asked.join(index.hint("merge"), "_gram").where(F.contains("text", "key")).drop("_gram")


def with_place_from(df: DataFrame, text: str, lookup: DataFrame, order: str, city: str, region: str) -> DataFrame:
    """N5 with a lookup table: the city that comes first by ``order`` wins, as in ``with_place``."""
    low = F.lower(F.col(text))
    # Of the rows of one key the first alone can win.
    keys = lookup.groupBy(F.lower(F.col(city)).alias("key")).agg(
        F.min(F.struct(F.col(order).alias("_pos"), F.col(city).alias("_city"), F.col(region).alias("_region"))).alias("_first"))
    # Few distinct texts stand for many rows.
    texts = df.select(low.alias("text")).where("text IS NOT NULL").distinct()
    won = contained_keys(texts, keys).groupBy("text").agg(F.min("_first").alias("_won"))
    placed = won.select(F.col("text").alias("_text"), F.struct(F.col("_won._city").alias("city"), F.col("_won._region").alias("region")).alias("_place"))
    joined = df.join(placed.hint("merge"), low == F.col("_text"), "left").drop("_text")
    return place_columns(joined, low).drop("_place")


def categorised_from(names: DataFrame, lookup: DataFrame, other: str = fv.OTHER_CATEGORY) -> DataFrame:
    """N6 with a lookup table (pos, name, category): an equal name first, else the first one inside, else ``other``."""
    low = F.lower("name")
    # Of the rows of one key the first alone can win.
    keys = lookup.groupBy(F.lower("name").alias("key")).agg(
        F.min(F.struct(F.col("pos").alias("_pos"), F.col("category").alias("_category"))).alias("_first"))
    texts = names.select(low.alias("text")).where("text IS NOT NULL").distinct()
    won = contained_keys(texts, keys).groupBy("text").agg(
        F.min(F.struct(F.col("key") != F.col("text"), F.col("_first")))["_first"]["_category"].alias("_category"))
    joined = names.join(won.hint("merge"), low == F.col("text"), "left").drop("text")
    return joined.withColumn("category", F.when(F.col("name").isNotNull(), F.coalesce("_category", F.lit(other)))).drop("_category")


def keywords_from(docs: DataFrame, key: str, text: str, keywords: DataFrame) -> DataFrame:
    """X10 with a keyword table (pos, keyword): per document the keywords found as whole words, in order of ``pos``.

    ``key`` identifies documents. A text is cut into words once; a keyword is asked for by its longest word, which must be
    a whole word of the text, and one with other signs is then verified in the text. Keywords without any word character
    are verified in all texts. Documents without keywords are not returned.
    """
    low = docs.select(F.col(key).alias("_doc"), folded(F.col(text)).alias("_text"))
    listed = keywords.groupBy("keyword").agg(F.min("pos").alias("pos")).withColumn("_low", F.lower("keyword"))
    words = words_of(F.col("_low"))
    listed = listed.withColumns({
        "word": F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"], "_whole": whole_word(F.col("_low"))})
    tokens = low.select("_doc", F.explode(F.array_distinct(words_of(F.col("_text")))).alias("word"))
    met = tokens.join(listed, "word")
    plain = met.where(F.col("_low") == F.col("word")).select("_doc", "pos", "keyword")
    open_ = met.where(F.col("_low") != F.col("word")).select("_doc", "pos", "keyword", "_low", "_whole")
    open_ = low.join(open_, "_doc")
    unworded = listed.where(F.col("word").isNull()).select("pos", "keyword", "_low", "_whole")
    rest = low.join(unworded, F.contains("_text", "_low"))
    verified = [part.where(F.contains("_text", "_low") & F.expr("rlike(_text, _whole)")).select("_doc", "pos", "keyword")
                for part in (open_, rest.select(*open_.columns))]
    found = plain.unionByName(verified[0]).unionByName(verified[1])
    ordered = F.array_sort(F.collect_set(F.struct("pos", "keyword")))
    return found.groupBy(F.col("_doc").alias(key)).agg(F.transform(ordered, lambda k: k["keyword"]).alias("keywords"))
