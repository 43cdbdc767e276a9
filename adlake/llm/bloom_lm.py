"""Language-model scoring with log-frequency Bloom filters.

Counts of words and word pairs are gathered over all training texts, quantised to levels, and stored in Bloom filters:
a name of level l is there as (name, 1) .. (name, l). Its count is read back by probing one level after the other until
one is missing. The probability of a word mixes both counts:

    p(w | h) = share * min(1, low f(hw) / high f(h)) + (1 - share) * (low f(w) + a) / (N + a (V + 1))

where low and high are the least and the largest count of a level, and share is the part of training pairs that would
still be known if their own occurrence were left out (deleted interpolation). low f(hw) sums to f(h) at most over all w,
and low f(w) to N, so p(. | h) sums to 1 at most over the vocabulary and one unknown word, but for what the filters read
by mistake (about 1 % of the names asked that they do not hold, nearly always at level 1).

All counts are stored from level 1 on at every size of input: words and pairs are dealt to buckets by hash, as many as
the training text needs, each with a filter of ``BITS_PER_ENTRY`` bits an entry; what grows with the input is never
broadcast. The texts to be scored ask by the same hash: a chunk of texts sends its distinct words and pairs to their
buckets and gets their counts back. A bucket also has its words' exact counts, for the base score alone. The
``head_words`` most frequent words go by broadcast, with a filter of their own; no chunk need ask for them.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adlake.llm.tables import needs, row_key, send_code, written
from adlake.llm.words import U, longs, mix, row_sums, slices, words

BUCKET_BYTES = 16 << 20  # text per counting bucket
CHUNK_BYTES = 4 << 20  # text that asks for its counts at once
LEAST_BITS = 1 << 16  # of a bucket's filter, however few its pairs
SEGMENTS, PROBES, BITS_PER_ENTRY = 128, 4, 10
_PAIR_BYTES = 5
_FLUSH = 1_200_000  # tokens that a task gathers before it sends their counts
ALPHA = 0.1
END, BEGIN = mix(np.array([1, 2], dtype=np.uint64), 91)
# Least counts of the levels 1, 2, ..: doubling in two steps.
LEVELS = np.array([1, 2] + [x << k for k in range(62) for x in (3, 4)][:100], dtype=np.uint64)
LOW, HIGH = np.append(0.0, LEVELS[:-1].astype(float)), np.append(0.0, LEVELS[1:].astype(float) - 1)
VALUES = (LOW + HIGH) / 2


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of each row with one end token behind them, the row offsets, and the histories (begin first)."""
    found, at = words(texts)
    rows = len(at) - 1
    out_at = at + np.arange(rows + 1)
    out = np.empty(len(found) + rows, dtype=np.uint64)
    ends = np.zeros(len(out), dtype=bool)
    ends[out_at[1:] - 1] = True
    out[ends] = END
    out[~ends] = found
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[out_at[:-1]] = BEGIN
    return out, out_at, before


def pairs(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A pair's name: half of the hash of either word."""
    return (before & U(0xFFFFFFFF00000000)) | (word >> U(32))


def _packed(names: np.ndarray, order: int) -> bytes:
    """Names as bytes; within its bucket a pair's name of 40 bits is enough, and a word's is whole."""
    return (names if order == 1 else names.view(np.uint8).reshape(-1, 8)[:, :_PAIR_BYTES]).tobytes()


def _unpacked(raw, order: int) -> np.ndarray:
    if order == 1:
        return np.frombuffer(raw, dtype=np.uint64)
    short = np.frombuffer(raw, dtype=np.uint8).reshape(-1, _PAIR_BYTES)
    out = np.zeros((len(short), 8), dtype=np.uint8)
    out[:, :_PAIR_BYTES] = short
    return out.reshape(-1).view(np.uint64)


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(names, 51) % U(buckets)).astype(np.int64)


def _dealt(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list]:
    """The order of names by bucket, the buckets that have some, and where each begins and ends in that order."""
    bucket = _bucket(names, buckets)
    by = np.argsort(bucket, kind="stable")
    kinds, begin = np.unique(bucket[by], return_index=True)
    return by, kinds, list(zip(begin, np.append(begin[1:], len(names))))


def _inner(names: np.ndarray, order: int) -> np.ndarray:
    """Names as they are called within their bucket."""
    return names if order == 1 else mix(names, 53) >> U(64 - 8 * _PAIR_BYTES)


def _tally(buckets: int):
    """Counts of words (order 1) and pairs (order 2), combined per task before they are sent to their buckets."""
    def run(batches):
        held, size = {1: [], 2: []}, 0

        def flush():
            for order, parts in held.items():
                if not parts:
                    continue
                names, counts = np.unique(np.concatenate(parts), return_counts=True)
                by, kinds, spans = _dealt(names, buckets)
                names, counts = _inner(names[by], order), counts[by].astype(np.uint32)
                # One byte a count, the few large ones written out behind.
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(kinds), order), pa.int32()), pa.array(kinds, pa.int64()),
                    pa.array([_packed(names[a:b], order) for a, b in spans], pa.binary()),
                    pa.array([_short(counts[a:b]) for a, b in spans], pa.binary())], names=["n", "bucket", "names", "counts"])
                parts.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                word, at, before = tokens(part.column(0))
                held[1].append(word)
                held[2].append(pairs(before, word))
                size += len(word)
                if size > _FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()
    return run


def _short(counts: np.ndarray) -> bytes:
    """Counts as bytes, 255 standing for the large ones that follow as 64-bit numbers."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def _long(raw: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(raw, dtype=np.uint8, count=n).astype(np.uint64)
    counts[counts == 255] = np.frombuffer(raw, dtype="<u8", offset=n)
    return counts


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, "right")


def _summed(group: pa.Table) -> pa.Table:
    """All counts of a bucket with their statistics: a filter of the size that they need, and words also as they are."""
    order, bucket = group.column("n")[0].as_py(), group.column("bucket")[0].as_py()
    parts = [_unpacked(x.as_buffer(), order) for x in group.column("names")]
    counts = np.concatenate([_long(c.as_py(), len(p)) for c, p in zip(group.column("counts"), parts)])
    names, place = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(place, weights=counts).astype(np.uint64)
    levels = level_of(total)
    kept = slice(None) if order == 1 else slice(0)
    return pa.table({
        "n": pa.array([order], pa.int32()), "bucket": pa.array([bucket], pa.int64()), "names": pa.array([names[kept].tobytes()], pa.binary()),
        "counts": pa.array([_short(total[kept])], pa.binary()), "filter": pa.array([log_filter(names, levels).tobytes()], pa.binary()),
        "histogram": pa.array([np.bincount(levels, minlength=len(LEVELS) + 1).tolist()], pa.list_(pa.int64())),
        "tokens": pa.array([float(counts.sum())], pa.float64()), "kinds": pa.array([len(levels)], pa.int64())})


def _bits(names: np.ndarray, level: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first probe's bit number of (name, level), and how far the next ones are from it."""
    y = mix(names, 200 + level)
    at, step = (y & U(0xFFFFFFFF)) % U(bits), ((y >> U(32)) | U(1)) % U(bits)
    return at.astype(np.int64), step.astype(np.int64)


def log_filter(names: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The filter's bytes, with a name of level l put in as (name, 1) .. (name, l)."""
    bits = np.zeros(max(-(-int(levels.sum()) * BITS_PER_ENTRY // 64) * 64, LEAST_BITS), dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        at, step = _bits(names[levels >= level], level, len(bits))
        for _ in range(PROBES):
            bits[at] = True
            at = (at + step) % len(bits)
    return np.packbits(bits, bitorder="little")


def read_levels(raw: np.ndarray, names: np.ndarray) -> np.ndarray:
    """How many levels of each name are in the filter, from the first on."""
    levels, live = np.zeros(len(names), dtype=np.int64), np.arange(len(names))
    for level in range(1, len(LEVELS)):
        at, step = _bits(names[live], level, 8 * len(raw))
        for _ in range(PROBES):
            there = (raw[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            live, step = live[there], step[there]
            at = (at[there] + step) % (8 * len(raw))
        if not len(live):
            break
        levels[live] = level
    return levels


def held_out_fold(column: str = "doc_id"):
    """Documents that are scored only; a null doc_id counts as empty text, so it is one of them."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 10 == 0


def train(docs: DataFrame, head_words: int = 1 << 16) -> dict:
    """The model of all texts of ``docs``: the table ``stored`` (by bucket: filters of words and of pairs, exact word
    counts) in the shared folder, the head words (bounded) on the driver.

    A null text is an empty one and still has its end token. Without documents all counts are 0.
    """
    spark = docs.sparkSession
    send_code(spark)
    rows = needs(docs, "text")
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    buckets = max(-(-total // BUCKET_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    tallied = rows.mapInArrow(_tally(buckets), "n int, bucket bigint, names binary, counts binary")
    summed = written(tallied.groupBy("n", "bucket").applyInArrow(
        _summed, "n int, bucket bigint, names binary, counts binary, filter binary, histogram array<bigint>, tokens double, kinds bigint"))
    # One row per order: histograms are added level by level.
    stats = {r["n"]: r for r in summed.groupBy("n").agg(
        F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds"),
        F.array(*[F.sum(F.get("histogram", F.lit(i))) for i in range(len(LEVELS) + 1)]).alias("histogram")).collect()}
    histogram = {n: np.array(stats[n]["histogram"] if n in stats else [0] * (len(LEVELS) + 1)) for n in (1, 2)}

    def rows_of(batches):
        for batch in batches:
            for row in batch.to_pylist():
                names = np.frombuffer(row["names"], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([longs(names), longs(_long(row["counts"], len(names)))], names=["hash", "n"])

    vocabulary = summed.where("n = 1").select("names", "counts").mapInArrow(rows_of, "hash bigint, n bigint")
    # The frequent words: all of a level and above, as many levels as there is room for.
    at_least = np.cumsum(histogram[1][::-1])[::-1]
    level = next((i for i in range(1, len(at_least)) if at_least[i] <= head_words), len(LEVELS))
    head = vocabulary.where(F.col("n") >= int(LEVELS[level - 1])).toPandas().sort_values("hash")
    head = head["hash"].to_numpy(np.int64), head["n"].to_numpy(np.int64)
    # Stored pairs less one occurrence each: what would still be known of a training text left out.
    again = float((histogram[2][2:len(VALUES)] * (VALUES[2:] - 1)).sum())
    one, two = stats.get(1), stats.get(2)
    return {
        "stored": summed.select("n", "bucket", "names", "counts", "filter"), "buckets": buckets,
        "N": int(one["tokens"]) if one else 0, "V": int(one["kinds"]) if one else 0,
        "share": min(0.95, again / two["tokens"]) if two else 0.0,
        "head": head, "head_filter": log_filter(head[0].view(np.uint64), level_of(head[1].astype(np.uint64)))}


def _in_head(names: np.ndarray, head: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Whether words are head words, and the counts of those that are."""
    known, n = head
    if not len(known):
        return np.zeros(len(names), dtype=bool), np.zeros(len(names), dtype=np.int64)
    own = names.view(np.int64)
    spot = np.minimum(np.searchsorted(known, own), len(known) - 1)
    found = known[spot] == own
    return found, np.where(found, n[spot], 0)


def _ask(sent, buckets: int, parts: int):
    """The distinct words (but head words) and pairs of a chunk of texts, for their buckets."""
    def run(group: pa.Table) -> pa.Table:
        chunk = group.column("chunk")[0].as_py()
        word, _, before = tokens(group.column("text"))
        orders, to, blobs = [], [], []
        for order, names in ((1, np.unique(word)), (2, np.unique(pairs(before, word)))):
            if order == 1:
                names = names[~_in_head(names, sent.value["head"])[0]]
            by, kinds, spans = _dealt(names, buckets)
            names = _inner(names[by], order)
            orders += [order] * len(kinds)
            to += kinds.tolist()
            blobs += [_packed(names[a:b], order) for a, b in spans]
        return pa.table({"chunk": pa.array([chunk] * len(to), pa.int64()), "part": pa.array([chunk % parts] * len(to), pa.int32()),
                         "n": pa.array(orders, pa.int32()), "bucket": pa.array(to, pa.int64()), "names": pa.array(blobs, pa.binary())})
    return run


def _answer(asked: pa.Table, stored: pa.Table) -> pa.Table:
    """Levels, and of words also exact counts behind them, in the order that they were asked for."""
    answers = []
    if asked.num_rows:
        order = asked.column("n")[0].as_py()
        each = [_unpacked(x.as_buffer(), order) for x in asked.column("names")]
        names = np.concatenate(each)
        cuts = np.cumsum([len(x) for x in each])[:-1]
        levels, exact = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.uint64)
        if stored.num_rows:
            levels = read_levels(np.frombuffer(stored.column("filter")[0].as_buffer(), dtype=np.uint8), names)
            if order == 1:
                known = np.frombuffer(stored.column("names")[0].as_buffer(), dtype=np.uint64)
                n = _long(stored.column("counts")[0].as_py(), len(known))
                spot = np.minimum(np.searchsorted(known, names), len(known) - 1)
                exact = np.where(known[spot] == names, n[spot], U(0))
        answers = [x.astype(np.uint8).tobytes() for x in np.split(levels, cuts)]
        if order == 1:
            answers = [a + _short(x) for a, x in zip(answers, np.split(exact, cuts))]
    return pa.table({"chunk": asked.column("chunk").cast(pa.int64()), "n": asked.column("n").cast(pa.int32()),
                     "bucket": asked.column("bucket").cast(pa.int64()), "counts": pa.array(answers, pa.binary())})


def _told(names: np.ndarray, order: int, answers: dict, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """What a chunk's names were answered: levels, and exact counts of words."""
    by, kinds, spans = _dealt(names, buckets)
    levels, exact = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
    for bucket, (a, b) in zip(kinds.tolist(), spans):
        raw = answers[order, bucket]
        levels[by[a:b]] = np.frombuffer(raw, np.uint8, b - a)
        if order == 1:
            exact[by[a:b]] = _long(raw[b - a:], b - a)
    return levels, exact


def _score_chunk(sent, buckets: int):
    """Scores of a chunk's texts from the answers to it."""
    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        model = sent.value
        answers = {(n, b): c for n, b, c in zip(*[told.column(x).to_pylist() for x in ("n", "bucket", "counts")])}
        word, at, before = tokens(texts.column("text"))
        kinds, place = np.unique(word, return_inverse=True)
        frequent, exact = _in_head(kinds, model["head"])
        levels = np.zeros(len(kinds), dtype=np.int64)
        levels[frequent] = read_levels(model["head_filter"], kinds[frequent])
        levels[~frequent], exact[~frequent] = _told(kinds[~frequent], 1, answers, buckets)
        floor = model["N"] + ALPHA * (model["V"] + 1)
        base = np.log10((exact + ALPHA) / floor)
        both, where = np.unique(pairs(before, word), return_inverse=True)
        each = np.log10(mixed(levels, place, at, _told(both, 2, answers, buckets)[0][where], model["share"], floor))
        return pa.table({
            "doc_id": texts.column("doc_id"), "row_key": texts.column("row_key"), "n_tokens": pa.array(np.diff(at)), "n_known": pa.array(row_sums((exact[place] > 0).astype(np.int64), at)),
            "base_score": pa.array(np.add.reduceat(base[place], at[:-1])), "score": pa.array(np.add.reduceat(each, at[:-1]))})
    return run


def mixed(levels: np.ndarray, place: np.ndarray, at: np.ndarray, together: np.ndarray, share: float, floor: float) -> np.ndarray:
    """The probability of each token, from the levels of words (by place) and of the pairs that tokens end."""
    # The history's count; a begin is followed once per document, as an end is preceded.
    before = np.empty(len(place), dtype=np.int64)
    before[1:] = place[:-1]
    before[at[:-1]] = place[at[1:] - 1]
    history = HIGH[levels][before]
    near = np.where(history > 0, np.minimum(LOW[together] / np.maximum(history, 1), 1), 0)
    return share * near + (1 - share) * ((LOW[levels] + ALPHA) / floor)[place]


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, row_key, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Tokens are words with A-Z lower-cased and one end. ``score`` is the model's log10 probability of the text;
    ``base_score`` the sum of log10((c + 0.1) / (N + 0.1 (V + 1))) over its tokens, with exact counts. A null or empty
    text has its end token alone. Rows that repeat doc_id and text are scored each, alike.
    """
    spark = docs.sparkSession
    send_code(spark)
    rows = needs(docs, "doc_id", "text").select("text", F.struct("doc_id", row_key("doc_id", "text").alias("row_key")).alias("key"))
    # Chunks of texts ask the buckets that their words and pairs belong to and are scored with the answers.
    buckets = model["buckets"]
    sent = spark.sparkContext.broadcast({k: model[k] for k in ("head", "head_filter", "share", "N", "V")})
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    chunks = max(-(-total // CHUNK_BYTES), spark.sparkContext.defaultParallelism)
    # Far more text than the model was made of: as many copies of a bucket share its work.
    parts = max(1, -(-total // (2 * buckets * BUCKET_BYTES)))
    # Rows that repeat a document would share a chunk: one of them is scored, for all.
    copies = written(rows.groupBy("key").count().where("count > 1").withColumnRenamed("key", "_copy"))
    repeated = copies.count()
    if repeated:
        same = F.col("key").eqNullSafe(F.col("_copy"))
        rows = rows.join(copies, same, "left_anti").select("key", "text").unionByName(
            rows.join(copies, same, "left_semi").groupBy("key").agg(F.first("text").alias("text")))
    # Both reads of it are one exchange.
    texts = rows.select(F.pmod(F.col("key.row_key"), F.lit(chunks)).cast("long").alias("chunk"), "key.doc_id", "key.row_key", "text").groupBy("chunk")
    asked = texts.applyInArrow(_ask(sent, buckets, parts), "chunk bigint, part int, n int, bucket bigint, names binary")
    stored = model["stored"].withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    where = ["part", "n", "bucket"]
    told = asked.groupBy(*where).cogroup(stored.groupBy(*where)).applyInArrow(_answer, "chunk bigint, n int, bucket bigint, counts binary")
    out = texts.cogroup(told.groupBy("chunk")).applyInArrow(
        _score_chunk(sent, buckets), "doc_id bigint, row_key bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    if repeated:
        same = (F.col("row_key") == F.col("_copy.row_key")) & F.col("doc_id").eqNullSafe(F.col("_copy.doc_id"))
        out = out.join(copies, same, "left").withColumn(
            "_each", F.explode(F.sequence(F.lit(1), F.coalesce("count", F.lit(1)))))
    return out.select("doc_id", "row_key", "n_tokens", "n_known", F.lit(model["N"]).cast("long").alias("train_tokens"),
                      "base_score", "score")
