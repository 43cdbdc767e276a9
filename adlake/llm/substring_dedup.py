"""Near-duplicate passages by compact windows.

Under a hash function every passage of ``t`` shingles or more has its least shingle at some place c; all passages of a
text with the same c make one compact window (l, c, r): those that begin in [l, c] and end in [c, r]. Its bounds are the
next smaller values on either side, the ancestors of c in the Cartesian tree of the hashes, which are themselves least
in some passage; so the tree is built on such places alone, about 2 / (t + 1) of a text. Two texts with a common passage
have windows with the same least shingle, whose intervals about it overlap by t or more; each of ``FUNCTIONS`` hash
functions gives another chance to meet, and what meets is verified on the texts.

Windows meet under the least shingle with the words that follow it (``CONTEXT`` words). Those of one task meet there,
at the task's first such window, which alone goes on; so a passage found in a third of the corpus sends a window
per task, and texts are compared with their group's first, never all with all.

A phrase of many texts that lies within a longer passage of some of them gives all of these the same first, which confirms
none. All windows of such a key therefore meet again, pair by pair as far as a link is possible: a link about a place needs
a number of distinct shingles of a run about it in common, so a window asks with each run's rarest ones, as many as leave too few
for a link, and the phrase that all of them share is not among these, nor is a word that junk repeats (prefix filtering; exact).
What is around both places then tells most pairs without a link from others before their texts are read.
"""

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from adlake.llm.components import components
from adlake.llm.tables import give_back, needs, row_key, send_code, written
from adlake.llm.words import U, mix, runs, shingles, slices, words

FUNCTIONS, CONTEXT = 6, 12
_DRIFT = 8  # words that an alignment may shift by within a passage
_MORE = 24  # places on either side of a place by which the runs about it that are looked at exceed a passage
_FLUSH = 1_500_000
LARGE = 1 << 15  # windows of a key that meet in one task, about 50 MB
_RECORD = np.dtype([("key", "<u8"), ("uid", "<i8"), ("c", "<u4"), ("left", "<u2"), ("right", "<u2")])
_LINK = [("doc_id", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("source_id", pa.int64()), ("source_start", pa.int64()),
         ("source_size", pa.int64()), ("similarity", pa.float64())]


def _sliding(values: np.ndarray, t: int, better) -> np.ndarray:
    """The least (or greatest) of every run of t values, at the run's first place."""
    out, span = values, 1
    while 2 * span <= t:
        out, span = better(out[:-span], out[span:]), 2 * span
    return better(out[:len(values) - t + 1], out[t - span:len(values) - t + 1 + t - span]) if span < t else out


def centres(values: np.ndarray, at: np.ndarray, t: int) -> np.ndarray:
    """Places that are least in some run of t values within their row."""
    if len(values) < t:
        return np.zeros(0, dtype=np.int64)
    least = _sliding(values, t, np.minimum)
    ends = np.repeat(at[1:], np.diff(at))[:len(least)]
    least = np.where(np.arange(len(least)) + t <= ends, least, U(0))  # runs across rows do not count
    padded = np.concatenate([np.zeros(t - 1, np.uint64), least, np.zeros(t - 1, np.uint64)])
    return np.flatnonzero(_sliding(padded, t, np.maximum) == values)


def windows(values: np.ndarray, at: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compact windows (l, c, r), inclusive; of equal least values the leftmost counts."""
    c = centres(values, at, t)
    row = np.searchsorted(at, c, "right") - 1
    # A sentinel smaller than all before each row's places and at the very end.
    first = np.flatnonzero(np.diff(row, prepend=-1))
    v = np.append(np.insert(values[c], first, U(0)), U(0))
    place = np.append(np.insert(c, first, -1), -1)
    n = len(v)

    def nearest(start, beats):
        near = start
        todo = np.flatnonzero(v > 0)
        while len(todo):
            todo = todo[beats(v[near[todo]], v[todo])]
            near[todo] = near[near[todo]]
        return near

    index = np.arange(n)
    before = nearest(np.maximum(index - 1, 0), lambda x, own: x > own)
    after = nearest(np.minimum(index + 1, n - 1), lambda x, own: x >= own)
    real = np.flatnonzero(v > 0)
    l, r = place[before[real]] + 1, place[after[real]] - 1
    l = np.where(v[before[real]] == 0, at[row], l)
    r = np.where(v[after[real]] == 0, at[row + 1] - 1, r)
    wide = r - l + 1 >= t
    return l[wide], c[wide], r[wide]


# Of every place at the beginning, how far its partner may lie behind it.
_BEHIND = np.arange(-_DRIFT, _DRIFT + 1)[:, None] >= -np.arange(_DRIFT)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which values of a are among b's, of the same length, at most ``_DRIFT`` places away."""
    n = len(a)
    wide = np.zeros(n + 2 * _DRIFT, dtype=np.uint64)
    wide[_DRIFT:-_DRIFT] = b
    same = np.ndarray((2 * _DRIFT + 1, n), np.uint64, wide, strides=(8, 8)) == a
    same[:, :_DRIFT] &= _BEHIND[:, :n]  # what lies beyond the ends of b does not count
    same[:, max(0, n - _DRIFT):] &= _BEHIND[::-1, ::-1][:, max(0, _DRIFT - n):]
    return same.any(axis=0)


def passages(a: np.ndarray, b: np.ndarray, met, t: int, percent: int) -> list:
    """Near-duplicate passages (a from, a to, b from, b to, similarity) of two shingle sequences around places that met, in order."""
    out, need = [], _least_common(t, percent)
    met = np.asarray(met, dtype=np.int64).reshape(-1, 2)
    todo = np.ones(len(met), dtype=bool)
    for place, (ca, cb) in enumerate(met.tolist()):
        if not todo[place] or (place and (met[place] == met[place - 1]).all()):
            continue
        reach = 4 * t
        while True:
            low, high = max(-ca, -cb, -reach), min(len(a) - ca, len(b) - cb, reach)
            if high - low < t:
                break
            same = _alike(a[ca + low:ca + high], b[cb + low:cb + high])
            sums = np.zeros(len(same) + 1, dtype=np.int64)
            np.cumsum(same, out=sums[1:])
            count = sums[t:] - sums[:-t]
            good = count >= need
            at = -low  # the place that met
            near = good[max(0, at - t + 1):at + 1]
            if not near.any():
                break
            begin = end = max(0, at - t + 1) + int(near.argmax())
            bad = np.flatnonzero(~good)
            after = int(np.searchsorted(bad, begin))
            begin, end = int(bad[after - 1]) + 1 if after else 0, int(bad[after]) - 1 if after < len(bad) else len(good) - 1
            grows = (begin == 0 and low == -reach) or (end == len(good) - 1 and high == reach)
            if grows:
                reach *= 4
                continue
            best = begin + int(count[begin:end + 1].argmax())
            one, two = (set(x[c + low + best:c + low + best + t].tolist()) for x, c in ((a, ca), (b, cb)))
            both = len(one & two)
            if 100 * both >= percent * (len(one) + len(two) - both):
                inside = np.flatnonzero(same[begin:end + t])
                # Without what does not match at the ends, but never less than the passage that was verified.
                lo, hi = low + min(begin + int(inside[0]), best), low + max(begin + int(inside[-1]) + 1, best + t)
                out.append((ca + lo, ca + hi, cb + lo, cb + hi, both / (len(one) + len(two) - both)))
                if place + 1 < len(met):
                    todo &= ~(_covers(out[-1], met[:, 0], met[:, 1]) & (abs(met[:, 1] - met[:, 0] - (cb - ca)) <= _DRIFT))
            break
    return out


def _covers(passage: tuple, ca: np.ndarray, cb: np.ndarray) -> np.ndarray:
    lo, hi, blo, bhi, _ = passage
    return (lo <= ca) & (ca < hi) & (blo <= cb) & (cb < bhi)


def _least_common(t: int, percent: int) -> int:
    """How many of t shingles two passages have in common at least."""
    return -(-2 * t * percent // (100 + percent))


def _links(doc_a, a, doc_b, b, ca: np.ndarray, cb: np.ndarray, t, percent, k) -> tuple[list, np.ndarray]:
    """Links of two texts around the places that met, and of each of these places whether a link confirms it."""
    order = np.lexsort((cb, ca))
    found = passages(a, b, np.stack([ca[order], cb[order]], axis=1), t, percent)
    links = [(doc_a, lo, hi - lo + k - 1, doc_b, blo, bhi - blo + k - 1, similarity) for lo, hi, blo, bhi, similarity in found]
    ok = np.zeros(len(ca), dtype=bool)
    for passage in found:
        ok |= _covers(passage, ca, cb)
    return links, ok


_PAIR = ["key", "a", "b", "ca", "cb"]
_PAIR_TYPES = "key bigint, a bigint, b bigint, ca bigint, cb bigint"


def _pairs(columns: list, ok: np.ndarray) -> list:
    """Columns of pairs and whether they are confirmed."""
    return [*(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns), pa.array(ok)]


def _no_pairs(n: int) -> list:
    return [*[pa.nulls(n, pa.int64())] * len(_PAIR), pa.nulls(n, pa.bool_())]


def _table(rows: list) -> list:
    columns = list(zip(*rows)) if rows else [[]] * len(_LINK)
    return [pa.array(c, kind) for c, (_, kind) in zip(columns, _LINK)]


def _gather(buckets: int, t: int, percent: int, k: int):
    """Windows of a task's texts: the first of each key by bucket, and of the others the pair with it and the verified links."""
    names = ["bucket", "records", *[n for n, _ in _LINK], *_PAIR, "ok"]

    def run(batches):
        held, size = [], 0

        def flush():
            ids = [i for part in held for i in part[0]]
            uids = np.concatenate([part[1] for part in held])
            values = np.concatenate([part[2] for part in held])
            hashes = np.concatenate([part[3] for part in held])
            at, word_at = (np.concatenate([[0], np.cumsum(np.concatenate([np.diff(part[x]) for part in held]))]) for x in (4, 5))
            held.clear()
            found = []
            for f in range(FUNCTIONS):
                l, c, r = windows(mix(values, 300 + f) | U(1), at, t)
                found.append(np.stack([l, c, r]))
            l, c, r = np.concatenate(found, axis=1)
            row = np.searchsorted(at, c, "right") - 1
            record = np.zeros(len(c), dtype=_RECORD)
            # The words that follow a place, or the last CONTEXT words of the text.
            n = np.diff(word_at)[row]
            record["key"] = runs(hashes, word_at[row] + np.minimum(c - at[row], np.maximum(n - CONTEXT, 0)), np.minimum(n, CONTEXT), CONTEXT)
            record["uid"], record["c"] = uids[row], c - at[row]
            record["left"], record["right"] = np.minimum(c - l, 65535), np.minimum(r - c, 65535)
            # Per text and key the widest window is enough; per key the least text is the first.
            wide = record["left"].astype(np.int64) + record["right"]
            order = np.argsort(record["key"])
            same = record["key"][order[1:]] == record["key"][order[:-1]]
            several = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))  # the other columns order few windows
            part = order[several]
            order[several] = part[np.lexsort((part, record["c"][part], -wide[part], record["uid"][part], record["key"][part]))]
            record, row = record[order], row[order]
            fresh = np.ones(len(record), dtype=bool)
            fresh[1:] = (record["key"][1:] != record["key"][:-1]) | (record["uid"][1:] != record["uid"][:-1])
            record, row = record[fresh], row[fresh]
            leads = np.ones(len(record), dtype=bool)
            leads[1:] = record["key"][1:] != record["key"][:-1]
            lead = np.maximum.accumulate(np.where(leads, np.arange(len(record)), 0))
            overlap = _overlap(record, lead, t)
            links, ok = [], np.zeros(len(record), dtype=bool)
            met = np.flatnonzero(~leads & overlap)
            met = met[np.lexsort((row[lead[met]], row[met]))]
            for own in np.split(met, np.flatnonzero(np.diff(row[met]) | np.diff(row[lead[met]])) + 1) if len(met) else []:
                x, y = row[own[0]], row[lead[own[0]]]
                more, ok[own] = _links(ids[x], values[at[x]:at[x + 1]], ids[y], values[at[y]:at[y + 1]],
                                       record["c"][own].astype(np.int64), record["c"][lead[own]].astype(np.int64), t, percent, k)
                links += more
            other = np.flatnonzero(~leads)
            judged = _pairs([record["key"][other], record["uid"][other], record["uid"][lead[other]], record["c"][other].astype(np.int64),
                             record["c"][lead[other]].astype(np.int64)], ok[other])
            for n, link, pair in ((len(links), _table(links), _no_pairs(len(links))),
                                  (len(other), [pa.nulls(len(other), kind) for _, kind in _LINK], judged)):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) % buckets), pa.nulls(n, pa.binary()), *link, *pair], names=names)
            record = record[leads]
            bucket = (mix(record["key"], 61) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            record, bucket = record[order], bucket[order]
            kinds, begin = np.unique(bucket, return_index=True)
            blobs = [record[x:y].tobytes() for x, y in zip(begin, np.append(begin[1:], len(record)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds), pa.array(blobs, pa.binary()), *[pa.nulls(len(kinds), kind) for _, kind in _LINK],
                 *_no_pairs(len(kinds))], names=names)

        for batch in batches:
            for part in slices(batch, "text"):
                hashes, word_at = words(part.column(0))
                values, at = shingles(hashes, word_at, k)
                keys = part.column(1)
                held.append((keys.field("doc_id").to_pylist(), keys.field("uid").to_numpy(zero_copy_only=False), values, hashes, at, word_at))
                size += len(values)
                if size > _FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()
        give_back()
    return run


def _overlap(record: np.ndarray, lead: np.ndarray, t: int, among: np.ndarray | None = None) -> np.ndarray:
    """Whether a window and its lead's share passages of t shingles: their intervals about the least one overlap enough."""
    among = record if among is None else among
    left = np.minimum(record["left"], among["left"][lead]).astype(np.int64)
    return left + np.minimum(record["right"], among["right"][lead]) + 1 >= t


def _meet(t: int):
    """All windows of a bucket of keys: pairs of each text and the first of its key; links and judged pairs pass through.

    ``ok`` is null for a pair that is to be verified, and false for one that has no passage in common.
    """
    names = [n for n, _ in _LINK]

    def run(group: pa.Table) -> pa.Table:
        passed = group.filter(pc.is_null(group.column("records")))
        parts = [np.frombuffer(x.as_buffer(), dtype=_RECORD) for x in group.column("records") if x.is_valid]
        record = np.concatenate(parts) if parts else np.zeros(0, _RECORD)
        record = record[np.lexsort((record["uid"], record["key"]))]
        leads = np.ones(len(record), dtype=bool)
        leads[1:] = record["key"][1:] != record["key"][:-1]
        lead = np.maximum.accumulate(np.where(leads, np.arange(len(record)), 0)) if len(record) else np.zeros(0, np.int64)
        i = np.flatnonzero(~leads & (record["uid"] != record["uid"][lead]))
        overlap = _overlap(record[i], lead[i], t, record)
        keys = record["key"].view(np.int64)
        pairs = [pa.array(x.astype(np.int64)) for x in (keys[i], record["uid"][i], record["uid"][lead[i]], record["c"][i], record["c"][lead[i]])]
        apart = pc.if_else(pa.array(overlap), pa.scalar(None, pa.bool_()), pa.scalar(False))
        return pa.table([pa.concat_arrays([*passed.column(x).cast(pa.int64()).chunks, p]) for x, p in zip(_PAIR, pairs)]
                        + [pa.concat_arrays([*passed.column(x).cast(kind).chunks, pa.nulls(len(i), kind)]) for x, kind in _LINK]
                        + [pa.concat_arrays([*passed.column("ok").cast(pa.bool_()).chunks, apart])], names=[*_PAIR, *names, "ok"])
    return run


def _verify(t: int, percent: int, k: int):
    """Links of a block's pairs, out of them and its texts, and the pairs of places with whether a link confirms them."""
    names = [*_PAIR, "ok", *[n for n, _ in _LINK]]

    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        own = []
        for batch in texts.select(["text"]).to_batches():
            for part in slices(batch, "text"):
                values, at = shingles(*words(part.column(0)), k)
                own += np.split(values, at[1:-1])
        ids, uids = texts.column("doc_id").to_pylist(), texts.column("uid").to_numpy()
        order = np.argsort(uids)
        sides = [pairs.column(x).to_numpy() for x in "ab"]
        x, y = (order[np.searchsorted(uids[order], side)].tolist() for side in sides)
        met = pairs.column("met").combine_chunks()
        met_at, places = met.offsets.to_numpy() - met.offsets[0].as_py(), met.flatten()
        key, ca, cb = (places.field(i).to_numpy() for i in range(3))
        links, ok = [], np.zeros(len(key), dtype=bool)
        for row, (low, high) in enumerate(zip(met_at[:-1].tolist(), met_at[1:].tolist())):
            i, j = x[row], y[row]
            more, ok[low:high] = _links(ids[i], own[i], ids[j], own[j], ca[low:high], cb[low:high], t, percent, k)
            links += more
        judged = _pairs([key, *(np.repeat(side, np.diff(met_at)) for side in sides), ca, cb], ok)
        give_back()
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(x, names=names) for x in (
            [*_no_pairs(len(links)), *_table(links)], [*judged, *[pa.nulls(len(ok), kind) for _, kind in _LINK]])])
    return run


_BLOCK = 8 << 20  # bytes of texts whose pairs are verified together


def _texts(rows: DataFrame, uids: DataFrame) -> DataFrame:
    """Each text of ``uids`` (uid and what else is known of it) once."""
    known = ["doc_id", "text", *uids.drop("uid").columns]
    return written(rows.join(uids, "uid").groupBy("uid").agg(*[F.first(x).alias(x) for x in known]).withColumn("bytes", F.octet_length("text")))


def _verified(pairs: DataFrame, texts: DataFrame, t: int, percent: int, k: int, link: str) -> DataFrame:
    """Links (a is null) and judged pairs of places out of (key, a, b, ca, cb).

    Pairs of one key name the same texts again and again, so they are cut into blocks of ``_BLOCK`` bytes of texts, key by key; a block
    gets each of its texts once.
    """
    pairs = pairs.groupBy("a", "b").agg(F.collect_set(F.struct("key", "ca", "cb")).alias("met"))
    for side in "ab":
        pairs = pairs.join(texts.select(F.col("uid").alias(side), F.col("bytes").alias(f"bytes_{side}")), side)
    key = F.array_min("met.key")
    bucket = F.pmod(F.xxhash64(key), F.lit(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    near = Window.partitionBy("bucket").orderBy("key", "a", "b")
    # A text that several pairs in a row have on their first side counts once.
    size = F.col("bytes_b") + 24 * F.size("met") + F.when(F.lag("a").over(near) == F.col("a"), 0).otherwise(F.col("bytes_a"))
    cut = pairs.withColumn("key", key).withColumn("bucket", bucket).withColumn("size", size)
    cut = cut.withColumn("part", F.floor((F.sum("size").over(near.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")) / _BLOCK))
    cut = written(cut.select("a", "b", "met", "bucket", "part"))
    sides = [cut.select(F.col("bucket").alias("of_bucket"), F.col("part").alias("of_part"), F.col(x).alias("uid")) for x in "ab"]
    own = texts.select("uid", "doc_id", "text").join(sides[0].union(sides[1]).distinct(), "uid")
    return written(cut.groupBy("bucket", "part").cogroup(own.groupBy("of_bucket", "of_part")).applyInArrow(_verify(t, percent, k), f"{_PAIR_TYPES}, ok boolean, {link}"))


_WINDOW = ["key", "uid", "c"]
_SHINGLE = "<i4"
_PAIRS_AT_ONCE = 1 << 12
_ROWS_AT_ONCE = 1 << 8
_BITS = 1 << 10
_HITS_AT_ONCE = 1 << 19


def _reach(t: int, percent: int) -> int:
    """How far from a place its surroundings reach."""
    return t - 1 + _DRIFT + max(_MORE, 2 * (t - _least_common(t, percent) + 1))


def _around(t: int, percent: int, k: int):
    """Of each window the shingles about its place: ``near`` in order, 31 bits of each, ``before`` of them before it.

    ``form`` is one for windows with the same shingles in the same order about their place; a task gives ``near`` once for a key's form.
    Windows of large keys also have the distinct ones, ``around``.
    """
    reach = _reach(t, percent)
    salts = [before.to_bytes(8, "little") for before in range(reach + 1)]

    def run(batches):
        told = set()
        for batch in batches:
            for part in slices(batch, "text"):
                values, at = shingles(*words(part.column("text")), k)
                out = []
                for row, (uid, places) in enumerate(zip(part.column("uid").to_pylist(), part.column("places").to_pylist())):
                    own = values[at[row]:at[row + 1]].view(np.int64)
                    short = (own & 0x7FFFFFFF).astype(_SHINGLE)
                    for place in places:
                        key, c, large = place["key"], place["c"], place["large"]
                        before = min(c, reach)
                        form = blake2b(own[c - before:c + reach + 1], digest_size=16, salt=salts[before]).digest()
                        near = short[c - before:c + reach + 1]
                        fresh = large or (key, form) not in told
                        if fresh and not large:
                            told.add((key, form))
                        out.append((key, uid, c, form, before, near.tobytes() if fresh else None, np.unique(near) if large else None))
                if len(told) > 100_000:
                    told.clear()
                columns = list(zip(*out)) if out else [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)],
                                                 names=[*_WINDOW, "form", "before", "near", "around"])
        give_back()
    return run


def _laid(blobs: list, before: list, reach: int, kind: str = "<u2") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles around places as rows with the place in column ``reach``, and each row's first column and end."""
    out = np.full((len(blobs), 2 * reach + 1), -1, dtype=np.int32)
    first = reach - np.array(before, dtype=np.int64)
    end = first.copy()
    for row, (blob, low) in enumerate(zip(blobs, first.tolist())):
        near = np.frombuffer(blob, dtype=kind)
        out[row, low:low + len(near)] = near
        end[row] += len(near)
    return out, first, end


def _may_link(one: tuple, two: tuple, t: int, percent: int) -> np.ndarray:
    """Which pairs of rows of ``_laid`` have a link about their places by ``passages``, or may have one that goes beyond the rows."""
    need, width = _least_common(t, percent), one[0].shape[1]
    centre = width // 2
    at = np.arange(width)
    low, high = np.maximum(one[1], two[1]), np.minimum(one[2], two[2])
    inside = (at >= low[:, None]) & (at < high[:, None])
    a, b = np.where(inside, one[0], -1)[:, _DRIFT:-_DRIFT], np.where(inside, two[0], -2)
    same = np.zeros(a.shape, dtype=bool)
    for s in range(2 * _DRIFT + 1):
        same |= a == b[:, s:s + a.shape[1]]
    sums = np.zeros((len(a), a.shape[1] + 1), dtype=np.int32)
    np.cumsum(same, axis=1, out=sums[:, 1:])
    count = sums[:, t:] - sums[:, :-t]
    runs_ = count.shape[1]  # of t places; run i begins in column i + _DRIFT
    begin = np.arange(runs_) + _DRIFT
    good = (count >= need) & (begin >= low[:, None]) & (begin + t <= high[:, None])
    near = good[:, centre - _DRIFT - t + 1:centre - _DRIFT + 1]
    out = near.any(axis=1)
    row = np.flatnonzero(out)
    if not len(row):
        return out
    # The runs about the first good one, as far as they are good; of these the first one with the most in common decides.
    good, count, low, high = good[row], count[row], low[row], high[row]
    some = centre - _DRIFT - t + 1 + near[row].argmax(axis=1)
    i, each = np.arange(runs_), np.arange(len(row))
    left = np.maximum.accumulate(np.where(good, -1, i), axis=1)[each, some] + 1
    right = np.minimum.accumulate(np.where(good, runs_, i)[:, ::-1], axis=1)[:, ::-1][each, some]
    best = np.where((i >= left[:, None]) & (i < right[:, None]), count, -1).argmax(axis=1)
    beyond = (left == 0) & (low < _DRIFT) | (right == runs_) & (high > runs_ - 1 + _DRIFT + t) & (count[each, best] < t)
    row, best = row[~beyond], best[~beyond]
    column = best[:, None] + _DRIFT + np.arange(t)
    sides = [np.sort(x[0][row[:, None], column], axis=1) for x in (one, two)]
    sizes = [1 + (np.diff(x, axis=1) != 0).sum(axis=1) for x in sides]
    both = np.sort(np.concatenate(sides, axis=1), axis=1)
    every = 1 + (np.diff(both, axis=1) != 0).sum(axis=1)
    out[row] = 100 * (sizes[0] + sizes[1] - every) >= percent * every
    return out


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)  # np.unique hashes first, which takes longer
    return values[np.diff(values, prepend=-1) != 0]


def _before(rows: np.ndarray) -> np.ndarray:
    """Of each place the column of the last one before it in its row with the same shingle, or -1."""
    order = np.argsort(rows, axis=1, kind="stable")
    ordered = np.take_along_axis(rows, order, 1)
    before = np.full(rows.shape, -1, dtype=np.int16)
    np.put_along_axis(before, order[:, 1:], np.where(ordered[:, 1:] == ordered[:, :-1], order[:, :-1], -1).astype(np.int16), 1)
    return before


def _plain(rows: np.ndarray, t: int) -> np.ndarray:
    """Which rows have no run of t places with a shingle twice."""
    out = [np.zeros(0, dtype=bool)]
    for low in range(0, len(rows), _ROWS_AT_ONCE):
        before = _before(rows[low:low + _ROWS_AT_ONCE])
        near = (before >= 0) & (np.arange(rows.shape[1]) - before < t)
        out.append(~(near & (rows[low:low + _ROWS_AT_ONCE] >= 0)).any(axis=1))
    return np.concatenate(out)


def _rare(rows: np.ndarray, times: np.ndarray, first: np.ndarray, end: np.ndarray, t: int, percent: int, others: np.ndarray) -> list:
    """Rows and shingles: of each run of t places as many of the rarest distinct shingles as must hold one that a similar run has, too;
    first for those of ``_plain`` rows, then for others, for rows with ``others`` alone.

    ``times``: how many rows have a place's shingle; those that no other has are left out. Of m distinct shingles and n of the other run
    at least percent * (m + n) / (100 + percent) are common; n is t, or at least percent / 100 * m.
    """
    found, begin = [[np.zeros(0, dtype=np.int64)] for _ in range(2)], np.arange(_DRIFT, rows.shape[1] - _DRIFT - t + 1)
    for low in range(0, len(rows), _ROWS_AT_ONCE):
        part = slice(low, low + _ROWS_AT_ONCE)
        own, often, inside = rows[part], times[part], (begin >= first[part, None]) & (begin + t <= end[part, None])

        def sliding(x):
            return np.lib.stride_tricks.sliding_window_view(x[:, _DRIFT:-_DRIFT], t, axis=1)

        fresh = sliding(_before(own)) < begin[:, None].astype(np.int16)  # not in the run before
        distinct, alone = np.count_nonzero(fresh, axis=2), np.count_nonzero(fresh & sliding(often == 1), axis=2)
        for out, size, asks in zip(found, (t, -(-percent * distinct // 100)), (np.ones(len(own), dtype=bool), others[part])):
            spare = distinct + -percent * (distinct + size) // (100 + percent)
            row, i = np.nonzero((alone <= spare) & inside & asks[:, None])
            if not len(row):
                continue
            value = np.where(fresh[row, i], sliding((often.astype(np.int64) << 32) | own)[row, i], np.iinfo(np.int64).max)
            most = int(spare[row, i].max()) + 1
            value = np.sort(np.partition(value, most - 1, axis=1)[:, :most], axis=1)
            asked = (np.arange(most) <= spare[row, i][:, None]) & (value >> 32 > 1)
            out.append(_distinct((np.broadcast_to(low + row[:, None], value.shape)[asked] << 32) | (value[asked] & 0xFFFFFFFF)))
    return [(code >> 32, code & 0xFFFFFFFF) for code in map(np.concatenate, found)]


def _ends(width: int, t: int, percent: int) -> list[np.ndarray]:
    """Columns at either end of a row of ``_laid`` of that width: a link that goes beyond the row matches nearly all of one of them."""
    some = t - _least_common(t, percent) + 1
    end = width - _DRIFT
    return [np.arange(_DRIFT, width)[:min(2 * some, t)], np.arange(end - min(2 * some, t), end)]


def _asked(laid: tuple, group: np.ndarray, apart: np.ndarray, asks: np.ndarray, answers: np.ndarray, t: int, percent: int):
    """Pairs of rows of one group with different ``apart`` that may have a link, a later row with ``asks`` and an earlier one with
    ``answers``; in parts, between which what is apart may become less.

    A link whose run lies within the rows has enough distinct shingles in common, so that the rarest of either side hold one
    (``_rare``); the one of the smaller part asks. One whose run goes beyond them has good runs up to their end, and of the last
    places there the later row has no more unmatched than t less the least common ones; so it asks with one more, the rarest.
    """
    rows, first, end = laid
    n, need, centre, seen = len(rows), _least_common(t, percent), rows.shape[1] // 2, set()
    some = t - need + 1
    part = np.unique(apart, return_inverse=True)[1]
    order = _ranks(np.bincount(part)[part], part)  # of parts, by size
    parts = int(order.max(initial=0)) + 1
    last, least = np.zeros((2, int(group.max(initial=0)) + 1), dtype=np.int64)
    least += parts
    np.maximum.at(last, group, order)
    np.minimum.at(least, group, order)
    several = (least < last)[group]
    row, column = np.nonzero((rows >= 0) & several[:, None])
    ids = np.full(rows.shape, -1, dtype=np.int64)
    ids[row, column] = np.unique((group[row].astype(np.int64) << 32) | rows[row, column], return_inverse=True)[1]

    def index(own, which):
        """Tokens with their part's order, sorted, and the rows they are of."""
        return np.divmod(_distinct((own * parts + order[which]) * n + which), max(n, 1))

    def met(who, start, stop, owner):
        many = stop > start
        who, start, size = who[many], start[many], (stop - start)[many]
        total, low = np.concatenate([[0], np.cumsum(size)]), 0
        while low < len(who):
            high = max(low + 1, int(np.searchsorted(total, total[low] + _HITS_AT_ONCE, "right")) - 1)
            sizes = size[low:high]
            place = np.arange(total[high] - total[low]) - np.repeat(total[low:high] - total[low], sizes) + np.repeat(start[low:high], sizes)
            x, y = np.repeat(who[low:high], sizes), owner[place]
            good = apart[x] != apart[y]
            yield x[good], y[good]
            low = high

    def pairs():
        own = ids[row, column]
        times = np.bincount(_distinct(own * n + row) // max(n, 1), minlength=1)
        todo = np.flatnonzero(order < last[group])
        plain = _plain(ids, t)
        odd = np.zeros(len(last), dtype=bool)
        odd[group[~plain]] = True
        for (who, wanted), mine in zip(_rare(ids[todo], times[ids[todo]], first[todo], end[todo], t, percent, odd[group[todo]]), (plain, ~plain)):
            who, some_ask = todo[who], np.zeros(len(times), dtype=bool)
            some_ask[wanted] = True
            hit = some_ask[own] & mine[row]
            token, owner = index(own[hit], row[hit])
            low, high = wanted * parts + order[who] + 1, (wanted + 1) * parts
            for x, y in met(who, np.searchsorted(token, low), np.searchsorted(token, high), owner):
                yield np.maximum(x, y), np.minimum(x, y), slice(centre - t + 1, centre + t), np.any
        for side, beyond in zip(_ends(rows.shape[1], t, percent), (slice(_DRIFT, centre + 1), slice(centre, rows.shape[1] - _DRIFT))):
            near = slice(side[0] - _DRIFT, side[-1] + _DRIFT + 1)
            hit, place = np.nonzero(ids[:, near] >= 0)
            token, owner = index(ids[:, near][hit, place], hit)
            whole = np.flatnonzero(asks & several & (first <= side[0]) & (end > side[-1]))
            own = ids[np.ix_(whole, side)]
            count = np.searchsorted(token, (own + 1) * parts) - np.searchsorted(token, own * parts)
            rarest = np.take_along_axis(own, np.argpartition(count, some - 1, axis=1)[:, :some], 1)
            who, own = (x.astype(np.int64) for x in np.divmod(_distinct(((whole[:, None] << 32) | rarest).ravel()), 1 << 32))
            for low, high in ((own * parts, own * parts + order[who]), (own * parts + order[who] + 1, (own + 1) * parts)):
                for x, y in met(who, np.searchsorted(token, low), np.searchsorted(token, high), owner):
                    yield x, y, beyond, np.all

    # Whether a row has a shingle, some others taken for it: few pairs are left to compare.
    has = np.zeros((n, _BITS), dtype=bool)
    has[row, ids[row, column] % _BITS] = True
    for x, y, near, which in pairs():
        good = (x > y) & asks[x] & answers[y]
        code = _distinct(x[good] * n + y[good])
        for i in range(0, len(code), _PAIRS_AT_ONCE):
            x, y = np.divmod(code[i:i + _PAIRS_AT_ONCE], n)
            own = ids[:, near][x]
            sums = np.cumsum(has[y[:, None], own % _BITS] & (own >= 0), axis=1, dtype=np.int16)
            sums[:, t:] -= sums[:, :-t].copy()
            still = (apart[x] != apart[y]) & which(sums[:, t - 1:] >= need, axis=1)
            x, y = x[still], y[still]
            fits = _may_link(*(tuple(z[w] for z in laid) for w in (x, y)), t, percent)
            fresh = [pair for pair in zip(x[fits].tolist(), y[fits].tolist()) if pair not in seen]
            seen.update(fresh)
            yield np.array(fresh, dtype=np.int64).reshape(-1, 2).T


def _repeated(laid: tuple, group: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each row and the first one of its group with the same run of t places at the same distance from the place, for some runs."""
    rows, first, end = laid
    centre, pairs = rows.shape[1] // 2, [np.zeros(0, dtype=np.int64)]
    sums = np.zeros((len(rows), rows.shape[1] + 1), dtype=np.uint64)
    np.cumsum(mix(rows.astype(np.uint64), 71) * mix(np.arange(rows.shape[1], dtype=np.uint64), 72), axis=1, out=sums[:, 1:])
    for low in range(centre - t + 1, centre + 1, max(1, t // 9)):
        row = np.flatnonzero((first <= low) & (end >= low + t))
        code = mix(sums[row, low + t] - sums[row, low], 73) ^ mix(group[row].astype(np.uint64), 74)
        order = np.argsort(code, kind="stable")
        begins = np.flatnonzero(np.diff(code[order], prepend=code[order[:1]] ^ U(1)) != 0)
        lead = np.repeat(row[order[begins]], np.diff(np.append(begins, len(order))))
        pairs.append(row[order] * len(rows) + lead)
    x, y = np.divmod(_distinct(np.concatenate(pairs)), max(len(rows), 1))
    return x[x != y], y[x != y]


def _ranks(*columns: np.ndarray) -> np.ndarray:
    """Each row's place, from 0, among the distinct rows of the columns in order."""
    order = np.lexsort(columns[::-1])
    out = np.zeros(len(order), dtype=np.int64)
    out[order[1:]] = np.cumsum(np.any([np.diff(x[order]) != 0 for x in columns], axis=0))
    return out


def _within(t: int, percent: int, every: bool):
    """Pairs to verify among the windows of a bucket of keys, out of them and the judged pairs: with ``every`` all that may have a
    link and that judged ones do not connect, else as many as connect these if they do have it."""
    reach = _reach(t, percent)

    def run(windows_: pa.Table, judged: pa.Table) -> pa.Table:
        n, window = windows_.num_rows, [windows_.column(x).to_numpy() for x in _WINDOW]
        key, a, b, ca, cb, ok = (judged.column(x).to_numpy() for x in (*_PAIR, "ok"))
        rank = _ranks(*(np.concatenate(x) for x in zip(window, (key, a, ca), (key, b, cb))))
        node = np.zeros(int(rank.max(initial=-1)) + 1, dtype=np.int64)
        node[rank[:n]] = np.arange(n)
        met, rank = node[rank[n:]].reshape(2, -1), rank[:n].tolist()
        parent = list(range(n))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def join(i, j):
            i, j = root(i), root(j)
            parent[max(i, j)] = min(i, j)
            return i != j

        known = set(zip(met.max(axis=0).tolist(), met.min(axis=0).tolist()))
        for i, j in zip(*met[:, ok.astype(bool)].tolist()):
            join(i, j)
        # Windows of one form surely have links: they go on as the form's first, but for those that were judged to have none.
        forms = np.frombuffer(b"".join(windows_.column("form").to_pylist()), dtype="<i8").reshape(-1, 2)
        form = _ranks(window[0], forms[:, 0], forms[:, 1])
        first, near = np.zeros((2, int(form.max(initial=-1)) + 1), dtype=np.int64)
        last = np.argsort(rank)[::-1]
        first[form[last]] = last  # of each form the last one written stays, its first
        given = np.flatnonzero(windows_.column("near").is_valid().to_numpy())
        near[form[given]] = given
        ones, asked = [], []
        for i, one in enumerate(first[form].tolist()):
            if i == one:
                ones.append(i)
            elif root(i) != root(one):
                if (max(i, one), min(i, one)) in known:
                    ones.append(i)
                else:
                    asked.append((i, one))
        for i, one in asked:
            join(i, one)
        parts = [root(i) for i in ones]
        keys = window[0][ones].tolist() if ones else []
        counts = {}
        for key, part in zip(keys, parts):
            own = counts.setdefault(key, {})
            own[part] = own.get(part, 0) + 1
        most = {key for key, own in counts.items() if len(own) > 1}
        left = sorted((x for x, key in enumerate(keys) if key in most), key=lambda x: rank[ones[x]])
        ones, parts, keys = ([x[y] for y in left] for x in (ones, parts, keys))
        if ones:
            number = {key: i for i, key in enumerate(most)}
            laid = _laid(windows_.column("near").take(near[form[ones]]).to_pylist(), windows_.column("before").to_numpy()[ones], reach, _SHINGLE)
            group, apart = np.array([number[key] for key in keys]), np.array(parts)

            def ask(pairs):
                for x, y in pairs:
                    for i, j in zip(x.tolist(), y.tolist()):
                        i, j = ones[i], ones[j]
                        if (max(i, j), min(i, j)) not in known and (every or join(i, j)):
                            known.add((max(i, j), min(i, j)))
                            asked.append((i, j))
                    if not every and len(x):
                        apart[:] = [root(i) for i in ones]

            if not every:  # first what surely connects many
                x, y = _repeated(laid, group, t)
                for low in range(0, len(x), _PAIRS_AT_ONCE):
                    i, j = x[low:low + _PAIRS_AT_ONCE], y[low:low + _PAIRS_AT_ONCE]
                    i, j = (z[apart[i] != apart[j]] for z in (i, j))
                    fits = _may_link(*(tuple(part[z] for part in laid) for z in (i, j)), t, percent)
                    ask([(i[fits], j[fits])])
            everyone = np.ones(len(ones), dtype=bool)
            ask(_asked(laid, group, apart, everyone, everyone, t, percent))
        pairs = np.array([(i, j) if rank[i] > rank[j] else (j, i) for i, j in asked], dtype=np.int64).reshape(-1, 2)
        (_, a, ca), (key, b, cb) = ([x[pairs[:, side]] for x in window] for side in (0, 1))
        other = a != b
        give_back()
        return pa.table([pa.array(x[other], pa.int64()) for x in (key, a, b, ca, cb)], names=_PAIR)
    return run


def _near_enough(t: int, percent: int):
    """Of pairs those that may have a link, by what is around their places."""
    reach = _reach(t, percent)

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, _PAIRS_AT_ONCE):
                part = batch.slice(low, _PAIRS_AT_ONCE)
                sides = [_laid(part.column(f"_near{x}").to_pylist(), part.column(f"_before{x}").to_pylist(), reach, _SHINGLE) for x in "ab"]
                fits = pa.array(_may_link(*sides, t, percent))
                yield pa.RecordBatch.from_arrays([part.column(x).filter(fits) for x in _PAIR], names=_PAIR)
        give_back()
    return run


def _wanted(t: int, percent: int):
    """Of windows the shingles that they ask with and answer to, by kind: those of ``_rare``, and those at either end, as in ``_asked``.

    ``often`` are the shingles near a place that other windows of the key have, too, with their number.
    """
    reach = _reach(t, percent)

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, _ROWS_AT_ONCE):
                part = batch.slice(low, _ROWS_AT_ONCE)
                rows, first, end = _laid(part.column("near").to_pylist(), part.column("before").to_pylist(), reach, _SHINGLE)
                often = part.column("often")
                at, pairs = often.offsets.to_numpy() - often.offsets[0].as_py(), often.flatten()
                code = (np.repeat(np.arange(part.num_rows), np.diff(at)) << 32) | pairs.field("shingle").to_numpy()
                order = np.argsort(code)
                code, number = code[order], pairs.field("n").to_numpy()[order]
                own = (np.arange(part.num_rows)[:, None] << 32) | rows
                place = np.minimum(np.searchsorted(code, own), max(len(code) - 1, 0))
                times = np.where(code[place] == own, number[place], 1) if len(code) else np.ones(rows.shape, dtype=np.int64)
                asks, answers = ([[[] for _ in range(4)] for _ in range(part.num_rows)] for _ in range(2))
                for kind, found in enumerate(_rare(rows.astype(np.int64), times, first, end, t, percent, np.ones(part.num_rows, dtype=bool))):
                    for row, shingle in zip(*(x.tolist() for x in found)):
                        asks[row][kind].append(shingle)
                for row, plain in enumerate(_plain(rows, t).tolist()):
                    answers[row][0 if plain else 1] = np.unique(rows[row][(times[row] > 1) & (rows[row] >= 0)]).tolist()
                some = t - _least_common(t, percent) + 1
                for kind, side in enumerate(_ends(rows.shape[1], t, percent)):
                    for row in range(part.num_rows):
                        near = slice(side[0] - _DRIFT, side[-1] + _DRIFT + 1)
                        answers[row][kind + 2] = np.unique(rows[row, near][(times[row, near] > 1) & (rows[row, near] >= 0)]).tolist()
                        if first[row] <= side[0] and end[row] > side[-1]:
                            rarest = side[np.argsort(times[row, side], kind="stable")[:some]]
                            asks[row][kind + 2] = np.unique(rows[row, rarest][times[row, rarest] > 1]).tolist()
                lists = pa.list_(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in _WINDOW), pa.array(asks, lists), pa.array(answers, lists)],
                                                 names=[*_WINDOW, "asks", "answers"])
        give_back()
    return run


def _node(uid: str, c: str):
    return F.encode(F.concat_ws("/", uid, c), "UTF-8")


def _second_links(judged: DataFrame, rows: DataFrame, t: int, percent: int, k: int, link: str, large: int) -> DataFrame:
    """Links between the windows of keys whose first did not confirm them all, out of judged pairs of windows.

    Every pair of one key that may have a link is verified or connected by links already. Keys of up to ``large`` windows are met
    by bucket: the pairs that would connect them, where one of these has no link others that would, and if that fails all that are
    left. Windows of larger keys are dealt by their shingles.
    """
    a, b = judged.select("key", F.col("a").alias("uid"), F.col("ca").alias("c")), judged.select("key", F.col("b").alias("uid"), F.col("cb").alias("c"))
    # Of two windows the only pair has been judged.
    open_ = judged.where("not ok").select("key").distinct()
    open_ = written(a.union(b).join(open_, "key", "left_semi").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 2").select(
        "key", (F.col("n") > large).alias("large"), "n"))
    judged = written(judged.join(open_, "key").select(*_PAIR, "ok", "large"))
    sides = [judged.select("key", F.col(x).alias("uid"), F.col(f"c{x}").alias("c"), "large") for x in "ab"]
    windows_ = sides[0].union(sides[1]).distinct()
    places = written(windows_.groupBy("uid").agg(F.collect_list(F.struct("key", "c", "large")).alias("places")))
    texts = _texts(rows, places)
    around = written(texts.select("text", "uid", "places").mapInArrow(_around(t, percent, k), "key bigint, uid bigint, c bigint, form binary, before bigint, near binary, around array<bigint>"))
    small, any_large = open_.agg(F.sum(F.when(~F.col("large"), F.col("n"))), F.max("large")).first()
    buckets = max(-(-(small or 0) // 10_000), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    met = around.where("around is null").select(*_WINDOW, "form", "before", "near", bucket)

    def within(known: DataFrame, among: DataFrame, every: bool) -> DataFrame:
        return among.groupBy("bucket").cogroup(known.select(*_PAIR, "ok", bucket).groupBy("bucket")).applyInArrow(
            _within(t, percent, every), _PAIR_TYPES)

    known, links = judged.where("not large").select(*_PAIR, "ok"), None
    for every in (False, False, True):
        done = _verified(within(known, met, every), texts, t, percent, k, link)
        links = done.where("a is null") if links is None else links.union(done.where("a is null"))
        if every:
            break
        fresh = done.where("a is not null").select(*_PAIR, "ok")
        failed = written(fresh.where("not ok").select("key").distinct())
        if failed.isEmpty():
            break
        known, met = (x.join(failed, "key", "left_semi") for x in (known.union(fresh), met))
    if not any_large:
        return links
    return links.union(_large_links(judged.where("large").drop("large"), around.where("around is not null"), texts, t, percent, k, link))


def _large_links(judged: DataFrame, around: DataFrame, texts: DataFrame, t: int, percent: int, k: int, link: str) -> DataFrame:
    """Links between windows of keys of any size: by prefix filtering on the shingles around their places."""
    # Windows of one form surely have links: those that no common first connects are linked to the form's first, which alone goes on.
    first = around.groupBy("key", "form").agg(F.min(F.struct("uid", "c")).alias("first"))
    formed = around.select(*_WINDOW, "form").join(first, ["key", "form"]).select(*_WINDOW, "first")
    told = judged.where("ok").select("key", F.col("a").alias("uid"), F.col("ca").alias("c"), F.struct("b", "cb").alias("to"))
    alike = formed.where("uid != first.uid").join(told, _WINDOW, "left").withColumnRenamed("to", "_to")
    firsts = told.select("key", F.struct("uid", "c").alias("first"), F.col("to").alias("_first_to"))
    alike = alike.join(firsts, ["key", "first"], "left").where("not coalesce(_to = _first_to, false)").select(
        "key", F.col("uid").alias("a"), F.col("first.uid").alias("b"), F.col("c").alias("ca"), F.col("first.c").alias("cb"))
    around = written(around.join(first.select("key", "first.uid", "first.c"), _WINDOW, "left_semi").drop("form"))

    each = around.select(*_WINDOW, F.explode("around").alias("shingle"))
    common = each.groupBy("key", "shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(each.join(common, ["key", "shingle"]))
    often = shared.groupBy(*_WINDOW).agg(F.collect_list(F.struct("shingle", "n")).alias("often"))
    wanted = written(around.select(*_WINDOW, "before", "near").join(often, _WINDOW).select(*_WINDOW, "before", "near", "often").mapInArrow(
        _wanted(t, percent), "key bigint, uid bigint, c bigint, asks array<array<bigint>>, answers array<array<bigint>>"))

    def tokens(column: str) -> DataFrame:
        each = wanted.select(*_WINDOW, F.posexplode(column).alias("kind", "shingle")).select(*_WINDOW, "kind", F.explode("shingle").alias("shingle"))
        return each.select(F.xxhash64("key", "kind", "shingle").alias("token"), *_WINDOW, "kind")

    asks, answers = tokens("asks"), tokens("answers")
    answers = answers.join(asks.select("token").distinct(), "token", "left_semi")

    def possible(pairs: DataFrame) -> DataFrame:
        """Of pairs not judged yet those that may have a link."""
        one = around.select("key", F.col("uid").alias("a"), F.col("c").alias("ca"), F.col("near").alias("_neara"), F.col("before").alias("_beforea"))
        two = around.select("key", F.col("uid").alias("b"), F.col("c").alias("cb"), F.col("near").alias("_nearb"), F.col("before").alias("_beforeb"))
        fresh = pairs.distinct().join(judged.select(*_PAIR), _PAIR, "left_anti")
        near = fresh.join(one, ["key", "a", "ca"]).join(two, ["key", "b", "cb"])
        return near.select(*_PAIR, "_neara", "_nearb", "_beforea", "_beforeb").mapInArrow(_near_enough(t, percent), _PAIR_TYPES)

    def paired(pairs: DataFrame) -> DataFrame:
        return pairs.selectExpr("x.key", "greatest(x.uid, y.uid) a", "least(x.uid, y.uid) b", "if(x.uid > y.uid, x.c, y.c) ca", "if(x.uid > y.uid, y.c, x.c) cb")

    lead = answers.groupBy("token").agg(F.min(F.struct("uid", "c")).alias("lead")).select("token", "lead.*").alias("y")
    # The later one of two windows asks with what is at the ends.
    star = paired(asks.alias("x").join(lead, "token").where("x.uid > y.uid or x.kind < 2 and x.uid != y.uid"))
    alike = alike.distinct().join(judged.select(*_PAIR), _PAIR, "left_anti")
    once = _verified(possible(star).union(alike).distinct(), texts, t, percent, k, link)

    linked = judged.where("ok").select(*_PAIR).union(once.where("ok").select(*_PAIR))
    named = components(linked.select(_node("a", "ca").alias("a"), _node("b", "cb").alias("b"))).withColumnRenamed("node", "_node")
    sides = [each.withColumn("_node", _node("uid", "c")).join(named, "_node", "left").select(
        "token", *_WINDOW, "kind", F.coalesce("component", "_node").alias("component")) for each in (asks, answers)]
    sizes = sides[1].select(*_WINDOW, "component").distinct().groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    asks, answers = (each.join(sizes, ["key", "component"]).withColumn("order", F.struct("n", "component")).drop("n", "component") for each in sides)
    # What is not in the largest component of its shingle meets all that is in another one. Among all runs' shingles the smaller component asks.
    largest = answers.groupBy("token", "order").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(
        F.max(F.struct("n", "order"))["order"].alias("_most"), F.max("order").alias("_last"), F.count(F.lit(1)).alias("_kinds")).where("_kinds > 1").drop("_kinds")
    asks, answers = (each.join(largest, "token").withColumn("_out", F.col("order") != F.col("_most")) for each in (asks, answers))
    asks, answers = written(asks.where("kind > 1 or order < _last").drop("_most", "_last")), written(answers.drop("_most", "_last"))
    rest = None
    for asking, asked in (("_out", "true"), ("not _out", "_out")):
        x, y = asks.where(asking).alias("x"), answers.where(asked).alias("y")
        pairs = x.join(y, F.expr("x.token = y.token and x.uid != y.uid and if(x.kind < 2, x.order < y.order, x.order != y.order and x.uid > y.uid)"))
        rest = paired(pairs) if rest is None else rest.union(paired(pairs))
    rest = possible(rest).join(once.where("a is not null").select(*_PAIR), _PAIR, "left_anti")
    again = _verified(rest, texts, t, percent, k, link)
    return once.where("a is null").union(again.where("a is null"))


def repeated_passages(docs: DataFrame, least_words: int = 50, words_per_shingle: int = 5, percent: int = 80,
                      large: int = LARGE) -> DataFrame:
    """Passages that two documents share: doc_id, start, size, source_id, source_start, source_size (in words), similarity.

    A row links a passage to the same or nearly the same one in the first document (by a hash of doc_id and text) that
    was met with it, so that m documents with one passage are connected by m - 1 rows or some more; which of them a row
    names depends on how the table is cut into tasks, the documents that are connected do not. Passages have
    ``least_words`` words or more, and among them that many with ``percent`` of their distinct shingles in common.
    Within one document repeats are not reported; rows that repeat doc_id and text are one document. Null, empty and
    short texts have no passages; a null doc_id is given as null. An empty table gives no rows. Keys of more than ``large`` windows
    are met in another way, with the same links found.

    Near copies of a passage meet under one of ``FUNCTIONS`` functions or not at all: at a similarity of 0.8 a pair is
    missed with a chance of about one in a thousand; word for word repeats of more than ``least_words`` with about one in
    a hundred thousand.
    """
    send_code(docs.sparkSession)
    spark = docs.sparkSession
    t, k = least_words - words_per_shingle + 1, words_per_shingle
    rows = needs(docs, "doc_id", "text").where("text is not null").select("text", "doc_id", row_key("doc_id", "text").alias("uid"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(-(-total // (16 << 20)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    link = "doc_id bigint, start bigint, size bigint, source_id bigint, source_start bigint, source_size bigint, similarity double"
    gathered = rows.select("text", F.struct("doc_id", "uid").alias("key")).mapInArrow(
        _gather(buckets, t, percent, k), f"bucket bigint, records binary, {link}, {_PAIR_TYPES}, ok boolean")
    met = written(gathered.groupBy("bucket").applyInArrow(_meet(t), f"{_PAIR_TYPES}, {link}, ok boolean"))
    pairs = met.where("a is not null and ok is null").select(*_PAIR)
    involved = pairs.select(F.col("a").alias("uid")).union(pairs.select(F.col("b").alias("uid"))).distinct()
    once = _verified(pairs, _texts(rows, involved), t, percent, k, link)
    judged = [part.where("a is not null and ok is not null").select(*_PAIR, "ok") for part in (met, once)]
    again = _second_links(written(judged[0].union(judged[1])), rows, t, percent, k, link, large)
    names = [n for n, _ in _LINK]
    found = met.where("a is null").select(*names)
    return found.union(once.where("a is null").select(*names)).union(again.select(*names)).distinct()
