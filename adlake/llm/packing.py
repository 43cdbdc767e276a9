"""Best-fit packing of tokenized documents into sequences by linear grouping.

Planning needs the number of pieces of each length and nothing else, so it works on at most ``capacity`` counts,
however many documents there are. Large lengths fall into groups of equal cardinality and are rounded up to the largest
of their group; configurations of the few rounded sizes are chosen to fill a sequence best; then the actual pieces,
longest first, take the places of their group, and small pieces go into what is really left by best fit. The plan is a
list of runs, "the pieces of this length with these ranks take these places in these sequences", by which the workers
place the pieces; ranks within a length come from counts per slot of documents, not from one task per length.
"""

import gc
import os
import re
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from adlake.llm.tables import give_back, needs, row_key, send_code, written
from adlake.llm.words import slices

SLOTS = 256
GROUPINGS = (24, 64, 160)
_CACHE = 400_000  # words in a generation, about 70 MB
# Letters whose lower case and composed form stand alone, with signs behind them but no apostrophe, which may begin a token
# with letters, and no mark of a special token.
_IN_PARTS = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=-@\\[-`{-~]*)").fullmatch


class _Encoder:
    """Token ids of texts, word by word: no token of this kind of tokenizer spans white space.

    Nor does one span letters and signs, and letters are lower-cased, so that a new word of plain letters and signs behind
    them is put together from its parts. Words are remembered in two generations, so that frequent ones stay when the memory
    is full.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has given the cores to tasks already
        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        self.mark = next(t for t in self.tokenizer.get_added_tokens_decoder().values() if t.special).content
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if suffix:
            self.ends[[i for word, i in vocabulary.items() if word.endswith(suffix)]] = True

    def _learn(self, words: list) -> None:
        """Ids of new words; those of letters and signs are put together from the ids of both, whose letters are lower-cased."""
        made, rest, letters = [], [], set()
        for word in words:
            parts = _IN_PARTS(word)
            if parts is None:
                rest.append(word)
            else:
                low = parts[1].lower()
                made.append((word, low, parts[2]))
                letters.add(low)
        ids = self._spelled([w for w in letters if w not in self.known])
        for signs in {signs for _, _, signs in made}:
            ids[signs] = self._encoded(signs) if signs else b""
        for word, low, signs in made:
            self.known[word] = (ids[low] if low in ids else self.known[low]) + ids[signs]
        for low in range(0, len(rest), 1000):
            part = [w for w in rest[low:low + 1000] if "<" not in w]
            got = self.tokenizer.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0]
            ids = np.array(got.ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            raw, begin = ids.tobytes(), [0, *(4 * (cuts + 1)).tolist()]
            for word, first, last in zip(part, begin, [*(4 * cuts).tolist(), len(raw)]):
                self.known[word] = raw[first:last]
        for word in rest:
            if "<" in word:  # might hold a special token's text
                self.known[word] = self._encoded(word)

    def _encoded(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _spelled(self, words: list) -> dict:
        """Ids of words of letters alone: many in one text, each up to the token that ends a word."""
        out = {}
        for low in range(0, len(words), 1000):
            part = words[low:low + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(part):  # a tokenizer without such tokens
                out.update((word, self._encoded(word)) for word in part)
                continue
            raw = ids.tobytes()
            for word, first, last in zip(part, [0, *cuts], cuts):
                out[word] = raw[first:last]
        return out

    def __call__(self, texts: list) -> list:
        split = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        words = set().union(*split)
        if len(self.known) + len(words) > _CACHE:
            self.known, self.older = {}, self.known
        new = words.difference(self.known)
        for word in new.intersection(self.older):
            self.known[word] = self.older[word]
        self._learn(list(new.difference(self.older)))
        known = self.known
        return [b"".join([known[w] for w in chunks]) for chunks in split]


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    """One per worker process, with its memory, over the tasks that it runs."""
    return _Encoder(path)


def _cut(path: str, capacity: int, end_id: int, with_ids: bool, remember: bool = True):
    def run(batches):
        from zlib import crc32

        encode, end = _encoder(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                keys, rows, pieces = part.column(1), [], []
                for row, ids in enumerate(encode([t or "" for t in part.column(0).to_pylist()])):
                    ids += end
                    for n, start in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[start:start + 4 * capacity]
                        rows.append(row)
                        pieces.append((n, start // 4, len(piece) // 4, crc32(piece), piece if with_ids else None))
                columns = list(zip(*pieces))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows)), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())],
                    names=["_key", "piece", "start", "length", "ids_crc32", "ids"])
        encode.older = {}  # a worker that waits, or runs other stages, keeps one generation
        if not remember:
            del encode
            _encoder.cache_clear()
            gc.collect()
        give_back()
    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, remember: bool = True) -> DataFrame:
    """doc_id, row_key, piece, start, length, ids_crc32, ids (little-endian 32-bit, null unless wanted).

    A document is its token ids and ``end_id``; a null text is empty and has that id alone. Only documents longer than
    ``capacity`` are cut, into pieces of ``capacity`` and a last one. Each row is cut, repeated ones too.
    A worker keeps the tokenizer and its words for its next task, unless ``remember`` is off: then other stages have this memory.
    """
    send_code(docs.sparkSession)
    rows = needs(docs, "doc_id", "text").select("text", F.struct("doc_id", row_key("doc_id", "text").alias("row_key")).alias("_key"))
    out = rows.mapInArrow(_cut(tokenizer, capacity, end_id, with_ids, remember),
                          "_key struct<doc_id:bigint,row_key:bigint>, piece bigint, start bigint, length bigint, "
                          "ids_crc32 bigint, ids binary")
    return out.select("_key.doc_id", "_key.row_key", "piece", "start", "length", "ids_crc32", "ids")


# --- the plan ---------------------------------------------------------------

def _configuration(sizes: list, left: list, capacity: int) -> list:
    """How many of each size to put together: the largest, and what fills its sequence best, by reachable sums.

    Sizes come in falling order; the largest is always in, so that no size is left over that fits with little else.
    """
    room, have = capacity - sizes[0], [left[0] - 1, *left[1:]]
    reach = np.full(room + 1, -1, dtype=np.int32)  # the size that completed a sum
    reach[0] = len(sizes)
    for i, (size, count) in enumerate(zip(sizes, have)):
        known = reach >= 0
        frontier = known.copy()
        for _ in range(min(count, room // size)):
            step = np.zeros_like(known)
            step[size:] = frontier[:-size]
            step &= ~known
            if not step.any():
                break
            reach[step] = i
            known |= step
            frontier = step
    total = int(np.flatnonzero(reach >= 0)[-1])
    used = [1] + [0] * (len(sizes) - 1)
    while total:
        used[reach[total]] += 1
        total -= sizes[reach[total]]
    return used


def plan(counts: dict, capacity: int, groupings: tuple = GROUPINGS) -> list:
    """The plan with the fewest sequences among some numbers of groups."""
    return min((_plan(counts, capacity, n) for n in groupings), key=lambda found: found[0])[1]


def _plan(counts: dict, capacity: int, groups: int, small: int = 8) -> tuple:
    """The number of sequences, and runs (length, first rank, number, first sequence, offset, pieces a sequence).

    A run places ranks r = first rank + q with q < number: into sequence first + q // m at offset + (q % m) * length,
    where m is the pieces a sequence. ``counts`` maps lengths from 1 to ``capacity`` to how many pieces have them.
    """
    runs, next_bin = [], 0
    taken = dict.fromkeys(counts, 0)

    def place(length, number, first_bin, offset, each):
        runs.append((length, taken[length], number, first_bin, offset, each))
        taken[length] += number

    if counts.get(capacity):
        place(capacity, counts[capacity], 0, 0, 1)
        next_bin = counts[capacity]
    large = sorted((n for n in counts if capacity // small < n < capacity), reverse=True)
    # Groups of equal cardinality, longest first; a length may be shared by neighbouring groups.
    total = sum(counts[n] for n in large)
    share = max(1, -(-total // groups))
    rounded, left, stock = [], [], []
    for length in large:
        rest = counts[length]
        while rest:
            if not rounded or left[-1] == share:
                rounded.append(length)
                left.append(0)
                stock.append([])
            some = min(rest, share - left[-1])
            stock[-1].append([length, some])
            left[-1] += some
            rest -= some
    free = {}  # room -> runs of sequences (first, number) with that room

    def give_back(room, first, number):
        if number and room:
            free.setdefault(room, []).append((first, number))

    while any(left):
        live = [i for i, n in enumerate(left) if n]
        used = dict(zip(live, _configuration([rounded[i] for i in live], [left[i] for i in live], capacity)))
        used = {i: n for i, n in used.items() if n}
        times = min(left[i] // n for i, n in used.items())
        # Substitute actual pieces: stretches over which every place has one actual length.
        parts, done = [], 0
        for i, n in used.items():
            left[i] -= n * times
            for _ in range(n):
                parts.append([])
                need = times
                while need:
                    length, have = stock[i][0]
                    some = min(have, need)
                    parts[-1].append((length, some))
                    need -= some
                    if some == have:
                        stock[i].pop(0)
                    else:
                        stock[i][0][1] -= some
        at = [[0, 0] for _ in parts]
        while done < times:
            stretch = min(p[a[0]][1] - a[1] for p, a in zip(parts, at))
            offset = 0
            for p, a in zip(parts, at):
                length = p[a[0]][0]
                place(length, stretch, next_bin + done, offset, 1)
                offset += length
                a[1] += stretch
                if a[1] == p[a[0]][1]:
                    a[0], a[1] = a[0] + 1, 0
            give_back(capacity - offset, next_bin + done, stretch)
            done += stretch
        next_bin += times

    rooms = sorted(free)

    def put(room, first, number):
        if number and room:
            if room not in free:
                insort(rooms, room)
                free[room] = []
            free[room].append((first, number))

    for length in sorted((n for n in counts if n <= capacity // small), reverse=True):
        rest = counts[length]
        while rest:
            i = bisect_left(rooms, length)
            if i == len(rooms):  # open sequences that this length fills alone as far as it goes
                each = min(capacity // length, rest)
                number = rest // each
                place(length, number * each, next_bin, 0, each)
                put(capacity - each * length, next_bin, number)
                next_bin += number
                rest -= number * each
                continue
            room = rooms[i]
            first, number = free[room].pop()
            if not free[room]:
                del free[room]
                rooms.pop(i)
            each = min(room // length, rest)
            some = min(number, rest // each)
            place(length, some * each, first, capacity - room, each)
            rest -= some * each
            put(room - each * length, first, some)
            put(room, first + some, number - some)
    return next_bin, runs


# --- placing ----------------------------------------------------------------

def _placed(sent):
    def run(batches):
        key, begin, runs = sent.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy().astype(np.int64) for i in (1, 2))
            own = np.searchsorted(key, (length << 40) | rank, "right") - 1
            q, first, offset, each = rank - begin[own], runs[own, 0], runs[own, 1], runs[own, 2]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(first + q // each), pa.array(offset + (q % each) * length)],
                names=["row", "sequence_id", "offset"])
        give_back()
    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, groupings: tuple = GROUPINGS, with_ids: bool = False,
         remember: bool = True) -> DataFrame:
    """The pieces of ``pieces`` with sequence_id and offset.

    Every piece is in one sequence, sequences hold at most ``capacity`` ids and have no gaps; which of the pieces of
    equal length goes where is settled by their keys. An empty table gives no sequences.
    """
    cut = pieces(docs, tokenizer, capacity, end_id, with_ids, remember).withColumn("slot", F.pmod(F.xxhash64("row_key", "piece"), F.lit(SLOTS)).cast("int"))
    cut = written(cut)
    return place(cut, capacity, groupings)


def place(cut: DataFrame, capacity: int, groupings: tuple = GROUPINGS) -> DataFrame:
    """Pieces (with length, row_key, piece, slot) with their places. The driver gets one count per length."""
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    runs = np.array(sorted(plan(counts, capacity, groupings)), dtype=np.int64).reshape(-1, 6)
    sent = cut.sparkSession.sparkContext.broadcast(((runs[:, 0] << 40) | runs[:, 1], runs[:, 1], runs[:, 3:]))
    # The rank within a length: pieces in lower slots, then the place within the slot.
    lower = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = cut.groupBy("length", "slot").count().select("length", "slot", F.coalesce(F.sum("count").over(lower), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "slot").orderBy("row_key", "piece", "doc_id")
    ranked = cut.withColumn("nth", F.row_number().over(order)).join(slots, ["length", "slot"])
    rows = ranked.select(F.struct("doc_id", "row_key", "piece", "start", "length", "ids_crc32", "ids").alias("row"), "length",
                         (F.col("before") + F.col("nth") - 1).alias("rank"))
    schema = rows.select("row").schema.add("sequence_id", "long").add("offset", "long")
    return rows.mapInArrow(_placed(sent), schema).select("row.*", "sequence_id", "offset")
