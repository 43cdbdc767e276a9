"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

score = w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2], through a logistic link. The pairwise
part costs one pass over the features of a text. The model is fitted on a bounded sample of labelled rows (``max_rows``)
and is of fixed size (``2**BITS`` words), so sending it to the workers is bounded whatever the corpus.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adlake.llm.tables import give_back, needs, send_code, written
from adlake.llm.words import U, buffers, distinct, row_sums, slices, words

BITS, RANK = 15, 6
# Classes of bytes whose shares describe a text's make-up.
_CLASSES = {"upper": rb"[A-Z]", "digit": rb"[0-9]", "space": rb"[\t-\r ]", "mark": rb"[.,;:!?]", "symbol": rb"[|*%$&#@<>{}=_~^\\/+]",
            "wide": rb"[\x80-\xff]", "line": rb"\n", "exclaim": rb"!"}
_IN_CLASS = np.array([[bool(re.match(p, bytes([b]))) for b in range(256)] for p in _CLASSES.values()])
N_STRUCTURE = len(_CLASSES) + 8
N_FEATURES = 2**BITS + N_STRUCTURE


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values and row offsets. A null text counts as empty; it has the structure features alone."""
    raw, at = buffers(texts)
    size = np.diff(at).astype(np.float64)
    shares = []
    for member in _IN_CLASS:
        shares.append(row_sums(member[raw].astype(np.int64), at) / np.maximum(size, 1))
    hashes, word_at = words(texts)
    kinds, kind_at = distinct(hashes, word_at)
    n_words, n_kinds = np.diff(word_at), np.diff(kind_at)
    filled = np.maximum(n_words, 1)
    # The most frequent word's share and the share of adjacent repeats tell repetitive junk from prose.
    slots = (hashes & U(2**BITS - 1)).astype(np.int64)
    counts, slot_at, names = [], [0], []
    top = np.zeros(len(n_words))
    for i, (a, b) in enumerate(zip(word_at[:-1], word_at[1:])):
        name, count = np.unique(slots[a:b], return_counts=True)
        names.append(name)
        counts.append(count)
        slot_at.append(slot_at[-1] + len(name))
        top[i] = count.max() / (b - a) if b > a else 0
    same = np.zeros(len(hashes), dtype=np.int64)
    same[1:] = hashes[1:] == hashes[:-1]
    same[word_at[:-1][n_words > 0]] = 0
    single = np.log1p(n_words)
    structure = np.stack([
        *shares, np.minimum(np.log1p(size) / 10, 2), np.minimum(single / 8, 2), np.minimum(size / filled / 10, 3),
        n_kinds / filled, top, row_sums(same, word_at) / filled, (n_words == 0).astype(float), np.ones(len(size)) * 0.5], axis=1)
    lengths = np.diff(slot_at)
    values = np.log1p(np.concatenate(counts)) if counts else np.zeros(0)
    norm = np.sqrt(np.maximum(np.add.reduceat(np.append(values**2, 0), np.minimum(slot_at[:-1], len(values))) * (lengths > 0), 1e-9))
    values = values / np.repeat(norm, lengths)
    rows = np.arange(len(size))
    index = np.concatenate([np.concatenate(names) if names else np.zeros(0, np.int64),
                            np.tile(2**BITS + np.arange(N_STRUCTURE), len(size))])
    value = np.concatenate([values, structure.ravel()])
    row = np.concatenate([np.repeat(rows, lengths), np.repeat(rows, N_STRUCTURE)])
    order = np.argsort(row, kind="stable")
    out_at = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(lengths + N_STRUCTURE, out=out_at[1:])
    return index[order].astype(np.int32), value[order].astype(np.float32), out_at


def raw_scores(model: dict, index: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The machine's value per row, by the sum-of-squares identity."""
    vx = model["v"][index] * value[:, None]
    pair = (np.add.reduceat(vx, at[:-1]) ** 2 - np.add.reduceat(vx**2, at[:-1])).sum(axis=1) / 2
    return model["w0"] + np.add.reduceat(model["w"][index] * value, at[:-1]) + pair


def fit(parts: list, labels: list, epochs: int = 12, steps: int = 800, rate: float = 0.08, seed: int = 7) -> dict:
    """AdaGrad on the logistic loss over mini-batches, for ``epochs`` passes and ``steps`` batches at least.

    ``parts`` are the features of 64 rows each. With no rows of one class the model is the plain share.
    """
    y = np.asarray(labels, dtype=np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    rng = np.random.default_rng(seed)
    model = {"w0": float(np.log(share / (1 - share))), "w": np.zeros(N_FEATURES, np.float32),
             "v": rng.normal(0, 0.02, (N_FEATURES, RANK)).astype(np.float32)}
    if not len(y) or y.min() == y.max():
        model["v"][:] = 0
        return model
    labelled = [(p, y[i * 64:(i + 1) * 64]) for i, p in enumerate(parts)]
    gw, gv, g0 = np.full(N_FEATURES, 1e-6), np.full((N_FEATURES, RANK), 1e-6), 1e-6
    for _ in range(max(epochs, -(-steps // len(labelled)))):
        for j in rng.permutation(len(labelled)):
            (index, value, at), want = labelled[j]
            n = np.diff(at)
            error = 1 / (1 + np.exp(-raw_scores(model, index, value, at))) - want
            each = np.repeat(error, n)[:, None] / len(want)
            vx = model["v"][index] * value[:, None]
            total = np.repeat(np.add.reduceat(vx, at[:-1]), n, axis=0)
            touched, place = np.unique(index, return_inverse=True)
            step_w, step_v = np.zeros(len(touched)), np.zeros((len(touched), RANK))
            np.add.at(step_w, place, each[:, 0] * value)
            np.add.at(step_v, place, each * value[:, None] * (total - vx))
            step_w += 1e-5 * model["w"][touched]
            step_v += 1e-5 * model["v"][touched]
            gw[touched] += step_w**2
            gv[touched] += step_v**2
            model["w"][touched] -= (rate * step_w / np.sqrt(gw[touched])).astype(np.float32)
            model["v"][touched] -= (0.2 * rate * step_v / np.sqrt(gv[touched])).astype(np.float32)
            step = error.mean()
            g0 += step**2
            model["w0"] -= rate * step / np.sqrt(g0)
    return model


def held_out_fold(column: str = "doc_id", folds: int = 5):
    return F.crc32(F.col(column).cast("string")) % folds == 0


def _vectors(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            index, value, at = features(part.column(part.schema.get_field_index("text")))
            spans = list(zip(at[:-1], at[1:]))
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index(c)) for c in ("k", "doc_id", "y")]
                + [pa.array(np.diff(at)), pa.array([index[a:b].tobytes() for a, b in spans], pa.binary()),
                   pa.array([value[a:b].tobytes() for a, b in spans], pa.binary())],
                names=["k", "doc_id", "y", "n", "index", "value"])
    give_back()


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 6000, max_features: int = 1 << 22) -> dict:
    """A model from labelled rows outside the held-out fold.

    The sample is taken in order of a hash of doc_id, whatever a text's length, until ``max_rows`` rows or
    ``max_features`` features (8 bytes each) are reached. Texts stay on the workers: the driver gets feature vectors,
    and one has ``N_FEATURES`` features at most. Rows without text count as empty texts; rows whose label is null, or
    whose doc_id is null or has several different labels, are not learnt from.
    """
    send_code(docs.sparkSession)
    one = (needs(labels, "doc_id", label).where(F.col("doc_id").isNotNull() & ~held_out_fold())
           .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id", "y")
    rows = (needs(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
            .select(F.xxhash64("doc_id").alias("k"), "doc_id", F.col("y").cast("double").alias("y"), "text"))
    kinds = rows.select("k", "doc_id", "y").schema
    vectors = written(rows.mapInArrow(_vectors, kinds.add("n", "long").add("index", "binary").add("value", "binary")))
    last, total = None, 0
    for row in vectors.select("k", "doc_id", "n").orderBy("k", "doc_id").collect():
        last, total = row, total + row.n
        if total >= max_features:
            break
    if last is None:
        return fit([], [])
    same = F.lit(last.doc_id).cast(vectors.schema["doc_id"].dataType)
    within = (F.col("k") < last.k) | ((F.col("k") == last.k) & (F.col("doc_id") <= same))
    sample = vectors.where(within).orderBy("k", "doc_id").collect()
    parts = []
    for i in range(0, len(sample), 64):
        some = sample[i:i + 64]
        parts.append((np.concatenate([np.frombuffer(r["index"], np.int32) for r in some]),
                      np.concatenate([np.frombuffer(r["value"], np.float32) for r in some]),
                      np.cumsum([0] + [r["n"] for r in some])))
    return fit(parts, [r["y"] for r in sample])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of ``docs`` as ``row`` (a struct) and its score from 0 to 1; repeated rows are scored each."""
    send_code(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        fm = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                index, value, at = features(part.column(part.schema.get_field_index("text")))
                values = 1 / (1 + np.exp(-np.clip(raw_scores(fm, index, value, at), -60, 60).astype(np.float64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values)], names=["row", "score"])
        give_back()

    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    schema = rows.select("row").schema.add("score", "double")
    return rows.mapInArrow(run, schema)
