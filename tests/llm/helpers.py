"""Small tables and brute-force versions that the operators are held against."""

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns whose names the operators use themselves.
CLASHES = "row string, row_key bigint, _key bigint, bucket bigint, n bigint, component string, slot int, part int, score double, place int"
_LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))


def shingles(text, k):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def prose(seed, n, vocabulary=3000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(text, seed, times):
    rng, w = random.Random(seed), text.split(" ")
    for _ in range(times):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def frame(spark, texts, extra=False):
    """Documents with ids from 0; ``texts`` holds texts or (doc_id, text) pairs."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    if not extra:
        return spark.createDataFrame(full, SCHEMA)
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, "y", 5, 6, 0.5, 7) for r in full], f"{SCHEMA}, {CLASHES}")


def odd_texts():
    """Nulls, empties, white space, ties, repeated rows, a very long text, a very long word, odd characters."""
    long = prose(1, 60_000, 20_000)
    return [(None, None), (None, "lost words here"), (None, "lost words here"), (1, None), (2, ""), (3, " \n\t \x0b"), (4, "one"), (5, "ONE"),
            (6, "a b c d e f"), (6, "a b c d e f"), (6, "other text for the same id"), (7, long), (8, long), (9, "z" * 300_000),
            (10, "naïve ÄÖ \u00a0 \U0001f600 text\r\nline\x85end"), (11, "same same same same " * 200), (12, "x\n" * 500)]


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
