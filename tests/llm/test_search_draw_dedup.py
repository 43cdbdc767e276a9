"""Ranked search, importance resampling and exact deduplication against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import CLASHES, SCHEMA, edited, frame, odd_texts, prose
from pyspark.sql import functions as F

from adlake.llm import ball_tree, exact_dedup, importance
from adlake.llm.terms import crc_of_terms, hashes, runs_of, terms

ITEMS = "item_id bigint, text string"
_LOWER = {i: i + 32 for i in range(65, 91)}
STRANGE = ["", None, "a", "A b", "x" * 70, "é-Ö_ü 12ab\x7fCD", "w" * 64 + " " + "v" * 65 + " u", "\U0001f600   z", "a a a b"]


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))


def numbers(*values):
    return [np.array(v) for v in values]


def test_terms_and_checksums():
    texts = STRANGE + [prose(i, 50) for i in range(5)]
    raw, starts, ends, at = terms(pa.array(texts))
    one, two = crc_of_terms(raw, starts, ends)
    value = hashes(raw, starts, ends)
    seen = {}
    for i, text in enumerate(texts):
        want, (a, b) = terms_of(text), at[i:i + 2]
        assert [bytes(raw[s:e]).decode() for s, e in zip(starts[a:b], ends[a:b])] == want
        assert [int(c) for c in one[a:b]] == [zlib.crc32(w.encode()) for w in want]
        assert [int(c) for c in two[a:b][:-1]] == [zlib.crc32(f"{v} {w}".encode()) for v, w in zip(want, want[1:])]
        for w, h in zip(want, value[a:b]):
            assert seen.setdefault(int(h), w) == w
    distinct, count, at = runs_of(*numbers([5, 3, 5, 9, 9, 9], [0, 3, 3, 6]))
    assert distinct.tolist() == [3, 5, 9] and count.tolist() == [1, 2, 3] and at.tolist() == [0, 2, 2, 3]


# --- ranked search ---------------------------------------------------------------------


def brute_search(docs, items, k):
    """docs and items: lists of (id, text). Per item the k best (score, id), ids ascending where scores are equal."""
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    n, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        asked, scores = Counter(terms_of(text)), []
        for i, bag in bags:
            m = 25 + 75 * sum(bag.values()) * n // total if bag else 0
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * bag[w] // (1000 * bag[w] + 8 * m))
                        for w, c in asked.items() if w in bag)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return Counter(out)


def searched(docs, items, **options):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in ball_tree.search(docs, items, **options).collect())


def zipf_texts(seed, n, words):
    rng = random.Random(seed)
    return [" ".join(f"t{int(rng.paretovariate(0.6)) % 500}" for _ in range(rng.randrange(1, words))) for _ in range(n)]


@pytest.mark.parametrize("options", [
    {}, {"tree_docs": 7, "leaf": 2, "centre": 3, "cell_entries": 50, "query_bytes": 200}, {"most_terms": 0, "leaf": 1, "tree_entries": 40}])
def test_search_equals_brute_force(spark, options):
    texts = zipf_texts(1, 150, 60)
    texts += texts[:20] + [edited(t, 3, 2) for t in texts[20:30]] + ["only here", "", None, texts[0] * 40]
    items = [(i, t) for i, t in enumerate(texts[5:9] + zipf_texts(2, 6, 30))] + [(90, ""), (91, None), (92, "nowhere"), (92, "nowhere t1 t1 t2")]
    docs = list(enumerate(texts))
    got = searched(frame(spark, docs).repartition(3), spark.createDataFrame(items, ITEMS), k=4, **options)
    assert got == brute_search(docs, items, 4)


def test_search_edges(spark):
    odd, items = odd_texts(), [(1, "lost words here"), (None, "one"), (2, "same c"), (2, "same c"), (3, None), (4, "w1 w2 w3 w4 naïve äö"), (5, "z" * 300_000)]
    queries = spark.createDataFrame([(*i, 1, 0.5, 2) for i in items], ITEMS + ", doc_id bigint, score double, row int")
    got = searched(frame(spark, odd, extra=True).repartition(4), queries, k=3)
    assert got == brute_search(odd, items, 3)
    assert searched(frame(spark, []), queries) == Counter() == searched(frame(spark, odd), queries.limit(0))


def test_far_subtrees_are_left_out():
    """Documents of separate subjects: a search for one subject scores few of the others."""
    rng, rows = np.random.default_rng(5), []
    for subject in range(32):
        for _ in range(32):
            rows.append(np.unique(rng.integers(0, 12, 12) + 100 * subject).astype(np.uint64))
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    tree = ball_tree.build_tree(np.arange(1024), np.arange(1024), at, np.concatenate(rows), np.full(at[-1], 1000), leaf=16, centre=64)
    held, seen = ball_tree._Tree({c: tree[c].astype(kind).tobytes() for c, kind in ball_tree._KINDS.items()}), [0]
    term, weight = np.arange(700, 712, dtype=np.uint64), np.full(12, 9)
    best = ball_tree.search_trees([held], term, weight, 5, seen)
    every = sorted(((-9000 * len(np.intersect1d(r, term)), i) for i, r in enumerate(rows)))[:5]
    assert sorted((-s, d) for s, d, _ in best) == every and seen[0] < 200


# --- importance resampling -------------------------------------------------------------


def brute_draw(docs, target, percent, least, buckets, seed):
    def features(text):
        w = terms_of(text)
        return w, [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        w, f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[:percent * len(able) // 100]
    # Rows with equal score and id are alike up to their other columns: only their ranks are compared.
    return Counter((r[0], *r[2:]) for r in rows), [(n + 1, r[0], r[4]) for n, r in enumerate(drawn)]


def drawn(docs, target, **options):
    rows = importance.resample(docs, target, **options).collect()
    return Counter((r.doc_id, r.n_features, r.weight, r.score) for r in rows), sorted((r["rank"], r.doc_id, r.score) for r in rows if r["rank"])


@pytest.mark.parametrize("at_once, percent, least", [(1, 25, 20), (7, 60, 3), (4096, 25, 20), (2, 100, 0), (3, 0, 0)])
def test_draw_equals_brute_force(spark, at_once, percent, least):
    docs = list(enumerate(zipf_texts(3, 220, 70)))
    target = zipf_texts(4, 30, 20) + [None, ""]
    got = drawn(frame(spark, docs).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"),
                percent=percent, least_words=least, buckets=97, at_once=at_once)
    assert got == brute_draw(docs, target, percent, least, 97, 7)


def test_draw_edges(spark):
    odd = odd_texts() + [(6, "a b c d e f")] * 40 + [(None, "lost words here")] * 30
    got = drawn(frame(spark, odd, extra=True).repartition(6), frame(spark, odd), percent=50, least_words=1, at_once=1)
    assert got == brute_draw(odd, [t for _, t in odd], 50, 1, 10_000, 7)
    none = frame(spark, [])
    assert drawn(none, frame(spark, odd)) == (Counter(), [])
    rows, ranks = drawn(frame(spark, odd), none, percent=100, least_words=0)
    assert (rows, ranks) == brute_draw(odd, [], 100, 0, 10_000, 7) and len(ranks) == len(odd)


def test_cutoff_of_equal_scores(spark):
    """All scores equal: the id, and where it is equal too the row number, decide."""
    keys = spark.createDataFrame([(i, None if i % 5 == 0 else i % 7, 3) for i in range(400)], "row bigint, doc_id bigint, score bigint").repartition(9)
    order = sorted((-3, i % 5 == 0, 0 if i % 5 == 0 else i % 7, i) for i in range(400))
    for wanted in (1, 57, 200, 333, 400):
        assert importance.cutoff(keys, wanted, at_once=1) == order[wanted - 1]
    assert importance.cutoff(keys, 401) is None and importance.cutoff(keys, 0) is None


# --- exact deduplication -----------------------------------------------------------------


def brute_groups(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = Counter()
    for content, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(content.encode()).hexdigest()
        out.update((i, ids[0], len(ids), n == 0, sha) for n, i in enumerate(ids))
    return out


def decided(df):
    return Counter((r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def stored(spark, rows, path, files=3, schema=SCHEMA, extra=()):
    full = [(i, t, "en", "s", len(t or ""), *extra) for i, t in rows]
    spark.createDataFrame(full, schema).repartition(files).write.mode("append").parquet(path)


def copies():
    base = zipf_texts(6, 60, 30)
    return list(enumerate(base + [b.replace(" ", " \n\t", 1) for b in base[:30]] + [base[0]] * 300 + ["", None, " ", "\n\n"]))


# A digest of 3 values: nearly all hits are false ones, which only the comparison of contents can tell.
def weak_digest(content):
    return F.encode((F.crc32(F.encode(content, "UTF-8")) % 3).cast("string"), "UTF-8")


@pytest.mark.parametrize("options", [{}, {"cell_bytes": 40}, {"digest": weak_digest}, {"digest": weak_digest, "cell_bytes": 40}])
def test_exact_groups(spark, tmp_path, options):
    rows = copies()
    stored(spark, rows, str(tmp_path / "t"))
    assert decided(exact_dedup.deduplicate(spark, str(tmp_path / "t"), **options)) == brute_groups(rows)


def test_later_files_meet_the_kept_state(spark, tmp_path):
    rows, path, checkpoint = copies(), str(tmp_path / "t"), str(tmp_path / "state")
    random.Random(2).shuffle(rows)
    for n, part in enumerate((rows[:100], rows[100:250], rows[250:])):
        stored(spark, part, path, files=2)
        # One byte a batch: every file is a batch of its own.
        got = exact_dedup.deduplicate(spark, path, checkpoint, bytes_per_batch=1)
        assert decided(got) == brute_groups(rows[:(100, 250, len(rows))[n]])
    before = exact_dedup.retained(spark, checkpoint).collect()
    exact_dedup.ingest(spark, path, checkpoint)  # nothing new
    assert sorted(map(repr, exact_dedup.retained(spark, checkpoint).collect())) == sorted(map(repr, before))


def test_exact_dedup_edges(spark, tmp_path):
    odd = odd_texts() + [(None, "twice")] * 2 + [(-5, "TWICE"), (8, "twice")]
    stored(spark, odd, str(tmp_path / "odd"), schema=f"{SCHEMA}, {CLASHES}", extra=("x", 1, 2, 3, 4, "y", 5, 6, 0.5, 7))
    assert decided(exact_dedup.deduplicate(spark, str(tmp_path / "odd"))) == brute_groups(odd)
    frame(spark, []).write.parquet(str(tmp_path / "none"))
    assert exact_dedup.deduplicate(spark, str(tmp_path / "none")).collect() == []
