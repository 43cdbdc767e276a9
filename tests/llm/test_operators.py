"""Operators against brute force, exact round trips or SQL."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import components, edited, frame, prose, shingles, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from adlake.llm import decontaminate as decontamination
from adlake.llm import bloom_lm, minhash_dedup, packing, quality, substring_dedup, url_filter
from adlake.llm import words as hashed
from adlake.llm.components import components as connected
from adlake.llm.decontaminate import contaminated, decontaminate
from adlake.llm.line_dedup import dedup_lines, keep_bitmaps
from adlake.llm.order_minhash import edited_likeness, fingerprints
from adlake.llm.queries import QUERIES, SQL, URL_RULES
from adlake.llm.sharding import numbered_copies, shuffle_into_shards, write_shards
from check_oracle import connect, spark_rows, sql_rows

FOLDER = os.environ.get("ADLAKE_TEST_TABLES", "/root/testdata/sf0.001")
TOKENS = public_tokenizers.path("word_bpe_49k.json")
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


# --- words --------------------------------------------------------------------

def test_words_agree_with_a_regular_expression():
    texts = ["", None, " a\tB  c\n", "ÄÖ é\u00a0x", "one", "\x0b\x0c\r", "A b A b", "a" * 3_000_000 + " tail " + "b c " * 600_000, "x"]
    found, at = hashed.words(pa.array(texts, pa.large_string()))
    names = {}
    for i, text in enumerate(texts):
        want = words(text)
        own = found[at[i]:at[i + 1]].tolist()
        assert len(own) == len(want)
        for word, value in zip(want, own):
            assert names.setdefault(word, value) == value
    assert len(set(names.values())) == len(names)


def test_shingles_and_sets():
    texts = ["a b c d e", "a b", "", "a b c a b c a b c"]
    values, at = hashed.shingles(*hashed.words(pa.array(texts, pa.large_string())), 3)
    assert np.diff(at).tolist() == [3, 1, 0, 7]
    kinds, kind_at = hashed.distinct(values, at)
    assert np.diff(kind_at).tolist() == [len(shingles(t, 3)) for t in texts]


# --- 1 ------------------------------------------------------------------------

def near_texts():
    base = [prose(i, 40 + 25 * (i % 7)) for i in range(25)]
    texts = list(base)
    for i, text in enumerate(base):
        texts += [edited(text, 100 * i + j, j) for j in range(1, 1 + i % 6)] + [text] * (i % 3)
    chain = prose(99, 60)
    for j in range(6):
        texts.append(chain)
        chain = edited(chain, j, 1)
    return texts + ["short one", "short ONE", "a", "a", "", ""]


def test_near_duplicates_equal_brute_force(spark):
    texts = near_texts()
    random.Random(3).shuffle(texts)
    sets = [shingles(t, 4) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2)
             if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = components(range(len(texts)), links)
    got = minhash_dedup.near_duplicates(frame(spark, texts), words_per_shingle=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        i: (len(s), want[i], want[i] == i) for i, s in enumerate(sets)}


def test_large_group_of_copies_needs_few_pairs(spark):
    base = prose(5, 120)
    texts = [edited(base, i, i % 9) for i in range(300)]
    sets = [shingles(t, 5) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(300), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = components(range(300), links)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert got == want


def test_superminhash_estimates_resemblance():
    rng = np.random.default_rng(1)
    errors = []
    for share in (0.2, 0.5, 0.8):
        for _ in range(30):
            n = 200
            both = int(2 * n * share / (1 + share))
            x = rng.integers(0, 2**63, 2 * n - both).astype(np.uint64)
            sets = np.concatenate([x[:n], x[n - both:]])
            one, two = minhash_dedup.signatures(sets, np.array([0, n, 2 * n]))
            errors.append((one == two).mean() - both / (2 * n - both))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_parity_bound_never_exceeds_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        one, two = minhash_dedup.parities(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).view(np.uint64)
        bits = sum(int(x).bit_count() for x in one ^ two)
        assert bits <= len(np.setxor1d(a, b))


def test_components_of_long_paths(spark):
    n = 120
    order = list(range(n))
    random.Random(1).shuffle(order)
    name = {i: f"{x:04d}".encode() for i, x in enumerate(order)}
    links = [(name[i], name[i + 1]) for i in range(n - 1) if i != 59] + [(b"zz", b"zy"), (b"zz", b"zz")]
    got = dict(connected(spark.createDataFrame(links, "a binary, b binary").repartition(9)).collect())
    left, right = min(name[i] for i in range(60)), min(name[i] for i in range(60, n))
    assert {bytes(k): bytes(v) for k, v in got.items()} == {
        **{name[i]: left for i in range(60)}, **{name[i]: right for i in range(60, n)}, b"zz": b"zy", b"zy": b"zy"}


# --- 2 ------------------------------------------------------------------------

def test_windows_equal_brute_force():
    rng = np.random.default_rng(4)
    for t in (2, 3, 5):
        sizes = [0, 1, t, 17, 30]
        values = rng.integers(1, 40, sum(sizes)).astype(np.uint64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        want = set()
        for a, b in zip(at[:-1], at[1:]):
            spans = {}
            for i in range(a, b):
                for j in range(i + t - 1, b):
                    c = i + int(np.argmin(values[i:j + 1]))
                    lo, hi = spans.get(c, (i, j))
                    spans[c] = (min(lo, i), max(hi, j))
            want |= {(lo, c, hi) for c, (lo, hi) in spans.items()}
        assert set(zip(*(x.tolist() for x in substring_dedup.windows(values, at, t)))) == want


def test_repeated_passages_are_found_and_others_left_alone(spark):
    shared = [prose(1000 + i, 55 + 10 * i) for i in range(6)]
    texts, planted = [], {}
    for i in range(60):
        text = [prose(i, 80 + i)]
        if i < 36:
            text.insert(0, shared[i % 6] if i % 12 < 6 else edited(shared[i % 6], i, 1))
            text.insert(0, prose(500 + i, 30))
            planted[i] = i % 6
        texts.append(" ".join(text))
    texts += [prose(77, 40) + " " + prose(i, 45) for i in range(3000, 3006)]  # forty common words are not a passage
    rows = substring_dedup.repeated_passages(frame(spark, texts)).collect()
    found = {r.doc_id for r in rows} | {r.source_id for r in rows}
    assert found == set(planted)
    for r in rows:
        assert planted[r.doc_id] == planted[r.source_id] and r.size >= 50 and r.source_size >= 50
        a, b = words(texts[r.doc_id])[r.start:r.start + r.size], words(texts[r.source_id])[r.source_start:r.source_start + r.source_size]
        one, two = shingles(" ".join(a), 5), shingles(" ".join(b), 5)
        assert len(a) == r.size and len(one & two) >= 0.7 * len(one | two)


# --- 3 ------------------------------------------------------------------------

def bench(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def test_containment_equals_brute_force(spark):
    items = [(i, prose(900 + i, n)) for i, n in enumerate([3, 5, 9, 14, 20, 33, 47, 60, 90, 150, 400])] + [(50, None), (51, "")]
    texts = [prose(i, 200 + 97 * i) for i in range(12)]
    for i, text in items[:11]:
        cut = words(text)
        texts += [prose(40 + i, 1500) + " " + text.upper() + " " + prose(70 + i, 700), edited(text, i, max(1, len(cut) // 40)) + " end of it",
                  " ".join(cut[:len(cut) * 3 // 4]) + " " + prose(i, 90), text]
    own = {i: shingles(t, 5) for i, t in items}
    want = set()
    for d, text in enumerate(texts):
        s = shingles(text, 5)
        want |= {(d, i, len(x), len(x & s)) for i, x in own.items() if x and 100 * len(x & s) >= 80 * len(x)}
    for block in (1 << 22, 700):  # one block and many
        got = contaminated(frame(spark, texts), bench(spark, items), block_bytes=block).collect()
        assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got} == want and len(got) == len(want)
    clean = {r.doc_id for r in decontaminate(frame(spark, texts), bench(spark, items)).collect()}
    assert clean == set(range(len(texts))) - {d for d, *_ in want}


def test_item_of_one_shingle_at_the_begin_of_a_document(spark):
    # Documents whose second shingle has the bin of the first and a smaller rank.
    texts = [f"one two three four five x{i}" for i in range(6000)]
    values, _ = hashed.shingles(*hashed.words(pa.array(texts, pa.large_string())), 5)
    first, second = decontamination._ranks(values).reshape(-1, 2).T
    hidden = np.flatnonzero((decontamination._bins(first) == decontamination._bins(second)) & (second < first)).tolist()
    assert hidden
    got = contaminated(frame(spark, [texts[i] for i in hidden] + ["none of it here at all"]), bench(spark, [(1, texts[0][:-3])])).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(hidden)))


# --- 4 ------------------------------------------------------------------------

def brute_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host):])[0]
    return host.translate({i: i + 32 for i in range(65, 91)}), path


def test_url_rules_and_ratio(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q#f", "http://example.net/EN/x", "http://example.net", "http://x.net/", "ftp://net/a",
            "http://example.com/de/1", "http://m.example.com/dex", "https://a.org/fr/", "https://org/fr/1", "https://org.x/fr/", "http://h?x=/en/",
            "http://h#x/y", "http://ünet/é/", "://net/", "a://b://net/", "http://x.net/\nq"]
    urls += [f"http://casino-{i}.example.net/win/{i}" for i in range(60)] + [f"http://poem-{i}.example.net/en/{i}" for i in range(60)]
    urls += ["http://casino-77.example.com/win/9", "http://poem-88.example.com/en/3"] * 2
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    rows = url_filter.judge(pages, URL_RULES).collect()
    assert sorted(r.page_id for r in rows) == list(range(len(urls)))
    for r in rows:
        host, path = brute_parts(urls[r.page_id])
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        if fits:
            assert r.verdict == max(fits)[2]
    assert [r.verdict for r in sorted(rows, key=lambda r: r.page_id)[-4:]] == ["block", "allow"] * 2


def test_url_scores_equal_brute_force(spark):
    labelled = [("http://aab.x/1", True), ("http://abc.x/", True), ("http://zzy.x/?", False), ("q", False), ("", True)]
    asked = ["http://abz.x/Ä", "", "zz", "http://aab.x/1"]
    model = url_filter.train(spark.createDataFrame(labelled, "url string, accepted boolean"))
    got = {r.url: r.score for r in url_filter.scores(spark.createDataFrame([(u,) for u in asked], "url string"), model).collect()}
    order, alphabet = url_filter.ORDER, url_filter.ALPHABET

    def signs(url):
        return "^" * (order - 1) + re.sub("[^a-z0-9./_?=&#%:@~+-]", "*", url.translate({i: i + 32 for i in range(65, 91)})) + "$"

    counts = {True: Counter(), False: Counter()}
    for url, kind in labelled:
        s = signs(url)
        for i in range(order - 1, len(s)):
            counts[kind].update(s[i - n:i + 1] for n in range(order))

    def p(kind, context, x):
        lower = p(kind, context[1:], x) if context else 1 / len(alphabet)
        total = sum(counts[kind][context + y] for y in alphabet)
        return (counts[kind][context + x] + 4 * lower) / (total + 4)

    def known(context):
        return any(counts[k][context + y] for k in counts for y in alphabet)

    for url in asked:
        s, ratios = signs(url), []
        for i in range(order - 1, len(s)):
            context = s[i - order + 1:i]
            while not known(context):
                context = context[1:]
            ratios.append(math.log(p(True, context, s[i]) / p(False, context, s[i])))
        assert got[url] == pytest.approx(sum(ratios) / len(ratios))


# --- 5 ------------------------------------------------------------------------

def tokens(text):
    return words(text) + ["\0end"]


def test_scores_equal_brute_force(spark):
    train = [prose(i, 50, 300) for i in range(40)] + ["", None, "A a b", prose(1, 50, 300)]
    asked = train[:5] + [prose(90, 60, 400), "", None, "never seen before", "a A"]
    counts = Counter(itertools.chain.from_iterable(tokens(t) for t in train))
    pairs = Counter((x, y) for t in train for x, y in zip(["\0begin"] + tokens(t), tokens(t)))
    n, v = sum(counts.values()), len(counts)
    for head in (1 << 17, 20):  # with hardly any head, nearly all words go through the shuffle
        model = bloom_lm.train(frame(spark, train), head_words=head)
        assert (model["N"], model["V"]) == (n, v)
        got = {r.doc_id: r for r in bloom_lm.score(frame(spark, asked), model).collect()}
        share = sum(bloom_lm.VALUES[bloom_lm.level_of(c)] - 1 for c in pairs.values() if c > 1) / n
        assert model["share"] == pytest.approx(min(0.95, share))

        def quantised(c, bound=bloom_lm.LOW):
            return bound[int(bloom_lm.level_of(np.uint64(c)))]

        for i, text in enumerate(asked):
            own = tokens(text)
            base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
            assert (got[i].n_tokens, got[i].n_known) == (len(own), sum(counts[w] > 0 for w in own))
            assert got[i].base_score == pytest.approx(base)
            score = 0.0
            for h, w in zip(["\0begin"] + own, own):
                of_h = quantised(len(train) if h == "\0begin" else counts[h], bloom_lm.HIGH)
                near = min(1, quantised(pairs[h, w]) / of_h) if of_h else 0
                score += math.log10(model["share"] * near + (1 - model["share"]) * (quantised(counts[w]) + 0.1) / (n + 0.1 * (v + 1)))
            assert got[i].score == pytest.approx(score, rel=0.02)  # false positives of the filters


def test_probabilities_sum_to_one_at_most(spark):
    # Words seen 11, 12, 15 and 23 times with followers of their own are where quantised shares of pairs exceeded 1.
    train = [f"h{n} f{n}x{i}" for n in (1, 4, 5, 11, 12, 15, 23) for i in range(n)] + ["h9 a h9 a h9 b"] * 3 + [prose(i, 80, 40) for i in range(20)]
    model = bloom_lm.train(frame(spark, train))
    vocabulary = sorted({w for t in train for w in words(t)})
    histories = ["h1", "h4", "h5", "h11", "h12", "h15", "h23", "h9", "a", "w7", "w31", "never"]
    # p(w | h) from the scores s of texts: s(h w) - s(w) = log10 of p(h | begin) p(w | h) / p(w | begin).
    asked = vocabulary + ["unseen"] + [f"{h} {w}" for h in histories for w in vocabulary + ["unseen"]]
    got = {r.doc_id: r.score for r in bloom_lm.score(frame(spark, asked), model).collect()}
    score = {text: got[i] for i, text in enumerate(asked)}
    floor, share = model["N"] + 0.1 * (model["V"] + 1), model["share"]
    counts = Counter(itertools.chain.from_iterable(tokens(t) for t in train))
    pairs = Counter((x, y) for t in train for x, y in zip(["\0begin"] + tokens(t), tokens(t)))

    def low(c, bound=bloom_lm.LOW):
        return bound[int(bloom_lm.level_of(np.uint64(c)))]

    def from_begin(w):
        return share * low(pairs["\0begin", w]) / low(len(train), bloom_lm.HIGH) + (1 - share) * (low(counts[w]) + 0.1) / floor

    for h in histories:
        mass = sum(10 ** (score[f"{h} {w}"] - score[w]) * from_begin(w) / from_begin(h) for w in vocabulary + ["unseen"])
        # The end follows too.
        end = share * low(pairs[h, "\0end"]) / max(1, low(counts[h], bloom_lm.HIGH)) + (1 - share) * (low(counts["\0end"]) + 0.1) / floor
        assert 0 < mass + end <= 1 + 1e-6
        if h in ("h1", "h4", "h11"):
            assert mass + end > 0.5 * share


def test_filter_reads_quantised_counts():
    rng = np.random.default_rng(5)
    names = np.unique(rng.integers(1, 1 << 62, 20000).astype(np.uint64))
    levels = bloom_lm.level_of(rng.zipf(1.5, len(names)).clip(1, 10**6).astype(np.uint64))
    raw = bloom_lm.log_filter(names, levels)
    got = bloom_lm.read_levels(raw, names)
    assert (got >= levels).all() and (got == levels).mean() > 0.97
    strange = bloom_lm.read_levels(raw, rng.integers(1 << 62, 1 << 63, 20000).astype(np.uint64))
    assert (strange == 0).mean() > 0.97 and (bloom_lm.read_levels(bloom_lm.log_filter(names[:0], levels[:0]), names) == 0).all()


def test_all_levels_are_stored_whatever_the_input(spark):
    # 2 million words seen twice and as many seen once: more than the fixed filter of words (6 MB) held.
    own = F.when(F.col("id") < 1000, F.col("id") % 500).otherwise(F.col("id"))
    train = spark.range(1500).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(
        F.sequence(F.lit(0), F.lit(3999)), lambda i: F.concat(own.cast("string"), F.lit("w"), i.cast("string")))).alias("text"))
    model = bloom_lm.train(train)
    assert model["V"] == 4 * 10**6 + 1 and model["share"] > 0.2
    got = bloom_lm.score(train.where("doc_id in (3, 1003)"), model).collect()
    # Each word is always followed by the same one, whether seen twice or once.
    assert len(got) == 2 and all(r.n_known == 4001 and r.score / r.n_tokens > math.log10(model["share"]) - 0.01 for r in got)


# --- 6 ------------------------------------------------------------------------

def test_packing_round_trip(spark):
    texts = [prose(i, 1 + (i * 37) % 900) for i in range(80)] + [prose(7, 9000), "", None, "It's <|endoftext|> 3x\u00a0y\r\nÄ"]
    rows = packing.pack(frame(spark, texts), TOKENS, capacity=512, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(TOKENS)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    for i, text in enumerate(texts):
        own = sorted(by_doc[i], key=lambda r: r.piece)
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert b"".join(r.ids for r in own) == np.array(ids, "<u4").tobytes()
        assert [r.piece for r in own] == list(range(-(-len(ids) // 512))) and [r.start for r in own] == list(range(0, len(ids), 512))
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // 512) * 1.03 + 1


def test_plans_place_each_piece_once_without_gaps():
    rng = np.random.default_rng(3)
    for _ in range(150):
        capacity = int(rng.choice([1, 2, 7, 50, 128]))
        counts = {int(n): int(rng.integers(1, 60)) for n in rng.integers(1, capacity + 1, int(rng.integers(1, 25)))}
        bins, seen = {}, Counter()
        for length, first, number, bin_, offset, each in packing.plan(counts, capacity):
            assert first == seen[length]
            seen[length] += number
            for q in range(number):
                bins.setdefault(bin_ + q // each, []).append((offset + q % each * length, length))
        assert seen == Counter(counts)
        for own in bins.values():
            assert [o for o, _ in sorted(own)] == [0, *itertools.accumulate(n for _, n in sorted(own))][:-1]
            assert sum(n for _, n in own) <= capacity
    assert packing.plan({}, 10) == []


# --- 7 ------------------------------------------------------------------------

def test_lines_equal_brute_force(spark):
    rng = random.Random(5)
    pool = [f"line number {i} É" for i in range(30)] + ["", " ", "x"]
    texts = ["\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own {i} {j}" for j in range(rng.randrange(1, 40))) for i in range(60)]
    texts += [t.upper() for t in texts[:5]] + [None, "", "\n\n"]

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})

    docs = {}
    for i, text in enumerate(texts):
        for line in (text or "").split("\n"):
            docs.setdefault(key(line), set()).add(i)
    for least, chars, keep_first in ((10, 1, False), (2, 1, True), (3, 5, True)):
        seen, want = set(), {}
        for i, text in enumerate(texts):
            lines, kept = (text or "").split("\n"), []
            for line in lines:
                k = key(line)
                common = len(k) >= chars and len(docs[k]) >= least
                if not common or (keep_first and k not in seen):
                    kept.append(line)
                seen.add(k)
            want[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
        got = dedup_lines(frame(spark, texts), min_docs=least, min_chars=chars, keep_first=keep_first).collect()
        assert {r.row.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in got} == want


def test_keep_bitmap_is_runs_of_kept_lines(spark):
    got = keep_bitmaps(frame(spark, ["a\nb\nc\nd", "b\nc\nz", "b"]), min_docs=2, keep_first=False).collect()
    assert {r.doc_id: [tuple(x) for x in r.keep_runs] for r in got} == {0: [(0, 1), (3, 1)], 1: [(2, 1)], 2: []}


# --- 8 ------------------------------------------------------------------------

def test_shards_are_a_seeded_permutation(spark, tmp_path):
    texts = [f"text {i % 50}" for i in range(403)]
    first = shuffle_into_shards(frame(spark, texts), shards=8, seed=1)
    rows = first.collect()
    assert sorted(r.row.doc_id for r in rows) == list(range(403))
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s])) for s in sizes)
    again = {r.row.doc_id: r.place for r in shuffle_into_shards(frame(spark, texts).repartition(7), shards=8, seed=1).collect()}
    assert again == {r.row.doc_id: r.place for r in rows}
    other = {r.row.doc_id: r.place for r in shuffle_into_shards(frame(spark, texts), shards=8, seed=2).collect()}
    order = np.array([again[i] for i in range(403)])
    assert other != again and abs(np.corrcoef(order, np.arange(403))[0, 1]) < 0.2
    write_shards(first, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in back} == {(r.row.doc_id, r.shard, r.slot) for r in rows}


def test_one_record_many_times_is_dealt_to_all_buckets(spark):
    same = spark.range(3000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("a copy").alias("text"))
    some = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("own "), "id")).alias("text"))
    table = same.union(some).union(some.limit(40))
    want = Counter((r.doc_id, r.text) for r in table.collect())
    rows = shuffle_into_shards(table, shards=8, seed=3, equal_rows=64).collect()
    assert Counter((r.row.doc_id, r.row.text) for r in rows) == want
    assert sorted(r.place for r in rows) == list(range(3540)) and {r.place % 8 == r.shard for r in rows} == {True}
    copies = sorted(r.place for r in rows if r.row.text == "a copy")
    assert max(b - a for a, b in zip(copies, copies[1:])) < 60 and copies[0] < 60 and copies[-1] > 3480
    again = shuffle_into_shards(table.repartition(7), shards=8, seed=3, equal_rows=64).collect()
    assert {(r.place, r.row) for r in again} == {(r.place, r.row) for r in rows}
    keyed = table.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    keys = [r.key for r in numbered_copies(keyed, 3, 64).where("row.text = 'a copy'").collect()]
    assert len(keys) == len(set(keys)) == 3000


# --- 9 ------------------------------------------------------------------------

def test_edited_texts_and_fingerprints(spark):
    texts = [prose(i, 5 + 17 * i % 400) for i in range(70)] + ["é😀x" * 30, "a", "", None, prose(3, 5 + 51)]
    rows = {r.doc_id: r for r in edited_likeness(frame(spark, [(3 * i - 50, t) for i, t in enumerate(texts)])).collect()}
    order = sorted(rows, reverse=True)
    text = {3 * i - 50: t or "" for i, t in enumerate(texts)}
    for i, d in enumerate(order):
        own, after = text[d], text[order[(i + 1) % len(order)]]
        cut = len(own) // 3
        assert rows[d].n_chars == len(own)
        assert rows[d].edited_sha256 == hashlib.sha256((own[:len(own) - cut] + after[:cut]).encode()).hexdigest()
        assert 0 <= rows[d].near_edited <= 1 and 0 <= rows[d].near_next <= 1
        if own == after:
            assert rows[d].near_next == 1
    long = [r for r in rows.values() if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.95 * len(long)
    prints = {r.doc_id: r.fingerprint for r in fingerprints(frame(spark, [(3 * i - 50, t) for i, t in enumerate(texts)])).collect()}
    assert prints == {d: r.fingerprint for d, r in rows.items()}


def test_order_of_words_matters(spark):
    base = words(prose(8, 400))
    swapped = base[200:] + base[:200]
    shuffled = random.Random(1).sample(base, 400)
    got = {r.doc_id: r.fingerprint for r in fingerprints(frame(spark, [" ".join(x) for x in (base, edited(" ".join(base), 1, 8).split(" "), swapped, shuffled)])).collect()}

    def like(a, b):
        return sum(a[i:i + 8] == b[i:i + 8] for i in range(0, len(a), 8)) / (len(a) / 8)

    assert like(got[0], got[1]) > like(got[0], got[2]) > like(got[0], got[3])


# --- 10 -----------------------------------------------------------------------

def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    model = {"w0": 0.3, "w": rng.normal(size=quality.N_FEATURES).astype(np.float32),
             "v": rng.normal(size=(quality.N_FEATURES, quality.RANK)).astype(np.float32)}
    index, value, at = quality.features(pa.array(["some words here and some there", None, "", "x " * 50], pa.large_string()))
    got = quality.raw_scores(model, index, value, at)
    for row in range(4):
        i, x = index[at[row]:at[row + 1]], value[at[row]:at[row + 1]]
        pairs = sum(float(model["v"][i[a]] @ model["v"][i[b]]) * x[a] * x[b] for a, b in itertools.combinations(range(len(i)), 2))
        assert got[row] == pytest.approx(0.3 + float(model["w"][i] @ x) + pairs, rel=1e-3, abs=1e-3)


@tables
def test_held_out_accuracy(spark):
    folder = FOLDER.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in QUERIES["op10_quality"](spark, folder).collect()}
    labels = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if got[r.doc_id].held_out]
    right = sum(got[r.doc_id].predicted == r.quality for r in labels)
    assert len(labels) > 50 and right >= 0.95 * len(labels)
    assert all((zlib.crc32(str(d).encode()) % 5 == 0) == r.held_out and 0 <= r.score <= 1 for d, r in got.items())


def test_sample_holds_texts_of_all_lengths(spark):
    # Chunks of one length that are more text than the old bound, and shorter texts that tell nothing.
    words = F.when(F.col("id") % 2 == 0, F.lit("good words here ")).otherwise(F.lit("bad junk there "))
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.rpad(F.expr("''"), 4096, words).alias("text"))
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    scored = quality.score(docs, quality.train(docs, labels)).groupBy((F.col("row.doc_id") % 2).alias("odd")).agg(
        F.min("score").alias("least"), F.max("score").alias("most")).collect()
    by = {r.odd: r for r in scored}
    assert by[0].least > 0.9 and by[1].most < 0.1
    # A bound that bites leaves fewer rows, of all lengths alike.
    long = quality.train(docs, labels, max_features=40 * 20)
    assert np.abs(long["w"]).max() > 0


# --- SQL ----------------------------------------------------------------------

@tables
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, FOLDER)) == sql_rows(connect(FOLDER), SQL[name])


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("parts", [1, 7])
def test_passages_around_a_common_phrase_are_not_lost(spark, parts):
    """Two documents share a passage that holds a phrase of others, which come first under the phrase's keys."""
    rng, texts, pairs = random.Random(5), [], []

    def some(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    for phrase, passage in [(45, 50), (40, 60), (30, 60)] * 10:
        common, cut = some(phrase), rng.randrange(passage - phrase + 1)
        shared = some(cut) + common + some(passage - phrase - cut)
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(some(70) + shared + some(80)), " ".join(some(90) + shared + some(60))]
        texts += [" ".join(some(60) + common + some(60)) for _ in range(3)]
    rows = substring_dedup.repeated_passages(frame(spark, texts).repartition(parts)).collect()
    found = components(range(len(texts)), [(r.doc_id, r.source_id) for r in rows])
    assert [p for p in pairs if found[p[0]] != found[p[1]]] == []
    for r in rows:  # every row is a passage that its documents share
        one, two = (set(zip(*[w[i:] for i in range(5)])) for w in (
            texts[r.doc_id].split()[r.start:r.start + r.size], texts[r.source_id].split()[r.source_start:r.source_start + r.source_size]))
        assert len(one & two) >= 0.7 * min(len(one), len(two)) and r.size >= 50


def test_passages_that_the_first_of_their_key_does_not_confirm_are_linked_to_the_others(spark):
    """Two documents each share 45 of a third's fifty words, and 40 with each other: one may come first for all three."""
    rng, texts, pairs = random.Random(8), [], []

    def some(n):
        return [f"v{rng.randrange(10**6)}" for _ in range(n)]

    for _ in range(400):
        whole = some(50)
        pairs += [(len(texts), len(texts) + 1), (len(texts), len(texts) + 2)]
        texts += [" ".join(some(20) + part + some(20)) for part in (whole, whole[:45], whole[5:])]
    rows = substring_dedup.repeated_passages(frame(spark, texts)).collect()
    found = {tuple(sorted((r.doc_id, r.source_id))) for r in rows}
    assert [p for p in pairs if p not in found] == []


def test_pairs_that_may_have_a_link_are_all_asked_for_and_told_by_what_is_around_their_places():
    """Against passages on whole sequences: with edits, insertions, repeats, and places near the ends."""
    rng, t, percent = random.Random(21), 46, 80
    reach, texts = t - 1 + substring_dedup._DRIFT, []
    for group in range(12):
        base = [rng.randrange(1, 10**6) for _ in range(150)]
        if group % 4 == 3:  # few words, repeated
            base = [rng.choice(base[:9]) for _ in base]
        for _ in range(9):
            own, place = list(base), rng.choice([3, 60, 75, 90, 147])
            for _ in range(rng.randrange(0, 24)):
                at = rng.randrange(len(own))
                if at != place and rng.random() < 0.8:
                    own[at] = rng.randrange(1, 10**6)
                elif at > place + 8:
                    own.insert(at, 7)
            texts.append((group, np.array(own, dtype=np.uint64), place))
    near = [(v[max(0, c - reach):c + reach + 1].astype("<u2").tobytes(), min(c, reach)) for _, v, c in texts]
    laid = substring_dedup._laid(*zip(*near), reach)
    group, apart, everyone = np.array([g for g, _, _ in texts]), np.arange(len(texts)), np.ones(len(texts), bool)
    links = {(i, j) for i in range(len(texts)) for j in range(i) if texts[i][0] == texts[j][0]
             and substring_dedup.passages(texts[i][1], texts[j][1], [(texts[i][2], texts[j][2])], t, percent)}
    assert len(links) > 40
    got = [p for x, y in substring_dedup._asked(laid, group, apart, everyone, everyone, t, percent) for p in zip(x.tolist(), y.tolist())]
    assert links <= set(got) and len(got) == len(set(got)) < len(texts) * 4
    for least in (60, 30):  # less in common, and so little that all meet all
        some = {(i, j) for i in range(len(texts)) for j in range(i) if texts[i][0] == texts[j][0]
                and substring_dedup.passages(texts[i][1], texts[j][1], [(texts[i][2], texts[j][2])], t, least)}
        assert some <= {p for x, y in substring_dedup._asked(laid, group, apart, everyone, everyone, t, least) for p in zip(x.tolist(), y.tolist())}


def test_pairs_are_told_by_longer_surroundings_as_passages_tells_them():
    """Near copies and junk that repeats words: no link is lost, and few pairs without one are left to verify."""
    rng, t, percent = random.Random(22), 46, 80
    reach, texts = substring_dedup._reach(t, percent), []
    for group in range(12):
        base = [rng.randrange(1, 10**6) for _ in range(260)]
        for number in range(12):
            own, place = list(base), 110
            if group % 3 == 2:  # a run of one shingle between others
                size = rng.choice([43, 44, 47, 60, 150])
                own = [rng.randrange(1, 10**6) for _ in range(110)] + [7] * size + (base if number % 4 == 0 else [rng.randrange(1, 10**6) for _ in range(90)])
            for _ in range(rng.randrange(0, 30)):
                at = rng.randrange(len(own))
                if at != place and rng.random() < 0.8:
                    own[at] = rng.randrange(1, 10**6)
                elif at > place + 8:
                    own.insert(at, 7)
            texts.append((group, np.array(own, dtype=np.uint64), place))
    near = [(v[c - reach:c + reach + 1].astype(substring_dedup._SHINGLE).tobytes(), reach) for _, v, c in texts]
    laid = substring_dedup._laid(*zip(*near), reach, substring_dedup._SHINGLE)
    group, apart, everyone = np.array([g for g, _, _ in texts]), np.arange(len(texts)), np.ones(len(texts), bool)
    links = {(i, j) for i in range(len(texts)) for j in range(i) if texts[i][0] == texts[j][0]
             and substring_dedup.passages(texts[i][1], texts[j][1], [(texts[i][2], texts[j][2])], t, percent)}
    for apart in (apart, np.arange(len(texts)) // 3):  # alone, and in parts
        wanted = {(i, j) for i, j in links if apart[i] != apart[j]}
        got = [p for x, y in substring_dedup._asked(laid, group, apart, everyone, everyone, t, percent) for p in zip(x.tolist(), y.tolist())]
        assert wanted <= set(got) and len(got) == len(set(got)) < 1.1 * len(wanted) + 10 and len(wanted) > 100


@pytest.mark.parametrize("given", [{}, {"large": 2}])
def test_junk_that_repeats_a_word_is_not_compared_all_with_all(spark, monkeypatch, given):
    """Runs of a word too short for a passage, between other words: all have the same key, and no two have a link."""
    rng, asked, real = random.Random(4), [], substring_dedup.written

    def some(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    texts = [" ".join(some(60) + ["the"] * (45 + i % 4) + some(60)) for i in range(80)]
    texts += [" ".join(some(60) + ["the"] * 70 + some(60)) for _ in range(20)]

    def counted(df, *by):
        out = real(df, *by)
        asked.append(out.selectExpr("coalesce(sum(size(met)), 0)").first()[0] if "met" in out.columns else 0)
        return out

    monkeypatch.setattr(substring_dedup, "written", counted)
    rows = substring_dedup.repeated_passages(frame(spark, texts).repartition(3), **given).collect()
    found = components(range(len(texts)), [(r.doc_id, r.source_id) for r in rows])
    assert len(set(found.values())) == 81 and len({found[i] for i in range(80, 100)}) == 1
    assert sum(asked) < 8 * len(texts)


def test_second_meeting_writes_few_rows_and_links_the_same_in_keys_of_any_size(spark, monkeypatch):
    """Near copies whose edits leave each key's first without some: no table has a row for each window and shingle."""
    rng, texts = random.Random(9), []
    for _ in range(3):
        base = [f"u{rng.randrange(10**6)}" for _ in range(260)]
        for _ in range(25):
            own = list(base)
            for _ in range(22):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    tables, real = [], substring_dedup.written

    def counted(df, *by):
        tables.append(real(df, *by))
        return tables[-1]

    monkeypatch.setattr(substring_dedup, "written", counted)

    def places(**given):
        """Connected places of texts: links by document and word, ten words to a place."""
        tables.clear()
        rows = substring_dedup.repeated_passages(frame(spark, texts).repartition(3), **given).collect()
        links = [((r.doc_id, (r.start + x) // 10), (r.source_id, (r.source_start + x) // 10)) for r in rows for x in range(0, r.size, 10)]
        named = components({p for link in links for p in link}, links)
        return {frozenset(p for p in named if named[p] == n) for n in set(named.values())}, [x.count() for x in tables]

    (parts, sizes), (others, old) = places(), places(large=2)
    assert {frozenset(d for d, _ in p) for p in parts} == {frozenset(d for d, _ in p) for p in others}
    windows = next(x.count() for x in tables if "around" in x.columns)
    assert max(old) > 10 * windows > 2 * max(sizes)


def test_passages_of_large_keys_are_linked_as_those_of_small_ones(spark):
    rng, texts, pairs = random.Random(8), [], []

    def some(n):
        return [f"v{rng.randrange(10**6)}" for _ in range(n)]

    for _ in range(150):
        whole = some(50)
        pairs += [(len(texts), len(texts) + 1), (len(texts), len(texts) + 2)]
        texts += [" ".join(some(20) + part + some(20)) for part in (whole, whole[:45], whole[5:])]
    found = {tuple(sorted((r.doc_id, r.source_id))) for r in substring_dedup.repeated_passages(frame(spark, texts), large=2).collect()}
    assert [p for p in pairs if p not in found] == []


def test_a_block_of_pairs_gets_each_of_its_texts_once(spark, monkeypatch):
    """All pairs of 40 texts of a key name 1560 texts; 40 go to the workers, or some more in small blocks."""
    texts = [prose(i, 60) for i in range(40)]
    table = spark.createDataFrame([(i, i, t, None, len(t)) for i, t in enumerate(texts)], "uid bigint, doc_id bigint, text string, places string, bytes int")
    pairs = spark.createDataFrame([(7, a, b, 0, 0) for a in range(40) for b in range(a)] * 2, "key bigint, a bigint, b bigint, ca bigint, cb bigint")
    real = substring_dedup._verify

    def counted(*given):
        import pyarrow as pa

        def run(pairs, texts):
            out = real(*given)(pairs, texts)
            assert out.num_rows == pairs.num_rows  # judged once each
            sizes = [pairs.num_rows, texts.num_rows, sum(len(x) for x in texts.column("text").to_pylist()), 0, 0]
            return pa.table([*(pa.array([x], pa.int64()) for x in sizes), pa.array([False]), *(c.slice(0, 1) for c in out.columns[6:])], names=out.column_names)
        return run

    monkeypatch.setattr(substring_dedup, "_verify", counted)
    link = "doc_id bigint, start bigint, size bigint, source_id bigint, source_start bigint, source_size bigint, similarity double"
    whole = substring_dedup._verified(pairs, table, 46, 80, 5, link).collect()
    assert [(r.key, r.a) for r in whole] == [(780, 40)]
    monkeypatch.setattr(substring_dedup, "_BLOCK", 20 * len(texts[0]))
    parts = substring_dedup._verified(pairs, table, 46, 80, 5, link).collect()
    assert sum(r.key for r in parts) == 780 and len(parts) > 10 and sum(r.a for r in parts) < 1000
    assert max(r.b for r in parts) < substring_dedup._BLOCK + 2 * max(map(len, texts))


def test_passages_do_not_depend_on_blocks(spark, monkeypatch):
    rng, texts = random.Random(12), []
    for _ in range(2):
        base = [f"u{rng.randrange(10**6)}" for _ in range(200)]
        for _ in range(10):
            own = list(base)
            for _ in range(5):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    docs = frame(spark, texts).repartition(3)
    found = set(map(tuple, substring_dedup.repeated_passages(docs).collect()))
    monkeypatch.setattr(substring_dedup, "_BLOCK", 1 << 14)
    assert len({(r[0], r[3]) for r in found}) >= 18
    named = [components(range(len(texts)), [(r[0], r[3]) for r in x]) for x in (found, substring_dedup.repeated_passages(docs).collect())]
    assert named[0] == named[1]


def test_values_alike_within_the_drift_equal_brute_force():
    """Also of passages shorter than the drift, as least_words of 8 gives."""
    rng, drift = np.random.default_rng(3), substring_dedup._DRIFT
    for n in (1, 3, 7, 8, 9, 16, 17, 60):
        a, b = (rng.integers(0, n + 4, n).astype(np.uint64) for _ in range(2))
        want = [any(a[i] == b[j] for j in range(max(0, i - drift), min(n, i + drift + 1))) for i in range(n)]
        assert substring_dedup._alike(a, b).tolist() == want
    a = np.arange(1, 6, dtype=np.uint64)
    assert substring_dedup.passages(a, a, [(0, 0), (2, 2)], 4, 80) == [(0, 5, 0, 5, 1.0)]


def test_words_put_together_from_letters_and_signs_are_those_of_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, plain = packing._Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(3)
    pieces = ["Don", "t", "'s", "'", "'re", "S", "Straße", "ÜBER", "é", "é", "İ", "ŉ", "×", "µ", "ª", "x1", "2", ".", ",", "!!", "***", "<", "<|endoftext|>",
              "<|startoftext|>", "̸", "-", "_", "@", "\r", "\x0b", "\xa0", " ", "Σ", "ΑΣ", "漢", "`", "~", "\"", "ÿ", "Ÿ", "l", "ll"]
    texts = ["", " ", "it's Don't. 'tis WE'LL!"] + [" ".join("".join(rng.choices(pieces, k=rng.randrange(1, 5))) for _ in range(30)) for _ in range(200)]
    got = encoder(texts)
    assert [list(memoryview(g).cast("I")) for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    asked = []
    known = encoder._spelled
    encoder._spelled = lambda words: asked.extend(words) or known(words)
    encoder(["Zebrafishes zebrafishes, ZEBRAFISHES! zebrafishes..."])
    assert asked == ["zebrafishes"]  # once for all its cases and signs
