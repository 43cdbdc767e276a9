"""The pipeline on the given tables, stage by stage against brute force."""

import os
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from helpers import components, edited, frame, prose, shingles

import corpus_pipeline
from adlake.llm import packing

FOLDER = os.environ.get("ADLAKE_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = [texts(docs)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == corpus_pipeline.COLUMNS
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(texts(docs))
    start, good, lines, near, clean = kept
    assert set(start) >= set(good) >= set(lines) >= set(near) >= set(clean) and clean
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert sum(d in good for d, y in labels.items() if y == 1) >= 0.98 * sum(labels.values())

    sets = {d: shingles(t, 5) for d, t in lines.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    names = components(sorted(sets), links)
    assert set(near) == {d for d in sets if names[d] == d}

    items = [shingles(r.text, 5) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    held = {d for d in near if any(i and 100 * len(sets[d] & i) >= 80 * len(i) for i in items)}
    assert set(clean) == set(near) - held

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r.doc_id for r in packed} == set(clean)
    used = defaultdict(int)
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096


def test_lines_stay_in_the_first_document_and_copies_go(spark):
    common = "a line that many documents have in common"
    body = [prose(i, 60) for i in range(15)]
    copied = prose(99, 80)
    docs = frame(spark, [f"{b}\n{common}" for b in body] + [copied] * 12 + [copied + "\n" + prose(7, 4), "", None])
    got = texts(corpus_pipeline.line_dedup(spark, docs, FOLDER))
    assert got[0] == f"{body[0]}\n{common}" and all(got[i] == body[i] for i in range(1, 15))
    assert got[15] == copied and not set(range(16, 27)) & set(got)
    assert got[27] == prose(7, 4)  # the one line of its own stays
    assert got[28] == "" and got[29] is None


def test_own_lines_and_first_occurrences_are_not_lost_with_their_document(spark):
    license = "this line of a license stands in all of them " + prose(98, 20)
    first, late = prose(97, 40), prose(96, 5)
    docs = frame(spark, [license] + [f"{license}\nown{i} words" for i in range(1, 12)]
                 + [f"{license}\n{first}\n{late}" for _ in range(12)] + [f"{license}\n \n"])
    got = texts(corpus_pipeline.line_dedup(spark, docs, FOLDER))
    assert got[0] == license and all(got[i] == f"own{i} words" for i in range(1, 12))
    # The copies' first keeps the lines that it is the first to hold; the others have nothing left.
    assert got[12] == f"{first}\n{late}" and not set(range(13, 25)) & set(got)
    # Most of document 12 is an earlier line, and the one line that it holds first stays too.
    docs = frame(spark, [prose(95, 60)] + [f"{prose(95, 60)}\n{late}"] * 11 + [prose(95, 60)])
    got = texts(corpus_pipeline.line_dedup(spark, docs, FOLDER))
    assert got == {0: prose(95, 60), 1: late}


def test_one_of_each_group_stays(spark):
    base = [prose(i, 90) for i in range(5)]
    docs = frame(spark, base + [edited(b, j, 1) for j, b in enumerate(base)] + base + ["", "", None])
    assert set(texts(corpus_pipeline.near_dedup(spark, docs, FOLDER))) == {0, 1, 2, 3, 4, 15, 16, 17}


def test_packing_leaves_no_tokenizer_with_its_workers(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = pa.array([f"word{i} Word, other{i}." for i in range(300)], pa.large_string())
    keys = pa.array([{"doc_id": i, "row_key": i} for i in range(300)])
    made, given = [], []
    monkeypatch.setattr(packing, "give_back", lambda: given.append(1))
    packing._encoder.cache_clear()
    for remember in (True, False):
        batch = pa.RecordBatch.from_arrays([texts, keys], names=["text", "_key"])
        made.append(pa.Table.from_batches(list(packing._cut(path, 4096, 1, True, remember)([batch]))))
        assert packing._encoder.cache_info().currsize == remember
    assert made[0].equals(made[1]) and len(given) == 2
