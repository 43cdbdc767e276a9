"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names: defined results."""

import itertools
from collections import Counter

import public_tokenizers
import pytest
from helpers import frame, odd_texts
from pyspark.sql import functions as F

import corpus_pipeline
from adlake.llm import bloom_lm, quality
from adlake.llm.decontaminate import contaminated, decontaminate
from adlake.llm.line_dedup import dedup_lines
from adlake.llm.minhash_dedup import near_duplicates
from adlake.llm.order_minhash import edited_likeness, fingerprints
from adlake.llm.packing import pack
from adlake.llm.queries import URL_RULES
from adlake.llm.sharding import shuffle_into_shards
from adlake.llm.substring_dedup import repeated_passages
from adlake.llm.url_filter import judge

TOKENS = public_tokenizers.path("word_bpe_49k.json")
ITEMS = "item_id bigint, text string"
LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_texts(), extra=True).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [], extra=True)


def ids(rows):
    return Counter(r.doc_id for r in rows)


ALL = Counter(i for i, _ in odd_texts())


def test_near_duplicates(spark, odd, none):
    rows = near_duplicates(odd).collect()
    assert ids(rows) == ALL
    own = {(r.doc_id, r.n_shingles): r for r in rows}
    assert all(r.component_id == r.doc_id for r in rows if r.n_shingles == 0)
    assert {r.component_id for r in rows if r.doc_id in (7, 8)} == {7} and {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert {r.component_id for r in rows if r.doc_id == 6} == {6} and own[(9, 1)].component_id == 9
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None and r.n_shingles] == [(None, False)] * 2
    assert near_duplicates(none).collect() == []


def test_passages(spark, odd, none):
    assert {(min(r.doc_id, r.source_id), max(r.doc_id, r.source_id)) for r in repeated_passages(odd).collect()} == {(7, 8)}
    assert repeated_passages(none).collect() == []


def test_containment(spark, odd, none):
    items = spark.createDataFrame([(1, "b c d e f"), (1, "b c d e f"), (2, None), (None, "lost words here"), (3, ""), (4, "one")], ITEMS)
    found = Counter((r.doc_id, r.item_id) for r in contaminated(odd, items).collect())
    assert found == {(6, 1): 2, (None, None): 2, (4, 4): 1, (5, 4): 1}
    assert ids(decontaminate(odd, items).collect()) == ALL - Counter({6: 2, None: 2, 4: 1, 5: 1})
    assert decontaminate(odd, items).columns == odd.columns
    assert contaminated(none, items).collect() == [] and contaminated(odd, items.limit(0)).collect() == []
    assert decontaminate(odd, items.limit(0)).count() == odd.count()


def test_urls(spark):
    pages = spark.createDataFrame([(None, None, "x", 1.0), (1, "", None, 2.0), (1, "http://a.net/" + "x" * 100_000, "y", 3.0), (2, "http://a.net/", "z", 4.0),
                                   (2, "http://a.net/", "z", 4.0)], "page_id bigint, url string, host string, score double")
    rows = judge(pages, URL_RULES).collect()
    assert Counter((r.page_id, r.rule, r.verdict) for r in rows) == {
        (None, None, "allow"): 1, (1, None, "allow"): 1, (1, "net/", "block"): 1, (2, "net/", "block"): 2}
    assert judge(pages.limit(0), URL_RULES).collect() == [] and judge(pages, []).count() == 5


def test_language_model(spark, odd, none):
    rows = bloom_lm.score(odd, bloom_lm.train(odd)).collect()
    assert ids(rows) == ALL and all(r.n_known == r.n_tokens and r.score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    untrained = bloom_lm.score(odd, bloom_lm.train(none)).collect()
    assert ids(untrained) == ALL and all(r.n_known == 0 == r.train_tokens for r in untrained)
    assert all(r.base_score == pytest.approx(0) for r in untrained)  # one unknown word of one
    assert bloom_lm.score(none, bloom_lm.train(odd)).collect() == []
    assert len({(r.base_score, r.score) for r in rows if r.doc_id == 6}) == 2


def test_packing(spark, odd, none):
    rows = pack(odd, TOKENS).collect()
    assert {i: n for i, n in ids(rows).items() if i not in (7, 8, 9)} == {i: n for i, n in ALL.items() if i not in (7, 8, 9)}
    assert {r.length for r in rows if r.doc_id in (1, 2, 3)} == {1} and max(r.length for r in rows) == 4096
    for own in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in own[1]:
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert pack(none, TOKENS).collect() == []


def test_lines(spark, odd, none):
    rows = dedup_lines(odd, min_docs=2).collect()
    assert Counter(r.row.doc_id for r in rows) == ALL and set(rows[0].row.asDict()) == set(odd.columns)
    kept = {(r.row.doc_id, r.row.text): (r.n_lines, r.n_dropped, r.kept_text) for r in rows}
    assert kept[1, None] == (1, 0, "") and kept[4, "one"] == (1, 0, "one") and kept[5, "ONE"] == (1, 1, "")
    assert [kept[i, odd_texts()[11][1]][1] for i in (7, 8)] == [0, 1] and kept[6, "a b c d e f"][1] == 0
    assert kept[12, "x\n" * 500] == (501, 0, "x\n" * 500)
    assert dedup_lines(none).collect() == []


def test_shards(spark, odd, none):
    rows = shuffle_into_shards(odd, shards=4).collect()
    assert Counter(r.row.doc_id for r in rows) == ALL and sorted(r.place for r in rows) == list(range(len(rows)))
    assert shuffle_into_shards(none).collect() == []
    assert {(r.shard, r.slot) for r in shuffle_into_shards(odd.limit(1), shards=8).collect()} == {(0, 0)}


def test_fingerprints(spark, odd, none):
    distinct = len(set(odd_texts()))
    rows = edited_likeness(odd).collect()
    assert len(rows) == distinct == fingerprints(odd).count()
    by = {(r.doc_id, r.n_chars): r for r in rows}
    assert by[2, 0].fingerprint == by[1, 0].fingerprint == "" and by[2, 0].near_edited == 1 == by[2, 0].near_next
    assert len({r.fingerprint for r in rows if r.doc_id in (7, 8)}) == 1
    assert edited_likeness(none).collect() == [] and fingerprints(none).collect() == []
    alone = edited_likeness(frame(spark, ["only one text"])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1


def test_quality(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 1), (10, 0, 0), (11, 0, 1), (11, 1, 0), (12, None, None), (None, 1, 0), (99, 1, 1)], LABELS)
    rows = quality.score(odd, quality.train(odd, labels)).collect()
    assert Counter(r.row.doc_id for r in rows) == ALL and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.row.doc_id in (1, 2, None) and not r.row.text}) == 1
    assert {round(r.score, 6) for r in quality.score(odd, quality.train(odd, labels.limit(0))).collect()} == {0.5}
    assert quality.score(none, quality.train(none, labels)).collect() == []


# --- stages -------------------------------------------------------------------

@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (10, 0, 0), (12, None, 1)], LABELS).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "b c d e f"), (None, None)], ITEMS).write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stage_returns_documents(spark, odd, none, folder, name, stage):
    out = stage(spark, odd, folder)
    assert out.dtypes == odd.dtypes
    rows = out.collect()
    assert not ids(rows) - ALL
    assert stage(spark, none, folder).collect() == [] and stage(spark, none, folder).dtypes == odd.dtypes


def test_stages_keep_and_drop(spark, odd, folder):
    lines = ids(corpus_pipeline.line_dedup(spark, odd, folder).collect())
    assert lines == ALL  # no line is in ten documents
    near = ids(corpus_pipeline.near_dedup(spark, odd, folder).collect())
    assert near == ALL - Counter({5: 1, 6: 1, 8: 1, None: 1})
    clean = ids(corpus_pipeline.decontamination(spark, odd, folder).collect())
    assert clean == ALL - Counter({6: 2})


def test_pipeline_on_odd_and_empty_tables(spark, folder, none, tmp_path):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and {r.doc_id for r in rows} <= set(ALL)
    path = str(tmp_path / "empty")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    none.write.parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.run(spark, path).collect() == []
