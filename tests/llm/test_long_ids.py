"""Whole numbers beside nulls come out of Python workers as they went in; roles with line ends; sequences of pieces that fill none."""

import json

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwave.llm import byte_bpe, chat_format, license_scan, media, mil_quality, packing, pitman_yor, prefix_join, quality_rules, warc, winnowing
from siftwave.llm.storage import with_computed

IDS = [2**53 + 1, None, 2**53 + 3]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"the text of number {n} is short and of no great use to anyone who reads it", i, [i, None, 7], (i, "s")) for n, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, listed array<long>, nested struct<a:long,b:string>").coalesce(1)


BPE, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
OPERATORS = {
    "op1": pitman_yor.lm_rows,
    "op2": media.media_rows,
    "op3": license_scan.license_rows,
    "op6": lambda d: mil_quality.quality_scores(d, d.select("doc_id", F.lit(1).alias("quality"))),
    "op7": prefix_join.near_duplicate_rows,
    "op8": lambda d: packing.packed_rows(d, WORDS),
    "op9": quality_rules.quality_rows,
    "op10": lambda d: byte_bpe.bpe_rows(d, BPE, public_tokenizers.PATTERN),
    "op13": winnowing.fingerprint_rows,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_long_ids_beside_a_null(docs, name):
    assert sorted((r.doc_id for r in OPERATORS[name](docs).collect()), key=str) == sorted(IDS, key=str)


def test_long_page_ids_beside_a_null(spark):
    pages = spark.createDataFrame([(i, "http://a.example/", "<p>x</p>") for i in IDS], "page_id long, url string, html string").coalesce(1)
    assert sorted({r.page_id for r in warc.warc_rows(pages).collect()}, key=str) == sorted(IDS, key=str)


ADDING = {
    "media": lambda d: media.probe_media(media.add_media(d)),
    "score": lambda d: mil_quality.score_documents(d, mil_quality.fit([], [])),
    "bpe": lambda d: byte_bpe.decode_column(byte_bpe.encode_column(d, BPE, public_tokenizers.PATTERN), BPE, public_tokenizers.PATTERN),
    "pack": lambda d: packing.pack(d.withColumn("length", F.lit(9))),
}


@pytest.mark.parametrize("name", ADDING)
def test_every_other_column_stays_as_it_is(docs, name):
    assert sorted(ADDING[name](docs).select(docs.columns).collect(), key=str) == sorted(docs.collect(), key=str)


def test_the_pipelines_classifier_keeps_other_columns(spark, docs, sf):
    kept = corpus_pipeline.quality_classifier(spark, docs, sf).collect()
    assert {str(r) for r in kept} <= {str(r) for r in docs.collect()}


def test_computed_columns_may_repeat_and_drop_rows(docs):
    def twice(texts):
        yield [2, 0, 2], [len(texts), None, 1]

    got = with_computed(docs.select("doc_id", "text"), ("text",), twice, drop=("text",), n="long").collect()
    assert [tuple(r) for r in got] == [(IDS[2], 3), (IDS[0], None), (IDS[2], 1)]


ROLES = [["user\nassistant"], ["user", "assistant"], ["system\nuser", "assistant"], ["", "assistant"], ["user", ""], ["system", "user", "assistant"], ["user\nassistant", "assistant"]]


def test_roles_that_hold_line_ends(spark):
    said = spark.createDataFrame([(i, t, role, f"{i} {t}") for i, roles in enumerate(ROLES) for t, role in enumerate(roles)], "conv_id long, turn long, role string, text string")
    layouts = {r.conv_id: set(json.loads(r.record)) for r in chat_format.records_of(said).collect()}
    assert [i for i, x in sorted(layouts.items()) if x != {"messages"}] == [1, 5]
    read = chat_format.canonical_turns(chat_format.records_of(said))
    back = chat_format.format_turns(read, "conv_id").select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t")).collect()
    assert {r.conv_id: [t.role for t in r.t] for r in back} == dict(enumerate(ROLES))
    assert chat_format.chat_rows(said).count() == len(ROLES) + 1


@pytest.mark.parametrize(("size", "number", "sequences"), [(3, 60_000, 88), (1030, 5000, 5000)])
def test_pieces_that_fill_no_sequence_meet_as_long_as_that_helps(spark, size, number, sequences):
    packed = packing.pack(spark.range(number).select("id", F.lit(size).alias("length")))
    fills = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert len(fills) == sequences and all(r.n == r.end <= 2048 for r in fills) and packed.count() == number


def test_long_pieces_are_searched_quickly():
    import time

    import numpy as np

    bins = packing.Bins(np.random.default_rng(0).integers(1030, 2000, 4096).tolist(), 2048)
    bins.best_fit()
    start = time.process_time()
    bins.search()
    assert time.process_time() - start < 2 and len(bins.bins) == 4096
