"""The pipeline against its stages done plainly, and each stage on odd rows."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from memgrid.llm import bpe, language_id, secret_scan
from memgrid.llm.common import read, scratch, stored, written
from tests.llm.cases import odd, odd_rows
from tests.llm.test_native import plain_pairs
from tests.llm.test_near_duplicates import plain_classes


def test_pipeline_equals_plain_version(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = language_id.train_on(docs)
    rows = [(d, t) for d, t in docs.select("doc_id", "text").collect() if not model.judge(t)[2]]
    rows = [(d, t) for (d, t), c in zip(rows, plain_classes(rows)) if c == d]
    items = [tuple(r) for r in read(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    leaks = {p[0] for p in plain_pairs(rows, items)}
    assert leaks
    rows = [(d, secret_scan.masked(t, secret_scan.scanner(public_tokenizers.path(bpe.RANKS), secret_scan.CHARS_PER_TOKEN).spans(t)[1])) for d, t in rows if d not in leaks]
    b = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Bpe(public_tokenizers.path(bpe.RANKS)).ranks, special_tokens={})
    want = []
    for d, t in rows:
        ids = np.array(b.encode_ordinary(t), "<u4")
        want.append((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(want)


HELPERS = ("h", "doc", "n", "__key", "__doc", "__node", "__n", "__h", "h_doc")


def test_stages_on_odd_rows(spark, sf_dir):
    """Each stage's own rule on nulls, empty and long texts, ties, repeats and clashing names; extra columns come through."""
    docs = odd(spark).withColumns({c: F.lit("clash") for c in HELPERS})
    ids = [r[0] for r in odd_rows()]
    want = {
        "decontamination": ids,
        "secrets": ids,
        "tokens": ids,
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        got = sorted((r.doc_id for r in rows), key=str)
        if name == "language":
            assert not {0, 1, 2} & set(got) and None in got and set(got) <= set(ids)
        elif name == "near_dedup":
            texts = [r.text for r in rows]
            assert texts.count(None) == 2 and len([t for t in texts if t]) == len({r[1] for r in odd_rows() if r[1] and r[1].strip()}) + 1
            assert sum(r.doc_id == 4 for r in rows) == 1 and 5 not in got and 10 not in got
        else:
            assert got == sorted(want[name], key=str)
        if name != "tokens":
            assert out.columns == docs.columns and all(r[c] == "clash" for r in rows for c in HELPERS)
        assert stage(spark, docs.where("false"), sf_dir).collect() == []


def test_tables_on_the_way_are_emptied(spark):
    with scratch():
        a = written(spark.range(50).toDF("x"), "test")
        b = stored(a.selectExpr("x + 1 as x"), "test")
    assert b.count() == 50
    assert spark.read.schema("x long").parquet(a.inputFiles()[0].rsplit("/", 1)[0]).count() == 0
