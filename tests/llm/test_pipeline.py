"""The pipeline's stages by their contracts, each on its own input."""

from __future__ import annotations

import collections

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from rowcaster.llm.queries import TOKENIZER, tokenizer_path
from rowcaster.session import written
from rowcaster.sources.artifacts import exists

from .fixture import CLASH, collected
from .test_rows import base_brute, bench_items, hits_brute, join_brute, rule_rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    data = rule_rows()
    spark.createDataFrame([(*x, len(x[1] or "")) for x in data], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench_items(data), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, plain = docs.columns, Tokenizer.from_file(tokenizer_path(TOKENIZER))
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "token output"]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
        out = stage(spark, docs, folder).cache()
        if name != "token output":
            assert out.columns == columns
            after = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in out.collect()]
            assert set(after) <= set(before)
            ids = {x[0] for x in after}
        if name == "quality rules":
            assert not any(base_brute(x[1])[-1] for x in after)
            assert set(range(200, 350)) <= ids and not ids & set(range(400, 412))
        elif name == "n-gram Jaccard join":
            groups = {c for i, _, c in join_brute(before, 5, 80, 100)}
            assert len(after) == len(set(after)) and ids - {None} == groups - {None}
        elif name == "benchmark decontamination":
            bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            clean = collections.Counter(x[0] for x in hits_brute(before, bench) if not x[-1])
            assert collections.Counter(x[0] for x in after) == clean
        elif name == "mixing sources":
            times = collections.Counter(after)
            assert max(times.values()) <= 2
        else:
            import zlib

            want = collections.Counter()
            for i, t, *_ in before:
                found = plain.encode(t or "", add_special_tokens=False).ids + [2]
                want[i, len(found), zlib.crc32(np.array(found, "<u4").tobytes())] += 1
            assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out.collect()) == want
        docs = out


def test_run_is_the_stages_in_order(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert collected(got) == collected(corpus_pipeline.run(spark, folder))


def test_stages_on_an_empty_table_and_clashing_columns(spark, folder):
    """An empty table passes through; columns of any name are carried by all stages but the last."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clash = docs.withColumns({c: F.lit(c) for c in [*CLASH, "a b", "_w", "token", "gid", "shard", "part", "tie"]})
    for source in (docs.limit(0), clash):
        columns = source.columns
        for name, stage in corpus_pipeline.STAGES:
            source = stage(spark, source, folder).cache()
            if name != "token output":
                assert source.columns == columns
            if columns == docs.columns:
                assert source.count() == 0
            elif name != "token output":
                assert source.count() > 0 and all(r["a b"] == "a b" and r["uid"] == "uid" for r in source.select("a b", "uid").collect())
        assert source.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_a_stage_removes_what_the_one_before_left(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    first = written(steps["quality rules"](spark, docs, folder), "stage")
    paths = list(corpus_pipeline._made)
    assert paths and all(exists(spark, p) for p in paths)
    kept = written(steps["n-gram Jaccard join"](spark, first, folder), "stage")
    assert kept.count() > 0 and not any(exists(spark, p) for p in paths)
