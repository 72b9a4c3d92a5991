"""Queries against their SQL in another engine; the pipeline against its parts and a brute-force version."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from urbandemand.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, (tuple(r[i] for i in place) for r in want.fetchall())))


def test_pipeline_composes(spark):
    """What comes out is what each operator's own result keeps of its input."""
    from pyspark.sql import functions as F

    from urbandemand.llm.common import stored
    from urbandemand.llm.decontamination import decontaminate
    from urbandemand.llm.exact_dedup import exact_dedup
    from urbandemand.llm.near_dedup import near_duplicates
    from urbandemand.llm.quality import fit_quality, score_quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    keep = score_quality(docs, fit_quality(docs, labels)).filter("predicted = 1").select("doc_id")
    docs = stored(docs.join(keep, "doc_id", "left_semi"), "t")
    docs = stored(docs.join(exact_dedup(docs).filter("kept").select("doc_id"), "doc_id", "left_semi"), "t")
    docs = stored(docs.join(near_duplicates(docs).filter("kept").select("doc_id"), "doc_id", "left_semi"), "t")
    docs = stored(docs.join(decontaminate(docs, items).filter("not contaminated").select("doc_id"), "doc_id", "left_semi"), "t")
    out = corpus_pipeline.run(spark, SF)
    assert out.join(docs, "doc_id", "left_anti").count() == 0
    want = corpus_pipeline.mixing(spark, docs, SF).select("doc_id", "n_copies", "copy_no", "shuffle_key")
    assert sorted(map(tuple, out.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert out.select(F.count_distinct("shuffle_key")).first()[0] == out.count()


def test_pipeline_against_brute_force(spark):
    """The five stages in plain Python over all documents; the copies come from the mixing's SQL."""
    import re

    from urbandemand.llm.quality import THRESHOLD, fit_quality

    from .test_methods import _components

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_quality(frame, spark.read.parquet(f"{SF}/labels.parquet"))
    text = {r.doc_id: r.text or "" for r in frame.collect() if model.score(r.text) >= THRESHOLD}
    last = {t: d for d, t in sorted(text.items())}
    text = {d: t for t, d in last.items()}
    text = {d: text[d] for d, (_, least) in _components(text).items() if d == least}
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = cut(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}

    def clean(t):
        w = cut(t)
        return not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    kept = [d for d, t in text.items() if clean(t)]
    assert len(kept) < len(text) < len(last)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet' where doc_id in ({','.join(map(str, kept))})")
    want = con.sql(f"select doc_id, n_copies, copy_no, shuffle_key from ({queries.ORACLE_SQL['op7_mixing']})").fetchall()
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_copies", "copy_no", "shuffle_key").collect()]
    assert sorted(got) == sorted(want)
