"""Nulls, empty and long texts, ties, repeated rows, clashing names and empty tables, for every operator and stage."""

import hashlib

import pytest

import corpus_pipeline
from urbandemand.llm.decontamination import decontaminate
from urbandemand.llm.exact_dedup import exact_dedup
from urbandemand.llm.katz import score_katz
from urbandemand.llm.language import fit_languages, identify_language
from urbandemand.llm.mixing import mix_sources
from urbandemand.llm.near_dedup import near_duplicates
from urbandemand.llm.pii import find_personal_data
from urbandemand.llm.quality import fit_quality, score_quality
from urbandemand.llm.secret_scan import scan_secrets
from urbandemand.llm.toxicity import fit_toxicity, score_toxicity

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, kept string, name string, score string, place string, digest string, rep string, sig string, copy_no int, its_id string, its_sha string, its_mark string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
ROWS = [
    (1, WORDS, "en", "a"),
    (2, WORDS, "en", None),
    (2, WORDS, "en", None),
    (3, None, None, "a"),
    (4, "", "de", "b"),
    (5, "word " * 30_000, "en", "b"),
    (None, "no id at all, with a password=abcdefgh123", None, None),
    (6, "ÉÉ \U0001f600 mail a.b@c.de +1 (602) 555-9039 token = \"0123456789abcdef0123456789abcdef\"", "fr", "c"),
    (7, WORDS.replace("upsilon", "omega"), "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "k", "n", "s", "p", "d", "r", "g", 9, "i", "h", "m") for i, t, g, s in ROWS], CLASHING)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (99, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, WORDS), (2, "mu nu xi"), (3, None), (4, ""), (None, WORDS), (1, WORDS)], "item_id long, text string")


def run(spark, docs, labels, items):
    return {
        "decontaminate": lambda: decontaminate(docs, items),
        "decontaminate_near": lambda: decontaminate(docs, items, slop=2),
        "near": lambda: near_duplicates(docs),
        "secrets": lambda: scan_secrets(docs),
        "language": lambda: identify_language(docs, fit_languages(docs)),
        "exact": lambda: exact_dedup(docs, 64),
        "quality": lambda: score_quality(docs, fit_quality(docs, labels)),
        "mixing": lambda: mix_sources(docs),
        "katz": lambda: score_katz(docs),
        "pii": lambda: find_personal_data(docs),
        "toxicity": lambda: score_toxicity(docs, fit_toxicity(docs, labels)),
    }


NAMES = ["decontaminate", "decontaminate_near", "near", "secrets", "language", "exact", "quality", "mixing", "katz", "pii", "toxicity"]


@pytest.mark.parametrize("name", NAMES)
def test_each_row_has_a_result(spark, docs, labels, items, name):
    out = run(spark, docs, labels, items)[name]().collect()
    if name == "mixing":
        copies = {}
        for r in out:
            copies.setdefault((r.doc_id, r.text, r.source), []).append(r.copy_no)
        assert all(r.n_copies >= r.copy_no >= 1 for r in out)
    else:
        assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, docs, labels, items, name):
    assert run(spark, docs.limit(0), labels.limit(0), items.limit(0))[name]().count() == 0


def test_exact_groups(spark, docs):
    got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs, 16).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1, sha(WORDS)] == (2, 3, False)
    assert got[2, sha(WORDS)] == (2, 3, True)
    assert got[3, sha("")] == (4, 2, False)
    assert got[4, sha("")] == (4, 2, True)
    assert got[None, sha(ROWS[6][1])] == (None, 1, True)


def test_exact_repeats_of_several_blocks(spark):
    """Rows that repeat a doc_id and text are copies at every number of blocks, as in the SQL."""
    texts = {n: "".join(f"{n}.{i} " for i in range(4000))[:n] for n in (1000, 1024, 1025, 2500, 9000)}
    rows = [(n, t) for n, t in texts.items() for _ in range(2 if n < 9000 else 3)] + [(None, "no id " + texts[2500])] * 2 + [(5, "alone " + texts[9000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).collect())
    size = {i: sum(j == i for j, _ in rows) for i, _ in rows}
    assert got == sorted((str(i), i, size[i], True) for i, _ in rows)
    left = corpus_pipeline.exact_dedup(spark, docs, "")
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, size))


def test_exact_repeats_that_differ_elsewhere(spark):
    """Of rows that repeat a doc_id and text the first by its columns' JSON stays; null is the empty text."""
    rows = [(1, None, "b", 2), (1, "", "a", 1), (2, "x y", "c", 3), (2, "x y", "b", 9), (2, "x y", "b", 4), (3, "z", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, its_id string, row int")
    got = sorted(tuple(r) for r in corpus_pipeline.exact_dedup(spark, docs, "").collect())
    assert got == [(1, "", "a", 1), (2, "x y", "b", 4), (3, "z", None, None)]


def test_near_groups(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got[1] == (16, 1, True)
    assert got[2] == (16, 1, False)
    assert got[7] == (16, 1, False)  # 15 of 17 shingles are common
    assert got[3] == (0, 3, True) and got[4] == (0, 4, True)
    assert got[None][1] is None and got[None][2]
    assert got[5][0] == 1


def test_decontamination(spark, docs, items):
    got = {r.doc_id: r for r in decontaminate(docs, items).collect()}
    assert got[1].items == ["1", "2"] and got[1].n_hit == 20
    assert got[7].items == ["1", "2"] and got[7].n_hit == 19
    assert not got[5].contaminated and got[5].n_words == 30_000
    assert got[3].n_words == 0 and got[3].items_sha256 == hashlib.sha256(b"").hexdigest()


def test_spans_count_code_points(spark, docs):
    text = ROWS[7][1]
    r = next(r for r in find_personal_data(docs).collect() if r.doc_id == 6)
    assert f"email:{text.index('a.b@')}:{text.index('a.b@') + 8}" in r.spans and r.n_phone == 1
    s = next(r for r in scan_secrets(docs).collect() if r.doc_id == 6)
    assert (s.n_assign, s.n_hex) == (1, 1)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, labels, items, tmp_path, name, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, docs, str(tmp_path))
    got = out.collect()
    if name != "mixing":
        assert out.columns == docs.columns
    ids = [r.doc_id for r in got]
    if name == "exact_dedup":
        assert sorted(str(i) for i in ids) == ["2", "4", "5", "6", "7", "None"]
    if name == "near_dedup":
        assert sorted(str(i) for i in ids) == ["1", "3", "4", "5", "6", "None"]
    if name == "decontamination":
        assert sorted(str(i) for i in ids) == ["3", "4", "5", "6", "None"]
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
