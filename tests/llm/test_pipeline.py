"""The pipeline's stages, one after another, against plain versions."""

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from samples import prose
from test_operators import check_packing

ITEMS = [(0, prose(900, 30)), (1, prose(901, 13)), (2, None)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    base = prose(7, 150).split()
    texts = [f"{prose(k, 60 + k)}\nA shared   footer line\n{prose(k + 400, 30)}" for k in range(14)]
    texts += [" ".join([*base[:k], "edit", *base[k + 1 :]]) for k in (20, 70, 90)] + [" ".join(base)] * 2
    texts += [f"{prose(50 + k, 40)} {ITEMS[k][1]}" for k in (0, 1)] + [None, "", "too short", "again and again " * 60, prose(3, 4000)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    at = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def plainly(docs):
    """{doc_id: text} before packing."""
    docs = {i: t for i, t in docs.items() if not brute.quality(t)[-1] and brute.compression_kept(t)}
    common = [k for k, n in brute.line_counts(docs.values()).items() if n >= 10]
    docs = {i: "\n".join(x for x in t.split("\n") if brute.line_key(x) not in common) for i, t in docs.items()}
    found = brute.components(list(docs.items()))
    docs = {i: t for i, t in docs.items() if found[i][1] == i}
    return {i: t for i, t in docs.items() if not brute.contamination(t, ITEMS)[-1]}


def test_stages_equal_plain_versions(spark, sf_dir, tmp_path):
    first = docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in first.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.dtypes == first.dtypes
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert kept == plainly(texts) and 10 < len(kept) < len(texts) - 8
    assert docs.filter(F.length("text") != F.col("n_chars")).count() == 0
    ids = sorted(kept)
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    place = {i: n for n, i in enumerate(ids)}
    renamed = [type(r)(**{**r.asDict(), "doc_id": place[r.doc_id]}) for r in packed]
    check_packing(renamed, [kept[i] for i in ids])


def test_near_stage_takes_five_words_and_four_fifths(spark):
    """Edits so far apart that a pair's similarity is on either side of the bounds of the stage and of op8."""
    texts = []
    for seed, edits in ((1, 3), (2, 4), (3, 5), (4, 6), (5, 7)):
        base = prose(seed, 240).split()
        texts += [" ".join(base), " ".join(f"edit{k}" if k % 30 == 10 and k // 30 < edits else w for k, w in enumerate(base))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def likeness(a, b):
        a, b = brute.shingles(a, 5), brute.shingles(b, 5)
        return len(a & b) / len(a | b)

    want = {2 * k for k in range(5)} | {2 * k + 1 for k in range(5) if likeness(texts[2 * k], texts[2 * k + 1]) < 0.8}
    assert 5 < len(want) < 10
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want


def test_repeated_null_and_clashing_rows(spark, sf_dir, tmp_path):
    """Other texts of an id, null ids and columns named like the stages' own survive all stages; an empty table too."""
    a, b, c, d = (prose(700 + k, 60) for k in range(4))
    texts = [(1, a), (2, a), (2, b), (3, c), (3, d), (None, d), (None, prose(710, 60)), (4, f"{prose(711, 20)} {ITEMS[0][1]}"), (4, prose(712, 60)), (5, None), (None, "")]
    rows = [(i, t, "en", "s", len(t or ""), k, "x") for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component long, text_key string")
    left = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, left, sf_dir).write.parquet(f"{tmp_path}/{k}")
        left = spark.read.parquet(f"{tmp_path}/{k}")
        assert left.dtypes == docs.dtypes
    assert sorted(r.component for r in left.collect()) == [0, 2, 3, 4, 6, 8]
    packed = corpus_pipeline.STAGES[-1][1](spark, left, sf_dir).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in packed if r.piece == 0 and r.doc_id is not None) == [(False, i) for i in (1, 2, 3, 3, 4)]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
        assert empty.count() == 0
