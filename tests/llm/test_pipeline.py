import random

import pytest

import corpus_pipeline
from pulsegrid.llm import pii


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    base = tmp_path_factory.mktemp("tables")
    item = " ".join(f"q{rng.randrange(300)}" for _ in range(30)) + "."
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(60)) for _ in range(160)]
    texts = [x.upper().replace(" ", "!! ") if i % 4 == 0 else x for i, x in enumerate(texts)]
    texts[101] = texts[102] = texts[3]
    texts[5] += " " + item
    texts[6] += " mail me at some.one@example.org now"
    rows = [(i, x, "en", "s", len(x)) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def test_stages_decide_and_hand_on(spark, tables):
    docs = first = spark.read.parquet(f"{tables}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == first.columns and docs.dtypes == first.dtypes, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        ids.append({r.doc_id for r in docs.collect()})
    good = {i for i in range(160) if i % 4}
    assert ids[0] == good
    assert ids[1] == good - {101, 102}
    assert ids[2] == ids[1] - {5} == ids[3]
    text = {r.doc_id: r.text for r in docs.collect()}
    assert "<email>" in text[6] and "example.org" not in text[6]
    assert pii.digest(docs).where("n_email > 0").count() == 0


def test_run_packs_what_is_left(spark, tables):
    got = corpus_pipeline.run(spark, tables).collect()
    assert {r.doc_id for r in got} == {i for i in range(160) if i % 4} - {101, 102, 5}
    assert all(r.offset + r.length <= 2048 for r in got)


def test_odd_rows_and_empty_tables(spark, tables, tmp_path):
    """Null and repeated ids, null texts, extra columns with clashing names, and empty tables, through all stages."""
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{tables}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    item = spark.read.parquet(f"{tables}/benchmark.parquet").first().text
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, base string, v long"
    rows = [(None, "mail a.b@example.org about it now please"), (None, "mail a.b@example.org about it now please"), (None, item), (4, "one text with some words in it"), (4, "another text of a few words"), (None, None), (5, ""), (6, "one text with some words in it")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "b", 1) for i, t in rows], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        docs = spark.createDataFrame(docs.collect(), schema)
    got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    assert got == sorted([(None, "mail <email> about it now please"), (4, rows[3][1]), (4, rows[4][1]), (None, None), (5, "")], key=str)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 5
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
