"""The pipeline's stages against what each decision means, on the smallest tables."""

import duckdb

import corpus_pipeline as pipeline
from freshet.llm.common import read
from freshet.sources.workspace import stored
from tests.conftest import SF
from tests.llm.test_operators import hits_of, plain_components


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet' where quality is not null").fetchall())
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()

    good = stored(pipeline.keep_quality(spark, docs, SF), "t1")
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == columns
    right = [(i in kept) == (q == 1) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.9

    single = stored(pipeline.drop_near_duplicates(spark, good, SF), "t2")
    rows = [(i, before[i].text, None) for i in sorted(kept)]
    assert single.columns == columns
    assert {r.doc_id for r in single.collect()} == {i for i, _, c in plain_components(rows, pipeline.NEAR_WORDS, 80) if i == c}

    clean = stored(pipeline.drop_benchmark(spark, single, SF), "t3")
    assert clean.columns == columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect() if not hits_of(r.text, items)[4]}

    mixed = stored(pipeline.mix_sources(spark, clean, SF), "t4")
    assert mixed.columns == columns
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert abs(words(mixed.collect()) / words(clean.collect()) - 1) < 0.05

    tokens = pipeline.write_tokens(spark, mixed, SF).collect()
    assert sorted(r.doc_id for r in tokens) == sorted(r.doc_id for r in mixed.collect())


def test_rows_without_id_or_sharing_one(spark):
    passage = duckdb.sql(f"select text from '{SF}/benchmark.parquet' where len(text) > 80 order by item_id limit 1").fetchall()[0][0]
    words = lambda tag: " ".join(f"{tag}{k}" for k in range(40))
    a, b, c, d = (words(x) for x in "abcd")
    rows = [(None, a), (3, a), (3, b), (3, b), (None, c), (None, c), (4, ""), (4, ""), (5, None), (None, None), (4, d), (9, d + " more")]
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    found = lambda out: sorted(((r.doc_id, r.text) for r in out.collect()), key=str)

    single = pipeline.drop_near_duplicates(spark, frame(rows), SF)
    assert single.columns == list(pipeline.COLUMNS)
    assert found(single) == sorted([(3, a), (3, b), (None, c), (4, ""), (5, None), (None, None), (4, d)], key=str)

    dirty = [(None, passage), (7, passage), (7, a), (None, b), (8, None)]
    assert found(pipeline.drop_benchmark(spark, frame(dirty), SF)) == sorted([(7, a), (None, b), (8, None)], key=str)

    mixed = pipeline.mix_sources(spark, frame([(None, a), (None, b), (2, c), (2, d)]), SF)
    assert found(mixed) == sorted([(None, a), (None, b), (2, c), (2, d)], key=str)


def test_run_is_the_stages_in_order(spark):
    assert [name for name, _ in pipeline.STAGES] == ["quality classifier", "near duplicates", "benchmark decontamination", "mixing to target weights", "token output"]
    first = sorted(map(tuple, pipeline.run(spark, SF).collect()))
    assert first and first == sorted(map(tuple, pipeline.run(spark, SF).collect()))
