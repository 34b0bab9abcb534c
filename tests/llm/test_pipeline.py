"""The pipeline against the stages' brute-force versions, and the SQL of the queries."""

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_text_operators import DIRECTORY, brute_copies, brute_exact, brute_near
from tools_check import rows_of
from tracegraph.llm.queries import ORACLES, QUERIES
from tracegraph.llm.tables import table


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, key):
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIRECTORY}/{name}.parquet'")
    df, cur = QUERIES[key](spark, DIRECTORY), con.execute(ORACLES[key])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_stages(spark):
    docs = table(spark, DIRECTORY, "documents")
    rows, columns = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], docs.columns
    texts = dict(rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, DIRECTORY)
        got = docs.toPandas()
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        if k < 4:
            assert docs.columns == columns, name
        if k == 0:
            assert set(got.doc_id) == ids
        elif k == 1:
            assert set(got.doc_id) == {r[0] for r in brute_exact([(i, texts[i]) for i in ids]) if r[3]}
        elif k == 2:
            first = {r[0] for r in brute_near([(i, texts[i]) for i in ids]) if r[0] == r[2]}
            assert set(got.doc_id) == first - brute_copies([(i, texts[i]) for i in ids])
        elif k == 3:
            items = [r.text for r in table(spark, DIRECTORY, "benchmark").collect()]
            holds = {i for i in ids if any(item in texts[i] for item in items)}
            assert holds and not holds & set(got.doc_id) and len(ids - set(got.doc_id)) <= len(holds) + 3
        else:
            plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert got.groupby("doc_id").length.sum().to_dict() == {i: len(plain.encode(texts[i], add_special_tokens=False).ids) + 1 for i in ids}


def test_run(spark):
    assert corpus_pipeline.run(spark, DIRECTORY).count() > 100


def test_run_leaves_no_near_copies(spark):
    kept = {r.doc_id for r in corpus_pipeline.run(spark, DIRECTORY).select("doc_id").distinct().collect()}
    rows = [(r.doc_id, r.text) for r in table(spark, DIRECTORY, "documents").collect() if r.doc_id in kept]
    assert rows and not brute_copies(rows)
