"""Queries that SQL can state, against their SQL on the sf0.01 tables; and all names are registered."""

import os

import duckdb
import pytest

from crownlake.llm import queries as Q

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    df = Q.queries()[name](spark, DATA)
    other = con.sql(Q.oracle_sql()[name])
    place = [list(other.columns).index(c) for c in df.columns]
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted((tuple(r[k] for k in place) for r in other.fetchall()), key=str)


def test_ten_operators_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_segmentations_cover_whole_documents(spark, tmp_path):
    from cases import documents

    from crownlake.llm.queries import op7_gumbel_segmentations, tokenizer_file
    from crownlake.llm.sampling import Sampler

    texts = {1: "a short text", 2: "many words in one long text " * 400, 3: "a short text"}
    documents(spark, list(texts.items())).write.parquet(str(tmp_path / "documents.parquet"))
    rows = op7_gumbel_segmentations(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r["rank"]) for r in rows} == {(k, n) for k in texts for n in (1, 2, 3)}
    model = Sampler.load(tokenizer_file("piece_bpe_32k.model"), 1.0).model
    assert all(r.decoded == model.decode(r.ids) for r in rows)
    # the decoded text is the normalised one, whole
    assert all(r.decoded.split() == texts[r.doc_id].split() for r in rows)
