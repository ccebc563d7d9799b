"""The registered queries with SQL, and the pipeline, on the smallest tables."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from clickloom.llm import langid
from clickloom.llm.queries import ORACLE, QUERIES

from ..conftest import SF
from .test_minhash import brute


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = con.execute(ORACLE[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    got = Counter(tuple(row[c] for c in columns) for row in df.collect())
    assert got == Counter(tuple(row[order.index(c)] for c in columns) for row in result.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_pipeline_stages_against_brute_force(spark, documents):

    docs, columns = documents, documents.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        left = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language_id":
            models = langid.train(documents)
            want = {r["doc_id"] for r in langid.identify(documents, models).collect() if r["accepted"]}
        elif name == "exact_dedup":
            first: dict = {}
            for i in sorted(rows):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]), i)
            want = set(first.values())
        else:
            want = set(brute(list(rows.items()), 5).values())
        assert set(left) == want, name
        rows = left
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p["doc_id"] for p in pieces} == set(rows)
    assert sum(p["length"] for p in pieces) == sum({p["doc_id"]: p["doc_tokens"] for p in pieces}.values())


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls in any column, repeated rows and names that stages use themselves; a table without labels, an empty one."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _dropped long, __key string, __text_sha256 string, __host string"
    prose = "the quick brown fox jumps over the lazy dog and runs away from the old grey house near the river "
    rows = [(k, prose * 2 + f"in the year {1900 + k} with number {k * k}", "en", "web", 9, k, "a", "b", "c") for k in range(12)]
    odd = [rows[0], rows[0], (None, prose + "once", "en", None, None, None, None, None, None), (90, None, None, None, None, None, None, None, None), (91, "", "en", "web", 0, 1, "", "", "")]
    unlabelled = [(*r[:2], None, *r[3:]) for r in rows]
    for name, table, least in (("odd", rows + odd, 2), ("unlabelled", unlabelled, 1), ("empty", [], 0)):
        folder = tmp_path / name
        spark.createDataFrame(table, schema).write.parquet(str(folder / "documents.parquet"))
        packed = corpus_pipeline.run(spark, str(folder)).collect()
        assert len({r["doc_id"] for r in packed}) >= least and (packed or not table), name
        assert all(r["doc_id"] not in (90, 91) for r in packed)
        docs = spark.createDataFrame(table, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == [f.strip().split()[0] for f in schema.split(",")]
