from __future__ import annotations

from collections import defaultdict

import pytest

import corpus_pipeline
from sessionlake.llm.catalog import ORACLES, QUERIES
from sessionlake.llm.pii import pseudonymise, secret_key
from sessionlake.llm.toxicity import THRESHOLD, train_lexicon
from tests.conftest import SMALL
from tests.llm.test_decontamination import smith_waterman
from tests.llm.test_kernel import plain
from tests.llm.test_near_dup import brute


def test_run_is_the_stages_by_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    lexicon = train_lexicon(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    a = lexicon.automaton()
    kept = {k: t for k, t in docs.items() if lexicon.score(lexicon.feature(a, t or "")) < THRESHOLD}
    kept = {k: kept[k] for k, _, c in brute(sorted(kept.items()), 80) if k == c}
    items = [plain(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]

    def leaked(text):
        w = plain(text)
        inside = set(zip(w, w[1:], w[2:], strict=False))
        near = [v for v in items if inside & set(zip(v, v[1:], v[2:], strict=False))]
        return any(len(inside & set(zip(v, v[1:], v[2:], strict=False))) >= 4 and smith_waterman(v, w) >= 0.8 * len(v) for v in near)

    kept = {k: t for k, t in kept.items() if not leaked(t)}
    texts = {k: pseudonymise(t, secret_key(spark))[0] for k, t in kept.items()}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(texts)
    from sessionlake.llm.packing import byte_bpe_50k

    encode, sizes = byte_bpe_50k(), defaultdict(int)
    for r in rows:
        sizes[r.doc_id] += r.length
    assert dict(sizes) == {k: len(encode(t)) + 1 for k, t in texts.items()}


def test_stages_give_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).dtypes == docs.dtypes


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df, rel = QUERIES[name](spark, SMALL), con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr) == sorted((tuple(r[rel.columns.index(c)] for c in sorted(rel.columns)) for r in rel.fetchall()), key=repr)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
