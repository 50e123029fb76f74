"""Registered queries against their SQL twins at the smallest scale, and the pipeline against brute force."""

from __future__ import annotations

import math
import re

import pytest
from check_oracle import difference, oracle_connection

import __spark_entry__ as registry
import corpus_pipeline
from riskmill.llm import queries, sql

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_query_equals_its_twin(spark, name):
    problem = difference(registry.queries()[name](spark, SMALL), oracle_connection(SMALL), sql.ORACLE[name])
    assert problem is None or problem.startswith("tiny"), problem


def test_all_operators_and_the_pipeline_are_registered():
    names = list(registry.queries())
    assert [n for n in names if re.match(r"op\d+_", n)] == list(queries.QUERIES)
    assert [int(re.match(r"op(\d+)_", n).group(1)) for n in queries.QUERIES] == list(range(1, 14))
    assert "pipeline" in names and set(sql.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", ["op1_simhash", "op5_toxicity", "op6_token_counts", "op7_sentencepiece"])
def test_one_row_per_document(spark, name):
    found = registry.queries()[name](spark, SMALL)
    wanted = sorted(r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect())
    assert sorted(r.doc_id for r in found.select("doc_id").collect()) == wanted


def test_pipeline_equals_brute_force(spark):
    from test_dedup import plain_components, plain_fingerprint

    from riskmill.llm import mixing, quality
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    judged = quality.judge(quality.measures(docs), quality.fit_trust(quality.measures(docs)))
    good = {r.doc_id for r in judged.collect() if r.kept}
    texts = {r.doc_id: (r.text or "", r.source) for r in docs.collect() if r.doc_id in good}
    first = {}
    for i in sorted(texts):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i][0]), i)
    single = sorted(first.values())
    components = plain_components([(i, plain_fingerprint(texts[i][0])) for i in single])
    left = [i for i, c in zip(single, components) if i == c]
    plan = mixing.assign(docs.where(docs.doc_id.isin(left))).where("taken > 0").collect()
    wanted = sorted(i for r in plan for i in [r.doc_id] * math.ceil(r.taken / r.size))

    found = corpus_pipeline.run(spark, SMALL)
    rows = found.collect()
    assert sorted(r.doc_id for r in rows) == wanted
    assert all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in rows)


def test_stages_keep_the_columns_of_documents(spark, documents, odd_rows):
    docs = documents(odd_rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash", "mixing", "sentencepiece"]


def test_pipeline_of_odd_and_empty_tables(spark, documents, odd_rows, tmp_path):
    words = [f"plain{(7 * k + j) % 301} text{j}" for k in range(6) for j in range(60)]
    rows = odd_rows + [(50 + k, " ".join(words[60 * k:60 * k + 60]), None if k % 2 else "s") for k in range(6)] + [(50, " ".join(words[:60]), "s")]
    for name, some in (("odd", rows), ("empty", [])):
        documents(some).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r.doc_id for r in found} - {6} <= {50 + k for k in range(6)} and found
    assert all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in found)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
