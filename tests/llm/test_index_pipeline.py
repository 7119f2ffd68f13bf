"""The permutation index, the registered queries, the pipeline."""
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from textguard.llm import bbit_minhash, packing, permutation_index, pii_tagger, weak_quality

DATA = "/root/testdata/sf0.001"
OPERATORS = ["op1_bbit_minhash", "op2_permutation_index", "op3_context_coder", "op4_best_fit_packing", "op5_scaled_sketch", "op6_backoff_lm", "op7_license_rules", "op8_pii_tagger", "op9_bpe",
             "op10_weak_quality", "op11_centroid_matrix", "op12_count_bitmaps", "op13_entropy_secrets", "pipeline"]


def exact(ids, vectors, query, k=5):
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    q = units[ids.index(query)]
    return sorted(((-float(u @ q), i) for i, u in zip(ids, units) if i != query))[:k]


@pytest.mark.parametrize("block", [8192, 120])
def test_recall_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(permutation_index, "BLOCK_ROWS", block)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    ids, vectors = [d[0] for d in data], np.array([d[1] for d in data], float)
    got = {}
    for r in permutation_index.search(df, "vec_id % 50 = 0").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == [i for i in sorted(ids) if i % 50 == 0]
    hits = 0
    for q, found in got.items():
        want = exact(ids, vectors, q)
        hits += len({i for _, i in want} & {i for i, _ in found.values()})
        assert sorted(found) == [1, 2, 3, 4, 5] and [s for _, s in (found[k] for k in range(1, 6))] == sorted((s for _, s in found.values()), reverse=True)
        for i, s in found.values():
            a, b = vectors[ids.index(q)], vectors[ids.index(i)]
            assert abs(s - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
    assert hits / (5 * len(got)) >= 0.9


def test_index_on_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (50, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rank": F.lit(1), "block": F.lit("x"), "score": F.lit(None).cast("double")})
    got = [tuple(r) for r in permutation_index.search(df, "vec_id % 50 = 0").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0), (50, 3, 2, 0.0)]
    assert permutation_index.search(df.limit(0), "vec_id % 50 = 0").count() == 0
    assert permutation_index.search(df.where("vec_id = 50"), "vec_id % 50 = 0").count() == 0


def test_many_equal_vectors_tie_by_id(spark):
    rng = np.random.default_rng(1)
    one = rng.normal(size=8).tolist()
    rows = [(k, one if k % 3 == 0 else rng.normal(size=8).tolist()) for k in range(900)]
    got = permutation_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id = 150").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 3, 6, 9, 12]


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit() or n == "pipeline"]
    assert sorted(names) == sorted(OPERATORS)


@pytest.mark.parametrize("name", OPERATORS)
def test_query_runs_over_the_whole_table(spark, name):
    df = entry.queries()[name](spark, DATA)
    got = df.collect()
    if name in ("op2_permutation_index",):
        n = spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id % 50 = 0").count()
        assert len(got) == 5 * n
    elif name == "op11_centroid_matrix":
        assert sorted(r["vec_id"] for r in got) == [r[0] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").orderBy("vec_id").collect()]
    elif name not in ("op4_best_fit_packing", "op12_count_bitmaps", "pipeline"):
        assert sorted(r["doc_id"] for r in got) == [r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").orderBy("doc_id").collect()]


def test_near_duplicates_match_their_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["op1_bbit_minhash"]).fetchall())
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in entry.queries()["op1_bbit_minhash"](spark, DATA).collect())
    assert got == want


def test_pipeline_stages_do_their_whole_job(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "near duplicates", "personal data", "packing"]
    given = {r["doc_id"]: r for r in docs.collect()}
    good = corpus_pipeline.STAGES[0][1](spark, docs, DATA)
    assert good.columns == docs.columns
    keep = {r["doc_id"] for r in weak_quality.classify(docs).collect() if r["keep"]}
    assert {r["doc_id"]: r for r in good.collect()} == {i: given[i] for i in keep}
    unlike = corpus_pipeline.STAGES[1][1](spark, good, DATA)
    stay = {r["doc_id"] for r in bbit_minhash.near_duplicates(good, 5, 80).collect() if r["kept"]}
    assert unlike.columns == docs.columns and {r["doc_id"]: r for r in unlike.collect()} == {i: given[i] for i in stay} and len(stay) < len(keep)
    clean = corpus_pipeline.STAGES[2][1](spark, unlike, DATA)
    assert clean.columns == docs.columns
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii_tagger.find(unlike).collect()}
    after = {r["doc_id"]: r for r in clean.collect()}
    assert set(after) == stay and any(spans.values())
    for i, r in after.items():
        want = pii_tagger.redacted(given[i]["text"], spans[i])
        assert (r["text"], r["n_chars"], r["lang"], r["source"]) == (want, len(want), given[i]["lang"], given[i]["source"])
        assert not pii_tagger.base_spans(r["text"])
    packed = corpus_pipeline.STAGES[3][1](spark, clean, DATA)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, packed.select(key).collect())) == sorted(map(tuple, packing.cut(clean, corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"), 0).select(key).collect()))
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, packed.select(key).collect()))


def test_pipeline_on_awkward_rows(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for _, stage in corpus_pipeline.STAGES:
            before = docs
            docs = stage(spark, docs, DATA)
        assert docs.columns[:3] == ["doc_id", "piece", "start"]
    assert before.columns == nothing.columns
