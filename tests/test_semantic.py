import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from doclens import catalog
from doclens.operators import semantic

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


def _dense(model, docs):
    rows = model.tfidf.transform(docs, "text").select("doc_id", vector_to_array("tfidf").alias("v")).orderBy("doc_id").collect()
    return np.array([r["v"] for r in rows])


def test_subspace_equals_a_dense_decomposition(spark):
    docs = spark.read.parquet(DOCUMENTS).repartition(5)
    model = semantic.fit_semantic(docs, "text", dims=6, spare=20, rounds=60, tolerance=1e-11, max_terms=400)
    assert model.residual <= 1e-11
    matrix = _dense(model, docs)
    _, values, right = np.linalg.svd(matrix, full_matrices=False)
    assert np.allclose(model.singular, values[:6], rtol=1e-8)
    # the sines of all angles between the two subspaces
    outside = model.basis - right[:6].T @ (right[:6] @ model.basis)
    assert np.linalg.norm(outside, 2) < 1e-6
    rows = model.transform(docs.select("doc_id", "text"), "text").orderBy("doc_id").collect()
    want = matrix @ model.basis
    norms = np.linalg.norm(want, axis=1, keepdims=True)
    want /= np.where(norms == 0, 1, norms)  # a text without a term stays zero
    assert np.allclose(np.array([r["embedding"] for r in rows]), want, atol=1e-6)
    assert rows[0].asDict().keys() == {"doc_id", "text", "embedding"}


def test_all_dimensions_keep_every_cosine(spark):
    docs = spark.read.parquet(DOCUMENTS)
    model = semantic.fit_semantic(docs, "text", dims=40, rounds=3, max_terms=40)
    matrix = _dense(model, docs)
    rows = model.transform(docs, "text", "e").select("e").orderBy("doc_id").collect()
    found = np.array([r["e"] for r in rows])
    assert np.allclose(found @ found.T, matrix @ matrix.T, atol=1e-5)


def test_saved_and_loaded(spark, tmp_path):
    docs = spark.read.parquet(DOCUMENTS)
    model = semantic.fit_semantic(docs, "text", dims=4, rounds=2, max_terms=50, stop_words=["the"])
    same = semantic.SemanticModel.load(spark, model.save(spark, str(tmp_path / "m")))
    assert same.tfidf == model.tfidf and np.array_equal(same.basis, model.basis) and same.residual == model.residual
    pairs = [m.transform(docs, "text", "e").orderBy("doc_id").select("e").collect() for m in (model, same)]
    assert pairs[0] == pairs[1]


def test_odd_tables(spark):
    schema = "doc_id long, text string, embedding string"
    empty = spark.createDataFrame([], schema)
    model = semantic.fit_semantic(empty, "text", dims=3)
    assert model.basis.shape == (0, 3) and model.transform(empty, "text").count() == 0
    rows = [(1, "alpha beta", "x"), (1, "alpha beta", "x"), (2, None, None), (3, "", "y"), (4, "gamma " * 20_000, "z"), (5, "beta gamma", "w")]
    docs = spark.createDataFrame(rows, schema)
    model = semantic.fit_semantic(docs, "text", dims=8, max_df=1.0)
    assert model.basis.shape[1] == 8 and len(model.tfidf.terms) < 8
    out = model.transform(docs, "text").withColumn("n", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).orderBy("doc_id").collect()
    assert [round(r["n"], 5) for r in out] == [1, 1, 0, 0, 1, 1]  # the column of that name is replaced
    assert out[0]["embedding"] == out[1]["embedding"] and len(out[0]["embedding"]) == 8


def test_cosine_with_a_vector_is_whole_whatever_the_dimensions(spark):
    docs = spark.read.parquet(DOCUMENTS)
    for dims in (4, 40):
        model = semantic.fit_semantic(docs, "text", dims=dims, rounds=2, max_terms=40)
        matrix = _dense(model, docs)
        first = matrix[np.flatnonzero(matrix.any(1))[0]]
        rows = model.transform(docs, "text", cosine="c", to=dict(enumerate(first))).orderBy("doc_id").collect()
        assert np.allclose([r["c"] for r in rows], matrix @ first, atol=1e-9)
        assert len(rows[0]["embedding"]) == dims and rows[0].asDict().keys() == {*docs.columns, "embedding", "c"}


def test_query_takes_the_whole_vocabulary(spark, monkeypatch):
    """It took 32 terms of 8,000, and as many dimensions."""
    fits = []
    fit = semantic.fit_semantic
    monkeypatch.setattr(semantic, "fit_semantic", lambda *a, **b: fits.append(fit(*a, **b)) or fits[-1])
    rows = catalog.load()[0]["embed_documents_semantic"](spark, DOCUMENTS.rpartition("/")[0]).collect()
    words = semantic.vectors.fit_tfidf(spark.read.parquet(DOCUMENTS), "text")
    assert len(rows) == spark.read.parquet(DOCUMENTS).count() and fits[0].basis.shape[1] == 384 and fits[0].tfidf == words and len(words.terms) > 1000
