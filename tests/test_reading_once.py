import hashlib

import numpy as np
import pytest
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import vector_to_array

from doclens.operators import vectors
from doclens.plans import train

TEXTS = ["Python and SQL, 5 years of experience", "C++ c++ é É ٣", "", None, "a " * 3000 + "b", "python python sql"]


def test_hashed_vectors_are_the_counts_of_the_buckets(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, t string").repartition(2)
    counted = vectors.count_buckets(df, "t", "c")
    unit = Normalizer(p=2.0, inputCol="c", outputCol="u").transform(counted)
    plain = {r[0]: r[1] for r in unit.select("doc_id", vector_to_array("u", "float32")).collect()}
    done = vectors.embed_documents(df, "t", "v")
    assert done.columns == ["doc_id", "t", "v"]
    assert {r["doc_id"]: r["v"] for r in done.collect()} == plain
    few = vectors._Buckets(8)
    assert few.of(["x"]).tolist() == [int(hashlib.md5(b"x").hexdigest()[:7], 16) % 8]


def test_read_documents_serve_every_model_that_reads_the_same(spark, monkeypatch):
    rows = [(i, f"{'python sql data' if i % 2 else 'figma design ux'} {i % 7} years", "a" if i % 2 else "b") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, resume_text string, category string")
    done = train.train_classifier(df, calibrate=False, tune=False, as_of_year=2025).classifier
    docs = df.select("doc_id", df.resume_text.alias("text"))
    read = done.read_documents(docs).cache()
    plain = {r["doc_id"]: r for r in done.predict_category(docs).collect()}
    monkeypatch.setattr(done, "read_documents", lambda *a: pytest.fail("read again"))
    once = {r["doc_id"]: r for r in done.predict_category(read, is_read=True).collect()}
    assert {k: (r["category"], r["cleaned_text"]) for k, r in once.items()} == {k: (r["category"], r["cleaned_text"]) for k, r in plain.items()}
    assert np.allclose([once[k]["confidence"] for k in plain], [plain[k]["confidence"] for k in plain])
    assert {r["category"] for r in plain.values()} == {"a", "b"}
