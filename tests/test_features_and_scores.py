import math

import pytest
from pyspark.sql import functions as F

from doclens.functions import features as ft
from doclens.functions import scores as sc
from doclens.operators import vectors


def test_years(values):
    texts = [
        None, "5+ years of experience", "over 12 yrs", "2010 - 2015, 2018 to Present", "2019 - 2015", "3 yrs exp and 7 years experience",
    ]
    assert values(ft.years_experience("t", 2025), texts) == [0, 5, 12, 7, 0, 7]


def test_education(values):
    texts = [None, "PhD", "M.Sc in X", "BA", "high school", "msn", "associate and diploma", "certificate; bachelor"]
    assert values(ft.education_level("t"), texts) == [0, 5, 4, 3, 1, 0, 2, 3]


def test_recency(values):
    got = values(ft.recency_score("t", 2025), [None, "none", "in 2025", "2030", "1990", "2010 and 2019"])
    assert got == pytest.approx([0, 0, 1, 1, 0, 1 - 6 / 15])


def test_title_signals(values):
    assert values(ft.job_title_signals("t")["job_title_designer"], ["UX lead", "luxury", None]) == [1, 0, 0]


def test_decisions_at_the_edges(spark):
    rows = spark.createDataFrame([(0.6,), (0.5999,), (0.4,), (0.39,), (None,)], "s double")
    assert [r[0] for r in rows.select(sc.decide("s")).collect()] == [
        "Shortlist", "Further Review", "Further Review", "Reject", "Reject",
    ]


def test_finite_score(spark):
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (0.3,)], "s double")
    assert [r[0] for r in rows.select(sc.finite_score("s")).collect()] == [0.0, 1.0, 0.0, 0.3]


def test_temperature_and_margins(spark):
    row = spark.range(1).select(
        sc.temperature_scale(F.array(F.lit(0.7), F.lit(0.3)), 0.5).alias("t"),
        sc.margin_confidence(F.array(F.lit(2.0))).alias("one"),
        sc.margin_confidence(F.array(F.lit(1.0), F.lit(3.0))).alias("two"),
    ).first()
    assert row["t"] == pytest.approx([0.49 / 0.58, 0.09 / 0.58])
    assert row["one"] == pytest.approx(1 / (1 + math.exp(-2)))
    assert row["two"] == pytest.approx(1 / (1 + math.exp(-2)))
    with pytest.raises(ValueError):
        sc.temperature_scale(F.lit(None), 0)


def test_scaler_uses_population_deviation_and_keeps_constants(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    model = vectors.fit_scaler(rows, ["a", "b"])
    assert sorted(map(tuple, vectors.scale_features(rows, model).collect())) == [(-1.0, 0.0), (1.0, 0.0)]
    with pytest.raises(ValueError):
        vectors.scale_features(rows, None)


def test_plugged_in_encoder_and_blank_text(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, " "), (3, None)], "doc_id long, resume_text string")

    def factory():
        return lambda texts: [[float(len(t)), 0.0, 1.0 if t == "[empty]" else 0.0] for t in texts]

    got = {r["doc_id"]: r["embedding"] for r in vectors.embed_documents(rows, encoder=factory).collect()}
    assert got[1] == [1.0, 0.0, 0.0]
    assert got[2] == got[3] and got[2][2] > 0
    default = {r["doc_id"]: r["embedding"] for r in vectors.embed_documents(rows).collect()}
    assert len(default[1]) == 384 and sum(v * v for v in default[2]) == pytest.approx(1.0)
    assert default[2] == default[3]
