import hashlib

import pytest
from pyspark.sql import functions as F

from doclens.operators import clean, evaluate, profile, sampling


@pytest.fixture(scope="module")
def people(spark):
    # one class holds most rows, one has a single row
    rows = [(i, "big" if i < 700 else "mid" if i < 990 else "tiny" if i < 999 else "one") for i in range(1000)]
    return spark.createDataFrame(rows, "doc_id long, category string").repartition(7)


def _order(i, seed=42):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


def test_global_holdout_is_the_first_fifth_in_hash_order(people):
    tagged = sampling.assign_holdout(people)
    held = {r["doc_id"] for r in tagged.filter("data_source = 'holdout'").collect()}
    assert held == set(sorted(range(1000), key=_order)[:200])
    assert sampling.assign_holdout(tagged) is tagged


def test_stratified_holdout_counts(people):
    tagged = sampling.assign_stratified_holdout(people)
    counts = {tuple(r)[:2]: r["count"] for r in tagged.groupBy("category", "data_source").count().collect()}
    assert counts[("one", "holdout")] == 1 and counts[("tiny", "holdout")] >= 1
    assert sum(v for (_, s), v in counts.items() if s == "holdout") == 200


def test_split_shares_and_fallback(people, spark):
    big = people.filter("category <> 'one'")
    split = sampling.train_test_split(big)
    counts = {r["category"]: r["n"] for r in split.filter("is_test").groupBy("category").agg(F.count("*").alias("n")).collect()}
    assert counts == {"big": 140, "mid": 58, "tiny": 2}
    plain = sampling.train_test_split(people)  # a class of one row cannot be stratified
    assert {r["doc_id"] for r in plain.filter("is_test").collect()} == set(sorted(range(1000), key=_order)[:200])


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_result_does_not_depend_on_partitioning(people, partitions):
    split = sampling.train_test_split(people.filter("category <> 'one'").repartition(partitions))
    assert sorted(r["doc_id"] for r in split.filter("is_test").collect()) == sorted(
        r["doc_id"] for r in sampling.train_test_split(people.filter("category <> 'one'")).filter("is_test").collect()
    )


def test_balancing(people):
    over = sampling.oversample(people)
    assert {r["count"] for r in over.groupBy("category").count().collect()} == {700}
    assert over.filter("copy = 0").count() == 1000
    assert {r["count"] for r in sampling.undersample(people).groupBy("category").count().collect()} == {1}


def test_many_copies_of_one_row_are_spread(people, monkeypatch):
    monkeypatch.setattr(sampling, "_COPIES_PER_TASK", 50)
    over = sampling.oversample(people)
    assert {r["count"] for r in over.groupBy("category").count().collect()} == {700}
    assert over.select("doc_id", "copy").distinct().count() == 2800


def test_only_train_is_balanced_and_other_tags_vanish(people):
    tag = F.when(F.col("doc_id") % 10 == 0, "holdout").when(F.col("doc_id") % 10 == 1, "other").otherwise("train")
    out = sampling.balance_classes(people.withColumn("data_source", tag))
    assert {r[0] for r in out.select("data_source").distinct().collect()} == {"train", "holdout"}
    assert out.filter("data_source = 'holdout'").count() == 100


def test_shuffle_index(people):
    rows = sampling.shuffle_rows(people, index_column="ix").collect()
    assert [r["doc_id"] for r in rows] == sorted(range(1000), key=_order)
    assert [r["ix"] for r in rows] == list(range(1000))


def test_dedup_keeps_the_first_and_survives_one_dominant_text(spark):
    rows = spark.createDataFrame([(i, "same" if i % 2 else f"t{i % 10}") for i in range(500)] + [(500, None), (501, None)], "doc_id long, t string")
    kept = clean.dedup_exact(rows.repartition(5), "t", "doc_id")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 4, 6, 8, 500]


def test_clean_documents_picks_renames_and_drops(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, " \t", "x"), (3, None, "x"), (4, "b", "\u00a0"), (5, "a", "y")], "doc_id long, content string, role string")
    got = clean.clean_documents(rows)
    assert got.columns == ["doc_id", "resume_text", "category"]
    assert [tuple(r) for r in got.collect()] == [(1, "a", "x")]
    with pytest.raises(ValueError):
        clean.clean_documents(rows.drop("role"))


def test_rare_categories(people):
    kept = clean.filter_rare_categories(people, min_category_count=9)
    assert {r[0] for r in kept.select("category").distinct().collect()} == {"big", "mid", "tiny"}


def test_profile(people):
    got = {(r["section"], r["name"]): r["value"] for r in profile.profile_dataset(people).collect()}
    assert got[("shape", "rows")] == 1000 and got[("imbalance_ratio", "max/min")] == 700


def test_metrics_count_classes_seen_on_either_side(spark):
    rows = spark.createDataFrame([("a", "a", 0.95, "train"), ("a", "b", 0.55, "train"), ("b", "c", 0.55, "holdout")], "label string, prediction string, confidence double, data_source string")
    row = evaluate.f1_scores(rows).first()
    assert row["f1_macro"] == pytest.approx((2 / 3 + 0 + 0) / 3)
    assert row["f1_weighted"] == pytest.approx((2 / 3) * 2 / 3)
    assert evaluate.calibration_error(rows).first()[0] == pytest.approx((0.05 + 0.55) / 2)
    assert evaluate.confusion_matrix(rows).count() == 9
    assert evaluate.classification_report(rows).count() == 6
