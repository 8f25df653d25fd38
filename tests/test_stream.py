"""The leaderboard against the batch on the last versions."""

import random

import pytest
from pyspark.sql import functions as F

from doclens.operators import rank
from doclens.streaming import leaderboard as board

SKILLS = ["python", "java", "docker", "sql", "react", "aws", "linux", "excel", "git", "spark"]


def _text(rng):
    return " ".join(rng.choice(SKILLS + ["report", "team", "sales", "garden"]) for _ in range(rng.randint(1, 9)))


@pytest.fixture(scope="module")
def listing(spark):
    rows = [(1, "python sql docker aws report", 2), (2, "java react git team", 3), (3, "excel sales garden", 1)]
    return spark.createDataFrame(rows, "job_id long, job_text string, top_n int").withColumns(
        {"shortlist_threshold": F.lit(0.6), "review_threshold": F.lit(0.4)}
    )


def _run(spark, jobs, batches, root, **options):
    columns = "doc_id long, text string" + (", version int" if options else "")
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(f"{root}/in")
        arriving = spark.readStream.schema(columns).parquet(f"{root}/in")
        board.screen_stream(jobs, arriving, f"{root}/board", f"{root}/checkpoint", available_now=True, **options).awaitTermination()
        yield number, sorted((r["job_id"], r["rank"], r["doc_id"], round(r["combined_score"], 9)) for r in board.leaderboard(jobs, f"{root}/board").collect())


def _batch(spark, jobs, texts):
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    return sorted((r["job_id"], r["rank"], r["doc_id"], round(r["combined_score"], 9)) for r in rank.rank_with_skills(jobs, docs).collect())


def test_documents_fall_and_others_rise(spark, listing, tmp_path, monkeypatch):
    made_anew = []
    inner = board.last_versions
    monkeypatch.setattr(board, "last_versions", lambda d, t, i, order: made_anew.append("batch" in order) or inner(d, t, i, order))
    monkeypatch.setattr(board, "pool_size", lambda top_n: top_n + 1)  # pools that are soon used up
    rng = random.Random(4)
    texts, batches = {}, []
    for number in range(3):
        rows = {i: _text(rng) for i in (range(40) if number == 0 else rng.sample(range(60), 12))}
        if number > 1:  # nearly all that are known become unrelated
            rows |= dict.fromkeys(range(0, 36), "nothing of that")
        batches.append(list(rows.items()))
    for number, got in _run(spark, listing, batches, str(tmp_path)):
        texts |= dict(batches[number])
        assert got == _batch(spark, listing, texts), number
    assert any(made_anew)


def test_the_case_of_two_listed(spark, listing, tmp_path):
    jobs = listing.filter("job_id = 1")
    first = [(1, "python sql docker aws report"), (2, "python sql docker aws"), (3, "python sql")]
    *_, (_, got) = _run(spark, jobs, [first, [(1, "garden")]], str(tmp_path))
    assert [(r, d) for _, r, d, _ in got] == [(1, 2), (2, 3)]


def test_versions_late_and_doubled(spark, listing, tmp_path):
    batches = [
        [(1, "python sql docker aws report", 2), (2, "java react git team", 1), (3, "excel", 1), (3, "sales garden excel", 2)],
        [(1, "garden", 1), (2, "garden", 3), (2, "sales", 2)],
    ]
    *_, (_, got) = _run(spark, listing, batches, str(tmp_path), version_column="version")
    assert got == _batch(spark, listing, {1: "python sql docker aws report", 2: "garden", 3: "sales garden excel"})


def test_a_document_twice_in_a_batch_is_one(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c")], "doc_id long, text string")
    one, two = ({r["doc_id"]: r["text"] for r in board.last_versions(d, "text", "doc_id", []).collect()} for d in (docs, docs.repartition(3)))
    assert one == two and set(one) == {1, 2}
