import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from doclens.catalog.sources import docx_bytes
from doclens.functions import text as tx
from doclens.operators import classify, nearest, rank
from doclens.plans import screen
from doclens.sources import files, tables
from doclens.streaming import leaderboard as board

JOBS = [
    (1, "python and sql for machine learning", 3), (2, "java developer with docker", 2), (3, "   ", 2), (4, "gardener", 0),
]
WORDS = "python java sql docker team work garden plant data model cloud aws".split()
DOCS = [(i, " ".join(WORDS[(i * k) % 12] for k in range(1, 4 + i % 5)) if i else "") for i in range(40)] + [(40, None)]


@pytest.fixture(scope="module")
def jobs(spark):
    return spark.createDataFrame(JOBS, "job_id long, job_text string, top_n int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").repartition(5)


def _bucket(token):
    import hashlib

    return int(hashlib.md5(token.encode()).hexdigest()[:7], 16) % 384


def _brute_force(spark):
    """All pairs in plain Python, skills from the column function."""
    texts = spark.createDataFrame([(f"j{j}", t) for j, t, _ in JOBS] + [(f"d{d}", t) for d, t in DOCS], "k string, t string")
    skills = {r["k"]: set(r["s"]) for r in texts.select("k", tx.extract_skills("t").alias("s")).collect()}

    def counts(text):
        return Counter(_bucket(w) for w in ((text or "").lower().split() or ["empty"]))

    out = []
    for j, job, n in JOBS:
        scored = []
        for d, doc in DOCS:
            a, b = counts(job), counts(doc)
            norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
            sim = sum(a[k] * b[k] for k in a) / norm if job.strip() else 0.0
            wanted = skills[f"j{j}"]
            match = len(wanted & skills[f"d{d}"]) / len(wanted) if wanted else 0.0
            scored.append((0.5 * sim + 0.5 * match, d))
        best = sorted(scored, key=lambda p: (-p[0], p[1]))[: max(n, 1)]
        out += [(j, place + 1, d, round(s, 9)) for place, (s, d) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [1000, 3])
def test_ranking_equals_brute_force_in_both_layouts(spark, jobs, docs, block_rows):
    ranked = rank.rank_with_skills(jobs, docs, block_rows=block_rows)
    got = sorted((r["job_id"], r["rank"], r["doc_id"], round(r["combined_score"], 9)) for r in ranked.collect())
    assert got == _brute_force(spark)


def test_skill_arrays_and_cleaned_text(jobs, docs):
    row = rank.rank_with_skills(jobs, docs, with_cleaned_text=True).filter("job_id = 2 AND rank = 1").first()
    assert set(row["matched_skills"]) | set(row["missing_skills"]) == {"Docker", "Java"}
    assert row["cleaned_text"]


def test_validate_jobs(spark):
    rows = spark.createDataFrame([(1, "x", 0.3, 0.4, 0), (2, "y", 0.4, 0.4, 5)], "job_id long, job_text string, shortlist_threshold double, review_threshold double, top_n int")
    got = {r["job_id"]: (r["top_n"], r["reject_reason"] is None) for r in rank.validate_jobs(rows).collect()}
    assert got == {1: (1, False), 2: (5, True)}


@pytest.mark.parametrize("block_rows", [1000, 7])
def test_neighbours_equal_brute_force_in_both_layouts(spark, block_rows):
    vectors = [[math.sin(i * 7.0 + j) for j in range(4)] for i in range(30)]
    vectors[20] = vectors[3]  # an exact copy: only it votes
    items = spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(vectors[:20])], "item_id long, label int, vector array<float>")
    rows = spark.createDataFrame([(i, vectors[i]) for i in range(20, 30)], "query_id long, vector array<float>")
    near = nearest.nearest_items(rows, items, 7, 4, block_rows).collect()
    single = [[float(x) for x in v] for v in vectors]
    for q in range(20, 30):
        got = sorted((r["distance"], r["item_id"]) for r in near if r["query_id"] == q)
        want = sorted((math.dist(single[q], single[i]), i) for i in range(20))[:7]
        assert [i for _, i in got] == [i for _, i in want]
    knn = {r["query_id"]: r for r in classify.predict_knn(items, rows, 4, block_rows=block_rows).collect()}
    assert len(knn) == 10 and knn[20]["prediction"] == 0 and knn[20]["confidence"] == 1.0


def test_items_never_pass_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(nearest, "blocks_of", lambda *a: pytest.fail("items are taken to the driver"))
    items = spark.range(300).selectExpr("id AS item_id", "int(id % 3) AS label", "array(float(id), float(0)) AS vector")
    rows = spark.range(40).selectExpr("concat('q', id) AS query_id", "array(float(id * 7 + 0.25), float(0)) AS vector")
    near = nearest.nearest_items(rows, items, 3, 2, block_rows=9)
    got = {}
    for r in near.collect():
        got.setdefault(r["query_id"], set()).add(r["item_id"])
    assert got == {f"q{i}": {i * 7 - 1, i * 7, i * 7 + 1} if i else {0, 1, 2} for i in range(40)}
    assert nearest.nearest_items(rows, items.limit(0), 3, 2).count() == 0


def test_stream_equals_batch_and_replay_changes_nothing(spark, jobs, docs, tmp_path):
    source = str(tmp_path / "in")
    docs.repartition(4).write.parquet(source)
    arriving = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(source)
    path = str(tmp_path / "board")
    for checkpoint in ("a", "b"):  # the second run delivers every document again
        board.screen_stream(jobs, arriving, path, str(tmp_path / checkpoint), available_now=True).awaitTermination()
    got = {(r["job_id"], r["rank"], r["doc_id"]) for r in board.leaderboard(jobs, path).collect()}
    want = {(r["job_id"], r["rank"], r["doc_id"]) for r in rank.rank_with_skills(jobs, docs).collect()}
    assert got == want


def test_document_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx_bytes("line one\n\n  two & <three>"))
    (tmp_path / "bad.docx").write_bytes(b"not a zip")
    (tmp_path / "empty.docx").write_bytes(docx_bytes(" "))
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.txt").write_text("ignored")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.docx").write_bytes(docx_bytes("nested"))
    got = files.ingest_document_files(spark, str(tmp_path), pdf_reader=lambda content: "page one\npage two").collect()
    assert {(r["filename"], r["text"], r["file_type"]) for r in got} == {
        ("a.docx", "line one\n  two & <three>", "DOCX"), ("c.pdf", "page one\npage two", "PDF"),
    }
    failed = files.ingest_document_files(spark, str(tmp_path), keep_errors=True).filter("error IS NOT NULL")
    assert {r["filename"] for r in failed.collect()} >= {"bad.docx"}


def test_uploads_and_screening(spark, jobs):
    blobs = [("a.docx", docx_bytes("python sql machine learning")), ("b.odt", b"x"), ("noext", b"y")]
    uploads = spark.createDataFrame(blobs, "filename string, content binary")
    kept = {r["filename"]: r for r in files.ingest_uploads(uploads, pdf_reader=lambda c: "java docker", keep_errors=True).collect()}
    assert kept["noext"]["file_type"] == "UNKNOWN" and kept["noext"]["text"] == "java docker"
    assert "unsupported" in kept["b.odt"]["error"]
    answer = screen.screen_uploads(jobs, uploads.unionAll(uploads.filter("filename = 'a.docx'")))
    result = answer.rows.filter("job_id = 1").collect()
    assert [r["filename"] for r in result] == ["a.docx"] * 2 and result[0]["decision"] == "Shortlist"
    assert sorted(r["rank"] for r in result) == [1, 2] and len({r["doc_id"] for r in result}) == 2
    assert sorted(r["filename"] for r in answer.failed.collect()) == ["b.odt", "noext"]
    totals = {(r["total_documents"], r["failed_documents"]) for r in answer.summary.collect()}
    assert totals == {(4, 2)}


def test_no_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from doclens.session import shared_folder

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(spark, "x")


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([('say "hi",\nline two', "x"), ("plain", "y")], "resume_text string, category string")
    path = tables.write_documents(rows, str(tmp_path / "out"), "csv")
    assert sorted(map(tuple, tables.read_documents_csv(spark, path).collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(ValueError):
        tables.read_documents_csv(spark, None)


def test_report_defaults(spark):
    ranked = spark.createDataFrame([(1, 1, 0.123456)], "job_id long, rank int, combined_score double")
    row = tables.shortlist_report(ranked).first()
    assert row["candidate_name"] == "Unknown" and row["decision"] == "Unknown" and row["combined_score"] == 0.1235


def test_ranking_takes_the_first_text_that_is_there(spark, jobs):
    rows = [(1, None, "python sql machine learning"), (2, "", "java docker"), (3, "python sql machine learning", "java")]
    docs = spark.createDataFrame(rows, "doc_id long, cleaned_text string, text string")
    plain = spark.createDataFrame([(i, c or t) for i, c, t in rows], "doc_id long, text string")
    key = lambda r: (r["job_id"], r["rank"], r["doc_id"], r["combined_score"])
    got = rank.rank_with_skills(jobs, docs, ("cleaned_text", "body", "text")).collect()
    assert sorted(map(key, got)) == sorted(map(key, rank.rank_with_skills(jobs, plain).collect()))


def test_a_task_scores_few_documents_at_a_time():
    """An Arrow batch of 10,000 vectors was widened and scored at once, in matrices of documents by jobs."""
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, (3000, 4)).astype(np.float32)
    schema = pa.schema([("job_id", pa.int64()), ("doc_id", pa.int64()), *nearest._SCORES.items()])
    wanted = pa.table({
        "job_id": list(range(600)), "vector": [[1.0, j % 5, j % 3, 1.0] for j in range(600)], "top_n": [3] * 600, "is_blank": [False] * 600,
        "similarity_weight": [0.5] * 600, "skill_weight": [0.5] * 600,
    })
    jobs = nearest.JobBlock(wanted, 3, 1, schema)
    similarity, skill, combined = jobs.score(counts.astype(float))
    order = [np.lexsort((np.arange(3000), -combined[:, j]))[:3].tolist() for j in range(600)]
    sizes, score = [], jobs.score
    jobs.score = lambda documents: sizes.append(len(documents)) or score(documents)
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(counts.tolist(), pa.list_(pa.float32()))], ["doc_id", "vector"])
    found = nearest.best_documents(jobs, iter([batch]), 4).sort_by([("job_id", "ascending"), ("combined_score", "descending"), ("doc_id", "ascending")])
    assert sum(sizes) == 3000 and max(sizes) <= 1024
    assert found.column("doc_id").to_pylist() == [d for docs in order for d in docs]


def test_survivors_are_found_without_shuffling_the_texts(spark, jobs, docs):
    plan = screen.screen(jobs, docs)._jdf.queryExecution().optimizedPlan().toString()
    semi = [line for line in plan.splitlines() if "Join LeftSemi" in line]
    assert len(semi) == 1 and "rightHint=(strategy=broadcast)" in semi[0]
