"""Queries of similarity, ranking, decisions and screening."""

from pyspark.sql import functions as F

from doclens import lexicon as lx
from doclens.catalog.base import derived, query, table, with_views
from doclens.catalog.cleaning import SQL_JOB_TEXT
from doclens.catalog.features import sql_buckets
from doclens.catalog.text import SQL_PREPROCESSED, sql_aliases, sql_skills
from doclens.functions import scores as sc
from doclens.functions import text as tx
from doclens.operators import rank
from doclens.plans import screen
from doclens.sources import tables


@query(
    "cosine_similarity",
    """SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id""",
)
def _(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vectors.join(following, "vec_id").select(
        "vec_id", F.round(sc.cosine_similarity("embedding", "other"), 6).alias("cosine")
    )


SQL_COUNTS = f"""
jb AS MATERIALIZED ({sql_buckets('jobs', 'job_id', 'job_text')}),
db AS MATERIALIZED ({sql_buckets('resumes', 'resume_id', 'resume_text')}),
jn AS (SELECT job_id, sum(c * c) AS n2 FROM jb GROUP BY job_id),
dn AS (SELECT resume_id, sum(c * c) AS n2 FROM db GROUP BY resume_id),
dots AS (SELECT job_id, resume_id, sum(jb.c * db.c) AS dot FROM jb JOIN db USING (bucket) GROUP BY ALL),
sims AS MATERIALIZED (
  SELECT j.job_id, d.resume_id,
         coalesce(CAST(dot AS DOUBLE), 0) / sqrt(CAST(j.n2 AS DOUBLE) * CAST(d.n2 AS DOUBLE)) AS similarity_score
  FROM jn j CROSS JOIN dn d LEFT JOIN dots ON dots.job_id = j.job_id AND dots.resume_id = d.resume_id)
"""
SQL_JOB_SKILLS = f"SELECT job_id, {sql_skills('')} AS job_skills FROM (SELECT job_id, {sql_aliases('job_text')} AS expanded FROM jobs)"
SQL_DOC_SKILLS = f"SELECT resume_id, {sql_skills('')} AS resume_skills FROM (SELECT resume_id, {sql_aliases('resume_text')} AS expanded FROM resumes)"
SQL_RANKED = f"""
{SQL_COUNTS},
js AS MATERIALIZED ({SQL_JOB_SKILLS}), ds AS MATERIALIZED ({SQL_DOC_SKILLS}),
matched AS (SELECT s.*, job_skills, resume_skills,
    CASE WHEN len(job_skills) > 0 THEN CAST(len(list_intersect(job_skills, resume_skills)) AS DOUBLE) / len(job_skills)
         ELSE 0 END AS skill_match_score
    FROM sims s JOIN js ON s.job_id = js.job_id JOIN ds ON s.resume_id = ds.resume_id),
combined AS (SELECT m.*, similarity_weight * similarity_score + skill_weight * skill_match_score AS combined_score,
                    top_n, shortlist_threshold, review_threshold FROM matched m JOIN jobs j ON m.job_id = j.job_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY combined_score DESC, resume_id) AS rank FROM combined),
ranked AS MATERIALIZED (SELECT *, CASE WHEN combined_score >= shortlist_threshold THEN 'Shortlist'
                           WHEN combined_score >= review_threshold THEN 'Further Review' ELSE 'Reject' END AS decision,
                  array_to_string(list_sort(list_intersect(job_skills, resume_skills)), '|') AS matched_skills,
                  array_to_string(list_sort(list_filter(job_skills, lambda s: NOT list_contains(resume_skills, s))), '|') AS missing_skills,
                  array_to_string(list_sort(resume_skills), '|') AS all_skills,
                  array_to_string(list_sort(job_skills), '|') AS wanted_skills
           FROM placed WHERE rank <= top_n)
"""
_SCORES = ", ".join(
    f"round({c}, 6) AS {c}" for c in ("similarity_score", "skill_match_score", "combined_score")
)


def _ranked(spark, d, **options):
    resumes = derived(spark, d, "resumes").select("resume_id", "resume_text")
    return rank.rank_with_skills(derived(spark, d, "jobs"), resumes, "resume_text", "resume_id", **options)


def _decided(spark, d):
    return rank.apply_decisions(_ranked(spark, d), derived(spark, d, "jobs"))


def _flat(df):
    joined = {
        c: F.array_join(c, "|") for c in ("matched_skills", "missing_skills", "job_skills", "resume_skills") if c in df.columns
    }
    rounded = {
        c: F.round(c, 6) for c in ("similarity_score", "skill_match_score", "combined_score") if c in df.columns
    }
    return df.withColumns({**joined, **rounded, "rank": F.col("rank").cast("long")})


_PAIRS = """pairs AS (SELECT r.resume_id, r.resume_text, j.job_text, j.shortlist_threshold, j.review_threshold, j.job_id
  FROM (SELECT *, resume_id % (SELECT count(*) FROM benchmark) AS job_no FROM resumes) r JOIN jobs j ON r.job_no = j.job_id)"""


def _pairs(spark, d):
    """Every candidate next to the job it applied for."""
    jobs = derived(spark, d, "jobs")
    wanted = jobs.count()
    resumes = derived(spark, d, "resumes").select("resume_id", "resume_text")
    return resumes.withColumn("job_id", F.pmod("resume_id", F.lit(wanted))).join(jobs, "job_id")


@query(
    "score_similarity",
    with_views(
        f"""WITH {_PAIRS},
        a AS ({sql_buckets('pairs', 'resume_id', 'job_text')}), b AS ({sql_buckets('pairs', 'resume_id', 'resume_text')}),
        an AS (SELECT resume_id, sum(c * c) AS n2 FROM a GROUP BY resume_id),
        bn AS (SELECT resume_id, sum(c * c) AS n2 FROM b GROUP BY resume_id),
        dots AS (SELECT resume_id, sum(a.c * b.c) AS dot FROM a JOIN b USING (resume_id, bucket) GROUP BY resume_id)
        SELECT an.resume_id, round(coalesce(CAST(dot AS DOUBLE), 0) / sqrt(CAST(an.n2 AS DOUBLE) * bn.n2), 6) AS similarity_score
        FROM an JOIN bn USING (resume_id) LEFT JOIN dots USING (resume_id)""",
        "resumes",
        "jobs",
    ),
)
def _(spark, d):
    scored = rank.score_similarity(_pairs(spark, d), "job_text", "resume_text")
    return scored.select("resume_id", F.round("similarity_score", 6).alias("similarity_score"))


@query(
    "skill_overlap",
    with_views(
        f"""WITH {_PAIRS}, js AS ({SQL_JOB_SKILLS}), ds AS ({SQL_DOC_SKILLS})
        SELECT p.resume_id,
               CASE WHEN len(job_skills) > 0 THEN round(CAST(len(list_intersect(job_skills, resume_skills)) AS DOUBLE)
                 / len(job_skills), 6) ELSE 0 END AS skill_match_score,
               array_to_string(list_sort(list_intersect(job_skills, resume_skills)), '|') AS matched_skills,
               array_to_string(list_sort(list_filter(job_skills, lambda s: NOT list_contains(resume_skills, s))), '|')
                 AS missing_skills
        FROM pairs p JOIN js ON p.job_id = js.job_id JOIN ds ON p.resume_id = ds.resume_id""",
        "resumes",
        "jobs",
    ),
)
def _(spark, d):
    pairs = _pairs(spark, d).withColumns(
        {"job_skills": tx.extract_skills("job_text"), "resume_skills": tx.extract_skills("resume_text")}
    )
    return pairs.select(
        "resume_id",
        F.round(sc.skill_overlap("job_skills", "resume_skills"), 6).alias("skill_match_score"),
        F.array_join(sc.matched_skills("job_skills", "resume_skills"), "|").alias("matched_skills"),
        F.array_join(sc.missing_skills("job_skills", "resume_skills"), "|").alias("missing_skills"),
    )


@query(
    "rank_by_similarity",
    with_views(
        f"""WITH {SQL_COUNTS}, placed AS (SELECT s.*, j.top_n, row_number() OVER (PARTITION BY s.job_id
             ORDER BY similarity_score DESC, resume_id) AS rank FROM sims s JOIN jobs j ON s.job_id = j.job_id)
        SELECT job_id, rank, resume_id AS doc_id, round(similarity_score, 6) AS similarity_score
        FROM placed WHERE rank <= top_n""",
        "resumes",
        "jobs",
    ),
)
def _(spark, d):
    resumes = derived(spark, d, "resumes").select("resume_id", "resume_text")
    return _flat(rank.rank_by_similarity(derived(spark, d, "jobs"), resumes, id_column="resume_id"))


@query(
    "rank_with_skills",
    with_views(
        f"""WITH {SQL_RANKED} SELECT job_id, rank, resume_id AS doc_id, {_SCORES}, matched_skills, missing_skills,
        wanted_skills AS job_skills, all_skills AS resume_skills, decision FROM ranked""",
        "resumes",
        "jobs",
    ),
)
def _(spark, d):
    return _flat(_decided(spark, d)).drop("shortlist_threshold", "review_threshold")


@query(
    "rank_with_fallback_texts",
    with_views(
        f"""WITH resumes AS (SELECT doc_id AS resume_id, CASE WHEN doc_id % 3 = 2 THEN lower(text) WHEN doc_id % 2 = 0 THEN text
          ELSE 'python sql ' || text END AS resume_text FROM documents),
        {SQL_RANKED} SELECT job_id, rank, resume_id AS doc_id, {_SCORES} FROM ranked""",
        "jobs",
    ),
)
def _(spark, d):
    docs = table(spark, d, "documents").selectExpr(
        "doc_id", "CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE lower(text) END AS cleaned_text",
        "CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS text", "'python sql ' || text AS resume_text",
    )
    ranked = rank.rank_with_skills(derived(spark, d, "jobs"), docs, ("cleaned_text", "text", "body", "resume_text"))
    return _flat(ranked).select("job_id", "rank", "doc_id", "similarity_score", "skill_match_score", "combined_score")


@query(
    "rank_with_cleaned_text",
    with_views(
        f"""WITH {SQL_PREPROCESSED}, {SQL_RANKED}
        SELECT job_id, rank, r.resume_id AS doc_id, cleaned_text FROM ranked r JOIN preprocessed p
          ON r.resume_id = p.resume_id""",
        "resumes",
        "jobs",
    ),
)
def _(spark, d):
    return _flat(_ranked(spark, d, with_cleaned_text=True)).select("job_id", "rank", "doc_id", "cleaned_text")


@query(
    "decide",
    with_views(
        """SELECT id, CASE WHEN coalesce(score, 0) >= hi THEN 'Shortlist' WHEN coalesce(score, 0) >= lo
          THEN 'Further Review' ELSE 'Reject' END AS decision
        FROM (SELECT id, CASE WHEN id % 50 = 0 THEN NULL ELSE confidence END AS score,
                     CAST(0.6 + 0.1 * (id % 3) AS DOUBLE) AS hi, CAST(0.4 AS DOUBLE) AS lo FROM predictions)""",
        "predictions",
    ),
)
def _(spark, d):
    scored = derived(spark, d, "predictions").selectExpr(
        "id",
        "CASE WHEN id % 50 = 0 THEN NULL ELSE confidence END AS score",
        "CAST(0.6 + 0.1 * (id % 3) AS DOUBLE) AS hi",
        "CAST(0.4 AS DOUBLE) AS lo",
    )
    return scored.select("id", sc.decide("score", "hi", "lo").alias("decision"))


@query(
    "score_band",
    with_views(
        "SELECT id, CASE WHEN confidence >= 0.6 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS band "
        "FROM predictions",
        "predictions",
    ),
)
def _(spark, d):
    return derived(spark, d, "predictions").select("id", sc.score_band("confidence").alias("band"))


@query(
    "validate_jobs",
    with_views(
        """SELECT job_id, greatest(top_n, 1) AS top_n, hi < lo AS rejected FROM (
          SELECT job_id, CAST(top_n - 9 AS BIGINT) AS top_n, CAST(0.3 + 0.1 * (job_id % 4) AS DOUBLE) AS hi,
                 CAST(0.4 AS DOUBLE) AS lo FROM jobs)""",
        "jobs",
    ),
)
def _(spark, d):
    jobs = derived(spark, d, "jobs").selectExpr(
        "job_id", "job_text", "top_n - 9 AS top_n", "CAST(0.3 + 0.1 * (job_id % 4) AS DOUBLE) AS shortlist_threshold",
        "CAST(0.4 AS DOUBLE) AS review_threshold",
    )
    return rank.validate_jobs(jobs).select(
        "job_id", F.col("top_n").cast("long").alias("top_n"), F.col("reject_reason").isNotNull().alias("rejected")
    )


@query(
    "decision_summary",
    with_views(
        f"""WITH {SQL_RANKED} SELECT job_id, (SELECT count(*) FROM resumes) AS total_documents,
        count(*) FILTER (WHERE decision = 'Shortlist') AS shortlisted,
        count(*) FILTER (WHERE decision = 'Further Review') AS further_review,
        count(*) FILTER (WHERE decision = 'Reject') AS rejected FROM ranked GROUP BY job_id""",
        "resumes",
        "jobs",
    ),
)
def _(spark, d):
    return rank.decision_summary(_decided(spark, d), table(spark, d, "documents").count())


@query(
    "shortlist_report",
    with_views(
        f"""WITH {SQL_RANKED} SELECT job_id, rank, 'Unknown' AS candidate_name, round(similarity_score, 4) AS similarity_score,
        round(skill_match_score, 4) AS skill_match_score, round(combined_score, 4) AS combined_score, decision,
        replace(matched_skills, '|', ', ') AS matched_skills, replace(missing_skills, '|', ', ') AS missing_skills,
        replace(all_skills, '|', ', ') AS all_resume_skills FROM ranked WHERE rank <= 10""",
        "resumes",
        "jobs",
    ),
)
def _(spark, d):
    return tables.shortlist_report(_decided(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query(
    "export_results",
    with_views(
        f"""WITH {SQL_RANKED} SELECT job_id AS "Job", rank AS "Rank", 'file' || resume_id || '.docx' AS "Filename",
        decision AS "Decision", round(combined_score, 4) AS "Combined Score", round(similarity_score, 4) AS "Similarity Score",
        round(skill_match_score, 4) AS "Skill Match", '' AS "Predicted Category", CAST(0 AS DOUBLE) AS "Category Confidence",
        replace(matched_skills, '|', ', ') AS "Matched Skills", replace(missing_skills, '|', ', ') AS "Missing Skills"
        FROM ranked""",
        "resumes",
        "jobs",
    ),
)
def _(spark, d):
    named = _decided(spark, d).withColumn(
        "filename", F.concat(F.lit("file"), F.col("doc_id").cast("string"), F.lit(".docx"))
    )
    return tables.export_results(named.withColumn("rank", F.col("rank").cast("long")))


@query(
    "rank_job_requests",
    with_views(
        f"""WITH jobs AS (SELECT job_id, {SQL_JOB_TEXT} AS job_text, CAST(0.6 AS DOUBLE) AS shortlist_threshold,
          CAST(0.4 AS DOUBLE) AS review_threshold, 10 AS top_n, CAST(0.5 AS DOUBLE) AS skill_weight,
          CAST(0.5 AS DOUBLE) AS similarity_weight FROM job_requests),
        {SQL_RANKED} SELECT job_id, rank, resume_id AS doc_id, {_SCORES}, decision FROM ranked""",
        "resumes",
        "job_requests",
    ),
)
def _(spark, d):
    requests = derived(spark, d, "job_requests").select("job_id", rank.build_job_text().alias("job_text"))
    resumes = derived(spark, d, "resumes").select("resume_id", "resume_text")
    ranked = rank.rank_with_skills(requests, resumes, "resume_text", "resume_id")
    return _flat(rank.apply_decisions(ranked, requests)).select(
        "job_id", "rank", "doc_id", "similarity_score", "skill_match_score", "combined_score", "decision"
    )
