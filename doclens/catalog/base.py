"""Registry plus the derived input views that both engines build from the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from doclens.sources.tables import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF_YEAR = 2025


def query(name: str, sql: str | None = None):
    """Register a query builder, with its SQL twin where one exists."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name == "documents" else df


# Candidate documents: each document's own text inside a generated candidate
# frame. The frame depends on the text length only, so copies stay copies.
_RESUMES = """
SELECT doc_id AS resume_id, category, data_source, years,
       CASE WHEN k % 97 = 13 THEN NULL
            WHEN k % 97 = 14 THEN '   '
       ELSE concat(
         CASE WHEN k % 3 = 0 THEN 'Senior ' ELSE '' END, category,
         {NL}, 'Contact: user', CAST(k % 50 AS {STR}), '@mail.example, 555-', CAST(100 + k % 50 AS {STR}),
         '-1234, http://site.example/', CAST(k % 50 AS {STR}),
         CASE WHEN k % 4 = 3 THEN ' ' ELSE concat({NL}, 'SKILLS:', {NL}) END,
         CASE k % 6 WHEN 0 THEN 'Python 3.11, TensorFlow 2.x, ML, SQL' WHEN 1 THEN 'C++, C#, Java 17, CI/CD'
              WHEN 2 THEN 'node.js, React.js, TS, HTML5' WHEN 3 THEN 'K8s, Docker, Terraform, AWS'
              WHEN 4 THEN 'postgres, mongo, Java Script, go to market, asp.net'
              ELSE 'Figma, UI/UX, agile, cv engineer' END,
         CASE WHEN k % 4 = 3 THEN ' ' ELSE concat({NL}, '## Work Experience', {NL}) END,
         CAST(1 + k % 15 AS {STR}), '+ years of experience. Acme (', CAST(2005 + k % 10 AS {STR}), ' - ',
         CASE WHEN k % 2 = 0 THEN 'Present' ELSE CAST(2012 + k % 12 AS {STR}) END, ')',
         CASE WHEN k % 4 = 3 THEN ' ' ELSE concat({NL}, 'EDUCATION', {NL}) END,
         CASE k % 4 WHEN 0 THEN 'PhD in Statistics' WHEN 1 THEN 'MS Computer Science'
              WHEN 2 THEN 'Bachelor of Arts' ELSE 'Certificate' END,
         CASE WHEN k % 4 = 3 THEN ' ' WHEN k % 4 = 2 THEN concat({NL}, '  * Profile :', {NL})
              ELSE concat({NL}, 'Skills', {NL}) END,
         text) END AS resume_text
FROM (SELECT doc_id, text, n_chars AS k, CAST(1 + n_chars % 15 AS {INT}) AS years,
             CASE WHEN n_chars % 400 = 399 THEN 'UX Designer'
                  WHEN n_chars % 10 < 4 THEN 'Software Engineer'
                  WHEN n_chars % 10 < 7 THEN 'Data Scientist'
                  WHEN n_chars % 10 < 9 THEN 'DevOps Engineer'
                  ELSE 'Product Manager' END AS category,
             CASE WHEN doc_id % 5 = 0 THEN 'holdout' ELSE 'train' END AS data_source
      FROM documents) AS framed
"""

# Jobs: every benchmark text, with a skill list in front.
_JOBS = """
SELECT item_id AS job_id,
       concat('Wanted: ', CASE item_id % 5 WHEN 0 THEN 'Python, SQL and machine learning'
                               WHEN 1 THEN 'Java 17, REST and CI/CD' WHEN 2 THEN 'HTML5, TS and React'
                               WHEN 3 THEN 'K8s, Docker and AWS' ELSE 'people skills' END, '. ', text) AS job_text,
       CAST(0.5 + 0.1 * (item_id % 3) AS DOUBLE) AS shortlist_threshold,
       CAST(0.4 AS DOUBLE) AS review_threshold,
       CAST(10 - item_id % 4 AS {INT}) AS top_n,
       CAST(0.5 AS DOUBLE) AS skill_weight,
       CAST(0.5 AS DOUBLE) AS similarity_weight
FROM benchmark
"""

# Screening rows: candidate, job text and a recorded outcome with untidy names.
_SCREENING = """
SELECT r.resume_id,
       CASE WHEN r.resume_id % 11 = 0 THEN '  ui/ux  designer' WHEN r.resume_id % 11 = 1 THEN 'ml-ops   ENGINEER'
            WHEN r.resume_id % 11 = 2 THEN 'qa o''neil lead' WHEN r.resume_id % 11 = 3 THEN 'devops engineer'
            ELSE lower(r.category) END AS role,
       CASE WHEN r.resume_id % 3 = 0 THEN 'Here''s a professional resume for a Role: ' || r.resume_text
                                            || ' [mail me](mailto:a@b.example)'
            WHEN r.resume_id % 3 = 1 THEN '  HERE IS A resume for someone:' || {NL} || r.resume_text
            ELSE r.resume_text END AS resume,
       CASE WHEN r.resume_id % 2 = 0 THEN ' Select ' ELSE 'REJECT' END AS decision,
       CASE WHEN r.resume_id % 2 = 0 THEN 'fits' ELSE 'lacks skills' END AS reason_for_decision,
       j.job_text AS job_description
FROM (SELECT *, resume_id % (SELECT count(*) FROM benchmark) AS job_no FROM resumes) r
JOIN jobs j ON r.job_no = j.job_id
"""

# Predictions: language of a document guessed from its commonest little words.
_PREDICTIONS = """
SELECT doc_id AS id, lang AS label, data_source,
       CASE WHEN en >= fr AND en >= de AND en >= es THEN 'en' WHEN fr >= de AND fr >= es THEN 'fr'
            WHEN de >= es THEN 'de' ELSE 'es' END AS prediction,
       CAST(greatest(en, fr, de, es) AS DOUBLE) / (en + fr + de + es) AS confidence,
       CAST(de AS DOUBLE) / (en + fr + de + es) AS p_de, CAST(en AS DOUBLE) / (en + fr + de + es) AS p_en,
       CAST(es AS DOUBLE) / (en + fr + de + es) AS p_es, CAST(fr AS DOUBLE) / (en + fr + de + es) AS p_fr
FROM (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN 'holdout' ELSE 'train' END AS data_source,
             1 + length(t) - length(replace(t, 'th', 't')) AS en,
             1 + length(t) - length(replace(t, 'ou', 'o')) AS fr,
             1 + length(t) - length(replace(t, 'ei', 'e')) AS de,
             1 + length(t) - length(replace(t, 'ci', 'c')) AS es
      FROM (SELECT doc_id, lang, lower(text) AS t FROM documents) AS lowered) AS counted
"""

# Structured candidate profiles out of the part table.
_PROFILES = """
SELECT p_partkey AS candidate_id,
       CASE p_partkey % 8 WHEN 0 THEN 'Python, SQL' WHEN 1 THEN 'Java, Spring' WHEN 2 THEN 'JavaScript, React'
            WHEN 3 THEN 'TypeScript, Angular' WHEN 4 THEN 'AWS, Docker' WHEN 5 THEN 'SQL, R' WHEN 6 THEN NULL
            ELSE p_name END AS programming_languages,
       CAST(p_size AS {INT}) AS experience_years,
       CASE p_partkey % 3 WHEN 0 THEN 'machine data' WHEN 1 THEN 'Analysis' ELSE CAST(p_partkey % 7 AS {STR}) END
         AS projects,
       CAST(p_partkey % 4 AS {INT}) AS internships,
       CAST(p_retailprice AS DOUBLE) AS skills_score,
       p_brand AS company_type,
       CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN '' ELSE p_type END AS certifications,
       CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_partkey % 3 AS {INT}) END AS research_papers,
       CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'Masters' END AS education_level,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'Tier-2' END AS university_tier,
       CAST(6 + p_partkey % 4 AS DOUBLE) AS cgpa
FROM part
"""

# Job requests as a recruiter fills them in: any field may be empty.
_JOB_REQUESTS = """
SELECT item_id AS job_id,
       CASE WHEN item_id % 3 = 0 THEN '' ELSE 'Data Scientist' END AS job_title,
       CASE WHEN item_id % 6 = 0 THEN NULL WHEN item_id % 4 = 1 THEN 'Senior' ELSE '' END AS seniority,
       CAST(CASE WHEN item_id % 3 = 0 THEN 0 ELSE item_id % 12 END AS {INT}) AS experience_years,
       CASE WHEN item_id % 3 = 0 THEN '' ELSE 'Python, SQL' END AS required_skills,
       CASE WHEN item_id % 5 = 1 THEN 'Docker' ELSE '' END AS optional_skills,
       CASE WHEN item_id % 7 = 1 THEN 'retail' ELSE '' END AS industry,
       CASE WHEN item_id % 6 = 1 THEN 'Berlin' ELSE '' END AS location,
       CASE WHEN item_id % 6 = 3 THEN 'Masters' ELSE '' END AS education_level,
       CASE WHEN item_id % 6 = 5 THEN 'remote only' ELSE '' END AS remote_preference
FROM benchmark
"""

_TEMPLATES = {
    "resumes": _RESUMES,
    "jobs": _JOBS,
    "screening": _SCREENING,
    "predictions": _PREDICTIONS,
    "profiles": _PROFILES,
    "job_requests": _JOB_REQUESTS,
}
_NEEDS = {"screening": ["resumes", "jobs"]}
_BASE_TABLES = {
    "resumes": ["documents"],
    "jobs": ["benchmark"],
    "screening": ["documents", "benchmark"],
    "predictions": ["documents"],
    "profiles": ["part"],
    "job_requests": ["benchmark"],
}


def derived_sql(name: str, spark: bool) -> str:
    values = {"STR": "STRING" if spark else "VARCHAR", "INT": "INT" if spark else "INTEGER", "NL": "chr(10)"}
    return _TEMPLATES[name].format(**values)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived views as a DataFrame (named parameters, no global temp views)."""
    inputs = {t: table(spark, sf_dir, t) for t in _BASE_TABLES[name]}
    for needed in _NEEDS.get(name, []):
        inputs[needed] = derived(spark, sf_dir, needed)
    text = derived_sql(name, spark=True)
    for t in sorted(inputs, key=len, reverse=True):
        text = _use_parameter(text, t)
    return spark.sql(text, **inputs)


def _use_parameter(text: str, name: str) -> str:
    for word in ("FROM", "JOIN"):
        text = text.replace(f"{word} {name}", f"{word} {{{name}}}")
    return text


def with_views(sql: str, *names: str) -> str:
    """Put the named derived views in front of a DuckDB query as CTEs."""
    ordered: list[str] = []
    for name in names:
        for n in [*_NEEDS.get(name, []), name]:
            if n not in ordered:
                ordered.append(n)
    ctes = ", ".join(f"{n} AS MATERIALIZED ({derived_sql(n, spark=False)})" for n in ordered)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def fold(expression: str) -> str:
    """DuckDB: turn accented letters into a word character, for ASCII-only word classes."""
    return f"regexp_replace({expression}, '[\\x{{00C0}}-\\x{{024F}}]', '_', 'g')"
