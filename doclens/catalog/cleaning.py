"""Queries of the cleaning operators and dataset adapters."""

from pyspark.sql import functions as F

from doclens import lexicon as lx
from doclens.catalog.base import derived, query, quoted, table, with_views
from doclens.catalog.text import sql_replace, sql_strip
from doclens.functions import text as tx
from doclens.operators import clean, rank
from doclens.plans import prepare

_NOT_BLANK = "regexp_matches({0}, '\\S')"


@query(
    "dedup_exact",
    "SELECT doc_id, text, lang FROM documents "
    "QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
)
def _(spark, d):
    return clean.dedup_exact(table(spark, d, "documents").select("doc_id", "text", "lang"), "text", "doc_id")


@query(
    "clean_documents",
    with_views(
        f"""SELECT resume_id, category, resume_text FROM resumes
        WHERE {_NOT_BLANK.format('resume_text')} AND {_NOT_BLANK.format('category')}
        QUALIFY row_number() OVER (PARTITION BY resume_text ORDER BY resume_id) = 1""",
        "resumes",
    ),
)
def _(spark, d):
    raw = derived(spark, d, "resumes").select(
        "resume_id", F.col("category").alias("job_title"), F.col("resume_text").alias("content")
    )
    return clean.clean_documents(raw, id_column="resume_id").select("resume_id", "category", "resume_text")


@query(
    "normalize_columns",
    with_views(
        "SELECT resume_id, role AS category, resume AS resume_text, decision AS screening_decision, "
        "reason_for_decision, job_description FROM screening",
        "screening",
    ),
)
def _(spark, d):
    untidy = derived(spark, d, "screening").toDF(
        "resume_id", " Role", "Resume ", "DECISION", "Reason for decision", "Job Description"
    )
    return clean.normalize_columns(untidy)


def sql_preamble(text: str) -> str:
    out = sql_strip(f"coalesce({text}, '')")
    for pattern in lx.PREAMBLES:
        out = f"regexp_replace({out}, {quoted(pattern)}, '', 'i')"
    out = sql_replace(out, lx.MARKDOWN_LINK, r"\1")
    return sql_strip(sql_replace(out, r"\s+", " "))


def sql_role(role: str) -> str:
    collapsed = sql_strip(sql_replace(role, r"\s+", " "))
    fixes = " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in lx.ROLE_ACRONYMS.items())
    titled = (
        "array_to_string(list_transform(regexp_extract_all(p, '\\p{L}+|[^\\p{L}]+'), "
        "lambda r: upper(left(r, 1)) || lower(substr(r, 2))), '')"
    )
    return (
        f"array_to_string(list_transform(list_transform(regexp_extract_all({collapsed}, '[ \\-]|[^ \\-]+'), "
        f"lambda p: {titled}), lambda t: CASE t {fixes} ELSE t END), '')"
    )


@query(
    "strip_preamble",
    with_views(f"SELECT resume_id, {sql_preamble('resume')} AS stripped FROM screening", "screening"),
)
def _(spark, d):
    return derived(spark, d, "screening").select("resume_id", tx.strip_preamble("resume").alias("stripped"))


@query("normalize_role", with_views(f"SELECT resume_id, {sql_role('role')} AS category FROM screening", "screening"))
def _(spark, d):
    return derived(spark, d, "screening").select("resume_id", tx.normalize_role("role").alias("category"))


@query(
    "normalize_decision",
    with_views("SELECT resume_id, lower(trim(decision)) AS screening_decision FROM screening", "screening"),
)
def _(spark, d):
    return derived(spark, d, "screening").select(
        "resume_id", tx.normalize_decision("decision").alias("screening_decision")
    )


@query(
    "filter_min_length",
    with_views(
        "SELECT resume_id, category FROM resumes WHERE length(resume_text) >= 50 AND length(category) > 0", "resumes"
    ),
)
def _(spark, d):
    return clean.filter_min_length(derived(spark, d, "resumes")).select("resume_id", "category")


@query(
    "filter_rare_categories",
    with_views(
        "SELECT resume_id, category FROM resumes QUALIFY count(*) OVER (PARTITION BY category) >= 5", "resumes"
    ),
)
def _(spark, d):
    return clean.filter_rare_categories(derived(spark, d, "resumes").select("resume_id", "category"))


SQL_HASH = "md5('42|' || {0})"

# stratified holdout: a share per category, topped up from the rest in hash order
SQL_STRATIFIED = """
sized AS (SELECT *, {hash} AS h, count(*) OVER (PARTITION BY category) AS n_c, count(*) OVER () AS n FROM {source}),
first AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY h)
                    <= greatest(1, floor(n_c * CAST(0.2 AS DOUBLE))) AS held FROM sized),
topped AS (SELECT *, row_number() OVER (PARTITION BY held ORDER BY h)
                     <= greatest(1, floor(n * CAST(0.2 AS DOUBLE))) - (SELECT count(*) FROM first WHERE held) AS extra
           FROM first),
tagged AS (SELECT *, CASE WHEN held OR extra THEN 'holdout' ELSE 'train' END AS data_source FROM topped)
"""


@query(
    "adapt_screening_table",
    with_views(
        f"""WITH cleaned AS (SELECT resume_id, {sql_preamble('resume')} AS resume_text, {sql_role('role')} AS category,
                lower(trim(decision)) AS screening_decision, reason_for_decision, job_description FROM screening),
        unique_rows AS (SELECT * FROM cleaned WHERE length(resume_text) >= 50 AND length(category) > 0
                        QUALIFY row_number() OVER (PARTITION BY resume_text ORDER BY resume_id) = 1),
        frequent AS (SELECT * FROM unique_rows QUALIFY count(*) OVER (PARTITION BY category) >= 5),
        {SQL_STRATIFIED.format(hash=SQL_HASH.format('resume_id'), source='frequent')}
        SELECT resume_id, resume_text, category, data_source, screening_decision, reason_for_decision, job_description
        FROM tagged""",
        "screening",
    ),
)
def _(spark, d):
    return prepare.adapt_screening_table(derived(spark, d, "screening"))


_SQL_PROFILE_TEXT = """concat_ws(' ',
  'Professional with ' || experience_years || ' years of experience.',
  'Skilled in ' || programming_languages || '.',
  'Completed ' || projects || ' major projects and ' || internships || ' internships.',
  CASE WHEN length(certifications) > 0 THEN 'Holds certifications in ' || certifications || '.' END,
  CASE WHEN research_papers > 0 THEN 'Author of ' || research_papers || ' research papers.' END,
  'Education: ' || coalesce(education_level, 'Graduate') || ' from ' || coalesce(university_tier, 'Tier-1')
    || ' university with CGPA ' || cgpa || '.')"""
_SQL_INFER = """CASE
  WHEN lower(coalesce(programming_languages, '')) LIKE '%python%' AND (projects LIKE '%machine%' OR projects LIKE '%data%')
    THEN 'Data Scientist'
  WHEN lower(coalesce(programming_languages, '')) LIKE '%java%' OR lower(coalesce(programming_languages, '')) LIKE '%spring%'
    THEN 'Backend Developer'
  WHEN regexp_matches(lower(coalesce(programming_languages, '')), 'javascript|react|angular') THEN 'Frontend Developer'
  WHEN regexp_matches(lower(coalesce(programming_languages, '')), 'devops|aws|docker') THEN 'DevOps Engineer'
  WHEN lower(coalesce(programming_languages, '')) LIKE '%sql%' AND lower(projects) LIKE '%analysis%' THEN 'Data Analyst'
  ELSE CASE candidate_id % 5 WHEN 0 THEN 'Software Engineer' WHEN 1 THEN 'Full Stack Developer'
       WHEN 2 THEN 'Backend Developer' WHEN 3 THEN 'Data Analyst' ELSE 'Product Manager' END END"""


@query("profile_to_text", with_views(f"SELECT candidate_id, {_SQL_PROFILE_TEXT} AS resume_text FROM profiles", "profiles"))
def _(spark, d):
    profiles = derived(spark, d, "profiles")
    return profiles.select("candidate_id", clean.profile_to_text(profiles).alias("resume_text"))


@query("infer_category", with_views(f"SELECT candidate_id, {_SQL_INFER} AS category FROM profiles", "profiles"))
def _(spark, d):
    return derived(spark, d, "profiles").select("candidate_id", clean.infer_category().alias("category"))


@query(
    "adapt_profiles",
    with_views(
        f"SELECT candidate_id, {_SQL_PROFILE_TEXT} AS resume_text, {_SQL_INFER} AS category FROM profiles", "profiles"
    ),
)
def _(spark, d):
    return prepare.adapt_profiles(derived(spark, d, "profiles"))


SQL_JOB_TEXT = """coalesce(nullif(trim(concat_ws('. ',
  CASE WHEN job_title <> '' THEN 'Looking for a ' || job_title END,
  CASE WHEN seniority <> '' THEN seniority || ' level' END,
  CASE WHEN experience_years <> 0 THEN 'with at least ' || experience_years || ' years of experience' END,
  CASE WHEN industry <> '' THEN 'in the ' || industry || ' industry' END,
  CASE WHEN location <> '' THEN 'based in ' || location END,
  CASE WHEN education_level <> '' THEN 'with ' || education_level || ' education' END,
  CASE WHEN remote_preference <> '' THEN remote_preference END,
  CASE WHEN required_skills <> '' THEN 'Required skills: ' || required_skills END,
  CASE WHEN optional_skills <> '' THEN 'Preferred skills: ' || optional_skills END)), ''),
  'Looking for a qualified candidate with relevant skills and experience.')"""


@query("build_job_text", with_views(f"SELECT job_id, {SQL_JOB_TEXT} AS job_text FROM job_requests", "job_requests"))
def _(spark, d):
    return derived(spark, d, "job_requests").select("job_id", rank.build_job_text().alias("job_text"))


@query(
    "coalesce_text",
    with_views("SELECT resume_id, coalesce(resume_text, category, '') AS resume_text FROM resumes", "resumes"),
)
def _(spark, d):
    return derived(spark, d, "resumes").select(
        "resume_id", tx.coalesce_texts("resume_text", "category").alias("resume_text")
    )


@query(
    "truncate_text",
    with_views("SELECT resume_id, left(coalesce(resume_text, ''), 3000) AS head FROM resumes", "resumes"),
)
def _(spark, d):
    return derived(spark, d, "resumes").select("resume_id", tx.truncate_text("resume_text").alias("head"))
