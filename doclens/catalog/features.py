"""Queries of the numeric features, vectors and labels."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from doclens import lexicon as lx
from doclens.catalog.base import AS_OF_YEAR, derived, fold, query, quoted, table, with_views
from doclens.catalog.cleaning import SQL_HASH
from doclens.catalog.text import SQL_SECTIONS, SQL_STOP_WORDS, sql_aliases, sql_skills, sql_words
from doclens.functions import features as ft
from doclens.functions import text as tx
from doclens.operators import semantic, vectors
from doclens.session import written

_LOWER = fold("lower(coalesce(resume_text, ''))")


def _ints(text: str, pattern: str) -> str:
    return f"list_transform(regexp_extract_all({text}, {quoted(pattern)}, 1), lambda x: CAST(x AS INTEGER))"


def _any(text: str, words: list[str]) -> str:
    return f"regexp_matches({text}, {quoted(lx.any_word(words))})"


SQL_YEARS = f"""CAST(coalesce(list_max(list_concat(list_concat(
    {_ints(_LOWER, lx.YEARS_PHRASE)}, {_ints(_LOWER, lx.YEARS_AT_LEAST)}),
    list_filter(list_transform(list_zip(regexp_extract_all({_LOWER}, {quoted(lx.YEARS_RANGE)}, 1),
                                        regexp_extract_all({_LOWER}, {quoted(lx.YEARS_RANGE)}, 2)),
      lambda z: coalesce(TRY_CAST(z[2] AS INTEGER), {AS_OF_YEAR}) - CAST(z[1] AS INTEGER)), lambda g: g >= 0))), 0) AS DOUBLE)"""
SQL_EDUCATION = (
    "CASE "
    + " ".join(
        f"WHEN {_any(_LOWER, [k for k, v in lx.EDUCATION_LEVELS.items() if v == level])} THEN {level}"
        for level in (5, 4, 3, 2, 1)
    )
    + " ELSE 0 END"
)
_RAW = fold("coalesce(resume_text, '')")
_LATEST = f"list_max({_ints(_RAW, lx.YEAR_TOKEN)})"
SQL_RECENCY = (
    f"CASE WHEN {_LATEST} IS NULL THEN CAST(0 AS DOUBLE) "
    f"ELSE greatest(CAST(0 AS DOUBLE), 1 - greatest(0, {AS_OF_YEAR} - {_LATEST}) / CAST(15 AS DOUBLE)) END"
)
SQL_TITLES = {
    f"job_title_{family}": f"CASE WHEN {_any(_LOWER, words)} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    for family, words in lx.JOB_TITLES.items()
}
_N_WORDS = "greatest(len(" + sql_words("coalesce(resume_text, '')") + "), 1)"
_WITH_SKILLS = (
    f"SELECT *, len({sql_skills('')}) AS n_skills FROM (SELECT *, {sql_aliases('resume_text')} AS expanded FROM resumes)"
)
SQL_STRUCTURED = f"""structured AS (SELECT resume_id, {SQL_YEARS} AS years_experience,
    CAST({SQL_EDUCATION} AS DOUBLE) AS education_level, CAST(n_skills AS DOUBLE) AS skill_count,
    CAST(n_skills AS DOUBLE) / {_N_WORDS} * 100 AS skill_density, {SQL_RECENCY} AS recency_score,
    CAST(0 AS DOUBLE) AS experience_section_ratio, CAST(0 AS DOUBLE) AS skills_section_ratio,
    {', '.join(f'{v} AS {k}' for k, v in SQL_TITLES.items())}
    FROM ({_WITH_SKILLS}))"""


def _resumes(spark, d):
    return derived(spark, d, "resumes").select("resume_id", "category", "data_source", "resume_text")


@query("years_experience", with_views(f"SELECT resume_id, {SQL_YEARS} AS years_experience FROM resumes", "resumes"))
def _(spark, d):
    return _resumes(spark, d).select(
        "resume_id", ft.years_experience("resume_text", AS_OF_YEAR).alias("years_experience")
    )


@query(
    "education_level",
    with_views(f"SELECT resume_id, CAST({SQL_EDUCATION} AS BIGINT) AS education_level FROM resumes", "resumes"),
)
def _(spark, d):
    return _resumes(spark, d).select(
        "resume_id", ft.education_level("resume_text").cast("long").alias("education_level")
    )


@query(
    "skill_metrics",
    with_views(
        f"""SELECT resume_id, CAST(n_skills AS DOUBLE) AS skill_count,
        round(CAST(n_skills AS DOUBLE) / {_N_WORDS} * 100, 6) AS skill_density FROM ({_WITH_SKILLS})""",
        "resumes",
    ),
)
def _(spark, d):
    skilled = _resumes(spark, d).withColumn("skills", tx.extract_skills("resume_text"))
    return skilled.select(
        "resume_id",
        ft.skill_count("skills").alias("skill_count"),
        F.round(ft.skill_density("resume_text", "skills"), 6).alias("skill_density"),
    )


@query(
    "recency_score",
    with_views(f"SELECT resume_id, round({SQL_RECENCY}, 6) AS recency_score FROM resumes", "resumes"),
)
def _(spark, d):
    score = F.round(ft.recency_score("resume_text", AS_OF_YEAR), 6)
    return _resumes(spark, d).select("resume_id", score.alias("recency_score"))


@query(
    "job_title_signals",
    with_views(f"SELECT resume_id, {', '.join(f'{v} AS {k}' for k, v in SQL_TITLES.items())} FROM resumes", "resumes"),
)
def _(spark, d):
    signals = [c.alias(name) for name, c in ft.job_title_signals("resume_text").items()]
    return _resumes(spark, d).select("resume_id", *signals)


_SECTION_WORDS = f"len({sql_words('content')})"


@query(
    "section_ratios",
    with_views(
        f"""WITH {SQL_SECTIONS},
        sums AS (SELECT resume_id, sum({_SECTION_WORDS}) AS total,
                        coalesce(sum({_SECTION_WORDS}) FILTER (WHERE section = 'experience'), 0) AS e,
                        coalesce(sum({_SECTION_WORDS}) FILTER (WHERE section = 'skills'), 0) AS s
                 FROM sections GROUP BY resume_id)
        SELECT r.resume_id, round(coalesce(CAST(e AS DOUBLE) / total, 0), 6) AS experience_section_ratio,
               round(coalesce(CAST(s AS DOUBLE) / total, 0), 6) AS skills_section_ratio
        FROM resumes r LEFT JOIN sums ON r.resume_id = sums.resume_id""",
        "resumes",
    ),
)
def _(spark, d):
    ratios = _resumes(spark, d).select("resume_id", ft.section_ratios("resume_text").alias("r"))
    return ratios.select(
        "resume_id",
        F.round("r.experience", 6).alias("experience_section_ratio"),
        F.round("r.skills", 6).alias("skills_section_ratio"),
    )


def _featured(spark, d):
    return vectors.structured_features(_resumes(spark, d), as_of_year=AS_OF_YEAR)


def _rounded(columns):
    return [F.round(c, 6).alias(c) for c in columns]


@query(
    "structured_features",
    with_views(
        f"WITH {SQL_STRUCTURED} SELECT resume_id, {', '.join(f'round({c}, 6) AS {c}' for c in lx.FEATURE_COLUMNS)} FROM structured",
        "resumes",
    ),
)
def _(spark, d):
    return _featured(spark, d).select("resume_id", *_rounded(lx.FEATURE_COLUMNS))


_SCALED = ", ".join(
    f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 1e-12 THEN stddev_pop({c}) OVER () ELSE 1 END AS {c}"
    for c in lx.FEATURE_COLUMNS
)


@query(
    "scale_features",
    with_views(
        f"""WITH {SQL_STRUCTURED}, scaled AS (SELECT resume_id, {_SCALED} FROM structured)
        SELECT resume_id, {', '.join(f'round({c}, 6) AS {c}' for c in lx.FEATURE_COLUMNS)} FROM scaled""",
        "resumes",
    ),
)
def _(spark, d):
    featured = _featured(spark, d).select("resume_id", *lx.FEATURE_COLUMNS)
    featured = written(featured, "featured")  # read by the fit and by the scaling
    scaled = vectors.scale_features(featured, vectors.fit_scaler(featured))
    # adding zero turns a negative zero into a plain one
    return scaled.select("resume_id", *[(F.round(c, 6) + 0.0).alias(c) for c in lx.FEATURE_COLUMNS])


# -- vectors -----------------------------------------------------------------------------


def sql_buckets(source: str, key: str, text: str) -> str:
    """``(key, bucket, c)``: token counts per hash bucket."""
    tokens = f"regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+')"
    return f"""SELECT {key}, bucket, count(*) AS c FROM (
        SELECT {key}, CAST('0x' || substr(md5(token), 1, 7) AS BIGINT) % {lx.EMBEDDING_DIM} AS bucket FROM (
          SELECT {key}, unnest(CASE WHEN len(t) = 0 THEN ['empty'] ELSE t END) AS token
          FROM (SELECT {key}, {tokens} AS t FROM {source})))
      GROUP BY {key}, bucket"""


SQL_EMBEDDED = f"""embedded AS (SELECT resume_id, bucket,
    CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY resume_id)) AS FLOAT) AS DOUBLE) AS weight
    FROM ({sql_buckets('resumes', 'resume_id', 'resume_text')}))"""


@query(
    "embed_documents",
    with_views(f"WITH {SQL_EMBEDDED} SELECT resume_id, bucket, round(weight, 6) AS weight FROM embedded", "resumes"),
)
def _(spark, d):
    embedded = vectors.embed_documents(_resumes(spark, d).select("resume_id", "resume_text"))
    long_form = embedded.select("resume_id", F.posexplode("embedding").alias("bucket", "weight"))
    return long_form.filter("weight > 0").select(
        "resume_id", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("weight").cast("double"), 6).alias("weight")
    )


@query(
    "assemble_features",
    with_views(
        f"""WITH {SQL_EMBEDDED}, {SQL_STRUCTURED}, scaled AS (SELECT resume_id, {_SCALED} FROM structured),
        joined AS (SELECT resume_id, bucket AS slot, weight AS value FROM embedded UNION ALL
        {' UNION ALL '.join(f'SELECT resume_id, {lx.EMBEDDING_DIM + i}, {c} FROM scaled' for i, c in enumerate(lx.FEATURE_COLUMNS))})
        SELECT resume_id, CAST(slot AS BIGINT) AS slot, round(value, 5) AS value FROM joined WHERE abs(value) > 1e-9""",
        "resumes",
    ),
)
def _(spark, d):
    featured = written(_featured(spark, d).select("resume_id", "resume_text", *lx.FEATURE_COLUMNS), "featured")
    scaled = vectors.scale_features(featured, vectors.fit_scaler(featured))
    assembled = vectors.assemble_features(vectors.embed_documents(scaled), "embedding", lx.FEATURE_COLUMNS)
    slots = assembled.select("resume_id", F.posexplode(vector_to_array("features")).alias("slot", "value"))
    return slots.filter(F.abs("value") > 1e-9).select(
        "resume_id", F.col("slot").cast("long").alias("slot"), F.round("value", 5).alias("value")
    )


_SQL_TFIDF = f"""
WITH words AS (SELECT doc_id, list_filter(regexp_extract_all({fold('lower(text)')}, '\\b[a-z][a-z0-9]+\\b'),
                                          lambda t: NOT list_contains({SQL_STOP_WORDS}, t)) AS w FROM documents),
terms AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
          FROM words),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
vocabulary AS MATERIALIZED (
  SELECT term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY term
  HAVING count(*) >= 2 AND count(*) <= CAST(0.95 AS DOUBLE) * (SELECT n FROM n)
  ORDER BY cf DESC, term LIMIT {lx.TFIDF_MAX_TERMS}),
weighted AS (SELECT doc_id, term, tf * (ln((1.0 + n) / CAST(1 + df AS DOUBLE)) + 1) AS w
             FROM tf JOIN vocabulary USING (term), n)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM weighted
"""


@query("tfidf", _SQL_TFIDF)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = vectors.fit_tfidf(docs, "text")
    return model.long_form(docs, "text", "doc_id").withColumn("weight", F.round("weight", 6))


# Cosines of the documents' TF-IDF vectors with the one of the smallest id that has a term: what the embeddings keep of
# them and what lies outside the basis make up the whole.
_COSINES = _SQL_TFIDF.replace(
    "SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM weighted",
    """, unit AS MATERIALIZED (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM weighted),
    first AS (SELECT term, w AS v FROM unit WHERE doc_id = (SELECT min(doc_id) FROM unit))
    SELECT d.doc_id, round(coalesce(sum(w * v), 0) + 0.0, 3) AS cosine
    FROM documents d LEFT JOIN unit USING (doc_id) LEFT JOIN first USING (term) GROUP BY d.doc_id""",
)


_FIRST_DOCUMENTS = 1000


@query("embed_documents_semantic", _COSINES)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = semantic.fit_semantic(docs, "text")
    first = []
    for some in (docs.orderBy("doc_id").limit(_FIRST_DOCUMENTS), docs):  # the first document that has a term is likely among the first
        if model.tfidf.terms and not first:
            weighted = model.tfidf.transform(some, "text", "v").select("doc_id", F.unwrap_udt("v").alias("v"))
            first = weighted.filter(F.exists("v.values", lambda x: x != 0)).orderBy("doc_id").limit(1).collect()
    weights = dict(zip(first[0]["v"]["indices"], first[0]["v"]["values"])) if first else {}
    embedded = model.transform(docs, "text", cosine="cosine", to=weights)
    return embedded.select("doc_id", (F.round("cosine", 3) + 0.0).alias("cosine"))


# documents with a term have unit length, others are zero
_UNIT_LENGTHS = _SQL_TFIDF.replace(
    "SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM weighted",
    f"""SELECT CAST({lx.EMBEDDING_DIM} AS BIGINT) AS dims, count(*) AS documents,
    count(CASE WHEN doc_id IN (SELECT doc_id FROM weighted) THEN 1 END) AS unit FROM documents""",
)


@query("fit_semantic", _UNIT_LENGTHS)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    embedded = semantic.fit_semantic(docs, "text").transform(docs, "text")
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return embedded.select(F.size("embedding").cast("long").alias("dims"), norm.alias("n")).groupBy("dims").agg(
        F.count(F.lit(1)).alias("documents"), F.count(F.when(F.abs(F.col("n") - 1) < 1e-4, 1)).alias("unit")
    )


@query(
    "encode_labels",
    with_views(
        "SELECT resume_id, category, dense_rank() OVER (ORDER BY category) - 1 AS code FROM resumes", "resumes"
    ),
)
def _(spark, d):
    return vectors.encode_labels(_resumes(spark, d).select("resume_id", "category")).select(
        "resume_id", "category", "code"
    )


@query(
    "decode_labels",
    with_views("SELECT resume_id, category FROM resumes", "resumes"),
)
def _(spark, d):
    rows = _resumes(spark, d).select("resume_id", "category")
    codes = vectors.label_codes(rows)
    encoded = vectors.encode_labels(rows, codes=codes).select("resume_id", "code")
    return vectors.decode_labels(encoded, codes).select("resume_id", "category")


@query(
    "class_weights",
    with_views(
        """SELECT category, CAST(count(*) AS BIGINT) AS n,
        round((SELECT count(*) FROM resumes) / (CAST((SELECT count(DISTINCT category) FROM resumes) AS DOUBLE) * count(*)), 6)
          AS weight FROM resumes GROUP BY category""",
        "resumes",
    ),
)
def _(spark, d):
    from doclens.operators import classify

    weighted = classify.class_weights(_resumes(spark, d).select("resume_id", "category"), "category")
    return weighted.select("category", "n", F.round("weight", 6).alias("weight"))
