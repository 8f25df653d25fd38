"""Queries of the text functions."""

from pyspark.sql import functions as F

from doclens import lexicon as lx
from doclens.catalog.base import derived, fold, query, quoted, table, with_views
from doclens.functions import text as tx
from doclens.operators import sentences, tokens
from doclens.session import written


def sql_replace(expression: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({expression}, {quoted(pattern)}, {quoted(replacement)}, 'g')"


def sql_aliases(text: str) -> str:
    out = fold(f"lower(coalesce({text}, ''))")
    for word, target in lx.ALIASES:
        out = sql_replace(out, rf"\b{word}\b", target)
    return out


def sql_terms(text: str) -> str:
    out = text
    for term, token in lx.PROTECTED_TERMS:
        out = sql_replace(out, rf"\b{lx.escaped(term)}\b", f" {token} ")
    for pattern, replacement in lx.VERSION_RULES:
        out = sql_replace(out, rf"\b{pattern}\b", " " + replacement.replace("$", "\\") + " ")
    return out


def sql_contacts(text: str) -> str:
    out = text
    for pattern in (lx.URL_PATTERN, lx.EMAIL_PATTERN, lx.PHONE_PATTERN):
        out = sql_replace(out, pattern, " ")
    return out


def sql_charset(text: str) -> str:
    return f"trim({sql_replace(sql_replace(text, '[^a-z0-9\\s]', ' '), '\\s+', ' ')})"


def sql_strip(text: str) -> str:
    return sql_replace(text, r"^\s+|\s+$", "")


def sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"


def sql_clean(text: str) -> str:
    return sql_charset(sql_contacts(sql_terms(sql_aliases(text))))


SQL_STOP_WORDS = "[" + ", ".join(quoted(w) for w in tx.default_stop_words()) + "]"


def sql_no_stop_words(text: str) -> str:
    return (
        f"array_to_string(list_filter({sql_words(text)}, "
        f"lambda w: NOT list_contains({SQL_STOP_WORDS}, w)), ' ')"
    )


def sql_skills(text: str) -> str:
    """Array of skills in lexicon order: one test per group, look-aheads by blanking first."""
    tests = []
    for skill, spellings in lx.SKILLS.items():
        parts = []
        for spelling in spellings:
            source = "expanded"
            if spelling in lx.NOT_FOLLOWED_BY:
                blanked = {"java": r"\bjava\s+script", "go": r"\bgo\s+(to|lang)", "cv": r"\bcv\s+engineer"}
                source = sql_replace("expanded", blanked[spelling], "_")
            parts.append(f"regexp_matches({source}, {quoted(chr(92) + 'b' + lx.spelling_pattern(spelling) + chr(92) + 'b')})")
        tests.append(f"CASE WHEN {' OR '.join(parts)} THEN {quoted(skill)} END")
    return f"list_filter([{', '.join(tests)}], lambda s: s IS NOT NULL)"


def _on_resumes(expression: str, name: str) -> str:
    return with_views(f"SELECT resume_id, {expression} AS {name} FROM resumes", "resumes")


def _on_documents(expression: str, name: str) -> str:
    return f"SELECT doc_id, {expression} AS {name} FROM documents"


@query("expand_aliases", _on_resumes(sql_aliases("resume_text"), "expanded"))
def _(spark, d):
    # the twin folds accented letters; fold here after the rules to compare like with like
    out = F.regexp_replace(tx.expand_aliases("resume_text"), r"[À-ɏ]", "_")
    return derived(spark, d, "resumes").select("resume_id", out.alias("expanded"))


@query("protect_terms", _on_resumes(sql_terms(fold("lower(coalesce(resume_text, ''))")), "protected"))
def _(spark, d):
    out = F.regexp_replace(tx.protect_terms("resume_text"), r"[À-ɏ]", "_")
    return derived(spark, d, "resumes").select("resume_id", out.alias("protected"))


@query("strip_contacts", _on_documents(sql_contacts(fold("text")), "stripped"))
def _(spark, d):
    out = F.regexp_replace(tx.strip_contacts("text"), r"[À-ɏ]", "_")
    return table(spark, d, "documents").select("doc_id", out.alias("stripped"))


@query("fold_charset", _on_documents(sql_charset("text"), "folded"))
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.fold_charset("text").alias("folded"))


@query("clean_text", _on_resumes(sql_clean("resume_text"), "cleaned"))
def _(spark, d):
    return derived(spark, d, "resumes").select("resume_id", tx.clean_text("resume_text").alias("cleaned"))


@query("clean_text_documents", _on_documents(sql_clean("text"), "cleaned"))
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clean_text("text").alias("cleaned"))


@query("remove_stopwords", _on_documents(sql_no_stop_words(sql_clean("text")), "kept"))
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.remove_stopwords(tx.clean_text("text")).alias("kept"))


_SENTENCES = f"array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda s: {sql_strip('s')}), lambda s: s <> ''), chr(10))"


@query("sentence_lines", _on_documents(_SENTENCES, "lines"))
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.sentence_lines("text").alias("lines"))


_TOKEN = quoted(f"^{sentences.OPENING}({sentences.WORD})(\\.?){sentences.CLOSING}$")
_LETTERS = "CAST(length(replace(word, '.', '')) AS DOUBLE)"
_ABBREVIATIONS = f"""
tokens AS (SELECT unnest(regexp_extract_all(lower(resume_text), '\\S+')) AS token FROM resumes),
counted AS (SELECT regexp_extract(token, {_TOKEN}, 1) AS word,
                   CAST(sum(CASE WHEN regexp_extract(token, {_TOKEN}, 2) = '.' THEN 1 ELSE 0 END) AS BIGINT) AS with_stop,
                   CAST(sum(CASE WHEN regexp_extract(token, {_TOKEN}, 2) = '.' THEN 0 ELSE 1 END) AS BIGINT) AS without_stop
            FROM tokens WHERE regexp_matches(token, {_TOKEN}) GROUP BY 1),
total AS (SELECT sum(with_stop) / sum(with_stop + without_stop) AS share FROM counted),
scored AS (SELECT word, with_stop, without_stop,
    -2 * (with_stop * ln(share / {sentences.CLINGS}) + without_stop * ln((1 - share) / (1 - {sentences.CLINGS})))
    * exp(-{_LETTERS}) * (length(word) - {_LETTERS} + 1) * pow({_LETTERS}, -without_stop) AS score FROM counted, total WHERE with_stop > 0),
known AS (SELECT * FROM scored WHERE score >= {sentences.THRESHOLD})"""
_LAST_WORD = f"lower(regexp_extract(p, {quoted(sentences.LAST_WORD)}, 1))"
_LEARNED_LINES = f"""
WITH {_ABBREVIATIONS},
listed AS (SELECT coalesce(list(word), []) AS words FROM known),
broken AS (SELECT resume_id, array_to_string(list_transform(regexp_extract_all(coalesce(resume_text, ''), {quoted(sentences.PIECE)}),
             lambda p: p || CASE WHEN list_contains(words, {_LAST_WORD}) THEN '' ELSE chr(10) END), '') AS joined FROM resumes, listed)
SELECT resume_id, array_to_string(list_filter(list_transform(string_split(joined, chr(10)), lambda s: {sql_strip('s')}),
                                              lambda s: s <> ''), chr(10)) AS lines FROM broken"""


@query(
    "abbreviations",
    with_views(f"WITH {_ABBREVIATIONS} SELECT word, with_stop, without_stop, round(score, 6) AS score FROM known", "resumes"),
)
def _(spark, d):
    found = sentences.abbreviations(derived(spark, d, "resumes"), "resume_text")
    return found.withColumn("score", F.round("score", 6))


@query("sentence_lines_abbreviations", with_views(_LEARNED_LINES, "resumes"))
def _(spark, d):
    resumes = derived(spark, d, "resumes")
    return sentences.sentence_lines(resumes, sentences.abbreviations(resumes, "resume_text"), "resume_text", "resume_id")


# The dictionaries come from the corpus: a word maps to a shorter form of itself that also occurs.
_WORDS = "SELECT DISTINCT unnest({words}) AS token FROM documents"
_LEMMAS = """
SELECT a.token AS token, b.token AS norm FROM corpus_words a JOIN corpus_words b ON a.token = b.token || 's'
"""
_STEMS = """
SELECT token, min(norm) AS norm FROM (
  SELECT token, CASE WHEN token LIKE '%ing' THEN left(token, length(token) - 3)
                     WHEN token LIKE '%tion' THEN left(token, length(token) - 3)
                     WHEN token LIKE '%ed' THEN left(token, length(token) - 2) END AS norm
  FROM corpus_words) AS cut
WHERE length(norm) >= 2 GROUP BY token
"""


def _dictionary(spark, d, text: str):
    cleaned = table(spark, d, "documents").select(tx.words(tx.clean_text("text")).alias("w"))
    words = written(cleaned.select(F.explode("w").alias("token")).distinct(), "corpus-words")  # joined with itself
    return spark.sql(text.replace("corpus_words", "{corpus_words}"), corpus_words=words)


def _token_twin(dictionary: str, cleaned: str) -> str:
    return f"""
WITH cleaned AS MATERIALIZED (SELECT doc_id, {sql_clean('text')} AS t FROM documents),
corpus_words AS MATERIALIZED (SELECT DISTINCT token FROM (SELECT unnest({sql_words('t')}) AS token FROM cleaned)),
dictionary AS MATERIALIZED ({dictionary}),
tokens AS (SELECT doc_id, unnest(w) AS token, unnest(generate_series(1, len(w))) AS pos
           FROM (SELECT doc_id, {sql_words(cleaned)} AS w FROM cleaned)),
joined AS (SELECT doc_id, string_agg(coalesce(norm, token), ' ' ORDER BY pos) AS n
           FROM tokens LEFT JOIN dictionary USING (token) GROUP BY doc_id)
SELECT doc_id, coalesce(n, '') AS normalized FROM cleaned LEFT JOIN joined USING (doc_id)
"""


def _normalized(spark, d, dictionary, stop_words=None):
    cleaned = table(spark, d, "documents").select("doc_id", tx.clean_text("text").alias("text"))
    return tokens.normalize_tokens(cleaned, _dictionary(spark, d, dictionary), stop_words=stop_words)


@query("normalize_tokens_lemma", _token_twin(_LEMMAS, "t"))
def _(spark, d):
    return _normalized(spark, d, _LEMMAS)


@query("normalize_tokens_stem", _token_twin(_STEMS, "t"))
def _(spark, d):
    return _normalized(spark, d, _STEMS)


@query("normalize_tokens_lemma_without_stopwords", _token_twin(_LEMMAS, sql_no_stop_words("t")))
def _(spark, d):
    return _normalized(spark, d, _LEMMAS, tx.default_stop_words())


# -- sections, by lines and windows ---------------------------------------------------

_HEADER_SQL = (
    r"(?i)^[\s#*]*(" + "|".join(sorted(lx.SECTION_HEADERS, key=len, reverse=True)) + r")\s*:?\s*$"
)
_FAMILIES = " ".join(f"WHEN {quoted(h)} THEN {quoted(s)}" for h, s in lx.SECTION_HEADERS.items())
SQL_SECTIONS = f"""
lines AS (SELECT resume_id, unnest(a) AS raw, unnest(generate_series(1, len(a))) AS pos
          FROM (SELECT resume_id, string_split(coalesce(resume_text, ''), chr(10)) AS a FROM resumes)),
stripped AS (SELECT resume_id, pos, {sql_strip('raw')} AS line FROM lines),
marked AS (SELECT resume_id, pos, line,
                  CASE lower(regexp_extract(line, {quoted(_HEADER_SQL)}, 1)) {_FAMILIES} END AS header
           FROM stripped WHERE line <> ''),
filled AS (SELECT *, coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY resume_id ORDER BY pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'other') AS section
           FROM marked),
firsts AS (SELECT resume_id, section, min(pos) AS first_pos FROM filled GROUP BY resume_id, section
           UNION ALL SELECT resume_id, 'other', 0 FROM resumes),
contents AS (SELECT resume_id, section, string_agg(line, ' ' ORDER BY pos) AS content
             FROM filled WHERE header IS NULL GROUP BY resume_id, section),
sections AS (SELECT c.resume_id, c.section, c.content,
                    row_number() OVER (PARTITION BY c.resume_id ORDER BY f.first_pos) - 1 AS ord
             FROM contents c JOIN (SELECT resume_id, section, min(first_pos) AS first_pos FROM firsts GROUP BY ALL) f
               ON c.resume_id = f.resume_id AND c.section = f.section)
"""


@query(
    "parse_sections",
    with_views(f"WITH {SQL_SECTIONS} SELECT resume_id, CAST(ord AS BIGINT) AS ord, section, content FROM sections", "resumes"),
)
def _(spark, d):
    return tokens.parse_sections_long(derived(spark, d, "resumes"), "resume_text", "resume_id").withColumn(
        "ord", F.col("ord").cast("long")
    )


SQL_WEIGHTED = f"""
{SQL_SECTIONS},
repeated AS (SELECT resume_id, ord, content, CASE WHEN section IN ('experience', 'skills', 'projects') THEN 2 ELSE 1 END AS times,
                    section FROM sections),
weights AS (SELECT resume_id, bool_and(section = 'other') AS plain,
                   string_agg(CASE WHEN times = 2 THEN content || ' ' || content ELSE content END, ' ' ORDER BY ord) AS weighted
            FROM repeated GROUP BY resume_id),
weighted AS (SELECT r.resume_id, CASE WHEN w.plain IS NULL OR w.plain THEN coalesce(r.resume_text, '') ELSE w.weighted END AS t
             FROM resumes r LEFT JOIN weights w ON r.resume_id = w.resume_id)
"""


@query("section_weighted_text", with_views(f"WITH {SQL_WEIGHTED} SELECT resume_id, t AS weighted FROM weighted", "resumes"))
def _(spark, d):
    return derived(spark, d, "resumes").select("resume_id", tx.section_weighted_text("resume_text").alias("weighted"))


SQL_PREPROCESSED = f"""
{SQL_WEIGHTED},
preprocessed AS (SELECT resume_id, {sql_no_stop_words('c')} AS cleaned_text
                 FROM (SELECT resume_id, {sql_clean('t')} AS c FROM weighted))
"""


@query(
    "preprocess_documents",
    with_views(f"WITH {SQL_PREPROCESSED} SELECT resume_id, cleaned_text FROM preprocessed", "resumes"),
)
def _(spark, d):
    resumes = derived(spark, d, "resumes").select("resume_id", "resume_text")
    return tokens.preprocess_documents(resumes, "resume_text", "resume_id").select("resume_id", "cleaned_text")


@query(
    "preprocess_documents_lemma",
    with_views(
        f"""WITH {SQL_PREPROCESSED},
        plain AS MATERIALIZED (SELECT {sql_clean('text')} AS t FROM documents),
        corpus_words AS MATERIALIZED (SELECT DISTINCT token FROM (SELECT unnest({sql_words('t')}) AS token FROM plain)),
        dictionary AS MATERIALIZED ({_LEMMAS}),
        tokens AS (SELECT resume_id, unnest(w) AS token, unnest(generate_series(1, len(w))) AS pos
                   FROM (SELECT resume_id, {sql_words('cleaned_text')} AS w FROM preprocessed)),
        joined AS (SELECT resume_id, string_agg(coalesce(norm, token), ' ' ORDER BY pos) AS n
                   FROM tokens LEFT JOIN dictionary USING (token) GROUP BY resume_id)
        SELECT resume_id, coalesce(n, '') AS cleaned_text FROM preprocessed LEFT JOIN joined USING (resume_id)""",
        "resumes",
    ),
)
def _(spark, d):
    resumes = derived(spark, d, "resumes").select("resume_id", "resume_text")
    done = tokens.preprocess_documents(resumes, "resume_text", "resume_id", dictionary=_dictionary(spark, d, _LEMMAS))
    return done.select("resume_id", "cleaned_text")


@query(
    "preprocess_documents_tokens",
    with_views(
        f"WITH {SQL_PREPROCESSED} SELECT resume_id, CAST(len({sql_words('cleaned_text')}) AS BIGINT) AS n_tokens, "
        f"array_to_string({sql_words('cleaned_text')}, '|') AS tokens FROM preprocessed",
        "resumes",
    ),
)
def _(spark, d):
    resumes = derived(spark, d, "resumes").select("resume_id", "resume_text")
    done = tokens.preprocess_documents(resumes, "resume_text", "resume_id", return_tokens=True)
    return done.select(
        "resume_id",
        F.size("cleaned_text").cast("long").alias("n_tokens"),
        F.array_join("cleaned_text", "|").alias("tokens"),
    )


@query(
    "extract_skills",
    with_views(
        f"SELECT resume_id, array_to_string({sql_skills('')}, '|') AS skills "
        f"FROM (SELECT resume_id, {sql_aliases('resume_text')} AS expanded FROM resumes)",
        "resumes",
    ),
)
def _(spark, d):
    skills = F.array_join(tx.extract_skills("resume_text"), "|")
    return derived(spark, d, "resumes").select("resume_id", skills.alias("skills"))


@query(
    "extract_skills_documents",
    f"SELECT doc_id, array_to_string({sql_skills('')}, '|') AS skills "
    f"FROM (SELECT doc_id, {sql_aliases('text')} AS expanded FROM documents)",
)
def _(spark, d):
    skills = F.array_join(tx.extract_skills("text"), "|")
    return table(spark, d, "documents").select("doc_id", skills.alias("skills"))
