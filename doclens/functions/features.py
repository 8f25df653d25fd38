"""Numeric features read out of document text."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclens import lexicon as lx
from doclens.functions.text import (
    UNICODE,
    ColumnLike,
    as_column,
    bind,
    extract_skills,
    parse_sections,
    text_or_empty,
    word_count,
)


def _year(as_of_year: int | None) -> int:
    return date.today().year if as_of_year is None else as_of_year


def _all_numbers(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract_all(text, F.lit(UNICODE + pattern), F.lit(group))
    return F.transform(found, lambda s: s.try_cast("int"))


def years_experience(text: ColumnLike, as_of_year: int | None = None) -> Column:
    """Largest of the stated years and the year ranges; 0 when there is none."""
    now = F.lit(_year(as_of_year))

    def longest(t: Column) -> Column:
        none = F.array().cast("array<int>")
        named = t.contains("year") | t.contains("yr")
        range_pattern = UNICODE + lx.YEARS_RANGE
        # the ranges are cut out in one scan and read from the short pieces
        pieces = F.when(
            t.contains("19") | t.contains("20"), F.regexp_extract_all(t, F.lit(range_pattern), F.lit(0))
        ).otherwise(F.array().cast("array<string>"))
        spans = F.transform(
            pieces,
            lambda p: F.coalesce(F.regexp_extract(p, range_pattern, 2).try_cast("int"), now)
            - F.regexp_extract(p, range_pattern, 1).try_cast("int"),
        )
        least = named & (t.contains("over") | t.contains("more than") | t.contains("at least"))
        years = F.concat(
            F.when(named, _all_numbers(t, lx.YEARS_PHRASE)).otherwise(none),
            F.when(least, _all_numbers(t, lx.YEARS_AT_LEAST)).otherwise(none),
            F.filter(spans, lambda s: s >= 0),
        )
        return F.coalesce(F.array_max(years), F.lit(0)).cast("double")

    return bind(F.lower(text_or_empty(text)), longest)


_SIGNALS = UNICODE + lx.signal_pattern()


def signal_words(text: ColumnLike) -> Column:
    """Keywords of education levels and job titles that occur as whole words, found in one scan.

    This is exact because no keyword contains or overlaps another one.
    """
    return F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(_SIGNALS), F.lit(0)))


def _has(found: Column, keywords: list[str]) -> Column:
    return F.arrays_overlap(found, F.array(*[F.lit(k) for k in keywords]))


def _education(found: Column) -> Column:
    chain = F.lit(0)
    for level in sorted(set(lx.EDUCATION_LEVELS.values())):
        chain = F.when(_has(found, [k for k, v in lx.EDUCATION_LEVELS.items() if v == level]), F.lit(level)).otherwise(chain)
    return chain.cast("int")


def education_level(text: ColumnLike) -> Column:
    """Highest education level whose keyword occurs as a whole word; 0 when there is none."""
    return bind(signal_words(text), _education)


def skill_count(skills: ColumnLike) -> Column:
    """Number of skills in an array made by ``extract_skills``."""
    return F.size(as_column(skills)).cast("double")


def skill_density(text: ColumnLike, skills: ColumnLike) -> Column:
    """Skills per 100 words."""
    return skill_count(skills) / F.greatest(word_count(text_or_empty(text)), F.lit(1)) * F.lit(100.0)


def recency_score(text: ColumnLike, as_of_year: int | None = None) -> Column:
    """1 when the latest year named is this year or later, falling to 0 over 15 years; 0 without any."""

    def score(latest: Column) -> Column:
        # greatest() skips NULL, so a text without a year needs its own branch
        gap = F.greatest(F.lit(_year(as_of_year)) - latest, F.lit(0))
        return F.when(latest.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(1.0) - gap / F.lit(15.0), F.lit(0.0)))

    t = text_or_empty(text)
    years = F.when(t.contains("19") | t.contains("20"), _all_numbers(t, lx.YEAR_TOKEN))
    return bind(F.array_max(years), score)


def job_title_signals(text: ColumnLike) -> dict[str, Column]:
    """One 0/1 column per job family."""
    return _titles(signal_words(text))


def _titles(found: Column) -> dict[str, Column]:
    return {f"job_title_{family}": _has(found, keywords).cast("double") for family, keywords in lx.JOB_TITLES.items()}


def _section_words(sections: Column, name: str) -> Column:
    return F.aggregate(
        F.filter(sections, lambda s: s["section"] == name),
        F.lit(0),
        lambda total, s: total + word_count(s["content"]),
    )


def section_ratios(text: ColumnLike) -> Column:
    """``struct(experience, skills)``: share of section words in these two sections."""
    document_words = F.greatest(word_count(text_or_empty(text)), F.lit(1))

    def shares(sections: Column) -> Column:
        total = F.aggregate(sections, F.lit(0), lambda t, s: t + word_count(s["content"]))
        base = F.when(total > 0, total).otherwise(document_words)
        return F.struct(
            (_section_words(sections, "experience") / base).alias("experience"),
            (_section_words(sections, "skills") / base).alias("skills"),
        )

    return bind(parse_sections(text), shares)


def structured_features(
    text: ColumnLike,
    as_of_year: int | None = None,
    use_sections: bool = False,
    skills: ColumnLike | None = None,
    signals: ColumnLike | None = None,
) -> list[Column]:
    """The 14 numeric features in their fixed order.

    ``skills`` is a column already holding the extracted skills, if there is one; ``signals`` one with the keywords found.

    Without ``use_sections`` both section ratios are 0, as in the table form of
    the feature extractor.
    """
    t = as_column(text)
    known = extract_skills(t) if skills is None else as_column(skills)
    found = signal_words(t) if signals is None else as_column(signals)
    if use_sections:
        ratios = section_ratios(t)
        experience, skills = ratios["experience"], ratios["skills"]
    else:
        experience = skills = F.lit(0.0)
    by_name = {
        "years_experience": years_experience(t, as_of_year),
        "education_level": _education(found).cast("double"),
        "skill_count": skill_count(known),
        "skill_density": skill_density(t, known),
        "recency_score": recency_score(t, as_of_year),
        "experience_section_ratio": experience,
        "skills_section_ratio": skills,
        **_titles(found),
    }
    return [by_name[name].alias(name) for name in lx.FEATURE_COLUMNS]
