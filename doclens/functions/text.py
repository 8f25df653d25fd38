"""Text column functions. All are built-in expressions: no Python runs per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclens import lexicon as lx

ColumnLike = Column | str
UNICODE = "(?U)"  # word, digit and blank classes cover all of Unicode


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(text: ColumnLike) -> Column:
    """NULL becomes the empty string."""
    return F.coalesce(as_column(text).cast("string"), F.lit(""))


coalesce_text = text_or_empty


def coalesce_texts(*texts: ColumnLike) -> Column:
    """First text that is not NULL, else the empty string."""
    return F.coalesce(*[as_column(t).cast("string") for t in texts], F.lit(""))


def truncate_text(text: ColumnLike, max_chars: int = lx.ENCODER_MAX_CHARS) -> Column:
    """First ``max_chars`` characters; NULL gives the empty string."""
    return F.left(text_or_empty(text), F.lit(max_chars))


# what \s stands for under UNICODE
_BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: ColumnLike) -> Column:
    """Cut every kind of whitespace at both ends."""
    return F.btrim(as_column(text), F.lit(_BLANKS))


def is_blank(text: ColumnLike) -> Column:
    return ~F.coalesce(as_column(text), F.lit("")).rlike(rf"{UNICODE}\S")


def collapse_whitespace(text: ColumnLike) -> Column:
    return strip(F.regexp_replace(as_column(text), rf"{UNICODE}\s+", " "))


def words(text: ColumnLike) -> Column:
    """Whitespace-separated words; the empty array for blank text."""
    return F.filter(F.split(as_column(text), rf"{UNICODE}\s+"), lambda w: w != "")


def word_count(text: ColumnLike) -> Column:
    return F.size(words(text))


# -- rewrites -------------------------------------------------------------------


def _apply(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, UNICODE + pattern, replacement)
    return text


def _apply_where_present(text: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Ordered rewrites ``(literal, pattern, replacement)``.

    A rule's pattern runs only on texts that contain its literal: a byte search
    is many times cheaper than decoding and scanning the text with a regex.
    """

    def rewrite(literal: str, pattern: str, replacement: str) -> Callable[[Column], Column]:
        return lambda t: F.when(
            t.contains(literal), F.regexp_replace(t, UNICODE + pattern, replacement)
        ).otherwise(t)

    for rule in rules:
        text = bind(text, rewrite(*rule))
    return text


_ALIAS_RULES = [(word, rf"\b{word}\b", target) for word, target in lx.ALIASES]
_ALIAS_PROBE = UNICODE + lx.any_word([word for word, _ in lx.ALIASES])
_TERM_RULES = [
    (term, rf"\b{lx.escaped(term)}\b", f" {token} ") for term, token in lx.PROTECTED_TERMS
] + [
    (product, rf"\b{pattern}\b", f" {replacement} ")
    for pattern, replacement in lx.VERSION_RULES
    for product in lx.VERSIONED_PRODUCTS
    if pattern.startswith(product)
]
# linear-time form of the e-mail pattern: a match always takes a whole run of
# non-blanks, so it needs to be tried at the start of a run only
_EMAIL_RUN = r"(?<!\S)\S[^\s@]*+@\S+"


def expand_aliases(text: ColumnLike) -> Column:
    """Lower-case, then spell out the short names.

    One scan collects the short names that occur, and only their rules run: no rule makes a short name of another.
    """

    def expanded(t: Column, found: Column) -> Column:
        for word, pattern, replacement in _ALIAS_RULES:
            present = F.array_contains(found, word)
            t = bind(t, lambda x: F.when(present, F.regexp_replace(x, UNICODE + pattern, replacement)).otherwise(x))  # noqa: B023
        return t

    return bind(
        F.lower(text_or_empty(text)),
        lambda t: bind(
            F.regexp_extract_all(t, F.lit(_ALIAS_PROBE), F.lit(0)),
            lambda found: F.when(F.size(found) > 0, expanded(t, found)).otherwise(t),
        ),
    )


def protect_terms(text: ColumnLike) -> Column:
    """Lower-case, then turn dotted and versioned terms into plain tokens."""
    return _apply_where_present(F.lower(text_or_empty(text)), _TERM_RULES)


def strip_contacts(text: ColumnLike) -> Column:
    """Replace URLs, e-mail addresses and phone numbers with a blank."""
    no_urls = bind(
        text_or_empty(text),
        lambda t: F.when(t.contains("http") | t.contains("www"), _apply(t, [(lx.URL_PATTERN, " ")])).otherwise(t),
    )
    no_mails = _apply_where_present(no_urls, [("@", _EMAIL_RUN, " ")])
    return _apply(no_mails, [(lx.PHONE_PATTERN, " ")])


def fold_charset(text: ColumnLike) -> Column:
    """Keep ``a-z 0-9`` and single blanks."""
    return F.trim(F.regexp_replace(text_or_empty(text), "[^a-z0-9]+", " "))  # other characters and blanks in one run


def clean_text(text: ColumnLike, keep_terms: bool = True) -> Column:
    """Aliases, protected terms, contacts, charset: in that order."""
    expanded = expand_aliases(text)
    return fold_charset(strip_contacts(protect_terms(expanded) if keep_terms else expanded))


def default_stop_words() -> list[str]:
    return list(lx.STOP_WORDS)


def remove_stopwords(text: ColumnLike, stop_words: list[str] | None = None, folded: bool = False) -> Column:
    """Drop stop words from whitespace-separated text; ``folded`` text comes from ``fold_charset``."""
    stop = stop_words or default_stop_words()  # a long list: the optimizer makes it a hash set
    split = F.split(text_or_empty(text), " ") if folded else words(text_or_empty(text))
    return F.array_join(F.filter(split, lambda w: ~w.isin(stop)), " ")


def sentence_lines(text: ColumnLike, max_chars: int | None = None) -> Column:
    """One sentence per line. ``max_chars`` is the optional guard for huge documents."""
    whole = text_or_empty(text)
    if max_chars is not None:
        whole = F.left(whole, F.lit(max_chars))
    broken = F.regexp_replace(whole, rf"{UNICODE}([.!?])\s+", "$1\n")
    lines = F.filter(F.transform(F.split(broken, "\n"), strip), lambda s: s != "")
    return F.array_join(lines, "\n")


def strip_preamble(text: ColumnLike) -> Column:
    """Remove a generated preamble, unwrap markdown links, collapse whitespace."""
    stripped = strip(text_or_empty(text))
    for pattern in lx.PREAMBLES:
        stripped = F.regexp_replace(stripped, "(?iU)" + pattern, "")
    unwrapped = F.regexp_replace(stripped, lx.MARKDOWN_LINK, "$1")
    return collapse_whitespace(unwrapped)


def normalize_role(role: ColumnLike) -> Column:
    """Title-case each run of letters, then restore acronyms in blank/hyphen-separated parts."""
    acronyms = F.create_map(*[F.lit(v) for pair in lx.ROLE_ACRONYMS.items() for v in pair])
    parts = F.regexp_extract_all(collapse_whitespace(role), F.lit(r"[ \-]|[^ \-]+"), F.lit(0))

    def titled(part: Column) -> Column:
        runs = F.regexp_extract_all(part, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
        return F.array_join(
            F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substr(r, F.lit(2))))),
            "",
        )

    return F.array_join(
        F.transform(
            parts, lambda p: bind(titled(p), lambda t: F.coalesce(F.element_at(acronyms, t), t))
        ),
        "",
    )


def normalize_decision(decision: ColumnLike) -> Column:
    return F.lower(strip(decision))


# -- skills ----------------------------------------------------------------------

_SKILL_PATTERN = UNICODE + lx.skill_pattern()
_SKILL_ROWS = [(skill, [s.lower() for s in spellings]) for skill, spellings in lx.SKILLS.items()]


def extract_skills(text: ColumnLike) -> Column:
    """Canonical skills named in the text, in lexicon order.

    One scan collects the spellings that occur; the 61 groups are then matched
    against that short list instead of against the document. This is exact
    because no spelling of one skill contains or overlaps one of another.
    """
    found = F.array_distinct(
        F.transform(
            F.regexp_extract_all(expand_aliases(text), F.lit(_SKILL_PATTERN), F.lit(0)),
            lambda s: F.regexp_replace(s, rf"{UNICODE}\s+", " "),
        )
    )
    lexicon = F.array(
        *[
            F.struct(F.lit(skill).alias("skill"), F.array(*[F.lit(s) for s in spellings]).alias("spellings"))
            for skill, spellings in _SKILL_ROWS
        ]
    )
    return bind(
        found,
        lambda hits: F.when(F.size(hits) == 0, F.array().cast("array<string>")).otherwise(
            F.transform(
                F.filter(lexicon, lambda row: F.arrays_overlap(row["spellings"], hits)),
                lambda row: row["skill"],
            )
        ),
    )


# -- sections ----------------------------------------------------------------------

_HEADER = (
    r"(?iU)^[\s#*]*("
    + "|".join(sorted(lx.SECTION_HEADERS, key=len, reverse=True))
    + r")\s*:?\s*$"
)


def section_of_header(line: Column) -> Column:
    """Section opened by a header line; NULL for any other line."""
    families = F.create_map(*[F.lit(v) for pair in lx.SECTION_HEADERS.items() for v in pair])
    return F.element_at(families, F.lower(F.regexp_extract(line, _HEADER, 1)))


def parse_sections(text: ColumnLike) -> Column:
    """``array<struct<section, content>>`` in order of first appearance, empty sections left out.

    Positions of the header lines cut the line array into slices, so the work
    is linear in the document and stays inside the row.
    """
    lines = F.filter(F.transform(F.split(text_or_empty(text), "\n"), strip), lambda s: s != "")

    def cut(line_array: Column) -> Column:
        headers = F.filter(
            F.transform(
                line_array,
                lambda line, i: F.struct(i.alias("pos"), section_of_header(line).alias("section")),
            ),
            lambda h: h["section"].isNotNull(),
        )
        first = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(lx.OTHER_SECTION).alias("section")))
        return bind(
            F.concat(first, headers),
            lambda marks: F.transform(
                marks,
                lambda m, j: F.struct(
                    m["section"].alias("section"),
                    F.slice(
                        line_array,
                        m["pos"] + 2,
                        F.coalesce(F.get(marks, j + 1)["pos"], F.size(line_array)) - m["pos"] - 1,
                    ).alias("lines"),
                ),
            ),
        )

    def merge(pieces: Column) -> Column:
        names = F.array_distinct(F.transform(pieces, lambda p: p["section"]))
        merged = F.transform(
            names,
            lambda name: F.struct(
                name.alias("section"),
                F.array_join(
                    F.flatten(
                        F.transform(
                            F.filter(pieces, lambda p: p["section"] == name), lambda p: p["lines"]
                        )
                    ),
                    " ",
                ).alias("content"),
            ),
        )
        return F.filter(merged, lambda s: s["content"] != "")

    return bind(bind(lines, cut), merge)


def sections_map(text: ColumnLike) -> Column:
    return F.map_from_entries(parse_sections(text))


def section_weighted_text(text: ColumnLike) -> Column:
    """Repeat important sections. Text without any real section passes unchanged."""
    repeats = F.create_map(*[F.lit(v) for pair in lx.SECTION_REPEATS.items() for v in pair])
    raw = text_or_empty(text)

    def weighted(sections: Column) -> Column:
        copies = F.transform(
            sections,
            lambda s: F.array_repeat(
                s["content"], F.coalesce(F.element_at(repeats, s["section"]), F.lit(1))
            ),
        )
        only_other = (F.size(sections) == 0) | (
            (F.size(sections) == 1) & (F.get(sections, F.lit(0))["section"] == lx.OTHER_SECTION)
        )
        return F.when(only_other, raw).otherwise(F.array_join(F.flatten(copies), " "))

    return bind(parse_sections(text), weighted)


# -- tokens for the default encoder and for TF-IDF -----------------------------------


def encoder_tokens(text: ColumnLike) -> Column:
    """Lower-cased runs of letters and digits; blank text becomes the one token ``empty``."""
    tokens = F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return bind(tokens, lambda t: F.when(F.size(t) == 0, F.array(F.lit("empty"))).otherwise(t))


def tfidf_words(text: ColumnLike, stop_words: list[str] | None = None) -> Column:
    """The tokens of TF-IDF terms, without stop words."""
    stop = stop_words or default_stop_words()
    return F.filter(
        F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(UNICODE + lx.TFIDF_TOKEN), F.lit(0)),
        lambda t: ~t.isin(stop),
    )


def bigrams(tokens: Column, only: list[str] | None = None) -> Column:
    """Neighbours joined by a blank; with ``only``, those of two tokens that are in it."""
    rest = F.greatest(F.size(tokens) - 1, F.lit(0))
    joined = lambda a, b: F.concat(a, F.lit(" "), b)
    if only is None:
        return F.zip_with(F.slice(tokens, 1, rest), F.slice(tokens, 2, rest), joined)
    known = F.transform(tokens, lambda t: F.when(t.isin(only), t))  # a pair with NULL is NULL
    return F.filter(
        bind(known, lambda t: F.zip_with(F.slice(t, 1, rest), F.slice(t, 2, rest), joined)), lambda pair: pair.isNotNull()
    )


def tfidf_terms(text: ColumnLike, stop_words: list[str] | None = None) -> Column:
    """Uni- and bigrams over tokens, built after stop words are dropped."""
    return bind(tfidf_words(text, stop_words), lambda t: F.concat(t, bigrams(t)))
