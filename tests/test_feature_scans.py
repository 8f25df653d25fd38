"""Numeric features: one scan for all keywords, once per text."""

import re

import pytest

from doclens import lexicon as lx
from doclens.functions import features as ft


def test_keywords_do_not_hide_each_other():
    words = [*lx.EDUCATION_LEVELS, *(w for group in lx.JOB_TITLES.values() for w in group)]
    for a in words:
        assert [m.group() for m in re.finditer(lx.signal_pattern(), f"a {a}, x")] == [a]
        for b in words:
            if a != b:
                parts = b.split()
                assert a != b and not re.search(lx.any_word([a]), b)
                assert not any(a.startswith(" ".join(parts[-k:]) + " ") for k in range(1, len(parts) + 1))


def test_signals_equal_one_scan_per_keyword(spark):
    texts = ["PhD, M.Sc. and BA; UX-lead", "head of ui/ux", "mba msc b.s", "master's thesis, front-end", "lead_x bachelor_", "", None, "éba ba", "high school certificate"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(ft.education_level("t"), *ft.job_title_signals("t").values()).collect()
    for text, row in zip(texts, got):
        has = lambda words: re.search(lx.any_word(words), (text or "").lower()) is not None  # noqa: B023, E731
        assert row[0] == max([v for k, v in lx.EDUCATION_LEVELS.items() if has([k])], default=0)
        assert [bool(x) for x in row[1:]] == [has(w) for w in lx.JOB_TITLES.values()]


@pytest.mark.parametrize("step", ["scale_features", "assemble_features"])
def test_features_are_computed_once(spark, tmp_path, step, monkeypatch):
    from doclens import catalog
    from doclens.catalog import features

    d = str(tmp_path)
    rows = [(i, f"{i % 9} years of experience", "en", "web", 100 + i) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{d}/documents.parquet")
    kept = []
    monkeypatch.setattr(features, "written", lambda df, purpose: kept.append(purpose) or df.localCheckpoint(), raising=False)
    assert catalog.load()[0][step](spark, d).count() > 0
    assert kept == ["featured"]
