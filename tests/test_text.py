import re

from doclens import lexicon as lx
from doclens.functions import text as tx


def test_aliases_are_whole_words_and_unicode_aware(values):
    texts = [None, "", "ML and K8s, JS", "éai html aim", "cpp csharp"]
    assert values(tx.expand_aliases("t"), texts) == [
        "", "", "machine learning and kubernetes, javascript", "éai html aim", "c++ c#",
    ]


def test_protected_terms_need_a_word_character_after_plus_and_sharp(values):
    texts = ["C++, C#,", "c++11 c#x", "asp.net", "use .NET now", "react.js ci/cd UI/UX", "scikit-learn"]
    assert values(tx.protect_terms("t"), texts) == [
        "c++, c#,", " cpp 11  csharp x", "asp dotnet ", "use .net now", " reactjs   cicd   uiux ", " scikitlearn ",
    ]


def test_versions(values):
    texts = ["Python 3.11", "python 2.7", "TensorFlow 2.x", "pytorch 1.13", "java 17", "react 18"]
    cleaned = values(tx.clean_text("t"), texts)
    assert cleaned == ["python311", "python27", "tensorflow2", "pytorch1 13", "java17", "react18"]


def test_contacts_and_charset(values):
    texts = ["mail a.b@c.de now", "see http://x.y/z or www.q.r", "call 555-123-4567", "@x a@ b", "a\u00a0b\r\nc"]
    assert values(tx.clean_text("t"), texts) == ["mail now", "see or", "call", "x a b", "a b c"]


def test_fast_email_form_equals_the_plain_pattern(values):
    texts = ["a@b", "@b", "@@b", "a@", "a@@", "x a@b@c y", "ab@cd@", "no at", "@", "é@ü z", " q@w"]
    assert values(tx.strip_contacts("t"), texts) == [re.sub(lx.EMAIL_PATTERN, " ", t) for t in texts]


def test_strip_preamble(values):
    texts = [
        None,
        "  Here's a professional resume for a Data Analyst: body",
        "HERE IS A resume for X:\n body  two",
        "call [Jo](mailto:jo@x.y) now",
    ]
    assert values(tx.strip_preamble("t"), texts) == ["", "body", "body two", "call Jo now"]


def test_role_names(values):
    texts = ["  ux  designer", "ml-ops engineer", "o'neil", "devops/sre", "3d artist", "HR manager"]
    assert values(tx.normalize_role("t"), texts) == [
        "UX Designer", "ML-Ops Engineer", "O'Neil", "Devops/Sre", "3D Artist", "HR Manager",
    ]


def test_sentences(values):
    assert values(tx.sentence_lines("t"), ["One. Two!  Three?\n\nFour", None]) == ["One.\nTwo!\nThree?\nFour", ""]


def _sections(text):
    """Plain loop over lines, as an independent statement of the rules."""
    current, found = "other", {"other": []}
    for line in (text or "").split("\n"):
        line = line.strip()
        header = re.fullmatch(r"[\s#*]*(.*?)\s*:?\s*", line, re.S)
        name = header.group(1).lower() if header else None
        if not line:
            continue
        if name in lx.SECTION_HEADERS:
            current = lx.SECTION_HEADERS[name]
            found.setdefault(current, [])
        else:
            found[current].append(line)
    return [(k, " ".join(v)) for k, v in found.items() if v]


def test_sections_against_a_line_loop(values):
    texts = [
        None, "", "   ", "Skills", "Skills\n", "no header\nat all", "intro\nSKILLS:\nx\n## Work Experience\ny\nskills\nz",
        "Summary\r\na\r\n* Education *\r\nb", "###\nprofile:\nme\n\n\nEmployment :\njob", "skills and more\nPROJECTS\np1\np2",
    ]
    got = [[(s["section"], s["content"]) for s in row] for row in values(tx.parse_sections("t"), texts)]
    assert got == [_sections(t) for t in texts]


def test_weighted_text(values):
    texts = ["plain text", "intro\nSkills\na b", "Skills\nx\nEducation\ny", None]
    assert values(tx.section_weighted_text("t"), texts) == ["plain text", "intro a b a b", "x x y", ""]


def _skills(text):
    """One search per spelling, group by group."""
    text = (text or "").lower()
    for word, target in lx.ALIASES:
        text = re.sub(rf"\b{word}\b", target, text)
    found = []
    for skill, spellings in lx.SKILLS.items():
        for spelling in spellings:
            stop = lx.NOT_FOLLOWED_BY.get(spelling)
            pattern = rf"\b{lx.spelling_pattern(spelling)}\b" + (f"(?!{stop})" if stop else "")
            if re.search(pattern, text):
                found.append(skill)
                break
    return found


def test_skills_against_one_search_per_spelling(values):
    texts = [
        None, "", "Java Script, JavaScript, java", "go to market", "golang; go  lang", "cv engineer", "CV, NLP",
        "C++, C#, .NET", "c++11 asp.net c#x", "node.js React.js vue.js", "spring  boot and google cloud platform",
        "power bi powerbi power  bi", "machine  learning machine learning", "éai rest restful", "micro-service ci/cd",
        "user interface user experience UI/UX", " ".join(s for group in lx.SKILLS.values() for s in group),
        ", ".join(s for group in lx.SKILLS.values() for s in reversed(group)),
    ]
    assert values(tx.extract_skills("t"), texts) == [_skills(t) for t in texts]


def test_stop_words_and_words(values):
    assert values(tx.remove_stopwords("t"), ["the cat  is on a mat", "", None]) == ["cat mat", "", ""]
    assert values(tx.words("t"), [" a\u00a0b\tc ", "", "  "]) == [["a", "b", "c"], [], []]


def test_tfidf_terms_skip_stop_words_before_pairing(values):
    assert values(tx.tfidf_terms("t"), ["The quick fox", "x 1a élan ab"]) == [
        ["quick", "fox", "quick fox"], ["ab"],
    ]
