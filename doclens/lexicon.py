"""Word lists, rewrite rules, column names and thresholds.

Everything here is data whose content decides results. The patterns are
generated from it by the small rules at the end of the file.
"""

# --- Fixed values: whole-word aliases, applied in this order -----------------
ALIASES = [
    ("ml", "machine learning"),
    ("ai", "artificial intelligence"),
    ("k8s", "kubernetes"),
    ("js", "javascript"),
    ("ts", "typescript"),
    ("cpp", "c++"),
    ("csharp", "c#"),
    ("postgres", "postgresql"),
    ("mongo", "mongodb"),
]

# --- Fixed values: technical terms kept through charset folding --------------
# (term as written, token it becomes)
PROTECTED_TERMS = [
    ("c++", "cpp"),
    ("c#", "csharp"),
    (".net", "dotnet"),
    ("react.js", "reactjs"),
    ("node.js", "nodejs"),
    ("vue.js", "vuejs"),
    ("next.js", "nextjs"),
    ("express.js", "expressjs"),
    ("angular.js", "angularjs"),
    ("scikit-learn", "scikitlearn"),
    ("ci/cd", "cicd"),
    ("ui/ux", "uiux"),
]

# --- Fixed values: product versions glued to the product name ----------------
# (pattern between word boundaries, replacement with $n groups)
VERSION_RULES = [
    (r"python\s*3\.(\d{1,2})", "python3$1"),
    (r"python\s*(\d)\.(\d+)", "python$1$2"),
    (r"tensorflow\s*2(?:\.x)?", "tensorflow2"),
    (r"tensorflow\s*(\d+(?:\.\d+)?)", "tensorflow$1"),
    (r"pytorch\s*(\d+(?:\.\d+)?)", "pytorch$1"),
    (r"java\s*(\d{1,2})", "java$1"),
    (r"react\s*(\d+(?:\.\d+)?)", "react$1"),
]

VERSIONED_PRODUCTS = ["python", "tensorflow", "pytorch", "java", "react"]

# --- Fixed values: section headers and the section each one opens ------------
SECTION_HEADERS = {
    "experience": "experience",
    "work experience": "experience",
    "professional experience": "experience",
    "employment": "experience",
    "education": "education",
    "academic background": "education",
    "qualifications": "education",
    "skills": "skills",
    "technical skills": "skills",
    "core competencies": "skills",
    "technologies": "skills",
    "projects": "projects",
    "certifications": "certifications",
    "summary": "summary",
    "objective": "objective",
    "profile": "profile",
}
OTHER_SECTION = "other"

# --- Fixed values: how often a section is repeated in weighted text ----------
# weights 2.0, 2.0 and 1.5 give two copies; all other sections appear once
SECTION_REPEATS = {"experience": 2, "skills": 2, "projects": 2}

# --- Fixed values: skills, each with the spellings that report it ------------
SKILLS = {
    "Python": ["python", "py"],
    "Java": ["java"],
    "JavaScript": ["javascript", "js"],
    "TypeScript": ["typescript", "ts"],
    "C++": ["c++", "cpp"],
    "C#": ["c#", "csharp"],
    "Go": ["golang", "go lang", "go"],
    "Ruby": ["ruby"],
    "PHP": ["php"],
    "Swift": ["swift"],
    "Kotlin": ["kotlin"],
    "Rust": ["rust"],
    "SQL": ["sql"],
    "NoSQL": ["nosql"],
    "MongoDB": ["mongodb", "mongo"],
    "PostgreSQL": ["postgresql", "postgres"],
    "MySQL": ["mysql"],
    "Redis": ["redis"],
    "Elasticsearch": ["elasticsearch", "elastic search"],
    "AWS": ["aws", "amazon web services"],
    "Azure": ["azure", "microsoft azure"],
    "GCP": ["gcp", "google cloud", "google cloud platform"],
    "Docker": ["docker"],
    "Kubernetes": ["kubernetes", "k8s"],
    "Terraform": ["terraform"],
    "Jenkins": ["jenkins"],
    "Git": ["git", "github", "gitlab"],
    "Linux": ["linux", "unix"],
    "React": ["react", "reactjs", "react.js"],
    "Angular": ["angular"],
    "Vue": ["vue", "vuejs", "vue.js"],
    "Node.js": ["node.js", "nodejs"],
    "Django": ["django"],
    "Flask": ["flask"],
    "Spring": ["spring boot", "spring"],
    "TensorFlow": ["tensorflow", "tensorflow2"],
    "PyTorch": ["pytorch"],
    "Keras": ["keras"],
    "Scikit-learn": ["scikit-learn", "scikitlearn"],
    "Pandas": ["pandas"],
    "NumPy": ["numpy"],
    "Matplotlib": ["matplotlib"],
    "Tableau": ["tableau"],
    "Power BI": ["power bi", "powerbi"],
    "Machine Learning": ["machine learning", "machinelearning", "ml"],
    "Deep Learning": ["deep learning", "dl"],
    "NLP": ["nlp", "natural language processing"],
    "Computer Vision": ["computer vision", "cv"],
    "Data Analysis": ["data analysis", "data analytics"],
    "Statistics": ["statistics", "statistical"],
    "Agile": ["agile"],
    "Scrum": ["scrum"],
    "REST API": ["rest", "restful"],
    "GraphQL": ["graphql"],
    "Microservices": ["microservices", "micro-service"],
    "CI/CD": ["ci/cd", "cicd", "continuous integration"],
    "HTML": ["html", "html5"],
    "CSS": ["css", "css3"],
    "Figma": ["figma"],
    "UI/UX": ["ui/ux", "uiux", "user experience", "user interface"],
    ".NET": [".net", "dotnet"],
}
# spellings whose blank may be any run of whitespace
LOOSE_BLANKS = {"go lang", "elastic search", "spring boot", "power bi"}
# spellings that do not count when this follows
NOT_FOLLOWED_BY = {"java": r"\s*script", "go": r"\s*(?:to|lang)", "cv": r"\s*engineer"}

# --- Fixed values: English stop words, as in Spark's StopWordsRemover ------------
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she "
    "her hers herself it its itself they them their theirs themselves what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here "
    "there when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll "
    "i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've "
    "they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't "
    "shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's "
    "what's when's where's who's why's would"
).split()

# --- Fixed values: education keywords and their level ------------------------
EDUCATION_LEVELS = {
    "phd": 5,
    "doctorate": 5,
    "doctoral": 5,
    "master": 4,
    "mba": 4,
    "ms": 4,
    "m.s": 4,
    "m.sc": 4,
    "bachelor": 3,
    "bs": 3,
    "b.s": 3,
    "b.sc": 3,
    "ba": 3,
    "b.a": 3,
    "associate": 2,
    "diploma": 2,
    "certificate": 1,
    "certification": 1,
    "high school": 1,
}

# --- Fixed values: job-title signals -----------------------------------------
JOB_TITLES = {
    "engineer": ["engineer", "developer", "architect", "programmer"],
    "data": ["data scientist", "data analyst", "machine learning"],
    "frontend": ["frontend", "ui", "ux", "front-end"],
    "backend": ["backend", "back-end", "infrastructure"],
    "devops": ["devops", "dev-ops", "sre", "infrastructure"],
    "manager": ["manager", "lead", "director", "head of"],
    "designer": ["designer", "ux", "ui", "creative"],
}

# --- Fixed values: order of the numeric features -----------------------------
FEATURE_COLUMNS = [
    "years_experience",
    "education_level",
    "skill_count",
    "skill_density",
    "recency_score",
    "experience_section_ratio",
    "skills_section_ratio",
    "job_title_engineer",
    "job_title_data",
    "job_title_frontend",
    "job_title_backend",
    "job_title_devops",
    "job_title_manager",
    "job_title_designer",
]

# --- Fixed values: patterns read out of the text -----------------------------
YEARS_PHRASE = r"(\d{1,2})\s*\+?\s*(?:years?|yrs?)\s+(?:of\s+)?(?:experience|exp)"
YEARS_AT_LEAST = r"(?:over|more than|at least)\s+(\d{1,2})\s+(?:years?|yrs?)"
YEARS_RANGE = r"\b((?:19|20)\d{2})\s*[-–—to]+\s*((?:19|20)\d{2}|present|current|now)\b"
YEAR_TOKEN = r"\b(20\d{2}|19\d{2})\b"
URL_PATTERN = r"http\S+|www\S+|https\S+"
EMAIL_PATTERN = r"\S+@\S+"
PHONE_PATTERN = r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
TFIDF_TOKEN = r"\b[a-z][a-z0-9]+\b"
PREAMBLES = [
    r"^Here'?s a (?:professional |sample )?resume for[^:]+:\s*",
    r"^Here is a (?:professional |sample )?resume for[^:]+:\s*",
    r"^Here'?s a sample professional resume for[^:]+:\s*",
]
MARKDOWN_LINK = r"\[([^\]]+)\]\([^)]+\)"

# --- Fixed values: column names ----------------------------------------------
COLUMN_ALIASES = {
    "role": "category",
    "resume": "resume_text",
    "decision": "screening_decision",
    "reason_for_decision": "reason_for_decision",
    "job_description": "job_description",
}
TEXT_COLUMNS = ["resume_text", "resume", "text", "content", "description", "resume_content"]
CATEGORY_COLUMNS = [
    "category", "label", "class", "job_title", "job_category", "role", "designation",
    "job_role", "position",
]
INSPECTED_TEXT_COLUMNS = TEXT_COLUMNS + ["resume_text_cleaned", "raw_text"]
INSPECTED_CATEGORY_COLUMNS = CATEGORY_COLUMNS + ["job_family"]
SCREENING_COLUMNS = [
    "resume_text", "category", "data_source", "screening_decision", "reason_for_decision",
    "job_description",
]
PROFILE_COLUMNS = [
    "programming_languages", "experience_years", "projects", "internships", "skills_score",
    "company_type", "certifications", "research_papers", "education_level", "university_tier",
    "cgpa", "candidate_id",
]

# --- Fixed values: names in role titles ---------------------------------------
ROLE_ACRONYMS = {
    "Ux": "UX",
    "Ui": "UI",
    "Ai": "AI",
    "Ml": "ML",
    "Hr": "HR",
    "Qa": "QA",
    "Devops": "DevOps",
}

# --- Fixed values: roles given to structured profiles -------------------------
FALLBACK_ROLES = [
    "Software Engineer", "Full Stack Developer", "Backend Developer", "Data Analyst",
    "Product Manager",
]

# --- Fixed values: thresholds, sizes, names -----------------------------------
SHORTLIST_THRESHOLD = 0.6
REVIEW_THRESHOLD = 0.4
TOP_N = 10
SKILL_WEIGHT = 0.5
SIMILARITY_WEIGHT = 0.5
EMBEDDING_DIM = 384
ENCODER_MAX_CHARS = 3000
TFIDF_MAX_TERMS = 8000
DEFAULT_JOB_TEXT = "Looking for a qualified candidate with relevant skills and experience."


# --- Rules that turn the values into patterns ---------------------------------
_SPECIAL = set(".+*?()[]{}|^$\\/#-")


def escaped(literal: str) -> str:
    """Quote a literal so that Java regex and RE2 read it the same way."""
    return "".join("\\" + c if c in _SPECIAL and c not in "/#-" else c for c in literal)


def spelling_pattern(spelling: str) -> str:
    """Pattern of one skill spelling, without the word boundaries around it."""
    blank = r"\s+" if spelling in LOOSE_BLANKS else " "
    return blank.join(escaped(part) for part in spelling.split(" "))


def skill_pattern() -> str:
    """One whole-word alternation over all spellings of all skills.

    Spellings are grouped by first character (order kept inside a group), which
    cuts the alternatives tried at a word start from all spellings to a few.
    """
    tails = []
    for spellings in SKILLS.values():
        for spelling in spellings:
            stop = NOT_FOLLOWED_BY.get(spelling)
            tails.append((spelling, spelling_pattern(spelling) + (f"(?!{stop})" if stop else "")))
    return _grouped(tails)


def _grouped(patterns: list[tuple[str, str]]) -> str:
    """Whole-word alternation of ``(spelling, pattern)``, grouped by the spellings' first characters."""
    by_first: dict[str, list[str]] = {}
    for spelling, pattern in patterns:
        head = escaped(spelling[0])
        by_first.setdefault(head, []).append(pattern[len(head):])
    groups = [head + "(?:" + "|".join(tails) + ")" for head, tails in sorted(by_first.items())]
    return r"\b(?:" + "|".join(groups) + r")\b"


def signal_pattern() -> str:
    """One whole-word alternation over all keywords of education levels and job titles."""
    return _grouped([(w, escaped(w)) for w in dict.fromkeys([*EDUCATION_LEVELS, *(w for words in JOB_TITLES.values() for w in words)])])


def any_word(words: list[str]) -> str:
    """Whole-word alternation of literals."""
    return r"\b(?:" + "|".join(escaped(w) for w in words) + r")\b"
