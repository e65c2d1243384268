"""What exam-paper URLs, titles and file names say, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import clean_filename, url_path

# Words and path parts that tell papers from notes, and pages to leave out.
EXCLUDED_PATH_PARTS = ("tamil-medium", "english-medium", "textbook", "/wp-admin", "/wp-json", "/feed", "/tag/", "/author/", "/download/", "comment-page", "/amp")
SKIP_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".zip", ".rar", ".pdf")
PAPER_WORDS = ("paper", "exam", "term-test", "-term-")
NOT_PAPER_WORDS = ("note", "lesson", "unit-", "chapter", "workbook", "textbook", "syllabus", "teacher", "guide", "activity", "පාඩම", "සටහන")
# Provinces in the order in which they are looked for; words of terms and their numbers.
REGIONS = ("north-western", "north-central", "western", "southern", "central", "uva", "sabaragamuwa", "eastern", "northern")
TERMS = {"1st": 1, "2nd": 2, "3rd": 3, "first": 1, "second": 2, "third": 3}
# Words that tell answers; subjects of titles in the order in which they are looked for.
ANSWER_WORDS = ("answer", "marking scheme", "marking-scheme", "marking_scheme")
TITLE_SUBJECTS = ("Mathematics", "Science", "Sinhala", "History", "English", "Buddhism", "Geography", "Civic", "ICT", "Health", "Art", "Music", "Dancing", "Drama")

# Subjects by the names that URLs have for them, and names of subjects that are not wanted.
SUBJECTS = {
    "History": ["history"],
    "Drama and Theatre": ["drama", "drama-and-theatre"],
    "Dancing": ["dancing", "dance"],
    "Eastern Music": ["eastern-music", "oriental-music"],
    "Arts": ["art", "arts"],
    "Buddhism": ["buddhism"],
    "Catholicism": ["catholicism", "catholic"],
    "Christianity": ["christianity"],
    "Islam": ["islam", "islamic"],
    "Buddhist Civilization": ["buddhist-civilization", "buddhist-civilisation"],
    "History of Sri Lanka": ["history-of-sri-lanka"],
    "Dancing Indigenous": ["dancing-indigenous", "indigenous-dancing", "indigenous-dance"],
    "Citizenship Education": ["civic-education", "citizenship-education", "civics", "civic"],
    "Health and Physical Science": ["health-and-physical-education", "health-and-physical-science", "health-physical-education", "health"],
    "Geography": ["geography"],
    "Political Science": ["political-science"],
    "Physics": ["physics"],
    "Chemistry": ["chemistry"],
    "Biology": ["biology"],
    "Science": ["science"],
    "Sinhala Language and Literature": ["sinhala-language", "sinhala-literature", "sinhala-language-and-literature", "sinhala"],
    "Business and Accounting Studies": ["business-studies", "business-and-accounting-studies", "business-accounting-studies", "business-and-accounting", "accounting"],
    "Entrepreneurship Studies": ["entrepreneurship-studies", "entrepreneurship"],
    "Economics": ["economics"],
    "Home Economics": ["home-science", "home-economics"],
    "Biosystems Technology": ["biosystems-technology", "bio-systems-technology"],
    "Communication and Media Studies": ["communication-and-media-studies", "media-studies", "media"],
    "Design and Construction Technology": ["design-and-construction-technology", "construction-technology"],
    "Agriculture and Food Technology": ["agriculture-and-food-technology", "agriculture"],
}
SUBJECT_ALIASES = {"oriental music": "Eastern Music"}
UNWANTED = (
    "mathematics", "maths", "math", "english", "english-literature", "english-language", "tamil", "second-language-tamil", "second-language-sinhala", "sinhala-second-language", "tamil-language",
    "ict", "information-and-communication-technology", "art-and-craft", "western-music", "design-and-mechanical-technology", "design-electrical-and-electronic-technology", "electronic-technology",
    "electrical-and-electronic-technology", "mechanical-technology", "aquatic-bio-resources-technology", "bio-resources-technology", "french", "german", "hindi", "japanese", "korean", "chinese",
    "arabic", "pali", "sanskrit", "hinduism", "saivaneri", "combined-mathematics", "combined-maths", "higher-mathematics", "engineering-technology", "engineering-technology-et",
    "science-for-technology", "information-technology", "information-and-communication-technology-ict", "genaral-information-technology", "general-information-technology", "general-english",
    "business-statistics", "logic", "logic-and-scientific-method", "christian-civilization", "islamic-civilization", "hindu-civilization", "greek-and-roman-civilization", "home-economics-tamil",
    "russian", "hindi-language", "arabic-language", "chinese-language", "french-language", "german-language", "japanese-language", "korean-language", "russian-language",
    "tamil-language-and-literature",
)


def wanted_subjects(names: list[str] | None = None) -> list[str]:
    """The subjects of a list of names or aliases in any case; all without one. An unknown name is an error."""
    if names is None:
        return list(SUBJECTS)
    known = {s.lower(): s for s in SUBJECTS} | SUBJECT_ALIASES
    unknown = [n for n in names if n.strip() and n.strip().lower() not in known]
    if unknown:
        raise ValueError(f"unknown subjects: {', '.join(unknown)}")
    return [known[n.strip().lower()] for n in names if n.strip()]


def subject_names(spark: SparkSession, wanted: list[str] | None = None) -> DataFrame:
    """name, subject of all names that slugs have; the subject is null where it isn't wanted."""
    chosen = set(wanted_subjects(wanted))
    rows = [(n, s if s in chosen else None) for s, names in SUBJECTS.items() for n in names]
    have = {n for n, _ in rows}
    return spark.createDataFrame(rows + [(n, None) for n in UNWANTED if n not in have], "name string, subject string")


def _any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def is_not_paper(slug: Column) -> Column:
    return _any(slug, NOT_PAPER_WORDS)


def is_paper(pdf_slug: Column, page_slug: Column) -> Column:
    """Either says it's a paper, neither looks like notes."""
    return ~is_not_paper(pdf_slug) & ~is_not_paper(page_slug) & (_any(pdf_slug, PAPER_WORDS) | _any(page_slug, PAPER_WORDS))


def follow_link(url: Column, host: Column, hosts: tuple[str, ...], grade: int | None) -> Column:
    """Whether a link is to be followed: an own host, no file, the grade in its path, and no excluded part."""
    path = F.lower(url_path(url))
    ok = F.lower(host).isin(*hosts) & ~_any(path, EXCLUDED_PATH_PARTS)
    for e in SKIP_EXTENSIONS:
        ok = ok & ~F.endswith(path, F.lit(e))
    return ok if grade is None else ok & path.rlike(f"grade-?0?{grade}(?![0-9])")


def paper_details(slug: Column, site_name: Column | None = None) -> dict[str, Column]:
    """term, year, region and has_answers of a slug; site_name, the subject's name in it, is no part of a region."""
    rest = slug if site_name is None else F.when(F.coalesce(site_name, F.lit("")) != "", F.replace(slug, site_name, F.lit(" "))).otherwise(slug)
    named = F.regexp_extract(slug, "(1st|2nd|3rd|first|second|third)-term", 1)
    term = F.element_at(F.create_map(*[F.lit(x) for kv in TERMS.items() for x in kv]), F.nullif(named, F.lit("")))
    years = F.regexp_extract_all(slug, F.lit("20[0-3][0-9]"), F.lit(0))
    region = F.coalesce(*[F.when(rest.rlike(f"(^|-){r}(-|$)"), F.initcap(F.lit(r.replace("-", " ") + " province"))) for r in REGIONS])
    school = F.initcap(F.replace(F.nullif(F.regexp_extract(rest, "([a-z]+-(?:college|vidyalaya|school))", 1), F.lit("")), F.lit("-"), F.lit(" ")))
    return {
        "term": term,
        "year": F.array_max(years).cast("int"),
        "region": F.coalesce(region, school, F.lit("")),
        "has_answers": F.contains(slug, F.lit("answer")),
    }


def target_path(grade: Column, subject: Column, term: Column, pdf_url: Column) -> Column:
    """grade_NN/subject/term_N/file.pdf; long file names are cut and get eight digits of the URL's sha1."""
    name = F.regexp_extract(url_path(pdf_url), "([^/]*)/*$", 1)
    stem = clean_filename(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
    short = F.when(F.char_length(stem) <= 90, stem).otherwise(F.concat(F.left(stem, F.lit(90)), F.lit("-"), F.left(F.sha1(pdf_url.cast("binary")), F.lit(8))))
    folder = F.when(F.coalesce(term, F.lit(0)) != 0, F.concat(F.lit("term_"), term.cast("string"))).otherwise("term_unknown")
    return F.concat(F.lit("grade_"), F.lpad(grade.cast("string"), 2, "0"), F.lit("/"), clean_filename(subject), F.lit("/"), folder, F.lit("/"), short, F.lit(".pdf"))


# -- titles (the older, single-grade rules)


def title_grade(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)grade[\s-]*(0?[0-9]{1,2})", 1), F.lit("")).cast("int")


def title_term(text: Column) -> Column:
    return F.coalesce(*[F.when(text.rlike(rf"(?i)\b{t}\s+term\b"), F.lit(n)) for n, t in ((1, "1st"), (2, "2nd"), (3, "3rd"))])


def title_year(text: Column) -> Column:
    return F.array_max(F.regexp_extract_all(text, F.lit(r"\b20[0-9]{2}\b"), F.lit(0))).cast("int")


def title_subject(text: Column) -> Column:
    low = F.regexp_replace(F.lower(text), r"sinhala[\s_-]*medium", " ")
    return F.coalesce(*[F.when(F.contains(low, F.lit(s.lower())), F.lit(s)) for s in TITLE_SUBJECTS], F.lit("Unknown"))


def is_answer(text: Column) -> Column:
    return _any(F.lower(text), ANSWER_WORDS)


def page_title(html: Column) -> Column:
    """Text of the first h1, else of the title, else ''; tags in it are spaces."""
    inner = lambda tag: F.nullif(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), F.lit(""))
    text = F.coalesce(inner("h1"), inner("title"), F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"(?U)\s+", " "))
