"""Queries over hand-written rows, for what the driver's tables don't hold: Sinhala text, exam papers, keys, links, files.

Each has rows for every branch of its operator, and SQL over the same rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import mcq, papers, text
from .operators import browse, crawl, dedup, joins, metrics, parse, sampling, scoring
from .plans import extraction, training
from .registry import Rows, query
from .sources import questions as src
from .sources.scratch import saver, scratch_folder
from .streaming import evaluation

# -- text

TEXTS = Rows(
    "id int, t string",
    (
        (1, "“කොළඹ”  ‘නගරය’ ` x"), (2, "ක‍‍‍ෂ \n  පහත\t\t ව"), (3, "﻿Café  බල​ය ''q''"), (4, "• ප්‍රශ්නය ,;"), (5, "  "), (6, ""), (7, None), (8, "Köln, ශ්‍රී 12 ලංකා!"), (9, "a'''b'c"), (10, ";, x y  ,z ;"),
    ),
)
_WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_PROMPT_TEXT = _strip(r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(translate(nfc_normalize(t), '“”‘’`' || chr(160), '""'''''' '), chr(8203), ''), chr(65279), ''),
  chr(8205) || '+', chr(8205), 'g'), '''''+', '"', 'g'), '""" + _WS + r"""*\n""" + _WS + r"""*', chr(10), 'g'), '[ \t]+', ' ', 'g')""")


@query(rf"""SELECT id, {_PROMPT_TEXT} AS prompt_text,
  regexp_replace(regexp_replace(translate(nfc_normalize(t), chr(160) || chr(8226), '  '), '{_WS}+', ' ', 'g'), '^[ ,;]+|[ ,;]+$', '', 'g') AS line,
  regexp_replace(lower(nfc_normalize(t)), '[^\p{{L}}\p{{N}}]+', '', 'g') AS key FROM {TEXTS.sql}""")
def normalize_text(spark: SparkSession, d: str):
    t = F.col("t")
    return TEXTS.df(spark).select("id", text.normalize_prompt_text(t).alias("prompt_text"), text.normalize_line(t).alias("line"), text.compare_key(t).alias("key"))


GRAMS = Rows("id int, a string, b string", ((1, "abcdefgh", "abcdefgh"), (2, "abcdefgh", "abcdxfgh"), (3, "abc", "abc"), (4, "abc", ""), (5, "", ""), (6, "කමලඅමලකමල", "අමලකමල"), (7, "aaaaaaaa", "aaaa"), (8, "xyzw", "abcd")))
_G = lambda c: f"CASE WHEN length({c}) < 4 THEN [{c}] ELSE list_distinct(list_transform(range(1, length({c}) - 2), lambda i: substr({c}, i, 4))) END"


@query(f"""WITH g AS (SELECT id, {_G('a')} AS ga, {_G('b')} AS gb FROM {GRAMS.sql}), n AS (SELECT id, len(ga) AS na, len(gb) AS nb, len(list_intersect(ga, gb)) AS common FROM g)
  SELECT id, CAST(common AS INTEGER) AS shared, CAST(na + nb - common AS INTEGER) AS whole, common / greatest(na + nb - common, 1) AS jaccard, common / greatest(least(na, nb), 1) AS overlap FROM n""")
def gram_similarity(spark, d):
    g = GRAMS.df(spark).select("id", text.shingles(F.col("a")).alias("ga"), text.shingles(F.col("b")).alias("gb"))
    a, b = F.col("ga"), F.col("gb")
    return g.select("id", F.size(F.array_intersect(a, b)).alias("shared"), F.size(F.array_union(a, b)).alias("whole"), text.jaccard(a, b).alias("jaccard"), text.overlap(a, b).alias("overlap"))


_SI = "කමල අමල "
SCRIPTS = Rows(
    "id int, t string",
    (
        (1, _SI * 60), (2, "ිි ා ු " * 60 + _SI * 60), (3, "the and of to is in for are " * 5), (4, "the and of " * 5), (5, "scan 12 3 4"), (6, "කා මි ක්‍ර"), (7, "ා"), (8, "aාකි"), (9, ""), (10, _SI * 60 + "the of and to is in for are " * 30), (11, "words without any frequent ones " * 20),
    ),
)
_LETTERS, _SIGNS = "regexp_extract_all(t, '[^\\n]')", "'[ංඃ්ා-ෟ]'"
_STATS = f"""(SELECT id, t, len(regexp_extract_all(t, '[\\x{{D80}}-\\x{{DFF}}]')) AS si, regexp_extract_all(lower(t), '[a-z]+') AS w, list_transform(range(1, length(t) + 1), lambda i: substr(t, i, 1)) AS ch FROM {SCRIPTS.sql}),
  n AS (SELECT *, len(list_filter(w, lambda x: list_contains({list(text.ENGLISH_WORDS)!r}, x))) AS en, len(list_filter(ch, lambda x: regexp_matches(x, {_SIGNS}))) AS signs,
    len(list_filter(range(1, len(ch) + 1), lambda i: regexp_matches(ch[i], {_SIGNS}) AND (i = 1 OR NOT regexp_matches(ch[i - 1], '[ංඃ්ා-ෟඅ-ඖක-ෆ' || chr(8205) || ']')))) AS bad FROM s)"""


@query(f"""WITH s AS {_STATS}, r AS (SELECT *, CASE WHEN signs > 0 THEN bad / signs ELSE 0.0::DOUBLE END AS broken FROM n)
  SELECT id, CAST(si AS INTEGER) AS sinhala, CAST(en AS INTEGER) AS english, broken,
    CASE WHEN si >= 300 AND broken > 0.03 THEN 'needs_ocr' WHEN si >= 300 THEN 'sinhala_text' WHEN en / greatest(len(w), 1) > 0.08 AND en > 30 THEN 'english_medium' ELSE 'needs_ocr' END AS class FROM r""")
def classify_scripts(spark, d):
    t = F.col("t")
    return SCRIPTS.df(spark).select("id", text.sinhala_chars(t).alias("sinhala"), text.english_words(text.words_in(t)).alias("english"), text.broken_sign_ratio(t).alias("broken"), text.classify_document(t).alias("class"))


LEGACY = Rows("id int, t string, glyphs string", (
    (1, "xyq jkl wer tyu iop asd fgh jkl zxc vbn mqw", _SI * 8), (2, "short", _SI), (3, _SI * 8, _SI * 8), (4, "the and of to is in for are which what answer question", _SI * 8), (5, "xyq jkl wer tyu iop asd fgh jkl zxc vbn mqw", "still latin text all of it, more than the rest " + _SI),
    (6, "xyq jkl wer tyu iop asd fgh jkl zxc vbn mqw", "ා ි ු " * 9 + _SI * 4),
))


@query("SELECT CAST(id AS INTEGER) AS id, legacy FROM (VALUES (1, true), (2, false), (3, false), (4, false), (5, false), (6, false)) v(id, legacy)")
def looks_legacy_encoded(spark, d):
    """glyphs is what the font's converter makes of the text; which rule refuses each row: length, script, language, share, signs."""
    return LEGACY.df(spark).select("id", text.looks_legacy_encoded(F.col("t"), F.col("glyphs")).alias("legacy"))


PRECHECK = Rows(
    "id int, pages int, fonts int, sinhala int, nwords int, eng double, broken double, pairs int",
    (
        (1, 5, 0, 900, 10, 0.0, 0.0, 0), (2, 5, 2, 100, 300, 0.2, 0.0, 0), (3, 5, 2, 900, 10, 0.0, 0.1, 0), (4, 2, 2, 900, 10, 0.0, 0.0, 25), (5, 2, 2, 900, 10, 0.0, 0.0, 3), (6, 9, 2, 900, 10, 0.0, 0.0, 3), (7, 9, 7, 10, 400, 0.01, 0.0, 3), (8, 9, 3, 10, 400, 0.01, 0.0, 3),
        (9, 9, 3, 2500, 400, 0.5, 0.0, 3),
    ),
)


@query(f"""SELECT id, why IN ('answer key', 'Sinhala text', 'legacy-font Sinhala text') AS keep, why AS reason FROM (SELECT id, CASE WHEN fonts = 0 THEN 'scanned (no text on the first pages)' WHEN nwords > 200 AND eng > 0.08 AND sinhala < 2000 THEN 'English medium'
  WHEN broken > 0.03 THEN 'garbled Sinhala text layer' WHEN pages <= 3 AND pairs >= 20 THEN 'answer key' WHEN pages <= 3 THEN 'short file without MCQs' WHEN sinhala >= 300 THEN 'Sinhala text'
  WHEN nwords >= 300 AND eng < 0.03 AND fonts >= 6 THEN 'legacy-font Sinhala text' ELSE 'no readable Sinhala text' END AS why FROM {PRECHECK.sql})""")
def precheck_outcomes(spark, d):
    c = [F.col(n) for n in ("pages", "fonts", "sinhala", "nwords", "eng", "broken", "pairs")]
    return PRECHECK.df(spark).select("id", text.precheck_decide(*c).alias("r")).select("id", "r.keep", "r.reason")


PAIR_TEXTS = Rows("id int, t string, want int", ((1, "(01) 2 (02) 3", 2), (2, "1. 3, 12 - 4", 2), (3, "3 9", 0), (4, "07) 1", 1), (5, "1.25 and 3.5", 0), (6, "no key", 0), (7, "", 0), (8, "1–2 3:4 5-1", 3)))


@query(f"SELECT id, want AS pairs, CAST(len(regexp_extract_all(lower(t), '[a-z]{{2,}}')) AS INTEGER) AS nwords FROM {PAIR_TEXTS.sql}")
def precheck_pairs(spark, d):
    f = text.precheck_features(F.col("t"))
    return PAIR_TEXTS.df(spark).select("id", f["pairs"].alias("pairs"), f["nwords"].alias("nwords"))


URLS = Rows("id int, u string", (
    (1, "https://www.Site.lk/a/b.pdf/?q=1#x"), (2, "http://user@site.lk:80/Path//"), (3, "ftp://www.www.x.y"), (4, "/only/path?x"), (5, ""), (6, None), (7, "https://site.lk/a%20b+c/Grade-10-Paper.PDF"), (8, "https://site.lk/x?y=https://www.z/#f"),
))
_PATH_SQL = "regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


@query(f"""SELECT id, lower(regexp_replace(replace(regexp_extract(coalesce(u, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '') || coalesce({_PATH_SQL}, ''), '/+$', '')) AS source,
  regexp_replace(u, '[?#].*$', '') AS page, regexp_replace(u, '#.*$', '') AS bare, lower(url_decode(list_last(string_split(regexp_replace({_PATH_SQL}, '/+$', ''), '/')))) AS slug FROM {URLS.sql}""")
def url_keys(spark, d):
    u = F.col("u")
    return URLS.df(spark).select("id", text.source_key(u).alias("source"), text.page_url(u).alias("page"), text.without_fragment(u).alias("bare"), text.last_slug(u).alias("slug"))


NAMES = Rows("id int, name string", ((1, 'a<b>:"c/d\\e|f?g*h'), (2, "  two   spaces\t "), (3, "x" * 200), (4, ""), (5, None), (6, "සිංහල / භාෂාව")))


@query(rf"""SELECT id, substr({_strip(f"regexp_replace(regexp_replace(name, '[<>:" + '"' + rf"/\\|?*]', '_', 'g'), '{_WS}+', ' ', 'g')")}, 1, 150) AS name FROM {NAMES.sql}""")
def clean_filenames(spark, d):
    return NAMES.df(spark).select("id", text.clean_filename(F.col("name")).alias("name"))


# -- what names of papers say

SLUGS = Rows("id int, slug string, page string, name string", (
    (1, "grade-10-history-2nd-term-test-paper-2019-western-province", "papers", "history"), (2, "history-third-term-2020-2021-answers", "x", "history"), (3, "royal-college-science-exam-2015", "x", "science"), (4, "north-western-first-term-paper", "x", None),
    (5, "science-notes-paper", "x", "science"), (6, "science-unit", "term-test-papers", "science"), (7, "drama-1st-term", "lesson-papers", "drama"), (8, "western-music-paper", "x", "western-music"), (9, "plain", "plain", None), (10, "saint-anne-vidyalaya-eastern-2039", "x", ""),
))
_ANY = lambda c, ws: "(" + " OR ".join(f"contains({c}, '{w}')" for w in ws) + ")"
_REST = "CASE WHEN coalesce(name, '') <> '' THEN replace(slug, name, ' ') ELSE slug END"
_TITLE = lambda x: f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"


@query(f"""WITH r AS (SELECT *, {_REST} AS rest FROM {SLUGS.sql})
  SELECT id, CAST(CASE regexp_extract(slug, '(1st|2nd|3rd|first|second|third)-term', 1) WHEN '1st' THEN 1 WHEN 'first' THEN 1 WHEN '2nd' THEN 2 WHEN 'second' THEN 2 WHEN '3rd' THEN 3 WHEN 'third' THEN 3 END AS INTEGER) AS term,
    CAST(list_max(regexp_extract_all(slug, '20[0-3][0-9]')) AS INTEGER) AS year,
    coalesce(CASE {' '.join(f"WHEN regexp_matches(rest, '(^|-){x}(-|$)') THEN '{x.replace('-', ' ').title()} Province'" for x in papers.REGIONS)} END, {_TITLE("replace(nullif(regexp_extract(rest, '([a-z]+-(college|vidyalaya|school))', 1), ''), '-', ' ')")}, '') AS region,
    contains(slug, 'answer') AS has_answers, {_ANY('slug', papers.NOT_PAPER_WORDS)} AS notes,
    NOT {_ANY('slug', papers.NOT_PAPER_WORDS)} AND NOT {_ANY('page', papers.NOT_PAPER_WORDS)} AND ({_ANY('slug', papers.PAPER_WORDS)} OR {_ANY('page', papers.PAPER_WORDS)}) AS is_paper FROM r""")
def paper_slugs(spark, d):
    s, f = F.col("slug"), papers.paper_details(F.col("slug"), F.col("name"))
    return SLUGS.df(spark).select("id", *[c.alias(n) for n, c in f.items()], papers.is_not_paper(s).alias("notes"), papers.is_paper(s, F.col("page")).alias("is_paper"))


LINKS = Rows("id int, u string", (
    (1, "https://site.lk/grade-10-papers"), (2, "https://site.lk/grade-100-papers"), (3, "https://other.lk/grade-10"), (4, "https://SITE.lk/grade10/x"), (5, "https://site.lk/grade-010/x"), (6, "https://site.lk/grade-10/a.JPG"), (7, "https://site.lk/grade-10/tag/x"), (8, "https://site.lk/grade-10-english-medium"),
    (9, "https://site.lk/grade-11"), (10, "/grade-10"), (11, "https://site.lk/grade-10/feed"),
))


@query(f"""WITH p AS (SELECT id, lower({_PATH_SQL}) AS path, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM {LINKS.sql})
  SELECT id, host IN ('site.lk', 'www.site.lk') AND NOT {_ANY('path', papers.EXCLUDED_PATH_PARTS)} AND NOT regexp_matches(path, '(\\.jpg|\\.jpeg|\\.png|\\.gif|\\.webp|\\.zip|\\.rar|\\.pdf)$') AND regexp_matches(path, 'grade-?0?10([^0-9]|$)') AS follow FROM p""")
def links_to_follow(spark, d):
    return LINKS.df(spark).select("id", papers.follow_link(F.col("u"), text.url_host(F.col("u")), ("site.lk", "www.site.lk"), 10).alias("follow"))


TARGETS = Rows("id int, grade int, subject string, term int, u string", (
    (1, 7, "History", 2, "https://s.lk/a/paper.pdf"), (2, 10, "Drama/Theatre", None, "https://s.lk/a/" + "long-name-" * 12 + ".pdf"), (3, 11, "ICT", 0, "https://s.lk/a/b?c.pdf"), (4, 6, "Arts", 1, "https://s.lk/dots.in.name.pdf"),
))


@query(f"""WITH n AS (SELECT *, regexp_replace(regexp_extract({_PATH_SQL}, '([^/]*)/*$', 1), '(.)\\.[^.]*$', '\\1') AS stem FROM {TARGETS.sql})
  SELECT id, 'grade_' || lpad(CAST(grade AS VARCHAR), 2, '0') || '/' || replace(subject, '/', '_') || '/' || CASE WHEN coalesce(term, 0) <> 0 THEN 'term_' || term ELSE 'term_unknown' END || '/' ||
    CASE WHEN length(stem) <= 90 THEN stem ELSE substr(stem, 1, 90) || '-' || substr(sha1(u), 1, 8) END || '.pdf' AS path FROM n""")
def target_paths(spark, d):
    return TARGETS.df(spark).select("id", papers.target_path(F.col("grade"), F.col("subject"), F.col("term"), F.col("u")).alias("path"))


TITLES = Rows("id int, html string", (
    (1, "<html><title>Site</title><h1 class=x>Grade 10 <b>History</b>  1st Term 2019 2021</h1>"), (2, "<TITLE>grade-06 Science Sinhala Medium 2nd term Answer</TITLE>"), (3, "<h1></h1><title>Grade 9 marking scheme, 3RD  TERM, Civics 1999</title>"), (4, "no title"), (5, None), (6, "<title>ICT upgrade 20201</title>"),
))
_INNER = lambda tag: f"nullif(regexp_extract(html, '<{tag}[^>]*>(.*?)</{tag}>', 1, 'is'), '')"


@query(f"""WITH t AS (SELECT id, trim(regexp_replace(regexp_replace(coalesce({_INNER('h1')}, {_INNER('title')}, ''), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM {TITLES.sql})
  SELECT id, t AS title, TRY_CAST(nullif(regexp_extract(t, 'grade[\\s-]*(0?[0-9]{{1,2}})', 1, 'i'), '') AS INTEGER) AS grade,
    CAST(CASE WHEN regexp_matches(t, '\\b1st\\s+term\\b', 'i') THEN 1 WHEN regexp_matches(t, '\\b2nd\\s+term\\b', 'i') THEN 2 WHEN regexp_matches(t, '\\b3rd\\s+term\\b', 'i') THEN 3 END AS INTEGER) AS term,
    CAST(list_max(regexp_extract_all(t, '\\b20[0-9]{{2}}\\b')) AS INTEGER) AS year,
    coalesce(CASE {' '.join(f"WHEN contains(regexp_replace(lower(t), 'sinhala[ _-]*medium', ' ', 'g'), '{x.lower()}') THEN '{x}'" for x in papers.TITLE_SUBJECTS)} END, 'Unknown') AS subject, {_ANY('lower(t)', papers.ANSWER_WORDS)} AS answers FROM t""")
def title_details(spark, d):
    t = F.col("title")
    out = TITLES.df(spark).select("id", papers.page_title(F.col("html")).alias("title")).withColumn("title", F.coalesce("title", F.lit("")))
    return out.select("id", "title", papers.title_grade(t).alias("grade"), papers.title_term(t).alias("term"), papers.title_year(t).alias("year"), papers.title_subject(t).alias("subject"), papers.is_answer(t).alias("answers"))


SITE_NAMES = Rows("name string", (("history",), ("art",), ("arts",), ("drama",), ("drama-and-theatre",), ("ict",)))
SITE_SLUGS = Rows("id int, slug string", ((1, "grade-10-history-paper"), (2, "drama-and-theatre-2020"), (3, "artist-paper"), (4, "arts"), (5, "old-art-history"), (6, "sinhala-medium-ict"), (7, None), (8, ""), (9, "DRAMA-x")))


@query(f"""WITH m AS (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY length(name) DESC, name) AS r FROM {SITE_SLUGS.sql} JOIN {SITE_NAMES.sql} ON contains('-' || lower(slug) || '-', '-' || name || '-'))
  SELECT s.id, name AS site_name FROM {SITE_SLUGS.sql} s LEFT JOIN m ON m.id = s.id AND r = 1""")
def longest_of_several_names(spark, d):
    return joins.longest_match(SITE_SLUGS.df(spark), F.col("slug"), SITE_NAMES.df(spark)).select("id", "site_name")


# -- questions

FOUR = ["alpha one", "beta two", "gamma three", "delta four"]
QUESTIONS = Rows("id int, question string, choices array<string>, answer int", (
    (1, "What is one?", FOUR, 1), (2, " ", FOUR, 1), (3, "Few?", ["a"], 1), (4, "Blank?", ["a", " ", "c", "d"], 1), (5, "None?", FOUR, None), (6, "Five?", [*FOUR, "five"], 2), (7, "Too far?", FOUR, 5), (8, "Zero?", FOUR, 0), (9, None, FOUR, 1), (10, "රූපය බලන්න", FOUR, 2), (11, "ඉහත ප්‍රකාශ දෙක", FOUR, 2),
    (12, "ඉහත දී ඇති වගුව", FOUR, 2), (13, "සිතියම", FOUR, 1),
))
_BLANK = "list_filter(choices, lambda c: trim(c) = '')"


@query(f"""SELECT id, answer IS NULL OR trim(coalesce(question, '')) = '' OR len(choices) < 2 OR len({_BLANK}) > 0 AS bad, len(choices) <> 4 OR NOT coalesce(answer BETWEEN 1 AND 4, false) OR len({_BLANK}) > 0 AS malformed,
  regexp_matches(question, 'රූප|සිතියම|ප්‍රස්තාර|රූපසටහන|වගුව|ඡායාරූප|දළ\\s*සටහන|පහත\\s*දැක්වෙන\\s*සටහන|පහත\\s*ආකාර|තීරුව') OR regexp_matches(regexp_replace(question, 'ඉහත\\s*(ප්‍රකාශ|වගන්ති)', '', 'g'), 'ඉහත') AS context FROM {QUESTIONS.sql}""")
def question_predicates(spark, d):
    q = [F.col(c) for c in ("question", "choices", "answer")]
    return QUESTIONS.df(spark).select("id", mcq.is_bad(*q).alias("bad"), mcq.is_malformed(q[1], q[2]).alias("malformed"), mcq.needs_context(q[0]).alias("context"))


OPTIONS = Rows("id int, o string, want string", (
    (1, "රන් (ලකුණු 2)", "රන්"), (2, "(ලකුණු 2) රන්", "(ලකුණු 2) රන්"), (3, "plain  text ,", "plain text"), (4, "රිදී - 12 - පිටුව", "රිදී"), (5, "තඹ ප්‍රශ්න අංක 5 සිට", "තඹ"), (6, "• x", "x"), (7, "", ""), (8, None, None), (9, "යකඩ II පත්‍රය", "යකඩ"), (10, "a පහත දැක්වෙන ප්‍රශ්න අංක 7", "a"),
))


@query(f"SELECT id, want AS option FROM {OPTIONS.sql}")
def clean_options(spark, d):
    return OPTIONS.df(spark).select("id", mcq.clean_option(F.col("o")).alias("option"))


@query(f"""SELECT id, regexp_replace(regexp_replace(question, '\\s+', ' ', 'g'), '^[ ,;]+|[ ,;]+$', '', 'g') || '||' || array_to_string(list_transform(choices, lambda c: regexp_replace(regexp_replace(c, '\\s+', ' ', 'g'), '^[ ,;]+|[ ,;]+$', '', 'g')), '|') AS line_key,
  trim(question) || '||' || array_to_string(list_transform(choices, lambda c: trim(c)), '|') AS exact_key,
  regexp_replace(lower(question), '[^\\p{{L}}\\p{{N}}]+', '', 'g') || '|' || array_to_string(list_sort(list_transform(choices, lambda c: regexp_replace(lower(c), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))), '|') AS bag_key FROM {QUESTIONS.sql} WHERE question IS NOT NULL""")
def question_keys(spark, d):
    q, c = F.col("question"), F.col("choices")
    return QUESTIONS.df(spark).filter("question is not null").select("id", mcq.line_key(q, c).alias("line_key"), mcq.exact_key(q, c).alias("exact_key"), mcq.bag_key(q, c, True).alias("bag_key"))


SUBJECTS = Rows("id int, s string", ((1, "eastern_music"), (2, " Eastern  Music "), (3, "civics"), (4, "Physics"), (5, "Unknown thing"), (6, ""), (7, None), (8, "SCIENCE"), (9, "Economics")))


@query(f"""WITH b AS (SELECT id, trim(regexp_replace(replace(s, '_', ' '), '\\s+', ' ', 'g')) AS b FROM {SUBJECTS.sql}),
  c AS (SELECT id, coalesce(map_extract({{{', '.join(f"'{k}': '{v}'" for k, v in mcq.SUBJECT_NAMES.items())}}}::MAP(VARCHAR, VARCHAR), lower(b))[1], b) AS subject FROM b)
  SELECT id, subject, coalesce(map_extract(MAP {{{', '.join(f"'{k}': '{v}'" for k, v in mcq.CATEGORY.items())}}}, coalesce(subject, ''))[1], 'humanities') AS category FROM c""".replace("{'arts'", "MAP {'arts'").replace("}::MAP(VARCHAR, VARCHAR)", "}"))
def subject_names(spark, d):
    s = SUBJECTS.df(spark).select("id", mcq.canonical_subject(F.col("s")).alias("subject"))
    return s.withColumn("category", mcq.subject_category(F.col("subject")))


SAID = Rows("id int, said string, choices array<string>", (
    (1, "2", FOUR), (2, " The answer is 3. ", FOUR), (3, "12 or 4", FOUR), (4, "෩", FOUR), (5, "it is gamma three", FOUR), (6, "nothing", FOUR), (7, "", FOUR), (8, "   ", FOUR), (9, None, FOUR), (10, "7", FOUR), (11, "9 then 1", FOUR), (12, "delta four or alpha one", FOUR), (13, "5", [*FOUR, "e"]), (14, "x", ["", "x"]),
))


@query(f"""WITH t AS (SELECT id, choices, translate(trim(said), '෦෧෨෩෪෫෬෭෮෯', '0123456789') AS t FROM {SAID.sql}),
  n AS (SELECT *, TRY_CAST(list_filter(regexp_extract_all(regexp_replace(t, '[0-9]{{2,}}', '', 'g'), '[1-9]'), lambda d: CAST(d AS INTEGER) <= len(choices))[1] AS INTEGER) AS number,
    list_position(list_transform(choices, lambda c: trim(c) <> '' AND contains(t, trim(c))), true) AS named FROM t)
  SELECT id, CASE WHEN t <> '' THEN coalesce(number, nullif(CAST(named AS INTEGER), 0)) END AS answer FROM n""")
def parse_answer_texts(spark, d):
    return SAID.df(spark).select("id", mcq.parse_answer(F.col("said"), F.col("choices")).alias("answer"))


SHOTS = Rows("id int, subject string, question string, choices array<string>, answer int", ((1, "h", "Q  one", ["a", "b"], 2), (2, "h", "“Q” two", ["c"], 1), (3, "g", "Q three", [], 1), (4, None, "Q four", ["ක", "ඛ"], 1)))


def _prompt_sql(language: str) -> str:
    p = mcq.PROMPTS[language]
    clean = lambda x: f"trim(regexp_replace(translate({x}, '“”', '\"\"'), '[ \\t]+', ' ', 'g'))"
    return f"""'{p['question']} ' || {clean('question')} || chr(10) || chr(10) || array_to_string(list_transform(choices, lambda c, i: i || '. ' || {clean('c')}), chr(10)) || CASE WHEN len(choices) > 0 THEN chr(10) ELSE '' END || chr(10) || '{p['answer']}'"""


@query(f"""WITH q AS (SELECT id, subject, answer, {_prompt_sql('si')} AS p FROM {SHOTS.sql}),
  s AS (SELECT a.id, string_agg('user:' || b.p || '|assistant:' || b.answer, '|' ORDER BY b.id) AS turns, count(*) AS n FROM q a JOIN q b ON b.subject = a.subject AND b.id <> a.id GROUP BY a.id)
  SELECT q.id, CAST(2 + 2 * coalesce(n, 0) AS INTEGER) AS n_messages, 'system:{mcq.PROMPTS['si']['system']}|' || coalesce(turns || '|', '') || 'user:' || p AS messages FROM q LEFT JOIN s USING (id)""")
def messages_with_shots(spark, d):
    q = SHOTS.df(spark).withColumn("p", mcq.format_question(F.col("question"), F.col("choices"), "si"))
    other = q.select(F.col("id").alias("o"), F.col("subject").alias("s"), F.struct(F.col("id"), F.col("p").alias("prompt"), "answer").alias("shot"))
    shots = q.join(other, (F.col("s") == F.col("subject")) & (F.col("o") != F.col("id")), "left").groupBy("id", "p").agg(F.array_sort(F.collect_list("shot")).alias("shots"))
    m = shots.select("id", mcq.build_messages(F.col("p"), F.col("shots"), "si").alias("m"))
    return m.select("id", F.size("m").alias("n_messages"), F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|").alias("messages"))


@query(f"""SELECT id, '{mcq.PROMPTS['en']['system']}' || chr(10) || chr(10) || 'ask one' || ' ' || '3' || chr(10) || chr(10) || {_prompt_sql('en')} AS plain FROM {SHOTS.sql}""")
def render_plain_prompts(spark, d):
    shot = F.array(F.struct(F.lit("ask one").alias("prompt"), F.lit(3).alias("answer")))
    return SHOTS.df(spark).select("id", mcq.render_prompt(mcq.build_messages(mcq.format_question(F.col("question"), F.col("choices"), "en"), shot, "en")).alias("plain"))


SHARES = Rows("id int, share double, zero_based int", ((1, 0.5, 0), (2, 0.12345, 3), (3, 1.0, 1), (4, None, None), (5, 0.0, 2)))


@query(f"SELECT id, format('{{:.2f}}%', share * 100) AS shown, zero_based + 1 AS answer FROM {SHARES.sql}")
def shown_shares(spark, d):
    return SHARES.df(spark).select("id", F.when(F.col("share").isNotNull(), mcq.percent(F.col("share"))).alias("shown"), mcq.one_based(F.col("zero_based")).alias("answer"))


@query(f"""WITH r AS (SELECT id, choices, c FROM {QUESTIONS.sql}, range(2) x(c) WHERE len(list_filter(choices, lambda o: contains(coalesce(o, ''), 'ඉහත'))) = 0 AND answer BETWEEN 1 AND len(choices))
  SELECT CAST(id AS VARCHAR) || '#shuf' || c AS id, array_to_string(list_sort(choices), '|') AS bag, CAST(len(choices) AS INTEGER) AS n FROM r UNION ALL SELECT CAST(id AS VARCHAR), array_to_string(list_sort(choices), '|'), CAST(len(choices) AS INTEGER) FROM {QUESTIONS.sql} WHERE answer BETWEEN 1 AND len(choices)""")
def shuffles_keep_the_answer(spark, d):
    """Copies hold the same options, and the answer is the option it was; a row for which that isn't so has a null bag."""
    q = QUESTIONS.df(spark).filter("answer between 1 and size(choices)")
    out = sampling.option_shuffles(q, 2).withColumn("first", F.split("id", "#")[0].cast("int"))
    was = q.select(F.col("id").alias("first"), F.get("choices", F.col("answer") - 1).alias("right"))
    same = F.get("choices", F.col("answer") - 1) == F.col("right")
    return out.join(was, "first").select("id", F.when(same, F.array_join(F.array_sort("choices"), "|")).alias("bag"), F.size("choices").alias("n"))


ABOVE_OPTIONS = Rows("id int, choices array<string>, answer int", ((1, ["a", "ඉහත සියල්ල", "c"], 2), (2, ["a", "b"], 1), (3, [None, "b"], 2)))


@query(f"SELECT CAST(id AS VARCHAR) || s AS id FROM {ABOVE_OPTIONS.sql}, (VALUES (''), ('#shuf0')) v(s) WHERE s = '' OR len(list_filter(choices, lambda o: contains(coalesce(o, ''), 'ඉහත'))) = 0")
def shuffles_skip_above(spark, d):
    return sampling.option_shuffles(ABOVE_OPTIONS.df(spark), 1).select("id")


# -- near-duplicates of a test set: each rule, and none

_LONG = "which of the following kings built the great tank of the dry zone"
DEV = Rows("dev_id int, question string, choices array<string>", (
    (1, _LONG + " in the north", ["Parakrama", "Mahasen", "Vijaya", "Dutugemunu"]), (2, "name the largest river of the island", ["red", "green", "blue", "white"]), (3, "how many planets move around the sun", ["six", "seven", "eight", "nine"]), (4, "zzzz yyyy", ["p", "q", "r", "s"]),
))
PROBE = Rows("row int, question string, choices array<string>", (
    (1, _LONG + " in the north", ["Parakrama", "Mahasen", "Vijaya", "Dutugemunu"]), (2, _LONG + " in the south", ["Parakrama", "Mahasen", "Vijaya", "Gemunu"]),
    (3, "name the largest river of the island", ["red", "a very long option that is nowhere else, to lower the similarity", "and yet another one, longer than the first of them", "the last of these long options, of many characters"]),
    (4, "read the passage about space that follows and then say how many planets move around the sun in all", ["six", "seven", "a totally different third option here", "one more different option, the fourth"]),
    (5, "a wholly different question", ["red", "green", "blue", "white"]), (6, "name the largest river of the island", ["i", "ii", "iii", "something that makes the whole far longer than it was before, by a lot of words"]), (7, "", ["", "", "", ""]),
))
_K = lambda c: rf"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_SIDE = lambda i, rows: f"(SELECT {i}, {_G('q')} AS sq, {_G('w')} AS sa, o FROM (SELECT {i}, {_K('question')} AS q, {_K(chr(39) * 2 + ' || question || array_to_string(choices, ' + chr(39) * 2 + ')')} AS w, list_distinct(list_transform(choices, lambda c: {_K('c')})) AS o FROM {rows}))"
_JAC = lambda a, b: f"len(list_intersect({a}, {b})) / greatest(len(list_distinct(list_concat({a}, {b}))), 1)"
_OVERLAP = f"""p AS {_SIDE('row', PROBE.sql)}, d AS {_SIDE('dev_id', DEV.sql)},
  hit AS (SELECT row, dev_id, count(*) AS hits FROM (SELECT row, unnest(list_distinct(list_concat(sq, sa))) AS g FROM p) JOIN (SELECT dev_id, unnest(list_distinct(list_concat(sq, sa))) AS g FROM d) USING (g) GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY hits DESC, dev_id) AS rank FROM hit),
  judged AS (SELECT row, dev_id, rank, {_JAC('p.sa', 'd.sa')} AS near, {_JAC('p.sq', 'd.sq')} AS asked, len(list_intersect(p.sq, d.sq)) / greatest(least(len(p.sq), len(d.sq)), 1) AS held, len(p.sq) AS n, len(list_intersect(p.o, d.o)) AS same FROM ranked JOIN p USING (row) JOIN d USING (dev_id) WHERE rank <= 8),
  why AS (SELECT row, dev_id, rank, CASE WHEN near >= 0.5 THEN 'near-duplicate of a test question (similarity ' || format('{{:.2f}}', near) || ')' WHEN asked >= 0.8 AND same >= 1 THEN 'same question text as a test question' WHEN held >= 0.8 AND n >= 15 AND same >= 2 THEN 'test question with extra words around it' END AS reason FROM judged)"""


@query(f"WITH {_OVERLAP} SELECT row, arg_min(dev_id, rank) AS dev_id, arg_min(reason, rank) AS reason FROM why WHERE reason IS NOT NULL GROUP BY row")
def near_dup_rules(spark, d):
    return dedup.test_overlap(dedup.question_grams(PROBE.df(spark)), dedup.question_grams(DEV.df(spark)), "row", "dev_id")


# -- the training set as a whole

_META = "struct<difficulty:string,grade:int,type:string,term:int,year:int,region:string,source:string,pdf:string,n_options:int,needs_context:boolean,original_n_options:int>"
EXTRACTED = Rows("row int, q_no int, subject string, question string, choices array<string>, answer int, grade int, source string, pdf string, ctx boolean", (
    (1, 1, "civics", "first question of all, kept", FOUR, 2, 10, None, "grade_10/a.pdf", False), (2, 2, "civics", "no answer here", FOUR, None, 10, None, "grade_10/a.pdf", False), (3, 3, "civics", "zero answer here", FOUR, 0, 10, None, "grade_10/a.pdf", True),
    (4, 4, "civics", "with a figure", FOUR, 1, 10, None, "grade_10/a.pdf", True), (5, 5, "civics", "only three", FOUR[:3], 1, 10, None, "grade_10/a.pdf", False), (6, 6, "civics", "blank option", ["a", " ", "c", "d"], 1, 10, None, "grade_10/a.pdf", None),
    (7, 7, "History", "five options that become four", [*FOUR, "epsilon five"], 5, 11, None, "grade_11/b.pdf", False), (8, 8, "History", "of the same paper", FOUR, 1, 11, "https://www.s.lk/Paper/", "grade_11/b.pdf", False), (9, 9, "History", _LONG + " in the north", ["Parakrama", "Mahasen", "Vijaya", "Dutugemunu"], 1, 11, None, "grade_11/b.pdf", False),
    (10, 10, "History", "First question, of all: KEPT", FOUR[::-1], 3, 11, None, "grade_11/b.pdf", False), (11, 1, "Physics", "another question that stays", FOUR, 1, 10, "https://o.lk/x", "grade_10/a.pdf", False), (12, 12, "Physics", "no options", [], 1, 10, None, None, False), (13, 13, "Physics", "answer out of range", FOUR, 6, None, None, None, False),
    (14, 14, "Physics", "without grade or file", FOUR, 4, None, "", None, False),
))
DEV_SOURCES = {1: None, 2: "http://s.lk/paper", 3: "", 4: None}
_MD5_PICK = "list_position(['0','1','2','3','4','5','6','7','8','9','a','b','c','d','e','f'], md5(question)[32:32]) - 1"
_DECISIONS = f"""x AS (SELECT *, len(choices) = 5 AND coalesce(answer, 0) <> 0 AS five, ({_MD5_PICK}) % 4 AS pick FROM {EXTRACTED.sql}),
  y AS (SELECT *, pick + CASE WHEN pick >= answer - 1 THEN 1 ELSE 0 END AS gone FROM x),
  z AS (SELECT row, q_no, subject, question, grade, source, pdf, ctx, five AND NOT coalesce(ctx, false) AS was_five, CASE WHEN five THEN list_filter(choices, lambda c, i: i <> gone + 1) ELSE choices END AS choices, CASE WHEN five AND gone < answer - 1 THEN answer - 1 ELSE answer END AS answer FROM y),
  e AS (SELECT *, CASE WHEN coalesce(answer, 0) = 0 OR len(choices) = 0 THEN 'no answer' WHEN coalesce(ctx, false) THEN 'needs context' WHEN len(choices) <> 4 OR NOT (answer BETWEEN 1 AND 4) OR len({_BLANK}) > 0 THEN 'malformed' WHEN lower(regexp_replace(regexp_replace(source, '^https?://(www\\.)?', ''), '/+$', '')) = 's.lk/paper' THEN 'same paper' END AS early FROM z),
  p AS {_SIDE('row', '(SELECT row, question, choices FROM e WHERE early IS NULL)')}, d AS {_SIDE('dev_id', DEV.sql)},""" + _OVERLAP.split(f"d AS {_SIDE('dev_id', DEV.sql)},", 1)[1] + f""",
  o AS (SELECT DISTINCT row FROM why WHERE reason IS NOT NULL),
  k AS (SELECT e.*, coalesce(early, CASE WHEN o.row IS NOT NULL THEN 'overlaps test' END) AS dec, {_K('question')} || '|' || array_to_string(list_sort(list_transform(choices, lambda c: {_K('c')})), '|') AS key FROM e LEFT JOIN o USING (row)),
  w AS (SELECT *, coalesce(dec, CASE WHEN row_number() OVER (PARTITION BY key, dec IS NULL ORDER BY row) = 1 THEN 'kept' ELSE 'repeated' END) AS decision FROM k)"""


def _training(spark: SparkSession):
    meta = F.struct(
        F.lit(None).cast("string").alias("difficulty"), "grade", F.lit("extracted_pdf").alias("type"), F.lit(None).cast("int").alias("term"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("region"),
        "source", "pdf", F.size("choices").alias("n_options"), F.col("ctx").alias("needs_context"), F.lit(None).cast("int").alias("original_n_options"),
    )
    extracted = EXTRACTED.df(spark).withColumn("metadata", meta.cast(_META)).withColumn("category", F.lit("humanities")).drop("grade", "source", "pdf", "ctx")
    sources = spark.createDataFrame(list(DEV_SOURCES.items()), "dev_id int, source string")
    dev = DEV.df(spark).join(sources, "dev_id").select(F.col("dev_id").cast("string").alias("id"), "question", "choices", F.lit("History").alias("subject"), F.struct("source").alias("metadata"))
    return training.training_set(extracted, dev, saver(spark, "training")), dev


@query(f"WITH {_DECISIONS} SELECT decision, count(*) AS n, count(*) FILTER (was_five) AS n_from_five FROM w GROUP BY decision")
def training_set_decisions(spark, d):
    return _training(spark)[0].counts


@query(f"""WITH {_DECISIONS}, i AS (SELECT *, 'g' || coalesce(CAST(grade AS VARCHAR), 'None') || '::' || regexp_replace(regexp_extract(coalesce(pdf, 'x'), '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') || '::' || q_no AS base FROM w WHERE decision = 'kept'),
  j AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY row) AS n FROM i)
  SELECT CASE WHEN n > 1 THEN base || '#' || n ELSE base END AS id, CASE subject WHEN 'civics' THEN 'Citizenship Education' ELSE subject END AS subject, question, array_to_string(choices, '|') AS choices, answer, grade, source, 'extracted' AS dataset, CAST(CASE WHEN was_five THEN 5 ELSE len(choices) END AS INTEGER) AS original_n_options FROM j""")
def training_set_kept(spark, d):
    return _training(spark)[0].kept.select("id", "subject", "question", F.array_join("choices", "|").alias("choices"), "answer", "grade", "source", "dataset", "original_n_options")


@query(f"""WITH {_DECISIONS}, f AS (SELECT row, arg_min(dev_id, rank) AS dev_id, arg_min(reason, rank) AS reason FROM why WHERE reason IS NOT NULL GROUP BY row)
  SELECT w.row, CASE WHEN decision = 'same paper' THEN 'same exam paper as a test question' ELSE reason END AS removed_because, v.question AS dev_question FROM w LEFT JOIN f ON f.row = w.row AND decision = 'overlaps test' LEFT JOIN {DEV.sql} v ON v.dev_id = f.dev_id WHERE decision IN ('same paper', 'overlaps test')""")
def training_set_removed(spark, d):
    return _training(spark)[0].removed.select("row", "removed_because", "dev_question")


@query(f"""WITH {_DECISIONS}, kept AS (SELECT *, CASE subject WHEN 'civics' THEN 'Citizenship Education' ELSE subject END AS s FROM w WHERE decision = 'kept')
  SELECT 'split' AS part, 'train' AS key, count(*) AS n FROM kept UNION ALL SELECT 'split', 'test', count(*) FROM {DEV.sql} UNION ALL SELECT 'decision', decision, count(*) FROM w GROUP BY decision
  UNION ALL SELECT 'grade', coalesce(CAST(grade AS VARCHAR), 'None'), count(*) FROM kept GROUP BY ALL UNION ALL SELECT 'subject', s, count(*) FROM kept GROUP BY ALL UNION ALL SELECT 'test subject', v, count(*) FROM {DEV.sql}, (VALUES ('Botany')) t(v) GROUP BY ALL
  UNION ALL SELECT 'answer', CAST(answer AS VARCHAR), count(*) FROM kept GROUP BY ALL UNION ALL SELECT 'only in test', 'Botany', count(*) FROM {DEV.sql}""")
def training_summary(spark, d):
    made, dev = _training(spark)
    return training.summary(training.with_validation(made.kept), dev.withColumn("subject", F.lit("Botany")), made.counts)


RAW_ROWS = Rows("id string, subject string, question string, choices array<string>, answer string", (
    ("a1", "Eastern music", "Q1", ["x", "y"], "1"), ("a2", "Eastern_music", "Q1 ", [" x", "y"], "2"), ("a3", "Eastern music", "Q2", ["x", "y"], " y "), ("a4", "history", "Q3", ["x", "y"], "z"), ("a5", "History", "Q3", ["x"], "1"), ("a6", "History", "Q3", ["y", "x"], "1"), ("a7", "History", "Q3", ["x", "y"], "3"),
    ("a8", "History", "Q3", ["x", "y"], "2"), ("a9", None, " ", ["x", "y"], "2"),
))


@query(f"""WITH k AS (SELECT *, lower(trim(replace(subject, '_', ' '))) AS key FROM {RAW_ROWS.sql}), c AS (SELECT key, subject, count(*) AS n, min(id) AS f FROM k GROUP BY ALL), b AS (SELECT key, arg_min(subject, struct_pack(n := -n, f := f)) AS best FROM c GROUP BY key),
  r AS (SELECT id, coalesce(best, subject) AS subject, question, choices, CASE WHEN TRY_CAST(trim(answer) AS INTEGER) BETWEEN 1 AND len(choices) THEN TRY_CAST(trim(answer) AS INTEGER) ELSE nullif(list_position(list_transform(choices, lambda c: trim(c)), trim(answer)), 0) END AS answer FROM k LEFT JOIN b USING (key)),
  w AS (SELECT *, answer IS NULL OR trim(question) = '' OR len(choices) < 2 OR len({_BLANK}) > 0 AS bad FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY bad, trim(question) || '||' || array_to_string(list_transform(choices, lambda c: trim(c)), '|') ORDER BY id) AS n FROM w)
  SELECT id, CASE WHEN bad THEN 'bad' WHEN n > 1 THEN 'repeated' ELSE 'kept' END AS why, CASE WHEN NOT bad AND n = 1 THEN subject END AS subject, CASE WHEN NOT bad AND n = 1 THEN CAST(answer AS INTEGER) END AS answer FROM n""")
def validate_raw(spark, d):
    kept, dropped = training.validate(RAW_ROWS.df(spark))
    return kept.select("id", F.lit("kept").alias("why"), "subject", "answer").unionByName(dropped.withColumn("subject", F.lit(None).cast("string")).withColumn("answer", F.lit(None).cast("int")))


# -- papers

LINE = "paper_id string, line_no int, text string, page int, x0 double, y0 double, x1 double, y1 double"


def _lines(name: str, texts: list[str]) -> list[tuple]:
    return [(name, i, t, 0, 50.0, 100.0 + 12 * i, 400.0, 110.0 + 12 * i) for i, t in enumerate(texts)]


def _cells(name: str, first: int, cells: list[tuple[str, float, float]]) -> list[tuple]:
    return [(name, first + i, t, 1, float(x), float(y), float(x), float(y)) for i, (t, x, y) in enumerate(cells)]


def _digits(n: int, options: int = 4) -> list[str]:
    return [x for i in range(1, n + 1) for x in (f"{i:02d}. Question {i} text", f"wrapped part {i}", "  ".join(f"({k}) o{k}x{i}" for k in range(1, options + 1)))]


def _roman(n: int) -> list[str]:
    return [x for i in range(1, n + 1) for x in (f"{i}. Ask {i}", f"(i) a{i} (ii) b{i}", f"(iii) c{i}", f"(iv) d{i}")]


_N = 10
PAPERS = (
    _lines("pairs", [*_digits(6), "Marking scheme", "පිළිතුරු", "(01) 2 (02) 3 (03) 1", "04. 4  05 - 2  06) 1"])
    + _lines("roman", [*_roman(6), "Marking scheme", "( 3 )", "-", "1", "ii", "4", "2", "iv"])
    + _lines("five", [*_digits(9, 5), "Part II", "answers", " ".join(f"{i}) {i % 5 + 1}" for i in range(1, 10))])
    + _lines("across", [*_digits(_N), "Marking scheme"]) + _cells("across", 100, [(str(i), 20 * i, 500) for i in range(1, _N + 1)] + [(str(i % 4 + 1), 20 * i + 3, 530) for i in range(1, _N + 1)])
    + _lines("down", [*_digits(_N), "Marking scheme"]) + _cells("down", 100, [(str(i), 60, 20 * i) for i in range(1, _N + 1)] + [(f"({i % 4 + 1})", 120, 20 * i) for i in range(1, _N + 1)])
    + _lines("short", _digits(4)) + _lines("ended", [*_digits(6), "Part II", "07. More", "(1) a (2) b (3) c (4) d"]) + _lines("bare", [*_digits(6), "Marking scheme", "1. 2 2. 3"])
    + _lines("refused", [*_digits(6), "07. x", "(1) a (2) b (3) c (4) d", "08. Swallowed", "(1) A full sentence. Then a very long text that goes on and on here (2) b (3) c (4) d", "09. Skips one", "(1) a9 (2) b9 (3) c9 (4) d9"])
)


def _parsed(spark: SparkSession):
    return parse.parse_papers(spark.createDataFrame(PAPERS, LINE), saver(spark, "papers"))


_MADE = f"""made(paper_id, n, w) AS (VALUES ('pairs', 6, 4), ('five', 9, 5), ('across', {_N}, 4), ('down', {_N}, 4), ('ended', 6, 4), ('bare', 6, 4), ('refused', 6, 4)),
  asked AS (SELECT paper_id, unnest(range(1, n + 1)) AS i, w FROM made),
  digits AS (SELECT paper_id, i, 'Question ' || i || ' text wrapped part ' || i AS question, array_to_string(list_transform(range(1, w + 1), lambda k: 'o' || k || 'x' || i), '|') AS choices FROM asked),
  roman AS (SELECT 'roman' AS paper_id, i, 'Ask ' || i AS question, 'a' || i || '|b' || i || '|c' || i || '|d' || i AS choices FROM range(1, 7) t(i))"""


@query(f"""WITH {_MADE} SELECT paper_id, CAST(i AS INTEGER) AS q_no, question, choices FROM (SELECT * FROM digits UNION ALL SELECT * FROM roman UNION ALL SELECT 'refused', 9, 'Skips one', 'a9|b9|c9|d9')""")
def parse_layouts(spark, d):
    """Digit and roman options, five options, wrapped lines, a heading that ends the questions, too few questions (none),
    refused ones (a question of one letter, an option that has swallowed text) and a number that is skipped."""
    return _parsed(spark).filter("kind = 'question'").select("paper_id", "q_no", "question", F.array_join("choices", "|").alias("choices"))


@query(f"""WITH {_MADE}, keys AS (SELECT 'pairs' AS paper_id, i, [2, 3, 1, 4, 2, 1][i] AS answer, 'pairs' AS method FROM range(1, 7) t(i) UNION ALL SELECT 'roman', i, [3, 1, 2, 4, 2, 4][i], 'sequence' FROM range(1, 7) t(i) UNION ALL SELECT 'five', i, i % 5 + 1, 'pairs' FROM range(1, 10) t(i)
  UNION ALL SELECT 'across', i, i % 4 + 1, 'table' FROM range(1, {_N + 1}) t(i) UNION ALL SELECT 'down', i, i % 4 + 1, 'table' FROM range(1, {_N + 1}) t(i) UNION ALL SELECT p, i, NULL, 'none' FROM range(1, 7) t(i), (VALUES ('ended'), ('bare'), ('refused')) v(p) UNION ALL SELECT 'refused', 9, NULL, 'none')
  SELECT paper_id, CAST(i AS INTEGER) AS q_no, CAST(answer AS INTEGER) AS answer, method FROM keys""")
def parse_key_layouts(spark, d):
    """Keys as pairs, a sequence, a table across and down; one that answers too little; none."""
    return _parsed(spark).filter("kind = 'question'").select("paper_id", "q_no", "answer", "method")


KEY_FILES = _lines("forty", [f"{i}. {i % 5 + 1}" for i in range(1, 41)]) + _lines("dozen", [f"{i}. 1" for i in range(1, 13)]) + _lines("text", ["nothing of a key"]) + _lines("list", ["පිළිතුරු", *[str(i % 4 + 1) for i in range(1, 31)]])


@query("""SELECT 'forty' AS paper_id, 'key' AS kind, CAST(i AS INTEGER) AS q_no, CAST(i % 5 + 1 AS INTEGER) AS answer FROM range(1, 41) t(i) UNION ALL SELECT 'list', 'key', CAST(i AS INTEGER), CAST(i % 4 + 1 AS INTEGER) FROM range(1, 31) t(i)
  UNION ALL SELECT p, 'none', NULL, NULL FROM (VALUES ('dozen'), ('text')) v(p)""")
def key_only_files(spark, d):
    return parse.parse_papers(spark.createDataFrame(KEY_FILES, LINE), saver(spark, "papers")).select("paper_id", "kind", "q_no", "answer")


BODY = Rows("id int, text string, y0 double, y1 double", (
    (1, "Term Test 2020", 400.0, 410.0), (2, " ", 400.0, 410.0), (3, "- 3 -", 10.0, 20.0), (4, "3", 400.0, 410.0), (5, "text", 10.0, 20.0), (6, "12", 790.0, 799.0), (7, "කාලය පැය 2", 300.0, 310.0), (8, "ප්‍රශ්නය", 300.0, 310.0), (9, "past   papers", 300.0, 310.0), (10, "", 300.0, 310.0),
))


@query(f"""SELECT id FROM {BODY.sql} WHERE NOT (regexp_matches(text, '^\\s*$') OR regexp_matches(text, '{parse.HEADER}', 'i') OR (y1 < 0.07 * 800 OR y0 > 0.93 * 800) AND regexp_matches(text, '^\\s*-?\\s*[0-9]{{1,2}}\\s*-?\\s*$'))""".replace("{{", "{").replace("}}", "}"))
def body_lines(spark, d):
    return parse.body_lines(BODY.df(spark).withColumn("page_height", F.lit(800.0))).select("id")


MARKERS = _lines("digits", ["1. a", "(2) b", "3. c", "iv d", "5) e"]) + _lines("romans", ["i. a", "(ii) b", "iii c", "1. d"]) + _lines("fives", [f"({k}) x" for _ in range(8) for k in range(1, 6)]) + _lines("fours", [f"({k}) x" for _ in range(8) for k in range(1, 5)]) + _lines("few", [f"({k}) x" for _ in range(7) for k in range(1, 6)])


@query("SELECT paper_id, style, CAST(n AS INTEGER) AS options FROM (VALUES ('digits', 'digit', 4), ('romans', 'roman', 4), ('fives', 'digit', 5), ('fours', 'digit', 4), ('few', 'digit', 4)) v(paper_id, style, n)")
def option_styles(spark, d):
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = pdf.sort_values("line_no")["text"].tolist()
        pattern = parse.option_pattern(lines)
        return pd.DataFrame({"paper_id": [pdf["paper_id"].iloc[0]], "style": ["roman" if pattern is parse.ROMAN_OPTION else "digit"], "options": [parse.options_per_question(lines, pattern)]})

    return spark.createDataFrame(MARKERS, LINE).groupBy("paper_id").applyInPandas(one, "paper_id string, style string, options int")


_FULL = [_SI * 60, *_digits(6)]
EXTRACT_LINES = _lines("grade_10/a.pdf", _FULL) + _lines("grade_10/b.pdf", [f"{i:02d}. {i % 4 + 1}" for i in range(1, 21)]) + _lines("grade_10/c.pdf", _FULL) + _lines("grade_10/d.pdf", ["the of and to " * 30]) + _lines("grade_10/f.pdf", [_SI * 60])
EXTRACT_PAPERS = Rows("paper_id string, subject string, grade string, term string, year string, region string, source_page string, pdf_url string", tuple(
    (f"grade_10/{x}.pdf", "Science", "10", "2", "2020", "", s, "u") for x, s in (("a", "page1"), ("b", "page1"), ("c", ""), ("d", "page3"), ("e", "page4"), ("f", "page5"))
))


def _extraction(spark: SparkSession):
    dev = spark.createDataFrame([("Question 6 text wrapped part 6", [f"o{k}x6" for k in range(1, 5)])], "question string, choices array<string>")
    return extraction.extract(spark.createDataFrame(EXTRACT_LINES, LINE), EXTRACT_PAPERS.df(spark), dev, saver(spark, "extract"))


@query("""SELECT 'grade_10/a.pdf' AS paper_id, CAST(i AS INTEGER) AS q_no, 'Question ' || i || ' text wrapped part ' || i AS question, CAST(i % 4 + 1 AS INTEGER) AS answer, 'stem' AS category, 10 AS grade, 2 AS term, 2020 AS year, 'page1' AS source FROM range(1, 6) t(i)""")
def extract_questions(spark, d):
    """Answers come from the key file of the same page; the paper without one repeats the same questions; the sixth is a test question."""
    q = _extraction(spark)["questions"]
    return q.select("paper_id", "q_no", "question", "answer", "category", "metadata.grade", "metadata.term", "metadata.year", "metadata.source")


@query("""SELECT 'grade_10/' || p || '.pdf' AS paper_id, status, CAST(q AS BIGINT) AS questions, CAST(a AS BIGINT) AS answers FROM (VALUES ('a', 'ok', 6, 6), ('b', 'answer_key_only', 0, 0), ('c', 'ok', 6, 0), ('d', 'english_medium', 0, 0), ('e', 'needs_ocr', 0, 0), ('f', 'no_mcq_found', 0, 0)) v(p, status, q, a)""")
def extract_report(spark, d):
    return _extraction(spark)["report"].select("paper_id", "status", "questions", "answers")


@query(f"SELECT paper_id, status, nullif(source_page, '') AS source FROM {EXTRACT_PAPERS.sql} JOIN (VALUES ('grade_10/e.pdf', 'needs_ocr'), ('grade_10/f.pdf', 'no_mcq_found')) v(p, status) ON p = paper_id")
def extract_needs_ocr(spark, d):
    return _extraction(spark)["needs_ocr"].select("paper_id", "status", "source")


# -- crawling

_A = lambda *links: "".join(f'<p><a class="x" href="{h}">t</a></p>' for h in links)
SITE = Rows("url string, html string", (
    ("https://s.lk/grade-10/", _A("grade-10-history-papers", "/grade-10-science?page=2#top", "https://other.lk/grade-10", "grade-11", "/grade-10/tag/x", "../grade-10-drama-notes")),
    ("https://s.lk/grade-10-history-papers", _A("/files/History-1st-Term-Paper-2019.pdf", "files/grade-10-history-notes.pdf", "https://s.lk/grade-10/", "/files/history-tamil-medium-paper.pdf")),
    ("https://s.lk/grade-10-science", "<A HREF='/files/grade-10-science-exam-2020-answers.pdf?d=1'>x</A>" + _A("/files/History-1st-Term-Paper-2019.pdf", "/files/russian-paper.pdf", "/files/royal-college-2nd-term-test.pdf") + "<a name=x>no link</a>"),
))
CRAWL_NAMES = Rows("name string, subject string", (("history", "History"), ("science", "Science"), ("drama", "Drama and Theatre"), ("russian", None)))
_JOINED = """(VALUES ('https://s.lk/grade-10/', 0, 'https://s.lk/grade-10/grade-10-history-papers'), ('https://s.lk/grade-10/', 1, 'https://s.lk/grade-10-science?page=2#top'), ('https://s.lk/grade-10/', 2, 'https://other.lk/grade-10'), ('https://s.lk/grade-10/', 3, 'https://s.lk/grade-10/grade-11'), ('https://s.lk/grade-10/', 4, 'https://s.lk/grade-10/tag/x'),
  ('https://s.lk/grade-10/', 5, 'https://s.lk/grade-10-drama-notes'), ('https://s.lk/grade-10-history-papers', 0, 'https://s.lk/files/History-1st-Term-Paper-2019.pdf'), ('https://s.lk/grade-10-history-papers', 1, 'https://s.lk/files/grade-10-history-notes.pdf'), ('https://s.lk/grade-10-history-papers', 2, 'https://s.lk/grade-10/'), ('https://s.lk/grade-10-history-papers', 3, 'https://s.lk/files/history-tamil-medium-paper.pdf'),
  ('https://s.lk/grade-10-science', 0, 'https://s.lk/files/grade-10-science-exam-2020-answers.pdf?d=1'), ('https://s.lk/grade-10-science', 1, 'https://s.lk/files/History-1st-Term-Paper-2019.pdf'), ('https://s.lk/grade-10-science', 2, 'https://s.lk/files/russian-paper.pdf'), ('https://s.lk/grade-10-science', 3, 'https://s.lk/files/royal-college-2nd-term-test.pdf')) v(url, pos, link)"""


@query(f"SELECT url, CAST(pos AS INTEGER) AS pos, link FROM {_JOINED}")
def resolved_links(spark, d):
    return crawl.extract_links(SITE.df(spark)).select("url", "pos", "link")


@query("""SELECT * FROM (VALUES ('History', 'https://s.lk/files/History-1st-Term-Paper-2019.pdf', 'https://s.lk/grade-10-history-papers', 1, 2019, false, ''), ('Science', 'https://s.lk/files/grade-10-science-exam-2020-answers.pdf?d=1', 'https://s.lk/grade-10-science', NULL, 2020, true, ''),
  ('Science', 'https://s.lk/files/royal-college-2nd-term-test.pdf', 'https://s.lk/grade-10-science', NULL, NULL, false, '')) v(subject, pdf_url, source_page, term, year, has_answers, region)""")
def linked_papers(spark, d):
    """A paper of its own name's subject, one of its page's, notes, another medium, a subject that isn't wanted, a second page."""
    found, _ = crawl.paper_links(SITE.df(spark), CRAWL_NAMES.df(spark), ("s.lk",), 10)
    return found.select("subject", "pdf_url", "source_page", "term", "year", "has_answers", "region")


@query("""SELECT * FROM (VALUES ('https://s.lk/grade-10/', 'https://s.lk/grade-10/grade-10-history-papers'), ('https://s.lk/grade-10/', 'https://s.lk/grade-10-science'), ('https://s.lk/grade-10-history-papers', 'https://s.lk/grade-10/'), ('https://s.lk/grade-10/', 'https://s.lk/grade-10/grade-11')) v(url, link)""")
def pages_to_visit(spark, d):
    _, follow = crawl.paper_links(SITE.df(spark), CRAWL_NAMES.df(spark), ("s.lk",), 10)
    return follow


# -- catalogue, log, sets

LISTED = Rows("local_path string, subject string", (("grade_10/History/term_1/a-2019.pdf", "History"), ("grade_10/History/term_1/gone.pdf", "History")))
ON_DISK = Rows("local_path string", (("grade_10/History/term_1/a-2019.pdf",), ("grade_06/Drama/term_unknown/b-2018-2021.pdf",), ("grade_07/Arts/term_3/c.pdf",), ("loose.pdf",), ("grade_07/Arts/term_3/notes.txt",)))


@query(f"""SELECT local_path, subject, CAST(NULL AS VARCHAR) AS grade, CAST(NULL AS VARCHAR) AS term, CAST(NULL AS VARCHAR) AS year FROM {LISTED.sql} l WHERE EXISTS (SELECT 1 FROM {ON_DISK.sql} o WHERE o.local_path = l.local_path) UNION ALL
  SELECT local_path, split_part(local_path, '/', 2), split_part(split_part(local_path, '/', 1), '_', 2), CASE WHEN regexp_matches(split_part(local_path, '/', 3), '[0-9]$') THEN split_part(split_part(local_path, '/', 3), '_', 2) ELSE '' END, coalesce(list_max(regexp_extract_all(split_part(local_path, '/', 4), '20[0-3][0-9]')), '')
  FROM {ON_DISK.sql} o WHERE NOT EXISTS (SELECT 1 FROM {LISTED.sql} l WHERE o.local_path = l.local_path) AND regexp_matches(local_path, '^grade_[^/]*/[^/]*/[^/]*/[^/]*\\.pdf$')""")
def catalog_and_orphans(spark, d):
    return joins.catalog(LISTED.df(spark), ON_DISK.df(spark)).select("local_path", "subject", "grade", "term", "year")


PARTS = {"train": Rows("id string", (("a",), ("b",), ("b",), (None,))), "val": Rows("id string", (("c",), ("b",))), "test": Rows("id string", (("d",), (None,)))}


@query(f"""WITH t AS (SELECT DISTINCT 'train' AS p, id FROM {PARTS['train'].sql} UNION SELECT 'val', id FROM {PARTS['val'].sql} UNION SELECT 'test', id FROM {PARTS['test'].sql}), v(first, second) AS (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test'))
  SELECT first, second, (SELECT count(*) FROM t a JOIN t b ON a.id = b.id WHERE a.p = first AND b.p = second) AS n FROM v""")
def shared_ids(spark, d):
    return joins.shared_ids({k: v.df(spark) for k, v in PARTS.items()})


TEST_SUBJECTS, TRAIN_SUBJECTS = Rows("subject string", (("History",), ("Arts",), ("Arts",), ("Islam",))), Rows("subject string", (("History",), ("Science",)))


@query(f"SELECT DISTINCT subject FROM {TEST_SUBJECTS.sql} EXCEPT SELECT subject FROM {TRAIN_SUBJECTS.sql}")
def subjects_only_in_test(spark, d):
    return TEST_SUBJECTS.df(spark).subtract(TRAIN_SUBJECTS.df(spark))


TRIALS = Rows("lang string, lr double, r int, score double", (("en", 0.1, 8, 0.5), ("en", 0.1, 16, 0.6), ("si", 0.2, 8, 0.6)))


@query(f"SELECT lang, lr, r FROM (VALUES ('en'), ('si')) a(lang), (VALUES (0.1::DOUBLE), (0.2::DOUBLE)) b(lr), (VALUES (8), (16)) c(r) WHERE NOT EXISTS (SELECT 1 FROM {TRIALS.sql} t WHERE t.lang = a.lang AND t.lr = b.lr AND t.r = c.r)")
def resume_grid(spark, d):
    grid = spark.createDataFrame([(a, b, c) for a in ("en", "si") for b in (0.1, 0.2) for c in (8, 16)], "lang string, lr double, r int")
    return joins.todo(grid, TRIALS.df(spark), "lang", "lr", "r")


ACCURACY = Rows("id int, subject string, category string, correct boolean, pred int", ((1, "a", "x", True, 1), (2, "a", "x", False, 2), (3, "b", "x", True, 1), (4, "c", "y", False, None), (5, None, "y", True, 1), (6, "d", None, True, 3)))


@query(f"SELECT subject, n, accuracy, CAST(row_number() OVER (ORDER BY accuracy DESC, subject) AS INTEGER) AS place FROM (SELECT subject, count(*) AS n, round_even(avg(correct::INT::DOUBLE), 4) AS accuracy FROM {ACCURACY.sql} WHERE subject IS NOT NULL GROUP BY subject)")
def accuracy_in_order(spark, d):
    rows = metrics.accuracy_by(ACCURACY.df(spark), "subject").orderBy(F.desc("accuracy"), "subject").coalesce(1)
    return rows.withColumn("place", (F.monotonically_increasing_id() + 1).cast("int"))


@query("SELECT CAST(i AS INTEGER) AS id, CAST(row_number() OVER (ORDER BY md5('42-' || i), i) AS INTEGER) AS place FROM range(1, 31) t(i)")
def shuffled_rows(spark, d):
    rows = sampling.shuffle(spark.range(1, 31).select(F.col("id").cast("int")), "id").coalesce(1)
    return rows.withColumn("place", (F.monotonically_increasing_id() + 1).cast("int"))


LENGTHS = Rows("id int, n int", ((1, 5), (2, 9), (3, 3), (4, 3), (5, 20), (6, 4), (7, 7)))


@query("SELECT CAST(id AS INTEGER) AS id, CAST(batch AS INTEGER) AS batch FROM (VALUES (3, 0), (4, 0), (6, 0), (1, 1), (7, 1), (2, 2), (5, 3)) v(id, batch)")
def token_budget_batches(spark, d):
    """Sorted lengths 3 3 4 5 7 9 20, padded size of a batch at most 14."""
    return sampling.pack_batches(LENGTHS.df(spark), "n", 14, F.lit(0), "id").select("id", "batch")


TOKENS = Rows("id int, prompt array<int>, whole array<int>", ((1, [1, 2], [1, 2, 3]), (2, [1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 6]), (3, [], [7]), (4, [1], [1])))


@query(f"SELECT id, array_to_string(whole, ',') AS input_ids, array_to_string(list_concat(list_transform(prompt, lambda x: -100), whole[len(prompt) + 1:]), ',') AS labels, (SELECT count(*) FROM {TOKENS.sql} WHERE len(whole) > 5) AS skipped FROM {TOKENS.sql} WHERE len(whole) <= 5")
def training_examples(spark, d):
    rows, skipped = scoring.training_examples(TOKENS.df(spark), "prompt", "whole", 5)
    n = skipped.first()[0]
    return rows.select("id", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"), F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"), F.lit(n).cast("long").alias("skipped"))


SCORES = Rows("id int, scores array<double>", ((1, [0.1, 0.9, 0.3]), (2, [2.0, 2.0]), (3, [-5.0, -1.0, -3.0, -2.0])))


@query(f"SELECT id, CAST(list_position(scores, list_max(scores)) AS VARCHAR) AS raw_output FROM {SCORES.sql}")
def choice_scores(spark, d):
    return scoring.choice_scores_to_output(SCORES.df(spark)).select("id", "raw_output")


BROWSED = Rows("id int, subject string, q_no int, question string, choices array<string>, answer int, pdf string", ((1, "History", 1, "Q", ["a", "b"], 2, "grade_10/A.pdf"), (2, "history of art", 2, "R", ["c"], None, "grade_10/b.pdf"), (3, "Science", 3, "S", ["d"], 1, "x/a.pdf"), (4, None, 4, "T", ["e"], 1, None)))


@query(f"""SELECT id, subject || ' | Q' || q_no || ' | ? term ? | ' || coalesce(pdf, '?') || chr(10) || chr(10) || question || chr(10) || array_to_string(list_transform(choices, lambda c, i: '   (' || i || ') ' || c || CASE WHEN answer = i THEN '   <== answer' ELSE '' END), chr(10)) AS shown
  FROM {BROWSED.sql} WHERE contains(lower(coalesce(subject, '')), 'hist') AND contains(lower(coalesce(pdf, '')), 'a.pdf') AND coalesce(answer, 0) <> 0""")
def browse_questions(spark, d):
    q = BROWSED.df(spark).withColumn("metadata", F.struct(F.col("pdf").alias("pdf"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("int").alias("term"), F.lit(False).alias("needs_context")))
    return browse.browse(q, "HIST", "a.PDF", True, None).select("id", "shown")


@query(f"SELECT local_path FROM {ON_DISK.sql} WHERE starts_with(local_path, 'grade_07/')")
def papers_of_grade(spark, d):
    return browse.of_grade(ON_DISK.df(spark), 7)


DEV_KEYS = Rows("question string, choices array<string>", (("Q  one ,", ["a", "b"]), ("Q two", ["x"])))
NEW_ROWS = Rows("paper_id string, q_no int, question string, choices array<string>", (("p1", 1, "Q one", ["a", "b"]), ("p1", 2, "Q one", ["b", "a"]), ("p2", 1, "Q  three", ["c"]), ("p1", 3, "Q three ;", [" c"]), ("p2", 2, "Q two", ["y"])))
_LINE_KEY = "regexp_replace(regexp_replace(question, '\\s+', ' ', 'g'), '^[ ,;]+|[ ,;]+$', '', 'g') || '||' || array_to_string(list_transform(choices, lambda c: regexp_replace(regexp_replace(c, '\\s+', ' ', 'g'), '^[ ,;]+|[ ,;]+$', '', 'g')), '|')"


@query(f"""WITH k AS (SELECT *, {_LINE_KEY} AS k FROM {NEW_ROWS.sql}) SELECT paper_id, q_no FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY paper_id, q_no) AS n FROM k WHERE k NOT IN (SELECT {_LINE_KEY} FROM {DEV_KEYS.sql})) WHERE n = 1""")
def first_of_each_line_key(spark, d):
    key = mcq.line_key(F.col("question"), F.col("choices"))
    known = DEV_KEYS.df(spark).select(key.alias("key")).distinct()
    rows = NEW_ROWS.df(spark).withColumn("key", key).join(known, "key", "left_anti")
    return dedup.keep_first(rows, F.col("key"), [F.col("paper_id"), F.col("q_no")]).select("paper_id", "q_no")


# -- readers and writers: what is written is read again

FLAT = Rows("q_no int, subject string, question string, answer string, grade int", ((1, " History ", "Q1\nline, \"two\"", "2", 10), (2, "Arts", "ප්‍රශ්නය", "text", None), (3, "Arts", "", None, 7)))


def _raw(spark: SparkSession):
    meta = F.from_json(F.to_json(F.struct("grade", F.lit(2020).alias("year"))), src.METADATA)
    return FLAT.df(spark).select("q_no", "subject", F.lit("c").alias("category"), "question", F.array(F.lit("a"), F.lit("b")).alias("choices"), "answer", meta.alias("metadata"))


@query(f"SELECT 'sub ject::' || q_no AS id, q_no, trim(subject) AS subject, question, answer, grade, 2020 AS year FROM {FLAT.sql}")
def json_array_round_trip(spark, d):
    """Written as an indented JSON array, and read as a raw file whose name gives the ids."""
    folder = scratch_folder(spark, "json-array")
    src.write_json_array(_raw(spark), f"{folder}/made", ["q_no"])
    whole = spark.read.text(f"{folder}/made", wholetext=True)
    whole.select("value").coalesce(1).write.text(f"{folder}/again")
    rename_part(spark, f"{folder}/again", f"{folder}/raw/sub ject.json")
    return src.read_raw(spark, f"{folder}/raw").select("id", "q_no", "subject", "question", "answer", "grade", "year")


def rename_part(spark: SparkSession, folder: str, to: str) -> None:
    """The only part file of a folder under another name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in store.listStatus(path(folder)) if s.getPath().getName().startswith("part-"))
    store.mkdirs(path(to).getParent())
    store.rename(part, path(to))


@query(f"SELECT q_no, subject, question, answer FROM {FLAT.sql}")
def jsonl_round_trip(spark, d):
    folder = scratch_folder(spark, "jsonl")
    src.write_jsonl(_raw(spark), folder)
    return src.read_jsonl(spark, folder, src.RAW).select("q_no", "subject", "question", "answer")


@query(f"SELECT q_no, question, TRY_CAST(answer AS INTEGER) AS answer, lpad(CAST(coalesce(grade, 0) AS VARCHAR), 2, '0') AS folder FROM {FLAT.sql}")
def by_grade_round_trip(spark, d):
    folder = scratch_folder(spark, "by-grade")
    src.write_by_grade(_raw(spark), folder, F.col("metadata.grade"))
    back = spark.read.schema(src.RAW).json(folder, recursiveFileLookup=True).withColumn("folder", F.regexp_extract("_metadata.file_path", "grade_folder=([0-9]+)", 1))
    return back.select("q_no", "question", F.col("answer").try_cast("int").alias("answer"), "folder")


@query(f"SELECT q_no, question, TRY_CAST(answer AS INTEGER) AS answer FROM {FLAT.sql} WHERE q_no <> 3")
def extracted_round_trip(spark, d):
    """Files of two grades, below folders of grades; other files beside them are passed over."""
    folder = scratch_folder(spark, "extracted")
    for n, grade in ((1, "10"), (2, "11"), (3, "12")):
        src.write_json_array(_raw(spark).filter(F.col("q_no") == n), f"{folder}/made{n}")
        rename_part(spark, f"{folder}/made{n}", f"{folder}/grade_{grade}/{'no_answer' if n == 3 else 'questions'}_grade_{grade}.json")
    return src.read_extracted(spark, folder).select("q_no", "question", "answer")


CSV_ROWS = Rows("grade string, subject string, term string, year string, region string, has_answers string, source_page string, pdf_url string", (("10", 'a "quoted", b', "1", "2020", None, "True", "p", "u1"), ("7", "සිංහල", None, None, "x\ny", "False", "p", "u2"), ("x", "c", "2", "20a", "r", None, None, "u3")))


@query(f"SELECT TRY_CAST(grade AS INTEGER) AS grade, subject, TRY_CAST(term AS INTEGER) AS term, TRY_CAST(year AS INTEGER) AS year, region, has_answers = 'True' AS has_answers, pdf_url FROM {CSV_ROWS.sql}")
def csv_round_trip(spark, d):
    folder = scratch_folder(spark, "csv")
    src.write_csv(CSV_ROWS.df(spark).coalesce(1), folder)
    return src.read_papers(spark, folder).select("grade", "subject", "term", "year", "region", "has_answers", "pdf_url")


ERRORS = Rows("url string, error string", (("u1", "not found"), ("u2", 'said "no", twice'), ("u3", "url"), ("url", "x")))


@query(f"SELECT url, error, CAST(1 AS BIGINT) AS headers FROM {ERRORS.sql}")
def error_log(spark, d):
    folder = scratch_folder(spark, "errors")
    for part in ("url in ('u1', 'u2')", "url not in ('u1', 'u2')"):
        src.append_errors(ERRORS.df(spark).filter(part), folder)
    headers = spark.read.text(folder).filter("value = 'url,error'").count()
    return src.read_errors(spark, folder).withColumn("headers", F.lit(headers).cast("long"))


@query(f"""WITH g AS (SELECT subject, count(*) AS n, round_even(avg(correct::INT::DOUBLE), 4) AS accuracy FROM {ACCURACY.sql} WHERE subject IS NOT NULL GROUP BY subject)
  SELECT '{{"by_subject":[' || string_agg('{{"subject":"' || subject || '","n":' || n || ',"accuracy":' || accuracy || '}}', ',' ORDER BY subject) || '],"overall":[{{"n":6,"accuracy":0.6667,"unparsed_rate":0.1667}}]}}' AS json FROM g""")
def metrics_json(spark, d):
    p = ACCURACY.df(spark)
    return src.report_json(by_subject=metrics.accuracy_by(p, "subject"), overall=metrics.overall(p))


FILES = Rows("local_path string, content string", (("grade_10/a.pdf", "%PDF-1.4 a"), ("grade_10/b/c.pdf", "%PDF-x"), ("bad.pdf", "<html>"), ("none.pdf", None)))


@query(f"""SELECT local_path, CASE WHEN content IS NULL THEN 'nothing to store' WHEN NOT starts_with(content, '%PDF-') THEN 'not a valid file' END AS error, CASE WHEN starts_with(content, '%PDF-') THEN sha256(content) END AS sha256, CASE WHEN starts_with(content, '%PDF-') THEN true END AS is_pdf FROM {FILES.sql}""")
def stored_files(spark, d):
    from .sources import remote

    folder = scratch_folder(spark, "files")
    said = saver(spark, "stored")(remote.store_files(FILES.df(spark).withColumn("content", F.col("content").cast("binary")), folder))
    return said.join(src.files_on_disk(spark, folder), "local_path", "left").select("local_path", "error", "sha256", "is_pdf")


# -- evaluation that goes on

ASKED = Rows("id string, subject string, category string, question string, choices array<string>, answer int", tuple((f"q{i}", "s", "c", f"Question {i}", ["w", "x", "y", "z"], i % 4 + 1) for i in range(1, 9)))


class Echo:
    """Says the number that the question ends with, modulo 5: 0 names no option."""

    def generate(self, batch):
        return [str(int(m[-1]["content"].split("\n")[0].split()[-1]) % 5) for m in batch]


_EVALUATED = f"SELECT id, answer, CAST(nullif(i % 5, 0) AS INTEGER) AS pred, coalesce(nullif(i % 5, 0) = answer, false) AS correct FROM (SELECT *, CAST(substr(id, 2) AS INTEGER) AS i FROM {ASKED.sql})"


@query(_EVALUATED + " WHERE id <> 'q8'")
def evaluation_goes_on(spark, d):
    """Three questions first; then seven, of which the log has three; the log may hold more than is asked for."""
    log, q = scratch_folder(spark, "log"), ASKED.df(spark)
    evaluation.run_eval(spark, q.filter("id in ('q1', 'q2', 'q8')"), Echo, log).count()
    return evaluation.run_eval(spark, q.filter("id <> 'q8'"), Echo, log).select("id", "answer", "pred", "correct")


@query(_EVALUATED)
def evaluation_as_a_stream(spark, d):
    folder, q = scratch_folder(spark, "stream"), ASKED.df(spark)
    for part in ("id < 'q4'", "id >= 'q4'"):
        q.filter(part).write.mode("append").json(f"{folder}/in")
        evaluation.stream_eval(spark, f"{folder}/in", q.schema, Echo, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(src.PREDICTIONS).json(f"{folder}/log").select("id", "answer", "pred", "correct")


VERSIONS = Rows("pdf_url string, version int, region string", (("u1", 1, "a"), ("u2", 1, "b"), ("u1", 2, "c"), ("u3", 3, None), ("u2", 5, "d"), ("u2", 4, "e")))


@query(f"SELECT pdf_url, arg_max(version, version) AS version, arg_max(struct_pack(r := region), version).r AS region FROM {VERSIONS.sql} GROUP BY pdf_url")
def upsert_as_a_stream(spark, d):
    """Two micro-batches; each is merged into the table that the last one left."""
    folder, rows = scratch_folder(spark, "upsert"), VERSIONS.df(spark)

    def merge(batch, number):
        old = spark.read.schema(rows.schema).parquet(f"{folder}/table-{number - 1}") if number else rows.limit(0)
        joins.upsert(old, batch, "pdf_url", "version").drop("first").write.mode("overwrite").parquet(f"{folder}/table-{number}")

    for part in ("version <= 2", "version > 2"):
        rows.filter(part).write.mode("append").parquet(f"{folder}/in")
        evaluation.stream_upsert(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), merge, "pdf_url", "version", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/table-1")


@query("SELECT CAST(1 AS BIGINT) AS made, i AS id FROM range(3) t(i)")
def cached_table(spark, d):
    """The second call reads what the first one made."""
    path, made = scratch_folder(spark, "cached") + "/t", []

    def make():
        made.append(1)
        return spark.range(3)

    src.cached(spark, path, make).count()
    return src.cached(spark, path, make).select(F.lit(len(made)).cast("long").alias("made"), "id")
