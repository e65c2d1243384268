"""Text normalisation, shingles, URLs and text statistics as column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"(?U)\s+"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(c: Column) -> Column:
    """Unicode NFC, for which Spark has no built-in; a text that is all ASCII doesn't leave the JVM. Null stays null."""
    return F.coalesce(_nfc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (trim takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def normalize_prompt_text(c: Column, with_nfc: bool = True) -> Column:
    """Text as a prompt has it: NFC, straight quotes, single spaces and joiners, no zero-width spaces or BOMs."""
    c = nfc(c) if with_nfc else c
    # fixed values: what is translated, and to what; the last two are deleted
    c = F.translate(c, "“”‘’` ​﻿", "\"\"''' ")
    c = F.regexp_replace(c, "‍+", "‍")
    c = F.regexp_replace(c, "''+", '"')
    c = F.regexp_replace(c, r"(?U)\s*\n\s*", "\n")
    return strip(F.regexp_replace(c, r"[ \t]+", " "))


def normalize_line(c: Column, with_nfc: bool = True) -> Column:
    """Text of an extracted line: NFC, no-break spaces and bullets as spaces, single spaces, ends cut of ' ,;'."""
    c = nfc(c) if with_nfc else c
    c = F.regexp_replace(F.translate(c, " •", "  "), SPACE, " ")
    return F.regexp_replace(c, r"^[ ,;]+|[ ,;]+$", "")


def compare_key(c: Column, with_nfc: bool = True) -> Column:
    """Lower-case letters and digits only, for comparing questions. Combining signs are dropped, too."""
    return F.regexp_replace(F.lower(nfc(c) if with_nfc else c), r"[^\p{L}\p{N}]+", "")


def shingles(c: Column, k: int = 4) -> Column:
    """Distinct character k-grams; a shorter text is its only shingle, the empty one included."""
    return F.when(F.char_length(c) < k, F.array(c)).otherwise(F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def overlap(a: Column, b: Column) -> Column:
    """Shared share of the smaller set."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))


# -- URLs

_NETLOC = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def url_host(c: Column) -> Column:
    return F.regexp_extract(c, _NETLOC, 1)


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, _PATH, 1)


def source_key(c: Column) -> Column:
    """Host (without any 'www.') and path, lower-case, no slash at the end: the same paper has the same key. '' for null."""
    c = F.coalesce(c, F.lit(""))
    return F.lower(F.regexp_replace(F.concat(F.replace(url_host(c), F.lit("www."), F.lit("")), url_path(c)), "/+$", ""))


def page_url(c: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(c, r"[?#].*$", "")


def without_fragment(c: Column) -> Column:
    return F.regexp_replace(c, "#.*$", "")


def last_slug(c: Column) -> Column:
    """Last segment of the path, percent-decoded ('+' stays), lower-case."""
    last = F.element_at(F.split(F.regexp_replace(url_path(c), "/+$", ""), "/"), -1)
    return F.lower(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))))


def clean_filename(c: Column, longest: int = 150) -> Column:
    return F.substring(strip(F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*]', "_"), SPACE, " ")), 1, longest)


# -- statistics

#: Frequent English words of exam papers.
ENGLISH_WORDS = ("the", "and", "of", "to", "is", "in", "for", "are", "which", "what", "answer", "question", "following", "paper", "write", "from", "with", "this", "that", "by", "on", "an", "be")
#: Fixed value: a question's number with its answer.
ANSWER_PAIR = r"(?U)\(?0?\d{1,2}\)?\s*[.)\-:–]?\s*\(?[1-4]\)?(?![\d.])"
#: Signs that follow a letter, and what they may follow.
DEPENDENT, LETTER = "ංඃ්ා-ෟ", "අ-ඖක-ෆ‍"


def sinhala_chars(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[඀-෿]"))


def words_in(c: Column, least: int = 1) -> Column:
    """Runs of at least so many ASCII letters, lower-case."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"[a-z]{{{least},}}"), F.lit(0))


def english_words(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*ENGLISH_WORDS)))


def broken_sign_ratio(c: Column) -> Column:
    """Share of dependent signs that don't follow a letter or another sign; 0 without signs."""
    signs = F.regexp_count(c, F.lit(f"[{DEPENDENT}]"))
    bad = F.regexp_count(c, F.lit(f"(?<![{LETTER}{DEPENDENT}])[{DEPENDENT}]"))
    return F.when(signs > 0, bad / signs).otherwise(F.lit(0.0))


def looks_legacy_encoded(text: Column, converted: Column) -> Column:
    """Whether text is Sinhala in a legacy font, given what the font's converter makes of it.

    It is if it has 40 characters, isn't Sinhala or English as it stands, and becomes clean Sinhala.
    """
    words = words_in(text, 2)
    n = F.size(words)
    now = sinhala_chars(text) > 0.2 * F.greatest(n, F.lit(1))
    english = (n > 0) & (english_words(words) / F.greatest(n, F.lit(1)) > 0.08)
    si = sinhala_chars(converted)
    letters = si + F.regexp_count(converted, F.lit("[A-Za-z]"))
    clean = (letters > 0) & (si / F.greatest(letters, F.lit(1)) >= 0.6) & (broken_sign_ratio(converted) < 0.03)
    return (F.char_length(strip(text)) >= 40) & ~now & ~english & clean


def classify_document(text: Column) -> Column:
    """needs_ocr, sinhala_text or english_medium, from the text of a paper."""
    si, words = sinhala_chars(text), words_in(text)
    english = english_words(words)
    return (
        F.when((si >= 300) & (broken_sign_ratio(text) > 0.03), "needs_ocr")
        .when(si >= 300, "sinhala_text")
        .when((english / F.greatest(F.size(words), F.lit(1)) > 0.08) & (english > 30), "english_medium")
        .otherwise("needs_ocr")
    )


def precheck_features(text: Column) -> dict[str, Column]:
    """What the pre-check wants to know of the text of a paper's first pages."""
    words = words_in(text, 2)
    return {
        "sinhala": sinhala_chars(text),
        "nwords": F.size(words),
        "eng": english_words(words) / F.greatest(F.size(words), F.lit(1)),
        "broken": broken_sign_ratio(text),
        "pairs": F.regexp_count(text, F.lit(ANSWER_PAIR)),
    }


def precheck_decide(pages: Column, fonts: Column, sinhala: Column, nwords: Column, eng: Column, broken: Column, pairs: Column) -> Column:
    """struct(keep, reason): the first rule that holds."""
    say = lambda keep, why: F.struct(F.lit(keep).alias("keep"), F.lit(why).alias("reason"))
    return (
        F.when(fonts == 0, say(False, "scanned (no text on the first pages)"))
        .when((nwords > 200) & (eng > 0.08) & (sinhala < 2000), say(False, "English medium"))
        .when(broken > 0.03, say(False, "garbled Sinhala text layer"))
        .when((pages <= 3) & (pairs >= 20), say(True, "answer key"))
        .when(pages <= 3, say(False, "short file without MCQs"))
        .when(sinhala >= 300, say(True, "Sinhala text"))
        .when((nwords >= 300) & (eng < 0.03) & (fonts >= 6), say(True, "legacy-font Sinhala text"))
        .otherwise(say(False, "no readable Sinhala text"))
    )
