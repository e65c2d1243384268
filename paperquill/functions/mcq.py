"""Multiple-choice questions: repair, conversion, keys, prompts, answers and training examples as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, compare_key, nfc, normalize_line, normalize_prompt_text, strip

#: Wording of prompts by language.
PROMPTS = {
    "en": {
        "system": "You are an expert at answering multiple-choice questions written in Sinhala. Read the question and the numbered options, then reply with ONLY the number of the correct option (for example: 2). Do not add any explanation.",
        "question": "Question:",
        "answer": "Answer:",
    },
    "si": {
        "system": "ඔබ සිංහල බහුවරණ ප්‍රශ්නවලට පිළිතුරු දීමේ විශේෂඥයෙකි. ප්‍රශ්නය සහ අංක කළ පිළිතුරු කියවා, නිවැරදි පිළිතුරේ අංකය පමණක් ලබා දෙන්න (උදා: 2). කිසිදු පැහැදිලි කිරීමක් එක් නොකරන්න.",
        "question": "ප්‍රශ්නය:",
        "answer": "පිළිතුර:",
    },
}
#: Questions that need a figure, a table or a passage; options cut at what follows them.
NEEDS_CONTEXT = r"රූප|සිතියම|ප්‍රස්තාර|රූපසටහන|වගුව|ඡායාරූප|දළ\s*සටහන|පහත\s*දැක්වෙන\s*සටහන|පහත\s*ආකාර|ඉහත(?!\s*(ප්‍රකාශ|වගන්ති))|තීරුව"
OPTION_END = r"\(\s*ලකුණු|\s-\s?\d{1,2}\s?-(\s|$)|(පහත|ඉහත)[^.?]{0,120}?ප්‍රශ්න\s*(අංක)?\s*\d|ප්‍රශ්න\s*අංක\s*\d+\s*(සිට|හා|-)|(I|II|11)\s*පත්‍රය"
#: Fixed value: a word of options like "all of the above", which have to keep their place.
ABOVE = "ඉහත"
SINHALA_DIGITS = "".join(chr(0x0DE6 + i) for i in range(10))
#: Subjects as test sets spell them, and as the corpus does.
SUBJECT_NAMES = {
    "arts": "Arts", "buddhism": "Buddhism", "catholicism": "Catholicism", "christianity": "Christianity",
    "civics": "Citizenship Education", "eastern music": "Eastern Music", "geography": "Geography",
    "health and physical science": "Health and Physical Science", "history": "History", "islam": "Islam",
    "sinhala language and literature": "Sinhala Language and Literature", "dancing": "Dancing",
    "drama and theatre": "Drama and Theatre", "science": "Science",
}
#: Category of each subject; any other is humanities.
CATEGORY = {
    "Science": "stem", "Agriculture and Food Technology": "stem", "Design and Construction Technology": "stem",
    "Sinhala Language and Literature": "language",
    "Citizenship Education": "social_science", "Geography": "social_science",
    "Health and Physical Science": "social_science", "Business and Accounting Studies": "social_science",
    "Entrepreneurship Studies": "social_science", "Home Economics": "social_science",
    "Communication and Media Studies": "social_science",
    "Physics": "stem", "Chemistry": "stem", "Biology": "stem", "Biosystems Technology": "stem",
    "Economics": "social_science", "Political Science": "social_science",
}


def _look_up(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def nfc_each(choices: Column) -> Column:
    return F.when(F.size(choices) > 0, F.split(nfc(F.array_join(choices, "\x1f", "")), "\x1f")).otherwise(choices)


def canonical_subject(c: Column) -> Column:
    bare = strip(F.regexp_replace(F.translate(c, "_", " "), r"(?U)\s+", " "))
    return F.coalesce(_look_up(SUBJECT_NAMES, F.lower(bare)), bare)


def subject_category(c: Column) -> Column:
    return F.coalesce(_look_up(CATEGORY, F.coalesce(c, F.lit(""))), F.lit("humanities"))


def repair_answer(answer: Column, choices: Column) -> Column:
    """1-based answer: a number within the options stays; the text of an option becomes its number; else null."""
    number = F.when(strip(answer).rlike(r"^-?\d{1,9}$"), strip(answer).try_cast("int"))
    place = F.array_position(F.transform(choices, strip), strip(answer)).cast("int")
    return F.when((number >= 1) & (number <= F.size(choices)), number).otherwise(F.nullif(place, F.lit(0)))


def is_bad(question: Column, choices: Column, answer: Column) -> Column:
    """No answer, a blank question, fewer than two options or a blank one."""
    return answer.isNull() | blank(question) | (F.size(choices) < 2) | F.exists(choices, blank)


def is_malformed(choices: Column, answer: Column) -> Column:
    """Not four options that all say something, with an answer among them."""
    return (F.size(choices) != 4) | ~F.coalesce(answer.between(1, 4), F.lit(False)) | F.exists(choices, blank)


def needs_context(question: Column) -> Column:
    return question.rlike(NEEDS_CONTEXT)


def dropped_option(question: Column, answer: Column) -> Column:
    """0-based place of the wrong option that a five-option question loses, by its question's md5."""
    pick = F.conv(F.right(F.md5(question.cast("binary")), F.lit(1)), 16, 10).cast("int") % 4
    return pick + F.when(pick >= answer - 1, 1).otherwise(0)


def to_four(question: Column, choices: Column, answer: Column) -> tuple[Column, Column]:
    """(choices, answer) with four options where there were five and an answer; others as they are."""
    five = (F.size(choices) == 5) & (F.coalesce(answer, F.lit(0)) != 0)
    drop = dropped_option(question, answer)
    return (
        F.when(five, F.filter(choices, lambda c, i: i != drop)).otherwise(choices),
        F.when(five & (drop < answer - 1), answer - 1).otherwise(answer),
    )


def line_key(question: Column, choices: Column, with_nfc: bool = True) -> Column:
    """Key of a question and its options, in order, as extracted lines."""
    if with_nfc:
        question, choices = nfc(question), nfc_each(choices)
    return F.concat(normalize_line(question, False), F.lit("||"), F.array_join(F.transform(choices, lambda c: normalize_line(c, False)), "|"))


def exact_key(question: Column, choices: Column) -> Column:
    """Key with options in order, ends stripped."""
    return F.concat(strip(question), F.lit("||"), F.array_join(F.transform(choices, strip), "|"))


def bag_key(question: Column, choices: Column, with_nfc: bool = False) -> Column:
    """Key with options in any order, letters and digits only."""
    return F.concat(compare_key(question, with_nfc), F.lit("|"), F.array_join(F.array_sort(F.transform(choices, lambda c: compare_key(c, False))), "|"))


def clean_option(c: Column, with_nfc: bool = True) -> Column:
    """An option without what a page has after it: cut at the first mark that is not at its start."""
    at = F.regexp_instr(c, F.lit(OPTION_END))
    return normalize_line(F.when(at > 1, F.left(c, at - 1)).otherwise(c), with_nfc)


def format_question(question: Column, choices: Column, language: str = "en", with_nfc: bool = True) -> Column:
    """The text of a question in a prompt."""
    if with_nfc:
        question, choices = nfc(question), nfc_each(choices)
    clean = lambda c: normalize_prompt_text(c, False)
    p = PROMPTS[language]
    options = F.array_join(F.transform(choices, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), clean(c))), "\n")
    return F.concat(F.lit(p["question"] + " "), clean(question), F.lit("\n\n"), options, F.when(F.size(choices) > 0, "\n").otherwise(""), F.lit("\n" + p["answer"]))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_messages(prompt: Column, shots: Column | None = None, language: str = "en") -> Column:
    """Chat messages: system, a user and an assistant turn per shot (array of struct(prompt, answer)), user."""
    first, last = F.array(message("system", F.lit(PROMPTS[language]["system"]))), F.array(message("user", prompt))
    if shots is None:
        return F.concat(first, last)
    turns = F.flatten(F.transform(shots, lambda s: F.array(message("user", s["prompt"]), message("assistant", s["answer"].cast("string")))))
    return F.concat(first, F.coalesce(turns, F.array().cast("array<struct<role:string,content:string>>")), last)


def render_prompt(messages: Column) -> Column:
    """Messages as plain text: an assistant's follows the part before it after a space, others after a blank line."""
    parts = F.transform(messages, lambda m, i: F.concat(F.when(i == 0, "").when(m["role"] == "assistant", " ").otherwise("\n\n"), m["content"]))
    return F.array_join(parts, "")


def parse_answer(output: Column, choices: Column) -> Column:
    """1-based option that a model's output names: its first lone digit in range (options up to 9), or else the first
    option whose text it has; null if none."""
    t = F.translate(strip(output), SINHALA_DIGITS, "0123456789")
    lone = F.regexp_extract_all(t, F.lit(r"(?U)(?<!\d)([1-9])(?!\d)"), F.lit(1))
    number = F.get(F.filter(lone, lambda d: d.cast("int") <= F.size(choices)), F.lit(0)).cast("int")
    named = F.array_position(F.transform(choices, lambda c: (strip(c) != "") & F.contains(t, strip(c))), True).cast("int")
    return F.when(t != "", F.coalesce(number, F.nullif(named, F.lit(0))))


def option_argmax(scores: Column) -> Column:
    """1-based place of the highest score, the first of equals, as text."""
    return F.array_position(scores, F.array_max(scores)).cast("string")


def mask_labels(prompt_ids: Column, full_ids: Column) -> Column:
    """Labels of a training example: -100 for the prompt's tokens, then the answer's."""
    n = F.size(prompt_ids)
    return F.concat(F.array_repeat(F.lit(-100), n), F.slice(full_ids, n + 1, F.greatest(F.size(full_ids) - n, F.lit(0))))


def left_pad(ids: Column, width: Column, value: int) -> Column:
    return F.concat(F.array_repeat(F.lit(value), F.greatest(width - F.size(ids), F.lit(0)).cast("int")), ids)


def one_based(answer: Column) -> Column:
    """1-based place of a 0-based answer."""
    return answer + F.lit(1)


def percent(c: Column, places: int = 2) -> Column:
    """A share as text, as in 12.34%."""
    return F.format_string(f"%.{places}f%%", c * 100)
