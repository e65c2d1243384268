"""Answer keys of exam papers, by table operations over the lines that follow the questions.

A key is looked for after every heading of answers, and after none. What follows is read in three ways: as numbered
pairs, as a table whose columns (or rows) are numbered, and as a plain sequence of answers. Each way makes rows (paper,
lines read, method, q_no, answer, most); the first way, and of it the first start, that answers nearly all of the n questions
counts. The same lines are read once, whichever starts and numbers of questions they are for.
No group is larger than the lines of a paper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mcq import SINHALA_DIGITS
from ..functions.text import strip
from .windows import cluster_by_gap, longest_block

# Patterns of headings of keys, of a numbered answer, of a number in a table, of a line with one answer and of a
# line that doesn't count; roman numbers of options; usual numbers of questions.
PAIR = r"(?U)(?<![\d.])\(?0?(\d{{1,2}})\)?\s*[.)\-:–]?\s*\(?([1-{most}])\)?(?![\d.])"
TOKEN, ALONE, PASSED = r"(?U)^\(?(\d{1,2})[.)]?$", r"(?U)^\(?\s*([1-5])\s*\)?$", r"(?U)^[-–()\s.]*$"
HEADING = r"(?iU)පිළිතුරු|marking\s*scheme|ලකුණු\s*දීමේ|answer|(^|\s)I\s*කොටස"
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5}
USUAL_SIZES = (50, 40, 35, 30, 25, 20)
#: Longest heading; share of the questions that a key has to answer; lines that a key has, for each question.
HEADING_LENGTH, COVERAGE, LINES_EACH = 60, 0.9, 5
#: In points: rows of a table are further apart than SAME_ROW, and an answer is within BESIDE of its number's place.
SAME_ROW, BESIDE = 4, 6
FILE_OPTIONS, HEADER_LENGTH, ROWS_BELOW = 5, 5, 3
METHODS = ("pairs", "table", "sequence")
#: The start that no heading precedes comes after all others.
NO_HEADING = (1 << 31) - 1
#: Of ways that don't say how many questions they answer in a row.
ANY = (1 << 31) - 1
#: The lines at, at + 1, ... of a tail, so many as upto says.
SPAN = ["paper_id", "at", "upto"]


def _number(c: Column) -> Column:
    return F.translate(c, SINHALA_DIGITS, "0123456789").try_cast("int")


def spans(papers: DataFrame, headed: bool = False) -> DataFrame:
    """paper_id, options, at, upto, part (array of lines): what follows each heading in the tail of a paper, as far as it is
    read for each number of questions; asked: the starts and numbers of questions (n) that it is read for.

    headed: the tail as a whole is taken to follow a heading, too.
    """
    is_heading = lambda x: (F.char_length(strip(x["text"])) <= HEADING_LENGTH) & x["text"].rlike(HEADING)
    place = lambda start, at, less: F.struct(start.cast("int").alias("start"), at.cast("int").alias("at"), F.lit(less).alias("less"))
    found = F.filter(F.transform("tail", lambda x, i: F.when(is_heading(x), place(i, i + 1, 0))), lambda s: s.isNotNull())
    first = [F.array(place(F.lit(-1), F.lit(0), 0))] if headed else []
    last = F.array(place(F.lit(NO_HEADING), F.lit(0), 1 if headed else 0))
    each = papers.select("paper_id", "sizes", "options", "tail", F.concat(*first, found, last).alias("places"))
    upto = lambda s, n: F.least(F.size("tail") - s["at"], F.lit(LINES_EACH) * n - s["less"])
    read = F.flatten(F.transform("places", lambda s: F.transform("sizes", lambda n: F.struct(s["at"].alias("at"), upto(s, n).alias("upto"), s["start"].alias("start"), n.alias("n")))))
    each = each.select("paper_id", "options", "tail", F.filter(read, lambda r: r["upto"] > 0).alias("read"))
    each = each.select("*", F.explode(F.array_distinct(F.transform("read", lambda r: F.struct(r["at"].alias("at"), r["upto"].alias("upto"))))).alias("s"))
    asked = F.transform(F.filter("read", lambda r: (r["at"] == F.col("s.at")) & (r["upto"] == F.col("s.upto"))), lambda r: F.struct(r["start"].alias("start"), r["n"].alias("n")))
    return each.select("paper_id", "options", "s.at", "s.upto", F.slice("tail", F.col("s.at") + 1, F.col("s.upto")).alias("part"), asked.alias("asked"))


def pairs(parts: DataFrame) -> DataFrame:
    """'(01) 2', '1. 3', '12 - 4' anywhere in the joined lines; a question's first answer counts."""
    text = F.array_join(F.col("part.text"), " ")
    pattern = lambda most: F.lit(PAIR.format(most=most))
    zipped = lambda most: F.arrays_zip(F.regexp_extract_all(text, pattern(most), F.lit(1)).alias("q"), F.regexp_extract_all(text, pattern(most), F.lit(2)).alias("a"))
    each = parts.select(*SPAN, F.posexplode(F.when(F.col("options") >= 5, zipped(5)).otherwise(zipped(4))).alias("i", "pair"))
    each = each.select(*SPAN, "i", _number(F.col("pair.q")).alias("q_no"), F.col("pair.a").cast("int").alias("answer"))
    return each.filter("q_no >= 1").groupBy(*SPAN, "q_no").agg(F.min_by("answer", "i").alias("answer")).withColumn("most", F.lit(ANY))


def table(parts: DataFrame) -> DataFrame:
    """A header of consecutive numbers, across or down, and the nearest of the next rows (or columns) of the page that holds
    answers only; each answer belongs to the number that is nearest to it along the header."""
    lines = parts.select(*SPAN, "options", F.posexplode("part").alias("i", "line"))
    words = lines.select(*SPAN, "options", "i", "line", F.posexplode(F.split("line.text", r"(?U)\s+")).alias("j", "word"))
    number = _number(F.regexp_extract("word", TOKEN, 1))
    middle = lambda a, b: (F.col(f"line.{a}") + F.col(f"line.{b}")) / 2
    token = words.select(*SPAN, "options", F.col("line.page").alias("page"), (F.col("i").cast("long") * (1 << 20) + F.col("j")).alias("read"), number.alias("v"), middle("x0", "x1").alias("x"), middle("y0", "y1").alias("y"))
    ways = F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("x").alias("along"), F.col("y").alias("across")), F.struct(F.lit(1).alias("way"), F.col("y").alias("along"), F.col("x").alias("across"))))
    token = token.filter("v is not null and x is not null and y is not null").select("*", ways.alias("w")).select(*SPAN, "options", "page", "read", "v", "w.*")
    page = [*SPAN, "options", "way", "page"]
    rows = cluster_by_gap(token, page, "across", SAME_ROW, "read").groupBy(*page, "cluster").agg(F.array_sort(F.collect_list(F.struct("along", "across", "read", "v"))).alias("row"))
    below = Window.partitionBy(*page).orderBy("cluster")
    values = F.col("row.v")
    is_header = (F.size("row") >= HEADER_LENGTH) & (values == F.sequence(values[0], values[0] + F.size("row") - 1))
    answers = lambda r: r.isNotNull() & (F.size(r) >= F.floor(F.size("row") / 2)) & F.forall(r, lambda t: t["v"].between(1, F.col("options")))
    near = F.filter(F.array(*[F.lead("row", k).over(below) for k in range(1, ROWS_BELOW + 1)]), answers)
    heads = rows.withColumn("near", F.get(near, F.lit(0))).filter(is_header & F.col("near").isNotNull())
    each = heads.select(*SPAN, "way", "page", "cluster", "row", F.posexplode("near").alias("k", "t"))
    nearest = F.array_min(F.transform("row", lambda h, i: F.struct(F.abs(h["along"] - F.col("t.along")).alias("off"), i.alias("i"), h["v"].alias("v"))))
    each = each.withColumn("h", nearest).filter((F.col("h.off") <= BESIDE) & (F.col("h.v") >= 1))
    return each.groupBy(*SPAN, F.col("h.v").alias("q_no")).agg(F.min_by("t.v", F.struct("way", "page", "cluster", "k")).alias("answer")).withColumn("most", F.lit(ANY))


def sequence(parts: DataFrame) -> DataFrame:
    """The longest block of lines of one answer each, if it is long enough; lines of dashes and brackets don't break it."""
    lines = parts.select(*SPAN, "options", F.posexplode("part").alias("i", "line")).withColumn("said", F.lower(strip(F.col("line.text"))))
    digit = F.regexp_extract("said", ALONE, 1).try_cast("int")
    roman = F.try_element_at(F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv]), F.col("said"))
    value = F.coalesce(digit, roman)
    lines = lines.select(*SPAN, "i", F.when(value <= F.col("options"), value).alias("answer"), F.col("said").rlike(PASSED).alias("neutral"))
    lines = lines.withColumn("inside", F.col("answer").isNotNull())
    best = longest_block(lines, SPAN, "i", "inside", "neutral").withColumnRenamed("length", "most")
    block = lines.filter("not neutral").join(best, SPAN).filter("i >= start")
    q_no = F.row_number().over(Window.partitionBy(*SPAN).orderBy("i"))
    return block.withColumn("q_no", q_no).filter("q_no <= most").select(*SPAN, "q_no", "answer", F.col("most").cast("int").alias("most"))


def answer_keys(papers: DataFrame, headed: bool = False) -> DataFrame:
    """papers (paper_id, n, options, tail), one row each, to paper_id, answers (map of question to answer) and method of those
    with a key.

    With sizes (an array) instead of n, the largest size counts whose key reaches nearly to its end. tail: array of lines
    (text, page, x0, y0, x1, y1). A paper without lines, or whose key answers too little, has no row.
    """
    parts = spans(papers if "sizes" in papers.columns else papers.withColumn("sizes", F.array("n")), headed)
    rows = None
    for i, method in enumerate((pairs, table, sequence)):
        one = method(parts).select(*SPAN, F.lit(i).alias("m"), "q_no", "answer", "most")
        rows = one if rows is None else rows.unionByName(one)
    said = rows.groupBy(*SPAN, "m").agg(F.collect_list(F.struct("q_no", "answer")).alias("said"), F.max("most").alias("most"))
    each = said.join(parts.select(*SPAN, "asked"), SPAN).select("paper_id", "m", "said", "most", F.explode("asked").alias("s")).filter("most >= s.n")
    each = each.select("paper_id", "m", "s.start", "s.n", F.filter("said", lambda x: x["q_no"] <= F.col("s.n")).alias("said"))
    enough = each.filter((F.size("said") > 0) & (F.size("said") >= F.lit(COVERAGE) * F.col("n")))
    best = enough.groupBy("paper_id", "n").agg(F.min_by(F.struct("said", F.array_max("said.q_no").alias("last"), "m"), F.struct("m", "start")).alias("b"))
    best = best.filter(F.col("b.last") >= F.lit(COVERAGE) * F.col("n")) if headed else best
    best = best.groupBy("paper_id").agg(F.max_by("b", "n").alias("b"))
    return best.select("paper_id", F.map_from_entries("b.said").alias("answers"), F.element_at(F.array(*[F.lit(x) for x in METHODS]), F.col("b.m") + 1).alias("method"))


def keys_of_files(files: DataFrame) -> DataFrame:
    """answer_keys() of files (paper_id, tail) that have no questions: the usual numbers of questions are tried."""
    sizes = F.array(*[F.lit(n) for n in USUAL_SIZES]).alias("sizes")
    return answer_keys(files.select("paper_id", sizes, F.lit(FILE_OPTIONS).alias("options"), "tail"), headed=True)
