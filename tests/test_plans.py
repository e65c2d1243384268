import json

from pyspark.sql import functions as F

from paperquill.operators.keys import answer_keys, keys_of_files
from paperquill.operators.parse import body_lines, parse_papers
from paperquill.plans.extraction import extract
from paperquill.plans.training import training_set, validate, with_validation
from paperquill.sources import questions as src
from paperquill.streaming.evaluation import run_eval, stream_eval

LINE = "paper_id string, line_no int, text string, page int, x0 double, y0 double, x1 double, y1 double"


def paper(name, texts):
    return [(name, i, t, 0, 50.0, 100.0 + 12 * i, 400.0, 110.0 + 12 * i) for i, t in enumerate(texts)]


def digits(n, extra=()):
    out = []
    for i in range(1, n + 1):
        out += [f"{i:02d}. Question {i} text", f"wrapped part {i}", f"1. one{i}   2. two{i}", f"3. three{i}", f"4. four{i}"]
    return out + list(extra)


def parsed(spark, texts):
    return parse_papers(spark.createDataFrame(paper("p", texts), LINE)).orderBy("q_no").collect()


def test_digit_options_and_pairs(spark):
    got = parsed(spark, digits(6, ["පිළිතුරු", "(01) 2 (02) 3 (03) 1", "04. 4  05 - 2  06) 1"]))
    assert [r["q_no"] for r in got] == [1, 2, 3, 4, 5, 6]
    assert got[0]["question"] == "Question 1 text wrapped part 1" and got[0]["choices"] == ["one1", "two1", "three1", "four1"]
    assert [r["answer"] for r in got] == [2, 3, 1, 4, 2, 1] and got[0]["method"] == "pairs"


def test_roman_options_and_sequence(spark):
    lines = []
    for i in range(1, 6):
        lines += [f"{i}. Ask {i}", f"(i) a{i} (ii) b{i}", f"(iii) c{i}", f"(iv) d{i}"]
    got = parsed(spark, lines + ["Marking scheme", "( 3 )", "-", "1", "ii", "4", "2"])
    assert [r["choices"][3] for r in got] == ["d1", "d2", "d3", "d4", "d5"]
    assert [r["answer"] for r in got] == [3, 1, 2, 4, 2] and got[0]["method"] == "sequence"


def test_skipped_and_restarted_questions(spark):
    lines = digits(4)
    lines = ["1"] + lines + ["06. Question 6", "1. a 2. b 3. c 4. d", "07. Question 7", "1. a 2. b 3. c 4. d"]
    assert [r["q_no"] for r in parsed(spark, lines)] == [1, 2, 3, 4, 6, 7]


def test_too_few_questions_give_none(spark):
    got = parsed(spark, digits(4))
    assert len(got) == 1 and got[0]["kind"] == "none"


def test_end_heading_stops(spark):
    got = parsed(spark, digits(6, ["Part II", "07. More", "1. a 2. b 3. c 4. d"]))
    assert max(r["q_no"] for r in got) == 6


def test_five_options(spark):
    lines = []
    for i in range(1, 10):
        lines += [f"{i:02d}. Ask {i}", f"(1) a (2) b (3) c (4) d (5) e{i}"]
    got = parsed(spark, lines)
    assert len(got) == 9 and got[8]["choices"] == ["a", "b", "c", "d", "e9"]


def cell(text, x, y, page=0):
    return (text, page, float(x), float(y), float(x), float(y))


TAIL = "tail array<struct<text:string,page:int,x0:double,y0:double,x1:double,y1:double>>"


def found(spark, tails, n, options=4):
    df = spark.createDataFrame([(str(i), n, options, t) for i, t in enumerate(tails)], f"paper_id string, n int, options int, {TAIL}")
    got = {r["paper_id"]: (r["answers"], r["method"]) for r in answer_keys(df).collect()}
    return [got.get(str(i), ({}, "none")) for i in range(len(tails))]


def test_tables_across_and_down(spark):
    want = {i: i % 4 + 1 for i in range(1, 11)}
    across = [cell(str(i), 20 * i, 10) for i in range(1, 11)] + [cell(str(i % 4 + 1), 20 * i + 3, 40) for i in range(1, 11)]
    down = [cell(str(i), 10, 20 * i) for i in range(1, 11)] + [cell(f"({i % 4 + 1})", 60, 20 * i) for i in range(1, 11)]
    far = [cell(str(i), 20 * i, 10) for i in range(1, 11)] + [cell(f"{i % 4 + 1} x", 20 * i + 9, 40) for i in range(1, 11)]  # no answer is beside its number
    other_page = across[:10] + [cell(f"{i % 4 + 1} x", 20 * i, 40, page=1) for i in range(1, 11)]
    second = across[:10] + [cell("7", 20, 25), cell("9", 40, 25)] + across[10:]  # a row that holds no answers stands between
    one_line = [("1 2 3 4 5", 0, 0.0, 0.0, 10.0, 0.0)]
    assert found(spark, [across, down, far, other_page, second, one_line], 10) == [(want, "table")] * 2 + [({}, "none")] * 2 + [(want, "table"), ({}, "none")]


def test_sequences(spark):
    block = [cell(x, 1, 20 * i) for i, x in enumerate(["1", "2", "text", "( 3 )", "-", "1", "ii", "IV", "(2)", "", "4", "5", "3"])]
    assert found(spark, [block, block], 5) == [({1: 3, 2: 1, 3: 2, 4: 4, 5: 2}, "sequence")] * 2
    assert found(spark, [block], 7, 5) == [({1: 3, 2: 1, 3: 2, 4: 4, 5: 2, 6: 4, 7: 5}, "sequence")]
    assert found(spark, [block], 9, 5) == [({}, "none")]


def test_pairs_come_before_tables_and_headings_before_the_start(spark):
    lines = [cell("1. 4 2. 4 3. 4", 1, 1), cell("answer sheet", 1, 2), cell("1. 1 2. 2 3. 3 1. 4", 1, 3)]
    assert found(spark, [lines, [], [cell(None, 1, 1)]], 3) == [({1: 1, 2: 2, 3: 3}, "pairs"), ({}, "none"), ({}, "none")]


def test_same_lines_are_read_once(spark):
    from paperquill.operators import keys, parse

    lines = [cell("answer", 1, 1), cell("1. 1 2. 2", 1, 2)]
    df = spark.createDataFrame([("a", lines)], f"paper_id string, {TAIL}").selectExpr("paper_id", "array(50, 40, 35, 30, 25, 20) AS sizes", "5 AS options", "tail")
    got = {(r["at"], r["upto"]): len(r["asked"]) for r in keys.spans(df, True).collect()}
    assert got == {(0, 2): 12, (1, 1): 6}  # not eighteen times
    flat = spark.createDataFrame([("a", 2, None, 0, 1.0, 1.0, 1.0, float("nan")), ("a", 1, "x", None, 1.0, 1.0, 1.0, 1.0)], "paper_id string, line_no int, text string, page int, x0 double, y0 double, x1 double, y1 double")
    read = parse.read_papers(flat)
    assert "FlatMapGroups" not in read._jdf.queryExecution().toString()
    assert [[tuple(x) for x in r["tail"]] for r in read.collect()] == [[("x", None, 1.0, 1.0, 1.0, 1.0), ("", 0, 1.0, 1.0, 1.0, None)]]


def test_coverage_below_ninety_per_cent_is_none(spark):
    assert found(spark, [[cell("1. 2 2. 3 3. 1", 1, 1)]], 10) == [({}, "none")]


def test_key_only_file(spark):
    key = lambda n: [cell(f"{i}. {i % 5 + 1}", 1, 20 * i) for i in range(1, n + 1)]
    df = spark.createDataFrame([("a", key(40)), ("b", [cell("nothing", 1, 1)]), ("c", key(36)), ("d", key(12)), ("e", [])], f"paper_id string, {TAIL}")
    got = {r["paper_id"]: r["answers"] for r in keys_of_files(df).collect()}
    assert got == {"a": {i: i % 5 + 1 for i in range(1, 41)}, "c": {i: i % 5 + 1 for i in range(1, 37)}}


def test_body_lines(spark):
    rows = [("p", 0, "Term Test 2020", 0, 0.0, 400.0, 0.0, 410.0), ("p", 1, " ", 0, 0.0, 400.0, 0.0, 410.0), ("p", 2, "- 3 -", 0, 0.0, 10.0, 0.0, 20.0), ("p", 3, "3", 0, 0.0, 400.0, 0.0, 410.0), ("p", 4, "text", 0, 0.0, 10.0, 0.0, 20.0)]
    df = spark.createDataFrame(rows, LINE).withColumn("page_height", F.lit(800.0))
    assert [r["line_no"] for r in body_lines(df).orderBy("line_no").collect()] == [3, 4]


def test_extraction_plan(spark, save):
    si = "කමල අමල "
    full = [f"{si * 60}"] + digits(6)
    lines = paper("grade_10/a.pdf", full) + paper("grade_10/b.pdf", [f"{i:02d}. {i % 4 + 1}" for i in range(1, 21)]) + paper("grade_10/c.pdf", full) + paper("grade_10/d.pdf", ["the of and to " * 30])
    papers = spark.createDataFrame(
        [(f"grade_10/{x}.pdf", "Science", "10", "2", "2020", "", s, "u") for x, s in (("a", "page1"), ("b", "page1"), ("c", "page2"), ("d", "page3"), ("e", "page4"))],
        "paper_id string, subject string, grade string, term string, year string, region string, source_page string, pdf_url string",
    )
    dev = spark.createDataFrame([("Question 6 text wrapped part 6", ["one6", "two6", "three6", "four6"])], "question string, choices array<string>")
    out = extract(spark.createDataFrame(lines, LINE), papers, dev, save)
    got = out["questions"].orderBy("q_no").collect()
    assert [(r["paper_id"], r["q_no"], r["answer"]) for r in got] == [("grade_10/a.pdf", i, i % 4 + 1) for i in range(1, 6)]
    assert got[0]["category"] == "stem" and got[0]["metadata"]["grade"] == 10 and got[0]["metadata"]["source"] == "page1"
    assert out["unanswered"].count() == 0
    report = {r["paper_id"][-5]: (r["status"], r["questions"], r["answers"]) for r in out["report"].collect()}
    assert report == {"a": ("ok", 6, 6), "b": ("answer_key_only", 0, 0), "c": ("ok", 6, 0), "d": ("english_medium", 0, 0), "e": ("needs_ocr", 0, 0)}


def question(row, text, choices, answer, source=None, ctx=False, q_no=1):
    return (row, q_no, "history", "humanities", text, choices, answer, (None, 10, None, None, None, None, source, "grade_10/x.pdf", len(choices), ctx, None))


FOUR = ["alpha one", "beta two", "gamma three", "delta four"]


def test_training_set(spark, save):
    schema = src._struct("row int, q_no int, subject string, category string, question string, choices strings, answer int").add("metadata", src.METADATA)
    texts = ["what is the capital city of that island nation", "when did the old kingdom lose its last war", "who wrote the long poem on the sea"]
    rows = [
        question(1, texts[0], FOUR, None), question(2, texts[0], FOUR, 0), question(3, texts[0], FOUR, 2, ctx=True), question(4, texts[0], FOUR[:3], 2),
        question(5, texts[0], FOUR, 2, "https://www.a.org/p/"), question(6, texts[1], FOUR, 1), question(7, texts[2], ["five a", "five b", "five c", "five d", "five e"], 5),
        question(8, "which river has the most tributaries of all", FOUR, 3), question(9, "Which river has the most tributaries of all?", FOUR[::-1], 2), question(10, "how many moons does the red planet have", FOUR, 4),
    ]
    dev = spark.createDataFrame([("d::1", texts[1], FOUR, ("http://a.org/p",))], "id string, question string, choices array<string>, metadata struct<source:string>")
    out = training_set(spark.createDataFrame(rows, schema), dev, save)
    counts = {r["decision"]: r["n"] for r in out.counts.collect()}
    assert counts == {"no answer": 2, "needs context": 1, "malformed": 1, "same paper": 1, "overlaps test": 1, "repeated": 1, "kept": 3}
    assert sum(counts.values()) == len(rows) and sum(r["n_from_five"] for r in out.counts.collect()) == 1
    kept = {r["question"]: r for r in out.kept.collect()}
    assert sorted(r["id"] for r in kept.values()) == ["g10::x::1", "g10::x::1#2", "g10::x::1#3"]
    five = kept[texts[2]]
    assert len(five["choices"]) == 4 and five["choices"][five["answer"] - 1] == "five e" and five["original_n_options"] == 5
    removed = {r["row"]: r["removed_because"] for r in out.removed.collect()}
    assert removed[5] == "same exam paper as a test question" and removed[6].startswith("near-duplicate of a test question")
    assert {r["split"] for r in with_validation(out.kept).collect()} == {"train"}


def test_validate(spark):
    rows = [("a::1", "Eastern_music", "q1", ["x", "y"], "y"), ("a::2", "Eastern music", "q2", ["x", "y"], "1"), ("a::3", "Eastern music", "q1", ["x", "y"], "2"), ("a::4", "B", " ", ["x", "y"], "1"), ("a::5", "B", "q", ["x"], "1")]
    clean, dropped = validate(spark.createDataFrame(rows, "id string, subject string, question string, choices array<string>, answer string"))
    assert {(r["id"], r["subject"], r["answer"]) for r in clean.collect()} == {("a::1", "Eastern music", 2), ("a::2", "Eastern music", 1)}
    assert {tuple(r) for r in dropped.collect()} == {("a::3", "repeated"), ("a::4", "bad"), ("a::5", "bad")}


def test_readers_and_writers(spark, tmp_path):
    raw = [{"q_no": 1, "subject": " S ", "category": "c", "question": "q", "choices": ["a", "b"], "answer": 1, "metadata": {"grade": 6}}, {"q_no": 2, "subject": "S", "category": "c", "question": "q2", "choices": ["a", "b"], "answer": "b"}]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "File 1.json").write_text(json.dumps(raw), encoding="utf-8")
    got = src.read_raw(spark, str(tmp_path / "raw")).orderBy("q_no").collect()
    assert [(r["id"], r["subject"], r["answer"], r["grade"]) for r in got] == [("File 1::1", "S", "1", 6), ("File 1::2", "S", "b", None)]
    df = spark.createDataFrame([(1, None, "සි,\"x\"")], "grade int, term string, subject string")
    src.write_csv(df, str(tmp_path / "csv"))
    back = src.read_csv(spark, str(tmp_path / "csv"))
    assert back.columns == ["grade", "term", "subject"] and tuple(back.first()) == ("1", None, "සි,\"x\"")
    src.write_jsonl(df, str(tmp_path / "jsonl"))
    assert "සි" in "".join(f.read_text(encoding="utf-8") for f in (tmp_path / "jsonl").glob("part*"))
    src.write_by_grade(df, str(tmp_path / "grades"), F.col("grade"))
    assert (tmp_path / "grades" / "grade_folder=01").exists()
    (tmp_path / "pdf" / "grade_10").mkdir(parents=True)
    (tmp_path / "pdf" / "grade_10" / "a.pdf").write_bytes(b"%PDF-1.4")
    f = src.files_on_disk(spark, str(tmp_path / "pdf")).first()
    assert f["local_path"] == "grade_10/a.pdf" and f["is_pdf"]
    assert json.loads(src.report_json(a=df, b=df.limit(0)).first()[0]) == {"a": [{"grade": 1, "term": None, "subject": "සි,\"x\""}], "b": []}


def test_evaluation_goes_on_where_it_stopped(spark, tmp_path):
    class Second:  # in here, so that tasks get it by value
        def generate(self, batch):
            return [f"the answer is 2 of {len(m)}" for m in batch]

    rows = [(f"q{i}", "s", "c", f"text {i}", ["a", "b", "c", "d"], i % 4 + 1) for i in range(10)]
    df = spark.createDataFrame(rows, "id string, subject string, category string, question string, choices array<string>, answer int")
    log = str(tmp_path / "log")
    assert run_eval(spark, df.filter("id < 'q5'"), Second, log).count() == 5
    got = run_eval(spark, df, Second, log, pool=df, k=2).collect()
    assert len(got) == 10 and all(r["pred"] == 2 and r["correct"] == (r["answer"] == 2) for r in got)
    assert {r["raw_output"][-1] for r in got} == {"2", "6"}  # five were not asked again
    src.write_jsonl(df, str(tmp_path / "in"))
    stream_eval(spark, str(tmp_path / "in"), df.schema, Second, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 10
    stream_eval(spark, str(tmp_path / "in"), df.schema, Second, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 10
