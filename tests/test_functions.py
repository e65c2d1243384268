from pyspark.sql import functions as F

from paperquill.functions import mcq, papers, text


def rows(spark, values, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(values, schema).select(*cols).collect()]


def test_normalize_prompt_text(spark):
    got = rows(spark, [(" “a”   b​ \n  c ''d'' ",), (None,), ("",)], "t string", text.normalize_prompt_text(F.col("t")))
    assert got == [('"a" b\nc "d"',), (None,), ("",)]


def test_normalize_line_and_keys(spark):
    got = rows(spark, [(" ,a •  b\n;",), ("Ab-1 é_",)], "t string", text.normalize_line(F.col("t")), text.compare_key(F.col("t")))
    assert got == [("a b", "ab"), ("Ab-1 é_", "ab1é")]
    # combining signs are dropped
    assert rows(spark, [("ක්‍ය කා",)], "t string", text.compare_key(F.col("t"))) == [("කයක",)]


def test_shingles(spark):
    got = rows(spark, [("",), ("abc",), ("abcd",), ("aaaaaa",), ("ab\ncd",)], "t string", text.shingles(F.col("t")))
    assert [r[0] for r in got] == [[""], ["abc"], ["abcd"], ["aaaa"], ["ab\nc", "b\ncd"]]


def test_similarities(spark):
    got = rows(spark, [(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>", text.jaccard(F.col("a"), F.col("b")), text.overlap(F.col("a"), F.col("b")))
    assert got == [(1 / 3, 0.5), (0.0, 0.0)]


def test_urls(spark):
    u = F.col("u")
    got = rows(spark, [("https://www.X.org/A/b%20C+d/?q=1#f",), (None,), ("/p/q.pdf",)], "u string", text.source_key(u), text.page_url(u), text.last_slug(u))
    assert got[0] == ("x.org/a/b%20c+d", "https://www.X.org/A/b%20C+d/", "b c+d")
    assert got[1] == ("", None, None)
    assert got[2] == ("/p/q.pdf", "/p/q.pdf", "q.pdf")
    assert rows(spark, [(' a<b>:c  d ' + "x" * 200,)], "u string", text.clean_filename(u))[0][0] == ("a_b__c d " + "x" * 200)[:150]


def test_broken_signs_and_classes(spark):
    clean, broken = "කා" * 200, "aා" * 400
    english = "the of and " * 40
    got = rows(spark, [(clean,), (broken,), (english,), ("words only " * 40,), ("",)], "t string", text.broken_sign_ratio(F.col("t")), text.classify_document(F.col("t")))
    assert [r[1] for r in got] == ["sinhala_text", "needs_ocr", "english_medium", "needs_ocr", "needs_ocr"]
    assert got[0][0] == 0 and got[1][0] > 0 and got[4][0] == 0


def test_precheck_rules(spark):
    cases = [
        ((5, 0, 0, 0, 0.0, 0.0, 0), (False, "scanned (no text on the first pages)")),
        ((5, 3, 100, 300, 0.2, 0.0, 0), (False, "English medium")),
        ((5, 3, 900, 10, 0.0, 0.1, 0), (False, "garbled Sinhala text layer")),
        ((2, 3, 900, 10, 0.0, 0.0, 25), (True, "answer key")),
        ((2, 3, 900, 10, 0.0, 0.0, 5), (False, "short file without MCQs")),
        ((5, 3, 300, 10, 0.0, 0.0, 0), (True, "Sinhala text")),
        ((5, 6, 0, 400, 0.01, 0.0, 0), (True, "legacy-font Sinhala text")),
        ((5, 6, 0, 100, 0.01, 0.0, 0), (False, "no readable Sinhala text")),
    ]
    names = ["pages", "fonts", "sinhala", "nwords", "eng", "broken", "pairs"]
    got = rows(spark, [c[0] for c in cases], "pages int, fonts int, sinhala int, nwords int, eng double, broken double, pairs int", text.precheck_decide(*[F.col(n) for n in names]))
    assert [tuple(r[0]) for r in got] == [c[1] for c in cases]


def test_legacy_encoding(spark):
    t = "wxlh iy wlaIr jHdlrK m%Yak i`oyd w;ska fnfyjska jeo.;a"
    got = rows(spark, [(t, "කමල අර" * 20), (t, "xx yy"), ("the paper is for the answer of the question and this", "ක" * 50), ("short", "ක" * 50)], "t string, c string", text.looks_legacy_encoded(F.col("t"), F.col("c")))
    assert [r[0] for r in got] == [True, False, False, False]


def test_repair_answer(spark):
    c = ["red", " blue ", "3"]
    got = rows(spark, [("2", c), ("3", c), ("9", c), ("blue", c), (" red", c), ("none", c), (None, c), ("0", c)], "a string, c array<string>", mcq.repair_answer(F.col("a"), F.col("c")))
    assert [r[0] for r in got] == [2, 3, None, 2, 1, None, None, None]


def test_bad_and_malformed(spark):
    data = [("q", ["a", "b", "c", "d"], 1), (" ", ["a", "b"], 1), ("q", ["a"], 1), ("q", ["a", " "], 1), ("q", ["a", "b"], None), ("q", ["a", "b", "c", "d"], 5)]
    got = rows(spark, data, "q string, c array<string>, a int", mcq.is_bad(F.col("q"), F.col("c"), F.col("a")), mcq.is_malformed(F.col("c"), F.col("a")))
    assert [r[0] for r in got] == [False, True, True, True, True, False]
    assert [r[1] for r in got] == [False, True, True, True, True, True]


def test_to_four_keeps_the_answer(spark):
    import hashlib

    five = ["a", "b", "c", "d", "e"]
    data = [(f"q{i}", five, a) for i in range(30) for a in range(1, 6)] + [("q", five[:4], 2), ("q", five, None)]
    got = rows(spark, data, "q string, c array<string>, a int", "q", "a", *[x for x in mcq.to_four(F.col("q"), F.col("c"), F.col("a"))])
    for q, a, c, b in got[:-2]:
        wrong = [x for i, x in enumerate(five) if i != a - 1]
        gone = wrong[int(hashlib.md5(q.encode()).hexdigest(), 16) % 4]
        assert c == [x for x in five if x != gone] and c[b - 1] == five[a - 1]
    assert got[-2][2:] == (five[:4], 2) and got[-1][2:] == (five, None)


def test_clean_option(spark):
    got = rows(spark, [("abc - 3 - next",), ("plain, ",), ("(ලකුණු 2)",)], "t string", mcq.clean_option(F.col("t")))
    assert [r[0] for r in got] == ["abc", "plain", "(ලකුණු 2)"]


def test_needs_context(spark):
    got = rows(spark, [("රූප සටහන",), ("ඉහත ප්‍රකාශ",), ("ඉහත වගුව",), ("ගණන",)], "t string", mcq.needs_context(F.col("t")))
    assert [r[0] for r in got] == [True, False, True, False]


def test_prompts_and_messages(spark):
    q = spark.createDataFrame([("What  is\tit?", ["one ", "two"], 2)], "q string, c array<string>, a int")
    p = mcq.format_question(F.col("q"), F.col("c"))
    assert q.select(p).first()[0] == "Question: What is it?\n\n1. one\n2. two\n\nAnswer:"
    shot = F.array(F.struct(F.lit("S").alias("prompt"), F.lit(3).alias("answer")))
    m = q.select(mcq.build_messages(p, shot).alias("m"))
    assert [x["role"] for x in m.first()[0]] == ["system", "user", "assistant", "user"]
    assert m.select(mcq.render_prompt(F.col("m"))).first()[0].endswith("\n\nS 3\n\nQuestion: What is it?\n\n1. one\n2. two\n\nAnswer:")
    assert q.select(mcq.format_question(F.col("q"), F.array().cast("array<string>"))).first()[0] == "Question: What is it?\n\n\nAnswer:"


def test_parse_answer(spark):
    c = ["cat", "dog ", "cow", "1"]
    data = [("", c), (None, c), (" 2", c), ("12 or 3", c), ("෨ is it", c), ("the dog", c), ("nothing", c), ("7", c), ("9 4", c)]
    got = rows(spark, data, "t string, c array<string>", mcq.parse_answer(F.col("t"), F.col("c")))
    assert [r[0] for r in got] == [None, None, 2, 3, 2, 2, None, None, 4]


def test_token_columns(spark):
    got = rows(spark, [([1, 2], [1, 2, 7, 8])], "p array<int>, f array<int>", mcq.mask_labels(F.col("p"), F.col("f")), mcq.left_pad(F.col("p"), F.lit(4), 0), mcq.option_argmax(F.col("f")))
    assert got == [([-100, -100, 7, 8], [0, 0, 1, 2], "4")]


def test_subjects(spark):
    got = rows(spark, [("Eastern_music",), (" Arts ",), ("Other  thing",)], "s string", mcq.canonical_subject(F.col("s")), mcq.subject_category(mcq.canonical_subject(F.col("s"))))
    assert got == [("Eastern Music", "humanities"), ("Arts", "humanities"), ("Other thing", "humanities")]
    assert rows(spark, [("Physics",), (None,)], "s string", mcq.subject_category(F.col("s"))) == [("stem",), ("humanities",)]


def test_paper_details(spark):
    s = F.col("s")
    data = [("grade-10-history-2nd-term-test-paper-20232024-western-province-answers",), ("royal-college-first-term",), ("eastern-music-paper",)]
    d = papers.paper_details(s, F.when(s.startswith("eastern"), "eastern-music"))
    got = rows(spark, data, "s string", *d.values())
    assert got == [(2, 2024, "Western Province", True), (1, None, "Royal College", False), (None, None, "", False)]


def test_paper_words_and_paths(spark):
    got = rows(spark, [("history-term-test", "x"), ("history-note", "exam"), ("x", "exam-page")], "a string, b string", papers.is_paper(F.col("a"), F.col("b")))
    assert [r[0] for r in got] == [True, False, True]
    long = "x" * 100
    got = rows(spark, [(7, "A/B", 2, "https://h/p/file.v2.pdf"), (11, "S", None, f"https://h/{long}.pdf")], "g int, s string, t int, u string", papers.target_path(F.col("g"), F.col("s"), F.col("t"), F.col("u")))
    import hashlib

    assert got[0][0] == "grade_07/A_B/term_2/file.v2.pdf"
    assert got[1][0] == f"grade_11/S/term_unknown/{'x' * 90}-{hashlib.sha1(f'https://h/{long}.pdf'.encode()).hexdigest()[:8]}.pdf"


def test_titles(spark):
    t = F.col("t")
    got = rows(spark, [("Grade - 06 Sinhala Medium History 2nd  Term 2019 2021",), ("nothing",)], "t string", papers.title_grade(t), papers.title_term(t), papers.title_year(t), papers.title_subject(t), papers.is_answer(t))
    assert got == [(6, 2, 2021, "History", False), (None, None, None, "Unknown", False)]
    assert rows(spark, [("<title>T x</title><h1 class='a'>A <b>b</b></h1>",), ("<title>T</title>",), ("",)], "t string", papers.page_title(t)) == [("A b",), ("T",), ("",)]
