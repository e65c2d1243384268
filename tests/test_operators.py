from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperquill.functions import papers as names_of
from paperquill.operators import browse, crawl, dedup, joins, metrics, sampling, scoring, windows


def test_splits_partition_the_input(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("g"))
    out = sampling.stratified_split(df, "g").collect()
    assert sorted(r["id"] for r in out) == list(range(1000))
    per = Counter((r["g"], r["split"]) for r in out)
    for g in range(7):
        n = sum(per[g, s] for s in ("train", "val", "test"))
        assert abs(per[g, "train"] - 0.7 * n) <= 1 and abs(per[g, "val"] - 0.15 * n) <= 1 and abs(per[g, "test"] - 0.15 * n) <= 1


def test_validation_slice(spark):
    df = spark.range(130).select("id", F.when(F.col("id") < 100, "big").when(F.col("id") < 119, "small").otherwise(None).alias("g"))
    per = Counter((r["g"], r["val"]) for r in sampling.validation_slice(df, "g").collect())
    assert per["big", True] == 5 and per["small", True] == 0


def test_oversample_counts(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, 1.5).otherwise(0.0).alias("f"))
    got = [r["id"] for r in sampling.oversample(df, F.col("f")).collect()]
    assert len(got) == len(set(got)) and 1400 < len(got) < 1600
    assert sum("#rep1" in i for i in got) == len(got) - 1000


def test_option_shuffles_keep_the_answer(spark):
    rows = [(str(i), [f"a{i}", f"b{i}", f"c{i}", f"d{i}"], i % 4 + 1) for i in range(20)] + [("x", ["ඉහත සියල්ල", "b", "c", "d"], 1)]
    got = sampling.option_shuffles(spark.createDataFrame(rows, "id string, choices array<string>, answer int"), 3).collect()
    assert len(got) == 21 + 60
    right = {r[0]: r[1][r[2] - 1] for r in rows}
    assert all(r["choices"][r["answer"] - 1] == right[r["id"].split("#")[0]] for r in got)
    assert len({tuple(r["choices"]) for r in got if r["id"].startswith("3")}) > 1


def test_few_shots(spark):
    pool = spark.createDataFrame([(f"p{i}", "s", f"q{i}", i) for i in range(5)] + [("o", "one", "q", 9)], "id string, subject string, prompt string, answer int")
    df = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "one"), ("d", "none"), ("e", None)], "id string, subject string")
    got = {r["id"]: r["shots"] for r in sampling.few_shots(df, pool, 3).collect()}
    assert [len(got[k]) for k in "abcde"] == [3, 3, 1, 0, 0]
    assert len({s["answer"] for s in got["a"]}) == 3
    assert all(len(r["shots"]) == 0 for r in sampling.few_shots(df, pool, 0).collect())


def test_pack_batches(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([1, 2, 3, 4, 5, 50])], "id int, n int")
    got = sampling.pack_batches(df, "n", 10, F.lit(0), "id").collect()
    by = {}
    for r in got:
        by.setdefault(r["batch"], []).append(r["n"])
    assert all(len(v) == 1 or len(v) * max(v) <= 10 for v in by.values()) and sum(map(len, by.values())) == 6


def test_keep_first_and_ids(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a"), (4, None), (5, None)], "id int, k string")
    assert sorted(r["id"] for r in dedup.keep_first(df, F.col("k"), F.col("id")).collect()) == [1, 2, 4]
    ids = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "n int, id string")
    assert sorted(r["id"] for r in dedup.unique_ids(ids, "id", F.col("n")).collect()) == ["x", "x#2", "y"]


def test_test_overlap_rules(spark):
    base = "මුල් ප්‍රශ්නය කුමක්ද යන්න සොයන්න ගැන"
    dev = [(1, base, ["aaaa one", "bbbb two", "cccc three", "dddd four"]), (2, "entirely different words stand in here", ["w", "x", "y", "z"])]
    probe = [
        (10, base, ["aaaa one", "bbbb two", "cccc three", "dddd four"]),
        (11, base, ["aaaa one", "qqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqq", "rrrrsssstttt uuuuvvvvwwww xxxxyyyyzzzz 0000111122223333", "444455556666 777788889999 abcdefghijkl mnopqrstuvwx"]),
        (12, "first read all of this long introduction that has many other words in it " * 2 + base, ["aaaa one", "bbbb two", "other words stand here", "and here are some more"]),
        (13, "nothing in common at all 12345", ["w", "x", "y", "z"]),
    ]
    schema = "choices array<string>"
    a = dedup.question_grams(spark.createDataFrame(probe, f"id int, question string, {schema}"))
    b = dedup.question_grams(spark.createDataFrame(dev, f"dev_id int, question string, {schema}"))
    got = {r["id"]: (r["dev_id"], r["reason"]) for r in dedup.test_overlap(a, b).collect()}
    assert got[10] == (1, "near-duplicate of a test question (similarity 1.00)")
    assert got[11] == (1, "same question text as a test question")
    assert got[12] == (1, "test question with extra words around it")
    assert 13 not in got
    assert dedup.test_overlap(a, b, top=None).count() == 3


def test_test_overlap_without_a_shuffle_of_grams(spark, monkeypatch):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    text = lambda i, n: " ".join(words[(i * k + k * k) % 12] for k in range(n))
    rows = [(i, text(i, 3 + i % 9), [text(i + k, 2) for k in range(i % 4)]) for i in range(60)]
    rows += [(100, None, ["x"]), (101, "", []), (102, "ab", []), (103, text(3, 6) + " more words at its end", [text(3, 2), text(4, 2)]), (104, "q", None), (None, "alpha beta", [])]
    dev = [(i, *r[1:]) for i, r in enumerate(rows[:20])] + [(50, "", []), (51, "ab", [None]), (52, None, []), (None, "alpha beta", [])]
    a = dedup.question_grams(spark.createDataFrame(rows, "id int, question string, choices array<string>"))
    b = dedup.question_grams(spark.createDataFrame(dev, "dev_id int, question string, choices array<string>"))
    for near in (0.3, 0.95):
        found = dedup.test_overlap(a, b, near=near, top=3)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        want = sorted(map(tuple, found.collect()))
        for bound in ("MAX_CELLS", "MAX_INDEX"):
            with monkeypatch.context() as m:
                m.setattr(dedup, bound, 0)
                assert want == sorted(map(tuple, dedup.test_overlap(a, b, near=near, top=3).collect())) and want


def test_metrics(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", None, False), ("b", 2, True), (None, 1, False)], "subject string, pred int, correct boolean")
    assert {tuple(r) for r in metrics.accuracy_by(df, "subject").collect()} == {("a", 2, 0.5), ("b", 1, 1.0)}
    assert tuple(metrics.overall(df).first()) == (4, 0.5, 0.25)
    dist = metrics.answer_distribution(df, "pred")
    assert [(r["answer"], r["n"]) for r in dist.orderBy("answer").collect()] == [(1, 2), (2, 1), (3, 0), (4, 0)]
    assert metrics.majority(dist).first()["answer"] == 1
    assert metrics.accuracy_gain(df.filter("subject = 'a'"), df, "subject").count() == 2


def test_canonical_by_mode(spark):
    df = spark.createDataFrame([(1, "Eastern music"), (2, "Eastern_music"), (3, "Eastern_music"), (4, "b"), (5, "B"), (6, None)], "id int, s string")
    got = {r["id"]: r["s"] for r in joins.canonical_by_mode(df, "s", "id").collect()}
    assert got == {1: "Eastern_music", 2: "Eastern_music", 3: "Eastern_music", 4: "b", 5: "b", 6: None}


def test_longest_match(spark):
    names = spark.createDataFrame([("art",), ("art-and-craft",), ("sinhala",), ("craft",)], "name string")
    df = spark.createDataFrame([("grade-6-art-and-craft-paper",), ("grade-6-sinhala-medium-art",), ("smart-paper",), (None,)], "slug string")
    got = [r["site_name"] for r in joins.longest_match(df, F.col("slug"), names).orderBy("slug").collect()]
    assert got == [None, "art-and-craft", "art", None]


def test_match_keys(spark):
    q = [("p1", "page", n, 4, None) for n in range(1, 11)] + [("p2", "page", n, 4, 2) for n in range(1, 6)] + [("p3", None, 1, 4, None)]
    k = [(1, "page", n, 1) for n in range(1, 6)] + [(2, "page", n, 5 if n == 1 else 3) for n in range(1, 10)]
    q = spark.createDataFrame(q, "paper string, source_page string, q_no int, n_options int, answer int")
    got = joins.match_keys(q, spark.createDataFrame(k, "key_id int, source_page string, q_no int, answer int")).collect()
    p1 = {r["q_no"]: r["answer"] for r in got if r["paper"] == "p1"}
    assert p1 == {1: None, **{n: 3 for n in range(2, 10)}, 10: None}
    assert all(r["answer"] == 2 for r in got if r["paper"] == "p2") and len(got) == 16


def test_upsert_and_catalog(spark):
    old = spark.createDataFrame([("u1", "a", 1), ("u2", "b", 2)], "url string, v string, n int")
    new = spark.createDataFrame([("u1", "c", 3), ("u3", "d", 4)], "url string, v string, n int")
    assert {(r["url"], r["v"], r["first"]) for r in joins.upsert(old, new, "url", "n").collect()} == {("u1", "c", 1), ("u2", "b", 2), ("u3", "d", 4)}
    listed = spark.createDataFrame([("grade_10/A/term_1/x.pdf", "10", "A"), ("gone.pdf", "9", "B")], "local_path string, grade string, subject string")
    disk = spark.createDataFrame([("grade_10/A/term_1/x.pdf",), ("grade_11/B/term_unknown/y-2019-2021.pdf",), ("other.pdf",)], "local_path string")
    got = {r["local_path"]: r for r in joins.catalog(listed, disk).collect()}
    assert set(got) == {"grade_10/A/term_1/x.pdf", "grade_11/B/term_unknown/y-2019-2021.pdf"}
    assert (got["grade_11/B/term_unknown/y-2019-2021.pdf"]["term"], got["grade_11/B/term_unknown/y-2019-2021.pdf"]["year"]) == ("", "2021")


def test_same_content(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "path string, sha256 string")
    assert [tuple(r) for r in joins.same_content(df).collect()] == [("b", "a")]


def test_windows(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([5, 6, 7, 8, 9, 3, 4, 4, 5])], "g int, i int, v int")
    assert [tuple(r) for r in windows.consecutive_runs(df, ["g"], ["i"], "v").collect()] == [(1, 5, 9, 5)]
    c = windows.cluster_by_gap(spark.createDataFrame([(1, 1.0, 1), (1, 4.0, 2), (1, 9.0, 3)], "g int, x double, i int"), ["g"], "x", 4, "i")
    assert [r["cluster"] for r in c.orderBy("i").collect()] == [1, 1, 2]
    b = spark.createDataFrame([(1, i, x == "y", x == "-") for i, x in enumerate("yy-ynyyn")], "g int, i int, ok boolean, skip boolean")
    assert [tuple(r) for r in windows.longest_block(b, ["g"], "i", "ok", "skip").collect()] == [(1, 0, 3)]


def test_crawl(spark, save):
    host = "https://ex.org"
    pages = [
        (f"{host}/grade-10-papers", f"<a href='/grade-10-history-page/'>h</a> <a href=\"/grade-10-maths\">m</a> <a class=x href={host}/grade-10-art?x=1>a</a> <a href='/grade-9-history'>o</a> <a href='https://other.org/grade-10-z'>z</a>"),
        (f"{host}/grade-10-history-page/", "<a href='/d/grade-10-history-2nd-term-test-paper-2021.pdf'>p</a><a href='/d/grade-10-history-notes.pdf'>n</a><a href='/grade-10-papers'>up</a>"),
        (f"{host}/grade-10-art", "<a href='term-test.pdf'>p</a><a href='/d/grade-10-maths-paper.pdf'>m</a>"),
    ]
    df = spark.createDataFrame(pages, "url string, html string")
    names = spark.createDataFrame([("history", "History"), ("art", "Arts"), ("maths", None)], "name string, subject string")
    papers, follow = crawl.paper_links(df, names, ("ex.org",), 10)
    assert {(r["subject"], r["pdf_url"], r["term"], r["year"]) for r in papers.collect()} == {
        ("History", f"{host}/d/grade-10-history-2nd-term-test-paper-2021.pdf", 2, 2021), ("Arts", f"{host}/term-test.pdf", None, None)
    }
    reached = crawl.crawl_fixpoint(follow, spark.createDataFrame([(f"{host}/grade-10-papers",)], "url string"), save)
    assert {r["url"]: r["depth"] for r in reached.collect()} == {f"{host}/grade-10-papers": 0, f"{host}/grade-10-history-page/": 1, f"{host}/grade-10-art": 1}


def test_http_scorer_tries_again():
    calls, naps = [], []

    def post(body):
        calls.append(body)
        if len(calls) < 3:
            raise OSError
        return {"choices": [{"message": {"content": "2"}}]}

    assert scoring.HttpScorer("m", "http://x", "k", workers=1, post=post, sleep=naps.append).generate([[{"role": "user", "content": "q"}]]) == ["2"]
    assert naps == [1, 2]

    def fail(body):
        raise OSError

    assert scoring.HttpScorer("m", "http://x", "k", post=fail, sleep=lambda s: None).generate([[]]) == [""]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 99), min_size=1, max_size=40), st.integers(20, 60))
def test_quotas_sum_up(sizes, _):
    # the largest-remainder rule of stratified_split, for any stratum size
    for n in sizes:
        parts = [700, 150, 150]
        base, rest = [n * p // 1000 for p in parts], [n * p % 1000 for p in parts]
        left = n - sum(base)
        rank = [sum(rest[j] > rest[i] or rest[j] == rest[i] and j < i for j in range(3)) for i in range(3)]
        assert sum(b + (r < left) for b, r in zip(base, rank)) == n


def test_subject_names(spark):
    rows = {r["name"]: r["subject"] for r in names_of.subject_names(spark, ["history", "Oriental Music"]).collect()}
    assert rows["history"] == "History" and rows["oriental-music"] == "Eastern Music" and rows["geography"] is None and rows["maths"] is None
    slug = spark.createDataFrame([("grade-10-history-of-sri-lanka-paper",), ("grade-6-art-and-craft-sinhala-medium",)], "slug string")
    got = [r["site_name"] for r in joins.longest_match(slug, F.col("slug"), names_of.subject_names(spark)).orderBy("slug").collect()]
    assert got == ["history-of-sri-lanka", "art-and-craft"]


def test_browse(spark):
    rows = [("1", "History", "q1", ["a", "b"], 2, 1, (2020, 1, "g/x.pdf", False)), ("2", "Arts", "q2", ["a", "b"], None, 2, (None, None, "g/y.pdf", True))]
    df = spark.createDataFrame(rows, "id string, subject string, question string, choices array<string>, answer int, q_no int, metadata struct<year:int,term:int,pdf:string,needs_context:boolean>")
    assert browse.browse(df, subject="hist").first()["shown"] == "History | Q1 | 2020 term 1 | g/x.pdf\n\nq1\n   (1) a\n   (2) b   <== answer"
    assert browse.browse(df, answered=False, n=None).first()["shown"].startswith("Arts | Q2 | ? term ? | g/y.pdf   [needs")
    assert browse.browse(df, pdf="Y.PDF").count() == 1 and browse.browse(df, n=1).count() == 1
