"""Retries, range reading and files, without a network; and the model in the task's own process."""

import pytest
from pyspark.sql import functions as F

from paperquill.operators.scoring import LocalScorer
from paperquill.sources import remote
from paperquill.sources.remote import Refused, Response


def test_retries():
    slept, answers = [], iter([OSError(), Response(500, b""), Response(200, b"ok")])

    def get(url, headers):
        got = next(answers)
        if isinstance(got, Exception):
            raise got
        return got

    ask = remote.retrying(get, delay=0.5, sleep=slept.append)
    assert ask("u").body == b"ok" and slept == [0.5, 2.0, 0.5, 4.0, 0.5]
    assert remote.retrying(lambda u, h: Response(404, b""), sleep=slept.append)("u") is None


def server(data, ranges=True, html=False):
    asked = []

    def get(url, headers):
        a, b = map(int, headers["Range"].removeprefix("bytes=").split("-"))
        asked.append((a, b))
        if html:
            return Response(200, b"<html>", {"content-type": "text/html"})
        if not ranges:
            return Response(200, data)
        return Response(206, data[a : b + 1], {"content-range": f"bytes {a}-{b}/{len(data)}"})

    return get, asked


def test_range_reader():
    data = bytes(range(256)) * 10
    get, asked = server(data)
    f = remote.RangeReader("u", get, block=100)
    assert f.size == 2560 and f.seek(-5, 2) == 2555 and f.read() == data[-5:] and f.read(3) == b""
    f.seek(95)
    assert f.read(10) == data[95:105] and f.tell() == 105
    f.seek(-10, 1)
    assert f.read(2) == data[95:97] and asked == [(0, 0), (2500, 2559), (0, 99), (100, 199)] and f.fetched == 260
    whole = remote.RangeReader("u", server(data, ranges=False)[0], block=100)
    assert whole.read() == data and whole.fetched == 2560


def test_range_reader_refuses():
    with pytest.raises(Refused, match="web page"):
        remote.RangeReader("u", server(b"x", html=True)[0])
    with pytest.raises(Refused, match="larger"):
        remote.RangeReader("u", server(b"x" * 99, ranges=False)[0], most_bytes=50)
    now = iter([0.0, 500.0])
    with pytest.raises(Refused, match="slow"):
        remote.RangeReader("u", server(b"x" * 99)[0], clock=lambda: next(now)).read()
    first = iter([Response(206, b"x", {"content-range": "bytes 0-0/99"}), Response(200, b"x" * 99)])
    with pytest.raises(Refused, match="ranges"):
        remote.RangeReader("u", lambda u, h: next(first)).read(1)


def test_fetch(spark):
    df = spark.createDataFrame([("a",), ("bad",), (None,)], "url string")
    got = {r["url"]: (r["body"] and bytes(r["body"]), r["error"]) for r in remote.fetch(df, lambda: lambda u: Response(200, u.encode()) if u == "a" else None).collect()}
    assert got == {"a": (b"a", None), "bad": (None, "failed"), None: (None, "failed")}
    assert remote.fetch(df.limit(0), lambda: None).count() == 0


def test_local_scorer():
    class Said:
        text = "2"

    class Engine:
        def chat(self, batch, settings):
            return ["1" if settings else type("O", (), {"outputs": [Said]}) for _ in batch]

    made = []
    s = LocalScorer(lambda: made.append(1) or Engine())
    assert s.generate([[], []]) == ["2", "2"] and s.generate([[]]) == ["2"] and made == [1]
    assert LocalScorer(Engine, settings=object()).generate([[]]) == ["1"]


def test_ranks_of_a_large_stratum(spark):
    from paperquill.operators.sampling import draw, ranked

    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 7 != 0, "big").alias("g"))
    got = ranked(rows, "g", draw(42, "id"), "id").collect()
    for g in ("big", None):
        mine = [r for r in got if r["g"] == g]
        assert sorted(r["_r"] for r in mine) == list(range(1, len(mine) + 1)) and {r["_n"] for r in mine} == {len(mine)}


def test_gram_counts_with_and_without_a_broadcast(spark, monkeypatch):
    from paperquill.operators import dedup

    rows = [(i, f"question {i % 5} about the thing number {i}", ["one", f"two {i}"]) for i in range(30)] + [(99, None, None), (100, "", [])]
    a = dedup.question_grams(spark.createDataFrame(rows, "row int, question string, choices array<string>"))
    b = dedup.question_grams(spark.createDataFrame(rows[:12], "dev_id int, question string, choices array<string>"))
    fast = sorted(map(tuple, dedup.shared_grams(a, b, "row", "dev_id").collect()))
    monkeypatch.setattr(dedup, "MAX_INDEX", 0)
    assert fast == sorted(map(tuple, dedup.shared_grams(a, b, "row", "dev_id").collect())) and fast


def test_ids_that_many_rows_share(spark, save):
    from paperquill.operators.dedup import unique_ids

    rows = [("a", i) for i in range(500)] + [(None, i) for i in range(20)] + [(f"b{i}", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, at int").repartition(7)
    want = sorted(map(str, unique_ids(df, "id", F.col("at")).collect()))
    assert sorted(map(str, unique_ids(df, "id", F.col("at"), save).collect())) == want and any("a#500" in x for x in want)
