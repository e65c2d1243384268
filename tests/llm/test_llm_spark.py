"""Operators of paperquill.llm on small tables: results by brute force, nulls, empty tables, ties, clashing columns."""

import hashlib
import json
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from paperquill.llm import brown, byte_bpe, components, decontaminate, grid_join, near_dup, queries, revisits, token_frames, tool_calls, toxicity, tree_score  # noqa: E402
from paperquill.llm.base import Scratch  # noqa: E402

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "tests")


def test_byte_bpe_columns(spark):
    df = spark.createDataFrame([(1, "ab cd", "x"), (None, None, None), (2, "", "y"), (2, "", "y")], "doc_id long, text string, ids string")
    enc = byte_bpe.encode_documents(df, P.path(queries.BYTE_BPE), P.PATTERN)
    assert enc.columns == ["doc_id", "text", "ids"]
    got = byte_bpe.decode_documents(enc, P.path(queries.BYTE_BPE)).collect()
    assert Counter(bytes(r["decoded"]) for r in got) == {b"ab cd": 1, b"": 3}
    assert byte_bpe.encode_documents(df.limit(0), P.path(queries.BYTE_BPE), P.PATTERN).count() == 0


def test_op9_against_the_library(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(queries.BYTE_BPE), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op9_byte_bpe(spark, DATA).collect():
        ids = lib.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_token_frames(spark, scratch):
    from tokenizers import Tokenizer

    rows = [(5, "five, words. here"), (None, "null id"), (1, None), (5, "a second five"), (-3, ""), (9, "word " * 5000)]
    df = spark.createDataFrame(rows, DOC)
    folder = f"{scratch.root}/shards"
    manifest = scratch.save(token_frames.write_shards(df, folder, P.path(queries.WORD_BPE), 1, 3))
    lib, at = Tokenizer.from_file(P.path(queries.WORD_BPE)), 0
    got = {(r["doc_id"], r["start"]): r for r in token_frames.read_shards(manifest, folder).collect()}
    assert len(got) == len(rows)
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        assert got[d, at]["ids"] == ids and got[d, at]["crc"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert {r["doc_id"] for r in token_frames.read_shards(manifest, folder, {1, 9}, with_ids=False).collect()} == {1, 9}
    empty = scratch.save(token_frames.write_shards(df.limit(0), folder + "0", P.path(queries.WORD_BPE), 1, 2))
    assert token_frames.read_shards(empty, folder + "0").count() == 0


def test_tree_score_columns(spark):
    df = spark.createDataFrame([(1, "<article><p>A text.</p></article>", "old"), (2, None, None)], "page_id long, html string, text string")
    assert {r["page_id"]: r["text"] for r in tree_score.extract_pages(df).collect()} == {1: "A text.", 2: ""}


def decontaminated(spark, scratch, docs, bench):
    d, b = spark.createDataFrame(docs, DOC), spark.createDataFrame(bench, "item_id long, text string")
    return {r["doc_id"]: r for r in decontaminate.scan(d, b, scratch).collect()}


def test_decontamination(spark, scratch):
    w = [f"w{i}" for i in range(40)]
    bench = [(10, " ".join(w[:20])), (9, "Short ITEM"), (3, None), (4, "..."), (5, " ".join(w[:20])), (6, "É only here")]
    docs = [
        (1, "x " * 30 + "W0, " + " ".join(w[1:13]) + " y"), (2, "short, item!"), (3, None), (4, ""), (5, " ".join(w[:12])), (6, "é only here"), (7, "É ONLY here"),
        (8, " ".join(w[:20]) + " " + " ".join(w[5:20])), (9, "item short " * 4000 + "end"),
    ]
    got = decontaminated(spark, scratch, docs, bench)
    assert {k: (r["n_words"], r["n_hit"], r["items"]) for k, r in got.items()} == {
        1: (44, 13, ["10", "5"]), 2: (2, 2, ["9"]), 3: (0, 0, []), 4: (0, 0, []), 5: (12, 0, []), 6: (3, 0, []), 7: (3, 3, ["6"]), 8: (35, 35, ["10", "5"]), 9: (8001, 7998, ["9"]),
    }
    assert decontaminated(spark, scratch, docs, [(1, None)])[8]["n_hit"] == 0


def test_decontamination_removes(spark, scratch):
    docs = spark.createDataFrame([(1, "a, bad item. b", "x"), (2, "clean", "y"), (2, "clean", "y"), (None, None, None)], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(1, "bad item")], "item_id long, text string")
    kept = decontaminate.remove_documents(docs, bench, scratch)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == {2: 2, None: 1}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench, scratch).collect()}
    assert cut == {1: "a, b", 2: "clean", None: None}


def test_one_window_in_a_long_document_removes_it(spark, scratch):
    w = [f"w{i}" for i in range(30)]
    long = lambda inside: " ".join([f"x{i}" for i in range(1000)] + inside + [f"y{i}" for i in range(1000)])
    docs = [(1, long(w[3:16])), (2, long(w[3:15])), (3, long(["bad", "item"])), (4, "a bad item"), (None, long(w[3:16])), (5, None), (6, "")]
    df = spark.createDataFrame([(d, t, "r", "k", "h", "g") for d, t in docs], "doc_id long, text string, row string, _text_key string, hits string, gone string")
    bench = spark.createDataFrame([(1, " ".join(w)), (2, "bad item")], "item_id long, text string")
    kept = decontaminate.remove_documents(df, bench, scratch)
    assert kept.columns == df.columns
    assert Counter(map(tuple, kept.collect())) == Counter((d, t, "r", "k", "h", "g") for d, t in docs if d in (2, 3, 5, 6))
    cut = decontaminate.remove_spans(df, bench, scratch)
    assert cut.columns == df.columns and {(r["hits"], r["gone"]) for r in cut.collect()} == {("h", "g")}
    assert {r["doc_id"]: r["text"] for r in cut.collect()}[1] == long([])
    assert decontaminate.remove_documents(df.limit(0), bench, scratch).count() == 0
    assert decontaminate.remove_documents(df, bench.limit(0), scratch).count() == len(docs)


def test_stages_keep_columns_with_the_names_of_helpers(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for c in ("_row", "row", "score", "_score", "_text_key", "hits", "node"):
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DATA)
        assert kept.columns == docs.columns and kept.join(docs, docs.columns, "left_anti").count() == 0 and kept.count() > 100


def test_decontamination_by_join_when_the_index_is_large(spark, scratch, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    got = decontaminated(spark, scratch, [(1, "a bad item b"), (2, "none")], [(1, "bad item")])
    assert (got[1]["n_hit"], got[2]["n_hit"]) == (2, 0)


def test_toxicity_on_empty_and_null(spark, scratch):
    docs = spark.createDataFrame([(i, f"clean text number {i} of many") for i in range(60)] + [(100 + i, f"you idiot number {i}") for i in range(30)] + [(999, None)], DOC)
    labels = spark.createDataFrame([(i, 0) for i in range(60)] + [(100 + i, 1) for i in range(30)] + [(None, 1), (7, None), (12345, 1)], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels, scratch)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs.withColumn("score", F.lit("x")), m).collect()}
    assert all(got[i] < 0.3 for i in range(60)) and all(got[100 + i] >= 0.3 for i in range(30))
    assert 0 < got[999] == toxicity.score_documents(spark.createDataFrame([(1, "")], DOC), m).first()["score"] < 1
    none = toxicity.fit(docs, labels.limit(0), scratch)
    assert {r["score"] for r in toxicity.score_documents(docs, none).collect()} == {0.0}


def test_toxicity_of_repeated_ids_is_bounded(spark, scratch):
    docs = spark.createDataFrame([(1, f"you idiot number {i} of them") for i in range(40)] + [(2, f"a fine text number {i} of them") for i in range(40)], DOC)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels, scratch, max_rows=10)
    assert m.rows == 20 and m.swapped == 0


def test_toxicity_swaps_identity_terms(spark, scratch):
    rng = np.random.default_rng(4)
    rows = [(i, f"they hate {rng.choice(['women', 'men'])} idiots {rng.integers(50)}" if i % 4 == 0 else f"we met {'women' if i % 9 == 0 else 'people'} there {rng.integers(50)}") for i in range(600)]
    docs, labels = spark.createDataFrame(rows, DOC), spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    test = spark.createDataFrame([(1, "we met women there"), (2, "we met men there"), (3, "they hate women idiots")], DOC)
    held = {}
    for weight in (0.0, 1.0):
        m = toxicity.fit(docs, labels, scratch, counterfactual=weight)
        s = {r["doc_id"]: r["score"] for r in toxicity.score_documents(test, m).collect()}
        held[weight] = abs(s[1] - s[2])
        assert m.swapped > 100 and s[3] > 0.9
    assert held[1.0] < 0.5 * held[0.0] or held[1.0] < 0.01


def test_a_scratch_is_closed(spark):
    import os

    with Scratch(spark, "closed") as s:
        t = s.save(spark.range(3), "t")
        folder = s.root.removeprefix("file://")
        assert t.count() == 3 and os.path.isdir(folder)
    assert not os.path.isdir(folder)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op2_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    hit = sum(r["predicted"] == 1 for r in got if r["toxic"] == 1) / sum(r["toxic"] == 1 for r in got)
    false = sum(r["predicted"] == 1 for r in got if r["toxic"] == 0) / sum(r["toxic"] == 0 for r in got)
    assert hit >= 0.7 and false <= 0.05


def test_brown_against_counts(spark, scratch):
    train = [(1, "the cat sat"), (2, "The dog\tsat"), (3, None), (4, "das Haus ist das Haus"), (4, "das Haus ist das Haus")]
    docs = [*train, (9, "the unknown cat"), (10, ""), (None, "the"), (11, "the " * 5000)]
    c = Counter()
    for _, t in train:
        c.update([*(t or "").lower().split(), None])
    n, v = sum(c.values()), len(c)
    model, rare = brown.fit(spark.createDataFrame(train, DOC), scratch, head=2)
    assert (model.n, model.v) == (n, v) and rare.count() > 0
    got = brown.score(spark.createDataFrame(docs, DOC), model, rare, scratch, [F.col("doc_id")]).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    for d, t in docs:
        tokens = [*(t or "").lower().split(), None]
        r = by[d]
        assert (r["n_tokens"], r["n_known"]) == (len(tokens), sum(c[x] > 0 for x in tokens))
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens), rel_tol=1e-9)
        assert r["score"] < 0 and r["perplexity"] > 1
    nothing, rare = brown.fit(spark.createDataFrame([], DOC), scratch)
    assert brown.score(spark.createDataFrame(docs[:1], DOC), nothing, rare, scratch, [F.col("doc_id")]).first()["base_score"] == 0


def test_brown_endings_are_the_same_in_sql(spark):
    words = ["a", "...", "(word)", "Größe,", "ක්‍ර", "日本語文", "x!", "'tis", "-", "ab", "naïve", "\u00a0z", "😀😀😀😀", "\"q\""]
    df = spark.createDataFrame([(w.encode(),) for w in words], "word binary")
    got = {bytes(r[0]).decode(): r[1] for r in df.select("word", brown.ending_class("word", list(range(brown.ENDINGS)))).collect()}
    assert got == {w: brown.ending(w.encode()) for w in words}


def test_brown_probabilities_sum_to_one(spark, scratch):
    train = [(i, t) for i, t in enumerate(["a b c a b", "b c a", "d e f d", "e f d e", "rare words here"])]
    model, rare = brown.fit(spark.createDataFrame(train, DOC), scratch)
    words = sorted({w for _, t in train for w in t.split()})
    unit = brown._Units(model.unit_words)
    for g in range(brown.CLASSES):
        total = 10 ** model.transition[g, 0]
        for w in words:
            k = model.classes[unit[w.encode()]]
            total += 10 ** (model.transition[g, k] - model.class_log[k]) * (model.head[w.encode()] - model.discount)
        for k in range(1, brown.CLASSES):
            total += model.unseen[k] * 10 ** (model.transition[g, k] - model.class_log[k] + model.unknown_log[k])
            once = np.log10(1 - model.discount)
            assert model.unknown_log[k] < once or not any(model.classes[unit[w.encode()]] == k for w in words)
        assert math.isclose(total, 1, abs_tol=1e-6)


def test_brown_score_by_brute_force(spark, scratch):
    """Scores from class bigrams, counts and types that are taken from the texts here; only the classes are the model's."""
    rng = np.random.default_rng(9)
    train = [(i, " ".join(f"w{min(int(x), 200)}" for x in rng.zipf(1.3, 30))) for i in range(80)] + [(80, None), (81, "Only HERE")]
    docs = [*train[:9], (100, "w1 never seen w2"), (101, ""), (102, None), (103, "zzz " * 300)]
    for head in (10_000, 20):
        model, rare = brown.fit(spark.createDataFrame(train, DOC), scratch, head=head)
        unit = brown._Units(model.unit_words)
        own = {w: int(model.classes[unit[w]]) for w in model.head} | {bytes(r["word"]): r["k"] for r in rare.collect()}
        of = lambda w: own.get(w, int(model.classes[unit[w]]))
        split = lambda t: (t or "").lower().encode().split()
        counts, table, n_class = Counter(), np.zeros((brown.CLASSES, brown.CLASSES)), np.zeros(brown.CLASSES)
        for _, t in train:
            path = [0, *map(of, split(t)), 0]
            counts.update(split(t))
            for a, b in zip(path, path[1:]):
                table[a, b] += 1
                n_class[b] += 1
        types = np.bincount([of(w) for w in counts], minlength=brown.CLASSES)
        once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
        d = min(0.95, max(0.05, once / (once + 2 * twice)))
        share = (n_class + 0.5) / (n_class.sum() + 0.5 * brown.CLASSES)
        got = {r["doc_id"]: r["score"] for r in brown.score(spark.createDataFrame(docs, DOC), model, rare, scratch, [F.col("doc_id")]).collect()}
        for doc, t in docs:
            want, before = 0.0, 0
            for w in [*split(t), None]:
                k = 0 if w is None else of(w)
                p = (table[before, k] + brown.MIX * share[k]) / (table[before].sum() + brown.MIX)
                if w is not None:
                    unseen = max(1.0, 2 * d / (1 - d) * (types[k] if n_class[k] else types.mean()))
                    mass = d * types[k] if n_class[k] and types[k] else 1.0
                    p *= (counts[w] - d if counts[w] else mass / unseen) / max(n_class[k], 1)
                want, before = want + math.log10(p), k
            assert math.isclose(got[doc], want, rel_tol=1e-9), doc


@pytest.mark.parametrize("head", [5000, 700])  # by exchange in rounds; and words beyond the head by their neighbours
def test_brown_classes_of_rare_words_follow_their_neighbours(spark, scratch, head):
    # two languages whose words have the same endings: no word beyond the first 640 tells them apart by its ending
    rng = np.random.default_rng(3)
    draw = lambda side: " ".join(f"{'pq'[side]}{min(int(x), 899)}" for x in rng.zipf(1.15, 40))
    train = [(i, draw(i % 2)) for i in range(3000)]
    model, rare = brown.fit(spark.createDataFrame(train, DOC), scratch, head=head)
    unit = brown._Units(model.unit_words)
    classes = {w.decode(): int(model.classes[unit[w]]) for w, c in model.head.items() if c >= 3}
    classes |= {bytes(r["word"]).decode(): r["k"] for r in rare.filter("c >= 3").collect()}
    sides = Counter((k, w[0]) for w, k in classes.items())
    assert len(classes) > 1300
    assert sum(max(sides[k, "p"], sides[k, "q"]) for k in range(brown.CLASSES)) > 0.97 * len(classes)
    n = brown.score(spark.createDataFrame(train[:50], DOC), model, rare, scratch, [F.col("doc_id")]).filter("score < 0").count()
    assert n == 50 and model.stopped


def test_near_duplicates(spark, scratch):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(120)]
        for k in range(8):
            t = list(base)
            for p in rng.choice(120, rng.integers(0, 5), replace=False):
                t[p] = word()
            rows.append((n, " ".join(t)))
            n += 1
    rows += [(1000, None), (1001, ""), (1002, "two words"), (1003, "Two  words"), (1004, "a b c d e"), (1005, "x " * 20000), (1006, "x " * 3), (None, rows[0][1]), (1007, "alone only")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, DOC + ""), scratch, 85).collect()
    sets = [near_dup.shingles((t or "").encode(), 5) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = near_dup.common(sets[i], sets[j]) if len(sets[i]) and len(sets[j]) else 0
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))
    assert near_dup.near_duplicates(spark.createDataFrame([], DOC), scratch, 85).count() == 0


def test_near_duplicates_in_blocks(spark, scratch, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(30):  # a chain: neighbours are near, the ends are not
        rows.append((k, " ".join([f"n{j}" if j < k else w for j, w in enumerate(base)])))
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOC), scratch, 85).collect()}
    assert set(got.values()) == {0}


@pytest.mark.parametrize("products", [0, 16])
def test_near_duplicates_of_one_template(spark, scratch, monkeypatch, products):
    """Texts of a template that are mostly too different to link, some pairs of which do link, in buckets of many blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "PRODUCTS", products)
    rng = np.random.default_rng(11)
    rows = []
    for i in range(150):
        t = [f"t{j}" for j in range(150)]
        for at in rng.choice(30, int(rng.integers(1, 6)), replace=False) * 5:
            t[at] = f"own{i}x{at}" if rng.random() < 0.8 else f"shared{at}x{rng.integers(3)}"
        rows.append((i, " ".join(t)))
    sets = [set(near_dup.shingles(t.encode(), 5).tolist()) for _, t in rows]
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top[i], top[j]))
                top = [a if x == b else x for x in top]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOC), scratch, 85).collect()}
    assert got == dict(enumerate(top)) and 3 < len(set(top)) < 140


def test_keep_one(spark, scratch):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(3, t, "a"), (2, t, "b"), (2, t, "c"), (5, "other text", "d"), (6, None, "e"), (7, None, "f")], "doc_id long, text string, row string")
    table = scratch.save(df.coalesce(1))
    got = near_dup.keep_one(table, scratch)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == [2, 5, 6, 7]


def test_near_duplicates_when_splits_change_between_scans(spark, scratch, monkeypatch, tmp_path):
    # as when an executor is lost or joins: the scans of one run are cut differently
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(0, 80, 2)]
    rows += [(d + 1, t + " more") for d, t in rows[::4]]
    spark.createDataFrame(rows, DOC).repartition(8).write.parquet(f"{tmp_path}/docs")
    save, cut = Scratch.save, iter(range(1 << 30))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def moved(self, df, name="t"):
        out = save(self, df, name)
        spark.conf.set("spark.sql.files.maxPartitionBytes", ["700", "128m"][next(cut) % 2])
        return out

    monkeypatch.setattr(Scratch, "save", moved)
    try:
        docs = spark.read.parquet(f"{tmp_path}/docs")
        got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, scratch, 80).collect()}
        kept = near_dup.keep_one(docs, scratch).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {d: d - d % 2 for d, _ in rows}
    assert sorted(map(tuple, kept)) == [(d, t) for d, t in sorted(rows) if d % 2 == 0]


def test_grid_join_edges(spark, scratch):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 0.0, 0.0]
    rows = [
        (1, v, 1), (2, v, 1), (3, [2.0, 0.0, 0.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [nan, 1.0, 0.0], 1), (9, [inf, 1.0, 0.0], 1), (10, [None, 1.0, 0.0], 1),
        (11, [-1.0, 0.0, 0.0], 1), (12, [], 1), (None, v, 1), (13, [1.0, 0.0], 1), (14, [1.0, 0.1, 0.0], 1), (14, [1.0, 0.1, 0.0], 1), (15, [1e-30, 1e-31, 0.0], 1),
    ]
    got = grid_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), scratch, 0.98).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    for i in (1, 2, 3, 14, 15):
        assert by[i] == (5, 1, i == 1)
    for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13):
        assert by[i] == (0, i, True)
    assert by[None] == (0, None, True)
    assert grid_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int"), scratch, 0.98).count() == 0


def test_grid_join_blocks(spark, scratch, monkeypatch):
    monkeypatch.setattr(grid_join, "INTERVAL", 16)
    monkeypatch.setattr(grid_join, "LEAF", 4)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(8, 12))
    x = (centers[rng.integers(8, size=200)] + rng.normal(size=(200, 12)) * 0.09).astype(np.float32).astype(float)
    y = rng.integers(3, size=200)
    df = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y))], "vec_id long, embedding array<float>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (y[:, None] == y)
    np.fill_diagonal(near, False)
    comp = np.arange(200)
    for _ in range(200):
        comp = np.minimum(comp, np.where(near, comp, 10**6).min(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in grid_join.near_vectors(df, scratch, 0.98).collect()}
    assert got == {i: (int(near[i].sum()), int(comp[i])) for i in range(200)} and near.any()


def test_million_words_and_hot_keys(spark, scratch):
    """A text of a million words; a vertex that two thirds of the edges share; a bucket of many near copies of it."""
    long = " ".join(f"w{i}" for i in range(1_000_000))
    rows = [(0, long), (1, long + " more"), (2, "short text of a few words")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOC), scratch, 85).collect()}
    assert got == {0: (999_996, 0), 1: (999_997, 0), 2: (2, 2)}
    edges = [(7, i) for i in range(10, 3000)] + [(i, i + 1) for i in range(5000, 6000)]
    comp = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert comp == {7: 7, **{i: 7 for i in range(10, 3000)}, **{i: 5000 for i in range(5000, 6001)}}
    base = [f"v{i}" for i in range(60)]
    near = [(i, " ".join([*base[: i % 60], f"own{i}", *base[i % 60 + 1 :]])) for i in range(900)]
    assert {r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(near, DOC), scratch, 80).collect()} == {0}


def test_extra_columns_with_the_names_of_helpers(spark, scratch):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, "a", "b"), (2, [1.0, 0.0], 1, "c", "d")], "vec_id long, embedding array<double>, label int, row string, node string")
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in grid_join.near_vectors(df, scratch, 0.98).collect()} == {(1, 1, 1), (2, 1, 1)}
    docs = spark.createDataFrame([(1, "a b c", "x", "y", "z"), (2, "b c", "x", "y", "z")], "doc_id long, text string, training string, tail string, n_tokens string")
    model, rare = brown.fit(docs, scratch)
    out = brown.score(docs, model, rare, scratch, [F.col("doc_id")])
    assert out.columns == ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"] and out.count() == 2
    _, both = brown.fit_and_score(docs, F.col("doc_id") == 1, scratch, [F.col("doc_id"), F.col("training")])
    assert {r["training"] for r in both.collect()} == {"x"}


def test_components(spark, scratch):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 7), (None, 3), (5, 2), (2, 9), (9, 5), (9, 5)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 2: 2, 5: 2, 9: 2}


def test_tool_calls(spark, scratch):
    schemas = {"get": (tool_calls.Argument("city", "string", low=1), tool_calls.Argument("days", "integer", required=False, low=1, high=7), tool_calls.Argument("unit", "string", required=False, values=("C", "F"))), "noop": ()}
    good = '{"days": 3, "city":"Bern" }'
    calls = [
        (1, "a", "get", good), (1, "b", "get", '{"city": 5}'), (1, "c", "get", '{"days": 9, "city": "x", "unit": "K"}'), (1, "d", "noop", "{}"), (1, "e", "noop", "no json"), (1, "f", "other", "{}"), (1, "g", "noop", "[1]"),
        (1, "x", "noop", "{}"), (1, "y", "noop", "{}"), (1, "h", "noop", "{}"), (2, "a", "noop", "{}"), (2, "a", "noop", "{}"), (2, None, "noop", "{}"), (3, "i", None, None), (1, "k", "get", '{"days": null}'),
    ]
    results = [(1, "a", 'said "hi"\n'), (1, "d", "2"), (1, "d", "1"), (1, "zz", "lost"), (None, "a", "x"), (1, "h", None)]
    depends = [(1, "d", "a"), (1, "h", "d"), (1, "h", "a"), (1, "x", "y"), (1, "y", "x"), (1, "a", "a"), (1, "a", "missing")]
    df = spark.createDataFrame
    c = df(calls, "conv_id long, call_id string, name string, arguments string").withColumn("level", F.lit("clash"))
    r = df(results, "conv_id long, call_id string, content string")
    out = tool_calls.link(c, r, df(depends, "conv_id long, call_id string, after string"), schemas, scratch).collect()
    assert len(out) == len(calls)
    by = {(x["conv_id"], x["call_id"]): x for x in out}
    status = {k: x["status"] for k, x in by.items()}
    assert status == {
        (1, "a"): "ok", (1, "b"): "invalid", (1, "c"): "invalid", (1, "d"): "ambiguous", (1, "e"): "invalid", (1, "f"): "invalid", (1, "g"): "invalid", (1, "x"): "unordered", (1, "y"): "unordered",
        (1, "h"): "ok", (2, "a"): "duplicate", (2, None): "unordered", (3, "i"): "invalid", (1, "k"): "invalid",
    }
    assert [by[1, k]["level"] for k in "adh"] == [0, 1, 2]
    assert by[1, "a"]["record"] == '{"arguments":{"city":"Bern","days":3},"id":"a","name":"get","result":"said \\"hi\\"\\n"}'
    assert json.loads(by[1, "d"]["record"])["result"] == "1" and by[3, "i"]["record"] is None
    assert by[1, "c"]["problems"] == ["days: out of range", "unit: not one of its values"] and by[1, "k"]["problems"] == ["city: missing"]
    assert {(x["conv_id"], x["call_id"]) for x in tool_calls.orphans(c, r).collect()} == {(1, "zz"), (None, "a")}
    assert tool_calls.link(c.limit(0), r, df(depends, "conv_id long, call_id string, after string"), schemas, scratch).count() == 0


def test_levels_of_long_chains_and_joins(spark, scratch):
    edges = [(0, f"c{i}", f"c{i - 1}") for i in range(1, 300)] + [(0, "m", "c299"), (0, "m", "c10"), (0, "n", "m"), (0, "o", "n"), (0, "o", "m"), (0, "p", "o"), (0, "q", "r"), (0, "r", "s"), (0, "s", "q"), (0, "t", "q"), (0, "u", "t"), (0, "u", "m")]
    nodes = sorted({x for e in edges for x in e[1:]})
    calls = spark.createDataFrame([(0, x) for x in nodes] + [(1, "c5")], "conv_id long, call_id string")
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in tool_calls.levels(calls, spark.createDataFrame(edges, "conv_id long, call_id string, after string"), scratch, ["conv_id", "call_id"]).collect()}
    assert got == {**{(0, f"c{i}"): i for i in range(300)}, (0, "m"): 300, (0, "n"): 301, (0, "o"): 302, (0, "p"): 303, (1, "c5"): 0}


RECORD = "record long, url string, ts long, kind string, etag string, modified string, digest string, headers map<string,string>"


def test_revisits(spark, scratch):
    h = {"ETag": '"1"', "X": "old", "Date": "d1", "x": "newer"}
    rows = [
        (1, "http://www.A.org:80/p/?b=2&a=1&utm_source=q#f", 10, "response", 'W/"1"', "m1", "D1", h), (2, "https://a.org/p?a=1&b=2", 20, "revisit", '"1"', None, None, {"date": "d2", "Server": "s"}),
        (3, "https://a.org/p?a=1&b=2", 20, "response", '"2"', "m2", "D2", None), (4, "https://a.org/p?a=1&b=2", 20, "revisit", '"2"', None, None, None), (5, "https://a.org/p?a=1&b=2", 21, "revisit", None, "m2", None, None),
        (6, "https://a.org/p?a=1&b=2", 22, "revisit", None, "m1", None, None), (7, "https://a.org/p?a=1&b=2", 23, "revisit", None, None, None, None), (8, "https://b.org/", 1, "revisit", '"1"', None, None, None),
        (9, None, 5, "revisit", '"1"', None, None, None), (10, "https://a.org/p?a=1&b=2", None, "revisit", None, None, None, None), (11, "https://a.org/p?a=1&b=2", 30, "other", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, RECORD).withColumn("status", F.lit("clash"))
    got = {r["record"]: r for r in revisits.resolve(df, scratch).collect()}
    assert {k: (r["source"], r["status"]) for k, r in got.items()} == {
        2: (1, "resolved"), 4: (1, "changed"), 5: (3, "resolved"), 6: (3, "changed"), 7: (3, "unchecked"), 8: (None, "missing"), 9: (None, "missing"), 10: (None, "missing")
    }
    assert got[2]["headers"] == {"etag": '"1"', "x": got[2]["headers"]["x"], "date": "d2"} and got[2]["digest"] == "D1" and got[4]["headers"] is None
    assert revisits.resolve(df.limit(0), scratch).count() == 0


def test_revisits_of_a_hot_url(spark, scratch):
    rows = [(i, "http://h/x", i, "response" if i % 50 == 0 else "revisit", None, None, str(i // 50), {}) for i in range(1, 1000)]
    got = {r["record"]: r["source"] for r in revisits.resolve(spark.createDataFrame(rows, RECORD).repartition(4), scratch).collect()}
    assert got == {i: (i // 50 * 50 or None) for i in range(1, 1000) if i % 50}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scratch = Scratch(spark, "stages")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = scratch.save(stage(spark, docs, DATA), name)
        assert kept.columns == docs.columns and kept.join(docs, docs.columns, "left_anti").count() == 0 and kept.count() <= docs.count()
        if name == "near_dup":
            sets = [near_dup.shingles((r["text"] or "").encode(), 5) for r in kept.collect()]
            for i in range(len(sets)):
                for j in range(i):
                    both = near_dup.common(sets[i], sets[j])
                    assert 100 * both < 80 * (len(sets[i]) + len(sets[j]) - both) or not len(sets[i])
        docs = kept
    assert docs.count() > 100
    done = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert done.count() == docs.count()


def test_tables_live_as_long_as_plans_that_read_them(spark, scratch):
    import gc
    import os

    def made():
        return scratch.save(spark.range(10).withColumnRenamed("id", "n"), "kept").select((F.col("n") + 1).alias("m"))

    derived = made()
    lost = scratch.save(spark.range(3), "lost")
    path = lost._paperquill_path.removeprefix("file://")
    assert os.path.isdir(path)
    del lost
    for _ in range(20):
        gc.collect()
        scratch.free()
        if not os.path.isdir(path):
            break
    assert not os.path.isdir(path)
    assert derived.agg(F.sum("m")).first()[0] == 55
