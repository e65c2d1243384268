"""The registered queries of paperquill.llm over whole small tables, by brute force, the libraries or their SQL."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from paperquill.llm import queries  # noqa: E402

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def documents(spark, d):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}


def crc(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())


def groups(links, ids):
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_op1(spark):
    docs = documents(spark, SMALL)
    c = Counter(w for i, t in docs.items() if crc(i, 7) != 2 for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    rows = queries.op1_brown(spark, SMALL).collect()
    assert len(rows) == len(docs)
    mean = {}
    for r in rows:
        ws = [*words(docs[r["doc_id"]]), None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(r["doc_id"], 7) == 2, len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        at = mean.setdefault(r["held_out"], [0.0, 0])
        mean[r["held_out"]] = [at[0] + r["score"], at[1] + r["n_tokens"]]
    assert mean[True][0] / mean[True][1] < mean[False][0] / mean[False][1]  # held-out texts are less likely than those learnt from


def test_op3(spark):
    from tokenizers import Tokenizer

    docs, lib, at = documents(spark, SMALL), Tokenizer.from_file(P.path(queries.WORD_BPE)), 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op3_token_frames(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for i in sorted(docs):
        ids = [*lib.encode(docs[i], add_special_tokens=False).ids, 1]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("name", ["op4_decontaminate", "op6_tool_calls", "op7_revisits"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    ours, theirs = queries.queries()[name](spark, SMALL), con.sql(queries.oracle_sql()[name])
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    assert Counter(tuple(r[c] for c in cols) for r in ours.collect()) == Counter(theirs.project(", ".join(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("d", [SMALL, "/root/testdata/check_s"])  # only the second has vectors that link
def test_op5(spark, d):
    if not os.path.exists(d):
        pytest.skip("no such tables here")
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    ok = [r for r in rows if r["label"] is not None and r["embedding"] and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and np.any(r["embedding"])]
    links, n = [], Counter()
    for label in {r["label"] for r in ok}:
        mine = [r for r in ok if r["label"] == label]
        x = np.array([r["embedding"] for r in mine], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(x @ x.T >= 0.98)):
            if i != j:
                n[mine[i]["vec_id"]] += 1
                links.append((mine[i]["vec_id"], mine[j]["vec_id"]))
    top = groups(links, [r["vec_id"] for r in rows])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries.op5_grid_join(spark, d).collect()}
    assert got == {r["vec_id"]: (n[r["vec_id"]], top[r["vec_id"]], top[r["vec_id"]] == r["vec_id"]) for r in rows}
    assert links or d == SMALL


def test_op8(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = queries.op8_tree_score(spark, SMALL).collect()
    assert {r["page_id"] for r in got} == set(pages) and len(got) == len(pages)
    for r in got:
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]
        assert not re.search(r"<[a-z/]|[ \t]{2}|\n\n|^\s|\s$", r["text"])
    assert sum(r["n_chars"] > 0 for r in got) > 0.9 * len(got)


@pytest.mark.parametrize("d", [SMALL, MORE])
def test_op10(spark, d):
    """All links, by an inverted index of all shingles: no pair of different sets is passed over."""
    docs = documents(spark, d)
    sets = {}
    for i, t in docs.items():
        ws = words(t)
        sets[i] = {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())
    index = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    shared = Counter((a, b) for held in index.values() if len(held) < 400 for k, a in enumerate(held) for b in held[k + 1 :])
    links = [(a, b) for (a, b), _ in shared.items() if 100 * (both := len(sets[a] & sets[b])) >= 85 * (len(sets[a]) + len(sets[b]) - both)]
    top = groups(links, docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op10_near_dup(spark, d).collect()}
    assert got == {i: (len(sets[i]), top[i], top[i] == i) for i in docs} and links


def test_pipeline_run(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(queries.BYTE_BPE), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = documents(spark, SMALL)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    hit = {r["doc_id"] for r in queries.op4_decontaminate(spark, SMALL).filter("contaminated").collect()}
    assert set(got) <= set(docs) - hit and len(got) > len(docs) / 2
    for i, r in got.items():
        ids = lib.encode_ordinary(docs[i])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
