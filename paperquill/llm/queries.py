"""The thin queries that apply each operator of this subpackage to its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, byte_bpe, decontaminate, grid_join, near_dup, revisits, token_frames, tool_calls, toxicity, tree_score
from .base import Scratch, crc_mod, read_table

BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"


def byte_bpe_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    coded = byte_bpe.encode_documents(docs.select("doc_id", "text"), ranks_path, pattern)
    back = byte_bpe.decode_documents(coded.drop("text"), ranks_path)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def held_out(modulus: int) -> Column:
    """True for the rows that the contracts keep from training."""
    return F.coalesce(crc_mod("doc_id", modulus) == 2, F.lit(False))


def op1_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "brown"), read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model, rows = brown.fit_and_score(docs, ~held_out(7), scratch, [F.col("doc_id"), held_out(7).alias("held_out")])
    return rows.withColumn("train_tokens", F.lit(model.n).cast("long"))


def toxicity_model(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> toxicity.Model:
    return toxicity.fit(docs, labels.filter(~held_out(4)), scratch)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "toxicity"), read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, toxicity_model(docs, read_table(spark, sf_dir, "labels"), scratch))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(4).alias("held_out"), "score", predicted)


def op3_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all documents' ids, written to the shared folder and read back."""
    scratch = Scratch(spark, "frames")
    folder = f"{scratch.root}/shards"
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = read_table(spark, sf_dir, "documents")
    manifest = scratch.save(token_frames.write_shards(docs, folder, public_tokenizers.path(WORD_BPE), 1, shards), "manifest")
    scratch.tie(folder, manifest)
    return token_frames.read_shards(manifest, folder, with_ids=False).withColumnRenamed("crc", "ids_crc32")


def decontamination_digests(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    return decontaminate.scan(docs, benchmark, scratch).select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "decontaminate")
    return decontamination_digests(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), scratch)


OP4_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
cut AS (SELECT item_id, w, unnest(range(greatest(len(w) - 13, 0) + 1)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, array_to_string(w[i + 1:i + 13], ' ') AS win, least(len(w), 13) AS size FROM cut),
sizes AS (SELECT DISTINCT size FROM windows),
spots AS (SELECT r, w, unnest(range(len(w))) AS pos0 FROM words),
found AS (
  SELECT s.r, s.pos0, z.size, v.item_id
  FROM spots s JOIN sizes z ON s.pos0 + z.size <= len(s.w) JOIN windows v ON v.size = z.size AND v.win = array_to_string(s.w[s.pos0 + 1:s.pos0 + z.size], ' ')),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(pos0, pos0 + size)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


def op5_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "grid-join")
    return grid_join.near_vectors(read_table(spark, sf_dir, "embeddings"), scratch, 0.98)


#: Tools that the turns of a conversation are taken to call, and what their arguments have to be.
TOOLS = {
    "answer": (tool_calls.Argument("turn", "integer", low=0, high=6), tool_calls.Argument("words", "integer", low=1), tool_calls.Argument("digest", "string", low=32, high=32)),
    "note": (tool_calls.Argument("turn", "integer"), tool_calls.Argument("words", "integer", low=1, high=30), tool_calls.Argument("reason", "string", required=False)),
}


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as calls (of 'answer' from 200 characters on, else of 'note'), the user turns after them as results."""
    scratch, turns = Scratch(spark, "tool-calls"), read_table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    n_words = F.regexp_count(text, F.lit(r"[^ \t\n\r]+"))
    arguments = F.concat(F.lit('{ "words" : '), n_words.cast("string"), F.lit(', "turn": '), F.col("turn").cast("string"), F.lit(', "digest":"'), F.md5(text.cast("binary")), F.lit('" }'))
    call_id = lambda n: F.concat(F.lit("call-"), (F.col("turn") - n).cast("string"))
    asked = turns.filter("role = 'assistant'")
    calls = asked.select("conv_id", call_id(0).alias("call_id"), F.when(F.char_length(text) >= 200, "answer").otherwise("note").alias("name"), arguments.alias("arguments"))
    results = turns.filter("role = 'user'").select("conv_id", call_id(1).alias("call_id"), F.md5(text.cast("binary")).alias("content"))
    depends = asked.select("conv_id", call_id(0).alias("call_id"), call_id(2).alias("after"))
    linked = tool_calls.link(calls, results, depends, TOOLS, scratch)
    rows = linked.select("conv_id", "call_id", "name", F.col("level").cast("long").alias("level"), "status", F.array_join("problems", "; ").alias("problems"), F.col("n_results").cast("long").alias("n_results"), "record")
    return rows


OP6_SQL = r"""
WITH asked AS (
  SELECT conv_id, turn, 'call-' || turn AS call_id, CASE WHEN length(coalesce(text, '')) >= 200 THEN 'answer' ELSE 'note' END AS name,
         len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) AS words, md5(coalesce(text, '')) AS digest
  FROM conversations WHERE role = 'assistant'),
often AS (SELECT conv_id, turn, count(*) AS n FROM asked GROUP BY ALL),
answer AS (SELECT conv_id, turn - 1 AS turn, count(*) AS n_results, min(md5(coalesce(text, ''))) AS result FROM conversations WHERE role = 'user' GROUP BY ALL),
chain AS (
  WITH RECURSIVE c AS (
    SELECT conv_id, turn, 0 AS level FROM often o WHERE NOT EXISTS (SELECT 1 FROM often p WHERE p.conv_id = o.conv_id AND p.turn = o.turn - 2)
    UNION ALL SELECT o.conv_id, o.turn, c.level + 1 FROM c JOIN often o ON o.conv_id = c.conv_id AND o.turn = c.turn + 2)
  SELECT * FROM c),
wrong AS (
  SELECT a.*, concat_ws('; ',
    CASE WHEN name = 'answer' AND (turn < 0 OR turn > 6) THEN 'turn: out of range' END,
    CASE WHEN name = 'answer' AND words < 1 OR name = 'note' AND (words < 1 OR words > 30) THEN 'words: out of range' END) AS problems
  FROM asked a)
SELECT w.conv_id, w.call_id, w.name, CAST(c.level AS BIGINT) AS level,
       CASE WHEN o.n > 1 THEN 'duplicate' WHEN problems <> '' THEN 'invalid' WHEN c.level IS NULL THEN 'unordered' WHEN coalesce(n_results, 0) = 0 THEN 'unanswered' WHEN n_results > 1 THEN 'ambiguous' ELSE 'ok' END AS status,
       problems, CAST(coalesce(n_results, 0) AS BIGINT) AS n_results,
       '{"arguments":{"digest":"' || digest || '","turn":' || w.turn || ',"words":' || words || '},"id":"' || call_id || '","name":"' || name || '","result":' || coalesce('"' || result || '"', 'null') || '}' AS record
FROM wrong w JOIN often o USING (conv_id, turn) LEFT JOIN chain c USING (conv_id, turn) LEFT JOIN answer r ON r.conv_id = w.conv_id AND r.turn = w.turn
"""


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a response, at ten times its page_id, and three revisits of it: then, a little later, and at the end."""
    scratch, pages = Scratch(spark, "revisits"), read_table(spark, sf_dir, "pages")
    digest = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    base = pages.select("page_id", "url", digest.alias("digest"), F.char_length(F.coalesce("html", F.lit(""))).cast("string").alias("size"))
    tag = F.concat(F.lit('W/"'), "digest", F.lit('"'))
    when = F.expr("array(named_struct('k', 0, 'add', 0L), named_struct('k', 1, 'add', 0L), named_struct('k', 2, 'add', 5L), named_struct('k', 3, 'add', 1000000000000L))")
    each = base.withColumn("w", F.explode(when))
    full = F.col("w.k") == 0
    headers = F.when(full, F.create_map(F.lit("Content-Length"), "size", F.lit("ETag"), tag, F.lit("Date"), F.lit("0"))).otherwise(
        F.create_map(F.lit("Date"), F.col("w.k").cast("string"), F.lit("Server"), F.lit("other"))
    )
    records = each.select(
        (F.col("page_id") * 4 + F.col("w.k")).alias("record"), "url", (F.col("page_id") * 10 + F.col("w.add")).alias("ts"), F.when(full, "response").otherwise("revisit").alias("kind"),
        F.when(full, tag).otherwise(F.concat(F.lit('"'), "digest", F.lit('"'))).alias("etag"), F.lit(None).cast("string").alias("modified"), "digest", headers.alias("headers"),
    )
    out = revisits.resolve(records, scratch)
    line = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return out.withColumn("headers", line)


OP7_SQL = r"""
WITH base AS (
  SELECT page_id, md5(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS size,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM pages),
cut AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) AS kept
  FROM base),
keyed AS (SELECT page_id, digest, size, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS key FROM cut),
response AS (SELECT page_id * 4 AS record, page_id * 10 AS ts, key, digest, size FROM keyed),
revisit AS (SELECT page_id * 4 + k AS record, page_id * 10 + add AS ts, key, digest, k FROM keyed, (VALUES (1, 0), (2, 5), (3, 1000000000000)) v(k, add)),
found AS (
  SELECT v.record, v.key, v.ts, v.digest AS own, v.k, r.record AS source, r.digest, r.size,
         row_number() OVER (PARTITION BY v.record ORDER BY r.ts DESC, r.record DESC) AS n
  FROM revisit v LEFT JOIN response r ON r.key = v.key AND r.ts < v.ts)
SELECT record, key, ts, source, CASE WHEN source IS NULL THEN 'missing' WHEN own = digest THEN 'resolved' ELSE 'changed' END AS status,
       CASE WHEN own = digest THEN digest END AS digest,
       CASE WHEN own = digest THEN 'content-length: ' || size || chr(10) || 'date: ' || k || chr(10) || 'etag: W/"' || digest || '"' END AS headers
FROM found WHERE n = 1
"""


def op8_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tree_score.extract_pages(read_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "near-dup")
    rows = near_dup.near_duplicates(read_table(spark, sf_dir, "documents"), scratch, percent=85)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_brown": op1_brown,
        "op2_toxicity": op2_toxicity,
        "op3_token_frames": op3_token_frames,
        "op4_decontaminate": op4_decontaminate,
        "op5_grid_join": op5_grid_join,
        "op6_tool_calls": op6_tool_calls,
        "op7_revisits": op7_revisits,
        "op8_tree_score": op8_tree_score,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_near_dup": op10_near_dup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontaminate": OP4_SQL,
        "op6_tool_calls": OP6_SQL,
        "op7_revisits": OP7_SQL,
    }
