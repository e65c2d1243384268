"""Queries over the driver's tables, one or more for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import mcq, papers, text
from .operators import crawl, dedup, joins, metrics, parse, sampling, windows
from .registry import query, table
from .sources.scratch import saver

# -- views: documents and labels as predictions, parts as questions

PREDS = """(SELECT d.doc_id AS id, source AS subject, lang AS category, quality AS answer, CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE toxic END AS pred,
  coalesce(CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE toxic END = quality, false) AS correct FROM documents d JOIN labels l USING (doc_id))"""
MCQ = """(SELECT p_partkey AS id, p_brand AS subject, split_part(p_type, ' ', 1) AS category, p_name AS question,
  [p_brand, p_type, 'size ' || p_size, 'price ' || CAST(floor(p_retailprice) AS BIGINT), p_name] AS choices, 1 + CAST(p_partkey % 5 AS INTEGER) AS answer, 6 + p_size % 8 AS grade FROM part)"""


def preds(spark: SparkSession, d: str) -> DataFrame:
    pred = F.when(F.col("doc_id") % 17 != 0, F.col("toxic"))
    rows = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id")
    return rows.select(F.col("doc_id").alias("id"), F.col("source").alias("subject"), F.col("lang").alias("category"), F.col("quality").alias("answer"), pred.alias("pred"), F.coalesce(pred == F.col("quality"), F.lit(False)).alias("correct"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    choices = F.array("p_brand", "p_type", F.concat(F.lit("size "), F.col("p_size").cast("string")), F.concat(F.lit("price "), F.floor("p_retailprice").cast("bigint").cast("string")), "p_name")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("subject"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("category"), F.col("p_name").alias("question"),
        choices.alias("choices"), (F.col("p_partkey") % 5 + 1).cast("int").alias("answer"), (F.col("p_size") % 8 + 6).alias("grade"),
    )


# -- metrics


@query(f"SELECT subject, count(*) AS n, round_even(avg(CAST(CAST(correct AS INTEGER) AS DOUBLE)), 4) AS accuracy FROM {PREDS} WHERE subject IS NOT NULL GROUP BY subject")
def accuracy_by_group(spark, d):
    return metrics.accuracy_by(preds(spark, d), "subject")


@query(f"SELECT count(*) AS n, round_even(avg(CAST(CAST(correct AS INTEGER) AS DOUBLE)), 4) AS accuracy, round_even(avg(CAST(CAST(pred IS NULL AS INTEGER) AS DOUBLE)), 4) AS unparsed_rate FROM {PREDS}")
def accuracy_overall(spark, d):
    return metrics.overall(preds(spark, d))


@query(f"""SELECT CASE WHEN grouping(subject) = 0 THEN 'subject' WHEN grouping(category) = 0 THEN 'category' ELSE 'all' END AS level, subject, category, count(*) AS n,
  round_even(avg(CAST(CAST(correct AS INTEGER) AS DOUBLE)), 4) AS accuracy FROM {PREDS} GROUP BY GROUPING SETS ((subject), (category), ())""")
def accuracy_grouping_sets(spark, d):
    return metrics.accuracy_sets(preds(spark, d))


@query(f"""WITH a AS (SELECT subject, avg(CAST(CAST(correct AS INTEGER) AS DOUBLE)) AS v FROM {PREDS} WHERE answer = 1 GROUP BY subject),
  b AS (SELECT subject, avg(CAST(CAST(correct AS INTEGER) AS DOUBLE)) AS v FROM {PREDS} WHERE answer = 0 GROUP BY subject)
  SELECT coalesce(a.subject, b.subject) AS subject, round_even(a.v, 4) AS good, round_even(b.v, 4) AS poor FROM a FULL JOIN b ON a.subject = b.subject""")
def accuracy_side_by_side(spark, d):
    p = preds(spark, d)
    return metrics.side_by_side({"good": metrics.accuracy_by(p.filter("answer = 1"), "subject"), "poor": metrics.accuracy_by(p.filter("answer = 0"), "subject")}, "subject")


@query(f"""WITH a AS (SELECT category, avg(CAST(CAST(correct AS INTEGER) AS DOUBLE)) AS before FROM {PREDS} WHERE answer = 0 GROUP BY category),
  b AS (SELECT category, avg(CAST(CAST(correct AS INTEGER) AS DOUBLE)) AS after FROM {PREDS} GROUP BY category)
  SELECT coalesce(a.category, b.category) AS category, before, after, after - before AS gain FROM a FULL JOIN b ON a.category = b.category""")
def accuracy_gain(spark, d):
    p = preds(spark, d)
    return metrics.accuracy_gain(p.filter("answer = 0"), p, "category")


@query(f"""WITH c AS (SELECT answer, count(*) AS n FROM {MCQ} GROUP BY answer), t AS (SELECT sum(n) AS total FROM c)
  SELECT CAST(r.a AS INTEGER) AS answer, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(n, 0) / (SELECT total FROM t) AS share FROM range(1, 7) r(a) LEFT JOIN c ON c.answer = r.a""")
def answer_distribution_dense(spark, d):
    return metrics.answer_distribution(questions(spark, d), "answer", 6)


@query(f"""WITH c AS (SELECT answer, count(*) AS n FROM {MCQ} GROUP BY answer)
  SELECT answer, n / (SELECT sum(n) FROM c) AS share FROM c ORDER BY n DESC, answer LIMIT 1""")
def majority_baseline(spark, d):
    return metrics.majority(metrics.answer_distribution(questions(spark, d), "answer", 6))


@query("SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def value_counts(spark, d):
    return metrics.value_counts(table(spark, d, "documents"), "source")


@query(f"SELECT subject, count(*) AS n, arg_min(category, id) AS category FROM {MCQ} GROUP BY subject")
def counts_with_first(spark, d):
    return metrics.counts_with_first(questions(spark, d), "subject", "category", "id")


@query("""SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es,
  count(*) FILTER (lang IN ('en', 'de', 'fr', 'es')) AS total FROM documents WHERE source IS NOT NULL GROUP BY source""")
def split_crosstab(spark, d):
    return metrics.crosstab(table(spark, d, "documents"), "source", "lang", ["en", "de", "fr", "es"])


@query("""SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS score FROM orders GROUP BY ALL ORDER BY score DESC, o_orderpriority, o_orderstatus LIMIT 1""")
def trial_argmax(spark, d):
    trials = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("score"))
    return metrics.best_trial(trials, "score", "o_orderpriority", "o_orderstatus")


@query("SELECT count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs FROM documents")
def distinct_counts(spark, d):
    return table(spark, d, "documents").agg(F.count_distinct("source").alias("n_sources"), F.count_distinct("lang").alias("n_langs"))


# -- joins and sets


@query(f"SELECT p.id, p.subject, p.answer, p.pred, d.n_chars FROM {PREDS} p JOIN documents d ON d.doc_id = p.id WHERE NOT p.correct")
def wrong_answers_join(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return joins.wrong_answers(preds(spark, d).select("id", "subject", "answer", "pred", "correct"), docs, "n_chars").drop("correct")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def eval_todo(spark, d):
    return joins.todo(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, quality FROM labels l WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')")
def eval_restrict(spark, d):
    return joins.restrict(table(spark, d, "labels").select("doc_id", "quality"), table(spark, d, "documents").filter("lang = 'en'"), "doc_id")


@query(f"SELECT id, pred IS NULL AS unparsed FROM {PREDS} WHERE pred IS NULL ORDER BY id LIMIT 20")
def unparsed_head(spark, d):
    return preds(spark, d).filter("pred is null").select("id", F.col("pred").isNull().alias("unparsed")).orderBy("id").limit(20)


@query("""WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN replace(p_type, ' ', '_') WHEN p_partkey % 7 = 0 THEN lower(p_type) ELSE p_type END AS form FROM part),
  k AS (SELECT *, lower(trim(replace(form, '_', ' '))) AS key FROM v),
  c AS (SELECT key, form, count(*) AS n, min(p_partkey) AS f FROM k GROUP BY ALL),
  b AS (SELECT key, form AS best, row_number() OVER (PARTITION BY key ORDER BY n DESC, f) AS r FROM c)
  SELECT p_partkey, best AS form FROM k JOIN b USING (key) WHERE r = 1""")
def subject_canonical_mode(spark, d):
    form = F.when(F.col("p_partkey") % 3 == 0, F.translate("p_type", " ", "_")).when(F.col("p_partkey") % 7 == 0, F.lower("p_type")).otherwise(F.col("p_type"))
    return joins.canonical_by_mode(table(spark, d, "part").select("p_partkey", form.alias("form")), "form", "p_partkey")


@query("SELECT path, duplicate_of FROM (SELECT doc_id AS path, min(doc_id) OVER (PARTITION BY sha256(text)) AS duplicate_of FROM documents) WHERE path <> duplicate_of")
def content_hash_dup(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return joins.same_content(files)


@query("""WITH l AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r, min(event_id) OVER (PARTITION BY user_id) AS first FROM events)
  SELECT user_id, event_id, event_type, value, first FROM l WHERE r = 1""")
def upsert_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return joins.upsert(e.filter("event_type = 'view'"), e.filter("event_type <> 'view'"), "user_id", "event_id")


@query("""WITH q AS (SELECT l_orderkey AS paper, l_suppkey % 50 AS page, l_linenumber AS q_no FROM lineitem GROUP BY ALL), asked AS (SELECT paper, page, count(DISTINCT q_no) AS n FROM q GROUP BY ALL),
  key AS (SELECT p_partkey AS key_id, p_partkey % 50 AS page, i AS q_no, 1 + (p_partkey + i) % 4 AS answer FROM part, range(1, 4) r(i)),
  c AS (SELECT q.paper, q.page, key_id, count(DISTINCT q.q_no) AS c FROM q JOIN key USING (page, q_no) GROUP BY ALL),
  f AS (SELECT paper, min(key_id) AS key_id FROM c JOIN asked USING (paper, page) WHERE c.c >= 0.9 * n GROUP BY paper)
  SELECT q.paper, q.page AS source_page, q.q_no, f.key_id, CAST(k.answer AS BIGINT) AS answer FROM q LEFT JOIN f ON f.paper = q.paper LEFT JOIN key k ON k.key_id = f.key_id AND k.q_no = q.q_no WHERE (SELECT count(*) FROM asked a WHERE a.paper = q.paper) = 1""")
def match_answer_keys(spark, d):
    q = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper"), (F.col("l_suppkey") % 50).alias("source_page"), F.col("l_linenumber").cast("long").alias("q_no")).distinct()
    one = q.groupBy("paper").agg(F.count_distinct("source_page").alias("n")).filter("n = 1").select("paper")
    q = q.join(one, "paper", "left_semi").select("*", F.lit(4).alias("n_options"), F.lit(None).cast("long").alias("answer"))
    keys = table(spark, d, "part").select(F.col("p_partkey").alias("key_id"), (F.col("p_partkey") % 50).alias("source_page"), F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])).alias("q_no"))
    keys = keys.withColumn("answer", (F.col("key_id") + F.col("q_no")) % 4 + 1)
    return joins.match_keys(q, keys).select("paper", "source_page", "q_no", "key_id", "answer")


# -- exact duplicates


@query(r"""WITH k AS (SELECT doc_id, source, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS key FROM documents)
  SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM k GROUP BY key""")
def exact_dedup_keep_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", text.compare_key(F.col("text"), False).alias("key"))
    return dedup.keep_first(docs, F.col("key"), F.col("doc_id")).select("doc_id", "source")


@query(r"""WITH k AS (SELECT doc_id, array_to_string(list_sort(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g'))), '|') AS key FROM documents)
  SELECT min(doc_id) AS doc_id FROM k GROUP BY key""")
def bag_dedup_keep_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", mcq.bag_key(F.lit(""), F.split("text", "\n")).alias("key"))
    return dedup.keep_first(docs, F.col("key"), F.col("doc_id")).select("doc_id")


@query("""SELECT doc_id, CASE WHEN n > 1 THEN id || '#' || n ELSE id END AS id FROM (
  SELECT doc_id, md5(text) AS id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents)""")
def dedup_unique_ids(spark, d):
    return dedup.unique_ids(table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("id")), "id", F.col("doc_id"), saver(spark, "ids"))


# -- near-duplicates of a test set

_GRAMS = r"""docs AS (SELECT doc_id AS row, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', '', 'g') AS q, string_split(text, chr(10)) AS c FROM documents),
  devs AS (SELECT item_id AS dev_id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', '', 'g') AS q, string_split(text, chr(10)) AS c FROM benchmark),
  pg AS (SELECT row, CASE WHEN length(q) < 4 THEN [q] ELSE list_distinct([q[i:i + 3] for i in range(1, length(q) - 2)]) END AS g, c FROM docs),
  dg AS (SELECT dev_id, CASE WHEN length(q) < 4 THEN [q] ELSE list_distinct([q[i:i + 3] for i in range(1, length(q) - 2)]) END AS g, c FROM devs),
  hits AS (SELECT row, dev_id, count(*) AS hits FROM (SELECT row, unnest(g) AS gram FROM pg) JOIN (SELECT dev_id, unnest(g) AS gram FROM dg) USING (gram) GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY hits DESC, dev_id) AS rank FROM hits)""".replace("{{", "{").replace("}}", "}")


def _as_questions(spark, d):
    """Whole texts as questions that have their lines as options, so the question has all grams of the row."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("row"), F.col("text").alias("question"), F.split("text", "\n").alias("choices"))
    devs = table(spark, d, "benchmark").select(F.col("item_id").alias("dev_id"), F.col("text").alias("question"), F.split("text", "\n").alias("choices"))
    grams = lambda df: dedup.question_grams(df, False).withColumns({"ak": F.col("qk"), "sa": F.col("sq")})
    return grams(docs), grams(devs)


@query(f"WITH {_GRAMS} SELECT row, dev_id, hits, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 8")
def near_dup_candidates(spark, d):
    a, b = _as_questions(spark, d)
    return dedup.shared_grams(a, b, "row", "dev_id")


@query(rf"""WITH {_GRAMS},
  opt AS (SELECT row, list_distinct(list_transform(c, lambda x: regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', '', 'g'))) AS o, g FROM pg),
  dopt AS (SELECT dev_id, list_distinct(list_transform(c, lambda x: regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', '', 'g'))) AS o, g FROM dg),
  m AS (SELECT r.row, r.dev_id, rank, hits, len(p.g) AS a, len(q.g) AS b, len(list_intersect(p.o, q.o)) AS same FROM ranked r JOIN opt p USING (row) JOIN dopt q USING (dev_id) WHERE rank <= 8),
  w AS (SELECT row, dev_id, rank, CASE WHEN hits / (a + b - hits) >= 0.1 THEN 'near' WHEN hits / (a + b - hits) >= 0.8 AND same >= 1 THEN 'same' WHEN hits / least(a, b) >= 0.8 AND a >= 15 AND same >= 2 THEN 'inside' END AS kind FROM m)
  SELECT row, arg_min(dev_id, rank) AS dev_id, arg_min(kind, rank) AS kind FROM w WHERE kind IS NOT NULL GROUP BY row""")
def decontaminate_benchmark(spark, d):
    a, b = _as_questions(spark, d)
    found = dedup.test_overlap(a, b, "row", "dev_id", near=0.1)
    return found.select("row", "dev_id", F.when(F.startswith("reason", F.lit("near")), "near").when(F.startswith("reason", F.lit("same")), "same").otherwise("inside").alias("kind"))


# -- questions


@query(f"""WITH q AS (SELECT * FROM {MCQ}), p AS (SELECT *, CASE md5(question)[32:32] WHEN 'a' THEN 10 WHEN 'b' THEN 11 WHEN 'c' THEN 12 WHEN 'd' THEN 13 WHEN 'e' THEN 14 WHEN 'f' THEN 15 ELSE CAST(md5(question)[32:32] AS INTEGER) END % 4 AS pick FROM q),
  w AS (SELECT *, pick + CASE WHEN pick >= answer - 1 THEN 1 ELSE 0 END AS gone FROM p)
  SELECT id, array_to_string(list_filter(choices, lambda c, i: i <> gone + 1), '|') AS choices, answer - CASE WHEN gone < answer - 1 THEN 1 ELSE 0 END AS answer FROM w""")
def to_four_options(spark, d):
    c, a = mcq.to_four(F.col("question"), F.col("choices"), F.col("answer"))
    return questions(spark, d).select("id", F.array_join(c, "|").alias("choices"), a.alias("answer"))


@query(f"""WITH q AS (SELECT *, CASE id % 4 WHEN 0 THEN CAST(answer AS VARCHAR) WHEN 1 THEN ' ' || choices[answer] || ' ' WHEN 2 THEN '9' ELSE 'none of it' END AS said FROM {MCQ})
  SELECT id, CASE WHEN regexp_full_match(trim(said), '-?[0-9]{{1,9}}') AND CAST(regexp_extract(trim(said), '^-?[0-9]{{1,9}}$') AS VARCHAR) <> '' AND TRY_CAST(trim(said) AS INTEGER) BETWEEN 1 AND 5 THEN TRY_CAST(trim(said) AS INTEGER)
    ELSE nullif(coalesce(list_position(list_transform(choices, lambda c: trim(c)), trim(said)), 0), 0) END AS answer FROM q""")
def answer_repair(spark, d):
    said = F.when(F.col("id") % 4 == 0, F.col("answer").cast("string")).when(F.col("id") % 4 == 1, F.concat(F.lit(" "), F.get("choices", F.col("answer") - 1), F.lit(" "))).when(F.col("id") % 4 == 2, "9").otherwise("none of it")
    return questions(spark, d).select("id", mcq.repair_answer(said, F.col("choices")).alias("answer"))


@query(r"""SELECT conv_id, turn, TRY_CAST(nullif(regexp_extract(translate(text, 'thersn', '123456'), '(^|[^0-9])([1-4])([^0-9]|$)', 2), '') AS INTEGER) AS answer FROM conversations""")
def parse_answer_digits(spark, d):
    none = F.array(*[F.lit("\x00") for _ in range(4)])  # four options of which no text has any
    return table(spark, d, "conversations").select("conv_id", "turn", mcq.parse_answer(F.translate("text", "thersn", "123456"), none).alias("answer"))


@query(f"""SELECT id, 'Question: ' || trim(regexp_replace(question, '[ \\t]+', ' ', 'g')) || chr(10) || chr(10) || array_to_string(list_transform(choices, lambda c, i: i || '. ' || trim(regexp_replace(c, '[ \\t]+', ' ', 'g'))), chr(10)) || chr(10) || chr(10) || 'Answer:' AS prompt FROM {MCQ}""")
def format_prompt(spark, d):
    return questions(spark, d).select("id", mcq.format_question(F.col("question"), F.col("choices"), "en", False).alias("prompt"))


@query("""SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) AS VARCHAR) AS best FROM embeddings""")
def option_argmax(spark, d):
    return table(spark, d, "embeddings").select("vec_id", mcq.option_argmax(F.col("embedding")).alias("best"))


@query("""WITH t AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM conversations), m AS (SELECT *, list_concat(list_transform(ids[1:2], lambda x: -100), ids[3:]) AS labels FROM t),
  w AS (SELECT conv_id, max(len(ids)) AS width FROM t GROUP BY conv_id)
  SELECT conv_id, turn, array_to_string(labels, ',') AS labels, array_to_string(list_concat(list_transform(range(width - len(ids)), lambda x: 0), ids), ',') AS padded FROM m JOIN w USING (conv_id)""")
def mask_and_pad(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.transform(F.split("text", " "), lambda w: F.char_length(w)).alias("ids"))
    width = t.groupBy("conv_id").agg(F.max(F.size("ids")).alias("width"))
    text_of = lambda c: F.array_join(c.cast("array<string>"), ",")
    t = t.join(width, "conv_id")
    return t.select("conv_id", "turn", text_of(mcq.mask_labels(F.slice("ids", 1, 2), F.col("ids"))).alias("labels"), text_of(mcq.left_pad(F.col("ids"), F.col("width"), 0)).alias("padded"))


# -- sampling

@query("SELECT doc_id FROM documents ORDER BY md5('42-' || doc_id), doc_id LIMIT 50")
def sample_documents(spark, d):
    return sampling.sample_n(table(spark, d, "documents").select("doc_id"), 50, "doc_id")


@query("""WITH r AS (SELECT doc_id, source, count(*) OVER w AS n, row_number() OVER (PARTITION BY source ORDER BY md5('42-' || doc_id), doc_id) AS r FROM documents WINDOW w AS (PARTITION BY source)),
  b AS (SELECT *, n * 700 // 1000 AS b0, n * 150 // 1000 AS b1, n * 700 % 1000 AS r0, n * 150 % 1000 AS r1 FROM r),
  l AS (SELECT *, n - b0 - b1 - b1 AS l FROM b),
  s AS (SELECT *, b0 + CASE WHEN (CASE WHEN r1 > r0 THEN 2 ELSE 0 END) < l THEN 1 ELSE 0 END AS s0, b1 + CASE WHEN (CASE WHEN r0 >= r1 THEN 1 ELSE 0 END) < l THEN 1 ELSE 0 END AS s1 FROM l)
  SELECT doc_id, source, CASE WHEN r <= s0 THEN 'train' WHEN r <= s0 + s1 THEN 'val' ELSE 'test' END AS split FROM s""")
def stratified_split(spark, d):
    return sampling.stratified_split(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")


@query("""WITH r AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY md5('42-' || doc_id), doc_id) AS r FROM documents)
  SELECT doc_id, source, r <= CASE WHEN n >= 20 THEN greatest(1, CAST(round_even(CAST(n AS DOUBLE) * CAST(0.05 AS DOUBLE), 0) AS INTEGER)) ELSE 0 END AS val FROM r""")
def val_slice(spark, d):
    return sampling.validation_slice(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")


@query("""WITH f AS (SELECT doc_id, CAST(1 AS DOUBLE) * CASE WHEN quality = 1 THEN CAST(1.5 AS DOUBLE) ELSE 1 END * CASE WHEN toxic = 1 THEN CAST(0.25 AS DOUBLE) ELSE 1 END AS f FROM labels),
  n AS (SELECT *, CAST(floor(f) AS INTEGER) + CASE WHEN CAST(('0x' || md5('42-' || doc_id)[1:8]) AS BIGINT) / CAST(4294967296 AS DOUBLE) < f - floor(f) THEN 1 ELSE 0 END AS n FROM f)
  SELECT CASE WHEN k = 0 THEN CAST(doc_id AS VARCHAR) ELSE doc_id || '#rep' || k END AS doc_id FROM (SELECT doc_id, unnest(range(n)) AS k FROM n)""")
def oversample_weighted(spark, d):
    factor = F.when(F.col("quality") == 1, 1.5).otherwise(1.0) * F.when(F.col("toxic") == 1, 0.25).otherwise(1.0)
    rows = table(spark, d, "labels").withColumn("f", factor)
    out = sampling.oversample(rows.withColumn("doc_id", F.col("doc_id").cast("string")), F.col("f"), "doc_id")
    return out.select("doc_id")


@query(f"""WITH q AS (SELECT id, choices, answer, unnest(range(2)) AS c FROM {MCQ}), e AS (SELECT *, list_sort(list_transform(range(5), lambda i: md5('42-' || id || '-' || c || '-' || i) || i)) AS keyed FROM q),
  o AS (SELECT *, list_transform(keyed, lambda s: CAST(s[33:33] AS INTEGER)) AS o FROM e)
  SELECT id || '#shuf' || c AS id, array_to_string(list_transform(o, lambda i: choices[i + 1]), '|') AS choices, CAST(list_position(o, answer - 1) AS INTEGER) AS answer FROM o
  UNION ALL SELECT CAST(id AS VARCHAR), array_to_string(choices, '|'), answer FROM {MCQ}""")
def option_shuffle(spark, d):
    q = questions(spark, d).select("id", "choices", "answer")
    return sampling.option_shuffles(q, 2).select("id", F.array_join("choices", "|").alias("choices"), "answer")


@query("""WITH ring AS (SELECT source, doc_id AS shot, row_number() OVER (PARTITION BY source ORDER BY md5('42-' || doc_id), doc_id) - 1 AS at FROM documents WHERE lang = 'en'), size AS (SELECT source, count(*) AS size FROM ring GROUP BY source),
  want AS (SELECT d.doc_id, d.source, size, CAST(floor(CAST(('0x' || md5('42-' || d.doc_id)[1:8]) AS BIGINT) / CAST(4294967296 AS DOUBLE) * size) AS BIGINT) AS start FROM documents d JOIN size USING (source) WHERE lang <> 'en'),
  each AS (SELECT *, unnest(range(least(3, size))) AS j FROM want)
  SELECT e.doc_id, string_agg(CAST(shot AS VARCHAR), ',' ORDER BY j) AS shots FROM each e JOIN ring r ON r.source = e.source AND r.at = (e.start + e.j) % e.size GROUP BY e.doc_id
  UNION ALL SELECT doc_id, '' FROM documents WHERE lang <> 'en' AND source NOT IN (SELECT source FROM size)""")
def few_shot_topk(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("subject"), "lang")
    pool = docs.filter("lang = 'en'").withColumn("answer", F.col("doc_id")).withColumn("prompt", F.lit(""))
    out = sampling.few_shots(docs.filter("lang <> 'en'"), pool, 3, "doc_id")
    return out.select("doc_id", F.array_join(F.transform("shots", lambda s: s["answer"].cast("string")), ",").alias("shots"))


# -- text


@query("""SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') AS key FROM documents""")
def compare_key(spark, d):
    return table(spark, d, "documents").select("doc_id", text.compare_key(F.col("text"), False).alias("key"))


@query("""SELECT doc_id, trim(regexp_replace(replace(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), '•', ' '), ' +', ' ', 'g'), ' ,;') AS line FROM documents""")
def normalize_line(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_line(F.col("text"), False).alias("line"))


_ENGLISH = ", ".join(f"'{w}'" for w in text.ENGLISH_WORDS)
_FEATURES = f"""SELECT doc_id, n_chars, regexp_extract_all(lower(text), '[a-z]{{2,}}') AS w2, regexp_extract_all(lower(text), '[a-z]+') AS w1 FROM documents"""


@query(f"""SELECT doc_id, CAST(len(w2) AS INTEGER) AS nwords, len(list_filter(w2, lambda w: w IN ({_ENGLISH}))) / greatest(len(w2), 1) AS eng FROM ({_FEATURES})""")
def text_quality_features(spark, d):
    f = text.precheck_features(F.col("text"))
    return table(spark, d, "documents").select("doc_id", f["nwords"].alias("nwords"), f["eng"].alias("eng"))


@query(f"""SELECT doc_id, CASE WHEN len(list_filter(w1, lambda w: w IN ({_ENGLISH}))) / greatest(len(w1), 1) > 0.08 AND len(list_filter(w1, lambda w: w IN ({_ENGLISH}))) > 30 THEN 'english_medium' ELSE 'needs_ocr' END AS class FROM ({_FEATURES})""")
def classify_document(spark, d):
    return table(spark, d, "documents").select("doc_id", text.classify_document(F.col("text")).alias("class"))


@query(f"""WITH f AS (SELECT doc_id, n_chars % 7 AS pages, n_chars % 9 AS fonts, len(w2) AS nwords, len(list_filter(w2, lambda w: w IN ({_ENGLISH}))) / greatest(len(w2), 1) AS eng FROM ({_FEATURES}))
  SELECT doc_id, pages > 3 AND fonts > 0 AND NOT (nwords > 200 AND eng > 0.08) AND nwords >= 300 AND eng < 0.03 AND fonts >= 6 AS keep,
    CASE WHEN fonts = 0 THEN 'scanned (no text on the first pages)' WHEN nwords > 200 AND eng > 0.08 THEN 'English medium' WHEN pages <= 3 THEN 'short file without MCQs'
      WHEN nwords >= 300 AND eng < 0.03 AND fonts >= 6 THEN 'legacy-font Sinhala text' ELSE 'no readable Sinhala text' END AS reason FROM f""")
def precheck_decide(spark, d):
    docs = table(spark, d, "documents").withColumns({k: c for k, c in text.precheck_features(F.col("text")).items()})
    verdict = text.precheck_decide(F.col("n_chars") % 7, F.col("n_chars") % 9, F.col("sinhala"), F.col("nwords"), F.col("eng"), F.col("broken"), F.lit(0))
    return docs.select("doc_id", verdict.alias("v")).select("doc_id", "v.keep", "v.reason")


# -- URLs and pages


@query("""SELECT page_id, lower(rtrim(replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', '') || regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/')) AS key,
  regexp_replace(url, '[?#].*$', '') AS page, regexp_replace(url, '#.*$', '') AS bare FROM pages""")
def normalize_url(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", text.source_key(u).alias("key"), text.page_url(u).alias("page"), text.without_fragment(u).alias("bare"))


@query("""SELECT page_id, lower(url_decode(string_split(rtrim(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/'), '/')[-1])) AS slug FROM pages""")
def last_slug(spark, d):
    return table(spark, d, "pages").select("page_id", text.last_slug(F.col("url")).alias("slug"))


_SLUG = "replace(lower(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^A-Za-z0-9]+', '-', 'g')), 'th', 'grade-7-2nd-term-2021-')"


def _slug(spark, d):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, d, "pages").select("page_id", F.replace(F.lower(F.regexp_replace(title, "[^A-Za-z0-9]+", "-")), F.lit("th"), F.lit("grade-7-2nd-term-2021-")).alias("slug"))


@query("""WITH n AS (SELECT DISTINCT unnest(string_split(lower(regexp_replace(p_type, '[^A-Za-z]+', '-', 'g')), '-')) AS name FROM part UNION SELECT DISTINCT lower(replace(p_type, ' ', '-')) FROM part),
  s AS (SELECT p_partkey, 'old-' || lower(replace(p_type, ' ', '-')) || '-paper' AS slug FROM part),
  m AS (SELECT p_partkey, name, row_number() OVER (PARTITION BY p_partkey ORDER BY length(name) DESC, name) AS r FROM s JOIN n ON contains('-' || slug || '-', '-' || name || '-'))
  SELECT p_partkey, name AS site_name FROM m WHERE r = 1""")
def longest_dictionary_match(spark, d):
    p = table(spark, d, "part")
    names = p.select(F.explode(F.split(F.lower(F.regexp_replace("p_type", "[^A-Za-z]+", "-")), "-")).alias("name")).union(p.select(F.lower(F.translate("p_type", " ", "-")))).distinct()
    s = p.select("p_partkey", F.concat(F.lit("old-"), F.lower(F.translate("p_type", " ", "-")), F.lit("-paper")).alias("slug"))
    return joins.longest_match(s, F.col("slug"), names).select("p_partkey", "site_name")


@query("""SELECT url, CAST(i - 1 AS INTEGER) AS pos, l[i] AS href FROM (SELECT url, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages))""")
def extract_links(spark, d):
    return crawl.extract_links(table(spark, d, "pages")).select("url", "pos", "href")


def _graph(spark, d):
    """Customers as pages: each links to those whose numbers are twice and thrice its own."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    n = c.count()
    return c.select(F.col("k").alias("url"), F.explode(F.array(F.col("k") * 2, F.col("k") * 3)).alias("link")).filter(F.col("link") <= n)


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS url, c_custkey * m AS link FROM customer, (VALUES (2), (3)) v(m) WHERE c_custkey * m <= (SELECT count(*) FROM customer)),
  w AS (SELECT CAST(1 AS BIGINT) AS url, 0 AS depth UNION SELECT e.link, depth + 1 FROM w JOIN e USING (url))
  SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY url""")
def crawl_fixpoint(spark, d):
    return crawl.crawl_fixpoint(_graph(spark, d), spark.range(1, 2).withColumnRenamed("id", "url"), saver(spark, "crawl"))


# -- windows


@query("""WITH g AS (SELECT user_id, event_id, epoch(ts) AS s, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w <= 86400 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch(ts), event_id))
  SELECT user_id, event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM g""")
def cluster_by_gap(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return windows.cluster_by_gap(e.withColumn("s", F.col("us") / 1e6), ["user_id"], "s", 86400, "event_id").select("user_id", "event_id", "cluster")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber - lag(l_linenumber) OVER w = 1 THEN 0 ELSE 1 END AS new, row_number() OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
  c AS (SELECT l_orderkey, l_linenumber, sum(new) OVER (PARTITION BY l_orderkey ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM r)
  SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS length FROM c GROUP BY l_orderkey, run HAVING count(*) >= 5""")
def consecutive_runs(spark, d):
    return windows.consecutive_runs(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber"], "l_linenumber")


@query("""WITH c AS (SELECT user_id, event_id, event_type = 'view' AS ok, sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cut FROM events),
  r AS (SELECT user_id, cut, count(*) AS length, min(event_id) AS start FROM c WHERE ok GROUP BY ALL),
  b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start) AS n FROM r) SELECT user_id, start, length FROM b WHERE n = 1""")
def longest_block(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "view").alias("ok"))
    return windows.longest_block(e, ["user_id"], "event_id", "ok")


# -- papers


def paper_lines(spark, d):
    """Forty parts to a paper: a line with number and name, two with options, and at its end a key of four pairs a line."""
    q = questions(spark, d).select(F.floor(F.col("id") / 40).alias("paper"), (F.col("id") % 40 + 1).alias("n"), "id", "question", "choices")
    option = lambda i: F.concat(F.lit(f"({i}) "), F.get("choices", F.lit(i - 1)))
    number = F.lpad(F.col("n").cast("string"), 2, "0")
    body = q.select("paper", (F.col("n") * 10).alias("at"), F.posexplode(F.array(
        F.concat(number, F.lit(". which "), "question"), F.concat_ws("  ", option(1), option(2)), F.concat_ws("  ", option(3), option(4))
    )).alias("k", "text"))
    key = q.select("paper", (1000 + F.floor((F.col("n") - 1) / 4)).alias("at"), "n", F.concat(number, F.lit(") "), (F.col("id") % 4 + 1).cast("string")).alias("pair"))
    key = key.groupBy("paper", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "pair"))), lambda s: s["pair"]), "  ").alias("text"))
    heading = q.select("paper").distinct().select("paper", F.lit(999).cast("long").alias("at"), F.lit(0).alias("k"), F.lit("Marking scheme").alias("text"))
    lines = body.unionByName(key.withColumn("k", F.lit(0)).select("paper", "at", "k", "text")).unionByName(heading)
    box = [F.lit(float(x)).alias(n) for n, x in (("x0", 50), ("y0", 100), ("x1", 400), ("y1", 110))]
    return lines.select(F.concat(F.lit("paper-"), F.col("paper").cast("string")).alias("paper_id"), (F.col("at") * 10 + F.col("k")).cast("int").alias("line_no"), "text", F.lit(0).alias("page"), *box)


@query(f"""SELECT 'paper-' || id // 40 AS paper_id, 'question' AS kind, CAST(id % 40 + 1 AS INTEGER) AS q_no, 'which ' || question AS question, array_to_string(choices[1:4], '|') AS choices, CAST(id % 4 + 1 AS INTEGER) AS answer, 'pairs' AS method FROM {MCQ}""")
def parse_mcqs(spark, d):
    got = parse.parse_papers(paper_lines(spark, d), saver(spark, "papers"))
    return got.withColumn("choices", F.array_join("choices", "|"))


@query(f"""SELECT 'paper-' || id // 40 AS paper_id, CAST(count(*) AS BIGINT) AS answers, string_agg(CAST(id % 4 + 1 AS VARCHAR), '' ORDER BY id) AS key FROM {MCQ} GROUP BY id // 40""")
def answer_keys(spark, d):
    """Keys of the same papers without their questions, as files that have a key only."""
    got = parse.parse_papers(paper_lines(spark, d).filter("line_no >= 10000"), saver(spark, "papers"))
    pairs = F.array_sort(F.collect_list(F.struct("q_no", "answer")))
    return got.groupBy("paper_id").agg(F.count("answer").alias("answers"), F.array_join(F.transform(pairs, lambda s: s["answer"].cast("string")), "").alias("key"))

