"""Joins of questions, predictions, papers and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dictionaries of at most so many rows are broadcast; longer ones are joined by their names.
MAX_BROADCAST = 100_000


def todo(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows not done yet."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def restrict(preds: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Predictions of the rows given; repeated ones stay."""
    return preds.join(rows.select(key), key, "left_semi")


def wrong_answers(preds: DataFrame, questions: DataFrame, *columns: str) -> DataFrame:
    return preds.filter(~F.col("correct")).join(questions.select("id", *columns), "id")


def canonical_by_mode(df: DataFrame, column: str, order: str, key: Column | None = None) -> DataFrame:
    """df with each spelling of a key replaced by the key's most frequent one, of equals the one that comes first.

    The key is the value in lower case, underscores as spaces. Counts are combined before they are shuffled.
    """
    k = key if key is not None else F.lower(F.trim(F.translate(F.col(column), "_", " ")))
    forms = df.filter(F.col(column).isNotNull()).groupBy(k.alias("_key"), F.col(column).alias("_form")).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    best = forms.groupBy("_key").agg(F.min_by("_form", F.struct(-F.col("_n"), F.col("_first"))).alias("_best"))
    return df.withColumn("_key", k).join(best, "_key", "left").withColumn(column, F.coalesce("_best", column)).drop("_key", "_best")


def longest_match(df: DataFrame, slug: Column, names: DataFrame, name: str = "name") -> DataFrame:
    """df with a column site_name: the longest dictionary name that a slug holds between hyphens, null if none.

    The distinct slugs' runs of up to as many hyphen-separated parts as the longest name has are looked up by a hash join,
    so each slug is met by the names it holds only. 'sinhala-medium' is in nearly all slugs and names no subject. Of names
    of one length the first in the alphabet counts.
    """
    rows = df.withColumn("_slug", slug)
    slugs = rows.select("_slug").filter("_slug is not null").distinct()
    longest = names.agg(F.max(F.size(F.split(F.col(name), "-")))).first()[0] or 1
    lookup = names.select(F.col(name).alias("_name")).distinct()
    if lookup.count() <= MAX_BROADCAST:
        lookup = F.broadcast(lookup)
    parts = F.split(F.regexp_replace(F.lower("_slug"), "sinhala-?medium", "-"), "-")
    runs = slugs.select("_slug", parts.alias("_p")).select("_slug", "_p", F.posexplode("_p").alias("_i", "_w"))
    of = F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.array_join(F.slice("_p", F.col("_i") + 1, n), "-"))
    runs = runs.select("_slug", F.explode(F.array_distinct(of)).alias("_name"))
    best = runs.join(lookup, "_name").groupBy("_slug").agg(F.min_by("_name", F.struct(-F.char_length("_name"), F.col("_name"))).alias("site_name"))
    return rows.join(best, "_slug", "left").drop("_slug")


def match_keys(questions: DataFrame, keys: DataFrame, least: float = 0.9) -> DataFrame:
    """questions (paper, source_page, q_no, n_options, answer) with answers from separate key files of the same page.

    keys: key_id, source_page, q_no, answer. A key fits a paper of which no question has an answer if it covers at least
    that share of its question numbers; of several, the smallest key_id. Answers beyond the options are null.
    """
    numbers = F.array_sort(F.collect_set("q_no")).alias("asked")
    asked = questions.filter("source_page is not null").groupBy("paper", "source_page").agg(numbers, F.count("answer").alias("_have")).filter("_have = 0").drop("_have")
    # papers of a page mostly ask the same numbers, and its keys answer the same ones: each set meets each other once
    wanted = asked.select("source_page", "asked").distinct()
    have = keys.groupBy("key_id", "source_page").agg(F.array_sort(F.collect_set("q_no")).alias("said")).groupBy("source_page", "said").agg(F.min("key_id").alias("key_id"))
    fits = wanted.join(have, "source_page").filter(F.size(F.array_intersect("asked", "said")) >= least * F.size("asked")).filter(F.arrays_overlap("asked", "said"))
    fits = fits.groupBy("source_page", "asked").agg(F.min("key_id").alias("key_id"))
    fit = asked.join(fits, ["source_page", "asked"]).groupBy("paper").agg(F.min("key_id").alias("key_id"))
    given = fit.join(keys.select("key_id", "q_no", F.col("answer").alias("_key")), "key_id").select("paper", "q_no", "key_id", "_key")
    out = questions.join(given, ["paper", "q_no"], "left")
    return out.withColumn("answer", F.coalesce("answer", F.when((F.col("_key") >= 1) & (F.col("_key") <= F.col("n_options")), F.col("_key")))).drop("_key")


def same_content(files: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """Files whose content another path had before: path, duplicate_of (the first path)."""
    first = files.groupBy(digest).agg(F.min(path).alias("duplicate_of"))
    return files.join(first, digest).filter(F.col(path) != F.col("duplicate_of")).select(path, "duplicate_of")


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key: that of the highest version, at the place (column first) of the key's lowest."""
    both = old.unionByName(new, allowMissingColumns=True)
    row = F.struct(*[F.col(f"`{c}`") for c in both.columns])
    out = both.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, version).alias("_row"), F.min(version).alias("_first"))
    return out.select("_row.*", F.col("_first").alias("first"))


def catalog(listed: DataFrame, on_disk: DataFrame, path: str = "local_path") -> DataFrame:
    """Listed papers that exist, and files that aren't listed, with what their folders say of them.

    Unlisted paths are grade_10/<Subject>/term_2/<file>.pdf.
    """
    have = listed.join(on_disk.select(path).distinct(), path, "left_semi")
    p = F.split(F.col(path), "/")
    term = F.element_at(F.split(p[2], "_"), -1)
    extra = on_disk.join(listed.select(path).distinct(), path, "left_anti").filter(F.col(path).rlike(r"^grade_[^/]*/[^/]*/[^/]*/[^/]*\.pdf$")).select(
        path,
        F.element_at(F.split(p[0], "_"), -1).alias("grade"),
        p[1].alias("subject"),
        F.when(p[2].rlike("[0-9]$"), term).otherwise("").alias("term"),
        F.coalesce(F.array_max(F.regexp_extract_all(F.regexp_replace(p[3], r"\.pdf$", ""), F.lit("20[0-3][0-9]"), F.lit(0))), F.lit("")).alias("year"),
    )
    return have.unionByName(extra, allowMissingColumns=True)


def shared_ids(parts: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """first, second and the number of ids that each two of some tables have in common; 0 for those that are disjoint.

    A row goes through one aggregate by id, however many tables there are. Null ids are not ids.
    """
    names = list(parts)
    rows = None
    for i, df in enumerate(parts.values()):
        one = df.select(F.col(key).cast("string").alias("id"), F.lit(i).alias("part"))
        rows = one if rows is None else rows.unionByName(one)
    at = rows.filter("id is not null").groupBy("id").agg(F.array_sort(F.collect_set("part")).alias("at"))
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    counts = at.agg(*[F.count(F.when(F.array_contains("at", i) & F.array_contains("at", j), 1)).alias(f"n{i}_{j}") for i, j in pairs])
    each = F.array(*[F.struct(F.lit(names[i]).alias("first"), F.lit(names[j]).alias("second"), F.col(f"n{i}_{j}").alias("n")) for i, j in pairs])
    return counts.select(F.explode(each).alias("p")).select("p.first", "p.second", "p.n")
