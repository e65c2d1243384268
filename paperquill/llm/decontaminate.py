"""Benchmark decontamination with DataFrame functions only.

Every window of the benchmark (n consecutive words of an item, or all of a shorter one) is indexed by one of its words,
the anchor, which is the one that the fewest windows have. Documents are cut into words and scanned once: a position
is looked at further if its word is an anchor, and hit if the hash and then the words of the window around it agree.
The index is broadcast while it has at most MAX_BROADCAST windows; a larger one is joined by its anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Scratch, columns_of, fresh, numbered

#: Words are runs of what is neither ASCII white space, control, punctuation nor an upper case letter once lowered.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW, MAX_BROADCAST = 13, 200_000
#: Stands at the end of each document's words, so that the scan gives one row for documents without a hit too.
END, END_KEYS = "\x00", 1024


def lowered_words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; those of null are none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """item_id, words of each distinct window of each item. Items without words have none."""
    items = benchmark.select("item_id", lowered_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    return items.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i") + 1, F.lit(n)).alias("words")).distinct()


def window_index(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """anchor, before (words before the anchor), size, words, items (array of the item_ids) of each distinct window."""
    distinct = windows(benchmark, n).groupBy("words").agg(F.collect_set("item_id").alias("items"))
    words = distinct.select("words", "items", F.posexplode("words").alias("before", "anchor"))
    often = words.groupBy("anchor").agg(F.count_distinct("words").alias("often"))
    best = words.join(often, "anchor").groupBy("words").agg(
        F.min(F.struct("often", "anchor", "before")).alias("a"), F.first("items").alias("items")
    )
    return best.select("a.anchor", "a.before", F.size("words").alias("size"), "words", "items")


def scan(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, n: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: row (its key here), doc_id, n_words, n_hit, n_items, items (sorted strings), hits.

    hits: array of (at, size), the word positions (from 0) where windows occur and how long they are, sorted. n_hit
    counts the words that at least one of them covers. A null text has no words; an empty benchmark hits nothing; equal
    rows, and rows with a null doc_id, are documents of their own. Other columns of the inputs are not read.
    """
    index = scratch.save(window_index(benchmark.select("item_id", "text"), n), "windows")
    small = index.count() <= MAX_BROADCAST
    # where positions are shuffled, the ends of documents are dealt out, too
    ends = F.array(*[F.lit(f"{END}{i}") for i in range(1 if small else END_KEYS)])
    end = docs.sparkSession.range(1).select(
        F.explode(ends).alias("anchor"), F.lit(0).alias("before"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("words"), F.array().cast("array<string>").alias("items")
    )
    window = F.array_join("words", " ")  # a word has no space, so this tells windows apart
    keys = index.withColumn("items", F.col("items").cast("array<string>")).unionByName(end).select(
        F.lower("anchor").alias("anchor"), "before", "size", "items", window.alias("window"), F.xxhash64(window).alias("hash"),
        F.lower(F.get("words", F.lit(0))).alias("first"), F.lower(F.get("words", F.col("size") - 1)).alias("last"),
    )
    if small:
        keys = F.broadcast(keys)
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD_ANY_CASE), F.lit(0))
    marked = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words.alias("w"))
    own_end = F.lit(f"{END}0") if small else F.concat(F.lit(END), F.pmod(F.xxhash64("row"), F.lit(END_KEYS)).cast("string"))
    marked = marked.withColumn("w", F.concat("w", F.array(own_end)))
    seen = marked.select("row", "doc_id", "w", F.posexplode("w").alias("pos", "word"))
    at, total = F.col("pos") - F.col("before"), F.size("w") - 1
    if not small:  # positions are shuffled, so each takes along the words that a window around it can have, not them all
        from_ = F.greatest(F.col("pos") - (n - 1), F.lit(0))
        seen = seen.select("row", "doc_id", total.alias("total"), from_.alias("from"), F.slice("w", from_ + 1, F.lit(2 * n - 1)).alias("w"), "pos", "word")
        at, total = at - F.col("from"), F.col("total")
    found = seen.join(keys, F.lower("word") == F.col("anchor"))
    # No lambda here: it would take the join out of generated code, and each position would then copy its document.
    there = F.translate(F.array_join(F.slice("w", F.greatest(at + 1, F.lit(1)), F.col("size")), " "), UPPER, LOWER)
    # the ends of the window first, for that is cheap; then its hash, and then its words
    agrees = (F.lower(F.get("w", at)) == F.col("first")) & (F.lower(F.get("w", at + F.col("size") - 1)) == F.col("last"))
    agrees = agrees & (F.xxhash64(there) == F.col("hash")) & (there == F.col("window"))
    is_end = F.col("size") == 0
    found = found.filter(is_end | agrees).select(
        "row", "doc_id", "items",
        F.when(is_end, total).alias("n_words"),
        F.when(~is_end, F.struct((F.col("pos") - F.col("before")).alias("at"), F.col("size"))).alias("hit"),
    )
    docs_hit = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set("hit")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))

    def cover(a: Column, h: Column) -> Column:
        stop = (h["at"] + h["size"]).cast("long")
        fresh = F.greatest(stop - F.greatest(a["to"], h["at"].cast("long")), F.lit(0).cast("long"))
        return F.struct((a["n"] + fresh).alias("n"), F.greatest(a["to"], stop).alias("to"))

    return docs_hit.select(
        "row", "doc_id", "n_words", F.aggregate("hits", none, cover, lambda a: a["n"]).alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "hits"
    )


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit") -> Column:
    """True where words are hit and they are at least a twentieth of the document."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def remove_documents(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, n: int = WINDOW) -> DataFrame:
    """docs without those that hold benchmark text, each row judged by its own text; columns unchanged.

    A document goes where a window of n words occurs in it, however long it is. The window of an item of fewer words
    can be a common phrase; a document with such hits only goes where they are a twentieth of its words.
    Rows are stored and told apart by their number; what goes is a small table of numbers (broadcast while Spark finds it
    small enough), so that no text is shuffled.
    """
    stored, row = numbered(docs, scratch)
    judged = scan(stored.select(row, "text"), benchmark, scratch, n, doc_id=row)
    bad = scratch.save(judged.filter(F.exists("hits", lambda h: h["size"] >= n) | contaminated()).select(F.col("doc_id").alias(row)), "contaminated")
    return stored.join(bad, row, "left_anti").select(*columns_of(docs))


def remove_spans(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, n: int = WINDOW, text: str = "text") -> DataFrame:
    """docs with the hit words, and what stands between each and the next word, cut from their texts; columns unchanged.

    Null texts and texts without hits stay as they are; a text that is all hits becomes what stood before its first word.
    """
    stored, row = numbered(docs, scratch)
    judged = scan(stored.select(row, F.col(text).alias("text")), benchmark, scratch, n, doc_id=row)
    hits, gone = fresh(stored, "hits", "gone")
    bad = scratch.save(judged.filter("n_hit > 0").select(F.col("doc_id").alias(row), F.col("hits").alias(hits)), "hits")
    pieces = F.regexp_extract_all(F.col(text), F.lit(WORD_ANY_CASE.removesuffix("+") + r"+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    lead = F.regexp_extract(F.col(text), r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    places = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1))))
    cut = F.concat(lead, F.array_join(F.filter(pieces, lambda p, i: ~F.array_contains(F.col(gone), i)), ""))
    joined = stored.join(bad, row, "left").withColumn(gone, places)
    return joined.select(*[F.when(F.col(gone).isNull(), F.col(c)).otherwise(cut).alias(c) if c == text else x for c, x in zip(docs.columns, columns_of(docs))])
