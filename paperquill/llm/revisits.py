"""Not-modified revisits of web archives.

A revisit record says that a page had not changed since it was fetched before. It is joined as of its time with the latest
earlier full response of its canonical URL, their validators are compared, and the headers that a not-modified answer may
renew are merged over those of the stored response.

Records are sorted by URL and time over ranges of both, so the records of a URL that has a third of all rows are in many
tasks. Each task carries the last response forward; what it would need from tasks before it, one row each, is filled in.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Scratch, small_batches

# Header fields that a not-modified answer sends and a cache has to update (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified", "age")
#: Query parameters that only track where a visitor came from. A parameter.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)"


def canonical_url(url: Column) -> Column:
    """Lower-case host without www. or default port, no scheme, fragment, tracking parameters, or slash at the end.

    The other query parameters are sorted. A null URL stays null.
    """
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(path, r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^{TRACKING}(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


_LAST = ["record", "etag", "modified", "digest", "headers"]


def resolve(records: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per revisit: record, key, ts, source, status, digest, headers.

    records: record (a number that tells rows apart), url, ts (long), kind ('response' or 'revisit'), etag, modified,
    digest (strings) and headers (map). source: the record of the latest response of the same canonical URL and an
    earlier time; of responses of one time it is the one with the largest number. status: 'resolved' where its validators
    agree (the entity tags if both have one, weak ones compared without W/; else the dates if both have one; else the
    digests), 'changed' where they don't, 'unchecked' where nothing can be compared, 'missing' without a response. digest
    and headers are those of the source, the headers with the permitted ones of the revisit merged over them; both only
    where the status is resolved or unchecked. Revisits without a URL or time are missing; other kinds are passed over.
    """
    spark = records.sparkSession
    small_batches(spark)
    flat = records.select(
        "record", canonical_url(F.col("url")).alias("key"), F.col("ts").cast("long").alias("ts"), (F.col("kind") == "response").alias("full"),
        *[F.col(c).cast("string").alias(c) for c in ("etag", "modified", "digest")], F.col("headers").cast("map<string,string>").alias("headers"), "kind",
    ).filter("kind in ('response', 'revisit')").drop("kind")
    usable = F.col("key").isNotNull() & F.col("ts").isNotNull()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "ts", "full", "record"]  # at one time a revisit comes before a response, which isn't earlier
    placed = flat.filter(usable).withColumn("headers", F.to_json("headers")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    names = ["record", "key", "ts", "full", "etag", "modified", "digest", "headers"]

    def sweep(batches):
        """Rows with the last response before each, where this task has it; and at its end the last of the last URL."""
        part, key, last, first = TaskContext.get().partitionId(), None, None, None
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in names}
            got = []
            for i in range(b.num_rows):
                if cols["key"][i] != key:
                    key, last = cols["key"][i], None
                first = key if first is None else first
                got.append(last)
                if cols["full"][i]:
                    last = tuple(cols[c][i] for c in _LAST)
            keep = [i for i in range(b.num_rows) if not cols["full"][i]]
            rows = [[cols[c][i] for c in names if c != "full"] + [part, False] + list(got[i] or (None,) * len(_LAST)) for i in keep]
            yield batch(rows)
        if key is not None:
            yield batch([[None, key, None, None, None, None, None, part, True] + list(last or (None,) * len(_LAST))])

    fields = [("record", pa.int64()), ("key", pa.string()), ("ts", pa.int64()), ("etag", pa.string()), ("modified", pa.string()), ("digest", pa.string()), ("headers", pa.string()), ("part", pa.int32()), ("tail", pa.bool_()), ("s_record", pa.int64()), ("s_etag", pa.string()), ("s_modified", pa.string()), ("s_digest", pa.string()), ("s_headers", pa.string())]

    def batch(rows):
        cols = list(zip(*rows)) if rows else [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[f for f, _ in fields])

    ddl = "record long, key string, ts long, etag string, modified string, digest string, headers string, part int, tail boolean, s_record long, s_etag string, s_modified string, s_digest string, s_headers string"
    swept = scratch.save(placed.select(*names).mapInArrow(sweep, ddl), "swept")
    # a row for each task: its last URL and that URL's last response. A task whose only URL is that of the task before
    # it, and which has no response, passes on what it got.
    ends = swept.filter("tail").select("part", "key", *[f"s_{c}" for c in _LAST]).orderBy("part").collect()
    carry, held = [], None
    for e in ends:
        if held is not None:
            carry.append((e["part"], *held))
        if e["s_record"] is not None or held is None or held[0] != e["key"]:
            held = tuple(e[c] for c in ("key", *[f"s_{c}" for c in _LAST]))
    given = spark.createDataFrame(carry, "part int, key string, c_record long, c_etag string, c_modified string, c_digest string, c_headers string")
    rows = swept.filter("not tail").join(F.broadcast(given), ["part", "key"], "left")
    own = F.col("s_record").isNotNull()
    filled = [F.when(own, F.col(f"s_{c}")).otherwise(F.col(f"c_{c}")).alias(f"s_{c}") for c in _LAST]
    rows = rows.select("record", "key", "ts", "etag", "modified", "digest", "headers", *filled)
    lost = flat.filter("not full").filter(~usable).withColumn("headers", F.to_json("headers"))
    for c in _LAST:
        lost = lost.withColumn(f"s_{c}", F.lit(None).cast("long" if c == "record" else "string"))
    rows = rows.unionByName(lost.drop("full"))
    strong = lambda c: F.regexp_replace(F.col(c), r"^W/", "")
    agree = F.coalesce(strong("etag") == strong("s_etag"), F.col("modified") == F.col("s_modified"), F.col("digest") == F.col("s_digest"))
    status = F.when(F.col("s_record").isNull(), "missing").when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("changed")
    empty = F.create_map().cast("map<string,string>")

    def low(c):  # names in lower case; of names that differ only in case, the last one counts
        e = F.transform(F.map_entries(F.coalesce(F.from_json(c, "map<string,string>"), empty)), lambda x: F.struct(F.lower(x["key"]).alias("key"), x["value"].alias("value")))
        names_ = F.reverse(F.transform(e, lambda x: x["key"]))
        return F.map_from_entries(F.filter(e, lambda x, i: i == F.size(e) - F.array_position(names_, x["key"])))

    renewed = F.map_filter(F.col("_new"), lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(F.col("_old"), lambda k, v: ~F.map_contains_key(renewed, k)), renewed)
    good = F.col("status").isin("resolved", "unchecked")
    rows = rows.withColumn("status", status).withColumn("_new", low("headers")).withColumn("_old", low("s_headers"))
    return rows.select("record", "key", "ts", F.col("s_record").alias("source"), "status", F.when(good, F.col("s_digest")).alias("digest"), F.when(good, merged).alias("headers"))
