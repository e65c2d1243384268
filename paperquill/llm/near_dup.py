"""Near-duplicate documents by SetSketch registers.

A document is the set of its word shingles, hashed to 64 bits. Each shingle has a Poisson process of points, marked with
registers; a register of a set is the exponentially spaced, truncated minimum of the points it gets, so registers merge
by maximum and those of two sets agree with about the probability of their Jaccard similarity. Bands of registers bring
candidates together, the similarity of a candidate pair is estimated from both sketches by maximum likelihood, and what
may reach the threshold is verified on the full sets, which are made again from the texts of the documents concerned.

Groups are never expanded into pairs. Equal sets are one node. Each band bucket ties its nodes to its smallest node; only
buckets whose nodes are not all tied together by verified links are looked at further, in blocks of bounded size, where a
pair is compared only while its two nodes are not connected yet. Of a bucket of many blocks, such nodes meet only as have
one of their rarest shingles in common. So every link between candidates is found or implied.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch, columns_of, hot_join, numbered, small_batches, texts, trim
from .components import components

REGISTERS, BASE, RATE, TOP = 256, 1.001, 20.0, 65_535
#: An estimate may fall short of the threshold by this much, over five standard deviations, and still be verified.
MARGIN = 0.12
#: A pair at the threshold is missed by all bands with at most this probability.
MISSED = 1e-5
BLOCK = 256
#: Words that a worker remembers, and shingles that are sketched at once, at most (a longer text is sketched by itself).
REMEMBERED, AT_ONCE = 100_000, 200_000
#: Bytes of shingle sets that a task of verification takes, but for those of two documents; rows that are broadcast.
BLOCK_SHINGLES, MAX_BROADCAST = 4_000_000, 1_000_000
#: A torn bucket of more pairs of blocks is dealt to buckets of rare shingles first.
PRODUCTS = 16
_G, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(z: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    z = (z ^ (z >> np.uint64(30))) * _A
    z = (z ^ (z >> np.uint64(27))) * _B
    return z ^ (z >> np.uint64(31))


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have for a pair at the threshold to be missed with at most MISSED."""
    for rows in range(16, 0, -1):
        bands = REGISTERS // rows
        if (1 - threshold**rows) ** bands <= MISSED:
            return bands, rows
    return REGISTERS, 1


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_word_hash = _WordHash()


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of k words; of fewer words, of the whole sequence."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, len(words))
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * _G + w[i : len(w) - n + 1 + i]
    return np.unique(mix(h))


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (uint16) of each set; of an empty one all zero."""
    parts, first, n = [], 0, 0
    for i, s in enumerate(sets):
        if i > first and n + len(s) > AT_ONCE:
            parts.append(_sketch(sets[first:i]))
            first, n = i, 0
        n += len(s)
    return np.concatenate([*parts, _sketch(sets[first:])])


def _sketch(sets: list[np.ndarray]) -> np.ndarray:
    m = REGISTERS
    low = np.full((len(sets), m), np.inf)
    size = np.array([len(s) for s in sets], np.int64)
    flat = low.reshape(-1)
    held = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), size)
    reach = (np.log(m) + 3) / (RATE * np.maximum(size, 1))  # points up to here fill all registers of most sets

    def following(h, d, x, turn):
        z = mix(h + (turn + 1).astype(np.uint64) * _G)
        x = x - np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (RATE * m)
        return h, d, x, turn + 1, d * m + (z & np.uint64(m - 1)).astype(np.int64)

    point = following(held, doc, np.zeros(len(held)), np.zeros(len(held), np.int64))
    beyond: list[tuple] = []
    while True:
        inside = point[2] <= reach[point[1]]
        np.minimum.at(flat, point[4][inside], point[2][inside])
        beyond.append(tuple(c[~inside] for c in point))
        point = following(*(c[inside] for c in point[:4]))
        if not len(point[0]):
            # all points within reach are in; a set with a register that got none has to reach further
            short = np.isinf(low).any(1) & (size > 0)
            if not short.any():
                break
            reach[short] *= 1.5
            point = tuple(np.concatenate(c) for c in zip(*beyond))
            point = tuple(c[short[point[1]]] for c in point)
            beyond = []
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(low) / np.log(BASE))
    return np.clip(np.where(np.isinf(low), 0, k), 0, TOP).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches, the sizes of both sets being known."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = REGISTERS - up - down
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(np.clip(u - v * j, 1e-12, 1)), p(np.clip(v - u * j, 1e-12, 1))
    fit = up[:, None] * np.log(more) + down[:, None] * np.log(less) + same[:, None] * np.log(np.clip(1 - more - less, 1e-12, 1))
    return np.take_along_axis(j, fit.argmax(1)[:, None], 1)[:, 0]


def _sketches(docs: DataFrame, text: str, k: int, bands: int, rows: int) -> DataFrame:
    """row, doc_id, n, key1, key2 (hashes of the whole set), bands (array), registers (binary) of each document."""

    def run(batches):
        for b in batches:
            sets = [shingles(t, k) for t in texts(b, "text")]
            regs = sketch(sets)
            with np.errstate(over="ignore"):
                key1 = [int(mix(s).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0 for s in sets]
                key2 = [int(mix(s * _A + _B).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0 for s in sets]
                h = np.zeros((len(sets), bands), np.uint64) + mix(np.arange(1, bands + 1, dtype=np.uint64))
                for i in range(rows):
                    h = mix(h * _G + regs[:, i : bands * rows : rows].astype(np.uint64))
            offsets = np.arange(0, bands * (len(sets) + 1), bands, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("row"), b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(key1, pa.int64()), pa.array(key2, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h.astype(np.int64).reshape(-1))),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                ],
                names=["row", "doc_id", "n", "key1", "key2", "bands", "registers"],
            )
        trim()

    return docs.mapInArrow(run, "row long, doc_id long, n long, key1 long, key2 long, bands array<long>, registers binary")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """row and shingle set (binary) of the documents whose rows are wanted; only their texts leave the JVM."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([shingles(t, k).tobytes() for t in texts(b, "text")], pa.binary())], names=["row", "set"])
        trim()

    wanted = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST else wanted
    return docs.select("row", "text").join(wanted, "row", "left_semi").mapInArrow(run, "row long, set binary")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) < len(b):
        a, b = b, a
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(percent: int):
    """Rows of a task together, sorted: to links (a, b) of nodes. Where a task has a center, it alone is compared with
    the others; else pairs of different components are compared, likely ones first, until they are connected."""

    def solve(task: list[tuple]) -> list[tuple[int, int]]:
        centers = [t for t in task if t[2]]
        if centers:
            c, cs = centers[0][0], centers[0][4]
            return [(c, t[0]) for t in task if not t[2] and _linked(cs, t[4], percent)]
        top = {}

        def find(x):
            while top.setdefault(x, x) != x:
                top[x] = x = top[top[x]]
            return x

        out = []
        regs = np.stack([np.frombuffer(t[3], np.uint16) for t in task])
        comp = np.array([t[1] for t in task])
        side = np.array([t[5] for t in task])
        size = np.array([len(t[4]) for t in task], float)
        pairs = []
        two = len(set(side)) > 1
        for i in range(len(task) - 1):
            j = np.arange(i + 1, len(task))
            j = j[(comp[j] != comp[i]) & ((side[j] != side[i]) | (not two))]
            if len(j):
                same = (regs[j] == regs[i]).sum(1)
                j, same = j[same >= (percent / 100 - 2 * MARGIN) * REGISTERS], same[same >= (percent / 100 - 2 * MARGIN) * REGISTERS]
            if len(j):
                est = estimate(np.broadcast_to(regs[i], (len(j), REGISTERS)), regs[j], np.full(len(j), size[i]), size[j])
                pairs += [(-e, i, int(x)) for e, x in zip(est, j) if e >= percent / 100 - MARGIN]
        for _, i, j in sorted(pairs):
            a, b = find(comp[i]), find(comp[j])
            if a != b and _linked(task[i][4], task[j][4], percent):
                top[max(a, b)] = min(a, b)
                out.append((task[i][0], task[j][0]))
        return out

    def run(batches):
        held, key = [], None
        for b in batches:
            out = []
            cols = [b.column(c).to_pylist() for c in ("task", "salt", "node", "comp", "center", "registers", "set", "side")]
            for t, salt, node, comp, center, regs, s, side in zip(*cols):
                if (t, salt) != key:
                    out += solve(held) if len(held) > 1 else []
                    held, key = [], (t, salt)
                held.append((node, comp, center, regs, np.frombuffer(s, np.uint64), side))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
        out = solve(held) if len(held) > 1 else []
        held = []
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return run


def _by_rare_shingles(numbered: DataFrame, members: DataFrame, scratch: Scratch, percent: int, k: int) -> DataFrame:
    """members (bucket, node, comp, n) dealt anew, to a bucket for each of the rarest shingles of a node in its bucket.

    Two sets that reach the threshold have a shingle in common among the (1 - threshold) * n + 1 rarest of either, so each
    link is in one of these buckets. Texts of one template that are too different to link share common shingles only, so
    they don't meet. Shingles that one component alone has make no bucket.
    """
    members = scratch.save(members, "members")
    wanted = scratch.save(members.select(F.col("node").alias("row")).distinct(), "wanted")

    def lists(batches):
        for b in batches:
            sets = [np.frombuffer(x, np.int64) for x in b.column("set").to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            xs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([b.column("row"), xs], names=["node", "xs"])

    sets = _sets(numbered, wanted, k).mapInArrow(lists, "node long, xs array<long>")
    grams = members.join(sets, "node").select("bucket", "node", "comp", "n", F.explode("xs").alias("x")).select("bucket", "node", "comp", "n", F.xxhash64("bucket", "x").alias("h"))
    grams = scratch.save(grams, "grams")
    often = scratch.save(grams.groupBy("h").agg(F.count("*").alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high")), "often")
    # n - ceil(threshold * n) + 1
    first = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
    place = F.row_number().over(Window.partitionBy("bucket", "node").orderBy("c", "h"))
    rare = hot_join(grams, often, "h", "node", "c", grams.count()).withColumn("place", place).filter((F.col("place") <= first) & (F.col("low") != F.col("high")))
    return rare.select(F.col("h").alias("bucket"), "node", "comp", "n")


def near_duplicates(docs: DataFrame, scratch: Scratch, percent: int, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: row (its number), doc_id, n_shingles, component, component_id, kept.

    Documents are linked where 100 * intersection >= percent * union of their shingle sets. component_id is the smallest
    doc_id that links reach, and kept tells whether it is the row's own. A null or empty text has no shingles and is linked
    with nothing. A null doc_id is passed over when the smallest is sought; a component without any other has a null
    component_id, and keeps its rows. docs is read once: its rows are stored with their numbers.
    """
    return _judge(scratch.save(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "rows"), scratch, percent, k)


def _judge(numbered: DataFrame, scratch: Scratch, percent: int, k: int) -> DataFrame:
    """near_duplicates() of a stored table of row, doc_id and text: a scan numbers rows by its splits, which change with
    the cores that are registered when it is planned, so numbers are taken once and read by all steps."""
    small_batches(numbered.sparkSession)
    bands, rows = banding(percent / 100)
    made = scratch.save(_sketches(numbered, "text", k, bands, rows), "sketches")
    classes = scratch.save(made.filter("n > 0").groupBy("key1", "key2", "n").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "classes")
    nodes = made.join(classes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")

    # buckets of at least two nodes, and the tie of each of their nodes to the smallest
    band = nodes.select("node", F.explode("bands").alias("bucket"))
    many = band.groupBy("bucket").agg(F.count("*").alias("g"), F.min("node").alias("center"), F.bit_xor(F.xxhash64("node")).alias("mark")).filter("g > 1")
    many = scratch.save(many, "many")
    held = many.agg(F.coalesce(F.sum("g"), F.lit(0))).first()[0]
    member = scratch.save(hot_join(band, many, "bucket", "node", "g", held), "buckets")
    tie = member.filter("node <> center").select("node", "center").distinct()
    sized = made.select(F.col("row").alias("node"), "registers", "n")
    stars = member.filter("node <> center").groupBy("center").agg(F.count("*").alias("nodes"))  # repeated ties count, which does no harm
    lead = sized.select(F.col("node").alias("center"), F.col("registers").alias("c_registers"), F.col("n").alias("c_n")).join(stars, "center")
    pair = hot_join(tie.join(sized, "node"), lead, "center", "node", "nodes", held)

    def likely(batches):
        for b in batches:
            if b.num_rows:
                a, c = (np.stack([np.frombuffer(x, np.uint16) for x in b.column(name).to_pylist()]) for name in ("registers", "c_registers"))
                na, nc = (b.column(name).to_numpy().astype(float) for name in ("n", "c_n"))
                ok = (estimate(a, c, na, nc) >= percent / 100 - MARGIN) & (100 * np.minimum(na, nc) >= percent * np.maximum(na, nc))
                yield b.select(["node", "center", "n"]).filter(pa.array(ok))

    tie = scratch.save(pair.select("node", "center", "registers", "n", "c_registers", "c_n").mapInArrow(likely, "node long, center long, n long"), "ties")
    shape = "a long, b long"
    nothing = F.lit(None).cast("binary")

    def verified(requests: DataFrame) -> DataFrame:
        wanted = scratch.save(requests.select(F.col("node").alias("row")).distinct(), "wanted")
        sets = _sets(numbered, wanted, k).withColumnRenamed("row", "node")
        rows_ = requests.join(sets, "node").select("task", "salt", "node", "comp", "center", "registers", "set", "side")
        return rows_.repartition("task", "salt").sortWithinPartitions("task", "salt", F.desc("center"), "node").mapInArrow(_verify(percent), shape)

    def blocks_of(count: Column, shingles_: Column) -> Column:
        """Blocks that so many nodes with so many shingles fill."""
        return F.greatest(F.ceil(count / BLOCK), F.ceil(shingles_ / BLOCK_SHINGLES)).cast("int")

    # a center with many nodes is copied to as many tasks as they fill
    width = scratch.save(tie.groupBy("center").agg(F.count("*").alias("nodes"), blocks_of(F.count("*"), F.sum("n")).alias("w")), "widths")
    spread = hot_join(tie, width, "center", "node", "nodes", held).select(F.col("center").alias("task"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("w")).cast("int").alias("salt"), "node")
    spread = spread.unionByName(width.select(F.col("center").alias("task"), F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("salt"), F.col("center").alias("node")))
    star = spread.select("task", "salt", "node", F.col("node").alias("comp"), (F.col("task") == F.col("node")).alias("center"), nothing.alias("registers"), F.lit(0).alias("side"))
    links = scratch.save(verified(star), "links")

    label = scratch.save(components(links, scratch).select(F.col("id").alias("node"), F.col("component").alias("comp")), "labels")
    labelled = member.filter("g > 2").select("bucket", "node").join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(sized.select("node", "n"), "node").select("bucket", "node", "comp", "n")

    def torn_of(rows: DataFrame) -> DataFrame:
        """bucket, nodes, main (its largest component), w and v (blocks outside and inside it) of the buckets that links
        don't tie together; of buckets of the same nodes one."""
        sides = rows.groupBy("bucket", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("c_n"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("mark"))
        whole = sides.groupBy("bucket").agg(F.max_by(F.struct("comp", "c", "c_n"), F.struct("c", "comp")).alias("main"), F.sum("c").alias("g"), F.sum("c_n").alias("n"), F.min("least").alias("least"), F.bit_xor("mark").alias("mark"))
        one = whole.filter("main.c < g").groupBy("g", "least", "mark").agg(F.min(F.struct("bucket", "main", "n")).alias("t")).select("t.bucket", "g", "t.main", "t.n")
        outside = blocks_of(F.col("g") - F.col("main.c"), F.col("n") - F.col("main.c_n"))
        return one.select("bucket", F.col("g").alias("nodes"), F.col("main.comp").alias("main"), outside.alias("w"), blocks_of(F.col("main.c"), F.col("main.c_n")).alias("v"))

    def products(rows: DataFrame, torn: DataFrame, total: int) -> DataFrame:
        """Tasks of pairs of blocks: the w of the nodes outside a bucket's main component meet each other and the v inside it;
        those inside are connected."""
        rest = hot_join(rows.select("bucket", "node", "comp"), torn, "bucket", "node", "nodes", total).withColumn("minor", F.col("comp") != F.col("main"))
        rest = rest.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.when(F.col("minor"), F.col("w")).otherwise(F.col("v"))).cast("int"))
        up_to = lambda n: F.sequence(F.lit(0), n - 1)
        minor = rest.filter("minor")
        one = minor.select("*", F.explode(up_to(F.col("w"))).alias("o")).select("*", (F.least("block", "o") * F.col("w") + F.greatest("block", "o")).alias("salt"), F.col("block").alias("side"))
        two = minor.select("*", F.explode(up_to(F.col("v"))).alias("o")).select("*", (F.col("w") * F.col("w") + F.col("block") * F.col("v") + F.col("o")).alias("salt"), F.lit(0).alias("side"))
        three = rest.filter("not minor").select("*", F.explode(up_to(F.col("w"))).alias("o")).select("*", (F.col("w") * F.col("w") + F.col("o") * F.col("v") + F.col("block")).alias("salt"), F.lit(1).alias("side"))
        return one.unionByName(two).unionByName(three).select(F.col("bucket").alias("task"), "salt", "node", "comp", F.lit(False).alias("center"), "side")

    torn = scratch.save(torn_of(labelled), "torn")
    large = F.col("w").cast("long") * (F.col("w") + F.col("v")) > PRODUCTS
    met = products(labelled, torn.filter(~large), held)
    if not torn.filter(large).isEmpty():
        inside = hot_join(labelled, torn.filter(large).select("bucket", "nodes"), "bucket", "node", "nodes", held).select("bucket", "node", "comp", "n")
        sub = scratch.save(_by_rare_shingles(numbered, inside, scratch, percent, k), "sub-buckets")
        met = met.unionByName(products(sub, scratch.save(torn_of(sub), "torn"), sub.count()))
    met = scratch.save(met.join(sized.select("node", "registers"), "node"), "blocks")
    more = scratch.save(verified(met), "links")
    scratch.drop(met, member, tie, many, width, torn)

    # the links found last are between components of those found first
    of = lambda c: label.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
    between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    above = scratch.save(components(between, scratch).select(F.col("id").alias("comp"), F.col("component").alias("top")), "above")
    single = above.join(label, above.comp == label.node, "left_anti").select(F.col("comp").alias("id"), F.col("top").alias("component"))
    size = label.groupBy("comp").agg(F.count("*").alias("nodes"))
    tops = size.join(above, "comp", "left").select("comp", F.coalesce("top", "comp").alias("component"), "nodes")
    found = hot_join(label, tops, "comp", "node", "nodes", held).select(F.col("node").alias("id"), "component").unionByName(single)
    tied = classes.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    tied = scratch.save(tied, "tied")
    # a component's first row: the smallest doc_id, and of its rows the first
    least = tied.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    whole = hot_join(tied, least, "component", "node", "nodes", tied.count()).select("key1", "key2", "n", "component", "component_id")
    out = made.select("row", "doc_id", "n", "key1", "key2").join(whole, ["key1", "key2", "n"], "left")
    out = out.withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("row", "doc_id", F.col("n").alias("n_shingles"), "component", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, scratch: Scratch, percent: int = 80, k: int = 5) -> DataFrame:
    """docs without the near-duplicates: of each component the row with the smallest doc_id, or the first such row.

    Documents without shingles all stay. Columns are unchanged.
    """
    stored, row = numbered(docs, scratch)
    judged = scratch.save(_judge(stored.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), scratch, percent, k), "judged")
    firsts = judged.filter("kept and component is not null").groupBy("component").agg(F.min("row").alias(row)).select(row)
    stay = scratch.save(firsts.unionByName(judged.filter("component is null").select(F.col("row").alias(row))), "stay")
    return stored.join(stay, row, "left_semi").select(*columns_of(docs))
