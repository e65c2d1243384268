"""Epsilon grid order join of embeddings.

Vectors are scaled to unit length, where a cosine of at least t is a distance of at most eps = sqrt(2 - 2t), and turned so
that their leading axes are principal directions (a turn changes no distance). They are sorted by label and by the cells,
eps wide, of the leading axes, and the sequence is cut into intervals. The join goes down from runs of intervals to
intervals and their halves: whatever pair has extents that are further apart than eps on some axis is skipped, and what is
left at the bottom is compared with one matrix product in double precision. A task takes a pair of runs, so an interval is
shipped once for up to GROUP partners.

Equal vectors are one vector with a weight. Links are counted, not listed: each leaf adds to the number of links of its
vectors and passes on only such links as connect what it hasn't connected yet.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Scratch, hot_join, small_batches
from .components import components

#: Vectors of one interval, and of a half that isn't halved further; leading axes; rows that the axes are fitted on.
INTERVAL, LEAF, AXES, SAMPLE = 1024, 128, 6, 20_000
#: Intervals of a run.
GROUP = 8
#: Rounding of a distance or a cosine stays far below this.
SLACK = 1e-9


def _clean(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """row, vec_id, label, key (digest of the direction's components), unit (float64 bytes); null key: links with nothing."""

    def run(batches):
        for b in batches:
            keys, units = [], []
            for v, y, i in zip(b.column("v").to_pylist(), b.column("label").to_pylist(), b.column("vec_id").to_pylist()):
                key = unit = None
                if v and y is not None and i is not None and None not in v:
                    x = np.array(v, np.float64)
                    top = np.abs(x).max()
                    if np.isfinite(x).all() and top > 0:
                        x = x / top + 0.0  # no -0, and no overflow of the squares
                        x = x / np.sqrt(x @ x)
                        unit = x.tobytes()
                        key = hashlib.blake2b(unit, digest_size=16).digest()
                keys.append(key)
                units.append(unit)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("label"), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], names=["row", "vec_id", "label", "key", "unit"])

    src = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    return src.mapInArrow(run, "row long, vec_id long, label string, key binary, unit binary")


def _axes(distinct: DataFrame, axes: int) -> np.ndarray:
    """A turn whose first columns are principal directions, fitted on at most SAMPLE vectors, those of the smallest keys.

    Vectors of other lengths than the most frequent one are not used; lengths never meet, see _leaf.
    """
    rows = [np.frombuffer(r[0]) for r in distinct.select("unit", "key").orderBy("key").limit(SAMPLE).select("unit").collect()]
    if not rows:
        return np.eye(1)
    sizes = np.bincount([len(r) for r in rows])
    x = np.stack([r for r in rows if len(r) == sizes.argmax()])
    _, turn = np.linalg.eigh(np.cov(x.T, bias=True) if len(x) > 1 and x.shape[1] > 1 else np.eye(x.shape[1]))
    return np.ascontiguousarray(turn[:, ::-1][:, :axes])


def _placed(distinct: DataFrame, turn: np.ndarray, eps: float) -> DataFrame:
    """distinct with its projections on the axes (binary) and its cells (array); other lengths than the axes' have zeros."""
    shared = distinct.sparkSession.sparkContext.broadcast(turn)
    names = ["node", "label", "weight", "unit"]

    def run(batches):
        t = shared.value
        for b in batches:
            at = np.zeros((b.num_rows, AXES))
            for i, u in enumerate(b.column("unit").to_pylist()):
                x = np.frombuffer(u)
                if len(x) == len(t):
                    at[i, : t.shape[1]] = x @ t
            cells = np.floor(at / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array([r.tobytes() for r in at], pa.binary()), pa.array(list(cells), pa.list_(pa.int32()))], names=[*names, "at", "cells"])

    return distinct.select(*names).mapInArrow(run, "node long, label string, weight long, unit binary, at binary, cells array<int>")


def _intervals(placed: DataFrame) -> DataFrame:
    """The sorted sequence cut into intervals: block, label, lo and hi of each axis, and the vectors packed."""
    from pyspark import TaskContext

    def run(batches):
        part, n, held, label = TaskContext.get().partitionId(), 0, [], None

        def block():
            nonlocal n, held
            at = np.stack([np.frombuffer(r[3]) for r in held])
            sizes = [len(r[2]) for r in held]
            row = [
                pa.array([part << 32 | n], pa.int64()), pa.array([label]), pa.array([at.min(0).tolist()]), pa.array([at.max(0).tolist()]),
                pa.array([np.array([r[0] for r in held], np.int64).tobytes()], pa.binary()), pa.array([np.array([r[1] for r in held], np.int64).tobytes()], pa.binary()),
                pa.array([np.array(sizes, np.int64).tobytes()], pa.binary()), pa.array([b"".join(r[2] for r in held)], pa.binary()), pa.array([at.tobytes()], pa.binary()),
            ]
            n, held = n + 1, []
            return pa.RecordBatch.from_arrays(row, names=["block", "label", "lo", "hi", "nodes", "weights", "sizes", "units", "at"])

        for b in batches:
            for node, y, weight, unit, at in zip(*(b.column(c).to_pylist() for c in ("node", "label", "weight", "unit", "at"))):
                if held and (len(held) == INTERVAL or y != label):
                    yield block()
                label = y
                held.append((node, weight, unit, at))
        if held:
            yield block()

    cells = [F.col("cells")[i].alias(f"c{i}") for i in range(AXES)]
    order = ["label", *[f"c{i}" for i in range(AXES)], "node"]
    keyed = placed.select("node", "label", "weight", "unit", "at", *cells)
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("node", "label", "weight", "unit", "at").mapInArrow(
        run, "block long, label string, lo array<double>, hi array<double>, nodes binary, weights binary, sizes binary, units binary, at binary"
    )


def _near(a: str, b: str, wide: float) -> Column:
    """Whether two boxes (columns a_lo, a_hi, b_lo, b_hi) are within a distance on all axes."""
    out = F.lit(True)
    for i in range(AXES):
        out = out & (F.col(f"{a}_lo")[i] - F.col(f"{b}_hi")[i] <= wide) & (F.col(f"{b}_lo")[i] - F.col(f"{a}_hi")[i] <= wide)
    return out


def _work(meta: DataFrame, eps: float, scratch: Scratch) -> DataFrame:
    """(x, y, block, partners) of what is joined: the runs x <= y of GROUP intervals each that a task takes, their
    intervals, and with which others (block <= other) each is to be joined; null where it is only a partner.

    Runs of intervals, which follow each other in the sequence, meet by the cells of the first two axes, in which a run that
    is wide stands once for each cell; of the runs whose extents are within eps on all axes, the intervals are compared.
    """
    wide = eps + SLACK
    cell = lambda c: F.floor(c / F.lit(wide)).cast("long")
    box = [F.array(*[f(F.col(c)[i]) for i in range(AXES)]).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi"))]
    runs = meta.withColumn("run", F.floor(F.col("block") / GROUP)).groupBy("run", "label").agg(*box, F.collect_list(F.struct("block", "lo", "hi")).alias("members"))
    runs = runs.withColumn("run", F.array_min("members.block"))
    runs = scratch.save(runs, "runs")
    spots = lambda i, more: F.explode(F.sequence(cell(F.col("lo")[i]) - more, cell(F.col("hi")[i]) + more)).alias(f"c{i}")
    own = runs.select(F.col("run").alias("x"), "label", F.col("lo").alias("x_lo"), F.col("hi").alias("x_hi"), "lo", "hi", spots(0, 0)).select("*", spots(1, 0)).drop("lo", "hi")
    other = runs.select(F.col("run").alias("y"), "label", F.col("lo").alias("y_lo"), F.col("hi").alias("y_hi"), "lo", "hi", spots(0, 1)).select("*", spots(1, 1)).drop("lo", "hi")
    met = own.join(other, ["label", "c0", "c1"]).filter("x <= y").filter(_near("x", "y", wide)).select("x", "y").distinct()
    held = lambda c: runs.select(F.col("run").alias(c), F.col("members").alias(f"{c}_members"))
    each = met.join(held("x"), "x").join(held("y"), "y").select("x", "y", F.explode("x_members").alias("a"), "y_members").select("x", "y", "a", F.explode("y_members").alias("b"))
    each = each.select("x", "y", F.col("a.block").alias("block"), F.col("b.block").alias("other"), F.col("a.lo").alias("a_lo"), F.col("a.hi").alias("a_hi"), F.col("b.lo").alias("b_lo"), F.col("b.hi").alias("b_hi"))
    each = each.filter("block <= other").filter(_near("a", "b", wide)).select("x", "y", "block", "other")
    needed = each.unionByName(each.select("x", "y", F.col("other").alias("block"), F.lit(None).cast("long").alias("other")))
    return needed.groupBy("x", "y", "block").agg(F.array_sort(F.collect_list("other")).alias("partners"))


class _Interval:
    def __init__(self, nodes, weights, sizes, units, at):
        self.nodes, self.weights, self.sizes = (np.frombuffer(x, np.int64) for x in (nodes, weights, sizes))
        self.at = np.frombuffer(at).reshape(len(self.nodes), -1)
        self.even = len(set(self.sizes.tolist())) == 1
        ends = np.cumsum(self.sizes)
        self.units = np.frombuffer(units).reshape(len(self.nodes), -1) if self.even else [np.frombuffer(units[e - s : e]) for s, e in zip(self.sizes, ends)]


def ego_join(s: _Interval, t: _Interval, same: bool, least: float, found) -> None:
    """Call found(i, j) with arrays of linked positions of s and t; for same, of i < j."""
    eps = math.sqrt(max(0.0, 2 - 2 * least)) + SLACK
    stack = [(0, len(s.nodes), 0, len(t.nodes))]
    while stack:
        a, b, c, d = stack.pop()
        if same and c < a:
            continue  # its mirror image is joined
        x, y = s.at[a:b], t.at[c:d]
        if (x.min(0) - y.max(0) > eps).any() or (y.min(0) - x.max(0) > eps).any():
            continue
        if b - a <= LEAF and d - c <= LEAF:
            if s.even and t.even:
                if s.units.shape[1] != t.units.shape[1]:
                    continue
                cos = s.units[a:b] @ t.units[c:d].T
            else:
                cos = np.array([[u @ v if len(u) == len(v) else -2.0 for v in t.units[c:d]] for u in s.units[a:b]])
            i, j = np.nonzero(cos >= least - SLACK)
            if same and a == c:
                i, j = i[i < j], j[i < j]
            close = np.flatnonzero(cos[i, j] < least + SLACK)
            if len(close):  # too near the threshold for a matrix product's rounding
                ok = np.ones(len(i), bool)
                ok[close] = [math.fsum(s.units[a + p] * t.units[c + q]) >= least for p, q in zip(i[close], j[close])]
                i, j = i[ok], j[ok]
            if len(i):
                found(i + a, j + c)
            continue
        ab = [(a, b)] if b - a <= LEAF else [(a, (a + b) // 2), ((a + b) // 2, b)]
        cd = [(c, d)] if d - c <= LEAF else [(c, (c + d) // 2), ((c + d) // 2, d)]
        stack += [(*p, *q) for p in ab for q in cd]


def _joined(least: float):
    """Rows of a task (the intervals of two runs, with their partners) to (node, links, null) and (node, null, other node)."""

    def solve(held: dict[int, tuple[_Interval, list[int]]]):
        at, start = {}, 0  # an interval's vectors have places of their own in a forest over all of the task
        for block, (one, _) in held.items():
            at[block], start = start, start + len(one.nodes)
        top, n_links = np.arange(start), np.zeros(start, np.int64)
        edges = []

        def find(x):
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        for block, (one, partners) in held.items():
            for other in partners:
                two, p0, q0 = held[other][0], at[block], at[other]

                def found(i, j, one=one, two=two, p0=p0, q0=q0):
                    np.add.at(n_links, i + p0, two.weights[j])
                    np.add.at(n_links, j + q0, one.weights[i])
                    # what is connected already needs no more than a look at its roots
                    apart = top[i + p0] != top[j + q0]
                    for p, q in zip(i[apart].tolist(), j[apart].tolist()):
                        x, y = find(p + p0), find(q + q0)
                        if x != y:
                            top[max(x, y)] = min(x, y)
                            edges.append((int(one.nodes[p]), int(two.nodes[q])))

                ego_join(one, two, block == other, least, found)
        out = [(int(one.nodes[k]), int(n_links[at[block] + k]), None) for block, (one, _) in held.items() for k in np.flatnonzero(n_links[at[block] : at[block] + len(one.nodes)])]
        return out + [(a, None, b) for a, b in edges]

    def run(batches):
        key, held = None, {}

        def packed():
            out = solve(held)
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["node", "links", "other"])

        for b in batches:
            for x, y, block, partners, *rest in zip(*(b.column(c).to_pylist() for c in ("x", "y", "block", "partners", "nodes", "weights", "sizes", "units", "at"))):
                if (x, y) != key:
                    if held:
                        yield packed()
                    key, held = (x, y), {}
                held[block] = _Interval(*rest), partners
        if held:
            yield packed()

    return run


def near_vectors(vectors: DataFrame, scratch: Scratch, least: float, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept; linked are vectors of one label with cosine >= least.

    A vector that is null, empty or zero, or has null or non-finite components, and one without a label or an id, links
    with nothing and is kept as its own component. Vectors of different lengths don't link. Rows of equal vectors, those
    that repeat an id included, link with each other, and each counts.
    """
    small_batches(vectors.sparkSession)
    clean = scratch.save(_clean(vectors, vec_id, embedding, label), "clean")
    groups = clean.filter("key is not null").groupBy("label", "key").agg(F.min("row").alias("node"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    groups = scratch.save(groups, "groups")
    distinct = clean.select(F.col("row").alias("node"), "unit").join(groups.select("node", "label", "weight", "key"), "node")
    eps = math.sqrt(max(0.0, 2 - 2 * least))
    blocks = scratch.save(_intervals(_placed(distinct, _axes(distinct, AXES), max(eps, 1e-6))), "intervals")
    work = _work(blocks.select("block", "label", "lo", "hi"), eps, scratch)
    work = work.join(blocks.drop("label", "lo", "hi"), "block").repartition("x", "y").sortWithinPartitions("x", "y", "block")
    found = scratch.save(work.select("x", "y", "block", "partners", "nodes", "weights", "sizes", "units", "at").mapInArrow(_joined(least), "node long, links long, other long"), "links")
    counts = found.filter("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), scratch)
    tied = groups.join(counts, "node", "left").join(comps.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    tied = scratch.save(tied, "tied")
    smallest = tied.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    tied = hot_join(tied, smallest, "component", "node", "nodes", tied.count()).select("label", "key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = clean.select("vec_id", "label", "key").join(tied, ["label", "key"], "left")
    whole = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), whole.alias("component_id"), F.col("vec_id").eqNullSafe(whole).alias("kept"))
