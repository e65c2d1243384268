"""Brown class-based bigram model with exchange clustering.

P(text) is the product over its tokens (the words, then an end) of P(class | class before) * P(word | class). Classes are
found by exchange: each word moves to the class where the likelihood of the class bigrams is highest. The most frequent
words and the endings of all others start it on the driver. Then all words of the head that occur LEAST_OWN times or more
are exchanged in rounds of Spark tasks over the table of their neighbours, half of them a round, until none moves, a round
gains nothing, or ROUNDS are over (Model.stopped says which). A round reads that table once: it counts the class bigrams
that the last round's moves made, and moves words by these counts as they were before, with what the moves changed.
Words beyond the head, if they occur as often, are put by their own neighbours into the best of those classes, once; a
neighbour beyond the head counts there as its ending. Only rarer and unseen words have the class of their ending (hashed
to a fixed number). All counts (words, bigrams, types of each class) are taken over all training texts, with the final
classes.

Smoothing: a class transition is mixed with the class's own frequency; a word's count is discounted, and what a class
loses by that is spread evenly over its unseen types, which are taken to be so many that each is half as likely as a word
of the class that occurs once. Over the known words and the unseen types of all classes, the probabilities of the next
token sum to 1.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, replace
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Scratch, small_batches, texts, trim

#: Words whose counts every task has at hand; units that start the clustering, and how many of them are words; classes.
HEAD, UNITS, UNIT_WORDS, CLASSES = 200_000, 1024, 640, 64
ENDINGS = UNITS - UNIT_WORDS - 1
#: Words that occur so often have a class by their own neighbours.
LEAST_OWN = 3
ROUNDS, MIX = 12, 4.0
MARK_BITS = 24
#: Words whose neighbours are summed in two steps, and groups of tasks of the first.
HOT, SALTS = 512, 256
HOLE = 255
_EDGE = bytes(i for i in range(33, 127) if not chr(i).isalnum())


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, A-Z lower-cased, cut at ASCII white space; the end is not among them."""
    return text.lower().split()


def ending(word: bytes) -> int:
    """Number of a word's ending, of its last three characters."""
    return zlib.crc32(word.strip(_EDGE).decode("utf-8", "replace")[-3:].encode()) % ENDINGS


def ending_class(word: str, classes: list[int]) -> Column:
    """Class of the ending of a word (binary column), the same endings as ending() has. classes: of each ending."""
    end = F.right(F.btrim(F.col(word).cast("string"), F.lit(_EDGE.decode())), F.lit(3))
    return F.get(F.array(*[F.lit(int(k)) for k in classes]), (F.crc32(end.cast("binary")) % ENDINGS).cast("int"))


class _Units(dict):
    """Unit of each word: its own, or that of its ending; the unit after all of these is the end."""

    def __missing__(self, word: bytes) -> int:
        return len(self) + ending(word)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit; the last unit, the end, has class 0 for itself, and units that don't occur go to class 1."""
    n = len(bigrams)
    c = bigrams.astype(np.float64)
    left, right = c.sum(0), c.sum(1)
    order = np.argsort(-left[: n - 1], kind="stable")
    cls = np.zeros(n, np.int64)
    cls[order] = np.arange(n - 1) % (classes - 1) + 1
    cls[: n - 1][left[: n - 1] + right[: n - 1] == 0] = 1
    hot = np.eye(classes)[cls]
    table = hot.T @ c @ hot
    for _ in range(rounds):
        moved = 0
        for w in order:
            if left[w] + right[w] == 0:
                continue
            old, own = cls[w], c[w, w]
            after = np.bincount(cls, c[w], classes)  # class that follows the unit
            before = np.bincount(cls, c[:, w], classes)
            after[old] -= own
            before[old] -= own
            table[old] -= after
            table[:, old] -= before
            table[old, old] -= own
            rows, cols, diag = table.sum(1), table.sum(0), np.diag(table)
            kept = xlogx(table)
            gain = (xlogx(table + after) - kept).sum(1) + (xlogx(table.T + before) - kept.T).sum(1)
            gain -= xlogx(diag + after) + xlogx(diag + before) - 2 * xlogx(diag)
            gain += xlogx(diag + after + before + own) - xlogx(diag)
            gain -= xlogx(rows + after.sum() + own) - xlogx(rows) + xlogx(cols + before.sum() + own) - xlogx(cols)
            gain[0] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            table[new] += after
            table[:, new] += before
            table[new, new] += own
            cls[w] = new
            moved += new != old
        if not moved:
            break
    return cls


@dataclass
class Model:
    """n, v: tokens and distinct tokens of training. head: counts of the frequent words. unseen: types that each class has
    room for; unknown_log: what each of them has instead of a discounted count. All logs are to base 10."""

    n: int
    v: int
    ends: int
    head: dict[bytes, int]
    unit_words: dict[bytes, int]
    classes: np.ndarray
    transition: np.ndarray
    class_log: np.ndarray
    unknown_log: np.ndarray
    unseen: np.ndarray
    discount: float
    least: int
    stopped: str = ""


def _count(docs: DataFrame, text: str) -> DataFrame:
    def run(batches):
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
            seen.clear()
            return out

        for b in batches:
            for t in texts(b, text):
                seen.update(tokens(t))
            if len(seen) > 250_000:
                yield flush()
        yield flush()
        trim()

    return docs.select(text).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class _Recording(_Units):
    """Units that note the words, in order, which have none of their own."""

    def __init__(self, words: dict[bytes, int]):
        super().__init__(words)
        self.missed: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.missed.append(word)
        return super().__missing__(word)


def _binary(rows: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary for each slice of rows (int32) that begins at one of starts, the last at the end."""
    offsets = np.append(starts, len(rows)).astype(np.int32) * (rows.itemsize * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """(items in each binary, all of them) of a binary column without nulls."""
    size = np.dtype(kind).itemsize
    if not len(column):
        return np.empty(0, np.int64), np.empty(0, kind)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return np.diff(offsets).astype(np.int64) // size, held.view(kind)


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of rows in each binary, all their rows of two int32) of a binary column."""
    lens, items = _flat(column, np.int32)
    return lens // 2, items.reshape(-1, 2)


def _summed(w: np.ndarray, x: np.ndarray, c: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one (w, x) made one, sorted."""
    key = w.astype(np.int64) * (2 * units) + x
    order = np.argsort(key, kind="stable")
    key, c = key[order], c[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key = key[first]
    return (key // (2 * units)).astype(np.int32), (key % (2 * units)).astype(np.int32), np.add.reduceat(c, first) if len(first) else c


def _marks(words: DataFrame) -> np.ndarray:
    """Bits of the words' CRC-32, modulo 2 ** MARK_BITS: 2 MB, whatever their number; a bit may be another word's, too."""
    bit = F.pmod(F.crc32("word"), F.lit(1 << MARK_BITS)).cast("int")
    got = words.select(bit.alias("bit")).selectExpr("shiftright(bit, 6) AS w", "shiftleft(1L, bit & 63) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (MARK_BITS - 6), np.int64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out


def _neighbours(docs: DataFrame, text: str, shared, marks, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """w, word, own, p: what is around each unit w, and around each word of LEAST_OWN occurrences or more beyond the head
    (its w is -1). p: rows of (unit, count), two int32 each; units before it have the number of units added. own: how often
    the unit follows itself. An end is before the first and after the last token of a text. marks: of the words beyond the
    head that occur often enough; the others' neighbours needn't be sent.

    Two stored tables, which together have a row for each: what is around the HOT most frequent words and the end is
    summed in two steps, over SALTS groups of tasks and then over these, for every task has counts of them.
    """

    number = len(shared.value) + ENDINGS + 1
    is_hot = (F.col("w") == number - 1) | F.col("w").between(0, min(HOT, len(shared.value)) - 1)

    def count(batches):
        unit = _Recording(shared.value)
        words, units = len(unit), len(unit) + ENDINGS + 1
        flat: list[int] = [units - 1]

        def flush():
            u = np.array(flat, np.int64)
            del flat[:-1]
            key, c = np.unique(u[:-1] * units + u[1:], return_counts=True)
            left, right = key // units, key % units
            w, x = np.concatenate([left, right]), np.concatenate([right, left + units])
            order = np.argsort(w, kind="stable")
            w, rows = w[order], np.stack([x[order], np.concatenate([c, c])[order]], 1).astype(np.int32)
            starts = np.flatnonzero(np.diff(w, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(w[starts], pa.int32()), pa.nulls(len(starts), pa.binary()), _binary(rows, starts)], names=["w", "word", "p"])
            at = np.flatnonzero((u >= words) & (u < units - 1))
            if len(at):
                bit = np.fromiter(map(zlib.crc32, unit.missed), np.int64, len(at)) & ((1 << MARK_BITS) - 1)
                often = np.flatnonzero(marks.value[bit >> 6] >> (bit & 63) & 1)
                at, missed = at[often], [unit.missed[j] for j in often.tolist()]
                unit.missed.clear()
                place = {x: i for i, x in enumerate(dict.fromkeys(missed))}
                i = np.fromiter(map(place.__getitem__, missed), np.int64, len(at))
                order = np.argsort(i, kind="stable")
                at = at[order]
                rows = np.stack([u[at + 1], u[at - 1] + units], 1).reshape(-1, 1)
                rows = np.concatenate([rows, np.ones_like(rows)], 1).astype(np.int32)
                starts = 2 * np.flatnonzero(np.diff(i[order], prepend=-1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), -1, np.int32)), pa.array(list(place), pa.binary()), _binary(rows, starts)], names=["w", "word", "p"])

        for b in batches:
            for t in texts(b, text):
                flat.extend(map(unit.__getitem__, tokens(t)))
                flat.append(units - 1)
            if len(flat) > 1_200_000:
                yield from flush()
        yield from flush()
        trim()

    def merge(batches):
        units, held, n, most, seldom = number, [], 0, 1_500_000, {}

        def summed():
            return _summed(*(np.concatenate(k) for k in zip(*held)), units)

        for b in batches:
            w = b.column("w").to_numpy()
            head = np.flatnonzero(w >= 0)
            lens, rows = _rows(b.column("p").take(pa.array(head)) if len(head) < len(w) else b.column("p"))
            held.append((np.repeat(w[head], lens), rows[:, 0].copy(), rows[:, 1].astype(np.int64)))
            n += len(rows)
            if len(head) < len(w):
                tail = b.take(pa.array(np.flatnonzero(w < 0)))
                for word, p in zip(tail.column("word").to_pylist(), tail.column("p").to_pylist()):
                    seldom[word] = seldom.get(word, b"") + p
            if n > most:  # what has come so far, counted: no more than the distinct neighbours of the task's words
                held = [summed()]
                n = len(held[0][0])
                most = max(most, 2 * n)
        if held:
            w, x, c = summed()
            held = []
            starts = np.flatnonzero(np.diff(w, prepend=-1))
            ends = np.append(starts[1:], len(w))
            own = np.zeros(len(w), np.int64)
            own[x == w] = c[x == w]
            own = np.add.reduceat(own, starts) if len(starts) else own
            rows = np.stack([x, np.minimum(c, 2**31 - 1)], 1).astype(np.int32)
            for i in range(0, len(starts), 64):
                s, e = starts[i : i + 64], ends[i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array(w[s], pa.int32()), pa.nulls(len(s), pa.binary()), pa.array(own[i : i + 64]), _binary(rows[s[0] : e[-1]], s - s[0])], names=["w", "word", "own", "p"])
        enough = [(x, p) for x, p in seldom.items() if len(p) >= 16 * LEAST_OWN]
        for i in range(0, len(enough), 512):
            part = enough[i : i + 512]
            yield pa.RecordBatch.from_arrays([pa.array([-1] * len(part), pa.int32()), pa.array([x for x, _ in part], pa.binary()), pa.array([0] * len(part), pa.int64()), pa.array([p for _, p in part], pa.binary())], names=["w", "word", "own", "p"])
        trim()

    found = docs.select(text).mapInArrow(count, "w int, word binary, p binary")
    n, shape = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "w int, word binary, own long, p binary"
    found = found.withColumn("salt", F.when(is_hot, F.spark_partition_id() % SALTS).otherwise(0)).repartition(n, "w", "word", "salt")
    first, rest = scratch.save_split(found.select("w", "word", "p").mapInArrow(merge, shape).withColumn("hot", is_hot), "hot", "neighbours")
    hot = scratch.save(first.select("w", "word", "p").repartition(max(1, n // 4), "w").mapInArrow(merge, shape), "hot-neighbours")
    scratch.drop(first)
    return rest, hot


def _start(around: DataFrame, words: int) -> np.ndarray:
    """Classes of all units: UNIT_WORDS words and the endings by exchange on the driver, other words -1."""
    units, first = words + ENDINGS + 1, min(words, UNIT_WORDS)
    small = first + ENDINGS + 1

    def run(batches):
        total = np.zeros(small * small, np.int64)
        of = lambda u: np.where(u >= words, u - words + first, np.where(u < first, u, -1))
        for b in batches:
            lens, rows = _rows(b.column("p"))
            x = rows[:, 0]
            w, k = of(np.repeat(b.column("w").to_numpy(), lens)), of(np.where(x < units, x, 0))
            ok = (x < units) & (k >= 0)
            np.add.at(total, w[ok].astype(np.int64) * small + k[ok], rows[ok, 1])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "c"])

    got = around.filter((F.col("w") >= words) | F.col("w").between(0, first - 1)).select("w", "p").mapInArrow(run, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    table = np.zeros(small * small)
    table[got.column("at").to_numpy()] = got.column("c").to_numpy()
    cls = exchange(table.reshape(small, small))
    out = np.full(units, -1, np.int64)
    out[:first], out[words:] = cls[:first], cls[first:]
    return out


def best_class(table: np.ndarray, m: np.ndarray, old: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The class in which each word gains most, the others staying: m[i] has counts of the classes after and before word i,
    with the own times that it follows itself; these are in the table with its old class, if that isn't -1."""
    n, classes = len(m), len(table)
    a, b, row = m[:, 0].copy(), m[:, 1].copy(), np.arange(n)
    has = row[old >= 0]
    a[has, old[has]] -= own[has]
    b[has, old[has]] -= own[has]
    a, b = np.maximum(a, 0), np.maximum(b, 0)
    gain = np.zeros((n, classes))
    for x, other, t in ((a, b, np.ascontiguousarray(table.T)), (b, a, table)):
        r, j = np.nonzero(x)
        if not len(r):
            continue
        v, o = x[r, j], old[r]
        term = t[j]
        term += v[:, None]
        term = xlogx(term)
        term -= xlogx(t)[j]
        # the word's own counts are not in the table's rest: in its old class, and where that class is its neighbour
        e = np.flatnonzero((o >= 0) & (j != o))
        rest = np.maximum(t[j[e], o[e]] - v[e], 0)
        term[e, o[e]] = xlogx(rest + v[e]) - xlogx(rest)
        e = np.flatnonzero(j == o)
        rest = t[j[e]] - other[r[e]]
        rest[np.arange(len(e)), o[e]] -= v[e] + own[r[e]]
        rest = np.maximum(rest, 0)
        term[e] = xlogx(rest + v[e, None]) - xlogx(rest)
        term[np.arange(len(r)), j] = 0
        first = np.flatnonzero(np.diff(r, prepend=-1))
        gain[r[first]] += np.add.reduceat(term, first, 0)
    took = np.zeros((n, classes))
    took[has, old[has]] = 1
    diag = np.maximum(np.diag(table) - took * (a + b + own[:, None]), 0)
    gain += xlogx(diag + a + b + own[:, None]) - xlogx(diag)
    for x, total in ((a, table.sum(1)), (b, table.sum(0))):
        w = (x.sum(1) + own)[:, None]
        rest = np.maximum(total - took * w, 0)
        gain -= xlogx(rest + w) - xlogx(rest)
    gain[:, 0] = -np.inf
    new = gain.argmax(1)
    stay = (old >= 0) & (gain[row, new] <= gain[row, old] + 1e-9)
    return np.where(stay, old, new)


def _around(lens: np.ndarray, rows: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Counts of the classes after and before each word: (words, 2, CLASSES). slot: of each unit, -1 for none."""
    k = slot[rows[:, 0]]
    at = np.repeat(np.arange(len(lens)) * 2 * CLASSES, lens) + k
    c = rows[:, 1]
    if len(k) and k.min() < 0:
        at, c = at[k >= 0], c[k >= 0]
    return np.bincount(at, c, len(lens) * 2 * CLASSES).reshape(len(lens), 2, CLASSES)


def _slots(cls: np.ndarray) -> np.ndarray:
    return np.concatenate([cls, np.where(cls < 0, -1, cls + CLASSES)]).astype(np.int64)


def _round(around: DataFrame, cls: np.ndarray, table: np.ndarray | None, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class bigrams under cls, new classes, what they change of the bigrams) of one round; without a table, nothing moves.

    The change is that of each moved word among the others' classes under cls.
    """
    units = len(cls)
    shared = around.sparkSession.sparkContext.broadcast((_slots(cls), table))

    def run(batches):
        slot, table = shared.value
        seen, change = np.zeros((CLASSES, CLASSES)), np.zeros((CLASSES, CLASSES))
        hot = np.eye(CLASSES)
        for b in batches:
            w = b.column("w").to_numpy()
            m = _around(*_rows(b.column("p")), slot)
            old = slot[w]
            there = old >= 0
            seen += hot[old[there]].T @ m[there, 0]
            if table is None:
                continue
            go = np.flatnonzero((w < units - 1) & (~there if turn < 0 else (w + turn) % 2 == 0))
            own = np.where(there, b.column("own").to_numpy(), 0)[go]
            new, was = best_class(table, m[go], old[go], own), old[go]
            moved = np.flatnonzero(new != was)
            new, was, own, m = new[moved], was[moved], own[moved], m[go[moved]]
            had = was >= 0
            m[had, 0, was[had]] -= own[had]
            m[had, 1, was[had]] -= own[had]
            to, fro = hot[new], np.where(had[:, None], hot[was], 0)
            change += (to - fro).T @ m[:, 0] + m[:, 1].T @ (to - fro) + np.diag(own @ (to - fro))
            yield pa.RecordBatch.from_arrays([pa.array(w[go][moved], pa.int32()), pa.array(new, pa.int32()), pa.nulls(len(moved), pa.binary())], names=["w", "k", "t"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), pa.array([np.stack([seen, change]).tobytes()], pa.binary())], names=["w", "k", "t"])

    total, out = np.zeros((2, CLASSES, CLASSES)), cls.copy()
    got = around.mapInArrow(run, "w int, k int, t binary").toArrow()
    w, k = got.column("w").to_numpy(), got.column("k").to_numpy()
    out[w[w >= 0]] = k[w >= 0]
    for t in got.column("t").to_pylist():
        if t is not None:
            total += np.frombuffer(t).reshape(2, CLASSES, CLASSES)
    shared.unpersist()
    return total[0], out, total[1]


def likelihood(table: np.ndarray) -> float:
    return float(xlogx(table).sum() - xlogx(table.sum(0)).sum() - xlogx(table.sum(1)).sum())


def _cluster(around: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, str]:
    """(classes of all units, class bigrams, why the rounds ended)."""
    cls = _start(around, words)
    around = around.filter("w >= 0").select("w", "own", "p")
    table, _, _ = _round(around, cls, None, 0)
    if (cls < 0).any():  # words that aren't among the first: the best class at their neighbours so far
        _, cls, change = _round(around, cls, table, -1)
        cls[cls < 0] = 1
        table = np.maximum(table + change, 0)
    best = None
    still, stopped = 0, f"after {ROUNDS} rounds"
    for turn in range(ROUNDS):
        seen, new, change = _round(around, cls, table, turn)
        if best is not None and likelihood(seen) <= likelihood(best[1]) and not still:
            stopped = "a round of moves gains nothing"
            break
        best = cls, seen
        still = still + 1 if (new == cls).all() else 0
        if still == 2:
            stopped = "no word moves"
            break
        cls, table = new, np.maximum(seen + change, 0)
    return *best, stopped


def _place(beyond: DataFrame, words: int, cls: np.ndarray, table: np.ndarray) -> DataFrame:
    """word, k: the best class of each word that has no unit of its own, by its neighbours."""
    given = beyond.sparkSession.sparkContext.broadcast((cls[words:], _slots(cls), table))

    def run(batches):
        of_ending, slot, table = given.value
        for b in batches:
            ws = b.column("word").to_pylist()
            old = of_ending[np.fromiter(map(ending, ws), np.int64, len(ws))]
            k = best_class(table, _around(*_rows(b.column("p")), slot), old, np.zeros(len(ws)))
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(k, pa.int32())], names=["word", "k"])
        trim()

    return beyond.select("word", "p").mapInArrow(run, "word binary, k int")


def fit(docs: DataFrame, scratch: Scratch, text: str = "text", head: int = HEAD) -> tuple[Model, DataFrame]:
    """(model, table of the counts of the words that are not in its head) of all docs; a null text has only its end."""
    model, rare = _learn(docs, scratch, text, head)
    return _with_transitions(model, _resolved(docs, model, rare, scratch, [], text)), rare


def fit_and_score(docs: DataFrame, training: Column, scratch: Scratch, keep: list[Column], text: str = "text", head: int = HEAD) -> tuple[Model, DataFrame]:
    """(model, scores) of a model that learns from the rows for which training holds, and scores all; see fit() and score().

    Words are looked up once for both.
    """
    model, rare = _learn(docs.filter(training), scratch, text, head)
    # of helper names that the kept columns don't have
    taken = set(docs.select(*keep).columns)
    flag = next(n for n in ("training" + "_" * i for i in range(len(taken) + 1)) if n not in taken)
    found = scratch.save(_resolved(docs, model, rare, scratch, [*keep, F.coalesce(training, F.lit(False)).alias(flag)], text), "resolved")
    model = _with_transitions(model, found.filter(F.col(flag)))
    return model, _scored(found.drop(flag), model)


def _learn(docs: DataFrame, scratch: Scratch, text: str, head: int) -> tuple[Model, DataFrame]:
    """(model without transitions, counts and classes of words beyond its head)."""
    small_batches(docs.sparkSession)
    vocabulary = scratch.save(_count(docs, text), "words")
    ends = docs.count()
    # counts by size, in bins of a sixteenth of a doubling above 256, to find how rare the head's words may be
    size = F.when(F.col("c") < 256, F.col("c")).otherwise(256 + F.floor(16 * F.log2(F.col("c") / 256)))
    bins = sorted(vocabulary.groupBy(size.alias("size")).agg(F.count("*"), F.sum("c"), F.min("c")).collect(), reverse=True)
    n, v = sum(r[2] for r in bins) + ends, sum(r[1] for r in bins) + (ends > 0)
    least, words = (bins[0][3] + 1 if bins else 1), 0
    for _, count, _, low in bins:
        words += count
        if words > head:
            break
        least = low
    known = {bytes(w): c for w, c in vocabulary.filter(F.col("c") >= least).collect()}
    ranked = sorted(known, key=lambda w: (-known[w], w))
    unit_words = {w: i for i, w in enumerate(w for w in ranked if known[w] >= LEAST_OWN)}
    shared = docs.sparkSession.sparkContext.broadcast(unit_words)
    beyond = vocabulary.filter(F.col("c") < least)
    marks = docs.sparkSession.sparkContext.broadcast(_marks(beyond.filter(F.col("c") >= LEAST_OWN)))
    rest, hot = _neighbours(docs, text, shared, marks, scratch)
    around = rest.unionByName(hot)
    cls, table, stopped = _cluster(around, len(unit_words))
    # in the head, words of less than LEAST_OWN occurrences stay with their endings, too
    placed = _place(rest.filter("w < 0"), len(unit_words), cls, table) if least > LEAST_OWN else docs.sparkSession.createDataFrame([], "word binary, k int")

    k = F.coalesce("k", ending_class("word", cls[len(unit_words) : -1]))
    rare = scratch.save(beyond.join(placed, "word", "left").select("word", "c", k.alias("k")), "rare")
    scratch.drop(rest, hot)
    unit = _Units(unit_words)
    types = np.bincount([cls[unit[w]] for w in known], minlength=CLASSES).astype(float) if known else np.zeros(CLASSES)
    for k, t in rare.groupBy("k").count().collect():
        types[k] += t
    by_size = {r[0]: r[1] for r in bins}
    once, twice = by_size.get(1, 0), by_size.get(2, 0)
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    # what an unseen type of a class has beside a count; a class that training hasn't seen has room for unseen types only
    unseen = np.maximum(2 * discount / (1 - discount) * np.where(types > 0, types, types.mean()), 1.0)
    unknown = np.log10(np.where(types > 0, discount * types, 1.0) / unseen)
    blank = np.zeros((CLASSES, CLASSES))
    return Model(n, v, ends, known, unit_words, cls, blank, np.zeros(CLASSES), unknown, unseen, discount, least, stopped), rare


def _with_transitions(model: Model, resolved: DataFrame) -> Model:
    table = _class_bigrams(resolved)
    total = table.sum(0)
    share = (total + 0.5) / (total.sum() + 0.5 * CLASSES)
    transition = np.log10((table + MIX * share) / (table.sum(1, keepdims=True) + MIX))
    return replace(model, transition=transition, class_log=np.where(total > 0, np.log10(np.maximum(total, 1)), 0.0))


def _steps(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of neighbouring classes, as left * CLASSES + right, of all documents; where each document's begin).

    An end is before the first and after the last token, so a document has one more of them than tokens.
    """
    path, at, found = (batch.column(c) for c in ("path", "at", "found"))
    lens, flat = _flat(path, np.uint8)
    holes = np.flatnonzero(flat == HOLE)
    k = flat.astype(np.int64)
    doc = np.repeat(np.arange(len(lens)), lens)
    if len(holes):
        sizes = pc.list_value_length(found).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        words = found.flatten()
        of = np.zeros(len(words), np.int64)
        of[np.repeat(first, sizes) + words.field("pos").to_numpy()] = words.field("k").to_numpy()
        k[holes] = of[first[doc[holes]] + _flat(at, np.int32)[1]]
    run = np.zeros(len(k) + len(lens) + 1, np.int64)  # an end between two documents is the last of one and the first of the other
    run[np.arange(len(k)) + 1 + doc] = k
    return run[:-1] * CLASSES + run[1:], np.cumsum(lens) - lens + np.arange(len(lens))


def _class_bigrams(resolved: DataFrame) -> np.ndarray:
    def run(batches):
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(_steps(b)[0], minlength=CLASSES * CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES * CLASSES)), pa.array(total)], names=["at", "c"])
        trim()

    table = np.zeros(CLASSES * CLASSES)
    for at, c in resolved.select("path", "at", "found").mapInArrow(run, "at long, c long").groupBy("at").agg(F.sum("c")).collect():
        table[at] = c
    return table.reshape(CLASSES, CLASSES)


def score(docs: DataFrame, model: Model, rare: DataFrame, scratch: Scratch, keep: list[Column], text: str = "text") -> DataFrame:
    """The kept columns of each document, n_tokens, n_known, base_score, score and perplexity.

    base_score: log10 probability under add-one smoothed word frequencies; score: under the model; perplexity: of a token
    under the model. Words beyond the head are looked up by a join with the table of their counts, each document's
    distinct ones once. Empty and null texts are scored for their end. Rows are told apart by their number, not doc_id.
    """
    return _scored(_resolved(docs, model, rare, scratch, keep, text), model)


def _scored(out: DataFrame, model: Model) -> DataFrame:
    shared = out.sparkSession.sparkContext.broadcast((model.transition, model.class_log))
    names = [f for f in out.schema.fields if f.name not in ("path", "at", "found")]

    def run(batches):
        transition, class_log = shared.value
        value = (transition - np.append(0.0, class_log[1:])).reshape(-1)  # the end is all of its class
        for b in batches:
            if b.num_rows:
                steps, starts = _steps(b)
                yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in names], pa.array(np.add.reduceat(value[steps], starts))], names=[*[f.name for f in names], "moves"])
        trim()

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)
    score_ = F.col("own") + F.col("moves")
    kept = [F.col(f"`{f.name}`") for f in names if f.name not in ("n_tokens", "n_known", "base_score", "own")]
    return out.mapInArrow(run, shape + ", moves double").select(*kept, "n_tokens", "n_known", "base_score", score_.alias("score"), F.pow(F.lit(10.0), -score_ / F.col("n_tokens")).alias("perplexity"))


def _resolved(docs: DataFrame, model: Model, rare: DataFrame, scratch: Scratch, keep: list[Column], text: str) -> DataFrame:
    """The kept columns, n_tokens, n_known, base_score, own (log10 of the words' discounted counts), and the path of classes:
    path (a byte a token, HOLE for words beyond the head), at (each hole's word) and found (the classes of these words)."""
    small_batches(docs.sparkSession)
    m, counts = model, np.fromiter(model.head.values(), np.float64, len(model.head))
    logs = np.append(np.log10(counts + 1), 0.0), np.append(np.log10(np.maximum(counts - m.discount, 1e-300)), 0.0)
    unit = _Units(m.unit_words)
    cls_of = np.append(m.classes[np.fromiter(map(unit.__getitem__, m.head), np.int64, len(counts))], HOLE).astype(np.uint8) if m.head else np.array([HOLE], np.uint8)
    n_ends, scale = m.ends, np.log10(m.n + m.v + 1)
    shared = docs.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(m.head)}, logs, cls_of))
    kept = docs.select(F.monotonically_increasing_id().alias("_row"), *keep, F.col(text).alias("_text"))
    fields = [f for f in kept.schema.fields if f.name != "_text"]

    def run(batches):
        at, (base_log, own_log), cls_of = shared.value
        end_base, missing = np.log10(n_ends + 1), len(at)
        for b in batches:
            docs_ = [tokens(t) for t in texts(b, "_text")]
            lens = np.fromiter(map(len, docs_), np.int64, len(docs_))
            ends = np.cumsum(lens)
            starts = ends - lens
            i = np.fromiter(map(at.get, chain.from_iterable(docs_), repeat(missing)), np.int64, int(lens.sum()))
            holes = np.flatnonzero(i == missing)
            bounds = np.searchsorted(holes, np.append(starts, len(i)))
            full = np.flatnonzero(lens)
            sums = np.zeros((2, len(docs_)))
            for side, log in enumerate((base_log, own_log)):
                if len(full):
                    sums[side, full] = np.add.reduceat(log[i], starts[full])
            words, often, sizes, spots = [], [], np.zeros(len(docs_), np.int64), []
            for d in np.flatnonzero(np.diff(bounds)).tolist():
                ws, first = docs_[d], int(starts[d])
                mine = [ws[j - first] for j in holes[bounds[d] : bounds[d + 1]].tolist()]
                seldom = Counter(mine)
                place = dict(zip(seldom, range(len(seldom))))
                spots.extend(map(place.__getitem__, mine))
                words.extend(seldom)
                often.extend(seldom.values())
                sizes[d] = len(seldom)
            tail_ = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(often, pa.int32())], ["word", "tf"]))
            cols = [
                pa.array(lens + 1), pa.array(lens - np.diff(bounds) + (n_ends > 0)), pa.array(sums[0] + end_base - (lens + 1) * scale), pa.array(sums[1]),
                _binary(cls_of[i].reshape(-1, 1), starts), _binary(np.array(spots, np.int32).reshape(-1, 1), bounds[:-1]), tail_,
            ]
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in fields] + cols, names=[f.name for f in fields] + ["n_tokens", "known", "base", "own", "path", "at", "tail"])
        trim()

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    part = scratch.save(kept.mapInArrow(run, shape + ", n_tokens long, known long, base double, own double, path binary, at binary, tail array<struct<word:binary,tf:int>>"), "parts")
    words = part.select("_row", F.posexplode("tail").alias("pos", "t")).select("_row", "pos", "t.word", "t.tf")
    words = words.join(rare, "word", "left").withColumn("k", F.coalesce("k", ending_class("word", m.classes[len(m.unit_words) : -1])))
    seen = F.col("c").isNotNull()
    unknown = F.get(F.array(*[F.lit(float(x)) for x in model.unknown_log]), F.col("k"))
    own = F.when(seen, F.log10(F.greatest(F.col("c") - model.discount, F.lit(1e-300)))).otherwise(unknown)
    sums = words.groupBy("_row").agg(
        F.sum(F.when(seen, F.col("tf")).otherwise(0)).alias("k2"), F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("b2"), F.sum(F.col("tf") * own).alias("s2"),
        F.collect_list(F.struct("pos", "k")).alias("found"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = part.drop("tail").join(sums, "_row", "left")
    names = [F.col(f"`{f.name}`") for f in fields if f.name != "_row"]
    return out.select(
        *names, "n_tokens", (F.col("known") + zero("k2")).alias("n_known"), (F.col("base") + zero("b2")).alias("base_score"),
        (F.col("own") + zero("s2")).alias("own"), "path", "at", "found",
    )
