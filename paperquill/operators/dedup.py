"""Exact and near-duplicate questions, unique ids, and leakage from a test set."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mcq import nfc_each
from ..functions.text import compare_key, jaccard, overlap, shingles

NEAR_DUP = 0.5
#: Questions that a task counts at once.
ROWS_AT_ONCE = 64
#: Test sets of at most so many grams, each counted once for a question, and questions are broadcast; larger ones are joined.
MAX_INDEX, MAX_QUESTIONS = 5_000_000, 50_000
#: Letters of a gram. Of fewer different ones than so many, its four fit a number of 64 bits.
K, MAX_LETTERS = 4, 50_000
#: Tables of grams by test questions of at most so many cells are multiplied with; else lists of questions are counted.
MAX_CELLS = 8_000_000


def keep_first(df: DataFrame, key: Column, order: Column | list[Column]) -> DataFrame:
    """The first row of each key in an order that has to be total; a null key is a key of its own.

    Keys are compared by their SHA-256. min_by over the whole row combines before the shuffle, so a key with very many rows
    is no burden to its task.
    """
    orders = order if isinstance(order, list) else [order]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    kept = df.groupBy(F.unhex(F.sha2(key.cast("binary"), 256)).alias("_key")).agg(F.min_by(row, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(orders)])).alias("_row"))
    return kept.select("_row.*")


def unique_ids(df: DataFrame, id_col: str, order: Column | list[Column], save: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The id of its second and later rows in order gets '#2', '#3', ...

    save: a function that stores a table. With it, rows are dealt by ranges of id and order, and an id's places are those
    within a range after all ranges before, so an id that very many rows share is not one task.
    """
    orders = order if isinstance(order, list) else [order]
    if save is None:
        n = F.row_number().over(Window.partitionBy(id_col).orderBy(*orders))
        rows = df.withColumn("_n", n)
    else:
        dealt = save(df.repartitionByRange(F.col(id_col), *orders).withColumn("_p", F.spark_partition_id()))
        ranges = dealt.groupBy(F.col(id_col).alias("_id"), F.col("_p").alias("_q")).agg(F.count("*").alias("_m"))
        so_far = Window.partitionBy("_id").orderBy("_q").rowsBetween(Window.unboundedPreceding, 0)
        ranges = ranges.withColumn("_before", F.sum("_m").over(so_far) - F.col("_m"))
        rows = dealt.join(ranges, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_p") == F.col("_q")))
        rows = rows.withColumn("_n", F.col("_before") + F.row_number().over(Window.partitionBy(id_col, "_p").orderBy(*orders))).drop("_p", "_id", "_q", "_m", "_before")
    return rows.withColumn(id_col, F.when(F.col("_n") > 1, F.concat(id_col, F.lit("#"), F.col("_n").cast("string"))).otherwise(F.col(id_col))).drop("_n")


def question_grams(df: DataFrame, with_nfc: bool = True) -> DataFrame:
    """df (question, choices) with qk and ak, keys of the question and of it with its options, sq and sa, the grams of these, and
    opts, the options' keys."""
    whole = F.concat("question", F.array_join("choices", ""))
    df = df.withColumn("_c", nfc_each(F.col("choices")) if with_nfc else F.col("choices"))
    return (
        df.withColumns({"qk": compare_key(F.col("question"), with_nfc), "ak": compare_key(whole, with_nfc)})
        .withColumns({"sq": shingles(F.col("qk")), "sa": shingles(F.col("ak"))})
        .withColumn("opts", F.array_distinct(F.transform("_c", lambda c: compare_key(c, False))))
        .drop("_c")
    )


def _grams(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(F.col(id_col), F.explode(F.array_union("sq", "sa")).alias("gram"))


def _coded(lists: pa.ListArray, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and code (place in known) of the known values of lists; a null list has none."""
    code = pc.index_in(lists.flatten(), value_set=known)
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    return row[code.is_valid().to_numpy(zero_copy_only=False)], code.drop_null().to_numpy()


def _windows(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and four code points of each gram of keys, repeats included. Keys hold letters and digits only; a shorter one is
    filled up with zeros, so it is a gram of its own."""
    keys = [k.ljust(K, "\0") for k in keys]
    n = np.fromiter(map(len, keys), np.int64, len(keys))
    points = np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32)
    at = _places(np.cumsum(n) - n, n - K + 1)
    return np.repeat(np.arange(len(keys)), n - K + 1), points[at[:, None] + np.arange(K)]


class GramCutter:
    """Cuts keys into grams and knows those of the test questions, by number."""

    def __init__(self, keys: list[str]):
        self.row, points = _windows(keys)
        self.known, self.code = np.unique(points, axis=0, return_inverse=True)
        self.code = self.code.reshape(-1)
        self.row, self.code = np.divmod(np.unique(self.row * len(self.known) + self.code), max(len(self.known), 1))
        self.sizes = np.bincount(self.row, minlength=len(keys))

    def __len__(self) -> int:
        return len(self.known)

    def cut(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and number of the known grams of keys, once a row, and how many different grams each key has."""
        row, points = _windows(keys)
        place = np.zeros(0x110000, np.int64)
        place[points[:, 0]] = 1
        place[points[row != np.append(row[1:], -1)]] = 1  # a row's last gram has the characters that begin none
        used = np.flatnonzero(place)
        place[used] = np.arange(1, len(used) + 1)
        a = len(used) + 1
        both = lambda p: (place[p[:, 0]] * a + place[p[:, 1]], place[p[:, 2]] * a + place[p[:, 3]])
        mine, theirs, wide = both(points), both(self.known), a * a
        usable = (place[self.known] > 0).all(1)
        if a > MAX_LETTERS:  # the number of a gram wouldn't fit 64 bits: halves are numbered first
            halves = np.unique(np.concatenate([*mine, *theirs]))
            mine, theirs, wide = [np.searchsorted(halves, x) for x in mine], [np.searchsorted(halves, x) for x in theirs], len(halves)
        grams, theirs = mine[0] * wide + mine[1], (theirs[0] * wide + theirs[1])[usable]
        ends = np.searchsorted(row, np.arange(len(keys) + 1))
        each = [_distinct(grams[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        grams, row = np.concatenate([*each, grams[:0]]), np.repeat(np.arange(len(keys)), sizes)
        order = np.argsort(theirs)
        theirs, number = theirs[order], np.flatnonzero(usable)[order]
        if not len(theirs):
            return row[:0], row[:0], sizes
        at = np.minimum(np.searchsorted(theirs, grams), len(theirs) - 1)
        found = theirs[at] == grams
        return row[found], number[at[found]], sizes


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class GramIndex:
    """Counts the grams that rows share with test questions. gram and dev: codes and places of the questions, once a pair."""

    def __init__(self, gram: np.ndarray, dev: np.ndarray, n_grams: int, n_devs: int):
        self.n_grams, self.n_devs, self.table = n_grams, n_devs, None
        if n_grams * n_devs <= MAX_CELLS:
            self.table = np.zeros((n_grams, n_devs), np.float32)
            self.table[gram, dev] = 1
        else:
            order = np.argsort(gram, kind="stable")
            self.posting, self.starts = dev[order].astype(np.int32), np.searchsorted(gram[order], np.arange(n_grams + 1))

    def count(self, row: np.ndarray, code: np.ndarray, n_rows: int) -> np.ndarray:
        """Of each row and question the number of codes that both have; a code of a row counts once."""
        if self.table is not None:
            held = np.zeros((n_rows, self.n_grams), np.float32)
            held[row, code] = 1
            return (held @ self.table).astype(np.int64)  # exact: no sum is beyond MAX_CELLS, which is less than 2 ** 24
        row, code = np.divmod(np.unique(row * self.n_grams + code), self.n_grams)
        first, lens = self.starts[code], self.starts[code + 1] - self.starts[code]
        counts = np.bincount(np.repeat(row, lens) * self.n_devs + self.posting[_places(first, lens)], minlength=n_rows * self.n_devs)
        return counts.reshape(n_rows, self.n_devs)


def _places(first: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, so many as lens says, one after the other."""
    ends = np.cumsum(lens)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - lens), lens)


def _best(counts: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place of the question, hits and rank from 0 of the top counts of each row; of equals the smaller place, no zeros."""
    best = np.argsort(-counts, axis=1, kind="stable")[:, :top]
    hits = np.take_along_axis(counts, best, 1)
    r, k = np.nonzero(hits)
    return r, best[r, k], hits[r, k], k


def shared_grams(probe: DataFrame, dev: DataFrame, probe_id: str, dev_id: str, top: int | None = 8) -> DataFrame:
    """(probe_id, dev_id, hits, rank): the test questions with the most grams in common with each question, of its own or its
    options; ties: the smaller dev_id. top: how many of them; None: all that share one.

    A test set whose grams fit MAX_INDEX is broadcast, and each task cuts, counts and ranks for its own questions, so nothing
    is shuffled. A larger one, or one of repeated ids, is joined by its grams.
    """
    d = _grams(dev, dev_id)
    size, n = d.count(), dev.agg(F.count("*"), F.count_distinct(dev_id)).first()
    if top is None or size > MAX_INDEX or n[0] > MAX_QUESTIONS or n[0] != n[1]:
        hits = _grams(probe, probe_id).join(d, "gram").groupBy(probe_id, dev_id).agg(F.count("*").alias("hits"))
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(probe_id).orderBy(F.desc("hits"), dev_id)))
        return hits if top is None else hits.filter(F.col("rank") <= top)
    known = dev.filter("qk is not null and ak is not null").select(dev_id, "qk", "ak").toArrow()  # at most MAX_QUESTIONS rows with MAX_INDEX grams
    shared = probe.sparkSession.sparkContext.broadcast(known)
    kinds = {c: t for c, t in [*probe.dtypes, *dev.dtypes]}

    def run(batches):
        ids, place = np.unique(shared.value.column(dev_id).to_numpy(zero_copy_only=False), return_inverse=True)
        cutter = GramCutter([*shared.value.column("qk").to_pylist(), *shared.value.column("ak").to_pylist()])
        index = GramIndex(cutter.code, np.concatenate([place, place])[cutter.row], len(cutter), len(ids))
        for part, counts, *_ in _counted(batches, cutter, index):
            r, q, hits, k = _best(counts, top)
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(r)), pa.array(ids[q]), pa.array(hits), pa.array((k + 1).astype(np.int32))], names=[probe_id, dev_id, "hits", "rank"])

    return _keys(probe, probe_id).mapInArrow(run, f"`{probe_id}` {kinds[probe_id]}, `{dev_id}` {kinds[dev_id]}, hits long, rank int")


def _keys(probe: DataFrame, probe_id: str, *more: str) -> DataFrame:
    """id, qk, other (ak where it is another than qk) and whether grams can be cut from both."""
    other = F.when(~F.col("qk").eqNullSafe(F.col("ak")), F.col("ak")).alias("other")
    usable = (F.col("qk").isNotNull() & F.col("ak").isNotNull()).alias("usable")
    return probe.select(F.col(probe_id).alias("id"), "qk", other, usable, *more)


def _counted(batches, cutter: GramCutter, index: GramIndex):
    """Rows of _keys() in parts, the grams that each has in common with each test question, and what was cut from qk and ak."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS_AT_ONCE):
            part = b.slice(at, ROWS_AT_ONCE)
            part = part.filter(part.column("usable"))
            asked = whole = cutter.cut(part.column("qk").to_pylist())
            row, code = asked[:2]
            if (differs := np.flatnonzero(part.column("other").is_valid().to_numpy(zero_copy_only=False))).size:
                more = cutter.cut(part.column("other").drop_null().to_pylist())
                alike = ~np.isin(row, differs)
                sizes = asked[2].copy()
                sizes[differs] = more[2]
                row, code = np.concatenate([row, differs[more[0]]]), np.concatenate([code, more[1]])
                whole = np.concatenate([asked[0][alike], differs[more[0]]]), np.concatenate([asked[1][alike], more[1]]), sizes
            yield part, index.count(row, code, part.num_rows), asked, whole


class _Lists:
    """Sets of the test questions, in codes, for how many values pairs of a row and a question have in common."""

    def __init__(self, row: np.ndarray, code: np.ndarray, n_rows: int, n_codes: int):
        self.code, self.n, self.starts = code, max(n_codes, 1), np.searchsorted(row, np.arange(n_rows + 1))
        self.sizes = np.diff(self.starts)

    def common(self, row: np.ndarray, code: np.ndarray, r: np.ndarray, q: np.ndarray) -> np.ndarray:
        """row and code: what the rows hold; r and q: the pairs."""
        held = np.unique(row * self.n + code)
        lens = self.starts[q + 1] - self.starts[q]
        asked = np.repeat(r, lens) * self.n + self.code[_places(self.starts[q], lens)]
        at = np.searchsorted(held, asked)
        inside = at < len(held)
        inside[inside] = held[at[inside]] == asked[inside]
        return np.bincount(np.repeat(np.arange(len(r)), lens)[inside], minlength=len(r))


def _ruled(probe: DataFrame, dev: pa.Table, probe_id: str, dev_id: str, top: int, near: float, kinds: dict[str, str]) -> DataFrame:
    """(probe_id, dev_id, rank, rule, similarity): the first of each row's test questions for which a rule of test_overlap
    holds, all in the task that has the row, so its grams are neither shuffled nor repeated for each test question.

    dev: dev_id, which is unique, and qk, ak and opts, which the tasks get whole.
    """
    usable = pc.and_(dev.column("qk").is_valid(), dev.column("ak").is_valid())
    shared = probe.sparkSession.sparkContext.broadcast(dev.filter(usable).sort_by(dev_id).combine_chunks())

    def run(batches):
        ids, d_opts = (pa.concat_arrays(shared.value.column(c).chunks) for c in (dev_id, "opts"))
        qk, ak = (shared.value.column(c).to_pylist() for c in ("qk", "ak"))
        n = len(ids)
        cutter, options = GramCutter(qk + ak), pc.unique(d_opts.flatten())
        first = cutter.row < n
        sq, sa = _Lists(cutter.row[first], cutter.code[first], n, len(cutter)), _Lists(cutter.row[~first] - n, cutter.code[~first], n, len(cutter))
        opts = _Lists(*_coded(d_opts, options), n, len(options))
        index = GramIndex(cutter.code, cutter.row % n, len(cutter), n)
        one = qk == ak  # then, and if it is so of the rows, what is in common is counted already
        for part, counts, asked, whole in _counted(batches, cutter, index):
            r, q, hits, k = _best(counts, top)
            in_sq, in_sa = (hits, hits) if one and whole is asked else (sq.common(*asked[:2], r, q), sa.common(*whole[:2], r, q))
            a_sq, a_sa = asked[2][r], whole[2][r]
            similar = in_sa / np.maximum(a_sa + sa.sizes[q] - in_sa, 1)
            same_text = in_sq / np.maximum(a_sq + sq.sizes[q] - in_sq, 1) >= 0.8
            within = (in_sq / np.maximum(np.minimum(a_sq, sq.sizes[q]), 1) >= 0.8) & (a_sq >= 15)
            rule = np.where(similar >= near, 1, 0)
            if len(doubt := np.flatnonzero((rule == 0) & (same_text | within))):
                same = opts.common(*_coded(part.column("opts"), options), r[doubt], q[doubt])
                rule[doubt] = np.where(same_text[doubt] & (same >= 1), 2, np.where(within[doubt] & (same >= 2), 3, 0))
            found = np.flatnonzero(rule)
            found = found[np.unique(r[found], return_index=True)[1]]  # pairs are in the order of rows and ranks
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(r[found])), ids.take(pa.array(q[found])), pa.array((k[found] + 1).astype(np.int32)), pa.array(rule[found].astype(np.int32)), pa.array(similar[found])],
                names=[probe_id, dev_id, "rank", "rule", "similarity"],
            )

    rows = _keys(probe.filter(F.col(probe_id).isNotNull()), probe_id, "opts")
    return rows.mapInArrow(run, f"`{probe_id}` {kinds[probe_id]}, `{dev_id}` {kinds[dev_id]}, rank int, rule int, similarity double")


def test_overlap(probe: DataFrame, dev: DataFrame, probe_id: str = "id", dev_id: str = "dev_id", top: int | None = 8, near: float = NEAR_DUP) -> DataFrame:
    """(probe_id, dev_id, reason) of each probe question that is one of the test set.

    Both sides need the columns of question_grams. top: only so many test questions with the most shared grams (ties:
    the smaller dev_id) are looked at; None looks at all that share a gram. The first of them in that order for which a
    rule holds counts; for it, the first rule: similar with options; the same question and an option; the question inside
    a longer one and two options. A test set that fits MAX_INDEX goes to the tasks, which apply the rules as they rank.
    """
    kinds = {c: t for c, t in [*probe.dtypes, *dev.dtypes]}
    about = lambda x: F.concat(F.lit("near-duplicate of a test question (similarity "), F.format_string("%.2f", x), F.lit(")"))
    second, third = "same question text as a test question", "test question with extra words around it"
    known = dev.filter(F.col(dev_id).isNotNull())
    held = known.agg(F.count("*"), F.count_distinct(dev_id), F.sum(F.size(F.array_union("sq", "sa")))).first()
    if top is not None and 0 < held[0] == held[1] <= MAX_QUESTIONS and 0 < (held[2] or 0) <= MAX_INDEX:
        pair = _ruled(probe, known.select(dev_id, "qk", "ak", "opts").toArrow(), probe_id, dev_id, top, near, kinds)
        reason = F.when(F.col("rule") == 1, about(F.col("similarity"))).when(F.col("rule") == 2, second).otherwise(third)
    else:
        hits = shared_grams(probe, dev, probe_id, dev_id, top)
        d = dev.select(dev_id, F.col("sq").alias("d_sq"), F.col("sa").alias("d_sa"), F.col("opts").alias("d_opts"))
        pair = hits.join(d, dev_id).join(probe.select(probe_id, "sq", "sa", "opts"), probe_id)
        same = F.size(F.array_intersect("opts", "d_opts"))
        near_text = jaccard(F.col("sa"), F.col("d_sa"))
        reason = (
            F.when(near_text >= near, about(near_text))
            .when((jaccard(F.col("sq"), F.col("d_sq")) >= 0.8) & (same >= 1), second)
            .when((overlap(F.col("sq"), F.col("d_sq")) >= 0.8) & (F.size("sq") >= 15) & (same >= 2), third)
        )
    found = pair.withColumn("reason", reason).filter("reason is not null")
    return found.groupBy(probe_id).agg(F.min_by(F.struct(dev_id, "reason"), "rank").alias("r")).select(probe_id, f"r.{dev_id}", "r.reason")
