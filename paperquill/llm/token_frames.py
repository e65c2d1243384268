"""Token-id files: independent zstandard frames, a document index and a trailing seek table.

A shard is a file of
- zstandard frames, each of whole documents: their ids as little-endian unsigned 32-bit integers, about FRAME_IDS of
  them (a longer document has a frame of its own);
- one skippable frame (magic 0x184D2A5D) with the document index: for each document its doc_id (int64, the smallest
  value for null), frame number, offset in the frame and length in ids (all int64), compressed;
- the seek table of the zstandard seekable format: a skippable frame (magic 0x184D2A5E) with compressed size,
  decompressed size and checksum (low 32 bits of XXH64 of the decompressed bytes) of each frame, then the footer.
A plain zstandard decoder reads the file as one stream of ids, for it skips the index and the table. A reader that wants
some documents reads the footer, the table and the index, and decompresses only the frames that hold them.
"""

from __future__ import annotations

import posixpath
import re
import struct
import uuid
import zlib
from itertools import chain, repeat
from json import loads

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import gather, small_batches, texts

FRAME_IDS = 1 << 18
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
NO_ID = np.iinfo(np.int64).min
REMEMBERED = 1_000_000
#: Printable characters up to U+024F: none of them combines, and each is lowered by itself.
PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]*").fullmatch
ASCII = bytes(range(128))
LETTERS = re.compile(rb"(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*").fullmatch
RUN = re.compile(rb"[^A-Za-z0-9\s\x80-\xbf][.,][ \n]").search
#: The printable characters that byte-level models write bytes as: printable ones stand for themselves, the rest follow from U+0100.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: b if b in _PRINTABLE else 256 + b - sum(p < b for p in _PRINTABLE) for b in range(256)}


class ChunkEncoder:
    """A tokenizer that drops white space, run once for each distinct chunk between ASCII white space.

    The chunks of Latin script, which are nearly all, are cut by the tokenizer's own pattern, and its model is asked
    once for each distinct piece; other chunks, and those that may hold a special token, go to the whole tokenizer.
    """

    def __init__(self, json: str, end_id: int | None):
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_str(json), end_id
        self.model = self.tokenizer.model
        steps = loads(json)
        kinds = [x["type"] for x in (steps["normalizer"] or {}).get("normalizers", [])], [x["type"] for x in (steps["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.latin = None
        if kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and not steps["post_processor"]:
            self.latin = regex.compile(steps["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.pieces: dict[str, list[int]] = {}
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.starts, self.lens = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        if self.end is not None:  # white space can't be a chunk, so this one stands for the end
            self._learn([b" "], [[self.end]])

    def _learn(self, chunks: list[bytes], ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks))))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.lens = np.concatenate([self.lens, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])

    def _ids(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(BYTE_CHARS))]

    def _piece(self, piece: str) -> list[int]:
        got = self.pieces.get(piece)
        if got is None:
            if len(self.pieces) >= 100_000:
                self.pieces.clear()
            got = self.pieces[piece] = self._ids(piece)
        return got

    def _chunk(self, chunk: bytes) -> list[int]:
        if self.latin is not None and chunk.isalpha():  # ASCII letters, which stand for themselves
            return [t.id for t in self.model.tokenize(chunk.decode().lower())]
        text = chunk.decode()
        if self.latin is None or "<|" in text or not PLAIN(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        parts = self.latin(text.lower())
        return self._ids(parts[0]) if len(parts) == 1 else [i for p in parts for i in self._piece(p)]

    @staticmethod
    def _apart(doc: bytes) -> bytes:
        """The text in lower case with a space before a comma or full stop at a word's end, where that changes no id:
        all that isn't ASCII are Latin-1 letters, and each of these marks follows a letter, digit or space."""
        if b"<|" in doc or not LETTERS(doc.translate(None, ASCII)) or RUN(doc):
            return doc
        doc = doc.lower()
        for mark in (b", ", b". ", b",\n", b".\n"):
            doc = doc.replace(mark, b" " + mark)
        return doc

    def encode(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the documents, with the end id where there is one."""
        parts = [(self._apart(d) if self.latin is not None else d).split() for d in docs]
        if self.end is not None:
            for p in parts:
                p.append(b" ")
        chunks = list(chain.from_iterable(parts))
        at = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        miss = np.flatnonzero(at < 0)
        if len(miss):
            strange = [chunks[i] for i in miss.tolist()]
            new = list(dict.fromkeys(strange))
            if len(self.known) + len(new) > REMEMBERED:
                self.forget()
                new, strange, miss = list(dict.fromkeys(c for c in chunks if c not in self.known)), chunks, slice(None)
            self._learn(new, [self._chunk(c) for c in new])
            at[miss] = np.fromiter(map(self.known.__getitem__, strange), np.int64, len(strange))
        lens = self.lens[at]
        ends = np.concatenate([[0], np.cumsum(lens)])
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return ends[bounds], gather(self.flat, self.starts[at], lens)


def open_fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard under a name of its own and renames it at the end, so that a repeated task does no harm."""

    def __init__(self, folder: str, shard: int, level: int = 3, frame_ids: int | None = None):
        self.frame_ids = frame_ids or FRAME_IDS
        self.fs, root = open_fs(folder)
        self.fs.create_dir(root)
        self.name = f"shard-{shard:06d}.zst"
        self.final = posixpath.join(root, self.name)
        self.part = posixpath.join(root, f".{self.name}.{uuid.uuid4().hex}")
        self.out = self.fs.open_output_stream(self.part)
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.table, self.index, self.held, self.n_held = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.n_held and self.n_held + len(ids) > self.frame_ids:
            self._frame()
        self.index.append((NO_ID if doc_id is None else doc_id, len(self.table), self.n_held, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)

    def _frame(self) -> None:
        raw = np.concatenate(self.held).astype("<u4").tobytes()
        packed = self.zstd.compress(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.n_held = [], 0

    def abort(self) -> None:
        """Remove what was written, after a failure."""
        self.out.close()
        self.fs.delete_file(self.part)

    def close(self) -> None:
        if self.held:
            self._frame()
        index = self.zstd.compress(np.array(self.index, "<i8").reshape(-1, 4).T.tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        # the index is a frame too, of no decompressed bytes
        rows = b"".join(struct.pack("<III", *x) for x in [*self.table, (len(index) + 8, 0, 0)])
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(rows) + 9) + rows)
        self.out.write(struct.pack("<IBI", len(self.table) + 1, 0x80, FOOTER_MAGIC))
        self.out.close()
        self.fs.move(self.part, self.final)


class ShardReader:
    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise ValueError(f"{uri} has no seek table with checksums")
        rows = self.file.read_at(12 * n, size - 9 - 12 * n)
        self.table = np.frombuffer(rows, "<u4").reshape(-1, 3).astype(np.int64)
        self.at = np.cumsum(self.table[:, 0]) - self.table[:, 0]
        raw = self.file.read_at(int(self.table[-1, 0]) - 8, int(self.at[-1]) + 8)
        self.index = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<i8").reshape(4, -1)
        self.frames_read = 0

    def frame(self, k: int) -> np.ndarray:
        packed, size, check = (int(x) for x in self.table[k])
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, int(self.at[k])), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} does not have the checksum that the seek table gives")
        self.frames_read += 1
        return np.frombuffer(raw, "<u4")

    def documents(self, wanted: set[int] | None = None):
        """(doc_id, offset in the shard, ids) in the order of the file, of all or the wanted documents."""
        ids, frames, offsets, lens = self.index
        starts = np.cumsum(lens) - lens
        take = range(len(ids)) if wanted is None else np.flatnonzero(np.isin(ids, list(wanted)))
        held, frame = -1, np.empty(0, "<u4")
        for i in take:
            if frames[i] != held:
                held, frame = int(frames[i]), self.frame(int(frames[i]))
            yield None if ids[i] == NO_ID else int(ids[i]), int(starts[i]), frame[offsets[i] : offsets[i] + lens[i]]


_encoders: dict[tuple[int, int | None], ChunkEncoder] = {}


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None, shards: int, doc_id: str = "doc_id", text: str = "text", frame_ids: int | None = None) -> DataFrame:
    """Encode docs and write them in ascending doc_id order to shards of a folder that driver and executors share.

    Returns one row per shard: shard, name, n_docs, n_tokens. Nulls: a null text is empty (only the end id), a null
    doc_id sorts first. Rows with equal doc_id (or none) have the order of the first characters of their texts, and may be
    in several shards. An empty table gives no shard. frame_ids: ids of a frame at most (FRAME_IDS by default), but for longer
    documents; a reader of one document decompresses its frame, about 1 MB by default.
    """
    small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        json = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        key = hash(json.value), end_id
        if key not in _encoders:
            _encoders[key] = ChunkEncoder(json.value, end_id)
        shard, writer, n_docs, n_tokens = TaskContext.get().partitionId(), None, 0, 0
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                writer = writer or ShardWriter(folder, shard, frame_ids=frame_ids)
                offsets, ids = _encoders[key].encode(texts(b, "text"))
                for i, d in enumerate(b.column("doc_id").to_pylist()):
                    writer.add(d, ids[offsets[i] : offsets[i + 1]])
                n_docs, n_tokens = n_docs + b.num_rows, n_tokens + len(ids)
            if writer:
                writer.close()
        except BaseException:
            if writer:
                writer.abort()
            raise
        if writer:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "name": pa.array([writer.name]), "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    begin = F.left("text", F.lit(16))
    rows = rows.withColumn("begin", begin).withColumn("row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(shards, "doc_id", "begin", "row").sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    return ordered.mapInArrow(run, "shard long, name string, n_docs long, n_tokens long")


def read_shards(manifest: DataFrame, folder: str, wanted: set[int] | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it, in file order), n_tokens, crc and ids of the documents of all shards.

    manifest: what write_shards returned, written to a table. It has a row for each shard, so the shards' offsets are
    summed on the driver; documents stay on the executors. crc: crc32 of the
    ids as stored. with_ids: whether the ids themselves are returned.
    """
    total, offset = 0, {}
    for shard, n in manifest.select("shard", "n_tokens").orderBy("shard").collect():
        offset[shard], total = total, total + n
    spark = manifest.sparkSession
    spots = spark.sparkContext.broadcast(offset)
    names, kinds = ["doc_id", "start", "n_tokens", "crc"], [pa.int64()] * 4
    if with_ids:
        names, kinds = [*names, "ids"], [*kinds, pa.list_(pa.int64())]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        for b in batches:
            for shard, name in zip(b.column("shard").to_pylist(), b.column("name").to_pylist()):
                held, n = [], 0
                for doc, at, ids in ShardReader(f"{folder}/{name}").documents(wanted):
                    held.append((doc, spots.value[shard] + at, len(ids), zlib.crc32(ids), *([ids] if with_ids else [])))
                    n += len(ids)
                    if n >= FRAME_IDS:
                        yield batch(held)
                        held, n = [], 0
                if held:
                    yield batch(held)

    one_each = manifest.select("shard", "name").repartitionByRange(max(1, len(offset)), "shard")
    return one_each.mapInArrow(run, "doc_id long, start long, n_tokens long, crc long" + ", ids array<long>" * with_ids)
