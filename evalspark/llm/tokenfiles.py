"""Token-id output in binary files of patched frame-of-reference blocks.

Texts are encoded with a public tokenizer file (a parameter, loaded once per
Python worker), each followed by an end id, and written in ascending id order:
the rows are range-partitioned by ``doc_id`` and one file is written per
partition by Spark's own writer and commit protocol, so a lost executor only
repeats its tasks and any file system that Spark writes to will do.

File format, little endian.  A file is a sequence of records, each
``u32 length, payload, 0x0A`` (the line end is the writer's):

* ``H``  u32 shard number
* ``B``  block: u32 ids in it, u32 minimum, u8 width, u32 exceptions, packed
  64-bit words (``64 // width`` values each), exception positions (u32) and values (u32).
  The minimum of the block is subtracted, the width is the bits of the
  ``percentile`` of the rest, and values that need more are kept as exceptions
* ``D``  document table: u32 rows, ids (i64), null flags (u8), token counts (u32)
* ``I``  index: u32 blocks, byte offset of each block record (u64), first id of each (u64)

Defined results: a null or empty text is the end id alone; null ids sort
first; rows with equal ids are ordered by text; other columns are not read;
an empty table gives no file rows.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.llm import common

END_ID = 2
BLOCK = 4096                 # ids per block
PERCENTILE = 0.9             # share of a block's values that its width covers
FLUSH_BLOCKS = 64            # blocks packed at once
MEMO_PIECES = 1_300_000       # pieces remembered per worker (about 200 bytes each) before the long ones are forgotten
SHORT_PIECE = 9
SLICE_ROWS = 200             # rows of an Arrow batch that are Python objects at a time
SLICE_CHARS = 4_000_000      # of texts that are cut into pieces together

#: Texts of these characters only are cut into pieces here: on them the cut is the
#: same in every regex library.  Any other text goes to the tokenizer whole.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*+")
_CUT = re.compile(r"(?<=[a-z]) (?=[a-z])")
#: Classes of their characters.
_LETTER, _DIGIT, _WHITE, _SIGN = range(4)
_PLAIN_END = 0x250
_CLASS = np.array([_WHITE if re.match(r"\s", c) else _DIGIT if re.match(r"\d", c) else _LETTER if re.match(r"[^\W_]", c) else _SIGN
                   for c in map(chr, range(_PLAIN_END))], np.uint8)
_BYTE_CLASS = np.concatenate([_CLASS[:128], np.full(128, _SIGN, np.uint8)]).tobytes()     # as a table of ``bytes.translate``
#: The characters that stand for bytes in the names of byte-level tokens.
_KEPT = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = dict(zip(_KEPT, _KEPT, strict=True)) | {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)).difference(_KEPT)))}


def _piece_starts(data: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
    """First bytes of the pieces of plain texts in UTF-8 that stand one behind the other: letters, digits or other
    signs with a space before them, contractions, white space without the character before the next piece."""
    size = len(data)
    kind = np.frombuffer(bytearray(data.tobytes().translate(_BYTE_CLASS)), np.uint8)
    lead = np.flatnonzero(data >= 0xC0)                      # plain characters have two bytes at most
    if len(lead):
        kind[lead] = kind[lead + 1] = _CLASS[(data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F]
    is_row = np.zeros(size + 3, bool)
    is_row[row_starts[row_starts < size]] = True
    begins = np.empty(size, bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= is_row[:size]
    # The last white space of a run begins a piece of its own; a space goes with what is behind it.
    white = kind == _WHITE
    after = np.flatnonzero(white[:-1] & ~white[1:] & ~is_row[1:size]) + 1
    last = after - 1 - ((data[after - 1] & 0xC0) == 0x80)
    begins[last] = True
    begins[after[data[last] == 0x20]] = False
    # 's, 't, 'm, 'd, 're, 've and 'll where a piece begins.
    quote = np.flatnonzero(data == 0x27)
    quote = quote[begins[quote]]
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    one, two = padded[quote + 1], padded[quote + 2]
    short = ((one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))) & ~is_row[quote + 1]
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    long &= ~is_row[quote + 1] & ~is_row[quote + 2]
    begins[quote[short | long] + 1] = False
    behind = np.concatenate([quote[short] + 2, quote[long] + 3])
    begins[behind[behind < size]] = True
    return np.flatnonzero(begins)


def _parts(text: str) -> Iterator[str]:
    """A long text in parts, cut where a piece begins whatever stands before it."""
    begin = 0
    while len(text) - begin > SLICE_CHARS and (cut := _CUT.search(text, begin + SLICE_CHARS)):
        yield text[begin:cut.start()]
        begin = cut.start()
    yield text[begin:]


class PieceEncoder:
    """Ids of texts as little-endian u32 bytes, equal to the tokenizer's on the whole text.

    Byte-level BPE never merges across pieces, so the ids of a text are the ids
    of its pieces in a row; the plain texts of a slice are cut with array
    operations, and each distinct piece is merged once by the tokenizer's model
    and remembered.  Texts that hold a special token's string or a
    character outside the plain range are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[bytes, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, pieces: list[bytes]) -> None:
        """Ids of pieces: the tokenizer's model merges them as they are, unless it changes texts before it cuts them."""
        if self.tokenizer.normalizer is not None:
            self.memo.update(zip(pieces, self._whole([p.decode() for p in pieces]), strict=True))
            return
        merge = self.tokenizer.model.tokenize
        for piece in pieces:
            self.memo[piece] = array("I", [t.id for t in merge(piece.decode("latin-1").translate(_BYTE_CHARS))]).tobytes()

    def _make_room(self) -> None:
        """Forget the long pieces, which are the rare ones; all, if that is not enough."""
        self.memo = {p: ids for p, ids in self.memo.items() if len(p) <= SHORT_PIECE}
        if len(self.memo) > MEMO_PIECES // 2:
            self.memo = {}

    def _in_pieces(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of plain texts, whose distinct pieces are looked up once."""
        raw = [t.encode() for t in texts]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        data = b"".join(raw)
        if not data:
            yield from raw
            return
        starts = _piece_starts(np.frombuffer(data, np.uint8), np.concatenate([[0], ends[:-1]]))
        offsets = np.append(starts, len(data)).astype(np.int32)
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        own, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        cuts = np.frombuffer(distinct.buffers()[1], np.int32, len(distinct) + 1).tolist()
        pieces = list(map(distinct.buffers()[2].to_pybytes().__getitem__, map(slice, cuts, cuts[1:])))
        ids = list(map(self.memo.get, pieces))
        if None in ids:
            if len(self.memo) > MEMO_PIECES:
                self._make_room()
                ids = list(map(self.memo.get, pieces))
            self._learn([p for p, i in zip(pieces, ids, strict=True) if i is None])
            ids = list(map(self.memo.__getitem__, pieces))
        known, length = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        count = length[own]
        to = np.cumsum(count)
        every = known[np.repeat((np.cumsum(length) - length)[own] - (to - count), count) + np.arange(to[-1])].tobytes()
        cuts = (4 * np.concatenate([[0], to])[np.searchsorted(starts, ends)]).tolist()
        yield from (every[a:b] for a, b in zip([0, *cuts], cuts, strict=False))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        waiting, size = [], 0
        for text in texts:
            if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
                yield from self._in_pieces(waiting)
                waiting, size = [], 0
                yield self._whole([text])[0]
                continue
            if len(text) > 2 * SLICE_CHARS:
                yield from self._in_pieces(waiting)
                waiting, size = [], 0
                yield b"".join(ids for part in _parts(text) for ids in self._in_pieces([part]))
                continue
            waiting.append(text)
            size += len(text)
            if size >= SLICE_CHARS:
                yield from self._in_pieces(waiting)
                waiting, size = [], 0
        yield from self._in_pieces(waiting)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _bits(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """Payloads of the blocks of ``ids`` (u32); all blocks but the last are full."""
    out: list[bytes] = []
    full = len(ids) // BLOCK * BLOCK
    for part in (ids[:full].reshape(-1, BLOCK), ids[full:].reshape(1, -1)):
        if part.size == 0:
            continue
        low = part.min(axis=1)
        rest = part - low[:, None]
        n = part.shape[1]
        at = min(n - 1, int(np.ceil(percentile * n)) - 1)
        widths = np.maximum(1, _bits(np.partition(rest, at, axis=1)[:, at]))
        for k in range(len(part)):
            w = int(widths[k])
            values = rest[k]
            odd = np.flatnonzero(values >= (1 << w)) if w < 32 else np.empty(0, np.int64)
            per = 64 // w
            lanes = np.zeros(-(-n // per) * per, np.uint64)
            lanes[:n] = values
            lanes[odd] = 0
            words = np.bitwise_or.reduce(lanes.reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(w)), axis=1)
            out.append(b"B" + struct.pack("<IIBI", n, int(low[k]), w, len(odd)) + words.astype("<u8").tobytes()
                       + odd.astype("<u4").tobytes() + values[odd].astype("<u4").tobytes())
    return out


def unpack_block(payload: memoryview) -> np.ndarray:
    n, low, w, odd = struct.unpack_from("<IIBI", payload, 1)
    at, per = 1 + struct.calcsize("<IIBI"), 64 // w
    words = np.frombuffer(payload, "<u8", -(-n // per), at)
    at += words.nbytes
    lanes = (words[:, None] >> (np.arange(per, dtype=np.uint64) * np.uint64(w))) & np.uint64((1 << w) - 1)
    ids = lanes.reshape(-1)[:n].astype(np.uint32)
    where = np.frombuffer(payload, "<u4", odd, at)
    ids[where] = np.frombuffer(payload, "<u4", odd, at + where.nbytes)
    return ids + np.uint32(low)


def _record(payload: bytes) -> bytes:
    return struct.pack("<I", len(payload)) + payload


def _encoded(batch: pa.RecordBatch, codec: PieceEncoder) -> Iterator[tuple[int | None, bytes]]:
    rows = max(1, min(SLICE_ROWS, SLICE_CHARS * batch.num_rows // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield from zip(part.column(0).to_pylist(), codec.encode([t or "" for t in part.column(1).to_pylist()]), strict=True)


def _write_partition(batches: Iterator[pa.RecordBatch], path: str, end_id: int, percentile: float) -> Iterator[pa.RecordBatch]:
    codec, end = encoder(path), np.array([end_id], "<u4").tobytes()
    waiting, n_waiting, n_done, at = [], 0, 0, 0
    doc_ids, nulls, counts, starts, firsts = [], [], [], [], []

    def rows(payloads: list[bytes]) -> pa.RecordBatch:
        nonlocal at
        records = [_record(p) for p in payloads]
        at += sum(len(r) + 1 for r in records)
        return pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["value"])

    def pack(whole: bool) -> Iterator[pa.RecordBatch]:
        nonlocal waiting, n_waiting, n_done
        ids = np.frombuffer(b"".join(waiting), "<u4")
        take = len(ids) if whole else len(ids) // BLOCK * BLOCK
        for payload in pack_blocks(ids[:take], percentile):
            starts.append(at)
            firsts.append(n_done)
            n_done += struct.unpack_from("<I", payload, 1)[0]
            yield rows([payload])
        waiting, n_waiting = [ids[take:].tobytes()], len(ids) - take

    first = True
    for batch in batches:
        if batch.num_rows and first:
            yield rows([b"H" + struct.pack("<I", TaskContext.get().partitionId())])
            first = False
        for key, ids in _encoded(batch, codec):
            doc_ids.append(key or 0)
            nulls.append(key is None)
            counts.append(len(ids) // 4 + 1)
            waiting += [ids, end]
            n_waiting += counts[-1]
            if n_waiting >= FLUSH_BLOCKS * BLOCK:
                yield from pack(False)
    if not first:
        yield from pack(True)
        table = (b"D" + struct.pack("<I", len(counts)) + np.array(doc_ids, "<i8").tobytes()
                 + np.array(nulls, np.uint8).tobytes() + np.array(counts, "<u4").tobytes())
        index = b"I" + struct.pack("<I", len(starts)) + np.array(starts, "<u8").tobytes() + np.array(firsts, "<u8").tobytes()
        yield rows([table, index])


def write_token_files(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = END_ID,
                      percentile: float = PERCENTILE) -> None:
    """Write ``docs`` (``doc_id`` integer, ``text``) as token files under ``out``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    payloads = rows.mapInArrow(common.releasing(lambda batches: _write_partition(batches, tokenizer_path, end_id, percentile)), "value binary")
    payloads.select(F.col("value").cast("string").alias("value")).write.text(out)


def _records(content: bytes) -> Iterator[memoryview]:
    view, at = memoryview(content), 0
    while at < len(view):
        n = struct.unpack_from("<I", view, at)[0]
        yield view[at + 4:at + 4 + n]
        at += 4 + n + 1


def _read_file(view: memoryview) -> pa.RecordBatch | None:
    """The documents of one file; its blocks are unpacked one at a time."""
    shard, blocks, table = 0, [], None
    for record in _records(view):                        # hops by lengths, no block is unpacked
        kind = bytes(record[:1])
        if kind == b"H":
            shard = struct.unpack_from("<I", record, 1)[0]
        elif kind == b"B":
            blocks.append(record)
        elif kind == b"D":
            table = record
    if table is None:
        return None
    n = struct.unpack_from("<I", table, 1)[0]
    keys = np.frombuffer(table, "<i8", n, 5)
    nulls = np.frombuffer(table, np.uint8, n, 5 + 8 * n).astype(bool)
    counts = np.frombuffer(table, "<u4", n, 5 + 9 * n).astype(np.int64)
    ends = np.cumsum(counts)
    crc, row, done = np.zeros(n, np.int64), 0, 0         # ``done``: ids of the blocks before
    for block in blocks:
        ids = unpack_block(block).astype("<u4", copy=False)
        last = done + len(ids)
        to = int(np.searchsorted(ends, last, side="left"))               # the document that this block breaks off or ends
        cuts = [0, *(ends[row:to] - done).tolist(), len(ids)]
        data, sums = memoryview(ids).cast("B"), crc[row:to + 1].tolist()
        crc[row:to + 1] = [zlib.crc32(data[4 * a:4 * b], c) for a, b, c in zip(cuts[:-1], cuts[1:], sums, strict=True)]
        row, done = to + (to < n and ends[to] == last), last
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64(), mask=nulls), pa.array(np.full(n, shard), pa.int64()), pa.array(ends - counts, pa.int64()),
         pa.array(counts, pa.int64()), pa.array(crc, pa.int64())],
        ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder.cache_clear()                                # a worker that has written before needs its pieces no more
    for batch in batches:
        for content in batch.column(0):
            found = _read_file(memoryview(content.as_buffer()))
            if found is not None:
                yield found


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document of the files under ``path``.

    ``start`` counts the ids of all documents before it: the shards' totals
    (one row a file) are summed up in shard order and added.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = common.staged(files.mapInArrow(
        common.releasing(_read_documents), "doc_id long, shard long, shard_start long, n_tokens long, ids_crc32 long"), "token-rows")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, "shard").select("doc_id", (F.col("offset") + F.col("shard_start")).alias("start"),
                                              "n_tokens", "ids_crc32")


def _wanted_ids(batches: Iterator[pa.RecordBatch], doc_ids: list[int | None]) -> Iterator[pa.RecordBatch]:
    wanted, want_null = np.array([d for d in doc_ids if d is not None], np.int64), None in doc_ids
    for batch in batches:
        for content in batch.column(0):
            view, table, index = memoryview(content.as_buffer()), None, None
            for record in _records(view):                # hops by lengths, no block is unpacked
                if bytes(record[:1]) == b"D":
                    table = record
                elif bytes(record[:1]) == b"I":
                    index = record
            if table is None or index is None:
                continue
            n, n_blocks = struct.unpack_from("<I", table, 1)[0], struct.unpack_from("<I", index, 1)[0]
            keys = np.frombuffer(table, "<i8", n, 5)
            nulls = np.frombuffer(table, np.uint8, n, 5 + 8 * n).astype(bool)
            ends = np.cumsum(np.frombuffer(table, "<u4", n, 5 + 9 * n).astype(np.int64))
            starts = np.concatenate([[0], ends[:-1]])
            places = np.frombuffer(index, "<u8", n_blocks, 5).astype(np.int64)
            firsts = np.frombuffer(index, "<u8", n_blocks, 5 + 8 * n_blocks).astype(np.int64)
            for row in np.flatnonzero(np.where(nulls, want_null, np.isin(keys, wanted))):
                a = int(np.searchsorted(firsts, starts[row], "right")) - 1
                b = int(np.searchsorted(firsts, ends[row], "left"))
                blocks = [unpack_block(view[p + 4:p + 4 + struct.unpack_from("<I", view, p)[0]]) for p in places[a:b].tolist()]
                ids = np.concatenate(blocks)[starts[row] - firsts[a]:ends[row] - firsts[a]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if nulls[row] else int(keys[row])], pa.int64()), pa.array([ids.astype(np.int64)], pa.list_(pa.int64())),
                     pa.array([b - a], pa.int64())], ["doc_id", "ids", "n_blocks"])


def read_ids(spark: SparkSession, path: str, doc_ids: list[int | None]) -> DataFrame:
    """``doc_id, ids, n_blocks`` of the documents with one of ``doc_ids`` in the files under ``path``.

    A lookup of few documents: the ids travel with the tasks, so their list is
    the caller's bound.  The block index says which blocks hold a document
    (``n_blocks``), and only those are unpacked; the bytes of a file are still
    read by Spark, as its stores have no ranged reads.  Defined results: None
    asks for the rows without an id, equal ids give a row each, ids that no
    file holds give none, and asking twice for an id is asking once.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(lambda batches: _wanted_ids(batches, list(doc_ids)), "doc_id long, ids array<long>, n_blocks long")
