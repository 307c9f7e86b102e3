"""Token ids as compressed binary files: an adaptive context-mixing range coder in independent blocks.

A file holds documents: their ids one after another, and a table of doc_ids and lengths. Ids are cut into blocks of
``BLOCK``. Each block starts from fresh models, is coded by itself and carries a CRC-32, so any block decodes alone.

A block is cut into up to ``LANES`` runs of equal length, coded in lockstep: step t codes the t-th id of every run, each
with a range coder of its own but all with the same models, which take in all ids of a step before the next. So a step
is a few array operations, and the models learn from the whole block. An id x is predicted by a mixture

    P(x) = sum of w_k [x = c_k], or w0 P0(x) if x is no c_k

* P0, order 0: the ids' frequencies so far, brought up to date at the steps of :func:`_due_for_counts`,
* c_k, order 1: the two ids that followed the id before most reliably, each with a confidence of 0 to 15,
* c_k, order 2: the same after the two ids before (a hashed context).

The weights depend on the candidates' confidences together and are learnt: each candidate, and order 0, is credited with
its share in the prediction of the id that came; weights of candidates that agree add up. All arithmetic is in integers
(one quotient of small ones is the whole part of a double, and exact), so files decode alike on any machine.

Layout (little endian): magic ``KVXI``, u32 version, u32 blocks, u64 ids, u64 documents, u32 length and u32 CRC-32 of the
document table (zlib: a bit per document that has an id, doc_ids as i64, lengths as u32); for each block u32 ids, u32
alphabet, u32 lanes, u32 CRC-32 of its ids as u32, u16 coded words of each lane, and the 16-bit words of all lanes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, partitions, read_bytes, text_or_empty, write_bytes
from .tokens import encoder

MAGIC, VERSION = b"KVXI", 2
BLOCK = 1 << 22
LANES = 8192
#: Ids of a lane, where a block is too short to fill all lanes.
RUN = 512
FILE_IDS = 8_000_000
#: Bits of the scales of order 0 and of the weights, and of the hashed contexts of order 2.
BITS0, BITS_W, BITS2 = 20, 10, 18
CANDIDATES = 4
TILE = 64
_LEVEL = np.array([0, 1, 2, 2, 3, 3, 3, 4, 4, 4, 4, 4, 5, 5, 5, 5], np.int64)
_U = np.uint64
_SHIFT = _U(BITS0 + BITS_W)
_TOP, _BOTTOM, _SAME, _MASK = _U(40), _U(1 << 34), _U(1 << 40), _U((1 << 56) - 1)
_HEAD, _BLOCK_HEAD = "<4sIIQQII", "<IIII"
HEAD_BYTES, BLOCK_HEAD_BYTES = struct.calcsize(_HEAD), struct.calcsize(_BLOCK_HEAD)

# What a lane's prediction depends on is one small number, and what follows from it is looked up. First come the
# confidences (a slot's byte: the first candidate's in its low half) ...
_FIRST, _SECOND = np.arange(256) & 15, np.arange(256) >> 4
_CLASSES = 6 * 6 * 3 * 3
_CLASS = [
    _LEVEL[_FIRST] * 54 + np.minimum(_LEVEL[_SECOND], 2) * 3,  # order 2
    _LEVEL[_FIRST] * 9 + np.minimum(_LEVEL[_SECOND], 2),  # order 1
]
# ... then which candidates of order 2 (a, b) order 1 (c, d) names too, as bits: a = c, a = d, b = c, b = d
_PATTERNS = np.array([0, 1, 2, 4, 8, 1 | 8, 2 | 4])
_AC, _AD, _BC, _BD = (((_PATTERNS >> k) & 1)[:, None] for k in range(4))
_CASES = 16 * _CLASSES
#: The weights' state of each case: the class, and whether a = c.
_STATES = 2 * _CLASSES
_STATE = (np.arange(_CASES) % _CLASSES // 9 * 2 + np.arange(_CASES) // _CLASSES % 2) * 9 + np.arange(_CASES) % 9
#: Where the part of the first candidate that is named (bits) begins in tables of all cases; the last part is order 0's.
_PART = _CASES * np.array([CANDIDATES, *[(m & -m).bit_length() - 1 for m in range(1, 16)]])
_ONES, _TOPS = _U(0x0001000100010001), _U(0x8000800080008000)


def _next_slots() -> np.ndarray:
    """By hits (1: the first candidate, 2: the second) and confidences: the byte of the new confidences, and above it a mask
    of the id that stays; the other gives way to the id that came."""
    stays_a, stays_b, out = 0xFFFFFF00, -(1 << 32), []
    for hits in range(3):
        for a, b in zip(_FIRST.tolist(), _SECOND.tolist(), strict=True):
            # a hit makes a candidate surer and a miss less sure; a surer second comes first, and what is new comes second
            if hits == 1:
                out.append(stays_b | min(a + 1, 15) | b << 4)
            elif hits == 2 and b >= a:
                out.append(min(b + 1, 15) | a << 4)
            elif hits == 2:
                out.append(stays_a | a - 1 | b + 1 << 4)
            else:
                out.append(stays_a | a - 1 | 1 << 4 if a else stays_b | 1 | b << 4)
    return np.array(out, np.int64)


_NEXT, _SWAPS = _next_slots(), _SECOND >= _FIRST


def _due_for_counts(step: int) -> bool:
    return step < 32 and step & (step - 1) == 0 or step % 32 == 0


def _pick(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``table`` at places that all lie in it: to clip them takes half of the time of a check."""
    return table.take(at, mode="clip")


def _turned(rows: np.ndarray) -> np.ndarray:
    """The transposed array in memory order, made in tiles: whole columns would miss every cache."""
    out = np.empty(rows.shape[::-1], rows.dtype)
    for k in range(0, rows.shape[0], TILE):
        for j in range(0, rows.shape[1], TILE):
            out[j : j + TILE, k : k + TILE] = rows[k : k + TILE, j : j + TILE].T
    return out


def _bits(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Four flags as one number, by additions: shifts of bytes take twice as long."""
    out = d.view(np.uint8) * np.uint8(2)
    out += c.view(np.uint8)
    out += out
    out += b.view(np.uint8)
    out += out
    out += a.view(np.uint8)
    return out


class _Models:
    """The models of a block of ids below ``alphabet``; a slot of a context holds both its candidates."""

    def __init__(self, alphabet: int, lanes: int, decodes: bool):
        self.alphabet, self.decodes = alphabet, decodes
        #: bits 0 to 3 and 4 to 7: confidences; from bit 8 and from bit 32: ids, which always differ, at first 0 and 1
        self.slots = [np.full(n, 1 << 32, np.int64) for n in (1 << BITS2, alphabet)]
        self.credit = np.full((CANDIDATES + 1, _STATES), 16, np.int64)
        self.seen, self.waiting = np.zeros(alphabet, np.int64), []
        self.before, self.last, self.wide = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32), np.zeros(lanes, np.int64)
        #: candidates of all lanes: order 2, order 1, and a row for none
        self.ids, self.lanes = np.zeros((CANDIDATES + 1, lanes), np.int32), np.arange(lanes)
        self.step = 0
        self._count()
        self._weigh()

    def _count(self) -> None:
        if self.waiting:
            self.seen += np.bincount(np.concatenate(self.waiting), minlength=self.alphabet)
            self.waiting = []
        whole = (1 << BITS0) - self.alphabet
        share = 1 + self.seen * whole // max(1, int(self.seen.sum()))
        share[np.argmax(self.seen)] += (1 << BITS0) - int(share.sum())
        #: start and width of each id's part of order 0
        self.spread = (np.cumsum(share) - share) << 32 | share
        if self.decodes:
            self.id_at = np.repeat(np.arange(self.alphabet, dtype=np.uint16 if self.alphabet <= 1 << 16 else np.int32), share)

    def _weigh(self) -> None:
        out = 1 + self.credit * ((1 << BITS_W) - CANDIDATES - 1) // self.credit.sum(axis=0)
        out[CANDIDATES] = (1 << BITS_W) - out[:CANDIDATES].sum(axis=0)
        self.weights = out.astype(np.int32)
        w = out[:, _STATE.reshape(16, _CLASSES)[_PATTERNS]]
        # a candidate of order 1 that order 2 names too is one with it; the two of an order differ
        own = [w[0] + w[2] * _AC + w[3] * _AD, w[1] + w[2] * _BC + w[3] * _BD, w[2] * (1 - (_AC | _BC)), w[3] * (1 - (_AD | _BD))]
        ends = np.cumsum(own, axis=0)
        #: start and width of each part of a case in a range of 2**(BITS0 + BITS_W); of order 0 the start, its weight apart
        self.parts, self.rest = np.zeros((2, CANDIDATES + 1, 16, _CLASSES), np.int64)
        for k in range(CANDIDATES):
            self.parts[k, _PATTERNS] = (ends[k] - own[k]) << 32 + BITS0 | own[k] << BITS0
        self.parts[CANDIDATES, _PATTERNS], self.rest[CANDIDATES, _PATTERNS] = ends[-1] << 32 + BITS0, w[CANDIDATES]
        self.parts, self.rest = self.parts.reshape(-1), self.rest.reshape(-1)
        if self.decodes:
            self.ends = np.zeros((16, _CLASSES), np.uint64)
            self.ends[_PATTERNS] = ends[0] | ends[1] << 16 | ends[2] << 32 | ends[3] << 48
            self.ends = self.ends.reshape(-1)

    def predict(self) -> None:
        """Candidates, and the case of each lane."""
        mixed = self.last.view(np.uint32) * np.uint32(0x9E3779B1) + self.before.view(np.uint32) * np.uint32(0x85EBCA6B)
        self.at = [(mixed >> np.uint32(32 - BITS2)).astype(np.int64), self.wide]
        self.held = [_pick(s, i) for s, i in zip(self.slots, self.at, strict=True)]
        self.conf = [h & 255 for h in self.held]
        for k, h in enumerate(self.held):
            halves = h.view(np.int32)
            np.right_shift(halves[::2], 8, out=self.ids[2 * k])
            self.ids[2 * k + 1] = halves[1::2]
        a, b, c, d, _ = self.ids
        self.case = np.multiply(_bits(a == c, a == d, b == c, b == d), _CLASSES, dtype=np.int64)
        self.case += _pick(_CLASS[0], self.conf[0])
        self.case += _pick(_CLASS[1], self.conf[1])

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of ``ids`` in a range of 2**(BITS0 + BITS_W)."""
        self.named = [c == ids for c in self.ids[:CANDIDATES]]
        self.bits, self.coming = _bits(*self.named), ids.astype(np.int64)
        at = _pick(_PART, self.bits.astype(np.int64))
        at += self.case
        both = _pick(self.rest, at)
        both *= _pick(self.spread, self.coming)
        both += _pick(self.parts, at)
        return both >> 32, both & 0xFFFFFFFF

    def find(self, value: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold ``value``."""
        high = (value >> BITS0).view(np.uint64)
        # how many of the four ends, 16 bits each, are not above
        part = np.bitwise_count(((high * _ONES | _TOPS) - _pick(self.ends, self.case)) & _TOPS)
        at = np.multiply(part, len(value), dtype=np.int64)
        at += self.lanes
        out = _pick(self.ids, at)
        other = np.flatnonzero(part == CANDIDATES)
        at = _pick(self.case, other) + CANDIDATES * _CASES
        # both below 2**30: the quotient's whole part is exact
        place = (_pick(value, other) - (_pick(self.parts, at) >> 32)) / _pick(self.rest, at)
        out[other] = _pick(self.id_at, place.astype(np.int64))
        return out

    def learn(self, ids: np.ndarray) -> None:
        """Take in the ids of this step; :meth:`interval` was asked for them."""
        if self.step < 64 or self.step % 16 == 0:
            state = _pick(_STATE, self.case)
            parts = [_pick(w, state) * n for w, n in zip(self.weights, self.named, strict=False)]
            whole = np.maximum(parts[0] + parts[1] + parts[2] + parts[3], 1)
            parts = [*[(p << 10) // whole for p in parts], (self.bits == 0) * np.int32(1024)]
            self.credit += np.array([np.bincount(state, p, _STATES) for p in parts]).astype(np.int64)
            self._weigh()
        named = self.coming << 8 | self.coming << 32
        for k in range(2):
            hits = np.multiply(self.bits >> 2 * k & 3, 256, dtype=np.int64)
            hits += self.conf[k]
            new = self.held[k] | 255
            new ^= named
            new &= _pick(_NEXT, hits)
            new ^= named
            rows = np.flatnonzero(self.named[2 * k + 1])
            rows = rows[_pick(_SWAPS, _pick(self.conf[k], rows))]
            new.view(np.int32)[1::2][rows] = _pick(self.ids[2 * k], rows)
            self.slots[k][self.at[k]] = new
        self.waiting.append(ids)
        self.before, self.last, self.wide = self.last, ids, self.coming
        self.step += 1
        if _due_for_counts(self.step):
            self._count()


class _Coder:
    def __init__(self, n: int):
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, _MASK)

    def narrow(self, step, start, width) -> None:
        self.low += step * start.view(np.uint64)
        self.range = step * width.view(np.uint64)

    def settle(self) -> None:
        """Shift words out of every lane until its range is wide again; where the range is narrow and the top bits still
        differ, it is cut so that they agree."""
        due, low, width = None, self.low, self.range
        while True:
            same = (low ^ (low + width)) < _SAME
            more = np.flatnonzero(same | (width < _BOTTOM))
            if not len(more):
                return
            due = more if due is None else _pick(due, more)
            low, width, same = _pick(low, more), _pick(width, more), _pick(same, more)
            if not same.all():
                width = np.where(same, width, (_U(0) - low) & (_BOTTOM - _U(1)))
            self.shift(due, low)
            low = (low << _U(16)) & _MASK
            width = width << _U(16)
            self.low[due], self.range[due] = low, width


class _Encoder(_Coder):
    def __init__(self, n: int):
        super().__init__(n)
        self.out: list[tuple[np.ndarray, np.ndarray]] = []

    def shift(self, due, low) -> None:
        self.out.append((due.astype(np.uint16), (low >> _TOP).astype(np.uint16)))

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """(words of each lane, all words lane by lane). Two last words name a point within a lane's range."""
        n = len(self.low)
        point = (self.low + _U((1 << 24) - 1)) >> _U(24)
        every = np.arange(n, dtype=np.uint16)
        self.out += [(every, (point >> _U(16)).astype(np.uint16)), (every, (point & _U(0xFFFF)).astype(np.uint16))]
        counts = np.bincount(np.concatenate([lanes for lanes, _ in self.out]), minlength=n)
        out, place = np.empty(int(counts.sum()), np.uint16), np.cumsum(counts) - counts
        for lanes, words in self.out:
            at = place[lanes]
            out[at] = words
            place[lanes] = at + 1
        return counts, out


class _Decoder(_Coder):
    def __init__(self, counts: np.ndarray, words: np.ndarray):
        super().__init__(len(counts))
        self.words = np.append(words, np.uint16(0))
        self.at = np.cumsum(counts) - counts
        self.code = np.zeros(len(counts), np.uint64)
        every = np.arange(len(counts))
        for _ in range(3):
            self.code = (self.code << _U(16)) | self._next(every)
        # 56 bits are held: the last word lends its high half, the low half waits
        word = self._next(every)
        self.code = (self.code << _U(8)) | (word >> _U(8))
        self.tail = word & _U(0xFF)

    def _next(self, due) -> np.ndarray:
        at = _pick(self.at, due)
        self.at[due] = at + 1
        # beyond a lane's words any would do: its two last words name a point whose lower bits are free
        return _pick(self.words, at).astype(np.uint64)

    def shift(self, due, low) -> None:
        word = self._next(due)
        fed = (_pick(self.tail, due) << _U(8)) | (word >> _U(8))
        self.tail[due] = word & _U(0xFF)
        self.code[due] = ((_pick(self.code, due) << _U(16)) & _MASK) | fed


def encode_block(ids: np.ndarray) -> bytes:
    n = len(ids)
    lanes = min(LANES, max(1, n // RUN))
    steps, alphabet = -(-n // lanes), int(ids.max()) + 1
    padded = np.zeros(lanes * steps, np.int32)
    padded[:n] = ids
    models, coder = _Models(alphabet, lanes, False), _Encoder(lanes)
    for own in _turned(padded.reshape(lanes, steps)):
        models.predict()
        coder.narrow(coder.range >> _SHIFT, *models.interval(own))
        coder.settle()
        models.learn(own)
    counts, words = coder.finish()
    head = struct.pack(_BLOCK_HEAD, n, alphabet, lanes, zlib.crc32(ids.astype("<u4").tobytes()))
    return head + counts.astype("<u2").tobytes() + words.astype("<u2").tobytes()


def decode_block(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """(ids of the block that starts at ``at``, where the next one starts); raises if its checksum fails."""
    n, alphabet, lanes, crc = struct.unpack_from(_BLOCK_HEAD, data, at)
    if not 0 < lanes <= LANES or not 0 < alphabet < 1 << (BITS0 - 1):
        raise ValueError("not a block of token ids")
    at += BLOCK_HEAD_BYTES
    counts = np.frombuffer(data, "<u2", lanes, at).astype(np.int64)
    at += 2 * lanes
    words = np.frombuffer(data, "<u2", int(counts.sum()), at)
    at += 2 * len(words)
    steps = -(-n // lanes)
    models, coder = _Models(alphabet, lanes, True), _Decoder(counts, words)
    out = np.zeros((steps, lanes), np.int32)
    for t in range(steps):
        models.predict()
        step = coder.range >> _SHIFT
        value = np.minimum((coder.code - coder.low) // step, _U((1 << (BITS0 + BITS_W)) - 1)).astype(np.int64)
        out[t] = own = models.find(value)
        coder.narrow(step, *models.interval(own))
        coder.settle()
        models.learn(own)
    ids = _turned(out).reshape(-1)[:n].astype(np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block does not match its checksum")
    return ids, at


def encode_ids(ids: np.ndarray, block: int = BLOCK, docs: np.ndarray | None = None, valid: np.ndarray | None = None, counts: np.ndarray | None = None) -> bytes:
    """A file of ``ids`` (unsigned, below 2**19); ``docs``, ``valid`` and ``counts`` tell the documents' doc_ids, which
    of them are not null, and how many ids each has."""
    ids = np.ascontiguousarray(ids, np.uint32)
    if len(ids) and int(ids.max()) >= 1 << (BITS0 - 1):
        raise ValueError("ids must be below 2**19")
    n = 0 if docs is None else len(docs)
    table = zlib.compress(np.packbits(valid).tobytes() + docs.astype("<i8").tobytes() + counts.astype("<u4").tobytes(), 1) if n else b""
    blocks = [encode_block(ids[k : k + block]) for k in range(0, len(ids), block)]
    return b"".join([struct.pack(_HEAD, MAGIC, VERSION, len(blocks), len(ids), n, len(table), zlib.crc32(table)), table, *blocks])


def ids_in(data: bytes) -> int:
    """How many ids a file holds, from its first bytes."""
    magic, version, _, ids, *_ = struct.unpack_from(_HEAD, data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a file of token ids")
    return ids


def decode_ids(data: bytes) -> np.ndarray:
    """The ids of a file; a block whose checksum fails raises."""
    return decode_file(data)[0]


def decode_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, doc_ids, which of these are not null, ids of each document)."""
    total = ids_in(data)
    _, _, blocks, _, n, size, crc = struct.unpack_from(_HEAD, data)
    at = HEAD_BYTES
    table = data[at : at + size]
    if zlib.crc32(table) != crc:
        raise ValueError("the document table does not match its checksum")
    at, raw, bits = at + size, zlib.decompress(table) if n else b"", -(-n // 8)
    valid = np.unpackbits(np.frombuffer(raw, np.uint8, bits), count=n).astype(bool)
    docs = np.frombuffer(raw, "<i8", n, bits)
    counts = np.frombuffer(raw, "<u4", n, bits + 8 * n).astype(np.int64)
    parts = []
    for _ in range(blocks):
        ids, at = decode_block(data, at)
        parts.append(ids)
    out = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if len(out) != total or n and counts.sum() != total:
        raise ValueError("ids are missing")
    return out, docs, valid, counts


def write_ids(docs: DataFrame, ws: Workspace, path: str, end_id: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Files of documents in ascending doc_id order (null first; equal doc_ids by text), each of whole documents and
    about ``file_ids`` ids; returns the manifest: part, place, file.

    Documents are dealt by ranges of (doc_id, hash of text), so neither long documents nor a repeated doc_id fill one
    task, and a file is written under a name of the attempt and counts only if its task is committed.
    """
    folder, spark = ws.path("ids"), ws.spark

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, rows = encoder(path), TaskContext.get().partitionId(), []
        held, names, counts, size = [], [], [], 0

        def close():
            target = f"{folder}/{part:06d}-{len(rows):04d}-{TaskContext.get().taskAttemptId()}.kvxi"
            valid = np.concatenate([np.asarray(n.is_valid()) for n in names])
            ids = np.concatenate([n.fill_null(0).to_numpy(zero_copy_only=False) for n in names])
            write_bytes(target, encode_ids(np.concatenate(held), BLOCK, ids, valid, np.concatenate(counts)))
            rows.append((part, len(rows), target))

        for b in batches:
            for lo in range(0, b.num_rows, 512):
                piece = b.slice(lo, 512)
                ids, n = enc.encode(piece.column(1))
                held.append(np.insert(ids, np.cumsum(n), end_id).astype(np.uint32))
                names.append(piece.column(0))
                counts.append(n + 1)
                size += len(held[-1])
                if size >= file_ids:
                    close()
                    held, names, counts, size = [], [], [], 0
        if held:
            close()
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.string()), strict=True)], ["part", "place", "file"])

    ordered = (
        docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
        .withColumn("__tie", F.xxhash64("text"))
        .repartitionByRange(partitions(spark), "doc_id", "__tie")
        .sortWithinPartitions("doc_id", "__tie")
        .select("doc_id", "text")
    )
    return ws.save(ordered.mapInArrow(work, "part int, place int, file string"), "manifest")


def read_ids(manifest: DataFrame, ws: Workspace) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of a manifest: it only lists them in order.
    Their heads tell how many ids come before each file."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [ids_in(read_bytes(f, HEAD_BYTES)) for f in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], ["part", "place", "file", "ids"])

    spread = lambda df: df.repartition(partitions(ws.spark), "file")
    sized = ws.save(spread(manifest).mapInArrow(heads, "part int, place int, file string, ids long"), "heads")
    before = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    listed = sized.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))  # a row per file

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, docs, valid, counts = decode_file(read_bytes(file))
                ids, ends = ids.astype("<u4"), np.cumsum(counts)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                columns = [pa.array(docs, pa.int64(), mask=~valid), pa.array(first + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread(listed).mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Tokenise, write files, read them back."""
    ws = Workspace(docs.sparkSession, "idcodec")
    return read_ids(write_ids(docs, ws, path, end_id), ws)
