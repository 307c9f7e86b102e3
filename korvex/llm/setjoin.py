"""What the two exact set-similarity operators share: scanning texts into sets, a rarity order over all tokens, packed
postings of prefix tokens, fetching the sets of candidates, and verification.

A unit (a document, a line) is a set of 64-bit tokens. Texts are scanned again for each step instead of keeping all
sets: hashing costs less than storing or shuffling them. Shuffles carry packed arrays, one row for a scan task and part
of the token space. Parts are as many as keep about ``PART_TOKENS`` entries in each, so no task grows with the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as K
from .common import Workspace, thrifty, thrifty_group

PART_TOKENS = 1_000_000
FLUSH_TOKENS = 1_000_000
#: Slots of the rarity table: 2**RARITY_BITS bytes reach every task, whatever the input's size. Tokens that share a slot
#: count as the commonest of them; any function of the token is a valid order, so this costs time only.
RARITY_BITS = 25
#: Up to so many sets may hold a token of class 0.
RARE = 2
CANDIDATE_BITS = 27

Units = Callable[[np.ndarray, pa.Array], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


#: One more token that may fall together with another of its set, for so many in the set.
FALLEN = 4096
#: A prefix is longer than the shortest that works by one token in so many of the set.
STEP = 16


def prefix_lengths(sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Tokens that a set of size n posts: n - ceil(n num/den) + 1 + n // STEP.

    Let x be the one of a pair whose prefix ends first in the common order. At most ceil(n num/den) - 1 - n // STEP
    common tokens lie behind it, so a pair of Jaccard num/den or more has at least 1 + n // STEP of them before, and
    those are in both prefixes: the pair meets in that many lists, not just in one.
    """
    return np.where(sizes > 0, sizes - (-(-sizes * num // den)) + 1 + sizes // STEP, 0)


def linked(common, a, b, num: int, den: int):
    """Whether sets of sizes a and b with ``common`` tokens in common have Jaccard num/den or more."""
    return common * den >= num * (a + b - common)


def meetings_needed(x: F.Column, low: F.Column, high: F.Column, num: int, den: int) -> F.Column:
    """Lists that a set of size x shares with any set like it of size low .. high (null if none can be like it).

    The one whose prefix ends first has at most its rest of about n (num/den - 1/STEP) tokens behind it, so the overlap
    that the sizes demand, less the larger rest, lies in both prefixes. The bound is lowest at an end of the range. Very
    large sets are allowed some tokens that fall together where postings cut them short.
    """
    low, high = F.greatest(low, F.ceil(x * num / den)), F.least(high, F.floor(x * den / num))
    least = lambda y: (x + y) * (num / (num + den)) - F.greatest(x, y) * (num / den - 1 / STEP) - 1
    tight = F.ceil(F.least(least(low), least(high)) - 1e-9)
    return F.when(low <= high, F.greatest(F.lit(1), F.greatest(tight, 1 + F.floor(F.least(x, low) / STEP)) - F.floor(x / FALLEN)))


def able_sets(met: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``met`` (token, print, size, lo, hi ...; lo and hi: the least and largest size in the token's list) of
    sets that meet others in as many lists as they must meet any set like them. A set has at most its prefix of rows."""
    own = Window.partitionBy("print")
    needed = meetings_needed(F.col("size"), F.min("lo").over(own), F.max("hi").over(own), num, den)
    ranked = met.withColumn("__c", F.count(F.lit(1)).over(own)).withColumn("__m", needed)
    return ranked.where(F.col("__c") >= F.col("__m")).drop("__c", "__m", "lo", "hi")


@dataclass
class Sets:
    """Texts to scan: ``rows`` has the columns id (long) and text (no nulls); ``units`` makes (keys, tokens, counts) of
    a batch slice by slice, the keys telling rows apart that have equal sets."""

    ws: Workspace
    rows: DataFrame
    units: Units
    tokens: int = 0
    held: list = field(default_factory=list)

    def share(self, value: np.ndarray):
        """A broadcast that lasts until :meth:`release`."""
        self.held.append(self.ws.spark.sparkContext.broadcast(value))
        return self.held[-1]

    def release(self) -> None:
        """Give up what was broadcast; the steps that read it must have been written."""
        while self.held:
            self.held.pop().destroy()
        self.ws.tidy()

    @property
    def part_bits(self) -> int:
        return max(4, int(np.ceil(np.log2(max(1, self.tokens / PART_TOKENS)))))

    def scan(self, each: Callable, schema: str) -> DataFrame:
        """``each(slices)`` per task, over (keys, tokens, counts, prints) of its texts; it yields record batches."""
        units = self.units

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def slices():
                for b in batches:
                    ids = b.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                    for keys, tokens, counts in units(ids, b.column(1)):
                        if len(counts):
                            yield keys, tokens, counts, K.set_prints(tokens, counts)

            yield from each(slices())

        return self.rows.mapInArrow(thrifty(work), schema)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x) -> np.ndarray:
    return x if x.dtype == np.uint64 else np.ascontiguousarray(x, dtype=np.int64).view(np.uint64)


def binary_rows(parts: np.ndarray, chunks: list[list[bytes]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *[pa.array(c, pa.binary()) for c in chunks]], ["part", *names])


def narrow(values: np.ndarray) -> bytes:
    """Integers in as few bytes each as their range takes."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    width = next((w for w in (1, 2, 4) if low >= 0 and high < 1 << 8 * w), 8)
    return values.astype(f"u{width}" if width < 8 else np.int64).tobytes()


def widen(raw: bytes, n: int) -> np.ndarray:
    """The ``n`` integers of :func:`narrow`, as int64."""
    width = len(raw) // n if n else 8
    return np.frombuffer(raw, f"u{width}" if width < 8 else np.int64).astype(np.int64)


def split_by_part(tokens: np.ndarray, bits: int, *columns: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """Sorted ``tokens`` and aligned columns cut where the top ``bits`` change: (parts, bytes of each column by part);
    columns of int64 are narrowed."""
    part = (tokens >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.diff(part)) + 1
    bounds = np.concatenate([[0], cut, [len(part)]]) if len(part) else np.zeros(1, np.int64)
    as_bytes = lambda c: narrow(c) if c.dtype == np.int64 else np.ascontiguousarray(c).tobytes()
    pieces = [[as_bytes(c[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)] for c in columns]
    return part[bounds[:-1]] if len(part) else part, pieces


def within_part(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits after the part's."""
    return ((tokens << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def rarity_table(sets: Sets) -> np.ndarray:
    """Class of every slot: 0 if its tokens are in at most ``RARE`` sets, else the bit length of the count.

    Counts cover all units (a set that a scan task meets again counts once for it). Each task sends a token once with
    its own count, so the commonest token costs one entry a task.
    """
    bits = sets.part_bits

    def each(slices):
        def flush(held):
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            parts, chunks = split_by_part(tokens, bits, within_part(tokens, bits), np.minimum(counts, 65535).astype(np.uint16))
            return binary_rows(parts, chunks, ["tokens", "counts"])

        held, size, seen = [], 0, set()
        for _, tokens, counts, prints in slices:
            new = np.array([p not in seen and not seen.add(p) for p in prints.tolist()], bool)
            held.append(tokens[np.repeat(new, counts)])
            size += len(held[-1])
            if size >= FLUSH_TOKENS:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    slot_bits = max(0, RARITY_BITS - bits)

    def count(key, pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = np.frombuffer(b"".join(pdf["tokens"]), np.uint32)
        counts = np.frombuffer(b"".join(pdf["counts"]), np.uint16)
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        total = np.add.reduceat(counts[order].astype(np.int64), first)
        common = total > RARE
        classes = np.zeros(1 << slot_bits, np.uint8)
        np.maximum.at(classes, (tokens[first][common].astype(np.int64) >> (32 - slot_bits)), np.ceil(np.log2(total[common] + 1)).astype(np.uint8))
        return pd.DataFrame({"part": [key[0]], "classes": [classes.tobytes()]})

    found = sets.scan(each, "part int, tokens binary, counts binary").groupBy("part").applyInPandas(thrifty_group(count), "part int, classes binary")
    table = np.zeros(1 << max(RARITY_BITS, bits), np.uint8)
    for part, classes in found.toLocalIterator():
        table[part << slot_bits : (part + 1) << slot_bits] = np.frombuffer(classes, np.uint8)
    return table


def ordered_prefixes(tokens: np.ndarray, counts: np.ndarray, table: np.ndarray, num: int, den: int):
    """(tokens, owner, position) of every unit's prefix, rarest class first, then by token."""
    owner = K.run_ids(counts)
    rarity = table[(tokens >> np.uint64(64 - int(np.log2(len(table))))).astype(np.int64)]
    mixed = np.flatnonzero(np.bincount(owner, rarity > 0, minlength=len(counts)))
    ends = np.cumsum(counts)
    if len(mixed):
        tokens = tokens.copy()
        for u in mixed.tolist():  # tokens of a unit are sorted already; only units with common tokens change
            a, b = ends[u] - counts[u], ends[u]
            tokens[a:b] = tokens[a:b][np.argsort(rarity[a:b], kind="stable")]
    lengths = prefix_lengths(counts, num, den)
    picked = K.gather_runs(ends - counts, lengths)
    position = picked - np.repeat(ends - counts, lengths)
    return tokens[picked], owner[picked], position


def postings(
    sets: Sets, table: np.ndarray, num: int, den: int, meet: Callable, schema: str, carry: list[Callable] = (), ends: bool = False
) -> DataFrame:
    """``meet(tokens, prints, sizes, positions, *carried)`` over each part's prefix postings; it returns a frame, to which
    lo and hi are added, the least and the largest size in each row's list.

    Only lists of two or more sets get there, sorted by token; ``meet`` may sort within lists. ``carry`` adds columns of integers, made
    from the units' keys; of equal sets, the one with the least carried values is taken. ``ends``
    adds the place of the last token of the set's prefix in the common order.

    Equal sets post once a task or so, and again when a task meets one with less carried values, whatever the order of
    its rows; they are seen once in all. Tokens are cut to part and 32 bits: two that fall together only make a
    candidate more.
    """
    bits = sets.part_bits
    shared = sets.share(table)
    names = ["tokens", "prints", "sizes", "positions", *[f"c{i}" for i in range(len(carry))], *(["end"] if ends else [])]

    def each(slices):
        def flush(held):
            tokens, *columns = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(tokens)
            tokens = tokens[order]
            parts, chunks = split_by_part(tokens, bits, within_part(tokens, bits), *[c[order] for c in columns])
            return binary_rows(parts, chunks, names)

        held, size, least = [], 0, {}
        for keys, tokens, counts, prints in slices:
            carried = [fn(keys).astype(np.int64) for fn in carry]
            places = zip(*[c.tolist() for c in carried], strict=True) if carry else [()] * len(prints)
            new = np.zeros(len(prints), bool)
            for i, (p, place) in enumerate(zip(prints.tolist(), places, strict=True)):
                if p not in least or place < least[p]:
                    least[p], new[i] = place, True
            mine, owner, position = ordered_prefixes(tokens[np.repeat(new, counts)], counts[new], shared.value, num, den)
            more = [c[new][owner] for c in carried]
            if ends and len(mine):
                last = mine[np.maximum(np.cumsum(np.bincount(owner, minlength=int(new.sum()))) - 1, 0)]
                rarity = shared.value[(last >> np.uint64(64 - int(np.log2(len(shared.value))))).astype(np.int64)].astype(np.int64)
                more.append(((rarity << 56) | (last >> np.uint64(8)).astype(np.int64))[owner])
            elif ends:
                more.append(np.zeros(0, np.int64))
            held.append((mine, prints[new][owner], counts[new][owner], position, *more))
            size += len(mine)
            if size >= FLUSH_TOKENS // 2:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    def reduce(key, pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, prints = np.frombuffer(b"".join(pdf["tokens"]), np.uint32), np.frombuffer(b"".join(pdf["prints"]), np.uint64)
        each_row = [len(t) // 4 for t in pdf["tokens"]]
        rest = [np.concatenate([widen(raw, n) for raw, n in zip(pdf[name], each_row, strict=True)]) for name in names[2:]]
        order = np.lexsort((*rest[2:][::-1], prints, tokens))
        tokens, prints, *rest = (x[order] for x in (tokens, prints, *rest))
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (prints[1:] != prints[:-1])
        tokens, prints, *rest = (x[new] for x in (tokens, prints, *rest))
        lists = np.concatenate([[True], tokens[1:] != tokens[:-1]])
        sizes = np.diff(np.append(np.flatnonzero(lists), len(tokens)))
        several = np.repeat(sizes > 1, sizes)
        whole = (np.uint64(key[0]) << np.uint64(32)) | tokens[several].astype(np.uint64)
        columns = [x[several] for x in rest]
        out = meet(signed(whole), prints[several], *columns)
        long = sizes[sizes > 1]
        starts = np.cumsum(long) - long
        for name, least in (("lo", np.minimum), ("hi", np.maximum)):
            ends = least.reduceat(columns[0], starts) if len(long) else columns[0]
            out[name] = np.repeat(ends, long).astype(np.int32)
        return out

    packed = sets.scan(each, "part int, " + ", ".join(f"{n} binary" for n in names))
    return packed.groupBy("part").applyInPandas(thrifty_group(reduce), schema + ", lo int, hi int")


def gather(sets: Sets, chosen: DataFrame, name: str) -> DataFrame:
    """(print, tokens) of the chosen rows (columns print and the keys, all long), written to the shared folder.

    The scan keeps what a bitmap of 2**CANDIDATE_BITS bits admits; the few rows it admits wrongly, and repeated rows,
    only repeat a set under its own print.
    """
    bits, parts = CANDIDATE_BITS, 6

    names = [c for c in chosen.columns if c != "print"]

    def mark(prints: np.ndarray, *keys: np.ndarray) -> np.ndarray:
        for key in keys:
            prints = K.mix(prints ^ K.mix(unsigned(key)))
        return (prints >> np.uint64(64 - bits)).astype(np.int64)

    def partial(batches):
        slots = [mark(unsigned(b["print"].to_numpy()), *[b[n].to_numpy() for n in names]) for b in batches]
        slots = np.unique(np.concatenate(slots)) if slots else np.zeros(0, np.int64)
        part = slots >> (bits - parts)
        yield pd.DataFrame([(int(p), slots[part == p].astype(np.uint32).tobytes()) for p in np.unique(part)], columns=["part", "slots"])

    def union(key, pdf):
        flags = np.zeros(1 << (bits - parts), bool)
        flags[np.frombuffer(b"".join(pdf["slots"]), np.uint32).astype(np.int64) & ((1 << (bits - parts)) - 1)] = True
        return pd.DataFrame({"part": [key[0]], "flags": [np.packbits(flags).tobytes()]})

    slots = chosen.mapInPandas(thrifty(partial), "part int, slots binary")
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (bits - parts - 3)
    for part, flags in slots.groupBy("part").applyInPandas(thrifty_group(union), "part int, flags binary").toLocalIterator():
        bitmap[part * width : (part + 1) * width] = np.frombuffer(flags, np.uint8)
    shared = sets.share(bitmap)

    def each(slices):
        for keys, tokens, counts, prints in slices:
            at = mark(prints, *keys.reshape(len(prints), -1).T)
            keep = (shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool) & (counts > 0)
            ends = np.cumsum(counts)
            rows = [tokens[ends[u] - counts[u] : ends[u]].tobytes() for u in np.flatnonzero(keep).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(signed(prints[keep])), pa.array(rows, pa.binary())], ["print", "tokens"])

    out = sets.ws.save(sets.scan(each, "print long, tokens binary"), name)
    sets.release()
    return out


def verify(pairs: DataFrame, table: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b: prints) whose sets have Jaccard num/den or more. Sizes are compared before sets are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if linked(min(len(x), len(y)), len(x), len(y), num, den):
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    keep[i] = linked(int((y[at] == x).sum()), len(x), len(y), num, den)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    left = table.select(F.col("print").alias("a"), F.col("tokens").alias("x"))
    right = table.select(F.col("print").alias("b"), F.col("tokens").alias("y"))
    sized = pairs.join(left, "a").join(right, "b").where(
        (F.octet_length("x") * num <= F.octet_length("y") * den) & (F.octet_length("y") * num <= F.octet_length("x") * den)
    )
    return sized.select("a", "b", "x", "y").mapInArrow(thrifty(work), "a long, b long")
