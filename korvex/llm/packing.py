"""Packing documents into sequences by a grouping genetic algorithm on islands.

Documents become token ids plus an end id; only longer ones than a sequence are cut, into full pieces and a last one.
Pieces are dealt by a hash over shards of about ``SHARD`` pieces. A shard's population starts from best fit in falling
and in shuffled orders. A crossover injects well-filled bins of one parent, whole, into the other, removes the bins that
hold injected pieces again, and puts the displaced pieces back by best fit; a mutation empties some poorly filled bins.
Fitness is the number of bins, then the sum of squared fills. Every shard has ``ISLANDS`` such populations, evolved in
tasks of their own; after each epoch an island takes over the elite of its neighbour. A shard that reaches the bound
ceil(tokens / sequence) stops.

Bins filled to less than ``OPEN_BELOW`` are opened again and their pieces dealt to fewer shards, until one is left, so
shards cost about one loose bin altogether. Full pieces need no packing.

Defined cases: null and empty texts are one piece of the end id alone; rows that repeat are packed each; an empty table
gives no rows; extra columns are ignored. Sequence ids are arbitrary but distinct.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty, thrifty, thrifty_group
from .tokens import encoder

CAPACITY = 4096
SHARD = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 6
OPEN_BELOW = 0.995
MAX_LEVELS = 4

Bins = list[list[int]]


def best_fit(items: list[int], lengths: list[int], capacity: int, bins: Bins, room: list[int]) -> None:
    """Put ``items``, in their order, each into the fullest bin that takes it, or a new one. ``room``: space left a bin."""
    open_bins = sorted((r, b) for b, r in enumerate(room) if r)
    for i in items:
        need = lengths[i]
        at = bisect_left(open_bins, (need, -1))
        if at < len(open_bins):
            r, b = open_bins.pop(at)
            bins[b].append(i)
        else:
            b, r = len(bins), capacity
            bins.append([i])
            room.append(capacity)
        room[b] = r - need
        if room[b]:
            insort(open_bins, (room[b], b))


def fitness(bins: Bins, lengths: list[int], capacity: int) -> tuple[int, float]:
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def _reinsert(kept: Bins, loose: list[int], lengths: list[int], capacity: int) -> Bins:
    kept = [list(b) for b in kept]
    room = [capacity - sum(lengths[i] for i in b) for b in kept]
    best_fit(sorted(loose, key=lambda i: -lengths[i]), lengths, capacity, kept, room)
    return kept


def crossover(a: Bins, b: Bins, lengths: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """Well-filled bins of ``b`` injected into ``a``."""
    fills = [sum(lengths[i] for i in x) for x in b]
    ranked = sorted(range(len(b)), key=lambda k: -fills[k])
    pool = ranked[: max(1, len(ranked) // 2)]
    chosen = rng.permutation(len(pool))[: max(1, len(pool) // 4)]
    injected = [b[pool[k]] for k in chosen]
    taken = {i for x in injected for i in x}
    kept, loose = list(injected), []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(x)
        else:
            loose += [i for i in x if i not in taken]
    return _reinsert(kept, loose, lengths, capacity)


def mutate(a: Bins, lengths: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """The emptiest bins and some others are emptied and their pieces put back in another order."""
    fills = np.array([sum(lengths[i] for i in x) for x in a])
    poor = np.argsort(fills, kind="stable")[: 2 + len(a) // 50]
    gone = {*poor.tolist(), *rng.integers(len(a), size=2 + len(a) // 100).tolist()}
    loose = [i for k in gone for i in a[k]]
    kept = [list(x) for k, x in enumerate(a) if k not in gone]
    room = [capacity - sum(lengths[i] for i in x) for x in kept]
    order = sorted(loose, key=lambda i: -lengths[i] * (1 + 0.2 * rng.random()))
    best_fit(order, lengths, capacity, kept, room)
    return kept


def start_population(lengths: list[int], capacity: int, rng: np.random.Generator) -> list[Bins]:
    out = []
    for k in range(POPULATION):
        noise = np.zeros(len(lengths)) if not k else rng.random(len(lengths)) * 0.15 * k
        order = np.argsort(-np.array(lengths) * (1 + noise), kind="stable").tolist()
        bins: Bins = []
        best_fit(order, lengths, capacity, bins, [])
        out.append(bins)
        if len(bins) == bound(lengths, capacity):
            break
    return out


def bound(lengths: list[int], capacity: int) -> int:
    return -(-sum(lengths) // capacity)


def evolve(population: list[Bins], lengths: list[int], capacity: int, rng: np.random.Generator, generations: int = GENERATIONS) -> list[Bins]:
    """The population after some generations, best first; it stops at the bound."""
    least = bound(lengths, capacity)
    key = lambda p: fitness(p, lengths, capacity)
    population = sorted(population, key=key, reverse=True)
    for _ in range(generations):
        if len(population[0]) == least:
            break
        mother, father = population[0], population[int(rng.integers(len(population)))]
        children = [crossover(father, mother, lengths, capacity, rng), mutate(mother, lengths, capacity, rng)]
        population = sorted(population + children, key=key, reverse=True)[:POPULATION]
    return population


def _pack(bins: Bins, n: int) -> bytes:
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _unpack(raw: bytes) -> Bins:
    place = np.frombuffer(raw, np.int32)
    order = np.argsort(place, kind="stable")
    return [x.tolist() for x in np.split(order, np.cumsum(np.bincount(place))[:-1])] if len(place) else []


def pieces(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32: what is to be packed. uids are only unique in a written table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at = encoder(path), TaskContext.get().partitionId() << 33
        for b in batches:
            ids, counts = enc.encode(b.column(1))
            ids, end = ids.astype("<u4"), np.array([end_id], "<u4")
            rows: list[tuple] = []
            stop = 0
            for doc, n in zip(b.column(0).to_pylist(), counts.tolist(), strict=True):
                own = np.concatenate([ids[stop : stop + n], end])
                stop += n
                for k in range(0, n + 1, capacity):
                    part = own[k : k + capacity]
                    rows.append((at, doc, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
                    at += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(thrifty(work), schema)


_STATE = "shard int, island int, uids binary, lengths binary, elite binary, population array<binary>"


def _shards(loose: DataFrame, n_shards: int, capacity: int) -> DataFrame:
    """A row per island of each shard, holding its pieces and first population."""

    def gather(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        lengths = pdf["length"].tolist()
        rows = []
        for island in range(ISLANDS):
            rng = np.random.default_rng([17, int(key[0]), island])
            population = evolve(start_population(lengths, capacity, rng), lengths, capacity, rng, GENERATIONS)
            packed = [_pack(p, len(lengths)) for p in population]
            rows.append((int(key[0]), island, pdf["uid"].to_numpy(np.int64).tobytes(), pdf["length"].to_numpy(np.int32).tobytes(), packed[0], packed))
            if len(population[0]) == bound(lengths, capacity):
                break  # nothing is left to gain on this shard
        return pd.DataFrame(rows, columns=["shard", "island", "uids", "lengths", "elite", "population"])

    dealt = loose.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(n_shards)), F.lit(n_shards)).cast("int").alias("shard"))
    return dealt.groupBy("shard").applyInPandas(thrifty_group(gather), _STATE)


def _epoch(state: DataFrame, epoch: int, capacity: int) -> DataFrame:
    """Elites migrate to the next island of their shard, then every island evolves."""
    guests = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite").alias("guest"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                lengths = np.frombuffer(r.lengths, np.int32).tolist()
                population = [_unpack(p) for p in r.population]
                if r.guest is not None:
                    population.append(_unpack(r.guest))
                rng = np.random.default_rng([19, epoch, r.shard, r.island])
                packed = [_pack(p, len(lengths)) for p in evolve(population, lengths, capacity, rng)]
                rows.append((r.shard, r.island, r.uids, r.lengths, packed[0], packed))
            yield pd.DataFrame(rows, columns=["shard", "island", "uids", "lengths", "elite", "population"])

    return state.join(guests, ["shard", "island"], "left").mapInPandas(thrifty(work), _STATE)


def _settle(state: DataFrame, level: int, last: bool, capacity: int) -> DataFrame:
    """uid, length, sequence_id, offset of the best island of each shard; sequence_id is null in bins to open again."""

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        top = max(pdf.itertuples(index=False), key=lambda r: (*fitness(_unpack(r.elite), np.frombuffer(r.lengths, np.int32).tolist(), capacity), -r.island))
        uids, lengths = np.frombuffer(top.uids, np.int64), np.frombuffer(top.lengths, np.int32)
        for k, b in enumerate(_unpack(top.elite)):
            own = lengths[b].astype(np.int64)
            kept = last or own.sum() >= OPEN_BELOW * capacity
            sequence = (level << 56) | (int(top.shard) << 20) | k if kept else None
            rows.append(pd.DataFrame({"uid": uids[b], "length": own, "sequence_id": pd.array([sequence] * len(b), "Int64"), "offset": np.cumsum(own) - own}))
        return pd.concat(rows)

    return state.groupBy("shard").applyInPandas(best, "uid long, length long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    ws = Workspace(docs.sparkSession, "packing")
    table = ws.save(pieces(docs, path, end_id, capacity), "pieces")
    loose = table.where(F.col("length") < capacity).select("uid", "length")
    placed = table.where(F.col("length") >= capacity).select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    total = loose.count()
    for level in range(MAX_LEVELS):
        if not total:
            break
        n_shards = -(-total // SHARD)
        last = n_shards == 1 or level == MAX_LEVELS - 1
        state = ws.save(_shards(loose, n_shards, capacity), f"state-{level}")
        for epoch in range(EPOCHS):
            state = ws.save(_epoch(state, epoch, capacity), f"state-{level}-{epoch}")
        settled = ws.save(_settle(state, level, last, capacity), f"settled-{level}")
        placed = placed.unionByName(settled.where("sequence_id is not null").select("uid", "sequence_id", "offset"))
        loose = settled.where("sequence_id is null").select("uid", "length")
        if last:
            break
        total = loose.count()
    return table.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
