"""Token ids of whole texts with a public tokenizer file, fast on large batches.

Both byte-level and word-end BPE cut a text before a single space or line feed that stands between two characters that
are no white space, and encode what lies between cuts on its own. So a text is split there, each distinct piece is encoded once by
the tokenizers library and remembered by its bytes, and a batch's ids are gathered from those. Splits are made only
where both neighbours are plain ASCII or Latin-1 letters (lead byte 0xC3); around anything else the piece just grows.

A piece of up to ``SHORT`` bytes is its own key: two 64-bit numbers hold its bytes and its length. Longer pieces are keys
of a dict. So no hash stands for a piece, and no two pieces are ever taken for one another.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from . import textkit as K

#: New pieces that are encoded as one text.
JOINED = 2048
#: Pieces that a process remembers; beyond it starts anew.
MEMORY = 1_500_000
SLICE = 1 << 20
SHORT = 15
#: Twice what a process remembers, with the pieces of a slice, and more.
SLOTS = 1 << 22

_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        # both vocabularies write a token's bytes as one character each, and mark word ends by a suffix
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.widths[i] = len(token.removesuffix("</w>"))
        probe = self.tokenizer.encode(" a b", add_special_tokens=False).ids
        self.spaces = int(self.widths[probe].sum() == 4)

    def _forget(self) -> None:
        #: entry of each slot of an open hash table over short pieces, -1 if free
        self.table = np.full(SLOTS, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.n = 0
        self.key0, self.key1 = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(0, np.uint32), 0

    @staticmethod
    def _slot(key0: np.ndarray, key1: np.ndarray) -> np.ndarray:
        return (K.mix(key0 ^ K.mix(key1)) & np.uint64(SLOTS - 1)).astype(np.int64)

    def _find(self, key0: np.ndarray, key1: np.ndarray) -> np.ndarray:
        """Entries of short pieces, -1 for new ones."""
        slot = self._slot(key0, key1)
        out = self.table[slot]
        rest = np.flatnonzero(out >= 0)
        rest = rest[(self.key0[out[rest]] != key0[rest]) | (self.key1[out[rest]] != key1[rest])]
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (SLOTS - 1)
            entry = self.table[slot[rest]]
            out[rest] = entry
            rest = rest[(entry >= 0) & ((self.key0[entry] != key0[rest]) | (self.key1[entry] != key1[rest]))]
        return out

    def _insert(self, key0: np.ndarray, key1: np.ndarray, entries: np.ndarray) -> None:
        """New, distinct short pieces."""
        slot, rest = self._slot(key0, key1), np.arange(len(entries))
        while len(rest):
            free = self.table[slot[rest]] < 0
            self.table[slot[rest[free]]] = entries[rest[free]]
            rest = rest[self.table[slot[rest]] != entries[rest]]
            slot[rest] = (slot[rest] + 1) & (SLOTS - 1)

    def _grown(self, old: np.ndarray, n: int) -> np.ndarray:
        if n <= len(old):
            return old
        new = np.zeros(max(n, len(old) * 5 // 4, 1 << 14), old.dtype)
        new[: len(old)] = old
        return new

    def _encode_each(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        ids = [e.ids for e in encode([p.decode() for p in pieces], add_special_tokens=False)]
        return np.array([t for x in ids for t in x], np.uint32), np.array([len(x) for x in ids], np.int32)

    def _encode_joined(self, text: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces that each are a space or line feed and plain characters: as one text, cut where their bytes end;
        none if ids do not end there."""
        if b"<|" in text:
            return None
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        ids = np.array(encode([text.decode()], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum(self.widths[ids])
        wanted = np.cumsum(sizes - 1 + self.spaces)
        at = np.searchsorted(ends, wanted)
        if not len(ids) or ends[-1] != wanted[-1] or not np.array_equal(ends[at], wanted):
            return None
        return ids, np.diff(np.concatenate([[0], at + 1])).astype(np.int32)

    def _learn(self, part: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The entries that these new pieces of a slice get."""
        raw = part[K.gather_runs(starts, sizes)]
        begins = np.cumsum(sizes) - sizes
        # a plain character is printable ASCII or a Latin-1 letter: lower-casing keeps its number of bytes
        fits = _PLAIN[raw] | (raw == 0xC3)
        fits[1:] |= ((raw[1:] & 0xC0) == 0x80) & (raw[:-1] == 0xC3)
        fits[begins] = (raw[begins] == 0x20) | (raw[begins] == 0x0A)
        joinable = np.logical_and.reduceat(fits, begins) & (sizes > 1)
        order = np.argsort(~joinable, kind="stable")
        n, data = int(joinable.sum()), None
        ids, lengths = [], []
        for rows in [order[k : min(k + JOINED, n)] for k in range(0, n, JOINED)] + [order[n:]]:
            found = None
            if len(rows) and joinable[rows[0]]:
                found = self._encode_joined(raw[K.gather_runs(begins[rows], sizes[rows])].tobytes(), sizes[rows])
            if found is None:
                data = data if data is not None else raw.tobytes()
                found = self._encode_each([data[a : a + c] for a, c in zip(begins[rows].tolist(), sizes[rows].tolist(), strict=True)])
            ids.append(found[0])
            lengths.append(found[1])
        ids, lengths = np.concatenate(ids), np.concatenate(lengths)
        first, self.n = self.n, self.n + len(sizes)
        self.flat = self._grown(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts, self.lengths = self._grown(self.starts, self.n), self._grown(self.lengths, self.n)
        self.key0, self.key1 = self._grown(self.key0, self.n), self._grown(self.key1, self.n)
        self.starts[first : self.n] = self.used + np.cumsum(lengths, dtype=np.int64) - lengths
        self.lengths[first : self.n] = lengths
        self.used += len(ids)
        entries = np.empty(len(sizes), np.int64)
        entries[order] = np.arange(first, self.n)
        return entries

    def _entries(self, part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of every piece of a slice; new pieces are learnt."""
        size, blocks = ends - starts, K.blocks_view(part)
        key0 = K.block_of(blocks, starts, size, 0)
        key1 = size.astype(np.uint64) << np.uint64(56)
        longer = np.flatnonzero((size > 8) & (size <= SHORT))
        key1[longer] |= K.block_of(blocks, starts[longer], size[longer], 1)
        out = self._find(key0, key1)
        wide = np.flatnonzero(size > SHORT)
        if len(wide):
            data = part.tobytes()
            keys = [data[a:b] for a, b in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True)]
            new = {k: i for k, i in zip(keys, wide.tolist(), strict=True) if k not in self.long}
            if new:
                rows = np.array([*new.values()])
                self.long.update(zip(new, self._learn(part, starts[rows], size[rows]).tolist(), strict=True))
            out[wide] = [self.long[k] for k in keys]
        missing = np.flatnonzero(out < 0)
        if len(missing):
            own0, own1 = key0[missing], key1[missing]
            order = np.lexsort((own0, own1))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (own0[order[1:]] != own0[order[:-1]]) | (own1[order[1:]] != own1[order[:-1]])
            rows = missing[order[fresh]]
            entries = self._learn(part, starts[rows], size[rows])
            self.key0[entries], self.key1[entries] = key0[rows], key1[rows]
            self._insert(key0[rows], key1[rows], entries)
            out[missing[order]] = entries[np.cumsum(fresh) - 1]
        return out

    def _pieces(self, raw: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        n = len(raw)
        if not n:
            return np.zeros(0, np.int64)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:] = _PLAIN[raw[:-1]]
        before[2:] |= (raw[1:-1] >= 0x80) & (raw[:-2] == 0xC3)
        after[:-1] = _PLAIN[raw[1:]] | (raw[1:] == 0xC3)
        starts = ((raw == 0x20) | (raw == 0x0A)) & before & after
        starts[cuts[:-1][np.diff(cuts) > 0]] = True
        return np.flatnonzero(starts)

    def encode(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids of each text)."""
        raw, offsets = K.buffers(array)
        parts, counts = [], np.zeros(len(offsets) - 1, np.int64)
        for i, j in K.slices(offsets, SLICE):
            part = raw[offsets[i] : offsets[j]]
            cuts = offsets[i : j + 1] - offsets[i]
            starts = self._pieces(part, cuts)
            ends = np.append(starts[1:], len(part))
            sizes, first = [], 0
            while first < len(starts):  # a very long text: some of its pieces at a time
                last = max(first + 1, int(np.searchsorted(ends, starts[first] + SLICE, "right")))
                if self.n + (last - first) // 4 > MEMORY or self.n + last - first > SLOTS // 2:
                    self._forget()
                base, stop = starts[first], ends[last - 1]
                at = self._entries(part[base:stop], starts[first:last] - base, ends[first:last] - base)
                lengths = self.lengths[at].astype(np.int64)
                parts.append(self.flat[K.gather_runs(self.starts[at], lengths)])
                sizes.append(lengths)
                first = last
            total = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
            counts[i:j] = np.diff(total[np.searchsorted(starts, cuts)])
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder of a tokenizer file; it remembers pieces from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
