"""Quality scores by a generalised additive model with pairwise interactions.

Every text becomes a row of features, each cut into at most ``BINS`` bins. Training cycles over the features: a shallow
regression tree of the logistic loss's gradient on one feature's bins is added to that feature's lookup table; then the
pairs of features with the largest remaining gain get tables of their own in the same way. A score is the logistic of
the intercept and the table entries of the text's bins: additions, a whole batch at a time.

The model is fitted on a bounded sample: the ``MAX_LABELS`` rows of ``labels`` of smallest doc_id hash, of those whose
crc32(doc_id) mod ``FOLDS`` is not 0. Scoring covers every text, whole. Features read the text alone.

Defined cases: null and empty texts have all features 0 and are scored like any; labels without quality or without a
document teach nothing; without labels of both kinds the score is the share of ones (0.5 without any); repeated rows
are scored each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import text_or_empty, thrifty

FOLDS = 5
MAX_LABELS = 20_000
BINS = 32
PAIR_BINS = 8
THRESHOLD = 0.3
FEATURES = [
    "log_words", "word_length", "upper", "symbols", "punctuation", "digits", "bangs", "distinct_words", "top_word",
    "repeated_next", "short_words", "capitalised", "symbol_ends", "line_words", "distinct_lines", "wide_bytes",
]

_UPPER, _SYMBOL, _PUNCT, _DIGIT = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_PUNCT[[ord(c) for c in ".,;:'\"!?()-"]] = True
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_SYMBOL &= ~_PUNCT


def text_features(array: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    raw, offsets = K.buffers(array)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for i, j in K.slices(offsets):
        part = raw[offsets[i] : offsets[j]]
        cuts = offsets[i : j + 1] - offsets[i]
        out[i:j] = _slice_features(part, cuts)
    return out


def _per_doc(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[cuts])


def _slice_features(raw: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    starts, ends = K.word_spans(raw, cuts)
    at = np.searchsorted(starts, cuts)
    words = np.diff(at)
    size = np.maximum(np.diff(cuts), 1)
    n = np.maximum(words, 1)
    wide_upper = np.zeros(len(raw), bool)
    if len(raw) > 1:
        wide_upper[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    upper = _UPPER[raw] | wide_upper
    hashes = K.span_hashes(raw, starts, ends, lower=False)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[at[:-1][words > 0]] = False
    lines = np.flatnonzero(raw == 0x0A)
    line_starts = np.unique(np.concatenate([cuts[:-1][np.diff(cuts) > 0], lines + 1]))
    line_starts = line_starts[line_starts < len(raw)]
    line_ends = np.append(line_starts[1:], len(raw))
    line_hashes = K.span_hashes(raw, line_starts, line_ends, lower=False)
    line_at = np.searchsorted(line_starts, cuts)
    distinct, top, distinct_lines = np.zeros(len(words)), np.zeros(len(words)), np.zeros(len(words))
    for d in range(len(words)):
        own = np.sort(hashes[at[d] : at[d + 1]])
        if len(own):
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            distinct[d], top[d] = len(new) - 1, np.diff(new).max()
        distinct_lines[d] = len(np.unique(line_hashes[line_at[d] : line_at[d + 1]]))
    length = ends - starts
    word_sum = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    n_lines = np.maximum(np.diff(line_at), 1)
    return np.column_stack([
        np.log1p(words),
        word_sum(length) / n,
        _per_doc(upper, cuts) / size,
        _per_doc(_SYMBOL[raw], cuts) / size,
        _per_doc(_PUNCT[raw], cuts) / size,
        _per_doc(_DIGIT[raw], cuts) / size,
        _per_doc(raw == 0x21, cuts) / size,
        distinct / n,
        top / n,
        word_sum(again) / n,
        word_sum(length <= 3) / n,
        word_sum(upper[np.minimum(starts + (raw[starts] == 0xC3), len(raw) - 1)] if len(starts) else again) / n,
        word_sum(_SYMBOL[raw[ends - 1]] if len(ends) else again) / n,
        np.log1p(words / n_lines),
        distinct_lines / n_lines,
        _per_doc(raw >= 0x80, cuts) / size,
    ])


@dataclass
class AdditiveModel:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, f], "right")]
        for a, b, ea, eb, table in self.pairs:
            out += table[np.searchsorted(ea, x[:, a], "right"), np.searchsorted(eb, x[:, b], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, smooth: float) -> np.ndarray:
    """Leaf values per bin of a tree of at most ``leaves`` leaves over ordered bins."""
    segments = [(0, len(g))]
    gain = lambda s, t: s * s / (t + smooth)
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(segments) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(segments):
            if b - a < 2:
                continue
            cut = np.arange(a + 1, b)
            left_g, left_h = cg[cut] - cg[a], ch[cut] - ch[a]
            whole_g, whole_h = cg[b] - cg[a], ch[b] - ch[a]
            gains = gain(left_g, left_h) + gain(whole_g - left_g, whole_h - left_h) - gain(whole_g, whole_h)
            top = int(np.argmax(gains))
            if gains[top] > best[0]:
                best = (float(gains[top]), k, int(cut[top]))
        if best[1] is None:
            break
        a, b = segments.pop(best[1])
        segments += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in segments:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + smooth)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[float, np.ndarray]:
    """The best tree that cuts both axes once, of a two-way table of gradients: its gain and its cell values."""
    cg, ch = (np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (g, h))
    rows, cols = g.shape
    best, value = 0.0, np.zeros_like(g)
    whole = cg[rows, cols] ** 2 / (ch[rows, cols] + smooth)
    for r in range(1, rows):
        for c in range(1, cols):
            parts = [(0, r, 0, c), (0, r, c, cols), (r, rows, 0, c), (r, rows, c, cols)]
            sums = [(cg[b, d] - cg[a, d] - cg[b, e] + cg[a, e], ch[b, d] - ch[a, d] - ch[b, e] + ch[a, e]) for a, b, e, d in parts]
            gain = sum(s * s / (t + smooth) for s, t in sums) - whole
            if gain > best:
                best, value = gain, np.zeros_like(g)
                for (a, b, e, d), (s, t) in zip(parts, sums, strict=True):
                    value[a:b, e:d] = s / (t + smooth)
    return best, value


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, pairs: int = 4, pair_rounds: int = 20, rate: float = 0.15, smooth: float = 3.0) -> AdditiveModel:
    model = AdditiveModel()
    share = float(y.mean()) if len(y) else 0.5
    model.intercept = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6))))
    model.edges = [_edges(x[:, f], BINS) if len(x) else np.zeros(0) for f in range(len(FEATURES))]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if share in (0.0, 1.0) or not len(y):
        return model
    logit = np.full(len(y), model.intercept)
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    for _ in range(rounds):
        for f, own in enumerate(bins):
            p = 1 / (1 + np.exp(-logit))
            size = len(model.tables[f])
            step = rate * _tree(np.bincount(own, y - p, size), np.bincount(own, p * (1 - p), size), 4, smooth)
            model.tables[f] += step
            logit += step[own]
    coarse = [_edges(x[:, f], PAIR_BINS) for f in range(len(FEATURES))]
    cells = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]

    def table(values: np.ndarray, a: int, b: int) -> np.ndarray:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(cells[a] * shape[1] + cells[b], values, shape[0] * shape[1]).reshape(shape)

    def update(a: int, b: int) -> tuple[float, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return _quadrants(table(y - p, a, b), table(p * (1 - p), a, b), smooth)

    gains = sorted(((update(a, b)[0], a, b) for a in range(len(FEATURES)) for b in range(a)), reverse=True)[:pairs]
    found = {(a, b): np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for _, a, b in gains}
    for _ in range(pair_rounds):
        for (a, b), values in found.items():
            step = rate * update(a, b)[1]
            values += step
            logit += step[cells[a], cells[b]]
    model.pairs = [(a, b, coarse[a], coarse[b], values) for (a, b), values in found.items()]
    return model


def fold() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> AdditiveModel:
    """Fit on a bounded sample of the labels outside the held-out fold."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0))
        .select(F.col("doc_id").alias("__doc"), F.col("quality").cast("int").alias("__quality"))
        .orderBy(F.xxhash64("__doc"), "__doc", "__quality")
        .limit(max_labels)
    )
    names = [f"f{i}" for i in range(len(FEATURES))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = text_features(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x[:, i]) for i in range(len(FEATURES))]], ["d", "y", *names])

    # at most max_labels rows of 12 bytes are broadcast
    pairs = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__doc"))
    rows = (
        pairs.select("doc_id", "__quality", "text")
        .mapInArrow(thrifty(work), "d long, y int, " + ", ".join(f"{n} double" for n in names))
        .dropDuplicates(["d"])
        .orderBy("d")
        .toPandas()
    )
    return fit(rows[names].to_numpy(float).reshape(-1, len(FEATURES)), (rows["y"].to_numpy() > 0).astype(float))


def score_documents(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(text_features(b.column(2)))
            columns = [b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    chosen = docs.select(F.col("doc_id").cast("long"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), text_or_empty().alias("text"))
    return chosen.mapInArrow(thrifty(work), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns kept."""
    schema = docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(b.schema.get_field_index("text"))
            yield b.filter(pa.array(model.score(text_features(text)) >= threshold))

    return docs.mapInArrow(thrifty(work), schema)
