"""Queries of the subpackage against their SQL, or against brute force where SQL cannot express them."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from helpers import rows_of
from korvex.llm import queries as llm

FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def classes(rows):
    """Brute-force (size, smallest linked doc_id) of (doc_id, text) rows with distinct ids."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for d in sorted(sets):
        for y, k in Counter(y for g in sets[d] for y in where[g]).items():
            if 100 * k >= 75 * (len(sets[d]) + len(sets[y]) - k):
                a, b = find(y), find(d)
                parent[max(a, b)] = min(a, b)
        for g in sets[d]:
            where[g].append(d)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def kept_lines(rows):
    """Brute-force texts after line dedup of (doc_id, text) rows in order."""
    where, sizes, out = defaultdict(list), [], {}
    for d, text in rows:
        keep = []
        for line in text.split("\n") if text else []:
            s = shingles(line)
            hits = Counter(y for g in s for y in where[g])
            if not any(100 * k >= 75 * (len(s) + sizes[y] - k) for y, k in hits.items()):
                keep.append(line)
            for g in s:
                where[g].append(len(sizes))
            sizes.append(len(s))
        out[d] = "\n".join(keep)
    return out


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_matches_sql(spark, sf, duck, name):
    got, want = llm.QUERIES[name](spark, sf).toPandas(), duck.sql(llm.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def documents(duck):
    return duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def test_quality_held_out(spark, sf, duck):
    got = llm.QUERIES["op2_quality_scores"](spark, sf).toPandas()
    labels = duck.sql("SELECT doc_id, quality FROM labels").df().merge(got, on="doc_id")
    held = labels[labels.held_out]
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    assert (held.predicted == held.quality).mean() > 0.9


def test_neighbours_recall(spark, sf, duck):
    got = llm.QUERIES["op3_nearest_neighbours"](spark, sf).toPandas()
    e = duck.sql("SELECT vec_id, embedding FROM embeddings").df()
    x, ids, hits = np.array(e.embedding.tolist(), float), e.vec_id.to_numpy(), 0
    found = {q: dict(zip(g.vec_id, g.score, strict=True)) for q, g in got.groupby("query_id")}
    for i in np.flatnonzero(ids % 50 == 0):
        score = (x @ x[i]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[i]))
        score[i] = -9
        best = ids[np.lexsort((ids, -score))[:5]]
        hits += len({*best} & {*found[ids[i]]})
        assert all(abs(score[np.flatnonzero(ids == v)[0]] - s) < 1e-12 for v, s in found[ids[i]].items())
    assert hits >= 0.9 * 5 * (ids % 50 == 0).sum()


def test_line_dedup(spark, sf, duck):
    got = llm.QUERIES["op5_line_dedup"](spark, sf).toPandas().set_index("doc_id")
    for d, text in kept_lines(documents(duck)).items():
        assert got.kept_md5[d] == hashlib.md5(text.encode()).hexdigest()


def test_gram_join(spark, sf, duck):
    got = llm.QUERIES["op6_gram_join"](spark, sf).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == classes(documents(duck))


def encoded(duck, name, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    rows = documents(duck)
    return [(d, np.array([*e.ids, end], "<u4")) for (d, _), e in zip(rows, t.encode_batch([x or "" for _, x in rows], add_special_tokens=False), strict=True)]


def test_binary_ids(spark, sf, duck):
    got = llm.QUERIES["op8_binary_ids"](spark, sf).toPandas().sort_values("doc_id")
    want, start = [], 0
    for d, ids in encoded(duck, "byte_bpe_50k.json", 2):
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert list(got.itertuples(index=False, name=None)) == want


def test_packing(spark, sf, duck):
    got = llm.QUERIES["op9_pack_sequences"](spark, sf).toPandas()
    want = {(d, k // 4096, k, len(p := ids[k : k + 4096]), zlib.crc32(p.tobytes())) for d, ids in encoded(duck, "word_bpe_49k.json", 1) for k in range(0, len(ids), 4096)}
    assert {*got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)} == want and len(got) == len(want)
    check_layout(got)
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) * 1.02 + 1


def check_layout(got):
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all() and g.length.sum() <= 4096
