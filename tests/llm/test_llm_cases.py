"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import dis
import gzip
import random
import re
import sys
import zlib

import numpy as np
import pytest

import public_tokenizers
from korvex.llm import grams, idcodec, lines, mixing, packing, pii, pivots, projections, quality, textkit, tokens, vectors, warc
from korvex.llm.common import Workspace, connected_components
from test_llm_queries import check_layout, classes, kept_lines, shingles

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def test_mixing_cases(odd_docs, no_docs, make_docs):
    got = mixing.mix_schedule(odd_docs).toPandas()
    assert len(got) == 10 and (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(by.taken - by.target) <= 1).all() and (by.target <= 2 * by["size"]).all()
    assert abs(by.target.sum() - 1.5 * got["size"].sum()) < 1e-6
    assert mixing.mix_schedule(no_docs).count() == 0 and mixing.mix_documents(no_docs).count() == 0
    many = make_docs([(i, "w " * (1 + i % 9), "hot" if i % 3 else f"s{i % 7}") for i in range(600)])
    a, b = mixing.mix_schedule(many).toPandas(), mixing.mix_schedule(many).toPandas()
    assert a.sort_values("doc_id").values.tolist() == b.sort_values("doc_id").values.tolist()
    # every stretch of the schedule holds the sources near their shares
    texts = make_docs([(i, "w " * (20 + i % 9), "hot" if i % 3 else f"s{i % 4}") for i in range(3000)])
    order = mixing.mix_schedule(texts).toPandas().sort_values("first_slot").dropna(subset="first_slot")
    share = order.groupby("source").target.first() / order.groupby("source").target.first().sum()
    for n in (300, 700, 1200):
        part = order.head(n)
        got_share = part.groupby("source").taken.sum() / part.taken.sum()
        assert (got_share - share).abs().max() < 0.1
    slotted = mixing.mix_documents(texts, slot="at").toPandas()
    assert slotted["at"].notna().all() and slotted["at"].nunique() > 1000
    copies = mixing.mix_documents(many)
    assert copies.columns == many.columns and copies.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2


def test_quality_cases(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(odd_docs, labels)
    assert quality.score_documents(odd_docs, model).count() == 10
    assert quality.score_documents(no_docs, quality.train(no_docs, labels)).count() == 0
    none = quality.train(odd_docs, labels.limit(0))
    assert {round(r["score"], 6) for r in quality.score_documents(odd_docs, none).collect()} == {0.5}
    assert quality.keep_good(odd_docs, none).count() == 10 and quality.keep_good(odd_docs, none).columns == odd_docs.columns


def test_quality_learns_interactions():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


VECTORS = "vec_id long, embedding array<float>, label int, score string"


def vector_rows(n=400, dim=8, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    rows = [(i, [float(v) for v in x[i]], 0, "extra") for i in range(n)]
    rows[20] = (20, rows[40][1], 0, "")  # equal vectors
    return rows + [
        (1000, None, 0, ""), (1020, [0.0] * dim, 0, ""), (1040, [float("nan")] * dim, 0, ""), (1060, [None] + [1.0] * (dim - 1), 0, ""),
        (1080, [1.0], 0, ""), (None, [1.0] * dim, 0, ""), (1100, [float("inf")] * dim, 0, ""),
    ]


def test_projection_cases(spark):
    rows = vector_rows()
    got = projections.nearest_by_cosine(spark.createDataFrame(rows, VECTORS), every=20).toPandas()
    x = {i: np.array(np.float32(v), float) for i, v, _, _ in rows[:400]}
    assert set(got.query_id) == {i for i in x if i % 20 == 0}
    hits = 0
    for q, g in got.groupby("query_id"):
        score = {i: float(v @ x[q] / np.linalg.norm(v) / np.linalg.norm(x[q])) for i, v in x.items() if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:5]
        hits += len({*best} & {*g.vec_id})
        assert list(g["rank"]) == [1, 2, 3, 4, 5] and np.allclose(g.score, [score[i] for i in g.vec_id], atol=1e-12)
    assert hits >= 0.9 * len(got)
    few = spark.createDataFrame(rows[:3], VECTORS)
    assert projections.nearest_by_cosine(few).count() == 2
    assert projections.nearest_by_cosine(few.limit(0)).count() == 0
    assert abs(projections.chi_square_quantile(0.95, 8) - 15.507) < 1e-3


def test_pivot_cases(spark):
    rows = vector_rows(300)
    got = pivots.top_inner_products(spark.createDataFrame(rows, VECTORS)).toPandas()
    z = {i: np.floor(64 * np.array(np.float32(v), float)) for i, v, _, _ in rows[:300]}
    z[1020] = np.zeros(8)
    for q in (i for i in z if i % 20 == 0):
        want = sorted(((-int(z[q] @ v), i) for i, v in z.items() if i != q))[:20]
        own = got[got.query_id == q].sort_values("rank")
        assert [(-s, i) for s, i in zip(own.score, own.vec_id, strict=True)] == want
    assert pivots.top_inner_products(spark.createDataFrame(rows[:1], VECTORS)).count() == 0
    assert pivots.top_inner_products(spark.createDataFrame([], VECTORS)).count() == 0


def test_pivots_skip_rows():
    rng = np.random.default_rng(1)
    x = np.floor(np.concatenate([rng.normal(c, 1, (500, 8)) for c in (-40, 0, 40)]))
    longest = float((x**2).sum(axis=1).max())
    chosen = pivots.choose_pivots(x, 16)
    lift = np.sqrt(longest - (x**2).sum(axis=1))
    table = pivots.pivot_distances(x, lift, chosen, longest).astype(np.float32)
    asked = pivots.pivot_distances(x[1400:1410], np.zeros(10), chosen, longest).astype(np.float32)
    found, evaluated = pivots.search_block(np.arange(1400, 1410), x[1400:1410], asked, np.arange(1500), x, table, longest, 20)
    assert evaluated < 0.8 * 10 * 1500
    for q, ids, score in found:
        want = sorted(((-(x[q] @ x[i]), i) for i in range(1500) if i != q))[:20]
        assert [(-s, i) for s, i in zip(score, ids, strict=True)] == want


PLAIN = {
    0: re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    1: re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    2: re.compile(r"[0-9]([\x20-]?[0-9])+"),
    3: re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for kind, p in PLAIN.items():
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = kind == 0 or kind == 1 and all(int(x) <= 255 for x in m.group().split(".")) or kind == 2 and 16 <= len(digits) <= 19 and pii.luhn(digits) or kind == 3 and 8 <= len(digits) <= 15
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans():
    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("ab@.@0123..+- ()9-5é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []


def test_pii_added_spans(odd_docs, no_docs, make_docs):
    w = pii.trained_weights()
    added = lambda t: [(pii.KINDS[k], t[a:b]) for k, a, b in pii.added_spans(t, pii.base_spans(t), w)]
    assert added("call (988) 555-2485 now") == [("phone", "(988) 555-2485")]
    assert added("card 4111.1111.1111.1111 x") == [("card", "4111.1111.1111.1111")]
    assert added("write jo at mail dot com and") == [("email", "jo at mail dot com")]
    for clean in ("Licensed under CC BY-NC 4.0.", "v 1.2.3 and 2024-01-02, 12:30:01", "look at the house. dot com", "the the of 1234 and 99", "card 4111 1111 1111 1112 x"):
        assert added(clean) == []
    got = pii.find_pii(odd_docs).toPandas()
    assert len(got) == 10 and got[got.doc_id == 1].spans.tolist() == [""]
    assert pii.find_pii(no_docs).count() == 0
    row = pii.find_pii(make_docs([(1, "a@b.c 1.2.3.4 +1 234 567 8901", "s")])).first()
    assert row["n_email"] == row["n_ip"] == row["n_phone"] == 1 and row["spans"].startswith("email:0:5,ip:6:13,phone:14:")


def test_semi_markov_sums():
    """The dynamic programmes against every segmentation of a small lattice."""
    rng = np.random.default_rng(4)
    starts, ends = np.array([0, 0, 1, 2]), np.array([1, 2, 3, 4])
    scores = rng.normal(size=(4, 2))
    total, best, marginal = 0.0, (-1.0, None), np.zeros((4, 2))

    def walk(p, weight, used):
        nonlocal total, best
        if p == 4:
            total += np.exp(weight)
            best = max(best, (weight, used))
            for s, k in used:
                marginal[s, k] += np.exp(weight)
            return
        walk(p + 1, weight, used)
        for s in range(4):
            if starts[s] == p:
                for k in range(2):
                    walk(ends[s], weight + scores[s, k], [*used, (s, k)])

    best = (0.0, [])
    walk(0, 0.0, [])
    assert np.allclose(pii.marginals(4, starts, ends, scores), marginal / total)
    assert pii.decode(4, starts, ends, scores) == best[1]


def near(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"z{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def copies():
    """Clusters of near copies around the threshold, exact copies, and passages that many texts share."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = " ".join(word() for _ in range(60))
    rows = []
    for c in range(6):
        base = [word() for _ in range(60 + 40 * c)]
        rows += [near(rng, base, k % 7) for k in range(40)]
    rows += [" ".join(word() for _ in range(50 + k)) + "\n" + passage + "\n" + " ".join(word() for _ in range(20)) for k in range(60)]
    rows += [passage + " " + " ".join(word() for _ in range(k)) for k in range(25)] + ["a b c", "A b  c", "b c a"] * 3
    return list(enumerate(rows))


def test_gram_cases(odd_docs, no_docs, make_docs, copies, monkeypatch):
    monkeypatch.setattr(grams, "GROUP", 8)
    docs = make_docs([(i, t, "s") for i, t in copies])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in grams.near_duplicate_classes(docs).collect()}
    assert got == classes(copies)
    kept = grams.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {c for d, (n, c) in got.items()}
    odd = grams.near_duplicate_classes(odd_docs).toPandas()
    assert len(odd) == 10 and set(odd[odd.doc_id.isin([5, 6])].component_id) == {5}
    assert odd[odd.doc_id.isna()].component_id.tolist() == [5] and odd[odd.doc_id == 1].component_id.tolist() == [1]
    assert odd[odd.doc_id == 7].component_id.tolist() == [7, 7]
    assert grams.near_duplicate_classes(no_docs).count() == 0


def test_line_cases(odd_docs, no_docs, make_docs, copies):
    rows = [(i, t.replace(" w1", "\nw1")) for i, t in copies]
    docs = make_docs([(i, t, "s") for i, t in rows])
    got = lines.drop_repeated_lines(docs).collect()
    assert {r["doc_id"]: r["text"] for r in got} == kept_lines(rows) and got[0]["taken"] == "extra"
    odd = {(r["doc_id"], r["n_lines"], r["n_removed"], r["text"] is None) for r in lines.drop_repeated_lines(odd_docs).collect()}
    assert {(1, 0, 0, True), (2, 0, 0, False), (6, 1, 1, False), (None, 1, 1, False), (7, 1, 0, False)} <= odd
    assert lines.drop_repeated_lines(no_docs).count() == 0


def test_shingles_match_words():
    import pyarrow as pa

    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "B", " ", "\n", "é", "É", "\x0b", " ", "zz "]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None]
    seen = {}
    for i, _, tok, counts in textkit.doc_shingles(pa.array(texts)):
        assert counts.tolist() == [len(shingles(t)) for t in texts[i : i + len(counts)]]
        for t, part in zip(texts[i : i + len(counts)], np.split(tok, np.cumsum(counts)[:-1]), strict=True):
            assert seen.setdefault(frozenset(part.tolist()), shingles(t)) == shingles(t)


def test_encoder_equals_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(3)
    bits = ["a", "B", " ", "  ", "\n", "é", " É", " ", "́", "'s", " 's", "1", "<|endoftext|>", "ß", " ", "\x1f", "—", "日本", "×", "İ", "\t", ".", "\u0085", "😀"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for path in (BYTES, WORDS):
        ids, counts = tokens.Encoder(path).encode(pa.array(texts))
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_codec_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_258, n), rng.integers(0, 3, n), np.zeros(n, int)):
        ids = ids.astype(np.uint32)
        data = idcodec.encode_ids(ids, block=256)
        assert np.array_equal(idcodec.decode_ids(data), ids)
    if n > 1000:
        broken = bytearray(idcodec.encode_ids(rng.integers(0, 50_000, n).astype(np.uint32), block=256))
        broken[-40] ^= 1
        with pytest.raises(ValueError):
            idcodec.decode_ids(bytes(broken))


def test_codec_beats_plain_models():
    """Fewer bytes than zlib and than the ids' own order-0 entropy, on text; documents come out of the file itself."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].combine_chunks()
    ids, counts = tokens.encoder(BYTES).encode(texts)
    share = np.bincount(ids) / len(ids)
    share = share[share > 0]
    docs, valid = np.arange(len(counts)) * 3 - 7, np.arange(len(counts)) % 5 > 0
    data = idcodec.encode_ids(ids, docs=docs, valid=valid, counts=counts)
    assert len(data) < len(zlib.compress(ids.astype("<u4").tobytes(), 9)) and 8 * len(data) < -(share * np.log2(share)).sum() * len(ids)
    got = idcodec.decode_file(data)
    assert all(np.array_equal(a, b) for a, b in zip(got, (ids, docs, valid, counts), strict=True))


def array_steps(call):
    """How many operations, calls and subscripts the codec's own lines make in ``call``, and what it returns."""
    counted, n = {dis.opmap[k] for k in ("BINARY_OP", "BINARY_SUBSCR", "COMPARE_OP", "UNARY_INVERT", "STORE_SUBSCR", "CALL", "CALL_KW")}, 0

    def trace(frame, event, arg):
        nonlocal n
        if frame.f_code.co_filename != idcodec.__file__:
            return None
        frame.f_trace_opcodes = True
        n += event == "opcode" and frame.f_code.co_code[frame.f_lasti] in counted
        return trace

    before = sys.gettrace()
    sys.settrace(trace)
    try:
        out = call()
    finally:
        sys.settrace(before)
    return n, out


def test_codec_takes_few_array_steps():
    """CPU time goes with the array steps for each step of ids: 441 and 536 when the check failed on 400 CPU s/GB."""
    ids = np.random.default_rng(8).integers(0, 500, 64 * idcodec.RUN).astype(np.uint32)
    encoded, data = array_steps(lambda: idcodec.encode_block(ids))
    decoded, (back, _) = array_steps(lambda: idcodec.decode_block(data, 0))
    assert np.array_equal(back, ids)
    assert 0 < encoded < 300 * idcodec.RUN and 0 < decoded < 370 * idcodec.RUN


def test_codec_file_stays():
    """The bytes of version 2 do not depend on how the models are computed; also ids that take more than 16 bits."""
    at = np.arange(40_000, dtype=np.uint64)
    for top, crc in ((500, 1850639748), (50_258, 2983206402), (1 << 19, 481551645)):
        ids = np.where(at * at % 7 < 4, at * at * 31 % 4099 % 97, at * 2654435761 % 1000003 % top).astype(np.uint32)
        data = idcodec.encode_ids(ids, block=30_000)
        assert zlib.crc32(data) == crc and np.array_equal(idcodec.decode_ids(data), ids)


def test_pieces_of_one_polynomial_hash():
    """Words that are equal under any polynomial modulo 2**64 stay apart in ids and shingles."""
    import pyarrow as pa

    flip = str.maketrans("ab", "ba")
    word = "a"
    while len(word) < 2048:
        word += word.translate(flip)
    texts = [word, word.translate(flip), word[:1024], word[:1024].translate(flip)]
    for path in (BYTES, WORDS):
        enc = tokens.Encoder(path)
        ids, counts = enc.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert len({int(t) for _, _, tok, _ in textkit.doc_shingles(pa.array(texts)) for t in tok}) == 4


def test_long_texts_in_pieces():
    """Word hashes of a text that is worked on a piece at a time equal those of the whole."""
    rng = random.Random(6)
    text = "".join(rng.choice(["ab", "é", " ", "\n", "long" * 40, "\n\n"]) for _ in range(6000)).encode()
    raw = np.frombuffer(text, np.uint8)
    bounds = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
    whole = textkit.unit_hashes(raw, bounds, step=len(raw))
    for step in (1, 7, 100, 5000):
        assert all(np.array_equal(a, b) for a, b in zip(textkit.unit_hashes(raw, bounds, step=step), whole, strict=True))


def test_binary_cases(odd_docs, no_docs):
    got = idcodec.encode_documents(odd_docs, BYTES).toPandas().sort_values("start")
    assert len(got) == 10 and got.doc_id.isna().tolist()[0] and got.n_tokens.min() == 1
    assert (got.start.to_numpy() == np.concatenate([[0], np.cumsum(got.n_tokens)[:-1]])).all()
    assert idcodec.encode_documents(no_docs, BYTES).count() == 0


def test_packing_cases(odd_docs, no_docs):
    got = packing.pack_documents(odd_docs, WORDS).toPandas()
    check_layout(got)
    assert (got[got.doc_id == 4].length == 4096).sum() > 5 and got[got.doc_id == 1].length.tolist() == [1]
    assert packing.pack_documents(no_docs, WORDS).count() == 0


def test_genetic_operators():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1000, 3000, 300).tolist()
    whole = lambda b: sorted(i for x in b for i in x) == list(range(300)) and max(sum(lengths[i] for i in x) for x in b) <= 4096
    first = packing.start_population(lengths, 4096, rng)
    assert all(map(whole, first)) and whole(packing.crossover(first[0], first[1], lengths, 4096, rng)) and whole(packing.mutate(first[0], lengths, 4096, rng))
    last = packing.evolve(first, lengths, 4096, rng, 10)
    assert all(map(whole, last)) and len(last[0]) <= min(map(len, first))
    assert packing._unpack(packing._pack(last[0], 300)) == [sorted(b) for b in last[0]]


PAGES = "page_id long, url string, html string, refers_to string"


def test_warc_cases(spark):
    rows = [(1, "http://a/ b\r\n", "<p>é</p>", ""), (2, None, "<p>é</p>", ""), (3, "u", None, ""), (4, "u", "", ""), (None, "u", "<p>é</p>", ""), (5, "u", "x" * 300_000, ""), (5, "u", "x" * 300_000, ""), (6, "u", "WARC/1.1\r\n\r\n", "")]
    got = warc.archive_pages(spark.createDataFrame(rows, PAGES)).toPandas()
    key = lambda i: got[got.page_id == i].iloc[0]
    assert len(got) == 8 and key(1).record_type == "response" and key(2).refers_to == 1 and key(4).refers_to == 3
    assert got[got.page_id.isna()].refers_to.tolist() == [1] and got[got.page_id == 5].record_type.tolist() == ["response"] * 2
    assert key(2).payload_bytes == 9 and key(2).payload_digest == warc.payload_digest("<p>é</p>".encode()) and key(6).record_type == "response"
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_normaliser():
    records = [warc.record_bytes(i, "u", b"payload %d\r\n\r\n" % i * (i + 1), None, False, "2024-01-01T00:00:00Z") for i in range(5)]
    whole = gzip.compress(b"".join(records))
    for data in (whole, gzip.compress(records[0]) + gzip.compress(b"".join(records[1:]))):
        out, index, n = warc.normalise_file(data)
        assert n == 5 and gzip.decompress(out) == b"".join(records)
        for line, record in zip(index.splitlines(), records, strict=True):
            at, size, _ = line.split(" ", 2)
            assert zlib.decompress(out[int(at) : int(at) + int(size)], 31) == record
    with pytest.raises(ValueError):
        warc.normalise_file(whole[:-30])


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in got} and {x for e in edges for x in e if e[0] != e[1]} <= set(got)


def test_projection_storage(spark, monkeypatch):
    """What is stored grows with the table, not with queries times cells; and many cells, queries in several blocks and
    equal vectors give the same rows as one block."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 32)).astype(np.float32)
    x[1000:1040] = x[990]
    rows = spark.createDataFrame([(i, v.tolist(), 0, "t") for i, v in enumerate(x)], VECTORS)
    monkeypatch.setattr(projections, "BLOCK", 64)
    for module in (vectors, projections):
        monkeypatch.setattr(module, "QUERY_BLOCK", 64, raising=False)
    stored = []
    load = Workspace.load

    def weighed(self, name, schema):
        table = load(self, name, schema)
        if "vec" in table.columns:
            stored.append(table.selectExpr("sum(octet_length(vec))").first()[0])
        return table

    monkeypatch.setattr(Workspace, "load", weighed)
    got = projections.nearest_by_cosine(rows, every=10).toPandas()
    assert 0 < max(stored) < 4 * x.nbytes
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = 0
    for q, g in got.groupby("query_id"):
        score = unit @ unit[q]
        score[q] = -2
        best = np.lexsort((np.arange(len(x)), -score.round(12)))[:5]
        hits += len({*best} & {*g.vec_id})
        assert list(g["rank"]) == [1, 2, 3, 4, 5] and np.allclose(g.score, score[g.vec_id], atol=1e-12)
    assert len(got) == 5 * 400 and hits >= 0.9 * len(got)
    assert got[got.query_id == 990].sort_values("rank").vec_id.tolist() == [1000, 1001, 1002, 1003, 1004]
