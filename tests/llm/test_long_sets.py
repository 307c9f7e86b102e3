"""Sets of more than 65,535 tokens in the set joins."""

from korvex.llm import grams, lines


def run(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def test_long_lines(make_docs):
    shared = run("s", 180_000)
    docs = make_docs([(i, run(f"own{i}x", 20_000) + " " + shared, "s") for i in range(3)])
    got = {r["doc_id"]: len(r["text"]) for r in lines.drop_repeated_lines(docs).collect()}
    assert got[0] > 0 and got[1] == got[2] == 0


def test_long_documents(make_docs):
    shared = run("s", 60_004)
    docs = make_docs([(1, shared, "s"), (2, shared + " " + run("o", 20_000), "s"), (3, shared + " end", "s")])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in grams.near_duplicate_classes(docs).collect()}
    assert got == {1: (60_000, 1), 2: (80_000, 1), 3: (60_001, 1)}
