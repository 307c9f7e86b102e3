"""Line dedup over all lines with words, against brute force without exemptions."""

import re
from collections import Counter, defaultdict

from korvex.llm import lines
from test_llm_queries import shingles


def whole_lines(rows):
    """Brute-force texts after line dedup of (doc_id, text) rows in order; lines of one to four words take part."""
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


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_short_lines_go(make_docs):
    rows = [
        (1, "Home\nAbout us\nread more here\n\n \t\none two three four"), (2, "home\nabout  us\nRead more here\n\nnew\none two three four five"),
        (3, "Read more\none two three four\nfour three two one\nHome\nHome\nlast"), (4, "one two three four five\nnew"),
    ]
    got = texts(lines.drop_repeated_lines(make_docs([(i, t, "s") for i, t in rows])))
    assert got == whole_lines(rows)
    assert got[2] == "\nnew\none two three four five" and got[3] == "Read more\nfour three two one\nlast" and got[4] == ""


def test_short_lines_of_documents(spark, sf, duck):
    rows = duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    short = [x for _, t in rows for x in (t or "").split("\n") if 0 < len(re.findall(r"[^\x20\x09-\x0D]+", x)) < 5]
    assert len(short) > len({shingles(x) for x in short})
    assert {d: t or "" for d, t in texts(lines.drop_repeated_lines(docs)).items()} == whole_lines(rows)


def test_earliest_line_in_any_order_of_rows(make_docs):
    a, b = (" ".join(f"w{i}" for i in range(40)) + x for x in (" end", " and more"))
    rows = [(50, a, "s"), (1, a, "s"), (20, b, "s"), (60, b, "s"), (0, "other words that stand alone here", "s")]
    for order in (rows, rows[::-1], sorted(rows), sorted(rows, reverse=True)):
        got = texts(lines.drop_repeated_lines(make_docs(order).coalesce(1)))
        assert got == {0: rows[4][1], 1: a, 20: "", 50: "", 60: ""} == whole_lines(sorted((d, t) for d, t, _ in rows))
