"""Removing lines that an earlier line of the corpus resembles: an exact set-similarity join over lines.

A line is what stands between line feeds; its tokens are its distinct 5-word shingles (words are folded A-Z). A line of
one to four words has its whole sequence as its one token, so only equal lines are like it; lines without words always
stay. Lines are ordered by (doc_id, place in the document). A line goes if any earlier line has Jaccard 0.75 or more
with it.

1. Lines of equal sets collapse to the earliest; all others of them go.
2. Tokens are ordered by rarity over all lines. Every distinct line posts its prefix with its size and the position of
   the token (prefix filter); entries of one list are compared by size (length filter) and by how much overlap the two
   positions leave possible (positional filter).
3. Every line is first verified against the earliest line it meets, which settles copies in one comparison each. What
   is left is compared with every earlier line of its lists that passes the filters. Both steps verify whole sets.

Defined cases: null and empty texts have no lines; rows that repeat a doc_id count as one document and are cut alike; a
null doc_id comes last in the order and its rows are cut alike too; an empty table gives no rows; extra columns are kept
by :func:`drop_repeated_lines`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import setjoin as J
from . import textkit as K
from .common import Workspace, text_or_empty, thrifty

NUM, DEN = 3, 4
_LAST = np.iinfo(np.int64).max


def line_units(ids: np.ndarray, text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Units of lines with words; keys are rows (doc, line)."""
    raw, offsets = K.buffers(text)
    for i, j in K.slices(offsets):
        part = raw[offsets[i] : offsets[j]]
        cuts = offsets[i : j + 1] - offsets[i]
        feeds = np.flatnonzero(part == 0x0A)
        bounds = np.sort(np.concatenate([cuts[:-1], feeds + 1]))  # line starts; empty documents add empty lines
        owner = np.repeat(np.arange(j - i), 1 + np.diff(np.searchsorted(feeds, cuts)))
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        hashes, words = K.unit_hashes(part, bounds)
        worded = words > 0
        tokens, counts = K.shingle_sets(hashes, words[worded])
        yield np.column_stack([ids[i:j][owner[worded]], place[worded]]), tokens, counts


def filtered(size_x, at_x, size_y, at_y, num: int, den: int):
    """Length and positional filter of two postings of one token."""
    need = -(-(size_x + size_y) * num // (num + den))
    possible = 1 + np.minimum(size_x - at_x - 1, size_y - at_y - 1)
    return (np.minimum(size_x, size_y) * den >= np.maximum(size_x, size_y) * num) & (possible >= need)


def earliest(num: int, den: int):
    """Posting lists as rows, each entry with the earliest line of its list if the two pass the filters."""

    def meet(tokens, prints, sizes, positions, docs, lines) -> pd.DataFrame:
        order = np.lexsort((lines, docs, tokens))
        tokens, prints, sizes, positions, docs, lines = (x[order] for x in (tokens, prints, sizes, positions, docs, lines))
        first = np.concatenate([[True], tokens[1:] != tokens[:-1]])[: len(tokens)]
        lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(tokens) else np.zeros(0, np.int64)
        ok = filtered(sizes, positions, sizes[lead], positions[lead], num, den) & ~first
        return pd.DataFrame({
            "token": tokens, "print": J.signed(prints), "doc": docs, "line": lines.astype(np.int32), "size": sizes.astype(np.int32),
            "at": positions.astype(np.int32), "leader": J.signed(prints[lead]), "near": ok,
        })

    return meet


def repeated_lines(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc, line) of every line that goes; doc is the largest long for a null doc_id."""
    spark = docs.sparkSession
    ws = Workspace(spark, "lines")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_LAST))).alias("id"), text_or_empty().alias("text"))
    sets = J.Sets(ws, rows, line_units)

    def profile(slices):
        for keys, _, counts, prints in slices:
            columns = [pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(keys[:, 1].astype(np.int32)), pa.array(counts.astype(np.int32)), pa.array(J.signed(prints))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "line", "n", "print"])

    profiles = ws.save(sets.scan(profile, "doc long, line int, n int, print long"), "profiles")
    sets.tokens = profiles.agg(F.sum("n")).first()[0] or 0
    place = F.struct("doc", "line")
    repeated = profiles.groupBy("print").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    copies = profiles.join(ws.save(repeated.select("print", "first"), "repeated"), "print").where(place != F.col("first")).select("doc", "line")

    table = J.rarity_table(sets)
    ws.tidy()
    carry = [lambda keys: keys[:, 0], lambda keys: keys[:, 1]]
    schema = "token long, print long, doc long, line int, size int, at int, leader long, near boolean"
    met = ws.save(J.postings(sets, table, num, den, earliest(num, den), schema, carry), "met")
    del table
    sets.release()
    lists = ws.save(J.able_sets(met, num, den), "lists")

    ws.drop("met")
    # equal lines are in the lists as the earliest of them
    keyed = ws.save(lists.select("print", "doc", F.col("line").cast("long").alias("line")).distinct(), "keyed")
    chosen = J.gather(sets, keyed, "sets")
    ws.tidy()

    # a line against the earliest line that it meets most
    tried = lists.where("near").groupBy("print", "leader").agg(F.count(F.lit(1)).alias("c"), F.max("size").alias("n"))
    tried = tried.groupBy("print").agg(F.max_by("leader", F.struct("c", "leader")).alias("b")).withColumnRenamed("print", "a")
    settled = ws.save(J.verify(tried, chosen, num, den).select(F.col("a").alias("print")).distinct(), "settled")
    ws.tidy()

    # what is left against every earlier line of its lists
    left = lists.join(settled, "print", "left_anti").select(*[F.col(c).alias(f"x_{c}") for c in ("token", "print", "doc", "line", "size", "at")])
    need = F.ceil((F.col("x_size") + F.col("size")) * num / (num + den))
    possible = 1 + F.least(F.col("x_size") - F.col("x_at") - 1, F.col("size") - F.col("at") - 1)
    pairs = (
        left.join(lists, F.col("x_token") == F.col("token"))
        .where("doc < x_doc or (doc = x_doc and line < x_line)")
        .where((F.least("x_size", "size") * den >= F.greatest("x_size", "size") * num) & (possible >= need))
        .groupBy(F.col("x_print").alias("a"), F.col("print").alias("b"))
        .agg(F.max("x_size").alias("n"))
    )
    pairs = ws.save(pairs.select("a", "b"), "pairs")
    later = J.verify(pairs, chosen, num, den).select(F.col("a").alias("print")).distinct().unionByName(settled)
    similar = keyed.join(later, "print", "left_semi").select("doc", F.col("line").cast("int").alias("line"))
    gone = ws.save(copies.unionByName(similar), "gone")
    ws.drop("sets", "lists", "pairs", "profiles", "repeated", "keyed")
    ws.tidy()
    return gone


def without_lines(docs: DataFrame, gone: DataFrame, names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with the lines of ``gone`` cut out of text, and two columns of these names: lines before, lines cut
    (columns of the input that have these names give way). Documents join one row each that lists the places to cut, so
    rows of different documents never meet."""
    docs = docs.drop(*names)
    cuts = gone.groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("line").alias("__cut"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_LAST)))
    marked = docs.join(cuts.hint("shuffle_hash"), key == F.col("__doc"), "left").drop("__doc")  # texts need no sort
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            text, cut = b.column(at), b.column(b.schema.get_field_index("__cut"))
            out, lines, removed = [], [], []
            for value, places in zip(text.to_pylist(), cut.to_pylist(), strict=True):
                pieces = value.split("\n") if value else []
                drop = set(places or ())
                lines.append(len(pieces))
                removed.append(len(drop))
                out.append("\n".join(x for i, x in enumerate(pieces) if i not in drop) if drop else value)
            columns = [pa.array(out, text.type) if n == "text" else c for n, c in zip(b.schema.names, b.columns, strict=True) if n != "__cut"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], schema.names)

    return marked.mapInArrow(thrifty(work), schema)


def drop_repeated_lines(docs: DataFrame, num: int = NUM, den: int = DEN, names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with repeated lines cut out of text, and n_lines, n_removed (or as ``names`` has it)."""
    return without_lines(docs, repeated_lines(docs, num, den), names)
