"""N-gram Jaccard join by a token-group matrix: documents whose 5-word shingle sets have Jaccard 0.75 or more are linked.

1. Equal sets collapse to one fingerprint. All further work is on distinct sets.
2. Tokens get a rarity order over all documents, and every set posts its prefix: pairs over the threshold share posted
   tokens, the more the larger they are.
3. Similar documents are partitioned into groups, in ``ROUNDS`` rounds: every list of several classes names a leader from
   its largest class (another one each round), and a set moves to the class of the leader it meets in most lists, if the
   pair is verified. Sets of one class are surely connected; a class is cut into groups of at most about ``GROUP``.
4. The matrix has a cell for every (token, group) of the lists that still hold several classes. A set is a query to the
   groups of other, larger classes that it meets in the fewest of its lists that must hold any set like it, so lists that
   a large group of copies shares are hardly ever walked. Each group's union of tokens bounds the
   overlap of a query with any member; only groups that reach 3/4 of the query's size are opened, and their members
   verified exactly.
5. Classes are the connected components of the links found. No link between different sets is lost: a pair in different
   classes after step 3 shares a posted token, so step 4 compares it.

Defined cases: null and empty texts have an empty set and are linked with nothing; texts of fewer than five words are
one shingle; repeated rows are linked if they have words; component_id is the smallest doc_id that is not null; an empty
table gives no rows; extra columns are ignored by the query and kept by :func:`drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setjoin as J
from . import textkit as K
from .common import Workspace, connected_components, text_or_empty, thrifty_group

NUM, DEN = 3, 4
GROUP = 128
QUERIES = 128
#: Times that sets are tried against the leaders of their lists before the matrix takes over.
ROUNDS = 3


def document_units(ids: np.ndarray, text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    keys = ids.astype(np.int64).view(np.uint64)
    for i, j, tokens, counts in K.doc_shingles(text):
        yield keys[i:j], tokens, counts


def as_rows(tokens, prints, sizes, positions, ends) -> pd.DataFrame:
    return pd.DataFrame({"token": tokens, "print": J.signed(prints), "size": sizes.astype(np.int32), "end": ends})


def open_groups(queries: pd.DataFrame, members: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """One link of each query to a group that holds a set like it. ``members``: the group's sets."""
    if not len(queries) or not len(members):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    members = members.drop_duplicates("print")
    sizes = members["tokens"].map(len).to_numpy() // 8
    tokens = np.frombuffer(b"".join(members["tokens"]), np.uint64)
    union, at = np.unique(tokens, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    names, links = members["print"].to_numpy(), []
    held = np.zeros(len(union), bool)
    for name, raw in zip(queries["print"], queries["tokens"], strict=True):
        own = np.frombuffer(raw, np.uint64)
        place = np.minimum(np.searchsorted(union, own), len(union) - 1)
        place = place[union[place] == own]
        if len(place) * den < num * len(own):
            continue  # no member can reach the overlap
        held[place] = True
        common = np.add.reduceat(held[at].astype(np.int64), starts)
        held[place] = False
        hit = np.flatnonzero(J.linked(common, sizes, len(own), num, den))
        if len(hit):
            links.append((name, names[hit[0]]))
    return pd.DataFrame(links, columns=["a", "b"]).astype(np.int64)


def _placed(ws: Workspace, lists: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """(token, print, n, end) of the lists with each set's component (itself, if it has none yet) and that one's size."""
    sizes = classes.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    known = ws.save(classes.join(sizes, "component"), f"{name}-known")
    out = lists.select("token", "print", F.col("size").alias("n"), "end").join(known, "print", "left")
    return ws.save(out.withColumns({"component": F.coalesce("component", "print"), "size": F.coalesce("size", F.lit(1))}), name)


def matrix_cells(left: DataFrame) -> DataFrame:
    """The matrix: (token, group, chunk) with the group's size, and bounds of its members there: their sizes, their
    ``top`` and where their prefixes end."""
    return left.groupBy("token", F.col("component").alias("group"), F.col("size").alias("g_size"), "chunk").agg(
        F.min("n").alias("g_min"), F.max("n").alias("g_max"), F.max("top").alias("g_top"), F.min("end").alias("g_first"), F.max("end").alias("g_last")
    )


def fewest_lists(left: DataFrame, num: int, den: int) -> DataFrame:
    """Of each set that can be like one in its lists: (print, n, component, size, end, top, lists), lists being those in
    which it must meet any set like it once at least.

    A set whose prefix ends later in the common order holds every token that both share of the other's prefix in its own.
    So to it, the other's prefix tokens in no list bound their overlap; ``top`` is the size of the largest set of a later
    end that a set can be like.

    A set in c lists meets any set like it in m of them or more (:func:`korvex.llm.setjoin.meetings_needed`, by the sizes
    that its lists hold), so in one at least of any c - m + 1: those with the fewest cells are taken, and a list that a
    large group of copies shares is hardly ever among them. Sets of fewer than m lists are like none.
    """
    about = matrix_cells(left).groupBy("token").agg(F.count(F.lit(1)).alias("cells"), F.min("g_min").alias("lo"), F.max("g_max").alias("hi"))
    own = (
        left.join(about, "token")
        .groupBy("print", "n", "component", "size", "end")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_list(F.struct("cells", "token"))).alias("lists"))
        .withColumn("overlap", F.col("n") - (F.col("n") - F.ceil(F.col("n") * num / den) + 1 + F.floor(F.col("n") / J.STEP)) + F.size("lists") + F.floor(F.col("n") / J.FALLEN))
        .withColumn("top", (F.floor(F.col("overlap") * (num + den) / num + 1e-9) - F.col("n")).cast("int"))
        .withColumn("spare", F.size("lists") - J.meetings_needed(F.col("n"), F.col("lo"), F.col("hi"), num, den) + 1)
        .where("spare > 0")
    )
    taken = F.transform(F.slice("lists", F.lit(1), F.greatest(F.col("spare"), F.lit(0)).cast("int")), lambda x: x["token"])
    return own.select("print", "n", "component", "size", "end", "top", taken.alias("lists"))


def near_duplicate_classes(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark = docs.sparkSession
    ws = Workspace(spark, "grams")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"))
    sets = J.Sets(ws, rows, document_units)

    def profile(slices):
        for keys, _, counts, prints in slices:
            yield pa.RecordBatch.from_arrays([pa.array(J.signed(keys)), pa.array(counts), pa.array(J.signed(prints))], ["key", "n", "print"])

    # 1. distinct sets
    profiles = ws.save(sets.scan(profile, "key long, n long, print long"), "profiles")
    nobody = F.col("key") == np.iinfo(np.int64).min
    reps = ws.save(
        profiles.where("n > 0").groupBy("print").agg(F.min("key").alias("key"), F.min(F.when(~nobody, F.col("key"))).alias("doc")), "reps"
    )
    sets.tokens = profiles.agg(F.sum("n")).first()[0] or 0

    # 2. posting lists of two or more sets
    table = J.rarity_table(sets)
    ws.tidy()
    met = ws.save(J.postings(sets, table, num, den, as_rows, "token long, print long, size int, end long", ends=True), "met")
    del table
    sets.release()
    lists = ws.save(J.able_sets(met, num, den), "lists")

    # 3. groups of similar documents
    candidates = lists.select("print").distinct()
    chosen = J.gather(sets, reps.join(candidates, "print", "left_semi").select("print", "key"), "sets")
    ws.tidy()
    classes = ws.save(spark.createDataFrame([], "print long, component long"), "classes-none")
    links = None
    for round_ in range(ROUNDS):
        placed = _placed(ws, lists, classes, f"placed-{round_}")
        lead = placed.groupBy("token").agg(
            F.max_by(F.struct("print", "component", "n"), F.struct("size", F.xxhash64("print", F.lit(round_)), "print")).alias("lead"),
            F.min("component").alias("lo"),
            F.max("component").alias("hi"),
        )
        lead = ws.save(lead.where("lo <> hi").select("token", "lead"), f"lead-{round_}")
        tried = (
            placed.join(lead, "token")
            .where("component <> lead.component")
            .groupBy("print", F.col("lead.print").alias("leader"), F.col("lead.component").alias("joins"))
            .agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"), F.max("lead.n").alias("m"))
            .where(F.col("c") >= J.meetings_needed(F.col("n"), F.col("m"), F.col("m"), num, den))
            .groupBy(F.col("print").alias("a"))
            .agg(F.max_by(F.struct(F.col("leader").alias("b"), "joins"), F.struct("c", "leader")).alias("to"))
        )
        tried = ws.save(tried.select("a", "to.b", "to.joins"), f"tried-{round_}")
        new = ws.save(J.verify(tried.select("a", "b"), chosen, num, den), f"links-{round_}")
        links = new if links is None else links.unionByName(new)
        moved = new.join(tried, ["a", "b"]).select(F.col("a").alias("print"), F.col("joins").alias("component"))
        stayed = classes.join(moved.select("print"), "print", "left_anti")
        joined = ws.save(moved.unionByName(stayed), f"joined-{round_}")
        # a leader that stays where it is counts as a member of its class
        heads_ = joined.select(F.col("component").alias("print")).distinct().join(joined.select("print"), "print", "left_anti")
        classes = ws.save(joined.unionByName(heads_.select("print", F.col("print").alias("component"))), f"classes-{round_}")
        ws.tidy()

    # 4. the token-group matrix of what is left, and the groups it opens
    placed = _placed(ws, lists, classes, "placed")
    mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    sizes = classes.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    left = ws.save(
        placed.join(mixed, "token", "left_semi").withColumn("chunk", F.pmod(F.xxhash64("print"), F.ceil(F.col("size") / GROUP)).cast("int")).withColumn("top", F.lit(2**31 - 1)),
        "left",
    )
    # a set that can be like none leaves the lists
    probes = ws.save(fewest_lists(left, num, den), "probes")
    left = ws.save(left.drop("top").join(probes.select("print", "top"), "print"), "left-able")
    cells = matrix_cells(left)
    probes = probes.withColumn("token", F.explode("lists")).drop("lists")
    asks = (
        probes.join(cells, "token")
        .where("component <> `group` and (size < g_size or (size = g_size and component < `group`))")
        .where("not (g_first > end and g_min > top) and not (g_last < end and n > g_top)")
        .where(J.meetings_needed(F.col("n"), F.col("g_min"), F.col("g_max"), num, den).isNotNull())
        .select("print", "group", "chunk")
        .distinct()
    )
    asks = ws.save(asks, "asks")
    waiting = asks.groupBy("group", "chunk").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("salts"))
    waiting = ws.save(waiting, "waiting")
    asked = (
        asks.join(waiting, ["group", "chunk"])
        .withColumn("salt", F.pmod(F.xxhash64("print"), F.col("salts")).cast("int"))
        .join(chosen, "print")
        .select("group", "chunk", "salt", "print", "tokens")
    )
    whole = reps.select("print").join(classes, "print", "left").withColumn("group", F.coalesce("component", "print"))
    whole = whole.join(sizes.withColumnRenamed("component", "group"), "group", "left").withColumn(
        "chunk", F.pmod(F.xxhash64("print"), F.ceil(F.coalesce("size", F.lit(1)) / GROUP)).cast("int")
    )
    opened = (
        whole.join(waiting, ["group", "chunk"])
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .join(chosen.select(F.col("print"), F.col("tokens")), "print")
        .select("group", "chunk", "salt", F.col("print").alias("print"), F.col("tokens").alias("tokens"))
    )
    keys = ["group", "chunk", "salt"]
    more = asked.groupBy(*keys).cogroup(opened.groupBy(*keys)).applyInPandas(thrifty_group(lambda q, m: open_groups(q, m, num, den)), "a long, b long")
    found = ws.save(links.unionByName(more), "found")
    ws.tidy()

    # 5. classes, named by their smallest document
    final = ws.save(connected_components(ws, found, "last"), "last-classes").withColumnRenamed("node", "print")
    named = ws.save(reps.join(final, "print", "left").withColumn("component", F.coalesce("component", "print")), "named")
    heads = named.groupBy("component").agg(F.min("doc").alias("head"))
    heads = ws.save(named.join(heads, "component").select(F.col("print").alias("p"), "head"), "heads")
    ws.drop("sets", "met", "lists", "left")
    doc = F.when(~nobody, F.col("key"))
    return profiles.join(heads, F.col("print") == F.col("p"), "left").select(
        doc.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("head")).otherwise(doc).alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """``docs`` with one document of each class: that of smallest doc_id (all rows of a doc_id stay or go together)."""
    classes = near_duplicate_classes(docs, num, den)
    gone = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
