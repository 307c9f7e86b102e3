"""Mutable collections on immutable Parquet files.

Every write appends one batch of rows (id, op_seq, is_deleted, columns) and commits by creating the next numbered
manifest; a manifest that exists already means another writer was faster. Readers take the newest row of every id
(:mod:`korvex.operators.latest`); when the manifest says that no id repeats, they skip that. Columns have physical names
of their own, so renaming, dropping and adding columns, also with a constant, and widening types touch only the manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AlreadyExists, InvalidInput, NotFound, ReadOnly
from ..operators.latest import fetch, latest_live, log_stats, newest
from ..plans.context import QueryContext
from ..plans.engine import execute
from ..plans.filters import Compiler, parse
from ..schema import SCALARS, UNSIGNED_MAX, WIDENINGS, CollectionSchema, Field, Vector, metric_name
from .files import Files
from .keys import KeyTable

AUTO_COMPACT = 4


class Database:
    """A folder of collections."""

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.root, self.read_only, self.files = spark, root.rstrip("/"), read_only, Files(spark)
        if not read_only:
            self.files.mkdirs(f"{self.root}/collections")

    def _path(self, name: str) -> str:
        if not name or "/" in name:
            raise InvalidInput(f"{name!r} is no collection name")
        return f"{self.root}/collections/{name}"

    def list_collections(self) -> list[str]:
        names = self.files.list(f"{self.root}/collections")
        return [n for n in names if self.files.list(f"{self.root}/collections/{n}/manifests")]

    def create_collection(self, name: str, schema: CollectionSchema) -> Collection:
        if self.read_only:
            raise ReadOnly("the database is open for reading only")
        path = self._path(name)
        if self.files.list(f"{path}/manifests"):
            raise AlreadyExists(f"collection {name!r} exists")
        columns = {x.name: {"physical": f"c{i}", "since": 0} for i, x in enumerate([*schema.fields, *schema.vectors])}
        manifest = {
            "name": name, "schema": schema.to_dict(), "columns": columns, "next_column": len(columns), "batches": [], "next_seq": 1,
            "indexes": {}, "indexed_version": None, "data_version": 0, "key_mode": "numeric",
        }
        self.files.mkdirs(f"{path}/manifests")
        if not self.files.create(f"{path}/manifests/{0:012d}.json", json.dumps(manifest)):
            raise AlreadyExists(f"collection {name!r} exists")
        return Collection(self, path)

    def open_collection(self, name: str) -> Collection:
        path = self._path(name)
        if not self.files.list(f"{path}/manifests"):
            raise NotFound(f"no collection {name!r}")
        return Collection(self, path)

    def drop_collection(self, name: str) -> None:
        if self.read_only:
            raise ReadOnly("the database is open for reading only")
        path = self._path(name)
        if not self.files.list(f"{path}/manifests"):
            raise NotFound(f"no collection {name!r}")
        self.files.delete(path)


class Collection:
    def __init__(self, db: Database, path: str):
        self.db, self.spark, self.path, self.files = db, db.spark, path, db.files
        self.refresh()

    # --- manifest ------------------------------------------------------------------------------------------------

    def refresh(self) -> None:
        self.version = int(max(n for n in self.files.list(f"{self.path}/manifests") if n.endswith(".json"))[:-5])
        self.manifest = json.loads(self.files.read(f"{self.path}/manifests/{self.version:012d}.json"))
        self.schema = CollectionSchema.from_dict(self.manifest["schema"])

    def _writable(self) -> None:
        if self.db.read_only:
            raise ReadOnly("the database is open for reading only")

    def _commit(self, data: bool, **changes) -> None:
        self._writable()
        manifest = {**self.manifest, **changes}
        if data:
            manifest["data_version"] = self.manifest["data_version"] + 1
        if not self.files.create(f"{self.path}/manifests/{self.version + 1:012d}.json", json.dumps(manifest)):
            raise AlreadyExists("another writer has committed; refresh and try again")
        self.refresh()

    # --- reading -------------------------------------------------------------------------------------------------

    def log(self) -> DataFrame:
        """Every stored row under its present schema: id, op_seq, is_deleted and all columns."""
        out = [F.col("id"), F.col("op_seq"), F.col("is_deleted")]
        physical = [T.StructField("id", T.LongType()), T.StructField("op_seq", T.LongType()), T.StructField("is_deleted", T.BooleanType())]
        by_name = {f.name: f for f in [*self.schema.fields, *self.schema.vectors]}
        for name, c in self.manifest["columns"].items():
            kind = by_name[name].spark()
            stored = SCALARS[c["stored"]] if "stored" in c else kind
            physical.append(T.StructField(c["physical"], stored))
            value: Column = F.col(c["physical"])
            if "stored" in c:
                value = value.cast(kind)
            if "default" in c:
                value = F.when(F.col("op_seq") < c["since"], F.lit(c["default"]).cast(kind)).otherwise(value)
            out.append(value.alias(name))
        paths = [f"{self.path}/data/{b['name']}" for b in self.manifest["batches"]]
        if not paths:
            return self.spark.createDataFrame([], T.StructType(physical)).select(*out)
        return self.spark.read.schema(T.StructType(physical)).parquet(*paths).select(*out)

    @property
    def compacted(self) -> bool:
        """Whether no id can repeat and no tombstone is left."""
        b = self.manifest["batches"]
        return len(b) <= 1 and all(not x.get("tombstones") for x in b)

    def live(self) -> DataFrame:
        rows = self.log() if self.compacted else latest_live(self.log())
        return rows.drop("op_seq", "is_deleted")

    def query(self, ctx: QueryContext, exact: bool = False) -> DataFrame:
        """Exact, unless the only source is a dense vector whose index by cells is current, and neither a filter, groups nor
        an order by a field ask for rows far from it: then only the cells nearest to the vector are read (``nprobe`` of
        the query or of the index) and scored exactly. ``exact`` reads all rows."""
        rows, q = None, ctx.queries[0] if len(ctx.queries) == 1 else None
        near = ctx.group_by is None and (ctx.order_by is None or ctx.order_scope == "topk") and not (ctx.filter or "").strip()
        if q is not None and near and not exact and q.ids is None and isinstance(q.vector, (list, tuple)):
            from ..index.catalog import candidates

            name = q.field or self.schema.primary_vector
            if len(q.vector) == self.schema.vector(name).dimension:
                rows = candidates(self, name, q.vector, q.nprobe, metric_name(q.metric) if q.metric else self.schema.metric_of(name))
        return execute(self.live() if rows is None else rows, self.schema, ctx)

    def fetch(self, ids: list[int]) -> DataFrame:
        return fetch(self.live(), ids)

    def stats(self) -> DataFrame:
        done = F.lit(1.0 if self.manifest["indexed_version"] == self.manifest["data_version"] or not self.manifest["batches"] else 0.0)
        return log_stats(self.log()).withColumn("index_completeness", done)

    def segments(self) -> DataFrame:
        """Per batch: rows that are the newest of their id and live, and the others."""
        last = newest(self.log()).where(~F.col("is_deleted")).select("id", "op_seq", F.lit(1).alias("live"))
        rows = self.log().select("id", "op_seq").join(last, ["id", "op_seq"], "left")
        return rows.groupBy("op_seq").agg(F.count("live").alias("live_rows"), (F.count(F.lit(1)) - F.count("live")).alias("dead_rows"))

    # --- writing -------------------------------------------------------------------------------------------------

    def _append(self, rows: DataFrame, tombstones: bool, seq: int | None = None) -> None:
        """``rows``: id, is_deleted and the columns of the schema that the batch has."""
        self._writable()
        seq = self.manifest["next_seq"] if seq is None else seq
        name = f"{seq:012d}-{uuid.uuid4().hex[:8]}"
        out = [F.col("id").cast("long").alias("id"), F.lit(seq).cast("long").alias("op_seq"), F.col("is_deleted")]
        by_name = {f.name: f for f in [*self.schema.fields, *self.schema.vectors]}
        for column, c in self.manifest["columns"].items():
            kind = SCALARS[c["stored"]] if "stored" in c else by_name[column].spark()
            value = F.col(f"`{column}`").cast(kind) if column in rows.columns else F.lit(None).cast(kind)
            out.append(value.alias(c["physical"]))
        rows.select(*out).write.parquet(f"{self.path}/data/{name}")
        batches = [*self.manifest["batches"], {"name": name, "tombstones": tombstones}]
        self._commit(True, batches=batches, next_seq=seq + 1)

    def _validated(self, docs: DataFrame, patch: bool = False) -> DataFrame:
        """``docs`` cached and checked: ids, unsigned ranges, nulls, vector kinds and dimensions. One pass."""
        self._writable()
        names = set(self.manifest["columns"])
        unknown = [c for c in docs.columns if c != "id" and c not in names]
        if "id" not in docs.columns or unknown:
            raise InvalidInput(f"columns {unknown or ['id']} do not fit the schema")
        docs = docs.persist()
        faults = {"a null id": F.col("id").isNull()}
        for f in self.schema.fields:
            if f.name not in docs.columns:
                if not patch and not f.nullable:
                    raise InvalidInput(f"field {f.name!r} is missing")
                continue
            c = F.col(f"`{f.name}`")
            if not f.nullable and not patch:
                faults[f"a null {f.name}"] = c.isNull()
            if f.type in UNSIGNED_MAX and not f.array:
                faults[f"{f.name} out of range"] = ~c.cast("decimal(38,0)").between(0, UNSIGNED_MAX[f.type])
        for v in self.schema.vectors:
            c = F.col(f"`{v.name}`")
            if v.name not in docs.columns:
                if v.name == self.schema.primary_vector and not patch:
                    raise InvalidInput(f"the primary vector {v.name!r} is missing")
                continue
            if v.name == self.schema.primary_vector and not patch:
                faults[f"no {v.name}"] = c.isNull()
            faults[f"{v.name} of another dimension"] = (F.size(c["indices"]) != F.size(c["values"])) if v.sparse else (F.size(c) != v.dimension)
        checks = [F.coalesce(F.sum(F.coalesce(t, F.lit(False)).cast("long")), F.lit(0)).alias(f"f{i}") for i, t in enumerate(faults.values())]
        row = docs.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"), *checks).first()
        for i, what in enumerate(faults):
            if row[f"f{i}"]:
                docs.unpersist()
                raise InvalidInput(f"{row[f'f{i}']} rows with {what}")
        if row["rows"] != row["ids"]:
            docs.unpersist()
            raise InvalidInput("an id comes twice in the batch")
        docs._korvex_rows = row["rows"]
        return docs

    def insert(self, docs: DataFrame) -> int:
        docs = self._validated(docs)
        try:
            if not self.live().select("id").join(docs.select("id"), "id", "left_semi").isEmpty():
                raise InvalidInput("an id is live already")
            return self._write(docs)
        finally:
            docs.unpersist()

    def upsert(self, docs: DataFrame) -> int:
        docs = self._validated(docs)
        try:
            return self._write(docs)
        finally:
            docs.unpersist()

    def _write(self, docs: DataFrame) -> int:
        n = docs._korvex_rows
        if n:
            self._append(self._halved(docs).withColumn("is_deleted", F.lit(False)), False)
            self._maybe_compact()
        return n

    def _halved(self, docs: DataFrame) -> DataFrame:
        """fp16 vectors rounded through half precision."""
        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def half(v: pd.Series) -> pd.Series:
            return v.map(lambda x: None if x is None else np.asarray(x, np.float16).astype(np.float32))

        for v in self.schema.vectors:
            if v.type == "vector_fp16" and v.name in docs.columns:
                docs = docs.withColumn(v.name, half(F.col(f"`{v.name}`")))
        return docs

    def update(self, patch: DataFrame, unset: Iterable[str] = ()) -> int:
        """Set the patch's non-null columns on its ids, and remove the ``unset`` columns; ids that are not live are
        skipped. Returns how many documents were merged."""
        unset = list(unset)
        if self.schema.primary_vector in unset or any(u not in self.manifest["columns"] for u in unset):
            raise InvalidInput("a column to unset is the primary vector or unknown")
        patch = self._validated(patch, patch=True)
        try:
            p = patch.select(F.col("id").alias("__id"), *[F.col(f"`{c}`").alias(f"__p_{c}") for c in patch.columns if c != "id"])
            merged = self.live().join(p, F.col("id") == F.col("__id"))
            out = [F.col("id")]
            for c in self.manifest["columns"]:
                value = F.coalesce(f"`__p_{c}`", f"`{c}`") if c in patch.columns else F.col(f"`{c}`")
                out.append((F.lit(None) if c in unset else value).alias(c))
            merged = merged.select(*out).persist()
            n = merged.count()
            if n:
                self._append(merged.withColumn("is_deleted", F.lit(False)), False)
                self._maybe_compact()
            merged.unpersist()
            return n
        finally:
            patch.unpersist()

    def delete(self, ids: DataFrame | list[int]) -> int:
        """Returns how many live documents went; unknown ids do nothing."""
        self._writable()
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(int(i),) for i in ids], "id long")
        return self._bury(self.live().select("id").join(ids.select("id").distinct(), "id", "left_semi"))

    def delete_by_filter(self, text: str) -> int:
        self._writable()
        live = self.live()
        return self._bury(live.where(Compiler({f.name: f.dataType for f in live.schema.fields}).holds(parse(text))).select("id"))

    def _bury(self, ids: DataFrame) -> int:
        ids = ids.persist()
        n = ids.count()
        if n:
            self._append(ids.withColumn("is_deleted", F.lit(True)), True)
            self._maybe_compact()
        ids.unpersist()
        return n

    # --- maintenance ---------------------------------------------------------------------------------------------

    def flush(self) -> None:
        """Every commit is durable already."""

    def _maybe_compact(self) -> None:
        if len(self.manifest["batches"]) > AUTO_COMPACT:
            self.compact()

    def compact(self, max_records_per_file: int = 0) -> None:
        """Rewrite the live rows as one batch; old files stay for readers of older manifests until :meth:`vacuum`."""
        self._writable()
        if self.compacted:
            return
        seq = self.manifest["next_seq"]
        name = f"{seq:012d}-{uuid.uuid4().hex[:8]}"
        out = [F.col("id"), F.lit(seq).alias("op_seq"), F.lit(False).alias("is_deleted")]
        columns = {}
        for column, c in self.manifest["columns"].items():
            out.append(F.col(f"`{column}`").alias(c["physical"]))
            columns[column] = {"physical": c["physical"], "since": 0}
        writer = self.live().select(*out).write
        if max_records_per_file:
            writer = writer.option("maxRecordsPerFile", max_records_per_file)
        writer.parquet(f"{self.path}/data/{name}")
        self._commit(True, batches=[{"name": name, "tombstones": False}], next_seq=seq + 1, columns=columns)

    def vacuum(self) -> None:
        """Remove data that the present manifest does not use, and older manifests."""
        self._writable()
        used = {b["name"] for b in self.manifest["batches"]}
        for name in self.files.list(f"{self.path}/data"):
            if name not in used:
                self.files.delete(f"{self.path}/data/{name}")
        for name in self.files.list(f"{self.path}/manifests"):
            if name != f"{self.version:012d}.json":
                self.files.delete(f"{self.path}/manifests/{name}")

    # --- schema --------------------------------------------------------------------------------------------------

    def _reshape(self, change: Callable[[CollectionSchema, dict], None], **more) -> None:
        self._writable()
        schema, columns = CollectionSchema.from_dict(self.manifest["schema"]), json.loads(json.dumps(self.manifest["columns"]))
        change(schema, columns)
        schema = CollectionSchema.from_dict(schema.to_dict())  # checked again
        self._commit(False, schema=schema.to_dict(), columns=columns, **more)

    def _new_column(self) -> str:
        return f"c{self.manifest['next_column']}"

    def add_column(self, f: Field, expression: str | None = None) -> None:
        """A scalar column; with a constant (see :func:`parse_constant`) present rows get that value."""
        value = None if expression is None else parse_constant(expression, f)
        if value is None and not f.nullable and self.manifest["batches"]:
            raise InvalidInput("a column without a constant must be nullable")
        entry = {"physical": self._new_column(), "since": self.manifest["next_seq"]}
        if value is not None:
            entry["default"] = value

        def change(schema, columns):
            if f.name in columns:
                raise AlreadyExists(f"column {f.name!r} exists")
            schema.fields.append(f)
            columns[f.name] = entry

        self._reshape(change, next_column=self.manifest["next_column"] + 1)

    def drop_column(self, name: str) -> None:
        def change(schema, columns):
            if schema.field(name) is None:
                raise NotFound(f"no column {name!r}")
            schema.fields[:] = [f for f in schema.fields if f.name != name]
            del columns[name]

        self._reshape(change, indexes={k: v for k, v in self.manifest["indexes"].items() if k != name})

    def rename_column(self, old: str, new: str) -> None:
        def change(schema, columns):
            f = schema.field(old)
            if f is None:
                raise NotFound(f"no column {old!r}")
            if new in columns:
                raise AlreadyExists(f"column {new!r} exists")
            f.name = new
            columns[new] = columns.pop(old)

        self._reshape(change)

    def widen_column(self, name: str, to: str, new_name: str | None = None) -> None:
        """int32 to int64, uint32 to uint64, float to float64; refused while the column has a scalar index."""
        if name in self.manifest["indexes"]:
            raise InvalidInput(f"column {name!r} is indexed")

        def change(schema, columns):
            f = schema.field(name)
            if f is None:
                raise NotFound(f"no column {name!r}")
            if (f.type, to) not in WIDENINGS or f.array:
                raise InvalidInput(f"{f.type} does not widen to {to}")
            columns[name].setdefault("stored", f.type)
            f.type = to
            if new_name and new_name != name:
                if new_name in columns:
                    raise AlreadyExists(f"column {new_name!r} exists")
                f.name = new_name
                columns[new_name] = columns.pop(name)

        self._reshape(change)
        self.compact_types()

    def compact_types(self) -> None:
        """After widening, new rows must not go through the old type: the live rows are rewritten once."""
        if not any("stored" in c for c in self.manifest["columns"].values()):
            return
        if not self.manifest["batches"]:
            columns = {k: {x: y for x, y in c.items() if x != "stored"} for k, c in self.manifest["columns"].items()}
            self._commit(False, columns=columns)
            return
        batches = self.manifest["batches"]
        self.manifest["batches"] = [*batches[:-1], {**batches[-1], "tombstones": True}]
        self.compact()

    def add_vector(self, v: Vector) -> None:
        def change(schema, columns):
            if v.name in columns:
                raise AlreadyExists(f"{v.name!r} exists")
            schema.vectors.append(v)
            columns[v.name] = {"physical": self._new_column(), "since": self.manifest["next_seq"]}

        self._reshape(change, next_column=self.manifest["next_column"] + 1)

    def drop_vector(self, name: str) -> None:
        def change(schema, columns):
            if name == schema.primary_vector:
                raise InvalidInput("the primary vector stays")
            schema.vector(name)
            schema.vectors[:] = [v for v in schema.vectors if v.name != name]
            del columns[name]

        self._reshape(change, indexes={k: v for k, v in self.manifest["indexes"].items() if k != name})

    # --- indexes -------------------------------------------------------------------------------------------------

    def create_index(self, field_name: str, kind: str, **params) -> None:
        from ..index.catalog import check_index

        check_index(self.schema, field_name, kind, params)
        self._commit(False, indexes={**self.manifest["indexes"], field_name: {"kind": kind, "params": params}}, indexed_version=None)

    def drop_index(self, field_name: str) -> None:
        if field_name not in self.manifest["indexes"]:
            raise NotFound(f"no index on {field_name!r}")
        self._commit(False, indexes={k: v for k, v in self.manifest["indexes"].items() if k != field_name})

    def list_indexes(self) -> dict:
        return dict(self.manifest["indexes"])

    def optimize(self) -> None:
        """Compact, and build every index of the catalog for the present data."""
        from ..index.catalog import build_index

        self._writable()
        self.compact()
        for field_name, entry in self.manifest["indexes"].items():
            build_index(self, field_name, entry["kind"], entry["params"])
        self._commit(False, indexed_version=self.manifest["data_version"], indexed_columns=self.manifest["columns"])

    # --- string keys ---------------------------------------------------------------------------------------------

    @property
    def keys(self) -> KeyTable:
        return KeyTable(self)


def parse_constant(text: str, f: Field):
    """``null``, ``true``, ``false``, a JSON string, or a plain decimal number, of exactly the column's type."""
    s = text.strip()
    if f.array:
        raise InvalidInput("an array column takes no constant")
    if s == "null":
        return None
    if s in ("true", "false"):
        kind, value = "bool", s == "true"
    elif s.startswith('"'):
        try:
            kind, value = "string", json.loads(s)
        except ValueError:
            raise InvalidInput(f"{text!r} is no constant") from None
    elif s.lstrip("-").isdigit() and s.count("-") <= 1:
        kind, value = "int", int(s)
    elif reduce(lambda n, c: n and (c.isdigit() or c in "-."), s, bool(s)) and s.count(".") == 1:
        kind, value = "float", float(s)
    else:
        raise InvalidInput(f"{text!r} is no constant")
    ranges = {"int32": (-(2**31), 2**31 - 1), "int64": (-(2**63), 2**63 - 1), "uint32": (0, 2**32 - 1), "uint64": (0, 2**64 - 1)}
    fits = (kind == f.type) or (kind == "int" and f.type in ranges and ranges[f.type][0] <= value <= ranges[f.type][1]) or (kind == "float" and f.type in ("float", "float64"))
    if not fits:
        raise InvalidInput(f"{text!r} does not fit {f.type}")
    return value
