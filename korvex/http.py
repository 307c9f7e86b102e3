"""A WSGI application over a :class:`Database`: the REST routes of the engine, one collection operation each.

Ids are decimal strings in answers and requests. Unknown keys of a request are errors. Run it with any WSGI server, for
example ``wsgiref.simple_server.make_server("", 8080, app(db)).serve_forever()``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from .errors import AlreadyExists, InvalidInput, NotFound, ReadOnly, Unsupported
from .plans.context import RRF, GroupBy, OrderBy, QueryContext, VectorQuery, Weighted
from .schema import CollectionSchema, Field, Vector
from .store.collection import Collection, Database

_STATUS = {InvalidInput: "400 Bad Request", Unsupported: "400 Bad Request", NotFound: "404 Not Found", AlreadyExists: "409 Conflict", ReadOnly: "403 Forbidden"}
MAX_ROWS = 10_000


def _take(body: dict, *names: str) -> dict:
    unknown = set(body) - set(names)
    if unknown:
        raise InvalidInput(f"unknown keys {sorted(unknown)}")
    return body


def _ids(values) -> list[int]:
    if not isinstance(values, list) or not all(isinstance(v, str) and re.fullmatch(r"-?[0-9]+", v) for v in values):
        raise InvalidInput("ids are a list of decimal strings")
    return [int(v) for v in values]


def _sparse(v):
    return {int(i): float(x) for i, x in zip(v["indices"], v["values"], strict=True)} if isinstance(v, dict) else v


def context(body: dict) -> QueryContext:
    """The request of a search body."""
    b = _take(body, "queries", "filter", "top_k", "output_fields", "include_vector", "group_by", "order_by", "reranker")
    queries = []
    for q in b.get("queries", []):
        q = _take(q, "field", "vector", "ids", "metric", "ef_search", "nprobe")
        queries.append(VectorQuery(q.get("field"), _sparse(q.get("vector")), _ids(q["ids"]) if "ids" in q else None, q.get("metric"), q.get("ef_search"), q.get("nprobe")))
    rerank = b.get("reranker")
    if rerank is not None:
        rerank = _take(rerank, "type", "rank_constant", "weights", "metric")
        kind = rerank.get("type")
        if kind not in ("rrf", "weighted"):
            raise InvalidInput(f"unknown reranker {kind!r}")
        rerank = RRF(rerank.get("rank_constant", 60)) if kind == "rrf" else Weighted(rerank.get("weights", {}), rerank.get("metric"))
    group, order = b.get("group_by"), b.get("order_by")
    return QueryContext(
        queries, b.get("filter"), b.get("top_k", 10), b.get("output_fields", []), b.get("include_vector", False),
        GroupBy(**_take(group, "field", "group_topk", "group_count")) if group else None,
        OrderBy(**_take(order, "field", "descending")) if order else None,
        rerank or (RRF() if len(queries) > 1 else None),
    )


class Api:
    def __init__(self, db: Database):
        self.db = db

    def documents(self, c: Collection, body: dict):
        rows = _take(body, "documents")["documents"]
        fields = [f.name for f in c.schema.spark().fields]
        out = []
        for r in rows:
            r = _take(r, "id", "fields", "vectors")
            values = {**r.get("fields", {}), **r.get("vectors", {})}
            unknown = set(values) - set(fields)
            if unknown:
                raise InvalidInput(f"unknown fields {sorted(unknown)}")
            floats = {f.name for f in c.schema.fields if f.type in ("float", "float64") and not f.array}
            values = {k: float(v) if k in floats and isinstance(v, int) and not isinstance(v, bool) else v for k, v in values.items()}
            vectors = {v.name for v in c.schema.vectors if not v.sparse}
            values = {k: [float(x) for x in v] if k in vectors and v is not None else v for k, v in values.items()}
            out.append(tuple([_ids([r["id"]])[0], *[values.get(n) for n in fields[1:]]]))
        return self.db.spark.createDataFrame(out, c.schema.spark())

    @staticmethod
    def rows(df) -> list[dict]:
        out = []
        for r in df.limit(MAX_ROWS).collect():
            d = r.asDict(recursive=True)
            out.append({k: str(v) if k == "id" else v for k, v in d.items()})
        return out

    # --- routes ------------------------------------------------------------------------------------------------------

    def create(self, body):
        b = _take(body, "name", "fields", "vectors", "primary_vector", "metric")
        schema = CollectionSchema(b["primary_vector"], [Vector(**v) for v in b["vectors"]], [Field(**f) for f in b.get("fields", [])], b.get("metric", "l2"))
        self.db.create_collection(b["name"], schema)
        return {"name": b["name"]}

    def update(self, c, body):
        b = _take(body, "ids", "fields", "unset", "vectors")
        values = {**b.get("fields", {}), **b.get("vectors", {})}
        unset = [*b.get("unset", []), *[k for k, v in values.items() if v is None]]
        values = {k: v for k, v in values.items() if v is not None}
        kinds = {f.name: f for f in c.schema.spark().fields}
        if set(values) - set(kinds):
            raise InvalidInput("unknown fields")
        from pyspark.sql import types as T

        schema = T.StructType([kinds["id"], *[kinds[k] for k in values]])
        return {"updated": c.update(self.db.spark.createDataFrame([(i, *values.values()) for i in _ids(b["ids"])], schema), unset)}

    def routes(self) -> list[tuple[str, str, Callable]]:
        db, c = self.db, self.db.open_collection
        done = lambda _: {"ok": True}
        return [
            ("GET", "/health", lambda b: {"status": "ok"}),
            ("GET", "/collections", lambda b: {"collections": db.list_collections()}),
            ("POST", "/collections", self.create),
            ("GET", "/collections/{c}", lambda b, n: {"name": n, "schema": c(n).schema.to_dict(), **self.rows(c(n).stats())[0]}),
            ("DELETE", "/collections/{c}", lambda b, n: done(db.drop_collection(n))),
            ("GET", "/collections/{c}/stats", lambda b, n: self.rows(c(n).stats())[0]),
            ("POST", "/collections/{c}/admin/flush", lambda b, n: done(c(n).flush())),
            ("POST", "/collections/{c}/admin/compact", lambda b, n: done(c(n).compact())),
            ("POST", "/collections/{c}/admin/optimize", lambda b, n: done(c(n).optimize())),
            ("GET", "/collections/{c}/admin/segments", lambda b, n: {"segments": self.rows(c(n).segments())}),
            ("POST", "/collections/{c}/records", lambda b, n: {"inserted": (x := c(n)).insert(self.documents(x, b))}),
            ("DELETE", "/collections/{c}/records", lambda b, n: {"deleted": c(n).delete(_ids(_take(b, "ids")["ids"]))}),
            ("POST", "/collections/{c}/records/delete_by_filter", lambda b, n: {"deleted": c(n).delete_by_filter(_take(b, "filter")["filter"])}),
            ("POST", "/collections/{c}/records/upsert", lambda b, n: {"upserted": (x := c(n)).upsert(self.documents(x, b))}),
            ("POST", "/collections/{c}/records/update", lambda b, n: self.update(c(n), b)),
            ("POST", "/collections/{c}/records/fetch", lambda b, n: {"documents": self.rows(c(n).fetch(_ids(_take(b, "ids")["ids"])).drop("pos"))}),
            ("POST", "/collections/{c}/search", lambda b, n: {"hits": self.rows(c(n).query(context(b)))}),
            ("POST", "/collections/{c}/schema/columns", lambda b, n: done(c(n).add_column(Field(**_take(b, "name", "type", "nullable", "array"))))),
            ("DELETE", "/collections/{c}/schema/columns/{f}", lambda b, n, f: done(c(n).drop_column(f))),
            ("PATCH", "/collections/{c}/schema/columns/{f}", lambda b, n, f: done(c(n).rename_column(f, _take(b, "new_name")["new_name"]))),
            ("POST", "/collections/{c}/schema/vectors", lambda b, n: done(c(n).add_vector(Vector(**_take(b, "name", "dimension", "type", "metric"))))),
            ("DELETE", "/collections/{c}/schema/vectors/{f}", lambda b, n, f: done(c(n).drop_vector(f))),
            *[
                route
                for kind in ("vector", "scalar")
                for route in (
                    ("GET", f"/collections/{{c}}/indexes/{kind}", lambda b, n, k=kind: {"indexes": {f: i for f, i in c(n).list_indexes().items() if (i["kind"] == "inverted") == (k == "scalar")}}),
                    ("POST", f"/collections/{{c}}/indexes/{kind}", lambda b, n: done(c(n).create_index(b["field"], b["kind"], **b.get("params", {})))),
                    ("DELETE", f"/collections/{{c}}/indexes/{kind}/{{f}}", lambda b, n, f: done(c(n).drop_index(f))),
                )
            ],
        ]


def app(db: Database) -> Callable:
    table = [(m, re.compile("^" + re.sub(r"\{\w+\}", r"([^/]+)", p) + "$"), fn) for m, p, fn in Api(db).routes()]

    def wsgi(environ, start_response):
        method, path = environ["REQUEST_METHOD"], environ.get("PATH_INFO", "/")
        try:
            size = int(environ.get("CONTENT_LENGTH") or 0)
            body = json.loads(environ["wsgi.input"].read(size)) if size else {}
            found = [(m, p.match(path), fn) for m, p, fn in table if p.match(path)]
            if not found:
                raise NotFound(path)
            hit = [(p, fn) for m, p, fn in found if m == method]
            if not hit:
                status, answer = "405 Method Not Allowed", {"error": method}
            else:
                status, answer = "200 OK", hit[0][1](body, *hit[0][0].groups())
        except tuple(_STATUS) as e:
            status, answer = next(s for t, s in _STATUS.items() if isinstance(e, t)), {"error": str(e)}
        except (KeyError, TypeError, ValueError) as e:
            status, answer = "400 Bad Request", {"error": f"bad request: {e}"}
        data = json.dumps(answer, default=str).encode()
        start_response(status, [("Content-Type", "application/json"), ("Content-Length", str(len(data)))])
        return [data]

    return wsgi
