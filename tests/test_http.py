"""The REST routes, called in process."""

import io
import json

from korvex.http import app
from korvex.store.collection import Database


def test_routes(spark, tmp_path):
    call_app = app(Database(spark, f"file://{tmp_path}/db"))

    def call(method, path, body=None):
        raw, seen = json.dumps(body).encode() if body is not None else b"", []
        env = {"REQUEST_METHOD": method, "PATH_INFO": path, "CONTENT_LENGTH": str(len(raw)), "wsgi.input": io.BytesIO(raw)}
        out = json.loads(b"".join(call_app(env, lambda status, _: seen.append(status))))
        return int(seen[0][:3]), out

    assert call("GET", "/health") == (200, {"status": "ok"})
    made = {"name": "c", "primary_vector": "v", "vectors": [{"name": "v", "dimension": 2}], "fields": [{"name": "n", "type": "int32", "nullable": True}]}
    assert call("POST", "/collections", made)[0] == 200 and call("POST", "/collections", made)[0] == 409
    docs = [{"id": str(i), "fields": {"n": i}, "vectors": {"v": [i, 0]}} for i in range(6)]
    assert call("POST", "/collections/c/records", {"documents": docs}) == (200, {"inserted": 6})
    status, found = call("POST", "/collections/c/search", {"queries": [{"vector": [2.2, 0]}], "filter": "n != 2", "top_k": 2, "output_fields": ["n"]})
    assert status == 200 and [h["id"] for h in found["hits"]] == ["3", "1"]
    assert call("POST", "/collections/c/search", {"bogus": 1})[0] == 400
    assert call("POST", "/collections/c/records/update", {"ids": ["1", "9"], "fields": {"n": None}}) == (200, {"updated": 1})
    assert call("DELETE", "/collections/c/records", {"ids": ["0"]}) == (200, {"deleted": 1})
    assert call("DELETE", "/collections/c/records", {"ids": [0]})[0] == 400
    assert call("POST", "/collections/c/records/delete_by_filter", {"filter": "n > 4"}) == (200, {"deleted": 1})
    status, got = call("POST", "/collections/c/records/fetch", {"ids": ["3", "1", "3", "7"]})
    assert [d["id"] for d in got["documents"]] == ["3", "1", "3"] and got["documents"][1]["n"] is None
    assert call("GET", "/collections/c/stats")[1]["live_count"] == 4
    assert call("POST", "/collections/c/schema/columns", {"name": "m", "type": "string", "nullable": True})[0] == 200
    assert call("PATCH", "/collections/c/schema/columns/m", {"new_name": "k"})[0] == 200
    assert call("POST", "/collections/c/indexes/scalar", {"field": "n", "kind": "inverted"})[0] == 200
    assert call("GET", "/collections/c/indexes/scalar")[1]["indexes"].keys() == {"n"}
    assert call("GET", "/collections/c/admin/segments")[0] == 200 and call("POST", "/collections/c/admin/compact")[0] == 200
    assert call("GET", "/nothing")[0] == 404 and call("PUT", "/collections")[0] == 405 and call("GET", "/collections/zz")[0] == 404
    assert call("DELETE", "/collections/c")[0] == 200 and call("GET", "/collections")[1] == {"collections": []}
