"""HTTP contracts and routes: OpenAPI documents, route detectors over source text, checks between both."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import route_key

# Methods of operations, keys that only annotate, and route patterns of frameworks as (detector, languages, pattern).
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
ANNOTATIONS = ("description", "title", "example", "examples", "summary", "externalDocs")
DETECTORS = (
    ("annotation", ("typescript", "javascript", "python", "rust"), r"@route\s+(GET|PUT|POST|DELETE|PATCH|HEAD|OPTIONS)\s+(\S+)"),
    ("router_call", ("typescript", "javascript"), r"\b(?:app|router|server|fastify)\.(get|put|post|delete|patch)\(\s*[\"'`]([^\"'`]+)"),
    ("decorator", ("python",), r"@\w+\.(get|put|post|delete|patch)\(\s*[\"']([^\"']+)"),
    ("attribute", ("rust",), r"#\[(get|put|post|delete|patch)\(\s*\"([^\"]+)"),
)
OPERATIONS = "source string, key string, method string, path string, operation_id string, security array<string>, parameters array<string>, request_body string, responses array<string>, problem string"


def resolve(document: dict, node: object, seen: tuple[str, ...] = ()) -> object:
    """References replaced by what they name; one that is open already becomes {"$recursiveRef": name}."""
    if isinstance(node, dict):
        target = node.get("$ref")
        if isinstance(target, str) and target.startswith("#/"):
            if target in seen:
                return {"$recursiveRef": target}
            at: object = document
            for part in target[2:].split("/"):
                part = part.replace("~1", "/").replace("~0", "~")
                at = at.get(part) if isinstance(at, dict) else None
            return resolve(document, at, (*seen, target))
        return {k: resolve(document, v, seen) for k, v in node.items()}
    if isinstance(node, list):
        return [resolve(document, x, seen) for x in node]
    return node


def schema_digest(document: dict, schema: object) -> str:
    """A digest of a schema's meaning: annotations don't count, the order of keys doesn't either."""

    def plain(x: object) -> object:
        if isinstance(x, dict):
            return {k: plain(v) for k, v in sorted(x.items()) if k not in ANNOTATIONS}
        return [plain(y) for y in x] if isinstance(x, list) else x

    return hashlib.sha256(json.dumps(plain(resolve(document, schema)), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def operations(source: str, text: str) -> list[dict]:
    """One row an operation, and rows with a problem for what is wrong in the document."""
    empty = dict.fromkeys(x.split()[0] for x in OPERATIONS.split(", "))
    try:
        document = json.loads(text)
        if not str(document.get("openapi", "")).startswith(("3.0", "3.1")):
            raise ValueError
    except (ValueError, AttributeError):
        return [empty | {"source": source, "problem": "schema_unreadable"}]
    out, ids = [], {}
    for path, item in sorted((document.get("paths") or {}).items()):
        item = resolve(document, item) or {}
        for method in METHODS:
            if not isinstance(op := item.get(method), dict):
                continue
            parameters = sorted(f"{p.get('in')}:{p.get('name')}:{bool(p.get('required'))}:{schema_digest(document, p.get('schema'))[:16]}" for p in [*item.get("parameters", []), *op.get("parameters", [])] if isinstance(p, dict))
            security = sorted({name for need in op.get("security", document.get("security", [])) or [] for name in need})
            responses = sorted(f"{code}:{','.join(sorted((r or {}).get('content', {})))}" for code, r in (op.get("responses") or {}).items())
            body = op.get("requestBody")
            row = empty | {"source": source, "method": method.upper(), "path": path, "operation_id": op.get("operationId"), "security": security, "parameters": parameters, "responses": responses, "request_body": schema_digest(document, body) if body else None}
            out.append(row)
            named = {p.split(":")[1] for p in parameters if p.startswith("path:")}
            wanted = {x[1:-1] for x in path.split("/") if x.startswith("{") and x.endswith("}")}
            problems = [
                ("operation_id_missing", not op.get("operationId")),
                ("operation_id_duplicate", op.get("operationId") in ids),
                ("path_parameter_undeclared", bool(wanted - named)),
                ("success_response_missing", not any(r[0] in "23" for r in responses)),
                ("client_error_response_missing", not any(r[0] == "4" for r in responses)),
                ("security_missing", not security),
            ]
            ids[op.get("operationId")] = True
            out += [row | {"problem": name} for name, holds in problems if holds]
    return out


def scan_openapi(files: DataFrame) -> DataFrame:
    """Operations and problems of every document of (path, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in OPERATIONS.split(", ")]
        kinds = [pa.list_(pa.string()) if "array" in x else pa.string() for x in OPERATIONS.split(", ")]
        for batch in batches:
            rows = [r for p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in operations(p, t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    found = files.select("path", "text").mapInArrow(run, OPERATIONS)
    return found.withColumn("key", F.when(F.col("path").isNotNull(), route_key(F.col("method"), F.col("path"))))


def scan_routes(files: DataFrame) -> DataFrame:
    """(path, line, detector, key) of routes that the detectors find in (path, language, text); one row a key and line, with the first detector by name."""
    out = None
    lines = files.select("path", "language", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    for detector, languages, pattern in DETECTORS:
        method, target = F.regexp_extract("text", pattern, 1), F.regexp_extract("text", pattern, 2)
        found = lines.filter(F.col("language").isin(*languages) & F.col("text").rlike(pattern)).select("path", (F.col("line") + 1).alias("line"), F.lit(detector).alias("detector"), route_key(method, target).alias("key"))
        out = found if out is None else out.unionByName(found)
    return out.groupBy("path", "line", "key").agg(F.min("detector").alias("detector")).select("path", "line", "detector", "key")


def check(contract: DataFrame, routes: DataFrame, complete: bool) -> DataFrame:
    """(code, key, severity): operations that stand twice, and keys that only the contract or only the sources have."""
    documented = contract.filter("problem IS NULL").select("key", "operation_id")
    twice = documented.filter("operation_id IS NOT NULL").groupBy("operation_id").agg(F.count("*").alias("n"), F.min("key").alias("key")).filter("n > 1").select(F.lit("operation_id_duplicate").alias("code"), "key", F.lit("error").alias("severity"))
    again = routes.groupBy("key").agg(F.countDistinct("path").alias("n")).filter("n > 1").select(F.lit("source_operation_duplicate").alias("code"), "key", F.lit("warning").alias("severity"))
    level = F.lit("error" if complete else "warning")
    left = documented.select("key").distinct().join(routes, "key", "left_anti").select(F.lit("operation_without_source").alias("code"), "key", level.alias("severity"))
    right = routes.select("key").distinct().join(documented, "key", "left_anti").select(F.lit("source_without_operation").alias("code"), "key", level.alias("severity"))
    return twice.unionByName(again).unionByName(left).unionByName(right)
