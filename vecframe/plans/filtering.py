"""Metadata filter and validation queries, over documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as L
from ..operators import rules, validate
from .registry import query, table, vectors


def _filter(name, tree, sql):
    @query(f"flt_{name}", f"SELECT doc_id FROM documents WHERE {sql}")
    def run(spark, sf):
        docs = table(spark, sf, "documents")
        fields = L.TypedFields(docs, {"source": "source", "lang": "lang", "n_chars": "n_chars", "text": "text"})
        return docs.where(L.compile_filter(L.parse(tree) if isinstance(tree, dict) else tree, fields)).select("doc_id")


def _all(*conditions):
    return {"logical_operator": "and", "conditions": [dict(zip(("field", "operator", "value"), c, strict=False)) for c in conditions]}


_filter("eq", _all(("source", "eq", "src0")), "source = 'src0'")
_filter("eq_number", _all(("n_chars", "eq", "1000")), "n_chars = 1000")
_filter("ne", _all(("lang", "ne", "en")), "lang <> 'en'")
_filter("gt_ge_lt_le", _all(("n_chars", "gt", 500), ("n_chars", "ge", 501), ("n_chars", "lt", 9000), ("n_chars", "le", 8999)), "n_chars > 500 AND n_chars < 9000")
_filter("in_nin", _all(("lang", "in", ["en", "de"]), ("source", "nin", ["src1", "src2"])), "lang IN ('en', 'de') AND source NOT IN ('src1', 'src2')")
_filter("contains", _all(("text", "contains", "and"), ("text", "ncontains", "the ")), "contains(text, 'and') AND NOT contains(text, 'the ')")
_filter("prefix_suffix", _all(("text", "startswith", "E"), ("text", "endswith", ".")), "starts_with(text, 'E') AND suffix(text, '.')")
_filter("regex", _all(("source", "regex", "^src[0-4]$")), "regexp_matches(source, '^src[0-4]$')")
_filter("exists", _all(("lang", "exists"), ("missing", "nexists")), "lang IS NOT NULL")
_filter(
    "and_or_not",
    {"logical_operator": "or", "conditions": [{"field": "lang", "operator": "eq", "value": "fr"}], "groups": [{"logical_operator": "not", "conditions": [{"field": "n_chars", "operator": "gt", "value": 1000}, {"field": "source", "operator": "ne", "value": "src3"}]}]},
    "lang = 'fr' OR NOT (n_chars > 1000 AND source <> 'src3')",
)
_filter("mongo", L.from_document({"metadata.lang": "en", "metadata.n_chars": {"$gte": 1000, "$lt": 5000}}), "lang = 'en' AND n_chars >= 1000 AND n_chars < 5000")
_filter("request", L.from_request([{"key": "lang", "operator": "in", "value": "en, es"}, {"key": "source", "operator": "!=", "value": "src0"}]), "lang IN ('en', 'es') AND source <> 'src0'")
_filter("match", L.from_match([("lang", "=", "de"), ("text", "contains", "und")]), "lang = 'de' AND contains(text, 'und')")
_filter("exact_map", L.from_map({"lang": "es", "source": "src1"}), "lang = 'es' AND source = 'src1'")


@query("flt_mixed_type", "SELECT doc_id FROM documents WHERE CAST(n_chars AS VARCHAR) > '9' OR CAST(n_chars AS VARCHAR) = '1234'")
def mixed(spark, sf):
    """Wire metadata: all values are strings, so order is that of text."""
    docs = table(spark, sf, "documents").select("doc_id", F.create_map(F.lit("n"), F.col("n_chars").cast("string")).alias("metadata"))
    tree = {"logical_operator": "or", "conditions": [{"field": "n", "operator": "gt", "value": 9}, {"field": "n", "operator": "eq", "value": 1234}]}
    return docs.where(L.compile_filter(L.parse(tree), L.MapFields(), F.col("metadata"))).select("doc_id")


@query("flt_variant", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 50 AND event_type <> 'error'")
def variant(spark, sf):
    """Numbers inside a VARIANT compare as numbers."""
    events = table(spark, sf, "events").select("event_id", "event_type", F.parse_json("props").alias("metadata"))
    got = events.where(L.compile_filter(L.parse(_all(("k", "ge", 50))), L.VariantFields(), F.col("metadata")))
    return got.where("event_type <> 'error'").select("event_id")


@query("validate_rows", "SELECT vec_id AS id, CASE WHEN list_max(embedding) > 0.35 OR list_min(embedding) < -0.35 THEN 'value range' END AS reason FROM embeddings")
def rows(spark, sf):
    v = vectors(spark, sf)
    return v.select("id", validate.reject_reason(F.col("id").cast("string"), F.col("data"), bounds=(F.lit(-0.35).cast("float"), F.lit(0.35).cast("float"))).alias("reason"))


@query("validate_metadata_schema", "SELECT doc_id, array_to_string(list_filter([CASE WHEN octet_length(encode(source)) > 4 THEN 'source: max' END, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'lang: enum' END, CASE WHEN n_chars < 100 THEN 'n_chars: min' END], lambda x: x IS NOT NULL), ',') AS errors FROM documents")
def schema(spark, sf):
    R = validate.Rule
    rules = {"source": (F.col("source"), R("string", max=4)), "lang": (F.col("lang"), R("string", enum=("en", "fr", "de"))), "n_chars": (F.col("n_chars"), R("int", min=100))}
    return table(spark, sf, "documents").select("doc_id", F.array_join(validate.schema_errors_typed(rules), ",").alias("errors"))


@query("validate_variant_schema", "SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS DOUBLE) > 80 THEN 'k: max' ELSE '' END AS errors FROM events")
def variant_schema(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.parse_json("props").alias("m"))
    return e.select("event_id", F.array_join(validate.schema_errors(F.col("m"), {"k": validate.Rule("int", required=True, max=80), "z": validate.Rule("string")}), ",").alias("errors"))


@query("size_estimate", "SELECT vec_id AS id, CAST(octet_length(encode(CAST(vec_id AS VARCHAR))) + 4 * len(embedding) + 16 + 24 AS BIGINT) AS bytes FROM embeddings")
def size(spark, sf):
    return vectors(spark, sf).select("id", validate.size_estimate(F.col("id").cast("string"), F.col("data"), F.lit(1)).alias("bytes"))


@query("request_rules", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in rules.RULES) + "], lambda x: x IS NOT NULL), ',') AS broken FROM documents")
def request_rules(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(rules.broken_rules(F.col("text")), ",").alias("broken"))
