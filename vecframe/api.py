"""The request surface: JSON in, DataFrames through the operators, JSON out."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import filters, ivf, search, topk, validate
from .sources.requests import respond


def compile_request_filter(spec: Any, fields) -> Column | None:
    """A filter in any dialect: a tree, a list of request conditions, a document, or an exact map."""
    if not spec:
        return None
    if isinstance(spec, list):
        return filters.compile_filter(filters.from_request(spec), fields)
    if "logical_operator" in spec:
        return filters.compile_filter(filters.parse(spec), fields)
    if any(isinstance(v, dict) or k.startswith("metadata.") for k, v in spec.items()):
        return filters.compile_filter(filters.from_document(spec), fields)
    return filters.compile_filter(filters.from_map({k: str(v) for k, v in spec.items()}), fields)


class Engine:
    """Search over one table of vectors (id, data, and metadata in columns, a map or a VARIANT)."""

    def __init__(self, vectors: DataFrame, fields=None, index: ivf.IVF | None = None):
        self.vectors, self.index = vectors, index
        self.fields = fields or filters.TypedFields(vectors)

    def search(self, request: str | dict) -> DataFrame:
        """id, distance, score, rank for {vector, k, metric, threshold, filter, mode, cluster_ids, recall_preference, strategy}."""
        r = json.loads(request) if isinstance(request, str) else request
        k = search.clamp_k(r.get("k"))
        validate.check_request(k=k, threshold=r.get("threshold"))
        where = compile_request_filter(r.get("filter"), self.fields)
        if r.get("cluster_ids"):
            own = F.col("cluster_id").isin(r["cluster_ids"])
            where = own if where is None else where & own
        if self.index is not None and where is None and r.get("recall_preference"):
            out = self.index.search(r["vector"], k, self.index.nprobe_for(r["recall_preference"]), r.get("threshold"))
            from .functions.distance import score_metric

            out = out.withColumn("score", score_metric(F.col("distance"), self.index.metric))
        else:
            out = search.knn(self.vectors, r["vector"], k, r.get("metric"), r.get("threshold"), where, r.get("mode") == "post")
        if r.get("strategy"):
            options = {n: r[n] for n in ("score_threshold",) if n in r}
            if r["strategy"] in ("threshold", "hybrid") and options:
                return topk.select(out.drop("rank"), r["strategy"], threshold=options["score_threshold"])
            return topk.select(out.drop("rank"), r["strategy"])
        return out

    def search_batch(self, requests: list[dict]) -> DataFrame:
        """Results of up to 100 requests with query_id 0..n-1; a request that fails its checks gives no rows."""
        validate.check_request(batch=len(requests))
        out = None
        for i, r in enumerate(requests):
            try:
                part = self.search(r).withColumn("query_id", F.lit(str(i)))
            except ValueError:
                continue
            part = part.select("query_id", "id", "distance", "score", "rank")
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError("no request could be run")
        return out

    def respond(self, request: str | dict) -> str:
        rows = respond(self.search(request).withColumn("query_id", F.lit("0"))).collect()  # k rows at most
        return rows[0].body if rows else json.dumps({"results": [], "total": 0})
