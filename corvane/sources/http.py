"""Connectors that speak HTTP: embedding services, a vector service, a relationship service."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import MetadataFilter
from .store import DEFAULT_TOP_K

#: Rows sent in one request.
BATCH = 256
#: Payload fields of a point that are not metadata.
INTERNAL = ("source_doc_id", "source_uri", "content")
#: Vector lengths of known embedding models.
DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536}


def request(method: str, url: str, body: object = None, headers: dict[str, str] | None = None, timeout: float = 60) -> dict:
    """A JSON request; any status but 2xx is an error with the response's body."""
    data = None if body is None else json.dumps(body).encode()
    call = urllib.request.Request(url, data=data, method=method, headers={"Content-Type": "application/json", **(headers or {})})
    try:
        with urllib.request.urlopen(call, timeout=timeout) as answer:
            text = answer.read()
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"{method} {url} returned {e.code}: {e.read().decode('utf-8', 'replace')}") from e
    return json.loads(text) if text else {}


def bearer(key: str) -> dict[str, str]:
    return {"Authorization": f"Bearer {key}"} if key else {}


def ollama_embedder(model: str, url: str = "http://localhost:11434") -> Callable[[list[str]], list[list[float]]]:
    """Texts to vectors by a local embedding server."""

    def embed(texts: list[str]) -> list[list[float]]:
        return request("POST", f"{url.rstrip('/')}/api/embed", {"model": model, "input": texts})["embeddings"] if texts else []

    return embed


def openai_embedder(model: str, api_key: str = "", url: str = "https://api.openai.com/v1") -> Callable[[list[str]], list[list[float]]]:
    """Texts to vectors by an embeddings service; answers are put in order by index."""

    def embed(texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        rows = request("POST", f"{url.rstrip('/')}/embeddings", {"model": model, "input": texts}, bearer(api_key))["data"]
        out: list[list[float]] = [[] for _ in texts]
        for row in rows:
            if row["index"] < len(out):
                out[row["index"]] = row["embedding"]
        return out

    return embed


def dimensions(model: str) -> int:
    """The vector length of a model; unknown ones count as the smallest."""
    return DIMENSIONS.get(model, 1536)


class Qdrant:
    """Points of one collection, reached over HTTP from the executors."""

    def __init__(self, url: str, collection: str, size: int, api_key: str = ""):
        if not url or not collection or size <= 0:
            raise ValueError("url, collection and a positive size are required")
        self.base, self.size = f"{url.rstrip('/')}/collections/{collection}", size
        self.headers = {"api-key": api_key} if api_key else {}

    def ensure(self) -> None:
        request("PUT", self.base, {"vectors": {"size": self.size, "distance": "Cosine"}}, self.headers)

    def store(self, chunks: DataFrame) -> int:
        """Upsert points; metadata may replace the internal payload fields. Repeats
        of a partition after a lost executor write the same points again."""
        base, headers = self.base, self.headers

        def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sent = 0
            for frame in frames:
                points = []
                for row in frame.to_dict("records"):
                    payload = {"source_doc_id": row["source_doc_id"], "source_uri": row["source_uri"], "content": row["as_text"]}
                    payload |= json.loads(row["metadata"]) if row["metadata"] else {}
                    points.append({"id": row["unit_id"], "vector": [float(x) for x in row["vector"]], "payload": payload})
                for i in range(0, len(points), BATCH):
                    request("PUT", f"{base}/points", {"points": points[i : i + BATCH]}, headers)
                sent += len(points)
            yield pd.DataFrame({"sent": [sent]})

        rows = chunks.select("unit_id", "source_doc_id", F.coalesce("source_uri", F.lit("")).alias("source_uri"), F.coalesce("as_text", "text").alias("as_text") if "as_text" in chunks.columns else F.col("text").alias("as_text"), "vector", F.to_json("metadata").alias("metadata"))
        return rows.mapInPandas(send, "sent long").agg(F.sum("sent")).first()[0] or 0

    def search(self, spark: SparkSession, vector: Sequence[float], top_k: int = 0, where: MetadataFilter | None = None) -> DataFrame:
        """Nearest points as chunks with scores; metadata is the payload without the internal fields."""
        body: dict = {"nearest": {"vector": [float(x) for x in vector]}, "limit": top_k if top_k > 0 else DEFAULT_TOP_K, "with_payload": True}
        if where is not None and (test := point_filter(where)):
            body["filter"] = test
        points = request("POST", f"{self.base}/points/query", body, self.headers)["result"]["points"]
        rows = [
            (str(p["id"]), p["payload"].get("source_doc_id"), p["payload"].get("source_uri"), p["payload"].get("content"), json.dumps({k: v for k, v in p["payload"].items() if k not in INTERNAL}), float(p["score"]))
            for p in points
        ]
        return spark.createDataFrame(rows, "unit_id string, source_doc_id string, source_uri string, text string, metadata string, score double").withColumn("metadata", F.parse_json("metadata"))

    def delete(self, unit_ids: Sequence[str]) -> None:
        if unit_ids:
            request("POST", f"{self.base}/points/delete", {"points": list(unit_ids)}, self.headers)


def point_filter(f: MetadataFilter) -> dict | None:
    """A filter in the vector service's own form; ``in`` and ``any_of`` are alike there."""
    if f.op == "eq":
        match: dict = {"value": f.value}
    elif f.op in ("in", "any_of"):
        match = {"any": list(f.value)}
    else:
        return None
    return {"must": [{"key": f.field, "match": match}]}


class RelationshipService:
    """Checks and lists of a relationship-based authorization server."""

    def __init__(self, url: str, store_id: str, model_id: str = "", api_key: str = ""):
        if not url or not store_id:
            raise ValueError("url and store_id are required")
        self.base, self.model, self.headers = f"{url.rstrip('/')}/stores/{store_id}", {"authorization_model_id": model_id} if model_id else {}, bearer(api_key)

    def check(self, subject: str, action: str, resource: str) -> bool:
        body = {"tuple_key": {"user": subject, "relation": action, "object": resource}, **self.model}
        return bool(request("POST", f"{self.base}/check", body, self.headers).get("allowed"))

    def filter(self, subject: str, action: str, candidates: Sequence[str] | None) -> list[str]:
        """The candidates that are allowed; without candidates, all documents that are."""
        if candidates is not None:
            return [c for c in candidates if self.check(subject, action, c)]
        return request("POST", f"{self.base}/list-objects", {"user": subject, "relation": action, "type": "document", **self.model}, self.headers).get("objects", [])

    def grants(self, spark: SparkSession, subjects: Sequence[str], action: str = "reader") -> DataFrame:
        """What each subject may read as rows (subject, resource), without the type before the id."""
        rows = [(s, o.removeprefix("document:")) for s in subjects for o in self.filter(s, action, None)]
        return spark.createDataFrame(rows, "subject string, resource string")
