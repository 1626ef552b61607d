"""Ingest, retrieve and delete as lazy plans around one action each."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import auth, embed
from ..operators.auth import Authorizer, Mode
from ..sources.store import TableStore

log = logging.getLogger("corvane")
#: Subjects or tenants whose searches one plan holds.
MOST_NAMES = 64


@dataclass
class Hook:
    """Called on the driver around the pipeline's actions; any of them may be absent."""

    before_ingest: Callable[[int], None] | None = None
    after_ingest: Callable[[int, Exception | None], None] | None = None
    before_retrieve: Callable[[DataFrame], None] | None = None
    after_retrieve: Callable[[int, Exception | None], None] | None = None
    before_rerank: Callable[[DataFrame], None] | None = None
    after_rerank: Callable[[int, Exception | None], None] | None = None


def log_hook() -> Hook:
    """A hook that logs what happens."""

    def after(what: str) -> Callable[[int, Exception | None], None]:
        return lambda n, error: log.info("%s: %d rows", what, n) if error is None else log.error("%s failed: %s", what, error)

    return Hook(
        lambda n: log.info("ingesting %d documents", n),
        after("ingest"),
        lambda q: log.info("retrieving for queries %s", q.columns),
        after("retrieve"),
        lambda f: log.info("reranking %s", f.columns),
        after("rerank"),
    )


class Pipeline:
    """A splitter, an embedder, a store and a retriever, with optional reranker and
    authorizer.

    ``retriever`` takes (chunks, queries); ``reranker`` takes (found, queries).
    Post-filtering drops units after ranking, so fewer than asked for may remain.
    Pre-filtering searches only what each query's subject may see; a query without
    a subject finds nothing. Hybrid mode searches only the chunks of the tenant
    that a query names, whatever the retriever, and filters by subject afterwards.
    """

    def __init__(
        self,
        splitter: Callable[[DataFrame], DataFrame],
        embedder: Callable[[Column], Column],
        store: TableStore,
        retriever: Callable[[DataFrame, DataFrame], DataFrame],
        reranker: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
        authorizer: Authorizer | None = None,
        mode: Mode = Mode.POST_FILTER,
        hooks: Sequence[Hook] = (),
    ):
        for name, part in (("splitter", splitter), ("embedder", embedder), ("store", store), ("retriever", retriever)):
            if part is None:
                raise ValueError(f"{name} is required")
        self.splitter, self.embedder, self.store, self.retriever = splitter, embedder, store, retriever
        self.reranker, self.authorizer, self.mode, self.hooks = reranker, authorizer, mode, list(hooks)

    def _call(self, name: str, *args) -> None:
        for hook in self.hooks:
            if fn := getattr(hook, name):
                fn(*args)

    def ingest(self, documents: DataFrame) -> int:
        """Split, embed and store; earlier chunks of the same documents go. Returns the
        number of chunks, which is counted as they are written."""
        if self.hooks:
            self._call("before_ingest", documents.count())
        seen = Observation()
        chunks = embed.embed_chunks(self.splitter(documents), self.embedder).observe(seen, F.count("*").alias("n"))
        try:
            self.store.replace_documents(chunks)
        except Exception as e:
            self._call("after_ingest", 0, e)
            raise
        count = seen.get["n"]
        self._call("after_ingest", count, None)
        return count

    def _each(self, chunks: DataFrame, queries: DataFrame, column: str, seen: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
        """The retriever's results for the queries of each subject or tenant, over the
        chunks that it sees."""
        names = [r[0] for r in queries.where(F.coalesce(F.col(column), F.lit("")) != "").select(column).distinct().limit(MOST_NAMES + 1).collect()]
        if len(names) > MOST_NAMES:
            raise ValueError(f"at most {MOST_NAMES} values of {column} at a time")
        if not names:
            return self.retriever(chunks.where(F.lit(False)), queries.where(F.lit(False)))
        return reduce(DataFrame.unionByName, (self.retriever(seen(chunks, name), queries.where(F.col(column) == name)) for name in sorted(names)))

    def plan(self, queries: DataFrame, action: str = "read") -> DataFrame:
        """The lazy plan of ``retrieve``."""
        authorizer = self.authorizer
        if authorizer is None or self.mode is Mode.POST_FILTER:
            found = self.retriever(self.store.chunks(), queries)
        else:
            chunks = self.store.chunks()
            if self.mode is Mode.PRE_FILTER:
                found = self._each(chunks, queries, "subject", lambda chunks, who: auth.permitted_chunks(chunks, who, authorizer, action))
            elif "tenant_id" not in queries.columns:
                found = self.retriever(chunks, queries)
            else:
                named = F.coalesce(F.col("tenant_id"), F.lit("")) != ""
                found = self._each(chunks, queries.where(named), "tenant_id", auth.tenant_chunks).unionByName(self.retriever(chunks, queries.where(~named)))
        if self.reranker is not None:
            self._call("before_rerank", found)
            found = self.reranker(found, queries)
        if authorizer is not None and self.mode is not Mode.PRE_FILTER:
            found = auth.post_filter(found, queries, authorizer, action)
        return found

    def retrieve(self, queries: DataFrame, action: str = "read") -> list:
        """Ranked units of all queries, as rows."""
        self._call("before_retrieve", queries)
        try:
            rows = self.plan(queries, action).orderBy("query_id", "rank").collect()
        except Exception as e:
            if self.reranker is not None:
                self._call("after_rerank", 0, e)
            self._call("after_retrieve", 0, e)
            raise
        if self.reranker is not None:
            self._call("after_rerank", len(rows), None)
        self._call("after_retrieve", len(rows), None)
        return rows

    def delete(self, document_ids: Sequence[str]) -> None:
        """All chunks of these documents go."""
        self.store.delete_documents(document_ids)
