"""Authorization: which subject may see which units. Everything fails closed."""

from __future__ import annotations

from enum import Enum
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



class Mode(Enum):
    """Where a pipeline enforces access."""

    POST_FILTER = 0
    PRE_FILTER = 1
    HYBRID = 2


class Authorizer(Protocol):
    """``allowed`` keeps the rows of ``requests`` (subject, action, resource and any
    more columns) that are permitted; ``resources`` lists what subjects may see, or
    is None where that cannot be listed."""

    def allowed(self, requests: DataFrame) -> DataFrame: ...
    def resources(self, subjects: DataFrame, action: str) -> DataFrame | None: ...


class Noop:
    """Everything is permitted."""

    def allowed(self, requests: DataFrame) -> DataFrame:
        return requests

    def resources(self, subjects: DataFrame, action: str) -> DataFrame | None:
        return None


class Allowlist:
    """Grants (subject, resource); the action does not matter."""

    def __init__(self, grants: DataFrame):
        self.grants = grants.select("subject", "resource").distinct()

    def allowed(self, requests: DataFrame) -> DataFrame:
        return requests.join(self.grants, ["subject", "resource"], "left_semi")

    def resources(self, subjects: DataFrame, action: str) -> DataFrame | None:
        return self.grants.join(subjects.select("subject").distinct(), "subject", "left_semi")

    def grant(self, more: DataFrame) -> "Allowlist":
        return Allowlist(self.grants.unionByName(more.select("subject", "resource")))

    def revoke(self, less: DataFrame) -> "Allowlist":
        return Allowlist(self.grants.join(less.select("subject", "resource"), ["subject", "resource"], "left_anti"))


class RoleBased:
    """Policies (subject, resource, action) with ``*`` for anything, and roles
    (subject, role) of one level.

    Wildcards are equi-joins on what a request may match, exact or ``*``: a request
    has at most four such keys for each of its subject's roles.
    """

    def __init__(self, policies: DataFrame, roles: DataFrame):
        self.policies, self.roles = policies, roles

    def allowed(self, requests: DataFrame) -> DataFrame:
        asked = requests.select("subject", "action", "resource").distinct()
        names = asked.select("subject").distinct()
        both = names.select("subject", F.col("subject").alias("_as")).unionByName(self.roles.join(names, "subject", "left_semi").select("subject", F.col("role").alias("_as"))).unionByName(names.select("subject", F.lit("*").alias("_as")))
        keys = (
            asked.join(both.distinct(), "subject")
            .withColumn("_resource", F.explode(F.array_distinct(F.array(F.col("resource"), F.lit("*")))))
            .withColumn("_action", F.explode(F.array_distinct(F.array(F.col("action"), F.lit("*")))))
        )
        rules = self.policies.select(F.col("subject").alias("_as"), F.col("resource").alias("_resource"), F.col("action").alias("_action")).distinct()
        permitted = keys.join(rules, ["_as", "_resource", "_action"], "left_semi").select("subject", "action", "resource").distinct()
        return requests.join(permitted, ["subject", "action", "resource"], "left_semi")

    def resources(self, subjects: DataFrame, action: str) -> DataFrame | None:
        return None


def check(authorizer: Authorizer, spark, subject: str, action: str, resource: str) -> bool:
    """One request."""
    return not authorizer.allowed(spark.createDataFrame([(subject, action, resource)], "subject string, action string, resource string")).isEmpty()


def post_filter(found: DataFrame, queries: DataFrame, authorizer: Authorizer, action: str = "read") -> DataFrame:
    """Ranked units without those that the query's subject may not see; nothing is
    filled in, the order stays. Queries without a subject see nothing."""
    asked = queries.select(F.col("query_id").alias("_asked"), "subject")
    requests = found.join(asked, F.col("query_id") == F.col("_asked")).where("coalesce(subject, '') <> ''").withColumn("action", F.lit(action)).withColumn("resource", F.col("source_doc_id"))
    return authorizer.allowed(requests).select(*found.columns)


def permitted_chunks(chunks: DataFrame, subject: str, authorizer: Authorizer, action: str = "read") -> DataFrame:
    """Chunks that a subject may see, to search in: the join goes below the scoring."""
    if isinstance(authorizer, Noop):
        return chunks
    names = chunks.sparkSession.createDataFrame([(subject,)], "subject string")
    listed = authorizer.resources(names, action)
    if listed is not None:
        return chunks.join(listed.select(F.col("resource").alias("source_doc_id")).distinct(), "source_doc_id", "left_semi")
    requests = chunks.select("source_doc_id").distinct().select(F.lit(subject).alias("subject"), F.lit(action).alias("action"), F.col("source_doc_id").alias("resource"))
    return chunks.join(authorizer.allowed(requests).select(F.col("resource").alias("source_doc_id")), "source_doc_id", "left_semi")


def tenant_chunks(chunks: DataFrame, tenant_id: str | None) -> DataFrame:
    """Chunks of one tenant; all where no tenant is named."""
    return chunks.where(F.coalesce(F.col("tenant_id") == tenant_id, F.lit(False))) if tenant_id else chunks


