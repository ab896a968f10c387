"""Capabilities: who may do what to which resource."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("read", "write", "admin")


def level(permission: Column) -> Column:
    """Higher includes lower; unknown permissions are null."""
    return F.when(permission == "read", 0).when(permission == "write", 1).when(permission == "admin", 2)


def active(grants: DataFrame, revoked: DataFrame, now: int) -> DataFrame:
    """Grants neither revoked nor expired."""
    alive = F.col("expires_at").isNull() | (F.col("expires_at") > now)
    return grants.where(alive).join(revoked.select("grant_id"), "grant_id", "left_anti")


def covers(ns: Column, key: Column) -> Column:
    """Whether a grant's pattern (``kind``, ``pattern``) covers a resource."""
    resource = F.concat_ws(":", ns, key)
    return F.coalesce(
        F.when(F.col("kind") == "exact", resource == F.col("pattern"))
        .when(F.col("kind") == "wildcard", resource.startswith(F.regexp_replace("pattern", r"\*$", "")))
        .when(F.col("kind") == "namespace", ns == F.col("pattern")),
        F.lit(False),
    )


def of_grantee(grants: DataFrame, identity: str) -> DataFrame:
    return grants.where(F.col("grantee") == identity)


def of_granter(grants: DataFrame, identity: str) -> DataFrame:
    return grants.where(F.col("granter") == identity)


def for_resource(grants: DataFrame, ns: str, key: str) -> DataFrame:
    return grants.where(covers(F.lit(ns), F.lit(key)))


def authorize(
    requests: DataFrame, grants: DataFrame, revoked: DataFrame, now: int
) -> DataFrame:
    """The requests (identity, ns, key, permission) that an active grant covers.

    A grant's ``pattern`` is exact ('ns:key'), a prefix (with '*' at its end) or a namespace
    ('ns').  Identity is an equality, so the join hashes on it and tests patterns only among
    a grantee's own grants.
    """
    g = active(grants, revoked, now).select("grantee", "kind", "pattern", level(F.col("permission")).alias("up_to"))
    fits = covers(F.col("ns"), F.col("key"))
    enough = F.col("up_to") >= level(F.col("permission"))
    return requests.join(g, (F.col("identity") == F.col("grantee")) & fits & enough, "left_semi")
