"""Multi-tenant access to stored assessments: roles, row filters, submit, list, delete, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import windows as wi

#: What each role may do.
ROLES = {
    "owner": ("assessment:create", "assessment:read", "assessment:list", "assessment:delete", "audit:read", "policy:read", "policy:write", "member:manage"),
    "admin": ("assessment:create", "assessment:read", "assessment:list", "assessment:delete", "audit:read", "policy:read"),
    "analyst": ("assessment:create", "assessment:read", "assessment:list"),
    "viewer": ("assessment:read", "assessment:list"),
}


def permissions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, a) for r, actions in ROLES.items() for a in actions], "role STRING, action STRING")


def allowed(requests: DataFrame, roles: DataFrame) -> DataFrame:
    """requests (role, action, tenant, resource_tenant) with allowed: denied unless the role has the action and the tenants are one."""
    held = roles.withColumn("granted", F.lit(True))
    return requests.join(F.broadcast(held), ["role", "action"], "left").withColumn("allowed", F.coalesce("granted", F.lit(False)) & (F.col("tenant") == F.col("resource_tenant"))).drop("granted")  # a dozen permissions


def own(rows: DataFrame, tenant: str | Column) -> DataFrame:
    """Rows of one tenant; others' are as if they weren't there."""
    return rows.filter(F.col("tenant") == tenant)


def get(rows: DataFrame, tenant: str, scan_id: str) -> DataFrame:
    return own(rows, tenant).filter(F.col("scan_id") == scan_id)


def submit(store: str, rows: DataFrame) -> None:
    """Appends assessments to a table partitioned by tenant."""
    rows.write.mode("append").partitionBy("tenant").parquet(store)


def without_scan(rows: DataFrame, tenant: str, scan_id: str) -> DataFrame:
    """The store after a tenant's scan is deleted."""
    return rows.filter(~((F.col("tenant") == tenant) & (F.col("scan_id") == scan_id)))


def audit(chain: DataFrame, tenant: str, key: str, order: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """(the chains' state over all tenants, the tenant's own entries)."""
    return wi.verify(chain, key, order, payload), own(chain, tenant)
