"""Client scope, permissions and pairing codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCOPES = ("read", "write", "admin")


def scoped(rows: DataFrame, clients: DataFrame, client_id: str) -> DataFrame:
    """Rows of the knowledge bases a client may see: all if its list is null, none if it is unknown or revoked."""
    grants = clients.where((F.col("id") == client_id) & F.col("revoked_at").isNull()).select("kb_ids")
    seen = rows.select("kb_id").distinct().join(F.broadcast(grants.limit(1)), F.col("kb_ids").isNull() | F.array_contains("kb_ids", F.col("kb_id")), "left_semi")
    return rows.join(seen, "kb_id", "left_semi")


def allows(scopes: list[str], needed: str) -> bool:
    """admin implies write, write implies read."""
    if needed not in SCOPES:
        raise ValueError(f"unknown scope {needed!r}")
    return any(SCOPES.index(s) >= SCOPES.index(needed) for s in scopes if s in SCOPES)


def valid_codes(codes: DataFrame, now, attempts: int = 5) -> DataFrame:
    """Codes that can be redeemed: unused, not expired, fewer failed attempts than the cap."""
    return codes.where(F.col("consumed_at").isNull() & (F.col("expires_at") > now) & (F.col("attempts") < attempts))


def active_clients(clients: DataFrame, revoked_serials: DataFrame) -> DataFrame:
    return clients.where("revoked_at is null").join(revoked_serials, "cert_serial", "left_anti")


def failed_redeems(attempts: DataFrame, most: int = 5) -> DataFrame:
    """(code, failed, locked): failed attempts to redeem a code, and whether they reach the cap."""
    counted = attempts.groupBy("code").agg(F.sum(F.when(F.col("ok"), 0).otherwise(1)).alias("failed"))
    return counted.withColumn("locked", F.col("failed") >= most)
