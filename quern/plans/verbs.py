"""Queries on semi, anti and as-of joins and on sets of ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import verbs as B

from .book import query


@query("ext_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def ext_semi_join(t):
    """Customers with a finished order."""
    done = t("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return B.having(t("customer"), done, ["c_custkey"]).select("c_custkey")


@query("ext_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 450000)")
def ext_anti_join(t):
    """Customers without a large order."""
    return B.lacking(t("customer"), t("orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


@query(
    "ext_as_of_join",
    """WITH v AS (SELECT user_id, ts, MAX(event_id) AS seen FROM events WHERE event_type = 'view' GROUP BY 1, 2)
       SELECT e.event_id, v.seen FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts""",
)
def ext_as_of_join(t):
    """What each click's user saw last."""
    e = t("events")
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("seen"))
    return B.as_of(e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", ["seen"]).select("event_id", "seen")


@query("ids_common", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def ids_common(t):
    """Documents with a label."""
    return B.common_ids(t("documents"), t("labels"), "doc_id")


@query("ids_other", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def ids_other(t):
    """Documents without one."""
    return B.other_ids(t("documents"), t("labels"), "doc_id")
