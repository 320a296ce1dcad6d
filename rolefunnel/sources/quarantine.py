"""JSON payloads taken apart item by item, with what cannot be read put aside and named.

A payload lands as VARIANT, so one item of a wrong shape costs neither its payload
nor its neighbours: items are exploded as they are, and each is held against the
columns wanted.  What is left over is a table of rejects with the place and the
reason, one row per payload or item.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefunnel.operators.barrier import add_once
from rolefunnel.schema import ddl_fields
from rolefunnel.sources import feeds

#: Each JSON feed: fields of an item, the member that holds the items, and the fields an item cannot do without.
JSON_FEEDS: dict[str, tuple[str, str | None, tuple[str, ...]]] = {
    "remoteok": (feeds.REMOTEOK_ITEM, None, ("position", "company")),
    "remotive": (feeds.REMOTIVE_ITEM, "jobs", ("title", "company_name", "url")),
    "himalayas": (feeds.HIMALAYAS_ITEM, "jobs", ("title",)),
    "jobicy": (feeds.JOBICY_ITEM, "jobs", ("jobTitle", "url")),
    "arbeitnow": (feeds.ARBEITNOW_ITEM, "data", ("slug", "title")),
}


def _kind(value: Column) -> Column:
    """``ARRAY``, ``OBJECT`` or another word that a VARIANT's schema starts with."""
    return F.regexp_extract(F.schema_of_variant(value), r"^([A-Z]+)", 1)


def _landed_items(landed: DataFrame, member: str | None) -> DataFrame:
    """Columns of ``landed`` without ``payload``, and ``pos``, ``item``, ``reason``, ``raw``.

    A payload without readable items is one row with a reason and no position.
    """
    context = [c for c in landed.columns if c != "payload"]
    parsed = add_once(landed, {"_v": F.try_parse_json("payload"), "raw": F.col("payload")}).drop("payload")
    items = F.col("_v") if member is None else F.try_variant_get("_v", f"$.{member}", "variant")
    shape = "payload is no array" if member is None else f"payload has no array {member}"
    reason = (
        F.when(F.coalesce(F.trim("raw"), F.lit("")) == "", "payload is empty")
        .when(F.col("_v").isNull(), "payload is no JSON")
        .when(F.coalesce(_kind(F.col("_items")), F.lit("")) != "ARRAY", shape)
    )
    shaped = parsed.withColumn("_items", items).withColumn("reason", reason)
    exploded = shaped.lateralJoin(shaped.sparkSession.tvf.variant_explode_outer(F.when(F.col("reason").isNull(), F.col("_items")).outer()))
    # An empty array gives one row without a position too: it holds nothing, good or bad.
    rows = exploded.filter(F.col("reason").isNotNull() | F.col("pos").isNotNull())
    return rows.select(*context, F.col("pos").cast("bigint").alias("pos"), F.col("value").alias("item"), "reason", "raw")


def _fault(ddl: str, required: Sequence[str]) -> Column:
    """Why an item cannot be read; null where it can."""
    item, reason = F.col("item"), F.lit(None).cast("string")
    for name, dtype in reversed(ddl_fields(ddl)):
        there = F.try_variant_get(item, f"$.{name}", "variant")
        kind = _kind(there)
        missing = there.isNull() | (kind == "VOID")
        if name in required:
            reason = F.when(missing, f"field {name} is missing").otherwise(reason)
        if dtype.startswith("array"):
            wrong = kind != "ARRAY"
        elif dtype == "string":
            wrong = kind.isin("ARRAY", "OBJECT")
        else:
            wrong = F.try_variant_get(item, f"$.{name}", dtype).isNull()
        reason = F.when(~missing & wrong, f"field {name} is no {dtype}").otherwise(reason)
    return F.when(_kind(item) != "OBJECT", "item is no object").otherwise(reason)


def split_items(landed: DataFrame, ddl: str, member: str | None, required: Sequence[str] = (), skip_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of landed payloads (..., payload).

    ``good`` has the other columns of ``landed``, ``pos`` and the fields of ``ddl``;
    ``rejects`` those columns, ``pos`` (null for a whole payload), ``reason`` and
    ``raw``, the payload or item as text.  ``skip_first`` leaves the first item of a
    payload out, where that is a notice.
    """
    context = [c for c in landed.columns if c != "payload"]
    rows = _landed_items(landed, member)
    if skip_first:
        rows = rows.filter(F.col("pos").isNull() | (F.col("pos") > 0))
    judged = add_once(rows, {"reason": F.coalesce("reason", F.when(F.col("pos").isNotNull(), _fault(ddl, required)))})
    fields = [F.try_variant_get("item", f"$.{name}", dtype).alias(name) for name, dtype in ddl_fields(ddl)]
    good = judged.filter(F.col("reason").isNull()).select(*context, "pos", *fields)
    raw = F.when(F.col("pos").isNull(), F.col("raw")).otherwise(F.to_json("item")).alias("raw")
    return good, judged.filter(F.col("reason").isNotNull()).select(*context, "pos", "reason", raw)


def split_feed(landed: DataFrame, feed: str) -> tuple[DataFrame, DataFrame]:
    """``split_items`` for one of ``JSON_FEEDS``."""
    ddl, member, required = JSON_FEEDS[feed]
    return split_items(landed, ddl, member, required, skip_first=member is None)


def outcome(good: DataFrame, rejects: DataFrame) -> DataFrame:
    """(reason, n): rows read, under ``read``, and rejects by reason."""
    rows = good.select(F.lit("read").alias("reason")).unionByName(rejects.select("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))
