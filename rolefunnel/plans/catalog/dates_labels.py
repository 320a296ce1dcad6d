"""Date forms, structured labels, JSON edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolefunnel.functions import dates as dt
from rolefunnel.functions import labels as lb
from rolefunnel.functions import text as t
from rolefunnel.functions import urls as u
from rolefunnel.plans.catalog.base import SQL_EMAIL, SQL_TITLE, query, sql_norm, sql_strip, table, title_of


def _micros(c):
    return F.unix_micros(c).alias("micros")


@query(
    "parse_iso",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) - 7200000000
       WHEN 2 THEN epoch_us(ts) + 19800000000 WHEN 3 THEN epoch_us(ts)
       WHEN 4 THEN epoch_us(date_trunc('day', ts)) ELSE NULL END AS micros FROM events""",
)
def _(spark, d):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    kind = F.col("event_id") % 6
    text = (
        F.when(kind == 0, F.concat(stamp, F.lit("Z")))
        .when(kind == 1, F.concat(stamp, F.lit("+02:00")))
        .when(kind == 2, F.concat(F.replace(stamp, F.lit("T"), F.lit(" ")), F.lit("-0530")))
        .when(kind == 3, stamp)
        .when(kind == 4, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.concat(F.lit("about "), stamp))
    )
    return table(spark, d, "events").select("event_id", _micros(dt.parse_iso(text)))


@query(
    "parse_rfc822",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN epoch_us(o_orderdate) WHEN 1 THEN epoch_us(o_orderdate)
       WHEN 2 THEN epoch_us(o_orderdate) + 25200000000 WHEN 3 THEN epoch_us(o_orderdate) + 18000000000
       ELSE NULL END AS micros FROM orders""",
)
def _(spark, d):
    stamp = F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss")
    kind = F.col("o_orderkey") % 5
    text = (
        F.when(kind == 0, F.concat(stamp, F.lit(" +0000")))
        .when(kind == 1, stamp)
        .when(kind == 2, F.concat(stamp, F.lit(" -0700")))
        .when(kind == 3, F.concat(F.date_format("o_orderdate", "d MMM yyyy HH:mm"), F.lit(" EST")))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    )
    return table(spark, d, "orders").select("o_orderkey", _micros(dt.parse_rfc822(text)))


@query(
    "epoch_units",
    """SELECT event_id, CASE WHEN event_id % 10 = 9 THEN NULL ELSE epoch_us(date_trunc('second', ts)) END AS from_seconds,
       epoch_us(date_trunc('millisecond', ts)) AS from_millis FROM events""",
)
def _(spark, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = F.when(F.col("event_id") % 10 == 9, "soon").otherwise(
        F.floor(micros / 1_000_000).cast("string")
    )
    millis = F.floor(micros / 1000)
    return table(spark, d, "events").select(
        "event_id",
        F.unix_micros(dt.parse_epoch(seconds)).alias("from_seconds"),
        F.unix_micros(dt.parse_epoch(millis, milliseconds=True)).alias("from_millis"),
    )


@query(
    "space_utc",
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE epoch_us(date_trunc('second', ts)) END AS micros
       FROM events""",
)
def _(spark, d):
    kind = F.col("event_id") % 4
    plain = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = (
        F.when(kind == 0, F.concat(plain, F.lit(" UTC")))
        .when(kind == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(kind == 2, F.concat(F.lit(" "), plain))
        .otherwise("UTC")
    )
    return table(spark, d, "events").select("event_id", _micros(dt.parse_space_utc(text)))


@query(
    "age_days",
    """SELECT o_orderkey, round(greatest(0.0, (epoch_us(TIMESTAMP '2001-01-01 06:00:00') - epoch_us(o_orderdate))
       / 86400000000.0::DOUBLE), 6) AS age FROM orders""",
)
def _(spark, d):
    age = dt.age_days(F.col("o_orderdate").cast("timestamp"), dt.utc_timestamp("2001-01-01T06:00:00Z"))
    return table(spark, d, "orders").select("o_orderkey", F.round(age, 6).alias("age"))


# --- labels -------------------------------------------------------------------------

_SQL_PERIOD = "CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' (' || lower(p_type) || ')' END"


@query(
    "salary_range",
    f"""WITH b AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size * 1000 END::BIGINT AS lo,
          CASE WHEN p_partkey % 10 = 0 THEN 0 WHEN p_partkey % 7 = 0 THEN p_size * 1000 ELSE trunc(p_retailprice * 90) END::BIGINT AS hi,
          CASE p_partkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE '' END AS cur FROM part),
      f AS (SELECT *, CASE WHEN cur = 'USD' THEN '$' ELSE '' END AS pre,
                      CASE WHEN cur = 'EUR' THEN ' EUR' ELSE '' END AS suf FROM b)
      SELECT p_partkey, CASE WHEN lo = 0 AND hi = 0 THEN NULL ELSE
        CASE WHEN lo <> 0 AND hi <> 0 AND lo <> hi
             THEN pre || format('{{:,}}', lo) || ' - ' || pre || format('{{:,}}', hi)
             ELSE pre || format('{{:,}}', CASE WHEN lo <> 0 THEN lo ELSE hi END) END || suf || {_SQL_PERIOD} END AS salary
      FROM f""",
)
def _(spark, d):
    key = F.col("p_partkey")
    low = F.when(key % 5 == 0, 0).otherwise(F.col("p_size") * 1000)
    high = F.when(key % 10 == 0, 0.0).when(key % 7 == 0, F.col("p_size") * 1000.0).otherwise(F.col("p_retailprice") * 90)
    currency = F.when(key % 3 == 0, "USD").when(key % 3 == 1, "EUR")
    period = F.when(key % 2 == 0, F.lit(None)).otherwise(F.lower("p_type"))
    return table(spark, d, "part").select("p_partkey", lb.salary_range(low, high, currency, period).alias("salary"))


@query(
    "location_allow_list",
    """WITH b AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN [n_name, 'Worldwide'] WHEN 1 THEN [n_name, ' ']
         WHEN 2 THEN [n_name, r_name] ELSE ['', NULL] END AS places
         FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
       k AS (SELECT s_suppkey, list_filter(list_transform(places, lambda x: trim(x)), lambda x: x <> '') AS ps FROM b)
       SELECT s_suppkey, CASE WHEN len(ps) = 0 THEN NULL WHEN s_suppkey % 4 = 0 THEN array_to_string(ps, ', ')
         ELSE array_to_string(ps, ', ') || ' only' END AS place FROM k""",
)
def _(spark, d):
    places = (
        table(spark, d, "supplier")
        .join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    kind = F.col("s_suppkey") % 4
    listed = (
        F.when(kind == 0, F.array("n_name", F.lit("Worldwide")))
        .when(kind == 1, F.array("n_name", F.lit(" ")))
        .when(kind == 2, F.array("n_name", "r_name"))
        .otherwise(F.array(F.lit(""), F.lit(None).cast("string")))
    )
    return places.select("s_suppkey", lb.location_allow_list(listed).alias("place"))


_LABELS = ["Full-Time", "B2B contract (six months)", "fixed term, parttime", "", "Werkstudent/in", "ask us"]
_SQL_LABEL = "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_LABELS)) + " END"


def _sql_contract(x: str, freelance: list[str], employment: list[str]) -> str:
    norm = sql_norm(x)
    some = lambda words: "(" + " OR ".join(f"contains({norm}, '{w}')" for w in words) + ")"
    return f"CASE WHEN {some(freelance)} THEN 'freelance' WHEN {some(employment)} THEN 'employment' ELSE 'unclear' END"


_SQL_FIXED = _sql_contract(_SQL_LABEL, ["contract", "freelance", "fixed term"], ["full time", "parttime", "werkstudent"])
_SQL_PRIORITY = _sql_contract("o_orderpriority", ["urgent", "high"], ["low", "medium"])


@query(
    "contract_label",
    f"""SELECT o_orderkey, {_SQL_FIXED} AS fixed, {_SQL_PRIORITY} AS by_priority,
        CASE WHEN {_SQL_FIXED} <> 'unclear' THEN {_SQL_FIXED} ELSE CASE WHEN o_orderstatus = 'F' THEN 'freelance'
        ELSE 'unclear' END END AS first_of FROM orders""",
)
def _(spark, d):
    label = F.when(F.col("o_orderkey") % 6 == 0, _LABELS[0])
    for i, value in enumerate(_LABELS[1:], 1):
        label = label.when(F.col("o_orderkey") % 6 == i, value)
    second = F.when(F.col("o_orderstatus") == "F", "Freelancer").otherwise("n/a")
    return table(spark, d, "orders").select(
        "o_orderkey",
        lb.contract_from_label(label).alias("fixed"),
        lb.contract_from_label(
            F.col("o_orderpriority"), freelance=["urgent", "high"], employment=["low", "medium"]
        ).alias("by_priority"),
        lb.contract_from_labels(F.array(label, second)).alias("first_of"),
    )


_SQL_RAW = f"CASE doc_id % 4 WHEN 0 THEN source || ': ' || {SQL_TITLE} WHEN 1 THEN {SQL_TITLE} WHEN 2 THEN ' : ' || lang ELSE lang || ': a: b' END"


@query(
    "split_company_title",
    f"""WITH b AS (SELECT doc_id, {_SQL_RAW} AS raw FROM documents),
      p AS (SELECT doc_id, raw, strpos(raw, ': ') AS colon FROM b),
      q AS (SELECT *, {sql_strip('left(raw, colon - 1)')} AS c, {sql_strip('substr(raw, colon + 2)')} AS r FROM p)
      SELECT doc_id, CASE WHEN colon > 0 AND c <> '' AND r <> '' THEN c ELSE '(company not stated)' END AS company,
             CASE WHEN colon > 0 AND c <> '' AND r <> '' THEN r ELSE raw END AS title FROM q""",
)
def _(spark, d):
    kind = F.col("doc_id") % 4
    raw = (
        F.when(kind == 0, F.concat("source", F.lit(": "), title_of()))
        .when(kind == 1, title_of())
        .when(kind == 2, F.concat(F.lit(" : "), "lang"))
        .otherwise(F.concat("lang", F.lit(": a: b")))
    )
    return (
        table(spark, d, "documents")
        .select("doc_id", lb.split_company_title(raw).alias("p"))
        .select("doc_id", "p.company", "p.title")
    )


@query(
    "sections_join",
    f"""SELECT conv_id, turn, array_to_string(list_filter([role || chr(10) || text, CASE WHEN turn % 2 = 0 THEN 'Turn' || chr(10) || turn ELSE turn::VARCHAR END,
        CASE WHEN turn % 3 = 0 THEN NULL ELSE '  ' END], lambda s: s IS NOT NULL AND trim(s) <> ''), chr(10) || chr(10)) AS body
        FROM conversations WHERE text <> ''""",
)
def _(spark, d):
    turn = F.col("turn").cast("string")
    sections = F.array(
        t.headed_section(F.concat(F.lit(" "), "role"), F.col("text")),
        t.headed_section(F.when(F.col("turn") % 2 == 0, "Turn"), turn),
        t.headed_section(F.lit(""), F.when(F.col("turn") % 3 == 0, "").otherwise("  ")),
    )
    rows = table(spark, d, "conversations").filter(F.col("text") != "")
    return rows.select("conv_id", "turn", t.join_sections(sections).alias("body"))


@query(
    "channel",
    f"""WITH b AS (SELECT doc_id, doc_id % 3 = 0 AS has_url, {SQL_EMAIL} AS email FROM documents)
      SELECT doc_id, CASE WHEN has_url THEN 'url' WHEN email IS NOT NULL THEN 'email' ELSE 'unknown' END AS url_first,
             CASE WHEN email IS NOT NULL THEN 'email' WHEN has_url THEN 'url' ELSE 'unknown' END AS email_first FROM b""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", (F.col("doc_id") % 3 == 0).alias("has_url"), u.extract_email(F.col("text")).alias("email")
    )
    return docs.select(
        "doc_id",
        u.application_channel(F.col("has_url"), F.col("email")).alias("url_first"),
        u.application_channel(F.col("has_url"), F.col("email"), email_first=True).alias("email_first"),
    )


@query(
    "commute_location",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority || ', ' END
       || CASE WHEN o_orderstatus = 'F' THEN 'Remote' ELSE 'vor Ort' END AS place FROM orders""",
)
def _(spark, d):
    place = F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select(
        "o_orderkey", lb.commute_location(place, F.col("o_orderstatus") == "F").alias("place")
    )


@query(
    "bucket_confidence",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 60 WHEN 2 THEN 0 ELSE 50 END AS confidence
       FROM orders""",
)
def _(spark, d):
    kind = F.col("o_orderkey") % 4
    bucket = F.when(kind == 0, "eligible").when(kind == 1, "needs_review").when(kind == 2, "excluded")
    return table(spark, d, "orders").select(
        "o_orderkey", lb.bucket_confidence(bucket.otherwise("other")).alias("confidence")
    )


# --- JSON edges ----------------------------------------------------------------------


@query(
    "json_round_trip",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       '["' || event_type || '","' || json_extract_string(props, '$.k') || '"]' AS packed, 2 AS members,
       event_type AS first_member FROM events""",
)
def _(spark, d):
    events = table(spark, d, "events").withColumn("p", F.from_json("props", "k string"))
    packed = events.withColumn("packed", F.to_json(F.array("event_type", "p.k")))
    back = packed.withColumn("tags", F.from_json("packed", "array<string>"))
    return back.select(
        "event_id",
        F.col("p.k").cast("bigint").alias("k"),
        "packed",
        F.size("tags").alias("members"),
        F.get("tags", F.lit(0)).alias("first_member"),
    )
