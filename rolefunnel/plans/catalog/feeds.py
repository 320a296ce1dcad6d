"""Feeds and threads: tables packed as the payloads a source would land, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolefunnel.plans.catalog.base import query, table
from rolefunnel.sources import feeds as fd
from rolefunnel.sources import threads as th
from rolefunnel.sources.landing import page_report, reached_items
from rolefunnel.sources.quarantine import JSON_FEEDS, outcome, split_feed
from rolefunnel.sources.registry import expand_boards, link_boards, union_sources


def _pack(rows, page, order, item, wrap=None, notice=False):
    """(page, payload): items of a page as one JSON text; pages are small by construction."""
    packed = rows.groupBy(page.cast("bigint").alias("page")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), item.alias("i")))), lambda x: x["i"]).alias("items")
    )
    body = F.to_json("items")
    if notice:
        body = F.concat(F.lit('[{"legal":"notice"},'), F.substr(body, F.lit(2)))
    elif wrap:
        body = F.concat(F.lit(f'{{"{wrap}":'), body, F.lit("}"))
    return packed.select("page", body.alias("payload"))


def _micros(name="posted_date"):
    return F.unix_micros(name).alias("posted")


@query(
    "src_header_array",
    """SELECT p_partkey::VARCHAR AS source_id, p_name AS title, p_brand AS company, p_type AS description,
      CASE WHEN p_partkey % 9 = 0 THEN 'https://remoteok.com/remote-jobs/' ELSE 'https://remoteok.com/l/' || p_partkey END AS url,
      epoch_us(TIMESTAMP '2024-01-01') + p_partkey * 3600000000 AS posted,
      CASE WHEN p_size = 1 THEN NULL ELSE '$' || format('{:,}', (p_size - 1) * 1000) || ' - $' || format('{:,}', p_size * 2000) END AS salary,
      array_to_string([p_type] || CASE WHEN p_partkey % 4 = 0 THEN ['full time'] ELSE [] END, ',') AS tags,
      CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'Berlin' END AS place, 'url' AS channel
      FROM part WHERE NOT (p_partkey % 18 = 0) AND p_partkey % 8 <> 0""",
)
def _(spark, d):
    key = F.col("p_partkey")
    item = F.struct(
        key.alias("id"),
        F.when(key % 6 == 0, " ").otherwise(F.col("p_name")).alias("slug"),
        F.col("p_name").alias("position"),
        F.col("p_brand").alias("company"),
        F.concat(F.lit("<p>"), "p_type", F.lit("</p>")).alias("description"),
        F.when(key % 9 == 0, "https://remoteok.com/remote-jobs/")
        .otherwise(F.concat(F.lit("https://remoteok.com/l/"), key.cast("string")))
        .alias("url"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + key * 3600), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("date"),
        F.when(F.col("p_size") == 1, 0).otherwise((F.col("p_size") - 1) * 1000).alias("salary_min"),
        F.when(F.col("p_size") == 1, 0).otherwise(F.col("p_size") * 2000).alias("salary_max"),
        F.array_compact(
            F.array("p_type", F.when(key % 4 == 0, "full time"), F.when(key % 8 == 0, "part time"))
        ).alias("tags"),
        F.when(key % 3 == 0, " ").otherwise(" Berlin ").alias("location"),
    )
    landed = _pack(table(spark, d, "part"), F.floor(key / 50), key, item, notice=True)
    return fd.remoteok(landed).select(
        "source_id", "title", "company", "description", "url", _micros(), F.col("salary_text").alias("salary"),
        F.array_join("tags", ",").alias("tags"), F.col("location_text").alias("place"),
        F.col("application_channel").alias("channel"),
    )


@query(
    "src_wrapped",
    """SELECT s_suppkey::VARCHAR AS source_id, s_name AS title, n_name AS company, 'A' || chr(10) || 'mail: a@b.example' AS description,
       CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'https://remotive.example/' || s_suppkey END AS url,
       CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE '$' || s_suppkey END AS salary,
       CASE WHEN s_suppkey % 4 = 0 THEN 'email' ELSE 'url' END AS channel,
       epoch_us(TIMESTAMP '2024-01-01 10:30:00') AS posted FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 10 <> 9""",
)
def _(spark, d):
    key = F.col("s_suppkey")
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    item = F.struct(
        key.alias("id"),
        F.when(key % 10 != 9, F.col("s_name")).alias("title"),
        F.col("n_name").alias("company_name"),
        F.lit("<li>A</li><li>mail: a@b.example</li>").alias("description"),
        F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("https://remotive.example/"), key.cast("string"))).alias("url"),
        F.lit("2024-01-01T10:30:00").alias("publication_date"),
        F.when(key % 2 == 0, "  ").otherwise(F.concat(F.lit("$"), key.cast("string"))).alias("salary"),
        F.array("n_name").alias("tags"),
    )
    landed = _pack(rows, F.floor(key / 40), key, item, wrap="jobs")
    return fd.remotive(landed).select(
        "source_id", "title", "company", "description", "url", F.col("salary_text").alias("salary"),
        F.col("application_channel").alias("channel"), _micros(),
    )


@query(
    "src_paged",
    """WITH r AS (SELECT event_id, user_id, event_type, value, event_id // 20 AS page, 'https://himalayas.example/' || user_id || '/' || event_type AS url,
               epoch_us(date_trunc('second', ts)) AS posted FROM events WHERE event_id % 13 <> 0)
    SELECT url, event_type AS title, CASE WHEN user_id % 5 = 0 THEN 'Unknown' ELSE 'user ' || user_id END AS company,
       CASE WHEN event_id % 2 = 0 THEN 'short' ELSE 'long text' END AS description, posted,
       CASE WHEN event_id % 3 = 0 THEN 'Anywhere' ELSE 'DE, FR only' END AS place, 'cat,' || event_type || ',senior' AS tags,
       CASE event_type WHEN 'click' THEN 'freelance' WHEN 'view' THEN 'employment' ELSE 'unclear' END AS contract
    FROM r QUALIFY row_number() OVER (PARTITION BY url ORDER BY event_id) = 1""",
)
def _(spark, d):
    """All pages are full but the last, so every page is read; repeats across pages are dropped."""
    key = F.col("event_id")
    guid = F.concat(F.lit("https://himalayas.example/"), F.col("user_id").cast("string"), F.lit("/"), "event_type")
    item = F.struct(
        F.when(key % 13 == 0, " ").otherwise(F.concat(F.lit(" "), "event_type")).alias("title"),
        F.lit("short").alias("excerpt"),
        F.when(F.col("user_id") % 5 == 0, "").otherwise(F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("companyName"),
        F.when(F.col("event_type") == "click", "Contractor").when(F.col("event_type") == "view", "Full Time").otherwise("Other").alias("employmentType"),
        F.array(F.lit("senior")).alias("seniority"),
        F.when(key % 3 == 0, F.array(F.lit("Anywhere"))).otherwise(F.array(F.lit("DE"), F.lit("FR"))).alias("locationRestrictions"),
        F.array(F.lit("cat"), F.col("event_type")).alias("categories"),
        F.when(key % 2 == 0, "<div></div>").otherwise("<div>long</div> text").alias("description"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("pubDate"),
        F.lit("https://elsewhere.example").alias("applicationLink"),
        guid.alias("guid"),
    )
    landed = _pack(table(spark, d, "events"), F.floor(key / 20), key, item, wrap="jobs")
    return fd.himalayas(landed).select(
        "url", "title", "company", F.replace("description", F.lit("\n"), F.lit(" ")).alias("description"), _micros(),
        F.col("location_text").alias("place"), F.array_join("tags", ",").alias("tags"),
        F.col("contract_type_guess").alias("contract"),
    )


@query(
    "src_capped",
    """SELECT p_partkey::VARCHAR AS source_id, p_name || ' & co' AS title, CASE WHEN p_partkey % 7 = 0 THEN 'Unknown' ELSE '<' || p_brand || '>' END AS company,
       'R&D' || CASE WHEN p_partkey % 2 = 0 THEN ',Senior' ELSE '' END AS tags,
       CASE WHEN p_partkey % 3 = 0 THEN p_type || ' only' END AS place,
       format('{:,}', p_size * 1000) || ' EUR (yearly)' AS salary,
       CASE WHEN p_partkey % 5 = 0 THEN 'employment' ELSE 'unclear' END AS contract FROM part WHERE p_partkey % 11 <> 0""",
)
def _(spark, d):
    key = F.col("p_partkey")
    item = F.struct(
        key.alias("id"),
        F.when(key % 11 == 0, "").otherwise(F.concat(F.lit("https://jobicy.example/"), key.cast("string"))).alias("url"),
        F.concat("p_name", F.lit(" &amp; co")).alias("jobTitle"),
        F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("&lt;"), "p_brand", F.lit("&gt;"))).alias("companyName"),
        F.array(F.lit("R&amp;D")).alias("jobIndustry"),
        F.array(F.lit("n/a"), F.when(key % 5 == 0, "Full-Time").otherwise("?")).alias("jobType"),
        F.when(key % 3 == 0, F.col("p_type")).alias("jobGeo"),
        F.when(key % 2 == 0, "Senior").otherwise(" ").alias("jobLevel"),
        F.lit("2024-01-01 10:00:00").alias("pubDate"),
        (F.col("p_size") * 1000).alias("salaryMin"),
        F.lit("EUR").alias("salaryCurrency"),
        F.lit("yearly").alias("salaryPeriod"),
    )
    landed = _pack(table(spark, d, "part"), F.floor(key / 100), key, item, wrap="jobs")
    return fd.jobicy(landed).select(
        "source_id", "title", "company", F.array_join("tags", ",").alias("tags"), F.col("location_text").alias("place"),
        F.col("salary_text").alias("salary"), F.col("contract_type_guess").alias("contract"),
    )


@query(
    "src_rss",
    """WITH r AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate, o_orderkey % 3 AS feed, 'https://wwr.example/' || o_custkey AS url
                FROM orders WHERE o_orderkey % 10 <> 9)
    SELECT url, CASE WHEN o_orderkey % 4 = 0 THEN '(company not stated)' ELSE 'Cust ' || o_custkey END AS company,
       CASE WHEN o_orderkey % 4 = 0 THEN 'Role ' || o_orderkey ELSE 'Role: ' || o_orderkey END AS title,
       epoch_us(o_orderdate) AS posted, CASE WHEN o_orderstatus = 'F' THEN 'Europe, DE' ELSE 'DE' END AS place, o_orderpriority AS tags
    FROM r QUALIFY row_number() OVER (PARTITION BY url ORDER BY feed, o_orderkey) = 1""",
)
def _(spark, d):
    key = F.col("o_orderkey")

    def tag(name, value):
        return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))

    cust = F.col("o_custkey").cast("string")
    title = F.when(key % 10 == 9, " ").when(key % 4 == 0, F.concat(F.lit("Role "), key.cast("string"))).otherwise(
        F.concat(F.lit("Cust "), cust, F.lit(": Role: "), key.cast("string"))
    )
    item = F.concat(
        F.lit("<item>"),
        tag("title", title),
        tag("region", F.when(F.col("o_orderstatus") == "F", "Europe").otherwise("")),
        tag("country", F.lit(" DE ")),
        tag("category", F.col("o_orderpriority")),
        tag("skills", F.lit("")),
        tag("pubDate", F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss +0000")),
        tag("guid", F.concat(F.lit("https://wwr.example/"), cust)),
        F.lit("</item>"),
    )
    # A feed file per hundred orders of one feed number; the page orders feeds first.
    page = (key % 3) * 1_000_000 + F.floor(key / 300)
    files = table(spark, d, "orders").groupBy(page.cast("bigint").alias("page")).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct(key.alias("k"), item.alias("i")))), lambda x: x["i"]), ""
        ).alias("items")
    )
    landed = files.select(
        "page", F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("payload")
    )
    return fd.weworkremotely(landed).select(
        "url", "company", "title", _micros(), F.col("location_text").alias("place"), F.array_join("tags", ",").alias("tags")
    )


@query(
    "src_page_number",
    """WITH r AS (SELECT *, 'slug-' || user_id || '-' || event_type AS slug FROM events)
    SELECT slug AS source_id, 'T ' || event_type AS title, epoch_us(date_trunc('second', ts)) AS posted,
      CASE WHEN user_id % 2 = 0 THEN 'Berlin, ' ELSE '' END || CASE WHEN event_type = 'view' THEN 'Remote' ELSE 'vor Ort' END AS place,
      CASE WHEN event_type = 'click' THEN 'employment' ELSE 'unclear' END AS contract
    FROM r QUALIFY row_number() OVER (PARTITION BY slug ORDER BY event_id) = 1""",
)
def _(spark, d):
    key = F.col("event_id")
    item = F.struct(
        F.concat(F.lit("slug-"), F.col("user_id").cast("string"), F.lit("-"), "event_type").alias("slug"),
        F.lit("co").alias("company_name"),
        F.concat(F.lit("T "), "event_type").alias("title"),
        F.lit("<p>x</p>").alias("description"),
        (F.col("event_type") == "view").alias("remote"),
        F.concat(F.lit("https://arbeitnow.example/"), key.cast("string")).alias("url"),
        F.array(F.lit("t")).alias("tags"),
        F.array(F.lit("berufserfahren"), F.when(F.col("event_type") == "click", "Full-Time").otherwise("-")).alias("job_types"),
        F.when(F.col("user_id") % 2 == 0, "Berlin").otherwise("").alias("location"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("created_at"),
    )
    landed = _pack(table(spark, d, "events"), F.floor(key / 100) + 1, key, item, wrap="data")
    return fd.arbeitnow(landed).select(
        "source_id", "title", _micros(), F.col("location_text").alias("place"), F.col("contract_type_guess").alias("contract")
    )


@query(
    "page_window",
    """WITH s AS (SELECT o_custkey AS page, count(*) AS n FROM orders GROUP BY 1),
       r AS (SELECT 0 AS page UNION ALL SELECT page + 1 FROM s WHERE n >= 3 AND page >= 0),
       g AS (SELECT min(page) AS stop FROM r WHERE page NOT IN (SELECT page FROM s WHERE n >= 3 AND page IS NOT NULL))
       SELECT o_orderkey, o_custkey AS page, s.n, s.n < 10 AS short, b.page IS NULL AND s.page > 0 AS gap,
              coalesce(o_custkey BETWEEN 0 AND stop, false) AS read
       FROM orders JOIN s ON s.page IS NOT DISTINCT FROM o_custkey LEFT JOIN s b ON b.page = s.page - 1, g""",
)
def _(spark, d):
    """Every order as an item, customers as pages: is its page short, does it follow a hole, and does a reader that ends at the first short page get there."""
    items = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("page"))
    report = page_report(items, F.lit(1), page_size=10).withColumnRenamed("page", "_page")
    rows = reached_items(items, F.lit(1), page_size=3).join(report, F.col("page").eqNullSafe(F.col("_page")))
    return rows.select("o_orderkey", "page", "n", "short", "gap", "read")


@query(
    "junk_filters",
    """SELECT p_partkey, p_partkey % 6 = 0 AND p_partkey % 4 = 0 AS junk, p_partkey % 5 = 0 AS contradictory FROM part""",
)
def _(spark, d):
    key = F.col("p_partkey")
    slug = F.when(key % 6 == 0, F.when(key % 12 == 0, " ")).otherwise(F.col("p_name"))
    url = F.when(key % 4 == 0, "HTTPS://www.remoteok.com/remote-jobs").otherwise("https://remoteok.com/remote-jobs/1")
    tags = F.when(key % 5 == 0, F.array(F.lit("part time"), F.lit("x"), F.lit("full time"))).otherwise(
        F.array(F.lit("full time"))
    )
    return table(spark, d, "part").select(
        "p_partkey", fd.is_junk_entry(slug, url).alias("junk"), fd.has_contradictory_tags(tags).alias("contradictory")
    )


# --- the union of sources -------------------------------------------------------------------------


@query(
    "union_enabled_sources",
    """SELECT 'remotive' AS source, s_suppkey::VARCHAR AS source_id, s_name AS title, 'https://remotive.example/' || s_suppkey AS url FROM supplier
    UNION ALL SELECT 'remoteok', p_partkey::VARCHAR, p_name, 'https://remoteok.com/l/' || p_partkey FROM part
    UNION ALL SELECT 'arbeitnow', slug, title, 'https://a.example/' || slug FROM (SELECT 'c' || c_custkey AS slug, c_name AS title FROM customer)""",
)
def _(spark, d):
    """Suppliers, parts, customers and orders as four feeds, read through the registry; the feed of orders is switched off."""
    text = lambda c: F.col(c).cast("string")
    link = lambda base, c: F.concat(F.lit(base), text(c)).alias("url")

    def landed(name, key, *fields, **wrap):
        return _pack(table(spark, d, name), F.floor(F.col(key) / 50), F.col(key), F.struct(*fields), **wrap)

    feeds = {
        "remotive": landed("supplier", "s_suppkey", F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.lit("c").alias("company_name"),
                           link("https://remotive.example/", "s_suppkey"), wrap="jobs"),
        "remoteok": landed("part", "p_partkey", F.col("p_partkey").alias("id"), F.lit("s").alias("slug"), F.col("p_name").alias("position"), F.lit("c").alias("company"),
                           link("https://remoteok.com/l/", "p_partkey"), notice=True),
        "arbeitnow": landed("customer", "c_custkey", F.concat(F.lit("c"), text("c_custkey")).alias("slug"), F.col("c_name").alias("title"), F.lit("c").alias("company_name"),
                            link("https://a.example/c", "c_custkey"), wrap="data"),
        "himalayas": landed("orders", "o_orderkey", text("o_orderkey").alias("title"), link("https://h.example/", "o_orderkey").alias("guid"), wrap="jobs"),
    }
    return union_sources(feeds, {"himalayas": False}).select("source", "source_id", "title", "url")


# --- what cannot be read -----------------------------------------------------------------------


def _spoiled(spark, d, feed):
    """Orders as items of a feed, twenty to a page: some items and some payloads are not what they should be."""
    _, member, required = JSON_FEEDS[feed]
    key, page = F.col("o_orderkey"), F.expr("o_orderkey div 20")
    fields = lambda names: ", ".join(f'"{n}": "v"' for n in names)
    item = (
        F.when(key % 11 == 3, "7")
        .when(key % 11 == 5, f"{{{fields(required[1:])}}}")
        .when(key % 11 == 7, f'{{{fields(required[1:])}{", " if required[1:] else ""}"{required[0]}": ["x"]}}')
        .otherwise(f"{{{fields(required)}}}")
    )
    rows = table(spark, d, "orders").groupBy(page.alias("page")).agg(F.concat_ws(", ", F.collect_list(item)).alias("items"))
    body = F.concat(F.lit('[{"legal": "notice"}, '), "items", F.lit("]")) if member is None else F.concat(F.lit(f'{{"{member}": ['), "items", F.lit("]}"))
    payload = F.when(F.col("page") % 9 == 4, "not json {").when(F.col("page") % 9 == 6, '{"other": []}').when(F.col("page") % 9 == 8, " ").otherwise(body)
    return rows.select("page", payload.alias("payload"))


_SQL_FEEDS = ", ".join(
    f"('{name}', '{required[0]}', '{'payload is no array' if member is None else f'payload has no array {member}'}')" for name, (_, member, required) in JSON_FEEDS.items()
)


@query(
    "landed_quarantine",
    f"""WITH f(feed, field, shape) AS (VALUES {_SQL_FEEDS}),
    o AS (SELECT o_orderkey // 20 AS page, o_orderkey % 11 AS k FROM orders),
    p AS (SELECT DISTINCT page, CASE page % 9 WHEN 4 THEN 'payload is no JSON' WHEN 6 THEN 'shape' WHEN 8 THEN 'payload is empty' END AS reason FROM o),
    i AS (SELECT CASE k WHEN 3 THEN 'item is no object' WHEN 5 THEN 'missing' WHEN 7 THEN 'type' ELSE 'read' END AS reason FROM o WHERE page % 9 NOT IN (4, 6, 8)),
    r AS (SELECT reason FROM p WHERE reason IS NOT NULL UNION ALL SELECT reason FROM i)
    SELECT feed, CASE reason WHEN 'shape' THEN shape WHEN 'missing' THEN 'field ' || field || ' is missing' WHEN 'type' THEN 'field ' || field || ' is no string' ELSE reason END AS reason,
           count(*) AS n FROM r, f GROUP BY 1, 2""",
)
def _(spark, d):
    """Items read and rejected of every JSON feed, by reason."""
    parts = [outcome(*split_feed(_spoiled(spark, d, feed), feed)).select(F.lit(feed).alias("feed"), "reason", "n") for feed in JSON_FEEDS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- threads: a conversation is a thread, its turns are the comments ------------------------


def _threads(spark, d, marker=False):
    """Threads with a title by conversation; some comments are gone, some present themselves."""
    turn, conv = F.col("turn"), F.col("conv_id")
    whole = F.replace("text", F.lit("\n"), F.lit("<p>"))
    lead = F.when(turn % 3 == 0, "SEEKING FREELANCER | ").when(turn % 3 == 1, "Seeking freelancers - ").otherwise("")
    body = F.concat(
        lead if marker else F.lit(""),
        F.lit("Co "), conv.cast("string"), F.lit(" | Remote | "),
        F.when(turn % 2 == 0, "Role of the turn").otherwise("$100k"),
        F.lit("<p>"),
        F.when(turn % 4 == 3, "Willing to relocate: yes. ").otherwise(""),
        whole,
        F.when(turn % 3 == 2, F.concat(F.lit(" jobs@co"), conv.cast("string"), F.lit(".example"))).otherwise(""),
        F.when(turn % 4 == 1, F.concat(F.lit("<p>Apply: https://co.example/jobs/"), turn.cast("string"), F.lit("."))).otherwise(""),
    )
    comment = F.struct(
        (conv * 1000 + turn).alias("id"),
        F.when(turn % 7 == 6, "").otherwise(body).alias("text"),
        F.lit("2024-01-01T00:00:00.000Z").alias("created_at"),
        (turn % 5 == 4).alias("deleted"),
        F.lit(None).cast("boolean").alias("dead"),
    )
    title = F.when(conv % 4 == 0, "Ask HN: Who is hiring? (May)").when(
        conv % 4 == 1, "Ask HN: Freelancer? Seeking freelancer? (May)"
    ).otherwise("Ask HN: Who wants to be hired? Not who is hiring")
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(turn.alias("t"), comment.alias("c")))), lambda x: x["c"]).alias("children")
    ).select(
        F.col("conv_id").cast("string").alias("id"),
        title.alias("title"),
        F.lpad(F.col("conv_id").cast("string"), 12, "0").alias("created_at"),
        "children",
    )


def _sql_thread(marker: bool) -> str:
    accept = "turn % 3 IN (0, 1)" if marker else "turn % 4 <> 3"
    return f"""WITH c AS (SELECT *, conv_id * 1000 + turn AS cid FROM conversations WHERE turn % 7 <> 6 AND turn % 5 <> 4 AND {accept})
    SELECT conv_id, cid::VARCHAR AS source_id, 'Co ' || conv_id AS company,
      CASE WHEN turn % 2 = 0 THEN 'Role of the turn' ELSE 'Role not stated in header — see description' END AS title,
      CASE WHEN turn % 4 = 1 THEN 'https://co.example/jobs/' || turn ELSE 'https://news.ycombinator.com/item?id=' || cid END AS url,
      CASE WHEN turn % 3 = 2 OR regexp_matches(text, '[\\w.+-]+@[\\w-]+\\.[\\w.-]+') THEN 'email' WHEN turn % 4 = 1 THEN 'url' ELSE 'unknown' END AS channel FROM c"""


def _comment_view(spark, d, kind, marker):
    comments = th.top_level_comments(_threads(spark, d, marker))
    return th.comment_postings(comments, kind, 2).select(
        F.floor(F.col("source_id").cast("bigint") / 1000).alias("conv_id"),
        "source_id", "company", "title", "url", F.col("application_channel").alias("channel"),
    )


@query("src_thread", _sql_thread(False))
def _(spark, d):
    """Comments of every conversation, as one thread each."""
    return _comment_view(spark, d, th.HIRING, False)


@query("src_thread_marker", _sql_thread(True))
def _(spark, d):
    return _comment_view(spark, d, th.FREELANCE, True)


def _flat_thread(spark, d):
    """(stories, comments): three stories, every turn a comment of one of them or a reply; links to boards and lists of roles."""
    turn, conv = F.col("turn"), F.col("conv_id")
    key = conv * 16 + turn
    n = key.cast("string")
    board = F.concat(F.lit("https://jobs.lever.co/co"), (conv % 5).cast("string"))
    roles = F.concat(F.lit("- Role A: https://x.example/jobs/a"), n, F.lit("<p>- Role B: https://x.example/jobs/b"), n)
    body = F.when(turn % 4 == 1, board).when(turn % 4 == 2, roles).otherwise(F.replace("text", F.lit("\n"), F.lit("<p>")))
    comments = table(spark, d, "conversations").select(
        key.alias("id"),
        F.when(turn % 6 == 5, key - 1).otherwise(conv % 3).cast("string").alias("parent"),
        key.alias("pos"),
        F.concat(F.lit("Co "), conv.cast("string"), F.lit(" | Dev<p>"), body).alias("text"),
        F.lit("2024-01-01T00:00:00.000Z").alias("created_at"),
        (turn % 5 == 4).alias("deleted"),
        F.lit(None).cast("boolean").alias("dead"),
    )
    titles = [("0", "Ask HN: Who is hiring? (May)", "1"), ("1", "Ask HN: Freelancer? Seeking freelancer?", "3"), ("2", "Ask HN: Who is hiring? (June)", "2")]
    return spark.createDataFrame(titles, "id string, title string, created_at string"), comments


@query(
    "thread_source",
    """WITH c AS (SELECT *, conv_id * 16 + turn AS id FROM conversations WHERE conv_id % 3 = 2 AND turn % 6 <> 5 AND turn % 5 <> 4)
    SELECT id || ':lever:' || r AS source_id, 'Role ' || r AS title, 'Co ' || conv_id AS company, 'https://l/' || r AS url FROM c, (VALUES ('x'), ('y')) v(r) WHERE turn % 4 = 1 AND conv_id % 5 = 0
    UNION ALL SELECT id::VARCHAR, 'Dev', 'Co ' || conv_id, 'https://jobs.lever.co/co' || conv_id % 5 FROM c WHERE turn % 4 = 1 AND conv_id % 5 <> 0
    UNION ALL SELECT id || ':bullet:' || k, 'Role ' || chr(65 + k), 'Co ' || conv_id, 'https://x.example/jobs/' || chr(97 + k) || id FROM c, (VALUES (0), (1)) v(k) WHERE turn % 4 = 2
    UNION ALL SELECT id::VARCHAR, 'Dev', 'Co ' || conv_id, 'https://news.ycombinator.com/item?id=' || id FROM c WHERE turn % 4 IN (0, 3)""",
)
def _(spark, d):
    """The newest thread, its links followed to boards, boards and lists of roles expanded; whole turns."""
    stories, comments = _flat_thread(spark, d)
    payloads = spark.createDataFrame(
        [("lever", "co0", '[{"id":"x","text":"Role x","hostedUrl":"https://l/x"},{"id":"y","text":"Role y","hostedUrl":"https://l/y"}]')],
        "platform string, board_slug string, payload string",
    )
    pages = spark.createDataFrame([], "url string, final_url string, html string")
    linked = link_boards(th.newest_from_rows(stories, comments, th.HIRING, 2), pages)
    return expand_boards(linked, payloads, pages).select("source_id", "title", "company", "url")


@query(
    "latest_thread",
    """SELECT 'hiring' AS kind, max(conv_id) AS id FROM conversations WHERE conv_id % 4 = 0
       UNION ALL SELECT 'freelance', max(conv_id) FROM conversations WHERE conv_id % 4 = 1""",
)
def _(spark, d):
    threads = _threads(spark, d)
    found = [
        th.latest_thread(threads, kind).select(F.lit(name).alias("kind"), F.col("id").cast("bigint").alias("id"))
        for name, kind in (("hiring", th.HIRING), ("freelance", th.FREELANCE))
    ]
    return found[0].unionByName(found[1])
