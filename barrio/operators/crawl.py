"""Which business websites to visit, and which paths they allow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barrio.functions.links import url_host, url_origin, url_path
from barrio.operators.serve import served
from barrio.operators.keyed import keyed_join

MAX_STORES_PER_URL = 3
MAX_AGE_DAYS = 90

# Hosts that never state a single shop's hours.
SKIPPED_HOSTS = [
    "facebook.com", "m.facebook.com", "instagram.com", "twitter.com", "x.com", "tripadvisor.com",
    "tripadvisor.es", "wa.me", "api.whatsapp.com", "t.me", "linktr.ee", "goo.gl",
    "maps.google.com", "google.com",
]


def due_for_crawl(stores: DataFrame, now, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """Served rows with a website, without mapped hours, not checked recently."""
    oldest = now - F.make_interval(days=F.lit(max_age_days))
    return served(stores).where(
        F.col("website").isNotNull()
        & F.col("opening_hours_osm").isNull()
        & (F.col("hours_web_checked_at").isNull() | (F.col("hours_web_checked_at") < oldest))
    )


def url_groups(due: DataFrame) -> DataFrame:
    """One row per website: number of rows, host, status and, for queued ones, the ids.

    Status: queued, brand (shared by more than MAX_STORES_PER_URL rows) or host (skipped). Websites are counted with
    partial sums; only the few ids of queued ones are ever gathered.
    """
    host = url_host(F.col("website"))
    status = (
        F.when(F.col("n") > MAX_STORES_PER_URL, "brand")
        .when(F.col("host").isNull() | F.col("host").isin("", *SKIPPED_HOSTS), "host")
        .otherwise("queued")
    )
    counted = due.groupBy("website").agg(F.count(F.lit(1)).alias("n"))
    groups = counted.withColumn("host", host).withColumn("status", status)
    queued = groups.where("status = 'queued'").select("website")
    ids = due.select("website", "id").join(queued, "website").groupBy("website").agg(
        F.array_sort(F.collect_list("id")).alias("ids")
    )
    return groups.join(ids, "website", "left")


def crawl_queue(groups: DataFrame, limit: int | None = None) -> DataFrame:
    """Websites to visit in order, optionally only the first ones."""
    queue = groups.where("status = 'queued'").select("website", "host", "ids").orderBy("website")
    return queue.limit(limit) if limit else queue


def robots_sections(lines: DataFrame) -> DataFrame:
    """Each rule line with the user agent above it: (origin, line_no, agent, disallow).

    A group is one robots file.
    """
    # A line is a field and a value around its first colon; the rest from a hash sign on is a comment.
    halves = F.split(F.substring_index("line", "#", 1), ":", 2)
    field, value = F.lower(F.trim(halves[0])), F.coalesce(F.trim(F.get(halves, F.lit(1))), F.lit(""))
    agent = F.when(field == "user-agent", F.lower(value))
    above = Window.partitionBy("origin").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return (
        lines.withColumn("_agent", F.nullif(agent, F.lit("")))
        .withColumn("disallow", F.when(field == "disallow", value).otherwise(""))
        .withColumn("agent", F.last("_agent", ignorenulls=True).over(above))
        .where("_agent is null and disallow <> ''")
        .select("origin", "line_no", "agent", "disallow")
    )


def applicable_rules(sections: DataFrame, bot: str) -> DataFrame:
    """Distinct disallowed prefixes that apply to everyone or to `bot`."""
    applies = (F.col("agent") == "*") | F.col("agent").contains(bot.lower())
    return sections.where(applies).select("origin", "disallow").distinct()


def robots_verdict(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct links with `allowed`; an origin without rules allows everything, a malformed link is never allowed.

    A rule can only match a link whose path begins with it, so both sides meet by origin, length and hash of that
    beginning: a link looks up one key for each rule length in use at its origin, and no list of all pairs of an
    origin's links and rules is made. Needs `url`; rules: origin, disallow.
    """
    links = urls.select("url").distinct().withColumn("origin", url_origin(F.col("url"))).withColumn(
        "path", url_path(F.col("url"))
    )
    keyed = rules.select("origin", F.length("disallow").alias("_length"), F.xxhash64("disallow").alias("_hash"), "disallow")
    lengths = keyed.select("origin", "_length").distinct()
    starts = links.join(lengths, "origin").where(F.length("path") >= F.col("_length")).withColumn(
        "_start", F.substring("path", F.lit(1), F.col("_length"))
    )
    looked_up = starts.withColumn("_hash", F.xxhash64("_start"))
    blocked = keyed_join(
        looked_up, keyed, ["origin", "_length", "_hash"], F.col("_start") == F.col("disallow"),
    ).select("url").distinct().withColumn("_blocked", F.lit(True))
    allowed = F.col("_blocked").isNull() & F.col("origin").isNotNull()
    return links.join(blocked, "url", "left").select("url", "origin", "path", allowed.alias("allowed"))
