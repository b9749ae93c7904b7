"""robots.txt: parsing to rules by host, pattern matching and the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGENT = "lectio"


def parse(files: DataFrame, agent: str = AGENT) -> DataFrame:
    """(host, allow, disallow) of files (host, content) for ``agent``.

    A section belongs to the last agent named before it. An agent matches if it is ours or a part of our name, a blank one
    too; where any matches, only such sections count, else those of ``*``. Empty patterns and comments are dropped. A file
    that could not be read (null) has no rules. Files are short; each is handled by itself.
    """
    lines = files.select("host", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("pos", "line"))
    cut = F.trim(F.regexp_replace(F.regexp_replace("line", "#.*$", ""), r"[\r\t]", " "))
    named = lines.select(
        "host",
        "pos",
        F.lower(F.trim(F.regexp_extract(cut, "^([^:]*):", 1))).alias("name"),
        F.trim(F.regexp_extract(cut, "^[^:]*:(.*)$", 1)).alias("value"),
        cut.contains(":").alias("ok"),
    ).where("ok")
    order = Window.partitionBy("host").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sections = named.withColumn("agent", F.last(F.when(F.col("name") == "user-agent", F.lower("value")), ignorenulls=True).over(order))
    ours = F.lit(agent.lower()).contains(F.col("agent"))
    rules = sections.select(
        "host",
        "name",
        "value",
        F.when(ours, "own").when(F.col("agent") == "*", "all").alias("kind"),
        F.max(ours.cast("int")).over(Window.partitionBy("host")).alias("own"),
    )
    mine = rules.where((F.col("value") != "") & (F.col("kind") == F.when(F.col("own") == 1, "own").otherwise("all")))
    grouped = mine.groupBy("host").agg(
        F.sort_array(F.collect_list(F.when(F.col("name") == "allow", F.col("value")))).alias("allow"),
        F.sort_array(F.collect_list(F.when(F.col("name") == "disallow", F.col("value")))).alias("disallow"),
    )
    none = F.array().cast("array<string>")
    return files.select("host").join(grouped, "host", "left").select("host", F.coalesce("allow", none).alias("allow"), F.coalesce("disallow", none).alias("disallow"))


def path_matches(path: Column, pattern: Column) -> Column:
    """A pattern closed by ``$`` must equal the path; one with ``*`` needs its pieces in order anywhere; else it is a
    prefix. Letter case does not count; an empty pattern matches nothing."""
    low, p = F.lower(path), F.lower(pattern)
    glob = F.concat(F.lit(r"(?s)\Q"), F.replace(p, F.lit("*"), F.lit(r"\E.*\Q")), F.lit(r"\E"))
    return (
        F.when(p == "", False)
        .when(p.endswith("$"), low == F.left(p, F.length(p) - 1))
        .when(p.contains("*"), F.rlike(low, glob))
        .otherwise(low.startswith(p))
    )


def allowed(path: Column, allow: Column, disallow: Column) -> Column:
    """The longest matching rule decides; a tie, or no match, allows. Null rules allow."""

    def longest(rules: Column) -> Column:
        hits = F.filter(rules, lambda r: path_matches(path, r))
        return F.coalesce(F.array_max(F.transform(hits, lambda r: F.length(r))), F.lit(-1))

    return longest(allow) >= longest(disallow)


def gate(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``robots_allowed``; the path alone is tested; hosts without rules allow."""
    from . import urls

    u = F.col(url)
    joined = pages.withColumn("_host", urls.host(u)).join(rules.withColumnRenamed("host", "_host"), "_host", "left")
    path = F.when(urls.part(u, 3) == "", "/").otherwise(urls.part(u, 3))
    none = F.array().cast("array<string>")
    return joined.withColumn("robots_allowed", allowed(path, F.coalesce("allow", none), F.coalesce("disallow", none))).drop("_host", "allow", "disallow")
