"""Robots rules as a relation: of the group that names the agent, the first rule whose path begins the URL's decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import origin, percent_decoded, percent_encoded

#: Fields that are rules of a group; those that name no path only keep it from being empty.
_RULES = ("allow", "disallow", "crawl-delay", "request-rate")


def parse(files: DataFrame) -> DataFrame:
    """files (origin, body) to rules (origin, group, agent, rule_no, allow, path), a row per agent and rule.

    A group is a run of user-agent lines and the rules after it, up to a blank line or the next
    run. An empty `Disallow` allows everything; a delay has no path and matches nothing; a group without any
    such line is none. Paths are percent-encoded.
    """
    out = files.select("origin", F.posexplode(F.split("body", r"\r\n|\n|\r")).alias("rule_no", "line"))
    line = F.trim(F.regexp_replace("line", "#.*", ""))
    field = F.when(F.trim("line") == "", "blank").otherwise(F.lower(F.trim(F.regexp_extract(line, r"^([^:]*):", 1))))
    out = out.withColumns({"field": field, "value": F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1))}).filter(F.col("field").isin("blank", "user-agent", *_RULES))
    w = Window.partitionBy("origin").orderBy("rule_no")
    is_agent = F.col("field") == "user-agent"
    starts = is_agent & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    out = out.withColumn("group", F.sum(starts.cast("int")).over(w))
    # what comes after a blank line, and before the next agents, belongs to nobody
    ended = F.max(F.col("field") == "blank").over(Window.partitionBy("origin", "group").orderBy("rule_no"))
    out = out.withColumn("ended", ended).filter("`group` > 0 AND NOT ended")
    agents = out.filter(is_agent).select("origin", "group", F.lower("value").alias("agent"))
    allow = (F.col("field") == "allow") | ((F.col("field") == "disallow") & (F.col("value") == ""))
    path = F.when(F.col("field").isin("allow", "disallow"), percent_encoded(percent_decoded(F.col("value"))))
    rules = out.filter(~is_agent).select("origin", "group", "rule_no", allow.alias("allow"), path.alias("path"))
    return agents.join(rules, ["origin", "group"]).select("origin", "group", "agent", "rule_no", "allow", "path")


def rules_for(rules: DataFrame, agent: str) -> DataFrame:
    """origin, rules: the agent's rules in file order as one array. The first group that names it counts, else the first for `*`."""
    name = agent.split("/")[0].strip().lower()
    of_group = rules.groupBy("origin", "group").agg(
        F.max(F.col("agent") == "*").alias("general"), F.max(F.contains(F.lit(name), F.col("agent"))).alias("named"), F.array_sort(F.collect_set(F.struct("rule_no", "allow", "path"))).alias("rules")
    )
    mine = of_group.filter("general OR named")
    return mine.groupBy("origin").agg(F.min_by("rules", F.struct("general", "group")).alias("rules"))


def allows(url: Column, rules: Column) -> Column:
    """Whether an origin's array of rules lets a URL be fetched; no rule, or none that matches, does."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[^#]*", 0), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = percent_encoded(percent_decoded(F.when(path == "", "/").otherwise(path)))
    hits = F.filter(rules, lambda r: r["path"].isNotNull() & F.startswith(path, r["path"]))
    return F.coalesce(F.get(hits, F.lit(0))["allow"], F.lit(True))


def allowed(urls: DataFrame, rules: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """urls with `can_fetch`: one join by origin, each URL against its origin's array."""
    mine = rules_for(rules, agent).withColumnsRenamed({"origin": "__origin", "rules": "__rules"})
    out = urls.join(mine, origin(F.col(url)) == F.col("__origin"), "left")
    return out.withColumn("can_fetch", allows(F.col(url), F.col("__rules"))).drop("__origin", "__rules")
