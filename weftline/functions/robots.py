"""Robots exclusion: parsing of robots.txt and the longest-match rule, as columns and for whole files."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from .urls import part


def parse(text: str | None) -> list[tuple[str, bool, str]]:
    """(agent, allow, pattern) of a robots.txt; neighbouring agent lines share the rules that follow them.

    Each agent that is named has a row that allows the empty pattern, so a group without rules is a group all the same.
    """
    out, agents, open_group = [], [], False
    for raw in (text or "").splitlines():
        key, _, value = raw.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            agents = [*agents, value.lower()] if open_group else [value.lower()]
            open_group = True
            out.append((value.lower(), True, ""))
        elif key in ("allow", "disallow"):
            open_group = False
            out += [(a, key == "allow", value) for a in agents if value]
    return list(dict.fromkeys(out))


def allowed(rules: list[tuple[str, bool, str]], agent: str, path: str) -> bool:
    """The longest pattern that matches decides, and allow wins ties; an agent's own groups replace those of "*"."""
    token = agent.partition("/")[0].lower()
    own = [r for r in rules if r[0] == token] or [r for r in rules if r[0] == "*"]
    best = (0, True)
    for _, allow, pattern in own:
        end = "$" if pattern.endswith("$") else ""
        regex = ".*".join(re.escape(x) for x in pattern.removesuffix("$").split("*")) + end
        if re.match(regex, path):
            best = max(best, (len(pattern), allow))
    return best[1]


def request_path(url: Column) -> Column:
    path, query = part(url, "path"), part(url, "query")
    return F.concat(F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


@F.pandas_udf(ArrayType(StructType([StructField("agent", StringType()), StructField("allow", BooleanType()), StructField("pattern", StringType())])))
def _parsed(text: pd.Series) -> pd.Series:
    return pd.Series([[{"agent": a, "allow": w, "pattern": p} for a, w, p in parse(t)] for t in text], dtype=object)


def rules(bodies: DataFrame) -> DataFrame:
    """(origin_host, agent, allow, pattern) of robots files (origin_host, body). A file that is missing (null) has no rules, so its origin allows all."""
    return bodies.select("origin_host", F.explode(_parsed("body")).alias("r")).select("origin_host", "r.agent", "r.allow", "r.pattern")


def matches(path: Column, pattern: Column) -> Column:
    """Whether a pattern matches a path from its beginning; `*` stands for anything and a `$` at the end for the end."""
    body = F.regexp_replace(pattern, r"\$$", "")
    quoted = F.concat(F.lit(r"\Q"), F.replace(F.replace(body, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit("*"), F.lit(r"\E[\s\S]*\Q")), F.lit(r"\E"))
    regex = F.concat(F.lit("^"), quoted, F.when(pattern.endswith("$"), r"\z").otherwise(""))
    return F.when(F.instr(pattern, "*") + F.instr(pattern, "$") == 0, F.startswith(path, pattern)).otherwise(F.rlike(path, regex))


def check(urls: DataFrame, rules: DataFrame, agent: str = "gobot") -> DataFrame:
    """urls (url, host, ...) with `allowed`, by the rules (origin_host, agent, allow, pattern) of their origin: the longest pattern that matches decides, and allow wins ties."""
    own = rules.filter(F.col("agent").isin(agent, "*"))
    ranked = own.groupBy("origin_host").agg(F.max(F.col("agent") == agent).alias("named")).select(F.col("origin_host").alias("__o"), "named")
    used = own.join(ranked, (F.col("origin_host") == F.col("__o")) & (F.col("named") == (F.col("agent") == agent))).select("origin_host", "allow", "pattern")
    hit = urls.select("url", "host").distinct().join(used, (F.col("host") == F.col("origin_host")) & matches(request_path(F.col("url")), F.col("pattern")))
    verdict = hit.groupBy("url").agg(F.max_by("allow", F.struct(F.length("pattern"), "allow")).alias("v"))
    return urls.join(verdict, "url", "left").withColumn("allowed", F.coalesce("v", F.lit(True))).drop("v")
