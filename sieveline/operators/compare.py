"""Multiset differences of reports, and occurrence-wise comparison of two scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sides(old: DataFrame, new: DataFrame, structure: list[str]) -> DataFrame:
    """The rows of both reports, each with its side ('old' or 'new')."""
    return old.select(*structure, F.lit("old").alias("side")).unionByName(new.select(*structure, F.lit("new").alias("side")))


def diff(rows: DataFrame, structure: list[str]) -> DataFrame:
    """For each structure of sided rows how often it is in both, only in the new, and only in the old report (multisets). One aggregate, no join."""
    counted = rows.groupBy(*structure).agg(F.count_if(F.col("side") == "old").alias("_o"), F.count_if(F.col("side") == "new").alias("_n"))
    o, n = F.col("_o"), F.col("_n")
    return counted.select(*structure, F.least(o, n).cast("long").alias("same"), F.greatest(n - o, F.lit(0)).cast("long").alias("new"), F.greatest(o - n, F.lit(0)).cast("long").alias("resolved"))


def occurrences(rows: DataFrame, key: list[str]) -> DataFrame:
    """Every finding of sided rows as resolved, remaining or introduced, paired by key and occurrence (which counts those of an equal key)."""
    counted = rows.groupBy(*key).agg(F.count_if(F.col("side") == "old").alias("_o"), F.count_if(F.col("side") == "new").alias("_n"))
    each = counted.withColumn("occurrence", F.explode(F.sequence(F.lit(1), F.greatest("_o", "_n").cast("int"))))
    state = F.when(F.col("occurrence") > F.col("_n"), "resolved").when(F.col("occurrence") > F.col("_o"), "introduced").otherwise("remaining")
    return each.select(*key, "occurrence", state.alias("state"))


def outcome(states: DataFrame, before_verdict: str, after_verdict: str, verified: Column | bool = True) -> DataFrame:
    """One row: counts, outcome (incomplete, regressed, improved, unchanged) and whether the result is ready for review."""
    counts = states.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("resolved", "remaining", "introduced")])
    complete = F.lit(before_verdict != "incomplete" and after_verdict != "incomplete")
    ok = verified if isinstance(verified, Column) else F.lit(verified)
    result = F.when(~complete | ~ok, "incomplete").when(F.col("introduced") > 0, "regressed").when(F.col("resolved") > 0, "improved").otherwise("unchanged")
    return counts.withColumn("outcome", result).withColumn("ready_for_review", complete & ok & F.lit(after_verdict == "no_findings") & (F.col("introduced") == 0))


def artifact_changes(rows: DataFrame) -> DataFrame:
    """Artifacts (path, token, side) of two scans by path: added, removed, changed, unchanged; a path that is there twice compares as a multiset of tokens.

    Tokens are counted before paths are, so that a path of very many artifacts is never one row.
    """
    count = lambda s: F.count_if(F.col("side") == s)
    each = rows.groupBy("path", "token").agg(count("old").alias("_o"), count("new").alias("_n"))
    per = each.groupBy("path").agg(F.sum("_o").alias("before"), F.sum("_n").alias("after"), F.bool_and(F.col("_o") == F.col("_n")).alias("_same"))
    state = F.when(F.col("before") == 0, "added").when(F.col("after") == 0, "removed").when(F.col("_same"), "unchanged").otherwise("changed")
    return per.select("path", state.alias("state"), F.col("before").cast("long").alias("before"), F.col("after").cast("long").alias("after"))


def receipts(changed: DataFrame, actions: DataFrame, receipts_: DataFrame) -> DataFrame:
    """Changed paths with whether exactly one applied action and one receipt for it explain the change."""
    act = actions.where("status = 'applied'").groupBy("path").agg(F.count("*").alias("n_actions"), F.first("action").alias("action"))
    rec = receipts_.groupBy("path", "action").agg(F.count("*").alias("n_receipts"), F.bool_and(F.forall("facets", lambda f: f["preserved"])).alias("kept"))
    out = changed.join(act, "path", "left").join(rec, ["path", "action"], "left")
    good = (F.col("n_actions") == 1) & (F.col("n_receipts") == 1) & F.col("kept")
    return out.select("path", "action", F.coalesce(good, F.lit(False)).alias("explained"))
