"""Report relations: findings with identity and caps, artifacts, coverage, verdicts and grouped views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions import fixed
from sieveline.functions.fixed import LIMITS, SEVERITIES

from .detect import ALL, detect, findings
from .evidence import hmac_token, mask_value, stable_id


def rank(severity: Column) -> Column:
    """0 for info to 4 for critical; null for anything else."""
    return F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(0)) - 1


def severity_counts(severity: Column = None) -> list[Column]:
    """One count for each severity, also of those that do not occur."""
    severity = F.col("severity") if severity is None else severity
    return [F.count_if(severity == s).alias(s) for s in SEVERITIES]


def masked_findings(docs: DataFrame, keys: list[str], key: bytes | None = None, text: str = "text", most: int = ALL) -> DataFrame:
    """Findings with masked evidence (and a token, given a run's key) in place of values, ids and occurrences.

    The value is dropped here, so nothing downstream can show it. Occurrences
    count equal findings of an artifact in text order, so they do not depend on
    how the rows were dealt.
    """
    found = findings(docs, keys, text, most).withColumn("evidence", mask_value(F.col("value"), F.col("value_class")))
    if key is not None:
        found = found.withColumn("token", hmac_token(key, F.col("value")))
    found = found.drop("value")
    same = Window.partitionBy(*keys, "rule_id", "line", "column").orderBy("start", "end")
    found = found.withColumn("occurrence", F.row_number().over(same))
    return found.withColumn("finding_id", stable_id("f", *[F.col(k) for k in keys], F.col("rule_id"), F.col("line"), F.col("column"), F.col("occurrence")))


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add each row's place among those of its key (_n, from 1) and how many those are (_total), from one exchange."""
    same = Window.partitionBy(*keys)
    return rows.withColumns({"_n": F.row_number().over(same.orderBy(*order)), "_total": F.count("*").over(same)})


def cap(rows: DataFrame, keys: list[str], order: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The first `most` rows of each key, and a gap row for each key that had more (not for one that just fits)."""
    placed = numbered(rows, keys, order)
    gaps = placed.where((F.col("_n") == 1) & (F.col("_total") > most)).select(*keys, F.lit("text").alias("capability"), F.lit("finding_limit").alias("reason"), (F.col("_total") - most).cast("long").alias("omitted"))
    return placed.where(F.col("_n") <= most).drop("_n", "_total"), gaps


def cap_all(rows: DataFrame, keys: list[str], order: list[str], each: int = LIMITS["max_findings_per_artifact"], total: int = LIMITS["max_findings_total"]) -> tuple[DataFrame, DataFrame]:
    """The first `each` rows of each key and of those, in the order of keys, the first `total`; and the gaps.

    A key that had more than `each` has the gap artifact_finding_limit, unless the
    total was used up before; a row without keys (global_finding_limit) says that
    the total cut something. Neither is there for an exact fit. Only the first
    `total` keys can keep anything, so only they are put in order.
    """
    placed = numbered(rows, keys, order)
    per = placed.where("_n = 1").select(*keys, F.col("_total").alias("_of"))
    before = F.sum(F.least("_of", F.lit(each))).over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))  # of `total` rows at most
    first = per.orderBy(*keys).limit(total).withColumn("_before", F.coalesce(before, F.lit(0)))
    on = [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    spans = F.broadcast(first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before"))
    joined = placed.join(spans, reduce(lambda a, b: a & b, on)).where((F.col("_n") <= each) & (F.col("_before") + F.col("_n") <= total))
    full = first.where((F.col("_of") > each) & (F.col("_before") + each <= total)).select(*keys, F.lit("findings").alias("capability"), F.lit("artifact_finding_limit").alias("reason"))
    # What is tried: one more than fits of each key, until the total is full.
    sums = per.agg(F.sum(F.least("_of", F.lit(each))).alias("fit"))
    last = first.agg(F.max(F.col("_before") + F.least("_of", F.lit(each + 1))).alias("tried"))
    over = sums.join(F.broadcast(last)).where((F.col("fit") > total) | (F.col("tried") > total))  # one row each
    none = [F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in keys]
    return joined.drop("_n", "_total", "_before", *[f"_k{i}" for i in range(len(keys))]), full.unionByName(over.select(*none, F.lit("findings").alias("capability"), F.lit("global_finding_limit").alias("reason")))


def cap_gaps(gaps: DataFrame, errors: DataFrame, order: list[str], most: int = LIMITS["max_gaps_total"], most_errors: int = LIMITS["max_errors_total"]) -> tuple[DataFrame, DataFrame]:
    """Gaps and errors within their limits. Four gaps are kept free for what says that something was cut: control gaps, without path."""
    room = max(0, most - fixed.CONTROL_GAPS)
    each = gaps.distinct()
    first = each.orderBy(*order).limit(room)
    control = lambda df, n, reason: df.agg(F.count("*").alias("_c")).where(F.col("_c") > n).select(*[F.lit({"capability": "reporting", "reason": reason}.get(c)).cast(gaps.schema[c].dataType).alias(c) for c in gaps.columns])
    out = first.unionByName(control(each, room, "global_gap_limit")).unionByName(control(errors, most_errors, "global_error_limit"))
    return out, errors.orderBy(*errors.columns).limit(most_errors)


def artifacts_of(docs: DataFrame, keys: list[str], text: str = "text", most: int = LIMITS["max_findings_per_artifact"]) -> DataFrame:
    """One row for each row of docs, as artifacts() gives them, and the categories of its findings: all within the row, without a shuffle."""
    found = detect(docs.select(*dict.fromkeys([*keys, text])), text, "_hits").withColumn("_kept", F.slice("_hits", 1, most))
    of = lambda s: F.size(F.filter("_kept", lambda h: h["severity"] == s)).cast("long").alias(s)
    worst = F.array_max(F.transform("_kept", lambda h: rank(h["severity"])))
    named = F.when(worst.isNotNull(), F.element_at(F.array(*map(F.lit, SEVERITIES)), worst.cast("int") + 1))
    gaps = (F.size("_hits") > most).cast("long")
    return found.select(*keys, F.size("_kept").cast("long").alias("findings"), *[of(s) for s in SEVERITIES], gaps.alias("gaps"), named.alias("worst"), F.when(gaps > 0, "partial").otherwise("scanned").alias("status"), F.array_distinct(F.transform("_kept", lambda h: h["category"])).alias("categories"))


def artifacts(docs: DataFrame, found: DataFrame, gaps: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each artifact: findings by severity, worst severity, gaps and status."""
    counts = found.groupBy(*keys).agg(F.count("*").alias("findings"), *severity_counts(), F.max(rank(F.col("severity"))).alias("_worst"))
    open_ = gaps.groupBy(*keys).agg(F.count("*").alias("gaps"))
    out = docs.select(*keys).join(counts, keys, "left").join(open_, keys, "left").na.fill(0, ["findings", "gaps", *SEVERITIES])
    worst = F.when(F.col("_worst").isNotNull(), F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("_worst").cast("int") + 1))
    return out.withColumn("worst", worst).withColumn("status", F.when(F.col("gaps") > 0, "partial").otherwise("scanned")).drop("_worst")


def verdict(incomplete: Column, high: Column, any_: Column) -> Column:
    """incomplete before block before review before no_findings."""
    return F.when(incomplete, "incomplete").when(high, "block").when(any_, "review").otherwise("no_findings")


def summary(per_artifact: DataFrame, errors: int = 0, more: list[Column] | None = None) -> DataFrame:
    """One row: totals, counts by severity and the technical verdict, and what else is to be summed in the same pass."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = per_artifact.agg(F.count("*").alias("artifacts_total"), F.count_if(F.col("status") == "scanned").alias("artifacts_complete"), F.count_if(F.col("status") == "partial").alias("artifacts_partial"), *[total(s).alias(s) for s in SEVERITIES], total("findings").alias("findings"), total("gaps").alias("gaps"), *(more or []))
    out = out.withColumn("errors", F.lit(errors).cast("long"))
    incomplete = (F.col("gaps") > 0) | (F.col("errors") > 0) | (F.col("artifacts_partial") > 0)
    return out.withColumn("verdict", verdict(incomplete, F.col("high") + F.col("critical") > 0, F.col("findings") > 0))


def exit_code(summary_row: DataFrame, fail_on: str = "high") -> DataFrame:
    """0 fine, 1 threshold met, 2 incomplete."""
    bad = F.lit(False) if fail_on == "never" else sum((F.col(s) for s in SEVERITIES[SEVERITIES.index(fail_on) :]), F.lit(0)) > 0
    return summary_row.withColumn("exit_code", F.when(F.col("verdict") == "incomplete", 2).when(bad, 1).otherwise(0))


def show(found: DataFrame, by: str = "rule", least: str = "info") -> DataFrame:
    """Findings of at least a severity, grouped by rule, category or severity: value, count and counts by severity, with the place in the view."""
    column = {"rule": "rule_id", "category": "category", "severity": "severity"}[by]
    groups = found.where(rank(F.col("severity")) >= SEVERITIES.index(least)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"), *severity_counts())
    order = [F.desc(rank(F.col("value"))), F.asc("value")] if by == "severity" else [F.asc("value")]
    return groups.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def coverage(events: DataFrame) -> DataFrame:
    """The coverage of each (artifact_id, capability) after events (value, seq): the worst, of equals the last; status is partial if anything is."""
    ranks = F.create_map(*[F.lit(x) for kv in fixed.COVERAGE_RANK.items() for x in kv])
    each = events.groupBy("artifact_id", "capability").agg(F.max_by("value", F.struct(F.try_element_at(ranks, F.col("value")), F.col("seq"))).alias("value"))
    return each.groupBy("artifact_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("capability", "value")))).alias("coverage"), F.max(F.try_element_at(ranks, F.col("value"))).alias("_r")).select("artifact_id", "coverage", F.when(F.col("_r") > 0, "partial").otherwise("scanned").alias("status"))


def catalog(spark) -> DataFrame:
    """All rules: rule_id, category, severity, confidence and whether they are text rules."""
    rows = [(r.rule_id, r.category, r.severity, r.confidence, True) for r in fixed.ALL_RULES]
    rows += [(k, {"file": "file_metadata", "archive": "archive_metadata", "office": "document_metadata", "image": "image_metadata", "pdf": "document_metadata"}[k.split(".")[0]], s, 1.0, False) for k, s in fixed.STRUCTURAL_RULES.items()]
    return spark.createDataFrame(rows, "rule_id string, category string, default_severity string, confidence double, text_rule boolean")


def sensitive_name(path: Column) -> Column:
    """Whether the last part of a path is a name that should not be shared."""
    name = F.lower(F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1))
    out = name.isin(*fixed.SENSITIVE_NAMES) | name.startswith(".env.")
    for end in fixed.SENSITIVE_SUFFIXES:
        out |= name.endswith(end)
    return out


def duplicate_contents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of equal contents: digest, members and the least member."""
    return docs.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest")).agg(F.count("*").alias("members"), F.min(key).alias("first")).where("members > 1")
