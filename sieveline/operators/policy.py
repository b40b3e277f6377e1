"""Policies: merged from defaults to overrides, and the decision they make on a report."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.fixed import LIMITS, SEVERITIES

from .report import verdict

#: Reasons in the order in which a decision lists them (fixed values).
REASONS = ("scan_error_present", "coverage_gap_present", "partial_artifact_present", "optional_dependency_unavailable", "technical_incomplete_reported", "manifest_validation_missing", "manifest_validation_incomplete", "manifest_not_exact", "required_capability_incomplete", "blocking_category_present", "severity_threshold_met", "technical_block_reported", "findings_below_threshold", "no_findings_observed")


class PolicyError(ValueError):
    pass


@dataclass(frozen=True)
class Policy:
    fail_on: str = "high"
    required_capabilities: tuple[str, ...] = ()
    blocking_categories: tuple[str, ...] = ()
    optional_tools: bool = False
    manifest_enabled: bool = False
    manifest_exact: bool = True
    limits: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.fail_on != "never" and self.fail_on not in SEVERITIES:
            raise PolicyError("fail_on")
        for name in ("required_capabilities", "blocking_categories"):
            value = getattr(self, name)
            if isinstance(value, str) or not all(isinstance(x, str) and x for x in value):
                raise PolicyError(name)
            object.__setattr__(self, name, tuple(sorted(set(value))))
        for name in ("optional_tools", "manifest_enabled", "manifest_exact"):
            if not isinstance(getattr(self, name), bool):
                raise PolicyError(name)
        for name, value in self.limits.items():
            if name not in LIMITS or isinstance(value, bool) or not isinstance(value, int) or not 0 < value <= (1 << 63) - 1:
                raise PolicyError(f"limits.{name}")

    def digest(self) -> str:
        return "sha256:" + hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def resolve(*layers: dict) -> Policy:
    """A policy from layers, later ones over earlier ones; limits are merged one by one. Unknown fields are refused."""
    known = {f.name for f in fields(Policy)}
    out = Policy()
    for layer in layers:
        if unknown := set(layer) - known:
            raise PolicyError(f"unknown: {sorted(unknown)}")
        layer = {k: tuple(v) if isinstance(v, list) else v for k, v in layer.items()}
        out = replace(out, **layer | {"limits": out.limits | layer.get("limits", {})})
    return out


def load(path: str) -> Policy:
    """A policy of a TOML file of at most 1 MiB."""
    import tomllib

    with open(path, "rb") as f:
        data = f.read((1 << 20) + 1)
    if len(data) > 1 << 20:
        raise PolicyError("policy_too_large")
    return resolve(tomllib.loads(data.decode("utf-8")))


def decide(summary: DataFrame, policies: DataFrame) -> DataFrame:
    """The decision of every policy row on a one-row summary.

    summary has the counts of report.summary(), and categories (array),
    partial_coverage and dependencies_missing (boolean), coverage
    (array<map<string,string>> of the artifacts). policies has policy_id,
    fail_on, required, blocking (arrays) and manifest (null, 'missing',
    'complete', 'incomplete' or 'inexact').
    """
    rows = policies.join(F.broadcast(summary))  # one row
    ranks = F.array(*map(F.lit, SEVERITIES))
    errors, gaps = F.col("errors") > 0, F.col("gaps") > 0
    partial = (F.col("artifacts_partial") > 0) | F.col("partial_coverage")
    known = F.col("verdict") == "incomplete"
    technical = verdict(known | errors | gaps | partial | F.col("dependencies_missing"), F.col("high") + F.col("critical") > 0, F.col("findings") > 0)
    lacking = F.exists("required", lambda c: F.exists("coverage", lambda m: ~F.coalesce(F.try_element_at(m, c).isin("complete", "not_applicable"), F.lit(False))))
    bar = F.array_position(ranks, F.col("fail_on"))
    severe = (F.col("fail_on") != "never") & F.exists(F.array(*[F.when(F.col(s) > 0, k + 1) for k, s in enumerate(SEVERITIES)]), lambda r: F.coalesce(r >= bar, F.lit(False)))
    category = F.arrays_overlap("blocking", "categories")
    manifest = F.col("manifest").isNotNull() & (F.col("manifest") != "complete")
    outcome = F.when((technical == "incomplete") | lacking | manifest, "incomplete").when(category | severe, "block").when(F.col("findings") > 0, "review").otherwise("pass")
    rows = rows.withColumn("technical_verdict", technical).withColumn("policy_outcome", outcome)
    hold = {
        "scan_error_present": errors,
        "coverage_gap_present": gaps,
        "partial_artifact_present": partial,
        "optional_dependency_unavailable": F.col("dependencies_missing"),
        "technical_incomplete_reported": known,
        "manifest_validation_missing": F.col("manifest") == "missing",
        "manifest_validation_incomplete": F.col("manifest") == "incomplete",
        "manifest_not_exact": F.col("manifest") == "inexact",
        "required_capability_incomplete": lacking,
        "blocking_category_present": category,
        "severity_threshold_met": severe,
        "technical_block_reported": F.col("technical_verdict") == "block",
        "findings_below_threshold": F.col("policy_outcome") == "review",
        "no_findings_observed": F.col("policy_outcome") == "pass",
    }
    reasons = F.array_compact(F.array(*[F.when(hold[r], r) for r in REASONS]))
    code = F.when(F.col("policy_outcome") == "incomplete", 2).when(F.col("policy_outcome") == "block", 1).otherwise(0)
    return rows.select("policy_id", "technical_verdict", "policy_outcome", code.alias("exit_code"), reasons.alias("reasons"))
