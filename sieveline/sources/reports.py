"""Saved reports: written once as sorted JSON of a bounded size, read back strictly."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from sieveline.functions.fixed import LIMITS
from sieveline.operators.transform import write_exclusive


class ReportError(ValueError):
    pass


def _object(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ReportError("duplicate_key")
    return out


def _refuse(value):
    raise ReportError("not_a_number")


def parse(data: bytes) -> dict:
    """An object of strict JSON: UTF-8 without a mark, no key twice, no NaN."""
    if data.startswith(b"\xef\xbb\xbf"):
        raise ReportError("byte_order_mark")
    try:
        out = json.loads(data.decode("utf-8"), object_pairs_hook=_object, parse_constant=_refuse)
    except (UnicodeDecodeError, json.JSONDecodeError) as e:
        raise ReportError("invalid_json") from e
    if not isinstance(out, dict):
        raise ReportError("no_object")
    try:
        json.dumps(out, ensure_ascii=False).encode("utf-8")  # half of a surrogate pair is no character
    except UnicodeEncodeError as e:
        raise ReportError("not_unicode") from e
    return out


def load(path: str, most: int = LIMITS["max_report_bytes"]) -> dict:
    with open(path, "rb") as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise ReportError("report_too_large")
    return parse(data)


def save(report: dict, path: str, most: int = LIMITS["max_report_bytes"]) -> None:
    """Write a report that does not exist yet. One over the bound becomes a whole, minimal report that says so."""
    text = json.dumps(report, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False).encode()
    if len(text) > most:
        small = {"summary": report.get("summary", {}) | {"verdict": "incomplete"}, "findings": [], "artifacts": [], "gaps": [{"capability": "report", "reason": "report_size_limit"}]}
        text = json.dumps(small, sort_keys=True, indent=2).encode()
    write_exclusive(path, text)


def write_relations(relations: dict[str, DataFrame], folder: str) -> None:
    """The relations of a scan as Parquet, one folder each; never over existing ones."""
    for name, df in relations.items():
        df.write.mode("errorifexists").parquet(os.path.join(folder, name))


def read_relations(spark: SparkSession, folder: str, names=("artifacts", "findings", "gaps", "errors", "dependencies")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(os.path.join(folder, n)) for n in names}


def document(summary: dict, relations: dict[str, DataFrame]) -> dict:
    """A scan as one object, its rows in order. The relations are within the limits of a report, so they fit the driver."""
    order = {"artifacts": ["path", "artifact_id"], "findings": ["path", "part", "line", "column", "finding_id"], "gaps": ["path", "part", "capability", "reason"], "errors": ["code", "message"], "dependencies": ["name"]}
    return {"summary": summary} | {n: [r.asDict(recursive=True) for r in relations[n].orderBy(*c).collect()] for n, c in order.items()}
