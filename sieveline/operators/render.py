"""Reports as lines of text for a terminal. Only masked relations come here, and those are within the report's limits."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .report import rank

NO_GUARANTEE = "Nothing was found in what could be checked. That is no guarantee that it is safe to share."
REVIEW = "Look at the findings and at every gap before sharing."


def scan_lines(row: dict, relations: dict[str, DataFrame]) -> Iterator[str]:
    """A head line, findings from the severest on, gaps and errors, and what to make of it."""
    counts = " ".join(f"{s}:{row[s]}" for s in ("critical", "high", "medium", "low", "info"))
    yield f"{row['verdict']} | artifacts {row['artifacts_total']} | findings {counts} | gaps {row['gaps']} | errors {row['errors']}"
    for r in relations["findings"].orderBy(F.desc(rank(F.col("severity"))), "path", "part", "line", "column", "rule_id").toLocalIterator():
        where = r.path + (f" [{r.part}]" if r.part else "") + (f":{r.line}:{r.column}" if r.line else "")
        yield f"- {r.severity.upper()} {r.rule_id} {where}" + (f" {r.evidence}" if r.evidence else "")
    for r in relations["gaps"].orderBy(F.col("path").asc_nulls_last(), "capability", "reason").toLocalIterator():
        yield f"- INCOMPLETE {r.path if r.path is not None else 'the scan'}: {r.capability} / {r.reason}"
    for r in relations["errors"].orderBy("code", "message").toLocalIterator():
        yield f"- ERROR {r.code} ({r.message})"
    yield NO_GUARANTEE if row["verdict"] == "no_findings" else REVIEW


def table_lines(rows: list[dict]) -> Iterator[str]:
    """Rows of a view in columns of equal width."""
    if not rows:
        yield "(none)"
        return
    names = list(rows[0])
    text = lambda v: "" if v is None else ",".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)
    cells = [names, *[[text(r[n]) for n in names] for r in rows]]
    widths = [max(len(r[k]) for r in cells) for k in range(len(names))]
    for r in cells:
        yield "  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip()


def operation_lines(name: str, row: dict, notes: list[tuple[str, str]]) -> Iterator[str]:
    """What an operation came to, and what it left undone."""
    yield f"{name}: {row['outcome']} | resolved {row['resolved']} | remaining {row['remaining']} | introduced {row['introduced']}"
    for path, reason in notes:
        yield f"- NOT DONE {path}: {reason}"
    yield "Ready for a person's review." if row["ready_for_review"] else "Not ready: look at the report before sharing."


def value_lines(value, indent: str = "") -> Iterator[str]:
    """Any other answer, a line for each value."""
    if isinstance(value, dict):
        for k in sorted(value):
            if isinstance(value[k], (dict, list, tuple)) and value[k]:
                yield f"{indent}{k}:"
                yield from value_lines(value[k], indent + "  ")
            else:
                yield f"{indent}{k}: {value[k]}"
    elif isinstance(value, (list, tuple)):
        for x in value:
            if isinstance(x, dict):
                yield indent + ", ".join(f"{k}={x[k]}" for k in sorted(x))
            else:
                yield f"{indent}{x}"
    else:
        yield f"{indent}{value}"
