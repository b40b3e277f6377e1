"""What a report must not hold before it leaves: each rule is a condition on rows, and no row may meet it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.fixed import LIMITS, SEVERITIES

from .detect import ALL
from .evidence import NAME_OMITTED, PATH_OMITTED, display_path, mask_homes

#: Control characters, and characters that can't be seen (fixed values).
CONTROLS = r"[\x00-\x1f\x7f-\x9f]"
UNSEEN = r"[\u00ad\u061c\u200b-\u200f\u202a-\u202e\u2060\u2066-\u2069\ufeff]"
STATUS = ("scanned", "partial")
#: Evidence is a mask: of a value, of control characters, or a path with masked parts.
MASK = r"^<[a-z0-9_-]+(?::[^<>]*)?>$"
OMITTED = "<field:omitted-limit>"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def field(value: Column, most: int = LIMITS["max_field_chars"]) -> list[tuple[str, Column]]:
    """The codes that a string of any field can have, with the condition for each."""
    return [
        ("report_field_limit", F.length(value) > most),
        ("raw_control_character", F.rlike(value, F.lit(CONTROLS)) | F.rlike(value, F.lit(UNSEEN))),
        ("unmasked_home_path", mask_homes(value) != value),
    ]


def path(value: Column, most: int = LIMITS["max_path_chars"]) -> list[tuple[str, Column]]:
    """Those of a displayed path: within its limit, relative, and not changed by masking it again."""
    outer = F.substring_index(value, "!/", 1)
    held = value.isin(NAME_OMITTED, PATH_OMITTED) | F.rlike(outer, F.lit("^<.*>$"))
    return [
        ("display_path_limit", F.length(value) > most),
        ("absolute_display_path", ~held & F.rlike(outer, F.lit(r"^[/\\]|^[A-Za-z]:[/\\]"))),
        ("unmasked_display_path", (F.length(value) <= most) & (display_path(value)["value"] != value)),
    ]


#: The strings of each relation, and which of them are paths.
STRINGS = {
    "artifacts": (["path", "media_type"], ["path"]),
    "findings": (["path", "part", "rule_id", "category", "evidence"], ["path", "part"]),
    "gaps": (["path", "part", "capability", "reason"], ["path"]),
}


def rows_of(name: str) -> list[tuple[str, Column]]:
    """Those of a relation's row as a whole."""
    id_ = lambda c, prefix: ~F.rlike(F.col(c), F.lit(f"^{prefix}-[0-9a-f]{{20}}$"))
    if name == "artifacts":
        return [("invalid_status", ~F.col("status").isin(*STATUS)), ("invalid_id", id_("artifact_id", "a"))]
    if name == "gaps":
        return []
    evidence = F.col("evidence").isNotNull() & ~F.rlike("evidence", F.lit(MASK)) & ~((F.col("category") == "path_disclosure") & F.contains("evidence", F.lit("<")))
    return [
        ("invalid_severity", ~F.col("severity").isin(*SEVERITIES)),
        ("invalid_confidence", ~F.col("confidence").between(0, 1)),
        ("invalid_evidence", evidence),
        ("invalid_location", (F.col("line") < 1) | (F.col("column") < 1)),
        ("invalid_id", id_("finding_id", "f")),
        ("unknown_artifact", F.col("artifact_id").isNull()),
    ]


def violations(relations: dict[str, DataFrame]) -> DataFrame:
    """relation, code and n (rows) of what the relations of a scan (artifacts, findings, gaps) break; none if they may be saved.

    Findings and gaps must name an artifact that there is (a gap may name none).
    Each relation is read once, as it may be costly to make: its rows give their
    strings, their artifact's id and the codes of their own faults, which are
    counted, so that each different string is judged once.
    """
    seen = None
    for name, (columns, paths) in STRINGS.items():
        entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
        each = [entry("path" if c in paths else "field", F.col(c)) for c in columns] + [entry("id", F.col("artifact_id"))]
        each += [entry("fault", F.when(condition, F.lit(code))) for code, condition in rows_of(name)]
        rows = relations[name].select(F.explode(F.array(*each)).alias("s")).select(F.lit(name).alias("relation"), "s.kind", "s.value").where("value <> '' OR kind = 'id' AND value IS NOT NULL")
        seen = rows if seen is None else seen.unionByName(rows)
    counted = seen.groupBy("kind", "value").agg(*[F.count_if(F.col("relation") == name).alias(name) for name in STRINGS])
    value, is_path = F.col("value"), F.col("kind") == "path"
    judged = F.array(*[F.when(c, code) for code, c in field(value)], *[F.when(is_path, F.when(c, code)) for code, c in path(value)])
    codes = F.when(F.col("kind") == "fault", F.array(value)).when(F.col("kind") == "id", F.when(F.col("artifacts") == 0, F.array(F.lit("unknown_artifact")))).otherwise(F.array_compact(judged))
    # As in findings(): of a plain column explode() infers a filter, which judges everything once more.
    found = counted.select(F.explode(F.slice(codes, 1, ALL)).alias("code"), *STRINGS).groupBy("code").agg(*[F.sum(name).alias(name) for name in STRINGS])
    each = F.array(*[F.struct(F.lit(name).alias("relation"), F.col(name).alias("n")) for name in STRINGS])
    return found.select("code", F.explode(each).alias("r")).select("r.relation", "code", "r.n").where("n > 0")


def bounded(df: DataFrame, columns: list[str], most: int = LIMITS["max_field_chars"]) -> DataFrame:
    """df with strings that are too long replaced by a placeholder, and _cut (whether a row had one)."""
    cut = _any([F.coalesce(F.length(c) > most, F.lit(False)) for c in columns])
    return df.withColumn("_cut", cut).withColumns({c: F.when(F.length(c) > most, F.lit(OMITTED)).otherwise(F.col(c)) for c in columns})
