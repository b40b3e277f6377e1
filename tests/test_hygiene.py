"""What a report breaks: counted over repeated strings, and with each relation read once."""

import pytest

from sieveline.operators import hygiene

A, B, LOST = "a-" + "0" * 20, "a-" + "1" * 20, "a-" + "2" * 20
FINDING = {"finding_id": "f-" + "0" * 20, "artifact_id": A, "path": "a/b", "part": "", "rule_id": "pii.email", "category": "pii", "severity": "high", "confidence": 0.9, "evidence": "<email:redacted>", "line": 1, "column": 1}
GAP = {"artifact_id": A, "path": "a/b", "part": "", "capability": "text", "reason": "text_size_limit"}
ARTIFACT = {"artifact_id": A, "path": "a/b", "media_type": "text/plain", "status": "scanned"}
SCHEMAS = {
    "findings": "finding_id string, artifact_id string, path string, part string, rule_id string, category string, severity string, confidence double, evidence string, line int, `column` int",
    "gaps": "artifact_id string, path string, part string, capability string, reason string",
    "artifacts": "artifact_id string, path string, media_type string, status string",
}


@pytest.fixture
def relations(spark):
    rows = {
        "findings": [FINDING | {"path": "/home/ann/x", "part": "/home/ann/x"}] * 2 + [FINDING | {"artifact_id": x} for x in (None, LOST, LOST, B, "")] + [FINDING | {"line": 0, "column": 0, "evidence": None, "category": None}],
        "gaps": [GAP | {"artifact_id": x} for x in (None, LOST, B)] + [GAP | {"path": None, "part": None, "reason": "a\tb"}] * 2,
        "artifacts": [ARTIFACT, ARTIFACT | {"artifact_id": B, "path": "/home/ann/x"}, ARTIFACT | {"artifact_id": None, "status": None}, ARTIFACT | {"artifact_id": "", "path": "", "media_type": None}],
    }
    return {name: spark.createDataFrame([tuple(r.values()) for r in rows[name]], SCHEMAS[name]) for name in rows}


def test_violations_are_counted_for_every_string_and_row(relations):
    assert sorted(map(tuple, hygiene.violations(relations).collect())) == sorted([
        *[("findings", code, 4) for code in ("absolute_display_path", "unmasked_display_path", "unmasked_home_path")],
        ("findings", "invalid_location", 1), ("findings", "unknown_artifact", 3),
        ("gaps", "raw_control_character", 2), ("gaps", "unknown_artifact", 1),
        *[("artifacts", code, 1) for code in ("absolute_display_path", "unmasked_display_path", "unmasked_home_path", "invalid_id")],
    ])


def test_nothing_is_found_in_what_is_fine_or_empty(spark):
    fine = {"findings": FINDING, "gaps": GAP, "artifacts": ARTIFACT}
    assert hygiene.violations({k: spark.createDataFrame([tuple(v.values())] * 3, SCHEMAS[k]) for k, v in fine.items()}).count() == 0
    assert hygiene.violations({k: spark.createDataFrame([], SCHEMAS[k]) for k in fine}).count() == 0


def test_each_relation_is_read_once(spark, relations, tmp_path):
    for name, df in relations.items():
        df.write.parquet(f"{tmp_path}/{name}")
    read = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in relations}
    plan = hygiene.violations(read)._jdf.queryExecution().executedPlan().toString()
    # Findings may be detected by what reads them: read thrice, a text is searched thrice.
    assert plan.count("Scan parquet") == len(read)
