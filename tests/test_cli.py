import json
import os

import pytest

from sieveline import cli
from sieveline.operators import prepare
from sieveline.sources import reports

from . import makers


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "copy.txt").write_text("mail ann@example.com")
    (root / "old.txt").write_text("plain words")
    (root / "omit.txt").write_text("leave out")
    (root / "photo.png").write_bytes(makers.png((b"tEXt", b"k\0v")))
    return root


def run(capsys, *args):
    code = cli.main([str(a) for a in args])
    text = capsys.readouterr().out
    return code, json.loads(text) if text.strip() else None


def test_scan_and_report(spark, tree, tmp_path, capsys):
    code, out = run(capsys, "scan", tree, "--out", tmp_path / "r1")
    assert run(capsys, "scan", tree / "copy.txt", "--report", tmp_path / "r.json")[0] == 1
    saved = reports.load(str(tmp_path / "r.json"))
    assert saved["summary"]["verdict"] == "block" and [f["rule_id"] for f in saved["findings"]] == ["pii.email"] and saved["findings"][0]["artifact_id"] == saved["artifacts"][0]["artifact_id"]
    assert run(capsys, "scan", tree / "copy.txt", "--report", tmp_path / "r.json")[0] == 3
    assert code == 2 and out["findings"] == 2 and out["verdict"] == "incomplete" and out["dependencies_missing"]  # pictures are never read in full
    assert run(capsys, "scan", tree / "copy.txt")[0] == 1 and run(capsys, "scan", tree / "old.txt")[0] == 0
    (tree / "old.txt").write_text("now bob@example.org")
    run(capsys, "scan", tree, "--out", tmp_path / "r2")
    assert {(r["value"], r["count"]) for r in run(capsys, "report", "show", tmp_path / "r2")[1]} == {("image.png_text", 1), ("pii.email", 2)}
    assert sum(r["new"] for r in run(capsys, "report", "diff", tmp_path / "r1", tmp_path / "r2")[1]) == 1
    assert "path" not in run(capsys, "report", "share-summary", tmp_path / "r2")[1]


def test_check_and_policy(spark, tree, tmp_path, capsys):
    policy = tmp_path / "p.toml"
    assert run(capsys, "policy", "init", policy)[0] == 0 and run(capsys, "policy", "init", policy)[0] == 3
    assert run(capsys, "policy", "validate", policy)[1] == {"valid": True}
    assert run(capsys, "policy", "show", policy)[1]["digest"].startswith("sha256:")
    code, out = run(capsys, "check", tree / "copy.txt", "--config", policy)
    assert (code, out["policy_outcome"]) == (1, "block")
    assert run(capsys, "check", tree / "old.txt")[1]["policy_outcome"] == "pass"


def test_sanitize_and_verify(spark, tree, tmp_path, capsys):
    _, out = run(capsys, "sanitize", tree, tmp_path / "out")
    assert out["resolved"] == 1 and out["introduced"] == 0
    assert sorted(os.listdir(tmp_path / "out")) == sorted(os.listdir(tree))
    assert run(capsys, "sanitize", tree, tmp_path / "out")[0] == 3
    assert run(capsys, "verify", tree, tmp_path / "out")[1]["resolved"] == 1


def test_hidden_files_are_scanned_and_copied(spark, tmp_path, capsys):
    from .test_scan import HIDDEN, hidden_tree

    root = tmp_path / "t"
    hidden_tree(root)
    code, out = run(capsys, "scan", root)
    assert code == 1 and out["findings"] == 5 and out["gaps"] == 0
    (root / "big.txt").write_text("x")
    os.truncate(root / "big.txt", 60 << 20)
    code, out = run(capsys, "sanitize", root, tmp_path / "copy")
    assert code == 2 and out["not_done"] == [["t/big.txt", "file_size_limit"]] and not out["ready_for_review"]
    for name, text in HIDDEN.items():
        assert (tmp_path / "copy" / name).read_text() == text


def test_verify_pairs_by_path(spark, tmp_path, capsys):
    for side, where in (("a", "x"), ("b", "y")):
        for folder in ("x", "y"):
            (tmp_path / side / folder).mkdir(parents=True)
            (tmp_path / side / folder / "n.txt").write_text("mail ann@example.com" if folder == where else "plain")
    code, out = run(capsys, "verify", tmp_path / "a", tmp_path / "b")
    assert (code, out["resolved"], out["introduced"]) == (1, 1, 1)


def test_text_and_sizes(spark, tree, capsys):
    assert cli.main(["--format", "text", "scan", str(tree), "--max-file-bytes", "1MiB"]) == 2
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].startswith("incomplete | artifacts 5") and any(x.startswith("- HIGH pii.email src/copy.txt:1:6 <email:redacted>") for x in lines) and any("INCOMPLETE src/photo.png: ocr" in x for x in lines)
    assert [cli.parse_size(x) for x in ("7", "2 kb".replace(" ", ""), "3KiB", "1GB")] == [7, 2000, 3072, 1_000_000_000]
    for bad in ("", "0", "1.5mb", "-1", "kb", "5 tb"):
        with pytest.raises(Exception, match="no size"):
            cli.parse_size(bad)
    assert cli.main(["--format", "text", "scan", str(tree / "old.txt")]) == 0
    assert "no guarantee" in capsys.readouterr().out


def test_prepare(spark, tree, tmp_path, capsys):
    actions = [("copy.txt", "copy.txt", "copy_unchanged"), ("old.txt", "new/name.txt", "rename_in_bundle"), ("omit.txt", None, "omit_from_boundary"), ("photo.png", "photo.png", "strip_png_metadata")]
    write = lambda a: (tmp_path / "d.json").write_text(json.dumps({"actions": [dict(zip(("source_path", "target_path", "action"), x, strict=True)) for x in a]}))
    write(actions[:3])
    assert run(capsys, "prepare", "plan", tree, tmp_path / "d.json", tmp_path / "plan.json")[1] == {"error": "missing"}
    write(actions)
    assert run(capsys, "prepare", "plan", tree, tmp_path / "d.json", tmp_path / "plan.json")[0] == 0
    assert run(capsys, "prepare", "inspect", tmp_path / "plan.json")[1]["counts"]["omit_from_boundary"] == 1
    plan = prepare.read(str(tmp_path / "plan.json"))
    plan["actions"][0]["source_path"] = "mail/ann@example.com.txt"
    assert prepare.inspect(spark, plan)["actions"][0]["source_path"] == "mail/<email:redacted>"
    assert run(capsys, "prepare", "approve", tmp_path / "plan.json", tmp_path / "ok.json")[0] == 0
    code, out = run(capsys, "prepare", "apply", tree, tmp_path / "plan.json", tmp_path / "ok.json", tmp_path / "bundle", "--report", tmp_path / "result.json")
    saved = reports.load(str(tmp_path / "result.json"))
    assert (saved["outcome"], saved["ready_for_review"], saved["expected"], saved["observed"], saved["issues_total"], saved["detail"]) == ("verified", False, 3, 3, 0, "complete")
    assert saved["final_scan"]["findings"] == 1 and saved["actions"]["omit_from_boundary"] == 1
    assert code == 0 and {r["path"] for r in out} == {"copy.txt", "new/name.txt", "photo.png"}
    (tmp_path / "bundle" / "copy.txt").write_text("tampered")
    (tmp_path / "bundle" / "more.txt").write_text("x")
    code, out = run(capsys, "prepare", "verify", tree, tmp_path / "plan.json", tmp_path / "bundle")
    assert code == 1 and {r["path"]: r["state"].split(":")[0] for r in out} == {"copy.txt": "changed", "more.txt": "unexpected", "new/name.txt": "ok", "photo.png": "ok"}
    (tree / "old.txt").write_text("drift")
    assert run(capsys, "prepare", "apply", tree, tmp_path / "plan.json", tmp_path / "ok.json", tmp_path / "b2")[1] == {"error": "source_changed"}
    plan = prepare.read(str(tmp_path / "plan.json"))
    plan["actions"][0]["target_path"] = "else.txt"
    with pytest.raises(prepare.PrepareError):
        prepare.approve(plan, [a["action_id"] for a in plan["actions"]])


def test_results_of_many_issues_are_cut_to_size(spark):
    states = spark.createDataFrame([(f"folder/file-{k:04d}.txt", "missing") for k in range(300)] + [("fine", "ok")], "path string, state string")
    plan = {"digest": "sha256:0", "actions": []}
    for most in (2000, 9000, 1 << 20):
        out = prepare.result(plan, states, {"verdict": "no_findings"}, most)
        assert len(json.dumps(out, sort_keys=True, indent=2).encode()) <= most and len(out["issues"]) + out["issues_omitted"] == out["issues_total"] == 300
        assert out["outcome"] == "incomplete" and not out["ready_for_review"] and out["detail"] == ("complete" if most == 1 << 20 else "truncated")
    assert prepare.result(plan, states.where("state = 'ok'"), {"verdict": "no_findings"})["ready_for_review"]


def test_metadata_commands(spark, capsys):
    assert len(run(capsys, "rules")[1]) == 95
    assert run(capsys, "doctor")[0] == 0 and ".docx" in run(capsys, "formats")[1]
    assert run(capsys, "self-test")[1]["wrong"] == []
