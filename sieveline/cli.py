"""Commands: scan, check, sanitize, verify, report, policy, prepare, rules, formats, doctor, self-test."""

from __future__ import annotations

import argparse
import json
import os
import secrets
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.fixed import SEVERITIES
from sieveline.operators import compare, hygiene, policy, prepare, render, report, scan, transform
from sieveline.sources import files, media, reports


def session() -> SparkSession:
    spark = SparkSession.builder.appName("sieveline").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: How answers are printed: json or text.
FORMAT = ["json"]


def show(value, lines=None) -> None:
    """Print an answer, as JSON or as its lines of text."""
    if FORMAT[0] == "json":
        print(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, default=str))
    else:
        for line in lines if lines is not None else render.value_lines(value):
            print(line)


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def scanned(spark: SparkSession, paths: list[str], limits: dict | None = None) -> dict[str, DataFrame]:
    """The relations of local paths."""
    return scan.scan_paths(spark, *paths, limits=scan.LIMITS | (limits or {}), key=secrets.token_bytes(32))


def checked(found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The relations, if nothing in them is against the rules for what may leave."""
    if bad := sorted(f"{r.relation}:{r.code}" for r in hygiene.violations(found).collect()):
        raise reports.ReportError("report_hygiene " + ",".join(bad))
    return found


def totals(found: dict[str, DataFrame]) -> DataFrame:
    """One summary row of saved relations."""
    f = found["findings"].agg(F.count("*").alias("findings"), *report.severity_counts(), F.collect_set("category").alias("categories"))
    a = found["artifacts"].agg(F.count("*").alias("artifacts_total"), F.count_if(F.col("status") == "scanned").alias("artifacts_complete"), F.count_if(F.col("status") == "partial").alias("artifacts_partial"), F.coalesce(F.collect_set(F.array_sort(F.map_entries("coverage"))), F.array()).alias("coverage")).withColumn("coverage", F.transform("coverage", F.map_from_entries))
    g = found["gaps"].agg(F.count("*").alias("gaps"))
    e = found["errors"].agg(F.count("*").alias("errors"))
    d = found["dependencies"].agg(F.coalesce(F.bool_or(~F.col("available")), F.lit(False)).alias("dependencies_missing"))
    row = a.join(F.broadcast(f)).join(F.broadcast(g)).join(F.broadcast(e)).join(F.broadcast(d))  # one row each
    incomplete = (F.col("gaps") > 0) | (F.col("artifacts_partial") > 0) | (F.col("errors") > 0)
    partial = F.exists("coverage", lambda m: F.exists(F.map_values(m), lambda v: v.isin("partial", "unsupported")))
    return row.withColumn("verdict", report.verdict(incomplete, F.col("high") + F.col("critical") > 0, F.col("findings") > 0)).withColumn("partial_coverage", partial)


def parse_size(text: str) -> int:
    """A positive whole number of bytes, with or without a unit (b, kb, kib, mb, mib, gb, gib)."""
    units = {"": 1, "b": 1, "kb": 1000, "kib": 1 << 10, "mb": 1000**2, "mib": 1 << 20, "gb": 1000**3, "gib": 1 << 30}
    plain = text.strip().lower()
    number = plain.rstrip("bgikm")
    if not (number.isascii() and number.isdigit()) or plain[len(number) :] not in units or int(number) == 0:
        raise argparse.ArgumentTypeError(f"no size: {text!r}")
    return int(number) * units[plain[len(number) :]]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sieveline", description=__doc__)
    top.add_argument("--format", choices=["json", "text"], default="json")
    sub = top.add_subparsers(dest="command", required=True)

    def add(group, name, *names, **options):
        p = group.add_parser(name)
        for n in names:
            p.add_argument(n, **({"nargs": "+"} if n == "paths" else {}))
        for n, o in options.items():
            p.add_argument(f"--{n.replace('_', '-')}", **o)
        return p

    fail = {"default": "high", "choices": ["never", *SEVERITIES]}
    sizes = {f"max_{n}": {"type": parse_size, "help": "a size, such as 10MiB"} for n in ("file_bytes", "total_bytes", "text_bytes", "archive_expanded_bytes")}
    add(sub, "scan", "paths", out={"help": "a new folder for the relations"}, report={"help": "a new file for the whole report in JSON"}, fail_on=fail, **sizes)
    add(sub, "check", "paths", config={"help": "a policy in TOML"})
    add(sub, "sanitize", "source", "target")
    add(sub, "verify", "before", "after")
    for name in ("rules", "formats", "doctor", "self-test"):
        add(sub, name)
    group = sub.add_parser("report").add_subparsers(dest="action", required=True)
    add(group, "show", "folder", by={"default": "rule", "choices": ["rule", "category", "severity"]}, min_severity={"default": "info", "choices": SEVERITIES})
    add(group, "diff", "old", "new")
    add(group, "share-summary", "folder")
    group = sub.add_parser("policy").add_subparsers(dest="action", required=True)
    for name in ("init", "validate", "show"):
        add(group, name, "file")
    group = sub.add_parser("prepare").add_subparsers(dest="action", required=True)
    add(group, "plan", "source", "decisions", "out")
    add(group, "inspect", "plan")
    add(group, "approve", "plan", "out")
    saved = {"help": "a new file for the result in JSON, with a scan of the bundle"}
    add(group, "apply", "source", "plan", "approval", "target", report=saved)
    add(group, "verify", "source", "plan", "target", report=saved)
    return top


def sanitize(spark: SparkSession, source: str, target: str) -> list[tuple[str, str]]:
    """Copies of all files below source without metadata, in a new folder; and what was not copied, with the reason for each."""
    if os.path.lexists(target):
        raise prepare.PrepareError("target_exists")
    found = files.listing(spark, source)
    contents = files.contents(spark, found).persist()
    roots = (files.plain(source),)
    shown = lambda path: scan.display_path(scan.below(F.col(path), roots))["value"]
    notes = [(r[0], r[1]) for r in contents.where("reason IS NOT NULL").select(shown("path"), "reason").collect()]  # as many as the limits allow files
    left = [(p, k) for p, k in found.others if k not in ("directory", "empty")]
    notes += [(r[0], r[1]) for r in spark.createDataFrame(left, "path string, kind string").select(shown("path"), "kind").collect()]
    notes += [(code, message) for code, message in found.errors] + [("the scan", "file_count_limit")] * found.cut
    root = os.path.abspath(roots[0])
    os.makedirs(target)
    for path, _ in (x for x in found.others if x[1] == "empty" and x[0] != root):
        os.makedirs(os.path.join(target, os.path.relpath(path, root)), exist_ok=True)
    for r in transform.transform(contents.where("reason IS NULL"), secrets.token_bytes(32)).toLocalIterator():
        inner = os.path.relpath(r.path, root) if r.path != root else os.path.basename(root)
        path = os.path.join(target, inner)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        transform.write_exclusive(path, bytes(r.copy))
    contents.unpersist()
    return sorted(notes)


def run(a: argparse.Namespace) -> int:
    FORMAT[0] = a.format
    if a.command == "formats":
        show(["text", "zip", *media.OFFICE_TYPES, "pdf", "png", "jpeg"])
        return 0
    if a.command == "policy":
        if a.action == "init":
            transform.write_exclusive(a.file, b'fail_on = "high"\nrequired_capabilities = []\nblocking_categories = []\n')
        else:
            p = policy.load(a.file)
            show({"valid": True} if a.action == "validate" else {"policy": p.__dict__, "digest": p.digest()})
        return 0
    spark = session()
    if a.command == "doctor":
        show({"spark": spark.version, "python": sys.version.split()[0], "pdf_text": False, "image_metadata_reader": False, "ocr": False})
        return 0
    if a.command == "rules":
        show(rows(report.catalog(spark).orderBy("rule_id")))
        return 0
    if a.command == "self-test":
        from sieveline.operators.detect import detect
        from sieveline.plans import cases

        wrong = [r for r in detect(cases.RULE_CASES.spark(spark)).select("case_id", "expect", F.size(F.filter("hits", lambda h: h["rule_id"] == F.col("rule_id"))).alias("n")).collect() if r.n != r.expect]
        show({"cases": len(cases.RULE_CASES.rows), "wrong": [r.case_id for r in wrong]})
        return int(bool(wrong))
    if a.command == "scan":
        given = {k: v for k, v in vars(a).items() if k.startswith("max_") and v}
        found = checked(scanned(spark, a.paths, given))
        if a.out:
            reports.write_relations(found, a.out)
            found = reports.read_relations(spark, a.out)
        row = report.exit_code(totals(found).drop("coverage", "categories"), a.fail_on).first().asDict()
        if a.report:
            reports.save(reports.document(row, found), a.report)
        show(row, render.scan_lines(row, found))
        return row["exit_code"]
    if a.command == "check":
        p = policy.load(a.config) if a.config else policy.Policy()
        given = spark.createDataFrame([(1, p.fail_on, list(p.required_capabilities), list(p.blocking_categories), "missing" if p.manifest_enabled else None)], "policy_id long, fail_on string, required array<string>, blocking array<string>, manifest string")
        row = policy.decide(totals(scanned(spark, a.paths, p.limits)), given).first()
        show(row.asDict() | {"policy": p.digest()})
        return row.exit_code
    if a.command == "report":
        if a.action == "diff":
            old, new = (reports.read_relations(spark, x)["findings"] for x in (a.old, a.new))
            where = ["rule_id", "path", "part", "line", "column"]
            out = rows(compare.diff(compare.sides(old, new, where), where).orderBy("path", "part", "line", "column", "rule_id"))
            show(out, render.table_lines(out))
            return 0
        found = reports.read_relations(spark, a.folder)
        if a.action == "show":
            out = rows(report.show(found["findings"], a.by, a.min_severity).orderBy("place"))
            show(out, render.table_lines(out))
        else:
            show(totals(found).drop("coverage", "categories", "partial_coverage", "dependencies_missing").first().asDict())
        return 0
    if a.command in ("sanitize", "verify"):
        notes = sanitize(spark, a.source, a.target) if a.command == "sanitize" else []
        before, after = (a.source, a.target) if a.command == "sanitize" else (a.before, a.after)
        key = ["name", "part", "rule_id"]
        sides = [scanned(spark, [p]) for p in (before, after)]
        # Names below the two roots, which are called differently.
        below = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "^[^/]*/", "")).otherwise(F.col("path"))
        named = [s["findings"].withColumn("name", below if os.path.isdir(p) else F.lit("")).select(*key) for s, p in zip(sides, (before, after), strict=True)]
        verdicts = [totals(s).first().verdict for s in sides]
        row = compare.outcome(compare.occurrences(compare.sides(*named, key), key), *verdicts, verified=not notes).first().asDict()
        show(row | {"not_done": notes}, render.operation_lines(a.command, row, notes))
        return 0 if row["outcome"] in ("improved", "unchanged") else 1 if row["outcome"] == "regressed" else 2
    save = lambda value, path: transform.write_exclusive(path, json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False).encode())
    if a.action == "plan":
        save(prepare.make_plan(spark, a.source, reports.load(a.decisions)["actions"]), a.out)
    elif a.action == "inspect":
        plan = prepare.inspect(spark, prepare.read(a.plan))
        show(plan, render.value_lines(plan))
    elif a.action == "approve":
        plan = prepare.read(a.plan)
        save(prepare.approve(plan, [x["action_id"] for x in plan["actions"]]), a.out)
    else:
        plan = prepare.read(a.plan)
        out = prepare.apply(spark, a.source, plan, prepare.read(a.approval), a.target) if a.action == "apply" else prepare.verify(spark, a.source, plan, a.target)
        states = rows(out.orderBy("path"))
        if a.report:
            final = totals(checked(scanned(spark, [a.target]))).drop("coverage").first().asDict()
            save(prepare.result(plan, out, final), a.report)
        show(states, render.table_lines(states))
        return int(any(r["state"] != "ok" for r in states))
    return 0


def main(args: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(args))
    except (prepare.PrepareError, policy.PolicyError, reports.ReportError, FileExistsError) as e:
        show({"error": str(e)})
        return 3
