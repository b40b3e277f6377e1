"""Scanning files: containers opened to parts by one Arrow function, all else as DataFrames.

The function emits one relation of events (artifact, text, finding, gap,
coverage); texts then go through the same detectors as tables do.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.functions.fixed import LIMITS
from sieveline.functions.spans import column_of, line_of
from sieveline.sources import archives, files, images, media
from sieveline.sources.scratch import held

from . import report
from .detect import detect
from .evidence import display_path, hmac_token, mask_value, stable_id
from .hygiene import bounded

#: PDF names and the rules they stand for (fixed values).
PDF_NAMES = {"Author": "author", "Creator": "creator", "Producer": "producer", "Title": "title", "Subject": "subject", "Keywords": "keywords", "EmbeddedFiles": "attachment", "Filespec": "file_spec", "JavaScript": "javascript", "OpenAction": "open_action", "AcroForm": "form", "Annots": "annotation", "Redact": "redaction_annotation", "Encrypt": "encrypted"}
EVENTS = "path string, event string, part string, name string, value string, n long, text string"


def events_of_listing(spark: SparkSession, found: files.Found) -> DataFrame:
    """The events of what a listing found besides files: links, folders, special files, and where it stopped."""
    rows = []
    for path, kind in found.others:
        emit = lambda event, name="", value="": rows.append((path, event, "", name, value, 0 if event == "artifact" else 1, None))  # noqa: B023, E731
        emit("artifact", {"link": "link", "special": "special"}.get(kind, "directory"), {"link": "inode/symlink", "special": "application/octet-stream"}.get(kind, "inode/directory"))
        if rule := {"link": "file.symlink", "vcs": "file.vcs_metadata"}.get(kind):
            emit("finding", rule)
        if reason := {"link": "link_not_followed", "vcs": "vcs_history_not_scanned", "special": "special_file", "too_deep": "directory_depth_limit"}.get(kind):
            emit("gap", "content", reason)
            if kind != "vcs":
                emit("coverage", "content", "partial")
    if found.cut:
        rows.append((None, "gap", "", "content", "file_count_limit", 1, None))
    return spark.createDataFrame(rows, EVENTS)


def unread(path: str, size: int, reason: str) -> Iterator[tuple]:
    """The events of a file that was listed but not read."""
    yield path, "artifact", "", "unread", "application/octet-stream", size, None
    yield path, "gap", "", "content", reason, 1, None
    yield path, "coverage", "", "content", "partial", 1, None


def events_of(path: str, data: bytes, budget: list[int], depth: int = 0, limits: dict = LIMITS) -> Iterator[tuple]:
    """(path, event, part, name, value, n, text) of a file and, in containers, of what it holds."""
    kind, kind_name, mismatch = media.sniff(data, path)
    emit = lambda event, name="", value="", part="", n=1, text=None: (path, event, part, name, value, n, text)
    yield emit("artifact", kind, kind_name, n=len(data))
    if mismatch:
        yield emit("finding", "file.type_mismatch")
    if kind == "executable":
        yield emit("finding", "file.executable")
    covers = lambda **c: [emit("coverage", k, v) for k, v in c.items()]
    if kind == "text":
        text, encoding = media.decode(data) if len(data) <= limits["max_text_bytes"] else (None, None)
        if text is None:
            yield emit("gap", "text", "text_size_limit" if len(data) > limits["max_text_bytes"] else "encoding_unknown")
            yield from covers(text="unsupported")
        else:
            yield emit("text", encoding, text=text)
            yield from covers(text="complete")
    elif kind in ("zip", "office"):
        yield from _container(path, data, budget, depth, limits, kind, emit)
    elif kind == "pdf":
        yield from covers(metadata="partial", text="partial", hidden_content="partial", embedded_objects="partial", ocr="not_applicable")
        yield emit("gap", "text", "optional_dependency_missing")
        for name, rule in PDF_NAMES.items():
            if re.search(rb"/" + name.encode() + rb"(?=[\s/<\[(])", data):
                yield emit("finding", f"pdf.{rule}")
        if b"<x:xmpmeta" in data.lower() or b"<?xpacket" in data.lower():
            yield emit("finding", "pdf.xmp")
    elif kind in ("png", "jpeg"):
        yield from covers(ocr="unsupported", text="not_applicable")
        yield emit("gap", "ocr", "ocr_not_available")
        yield from _image(data, kind, limits, emit)
    elif kind in ("tiff", "webp"):
        yield emit("gap", "metadata", "optional_dependency_missing")
        yield from covers(metadata="unsupported", ocr="unsupported")
    else:
        yield emit("gap", "content", "format_not_supported")
        yield from covers(content="unsupported")


def _exif(payload: bytes, part: str, emit) -> Iterator[tuple]:
    """Findings and texts of EXIF data; a gap if it can't be read."""
    try:
        place, person, device, text = images.exif_facts(payload)
    except ValueError:
        yield emit("gap", "metadata", "exif_unreadable", part=part)
        return
    for rule, n in (("image.gps", int(place)), ("image.identity", person), ("image.device", device)):
        if n:
            yield emit("finding", rule, part=part, n=n)
    if text:
        yield emit("text", "exif", part=part, text=text)


def _image(data: bytes, kind: str, limits: dict, emit) -> Iterator[tuple]:
    left = limits["max_text_bytes"]
    try:
        if kind == "png":
            for chunk, payload in images.png_chunks(data):
                if chunk not in images.PNG_METADATA:
                    continue
                yield emit("finding", {"eXIf": "image.png_exif", "tIME": "image.png_time"}.get(chunk, f"image.png_{chunk.lower()}"), part=f"PNG/{chunk}")
                if chunk == "eXIf":
                    yield from _exif(payload, f"PNG/{chunk}", emit)
                try:
                    text = images.png_text(chunk, payload, left)
                except images.LimitError:
                    yield emit("gap", "metadata", "png_text_limit")
                    continue
                except ValueError:
                    yield emit("gap", "metadata", "png_text_unreadable")
                    continue
                left -= len(text.encode())
                if text:
                    yield emit("text", chunk, part=f"PNG/{chunk}", text=text)
        else:
            for marker, payload, _, _ in images.jpeg_segments(data):
                if found := images.jpeg_kind(marker, payload):
                    yield emit("finding", f"image.jpeg_{found}", part=f"JPEG/0x{marker:02x}")
                    if found == "exif":
                        yield from _exif(payload, f"JPEG/0x{marker:02x}", emit)
                    if found in ("xmp", "comment") and (text := media.decode(payload)[0]):
                        yield emit("text", found, part=f"JPEG/0x{marker:02x}", text=text)
        yield emit("coverage", "metadata", "partial")
    except images.LimitError:
        yield emit("gap", "structure", "chunk_limit")
        yield emit("coverage", "metadata", "partial")
    except ValueError:
        yield emit("gap", "structure", "invalid_structure")
        yield emit("coverage", "metadata", "partial")


def _container(path: str, data: bytes, budget: list[int], depth: int, limits: dict, kind: str, emit) -> Iterator[tuple]:
    own = "archive" if kind == "zip" else "office"
    if depth >= limits["max_archive_depth"]:
        yield emit("gap", "structure", "archive_depth_limit")
        yield emit("coverage", "structure", "partial")
        return
    parts: dict[str, bytes] = {}
    folded: dict[str, int] = {}
    whole = True
    room = limits["max_text_bytes"]  # for the text of all comments together

    def said(comment: bytes, part: str) -> tuple:
        nonlocal room, whole
        if len(comment) > room:
            whole = False
            return emit("gap", "text", "archive_comment_text_limit", part=part)
        room -= len(comment)
        return emit("text", "comment", part=part, text=media.decode(comment)[0] or "")

    try:
        if comment := archives.archive_comment(data):
            yield emit("finding", "archive.comment" if kind == "zip" else "office.package_comment")
            yield said(comment, "comment")
        dated = 0
        for m in archives.members(data, budget, limits):
            part = m.name if m.occurrence == 1 else f"{m.name} [duplicate {m.occurrence}]"
            dated += m.dated
            fold = m.name if kind == "zip" else m.name.lower()
            folded[fold] = folded.get(fold, 0) + 1
            if m.unsafe:
                yield emit("finding", "archive.path_traversal", part=part)
            if folded[fold] == 2:
                yield emit("finding", "archive.duplicate_name" if kind == "zip" else "office.duplicate_part", part=m.name)
            if m.comment:
                yield emit("finding", "archive.comment" if kind == "zip" else "office.part_comment", part=part)
                yield said(m.comment, part)
            if m.refused:
                rule = {"symlink": ("archive.symlink", "office.symlink_part"), "encrypted": ("archive.encrypted", "office.encrypted_part")}.get(m.refused)
                if rule:
                    yield emit("finding", rule[kind == "office"], part=part)
                yield emit("gap", "structure", m.refused, part=part)
                whole = False
                continue
            if kind == "office" and m.name.lower().endswith((".xml", ".rels", ".vml")):
                parts[part] = m.data
                try:
                    if len(m.data) > limits["max_xml_bytes"]:
                        raise archives.Refused("xml_size_limit")
                    yield emit("text", "xml", part=part, text=archives.xml_text(archives.parse_xml(m.data)))
                except archives.Refused as e:
                    yield emit("gap", "text", e.args[0], part=part)
                    yield emit("text", "raw", part=part, text=media.decode(m.data)[0] or "")
                    whole = False
            else:
                parts[part] = m.data if kind == "office" else b""
                yield from events_of(f"{path}!/{part}", m.data, budget, depth + 1, limits)
        if kind == "zip" and dated:
            yield emit("finding", "archive.entry_metadata", n=dated)
        if kind == "office":
            for rule, part, n in archives.office_rules(parts):
                yield emit("finding", rule, part=part, n=n)
                if rule in ("office.macro", "office.embedded_object"):
                    yield emit("gap", "embedded_objects", rule.removeprefix("office.") + "_not_analyzed")
    except archives.Refused as e:
        yield emit("gap", "structure", e.args[0])
        whole = False
    yield emit("coverage", "structure", "complete" if whole else "partial")
    if own == "office":
        yield emit("coverage", "text", "complete" if whole else "partial")


def open_files(contents: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """The events of files (path, content, and reason, length and budget if there are such columns). One file is one task's work at a time; budget is what it may expand to."""

    def events(path: str, data: bytes | None, size: int | None, reason: str | None, budget: int | None) -> Iterator[tuple]:
        if data is None and reason:
            yield from unread(path, size or 0, reason)
            return
        yield from events_of(path, data or b"", [limits["max_archive_expanded_bytes"] if budget is None else budget], 0, limits)
        if reason:
            yield path, "gap", "", "content", reason, 1, None
            yield path, "coverage", "", "content", "partial", 1, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(),) * 5 + (pa.int64(), pa.string())
        for part in batches:
            for path, data, size, reason, budget in zip(*(part.column(c) for c in ("path", "content", "length", "reason", "budget")), strict=True):
                rows = list(events(path.as_py() or "", data.as_py(), size.as_py(), reason.as_py(), budget.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "event", "part", "name", "value", "n", "text"])

    extra = [F.col(c) if c in contents.columns else F.lit(None).cast(k).alias(c) for c, k in (("length", "long"), ("reason", "string"), ("budget", "long"))]
    return contents.select("path", "content", *extra).mapInArrow(run, EVENTS)


def below(path: Column, roots: tuple[str, ...]) -> Column:
    """A path from the last part of the root that it lies under; as it is if under none."""
    for root in roots:
        above = os.path.dirname(os.path.abspath(root)).rstrip("/") + "/"
        path = F.regexp_replace(path, r"^(?:file:/{0,2}(?=/))?\Q" + above + r"\E", "")
    return path


#: Readers that are not here, by the kinds of files that they would read: name and capability.
READERS = {"pdf": ("pdf_reader", "pdf_text_and_structure"), **dict.fromkeys(("png", "jpeg", "tiff", "webp"), ("image_reader", "rich_image_metadata"))}


def scan(contents: DataFrame, limits: dict = LIMITS, key: bytes | None = None, roots: tuple[str, ...] = (), found: files.Found | None = None) -> dict[str, DataFrame]:
    """artifacts, findings, gaps, errors and dependencies of files (path, content, reason), and of what a listing found besides them.

    Paths are reported from the last part of their root on, and names are
    searched in that form: what stands above a root is not part of a report.
    Files are opened once: one pass finds, masks and drops their texts, and only
    what is masked is written for the relations to be made of.
    """
    spark = contents.sparkSession
    events = open_files(contents, limits)
    if found is not None:
        events = events.unionByName(events_of_listing(spark, found))
    each, total = limits["max_findings_per_artifact"], limits["max_findings_total"]
    facts = held(_facts(events.withColumn("path", below(F.col("path"), roots)), key, each), "scan-facts")
    event = lambda kind: facts.where((F.col("event") == kind) & (F.coalesce("pos", F.lit(0)) == 0))
    turn = F.row_number().over(Window.partitionBy("shown").orderBy("path", "media_type"))
    artifacts = event("artifact").select("path", "shown", F.col("name").alias("kind"), F.col("value").alias("media_type"), F.col("n").alias("size")).withColumn("occurrence", turn)
    artifacts = held(artifacts.withColumn("artifact_id", stable_id("a", F.col("shown"), F.col("media_type"), F.col("occurrence"))), "scan-artifacts")
    # Findings and gaps are tied to the artifact of their path; of two with one path, to the first.
    ids = artifacts.groupBy("path").agg(F.min_by(F.struct("artifact_id", "shown"), "occurrence").alias("_a"))
    hits = facts.where("rule_id IS NOT NULL")
    in_names = hits.where("event = 'artifact' AND category IN ('pii', 'secret', 'unicode_control')").withColumns({"rule_id": F.lit("file.personal_name"), "severity": F.lit("high"), "part": F.lit("name")})
    rules = report.catalog(spark).select("rule_id", "category", F.col("default_severity").alias("severity"), "confidence")
    named = event("artifact").where(report.sensitive_name(F.col("path"))).select("path", F.lit("").alias("part"), F.lit("file.sensitive_name").alias("rule_id"))
    built = event("finding").select("path", "part", F.col("name").alias("rule_id")).unionByName(named).join(F.broadcast(rules), "rule_id")
    columns = ["path", "part", "rule_id", "category", "severity", "confidence", "evidence", "token", "line", "column", "start", "end"]
    phase = lambda df, k: df.withColumn("_phase", F.lit(k))
    every = phase(in_names.select(*columns), 0).unionByName(phase(built.select(*columns[:6]), 1), allowMissingColumns=True).unionByName(phase(hits.where("event = 'text'").select(*columns), 2))
    kept, over = report.cap_all(every, ["path"], ["_phase", "part", "start", "end", "rule_id"], each, total)
    kept = bounded(kept, ["part", "evidence"], limits["max_field_chars"])
    kept, over = held(kept, "scan-findings"), held(over, "scan-cut")
    fields = kept.agg(F.coalesce(F.bool_or("_cut"), F.lit(False)).alias("_c")).where("_c").select(F.lit(None).cast("string").alias("path"), F.lit("").alias("part"), F.lit("reporting").alias("capability"), F.lit("report_field_limit").alias("reason"))
    place = Window.partitionBy("path", "part", "rule_id", "line", "column").orderBy("start", "end")
    tied = lambda df: df.join(ids, "path", "left").withColumns({"artifact_id": F.col("_a.artifact_id"), "path": F.col("_a.shown")}).drop("_a")
    findings = tied(kept.withColumn("occurrence", F.row_number().over(place)))
    findings = findings.withColumn("finding_id", stable_id("f", *[F.col(c) for c in ("artifact_id", "part", "rule_id", "line", "column", "occurrence")]))
    gaps = event("gap").select("path", "part", F.col("name").alias("capability"), F.col("value").alias("reason")).unionByName(over.withColumn("part", F.lit(""))).unionByName(fields)
    errors = spark.createDataFrame(found.errors if found is not None else [], "code string, message string")
    gaps, errors = report.cap_gaps(tied(gaps), errors, ["path", "part", "capability", "reason"], limits["max_gaps_total"], limits["max_errors_total"])
    covered = report.coverage(event("coverage").select(F.col("path").alias("artifact_id"), F.col("name").alias("capability"), "value", F.lit(0).alias("seq")))
    cut = over.where("path IS NOT NULL").select("path", F.lit("partial").alias("_cut"))
    out = artifacts.join(covered.withColumnRenamed("artifact_id", "path"), "path", "left").join(cut, "path", "left")
    out = out.withColumn("status", F.coalesce("_cut", "status", F.lit("scanned"))).withColumn("path", F.col("shown")).drop("_cut", "shown")
    reader = F.create_map(*[F.lit(x) for k, v in READERS.items() for x in (k, "/".join(v))])
    needed = artifacts.select(F.try_element_at(reader, F.col("kind")).alias("r")).where("r IS NOT NULL").distinct()
    dependencies = needed.select(F.substring_index("r", "/", 1).alias("name"), F.lit(False).alias("available"), F.substring_index("r", "/", -1).alias("capability"))
    return {"artifacts": out, "findings": findings.select("finding_id", "artifact_id", *columns[:-2], "occurrence"), "gaps": gaps, "errors": errors, "dependencies": dependencies}


def _facts(events: DataFrame, key: bytes | None, each: int) -> DataFrame:
    """Events with what is found in texts and in artifacts' names, a row for each hit (pos from 0) or one for none; values are masked, texts gone.

    One hit more than is kept of a text tells that there are more.
    """
    subject = F.when(F.col("event") == "text", F.col("text")).when(F.col("event") == "artifact", F.col("path"))
    rows = detect(events.withColumn("_subject", subject).drop("text"), "_subject", "_hits", each + 1)
    rows = rows.select("path", "event", "part", "name", "value", "n", "_subject", F.posexplode_outer("_hits").alias("pos", "_h"))
    hit = {c: F.col(f"_h.{c}") for c in ("start", "end", "rule_id", "category", "severity", "confidence")}
    evidence = mask_value(F.col("_h.value"), F.col("_h.value_class"))
    token = F.lit(None).cast("string") if key is None else hmac_token(key, F.col("_h.value"))
    place = {"line": line_of(F.col("_subject"), hit["start"]), "column": column_of(F.col("_subject"), hit["start"])}
    shown = F.when((F.col("event") == "artifact") & (F.coalesce("pos", F.lit(0)) == 0), display_path(F.col("path"))["value"])
    found = F.col("_h").isNotNull()
    return rows.select("path", "event", "part", "name", "value", "n", "pos", *[c.alias(k) for k, c in hit.items()], F.when(found, evidence).alias("evidence"), F.when(found, token).alias("token"), *[F.when(found, c).alias(k) for k, c in place.items()], shown.alias("shown"))


def scan_paths(spark: SparkSession, *paths: str, limits: dict = LIMITS, key: bytes | None = None) -> dict[str, DataFrame]:
    """scan() of all that lies below some paths. Every entry of the listing is an artifact or a gap."""
    found = files.listing(spark, *paths, limits=limits)
    contents = files.contents(spark, found, limits)
    if budgets := files.expansion_budgets(spark, found, limits):
        shared = spark.createDataFrame(list(budgets.items()), "path string, budget long")  # a row for each archive of the listing
        contents = contents.join(F.broadcast(shared), "path", "left")
    return scan(contents, limits, key, tuple(files.plain(p) if files.is_local(p) else p for p in paths), found)
