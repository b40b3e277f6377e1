import json
import os
import struct

import pytest

from sieveline.operators import compare, hygiene, inventory, policy, report, scan, transform
from sieveline.sources import archives, files, images, media, reports

from . import makers

KEY = b"0123456789abcdef"


def events(data, path, **limits):
    rows = list(scan.events_of(path, data, [limits.pop("budget", 1 << 28)], 0, scan.LIMITS | limits))
    return {(e, n, p) for _, e, p, n, *_ in rows}, rows


def rules(data, path):
    return sorted(n for e, n, _ in events(data, path)[0] if e == "finding")


@pytest.mark.parametrize(
    ("data", "path", "want"),
    [
        (b"plain", "a.txt", ("text", "text/plain", False)),
        (b"%PDF-1.7", "a.pdf", ("pdf", "application/pdf", False)),
        (b"%PDF-1.7", "a.txt", ("pdf", "application/pdf", True)),
        (b"MZ\0", "photo.jpg.exe", ("executable", "application/vnd.microsoft.portable-executable", True)),
        (makers.png(), "x.png", ("png", "image/png", False)),
        (b"RIFF\0\0\0\0WEBP", "x.webp", ("webp", "image/webp", False)),
        (b"\0\1\2\3" * 100, "x.docx", ("binary", "application/octet-stream", True)),
        (makers.docx(), "x.docx", ("office", media.OFFICE_TYPES[".docx"], False)),
        (makers.archive(("a", b"b")), "x.dat", ("zip", "application/zip", True)),
        (("é" * 8191).encode(), "noext", ("text", "text/plain", False)),
        (b"", ".env", ("text", "text/plain", False)),
    ],
)
def test_sniff(data, path, want):
    assert media.sniff(data, path) == want


def test_decode():
    assert media.decode("h\u00e9llo".encode("utf-16")) == ("h\u00e9llo", "utf-16-le")
    assert media.decode("\u4e2d\u6587\u6587\u672c".encode("gb18030")) == ("\u4e2d\u6587\u6587\u672c", "gb18030")
    assert media.decode(b"\xef\xbb\xbfabc")[0] == "abc" and media.decode("ab".encode("utf-16-le") * 20) == ("ab" * 20, "utf-16-le")
    assert media.decode(bytes(range(1, 32)) * 50) == (None, None)


def test_archives():
    inner = makers.archive(("deep.txt", b"mail ann@example.com"))
    data = makers.archive(("a.txt", b"x"), ("a.txt", b"y"), ("../up", b"z"), ("in.zip", inner), ("link", b"to", {"external_attr": 0o120777 << 16}), ("noted", b"n", {"comment": b"said"}), comment=b"c")
    assert rules(data, "x.zip") == ["archive.comment", "archive.comment", "archive.duplicate_name", "archive.path_traversal", "archive.symlink"]
    _, rows = events(data, "x.zip")
    assert {r[0] for r in rows} >= {"x.zip!/a.txt [duplicate 2]", "x.zip!/in.zip!/deep.txt"}
    gap = lambda found: {(n, v) for _, e, _, n, v, *_ in found if e == "gap"}
    assert ("structure", "compression_ratio_limit") in gap(events(makers.archive(("z", b"\0" * 1_000_000)), "x.zip")[1])
    assert ("structure", "expanded_size_limit") in gap(events(data, "x.zip", budget=1)[1])
    assert ("structure", "archive_depth_limit") in gap(events(data, "x.zip", max_archive_depth=1)[1])
    assert ("structure", "entry_limit") in gap(events(data, "x.zip", max_archive_entries=2)[1])
    forged = bytearray(data)
    at = forged.rfind(b"PK\x05\x06")
    forged[at + 10 : at + 12] = struct.pack("<H", 1)
    assert ("structure", "invalid_archive") in gap(events(bytes(forged), "x.zip")[1])
    assert ("structure", "invalid_archive") in gap(events(b"PK\x03\x04garbage", "x.zip")[1])


def test_office_packages():
    assert rules(makers.docx(), "x.docx") == ["office.app.application", "office.app.company", "office.comments", "office.core.creator", "office.core.last_modified_by", "office.custom_properties", "office.external_relationship", "office.tracked_changes"]
    assert rules(makers.xlsx(), "x.xlsx") == ["office.hidden_rows_columns", "office.hidden_sheet"]
    more = makers.docx([("word/vbaProject.bin", b"v"), ("customXml/item1.xml", "<a/>"), ("word/embeddings/o.bin", archives.OLE), ("ppt/notesSlides/n.xml", "<n/>"), ("xl/connections.xml", "<c/>"), ("_xmlsignatures/s.xml", "<s/>")])
    assert {"office.macro", "office.custom_xml", "office.embedded_object", "office.speaker_notes", "office.external_data", "office.digital_signature"} <= set(rules(more, "x.docx"))
    bomb = makers.archive(("word/document.xml", '<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>'))
    assert ("gap", "text", "word/document.xml") in events(bomb, "x.docx")[0]


def test_images_and_pdf():
    text = b"Comment\0mail ann@example.com"
    data = makers.png((b"tEXt", text), (b"eXIf", makers.exif(1)), (b"tIME", b"1234567"), (b"zTXt", b"k\0\0" + __import__("zlib").compress(b"packed")))
    assert rules(data, "x.png") == ["image.png_exif", "image.png_text", "image.png_time", "image.png_ztxt"]
    photo = makers.jpeg((0xE1, b"Exif\0\0" + makers.exif(1)), (0xE1, images.XMP[0] + b"<x/>"), (0xED, b"i"), (0xFE, b"said"))
    assert rules(photo, "x.jpg") == ["image.jpeg_comment", "image.jpeg_exif", "image.jpeg_iptc", "image.jpeg_xmp"]
    assert ("gap", "structure", "") in events(data[:-3], "x.png")[0] and ("gap", "ocr", "") in events(data, "x.png")[0]
    pdf = b"%PDF-1.4 /Author (A) /JavaScript /Authority <x:xmpmeta /Encrypt 3 0 R /OpenAction["
    assert rules(pdf, "x.pdf") == ["pdf.author", "pdf.encrypted", "pdf.javascript", "pdf.open_action", "pdf.xmp"]


def test_copies_without_metadata(spark):
    data = makers.png((b"tEXt", b"k\0v"), (b"eXIf", makers.exif(6)))
    out, removed, reason = images.strip_png(data)
    assert removed == 1 and reason == images.KEPT and rules(out, "x.png") == ["image.png_exif"]
    photo = makers.jpeg((0xE1, b"Exif\0\0" + makers.exif(1)), (0xFE, b"said"))
    out, removed, reason = images.strip_jpeg(photo)
    assert out == makers.jpeg() and removed == 2 and reason is None
    out, removed, reason = archives.strip_office(makers.docx())
    assert reason is None and removed == 5 and not {r for r in rules(out, "x.docx") if ".core." in r or ".app." in r or "custom" in r}
    assert archives.strip_office(makers.docx([("_xmlsignatures/s.xml", "<s/>")]))[1:] == (0, "digitally_signed_document")
    rows = [("a.png", makers.png((b"tEXt", b"k\0v"))), ("b.jpg", photo), ("c.docx", makers.docx()), ("d.txt", b"x"), ("e.png", b"\x89PNG\r\n\x1a\nbad")]
    got = {r.path: r for r in transform.transform(spark.createDataFrame([(p, bytearray(d)) for p, d in rows], "path string, content binary"), KEY).collect()}
    assert {p: r.status for p, r in got.items()} == {"a.png": "applied", "b.jpg": "applied", "c.docx": "applied", "d.txt": "not_needed", "e.png": "skipped"}
    assert all(f.preserved for r in got.values() for f in r.facets) and all(got[p].facets for p in ("a.png", "b.jpg", "c.docx"))
    assert bytes(got["d.txt"].copy) == b"x"


def test_scan_of_a_folder(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "sub").mkdir(parents=True)
    (root / "empty").mkdir()
    (root / ".git").mkdir()
    (root / "a.txt").write_text("mail ann@example.com\ntoken = 'abc123xyz'")
    (root / "sub" / "id_rsa").write_text("nothing")
    (root / "sub" / "bob@example.org.txt").write_text("clean")
    (root / "x.docx").write_bytes(makers.docx())
    (root / "x.zip").write_bytes(makers.archive(("in.txt", b"4111 1111 1111 1111")))
    (root / "big.txt").write_text("x" * 5000)
    os.symlink(root / "a.txt", root / "link")
    out = scan.scan_paths(spark, str(root), limits=scan.LIMITS | {"max_file_bytes": 4000}, key=KEY)
    gaps = {(r.path.removeprefix("tree/"), r.reason) for r in out["gaps"].collect()}
    assert gaps == {("big.txt", "file_size_limit"), ("link", "link_not_followed"), (".git", "vcs_history_not_scanned")}
    found = {(r.path.removeprefix("tree/"), r.rule_id) for r in out["findings"].collect()}
    assert {("a.txt", "pii.email"), ("a.txt", "secret.credential_assignment"), ("sub/id_rsa", "file.sensitive_name"), ("sub/<email:redacted>", "file.personal_name"), ("x.docx", "pii.email"), ("x.docx", "office.comments"), ("x.zip!/in.txt", "pii.bank_card")} <= found
    kinds = {r.path.removeprefix("tree/"): (r.kind, r.status) for r in out["artifacts"].collect()}
    assert kinds["a.txt"] == ("text", "scanned") and kinds["x.zip!/in.txt"][0] == "text"
    assert kinds["empty"] == ("directory", "scanned") and kinds["link"] == ("link", "partial") and kinds["big.txt"] == ("unread", "partial")
    assert {("link", "file.symlink"), (".git", "file.vcs_metadata")} <= found
    assert hygiene.violations(out).count() == 0
    reports.write_relations(out, str(tmp_path / "saved"))
    assert reports.read_relations(spark, str(tmp_path / "saved"))["findings"].count() == out["findings"].count()
    with pytest.raises(Exception, match="exists"):
        reports.write_relations(out, str(tmp_path / "saved"))


HIDDEN = {".env": "token = 'abc123xyz'", "_notes.txt": "mail ann@example.com", ".conf/a.txt": "mail bob@example.com", "_x/b.txt": "4111 1111 1111 1111", "ok.txt": "plain"}


def hidden_tree(root):
    for name, text in HIDDEN.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def test_files_with_hidden_names_are_scanned(spark, tmp_path):
    hidden_tree(tmp_path / "tree")
    out = scan.scan_paths(spark, str(tmp_path / "tree"))
    found = {(r.path.removeprefix("tree/"), r.rule_id) for r in out["findings"].collect()}
    assert found == {(".env", "secret.credential_assignment"), (".env", "file.sensitive_name"), ("_notes.txt", "pii.email"), (".conf/a.txt", "pii.email"), ("_x/b.txt", "pii.bank_card")}
    listed = files.listing(spark, str(tmp_path / "tree"))
    assert {os.path.relpath(f[0], tmp_path / "tree") for f in listed.files} == set(HIDDEN)
    assert out["artifacts"].count() == len(listed.files) + len(listed.others) and out["gaps"].count() == 0


def test_every_listed_entry_is_an_artifact_or_a_gap(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "deep" / "er" / "still").mkdir(parents=True)
    for k in range(6):
        (root / f"f{k}.txt").write_text("x" * (10 + k))
    (root / "deep" / "er" / "still" / "z.txt").write_text("z")
    os.mkfifo(root / "pipe")
    gaps = lambda *paths, **limits: {(r.path, r.reason) for r in scan.scan_paths(spark, *map(str, paths), limits=scan.LIMITS | limits)["gaps"].collect()}
    assert gaps(root) == {("tree/pipe", "special_file")}
    assert ("tree/deep/er/still", "directory_depth_limit") in gaps(root, max_directory_depth=2)
    assert (None, "file_count_limit") in gaps(root, max_files=3)
    assert {("tree/f5.txt", "total_size_limit"), ("tree/f4.txt", "total_size_limit")} <= gaps(root, max_total_bytes=50)
    out = scan.scan_paths(spark, str(root / "f0.txt"), str(tmp_path / "gone"))
    assert [r.code for r in out["errors"].collect()] == ["path_unavailable"] and out["artifacts"].count() == 1


def test_reads_are_of_the_listed_file(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_text("first")
    (_, size, device, inode, time, _), = files.listing(spark, str(path)).files
    assert files.read_verified(str(path), size, device, inode, time, 100) == (b"first", None)
    assert files.read_verified(str(path), size, device, inode, time, 3) == (None, "file_size_limit")
    assert files.read_verified(str(path), size, device, inode + 1, time, 100) == (None, "file_identity_changed_before_read")
    os.rename(path, tmp_path / "b.txt")
    os.symlink(tmp_path / "b.txt", path)
    assert files.read_verified(str(path), size, device, inode, time, 100) == (None, "read_error")
    found = files.listing(spark, str(tmp_path / "b.txt"))
    (tmp_path / "b.txt").write_text("other text")
    assert [(r.content, r.reason) for r in files.contents(spark, found).collect()] == [(None, "file_identity_changed_before_read")]


def test_archives_with_forged_counts(spark):
    data = makers.archive(*[(f"e{k}", b"x") for k in range(50)])
    at = data.rfind(b"PK\x05\x06")
    forged = data[: at + 8] + struct.pack("<HH", 1, 1) + data[at + 12 :]
    for most, why in ((2, "entry_limit"), (100, "invalid_archive")):
        with pytest.raises(archives.Refused, match=why):
            archives.entry_count(forged, most)
    assert archives.entry_count(data, 50) == archives.entry_count(b"some prefix" + data, 50) == 50
    with pytest.raises(archives.Refused, match="entry_limit"):
        archives.entry_count(data, 49)
    assert not [e for e in events(forged, "x.zip", max_archive_entries=2)[1] if "!/" in e[0]]


def test_missing_readers_are_dependencies(spark, tmp_path):
    (tmp_path / "p.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "i.png").write_bytes(makers.png())
    out = scan.scan_paths(spark, str(tmp_path))
    assert {(r.name, r.available) for r in out["dependencies"].collect()} == {("pdf_reader", False), ("image_reader", False)}


def test_saved_reports_are_strict(tmp_path):
    path = str(tmp_path / "r.json")
    reports.save({"summary": {"verdict": "review"}, "findings": [1]}, path)
    assert reports.load(path)["findings"] == [1] and os.stat(path).st_mode & 0o777 == 0o600
    with pytest.raises(FileExistsError):
        reports.save({}, path)
    reports.save({"findings": ["x" * 500]}, str(tmp_path / "s.json"), most=200)
    assert json.loads((tmp_path / "s.json").read_text())["gaps"]
    for bad in (b'{"a":1,"a":2}', b'{"a":NaN}', b"[1]", b"\xff", b"\xef\xbb\xbf{}"):
        with pytest.raises(reports.ReportError):
            reports.parse(bad)


def test_policies(tmp_path):
    p = policy.resolve({"fail_on": "low"}, {"fail_on": "medium", "limits": {"max_files": 5}}, {"limits": {"max_pdf_pages": 2}, "blocking_categories": ["b", "a", "a"]})
    assert (p.fail_on, p.limits, p.blocking_categories) == ("medium", {"max_files": 5, "max_pdf_pages": 2}, ("a", "b"))
    assert p.digest() == policy.resolve({"fail_on": "medium", "limits": {"max_pdf_pages": 2, "max_files": 5}, "blocking_categories": ["a", "b"]}).digest()
    for bad in ({"fail_on": "huge"}, {"other": 1}, {"limits": {"max_files": True}}, {"limits": {"nope": 1}}, {"optional_tools": 1}, {"blocking_categories": "pii"}):
        with pytest.raises(policy.PolicyError):
            policy.resolve(bad)
    (tmp_path / "p.toml").write_text('fail_on = "critical"\n[limits]\nmax_files = 3\n')
    assert policy.load(str(tmp_path / "p.toml")).fail_on == "critical"


def test_empty_scans_and_states(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found = report.findings(docs, ["doc_id"])
    row = report.exit_code(report.summary(report.artifacts(docs, found, report.cap(found, ["doc_id"], ["start"], 5)[1], ["doc_id"]))).first()
    assert (row.verdict, row.exit_code, row.artifacts_total) == ("no_findings", 0, 0)
    states = compare.occurrences(compare.sides(found, found, ["doc_id"]), ["doc_id"])
    assert compare.outcome(states, "no_findings", "no_findings").first().ready_for_review
    assert compare.outcome(states, "incomplete", "review").first().outcome == "incomplete"


def test_receipts_and_approvals(spark):
    changed = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    actions = spark.createDataFrame([("a", "strip", "applied"), ("b", "strip", "applied"), ("b", "strip", "applied")], "path string, action string, status string")
    proof = spark.createDataFrame([("a", "strip", [("f", True)]), ("b", "strip", [("f", True)])], "path string, action string, facets array<struct<facet:string,preserved:boolean>>")
    assert {r.path: r.explained for r in compare.receipts(changed, actions, proof).collect()} == {"a": True, "b": False, "c": False}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "action_id string")
    assert {(r.action_id, r.state) for r in inventory.approved(ids("1", "2"), ids("2", "3")).collect()} == {("1", "unapproved"), ("3", "unknown")}
    assert inventory.drift(ids("1"), ids("1")).isEmpty() and inventory.drift(ids("1", "1"), ids("1")).count() == 1


def test_paths_of_one_name_in_two_forms_collide(spark):
    rows = [("caf\u00e9/a",), ("cafe\u0301/b",), ("Stra\u00dfe",), ("STRASSE",), ("plain",)]
    tree = spark.createDataFrame(rows, "path string")
    assert {(r.key, r.kind) for r in inventory.collisions(tree).collect()} == {("caf\u00e9", "folder_spelling"), ("strasse", "same_file")}
    order = inventory.sort_key(tree, "path", "k").orderBy("k").select("path").collect()
    assert [r.path for r in order] == ["caf\u00e9/a", "cafe\u0301/b", "plain", "STRASSE", "Stra\u00dfe"]


def test_prefixes_and_issues(spark):
    rows = spark.createDataFrame([(k, "x" * 10) for k in range(20)], "n long, text string")
    size = len('{"n":1,"text":"xxxxxxxxxx"}') + 1
    assert sorted(r.n for r in inventory.fitting_prefix(rows, "n", 5 * size).collect()) == [0, 1, 2, 3, 4]
    a = spark.createDataFrame([("gone", "action-1", "p", "first"), ("odd", None, "q", "first")], "code string, action_id string, path string, detail string")
    b = spark.createDataFrame([("gone", "action-1", "p", "second"), ("new", "action-2", "p", "second")], a.schema)
    assert {(r.code, r.detail) for r in inventory.merge_issues(a, b).collect()} == {("gone", "first"), ("odd", "first"), ("new", "second")}


def test_containment_and_streams(tmp_path):
    (tmp_path / "in").mkdir()
    os.symlink("/etc", tmp_path / "in" / "out")
    assert files.within(str(tmp_path / "in" / "x"), str(tmp_path / "in")) and files.within(str(tmp_path / "in"), str(tmp_path / "in"))
    assert not files.within(str(tmp_path / "in" / "out" / "x"), str(tmp_path / "in")) and not files.within(str(tmp_path / "inner"), str(tmp_path / "in"))
    assert files.has_stream("a.txt:hidden") and files.has_stream("C:\\x:y") and not files.has_stream("C:\\x") and not files.has_stream("a/b")


def test_long_fields_are_bounded(spark):
    content = [("/d/a.zip", makers.archive(("n" * 400 + "/a.txt", b"x@example.test")))]
    out = scan.scan(spark.createDataFrame([(p, bytearray(c)) for p, c in content], "path string, content binary"), scan.LIMITS | {"max_field_chars": 4})
    assert (None, "report_field_limit") in {(g.path, g.reason) for g in out["gaps"].collect()}
    assert {r.evidence for r in out["findings"].where("rule_id = 'pii.email'").collect()} == {hygiene.OMITTED}


def test_reasons_not_to_rewrite_a_package():
    why = lambda data, path="x.docx": archives.strip_office(data, path)[2]
    assert why(b"PK\x03\x04 nothing") == "malformed_ooxml"
    assert why(makers.archive(*[(f"p{k}", b"x") for k in range(2001)])) == "package_resource_limit"
    assert why(makers.docx([("WORD/document.xml", "<x/>")])) == why(makers.docx([("../up.xml", "<x/>")])) == "unsafe_or_ambiguous_package_structure"
    assert why(makers.docx(), "x.xlsx") == why(makers.docx(), "x.zip") == "ooxml_type_mismatch"
    assert why(makers.docx([("word/vbaProject.bin", b"v")])) == why(makers.docx(), "x.docm") == "macro_enabled_document"
    assert why(makers.docx([("word/embeddings/o.bin", b"x")])) == why(makers.docx([("word/media/o.bin", archives.OLE + b"x")])) == "embedded_object_not_supported"
    assert why(makers.docx([("word/big.bin", b"\0" * (40 << 20))])) == "package_resource_limit"
    assert why(makers.docx([("word/bad.xml", "<x>")])) == why(makers.docx([("word/bad.xml", "<!DOCTYPE a><a/>")])) == "package_rewrite_error"
    assert why(makers.docx()) is None


def test_targets_of_relationships():
    part = archives.target_part
    assert part("_rels/.rels", "docProps/custom.xml") == part("_rels/.rels", "/docProps/custom.xml") == part("word/_rels/document.xml.rels", "../docProps/./custom.xml") == "docProps/custom.xml"
    assert part("word/_rels/document.xml.rels", "media/a%20b.png?x#y") == "word/media/a b.png"
    for target in ("http://example.test/a", "//host/a", "../../up", "", "a\\b", "#only", "a%00b"):
        assert part("word/_rels/document.xml.rels", target) is None
    assert part("word/document.xml", "a") is None


def test_facets_of_packages_are_canonical():
    before = makers.docx()
    after = archives.strip_office(before)[0]
    a, b = archives.office_facets(before), archives.office_facets(after)
    assert a == b and any(n.startswith("canonical:") for n in a)
    changed = makers.docx([("word/more.xml", "<x/>")])
    assert archives.office_facets(changed) != a


def test_comments_share_one_budget():
    data = makers.archive(("a", b"x", {"comment": b"c" * 30}), ("b", b"x", {"comment": b"mail ann@example.com"}), comment=b"d" * 30)
    found, rows = events(data, "x.zip", max_text_bytes=60)
    assert ("gap", "text", "b") in found and ("gap", "text", "a") not in found
    assert [r[4] for r in rows if r[1] == "gap"] == ["archive_comment_text_limit"]


def test_exif_tells_place_person_and_device():
    data = makers.exif_of([(0x010F, b"Cam\0"), (0x013B, b"mail ann@example.com\0"), (0x8825, 1)], [(0xA431, b"SN-12345\0"), (0x9003, b"2024:01:01 00:00:00\0")])
    assert images.exif_facts(data) == (True, 2, 2, "Cam\nmail ann@example.com\nSN-12345\n2024:01:01 00:00:00")
    for picture, path in ((makers.jpeg((0xE1, b"Exif\0\0" + data)), "x.jpg"), (makers.png((b"eXIf", data)), "x.png")):
        found, rows = events(picture, path)
        assert {"image.gps", "image.identity", "image.device"} <= set(rules(picture, path))
        assert any(r[1] == "text" and "ann@example.com" in r[6] for r in rows)
    assert not {"image.gps", "image.identity"} & set(rules(makers.jpeg((0xE1, b"Exif\0\0" + makers.exif(1))), "x.jpg"))
    assert ("gap", "metadata", "JPEG/0xe1") in events(makers.jpeg((0xE1, b"Exif\0\0II*\0\xff\xff\0\0")), "x.jpg")[0]
    assert images.orientation(b"Exif\0\0" + makers.exif(6)) == (6, True) and images.orientation(b"II") == (None, False)


def test_reports_refuse_half_characters(tmp_path):
    with pytest.raises(reports.ReportError, match="not_unicode"):
        reports.parse(b'{"a": "\\ud800"}')


def test_archives_of_a_scan_share_one_budget(spark, tmp_path):
    for name in ("a.zip", "b.zip", "c.zip"):
        (tmp_path / name).write_bytes(makers.archive((f"in-{name}.txt", os.urandom(500).hex().encode())))
    (tmp_path / "d.txt").write_text("PK is no archive")
    out = scan.scan_paths(spark, str(tmp_path), limits=scan.LIMITS | {"max_archive_expanded_bytes": 2500})
    assert [(r.path.rpartition("/")[2], r.reason) for r in out["gaps"].collect()] == [("c.zip", "expanded_size_limit")]
    found = files.listing(spark, str(tmp_path))
    assert [v for _, v in sorted(files.expansion_budgets(spark, found, scan.LIMITS | {"max_archive_expanded_bytes": 2500}).items())] == [2500, 1500, 500]
