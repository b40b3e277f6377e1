"""ZIP archives and Office packages: what they hold, with budgets, and copies without document properties."""

from __future__ import annotations

import io
import re
import stat
import struct
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree

from sieveline.functions.fixed import LIMITS

OLE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
#: Properties of the core and app parts (fixed values).
CORE = ("creator", "lastModifiedBy", "title", "subject", "description", "keywords", "category", "identifier", "created", "modified", "lastPrinted", "revision", "contentStatus", "language", "version")
APP = ("Manager", "Company", "HyperlinkBase", "Application", "AppVersion", "Template")
DAWN = (1980, 1, 1, 0, 0, 0)


class Refused(ValueError):
    """A container that is not opened; args[0] says why."""


def snake(name: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z][a-z])", "_", name).lower()


def _directory(data: bytes) -> tuple[int, int, int]:
    """(where the central directory begins, where it ends, entries declared) by the end record, also in ZIP64 form."""
    least = max(0, len(data) - 65_557)
    at = data.rfind(b"PK\x05\x06", least)
    while at >= 0 and (at + 22 > len(data) or at + 22 + struct.unpack_from("<H", data, at + 20)[0] != len(data)):
        at = data.rfind(b"PK\x05\x06", least, at)
    if at < 0:
        raise Refused("invalid_archive")
    disk, start_disk, here, n, size, offset = struct.unpack_from("<4H2L", data, at + 4)
    end = at
    if 0xFFFF in (here, n) or 0xFFFFFFFF in (size, offset):
        if at < 20 or data[at - 20 : at - 16] != b"PK\x06\x07":
            raise Refused("invalid_archive")
        end = data.rfind(b"PK\x06\x06", 0, at - 20)
        if end < 0 or end + 56 > at - 20 or end + 12 + struct.unpack_from("<Q", data, end + 4)[0] != at - 20:
            raise Refused("invalid_archive")
        disk, start_disk, here, n, size, offset = struct.unpack_from("<2L4Q", data, end + 16)
    if disk or start_disk or here != n or size > end:
        raise Refused("invalid_archive")
    return end - size, end, n


def entry_count(data: bytes, most: int) -> int:
    """Entries of the central directory, counted record by record before any entry is made; what the end record declares is not believed."""
    at, end, declared = _directory(data)
    n = 0
    while at < end:
        if data[at : at + 4] != b"PK\x01\x02" or at + 46 > end:
            if data[at : at + 4] == b"PK\x05\x05":  # a signature of the directory ends it
                break
            raise Refused("invalid_archive")
        at += 46 + sum(struct.unpack_from("<3H", data, at + 28))
        n += 1
        if n > most:
            raise Refused("entry_limit")
    if at > end or n != declared:
        raise Refused("invalid_archive")
    return n


def declared(data: bytes, most: int) -> int:
    """Bytes that the first `most` entries say they expand to; none for what is no archive."""
    try:
        at, end, _ = _directory(data)
    except Refused:
        return 0
    size = n = 0
    while at + 46 <= end and data[at : at + 4] == b"PK\x01\x02" and n < most:
        size += struct.unpack_from("<I", data, at + 24)[0]
        at += 46 + sum(struct.unpack_from("<3H", data, at + 28))
        n += 1
    return size


@dataclass
class Member:
    name: str
    occurrence: int
    size: int
    unsafe: bool
    link: bool
    encrypted: bool
    comment: bytes
    dated: bool
    refused: str | None = None
    data: bytes | None = None


def unsafe_name(name: str) -> bool:
    """Absolute, with a drive or a null, or climbing out."""
    plain = name.replace("\\", "/")
    return not plain or "\0" in plain or plain.startswith("/") or re.match(r"[A-Za-z]:[/\\]", name) is not None or ".." in plain.split("/")


def members(data: bytes, budget: list[int], limits: dict = LIMITS) -> Iterator[Member]:
    """Members with their data where that is within all limits. budget[0] is what may still be expanded."""
    entry_count(data, limits["max_archive_entries"])
    try:
        box = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError, NotImplementedError) as e:
        raise Refused("invalid_archive") from e
    seen: Counter = Counter()
    with box:
        for info in box.infolist():
            if info.is_dir():
                continue
            seen[info.filename] += 1
            m = Member(info.filename, seen[info.filename], info.file_size, unsafe_name(info.filename), stat.S_ISLNK(info.external_attr >> 16), bool(info.flag_bits & 1), info.comment, info.date_time != DAWN)
            ratio = info.file_size / max(1, info.compress_size)
            if m.link:
                m.refused = "symlink"
            elif m.encrypted:
                m.refused = "encrypted"
            elif info.file_size > limits["max_archive_member_bytes"]:
                m.refused = "member_size_limit"
            elif ratio > limits["max_archive_ratio"]:
                m.refused = "compression_ratio_limit"
            elif info.file_size > budget[0]:
                m.refused = "expanded_size_limit"
            else:
                try:
                    with box.open(info) as f:
                        m.data = f.read(info.file_size + 1)
                except (zipfile.BadZipFile, zlib.error, EOFError, OSError, NotImplementedError, RuntimeError):
                    m.data, m.refused = None, "member_unreadable"
                if m.data is not None:
                    if len(m.data) > info.file_size:
                        m.data, m.refused = None, "declared_size_mismatch"
                    else:
                        budget[0] -= len(m.data)
            yield m


def archive_comment(data: bytes) -> bytes:
    at = data.rfind(b"PK\x05\x06", max(0, len(data) - 65_557))
    return data[at + 22 :] if at >= 0 else b""


def parse_xml(data: bytes) -> ElementTree.Element:
    """An XML tree with comments and instructions; document types and entities are refused in any encoding."""
    plain = data.replace(b"\0", b"").lower()
    if b"<!doctype" in plain or b"<!entity" in plain:
        raise Refused("xml_declares_entities")
    try:
        builder = ElementTree.TreeBuilder(insert_comments=True, insert_pis=True)
        return ElementTree.fromstring(data, ElementTree.XMLParser(target=builder))
    except (ElementTree.ParseError, LookupError, ValueError) as e:
        raise Refused("xml_invalid") from e


def local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def xml_text(root: ElementTree.Element) -> str:
    """Text of all runs without anything between them (values may be cut across runs), then the attributes, a line each."""
    runs, attributes, todo = [], [], [(root, False)]
    while todo:
        node, after = todo.pop()
        if after:
            runs.append(node.tail or "")
            continue
        runs.append(node.text or "")
        attributes += node.attrib.values()
        for child in reversed(node):
            todo += [(child, True), (child, False)]
    return "".join(runs) + "".join(f"\n{v}" for v in attributes if v)


def office_rules(parts: dict[str, bytes]) -> Iterator[tuple[str, str, int]]:
    """(rule, part, count) of what a package holds beside its text. Parts by name."""
    lower = {n: n.lower() for n in parts}
    has = lambda test: [n for n in parts if test(lower[n])]
    trees = {}
    for n in parts:
        if lower[n].endswith((".xml", ".rels")):
            try:
                trees[n] = parse_xml(parts[n])
            except Refused:
                continue
    types = " ".join(v for t in trees.values() for e in t.iter() for k, v in e.attrib.items() if local(k) in ("ContentType", "Type")).lower()
    if has(lambda n: n.endswith("vbaproject.bin")) or "macroenabled" in types or "vbaproject" in types:
        yield "office.macro", "", 1
    if has(lambda n: "_xmlsignatures/" in n) or "digital-signature" in types:
        yield "office.digital_signature", "", 1
    if found := has(lambda n: re.search(r"(?:^|/)(?:comments|threadedcomments)[^/]*(?:/|\.xml$)", n)):
        yield "office.comments", "", len(found)
    if found := has(lambda n: n.startswith("ppt/notesslides/") and n.endswith(".xml")):
        yield "office.speaker_notes", "", len(found)
    if has(lambda n: n.startswith("customxml/")):
        yield "office.custom_xml", "", 1
    if has(lambda n: "/embeddings/" in n or "/activex/" in n) or any(p.startswith(OLE) for p in parts.values()):
        yield "office.embedded_object", "", 1
    for n, tree in trees.items():
        name, count = lower[n], Counter(local(e.tag) for e in tree.iter())
        on = lambda e, key, off=("", "0", "false", "off"): next((v.lower() for k, v in e.attrib.items() if local(k) == key), "") not in off
        if name == "docprops/core.xml":
            yield from ((f"office.core.{snake(local(e.tag))}", n, 1) for e in tree if local(e.tag) in CORE and "".join(e.itertext()).strip())
        if name == "docprops/app.xml":
            yield from ((f"office.app.{snake(local(e.tag))}", n, 1) for e in tree if local(e.tag) in APP and "".join(e.itertext()).strip())
        if name == "docprops/custom.xml" and count["property"]:
            yield "office.custom_properties", n, count["property"]
        if name.endswith(".rels") and (found := sum(e.attrib.get("TargetMode", "").lower() == "external" for e in tree.iter())):
            yield "office.external_relationship", n, found
        if name.startswith("word/") and (found := sum(count[x] for x in ("ins", "del", "moveFrom", "moveTo"))):
            yield "office.tracked_changes", n, found
        if name.startswith("xl/worksheets/") and (found := sum(local(e.tag) in ("row", "col") and on(e, "hidden") for e in tree.iter())):
            yield "office.hidden_rows_columns", n, found
        if name == "xl/workbook.xml" and (found := sum(local(e.tag) == "sheet" and e.attrib.get("state", "visible").lower() != "visible" for e in tree.iter())):
            yield "office.hidden_sheet", n, found
        if name == "ppt/presentation.xml" and (found := sum(local(e.tag) == "sldId" and e.attrib.get("show", "1").lower() in ("0", "false", "off") for e in tree.iter())):
            yield "office.hidden_slide", n, found
        if "externallinks/" in name or name.endswith("connections.xml"):
            yield "office.external_data", n, 1


#: The part that makes a package a document of its kind, by extension, and extensions of macro-enabled ones (fixed values).
MAIN_PARTS = {".docx": "word/document.xml", ".docm": "word/document.xml", ".xlsx": "xl/workbook.xml", ".xlsm": "xl/workbook.xml", ".pptx": "ppt/presentation.xml", ".pptm": "ppt/presentation.xml"}
MACRO_EXTENSIONS = (".docm", ".xlsm", ".pptm")
CUSTOM = "docprops/custom.xml"


def target_part(relations: str, target: str) -> str | None:
    """The part, from the package's root on, that a target in a relationships part means; None for anything outside of the package."""
    owner = re.fullmatch(r"(?:(.*)/)?_rels/([^/]*)\.rels", relations.replace("\\", "/").strip("/"), re.I)
    split = urlsplit(target) if target.count("[") == target.count("]") else None
    if owner is None or split is None or split.scheme or split.netloc or not split.path:
        return None
    path = unquote(split.path)
    if "\\" in path or "\0" in path:
        return None
    base = "" if path.startswith("/") else f"{owner[1] or ''}/"
    out: list[str] = []
    for step in (base + path).split("/"):
        if step == ".." and not out:
            return None
        out = out[:-1] if step == ".." else [*out, step] if step not in ("", ".") else out
    return "/".join(out)


def _types(root: ElementTree.Element) -> str:
    return " ".join(v for e in root.iter() for k, v in e.attrib.items() if local(k) in ("ContentType", "Type")).lower()


def reason_against(found: list[Member], path: str, limits: dict = LIMITS) -> str | None:
    """Why a package may not be rewritten, the first of the reasons; None if it may."""
    names = [m.name.replace("\\", "/").lower() for m in found]
    ending = "." + path.lower().rpartition(".")[2]
    refused = {m.refused for m in found} - {None}
    folders = {f for n in names for f in n.split("/")}
    raw = {n: m.data or b"" for n, m in zip(names, found, strict=True)}
    xml = {n: d for n, d in raw.items() if n.endswith((".xml", ".rels"))}
    by_name = (
        ("unsafe_or_ambiguous_package_structure", len(set(names)) < len(names) or any(m.unsafe for m in found) or refused & {"symlink", "encrypted"}),
        ("ooxml_type_mismatch", not {"[content_types].xml", MAIN_PARTS.get(ending)} <= set(names)),
        ("macro_enabled_document", ending in MACRO_EXTENSIONS or any("vbaproject.bin" in n or n.endswith("/vbadata.xml") for n in names)),
        ("embedded_object_not_supported", folders & {"embeddings", "activex"}),
        ("package_resource_limit", refused & {"member_size_limit", "compression_ratio_limit", "expanded_size_limit"}),
        ("package_part_size_mismatch", "declared_size_mismatch" in refused),
        ("package_rewrite_error", refused),
        ("embedded_object_not_supported", any(d.startswith(OLE) for n, d in raw.items() if n not in xml)),
        ("xml_part_size_limit", any(len(d) > limits["max_xml_bytes"] for d in xml.values())),
    )
    for reason, holds in by_name:
        if holds:
            return reason
    try:
        said = {n: _types(parse_xml(d)) for n, d in xml.items()}
    except Refused:
        return "package_rewrite_error"
    links = [t for n, t in said.items() if n.endswith(".rels") or n == "[content_types].xml"]
    by_content = (
        ("macro_enabled_document", ("macroenabled", "vbaproject"), said.values()),
        ("embedded_object_not_supported", ("/oleobject", "oleobject+", "/package\"", "activex"), links),
        ("digitally_signed_document", ("digital-signature",), links),
    )
    for reason, words, texts in by_content:
        if any(w in t for t in texts for w in words):
            return reason
    return "digitally_signed_document" if "_xmlsignatures" in folders else None


def without_properties(name: str, part: bytes) -> tuple[bytes, int, int]:
    """(a part without the properties that are to go and without references to custom ones, properties that went, references that went); the part itself if none did."""
    low = name.lower()
    wanted = {"docprops/core.xml": CORE, "docprops/app.xml": APP}.get(low, ())
    types = low == "[content_types].xml"
    if not wanted and not types and not low.endswith(".rels"):
        return part, 0, 0
    root = parse_xml(part)
    properties, references = [], []
    for e in root:
        a = {local(k) or k: v for k, v in e.attrib.items()}
        if local(e.tag) in wanted and ("".join(e.itertext()).strip() or e.attrib):
            properties.append(e)
        elif types and local(e.tag) == "Override" and a.get("PartName", "").startswith("/") and (target_part("_rels/.rels", a["PartName"]) or "").lower() == CUSTOM:
            references.append(e)
        elif low.endswith(".rels") and local(e.tag) == "Relationship" and a.get("TargetMode", "").strip().lower() != "external" and (target_part(name, a.get("Target", "")) or "").lower() == CUSTOM:
            references.append(e)
    for e in [*properties, *references]:
        root.remove(e)
    out = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True) if properties or references else part
    return out, len(properties), len(references)


def office_facets(data: bytes) -> dict[str, bytes]:
    """What a copy must keep, by name: parts as they are, and canonical XML of those that lose properties or references, without these."""
    out = {}
    for m in members(data, [LIMITS["max_archive_expanded_bytes"]]):
        low = m.name.lower()
        if low == CUSTOM or m.data is None:
            continue
        if low in ("docprops/core.xml", "docprops/app.xml", "[content_types].xml") or low.endswith(".rels"):
            plain = without_properties(m.name, m.data)[0]
            out[f"canonical:{m.name}"] = ElementTree.canonicalize(plain.decode("utf-8-sig", "replace"), with_comments=True, rewrite_prefixes=True).encode()
        else:
            out[m.name] = m.data
    return out


def strip_office(data: bytes, path: str = "x.docx") -> tuple[bytes, int, str | None]:
    """(copy without core, app and custom properties and with plain entry metadata, how many went, why not)."""
    try:
        found = list(members(data, [LIMITS["max_archive_expanded_bytes"]]))
    except Refused as e:
        return data, 0, "package_resource_limit" if e.args[0] == "entry_limit" else "malformed_ooxml"
    if reason := reason_against(found, path):
        return data, 0, reason
    kept, removed, references = {}, 0, 0
    for m in found:
        if m.name.lower() == CUSTOM:
            removed += 1
            continue
        kept[m.name], properties, links = without_properties(m.name, m.data)
        removed, references = removed + properties, references + links
    if not removed and not references and not any(m.comment or m.dated for m in found) and not archive_comment(data):
        return data, 0, None
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as z:
        for n, part in kept.items():
            z.writestr(zipfile.ZipInfo(n, DAWN), part, zipfile.ZIP_DEFLATED)
    return box.getvalue(), removed, None
