"""Small binary files for tests, made with the standard library. All values are made up."""

import io
import struct
import zipfile
import zlib


def png(*chunks):
    body = lambda k, p: struct.pack(">I", len(p)) + k + p + struct.pack(">I", zlib.crc32(k + p))
    head = struct.pack(">IIBBBBB", 1, 1, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + body(b"IHDR", head) + b"".join(body(k, p) for k, p in chunks) + body(b"IDAT", zlib.compress(b"\0\1\2\3\4")) + body(b"IEND", b"")


def exif(turn):
    return b"II*\0" + struct.pack("<IHHHIHHI", 8, 1, 0x0112, 3, 1, turn, 0, 0)


def exif_of(first, more=()):
    """EXIF data with ASCII values by tag in both directories; a value of None is a pointer of no use."""

    def directory(entries, at, extra):
        out, rest = struct.pack("<H", len(entries)), b""
        base = at + 2 + 12 * len(entries) + 4
        for tag, value in entries:
            if isinstance(value, int):
                out += struct.pack("<HHII", tag, 4, 1, value)
            elif len(value) <= 4:
                out += struct.pack("<HHI4s", tag, 2, len(value), value)
            else:
                out += struct.pack("<HHII", tag, 2, len(value), base + len(rest))
                rest += value
        return out + b"\0" * 4 + rest

    first = [*first, *([(0x8769, 0)] if more else [])]
    size = len(directory(first, 8, b""))
    if more:
        first[-1] = (0x8769, 8 + size)
    return b"II*\0\x08\0\0\0" + directory(first, 8, b"") + (directory(list(more), 8 + size, b"") if more else b"")


def jpeg(*segments):
    one = lambda m, p: b"\xff" + bytes([m]) + struct.pack(">H", len(p) + 2) + p
    return b"\xff\xd8" + b"".join(one(m, p) for m, p in segments) + one(0xDB, b"\0" * 65) + one(0xC0, b"\x08\0\1\0\1\1\1\x11\0") + one(0xDA, b"\1\1\0\0?\0") + b"ab\xff\0cd\xff\xd0ef\xff\xd9"


def archive(*members, comment=b""):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data, *more in members:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            for attribute, value in more[0].items() if more else ():
                setattr(info, attribute, value)
            z.writestr(info, data)
        z.comment = comment
    return box.getvalue()


def docx(extra=()):
    ct = '<Types xmlns="c"><Override PartName="/word/document.xml" ContentType="x"/><Override PartName="/docProps/custom.xml" ContentType="y"/></Types>'
    rels = '<Relationships xmlns="r"><Relationship Id="1" Target="word/document.xml"/><Relationship Id="2" Target="docProps/custom.xml"/></Relationships>'
    core = '<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:creator>Ann</dc:creator><cp:lastModifiedBy>Bob</cp:lastModifiedBy><dc:title></dc:title></cp:coreProperties>'
    app = '<Properties xmlns="a"><Company>Acme</Company><Application>Writer</Application></Properties>'
    body = '<w:document xmlns:w="w"><w:r><w:t>mail ann@exam</w:t></w:r><w:r><w:t>ple.com now</w:t></w:r><w:ins><w:t>new</w:t></w:ins></w:document>'
    outer = '<Relationships xmlns="r"><Relationship Id="1" Target="https://example.org" TargetMode="External"/></Relationships>'
    return archive(("[Content_Types].xml", ct), ("_rels/.rels", rels), ("docProps/core.xml", core), ("docProps/app.xml", app), ("docProps/custom.xml", '<Properties xmlns="p"><property name="k">v</property></Properties>'), ("word/document.xml", body), ("word/comments.xml", "<c/>"), ("word/_rels/document.xml.rels", outer), *extra)


def xlsx():
    return archive(("xl/workbook.xml", '<workbook><sheets><sheet name="a" state="veryHidden"/></sheets></workbook>'), ("xl/worksheets/sheet1.xml", '<worksheet><row hidden="1"/><col hidden="0"/></worksheet>'))
