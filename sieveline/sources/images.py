"""PNG chunks and JPEG segments: reading them, and copies without metadata."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

PNG = b"\x89PNG\r\n\x1a\n"
#: Chunks and segments that hold metadata (fixed values).
PNG_METADATA = ("eXIf", "tEXt", "zTXt", "iTXt", "tIME")
XMP = (b"http://ns.adobe.com/xap/1.0/\0", b"http://ns.adobe.com/xmp/extension/\0")
MOST_CHUNKS = 4096


class LimitError(ValueError):
    pass


def png_chunks(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(kind, payload) of each chunk; lengths, checksums and the end are checked."""
    at, n = len(PNG), 0
    if not data.startswith(PNG):
        raise ValueError("no PNG")
    while True:
        n += 1
        if n > MOST_CHUNKS:
            raise LimitError("too many chunks")
        head = data[at : at + 8]
        if len(head) < 8:
            raise ValueError("cut chunk")
        size, kind = struct.unpack(">I4s", head)
        end = at + 12 + size
        if end > len(data) or not kind.isalpha():
            raise ValueError("bad chunk")
        payload = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[end - 4 : end])[0] != zlib.crc32(kind + payload):
            raise ValueError("bad checksum")
        yield kind.decode("ascii"), payload
        at = end
        if kind == b"IEND":
            if at != len(data):
                raise ValueError("data after the end")
            return


def inflate(data: bytes, most: int) -> bytes:
    """Decompressed data of at most `most` bytes."""
    box = zlib.decompressobj()
    try:
        out = box.decompress(data, most + 1)
    except zlib.error as e:
        raise ValueError("bad compression") from e
    if len(out) > most or not box.eof and box.unconsumed_tail:
        raise LimitError("too large")
    if not box.eof:
        raise ValueError("cut compression")
    return out


def png_text(kind: str, payload: bytes, most: int) -> str:
    """Keyword and text of a text chunk; nothing for other chunks."""
    if kind not in ("tEXt", "zTXt", "iTXt"):
        return ""
    key, split, rest = payload.partition(b"\0")
    if not split:
        raise ValueError("no keyword")
    if kind == "tEXt":
        body = rest.decode("latin-1")
    elif kind == "zTXt":
        if rest[:1] != b"\0":
            raise ValueError("unknown method")
        body = inflate(rest[1:], most).decode("latin-1")
    else:
        packed, rest = rest[:2], rest[2:]
        parts = rest.split(b"\0", 2)
        if len(parts) < 3 or packed[:1] not in (b"\0", b"\1"):
            raise ValueError("bad international text")
        raw = inflate(parts[2], most) if packed[:1] == b"\1" else parts[2]
        body = "\n".join(x.decode("utf-8", "replace") for x in (*parts[:2], raw) if x)
    text = key.decode("latin-1") + "\n" + body
    if len(text.encode()) > most:
        raise LimitError("too large")
    return text


def jpeg_segments(data: bytes) -> Iterator[tuple[int, bytes, int, int]]:
    """(marker, payload, start, end) of each segment, also of those between scans."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at = 2
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker")
        start = at
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            raise ValueError("cut marker")
        marker = data[at]
        at += 1
        if marker == 0xD9:
            return
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            continue
        if at + 2 > len(data):
            raise ValueError("cut length")
        size = int.from_bytes(data[at : at + 2], "big")
        end = at + size
        if size < 2 or end > len(data):
            raise ValueError("bad length")
        yield marker, data[at + 2 : end], start, end
        at = end
        if marker == 0xDA:  # picture data up to a marker that is neither stuffing nor a restart
            while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data) and (data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7):
                at += 2
            if at < 0:
                raise ValueError("no end")
    raise ValueError("no end")


def jpeg_kind(marker: int, payload: bytes) -> str | None:
    """Which metadata a segment holds."""
    if marker == 0xE1 and payload.startswith(b"Exif\0\0"):
        return "exif"
    if marker == 0xE1 and payload.startswith(XMP):
        return "xmp"
    return {0xED: "iptc", 0xFE: "comment"}.get(marker)


#: EXIF tags by what they tell (fixed values of the format): where, who, and with what and when.
EXIF_GPS = 0x8825
EXIF_IDENTITY = frozenset({0x013B, 0x8298, 0xA430, 0xA431, 0xA435, 0xC62F})
EXIF_DEVICE = frozenset({0x010F, 0x0110, 0x0131, 0x0132, 0x013C, 0x9003, 0x9004, 0xA433, 0xA434, 0xC614})
EXIF_MORE, EXIF_TURN = 0x8769, 0x0112
#: Bytes of one value of each type (fixed values of the format).
EXIF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
MOST_ENTRIES, MOST_TEXT = 4096, 4096


def exif(payload: bytes) -> dict[int, tuple[int, int, bytes]]:
    """Type, count and bytes by tag, of the first directory of EXIF data and of the one it names for more. ValueError if it can't be read."""
    tiff = payload.removeprefix(b"Exif\0\0")
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order or len(tiff) < 8 or struct.unpack(order + "H", tiff[2:4])[0] != 42:
        raise ValueError("no EXIF data")
    out: dict[int, tuple[int, int, bytes]] = {}
    todo = [struct.unpack(order + "I", tiff[4:8])[0]]
    for at in todo:
        if at + 2 > len(tiff):
            raise ValueError("a directory outside of the data")
        n = struct.unpack(order + "H", tiff[at : at + 2])[0]
        if at + 2 + 12 * n > len(tiff) or n > MOST_ENTRIES:
            raise ValueError("a cut directory")
        for k in range(n):
            tag, kind, count, value = struct.unpack(order + "HHI4s", tiff[at + 2 + 12 * k : at + 14 + 12 * k])
            size = EXIF_SIZES.get(kind, 1) * count
            if size > 4:
                where = struct.unpack(order + "I", value)[0]
                value = tiff[where : where + min(size, MOST_TEXT)]
            out.setdefault(tag, (kind, count, value[:size]))
            if tag == EXIF_MORE and len(todo) == 1 and kind == 4 and count == 1:
                todo.append(struct.unpack(order + "I", value)[0])
    if EXIF_TURN in out:
        kind, count, value = out[EXIF_TURN]
        out[EXIF_TURN] = (kind, count, struct.pack("<H", struct.unpack(order + "H", value)[0]) if kind == 3 and count == 1 else value)
    return out


def exif_facts(payload: bytes) -> tuple[bool, int, int, str]:
    """(whether EXIF data tells a place, how many tags tell a person, how many a device, software or time, and its texts)."""
    tags = exif(payload)
    texts = [v.split(b"\0")[0].decode("utf-8", "replace") for kind, _, v in tags.values() if kind == 2]
    return EXIF_GPS in tags, len(EXIF_IDENTITY & tags.keys()), len(EXIF_DEVICE & tags.keys()), "\n".join(filter(None, texts))


def orientation(payload: bytes) -> tuple[int | None, bool]:
    """(orientation in the first directory of EXIF data, whether it could be read)."""
    try:
        kind, count, value = exif(payload).get(EXIF_TURN, (3, 1, b""))
    except ValueError:
        return None, False
    if kind != 3 or count != 1:
        return None, False
    return (struct.unpack("<H", value)[0] if value else None), True


def _keeps(payload: bytes) -> bool:
    """EXIF that turns the picture, or can't be read, has to stay."""
    turn, read = orientation(payload)
    return not read or turn not in (None, 1)


KEPT = "orientation_needs_the_picture_turned"


def strip_png(data: bytes) -> tuple[bytes, int, str | None]:
    """(copy without metadata chunks, how many went, why some stayed)."""
    out, removed, kept = [PNG], 0, None
    try:
        for kind, payload in png_chunks(data):
            if kind in PNG_METADATA and not (kind == "eXIf" and _keeps(payload)):
                removed += 1
                continue
            kept = KEPT if kind == "eXIf" else kept
            name = kind.encode("ascii")
            out.append(struct.pack(">I", len(payload)) + name + payload + struct.pack(">I", zlib.crc32(name + payload)))
    except LimitError:
        return data, 0, "chunk_limit"
    except ValueError:
        return data, 0, "invalid_structure"
    return (b"".join(out) if removed else data), removed, kept


def strip_jpeg(data: bytes) -> tuple[bytes, int, str | None]:
    """(copy without metadata segments, how many went, why some stayed)."""
    cut, kept = [], None
    try:
        for marker, payload, start, end in jpeg_segments(data):
            kind = jpeg_kind(marker, payload)
            if kind == "exif" and _keeps(payload):
                kept = KEPT
            elif kind:
                cut.append((start, end))
    except ValueError:
        return data, 0, "invalid_structure"
    out, at = [], 0
    for start, end in cut:
        out.append(data[at:start])
        at = end
    return b"".join([*out, data[at:]]), len(cut), kept


def facets(data: bytes, kind: str) -> dict[str, bytes]:
    """What a copy without metadata must still have, by name."""
    if kind == "png":
        chunks = list(png_chunks(data))
        pick = lambda *names: b"".join(k.encode() + p for k, p in chunks if k in names)
        known = ("IHDR", "PLTE", "IDAT", "tRNS")
        return {"header": pick("IHDR"), "palette": pick("PLTE", "tRNS"), "pixels": pick("IDAT"), "order": b",".join(k.encode() for k, _ in chunks if k not in PNG_METADATA), "other": b"".join(k.encode() + p for k, p in chunks if k not in (*known, *PNG_METADATA))}
    segments = list(jpeg_segments(data))
    spans = [(s, e) for m, p, s, e in segments if jpeg_kind(m, p)]
    rest, at = [], 0
    for s, e in spans:
        rest.append(data[at:s])
        at = e
    return {"frames": b"".join(p for m, p, _, _ in segments if 0xC0 <= m <= 0xCF), "tables": b"".join(p for m, p, _, _ in segments if m in (0xDB, 0xDD)), "rest": b"".join([*rest, data[at:]])}
