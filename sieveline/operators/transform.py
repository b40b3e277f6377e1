"""Copies without metadata, with a receipt of what they kept."""

from __future__ import annotations

import hashlib
import hmac
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sieveline.sources import archives, images, media

#: By kind the action and the function (content, path) -> (copy, how much went, why not).
STRIP = {
    "png": ("strip_png_metadata", lambda data, path: images.strip_png(data)),
    "jpeg": ("strip_jpeg_metadata", lambda data, path: images.strip_jpeg(data)),
    "office": ("strip_ooxml_metadata", archives.strip_office),
}


def strip(path: str, data: bytes) -> tuple[str, bytes, str, str | None, int]:
    """(action, copy, status, reason, how much went) for one file."""
    kind = media.sniff(data, path)[0]
    if kind not in STRIP:
        return "copy_unchanged", data, "unsupported" if kind in ("zip", "pdf", "tiff", "webp") else "not_needed", None, 0
    action, f = STRIP[kind]
    out, removed, reason = f(data, path)
    if out != data:
        return action, out, "partial" if reason else "applied", reason, removed
    return action, data, "skipped" if reason else "not_needed", reason, 0


def kept(path: str, before: bytes, after: bytes, key: bytes) -> list[tuple[str, str, bool]]:
    """(facet, keyed token, whether the copy has it unchanged) of what a transformation must keep."""
    kind = media.sniff(before, path)[0]
    a, b = (images.facets(x, kind) if kind in ("png", "jpeg") else archives.office_facets(x) for x in (before, after))
    token = lambda n, v: hmac.new(key, f"{len(n)}:{n}:{len(v)}:".encode() + v, hashlib.sha256).hexdigest()[:32]
    return [(n, token(n, v), b.get(n) == v) for n, v in sorted(a.items())] + [(n, token(n, v), False) for n, v in sorted(b.items()) if n not in a]


def transform(contents: DataFrame, key: bytes) -> DataFrame:
    """Copies of files (path, content): action, status, reason, removed, the copy and its receipt (facets)."""
    facets = pa.list_(pa.struct([("facet", pa.string()), ("token", pa.string()), ("preserved", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), facets)
        for part in batches:
            for path, data in zip(part.column("path").to_pylist(), part.column("content"), strict=True):
                data = data.as_py() or b""
                action, out, status, reason, n = strip(path, data)
                proof = [dict(zip(("facet", "token", "preserved"), f, strict=True)) for f in kept(path, data, out, key)] if status in ("applied", "partial") else []
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((path, action, status, reason, n, out, proof), kinds, strict=True)], names=["path", "action", "status", "reason", "removed", "copy", "facets"])

    return contents.select("path", "content").mapInArrow(run, "path string, action string, status string, reason string, removed long, copy binary, facets array<struct<facet:string,token:string,preserved:boolean>>")


def write_exclusive(path: str, data: bytes, mode: int = 0o600) -> None:
    """A new file with all of data, never over an existing one: written beside it, then linked into place."""
    beside = f"{path}.{os.getpid()}.part"
    with os.fdopen(os.open(beside, os.O_WRONLY | os.O_CREAT | os.O_EXCL, mode), "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(beside, path)
    finally:
        os.unlink(beside)
