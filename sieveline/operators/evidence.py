"""Masked evidence, keyed tokens and display paths: nothing here returns a raw value."""

from __future__ import annotations

import hashlib
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions import fixed
from sieveline.functions.fixed import LIMITS, RULES
from sieveline.functions.spans import let, spans

from .detect import rule_hits

NAME_OMITTED, PATH_OMITTED = "<name:omitted-limit>", "<path:omitted-limit>"
#: Characters whose name a mask may show.
_CONTROLS = [0x061C, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A), 0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and 20 hex digits of the parts' canonical JSON."""
    named = [p.cast("string").alias(f"p{k:02d}") for k, p in enumerate(parts)]
    return F.concat(F.lit(f"{prefix}-"), F.left(F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), 256), F.lit(20)))


def hmac_token(key: bytes, message: Column, domain: str = "evidence-v1") -> Column:
    """HMAC-SHA-256 of the domain and a string, 32 hex digits, from built-in hashes.

    The key's pads stand in the plan as literals: use keys made for one run.
    """
    if len(key) < 16:
        raise ValueError("a key has at least 16 bytes")
    block = key.ljust(64, b"\0") if len(key) <= 64 else hashlib.sha256(key).digest().ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.lit(bytearray(domain.encode() + b"\0")), F.encode(message, "UTF-8")), 256))
    return F.concat(F.lit(f"hmac-sha256:{domain}:"), F.left(F.sha2(F.concat(outer, first), 256), F.lit(32)))


def _tail(value: Column, label: str, shown: int) -> Column:
    def mask(d: Column) -> Column:
        hidden = F.greatest(F.lit(4), F.length(d) - F.least(F.length(d), F.lit(shown)))
        return F.when(d == "", F.lit(f"<{label}:redacted>")).otherwise(F.concat(F.lit(f"<{label}:"), F.repeat(F.lit("*"), hidden), F.right(d, F.lit(shown)), F.lit(">")))

    return let(F.regexp_replace(value, "[^0-9]", ""), mask)


def _code(c: Column) -> Column:
    """U+XXXX of a character."""
    return F.concat(F.lit("U+"), F.lpad(F.hex(F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")), 4, "0"))


def mask_controls(value: Column) -> Column:
    names = F.create_map(*[F.lit(x) for c in _CONTROLS for x in (chr(c), unicodedata.name(chr(c), "UNKNOWN"))])
    codes = F.array_join(F.transform(F.split(value, ""), _code), ",")
    one = F.when(F.length(value) == 1, F.concat(F.lit(":"), F.coalesce(F.try_element_at(names, value), F.lit("UNKNOWN")))).otherwise("")
    return F.concat(F.lit("<unicode-control:"), codes, one, F.lit(">"))


def mask_value(value: Column, value_class: Column) -> Column:
    """The mask of a value by its class: full for secrets, a tail of digits for numbers, a masked path."""
    kind = F.replace(F.lower(F.trim(value_class)), F.lit("-"), F.lit("_"))
    out = F.when(kind.isin("secret", "credential", "private_key", "jwt", "email"), F.concat(F.lit("<"), kind, F.lit(":redacted>")))
    out = out.when(kind.isin("phone", "cn_mobile"), _tail(value, "phone", 4)).when(kind.isin("government_id", "cn_resident_id"), _tail(value, "cn-id", 2))
    out = out.when(kind.isin("payment_card", "bank_card"), _tail(value, "card", 4)).when(kind.isin("unicode_control", "control_character"), mask_controls(value))
    path = let(mask_homes(value), lambda p: F.when(p != value, p).otherwise("<path:redacted>"))
    out = out.when(kind.isin("path", "user_path"), path)
    label = F.regexp_replace(F.regexp_replace(kind, "[^a-z0-9_]+", "-"), "^-+|-+$", "")
    return out.otherwise(F.concat(F.lit("<"), F.when(label == "", "value").otherwise(label), F.lit(":redacted>")))


def mask_homes(path: Column) -> Column:
    """A path with home directories' users and hosts replaced. Masking a masked path changes nothing."""
    return reduce(lambda p, m: F.regexp_replace(p, m[0], m[1]), fixed.HOME_MASKS, path)


def _mask_component(part: Column) -> Column:
    """One path component with personal data, secrets and controls masked; of hits that overlap the surest, then longest, wins."""
    rules = [r for r in RULES if r.category in ("pii", "secret", "unicode_control")]
    found = F.concat(*[rule_hits(part, r, 100) for r in rules], rule_hits(part, fixed.ASSIGNMENTS[0], 100), rule_hits(part, fixed.ASSIGNMENTS[1], 100))
    ranked = F.array_sort(F.transform(found, lambda h: F.struct((-h["confidence"]).alias("c"), (h["start"] - h["end"]).alias("l"), h["start"].alias("start"), h["rule_id"].alias("rule_id"), h["end"].alias("end"), h["value_class"].alias("value_class"))))
    none = F.array().cast("array<struct<c:double,l:int,start:int,rule_id:string,end:int,value_class:string>>")
    chosen = F.aggregate(ranked, none, lambda acc, h: F.when(F.exists(acc, lambda o: (h["start"] < o["end"]) & (o["start"] < h["end"])), acc).otherwise(F.array_append(acc, h)))
    in_order = F.array_sort(F.transform(chosen, lambda h: F.struct(h["start"], h["end"], h["value_class"])))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, h: Column) -> Column:
        between = F.substring(part, acc["at"] + 1, h["start"] - acc["at"])
        value = F.substring(part, h["start"] + 1, h["end"] - h["start"])
        return F.struct(h["end"].alias("at"), F.concat(acc["out"], between, mask_value(value, h["value_class"])).alias("out"))

    def whole(hits: Column) -> Column:
        return F.aggregate(hits, start, add, lambda a: F.concat(a["out"], F.substring(part, a["at"] + 1, F.length(part))))

    return let(in_order, lambda hits: F.when(F.size(hits) == 0, part).otherwise(whole(hits)))


def display_path(path: Column, max_name: int = LIMITS["max_name_bytes"], max_chars: int = LIMITS["max_path_chars"]) -> Column:
    """struct<value, reasons>: a path as it may be shown, and which limits it was over."""
    pieces = spans(path, r"[^\\/]+", 0, 1 << 20)
    over = F.coalesce(F.exists(pieces, lambda x: (x["value"] == NAME_OMITTED) | (F.octet_length(x["value"]) > max_name)), F.lit(False))
    too_long = (path == PATH_OMITTED) | (F.length(path) > max_chars)
    parts = lambda p, f: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(r"([\\/]+|[^\\/]+)"), F.lit(1)), lambda x: F.when(F.rlike(x, F.lit(r"^[\\/]")), x).otherwise(f(x))), "")
    named = parts(path, lambda x: F.when(F.octet_length(x) > max_name, NAME_OMITTED).otherwise(x))
    control = F.array_join(F.transform(F.split(named, ""), lambda c: F.when(F.rlike(c, F.lit(r"[\x00-\x1f\x7f-\x9f]")), mask_controls(c)).otherwise(c)), "")
    shown = let(mask_homes(F.when(F.rlike(path, F.lit(r"[\x00-\x1f\x7f-\x9f]")), control).otherwise(named)), lambda p: parts(p, _mask_component))
    reasons = lambda x: F.array_compact(F.array(F.when(over, "name_limit"), F.when(x, "display_path_limit")))
    done = lambda v: F.struct(F.when(F.length(v) > max_chars, PATH_OMITTED).otherwise(v).alias("value"), reasons(F.length(v) > max_chars).alias("reasons"))
    return F.when(too_long, F.struct(F.lit(PATH_OMITTED).alias("value"), reasons(F.lit(True)).alias("reasons"))).otherwise(let(shown, done))
