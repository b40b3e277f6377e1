"""Detection: every rule's hits in a text, validated, without those that better ones cover."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import fixed
from sieveline.functions.fixed import ALL_RULES, ASSIGNMENTS, Rule
from sieveline.functions.spans import let, spans

HITS = "array<struct<start:int,end:int,rule_id:string,category:string,severity:string,confidence:double,value_class:string,value:string>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid_card(value: Column) -> Column:
    """13 to 19 digits, not all equal, with a right Luhn sum."""

    def right(d: Column) -> Column:
        return F.length(d).between(13, 19) & (F.length(F.replace(d, F.substring(d, 1, 1), F.lit(""))) > 0) & F.call_function("luhn_check", d)

    return let(F.translate(value, " -", ""), right)


def valid_resident_id(value: Column) -> Column:
    """A date that there is, and a right check character."""
    v = F.upper(value)
    whole = lambda a, n: F.substring(v, a, n).cast("int")
    first = F.make_date(whole(7, 4), whole(11, 2), F.lit(1))
    total = reduce(lambda a, b: a + b, (whole(k + 1, 1) * w for k, w in enumerate(fixed.ID_WEIGHTS)))
    check = F.substring(F.lit(fixed.ID_CHECKS), F.pmod(total, F.lit(11)) + 1, F.lit(1))
    return (whole(13, 2) <= F.dayofmonth(F.last_day(first))) & (check == F.substring(v, 18, 1))


def json_of(part: Column) -> Column:
    """A base64url part as variant, or null if it is no JSON in UTF-8."""
    padded = F.concat(F.translate(part, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(part), F.lit(4))))
    return F.try_parse_json(F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")))


def valid_jwt(value: Column) -> Column:
    """Header and payload are JSON objects, and the header names an algorithm."""
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))

    def named(header: Column) -> Column:
        alg = F.try_variant_get(header, "$.alg", "variant")
        return kind(header).startswith("OBJECT") & (kind(alg) == "STRING") & (F.lower(F.try_variant_get(header, "$.alg", "string")) != "none")

    def both(parts: Column) -> Column:
        return let(json_of(F.get(parts, F.lit(0))), named) & kind(json_of(F.get(parts, F.lit(1)))).startswith("OBJECT")

    return F.coalesce(let(F.split(value, r"\."), both), F.lit(False))


def likely_credential(hit: Column) -> Column:
    """Neither a placeholder, nor bare code, nor a type after a colon."""

    def judge(v: Column) -> Column:
        def real(plain: Column) -> Column:
            return ~reduce(lambda a, b: a | b, (F.contains(plain, F.lit(x)) for x in fixed.PLACEHOLDERS))

        ok = (F.length(v) >= 6) & (F.size(F.array_distinct(F.split(v, ""))) >= 3)
        ok &= let(F.regexp_replace(F.lower(v), "[^a-z0-9]+", ""), real)
        ok &= ~(v.startswith("${") | v.startswith("{{") | v.startswith("<") | v.endswith("}") | v.endswith(">"))
        before = F.substring(hit["whole"], F.lit(1), F.length(hit["whole"]) - F.length(hit["value"]))
        colon = F.rtrim(F.translate(before, "\t", " ")).endswith(":")
        typed = let(F.regexp_replace(v, r"\)+$", ""), lambda name: F.lower(name).isin(*fixed.TYPE_NAMES) | F.rlike(name, F.lit(fixed.TYPE_PATTERN)))
        return ok & ~(hit["bare"] & F.rlike(hit["value"], F.lit(r"[()\[\]{}]"))) & ~(hit["bare"] & colon & typed)

    return let(F.regexp_replace(hit["value"], f"^[{fixed.WS}]+|[{fixed.WS}]+$", ""), judge)


VALID = {"pii.cn_resident_id": valid_resident_id, "pii.bank_card": valid_card, "secret.jwt": valid_jwt}


def _gate(text: Column, rule: Rule) -> Column | None:
    if rule.needs:
        return reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in rule.needs))
    if rule.rule_id.startswith("pii."):
        return F.rlike(text, F.lit("[0-9](?:[ -]?[0-9]){9}"))
    if rule in ASSIGNMENTS:
        return F.rlike(text, F.lit(r"(?i)(?:password|passwd|pwd|secret|token|key)\b[\"']?["+ fixed.WS + r"]*[=:]"))
    if rule.rule_id == "privacy.windows_user_path":
        return F.rlike(text, F.lit(r"(?i)(?:Users|Documents and Settings)[\\/]"))
    return None


def _named(found: Column, rule: Rule) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"], x["end"], F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.category).alias("category"), F.lit(rule.severity).alias("severity"), F.lit(rule.confidence).alias("confidence"), F.lit(rule.value_class).alias("value_class"), x["value"].alias("value")))


def rule_hits(text: Column, rule: Rule, most: int) -> Column:
    """The first `most` valid hits of one rule. A candidate that is not valid has used up its text."""
    if rule in ASSIGNMENTS:
        found = spans(text, rule.pattern, 3, ALL)
        if rule.rule_id == "secret.credential_assignment":
            found = F.filter(found, likely_credential)
    else:
        check = VALID.get(rule.rule_id)
        found = spans(text, rule.pattern, 0, ALL if check else most)
        if check:
            found = F.filter(found, lambda x: check(x["value"]))
    out = _named(F.slice(found, 1, most), rule)
    gate = _gate(text, rule)
    return F.coalesce(F.when(gate, out) if gate is not None else out, F.array().cast(HITS))


#: No cap: more hits than a text can have.
ALL = (1 << 31) - 1


def detect(df: DataFrame, text: str = "text", hits: str = "hits", most: int = ALL) -> DataFrame:
    """Add the hits of a text column, in order of (start, end, rule), all unless `most` is given. report.cap() caps with a gap.

    All of it happens inside the row: no shuffle, no Python. A null text has no
    hits. A generic credential goes if it overlaps a personal datum or secret.
    """
    names = [f"_hit{k}" for k in range(len(ALL_RULES))]
    out = df.withColumns(dict(zip(names, _columns(id(SparkContext._gateway), text, most), strict=True)))
    strong = [n for n, r in zip(names, ALL_RULES, strict=True) if r.confidence >= 0.9 and r.category in ("pii", "secret")]
    guard = F.concat(*[F.transform(n, lambda x: F.struct(x["start"], x["end"])) for n in strong])
    free = F.filter(names[-1], lambda g: ~F.exists("_guard", lambda p: (g["start"] < p["end"]) & (p["start"] < g["end"])))
    every = F.concat(*names[:-1], free)
    return out.withColumn("_guard", guard).withColumn(hits, F.slice(F.array_sort(F.array_distinct(every)), 1, most)).drop("_guard", *names)


@lru_cache(maxsize=32)
def _columns(gateway: int, text: str, most: int) -> list[Column]:
    """The rules' hits as columns; making them takes more than a second, so they are kept for a JVM, column and cap."""
    source = F.coalesce(F.col(text), F.lit(""))
    return [rule_hits(source, r, most) for r in ALL_RULES]


def findings(df: DataFrame, keys: list[str], text: str = "text", most: int = ALL) -> DataFrame:
    """A row for each hit: the keys, the hit's fields (value included), and line and column of its start."""
    from sieveline.functions.spans import column_of, line_of

    found = detect(df.select(*dict.fromkeys([*keys, text])), text, "_hits", most)
    # Of a plain column explode() infers a filter, which is pushed down and detects all once more, below any exchange.
    rows = found.select(*keys, F.col(text).alias("_text"), F.explode(F.slice("_hits", 1, ALL)).alias("_h"))
    start = F.col("_h.start")
    return rows.select(*keys, "_h.*", line_of(F.col("_text"), start).alias("line"), column_of(F.col("_text"), start).alias("column"))
