"""Registered queries of the engine and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import compare, hygiene, inventory, policy, report
from sieveline.operators.detect import detect, findings
from sieveline.operators.evidence import display_path, hmac_token, mask_value
from sieveline.sources.scratch import held

from . import cases

#: A fixed key for results that can be compared; runs make their own.
TEST_KEY = b"sieveline-fixed-test-key"

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Register a function by its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt to all of them: detection is work on texts, and a file of one row group is one task. Larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(_docs(spark, sf_dir), ["doc_id"])


def _sql_findings(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """Findings of a table in SQL: emails by a left boundary, cards with boundaries doubled, assignments by groups.

    The tables hold nothing that the other rules find; those have literal cases.
    """
    email = r"(?i)(?:^|[^A-Za-z0-9.!#$%&''*+/=?^_`{|}~-])([A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?){1,10})"
    secret = r"(?i)[\"'']?\b(?:password|passwd|pwd|secret|token|api[-_]?key|access[-_]?key|client[-_]?secret|auth[-_]?token)\b[\"'']?[ \t]*(=|:)[ \t]*(?:\"([^\"\r\n]{4,256})\"|''([^''\r\n]{4,256})''|([^\s,;#\"'']{4,256}))"
    return rf"""
src AS (SELECT {key} AS k, coalesce({text}, '') AS text FROM {table}),
f_email AS (SELECT k, unnest(regexp_extract_all(text, '{email}', 1)) AS value FROM src WHERE contains(text, '@')),
f_card0 AS (SELECT k, replace(replace(unnest(regexp_extract_all(regexp_replace(text, '([^0-9])', '\1\1', 'g'), '(?:^|[^0-9])((?:[0-9](?:  |--)?){{12,18}}[0-9])(?:$|[^0-9])', 1)), ' ', ''), '-', '') AS v FROM src),
f_card AS (SELECT k, v AS value FROM f_card0 WHERE length(v) BETWEEN 13 AND 19 AND length(replace(v, v[1], '')) > 0 AND list_sum([CASE WHEN (length(v) - i) % 2 = 0 THEN CAST(v[i] AS INTEGER) ELSE (2 * CAST(v[i] AS INTEGER)) // 10 + (2 * CAST(v[i] AS INTEGER)) % 10 END FOR i IN range(1, length(v) + 1)]) % 10 = 0),
f_pair AS (SELECT k, unnest(regexp_extract_all(text, '{secret}', 1)) AS sign, unnest(regexp_extract_all(text, '{secret}', 2)) AS dq, unnest(regexp_extract_all(text, '{secret}', 3)) AS sq, unnest(regexp_extract_all(text, '{secret}', 4)) AS bare FROM src),
f_val AS (SELECT k, concat(dq, sq, bare) AS value, trim(concat(dq, sq, bare)) AS s, coalesce(bare, '') AS bare, sign FROM f_pair),
f_cred AS (SELECT k, value FROM f_val WHERE length(s) >= 6 AND len(list_distinct(string_split(s, ''))) >= 3
    AND NOT regexp_matches(regexp_replace(lower(s), '[^a-z0-9]+', '', 'g'), 'changeme|dummy|example|placeholder|redacted|replace|sample|yourpassword|yourtoken')
    AND NOT regexp_matches(s, '^(?:\$\{{|\{{\{{|<)|[}}>]$') AND NOT (bare <> '' AND regexp_matches(value, '[()\[\]{{}}]'))
    AND NOT (bare <> '' AND sign = ':' AND lower(s) IN ('any', 'bool', 'bytearray', 'bytes', 'float', 'int', 'memoryview', 'none', 'object', 'path', 'str', 'typing.any'))),
f AS (SELECT k, 'pii.email' AS rule_id, 'pii' AS category, 'high' AS severity, 'email' AS value_class, value FROM f_email
    UNION ALL SELECT k, 'pii.bank_card', 'pii', 'critical', 'bank_card', value FROM f_card
    UNION ALL SELECT k, 'secret.credential_assignment', 'secret', 'high', 'credential', value FROM f_cred)"""


_F = "WITH " + _sql_findings()
_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in report.SEVERITIES)
_SUMS = ", ".join(f"CAST(coalesce(sum({s}), 0) AS BIGINT) AS {s}" for s in report.SEVERITIES)
_RANK = "list_position(['info', 'low', 'medium', 'high', 'critical'], {})"


@query(_F + " SELECT rule_id, severity, count(*) AS n FROM f GROUP BY ALL")
def scan_documents_severity(spark, sf_dir):
    """Findings of the documents by rule and severity."""
    return _found(spark, sf_dir).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@query("WITH " + _sql_findings("pages", "page_id", "html") + " SELECT rule_id, severity, count(*) AS n, count(DISTINCT k) AS artifacts FROM f GROUP BY ALL")
def scan_pages(spark, sf_dir):
    """Findings in the markup of pages."""
    pages = _spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
    return findings(pages, ["page_id"], "html").groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("artifacts"))


@query("WITH " + _sql_findings("events", "event_id", "props") + " SELECT 'events' AS source, count(*) AS n FROM f UNION ALL SELECT 'conversations', (WITH " + _sql_findings("conversations", "conv_id", "text") + " SELECT count(*) FROM f)")
def scan_clean_tables(spark, sf_dir):
    """Findings in tables that hold none: a control."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    count = lambda df, key, text, name: findings(df.select(key, text), [key], text).agg(F.lit(name).alias("source"), F.count("*").alias("n"))
    return count(events, "event_id", "props", "events").unionByName(count(talk, "conv_id", "text", "conversations"))


_MASK = "CASE WHEN value_class = 'bank_card' THEN '<card:' || repeat('*', greatest(4, length(value) - 4)) || right(value, 4) || '>' ELSE '<' || value_class || ':redacted>' END"


@query(_F + f" SELECT k AS doc_id, rule_id, {_MASK} AS evidence, count(*) AS n FROM f GROUP BY ALL")
def masked_evidence(spark, sf_dir):
    """Masks of all findings of the documents."""
    found = report.masked_findings(_docs(spark, sf_dir), ["doc_id"])
    return found.groupBy("doc_id", "rule_id", "evidence").agg(F.count("*").alias("n"))


_CRED = r"(?i)[\"'']?\b(?:password|passwd|pwd|secret|token|api[-_]?key|access[-_]?key|client[-_]?secret|auth[-_]?token)\b[\"'']?[ \t]*(?:=|:)[ \t]*(?:\"[^\"\r\n]{4,256}\"|''[^''\r\n]{4,256}''|[^\s,;#\"'']{4,256})"


@query(
    _F
    + rf""", m AS (SELECT k, text, string_split_regex(text, '{_CRED}') AS gaps, regexp_extract_all(text, '{_CRED}') AS ms FROM src WHERE regexp_matches(text, '{_CRED}')),
p AS (SELECT k, text, ms[i] AS whole, list_sum([length(x) FOR x IN gaps[1:i]]) + list_sum([length(x) FOR x IN ms[1:i]]) AS stop FROM m, unnest(range(1, len(ms) + 1)) AS t(i)),
q AS (SELECT *, CASE WHEN right(whole, 1) IN ('"', '''') THEN stop - 1 ELSE stop END AS e FROM p),
v AS (SELECT DISTINCT q.k, text, e - length(value) AS s, e, value FROM q JOIN f ON q.k = f.k AND rule_id = 'secret.credential_assignment' AND substr(text, CAST(e - length(value) + 1 AS BIGINT), length(value)) = value)
SELECT k AS doc_id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", length(left(text, CAST(s AS BIGINT))) - length(replace(left(text, CAST(s AS BIGINT)), chr(10), '')) + 1 AS line, length(string_split(left(text, CAST(s AS BIGINT)), chr(10))[-1]) + 1 AS "column" FROM v"""
)
def findings_line_column(spark, sf_dir):
    """Offsets, lines and columns of credential assignments."""
    found = _found(spark, sf_dir).where("rule_id = 'secret.credential_assignment'")
    return found.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("start", "end", "line", "column")])


@query(_F + f", c AS (SELECT k, count(*) AS findings, {_COUNTS}, max({_RANK.format('severity')}) AS w FROM f GROUP BY k) SELECT src.k AS doc_id, coalesce(findings, 0) AS findings, {', '.join(f'coalesce({s}, 0) AS {s}' for s in report.SEVERITIES)}, ['info', 'low', 'medium', 'high', 'critical'][w] AS worst, 'scanned' AS status FROM src LEFT JOIN c ON src.k = c.k")
def artifact_summary(spark, sf_dir):
    """Each document as an artifact with its findings by severity."""
    return _artifacts(spark, sf_dir).drop("gaps", "categories")


def _artifacts(spark, sf_dir) -> DataFrame:
    return report.artifacts_of(_docs(spark, sf_dir), ["doc_id"])


_SUMMARY = f"""c AS (SELECT k, count(*) AS findings, {_COUNTS} FROM f GROUP BY k),
t AS (SELECT (SELECT count(*) FROM src) AS artifacts_total, {_SUMS}, CAST(coalesce(sum(findings), 0) AS BIGINT) AS findings FROM c),
s AS (SELECT artifacts_total, artifacts_total AS artifacts_complete, CAST(0 AS BIGINT) AS artifacts_partial, info, low, medium, high, critical, findings, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS errors, CASE WHEN high + critical > 0 THEN 'block' WHEN findings > 0 THEN 'review' ELSE 'no_findings' END AS verdict FROM t)"""


@query(_F + ", " + _SUMMARY + " SELECT *, CASE WHEN high + critical > 0 THEN 1 ELSE 0 END AS exit_code FROM s")
def report_summary(spark, sf_dir):
    """Totals, verdict and exit code."""
    return report.exit_code(report.summary(_artifacts(spark, sf_dir)), "high")


@query(_F + ", " + _SUMMARY + " SELECT verdict AS technical_verdict, artifacts_total, artifacts_complete, artifacts_partial, info, low, medium, high, critical, gaps, errors FROM s")
def share_summary(spark, sf_dir):
    """What of a report may be shared: totals only."""
    s = report.summary(_artifacts(spark, sf_dir))
    return s.select(F.col("verdict").alias("technical_verdict"), "artifacts_total", "artifacts_complete", "artifacts_partial", *report.SEVERITIES, "gaps", "errors")


def _show(by: str, least: str):
    column = {"rule": "rule_id", "category": "category", "severity": "severity"}[by]
    order = f"{_RANK.format('value')} DESC, value" if by == "severity" else "value"
    sql = _F + f", g AS (SELECT {column} AS value, count(*) AS count, {_COUNTS} FROM f WHERE {_RANK.format('severity')} >= {report.SEVERITIES.index(least) + 1} GROUP BY 1) SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM g"

    def run(spark, sf_dir):
        return report.show(_found(spark, sf_dir), by, least)

    run.__name__ = f"show_by_{by}"
    query(sql)(run)


for _by, _least in (("rule", "info"), ("category", "high"), ("severity", "medium")):
    _show(_by, _least)


@query(_F + ", n AS (SELECT k, count(*) AS n FROM f GROUP BY k) SELECT k AS doc_id, least(n, 1) AS kept, CAST(greatest(n - 1, 0) AS BIGINT) AS omitted FROM n")
def findings_capped(spark, sf_dir):
    """One finding for each document, and gaps for those that have more."""
    placed = report.numbered(_found(spark, sf_dir), ["doc_id"], ["start", "end", "rule_id"])
    return placed.groupBy("doc_id").agg(F.count_if(F.col("_n") <= 1).alias("kept"), F.max(F.greatest(F.col("_total") - 1, F.lit(0))).alias("omitted"))


_PER, _ALL = 1000, 10_000


@query(
    f"""WITH t AS (SELECT * FROM {cases.LONG_TEXTS.sql()}),
b AS (SELECT *, coalesce(sum(least(n, {_PER})) OVER (PARTITION BY report ORDER BY artifact ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
g AS (SELECT report, max(before + least(n, {_PER} + 1)) > {_ALL} AS over FROM b WHERE n > 0 GROUP BY report)
SELECT report, artifact, CAST(greatest(least(n, {_PER}, {_ALL} - before), 0) AS BIGINT) AS kept, n > {_PER} AND before + {_PER} <= {_ALL} AS artifact_gap, over AS global_gap FROM b JOIN g USING (report) WHERE n > 0"""
)
def findings_truncated(spark, sf_dir):
    """Findings kept of texts with exactly as many as the limits allow, and with more, and the gaps that say so."""
    out = None
    texts = cases.LONG_TEXTS.spark(spark).withColumn("text", F.expr("repeat('a@example.test ', CAST(n AS INT))"))
    every = held(report.findings(texts, ["report", "artifact"], most=_PER + 1).drop("value"), "truncated")
    for name in sorted({r[0] for r in cases.LONG_TEXTS.rows}):
        kept, gaps = report.cap_all(every.where(F.col("report") == name).drop("report"), ["artifact"], ["start", "end", "rule_id"], _PER, _ALL)
        own = gaps.where("artifact IS NOT NULL").select(F.col("artifact").alias("_a"))
        each = texts.where((F.col("report") == name) & (F.col("n") > 0)).select("report", "artifact")
        counted = each.join(kept.groupBy("artifact").agg(F.count("*").alias("kept")), "artifact", "left").join(own, F.col("artifact") == F.col("_a"), "left")
        over = gaps.where("artifact IS NULL").agg((F.count("*") > 0).alias("global_gap"))
        part = counted.join(F.broadcast(over)).select("report", "artifact", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), F.col("_a").isNotNull().alias("artifact_gap"), "global_gap")  # one row
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "SELECT * FROM (VALUES " + ", ".join(f"('{name}', CAST({g} AS BIGINT), CAST({min(g, 16)} AS BIGINT), {str(g > 16).lower()}, CAST({min(e, 5)} AS BIGINT), {str(e > 5).lower()})" for name, g, e in cases.GAP_BUDGETS) + ") AS t(case_name, gaps, kept, gaps_cut, errors, errors_cut)"
)
def gap_budget(spark, sf_dir):
    """Gaps and errors within limits of 20 and 5: four gaps are kept free for what says that something was cut."""
    out = None
    for name, n_gaps, n_errors in cases.GAP_BUDGETS:
        gaps = spark.range(n_gaps).select(F.col("id").cast("string").alias("path"), F.lit("content").alias("capability"), F.lit("read_error").alias("reason"))
        errors = spark.range(n_errors).select(F.lit("entry_unreadable").alias("code"), F.col("id").cast("string").alias("message"))
        kept, shown = report.cap_gaps(gaps.union(gaps), errors, ["path"], 20, 5)
        control = lambda r: F.count_if(F.col("reason") == r) > 0
        row = kept.agg(F.lit(name).alias("case_name"), F.lit(n_gaps).cast("long").alias("gaps"), F.count_if(F.col("path").isNotNull()).alias("kept"), control("global_gap_limit").alias("gaps_cut"), control("global_error_limit").alias("errors_cut"))
        row = row.join(F.broadcast(shown.agg(F.count("*").alias("errors")))).select("case_name", "gaps", "kept", "gaps_cut", "errors", "errors_cut")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


@query(_F + f" SELECT k AS doc_id, sum({_RANK.format('severity')} * {_RANK.format('severity')})::BIGINT AS score, count(*) AS n FROM f GROUP BY k ORDER BY score DESC, doc_id LIMIT 20")
def riskiest_documents(spark, sf_dir):
    """The 20 documents with the highest sum of squared severities: a top-k report."""
    weight = (report.rank(F.col("severity")) + 1) * (report.rank(F.col("severity")) + 1)
    return _found(spark, sf_dir).groupBy("doc_id").agg(F.sum(weight).cast("long").alias("score"), F.count("*").alias("n")).orderBy(F.desc("score"), "doc_id").limit(20)


@query(_F + " SELECT quality, toxic, rule_id, count(*) AS n FROM f JOIN labels ON f.k = labels.doc_id GROUP BY ALL")
def findings_by_label(spark, sf_dir):
    """Findings of labelled documents by label."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _found(spark, sf_dir).join(labels, "doc_id").groupBy("quality", "toxic", "rule_id").agg(F.count("*").alias("n"))


@query(_F + " SELECT category, severity, count(*) AS n, grouping(category) + grouping(severity) AS level FROM f GROUP BY CUBE (category, severity)")
def findings_cube(spark, sf_dir):
    """Findings by category and severity with all subtotals (an extension)."""
    return _found(spark, sf_dir).cube("category", "severity").agg(F.count("*").alias("n"), (F.grouping("category") + F.grouping("severity")).cast("long").alias("level"))


_TEXT_RULES = ", ".join(f"('{r.rule_id}', '{r.severity}')" for r in report.fixed.ALL_RULES)


@query(_F + f" SELECT t.rule_id, default_severity, count(f.rule_id) AS n FROM (VALUES {_TEXT_RULES}) AS t(rule_id, default_severity) LEFT JOIN f ON t.rule_id = f.rule_id GROUP BY ALL")
def catalog_join(spark, sf_dir):
    """Every text rule with its findings, also those without."""
    rules = report.catalog(spark).where("text_rule")
    return rules.join(_found(spark, sf_dir).select("rule_id", "doc_id"), "rule_id", "left").groupBy("rule_id", "default_severity").agg(F.count("doc_id").alias("n"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', CAST({n} AS BIGINT))" for k, n in (("text", 17), ("file", 6), ("archive", 6), ("office", 39), ("image", 12), ("pdf", 15))) + ") AS t(family, n)")
def rule_families(spark, sf_dir):
    """How many rules there are in each family."""
    family = F.when(F.col("text_rule"), "text").otherwise(F.substring_index("rule_id", ".", 1))
    return report.catalog(spark).groupBy(family.alias("family")).agg(F.count("*").alias("n"))


@query(f"SELECT case_id, rule_id, expect AS n FROM {cases.RULE_CASES.sql()}")
def rule_cases(spark, sf_dir):
    """Hits of each rule in texts that it must and must not find."""
    rows = detect(cases.RULE_CASES.spark(spark))
    return rows.select("case_id", "rule_id", F.size(F.filter("hits", lambda h: h["rule_id"] == F.col("rule_id"))).cast("long").alias("n"))


@query(f"SELECT value, value_class, expected AS mask FROM {cases.MASK_CASES.sql()}")
def mask_values(spark, sf_dir):
    """Masks of one value of each class."""
    return cases.MASK_CASES.spark(spark).select("value", "value_class", mask_value(F.col("value"), F.col("value_class")).alias("mask"))


@query(f"SELECT raw, value, array_to_string(reasons, ',') AS reasons FROM {cases.PATH_CASES.sql()}")
def display_paths(spark, sf_dir):
    """Paths as they may be shown."""
    shown = cases.PATH_CASES.spark(spark).select("raw", display_path(F.col("raw")).alias("d"))
    return shown.select("raw", "d.value", F.array_join("d.reasons", ",").alias("reasons"))


_BLOCK = TEST_KEY.ljust(64, b"\0")
_IPAD, _OPAD = (f"unhex('{bytes(b ^ p for b in _BLOCK).hex()}')" for p in (0x36, 0x5C))
_DOMAIN = f"unhex('{b'evidence-v1'.hex()}00')"


@query(f"SELECT doc_id, 'hmac-sha256:evidence-v1:' || left(sha256({_OPAD} || unhex(sha256({_IPAD} || {_DOMAIN} || encode(text)))), 32) AS token FROM documents")
def evidence_tokens(spark, sf_dir):
    """Keyed tokens of whole documents, by a fixed key."""
    return _docs(spark, sf_dir).select("doc_id", hmac_token(TEST_KEY, F.col("text")).alias("token"))


@query("SELECT sha256(coalesce(text, '')) AS digest, count(*) AS members, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content_groups(spark, sf_dir):
    """Documents with equal contents."""
    return report.duplicate_contents(_docs(spark, sf_dir))


@query(
    "WITH p AS (SELECT page_id, url, lower(string_split(url, '/')[-1]) AS name FROM pages) SELECT page_id, name IN ('.env', '.npmrc', '.pypirc', '.netrc', 'credentials', 'credentials.json', 'id_rsa', 'id_dsa', 'id_ecdsa', 'id_ed25519', 'secrets.yml', 'secrets.yaml', 'service-account.json', 'key.pem', 'private.pem') OR starts_with(name, '.env.') OR ends_with(name, '.pem') OR ends_with(name, '.key') OR ends_with(name, '.p12') OR ends_with(name, '.pfx') AS sensitive, CAST(len(regexp_extract_all(url, '[^/]+')) AS BIGINT) AS parts FROM p"
)
def filename_scan(spark, sf_dir):
    """The urls of pages as paths: sensitive names, and number of parts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    parts = F.size(F.regexp_extract_all("url", F.lit("[^/]+"), F.lit(0))).cast("long")
    return pages.select("page_id", report.sensitive_name(F.col("url")).alias("sensitive"), parts.alias("parts"))


@query(f"SELECT path, sensitive FROM {cases.SENSITIVE_CASES.sql()}")
def sensitive_names(spark, sf_dir):
    """Paths whose last part is a name that should not be shared, and some that only look so."""
    return cases.SENSITIVE_CASES.spark(spark).select("path", report.sensitive_name(F.col("path")).alias("sensitive"))


_EDIT = "CASE WHEN rule_id = 'pii.email' AND k % 2 = 0 THEN 'pii.renamed' ELSE rule_id END"


def _two_reports(spark, sf_dir) -> DataFrame:
    """The findings, and an edited copy: some renamed, some gone, some twice. One scan gives both sides."""
    found = _found(spark, sf_dir).select("doc_id", "rule_id")
    renamed = F.when((F.col("rule_id") == "pii.email") & (F.col("doc_id") % 2 == 0), "pii.renamed").otherwise(F.col("rule_id"))
    row = lambda side, rule: F.struct(F.lit(side).alias("side"), rule.alias("rule_id"))
    rows = F.array_compact(F.array(row("old", F.col("rule_id")), F.when(F.col("doc_id") % 5 != 0, row("new", renamed)), F.when(F.col("doc_id") % 7 == 0, row("new", F.col("rule_id")))))
    return found.select("doc_id", F.explode(rows).alias("_r")).select("doc_id", "_r.side", "_r.rule_id")


_TWO = _F + f", o AS (SELECT k AS doc_id, rule_id FROM f), w AS (SELECT k AS doc_id, {_EDIT} AS rule_id FROM f WHERE k % 5 <> 0 UNION ALL SELECT k, rule_id FROM f WHERE k % 7 = 0)"


@query(_TWO + ", a AS (SELECT doc_id, rule_id, count(*) AS o FROM o GROUP BY ALL), b AS (SELECT doc_id, rule_id, count(*) AS n FROM w GROUP BY ALL) SELECT doc_id, rule_id, CAST(least(coalesce(o, 0), coalesce(n, 0)) AS BIGINT) AS same, CAST(greatest(coalesce(n, 0) - coalesce(o, 0), 0) AS BIGINT) AS new, CAST(greatest(coalesce(o, 0) - coalesce(n, 0), 0) AS BIGINT) AS resolved FROM a FULL JOIN b USING (doc_id, rule_id)")
def diff_structural(spark, sf_dir):
    """Two reports as multisets: same, new and resolved."""
    return compare.diff(_two_reports(spark, sf_dir), ["doc_id", "rule_id"])


_STATES = _TWO + ", a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_id) AS occurrence FROM o), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_id) AS occurrence FROM w), s AS (SELECT doc_id, rule_id, CASE WHEN b.occurrence IS NULL THEN 'resolved' WHEN a.occurrence IS NULL THEN 'introduced' ELSE 'remaining' END AS state FROM a FULL JOIN b USING (doc_id, rule_id, occurrence))"


@query(_STATES + " SELECT doc_id, rule_id, state, count(*) AS n FROM s GROUP BY ALL")
def compare_occurrences(spark, sf_dir):
    """Two scans by occurrence: resolved, remaining, introduced."""
    states = compare.occurrences(_two_reports(spark, sf_dir), ["doc_id", "rule_id"])
    return states.groupBy("doc_id", "rule_id", "state").agg(F.count("*").alias("n"))


@query(_STATES + ", c AS (SELECT count(*) FILTER (state = 'resolved') AS resolved, count(*) FILTER (state = 'remaining') AS remaining, count(*) FILTER (state = 'introduced') AS introduced FROM s) SELECT *, CASE WHEN introduced > 0 THEN 'regressed' WHEN resolved > 0 THEN 'improved' ELSE 'unchanged' END AS outcome, false AS ready_for_review FROM c")
def compare_outcome(spark, sf_dir):
    """What a comparison comes to."""
    states = compare.occurrences(_two_reports(spark, sf_dir), ["doc_id", "rule_id"])
    return compare.outcome(states, "block", "block")


@query("WITH a AS (SELECT source AS path, sha256(text) AS token FROM documents), b AS (SELECT source AS path, sha256(CASE WHEN doc_id % 100 = 3 THEN text || '!' ELSE text END) AS token FROM documents WHERE source <> 'src7' AND doc_id % 20 < 15), x AS (SELECT path, list_sort(list(token)) AS l FROM a GROUP BY path), y AS (SELECT path, list_sort(list(token)) AS l FROM b GROUP BY path) SELECT path, CASE WHEN x.l IS NULL THEN 'added' WHEN y.l IS NULL THEN 'removed' WHEN x.l = y.l THEN 'unchanged' ELSE 'changed' END AS state, CAST(coalesce(len(x.l), 0) AS BIGINT) AS before, CAST(coalesce(len(y.l), 0) AS BIGINT) AS after FROM x FULL JOIN y USING (path)")
def artifact_changes(spark, sf_dir):
    """Contents by path in two scans, paths that occur several times as multisets."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.when(F.col("doc_id") % 100 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    row = lambda side, t: F.struct(F.lit(side).alias("side"), F.sha2(t, 256).alias("token"))
    both = F.array_compact(F.array(row("old", F.col("text")), F.when(F.expr("source <> 'src7' AND doc_id % 20 < 15"), row("new", text))))
    rows = docs.select(F.col("source").alias("path"), F.explode(both).alias("_r")).select("path", "_r.side", "_r.token")
    return compare.artifact_changes(rows)


_LACK = "len(list_filter(required, lambda c: c <> 'text')) > 0"


@query(
    _F
    + ", "
    + _SUMMARY
    + f""", g AS (SELECT list(DISTINCT category) AS cats FROM f),
d AS (SELECT p.*, s.*, coalesce(cats, []) AS cats, {_LACK} AS lacking, manifest IS NOT NULL AND manifest <> 'complete' AS open_manifest,
    len(list_intersect(blocking, coalesce(cats, []))) > 0 AS cat,
    CASE fail_on WHEN 'never' THEN false WHEN 'critical' THEN critical > 0 WHEN 'high' THEN high + critical > 0 WHEN 'medium' THEN medium + high + critical > 0 WHEN 'low' THEN low + medium + high + critical > 0 ELSE findings > 0 END AS sev
    FROM {cases.POLICIES.sql()} p, s, g),
o AS (SELECT *, CASE WHEN lacking OR open_manifest THEN 'incomplete' WHEN cat OR sev THEN 'block' WHEN findings > 0 THEN 'review' ELSE 'pass' END AS outcome FROM d)
SELECT policy_id, verdict AS technical_verdict, outcome AS policy_outcome, CASE outcome WHEN 'incomplete' THEN 2 WHEN 'block' THEN 1 ELSE 0 END AS exit_code,
array_to_string(list_filter([CASE WHEN manifest = 'missing' THEN 'manifest_validation_missing' END, CASE WHEN manifest = 'incomplete' THEN 'manifest_validation_incomplete' END, CASE WHEN manifest = 'inexact' THEN 'manifest_not_exact' END, CASE WHEN lacking THEN 'required_capability_incomplete' END, CASE WHEN cat THEN 'blocking_category_present' END, CASE WHEN sev THEN 'severity_threshold_met' END, CASE WHEN verdict = 'block' THEN 'technical_block_reported' END, CASE WHEN outcome = 'review' THEN 'findings_below_threshold' END, CASE WHEN outcome = 'pass' THEN 'no_findings_observed' END], lambda x: x IS NOT NULL), ',') AS reasons FROM o"""
)
def check_decisions(spark, sf_dir):
    """Decisions of several policies on the scan of the documents."""
    each = _artifacts(spark, sf_dir)
    row = report.summary(each, more=[F.array_distinct(F.flatten(F.collect_set("categories"))).alias("categories")])
    full = row.withColumns({"partial_coverage": F.lit(False), "dependencies_missing": F.lit(False), "coverage": F.array(F.create_map(F.lit("text"), F.lit("complete")))})
    return policy.decide(full, cases.POLICIES.spark(spark)).withColumn("reasons", F.array_join("reasons", ","))


@query(
    f"""WITH e AS (SELECT *, CASE value WHEN 'unsupported' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END AS r FROM {cases.COVERAGE_EVENTS.sql()}),
b AS (SELECT artifact_id, capability, value, r FROM e QUALIFY row_number() OVER (PARTITION BY artifact_id, capability ORDER BY r DESC, seq DESC) = 1)
SELECT artifact_id, string_agg(capability || '=' || value, ',' ORDER BY capability) AS coverage, CASE WHEN max(r) > 0 THEN 'partial' ELSE 'scanned' END AS status FROM b GROUP BY artifact_id"""
)
def coverage_rollup(spark, sf_dir):
    """Coverage after events: the worst counts."""
    out = report.coverage(cases.COVERAGE_EVENTS.spark(spark))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("coverage")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("artifact_id", text.alias("coverage"), "status")


@query(
    "SELECT * FROM (VALUES ('con.txt', 'copy_unchanged', 'action-000001', 'not_portable'), ('copy.txt', 'copy_unchanged', 'action-000002', 'ok'), ('gone.txt', 'omit_from_boundary', 'action-000003', 'ok'), ('odd.txt', 'polish', 'action-000004', 'unsupported'), ('old.txt', 'rename_in_bundle', 'action-000005', 'ok'), ('photo.png', 'strip_png_metadata', 'action-000006', 'ok'), ('same.txt', 'rename_in_bundle', 'action-000007', 'bad_target'), ('sub/held.bin', 'block', 'action-000008', 'ok'), ('twice.txt', 'copy_unchanged', 'action-000009', 'duplicate'), ('undecided.txt', NULL, 'action-000010', 'missing'), ('nofile.txt', 'copy_unchanged', NULL, 'unknown')) AS t(source_path, action, action_id, state)"
)
def plan_completeness(spark, sf_dir):
    """Decisions against an inventory."""
    return inventory.plan(cases.DECISIONS.spark(spark), cases.INVENTORY.spark(spark)).select("source_path", "action", "action_id", "state")


_KEYED = f"WITH p AS (SELECT path, lower(upper(path)) AS key, string_split(path, '/') AS parts FROM {cases.TREE.sql()}), a AS (SELECT DISTINCT array_to_string(parts[1:i], '/') AS folder FROM p, unnest(range(1, len(parts))) AS t(i)), k AS (SELECT folder, lower(upper(folder)) AS key FROM a)"


@query(_KEYED + " SELECT key, 'same_file' AS kind FROM p GROUP BY key HAVING count(*) > 1 UNION ALL SELECT DISTINCT p.key, 'file_is_folder' FROM p JOIN k ON p.key = k.key UNION ALL SELECT key, 'folder_spelling' FROM k GROUP BY key HAVING count(DISTINCT folder) > 1")
def path_collisions(spark, sf_dir):
    """Paths that some systems can't tell apart."""
    return inventory.collisions(cases.TREE.spark(spark))


@query(f"WITH d AS (SELECT * FROM {cases.DECISIONS.sql()}), t AS (SELECT lower(target_path) AS key FROM d WHERE target_path IS NOT NULL) SELECT source_path FROM d WHERE action IN ('omit_from_boundary', 'rename_in_bundle') AND lower(source_path) IN (SELECT key FROM t)")
def path_aliases(spark, sf_dir):
    """Names that a plan takes away but also writes."""
    return inventory.aliases(cases.DECISIONS.spark(spark))


@query(f"SELECT coalesce(e.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'unexpected' WHEN e.size <> o.size OR e.digest <> o.digest OR e.media_type <> o.media_type THEN 'changed:' || array_to_string(list_filter([CASE WHEN e.size <> o.size THEN 'size' END, CASE WHEN e.digest <> o.digest THEN 'digest' END, CASE WHEN e.media_type <> o.media_type THEN 'media_type' END], lambda x: x IS NOT NULL), ',') ELSE 'ok' END AS state FROM {cases.EXPECTED.sql()} e FULL JOIN {cases.OBSERVED.sql()} o ON e.path = o.path")
def output_relation(spark, sf_dir):
    """Expected files against observed ones."""
    return inventory.outputs(cases.EXPECTED.spark(spark), cases.OBSERVED.spark(spark))


@query("WITH a AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS size FROM documents) SELECT doc_id, CAST(sum(size) OVER w AS BIGINT) AS running, sum(size) OVER w <= 1000000 AS within FROM a WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)")
def byte_budget(spark, sf_dir):
    """Documents in order until a budget of bytes is used up."""
    sizes = _docs(spark, sf_dir).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return inventory.running_budget(sizes, "doc_id", "size", 1_000_000).select("doc_id", "running", "within")


_FAULTS: dict = {}
for _relation, _, _, _codes in cases.HYGIENE_FAULTS:
    for _code in _codes:
        _FAULTS[_relation, _code] = _FAULTS.get((_relation, _code), 0) + 1


@query("SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{c}', CAST({n} AS BIGINT))" for (r, c), n in sorted(_FAULTS.items())) + ") AS t(relation, code, n)")
def hygiene_violations(spark, sf_dir):
    """What is found in relations with planted faults; the masked findings of the documents, which are in them, too, have none."""
    docs = _docs(spark, sf_dir).select(F.format_string("a-%020x", "doc_id").alias("artifact_id"), F.lit("docs").alias("path"), "text")
    found = report.masked_findings(docs, ["artifact_id", "path"]).withColumn("part", F.lit(""))
    findings = found.select("finding_id", "artifact_id", "path", "part", "rule_id", "category", "severity", "confidence", "evidence", "line", "column")
    artifacts = docs.select("artifact_id", "path", F.lit("text/plain").alias("media_type"), F.lit("scanned").alias("status"))
    own = "a-ffffffffffffffffffff"  # of the first row of artifacts
    good = {
        "findings": {"finding_id": "f-0123456789abcdef0123", "artifact_id": own, "path": "a/b", "part": "", "rule_id": "pii.email", "category": "pii", "severity": "high", "confidence": "0.98", "evidence": "<email:redacted>", "line": "1", "column": "1"},
        "gaps": {"artifact_id": own, "path": "a/b", "part": "", "capability": "text", "reason": "text_size_limit"},
        "artifacts": {"artifact_id": own, "path": "a/b", "media_type": "text/plain", "status": "scanned"},
    }
    out = {}
    for name, like in (("findings", findings), ("artifacts", artifacts), ("gaps", None)):
        rows = [good[name]] + [good[name] | {column: value} for relation, column, value, _ in cases.HYGIENE_FAULTS if relation == name]
        if like is None:
            out[name] = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in good[name]))
            continue
        given = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in good[name]))
        out[name] = like.unionByName(given.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in like.schema.fields]))
    return hygiene.violations(out)
