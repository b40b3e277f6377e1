"""Quality rules of single documents, and verdicts on whole hosts.

A host's failure rate is shrunk towards that of all hosts by a beta prior whose
strength is fitted to the hosts' own rates (method of moments, less the spread
that counting alone gives), so a host with few documents is not condemned by them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Run, as_bytes, batch, fresh, map_texts, quoted, spill, spill_counted, table, word_codes

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host is rejected if its shrunk failure rate is over this.
MAX_HOST_RATE = 0.5
#: At most this many rejected hosts are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 50_000
#: Bounds of the prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 1_000_000.0

_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(codes: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows of `window` codes that occur twice or more, the first included. Exact."""
    n = len(codes)
    if n <= window:
        return 0
    distinct, own = np.unique(codes, return_inverse=True)
    rank, of, base = own.astype(np.int64), 1, len(distinct)
    key, top = rank, base
    while of < window:  # add a word at a time; where the numbers would pass 63 bits, rank them first
        if top > (1 << 62) // base:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            top = n
        key = key[: n - of] * base + rank[of:]
        top *= base
        of += 1
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(n + 1, np.int64)
    edges[: len(key)] += twice
    edges[window:] -= twice
    return int((np.cumsum(edges[:n]) > 0).sum())


def measure(part: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text; a null text counts as empty."""
    starts, codes, _ = word_codes(part)
    blank = {*b" \t\n\v\f\r"}
    table_of = np.zeros(256, np.uint8)  # 1: starts a code point of a word, 2: a symbol
    table_of[[b for b in range(256) if b & 0xC0 != 0x80 and b not in blank]] = 1
    table_of[[*b"#*$%&|<>"]] = 3
    chars, symbols, dup, repeat = [], [], [], []
    for k, text in enumerate(as_bytes(part)):
        kinds = np.bincount(table_of[np.frombuffer(text, np.uint8)], minlength=4)
        chars.append(kinds[1] + kinds[3])
        symbols.append(kinds[3])
        lines = [x for x in text.split(b"\n") if x and not x.isspace()] if b"\n" in text else []
        dup.append(len(lines) - len(set(lines)))
        repeat.append(repeated_words(codes[starts[k] : starts[k + 1]]))
    counts = (np.diff(starts), chars, symbols, dup, repeat)
    return {x.split()[0]: np.asarray(v, np.int64) for x, v in zip(_BASE.split(", "), counts, strict=True)}


def base_rules(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, the base counts of text, and base_failed."""
    fields = {f.name: f for f in docs.schema.fields}
    schema = ", ".join([f"{quoted(c)} {fields[c].dataType.simpleString()}" for c in keep] + [_BASE])

    def work(part: pa.RecordBatch):
        yield batch(**{c: part.column(c) for c in keep}, **measure(part.column("text")))

    out = map_texts(docs, lambda: work, schema)
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(measured: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: n_docs, n_failed, shrunk_rate, host_rejected. Null hosts have none."""
    hosts = measured.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    hosts_n, n, failed, squares = hosts.agg(F.count("*"), F.sum("n_docs"), F.sum("n_failed"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs"))).first()
    mean = failed / n if n else 0.0
    # The rates' variance, weighted by documents, less what binomial counts of equal hosts would have.
    spread = squares / n - mean * mean - hosts_n * mean * (1 - mean) / n if n else 0.0
    strength = min(max(mean * (1 - mean) / spread - 1, WEAKEST), STRONGEST) if spread > 1e-12 else STRONGEST
    shrunk = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("host_rejected", F.col("shrunk_rate") > max_rate)


def judge(docs: DataFrame, host: str = "source", keep: tuple[str, ...] = ("doc_id",), max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Every document with its base counts, base_failed and kept.

    kept is false for a document that fails the base rules and for one of a
    rejected host. A null text has no words, so it fails; a document without a
    host (null) is judged alone. Rows are judged one by one, repeated ids and
    rows included; an empty table gives an empty result. Columns of docs other
    than `keep` and host are not carried; those may not have a name that is added.
    """
    own = [c for c in dict.fromkeys([*keep, host])]
    with Run(docs.sparkSession) as run:
        measured = spill(base_rules(docs.select(*own, "text"), own), "quality")
        host_, out_ = fresh(measured, "host", "out")
        verdicts, n = spill_counted(host_verdicts(measured, host, max_rate).where("host_rejected").select(F.col(host).alias(host_), F.lit(True).alias(out_)), "rejected")
        run.keep(measured, verdicts)
    # Only rejected hosts are joined: few are broadcast, and of many, one with very many documents is split as it is read (AQE).
    joined = measured.join(F.broadcast(verdicts) if n <= MOST_BROADCAST else verdicts, F.col(host) == F.col(host_), "left")
    joined = joined.withColumn("host_rejected", F.coalesce(out_, F.lit(False))).drop(host_, out_)
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_good(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of docs (text, host and any other columns) that judge() would keep, unchanged.

    The rules are applied twice, first for the hosts and then to the rows, so
    that no text is written or shuffled in between.
    """
    (rejected_,) = fresh(docs, "rejected")
    with Run(docs.sparkSession) as run:
        measured = spill(base_rules(docs.select(host, "text"), [host]), "quality")
        rejected, n = spill_counted(host_verdicts(measured, host, max_rate).where("host_rejected").select(F.col(host).alias(rejected_)), "rejected")
        run.keep(rejected)

    def work(part: pa.RecordBatch):
        m = measure(part.column("text"))
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
        yield part.filter(pa.array(~failed))

    passed = map_texts(docs, lambda: work, docs.schema)
    if not n:
        return passed
    return passed.join(F.broadcast(rejected) if n <= MOST_BROADCAST else rejected, F.col(host) == F.col(rejected_), "left_anti")


def op9_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict on every document."""
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[x.split()[0] for x in _BASE.split(", ")], "base_failed", "kept")


_SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
    [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM t),
g AS (SELECT *, len(ws) AS n,
    CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) ELSE [] END AS gs FROM w),
e AS (SELECT doc_id, unnest(gs) AS gram, unnest(range(1, len(gs) + 1)) AS i FROM g WHERE len(gs) > 1),
d AS (SELECT doc_id, i FROM e QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
r AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM d) GROUP BY doc_id),
m AS (SELECT g.doc_id, source, CAST(n AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
    FROM g LEFT JOIN r ON g.doc_id = r.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM b WHERE source IS NOT NULL GROUP BY source),
q AS (SELECT sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) AS squares, count(*) / sum(n) AS per_document FROM h),
p AS (SELECT mean, squares - mean ** 2 - per_document * mean * (1 - mean) AS spread FROM q),
s AS (SELECT mean, CASE WHEN spread > 1e-12 THEN least(greatest(mean * (1 - mean) / spread - 1, 1), 1000000) ELSE 1000000 END AS strength FROM p),
v AS (SELECT source, (f + mean * strength) / (n + strength) > 0.5 AS rejected FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM b LEFT JOIN v ON b.source = v.source
"""

QUERIES = {"op9_host_quality": op9_host_quality}
ORACLE_SQL = {"op9_host_quality": _SQL}
