"""Quotation linking: conversations without their quotes, each message tied to what it answers.

All of it is DataFrame functions. Lines with '>' are quotes of a level; runs of
one level are passages. The sentences of passages are hashed in normal form and
joined to the first message of the conversation that has them as its own words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Run, spill, table

MARK = r"^((?:[ \t]{0,3}>)+)"
#: The line before a quote that says whose it is.
SAYS_WHO = r"(?i)(?:wrote|writes|schrieb|escribió|a écrit)[ \t]*:[ \t\r]*$"


def sentences(text: Column) -> Column:
    """md5 of each sentence in normal form: lower case, letters and digits, single spaces."""
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))
    found = F.transform(F.regexp_extract_all(text, F.lit(r"([^.!?]+[.!?]*)"), F.lit(1)), plain)
    return F.array_distinct(F.transform(F.filter(found, lambda x: x != ""), lambda x: F.md5(x)))


def parse_quotes(messages: DataFrame, text: str = "text") -> DataFrame:
    """Add clean (text without quotes and the lines that say whose they are), own (its sentences) and passages (level, sentences).

    A text without a quoted line is clean as it is; a null text stays null and has no sentences.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    mark = lambda x: F.regexp_extract(x, MARK, 1)
    parsed = messages.withColumn("_l", F.transform(lines, lambda x: F.struct(F.length(F.regexp_replace(mark(x), "[^>]", "")).alias("level"), F.trim(F.substring(x, F.length(mark(x)) + 1, F.length(x))).alias("body"), x.alias("line"))))
    at = lambda i: F.try_element_at("_l", i)  # noqa: E731  from 1
    number = F.sequence(F.lit(1), F.size("_l"))
    quoted = F.exists("_l", lambda x: x.level > 0)
    who = lambda i: F.rlike(at(i).line, F.lit(SAYS_WHO)) & (F.coalesce(at(i + 1).level, F.lit(0)) > 0)
    kept = F.transform(F.filter(number, lambda i: (at(i).level == 0) & ~who(i)), lambda i: at(i).line)
    first = F.filter(number, lambda i: (at(i).level > 0) & ((i == 1) | (F.coalesce(F.try_element_at("_l", F.greatest(i - 1, F.lit(1))).level, F.lit(0)) != at(i).level)))
    last = F.filter(number, lambda i: (at(i).level > 0) & (F.coalesce(at(i + 1).level, F.lit(0)) != at(i).level))
    parsed = parsed.withColumn("_kept", kept).withColumn("_runs", F.arrays_zip(first.alias("a"), last.alias("b")))
    passage = lambda r: F.struct(F.try_element_at("_l", r.a).level.alias("level"), sentences(F.concat_ws(" ", F.transform(F.slice("_l", r.a, r.b - r.a + 1), lambda x: x.body))).alias("sentences"))
    joined = F.regexp_replace(F.concat_ws("\n", "_kept"), r"\n[ \t\r]*(?:\n[ \t\r]*)+", "\n\n")
    clean = F.when(quoted, F.regexp_replace(joined, r"^\s+|\s+$", "")).otherwise(F.col(text))
    own = sentences(F.concat_ws(" ", "_kept"))
    return parsed.withColumn("clean", clean).withColumn("own", own).withColumn("passages", F.transform("_runs", passage)).drop("_l", "_kept", "_runs")


def chains(replies: DataFrame) -> DataFrame:
    """conv_id, turn, root (turn) and depth of each message with a reply_to (an earlier turn), by pointer doubling."""
    now = spill(replies.groupBy("conv_id", "turn").agg(F.min("reply_to").alias("root")).withColumn("depth", F.lit(1).cast("long")), "chains")
    if now.isEmpty():
        return now
    while True:
        up = now.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("root").alias("_r"), F.col("depth").alias("_d"))
        nxt = now.join(up, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("root") == F.col("_t")), "left")
        moved = spill(nxt.select("conv_id", "turn", F.coalesce("_r", "root").alias("root"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.col("_r").isNotNull().alias("moved")), "chains")
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return moved


def link_quotes(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) without quotes, tied to what they answer; one row per row.

    Returns conv_id, turn, role, clean, n_passages, n_linked (passages with half
    or more of their sentences found), reply_to (the turn that the outermost
    quotes come from most; of ties the latest), root_turn and depth (of the chain
    of replies; a message that answers none is its own root at depth 0). Sorted by
    conv_id, root_turn, depth and turn the messages are in reply order.

    A quoted sentence comes from the first message of the conversation that has
    it as its own, if that is earlier. Null text: stays null, quotes nothing. A
    null conv_id is a conversation of its own; a null turn neither quotes nor is
    quoted. Repeated rows give equal results; messages of one turn stand side by side
    and share the chain of the one that answers the earliest turn. An empty table gives an
    empty result.
    """
    with Run(messages.sparkSession) as run:
        parsed = parse_quotes(messages.select("conv_id", "turn", "role", "text")).withColumn("_m", F.md5(F.coalesce("text", F.lit(""))))
        quoting = parsed.where(F.size("passages") > 0)
        asked = quoting.where("turn IS NOT NULL").select("conv_id", "turn", "_m", F.posexplode("passages").alias("p", "q")).select("conv_id", "turn", "_m", "p", F.col("q.level").alias("level"), F.size("q.sentences").alias("of"), F.explode("q.sentences").alias("h")).distinct()
        asked = spill(asked, "quoted")
        if asked.isEmpty():
            # No row quotes anything: no message has anything to be joined to.
            found = parsed.select("*", F.lit(None).cast("bigint").alias("reply_to"), F.lit(0).cast("bigint").alias("n_linked"))
            tied = found.withColumn("root_turn", F.col("turn").cast("bigint")).withColumn("depth", F.lit(0).cast("bigint"))
        else:
            wanted = asked.select("conv_id", "h").distinct()
            own = parsed.where("turn IS NOT NULL").select("conv_id", "turn", F.explode("own").alias("h"))
            origin = own.groupBy("conv_id", "h").agg(F.min("turn").alias("origin")).select(F.col("conv_id").alias("_c"), F.col("h").alias("_h"), "origin")
            origin = origin.join(wanted, F.col("_c").eqNullSafe(F.col("conv_id")) & (F.col("_h") == F.col("h")), "left_semi")
            met = asked.join(origin, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("h") == F.col("_h")) & (F.col("origin") < F.col("turn")))
            met = spill(met.select("conv_id", "turn", "_m", "p", "level", "of", "h", "origin"), "linked")
            key = ["conv_id", "turn", "_m"]
            votes = met.groupBy(*key, "level", "origin").agg(F.count_distinct("h").alias("n"))
            best = votes.groupBy(*key).agg(F.max(F.struct((-F.col("level")).alias("l"), "n", "origin")).alias("b")).select(*key, F.col("b.origin").cast("bigint").alias("reply_to"))
            full = met.groupBy(*key, "p", "of").agg(F.count("*").alias("n")).where("2 * n >= of").groupBy(*key).agg(F.count("*").alias("n_linked"))
            links = spill(best.join(full.select(*[F.col(c).alias(f"_{c}") for c in key], "n_linked"), F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("turn") == F.col("_turn")) & (F.col("_m") == F.col("__m")), "left").select(*key, "reply_to", "n_linked"), "replies")
            to = links.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("_m").alias("_x"), "reply_to", "n_linked")
            found = parsed.join(to, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("turn") == F.col("_t")) & (F.col("_m") == F.col("_x")), "left").drop("_c", "_t", "_x")
            chained = chains(links)
            run.keep(links, chained)
            up = chained.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("root").alias("root_turn"), "depth")
            tied = found.join(up, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    return tied.select("conv_id", "turn", "role", "clean", F.size("passages").cast("bigint").alias("n_passages"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), "reply_to", F.coalesce("root_turn", F.col("turn")).cast("bigint").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"))


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages, clean, with what they answer."""
    return link_quotes(table(spark, sf_dir, "conversations"))


_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text, row_number() OVER () AS id FROM conversations),
l AS (SELECT id, conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM m),
k AS (SELECT *, regexp_extract(line, '^((?:[ \t]{0,3}>)+)', 1) AS mark FROM l),
v AS (SELECT *, length(regexp_replace(mark, '[^>]', '', 'g')) AS level, trim(substr(line, length(mark) + 1)) AS body FROM k),
n AS (SELECT *, lead(level, 1, 0) OVER w AS nxt, lag(level, 1, 0) OVER w AS prv FROM v WINDOW w AS (PARTITION BY id ORDER BY i)),
kept AS (SELECT id, any_value(conv_id) AS conv_id, any_value(turn) AS turn, string_agg(line, chr(10) ORDER BY i) AS joined, string_agg(line, ' ' ORDER BY i) AS flat FROM n
    WHERE level = 0 AND NOT (regexp_matches(line, '(?i)(?:wrote|writes|schrieb|escribió|a écrit)[ \t]*:[ \t\r]*$') AND nxt > 0) GROUP BY id),
runs AS (SELECT *, sum(CASE WHEN level <> prv THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS run FROM n),
pas AS (SELECT id, any_value(conv_id) AS conv_id, any_value(turn) AS turn, run, level, string_agg(body, ' ' ORDER BY i) AS flat FROM runs WHERE level > 0 GROUP BY id, run, level),
ps AS (SELECT DISTINCT id, conv_id, turn, run, level, h FROM (SELECT *, trim(regexp_replace(lower(unnest(regexp_extract_all(flat, '[^.!?]+[.!?]*'))), '[^\p{L}\p{N}]+', ' ', 'g')) AS h FROM pas) WHERE h <> ''),
os AS (SELECT conv_id, h, min(turn) AS origin FROM (SELECT *, trim(regexp_replace(lower(unnest(regexp_extract_all(flat, '[^.!?]+[.!?]*'))), '[^\p{L}\p{N}]+', ' ', 'g')) AS h FROM kept) WHERE h <> '' AND turn IS NOT NULL GROUP BY conv_id, h),
met AS (SELECT ps.*, origin FROM ps JOIN os ON ps.conv_id IS NOT DISTINCT FROM os.conv_id AND ps.h = os.h AND origin < turn),
votes AS (SELECT id, conv_id, turn, level, origin, count(DISTINCT h) AS c FROM met GROUP BY ALL),
best AS (SELECT id, conv_id, turn, origin AS reply_to FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY level, c DESC, origin DESC) = 1),
sizes AS (SELECT id, run, count(*) AS n FROM ps GROUP BY id, run),
full_ AS (SELECT id, count(*) AS n_linked FROM (SELECT met.id, met.run FROM met JOIN sizes USING (id, run) GROUP BY met.id, met.run, n HAVING 2 * count(*) >= n) GROUP BY id),
np AS (SELECT id, count(*) AS n_passages FROM pas GROUP BY id),
g AS (SELECT conv_id, turn, min(reply_to) AS reply_to FROM best GROUP BY conv_id, turn),
c AS (SELECT conv_id, turn, reply_to AS root_turn, 1 AS depth FROM g UNION ALL SELECT c.conv_id, c.turn, g.reply_to, c.depth + 1 FROM c JOIN g ON c.conv_id IS NOT DISTINCT FROM g.conv_id AND c.root_turn = g.turn),
r AS (SELECT conv_id, turn, max(depth) AS depth, min(root_turn) AS root_turn FROM c GROUP BY conv_id, turn)
SELECT m.conv_id, m.turn, role,
    CASE WHEN n_passages IS NULL THEN text ELSE regexp_replace(regexp_replace(coalesce(joined, ''), '\n[ \t\r]*(?:\n[ \t\r]*)+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') END AS clean,
    CAST(coalesce(n_passages, 0) AS BIGINT) AS n_passages, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, CAST(reply_to AS BIGINT) AS reply_to,
    CAST(coalesce(root_turn, m.turn) AS BIGINT) AS root_turn, CAST(coalesce(depth, 0) AS BIGINT) AS depth
FROM m LEFT JOIN kept ON m.id = kept.id LEFT JOIN np ON m.id = np.id LEFT JOIN full_ ON m.id = full_.id LEFT JOIN best ON m.id = best.id
LEFT JOIN r ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND m.turn = r.turn
"""

QUERIES = {"op7_quotation_linking": op7_quotation_linking}
ORACLE_SQL = {"op7_quotation_linking": _SQL}
