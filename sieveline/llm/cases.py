"""Made-up rows that the test tables do not hold, for queries whose SQL must see them: quotes in messages, and hosts to be rejected."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

from sieveline.plans.literals import Literal

from . import quality_rules, quotation


def _messages() -> list[tuple]:
    """Conversations with nested quotes, some of things that nobody said, lines that name an author, empty and missing texts, and equal turns."""
    rng = random.Random(3)
    said = [f"Sentence number {i} says w{i}." for i in range(12)]
    rows = [
        (1, 0, "user", "Hello there. How are you?\nIt rains."),
        (1, 1, "assistant", "> Hello there. How are you?\n\nFine."),
        (1, 2, "user", "Bob wrote:\n>> Hello there. How\n>> are you?\n> Fine.\nGood.\n\n\n\nBye."),
        (1, 2, "user", "> It rains.\nStill."),
        (2, 0, "user", None),
        (2, 1, "assistant", ""),
        (2, 2, "user", "> Nobody said this.\nOdd."),
        (3, 0, "user", "One."),
        (3, 1, "user", "> One.\nTwo."),
        (3, 2, "user", "> Two.\nThree."),
        (3, 3, "user", "> Three.\nFour."),
    ]
    for conv in range(4, 9):
        for turn in range(8):
            quoted = [rng.choice(["> ", ">> ", "> > "]) + rng.choice(said) for _ in range(rng.randrange(4))] if turn else []
            rows.append((conv, turn, "user" if turn % 2 else "assistant", "\n".join([*quoted, rng.choice(said), rng.choice(said)])))
    return rows


def _hosts() -> list[tuple]:
    """Documents of hosts that mostly fail, of good ones, of small ones with a failure, and of none."""
    good = lambda k: " ".join(f"w{k}x{i}" for i in range(14))
    rows = [(k, "too short", "awful.example") for k in range(60)] + [(60 + k, good(k), "awful.example") for k in range(6)]
    rows += [(100 + k, " ".join(["same words again here"] * 9), "repeats.example") for k in range(40)] + [(150, good(150), "repeats.example")]
    rows += [(200 + k, good(200 + k), f"fine{k % 7}.example") for k in range(120)]
    rows += [(400, "bad", "tiny.example"), (401, good(401), "tiny.example"), (402, None, None), (403, good(403), None), (404, "", "fine0.example")]
    return rows


MESSAGES = Literal("conv_id long, turn long, role string, text string", _messages())
HOSTS = Literal("doc_id long, text string, source string", _hosts())


def quotation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """link_quotes() on messages that quote."""
    return quotation.link_quotes(MESSAGES.spark(spark))


def host_verdict_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of judge() where hosts are rejected."""
    out = quality_rules.judge(HOSTS.spark(spark))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"quotation_cases": quotation_cases, "host_verdict_cases": host_verdict_cases}
ORACLE_SQL = {
    "quotation_cases": quotation.ORACLE_SQL["op7_quotation_linking"].replace("FROM conversations", f"FROM {MESSAGES.sql()} AS conversations"),
    "host_verdict_cases": quality_rules.ORACLE_SQL["op9_host_quality"].replace("FROM documents", f"FROM {HOSTS.sql()} AS documents"),
}
