"""Token counts: exact byte-level BPE counts at every prefix of a text."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from . import bpe_prefix
from .common import batch, map_texts, quoted, table
from .packing import LETTERS, MARKS

#: A space and then more white space: such texts are cut by the full pattern.
_RUN = regex.compile(f" [{bpe_prefix.SPACE}]")
_CHUNK = regex.compile(f"[{bpe_prefix.SPACE}]*[^{bpe_prefix.SPACE}]+|[{bpe_prefix.SPACE}]+$")


class TextCounter:
    """Counts a text from the prefix tables of its pieces, which it keeps by what stands between spaces."""

    def __init__(self, path: str, keep: int = 1_200_000):
        self.bpe, self.keep = bpe_prefix.PrefixCounts(path), keep
        self.known: dict[str, int] = {"": 0}

    def plain(self, text: str) -> bool:
        """Whether a text may be cut at every space: cutting before a run of white space never changes the pieces."""
        return not ("  " in text or _RUN.search(text) or any(x in text for x in self.bpe.special_strings))

    def learn(self, parts: list[str]) -> np.ndarray:
        """The counts of some distinct strings."""
        if len(self.known) + len(parts) > self.keep:
            self.known = {"": 0}
        known, count = self.known, self.bpe.count
        out = np.empty(len(parts), np.int64)
        for k, x in enumerate(parts):
            n = known.get(x)
            if n is None:
                n = known[x] = count(x)
            out[k] = n
        return out

    def after_space(self, parts: pa.Array) -> np.ndarray:
        """The counts of distinct strings that each stand after one space.

        Marks, letters and marks are three pieces (the space goes with the first
        one); all others are counted as they are.
        """
        inner = pc.utf8_trim(parts, MARKS)
        three = pc.match_substring_regex(inner, f"^[{LETTERS}]+$")
        size = np.asarray(pc.utf8_length(parts))
        before = np.where(np.asarray(three), size - np.asarray(pc.utf8_length(pc.utf8_ltrim(parts, MARKS))), 0)
        after = np.where(np.asarray(three), size - np.asarray(pc.utf8_length(pc.utf8_rtrim(parts, MARKS))), 0)
        middle = pc.if_else(three, inner, parts)
        spaced = pc.binary_join_element_wise(pa.array(np.where(before > 0, "", " ").tolist(), middle.type), middle, pa.scalar("", middle.type)).dictionary_encode()
        out = self.learn(spaced.dictionary.to_pylist())[np.asarray(spaced.indices, dtype=np.int64)]
        for n, cut in ((before, lambda x, k: " " + x[:k]), (after, lambda x, k: x[-k:])):
            at = np.flatnonzero(n)
            marks = list(map(cut, parts.take(pa.array(at)).to_pylist(), n[at].tolist()))
            out[at] += self.learn(marks)
        return out

    def long_count(self, text: str) -> int:
        if any(x in text for x in self.bpe.special_strings):
            return self.bpe.count(text)
        return sum(self.bpe.count(x) for x in _CHUNK.findall(text))

    def counts(self, texts: list[str], limit: int | None = None) -> tuple[list[int], list[int]]:
        """The tokens of each text and, given a limit, the bytes of its longest prefix of whole code points within it."""
        plain = [x if self.plain(x) else "" for x in texts]
        lists = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        starts = np.asarray(lists.offsets, dtype=np.int64)
        parts = lists.values.dictionary_encode()
        codes = np.asarray(parts.indices, dtype=np.int64)
        each = self.after_space(parts.dictionary)[codes]
        size = np.asarray(pc.binary_length(parts.dictionary))[codes] + 1
        totals, fits = [], []
        for k, (text, whole) in enumerate(zip(texts, plain, strict=True)):
            if not whole:
                totals.append(self.long_count(text))
                fits.append(self.long_fit(text, limit) if limit is not None and totals[-1] > limit else len(text.encode()))
                continue
            a, b = starts[k], starts[k + 1]
            head = text.split(" ", 1)[0]
            each[a], size[a] = self.bpe.count(head), len(head.encode())
            totals.append(int(each[a:b].sum()))
            if limit is None or totals[-1] <= limit:
                fits.append(int(size[a:b].sum()))
                continue
            done = np.cumsum(each[a:b])
            at = int(np.searchsorted(done, limit, side="right"))  # this part passes the limit
            spent = int(done[at - 1]) if at else 0
            part = (" " if at else "") + parts.dictionary[codes[a + at]].as_py()
            fits.append(int(size[a : a + at].sum()) + self.fit(part, limit - spent))
        return totals, fits

    def fit(self, text: str, limit: int) -> int:
        best = max(k for k, c in enumerate(self.bpe.prefixes(text)) if c <= limit)
        return len(text[:best].encode())

    def long_fit(self, text: str, limit: int) -> int:
        special = any(x in text for x in self.bpe.special_strings)
        done = size = 0
        for piece in [text] if special else _CHUNK.findall(text):
            n = self.bpe.count(piece)
            if done + n > limit:
                return size + self.fit(piece, limit - done)
            done, size = done + n, size + len(piece.encode())
        return size


@cache
def counter_of(path: str) -> TextCounter:
    """One counter for all tasks of a Python worker, so that its tables are reused."""
    return TextCounter(path)


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", limit: int | None = None, prefixes: bool = False) -> DataFrame:
    """Add n_bytes and n_tokens, and from the prefix tables what is asked for.

    limit adds fitting_bytes, the bytes of the longest prefix with at most that
    many tokens. prefixes adds prefix_tokens, an array with the exact count of
    every prefix by code points (0 to the length), which answers any other
    truncation without encoding again.

    A null text counts as empty: no bytes, no tokens. Rows are taken one by one,
    so repeated rows and ids, null ids and an empty table need nothing special;
    columns of df named like the added ones are replaced.
    """
    added = ["n_bytes", "n_tokens"] + ["fitting_bytes"] * (limit is not None) + ["prefix_tokens"] * prefixes
    kept = [f for f in df.schema.fields if f.name not in added]
    schema = ", ".join([f"{quoted(f.name)} {f.dataType.simpleString()}" for f in kept] + [f"{x} bigint" for x in added if x != "prefix_tokens"] + ["prefix_tokens array<int>"] * prefixes)
    names = [f.name for f in kept]

    def make():
        counter = counter_of(vocabulary)

        def work(part: pa.RecordBatch):
            texts = [x or "" for x in part.column(text).to_pylist()]
            counts, fits = counter.counts(texts, limit)
            out = {n: part.column(n) for n in names}
            out["n_bytes"] = np.fromiter((len(x.encode()) for x in texts), np.int64, len(texts))
            out["n_tokens"] = np.array(counts, np.int64)
            if limit is not None:
                out["fitting_bytes"] = np.array(fits, np.int64)
            if prefixes:
                out["prefix_tokens"] = pa.array([counter.bpe.prefixes(x) for x in texts], pa.list_(pa.int32()))
            yield batch(**out)

        return work

    return map_texts(df, make, schema, text)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text by the byte-level vocabulary, and whether they are over 512."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512)
    return out.selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 512 AS over_limit", "fitting_bytes AS bytes_within_limit")


QUERIES = {"op8_token_counts": op8_token_counts}
