"""Packing documents into fixed-length sequences: dominance reduction, then best fit.

The instance is a histogram of piece lengths (at most `capacity` numbers), so the
driver solves it exactly the same way for any number of documents; rows only take
their rank within their length and look up the place that rank was given.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, map_texts, quoted, spill, table, word_codes

CAPACITY = 2048


#: Letters whose lower case and normal form are single letters, so that a run of them is one piece (fixed value).
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿА-яЁё"
#: Marks that may stand around them; those next to each other are one piece, too.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordIds:
    """Token ids of a lower-case vocabulary that drops white space, from a cache of word parts.

    White space never crosses its pieces and its normaliser works within words,
    so the ids of a text are those of its words in turn. A word of marks, letters
    and marks is three pieces; all other words are encoded whole.
    """

    def __init__(self, path: str, keep: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        ends = {i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[list(ends)] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.at = {"": 0}
        self.starts, self.lengths, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def learn(self, letters: set[str], others: set[str]) -> None:
        """Encode what is not known: runs of letters in one go, other strings one by one."""
        if len(self.at) + len(letters) + len(others) > self.keep and not (letters | others) <= self.at.keys():
            self.clear()
        runs, rest = list(letters.difference(self.at)), list(others.difference(self.at).difference(letters))
        sizes, flat = [], []
        for a in range(0, len(runs), 2000):
            part = runs[a : a + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])  # the last id of each piece
            if len(last) != len(part):
                raise ValueError("a run of letters is not one piece of this vocabulary")
            sizes.append(np.diff(last, prepend=-1))
            flat.append(ids)
        ids = [x.ids for x in self.tokenizer.encode_batch(rest, add_special_tokens=False)]
        sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        flat.append(np.fromiter((i for x in ids for i in x), np.uint32, int(sizes[-1].sum())))
        n = np.concatenate(sizes)
        if not len(n):
            return
        base = len(self.at)
        self.at.update(zip([*runs, *rest], range(base, base + len(n)), strict=True))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(n) - n))
        self.lengths = np.concatenate((self.lengths, n))
        self.flat = np.concatenate((self.flat, *flat))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        bounds, codes, distinct = word_codes(texts)
        if not len(distinct):
            return [np.zeros(0, np.uint32) for _ in range(len(texts))]
        inner = pc.utf8_trim(distinct, MARKS)
        whole = pc.invert(pc.match_substring_regex(inner, f"^[{LETTERS}]+$"))
        for x in self.special:
            whole = pc.or_(whole, pc.match_substring(distinct, x))
        middle = pc.if_else(whole, distinct, pc.utf8_lower(inner)).dictionary_encode()
        names, codes_of = middle.dictionary.to_pylist(), np.asarray(middle.indices, np.int64)
        whole = np.asarray(whole)
        odd = {names[i] for i in np.unique(codes_of[whole])}
        # The marks before and after: few words have them, and few differ.
        size = np.asarray(pc.utf8_length(distinct))
        sides = []
        for trim, cut in ((pc.utf8_ltrim, lambda x, n: x[:n]), (pc.utf8_rtrim, lambda x, n: x[-n:])):
            n = np.where(whole, 0, size - np.asarray(pc.utf8_length(trim(distinct, MARKS))))
            at = np.flatnonzero(n)
            sides.append((at, list(map(cut, distinct.take(pa.array(at)).to_pylist(), n[at].tolist()))))
        self.learn(set(names) - odd, odd.union(*(x for _, x in sides)))
        get = self.at.__getitem__
        which = np.zeros((len(distinct), 3), np.int64)
        which[:, 1] = np.fromiter(map(get, names), np.int64, len(names))[codes_of]
        for k, (at, marks) in zip((0, 2), sides, strict=True):
            which[at, k] = np.fromiter(map(get, marks), np.int64, len(marks))
        which = which.ravel()
        # Ids of the three parts of each distinct word, one after another.
        flat = _gather(self.starts[which], self.lengths[which], self.flat)
        lengths = self.lengths[which].reshape(-1, 3).sum(axis=1)
        starts = np.cumsum(lengths) - lengths
        return [_gather(starts[own], lengths[own], flat) for own in np.split(codes, bounds[1:-1])]


def _gather(starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The slices of flat that begin at starts, joined."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(lengths.sum())]


@cache
def words_of(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Cut each document (doc_id, text) into pieces of at most `capacity` ids.

    A document is its ids and then end_id; a null or empty text is just end_id.
    Returns doc_id, piece, start, length, ids_crc32 and, if asked for, the ids.
    Null and repeated doc_ids are kept: every input row gives its own pieces.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def make():
        words = words_of(vocabulary)

        def work(part: pa.RecordBatch):
            ids = part.column("doc_id").to_pylist()
            rows: list[list] = [[] for _ in range(6)]
            for doc, found in zip(ids, words.encode(part.column("text")), strict=True):
                whole = np.append(found, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(whole), capacity)):
                    own = whole[at : at + capacity]
                    for to, x in zip(rows, (doc, k, at, len(own), zlib.crc32(own.tobytes()), own.astype(np.int32) if with_ids else None), strict=True):
                        to.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")[: 6 if with_ids else 5]
            yield batch(**{n: pa.array(x, k) for n, x, k in zip(names, rows, kinds, strict=False)})

        return work

    return map_texts(docs.select("doc_id", "text"), make, schema)


def _largest(sizes: list[int], count: Counter, limit: int) -> int:
    """The largest of the ascending sizes that is still there and at most limit, or 0."""
    lo = bisect_right(sizes, limit)
    while lo and not count[sizes[lo - 1]]:
        lo -= 1
    return sizes[lo - 1] if lo else 0


def _pairs(sizes: list[int], count: Counter, room: int) -> tuple[int, int]:
    """Of all pairs that fit a room the largest sum, and the largest smaller one; 0 for none."""
    there = [x for x in sizes if count[x]]
    top, second, hi = 0, 0, len(there) - 1
    for lo, x in enumerate(there):
        if 2 * x > room:
            break
        while hi >= 0 and there[hi] + x > room:
            hi -= 1
        # The largest partner that is not smaller, another copy of x itself among them.
        if hi > lo:
            top, second = max(top, x + there[hi]), x
        elif hi == lo and count[x] > 1:
            top, second = max(top, 2 * x), x
    return top, second


def reduce_by_dominance(count: Counter, capacity: int) -> list[tuple[int, list[int]]]:
    """Martello-Toth reduction: take out bins of up to three that no other choice can beat.

    For the largest size s with room r beside it, t the largest that fits r: the
    bin {s} dominates every other bin of s if nothing fits; {s, t} does if t
    fills r, if no two of the rest fit r together, or if no three do and t is as
    large as any two that do. {s, t, u}, u the largest beside both, does if no
    three fit r and in no pair that fits it the smaller is larger than u: each
    part of another choice then has a part of this one to take its place. Leaves
    a size that none settles and goes on to smaller ones; count keeps what
    remains. Returns (bins, their sizes).
    """
    fixed = []
    sizes = sorted(s for s, n in count.items() if n)
    for s in reversed(sizes):
        while count[s]:
            room, n = capacity - s, count[s]
            count[s] -= 1  # one s is in the bin, another may be its partner
            t = _largest(sizes, count, room)
            small: list[int] = []  # the three least that are there
            for x in sizes:
                small += [x] * min(count[x], 3 - len(small))
                if len(small) == 3:
                    break
            bin_: list[int] | None = None
            if not t:
                bin_ = []
            elif t == room or len(small) < 2 or sum(small[:2]) > room:
                bin_ = [t]
            elif len(small) < 3 or sum(small) > room:
                top, second = _pairs(sizes, count, room)
                count[t] -= 1
                u = _largest(sizes, count, room - t)
                count[t] += 1
                if t >= top:
                    bin_ = [t]
                elif u and second <= u:
                    bin_ = [t, u]
            count[s] = n
            if bin_ is None:
                break
            # As sizes are used up the rules hold all the more, so they take all bins of this kind at once.
            need = Counter([s, *bin_])
            m = min(count[x] // k for x, k in need.items())
            fixed.append((m, [s, *bin_]))
            for x, k in need.items():
                count[x] -= m * k
    return fixed


def best_fit(count: Counter, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing on a histogram. Returns (bins, [(size, times in each bin)])."""
    groups: dict[int, list[list]] = defaultdict(list)  # room: [bins, content]

    def put(room: int, bins: int, content: list[tuple[int, int]]) -> None:
        if bins:
            groups[room].append([bins, content])

    for s in sorted((s for s, n in count.items() if n), reverse=True):
        left = count[s]
        for room in sorted(r for r in groups if r >= s):
            each = room // s
            while left and groups[room]:
                bins, content = groups[room].pop()
                full = min(bins, left // each)
                put(room - each * s, full, [*content, (s, each)])
                left -= full * each
                rest = bins - full
                if rest and left:  # one bin takes what is left
                    put(room - left * s, 1, [*content, (s, left)])
                    rest, left = rest - 1, 0
                if rest:
                    put(room, rest, content)
                    if not left:
                        break
            if not left:
                break
        each = capacity // s
        put(capacity - each * s, left // each, [(s, each)])
        if left % each:
            put(capacity - left % each * s, 1, [(s, left % each)])
    return [(bins, content) for found in groups.values() for bins, content in found]


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """All bins of the instance, as (bins of that kind, [(size, times)])."""
    count = Counter(lengths)
    fixed = [(n, sorted(Counter(sizes).items(), reverse=True)) for n, sizes in reduce_by_dominance(count, capacity)]
    return fixed + best_fit(count, capacity)


def places(found: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first rank, last rank + 1, times in each bin, first bin, offset in the bin)."""
    rank: Counter = Counter()
    out, first = [], 0
    for bins, content in found:
        at = 0
        for size, times in content:
            out.append((size, rank[size], rank[size] + bins * times, times, first, at))
            rank[size] += bins * times
            at += size * times
        first += bins
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_bucket: int = 50_000) -> DataFrame:
    """Give every piece (doc_id, piece, length from 1 to capacity, ...) its sequence_id and offset.

    Ranks within a length come from two levels: buckets by a hash of the row,
    counted per length, then row numbers within (length, bucket), so no length
    lands in one task, however many pieces have it. The plan has at most a few
    thousand entries for any input. Ties and repeated rows take ranks of their
    own; an empty table gives an empty result. Columns of pieces named like the
    added ones are replaced.
    """
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = pieces.select(F.struct(*map(quoted, names)).alias("row"), "length", "doc_id", "piece")
    n = pieces.count()
    buckets = max(64, -(-n // rows_per_bucket))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    counts = spill(counts, "pack-counts")
    lengths = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}
    base = counts.withColumn("_base", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).selectExpr("length", "_bucket", "coalesce(_base, 0) AS _base")
    by_size: dict[int, list] = defaultdict(list)
    for size, *row in places(plan(lengths, capacity)):
        by_size[size].append(tuple(map(int, row)))
    kind = "array<struct<lo:bigint,hi:bigint,times:bigint,first:bigint,at:bigint>>"
    lookup = F.broadcast(spark.createDataFrame(sorted(by_size.items()), f"length long, _spans {kind}"))  # at most `capacity` rows
    rank = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece"))
    ranked = dealt.withColumn("_rank", rank - 1).join(base, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    placed = ranked.join(lookup, "length").withColumn("_at", F.element_at(F.filter("_spans", lambda x: (x.lo <= F.col("_rank")) & (F.col("_rank") < x.hi)), 1))
    within = F.col("_rank") - F.col("_at.lo")
    return placed.select(*[F.col("row")[c].alias(c) for c in names], (F.col("_at.first") + F.floor(within / F.col("_at.times"))).cast("long").alias("sequence_id"), (F.col("_at.at") + F.pmod(within, F.col("_at.times")) * F.col("length")).cast("long").alias("offset"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 2048 tokens as the reduction and best fit find."""
    import public_tokenizers

    pieces = spill(token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
