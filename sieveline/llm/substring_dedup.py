"""Substring dedup: word windows that start in an earlier document are removed.

Each window of a text is routed by the least hash of the word runs inside it, so
equal windows meet in one shard whatever stands around them. Only routes that
two or more documents share are kept. In a shard the segments (runs of windows of
one route, equal ones once) of documents that others may repeat make a compressed
FM-index, and those of documents that may repeat others are streamed against it:
backward search gives the matching statistics, and for every window that is
matched whole the least document that has it. Of a route of very many unlike
segments those of early documents are indexed first; windows that these do not
have are split by longer runs of words, in the end by whole windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Run, as_bytes, batch, fresh, map_texts, quoted, small, spill, table, word_codes
from .fm_index import FMIndex

WINDOW = 50
#: Words of a run whose hash routes the windows around it.
RUN = 24
#: A segment has at most this many windows; a longer run of one route is cut.
SEGMENT = 256
#: A route of more unlike segments than this is split by the least hash of longer runs inside its windows: of SUB_RUN words, then of WINDOW.
HOT_ROUTE = 200
SUB_RUN = 44
#: Segments of a hot route that all its others are streamed against before it is split.
PIVOTS = 4
#: Words that an index is built over at a time, and words a shard task aims at.
BLOCK_WORDS = 500_000
#: Bytes of segments that a task gives out at a time.
OUT_BYTES = 4 << 20
#: A null doc_id counts as later than all others.
LAST = (1 << 63) - 1

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False).astype(np.uint64)


def routes(hashes: np.ndarray, window: int, run: int) -> np.ndarray:
    """For every window the least mixed hash of the runs inside it."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64)
    grams, have = hashes, 1  # hash of `have` words from each place, by doubling
    while have < run:
        step = min(have, run - have)
        a, b = grams[: len(grams) - step], grams[step:]
        grams, have = _mix(a * _ODD + b + np.uint64(have)), have + step
    low, have, wide = grams, 1, window - run + 1
    while have < wide:
        step = min(have, wide - have)
        low, have = np.minimum(low[: len(low) - step], low[step:]), have + step
    return low


def segments_of(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of windows of one route begin, at most SEGMENT windows each, and their routes."""
    if not len(low):
        return np.zeros(0, np.int64), low
    begin = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    size = np.diff(np.append(begin, len(low)))
    if size.max() > SEGMENT:
        more = -(-size // SEGMENT)
        begin = np.repeat(begin, more) + SEGMENT * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more))
    return begin, low[begin]


def _analyse(docs: DataFrame, window: int, run: int) -> DataFrame:
    """Per row of docs: id, th (hash of the text), key (of its words), n_words, sha256 of the words, and its routes."""

    def work(part: pa.RecordBatch):
        starts, codes, words = word_codes(part.column("text"))
        hashes = word_hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
        keys, digests, begins, values = [], [], [], []
        for k, text in enumerate(as_bytes(part.column("text"))):
            joined = b" ".join(text.split())
            digests.append(hashlib.sha256(joined).hexdigest())
            keys.append(digests[-1][:32])
            b, v = segments_of(routes(hashes[starts[k] : starts[k + 1]], window, run))
            begins.append(b.astype(np.int32))
            values.append(v.astype(np.int64))
        bounds = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in begins]))), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x))) for x in (values, begins)]
        yield batch(doc_id=part.column("doc_id"), id=part.column("id"), th=part.column("th"), key=pa.array(keys), n_words=pa.array(np.diff(starts)), sha=pa.array(digests), route=lists[0], begin=lists[1])

    return map_texts(docs, lambda: work, "doc_id long, id long, th long, key string, n_words long, sha string, route array<bigint>, begin array<int>")


def _sid(seg: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(seg, digest_size=8).digest(), "little", signed=True)


def _pieces(candidates: DataFrame, window: int) -> DataFrame:
    """The segments of each candidate text: route, words, sid (hash of the words), and where."""

    def work(part: pa.RecordBatch):
        rows: list[tuple] = []
        for id_, th, text, segs in zip(part.column("id").to_pylist(), part.column("th").to_pylist(), as_bytes(part.column("text")), part.column("segs").to_pylist(), strict=True):
            words = text.split()
            for s in segs:
                seg = b" ".join(words[s["begin"] : s["begin"] + s["n"] + window - 1])
                rows.append((s["route"], seg, _sid(seg), id_, th, s["begin"]))
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        named = {c: pa.array(x, k) for c, x, k in zip(("route", "seg", "sid", "id", "th", "begin"), cols, kinds, strict=True)}
        yield batch(**named | {"seg": named["seg"].cast(pa.string())})

    return map_texts(candidates, lambda: work, "route long, seg string, sid long, id long, th long, begin int")


def _pivots(hot: DataFrame) -> DataFrame:
    """PIVOTS segments of each route, the earliest of as many parts of it: route and pivots (seg, least)."""
    part = hot.groupBy("route", F.pmod("sid", F.lit(PIVOTS)).alias("_part")).agg(F.min_by(F.struct("seg", "least"), F.struct("least", "sid")).alias("p"))
    return part.groupBy("route").agg(F.collect_list("p").alias("pivots"))


def _split(hot: DataFrame, window: int, run: int) -> DataFrame:
    """Segments (with their route's pivots) cut anew by runs of `run` words: route, words and sid of each part, what it is part of (of_route, of_sid), from which windows on (at), how many (n), and its documents' bounds.

    Windows that stand in a pivot of a document before all of the segment's are
    in no part: they are the places (at) of a row without words, whose least is such
    a document. Any later segment that has them has them from the pivot, too. Equal parts
    of a segment are one row.
    """

    def work(part: pa.RecordBatch):
        own_routes, offsets, pivots = part.column("route").to_numpy(), np.asarray(part.column("pivots").offsets), part.column("pivots").values
        chosen = np.concatenate([np.arange(offsets[k], offsets[k + 1]) for k in np.unique(own_routes, return_index=True)[1]])
        early = pivots.take(pa.array(chosen))
        starts, codes, words = word_codes(pa.concat_arrays([part.column("seg"), early.field("seg")]))
        hashes = word_hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
        end = starts[part.num_rows]
        index = FMIndex(codes[end:], starts[part.num_rows :] - end, np.asarray(early.field("least")), window)
        many, found = index.match(codes[:end], starts[: part.num_rows + 1])
        names = ("route", "seg", "sid", "of_route", "of_sid", "at", "n", "least", "most")
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int64())

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            named = {c: pa.array(x, k) for c, x, k in zip(names, cols, kinds, strict=True)}
            return batch(**named | {"seg": named["seg"].cast(pa.string())})

        rows: list[tuple] = []
        size = 0
        for k, (route, sid, least, most, seg) in enumerate(zip(*(part.column(c).to_pylist() for c in ("route", "sid", "least", "most")), as_bytes(part.column("seg")), strict=True)):
            low = routes(hashes[starts[k] : starts[k + 1]], window, run)
            place = slice(starts[k], starts[k] + len(low))
            known = (many[place] == window) & (found[place] < least)
            if known.any():
                rows.append((None, None, None, route, sid, np.flatnonzero(known), 1, int(found[place][known].max()), most))
            left = np.flatnonzero(~known)
            turn = np.flatnonzero(np.diff(left) > 1) + 1
            keys = _mix(low * _ODD + np.int64(route).view(np.uint64)).view(np.int64)
            own = seg.split()
            places: dict[tuple, list] = {}
            for of in np.split(left, turn) if len(left) else []:
                begin, _ = segments_of(low[of])
                for at, n in zip((of[0] + begin).tolist(), np.diff(np.append(begin, len(of))).tolist(), strict=True):
                    places.setdefault((keys[at].item(), b" ".join(own[at : at + n + window - 1]), n), []).append(at)
            for (key, cut, n), at in places.items():
                rows.append((key, cut, _sid(cut), route, sid, at, n, least, most))
                size += len(cut)
            if size >= OUT_BYTES:
                yield out(rows)
                rows, size = [], 0
        yield out(rows)

    return map_texts(hot.select("route", "sid", "least", "most", "seg", "pivots"), lambda: work, "route long, seg string, sid long, of_route long, of_sid long, at array<int>, n int, least long, most long", "seg")


def _words(rows: pa.Table | pa.RecordBatch) -> int:
    return rows.num_rows + (pc.sum(pc.count_substring(rows.column("seg"), " ")).as_py() or 0)


def search(group: pa.Table, window: int) -> pa.RecordBatch:
    """The least document of each window of the segments of whole routes (in order of route): route, sid, first.

    Indexed are the segments of documents that another one of the route may come
    after, streamed are those of documents that another may come before; the rest
    repeat nothing.
    """
    route, least, most = (np.asarray(group.column(c)) for c in ("route", "least", "most"))
    begin = np.flatnonzero(np.concatenate(([True], route[1:] != route[:-1])))
    rows = np.diff(np.append(begin, len(route)))
    indexed = np.flatnonzero(least < np.repeat(np.maximum.reduceat(most, begin), rows))
    streamed = np.flatnonzero(most > np.repeat(np.minimum.reduceat(least, begin), rows))
    starts, codes, _ = word_codes(group.column("seg").combine_chunks())
    sizes = np.diff(starts)

    def pick(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = sizes[which]
        bounds = np.concatenate(([0], np.cumsum(n)))
        return codes[np.repeat(starts[which] - bounds[:-1], n) + np.arange(bounds[-1])], bounds

    index = FMIndex(*pick(indexed), least[indexed], window)
    own, bounds = pick(streamed)
    many, found = index.match(own, bounds)
    out = np.full(len(codes), LAST, np.int64)
    place = np.repeat(starts[streamed] - bounds[:-1], sizes[streamed]) + np.arange(len(own))
    out[place[many == window]] = found[many == window]
    # One number a window: the last window - 1 places of a segment begin none.
    windows = np.maximum(sizes - window + 1, 0)
    ends = np.concatenate(([0], np.cumsum(windows)))
    flat = out[np.repeat(starts[:-1] - ends[:-1], windows) + np.arange(ends[-1])]
    return batch(route=group.column("route").combine_chunks(), sid=group.column("sid").combine_chunks(), first=pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))


def _first_documents(distinct: DataFrame, window: int, runs: list[int]) -> DataFrame:
    """For every distinct segment (route, sid, seg, least, most) of routes that documents share the least document of each of its windows, or one before all of the segment's.

    Routes of more than HOT_ROUTE segments are streamed against their pivots, and
    what these do not have is split by the first of runs, and so on; what the whole
    window splits (the last of runs) is never hot, so an index holds whole routes
    and about BLOCK_WORDS words.
    """
    spark = distinct.sparkSession
    stats = distinct.groupBy("route").agg(F.count("*").alias("of"), F.min("least").alias("lo"), F.max("most").alias("hi"), F.sum(F.octet_length("seg")).alias("size")).where("lo < hi")
    stats = spill(stats.select("route", "size", ((F.col("of") > HOT_ROUTE) & F.lit(bool(runs))).alias("hot")), "sub-stats")
    size, n_hot = stats.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count_if("hot")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        words = 0
        for part in batches:  # sorted by route
            held.append(part)
            words += _words(part)
            if words >= BLOCK_WORDS:
                whole = pa.Table.from_batches(held)
                route = np.asarray(whole.column("route"))
                end = int(np.searchsorted(route, route[-1], "left"))  # the last route may go on
                if end:
                    yield search(whole.slice(0, end), window)
                    held = whole.slice(end).to_batches()
                    words = _words(whole.slice(end))
        if held and (whole := pa.Table.from_batches(held)).num_rows:
            yield search(whole, window)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (5 * BLOCK_WORDS)))
    cold = distinct.join(stats.where("NOT hot").select("route"), "route", "left_semi")
    found = spill(cold.repartition(tasks, "route").sortWithinPartitions("route").mapInArrow(run, "route long, sid long, first array<bigint>"), "sub-firsts")
    if not n_hot:
        return found
    hot = distinct.join(stats.where("hot").select("route"), "route", "left_semi")
    pivots = spill(_pivots(hot), "sub-pivots")
    every = spill(_split(hot.join(small(pivots, n_hot), "route"), window, runs[0]), "sub-parts")
    parts, known = every.where("seg IS NOT NULL"), every.where("seg IS NULL")
    below = _first_documents(spill(parts.groupBy("route", "sid", "seg").agg(F.min("least").alias("least"), F.max("most").alias("most")), "sub-segments"), window, runs[1:])
    whole = parts.join(below, ["route", "sid"], "left").select("of_route", "of_sid", "at", F.coalesce("first", F.array_repeat(F.lit(LAST), F.col("n"))).alias("first"))
    whole = whole.union(known.select("of_route", "of_sid", "at", F.array("least")))
    placed = F.transform("at", lambda x: F.struct(x.alias("at"), F.col("first").alias("first")))
    joined = whole.groupBy("of_route", "of_sid").agg(F.array_sort(F.flatten(F.collect_list(placed))).alias("l"))
    return found.union(spill(joined.select("of_route", "of_sid", F.flatten(F.transform("l", lambda x: x["first"]))), "sub-firsts"))


def _cut(hit: DataFrame, window: int) -> DataFrame:
    """Texts without the words of their removed windows: id, th, n_removed, sha_left, kept."""

    def work(part: pa.RecordBatch):
        removed, digests, left = [], [], []
        for text, begins in zip(as_bytes(part.column("text")), part.column("begins").to_pylist(), strict=True):
            words = np.array(text.split(), dtype=object)
            edge = np.zeros(len(words) + 1, np.int64)
            at = np.unique(np.concatenate([np.asarray(x, np.int64) for x in begins]))
            edge[at] += 1
            edge[at + window] -= 1
            keep = np.cumsum(edge[:-1]) == 0
            joined = b" ".join(words[keep].tolist())
            removed.append(len(words) - int(keep.sum()))
            digests.append(hashlib.sha256(joined).hexdigest())
            left.append(joined.decode())
        yield batch(id=part.column("id"), th=part.column("th"), n_removed=pa.array(removed, pa.int64()), sha_left=pa.array(digests), kept=pa.array(left))

    return map_texts(hit, lambda: work, "id long, th long, n_removed long, sha_left string, kept string")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))


def find_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """One row per row of docs (doc_id, text): what repeats earlier documents, and what is left.

    Words are runs without ASCII white space. A word goes if a window over it
    also starts in a document with a smaller doc_id; windows are those of the
    input. Returns doc_id, id, th, n_words, n_removed, kept_sha256 (of the kept
    words joined by a space) and kept (that text; null where nothing goes).

    Null text: no words. Null doc_id: later than every other, and never the
    earlier one of another null. Rows of one doc_id never remove each other's
    words; equal rows give equal results. Texts shorter than a window, empty
    texts and an empty table lose nothing.
    """
    with Run(docs.sparkSession) as scope:
        docs = _keyed(docs.select("doc_id", "text"))
        rows = spill(_analyse(docs, window, run).withColumn("rid", F.monotonically_increasing_id()), "sub-rows")
        # Equal word sequences are one text with its least document: every window of the others starts there. One row
        # (rid) stands for it, so repeated rows go no further. (Written before it is joined, so that copies are not one task.)
        firsts = rows.groupBy("key").agg(F.min(F.struct("id", "th", "rid")).alias("f"))
        firsts = spill(firsts.select("key", F.col("f.id").alias("first"), F.col("f.th").alias("th"), F.col("f.rid").alias("rid")), "sub-copies")
        own = rows.where(F.size("route") > 0).join(firsts.select("rid"), "rid", "left_semi")
        windows = F.col("n_words") - (window - 1)
        ends = F.concat(F.slice("begin", 2, F.greatest(F.size("begin") - 1, F.lit(0))), F.array(windows.cast("int")))
        parts = own.select("id", "th", F.explode(F.arrays_zip(F.col("route"), F.col("begin"), ends.alias("end"))).alias("s")).select("id", "th", F.col("s.route").alias("route"), F.col("s.begin").alias("begin"), (F.col("s.end") - F.col("s.begin")).alias("n"))
        parts = spill(parts, "sub-routes")
        shared = parts.groupBy("route").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("route")
        wanted = parts.join(shared, "route").groupBy("id", "th").agg(F.collect_list(F.struct("route", "begin", "n")).alias("segs"))
        once = docs.groupBy("id", "th").agg(F.first("text").alias("text"))
        candidates = spill(once.join(wanted, ["id", "th"]), "sub-texts")
        pieces = spill(_pieces(candidates, window), "sub-pieces")
        distinct = spill(pieces.groupBy("route", "sid", "seg").agg(F.min("id").alias("least"), F.max("id").alias("most")), "sub-segments")
        found = _first_documents(distinct, window, [max(run, window * SUB_RUN // WINDOW), window])
        at = pieces.select("route", "sid", "id", "th", "begin").join(found, ["route", "sid"])
        gone = F.filter(F.transform("first", lambda x, i: F.when(x < F.col("id"), F.col("begin") + i)), lambda x: x.isNotNull())
        begins = at.withColumn("gone", gone).where(F.size("gone") > 0).groupBy("id", "th").agg(F.collect_list("gone").alias("begins"))
        cut = spill(_cut(candidates.select("id", "th", "text").join(begins, ["id", "th"]), window), "sub-cut")
        measured = spill(rows.select("doc_id", "id", "th", "key", "n_words", "sha"), "sub-rows")
        texts = spill(firsts.select("key", "first", "th").join(cut.withColumnRenamed("id", "first"), ["first", "th"], "left").drop("th"), "sub-texts")
        scope.keep(measured, texts)
    joined = measured.join(texts, "key")
    copy = (F.col("id") > F.col("first")) & (F.col("n_words") >= window)
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "doc_id", "id", "th", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("sha_left", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (with any columns) with repeated windows cut out of text; texts that lose nothing stay as they are.

    Documents of which nothing is left go. n_chars, where there is one, is that of
    the new text. Equal rows stay equal rows; for the rest see find_repeats.
    """
    id_, hash_, left = fresh(docs, "id", "hash", "left")
    found = find_repeats(docs.select("doc_id", "text"), window).where("kept IS NOT NULL").select(F.col("id").alias(id_), F.col("th").alias(hash_), F.col("kept").alias(left)).dropDuplicates([id_, hash_])
    keyed = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn(hash_, F.xxhash64(F.coalesce("text", F.lit(""))))
    out = keyed.join(found, [id_, hash_], "left").where(F.col(left).isNull() | (F.col(left) != "")).withColumn("text", F.coalesce(left, "text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(left).isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*map(quoted, docs.columns))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that windows of 50 repeated from earlier documents take from it."""
    return find_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS gram FROM g),
f AS (SELECT doc_id, i FROM h QUALIFY min(doc_id) OVER (PARTITION BY gram) < doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM f),
r AS (SELECT doc_id, list(k) AS ks FROM x GROUP BY doc_id),
o AS (SELECT w.doc_id, ws, coalesce(ks, []) AS ks FROM w LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ks) AS BIGINT) AS n_removed,
    CASE WHEN len(ks) = 0 THEN sha256(array_to_string(ws, ' '))
    ELSE sha256(array_to_string([y FOR y, j IN ws IF NOT list_contains(ks, j)], ' ')) END AS kept_sha256
FROM o
"""

QUERIES = {"op1_substring_dedup": op1_substring_dedup}
ORACLE_SQL = {"op1_substring_dedup": _SQL}
