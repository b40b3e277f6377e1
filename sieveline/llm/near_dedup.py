"""Near-duplicate classes: Order MinHash sketches, star candidates, banded alignment.

A sketch entry takes the two least of a text's five-word runs (each labelled with
its occurrence, so that repeats count) under one hash and keeps them in text
order; texts with an equal entry meet. In each bucket all are compared with its
least text by banded alignment of their words, never with all others; those that
are not joined by that are compared with the least of the rest, and so on while
rounds join much. What a bucket then still holds apart is compared pair by pair,
however many texts it holds: large ones by pairs of blocks.
"""

from __future__ import annotations

import hashlib
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .alignment import edit_distance
from .common import ROWS_OF_A_FILE, Run, batch, fresh, map_texts, small, spill, spill_counted, table, word_codes
from .substring_dedup import _ODD, _mix, word_hashes

#: Words of a run, and least similarity (1 - edits / words of the longer text).
RUN = 5
SIMILARITY = 0.8
#: Sketch entries of a text. Texts that share a share s of their runs (s of 0.8 is the law) have each entry in common with
#: probability s^2 or so: of pairs at 0.8, one in 10^10 shares none.
SKETCHES = 24
PAIRS_OF_A_TASK = 500
#: Star rounds go on while one joins at least this share of the pairs that it compares; all pairs follow anyway.
STAR_SHARE = 0.1
#: Pairs of a bucket of up to FEW texts are rows; those of a larger one go by pairs of blocks of about BLOCK texts and at most BLOCK_WORDS words.
#: Blocks of a bucket of more than HOT texts grow with it, so that a text still goes to HOT / BLOCK groups, up to MOST_BLOCK texts.
FEW = 16
BLOCK = 256
HOT = 4096
MOST_BLOCK = 2048
BLOCK_WORDS = 1 << 20
#: Counts by which the distance of two texts is bounded from below.
COUNTS = 256

_SEEDS = _mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _ODD)


def normal_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words in lower case without marks, as word_codes gives them; words of marks alone go."""
    starts, codes, words = word_codes(column)
    plain = pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}\p{N}]+", "").dictionary_encode()
    codes = np.asarray(plain.indices, dtype=np.int64)[codes] if len(codes) else codes
    empty = pc.index(plain.dictionary, pa.scalar("", plain.dictionary.type)).as_py()
    if empty >= 0:
        real = codes != empty
        starts = np.concatenate(([0], np.cumsum(real)))[starts]
        codes = codes[real]
    return starts, codes, plain.dictionary


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Order MinHash of a text from the hashes of its words: SKETCHES numbers, none for no words."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    if n < RUN:  # one run, of all words
        grams = np.array([0], np.uint64)
        for h in hashes:
            grams = _mix(grams * _ODD + h)
    else:
        grams = hashes[: n - RUN + 1]
        for k in range(1, RUN):
            grams = _mix(grams * _ODD + hashes[k : n - RUN + 1 + k])
    order = np.argsort(grams, kind="stable")
    new = np.concatenate(([True], grams[order[1:]] != grams[order[:-1]]))
    place = np.arange(len(grams))
    occurrence = np.empty(len(grams), np.uint64)
    occurrence[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    labelled = _mix(grams + occurrence * _ODD)
    out = np.empty(SKETCHES, np.uint64)
    several = max(1, (1 << 20) // len(labelled))
    for a in range(0, SKETCHES, several):
        x = (labelled[None, :] ^ _SEEDS[a : a + several, None]) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        rows = np.arange(len(x))
        first = x.argmin(axis=1)
        x[rows, first] = ~np.uint64(0)
        second = x.argmin(axis=1)
        low, high = np.minimum(first, second), np.maximum(first, second)
        out[a : a + several] = _mix(_mix(labelled[low] + _SEEDS[a : a + several]) * _ODD + labelled[high])
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, th, text): rid (a row number of its own), key (of the normal words; null for none) and entries."""

    def work(part: pa.RecordBatch):
        starts, codes, words = normal_words(part.column("text"))
        hashes = word_hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
        keys, entries, sizes = [], [], np.diff(starts)
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            own = hashes[a:b]
            keys.append(hashlib.md5(own.tobytes()).hexdigest() if len(own) else None)
            entries.append(sketch(own).view(np.int64))
        bounds = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in entries]))), pa.int32())
        yield batch(doc_id=part.column("doc_id"), th=part.column("th"), key=pa.array(keys, pa.string()), entries=pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(entries), pa.int64())), words=pa.array(sizes, pa.int64()))

    return map_texts(docs, lambda: work, "doc_id long, th long, key string, entries array<bigint>, words long").withColumn("rid", F.monotonically_increasing_id())


def alike(pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of rows whose texts (ta, tb) align well enough, by words in normal form."""

    def work(part: pa.RecordBatch):
        both = pa.concat_arrays([part.column("ta"), part.column("tb")])
        starts, codes, _ = normal_words(both)
        n, ok = part.num_rows, []
        for k in range(n):
            a, b = codes[starts[k] : starts[k + 1]], codes[starts[n + k] : starts[n + k + 1]]
            limit = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
            ok.append(edit_distance(a.tolist(), b.tolist(), limit) is not None)
        mask = pa.array(ok, pa.bool_())
        yield batch(a=part.column("a").filter(mask), b=part.column("b").filter(mask))

    return map_texts(pairs, lambda: work, "a long, b long", "ta")


def block_links(members: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of roots that a pair of aligned texts joins, from all pairs of each bucket's members (bucket, rid, root, n, words).

    A bucket is split into blocks, and each pair of blocks is one group of bounded
    size. Pairs are left out only if their texts are in one class by then, or if
    lengths or counts of words prove that they are too far apart.
    """
    block = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(BLOCK), F.ceil(F.col("n") * (BLOCK / HOT))))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("words") / BLOCK_WORDS)).cast("int")
    dealt = members.withColumn("_of", blocks).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("_of")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    dealt = dealt.select("bucket", "rid", "root", "leaves", "block", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"))

    def work(part: pa.Table) -> pa.Table:
        starts, codes, _ = normal_words(pa.concat_arrays(part.column("text").chunks))
        n, sizes = part.num_rows, np.diff(starts)
        counts = np.bincount(np.repeat(np.arange(n), sizes) * COUNTS + codes % COUNTS, minlength=n * COUNTS).reshape(n, COUNTS).astype(np.int32)
        roots, block = (part.column(c).to_numpy() for c in ("root", "block"))
        one, now, out = part.column("i")[0] == part.column("j")[0], roots.copy(), []
        place, bucket = np.arange(n), part.column("bucket")[0].as_py()
        leaves = [set(x) for x in part.column("leaves").to_pylist()]
        for a in range(n):
            other = place[a + 1 :]
            other = other[now[other] != now[a]] if one else other[(now[other] != now[a]) & (block[other] != block[a])]
            limit = ((1 - similarity) * np.maximum(sizes[other], sizes[a]) + 1e-9).astype(np.int64)
            near = np.abs(sizes[other] - sizes[a]) <= limit
            other, limit = other[near], limit[near]
            more = np.maximum(counts[a] - counts[other], 0).sum(axis=1)
            near = np.maximum(more, more - (sizes[a] - sizes[other])) <= limit
            own = codes[starts[a] : starts[a + 1]].tolist()
            for b, most in zip(other[near].tolist(), limit[near].tolist(), strict=True):
                if now[a] != now[b] and min(leaves[a] & leaves[b]) == bucket and edit_distance(own, codes[starts[b] : starts[b + 1]].tolist(), most) is not None:
                    out.append((roots[a], roots[b]))
                    now[now == now[b]] = now[a]
        ra, rb = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(ra, pa.int64()), "b": pa.array(rb, pa.int64())})

    return dealt.join(texts, "rid").groupBy("bucket", "i", "j").applyInArrow(work, "a long, b long")


def in_several_classes(members: DataFrame) -> DataFrame:
    """The members (bucket, rid, root, words) of buckets that hold several classes, with n and words (sums of the bucket)."""
    sums = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("words").alias("_words"), F.min("root").alias("_least"), F.max("root").alias("_most")).where("_least < _most")
    return members.drop("words").join(sums.select("bucket", "n", F.col("_words").alias("words")), "bucket")


def forest_roots(parents: DataFrame, rows: int, most: int = 60) -> DataFrame:
    """The root of each node (node, parent) whose parent is less than itself, by pointer doubling. rows: how many there are."""
    now = parents.select("node", F.col("parent").alias("root"))
    for _ in range(most):
        up = now.select(F.col("node").alias("p"), F.col("root").alias("r"))
        moved = now.join(small(up, rows), F.col("root") == F.col("p"), "left").select("node", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved"))
        seen = Observation()
        now = spill(moved.coalesce(max(8, rows // ROWS_OF_A_FILE)).observe(seen, F.count_if("moved").alias("n")), "roots").drop("moved")
        if not seen.get["n"]:
            return now
    raise RuntimeError("the roots did not settle")


def components(edges: DataFrame, rows: int | None = None, most: int = 60) -> tuple[DataFrame, int]:
    """The least node (root) of each node's connected set, for the nodes (node) that are not their set's least; and how many those are.

    Each node of the edges (a, b) is hung under its least smaller neighbour; the
    trees shrink to their roots, the edges to those between roots, and so on
    until none is left. Every step at least halves what a set has of roots, and
    is made of joins and sums, so a node with very many edges is never one group.
    rows bounds the number of edges, where it is known.
    """
    tidy = lambda pairs, n: spill_counted(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", n)
    now, n = tidy(edges, rows)
    total, of_total = now.select(F.col("u").alias("node"), F.col("v").alias("root")), 0
    for _ in range(most):
        if not n:
            return total, of_total
        hung, k = spill_counted(now.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("parent")), "hung", n)
        trees = forest_roots(hung, k)
        total, of_total = (trees, k) if not of_total else (move_roots(total, trees, k), of_total + k)
        end = lambda c: small(trees.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")), k)  # noqa: B023, E731
        now, n = tidy(now.join(end("u"), "u", "left").join(end("v"), "v", "left").select(F.coalesce("_u", "u").alias("a"), F.coalesce("_v", "v").alias("b")), n)
    raise RuntimeError("the components did not settle")


def move_roots(roots: DataFrame, over: DataFrame, rows: int) -> DataFrame:
    """roots (node, root) after their roots got roots themselves (over, of so many rows)."""
    up = small(over.select(F.col("node").alias("_n"), F.col("root").alias("_r")), rows)
    return spill(roots.join(up, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")).union(over), "near-roots")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), th (hash of the text) and root (the class), one row per row of docs.

    Texts are in one class if their normal words (lower case, no marks) are equal
    or a chain of links joins them. Linked are texts that share a sketch entry and
    whose words align to `similarity` or more; all pairs with a five-word
    similarity of 0.8 share one (see SKETCHES). A text without words (null, empty,
    marks only) is like no other and is a class of its own; its class_id is its
    doc_id. Repeated rows and ids share a class if their texts do; a null doc_id
    takes part, and a class of such rows alone has a null class_id. An empty table
    gives an empty result. Texts of fewer than five words are one run.
    """
    with Run(docs.sparkSession) as run:
        named = _roots(docs, similarity)
        # Written first, so that a large class is not one task of the join.
        classes = spill(named.groupBy("root").agg(F.min("doc_id").alias("class_id")), "near-classes")
        run.keep(named, classes)
    return named.join(classes, "root").select("doc_id", "class_id", "th", "root")


def _roots(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, th (hash of the text) and root (row number of the class) of each row of docs."""
    with Run(docs.sparkSession) as run:
        docs = docs.select("doc_id", "text").withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
        rows = spill(sketches(docs), "near-rows")
        reps = spill(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("rid").alias("rep")), "near-copies")
        own = rows.where("key IS NOT NULL").join(reps, "key").where("rid = rep").select("rid", F.explode("entries").alias("bucket"))
        own = spill(own, "near-buckets")
        buckets = own.join(own.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rid").alias("least")).where("n > 1"), "bucket")
        every, n_met = spill_counted(buckets.select("bucket", "rid", "least"), "near-met")
        buckets = every
        of = lambda df: df.select(F.col("rid").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        marks = spill(rows.select("rid", "doc_id", "th", "words").join(buckets.select("rid").distinct(), "rid", "left_semi"), "near-marks")
        # One text for each (id, text): rows that are repeated count once here, by a partial aggregate before the exchange.
        once = docs.select(F.struct("doc_id").alias("_d"), "th", "text").groupBy("_d", "th").agg(F.first("text").alias("text"))
        texts = spill(marks.select("rid", F.struct("doc_id").alias("_d"), "th").join(once, ["_d", "th"]).select("rid", "text"), "near-texts")

        def checked(pairs: DataFrame, n: int) -> tuple[DataFrame, int]:
            """Those of n pairs that align."""
            left = texts.select(F.col("rid").alias("a"), F.col("text").alias("ta")).join(small(pairs, n), "a")
            right = texts.select(F.col("rid").alias("b"), F.col("text").alias("tb")).join(small(pairs.select("b").distinct(), n), "b", "left_semi")
            both = left.join(right, "b").coalesce(max(12, n // PAIRS_OF_A_TASK))
            return spill_counted(alike(both, similarity), "near-links")

        met = spill(of(buckets), "near-pairs")
        # First each text with the least it met: one parent at most, so the links are a forest.
        tried, n_tried = spill_counted(met.groupBy("a").agg(F.min("b").alias("b")), "near-tried")
        links, n_roots = checked(tried, n_tried)
        roots = forest_roots(links.select(F.col("a").alias("node"), F.col("b").alias("parent")), n_roots)
        root = lambda c: small(roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")), n_roots)
        for turn in count():
            if turn:
                # The rest of a bucket: those apart from its star, with the least of them.
                named = buckets.join(root("rid"), "rid", "left").join(root("least"), "least", "left")
                rest, n_rest = spill_counted(named.where("coalesce(_rid, rid) <> coalesce(_least, least)").select("bucket", "rid"), "near-rest", n_met)
                least = rest.groupBy("bucket").agg(F.min("rid").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
                buckets, n_met = spill_counted(rest.join(small(least, n_rest), "bucket"), "near-met", n_rest)
                met = of(buckets)
            # Then the pairs that this leaves apart.
            apart = met.join(root("a"), "a", "left").join(root("b"), "b", "left").select("a", "b", F.coalesce("_a", "a").alias("ra"), F.coalesce("_b", "b").alias("rb")).where("ra <> rb")
            todo, n_todo = spill_counted(apart.join(small(tried, n_tried), ["a", "b"], "left_anti"), "near-todo", n_met)
            n_found = 0
            if n_todo:
                tried, n_tried = tried.union(todo.select("a", "b")), n_tried + n_todo
                found, n_found = checked(todo.select("a", "b"), n_todo)
            if n_found:
                # Links between classes join their roots.
                across, n_across = components(todo.join(small(found, n_found), ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")), n_found)
                roots, n_roots = move_roots(roots, across, n_across), n_roots + n_across
            if n_found <= STAR_SHARE * n_todo:
                break
        # What the stars leave: all pairs of a bucket whose texts are still in several classes, those of the hubs' classes too.
        left = every.join(root("rid"), "rid", "left").select("bucket", "rid", F.coalesce("_rid", "rid").alias("root")).join(marks.select("rid", "words"), "rid")
        left, n_left = spill_counted(in_several_classes(left), "near-left")
        if n_left:
            side = lambda c: left.where(F.col("n") <= FEW).select("bucket", F.col("rid").alias(c), F.col("root").alias(f"r{c}"))
            pairs = side("a").join(side("b"), "bucket").where("a > b AND ra <> rb").select("a", "b", "ra", "rb").distinct()
            todo, n_todo = spill_counted(pairs.join(small(tried, n_tried), ["a", "b"], "left_anti"), "near-todo")
            found, n_found = checked(todo.select("a", "b"), n_todo) if n_todo else (todo.select("a", "b"), 0)
            links = todo.join(small(found, n_found), ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            large = left.where(F.col("n") > FEW)
            leaves = left.groupBy("rid").agg(F.collect_list("bucket").alias("leaves"))  # at most SKETCHES
            large = large.join(leaves, "rid")
            links, n_found = spill_counted(links.union(block_links(large, texts, similarity)), "near-links")
            if n_found:
                across, n_across = components(links, n_found)
                roots, n_roots = move_roots(roots, across, n_across), n_roots + n_across
        named = rows.select("doc_id", "th", "rid", "key").join(reps, "key", "left").join(small(roots.select(F.col("node").alias("rep"), "root"), n_roots), "rep", "left").select("doc_id", "th", F.coalesce("root", "rep", "rid").alias("root"))
        named = spill(named, "near-named")
        run.keep(named)
        return named


def keep_one(docs: DataFrame) -> DataFrame:
    """docs (with any columns) with one document of each class, that with the least doc_id (null last).

    Rows alike in doc_id and text are copies, too: one of them stays, whatever
    their other columns hold. Texts without words are alike to none and all stay.
    """
    id_, hash_, own_ = fresh(docs, "id", "hash", "own")
    with Run(docs.sparkSession) as run:
        found = _roots(docs.select("doc_id", "text"))
        last = F.coalesce("doc_id", F.lit((1 << 63) - 1))
        copies = found.groupBy("root", "doc_id", "th").agg(F.count("*").alias("n"))
        first = copies.groupBy("root").agg(F.min_by(F.struct("doc_id", "th", "n"), F.struct(last, "th")).alias("f"))
        first = spill(first.select(F.col("f.doc_id").alias(id_), F.col("f.th").alias(hash_), (F.col("f.n") > 1).alias("several")).distinct(), "near-first")
        run.keep(first)
    keyed = docs.withColumn(own_, F.xxhash64(F.coalesce("text", F.lit(""))))
    of = lambda which: keyed.join(first.where(which), keyed["doc_id"].eqNullSafe(F.col(id_)) & (F.col(own_) == F.col(hash_)), "left_semi")
    out = of("NOT several")
    if not first.where("several").isEmpty():
        out = out.unionByName(of("several").dropDuplicates(["doc_id", own_]))
    return out.drop(own_)


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


QUERIES = {"op3_order_minhash": op3_order_minhash}
