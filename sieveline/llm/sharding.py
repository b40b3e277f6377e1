"""Sharding by histogram sort: exact bytes below candidate boundaries, refined until splitters fit, then one exchange.

Rows are ordered by (hash of the text, doc_id, row number), so equal texts stand
together and a group of any size is cut where a boundary falls into it. Each
round counts, in every partition, the bytes and rows between candidates, and what
the least and greatest keys are there; the driver sees only those sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Run, batch, fresh, quoted, spill, table

SHARDS = 24
#: Candidates in each open interval and round; FEW of them while more than MANY splitters are open.
PROBES, FEW, MANY = 64, 8, 512
#: A splitter fits if it is off by at most this share of a shard, or no row lies nearer.
TOLERANCE = 1e-4
#: Cells of a shard aim at this many bytes; a cell is the unit of the exchange.
CELL_BYTES = 128 << 20

KEY = ("hash", "id", "tie")
_OFF = 1 << 63
LEAST, GREATEST = -1, (1 << 192) - 1


def number_of(key: tuple[int, int, int]) -> int:
    """A key of three 64-bit numbers as one number, in the same order."""
    return (key[0] + _OFF) << 128 | (key[1] + _OFF) << 64 | (key[2] + _OFF)


def parts_of(number: int) -> tuple[int, int, int]:
    return tuple((number >> shift & (1 << 64) - 1) - _OFF for shift in (128, 64, 0))


@dataclass
class Splitter:
    """Where a boundary must lie: after the keys <= low, not after those <= high."""

    target: float
    low: int
    high: int
    below: int  # bytes of keys <= low
    rows_below: int
    upto: int  # bytes of keys <= high
    rows_upto: int
    slack: float

    def done(self) -> bool:
        return min(self.target - self.below, self.upto - self.target) <= self.slack or self.high - self.low < 2

    def choice(self) -> tuple[int, int, int]:
        """The nearer end: (last key of the left side, its bytes, its rows)."""
        if self.target - self.below <= self.upto - self.target:
            return self.low, self.below, self.rows_below
        return self.high, self.upto, self.rows_upto


def candidates(low: int, high: int, n: int) -> list[int]:
    """At most n keys that lie evenly within an interval, both ends left out."""
    return sorted({low + (high - low) * k // (n + 1) for k in range(1, n + 1)} - {low, high})


def positions(columns: list[np.ndarray], probes: list[np.ndarray]) -> np.ndarray:
    """For each row the number of probes (in order) that are below its key. Keys and probes are lists of columns."""
    at = np.searchsorted(probes[0], columns[0], "left")
    if len(columns) == 1:
        return at
    end = np.searchsorted(probes[0], columns[0], "right")
    for first in np.unique(at[at < end]):
        own = np.flatnonzero((at == first) & (end > first))
        last = end[own[0]]
        at[own] = first + positions([c[own] for c in columns[1:]], [p[first:last] for p in probes[1:]])
    return at


def columns_of(probes: list[int]) -> list[np.ndarray]:
    return [np.array(x, np.int64) for x in zip(*map(parts_of, probes), strict=True)] or [np.zeros(0, np.int64)] * 3


def histogram(keys: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """Of the keys between neighbouring probes (above probe i - 1, up to probe i): exact bytes and rows, the least and the greatest key. Cells without rows are left out."""
    at_probes = columns_of(probes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(probes) + 1), np.int64)
        ends: dict[int, list[tuple]] = {}
        for part in batches:
            own = [np.asarray(part.column(c)) for c in KEY]
            if not len(own[0]):
                continue
            at = positions(own, at_probes)
            np.add.at(total[0], at, np.asarray(part.column("size")))
            total[1] += np.bincount(at, minlength=len(probes) + 1)
            order = np.lexsort((*own[::-1], at))
            edge = np.flatnonzero(np.diff(at[order])) + 1
            for a, b in zip([0, *edge], [*edge, len(order)], strict=True):
                low, high = (tuple(int(c[order[k]]) for c in own) for k in (a, b - 1))
                seen = ends.setdefault(int(at[order[a]]), [low, high])
                seen[:] = min(seen[0], low), max(seen[1], high)
        used = sorted(ends)
        cols = [pa.array([ends[i][k][j] for i in used], pa.int64()) for k in (0, 1) for j in range(3)]
        yield batch(i=pa.array(used, pa.int32()), size=pa.array(total[0][used]), n=pa.array(total[1][used]), **dict(zip(("l0", "l1", "l2", "h0", "h1", "h2"), cols, strict=True)))

    parts = keys.select(*KEY, "size").mapInArrow(count, "i int, size long, n long, l0 long, l1 long, l2 long, h0 long, h1 long, h2 long")
    sums = parts.groupBy("i").agg(F.sum("size"), F.sum("n"), F.min(F.struct("l0", "l1", "l2")), F.max(F.struct("h0", "h1", "h2")))
    return {i: (size, n, number_of(tuple(low)), number_of(tuple(high))) for i, size, n, low, high in sums.collect()}  # a row for each probe


def find_splitters(keys: DataFrame, cells: int, total: int, rows: int, slack: float, tight: int, loose: float) -> list[tuple[int, int, int]]:
    """Boundaries between cells; every tight-th one must meet slack, the others loose."""
    open_ = [Splitter(total * k / cells, LEAST, GREATEST, 0, 0, total, rows, slack if k % tight == 0 else loose) for k in range(1, cells)]
    while todo := [s for s in open_ if not s.done()]:
        shared = Counter((s.low, s.high) for s in todo)
        n = PROBES if len(todo) <= MANY else FEW
        # All ends are probes, too, so that no cell spans two intervals.
        probes = sorted({p for low, high in shared for p in (low, *candidates(low, high, max(n, min(PROBES, shared[low, high]))), high)} - {LEAST})
        found = histogram(keys, probes)
        ends = {p: i for i, p in enumerate(probes)} | {LEAST: -1}
        for low, high in shared:
            cells_of = [found[i] for i in range(ends[low] + 1, ends[high] + 1) if i in found]
            for s in (s for s in todo if (s.low, s.high) == (low, high)):
                below, rows_below, last = s.below, s.rows_below, s.low
                for size, count, least, greatest in cells_of:
                    if below + size >= s.target:
                        s.low, s.below, s.rows_below = max(last, least - 1), below, rows_below
                        s.high, s.upto, s.rows_upto = greatest, below + size, rows_below + count
                        break
                    below, rows_below, last = below + size, rows_below + count, greatest
                else:
                    s.low, s.below, s.rows_below = last, below, rows_below
                    s.high, s.upto, s.rows_upto = last, below, rows_below
    return [s.choice() for s in open_]


def shard_by_bytes(df: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id", tolerance: float = TOLERANCE, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Add shard (0 to shards - 1) and slot (gapless from 0 in each shard) to all rows.

    A row's size is the UTF-8 bytes of its text (null: none) plus 8. The shards'
    sizes differ by at most tolerance on either side plus one row. Rows are in
    order of (xxhash64 of the text, doc_id, row number), so equal texts are
    neighbours, and a group of them, rows alike in all columns too, is cut where a
    boundary falls into it. A null id sorts as the least one; every row has a slot
    of its own; an empty table gives an empty result. Columns of df named shard or
    slot are replaced.

    The rows are written once with their keys: row numbers must not change when a
    lost task is run again.
    """
    df = df.drop("shard", "slot")
    hash_, id_, tie_, size_, cell_ = fresh(df, *KEY, "size", "cell")
    keyed = df.withColumn(hash_, F.xxhash64(F.coalesce(F.col(text), F.lit("")))).withColumn(id_, F.coalesce(F.col(doc_id).cast("long"), F.lit(1 - _OFF))).withColumn(size_, F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8)
    with Run(df.sparkSession) as run:
        keyed = spill(keyed.withColumn(tie_, F.monotonically_increasing_id()), "shard-rows")
        run.keep(keyed)
    keys = keyed.select(F.col(hash_).alias("hash"), F.col(id_).alias("id"), F.col(tie_).alias("tie"), F.col(size_).alias("size"))
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    per = max(1, -(-total // (shards * cell_bytes)))
    cells = shards * per
    found = find_splitters(keys, cells, total, rows, tolerance * total / shards, per, 0.05 * total / cells)
    before = [0, *(n for _, _, n in found)]
    probes = columns_of([k for k, _, _ in found])
    first = [before[c - c % per] for c in range(cells)]  # rows before the shard of a cell
    names = df.columns
    kinds = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            at = positions([np.asarray(part.column(c)) for c in (hash_, id_, tie_)], probes)
            yield batch(**{c: part.column(c) for c in (*names, hash_, id_, tie_)}, **{cell_: pa.array(at, pa.int32())})

    dealt = keyed.drop(size_).mapInArrow(place, f"{kinds}, {quoted(hash_)} long, {quoted(id_)} long, {quoted(tie_)} long, {quoted(cell_)} int")
    # One exchange: a cell goes to the partition of its number, and is sorted there.
    own = dealt.repartitionById(cells, F.col(cell_)).sortWithinPartitions(cell_, hash_, id_, tie_)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[int, int] = {}
        for part in batches:
            cell = np.asarray(part.column(cell_), np.int64)
            slot = np.empty(len(cell), np.int64)
            for c in np.unique(cell).tolist():
                at = np.flatnonzero(cell == c)
                slot[at] = before[c] - first[c] + done.get(c, 0) + np.arange(len(at))
                done[c] = done.get(c, 0) + len(at)
            yield batch(**{c: part.column(c) for c in names}, shard=pa.array(cell // per, pa.int32()), slot=pa.array(slot))

    return own.mapInArrow(number, f"{kinds}, shard int, slot long")


def op5_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    out = shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.selectExpr("doc_id", "coalesce(octet_length(text), 0) + 8L AS size", "crc32(encode(coalesce(text, ''), 'UTF-8')) AS text_crc32", "'bytes' AS law", "shard", "slot", "CAST(NULL AS INT) AS grown_shard")


QUERIES = {"op5_histogram_sharding": op5_histogram_sharding}
