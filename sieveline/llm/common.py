"""Helpers that the operators share: scratch tables, Arrow batches, word caches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in groups of at most this many bytes (one text may be longer).
GROUP_BYTES = 4 << 20
#: Tables of a few numbers a row are broadcast up to this many counted rows (a few MB).
MOST_BROADCAST = 100_000
ROWS_OF_A_FILE = 25_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the session has none (tests, one machine) a local folder is made for the application.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _own_roots:
            _own_roots[app] = tempfile.mkdtemp(prefix="sieveline-")
            atexit.register(shutil.rmtree, _own_roots[app], True)
        root = _own_roots[app]
    return root.rstrip("/")


class Run:
    """Owns the scratch tables that are written while it is open; leaving it deletes those it was not told to keep.

    Runs nest. keep(df) hands the table behind df over to the run around this
    one, so an operator deletes its own intermediate tables and leaves only what
    its result reads. The outermost tables belong to the session's own run: they
    live until release(). To have a folder empty after a job, write the job's
    result inside `with Run(spark):`.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def __enter__(self) -> Run:
        self.before = _open.get()
        self.token = _open.set(self)
        return self

    def keep(self, *dfs: DataFrame) -> None:
        """Do not delete these tables (as spill() returned them) when this run ends; the run around it gets them."""
        for df in dfs:
            mine = [t for t in self.tables if t[1] is df]
            self.tables = [t for t in self.tables if t[1] is not df]
            (self.before or _session).tables.extend(mine)

    def close(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        while self.tables:
            path = jvm.org.apache.hadoop.fs.Path(self.tables.pop()[0])
            path.getFileSystem(conf).delete(path, True)

    def __exit__(self, *_) -> None:
        _open.reset(self.token)
        self.close()


_open: ContextVar[Run | None] = ContextVar("run", default=None)
_session = Run(None)


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write df to a scratch table in the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read of files, not of work.
    The table belongs to the open Run.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    (_open.get() or _session).tables.append((path, out))
    return out


def drop(df: DataFrame) -> None:
    """Delete the scratch table behind df (as spill() returned it), if it is one."""
    for run in {id(r): r for r in (_open.get(), _session) if r is not None}.values():
        mine = [t for t in run.tables if t[1] is df]
        run.tables = [t for t in run.tables if t[1] is not df]
        gone = Run(df.sparkSession)
        gone.tables = mine
        gone.close()


def spill_counted(df: DataFrame, name: str, most: int | None = None) -> tuple[DataFrame, int]:
    """spill() and the number of rows, from the same job. A table of at most `most` rows is written in few files."""
    seen = Observation()
    if most is not None:
        df = df.coalesce(max(8, most // ROWS_OF_A_FILE))
    out = spill(df.observe(seen, F.count("*").alias("n")), name)
    return out, seen.get["n"]


def small(df: DataFrame, rows: int) -> DataFrame:
    """df for a join: broadcast if its counted rows are few, else left to be shuffled."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def release(spark: SparkSession) -> None:
    """Delete what finished operators keep for results that are read outside any Run. Call it only when none is needed any more."""
    _session.spark = spark
    _session.close()


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8 bytes; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def groups(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts come to GROUP_BYTES or one text."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column).cast(pa.binary())), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, base + GROUP_BYTES, side="right")))
        yield batch.slice(at, end - at)
        at = end


def map_texts(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema, column: str = "text") -> DataFrame:
    """mapInArrow with one worker object per task, fed slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in groups(batch, column):
                yield from work(part)

    return df.mapInArrow(run, schema)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def word_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text, as codes into the distinct words.

    Returns where each text's words start (one more than texts), the code of
    every word in turn, and the words by code. A null text has none.
    """
    lists = pa.compute.ascii_split_whitespace(pa.compute.fill_null(column.cast(pa.large_string()), ""))
    starts, words = np.asarray(lists.offsets, dtype=np.int64), lists.values
    starts = starts - starts[0]
    words = lists.flatten().dictionary_encode()
    codes, found = np.asarray(words.indices, dtype=np.int64), words.dictionary
    empty = pa.compute.index(found, pa.scalar("", found.type)).as_py()  # white space at an end of a text gives one
    if empty >= 0:
        real = codes != empty
        starts = np.concatenate(([0], np.cumsum(real)))[starts]
        codes = codes[real]
    return starts, codes, found


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as SQL and schema strings take it."""
    return f"`{name.replace('`', '``')}`"
