"""What the operators of this package share: inputs, written intermediate tables and Arrow maps."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of strings of one slice of an Arrow batch, so that long texts fit a small Python worker too.
BATCH_ROWS, BATCH_BYTES = 256, 2 << 20
#: What separates words wherever a contract speaks of words.
WORD = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}
#: Lists of (session, path, schema) that tables which are written() from now on are noted in; see scratch().
_noted: list[list[tuple]] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs in one process (as in tests) a temporary folder is made.
    """
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if set_:
        return set_.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="memgrid-")
        atexit.register(shutil.rmtree, _own[context.applicationId], ignore_errors=True)
    return _own[context.applicationId]


def _table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/memgrid-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    return _table(df, name)[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """As stored(), for what an operator needs on the way: inside scratch() it is emptied at the end."""
    out, path = _table(df, name)
    for notes in _noted:
        notes.append((df.sparkSession, path, df.schema))
    return out


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Empties what was written inside, when the block ends: only for results that are stored by then.

    A table is overwritten by one without rows, through Spark, so any shared store will do.
    """
    notes: list[tuple] = []
    _noted.append(notes)
    try:
        yield
    finally:
        _noted.remove(notes)

        def empty(note: tuple) -> None:
            spark, path, schema = note
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)

        with ThreadPoolExecutor(8) as pool:  # small jobs, side by side
            list(pool.map(empty, notes))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, each with as many underscores more as df's own columns call for."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batch: pa.RecordBatch, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """A batch in parts of no more than `rows` rows (BATCH_ROWS) and about BATCH_BYTES bytes of strings; a longer string is a part of its own."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, min(at + (rows or BATCH_ROWS), int(np.searchsorted(ends, before + BATCH_BYTES, "right"))))
        yield batch.slice(at, end - at)
        at = end


def give_back() -> None:
    """Returns memory that a finished task has freed to the system; a worker waits for the next stage, maybe of another kind, with what it holds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with a function that is made once for each task, on slices of the batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            yield from map(f, slices(batch))
        give_back()

    return df.mapInArrow(run, schema)


def arrow_filter(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows of df, with all their columns, for which a function that is made once for each task says so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(keep(part), pa.bool_()))
        give_back()

    return df.mapInArrow(run, df.schema)


def arrow_replace(df: DataFrame, column: str, make: Callable[[], Callable[[str | None], str | None]]) -> DataFrame:
    """df with a text column put through a function that is made once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch):
                i = part.schema.get_field_index(column)
                yield part.set_column(i, part.schema.field(i), pa.array(map(f, part.column(i).to_pylist()), part.schema.field(i).type))
        give_back()

    return df.mapInArrow(run, df.schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; null counts as the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def share(total: int, bound: int, *key: Column) -> Column:
    """True for a share of rows of which about `bound` of `total` are left, chosen by a hash of `key`."""
    if total <= bound:
        return F.lit(True)
    return F.pmod(F.xxhash64(*key, F.lit(20240131)), F.lit(1 << 30)) < int(bound / total * (1 << 30))
