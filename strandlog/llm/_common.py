"""Shared pieces: tables, the shared folder, staging, and filters of a fixed size."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator between words in these operators.
WORD = r"[^\x20\x09-\x0D]+"

_OWN: dict[str, str] = {}
_STAGED: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a folder of this machine serves a local master; any other master needs the setting.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir is not set, and the executors of {master} see no folder of this machine")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="strandlog-shared-")
    return _OWN[app]


def fresh_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


#: Settings of jobs whose result is stored or collected: shuffle files go when the job has ended, not when the driver
#: happens to collect its garbage, and Arrow batches are small, as texts may be long.
_TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Within it, jobs run with the settings above."""
    before = {k: spark.conf.get(k, None) for k in _TIDY}
    for k, v in _TIDY.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet to the shared folder and reads it back.

    A lost executor costs a re-read, not a re-computation, and row order or ids
    made by a non-deterministic expression stay as written.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unstage(df: DataFrame) -> None:
    """Deletes what stage() wrote for df, which no later job may read."""
    item = (df.sparkSession, df._staged)
    _delete(*item)
    _STAGED.remove(item)


def drop_staged() -> None:
    """Deletes what stage() and fresh_dir() made; runs at exit too."""
    while _STAGED:
        try:
            _delete(*_STAGED.pop())
        except Exception:  # the session has ended; the cluster's own clean-up takes the folder
            return


atexit.register(drop_staged)


def only_likely(df: DataFrame, keys: DataFrame, key: str, bits: int = 23, of: str | None = None) -> DataFrame:
    """Rows of df whose key (column `of` of df, if it has another name there) is in `keys`, and a few others: a bitmap of
    2**bits bits, so at most 2**(bits-6) broadcast rows however many keys there are. An exact join has to follow."""
    h = F.xxhash64(F.col(key)).bitwiseAND(F.lit((1 << bits) - 1))
    words = (
        keys.select(h.alias("h"))
        .groupBy(F.shiftright("h", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("_bits"))
    )
    return (
        df.withColumn("_h", F.xxhash64(F.col(of or key)).bitwiseAND(F.lit((1 << bits) - 1)))
        .join(F.broadcast(words), F.shiftright("_h", 6) == F.col("_word"))
        .where(F.expr("(shiftrightunsigned(_bits, cast(_h & 63 as int)) & 1L) = 1L"))
        .drop("_h", "_word", "_bits")
    )


#: Rows of a batch that a function of mapInArrow gets at once.
ROWS = 2048


def _give_back() -> None:
    """Returns freed memory of a Python worker to the system: workers outlive their tasks, and so would their peaks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(run):
    """run, a function of mapInArrow, on batches of at most ROWS rows; at its end, what it held is given back."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(b.slice(at, ROWS) for b in batches for at in range(0, max(1, b.num_rows), ROWS))
        finally:
            _give_back()

    return wrapped


#: Counts that one row of packed_counts() has.
SLICE = 1 << 14


def packed_counts(counts: np.ndarray):
    """Record batches (part int, counts binary) of a task's counts, for add_counts().

    Counts are stored as byte planes, the low one first: those of small counts are zeros, and Spark compresses what it shuffles.
    """
    whole = np.zeros(-(-len(counts) // SLICE) * SLICE, "<u8")
    whole[: len(counts)] = counts
    planes = [np.ascontiguousarray(p.view(np.uint8).reshape(-1, 8).T).tobytes() for p in whole.reshape(-1, SLICE)]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(planes), dtype=np.int32)), pa.array(planes, pa.binary())], names=["part", "counts"])


def add_counts(packed: DataFrame, n: int) -> np.ndarray:
    """The n sums of packed_counts() of all tasks: added up slice by slice in the executors, so n numbers come to the driver."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, planes in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = np.ascontiguousarray(np.frombuffer(planes.as_buffer(), np.uint8).reshape(8, -1).T).view("<u8").ravel()
                sums[part] = sums[part] + got if part in sums else got
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["part", "counts"])

    out = np.zeros(-(-n // SLICE) * SLICE, np.int64)
    with tidy(packed.sparkSession):
        for part, sums in packed.repartition("part").mapInArrow(released(add), "part int, counts binary").collect():
            out[part * SLICE : (part + 1) * SLICE] = np.frombuffer(sums, "<i8")
    return out[:n]


def spare(taken) -> str:
    """A column name that is not among those taken."""
    name = "_text"
    while name in taken:
        name += "_"
    return name


def roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the edges i-j (vectorised label halving)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while not np.array_equal(label, up := label[label]):
            label = up
        far = label[i] != label[j]
        i, j = i[far], j[far]
    return label
