"""What the operators share: reading tables, the shared folder, tokens and hashes."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Rows in an Arrow batch; documents may be very long, so the default of 10,000 rows is too much.
BATCH_ROWS = 1000
#: and bytes; a batch ends with the row that reaches them.
BATCH_BYTES = "2m"
#: Rows that a scan holds in the JVM at once, texts as one array that grows by doubling; Spark's 4096 may be very long.
SCAN_ROWS = 512
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Bounds what is between the JVM and a Python worker, and what a scan holds, whatever the texts' length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow after which the worker's free memory goes back to the system; workers live on between tasks, and
    would keep the most they ever held."""

    @functools.wraps(run)
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return f


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Only the named columns of a table, so that the scan reads no others."""
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a cluster it must be configured."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.sql.linework.localShared", made := spark.conf.get("spark.sql.linework.localShared", None) or tempfile.mkdtemp(prefix="linework-"))
    return made


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write the frame as a table in the shared folder and read it back: its lineage ends
    there, and a lost executor costs no more than the tasks it was running."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/linework/{label}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")  # shuffle files go when the table is written, not when the driver collects its garbage
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._linework_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables made by cut() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_linework_path", None)  # frames derived from one have none and stay
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict | None]]) -> DataFrame:
    """mapInArrow with state for each task: make() runs once in a task, what it returns runs
    on each batch and gives columns by name (None: no rows)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows and (columns := step(batch)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(tidy(run), schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """Texts one at a time; null is empty."""
    for x in batch.column(name):
        yield x.as_py() or ""


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The UTF-8 of each text without a Python string between; null is empty."""
    for x in batch.column(name):
        b = x.as_buffer()
        yield b"" if b is None else b.to_pybytes()


def words(raw: bytes) -> list[bytes]:
    """A-Z in lower case, then runs of anything but space and \\x09-\\x0D."""
    return raw.translate(LOWER).split()


def hash_words(found: list[bytes]) -> np.ndarray:
    """A 64-bit SipHash of each word, alike in every process."""
    from pandas.util import hash_array  # here, as most operators' workers do without pandas

    a = np.empty(len(found), dtype=object)
    a[:] = found
    return hash_array(a, categorize=False)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(raw: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text: runs of ``width`` words,
    with fewer words the whole sequence as one, without words none."""
    found = words(raw)
    if not found:
        return np.empty(0, U)
    h = hash_words(found)
    n = max(1, len(h) - width + 1)
    out = np.full(n, U(min(len(h), width)))
    for k in range(min(len(h), width)):
        out = mix64(out * U(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def hex_sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def keep_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows, with all their columns, for which the function that make() returns says true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(step(batch), pa.bool_()))

    return df.mapInArrow(tidy(run), df.schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """doc_id, text, y, draw of at most ``rows`` labelled documents whose crc32(doc_id as text) mod
    ``folds`` is not ``held_out``, the least by a hash of their id, so a larger corpus gives a
    sample of the same size. The chosen ids are bounded by ``rows`` and may be broadcast; texts are
    not shuffled. The sample is a table in the shared folder; draw is a hash to divide it by."""
    from pyspark.sql import functions as F

    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    usable = usable.where(F.crc32(F.col("doc_id").cast("string")) % folds != held_out)
    chosen = usable.withColumn("draw", F.xxhash64("doc_id")).orderBy("draw", "doc_id", "y").limit(rows)
    return cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "sample")


def fold_of(doc_ids: list, folds: int, held_out: int) -> list[bool]:
    """Whether crc32(doc_id as text) mod ``folds`` is ``held_out``; false without an id."""
    import zlib

    return [i is not None and zlib.crc32(str(i).encode()) % folds == held_out for i in doc_ids]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 60) -> np.ndarray:
    """Weights, the constant's last, of a ridge-penalised logistic regression by Newton steps."""
    z = np.c_[x, np.ones(len(x))]
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
