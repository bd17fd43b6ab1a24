"""What the operators share: shipping code, scratch tables, skew-proof joins, Arrow columns."""

from __future__ import annotations

import ctypes
import tempfile
import weakref
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellarate.session import scratch_path

#: A key is dealt to several tasks when it has more than this share of the rows,
#: so at most ``1 / HOT_SHARE`` keys are hot and their list may be broadcast.
HOT_SHARE = 1 / 2000
#: Bytes of a batch that goes to a Python worker, unless the session says otherwise.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of a hot key that one task should get.
ROWS_PER_PART = 200_000

Batches = Iterator[pa.RecordBatch]

_shipped: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of all executors, once a session."""
    context = spark.sparkContext
    if _shipped.get(context):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="stellarate-code-")) / f"{package.name}_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped[context] = True


#: What a worker process keeps from task to task.
caches: dict[object, object] = {}


def give_back() -> None:
    """Return what earlier tasks of this process freed to the system, where that is possible."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Task:
    """A function over batches; unless it uses the kept caches, they are dropped first."""

    def __init__(self, function: Callable[[Batches], Batches], keeps_caches: bool) -> None:
        self.function, self.keeps_caches = function, keeps_caches

    def __call__(self, batches: Batches) -> Batches:
        if not self.keeps_caches:
            caches.clear()
        give_back()
        return self.function(batches)


def map_arrow(
    df: DataFrame,
    function: Callable[[Batches], Batches],
    schema: str,
    keeps_caches: bool = False,
) -> DataFrame:
    ship(df.sparkSession)
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(Task(function, keeps_caches), schema)


class Scratch:
    """Tables of one run, written under the shared folder; those not kept go when it ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.passing: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        jvm = self.spark.sparkContext._jvm
        for path in self.passing:
            target = jvm.org.apache.hadoop.fs.Path(path)
            files = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            files.delete(target, True)

    def table(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        """``df`` written as Parquet and read back: cuts the lineage, survives lost executors."""
        path = scratch_path(self.spark, name)
        if not keep:
            self.passing.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def hot_keys(counts: DataFrame, key: str, total: int) -> DataFrame:
    """(key, parts) of the keys with over ``HOT_SHARE`` of all ``total`` rows; ``counts`` is (key, n)."""
    return counts.where(F.col("n") > int(max(total * HOT_SHARE, ROWS_PER_PART))).select(
        key, F.ceil(F.col("n") / F.lit(ROWS_PER_PART)).cast("int").alias("parts")
    )


def join_unique(
    many: DataFrame,
    one: DataFrame,
    key: str,
    counts: DataFrame,
    total: int,
    how: str = "inner",
) -> DataFrame:
    """``many`` joined to ``one`` (unique by ``key``) without a hot key meeting in one task.

    ``counts`` is (key, n) of ``many`` and ``total`` its number of rows. Rows of a hot key are dealt to parts in
    proportion to its count, and its row of ``one`` is repeated for each part.
    """
    hot = F.broadcast(hot_keys(counts, key, total))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in many.columns]), F.col("parts"))
    left = many.join(hot, key, "left").withColumn(
        "_part", F.coalesce(spread.cast("int"), F.lit(0))
    )
    right = one.join(hot, key, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    )
    return left.drop("parts").join(right.drop("parts"), [key, "_part"], how).drop("_part")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and where each begins and the last ends; null is empty."""
    texts = column.fill_null("").cast(pa.large_string())
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    whole = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return whole, offsets - offsets[0]


#: Bytes of text that a task works on together; a longer text is worked on alone.
TEXT_BYTES = 4 << 20


def sliced(batches: Batches, text: int, limit: int = TEXT_BYTES) -> Batches:
    """The rows of all batches in slices of at most ``limit`` bytes of the column ``text``."""
    for rows in batches:
        ends = np.cumsum(np.diff(text_buffer(rows.column(text))[1]))
        at = 0
        while at < rows.num_rows:
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield rows.slice(at, stop - at)
            at = stop


def segment_sums(mark: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``mark`` from each offset to the next."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(mark, offsets[full], dtype=np.int64)
    return out


def values(column: pa.Array, missing: int) -> np.ndarray:
    """A long column as numpy, with ``missing`` for null."""
    return column.fill_null(missing).to_numpy(zero_copy_only=False)


def batch(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, kind)
        for c, kind in zip(columns, schema.types, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def distinct(key: np.ndarray) -> np.ndarray:
    """The values of ``key``, which is sorted in place, without repeats."""
    key.sort()
    return key[np.append(True, key[1:] != key[:-1])] if len(key) else key


def pieces(columns: list[np.ndarray], rows: int) -> Iterator[list[np.ndarray]]:
    """Equally long columns cut to slices of at most ``rows`` rows."""
    for start in range(0, len(columns[0]), rows):
        yield [c[start : start + rows] for c in columns]
