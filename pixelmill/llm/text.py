"""Byte-level text kernels shared by the corpus operators.

Every kernel works on a slice of an Arrow string column as one flat byte buffer plus offsets, so that
tokenising and hashing are a handful of numpy passes per megabyte instead of a Python step per word.
Nulls read as empty texts. Words never cross a row.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text handled at a time; bounds the temporaries (about 40 bytes per byte of text).
CHUNK = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK + (CHUNK >> 2))
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                x = np.full(size, np.uint64(base & _MASK))
                x[0] = 1
                setattr(cls, name, np.multiply.accumulate(x))
        return cls.up, cls.down


def byte_table(*, drop: list[tuple[int, int]]) -> np.ndarray:
    """256 booleans: True for word bytes, False for the inclusive ranges in drop."""
    table = np.ones(256, bool)
    for a, b in drop:
        table[a : b + 1] = False
    return table


#: Words are runs of anything but ASCII white space.
NON_SPACE = byte_table(drop=[(0x20, 0x20), (0x09, 0x0D)])
#: Words are runs of ASCII letters and digits and of non-ASCII bytes. A-Z count as letters: they are read as a-z.
ALNUM = byte_table(drop=[(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_LOWER64 = LOWER.astype(np.uint64) + np.uint64(1)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and len+1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) or column.null_count:
        column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of slices of whole rows with about size bytes each; a longer row is a slice."""
    data, at = flat(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        stop = min(stop, rows)
        yield row, data[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


def prefix_hash(data: np.ndarray, table: np.ndarray = _LOWER64) -> np.ndarray:
    """len+1 prefix sums of table[byte] * base^position, modulo 2^64."""
    up, _ = _Powers.to(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each [start, stop), the same wherever the same bytes stand."""
    _, down = _Powers.to(len(sums))
    return mix((sums[stop] - sums[start]) * down[start])


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of all words, and for each row the index of its first word (len+1)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = table[data]
    edge = at[(at > 0) & (at < len(data))]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edge] = inside[edge]
    ends[:-1] &= ~inside[1:]
    ends[edge - 1] = inside[edge - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, stop, np.searchsorted(start, at)


def word_hashes(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words() and the hash of each word with A-Z lower-cased."""
    start, stop, first = words(data, at, table)
    return start, stop, first, span_hash(prefix_hash(data), start, stop)


#: Bytes of a batch of rows on their way to Python and back, several copies of which are held at a time.
BATCH = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that memory doesn't follow the length of texts. Results don't depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(name)).rstrip("b")) > BATCH:
        spark.conf.set(name, str(BATCH))


def hand_back() -> None:
    """Give memory that this worker no longer uses back to the system: workers outlive their tasks, side by side with the JVM."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mapped(df: DataFrame, step: Callable[[pa.RecordBatch], list[pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """df with the columns that step makes from each Arrow batch; columns of these names in df are replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    df = df.select([df[f"`{c}`"] for c in df.columns if c.lower() not in new])
    schema = T.StructType([*df.schema.fields, *fields])
    added = list(to_arrow_schema(T.StructType(fields)))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = [a if a.type == f.type else a.cast(f.type) for a, f in zip(step(batch), added, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *(f.name for f in added)])
                del made
        hand_back()

    return df.mapInArrow(run, schema)


#: Keys with this share of all rows are hot: at most 1 / HOT_SHARE of them can be.
HOT_SHARE = 1e-4


def hot_join(left: DataFrame, right: DataFrame, on: list[str], n: str, rows: int, how: str = "inner", alike: bool = False) -> DataFrame:
    """left joined with right, which has one row per key and in n the number of left's rows with it.

    The hot keys' rows of right (1 / HOT_SHARE at most) go to left's rows by broadcast; the others meet by shuffle, where
    a key has few rows. how: inner or left. alike: shuffle these even where right is small, so that the plan is one at every size."""
    from pyspark.sql import functions as F

    least = max(2, HOT_SHARE * rows)
    extra = [c for c in right.columns if c not in on]
    hot = F.broadcast(right.filter(F.col(n) >= least).withColumnsRenamed({c: f"__hot_{c}" for c in extra}))
    marked = left.join(hot, on, "left")
    met = marked.filter(F.col(f"__hot_{n}").isNotNull()).withColumnsRenamed({f"__hot_{c}": c for c in extra})
    rest = marked.filter(F.col(f"__hot_{n}").isNull()).drop(*[f"__hot_{c}" for c in extra])
    cold = right.filter(F.col(n) < least)
    return met.unionByName(rest.join(cold.hint("merge") if alike else cold, on, how))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the one the cluster shares. Only a local session, which has one machine, gets a default."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and read again if an executor is lost."""
    path = f"{shared_dir(df.sparkSession)}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
