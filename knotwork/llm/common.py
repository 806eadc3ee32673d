"""What the operators share: reading tables, bounded Arrow batches, splitting of batches, stable hashes."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from ..plans.shipping import ship

#: Bytes of text that one Python step holds at once; a single longer text is a batch of its own.
BATCH_BYTES = 2 << 20
#: Rows that one Python step holds at once.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cleared() -> None:
    """Give memory that a worker has freed back to the system, so that what one stage needed doesn't add to the next one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(sizes: np.ndarray, most: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of ``rows`` at most whose sizes sum to ``most`` at most, or that hold one item."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > most or i - start >= rows):
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def cut(batches: Iterator[pa.RecordBatch], sized: str, most: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Parts of the batches by ``slices`` of the bytes of column ``sized``; nothing is copied, whatever the session's batches are."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(sized)), 0).to_numpy()
        for lo, hi in slices(sizes, most, rows):
            yield batch.slice(lo, hi - lo)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` with this package sent to the workers, which tidy up after the last batch."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        cleared()

    ship(df.sparkSession)
    return df.mapInArrow(whole, schema)


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType | str, sized: str, most: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> DataFrame:
    """``df`` through ``run``, which gets and gives frames; only parts of bounded size become Python objects (see ``cut``)."""
    kinds = to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = (part.to_pandas(integer_object_nulls=True) for part in cut(batches, sized, most, rows))
        for out in run(frames):
            yield pa.RecordBatch.from_pandas(out, schema=kinds, preserve_index=False)

    return map_batches(df, whole, schema)


def text_function(spark: SparkSession, step: Callable[[], Callable[[list[str | None]], list]], kind: str) -> Callable[[Column], Column]:
    """A column function of texts. ``step`` is called once a worker's task and gives the function of lists of texts."""
    to = to_arrow_type(T.DataType.fromDDL(kind))

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = step()
        for texts in arrays:
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
            done = [pa.array(own(texts.slice(lo, hi - lo).to_pylist()), to) for lo, hi in slices(sizes)]
            yield pa.concat_arrays(done) if done else pa.array([], to)
        cleared()

    ship(spark)
    return F.arrow_udf(run, kind).asNondeterministic()


def own_name(df: DataFrame, what: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    names = {c.lower() for c in df.columns}
    while (name := f"__{what}_{uuid.uuid4().hex[:8]}") in names:
        pass
    return name


def whole_id(df: DataFrame, id_col: str) -> Column:
    """An id column as a 64-bit integer; what can't be one is null."""
    return F.expr(f"try_cast(`{id_col}` AS BIGINT)") if df.schema[id_col].dataType.simpleString() == "string" else F.col(f"`{id_col}`").cast("long")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of an id written as text; null ids count as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def replace_columns(df: DataFrame, **made: Column) -> DataFrame:
    """``df`` with columns added; an input column of the same name, in any case, gives way."""
    names = {m.lower() for m in made}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in names], *[v.alias(k) for k, v in made.items()])


def with_fields(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of ``df`` with further fields, given by name and type."""
    out = T.StructType(list(df.schema.fields))
    for name, kind in kinds.items():
        out.add(name, kind)
    return out


#: Most rows of a broadcast set of buckets.
ID_BUCKETS = 1 << 19


def by_bucket(rows: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` split into those that may and those that can't have an id among ``ids`` (one column).

    Ids are hashed to ``ID_BUCKETS`` buckets, and the set of buckets in use is broadcast; so its size is bounded, and wide rows without
    a partner needn't be shuffled to find that out. With far more ids than buckets nearly all rows may have one.
    """
    name = own_name(rows, "bucket")
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BUCKETS))
    used = ids.select(bucket(F.col(ids.columns[0]).cast("long")).alias(name)).distinct()
    own = rows.withColumn(name, bucket(whole_id(rows, id_col)))
    return tuple(own.join(F.broadcast(used), name, how).drop(name) for how in ("left_semi", "left_anti"))
