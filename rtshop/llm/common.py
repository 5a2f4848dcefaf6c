"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rtshop.session import shared_dir

# White space of the contracts: space and the five ASCII controls 09 to 0D.
WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
PART_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, nothing upstream runs twice.

    The files survive lost executors and belong to the caller's shared folder, which the cluster empties.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.staged_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing will read again."""
    for df in tables:
        jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of steps whose results are staged.

    The cleaner learns that a shuffle is no longer referenced when the driver collects its garbage.
    """
    for _ in range(2):  # what the first round frees may hold more; the cleaner works beside this thread
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def words(text: Column) -> Column:
    """Array of the maximal runs of non-white characters, empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{WHITE}+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    """Number of words without building them: what is left when each run shrinks to one letter."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), WHITE, ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row.

    The optimizer copies columns into the filters it moves down. A value that a lambda would then compute again for each
    element is bound to a name here, so that no plan can make the cost of a text grow with its square.
    """
    return F.get(F.transform(F.array(value), body), 0)


def add_columns(df: DataFrame, make: Callable[..., list], fields: list[T.StructField], reads: list[str],
                keep: list[str] | None = None) -> DataFrame:
    """``df``'s ``keep`` columns (all by default) and those that ``make`` computes from Arrow columns ``reads``.

    A kept column with the name of a computed one is replaced. ``make`` gets Arrow arrays and returns Arrow arrays.
    """
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    types = [to_arrow(f.dataType) for f in fields]
    names = kept + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # Parts of a few megabytes, so that what ``make`` builds for a part stays small beside the batch.
            rows = max(1, int(whole.num_rows * PART_BYTES / max(1, whole.nbytes)))
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                made = make(*(batch.column(c) for c in reads))
                made = [m if isinstance(m, pa.Array) else pa.array(m, type=t) for m, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, names=names)
        pa.default_memory_pool().release_unused()

    return df.select(*dict.fromkeys(kept + reads)).mapInArrow(run, schema)


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose sizes sum to about ``most``; a larger item stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
