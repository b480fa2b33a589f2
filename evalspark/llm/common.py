"""Small pieces that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.session import scratch_path

# A word: a run of anything but ASCII white space.  The class is given as
# code points so that Java, Python and SQL engines agree on it.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows that may be broadcast.
BROADCAST_ROWS = 100_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words as a long; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: Column) -> Column:
    """Array of words of a text; empty for a null text or one without words."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}|{SPACE}$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """An Arrow batch in parts, so that few of its texts are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def give_back() -> None:
    """Return memory that Python and Arrow hold unused to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def hold_freed() -> None:
    """Let this process keep the memory it frees until :func:`give_back`: a function that takes arrays of some MB
    over and over would else have the system map and clear their pages each time."""
    if set_option := getattr(ctypes.CDLL(None), "mallopt", None):
        set_option(-3, 32 << 20)              # M_MMAP_THRESHOLD: smaller arrays come from the heap
        set_option(-1, 64 << 20)              # M_TRIM_THRESHOLD: free bytes at its end that stay


def releasing(run: Callable) -> Callable:
    """A partition function that gives unused memory back when it begins and ends: Python workers live on between
    stages, and what they hold back adds to the memory of every later stage on their executor."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return wrapped


def settled(df: DataFrame) -> DataFrame:
    """The same rows, behind a generator: a later filter on a computed column is not pushed below it, where each
    step would compute that column anew."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def broadcast_few(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table of narrow rows, marked for a broadcast if it has at most ``rows`` of them: what is joined with it
    need not be shuffled then."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written to a fresh folder under the shared checkpoint folder and read back:
    computed once, its lineage cut, and safe when executors are lost."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
