"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A word: a run of characters other than space and the controls 09-0D. Java, RE2 and Python read it alike.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in an Arrow batch; with whole texts in the rows, the default of 10,000 takes too much memory.
ARROW_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: the one the session names in spark.checkpoint.dir.

    Where that is unset, a temporary one serves a local master, as in tests; on a cluster it is an error, as other
    machines couldn't read it.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """`df` as a written copy in the shared folder, so that a lost executor costs no recomputation of what led to it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Spark's setting by which a frame's shuffles are deleted when its action is over; it is read when the frame is made.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What frames made within this shuffle is deleted as soon as their own action is over, a checkpoint() above all.

    Otherwise it stays until the driver happens to collect its garbage, and a shuffle takes three files, and so three blocks of disk at least, for
    each task that writes: hundreds of shuffles of a few rows fill more than the table does. A frame that is run again shuffles again. The
    session's setting is what it was afterwards.
    """
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


#: A key with more than one row in HOT is hot: there are at most HOT of them, whatever the size of the table.
HOT = 1000


def join_counted(rows: DataFrame, lookup: DataFrame, on: Sequence[str], count: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """`rows` joined with a lookup of one row a key, without its column `count`, the number of `rows` of that key.

    Hot keys, of which there are at most HOT, are joined by a broadcast and the others by a shuffle, so that no task gets
    all rows of a hot key. Both tables are read more than once: they should be checkpoints, or cheap. Null keys find nothing.
    `total`, if known, is the number of rows, or a little more. The hot keys are looked up first: where there are none, as is
    usual, the plan is one join, and a single key of type long is told apart by a list in the plan, without another join.
    """
    if total is None:
        total = lookup.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT > total
    listed = len(on) == 1 and isinstance(rows.schema[on[0]].dataType, T.LongType)
    found = lookup.where(hot & F.col(on[0]).isNotNull()).select(*on)
    keys = [k[0] for k in (found if listed else found.select(F.lit(0)).limit(1)).collect()]
    if not keys:
        return rows.join(lookup.drop(count), [*on], how)
    few = F.broadcast(lookup.where(hot).drop(count))
    if listed:
        rest = rows.where(F.expr(f"NOT coalesce(`{on[0]}` IN ({', '.join(f'{k}L' for k in keys)}), false)"))
    else:
        rest = rows.join(F.broadcast(lookup.where(hot).select(*on)), [*on], "left_anti")
    return rows.join(few, [*on]).unionByName(rest.join(lookup.where(~hot).drop(count), [*on], how), allowMissingColumns=True)


def map_columns(
    df: DataFrame,
    make: Callable[[], Callable[..., Sequence[pa.Array]]],
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    drop: Sequence[str] = (),
) -> DataFrame:
    """`df` with columns computed in Arrow batches.

    make() runs once in each task and gives a function from the `inputs` columns of a batch to the
    arrays of `fields`. Columns of `df` that have the name of a new field are replaced, those in
    `drop` aren't sent back; all others pass through as they are. A batch holds at most ARROW_ROWS rows.
    """
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(limit)) <= ARROW_ROWS:
        df.sparkSession.conf.set(limit, str(ARROW_ROWS))
    new = [f.name for f in fields]
    keep = [f for f in df.schema.fields if f.name not in drop and f.name not in new]
    names = [f.name for f in keep]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    wanted = df.select(*dict.fromkeys([*names, *inputs]))

    def run(batches):
        function = fresh(make)
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            made = function(*(batch.column(at[c]) for c in inputs))
            made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in names), *made], names=[*names, *new])

    return wanted.mapInArrow(run, T.StructType([*keep, *fields]))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def string(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


_held: dict = {}
_used: list = []


def fresh(make: Callable[[], Callable]) -> Callable:
    """make(), after which this process holds only what make() asked for.

    Workers are used again for other operators. A task that holds nothing lets go of what earlier ones held, so that no
    operator's memory counts against the next.
    """
    _used.clear()
    out = make()
    if not _used:
        let_go()
    return out


def let_go() -> None:
    """Forgets what this process holds, and gives the memory back."""
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call, memory is kept for what comes next
        ctypes.CDLL(None).malloc_trim(0)


def held(name: object, make: Callable[[], object]) -> object:
    """What make() gave for this name in this process; all that other names hold is let go. A process holds one thing at a time."""
    _used.append(name)
    if name not in _held:
        if _held:
            let_go()
        _held[name] = make()
    return _held[name]


def letting_go(function: Callable) -> Callable:
    """A function of batches, after it has let go of what this process holds."""

    def run(batches):
        fresh(lambda: function)
        yield from function(batches)

    return run
