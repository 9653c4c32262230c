"""Iteration with bounded lineage: every round ends in a table that all executors can read."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Bytes that a writing task holds before it writes them out.
ROW_GROUP = 16 << 20
#: Rows that a side of a join may have to be broadcast.
MOST_BROADCAST = 100_000
#: Rows a partition up to which a shuffled side is held as a hash table.
MOST_HASHED = 1_000_000
#: Tables that stand, in the order they were written, and how to remove each.
_standing: list[tuple[str, Callable[[], None]]] = []


def shared_folder(df: DataFrame) -> str:
    """The folder of spark.checkpoint.dir. Only a local master may leave it unset: then a temporary folder does."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="evigraph-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table written to the shared folder: no lineage, and what is lost is read again.

    A checkpoint would keep the size that Spark expects of the plan it cuts. Over the rounds of a loop that number is
    multiplied by itself until planning takes longer than the work; a written table is as large as its files. ``tidied``
    removes tables that nothing reads any more, the end of the session the others.
    """
    return counted_cut(df)[0]


def counted_cut(df: DataFrame) -> tuple[DataFrame, int]:
    """The table of ``cut`` and its number of rows, counted as they are written."""
    path, _ = _place(df)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out, n = df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]
    return (shuffled(out) if n > MOST_BROADCAST else out), n


def shuffled(df: DataFrame) -> DataFrame:
    """The rows, never broadcast in a join: Spark judges by the size of compressed files, and a small file may fill the driver."""
    return df.hint("merge")


def beside(df: DataFrame, n: int) -> DataFrame:
    """A counted side of an inner join with a larger one: sent whole if it is small, else a hash table a partition, so that the larger
    side is not sorted; where that table would be too large, both sides are sorted."""
    if n <= MOST_BROADCAST:
        return F.broadcast(df)
    return df.hint("shuffle_hash") if n <= MOST_HASHED * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else shuffled(df)


def laid_out(df: DataFrame, column: str, distinct: bool = True) -> DataFrame:
    """The distinct rows as a written table in buckets of one column, sorted: joins on it, round after round, shuffle the other side only.

    Rows are dealt by that column before they are made distinct, so both take one shuffle. Where what follows takes equal rows as one
    anyway, ``distinct`` is not needed.
    """
    spark = df.sparkSession
    path, name = _place(df, catalogued=True)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(buckets, column)
    held = (dealt.distinct() if distinct else dealt).write.option("parquet.block.size", ROW_GROUP).option("path", path)
    held.format("parquet").bucketBy(buckets, column).sortBy(column).saveAsTable(name)
    return spark.table(name)


def _place(df: DataFrame, catalogued: bool = False) -> tuple[str, str]:
    """Path of a new table, and its name in the catalog; both go when the table does."""
    name = f"table-{uuid.uuid4().hex}"
    path, entry = f"{shared_folder(df)}/{name}", name.replace("-", "_")
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    jvm, settings = context._jvm, context._jsc.hadoopConfiguration()

    def remove() -> None:
        if catalogued and context._jsc is not None:
            spark.sql(f"DROP TABLE IF EXISTS {entry}")
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(settings).delete(where, True)

    if not _standing:
        atexit.register(remove_tables)
    _standing.append((name, remove))
    return path, entry


def remove_tables(first: int = 0, but: frozenset[str] = frozenset()) -> None:
    """Removes the standing tables from the given one on, but those named."""
    held = _standing[first:]
    del _standing[first:]
    for name, remove in held:
        if name in but:
            _standing.append((name, remove))
        else:
            remove()


def tidied(function: Callable) -> Callable:
    """The function, whose tables are gone when it returns but for those that its result, a DataFrame, reads."""

    @functools.wraps(function)
    def run(*args, **options):
        first, read = len(_standing), frozenset()
        try:
            out = function(*args, **options)
            if isinstance(out, DataFrame) and len(_standing) > first:
                read = frozenset(re.findall(r"table-[0-9a-f]{32}", "\n".join(out.inputFiles())))
            return out
        finally:
            remove_tables(first, read)

    return run


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def any_rows(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
