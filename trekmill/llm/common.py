"""What the operators share: where shared files go, lineage cuts, and the ASCII word rule."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts in an Arrow batch at most.
BATCH_ROWS = 2000

#: bytes.translate table that lower-cases A-Z and leaves UTF-8 sequences alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, under a local master only, a new one."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(at)
        return at
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(Path(tempfile.mkdtemp(prefix="trekmill-")).as_uri())
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go when the action that wrote them ends, not when the driver next collects garbage.

    For steps whose results are all cut or written, so that nothing reads those files again. The session's own setting comes back.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small_batches(df: DataFrame, rows: int = BATCH_ROWS) -> None:
    """Lets Spark hand Python at most so many texts at once in this session; a smaller setting of the user's stays.

    Spark's own 10,000 take some hundred megabytes a worker on both sides, as texts of some kilobytes.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))


def lower_ascii(text: Column) -> Column:
    """text with A-Z in lower case and all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_words(text: Column) -> Column:
    """Number of words of text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """Words of text in lower case (A-Z only), as UTF-8. bytes.split() breaks at the six white-space bytes."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def splittable(df: DataFrame) -> DataFrame:
    """df dealt anew, so that a join with it shuffles both sides and adaptive execution may split a hot key.

    The result of a grouping is already dealt by its keys; joined as it is, a hot key of the other side stays in one task.
    """
    return df.hint("rebalance")
