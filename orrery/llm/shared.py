"""The folder that driver and executors share, and ways to cut lineage through it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is named: a new one in local mode, an error on a cluster."""
    context = spark.sparkContext
    if not (named := context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-orrery-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def parts(batches: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """Arrow batches in parts of a few rows: what a worker makes of long texts stays small. Ids stay whole numbers."""
    for batch in batches:
        if "doc_id" in batch:
            batch = batch.astype({"doc_id": "Int64"})
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def portions(batches: Iterator[pd.DataFrame], letters: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Arrow batches in portions whose texts have ``letters`` code points together, or of one longer text. Ids stay whole numbers."""
    for batch in batches:
        batch = batch.astype({"doc_id": "Int64"})
        upto = batch["text"].str.len().fillna(0).astype("int64").cumsum().to_numpy()
        at = 0
        while at < len(batch):
            until = max(at + 1, int(upto.searchsorted((upto[at - 1] if at else 0) + letters, "right")))
            yield batch.iloc[at:until]
            at = until


class Remembered(dict):
    """A worker's results by word, for words of up to ``longest`` letters; ``room`` bounds their number, so bytes are bounded.

    A longer word is worked out each time: texts without spaces would fill the memory.
    """

    def __init__(self, make: Callable[[str | bytes], object], room: int, longest: int = 64):
        super().__init__()
        self.make, self.room, self.longest = make, room, longest

    def __missing__(self, word: str | bytes) -> object:
        made = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.room:
                self.clear()
            self[word] = made
        return made


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of ``names`` that ``df`` does not have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder; a lost executor costs no recomputation of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet, and read back: smaller than a checkpoint."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/orrery-{what}-{uuid.uuid4().hex}"


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and path object for ``path``, whatever store holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a file to a name that must be free; False if it is taken. HDFS does this atomically."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    fs, where = filesystem(spark, target)
    files = hadoop.FileContext.getFileContext(fs.getUri(), context._jsc.hadoopConfiguration())
    try:
        files.rename(hadoop.Path(source), where, context._gateway.new_array(hadoop.Options.Rename, 0))
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def discard(spark: SparkSession, path: str) -> None:
    fs, where = filesystem(spark, path)
    fs.delete(where, True)
