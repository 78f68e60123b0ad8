"""What the corpus operators share: tables, the shared folder, settled intermediate results and ASCII folding."""

from __future__ import annotations

import os
import string
import tempfile
import uuid
import zipfile
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A session on one machine without such a setting, as in tests, gets a folder of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: How tables are written where the shared folder is a mounted one: without Hadoop's file of checksums beside each file and, above all, without the helper process
#: that its local file system starts, twice a file, to set permissions. Other file systems take no notice.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def stored(df: DataFrame, name: str) -> DataFrame:
    """A compressed columnar table in the shared folder, written once and read again: later reads don't depend on any executor or on the plan above."""
    path = new_path(df.sparkSession, name)
    df.write.options(**PLAIN_FILES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """As stored(), for rows of few bytes."""
    return stored(df, "settled")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, so that it needn't be installed there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), "lodestone.zip")
    with zipfile.ZipFile(path, "w") as out:
        for d, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(d, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


#: Bytes of rows that go to a Python worker at once, so that its memory doesn't follow from the length of texts.
BATCH_BYTES = 8 << 20


def _tidied(f):
    """f over a task's batches; afterwards the worker, which waits for its next task, gives back memory that Arrow holds for reuse."""

    def run(batches):
        import pyarrow as pa

        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return run


def mapped(df: DataFrame, f, schema) -> DataFrame:
    """mapInArrow with this package at hand, over batches of at most about BATCH_BYTES."""
    spark = df.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(_tidied(f), schema)


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def fold_of(doc_id, modulus: int) -> int:
    """crc32 of the id as text, modulo the number of folds; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode()) % modulus


def fold_column(doc_id: Column, modulus: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus
