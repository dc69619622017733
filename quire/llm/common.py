"""What the operators share: the shared folder, written tables, Arrow batches and words.

A word is a maximal run of characters other than space, tab, LF, VT, FF and CR.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that a task works on at once; its arrays are some twenty times as large.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one is set where that is unset and all tasks run in this process, as
    in tests. A cluster without it is an error: its machines would not see each other's files."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all machines of {master} share")
        where = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/quire-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a table written under folder: cuts the lineage and survives lost executors."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def shuffled(df: DataFrame) -> DataFrame:
    """df as the side of a join that is sorted and merged at every size; Spark would broadcast it where it happens to be
    small, and a plan that changes with the input says nothing about a larger one."""
    return df.hint("merge")


def looked_up(df: DataFrame) -> DataFrame:
    """df, narrow and with distinct keys, as the side of a join that is hashed partition by partition, so that the other
    side's rows, which hold whole texts, are moved once and never sorted."""
    return df.hint("shuffle_hash")


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def whole_id(name: str = "doc_id") -> Column:
    """A column of ids as long integers; null for what is no whole number."""
    return F.col(quoted(name)).try_cast("long")


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that no later step reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def filesystem(folder: str):
    """(pyarrow file system, path in it) of a folder, for workers that read or write files of their own format."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)


def give_back() -> None:
    """Return freed memory to the system: a worker lives long, and allocators keep what they once had."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def byte_slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows with at most `limit` bytes of text; a longer text is alone."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end
            give_back()


class Words(NamedTuple):
    """The words of a batch of texts, in order: their codes, the row of each, the distinct words, words per row."""

    code: np.ndarray
    row: np.ndarray
    vocabulary: list[bytes]
    count: np.ndarray


def filled(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts, "") if texts.null_count else texts


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """The words of each text; lower: with A-Z lower-cased. A null text has none."""
    texts = filled(texts)
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full).as_py() and len(flat):
        flat, row = flat.filter(full), row[full.to_numpy(zero_copy_only=False)]
    coded = flat.dictionary_encode()
    return Words(
        coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
        row.astype(np.int64),
        coded.dictionary.cast(pa.binary()).to_pylist(),
        np.bincount(row, minlength=len(texts)).astype(np.int64),
    )


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1, one run after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are over and written."""
    for _ in range(2):  # the second round takes what the first has let go
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
