"""Token counts in delta-maintained rollups.

A rollup holds additive totals by source, language and tokenizer version. It is
fed with batches of signed events: an insert adds a document and its tokens, a
delete takes both away, a revision adds the difference between the new and the
prior count. A batch is summed to one row a key and written to a folder of its own;
then an empty file named after the batch and that folder is created, which publishes
it. Such a file is there whole or not at all, on any file system. A driver that dies
before it leaves data that nobody reads, and the batch can be sent again. If a batch
was sent twice, by two drivers at once even, it has two such files, and the totals
read the one with the smaller name: a batch counts once, whoever wins.

compact() sums all published batches into a base with the ids of its batches, publishes
that in the same way and then deletes what the base holds; it can die at any step. One
process may compact at a time, while others commit.

Defined results. A null source, language or tokenizer is a key like any other. A
null count is 0. An event whose kind is null or unknown adds nothing. Keys with
no documents and no tokens left have no row. Repeated events of one batch each
count; an empty batch is published and adds nothing. A batch sent again is known by its
id alone. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe import loaded
from quire.llm.common import byte_slices, removed

KEYS = ("source", "lang", "tokenizer")


def deltas(events: DataFrame) -> DataFrame:
    """One row a key: what the events (source, lang, tokenizer, kind, tokens, prior) add to its totals."""
    tokens, prior = F.coalesce("tokens", F.lit(0)).cast("long"), F.coalesce("prior", F.lit(0)).cast("long")
    kind = F.col("kind")
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).otherwise(0).cast("long")
    added = F.when(kind == "insert", tokens).when(kind == "delete", -tokens).when(kind == "revise", tokens - prior).otherwise(0)
    return events.groupBy(*KEYS).agg(F.sum(docs).alias("n_docs"), F.sum(added).alias("n_tokens"))


_TOTALS = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


class Rollup:
    """Totals under a folder on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        self._fs = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, kind: str, pattern: str = "*@*") -> list[tuple[str, str]]:
        """(what, folder) of the published files of a kind, sorted."""
        found = self._fs.globStatus(self._path(f"{kind}/{pattern}"))
        return sorted(tuple(status.getPath().getName().split("@")) for status in found or ())

    def _publish(self, kind: str, what: str, folder: str) -> None:
        self._fs.create(self._path(f"{kind}/{what}@{folder}"), True).close()

    def _base(self) -> tuple[int, str | None]:
        """(number, folder) of the latest base."""
        found = self._names("bases")
        return (int(found[-1][0]), found[-1][1]) if found else (0, None)

    def _in_base(self, folder: str | None) -> DataFrame:
        return self.spark.read.schema("batch string").parquet(f"{self.folder}/data/{folder}/batches") if folder else self.spark.createDataFrame([], "batch string")

    def _batches(self, folder: str | None) -> dict[str, str]:
        """{batch: its data} of what is published and not in the base: as many as were committed since compact()."""
        found: dict[str, str] = {}
        for batch, data in self._names("committed"):
            found.setdefault(batch, data)
        if found and folder:
            names = self.spark.createDataFrame([(b,) for b in found], "batch string")
            for r in names.join(self._in_base(folder), "batch", "left_semi").collect():
                del found[r.batch]
        return found

    @staticmethod
    def _named(batch_id: str) -> str:
        """A batch id as a file's name: only letters, digits, - and % are left, so no pattern or separator is in it."""
        return quote(batch_id, safe="").replace("~", "%7E").replace(".", "%2E").replace("_", "%5F")

    def commit(self, batch_id: str, events: DataFrame) -> bool:
        """Add a batch; False if its id was committed before."""
        batch = self._named(batch_id)
        if self._names("committed", f"{batch}@*") or not self._in_base(self._base()[1]).where(F.col("batch") == batch).isEmpty():
            return False
        data = uuid.uuid4().hex
        deltas(events).write.parquet(f"{self.folder}/data/{data}")
        self._publish("committed", batch, data)
        return True

    def _summed(self, base: str | None, batches: dict[str, str]) -> DataFrame:
        paths = [f"{self.folder}/data/{x}" for x in batches.values()] + ([f"{self.folder}/data/{base}/totals"] if base else [])
        parts = self.spark.read.schema(_TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], _TOTALS)
        return parts.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all published batches."""
        base = self._base()[1]
        return self._summed(base, self._batches(base))

    def compact(self) -> None:
        """Sum what is published into a new base, and delete the files that it replaces."""
        number, base = self._base()
        batches, data = self._batches(base), uuid.uuid4().hex
        self._summed(base, batches).write.parquet(f"{self.folder}/data/{data}/totals")
        added = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        self._in_base(base).unionByName(added).write.parquet(f"{self.folder}/data/{data}/batches")
        self._publish("bases", f"{number + 1:012d}", data)
        for old, folder in self._names("bases")[:-1]:
            self._fs.delete(self._path(f"bases/{old}@{folder}"), False)
            removed(self.spark, f"{self.folder}/data/{folder}")
        for batch, folder in self._names("committed"):
            if batch in batches:
                self._fs.delete(self._path(f"committed/{batch}@{folder}"), False)
                removed(self.spark, f"{self.folder}/data/{folder}")


def count_tokens(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """(doc_id, source, lang, n_bytes, n_words, n_bpe) of every whole text; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for b in byte_slices(batches):
            texts = [x or "" for x in b.column("text").to_pylist()]
            raw = [x.encode() for x in texts]
            counts = [list(map(len, raw)), [len(x.split()) for x in raw], [len(x) for x in bpe.encode(texts)]]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "source", "lang")), *(pa.array(np.array(c, np.int64)) for c in counts)], names=["doc_id", "source", "lang", "n_bytes", "n_words", "n_bpe"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "source", "lang", "text").mapInArrow(run, f"doc_id {id_type}, source string, lang string, n_bytes bigint, n_words bigint, n_bpe bigint")


def events(counts: DataFrame, kind: str, tokenizer: str, tokens: Column, prior: Column | None = None) -> DataFrame:
    """The rows of counts as events of one kind."""
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(kind).alias("kind"), tokens.cast("long").alias("tokens"), (F.lit(0) if prior is None else prior).cast("long").alias("prior"))
