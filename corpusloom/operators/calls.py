"""Calls to an outside service for each row, bounded over all tasks, and logged so that a repeated task asks only for the rest.

Rows are dealt into buckets by a hash of their content, and buckets to at most as many tasks as calls may run at once.
After each wave of calls, a task adds what came back to a journal in its bucket's folder of the log; once a second, and
at the bucket's end, it writes these rows as a Parquet file, by a rename, instead. An attempt reads that folder, journals
included, before it asks: rows that an earlier attempt or an earlier run had answered are taken from there. A lost
executor thus costs the wave that was in flight (where a store shows no file before it is closed, the waves of up to a
second as well). The log can be read while a run goes on, but for that second.
"""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources.joined import filesystem

#: Rows whose logged answers a task holds at once (expected).
BUCKET_ROWS = 4096
#: Seconds of answers that stand in a journal only; rows that a task makes Python objects of, and sends on, at once.
SETTLE_S, TAKEN = 1.0, 256


def _grouped(t: pa.Table | pa.RecordBatch) -> dict[str, list[tuple]]:
    own: dict[str, list[tuple]] = {}
    for row in t.to_pylist():
        own.setdefault(row.pop("call_key"), []).append(tuple(row.values()))
    return own


class _Bucket:
    """A bucket's folder of the log: the tuples known for each key, and the journal of those that no Parquet file holds."""

    def __init__(self, log: str, bucket: int, schema: pa.Schema):
        self.number, self.schema = bucket, pa.schema([("call_key", pa.string()), *schema])
        self.store, self.folder = filesystem(f"{log}/bucket={bucket}")
        self.journal = None
        while (found := self._read()) is None:
            pass
        self.known, self.open = found
        self.since = time.monotonic()

    def _read(self) -> tuple[dict[str, list[tuple]], dict[str, list[tuple]]] | None:
        """What earlier attempts had, and that part of it that only their journals hold; None if a file went meanwhile."""
        from pyarrow import fs, parquet

        settled: dict[str, list[tuple]] = {}
        journals: dict[str, list[tuple]] = {}
        for file in sorted(self.store.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)), key=lambda f: f.path):
            try:
                if file.base_name.endswith(".parquet") and not file.base_name.startswith("_"):
                    settled = _grouped(parquet.ParquetFile(self.store.open_input_file(file.path)).read()) | settled  # the first answer counts
                elif file.base_name.endswith(".journal"):
                    with self.store.open_input_stream(file.path) as f, contextlib.suppress(pa.ArrowInvalid, OSError, StopIteration):  # its end may be torn
                        waves = pa.ipc.open_stream(f)
                        while True:
                            journals = _grouped(waves.read_next_batch()) | journals
            except FileNotFoundError:
                return None
        return journals | settled, {k: x for k, x in journals.items() if k not in settled}

    def _columns(self, got: dict[str, list[tuple]]) -> list[pa.Array]:
        rows = [(k, *r) for k, x in got.items() for r in x]
        columns = list(zip(*rows)) or [()] * len(self.schema)
        return [pa.array(list(c), f.type) for c, f in zip(columns, self.schema)]

    def add(self, got: dict[str, list[tuple]]) -> None:
        """Keep a wave's answers: in the journal, or with all that is open as a Parquet file, if the last one is SETTLE_S old."""
        self.known |= got
        self.open |= got
        if time.monotonic() - self.since >= SETTLE_S:
            return self.settle()
        if self.journal is None:
            self.store.create_dir(self.folder, recursive=True)
            self.path = f"{self.folder}/_{uuid.uuid4().hex}.journal"
            self.sink = self.store.open_output_stream(self.path)
            self.journal = pa.ipc.new_stream(self.sink, self.schema)
        self.journal.write_batch(pa.RecordBatch.from_arrays(self._columns(got), schema=self.schema))
        self.sink.flush()

    def settle(self) -> None:
        from pyarrow import parquet

        if self.open:
            self.store.create_dir(self.folder, recursive=True)
            name = f"{uuid.uuid4().hex}.parquet"
            with self.store.open_output_stream(f"{self.folder}/_{name}") as out:
                parquet.write_table(pa.table(self._columns(self.open), schema=self.schema), out)
            self.store.move(f"{self.folder}/_{name}", f"{self.folder}/{name}")
            self.open = {}
        if self.journal is not None:
            self.journal.close()
            self.sink.close()
            self.store.delete_file(self.path)
            self.journal = None
        self.since = time.monotonic()


def called(rows: DataFrame, one: Callable[[dict], list[tuple]], schema: T.StructType | str, calls: int = 12, log: str | None = None, profile: ResourceProfile | None = None, n_rows: int | None = None) -> DataFrame:
    """The tuples that one(row as a dict) returns (at least one; it must not raise) for all rows, as rows of schema.

    calls: how many run at once over all tasks. log: a folder that all workers reach; with it, rows of equal content are
    asked at most once for each wave, and never again in a later one. Without it, a repeated task asks anew. n_rows: about
    how many rows there are, where that is known; with a log they are counted otherwise.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = rows.sparkSession
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)
    tasks = max(1, min(calls, spark.sparkContext.defaultParallelism))
    threads, buckets = max(1, calls // tasks), max(tasks, -(-(rows.count() if n_rows is None else n_rows) // BUCKET_ROWS)) if log else tasks

    def sent(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, out = None, {}, []
        with ThreadPoolExecutor(threads) as pool:
            each = map if threads == 1 else pool.map
            for b in (whole.slice(i, TAKEN) for whole in batches for i in range(0, whole.num_rows, TAKEN)):
                wanted = list(zip(b.column("bucket").to_pylist(), b.column("call_key").to_pylist(), b.column("row").to_pylist()))
                for start in range(0, len(wanted), threads):
                    wave = wanted[start : start + threads]
                    for bucket in dict.fromkeys(w[0] for w in wave):
                        own = [w for w in wave if w[0] == bucket]
                        if log and (at is None or bucket != at.number):
                            if at:
                                at.settle()
                            at = _Bucket(log, bucket, arrow)
                            known = at.known
                        new = [w for w in own if w[1] not in known]
                        got = dict(zip((w[1] for w in new), each(lambda w: one(w[2]), new)))
                        if log and new:
                            at.add(got)
                        out += [r for w in own for r in (got.get(w[1]) or known[w[1]])]
                    if len(out) >= TAKEN:
                        yield sent(out)
                        out = []
            if at:
                at.settle()
            if out:
                yield sent(out)

    key = F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256)
    named = rows.select(F.struct("*").alias("row"), key.alias("call_key"))
    dealt = named.withColumn("bucket", F.pmod(F.xxhash64("call_key"), F.lit(buckets)).cast("int"))
    return dealt.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket", "call_key").mapInArrow(run, schema, profile=profile)


def logged(spark: SparkSession, log: str, schema: T.StructType | str) -> DataFrame:
    """What a log holds so far: a partial result, while a run goes on or after it stopped."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(T.StructType([T.StructField("call_key", T.StringType()), *schema])).parquet(log).dropDuplicates(["call_key", *_scalars(schema)]).drop("call_key", "bucket")


def _scalars(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
