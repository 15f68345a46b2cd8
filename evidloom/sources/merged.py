"""A table that is merged into by key: numbered versions, writers that don't lose each other's rows, batches that count once.

A version is one small file ``log/<number>.json``, which names the folder of each bucket of keys. A merge reads and
rewrites only the buckets it has rows for, in a folder of its own, and then claims the next number by making its file,
which only one writer can. A writer that comes too late merges its rows anew into what the other wrote.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets that keys are dealt into when a table is begun, and versions that stay when older ones are cleaned up.
BUCKETS, KEPT = 16, 3
#: How often a writer starts anew before it gives up.
ATTEMPTS = 50


class Log:
    """The files that number a table's versions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.jvm = spark, path, spark._jvm
        self.fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/log")
        if not self.fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        stream = self.fs.open(self._path(self._file(number)))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict | None]:
        """The last version, (0, None) before the first."""
        found = self.numbers()
        return (found[-1], self.read(found[-1])) if found else (0, None)

    def claim(self, number: int, entry: dict) -> bool:
        """Make a version's file, whole and at once; false if another writer has made it."""
        draft = self._path(f"{self.path}/log/.{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        target = self._path(self._file(number))
        try:
            if self.fs.getScheme() == "file":  # where a rename would replace a file; a link never does
                local = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(local(target), local(draft))
                return True
            return bool(self.fs.rename(draft, target))
        except Exception as e:  # the JVM's exception says which
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self.fs.delete(draft, False)

    def drop(self, name: str) -> None:
        self.fs.delete(self._path(f"{self.path}/{name}"), True)

    def _file(self, number: int) -> str:
        return f"{self.path}/log/{number:012d}.json"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _rows(log: Log, entry: dict, buckets: list[str] | None = None) -> DataFrame:
    """The rows of a version, or of some of its buckets."""
    schema = StructType.fromJson(entry["schema"])
    found = [f"{log.path}/{folder}/bucket={b}" for b, folder in entry["buckets"].items() if buckets is None or b in buckets]
    return log.spark.read.schema(schema).parquet(*found) if found else log.spark.createDataFrame([], schema)


def current(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table as of its last version, or of an older one that still is there."""
    log = Log(spark, path)
    entry = log.read(number) if number else log.latest()[1]
    if entry is None:
        raise ValueError(f"no version under {path}")
    return _rows(log, entry)


def upsert(rows: DataFrame, path: str, key: str, order: list[str], source: str | None = None, batch: int | None = None, buckets: int = BUCKETS) -> int:
    """Merge ``rows`` by ``key`` and return the number of the version that has them.

    Of rows that share a key the last by ``order`` counts; it replaces the table's row, all other rows stay. A null key
    is a key. With ``source`` and ``batch``, a batch of a source that isn't newer than its last one changes nothing, so a
    stream may send a batch again. The columns are those of the first version. Writers may run side by side.
    """
    spark = rows.sparkSession
    log = Log(spark, path)
    first = lambda c: F.struct(*(F.col(o) for o in order), *(F.col(x) for x in c if x not in order))
    for _ in range(ATTEMPTS):
        number, entry = log.latest()
        done = (entry or {}).get("batches", {})
        if source is not None and batch is not None and done.get(source, -1) >= batch:
            return number
        many = entry["count"] if entry else buckets
        schema = StructType.fromJson(entry["schema"]) if entry else rows.schema
        own = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
        last = own.groupBy(key).agg(F.max_by(F.struct(*own.columns), first(c for c in own.columns if c != key)).alias("row")).select("row.*")
        touched = [str(r.b) for r in last.select(_bucket(key, many).alias("b")).distinct().collect()]
        stay = _rows(log, entry, touched).join(last.select(F.col(key).alias("_new")), F.col(key).eqNullSafe(F.col("_new")), "left_anti") if entry else None
        merged = last if stay is None else stay.unionByName(last)
        folder = f"v-{uuid.uuid4().hex}"
        merged.withColumn("bucket", _bucket(key, many)).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
        told = {**done, source: batch} if source is not None and batch is not None else done
        new = {"schema": schema.jsonValue(), "count": many, "batches": told, "buckets": {**((entry or {}).get("buckets", {})), **{b: folder for b in touched}}}
        if log.claim(number + 1, new):
            return number + 1
        log.drop(folder)
    raise RuntimeError(f"{ATTEMPTS} other writers came first under {path}")


def upsert_each(path: str, key: str, order: list[str], source: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: merges each batch of a stream, once however often it comes."""
    return lambda rows, batch: upsert(rows, path, key, order, source, batch) and None


def cleaned(spark: SparkSession, path: str, keep: int = KEPT) -> int:
    """Delete versions but the last ``keep`` with the folders that only they name; returns how many folders went.

    A folder that no version names is of a writer at work, or of a lost one, and is let be. A reader that holds an
    older version than those kept may find its files gone.
    """
    log = Log(spark, path)
    numbers = log.numbers()
    old, stay = numbers[:-keep], numbers[-keep:]
    if not old:
        return 0
    needed = {f for n in stay for f in log.read(n)["buckets"].values()}
    gone = {f for n in old for f in log.read(n)["buckets"].values()} - needed
    for n in old:
        log.drop(f"log/{n:012d}.json")
    for f in gone:
        log.drop(f)
    return len(gone)
