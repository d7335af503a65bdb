"""Tables that streams merge into, batch by batch: a batch that is run again changes nothing.

A table is a folder of versions, one for each batch. A version holds the buckets that its batch touched, whole, and, written last,
the list of them; a reader takes the newest version of each bucket. Batch n reads only versions before n and overwrites its
own, so whatever an earlier try of it left is of no account. Every so many batches all buckets are written, and the versions before go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.streaming.events import visitors_upsert


class StoredTable:
    """A table with one row for each key; its columns are given by a schema, `keys` name those of the key.

    What the driver holds of it are bucket numbers, at most `buckets` for each of the last `compact` batches."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 32, compact: int = 50):
        self.spark, self.path, self.schema, self.keys, self.buckets, self.compact = spark, path.rstrip("/"), schema, keys, buckets, compact

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The batches that have been written whole."""
        files = self._files()
        names = [x.getPath().getName() for x in files.listStatus(self._path())] if files.exists(self._path()) else []
        return sorted(int(n) for n in names if n.isdigit() and files.exists(self._path(n, "touched", "_SUCCESS")))

    def _newest(self, before: int | None = None) -> dict[int, tuple[int, int]]:
        """Of every bucket its newest version and how many rows it has there."""
        out: dict[int, tuple[int, int]] = {}
        for v in self.versions():
            if before is None or v < before:
                out |= {r["bucket"]: (v, r["n"]) for r in self.spark.read.schema("bucket int, n long").json(f"{self.path}/{v}/touched").collect()}
        return out

    def read(self, before: int | None = None, among: set[int] | None = None) -> DataFrame:
        """The rows as they are now, or were before a batch; `among`: of some buckets only."""
        paths = [f"{self.path}/{v}/rows/_bucket={b}" for b, (v, n) in sorted(self._newest(before).items()) if n and (among is None or b in among)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, batch: int, changes: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Writes version `batch`: fold(stored, changes) of the buckets that changes touch, every so often of all."""
        whole = batch % self.compact == self.compact - 1
        touched = set(range(self.buckets)) if whole else {r[0] for r in changes.select(self.bucket()).distinct().collect()}
        self._files().delete(self._path(str(batch)), True)
        rows = fold(self.read(batch, touched), changes).withColumn("_bucket", self.bucket())
        rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{batch}/rows")
        written = self.spark.read.schema(f"{self.schema}, _bucket int").parquet(f"{self.path}/{batch}/rows")
        counts = {r["_bucket"]: r["count"] for r in written.groupBy("_bucket").count().collect()}
        self.spark.createDataFrame([(b, counts.get(b, 0)) for b in sorted(touched)], "bucket int, n long").coalesce(1).write.json(f"{self.path}/{batch}/touched")
        if whole:
            for v in self.versions():
                if v < batch - 1:  # the one before may still be read
                    self._files().delete(self._path(str(v)), True)


def _run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Processes what a stream's source holds now, micro-batch by micro-batch."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


VISITORS = "ip_address string, visit_count long, first_visit timestamp, last_visit timestamp"


def visitors_stream(visits: DataFrame, path: str, checkpoint: str) -> StoredTable:
    """Merges a stream of visits(ip_address, created_at) into a stored table of visitors, as visitors_upsert() does.

    A visit without an address counts for the visitor without one."""
    table = StoredTable(visits.sparkSession, path, VISITORS, ["ip_address"])
    _run(visits.select("ip_address", "created_at"), checkpoint, lambda new, batch: table.merge(batch, new, lambda stored, more: visitors_upsert(more, stored)))
    return table


QUEUE = "content_type string, content_id long, status string, retry_count int, updated_at timestamp"


def queue_rows(stored: DataFrame, events: DataFrame, retries: int = 3) -> DataFrame:
    """Stored queue rows with events(content_type, content_id, ts, event_id, kind) folded on, in the order of time.

    enqueue and retry make a row pending with no retries, success takes it out, failure counts one more and fails it at
    `retries`. A failure of a row that is not there counts as its first."""
    key = ["content_type", "content_id"]
    w = [F.col("content_type").alias("_t"), F.col("content_id").alias("_i")]
    last = F.struct("ts", "event_id")
    resets = events.where(F.col("kind").isin("enqueue", "retry", "success")).groupBy(*key).agg(F.max(last).alias("_reset"), F.max_by("kind", last).alias("_kind")).select(*w, "_reset", "_kind")
    same = F.col("content_type").eqNullSafe(F.col("_t")) & F.col("content_id").eqNullSafe(F.col("_i"))
    rows = events.join(resets, same, "left")
    fails = F.count(F.when((F.col("kind") == "failure") & (F.col("_reset").isNull() | (last > F.col("_reset"))), 1))
    new = rows.groupBy(*key).agg(F.max("_kind").alias("_kind"), fails.alias("_fails"), F.max("ts").alias("_at"))
    old = stored.select(F.col("content_type").alias("_t"), F.col("content_id").alias("_i"), "status", "retry_count", "updated_at")
    both = new.join(old, same, "full")
    count = F.least(F.when(F.col("_at").isNull(), F.col("retry_count")).otherwise(F.col("_fails") + F.when(F.col("_kind").isNull(), F.coalesce("retry_count", F.lit(0))).otherwise(0)), F.lit(retries)).cast("int")
    # a stored row's open claim ends with its failure; without news everything stays
    status = F.when(F.col("_at").isNull(), F.col("status")).when(count >= retries, "failed").otherwise("pending")
    out = both.where(~((F.col("_kind") == "success") & (F.col("_fails") == 0)) | F.col("_kind").isNull())
    named = F.col("_at").isNull()
    return out.select(F.when(named, F.col("_t")).otherwise(F.col("content_type")).alias("content_type"), F.when(named, F.col("_i")).otherwise(F.col("content_id")).alias("content_id"), status.alias("status"), count.alias("retry_count"), F.coalesce("_at", "updated_at").alias("updated_at"))


def claimed(queue: DataFrame, most: int = 20, retries: int = 3) -> DataFrame:
    """The oldest open rows of a queue: pending or failed with retries left."""
    return queue.where(F.col("status").isin("pending", "failed") & (F.col("retry_count") < retries)).orderBy("updated_at", "content_type", "content_id").limit(most)


def queue_stream(events: DataFrame, path: str, checkpoint: str, most: int = 20) -> tuple[StoredTable, StoredTable]:
    """Folds a stream of queue events into a stored queue; after each micro-batch the oldest open rows are claimed.

    Returns the queue and the claims, one row for each batch and claimed key. Claimed rows are `processing` from the batch's last
    time on, and open again by an event of theirs. A batch that is run again makes the same claims."""
    spark = events.sparkSession
    queue = StoredTable(spark, f"{path}/queue", QUEUE, ["content_type", "content_id"])
    claims = StoredTable(spark, f"{path}/claims", f"batch long, {QUEUE}", ["batch"])

    def each(new: DataFrame, batch: int) -> None:
        now = new.agg(F.max("ts")).first()[0]
        queue.merge(2 * batch, new, queue_rows)
        taken = claimed(queue.read(2 * batch + 1), most)
        claims.merge(batch, taken.select(F.lit(batch).cast("long").alias("batch"), *taken.columns), lambda stored, more: stored.where(F.col("batch") != batch).unionByName(more))
        taken = claims.read(batch + 1).where(F.col("batch") == batch).select("content_type", "content_id")  # `most` rows

        def marked(stored: DataFrame, these: DataFrame) -> DataFrame:
            mine = these.select(F.col("content_type").alias("_t"), F.col("content_id").alias("_i"), F.lit(True).alias("_mine"))
            rows = stored.join(F.broadcast(mine), F.col("content_type").eqNullSafe(F.col("_t")) & F.col("content_id").eqNullSafe(F.col("_i")), "left")
            time = F.coalesce(F.lit(now).cast("timestamp"), F.col("updated_at"))
            return rows.withColumns({"status": F.when(F.col("_mine"), "processing").otherwise(F.col("status")), "updated_at": F.when(F.col("_mine"), time).otherwise(F.col("updated_at"))}).drop("_t", "_i", "_mine")

        queue.merge(2 * batch + 1, taken, marked)

    _run(events, checkpoint, each)
    return queue, claims
