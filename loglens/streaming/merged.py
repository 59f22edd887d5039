"""A deduplicated table that stream batches are merged into, folder by folder.

Rows lie in folders by day and by hash of their id. A batch rewrites only the folders it
touches, under its own number; the manifest of a batch, written last, names the number that
holds each folder. A reader takes the newest manifest. A batch that runs again starts from
the manifest before it and writes the same once more, so a replay changes nothing.

Copies of an id usually share their day. For those that do not, every folder keeps bitmaps
of the hashes of its ids: only folders of other days whose bitmaps hold a hash of the batch
are looked at, and only their ids (some in vain, no copy is missed); those that do hold one
are merged as well. History is not read otherwise.

Summaries, such as counts an hour, are kept a folder and rewritten with it; reading them
folds small cells and never the rows.

The first copy of an id is the one that ``dedupe_events`` keeps, whatever the order of
batches; rows without an id are all kept; a row without a time has the day ``none``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from ..operators.events import dedupe_events

Summary = Callable[[DataFrame], DataFrame]
_FOLDER = ["day", "bucket"]
_MANIFEST = "day string, bucket int, version long"
_BITMAPS = "number long, bitmap binary"
PLACES = 8


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _listed(spark: SparkSession, pattern: str) -> set[str]:
    """Paths that match a pattern, from their first ``version=`` on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    return {"version=" + str(f.getPath()).rsplit("/version=", 1)[1] for f in found}


class MergedTable:
    """``buckets`` folders a day; ``bits``: size (as a power of two) of a folder's bitmap of hashes;
    ``summaries``: name to a function that folds the rows of each (day, bucket)."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: StructType,
        summaries: Mapping[str, Summary] | None = None,
        key: str = "event_id",
        time: str = "event_time",
        buckets: int = 8,
        bits: int = 20,
    ):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.summaries = dict(summaries or {})
        self.key, self.time, self.buckets, self.bits = key, time, buckets, bits

    # --- places ---

    def _placed(self, rows: DataFrame) -> DataFrame:
        named = F.coalesce(F.nullif(F.col(self.key), F.lit("")), F.col(self.time).cast("string"), F.lit(""))
        return rows.withColumns(
            {
                "day": F.coalesce(F.date_format(self.time, "yyyy-MM-dd"), F.lit("none")),
                "bucket": F.pmod(F.xxhash64(named), F.lit(self.buckets)).cast("int"),
            }
        )

    def _hash(self):
        """Where an id is in the bitmaps of its bucket (another hash than the bucket's)."""
        return F.pmod(F.xxhash64(F.lit("bitmap"), F.col(self.key)), F.lit(1 << self.bits))

    def manifest(self, before: int | None = None) -> dict[tuple[str, int], int]:
        """(day, bucket) to the number of the batch that holds it, by the newest manifest (before
        a batch). It has one entry a folder, so its size does not grow with the rows."""
        path = f"{self.root}/manifest"
        if not _exists(self.spark, path):
            return {}
        written = self.spark.read.schema(_MANIFEST + ", batch long").parquet(path)
        if before is not None:
            written = written.filter(F.col("batch") < before)
        newest = written.agg(F.max("batch")).first()[0]
        if newest is None:
            return {}
        # A manifest without folders has the one row of nulls.
        rows = written.filter(F.col("batch") == newest).filter("day IS NOT NULL").collect()
        return {(r.day, r.bucket): r.version for r in rows}

    def _read(self, kind: str, folders: Mapping[tuple[str, int], int], schema: StructType) -> DataFrame:
        full = StructType([*schema.fields])
        for name, of in (("version", LongType()), ("day", StringType()), ("bucket", IntegerType())):
            full = full.add(name, of)
        base = f"{self.root}/{kind}"
        wanted = [f"version={v}/day={d}/bucket={b}" for (d, b), v in sorted(folders.items())]
        # A folder whose rows have no id, or no time, has no bitmap, or no cells.
        versions = ",".join(sorted({str(v) for v in folders.values()}))
        there = _listed(self.spark, f"{base}/version={{{versions}}}/day=*/bucket=*") if wanted else set()
        paths = [f"{base}/{w}" for w in wanted if w in there]
        if not paths:
            return self.spark.createDataFrame([], full).drop("version")
        return self.spark.read.schema(full).option("basePath", base).parquet(*paths).drop("version")

    def _write(self, kind: str, table: DataFrame, version: int) -> None:
        # One file for each folder; a number keeps small batches from being written by one task.
        gathered = table.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *_FOLDER)
        gathered.write.mode("overwrite").partitionBy(*_FOLDER).parquet(f"{self.root}/{kind}/version={version}")

    def _folders(self, path: str) -> set[tuple[str, int]]:
        parts = (x.split("/") for x in _listed(self.spark, f"{path}/day=*/bucket=*"))
        return {(day[len("day=") :], int(bucket[len("bucket=") :])) for _, day, bucket in parts}

    # --- merging ---

    def apply(self, batch: DataFrame, number: int) -> None:
        """Merge the rows of a batch; the same number again replaces what it did before."""
        now = self.manifest(number)
        staged = f"{self.root}/staging/version={number}"
        first = dedupe_events(batch.select(*self.schema.names), self.key, (self.time,), places=PLACES)
        self._placed(first).write.mode("overwrite").parquet(staged)
        new = self.spark.read.parquet(staged)
        touched = {(r.day, r.bucket) for r in new.select(*_FOLDER).distinct().collect()}
        touched |= self._repeats(new, now) if now else set()
        old = self._read("rows", {f: v for f, v in now.items() if f in touched}, self.schema)
        names = self.schema.names
        # An id has at most one row in a folder and one in the batch.
        both = old.select(*names).unionByName(new.select(*names))
        merged = self._placed(dedupe_events(both, self.key, (self.time,), places=1))
        self._write("rows", merged, number)
        written = self.spark.read.schema(StructType([*self.schema.fields]).add("day", StringType()).add("bucket", IntegerType())).parquet(
            f"{self.root}/rows/version={number}"
        )
        spot = written.filter(F.coalesce(F.col(self.key), F.lit("")) != "").select(*_FOLDER, self._hash().alias("spot"))
        bitmaps = spot.groupBy(*_FOLDER, F.bitmap_bucket_number("spot").alias("number")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bitmap")
        )
        self._write("bitmaps", bitmaps, number)
        for name, summary in self.summaries.items():
            self._write(f"summary-{name}", summary(written), number)
        left = self._folders(f"{self.root}/rows/version={number}")
        after = {f: v for f, v in now.items() if f not in touched} | dict.fromkeys(left, number)
        rows = [(d, b, v) for (d, b), v in sorted(after.items())] or [(None, None, None)]
        table = self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)
        table.write.mode("overwrite").parquet(f"{self.root}/manifest/batch={number}")

    def _repeats(self, new: DataFrame, now: Mapping[tuple[str, int], int]) -> set[tuple[str, int]]:
        """Folders of other days that hold an id of the new rows. Bitmaps name the folders that
        may; only the ids of these are read."""
        asked = new.filter(F.coalesce(F.col(self.key), F.lit("")) != "").select(
            F.col("day").alias("new_day"), "bucket", F.col(self.key).alias("new_key"),
            F.bitmap_bucket_number(self._hash()).alias("number"), F.bitmap_bit_position(self._hash()).alias("position"),
        )
        bitmaps = self._read("bitmaps", now, StructType.fromDDL(_BITMAPS))
        byte = F.conv(F.hex(F.substring("bitmap", (F.col("position") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.call_function("shiftleft", F.lit(1), F.expr("position % 8").cast("int"))
        may = asked.join(bitmaps, ["bucket", "number"]).filter((F.col("day") != F.col("new_day")) & (byte.bitwiseAND(bit) != 0))
        folders = {(r.day, r.bucket) for r in may.select(*_FOLDER).distinct().collect()}
        if not folders:
            return set()
        ids = self._read("rows", {f: v for f, v in now.items() if f in folders}, self.schema).select(*_FOLDER, F.col(self.key).alias("new_key"))
        same = asked.select("new_day", "bucket", "new_key").join(ids, ["bucket", "new_key"]).filter("day <> new_day")
        return {(r.day, r.bucket) for r in same.select(*_FOLDER).distinct().collect()}

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Merge every batch of a stream."""
        writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        return writer.foreachBatch(self.apply).start()

    # --- reading ---

    def rows(self) -> DataFrame:
        return self._read("rows", self.manifest(), self.schema).select(*self.schema.names)

    def summary(self, name: str) -> DataFrame:
        """The cells of a summary over all folders, to be folded further."""
        now = self.manifest()
        if not now:
            raise ValueError("no batch has been merged yet")
        some = next(iter(now.values()))
        schema = self.spark.read.parquet(f"{self.root}/summary-{name}/version={some}").drop(*_FOLDER).schema
        return self._read(f"summary-{name}", now, schema)


def counts_by(width: str, time: str = "event_time") -> Summary:
    """A summary: events per tumbling window (rows without a time are in none)."""

    def fold(rows: DataFrame) -> DataFrame:
        start = F.window(F.col(time).cast("timestamp"), width).start
        return rows.groupBy(*_FOLDER, start.alias("window_start")).agg(F.count(F.lit(1)).alias("event_count"))

    return fold


def cells_by(keys: list[str], sums: Mapping[str, str], count: str = "query_count") -> Summary:
    """A summary: number of rows and sums per keys, so that members stay countable."""

    def fold(rows: DataFrame) -> DataFrame:
        totals = (F.sum(column).alias(name) for name, column in sums.items())
        return rows.groupBy(*_FOLDER, *keys).agg(F.count(F.lit(1)).alias(count), *totals)

    return fold
