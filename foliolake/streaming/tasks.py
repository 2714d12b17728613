"""Streams of task events and catalogue changes; each micro-batch folds into a state that batch queries can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import latest_rows, postings
from ..operators.mutate import upsert
from ..session import cut

REFRESH = ("deck_id", "slide_key", "page_no", "title", "title_source", "body_text", "hidden", "updated_at", "row_seq", "iwa_uuid", "element_sig", "template_sig")
PRESERVE = ("type_tag", "subtype_tag", "customer_tag", "media_tag", "free_tags")
FILL = ("notes", "thumbnail_path")


class Versions:
    """A table as numbered folders on any file system that Spark knows. A version is written whole and then marked, so a reader never sees half of it
    and the one before stays for going back. A version may hold some buckets of the table only: of each bucket the newest marked one counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    @property
    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[str]:
        found = self._files.globStatus(self._path(pattern))
        return [str(x.getPath().toString()) for x in found] if found else []

    @property
    def marked(self) -> list[int]:
        """Numbers of the versions that are complete, the newest first."""
        return sorted((int(n.rpartition("/")[2][1:-3]) for n in self._names("v*.ok")), reverse=True)

    @property
    def current(self) -> int:
        return next(iter(self.marked), 0)

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets; None if there is none of it yet."""
        newest: dict[str, str] = {}
        for v in self.marked:
            whole = not self._names(f"v{v}/bucket=*")
            for path in [f"{self.folder}/v{v}"] if whole else self._names(f"v{v}/bucket=*"):
                newest.setdefault("" if whole else path.rpartition("=")[2], path)
            if whole:
                break
        wanted = [p for b, p in newest.items() if buckets is None or b == "" or int(b) in buckets]
        return self.spark.read.parquet(*wanted) if wanted else None

    def write(self, df: DataFrame, check=None) -> bool:
        """Write the next version, by buckets if df has a column of that name; with a check that gives false on what was written, it isn't marked."""
        at = self.current + 1
        writer = df.write.mode("overwrite")
        (writer.partitionBy("bucket") if "bucket" in df.columns else writer).parquet(f"{self.folder}/v{at}")
        if check and not check(self.spark.read.parquet(f"{self.folder}/v{at}")):
            return False
        self._files.create(self._path(f"v{at}.ok"), True).close()
        return True

    def roll_back(self) -> None:
        """Take the mark off the newest version."""
        if self.current:
            self._files.delete(self._path(f"v{self.current}.ok"), False)


def latest_status(events: DataFrame, task: str, at: str, status: str) -> DataFrame:
    """A stream's running state of each task: its last status and how many events it had (update or complete mode)."""
    return events.groupBy(task).agg(F.max(F.struct(F.col(at).alias("at"), F.col(status).alias("status"))).alias("s"), F.count(F.lit(1)).alias("events")).select(task, "s.at", "s.status", "events")


def ingest(spark: SparkSession, source: str, schema, table: str, checkpoint: str, retag: bool = False, files_per_batch: int = 1, buckets: int = 64) -> StreamingQuery:
    """Fold arriving slide files into a versioned table, batch by batch: the last row of each id in a batch is upserted. Runs until what is there has
    been taken in; a batch that comes again after a failure changes nothing. The table is kept in `buckets` by the hash of the id, and a batch
    reads and writes only those that its ids fall into."""
    target = Versions(spark, table)

    def merge(batch: DataFrame, _: int) -> None:
        bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
        new = cut(latest_rows(batch.where("id IS NOT NULL"), "id", "row_seq"))
        touched = [r[0] for r in new.select(bucket).distinct().collect()]
        if not touched:
            return
        old = target.read(touched)
        rows = new if old is None else upsert(old.select(new.columns), new, "id", REFRESH, PRESERVE, FILL, retag)
        target.write(rows.withColumn("bucket", bucket).repartition("bucket"))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_postings(index: DataFrame, changed: DataFrame, removed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The inverted index after some rows changed or went: their postings are dropped and those of the changed rows are made again."""
    gone = changed.select(key).unionByName(removed.select(key)).distinct()
    return index.join(gone, key, "left_anti").unionByName(postings(changed, key, columns).select(*index.columns))


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and kind with a watermark for late ones; an extra for event streams, not a feature of the catalogue."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")
