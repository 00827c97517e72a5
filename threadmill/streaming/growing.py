"""Growing transcripts as streams: orphan counts kept from change deltas, and rollups of the sessions that changed.

Both run in foreachBatch and keep their state in a folder that all executors reach (any file system that Spark reads).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import references as ref
from ..session import cut_lineage


class Log:
    """Append-only parts of a state's tables: folder/<table>/part=<n>, parted by bucket of session, and a mark per whole part.

    A part is written before its mark, so one that a failure cut short is written again and never read. Parts are
    merged by the reader; `merge` replaces all parts by one.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *p: path("/".join((self.folder, *p)))
        self.fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def parts(self) -> list[str]:
        """The whole parts in order, from the newest merged one ('m' and the number it goes up to) on."""
        if not self.fs.exists(self._path("marks")):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self._path("marks"))]
        upto = max((int(n[1:]) for n in names if n.startswith("m")), default=-1)
        return [f"m{upto}"] * (upto >= 0) + sorted((n for n in names if n.isdigit() and int(n) > upto), key=int)

    def has(self, number: int) -> bool:
        """Whether this number was written: parts come in the order of their numbers."""
        return any(int(p.lstrip("m")) >= number for p in self.parts())

    def read(self, table: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        places = [str(self._path(table, f"part={p}")) for p in self.parts()]
        if not places:
            return self.spark.createDataFrame([], schema)
        d = self.spark.read.schema(schema + ", bucket int").option("basePath", f"{self.folder}/{table}").parquet(*places)
        return (d if buckets is None else d.filter(F.col("bucket").isin(buckets))).drop("bucket", "part")

    def bucket(self) -> F.Column:
        return F.pmod(F.hash(F.coalesce("session_id", F.lit(""))), F.lit(self.buckets)).alias("bucket")

    def write(self, part: str, **tables: DataFrame) -> None:
        for name, d in tables.items():
            d.withColumn("bucket", self.bucket()).write.mode("overwrite").partitionBy("bucket").parquet(str(self._path(name, f"part={part}")))
        self.fs.create(self._path("marks", part), True).close()


class OrphanCounts:
    """Reference and existence counts kept under changes in any order: new and repeated records, blocks, removals."""

    LINES = "session_id string, line_no long, at timestamp, x struct<delivered_at:timestamp,uuid:string,parent:string,covered_session:string,covered:array<string>>"
    TOOLS = "session_id string, line_no long, uses array<string>, calls array<string>"
    GONE = "session_id string, uuid string"
    COUNTS = "domain string, session_id string, ref_id string, at timestamp, refs long, exists long"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.log = Log(spark, folder)

    def counts(self) -> DataFrame:
        """The state as of now, as references.count_state gives it."""
        return ref.count_state(self.log.read("counts", self.COUNTS))

    def apply(self, number: int, records: DataFrame | None = None, blocks: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Folds a change in; one that was folded in already (by its number) is passed over.

        Only lines that the change touches are looked at, in the buckets of their sessions: their contributions as they
        were go out, as they are now come in. What arrived before in the same state cancels out.
        """
        if self.log.has(number):
            return
        spark = self.log.spark
        empty = lambda schema: spark.createDataFrame([], schema)
        new_lines = cut_lineage(empty(self.LINES) if records is None else ref.record_lines(records))
        new_tools = cut_lineage(empty(self.TOOLS) if blocks is None else ref.tool_lines(blocks))
        new_gone = cut_lineage(empty(self.GONE) if removed is None else ref.removals(removed))
        sessions = new_lines.select("session_id").unionByName(new_tools.select("session_id")).unionByName(new_gone.select("session_id")).distinct()
        buckets = [r[0] for r in sessions.select(self.log.bucket()).distinct().collect()]
        read = lambda table, schema: self.log.read(table, schema, buckets)
        old_lines, old_tools, old_gone = ref.merge_lines(read("lines", self.LINES)), ref.merge_tools(read("tools", self.TOOLS)), read("gone", self.GONE).distinct()
        hit = ref.merge_lines(old_lines.unionByName(new_lines)).withColumn("uuid", F.col("x.uuid")).join(new_gone, ["session_id", "uuid"], "left_semi").select(*ref.LINE)
        touched = cut_lineage(new_lines.select(*ref.LINE).unionByName(new_tools.select(*ref.LINE)).unionByName(hit).distinct())
        near = lambda d: d.join(touched, ref.LINE, "left_semi")
        was = ref.contributions(ref.full_lines(near(old_lines), near(old_tools), old_gone)).filter("not is_gone")
        now = ref.contributions(ref.full_lines(
            ref.merge_lines(near(old_lines).unionByName(new_lines)), ref.merge_tools(near(old_tools).unionByName(new_tools)), old_gone.unionByName(new_gone).distinct()
        )).filter("not is_gone")
        back = ref.deltas(was).withColumn("refs", -F.col("refs")).withColumn("exists", -F.col("exists"))
        self.log.write(str(number), lines=new_lines, tools=new_tools, gone=new_gone, counts=ref.count_state(ref.deltas(now).unionByName(back)))

    def merge(self) -> None:
        """Replaces the parts so far by one, so that reading stays cheap; to be called now and then between changes."""
        parts = self.log.parts()
        if len(parts) > 1:
            self.log.write(
                "m" + parts[-1], lines=ref.merge_lines(self.log.read("lines", self.LINES)), tools=ref.merge_tools(self.log.read("tools", self.TOOLS)),
                gone=self.log.read("gone", self.GONE).distinct(), counts=self.counts(),
            )


def keep_orphan_counts(state: OrphanCounts, what: str = "records") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that folds a stream of records, blocks or removals (what: 'records', 'blocks', 'removed').

    Streams that feed one state need numbers of their own; one stream per state, or a union of streams, has them.
    """
    return lambda batch, number: state.apply(number, **{what: batch})


def rollup_changed(sink: str, query: Callable[[DataFrame], DataFrame], all_records: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that recomputes a per-session query for the sessions that a batch touches."""

    def run(batch: DataFrame, number: int) -> None:
        changed = cut_lineage(batch.select("session_id").distinct())
        query(all_records().join(changed, "session_id", "left_semi")).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={number}")

    return run
