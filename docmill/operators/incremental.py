"""Processing only new or changed records, with the target as the only state.

Every row that a run writes carries the key and the version of the source row it came from. What is still to be done is
therefore always `source anti-join target`; there is no bookmark beside the data that could run ahead of it or fall behind.
A target version is written to its own folder first and becomes visible by one atomic creation of a commit file, so a run
that dies leaves nothing behind that a reader or a later run would see.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from contextlib import suppress
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window


def slashed(path: Column | str) -> Column:
    """A path in slash notation. Null stays null."""
    path = F.col(path) if isinstance(path, str) else path
    return F.translate(path, "\\", "/")


#: After so many versions a run keeps the state beside its rows, so that later runs read no further back.
COMPACT = 16
#: Runs that find their version taken by another begin anew, so many times at most.
TRIES = 5


def listings(records: DataFrame) -> DataFrame:
    """What each scan listed: (scan_id, path, mtime, size), one row per scan and path.

    Rows belong to the scan they name, whenever they arrived. Rows without mtime, path or scan_id count as not listed; of
    several rows the one with the highest record_id counts. Size may be null and then equals only null.
    """
    kept = records.select("scan_id", slashed("path").alias("path"), "mtime", "size", "record_id").where(
        F.col("mtime").isNotNull() & F.col("path").isNotNull() & F.col("scan_id").isNotNull()
    )
    last = F.max(F.struct(F.coalesce("record_id", F.lit(-1)).alias("r"), "mtime", "size"))
    rows = kept.groupBy("scan_id", "path").agg(last.alias("last")).select("scan_id", "path", "last.mtime", "last.size")
    return rows.where(F.col("mtime").isNotNull())  # as a join would ask, so that all uses share one shuffle


def successful(scans: DataFrame) -> DataFrame:
    """(scan_id, prev_id): the successful scans, each with the last earlier successful scan of its root (null for the first).

    The sort per root holds two short columns of one row per scan; equal scan_ids count once.
    """
    ok = scans.where(F.col("status") == "success").groupBy("scan_id").agg(F.min("root_dir").alias("root"))
    return ok.select("scan_id", F.lag("scan_id").over(Window.partitionBy("root").orderBy("scan_id")).alias("prev_id"))


def scan_plan(scans: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(scan_id, root, prev_id, new, last): the successful scans after those in `done` (scan_id, root), and these themselves.

    prev_id is the last earlier successful scan of the root; last tells which scan of a root is the newest. Scans of one root
    are put in order in one task: two short columns of one row per scan.
    """
    ok = scans.where((F.col("status") == "success") & F.col("scan_id").isNotNull()).groupBy("scan_id").agg(F.min("root_dir").alias("root")).withColumn("new", F.lit(True))
    if done is not None:
        d = done.select(F.col("scan_id").alias("_done"), F.col("root").alias("_root"))
        ok = ok.join(d, F.col("root").eqNullSafe(F.col("_root")), "left").where(F.col("_done").isNull() | (F.col("scan_id") > F.col("_done"))).select("scan_id", "root", "new")
        ok = ok.unionByName(done.select("scan_id", "root", F.lit(False).alias("new")))
    w = Window.partitionBy("root").orderBy("scan_id")
    return ok.select("scan_id", "root", F.lag("scan_id").over(w).alias("prev_id"), "new", F.lead("scan_id").over(w).isNull().alias("last"))


def listing_history(records: DataFrame, plan: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(scan_id, root, path, mtime, size, changed, held): what the scans of a plan listed, which of it is to be processed, and what the newest listing of each root holds.

    `state` is what the newest listings held before. A path is compared with its own row before it, which counts only if it
    is from the scan before; so one partitioning by root and path serves both the repeated listings of a scan and the
    anti-join of each scan with the one before, and a root with a third of all rows is spread over its paths.
    """
    rows = records.select("scan_id", slashed("path").alias("path"), "mtime", "size", F.coalesce("record_id", F.lit(-1)).alias("record_id")).where(F.col("mtime").isNotNull() & F.col("path").isNotNull())
    rows = rows.join(plan.where("new"), "scan_id")
    if state is not None:
        kept = state.where(F.col("path").isNotNull()).select("scan_id", "path", "mtime", "size", F.lit(-1).cast("long").alias("record_id"))
        rows = rows.unionByName(kept.join(plan.where(~F.col("new")), "scan_id"))
    w = Window.partitionBy("root", "path").orderBy("scan_id", "record_id")
    rows = rows.withColumn("_next", F.lead("scan_id").over(w)).where(F.col("_next").isNull() | (F.col("_next") != F.col("scan_id")))
    rows = rows.withColumn("_before", F.lag(F.struct("scan_id", "mtime", "size")).over(w))
    same = (F.col("_before.scan_id") == F.col("prev_id")) & (F.col("_before.mtime") == F.col("mtime")) & F.col("_before.size").eqNullSafe(F.col("size"))
    return rows.select("scan_id", "root", "path", "mtime", "size", (F.col("new") & ~F.coalesce(same, F.lit(False))).alias("changed"), F.col("last").alias("held"))


def changed_paths(records: DataFrame, scans: DataFrame) -> DataFrame:
    """(scan_id, path, mtime, size): the paths each successful scan has to process, of a whole history at once.

    The listing of a successful scan is the state that its run publishes. Rows without mtime, path or scan_id count as not
    listed; of several rows of a scan and path the one with the highest record_id counts; null sizes equal null. Failed,
    aborted and unended scans publish nothing and are compared with none. Empty tables give no rows.
    """
    return listing_history(records, scan_plan(scans)).where("changed").select("scan_id", "path", "mtime", "size")


class VersionedTarget:
    """A Parquet table in versions under `root`: v=<n>-<run>/ holds the rows, commits/<n>.json names the folder.

    A version counts from the moment its commit file exists. The file is put in place by a rename that replaces nothing: of
    two runs that aim for the same version one fails and begins anew, and folders without a commit are never read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        given = self._path(root.rstrip("/"))
        self._fs = given.getFileSystem(conf)
        whole = given.makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory())
        self.root = whole.toString()
        self._context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), conf)

    def versions(self) -> list[int]:
        """Numbers of the published versions, in order."""
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return []
        names = (status.getPath().getName() for status in self._fs.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _commit(self, n: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/commits/{n}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def folder(self, n: int, part: str = "folder") -> str:
        """Where a published version has its rows."""
        return f"{self.root}/{self._commit(n)[part]}"

    def read(self, schema: str, numbers: list[int] | None = None) -> DataFrame:
        """The rows of all published versions, or of those given; an empty table with `schema` before the first."""
        folders = [self.folder(n) for n in (self.versions() if numbers is None else numbers)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def stage(self, rows: DataFrame, n: int) -> str:
        """Writes the rows of version n where no reader looks yet; returns the folder."""
        folder = f"v={n}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.root}/{folder}")
        return folder

    def drop(self, folder: str | None) -> None:
        """Removes a staged folder that is not going to be published."""
        if folder:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)

    def publish(self, n: int, folder: str, listing: str | None = None, **more: str) -> None:
        """Makes a staged folder version n, and a second one its state, in one atomic step. Fails with FileExistsError if n is already published."""
        made = self._path(f"{self.root}/commits/.{n}-{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(made, False)
        stream.write(bytearray(json.dumps({"version": n, "folder": folder} | ({"listing": listing} if listing else {}) | more).encode()))
        stream.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(made, self._path(f"{self.root}/commits/{n}.json"), none)  # refuses to replace an existing file
        except Exception as error:
            self._fs.delete(made, False)
            if "AlreadyExists" in str(getattr(error, "java_exception", error)):
                raise FileExistsError(f"version {n} of {self.root} is already published") from error
            raise

    def state(self, key: list[str], version: list[str], schema: str, numbers: list[int] | None = None) -> DataFrame:
        """(key..., version...): the state kept with the newest version that has one, with the rows of the versions after it, the last of each key."""
        numbers = self.versions() if numbers is None else numbers
        base, later = None, []
        for n in reversed(numbers):
            commit = self._commit(n)
            if "listing" in commit:
                base = self.spark.read.parquet(f"{self.root}/{commit['listing']}").select(*key, *version)
                break
            later.append(f"{self.root}/{commit['folder']}")
        if base is not None and not later:
            return base
        rows = self.spark.read.schema(schema).parquet(*later) if later else self.spark.createDataFrame([], schema)
        rows = rows.select(*key, *version, F.coalesce(F.nullif(F.regexp_extract(F.input_file_name(), r"/v=(\d+)-[0-9a-f]+/[^/]*$", 1), F.lit("")).cast("long"), F.lit(0)).alias("_n"))
        if base is not None:
            rows = rows.unionByName(base.withColumn("_n", F.lit(0).cast("long")))
        newest = rows.groupBy(*key).agg(F.max("_n").alias("_last"))
        on = F.col("r._n") == F.col("l._last")
        for c in key:
            on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"l.{c}"))
        return rows.alias("r").join(newest.alias("l"), on, "left_semi").select(*key, *version).distinct()

    def run(self, source: DataFrame, key: list[str], version: list[str], work: Callable[[DataFrame], DataFrame], schema: str, whole: bool = False) -> int | None:
        """One run: the source rows that differ from the published state of their key go through `work` and become a version.

        `work` must keep the key and version columns; `schema` describes its rows. The state of a key is its last published
        version, so a version that comes back is processed again. With `whole` the source is all there is: keys that it lacks
        are gone, and new when they return; each version then keeps the listing. Runs that fail publish nothing and change no
        state. A run that another one overtakes drops its rows and begins anew from what that one published. Null versions
        equal null. Repeated source rows with equal key and version count once. Returns the version published, or None if
        there was nothing to do.
        """
        source = source.dropDuplicates([*key, *version])
        equal = lambda columns: reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in columns])
        for _ in range(TRIES):
            numbers = self.versions()
            n = (numbers or [0])[-1] + 1
            done = self.state(key, version, schema, numbers).alias("t")
            todo = source.alias("s").join(done, equal([*key, *version]), "left_anti")
            folder, listing = self.stage(work(todo), n), None
            gone = whole and not done.join(source.alias("s"), equal([*key, *version]), "left_anti").isEmpty()
            fresh = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")
            if not gone and fresh.isEmpty():
                self.drop(folder)
                return None
            if whole:
                listing = self.stage(source.select(*key, *version), n)
            elif n % COMPACT == 0:
                new = fresh.select(*key, *version).distinct()
                listing = self.stage(done.join(new.alias("s"), equal(key), "left_anti").unionByName(new), n)
            try:
                self.publish(n, folder, listing)
                return n
            except FileExistsError:
                for staged in (folder, listing):
                    with suppress(Exception):
                        self.drop(staged)
        raise FileExistsError(f"{self.root} was published by others {TRIES} times in a row")


HISTORY = "scan_id long, root string, path string, mtime double, size long, changed boolean, held boolean"


def process_scans(target: VersionedTarget, records: DataFrame, scans: DataFrame) -> int | None:
    """One run over a history of scans: what the successful scans since the last run have to process becomes one version of the target.

    A version holds the rows to process (changed) and the newest listing of each root (held; a row with null path for the scan
    itself), which is all that the next run compares with; so the state is part of what is published, and a run that dies or
    is overtaken leaves none. Rows that arrive for a scan after the run that took it in belong to no later run. Returns the
    version, or None if there was no new scan.
    """
    for _ in range(TRIES):
        numbers = target.versions()
        n = (numbers or [0])[-1] + 1
        state = target.read(HISTORY, numbers[-1:]).where("held") if numbers else None
        plan = scan_plan(scans, None if state is None else state.where(F.col("path").isNull()).select("scan_id", "root"))
        if plan.where("new").isEmpty():
            return None
        names = [c.split()[0] for c in HISTORY.split(", ")]
        none = lambda t: F.lit(None).cast(t)
        marks = plan.where("last").select("scan_id", "root", none("string").alias("path"), none("double").alias("mtime"), none("long").alias("size"), F.lit(False).alias("changed"), F.lit(True).alias("held"))
        rows = listing_history(records, plan, state).where(F.col("changed") | F.col("held")).select(*names).unionByName(marks)
        folder = target.stage(rows, n)
        try:
            target.publish(n, folder)
            return n
        except FileExistsError:
            target.drop(folder)
    raise FileExistsError(f"{target.root} was published by others {TRIES} times in a row")


def processed_paths(target: VersionedTarget, numbers: list[int] | None = None) -> DataFrame:
    """(scan_id, path, mtime, size): what the published versions of process_scans, or those given, had to process."""
    return target.read(HISTORY, numbers).where("changed").select("scan_id", "path", "mtime", "size")
