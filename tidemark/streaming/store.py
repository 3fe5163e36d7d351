"""Events, spans and ledgers of growing logs in cells of sessions, under one version at a time.

A cell holds the sessions whose hash begins with its bits. Cells are split as their rows grow (extendible hashing: each cell has its own depth), so a
batch that touches one session reads and rewrites that session's cell, at any size of the store. Nothing written is ever changed: a cycle writes
the touched cells' tables to a new folder, then a new directory of all cells, and last one small version file, under a name that only one writer can
take. Readers follow one version, so they never see new spans with old costs, and a cycle that dies at any point leaves the version before it. The versions
are also the feed of changes: each names the cells that it changed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.cost import cost_ledger, unpriced_ledger
from tidemark.operators.merge import insert_absent
from tidemark.operators.spans import IDLE_MS, spans

#: Events that a cell holds at most, if it has more than one session; bits of a hash that name cells.
CELL_ROWS, BITS = 2_000_000, 40
#: Cells that are asked for by name, so that a file's other pages are not read.
FEW = 100
TABLES = ("events", "spans", "ledger", "unpriced")
KEPT = ("session_id", "source", "project_id", "group_id", "is_subagent")
DIRECTORY = "depth int, prefix long, rows long, sessions long, folder string"


class Conflict(RuntimeError):
    """Another writer took the version."""


def _prefix(depth: Column | int) -> Column:
    """The first `depth` bits of a session's hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.col("session_id").cast("string")), 64 - BITS)
    return F.floor(bits / F.pow(F.lit(2.0), F.lit(BITS) - (F.lit(depth) if isinstance(depth, int) else depth))).cast("long")


class SessionStore:
    """The store at a path (which all executors see)."""

    def __init__(self, spark: SparkSession, path: str, cell_rows: int = CELL_ROWS):
        self.spark, self.path, self.cell_rows = spark, path.rstrip("/"), cell_rows
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    # --- versions

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _read(self, path) -> str:
        stream = path.getFileSystem(self.conf).open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def version(self) -> int:
        """The newest version; 0 for a store without any."""
        folder = self._path("versions")
        files = folder.getFileSystem(self.conf)
        if not files.exists(folder):
            return 0
        return max((int(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return json.loads(self._read(self._path(f"versions/{version:012d}"))) if version else {"version": 0, "directory": None, "changed": [], "batch": None, "tables": {}}

    def _commit(self, manifest: dict) -> None:
        """Write the version file whole beside its place, then move it there unless somebody else has: the compare-and-swap."""
        name = f"{manifest['version']:012d}"
        beside, place = self._path(f"versions/.{name}-{uuid.uuid4().hex}"), self._path(f"versions/{name}")
        out = beside.getFileSystem(self.conf).create(beside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), self.conf).rename(beside, place, none)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(name) from e
            raise

    def changes(self, after: int = 0) -> list[dict]:
        """The feed: version, batch and changed cells (depth, prefix) of every version after one."""
        return [{k: m[k] for k in ("version", "batch", "changed")} for v in range(after + 1, self.version() + 1) for m in (self.manifest(v),)]

    # --- cells

    def directory(self, manifest: dict) -> DataFrame:
        return self.spark.read.schema(DIRECTORY).parquet(f"{self.path}/{manifest['directory']}") if manifest["directory"] else self.spark.createDataFrame([], DIRECTORY)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as one version has it."""
        manifest = self.manifest(version)
        return self._cells(table, manifest, self.directory(manifest))

    def _cells(self, table: str, manifest: dict, cells: DataFrame) -> DataFrame | None:
        """The rows of a table in the given cells, which lie in folders (one for each cycle that still has a cell). Files hold many cells each, in order: of few wanted cells only their pages are read."""
        schema = manifest["tables"].get(table)
        if schema is None:
            return None
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(schema)
        folders = [r.folder for r in cells.select("folder").distinct().collect()]
        there = [p for p in (f"{self.path}/{f}/{table}" for f in folders) if self._exists(p)]  # a cycle may have written no such table
        if not there:
            return self.spark.createDataFrame([], kind)
        rows = self.spark.read.schema(StructType([*kind.fields]).add("_cell", "string").add("_folder", "string")).parquet(*there)
        own = cells.select(F.concat_ws("-", "depth", "prefix").alias("_cell"), F.col("folder").alias("_folder"))
        few = [r["_cell"] for r in own.select("_cell").limit(FEW + 1).collect()]
        rows = rows.where(F.col("_cell").isin(few)) if len(few) <= FEW else rows
        return rows.join(F.broadcast(own), ["_cell", "_folder"], "left_semi").select(*kind.names)  # a row for each cell

    def _exists(self, path: str) -> bool:
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf).exists(p)

    def _routed(self, df: DataFrame, cells: DataFrame) -> DataFrame:
        """df with depth and prefix of its session's cell; a store without cells has one of depth 0. Cells have few depths, so each row asks for few prefixes."""
        depths = [r.depth for r in cells.select("depth").distinct().collect()] or [0]
        asked = df.withColumn("_c", F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), _prefix(d).alias("prefix")) for d in depths))))
        asked = asked.select(*df.columns, F.col("_c.depth").alias("depth"), F.col("_c.prefix").alias("prefix"))
        return asked.join(F.broadcast(cells.select("depth", "prefix")), ["depth", "prefix"]) if depths != [0] else asked

    # --- cycles

    def cycle(self, batch: DataFrame, idle_ms: int = IDLE_MS, prices: DataFrame | None = None, number: int | None = None, tries: int = 5) -> int:
        """One batch of events (event_id, session_id, thread_id, ts, kind, ...) under one new version, which is returned.

        A repeated event changes nothing, a late one rebuilds its cell. number: of a stream's batch; one that is already in changes nothing.
        """
        for _ in range(tries):
            try:
                return self._try(batch, idle_ms, prices, number)
            except Conflict:
                continue  # on top of what the other writer left
        raise Conflict(f"{tries} times")

    def _try(self, batch: DataFrame, idle_ms: int, prices: DataFrame | None, number: int | None) -> int:
        before = self.manifest()
        if number is not None and before["batch"] is not None and number <= before["batch"]:
            return before["version"]
        cells = self.directory(before)
        new = self._write(self._routed(batch.dropDuplicates(["event_id"]), cells), f"batches/{uuid.uuid4().hex}")
        touched = cells.join(new.select("depth", "prefix").distinct(), ["depth", "prefix"])
        stored = self._cells("events", before, touched)
        fresh = new.drop("depth", "prefix")
        whole = fresh if stored is None else stored.unionByName(insert_absent(stored, fresh, ["event_id"]).select(*stored.columns))
        folder = f"data/{uuid.uuid4().hex}"
        # cells that outgrow their bound get as many bits more as halve them enough; a cell of one session cannot be split
        sizes = self._routed(whole, cells).groupBy("depth", "prefix").agg(F.count("*").alias("rows"), F.countDistinct("session_id").alias("sessions"))
        more = F.when((F.col("rows") > self.cell_rows) & (F.col("sessions") > 1), F.ceil(F.log2(F.col("rows") / self.cell_rows))).otherwise(0)
        deeper = sizes.select("depth", "prefix", F.least(F.col("depth") + more, F.lit(BITS)).cast("int").alias("to"))
        placed = self._routed(whole, cells).join(deeper, ["depth", "prefix"])
        events = self._write(placed.select(*whole.columns, F.concat_ws("-", "to", _prefix(F.col("to"))).alias("_cell"), F.lit(folder).alias("_folder")), f"{folder}/events", "_cell")
        cell = events.select("session_id", "_cell").distinct()
        plain = events.drop("_cell", "_folder")
        made = {"spans": spans(plain, idle_ms, tuple(c for c in KEPT if c in whole.columns))}
        if prices is not None:
            made |= {"ledger": cost_ledger(plain, prices), "unpriced": unpriced_ledger(plain, prices)}
        for name, df in made.items():
            self._write(df.join(cell, "session_id").select(*df.columns, "_cell", F.lit(folder).alias("_folder")), f"{folder}/{name}", "_cell")
        own = events.groupBy("_cell").agg(F.count("*").alias("rows"), F.countDistinct("session_id").alias("sessions"))
        at = F.split("_cell", "-")
        own = own.select(F.get(at, F.lit(0)).cast("int").alias("depth"), F.get(at, F.lit(1)).cast("long").alias("prefix"), "rows", "sessions", F.lit(folder).alias("folder"))
        rest = cells.join(touched.select("depth", "prefix"), ["depth", "prefix"], "left_anti").select(own.columns)
        name = f"directories/{uuid.uuid4().hex}"
        # halves of a split cell in which no session lies yet are cells too: their sessions may come
        halves = deeper.where("to > depth").select("depth", F.col("to").alias("_to"), F.explode(F.sequence(F.col("prefix") * F.pow(F.lit(2.0), F.col("to") - F.col("depth")).cast("long"), (F.col("prefix") + 1) * F.pow(F.lit(2.0), F.col("to") - F.col("depth")).cast("long") - 1)).alias("prefix"))
        empty = halves.select(F.col("_to").alias("depth"), "prefix", F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("sessions"), F.lit(folder).alias("folder")).join(own.select("depth", "prefix"), ["depth", "prefix"], "left_anti")
        directory = self._write(rest.unionByName(own).unionByName(empty.select(own.columns)), name)
        changed = [[r.depth, r.prefix] for r in directory.where(F.col("folder") == folder).select("depth", "prefix").collect()]
        tables = {"events": whole.schema.jsonValue()} | {k: df.schema.jsonValue() for k, df in made.items()}
        self._commit({"version": before["version"] + 1, "directory": name, "changed": sorted(changed), "batch": number if number is not None else before["batch"], "tables": before["tables"] | tables})
        return before["version"] + 1

    def _write(self, df: DataFrame, name: str, by: str = "") -> DataFrame:
        """Write df below the store, in a folder of its own, and read it back."""
        out = df.repartition(F.col(by)).sortWithinPartitions(by) if by else df  # each cell in one file, as many files as there are tasks
        out.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def vacuum(self, keep: int = 1) -> int:
        """Delete what no version from the newest `keep` on needs (also what dead cycles left); returns how many folders went. Not while a cycle runs."""
        newest = self.version()
        kept = [self.manifest(v) for v in range(max(1, newest - keep + 1), newest + 1)]
        needed = {m["directory"].rsplit("/", 1)[1] for m in kept if m["directory"]}
        for m in kept:
            needed |= {r.folder.rsplit("/", 1)[1] for r in self.directory(m).select("folder").distinct().collect()}
        gone = 0
        for kind in ("data", "directories", "batches"):
            folder = self._path(kind)
            files = folder.getFileSystem(self.conf)
            for f in files.listStatus(folder) if files.exists(folder) else ():
                if f.getPath().getName() not in needed:
                    files.delete(f.getPath(), True)
                    gone += 1
        return gone


def follow_store(stream: DataFrame, store: SessionStore, checkpoint: str, idle_ms: int = IDLE_MS, prices: DataFrame | None = None, then: Callable[[int], None] | None = None, **trigger) -> StreamingQuery:
    """A cycle for each micro-batch; a batch that runs again after its version was made changes nothing. then: told of each version."""

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            version = store.cycle(batch, idle_ms, prices, number)
            if then:
                then(version)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "2 seconds"})).start()
