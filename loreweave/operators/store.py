"""The chunk store: Parquet runs that are added, merged on reading and compacted by size; and its parts as functions of tables."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F, types as T

from .. import schemas
from ..shared import TASK_ROWS, tasks_of
from . import file_index

KEY = ("pid", "source", "chunk_index")
COLUMNS = [f.name for f in schemas.CHUNKS.fields]


def stale(pages: DataFrame, store: DataFrame) -> DataFrame:
    """Pages without an equally new or newer article in the store. Null dates and sources never match, so such pages stay."""
    newest = store.groupBy(F.col("pid").alias("_pid"), F.col("source").alias("_source")).agg(F.max("last_modified_date").alias("_date"))
    return pages.join(newest, (F.col("pid") == F.col("_pid")) & (F.col("source") == F.col("_source")) & (F.col("_date") >= F.col("last_modified_date")), "left_anti")


def complete(store: DataFrame) -> DataFrame:
    """Articles of which every chunk is stored: pid, source, last_modified_date."""
    return store.groupBy("pid", "source").agg(F.max("last_modified_date").alias("last_modified_date"), F.count("*").alias("n"), F.max("chunk_count").alias("chunk_count")).filter("n >= chunk_count").drop("n", "chunk_count")


def without_articles(store: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the store but those of keys(pid, source); null sources are equal."""
    k = keys.select(F.col("pid").alias("_pid"), F.col("source").alias("_source")).distinct()
    return store.join(k, F.col("pid").eqNullSafe(F.col("_pid")) & F.col("source").eqNullSafe(F.col("_source")), "left_anti")


def upsert(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """The store with each incoming article in place of its old chunks; repeated keys keep the newest date."""
    fresh = incoming.groupBy(*KEY).agg(F.max_by(F.struct(*incoming.columns), F.coalesce("last_modified_date", F.lit("1900-01-01").cast("timestamp"))).alias("r")).select("r.*")
    return without_articles(store, incoming).unionByName(fresh)


def checked(rows: DataFrame, dimension: int) -> DataFrame:
    """Rows for the store; a missing or wrongly sized vector is an error."""
    ok = F.col("embedding").isNotNull() & (F.size("embedding") == dimension)
    return rows.withColumn("embedding", F.when(F.isnull(F.assert_true(ok, "an item without a vector of the store's dimension")), F.col("embedding"))).select(*COLUMNS)


def pid_of_title(store: DataFrame, title: str, source: str) -> DataFrame:
    """The smallest pid with that name."""
    return store.filter((F.col("name") == title) & (F.col("source") == source)).agg(F.min("pid").alias("pid"))


def retrieve(store: DataFrame, title: str, source: str = "enwiki") -> DataFrame:
    """name, content, chunk_index of an article in order; an unknown title gives no rows."""
    one = pid_of_title(store, title, source)
    return store.filter(F.col("source") == source).join(F.broadcast(one), "pid", "left_semi").orderBy("chunk_index").select("name", "content", "chunk_index")


def by_range(rows: DataFrame, n: int, *columns: str) -> DataFrame:
    """n rows dealt by ranges of columns; as many ranges as bound a task's rows, where that is more than the session has."""
    tasks = tasks_of(rows.sparkSession, n)
    return rows.repartitionByRange(tasks, *columns) if tasks else rows.repartitionByRange(*columns)


class ChunkStore:
    """The store in a folder that all executors share, as runs that are only ever added and merged.

    A write makes one run: its chunks, sorted by source and pid, an entry per article, and an index of its files. It reads
    nothing that is stored, so its cost follows the batch. POINTER-<n> files name the runs in order; the highest n counts, and a
    writer makes pointer n + 1 only if nobody else has (else it looks again and goes on behind the other). Readers merge: of each
    article only what no later run has replaced is seen. Runs of like size are merged, FANOUT at a time, so a row is
    written again as often as the logarithm of the store's size says. The last KEPT pointers and their runs stay for readers that began earlier.

    An article is written whole (`upsert`, `delete`) or in pieces (`append`). Pieces of one last_modified_date belong
    together; while a version lacks chunks it is hidden and the article's earlier version stays. Of equal chunks the last counts.

    Columns have numbers in the files and names in the pointer, so `migrate` renames, drops, adds and widens without rewriting.
    """

    KEPT = 3
    FANOUT = 4
    #: Entries up to which they are sent to every executor; beyond it rows and entries are shuffled.
    BROADCAST_KEYS = 1_000_000
    #: Columns that the store itself reads; they keep their names.
    CORE = ("pid", "name", "source", "chunk_index", "chunk_count", "last_modified_date")
    ENTRIES = "pid long, source string, whole boolean, date timestamp, chunks array<int>, of int"

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType = schemas.CHUNKS):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    # ---- pointers

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), root, jvm.org.apache.hadoop.fs.Path

    def _numbers(self) -> list[int]:
        fs, root, _ = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[8:]) for n in names if n.startswith("POINTER-") and n[8:].isdigit())

    def _read_pointer(self, number: int) -> dict | None:
        fs, _, path = self._fs()
        stream = fs.open(path(f"{self.folder}/POINTER-{number:012d}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:  # not one of ours, or not finished
            return None
        finally:
            stream.close()

    def _pointer(self) -> tuple[int, dict]:
        for number in reversed(self._numbers()):
            if (found := self._read_pointer(number)) is not None:
                return number, found
        return 0, {"runs": [], "fields": [{"id": k, "name": f.name, "type": f.dataType.simpleString()} for k, f in enumerate(self.schema.fields, 1)]}

    def _point(self, number: int, to: dict) -> None:
        """Makes a pointer at once and whole; fails if there is one of that number."""
        fs, root, path = self._fs()
        fs.mkdirs(root)
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        draft, final = path(f"{self.folder}/.draft-{uuid.uuid4().hex}"), path(f"{self.folder}/POINTER-{number:012d}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(to).encode()))
        out.close()
        only_new = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        only_new[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(final), only_new)
        except Exception:
            fs.delete(draft, False)
            raise

    def _change(self, change: Callable[[dict, int], dict | None], attempts: int = 20) -> bool:
        """Applies a change of the pointer to the newest one, again if another writer was first; a change that returns None is given up."""
        for left in range(attempts - 1, -1, -1):
            _, pointer = self._pointer()
            number = max(self._numbers(), default=0) + 1
            new = change(pointer, number)
            if new is None:
                return False
            try:
                self._point(number, new)
            except Exception as e:
                if not left or number not in self._numbers():
                    raise e
                continue
            self._clean()
            return True
        return False

    def _clean(self) -> None:
        """Old pointers go, and the runs that only they name."""
        fs, _, path = self._fs()
        numbers = self._numbers()
        named = {r["name"] for n in numbers[-self.KEPT :] for r in (self._read_pointer(n) or {"runs": []})["runs"]}
        for n in numbers[: -self.KEPT]:
            for r in (self._read_pointer(n) or {"runs": []})["runs"]:
                if r["name"] not in named:
                    fs.delete(path(f"{self.folder}/{r['name']}"), True)
            fs.delete(path(f"{self.folder}/POINTER-{n:012d}"), False)

    # ---- runs

    def _physical(self, run: dict) -> T.StructType:
        return T.StructType([T.StructField(f"c{k}", T._parse_datatype_string(kind)) for k, kind in run["fields"].items()])

    def _rows_of(self, run: dict, fields: list[dict], files: list[str] | None = None) -> DataFrame:
        """Rows of a run, or of some of its files, under today's names and types, with `_seq`."""
        base = f"{self.folder}/{run['name']}/data"
        if not run["rows"] or files == []:
            stored = self.spark.createDataFrame([], self._physical(run))
        else:
            stored = self.spark.read.schema(self._physical(run)).parquet(*([base] if files is None else [f"{base}/{f}" for f in files]))
        as_now = [(F.col(f"c{f['id']}") if str(f["id"]) in run["fields"] else F.lit(None)).cast(f["type"]).alias(f["name"]) for f in fields]
        return stored.select(*as_now, F.lit(run["seq"]).cast("long").alias("_seq"))

    def _entries_of(self, run: dict) -> DataFrame:
        if not run["keys"]:
            return self.spark.createDataFrame([], self.ENTRIES).withColumn("seq", F.lit(0).cast("long"))
        return self.spark.read.schema(self.ENTRIES).parquet(f"{self.folder}/{run['name']}/keys").withColumn("seq", F.lit(run["seq"]).cast("long"))

    def _union(self, frames: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, frames)

    def _fates(self, entries: DataFrame) -> DataFrame:
        """For each article with entries: the last run that replaced it, its versions since, and its chunks by version and run."""
        per = entries.groupBy("pid", "source").agg(F.max(F.when(F.col("whole"), F.col("seq"))).alias("_replaced"), F.collect_list(F.struct("seq", "date", "chunks", "of")).alias("_e"))  # an entry for each run at most
        own = F.filter("_e", lambda e: (e["seq"] >= F.coalesce("_replaced", F.lit(0))) & e["chunks"].isNotNull())
        per = per.select(F.col("pid").alias("_pid"), F.col("source").alias("_source"), "_replaced", own.alias("_e"))

        def version(date: Column) -> Column:
            same = F.filter("_e", lambda e: e["date"].eqNullSafe(date))
            chunks = F.array_distinct(F.flatten(F.transform(same, lambda e: e["chunks"])))
            return F.struct(date.alias("date"), F.array_max(F.transform(same, lambda e: e["seq"])).alias("seq"), (F.size(chunks) < F.array_max(F.transform(same, lambda e: e["of"]))).alias("open"))

        return per.withColumn("_versions", F.transform(F.array_distinct(F.transform("_e", lambda e: e["date"])), version))

    def _live(self, rows: DataFrame, entries: DataFrame, broadcast: bool, hide: bool = True) -> DataFrame:
        """Rows that no later run has replaced; with hide, also without those of versions that lack chunks."""
        fates = self._fates(entries)
        both = rows.join(F.broadcast(fates) if broadcast else fates, F.col("pid").cast("long").eqNullSafe(F.col("_pid")) & F.col("source").eqNullSafe(F.col("_source")), "left")
        date, seq = F.col("last_modified_date"), F.col("_seq")
        older = F.coalesce(seq < F.col("_replaced"), F.lit(False))
        other = F.exists("_versions", lambda v: ~v["open"] & (v["seq"] > seq) & ~v["date"].eqNullSafe(date))
        again = F.exists("_e", lambda e: (e["seq"] > seq) & e["date"].eqNullSafe(date) & F.array_contains(e["chunks"], F.col("chunk_index")))
        dead = older | F.coalesce(other, F.lit(False)) | F.coalesce(again, F.lit(False))
        if hide:
            dead = dead | F.coalesce(F.exists("_versions", lambda v: v["open"] & v["date"].eqNullSafe(date)), F.lit(False))
        return both.filter(~dead).drop("_pid", "_source", "_replaced", "_e", "_versions")

    def _visible(self, runs: list[dict], fields: list[dict], hide: bool = True) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], T.StructType([*(T.StructField(f["name"], T._parse_datatype_string(f["type"])) for f in fields), T.StructField("_seq", T.LongType())]))
        rows, keys = self._union([self._rows_of(r, fields) for r in runs]), [r for r in runs if r["keys"]]
        return self._live(rows, self._union([self._entries_of(r) for r in keys]), sum(r["keys"] for r in keys) <= self.BROADCAST_KEYS, hide) if keys else rows

    def read(self) -> DataFrame:
        """All whole articles as of now."""
        _, pointer = self._pointer()
        return self._visible(pointer["runs"], pointer["fields"]).drop("_seq")

    # ---- writing

    def _make_run(self, rows: DataFrame, fields: list[dict]) -> dict:
        """Writes sorted rows and the index of their files."""
        run = {"name": f"v-{uuid.uuid4().hex}", "fields": {str(f["id"]): f["type"] for f in fields}, "rows": 0, "keys": 0}
        home = f"{self.folder}/{run['name']}"
        rows.select(*(F.col(f["name"]).cast(f["type"]).alias(f"c{f['id']}") for f in fields)).write.option("compression", "zstd").parquet(f"{home}/data")
        ids = {f["name"]: f"c{f['id']}" for f in fields}
        stored = self.spark.read.schema(self._physical(run)).parquet(f"{home}/data")
        run["rows"] = file_index.write(stored, ids["pid"], ids["name"], f"{home}/files")
        return run

    def _add(self, run: dict) -> None:
        if run["rows"] or run["keys"]:
            self._change(lambda pointer, number: pointer | {"runs": [*pointer["runs"], run | {"seq": number}]})
            while self._merge_alike():
                pass

    def _put(self, incoming: DataFrame, whole: bool) -> None:
        _, pointer = self._pointer()
        fields = pointer["fields"]
        names = [f["name"] for f in fields]
        # dealt once, by pid alone, as a source that is a literal would make Spark deal again by a hash; and sorted once:
        # what follows needs an article's rows together and stays in its task and its order
        dealt = by_range(incoming.select(*names), incoming.count(), "pid").sortWithinPartitions("source", "pid", "chunk_index")
        date = F.coalesce("last_modified_date", F.lit("0001-01-01").cast("timestamp"))
        newest = dealt.withColumn("_newest", F.max(date).over(Window.partitionBy("source", "pid"))).filter(date == F.col("_newest"))
        rows = newest.groupBy("source", "pid", "chunk_index").agg(F.max_by(F.struct(*names), F.struct("content" if "content" in names else "name")).alias("r"))
        rows = rows.select(*(n if n in KEY else F.col(f"r.{n}").alias(n) for n in names)).sortWithinPartitions("source", "pid", "chunk_index")
        run = self._make_run(rows, fields)
        if not run["rows"]:
            return
        stored = self._rows_of(run | {"seq": 0}, fields)
        # by ranges before it is grouped: a task that reads small files together would group the rows of all of them
        dealt = stored.select("pid", "source", "last_modified_date", "chunk_index", "chunk_count").repartitionByRange(-(-run["rows"] // TASK_ROWS), "pid")
        entries = dealt.groupBy("pid", "source", F.col("last_modified_date").alias("date")).agg(F.array_sort(F.collect_set("chunk_index")).alias("chunks"), F.lit(0) if whole else F.max("chunk_count").alias("of"))  # chunks of one article
        keyed = self._make_entries(run, entries.select(F.col("pid").cast("long"), "source", F.lit(whole).alias("whole"), "date", "chunks", F.coalesce(F.col(entries.columns[-1]), F.lit(0)).cast("int").alias("of")))
        self._add(keyed)

    def _make_entries(self, run: dict, entries: DataFrame) -> dict:
        seen = Observation()
        entries.repartitionByRange("pid").sortWithinPartitions("pid", "source").observe(seen, F.count("*").alias("n")).write.option("compression", "zstd").parquet(f"{self.folder}/{run['name']}/keys")
        return run | {"keys": int(seen.get["n"])}

    def upsert(self, incoming: DataFrame) -> None:
        """Puts each incoming article in place of what is stored of it. Of an article that comes in several versions the newest counts."""
        self._put(incoming, True)

    def append(self, pieces: DataFrame) -> None:
        """Adds chunks to their articles' versions. A version is seen once it has as many chunks as chunk_count says; adding a piece again changes nothing.

        Versions count in the order in which they come; of pieces that come late, `without_older` takes out those that a newer version has overtaken.
        """
        self._put(pieces, False)

    def without_older(self, pieces: DataFrame) -> DataFrame:
        """Pieces but those of articles that are stored in a newer version. For a few late pieces, as it looks their articles up."""
        pids = [r[0] for r in pieces.select("pid").distinct().limit(1001).collect()]
        stored = self.articles(pids) if len(pids) <= 1000 else self.read()
        newest = stored.groupBy(F.col("pid").alias("_pid"), F.col("source").alias("_source")).agg(F.max("last_modified_date").alias("_date"))
        late = F.col("pid").eqNullSafe(F.col("_pid")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_date") > F.coalesce("last_modified_date", F.lit("0001-01-01").cast("timestamp")))
        return pieces.join(newest, late, "left_anti")

    def delete(self, keys: DataFrame) -> None:
        """Takes the articles of keys(pid, source) out."""
        gone = keys.select(F.col("pid").cast("long").alias("pid"), "source").distinct()
        none = gone.select("pid", "source", F.lit(True).alias("whole"), F.lit(None).cast("timestamp").alias("date"), F.lit(None).cast("array<int>").alias("chunks"), F.lit(0).alias("of"))
        _, pointer = self._pointer()
        self._add(self._make_entries({"name": f"v-{uuid.uuid4().hex}", "fields": {str(f["id"]): f["type"] for f in pointer["fields"]}, "rows": 0}, none))

    # ---- merging

    def _merge_alike(self) -> bool:
        """Merges the newest runs if FANOUT of them are of one tier of sizes."""
        runs = self._pointer()[1]["runs"]
        tier = [int(math.log(max(r["rows"] + r["keys"], 1), self.FANOUT) + 1e-9) for r in runs]
        alike = 0
        while alike < len(runs) and tier[-1 - alike] <= tier[-1]:
            alike += 1
        return alike >= self.FANOUT and self._merge(len(runs) - alike)

    def compact(self) -> None:
        """Merges all runs into one."""
        if len(self._pointer()[1]["runs"]) > 1:
            self._merge(0)

    def _merge(self, first: int) -> bool:
        """Merges the runs from `first` on; what other writers add meanwhile stays behind it. False if they have merged themselves."""
        _, pointer = self._pointer()
        fields, old = pointer["fields"], pointer["runs"][first:]
        rows = by_range(self._visible(old, fields, hide=False).drop("_seq"), sum(r["rows"] for r in old), "source", "pid").sortWithinPartitions("source", "pid", "chunk_index")
        run = self._make_run(rows, fields)
        keyed = [r for r in old if r["keys"]]
        if keyed:
            fates = self._fates(self._union([self._entries_of(r) for r in keyed]))
            open_ = F.exists("_versions", lambda v: v["open"])
            # what differs in date from two versions differs from any; below the oldest run there is nothing to replace
            whole = F.col("_replaced").isNotNull() | (F.size(F.filter("_versions", lambda v: ~v["open"])) > 1)
            kept = fates.filter(open_) if first == 0 else fates
            # one entry of an article for each version that still counts
            last = F.array_max(F.transform(F.filter("_versions", lambda v: ~v["open"]), lambda v: v["seq"]))
            counted = F.filter("_versions", lambda v: v["open"] | (v["seq"] == F.col("_last")))
            some = kept.withColumn("_last", last).withColumn("_whole", whole).withColumn("_v", F.explode_outer(F.when(F.size(counted) > 0, counted)))
            same = F.filter("_e", lambda e: e["date"].eqNullSafe(F.col("_v.date")))
            chunks = F.when(F.col("_v").isNotNull(), F.array_sort(F.array_distinct(F.flatten(F.transform(same, lambda e: e["chunks"])))))
            of = F.coalesce(F.array_max(F.transform(same, lambda e: e["of"])), F.lit(0))
            entries = some.select(F.col("_pid").alias("pid"), F.col("_source").alias("source"), F.col("_whole").alias("whole"), F.col("_v.date").alias("date"), chunks.alias("chunks"), of.cast("int").alias("of"))
            run = self._make_entries(run, entries)
        names = [r["name"] for r in old]

        def replaced(now: dict, _: int) -> dict | None:
            at = next((k for k, r in enumerate(now["runs"]) if r["name"] == names[0]), None)
            if at is None or [r["name"] for r in now["runs"][at : at + len(names)]] != names:
                return None
            return now | {"runs": [*now["runs"][:at], *([run | {"seq": old[-1]["seq"]}] if run["rows"] or run["keys"] else []), *now["runs"][at + len(names) :]]}

        return self._change(replaced)

    # ---- lookups

    def files_of_title(self, title: str) -> dict[str, list[str]]:
        """Run -> files that may hold the title, by their Bloom filters."""
        return {r["name"]: file_index.with_name(self.spark, f"{self.folder}/{r['name']}/files", title) for r in self._pointer()[1]["runs"] if r["rows"]}

    def retrieve(self, title: str, source: str = "enwiki") -> DataFrame:
        """name, content, chunk_index of the article of that name with the smallest pid, in order. Only files that may hold the title are opened."""
        _, pointer = self._pointer()
        runs, fields = pointer["runs"], pointer["fields"]
        wanted = (F.col("name") == title) & (F.col("source") == source)
        parts = [self._rows_of(r, fields, files).filter(wanted) for r in runs if r["rows"] and (files := file_index.with_name(self.spark, f"{self.folder}/{r['name']}/files", title))]
        if not parts:
            return self._visible([], fields).select("name", "content", "chunk_index")
        rows = self._union(parts)
        pids = [r[0] for r in rows.select("pid").distinct().limit(1001).collect()]  # articles of one name
        keyed = [self._entries_of(r) for r in runs if r["keys"]]
        if keyed:
            entries = self._union(keyed).filter(F.col("source") == source)
            if len(pids) <= 1000:  # read by the files' ranges of pids
                entries = entries.filter(F.col("pid").isin(pids))
            rows = self._live(rows, entries, len(pids) <= 1000)
        least = rows.withColumn("_least", F.min("pid").over(Window.partitionBy("source")))  # chunks of articles of one name
        return least.filter(F.col("pid") == F.col("_least")).orderBy("chunk_index").select("name", "content", "chunk_index")

    def articles(self, pids: list[int]) -> DataFrame:
        """All chunks of some articles; only files whose range of pids holds one of them are opened."""
        _, pointer = self._pointer()
        runs, fields = pointer["runs"], pointer["fields"]
        if not pids:
            return self._visible([], fields).drop("_seq")
        inside = F.col("pid").isin(pids)
        parts = [self._rows_of(r, fields, files).filter(inside) for r in runs if r["rows"] and (files := file_index.with_pids(self.spark, f"{self.folder}/{r['name']}/files", pids))]
        keyed = [self._entries_of(r).filter(inside) for r in runs if r["keys"]]
        rows = self._union(parts) if parts else self._visible([], fields)
        return (self._live(rows, self._union(keyed), True) if keyed else rows).drop("_seq")

    # ---- migrations and size

    def migrate(self, rename: dict[str, str] | None = None, drop: tuple[str, ...] = (), widen: dict[str, str] | None = None, add: dict[str, str] | None = None) -> None:
        """Changes names and types of columns in the pointer only. Added columns are null in older runs; a dropped one does not come back under its name."""
        rename, widen, add = rename or {}, widen or {}, add or {}
        wider = {("int", "bigint"), ("float", "double"), ("int", "double"), ("date", "timestamp"), ("array<float>", "array<double>")}

        def changed(pointer: dict, _: int) -> dict:
            fields = pointer["fields"]
            names = [f["name"] for f in fields]
            if unknown := (set(rename) | set(drop) | set(widen)) - set(names):
                raise ValueError(f"no such columns: {sorted(unknown)}")
            if core := (set(rename) | set(drop)) & set(self.CORE):
                raise ValueError(f"columns that the store needs: {sorted(core)}")
            out = []
            for f in fields:
                to = T._parse_datatype_string(widen[f["name"]]).simpleString() if f["name"] in widen else f["type"]
                if to != f["type"] and (f["type"], to) not in wider:
                    raise ValueError(f"{f['name']}: {f['type']} is not narrower than {to}")
                if f["name"] not in drop:
                    out.append(f | {"name": rename.get(f["name"], f["name"]), "type": to})
            used = max([pointer.get("last_id", 0), *(f["id"] for f in fields)])
            out += [{"id": used + k, "name": n, "type": T._parse_datatype_string(kind).simpleString()} for k, (n, kind) in enumerate(add.items(), 1)]
            if len({f["name"] for f in out}) < len(out):
                raise ValueError("two columns of one name")
            return pointer | {"fields": out, "last_id": used + len(add)}

        self._change(changed)

    def sizes(self) -> list[dict]:
        """name, seq, rows, keys and bytes of each run, oldest first."""
        fs, _, path = self._fs()
        return [{k: r[k] for k in ("name", "seq", "rows", "keys")} | {"bytes": fs.getContentSummary(path(f"{self.folder}/{r['name']}")).getLength()} for r in self._pointer()[1]["runs"]]


def size_by_source(store: DataFrame) -> DataFrame:
    return store.groupBy("source").agg(F.count("*").alias("chunks"), F.countDistinct("pid").alias("articles"))


def in_domain(source: Column) -> Column:
    return source.isNull() | source.isin(*schemas.SOURCES)
