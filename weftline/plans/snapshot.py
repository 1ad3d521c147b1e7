"""Versioned tables with file-scoped, atomic replacement.

Tables are dealt into buckets by the hash of the owning file, each bucket a folder of
Parquet.  A version is a manifest that names the folder of every bucket; ``_CURRENT`` names
the version that counts.  A change rewrites only the buckets of the files it touches into
new folders, writes a new manifest and then replaces the pointer in one step through
Hadoop's file system, so readers see the old or the new state and a failed write leaves the
old one.  Postings of the text index are dealt by the hash of the token instead: a change
adds a generation of postings, rows of earlier generations count only while the node's
length row names their generation, and generations are merged when there are many.  Old
folders stay until ``vacuum``.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.lineage import settle
from weftline.operators import search
from weftline.schema import EDGES, FILE_HASHES, LENGTHS, NODES, POSTINGS

TABLES = {"nodes": NODES, "edges": EDGES, "file_hashes": FILE_HASHES}
#: Buckets of a new store, and generations of postings after which they are merged.
BUCKETS, GENERATIONS = 16, 12
#: Keys (names of files, ids of nodes) that may be broadcast, and those that tasks may hold in hash tables, all together; more are met by sorting.
KEYS_SENT, KEYS_HASHED = 50_000, 50_000_000
SEARCHED = ("id", "signature", "docstring")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, that with the greatest order: an insert-or-replace of a batch."""
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("r"))
    return newest.select("r.*")


def listed(keys: DataFrame) -> DataFrame:
    """keys, each once, in the form in which tables meet them by an anti or semi join: few are sent to the rows, which then are not dealt (one file may own most of them); more are held in hash tables, so that the rows need no sort."""
    keys = settle(keys.distinct())
    n = keys.count()
    return F.broadcast(keys) if n <= KEYS_SENT else keys.hint("shuffle_hash") if n <= KEYS_HASHED else keys


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """old with the rows of new, which replace those with their key."""
    newest = last_wins(new, [key], order).drop(order) if order else new
    return old.join(listed(newest.select(key)), key, "left_anti").unionByName(newest, allowMissingColumns=True)


def with_defaults(edges: DataFrame) -> DataFrame:
    """edges to append, with confidence 1, weight 1 and no scope, detail or file where they are missing."""
    none = F.lit(None).cast("string")
    for name, value in (("confidence", F.lit(1.0)), ("weight", F.lit(1)), ("scope", none), ("detail", none), ("file", none)):
        edges = edges.withColumn(name, F.coalesce(F.col(name), value) if name in edges.columns else value)
    return edges


def without_files(nodes: DataFrame, edges: DataFrame, hashes: DataFrame, files: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without what the files (column file) produced.

    Edges go with the file that owns them.  With ``compat`` they go instead by the ids of the
    files' nodes at either end, whoever owns them, and edges of module ids stay.
    """
    names = listed(files.select("file"))
    if compat:
        gone = listed(nodes.join(names, "file", "left_semi").select("id"))
        kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns)
    else:
        kept = edges.join(names, "file", "left_anti").select(*edges.columns)
    drop = lambda df: df.join(names, "file", "left_anti").select(*df.columns)
    return drop(nodes), kept, drop(hashes)


def replace_files(old: tuple[DataFrame, DataFrame, DataFrame], new: tuple[DataFrame, DataFrame, DataFrame], compat: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, file_hashes) after the files of new's hashes are replaced by what new holds; ids that collide across files keep the newest row."""
    nodes, edges, hashes = without_files(*old, files=new[2], compat=compat)
    fresh = new[0].dropDuplicates(["id"]) if "seq" not in new[0].columns else last_wins(new[0], ["id"], "seq").drop("seq")
    nodes = upsert(nodes, fresh, "id")
    return nodes, edges.unionByName(new[1]), hashes.unionByName(new[2])


class Store:
    """The current snapshot in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self.version() is None:
            self._commit(self._fresh(), {"buckets": buckets, "postings": [], **{name: {} for name in (*TABLES, "lengths")}})

    # --- files ----------------------------------------------------------------------------

    def _text(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._files.exists(path):
            return None
        stream = self._files.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        stream = self._files.create(self._path(f"{self.root}/{name}"), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def _folders(self, name: str) -> list[str]:
        path = self._path(f"{self.root}/{name}")
        return [s.getPath().getName() for s in self._files.listStatus(path) if s.isDirectory()] if self._files.exists(path) else []

    @staticmethod
    def _fresh() -> str:
        return f"v{time.time_ns()}-{uuid.uuid4().hex[:8]}"

    def _commit(self, version: str, manifest: dict) -> str:
        """Makes a version current, once all that its manifest names is written."""
        self._put(f"{version}/manifest.json", json.dumps(manifest))
        self._put(f"_CURRENT.{version}", version)
        jvm = self.spark.sparkContext._jvm
        fresh = self._path(f"{self.root}/_CURRENT.{version}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fresh, self._path(f"{self.root}/_CURRENT"), options)
        return version

    # --- reading --------------------------------------------------------------------------

    def version(self) -> str | None:
        return self._text("_CURRENT")

    def manifest(self) -> dict:
        return json.loads(self._text(f"{self.version()}/manifest.json"))

    def _load(self, folders: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def read(self, name: str, manifest: dict | None = None, buckets: set[int] | None = None) -> DataFrame:
        """A table of the current version (of some buckets)."""
        held = (manifest or self.manifest())[name]
        schema = LENGTHS if name == "lengths" else TABLES[name]
        return self._load([f for b, f in sorted(held.items()) if buckets is None or int(b) in buckets], schema)

    def tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return tuple(self.read(name) for name in TABLES)

    def file_hash(self, file: str) -> str | None:
        """The stored hash of one file, from its bucket alone."""
        manifest = self.manifest()
        bucket = self.spark.range(1).select(_bucket(F.lit(file), manifest["buckets"])).first()[0]
        row = self.read("file_hashes", manifest, {bucket}).where(F.col("file") == file).first()
        return row["sha256"] if row else None

    def postings(self, tokens: list[str]) -> DataFrame:
        """Postings of some tokens, from the partitions of their hashes alone; those of replaced nodes are still among them."""
        manifest = self.manifest()
        wanted = {r[0] for r in self.spark.createDataFrame([(t,) for t in tokens], "token string").select(_bucket(F.col("token"), manifest["buckets"])).collect()} if tokens else set()
        folders = [f"{g['folder']}/bucket={b}" for g in manifest["postings"] for b in g["buckets"] if b in wanted]
        return self._load(folders, POSTINGS).where(F.col("token").isin(tokens))

    def search(self, query: str, kinds: list[str] | None = None, limit: int = 10) -> DataFrame:
        """The best nodes by the stored index, as search.search gives them."""
        parts = search.phrases(query)
        found = search.score_postings(self.postings(sorted({t for p in parts for t in p})), self.read("lengths"), parts)
        return search.best(found, self.read("nodes"), kinds, limit)

    # --- writing --------------------------------------------------------------------------

    @staticmethod
    def _together(*acts) -> None:
        """Runs acts in threads of the driver; the first error is raised once all have ended."""
        with ThreadPoolExecutor(len(acts)) as pool:
            for done in [pool.submit(act) for act in acts]:
                done.result()

    @staticmethod
    def _dealt(rows: DataFrame, key: str, manifest: dict) -> DataFrame:
        """rows with their bucket, by which they are dealt; the large buckets of a store are written by several tasks."""
        return rows.withColumn("bucket", _bucket(F.col(key), manifest["buckets"])).hint("rebalance", "bucket")

    def _write(self, version: str, name: str, rows: DataFrame, touched: set[int], manifest: dict) -> None:
        """Puts rows, which are all of the touched buckets, into new folders of a manifest to be."""
        self._dealt(rows, "file", manifest).write.partitionBy("bucket").parquet(f"{self.root}/{version}/{name}")
        made = {int(f.partition("=")[2]): f"{version}/{name}/{f}" for f in self._folders(f"{version}/{name}") if f.startswith("bucket=")}
        manifest[name] = {b: f for b, f in manifest[name].items() if int(b) not in touched} | {str(b): f for b, f in made.items()}

    def _index(self, version: str, nodes: DataFrame, manifest: dict) -> None:
        """Adds a generation of postings of the nodes."""
        gen = int(version[1:].partition("-")[0])
        rows = search.postings(nodes, "id", list(SEARCHED), gen)
        self._dealt(rows, "token", manifest).write.partitionBy("bucket").parquet(f"{self.root}/{version}/postings")
        made = [int(f.partition("=")[2]) for f in self._folders(f"{version}/postings") if f.startswith("bucket=")]
        manifest["postings"] = [*manifest["postings"], {"folder": f"{version}/postings", "buckets": made}] if made else manifest["postings"]

    def _merge(self, version: str, manifest: dict, lengths: DataFrame) -> None:
        """One folder of postings in place of many generations, without rows of replaced nodes."""
        folders = [f"{g['folder']}/bucket={b}" for g in manifest["postings"] for b in g["buckets"]]
        live = self._load(folders, POSTINGS).join(lengths.select("id", "gen"), ["id", "gen"]).select(*POSTINGS.names)
        self._dealt(live, "token", manifest).write.partitionBy("bucket").parquet(f"{self.root}/{version}/merged")
        made = [int(f.partition("=")[2]) for f in self._folders(f"{version}/merged") if f.startswith("bucket=")]
        manifest["postings"] = [{"folder": f"{version}/merged", "buckets": made}]

    def _change(self, nodes: DataFrame, edges: DataFrame, hashes: DataFrame, gone: DataFrame, compat: bool) -> str:
        """A version in which the files of ``gone`` have what the given rows hold."""
        manifest, version = self.manifest(), self._fresh()
        n = manifest["buckets"]
        touched = {r[0] for r in gone.select(_bucket(F.col("file"), n)).distinct().collect()}
        # Ids that collide across files keep the newest row: buckets of other files that have one are rewritten too.
        others = {int(b) for b in manifest["nodes"]} - touched
        if others:
            clash = self.read("nodes", manifest, others).select("id", "file").join(nodes.select("id").distinct(), "id")
            touched |= {r[0] for r in clash.select(_bucket(F.col("file"), n)).distinct().collect()}
        every = set(range(n)) if compat else touched
        old = (self.read("nodes", manifest, touched), self.read("edges", manifest, every), self.read("file_hashes", manifest, touched))
        kept_nodes, kept_edges, kept_hashes = without_files(*old, files=gone, compat=compat)
        fresh = nodes.dropDuplicates(["id"]) if "seq" not in nodes.columns else last_wins(nodes, ["id"], "seq").drop("seq")
        rows = {"nodes": upsert(kept_nodes, fresh, "id"), "edges": kept_edges.unionByName(edges), "file_hashes": kept_hashes.unionByName(hashes)}
        gen = int(version[1:].partition("-")[0])
        # Small jobs of independent tables run beside each other.
        self._together(*(lambda n=name, s=schema: self._write(version, n, rows[n].select(*s.names), every if n == "edges" else touched, manifest) for name, schema in TABLES.items()))
        written = self.read("nodes", manifest, touched)
        added = written.join(gone.select("file"), "file", "left_semi")
        lengths = self.read("lengths", manifest, touched).join(written.select("id", "file"), ["id", "file"], "left_semi").join(gone.select("file"), "file", "left_anti")
        lengths = lengths.unionByName(search.lengths(added, "id", list(SEARCHED), gen)).select(*LENGTHS.names)
        self._together(lambda: self._index(version, added, manifest), lambda: self._write(version, "lengths", lengths, touched, manifest))
        if len(manifest["postings"]) > GENERATIONS:
            self._merge(version, manifest, self.read("lengths", manifest))
        return self._commit(version, manifest)

    def write(self, tables: dict[str, DataFrame]) -> str:
        """A new snapshot of whole tables, current only once all of them are written."""
        manifest, version = self.manifest(), self._fresh()
        every, gen = set(range(manifest["buckets"])), int(version[1:].partition("-")[0])
        for name, schema in TABLES.items():
            self._write(version, name, tables[name].select(*schema.names), every, manifest)
        nodes = self.read("nodes", manifest)
        manifest["postings"] = []
        self._index(version, nodes, manifest)
        self._write(version, "lengths", search.lengths(nodes, "id", list(SEARCHED), gen).select(*LENGTHS.names), every, manifest)
        return self._commit(version, manifest)

    def replace(self, nodes: DataFrame, edges: DataFrame, hashes: DataFrame, compat: bool = False) -> str:
        return self._change(nodes, edges, hashes, hashes.select("file").distinct(), compat)

    def next_edge(self) -> int:
        """An edge_id above all that the store has."""
        return (self.read("edges").agg(F.max("edge_id")).first()[0] or 0) + 1

    def insert_edges(self, edges: DataFrame, *order: str) -> str:
        """Appends edges (src, dst, kind and what else they have) after all others, in the given order; nothing is replaced.  Only the buckets of their files are rewritten."""
        from weftline.functions.lineage import indexed

        start = self.next_edge()
        rows = indexed(with_defaults(edges), "edge_id", *(order or ("file", "src", "dst", "kind"))).withColumn("edge_id", F.col("edge_id") + start)
        manifest, version = self.manifest(), self._fresh()
        touched = {r[0] for r in rows.select(_bucket(F.col("file"), manifest["buckets"])).distinct().collect()}
        self._write(version, "edges", self.read("edges", manifest, touched).unionByName(rows.select(*EDGES.names)), touched, manifest)
        return self._commit(version, manifest)

    def upsert_nodes(self, nodes: DataFrame, order: str | None = None) -> str:
        """Inserts nodes or replaces those with their id, wherever they are; of equal ids in a batch the last by ``order`` counts."""
        fresh = last_wins(nodes, ["id"], order).drop(order) if order else nodes.dropDuplicates(["id"])
        all_ = upsert(self.read("nodes"), fresh.select(*NODES.names), "id")
        return self.write({"nodes": all_, "edges": self.read("edges"), "file_hashes": self.read("file_hashes")})

    def set_file_hash(self, file: str, sha256: str, indexed_at: int) -> str:
        """Puts one file's hash in place of the one before."""
        manifest, version = self.manifest(), self._fresh()
        row = self.spark.createDataFrame([(file, sha256, indexed_at)], FILE_HASHES)
        touched = {row.select(_bucket(F.col("file"), manifest["buckets"])).first()[0]}
        self._write(version, "file_hashes", upsert(self.read("file_hashes", manifest, touched), row, "file"), touched, manifest)
        return self._commit(version, manifest)

    def delete(self, files: list[str], compat: bool = False) -> str:
        none = {name: self.spark.createDataFrame([], schema) for name, schema in TABLES.items()}
        return self._change(none["nodes"], none["edges"], none["file_hashes"], self.spark.createDataFrame([(f,) for f in files], "file string"), compat)

    def vacuum(self) -> int:
        """Removes all versions but the current one, and what it does not use of their buckets; returns how many versions."""
        current, manifest, n = self.version(), self.manifest(), 0
        used = {f for name in (*TABLES, "lengths") for f in manifest[name].values()} | {f"{g['folder']}/bucket={b}" for g in manifest["postings"] for b in g["buckets"]}
        for version in (v for v in self._folders("") if v.startswith("v")):
            n += version != current and self._files.delete(self._path(f"{self.root}/{version}/manifest.json"), False)
            for table in self._folders(version):
                for bucket in self._folders(f"{version}/{table}"):
                    if f"{version}/{table}/{bucket}" not in used:
                        self._files.delete(self._path(f"{self.root}/{version}/{table}/{bucket}"), True)
            if version != current and not any(f.startswith(f"{version}/") for f in used):
                self._files.delete(self._path(f"{self.root}/{version}"), True)
        return n

    def close(self) -> None:
        self.spark.catalog.clearCache()


def _bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
