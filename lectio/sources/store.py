"""Versioned storage of an index: segments of Parquet tables, and one pointer to the list of the current ones.

A save writes one segment that holds all; :meth:`IndexStore.append` writes a small one with the changed documents and the
ids that they replace in the segments before, so that a change costs its own size. :meth:`IndexStore.compact` merges the
segments, and :meth:`IndexStore.expire` deletes those that no kept version names. Readers follow the pointer, so they see
a whole version, old or new. ``postings`` carry the length of their document and are sorted by term, so that a look-up of
terms skips row groups and needs no other table; ``docs`` are sorted by id, so that the texts of a few results are found
the same way.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "CURRENT"
#: Segments from which an append merges them all.
MOST_SEGMENTS = 8
#: Versions beside the current one whose segments stay for readers that still use them.
KEPT = 2


def with_lengths(postings: DataFrame, lengths: DataFrame) -> DataFrame:
    """Postings with the length of their document in each row."""
    return postings if "doc_len" in postings.columns else postings.join(lengths, "doc_id").select("term", "doc_id", "tf", "positions", "doc_len")


class IndexStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _held(self) -> dict | None:
        """What the pointer says: segments in order, number and total length of documents, and the versions before."""
        fs, p = self._fs(f"{self.path}/{_POINTER}")
        if not fs.exists(p):
            return None
        found = self.spark.read.text(f"{self.path}/{_POINTER}").first()
        return json.loads(found.value) if found else None

    def current(self) -> str | None:
        """The folder of the latest segment of the current version, or null where nothing was saved."""
        held = self._held()
        return f"{self.path}/{held['segments'][-1]}" if held else None

    def stats(self) -> tuple[int, float]:
        """(documents, average length) of the current version; both are kept beside the pointer."""
        held = self._held()
        return (held["n"], held["length"] / held["n"] if held["n"] else 0.0) if held else (0, 0.0)

    def save(self, tables: dict[str, DataFrame]) -> str:
        """Writes a version of one segment from (docs, postings, lengths) and makes it current; returns its folder."""
        name = self._segment(tables, None)
        n, length = self._sums(self.spark.read.parquet(f"{self.path}/{name}/lengths"))
        self._point([name], n, length)
        return f"{self.path}/{name}"

    def append(self, tables: dict[str, DataFrame], removed: DataFrame) -> str:
        """Adds a segment of changed documents to the current version; ``removed`` (doc_id) are the ids that the segments
        before lose, those of the changed documents among them."""
        held = self._held() or {"segments": [], "n": 0, "length": 0}
        before = self.load() if held["segments"] else None
        name = self._segment(tables, removed)
        n, length = self._sums(self.spark.read.parquet(f"{self.path}/{name}/lengths"))
        if before:
            lost = self._sums(before["lengths"].join(self.spark.read.parquet(f"{self.path}/{name}/removed"), "doc_id", "left_semi"))
            n, length = n + held["n"] - lost[0], length + held["length"] - lost[1]
        self._point([*held["segments"], name], n, length)
        if len(held["segments"]) + 1 >= MOST_SEGMENTS:
            self.compact()
        return f"{self.path}/{name}"

    def compact(self) -> None:
        """Merges the segments of the current version into one and deletes what no kept version needs."""
        held = self.load()
        if held:
            self.save(held)
            self.expire()

    def expire(self, kept: int = KEPT) -> None:
        """Deletes the segments that neither the current version nor the ``kept`` ones before it name."""
        held = self._held()
        if not held:
            return
        used = {*held["segments"], *(s for version in held["before"][:kept] for s in version)}
        fs, p = self._fs(self.path)
        for status in fs.listStatus(p):
            name = status.getPath().getName()
            if name.startswith("s-") and name not in used:
                fs.delete(status.getPath(), True)

    @staticmethod
    def _sums(lengths: DataFrame) -> tuple[int, int]:
        r = lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("length")).first()
        return r.n, r.length

    def _segment(self, tables: dict[str, DataFrame], removed: DataFrame | None) -> str:
        name = f"s-{uuid.uuid4().hex}"
        write = lambda df, table: df.write.option("compression", "zstd").parquet(f"{self.path}/{name}/{table}")
        write(tables["lengths"].select("doc_id", "doc_len"), "lengths")
        lengths = self.spark.read.parquet(f"{self.path}/{name}/lengths")
        write(with_lengths(tables["postings"], lengths).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"), "postings")
        write(tables["docs"].repartitionByRange("doc_id").sortWithinPartitions("doc_id"), "docs")
        if removed is not None:
            write(removed.select("doc_id").distinct(), "removed")
        return name

    def _point(self, segments: list[str], n: int, length: int) -> None:
        held = self._held()
        before = [held["segments"], *held["before"]][: 4 * KEPT] if held else []
        fs, temp = self._fs(f"{self.path}/{_POINTER}.{uuid.uuid4().hex}")
        stream = fs.create(temp)
        stream.write(bytearray(json.dumps({"segments": segments, "n": n, "length": length, "before": before}).encode()))
        stream.close()
        _, target = self._fs(f"{self.path}/{_POINTER}")
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        option = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(temp, target, option)

    def load(self) -> dict[str, DataFrame] | None:
        """The tables docs, postings, lengths and stats of the current version, or null."""
        held = self._held()
        if not held:
            return None
        out: dict[str, DataFrame] = {}
        gone = None
        for name in reversed(held["segments"]):
            folder = f"{self.path}/{name}"
            for table in ("docs", "postings", "lengths"):
                part = self.spark.read.parquet(f"{folder}/{table}")
                part = part if gone is None else part.join(gone, "doc_id", "left_anti").select(*part.columns)
                out[table] = part if table not in out else part.unionByName(out[table])
            if name != held["segments"][0]:
                removed = self.spark.read.parquet(f"{folder}/removed")
                gone = removed if gone is None else gone.union(removed)
        n, length = held["n"], held["length"]
        out["stats"] = self.spark.createDataFrame([(n, length / n if n else 0.0)], "n long, avgdl double")
        return out


def read_legacy(spark: SparkSession, folder: str) -> dict[str, DataFrame] | None:
    """An index in four JSON files (index, documents, doc_lengths, doc_contents) as tables; null where one is missing."""
    names = {"index": "map<string,array<struct<docId:string,termFrequency:int,positions:array<int>>>>", "doc_lengths": "map<string,int>", "doc_contents": "map<string,string>"}
    names["documents"] = "map<string,struct<Id:string,Title:string,Url:string,ContentType:int,Path:string>>"
    frames = {}
    for name, kind in names.items():
        path = f"{folder}/{name}.json"
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return None
        frames[name] = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    postings = frames["index"].select(F.explode("m").alias("term", "list")).select("term", F.explode("list").alias("p"))
    types = F.element_at(F.array(F.lit("Pdf"), F.lit("Markdown"), F.lit("Html")), F.col("d.ContentType") + 1)
    docs = frames["documents"].select(F.explode("m").alias("doc_id", "d")).select("doc_id", F.col("d.Title").alias("title"), F.col("d.Url").alias("url"), F.col("d.Path").alias("path"), types.alias("content_type"))
    contents = frames["doc_contents"].select(F.explode("m").alias("doc_id", "content"))
    return {
        "postings": postings.select("term", F.col("p.docId").alias("doc_id"), F.col("p.termFrequency").alias("tf"), F.sort_array("p.positions").alias("positions")),
        "docs": docs.join(contents, "doc_id", "left").withColumn("last_indexed_at", F.lit(None).cast("timestamp")),
        "lengths": frames["doc_lengths"].select(F.explode("m").alias("doc_id", "doc_len")),
    }
