"""A versioned store on any Hadoop file system: immutable Parquet batches and a manifest for each generation.

A batch becomes visible only with the manifest that names it. A manifest is made for the generation after the one
its writer has read; it is written under another name and put in place finished, by a step that fails if the generation is
there already. So of two writers that start from one generation the later one fails, no batch is lost, and nobody
ever reads half a manifest. Rows and tombstones carry the generation that wrote them: a tombstone hides older rows only.
Higher tokens fence off lower ones.

Appending reads nothing but its own batch. Merging rewrites the segments that it picks: their rows keep their generations,
all other segments their names, and of the tombstones those stay that still hide a row there. The manifest has a
fingerprint of each segment, by which segments and exported copies are verified.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import feeds

GENERATION = "__generation"
#: Seconds for which files that no manifest names are kept: a writer may be about to publish them, a reader to read them.
RETENTION_S = 24 * 3600
NOTHING = {"n": 0, "xor": 0, "sum": 0}


class StaleBase(RuntimeError):
    """Another writer has published meanwhile; read again and retry."""


class Damaged(ValueError):
    """Rows are not those that were written."""


def _marks(rows: DataFrame) -> list:
    own = [F.col(c) for c in sorted(rows.columns)]
    h = F.xxhash64(*own, *(c.isNull() for c in own))
    return [F.count("*").alias("n"), F.bit_xor(h).alias("xor"), F.sum(F.pmod(h, F.lit(2_147_483_647))).alias("sum")]


def fingerprint(rows: DataFrame) -> dict:
    """Count, exclusive or and sum of the rows' hashes: the same for any order and partition of the rows, and
    `merged` from the fingerprints of their parts.
    """
    return {k: v or 0 for k, v in rows.agg(*_marks(rows)).first().asDict().items()}


def merged(parts: Iterable[dict]) -> dict:
    out = dict(NOTHING)
    for p in parts:
        out = {"n": out["n"] + p["n"], "xor": out["xor"] ^ p["xor"], "sum": out["sum"] + p["sum"]}
    return out


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _files(self, folder: str) -> dict[str, float]:
        """Names under a folder and when each was last changed, in seconds."""
        at = self._path(f"{self.root}/{folder}")
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in self._fs.listStatus(at)} if self._fs.exists(at) else {}

    def _json(self, name: str) -> dict | None:
        """A file's JSON object; None if it isn't one, as where another program was cut off."""
        stream = self._fs.open(self._path(name))
        try:
            raw = bytes(stream.readAllBytes())
        finally:
            stream.close()
        try:
            found = json.loads(raw)
        except ValueError:
            return None
        return found if isinstance(found, dict) else None

    def _put(self, name: str, value: dict) -> None:
        """Write a file under another name, then put it in place, at once and only if the name is free."""
        last = self._path(name)
        held = self._path(last.getParent(), f".{uuid.uuid4().hex}.part")
        out = self._fs.create(held, False)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()
        try:
            if self._fs.getScheme() == "file":  # a local rename would replace; a link to the finished file can't
                files, paths = self._jvm.java.nio.file.Files, self._jvm.java.io.File
                files.createLink(paths(last.toUri().getPath()).toPath(), paths(held.toUri().getPath()).toPath())
            else:
                none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = none
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(last.toUri(), self._conf).rename(held, last, options)
        except Exception as e:
            if self._fs.exists(last):
                raise StaleBase(f"{last.getName()} exists") from e
            raise
        finally:
            self._fs.delete(held, False)

    def latest(self) -> dict | None:
        """The manifest of the highest generation that can be read."""
        for name in sorted((n for n in self._files("manifests") if n.endswith(".json") and not n.startswith(".")), reverse=True):
            if found := self._json(f"{self.root}/manifests/{name}"):
                return found
        return None

    def base(self, token: int) -> dict:
        """The generation that a writer starts from; an error if a higher token holds the store."""
        now = self.latest() or {"token": 0, "generation": 0, "segments": [], "deleted": []}
        if token < now["token"]:
            raise RuntimeError(f"token {token} is fenced off by {now['token']}")
        return now

    def commit(self, token: int, base: dict, segments: list[dict], deleted: list[str]) -> dict:
        """Publish the generation after `base`; StaleBase if that has been published already."""
        self.base(token)
        new = {"token": token, "generation": base["generation"] + 1, "segments": segments, "deleted": deleted}
        name = f"{self.root}/manifests/{new['generation']:020d}.json"
        if self._fs.exists(self._path(name)) and self._json(name) is None:
            self._fs.delete(self._path(name), False)  # a rest that was never a manifest
        self._put(name, new)
        return new

    def _write(self, rows: DataFrame, folder: str, base: dict, analyzer: str | None = None):
        """A new folder of rows; those without a generation get the one after `base`. Segments are read back for their
        fingerprint.
        """
        name = f"{folder[:3]}-{uuid.uuid4().hex}"
        rows = rows if GENERATION in rows.columns else rows.withColumn(GENERATION, F.lit(base["generation"] + 1))
        rows.write.parquet(f"{self.root}/{folder}/{name}")
        if folder == "deleted":
            return name
        mark = fingerprint(self.spark.read.schema(rows.schema).parquet(f"{self.root}/{folder}/{name}"))
        return {"name": name, "at": time.time(), "analyzer": analyzer, "fingerprint": mark}

    def append(self, rows: DataFrame, token: int, order: Sequence[str] = (), same: str | None = None, analyzer: str | None = None) -> dict:
        """Flush a batch as one segment and publish it; its rows replace live ones of the same id.

        Of rows that share an id the last by `order` stays, ties by all columns' hash. With `same`, the column that
        tells contents apart, rows whose live row has an equal value are left out: they change nothing. A row
        without an id is an error.
        """
        base = self.base(token)
        have = F.when(F.col("id").isNull(), F.raise_error(F.lit("a row lacks its id"))).otherwise(F.col("id"))
        last = Window.partitionBy("id").orderBy(*(F.col(c).desc_nulls_last() for c in order), F.desc(F.xxhash64(*sorted(rows.columns))))
        rows = rows.withColumn("id", have).withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
        if same is not None and base["segments"]:
            live = self._rows(base, ["id", same]).select("id", F.col(same).alias("__same"), F.lit(True).alias("__live"))
            rows = rows.join(live, "id", "left").where(F.col("__live").isNull() | ~F.col(same).eqNullSafe(F.col("__same"))).select(*rows.columns)
        segment = self._write(rows, "segments", base, analyzer)
        if not segment["fingerprint"]["n"] and base["segments"]:
            return base
        deleted = base["deleted"]
        if base["segments"]:
            # they hide older generations only, so which of these ids the store knows needs no look
            own = self.spark.read.parquet(f"{self.root}/segments/{segment['name']}").select("id")
            deleted = [*deleted, self._write(own, "deleted", base)]
        return self.commit(token, base, [*base["segments"], segment], deleted)

    def delete(self, ids: DataFrame, token: int) -> dict:
        """Publish a batch of tombstones; rows that come later under these ids are visible."""
        base = self.base(token)
        return self.commit(token, base, base["segments"], [*base["deleted"], self._write(ids.select("id").distinct(), "deleted", base)])

    def _stored(self, segments: Sequence[dict]) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(*(f"{self.root}/segments/{s['name']}" for s in segments))

    def _gone(self, at: dict) -> DataFrame:
        """(id, generation) of the latest tombstone of each id."""
        return self.spark.read.parquet(*(f"{self.root}/deleted/{s}" for s in at["deleted"])).groupBy("id").agg(F.max(GENERATION).alias(GENERATION))

    def _rows(self, at: dict, columns: Sequence[str] | None = None) -> DataFrame:
        rows = self._stored(at["segments"])
        rows = rows.select(*columns, GENERATION) if columns else rows
        return feeds.visible(rows, self._gone(at), "id", GENERATION) if at["deleted"] else rows

    def read(self) -> DataFrame | None:
        """Live rows of the latest generation."""
        now = self.latest()
        return self._rows(now).drop(GENERATION) if now and now["segments"] else None

    def segment_stats(self, at: dict, min_age_s: float = 0) -> DataFrame:
        """(segment, n, dead, old) of a generation's segments: rows, those that a tombstone hides, and whether they are old."""
        dead = {}
        if at["deleted"] and at["segments"]:
            rows = self._stored(at["segments"]).select("id", GENERATION, F.regexp_extract("_metadata.file_path", r"/segments/([^/]+)/", 1).alias("segment"))
            gone = self._gone(at).withColumnRenamed(GENERATION, "__gone")
            hidden = rows.join(gone, "id").where(F.col("__gone") > F.col(GENERATION)).groupBy("segment").count()
            dead = {r["segment"]: r["count"] for r in hidden.collect()}  # a row for each segment
        now = time.time()
        stats = [(s["name"], s["fingerprint"]["n"], dead.get(s["name"], 0), now - s["at"] >= min_age_s) for s in at["segments"]]
        return self.spark.createDataFrame(stats, "segment string, n long, dead long, old boolean")

    def merge(self, token: int, most: int = 8, dead_ratio: float = 0.25, min_age_s: float = 0) -> dict:
        """Rewrite the segments that `feeds.merge_inputs` picks as one; nothing is published if it picks none."""
        base = self.base(token)
        picked = {r.segment for r in feeds.merge_inputs(self.segment_stats(base, min_age_s), most, dead_ratio).collect()}
        return self._replace(base, token, picked) if picked else base

    def rewrite(self, token: int, analyzer: str, make: Callable[[DataFrame], DataFrame]) -> dict:
        """Rewrite the segments that are not of this analyzer's version through `make`, which keeps ids and generations."""
        base = self.base(token)
        picked = {s["name"] for s in base["segments"] if s["analyzer"] != analyzer}
        return self._replace(base, token, picked, make, analyzer) if picked else base

    def compact(self, token: int) -> dict:
        """Rewrite the live rows as one segment without tombstones."""
        base = self.base(token)
        return self._replace(base, token, {s["name"] for s in base["segments"]})

    def _replace(self, base: dict, token: int, picked: set[str], make: Callable[[DataFrame], DataFrame] = lambda rows: rows, analyzer: str | None = None) -> dict:
        """One segment for the live rows of the picked ones; the others stay, and the tombstones that they still need."""
        inputs, rest = ([s for s in base["segments"] if (s["name"] in picked) is x] for x in (True, False))
        segments, deleted = list(rest), []
        if inputs:
            versions = {s["analyzer"] for s in inputs}
            new = self._write(make(self._rows({**base, "segments": inputs})), "segments", base, analyzer or (versions.pop() if len(versions) == 1 else None))
            segments += [new] if new["fingerprint"]["n"] else []
        if base["deleted"] and rest:
            gone, kept = self._gone(base), self._stored(rest).select("id", F.col(GENERATION).alias("__row"))
            needed = gone.join(kept.groupBy("id").agg(F.min("__row").alias("__row")), "id").where(F.col("__row") < F.col(GENERATION)).select("id", GENERATION)
            carried = self._write(needed, "deleted", base)
            if not self.spark.read.schema(needed.schema).parquet(f"{self.root}/deleted/{carried}").isEmpty():
                deleted = [carried]
        return self.commit(token, base, segments, deleted)

    def verify(self) -> list[str]:
        """Names of the latest generation's segments whose rows are not those of their fingerprint."""
        now = self.latest() or {"segments": []}
        bad = []
        for s in now["segments"]:  # one after the other, each a job of its own
            at = f"{self.root}/segments/{s['name']}"
            if not self._fs.exists(self._path(at)) or fingerprint(self.spark.read.parquet(at)) != s["fingerprint"]:
                bad.append(s["name"])
        return bad

    def garbage(self, retention_s: float = RETENTION_S) -> list[str]:
        """Segments, tombstones and manifests that the latest generation doesn't need, and not written lately."""
        now = self.latest() or {"generation": 0, "segments": [], "deleted": []}
        own = {*(s["name"] for s in now["segments"]), *now["deleted"], f"{now['generation']:020d}.json"}
        old = time.time() - retention_s
        return [f"{folder}/{n}" for folder in ("segments", "deleted", "manifests") for n, at in sorted(self._files(folder).items()) if n not in own and not n.endswith(".crc") and at <= old]

    def collect_garbage(self, retention_s: float = RETENTION_S) -> int:
        found = self.garbage(retention_s)
        for name in found:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
        return len(found)

    def export_to(self, folder: str) -> dict:
        """The live rows of one generation under `folder`, and a manifest with their fingerprint, written last."""
        now = self.latest()
        if not now or not now["segments"]:
            raise RuntimeError("nothing to export")
        rows = self._rows(now).drop(GENERATION)
        rows.write.parquet(f"{folder}/rows")
        made = {"generation": now["generation"], "columns": sorted(rows.columns), "fingerprint": fingerprint(rows)}
        if fingerprint(self.spark.read.parquet(f"{folder}/rows")) != made["fingerprint"]:
            raise Damaged("the copy is not what was exported")
        self._put(f"{folder}/manifest.json", made)
        return made

    def import_from(self, folder: str, token: int) -> dict:
        """Take over an exported copy once its rows are known to be those exported, their ids distinct and present."""
        if not self._fs.exists(self._path(f"{folder}/manifest.json")):
            raise Damaged("the copy has no manifest")
        made, rows = self._json(f"{folder}/manifest.json"), self.spark.read.parquet(f"{folder}/rows")
        if not made or made["columns"] != sorted(rows.columns) or made["fingerprint"] != fingerprint(rows):
            raise Damaged("the copy's rows are not those of its manifest")
        bad = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL").limit(1).count()
        if bad:
            raise Damaged("the copy repeats ids or lacks one")
        return self.append(rows, token)


def missing_embeddings(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """(key, text): distinct texts that the cache (key) lacks; keys hash the model and the text."""
    key = F.substring(F.sha2(F.concat(F.lit(model + "\0"), F.col("text")), 256), 1, 32)
    return texts.select(key.alias("key"), "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON value a line; fields of a wrong type are null."""
    return spark.read.schema(schema).json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_grades(spark: SparkSession, path: str) -> DataFrame:
    """Hand grades: a CSV with a header of five columns."""
    return spark.read.csv(path, header=True, schema="query string, text string, memory string, memory_text string, grade int")


def write_grades(rows: DataFrame, path: str) -> None:
    rows.select("query", "text", "memory", "memory_text", "grade").write.mode("overwrite").csv(path, header=True, quoteAll=True)
