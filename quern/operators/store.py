"""Named indexes as versioned Parquet datasets.

A write goes to a new folder and counts only when its manifest is there, so a lost write leaves the version before it in
place.  Data is never changed where it lies.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import integrity, navigation, search
from .dedup import first_of, merge_hashes
from .folder import Folder

_MANIFEST = re.compile(r"manifest-(\d+)\.json")
TABLES = ("documents", "chunks", "hashes")


class Locked(RuntimeError):
    pass


class Unsupported(RuntimeError):
    pass


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to make."""


def dense_ids(items: DataFrame, key: str, count: str, base: int, buckets: int = 64, sample: int = 10_000) -> DataFrame:
    """``items`` with ``_first``, the first of ``count`` successive ids of each, from ``base`` in the order of the unique ``key``.

    Keys are cut into ranges of about a million, at least ``buckets``, at fixed bounds taken from about ``sample`` keys chosen
    by hash, so that a lost task falls into the same range again; totals of the ranges are summed first, and no window holds
    more than one range.
    """
    n = items.count()
    buckets, sample = max(buckets, n // 1_000_000), max(sample, 10 * (n // 1_000_000))
    share = max(1, n // sample)  # of the keys, by hash: about ``sample`` of them whatever the number
    seen = sorted(r[0] for r in items.select(key).where(F.pmod(F.xxhash64(key), F.lit(share)) == 0).collect())
    bounds = sorted({seen[i * len(seen) // buckets] for i in range(1, buckets)}) if seen else []
    part = F.size(F.filter(F.lit(bounds), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    ranged = items.withColumn("_part", part)
    totals = ranged.groupBy("_part").agg(F.sum(count).alias("_s"))
    before = totals.withColumn("_off", F.sum("_s").over(Window.orderBy("_part")) - F.col("_s")).select("_part", "_off")
    inside = F.sum(count).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) - F.col(count)
    return ranged.withColumn("_in", inside).join(before, "_part").withColumn("_first", F.lit(base) + F.col("_off") + F.col("_in")).drop("_part", "_off", "_in")


def number_documents(documents: DataFrame, base: int) -> DataFrame:
    """Documents with new ids from ``base`` in the order of their sources."""
    one = documents.drop("doc_id").withColumn("_one", F.lit(1))
    ids = dense_ids(one.select("source", "_one").distinct(), "source", "_one", base).select("source", F.col("_first").alias("doc_id"))
    return one.drop("_one").join(ids, "source")


def number_chunks(chunks: DataFrame, base: int, order: tuple[str, ...]) -> DataFrame:
    """Chunks with new ids from ``base``, source by source, within a source by ``order``."""
    first = dense_ids(chunks.groupBy("source").agg(F.count("*").alias("_n")), "source", "_n", base)
    rank = F.row_number().over(Window.partitionBy("source").orderBy(*[o for o in order if o != "source"])) - 1
    numbered = chunks.drop("id").withColumn("_r", rank).join(first.select("source", "_first"), "source")
    return numbered.withColumn("id", F.col("_first") + F.col("_r")).drop("_r", "_first")


def add_source(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of an old layout with the column ``source`` filled from their documents, '' where there is none."""
    if "source" in chunks.columns:
        return chunks
    docs = documents.select("doc_id", "source")
    return chunks.join(docs, "doc_id", "left").withColumn("source", F.coalesce("source", F.lit("")))


def ignore_known(new: DataFrame, known: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """The rows of ``new`` whose ``on`` is not in ``known``, the first of each by ``order``: insert or ignore."""
    fresh = new.join(known.select(*on).distinct(), on, "left_anti")
    return first_of(fresh.select(*new.columns), on, order)


def split_by_source(rows: DataFrame, sources: DataFrame, *, on: list[str], documents: DataFrame | None = None, column: str = "source") -> DataFrame:
    """``rows`` with ``gone``: whether their source (in ``column``), or that of their document, is one of ``sources``."""
    gone = sources.select(*on, F.col("source").alias(column)).distinct().withColumn("_g", F.lit(True))
    marked = rows.join(gone, [*on, column], "left")
    flag = F.col("_g").isNotNull()
    if documents is not None:
        ids = documents.join(sources.select(*on, "source").distinct(), [*on, "source"], "left_semi").select("doc_id").distinct().withColumn("_d", F.lit(True))
        marked, flag = marked.join(ids, "doc_id", "left"), flag | F.col("_d").isNotNull()
    return marked.withColumn("gone", flag).select(*rows.columns, "gone")


class Index:
    """One index in a folder.  ``kind`` 'documents' also stores whole documents and allows navigation.

    ``manifest-<n>.json`` names the data folders and the metadata of version n; the highest is current.  A write puts new
    data into ``data-<n>`` and then creates the manifest, which fails if another writer has created it before: that is the
    commit.  An append names the folders of the version before and its own, and rewrites nothing.
    """

    def __init__(self, spark: SparkSession, folder):
        self.spark = spark
        self.folder = folder if isinstance(folder, Folder) else Folder(spark, folder)
        self._checked: int | None = None

    # -- state

    @property
    def name(self) -> str:
        return self.folder.name

    @property
    def version(self) -> int | None:
        numbers = [int(m[1]) for n in self.folder.names() if (m := _MANIFEST.fullmatch(n))]
        return max(numbers, default=None)

    def exists(self) -> bool:
        return self.version is not None

    def manifest(self) -> dict:
        version = self.version
        return {"tables": {}, "records": [], "meta": {}} if version is None else (self.folder / f"manifest-{version}.json").json()

    def meta(self) -> dict:
        return {"storage_backend": "faiss", "embedding_backend": "local", "embedding_model": "all-MiniLM-L6-v2"} | self.manifest()["meta"]

    def locked(self) -> bool:
        return (self.folder / ".locked").exists()

    def lock(self) -> None:
        (self.folder / ".locked").write("")

    def unlock(self) -> None:
        (self.folder / ".locked").delete()

    # -- integrity

    def check(self, *, fast: bool = True) -> dict[str, str]:
        """File -> 'ok', 'mismatch', 'MISSING' or 'UNTRACKED_FILE'; {'': 'untracked' | 'suppressed'} without a usable record.
        An index never written is new and has no files."""
        if (self.folder / ".suppressed").exists():
            return {"": "suppressed"}
        if not self.exists():
            return {}
        states = self._states(fast)
        return {"": "untracked"} if states is None else {r["fname"]: r["state"] for r in states.collect()}

    def _states(self, fast: bool) -> DataFrame | None:
        manifest = self.manifest()
        records = [self._path(r) for r in manifest["records"] if (self.folder / r).exists()]
        if not records:
            return None
        folders = [self._path(p) for parts in manifest["tables"].values() for p in parts if (self.folder / p).exists()]
        recorded = self.spark.read.parquet(*records)
        recorded = recorded.where(F.array_contains(F.lit(sorted({p for parts in manifest["tables"].values() for p in parts})), F.regexp_extract("fname", r"^(.*)/[^/]+$", 1)))
        found = integrity.files_of(self.spark, folders, hashed=not fast) if folders else recorded.limit(0)
        return integrity.states_of(recorded, found, fast=fast)

    def suppress(self) -> None:
        (self.folder / ".suppressed").write("")

    def gate(self, *, fast: bool = True) -> None:
        """Refuse an index whose files are not those that were written; only the files that differ come to the driver."""
        if self.exists() and not (self.folder / ".suppressed").exists() and (states := self._states(fast)) is not None:
            bad = states.where("state in ('mismatch', 'MISSING')").limit(100)
            integrity.refuse(self.name, [(r["fname"], r["state"]) for r in bad.collect()])

    # -- reading

    def _path(self, part: str) -> str:
        return f"{self.folder.path}/{part}"

    def read(self, table: str) -> DataFrame:
        """A table of the current version; the files are checked, by size and time, when a version is first read."""
        version, parts = self.version, self.manifest()["tables"].get(table)
        if not parts:
            raise FileNotFoundError(f"{self.name} has no {table}")
        if self._checked != version:
            self.gate()
            self._checked = version
        return self.spark.read.option("mergeSchema", "true").parquet(*map(self._path, parts))

    def has(self, table: str) -> bool:
        return bool(self.manifest()["tables"].get(table))

    def require_documents(self) -> None:
        if not self.has("documents"):
            raise Unsupported(f"{self.name} stores no documents; reading and navigation need an index that does")

    def _chunks_of_documents(self) -> DataFrame:
        self.require_documents()
        return self.read("chunks")

    def document(self, source: str) -> DataFrame:
        """The document of exactly this source, or sources that contain it; see ``documents_by_source``."""
        self.require_documents()
        return navigation.documents_by_source(self.spark.createDataFrame([(source,)], "asked string"), self.read("documents"))

    def chunk(self, source: str, n: int, context: int = 0) -> DataFrame:
        """Chunk ``n`` of a document, from 0, and its neighbours; see ``nth_chunk``."""
        asked = self.spark.createDataFrame([(source, n)], "source string, n int")
        return navigation.nth_chunk(asked, self._chunks_of_documents(), by="source", context=context)

    def range(self, source: str, start: int = 0, count: int = 10) -> DataFrame:
        """Successive chunks of a document as one text; see ``read_range``."""
        own = self._chunks_of_documents().where(F.col("source") == source)
        return navigation.read_range(own, by=["source"], order=["chunk_idx", "id"], start=start, count=count)

    def sources(self, containing: str | None = None, most: int | None = 50) -> DataFrame:
        """Sources and their chunks, with the number of all; see ``listing``."""
        named = self.read("hashes").select(F.lit(self.name).alias("index_name"), F.col("filename").alias("source"), F.monotonically_increasing_id().alias("doc_id")).where("source is not null")
        chunks = self.read("chunks").select("source").join(named.select("source", "doc_id"), "source")
        return navigation.listing(named, chunks, containing=containing, most=most)

    def ask(self, questions: DataFrame, embedder, k: int = 5, **more) -> DataFrame:
        """``search.ask`` among the chunks of this index."""
        return search.ask(questions, self.read("chunks"), embedder, k, **more)

    # -- writing

    def _commit(self, base: int | None, new: dict[str, DataFrame], kept: dict[str, list[str]], records: list[str], meta: dict, lock: bool) -> None:
        """Write ``new`` beside the folders that are ``kept`` and make both the version after ``base``."""
        number = (base or 0) + 1
        token = uuid.uuid4().hex[:12]  # another writer of the same version writes elsewhere
        parts = {name: f"data-{number}-{token}/{name}" for name in new}
        for name, df in new.items():
            df.write.mode("overwrite").parquet(self._path(parts[name]))
        record = f"record-{number}-{token}"
        integrity.record(self.spark, [self._path(p) for p in parts.values()], self._path(record))
        tables = {name: [*kept.get(name, []), *([parts[name]] if name in parts else [])] for name in {*kept, *parts}}
        chunks = self.spark.read.option("mergeSchema", "true").parquet(*map(self._path, tables["chunks"]))
        counts = chunks.agg(F.count("*").alias("n"), F.countDistinct("source").alias("f")).first()
        dims = chunks.where("embedding is not null").select(F.size("embedding")).limit(1).collect() if "embedding" in chunks.columns else []
        meta = self.meta() | meta | {"n_chunks": counts["n"], "n_files": counts["f"], "dim": dims[0][0] if dims else None}
        manifest = {"tables": tables, "records": [*records, record], "meta": meta}
        if not (self.folder / f"manifest-{number}.json").write_new(json.dumps(manifest, indent=2)):
            for part in (f"data-{number}-{token}", record):
                (self.folder / part).delete()
            raise Conflict(f"{self.name}: another writer has made version {number}")
        if lock:
            self.lock()

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove data that none of the last ``keep`` versions names, and the manifests of the versions before them."""
        names = self.folder.names()
        numbers = sorted((int(m[1]) for n in names if (m := _MANIFEST.fullmatch(n))), reverse=True)
        manifests = [(self.folder / f"manifest-{n}.json").json() for n in numbers[:keep]]
        used = {p.split("/")[0] for m in manifests for parts in m["tables"].values() for p in parts} | {r for m in manifests for r in m["records"]}
        gone = [f"manifest-{n}.json" for n in numbers[keep:]] + [n for n in names if n.startswith(("data-", "record-")) and n not in used]
        # what a writer is putting down has a number beyond the current version and stays
        gone = [n for n in gone if not (m := re.match(r"(?:data|record)-(\d+)", n)) or int(m[1]) <= max(numbers, default=0)]
        for n in gone:
            (self.folder / n).delete()
        return gone

    def save(self, chunks: DataFrame, hashes: DataFrame, documents: DataFrame | None = None, *, force: bool = False, lock: bool = True, **meta) -> None:
        """Replace everything.  A locked index is replaced only by force."""
        if self.locked() and not force:
            raise Locked(f"{self.name} is locked")
        base = self.version
        tables = {"chunks": chunks, "hashes": hashes}
        if documents is not None:
            if "doc_id" not in documents.columns:
                documents = number_documents(documents, 1)
            ids = documents.groupBy("source").agg(F.min("doc_id").alias("doc_id"))
            tables = {"chunks": chunks.drop("doc_id").join(ids, "source", "left"), "hashes": hashes, "documents": documents}
        kind = "sqlite-doc" if documents is not None else meta.get("storage_backend", "faiss")
        self._commit(base, tables, {}, [], meta | {"storage_backend": kind}, lock)

    def save_hashes(self, hashes: DataFrame) -> None:
        """Replace the hashes alone; the other tables stay where they lie."""
        manifest, base = self.manifest(), self.version
        if base is None:
            raise FileNotFoundError(f"{self.name} does not exist")
        kept = {k: v for k, v in manifest["tables"].items() if k != "hashes"}
        self._commit(base, {"hashes": hashes}, kept, manifest["records"], {}, self.locked())

    def append(self, chunks: DataFrame, hashes: DataFrame, documents: DataFrame | None = None, *, order: tuple[str, ...] = ("source", "chunk_idx"), lock: bool = True, **meta) -> None:
        """Add chunks with the ids after the last, documents whose source is new, hashes not known yet; always allowed.

        Nothing stored is rewritten: only the new rows go into a new folder.
        """
        if not self.exists():
            return self.save(number_chunks(chunks, 0, order), hashes, documents, lock=lock, **meta)
        if documents is not None and not self.has("documents"):
            raise Unsupported(f"{self.name} stores no documents")
        if meta.get("index_type", self.meta().get("index_type")) != self.meta().get("index_type"):
            raise Unsupported(f"{self.name} is an index of {self.meta().get('index_type')}")
        base, manifest = self.version, self.manifest()
        first_id = self.read("chunks").agg(F.coalesce(F.max("id"), F.lit(-1)) + 1).first()[0]
        numbered = number_chunks(chunks, first_id, order)
        new = {}
        if self.has("documents"):
            known = self.read("documents")
            ids = known.select("source", "doc_id")
            if documents is not None:
                last = known.agg(F.coalesce(F.max("doc_id"), F.lit(0)) + 1).first()[0]
                new["documents"] = number_documents(ignore_known(documents, known, ["source"], documents.columns), last)
                ids = ids.unionByName(new["documents"].select("source", "doc_id"))
            numbered = numbered.drop("doc_id").join(ids.groupBy("source").agg(F.min("doc_id").alias("doc_id")), "source", "left")
        stored = self.read("hashes")
        fresh = hashes.select("hash", "filename").join(stored.select("hash"), "hash", "left_anti")
        new |= {"chunks": numbered, "hashes": merge_hashes(fresh, order=["filename"], last=False)}
        self._commit(base, new, manifest["tables"], manifest["records"], meta | {"source_dir": "multiple"}, lock)

    def remove_source(self, source: str) -> dict[str, int]:
        """Drop everything of one source; a source that nothing names is an error."""
        base = self.version
        sources = self.spark.createDataFrame([(source,)], "source string")
        docs = self.read("documents") if self.has("documents") else None
        parts = {
            "chunks": split_by_source(self.read("chunks"), sources, on=[], documents=docs),
            "hashes": split_by_source(self.read("hashes"), sources, on=[], column="filename"),
        }
        if docs is not None:
            parts["documents"] = split_by_source(docs, sources, on=[])
        out = {name: df.where("gone").count() for name, df in parts.items()}
        if not out["chunks"] + out.get("documents", 0):
            raise KeyError(source)
        self._commit(base, {name: df.where("not gone").drop("gone") for name, df in parts.items()}, {}, [], {}, self.locked())
        return out


def verify_all(indexes: list[Index], *, fast: bool = False) -> dict[str, dict[str, str]]:
    """The states of all files of each index."""
    return {i.name: i.check(fast=fast) for i in indexes}
