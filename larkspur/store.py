"""The document store: put, get, delete, search over tables in one folder.

Layout under a folder on any file system Spark reaches:

    records/batch=N-X/    change-log rows of one commit, or of several merged ones
    postings/segment=N-X/ index rows of one commit, or of one compaction
    staging/X/            what a put was given; rejected rows stay readable there until vacuum()
    manifest/N.json       what version N consists of; written to a temporary name, then put in place

X is unique to an attempt, so no writer touches another's files.  A version is visible once its manifest is
there, so records and postings commit together, readers see one version throughout, and a crash leaves only
files that nothing refers to.  A manifest is put in place only if there is none of its number (a hard link on local
files, a rename on HDFS; object stores need a committer that offers the same), so of writers that meet one commits, and
the others see its version and try again.  Sequence numbers grow across reopenings and are never reused.

Folders have a tier: ten of one tier are merged into one of the next after a commit, so n commits leave
some 10 * log10(n) folders to read.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.keys import url_key
from larkspur.operators import changelog, compaction, kv, postings, search
from larkspur.schemas import POSTINGS, RECORDS

INPUT = "url string, content string, metadata string, type int, op string"


class ReadOnlyError(RuntimeError):
    pass


class ConflictError(RuntimeError):
    """Another writer committed this version first."""


#: Attempts of one change among several writers, and manifests kept behind the current one.
ATTEMPTS, MANIFESTS = 30, 20


class DocumentStore:
    """A store in `folder`.

    postings_mode: "history" finds a key by the terms of all its versions, "current" by its last version's only.
    auto_compact: merge folders after a commit when enough have gathered.
    """

    def __init__(self, spark: SparkSession, folder: str, read_only: bool = False, postings_mode: str = "history", auto_compact: bool = True):
        if postings_mode not in ("history", "current"):
            raise ValueError("postings_mode is history or current")
        self.spark, self.folder, self.read_only, self.postings_mode, self.auto_compact = spark, folder.rstrip("/"), read_only, postings_mode, auto_compact
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.closed = False
        self._state = self._read_manifest()

    # --- versions

    def _path(self, *parts: object):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *map(str, parts)]))

    def _versions(self) -> list[int]:
        at = self._path("manifest")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read_manifest(self) -> dict:
        versions = self._versions()
        if not versions:
            return {"version": 0, "lsn": 0, "next": 1, "batches": {}, "segments": {}, "streams": {}}
        stream = self._fs.open(self._path("manifest", f"{versions[-1]}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        state = state | {"version": self._state["version"] + 1}
        draft, final = self._path("manifest", f".{state['version']}-{uuid.uuid4().hex}.tmp"), self._path("manifest", f"{state['version']}.json")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        if not self._put_in_place(draft, final):
            self._fs.delete(draft, False)
            raise ConflictError(f"version {state['version']} was written by someone else")
        self._state = state
        old = self._path("manifest", f"{state['version'] - MANIFESTS}.json")
        if state["version"] > MANIFESTS and self._fs.exists(old):
            self._fs.delete(old, False)

    def _put_in_place(self, draft, final) -> bool:
        """Give draft its final name unless that is taken."""
        if self._fs.getUri().getScheme() != "file":
            return not self._fs.exists(final) and self._fs.rename(draft, final)
        jvm = self.spark._jvm
        try:  # a rename would replace what is there
            jvm.java.nio.file.Files.createLink(*(jvm.java.io.File(p.toUri().getPath()).toPath() for p in (final, draft)))
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        self._fs.delete(draft, False)
        return True

    def refresh(self) -> None:
        """See what another writer has committed since."""
        self._state = self._read_manifest()

    @property
    def last_lsn(self) -> int:
        return self._state["lsn"]

    @property
    def segments(self) -> list[str]:
        return list(self._state["segments"])

    def log(self) -> DataFrame:
        """The change log of this version."""
        paths = [f"{self.folder}/records/batch={n}" for n in self._state["batches"]]
        return self.spark.read.schema(RECORDS).parquet(*paths) if paths else self.spark.createDataFrame([], RECORDS)

    def postings(self) -> DataFrame:
        """The index of this version."""
        paths = [f"{self.folder}/postings/segment={n}" for n in self._state["segments"]]
        return self.spark.read.schema(POSTINGS).parquet(*paths) if paths else self.spark.createDataFrame([], POSTINGS)

    def values(self) -> DataFrame:
        """The current row of every live key."""
        return kv.live(self.log())

    # --- changes

    def _writable(self) -> None:
        if self.read_only or self.closed:
            raise ReadOnlyError("the store is read-only" if self.read_only else "the store is closed")

    def _name(self) -> str:
        return f"{self._state['next']}-{uuid.uuid4().hex[:12]}"

    def _write_records(self, rows: DataFrame, name: str) -> DataFrame:
        at = f"{self.folder}/records/batch={name}"
        rows.repartitionByRange("u_hash").sortWithinPartitions("u_hash", "lsn").write.option("compression", "zstd").parquet(at)
        return self.spark.read.schema(RECORDS).parquet(at)

    def _append(self, make: Callable[[int], DataFrame], stream: tuple[str, int] | None = None) -> int:
        """Write make(last sequence number) as change-log rows, and their postings, and commit both; how many rows.

        If another writer commits first, all is done again above its sequence numbers.
        """
        for attempt in range(ATTEMPTS):
            state, name = self._state, self._name()
            if stream and state["streams"].get(stream[0], -1) >= stream[1]:
                return 0
            written = self._write_records(make(state["lsn"]), name)
            if written.groupBy("u_hash", "lsn").count().filter("count > 1").limit(1).count():
                raise ValueError("two changes of one key have the same seq")
            count, last = written.agg(F.count(F.lit(1)), F.max("lsn")).first()
            new = state | ({"streams": state["streams"] | {stream[0]: stream[1]}} if stream else {})
            if count:
                self._write_segment(postings.build(written, F.lit(state["next"])), name)
                new |= {"lsn": last, "next": state["next"] + 1, "batches": state["batches"] | {name: 0}, "segments": state["segments"] | {name: 0}}
            try:
                if new != state:
                    self._commit(new)
            except ConflictError:
                if attempt == ATTEMPTS - 1:
                    raise
                time.sleep(random.random() * min(2.0, 0.1 * 2**attempt))
                self.refresh()
                continue
            if self.auto_compact:
                self._tidy()
            return count
        raise AssertionError

    def _tidy(self) -> None:
        """Merge folders of a tier that has enough of them.  What another writer commits meanwhile comes first: then nothing is merged now."""
        try:
            for kind in ("batches", "segments"):
                tier = 0
                while tier <= max(self._state[kind].values(), default=-1):
                    some = [n for n, t in self._state[kind].items() if t == tier]
                    if compaction.should_compact(len(some)):
                        self._merge(kind, some, tier + 1)
                    tier += 1
        except ConflictError:
            self.refresh()

    def _merge(self, kind: str, some: list[str], tier: int) -> None:
        name = self._name()
        if kind == "batches":
            self._write_records(self.spark.read.schema(RECORDS).parquet(*[f"{self.folder}/records/batch={n}" for n in some]), name)
        else:
            index = self.spark.read.schema(POSTINGS).parquet(*[f"{self.folder}/postings/segment={n}" for n in some])
            self._write_segment(compaction.merged(index, self._state["next"]), name)
        left = {n: t for n, t in self._state[kind].items() if n not in some}
        self._commit(self._state | {"next": self._state["next"] + 1, kind: left | {name: tier}})

    def _write_segment(self, index: DataFrame, name: str) -> None:
        postings.arranged(index).write.option("compression", "zstd").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{self.folder}/postings/segment={name}")

    def put_many(self, rows: DataFrame, stream: tuple[str, int] | None = None) -> tuple[int, DataFrame]:
        """Put a frame of (url, content[, metadata, type, op, seq]) in one commit.

        op 'delete' makes a tombstone.  Sequence numbers are seq (from 0) above the last one; seq orders changes of one key
        inside the batch, and by default follows the frame's partitions and rows.  Returns how many rows went in,
        and the rejected rows: no url, puts without content, or with metadata that lacks a description, an op that is
        neither put nor delete (null is put), a seq that is null or below 0.  The frame is evaluated once.
        Raises ValueError, with nothing written, if two changes of one key have the same seq.
        """
        self._writable()
        metadata = F.col("metadata") if "metadata" in rows.columns else F.lit(None).cast("string")
        valid = changelog.is_valid(F.col("url"), F.col("content"), metadata)
        if "op" in rows.columns:
            op = F.coalesce(F.col("op"), F.lit(changelog.PUT))
            valid = F.when(op == changelog.DELETE, F.col("url").isNotNull()).otherwise(valid & (op == changelog.PUT))
        if "seq" in rows.columns:
            valid = valid & (F.col("seq") >= 0)
        at = f"{self.folder}/staging/{uuid.uuid4().hex}"
        staged = rows.withColumn("_ok", F.coalesce(valid, F.lit(False)))
        if "seq" not in rows.columns:
            staged = staged.withColumn("_seq", F.monotonically_increasing_id())
        staged.write.parquet(at)
        staged = self.spark.read.schema(staged.schema).parquet(at)
        seq = F.col("seq" if "seq" in rows.columns else "_seq")
        good = staged.filter("_ok")
        count = self._append(lambda last: changelog.changes(good.withColumn("_lsn", F.lit(last + 1) + seq), F.col("_lsn")), stream)
        return count, staged.filter(~F.col("_ok")).select(*rows.columns)

    def _one(self, url: str, content: str | None, metadata: dict | str | None, op: str) -> None:
        text = metadata if metadata is None or isinstance(metadata, str) else json.dumps(metadata, ensure_ascii=False)
        row = self.spark.createDataFrame([(url, content, text, 1, op)], INPUT)
        self._append(lambda last: changelog.changes(row, F.lit(last + 1), F.lit(int(time.time()))).coalesce(1))

    def put(self, url: str, content: str, metadata: dict | str | None = None) -> str | None:
        """Insert or replace one document; its key, or None if it was rejected (nothing is then written).

        With metadata the document is found by its description instead of its content.  Compaction
        is a job of its own: see run_compact().
        """
        self._writable()
        if url is None or content is None:
            return None
        filled = json.loads(metadata) if isinstance(metadata, str) else metadata
        if filled and filled.get("description") is None:
            return None
        self._one(url, content, metadata, changelog.PUT)
        return self.spark.range(1).select(url_key(F.lit(url))).first()[0]

    def delete(self, url: str) -> bool:
        """Delete one document; whether there was one."""
        self._writable()
        there = self.get(url) is not None
        if there:
            self._one(url, None, None, changelog.DELETE)
        return there

    # --- queries

    def get(self, url: str) -> Row | None:
        """The current (url, type, metadata, content, ts) of one document."""
        return kv.get(self.log(), url).select("url", "type", "metadata", "content", "ts").first()

    def get_many(self, urls: Iterable[str] | DataFrame) -> DataFrame:
        frame = urls if isinstance(urls, DataFrame) else self.spark.createDataFrame([(u,) for u in urls], "url string")
        return kv.get_many(self.log(), frame)

    def _index(self, keyword: str) -> DataFrame:
        index = search.matching(self.postings(), keyword)
        return search.current(index, self.log()) if self.postings_mode == "current" else index

    def search(self, keyword: str) -> DataFrame:
        """Live documents with any of the keyword's terms."""
        return search.search(self._index(keyword), self.log(), keyword)

    def ranking_search(self, keyword: str, per_segment: bool = False, limit: int | None = None) -> DataFrame:
        """The same by number of terms, then key."""
        return search.ranking_search(self._index(keyword), self.log(), keyword, per_segment, limit)

    # --- upkeep

    def should_compact(self) -> bool:
        return compaction.should_compact(len(self._state["segments"]))

    def run_compact(self) -> None:
        """Merge all segments into one without deleted keys; readers of older versions keep their files until vacuum()."""
        self._writable()
        if not self._state["segments"]:
            return
        number, name = self._state["next"], self._name()
        merged = compaction.compact(self.postings(), kv.live_keys(self.log()), number)
        self._write_segment(merged, name)
        self._commit(self._state | {"next": number + 1, "segments": {name: max(self._state["segments"].values())}})

    def rebuild(self) -> None:
        """Replace all segments by a fresh index of the change log."""
        self._writable()
        number, name = self._state["next"], self._name()
        self._write_segment(postings.build(self.log(), F.lit(number)), name)
        self._commit(self._state | {"next": number + 1, "segments": {name: max(self._state["segments"].values(), default=0)}})

    def vacuum(self, min_age: float = 0) -> int:
        """Delete folders and manifests that the current version doesn't use; how many.

        min_age: seconds since a folder's last change; more than any commit takes, if other writers are at work.
        """
        self._writable()
        gone = 0
        self.refresh()
        latest = (time.time() - min_age) * 1000
        for kind, name, used in (("records", "batch=", self._state["batches"]), ("postings", "segment=", self._state["segments"]), ("staging", "", {})):
            if self._fs.exists(self._path(kind)):
                for s in self._fs.listStatus(self._path(kind)):
                    if s.getPath().getName().removeprefix(name) not in used and (not min_age or s.getModificationTime() < latest):
                        gone += bool(self._fs.delete(s.getPath(), True))
        for v in self._versions()[:-1]:
            gone += bool(self._fs.delete(self._path("manifest", f"{v}.json"), False))
        return gone

    def close(self) -> None:
        """Every change is committed by the call that made it, so closing only ends the use of this object."""
        self.closed = True

    def __enter__(self) -> DocumentStore:
        return self

    def __exit__(self, *error) -> None:
        self.close()
