"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A batch of changes becomes signed rows: an insert adds a document and its tokens, a delete takes away
what the ledger holds for it, a revision does both.  Each batch writes its signed ledger rows and their
sums per group to a folder of its own and becomes valid by the next numbered entry of a log, which
appears whole and can be created by one committer only.  What a delete or a revision takes away depends
on the ledger as read; if another committer took the number meanwhile, the batch is derived again from
the newer ledger, while an insert just takes the next number.  A batch that is sent again is found in the log, or
among the names of older batches, and changes nothing; an attempt that died before its entry is never read.

Every SNAPSHOT entries the ledger and the sums are written out as a whole, so what a reader or a committer
reads is one snapshot and fewer than about SNAPSHOT batches, however old the rollup is.  vacuum() deletes
what the last snapshot has made superfluous.

Defined results: a null text counts as the empty text (0 tokens); null source or lang is a group of
its own; a repeated row is inserted twice, and a delete or revision by doc_id concerns all rows of that
doc_id (revised rows then count once); rows with a null doc_id can be inserted or replaced only; changes to
unknown documents do nothing; a revision after a delete does nothing; an empty batch is valid and adds
nothing; groups whose documents sum to 0 are left out; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checkpointed, salted_join, short_batches, table
from .secrets import _vocabulary

GROUP = ["source", "lang", "version"]
LEDGER = "doc_id long, source string, lang string, version string, documents long, tokens long"
SUMS = "source string, lang string, version string, documents long, tokens long"
#: Entries of the log after which ledger and sums are written out.
SNAPSHOT = 16


def _summed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


def _negated(df: DataFrame) -> DataFrame:
    return df.withColumns({"documents": -F.col("documents"), "tokens": -F.col("tokens")}).select("doc_id", *GROUP, "documents", "tokens")


def _once(df: DataFrame) -> DataFrame:
    return df.select("doc_id", *GROUP, F.lit(1).cast("long").alias("documents"), "tokens")


class State:
    """The valid batches at one moment: a snapshot's entry number (-1: none) and the entries after it."""

    def __init__(self, snapshot: int, entries: list[dict]):
        self.snapshot, self.entries = snapshot, entries

    @property
    def last(self) -> int:
        return self.snapshot + len(self.entries)


class Rollup:
    """A rollup in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        path = self._path(folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.folder = self._fs.makeQualified(path).toString().rstrip("/")

    # files: an entry of the log, the name of a batch, a snapshot's seal

    def _entry(self, k: int) -> str:
        return f"{self.folder}/log/{k:012d}"

    def _name(self, batch: str) -> str:
        return f"{self.folder}/names/{hashlib.sha256(batch.encode()).hexdigest()}"

    def _exists(self, path: str) -> bool:
        return bool(self._fs.exists(self._path(path)))

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> bool:
        """Create a file that appears whole; False if it was there before.

        The text is written aside first.  Then a rename, which on HDFS fails where the target is, or, where
        a rename would replace it (local disks), a hard link, which fails there.
        """
        draft, target = self._path(f"{self.folder}/drafts/{uuid.uuid4().hex}"), self._path(path)
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._fs.mkdirs(target.getParent())
        if self._fs.getScheme() != "file":
            return not self._fs.exists(target) and bool(self._fs.rename(draft, target))
        nio = self.spark._jvm.java.nio.file
        try:
            nio.Files.createLink(nio.Path.of(target.toUri()), nio.Path.of(draft.toUri()))
            return True
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        finally:
            self._fs.delete(draft, False)

    # reading

    def state(self) -> State:
        top, snapshot = self._path(f"{self.folder}/snapshots"), -1
        if self._fs.exists(top):
            sealed = [int(s.getPath().getName()) for s in self._fs.listStatus(top) if self._fs.exists(self._path(f"{s.getPath()}/sealed"))]
            snapshot = max(sealed, default=-1)
        entries = []
        while self._exists(self._entry(snapshot + len(entries) + 1)):
            entries.append(json.loads(self._read(self._entry(snapshot + len(entries) + 1))))
        return State(snapshot, entries)

    def _rows(self, state: State, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{e['attempt']}/{kind}" for e in state.entries]
        paths += [f"{self.folder}/snapshots/{state.snapshot:012d}/{kind}"] if state.snapshot >= 0 else []
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ledger(self, state: State | None = None) -> DataFrame:
        """What is counted now: a row per document and group."""
        return _summed(self._rows(state or self.state(), "ledger", LEDGER), ["doc_id", *GROUP]).where("documents != 0 or tokens != 0")

    def totals(self) -> DataFrame:
        return _summed(self._rows(self.state(), "sums", SUMS), GROUP).where("documents != 0")

    # writing

    def _known(self, batch: str, state: State) -> bool:
        return any(e["batch"] == batch for e in state.entries) or self._exists(self._name(batch))

    def commit(self, batch: str, signed, derived: bool) -> bool:
        """Make a batch valid; False if it was valid already.

        `signed` makes its signed ledger rows from a state; `derived` says whether they depend on it.
        """
        state, attempt = self.state(), None
        while not self._known(batch, state):
            if derived or attempt is None:
                attempt = f"attempts/{uuid.uuid4().hex}"
                signed(state).select("doc_id", *GROUP, "documents", "tokens").write.parquet(f"{self.folder}/{attempt}/ledger")
                _summed(self.spark.read.schema(LEDGER).parquet(f"{self.folder}/{attempt}/ledger"), GROUP).write.parquet(f"{self.folder}/{attempt}/sums")
            if self._create(self._entry(state.last + 1), json.dumps({"batch": batch, "attempt": attempt})):
                if (state.last + 2) % SNAPSHOT == 0:
                    self.snapshot()
                return True
            state = self.state()
        return False

    def snapshot(self) -> None:
        """Write ledger and sums out as they are now.  The names of the batches in them go first, so none can be sent again."""
        state = self.state()
        if not state.entries:
            return
        for e in state.entries:
            self._create(self._name(e["batch"]), "")
        folder, aside = f"{self.folder}/snapshots/{state.last:012d}", f"{self.folder}/attempts/{uuid.uuid4().hex}"
        self.ledger(state).write.parquet(f"{aside}/ledger")
        _summed(self._rows(state, "sums", SUMS), GROUP).where("documents != 0 or tokens != 0").write.parquet(f"{aside}/sums")
        stream = self._fs.create(self._path(f"{aside}/sealed"), False)
        stream.close()
        self._fs.mkdirs(self._path(f"{self.folder}/snapshots"))
        if not self._exists(folder):  # equal snapshots of two committers: either may stay
            self._fs.rename(self._path(aside), self._path(folder))

    def vacuum(self) -> None:
        """Delete all snapshots but the last, and what only they or batches before it need.  For times without readers or committers."""
        state = self.state()
        if state.snapshot < 0:
            return
        kept = {e["attempt"] for e in state.entries}
        for part, keep in (("attempts", lambda n: f"attempts/{n}" in kept), ("snapshots", lambda n: int(n) == state.snapshot), ("log", lambda n: int(n) > state.snapshot), ("drafts", lambda n: False)):
            top = self._path(f"{self.folder}/{part}")
            for status in self._fs.listStatus(top) if self._fs.exists(top) else []:
                if not status.getPath().getName().startswith(".") and not keep(status.getPath().getName()):
                    self._fs.delete(status.getPath(), True)

    def insert(self, batch: str, counted: DataFrame) -> bool:
        """Rows doc_id, source, lang, version, tokens."""
        return self.commit(batch, lambda state: _once(counted), False)

    def delete(self, batch: str, ids: DataFrame) -> bool:
        """All that is counted for the doc_ids."""
        return self.commit(batch, lambda state: _negated(self.ledger(state).join(ids.select("doc_id").distinct(), "doc_id")), True)

    def revise(self, batch: str, counted: DataFrame) -> bool:
        """New counts, and groups, for documents that are counted: the old ones go."""

        def signed(state):
            now = self.ledger(state)
            new = counted.join(now.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "version"])
            return _negated(now.join(counted.select("doc_id").distinct(), "doc_id")).unionByName(_once(new))

        return self.commit(batch, signed, True)

    def replace(self, batch: str, counted: DataFrame) -> bool:
        """All that is counted goes, and the rows come instead."""
        return self.commit(batch, lambda state: _negated(self.ledger(state)).unionByName(_once(counted)), True)


def counted(docs: DataFrame, path: str, version: str) -> DataFrame:
    """doc_id, source, lang, version, tokens of each text; `tidy`, its tokens once runs of white space
    are one space (null where that changes nothing); and a digest of the text."""
    short_batches(docs.sparkSession)

    def run(batches):
        encode = _vocabulary(path).encode_ordinary
        for batch in batches:
            tokens, tidy, digests = [], [], []
            for text in batch.column(3).to_pylist():
                text = text or ""
                plain = " ".join(text.split())
                tokens.append(len(encode(text)))
                tidy.append(None if plain == text else len(encode(plain)))
                digests.append(hashlib.md5(text.encode()).digest())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([version] * n, pa.string()), pa.array(tokens, pa.int64()), pa.array(tidy, pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "source", "lang", "version", "tokens", "tidy", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, lang string, version string, tokens long, tidy long, digest binary")


def history(spark: SparkSession, docs: DataFrame, folder: str, path: str, version: str) -> Rollup:
    """The life of a corpus: all documents come in; texts are tidied, so their counts are revised; of
    equal texts all but the least doc_id go.  The revision is sent twice, as after a lost reply."""
    rollup = Rollup(spark, folder)
    _lived(rollup, checkpointed(counted(docs, path, version)))
    return rollup


def whole(spark: SparkSession, docs: DataFrame, folder: str, path: str, version: str) -> Rollup:
    """The same life, after which all documents come back as they are: the batches net out to the counts
    of all rows and whole texts."""
    rollup = Rollup(spark, folder)
    rows = checkpointed(counted(docs, path, version))
    _lived(rollup, rows)
    rollup.replace("originals", rows)
    return rollup


def _lived(rollup: Rollup, rows: DataFrame) -> None:
    rollup.insert("load", rows)
    revised = rows.where("tidy is not null").select("doc_id", "source", "lang", "version", F.col("tidy").alias("tokens"))
    rollup.revise("tidy", revised)
    rollup.revise("tidy", revised)
    kept = rows.groupBy("digest").agg(F.min("doc_id").alias("kept"), F.count("*").alias("n")).where("n > 1")
    rollup.delete("copies", salted_join(rows, kept, "digest", "doc_id").where("doc_id != kept").select("doc_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    name, run = "byte_bpe_50k.tiktoken", Scratch(spark, "rollup")
    return run.result(whole(spark, table(spark, sf_dir, "documents"), f"{run.folder}/ledger", public_tokenizers.path(name), name).totals())
