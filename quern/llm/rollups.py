"""Token-count totals that batches of changes maintain.

A batch holds changes of documents' counts: inserts, deletes and revisions. Commit nets
them per document and tokenizer version, looks up what the ledger has for those, and turns
each into signed amounts: minus the old count, plus the new one. The amounts, summed by
source, language and tokenizer version, are added to the last totals; the changed rows are
appended to the ledger. Both are written to new folders, and a small manifest, put in
place by one rename, makes them count. A batch whose id is committed does nothing, and a
job that fails before the rename leaves no trace in the totals: batches can be run again.

Defined results: the change of the highest ``seq`` wins, of equal ones the one with more
tokens; an insert of a document that is there is a revision; a delete or a revision of one
that isn't does nothing; null sources and languages are groups; a null doc_id is one
document; null counts are 0. Totals leave out groups without documents.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import map_batches, word_count

INSERT, DELETE, REVISE = "insert", "delete", "revise"
KEY = ["doc_id", "tokenizer"]
GROUP = ["source", "lang", "tokenizer"]
LEDGER = "doc_id long, tokenizer string, source string, lang string, tokens long, live boolean, version int"
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"


def letter_runs(text: Column) -> Column:
    """Number of runs of letters and digits; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+")), F.lit(0)).cast("long")


#: Tokenizer versions that Spark counts itself.
NATIVE = {"words@1": word_count, "letters@2": letter_runs}


def counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, lang, tokens) under one of the NATIVE tokenizer versions."""
    return docs.select("doc_id", "source", "lang", NATIVE[tokenizer](F.col("text")).alias("tokens"))


def bpe_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, lang, tokens) under a public tokenizer's file."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        from tokenizers import Tokenizer

        held = step.__dict__.setdefault("held", [])
        if not held:
            held.append(Tokenizer.from_file(path))
            held[0].encode_special_tokens = True
        made = held[0].encode_batch([x or "" for x in batch.column(3).to_pylist()], add_special_tokens=False)
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(m.ids) for m in made], pa.int64())], ["doc_id", "source", "lang", "tokens"])

    return map_batches(docs.select("doc_id", "source", "lang", "text"), step, "doc_id long, source string, lang string, tokens long", "text", 1 << 20)


def changes(counted: DataFrame, tokenizer: str, op: str, seq: int = 0) -> DataFrame:
    """Rows of a batch: every row of counted (doc_id, source, lang, tokens) under one operation."""
    return counted.select("doc_id", F.lit(tokenizer).alias("tokenizer"), F.lit(op).alias("op"), "source", "lang", F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"), F.lit(seq).alias("seq"))


class Rollup:
    """The totals in one folder of the shared store."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.store = self.path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.store.mkdirs(self.path(f"{self.folder}/commits"))

    def _manifests(self) -> list[dict]:
        """What is committed, in order; one small file per batch."""
        names = sorted(s.getPath().toString() for s in self.store.listStatus(self.path(f"{self.folder}/commits")) if not s.getPath().getName().startswith("."))
        if not names:
            return []
        rows = self.spark.read.text(names, wholetext=True).collect()
        return sorted((json.loads(r.value) for r in rows), key=lambda m: m["version"])

    def totals(self) -> DataFrame:
        done = self._manifests()
        if not done:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(done[-1]["totals"]).filter("docs <> 0 OR tokens <> 0")

    def _ledger(self, done: list[dict]) -> DataFrame:
        if not done:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(*[m["ledger"] for m in done])

    def commit(self, batch_id: str, batch: DataFrame) -> bool:
        """Adds a batch (doc_id, tokenizer, op, source, lang, tokens, seq); False if it was committed before."""
        done = self._manifests()
        if any(m["batch"] == batch_id for m in done):
            return False
        version = len(done)
        latest = F.max(F.struct("seq", "tokens", "op", "source", "lang")).alias("c")
        net = batch.groupBy(*KEY).agg(latest).select(*KEY, "c.op", "c.source", "c.lang", "c.tokens", F.lit(True).alias("asked"))
        # one aggregation by key meets the changes with what the ledger has of the same documents
        old = self._ledger(done).groupBy(*KEY).agg(F.max_by(F.struct("source", "lang", "tokens", "live"), "version").alias("old"))
        empty = F.lit(None).cast("struct<source:string,lang:string,tokens:bigint,live:boolean>")
        both = net.select(*KEY, F.struct("op", "source", "lang", "tokens").alias("new"), empty.alias("old")).unionByName(old.select(*KEY, F.lit(None).cast("struct<op:string,source:string,lang:string,tokens:bigint>").alias("new"), "old"))
        met = both.groupBy(*KEY).agg(F.max("new").alias("new"), F.max("old").alias("old")).filter("new IS NOT NULL")
        was = F.coalesce(F.col("old.live"), F.lit(False))
        acts = was | (F.col("new.op") == INSERT)
        now = F.col("new.op") != DELETE
        changed = met.filter(acts).select(*KEY, "new.source", "new.lang", "new.tokens", now.alias("live"), F.lit(version).alias("version"), "old")
        name = f"{version:08d}-{uuid.uuid4().hex[:8]}"
        ledger, totals = f"{self.folder}/ledger/{name}", f"{self.folder}/totals/{name}"
        wide = LEDGER + ", old struct<source:string,lang:string,tokens:bigint,live:boolean>"
        changed.write.parquet(ledger)
        rows = self.spark.read.schema(wide).parquet(ledger)
        minus = rows.filter("old.live").select("old.source", "old.lang", "tokenizer", F.lit(-1).cast("long").alias("docs"), (-F.col("old.tokens")).alias("tokens"))
        plus = rows.filter("live").select("source", "lang", "tokenizer", F.lit(1).cast("long").alias("docs"), "tokens")
        before = self.spark.read.schema(TOTALS).parquet(done[-1]["totals"]) if done else self.spark.createDataFrame([], TOTALS)
        minus.unionByName(plus).unionByName(before).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).coalesce(1).write.parquet(totals)
        self._publish(version, {"version": version, "batch": batch_id, "ledger": ledger, "totals": totals})
        return True

    def _publish(self, version: int, manifest: dict) -> None:
        draft, final = (self.path(f"{self.folder}/commits/{name}") for name in (f".{uuid.uuid4().hex}", f"{version:08d}"))
        out = self.store.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self.store.exists(final) or not self.store.rename(draft, final):
            self.store.delete(draft, False)
            raise RuntimeError(f"version {version} was committed by another job: run the batch again")
