"""Sources and sinks (S1-S4): table sets, appended batches, JSON-lines, run results.

Writes go under a folder the caller names, by default below the session's shared
checkpoint folder (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from typing import Iterable, Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.keys import rank_within
from ..session import scratch_path
from .storage import create_new, delete, files, folders

SEQ = "_seq"
BATCH = "_batch"
LOG = "_log"


def read_table_set(spark: SparkSession, base: str, names: Iterable[str], fmt: str = "parquet",
                   **options) -> dict[str, DataFrame]:
    """One DataFrame per table from ``{base}/{name}.{fmt}`` (or a folder of that name)."""
    out = {}
    for n in names:
        path = f"{base}/{n}.{fmt}" if fmt == "parquet" else f"{base}/{n}"
        out[n] = spark.read.format(fmt).options(**options).load(path)
    return out


def write_table_set(tables: Mapping[str, DataFrame], base: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write every table (an empty table is still written, so it exists downstream)."""
    for n, df in tables.items():
        df.write.mode(mode).format(fmt).save(f"{base}/{n}")


class BatchWriter:
    """``write(entity, df)`` appends a batch; repeated calls extend the table.

    A table is a commit log: a batch's rows go to a folder of their own, then a manifest ``_log/<number>.json`` names
    that folder.  The manifest is written last and only if its number is free, so of several writers each gets a
    number of its own, a batch that failed half-way is never read, and readers see whole batches.  ``token``
    names a batch: writing a token again (a retry, also one that runs beside the first try) changes nothing.  Rows get ``_batch`` (the manifest's number, 0, 1, ...)
    and ``_seq`` (batch above bit 40, place of the row in the batch by ``order`` below), so last-write-wins
    resolution follows the order of commits, also inside a batch.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base

    def manifests(self, entity: str) -> list[dict]:
        """The committed batches in order: number, token, folder, rows, columns; of manifests with one token the first counts."""
        log = f"{self.base}/{entity}/{LOG}"
        names = [f for f in files(self.spark, log) if f.endswith(".json")]
        if not names:
            return []
        rows = self.spark.read.text([f"{log}/{n}" for n in names], wholetext=True).collect()
        # a writer that has created its manifest but not yet written it has not committed
        found = sorted((json.loads(r[0]) for r in rows if r[0].strip().endswith("}")), key=lambda m: m["batch"])
        first: dict[str, dict] = {}
        for m in found:
            first.setdefault(m["token"], m)
        return list(first.values())

    def _committed(self, entity: str, token: str) -> int | None:
        return next((m["rows"] for m in self.manifests(entity) if m["token"] == token), None)

    def write(self, entity: str, df: DataFrame, order: Sequence[str] = ("id",), token: str | None = None) -> int:
        """Append ``df`` in the order of ``order``; the number of rows of the batch."""
        token = token or uuid.uuid4().hex
        if (done := self._committed(entity, token)) is not None:
            return done
        folder = f"data-{uuid.uuid4().hex}"
        seen = Observation()
        rank_within(df, [], list(order), SEQ, start=0).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.base}/{entity}/{folder}")
        n = seen.get["n"]
        batch = len(files(self.spark, f"{self.base}/{entity}/{LOG}"))
        while True:
            note = {"batch": batch, "token": token, "folder": folder, "rows": n, "schema": df.schema.jsonValue()}
            if create_new(self.spark, f"{self.base}/{entity}/{LOG}/{batch:012d}.json", json.dumps(note)):
                return n
            # another writer took the number; it may have been this very batch, tried twice at once
            if (done := self._committed(entity, token)) is not None:
                delete(self.spark, f"{self.base}/{entity}/{folder}")
                return done
            batch += 1

    def read(self, entity: str) -> DataFrame:
        """All committed batches; a batch that lacks a column has nulls in it."""
        parts = []
        for m in self.manifests(entity):
            fields = T.StructType.fromJson(m["schema"])
            rows = self.spark.read.schema(fields.add(SEQ, "long")).parquet(f"{self.base}/{entity}/{m['folder']}")
            parts.append(rows.withColumn(SEQ, F.col(SEQ) + F.lit(m["batch"] << 40)).withColumn(BATCH, F.lit(m["batch"])))
        if not parts:
            raise FileNotFoundError(f"no batch of {entity} below {self.base}")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def tables(self) -> dict[str, DataFrame]:
        return {e: self.read(e) for e in folders(self.spark, self.base) if self.manifests(e)}


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S3: one JSON object per line; blank lines are skipped by the reader."""
    r = spark.read
    if schema:
        r = r.schema(schema)
    return r.json(path)


def write_runs(runs: DataFrame, path: str) -> None:
    """Run results with nested steps as JSON."""
    runs.write.mode("overwrite").json(path)


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read run results: JSON lines, or one document (or list of documents) per file, indented or not."""
    reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt")
    multi = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", "true")
    shapes = run_files(spark, path)
    single = [r["file"] for r in shapes.where("single").collect()]
    if not single:
        return reader.json(path)
    lines = [r["file"] for r in shapes.where("not single").collect()]
    documents = multi.json([unquote(f) for f in single])
    return documents.union(reader.json([unquote(f) for f in lines])) if lines else documents


def run_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, single): whether a file holds one document (or a list of them) rather than one document a line.

    It does if its first line that is not blank opens a list, or is no complete document while no other line is one (so a
    damaged first line makes no document of the file).  Files are read line by line and in blocks; what is kept per file is
    one line and a flag, combined before the shuffle.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                        F.monotonically_increasing_id().alias("line"), F.rtrim(F.col("value"), F.lit(" \t\r")).alias("value"))
    text = text.where(F.btrim("value", F.lit(" \t\r\ufeff")) != "")
    complete = F.col("value").startswith("{") & F.try_parse_json("value").isNotNull()
    per = text.groupBy("file").agg(F.min_by("value", F.struct("block", "line")).alias("first"), F.bool_or(complete).alias("records"))
    start = F.btrim("first", F.lit(" \t\r\ufeff"))
    one = F.try_parse_json(start).isNotNull()
    return per.select("file", (~one & (start.startswith("[") | ~F.col("records"))).alias("single"))
