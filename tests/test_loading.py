"""Loads in waves, the commit log, extract on a stream."""

import json
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from migrata.plans.loading import LoadError, load_in_waves
from migrata.sources.io import BatchWriter
from migrata.spec import Schema
from migrata.streaming.replay import extract_batch, extract_stream

SHIPS = Schema.from_dict({"entities": {
    "Port": {"fields": {"id": {"kind": "id"}}}, "Flag": {"fields": {"id": {"kind": "id"}}},
    "Ship": {"fields": {"id": {"kind": "id"}, "port_id": {"kind": "ref", "target": "Port"}, "flag_id": {"kind": "ref", "target": "Flag"}}},
    "Call": {"fields": {"id": {"kind": "id"}, "ship_id": {"kind": "ref", "target": "Ship"}}}}, "nested_blocks": {}})


def _ships(spark, broken=False):
    return {"Port": spark.range(5), "Flag": spark.range(3), "Call": spark.range(20).select("id", (F.col("id") % 7).alias("ship_id")),
            "Ship": spark.range(10).select("id", (F.col("id") % 5 + (5 if broken else 0)).alias("port_id"), (F.col("id") % 3).alias("flag_id"))}


def test_load_publishes_all_or_nothing(spark, tmp_path):
    gate = load_in_waves(_ships(spark), SHIPS, str(tmp_path / "out"))
    assert [(r.wave, r.ref) for r in gate.orderBy("wave", "ref").collect()] == [(0, None), (0, None), (1, "Ship.flag_id"), (1, "Ship.port_id"), (2, "Call.ship_id")]
    assert spark.read.parquet(str(tmp_path / "out" / "Call")).count() == 20
    with pytest.raises(LoadError, match="10 orphans in Ship.port_id"):
        load_in_waves(_ships(spark, broken=True), SHIPS, str(tmp_path / "bad"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    with pytest.raises(FileExistsError):
        load_in_waves(_ships(spark), SHIPS, str(tmp_path / "out"))


def test_tables_of_a_wave_are_written_at_once(spark, tmp_path, monkeypatch):
    # both writers of the first wave must be inside at the same time to get past the barrier
    from pyspark.sql.readwriter import DataFrameWriter
    meet, plain = threading.Barrier(2, timeout=60), DataFrameWriter.parquet

    def slow(self, path, *a, **k):
        if path.endswith(("/Port", "/Flag")):
            meet.wait()
        return plain(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", slow)
    load_in_waves(_ships(spark), SHIPS, str(tmp_path / "out"), workers=2)
    assert not meet.broken


def test_commit_log_gives_each_batch_once(spark, tmp_path):
    base = str(tmp_path / "log")
    one, two = BatchWriter(spark, base), BatchWriter(spark, base)
    rows = lambda a, b: spark.range(a, b).select("id", F.lit("x").alias("v"))
    assert one.write("T", rows(0, 5), token="a") == 5 and two.write("T", rows(5, 8), token="b") == 3
    # a retry, and rows whose manifest was never written
    assert one.write("T", rows(0, 5), token="a") == 5
    rows(100, 200).withColumn("_seq", F.col("id")).write.parquet(f"{base}/T/data-lost")
    back = two.read("T")
    assert sorted((r["id"], r["_batch"]) for r in back.collect()) == [(i, 0) for i in range(5)] + [(i, 1) for i in range(5, 8)]
    # writers that commit at the same time
    writers = [threading.Thread(target=BatchWriter(spark, base).write, args=("T", rows(10 * k, 10 * k + 2)), kwargs={"token": f"t{k}"}) for k in range(2, 6)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert [m["batch"] for m in one.manifests("T")] == list(range(6)) and one.read("T").count() == 16
    # the same batch tried twice at once
    twins = [threading.Thread(target=BatchWriter(spark, base).write, args=("U", rows(0, 4)), kwargs={"token": "same"}) for _ in range(2)]
    for w in twins:
        w.start()
    for w in twins:
        w.join()
    assert one.read("U").count() == 4 and set(one.tables()) == {"T", "U"}
    one.write("U", spark.range(1).select("id", F.lit(1.5).alias("more")))
    assert sorted(one.read("U").columns) == ["_batch", "_seq", "id", "more", "v"]
    with pytest.raises(FileNotFoundError):
        one.read("nothing")


def test_extract_on_a_stream_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    parents = [{"id": k, "name": f"n{k}", "xs": [{"a": j, "b": str(j)} for j in range(k % 4)]} for k in range(12)]
    for part in range(3):
        (src / f"{part}.json").write_text("\n".join(json.dumps(p) for p in parents[part::3]))
    schema = "id long, name string, xs array<struct<a:int,b:string>>"
    name = f"test-{uuid.uuid4().hex}"
    for _ in range(2):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
        out = extract_stream(spark, stream, "xs", "parent_id", str(tmp_path / "out"), "P", "X", name=name)
    assert sorted(r["id"] for r in out["P"].collect()) == list(range(12)) and out["P"].columns == ["id", "name"]
    items = sorted((r["parent_id"], r["a"], r["id"]) for r in out["X"].collect())
    assert items == [(k, j, (k << 20) + j) for k in range(12) for j in range(k % 4)]
    # a micro-batch that is run again writes its own folders again
    batch = spark.read.schema(schema).json(str(src / "0.json"))
    before = out["X"].count()
    extract_batch(batch, "xs", "parent_id")[1].write.mode("overwrite").parquet(f"{tmp_path}/out/X/__mg_batch=0")
    assert spark.read.parquet(f"{tmp_path}/out/X").count() == before
