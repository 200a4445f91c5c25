"""Batch jobs: migrate a stored table set by a spec, or verify a written destination.

The spec is a JSON document ``{"schema": {...}, "log": [...]}`` in the plain-dict form.
Tables are Parquet folders (or files) named after their entity under a base path.
Results are written, never collected: the check table and the one-row report.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..operators.transforms import ROUTE_COL, apply_log
from ..sources.io import write_table_set
from ..sources.storage import exists, folders, read_text
from ..spec import Schema, log_from_dicts, require
from .verify import Verifier


def load_spec(spark: SparkSession, path: str):
    """Schema and log of a spec file on any storage; a log that cannot be replayed faithfully is an error."""
    d = json.loads(read_text(spark, path))
    schema, log = Schema.from_dict(d["schema"]), log_from_dicts(d["log"])
    require(schema, log)
    return schema, log


ROUTED = "_routed"


def _read(spark: SparkSession, base: str, names) -> dict:
    """Tables by name: ``{base}/{name}``, ``{base}/{name}.parquet``, or a sub-table folder
    ``{base}/_routed/{entity}/__mg_sub={name}`` written in one pass by ``migrate``.  Tables that are nowhere
    are left out, and so count as absent."""
    routed = {}
    for entity in folders(spark, f"{base}/{ROUTED}"):
        for sub in folders(spark, f"{base}/{ROUTED}/{entity}"):
            if sub.startswith(f"{ROUTE_COL}="):
                routed[sub.split("=", 1)[1]] = f"{base}/{ROUTED}/{entity}/{sub}"
    out = {}
    for n in names:
        found = next((p for p in (f"{base}/{n}", f"{base}/{n}.parquet") if exists(spark, p)), routed.get(n))
        if found is not None:
            out[n] = spark.read.parquet(found)
    return out


def migrate(spark: SparkSession, spec_path: str, source_base: str, dest_base: str, records: bool = False) -> list[str]:
    """Replay the spec's log over the stored source tables and write every destination table.

    ``records=True`` writes JSON lines in id order instead of Parquet.
    """
    schema, log = load_spec(spark, spec_path)
    src = _read(spark, source_base, schema.entities)
    missing = sorted(set(schema.entities) - set(src))
    if missing:
        raise FileNotFoundError(f"no source table for {', '.join(missing)} below {source_base}")
    routed: dict = {}
    dest = apply_log(src, log, blocks={b: list(f) for b, f in schema.blocks.items()}, routed=routed)
    if records:
        from ..sources.records import write_record_set
        write_record_set(dest, dest_base)
        return sorted(dest)
    # sub-tables of a partition: one pass over the entity, one folder per sub-table
    in_routed = {sub for _, subs in routed.values() for sub in subs}
    for entity, (frame, _) in routed.items():
        frame.write.mode("overwrite").partitionBy(ROUTE_COL).parquet(f"{dest_base}/{ROUTED}/{entity}")
    write_table_set({t: dest[t] for t in dest if t not in in_routed}, dest_base)
    # a sub-table with no rows has no partition folder: write it empty so it exists downstream
    for entity, (frame, subs) in routed.items():
        for sub in subs:
            if not exists(spark, f"{dest_base}/{ROUTED}/{entity}/{ROUTE_COL}={sub}"):
                dest[sub].write.mode("overwrite").parquet(f"{dest_base}/{sub}")
    return sorted(dest)


def verify(spark: SparkSession, spec_path: str, source_base: str, dest_base: str, out_base: str,
           dest_tables=None, records: bool = False) -> None:
    """Score a written destination; writes ``{out}/checks`` and ``{out}/report``.

    ``records=True`` reads each destination table as JSON lines into a record bag, so
    per-row value classes and present ``None`` are scored exactly.
    """
    from ..sources.records import read_record_set
    from ..spec import dest_kinds
    schema, log = load_spec(spark, spec_path)
    src = _read(spark, source_base, schema.entities)
    kinds = dest_kinds(schema, log)
    names = list(dest_tables) if dest_tables else list(kinds)
    if records:
        # the fields that any check looks at: expected ones, and those of the source that may be left over
        fields = {n: sorted({*kinds.get(n, {}), *(f for fs in schema.entities.values() for f in fs)}) for n in names}
        dest = read_record_set(spark, dest_base, fields)
    else:
        dest = _read(spark, dest_base, names)
    v = Verifier(schema, log, src, dest).store_parts()
    checks = v.checks()
    checks.write.mode("overwrite").parquet(f"{out_base}/checks")
    # the report is folded from the written check table, so the verification runs once
    from .verify import score_report
    score_report(spark.read.parquet(f"{out_base}/checks"), v.ctx.has_structural) \
        .write.mode("overwrite").parquet(f"{out_base}/report")


def main(argv=None) -> None:
    import argparse
    from ..session import get_spark

    ap = argparse.ArgumentParser(prog="python -m migrata.plans.jobs")
    ap.add_argument("command", choices=["migrate", "verify"])
    ap.add_argument("spec")
    ap.add_argument("source")
    ap.add_argument("dest")
    ap.add_argument("--out", default=None, help="folder for checks and report (verify)")
    ap.add_argument("--records", action="store_true", help="destination tables are JSON-lines records")
    a = ap.parse_args(argv)
    spark = get_spark()
    if a.command == "migrate":
        print(json.dumps(migrate(spark, a.spec, a.source, a.dest)))
    else:
        verify(spark, a.spec, a.source, a.dest, a.out or f"{a.dest}/_verification", records=a.records)


if __name__ == "__main__":
    main()
