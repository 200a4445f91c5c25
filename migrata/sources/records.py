"""Record bags: JSON-lines destinations with per-row value classes and present ``None``.

Scripts write destinations as records (one JSON object per line).  Two rows of one table
may hold different value classes in one field (``5`` and ``"5"``), and a key may be
missing or present with ``null``; both matter to the score.  ``read_records`` parses each
line as a VARIANT (``parse_json``) and splits every field by value class:

* one class, never ``null``  -> a plain typed column ``f``
* otherwise                  -> ``f__mgt0``, ``f__mgt1``, ... (one typed column per class,
                                null where the row holds another class) and
                                ``f__mgnone`` (true where the key holds ``null``)

A missing key leaves every column of the field null.  JSON integers become BIGINT,
numbers with a fraction or exponent DOUBLE (Python reads them as float), ``true/false``
BOOLEAN, strings STRING, arrays ``ARRAY<VARIANT>`` and objects VARIANT.

The field list and the classes per field are metadata (at most fields x classes rows)
and are the only things collected.
"""

from __future__ import annotations

from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import NONE_TAG, VAR_TAG
from .storage import exists

SEQ = "_seq"
CLASS_TYPES = {"long": "bigint", "double": "double", "bool": "boolean", "string": "string",
               "array": "array<variant>", "object": "variant"}
CLASS_ORDER = ("long", "double", "bool", "string", "array", "object")


def _path(field: str) -> str:
    return "$['" + field.replace("'", "\\'") + "']"


def value_class(v: Column) -> Column:
    """Value class of a VARIANT value (null for a missing key, ``null`` for JSON null)."""
    t = F.schema_of_variant(v)
    return (F.when(v.isNull(), F.lit(None))
            .when(F.is_variant_null(v), F.lit("null"))
            .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit("long"))
            .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), F.lit("double"))
            .when(t == "BOOLEAN", F.lit("bool"))
            .when(t == "STRING", F.lit("string"))
            .when(t.startswith("ARRAY"), F.lit("array"))
            .otherwise(F.lit("object")))


def _part(file: Column) -> Column:
    """The number of a file that Spark wrote (its digits are padded to five, so names alone misplace the 100,000th), else 0."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(file, r"^part-(\d{1,18})-", 1), F.lit("")), F.lit("9" * 18)).cast("bigint"), F.lit(0).cast("bigint"))


def parse_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """One VARIANT ``rec`` per non-blank line, with ``_seq`` = place in the table.

    Spark reads files by size, so the place is (file, block of the file, line), by the file's name: writers
    number their files.  Lines that come from no file keep their order in the frame.
    """
    at = F.monotonically_increasing_id()
    if "file" in lines.columns and "block" in lines.columns:
        seq = F.struct(_part(F.col("file")).alias("part"), F.col("file"), F.col("block"), at.alias("line"))
    else:
        seq = F.struct(F.lit(0).cast("bigint").alias("part"), F.lit("").alias("file"), F.lit(0).cast("bigint").alias("block"), at.alias("line"))
    return lines.select(column, seq.alias(SEQ)).filter(F.trim(F.col(column)) != "").select(
        F.parse_json(F.col(column)).alias("rec"), SEQ)


def records_to_table(recs: DataFrame, fields: Iterable[str] | None = None, keep_seq: bool = True) -> DataFrame:
    """Split every field of a ``rec`` VARIANT column by value class (see module doc)."""
    if fields is None:
        keys = recs.select(F.explode(F.map_keys(F.from_json(F.to_json("rec"), "map<string,string>"))).alias("k"))
        fields = sorted(r.k for r in keys.distinct().collect())
    fields = list(fields)
    if not fields:
        return recs.select(*([F.col(SEQ)] if keep_seq and SEQ in recs.columns else []))
    probe = recs.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("f"), value_class(F.variant_get("rec", _path(f), "variant")).alias("c"))
        for f in fields])).alias("p")).select("p.*").filter(F.col("c").isNotNull()).distinct()
    classes: dict[str, set[str]] = {}
    for r in probe.collect():
        classes.setdefault(r.f, set()).add(r.c)
    cols = []
    for f in fields:
        v = F.variant_get("rec", _path(f), "variant")
        cls = value_class(v)
        present = [c for c in CLASS_ORDER if c in classes.get(f, set())]
        has_null = "null" in classes.get(f, set())
        if not present and not has_null:
            continue
        if len(present) == 1:
            names = [(present[0], f)]
        else:
            names = [(c, f"{f}{VAR_TAG}{k}") for k, c in enumerate(present)]
        for c, name in names:
            cols.append(F.when(cls == c, F.try_variant_get("rec", _path(f), CLASS_TYPES[c])).alias(name))
        if has_null:
            cols.append(F.coalesce(cls == "null", F.lit(False)).alias(f"{f}{NONE_TAG}"))
    if keep_seq and SEQ in recs.columns:
        cols.append(F.col(SEQ))
    return recs.select(*cols)


def read_records(spark: SparkSession, path: str, fields: Iterable[str] | None = None) -> DataFrame:
    """A JSON-lines table as a record bag (blank lines skipped)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return records_to_table(parse_records(lines), fields)


def read_record_set(spark: SparkSession, base: str, fields: Mapping[str, Iterable[str]]) -> dict[str, DataFrame]:
    """Record bags ``{base}/{name}`` with the given fields per table (absent folders stay absent)."""
    return {n: read_records(spark, f"{base}/{n}", f) for n, f in fields.items() if exists(spark, f"{base}/{n}")}


def write_records(df: DataFrame, path: str, order: Sequence[str] = ("id",), mode: str = "overwrite") -> None:
    """``df`` as JSON lines whose order of files and lines is that of ``order`` (nulls first).

    A destination of records is a list: its place in the list is what extract fidelity compares.  Rows are dealt by
    ranges of ``order`` and sorted, and Spark numbers the files by range, so ``read_records`` (file, block, line)
    gives them back in that order, however many files there are.  Null columns are left out of a record.
    """
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in order if c in df.columns]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
    rows.write.mode(mode).json(path)


def write_record_set(tables: Mapping[str, DataFrame], base: str, order: Sequence[str] = ("id",)) -> None:
    """Every table as an ordered JSON-lines folder ``{base}/{name}``."""
    for name, df in tables.items():
        write_records(df, f"{base}/{name}", order)
