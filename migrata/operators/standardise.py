"""Values made uniform: mapping tables (T3, P4), text and currency standardisation (E5), mixed date formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import SpecError

# currency signs and the codes they stand for (fixed values)
CURRENCY_SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}


# ---------------------------------------------------------------------------
# A mapping as a table
# ---------------------------------------------------------------------------
def check_mapping(mapping: DataFrame, key: str = "key", value: str = "value") -> None:
    """A mapping table gives every key one value: refuse null keys and keys with several values (rows that repeat are fine)."""
    bad = (mapping.select(F.col(f"`{key}`").alias("k"), F.col(f"`{value}`").alias("v")).distinct().groupBy("k")
           .agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR k IS NULL").orderBy("k").limit(5).collect())
    if bad:
        raise SpecError(f"mapping keys that are null or have several values: {[r.k for r in bad]}")


def remap_by_table(df: DataFrame, column: str, mapping: DataFrame, key: str = "key", value: str = "value", default: str = "self",
                   suffix: str = "", normalise=None) -> DataFrame:
    """T3 / P4 for maps of any size: a left equi-join with ``mapping``, checked first (``check_mapping``).

    ``default``: what a value without an entry becomes, ``self``, ``null`` or ``suffix``, as in ``values.remap``.  ``normalise``
    (a function of a column, such as ``plain_text``) is applied to both sides of the comparison.  A broadcast is Spark's choice,
    by the mapping's measured size; otherwise AQE splits hot values in a sort-merge join.
    """
    if default not in ("self", "null", "suffix"):
        raise ValueError(f"unknown default {default!r}")
    form = normalise or (lambda c: c)
    table = mapping.select(form(F.col(f"`{key}`")).alias("__mg_k"), F.col(f"`{value}`").alias("__mg_v")).distinct()
    check_mapping(table, "__mg_k", "__mg_v")
    own = F.col(f"`{column}`")
    hit = F.col("__mg_k").isNotNull()
    other = {"self": own, "null": F.lit(None).cast("string"), "suffix": F.concat(own, F.lit(suffix))}[default]
    joined = df.withColumn("__mg_f", form(own)).join(table, F.col("__mg_f") == F.col("__mg_k"), "left")
    return joined.select(*[F.when(hit, F.col("__mg_v")).otherwise(other).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])


# ---------------------------------------------------------------------------
# E5: text and currency
# ---------------------------------------------------------------------------
def plain_text(c: Column) -> Column:
    """Lower case, outer blanks off, inner runs of white space as one blank."""
    return F.lower(F.trim(F.regexp_replace(c.cast("string"), r"\s+", " ")))


def currency(c: Column) -> Column:
    """The currency an amount text names, by sign or three-letter code; null if none."""
    out = F.nullif(F.regexp_extract(F.upper(c), r"(?<![A-Z])([A-Z]{3})(?![A-Z])", 1), F.lit(""))
    for sign, code in CURRENCY_SIGNS.items():
        out = F.when(c.contains(sign), F.lit(code)).otherwise(out)
    return out


def amount(c: Column, scale: int = 2) -> Column:
    """The amount of a currency text as DECIMAL(38, scale); null where the text is no amount.

    Signs, codes and blanks go; brackets or a leading or trailing minus mean a negative amount.  If both ``.`` and ``,`` occur the last of them
    is the decimal mark; a mark that occurs once is one unless exactly three digits follow it (then it
    groups thousands); a mark that occurs several times groups thousands.
    """
    bare = F.regexp_replace(F.upper(c), r"[A-Z$€£¥\s '_]", "")
    negative = bare.rlike(r"^\(.*\)$") | bare.rlike(r"^-|-$")
    digits = F.regexp_replace(bare, r"^[-+(]+|[-)]+$", "")
    dot, comma = F.locate(".", F.reverse(digits)), F.locate(",", F.reverse(digits))
    dots, commas = (F.length(digits) - F.length(F.replace(digits, F.lit(m), F.lit(""))) for m in (".", ","))
    single = F.when(dots == 1, dot).when(commas == 1, comma)
    mark = (F.when((dots > 0) & (commas > 0), F.least(dot, comma)).when((dots + commas == 1) & (single != 4), single).otherwise(F.lit(0)))
    whole = F.when(mark > 0, F.substring(digits, F.lit(1), F.length(digits) - mark)).otherwise(digits)
    part = F.when(mark > 0, F.substring(digits, F.length(digits) - mark + 2, F.length(digits))).otherwise(F.lit(""))
    grouped = whole.rlike(r"^\d{1,3}([.,]\d{3})*$") | whole.rlike(r"^\d+$")
    number = F.concat(F.regexp_replace(whole, "[.,]", ""), F.lit("."), F.concat(part, F.lit("0")))
    value = F.when(grouped & part.rlike(r"^\d*$"), number.try_cast(f"decimal(38,{scale})"))
    return F.when(negative, -value).otherwise(value).cast(f"decimal(38,{scale})")


# ---------------------------------------------------------------------------
# Mixed date formats
# ---------------------------------------------------------------------------
_NUMERIC = r"^\s*(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})\s*$"


def date_evidence(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Per column (and per value of ``by``) the rows that show the day first (first number above 12), the month first
    (second above 12) or neither, and the decision: ``day_first``, ``month_first``, ``mixed``, ``ambiguous`` or ``none``."""
    first, second = (F.regexp_extract(F.col(f"`{column}`"), _NUMERIC, k).try_cast("int") for k in (1, 2))
    rows = df.select((F.col(f"`{by}`") if by else F.lit(None).cast("string")).alias("part"), first.alias("x"), second.alias("y"))
    counts = rows.groupBy("part").agg(
        F.count_if((F.col("x") > 12) & (F.col("y") <= 12)).alias("n_day_first"), F.count_if((F.col("y") > 12) & (F.col("x") <= 12)).alias("n_month_first"),
        F.count_if((F.col("x") <= 12) & (F.col("y") <= 12)).alias("n_either"))
    day, month = F.col("n_day_first") > 0, F.col("n_month_first") > 0
    decision = (F.when(day & month, "mixed").when(day, "day_first").when(month, "month_first").when(F.col("n_either") > 0, "ambiguous").otherwise("none"))
    return counts.select(F.lit(column).alias("column_name"), "part", "n_day_first", "n_month_first", "n_either", decision.alias("decision"))


def normalise_dates(df: DataFrame, column: str, by: str | None = None, pivot: int = 70, out: str = "parsed") -> DataFrame:
    """``df`` with ``out`` (DATE) and ``reject`` (why there is none; null if there is one, or no text).

    ISO texts (``2024-03-01``, with or without a time), ``20240301`` and ``1 Mar 2024`` parse as they stand.  Texts of numbers such as ``03/04/2024``
    follow the decision of ``date_evidence`` for the column (per value of ``by``, as different sources write differently).  In mixed
    and ambiguous columns only rows that show their order themselves (a number above 12, or two equal ones) parse; the
    others are rejected as ``ambiguous``, never guessed.  Two-digit years from ``pivot`` on are 19xx.
    """
    evidence = date_evidence(df, column, by).select(F.col("part").alias("__mg_part"), "decision")
    text = F.trim(F.col(f"`{column}`"))
    part = F.col(f"`{by}`") if by else F.lit(None).cast("string")
    rows = df.withColumn("__mg_by", part).join(evidence, F.col("__mg_by").eqNullSafe(F.col("__mg_part")), "left")
    x, y, z = (F.regexp_extract(F.col(f"`{column}`"), _NUMERIC, k) for k in (1, 2, 3))
    year = F.when(F.length(z) == 2, F.concat(F.when(z.try_cast("int") >= pivot, F.lit("19")).otherwise(F.lit("20")), z)).otherwise(z)
    xi, yi = x.try_cast("int"), y.try_cast("int")
    day_first = F.when((xi > 12) | (xi == yi), True).when(yi > 12, False).when(F.col("decision") == "day_first", True).when(F.col("decision") == "month_first", False)
    # a row against the decision of its column is no date of that column
    against = ((F.col("decision") == "day_first") & (yi > 12)) | ((F.col("decision") == "month_first") & (xi > 12))
    numeric = x != ""
    built = F.concat_ws("-", year, F.lpad(F.when(day_first, y).otherwise(x), 2, "0"), F.lpad(F.when(day_first, x).otherwise(y), 2, "0"))
    parsed = F.coalesce(
        F.when(numeric & day_first.isNotNull() & ~against, F.try_to_date(built, "yyyy-MM-dd")),
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")),
        F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd")),
        F.when(text.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}$"), F.try_to_date(F.initcap(text), "d MMM yyyy")))
    reject = F.when(text.isNull() | (text == ""), F.lit(None).cast("string")).when(parsed.isNotNull(), F.lit(None).cast("string")).when(
        numeric & day_first.isNull(), "ambiguous").otherwise("unparsed")
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], parsed.alias(out), reject.alias("reject"))
