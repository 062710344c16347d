"""What happens to records in review: defaults, quarantine, edits, labels and run totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from labcurate.functions import parsing as P

REQUIRED = ("material_name",)


def with_client_ids(df: DataFrame, file_col: str, order: str) -> DataFrame:
    """A record's own id, else file, hyphen, place; the same each time."""
    return df.withColumn("id", F.coalesce(P.blank_to_null(F.col("id")), F.concat_ws("-", F.col(file_col), F.col(order))))


def metadata_to_sync(df: DataFrame, file_col: str) -> DataFrame:
    """Fill blanks where a title or an identifier is there; else a temporary identifier from the file, 'Untitled' and this year."""
    has = lambda c: F.coalesce(P.strip(F.col(c)) != "", F.lit(False))
    known = has("title") | has("doi")
    return df.withColumns({
        "doi": F.when(known, F.coalesce("doi", F.lit(""))).otherwise(F.concat(F.lit("temp-"), F.col(file_col))),
        "title": F.when(has("title"), F.col("title")).otherwise(F.lit("Untitled")),
        "authors": F.coalesce("authors", F.lit("")),
        "journal": F.coalesce("journal", F.lit("")),
        "year": F.when(known & F.col("year").isNotNull(), F.col("year")).otherwise(F.year(F.current_date())),
    })


def field_errors(df: DataFrame) -> Column:
    """array<string>: which constraints a row breaks; columns that are not there break none but the required ones."""
    checks = [F.when(P.strip(F.col(c)).isNull() | (P.strip(F.col(c)) == ""), F.lit(f"{c} is required")) if c in df.columns else F.lit(f"{c} is required") for c in REQUIRED]
    if "confidence" in df.columns:
        checks.append(F.when(~F.col("confidence").between(0.0, 1.0), F.lit("confidence is out of range")))
    if "year" in df.columns:
        checks.append(F.when(~F.col("year").between(1900, 2100), F.lit("year is out of range")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``errors``)"""
    marked = df.withColumn("errors", field_errors(df))
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def edited(df: DataFrame, column: str, new_value: Column, status: str = "status") -> DataFrame:
    """Set a field, keep the first value it had in ``<column>_original`` and mark rows that change as modified."""
    changed = ~F.col(column).eqNullSafe(new_value)
    first = f"{column}_original"
    before = F.coalesce(F.col(first), F.col(column)) if first in df.columns else F.col(column)
    return df.withColumns({first: F.when(changed, before).otherwise(F.col(first) if first in df.columns else F.lit(None)), status: F.when(changed, F.lit("modified")).otherwise(F.col(status)), column: F.when(changed, new_value).otherwise(F.col(column))})


def signed_value(operator: Column, value: Column) -> Column:
    """Operator and value side by side, a hyphen without value."""
    return F.coalesce(F.concat(F.coalesce(operator, F.lit("")), value.cast("string")), F.lit("-"))


def shown_number(value: Column) -> Column:
    """A hyphen for nothing and for 0."""
    return F.coalesce(F.nullif(value, F.lit(0).cast("double")).cast("string"), F.lit("-"))


def run_totals(results: DataFrame, error: str, records: str) -> DataFrame:
    """Files that succeeded and failed, and the records of those that succeeded."""
    ok = F.col(error).isNull()
    return results.agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col(records))), F.lit(0)).alias("records"))


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` and an observation of its row count, filled in when the rows are written: no second pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def clock(c: Column) -> Column:
    return F.date_format(c, "HH:mm")
