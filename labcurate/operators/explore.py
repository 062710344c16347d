"""Search, facets, listings and summaries over records and their parents."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labcurate.functions.parsing import blank_to_null, strip

SEARCH_ROWS = 1000


@dataclass(frozen=True)
class Filter:
    """Every part is optional: value lists, and ranges with both ends included."""

    values: dict[str, list] | None = None
    ranges: dict[str, tuple[float | None, float | None]] | None = None

    def condition(self) -> Column:
        parts = [F.col(c).isin(xs) for c, xs in (self.values or {}).items() if xs]
        for c, (low, high) in (self.ranges or {}).items():
            parts += [F.col(c) >= low] if low is not None else []
            parts += [F.col(c) <= high] if high is not None else []
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def search(records: DataFrame, parents: DataFrame, key: str, wanted: Filter, order: list[str], parent_columns: list[str], limit: int = SEARCH_ROWS) -> DataFrame:
    """Filtered records with their parent as a struct, null where there is none.

    The filter and the limit come before the join, so at most ``limit`` rows look for a parent and the filter reaches the scan.
    """
    top = records.where(wanted.condition()).orderBy(*order).limit(limit)
    p = parents.select(F.col(key).alias("__key"), F.struct(*parent_columns).alias("parent"))
    return top.join(p, F.col(key) == F.col("__key"), "left").drop("__key")


def options(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value): the distinct values of each column, without null and empty, in code-point order; one scan."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    return df.select(pairs).select("p.*").where(F.col("value") != "").distinct().orderBy("facet", "value")


def option_lists(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, options): the values of options() of each column as one array in code-point order."""
    return options(df, columns).groupBy("facet").agg(F.array_sort(F.collect_list("value")).alias("options"))


def summary(records: DataFrame, parents: DataFrame, value: str) -> DataFrame:
    """Totals, and least, greatest and mean of a value; a mean of 0 is reported as null."""
    a = records.agg(F.count("*").alias("total_records"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.nullif(F.avg(value), F.lit(0.0)).alias("avg_value"), F.lit(1).alias("__one"))
    b = parents.agg(F.count("*").alias("total_parents"), F.lit(1).alias("__one"))
    return a.join(b, "__one").drop("__one")


def facet_name(c: Column) -> Column:
    return F.coalesce(blank_to_null(strip(c)), F.lit("Unknown"))


def facet_counts(df: DataFrame, column: str, order: str, needle: str | None = None, top: int | None = None) -> DataFrame:
    """(value, n, first_seen), most frequent first, ties in order of first appearance."""
    return _most_frequent(df.groupBy(facet_name(F.col(column)).alias("value")).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")), needle, top)


def _most_frequent(out: DataFrame, needle: str | None, top: int | None) -> DataFrame:
    if needle:
        out = out.where(F.contains(F.lower("value"), F.lit(needle.lower())))
    out = out.orderBy(F.col("n").desc(), "first_seen", "value")
    return out.limit(top) if top else out


def facet_rows(df: DataFrame, column: str, value: str) -> DataFrame:
    """The rows behind a facet; 'All' gives every row."""
    return df if value == "All" else df.where(facet_name(F.col(column)) == value)


def page_of(df: DataFrame, newest: str, key: str, offset: int = 0, limit: int = 100) -> DataFrame:
    return df.orderBy(F.col(newest).desc(), F.col(key).desc()).offset(offset).limit(limit)


def page_after(df: DataFrame, newest: str, key: str, after: tuple | None = None, limit: int = 100) -> DataFrame:
    """The page that follows the row with these values of ``newest`` and ``key``; the first without them.  Nothing is sorted to be skipped:
    older rows are chosen in the scan.  Rows without a date come last, after a row with one as after (None, key)."""
    if after is not None:
        when, last = after
        if when is None:
            df = df.where(F.col(newest).isNull() & (F.col(key) < last))
        else:
            df = df.where((F.col(newest) <= F.lit(when)) | F.col(newest).isNull())  # for the scan
            df = df.where(F.col(newest).isNull() | (F.col(newest) < F.lit(when)) | (F.col(key) < last))
    return df.orderBy(F.col(newest).desc_nulls_last(), F.col(key).desc()).limit(limit)


#: Partial aggregates of records by facet value; the empty facet holds all records.
PARTIALS = "facet string, value string, rows long, first_seen long, n double, total double, least double, greatest double"


def partials(rows: DataFrame, facets: list[str], measure: str, order: str, by: str) -> DataFrame:
    """PARTIALS for each value of ``by``: counts and sums that can be merged."""
    each = [F.struct(F.lit("").alias("facet"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in facets]]
    m = F.col(measure)
    out = rows.select(by, order, measure, F.explode(F.array(*each)).alias("f")).groupBy(by, "f.facet", "f.value")
    return out.agg(F.count("*").alias("rows"), F.min(order).alias("first_seen"), F.count(m).cast("double").alias("n"), F.sum(m).alias("total"), F.min(m).alias("least"), F.max(m).alias("greatest"))


def merged_summary(parts: DataFrame, total_parents: int) -> DataFrame:
    """As summary(), from partials."""
    a = parts.where("facet = ''").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total_records"), F.min("least").alias("min_value"), F.max("greatest").alias("max_value"), F.nullif(F.sum("total") / F.nullif(F.sum("n"), F.lit(0.0)), F.lit(0.0)).alias("avg_value"))
    return a.withColumn("total_parents", F.lit(total_parents).cast("long"))


def merged_option_lists(parts: DataFrame) -> DataFrame:
    """As option_lists(), from partials."""
    return parts.where("facet <> '' AND value <> ''").groupBy("facet").agg(F.array_sort(F.collect_set("value")).alias("options"))


def merged_facet_counts(parts: DataFrame, column: str, needle: str | None = None, top: int | None = None) -> DataFrame:
    """As facet_counts(), from partials."""
    out = parts.where(F.col("facet") == column).groupBy(facet_name(F.col("value")).alias("value")).agg(F.sum("rows").alias("n"), F.min("first_seen").alias("first_seen"))
    return _most_frequent(out, needle, top)


def with_children(parents: DataFrame, children: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Adds ``children``, an array of structs in order, empty for a parent without any."""
    lists = children.groupBy(F.col(key).alias("__key")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("children"))
    joined = parents.join(lists, F.col(key) == F.col("__key"), "left").drop("__key")
    kind = lists.schema["children"].dataType
    return joined.withColumn("children", F.coalesce("children", F.array().cast(kind)))


def children_of_known(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent exists."""
    return children.join(parents.select(key), key, "left_semi")


def by_key(df: DataFrame, column: str, value: object) -> DataFrame:
    """The row with a key, or none; an empty key finds nothing."""
    return df.where((F.col(column) == value) & F.lit(value not in (None, ""))).limit(1)


def batch_stats(files: DataFrame, status: str, records: str, warned: str) -> DataFrame:
    return files.agg(F.count("*").alias("total"), F.count_if(F.col(status).isin("completed", "success")).alias("completed"), F.coalesce(F.sum(records), F.lit(0)).alias("records"), F.count_if(F.col(warned)).alias("with_warnings"))


def has_warnings(records: DataFrame, key: str, cof: str) -> DataFrame:
    """For each file whether a coefficient is empty or a stand-in for nothing."""
    lost = F.col(cof).isNull() | F.col(cof).isin("", "-", "null")
    return records.groupBy(key).agg(F.bool_or(lost).alias("has_warnings"), F.count("*").alias("n_records"))


def scatter(records: DataFrame, x: str, y: str, extra: list[str]) -> DataFrame:
    """Points of a chart: rows with both numbers."""
    return records.dropna(subset=[x, y]).select(F.col(x).alias("x"), F.col(y).alias("y"), *extra)


def latest_context(turns: DataFrame, key: str, order: str, text: str, most: int = 2000) -> DataFrame:
    """The newest text of each key, cut to what a chat may see."""
    return turns.groupBy(key).agg(F.max_by(text, order).alias("__t")).select(key, F.substring("__t", 1, most).alias("context"))
