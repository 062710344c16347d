"""A dictionary of terms that is stored and grows, and normalisation against it by joins.

Aliases are found by equality.  The fuzzy stage asks which aliases contain a text or are contained in it; whichever is shorter shares
all its trigrams with the other, so one trigram of each text, and one of each alias, the rarest, lead to all candidates.

Nothing here is broadcast by Spark's own estimate: that is made from the sizes of compressed files and does not know how many trigrams
come from a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labcurate.functions.parsing import strip
from labcurate.operators.dictionaries import Term
from labcurate.operators.joins import join_counted
from labcurate.operators.tables import Conflict, SnapshotTable

GRAM = 3
#: Terms with patterns are part of the expression that each distinct text goes through; more of them are refused.
PATTERNED = 1000
_TERMS = "ord long, term string, chinese_name string, formula string, aliases array<string>, patterns array<string>"


class TermStore:
    """Terms in order; a change is one version of a table, so what one job registers the next one knows."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8):
        self.spark = spark
        self._table = SnapshotTable(spark, path, StructType.fromDDL(_TERMS), unique=("term",), key="term", buckets=buckets)

    def terms(self) -> DataFrame:
        return self._table.read()

    def register(self, terms: DataFrame | tuple[Term, ...]) -> None:
        """Add terms (term, chinese_name, formula, aliases, patterns), a table in no order by ord; a known term is refused."""
        while True:
            base = self._table.version()
            last = self._table.read(base).agg(F.max("ord")).first()[0]
            start = 0 if last is None else last + 1
            if isinstance(terms, DataFrame):
                new = terms.withColumn("ord", F.col("ord") + start)
            else:
                new = self.spark.createDataFrame([(start + i, *t) for i, t in enumerate(terms)], _TERMS)
            try:
                self._table.append(new.select("ord", "term", "chinese_name", "formula", "aliases", "patterns"), base=base)
                return
            except Conflict:
                continue

    def add_aliases(self, aliases: DataFrame) -> None:
        """One more alias for each row (term, alias), behind those that are there; an unknown term is an error and changes nothing."""
        given = aliases.groupBy("term").agg(F.array_sort(F.collect_set("alias")).alias("more"))
        while True:
            base = self._table.version()
            known = self._table.rows_of(given, base)
            lost = given.join(known.hint("merge"), "term", "left_anti").first()
            if lost:
                raise ValueError(f"unknown term: {lost.term}")
            new = known.join(given.hint("merge"), "term").withColumn("aliases", F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), "more")))
            try:
                self._table.change(new=new, gone=given, base=base)
                return
            except Conflict:
                continue

    def standard(self, df: DataFrame, column: str, out: str, brackets: bool = False) -> DataFrame:
        """``df`` with the standard term of a text in ``out``, or the text as it is: by alias, by the first pattern, then by an alias that
        holds it or is held by it (with ``brackets`` instead by the name without brackets and blanks).

        Each distinct text is looked up once; texts of many rows are joined where the rows are.
        """
        terms = self.terms()
        values = df.groupBy(F.col(column).alias("__raw")).agg(F.count("*").alias("__n")).where(F.col("__raw").isNotNull())
        values = values.withColumn("__text", strip(F.col("__raw"))).withColumn("__low", F.lower("__text"))
        texts = values.where(F.col("__low") != "").select("__low", "__text").distinct()
        found = _by_alias(texts, terms).withColumn("__stage", F.lit(1))
        found = found.unionByName(_by_pattern(texts, terms).withColumn("__stage", F.lit(2)))
        found = found.unionByName((_without_brackets if brackets else _fuzzy)(texts, terms).withColumn("__stage", F.lit(3)))
        best = found.groupBy("__text").agg(F.min_by("__term", "__stage").alias("__term"))
        names = values.join(best.hint("merge"), "__text", "left").select("__raw", F.coalesce("__term", "__raw").alias("__standard"), "__n")
        named = join_counted(df.withColumn("__raw", F.col(column)), names, "__raw", "__n")
        return named.withColumn(out, F.col("__standard")).drop("__raw", "__standard", "__n")


def _aliases(terms: DataFrame) -> DataFrame:
    """Each alias once, with the first term that has it and its place."""
    every = terms.select("ord", "term", F.posexplode("aliases").alias("at", "alias")).withColumn("place", F.struct("ord", "at"))
    return every.groupBy("alias").agg(F.min("place").alias("place"), F.min_by("term", "place").alias("term"))


def _by_alias(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """A later term's alias replaces an earlier one's."""
    every = terms.select("ord", "term", F.explode(F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    index = every.groupBy(F.lower("alias").alias("__low")).agg(F.max_by("term", "ord").alias("__term"))
    return texts.join(index.hint("merge"), "__low").select("__text", "__term")


def _by_pattern(texts: DataFrame, terms: DataFrame) -> DataFrame:
    rows = terms.where(F.size("patterns") > 0).select("ord", "term", "patterns").limit(PATTERNED + 1).collect()
    if len(rows) > PATTERNED:
        raise ValueError(f"more than {PATTERNED} terms have patterns")
    tests = [F.when(F.col("__text").rlike("|".join(f"(?iuU:{p})" for p in r.patterns)), F.lit(r.term)) for r in sorted(rows)]
    return texts.select("__text", F.coalesce(*tests, F.lit(None).cast("string")).alias("__term")).where(F.col("__term").isNotNull())


def _grams(c: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (GRAM - 1)), lambda i: F.substr(c, i, F.lit(GRAM))))


def _rarest(df: DataFrame, column: str, other: DataFrame, keep: list[str]) -> DataFrame:
    """Each row once with that of its trigrams which ``other`` (gram) holds least often; rows with one that it never holds go."""
    grams = df.select(*keep, F.explode(_grams(F.col(column))).alias("gram"))
    counts = other.groupBy("gram").agg(F.count("*").alias("__c"))
    some = grams.join(counts.hint("merge"), "gram", "left").groupBy(*keep).agg(F.min(F.struct(F.coalesce("__c", F.lit(0)).alias("c"), "gram")).alias("m"))
    return some.where("m.c > 0").select(*keep, F.col("m.gram").alias("gram"))


def _fuzzy(texts: DataFrame, terms: DataFrame) -> DataFrame:
    long = texts.where(F.length("__low") >= GRAM)
    aliases = _aliases(terms).where(F.length("alias") >= GRAM)
    alias_grams = aliases.select("alias", F.explode(_grams(F.col("alias"))).alias("gram"))
    text_grams = long.select("__low", "__text", F.explode(_grams(F.col("__low"))).alias("gram"))
    held = _rarest(long, "__low", alias_grams, ["__low", "__text"]).join(alias_grams.hint("merge"), "gram").where(F.contains("alias", F.col("__low")))
    holds = _rarest(aliases, "alias", text_grams, ["alias"]).join(text_grams.hint("merge"), "gram").where(F.contains("__low", F.col("alias")))
    letters = lambda c: F.array_remove(F.array_distinct(F.split(c, "")), "")
    columns = ["__low", "__text", "alias"]
    near = held.select(columns).unionByName(holds.select(columns)).where(F.size(F.array_intersect(letters(F.col("__low")), letters(F.col("alias")))) >= F.least(F.length("__low"), F.length("alias")) * 0.7)
    return near.join(aliases.hint("merge"), "alias").groupBy("__text").agg(F.min_by("term", "place").alias("__term"))


def _without_brackets(texts: DataFrame, terms: DataFrame) -> DataFrame:
    bare = lambda c: F.regexp_replace(F.lower(c), r"[ \[\]]", "")
    index = terms.groupBy(bare("term").alias("__bare")).agg(F.min_by("term", "ord").alias("__term"))
    return texts.withColumn("__bare", bare("__low")).join(index.hint("merge"), "__bare").select("__text", "__term")
