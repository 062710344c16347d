"""Entity normalisation against a small dictionary: alias, pattern, then a fuzzy or bracket-free comparison; the first that hits wins.

The dictionaries are constants of fixed size, so the chain is one Column expression without a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labcurate.functions.parsing import bound, strip
from labcurate.operators.dictionaries import LIQUIDS, SURFACES, Term


def alias_index(terms: tuple[Term, ...]) -> dict[str, str]:
    """Lower-cased alias -> term; a later entry replaces an earlier one."""
    return {a: t.term for t in terms for a in (t.term.lower(), *(x.lower() for x in t.aliases))}


def dictionary(spark: SparkSession, terms: tuple[Term, ...]) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(terms)], "ord int, term string, chinese_name string, formula string, aliases array<string>, patterns array<string>")


def _by_alias(low: Column, terms: tuple[Term, ...]) -> Column:
    return F.create_map(*[F.lit(x) for kv in alias_index(terms).items() for x in kv])[low]


def _by_pattern(text: Column, terms: tuple[Term, ...]) -> Column:
    """The first term, in order, one of whose patterns is found anywhere."""
    return F.coalesce(*[F.when(text.rlike("|".join(f"(?iuU:{p})" for p in t.patterns)), F.lit(t.term)) for t in terms])


def _characters(c: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(c, "")), "")


def _fuzzy(low: Column, terms: tuple[Term, ...]) -> Column:
    """The first alias that contains the text or is contained in it, both of three characters at least, with enough characters in common."""
    aliases = F.array(*[F.struct(F.lit(t.term).alias("term"), F.lit(a).alias("alias")) for t in terms for a in t.aliases if len(a) >= 3])
    near = lambda x: (
        (F.contains(low, x["alias"]) | F.contains(x["alias"], low)) & (F.length(low) >= 3) & (F.size(F.array_intersect(_characters(low), _characters(x["alias"]))) >= F.least(F.length(low), F.length(x["alias"])) * 0.7)
    )
    return F.get(F.filter(aliases, near), 0)["term"]


def _without_brackets(low: Column, terms: tuple[Term, ...]) -> Column:
    bare = F.regexp_replace(low, r"[ \[\]]", "")
    names = {}
    for t in reversed(terms):
        names["".join(c for c in t.term.lower() if c not in " []")] = t.term
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[bare]


def _first_of(c: Column, stages: Callable[[Column, Column], list[Column]]) -> Column:
    """The first of the stages (of the stripped text and its lower case) that hits, or the text as it is."""
    chain = lambda given: bound(strip(given), lambda text: bound(F.lower(text), lambda low: F.when(low == "", given).otherwise(F.coalesce(*stages(text, low), given))))
    return bound(c, chain)


def surface(c: Column, terms: tuple[Term, ...] = SURFACES) -> Column:
    """The standard surface, or the text as it is."""
    return _first_of(c, lambda text, low: [_by_alias(low, terms), _by_pattern(text, terms), _fuzzy(low, terms)])


def liquid(c: Column, terms: tuple[Term, ...] = LIQUIDS) -> Column:
    """The standard ionic liquid, or the text as it is."""
    return _first_of(c, lambda text, low: [_by_alias(low, terms), _by_pattern(text, terms), _without_brackets(low, terms)])


def term_info(spark: SparkSession, df: DataFrame, column: str, terms: tuple[Term, ...]) -> DataFrame:
    """Adds chinese_name and formula of a standard term; null for others."""
    info = dictionary(spark, terms).select(F.col("term").alias("__term"), "chinese_name", "formula")
    return df.join(F.broadcast(info), F.col(column) == F.col("__term"), "left").drop("__term")  # the dictionary has a fixed size


def with_alias(terms: tuple[Term, ...], term: str, alias: str) -> tuple[Term, ...]:
    """The dictionary with one more alias; an unknown term is an error."""
    if term not in standards(terms):
        raise ValueError(f"unknown term: {term}")
    return tuple(t._replace(aliases=(*t.aliases, alias)) if t.term == term else t for t in terms)


def standards(terms: tuple[Term, ...]) -> list[str]:
    return [t.term for t in terms]
