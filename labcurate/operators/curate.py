"""From raw extracted records to clean, deduplicated and scored ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labcurate.functions import json_fields as J
from labcurate.functions import parsing as P
from labcurate.functions import scoring as S
from labcurate.operators import terms


def records_of_answers(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """One row for each record in the answers, in order: the answers' columns, ``pos`` and the record's text fields."""
    parsed = answers.withColumn("__j", J.answer_json(F.col(answer)))
    rows = parsed.select("*", F.posexplode(J.listed_records(F.col("__j"))).alias("pos", "__v")).withColumn("__r", J.record_struct(F.col("__v")))
    return rows.drop(answer, "__v", "__j").select("*", "__r.*").drop("__r")


def has_measurement(cof: Column, friction: Column) -> Column:
    """The record gate: a coefficient or a friction force that reads like a number."""
    return P.is_numeric_entry(cof) | P.is_numeric_entry(friction)


def best_of_each(df: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """Of the rows of each key the one with the highest score, the earliest of equals.  One shuffle, and partial maxima before it."""
    best = F.max_by(F.struct(*df.columns), F.struct(F.col(score), -F.col(order))).alias("__best")
    return df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(best, F.min(order).alias("first_seen")).select("__best.*", "first_seen")


def deduplicate(records: DataFrame, order: str = "seq", fix: bool = False, within: tuple[str, ...] = ()) -> DataFrame:
    """Sanitise the numbers, drop records without a usable coefficient and keep the most complete record of each fingerprint.

    With ``within`` the same fingerprint in another group of these columns is another record.  The result has ``first_seen``, the place of the fingerprint's first record; its order is the output order.
    """
    clean = records.withColumns({
        "cof_clean": P.sanitize_cof(F.col("cof"), fix),
        "temperature": P.sanitize_numeric(F.col("temperature")),
        "normal_load": P.sanitize_numeric(F.col("normal_load")),
        "speed": P.sanitize_numeric(F.col("speed")),
        "potential": P.sanitize_potential(F.col("potential")),
    }).where(F.col("cof_clean").isNotNull())
    clean = clean.withColumns({
        "fp": F.concat_ws("|", P.fingerprint_text(F.col("material_name")), P.fingerprint_text(F.col("ionic_liquid")), F.expr("format_number(cof_clean, '0.000')"), P.fingerprint_text(F.col("potential"), fix)),
        "info": S.information(F.col("normal_load"), F.col("speed"), F.col("temperature"), F.col("potential"), F.col("ionic_liquid")),
    })
    return best_of_each(clean, [*within, "fp"], "info", order)


def curate(records: DataFrame, order: str = "seq", fix: bool = False, within: tuple[str, ...] = ()) -> DataFrame:
    """Gate, clean, normalise, deduplicate (``within`` groups), type and score: one shuffle of the records, for the deduplication."""
    kept = records.where(has_measurement(F.col("cof"), F.col("friction_force")))
    cof_raw = F.col("cof")
    # Row by row: names and defaults are the most skewed keys there are, so nothing is joined on them.
    kept = kept.withColumns({
        "material_name": terms.surface(F.col("material_name")),
        "ionic_liquid": terms.liquid(F.col("ionic_liquid")),
        "temperature": P.bound(P.default_temperature(F.col("temperature")), P.temperature_text),
    })
    kept = kept.withColumns({
        "cof_raw": cof_raw,
        "cof_operator": P.cof(cof_raw)["operator"],
        "material_name": F.coalesce(P.blank_to_null(F.col("material_name")), F.lit("Unknown Material")),
        "ionic_liquid": F.coalesce(P.blank_to_null(F.col("ionic_liquid")), F.lit("Unknown IL")),
    })
    best = deduplicate(kept, order, fix, within)
    return best.withColumns({
        "load_n": P.force_newtons(F.coalesce(F.col("load"), F.col("normal_load"))),
        "speed_mps": P.speed_mps(F.col("speed")),
        "temperature_k": P.kelvin(F.col("temperature")),
        "confidence": S.confidence(F.col("material_name"), F.col("ionic_liquid"), F.col("cof_raw"), F.col("cof_clean"), F.coalesce("load", "normal_load"), F.col("speed"), F.col("temperature")),
    })


def client_payload(df: DataFrame) -> DataFrame:
    """The coercion of an uploading client: numbers lose sign, unit and exponent, confidence is constant."""
    cof = P.client_cof(F.col("cof"))
    return df.withColumns({"cof_value": cof["value"], "cof_sign": cof["sign"], "load_value": P.client_number(F.col("load")), "speed_value": P.client_number(F.col("speed")), "temperature_value": P.client_number(F.col("temperature")), "confidence": F.lit(0.9)})


def merge_metadata(found: DataFrame, registry: DataFrame, key: str = "doi", fields: tuple[str, ...] = ("title", "authors", "journal", "year", "issn", "volume", "issue", "pages")) -> DataFrame:
    """Field by field the registry's value where it holds something, else the extracted one; rows without an entry stay as they are."""
    other = registry.select(F.col(key).alias("__key"), *[F.col(f).alias(f"__{f}") for f in fields])
    joined = found.join(other, F.col(key) == F.col("__key"), "left")
    filled = lambda f: F.when(F.col(f"__{f}").cast("string").isin("", "0"), None).otherwise(F.col(f"__{f}"))
    return joined.select(*[F.coalesce(filled(c), F.col(c)).alias(c) if c in fields else F.col(c) for c in found.columns])


def position_ids(df: DataFrame, parent: str, order: str) -> DataFrame:
    """Adds id: parent, underscore, place from 0."""
    n = F.row_number().over(Window.partitionBy(parent).orderBy(order)) - 1
    return df.withColumn("id", F.concat_ws("_", F.col(parent), n))


def batches(df: DataFrame, parent: str, order: str, size: int = 3) -> DataFrame:
    """Adds batch_idx: rows of a parent in order, ``size`` to a batch."""
    n = F.row_number().over(Window.partitionBy(parent).orderBy(order)) - 1
    return df.withColumn("batch_idx", F.floor(n / size).cast("int"))


# What makes a page worth looking at, and what makes one a list of references.
PAGE_WORDS = ("fig", "figure", "table", "schematic", "friction", "wear", "cof", "stribeck")


def page_selected(page_no: Column, text: Column) -> Column:
    """The first page always; later ones where a keyword occurs, unless the first five lines head a list of references without figures."""
    low = F.lower(text)
    head = F.array_join(F.slice(F.split(P.strip(low), "\n"), 1, 5), "")
    listing = P.any_of(head, ("references", "bibliography")) & ~P.any_of(low, ("figure", "fig.", "schematic"))
    return (page_no == 0) | (~listing & P.any_of(low, PAGE_WORDS))
