"""Semi-structured answers and metadata messages as Column expressions over variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labcurate.functions.parsing import blank_to_null, json_body

# The text fields of an extracted record.
RECORD_FIELDS = ("id", "material_name", "ionic_liquid", "base_oil", "concentration", "load", "speed", "temperature", "cof", "friction_force", "normal_load", "wear_rate", "test_duration", "contact_type", "potential", "water_content", "surface_roughness", "film_thickness", "mol_ratio", "cation", "source", "notes", "value_origin", "evidence")


def _whole_json(text: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else; the parser itself would stop after the first value."""
    one = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(one, "$[1]", "variant").isNull(), F.try_variant_get(one, "$[0]", "variant"))


def answer_json(answer: Column) -> Column:
    """The variant of the JSON inside a model's answer."""
    return _whole_json(json_body(answer))


def records(answer: Column) -> Column:
    """array<variant>: the list itself, or under data or records, or the one object; empty for text that is not JSON."""
    return listed_records(answer_json(answer))


def listed_records(v: Column) -> Column:
    """records() of what answer_json() gives: as a column of its own it is parsed once."""
    listed = lambda path: F.try_variant_get(v, path, "array<variant>")
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.array().cast("array<variant>"))
        .when(kind.startswith("ARRAY"), listed("$"))
        .when(F.try_variant_get(v, "$.data", "variant").isNotNull(), F.coalesce(listed("$.data"), F.array().cast("array<variant>")))
        .when(F.try_variant_get(v, "$.records", "variant").isNotNull(), F.coalesce(listed("$.records"), F.array().cast("array<variant>")))
        .when(kind.startswith("OBJECT"), F.array(v))
        .otherwise(F.array().cast("array<variant>"))
    )


def record_struct(v: Column) -> Column:
    """struct of RECORD_FIELDS, every value as text."""
    return F.struct(*[F.try_variant_get(v, f"$.{k}", "string").alias(k) for k in RECORD_FIELDS])


def _first(v: Column, path: str) -> Column:
    """A text, or the first of a list of texts; null for an empty list."""
    value = F.try_variant_get(v, path, "variant")
    listed = F.schema_of_variant(value).startswith("ARRAY")
    return blank_to_null(F.when(listed, F.try_variant_get(v, f"{path}[0]", "string")).otherwise(F.try_variant_get(value, "$", "string")))


def authors(v: Column) -> Column:
    """Given and family names joined by "; "; authors without family name do not count; null if none."""
    people = F.try_variant_get(v, "$.author", "array<variant>")
    family = lambda a: F.try_variant_get(a, "$.family", "string")
    name = lambda a: F.concat_ws(" ", F.try_variant_get(a, "$.given", "string"), family(a))
    return blank_to_null(F.array_join(F.transform(F.filter(people, lambda a: family(a).isNotNull()), name), "; "))


def year(v: Column) -> Column:
    """Of ``published`` if it has date parts at all, else of ``issued``; an empty list does not fall through."""
    part = lambda k: F.try_variant_get(v, f"$.{k}['date-parts'][0][0]", "int")
    return F.when(F.try_variant_get(v, "$.published['date-parts']", "variant").isNotNull(), part("published")).otherwise(part("issued"))


def pdf_url(v: Column) -> Column:
    """The first link to a PDF, else one under open access (a list or one object)."""
    is_pdf = lambda x: F.try_variant_get(x, "$['content-type']", "string") == "application/pdf"
    url = lambda links: F.try_variant_get(F.get(F.filter(links, is_pdf), 0), "$.URL", "string")
    single = F.try_variant_get(v, "$['open-access']", "variant")
    return F.coalesce(url(F.try_variant_get(v, "$.link", "array<variant>")), url(F.try_variant_get(v, "$['open-access']", "array<variant>")), F.when(is_pdf(single), F.try_variant_get(single, "$.URL", "string")))


def pdf_location(v: Column) -> Column:
    """pdf_url(), else the page's own address with .pdf."""
    return F.coalesce(pdf_url(v), F.concat(F.regexp_replace(F.try_variant_get(v, "$.URL", "string"), "/+$", ""), F.lit(".pdf")))


def bibliography(message: Column, doi: Column) -> Column:
    """struct of a registry's message (JSON text)."""
    v = F.try_parse_json(message)
    text = lambda k: F.try_variant_get(v, f"$.{k}", "string").alias({"page": "pages", "URL": "url"}.get(k, k))
    return F.struct(_first(v, "$.title").alias("title"), authors(v).alias("authors"), doi.alias("doi"), _first(v, "$['container-title']").alias("journal"), text("volume"), text("issue"), text("page"), year(v).alias("year"), _first(v, "$.ISSN").alias("issn"), text("abstract"), text("URL"), pdf_url(v).alias("pdf_url"))
