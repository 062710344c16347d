"""Completeness, confidence and validation of measurement records as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from labcurate.functions import parsing as P

_MISSING = ("", "-", "null", "None")
_UNCERTAIN = ("<", ">", "~", "≤", "≥", "约", "approximately")
ISSUE = "struct<field:string,message:string,severity:string>"


def missing(c: Column) -> Column:
    return F.coalesce(P.strip(c.cast("string")).isin(*_MISSING), F.lit(True))


def _points(cond: Column, points: float) -> Column:
    return F.when(cond, F.lit(points)).otherwise(F.lit(0.0))


def confidence(material: Column, lubricant: Column, cof_raw: Column, cof_value: Column, load: Column, speed: Column, temperature: Column, operator: Column | None = None) -> Column:
    """1 less what is missing or doubtful, between 0.1 and 1, to two decimals.  Without a value the number in the raw text counts."""
    texts = [c for c in (cof_raw, operator) if c is not None]
    doubtful = reduce(lambda a, b: a | b, [F.coalesce(P.any_of(c, _UNCERTAIN), F.lit(False)) for c in texts])
    value = F.coalesce(F.when(cof_value != 0, cof_value), F.regexp_extract(cof_raw, r"[\d.]+", 0).try_cast("double"), cof_value)
    lost = (
        _points(missing(material), 0.2) + _points(missing(lubricant), 0.2) + _points(doubtful, 0.1) + _points(missing(load), 0.05)
        + _points(missing(speed), 0.05) + _points(missing(temperature), 0.05) + _points(P.bound(value, lambda v: (v > 1.5) | (v < 0)), 0.2)
    )
    return F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1.0 - lost)), 2)


def information(normal_load: Column, speed: Column, temperature: Column, potential: Column, liquid: Column) -> Column:
    """How much a record tells beside its identity."""
    has = lambda c: _points(F.coalesce(c != "", F.lit(False)), 1.0)
    return has(normal_load) + has(speed) + has(temperature) + has(potential) + _points(F.length(liquid) > 3, 0.5)


def missing_cof(cof: Column, friction: Column, load: Column, origin: Column) -> Column:
    """struct<cof, value_origin>: a missing coefficient is friction over load, to six decimals, where both can be read and load is not 0."""
    absent = cof.isNull() | cof.isin("", "-")
    f, n = P.value_with_unit(friction), P.value_with_unit(load)
    ratio = F.try_divide(P.strict_newtons(f["value"], f["unit"]), P.strict_newtons(n["value"], n["unit"]))
    made = F.when(absent & (friction != "") & (load != ""), F.round(ratio, 6))
    return F.struct(
        F.coalesce(F.when(made.isNotNull(), F.regexp_replace(F.format_string("%.6f", made), r"(\.\d+?)0+$", "$1")), cof).alias("cof"),
        F.when(made.isNotNull(), F.lit("calculated")).when(~absent, F.coalesce(P.blank_to_null(origin), F.lit("extracted"))).otherwise(origin).alias("value_origin"),
    )


def filled(*cols: Column) -> Column:
    """How many hold something: not null, empty or 0."""
    one = lambda c: F.when(c.isNull() | c.cast("string").isin("", "0"), 0).otherwise(1)
    return reduce(lambda a, b: a + b, [one(c) for c in cols])


def should_update(old_doi: Column, new_doi: Column, old: list[Column], new: list[Column]) -> Column:
    """New metadata win with an identifier where the old have none, or with more fields filled."""
    has = lambda c: F.coalesce(c != "", F.lit(False))
    return (has(new_doi) & ~has(old_doi)) | (filled(*new) > filled(*old))


# What validation says.
MISSING_COF, INVALID_COF, NEGATIVE_COF, HIGH_COF = "Missing COF value", "Invalid COF format", "COF cannot be negative", "COF > 1.5 is physically unusual"
LOAD_UNIT, LOAD_UNSUPPORTED = "Load value must include unit (e.g., 5 N, 100 mN)", "Unsupported unit for load"
FORCE_UNIT = "Force value must include unit (e.g., 5 N, 100 mN)"


def _issue(field: str, message: Column | str, severity: Column | str) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(field).alias("field"), text(message).alias("message"), text(severity).alias("severity")).cast(ISSUE)


def cof_issue(c: Column, strict: bool = False) -> Column:
    """Null where nothing is wrong.  ``strict`` finds every entry badly formed, as a character class that drops the digits would."""
    blank = c.isNull() | P.strip(c).isin("", "-") if not strict else c.isNull() | (c == "-") | (P.strip(c) == "")
    value = F.lit(None).cast("double") if strict else F.regexp_extract(c, r"-?\d*\.?\d+", 0).try_cast("double")
    return (
        F.when(blank, _issue("cof", MISSING_COF, "warning"))
        .when(value.isNull(), _issue("cof", INVALID_COF, "warning"))
        .when(value < 0, _issue("cof", NEGATIVE_COF, "error"))
        .when(value > 1.5, _issue("cof", HIGH_COF, "warning"))
    )


_UNITED = r"([\d.]+)\s*([a-zA-Zµ]+)"


def united_newtons(c: Column) -> Column:
    """The first number with a unit, in newtons; units are case-sensitive, others give null."""
    number = F.regexp_extract(F.regexp_extract(c, _UNITED, 1), r"^(\d+\.?\d*|\.\d+)", 1).try_cast("double")
    factors = F.create_map(*[F.lit(x) for kv in {"N": 1.0, "mN": 0.001, "µN": 0.000001, "uN": 0.000001, "nN": 0.000000001}.items() for x in kv])
    return number * factors[F.regexp_extract(c, _UNITED, 2)]


def _has_unit(c: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(c, _UNITED, 1), r"^(\d+\.?\d*|\.\d+)", 1) != ""


def load_issue(c: Column) -> Column:
    return (
        F.when(c.isNull() | (c == ""), None)
        .when(~_has_unit(c), _issue("load", LOAD_UNIT, "warning"))
        .when(united_newtons(c).isNull(), _issue("load", LOAD_UNSUPPORTED, "warning"))
    )


def force_issue(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), None).when(~_has_unit(c), _issue("friction_force", FORCE_UNIT, "warning"))


def validation(cof: Column, load: Column, force: Column, status: Column, strict: bool = False) -> Column:
    """struct<status, message, issues>: an issue means warning, but what was verified or modified by hand stays so without errors."""
    issues = F.filter(F.array(cof_issue(cof, strict), load_issue(load), force_issue(force)), lambda x: x.isNotNull())
    errors = F.exists(issues, lambda x: x.severity == "error")
    state = F.when(~errors & status.isin("verified", "modified"), status).when(F.size(issues) > 0, F.lit("warning")).otherwise(F.coalesce(P.blank_to_null(status), F.lit("unverified")))
    return F.struct(state.alias("status"), F.get(issues, 0)["message"].alias("message"), issues.alias("issues"))


def mark_verified(status: Column, issues: Column) -> Column:
    """Bulk verification: verified where no issue is an error."""
    return F.when(~F.exists(issues, lambda x: x.severity == "error"), F.lit("verified")).otherwise(status)


def toggle_verified(status: Column, revalidated: Column) -> Column:
    return F.when(status == "verified", revalidated).otherwise(F.lit("verified"))


def metadata_issues(doi: Column, title: Column) -> Column:
    lost = lambda c, name: F.when(c.isNull() | (P.strip(c) == ""), F.lit(f"Missing {name}"))
    return F.filter(F.array(lost(doi, "DOI"), lost(title, "title")), lambda x: x.isNotNull())


def volume_issue_pages(volume: Column, issue: Column, pages: Column) -> Column:
    """The parts that are there, joined by commas, or a hyphen."""
    part = lambda c, tag: F.when(c != "", F.concat(F.lit(tag), c))
    return F.coalesce(P.blank_to_null(F.concat_ws(", ", part(volume, "Vol. "), part(issue, "Issue "), part(pages, "pp. "))), F.lit("-"))
