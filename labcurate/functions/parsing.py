"""Text and quantity parsing as Column expressions.

Null input gives null unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
# Factors to newtons and to metres a second.
FORCE_FACTORS = {"nn": 1e-9, "un": 1e-6, "μn": 1e-6, "µn": 1e-6, "mn": 1e-3, "n": 1.0, "kn": 1e3}
SPEED_FACTORS = {"nm/s": 1e-9, "um/s": 1e-6, "μm/s": 1e-6, "µm/s": 1e-6, "mm/s": 1e-3, "cm/s": 1e-2, "m/s": 1.0, "km/h": 1 / 3.6}
# Words of a qualitative entry.
QUALITATIVE = ("increase", "decrease", "depend", "versus", "function", "correla", "high", "low", "vary", "varies")
#: Symbol -> stored operator.
OPERATORS = {"<": "LT", ">": "GT", "≤": "LE", "<=": "LE", "≥": "GE", ">=": "GE"}


#: All that (?U)\s matches.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(_WHITE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    """Whether the text contains one of the words."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def _find(c: Column, pattern: str, group: int = 0) -> Column:
    """What the first match holds; null if there is no match or the group is empty."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once for each row, however often ``f`` refers to it.  Long chains stay out of generated code."""
    return F.get(F.transform(F.array(c), f), 0)


def _factor(unit: Column, factors: dict[str, float]) -> Column:
    pairs = [F.lit(x) for kv in factors.items() for x in kv]
    return F.create_map(*pairs)[unit]


def temperature_text(c: Column) -> Column:
    """Kelvin with two decimals; words for room temperature are 298.15 K; text without a number stays as it is; empty is null."""
    low = F.lower(strip(c))
    value = _find(low, r"[-+]?\d*\.?\d+").try_cast("double")
    celsius = (F.contains(low, F.lit("c")) | F.contains(low, F.lit("°")) | (value < 200)) & ~(F.contains(low, F.lit("k")) & ~F.contains(low, F.lit("c")))
    return (
        F.when(c.isNull() | (c == ""), None)
        .when(any_of(low, ("room", "ambient", "rt")), F.lit("298.15 K"))
        .when(value.isNull(), c)
        .otherwise(F.concat(F.format_string("%.2f", F.when(celsius, value + 273.15).otherwise(value)), F.lit(" K")))
    )


def default_temperature(c: Column) -> Column:
    return F.when(c.isNull() | c.isin("", "-"), F.lit("298.15 K")).otherwise(c)


def kelvin(c: Column) -> Column:
    """The number of a text that temperature_text() has made."""
    return _find(c, r"^([-+]?\d+\.\d\d) K$", 1).try_cast("double")


def value_with_unit(c: Column) -> Column:
    """struct<value, unit>: the first number anywhere and the letters after it."""
    p = rf"({_NUMBER})\s*([a-zA-Zμµ]+)?"
    return F.struct(_find(c, p, 1).try_cast("double").alias("value"), _find(c, p, 2).alias("unit"))


def _quantity(c: Column, factors: dict[str, float], unknown: Column) -> Column:
    low = F.lower(strip(c))
    p = rf"^(?:[<>≤≥~±]?\s*)?({_NUMBER})\s*([a-zμµ/]+)?$"
    value, unit = _find(low, p, 1).try_cast("double"), _find(low, p, 2)
    return F.when(unit.isNull(), value).when(unit.isin(*factors), value * _factor(unit, factors)).otherwise(F.when(unknown, None).otherwise(value))


def force_newtons(c: Column) -> Column:
    """Whole-text quantity with at most one sign before it; an unknown unit keeps the number."""
    return _quantity(c, FORCE_FACTORS, F.lit(False))


def speed_mps(c: Column) -> Column:
    """As force_newtons; revolutions a minute give null."""
    return _quantity(c, SPEED_FACTORS, F.contains(F.lower(c), F.lit("rpm")))


def strict_newtons(value: Column, unit: Column) -> Column:
    """A number with its unit; no unit means newtons, an unknown one (kN too) gives null."""
    known = {k: v for k, v in FORCE_FACTORS.items() if k != "kn"}
    return F.when(unit.isNull() | (unit == ""), value).otherwise(value * _factor(F.lower(unit), known))


def cof(c: Column) -> Column:
    """struct<value, operator>; no or an approximate sign, and text that cannot be read, mean EQ."""
    p = rf"^(<=|>=|[<>≤≥~±≈])?\s*({_NUMBER})"
    pairs = [F.lit(x) for kv in OPERATORS.items() for x in kv]
    found = lambda text: F.struct(_find(text, p, 1).alias("sign"), _find(text, p, 2).try_cast("double").alias("value"))
    op = lambda f: F.when(f["value"].isNotNull(), F.create_map(*pairs)[f["sign"]])
    return bound(bound(strip(c), found), lambda f: F.struct(f["value"].alias("value"), F.coalesce(op(f), F.lit("EQ")).alias("operator")))


def parse_and_normalize(c: Column, field: str) -> Column:
    """struct<value, operator> of a field that is force, speed or cof."""
    none = F.lit(None).cast("string").alias("operator")
    if field == "cof":
        return cof(c)
    known = {"force": force_newtons, "speed": speed_mps}
    return F.struct((known[field](c) if field in known else F.lit(None).cast("double")).alias("value"), none)


def is_numeric_entry(c: Column) -> Column:
    """A short entry with a digit and no qualitative word; null is not.  The entry is bound, as a filter would compute it for each use."""
    return F.coalesce(bound(strip(c), lambda text: (F.length(text) <= 20) & text.rlike(r"(?U)\d") & ~text.rlike("(?i)" + "|".join(QUALITATIVE))), F.lit(False))


def sanitize_numeric(c: Column) -> Column:
    """Text that begins with a digit, after at most a minus, and has 50 characters at most."""
    text = strip(c)
    return F.when((F.length(text) <= 50) & text.rlike(r"^-?\d"), text)


def sanitize_potential(c: Column) -> Column:
    text = strip(c)
    return F.when(any_of(F.upper(text), ("OCP", "OPEN", "CIRCUIT")), F.lit("OCP")).when(text.rlike(r"^[+-]?\d"), text)


def sanitize_cof(c: Column, fix: bool = False) -> Column:
    """The first number, if a coefficient can be so large.  ``fix`` reads ".05" as 0.05 and not as 5."""
    p = r"-?\d*\.?\d+([eE][-+]?\d+)?" if fix else r"-?\d+(\.\d+)?([eE][-+]?\d+)?"
    value = _find(c, p).try_cast("double")
    return F.when(value.between(0.0001, 5.0), value)


def fingerprint_text(c: Column, fix: bool = False) -> Column:
    """Lower case without brackets, white space, underscores and hyphens; ``fix`` keeps a leading minus.  Null is empty."""
    bare = F.regexp_replace(F.lower(c), r"[\[\]()\s_\-]", "")
    signed = F.concat(F.when(strip(c).startswith("-"), F.lit("-")).otherwise(F.lit("")), bare) if fix else bare
    return F.coalesce(signed, F.lit(""))


def normalize_doi(c: Column) -> Column:
    text = strip(c)
    return F.when(text.startswith("http"), F.substring_index(text, "doi.org/", -1)).when(text.startswith("doi:"), text.substr(F.lit(5), F.length(text))).otherwise(text)


def json_body(c: Column) -> Column:
    """The JSON inside a model's answer: a fenced block up to the last fence, else from the first bracket to the last of its kind."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*)\s*```", 1)
    square, curly = F.instr(c, "["), F.instr(c, "{")
    to_last = lambda opened, mark: F.when(F.contains(c, F.lit(mark)), c.substr(opened, F.length(c) - F.instr(F.reverse(c), mark) + 2 - opened)).otherwise(c)
    return (
        F.when(c.rlike(r"(?s)```.*```"), strip(fenced))
        .when((square == 0) & (curly == 0), c)
        .when((square > 0) & ((curly == 0) | (square < curly)), to_last(square, "]"))
        .otherwise(to_last(curly, "}"))
    )


def client_number(c: Column) -> Column:
    """Everything but digits and dots goes, then the longest prefix that is a number: sign, unit and exponent are lost."""
    return _find(F.regexp_replace(c, r"[^0-9.]", ""), r"^(\d+\.?\d*|\.\d+)").try_cast("double")


def client_cof(c: Column) -> Column:
    """struct<value, sign>: comparison signs go, then the prefix that is a number; the first sign, as it stands."""
    bare = F.regexp_replace(c, "[<>≤≥~]", "")
    return F.struct(_find(bare, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double").alias("value"), _find(c, "[<>≤≥~]").alias("sign"))


def cof_level(c: Column) -> Column:
    """low below 0.1, medium below 0.2, high from there, unknown without a number."""
    v = client_number(c)
    return F.when(v.isNull(), F.lit("unknown")).when(v < 0.1, F.lit("low")).when(v < 0.2, F.lit("medium")).otherwise(F.lit("high"))


def cof_bar_percent(c: Column) -> Column:
    return F.least(F.coalesce(client_number(c), F.lit(0.0)) * 200, F.lit(100.0))


def is_superlubricity(c: Column) -> Column:
    """Below 0.01, or a bound of at most 0.01; false without a number."""
    v = client_number(c)
    return F.coalesce(F.when(F.contains(c, F.lit("<")), v <= 0.01).otherwise(v < 0.01), F.lit(False))


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot, empty if none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def preview(c: Column, most: int = 500) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def display(c: Column, placeholder: Column | None = None) -> Column:
    """The value unless it is blank or a hyphen, else the placeholder, else a hyphen."""
    held = F.when(strip(c).isin("", "-"), None).otherwise(c)
    return F.coalesce(held, *([blank_to_null(placeholder)] if placeholder is not None else []), F.lit("-"))


def status_label(c: Column) -> Column:
    """One label for the states of work in progress, one for the finished ones."""
    return F.when(c.isin("extracting", "processing"), F.lit("extracting")).when(c.isin("completed", "success"), F.lit("completed")).when(c.isin("uploaded", "pending", "failed", "error"), c).otherwise(F.lit("unknown"))
