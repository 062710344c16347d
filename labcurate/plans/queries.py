"""Queries over the driver's tables, each with its SQL counterpart.

Raw measurements are spelled out from ``lineitem`` by expressions that both engines read alike: RAW holds them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labcurate.functions import parsing as P
from labcurate.functions import scoring as S
from labcurate.operators import curate as C
from labcurate.operators import explore as X
from labcurate.operators import review as R
from labcurate.operators import storage as W
from labcurate.operators import terms as T
from labcurate.operators.dictionaries import LIQUIDS, SURFACES
from labcurate.plans.library import Library, payload_schema
from labcurate.plans.registry import query
from labcurate.streaming import ingest

_Q = "cast(cast(l_quantity as int) as string)"


def _case(on: str, *values: str) -> str:
    return f"CASE {on} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


# Spellings of raw entries.
RAW = {
    "k1": "l_orderkey",
    "k2": "l_linenumber",
    "k3": "l_partkey",
    "load": _case("l_partkey", f"{_Q} || ' nN'", f"'< ' || {_Q} || ' mN'", f"{_Q} || '.5 uN'", f"'about ' || {_Q} || ' N'", f"{_Q} || ' kgf'", "''", "NULL", f"{_Q} || 'e-3 kN'", _Q),
    "speed": _case("l_suppkey", f"{_Q} || ' mm/s'", f"{_Q} || ' um/s'", f"{_Q} || ' rpm'", f"{_Q} || ' km/h'", f"{_Q} || ' mm s-1'", "''", "NULL", f"{_Q} || ' M/S'", _Q),
    "temperature": _case("l_orderkey", f"{_Q} || ' C'", f"'3' || {_Q} || ' K'", "'RT'", "'n/a'", "'-'", "''", "NULL", _Q, f"'4' || {_Q}", "'mortar 350 K'"),
    "cof": _case("l_partkey + l_linenumber", f"'0.0' || {_Q}", f"'< 0.' || {_Q}", f"'~ 0.' || {_Q}", f"'<=0.' || {_Q}", f"'0.02-0.0' || {_Q}", "'high 0.1'", "'-0.1'", "''", "NULL", f"{_Q} || '.5'", "'1e-3'", "'-'"),
    "potential": _case("l_suppkey + l_linenumber", f"'+1.' || {_Q}", "'Open circuit'", "'high'", "NULL", "'-0.5V'", "'ocp'"),
    "material": _case("l_suppkey", "' mica '", "'SiO2'", "'steel'", "'Au(111) surface'", "'gold'", "'unobtainium'", "''", "NULL", "'silicon'", "'sus304 plate'", "'muscovite'"),
    "liquid": _case("l_partkey", "'bmim pf6'", "'[EMIM][NTf2]'", "'[PIP14][NTf2]'", "'P66614 BOB'", "'water'", "'[PIP14][TFSI]'", "''", "NULL", "'N-butylpyridinium tetrafluoroborate'"),
    "friction_force": _case("l_linenumber", f"{_Q} || ' nN'", f"{_Q} || ' mN'", "''", "NULL", f"{_Q} || ' kgf'"),
    "normal_load": _case("l_suppkey + l_partkey", "'64 nN'", "'0 N'", "'512 mN'", "''", "NULL", "'13'"),
}
_RAW_SQL = "raw AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in RAW.items()) + " FROM lineitem)"
_KEYS = "k1, k2, k3"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(*[f"{v} AS {k}" for k, v in RAW.items()])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _each(*columns: object):
    return lambda s, d: raw(s, d).select("k1", "k2", "k3", *[c() if callable(c) else c for c in columns])


def _sql(columns: str) -> str:
    return f"WITH {_RAW_SQL} SELECT {_KEYS}, {columns} FROM raw"


_NUM = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
_WHOLE = rf"^(?:[<>≤≥~±]?\s*)?({_NUM})\s*([a-zμµ/]+)?$"
_RX = lambda c, p, g=0: f"nullif(regexp_extract({c}, '{p}', {g}), '')"
_DBL = lambda c, p, g=0: f"try_cast({_RX(c, p, g)} AS DOUBLE)"


def _quantity_sql(c: str, factors: dict[str, float], extra: str = "") -> str:
    low = f"lower(trim({c}))"
    value, unit = _DBL(low, _WHOLE, 1), _RX(low, _WHOLE, 2)
    return f"CASE WHEN {unit} IS NULL THEN {value} " + " ".join(f"WHEN {unit} = '{u}' THEN {value} * {f!r}::DOUBLE" for u, f in factors.items()) + extra + f" ELSE {value} END"


query("parse_force", _sql(_quantity_sql("load", P.FORCE_FACTORS) + " AS load_n"))(_each(lambda: P.force_newtons(F.col("load")).alias("load_n")))
query("parse_speed", _sql(_quantity_sql("speed", P.SPEED_FACTORS, " WHEN contains(lower(speed), 'rpm') THEN NULL") + " AS speed_mps"))(_each(lambda: P.speed_mps(F.col("speed")).alias("speed_mps")))
_COF = rf"^(<=|>=|[<>≤≥~±≈])?\s*({_NUM})"
query("parse_cof", _sql(f"{_DBL('cof', _COF, 2)} AS value, CASE WHEN {_DBL('cof', _COF, 2)} IS NULL THEN 'EQ' WHEN {_RX('cof', _COF, 1)} = '<' THEN 'LT' WHEN {_RX('cof', _COF, 1)} = '<=' THEN 'LE' ELSE 'EQ' END AS operator"))(_each(lambda: P.cof(F.col("cof"))["value"].alias("value"), lambda: P.cof(F.col("cof"))["operator"].alias("operator")))
query("parse_value_with_unit", _sql(f"{_DBL('friction_force', rf'({_NUM})\s*([a-zA-Zμµ]+)?', 1)} AS value, {_RX('friction_force', rf'({_NUM})\s*([a-zA-Zμµ]+)?', 2)} AS unit"))(_each(lambda: P.value_with_unit(F.col("friction_force"))["value"].alias("value"), lambda: P.value_with_unit(F.col("friction_force"))["unit"].alias("unit")))
_TV = _DBL("lower(trim(temperature))", r"[-+]?\d*\.?\d+")
_TEMPERATURE = f"CASE WHEN temperature = '' OR temperature IS NULL THEN NULL WHEN contains(lower(temperature), 'room') OR contains(lower(temperature), 'ambient') OR contains(lower(temperature), 'rt') THEN '298.15 K' WHEN {_TV} IS NULL THEN temperature WHEN contains(lower(temperature), 'k') AND NOT contains(lower(temperature), 'c') THEN printf('%.2f', {_TV}) || ' K' WHEN contains(lower(temperature), 'c') OR {_TV} < 200 THEN printf('%.2f', {_TV} + 273.15) || ' K' ELSE printf('%.2f', {_TV}) || ' K' END"
query("normalize_temperature", _sql(f"{_TEMPERATURE} AS temperature_text, CASE WHEN temperature IS NULL OR temperature IN ('', '-') THEN '298.15 K' ELSE temperature END AS defaulted"))(_each(lambda: P.temperature_text(F.col("temperature")).alias("temperature_text"), lambda: P.default_temperature(F.col("temperature")).alias("defaulted")))
_SAN = lambda c: f"CASE WHEN length(trim({c})) <= 50 AND regexp_matches(trim({c}), '^-?[0-9]') THEN trim({c}) END"
_COFV = _DBL("cof", r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?")
_SANCOF = f"CASE WHEN {_COFV} BETWEEN 0.0001 AND 5.0 THEN {_COFV} END"
_POT = "CASE WHEN contains(upper(potential), 'OCP') OR contains(upper(potential), 'OPEN') OR contains(upper(potential), 'CIRCUIT') THEN 'OCP' WHEN regexp_matches(trim(potential), '^[+-]?[0-9]') THEN trim(potential) END"
query("sanitize_numeric", _sql(f"{_SAN('load')} AS load_text, {_SAN('temperature')} AS temperature_text"))(_each(lambda: P.sanitize_numeric(F.col("load")).alias("load_text"), lambda: P.sanitize_numeric(F.col("temperature")).alias("temperature_text")))
query("sanitize_potential", _sql(f"{_POT} AS potential_text"))(_each(lambda: P.sanitize_potential(F.col("potential")).alias("potential_text")))
query("sanitize_cof", _sql(f"{_SANCOF} AS cof_value"))(_each(lambda: P.sanitize_cof(F.col("cof")).alias("cof_value")))
_GATE = lambda c: "coalesce(" + f"{c} <> '' AND length(trim({c})) <= 20 AND regexp_matches({c}, '[0-9]') AND NOT (" + " OR ".join(f"contains(lower({c}), '{w}')" for w in P.QUALITATIVE) + "), false)"
query("record_gate", f"WITH {_RAW_SQL} SELECT {_KEYS}, cof, friction_force FROM raw WHERE {_GATE('cof')} OR {_GATE('friction_force')}")(lambda s, d: raw(s, d).where(C.has_measurement(F.col("cof"), F.col("friction_force"))).select("k1", "k2", "k3", "cof", "friction_force"))
_CLIENT = lambda c: f"try_cast(nullif(regexp_extract(regexp_replace({c}, '[^0-9.]', '', 'g'), '^([0-9]+[.]?[0-9]*|[.][0-9]+)', 0), '') AS DOUBLE)"
query("client_coercion", _sql(f"{_CLIENT('load')} AS load_value, {_CLIENT('speed')} AS speed_value, nullif(regexp_extract(cof, '[<>≤≥~]', 0), '') AS cof_sign, 0.9::DOUBLE AS confidence"))(lambda s, d: C.client_payload(raw(s, d)).select("k1", "k2", "k3", "load_value", "speed_value", "cof_sign", "confidence"))
query("superlubricity", _sql(f"coalesce(CASE WHEN contains(cof, '<') THEN {_CLIENT('cof')} <= 0.01 ELSE {_CLIENT('cof')} < 0.01 END, false) AS super, CASE WHEN {_CLIENT('cof')} IS NULL THEN 'unknown' WHEN {_CLIENT('cof')} < 0.1 THEN 'low' WHEN {_CLIENT('cof')} < 0.2 THEN 'medium' ELSE 'high' END AS level, least(coalesce({_CLIENT('cof')}, 0) * 200, 100)::DOUBLE AS percent"))(_each(lambda: P.is_superlubricity(F.col("cof")).alias("super"), lambda: P.cof_level(F.col("cof")).alias("level"), lambda: P.cof_bar_percent(F.col("cof")).alias("percent")))
_UNITED = lambda c, g: f"nullif(regexp_extract({c}, '([0-9.]+)\\s*([a-zA-Zµ]+)', {g}), '')"
query("united_newtons", _sql(f"try_cast({_UNITED('load', 1)} AS DOUBLE) * CASE {_UNITED('load', 2)} WHEN 'N' THEN 1.0 WHEN 'mN' THEN 0.001 WHEN 'µN' THEN 0.000001 WHEN 'uN' THEN 0.000001 WHEN 'nN' THEN 0.000000001 END::DOUBLE AS newtons"))(_each(lambda: S.united_newtons(F.col("load")).alias("newtons")))
_PART = r"([-+]?\d*\.?\d+)\s*([a-zA-Z]+)?"
_STRICT = lambda c: f"({_DBL(c, _PART, 1)} * CASE lower(coalesce({_RX(c, _PART, 2)}, 'n')) WHEN 'nn' THEN 1e-9::DOUBLE WHEN 'un' THEN 1e-6::DOUBLE WHEN 'mn' THEN 1e-3::DOUBLE WHEN 'n' THEN 1.0::DOUBLE END)"
_RATIO = f"CASE WHEN coalesce(cof, '') IN ('', '-') AND friction_force <> '' AND normal_load <> '' AND {_STRICT('normal_load')} <> 0 THEN round({_STRICT('friction_force')} / {_STRICT('normal_load')}, 6) END"
query("missing_cof", _sql(f"CASE WHEN {_RATIO} IS NOT NULL THEN {_RATIO} ELSE try_cast(cof AS DOUBLE) END AS cof_number, CASE WHEN {_RATIO} IS NOT NULL THEN 'calculated' WHEN coalesce(cof, '') NOT IN ('', '-') THEN 'extracted' END AS value_origin"))(_each(lambda: _missing()["cof"].try_cast("double").alias("cof_number"), lambda: _missing()["value_origin"].alias("value_origin")))


def _missing():
    return S.missing_cof(F.col("cof"), F.col("friction_force"), F.col("normal_load"), F.lit(None).cast("string"))


_LOST = lambda c: f"coalesce(trim({c}) IN ('', '-', 'null', 'None'), true)"
_FIRST = _DBL("cof", r"[\d.]+")
_CONFIDENCE = f"round(greatest(0.1::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - (CASE WHEN {_LOST('material')} THEN 0.2 ELSE 0 END + CASE WHEN {_LOST('liquid')} THEN 0.2 ELSE 0 END + CASE WHEN coalesce(regexp_matches(cof, '[<>~≤≥]'), false) THEN 0.1 ELSE 0 END + CASE WHEN {_LOST('load')} THEN 0.05 ELSE 0 END + CASE WHEN {_LOST('speed')} THEN 0.05 ELSE 0 END + CASE WHEN {_LOST('temperature')} THEN 0.05 ELSE 0 END + CASE WHEN {_FIRST} > 1.5 THEN 0.2 ELSE 0 END)::DOUBLE)), 2)"
query("confidence", _sql(f"{_CONFIDENCE} AS confidence"))(_each(lambda: S.confidence(F.col("material"), F.col("liquid"), F.col("cof"), F.lit(None).cast("double"), F.col("load"), F.col("speed"), F.col("temperature")).alias("confidence")))
_VC = f"CASE WHEN coalesce(trim(cof), '') IN ('', '-') THEN 'Missing COF value' WHEN {_DBL('cof', r'-?\d*\.?\d+')} < 0 THEN 'COF cannot be negative' WHEN {_DBL('cof', r'-?\d*\.?\d+')} > 1.5 THEN 'COF > 1.5 is physically unusual' END"
_VL = f"CASE WHEN coalesce(load, '') = '' THEN NULL WHEN {_UNITED('load', 1)} IS NULL THEN 'Load value must include unit (e.g., 5 N, 100 mN)' WHEN {_UNITED('load', 2)} NOT IN ('N', 'mN', 'µN', 'uN', 'nN') THEN 'Unsupported unit for load' END"
query("validate_records", _sql(f"CASE WHEN coalesce({_VC}, {_VL}) IS NULL THEN 'unverified' ELSE 'warning' END AS status, coalesce({_VC}, {_VL}) AS message, (({_VC} IS NOT NULL)::INT + ({_VL} IS NOT NULL)::INT) AS n_issues"))(
    lambda s, d: raw(s, d).select("k1", "k2", "k3", S.validation(F.col("cof"), F.col("load"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("v")).select("k1", "k2", "k3", "v.status", "v.message", F.size("v.issues").alias("n_issues"))
)
def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _terms_sql(column: str) -> str:
    """The lookup chain in SQL: alias, then the first pattern found, then the fuzzy or the bracket-free comparison, else the text."""
    terms = SURFACES if column == "material" else LIQUIDS
    text, low = f"trim({column})", f"lower(trim({column}))"
    alias = f"CASE {low} " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in T.alias_index(terms).items()) + " END"
    pattern = "CASE " + " ".join(f"WHEN regexp_matches({text}, {_quoted('(?i)' + x)}) THEN {_quoted(t.term)}" for t in terms for x in t.patterns) + " END"
    if column == "material":
        characters = lambda c: f"list_distinct(string_split({c}, ''))"
        near = lambda a: f"(contains({low}, {a}) OR contains({a}, {low})) AND length({low}) >= 3 AND len(list_intersect({characters(low)}, {characters(a)})) >= 0.7 * least(length({low}), length({a}))"
        last = "CASE " + " ".join(f"WHEN {near(_quoted(a.lower()))} THEN {_quoted(t.term)}" for t in terms for a in t.aliases if len(a) >= 3) + " END"
    else:
        bare = lambda c: f"translate({c}, ' []', '')"
        last = "CASE " + " ".join(f"WHEN {bare(low)} = {bare(_quoted(t.term.lower()))} THEN {_quoted(t.term)}" for t in terms) + " END"
    return f"CASE WHEN {text} = '' THEN {column} ELSE coalesce({alias}, {pattern}, {last}, {column}) END"


query("normalize_surface", _sql(f"{_terms_sql('material')} AS standard"))(lambda s, d: raw(s, d).withColumn("standard", T.surface(F.col("material"))).select("k1", "k2", "k3", "standard"))
query("normalize_liquid", _sql(f"{_terms_sql('liquid')} AS standard"))(lambda s, d: raw(s, d).withColumn("standard", T.liquid(F.col("liquid"))).select("k1", "k2", "k3", "standard"))
_FORMULAS = {t.term: t.formula for t in LIQUIDS}
query("term_info", f"WITH {_RAW_SQL}, n AS (SELECT {_KEYS}, {_terms_sql('liquid')} AS standard FROM raw) SELECT {_KEYS}, standard, CASE standard " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FORMULAS.items()) + " END AS formula FROM n")(
    lambda s, d: T.term_info(s, raw(s, d).select("k1", "k2", "k3", T.liquid(F.col("liquid")).alias("standard")), "standard", LIQUIDS).select("k1", "k2", "k3", "standard", "formula")
)
query("surface_dictionary", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t.term}', '{t.chinese_name}', {len(t.patterns)})" for i, t in enumerate(SURFACES)) + ") v(ord, term, chinese_name, n_patterns)")(lambda s, d: T.dictionary(s, SURFACES).select("ord", "term", "chinese_name", F.size("patterns").alias("n_patterns")))


def _sequenced(s: SparkSession, d: str) -> DataFrame:
    """Raw records with an order of their own: the place in (order, line, part, quantity) as one number."""
    return raw(s, d).withColumnsRenamed({"material": "material_name", "liquid": "ionic_liquid"}).withColumn("seq", F.col("k1") * 1_000_000_000 + F.col("k2") * 100_000_000 + F.col("k3"))


_FP = lambda c: f"coalesce(regexp_replace(lower({c}), '[\\[\\]()\\s_\\-]', '', 'g'), '')"
_CLEAN = f"clean AS (SELECT k1 * 1000000000 + k2 * 100000000 + k3 AS seq, material, liquid, {_SANCOF} AS cof_clean, {_SAN('temperature')} AS temperature, {_SAN('normal_load')} AS normal_load, {_SAN('speed')} AS speed, {_POT} AS potential FROM raw)"
_SCORED = f"scored AS (SELECT *, concat_ws('|', {_FP('material')}, {_FP('liquid')}, printf('%.3f', cof_clean), {_FP('potential')}) AS fp, ((normal_load IS NOT NULL)::INT + (speed IS NOT NULL)::INT + (temperature IS NOT NULL)::INT + (potential IS NOT NULL)::INT + CASE WHEN length(liquid) > 3 THEN 0.5 ELSE 0 END)::DOUBLE AS info FROM clean WHERE cof_clean IS NOT NULL)"
query("dedup_best", f"WITH {_RAW_SQL}, {_CLEAN}, {_SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY info DESC, seq) AS rn, min(seq) OVER (PARTITION BY fp) AS first_seen FROM scored) SELECT fp, info, first_seen FROM ranked WHERE rn = 1")(lambda s, d: C.deduplicate(_sequenced(s, d)).select("fp", "info", "first_seen"))
def _stored(s: SparkSession, df: DataFrame) -> DataFrame:
    """Raw records as the collection holds them: a table of texts, not the expressions that spell them out here."""
    at = _shared(s)
    df.write.parquet(at)
    return s.read.schema(df.schema).parquet(at)


_NAMED = (
    f"named AS (SELECT k1 * 1000000000 + k2 * 100000000 + k3 AS seq, cof, normal_load, speed, potential, load, coalesce(nullif({_terms_sql('material')}, ''), 'Unknown Material') AS material, coalesce(nullif({_terms_sql('liquid')}, ''), 'Unknown IL') AS liquid, "
    f"(SELECT {_TEMPERATURE} FROM (SELECT CASE WHEN raw.temperature IS NULL OR raw.temperature IN ('', '-') THEN '298.15 K' ELSE raw.temperature END AS temperature)) AS temperature FROM raw WHERE {_GATE('cof')} OR {_GATE('friction_force')})"
)
_CHOSEN = f"clean AS (SELECT seq, material, liquid, {_SANCOF} AS cof_clean, cof, load, {_SAN('temperature')} AS temperature, {_SAN('normal_load')} AS normal_load, {_SAN('speed')} AS speed, {_POT} AS potential FROM named)"
query("curate_records", f"WITH {_RAW_SQL}, {_NAMED}, {_CHOSEN}, {_SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY info DESC, seq) AS rn, min(seq) OVER (PARTITION BY fp) AS first_seen FROM scored) SELECT seq, first_seen, material AS material_name, liquid AS ionic_liquid, cof_clean, potential, temperature, {_quantity_sql('coalesce(load, normal_load)', P.FORCE_FACTORS)} AS load_n FROM ranked WHERE rn = 1")(
    lambda s, d: C.curate(_stored(s, _sequenced(s, d))).select("seq", "first_seen", "material_name", "ionic_liquid", "cof_clean", "potential", "temperature", "load_n")
)
_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_COLUMNS = ", ".join(_ORDER)


def _search(s: SparkSession, d: str, wanted: X.Filter) -> DataFrame:
    parents = read(s, d, "orders").where("o_orderstatus <> 'P'").withColumnRenamed("o_orderkey", "l_orderkey")
    found = X.search(read(s, d, "lineitem"), parents, "l_orderkey", wanted, _ORDER, ["o_custkey", "o_orderstatus"])
    return found.select(*_ORDER, F.col("parent.o_custkey").alias("o_custkey"), F.col("parent.o_orderstatus").alias("o_orderstatus"))


def _search_sql(where: str) -> str:
    return f"SELECT t.*, o_custkey, o_orderstatus FROM (SELECT {_COLUMNS} FROM lineitem WHERE {where} ORDER BY {_COLUMNS} LIMIT 1000) t LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey"


query("search_records", _search_sql("l_returnflag IN ('A', 'R') AND l_linestatus IN ('F') AND l_quantity >= 10 AND l_quantity <= 30 AND l_discount <= 0.05"))(lambda s, d: _search(s, d, X.Filter({"l_returnflag": ["A", "R"], "l_linestatus": ["F"]}, {"l_quantity": (10, 30), "l_discount": (None, 0.05)})))
query("search_no_filter", _search_sql("true"))(lambda s, d: _search(s, d, X.Filter({"l_returnflag": []}, {})))
query("filter_options", "SELECT DISTINCT 'p_brand' AS facet, p_brand AS value FROM part WHERE p_brand <> '' UNION ALL SELECT DISTINCT 'p_type', p_type FROM part WHERE p_type <> ''")(lambda s, d: X.options(read(s, d, "part"), ["p_brand", "p_type"]))
query("stats", "SELECT (SELECT count(*) FROM lineitem) AS total_records, min(l_quantity) AS min_value, max(l_quantity) AS max_value, nullif(avg(l_quantity), 0) AS avg_value, (SELECT count(*) FROM orders) AS total_parents FROM lineitem")(lambda s, d: X.summary(read(s, d, "lineitem"), read(s, d, "orders"), "l_quantity"))
query("list_parents", "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100 OFFSET 50")(lambda s, d: X.page_of(read(s, d, "orders"), "o_orderdate", "o_orderkey", 50, 100).select("o_orderkey", "o_orderdate", "o_orderstatus"))
query("parent_with_children", "SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS children FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")(
    lambda s, d: X.with_children(read(s, d, "orders").select("o_orderkey"), read(s, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"]).select(
        "o_orderkey", F.array_join(F.transform("children", lambda c: F.concat_ws(":", c.l_linenumber, c.l_partkey, c.l_suppkey)), ",").alias("children")
    )
)
query("children_if_parent", f"SELECT {_COLUMNS} FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")(lambda s, d: X.children_of_known(read(s, d, "lineitem"), read(s, d, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").select(*_ORDER))
query("by_key", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7")(lambda s, d: X.by_key(read(s, d, "orders"), "o_orderkey", 7).select("o_orderkey", "o_custkey"))
query("facet_counts", "SELECT coalesce(nullif(trim(source), ''), 'Unknown') AS value, count(*) AS n, min(doc_id) AS first_seen FROM documents GROUP BY 1")(lambda s, d: X.facet_counts(read(s, d, "documents"), "source", "doc_id"))
query("facet_top8", "SELECT source AS value, count(*) AS n, min(doc_id) AS first_seen FROM documents WHERE contains(source, '1') GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 8")(lambda s, d: X.facet_counts(read(s, d, "documents"), "source", "doc_id", "1", 8))
query("facet_rows", "SELECT doc_id, lang FROM documents WHERE lang = 'fr'")(lambda s, d: X.facet_rows(read(s, d, "documents").select("doc_id", "lang"), "lang", "fr"))
query("batch_stats", "SELECT count(*) AS total, count(*) FILTER (event_type = 'view') AS completed, sum(user_id) AS records, count(*) FILTER (value > 100) AS with_warnings FROM events")(
    lambda s, d: X.batch_stats(read(s, d, "events").select(F.when(F.col("event_type") == "view", "completed").otherwise("failed").alias("status"), "user_id", (F.col("value") > 100).alias("warned")), "status", "user_id", "warned")
)
query("has_warnings", f"WITH {_RAW_SQL} SELECT k3, bool_or(coalesce(cof, '') IN ('', '-', 'null')) AS has_warnings, count(*) AS n_records FROM raw GROUP BY k3")(lambda s, d: X.has_warnings(raw(s, d), "k3", "cof"))
query("scatter_feed", "SELECT l_quantity AS x, l_extendedprice AS y, l_orderkey FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")(lambda s, d: X.scatter(read(s, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_orderkey"]))
_URL = "trim(CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'doi:10.' || page_id ELSE ' https://doi.org/10.1/' || page_id || ' ' END)"
query("doi_normalize", f"SELECT page_id, CASE WHEN starts_with({_URL}, 'http') THEN list_last(string_split({_URL}, 'doi.org/')) WHEN starts_with({_URL}, 'doi:') THEN substr({_URL}, 5) ELSE {_URL} END AS doi FROM pages")(
    lambda s, d: read(s, d, "pages").select("page_id", P.normalize_doi(F.expr("CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'doi:10.' || page_id ELSE ' https://doi.org/10.1/' || page_id || ' ' END")).alias("doi"))
)
query("json_records", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN json_extract(props, '$.k')::INT WHEN 1 THEN json_extract(props, '$.k')::INT ELSE NULL END AS k FROM events WHERE event_id % 3 < 2")(
    lambda s, d: C.records_of_answers(read(s, d, "events").select("event_id", F.expr("CASE event_id % 3 WHEN 0 THEN '```json\\n[' || replace(props, '\"k\"', '\"load\"') || ']\\n```' WHEN 1 THEN 'see {\"data\":[' || replace(props, '\"k\"', '\"load\"') || ']}' ELSE 'no answer' END").alias("answer"))).select("event_id", F.col("load").cast("int").alias("k"))
)
query("content_hash", "SELECT doc_id, md5(text) AS file_hash FROM documents")(lambda s, d: read(s, d, "documents").select("doc_id", F.md5("text").alias("file_hash")))
query("hash_dedupe", "SELECT min(doc_id) AS doc_id, md5(text) AS file_hash FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id < 100) GROUP BY 2")(lambda s, d: _hash_dedupe(s, d))


def _hashed(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", F.md5("text").alias("file_hash"))


def _hash_dedupe(s: SparkSession, d: str) -> DataFrame:
    return W.new_by_hash(_hashed(s, d), _hashed(s, d).where("doc_id < 100"), "file_hash", "doc_id")


query("preview", "SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS preview FROM documents")(lambda s, d: read(s, d, "documents").select("doc_id", P.preview(F.col("text")).alias("preview")))
query("page_select", "SELECT doc_id FROM documents WHERE doc_id % 5 = 0 OR (" + " OR ".join(f"contains(lower(text), '{w}')" for w in C.PAGE_WORDS) + ") AND NOT ((contains(array_to_string(string_split(lower(trim(text)), chr(10))[1:5], ''), 'references') OR contains(array_to_string(string_split(lower(trim(text)), chr(10))[1:5], ''), 'bibliography')) AND NOT (contains(lower(text), 'figure') OR contains(lower(text), 'fig.') OR contains(lower(text), 'schematic')))")(
    lambda s, d: read(s, d, "documents").where(C.page_selected(F.col("doc_id") % 5, F.col("text"))).select("doc_id")
)
query("chat_context", "SELECT conv_id, substr(arg_max(text, turn), 1, 2000) AS context FROM conversations GROUP BY conv_id")(lambda s, d: X.latest_context(read(s, d, "conversations"), "conv_id", "turn", "text"))
query("keyed_replace", f"SELECT {_COLUMNS} FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem n WHERE n.l_quantity > 45 AND n.l_orderkey = l.l_orderkey) UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity + 100, l_extendedprice FROM lineitem WHERE l_quantity > 45")(
    lambda s, d: W.replace_where_any(read(s, d, "lineitem").select(*_ORDER), read(s, d, "lineitem").where("l_quantity > 45").select(*_ORDER).withColumn("l_quantity", F.col("l_quantity") + 100), "l_orderkey")
)
query("cascade_delete", f"SELECT {_COLUMNS} FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")(
    lambda s, d: W.cascade_delete(read(s, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), read(s, d, "lineitem"), read(s, d, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")[1].select(*_ORDER)
)
query("get_or_create", "SELECT c.c_custkey, p.c_custkey AS parent_id, p.c_custkey IS NULL AS is_new FROM customer c LEFT JOIN (SELECT c_name, min(c_custkey) AS c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY 1) p USING (c_name)")(
    lambda s, d: W.get_or_create(read(s, d, "customer").where("c_mktsegment = 'MACHINERY'").select("c_name", F.col("c_custkey").alias("parent_id")), read(s, d, "customer").select("c_custkey", "c_name"), "c_name", "parent_id").select("c_custkey", "parent_id", "is_new")
)
query("new_ids", "SELECT count(*) AS n, count(DISTINCT c_custkey) AS ids, (SELECT max(o_orderkey) FROM orders) + 1 AS least, (SELECT max(o_orderkey) FROM orders) + count(*) AS greatest FROM customer")(
    lambda s, d: W.with_new_ids(read(s, d, "customer"), read(s, d, "orders").select(F.col("o_orderkey").alias("id")), "id", ["c_name"]).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.min("id").alias("least"), F.max("id").alias("greatest"))
)


def _altered(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.expr("CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN upper(c_name) END").alias("c_name"), F.lit("OTHER").alias("c_mktsegment"))


query("metadata_merge", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 1 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_custkey % 2 = 0 THEN 'OTHER' ELSE c_mktsegment END AS c_mktsegment FROM customer")(lambda s, d: C.merge_metadata(read(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), _altered(s, d), "c_custkey", ("c_name", "c_mktsegment")))
query("merge_filled", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 1 THEN upper(c_name) ELSE c_name END AS c_name FROM customer")(lambda s, d: W.merge_filled(read(s, d, "customer").select("c_custkey", "c_name"), _altered(s, d), "c_custkey", ["c_name"]))
query("should_update", "SELECT o_orderkey, (o_orderkey % 4 = 0) OR ((o_orderkey % 3 = 0)::INT + 1 > (o_orderkey % 5 = 0)::INT + (o_orderkey % 2 = 0)::INT) AS update_it FROM orders")(
    lambda s, d: read(s, d, "orders").select(
        "o_orderkey",
        S.should_update(F.lit(""), F.when(F.col("o_orderkey") % 4 == 0, F.lit("10.1/x")), [F.when(F.col("o_orderkey") % 5 == 0, "a"), F.when(F.col("o_orderkey") % 2 == 0, "b")], [F.when(F.col("o_orderkey") % 3 == 0, "a"), F.lit("x")]).alias("update_it"),
    )
)
query("image_batches", "SELECT page_id, ((row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) - 1) // 3)::INT AS batch_idx FROM pages")(lambda s, d: C.batches(read(s, d, "pages").select("page_id", (F.col("page_id") % 7).alias("file")), "file", "page_id").select("page_id", "batch_idx"))
query("position_ids", "SELECT page_id, (page_id % 7) || '_' || (row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) - 1) AS id FROM pages")(lambda s, d: C.position_ids(read(s, d, "pages").select("page_id", (F.col("page_id") % 7).alias("file")), "file", "page_id").select("page_id", "id"))
query("display_values", _sql("CASE WHEN trim(load) IN ('', '-') THEN '-' ELSE coalesce(load, '-') END AS shown, CASE WHEN trim(cof) IN ('', '-') THEN 'none' ELSE coalesce(cof, 'none') END AS with_placeholder"))(_each(lambda: P.display(F.col("load")).alias("shown"), lambda: P.display(F.col("cof"), F.lit("none")).alias("with_placeholder")))
query("metadata_issues", "SELECT c_custkey, (c_custkey % 2 = 0)::INT + (c_custkey % 3 = 0)::INT AS n_issues, CASE WHEN c_custkey % 5 = 0 THEN '-' ELSE 'Vol. 1, pp. 2' END AS label FROM customer")(
    lambda s, d: read(s, d, "customer").select(
        "c_custkey",
        F.size(S.metadata_issues(F.when(F.col("c_custkey") % 2 != 0, "x"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise("t"))).alias("n_issues"),
        S.volume_issue_pages(F.when(F.col("c_custkey") % 5 != 0, "1"), F.lit(None).cast("string"), F.when(F.col("c_custkey") % 5 != 0, "2")).alias("label"),
    )
)
query("file_states", "SELECT user_id, CASE max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END) WHEN 1 THEN 'pending' WHEN 2 THEN 'processing' WHEN 3 THEN 'extracting' WHEN 4 THEN 'completed' ELSE 'failed' END AS state FROM events GROUP BY 1")(
    lambda s, d: ingest.state_of(read(s, d, "events").select("user_id", F.expr("CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'signup' THEN 'extracting' WHEN 'purchase' THEN 'completed' ELSE 'failed' END").alias("state")), "user_id", "state")
)


def _shared(s: SparkSession) -> str:
    root = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()
    if not root:
        if not s.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="labcurate-")
    return f"{root}/labcurate-{uuid.uuid4().hex}"


@query("stream_store_new", "SELECT min(doc_id) AS doc_id, md5(text) AS file_hash FROM documents GROUP BY 2")
def stream_store_new(s: SparkSession, d: str) -> DataFrame:
    """Documents arrive as a stream and each content is stored once."""
    at = _shared(s)
    arriving = ingest.file_stream(s, f"{d}/documents.parque[t]", "doc_id long, text string").select("doc_id", F.md5("text").alias("file_hash"))
    table = W.SnapshotTable(s, f"{at}/table", s.createDataFrame([], "doc_id long, file_hash string").schema, unique=("file_hash",))
    ingest.store_new(arriving, table, "file_hash", "doc_id", f"{at}/progress").awaitTermination()
    return table.read()


@query("snapshot_replace", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 10 <> 5")
def snapshot_replace(s: SparkSession, d: str) -> DataFrame:
    """Two commits to a versioned table: the load, then replaced and deleted rows."""
    table = W.SnapshotTable(s, _shared(s), s.createDataFrame([], "c_custkey long, c_name string").schema)
    table.write(read(s, d, "customer").select("c_custkey", "c_name"))
    now = table.read()
    changed = now.where("c_custkey % 10 = 0").withColumn("c_name", F.lit("new"))
    table.write(W.keyed_replace(now, changed, now.where("c_custkey % 5 = 0"), "c_custkey"))
    return table.read()


@query(
    "library_sync",
    "WITH r AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '0.1' WHEN 1 THEN '< 0.05' ELSE NULL END AS cof FROM orders WHERE o_custkey % 5 <> 0 AND (o_custkey % 2 = 1 OR o_orderkey % 2 = 0)) "
    "SELECT (SELECT count(*) FROM customer WHERE c_custkey % 5 <> 0) AS total_parents, count(*) AS total_records, min(CASE cof WHEN '0.1' THEN 0.1 WHEN '< 0.05' THEN 0.05 END::DOUBLE) AS min_value, max(CASE cof WHEN '0.1' THEN 0.1 WHEN '< 0.05' THEN 0.05 END::DOUBLE) AS max_value, avg(CASE cof WHEN '0.1' THEN 0.1::DOUBLE WHEN '< 0.05' THEN 0.05::DOUBLE END) AS avg_value FROM r",
)
def library_sync(s: SparkSession, d: str) -> DataFrame:
    """Two synchronisations and a deletion: customers as documents, orders as measurements; even documents send half of theirs again."""
    lib = Library(s, _shared(s))
    schema = payload_schema()
    fields = {"cof": "CASE o.o_orderkey % 3 WHEN 0 THEN '0.1' WHEN 1 THEN '< 0.05' END", "evidence": "cast(o.o_orderkey as string)"}
    record = ", ".join(f"'{f.name}', {fields.get(f.name, 'cast(null as string)')}" for f in schema["records"].dataType.elementType.fields)

    def payload(orders: DataFrame, docs: DataFrame) -> DataFrame:
        lists = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.struct("o_orderkey")).alias("orders"))  # few columns are moved
        lists = lists.select("c_custkey", F.expr(f"transform(orders, o -> named_struct({record}))").alias("records"))
        rows = docs.join(lists, "c_custkey", "left").withColumns({"doi": F.concat(F.lit("doi:10.1/"), F.col("c_custkey")), "title": F.col("c_name"), "records": F.coalesce("records", F.array().cast(schema["records"].dataType))})
        return rows.select(*[F.col(f.name) if f.name in ("doi", "title", "records") else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])

    docs, orders = read(s, d, "customer"), read(s, d, "orders")
    lib.sync(payload(orders, docs))
    lib.sync(payload(orders.where("o_orderkey % 2 = 0"), docs.where("c_custkey % 2 = 0")))
    lib.delete(lib.literature().where("cast(substring(doi, 6) as int) % 5 = 0").select("id"))
    return lib.stats()


query("quarantine", f"WITH {_RAW_SQL} SELECT {_KEYS}, coalesce(trim(material), '') = '' AS bad FROM raw WHERE coalesce(trim(material), '') = '' OR k3 % 2 = 0")(lambda s, d: _quarantine(s, d))


def _quarantine(s: SparkSession, d: str) -> DataFrame:
    good, bad = R.split_valid(raw(s, d).withColumnRenamed("material", "material_name"))
    return good.where("k3 % 2 = 0").select("k1", "k2", "k3", F.lit(False).alias("bad")).unionByName(bad.select("k1", "k2", "k3", F.lit(True).alias("bad")))


query("client_ids", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment || '-' || c_custkey END AS id FROM customer")(
    lambda s, d: R.with_client_ids(read(s, d, "customer").withColumn("id", F.expr("CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 3 = 0 THEN '' END")), "c_mktsegment", "c_custkey").select("c_custkey", "id")
)
query("metadata_to_sync", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'temp-' || c_name WHEN c_custkey % 3 = 1 THEN '' ELSE '10.1/x' END AS doi, CASE WHEN c_custkey % 3 = 1 THEN 'T' ELSE 'Untitled' END AS title FROM customer")(
    lambda s, d: R.metadata_to_sync(read(s, d, "customer").selectExpr("c_custkey", "c_name", "CASE WHEN c_custkey % 3 = 2 THEN '10.1/x' END AS doi", "CASE WHEN c_custkey % 3 = 1 THEN 'T' WHEN c_custkey % 3 = 0 THEN ' ' END AS title", "cast(null as string) AS authors", "cast(null as string) AS journal", "cast(null as int) AS year"), "c_name").select(
        "c_custkey", "doi", "title"
    )
)
query("edit_tracking", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 25 ELSE p_size END AS p_size, CASE WHEN p_size > 25 THEN p_size END AS p_size_original, CASE WHEN p_size > 25 THEN 'modified' ELSE 'unverified' END AS status FROM part")(
    lambda s, d: R.edited(read(s, d, "part").select("p_partkey", "p_size", F.lit("unverified").alias("status")), "p_size", F.least("p_size", F.lit(25))).select("p_partkey", "p_size", "p_size_original", "status")
)
query("run_totals", "SELECT count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, sum(CASE WHEN event_type <> 'error' THEN user_id END) AS records FROM events")(lambda s, d: R.run_totals(read(s, d, "events").withColumn("failure", F.expr("CASE WHEN event_type = 'error' THEN 'x' END")), "failure", "user_id"))
query("detail_labels", "SELECT event_id, strftime(ts, '%H:%M') AS at, CASE event_type WHEN 'view' THEN '<' ELSE '' END || user_id AS shown FROM events")(lambda s, d: read(s, d, "events").select("event_id", R.clock(F.col("ts")).alias("at"), R.signed_value(F.expr("CASE WHEN event_type = 'view' THEN '<' END"), F.col("user_id")).alias("shown")))
