"""Normalisation of raw supplier values as column expressions.

Every rule gives a struct of ``value`` and ``error``: a value that does not
parse is null with an error, and never fails the job. Both are null where the
raw value is null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from specweave.schemas import FIELD_KINDS

# Fixed value: what counts as a number.
NUMBER = r"[-+]?\d+(?:\.\d+)?"
# Units and their factors to the canonical unit.
UNITS = {
    "voltage": {"v": 1.0, "伏": 1.0, "kv": 1000.0, "mv": 0.001},
    "current": {"a": 1.0, "安": 1.0, "ma": 0.001, "毫安": 0.001},
    "current_ma": {"ma": 1.0, "毫安": 1.0, "a": 1000.0, "安": 1000.0},
    "power": {"w": 1.0, "瓦": 1.0, "kw": 1000.0},
    "mass": {"g": 1.0, "克": 1.0, "kg": 1000.0, "公斤": 1000.0},
    "speed": {"rpm": 1.0, "r/min": 1.0, "转/分": 1.0, "转": 1.0},
    "torque": {"n·m": 1.0, "n.m": 1.0, "nm": 1.0, "mn·m": 0.001, "kgf·cm": 0.0980665, "kg·cm": 0.0980665, "kg.cm": 0.0980665},
}
# Spellings of each canonical value.
SYNONYMS = {
    "plug": {
        "US": ["美规", "us", "美标插头", "美标"],
        "EU": ["欧规", "eu", "欧标插头", "欧标"],
        "UK": ["英规", "uk", "英标插头", "英标"],
        "AU": ["澳规", "au", "澳标"],
        "CN": ["国标", "cn", "中规"],
    },
    "cert": {"CE": ["ce认证", "ce"], "UL": ["ul认证", "ul"], "CCC": ["3c认证", "ccc", "3c"], "FCC": ["fcc认证", "fcc"]},
    "chemistry": {
        "LiFePO4": ["磷酸铁锂", "lifepo4", "磷酸铁锂 lfp", "lfp"],
        "Li-ion": ["三元锂", "锂离子", "li-ion", "nmc"],
        "LiPo": ["聚合物锂", "锂聚合物", "lipo"],
    },
    "motor_type": {
        "BLDC": ["无刷直流电机", "bldc", "无刷", "brushless dc"],
        "brushed_dc": ["有刷直流电机", "有刷", "brushed dc"],
        "stepper": ["步进电机", "stepper", "步进"],
    },
}
# Capacity units in mAh, count multipliers and words, yes and no.
CAPACITY_UNITS = {"mah": 1.0, "毫安时": 1.0, "ah": 1000.0}
COUNT_MULTIPLIERS = {"万": 10000.0, "k": 1000.0}
COUNT_WORDS = ["个", "pcs", "units"]
NO_PREFIXES = ["否", "不", "no", "非"]
YES_WORDS, YES_PART = ["是", "yes", "可调光"], "调光"


def clean(raw: Column) -> Column:
    """Trimmed, lower-cased, without ASCII spaces and the sign for "about"."""
    return F.regexp_replace(F.lower(F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")), "[ 约]", "")


def _result(value: Column, raw: Column, why: str, kind: str) -> Column:
    value = value.cast(kind)
    error = F.when(raw.isNotNull() & value.isNull(), F.concat(F.lit(f"{why}: "), raw))
    return F.struct(value.alias("value"), error.alias("error"))


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _measured(s: Column, units: dict[str, float]) -> Column:
    """Number times unit factor of a whole string; null where it is not a number with a unit."""
    pattern = f"^({NUMBER})({'|'.join(re.escape(u) for u in units)})$"
    return F.regexp_extract(s, pattern, 1).try_cast("double") * _lookup(units, F.regexp_extract(s, pattern, 2))


def quantity(kind: str, raw: Column) -> Column:
    """A number with a unit, with an optional leading ``dc`` or ``ac``, to four decimals."""
    s = F.regexp_replace(clean(raw), "^(dc|ac)", "")
    return _result(F.round(_measured(s, UNITS[kind]), 4), raw, f"no {kind} with a unit", "double")


def capacity(raw: Column, voltage: Column) -> Column:
    """mAh; energy in Wh needs the voltage and is rounded half-even to tens."""
    s = clean(raw)
    energy = F.regexp_extract(s, f"^({NUMBER})wh$", 1).try_cast("double")
    charge = F.bround(F.try_divide(energy, voltage.cast("double")) * 1000, -1)
    return _result(F.coalesce(F.round(_measured(s, CAPACITY_UNITS), 2), charge), raw, "bad capacity, or Wh without voltage", "double")


def pair(text: Column, raw: Column) -> Column:
    """The first two signed numbers. A dash between digits is no minus where there are just two numbers."""
    numbers = F.transform(F.regexp_extract_all(F.replace(text, F.lit("+"), F.lit("")), F.lit(f"({NUMBER})")), lambda x: x.try_cast("double"))
    first, second = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    dashed = text.rlike(r"(?U)\d\s*-\s*\d") & (F.size(numbers) == 2) & (second < 0)
    value = F.when(F.size(numbers) >= 2, F.array(first, F.when(dashed, -second).otherwise(second)))
    return _result(value, raw, "not a range", "array<double>")


def voltage_range(raw: Column) -> Column:
    return pair(F.get(F.split(raw, "50/60"), F.lit(0)), raw)


def temp_range(raw: Column) -> Column:
    return pair(F.replace(F.replace(raw, F.lit("至"), F.lit("~")), F.lit("to"), F.lit("~")), raw)


def count(raw: Column) -> Column:
    pattern = f"^({NUMBER})({'|'.join(COUNT_MULTIPLIERS)})?({'|'.join(COUNT_WORDS)})?$"
    s = clean(raw)
    times = F.coalesce(_lookup(COUNT_MULTIPLIERS, F.regexp_extract(s, pattern, 2)), F.lit(1.0))
    return _result(F.bround(F.regexp_extract(s, pattern, 1).try_cast("double") * times), raw, "bad count", "bigint")


def enum(field: str, raw: Column) -> Column:
    table: dict[str, str] = {}
    for canonical, spellings in SYNONYMS[field].items():
        for x in spellings:
            table.setdefault(x.replace(" ", ""), canonical)
    return _result(_lookup(table, clean(raw)), raw, f"unknown {field}", "string")


def ip_rating(raw: Column) -> Column:
    digits = F.regexp_extract(clean(raw), r"ip(\d\d)", 1)
    return _result(F.when(digits != "", F.concat(F.lit("IP"), digits)), raw, "bad ip", "string")


def flag(raw: Column) -> Column:
    """A negative beginning decides first, so anything that begins with "no" is false."""
    s = clean(raw)
    value = F.when(s.rlike(f"^({'|'.join(NO_PREFIXES)})"), False).when(s.isin(YES_WORDS) | s.contains(YES_PART), True)
    return _result(value, raw, "bad bool", "boolean")


def normalize(field: str, raw: Column, voltage: Column | None = None) -> Column:
    """Struct of value and error for a canonical field; an unknown field is a KeyError."""
    kind = FIELD_KINDS[field]
    if kind in UNITS:
        return quantity(kind, raw)
    if kind == "enum":
        return enum(field, raw)
    if kind == "capacity":
        return capacity(raw, F.lit(None) if voltage is None else voltage)
    return {"voltage_range": voltage_range, "temp_range": temp_range, "count": count, "ip": ip_rating, "bool": flag}[kind](raw)


def close(a: Column, b: Column, share: float = 0.02) -> Column:
    """|a - b| within ``share`` of |b|; the second is the truth."""
    return F.abs(a - b) <= share * F.greatest(F.abs(b), F.lit(1e-9))


def same(field: str, a: Column, b: Column, share: float = 0.02) -> Column:
    """Whether a value equals the true one: numbers nearly, ranges by element, others exactly. Null is not equal."""
    kind = FIELD_KINDS[field]
    if kind in ("voltage_range", "temp_range"):
        equal = (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: close(x, y, share)), lambda x: F.coalesce(x, F.lit(False)))
    elif kind in ("enum", "ip", "bool"):
        equal = a == b
    else:
        equal = close(a.cast("double"), b.cast("double"), share)
    return F.coalesce(equal, F.lit(False))
