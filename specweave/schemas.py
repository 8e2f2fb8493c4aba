"""Schemas of sheets, queries, extractions and attributes."""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical fields and their kinds, in registry order.
FIELD_KINDS = {
    "output_voltage_v": "voltage",
    "voltage_v": "voltage",
    "input_voltage_v": "voltage_range",
    "output_current_a": "current",
    "max_discharge_a": "current",
    "no_load_current_a": "current",
    "output_current_ma": "current_ma",
    "power_w": "power",
    "weight_g": "mass",
    "speed_rpm": "speed",
    "rated_torque_nm": "torque",
    "capacity_mah": "capacity",
    "op_temp_c": "temp_range",
    "moq_units": "count",
    "plug": "enum",
    "cert": "enum",
    "chemistry": "enum",
    "motor_type": "enum",
    "ip_rating": "ip",
    "dimmable": "bool",
}
FIELDS = list(FIELD_KINDS)
# Categories.
CATEGORIES = ["adapter", "battery", "led_driver", "motor"]
# Mapping labels that are not fields.
UNMAPPED, AMBIGUOUS = "unmapped", "ambiguous"
# The fields that a query constrains, by category.
QUERY_FIELDS = {
    "adapter": ["output_voltage_v", "output_current_a", "plug", "cert"],
    "battery": ["chemistry", "voltage_v", "capacity_mah"],
    "led_driver": ["power_w", "output_current_ma", "ip_rating"],
    "motor": ["motor_type", "voltage_v", "speed_rpm"],
}


def spark_type(field: str) -> T.DataType:
    """The Spark type of a canonical field."""
    kind = FIELD_KINDS[field]
    if kind in ("voltage_range", "temp_range"):
        return T.ArrayType(T.DoubleType())
    return {"count": T.LongType(), "enum": T.StringType(), "ip": T.StringType(), "bool": T.BooleanType()}.get(kind, T.DoubleType())


ATTRIBUTES = T.StructType([T.StructField(f, spark_type(f)) for f in FIELDS])
S, I, D = T.StringType(), T.IntegerType(), T.DoubleType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


# Names of the JSON fields of sheets, queries, mappings and extractions.
ROW = struct(header=S, value=S, field=S, ambiguous=T.BooleanType())
SHEET = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "category", "supplier", "title")]
    + [T.StructField("rows", T.ArrayType(ROW)), T.StructField("truth", ATTRIBUTES), T.StructField("style", T.StringType())]
)
QUERY = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "category", "lang", "text")]
    + [T.StructField("constraints", ATTRIBUTES), T.StructField("relevant", T.ArrayType(T.StringType())), T.StructField("hard_negatives", T.ArrayType(T.StringType()))]
)
MAPPING = struct(category=S, rows=T.ArrayType(struct(index=I, field=S, confidence=D)))
ERRORS = T.ArrayType(struct(field=S, raw=S, error=S))
EXTRACTION = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("mapping", MAPPING), T.StructField("attributes", ATTRIBUTES), T.StructField("normalization_errors", ERRORS)]
)
