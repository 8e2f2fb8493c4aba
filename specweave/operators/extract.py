"""Extraction: header mapping by a provider, and attributes built from mapped rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave import schemas
from specweave.functions import normalize as nz
from specweave.operators.catalog import AMBIGUOUS_HEADERS, HEADERS
from specweave.schemas import AMBIGUOUS, CATEGORIES, FIELDS, UNMAPPED

# Words in titles that tell the category, for the offline provider.
CATEGORY_SIGNS = {
    "led_driver": ["led", "恒流"],
    "battery": ["battery", "电池", "锂"],
    "motor": ["motor", "电机", "马达"],
    "adapter": ["adapter", "power supply", "电源", "充电器"],
}


def alias_mapper(title: str, rows: list[tuple[str, str]]) -> dict:
    """Offline provider: category from the title, fields from known headers, then from the value where two fields share a header."""
    low = title.lower()
    category = next((c for c, signs in CATEGORY_SIGNS.items() if any(s in low for s in signs)), "adapter")
    unclear = {h for h in AMBIGUOUS_HEADERS.values()}
    used, out = set(), []
    for i, (header, value) in enumerate(rows):
        fields = [f for f, names in HEADERS.items() if header in names and f in CATEGORY_FIELDS[category] and f not in used]
        if header in unclear:
            field, confidence = AMBIGUOUS, 0.5
        elif not fields:
            field, confidence = UNMAPPED, 0.96 if re.search(r"\d", value) is None else 0.9
        else:
            field, confidence = fields[0], 0.99 if len(fields) == 1 else 0.85
            used.add(field)
        out.append({"index": i, "field": field, "confidence": confidence})
    return {"category": category, "rows": out}


# The fields that a category's sheets can have.
CATEGORY_FIELDS = {
    "adapter": ["output_voltage_v", "output_current_a", "power_w", "input_voltage_v", "plug", "cert", "moq_units"],
    "battery": ["chemistry", "voltage_v", "capacity_mah", "max_discharge_a", "weight_g", "op_temp_c", "moq_units"],
    "led_driver": ["power_w", "output_current_ma", "ip_rating", "dimmable", "op_temp_c", "moq_units"],
    "motor": ["motor_type", "voltage_v", "speed_rpm", "rated_torque_nm", "no_load_current_a", "weight_g", "moq_units"],
}


# What each field means, for a provider that reads it.
MEANINGS = {
    "output_voltage_v": "voltage that a power supply gives", "voltage_v": "rated voltage of the product itself", "input_voltage_v": "range of mains voltage that is accepted",
    "output_current_a": "current that a power supply gives, in amperes", "max_discharge_a": "largest discharge current of a battery", "no_load_current_a": "current of a motor without load",
    "output_current_ma": "constant output current of a driver, in milliamperes", "power_w": "rated power", "weight_g": "weight of one piece", "speed_rpm": "speed of a motor",
    "rated_torque_nm": "torque at rated load", "capacity_mah": "capacity of a battery", "op_temp_c": "range of working temperature", "moq_units": "smallest order, in pieces",
    "plug": "plug standard of a country", "cert": "certification mark", "chemistry": "cell chemistry of a battery", "motor_type": "kind of motor", "ip_rating": "ingress protection code",
    "dimmable": "whether light can be dimmed",
}


def mapping_prompt(title: str, rows: list[tuple[str, str]]) -> str:
    """What a language model is asked for one sheet."""
    fields = "\n".join(f"{f}: {MEANINGS[f]}" for f in FIELDS)
    lines = "\n".join(f"{i}. {header} = {value}" for i, (header, value) in enumerate(rows))
    return (
        f"A supplier's specification sheet follows, often in Chinese. Name its category ({', '.join(CATEGORIES)}) and, for each numbered row, the field that it gives.\n"
        f"Fields:\n{fields}\n"
        f"Say {UNMAPPED} for information that no field holds, and {AMBIGUOUS} where header, value and category leave more than one field possible. "
        f"A field is given at most once. Confidence is the probability that the answer is right.\n\nTitle: {title}\nRows:\n{lines}"
    )


def mapping_schema() -> dict:
    """JSON schema of the answer; strict, so that nothing else passes."""

    def strict(**properties) -> dict:
        return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}

    row = strict(index={"type": "integer"}, field={"type": "string", "enum": [*FIELDS, UNMAPPED, AMBIGUOUS]}, confidence={"type": "number"})
    return strict(category={"type": "string", "enum": list(CATEGORIES)}, rows={"type": "array", "items": row})


def asking(complete: Callable[[str, dict], str | tuple[str, dict]], tries: int = 2) -> Callable[[str, list[tuple[str, str]]], dict]:
    """A provider of mappings from ``complete(prompt, schema)``, which gives JSON text, or that and its usage.

    An answer that is no JSON or breaks the schema is asked for again, up to
    ``tries`` times, and is an error then. Usage counts all tries.
    """

    def provider(title: str, rows: list[tuple[str, str]]) -> dict:
        used, broken = {"input": 0, "output": 0}, None
        for _ in range(tries):
            answer = complete(mapping_prompt(title, rows), mapping_schema())
            text, usage = answer if isinstance(answer, tuple) else (answer, {})
            used = {k: n + int(usage.get(k, 0)) for k, n in used.items()}
            try:
                mapping = json.loads(text)
                if broken := _breach(mapping, mapping_schema()):
                    continue
                return mapping | {"usage": used}
            except json.JSONDecodeError as e:
                broken = str(e)
        raise ValueError(f"no valid answer in {tries} tries: {broken}")

    return provider


def _breach(value, schema: dict) -> str | None:
    """The first place at which a value breaks a schema of the kind above."""
    kinds = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float)}
    if not isinstance(value, kinds[schema["type"]]) or isinstance(value, bool):
        return f"{value!r} is no {schema['type']}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{value!r} is not allowed"
    if schema["type"] == "object":
        if set(value) != set(schema["required"]):
            return f"properties are {sorted(value)}"
        return next((b for k, s in schema["properties"].items() if (b := _breach(value[k], s))), None)
    if schema["type"] == "array":
        return next((b for v in value if (b := _breach(v, schema["items"]))), None)
    return None


def map_headers(sheets: DataFrame, provider: Callable[[str, list[tuple[str, str]]], dict] = alias_mapper, workers: int = 8) -> DataFrame:
    """(id, mapping, usage, failure): the provider's mapping of each sheet, or why there is none.

    A provider can tell its ``usage`` (tokens in and out) beside category and
    rows. It is called from ``workers`` threads in each task, as one that
    asks a service waits most of the time. A failure is a row, not the job's end.
    """
    kind = schemas.MAPPING.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        def one(title, rows):
            try:
                return provider(title or "", [(r["header"] or "", r["value"] or "") for r in rows]), None
            except Exception as e:  # noqa: BLE001  the error is the result
                return None, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(workers) as pool:
            for f in frames:
                got = list(pool.map(one, f.title, f["rows"]))
                usage = [(g[0] or {}).pop("usage", None) for g in got]
                yield pd.DataFrame({"id": f.id, "mapping": [g[0] for g in got], "usage": usage, "failure": [g[1] for g in got]})

    return sheets.select("id", "title", F.coalesce("rows", F.array()).alias("rows")).mapInPandas(run, f"id string, mapping {kind}, usage struct<input: bigint, output: bigint>, failure string")


def usage_totals(mapped: DataFrame) -> DataFrame:
    """One row: tokens that the provider took, and sheets that failed."""
    total = lambda c: F.coalesce(F.sum(f"usage.{c}"), F.lit(0)).alias(c)
    return mapped.agg(total("input"), total("output"), F.count_if(F.col("failure").isNotNull()).alias("failed"))


def valid_mapping(mapping: Column) -> Column:
    """Whether a mapping keeps the schema: a known category; known labels, an index and a confidence in every row."""
    row = lambda m: m["index"].isNotNull() & m["confidence"].isNotNull() & F.coalesce(m["field"].isin([*FIELDS, UNMAPPED, AMBIGUOUS]), F.lit(False))
    return F.coalesce(mapping["category"].isin(CATEGORIES) & F.forall(mapping["rows"], row), F.lit(False))


def parse_mapping(raw: Column) -> Column:
    """A mapping from JSON text; null where it does not keep the schema or has further properties."""
    parsed = F.from_json(raw, schemas.MAPPING)
    keys = F.array_sort(F.json_object_keys(raw)) == F.array(F.lit("category"), F.lit("rows"))
    rows = F.from_json(raw, "rows array<map<string,string>>")["rows"]
    own = F.forall(rows, lambda m: F.array_sort(F.map_keys(m)) == F.array(F.lit("confidence"), F.lit("field"), F.lit("index")))
    return F.when(F.coalesce(keys & own, F.lit(False)) & valid_mapping(parsed), parsed)


def best_rows(mappings: DataFrame) -> DataFrame:
    """(id, field, index, confidence, pos): of rows for one field the most confident, the first on ties.

    ``mappings`` is (id, n_rows, mapping). Labels that are no fields and indexes outside the sheet do not count.
    """
    rows = mappings.select("id", "n_rows", F.posexplode("mapping.rows").alias("pos", "m")).select("id", "n_rows", "pos", "m.*")
    rows = rows.where(~F.col("field").isin(UNMAPPED, AMBIGUOUS) & (F.col("index") >= 0) & (F.col("index") < F.col("n_rows")))
    first = F.min("pos").over(Window.partitionBy("id", "field"))
    best = Window.partitionBy("id", "field").orderBy(F.col("confidence").desc(), "pos")
    return rows.withColumn("first", first).withColumn("n", F.row_number().over(best)).where("n = 1").select("id", "field", "index", "confidence", "pos", "first")


def build_attributes(sheets: DataFrame, mappings: DataFrame) -> DataFrame:
    """(id, attributes, normalization_errors, order) from sheets (id, rows) and (id, mapping).

    Voltage is normalised first, as capacity in Wh needs it; errors and
    ``order`` (the fields that have a value) follow: voltage, then as mapped.
    """
    both = sheets.select("id", "rows").join(mappings.select("id", "mapping"), "id")
    best = best_rows(both.select("id", F.size("rows").alias("n_rows"), "mapping"))
    found = F.sort_array(F.collect_list(F.struct((F.col("field") != "voltage_v").alias("later"), F.col("first"), F.col("field"), F.col("index"))))
    both = both.join(best.groupBy("id").agg(found.alias("found")), "id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<later: boolean, first: int, field: string, index: int>>")))
    raws = F.map_from_entries(F.transform("found", lambda x: F.struct(x.field, F.get(F.col("rows"), x["index"]).value)))
    both = both.withColumn("raws", raws).withColumn("n_voltage", nz.normalize("voltage_v", F.col("raws")["voltage_v"]))
    rest = {f"n_{f}": nz.normalize(f, F.col("raws")[f], F.col("n_voltage.value")) for f in FIELDS}
    both = both.withColumns(rest)
    attributes = F.struct(*[F.col(f"n_{f}.value").cast(schemas.spark_type(f)).alias(f) for f in FIELDS])
    error = F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f"n_{f}.error"))])
    told = F.filter(F.transform("found", lambda x: F.struct(x.field.alias("field"), F.col("raws")[x.field].alias("raw"), error[x.field].alias("error"))), lambda x: x.error.isNotNull())
    right = F.filter(F.transform("found", lambda x: x.field), lambda f: error[f].isNull())
    return both.select("id", attributes.alias("attributes"), told.alias("normalization_errors"), right.alias("order"))


def extract(sheets: DataFrame, provider=alias_mapper) -> DataFrame:
    """Extractions of sheets: mapping, attributes, errors. Sheets whose mapping failed or breaks the schema are left out."""
    return extracted(sheets, map_headers(sheets, provider))


def extracted(sheets: DataFrame, mapped: DataFrame) -> DataFrame:
    """Extractions from mappings that a provider has given already."""
    mapped = mapped.where(F.col("mapping").isNotNull() & valid_mapping(F.col("mapping")))
    built = build_attributes(sheets, mapped)
    return mapped.select("id", "mapping").join(built, "id").select("id", "mapping", "attributes", "normalization_errors")


def containment(left: Column, right: dict, kinds: dict[str, str] | None = None) -> Column:
    """Whether a JSON text holds every key of ``right`` with an equal value (numbers by value, arrays as sets of items held by part, objects by part)."""

    def holds(value: Column, path: str, want) -> Column:
        if isinstance(want, dict):
            out = F.coalesce(F.try_variant_get(value, path, "map<string,variant>").isNotNull(), F.lit(False))
            for k, v in want.items():
                out = out & holds(value, f"{path}.{k}", v)
            return out
        if isinstance(want, list):
            items = F.try_variant_get(value, path, "array<variant>")
            out = F.coalesce(items.isNotNull(), F.lit(False))
            for w in want:  # some item holds it, whatever the place
                out = out & F.coalesce(F.exists(items, lambda x: holds(x, "$", w)), F.lit(False))  # noqa: B023  called at once
            return out
        if want is None:
            return F.coalesce(F.is_variant_null(F.try_variant_get(value, path, "variant")), F.lit(False))
        kind = "boolean" if isinstance(want, bool) else "double" if isinstance(want, (int, float)) else "string"
        scalar = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
        typed = {"boolean": scalar == "BOOLEAN", "string": scalar == "STRING", "double": ~scalar.isin("BOOLEAN", "STRING", "VOID")}[kind]
        return F.coalesce(typed & (F.try_variant_get(value, path, kind) == F.lit(want if kind != "double" else float(want))), F.lit(False))

    return holds(F.try_parse_json(left), "$", right)


def shredded(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Adds a column ``<column>_<key>`` with the text of each top-level scalar. Written sorted by them, files
    and row groups that lack a value are skipped by :func:`contained`."""
    parsed = F.try_parse_json(column)
    return rows.withColumns({f"{column}_{k}": F.try_variant_get(parsed, f"$.{k}", "string") for k in keys})


def contained(rows: DataFrame, column: str, want: dict) -> DataFrame:
    """Rows whose JSON holds ``want``. Shredded strings and integers are compared first, by a filter that the scan takes; the rest decides."""
    for k, v in want.items():
        own = f"{column}_{k}"
        if own in rows.columns and isinstance(v, str):
            rows = rows.where(F.col(own) == v)
        elif own in rows.columns and isinstance(v, int) and not isinstance(v, bool):
            rows = rows.where(F.col(own).isin(str(v), f"{v}.0") | F.col(own).contains("E") | F.col(own).contains(".") & (F.col(own).try_cast("double") == float(v)))
    return rows.where(containment(F.col(column), want))
