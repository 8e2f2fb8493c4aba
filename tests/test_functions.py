"""Goldens of tokens, normalisation and canonical text; edges of each rule."""

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specweave.functions import normalize as nz
from specweave.functions import segment
from specweave.functions import text as tx
from specweave.schemas import ATTRIBUTES, FIELDS, SHEET

TOKENS = {
    "DC12V": ["dc", "12v"], "12V": ["12v"], "12V1.5A": ["12v", "1.5a"], "AC100~240V": ["ac", "100", "240v"], "24VDC": ["24v", "dc"],
    "Brushed DC": ["brushed", "dc"], "IP65": ["ip65"], "2600mAh": ["2600mah"], "5.1kgf·cm": ["5.1kg", "f", "cm"], "": [], "the of 的": [],
    "12Ｖ 磷酸铁锂电池": ["12v", "磷酸铁锂", "电池"], "60℃": ["60", "c"],
}
VALUES = [
    ("capacity_mah", "2.6Ah", None, 2600.0), ("capacity_mah", "9.62Wh", 3.7, 2600.0), ("moq_units", "1万个", None, 10000), ("moq_units", "5K", None, 5000),
    ("input_voltage_v", "100-240VAC 50/60Hz", None, [100.0, 240.0]), ("op_temp_c", "-20°C to +60°C", None, [-20.0, 60.0]), ("motor_type", "Brushed DC", None, "brushed_dc"),
    ("op_temp_c", "-30--10", None, [-30.0, -10.0]), ("op_temp_c", "-20℃至60℃", None, [-20.0, 60.0]), ("dimmable", "normal", None, False), ("dimmable", "0-10V调光", None, True),
    ("voltage_v", " DC12 V ", None, 12.0), ("weight_g", "约0.35kg", None, 350.0), ("power_w", "1.5kW", None, 1500.0), ("speed_rpm", "3000转/分", None, 3000.0),
    ("capacity_mah", "2600毫安时", None, 2600.0), ("ip_rating", "防护等级ip67", None, "IP67"), ("plug", "美标 插头", None, "US"), ("moq_units", "2.5", None, 2),
    ("capacity_mah", "9.62Wh", None, "error"), ("capacity_mah", "9.62Wh", 0.0, "error"), ("ip_rating", "IP6", None, "error"), ("moq_units", "abc个", None, "error"),
    ("plug", "unknown", None, "error"), ("voltage_v", "12", None, "error"), ("input_voltage_v", "240V", None, "error"), ("dimmable", "maybe", None, "error"), ("voltage_v", "", None, "error"),
]


def test_tokens(spark):
    rows = spark.createDataFrame([(t,) for t in TOKENS], "t string").select("t", tx.tokenize(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == TOKENS


def test_latin_path_gives_the_same_tokens(spark):
    latin = [t for t in TOKENS if t.isascii()]
    rows = spark.createDataFrame([(t,) for t in latin], "t string").select("t", tx.tokenize(F.col("t"), latin=True).alias("x")).collect()
    assert {r.t: r.x for r in rows} == {t: TOKENS[t] for t in latin}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="dcaDC12.5vVwhkg·cm -_,;:/()[]|（）、磷酸铁的℃°", max_size=20), min_size=30, max_size=60))
def test_splitting_first_changes_nothing(spark, texts):
    """Token classes hold no separator, so searching whole texts equals searching their pieces."""
    pattern = re.compile(rf"[一-鿿]+|{tx.SPEC}|{tx.WORD}")

    def split_first(t):
        s = unicodedata.normalize("NFKC", t).lower().replace("°c", "c")
        s = re.sub(r"(?<![a-z])(dc|ac)(?=\d)", r"\1 ", s)
        return [m for part in re.split(r"[\s,;:/()（）\[\]|、，：]+", s) for m in pattern.findall(part)]

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.spec_tokens(F.col("t")).alias("x")).collect()
    for r in rows:
        assert r.x == split_first(r.t)


def test_lexicon_gives_words_and_their_parts():
    assert segment.default_segmenter("电源适配器") == ["电源", "适配器", "电源适配器"]
    assert segment.default_segmenter("龘电机") == ["龘", "电机"]


@pytest.mark.parametrize(("field", "raw", "voltage", "expected"), VALUES)
def test_values(spark, field, raw, voltage, expected):
    row = spark.createDataFrame([(raw, voltage)], "r string, v double").select(nz.normalize(field, F.col("r"), F.col("v")).alias("n")).first().n
    assert (row.value is None and raw in row.error) if expected == "error" else (row.value == expected and row.error is None)


def test_torque_and_null(spark):
    row = spark.createDataFrame([("5.1kgf·cm", None)], "r string, n string").select(nz.normalize("rated_torque_nm", F.col("r")).alias("a"), nz.normalize("plug", F.col("n")).alias("b")).first()
    assert abs(row.a.value - 0.5) <= 0.01
    assert row.b.value is None and row.b.error is None


def test_unknown_field():
    with pytest.raises(KeyError):
        nz.normalize("colour", None)


def test_same_is_relative_to_the_truth(spark):
    row = spark.createDataFrame([(98.0, 100.0)], "a double, b double").select(
        nz.same("power_w", F.col("a"), F.col("b")).alias("x"), nz.same("power_w", F.lit(97.9), F.col("b")).alias("y"), nz.same("plug", F.lit(None), F.lit("EU")).alias("z"),
        nz.same("op_temp_c", F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("w"),
    ).first()
    assert (row.x, row.y, row.z, row.w) == (True, False, False, False)


def test_short_numbers(spark):
    numbers = [12.0, 1.5, 0.0, 0.0001, 0.00001234, 1e6, 123456.7, 1234567.0, 999999.5, -3.0, 100000.0, 0.1 + 0.2]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", tx.short_number(F.col("x")).alias("s")).collect()
    assert {r.x: r.s for r in rows} == {x: f"{x:g}" for x in numbers}


def test_canonical_and_raw_text(spark):
    truth = {f: None for f in FIELDS} | {"voltage_v": 12.8, "chemistry": "LiFePO4", "moq_units": 5, "dimmable": False, "motor_type": "BLDC"}
    rows = [{"header": "电压", "value": "12V", "field": None, "ambiguous": False}, {"header": "MOQ", "value": "5", "field": None, "ambiguous": False}]
    df = spark.createDataFrame([("1", "battery", "s", "Title", rows, truth, "zh")], SHEET)
    order = F.array(F.lit("chemistry"), F.lit("moq_units"), F.lit("voltage_v"), F.lit("dimmable"), F.lit("motor_type"))
    row = df.select(
        tx.canonical_text(F.col("category"), F.col("truth"), order).alias("c"), tx.canonical_text(F.lit("none"), F.col("truth"), F.array(F.lit("voltage_v"))).alias("u"), tx.raw_text(F.col("title"), F.col("rows")).alias("r")
    ).first()
    assert row.c == "battery pack lithium battery | LiFePO4 | 12.8v | non-dimmable | brushless dc bldc"
    assert row.u == "12.8v"
    assert row.r == "Title\n电压: 12V\nMOQ: 5"
    assert len(ATTRIBUTES) == 20


@pytest.mark.parametrize("text", ["12V ½ kg ①②", "ＤＣ１２Ｖ　电源", "ﬁne ﬂow", "naïve café Ünï", "x́ yé", "plain 5 kg", "无刷电机 24V", "", None, "Å Ω µF"])
def test_rows_leave_the_jvm_only_where_it_matters(spark, text):
    """Folding and segmentation of the rows that need them give what doing it for all rows gives."""
    import unicodedata

    from specweave.functions import segment

    df = spark.createDataFrame([(text,), ("other plain row",)], "t string")
    whole = F.lower(F.lit(None if text is None else unicodedata.normalize("NFKC", text)))
    s = F.regexp_replace(F.replace(whole, F.lit("°c"), F.lit("c")), r"(?<![a-z])(dc|ac)(?=\d)", "$1 ")
    want = tx.without_stop_words(segment.segmented(F.regexp_extract_all(s, F.lit(f"({tx.HAN}|{tx.SPEC}|{tx.WORD})"), F.lit(1))))
    row = df.where(F.col("t").eqNullSafe(F.lit(text))).select(tx.tokenize(F.col("t")).alias("got"), want.alias("want")).first()
    assert row.got == row.want
