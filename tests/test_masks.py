"""Worked examples and edge rows of the masks."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilspark.functions import generators, redact
from veilspark.functions.domains import pool
from veilspark.operators.geometry import geometry_literal
from veilspark.plans.mask import mask_table
from veilspark.plans.rules import ColumnRule as R
from veilspark.plans.rules import RuleError, Settings, TableRule


def masked(spark, values, rule, kind="string", **more):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"k int, v {kind}")
    result = mask_table(df, TableRule("t", ("k",), (rule,)), **more)
    return [r["v"] for r in result.orderBy("k").collect()]


@pytest.mark.parametrize(
    "pattern,size,text,expected",
    [
        ("MaskingLeft", 3, "ABCDEFG", "***DEFG"),
        ("MaskingLeft", 7, "ABCDEFG", "ABCDEFG"),
        ("MaskingRight", 3, "ABCDEFG", "ABCDEF*"),
        ("MaskingRight", 4, "ABCDEFGH", "ABCD****"),
        ("MaskingMiddle", 2, "ABCDEFG", "AB****G"),
        ("MaskingMiddle", 4, "ABCDEFGH", "ABCDEFGH"),
        ("MaskingLeft", 2, "😀é字x", "**字x"),
        ("MaskingLeft", 2, "    ", "    "),
        ("MaskingRight", 2, "", ""),
    ],
)
def test_starring_out(spark, pattern, size, text, expected):
    assert masked(spark, [text], R("v", "MaskingOut", pattern=pattern, max=str(size))) == [expected]


def test_scramble_keeps_the_characters(spark):
    texts = ["Hello", "ab", "x", "", "aaaa", "😀é字x", "a" * 20 + "b" * 80, None, "ab cd\n"]
    result = masked(spark, texts, R("v", "Scramble"))
    for before, after in zip(texts, result):
        assert (before is None) == (after is None)
        if before is not None:
            assert Counter(before) == Counter(after)
            if len(set(before)) > 1:
                assert before != after


def test_scramble_numbers(spark):
    before = [120, -120, 7, 0, 2147483647, None]
    after = masked(spark, before, R("v", "Scramble"), "int")
    assert after[2:4] == [7, 0] and after[5] is None
    assert after[0] > 0 > after[1]
    digits = masked(spark, [9007199254740993, -15], R("v", "Scramble"), "bigint")
    assert digits[1] in (-51, -15) and Counter(str(digits[0]).zfill(16)) == Counter("9007199254740993")


def test_scramble_decimal_keeps_the_fraction(spark):
    df = spark.createDataFrame([(1, "123.45"), (2, "-987.60")], "k int, t string").selectExpr("k", "CAST(t AS DECIMAL(9,2)) AS v")
    rows = mask_table(df, TableRule("t", ("k",), (R("v", "Scramble"),))).orderBy("k").collect()
    assert [str(r["v"])[-3:] for r in rows] == [".45", ".60"] and rows[1]["v"] < 0


@pytest.mark.parametrize(
    "rule",
    [
        R("v", "FirstName"), R("v", "PickRandom", pattern="A,B"), R("v", "State", pattern="Canada"), R("v", "Vehicle", pattern="Fuel"),
        R("v", "RandomMonth", pattern="MM"), R("v", "StringFormat", pattern="?"),
    ],
)
def test_values_differ_from_small_domains(spark, rule):
    """Feed every generator its own output: nothing may come back unchanged."""
    first = masked(spark, ["-"] * 300, rule)
    again = masked(spark, first, rule)
    assert all(a != b for a, b in zip(first, again))
    assert set(again) <= set(first) | set(again)


def test_a_single_value_stays(spark):
    assert masked(spark, ["A", "B", None], R("v", "PickRandom", pattern="A")) == ["A", "A", None]


def test_whole_number_ranges_differ(spark):
    rule = R("v", "RandomInt", min="1", max="2")
    assert masked(spark, [1, 2] * 50, rule, "int") == [2, 1] * 50


def test_null_and_blank(spark):
    values = [None, "", "  \t", "x"]
    kept = masked(spark, values, R("v", "LastName", retain_empty=True))
    assert kept[:3] == [None, "", "  \t"] and kept[3] not in ("x", None)
    drawn = masked(spark, values, R("v", "LastName", retain_null=False))
    assert all(drawn) and drawn[1] != "" and drawn[2].strip()
    assert masked(spark, [None], R("v", "MaskingOut", pattern="MaskingLeft", max="2", retain_null=False)) == [""]


def test_mapping_of_values(spark):
    result = masked(spark, ["a", "b", "a", "c"], R("v", "StringFormat", pattern="####", local_mapping=True, value_mappings={"b": "fixed"}))
    assert result[0] == result[2] and result[1] == "fixed"
    # Without a mapping nulls have no common replacement.
    nulls = masked(spark, [None] * 20, R("v", "StringFormat", pattern="######", local_mapping=True, retain_null=False))
    assert len(set(nulls)) > 10


def test_later_rules_see_masked_values(spark):
    df = spark.createDataFrame([(1, 10.0, 5.0, 0.0, "z")], "k int, a double, b double, c double, t string")
    rules = (
        R("a", "RandomDec", min="100", max="200"), R("b", "NoMasking"), R("c", "math", pattern="a,b", operator="addition"),
        R("t", "Computed", source_columns=("a", "b"), separator="+"),
    )
    row = mask_table(df, TableRule("t", ("k",), rules)).first()
    assert 100 <= row["a"] <= 200 and row["c"] == row["a"] + 5.0 and row["t"] == f"{row['a']}+5.0"


def test_gender_column_masked_earlier_counts(spark):
    from veilspark.functions.pools import FEMALE_NAMES

    df = spark.createDataFrame([(i, "M", "x") for i in range(50)], "k int, g string, v string")
    rules = (R("g", "PickRandom", use_value="F"), R("v", "FirstName", gender_column="g"))
    assert {r["v"] for r in mask_table(df, TableRule("t", ("k",), rules)).collect()} <= set(FEMALE_NAMES)


@pytest.mark.parametrize(
    "rule",
    [
        R("v", "Vehicle", pattern="Wheel"), R("v", "Bogus", pattern="{{NO.SUCH}}"), R("v", "State", pattern="Atlantis"),
        R("v", "math", pattern="missing", operator="addition"), R("v", "MaskingOut", pattern="MaskingUp", max="2"),
        R("v", "MaskingOut", pattern="MaskingLeft"), R("v", "Geometry", use_value="1"), R("v", "TimeSpan"),
        R("v", "Computed", source_columns=("nope",)), R("v", "PhoneNumberInt", pattern="(###)"),
        R("v", "Company", unique=True, max="5"),
    ],
)
def test_faulty_rules_are_errors(spark, rule):
    with pytest.raises(RuleError):
        masked(spark, ["a"], rule)


def test_unknown_rule_type():
    with pytest.raises(RuleError):
        R("v", "Teleport")
    assert R("v", "fullname").type == "FullName"


def test_own_generator(spark):
    generators.register("Error", lambda rule, settings: generators.Recipe(pool(["custom-1", "custom-2"])))
    try:
        assert generators.has_generator("error")
        made = generators.recipe(R("v", "Error"), Settings())
        assert made.sampler.capacity == 2
    finally:
        generators._GENERATORS.pop("error")


def test_every_template_field_renders(spark):
    from veilspark.functions.draw import Draws
    from veilspark.functions.templates import FIELDS

    draws = Draws("42", "t", F.col("id").cast("string"))
    row = spark.range(3).select(*[make().value(draws).alias(name.replace(".", "_")) for name, make in FIELDS.items()]).first()
    assert all(isinstance(v, str) and v for v in row)


def test_geometry_text(spark):
    df = spark.sql(
        "SELECT named_struct('gtype', 2001, 'srid', 3005, 'point', named_struct('x', 1, 'y', CAST(NULL AS INT), 'z', 3), "
        "'elem', CAST(NULL AS ARRAY<INT>), 'ordinates', array(1, 2)) AS g"
    )
    text = df.select(geometry_literal(F.col("g"))).first()[0]
    assert text == "MDSYS.SDO_GEOMETRY(2001,3005,MDSYS.SDO_POINT_TYPE(1, NULL, 3),NULL,MDSYS.SDO_ORDINATE_ARRAY(1, 2))"


def test_date_texts(spark):
    from veilspark.functions.dates import parse_date

    texts = ["1/2/2020 3:04:05 PM", "2020-01-13 03:04", "20200131", "3-4-2021 12:05", "2020-13-01 1:00:00 AM", "soon", "", None, "13/13/2020 1:00 AM"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    parsed = [str(r[0]) for r in df.orderBy("k").select(parse_date(F.col("t"))).collect()]
    assert parsed == [
        "2020-01-02 15:04:05", "2020-01-13 03:04:00", "2020-01-31 00:00:00", "2021-03-04 00:05:00", "2020-01-13 01:00:00", "None", "None", "None", "None",
    ]


def test_math_golden(spark):
    df = spark.createDataFrame([(1, 10.0, 4.0, 1.0), (2, 10.0, None, 1.0), (3, 10.0, 4.0, None)], "k int, a double, b double, r double")

    def run(operator, pattern, factor=None):
        rules = (R("a", "NoMasking"), R("b", "NoMasking"), R("r", "math", pattern=pattern, operator=operator, max=factor))
        return [x["r"] for x in mask_table(df, TableRule("t", ("k",), rules)).orderBy("k").collect()]

    assert run("addition", "a,b") == [14.0, 10.0, None]
    assert run("substraction", "a,b") == [-14.0, -10.0, None]
    assert run("avarage", "a,b") == [7.0, 5.0, None]
    assert run("percentage", "a", "20") == [2.0, 2.0, None]
    assert run("division", "a", "4") == [2.5, 2.5, None]
    assert run("division", "a", "0") == [None, None, None]
    assert all(3.0 <= v <= 9.9 for v in run("randomPercentage", "a", "30")[:2])
    with pytest.raises(RuleError):
        run("multiplication", "a,b")


def test_numeric_and_blank_helpers(spark):
    df = spark.createDataFrame([("1e3",), (" 7 ",), ("x",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(redact.is_numeric(F.col("t"))).collect()] == [True, True, False, True, False]


def test_values_that_do_not_fit_the_column_become_null(spark):
    assert masked(spark, [7, 8], R("v", "LastName"), "int") == [None, None]
    years = masked(spark, [1, 2], R("v", "RandomYear", min="2001", max="2009"), "int")
    assert all(2001 <= y <= 2009 for y in years)
    assert masked(spark, [7], R("v", "Randomint64", min="5000000000", max="5000000001"), "int") == [None]
    with pytest.raises(RuleError):
        masked(spark, [1234], R("v", "MaskingOut", pattern="MaskingLeft", max="2"), "int")
