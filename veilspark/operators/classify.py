"""Classification: propose a masking rule for every profiled column from its name, type and bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.cascade import Step, choose, decide, ends, has
from veilspark.operators.profile import is_decimal_text, swap_bounds, whole_number

NOT_REQUIRED = "No Masking required"
# Rule of columns no step decides.
UNDECIDED = "Shuffle"
NO_DATE = "-- ::"

# Word lists and formats of the cascade: fixed values.
COMMENT_WORDS = ["DESCRIPTION", "TEXT", "MEMO", "COMMENT", "COMMENTS", "NOTE", "NOTES", "REMARK", "REMARKS"]
NAME_WORDS = ["OWNER_NAME", "OWNERS_NAME", "AGENT_NAME", "OFFICER_NAME", "FULL_NAME", "CONTACT_NAME", "MANAGER_NAME", "NAME"]
DATE_BY_LENGTH = {"8": "yyyyMMdd", "10": "yyyy-MM-dd", "6": "yyMMdd"}
TIME_BY_LENGTH = {"4": "HHmm", "5": "HH:mm", "6": "HHmmss", "8": "HH:mm:ss", "10": "HH:mm:sstt", "11": "HH:mm:ss tt"}
PHONE_BY_LENGTH = {"10": "##########", "12": "### ###-####", "14": "(###) ###-####"}
PHONE = "##########"

_DEFAULTS = {
    "masking_rule": UNDECIDED,
    "string_format": "",
    "rule_reasoning": "",
    "completed": "Uncompleted",
    "retain_empty": "TRUE",
    "preview": "TRUE",
}


def _rule(name: str | Column, fmt: str | Column = "", **more) -> dict:
    return {"masking_rule": name, "string_format": fmt, **more}


def _unmasked(reason: str = "", **more) -> dict:
    return _rule(NOT_REQUIRED, rule_reasoning=reason, **more)


def _steps() -> list[Step]:
    name, kind, comments, table = (F.col(c) for c in ("column_name", "__kind", "__comments", "__table"))
    low, high = F.col("min"), F.col("max")
    nothing = ((low == "") & (high == "")) | ((low == "NULL") & (high == "NULL")) | ((low == "1") & (high == "1"))
    measured = has(kind, "NUMERIC", "DECIMAL")
    phone = has(name, "PHONE_NO", "PHONE_NUMBER", "FAX_NO") | ends(name, "_PHONE") | (
        ends(name, "_NUMBER") & (low == "10") & (high == "10")
    )
    number = has(kind, "NUMBER") | (kind == "INT")
    whole = ~is_decimal_text(high) & ~is_decimal_text(low)
    vehicle_table, vehicle_name = has(table, "VEHICLE"), has(name, "VEHICLE")
    second_or_third = has(name, "2", "3")
    in_line = has(name, "ADDRESS") & has(name, "_LINE")
    length = F.coalesce(high.try_cast("int"), F.lit(0))
    return [
        Step(has(name, "_ID"), _unmasked("Column Identifier", preview="FALSE")),
        Step(has(kind, "SDO_GEOMETRY"), _rule("ShufflePolygon", rule_reasoning="Column contains Polygon and Geometry")),
        Step(has(kind, "BLOB", "VARBINARY"), _rule("Blob", rule_reasoning="Column contains binary objects (image and docs)")),
        Step(nothing, _unmasked("No sensitive record found in this column", completed="Completed", preview="FALSE")),
        Step(has(kind, "DATE", "TIME"), _rule("DateOfBirth", retain_empty="FALSE")),
        Step(ends(name, "_DATE"), _rule("Date", choose(high, DATE_BY_LENGTH), rule_reasoning="This column is String of DateTime")),
        Step(ends(name, "_TIME"), _rule("TimeSpan", choose(high, TIME_BY_LENGTH))),
        Step(has(name, "LONGITUDE") & measured, _rule("Longitude")),
        Step(has(name, "LATITUDE") & measured, _rule("Latitude")),
        Step(has(name, "FIRST_NAME", "FIRSTNAME", "MIDDLE_NAME"), _rule("FirstName")),
        Step(kind == "CLOB", _rule("Clob")),
        Step((name == "CITY") | ends(name, "_CITY"), _rule("City", "{{ADDRESS.CITY}}")),
        Step(name.isin("STATE", "PROVINCE"), _rule("State", "{{ADDRESS.CITY}}")),
        Step(has(name, "COUNTRY"), _rule("Bogus", "{{ADDRESS.COUNTRY}}")),
        Step(has(name, "SURNAME", "LASTNAME"), _rule("LastName")),
        Step(has(name, "COMPANY_NAME", "ORGANIZATION_NAME"), _rule("Company", "{{COMPANY.COMPANYNAME}} {{COMPANY.COMPANYSUFFIX}}")),
        Step(has(name, *COMMENT_WORDS), _rule("Rant")),
        Step((name == "YEAR") | ends(name, "_YEAR"), _rule("RandomYear")),
        Step(phone & has(kind, "NUMBER"), _rule("PhoneNumberInt", PHONE)),
        Step(phone, _rule("PhoneNumber", choose(high, PHONE_BY_LENGTH, PHONE))),
        Step(has(name, "EMAIL_ADDRESS"), _rule("Bogus", "{{INTERNET.EMAIL}}")),
        Step(has(kind, "MONEY"), _rule("Money", "{{FINANCE.AMOUNT}}")),
        Step(has(name, "POSTAL_CODE"), _rule("PostalCode")),
        Step(in_line & has(name, "1"), _rule("fullAddress")),
        Step(in_line & second_or_third, _rule("SecondaryAddress")),
        Step(in_line, _unmasked()),
        Step(has(name, "_ADDRESS") & has(name, "1"), _rule("fullAddress")),
        Step(has(name, "_ADDRESS") & second_or_third, _rule("SecondaryAddress")),
        Step(ends(name, "_ADDRESS"), _rule("FullAddress", "{{address.fullAddress}}")),
        Step(has(name, "_ADDRESS"), _rule(UNDECIDED)),
        Step(has(name, *NAME_WORDS), _rule("CompanyPersonName", "{{NAME.FULLNAME}}")),
        Step(has(name, "USERID", "USERNAME"), _rule("RandomUsername")),
        Step(has(name, "FILE_NAME", "FILENAME"), _rule("File", "{{SYSTEM.FILENAME}}")),
        Step(has(name, "_AMOUNT", "_AMT"), _rule("RandomDec")),
        Step(number & whole & (whole_number(high) > 2147483647), _rule("RandomInt64")),
        Step(number & whole & (whole_number(high) == 0), _unmasked()),
        Step(number & whole, _rule("RandomInt")),
        Step(number, _rule("RandomDec")),
        Step(vehicle_table & ((name == "MAKE") | ends(name, "_MAKE")), _rule("Vehicle", "Manufacturer")),
        Step(vehicle_table & ((name == "MODEL") | ends(name, "_MODEL")), _rule("Vehicle", "Model")),
        Step(vehicle_table & (has(name, "_IDENTIFICATION_NUMBER") | ends(name, "_VIN") | (name == "VIN")), _rule("Vehicle", "Vin")),
        Step(vehicle_table & ((name == "FUEL") | ends(name, "_FUEL")), _rule("Vehicle", "Fuel")),
        Step(vehicle_table & has(name, "_TYPE", "_STYLE"), _rule("Vehicle", "Type")),
        Step(vehicle_table, _rule(UNDECIDED)),
        Step(vehicle_name & has(name, "_MAKE"), _rule("Vehicle", "Manufacturer")),
        Step(vehicle_name & has(name, "_MODEL"), _rule("Vehicle", "Model")),
        Step(vehicle_name & has(name, "_IDENTIFICATION", "_REGISTRATION"), _rule("Vehicle", "Vin")),
        Step(vehicle_name & ends(name, "_FUEL"), _rule("Vehicle", "Fuel")),
        Step(vehicle_name & ends(name, "_TYPE", "BODY_STYLE"), _rule("Vehicle", "Type")),
        Step(vehicle_name, _rule(UNDECIDED)),
        Step(ends(name, "_NUMBER") & has(kind, "VARCHAR", "CHARACTER"), _rule("StringConcat", F.repeat(F.lit("#"), length))),
        Step(ends(name, "_DIRECTORY"), _rule("Bogus", "{{SYSTEM.DIRECTORYPATH}}")),
        Step(is_decimal_text(high) & is_decimal_text(low), _rule("RandomDec")),
        Step(has(comments, "identif"), _unmasked()),
        Step(has(comments, "address") & has(name, "LINE") & has(name, "1"), _rule("fullAddress")),
        Step(has(comments, "address") & has(name, "LINE"), _rule("SecondaryAddress")),
    ]


def classify_columns(profile: DataFrame, as_of: str = "2024-01-01 00:00:00") -> DataFrame:
    """The profile with ``masking_rule, string_format, rule_reasoning, completed, retain_empty, preview`` added.

    A time column whose bounds are equal gets ``as_of`` as its upper bound.
    """
    read = {"__kind": F.upper("data_type"), "__comments": F.lower("comments"), "__table": F.upper("table_name")}
    decided = decide(swap_bounds(profile).withColumns(read), _steps(), _DEFAULTS).drop(*read)
    point = (F.col("masking_rule") == "DateOfBirth") & (F.col("min") == F.col("max")) & (F.col("min") != NO_DATE)
    return decided.withColumn("max", F.when(point, as_of).otherwise(F.col("max")))


def classify_defaults(classified: DataFrame, target_schema: str = "") -> DataFrame:
    """Rule sheet rows: null kept, target schema, key column from the constraint or from the key list."""
    target = F.lit(target_schema.upper()) if target_schema else F.col("schema_name")
    return classified.withColumns({"retain_null": F.lit("TRUE"), "target_schema": target, "use_value": F.lit("")})


def key_constraint(constraint: Column, key_id: Column) -> Column:
    """The constraint, or the key column where it is empty."""
    return F.when(F.coalesce(constraint, F.lit("")) == "", key_id).otherwise(constraint)


def classify_simple(profile: DataFrame) -> DataFrame:
    """The small variant: identifiers unmasked, dates as birth dates, the rest undecided."""
    name, kind = F.upper("column_name"), F.upper("data_type")
    rule = F.when(has(kind, "DATE"), "DateOfBirth").when(has(name, "_ID"), NOT_REQUIRED).otherwise(UNDECIDED)
    bounded = has(kind, "DATE", "NUMBER", "MONEY", "DECIMAL", "FLOAT", "BIT", "VARCHAR", "CHARACTER", "TEXT") | kind.isin(
        "INT", "INTEGER"
    )
    return profile.select(
        "table_name", "column_name", "data_type", rule.alias("masking_rule"), F.lit("TRUE").alias("retain_null"),
        F.lit("TRUE").alias("retain_empty"), F.lit("FALSE").alias("preview"),
        F.when(bounded, F.col("min")).otherwise("").alias("min"), F.when(bounded, F.col("max")).otherwise("").alias("max"),
    )
