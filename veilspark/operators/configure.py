"""From the rule sheet to the column configuration, with its checks and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.cascade import Step, choose, decide, has
from veilspark.plans.rules import RULE_TYPES

# Words of the cascade: fixed values.
COMMENT_WORDS = [
    "Description", "DESCRIPTION", "TEXT", "MEMO", "describing", "Descr", "COMMENT", "comment", "NOTE", "Comment", "REMARK",
    "remark", "DESC",
]
NAME_WORDS = ["full name", "AGENT_NAME", "OFFICER_NAME", "FULL_NAME", "CONTACT_NAME", "MANAGER_NAME"]
BY_NAME_RULES = ["NO MASKING REQUIRED", "REPLACE VALUE WITH FAKE DATA", "SHUFFLE", "FLAGGED"]
TEXT_TYPES = ["CHAR", "NCHAR", "STRING", "VARCHAR", "NVARCHAR", "BINARY", "VARBINARY", "CHARACTER VARYING"]
SCRAMBLE_TYPES = TEXT_TYPES + ["NUMERIC", "DECIMAL", "DOUBLE", "INT", "NUMBER"]
VEHICLE_KINDS = ["Manufacturer", "Vin", "Model", "Type", "Fuel"]
COMPANY = "{{COMPANY.COMPANYNAME}} {{COMPANY.COMPANYSUFFIX}}"
PHONE = "##########"
NO_DATE = "-- ::"

# Rule types whose bounds lose everything after the point, whose pattern is empty, or whose pattern is fixed: fixed values.
CUT_BOUNDS = """CompanyPersonName Scramble Company TimeSpan StringConcat Bogus RandomUsername FullName LastName Date PickRandom
RandomString2 Rant Lorem StringFormat FullAddress StreetAddress SecondaryAddress PhoneNumber File RandomYear RandomInt""".split()
NO_PATTERN = "Scramble RandomUsername FirstName FullName LastName DateOfBirth Clob Geometry ShufflePolygon Shufflegeometry".split()
FIXED_PATTERN = {
    "Company": COMPANY, "Money": "{{FINANCE.AMOUNT}}", "State": "Canada", "City": "BC", "FullAddress": "Canada",
    "File": "{{SYSTEM.FILENAME}}",
}
# Rule types a sheet may name but that set nothing: fixed values.
WITHOUT_SETTINGS = ["NULL", "Ignore", "Location", "exception", "Computed", "RandomHexa"]

_DEFAULTS = {"type": "Ignore", "ignore": False, "pattern": "", "gender_column": "", "unmapped": False}


def _cut(text: Column) -> Column:
    """What stands before the point, if anything does."""
    return F.when(F.instr(text, ".") > 1, F.substring_index(text, ".", 1)).otherwise(text)


def _size_text(data_type: Column) -> Column:
    """The second word of a type text with its brackets taken as blanks; null when there is none."""
    words = F.split(F.translate(F.upper(data_type), "()", "  "), " ")
    return F.nullif(F.get(words, F.lit(1)), F.lit(""))


def _parsed_type(rule: Column) -> Column:
    """Canonical rule type of a sheet text; null when unknown."""
    names = {n.lower(): n for n in RULE_TYPES if n not in ("Error", "Filename")} | {"filename": "File"}
    return choose(F.lower(F.trim(rule)), names, F.lit(None).cast("string"))


def file_name_column(sheet: DataFrame) -> DataFrame:
    """Per table the column that holds file names."""
    named = sheet.where(F.col("column_name").isin("FILE_NAME", "FILENAME"))
    return named.groupBy("table_name").agg(F.min_by("column_name", "column_id").alias("__file_name"))


def _fallback_steps(name: Column, kind: Column, comments: Column) -> list[Step]:
    """The cascade by name and type, for sheets that leave the choice open."""
    size, low = F.col("__size"), F.col("min")
    fmt = F.col("string_format")
    measured = has(kind, "NUMERIC", "DECIMAL")
    phone = has(name, "PHONE_NO", "FAX_NO", "CONTRACT_NO", "CELL", "_PHONE", "PHONENUMBER")
    phone_format = F.when(fmt == "", PHONE).otherwise(fmt)
    rant = has(name, *COMMENT_WORDS) | has(kind, "CHAR") | has(comments, *COMMENT_WORDS)
    sized = F.coalesce(size, F.col("max"))
    address = has(name, "ADDRESS")
    place = {"gender_column": "Canada"}

    def step(condition, type_, pattern="", **more):
        return Step(condition, {"type": type_, "pattern": pattern, **more})

    return [
        step(has(name, "LONGITUDE") & measured, "Longitude", F.coalesce("description", F.lit(""))),
        step(has(name, "LATITUDE") & measured, "Latitude", F.coalesce("description", F.lit(""))),
        step(has(name, "FIRST_NAME", "FIRSTNAME", "MIDDLE_NAME"), "FirstName", "{{NAME.FIRSTNAME}}"),
        step(kind.isin("BLOB", "IMAGE"), "Blob", F.coalesce("__file_name", fmt)),
        step(kind == "CLOB", "Clob", fmt),
        step(has(name, "CITY"), "City", "BC", **place),
        step(has(name, "STATE", "PROVINCE"), "State", "Canada", **place),
        step(has(name, "COUNTRY"), "Bogus", "{{ADDRESS.COUNTRY}}", **place),
        step(has(kind, "GEOMETRY"), "ShufflePolygon", fmt),
        step(has(name, "SURNAME", "LASTNAME", "LAST_NAME"), "LastName", "{{NAME.LASTNAME}}"),
        step(has(name, "COMPANY_NAME", "ORGANIZATION_NAME"), "Company", COMPANY),
        step(rant, "Rant", "DESCRIPTION", min=F.lit("1"), max=sized),
        step(has(kind, "DATE"), "DateOfBirth"),
        step(name == "YEAR", "RandomYear"),
        step(phone & has(kind, "NUMBER"), "PhoneNumberInt", phone_format),
        step(phone, "PhoneNumber", phone_format),
        step(has(name, "EMAIL_ADDRESS"), "Bogus", "{{INTERNET.EMAIL}}"),
        step(has(kind, "MONEY"), "Money", "{{FINANCE.AMOUNT}}"),
        step(has(name, "POSTAL_CODE"), "PostalCode"),
        step(address & size.isNotNull() & has(F.col("column_name"), "2", "3"), "SecondaryAddress", "{{address.fullAddress}}", max=size, **place),
        step(address & size.isNotNull() & has(name, "STREET"), "StreetAddress", "{{address.fullAddress}}", max=size, **place),
        step(address, "FullAddress", "{{address.fullAddress}}", max=sized, **place),
        step(has(name, "USERID", "USERNAME"), "RandomUsername"),
        step(has(name, "FILE_NAME"), "File", "{{SYSTEM.FILENAME}}"),
        step(has(name, *NAME_WORDS) | has(comments, *NAME_WORDS), "Bogus", "{{NAME.FULLNAME}}"),
        step(has(name, "AMOUNT", "AMT") | has(comments, "Amount"), "RandomDec"),
        step(name == "NAME", "Bogus", "{{COMPANY.COMPANYNAME}}"),
        step(has(name, "AUTHOR", "EDITOR") & has(kind, "VARCHAR"), "FullName", min=_cut(low), max=_cut(F.col("max"))),
        step(has(kind, "NUMBER"), "RandomInt"),
        step(name == "TOTAL_AREA", "Bogus"),
        step(F.lit(True), "Ignore", ignore=True, unmapped=True),
    ]


def _explicit_steps(parsed: Column, as_of: str) -> list[Step]:
    """Steps for sheets that name a rule type."""
    low, high, fmt = F.col("min"), F.col("max"), F.col("string_format")
    cut = parsed.isin(*CUT_BOUNDS)
    pattern = choose(parsed, FIXED_PATTERN | {n: "" for n in NO_PATTERN}, fmt)
    undated = (high == NO_DATE) | (low == NO_DATE)
    digits = F.regexp_replace(fmt, r"\D", "")
    general = {"type": parsed, "pattern": pattern, "min": F.when(cut, _cut(low)).otherwise(low), "max": F.when(cut, _cut(high)).otherwise(high)}
    return [
        Step(parsed.isNull(), {"type": "None", "ignore": True, "min": F.lit(""), "max": F.lit("")}),
        Step(parsed.isin(*WITHOUT_SETTINGS), {"type": "None", "min": F.lit(""), "max": F.lit("")}),
        Step(parsed == "NoMasking", {"type": "None", "ignore": True, "min": F.lit(""), "max": F.lit("")}),
        Step(parsed == "MaskingOut", {"type": parsed, "pattern": F.substring_index(fmt, "(", 1), "min": low, "max": digits}),
        Step(
            parsed == "DateOfBirth",
            general | {"ignore": undated, "retain_empty": F.lit(False), "max": F.when((high == low) & (high != NO_DATE), as_of).otherwise(high)},
        ),
        Step(parsed == "Date", general | {"ignore": undated, "retain_empty": F.lit(False)}),
        Step(parsed == "Rant", general | {"min": F.lit("1")}),
        Step(parsed.isin("PhoneNumber", "PhoneNumberInt"), general | {"pattern": F.when(fmt == "", PHONE).otherwise(fmt)}),
        Step(parsed == "Blob", general | {"pattern": F.coalesce("__file_name", F.lit(""))}),
        Step(F.lit(True), general),
    ]


CONFIG = [
    "table_name", "column_name", "type", "ignore", "pattern", "min", "max", "operator", "gender_column", "retain_null",
    "retain_empty", "use_value", "preview", "unmapped",
]


def _all(conditions: list[Column], step: Step) -> Step:
    return Step(reduce(lambda a, b: a & b, [*conditions, step.condition]), step.outcome)


def rule_to_config(sheet: DataFrame, as_of: str = "2024-01-01 00:00:00") -> DataFrame:
    """One configuration row per sheet row, without key columns and flagged rows."""
    read = {
        "__rule": F.upper("masking_rule"), "__name": F.upper("column_name"), "__kind": F.upper("data_type"),
        "__parsed": _parsed_type(F.col("masking_rule")), "__size": _size_text(F.col("data_type")),
    }
    rule, name, kind, parsed = (F.col(c) for c in ("__rule", "__name", "__kind", "__parsed"))
    geometry = has(kind, "GEOMETRY")
    open_choice = has(rule, *BY_NAME_RULES)
    steps = [
        Step(has(rule, "NO MASKING") & geometry, {"type": "Geometry", "ignore": True}),
        Step(has(rule, "NO MASKING"), {"type": "NoMasking", "ignore": True}),
        Step(rule == "SHUFFLE", {"type": "Shuffle"}),
        Step(has(rule, "MATH"), {"type": "math", "pattern": F.col("string_format"), "operator": F.col("rule_reasoning")}),
        *[_all([~open_choice], s) for s in _explicit_steps(parsed, as_of)],
        *_fallback_steps(name, kind, F.coalesce("comments", F.lit(""))),
    ]
    defaults = _DEFAULTS | {
        "min": F.col("min"),
        "max": F.col("max"),
        "operator": "",
        "retain_empty": F.upper("retain_empty") != "FALSE",
    }
    keys = F.transform(F.split(F.coalesce("pk_constraint", F.lit("")), ","), lambda k: F.trim(k))
    kept = sheet.withColumns(read).where(~F.array_contains(keys, F.col("column_name")) & ~has(rule, "FLAGGED"))
    joined = kept.join(file_name_column(sheet), "table_name", "left")
    named = joined.withColumns(
        {
            "retain_null": F.upper("retain_null") == "TRUE",
            "use_value": F.nullif(F.col("use_value"), F.lit("")),
            "preview": F.upper("preview") != "FALSE",
        }
    )
    return decide(named, steps, defaults).select(*CONFIG)


def rule_violations(sheet: DataFrame) -> DataFrame:
    """``(table_name, column_name, violation)``: faults of the rule sheet. One pass, one row per fault."""
    rule, kind = F.lower(F.trim("masking_rule")), F.upper("data_type")
    fmt, low, high = F.col("string_format"), F.col("min"), F.col("max")
    no_format, no_low, no_high = fmt == "", low == "", high == ""
    unbounded = no_low | no_high
    longest = F.array_max(F.transform(F.split(fmt, ","), lambda x: F.length(x)))

    def is_(*names: str) -> Column:
        return rule.isin(*[n.lower() for n in names])

    checks = [
        (has(rule, "math") & has(kind, *TEXT_TYPES), "math on a text type"),
        (has(rule, "math") & no_format, "math without pattern"),
        (is_("Vehicle") & no_format, "Vehicle without pattern"),
        (is_("Vehicle") & ~no_format & ~fmt.isin(*VEHICLE_KINDS), "Vehicle of unknown kind"),
        (is_("MaskingOut") & ~has(kind, *TEXT_TYPES), "MaskingOut on a type that is not text"),
        (is_("MaskingOut") & no_format, "MaskingOut without pattern"),
        (is_("Scramble") & ~has(kind, *SCRAMBLE_TYPES), "Scramble on another type"),
        (is_("TimeSpan", "StringConcat", "Bogus") & no_format, "rule without pattern"),
        (is_("RandomUsername", "DateOfBirth", "Date", "RandomString2") & unbounded, "rule without Min and Max"),
        (is_("Date") & no_format, "Date without pattern"),
        (is_("PickRandom") & (no_format | no_high), "PickRandom without list or Max"),
        (is_("PickRandom") & ~no_format & ~no_high & (longest > _cut(high).try_cast("int")), "PickRandom item longer than Max"),
        (is_("Rant", "Lorem") & no_high, "text rule without Max"),
        (is_("RandomDec", "RandomInt") & no_high, "number rule without Max"),
        (is_("RandomDec", "RandomInt") & no_low, "number rule without Min"),
    ]
    faults = F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, text in checks]))
    return sheet.select("table_name", "column_name", F.explode(faults).alias("violation"))


def tables_without_key(sheet: DataFrame) -> DataFrame:
    """``(table_name, n_columns)`` of tables whose key constraint is empty."""
    return sheet.where(F.col("pk_constraint") == "").groupBy("table_name").agg(F.count("*").alias("n_columns"))


def unmapped_columns(config: DataFrame) -> DataFrame:
    """``(table_name, column_name, n_unmapped)``: columns no rule was found for."""
    found = config.where("unmapped").select("table_name", "column_name")
    return found.withColumn("n_unmapped", found.agg(F.count("*")).scalar())


def config_diff(built: DataFrame, saved: DataFrame) -> DataFrame:
    """``(table_name, column_name, property, old_value, new_value)`` where the two configurations differ."""
    properties = [c for c in CONFIG if c not in ("table_name", "column_name")]

    def long(config: DataFrame, value: str) -> DataFrame:
        pairs = [x for p in properties for x in (F.lit(p), F.col(p).cast("string"))]
        return config.select("table_name", "column_name", F.stack(F.lit(len(properties)), *pairs).alias("property", value))

    both = long(saved, "old_value").join(long(built, "new_value"), ["table_name", "column_name", "property"], "full_outer")
    return both.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def math_source_check(config: DataFrame) -> DataFrame:
    """``(table_name, column_name, source, violation)`` of arithmetic rules; needs ``position`` and ``data_type``.

    A source must stand earlier in the configuration and be numeric; an operator must have a formula.
    """
    rules = config.where(F.col("type") == "math")
    wanted = rules.select(
        "table_name", "column_name", "position", "operator", F.explode(F.split("pattern", ",")).alias("source")
    ).withColumn("source", F.trim("source"))
    sources = config.select(
        "table_name", F.col("column_name").alias("source"), F.col("position").alias("__at"), F.col("data_type").alias("__kind")
    )
    joined = wanted.join(sources, ["table_name", "source"], "left")
    own = F.upper("source") == F.upper("column_name")
    faults = [
        F.when(~own & (F.coalesce("__at", F.lit(2**31 - 1)) >= F.col("position")), F.lit("source must come earlier")),
        F.when(~has(F.coalesce(F.upper("__kind"), F.lit("")), "INT", "NUM", "FLOAT", "DEC", "DOUBLE"), F.lit("source must be numeric")),
        F.when(~F.lower("operator").isin("addition", "substraction", "percentage", "randompercentage", "avarage", "division"), F.lit("operator without formula")),
    ]
    return joined.select("table_name", "column_name", "source", F.explode(F.array_compact(F.array(*faults))).alias("violation"))
