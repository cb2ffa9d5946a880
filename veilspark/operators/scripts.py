"""INSERT scripts: one text row per statement part, so that any table size stays distributed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import sqltext
from veilspark.functions.dates import parse_date
from veilspark.operators.geometry import geometry_literal
from veilspark.plans.rules import TableRule

# Rows above which one dialect writes one statement per row: fixed value.
SINGLE_STATEMENT_ROWS = 1000
SETTINGS_ON = "SET ANSI_NULLS ON\nGO\nSET QUOTED_IDENTIFIER ON\nGO\nSET ANSI_WARNINGS OFF\nGO"
SETTINGS_OFF = "SET ANSI_WARNINGS ON\nGO"


@dataclass(frozen=True)
class Dialect:
    name: str
    open: str
    close: str

    def quoted(self, name: str) -> str:
        return f"{self.open}{name.replace(self.close, 2 * self.close) if self.close else name}{self.close}"

    def table(self, rule: TableRule) -> str:
        return ".".join(self.quoted(n) for n in (rule.target_schema, rule.name) if n)

    def binary(self, value: Column) -> Column:
        before, after = _BINARY[self.name]
        return F.concat(F.lit(before), F.hex(value), F.lit(after))


# How each dialect writes bytes: fixed values.
_BINARY = {"sqlserver": ("0x", ""), "oracle": ("HEXTORAW('", "')"), "postgres": ("'\\x", "'::bytea"), "mysql": ("X'", "'")}


DIALECTS = {
    "sqlserver": Dialect("sqlserver", "[", "]"),
    "oracle": Dialect("oracle", "", ""),
    "postgres": Dialect("postgres", '"', '"'),
    "mysql": Dialect("mysql", "`", "`"),
}


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def _moment(value: Column, dialect: str) -> Column:
    text = _quoted(F.date_format(value, "yyyy-MM-dd HH:mm:ss"))
    return F.concat(F.lit("TO_DATE("), text, F.lit(", 'YYYY-MM-DD HH24:MI:SS')")) if dialect == "oracle" else text


def literal(value: Column, kind: T.DataType, dialect: str) -> Column:
    """SQL literal of a value."""
    if isinstance(kind, T.BooleanType):
        text = F.when(value, "1").otherwise("0")
    elif isinstance(kind, T.StringType):
        text = _quoted(value)
        if dialect in ("oracle", "mysql"):
            # A text that is an ISO date must not change its day.
            moment = parse_date(value, iso=True)
            text = F.when(moment.isNotNull(), _moment(moment, dialect)).otherwise(text)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        text = _moment(value, dialect)
    elif isinstance(kind, T.StructType) and "gtype" in kind.names:
        text = geometry_literal(value)
    elif isinstance(kind, T.BinaryType):
        text = DIALECTS[dialect].binary(value)
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "NULL").otherwise(text)


def rule_comment(rule: TableRule) -> str:
    """The trailing comment with the rule types."""
    return "-- No Masking PK, " + "".join(f"{r.type} ," for r in rule.columns)[:-1]


def insert_script(
    df: DataFrame,
    rule: TableRule,
    dialect: str,
    remove_fields: Sequence[str] = (),
    replace_field: str | None = None,
    replacement: str | None = None,
) -> DataFrame:
    """``(part, key..., statement)``: part 0 the heading, 1 one row per record, 2 the end.

    ``replace_field`` gets ``replacement`` (SQL text; None means NULL) in every row. One look at the keys tells how many rows there are and
    which key is the smallest; the rows themselves are read once, when the script is written.
    """
    spark, d = df.sparkSession, DIALECTS[dialect]
    dropped = {f.upper() for f in remove_fields}
    fields = [f for f in df.schema.fields if f.name.upper() not in dropped]
    names = ", ".join(d.quoted(f.name) for f in fields)
    key_fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in rule.key)
    rows, smallest = df.agg(F.count("*"), F.min(F.struct(*rule.key))).first()
    fixed: list[tuple[int, str]] = []
    if rows == 0:
        if dialect == "sqlserver":
            fixed.append((0, SETTINGS_ON))
        fixed.append((0, f"--INSERT INTO {d.table(rule)}({names}) DEFAULT VALUES"))
        fixed.append((0, "-- EMPTY TABLE NOTHING TO INSERT"))
        return _fixed(spark, fixed, rule.key, key_fields)

    cells = []
    for f in fields:
        if replace_field and f.name.upper() == replace_field.upper():
            cells.append(F.lit("NULL" if replacement is None else replacement))
        else:
            cells.append(literal(F.col(f.name), f.dataType, dialect))
    values = F.concat(F.lit("("), F.concat_ws(", ", *cells), F.lit(")"))
    if dialect == "oracle" or (dialect == "sqlserver" and rows > SINGLE_STATEMENT_ROWS):
        statement = F.concat(F.lit(f"INSERT INTO {d.table(rule)}({names}) VALUES "), values, F.lit(";"))
        body = df.select(F.lit(1).alias("part"), *rule.key, statement.alias("statement"))
    else:
        # The heading stands before the first row in key order. Rows of the smallest key (one, if it is a key) are counted by their text, so
        # that of equal ones a single one gets it.
        head = f"INSERT INTO {d.table(rule)}\n\t({names})\nVALUES \n"
        first = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.expr(f"CAST({sqltext.constant(v)} AS {df.schema[k].dataType.simpleString()})")) for k, v in zip(rule.key, smallest)])
        begin = df.where(first).select(*rule.key, values.alias("__values")).groupBy(*rule.key, "__values").agg(F.count("*").alias("__n"))
        chosen = begin.agg(F.min("__values")).scalar()
        number = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__i")
        begin = begin.select(*rule.key, "__values", number).select(
            F.lit(1).alias("part"), *rule.key, F.concat(F.when((F.col("__values") == chosen) & (F.col("__i") == 1), head).otherwise(","), "__values").alias("statement")
        )
        rest = df.where(~first).select(F.lit(1).alias("part"), *rule.key, F.concat(F.lit(","), values).alias("statement"))
        body = begin.unionByName(rest)

    if dialect == "sqlserver":
        fixed += [(0, SETTINGS_ON), (2, rule_comment(rule) + "\n" + SETTINGS_OFF)]
    else:
        if dialect == "oracle":
            fixed.append((0, f"REM INSERTING into {d.table(rule)}\nSET DEFINE OFF"))
        fixed.append((2, ("" if dialect == "oracle" else ";\n") + rule_comment(rule)))
    return body.unionByName(_fixed(spark, fixed, rule.key, key_fields))


def _fixed(spark, rows: list[tuple[int, str]], key: Sequence[str], key_fields: str) -> DataFrame:
    return spark.createDataFrame(
        [(part, *[None] * len(key), text) for part, text in rows], f"part int, {key_fields}, statement string"
    )


def write_script(script: DataFrame, key: Sequence[str], path: str) -> None:
    """Write a script as text files in statement order. A heading stands before the other rows of its key."""
    script.orderBy("part", *key, F.col("statement").startswith(",")).select("statement").write.text(path)
