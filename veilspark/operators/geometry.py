"""Geometry structs ``(gtype, srid, point, elem, ordinates)``: redraw, permute, render as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.draw import Draws

# Range of a drawn ordinate, in hundred-millionths: fixed values.
ORDINATE_LOW, ORDINATE_HIGH, ORDINATE_SCALE = -429140204717672, 1614434940322170, 8


def _rotated(point: Column) -> Column:
    turned = F.struct(point["y"].alias("x"), point["z"].alias("y"), point["x"].alias("z"))
    return F.when(point.isNotNull(), turned)


def _permuted(values: Column, draws: Draws, part: str) -> Column:
    """Array elements in the order of a keyed hash; the digest is bound once per row."""
    ranked = F.transform(
        F.array(draws.digest(part)),
        lambda seed: F.transform(
            F.array_sort(
                F.transform(values, lambda v, i: F.struct(F.md5(F.concat(seed, i.cast("string"))).alias("h"), i.alias("i"), v.alias("v")))
            ),
            lambda x: x["v"],
        ),
    )
    return F.get(ranked, F.lit(0))


def _with(geometry: Column, point: Column, elem: Column, ordinates: Column) -> Column:
    built = F.struct(
        geometry["gtype"].alias("gtype"), geometry["srid"].alias("srid"), point.alias("point"), elem.alias("elem"),
        ordinates.alias("ordinates"),
    )
    return F.when(geometry.isNotNull(), built)


def geometry_random(geometry: Column, draws: Draws, kind: str) -> Column:
    """Keep type and reference system, rotate the point, draw every ordinate; without ordinates permute the elements."""
    span = ORDINATE_HIGH - ORDINATE_LOW + 1

    def ordinate(seed: Column, i: Column) -> Column:
        number = F.conv(F.substring(F.md5(F.concat(seed, i.cast("string"))), 1, 15), 16, 10).cast("bigint")
        return ((F.lit(ORDINATE_LOW) + number % F.lit(span)).cast("decimal(20,0)") * F.expr("0.00000001BD")).cast(kind)

    old = geometry["ordinates"]
    drawn = F.get(
        F.transform(F.array(draws.digest("o")), lambda seed: F.transform(old, lambda v, i: ordinate(seed, i))), F.lit(0)
    )
    elem = F.when(old.isNotNull(), geometry["elem"]).otherwise(_permuted(geometry["elem"], draws, "e"))
    return _with(geometry, _rotated(geometry["point"]), elem, F.when(old.isNotNull(), drawn))


def geometry_shuffle(geometry: Column, draws: Draws) -> Column:
    """Permute ordinates and elements in place, rotate the point; an unchanged order is turned by one."""

    def moved(values: Column, part: str) -> Column:
        mixed = _permuted(values, draws, part)
        turned = F.concat(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, 1))
        return F.when(F.size(values) > 1, F.when(mixed == values, turned).otherwise(mixed)).otherwise(values)

    return _with(
        geometry, _rotated(geometry["point"]), _permuted(geometry["elem"], draws, "e"), moved(geometry["ordinates"], "o")
    )


def geometry_literal(geometry: Column) -> Column:
    """Oracle constructor text of a geometry."""

    def numbers(values: Column, separator: str) -> Column:
        return F.array_join(F.transform(values, lambda v: v.cast("string")), separator)

    def cell(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("NULL"))

    point = geometry["point"]
    point_text = F.when(
        point.isNotNull(),
        F.concat(F.lit("MDSYS.SDO_POINT_TYPE("), cell(point["x"]), F.lit(", "), cell(point["y"]), F.lit(", "), cell(point["z"]), F.lit(")")),
    )
    elem = F.concat(F.lit("MDSYS.SDO_ELEM_INFO_ARRAY("), numbers(geometry["elem"], ","), F.lit(")"))
    ordinates = F.concat(F.lit("MDSYS.SDO_ORDINATE_ARRAY("), numbers(geometry["ordinates"], ", "), F.lit(")"))
    null = F.lit("NULL")
    return F.concat(
        F.lit("MDSYS.SDO_GEOMETRY("),
        F.concat_ws(
            ",",
            F.coalesce(geometry["gtype"].cast("string"), F.lit("")),
            F.coalesce(geometry["srid"].cast("string"), F.lit("")),
            F.coalesce(point_text, null),
            F.coalesce(elem, null),
            F.coalesce(ordinates, null),
        ),
        F.lit(")"),
    )
