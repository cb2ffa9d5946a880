"""Mixing sources to target weights: capped water-filling of the targets, then whole and fractional repetitions of documents.

Targets: a share of all words is dealt to the sources by weight; a source that would get more than `most_epochs` times its words is
clamped there, and what it leaves is dealt again by weight until no source is above. Each round is one aggregate over the sources; only
three numbers come to the driver.

Sample: a document is taken floor(rate) times, rate = target / words of its source, and one more time for a fraction of the documents.
These are picked systematically, in order of size class and seeded hash within the source, so that every size is hit evenly and the
words taken come near the target. Cells (source, size class, hash bucket) hold about CELL_ROWS documents at any size of a source; the
position of a cell comes from the counts of the cells before it.

Rows that share id, source and size are interchangeable: they are counted and numbered, and the number goes into the hash. So many rows of
one id, or without an id, spread over the cells as others do, and reruns agree: nothing depends on partitions or the order of rows.

A null text counts 0 words, and documents of 0 words add nothing whatever they are taken. Null is a source of its own, after all others.
Without rows, or without words, targets are 0. Other columns are not read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm import words as W
from veilspark.llm.frames import heavy_keys, looked_up, per_batch, picked, row_key
from veilspark.llm.tables import written

CELL_ROWS = 16_384
RUN_ROWS = 10_000
WEIGHTS = (3, 1, 2)


def sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """Words of each document, with its id and source."""
    frame = picked(docs, doc_id=id_col, source=source_col, text=text_col)
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}

    def make(batch: pa.RecordBatch) -> dict:
        found = [np.bincount(np.searchsorted(s.bounds, W.spans(s)[0], "right") - 1, minlength=s.rows) for s in W.slices(batch.column("text"))]
        size = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
        return {"doc_id": batch.column("doc_id"), "source": batch.column("source"), "size": size}

    return per_batch(frame, f"doc_id {kinds['doc_id']}, source {kinds['source']}, size long", make)


def weighed(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """source, source_size, weight: the weights repeat over the sources by code point, null last."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = by_source.orderBy(F.col("source").asc_nulls_last())
    schema = f"source {by_source.schema['source'].dataType.simpleString()}, source_size long, n long"
    numbered = ordered.sparkSession.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])), schema)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    return numbered.select("source", "source_size", weight.alias("weight"))


def filled(sources: DataFrame, share: float, most_epochs: float) -> DataFrame:
    """The sources with their targets."""
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    cap = F.col("source_size") * F.lit(float(most_epochs))
    level = 0.0
    while True:
        # Sources above their cap at this level are clamped; the rest shares what is left.
        above = (F.col("weight") * F.lit(level) > cap) if level else F.lit(False)
        held, free = sources.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        if not free:
            break
        new = (total - (held or 0.0)) / free
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def _fraction(*parts: Column | str, seed: str) -> Column:
    """60 bits of a seeded hash."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def numbered(groups: DataFrame, many: str, number: str) -> DataFrame:
    """Each row `many` times, numbered from 0. Large groups are dealt out in runs of RUN_ROWS first, so that no task repeats one row without end."""
    runs = F.sequence(F.lit(0).cast("long"), F.floor((F.col(many) - 1) / F.lit(RUN_ROWS)))
    large = groups.where(F.col(many) > RUN_ROWS).withColumn("__run", F.explode(runs))
    large = large.repartition("__run", *groups.columns)
    first = F.col("__run") * RUN_ROWS
    each = F.sequence(first, F.least(first + RUN_ROWS, F.col(many)) - 1)
    small = groups.where(F.col(many).between(1, RUN_ROWS)).withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1)))
    return small.unionByName(large.withColumn(number, F.explode(each)).drop("__run"))


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most_epochs: float = 2.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target of its source, copies, and taken = size * copies."""
    sizes = sized(docs, id_col, source_col, text_col)
    equal = written(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "sizes")
    sources = written(weighed(equal.withColumn("size", F.col("size") * F.col("rows")), weights), "sources")
    targets = filled(sources, share, most_epochs)
    digits = F.col("size").cast("string")
    kind = F.length(digits) * 100 + F.rpad(F.substring(digits, 1, 2), 2, "0").cast("int")
    drawn = numbered(equal, "rows", "k").drop("rows").withColumn("kind", kind)
    drawn = drawn.withColumn("u", _fraction(F.col("doc_id"), F.col("size"), F.col("k"), seed=seed)).withColumn("stratum", _stratum())
    strata = written(drawn.groupBy("stratum", "source", "kind").agg(F.count("*").alias("rows")).withColumn("parts", F.ceil(F.col("rows") / F.lit(CELL_ROWS))), "strata")
    split = looked_up(drawn, "stratum", strata, "stratum", heavy_keys(strata, "rows"), F.unhex(F.md5(F.concat_ws("|", "u", "k"))), parts="parts")
    split = written(split.withColumn("part", F.col("u") % F.col("parts")).drop("parts"), "cells")
    ranked = split.withColumn("place", F.row_number().over(Window.partitionBy("stratum", "part").orderBy("u", "doc_id", "size", "k")) - 1)
    cells = _cells(split, strata, targets)
    ranked = ranked.join(cells, ["stratum", "part"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = _fraction(F.col("source"), seed=seed + "-start") / F.lit(float(1 << 60))
    rest, at = rate - F.floor(rate), F.col("place") + F.col("before")
    more = F.floor(rest * (at + 1) + start) - F.floor(rest * at + start)
    copies = (F.floor(rate) + more).cast("long")
    return ranked.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def _stratum() -> Column:
    """One binary key of source and size class."""
    return F.unhex(F.md5(F.concat_ws("|", F.col("kind").cast("string"), F.when(F.col("source").isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), F.col("source").cast("string"))))))


def _cells(split: DataFrame, strata: DataFrame, targets: DataFrame) -> DataFrame:
    """stratum, part, rows before it in its source, and the source's size and target. The rows before a cell are those of smaller size classes
    (of which a source has some hundreds) and of earlier parts of its own."""
    smaller = Window.partitionBy("source").orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)
    bases = strata.withColumn("base", F.coalesce(F.sum("rows").over(smaller), F.lit(0)))
    bases = bases.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("stratum", "base", "source_size", "target")
    earlier = Window.partitionBy("stratum").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = split.groupBy("stratum", "part").agg(F.count("*").alias("rows")).withColumn("earlier", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    return cells.join(bases, "stratum").select("stratum", "part", (F.col("base") + F.col("earlier")).alias("before"), "source_size", "target")


def repeated_documents(docs: DataFrame, source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it. Ids are not looked at: a row is known by all its columns, and what is taken
    of equal rows is spread over them evenly."""
    keyed = docs.withColumn("__id", row_key(docs))
    copies = mix_sources(keyed, id_col="__id", source_col=source_col, text_col=text_col, **options)
    of_key = written(copies.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("rows"), F.sum("copies").alias("copies")), "copies")
    of_key = of_key.withColumns({"each": F.floor(F.col("copies") / F.col("rows")), "rest": F.col("copies") % F.col("rows")})
    any_key = F.concat(F.lit("row:").cast("binary"), F.monotonically_increasing_id().cast("string").cast("binary"))
    counted = looked_up(keyed, "__id", of_key, "__id", heavy_keys(of_key, "rows"), any_key, __each="each", __rest="rest")
    # The rest of equal rows is taken from one of them.
    columns = [F.col(f"`{c}`") for c in docs.columns]
    every = counted.where("__each > 0").withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__each")))).select(*columns)
    some = counted.where("__rest > 0").dropDuplicates(["__id"])
    return every.unionByName(numbered(some.select(*columns, "__rest"), "__rest", "__n").select(*columns))
