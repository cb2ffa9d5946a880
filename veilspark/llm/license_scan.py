"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are runs of letters and digits, lower-cased; a shingle is SHINGLE words (a template of fewer words has shingles of TINY). Shingles are
compared as 64-bit hashes of the words.

Retrieval. A window is WINDOW shingles; a template has one at each of its shingles, a text one at every half window. The signature of a
window is the least of its shingles' hashes in each of `bands` permutations, a band of one row each; a text meets a template where one value
of a band is equal. A stretch that holds a share of 0.8 of a template and is 1.25 times as long has windows of a template density of 0.64 or
more, and the window of the template that lies over such a one has a Jaccard similarity of SIMILARITY with it. `band_count` takes the least
number of bands that misses all disjoint windows of the shortest such template with probability MISS or less. Templates of fewer than LONG
shingles have windows of one shingle at every place: there the signature is the shingle, and collision is certain.

Verification. The places of a retrieved template's shingles in the text are swept once: a place adds to the count of all stretches that
begin after the shingle's place before and not after this one. The template is found where some stretch, 1.25 times its length, holds at
least `share` of its distinct shingles. The cost is linear in these places, however often a license is repeated.

Of found templates that share half of the smaller one's shingles, or of which one is a passage of the other, one that the other explains is
left out (`specific`): X is explained by Y if
the text holds less than half of what X has beyond Y, and at least half of what Y has beyond X; or, where X has nothing beyond Y, at
least half of what Y has beyond X, and Y as often as X.

Only expressions, joins with the bounded list of templates, and aggregates run. Null and empty texts have no license; a license that occurs
twice is named once; rows that share an id are judged each; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspark.llm.license_texts import TEMPLATES
from veilspark.llm.tables import written

SHINGLE = 5
TINY = 3
WINDOW = 16
LONG = 48
MISS = 1e-3
# Least density of a template in the densest window of a stretch (0.8 / 1.25), as similarity of two windows of one size.
SIMILARITY = 0.64 / (2 - 0.64)


def band_count(windows: int, similarity: float = SIMILARITY, miss: float = MISS) -> int:
    """Bands of one row with which `windows` disjoint windows of this similarity are all missed with probability `miss` at most."""
    return math.ceil(math.log(miss) / (windows * math.log(1 - similarity)))


BANDS = band_count(LONG // WINDOW)
# Constants that permute hashes, one for each band: fixed values from the digits of pi.
PERMUTE = [0x243F6A8885A308D3, 0x13198A2E03707344, 0x24093822299F31D0, 0x082EFA98EC4E6C89, 0x452821E638D01377, 0x3E5466CF34E90C6C]


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_hashes(text: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.filter(F.transform(words, lambda w: F.when(w != "", F.xxhash64(w))), lambda h: h.isNotNull())


def shingle_hashes(words: Column, size: int) -> Column:
    """Hash of every run of `size` words; empty if there are fewer."""
    run = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), run)).otherwise(F.array().cast("array<bigint>"))


def window_keys(hashes: Column, band: int, step: int) -> Column:
    """MinHash in one band of the windows that begin at every `step`-th shingle and, but for the first, are whole."""
    mixed = F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(PERMUTE[band])))
    last = lambda m: F.greatest(F.size(m) - (WINDOW - step), F.lit(1))
    starts = lambda m: F.when(F.size(m) > 0, F.sequence(F.lit(1), last(m), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return _let(mixed, lambda m: F.transform(starts(m), lambda s: F.array_min(F.slice(m, s, WINDOW)).bitwiseXOR(F.lit(PERMUTE[band]))))


def prepared(spark: SparkSession, templates: dict[str, str], share: float) -> list[dict]:
    """Of each template its shingles and MinHash keys, made by the expressions that make those of texts, and the length and count to verify."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string").withColumn("w", word_hashes(F.col("text"))).where(F.size("w") > 0)
    rows = rows.withColumn("size", F.when(F.size("w") >= SHINGLE, SHINGLE).otherwise(F.least(F.size("w"), F.lit(TINY))))
    out = []
    for size in sorted(r["size"] for r in rows.select("size").distinct().collect()):
        of_size = rows.where(F.col("size") == size).withColumn("h", shingle_hashes(F.col("w"), size))
        for row in of_size.select("name", "w", "h", *[F.array_distinct(window_keys(F.col("h"), b, 1)).alias(f"k{b}") for b in range(BANDS)]).collect():
            own = sorted(set(row["h"]))
            keys = [(b, k) for b in range(BANDS) for k in row[f"k{b}"]] if len(row["h"]) >= LONG else [(-1, k) for k in own]
            out.append({"name": row["name"], "size": size, "words": row["w"], "set": own, "keys": keys, "reach": math.ceil(1.25 * len(row["h"])), "need": math.ceil(share * len(own))})
    return sorted(out, key=lambda t: t["name"])


def _among(values: set[int]) -> str:
    return f"IN ({', '.join(f'{v}L' for v in sorted(values))})"


def _scanned(docs: DataFrame, known: list[dict], id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, keys (size, band, key) of templates that the text has, and hits (size, place, shingle) if it has any key."""
    frame = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), word_hashes(F.col(f"`{text_col}`")).alias("w"))
    sizes = sorted({t["size"] for t in known})
    frame = frame.select("row", "doc_id", *[shingle_hashes(F.col("w"), size).alias(f"h{size}") for size in sizes])
    found, hits = [], []
    for size in sizes:
        for band in sorted({b for t in known if t["size"] == size for b, _ in t["keys"]}):
            keys = {k for t in known if t["size"] == size for b, k in t["keys"] if b == band}
            source = F.col(f"h{size}") if band < 0 else window_keys(F.col(f"h{size}"), band, WINDOW // 2)
            frame = frame.withColumn(f"k{size}_{band + 1}", F.array_distinct(source))
            found.append(F.expr(f"transform(filter(k{size}_{band + 1}, x -> x {_among(keys)}), x -> struct({size} AS size, {band} AS band, x AS key))"))
        shingles = {h for t in known if t["size"] == size for h in t["set"]}
        hits.append(F.expr(f"filter(transform(h{size}, (x, i) -> struct({size} AS size, i AS place, x AS shingle)), y -> y.shingle {_among(shingles)})"))
    none = F.array().cast("array<struct<size:int,place:int,shingle:bigint>>")
    frame = frame.withColumn("keys", F.concat(*found))
    return written(frame.select("row", "doc_id", "keys", F.when(F.size("keys") > 0, F.concat(*hits)).otherwise(none).alias("hits")), "licenses")


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the templates: bounded by their list."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def _hits(scanned: DataFrame, known: list[dict]) -> DataFrame:
    """row, template, place, shingle of the retrieved templates."""
    spark = scanned.sparkSession
    keys = _table(spark, [(t["size"], b, k, i) for i, t in enumerate(known) for b, k in t["keys"]], "size int, band int, key long, template int")
    own = _table(spark, [(t["size"], h, i) for i, t in enumerate(known) for h in t["set"]], "size int, shingle long, template int")
    some = scanned.where(F.size("keys") > 0)
    retrieved = some.select("row", F.explode("keys").alias("k")).select("row", "k.*").join(keys, ["size", "band", "key"]).select("row", "template").distinct()
    places = some.select("row", F.explode("hits").alias("x")).select("row", "x.*").join(own, ["size", "shingle"]).select("row", "template", "place", "shingle")
    return places.join(retrieved, ["row", "template"], "left_semi")


def _found(hits: DataFrame, known: list[dict]) -> DataFrame:
    """row, template, times (how often the text has enough of it) where a stretch of the text holds enough of the template."""
    needs = _table(hits.sparkSession, [(i, t["reach"], t["need"]) for i, t in enumerate(known)], "template int, reach int, need int")
    before = F.lag("place").over(Window.partitionBy("row", "template", "shingle").orderBy("place"))
    swept = hits.withColumn("before", before).join(needs, "template")
    first = F.greatest(F.coalesce(F.col("before") + 1, F.lit(0)), F.col("place") - F.col("reach") + 1, F.lit(0))
    steps = swept.select("row", "template", "need", F.explode(F.array(F.struct(first.alias("at"), F.lit(1).alias("more")), F.struct((F.col("place") + 1).alias("at"), F.lit(-1).alias("more")))).alias("x"))
    held = F.sum("x.more").over(Window.partitionBy("row", "template").orderBy("x.at"))
    found = steps.withColumn("held", held).groupBy("row", "template", "need").agg(F.max("held").alias("held")).where("held >= need")
    many = hits.groupBy("row", "template", "shingle").agg(F.count("*").alias("n")).groupBy("row", "template").agg(F.sort_array(F.collect_list("n"), asc=False).alias("n"))
    return found.join(many, ["row", "template"]).select("row", "template", F.element_at("n", F.col("need")).alias("times"))


def related(known: list[dict]) -> dict[tuple[int, int], tuple[set[int], set[int]]]:
    """For ordered pairs of templates that share half of the smaller one's shingles what the first has beyond the second, and the second beyond
    the first. A template of shorter shingles is related to one that has it as a passage, and has nothing beyond it."""
    out = {}
    for (x, a), (y, b) in permutations(enumerate(known), 2):
        own, other = set(a["set"]), set(b["set"])
        if a["size"] == b["size"] and 2 * len(own & other) >= min(len(own), len(other)):
            out[x, y] = (own - other, other - own)
        elif a["size"] < b["size"] and any(b["words"][i : i + len(a["words"])] == a["words"] for i in range(len(b["words"]))):
            out[x, y] = (set(), other)
    return out


def _specific(found: DataFrame, hits: DataFrame, known: list[dict]) -> DataFrame:
    """What no other found template explains."""
    spark, pairs = found.sparkSession, related(known)
    of_pairs = _table(spark, [(x, y, len(one), len(two)) for (x, y), (one, two) in pairs.items()], "x int, y int, x_more long, y_more long")
    # Shingles by the template that has them and the one that lacks them.
    beyond = {(x, y): one for (x, y), (one, _) in pairs.items()} | {(y, x): two for (x, y), (_, two) in pairs.items()}
    extra = _table(spark, [(x, y, h) for (x, y), some in beyond.items() for h in some], "x int, y int, shingle long")
    both = found.select("row", F.col("template").alias("x"), F.col("times").alias("x_times")).join(found.select("row", F.col("template").alias("y"), F.col("times").alias("y_times")), "row")
    both = both.join(of_pairs, ["x", "y"])
    # What the text has of a template beyond another, for pairs that it holds.
    had = hits.select("row", F.col("template").alias("x"), "shingle").distinct().join(extra, ["x", "shingle"]).groupBy("row", "x", "y").agg(F.count("*").alias("has"))
    judged = both.join(had.withColumnRenamed("has", "x_has"), ["row", "x", "y"], "left")
    judged = judged.join(had.select("row", F.col("x").alias("y"), F.col("y").alias("x"), F.col("has").alias("y_has")), ["row", "x", "y"], "left").fillna(0, ["x_has", "y_has"])
    lacking = (F.col("x_more") > 0) & (2 * F.col("x_has") < F.col("x_more"))
    inside = (F.col("x_more") == 0) & (F.col("x_times") <= F.col("y_times"))
    explained = judged.where((lacking | inside) & (2 * F.col("y_has") >= F.col("y_more"))).select("row", F.col("x").alias("template")).distinct()
    return found.join(explained, ["row", "template"], "left_anti")


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text", specific: bool = True) -> DataFrame:
    """Per document: licenses (names in order, joined by "; "), n_licenses. Without `specific` every contained template is named."""
    known = prepared(docs.sparkSession, templates or TEMPLATES, share)
    scanned = _scanned(docs, known, id_col, text_col)
    hits = written(_hits(scanned, known), "hits")
    found = _found(hits, known)
    if specific:
        found = _specific(written(found, "found"), hits, known)
    names = _table(docs.sparkSession, [(i, t["name"]) for i, t in enumerate(known)], "template int, name string")
    listed = found.join(names, "template").groupBy("row").agg(F.array_sort(F.collect_set("name")).alias("l"))
    result = scanned.select("row", "doc_id").join(listed, "row", "left").withColumn("l", F.coalesce("l", F.array().cast("array<string>")))
    return result.select("doc_id", F.array_join("l", "; ").alias("licenses"), F.size("l").cast("long").alias("n_licenses"))
