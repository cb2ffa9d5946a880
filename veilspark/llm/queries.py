"""One query per operator, over whole tables, with the SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


@query("op8_compression_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.compression_rules import judge_quality

    return judge_quality(read(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (
  SELECT doc_id, p, list_aggregate(w[p:p + 34], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)
),
hits AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY s) AS n FROM starts) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM hits),
flat AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT f.doc_id, count(g.p) AS n_removed, string_agg(f.x, ' ' ORDER BY f.p) FILTER (WHERE g.p IS NULL) AS t
  FROM flat f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.p = g.p GROUP BY f.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""


@query("op1_substring_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.substring_dedup import digest, remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", digest("text").alias("kept_sha256"))


@query("op9_sentencepiece")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.pieces import encode_digests

    return encode_digests(read(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH counted AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sizes AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS number FROM counted),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sizes GROUP BY source
),
sorted AS (SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM sources),
levels AS (
  SELECT k, weight, cap, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level
  FROM sorted WINDOW p AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
chosen AS (SELECT level FROM levels WHERE weight * level <= cap ORDER BY k LIMIT 1),
targets AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM chosen)) AS target FROM sorted),
drawn AS (
  SELECT *, length(size::VARCHAR) * 100 + rpad(substr(size::VARCHAR, 1, 2), 2, '0')::INT AS kind,
    ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '~') || '|' || size || '|' || number), 1, 15))::BIGINT AS u FROM sizes
),
parted AS (SELECT *, u % CAST(ceil(count(*) OVER (PARTITION BY source, kind) / 16384.0) AS BIGINT) AS part FROM drawn),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY kind, part, u, doc_id, size, number) - 1 AS pos FROM parted),
rated AS (
  SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix-start|' || coalesce(p.source, '~')), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS start
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + floor((rate - floor(rate)) * (pos + 1) + start) - floor((rate - floor(rate)) * pos + start)) AS BIGINT) AS taken
FROM rated
"""


@query("op2_mix_sources", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.mixing import mix_sources

    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from veilspark.llm.language_id import held_out, identify, learn_languages

    docs = read(spark, sf_dir, "documents")
    model = learn_languages(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from veilspark.llm.language_id import held_out
    from veilspark.llm.quality_classifier import learn_quality, score_quality

    docs = read(spark, sf_dir, "documents")
    weights = learn_quality(docs.where(~held_out(F.col("doc_id"))), read(spark, sf_dir, "labels"))
    return score_quality(docs, weights).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op10_nearest_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from veilspark.llm.collision_search import nearest_neighbours

    return nearest_neighbours(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda p: w[p] || ' ' || w[p + 1] || ' ' || w[p + 2]) END) AS s FROM d
),
flat AS (SELECT doc_id, unnest(s) AS g FROM sets),
overlap AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM overlap JOIN sets p ON x = p.doc_id JOIN sets q ON y = q.doc_id WHERE 100 * n >= 85 * (len(p.s) + len(q.s) - n)
),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(doc_id, seen) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, b.y FROM reached r JOIN both_ways b ON r.seen = b.x),
smallest AS (SELECT doc_id, min(seen) AS component_id FROM reached GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept FROM sets s JOIN smallest m USING (doc_id)
"""


@query("op7_near_dedup", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.near_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), size=3, percent=85)


@query("op3_pii_surrogates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.surrogates import replace_entities

    return replace_entities(read(spark, sf_dir, "documents"))


def _op5_sql() -> str:
    from veilspark.llm.license_texts import TEMPLATES

    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''").replace("\n", " ")) for name, text in sorted(TEMPLATES.items()))
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
    runs = "list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda p: array_to_string(w[p:p + k - 1], ' '))"
    return f"""
WITH t AS (SELECT name, w, CASE WHEN len(w) >= 5 THEN 5 ELSE least(3, len(w)) END AS k FROM (SELECT name, {words} AS w FROM (VALUES {values}) v(name, text))),
ts AS (SELECT name, k, w, {runs} AS s FROM t),
tt AS (SELECT name, k, w, list_distinct(s) AS own, CAST(ceil(1.25 * len(s)) AS BIGINT) AS reach, CAST(ceil(0.8 * len(list_distinct(s))) AS BIGINT) AS need FROM ts),
docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
d AS (SELECT row, {words} AS w FROM docs),
ds AS (SELECT row, k, {runs} AS s FROM d, (SELECT DISTINCT k FROM t) sizes),
flat AS (SELECT row, k, p, s[p] AS g FROM (SELECT row, k, s, unnest(range(1, len(s) + 1)) AS p FROM ds)),
hits AS (SELECT f.row, tt.name, tt.reach, tt.need, f.p, f.g FROM flat f JOIN (SELECT name, k, reach, need, unnest(own) AS g FROM tt) tt ON f.k = tt.k AND f.g = tt.g),
held AS (
  SELECT DISTINCT row, name FROM (
    SELECT a.row, a.name FROM hits a JOIN hits b ON a.row = b.row AND a.name = b.name AND b.p >= a.p AND b.p < a.p + a.reach
    GROUP BY a.row, a.name, a.p, a.need HAVING count(DISTINCT b.g) >= a.need)
),
many AS (SELECT row, name, list_reverse_sort(list(n))[any_value(need)] AS times FROM (SELECT row, name, need, g, count(*) AS n FROM hits GROUP BY ALL) GROUP BY row, name),
found AS (SELECT row, name, times FROM held JOIN many USING (row, name)),
pairs AS (
  SELECT a.name AS x, b.name AS y, list_filter(a.own, lambda g: NOT list_contains(b.own, g)) AS x_more, list_filter(b.own, lambda g: NOT list_contains(a.own, g)) AS y_more
  FROM tt a JOIN tt b ON a.name <> b.name AND a.k = b.k AND 2 * len(list_intersect(a.own, b.own)) >= least(len(a.own), len(b.own))
  UNION ALL
  SELECT a.name, b.name, [], b.own FROM tt a JOIN tt b ON a.k < b.k AND contains(' ' || array_to_string(b.w, ' ') || ' ', ' ' || array_to_string(a.w, ' ') || ' ')
),
had AS (SELECT row, name, list(DISTINCT g) AS has FROM hits GROUP BY row, name),
judged AS (
  SELECT f.row, f.name, len(p.x_more) AS x_more, len(p.y_more) AS y_more, f.times AS x_times, g.times AS y_times,
    len(list_intersect(p.x_more, hx.has)) AS x_has, len(list_intersect(p.y_more, hy.has)) AS y_has
  FROM found f JOIN pairs p ON f.name = p.x JOIN found g ON f.row = g.row AND g.name = p.y
    JOIN had hx ON f.row = hx.row AND f.name = hx.name JOIN had hy ON g.row = hy.row AND g.name = hy.name
),
explained AS (
  SELECT DISTINCT row, name FROM judged WHERE 2 * y_has >= y_more AND ((x_more > 0 AND 2 * x_has < x_more) OR (x_more = 0 AND x_times <= y_times))
),
named AS (SELECT row, string_agg(name, '; ' ORDER BY name) AS licenses, count(*) AS n FROM (SELECT * FROM found ANTI JOIN explained USING (row, name)) GROUP BY row)
SELECT d.doc_id, coalesce(n.licenses, '') AS licenses, coalesce(n.n, 0) AS n_licenses FROM docs d LEFT JOIN named n USING (row)
"""


@query("op5_license_scan", _op5_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.license_scan import scan_licenses

    return scan_licenses(read(spark, sf_dir, "documents"))


# CRC-32 of UTF-8 text, byte by byte from the hexadecimal form; its table follows from the polynomial.
OP11_SQL = r"""
WITH steps AS (
  SELECT list_transform(range(0, 256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
texts AS (
  SELECT 'd' AS side, row_number() OVER () AS id, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
),
worded AS (
  SELECT side, id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
),
flat AS (
  SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda p: w[p] || ' ' || w[p + 1]))) AS g FROM worded
),
hashed AS (
  SELECT g, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(h) // 2 + 1), lambda p: ('0x' || h[2 * p - 1:2 * p])::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS k
  FROM (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM flat)), steps
),
counted AS (SELECT k, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM flat JOIN hashed USING (g) GROUP BY k),
gained AS (
  SELECT k, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE) / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM counted
),
weights AS (
  SELECT id, count(*) AS n, CAST((sum(gain) - ((sum(gain) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS weight
  FROM flat JOIN hashed USING (g) JOIN gained USING (k) WHERE side = 'd' GROUP BY id
),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM worded LEFT JOIN weights USING (id) WHERE side = 'd'
),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id, n_features, weight) AS r, count(*) FILTER (WHERE n_words >= 20) OVER () AS many FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, CAST(score AS BIGINT) AS score, CASE WHEN n_words >= 20 AND r <= 25 * many // 100 THEN r END AS rank FROM placed
"""


@query("op11_importance_resampling", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.importance import resample

    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, w[p] AS w1, w[p + 1] AS w2, w[p + 2] AS w3 FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS p FROM worded)
),
f1 AS (SELECT lang, w1 AS x, count(*) AS f FROM grams GROUP BY ALL),
f2 AS (SELECT lang, w1 AS x, w2 AS y, count(*) AS f FROM grams WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1 AS x, w2 AS y, w3 AS z, count(*) AS f FROM grams WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
inside AS (SELECT lang, x, y, max(f) AS longer FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL),
two AS (
  SELECT p.lang, p.x || ' ' || p.y AS phrase, p.f AS a, l.f AS l, r.f AS r, CAST(1000000::HUGEINT * p.f * p.f // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM f2 p JOIN f1 l ON p.lang = l.lang AND p.x = l.x JOIN f1 r ON p.lang = r.lang AND p.y = r.x
    LEFT JOIN inside i ON p.lang = i.lang AND p.x = i.x AND p.y = i.y
  WHERE p.f >= 10 AND (i.longer IS NULL OR 100 * i.longer < 50 * p.f)
),
cuts AS (
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z AS phrase, t.f AS a, l1.f AS l1, r1.f AS r1, l2.f AS l2, r2.f AS r2,
    1000000::HUGEINT * t.f * t.f // (l1.f::HUGEINT * r1.f) AS s1, 1000000::HUGEINT * t.f * t.f // (l2.f::HUGEINT * r2.f) AS s2
  FROM f3 t JOIN f1 l1 ON t.lang = l1.lang AND t.x = l1.x JOIN f2 r1 ON t.lang = r1.lang AND t.y = r1.x AND t.z = r1.y
    JOIN f2 l2 ON t.lang = l2.lang AND t.x = l2.x AND t.y = l2.y JOIN f1 r2 ON t.lang = r2.lang AND t.z = r2.x
),
three AS (
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END AS l, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END AS r, CAST(least(s1, s2) AS BIGINT) AS score FROM cuts
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM (SELECT * FROM two UNION ALL SELECT * FROM three)
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM placed JOIN (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang) USING (lang) WHERE rank <= 2000
"""


@query("op13_phrase_collocations", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.collocations import mine_phrases

    return mine_phrases(read(spark, sf_dir, "documents"))


@query("op12_toxicity_neighbours")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from veilspark.llm.toxicity import held_out, learn_toxicity, score_toxicity

    docs = read(spark, sf_dir, "documents")
    model = learn_toxicity(docs, docs.where(~held_out(F.col("doc_id"))), read(spark, sf_dir, "labels"))
    nearest = F.get("neighbours", F.lit(0))
    found = score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", nearest.alias("near"), "terms")
    return found.select("doc_id", "held_out", "score", "predicted", F.col("near.doc_id").alias("nearest_id"), F.col("near.cosine").alias("nearest_cosine"), F.array_join("terms", " ").alias("evidence"))
