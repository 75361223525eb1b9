"""All queries by name over the test tables, and the DuckDB SQL that each must equal.

The test tables stand in for the index: orders and customers for files, nations for places, events
for capture times, embeddings for faces, documents for contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import EXTENSIONS, Naming
from tidemark.functions import dates, geometry, scores, text
from tidemark.operators import classify, events, graphs, grouping, nearest, sessions, trips
from tidemark.plans import plan, where
from tidemark.sources import tables

FLAGSHIP = "plan_city"
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iso(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


ISO = "%Y-%m-%d %H:%M:%S.%f"


# --- duplicates -------------------------------------------------------------------------


def _hashed(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.col("n_chars"))


def _marked(spark, d) -> DataFrame:
    return grouping.mark_duplicates(_hashed(spark, d), "hash", "doc_id", [(-F.col("n_chars")).alias("a")])


_DUPS = "WITH h AS (SELECT doc_id, sha256(text) AS hash, first_value(doc_id) OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) AS best FROM documents), m AS (SELECT doc_id, hash, CASE WHEN best <> doc_id THEN best END AS dup_of FROM h) "


@query(_DUPS + "SELECT * FROM m")
def exact_dups(spark, d):
    return _marked(spark, d).select("doc_id", "hash", "dup_of")


@query(_DUPS + "SELECT m.doc_id, m.dup_of, c.n_chars AS canonical_chars FROM m JOIN documents c ON c.doc_id = m.dup_of")
def dup_listing(spark, d):
    m = _marked(spark, d)
    c = m.select(F.col("doc_id").alias("dup_of"), F.col("n_chars").alias("canonical_chars"))
    return m.select("doc_id", "dup_of").join(c, "dup_of").select("doc_id", "dup_of", "canonical_chars")


@query(_DUPS + "SELECT count(*) FILTER (dup_of IS NOT NULL) AS surplus, count(DISTINCT dup_of) AS dup_groups FROM m")
def dup_stats(spark, d):
    return _marked(spark, d).agg(F.count("dup_of").alias("surplus"), F.count_distinct("dup_of").alias("dup_groups"))


def _signatures(spark, d) -> DataFrame:
    """64-bit simhash of each canonical text: the sign of the sum of its words' hash bits."""
    docs = table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("n_chars").alias("n_chars"))
    words = docs.select("doc_id", "n_chars", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("w")).where("w <> ''")
    half = lambda k: F.conv(F.substring(F.md5("w"), 1 + 8 * k, 8), 16, 10).cast("long")
    h = words.select("doc_id", "n_chars", F.shiftleft(half(0), 32).bitwiseOR(half(1)).alias("h"))
    # Two counters to a sum: bit k of either half, 32 bits apart. A document has fewer than 2^31 words.
    two = lambda k: F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(0x100000001))).alias(f"s{k}")
    sums = h.groupBy("doc_id", "n_chars").agg(F.count("*").alias("n"), *[two(k) for k in range(32)])
    held = [F.shiftright(f"s{31 - i}", 32) for i in range(32)] + [F.col(f"s{31 - i}").bitwiseAND(F.lit(0xFFFFFFFF)) for i in range(32)]
    bits = F.concat(*[F.when(2 * c >= F.col("n"), "1").otherwise("0") for c in held])
    hexa = F.concat(*[F.lpad(F.lower(F.conv(F.substring(bits, 1 + 32 * k, 32), 2, 16)), 8, "0") for k in (0, 1)])
    return sums.select("doc_id", "n_chars", hexa.alias("phash"), F.concat(F.lit("p"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"))


_SIG = """WITH RECURSIVE c AS (SELECT min(doc_id) AS doc_id, max(n_chars) AS n_chars, text FROM documents GROUP BY text),
w AS (SELECT DISTINCT doc_id, n_chars, w FROM (SELECT doc_id, n_chars, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM c) WHERE w <> ''),
h AS (SELECT doc_id, n_chars, ('0x' || substr(md5(w), 1, 16))::UBIGINT AS h FROM w),
b AS (SELECT doc_id, n_chars, i, sum(CASE WHEN (h >> (63 - i)::UBIGINT) & 1::UBIGINT = 1 THEN 1 ELSE -1 END) AS s FROM h, (SELECT unnest(range(0, 64)) AS i) GROUP BY ALL),
g AS (SELECT doc_id, n_chars, string_agg(CASE WHEN s >= 0 THEN '1' ELSE '0' END, '' ORDER BY i) AS bits FROM b GROUP BY ALL),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, hamming(x.bits, y.bits) AS distance FROM g x JOIN g y ON x.doc_id < y.doc_id WHERE hamming(x.bits, y.bits) <= 5)"""
_CC = _SIG + """,
e AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p),
r(u, v) AS (SELECT u, u FROM e UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
k AS (SELECT u AS id, min(v) AS component FROM r GROUP BY u),
o AS (SELECT k.id, dense_rank() OVER (ORDER BY component) AS group_no, row_number() OVER (PARTITION BY component ORDER BY n_chars DESC, id) AS place FROM k JOIN g ON g.doc_id = k.id)"""


@query(_SIG + " SELECT a, b, CAST(distance AS INTEGER) AS distance FROM p")
def near_dup_pairs(spark, d):
    return graphs.near_pairs(_signatures(spark, d), "doc_id", "phash", 5)


@query(_CC + " SELECT CAST(group_no AS INTEGER) AS group_no, CAST(place AS INTEGER) AS place, id FROM o")
def near_dup_groups(spark, d):
    return graphs.near_groups(_signatures(spark, d), "doc_id", "phash", "path", "n_chars", 5)


@query(_CC + " SELECT CAST(group_no AS INTEGER) AS group_no, id AS best_id FROM o WHERE place = 1")
def best_of_group(spark, d):
    s = _signatures(spark, d)
    g = graphs.near_groups(s, "doc_id", "phash", "path", "n_chars", 5).join(s.select(F.col("doc_id").alias("id"), "n_chars"), "id")
    order = grouping.quality_order(F.lit(None).cast("int"), F.lit(None).cast("int"), F.col("n_chars"), F.col("id"))
    return grouping.best_per_group(g, ["group_no"], order).select("group_no", F.col("id").alias("best_id"))


# --- sessions, trips, events ------------------------------------------------------------

_GAP_SQL = "CASE WHEN ts - lag(ts) OVER (%s ORDER BY ts, event_id) > INTERVAL '%s' THEN 1 WHEN lag(ts) OVER (%s ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END"
_USER = "PARTITION BY user_id"
_SESSIONS = f"WITH f AS (SELECT *, {_GAP_SQL % (_USER, '6 hours', _USER)} AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM f) "
_GLOBAL = f"WITH f AS (SELECT *, {_GAP_SQL % ('', '15 minutes', '')} AS new FROM events), s AS (SELECT *, sum(new) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM f) "


def _user_sessions(spark, d) -> DataFrame:
    return sessions.by_key(table(spark, d, "events"), "ts", ["user_id"], ["event_id"], 6 * 3600)


@query(_SESSIONS + f"SELECT user_id, CAST(session AS BIGINT) AS session, strftime(min(ts), '{ISO}') AS started_at, strftime(max(ts), '{ISO}') AS ended_at, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 5")
def sessions_user(spark, d):
    s = sessions.summary(_user_sessions(spark, d), ["user_id", "session"], "ts", 5)
    return s.select("user_id", F.col("session").cast("long").alias("session"), iso("started_at").alias("started_at"), iso("ended_at").alias("ended_at"), "n")


@query(_GLOBAL + f"SELECT CAST(session AS BIGINT) AS session, strftime(min(ts), '{ISO}') AS started_at, strftime(max(ts), '{ISO}') AS ended_at, count(*) AS n FROM s GROUP BY ALL")
def sessions_global(spark, d):
    s = sessions.overall(table(spark, d, "events"), "ts", ["event_id"], 15 * 60)
    return sessions.summary(s, ["session"], "ts").select("session", iso("started_at").alias("started_at"), iso("ended_at").alias("ended_at"), "n")


@query(_SESSIONS + """, x AS (SELECT t.event_id, q.event_id AS source_id, q.value, row_number() OVER (PARTITION BY t.event_id ORDER BY abs(epoch_us(t.ts) - epoch_us(q.ts)), q.ts, q.event_id) AS r
FROM s t JOIN s q ON q.user_id = t.user_id AND q.session = t.session AND q.event_type = 'purchase' WHERE t.event_type <> 'purchase')
SELECT event_id, source_id, value AS inherited_value FROM x WHERE r = 1""")
def inherit_nearest(spark, d):
    s = _user_sessions(spark, d).withColumn("source_id", F.col("event_id"))
    got = sessions.inherit_nearest(s, ["user_id", "session"], "ts", "event_id", F.col("event_type") == "purchase", F.lit(True), ["source_id", "value"])
    return got.where(F.col("inherited").isNotNull()).select("event_id", F.col("inherited.source_id").alias("source_id"), F.col("inherited.value").alias("inherited_value"))


def _localities(s: DataFrame) -> DataFrame:
    dom = grouping.dominant(s, ["session"], "event_type", ["ts", "event_id"], "locality").select("session", "locality")
    return sessions.summary(s, ["session"], "ts").join(dom, "session")


@query(_GLOBAL.replace("WITH f", "WITH RECURSIVE f") + f""", c AS (SELECT session, event_type, count(*) AS k, min(ts) AS t0, min(event_id) AS e0 FROM s GROUP BY ALL),
l AS (SELECT session, event_type AS locality FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY k DESC, t0, e0) AS r FROM c) WHERE r = 1),
a AS (SELECT session, min(ts) AS lo, max(ts) AS hi, locality FROM s JOIN l USING (session) GROUP BY session, locality),
m(session, hi, anchor, trip) AS (SELECT session, hi, locality, 1 FROM a WHERE session = 1
  UNION ALL SELECT a.session, CASE WHEN a.lo - m.hi < INTERVAL '25 minutes' AND a.locality = m.anchor THEN greatest(m.hi, a.hi) ELSE a.hi END,
    CASE WHEN a.lo - m.hi < INTERVAL '25 minutes' AND a.locality = m.anchor THEN m.anchor ELSE a.locality END,
    CASE WHEN a.lo - m.hi < INTERVAL '25 minutes' AND a.locality = m.anchor THEN m.trip ELSE m.trip + 1 END FROM m JOIN a ON a.session = m.session + 1)
SELECT trip, count(*) AS n_sessions, strftime(min(lo), '{ISO}') AS started_at, strftime(max(a.hi), '{ISO}') AS ended_at, any_value(anchor) AS locality FROM m JOIN a USING (session) GROUP BY trip""")
def trip_merge(spark, d):
    s = _localities(sessions.overall(table(spark, d, "events"), "ts", ["event_id"], 15 * 60)).withColumn("all", F.lit(0))
    t = trips.merge(s, ["all"], 25 * 60, ["locality"], lambda a, b: a["locality"] == b["locality"])
    return t.groupBy("trip").agg(F.count("*").alias("n_sessions"), iso(F.min("started_at")).alias("started_at"), iso(F.max("ended_at")).alias("ended_at"), F.min_by("locality", "session").alias("locality"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(ts) AS t0, min(event_id) AS e0 FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, t0, e0) AS k, count(*) OVER (PARTITION BY user_id) AS n_values FROM c)
SELECT user_id, event_type AS dominant, n AS n_dominant, n_values FROM r WHERE k = 1""")
def dominant_type(spark, d):
    return grouping.dominant(table(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"])


_RANGES = [(1, "2024-01-02", "2024-01-03"), (2, "2024-01-03 12:00:00", "2024-01-05"), (3, "2024-01-10", "2024-01-10"), (4, "2024-01-04", "2024-01-04")]


def _ranges(spark) -> DataFrame:
    return spark.createDataFrame([(k, *events.bounds(a, b)) for k, a, b in _RANGES], "range_id int, lo timestamp_ntz, hi timestamp_ntz")


_RANGES_SQL = "WITH g(range_id, lo, hi) AS (VALUES " + ", ".join(f"({k}, TIMESTAMP '{events.bounds(a, b)[0]}', TIMESTAMP '{events.bounds(a, b)[1]}')" for k, a, b in _RANGES) + ") "


@query(_RANGES_SQL + "SELECT range_id, count(*) AS n, min(event_id) AS first_id FROM events JOIN g ON ts BETWEEN lo AND hi GROUP BY range_id")
def manual_range(spark, d):
    return events.in_ranges(table(spark, d, "events"), "ts", _ranges(spark)).groupBy("range_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(_RANGES_SQL + "SELECT DISTINCT y.range_id AS overlapped FROM g x JOIN g y ON (x.lo, x.range_id) < (y.lo, y.range_id) AND x.hi >= y.lo")
def overlap_check(spark, d):
    return events.overlapping(_ranges(spark)).select(F.col("b").alias("overlapped"))


@query(f"""WITH f AS (SELECT *, {_GAP_SQL % (_USER, '6 hours', _USER)} AS n6, {_GAP_SQL % (_USER, '4 hours', _USER)} AS n4 FROM events),
s AS (SELECT event_id, user_id || ':' || CAST(sum(n6) OVER w AS VARCHAR) AS old_group, user_id || ':' || CAST(sum(n4) OVER w AS VARCHAR) AS new_group FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
o AS (SELECT new_group, old_group, count(*) AS overlap FROM s GROUP BY ALL), z AS (SELECT old_group, count(*) AS size FROM s GROUP BY ALL),
r AS (SELECT new_group, old_group, overlap, row_number() OVER (PARTITION BY new_group ORDER BY overlap DESC, old_group) AS k FROM o JOIN z USING (old_group) WHERE overlap > 0.5 * size)
SELECT new_group, old_group, overlap FROM r WHERE k = 1""")
def name_carryover(spark, d):
    e = table(spark, d, "events")
    group = lambda h, name: sessions.by_key(e, "ts", ["user_id"], ["event_id"], h * 3600).select("event_id", F.concat_ws(":", "user_id", "session").alias(name))
    return grouping.carry_over(group(6, "old_group"), group(4, "new_group"), "event_id", "old")


@query(f"""SELECT user_id, CASE WHEN CAST(min(ts) AS DATE) = CAST(max(ts) AS DATE) THEN strftime(min(ts), '%Y-%m-%d')
WHEN year(min(ts)) = year(max(ts)) THEN strftime(min(ts), '%Y-%m-%d') || '..' || strftime(max(ts), '%m-%d')
ELSE strftime(min(ts), '%Y-%m-%d') || '..' || strftime(max(ts), '%Y-%m-%d') END || ' user ' || user_id AS name FROM events GROUP BY user_id""")
def event_name(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return e.select("user_id", dates.span_name(F.col("a"), F.col("b"), F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("name"))


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY k) FILTER (k <= 8) AS samples FROM r GROUP BY user_id""")
def event_cards(spark, d):
    e = table(spark, d, "events")
    top = grouping.best_per_group(e, ["user_id"], [F.asc("ts"), F.asc("event_id")], 8)
    s = top.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("samples"))
    return e.groupBy("user_id").agg(F.count("*").alias("n")).join(s, "user_id")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations) WHERE k <= 2")
def topk_samples(spark, d):
    return grouping.best_per_group(table(spark, d, "conversations"), ["conv_id"], [F.asc("turn"), F.asc("role"), F.asc("text")], 2).select("conv_id", "turn", "role")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id FROM r WHERE n <= 5 OR i IN (0, CAST(round_even((n - 1) / 4.0, 0) AS BIGINT), CAST(round_even(2 * (n - 1) / 4.0, 0) AS BIGINT), CAST(round_even(3 * (n - 1) / 4.0, 0) AS BIGINT), n - 1)""")
def even_samples(spark, d):
    return grouping.even_samples(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id")


# --- clusters ---------------------------------------------------------------------------


def _clusters(spark, d) -> DataFrame:
    k = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("id")).distinct()
    return k.select("id", F.concat(F.lit("person "), F.col("id").cast("string")).alias("label"), F.when(F.col("id") % 3 != 0, F.col("id") - 1).alias("merged_into"))


_CLUSTERS = "WITH RECURSIVE c AS (SELECT DISTINCT CAST(label AS BIGINT) AS id, CASE WHEN label % 3 <> 0 THEN CAST(label - 1 AS BIGINT) END AS merged_into FROM embeddings), r(id, root) AS (SELECT id, id FROM c WHERE merged_into IS NULL UNION ALL SELECT c.id, r.root FROM c JOIN r ON c.merged_into = r.id) "


@query(_CLUSTERS + "SELECT id, root FROM r")
def cluster_roots(spark, d):
    return graphs.roots(_clusters(spark, d))


@query(_CLUSTERS + """, f AS (SELECT root, vec_id, row_number() OVER (PARTITION BY root ORDER BY vec_id) AS k FROM embeddings e JOIN r ON r.id = e.label)
SELECT root, 'person ' || root AS label, count(*) AS size, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY k) FILTER (k <= 6) AS samples FROM f GROUP BY root""")
def cluster_cards(spark, d):
    c = _clusters(spark, d)
    faces = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("id")).join(graphs.roots(c), "id")
    top = grouping.best_per_group(faces, ["root"], [F.asc("vec_id")], 6).groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list("vec_id")), lambda x: x.cast("string")), ",").alias("samples"))
    n = faces.groupBy("root").agg(F.count("*").alias("size"))
    return n.join(top, "root").join(c.select(F.col("id").alias("root"), "label"), "root").select("root", "label", "size", "samples")


# --- vectors and scores -----------------------------------------------------------------

_DOT = "list_sum([CAST(e.embedding[i] AS DOUBLE) * p.v[i] FOR i IN range(1, len(p.v) + 1)])"


def _prompts(spark, d) -> DataFrame:
    """A prompt per label: its vector of least id."""
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("k")).agg(F.min_by("embedding", "vec_id").alias("v"))


@query(f"""WITH p AS (SELECT label AS k, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label),
x AS (SELECT e.vec_id, p.k, {_DOT} AS s FROM embeddings e, p), m AS (SELECT vec_id, max(s) AS top FROM x GROUP BY vec_id),
z AS (SELECT vec_id, sum(exp(10 * (s - top))) AS total FROM x JOIN m USING (vec_id) GROUP BY vec_id),
r AS (SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, k) AS n, exp(10 * (s - top)) / total AS prob FROM x JOIN m USING (vec_id) JOIN z USING (vec_id))
SELECT vec_id, k AS best, round(prob, 6) AS prob FROM r WHERE n = 1""")
def softmax_argmax(spark, d):
    if _prompts(spark, d).limit(10_001).count() > 10_000:
        raise ValueError("more than 10000 prompts: score them in parts")
    p = _prompts(spark, d).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("p"))  # one row per label
    e = table(spark, d, "embeddings").crossJoin(F.broadcast(p))
    e = e.withColumn("logits", F.transform("p", lambda q: scores.dot(F.col("embedding"), q["v"]))).withColumn("probs", scores.softmax(F.col("logits"), 10.0))
    return e.select("vec_id", F.get(F.col("p"), scores.argmax(F.col("logits")))["k"].alias("best"), F.round(F.array_max("probs"), 6).alias("prob"))


@query("WITH n AS (SELECT vec_id, embedding, sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding])) AS norm FROM embeddings) SELECT vec_id, round(embedding[1] / CASE WHEN norm = 0 THEN 1 ELSE norm END, 6) AS x0, round(norm, 5) AS norm FROM n")
def l2_normalized(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(F.get(scores.l2_normalize(F.col("embedding")), F.lit(0)), 6).alias("x0"), F.round(F.sqrt(scores.dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"))


def _scored(spark, d) -> DataFrame:
    """Files with provider scores from arithmetic on ids; every branch of the cascade is met."""
    i = F.col("doc_id")
    share = lambda m, n: (F.pmod(i * m, F.lit(n)) / F.lit(float(n)))
    name = F.when(i % 17 == 0, F.concat(F.lit("Screenshot_"), i.cast("string"), F.lit(".png"))).otherwise(F.concat(F.lit("img_"), i.cast("string"), F.lit(".jpg")))
    return table(spark, d, "documents").select(
        i.alias("id"),
        F.concat(F.when(i % 13 == 0, "/a/Screenshots/").otherwise("/a/b/"), name).alias("path"),
        F.when(i % 7 == 0, "Canon").otherwise("").alias("camera_make"),
        F.lit(None).cast("string").alias("camera_model"),
        F.when(i % 11 == 0, 1.5).alias("gps_lat"),
        (i % 5 == 0).alias("has_faces"),
        F.array(share(3, 10), share(7, 10), share(9, 10)).alias("probs"),
        F.array(*[F.lit(0.0)] * 5, share(1, 20), share(3, 20), share(7, 20), share(9, 20)).alias("doc_probs"),
        F.array(F.lit(0.0), F.lit(0.0), share(1, 8), share(3, 8), share(5, 8)).alias("prod_probs"),
        F.when(i % 3 != 0, share(1, 9)).alias("text_frac"),
        F.when(i % 4 == 0, "product").alias("vlm_label"),
    )


_N = Naming()


@query(f"""WITH b AS (SELECT doc_id AS id, doc_id % 17 = 0 AS named, doc_id % 13 = 0 AS shots, doc_id % 7 = 0 AS cam, doc_id % 11 = 0 AS gps, doc_id % 5 = 0 AS faces,
[doc_id * 3 % 10 / 10.0, doc_id * 7 % 10 / 10.0, doc_id * 9 % 10 / 10.0] AS probs,
greatest(doc_id % 20, doc_id * 3 % 20, doc_id * 7 % 20, doc_id * 9 % 20) / 20.0 AS doc, greatest(doc_id % 8, doc_id * 3 % 8, doc_id * 5 % 8) / 8.0 AS prod,
CASE WHEN doc_id % 3 <> 0 THEN doc_id % 9 / 9.0 END AS frac, CASE WHEN doc_id % 4 = 0 THEN 'product' END AS vlm FROM documents),
t1 AS (SELECT *, CASE WHEN named AND NOT cam THEN 'screenshot' WHEN NOT faces AND doc >= {_N.document_threshold} THEN 'document' WHEN cam OR gps OR faces THEN 'photo'
WHEN list_max(probs) >= {_N.junk_threshold} THEN ['photo', 'screenshot', 'meme'][list_position(probs, list_max(probs))] ELSE 'photo' END AS v1, CASE WHEN named AND NOT cam THEN 'heuristic' ELSE 'clip' END AS s1 FROM b),
t2 AS (SELECT *, NOT faces AND frac IS NOT NULL AND v1 = 'document' AND frac < {_N.text_frac_min} AS toph,
NOT faces AND frac IS NOT NULL AND v1 = 'photo' AND doc >= {_N.text_rescue_docscore_min} AND frac >= {_N.text_frac_document} AS todoc FROM t1),
t3 AS (SELECT *, CASE WHEN toph THEN 'photo' WHEN todoc THEN 'document' ELSE v1 END AS v2, CASE WHEN toph OR todoc THEN 'ocr' ELSE s1 END AS s2 FROM t2),
t4 AS (SELECT *, CASE WHEN v2 = 'photo' AND shots THEN 'screenshot' ELSE v2 END AS v3, CASE WHEN v2 = 'photo' AND shots THEN 'heuristic' ELSE s2 END AS s3 FROM t3),
t5 AS (SELECT *, NOT faces AND v3 NOT IN ('screenshot', 'meme') AND (v3 = 'document' OR doc >= {_N.text_rescue_docscore_min} OR prod >= {_N.product_candidate_min}) AS candidate FROM t4)
SELECT id, CASE WHEN candidate AND vlm IS NOT NULL THEN vlm ELSE v3 END AS verdict, CASE WHEN candidate AND vlm IS NOT NULL THEN 'vlm' ELSE s3 END AS source, candidate FROM t5""")
def tier_cascade(spark, d):
    return classify.classify(_scored(spark, d)).select("id", "verdict", "source", "candidate")


# --- geometry ---------------------------------------------------------------------------

_LATLON = "(x * 37 % 17000) / 100.0 - 85 AS lat, (x * 91 % 36000) / 100.0 - 180 AS lon"


def _latlon(df: DataFrame, key: str) -> DataFrame:
    x = F.col(key)
    return df.select(x, (F.pmod(x * 37, F.lit(17000)) / 100.0 - 85).alias("lat"), (F.pmod(x * 91, F.lit(36000)) / 100.0 - 180).alias("lon"))


@query(f"WITH c AS (SELECT c_custkey AS x, {_LATLON} FROM (SELECT c_custkey, c_custkey AS x FROM customer)) SELECT x AS c_custkey, round(2 * 6371.0088 * asin(sqrt(least(1.0, power(sin((radians(48.85) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(48.85)) * power(sin(radians(2.35 - lon) / 2), 2)))), 4) AS km FROM c")
def haversine(spark, d):
    c = _latlon(table(spark, d, "customer"), "c_custkey")
    return c.select("c_custkey", F.round(geometry.haversine_km(F.col("lat"), F.col("lon"), F.lit(48.85), F.lit(2.35)), 4).alias("km"))


@query(f"""WITH p AS (SELECT s_suppkey AS geonameid, {_LATLON} FROM (SELECT s_suppkey, s_suppkey * 7919 AS x FROM supplier)), c AS (SELECT c_custkey, {_LATLON} FROM (SELECT c_custkey, c_custkey AS x FROM customer)),
r AS (SELECT c_custkey, geonameid, row_number() OVER (PARTITION BY c_custkey ORDER BY sin(radians(c.lat)) * sin(radians(p.lat)) + cos(radians(c.lat)) * cos(radians(p.lat)) * cos(radians(c.lon - p.lon)) DESC, geonameid) AS k FROM c, p)
SELECT c_custkey, geonameid AS place_id FROM r WHERE k = 1""")
def nearest_place(spark, d):
    s = table(spark, d, "supplier").select((F.col("s_suppkey") * 7919).alias("x"), "s_suppkey")
    p = _latlon(s.select("x"), "x").join(s, "x").select(F.col("s_suppkey").alias("geonameid"), "lat", "lon")
    c = _latlon(table(spark, d, "customer"), "c_custkey")
    return c.join(nearest.nearest(c, p, out="place_id"), ["lat", "lon"]).select("c_custkey", "place_id")


@query("SELECT s_suppkey, abs((x1 * y2 - x2 * y1) + (x2 * y3 - x3 * y2) + (x3 * y1 - x1 * y3)) / 2 AS area FROM (SELECT s_suppkey, CAST(s_suppkey % 7 AS DOUBLE) AS x1, CAST(s_suppkey % 11 AS DOUBLE) AS y1, CAST(s_suppkey % 5 + 3 AS DOUBLE) AS x2, CAST(s_suppkey % 3 AS DOUBLE) AS y2, CAST(s_suppkey % 13 AS DOUBLE) AS x3, CAST(s_suppkey % 4 + 6 AS DOUBLE) AS y3 FROM supplier)")
def polygon_area(spark, d):
    k = F.col("s_suppkey")
    xs, ys = F.array(k % 7, k % 5 + 3, k % 13).cast("array<double>"), F.array(k % 11, k % 3, k % 4 + 6).cast("array<double>")
    return table(spark, d, "supplier").select("s_suppkey", geometry.polygon_area(xs, ys).alias("area"))


@query("SELECT c_custkey, CAST(abs((c_custkey % 50 - c_custkey % 20) * (c_custkey % 90 - c_custkey % 30)) AS DOUBLE) AS area FROM customer")
def bbox_area(spark, d):
    k = F.col("c_custkey")
    box = F.from_json(F.format_string("[%d,%d,%d,%d]", k % 20, k % 30, k % 50, k % 90), "array<double>")
    return table(spark, d, "customer").select("c_custkey", geometry.bbox_area(box).alias("area"))


@query("SELECT DISTINCT round_even(l_extendedprice / 1000, 0) AS cell FROM lineitem")
def distinct_cells(spark, d):
    return table(spark, d, "lineitem").select(F.bround(F.col("l_extendedprice") / 1000, 0).alias("cell")).dropDuplicates()


@query("SELECT page_id, round(length(regexp_replace(html, '<[^>]*>', '', 'g')) / greatest(1, length(html)), 6) AS text_density FROM pages")
def text_density(spark, d):
    return table(spark, d, "pages").select("page_id", F.round(F.length(F.regexp_replace("html", "<[^>]*>", "")) / F.greatest(F.lit(1), F.length("html")), 6).alias("text_density"))


# --- dates and names --------------------------------------------------------------------

_NAME = """CASE o_orderkey % 7 WHEN 0 THEN 'IMG_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '.jpg' WHEN 1 THEN 'WhatsApp Image ' || strftime(o_orderdate, '%Y-%m-%d') || ' at 12.34.56.jpeg'
WHEN 2 THEN 'IMG-' || strftime(o_orderdate, '%Y%m%d') || '-WA0001.jpg' WHEN 3 THEN 'trip ' || strftime(o_orderdate, '%Y-%m-%d') || '.png' WHEN 4 THEN strftime(o_orderdate, '%Y%m%d') || '.png'
WHEN 5 THEN 'IMG_20231399_999999.jpg' ELSE 'DSC0' || o_orderkey || 'x.jpg' END"""


def _named(spark, d) -> DataFrame:
    f = lambda p: F.date_format("o_orderdate", p)
    k = F.col("o_orderkey") % 7
    name = (
        F.when(k == 0, F.concat(F.lit("IMG_"), f("yyyyMMdd_HHmmss"), F.lit(".jpg")))
        .when(k == 1, F.concat(F.lit("WhatsApp Image "), f("yyyy-MM-dd"), F.lit(" at 12.34.56.jpeg")))
        .when(k == 2, F.concat(F.lit("IMG-"), f("yyyyMMdd"), F.lit("-WA0001.jpg")))
        .when(k == 3, F.concat(F.lit("trip "), f("yyyy-MM-dd"), F.lit(".png")))
        .when(k == 4, F.concat(f("yyyyMMdd"), F.lit(".png")))
        .when(k == 5, F.lit("IMG_20231399_999999.jpg"))
        .otherwise(F.concat(F.lit("DSC0"), F.col("o_orderkey").cast("string"), F.lit("x.jpg")))
    )
    exif = F.when(F.col("o_orderkey") % 3 == 0, f("yyyy:MM:dd HH:mm:ss")).when(F.col("o_orderkey") % 3 == 1, "0000:00:00 00:00:00")
    return table(spark, d, "orders").select("o_orderkey", name.alias("name"), exif.alias("exif"), F.lit(86400.0 * 365 * 40).alias("mtime"))


_FROM_NAME = """CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.000000') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d 12:34:56.000000')
WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d 00:00:00.000000') END"""


@query(f"SELECT o_orderkey, {_NAME} AS name, {_FROM_NAME} AS taken_at FROM orders")
def filename_date(spark, d):
    return _named(spark, d).select("o_orderkey", "name", iso(dates.from_filename(F.col("name"))).alias("taken_at"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.000000') END AS taken_at FROM orders")
def exif_date(spark, d):
    return _named(spark, d).select("o_orderkey", iso(dates.from_exif(F.col("exif"))).alias("taken_at"))


@query(f"""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.000000') END AS e, {_FROM_NAME} AS n FROM orders)
SELECT o_orderkey, coalesce(e, n, '2009-12-22 00:00:00.000000') AS taken_at, CASE WHEN e IS NOT NULL THEN 'exif' WHEN n IS NOT NULL THEN 'filename' ELSE 'mtime' END AS source,
CASE WHEN e IS NOT NULL THEN 'high' WHEN n IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence FROM x""")
def date_cascade(spark, d):
    # The generator keeps the three fields from being computed one by one.
    t = _named(spark, d).select("o_orderkey", F.inline(F.array(dates.cascade(F.col("exif"), F.col("name"), F.col("mtime")))))
    return t.select("o_orderkey", iso("taken_at").alias("taken_at"), "source", "confidence")


@query(r"""WITH n AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'con.' || page_id WHEN 1 THEN ' . ' WHEN 2 THEN url || ' .' ELSE url END AS n FROM pages),
s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(n, '[<>:"/\\|?*\x00-\x1F]', '_', 'g'), '^\s+|\s+$', '', 'g'), '[ .]+$', '', 'g') AS s FROM n)
SELECT page_id, CASE WHEN s = '' THEN '_' WHEN upper(split_part(s, '.', 1)) IN ('CON', 'PRN', 'AUX', 'NUL') THEN '_' || s ELSE s END AS clean FROM s""")
def sanitize(spark, d):
    k = F.col("page_id") % 5
    n = F.when(k == 0, F.concat(F.lit("con."), F.col("page_id").cast("string"))).when(k == 1, " . ").when(k == 2, F.concat("url", F.lit(" ."))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", text.sanitize(n).alias("clean"))


@query(r"""WITH n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Show.S01E02.mkv' WHEN 1 THEN 'film.1080p.mp4' WHEN 2 THEN 'VID_' || p_partkey || '.mp4' WHEN 3 THEN '[grp]' || p_name WHEN 4 THEN 'A.B.C.D.2021.mp4' ELSE p_name END AS name FROM part)
SELECT p_partkey, p_partkey % 6 IN (0, 1, 3, 4) AS is_release FROM n""")
def release_names(spark, d):
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, "Show.S01E02.mkv").when(k == 1, "film.1080p.mp4").when(k == 2, F.concat(F.lit("VID_"), F.col("p_partkey").cast("string"), F.lit(".mp4"))).when(k == 3, F.concat(F.lit("[grp]"), "p_name")).when(k == 4, "A.B.C.D.2021.mp4").otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", text.is_release(name).alias("is_release"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'photo' WHEN 1 THEN 'raw' WHEN 2 THEN 'video' END AS media_type FROM part")
def media_types(spark, d):
    k = F.col("p_partkey") % 4
    return table(spark, d, "part").select("p_partkey", text.media_type(F.when(k == 0, ".JPG").when(k == 1, "cr2").when(k == 2, ".Mov").otherwise("txt"), EXTENSIONS).alias("media_type"))


# --- filter language and plan -----------------------------------------------------------


def _files(spark, d) -> DataFrame:
    """Orders as files, with place, verdict, choice, persons and event columns already joined."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    k = F.col("o_orderkey")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return rows.select(
        k.alias("id"),
        F.concat(F.lit("/in/d"), (k % 10).cast("string"), F.lit("/f"), (k % 500).cast("string"), F.lit(".jpg")).alias("path"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("taken_at"),
        F.when(k % 9 == 0, "low").otherwise("high").alias("taken_at_confidence"),
        F.col("r_name").alias("country"),
        F.col("r_name").alias("country_name"),
        F.when(k % 8 != 0, F.col("n_name")).alias("city"),
        F.lit(None).cast("long").alias("city_geonameid"),
        F.lit(None).cast("long").alias("district_geonameid"),
        F.when(k % 5 == 0, "Old Town").alias("district_name"),
        F.when(k % 8 != 0, "exact_gps").otherwise("unknown").alias("place_confidence"),
        F.when(F.col("o_orderstatus") == "F", "document").when(k % 11 == 0, "meme").otherwise("photo").alias("junk_verdict"),
        F.when(F.col("o_orderpriority").startswith("1"), "to_delete").alias("dedup_action"),
        (k % 23 == 0).alias("not_personal"),
        F.when(k % 3 == 0, F.array(F.lit("Ann"), F.lit("Bob"))).when(k % 3 == 1, F.array(F.lit("Cy"))).alias("persons"),
        F.when(k % 4 == 0, F.concat(F.lit("Trip "), (k % 6).cast("string"))).alias("event"),
        F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy")).alias("event_year"),
        F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"),
        F.col("o_totalprice").cast("long").alias("size"),
    )


_FILES = """WITH b AS (SELECT o_orderkey AS id, '/in/d' || (o_orderkey % 10) || '/f' || (o_orderkey % 500) || '.jpg' AS path, 'f' || (o_orderkey % 500) AS stem, o_orderdate AS taken_at, o_orderkey % 9 = 0 AS low,
r_name AS country, CASE WHEN o_orderkey % 8 <> 0 THEN n_name END AS city, CASE WHEN o_orderstatus = 'F' THEN 'document' WHEN o_orderkey % 11 = 0 THEN 'meme' ELSE 'photo' END AS verdict,
starts_with(o_orderpriority, '1') AS del, o_orderkey % 23 = 0 AS film, o_orderkey AS k, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m') AS mon
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) """
_FIRST_RULES = "CASE WHEN del THEN '_delete|dedup_delete' WHEN film THEN '_Unsorted/not_personal|not_personal' WHEN verdict = 'document' THEN '_Documents|document' WHEN verdict <> 'photo' THEN '_Unsorted/junk/' || verdict || '|junk' "
_TARGETS = """, t AS (SELECT *, '/out/' || split_part(rule, '|', 1) AS folder, split_part(rule, '|', 2) AS reason FROM q),
u AS (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY path, id) - 1 AS nth FROM t)
SELECT id, reason, folder || '/' || stem || CASE WHEN nth > 0 THEN '_' || nth ELSE '' END || '.jpg' AS target FROM u"""


def _plan(spark, d, mode: str) -> DataFrame:
    return plan.plan(_files(spark, d), mode, "/out").select("id", "reason", "target")


@query(_FILES + ", q AS (SELECT *, " + _FIRST_RULES + "WHEN low THEN '_Unsorted/low_date|low_date' WHEN city IS NULL THEN '_Unsorted/no_place|no_place' ELSE country || '/' || city || '/' || y || CASE WHEN k % 5 = 0 THEN '/Old Town' ELSE '' END || '|city' END AS rule FROM b)" + _TARGETS)
def plan_city(spark, d):
    return _plan(spark, d, "city")


@query(_FILES + ", q AS (SELECT *, " + _FIRST_RULES + "WHEN k % 4 = 0 THEN y || '/Trip ' || (k % 6) || '|event' WHEN low THEN '_Unsorted/low_date|low_date' ELSE y || '/' || mon || '|no_event' END AS rule FROM b)" + _TARGETS)
def plan_event(spark, d):
    return _plan(spark, d, "event")


@query(_FILES + ", q AS (SELECT *, " + _FIRST_RULES + "WHEN low THEN '_Unsorted/low_date|low_date' WHEN k % 3 = 2 THEN '_Unsorted/no_faces|no_faces' WHEN k % 3 = 1 THEN 'Cy/' || y || '|person' ELSE 'Ann/' || y || '|person_primary' END AS rule FROM b)" + _TARGETS)
def plan_person(spark, d):
    return _plan(spark, d, "person")


@query(_FILES + ", q AS (SELECT *, " + _FIRST_RULES + "WHEN low THEN '_Unsorted/low_date|low_date' WHEN city IS NULL THEN '_Unsorted/no_place|no_place' ELSE country || '/' || city || '/' || y || CASE WHEN k % 5 = 0 THEN '/Old Town' ELSE '' END || '|city' END AS rule FROM b), p AS (SELECT string_split(split_part(rule, '|', 1), '/') AS s FROM q) SELECT array_to_string(s[1:i], '/') AS prefix, CAST(i AS INTEGER) AS depth, count(*) AS n FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM p) GROUP BY ALL")
def tree_counts(spark, d):
    r = plan.route(_files(spark, d), "city").withColumn("rel", F.array_join("parts", "/"))
    return grouping.tree_counts(r, "rel")


@query("WITH n AS (SELECT p_partkey AS id, '/t/' || (p_partkey % 3) AS folder, 'n' || (p_partkey % 20) AS stem FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY id) - 1 AS k FROM n) SELECT id, folder || '/' || stem || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.png' AS target FROM r")
def dst_suffix(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("id"), F.lpad(k.cast("string"), 12, "0").alias("path"), F.concat(F.lit("/t/"), (k % 3).cast("string")).alias("folder"), F.concat(F.lit("n"), (k % 20).cast("string"), F.lit(".png")).alias("name"))
    return plan.assign_targets(p).select("id", "target")


@query(_FILES + "SELECT id FROM b WHERE year(taken_at) >= 1995 AND lower(country) = 'asia' AND year(taken_at) <> 1996")
def where_year_country(spark, d):
    return where.apply(_files(spark, d), ["year>=1995", "country = Asia", "year!=1996"]).select("id")


@query(_FILES + "SELECT id FROM b WHERE k % 3 = 0")
def where_person(spark, d):
    f = _files(spark, d)
    people = f.select(F.col("id").alias("file_id"), F.explode("persons").alias("label"))
    return where.apply(f, ["person=Bob"], where.Names(persons=people)).select("id")


@query(_FILES + "SELECT id FROM b WHERE lower(city) = 'nation_1' AND k % 4 = 0 AND k % 6 = 4")
def where_city_event(spark, d):
    f = _files(spark, d)
    e = f.select(F.col("id").alias("file_id"), F.col("event").alias("name")).where("name IS NOT NULL")
    return where.apply(f, ["city=Nation_1", "event=trip 4"], where.Names(events=e)).select("id")


@query(_FILES + "SELECT id FROM b WHERE NOT starts_with(path, '/in/d1/') AND path <> '/in/d1'")
def exclude_dirs(spark, d):
    return _files(spark, d).where(~text.below(F.col("path"), "/in/d1")).select("id")


@query(_FILES + ", m AS (SELECT * FROM b WHERE k % 4 = 0 AND k % 6 = 2 AND year(taken_at) >= 1995 AND k % 3 <> 0), u AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY path, id) - 1 AS nth FROM m) SELECT id, '/albums/Trip 2/' || stem || CASE WHEN nth > 0 THEN '_' || nth ELSE '' END || '.jpg' AS target FROM u")
def album(spark, d):
    f = _files(spark, d)
    n = f.select("id", F.size("persons").alias("n"))
    return plan.album(f, "/albums", "Trip 2", f.where("event = 'Trip 2'"), ["year>=1995"], move=True, n_persons=n).select("id", "target")


@query("SELECT '/in' AS common")
def common_prefix(spark, d):
    return grouping.common_prefix(_files(spark, d), "path")


# --- statistics, increments, journal ----------------------------------------------------


def _index(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 3 == 0, 1.0).alias("gps_lat"), F.when(k % 4 == 0, "exif").when(k % 4 == 1, "filename").otherwise("mtime").alias("taken_at_source"), F.when(k % 10 == 0, k - 1).alias("dup_of"), F.when(k % 15 == 0, "bad").alias("error")
    )


_PARTS = {"with_gps": "k % 3 = 0", "exif": "k % 4 = 0", "filename": "k % 4 = 1", "mtime": "k % 4 > 1", "dups": "k % 10 = 0", "errors": "k % 15 = 0"}


@query("SELECT count(*) FILTER (k % 15 <> 0) AS total, " + ", ".join(f"count(*) FILTER ({c}) AS {n}, CAST(count(*) FILTER ({c}) * 100 // count(*) FILTER (k % 15 <> 0) AS BIGINT) AS {n}_pct" for n, c in _PARTS.items()) + " FROM (SELECT o_orderkey AS k FROM orders)")
def index_stats(spark, d):
    return grouping.coverage(_index(spark, d))


@query("SELECT o_orderstatus AS confidence, count(*) AS n FROM orders GROUP BY ALL")
def group_confidence(spark, d):
    return grouping.histogram(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "confidence"), "confidence").orderBy(F.desc("n"), "confidence")


def _snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    k, o = F.col("o_orderkey"), table(spark, d, "orders")
    row = lambda df, size: df.select(k.cast("string").alias("path"), size.cast("long").alias("size"), F.lit(1.0).alias("mtime"))
    return row(o.where(k % 7 != 0), F.col("o_totalprice")), row(o.where(k % 11 != 0), F.when(k % 5 == 0, F.col("o_totalprice") + 10).otherwise(F.col("o_totalprice")))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 7 = 0 THEN 'add' WHEN o_orderkey % 5 = 0 THEN 'update' ELSE 'skip' END AS action FROM orders WHERE o_orderkey % 11 <> 0")
def change_detect(spark, d):
    return tables.changes(*_snapshots(spark, d)).select("path", "action")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, CAST(trunc(CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 5 = 0 THEN o_totalprice + 10 ELSE o_totalprice END) AS BIGINT) AS size FROM orders WHERE o_orderkey % 11 <> 0 OR o_orderkey % 7 <> 0")
def upsert_merge(spark, d):
    old, new = _snapshots(spark, d)
    return tables.upsert(old, new, ["path"]).select("path", "size")


@query("SELECT max(o_orderkey) AS batch_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linestatus = 'F'")
def latest_batch(spark, d):
    moves = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(moves, "o_orderkey", "left_semi").agg(F.max("o_orderkey").alias("batch_id"))


@query("WITH m AS (SELECT max(l_orderkey) AS b FROM lineitem WHERE l_linestatus = 'F') SELECT l_orderkey AS batch_id, l_linenumber AS move_id, CAST(row_number() OVER (ORDER BY l_linenumber DESC, l_partkey) AS INTEGER) AS step FROM lineitem JOIN m ON l_orderkey = b WHERE l_linestatus = 'F'")
def undo_set(spark, d):
    done = table(spark, d, "lineitem").where("l_linestatus = 'F'")
    last = done.agg(F.max("l_orderkey").alias("l_orderkey"))
    own = done.join(F.broadcast(last), "l_orderkey")  # broadcast: one row
    return own.select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("move_id"), F.row_number().over(Window.orderBy(F.desc("l_linenumber"), "l_partkey")).alias("step"))


# --- existence --------------------------------------------------------------------------


@query("SELECT EXISTS (SELECT 1 FROM labels WHERE toxic = 1) AS has_toxic, EXISTS (SELECT 1 FROM documents WHERE n_chars < 0) AS has_negative")
def exists_flags(spark, d):
    a = table(spark, d, "labels").agg(F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("has_toxic"))
    b = table(spark, d, "documents").agg(F.coalesce(F.bool_or(F.col("n_chars") < 0), F.lit(False)).alias("has_negative"))
    return a.crossJoin(b)  # one row each


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents")
def mark_join(spark, d):
    m = table(spark, d, "labels").select("doc_id").distinct().withColumn("_m", F.lit(True))
    return table(spark, d, "documents").join(m, "doc_id", "left").select("doc_id", F.col("_m").isNotNull().alias("labelled"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_unprocessed(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "n_chars")
