"""More queries by name: a whole index made of the test tables, and the operators that work on its tables.

Orders are files, customers' nations their places, line items their faces, order months their events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.functions import dates, geometry, text
from tidemark.operators import classify, clusters, events, graphs, grouping, nearest, places
from tidemark.operators import naming as names
from tidemark.plans import plan, reports, run, where
from tidemark.plans.registry import _FILES, _FIRST_RULES, _TARGETS, ISO, _files, iso, query, table
from tidemark.sources import files as source
from tidemark.sources import tables


def _tables(spark, d) -> run.Tables:
    """The columns of the joined frame, taken apart into the tables of an index."""
    f = _files(spark, d)
    own = f.select("id", "path", "size", "width", "height", "taken_at", "taken_at_confidence", "not_personal", F.lit("photo").alias("media_type"), F.lit(None).cast("long").alias("dup_of"), F.lit(None).cast("string").alias("error"))
    place = f.select(F.col("id").alias("file_id"), "country", "country_name", "city", "city_geonameid", "district_geonameid", "district_name", F.col("place_confidence").alias("confidence"))
    verdict = f.select(F.col("id").alias("file_id"), F.col("junk_verdict").alias("verdict"), F.lit("clip").alias("source"))
    choice = f.where("dedup_action IS NOT NULL").select(F.col("id").alias("file_id"), F.col("dedup_action").alias("action"))
    heads = spark.createDataFrame([(1, "Ann", None), (2, "Bob", None), (3, None, 4), (4, "Cy", None), (5, None, None)], schema.FACE_CLUSTERS)
    cluster = F.create_map(*[F.lit(x) for pair in (("Ann", 1), ("Bob", 2), ("Cy", 3)) for x in pair])
    side = F.when(F.col("label") == "Ann", 9.0).otherwise(5.0)
    faces = f.select(F.col("id").alias("file_id"), F.explode("persons").alias("label")).select(
        (F.col("file_id") * 10 + F.try_element_at(cluster, F.col("label"))).cast("long").alias("id"), "file_id", F.array(F.lit(0.0), F.lit(0.0), side, side).alias("bbox"), F.try_element_at(cluster, F.col("label")).cast("long").alias("cluster_id")
    )
    held = f.where("event IS NOT NULL").select(F.col("id").alias("file_id"), "event", "taken_at", "event_year")
    number = F.crc32(F.concat_ws("/", "event", "event_year")).cast("long")
    ev = held.groupBy(number.alias("id"), F.col("event").alias("name")).agg(F.min("taken_at").alias("started_at"), F.max("taken_at").alias("ended_at"))
    return run.Tables(own, place, verdict, choice, faces, heads, ev, held.select(number.alias("event_id"), "file_id"))


_CITY_RULES = ", q AS (SELECT *, " + _FIRST_RULES + "WHEN low THEN '_Unsorted/low_date|low_date' WHEN city IS NULL THEN '_Unsorted/no_place|no_place' ELSE country || '/' || city || '/' || y || CASE WHEN k % 5 = 0 THEN '/Old Town' ELSE '' END || '|city' END AS rule FROM b)"
_EVENT_RULES = ", q AS (SELECT *, " + _FIRST_RULES + "WHEN k % 4 = 0 THEN y || '/Trip ' || (k % 6) || '|event' WHEN low THEN '_Unsorted/low_date|low_date' ELSE y || '/' || mon || '|no_event' END AS rule FROM b)"
_PERSON_RULES = ", q AS (SELECT *, " + _FIRST_RULES + "WHEN low THEN '_Unsorted/low_date|low_date' WHEN k % 3 = 2 THEN '_Unsorted/no_faces|no_faces' WHEN k % 3 = 1 THEN 'Cy/' || y || '|person' ELSE 'Ann/' || y || '|person_primary' END AS rule FROM b)"


@query(_FILES + "SELECT id, country, city, verdict AS junk_verdict, CASE WHEN del THEN 'to_delete' END AS dedup_action, CASE k % 3 WHEN 0 THEN 'Ann,Bob' WHEN 1 THEN 'Cy' END AS persons, CASE WHEN k % 4 = 0 THEN 'Trip ' || (k % 6) END AS event, CASE WHEN k % 4 = 0 THEN y END AS event_year FROM b WHERE NOT starts_with(path, '/in/d7/')")
def assemble(spark, d):
    t = _tables(spark, d)
    people, trips = plan.persons_of(graphs.person_files(t.clusters, t.faces)), plan.event_of(t.event_files, t.events)
    a = plan.assemble(t.files, t.places, t.media_class, t.choice, people, trips, ["/in/d7"])
    return a.select("id", "country", "city", "junk_verdict", "dedup_action", F.array_join("persons", ",").alias("persons"), "event", "event_year")


@query(_FILES + _CITY_RULES + _TARGETS)
def run_city(spark, d):
    return run.make_plan(_tables(spark, d), "city", "/out").select("id", "reason", "target")


@query(_FILES + _EVENT_RULES + _TARGETS)
def run_event(spark, d):
    return run.make_plan(_tables(spark, d), "event", "/out").select("id", "reason", "target")


@query(_FILES + _PERSON_RULES + _TARGETS.replace("FROM q)", "FROM q WHERE k % 3 = 0 AND year(taken_at) >= 1995)"))
def run_person_filtered(spark, d):
    return run.make_plan(_tables(spark, d), "person", "/out", expressions=["person=Bob", "year>=1995"]).select("id", "reason", "target")


@query(_FILES + _CITY_RULES + ", t AS (SELECT *, split_part(rule, '|', 2) AS reason FROM q) SELECT reason, count(*) AS n FROM t GROUP BY reason")
def run_counters(spark, d):
    one = run.counters(run.make_plan(_tables(spark, d), "city", "/out"), "/out")
    return one.select(F.explode("reasons").alias("reason", "n"))


# --- near duplicates ----------------------------------------------------------------------

_NEAR = _FILES + _CITY_RULES + """, e AS (SELECT q.*, split_part(rule, '|', 2) AS reason, CAST(trunc(o_totalprice) AS BIGINT) AS size, k // 7 AS g FROM q JOIN orders ON o_orderkey = id),
m AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY size DESC, id) AS r FROM e WHERE reason NOT IN ('document', 'junk', 'not_personal', 'dedup_delete')),
w AS (SELECT *, dense_rank() OVER (ORDER BY g) AS no FROM m WHERE n >= 2) """


def _routed(spark, d) -> tuple[DataFrame, DataFrame]:
    r = plan.route(_files(spark, d), "city")
    return r, r.select(F.floor(F.col("id") / 7).cast("int").alias("group_no"), "id")


@query(_NEAR + "SELECT id, CAST(no AS INTEGER) AS near_dup_group, CASE r WHEN 1 THEN 'kept' ELSE 'moved' END AS near_dup_role FROM w")
def near_dup_roles(spark, d):
    return plan.near_dup_roles(*_routed(spark, d)).select("id", "near_dup_group", "near_dup_role")


@query(_NEAR + "SELECT e.id, CASE WHEN w.r > 1 THEN 'near_dup_delete' ELSE e.reason END AS reason, CASE WHEN w.r > 1 THEN '_Duplicates' ELSE split_part(e.rule, '|', 1) END AS folder FROM e LEFT JOIN w ON w.id = e.id")
def near_dup_routes(spark, d):
    r, groups = _routed(spark, d)
    return plan.route_near_dups(r, groups, delete=True).select("id", "reason", F.array_join("parts", "/").alias("folder"))


@query("WITH g AS (SELECT p_partkey AS file_id, p_partkey // 5 AS group_no, p_partkey % 5 AS place, 'f' || p_partkey || '.jpg' AS name, p_size AS width, 10 AS height, CAST(trunc(p_retailprice) AS BIGINT) AS size, CASE WHEN p_partkey % 3 = 0 THEN 'keep' END AS action FROM part) SELECT *, row_number() OVER (PARTITION BY group_no ORDER BY width * height DESC, size DESC, file_id) = 1 AS recommended FROM g")
def dupes_payload(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    f = p.select(k.alias("id"), F.concat(F.lit("/a/f"), k.cast("string"), F.lit(".jpg")).alias("path"), F.col("p_size").alias("width"), F.lit(10).alias("height"), F.col("p_retailprice").cast("long").alias("size"))
    groups = p.select(F.floor(k / 5).alias("group_no"), (k % 5).alias("place"), k.alias("id"))
    return run.dupes_payload(f, p.where(k % 3 == 0).select(k.alias("file_id"), F.lit("keep").alias("action")), groups)


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 4 <> 0")
def trash_left(spark, d):
    k = F.col("p_partkey")
    f = table(spark, d, "part").select(k.alias("id"), F.col("p_name").alias("path"))
    ids = f.where("id % 4 = 0").select("id").union(f.selectExpr("id + 1000000000 AS id"))
    return run.trash(f, f.select(F.col("id").alias("file_id")), ids, lambda path: None)[0].select("id")


# --- faces and events ------------------------------------------------------------------------


def _heads(spark, d) -> DataFrame:
    """Suppliers as clusters: every third is a root, others hang on the one before."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), F.when(k % 2 == 0, F.col("s_name")).alias("label"), F.when((k % 3 != 0) & (k > 1), k - 1).alias("merged_into"))


def _faces(spark, d) -> DataFrame:
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    box = F.when(n == 7, F.array().cast("array<double>")).otherwise(F.array(F.lit(0.0), F.lit(0.0), n.cast("double"), F.lit(2.0)))
    return table(spark, d, "lineitem").select((k * 10 + n).alias("id"), k.alias("file_id"), box.alias("bbox"), F.col("l_suppkey").alias("cluster_id"))


_HEADS = "WITH h AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS label, CASE WHEN s_suppkey % 3 = 0 OR s_suppkey <= 1 THEN s_suppkey WHEN s_suppkey % 3 = 1 THEN s_suppkey - 1 WHEN s_suppkey = 2 THEN 1 ELSE s_suppkey - 2 END AS root FROM supplier), f AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS file_id, l_linenumber * 2.0 AS area, l_suppkey AS cluster_id FROM lineitem WHERE l_linenumber <> 7), p AS (SELECT f.*, h.root, r.label FROM f JOIN h ON h.id = f.cluster_id JOIN h r ON r.id = h.root) "


@query(_HEADS + "SELECT file_id, label, id AS face_id, root FROM p WHERE label IS NOT NULL")
def person_files(spark, d):
    return graphs.person_files(_heads(spark, d), _faces(spark, d)).select("file_id", "label", "face_id", "root")


@query(_HEADS + ", m AS (SELECT file_id, label, max(area) AS area FROM p WHERE label IS NOT NULL GROUP BY ALL) SELECT file_id, string_agg(label, ',' ORDER BY area DESC, label) AS persons FROM m GROUP BY file_id")
def persons_of_files(spark, d):
    return plan.persons_of(graphs.person_files(_heads(spark, d), _faces(spark, d))).select("file_id", F.array_join("persons", ",").alias("persons"))


@query(_HEADS + "SELECT id, file_id FROM p WHERE root = 3")
def cluster_faces_of(spark, d):
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("path"))
    return reports.contact_sheet(_heads(spark, d), _faces(spark, d).where(F.size("bbox") == 4), f, 3).select("id", "file_id")


@query("SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_linenumber = 7")
def face_markers(spark, d):
    hits = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file_id"), F.array(F.lit(0.0), F.lit(0.0), F.lit(50.04), F.lit(60.0)).alias("bbox"), F.when(F.col("l_linenumber") == 7, 0.5).otherwise(0.9).alias("score"), F.lit(None).cast("array<float>").alias("embedding"))
    return classify.detected_faces(hits).where(F.size("bbox") == 0).select(F.col("file_id").alias("id"))


@query("WITH x AS (SELECT o_custkey AS event_id, min(o_orderdate) AS s, max(o_orderdate) AS e FROM orders GROUP BY 1), j AS (SELECT l.l_orderkey AS file_id, x.event_id, x.s FROM lineitem l JOIN orders ON o_orderkey = l_orderkey JOIN x ON x.event_id = o_custkey) SELECT DISTINCT file_id, 'E' || event_id AS event, strftime(s, '%Y') AS event_year FROM j")
def event_of_files(spark, d):
    o = table(spark, d, "orders")
    ev = o.groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("started_at")).withColumn("name", F.concat(F.lit("E"), F.col("id").cast("string")))
    late = ev.select((F.col("id") + 10**9).alias("id"), F.expr("started_at + INTERVAL 1 YEAR").alias("started_at"), F.lit("later").alias("name"))
    held = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("event_id"), F.col("l_orderkey").alias("file_id"))
    both = held.union(held.select(F.col("event_id") + 10**9, "file_id"))
    return plan.event_of(both, ev.unionByName(late)).select("file_id", "event", "event_year")


@query("WITH m AS (SELECT o_custkey AS id, o_orderkey AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderkey % 13 <> 0) SELECT c_custkey AS id, coalesce(max(n), 0) AS n, string_agg(f, ',' ORDER BY r) FILTER (r <= 3) AS samples FROM customer LEFT JOIN m ON id = c_custkey GROUP BY 1")
def event_samples(spark, d):
    o = table(spark, d, "orders")
    f = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("taken_at"), F.lit(None).cast("long").alias("dup_of"), F.when(F.col("o_orderkey") % 13 == 0, "bad").alias("error"))
    cards = reports.event_cards(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), o.select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("file_id")), f, 3)
    return cards.select("id", "n", F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


@query("SELECT o_custkey AS event_id, o_orderkey AS file_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def event_orphans(spark, d):
    child = table(spark, d, "orders").select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("file_id"))
    return schema.orphans(child, "event_id", table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id")))


def _located(spark, d) -> DataFrame:
    """Events as dated files with places: cities of two regions and a country."""
    k = F.col("event_id")
    city = k % 5
    return table(spark, d, "events").select(
        k.alias("id"), F.col("ts").cast("timestamp_ntz").alias("taken_at"), F.when(k % 17 == 0, "low").otherwise("high").alias("taken_at_confidence"), F.when(k % 19 == 0, k - 1).alias("dup_of"), F.lit(None).cast("string").alias("error"),
        F.lit("XX").alias("country"), F.when(city < 4, F.concat(F.lit("i:"), city.cast("string"))).alias("locality"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"),
        F.when(city < 4, F.concat(F.lit("City "), city.cast("string"))).alias("place_name"), F.when(city < 2, "North").alias("region_name"), F.lit("Land").alias("country_name"),
    )


_EVENTS = f"""WITH f AS (SELECT event_id AS id, ts, event_id % 5 AS c FROM events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, id) <= INTERVAL '5 minutes' THEN 0 ELSE 1 END AS new FROM f),
s AS (SELECT *, sum(new) OVER (ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS no FROM g),
n AS (SELECT no, c, count(*) AS n, min((ts, id)) AS first FROM s WHERE c < 4 GROUP BY ALL),
m AS (SELECT no, c, row_number() OVER (PARTITION BY no ORDER BY n DESC, first) AS r, count(*) OVER (PARTITION BY no) AS kinds FROM n),
e AS (SELECT s.no, min(ts) AS a, max(ts) AS z, count(*) AS n FROM s GROUP BY s.no HAVING count(*) >= 3),
p AS (SELECT e.*, CASE WHEN kinds = 1 THEN 'City ' || c WHEN c < 2 THEN 'North' WHEN c < 4 THEN 'Land' END AS place FROM e LEFT JOIN m ON m.no = e.no AND r = 1)
SELECT strftime(a, '{ISO}') AS started_at, strftime(z, '{ISO}') AS ended_at, place AS place_city,
strftime(a, '%Y-%m-%d') || CASE WHEN CAST(a AS DATE) = CAST(z AS DATE) THEN '' WHEN year(a) = year(z) THEN '..' || strftime(z, '%m-%d') ELSE '..' || strftime(z, '%Y-%m-%d') END || coalesce(' ' || place, '') AS name FROM p"""


@query(_EVENTS)
def events_built(spark, d):
    ev, _ = events.build(_located(spark, d), 5 / 60, 0, 3, 0)
    return ev.select(iso("started_at").alias("started_at"), iso("ended_at").alias("ended_at"), "place_city", "name")


@query("WITH c AS (SELECT event_id AS id, event_id % 5 AS c, user_id FROM events), n AS (SELECT user_id, c, count(*) AS n, min(id) AS f FROM c WHERE c < 4 GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r, count(*) OVER (PARTITION BY user_id) AS kinds FROM n) SELECT user_id AS trip, CASE WHEN kinds = 1 THEN 'City ' || c WHEN c < 2 THEN 'North' ELSE 'Land' END AS place FROM m WHERE r = 1")
def event_place_names(spark, d):
    k = F.col("event_id")
    f = table(spark, d, "events").select(F.col("user_id").alias("trip"), k.alias("id"), F.lit(0).alias("taken_at"), (k % 5).alias("c"))
    city, known = F.concat(F.lit("City "), F.col("c").cast("string")), F.col("c") < 4
    f = f.select("trip", "id", "taken_at", F.when(known, city).alias("locality"), F.when(known, city).alias("place_name"), F.when(F.col("c") < 2, "North").alias("region_name"), F.lit("Land").alias("country_name"))
    return events.place_names(f)


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'i:' || c_nationkey WHEN 1 THEN 's:' || lower(n_name) WHEN 2 THEN 's:old ' || lower(n_name) END AS locality FROM customer JOIN nation ON n_nationkey = c_nationkey")
def locality_key(spark, d):
    k = F.col("c_custkey") % 4
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    p = c.select(F.col("c_custkey").alias("file_id"), F.when(k == 0, F.col("c_nationkey")).alias("city_geonameid"), F.when(k == 1, F.concat(F.lit("  "), F.upper("n_name"), F.lit(" "))).when(k == 3, "").otherwise(F.col("n_name")).alias("city"), F.when(k == 2, F.concat(F.lit("Old "), F.col("n_name"))).alias("district_name"))
    return events.with_locality(c.select(F.col("c_custkey").alias("id")), p).select("id", "locality")


@query("SELECT o_custkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'Manual' ELSE strftime(min(o_orderdate), '%Y-%m-%d') || CASE WHEN CAST(min(o_orderdate) AS DATE) = CAST(max(o_orderdate) AS DATE) THEN '' WHEN year(min(o_orderdate)) = year(max(o_orderdate)) THEN '..' || strftime(max(o_orderdate), '%m-%d') ELSE '..' || strftime(max(o_orderdate), '%Y-%m-%d') END || ' Town' END AS name FROM orders GROUP BY 1")
def named_events(spark, d):
    k = F.col("o_custkey")
    ev = table(spark, d, "orders").groupBy(k.alias("id")).agg(F.min("o_orderdate").alias("started_at"), F.max("o_orderdate").alias("ended_at"))
    ev = ev.select("id", "started_at", "ended_at", F.lit("Town").alias("place_city"), F.when(F.col("id") % 2 == 0, "Manual").otherwise("old").alias("name"), (F.col("id") % 2 == 0).alias("name_is_manual"))
    return names.name_events(ev, names.by_template(ev))[0].select("id", "name")


@query("SELECT vec_id AS id, 1 + CAST(vec_id % 3 AS BIGINT) AS cluster_id FROM embeddings")
def density_clusters(spark, d):
    """Three tight bundles of directions, numbered by their first face."""
    k = F.col("vec_id")
    axis = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i == k % 3, 1.0).otherwise(0.01 * F.sin(k * (i + 1))).cast("float"))
    f = table(spark, d, "embeddings").select(k.alias("id"), k.alias("file_id"), F.array(*[F.lit(float(x)) for x in (0, 0, 9, 9)]).alias("bbox"), axis.alias("embedding"))
    return clusters.cluster_faces(f, 5, 0.5, 8).select("id", "cluster_id")


# --- places ------------------------------------------------------------------------------------


def _dims(spark, d) -> dict[str, DataFrame]:
    """Nations as cities, regions as countries and their halves as regions; some have names in another language."""
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    cc = F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))
    place = n.select(k.cast("long").alias("geonameid"), (F.col("n_regionkey") * 10.0).alias("lat"), (k * 7.0).alias("lon"), F.when(k % 4 == 3, "PPLX").otherwise("PPLA").alias("fcode"), cc.alias("cc"), F.when(k % 5 != 4, (k % 2).cast("string")).alias("admin1"), F.col("n_name").alias("name_en"))
    regions = place.where("admin1 IS NOT NULL").select("cc", "admin1").distinct().select((F.crc32(F.concat("cc", F.lit("."), "admin1")) + 1000).alias("geonameid"), "cc", "admin1", F.concat(F.lit("Half "), "admin1", F.lit(" of "), "cc").alias("name_en"))
    lands = table(spark, d, "region").select((F.col("r_regionkey") + 100).cast("long").alias("geonameid"), F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("cc"), F.col("r_name").alias("name_en"))
    named = n.where(k % 3 == 0).select(k.cast("long").alias("geonameid"), F.lit("ru").alias("lang"), F.concat(F.lit("Город "), (k % 2).cast("string")).alias("name"))
    named = named.union(lands.where("geonameid % 2 = 0").select("geonameid", F.lit("ru"), F.concat(F.lit("Страна "), "cc")))
    return {"places": place, "names": named, "admin1": regions, "countries": lands}


_DIMS = "WITH n AS (SELECT n_nationkey AS g, 'R' || n_regionkey AS cc, CASE WHEN n_nationkey % 5 <> 4 THEN CAST(n_nationkey % 2 AS VARCHAR) END AS half, n_regionkey AS r, CASE WHEN n_nationkey % 3 = 0 THEN 'Город ' || (n_nationkey % 2) ELSE n_name END AS name FROM nation) "


@query(_DIMS + "SELECT CAST(g AS BIGINT) AS city_geonameid, CASE WHEN half IS NOT NULL THEN cc || '.' || half END AS region, CASE WHEN half IS NOT NULL THEN 'Half ' || half || ' of ' || cc END AS region_name, CASE WHEN (r + 100) % 2 = 0 THEN 'Страна ' || cc ELSE r_name END AS country_name FROM n JOIN region ON r_regionkey = r")
def city_lookups(spark, d):
    dims = _dims(spark, d)
    return nearest.about_cities(dims["places"].select(F.col("geonameid").alias("city_geonameid")), dims, "ru").select("city_geonameid", "region", "region_name", "country_name")


@query(_DIMS + "SELECT lower(name) AS folded, CAST(g AS BIGINT) AS geonameid FROM n WHERE g % 4 <> 3")
def city_homonyms(spark, d):
    return nearest.city_names(_dims(spark, d), "ru")


@query(_DIMS + "SELECT c_custkey AS id FROM customer JOIN n ON g = c_nationkey WHERE r = 2 AND ((g % 3 = 0 AND g % 2 = 0 AND g % 4 <> 3) OR c_custkey % 50 = 1)")
def where_localised(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    f = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("country"), F.when(F.col("c_custkey") % 50 == 1, "ГОРОД 0").otherwise("x").alias("city"), F.col("c_nationkey").cast("long").alias("city_geonameid"))
    dims = _dims(spark, d)
    known = where.Names(nearest.country_codes(dims, "ru"), nearest.city_names(dims, "ru"))
    return where.apply(f, ["country=страна r2", "city=Город 0"], known).select("id")


@query(_DIMS + "SELECT CAST(g AS BIGINT) AS geonameid, name, g % 3 = 0 AS name_exact FROM n")
def localised_names(spark, d):
    dims = _dims(spark, d)
    return nearest.localized(dims["places"].select("geonameid"), "geonameid", dims, "ru").select("geonameid", "name", "name_exact")


@query("WITH p AS (SELECT n_nationkey AS g, n_regionkey * 10.0 AS lat, n_nationkey * 7.0 AS lon, n_nationkey % 4 <> 3 AS city, 'R' || n_regionkey AS cc FROM nation), o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 41) * 1.0 + 0.25 END AS lat, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 167) * 1.0 + 0.25 END AS lon FROM orders), q AS (SELECT DISTINCT lat, lon FROM o WHERE lat IS NOT NULL), x AS (SELECT q.*, g, city, cc, sin(radians(q.lat)) * sin(radians(p.lat)) + cos(radians(q.lat)) * cos(radians(p.lat)) * cos(radians(q.lon - p.lon)) AS near FROM q, p), a AS (SELECT lat, lon, arg_max(g, near) AS g, arg_max(cc, near) AS cc, arg_max(g, near) FILTER (city) AS c FROM x GROUP BY ALL) SELECT id AS file_id, cc AS country, CAST(c AS BIGINT) AS city_geonameid, CAST(CASE WHEN a.g <> c THEN a.g END AS BIGINT) AS district_geonameid, CASE WHEN o.lat IS NULL THEN 'unknown' ELSE 'exact_gps' END AS confidence FROM o LEFT JOIN a ON a.lat = o.lat AND a.lon = o.lon")
def places_resolved(spark, d):
    k = F.col("o_orderkey")
    at = lambda m: F.when(k % 3 != 0, (k % m) * 1.0 + 0.25).cast("string")
    f = table(spark, d, "orders").select(k.alias("id"), F.lit(None).cast("timestamp_ntz").alias("taken_at"), F.lit(None).cast("string").alias("taken_at_confidence"), F.coalesce(at(41), F.lit("")).alias("gps_lat"), at(167).alias("gps_lon"), F.lit(None).cast("long").alias("dup_of"), F.lit(None).cast("string").alias("error"))
    return places.resolve_places(f, _dims(spark, d)["places"])


@query("SELECT n_nationkey AS file_id, CASE n_nationkey % 4 WHEN 0 THEN 'FR' WHEN 1 THEN 'IT' ELSE 'XX' END AS country, CASE n_nationkey % 4 WHEN 0 THEN 'Paris' WHEN 1 THEN 'Rome' END AS city, CASE WHEN n_nationkey % 4 < 2 THEN 'visual' WHEN n_nationkey % 4 = 2 THEN 'unknown' ELSE 'exact_gps' END AS confidence FROM nation")
def landmarks(spark, d):
    k = F.col("n_nationkey")
    n = table(spark, d, "nation")
    p = n.select(k.alias("file_id"), F.lit("XX").alias("country"), F.when(k % 4 == 3, "exact_gps").otherwise("unknown").alias("confidence"))
    z = lambda i: F.when(k % 4 == i, 0.9).otherwise(0.1)
    return places.landmarks(p, n.select(k.alias("file_id"), F.array(z(0), z(1), z(2)).alias("logits")), [("FR", "Paris"), ("IT", "Rome")]).select("file_id", "country", "city", "confidence")


# --- columns and small tables --------------------------------------------------------------------


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_acctbal END AS lat, cos(radians(s_suppkey % 80)) * cos(radians(s_suppkey % 170)) AS x, sin(radians(s_suppkey % 80)) AS z FROM supplier")
def coordinates(spark, d):
    k = F.col("s_suppkey")
    raw = F.when(k % 3 == 0, F.col("s_acctbal").cast("string")).when(k % 3 == 1, "").otherwise("north")
    xyz = geometry.unit_xyz((k % 80).cast("double"), (k % 170).cast("double"))
    return table(spark, d, "supplier").select("s_suppkey", geometry.coordinate(raw).alias("lat"), F.get(xyz, F.lit(0)).alias("x"), F.get(xyz, F.lit(2)).alias("z"))


@query("SELECT p_partkey, least(1.0, (p_size * 2.0 + 6.0) / 200.0) AS share FROM part")
def text_share(spark, d):
    size = F.col("p_size").cast("double")
    boxes = F.array(F.array(F.lit(0.0), size, F.lit(1.0), F.lit(3.0)), F.array(F.lit(5.0), F.lit(4.0), F.lit(0.0), F.lit(9.0)))
    corner = lambda x, y: F.array(F.lit(x), F.lit(y))
    polygons = F.array(F.array(corner(0.0, 0.0), corner(4.0, 0.0), corner(0.0, 3.0)), F.array(corner(1.0, 1.0), corner(2.0, 2.0)))
    return table(spark, d, "part").select("p_partkey", geometry.text_fraction(boxes, polygons, F.lit(20), F.lit(10)).alias("share"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'A B ' || p_partkey WHEN 2 THEN NULL ELSE repeat('x', 80) END AS name FROM part")
def generated_names(spark, d):
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit(' "'), F.col("p_name"), F.lit('."\nsecond line'))).when(k % 4 == 1, F.concat(F.lit("«A:  B/"), k.cast("string"), F.lit("»"))).when(k % 4 == 2, ' "" ').otherwise(F.repeat(F.lit("x"), 90))
    return table(spark, d, "part").select("p_partkey", text.sanitize_generated(raw).alias("name"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a/f' || p_partkey WHEN 1 THEN '/outer/f' || p_partkey ELSE '/out' END AS rel, 'file:///a%20b/' || p_partkey || '%23' AS uri FROM part")
def paths(spark, d):
    k = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 3
    dst = F.when(kind == 0, F.concat(F.lit("/out/a/f"), k)).when(kind == 1, F.concat(F.lit("/outer/f"), k)).otherwise("/out")
    return table(spark, d, "part").select("p_partkey", text.relative_to(dst, "/out/").alias("rel"), text.file_uri(F.concat(F.lit("/a b/"), k, F.lit("#"))).alias("uri"))


@query("WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 37 AS VARCHAR) ELSE 'n' || p_name END AS name FROM part) SELECT p_partkey, name, CAST(row_number() OVER (ORDER BY CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 37 END NULLS LAST, lower(name), p_partkey) AS BIGINT) AS place FROM n")
def tree_order(spark, d):
    k = F.col("p_partkey")
    n = table(spark, d, "part").select("p_partkey", F.when(k % 2 == 0, (k % 37).cast("string")).otherwise(F.concat(F.lit("n"), F.col("p_name"))).alias("name"))
    # The keys as columns: numbers come first, the rest has a number above all.
    keyed = n.withColumn("_number", F.coalesce(F.when(F.rlike("name", F.lit(r"^\d+$")), F.col("name").try_cast("long")), F.lit(1 << 62))).withColumn("_lower", F.lower("name"))
    return grouping.numbered(keyed, ["_number", "_lower", "p_partkey"], "place").select("p_partkey", "name", F.col("place").cast("long").alias("place"))


@query(_FILES + _CITY_RULES + ", t AS (SELECT split_part(rule, '|', 1) AS folder, split_part(rule, '|', 2) AS reason FROM q) SELECT reason, count(*) AS n, count(DISTINCT folder) AS folders FROM t GROUP BY reason")
def target_folders(spark, d):
    return reports.index_report(run.make_plan(_tables(spark, d), "city", "/out")).select("reason", "n", "folders")


@query(_FILES + "SELECT id, '{\"id\":' || id || ',\"path\":\"' || path || '\",\"target\":\"/t\",\"reason\":\"r\",\"geo\":\"' || country || CASE WHEN city IS NULL THEN '' ELSE '/' || city END || '\"}' AS json FROM b")
def plan_json(spark, d):
    p = _files(spark, d).withColumn("target", F.lit("/t")).withColumn("reason", F.lit("r"))
    return reports.as_json(p).select(F.get_json_object("json", "$.id").cast("long").alias("id"), "json")


@query(_FILES + "SELECT id, strftime(taken_at, '%Y-%m-%d') || CASE WHEN low THEN ' (uncertain)' ELSE '' END AS day, country || CASE WHEN city IS NULL THEN ' (unknown)' ELSE '/' || city || ' (exact_gps)' END || CASE WHEN k % 2 = 0 THEN ' · ' || format('{:.4f}', k % 90 + 0.5) || ', 2.0000' ELSE '' END AS geo, CASE k % 3 WHEN 0 THEN 'Ann, Bob' WHEN 1 THEN 'Cy' ELSE '' END || CASE WHEN k % 3 < 2 AND k % 4 = 0 THEN ' · ' ELSE '' END || CASE WHEN k % 4 = 0 THEN 'Trip ' || (k % 6) ELSE '' END AS people, 'document · ' || verdict || ' · to duplicates' AS category FROM b")
def report_cells(spark, d):
    k = F.col("id")
    lat, lon = F.when(k % 2 == 0, (k % 90) + 0.5), F.lit(2.0)
    return _files(spark, d).select(
        "id", reports.date_cell(F.col("taken_at"), F.col("taken_at_confidence")).alias("day"), reports.geo_cell(F.col("country"), F.col("city"), lat, lon, F.col("place_confidence")).alias("geo"),
        reports.people_event_cell(F.col("persons"), F.col("event")).alias("people"), reports.category_cell(F.lit("document"), F.col("junk_verdict"), F.lit("moved")).alias("category"),
    )


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'unreadable' END AS error, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'F' THEN 'document' ELSE 'photo' END AS verdict FROM orders UNION ALL SELECT -c_custkey, 'new', 'photo' FROM customer")
def guarded_and_failed(spark, d):
    k = F.col("o_orderkey")
    old = table(spark, d, "orders").select(k.alias("id"), k.cast("string").alias("path"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("indexed_at"), F.lit("photo").alias("media_type"), F.lit("photo").alias("verdict"), F.col("o_orderstatus").alias("status"))
    failed = old.where("id % 5 = 0").select("id", "path", F.lit("unreadable").alias("error"), F.lit("now").alias("indexed_at"))
    new = table(spark, d, "customer").select((-F.col("c_custkey")).alias("id"), F.concat(F.lit("new"), F.col("c_custkey").cast("string")).alias("path"), F.lit("new").alias("error"), F.lit("now").alias("indexed_at"))
    both = tables.upsert_errors(old, failed.unionByName(new))
    sure = (F.col("id") % 3 == 0) & (F.col("status") == "F")
    return tables.guarded_update(both, sure, {"verdict": F.lit("document")}).select("id", "error", F.coalesce("verdict", F.lit("photo")).alias("verdict"))


@query("SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 3 = 0 THEN 'to_delete' ELSE 'keep' END AS action FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0")
def choices(spark, d):
    k, o = F.col("o_orderkey"), table(spark, d, "orders")
    row = lambda df, action: df.select(k.alias("file_id"), action.alias("action"), F.lit("").alias("updated_at"))
    picked = row(o.where("o_orderkey % 3 = 0"), F.lit("to_delete")).union(row(o.where("o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0"), F.lit(None).cast("string")))
    return reports.set_choices(row(o.where("o_orderkey % 2 = 0"), F.lit("keep")), picked).select("file_id", "action")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS path, CASE WHEN s_suppkey % 2 = 0 THEN '2020:01:01 00:00:00' END AS date_original, -(10 + 30 / 60.0 + (s_suppkey % 60) / 3600.0) AS gps_lat, CASE WHEN s_suppkey % 3 = 0 THEN 7.5 END AS gps_lon, 640 AS width FROM supplier")
def exif_records(spark, d):
    k = F.col("s_suppkey")
    record = F.struct(
        k.cast("string").alias("SourceFile"), F.lit("").alias("DateTimeOriginal"), F.when(k % 2 == 0, "2020:01:01 00:00:00").otherwise("").alias("CreateDate"), F.concat(F.lit("10 deg 30' "), (k % 60).cast("string"), F.lit('.00" S')).alias("GPSLatitude"),
        F.when(k % 3 == 0, "7.5").when(k % 3 == 1, "").otherwise("east").alias("GPSLongitude"), F.lit("640").alias("ImageWidth"),
    )
    rows = table(spark, d, "supplier").select(F.to_json(F.array(record)).alias("value"))
    return source.exif_records(rows).select("path", "date_original", "gps_lat", "gps_lon", "width")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y') END AS year FROM orders")
def years(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", dates.year_of(F.col("o_orderdate"), F.when(k % 4 == 0, "low").otherwise("high")).alias("year"))


@query("WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS x FROM customer) SELECT id, CAST(row_number() OVER (ORDER BY x DESC NULLS LAST, id) AS BIGINT) AS place FROM r")
def falling_with_empty_last(spark, d):
    r = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("x"))
    ordered = r.withColumn("_empty", F.col("x").isNull()).withColumn("_x", -F.col("x"))
    return grouping.numbered(ordered, ["_empty", "_x", "id"], "place").select("id", F.col("place").cast("long").alias("place"))
