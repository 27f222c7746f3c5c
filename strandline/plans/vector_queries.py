"""Queries of vectors: joins, search, dedup, macro insights, prototypes; and of nested views, stores and streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import constants as K
from strandline.functions.lineage import work_path
from strandline.operators import assessment, chunking, clusters, extraction, lists, replies, search, similarity, upsert, views
from strandline.plans.catalog_queries import RESOLVED, q
from strandline.plans.inputs import load, oracle
from strandline.plans.registry import query
from strandline.plans.text_queries import CHUNKS
from strandline.sources import objects
from strandline.streaming.status import current_states, discover_batches, discovered as discovered_state, index_batches, indexed, latest_status, status_batches

COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
UNIT = "[x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) FOR x IN CAST(embedding AS DOUBLE[])]"
r6 = lambda c: F.round(c, 6)

q("J9_cosine_join", f"SELECT a.id AS a, b.id AS b, round({COS}, 6) AS similarity FROM vectors a JOIN vectors b ON a.id < b.id WHERE {COS} >= 0.3", "vectors")(
    lambda v: similarity.similarity_edges(v, 0.3).select("a", "b", r6("similarity").alias("similarity")))
q("A12_centroid", f"""WITH u AS (SELECT label, unnest({UNIT}) AS x, generate_subscripts(embedding, 1) AS i FROM vectors), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL)
    SELECT label, CAST(i AS INT) AS place, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m""", "vectors")(
    lambda v: similarity.centroids(v, "label").select("label", F.posexplode("centroid").alias("p", "x")).select("label", (F.col("p") + 1).alias("place"), r6("x").alias("x")))


def as_chunks(v: DataFrame) -> DataFrame:
    return v.select(F.format_string("c%05d", "id").alias("chunk_id"), F.when(F.col("id") % 2 == 0, "podcast").otherwise("document").alias("kind"), F.concat(F.lit("s"), F.col("label").cast("string")).alias("source"), "embedding", F.col("id").alias("n"))


CHUNK_SQL = "c AS (SELECT printf('c%05d', id) AS chunk_id, CASE WHEN id % 2 = 0 THEN 'podcast' ELSE 'document' END AS kind, 's' || CAST(label AS STRING) AS source, embedding, id FROM vectors)"
TOP = f"""WITH {CHUNK_SQL}, s AS (SELECT a.id AS query_id, b.chunk_id, b.kind, b.source, {COS} AS score, a.source AS wanted FROM c a JOIN c b ON a.id % 25 = 0 %s),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, kind, source, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM t WHERE rank <= 3 %s"""
TOP = TOP.replace("% 25", "%% 25").replace("% 2 ", "%% 2 ").replace("%05d", "%%05d")


def retrieved(v: DataFrame, by_source: bool = False) -> DataFrame:
    c = as_chunks(v)
    found = search.search_many(c.filter("n % 25 = 0").select(F.col("n").alias("query_id"), "embedding", "source"), c, 3, by_source)
    return found.select("query_id", "chunk_id", "kind", "source", r6("score").alias("score"), "rank")


q("V1_search_chunks", f"WITH {CHUNK_SQL} SELECT b.chunk_id, round({COS}, 6) AS score FROM (SELECT * FROM c WHERE id = 3) a, c b WHERE b.source = 's4' ORDER BY {COS} DESC, b.kind DESC, b.chunk_id LIMIT 3", "vectors")(
    lambda v: search.search_one(as_chunks(v), v.filter("id = 3").head().embedding, 3, "s4").select("chunk_id", r6("score").alias("score")))
q("V2_search_all", TOP % ("", ""), "vectors")(retrieved)


def from_lists(v: DataFrame) -> DataFrame:
    """A stored index of lists, to which the last third of the chunks is added later."""
    c = as_chunks(v)
    index = lists.add_chunks(lists.build_lists(c.filter("n % 3 < 2"), work_path(v.sparkSession, "lists")), c.filter("n % 3 = 2"))
    found = lists.search_lists(c.filter("n % 25 = 0").select(F.col("n").alias("query_id"), "embedding"), index, 3)
    return found.select("query_id", "chunk_id", "kind", "source", r6("score").alias("score"), "rank")


q("V2_lists", TOP % ("", ""), "vectors")(from_lists)
q("V3_batch_retrieve", TOP % ("AND a.source = b.source", ""), "vectors")(lambda v: retrieved(v, True))
q("V4_min_similarity", TOP % ("", "AND score >= 0.3"), "vectors")(lambda v: search.near_enough(retrieved(v), 0.3))
q("W2_top_k_per_query", TOP % ("AND b.kind = 'podcast'", ""), "vectors")(lambda v: search.search_many(as_chunks(v).filter("n % 25 = 0").select(F.col("n").alias("query_id"), "embedding"), as_chunks(v).filter("kind = 'podcast'")).select("query_id", "chunk_id", "kind", "source", r6("score").alias("score"), "rank"))
q("O3_top_k_similarity", f"SELECT b.id, round({COS}, 6) AS score FROM (SELECT * FROM vectors WHERE id = 7) a, vectors b ORDER BY {COS} DESC, b.id LIMIT 10", "vectors")(
    lambda v: search.search_one(as_chunks(v).withColumn("kind", F.lit("podcast")), v.filter("id = 7").head().embedding, 10).select(F.col("n").alias("id"), r6("score").alias("score")))

HINTED = "CASE type " + " ".join(f"WHEN '{t}' THEN ' ' || '{K.DIMENSION_HINTS[d]}'" for t, d in (("trend", "adoption"), ("health_stake", "urgency"))) + " ELSE '' END"
q("V5_query_text", f"SELECT id, CASE WHEN coalesce(description, '') <> '' THEN name || '. ' || description ELSE name END || {HINTED} AS query_text FROM units", "units")(
    lambda u: u.select("id", search.query_text(dimension=F.when(F.col("type") == "trend", "adoption").when(F.col("type") == "health_stake", "urgency").otherwise("none")).alias("query_text")))
LETTERS = "abcdefghilmnoprstuy"


def letter_embedder():
    """Counts of letters, which SQL can write too."""
    return lambda texts: [[float(t.count(c)) for c in LETTERS] for t in texts]


def letter_sql(text: str) -> str:
    return f"[CAST(length({text}) - length(replace({text}, c, '')) AS DOUBLE) FOR c IN {list(LETTERS)}]"


UNIT_LETTERS = "[CAST(x / greatest(sqrt(list_dot_product(v, v)), 1e-300) AS FLOAT) FOR x IN v]"


def embedded(named: DataFrame) -> DataFrame:
    """name and error of each text, and its vector's values by place; one row for a text that has none."""
    got = search.embed(named, letter_embedder)
    return got.select("name", "error", F.posexplode_outer("embedding").alias("place", "x")).select("name", "error", F.col("place").cast("long").alias("place"), F.round(F.col("x").cast("double"), 4).alias("x"))


def embedded_sql(named: str) -> str:
    """Values are kept in four decimals, as vectors are stored in single precision."""
    blank = r"(NOT regexp_matches(t, '\S') OR t IS NULL)"
    return f"""WITH n AS ({named}), v AS (SELECT name, {blank} AS blank, CASE WHEN {blank} THEN [NULL] ELSE {letter_sql('t')} END AS v FROM n)
    SELECT name, CASE WHEN blank THEN 'blank text' END AS error, CASE WHEN NOT blank THEN CAST(i - 1 AS BIGINT) END AS place, round(CAST(x AS DOUBLE), 4) AS x FROM (SELECT name, blank, unnest(CASE WHEN blank THEN [NULL] ELSE {UNIT_LETTERS} END) AS x, unnest(range(1, len(v) + 1)) AS i FROM v)"""


q("V0_embed", embedded_sql("SELECT doc_id AS name, text AS t FROM texts"), "texts")(lambda d: embedded(d.select(F.col("doc_id").alias("name"), "text")))
q("V6_jaccard_dedup", f"""WITH RECURSIVE e AS (SELECT dimension_id // 10 AS g, id, list_distinct([x FOR x IN regexp_split_to_array(lower(trim(chunk_text)), '\\s+') IF x <> '']) AS ws, row_number() OVER (PARTITION BY dimension_id // 10 ORDER BY id) AS r, count(*) OVER (PARTITION BY dimension_id // 10) AS n FROM evidence),
    k AS (SELECT g, r, n, [id] AS kept, [ws] AS sets FROM e WHERE r = 1 UNION ALL SELECT g, r2, n, CASE WHEN near THEN kept ELSE list_append(kept, id) END, CASE WHEN near THEN sets ELSE list_append(sets, ws) END
    FROM (SELECT k.*, e.id, e.ws, e.r AS r2, len([s FOR s IN sets IF len(list_intersect(s, e.ws)) >= {K.CHUNK_OVERLAP_LIMIT} * (len(s) + len(e.ws) - len(list_intersect(s, e.ws)))]) > 0 AS near FROM k JOIN e ON e.g = k.g AND e.r = k.r + 1) k)
    SELECT g, array_to_string(kept, ',') AS kept FROM k WHERE r = n""", "evidence")(
    lambda e: e.withColumn("g", F.expr("dimension_id div 10")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("id", F.col("chunk_text").alias("text")))).alias("c"))
    .select("g", F.array_join(F.transform(search.drop_overlaps("c"), lambda x: x["id"].cast("string")), ",").alias("kept")))

PARTS = lambda e: e.select("dimension_id", F.struct(
    "id", F.trim("source_ref").alias("source"), F.col("chunk_text").alias("text"), F.lit(None).cast("string").alias("speaker"), "page", F.col("start_time").alias("start"), (F.col("start_time") + 1).alias("end"), F.lit("Intro").alias("section"), F.col("similarity_score").alias("score")).alias("c"))
q("V7_format_context", """SELECT dimension_id, left(string_agg('[' || trim(source_ref) || CASE WHEN page IS NOT NULL THEN ' | Page ' || CAST(page AS STRING) ELSE '' END || ' | ' || CASE WHEN start_time IS NOT NULL THEN printf('%.1f', start_time) || '–' || printf('%.1f', start_time + 1) ELSE 'Intro' END || ']' || chr(10) || trim(chunk_text), chr(10) || chr(10) ORDER BY id), 200000) AS text,
    array_to_string(list_sort(list(DISTINCT trim(source_ref))), '|') AS sources FROM evidence GROUP BY 1""", "evidence")(
    lambda e: PARTS(e).groupBy("dimension_id").agg(search.format_context(F.array_sort(F.collect_list("c"))).alias("x")).select("dimension_id", F.col("x.text").alias("text"), F.array_join("x.sources", "|").alias("sources")))
q("V8_persist_evidence", """SELECT dimension_id, row_number() OVER (PARTITION BY dimension_id ORDER BY id) - 1 AS place, chunk_text, similarity_score, trim(source_ref) AS source_ref, CASE WHEN page IS NULL THEN 0 ELSE 1 END + CASE WHEN start_time IS NULL THEN 0 ELSE 2 END + 1 AS n_metadata FROM evidence""", "evidence")(
    lambda e: search.evidence_rows(PARTS(e).groupBy("dimension_id").agg(F.array_sort(F.collect_list("c")).alias("chunks"))).select("dimension_id", F.col("place").cast("long").alias("place"), "chunk_text", "similarity_score", "source_ref", F.size("chunk_metadata").cast("long").alias("n_metadata")))

ROWS = lambda v: v.filter("id % 5 <> 0")
MACROS = lambda v: v.filter("id % 5 = 0").select("id", F.col("embedding").alias("centroid_embedding"))
MATCHED = f"""m AS (SELECT id, macro_id, similarity FROM (SELECT a.id, b.id AS macro_id, {COS} AS similarity, row_number() OVER (PARTITION BY a.id ORDER BY {COS} DESC, b.id) AS r FROM vectors a JOIN vectors b ON a.id % 5 <> 0 AND b.id % 5 = 0 WHERE {COS} >= 0.25) WHERE r = 1)"""
q("M1_match_to_macros", f"WITH {MATCHED} SELECT id, macro_id, round(similarity, 6) AS similarity FROM m", "vectors")(lambda v: similarity.match_to_macros(ROWS(v), MACROS(v), 0.25).select("id", "macro_id", r6("similarity").alias("similarity")))
q("W3_argmax_first_wins", f"SELECT id, best FROM (SELECT a.id, b.id AS best, row_number() OVER (PARTITION BY a.id ORDER BY round({COS}, 9) DESC, b.id) AS r FROM vectors a JOIN vectors b ON b.id < 20 WHERE {COS} > 0) WHERE r = 1", "vectors")(
    lambda v: similarity.match_to_macros(v, v.filter("id < 20").select("id", F.col("embedding").alias("centroid_embedding")), 0.0).select("id", F.col("macro_id").alias("best")))
q("M3_update_centroids", f"""WITH {MATCHED}, e AS (SELECT macro_id, unnest({UNIT}) AS x, generate_subscripts(embedding, 1) AS i FROM m JOIN vectors USING (id)), c AS (SELECT macro_id, i, avg(x) AS x FROM e GROUP BY ALL)
    SELECT macro_id, CAST(i AS INT) AS place, round(x / sqrt(sum(x * x) OVER (PARTITION BY macro_id)), 6) AS x FROM c""", "vectors")(
    lambda v: similarity.centroids(ROWS(v).join(similarity.match_to_macros(ROWS(v), MACROS(v), 0.25), "id"), "macro_id").select("macro_id", F.posexplode("centroid").alias("p", "x")).select("macro_id", (F.col("p") + 1).alias("place"), r6("x").alias("x")))
q("M5_apply_updates", f"WITH {MATCHED} SELECT v.id, m.macro_id FROM vectors v LEFT JOIN m USING (id)", "vectors")(
    lambda v: upsert.assign_back(v.select("id", F.lit(None).cast("long").alias("macro_id")), similarity.match_to_macros(ROWS(v), MACROS(v), 0.25).select("id", F.col("macro_id").alias("value")), "macro_id"))


def greedy_sql(rows: str, threshold: float, name: str, least: int = 2) -> str:
    """CTEs of ordered greedy clusters of a table (id, embedding): {name} has node and leader. led holds the leader's place of each place, and each step decides one."""
    return f"""{name}_v AS (SELECT id, embedding, row_number() OVER (ORDER BY id) AS p FROM {rows}),
    {name}_e AS MATERIALIZED (SELECT a.p, list(b.p) AS near FROM {name}_v a JOIN {name}_v b ON a.p <> b.p WHERE {COS} >= {threshold} GROUP BY 1),
    {name}_g AS (SELECT 0::BIGINT AS p, [0::BIGINT FOR x IN range((SELECT count(*) FROM {name}_v))] AS led UNION ALL
        SELECT g.p + 1, CASE WHEN led[g.p + 1] = 0 AND len([x FOR x IN near IF led[x] = 0]) >= {least - 1} THEN [CASE WHEN led[x] = 0 AND (x = g.p + 1 OR list_contains(near, x)) THEN g.p + 1 ELSE led[x] END FOR x IN range(1, len(led) + 1)] ELSE led END
        FROM {name}_g g LEFT JOIN {name}_e e ON e.p = g.p + 1 WHERE g.p < len(led)),
    {name} AS (SELECT v.id AS node, w.id AS leader FROM (SELECT unnest(led) AS l, generate_subscripts(led, 1) AS p FROM {name}_g WHERE p = len(led)) x JOIN {name}_v v ON v.p = x.p LEFT JOIN {name}_v w ON w.p = x.l)"""


q("M2_greedy_clusters", f"WITH RECURSIVE {greedy_sql('vectors', 0.3, 'c')} SELECT node, leader FROM c", "vectors")(lambda v: similarity.greedy_clusters(v, 0.3))
q("M2_min_size", f"""WITH RECURSIVE {greedy_sql('vectors', 0.3, 'c', 3)}, {greedy_sql('vectors', 0.3, 'd', 5)} SELECT 3 AS least, node, leader FROM c UNION ALL SELECT 5, node, leader FROM d""", "vectors")(
    lambda v: similarity.greedy_clusters(v, 0.3, least=3).select(F.lit(3).alias("least"), "node", "leader").unionByName(similarity.greedy_clusters(v, 0.3, least=5).select(F.lit(5).alias("least"), "node", "leader")))


def discovery(v: DataFrame):
    """A step of discovery over named vectors, of which every 25th is a macro with itself as its member."""
    v = v.withColumn("name", F.concat(F.lit("Insight "), F.col("id").cast("string")))
    units, macros = v.filter("id % 25 <> 0").select("id", "name", "embedding"), v.filter("id % 25 = 0").select("id", "name", F.col("embedding").cast("array<double>").alias("centroid_embedding"))
    held = v.filter("id % 25 = 0").select("id", F.col("id").alias("macro_id"), "embedding")
    return units, macros, similarity.discover_macros(units, macros, held, 0.32)


def discovered(v: DataFrame) -> DataFrame:
    _, _, (assigned, _, new) = discovery(v)
    return assigned.join(new.select("leader", "name"), "leader", "left").select("id", "macro_id", "leader", "name")


def applied(v: DataFrame) -> DataFrame:
    """Units with their macro and its name, after new macros got ids and rows; and macros with the number of values of their centroid."""
    units, macros, (assigned, moved, new) = discovery(v)
    units, macros = upsert.apply_discovery(units.withColumn("macro_id", F.lit(None).cast("long")), macros, assigned, moved, new)
    linked = units.join(macros.select(F.col("id").alias("macro_id"), F.col("name").alias("macro_name")), "macro_id", "left")
    return linked.select(F.lit("unit").alias("kind"), "id", "macro_id", "macro_name").unionByName(macros.select(F.lit("macro").alias("kind"), "id", F.size("centroid_embedding").cast("long").alias("macro_id"), F.col("name").alias("macro_name")))


DISCOVERED = f"""m AS (SELECT id, macro_id FROM (SELECT a.id, b.id AS macro_id, row_number() OVER (PARTITION BY a.id ORDER BY {COS} DESC, b.id) AS r FROM vectors a JOIN vectors b ON a.id % 25 <> 0 AND b.id % 25 = 0 WHERE {COS} >= 0.32) WHERE r = 1),
    rest AS (SELECT id, embedding FROM vectors WHERE id % 25 <> 0 AND id NOT IN (SELECT id FROM m)), {greedy_sql('rest', 0.32, 'c')},
    d AS (SELECT id, macro_id, NULL::BIGINT AS leader, NULL::VARCHAR AS name FROM m UNION ALL SELECT node, NULL, leader, (SELECT min_by('Insight ' || CAST(x.node AS VARCHAR), x.node) FROM c x WHERE x.leader = c.leader) FROM c)"""
q("M4_discover_macros", f"WITH RECURSIVE {DISCOVERED} SELECT id, macro_id, leader, name FROM d", "vectors")(discovered)
q("M5_create_macros", f"""WITH RECURSIVE {DISCOVERED}, n AS (SELECT leader, any_value(name) AS name, (SELECT max(id) FROM vectors WHERE id % 25 = 0) + row_number() OVER (ORDER BY leader) AS id FROM d WHERE leader IS NOT NULL GROUP BY 1),
    x AS (SELECT id, 'Insight ' || CAST(id AS VARCHAR) AS name FROM vectors WHERE id % 25 = 0 UNION ALL SELECT id, name FROM n)
    SELECT 'unit' AS kind, d.id, coalesce(d.macro_id, n.id) AS macro_id, x.name AS macro_name FROM d LEFT JOIN n USING (leader) LEFT JOIN x ON x.id = coalesce(d.macro_id, n.id) UNION ALL SELECT 'macro', id, (SELECT max(len(embedding)) FROM vectors), name FROM x""", "vectors")(applied)
q("D1_dedup_within", f"""WITH RECURSIVE e AS (SELECT id // 25 AS g, id, embedding, row_number() OVER (PARTITION BY id // 25 ORDER BY id) AS r, count(*) OVER (PARTITION BY id // 25) AS n FROM vectors),
    k AS (SELECT g, r, n, [id] AS kept, [embedding] AS held FROM e WHERE r = 1 UNION ALL SELECT k.g, b.r, k.n, CASE WHEN near THEN kept ELSE list_append(kept, b.id) END, CASE WHEN near THEN held ELSE list_append(held, b.embedding) END
    FROM (SELECT k.*, len([h FOR h IN held IF list_cosine_similarity(CAST(h AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.25]) > 0 AS near FROM k JOIN e b ON b.g = k.g AND b.r = k.r + 1) k JOIN e b ON b.g = k.g AND b.r = k.r + 1)
    SELECT g, unnest(kept) AS id FROM k WHERE r = n""", "vectors")(lambda v: similarity.dedup_within(v.withColumn("g", F.floor(F.col("id") / 25)), "g", "id", threshold=0.25).select("g", "id"))
q("D2_dedup_across", f"""WITH RECURSIVE v AS (SELECT id, embedding, row_number() OVER (ORDER BY id) AS p FROM vectors), n AS MATERIALIZED (SELECT b.p, list(a.id ORDER BY {COS} DESC, a.id // 20, a.id) AS near FROM v a JOIN v b ON a.id // 20 < b.id // 20 WHERE {COS} >= 0.3 GROUP BY 1),
    k AS (SELECT 0::BIGINT AS p, []::BIGINT[] AS kept, NULL::BIGINT AS node, NULL::BIGINT AS target UNION ALL
        SELECT v.p, CASE WHEN best IS NULL THEN list_append(kept, v.id) ELSE kept END, v.id, coalesce(best, v.id)
        FROM (SELECT k.p, k.kept, [x FOR x IN coalesce(n.near, []) IF list_contains(k.kept, x)][1] AS best FROM k LEFT JOIN n ON n.p = k.p + 1) k JOIN v ON v.p = k.p + 1)
    SELECT node, target FROM k WHERE p > 0""", "vectors")(lambda v: similarity.dedup_across(v.withColumn("source_order", F.floor(F.col("id") / 20)), threshold=0.3))
q("D3_merge_sources", """SELECT node, string_agg(kind || CAST(sid AS STRING), ',' ORDER BY first) AS additional FROM (SELECT id % 20 AS node, CASE WHEN label % 2 = 0 THEN 'p' ELSE 'd' END AS kind, label % 7 AS sid, min(id) AS first FROM vectors WHERE id >= 20 GROUP BY ALL) t
    WHERE NOT EXISTS (SELECT 1 FROM vectors o WHERE o.id = t.node AND (CASE WHEN o.label % 2 = 0 THEN 'p' ELSE 'd' END) = t.kind AND o.label % 7 = t.sid) GROUP BY 1""", "vectors")(
    lambda v: similarity.merge_sources(v.select(F.col("id").alias("node"), F.when(F.col("id") < 20, F.col("id")).otherwise(F.col("id") % 20).alias("target")), v.select(F.col("id").alias("node"), F.when(F.col("label") % 2 == 0, "p").otherwise("d").alias("kind"), (F.col("label") % 7).alias("id")))
    .filter(F.size("additional") > 0).select("node", F.array_join(F.transform("additional", lambda x: F.concat(x["kind"], x["id"].cast("string"))), ",").alias("additional")))

NAMED = "SELECT id, label, 'P' || CAST(label AS STRING) AS name, embedding FROM vectors WHERE id IN (SELECT min(id) FROM vectors GROUP BY label)"
K1 = f"""p AS ({NAMED}), k AS (SELECT id, CASE WHEN score >= %s THEN name ELSE 'Other' END AS cluster_name, score, score < %s AS is_other FROM (SELECT a.id, b.name, {COS} AS score, row_number() OVER (PARTITION BY a.id ORDER BY {COS} DESC, b.label) AS r FROM vectors a, p b) WHERE r = 1)"""


def prototypes(v: DataFrame) -> list:
    return clusters.prototype_list(v.groupBy("label").agg(F.min_by("embedding", "id").alias("embedding")).select(F.concat(F.lit("P"), F.col("label").cast("string")).alias("name"), "embedding", F.col("label").alias("place")))


def old_clusters(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with a cluster for two thirds, and the table of clusters, the last of which is Other."""
    items = v.withColumn("cluster_id", F.when(F.col("id") % 3 != 0, F.col("id") % 11))
    names = v.filter("id < 11").select("id", F.when(F.col("id") == 10, K.OTHER).otherwise(F.concat(F.lit("P"), F.col("id").cast("string"))).alias("name"))
    return items, names


q("K1_assign_clusters", "WITH " + K1.replace("%s", "0.3") + " SELECT id, cluster_name, round(score, 6) AS score, is_other FROM k", "vectors")(lambda v: clusters.assign_clusters(v, prototypes(v), 0.3).select("id", "cluster_name", r6("score").alias("score"), "is_other"))
q("K2_assign_unassigned", "WITH " + K1.replace("%s", "0.25") + " SELECT id, cluster_name FROM k WHERE id % 3 = 0", "vectors")(lambda v: clusters.assign_unassigned(old_clusters(v)[0], prototypes(v), 0.25).select("id", "cluster_name"))
q("K3_change_tracking", "WITH " + K1.replace("%s", "0.2") + """, o AS (SELECT id, CASE WHEN id % 3 <> 0 THEN CASE WHEN id % 11 = 10 THEN 'Other' ELSE 'P' || CAST(id % 11 AS STRING) END END AS old_name FROM vectors)
    SELECT id, cluster_name, old_name, old_name IS NULL AS is_new, old_name IS DISTINCT FROM cluster_name AS is_changed FROM k JOIN o USING (id)""", "vectors")(
    lambda v: clusters.assign_with_changes(*old_clusters(v), prototypes(v), 0.2).select("id", "cluster_name", "old_name", "is_new", "is_changed"))
q("K4_reassign_other", "WITH " + K1.replace("%s", "0.1") + " SELECT id, cluster_name FROM k WHERE id % 3 <> 0 AND id % 11 = 10", "vectors")(lambda v: clusters.reassign_other(*old_clusters(v), prototypes(v), 0.1).select("id", "cluster_name"))
q("K5_assign_orphans", "WITH " + K1.replace("%s", "0.25") + " SELECT id, cluster_name FROM k WHERE id % 4 <> 1", "vectors")(
    lambda v: clusters.assign_orphans(v.withColumn("macro_insight_id", F.when(F.col("id") % 4 == 1, F.col("id"))), prototypes(v), 0.25).select("id", "cluster_name"))
q("K6_prototype_vectors", embedded_sql("SELECT lang AS name, arg_min(text, doc_id) AS t FROM texts GROUP BY 1"), "texts")(lambda d: embedded(d.groupBy(F.col("lang").alias("name")).agg(F.min_by("text", "doc_id").alias("text"))))
q("K1_A2_cluster_sizes", "WITH " + K1.replace("%s", "0.35") + ", n AS (SELECT name FROM p UNION ALL SELECT 'Other') SELECT name, (SELECT count(*) FROM k WHERE cluster_name = n.name) AS insights FROM n", "vectors")(
    lambda v: (lambda p: v.sparkSession.createDataFrame([(n,) for n, _ in p] + [(K.OTHER,)], "name string").join(clusters.assign_clusters(v, p, 0.35).groupBy("cluster_name").agg(F.count("*").alias("n")), F.col("name") == F.col("cluster_name"), "left").select("name", F.coalesce("n", F.lit(0)).alias("insights")))(prototypes(v)))

q("J6_unit_insight_detail", f"""SELECT u.id, count(DISTINCT d.id) AS n_dimensions, count(v.id) AS n_evidence, count(v.source_id) AS n_resolved, coalesce(sum(length(CASE WHEN v.source_kind = 'podcast' AND position(chr(10) || chr(10) IN chunk_text) > 0 THEN substr(chunk_text, position(chr(10) || chr(10) IN chunk_text) + 2) ELSE chunk_text END)), 0) AS shown_chars
    FROM units u LEFT JOIN dimensions d ON d.unit_insight_id = u.id LEFT JOIN {RESOLVED} v ON v.dimension_id = d.id GROUP BY 1""", "units", "dimensions", "evidence", "episodes", "sources")(
    lambda *t: (lambda e: views.unit_insight_detail(*t).select("id", F.size("dimensions").cast("long").alias("n_dimensions"), F.flatten(F.transform("dimensions", lambda x: x["evidence"])).alias("e")).select("id", "n_dimensions", F.size("e").cast("long").alias("n_evidence"), F.size(F.filter("e", lambda x: x["source_id"].isNotNull())).cast("long").alias("n_resolved"), e.alias("shown_chars")))(
        F.aggregate("e", F.lit(0).cast("long"), lambda s, x: s + F.length(x["display_text"]))))
q("J7_hierarchy", """SELECT 'cluster' AS level, c.id, c.name, (SELECT count(*) FROM macros WHERE cluster_id = c.id) AS n_macros, (SELECT count(*) FROM units u JOIN macros m ON u.macro_insight_id = m.id WHERE m.cluster_id = c.id) AS n_units, (SELECT count(*) FROM units WHERE cluster_id = c.id AND macro_insight_id IS NULL) AS n_orphans FROM clusters c
    UNION ALL SELECT 'unassigned_macro', id, name, 1, (SELECT count(*) FROM units WHERE macro_insight_id = m.id), 0 FROM macros m WHERE cluster_id IS NULL UNION ALL SELECT 'unassigned_unit', id, name, 0, 0, 1 FROM units WHERE cluster_id IS NULL AND macro_insight_id IS NULL""", "clusters", "macros", "units")(
    lambda *t: views.hierarchy(*t).select("level", "id", "name", F.size("macros").cast("long").alias("n_macros"), F.aggregate("macros", F.lit(0).cast("long"), lambda s, m: s + F.size(m["units"])).alias("n_units"), F.size("orphans").cast("long").alias("n_orphans")))
q("J7_parts", """WITH m AS (SELECT c.id, c.name, x.macro_id, x.unit_id, row_number() OVER (PARTITION BY c.id ORDER BY x.macro_id IS NULL, x.macro_id, x.unit_id NULLS FIRST) AS place FROM clusters c JOIN
        (SELECT m.cluster_id, m.id AS macro_id, u.id AS unit_id FROM macros m LEFT JOIN units u ON u.macro_insight_id = m.id UNION ALL SELECT cluster_id, NULL, id FROM units WHERE macro_insight_id IS NULL) x ON x.cluster_id = c.id),
    t AS (SELECT id, count(*) AS total FROM m GROUP BY 1)
    SELECT c.id, c.name, CAST(coalesce((place - 1) // 7, 0) AS BIGINT) AS part, CAST(greatest(1, ceil(coalesce(total, 0) / 7.0)) AS BIGINT) AS parts, coalesce(any_value(total), 0) AS total, coalesce(string_agg(coalesce(CAST(macro_id AS VARCHAR), '') || ':' || coalesce(CAST(unit_id AS VARCHAR), ''), ',' ORDER BY place), '') AS members
    FROM clusters c LEFT JOIN m ON m.id = c.id LEFT JOIN t ON t.id = c.id GROUP BY ALL""", "clusters", "macros", "units")(
    lambda *t: views.hierarchy_parts(*t, part_rows=7).withColumn("members", F.array_join(F.transform("members", lambda x: F.concat(F.coalesce(x["macro_id"].cast("string"), F.lit("")), F.lit(":"), F.coalesce(x["unit_id"].cast("string"), F.lit("")))), ",")))
PIVOT = ", ".join(f"(SELECT arg_max(value, id) FROM dimensions d WHERE d.unit_insight_id = u.id AND dimension_type = '{t}') AS {t}" for t in views.TREND)
q("A11_dimension_pivot", f"SELECT u.id, {PIVOT}, CASE WHEN episode_id IS NOT NULL THEN 'podcast' WHEN document_id IS NOT NULL THEN 'document' ELSE 'unknown' END AS source_type, id % 3 = 0 AS is_new FROM units u WHERE type = 'trend'", "units", "dimensions")(
    lambda u, d: views.dimension_pivot(u.filter("type = 'trend'"), d, views.TREND, u.filter("id % 3 = 0")).select("id", *views.TREND, "source_type", "is_new"))
q("S9_export_dimensions", """SELECT u.id, u.name, (SELECT arg_max(value, id) FROM dimensions d WHERE d.unit_insight_id = u.id AND dimension_type = 'adoption') AS stage, (SELECT arg_max(value, id) FROM dimensions d WHERE d.unit_insight_id = u.id AND dimension_type = 'urgency') AS urgency,
    (SELECT min_by(left(chunk_text, 500), e.id) FROM evidence e WHERE e.dimension_id = (SELECT max(id) FROM dimensions d WHERE d.unit_insight_id = u.id AND dimension_type = 'adoption')) AS evidence FROM units u WHERE id IN (SELECT unit_insight_id FROM dimensions)""", "units", "dimensions", "evidence")(
    lambda *t: views.export_dimensions(*t).select("id", *(F.get_json_object("export", p).alias(n) for n, p in (("name", "$.name"), ("stage", "$.dimensions.adoption.stage"), ("urgency", "$.dimensions.urgency.level"), ("evidence", "$.dimensions.adoption.evidence[0].text")))))
PLACED = "(SELECT dimension_id % 200 AS insight_id, id AS place, chunk_text, start_time FROM evidence)"
q("W4_evidence_sampling", f"""WITH s AS (SELECT *, count(*) OVER w AS n, count(start_time) OVER w AS t, row_number() OVER (PARTITION BY insight_id ORDER BY place) - 1 AS i, row_number() OVER (PARTITION BY insight_id ORDER BY start_time NULLS LAST, place) - 1 AS j FROM {PLACED} WINDOW w AS (PARTITION BY insight_id))
    SELECT insight_id, place FROM s WHERE CASE WHEN n <= 5 THEN true WHEN t >= 5 THEN j IN (0, t // 5, 2 * t // 5, 3 * t // 5, 4 * t // 5) ELSE i < 5 END""", "evidence")(
    lambda e: views.sample_evidence(e.select((F.col("dimension_id") % 200).alias("insight_id"), F.col("id").alias("place"), "start_time"), 5).select("insight_id", "place"))
q("W5_evidence_dedup", f"SELECT insight_id, min(place) AS place FROM {PLACED} GROUP BY insight_id, lower(trim(chunk_text))", "evidence")(
    lambda e: views.first_of_texts(e.select((F.col("dimension_id") % 200).alias("insight_id"), F.col("id").alias("place"), "chunk_text")).select("insight_id", "place"))
q("W6_first_natural_key", """SELECT id AS place, coalesce((SELECT min(id) FROM episodes e WHERE e.audio_url = f.audio_url), (SELECT min(id) FROM episodes e WHERE e.podcast_name = 'Show 2' AND e.episode_title = f.title)) AS existing_id FROM feed f""", "feed", "episodes")(
    lambda f, e: upsert.match_episodes(f.select(F.col("id").alias("place"), "audio_url", F.lit("Show 2").alias("podcast_name"), F.col("title").alias("episode_title")), e).select("place", "existing_id"))


def stub_model():
    """A model that finds an insight in each of the first sentences it is given."""

    def run(prompts):
        for p in prompts:
            found = [{"name": s.strip()[:40], "description": s.strip(), "type": "trend", "evidence": ""} for s in p.split(".")[:4] if s.strip()]
            yield json.dumps({"insights": found, "extraction_notes": f"{len(found)} found"})

    return run


query("E1_extract_insights")(lambda spark, d: extraction.extract_insights(load(spark, d, "texts").select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("source"), "text"), stub_model, search.hashing_embedder(), size=6000, overlap=500, search=1000)[0].select("source", "window", "place", "name"))


def assessed(v: DataFrame) -> DataFrame:
    """Retrieval, context, model and reply for each pair of an insight and a dimension."""
    chunks = as_chunks(v).withColumn("text", F.concat(F.lit("About "), "chunk_id"))
    found = search.search_many(v.filter("id % 25 = 0").select(F.col("id").alias("query_id"), "embedding"), chunks)
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("speaker", "string"), ("page", "int"), ("start", "double"), ("end", "double"), ("section", "string"))}
    full = found.join(chunks.select("chunk_id", "text"), "chunk_id").select("*", *none.values())
    context = search.ranked(full, "source", "text", *none).select("query_id", search.format_context("chunks").alias("x"))

    def model():
        return lambda prompts: (json.dumps({"dimension": "Progress", "value": "Low", "confidence": 0.5, "evidence": [{"text": p.split("\n")[1]}]}) for p in prompts)

    replied = search.complete(context.select("query_id", F.col("x.text").alias("prompt")), model)
    return replies.parse_dimensions(replied.select("query_id", "reply", "prompt"), context="prompt").select("query_id", "dimension", "value", "confidence", F.get("evidence", F.lit(0))["text"].alias("evidence"))


q("V9_assess_dimensions", f"SELECT query_id, 'progress' AS dimension, 'Low' AS value, CAST(0.5 AS DOUBLE) AS confidence, 'About ' || chunk_id AS evidence FROM ({TOP % ('', '')}) WHERE rank = 1", "vectors")(assessed)


def assessor():
    """Answers with the source of the first chunk of the context; fails where a batch holds a name that ends in 7."""

    def run(prompts):
        if any("7\n" in p for p in prompts):
            raise RuntimeError("no answer")
        for p in prompts:
            yield json.dumps({"dimension": p.split("\n")[0].split(": ")[1].upper(), "value": p.split("[", 1)[1].split("]")[0], "confidence": 0.5, "evidence": [{"text": "said"}]})

    return run


def assessed_dimensions(s: DataFrame, u: DataFrame, d: DataFrame) -> DataFrame:
    chunks = s.filter("trim(text) <> ''").groupBy("text").agg(F.min(F.concat("source", F.lit(" / "), F.format_string("%05d", "idx"))).alias("chunk_id")).select("chunk_id", F.lit("podcast").alias("kind"), F.col("chunk_id").alias("source"), "text")
    chunks = search.embed(chunks, letter_embedder).drop("error")
    got = assessment.assess_dimensions(u.withColumn("embedding", F.lit(None).cast("array<float>")), d.filter("id % 3 <> 0"), chunks, letter_embedder, assessor, least=0.94)
    return got.select("insight_id", "dimension_type", "value", "confidence", F.size("evidence").alias("n_evidence"), F.col("error").isNotNull().alias("failed"))


WANTED = "CASE WHEN type = 'health_stake' THEN ['criticality', 'urgency', 'actionability'] ELSE ['adoption', 'expectation', 'progress'] END"
ALL_HINTS = " ".join(f"WHEN '{d}' THEN '{h}'" for d, h in K.DIMENSION_HINTS.items())
q("V9_dimensions", f"""WITH c AS (SELECT min(source || ' / ' || printf('%05d', idx)) AS chunk_id, text FROM segments WHERE trim(text) <> '' GROUP BY text), cv AS (SELECT chunk_id, {letter_sql('text')} AS v FROM c),
    t AS (SELECT id, name, description, unnest({WANTED}) AS dim FROM units), p AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM dimensions d WHERE d.id % 3 <> 0 AND d.unit_insight_id = t.id AND d.dimension_type = t.dim)),
    q AS (SELECT id, name, dim, {letter_sql('s')} AS v FROM (SELECT *, CASE WHEN coalesce(description, '') <> '' THEN name || '. ' || description ELSE name END || ' ' || CASE dim {ALL_HINTS} END AS s FROM p)),
    r AS (SELECT q.id, q.dim, arg_max(chunk_id, (list_cosine_similarity(q.v, cv.v), '')) AS chunk_id, max(list_cosine_similarity(q.v, cv.v)) AS score FROM q, cv GROUP BY 1, 2)
    SELECT q.id AS insight_id, q.dim AS dimension_type, CASE WHEN score >= 0.94 THEN CASE WHEN name NOT LIKE '%7' THEN chunk_id END ELSE 'Unknown' END AS value, CASE WHEN score >= 0.94 THEN CASE WHEN name NOT LIKE '%7' THEN 0.5 END ELSE 0.0 END AS confidence,
        CAST(CASE WHEN score >= 0.94 THEN CASE WHEN name NOT LIKE '%7' THEN 1 END ELSE 0 END AS INT) AS n_evidence, score >= 0.94 AND name LIKE '%7' AS failed FROM q JOIN r USING (id, dim)""", "segments", "units", "dimensions")(assessed_dimensions)


def labeller():
    """Labels by the number of the first member: none for every fourth, whose batch fails; in JSON, at length, in quotes for the others."""

    def run(prompts):
        first = [int(p.split("- Insight ")[1].split(":")[0].split("\n")[0]) for p in prompts]
        if any(n % 4 == 0 for n in first):
            raise RuntimeError("no label")
        for n, p in zip(first, prompts):
            yield (json.dumps({"label": f" Theme {n} of {p.count('- Insight ')} "}), "so much to say " * 20, f'"Short {n}"')[n % 4 - 1]

    return run


def describer():
    def run(prompts):
        for p in prompts:
            if p.count("\n- ") > 3:
                raise RuntimeError("too long")
            yield f" On {p.split('Label: ')[1].split(chr(10))[0]}. "

    return run


def labelled(v: DataFrame) -> DataFrame:
    led = similarity.greedy_clusters(v, 0.3).filter("leader is not null").select(F.col("node").alias("id"), "leader")
    grouped = led.select("id", "leader", F.concat(F.lit("Insight "), F.col("id").cast("string")).alias("name"), F.lit("about it").alias("description"))
    got = assessment.label_macros(grouped, labeller, describer, most=4)
    return got.select("leader", "name", "description", F.col("label_error").isNotNull().alias("no_label"), F.col("description_error").isNotNull().alias("no_description"))


q("M4_labels", f"""WITH RECURSIVE {greedy_sql('vectors', 0.3, 'c')}, g AS (SELECT leader, min(node) AS first, count(*) AS n FROM c WHERE leader IS NOT NULL GROUP BY 1),
    l AS (SELECT leader, n, first % 4 = 0 AS no_label, CASE first % 4 WHEN 1 THEN 'Theme ' || CAST(first AS VARCHAR) || ' of ' || CAST(least(n, 4) AS VARCHAR) WHEN 3 THEN 'Short ' || CAST(first AS VARCHAR) ELSE 'Insight ' || CAST(first AS VARCHAR) END AS name FROM g)
    SELECT leader, name, CASE WHEN n <= 3 THEN 'On ' || name || '.' END AS description, no_label, n > 3 AS no_description FROM l""", "vectors")(labelled)


def stored(spark: SparkSession, name: str, write, read) -> DataFrame:
    path = work_path(spark, name)
    write(path)
    return read(path)


def turns(s: DataFrame) -> DataFrame:
    return s.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("segments"))


q("S1_read_transcripts", "SELECT source, count(*) AS segments FROM segments GROUP BY 1", "segments")(
    lambda s: stored(s.sparkSession, "transcripts", lambda p: turns(s).select(F.to_json(F.struct("source", "segments")).alias("value")).write.option("maxRecordsPerFile", 1).text(p), lambda p: objects.read_transcripts(s.sparkSession, p))
    .filter("error is null").select(F.try_variant_get("transcript", "$.source", "string").alias("source"), F.size(F.try_variant_get("transcript", "$.segments", "array<variant>")).cast("long").alias("segments")))
q("S2_write_transcripts", "SELECT source, count(*) AS segments FROM segments GROUP BY 1", "segments")(
    lambda s: stored(s.sparkSession, "lines", lambda p: objects.write_transcripts(turns(s).withColumn("content_type", F.when(F.crc32("source") % 2 == 0, "podcast").otherwise("document")), p), lambda p: s.sparkSession.read.schema("source string, segments array<struct<idx:int,text:string>>").json(p))
    .select("source", F.size("segments").cast("long").alias("segments")))
q("S3_texts", "SELECT count(*) AS n, CAST(sum(length(source)) AS BIGINT) AS chars FROM texts", "texts")(
    lambda d: stored(d.sparkSession, "texts", lambda p: objects.write_texts(d, p, "source"), lambda p: d.sparkSession.read.text(p)).agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars")))
q("S4_list_objects", "SELECT count(DISTINCT lang) AS folders FROM texts", "texts")(
    lambda d: stored(d.sparkSession, "objects", lambda p: objects.write_table(d.select("lang", "doc_id"), p, partition_by=("lang",)), lambda p: objects.list_objects(d.sparkSession, p, "*.parquet")).agg(F.countDistinct(F.regexp_extract("path", "lang=([^/]*)", 1)).alias("folders")))
q("S8_table_store", "SELECT id, CASE WHEN id % 2 = 0 THEN name END AS name, CASE WHEN id % 2 = 1 THEN type END AS type FROM units", "units")(
    lambda u: stored(u.sparkSession, "store", lambda p: (objects.write_table(u.filter("id % 2 = 0").select("id", "name"), p), objects.write_table(u.filter("id % 2 = 1").select("id", "type"), p, "append")), lambda p: objects.read_table(u.sparkSession, p)).select("id", "name", "type"))

q("R1_latest_status", "SELECT CAST(feed_id AS STRING) AS entity_id, max_by(audio_url, (published_at, audio_url)) AS status, max(published_at) AS \"timestamp\" FROM feed GROUP BY 1", "feed")(
    lambda f: latest_status(f.select(F.lit("episode").alias("type"), F.col("feed_id").cast("string").alias("entity_id"), F.col("audio_url").alias("status"), F.lit(None).cast("string").alias("error"), F.col("published_at").alias("timestamp"))).select("entity_id", "status", "timestamp"))


def as_podcast(s: DataFrame) -> DataFrame:
    """Chunks with vectors, of turns of conversations."""
    whole = s.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("idx", "text", F.col("idx").cast("double").alias("start"), F.lit(None).cast("double").alias("end")))).alias("segments"))
    return search.embed(chunking.chunk_podcast(whole), search.hashing_embedder(16), "full_text").drop("error")


def arriving(spark: SparkSession, rows: DataFrame, inbox: str, parts: int, key: str) -> None:
    rows.repartition(parts, key).write.mode("append").parquet(inbox)


def streamed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations arrive as a stream of files and are chunked, embedded and indexed batch by batch; first some turns, then all of them, which replace the chunks."""
    inbox, index, marks = (work_path(spark, n) for n in ("inbox", "index", "marks"))
    rows = load(spark, sf_dir, "segments").select("source", "idx", "text")
    for part in (rows.filter("idx < 3"), rows):
        arriving(spark, part, inbox, 4, "source")
        index_batches(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(inbox), as_podcast, index, marks).awaitTermination()
    return indexed(spark, index, "chunk_id string, source string, text string, overlap_text string, embedding array<float>").select("chunk_id", "source", "text", "overlap_text", F.size("embedding").alias("dim"))


query("R2_incremental_index", oracle(f"SELECT chunk_id, regexp_replace(chunk_id, '_chunk_[0-9]+$', '') AS source, text, overlap_text, 16 AS dim FROM ({CHUNKS})", "segments"))(streamed_index)


STEP = 0.32


def streamed_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors arrive in three batches; the macros found so far match the units of the next."""
    inbox, state, marks = (work_path(spark, n) for n in ("inbox", "state", "marks"))
    rows = load(spark, sf_dir, "vectors").select("id", F.concat(F.lit("Insight "), F.col("id").cast("string")).alias("name"), F.col("embedding").cast("array<float>").alias("embedding"))
    for k in range(3):
        arriving(spark, rows.filter(f"id % 3 = {k}"), inbox, 2, "id")
        discover_batches(spark.readStream.schema(rows.schema).parquet(inbox), state, marks, STEP).awaitTermination()
    units, macros = discovered_state(spark, state)
    return units.join(macros.select(F.col("id").alias("macro_id"), F.col("name").alias("macro_name"), "n"), "macro_id", "left").select("id", "macro_id", "macro_name", F.col("n").alias("members"))


def discovery_step(k: int, before: str) -> str:
    """CTEs of one batch: units f, matches m, clusters c, and the macros and free units after it."""
    near = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), b.total)"
    summed = lambda rows: f"SELECT g, list(x ORDER BY i) AS total, any_value(n) AS n FROM (SELECT g, i, sum(x) AS x, count(*) AS n FROM (SELECT g, unnest({UNIT}) AS x, generate_subscripts(embedding, 1) AS i FROM {rows}) GROUP BY g, i) GROUP BY g"
    return f"""f{k} AS (SELECT id, embedding FROM vectors WHERE id % 3 = {k} UNION ALL SELECT id, embedding FROM vectors WHERE id IN (SELECT id FROM free{before})),
    m{k} AS (SELECT id, macro_id FROM (SELECT a.id, b.id AS macro_id, row_number() OVER (PARTITION BY a.id ORDER BY {near} DESC, b.id) AS r FROM f{k} a JOIN macros{before} b ON {near} >= {STEP}) WHERE r = 1),
    rest{k} AS (SELECT * FROM f{k} WHERE id NOT IN (SELECT id FROM m{k})), {greedy_sql(f'rest{k}', STEP, f'c{k}')},
    gain{k} AS ({summed(f'(SELECT m.macro_id AS g, embedding FROM m{k} m JOIN f{k} USING (id))')}), group{k} AS ({summed(f'(SELECT leader AS g, embedding FROM c{k} JOIN f{k} ON id = node WHERE leader IS NOT NULL)')}),
    made{k} AS (SELECT (SELECT coalesce(max(id), 0) FROM macros{before}) + row_number() OVER (ORDER BY g) AS id, (SELECT min(node) FROM c{k} WHERE leader = g) AS first, g AS leader, total, n FROM group{k}),
    macros{k} AS MATERIALIZED (SELECT o.id, o.first, CASE WHEN g.g IS NULL THEN o.total ELSE [o.total[i] + g.total[i] FOR i IN range(1, len(o.total) + 1)] END AS total, o.n + coalesce(g.n, 0) AS n FROM macros{before} o LEFT JOIN gain{k} g ON g.g = o.id UNION ALL SELECT id, first, total, n FROM made{k}),
    link{k} AS MATERIALIZED (SELECT id, macro_id FROM m{k} UNION ALL SELECT node, made{k}.id FROM c{k} JOIN made{k} USING (leader)), free{k} AS MATERIALIZED (SELECT node AS id FROM c{k} WHERE leader IS NULL)"""


query("R3_incremental_matching", oracle(f"""WITH RECURSIVE free_none AS (SELECT id FROM vectors WHERE id < -1), macros_none AS (SELECT id, id AS first, CAST([] AS DOUBLE[]) AS total, CAST(0 AS BIGINT) AS n FROM vectors WHERE id < -1), {discovery_step(0, '_none')}, {discovery_step(1, '0')}, {discovery_step(2, '1')}
    SELECT u.id, u.macro_id, 'Insight ' || CAST(m.first AS VARCHAR) AS macro_name, m.n AS members FROM (SELECT * FROM link0 UNION ALL SELECT * FROM link1 UNION ALL SELECT * FROM link2 UNION ALL SELECT id, NULL FROM free2) u LEFT JOIN macros2 m ON m.id = u.macro_id""", "vectors"))(streamed_discovery)


def status_events(f: DataFrame) -> DataFrame:
    """Status events of the feed, one in eleven without a time of its own, which the receiver stamps."""
    return f.select(F.lit("episode").alias("type"), F.col("feed_id").cast("string").alias("entity_id"), F.col("audio_url").alias("status"), F.when(F.col("id") % 7 == 0, "late").alias("error"),
        F.when(F.col("id") % 11 != 0, F.col("published_at")).alias("timestamp"), (F.col("published_at") + F.expr("INTERVAL 1 HOUR")).alias("received"), "id")


def streamed_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status events arrive in files, out of order and in several triggers, the second run from where the first stopped; some come twice."""
    inbox, state, marks = (work_path(spark, n) for n in ("inbox", "states", "marks"))
    rows = status_events(load(spark, sf_dir, "feed"))
    for part in (rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0 or id % 5 = 0")):
        arriving(spark, part, inbox, 3, "id")
        status_batches(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(inbox), state, marks, F.col("received")).awaitTermination()
    return current_states(spark, state).select("entity_id", "status", "error", "timestamp")


query("R1_stream", oracle("""SELECT entity_id, max_by(status, (seen, status)) AS status, max_by(coalesce(error, 'none'), (seen, status)) AS error, max(seen) AS "timestamp"
    FROM (SELECT CAST(feed_id AS STRING) AS entity_id, audio_url AS status, CASE WHEN id % 7 = 0 THEN 'late' END AS error, CASE WHEN id % 11 <> 0 THEN published_at ELSE published_at + INTERVAL 1 HOUR END AS seen FROM feed) GROUP BY 1""", "feed"))(
    lambda spark, d: streamed_status(spark, d).withColumn("error", F.coalesce("error", F.lit("none"))))
