"""Queries of the catalogue: projections, filters, joins, aggregates, order, sets, maintenance and states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline import constants as K
from strandline.functions import text as T
from strandline.operators import catalog, stats, status, upsert
from strandline.sources.objects import backfill_sizes
from strandline.plans.inputs import load, oracle
from strandline.plans.registry import query


def q(name: str, sql: str, *tables: str):
    """Registers f(*tables); its SQL is over the same tables of the data model."""

    def put(f):
        query(name, oracle(sql, *tables))(lambda spark, sf_dir: f(*(load(spark, sf_dir, t) for t in tables)))
        return f

    return put


q("P1_source_key", "SELECT id, podcast_name || ' - ' || episode_title AS source FROM episodes", "episodes")(
    lambda e: e.select("id", T.source_key().alias("source")))

q("P2_source_kind", """SELECT id, CASE WHEN episode_id <> 0 THEN 'podcast' WHEN document_id <> 0 THEN 'document' ELSE 'unknown' END AS source_kind,
    CASE WHEN episode_id <> 0 THEN episode_id WHEN document_id <> 0 THEN document_id END AS source_id FROM units""", "units")(
    lambda u: u.withColumn("k", T.source_kind()).select("id", F.col("k.kind").alias("source_kind"), F.col("k.id").alias("source_id")))

P3 = "episode_id IS NOT NULL AND type = 'health_stake' AND macro_insight_id IS NOT NULL"
q("P3_list_unit_insights", f"SELECT id, name, type, (SELECT count(*) FROM units WHERE {P3}) AS total FROM units WHERE {P3} ORDER BY id LIMIT 20 OFFSET 5", "units")(
    lambda u: catalog.list_unit_insights(u, "podcast", "health_stake", True, 5, 20).select("id", "name", "type", "total"))
q("P4_list_macro_insights", """SELECT id, name, cluster_id, (SELECT count(*) FROM units WHERE macro_insight_id = m.id) AS unit_count FROM macros m WHERE cluster_id IS NOT NULL""", "macros", "units")(
    lambda m, u: catalog.list_macro_insights(m, u, has_cluster=True))

q("P5_list_documents", "SELECT id, title, pages FROM sources WHERE source_type = 'txt' ORDER BY pages DESC, id DESC LIMIT 25", "sources")(
    lambda d: catalog.list_documents(d, "txt", 25, "pages").select("id", "title", "pages"))

q("P6_episode_filters", """SELECT id, 'with' AS which FROM episodes WHERE gcs_transcript_uri IS NOT NULL UNION ALL SELECT id, 'without' FROM episodes WHERE gcs_transcript_uri IS NULL
    UNION ALL SELECT id, 'show' FROM episodes WHERE podcast_name = 'Show 7' UNION ALL SELECT id, 'url' FROM episodes WHERE audio_url = 'https://cdn.example/11'
    UNION ALL SELECT id, 'name' FROM episodes WHERE podcast_name = 'Show 3' AND episode_title = 'Episode 3'""", "episodes")(
    lambda e: catalog.with_transcript(e).select("id", F.lit("with").alias("which")).union(catalog.with_transcript(e, False).select("id", F.lit("without")))
    .union(catalog.episodes_of(e, "Show 7").select("id", F.lit("show"))).union(catalog.find_episode(e, "https://cdn.example/11").select("id", F.lit("url")))
    .union(catalog.find_episode(e, None, "Show 3", "Episode 3").select("id", F.lit("name"))))

q("P7_recent_episodes", "SELECT id, title FROM feed WHERE published_at > TIMESTAMP '2024-01-15 00:00:00'", "feed")(
    lambda f: catalog.recent_episodes(f, 1705276800).select("id", "title"))

SCORE = "(" + " + ".join(f"CASE WHEN contains(lower(title), '{k}') THEN 2.0 WHEN contains(lower(coalesce(description, '')), '{k}') OR contains(lower(title) || ' ' || lower(coalesce(description, '')), '{k}') THEN 1.0 ELSE 0.0 END" for k in K.KEYWORDS) + ")"

q("P8_relevance_score", f"SELECT id, CAST({SCORE} AS DOUBLE) AS score FROM feed", "feed")(lambda f: f.select("id", T.relevance_score().alias("score")))

q("P9_filter_by_relevance", f"""SELECT id, CAST(score AS DOUBLE) AS score FROM (SELECT id, {SCORE} AS score FROM feed) WHERE score >= 1 ORDER BY score DESC, id LIMIT 40""", "feed")(
    lambda f: catalog.filter_by_relevance(f, 1.0, 40).select("id", "score"))

q("P9d_discover_relevant", f"""SELECT feed_id, id, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY score DESC, place) AS r FROM (
    SELECT *, {SCORE} AS score FROM (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY published_at DESC, id) AS place FROM feed) WHERE place <= 50) WHERE score >= 1) WHERE r <= 10 AND score >= 3""", "feed")(
    lambda f: catalog.discover_relevant(f, cut=3.0).select("feed_id", "id", "score"))

q("P15_strip_overlap", """SELECT id, CASE WHEN position(chr(10) || chr(10) IN chunk_text) > 0 THEN substr(chunk_text, position(chr(10) || chr(10) IN chunk_text) + 2) ELSE chunk_text END AS display_text FROM evidence""", "evidence")(
    lambda e: e.select("id", T.strip_overlap("chunk_text").alias("display_text")))

q("P16_normalize_id", r"""SELECT doc_id, left(replace(trim(regexp_replace(left(text, 80), '[^\p{L}\p{N} _-]', '_', 'g'), ' '), ' ', '_'), 50) || '_20240101' AS document_id,
    left(replace(trim(regexp_replace(left(text, 200), '[^\p{L}\p{N} _-]', '_', 'g'), ' '), ' ', '_'), 100) AS filename FROM texts""", "texts")(
    lambda d: d.select("doc_id", T.normalize_id(F.left("text", F.lit(80)), 50, F.lit("20240101")).alias("document_id"), T.normalize_id(F.left("text", F.lit(200)), 100).alias("filename")))

q("P17_resolve_format", r"""SELECT id, CASE WHEN lower(source_type) IN ('pdf', 'txt', 'md', 'docx') THEN lower(source_type) WHEN lower(regexp_extract(gcs_transcript_uri, '[^/]\.([^./]+)$', 1)) IN ('pdf', 'txt', 'md', 'docx') THEN lower(regexp_extract(gcs_transcript_uri, '[^/]\.([^./]+)$', 1))
    WHEN id % 3 = 0 THEN lower(regexp_extract(gcs_document_uri, '[^/]\.([^./]+)$', 1)) ELSE 'unknown' END AS format FROM sources""", "sources")(
    lambda d: d.select("id", T.resolve_format("source_type", "gcs_transcript_uri", F.when(F.col("id") % 3 == 0, F.col("gcs_document_uri")), F.lit("web")).alias("format")))

q("P18_parse_iso_date", "SELECT id, CASE WHEN id % 3 <> 0 THEN date_trunc('second', published_at) END AS parsed FROM feed", "feed")(
    lambda f: f.select("id", T.parse_iso_date(F.when(F.col("id") % 3 == 0, F.lit("soon")).otherwise(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"))).cast("timestamp_ntz").alias("parsed")))

q("P19_evidence_metadata", """SELECT id, CASE WHEN start_time IS NOT NULL THEN 'start_time=' || CAST(CAST(start_time AS BIGINT) AS STRING) WHEN page IS NOT NULL THEN 'page=' || CAST(page AS STRING) END AS metadata FROM evidence""", "evidence")(
    lambda e: e.withColumn("m", T.evidence_metadata(F.lit(None), "page", F.col("start_time").cast("long"), F.lit(None), F.lit(None)))
    .select("id", F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat(x.key, F.lit("="), x.value)), ",").alias("metadata")))

q("P20_parse_label", r"""SELECT id, CASE id % 5 WHEN 0 THEN name WHEN 1 THEN 'x' || name WHEN 2 THEN name WHEN 3 THEN NULL ELSE name END AS label FROM units""", "units")(
    lambda u: u.withColumn("r", F.expr("""CASE id % 5 WHEN 0 THEN concat('{"label": " ', name, ' "}') WHEN 1 THEN concat('Sure: {"label" : "x', name, '"} as asked') WHEN 2 THEN concat('"', name, '"') WHEN 3 THEN repeat('long ', 40) ELSE concat('  ', name, ' ') END"""))
    .select("id", T.parse_label("r").alias("label")))

q("P23_plotting_filter", """SELECT unit_insight_id FROM dimensions GROUP BY 1 HAVING (max(CASE WHEN dimension_type = 'expectation' THEN 1 END) = 1 AND max(CASE WHEN dimension_type = 'progress' THEN 1 END) = 1) AND unit_insight_id % 2 = 0
    OR (max(CASE WHEN dimension_type = 'criticality' THEN 1 END) = 1 AND max(CASE WHEN dimension_type = 'urgency' THEN 1 END) = 1) AND unit_insight_id % 2 = 1""", "dimensions")(
    lambda d: plottable(d.groupBy("unit_insight_id").pivot("dimension_type", ["expectation", "progress", "criticality", "urgency"]).agg(F.max("value")).withColumn("type", F.when(F.col("unit_insight_id") % 2 == 0, "trend").otherwise("health_stake"))).select("unit_insight_id"))


def plottable(pivoted):
    """Trends with expectation and progress, stakes with criticality and urgency."""
    both = lambda a, b: T.is_set(a) & T.is_set(b)
    return pivoted.filter(F.when(F.col("type") == "trend", both("expectation", "progress")).when(F.col("type") == "health_stake", both("criticality", "urgency")))


q("P24_embedding_text", "SELECT id, CASE WHEN coalesce(description, '') <> '' THEN name || '. ' || description ELSE name END AS embedding_text FROM units", "units")(
    lambda u: u.select("id", T.embedding_text().alias("embedding_text")))

q("P25_title_from_path", r"SELECT id, 'my report v' || CAST(id AS STRING) AS title FROM sources", "sources")(
    lambda d: d.select("id", T.title_from_path(F.concat(F.lit("gs://b/dir.x/my_report_v"), F.col("id").cast("string"), F.lit(".pdf"))).alias("title")))

q("P26_preview", "SELECT doc_id, replace(left(text, 200), chr(10), ' ') AS preview FROM texts", "texts")(lambda d: d.select("doc_id", T.preview("text").alias("preview")))

q("P27_file_flags", "SELECT id, coalesce(gcs_audio_uri, '') <> '' AS has_audio, coalesce(gcs_transcript_uri, '') <> '' AS has_transcript FROM episodes", "episodes")(
    lambda e: e.select("id", T.is_set("gcs_audio_uri").alias("has_audio"), T.is_set("gcs_transcript_uri").alias("has_transcript")))

q("S5_parse_object_uri", r"SELECT id, CASE WHEN gcs_audio_uri LIKE 'gs://%' THEN regexp_extract(gcs_audio_uri, '^gs://([^/]*)/?(.*)$', 1) END AS bucket, CASE WHEN gcs_audio_uri LIKE 'gs://%' THEN regexp_extract(gcs_audio_uri, '^gs://([^/]*)/?(.*)$', 2) END AS object_key FROM episodes", "episodes")(
    lambda e: e.withColumn("u", T.parse_uri("gcs_audio_uri")).select("id", F.col("u.bucket").alias("bucket"), F.col("u.key").alias("object_key")))

READY = """(SELECT 'podcast' AS kind, id, podcast_name || ' - ' || episode_title AS source FROM episodes WHERE coalesce(gcs_transcript_uri, '') <> '' AND podcast_name || ' - ' || episode_title IN (SELECT source FROM podcast_chunks) AND id NOT IN (SELECT episode_id FROM units WHERE episode_id IS NOT NULL)
    UNION ALL SELECT 'document', id, title FROM sources WHERE coalesce(gcs_transcript_uri, '') <> '' AND title IN (SELECT source FROM document_chunks) AND id NOT IN (SELECT document_id FROM units WHERE document_id IS NOT NULL))"""
CAT = ("episodes", "sources", "podcast_chunks", "document_chunks", "units")

q("J1_ready_sources", f"SELECT * FROM {READY}", *CAT)(catalog.ready_sources)
q("J2_pending_insights", "SELECT id, name FROM units WHERE id NOT IN (SELECT unit_insight_id FROM dimensions)", "units", "dimensions")(
    lambda u, d: catalog.pending_insights(u, d).select("id", "name"))

WANTED = "(SELECT id AS insight_id, unnest(CASE WHEN type = 'health_stake' THEN ['criticality', 'urgency', 'actionability'] ELSE ['adoption', 'progress', 'expectation'] END) AS dimension_type FROM units)"
q("J3_dimensions_to_assess", f"SELECT * FROM {WANTED} w WHERE dimension_type <> 'urgency' AND NOT EXISTS (SELECT 1 FROM dimensions d WHERE d.unit_insight_id = w.insight_id AND d.dimension_type = w.dimension_type)", "units", "dimensions")(
    lambda u, d: catalog.dimensions_to_assess(u, d, disabled=["urgency"]))
q("J4_already_added", "SELECT id, audio_url IN (SELECT audio_url FROM episodes WHERE audio_url IS NOT NULL) AS already_added FROM feed", "feed", "episodes")(
    lambda f, e: catalog.flag_known(f, e).select("id", "already_added"))

RESOLVED = """(SELECT v.*, CASE WHEN e.id IS NOT NULL THEN 'podcast' WHEN d.id IS NOT NULL THEN 'document' END AS source_kind, coalesce(e.id, d.id) AS source_id FROM evidence v
    LEFT JOIN (SELECT podcast_name || ' - ' || episode_title AS k, min(id) AS id FROM episodes GROUP BY 1) e ON contains(source_ref, ' - ') AND trim(source_ref) = e.k
    LEFT JOIN (SELECT title, min(id) AS id FROM sources GROUP BY 1) d ON trim(source_ref) = d.title)"""
q("J5_resolve_source_ref", f"SELECT id, source_kind, CAST(source_id AS BIGINT) AS source_id FROM {RESOLVED}", "evidence", "episodes", "sources")(
    lambda v, e, d: catalog.resolve_source_ref(v, e, d).select("id", "source_kind", "source_id"))

q("J8_cascade_delete", """WITH gone AS (SELECT id FROM units WHERE episode_id % 4 = 0), lost AS (SELECT id FROM dimensions WHERE unit_insight_id IN (SELECT id FROM gone))
    SELECT 'units' AS table_name, count(*) AS n FROM units WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'dimensions', count(*) FROM dimensions WHERE id NOT IN (SELECT id FROM lost)
    UNION ALL SELECT 'evidence', count(*) FROM evidence WHERE dimension_id NOT IN (SELECT id FROM lost)""", "units", "dimensions", "evidence", "episodes")(
    lambda u, d, v, e: (lambda x: x[0].agg(F.count("*").alias("n")).select(F.lit("units").alias("table_name"), "n").union(x[1].agg(F.count("*")).select(F.lit("dimensions"), "*")).union(x[2].agg(F.count("*")).select(F.lit("evidence"), "*")))(
        catalog.cascade_delete(e.filter("id % 4 = 0").select("id").union(u.filter("episode_id % 4 = 0").select("episode_id")), "episode_id", u, d, v)))

COUNTS = f"""SELECT (SELECT count(*) FROM {READY} WHERE kind = 'podcast') AS ready_podcasts, (SELECT count(*) FROM {READY} WHERE kind = 'document') AS ready_documents, (SELECT count(*) FROM episodes) AS total_podcasts, (SELECT count(*) FROM sources) AS total_documents,
    count(DISTINCT episode_id) AS analyzed_podcasts, count(DISTINCT document_id) AS analyzed_documents, count(*) AS unit_insights, count(*) FILTER (type = 'trend') AS trends, count(*) FILTER (type = 'health_stake') AS stakes, count(macro_insight_id) AS with_macro,
    count(*) FILTER (macro_insight_id IS NULL AND cluster_id IS NOT NULL) AS orphans_with_cluster, count(*) FILTER (macro_insight_id IS NULL AND cluster_id IS NULL) AS orphans_without_cluster,
    (SELECT count(*) FROM macros) AS macros, (SELECT count(cluster_id) FROM macros) AS macros_with_cluster, (SELECT count(*) - count(cluster_id) FROM macros) AS macros_without_cluster, (SELECT count(*) FROM clusters) AS clusters, (SELECT count(*) FROM dimensions) AS dimensions FROM units"""
q("A1_pipeline_statistics", COUNTS, *CAT, "macros", "clusters", "dimensions")(stats.pipeline_statistics)
q("A2_cluster_statistics", "SELECT name, (SELECT count(*) FROM macros WHERE cluster_id = c.id) AS macro_count FROM clusters c", "clusters", "macros")(stats.cluster_statistics)
q("A3_documents_by_type", "SELECT source_type, count(*) AS n FROM sources GROUP BY 1", "sources")(stats.documents_by_type)
q("A4_dimension_stats", """SELECT dimension_type, count(*) AS n, (SELECT count(*) FROM units) AS total_insights, (SELECT count(*) FROM units WHERE id IN (SELECT unit_insight_id FROM dimensions)) AS with_dimensions,
    (SELECT count(*) FROM units WHERE id NOT IN (SELECT unit_insight_id FROM dimensions)) AS pending FROM dimensions GROUP BY 1""", "units", "dimensions")(stats.dimension_stats)
q("A5_index_stats", """SELECT (SELECT count(*) FROM podcast_chunks) AS podcast_chunks, (SELECT count(*) FROM document_chunks) AS document_chunks, (SELECT count(*) FROM podcast_chunks) + (SELECT count(*) FROM document_chunks) AS total_chunks,
    count(gcs_transcript_uri) AS with_transcript, count(*) - count(gcs_transcript_uri) AS without_transcript FROM episodes""", "podcast_chunks", "document_chunks", "episodes")(stats.index_stats)
q("A6_macro_size_stats", "SELECT avg(n) AS average_size, max(n) AS largest_size FROM (SELECT count(*) AS n FROM units WHERE macro_insight_id IS NOT NULL GROUP BY macro_insight_id)", "units")(stats.macro_size_stats)
q("A7_clusters_used", """WITH a AS (SELECT CASE WHEN cluster_id = 5 THEN 'Other' ELSE 'C' || CAST(cluster_id AS STRING) END AS cluster_name FROM macros WHERE cluster_id IS NOT NULL UNION ALL SELECT CASE WHEN cluster_id = 5 THEN 'Other' ELSE 'C' || CAST(cluster_id AS STRING) END FROM units WHERE macro_insight_id IS NULL AND cluster_id IS NOT NULL)
    SELECT cluster_name, count(*) AS assigned, (SELECT count(*) FROM a) AS processed, (SELECT count(*) FROM a WHERE cluster_name = 'Other') AS to_other FROM a GROUP BY 1""", "macros", "units")(
    lambda m, u: (lambda name: stats.clusters_used(*(x.filter("cluster_id is not null").select(name.alias("cluster_name"), (F.col("cluster_id") == 5).alias("is_other")) for x in (m, u.filter("macro_insight_id is null")))))(
        F.when(F.col("cluster_id") == 5, K.OTHER).otherwise(F.concat(F.lit("C"), F.col("cluster_id").cast("string")))))
q("A8_analyzed_counts", """SELECT e.id, count(DISTINCT u.id) AS insight_count, count(d.id) AS dimensions_count, count(d.id) > 0 AS analyzed FROM episodes e LEFT JOIN units u ON u.episode_id = e.id LEFT JOIN dimensions d ON d.unit_insight_id = u.id GROUP BY 1""", "episodes", "units", "dimensions")(stats.analyzed_counts)
q("A9_cluster_totals", """SELECT c.id, c.name, (SELECT count(*) FROM units u JOIN macros m ON u.macro_insight_id = m.id WHERE m.cluster_id = c.id) + (SELECT count(*) FROM units u WHERE u.macro_insight_id IS NULL AND u.cluster_id = c.id) AS unit_count FROM clusters c""", "clusters", "macros", "units")(stats.cluster_totals)
q("A10_ingest_summary", """SELECT count(*) AS total, count(*) FILTER (status IN ('completed', 'ready', 'indexed', 'success')) AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, CAST(sum(pages) AS BIGINT) AS chunks, CAST(sum(pages * 2) AS BIGINT) AS seconds FROM sources""", "sources")(
    lambda d: stats.ingest_summary(d.withColumns({"chunks": F.col("pages"), "seconds": F.col("pages") * 2})))
q("A14_chunk_averages", "SELECT source, count(*) AS chunks, CAST(sum(length(chunk_text)) // count(*) AS BIGINT) AS average_chars FROM podcast_chunks GROUP BY 1", "podcast_chunks")(lambda c: stats.chunk_averages(c, "chunk_text"))

PRIORITY = "CASE status " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(K.STATUS_ORDER, 1)) + " ELSE 9 END"
q("O1_status_priority", f"SELECT id, status, {PRIORITY} AS status_priority FROM episodes ORDER BY 3, created_at DESC, id LIMIT 50 OFFSET 10", "episodes")(
    lambda e: catalog.by_status(e, 10, 50).select("id", "status", "status_priority"))
q("O2_paging", "SELECT id, (SELECT count(*) FROM sources) > 40 AS has_more, CASE WHEN (SELECT count(*) FROM sources) > 40 THEN 40 END AS next_offset FROM sources ORDER BY id LIMIT 15 OFFSET 25", "sources")(
    lambda d: catalog.paged(d.select("id"), ["id"], 25, 15))
q("O4_clusters_by_size", "SELECT name, n, row_number() OVER (ORDER BY n DESC, name) AS place FROM (SELECT name, (SELECT count(*) FROM macros WHERE cluster_id = c.id) AS n FROM clusters c)", "clusters", "macros")(
    lambda c, m: stats.cluster_statistics(c, m).select("name", F.col("macro_count").alias("n"), F.row_number().over(Window.orderBy(F.desc("macro_count"), "name")).alias("place")))

q("U1_union_of_kinds", "SELECT id, source, 'podcast' AS kind FROM podcast_chunks UNION ALL SELECT id, source, 'document' FROM document_chunks", "podcast_chunks", "document_chunks")(
    lambda p, d: catalog.union_of_kinds(p, d).select("id", "source", "kind"))
q("U2_new_ids", "SELECT DISTINCT id FROM units WHERE id NOT IN (SELECT id FROM units WHERE weight < 4000) ORDER BY id", "units")(lambda u: catalog.new_ids(u, u.filter("weight < 4000")))
q("U3_distinct_sources", "SELECT dimension_id, array_to_string(list_sort(list(DISTINCT trim(source_ref))), '|') AS sources FROM evidence GROUP BY 1", "evidence")(
    lambda v: v.groupBy("dimension_id").agg(F.array_join(F.array_sort(F.collect_set(F.trim("source_ref"))), "|").alias("sources")))

def arriving(f: DataFrame) -> DataFrame:
    """A batch of episodes: rows that repeat by URL, by name, by both, and without either."""
    n = F.col("id")
    return f.select(n.alias("place"), F.when(n % 17 != 0, F.when(n % 4 == 0, F.concat(F.lit("https://cdn.example/"), (n * 7 % 1100).cast("string"))).otherwise(F.concat(F.lit("https://new.example/"), (n * n % 2503).cast("string")))).alias("audio_url"),
        F.concat(F.lit("Show "), (n % 40).cast("string")).alias("podcast_name"), F.when(n % 13 != 0, F.concat(F.lit("Episode "), (n * 31 % 1709).cast("string"))).alias("episode_title"))


# rounds over the rows that nothing stored matches: 1 made, 2 found, 0 open; a row is made once it comes first among the open ones of its URL and of its name
q("G1_upsert_episodes", """WITH RECURSIVE b AS (SELECT id AS place, CASE WHEN id % 17 <> 0 THEN CASE WHEN id % 4 = 0 THEN 'https://cdn.example/' || CAST(id * 7 % 1100 AS STRING) ELSE 'https://new.example/' || CAST(id * id % 2503 AS STRING) END END AS url,
        'Show ' || CAST(id % 40 AS STRING) || '|' || CASE WHEN id % 13 <> 0 THEN 'Episode ' || CAST(id * 31 % 1709 AS STRING) END AS name FROM feed),
    su AS (SELECT audio_url, min(id) AS id FROM episodes GROUP BY 1), sn AS (SELECT podcast_name || '|' || episode_title AS name, min(id) AS id FROM episodes GROUP BY 1),
    f AS (SELECT b.*, su.id AS by_url, sn.id AS by_name FROM b LEFT JOIN su ON su.audio_url = b.url LEFT JOIN sn ON sn.name = b.name),
    r AS (SELECT place, coalesce(url, 'row ' || place) AS u, coalesce(name, 'row ' || place) AS n, 0 AS made, 0 AS step FROM f WHERE by_url IS NULL AND by_name IS NULL UNION ALL
        SELECT place, u, n, CASE WHEN made > 0 THEN made WHEN gu OR gn THEN 2 WHEN place = mu AND place = mn THEN 1 ELSE 0 END, step + 1
        FROM (SELECT *, min(CASE WHEN made = 0 THEN place END) OVER (PARTITION BY u) AS mu, min(CASE WHEN made = 0 THEN place END) OVER (PARTITION BY n) AS mn, bool_or(made = 1) OVER (PARTITION BY u) AS gu, bool_or(made = 1) OVER (PARTITION BY n) AS gn, sum(CASE WHEN made = 0 THEN 1 ELSE 0 END) OVER () AS left_ FROM r) WHERE left_ > 0),
    new AS (SELECT place, u, n, (SELECT max(id) FROM episodes) + row_number() OVER (ORDER BY place) AS id FROM r WHERE made = 1 AND step = (SELECT max(step) FROM r))
    SELECT f.place, CAST(coalesce(own.id, by_url, x.id, by_name, y.id) AS BIGINT) AS id, own.id IS NOT NULL AS created FROM f LEFT JOIN new own ON own.place = f.place LEFT JOIN new x ON x.u = f.url AND x.place < f.place LEFT JOIN new y ON y.n = f.name AND y.place < f.place""", "feed", "episodes")(
    lambda f, e: upsert.upsert_episodes(arriving(f), e, "place").select("place", "id", "created"))
q("G1d_upsert_documents", """WITH b AS (SELECT id AS place, CASE WHEN id % 19 <> 0 THEN 'gs://docs/' || CAST(id % 400 AS STRING) || '.pdf' END AS uri FROM feed), f AS (SELECT b.*, (SELECT min(id) FROM sources s WHERE s.gcs_document_uri = b.uri) AS old FROM b),
    n AS (SELECT place, uri, (SELECT max(id) FROM sources) + row_number() OVER (ORDER BY place) AS id FROM f WHERE old IS NULL AND (uri IS NULL OR place = (SELECT min(place) FROM b WHERE b.uri = f.uri)))
    SELECT f.place, CAST(coalesce(f.old, n.id, m.id) AS BIGINT) AS id, CASE WHEN n.id IS NULL THEN 'skipped' ELSE 'processed' END AS outcome, 'pdf' AS source_type FROM f LEFT JOIN n ON n.place = f.place LEFT JOIN n m ON m.uri = f.uri""", "feed", "sources")(
    lambda f, d: upsert.upsert_documents(f.select(F.col("id").alias("place"), F.when(F.col("id") % 19 != 0, F.concat(F.lit("gs://docs/"), (F.col("id") % 400).cast("string"), F.lit(".pdf"))).alias("gcs_document_uri"), F.lit(None).cast("string").alias("source_type"), F.lit("pdf").alias("format")), d, "place").select("place", "id", "outcome", "source_type"))
q("G1s_select_episodes", """SELECT f.id, e.id AS existing_id, CASE WHEN e.id IS NULL THEN 'needs_processing' ELSE e.status END AS status, CASE WHEN e.id IS NULL THEN '' ELSE e.gcs_audio_uri END AS gcs_audio_uri FROM feed f LEFT JOIN (SELECT * FROM episodes WHERE id IN (SELECT min(id) FROM episodes GROUP BY audio_url)) e ON e.audio_url = f.audio_url WHERE f.id % 4 = 1""", "feed", "episodes")(
    lambda f, e: upsert.select_episodes(f, f.filter("id % 4 = 1").select("id", (-F.col("id")).alias("place")), e).select("id", "existing_id", "status", "gcs_audio_uri"))
q("G2_update_given", "SELECT e.id, coalesce(CASE WHEN e.id % 2 = 0 THEN 'indexing' END, status) AS status, coalesce(CASE WHEN e.id % 5 = 0 THEN 77 END, audio_file_size) AS audio_file_size FROM episodes e", "episodes")(
    lambda e: upsert.update_given(e, e.select("id", F.expr("CASE WHEN id % 2 = 0 THEN 'indexing' END").alias("status"), F.expr("CASE WHEN id % 5 = 0 THEN 77L END").alias("audio_file_size")), ["status", "audio_file_size"]).select("id", "status", "audio_file_size"))
q("G3_reindex_source", """SELECT id, source, chunk_text FROM podcast_chunks WHERE source NOT IN (SELECT source FROM podcast_chunks WHERE id % 50 = 1) UNION ALL SELECT -id, source, 'again' FROM podcast_chunks WHERE id % 50 = 1""", "podcast_chunks")(
    lambda c: upsert.reindex_source(c, c.filter("id % 50 = 1").select((-F.col("id")).alias("id"), "source", F.lit("again").alias("chunk_text")))[0])
KNOWN = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in kv)) for kv in K.PROTOTYPES.items())
q("G4_get_or_create_clusters", f"""WITH w AS (SELECT DISTINCT podcast_name AS name, CASE WHEN podcast_name LIKE '%1' THEN 'All of ' || podcast_name END AS description FROM episodes UNION ALL SELECT * FROM (VALUES {KNOWN}, ('Other', NULL)) v(name, description))
    SELECT id, name, NULL AS description FROM clusters UNION ALL SELECT (SELECT max(id) FROM clusters) + row_number() OVER (ORDER BY name), name, description FROM w""", "clusters", "episodes")(
    lambda c, e: upsert.get_or_create_clusters(c, e.select(F.col("podcast_name").alias("name"), F.when(F.col("podcast_name").endswith("1"), F.concat(F.lit("All of "), "podcast_name")).alias("description")).union(c.select("name", F.lit("")))
    .union(c.sparkSession.createDataFrame([(n, None) for n in (*K.PROTOTYPES, K.OTHER)], "name string, description string"))))
q("G5_assign_back", "SELECT id, CASE WHEN id % 3 = 0 THEN id % 4 ELSE cluster_id END AS cluster_id FROM units", "units")(
    lambda u: upsert.assign_back(u, u.filter("id % 3 = 0").select("id", (F.col("id") % 4).alias("value")), "cluster_id").select("id", "cluster_id"))
def resets(*tables):
    """Deleted rows of every stage, and what stays of each table with how many links."""
    given = dict(zip(("units", "macros", "clusters", "dimensions", "evidence"), tables, strict=True))
    out = None
    for stage in upsert.RESETS:
        after, gone = upsert.reset([stage], given)
        for name, df in after.items():
            links = F.count("macro_insight_id") + F.count("cluster_id") if name == "units" else F.count("cluster_id") if name == "macros" else F.lit(0)
            left = df.agg(F.count("*").alias("remaining"), links.cast("long").alias("links")).select(F.lit(stage).alias("stage"), F.lit(name).alias("table_name"), "remaining", "links")
            row = left.join(gone, "table_name", "left").select("stage", "table_name", F.coalesce("deleted", F.lit(0)).alias("deleted"), "remaining", "links")
            out = row if out is None else out.unionByName(row)
    return out


RESET = """WITH n AS (SELECT 'units' AS t, count(*) AS n, count(macro_insight_id) + count(cluster_id) AS k FROM units UNION ALL SELECT 'macros', count(*), count(cluster_id) FROM macros
    UNION ALL SELECT 'clusters', count(*), 0 FROM clusters UNION ALL SELECT 'dimensions', count(*), 0 FROM dimensions UNION ALL SELECT 'evidence', count(*), 0 FROM evidence),
    g(stage, t) AS (VALUES ('dimensions', 'evidence'), ('dimensions', 'dimensions'), ('clusters', 'macros'), ('clusters', 'clusters'), ('units', 'evidence'), ('units', 'dimensions'), ('units', 'units'))
    SELECT s.stage, n.t AS table_name, CASE WHEN g.t IS NULL THEN 0 ELSE n END AS deleted, CASE WHEN g.t IS NULL THEN n ELSE 0 END AS remaining, CASE WHEN g.t IS NOT NULL OR s.stage = 'clusters' AND n.t = 'units' THEN 0 ELSE k END AS links
    FROM (SELECT DISTINCT stage FROM g) s CROSS JOIN n LEFT JOIN g ON g.stage = s.stage AND g.t = n.t"""
q("G6_reset", RESET, "units", "macros", "clusters", "dimensions", "evidence")(resets)
q("G7_skip_existing", "SELECT id FROM episodes WHERE id NOT IN (SELECT episode_id FROM units WHERE episode_id IS NOT NULL)", "episodes", "units")(lambda e, u: upsert.without_insights(e, u, "episode_id").select("id"))
q("G8_index_if_missing", "SELECT id, title FROM sources WHERE title NOT IN (SELECT source FROM document_chunks)", "sources", "document_chunks")(lambda d, c: upsert.not_indexed(d, c, "title").select("id", "title"))
q("S6_backfill_file_size", """SELECT e.id, coalesce(audio_file_size, CASE WHEN e.id % 8 <> 2 AND gcs_audio_uri <> '' THEN e.id * 7 END) AS audio_file_size FROM episodes e""", "episodes")(
    lambda e: backfill_sizes(e, e.filter("gcs_audio_uri <> ''").select(F.col("gcs_audio_uri").alias("uri"), F.when(F.col("id") % 8 != 2, F.col("id") * 7).otherwise(0).alias("length"))).select("id", "audio_file_size"))

HAS = """s AS (SELECT e.*, podcast_name || ' - ' || episode_title IN (SELECT source FROM podcast_chunks) AS chunked, e.id IN (SELECT episode_id FROM units WHERE episode_id IS NOT NULL AND id IN (SELECT unit_insight_id FROM dimensions)) AS assessed FROM episodes e)"""
FILES = "CASE WHEN coalesce(gcs_transcript_uri, '') <> '' THEN CASE WHEN chunked THEN 'ready' ELSE 'indexing' END WHEN coalesce(gcs_audio_uri, '') <> '' THEN 'transcribing' ELSE 'needs_processing' END"
EP, DOC = ("episodes", "podcast_chunks", "units", "dimensions"), ("sources", "document_chunks", "units", "dimensions")
TRUSTED = "status IN ('downloading', 'transcribing', 'indexing', 'needs_processing', 'failed')"
q("T1_episode_status", f"WITH {HAS} SELECT id, CASE WHEN {TRUSTED} THEN status WHEN assessed THEN 'analyzed' ELSE {FILES} END AS derived_status FROM s", *EP)(lambda *t: status.episode_status(*t).select("id", "derived_status"))
q("T4_mark_analyzing", f"WITH {HAS} SELECT id, CASE WHEN {TRUSTED} THEN status WHEN assessed THEN 'analyzed' ELSE replace({FILES}, 'ready', 'analyzing') END AS derived_status FROM s", *EP)(lambda *t: status.mark_analyzing(status.episode_status(*t)).select("id", "derived_status"))
q("T5_live_episode_status", f"""WITH {HAS} SELECT id, CASE WHEN id % 13 = 0 THEN 'transcribing' WHEN id % 13 = 1 THEN 'indexing' WHEN assessed THEN 'analyzed' WHEN coalesce(gcs_transcript_uri, '') <> '' AND chunked THEN 'analyzing' ELSE {FILES} END AS derived_status FROM s""", *EP)(
    lambda e, *t: status.live_episode_status(e, e.filter("id % 13 < 3").select(F.col("id").alias("entity_id"), F.expr("CASE WHEN id % 13 = 2 THEN 'done' ELSE 'running' END").alias("status"), F.expr("CASE id % 13 WHEN 0 THEN 'transcribe' ELSE 'index' END").alias("stage")), *t, True).select("id", "derived_status"))
DHAS = """s AS (SELECT e.*, title IN (SELECT source FROM document_chunks) AS chunked, e.id IN (SELECT document_id FROM units WHERE document_id IS NOT NULL) AS known, e.id IN (SELECT document_id FROM units WHERE document_id IS NOT NULL AND id IN (SELECT unit_insight_id FROM dimensions)) AS assessed FROM sources e)"""
q("T2_document_status", f"WITH {DHAS} SELECT id, CASE WHEN assessed THEN 'analyzed' WHEN known THEN 'ready' ELSE status END AS derived_status, CASE WHEN chunked THEN 'ready' ELSE 'indexing' END AS after_failure FROM s", *DOC)(
    lambda *t: status.document_status(*t).select("id", "derived_status").join(status.document_status(*t, failed=True).select("id", F.col("derived_status").alias("after_failure")), "id"))
q("T3_document_processing_status", f"WITH {DHAS} SELECT id, CASE WHEN known THEN 'analyzed' WHEN coalesce(gcs_transcript_uri, '') <> '' THEN CASE WHEN chunked THEN 'ready' ELSE 'processing' END ELSE 'uploading' END AS derived_status FROM s", *DOC)(lambda *t: status.document_processing_status(*t).select("id", "derived_status"))
