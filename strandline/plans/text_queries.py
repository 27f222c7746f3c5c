"""Queries of transcripts, replies and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline import constants as K
from strandline.functions import text as T
from strandline.operators import chunking, replies, stats, transcripts
from strandline.plans.catalog_queries import q
from strandline.plans.inputs import load
from strandline.plans.registry import query

def episode_json():
    return F.to_json(F.struct(F.when(F.col("id") % 4 != 0, F.col("id")).alias("id"), F.when(F.col("id") % 6 != 0, F.col("title")).alias("title"), F.when(F.col("id") % 5 != 0, F.col("audio_url")).alias("enclosureUrl"), F.when(F.col("id") % 3 != 0, F.unix_timestamp("published_at")).otherwise(0).alias("datePublished"), "description"))


q("S7_read_feed", """SELECT CASE WHEN id % 4 <> 0 THEN id ELSE 0 END AS episode_id, feed_id, CASE WHEN id % 6 <> 0 THEN title ELSE 'Unknown' END AS title, CASE WHEN id % 5 <> 0 THEN audio_url ELSE '' END AS audio_url,
    CASE WHEN id % 3 <> 0 THEN date_trunc('second', published_at) END AS published_at, description FROM feed""", "feed")(
    lambda f: transcripts.parse_episodes(f.select("feed_id", episode_json().alias("item"))).select("episode_id", "feed_id", "title", "audio_url", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "description"))
q("S7_read_podcasts", """SELECT id AS feed_id, coalesce(CASE WHEN id % 6 <> 0 THEN title END, 'Unknown') AS title, CASE WHEN id % 2 = 0 THEN 'a' || CAST(id AS STRING) || '|b' ELSE '' END AS categories FROM feed""", "feed")(
    lambda f: transcripts.parse_podcasts(f.select(F.to_json(F.struct("id", F.when(F.col("id") % 6 != 0, F.col("title")).alias("title"), F.when(F.col("id") % 2 == 0, F.create_map(F.lit("1"), F.concat(F.lit("a"), F.col("id").cast("string")), F.lit("2"), F.lit("b"))).alias("categories"))).alias("item")))
    .select("feed_id", "title", F.array_join("categories", "|").alias("categories")))

TURN = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
GROUPED = "(SELECT source, list(text ORDER BY idx) AS texts, list(role ORDER BY idx) AS roles FROM segments GROUP BY 1)"


def collected(s, *fields):
    return s.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("idx", *fields))).alias("a"), F.min("idx").alias("n"))


def shaped(s):
    """Transcripts of six shapes from the turns of a conversation."""
    a, shape = collected(s, "text"), F.regexp_extract("source", r"\d+$", 0).cast("long") % 6
    texts, objects = F.transform("a", lambda x: x["text"]), F.transform("a", lambda x: F.struct(x["text"].alias("text")))
    as_json = (F.when(shape == 0, F.to_json(texts)).when(shape == 1, F.to_json(objects)).when(shape == 2, F.to_json(F.struct(objects.alias("segments"))))
               .when(shape == 3, F.to_json(F.struct(F.array_join(texts, " ").alias("transcript"), objects.alias("segments")))).when(shape == 4, F.to_json(F.struct(F.transform("a", lambda x: F.struct(x["text"].alias("transcript"))).alias("results"))))
               .otherwise(F.array_join(texts, " ")))
    return a.select("source", as_json.alias("json"))


q("P10_transcript_text", "SELECT source, array_to_string(list(text ORDER BY idx), chr(10)) AS text FROM segments GROUP BY 1", "segments")(
    lambda s: collected(s, "text").select("source", transcripts.transcript_text(F.to_json(F.struct(F.transform("a", lambda x: F.struct(x["text"].alias("text"))).alias("segments")))).alias("text")))
q("P10_transcript_shapes", """SELECT source, CASE WHEN k IN (0, 1) THEN array_to_string(list(text ORDER BY idx) FILTER (text <> ''), chr(10)) WHEN k = 2 THEN array_to_string(list(text ORDER BY idx) FILTER (text <> ''), chr(10)) WHEN k IN (3, 5) THEN array_to_string(list(text ORDER BY idx), ' ') ELSE array_to_string(list(text ORDER BY idx), chr(10)) END AS text
    FROM (SELECT *, CAST(regexp_extract(source, '[0-9]+$') AS BIGINT) % 6 AS k FROM segments) GROUP BY source, k""", "segments")(
    lambda s: shaped(s).select("source", transcripts.transcript_text("json").alias("text")))
q("P11_normalize_transcript", """SELECT source, idx, text, CAST(idx AS DOUBLE) AS start, CAST(CASE WHEN idx % 2 = 0 THEN idx ELSE idx + 1 END AS DOUBLE) AS "end", 'fr' AS language FROM segments""", "segments")(
    lambda s: collected(s, "text").select("source", transcripts.normalize_transcript(F.to_json(F.struct(F.transform("a", lambda x: F.struct(x["text"].alias("text"), F.array(x["idx"].cast("double"), F.when(x["idx"] % 2 == 1, x["idx"] + 1.0)).alias("timestamp"))).alias("chunks"), F.lit("fr").alias("language")), {"ignoreNullFields": "false"})).alias("t"))
    .select("source", F.col("t.language").alias("language"), F.posexplode("t.segments").alias("p", "s"))
    .select("source", F.col("p").alias("idx"), F.col("s.text").alias("text"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), "language"))
q("P12_words_to_segments", """SELECT source, idx, CAST(idx AS DOUBLE) AS start, idx + 0.5 AS "end", regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM segments WHERE role <> 'system' AND idx % 4 <> 3""", "segments")(
    lambda s: collected(s.filter("role <> 'system'"), "text").select("source", transcripts.words_to_segments(F.transform("a", lambda x: F.struct(x["text"].alias("transcript"), F.lit("").alias("language"), F.when(x["idx"] % 4 != 3, F.array(F.struct(F.lit("a").alias("word"), (x["idx"] + 0.0001).alias("start"), (x["idx"] + 0.1).alias("end")), F.struct(F.lit("b").alias("word"), (x["idx"] + 0.2).alias("start"), (x["idx"] + 0.5).alias("end")))).otherwise(F.array().cast("array<struct<word:string,start:double,end:double>>")).alias("words")))).alias("t"))
    .select("source", F.explode("t.segments").alias("s")).select("source", F.floor("s.start").cast("int").alias("idx"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("text")))
q("P13_pages_to_segments", rf"""SELECT source, array_to_string(list({TURN} ORDER BY idx), chr(10) || chr(10)) AS text, count(*) AS total_pages FROM segments WHERE {TURN} <> '' AND idx + 1 <= 6 GROUP BY 1""", "segments")(
    lambda s: transcripts.pages_to_segments(s.withColumn("page", F.col("idx") + 1), max_pages=6).select("source", "text", F.col("total_pages").cast("long").alias("total_pages")))
q("P14_transform_transcript", "SELECT source, count(*) AS segments, 'episode_title=' || source || ',lang=en' AS metadata FROM segments GROUP BY 1", "segments")(
    lambda s: collected(s, "text").select("source", transcripts.transform_transcript(F.to_json(F.struct(F.lit("en").alias("lang"), F.lit("old").alias("episode_title"), F.transform("a", lambda x: F.struct(x["text"].alias("text"))).alias("segments")))).alias("t"))
    .select("source", F.size("t.segments").cast("long").alias("segments"), F.array_join(F.array_sort(F.transform(F.map_entries(transcripts.merge_transcript("t.metadata", "source")), lambda e: F.concat(e.key, F.lit("="), e.value))), ",").alias("metadata")))
q("A13_segment_count", "SELECT source, count(*) AS segment_count FROM segments GROUP BY 1", "segments")(
    lambda s: stats.segment_count(collected(s, "text").withColumnRenamed("a", "segments")).select("source", F.col("segment_count").cast("long").alias("segment_count")))

q("P21_parse_insight_reply", "SELECT feed_id, id, title AS name, 'About ' || title AS description, 'trend' AS type FROM feed WHERE id % 3 <> 0", "feed")(
    lambda f: replies.parse_insights(f.select("feed_id", "id", F.to_json(F.struct(F.array(F.struct(F.concat(F.lit(" "), "title").alias("name"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("About "), "title")).otherwise(" ").alias("description"), F.lit("trend").alias("type"))).alias("insights"))).alias("reply"))).select("feed_id", "id", "name", "description", "type"))
q("P22_parse_dimension_reply", """SELECT id, CASE WHEN id % 4 <> 0 THEN 'progress' END AS dimension, CASE WHEN id % 5 = 0 OR id % 3 = 0 THEN 'Unknown' ELSE title END AS value, CASE WHEN id % 5 = 0 THEN 0.0 ELSE 0.5 END AS confidence,
    CASE WHEN id % 5 = 0 THEN 0 ELSE 1 END AS n_evidence, CASE WHEN id % 5 <> 0 THEN 'unknown' END AS source FROM feed""", "feed")(
    lambda f: replies.parse_dimensions(f.select("id", F.when(F.col("id") % 5 == 0, " ").otherwise("some").alias("context"), F.to_json(F.struct(F.when(F.col("id") % 4 != 0, " Progress ").otherwise("speed").alias("dimension"), F.when(F.col("id") % 3 != 0, F.col("title")).alias("value"), F.lit(0.5).alias("confidence"), F.array(F.struct(F.lit("seen").alias("text"))).alias("evidence"))).alias("reply")), context="context")
    .select("id", "dimension", "value", "confidence", F.size("evidence").alias("n_evidence"), F.get("evidence", F.lit(0))["source"].alias("source")))

LONG = rf"""(SELECT source, idx, t, lag(t) OVER (PARTITION BY source ORDER BY idx) AS b FROM (SELECT source, idx, {TURN} AS t FROM segments) WHERE t <> '')"""
CHUNKS = rf"""SELECT source || '_chunk_' || CASE WHEN idx < 10000 THEN lpad(CAST(idx AS STRING), 4, '0') ELSE CAST(idx AS STRING) END AS chunk_id, t AS text, CAST(idx AS DOUBLE) AS start, coalesce(list_last(string_split(regexp_replace(b, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))), '') AS overlap_text,
    len(regexp_split_to_array(t, '\s+')) AS word_count, length(t) AS char_count FROM {LONG}"""
SEEN = ("chunk_id", "text", "start", "overlap_text", "CAST(word_count AS BIGINT) AS word_count", "CAST(char_count AS BIGINT) AS char_count")
q("C1_chunk_podcast", CHUNKS, "segments")(lambda s: chunking.chunk_podcast(s.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("idx", "text", F.col("idx").cast("double").alias("start"), F.lit(None).cast("double").alias("end")))).alias("segments"))).selectExpr(*SEEN))
q("W1_overlap_lag", CHUNKS, "segments")(lambda s: chunking.chunk_segments_long(s.withColumns({"start": F.col("idx").cast("double"), "end": F.lit(None).cast("double")})).selectExpr(*SEEN))
q("C3_is_heading", r"""SELECT doc_id, place, p <> '' AND length(p) <= 200 AND (regexp_matches(p, '\A(?m:^#+\s+.+$)') OR regexp_matches(p, '\A(?m:^[A-Z][A-Z\s]{3,50}$)') OR regexp_matches(p, '\A(?m:^\d+\.\s+[A-Z].+$)') OR regexp_matches(p, '\A(?m:^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,5}:)') OR regexp_matches(p, '\A(?m:^(?:Chapter|Section|Part)\s+\d+)')) AS is_heading
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS place FROM texts)""", "texts")(
    lambda d: d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "p")).select("doc_id", "place", T.is_heading("p").alias("is_heading")))


def paragraphs():
    return F.replace("text", F.lit("\n"), F.lit("\n\n"))


HEAD = " OR ".join(f"regexp_matches(t, '\\A(?m:{h})')" for h in T.HEADINGS)
STRIP = "regexp_replace(%s, '^\\s+|\\s+$', '', 'g')"
# pages that are not blank, each with the number it names or the one after the last page's; their paragraphs; and the last heading so far
BLOCKS = rf"""g AS (SELECT doc_id, i, {STRIP % 'g'} AS t FROM (SELECT doc_id, unnest(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n{{3,}}|\x0c|(?:^|\n)---+(?:\n|$)')) AS g, generate_subscripts(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n{{3,}}|\x0c|(?:^|\n)---+(?:\n|$)'), 1) AS i FROM texts)),
    n AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, coalesce(nullif(CAST(coalesce(nullif(regexp_extract(t, '(?i)Page\s+([0-9]+)', 1), ''), nullif(regexp_extract(t, '-\s*([0-9]+)\s*-', 1), ''), nullif(regexp_extract(t, '(?m)^\s*([0-9]{{1,3}})\s*$', 1), '')) AS BIGINT), 0), NULL) AS mark FROM g WHERE t <> ''),
    m AS (SELECT doc_id, k, t, k + coalesce(last_value(mark - k IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k), 0) AS page FROM n),
    p AS (SELECT doc_id, k, page, {STRIP % 'x'} AS t, j FROM (SELECT doc_id, k, page, unnest(regexp_split_to_array(t, '\n\s*\n')) AS x, generate_subscripts(regexp_split_to_array(t, '\n\s*\n'), 1) AS j FROM m)),
    h AS (SELECT *, length(t) <= 200 AND ({HEAD}) AS heading FROM p WHERE t <> ''),
    blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS place, t AS text, heading, page, last_value(CASE WHEN heading THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k, j) AS section FROM h)"""
q("C2_split_blocks", f"WITH {BLOCKS} SELECT doc_id, CAST(place AS INT) AS place, text, CASE WHEN heading THEN 'heading' ELSE 'paragraph' END AS type, CAST(page AS INT) AS page, section FROM blocks", "texts")(
    lambda d: d.select("doc_id", F.posexplode(chunking.split_blocks(paragraphs())).alias("place", "b")).select("doc_id", "place", "b.text", "b.type", "b.page", "b.section"))
# greedy groups of blocks; long blocks in runs of sentences; small groups join their left neighbour. Each recursion goes over the rows of every document at once
GROUPS = rf"""b AS (SELECT *, length(text) AS n, length(text) > {K.CHUNK_MAX} AS long FROM blocks),
    w AS (SELECT doc_id, place, 0 AS gid, CASE WHEN long THEN 0 ELSE n END AS held, long AS empty FROM b WHERE place = 0 UNION ALL
        SELECT doc_id, place, gid + CASE WHEN fresh THEN 1 ELSE 0 END, CASE WHEN long THEN 0 WHEN fresh THEN n ELSE held + n END, long FROM (SELECT b.doc_id, b.place, b.n, b.long, w.gid, w.held, w.empty OR b.long OR b.heading OR w.held + b.n > {K.CHUNK_MAX} AS fresh FROM w JOIN b ON b.doc_id = w.doc_id AND b.place = w.place + 1)),
    z AS (SELECT doc_id, place, row_number() OVER (PARTITION BY doc_id, place ORDER BY j) AS j, t FROM (SELECT doc_id, place, {STRIP % 'x'} AS t, j FROM (SELECT doc_id, place, unnest(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS x,
        generate_subscripts(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), 1) AS j FROM b WHERE long)) WHERE t <> ''),
    y AS (SELECT doc_id, place, j, 0 AS sub, length(t) AS held FROM z WHERE j = 1 UNION ALL
        SELECT doc_id, place, j, sub + CASE WHEN fresh THEN 1 ELSE 0 END, CASE WHEN fresh THEN n ELSE held + 1 + n END FROM (SELECT z.doc_id, z.place, z.j, length(z.t) AS n, y.sub, y.held, y.held + length(z.t) + 1 > {K.CHUNK_MAX} AS fresh FROM y JOIN z ON z.doc_id = y.doc_id AND z.place = y.place AND z.j = y.j + 1)),
    gs AS (SELECT w.doc_id, w.gid, 0 AS sub, string_agg(b.text, chr(10) || chr(10) ORDER BY b.place) AS text, max_by(b.page, b.place) AS page, max_by(struct_pack(s := b.section), b.place).s AS section FROM w JOIN b USING (doc_id, place) WHERE NOT b.long GROUP BY ALL UNION ALL
        SELECT w.doc_id, w.gid, y.sub, string_agg(z.t, ' ' ORDER BY z.j), any_value(b.page), any_value(b.section) FROM y JOIN z USING (doc_id, place, j) JOIN w USING (doc_id, place) JOIN b USING (doc_id, place) GROUP BY w.doc_id, w.gid, y.sub),
    gn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gid, sub) - 1 AS i, length(text) AS n, {STRIP % f"right(array_to_string(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[-{K.CHUNK_OVERLAP_SENTENCES}:], ' '), {K.CHUNK_MIN // 2})"} AS ends FROM gs),
    c AS (SELECT doc_id, i, i AS number, n AS held FROM gn WHERE i = 0 UNION ALL
        SELECT doc_id, i, CASE WHEN joins THEN number ELSE i END, CASE WHEN joins THEN held + 2 + n ELSE n END FROM (SELECT gn.doc_id, gn.i, gn.n, c.number, c.held, gn.n < {K.CHUNK_MIN} AND c.held + 2 + gn.n <= {K.CHUNK_MAX} AS joins FROM c JOIN gn ON gn.doc_id = c.doc_id AND gn.i = c.i + 1)),
    k AS (SELECT doc_id, number, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text, arg_min(page, i) AS page, arg_min(section, i) AS section FROM c JOIN gn USING (doc_id, i) GROUP BY ALL)
    SELECT k.doc_id || '_chunk_' || CASE WHEN number < 10000 THEN lpad(CAST(number AS STRING), 4, '0') ELSE CAST(number AS STRING) END AS chunk_id, k.doc_id AS source, k.text, CAST(k.page AS INT) AS page, k.section, coalesce(g.ends, '') AS overlap_text,
    CAST(len(regexp_split_to_array({STRIP % 'k.text'}, '\s+')) AS BIGINT) AS word_count, CAST(length(k.text) AS BIGINT) AS char_count, CASE WHEN coalesce(g.ends, '') <> '' THEN g.ends || chr(10) || chr(10) || k.text ELSE k.text END AS full_text FROM k LEFT JOIN gn g ON g.doc_id = k.doc_id AND g.i = k.number - 1"""
SEGMENT_BLOCKS = rf"""p AS (SELECT source AS doc_id, idx AS k, CASE WHEN idx % 3 <> 0 THEN idx ELSE 1 END AS page, {STRIP % 'x'} AS t, j FROM (SELECT *, unnest(regexp_split_to_array(text, '\n\s*\n')) AS x, generate_subscripts(regexp_split_to_array(text, '\n\s*\n'), 1) AS j FROM segments)),
    h AS (SELECT *, length(t) <= 200 AND ({HEAD}) AS heading FROM p WHERE t <> ''),
    blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS place, t AS text, heading, page, last_value(CASE WHEN heading THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k, j) AS section FROM h)"""
WIDE = ("chunk_id", "source", "text", "page", "section", "overlap_text", "CAST(word_count AS BIGINT) AS word_count", "CAST(char_count AS BIGINT) AS char_count", "full_text")


def as_segments(s):
    return s.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: F.struct(x["text"].alias("text"), F.when(x["idx"] % 3 != 0, x["idx"]).alias("page"))).alias("segments"))


q("C4_chunk_segments", f"WITH RECURSIVE {SEGMENT_BLOCKS}, {GROUPS}", "segments")(lambda s: chunking.segment_chunks(as_segments(s)).selectExpr(*WIDE))
q("C5_C6_document_chunks", f"WITH RECURSIVE {BLOCKS}, {GROUPS}".replace("SELECT k.doc_id || '_chunk_'", "SELECT 'doc ' || CAST(k.doc_id AS STRING) || '_chunk_'").replace("k.doc_id AS source", "'doc ' || CAST(k.doc_id AS STRING) AS source"), "texts")(
    lambda d: chunking.document_chunks(d.select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("source"), paragraphs().alias("text"))).selectExpr(*WIDE))
q("C7_chunk_windows", """WITH RECURSIVE w AS (SELECT doc_id, text, 0 AS k, 1 AS s FROM texts UNION ALL SELECT doc_id, text, k + 1, s + 4500 FROM w WHERE s + 5000 <= length(text))
    SELECT doc_id, CAST(k AS BIGINT) AS "window", substr(text, s, 5000) AS text FROM w""", "texts")(
    lambda d: chunking.chunk_windows(d, "doc_id", "text", 5000, 500, 0).select("doc_id", F.col("window").cast("long").alias("window"), "text"))
