"""The tables of the data model, derived from the driver's tables by SQL that Spark and other engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# the line items have no key: one of each order and number stands for all
LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_discount) AS l_discount, min(l_tax) AS l_tax, min(l_quantity) AS l_quantity FROM {lineitem} GROUP BY l_orderkey, l_linenumber) l"

INPUTS = {
    "episodes": """SELECT o_orderkey AS id, concat('Show ', CAST(o_custkey % 40 AS STRING)) AS podcast_name, concat('Episode ', CAST(o_orderkey AS STRING)) AS episode_title,
        concat('https://cdn.example/', CAST(o_orderkey % 700 AS STRING)) AS audio_url, o_orderdate AS episode_date,
        CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('gs://audio/', CAST(o_orderkey AS STRING), '.mp3') END AS gcs_audio_uri,
        CASE WHEN o_orderkey % 3 <> 0 THEN concat('gs://text/podcasts/transcripts/', CAST(o_orderkey AS STRING), '.json') END AS gcs_transcript_uri,
        CASE WHEN o_orderkey % 5 > 1 THEN CAST(o_orderkey * 100 AS BIGINT) END AS audio_file_size,
        CASE o_orderkey % 9 WHEN 0 THEN 'needs_processing' WHEN 1 THEN 'downloading' WHEN 2 THEN 'transcribing' WHEN 3 THEN 'indexing' WHEN 4 THEN 'ready' WHEN 5 THEN 'analyzing' WHEN 6 THEN 'analyzed' WHEN 7 THEN 'failed' END AS status,
        o_orderdate AS created_at, o_orderpriority AS priority FROM {orders}""",
    "sources": """SELECT p_partkey AS id, concat('Report ', CAST(p_partkey % 150 AS STRING)) AS title, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'pdf' WHEN 2 THEN 'txt' WHEN 3 THEN 'web' ELSE 'docx' END AS source_type,
        concat('gs://docs/', CAST(p_partkey % 180 AS STRING), '.pdf') AS gcs_document_uri, CASE WHEN p_partkey % 3 <> 1 THEN concat('gs://text/documents/transcripts/', CAST(p_partkey AS STRING), '.json') END AS gcs_transcript_uri,
        CASE p_partkey % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'uploading' WHEN 2 THEN 'indexing' ELSE 'failed' END AS status, p_size AS pages FROM {part}""",
    "units": """SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE concat('About ', c_mktsegment) END AS description,
        CASE c_custkey % 5 WHEN 0 THEN 'other' WHEN 1 THEN 'health_stake' WHEN 2 THEN 'health_stake' ELSE 'trend' END AS type,
        CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS episode_id, CASE WHEN c_custkey % 2 = 1 THEN c_custkey % 120 END AS document_id,
        CASE WHEN c_custkey % 5 < 3 THEN c_custkey % 11 END AS macro_insight_id, CASE WHEN c_custkey % 7 < 4 THEN c_custkey % 6 END AS cluster_id, c_acctbal AS weight FROM {customer}""",
    "macros": """SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 6 END AS cluster_id FROM {supplier}""",
    "clusters": """SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM {region}""",
    "dimensions": f"""SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_orderkey % 5 = 4 THEN l_orderkey % 400 - 1 ELSE l_orderkey % 400 END AS unit_insight_id,
        CASE l_linenumber % 6 WHEN 0 THEN 'adoption' WHEN 1 THEN 'expectation' WHEN 2 THEN 'progress' WHEN 3 THEN 'criticality' WHEN 4 THEN 'urgency' ELSE 'actionability' END AS dimension_type,
        CASE WHEN l_linenumber % 4 = 0 THEN 'Unknown' ELSE concat(l_returnflag, l_linestatus, CAST(l_partkey % 7 AS STRING)) END AS value, l_discount AS confidence FROM {LINES}""",
    "evidence": f"""SELECT l_orderkey * 100 + l_linenumber AS id, l_orderkey * 10 + l_linenumber AS dimension_id, concat(CASE WHEN l_suppkey % 2 = 0 THEN ' Lead' ELSE 'lead' END, CASE WHEN l_partkey % 3 = 0 THEN '\n\n' ELSE ' ' END, 'Text ', CAST(l_partkey % 9 AS STRING)) AS chunk_text,
        l_tax AS similarity_score, CASE WHEN l_linenumber % 2 = 0 THEN concat('Show ', CAST(l_suppkey % 40 AS STRING), ' - Episode ', CAST(l_orderkey AS STRING)) ELSE concat(' Report ', CAST(l_partkey % 170 AS STRING), ' ') END AS source_ref,
        CASE WHEN l_partkey % 4 <> 0 THEN l_quantity END AS start_time, CASE WHEN l_partkey % 4 = 0 THEN CAST(l_suppkey % 30 AS INT) END AS page FROM {LINES}""",
    "podcast_chunks": f"""SELECT l_orderkey * 10 + l_linenumber AS id, concat(CASE WHEN o_orderkey % 7 < 4 THEN 'Show ' ELSE 'Archive ' END, CAST(o_custkey % 40 AS STRING), ' - Episode ', CAST(o_orderkey AS STRING)) AS source, concat('Chunk ', CAST(l_linenumber AS STRING)) AS chunk_text
        FROM {{orders}} JOIN {LINES} ON o_orderkey = l_orderkey""",
    "document_chunks": f"""SELECT l_orderkey * 10 + l_linenumber AS id, concat('Report ', CAST(l_partkey % 90 AS STRING)) AS source, concat('Passage ', CAST(l_linenumber AS STRING)) AS chunk_text FROM {LINES}""",
    "feed": """SELECT event_id AS id, CAST(user_id AS BIGINT) AS feed_id, concat(event_type, CASE WHEN event_id % 5 = 0 THEN ' and mental health' WHEN event_id % 7 = 0 THEN ' Sleep' ELSE '' END) AS title,
        CASE WHEN event_id % 3 = 0 THEN 'Diet, gut and brain' WHEN event_id % 4 = 0 THEN NULL ELSE 'News' END AS description, concat('https://cdn.example/', CAST(event_id % 900 AS STRING)) AS audio_url, ts AS published_at FROM {events}""",
    "segments": """SELECT concat('talk ', CAST(conv_id AS STRING)) AS source, CAST(turn AS INT) AS idx, CASE WHEN turn % 5 = 3 THEN '  ' ELSE text END AS text, role FROM {conversations}""",
    "vectors": """SELECT vec_id AS id, embedding, CAST(label AS BIGINT) AS label FROM {embeddings}""",
    "texts": """SELECT doc_id, text, lang, source, n_chars FROM {documents}""",
}
BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data model."""
    sql = INPUTS[name]
    used = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def oracle(sql: str, *names: str) -> str:
    """The SQL of a query over tables of the data model."""
    ctes = [f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', INPUTS[n])})" for n in names]
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {', '.join(ctes)}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join(ctes)}, {body[5:]}"
    return f"WITH {', '.join(ctes)} {body}"
