"""Work that must not pile up in one task, nor grow faster than the tables; results are those of plain versions."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_models import cosines, frame, plain_greedy

from strandline.operators import assessment, catalog, chunking, extraction, greedy, search, similarity


def test_recent_by_parts_of_a_second(spark):
    feed = spark.sql("SELECT id, CAST(t AS timestamp_ntz) AS published_at FROM VALUES (1, '2024-01-15 00:00:00'), (2, '2024-01-15 00:00:00.000001'), (3, '2024-01-14 23:59:59.9'), (4, NULL), (5, '2024-01-15 00:00:01') v(id, t)")
    assert sorted(r.id for r in catalog.recent_episodes(feed, 1705276800).collect()) == [2, 5]
    assert catalog.recent_episodes(feed, None).count() == 5


def test_references_without_a_key_do_not_meet(spark):
    episodes = spark.createDataFrame([(7, "Show", "One - two"), (5, "Show", "One - two"), (9, "", "x")], "id long, podcast_name string, episode_title string")
    documents = spark.createDataFrame([(3, "Paper"), (2, "Paper"), (4, "Show - None"), (6, "")], "id long, title string")
    refs = spark.createDataFrame([(0, " Show - One - two "), (1, "Paper "), (2, "Show - None"), (3, "Nothing"), (4, "No - thing"), (5, None), (6, " "), (7, " - x")], "id long, source_ref string")
    got = {r.id: (r.source_kind, r.source_id) for r in catalog.resolve_source_ref(refs, episodes, documents).collect()}
    assert got == {0: ("podcast", 5), 1: ("document", 2), 2: ("document", 4), 3: (None, None), 4: (None, None), 5: (None, None), 6: ("document", 6), 7: ("podcast", 9)}
    for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.set(c, "false" if c.endswith("enabled") else "-1")
    try:
        many = spark.range(4000, numPartitions=4).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("Report "), "id")).alias("source_ref"))
        out = catalog.resolve_source_ref(many, episodes, documents)
        most = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.max("n")).head()[0]
        assert out.count() == 4000 and most < 1200
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_search_for_queries_of_one_vector(spark, monkeypatch):
    asked = []
    whole = assessment.search_many
    monkeypatch.setattr(assessment, "search_many", lambda q, *a: (asked.append(q.count()), whole(q, *a))[1])
    units = spark.range(60).select("id", F.concat(F.lit("Unit "), (F.col("id") % 3).cast("string")).alias("name"), F.lit("").alias("description"), F.lit("trend").alias("type"), F.lit(None).cast("array<float>").alias("embedding"))
    chunks = spark.createDataFrame([("c1", "podcast", "s", "one", [1.0, 0.0]), ("c2", "podcast", "s", "two", [0.0, 1.0])], "chunk_id string, kind string, source string, text string, embedding array<float>")
    none = spark.createDataFrame([], "unit_insight_id long, dimension_type string")
    embedder = lambda: lambda texts: [[1.0, float("Unit 1" in t)] for t in texts]
    model = lambda: lambda prompts: [json.dumps({"dimension": p.split("\n")[0].split(": ")[1], "value": p.split("Insight: ")[1].split("\n")[0] + p.split("\n")[-1], "confidence": 1.0, "evidence": []}) for p in prompts]
    rows = assessment.assess_dimensions(units, none, chunks, embedder, model, k=1, least=0.5).collect()
    assert len({(r.insight_id, r.dimension_type) for r in rows}) == len(rows) == 180
    assert all(r.value == f"Unit {r.insight_id % 3}one" and r.error is None for r in rows if r.dimension_type in assessment.K.DIMENSION_HINTS)
    assert asked[0] <= 2


@pytest.mark.parametrize("least,most,bases", [(2, 40, 16), (3, 40, 16), (5, 300, 3), (5, 1, 16)])
def test_many_links_are_not_made_all_at_once(spark, monkeypatch, least, most, bases):
    rng = np.random.default_rng(least + most)
    v = rng.normal(size=(90, 4)).astype(np.float32)
    v[rng.random(90) < 0.1] = v[0]
    s, rows = cosines(v), []
    near = [[j for j in range(90) if j != i and s[i, j] >= 0.7] for i in range(90)]
    for name, value in (("DENSE", 0), ("BASES", bases), ("DEGREE_SAMPLE", 8)):
        monkeypatch.setattr(similarity, name, value)
    monkeypatch.setattr(greedy, "MOST", most)
    whole = similarity.similarity_edges
    monkeypatch.setattr(similarity, "similarity_edges", lambda df, *a: (rows.append(df.count()), whole(df, *a))[1])
    assert {r.node: r.leader for r in similarity.greedy_clusters(frame(spark, v), 0.7, least=least).collect()} == plain_greedy(90, near, least)
    assert rows[0] < 60

    source, kept, want = [i // 6 for i in range(90)], [], {}
    for g in range(15):
        fresh = []
        for i in range(6 * g, 6 * g + 6):
            found = [(round(s[i, j], 9), -j) for j in kept if s[i, j] >= 0.7]
            want[i] = -max(found)[1] if found else i
            fresh += [] if found else [i]
        kept += fresh
    assert {r.node: r.target for r in similarity.dedup_across(frame(spark, v, source_order=source), threshold=0.7).collect()} == want
    assert rows[1] < 60


def test_pieces_of_a_column(spark, monkeypatch):
    from strandline.functions import pieces as P

    monkeypatch.setattr(P, "PIECE_SIZE", 1000)
    s = pd.Series(["a" * 400, None, "", "b" * 3000, "c"] * 9, dtype=object)
    for step in (1, 4):
        parts = list(P.pieces(s, step=step))
        assert pd.concat(parts).tolist() == s.tolist() and len(parts) > 5 and all(len(x) % step == 0 for x in parts[:-1])
        assert max(sum(map(len, filter(None, x))) for x in parts) <= 1000 + 3400 * step
    assert list(P.pieces(s[:0])) == []
    # what leaves the function is no batch of the input, but a piece of it
    out = list(chunking.per_text(lambda t: [t], "array<string>").func(iter([s])))
    assert len(out) > 5 and pd.concat(out).tolist() == [[] if x is None else [x] for x in s]


def test_windows_are_asked_once(spark, tmp_path):
    def model():
        def run(prompts):
            for p in prompts:
                with open(tmp_path / "asked", "a") as f:
                    f.write("x")
                yield json.dumps({"insights": [{"name": p[:4], "description": p[:9], "type": "trend", "evidence": ""}], "extraction_notes": "n"})

        return run

    docs = spark.createDataFrame([("a", "one. " * 60), ("b", "two. "), ("c", "six. " * 30)], "source string, text string")
    insights, notes = extraction.extract_insights(docs, model, search.hashing_embedder(), size=100, overlap=10, search=20)
    assert {r.source for r in insights.collect()} == {"a", "b", "c"} == {r.source for r in notes.collect()}
    windows = sum(len(chunking.windows_of(r.text, 100, 10, 20)) for r in docs.collect())
    assert len((tmp_path / "asked").read_text()) == windows > 3


def test_lists_send_each_query_once(spark, tmp_path, monkeypatch):
    from strandline.operators import lists

    rng = np.random.default_rng(6)
    chunks = frame(spark, rng.normal(size=(300, 5)).astype(np.float32), kind=["podcast"] * 300).select(F.col("id").cast("string").alias("chunk_id"), "kind", F.col("kind").alias("source"), "embedding", "id")
    queries = chunks.filter("id % 10 = 0").select(F.col("id").alias("query_id"), "embedding")
    index = lists.build_lists(chunks, str(tmp_path / "lists"))
    key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())
    want, sent, whole = key(search.search_many(queries, chunks, 9)), [], lists.partial_top
    monkeypatch.setattr(lists, "partial_top", lambda ids, *a: (sent.append((len(ids), sum(map(len, a[1].values())))), whole(ids, *a))[1])
    assert key(lists.search_lists(queries, index, 9)) == want
    assert sent[1][0] == 30 < sent[1][1]
    monkeypatch.setattr(lists, "SMALL_SIDE_BYTES", 8 * 104)
    assert key(lists.search_lists(queries, index, 9)) == want and max(n for n, _ in sent[2:]) == 8


def test_every_transcript_is_a_file_of_one_folder(spark, sf_dir, monkeypatch):
    import os

    from strandline.plans import vector_queries
    from strandline.plans.queries import QUERIES

    seen, whole = [], vector_queries.objects.read_transcripts
    monkeypatch.setattr(vector_queries.objects, "read_transcripts", lambda s, p: (seen.append([x for x in os.listdir(p) if x.startswith(("part-", "file="))]), whole(s, p))[1])
    n = QUERIES["S1_read_transcripts"](spark, sf_dir).count()
    assert len(seen[0]) == n > 1 and all(x.endswith(".txt") for x in seen[0])
