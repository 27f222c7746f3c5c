"""Operators without SQL against plain Python restatements on small random inputs."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline import constants as K
from strandline.functions import text as T
from strandline.operators import chunking, clusters, greedy, search, similarity, transcripts, views


def vectors(seed, n, dim=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[rng.random(n) < 0.2] = v[0]  # equal vectors
    return v.astype(np.float32)


def frame(spark, v, **more):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(v)), "embedding": [x.tolist() for x in v], **more}))


def cosines(v):
    x = v.astype(float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def plain_greedy(n, near, least, weight=None):
    """Leader of each node; near: sets of neighbours."""
    weight = weight or [1] * n
    free, leader = set(range(n)), {i: None for i in range(n)}
    for base in range(n):
        if base in free:
            members = [base] + [j for j in near[base] if j in free]
            if sum(weight[j] for j in members) >= least:
                free -= set(members)
                leader |= dict.fromkeys(members, base)
    return leader


@pytest.mark.parametrize("seed,n,most,least", [(0, 1, 1, 2), (1, 12, 1, 2), (2, 40, 9, 3), (3, 60, 50_000, 5), (3, 60, 20, 2), (4, 60, 30, 5)])
def test_greedy_clusters(spark, monkeypatch, seed, n, most, least):
    monkeypatch.setattr(greedy, "MOST", most)  # rounds, one task, and both
    v = vectors(seed, n)
    s = cosines(v)
    near = [[j for j in range(n) if j != i and s[i, j] >= 0.8] for i in range(n)]
    assert {r.node: r.leader for r in similarity.greedy_clusters(frame(spark, v), 0.8, least=least).collect()} == plain_greedy(n, near, least)


@pytest.mark.parametrize("seed,most,least", [(0, 10, 1), (1, 30, 2), (2, 15, 3), (3, 40, 5), (4, 10_000, 4)])
def test_ordered_greedy_of_weighted_nodes(spark, seed, most, least):
    rng = random.Random(seed)
    n = 50
    edges = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(60)) if a < b}
    near = [[j for j in range(n) if (i, j) in edges or (j, i) in edges] for i in range(n)]
    weight = [rng.choice([1, 1, 1, 2, 3]) for _ in range(n)]
    nodes = spark.createDataFrame(list(enumerate(weight)), "node long, weight long")
    got = {r.node: r.leader for r in greedy.ordered_greedy(spark.createDataFrame(sorted(edges) + [(b, a) for a, b in sorted(edges)[:9]], "a long, b long"), nodes, least, most).collect()}
    want = plain_greedy(n, near, least, weight)
    assert got == {i: x for i, x in want.items() if x is not None and (near[i] and (x != i or any(want[j] == i for j in near[i]) or i in got))}
    assert all(want[i] == i for i in range(n) if i not in got and weight[i] >= least), "what is not taken and weighs enough leads itself"


@pytest.mark.parametrize("least,most", [(1, 60_000), (2, 60_000), (3, 60_000)])
def test_a_long_chain_takes_few_rounds(spark, monkeypatch, least, most):
    n, rounds = 100_000, []
    monkeypatch.setattr(greedy, "one_task", lambda *a, f=greedy.one_task: (rounds.append(1), f(*a))[1])
    got = greedy.ordered_greedy(spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), least=least, most=most).toPandas().set_index("node").leader
    want = plain_greedy(n + 1, [[j for j in (i - 1, i + 1) if 0 <= j <= n] for i in range(n + 1)], least)
    assert all(got.get(i) == x or (x == i and i not in got.index) for i, x in want.items() if x is not None) and len(got) <= sum(x is not None for x in want.values())
    assert len(rounds) <= 5


def test_copies_of_one_vector_have_few_edges(spark):
    v = vectors(5, 30)
    v = np.concatenate([v, np.repeat(v[7:8], 3000, 0), np.zeros((4, 3), np.float32)])
    df = frame(spark, v).withColumn("source_order", F.col("id") % 40)
    members, classes = similarity.classes_of(df)
    assert members.count() == 3030 and classes.count() <= 31 and similarity.similarity_edges(classes, 0.8, "rep").count() < 31 * 31
    s = cosines(np.where(v == 0, 1e-9 * np.arange(1, 4, dtype=np.float32), v)[:3030])
    near = [np.flatnonzero(s[i] >= 0.8).tolist() for i in range(3030)]
    want = plain_greedy(3034, [[j for j in x if j != i] for i, x in enumerate(near)] + [[]] * 4, 2)
    assert {r.node: r.leader for r in similarity.greedy_clusters(df, 0.8).collect()} == want
    kept, target = [], {}
    for g in range(40):
        fresh = []
        for i in range(g, 3034, 40):
            found = [(round(s[i, j], 9), -(j % 40), -j) for j in kept if s[i, j] >= 0.9] if i < 3030 else []
            target[i] = -max(found)[2] if found else i
            if not found and i < 3030:
                fresh.append(i)
        kept += fresh
    assert {r.node: r.target for r in similarity.dedup_across(df, threshold=0.9).collect()} == target


@pytest.mark.parametrize("seed,most", [(0, 1), (1, 50_000), (2, 9)])
def test_dedup_across(spark, monkeypatch, seed, most):
    monkeypatch.setattr(greedy, "MOST", most)
    v, n = vectors(seed, 40), 40
    s, source, kept, want = cosines(v), [i // 4 for i in range(n)], [], {}
    for g in range(n // 4):
        fresh = []
        for i in range(4 * g, 4 * g + 4):
            best, at = 0.0, None
            for j in kept:
                if s[i, j] > best + 1e-12:
                    best, at = s[i, j], j
            if at is not None and best >= 0.9:
                want[i] = at
            else:
                want[i] = i
                fresh.append(i)
        kept += fresh
    got = similarity.dedup_across(frame(spark, v, source_order=source), threshold=0.9)
    assert {r.node: r.target for r in got.collect()} == want


@pytest.mark.parametrize("seed", [0, 1])
def test_dedup_within_and_prototypes(spark, seed):
    v = vectors(seed, 50)
    s, want = cosines(v), []
    for g in range(5):
        kept = []
        for i in range(10 * g, 10 * g + 10):
            if all(s[i, j] < 0.9 for j in kept):
                kept.append(i)
        want += kept
    df = frame(spark, v, g=[i // 10 for i in range(50)])
    assert sorted(r.id for r in similarity.dedup_within(df, "g", "id").collect()) == want
    p = [(f"p{i}", v[i].tolist()) for i in range(6)]
    got = {r.id: (r.cluster_name, r.is_other) for r in clusters.assign_clusters(df, p, 0.7).collect()}
    for i in range(50):
        best = max(range(6), key=lambda k: (round(s[i, k], 9), -k))
        assert got[i] == ((f"p{best}", False) if s[i, best] >= 0.7 else (K.OTHER, True))
    assert clusters.assign_clusters(df, []).filter("is_other and score = 0").count() == 50


def test_block_join_equals_broadcast(spark, monkeypatch):
    v = vectors(5, 60)
    df = frame(spark, v)
    want = sorted((r.a, r.b) for r in similarity.similarity_edges(df, 0.6).collect())
    both = sorted((r.a, r.b) for r in similarity.cosine_join(df, df, 0.6).collect())
    assert both == sorted(want + [(b, a) for a, b in want] + [(i, i) for i in range(60)])
    monkeypatch.setattr(similarity, "SMALL_SIDE_BYTES", 1)
    for rows in (1000, 20, 7):
        assert sorted((r.a, r.b) for r in similarity.similarity_edges(df, 0.6, block_rows=rows).collect()) == want and want
        assert sorted((r.a, r.b) for r in similarity.cosine_join(df, df, 0.6, block_rows=rows).collect()) == both


def test_vectors_that_are_missing(spark):
    """Null and zero vectors are near to nothing: dedup keeps them, clusters leave them out."""
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, None), (3, 0, [2.0, 0.0]), (4, 0, [0.0, 0.0]), (5, 0, None), (6, 0, [0.0, 3.0])], "id long, g int, embedding array<float>")
    assert sorted(r.id for r in similarity.dedup_within(df, "g", ["g", "id"]).collect()) == [1, 2, 4, 5, 6]
    assert {r.id: r.cluster_name for r in clusters.assign_clusters(df, [("a", [5.0, 0.0]), ("b", [5.0, 0.0]), ("c", [0.0, 1.0])]).collect()} == {1: "a", 3: "a", 6: "c"}
    assert clusters.assign_clusters(df.limit(0), [("a", [5.0, 0.0])]).count() == 0 and clusters.assign_clusters(df, []).count() == 3


def plain_step(units, macros, threshold):
    """One step of discovery, in order, over dicts id -> vector and macro -> (name, centroid, member vectors): returns links and changes macros."""
    unit = lambda x: x / np.linalg.norm(x)
    links, gained = {}, set()
    for i, v in sorted(units.items()):
        scores = [(round(float(unit(v) @ unit(c)), 12), -m) for m, (_, c, _) in macros.items()]
        if scores and max(scores)[0] >= threshold and max(scores)[0] > 0:
            links[i] = -max(scores)[1]
    for i, m in links.items():
        macros[m][2].append(units[i])
        gained.add(m)
    free = [i for i in sorted(units) if i not in links]
    new, taken = [], set()
    for i in free:
        if i not in taken:
            own = [i] + [j for j in free if j != i and j not in taken and unit(units[i]) @ unit(units[j]) >= threshold]
            if len(own) > 1:
                taken |= set(own)
                new.append(own)
    for own in new:
        m = max(macros, default=0) + 1
        macros[m] = (f"n{min(own)}", None, [units[j] for j in own])
        gained.add(m)
        links |= dict.fromkeys(own, m)
    for m in gained:
        name, _, members = macros[m]
        macros[m] = (name, unit(np.mean([unit(x) for x in members], 0)), members)
    return links


@pytest.mark.parametrize("seed", [0, 1])
def test_discovery_over_batches(spark, seed, tmp_path):
    """The stream's tables after three batches are those of three plain steps; a batch that comes again changes nothing."""
    from strandline.streaming.status import discover_batches, discovered

    v = vectors(seed, 45).astype(float)
    df = frame(spark, v.astype(np.float32)).withColumn("name", F.concat(F.lit("n"), F.col("id").cast("string"))).select("id", "name", "embedding")
    links, macros, free = {}, {}, {}
    inbox, state = str(tmp_path / "inbox"), str(tmp_path / "state")
    for k in range(3):
        df.filter(f"id % 3 = {k}").coalesce(1).write.mode("append").parquet(inbox)
        for _ in range(2):
            discover_batches(spark.readStream.schema(df.schema).parquet(inbox), state, str(tmp_path / "marks"), 0.8).awaitTermination()
        free |= {i: v[i] for i in range(k, 45, 3)}
        links |= plain_step(free, macros, 0.8)
        free = {i: x for i, x in free.items() if i not in links}
    units, table = discovered(spark, state, 3)
    assert {r.id: r.macro_id for r in units.collect()} == {i: links.get(i) for i in range(45)} and links
    got = {r.id: (r.name, r.centroid_embedding) for r in table.collect()}
    assert {m: n for m, (n, _) in got.items()} == {m: n for m, (n, _, _) in macros.items()}
    assert all(np.allclose(got[m][1], c, atol=1e-5) for m, (_, c, _) in macros.items())


def test_resets(spark):
    from strandline.operators import upsert

    t = {n: spark.range(3).selectExpr("id", "id AS macro_insight_id", "id AS cluster_id") for n in ("units", "macros", "clusters", "dimensions", "evidence")}
    after, gone = upsert.reset(["dimensions", "clusters"], t)
    assert {r.table_name: r.deleted for r in gone.collect()} == dict.fromkeys(["evidence", "dimensions", "macros", "clusters"], 3)
    assert {n: df.count() for n, df in after.items()} == {"units": 3, "macros": 0, "clusters": 0, "dimensions": 0, "evidence": 0}
    assert after["units"].filter("macro_insight_id is null and cluster_id is null").count() == 3
    after, gone = upsert.reset(["units", "dimensions"], t)
    assert sorted(r.table_name for r in gone.collect()) == ["dimensions", "evidence", "units"] and after["macros"].filter("cluster_id is not null").count() == 3


def test_search_ties_and_blocks(spark, monkeypatch):
    v = vectors(7, 80)
    df = frame(spark, v).select("id", "embedding", F.col("id").cast("string").alias("chunk_id"), F.when(F.col("id") % 2 == 0, "podcast").otherwise("document").alias("kind"), F.lit("s").alias("source"))
    q = df.filter("id < 9").select(F.col("id").alias("query_id"), "embedding")
    key = lambda s, i: (-round(s, 12), "document" if i % 2 == 0 else "podcast", str(i))  # noqa: E731  podcasts come first
    s = cosines(v)
    want = {(i, r + 1): str(j) for i in range(9) for r, j in enumerate(sorted(range(80), key=lambda j: key(s[i, j], j))[:4])}
    for block in (512, 2):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        assert {(r.query_id, r.rank): r.chunk_id for r in search.search_many(q, df, 4).collect()} == want


def test_search_by_source(spark, monkeypatch):
    """Each query sees the chunks of its own source alone; blocks of queries and passes make no difference."""
    v = vectors(8, 70)
    df = frame(spark, v).select("id", "embedding", F.col("id").cast("string").alias("chunk_id"), F.lit("podcast").alias("kind"), (F.col("id") % 4).cast("string").alias("source"))
    q = df.filter("id < 12").select(F.col("id").alias("query_id"), "embedding", F.when(F.col("id") == 5, "none").otherwise(F.col("source")).alias("source"))
    s = cosines(v)
    want = {(i, r + 1): str(j) for i in range(12) if i != 5 for r, j in enumerate(sorted((j for j in range(70) if j % 4 == i % 4), key=lambda j: (-round(s[i, j], 12), str(j)))[:3])}
    for block, held in ((512, 64 << 20), (2, 300)):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        monkeypatch.setattr(search, "SMALL_SIDE_BYTES", held)
        assert {(r.query_id, r.rank): r.chunk_id for r in search.search_many(q, df, 3, True).collect()} == want


def test_drop_overlaps(spark):
    rng = random.Random(3)
    rows = [(g, [(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 4))),) for _ in range(rng.randint(0, 7))]) for g in range(40)]
    df = spark.createDataFrame(rows, "g int, c array<struct<text:string>>").select("g", search.drop_overlaps("c", 0.6).alias("k"))

    def jaccard(a, b):
        a, b = set(a.split()), set(b.split())
        return len(a & b) / len(a | b) if a and b else 0.0

    got = {r.g: [x.text for x in r.k] for r in df.collect()}
    for g, items in rows:
        kept = []
        for (t,) in items:
            if all(jaccard(t, k) < 0.6 for k in kept):
                kept.append(t)
        assert got[g] == kept


def test_transcript_shapes(spark):
    cases = [
        ('"plain"', "plain"), ('["a", {"text": "b"}, {"content": "c"}, {"text": "", "transcript": "d"}, {"x": 1}]', "a\nb\nc\nd"), ('{"text": "", "content": "x"}', ""), ('{"transcript": "t"}', "t"),
        ('{"segments": [{"text": "a"}, {"text": ""}, {"x": 1}, {"text": "b"}]}', "a\nb"), ('{"results": [{"text": "a"}, {"transcript": "b"}, {}]}', "a\nb\n"), ("no json", "no json"), (None, None),
    ]
    df = spark.createDataFrame([(i, j) for i, (j, _) in enumerate(cases)], "i int, j string").select("i", transcripts.transcript_text("j").alias("t"))
    assert [r.t for r in df.orderBy("i").collect()] == [t for _, t in cases]


def test_normalized_shapes(spark):
    cases = ['"hi"', '{"chunks": [{"text": "a", "timestamp": [1, null]}, {"text": "b", "timestamp": [null, 2]}, "c"]}', '{"text": "t", "segments": [], "language": "de"}', '{"segments": [{"text": "a", "start": 1, "end": 2}, {}]}']
    df = spark.createDataFrame([(i, j) for i, j in enumerate(cases)], "i int, j string").select("i", transcripts.normalize_transcript("j").alias("t"))
    got = [(r.t.text, [tuple(s) for s in r.t.segments], r.t.language) for r in df.orderBy("i").collect()]
    assert got == [("hi", [("hi", 0, 0)], "en"), ("a b c", [("a", 1, 1), ("b", 0, 2), ("c", 0, 0)], "en"), ("t", [], "de"), ("a ", [("a", 1, 2), ("", 0, 0)], "en")]


def test_blocks_and_chunks():
    text = "# One\n\nFirst paragraph.\n\f\nPage 7\n\nNext page.\n\n\n\nINTRODUCTION PART\n\nBody."
    blocks = chunking.blocks_of(chunking.numbered_pages(text))
    assert [(b.text, b.heading, b.page, b.section) for b in blocks] == [
        ("# One", True, 1, "# One"), ("First paragraph.", False, 1, "# One"), ("Page 7", False, 7, "# One"), ("Next page.", False, 7, "# One"), ("INTRODUCTION PART", True, 8, "INTRODUCTION PART"), ("Body.", False, 8, "INTRODUCTION PART")]
    chunks = chunking.chunks_of(blocks, merge=False)
    assert [c.text for c in chunks] == ["# One\n\nFirst paragraph.\n\nPage 7\n\nNext page.", "INTRODUCTION PART\n\nBody."]
    merged = chunking.chunks_of(blocks)
    assert len(merged) == 1 and merged[0].section == "# One" and merged[0].number == 0


@pytest.mark.parametrize("seed", range(20))
def test_chunk_invariants(seed):
    rng = random.Random(seed)
    paragraphs = [" ".join(rng.choice(["Word", "then.", "end!", "Title:"]) for _ in range(rng.choice([1, 5, 40, 300]))) for _ in range(rng.randint(0, 12))]
    blocks = chunking.blocks_of([(1, "\n\n".join(paragraphs))])
    plain = chunking.chunks_of(blocks, 200, 40, merge=False)
    assert "".join("".join(c.text for c in plain).split()) == "".join("".join(paragraphs).split())
    for a, b in zip(plain, plain[1:]):
        assert "".join(a.text.split()).endswith("".join(b.overlap.split())[-5:])
    for c in chunking.chunks_of(blocks, 200, 40):
        # joiners don't count in the limit; a long sentence stays whole
        assert len(c.text.replace("\n\n", "")) <= 200 or len(chunking.sentence_groups(c.text, 200)) == 1 or "\n\n" in c.text


def test_windows():
    text = "".join(f"Sentence {i}. " for i in range(2000))
    out = chunking.windows_of(text, 5000, 300, 500)
    assert out[0] + "".join(w[300:] for w in out[1:]) == text and all(len(w) <= 5000 for w in out)
    assert chunking.windows_of("short") == ["short"] and chunking.windows_of("") == [""]
    with pytest.raises(ValueError):
        chunking.windows_of("x", 1000, 600, 500)


def test_format_and_label(spark):
    df = spark.createDataFrame([(None, "a/b.PDF", "x", "web"), ("txt", "", "", None), ("odd", "x", "y.docx", "md")], "e string, p string, f string, s string")
    assert [r[0] for r in df.select(T.resolve_format("e", "p", "f", "s")).collect()] == ["pdf", "txt", "docx"]
    replies = spark.createDataFrame([('{"label": " A "}',), ('so "label": "B" it is',), ("'C'",), ("x" * 120,), ("",)], "r string")
    assert [r[0] for r in replies.select(T.parse_label("r")).collect()] == ["A", "B", "C", None, None]


def test_evidence_sampling(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.choice([None, float(rng.randint(0, 50)) + i / 1000])) for g in range(20) for i in range(rng.randint(0, 15))]
    got = {}
    for r in views.sample_evidence(spark.createDataFrame(rows, "insight_id int, place int, start_time double"), 4).collect():
        got.setdefault(r.insight_id, set()).add(r.place)
    for g in range(20):
        own = [(i, s) for h, i, s in rows if h == g]
        timed = sorted(((s, i) for i, s in own if s is not None))
        want = {i for i, _ in own} if len(own) <= 4 else {timed[int(k * len(timed) / 4)][1] for k in range(4)} if len(timed) >= 4 else {i for i, _ in own[:4]}
        assert got.get(g, set()) == want


def test_embed_errors(spark):
    df = spark.createDataFrame([("a b",), (" ",), (None,)], "text string")
    got = search.embed(df, search.hashing_embedder(8)).collect()
    assert [r.error for r in got] == [None, "blank text", "blank text"] and abs(sum(x * x for x in got[0].embedding) - 1) < 1e-5


def test_extraction_notes(spark):
    from strandline.operators.extraction import extract_insights

    def model():
        def run(prompts):
            for p in prompts:
                if "bad" in p:
                    raise ValueError("no")
                yield json.dumps({"insights": [{"name": p[:3], "description": "d", "type": "trend"}], "extraction_notes": "fine"})

        return run

    df = spark.createDataFrame([("one", "abc"), ("two", "bad")], "source string, text string")
    insights, notes = extract_insights(df, model, search.hashing_embedder(8))
    assert [r.name for r in insights.collect()] == ["abc"]
    assert {r.source: r.notes for r in notes.collect()} == {"one": "[Chunk 1] fine", "two": "[Chunk 1] ValueError: no"}


@pytest.mark.parametrize("seed,most", [(0, 10_000), (1, 20), (2, 7)])
def test_upserts_in_order_of_arrival(spark, monkeypatch, seed, most):
    from strandline.operators import upsert

    monkeypatch.setattr(greedy, "MOST", most)
    rng = random.Random(seed)
    some = lambda kind, n: rng.choice([None] + [f"{kind}{i}" for i in range(n)])
    stored = [(i, some("u", 9), some("p", 3), some("t", 5)) for i in range(1, 12)]
    batch = [(k * 3 + 1, some("u", 25), some("p", 3), some("t", 9)) for k in range(80)]
    table, want, top = list(stored), {}, 11
    for place, u, p, t in batch:
        found = [r[0] for r in table if u is not None and r[1] == u] or [r[0] for r in table if None not in (p, t) and r[2:] == (p, t)]
        if found:
            want[place] = (min(found), False)
        else:
            top += 1
            table.append((top, u, p, t))
            want[place] = (top, True)
    schema = "long, audio_url string, podcast_name string, episode_title string"
    got = upsert.upsert_episodes(spark.createDataFrame(batch, f"place {schema}"), spark.createDataFrame(stored, f"id {schema}"), "place").collect()
    assert len(got) == len(batch) and {r.place: (r.id, r.created) for r in got} == want
    uris, ids, expected = {r[1]: r[0] for r in reversed(stored) if r[1]}, 11, {}
    for place, u, *_ in batch:
        if u is not None and u in uris:
            expected[place] = (uris[u], "skipped")
        else:
            ids += 1
            expected[place] = (ids, "processed")
            if u is not None:
                uris[u] = ids
    docs = spark.createDataFrame([(p, u, None, "pdf") for p, u, *_ in batch], "place long, gcs_document_uri string, source_type string, format string")
    out = upsert.upsert_documents(docs, spark.createDataFrame([(r[0], r[1]) for r in stored], "id long, gcs_document_uri string"), "place").collect()
    assert {r.place: (r.id, r.outcome) for r in out} == expected and len(out) == len(batch)
    empty = upsert.upsert_episodes(spark.createDataFrame([], f"place {schema}"), spark.createDataFrame(stored, f"id {schema}"), "place")
    assert empty.count() == 0


def test_changes_by_batch(spark, tmp_path):
    """Batches again, a state before a batch, gathering into bases and full tables; several rows of a key."""
    from strandline.streaming import changes

    schema = "id long, v string"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    for many in (False, True):
        path, want = str(tmp_path / f"t{many}"), {}
        read = lambda before=None: sorted(map(tuple, changes.latest(spark, path, schema, ["id"], before, many).collect()), key=str)  # noqa: E731, B023
        said = lambda: sorted(((k, v) for k, vs in want.items() for v in vs), key=str)  # noqa: E731, B023
        assert read() == []
        for n in range(13):
            before = said()
            changes.gather(spark, path, schema, ["id"], n, 2, many)
            assert read() == before
            own = [f"v{n}", f"w{n}"] if many else [f"v{n}"]
            changes.put(rows(*((n % 3, v) for v in own), (100 + n, None)), path, n)
            changes.put(rows((n % 3, "again")), path, n)
            want |= {n % 3: own, 100 + n: [None]}
            assert read() == said() and read(n) == before
        found = changes.written(spark, path)
        assert len(found["full"]) == 1 and len(found["base"]) <= 3 and len(found["batch"]) <= 3


def test_discovery_stream_starts_again(spark, tmp_path):
    """A batch whose tables were only partly written, and units that come twice."""
    from strandline.streaming import status

    v = vectors(9, 40)
    df = frame(spark, v, name=[f"n{i}" for i in range(40)]).select("id", "name", F.col("embedding").cast("array<float>").alias("embedding"))
    inbox, state, marks = (str(tmp_path / x) for x in ("in", "state", "marks"))

    def go():
        status.discover_batches(spark.readStream.schema(df.schema).parquet(inbox), state, marks, 0.8).awaitTermination()

    df.filter("id < 20").write.mode("append").parquet(inbox)
    go()
    df.filter("id >= 15").coalesce(1).write.mode("append").parquet(inbox)
    go()
    first = [sorted(map(str, x.collect())) for x in status.discovered(spark, state)]
    import os
    import shutil

    shutil.rmtree(f"{state}/free/batch-1")
    for name in os.listdir(f"{marks}/commits"):
        if name.strip(".").split(".")[0] == "1":
            os.remove(f"{marks}/commits/{name}")
    go()
    units, macros = status.discovered(spark, state)
    assert [sorted(map(str, x.collect())) for x in (units, macros)] == first and units.count() == 40
    held = df.join(units, "id").filter("macro_id is not null")
    want = {r.macro_id: r.centroid for r in similarity.centroids(held, "macro_id").collect()}
    assert all(np.allclose(want[r.id], r.centroid_embedding, atol=1e-9) for r in macros.collect()) and len(want) == macros.count()


@pytest.mark.parametrize("threshold,share", [(0.72, 0.6), (0.9, 0.35)])
def test_blocks_that_angles_rule_out_never_meet(spark, monkeypatch, caplog, threshold, share):
    """Rows in bunches: the same edges as by brute force, from a part of the pairs of blocks."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(30, 12))
    v = (centre[rng.integers(0, 30, 900)] + 0.25 * rng.normal(size=(900, 12))).astype(np.float32)
    v[:5] = 0
    df, other = frame(spark, v), frame(spark, v[::3])
    s = cosines(np.where(v == 0, np.float32(1e-12), v))
    s[:5] = s[:, :5] = 0
    want = {(i, j) for i, j in zip(*np.nonzero(s >= threshold), strict=True) if i < j}
    assert len(want) > 1000
    monkeypatch.setattr(similarity, "SMALL_SIDE_BYTES", 1)
    got = similarity.similarity_edges(df, threshold, block_rows=25)
    assert {(r.a, r.b) for r in got.collect()} == want and got.count() == len(want)
    both = similarity.cosine_join(df, other, threshold, block_rows=25)
    assert {(r.a, r.b) for r in both.collect()} == {(i, j // 3) for i, j in zip(*np.nonzero(s >= threshold), strict=True) if j % 3 == 0}
    dealt = similarity.celled([similarity.usable(df, "id", "embedding")], threshold, 25)[0]
    blocks = dealt.select("_c").distinct().count()
    met = dealt.select("_c", F.explode(F.sequence("_from", "_to")).alias("o")).distinct().count()
    print(threshold, met / blocks**2)
    assert met / blocks**2 < share


def test_lists_that_cannot_reach_are_not_read(spark, tmp_path):
    """Chunks in bunches: the rows of a search of all, from a few lists; vectors that are null or zero, and more queries than a list has rows."""
    from strandline.operators import lists

    rng = np.random.default_rng(3)
    centre = rng.normal(size=(20, 10))
    v = (centre[rng.integers(0, 20, 600)] + 0.15 * rng.normal(size=(600, 10))).astype(np.float32)
    v[:3] = 0
    chunks = frame(spark, v, kind=["podcast", "document"] * 300).select(F.col("id").cast("string").alias("chunk_id"), "kind", F.col("kind").alias("source"), F.when(F.col("id") != 5, F.col("embedding")).alias("embedding"), "id")
    queries = chunks.filter("id % 50 = 7").select(F.col("id").alias("query_id"), "embedding")
    index = lists.build_lists(chunks, str(tmp_path / "lists"))
    for k in (3, 70):
        key = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.kind, r.source, round(r.score, 9)) for r in df.collect())
        assert key(lists.search_lists(queries, index, k)) == key(search.search_many(queries, chunks, k))
    asked = lists.search_lists(queries.limit(1), index, 3)
    assert asked.count() == 3
    plan = index.chunks(spark, np.array([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
