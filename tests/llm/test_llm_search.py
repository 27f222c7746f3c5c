"""Sharding, lexical search and token alignment against plain versions, and on odd rows."""

import collections
import hashlib
import math
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from compare import by_spark, by_sql
from pyspark.sql import functions as F

from strandline.llm import lexical, sharding
from strandline.llm import token_alignment as ta
from strandline.llm.queries import ORACLE, QUERIES

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- sharding


def test_shards_of_documents(spark, sf_dir):
    got = QUERIES["op13_virtual_slots"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id").text.fillna("").map(str.encode)
    assert sorted(got.doc_id) == sorted(docs.index)
    own = docs.reindex(got.doc_id)
    assert (got["size"].to_numpy() == own.map(len).to_numpy() + 16).all() and (got.text_crc32.to_numpy() == own.map(zlib.crc32).to_numpy()).all()
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all() and got.shard.between(0, 39).all()
    total = got.groupby("shard")["size"].sum().reindex(range(40), fill_value=0)
    assert total.max() <= got["size"].sum() / 40 + got["size"].max()
    assert all(sorted(x.slot) == list(range(len(x))) for _, x in got.groupby("shard"))


def test_shards_of_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.unionByName(odd_docs.filter("doc_id < 5")).unionByName(odd_docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    stored = sharding.write_shards(docs, shards=3, slots=64, file_bytes=20_000)
    got = sharding.shard_rows(stored).toPandas()
    assert len(got) == docs.count() and got["size"].min() == 16
    assert all(sorted(x.slot) == list(range(len(x))) for _, x in got.groupby("shard"))
    assert stored.rows().select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).isEmpty()
    assert sharding.shard_rows(sharding.write_shards(no_docs)).count() == 0


def test_map_is_edited(spark, tmp_path):
    rng = np.random.default_rng(3)
    load = (rng.pareto(1.5, 4096) * 1000).astype(np.int64)
    first = sharding.first_owner(4096, 10)
    even = sharding.rebalanced(first, load, 10)
    total = np.bincount(even, load, 10)
    assert total.max() - total.min() <= load[even != first].max() and (even != first).mean() < 0.5
    more = sharding.grown(even, load, 10)
    moved = more != even
    assert (more[moved] == 10).all() and abs(load[moved].sum() - load.sum() / 11) < load.sum() / 1000
    less = sharding.rebalanced(more, load, 9)
    assert less.max() == 8
    path = str(tmp_path / "map")
    for version, (before, owner) in enumerate([(None, first), (first, even), (even, more)], 1):
        sharding.put_version(spark, path, version, before, owner)
    assert spark.read.parquet(path).filter("version = 3").count() == moved.sum()
    for version, owner in ((1, first), (2, even), (3, more), (None, more)):
        at = sharding.read_map(spark, path, version).toPandas().sort_values("vslot")
        assert (at.shard.to_numpy() == owner).all()


def test_one_slot_over_the_mean():
    load = np.array([1000, 1, 1, 1, 0, 0, 0, 0])
    got = sharding.rebalanced(sharding.first_owner(8, 2), load, 2)
    assert sorted(np.bincount(got, load, 2).tolist()) == [3, 1000]


# --- lexical search


def plain_ranking(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    known = [(i, collections.Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    n_docs, total = len(known), sum(sum(c.values()) for _, c in known)
    df = collections.Counter(w for _, c in known for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in known:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in terms(text) if w in c)
            if s > 0:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def test_term_counts(odd_rows):
    texts = [t for _, t, *_ in odd_rows] + ["", None, "a", " a", "a ", "Aé-b_c"]
    assert lexical.term_counts(texts).tolist() == [len(lexical.terms_of(t)) for t in texts] and not len(lexical.term_counts([]))


def test_search_against_sql(spark, sf_dir):
    assert by_spark(QUERIES["op12_geometric_blocks"](spark, sf_dir)) == by_sql(sf_dir, ORACLE["op12_geometric_blocks"])


@pytest.mark.parametrize("segment_docs", [1, 5, 4096])
def test_search_odd_rows(spark, odd_rows, odd_docs, no_docs, segment_docs):
    asked = [(1, odd_rows[0][1]), (2, "Été word1 word1 ünïcode, WORD2"), (3, None), (4, ""), (5, "nowhere"), (6, "one two x"), (None, "one"), (7, "word")]
    items = spark.createDataFrame(asked, "item_id long, text string")
    rows = [(r[0], r[1]) for r in odd_rows] + [(90, odd_rows[3][1]), (None, "one two")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, term string").repartition(2)
    got = lexical.search(lexical.build_index(docs, segment_docs=segment_docs), items)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_ranking(rows, asked)
    assert lexical.search(lexical.build_index(no_docs), items).count() == 0
    assert lexical.search(lexical.build_index(docs), items.limit(0)).count() == 0


def test_items_in_blocks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 15)
    assert by_spark(QUERIES["op12_geometric_blocks"](spark, sf_dir)) == by_sql(sf_dir, ORACLE["op12_geometric_blocks"])


def test_blocks_are_skipped_and_bounds_hold():
    rng = np.random.default_rng(5)
    topics = [[f"t{k}w{i}" for i in range(40)] for k in range(8)]
    texts = [" ".join(rng.choice(topics[k % 8], 30).tolist() + ["all"] * 3) for k in range(400)]
    total = sum(len(lexical.terms_of(t)) for t in texts)
    row = lexical.segment(np.arange(400), texts, 400, total)
    part = lexical.Opened(SimpleNamespace(**row), words := sorted({w for t in texts for w in lexical.terms_of(t)}))
    terms, weights = np.array([words.index(w) for w in (b"all", b"t3w1", b"t3w2")]), np.array([10.0, 4000.0, 5000.0])
    bound = part.bounds(terms, weights)
    ids, scores = part.scores(terms, weights, np.arange(len(bound)))
    assert len(ids) == 400
    for c in range(len(bound)):
        own, own_scores = part.scores(terms, weights, np.array([c]))
        assert len(own) and own_scores.max() <= bound[c] and set(own) <= set(ids)
    least = np.sort(scores)[-10]
    assert (bound >= least).sum() < len(bound) / 2, "blocks of other topics are left out"


# --- token alignment


def plain_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
    a_model.encode_special_tokens = True
    entry, code = {v: k for k, v in a_model.get_vocab().items()}, ta.entry_bytes()

    def piece(i):
        p = b_model.id_to_piece(i)
        m = re.fullmatch("<0x([0-9A-F]{2})>", p)
        return bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode()

    rows, counts = [], collections.Counter()
    for t in texts:
        a, b = (a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)) if t else ([], [])
        x, y = [bytes(code[c] for c in entry[i]) for i in a], [piece(i) for i in b]
        if not t or b"".join(x) != (" " + t).encode() or b"".join(y) != (" " + t).encode():
            rows.append(None)
            continue
        at = lambda parts: np.cumsum([0, *map(len, parts)]).tolist()
        p, q = at(x), at(y)
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if p[i] < q[j + 1] and q[j] < p[i + 1]]
        groups, i, j = [], 0, 0
        for e in sorted(set(p[1:]) & set(q[1:])):
            m, n = p.index(e), q.index(e)
            groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
            i, j = m, n
        rows.append((len(a), len(b), groups, links))
        counts.update(set(links))
    top = collections.defaultdict(int)
    for (i, _), n in counts.items():
        top[i] = max(top[i], n)
    zero = (0, 0, 0, 0, 0, 0, "")
    return [zero if r is None else (r[0], r[1], len(r[2]), len(r[3]), sum(counts[x] == top[x[0]] for x in r[3]), sum(counts[x] for x in r[3]), hashlib.sha256(";".join(r[2]).encode()).hexdigest()) for r in rows]


ODD = [
    None, "", " ", "  two  spaces ", "a", "Été ÀÉÎ ünïcode", "日本語のテキスト です", "<|endoftext|> and <s> </s> <unk> <0x41>", "tab\tand\nline\n\n", "▁ mark", "null\x00byte", "emoji 👩‍👩‍👧 x", "x" * 300, "can't we'll I'm",
    "a b c " * 50, "ﬁ ligature ２", "  line sep \xa0 nbsp", "word " * 30 + "end", "123456 7.89", "ключ и замок", "﻿bom", "é combined", "\x1c\x1d sep",
]
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_of_odd_rows(spark, no_docs):
    texts = ODD + ["Été ÀÉÎ ünïcode", "a b c"]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, pairs string, n_a int").repartition(2)
    rows = ta.align_documents(docs, A_PATH, B_PATH)
    counts = ta.pair_counts(rows)
    want = dict(enumerate(plain_alignment(texts)))
    assert sum(w[0] == 0 for w in want.values()) >= 3, "some texts can't be spelled out"
    for got in (ta.score_links(rows, counts), ta.score_links(rows, counts, most=10)):
        assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got.collect()} == want
    none = ta.align_documents(no_docs, A_PATH, B_PATH)
    assert ta.score_links(none, ta.pair_counts(none)).count() == 0
    lost = ta.align_documents(docs.withColumn("doc_id", F.lit(None).cast("long")), A_PATH, B_PATH)
    assert ta.score_links(lost, ta.pair_counts(lost)).filter("doc_id is null").count() == len(texts)


def test_memo_full_and_hashes_that_collide(spark, sf_dir):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    one = ta.Windows(A_PATH, B_PATH)
    want = one.align(texts)
    first = one.worked
    assert first < one.windows(*one.tokens(texts)[:3])[0].size / 2, "windows repeat"
    one.align(texts)
    assert one.worked == first, "and are worked out once"
    small = ta.Windows(A_PATH, B_PATH, memo_bytes=0)
    small.align(texts)
    again = small.align(texts)
    clash = ta.Windows(A_PATH, B_PATH)
    clash.rolled = lambda noise, ids, start, end: np.zeros(len(start), np.uint64)
    met = clash.align(texts)
    for got in (again, met):
        assert got["groups"] == want["groups"]
        assert all(np.array_equal(got[k], want[k]) for k in ("n_a", "n_b", "n_groups", "n_links", "doc", "pair", "times"))


def test_alignment_query_runs(spark, sf_dir):
    got = QUERIES["op11_space_anchors"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sample = [r for r in docs.orderBy("doc_id").collect()]
    want = plain_alignment_counts(sample)
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links) for r in got.collect()} == want


def plain_alignment_counts(rows):
    """Numbers of whole texts without the pairs: links are tokens of both sides less shared ends."""
    from sentencepiece import SentencePieceProcessor

    a_model, a = ta.byte_level(A_PATH)
    b_model, b = SentencePieceProcessor(model_file=B_PATH), ta.pieces(B_PATH)[1]
    out = {}
    for r in rows:
        t = r.text or ""
        x, y = (np.array(a_model.encode(" " + t, add_special_tokens=False).ids, int), np.array(b_model.encode(t), int)) if t else (np.empty(0, int), np.empty(0, int))
        whole = (" " + t).encode() if t else b""
        if not t or a.spelled(x).tobytes() != whole or b.spelled(y).tobytes() != whole:
            out[r.doc_id] = (0, 0, 0, 0)
            continue
        shared = len(set(np.cumsum(a.length[x]).tolist()) & set(np.cumsum(b.length[y]).tolist()))
        out[r.doc_id] = (len(x), len(y), shared, len(x) + len(y) - shared)
    return out


def test_segments_are_read_one_at_a_time(spark, tmp_path, monkeypatch):
    sizes = lambda it: (pd.DataFrame({"n": [len(pdf)]}) for pdf in it)
    spark.range(300).write.parquet(str(tmp_path / "rows"))
    most = lambda: max(r.n for r in spark.read.parquet(str(tmp_path / "rows")).mapInPandas(sizes, "n long").collect())
    before = most()
    seen, whole = [], lexical.found
    monkeypatch.setattr(lexical, "found", lambda *a: (seen.append(most()), whole(*a))[1])
    docs = spark.createDataFrame([(i, f"one w{i}") for i in range(40)], "doc_id long, text string")
    got = lexical.search(lexical.build_index(docs, segment_docs=4), spark.createDataFrame([(1, "one w7")], "item_id long, text string"))
    assert seen == [1, 1] and before == most() > 1
    assert got.filter("rank = 1").head().doc_id == 7 and got.count() == 10
