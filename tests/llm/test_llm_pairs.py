"""Deduplication, decontamination and components against SQL and brute force."""

import random

import duckdb
import pandas as pd
import pytest
from compare import by_spark, by_sql, sorted_rows

from strandline.llm import near_dedup, substrings
from strandline.llm.components import components
from strandline.llm.queries import ORACLE, QUERIES


def sql_on(rows, sql):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r[:2] for r in rows], columns=["doc_id", "text"]))
    got = con.sql(sql)
    return sorted_rows(got.columns, got.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf_dir, name):
    assert by_spark(QUERIES[name](spark, sf_dir)) == by_sql(sf_dir, ORACLE[name])


def test_odd_tables(spark, odd_docs, odd_rows, no_docs):
    assert by_spark(near_dedup.near_components(odd_docs)) == sql_on(odd_rows, near_dedup.OP2_SQL)
    got = substrings.remove_repeats(odd_docs)
    assert by_spark(got.drop("spans")) == sql_on(odd_rows, substrings.OP9_SQL)
    for r in got.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    assert near_dedup.near_components(no_docs).count() == 0 and substrings.remove_repeats(no_docs).count() == 0


def test_repeated_ids_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words here"), (None, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.component_id, r.kept) for r in near_dedup.near_components(df).collect()] == [(1, True)] * 3
    assert substrings.remove_repeats(df).count() == 3


def variants(seed, n):
    """Copies of some texts with up to four words changed, so that similarities lie on both sides of the threshold."""
    rng = random.Random(seed)
    bases = [[f"w{rng.randint(0, 500)}" for _ in range(100)] for _ in range(n // 8)]
    out = []
    for i in range(n):
        w = list(bases[i % len(bases)])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(100)] = f"w{rng.randint(0, 500)}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_near_copies(spark, seed):
    rows = variants(seed, 160)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_spark(near_dedup.near_components(df)) == sql_on(rows, near_dedup.OP2_SQL)


def test_near_copies_of_few_words(spark):
    """Sets of six shingles link with sets of seven that hold them; smaller ones with equal sets alone."""
    rows = []
    for k in range(20):
        w = [f"k{k}_{i}" for i in range(11)]
        for part in (w[:10], w, w[1:], w[:9], w[1:9], w[1:9]):
            rows.append((len(rows), " ".join(part)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_spark(near_dedup.near_components(df))
    assert got == sql_on(rows, near_dedup.OP2_SQL)
    assert len({r.component_id for r in near_dedup.near_components(df.filter("doc_id < 3")).collect()}) == 1


def test_near_copies_in_a_crowd(spark):
    """Texts that share four fifths with each other but are not linked, and copies of some at the threshold."""
    rng = random.Random(7)
    common = [f"c{i}" for i in range(164)]
    own = [[f"o{k}_{i}" for i in range(20)] for k in range(1500)]
    rows = [(k, " ".join(common + w)) for k, w in enumerate(own)] + [(5000 + k, " ".join(common + own[k][:9] + [f"e{k}_{i}" for i in range(11)])) for k in range(0, 1500, 10)]
    rng.shuffle(rows)
    got = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - 5000 if i >= 5000 else i for i, _ in rows}
    x, y, z = (near_dedup.shingle_set(" ".join(common + w)) for w in (own[0], own[0][:9] + [f"e0_{i}" for i in range(11)], own[1]))
    share = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    assert share(x, y) >= 0.85 > share(x, z)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_repeats_in_many_places(spark, seed):
    """Passages of a small stock in random order and surroundings, over many partitions."""
    rng = random.Random(seed)
    stock = [[f"p{k}_{i}" for i in range(rng.randint(5, 40))] for k in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(stock)
            a = rng.randint(0, 4)
            w += p[a:] + [f"n{rng.randint(0, 3)}" for _ in range(rng.randint(0, 3))]
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert by_spark(substrings.remove_repeats(df).drop("spans")) == sql_on(rows, substrings.OP9_SQL)


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    root = {n: n for e in links for n in e}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if n in got} and {n for a, b in links if a != b for n in (a, b)} == set(got)


def test_leaks(spark):
    from strandline.llm.decontaminate import align, leak_finder
    import numpy as np

    rng = random.Random(4)
    word = lambda: f"v{rng.randint(0, 2000)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(15, 40)))) for i in range(12)] + [(50, None), (51, ""), (52, "tiny item")]
    noise = lambda n: " ".join(word() for _ in range(n))
    edited = items[3][1].split()
    edited[7], edited[12:14] = "other", []
    docs = [(0, noise(80)), (1, f"{noise(30)} {items[0][1]} {noise(30)}"), (2, f"{noise(30)} {' '.join(edited)} {noise(9)}"), (3, items[1][1].upper() + " " + items[2][1]), (4, None), (5, ""), (6, " ".join(items[4][1].split()[:5])), (7, "a tiny item here")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = df.select("doc_id", leak_finder(df, spark.createDataFrame(items, "item_id long, text string")).alias("x")).collect()
    assert {r.doc_id: [x.item_id for x in r.x] for r in found} == {0: [], 1: [0], 2: [3], 3: [1, 2], 4: [], 5: [], 6: [], 7: [52]}
    assert df.select(leak_finder(df, spark.createDataFrame([], "item_id long, text string")).alias("x")).filter("size(x) > 0").count() == 0

    def plain(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(map(max, h))

    for _ in range(50):
        a, b = [rng.randint(0, 3) for _ in range(rng.randint(1, 12))], [rng.randint(0, 3) for _ in range(rng.randint(0, 15))]
        assert align(np.array(a), np.array(b))[0] == plain(a, b)


def test_leaks_without_rare_words():
    """All rare words of an item are edited, and what stays is frequent in a large corpus."""
    from strandline.llm.common import word_hashes
    from strandline.llm.decontaminate import block_of, leaks, words

    item = "the of and to in is zyx it that for on was qwv with as be by at this from".split()
    counts = {int(h): 20_000_000 for h in word_hashes(words(" ".join(item)))} | {int(h): 3 for h in word_hashes([b"zyx", b"qwv"])}
    block = block_of([(7, " ".join(item))], counts, 1_000_000_000)
    edited = " ".join("changed" if w in ("zyx", "qwv") else w for w in item)
    noise = " ".join(f"n{i}" for i in range(50))
    got = leaks(block, [f"{noise} {edited} {noise}", f"{noise} this from {noise}", f"{noise} the of and {noise}"])
    assert [[x["item_id"] for x in r] for r in got] == [[7], [], []] and got[0][0]["score"] > 0.8


def edited_copy(rng, item, share):
    """Words of an item, some of them replaced, left out or preceded by others."""
    out = []
    for w in item:
        if rng.random() >= share:
            out.append(w)
        else:
            out += rng.choice(([], [f"e{rng.randint(0, 99)}"], [f"e{rng.randint(0, 99)}", w]))
    return out


@pytest.mark.parametrize("total", [2_000, 1_000_000_000])
def test_leaks_against_whole_texts(total):
    """Random edits and long insertions, at both ends of corpus size: what alignment with the whole text finds, the seeds find too."""
    from strandline.llm.common import word_hashes
    from strandline.llm.decontaminate import LEAK, MATCH, align, block_of, leaks

    rng = random.Random(12)
    items = [[f"w{int(rng.paretovariate(0.4)) % 3000}" for _ in range(rng.randint(12, 50))] for _ in range(40)]
    texts = []
    for k in range(400):
        item = items[k % 40]
        if k % 2:
            at = len(item) // 3
            copy = item[:at] + [f"i{rng.randint(0, 99)}" for _ in range(rng.randint(1, len(item) - 2))] + item[at:]
        else:
            copy = edited_copy(rng, item, rng.choice([0.1, 0.2, 0.3]))
        around = [[f"w{int(rng.paretovariate(0.4)) % 3000}" for _ in range(60)] for _ in range(2)]
        texts.append(around[0] + copy + around[1])
    counts = {int(h): max(1, int(total * 0.4 / r)) for r, h in enumerate(word_hashes([f"w{i}".encode() for i in range(3000)]), 1)}
    block = block_of([(i, " ".join(x)) for i, x in enumerate(items)], counts, total)
    got = [{x["item_id"]: x for x in r} for r in leaks(block, [" ".join(t) for t in texts])]
    held, found = 0, 0
    for k, t in enumerate(texts):
        score, start, end = align(block.items[k % 40], word_hashes([w.encode() for w in t]))
        if score >= LEAK * MATCH * len(items[k % 40]):
            held += 1
            found += k % 40 in got[k]
            if k % 40 in got[k]:
                x = got[k][k % 40]
                assert x["score"] * MATCH * len(items[k % 40]) == pytest.approx(score)
                assert align(block.items[k % 40], word_hashes([w.encode() for w in t[x["start"] : x["end"]]]))[0] == score
    assert held > 300 and found >= 0.99 * held, (held, found)
    for k, g in enumerate(got):  # others that are found are held as well
        for i, x in g.items():
            assert x["score"] * MATCH * len(items[i]) <= align(block.items[i], word_hashes([w.encode() for w in texts[k]]))[0] + 1e-9
