"""What every operator does with rows that corpora hold: null and repeated ids, one line of megabytes, names that clash."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import decontaminate, language_model, media, near_dedup, packing, quality, secrets, stages, substrings, token_store, toxicity
from strandline.llm.common import words

LONG = " ".join(random.Random(1).choice(["river", "house", "and", "the", "12", "stone,"]) + str(random.Random(i).randint(0, 99)) for i in range(150_000))
ROWS = [(None, "a text without an id " * 3), (None, None), (4, "first of two texts with one id and some words more"), (4, "second of two texts with one id and other words"), (4, "second of two texts with one id and other words"), (7, LONG), (8, "token = 'abcdefghijklmnop0123' ends"), (9, "")]
OWN = "doc_id long, text string, score double, node long, d long, t string, key long, n long, y int, bucket int, size int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0.5, 1, 2, "x", 3, 4, 5, 6, 7) for i, t in ROWS], OWN).repartition(3)


def named():
    return sorted((i, t or "") for i, t in ROWS if i is not None)


def test_scores(spark, docs):
    """A score for every row, of equal texts the same."""
    labels = spark.createDataFrame([(4, 1), (7, 0), (8, 0), (9, 1), (None, 1)], "doc_id long, quality int").withColumn("toxic", F.col("quality"))
    for train, score in ((quality.train_quality, quality.quality_score), (toxicity.train_toxicity, toxicity.toxicity_score)):
        got = docs.select("text", score(train(docs, labels, F.lit(True)), F.col("text")).alias("s")).collect()
        assert len(got) == len(ROWS) and all(0 <= r.s <= 1 for r in got) and len({(r.text, r.s) for r in got}) == len({t for _, t in ROWS})


def test_secrets(docs):
    model = secrets.train_secrets(docs)
    got = secrets.find_secrets(docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ROWS)
    assert {r.doc_id: r.n_assign for r in got if r.doc_id in (7, 8, 9)} == {7: 0, 8: 1, 9: 0}
    out = stages.redact_secrets(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS) and "[SECRET]" in out.filter("doc_id = 8").first().text


def test_media(docs):
    short = docs.withColumn("text", F.left("text", F.lit(100_000)))  # the decoder's own tests take longer ones
    got = media.media_features(media.store_texts(short)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ROWS)
    for r in got:
        if r.doc_id in (7, 8, 9):
            raw = dict(ROWS)[r.doc_id][:100_000].encode()
            assert r.payload_sha256 == hashlib.sha256(raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))).hexdigest()


def test_token_store(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = token_store.read_store(token_store.write_store(docs, path)).orderBy("start").collect()
    library, at = Tokenizer.from_file(path), 0
    assert [r.doc_id for r in got] == [i for i, _ in named()]
    for r, (_, t) in zip(got, named(), strict=True):
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        assert r.start == at and r.n_tokens == len(ids) and bytes(r.ids) == b"".join(x.to_bytes(4, "little") for x in ids)
        at += len(ids)


def test_language_model(docs):
    got = language_model.score_documents(docs, F.col("doc_id") != 8).collect()
    assert sorted((r.doc_id, r.n_tokens, r.held_out) for r in got) == sorted((i, len(words(t)) + 1, i == 8) for i, t in named())


def test_repeats_and_copies(docs):
    got = near_dedup.near_components(docs)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(i, i) for i, _ in named()]
    kept = stages.keep_distinct(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect())[0] == (4, ROWS[2][1]) and kept.count() == 4
    left = substrings.remove_repeats(docs).collect()
    assert sorted((r.doc_id, r.n_words) for r in left) == sorted((i, len(words(t, lower=False))) for i, t in named())


def test_leaks_and_bins(spark, docs):
    items = spark.createDataFrame([(1, "second of two texts with one id and other words"), (1, "token = 'abcdefghijklmnop0123' ends"), (None, "a text without an id"), (3, None)], "item_id long, text string")
    found = docs.select("doc_id", "text", decontaminate.leak_finder(docs, items).alias("x")).collect()
    assert sorted(r.text for r in found if r.x) == sorted(t for i, t in ROWS if t and (t.startswith("second") or t.startswith("token") or (i == 4 and t.startswith("first"))))
    packed = packing.pack_documents(docs, packing.word_tokens()).collect()
    assert sum(r.length for r in packed) == sum(len(words(t)) + 1 for _, t in ROWS) and len({r.bin for r in packed if r.doc_id == 7}) > 10
