"""Token store, media columns, packing and the pipeline: exact round trips and odd inputs."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm import media, packing
from strandline.llm import token_store as ts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_unreadable_media(spark):
    """A file that can't be read costs its own row alone."""
    good = media.store_payload(b"abc" * 192)
    df = spark.createDataFrame([(1, b"no picture", 3), (2, None, 0), (3, good, 576), (4, good[: len(good) // 2], 576)], "doc_id long, media binary, n_bytes long").coalesce(1)
    got = {r.doc_id: r for r in media.decode_media(df).collect()}
    assert got[1].tensor is None and "JPEG" in got[1].error and got[2].tensor is None and got[2].error is None
    assert len(got[3].tensor) == got[3].width * got[3].height * 3 and got[3].error is None and len(got) == 4
    found = {r.doc_id: r for r in media.media_features(df.filter("doc_id in (1, 3)")).collect()}
    assert found[1].payload_sha256 is None and found[1].media_bytes == 10 and found[3].payload_bytes == 576


def test_pieces_of_one_hash(library):
    """Every hash collides: the ids are those of the library all the same."""
    coder = ts.PlaneEncoder(PATH)
    coder.noise[:] = 1
    texts = [" one two three four", "", " six ten two one", "abc def"]
    for _ in range(2):
        ids, counts = coder.encode(texts)
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])


def test_encoder_equals_the_library(library):
    rng, coder = random.Random(1), ts.PlaneEncoder(PATH, most=200)
    parts = ["'", "s", "t", "re", "ll", "d", "ve", "m", " ", "  ", "\n", "\t", "a", "B", "é", "1", "²", ".", "!", "<|endoftext|>", "日", "\x85", "\xa0", "_", "ª", "\x1c", "ß", "word", " longer"]
    for _ in range(40):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(25)] + [None, ""]
        ids, counts = coder.encode(texts)
        for t, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert own.tolist() == library.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("block", [7, 65536])
def test_container(block):
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.integers(0, 50000, 100), rng.integers(0, 200, 50), np.array([2**31, 5, 0])]).astype(np.uint32)
    docs, counts, back = ts.unpack_container(ts.pack_container(np.array([5, 9, -3]), np.array([100, 50, 3]), ids, block))
    assert docs.tolist() == [5, 9, -3] and counts.tolist() == [100, 50, 3] and back.tolist() == ids.tolist()
    empty = ts.unpack_container(ts.pack_container(np.empty(0), np.empty(0), np.empty(0, np.uint32)))
    assert [len(x) for x in empty] == [0, 0, 0]


def test_store_order(odd_docs, odd_rows, no_docs, library):
    got = ts.read_store(ts.write_store(odd_docs, PATH, container_ids=500, shards=4)).orderBy("doc_id").collect()
    start = 0
    for r, row in zip(got, odd_rows, strict=True):
        ids = library.encode(row[1] or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens) == (row[0], start, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)
    assert ts.read_store(ts.write_store(no_docs, PATH)).count() == 0


def plain_decode(raw):
    """Coefficients of a progressive file, bit by bit, as the format's own flow charts say."""
    at, tables, pic, scans = 2, {}, None, []
    restart = 0
    while raw[at + 1] != 0xD9:
        marker, size = raw[at + 1], raw[at + 2] << 8 | raw[at + 3]
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            code, k, t = 0, 17, {}
            for length in range(1, 17):
                for _ in range(body[length]):
                    t[length, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            tables[body[0]] = t
        elif marker == 0xC2:
            pic = (body[3] << 8 | body[4], body[1] << 8 | body[2], [(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(body[5])])
        elif marker == 0xDD:
            restart = body[0] << 8 | body[1]
        elif marker == 0xDA:
            end = at
            while raw[end] != 0xFF or raw[end + 1] == 0 or 0xD0 <= raw[end + 1] <= 0xD7:
                end += 1
            scans.append((body, dict(tables), restart, raw[at:end]))
            at = end
    w, h, sampling = pic
    hm, vm = max(s[0] for s in sampling), max(s[1] for s in sampling)
    mw, mh = -(-w // (8 * hm)), -(-h // (8 * vm))
    coef = [np.zeros((mh * v, mw * u, 64), int) for u, v in sampling]
    zz = media.NATURAL
    for body, own, every, data in scans:
        n = body[0]
        comps = [body[1 + 2 * i] - 1 for i in range(n)]
        ss, se, ahl = body[1 + 2 * n : 4 + 2 * n]
        ah, al = ahl >> 4, ahl & 15
        parts, i, cur = [], 0, bytearray()
        while i < len(data):
            if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7:
                parts.append(cur)
                cur, i = bytearray(), i + 2
                continue
            cur.append(data[i])
            i += 2 if data[i] == 0xFF else 1
        parts.append(cur)
        if n > 1:
            units = [[(c, my * sampling[c][1] + y, mx * sampling[c][0] + x) for c in comps for y in range(sampling[c][1]) for x in range(sampling[c][0])] for my in range(mh) for mx in range(mw)]
        else:
            c = comps[0]
            bw, bh = -(-(-(-w * sampling[c][0] // hm)) // 8), -(-(-(-h * sampling[c][1] // vm)) // 8)
            units = [[(c, y, x)] for y in range(bh) for x in range(bw)]
        per = every or len(units)
        for p, part in enumerate(parts):
            bits = iter("".join(f"{b:08b}" for b in part))
            bit = lambda: int(next(bits, "1"))  # noqa: E731, B023

            def get(k):
                v = 0
                for _ in range(k):
                    v = v << 1 | bit()  # noqa: B023
                return v

            def symbol(t):
                code = length = 0
                while True:
                    code, length = code << 1 | bit(), length + 1  # noqa: B023
                    if (length, code) in t:
                        return t[length, code]

            def number(s):
                v = get(s)  # noqa: B023
                return v if not s or v >> (s - 1) else v - (1 << s) + 1

            pred, run = {}, 0
            for unit in units[p * per : (p + 1) * per]:
                for c, y, x in unit:
                    block = coef[c][y, x]
                    if ss == 0:
                        t = own.get(body[2 + 2 * comps.index(c)] >> 4)
                        if ah:
                            block[0] |= bit() << al
                        else:
                            pred[c] = pred.get(c, 0) + number(symbol(t))
                            block[0] = pred[c] << al
                        continue
                    t, k = own[0x10 | body[2] & 15], ss
                    fix = lambda j: block.__setitem__(j, block[j] + (1 if block[j] > 0 else -1) * (1 << al) if bit() and not abs(block[j]) >> al & 1 else block[j])  # noqa: E731, B023
                    if not ah:
                        if run:
                            run -= 1
                            continue
                        while k <= se:
                            rs = symbol(t)
                            r, s = rs >> 4, rs & 15
                            if s:
                                k += r
                                block[zz[k]] = number(s) << al if s else 0
                                k += 1
                            elif r == 15:
                                k += 16
                            else:
                                run = (1 << r) + get(r) - 1
                                break
                        continue
                    if not run:
                        while k <= se:
                            rs = symbol(t)
                            r, s = rs >> 4, rs & 15
                            if s == 0 and r < 15:
                                run = (1 << r) + get(r)
                                break
                            new = (1 if bit() else -1) << al if s else 0
                            while k <= se:
                                j = zz[k]
                                if block[j]:
                                    fix(j)
                                elif r == 0:
                                    block[j] = new
                                    k += 1
                                    break
                                else:
                                    r -= 1
                                k += 1
                    if run:
                        while k <= se:
                            if block[zz[k]]:
                                fix(zz[k])
                            k += 1
                        run -= 1
    return pic, coef


DC = {3: list(range(7))}
FIRST = {4: [0x00, 0x10, 0x20, 0xF0, *(r << 4 | s for r in range(4) for s in (1, 2))]}
REFINE = {3: [0x00, 0x10, 0x20, 0x01, 0x11, 0x21]}


def code(by_length, symbol):
    ((n, symbols),) = by_length.items()
    return f"{symbols.index(symbol):0{n}b}"


def random_file(seed):
    """A file of random symbols in scans of all kinds, with runs of ended blocks, long runs of zeros and corrections."""
    import struct

    rng = random.Random(seed)
    bits = lambda n: "".join(rng.choice("01") for _ in range(n))
    sampling = rng.choice([[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1)] * 3])
    w, h, every = rng.randint(1, 40), rng.randint(1, 40), rng.choice([1, 2, 3])
    n = len(sampling)
    out = b"\xff\xd8" + media.segment(0xDB, b"\0" + bytes(rng.randint(1, 9) for _ in range(64)))
    out += media.segment(0xC2, struct.pack(">BHHB", 8, h, w, n) + bytes(b for i, (u, v) in enumerate(sampling) for b in (i + 1, u << 4 | v, 0)))
    out += media.huffman(0, DC) + media.huffman(0x10, FIRST) + media.huffman(0x11, REFINE) + media.segment(0xDD, struct.pack(">H", every))
    hm, vm = max(s[0] for s in sampling), max(s[1] for s in sampling)
    mcus = -(-w // (8 * hm)) * -(-h // (8 * vm))
    alone = [-(-(-(-w * u // hm)) // 8) * -(-(-(-h * v // vm)) // 8) for u, v in sampling]
    there = [[set() for _ in range(k)] for k in alone]
    scans = [(tuple(range(n)), 0, 0, 0, 1, 0)] + [((c,), a, b, 0, 1, 0) for c in range(n) for a, b in ((1, 5), (6, 63))] + [((c,), 1, 63, 1, 0, 1) for c in range(n)] + [(tuple(range(n)), 0, 0, 1, 0, 0)]
    for comps, ss, se, ah, al, ac in scans:
        out += media.segment(0xDA, bytes([len(comps), *(b for c in comps for b in (c + 1, ac)), ss, se, ah << 4 | al]))
        units = mcus if len(comps) > 1 else alone[comps[0]]
        parts = []
        for lo in range(0, units, every):
            own, run, left = "", 0, min(every, units - lo)
            for i in range(lo, lo + left):
                rest = lo + left - i
                if ss == 0:
                    for c in comps:
                        for _ in range(sampling[c][0] * sampling[c][1] if len(comps) > 1 else 1):
                            s = rng.randint(0, 6)
                            own += bits(1) if ah else code(DC, s) + bits(s)
                    continue
                nz, k, table = there[comps[0]][i], ss, REFINE if ah else FIRST
                before = set(nz)
                while not run and k <= se:
                    zeros = [p for p in range(k, se + 1) if p not in before]
                    r = rng.randint(0, 2)
                    if rng.random() < 0.2 or (ah and len(zeros) <= r):
                        r = rng.choice([x for x in range(3) if 1 << x <= rest])
                        more = rng.randint(0, min((1 << r) - 1, rest - (1 << r)))
                        own += code(table, r << 4) + (f"{more:0{r}b}" if r else "")
                        run = (1 << r) + more
                    elif ah:
                        own += code(table, r << 4 | 1) + bits(1) + bits(sum(k <= p < zeros[r] for p in before))
                        nz.add(zeros[r])
                        k = zeros[r] + 1
                    elif rng.random() < 0.2 and k + 16 <= se:
                        own += code(table, 0xF0)
                        k += 16
                    else:
                        r, s = rng.randint(0, min(3, se - k)), rng.randint(1, 2)
                        own += code(table, r << 4 | s) + bits(s)
                        nz.add(k + r)
                        k += r + 1
                if run:
                    own += bits(sum(k <= p <= se for p in before)) if ah else ""
                    run -= 1
            own += "1" * (-len(own) % 8)
            parts.append(int(own, 2).to_bytes(len(own) // 8, "big") if own else b"")
        out += media.with_markers(parts)
    return out + b"\xff\xd9"


@pytest.mark.parametrize("seed", range(6))
def test_decoder_equals_the_plain_one(seed):
    raws = [random_file(seed), random_file(seed + 100), media.store_payload(bytes(range(256)) * 9)]
    pics, coefs = media.coefficients(raws)
    for raw, pic, got in zip(raws, pics, coefs, strict=True):
        (w, h, sampling), want = plain_decode(raw)
        assert (pic.width, pic.height) == (w, h) and len(got) == len(sampling)
        for a, b in zip(got, want, strict=True):
            assert (a == b.reshape(-1, 64)).all()
        assert media.tensor(pic, got).shape == (h, w, 1 if len(sampling) == 1 else 3)


def test_inverse_transform():
    rng = np.random.default_rng(5)
    block = rng.integers(-30, 30, 64)
    pic = media.Picture(8, 8, ((1, 1),), (b"\0\1" * 64,), b"")
    c = lambda u: 0.5**0.5 if u == 0 else 1
    want = [[0.25 * sum(c(u) * c(v) * block[8 * v + u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) + 128 for x in range(8)] for y in range(8)]
    got = media.tensor(pic, [block[None]])[:, :, 0]
    assert np.abs(got - np.clip(want, 0, 255)).max() <= 0.6


def test_payload_round_trip(odd_docs, odd_rows, no_docs):
    stored = media.store_texts(odd_docs)
    rows = {r.doc_id: r for r in media.media_features(stored).collect()}
    for i, t, *_ in odd_rows:
        raw = (t or "").encode()
        size = max(-(-len(raw) // 576), 1) * 576
        payload = raw + b"\xff" * (size - len(raw))
        import hashlib

        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256, rows[i].tail_crc32) == (len(raw), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert rows[9].media_sha256 == rows[10].media_sha256 and rows[9].feature == rows[10].feature
    tensors = media.decode_media(stored).collect()
    assert all(len(r.tensor) == r.width * r.height * r.channels for r in tensors) and len(tensors) == len(odd_rows)
    assert media.decode_media(stored.select("doc_id", F.lit(None).cast("binary").alias("media"))).filter("tensor is null").count() == len(odd_rows)
    assert media.media_features(media.store_texts(no_docs)).count() == 0


def test_packing(spark, odd_docs, odd_rows, no_docs):
    out = packing.pack_documents(odd_docs, packing.word_tokens(), (64, 128, 512), shard_pieces=5).toPandas()
    sizes = {i: len((t or "").encode().split()) + 1 for i, t, *_ in odd_rows}
    assert out.groupby("doc_id").length.sum().to_dict() == sizes
    for _, own in out.groupby("bin"):
        assert own.length.sum() == own.used.iloc[0] <= own.capacity.iloc[0] and own.capacity.iloc[0] == min(c for c in (64, 128, 512) if c >= own.used.iloc[0])
        assert sorted(own.slot) == list(range(len(own)))
    for _, own in out.groupby("doc_id"):
        own = own.sort_values("piece")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
    assert packing.pack_documents(no_docs, packing.word_tokens()).count() == 0
    assert packing.pack_documents(spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "doc_id long, text string"), packing.word_tokens()).count() == 3


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_best_fit(seed):
    """Against a plain best fit in which a new bin is tried at every length with the pieces behind it."""
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, 100) for _ in range(200)), reverse=True)
    for least in (20, 50, 100):
        permitted = [n for n in (20, 50, 100) if n >= least]
        rooms, want = [], []
        for i, s in enumerate(sizes):
            fits = [(room, k) for k, room in enumerate(rooms) if room >= s]
            if fits:
                rooms[min(fits)[1]] -= s
                continue
            tries = []
            for c in (n for n in permitted if n >= s):
                used = s
                for later in sizes[i + 1 :]:
                    used += later if used + later <= c else 0
                tries.append((round(packing.cost(min(n for n in permitted if n >= used)) / used, 9), c))
            want.append(min(tries)[1])
            rooms.append(want[-1] - s)
        bins = packing.fill(sizes, (20, 50, 100), least)
        assert [c for c, _ in bins] == want and sorted(i for _, own in bins for i in own) == list(range(200))
    best = packing.pack(sizes, (20, 50, 100))
    assert all(sum(sizes[i] for i in own) <= c for c, own in best)


def test_packings_cost_little():
    """Against the least cost of all ways to group a few pieces."""

    def least_cost(sizes, lengths):
        if not sizes:
            return 0.0
        out, rest = math.inf, sizes[1:]
        for mask in range(1 << len(rest)):
            own = [sizes[0]] + [x for k, x in enumerate(rest) if mask >> k & 1]
            if sum(own) <= lengths[-1]:
                out = min(out, packing.cost(next(n for n in lengths if n >= sum(own))) + least_cost([x for k, x in enumerate(rest) if not mask >> k & 1], lengths))
        return out

    rng, ratios = random.Random(9), []
    for _ in range(60):
        sizes = sorted((rng.randint(100, 8192) if rng.random() < 0.3 else rng.randint(100, 3000) for _ in range(rng.randint(1, 8))), reverse=True)
        found = sum(packing.cost(c) for c, _ in packing.pack(sizes, packing.LENGTHS))
        best = least_cost(sizes, packing.LENGTHS)
        assert found >= best - 1e-9
        ratios.append(found / best)
    assert sum(r < 1 + 1e-9 for r in ratios) >= 30 and max(ratios) < 1.4 and sum(ratios) / len(ratios) < 1.05, (sum(ratios) / len(ratios), max(ratios), sum(r < 1 + 1e-9 for r in ratios))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = p.table(spark, sf_dir, "documents")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in p.STAGES[:-1]:
        docs = p.written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= before and docs.count() == len(now) > 0
        if name == "secrets":
            assert now == before
        before = now
    packed = p.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == before
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
