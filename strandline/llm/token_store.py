"""Token-id store: fixed-size blocks of ids, transposed into byte planes, each plane compressed with zstandard.

A store is a Parquet table with a row for each container file: shard, file, first (ids of the shard before it), n_docs, n_ids, content.
Containers never cross a shard; shards follow one another in doc_id order. content is

    magic "BPL1" | u32 ids in a block | u64 ids | u32 blocks | u32 documents
    block index: for each block u32 ids, u8 planes, and for each plane u32 compressed bytes
    document index: zstandard of i64 doc ids and u32 id counts (u32 compressed bytes before it)
    planes, block by block, the low byte first
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Memo, batches_of, mix, table, written

MAGIC = b"BPL1"
PIECE_BYTES = 48 << 20  # of pieces and their ids that an encoder keeps


def planes(ids: np.ndarray) -> list[bytes]:
    """The byte planes of a block of ids, up to the highest that is not all zero; one at least."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    n = max(1, 4 - next((i for i in range(4) if raw[:, 3 - i].any()), 3))
    return [raw[:, i].tobytes() for i in range(n)]


def pack_container(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, block: int = 65536) -> bytes:
    z = zstandard.ZstdCompressor(level=3)
    starts = range(0, len(ids), block)
    blocks = [[z.compress(p) for p in planes(ids[i : i + block])] for i in starts]
    index = b"".join(struct.pack(f"<IB{len(b)}I", min(block, len(ids) - i), len(b), *map(len, b)) for i, b in zip(starts, blocks, strict=True))
    docs = z.compress(np.asarray(doc_ids, "<i8").tobytes() + np.asarray(counts, "<u4").tobytes())
    head = MAGIC + struct.pack("<IQII", block, len(ids), len(blocks), len(doc_ids))
    return b"".join([head, index, struct.pack("<I", len(docs)), docs, *(p for b in blocks for p in b)])


def unpack_container(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, id counts and all ids of a container."""
    if content[:4] != MAGIC:
        raise ValueError("not a plane container")
    z = zstandard.ZstdDecompressor()
    _, n, n_blocks, n_docs = struct.unpack_from("<IQII", content, 4)
    at, index = 24, []
    for _ in range(n_blocks):
        k, p = struct.unpack_from("<IB", content, at)
        index.append((k, struct.unpack_from(f"<{p}I", content, at + 5)))
        at += 5 + 4 * p
    (size,) = struct.unpack_from("<I", content, at)
    docs = z.decompress(content[at + 4 : at + 4 + size])
    at += 4 + size
    out = np.zeros((n, 4), np.uint8)
    done = 0
    for k, sizes in index:
        for i, s in enumerate(sizes):
            out[done : done + k, i] = np.frombuffer(z.decompress(content[at : at + s]), np.uint8)
            at += s
        done += k
    return np.frombuffer(docs, "<i8", n_docs), np.frombuffer(docs, "<u4", n_docs, 8 * n_docs), out.view("<u4").ravel()


@lru_cache(maxsize=1)
def loaded(path: str):
    """The library's tokenizer; a Python worker reads the file once. What it encodes isn't kept."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
LATIN_END = 0x180


class PlaneEncoder:
    """Encodes texts with a byte-level BPE of the tokenizers library, each distinct piece once.

    Its pre-tokenizer cuts a text into pieces that are encoded each for itself. Here the cuts of plain Latin texts are found for
    a whole batch at a time, and the library encodes the distinct pieces that were not met before. Pieces are looked up by hash and then
    compared character by character; if two differ, the batch goes to the library whole, as do texts with other characters or with a
    special token's string.
    """

    def __init__(self, path: str, most: int = PIECE_BYTES):
        self.model = loaded(path)
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for k, v in vocab.items():
            self.width[v] = len(k)
        self.special = [str(t.content) for t in self.model.get_added_tokens_decoder().values()]
        self.tables(most)

    def tables(self, most: int) -> None:
        """What all batches share: kinds and hashes of characters, and the pieces met (ids; characters)."""
        self.memo = Memo(np.uint32, np.uint16, most=most)
        self.kind = np.full(LATIN_END, 255, np.uint8)
        for i in range(LATIN_END):
            c = chr(i)
            if c in "\t\n\v\f\r \xa0":
                self.kind[i] = SPACE
            elif c.isalpha():
                self.kind[i] = LETTER
            elif c.isnumeric():
                self.kind[i] = NUMBER
            elif not 0x1C <= i <= 0x1F and i != 0x85:
                self.kind[i] = OTHER
        rng = np.random.default_rng(7)
        self.noise = rng.integers(1, 2**63, LATIN_END, dtype=np.uint64) | np.uint64(1)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
        self.power = self.unpower = np.empty(0, np.uint64)

    def cuts(self, cp: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pieces start: the library's pattern, on all texts at once. first: marks where a text starts, one longer than cp."""
        n = len(cp)
        run = first[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        at = np.flatnonzero(run)
        end = np.append(at[1:], n)
        cut = run.copy()
        blank = kind[at] == SPACE
        inner = blank & ~first[end]  # a word of the same text follows
        last = end[inner] - 1
        cut[last] = True
        cut[last[cp[last] == 0x20] + 1] = False  # one space joins the piece after it
        q = at[(cp[at] == 0x27) & (end - at == 1) & cut[at]]
        q = q[q + 1 < n]
        q = q[(kind[q + 1] == LETTER) & ~first[q + 1]]
        one = np.isin(cp[q + 1], [ord(c) for c in "stmd"])
        pair = np.zeros(len(q), bool)
        two = np.flatnonzero(q + 2 < n)
        a, b = cp[q[two] + 1], cp[q[two] + 2]
        pair[two] = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & ~first[q[two] + 2]
        for hit, k in ((one, 2), (pair, 3)):
            x = q[hit]
            cut[x + 1] = False
            x = x[x + k < n] + k
            # a lone space after the contraction still opens the next piece, so the mark holds in every case
            cut[x] = True
        return np.flatnonzero(cut)

    def pieces_ids(self, pieces: list[str]) -> list[np.ndarray]:
        """The ids of pieces, each encoded for itself."""
        joined = [i for i, p in enumerate(pieces) if p[0] == " " and p[1:].isalpha()]
        other = sorted(set(range(len(pieces))) - set(joined))
        ids: list = [None] * len(pieces)
        for k in range(0, len(joined), 40_000):  # an encoding takes far more memory than its ids
            part = joined[k : k + 40_000]
            lines = [part[i : i + 200] for i in range(0, len(part), 200)]
            coded = self.model.encode_batch_fast(["".join(pieces[i] for i in line) for line in lines], add_special_tokens=False)
            for line, e in zip(lines, coded, strict=True):
                x = np.array(e.ids, np.uint32)
                ends = np.searchsorted(np.cumsum(self.width[x]), np.cumsum([len(pieces[i].encode()) for i in line])) + 1
                for i, s, t in zip(line, np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
                    ids[i] = x[s:t]
        for k in range(0, len(other), 20_000):
            part = other[k : k + 20_000]
            for i, e in zip(part, self.model.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False), strict=True):
                ids[i] = np.array(e.ids, np.uint32)
        return ids

    def whole_ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts that aren't cut."""
        return [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        ids = self.pieces_ids(pieces)
        spelled = np.frombuffer("".join(pieces).encode("utf-16-le"), np.uint16)
        sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (ids, pieces)]
        self.memo.add(keys, (np.concatenate(ids), sizes[0]), (spelled, sizes[1]))

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of plain texts, and how many each text has."""
        text = "".join(texts)
        n = len(text)
        if not n:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        bounds = np.cumsum([0, *map(len, texts)])
        first = np.zeros(n + 1, bool)
        first[bounds] = True
        at = self.cuts(cp, self.kind[cp], first)
        if len(self.power) < n:
            self.power = np.cumprod(np.full(n + 1, self.base))
            self.unpower = np.cumprod(np.full(n + 1, self.inverse))
        rolled = np.zeros(n + 1, np.uint64)
        np.cumsum(self.noise[cp] * self.power[:n], out=rolled[1:])
        end = np.append(at[1:], n)
        key = mix((rolled[end] - rolled[at]) * self.unpower[at])
        distinct, where, back = np.unique(key, return_index=True, return_inverse=True)
        if self.memo.full():
            self.memo.forget()
        new = self.memo.find(distinct) < 0
        if new.any():
            w = where[new]
            self.learn(distinct[new], [text[s:e] for s, e in zip(at[w].tolist(), end[w].tolist(), strict=True)])
        found = self.memo.find(distinct)[back]
        spelled, length = self.memo.get(1, found)
        if not (np.array_equal(length, end - at) and np.array_equal(spelled, cp)):
            whole = self.whole_ids(texts)
            return np.concatenate(whole), np.array([len(x) for x in whole], np.int64)
        ids, size = self.memo.get(0, found)
        upto = np.append(0, np.cumsum(size))
        return ids, np.diff(upto[np.searchsorted(at, bounds)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has. Null is an empty text."""
        ids, counts = [], []
        texts = [t or "" for t in texts]
        for a, b in batches_of(texts, 1_000_000):
            part = texts[a:b]
            ok = [self.is_plain(t) for t in part]
            if all(ok):
                x, c = self.plain(part)
            else:
                x, c = self.plain([t for t, p in zip(part, ok, strict=True) if p])
                pieces, c = np.split(x, np.cumsum(c)[:-1]) if len(c) else [], list(c)
                whole = iter(self.whole_ids([t for t, p in zip(part, ok, strict=True) if not p]))
                easy = iter(pieces)
                all_ids = [next(easy) if p else next(whole) for p in ok]
                x, c = np.concatenate(all_ids), np.array([len(i) for i in all_ids])
            ids.append(x)
            counts.append(c)
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.empty(0, np.uint32), np.zeros(0, np.int64))

    def is_plain(self, text: str) -> bool:
        if any(s in text for s in self.special):
            return False
        if text.isascii():
            return not any(c in text for c in "\x1c\x1d\x1e\x1f")
        return ord(max(text)) < LATIN_END and not any(c in text for c in "\x1c\x1d\x1e\x1f\x85")


_held: dict[str, PlaneEncoder] = {}


def encoder(path: str, write: str) -> PlaneEncoder:
    """The encoder of one write in this worker; that of another write is dropped, with all that it met."""
    if write not in _held:
        _held.clear()
        _held[write] = PlaneEncoder(path)
    return _held[write]


STORE = "shard int, file int, first long, n_docs int, n_ids long, content binary"


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", container_ids: int = 1_000_000, shards: int | None = None) -> DataFrame:
    """Encodes every text and writes the store into the shared folder; returns the written table.

    Shards are ranges of doc_id, so that their order is the order of the ids; rows of one id follow by text. Null and empty texts
    are the end id alone. Rows without an id are left out. An empty table gives an empty store. Other columns are not read.
    """

    write = uuid.uuid4().hex

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, shard = encoder(tokenizer, write), TaskContext.get().partitionId()
        state = {"file": 0, "first": 0}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def close() -> pd.DataFrame:
            doc_ids, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            row = pd.DataFrame({"shard": [shard], "file": [state["file"]], "first": [state["first"]], "n_docs": [len(doc_ids)], "n_ids": [len(ids)], "content": [pack_container(doc_ids, counts, ids)]})
            state["file"] += 1
            state["first"] += len(ids)
            return row

        for pdf in it:
            texts = pdf.t.tolist()
            for a, b in batches_of([t or "" for t in texts], 1_000_000):
                ids, counts = coder.encode(texts[a:b])
                ids = np.insert(ids, np.cumsum(counts), end_id)
                held.append((pdf.d.to_numpy(np.int64)[a:b], counts + 1, ids))
                if sum(len(x[2]) for x in held) >= container_ids:
                    yield close()
        if held:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).filter("d is not null")
    ranged = rows.repartitionByRange(shards, "d") if shards else rows.repartitionByRange("d")
    return written(ranged.sortWithinPartitions("d", "t").mapInPandas(run, STORE), "tokens")


def read_store(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian 32-bit) of each document, read from the containers.

    start counts the ids of all documents before it; only a number for each shard goes through the driver.
    """
    totals = sorted(store.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    before = dict(zip([r.shard for r in totals], np.cumsum([0, *(r.n for r in totals)]).tolist(), strict=False))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                doc_ids, counts, ids = unpack_container(r.content)
                ends = np.cumsum(counts, dtype=np.int64)
                start = ends - counts
                raw = ids.astype("<u4")
                yield pd.DataFrame({"doc_id": doc_ids, "start": before[r.shard] + r.first + start, "n_tokens": counts.astype(np.int64), "ids": [raw[s:e].tobytes() for s, e in zip(start.tolist(), ends.tolist(), strict=True)]})

    return store.mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary")


def op7_token_planes(spark, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document's ids, as read back from the store."""
    docs = table(spark, sf_dir, "documents")
    store = write_store(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return read_store(store).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
