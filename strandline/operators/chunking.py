"""Chunks of transcripts and documents. Segments are cut with built-in functions, documents by a helper for each text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline import constants as K
from strandline.functions.pieces import pieces
from strandline.functions.text import HEADINGS, Name, col
from strandline.operators.transcripts import stripped


def chunk_segments_long(segments: DataFrame, sentences: int = 1) -> DataFrame:
    """Rows (source, idx, text, start, end) to chunks: blank segments drop out and keep their number; overlap is the end of the one before."""
    kept = segments.withColumn("text", stripped("text")).filter("text <> ''")
    before = F.lag("text").over(Window.partitionBy("source").orderBy("idx"))
    return kept.select(*chunk_columns(F.col("source"), F.col("idx"), F.col("text"), before, F.coalesce("start", F.lit(0.0)), F.coalesce("end", "start", F.lit(0.0)), sentences))


def tail(text: Column, sentences: int) -> Column:
    """The last sentences of a text; empty for null."""
    parts = F.split(text, r"(?U)(?<=[.!?])\s+")
    return F.coalesce(F.array_join(F.slice(parts, F.greatest(F.size(parts) - sentences + 1, F.lit(1)), sentences), " "), F.lit(""))


def chunk_columns(source: Column, idx: Column, text: Column, before: Column, start: Column, end: Column, sentences: int) -> list[Column]:
    overlap = tail(before, sentences)
    return [
        F.concat(source, F.lit("_chunk_"), F.lpad(idx.cast("string"), F.greatest(F.length(idx.cast("string")), F.lit(4)), F.lit("0"))).alias("chunk_id"), source.alias("source"), text.alias("text"), start.alias("start"), end.alias("end"),
        overlap.alias("overlap_text"), F.size(F.split(text, r"(?U)\s+")).alias("word_count"), F.length(text).alias("char_count"),
        F.when(overlap != "", F.concat(overlap, F.lit("\n\n"), text)).otherwise(text).alias("full_text")]


def chunk_podcast(transcripts: DataFrame, sentences: int = 1) -> DataFrame:
    """The same from rows (source, segments array<struct<text, start, end>>) without a shuffle."""
    numbered = F.transform("segments", lambda s, i: F.struct(i.alias("idx"), stripped(F.coalesce(s["text"], F.lit(""))).alias("text"), s["start"].alias("start"), s["end"].alias("end")))
    kept = transcripts.select("source", F.filter(numbered, lambda s: s["text"] != "").alias("kept"))
    paired = F.transform("kept", lambda s, i: F.struct(s.alias("s"), F.when(i > 0, F.get(F.col("kept"), i - 1)["text"]).alias("before")))
    rows = kept.select("source", F.explode(paired).alias("c"))
    s = F.col("c.s")
    return rows.select(*chunk_columns(F.col("source"), s["idx"], s["text"], F.col("c.before"), F.coalesce(s["start"], F.lit(0.0)), F.coalesce(s["end"], s["start"], F.lit(0.0)), sentences))


# Page breaks and page marks.
PAGE_BREAK = re.compile(r"\n{3,}|\x0c|(?:^|\n)---+(?:\n|$)")
PAGE_MARKS = [re.compile(p, re.IGNORECASE | re.MULTILINE) for p in (r"Page\s+(\d+)", r"-\s*(\d+)\s*-", r"^\s*(\d{1,3})\s*$")]
HEADING = re.compile("|".join(f"(?:{h})" for h in HEADINGS), re.MULTILINE)
SENTENCE_END, NEXT_SENTENCE = re.compile(r"(?<=[.!?])\s+"), re.compile(r"(?<=[.!?])\s+(?=[A-Z])")


class Block(NamedTuple):
    text: str
    heading: bool
    page: int
    section: str | None


class Chunk(NamedTuple):
    number: int
    text: str
    page: int | None
    section: str | None
    overlap: str


def heading_form(paragraph: str) -> bool:
    return 0 < len(paragraph) <= 200 and HEADING.match(paragraph) is not None


def marked_page(text: str) -> int:
    """Page number that a page names, by the first mark that is found; 0 if there is none."""
    return next((int(m[1]) for p in PAGE_MARKS if (m := p.search(text))), 0)


def numbered_pages(text: str) -> Iterator[tuple[int, str]]:
    """Pages that are not blank, with the number they name or else the one after the last page's."""
    number = 1
    for page in filter(None, (p.strip() for p in PAGE_BREAK.split(text))):
        number = marked_page(page) or number
        yield number, page
        number += 1


def blocks_of(pages: Iterable[tuple[int, str]]) -> list[Block]:
    """Paragraphs of pages; a heading opens a section, which lasts over pages."""
    out: list[Block] = []
    section = None
    for number, page in pages:
        for p in filter(None, (x.strip() for x in re.split(r"\n\s*\n", page))):
            if heading := heading_form(p):
                section = p
            out.append(Block(p, heading, number, section))
    return out


def sentence_groups(text: str, most: int) -> list[str]:
    """A long block in runs of whole sentences of at most so many characters; a longer sentence stays whole."""
    out: list[str] = []
    for s in filter(None, (x.strip() for x in NEXT_SENTENCE.split(text))):
        if out and len(out[-1]) + len(s) + 1 <= most:
            out[-1] += f" {s}"
        else:
            out.append(s)
    return out


def chunks_of(blocks: list[Block], most: int = K.CHUNK_MAX, least: int = K.CHUNK_MIN, by_heading: bool = True, sentences: int = K.CHUNK_OVERLAP_SENTENCES, merge: bool = True) -> list[Chunk]:
    """Greedy groups of blocks; each chunk's overlap is the end of the group before; small ones join their left neighbour."""
    groups: list[tuple[str, int | None, str | None]] = []
    held: list[str] = []
    page = section = None

    def flush() -> None:
        if held:
            groups.append(("\n\n".join(held), page, section))
            held.clear()

    for b in blocks:
        too_long = len(b.text) > most
        if too_long or (by_heading and b.heading) or sum(map(len, held)) + len(b.text) > most:
            flush()
        if too_long:
            page, section = b.page, b.section
            groups += [(part, page, section) for part in sentence_groups(b.text, most)]
        else:
            held.append(b.text)
            page, section = b.page or page, b.section or section
    flush()
    ends = [" ".join(SENTENCE_END.split(text)[-sentences:])[-(least // 2) :].strip() for text, _, _ in groups]
    out: list[Chunk] = []
    for i, (text, p, s) in enumerate(groups):
        last = out[-1] if out else None
        if merge and last and len(text) < least and len(last.text) + 2 + len(text) <= most:
            out[-1] = last._replace(text=f"{last.text}\n\n{text}", section=last.section or s)
        else:
            out.append(Chunk(i, text, p, s, ends[i - 1] if i else ""))
    return out


def windows_of(text: str, size: int = K.WINDOW_SIZE, overlap: int = K.WINDOW_OVERLAP, search: int = K.WINDOW_SEARCH) -> list[str]:
    """Windows of a long text, ended at the last sentence or line end in reach, each starting overlap characters before the end of the last."""
    if overlap >= size - search:
        raise ValueError("the overlap must be smaller than the part of a window that is never cut off")
    out, start = [], 0
    while True:
        end = start + size
        if end >= len(text):
            out.append(text[start:])
            return out
        low = max(end - search, start)
        cut = max(text.rfind(". ", low, end), text.rfind("\n", low, end))
        end = cut + 1 if cut > start else end
        out.append(text[start:end])
        start = end - overlap


CHUNK = "array<struct<number:int,text:string,page:int,section:string,overlap_text:string>>"
BLOCK = "array<struct<text:string,type:string,page:int,section:string>>"


def per_text(f, kind: str, size: Callable = len):
    """A vectorized function of one column; null gives an empty array. What it makes leaves it in pieces, so that none holds the rows of many texts."""

    @F.pandas_udf(kind)
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            for part in pieces(s, size):
                yield pd.Series([[] if x is None else f(x) for x in part], dtype=object)

    return run


def block_rows(blocks: list[Block]) -> list[dict]:
    return [{"text": b.text, "type": "heading" if b.heading else "paragraph", "page": b.page, "section": b.section} for b in blocks]


def chunk_rows(blocks: list[Block]) -> list[dict]:
    return [{"number": c.number, "text": c.text, "page": c.page, "section": c.section, "overlap_text": c.overlap} for c in chunks_of(blocks)]


def segment_pages(segments) -> list[tuple[int, str]]:
    """Pages of a transcript's segments; page 1 where none is named."""
    return [(s["page"] if s["page"] is not None else 1, s["text"]) for s in segments if (s["text"] or "").strip()]


def split_blocks(text: Name) -> Column:
    return per_text(lambda t: block_rows(blocks_of(numbered_pages(t))), BLOCK)(col(text))


def document_chunks(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """Chunks of documents, without a shuffle."""
    cut = per_text(lambda t: chunk_rows(blocks_of(numbered_pages(t))), CHUNK)
    return chunk_table(docs.select(F.col(source).alias("source"), F.explode(cut(F.col(text))).alias("c")))


def segment_chunks(docs: DataFrame, source: str = "source", segments: str = "segments") -> DataFrame:
    """The same from segments array<struct<text, page>>, whose page numbers hold."""
    cut = per_text(lambda x: chunk_rows(blocks_of(segment_pages(x))), CHUNK, lambda x: sum(len(s["text"] or "") for s in x))
    return chunk_table(docs.select(F.col(source).alias("source"), F.explode(cut(F.col(segments))).alias("c")))


def chunk_table(rows: DataFrame) -> DataFrame:
    c = F.col("c")
    overlap, text = c["overlap_text"], c["text"]
    return rows.select(
        F.concat("source", F.lit("_chunk_"), F.lpad(c["number"].cast("string"), F.greatest(F.length(c["number"].cast("string")), F.lit(4)), F.lit("0"))).alias("chunk_id"), "source", text.alias("text"), c["page"].alias("page"), c["section"].alias("section"),
        overlap.alias("overlap_text"), F.size(F.split(stripped(text), r"(?U)\s+")).alias("word_count"), F.length(text).alias("char_count"), F.when(overlap != "", F.concat(overlap, F.lit("\n\n"), text)).otherwise(text).alias("full_text"))


def chunk_windows(docs: DataFrame, key: str, text: str = "text", size: int = K.WINDOW_SIZE, overlap: int = K.WINDOW_OVERLAP, search: int = K.WINDOW_SEARCH) -> DataFrame:
    """key, window, text of each window."""
    cut = per_text(lambda t: windows_of(t, size, overlap, search), "array<string>")
    return docs.select(key, F.posexplode(cut(F.col(text))).alias("window", "text"))
