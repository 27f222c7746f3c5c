"""Transcripts and feeds of any JSON shape, turned into columns with variants and built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import Name, col

EPISODE = "id LONG, title STRING, enclosureUrl STRING, datePublished LONG, duration LONG, description STRING, episode LONG, season LONG, image STRING"
PODCAST = "id LONG, title STRING, author STRING, description STRING, url STRING, image STRING, language STRING, categories MAP<STRING, STRING>, episodeCount LONG"


def stripped(text: Name) -> Column:
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def parse_episodes(feed: DataFrame, item: str = "item", feed_id: str = "feed_id") -> DataFrame:
    """Typed episodes of feed items in JSON; 0, Unknown and an empty URL for what is missing; no date for 0 or null."""
    e = F.from_json(item, EPISODE)
    at = e["datePublished"]
    return feed.select(
        F.coalesce(e["id"], F.lit(0)).alias("episode_id"), feed_id, F.coalesce(e["title"], F.lit("Unknown")).alias("title"), F.coalesce(e["enclosureUrl"], F.lit("")).alias("audio_url"),
        F.when(at != 0, F.timestamp_seconds(at)).alias("published_at"), e["duration"].alias("duration"), e["description"].alias("description"),
        e["episode"].alias("episode_number"), e["season"].alias("season_number"), e["image"].alias("image_url"))


def parse_podcasts(feed: DataFrame, item: str = "item") -> DataFrame:
    p = F.from_json(item, PODCAST)
    return feed.select(
        F.coalesce(p["id"], F.lit(0)).alias("feed_id"), F.coalesce(p["title"], F.lit("Unknown")).alias("title"), p["author"].alias("author"), p["description"].alias("description"), p["url"].alias("url"),
        p["image"].alias("image_url"), p["language"].alias("language"), F.coalesce(F.map_values(p["categories"]), F.array().cast("array<string>")).alias("categories"), p["episodeCount"].alias("episode_count"))


def kind(v: Column) -> Column:
    """string, array, object or other."""
    s = F.schema_of_variant(v)
    return F.when(s == "STRING", "string").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").otherwise("other")


def get(v: Column, path: str, to: str = "string") -> Column:
    return F.try_variant_get(v, path, to)


def first_said(v: Column, *keys: str) -> Column:
    """The first of the keys with a text that is not empty; null if none."""
    return F.coalesce(*(F.when(get(v, f"$.{k}") != "", get(v, f"$.{k}")) for k in keys))


def has(v: Column, key: str) -> Column:
    return get(v, f"$.{key}", "variant").isNotNull()


def transcript_text(json: Name) -> Column:
    """Text of a transcript. A string is itself; of a list the strings and texts of its objects, by lines; of an object the first key present of
    text, transcript, content, else its segments' or results' texts by lines; anything else, and what is not JSON, as it is written."""
    v = F.try_parse_json(col(json))
    items = get(v, "$", "array<variant>")
    listed = F.array_join(F.filter(F.transform(items, lambda x: F.when(kind(x) == "string", get(x, "$")).when(kind(x) == "object", first_said(x, "text", "content", "transcript"))), lambda t: t.isNotNull()), "\n")
    direct = F.when(has(v, "text"), get(v, "$.text")).when(has(v, "transcript"), get(v, "$.transcript")).when(has(v, "content"), get(v, "$.content"))
    segments = F.filter(F.transform(get(v, "$.segments", "array<variant>"), lambda x: first_said(x, "text")), lambda t: t.isNotNull())
    results = F.transform(get(v, "$.results", "array<variant>"), lambda x: F.coalesce(first_said(x, "text", "transcript"), F.lit("")))
    of_object = F.when(has(v, "text") | has(v, "transcript") | has(v, "content"), direct).otherwise(F.coalesce(F.array_join(segments, "\n"), F.array_join(results, "\n"), F.to_json(v)))
    return F.when(v.isNull(), col(json)).when(kind(v) == "string", get(v, "$")).when(kind(v) == "array", listed).when(kind(v) == "object", of_object).otherwise(col(json))


def normalize_transcript(json: Name) -> Column:
    """struct(text, segments(text, start, end), language) of a recognizer's output: a string, or an object with segments or chunks."""
    v = F.try_parse_json(col(json))
    segment = lambda text, start, end: F.struct(text.alias("text"), start.alias("start"), end.alias("end"))
    zero = F.lit(0.0)

    def one(x: Column) -> Column:
        stamp = get(x, "$.timestamp", "array<double>")
        pair = F.coalesce(F.size(stamp) >= 2, F.lit(False))
        start = F.when(pair, F.coalesce(F.get(stamp, 0), zero)).otherwise(F.coalesce(get(x, "$.start", "double"), zero))
        end = F.when(pair, F.coalesce(F.get(stamp, 1), F.coalesce(F.get(stamp, 0), zero))).otherwise(F.coalesce(get(x, "$.end", "double"), zero))
        return F.when(kind(x) == "object", segment(F.coalesce(get(x, "$.text"), F.lit("")), start, end)).when(kind(x) == "string", segment(get(x, "$"), zero, zero))

    some = lambda k: F.when(F.size(get(v, f"$.{k}", "array<variant>")) > 0, get(v, f"$.{k}", "array<variant>"))
    raw = F.coalesce(some("segments"), some("chunks"), F.array().cast("array<variant>"))
    segments = F.filter(F.transform(raw, one), lambda s: s.isNotNull())
    whole = F.when(kind(v) == "string", get(v, "$")).otherwise(col(json))
    plain = F.struct(whole.alias("text"), F.array(segment(whole, zero, zero)).alias("segments"), F.lit("en").alias("language"))
    text = F.when(has(v, "text"), get(v, "$.text")).otherwise(F.array_join(F.transform(segments, lambda s: s["text"]), " "))
    full = F.struct(text.alias("text"), segments.alias("segments"), F.coalesce(get(v, "$.language"), F.lit("en")).alias("language"))
    return F.when(F.coalesce(kind(v) == "object", F.lit(False)), full).otherwise(plain)


def words_to_segments(results: Name, default_language: str = "en-US") -> Column:
    """struct(text, segments, language) of recognizer results: array<struct<transcript, language, words array<struct<word, start, end>>>>. Results without words drop out."""
    r = col(results)
    kept = F.filter(r, lambda x: F.size(x["words"]) > 0)
    at = lambda w, i, f: F.round(F.element_at(w, i)[f], 3)
    segments = F.transform(kept, lambda x: F.struct(at(x["words"], 1, "start").alias("start"), at(x["words"], -1, "end").alias("end"), stripped(x["transcript"]).alias("text"), x["words"].alias("words")))
    spoken = F.filter(F.transform(r, lambda x: x["language"]), lambda x: x.isNotNull() & (x != ""))
    return F.struct(F.array_join(F.transform(segments, lambda s: s["text"]), " ").alias("text"), segments.alias("segments"), F.coalesce(F.get(spoken, 0), F.lit(default_language)).alias("language"))


def pages_to_segments(pages: DataFrame, key: str = "source", page: str = "page", text: str = "text", max_pages: int | None = None) -> DataFrame:
    """A row for each document: segments(page, text) of pages that are not blank, their texts joined both ways, and how many there are."""
    if max_pages is not None:
        pages = pages.filter(F.col(page) <= max_pages)
    kept = pages.select(key, F.col(page).cast("int").alias("page"), stripped(text).alias("text")).filter("text <> ''")
    out = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("segments"))
    texts = F.transform("segments", lambda s: s["text"])
    return out.withColumns({"text": F.array_join(texts, "\n\n"), "plain_text": F.array_join(texts, "\n\n\n"), "total_pages": F.size("segments")})


def transform_transcript(json: Name) -> Column:
    """struct(segments, metadata): the segments as variants, and all other keys with their JSON values."""
    v = F.try_parse_json(col(json))
    every = F.from_json(col(json), "map<string, string>")
    return F.struct(F.coalesce(get(v, "$.segments", "array<variant>"), F.array().cast("array<variant>")).alias("segments"), F.map_filter(every, lambda k, _: k != "segments").alias("metadata"))


def merge_transcript(metadata: Name, title: Name) -> Column:
    """Metadata with the episode's title over an old one."""
    m = F.map_filter(F.coalesce(col(metadata), F.create_map().cast("map<string, string>")), lambda k, _: k != "episode_title")
    return F.map_concat(m, F.create_map(F.lit("episode_title"), col(title)))
