"""Column functions on text, sources and small records. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline import constants as K

Name = str | Column


def col(c: Name) -> Column:
    return F.col(c) if isinstance(c, str) else c


def source_key(podcast_name: Name = "podcast_name", episode_title: Name = "episode_title") -> Column:
    """Name of a podcast source; null if either part is."""
    return F.concat(col(podcast_name), F.lit(" - "), col(episode_title))


def source_kind(episode_id: Name = "episode_id", document_id: Name = "document_id") -> Column:
    """struct(kind, id): the episode if its id is set and not 0, else the document, else unknown."""
    e, d = col(episode_id).cast("long"), col(document_id).cast("long")
    pair = lambda kind, i: F.struct(F.lit(kind).alias("kind"), i.alias("id"))
    return F.when(e != 0, pair("podcast", e)).when(d != 0, pair("document", d)).otherwise(pair("unknown", F.lit(None).cast("long")))


def relevance_score(title: Name = "title", description: Name = "description", keywords: Sequence[str] = K.KEYWORDS) -> Column:
    """2 for each keyword in the title, else 1 for each in title or description."""
    head = F.lower(F.coalesce(col(title), F.lit("")))
    text = F.concat(head, F.lit(" "), F.lower(F.coalesce(col(description), F.lit(""))))
    return sum((F.when(head.contains(k.lower()), 2.0).when(text.contains(k.lower()), 1.0).otherwise(0.0) for k in keywords), F.lit(0.0))


def strip_overlap(text: Name) -> Column:
    """What follows the first blank-line separator; the text itself if there is none."""
    t = col(text)
    at = F.locate("\n\n", t)
    return F.when(at > 0, F.substring(t, at + 2, F.length(t))).otherwise(t)


def normalize_id(title: Name, most: int = 50, suffix: Name | None = None) -> Column:
    """Title as an id: other characters than letters, digits, space, - and _ become _, spaces too; cut to most characters."""
    clean = F.left(F.translate(F.trim(F.regexp_replace(col(title), r"[^\p{L}\p{N} _-]", "_")), " ", "_"), F.lit(most))
    return clean if suffix is None else F.concat(clean, F.lit("_"), col(suffix))


def suffix_of(path: Name) -> Column:
    """Lower-case extension of a path without its dot; empty if it has none."""
    return F.lower(F.regexp_extract(col(path), r"[^/]\.([^./]+)$", 1))


def resolve_format(explicit: Name, path: Name, filename: Name, source_type: Name) -> Column:
    """The first known of the explicit format, the suffixes of path and filename, and the source type; else unknown."""
    tries = [F.lower(col(explicit)), suffix_of(path), suffix_of(filename), F.lower(col(source_type))]
    return F.coalesce(*(F.when(t.isin(K.FORMATS), t) for t in tries), F.lit("unknown"))


def parse_iso_date(text: Name) -> Column:
    """Timestamp of an ISO string; null if it is none."""
    return F.try_to_timestamp(col(text))


def evidence_metadata(speaker: Name, page: Name, start: Name, end: Name, section: Name) -> Column:
    """Map of the values that are there, start and end under start_time and end_time; null if none is."""
    pairs = {"speaker": speaker, "page": page, "start_time": start, "end_time": end, "section": section}
    full = F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), col(v).cast("string"))))
    kept = F.map_filter(full, lambda _, v: v.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def parse_label(reply: Name) -> Column:
    """Label in a model's reply: of its JSON, else a quoted "label": value, else a text under 100 characters without quotes; null if none."""
    t = F.trim(col(reply))
    whole = F.trim(F.get_json_object(t, "$.label"))
    quoted = F.trim(F.regexp_extract(t, r'"label"\s*:\s*"([^"]+)"', 1))
    short = F.when(F.length(t) < 100, F.trim(F.regexp_replace(t, r"""^["']+|["']+$""", "")))
    some = lambda c: F.when(c != "", c)
    return F.coalesce(some(whole), some(quoted), some(short))


def embedding_text(name: Name = "name", description: Name = "description") -> Column:
    """name. description, or the name alone."""
    d = F.coalesce(col(description), F.lit(""))
    return F.when(d != "", F.concat(col(name), F.lit(". "), d)).otherwise(col(name))


def title_from_path(path: Name) -> Column:
    """File stem with spaces for underscores."""
    return F.translate(F.regexp_replace(F.regexp_extract(col(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", ""), "_", " ")


def preview(text: Name, most: int = 200) -> Column:
    return F.replace(F.left(col(text), F.lit(most)), F.lit("\n"), F.lit(" "))


def is_set(uri: Name) -> Column:
    """Not null and not empty."""
    return F.coalesce(col(uri) != "", F.lit(False))


def parse_uri(uri: Name, scheme: str = "gs") -> Column:
    """struct(bucket, key) of scheme://bucket/key; null for another scheme."""
    pattern = rf"^{scheme}://([^/]*)/?([\s\S]*)$"
    u = col(uri)
    return F.when(u.rlike(pattern), F.struct(F.regexp_extract(u, pattern, 1).alias("bucket"), F.regexp_extract(u, pattern, 2).alias("key")))


# The forms of a heading.
HEADINGS = [r"^#+\s+.+$", r"^[A-Z][A-Z\s]{3,50}$", r"^\d+\.\s+[A-Z].+$", r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,5}:", r"^(?:Chapter|Section|Part)\s+\d+"]


def is_heading(paragraph: Name) -> Column:
    """At most 200 characters, and a heading form at its start."""
    p = F.trim(col(paragraph))
    at_start = "|".join(rf"\A(?m:{h})" for h in HEADINGS)
    return F.coalesce((p != "") & (F.length(p) <= 200) & p.rlike(at_start), F.lit(False))


def sentences(text: Name) -> Column:
    return F.split(col(text), r"(?U)(?<=[.!?])\s+")


def word_set(text: Name) -> Column:
    """Distinct lower-case words, split at white space."""
    parts = F.split(F.lower(F.trim(col(text))), r"(?U)\s+")
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets in arrays; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)
