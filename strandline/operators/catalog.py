"""Listing, filtering and joining of the catalogue: episodes, documents, insights, macros, clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline import constants as K
from strandline.functions import text as T


def page_of(df: DataFrame, order: Sequence, offset: int = 0, limit: int | None = None) -> DataFrame:
    out = df.orderBy(*order).offset(offset)
    return out if limit is None else out.limit(limit)


def filtered_insights(units: DataFrame, source_type: str | None = None, insight_type: str | None = None, has_macro: bool | None = None) -> DataFrame:
    """Filters that are given hold; another source_type than podcast or document, and an empty type, is no filter."""
    if source_type == "podcast":
        units = units.filter("episode_id is not null")
    elif source_type == "document":
        units = units.filter("document_id is not null")
    if insight_type:
        units = units.filter(F.col("type") == insight_type)
    if has_macro is not None:
        units = units.filter(F.col("macro_insight_id").isNotNull() == has_macro)
    return units


def list_unit_insights(units: DataFrame, source_type: str | None = None, insight_type: str | None = None, has_macro: bool | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page, by id, of the insights that the filters leave, and in total how many they leave before paging. A page past the end has no rows."""
    kept = filtered_insights(units, source_type, insight_type, has_macro)
    return page_of(kept, ["id"], offset, limit).crossJoin(F.broadcast(kept.agg(F.count("*").alias("total"))))


def list_macro_insights(macros: DataFrame, units: DataFrame, cluster_id: int | None = None, has_cluster: bool | None = None) -> DataFrame:
    """Macros with their number of members."""
    if cluster_id is not None:
        macros = macros.filter(F.col("cluster_id") == cluster_id)
    if has_cluster is not None:
        macros = macros.filter(F.col("cluster_id").isNotNull() == has_cluster)
    members = units.groupBy(F.col("macro_insight_id").alias("m")).agg(F.count("*").alias("n"))
    return macros.join(members, F.col("id") == F.col("m"), "left").select(*macros.columns, F.coalesce("n", F.lit(0)).alias("unit_count"))


def list_documents(documents: DataFrame, source_type: str | None = None, limit: int | None = None, newest: str = "created_at") -> DataFrame:
    if source_type is not None:
        documents = documents.filter(F.col("source_type") == source_type)
    return page_of(documents, [F.desc(newest), F.desc("id")], 0, limit)


def with_transcript(episodes: DataFrame, there: bool = True) -> DataFrame:
    return episodes.filter(F.col("gcs_transcript_uri").isNotNull() == there)


def episodes_of(episodes: DataFrame, podcast_name: str) -> DataFrame:
    """Of one podcast, the newest first."""
    return episodes.filter(F.col("podcast_name") == podcast_name).orderBy(F.desc("episode_date"), "id")


def find_episode(episodes: DataFrame, audio_url: str | None = None, podcast_name: str | None = None, episode_title: str | None = None) -> DataFrame:
    """By audio URL if one is given, else by podcast and title."""
    if audio_url:
        return episodes.filter(F.col("audio_url") == audio_url)
    return episodes.filter((F.col("podcast_name") == podcast_name) & (F.col("episode_title") == episode_title))


def recent_episodes(feed: DataFrame, after: int | None, published: str = "published_at") -> DataFrame:
    """Published strictly after a unix time, be it by a part of a second; without a date, out. No time given: all rows."""
    return feed.filter(F.unix_micros(F.col(published).cast("timestamp")) > after * 1_000_000) if after else feed


def filter_by_relevance(feed: DataFrame, least: float = 1.0, top: int | None = None, order: str = "id", per: str | None = None, keywords: Sequence[str] = K.KEYWORDS) -> DataFrame:
    """Rows that score at least this, the best first and in feed order within a score; the top of all, or of each per."""
    scored = feed.withColumn("score", T.relevance_score(keywords=keywords)).filter(F.col("score") >= least)
    if top is None:
        return scored
    if per is None:
        return scored.orderBy(F.desc("score"), order).limit(top)
    rank = F.row_number().over(Window.partitionBy(per).orderBy(F.desc("score"), order))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top)


def discover_relevant(feed: DataFrame, first: int = 50, limit: int = 10, least: float = 1.0, cut: float | None = None, newest: str = "published_at", keywords: Sequence[str] = K.KEYWORDS) -> DataFrame:
    """Of the newest episodes of each feed, the most relevant; then a second cut on the score."""
    place = F.row_number().over(Window.partitionBy("feed_id").orderBy(F.desc(newest), "id"))
    recent = feed.withColumn("place", place).filter(F.col("place") <= first)
    best = filter_by_relevance(recent, least, limit, "place", "feed_id", keywords)
    return best if cut is None else best.filter(F.col("score") >= cut)


def ready_sources(episodes: DataFrame, documents: DataFrame, podcast_chunks: DataFrame, document_chunks: DataFrame, units: DataFrame, forced: bool = False) -> DataFrame:
    """kind, id, source of what has a transcript and a chunk and, unless forced, no insight."""

    def side(kind: str, df: DataFrame, key, chunks: DataFrame, owner: str) -> DataFrame:
        out = df.filter(T.is_set("gcs_transcript_uri")).select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), key.alias("source"))
        out = out.join(chunks.select("source").distinct(), "source", "left_semi")
        return out if forced else out.join(units.select(F.col(owner).alias("id")).filter("id is not null").distinct(), "id", "left_anti")

    podcasts = side("podcast", episodes, T.source_key(), podcast_chunks, "episode_id")
    return podcasts.unionByName(side("document", documents, F.col("title"), document_chunks, "document_id")).select("kind", "id", "source")


def pending_insights(units: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Insights without any dimension."""
    return units.join(dimensions.select(F.col("unit_insight_id").alias("id")).distinct(), "id", "left_anti")


def dimensions_to_assess(units: DataFrame, dimensions: DataFrame, skip_existing: bool = True, disabled: Sequence[str] = ()) -> DataFrame:
    """insight_id, dimension_type still to assess: those of the insight's type, trend for unknown types."""
    sets = {k: [d for d in v if d not in disabled] for k, v in (("stake", K.STAKE_DIMENSIONS), ("trend", K.TREND_DIMENSIONS))}
    array = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    wanted = F.when(F.col("type") == "health_stake", array(sets["stake"])).otherwise(array(sets["trend"]))
    todo = units.select(F.col("id").alias("insight_id"), F.explode(wanted).alias("dimension_type"))
    if not skip_existing:
        return todo
    return todo.join(dimensions.select(F.col("unit_insight_id").alias("insight_id"), "dimension_type").distinct(), ["insight_id", "dimension_type"], "left_anti")


def flag_known(feed: DataFrame, episodes: DataFrame) -> DataFrame:
    """already_added: the catalogue has the audio URL."""
    known = episodes.select(F.col("audio_url").alias("known_url")).filter("known_url is not null").distinct()
    return feed.join(known, F.col("audio_url") == F.col("known_url"), "left").withColumn("already_added", F.col("known_url").isNotNull()).drop("known_url")


def resolve_source_ref(refs: DataFrame, episodes: DataFrame, documents: DataFrame, ref: str = "source_ref") -> DataFrame:
    """source_kind and source_id: the podcast and title around the first " - ", else the document with the title; the smallest id of several.

    References that can't name an episode take no part in the join with episodes, nor null ones in any: as null keys they would all meet in one task.
    """
    parts = F.split(F.col(ref), " - ", 2)
    has = F.col(ref).contains(" - ")
    e = episodes.groupBy(F.col("podcast_name").alias("_show"), F.col("episode_title").alias("_episode")).agg(F.min("id").alias("_eid"))
    d = documents.groupBy(F.col("title").alias("_title")).agg(F.min("id").alias("_did"))
    named = refs.filter(has).withColumns({"_a": F.trim(parts[0]), "_b": F.trim(parts[1])})
    named = named.join(e, (F.col("_a") == F.col("_show")) & (F.col("_b") == F.col("_episode")), "left").select(*refs.columns, F.col("_eid").cast("long").alias("_eid"))
    other = refs.filter(~has).select(*refs.columns, F.lit(None).cast("long").alias("_eid"))
    joined = lambda df: df.withColumn("_c", F.trim(F.col(ref))).join(d, F.col("_c") == F.col("_title"), "left").select(*refs.columns, "_eid", F.col("_did").cast("long").alias("_did"))
    blank = refs.filter(F.col(ref).isNull()).select(*refs.columns, F.lit(None).cast("long").alias("_eid"), F.lit(None).cast("long").alias("_did"))
    out = joined(named).unionByName(joined(other)).unionByName(blank)
    kind = F.when(F.col("_eid").isNotNull(), "podcast").when(F.col("_did").isNotNull(), "document")
    return out.select(*refs.columns, kind.alias("source_kind"), F.coalesce("_eid", "_did").alias("source_id"))


def cascade_delete(ids: DataFrame, owner: str, units: DataFrame, dimensions: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of insights, dimensions and evidence once the sources with these ids (column id) are gone."""
    gone = units.join(ids.select(F.col("id").alias(owner)).distinct(), owner, "left_semi").select(F.col("id").alias("unit_insight_id"))
    lost = dimensions.join(gone, "unit_insight_id", "left_semi").select(F.col("id").alias("dimension_id"))
    left_units = units.join(gone.select(F.col("unit_insight_id").alias("id")), "id", "left_anti")
    return left_units, dimensions.join(gone, "unit_insight_id", "left_anti"), evidence.join(lost, "dimension_id", "left_anti")


def by_status(episodes: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """In the order of states that need attention, then the newest first."""
    place = F.coalesce(*(F.when(F.col("status") == s, i) for i, s in enumerate(K.STATUS_ORDER, 1)), F.lit(9))
    return page_of(episodes.withColumn("status_priority", place), ["status_priority", F.desc("created_at"), "id"], offset, limit)


def paged(df: DataFrame, order: Sequence, offset: int, limit: int) -> DataFrame:
    """A page with has_more and next_offset (null on the last page) on each row; one row more than the page is looked at."""
    probe = df.orderBy(*order).offset(offset).limit(limit + 1)
    numbered = probe.withColumn("_row", F.row_number().over(Window.orderBy(*order)))
    more = F.max("_row").over(Window.partitionBy()) > limit
    out = numbered.withColumn("has_more", more).filter(F.col("_row") <= limit)
    return out.withColumn("next_offset", F.when(F.col("has_more"), F.lit(offset + limit))).drop("_row")


def union_of_kinds(podcasts: DataFrame, documents: DataFrame) -> DataFrame:
    return podcasts.withColumn("kind", F.lit("podcast")).unionByName(documents.withColumn("kind", F.lit("document")), allowMissingColumns=True)


def new_ids(after: DataFrame, before: DataFrame, key: str = "id") -> DataFrame:
    return after.select(key).distinct().join(before.select(key), key, "left_anti").orderBy(key)
