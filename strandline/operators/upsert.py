"""Maintenance of tables: insert or reuse, update, replace, reset. Each returns the new table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline import constants as K
from strandline.functions.lineage import places, settled
from strandline.operators.greedy import first_of_either


def match_episodes(batch: DataFrame, episodes: DataFrame) -> DataFrame:
    """existing_id of each row of a batch: by audio URL, else by podcast and title; the smallest of several."""
    url = episodes.groupBy(F.col("audio_url").alias("_u")).agg(F.min("id").alias("_by_url"))
    name = episodes.groupBy(F.col("podcast_name").alias("_p"), F.col("episode_title").alias("_t")).agg(F.min("id").alias("_by_name"))
    out = batch.join(url, F.col("audio_url") == F.col("_u"), "left").join(name, (F.col("podcast_name") == F.col("_p")) & (F.col("episode_title") == F.col("_t")), "left")
    return out.select(*batch.columns, F.coalesce("_by_url", "_by_name").alias("existing_id"))


def numbered_after(df: DataFrame, table: DataFrame, order: str) -> DataFrame:
    """Ids that go on after the table's largest, in the order given."""
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_top"))
    return places(df, order, name="_at").crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_at")).drop("_at", "_top")


def upsert_episodes(batch: DataFrame, episodes: DataFrame, order: str) -> DataFrame:
    """Every row of a batch with id and created, as if they came one by one, in order: a row is made if neither the table nor a row made before it has
    its audio URL, nor its podcast and title; else it gets the id of the one found, by URL first.

    A null URL, and a name with a null in it, are found by nothing. order must tell the rows apart.
    """
    name = F.concat(F.length("podcast_name").cast("string"), F.lit(":"), "podcast_name", "episode_title")
    found = settled(places(match_episodes(batch, episodes).withColumn("_name", name), order, name="_at"))
    keys = found.filter("existing_id is null").select(F.col("_at").alias("place"), F.col("audio_url").alias("x"), F.col("_name").alias("y"))
    new = settled(numbered_after(keys.join(first_of_either(keys), "place"), episodes, "place"))
    by = lambda c: new.filter(F.col(c).isNotNull()).select(F.col(c).alias(f"_{c}"), F.col("place").alias(f"_p{c}"), F.col("id").alias(f"_i{c}"))
    own = new.select(F.col("place").alias("_po"), F.col("id").alias("_io"))
    out = found.join(own, F.col("_at") == F.col("_po"), "left")
    # what the table has by URL, then a row made before by URL, then by name in the same way
    url = episodes.select(F.col("audio_url").alias("_u")).distinct()
    out = out.join(url, F.col("audio_url") == F.col("_u"), "left").join(by("x"), (F.col("audio_url") == F.col("_x")) & (F.col("_px") < F.col("_at")), "left").join(by("y"), (F.col("_name") == F.col("_y")) & (F.col("_py") < F.col("_at")), "left")
    stored = F.col("existing_id").cast("long")
    id_ = F.coalesce("_io", F.when(F.col("_u").isNotNull(), stored), "_ix", stored, "_iy")
    return out.select(*batch.columns, id_.alias("id"), F.col("_io").isNotNull().alias("created"))


def upsert_documents(batch: DataFrame, documents: DataFrame, order: str) -> DataFrame:
    """Every row of a batch with id and outcome, as if they came one by one, in order: skipped with the known id if the table or a row before it has the
    URI, else processed with a new id; the type defaults to the format. A null URI is found by nothing. order must tell the rows apart."""
    known = documents.filter("gcs_document_uri is not null").groupBy(F.col("gcs_document_uri").alias("_u")).agg(F.min("id").cast("long").alias("_id"))
    found = settled(places(batch.join(known, F.col("gcs_document_uri") == F.col("_u"), "left").withColumn("source_type", F.coalesce("source_type", "format")), order, name="_p"))
    unknown = found.filter("_id is null")
    first = unknown.filter("gcs_document_uri is not null").groupBy("gcs_document_uri").agg(F.min("_p").alias("_p")).select("_p")
    new = settled(numbered_after(first.unionByName(unknown.filter("gcs_document_uri is null").select("_p")), documents, "_p").select(F.col("_p").alias("_pn"), F.col("id").alias("_new")))
    named = new.join(unknown.select(F.col("_p").alias("_pn"), F.col("gcs_document_uri").alias("_un")), "_pn").filter("_un is not null").select("_un", F.col("_new").alias("_first"))
    out = found.join(new, F.col("_p") == F.col("_pn"), "left").join(named, F.col("gcs_document_uri") == F.col("_un"), "left")
    return out.select(*batch.columns, F.coalesce("_id", "_new", "_first").alias("id"), F.when(F.col("_new").isNotNull(), "processed").otherwise("skipped").alias("outcome"))


def select_episodes(feed: DataFrame, chosen: DataFrame, episodes: DataFrame) -> DataFrame:
    """Feed items of the chosen ids (id, place) in place order, with existing_id by audio URL, or the state and empty audio of a new row."""
    known = episodes.groupBy(F.col("audio_url").alias("_u")).agg(F.min("id").alias("existing_id"), F.min_by("status", "id").alias("_status"), F.min_by("gcs_audio_uri", "id").alias("_audio"))
    out = feed.join(chosen.select("id", "place"), "id").join(known, F.col("audio_url") == F.col("_u"), "left")
    new = F.col("existing_id").isNull()
    return out.withColumn("status", F.when(new, "needs_processing").otherwise(F.col("_status"))).withColumn("gcs_audio_uri", F.when(new, "").otherwise(F.col("_audio"))).drop("_u", "_status", "_audio").orderBy("place")


def update_given(table: DataFrame, changes: DataFrame, fields: Sequence[str], key: str = "id") -> DataFrame:
    """Overwrites fields only where the change has a value."""
    side = changes.select(F.col(key).alias("_k"), *(F.col(f).alias(f"_{f}") for f in fields))
    out = table.join(side, F.col(key) == F.col("_k"), "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else c for c in table.columns))


def reindex_source(chunks: DataFrame, new: DataFrame, dim: int | None = None, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The table with all chunks of the new rows' sources replaced, and the rows turned away for a wrong vector length."""
    bad = F.lit(False) if dim is None else ~F.coalesce(F.size(vector) == dim, F.lit(False))
    kept = chunks.join(new.select("source").distinct(), "source", "left_anti").select(chunks.columns)
    return kept.unionByName(new.filter(~bad).select(chunks.columns)), new.filter(bad)


def get_or_create_clusters(clusters: DataFrame, wanted: DataFrame) -> DataFrame:
    """Clusters (id, name, description) with the missing names of wanted (name, and description if there is one) added, ids after the largest in the order of names.

    A new cluster's description is the one that is given, the smallest of several, else the known one of its name. Null names are left out.
    """
    described = lambda df: df if "description" in df.columns else df.withColumn("description", F.lit(None).cast("string"))
    known = F.create_map(*(F.lit(x) for kv in K.PROTOTYPES.items() for x in kv))
    given = F.min(F.when(F.col("description") != "", F.col("description")))
    names = described(wanted).filter("name is not null").groupBy("name").agg(given.alias("_given"))
    missing = names.join(clusters.select("name"), "name", "left_anti").select("name", F.coalesce("_given", known[F.col("name")]).alias("description"))
    columns = ["id", "name", "description"]
    return described(clusters).select(columns).unionByName(numbered_after(missing, clusters, "name").select(columns))


def assign_back(table: DataFrame, assignments: DataFrame, column: str, only_changed: bool = False) -> DataFrame:
    """Sets a column from assignments (id, value); only_changed returns just the rows whose value changes."""
    side = assignments.select(F.col("id").alias("_k"), F.col("value").alias("_v"))
    out = table.join(side, F.col("id") == F.col("_k"), "left")
    if only_changed:
        out = out.filter(F.col("_v").isNotNull() & ~F.col("_v").eqNullSafe(F.col(column)))
    return out.select(*(F.coalesce("_v", c).alias(c) if c == column else c for c in table.columns))


#: What a reset empties, in order, and the links to it that it sets to null in what stays.
RESETS = {
    "dimensions": (("evidence", "dimensions"), ()),
    "clusters": (("macros", "clusters"), (("units", "macro_insight_id"), ("units", "cluster_id"))),
    "units": (("evidence", "dimensions", "units"), ()),
}


def reset(stages: Sequence[str], tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables (units, macros, clusters, dimensions, evidence) after a reset of some stages, and table_name, deleted of those it empties.

    A table that two stages empty counts once.
    """
    gone = dict.fromkeys(t for s in stages for t in RESETS[s][0])
    after = {name: df.limit(0) if name in gone else df for name, df in tables.items()}
    for name, link in (x for s in stages for x in RESETS[s][1]):
        after[name] = after[name].withColumn(link, F.lit(None).cast(tables[name].schema[link].dataType))
    counts = [tables[name].agg(F.count("*").alias("deleted")).select(F.lit(name).alias("table_name"), "deleted") for name in gone]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return after, out


def apply_discovery(units: DataFrame, macros: DataFrame, assigned: DataFrame, centroids: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables units (id, macro_id, ...) and macros (id, name, centroid_embedding) after a step of discovery.

    Macros that gained members get their new centroid; new ones follow with ids after the largest, in the order of their leaders; units are
    linked to what they matched or to the macro of their leader.
    """
    made = settled(numbered_after(new.select("leader", "name", F.col("centroid").alias("centroid_embedding")), macros, "leader"))
    moved = update_given(macros, centroids.select(F.col("macro_id").alias("id"), F.col("centroid").alias("centroid_embedding")), ["centroid_embedding"])
    link = assigned.join(made.select("leader", F.col("id").alias("made")), "leader", "left").select("id", F.coalesce("macro_id", "made").alias("value"))
    return assign_back(units, link, "macro_id"), moved.unionByName(made.select(macros.columns))


def without_insights(sources: DataFrame, units: DataFrame, owner: str, forced: bool = False) -> DataFrame:
    """Sources that extraction still has to see."""
    return sources if forced else sources.join(units.select(F.col(owner).alias("id")).filter("id is not null").distinct(), "id", "left_anti")


def not_indexed(sources: DataFrame, chunks: DataFrame, key: str = "source") -> DataFrame:
    return sources.join(chunks.select(F.col("source").alias(key)).distinct(), key, "left_anti")
