"""Semi-structured item documents: read, flatten, look up, window, attach to a parent."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The marker of list documents and the link prefix of an item.
LIST_KIND = "youtube#videoListResponse"
URL_PREFIX = "www.youtube.com/watch?v="

_SNIPPET = "STRUCT<channelId: STRING, title: STRING, description: STRING, publishedAt: STRING>"

ITEM_SCHEMA = (
    f"kind STRING, id STRING, snippet {_SNIPPET}, items ARRAY<STRUCT<id: STRING, snippet: {_SNIPPET}>>, "
    "playlist STRUCT<snippet: STRUCT<title: STRING>>, created_date_time TIMESTAMP"
)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the explicit item schema: no inference pass over the data."""
    return spark.read.schema(ITEM_SCHEMA).json(path)


def parse_items(raw: DataFrame, column: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """Item documents kept as JSON text in a table column; ``keep`` names columns that stay beside the parsed fields.

    The generator yields one row per text. It keeps later filters on the fields above it; as plain columns they would
    be pushed down and every text parsed once per field they name.
    """
    return raw.select(*keep, F.inline_outer(F.array(F.from_json(column, ITEM_SCHEMA))))


def _entry(list_kind: str) -> Column:
    own = F.struct("id", "snippet")
    return F.when(F.col("kind") == list_kind, F.get("items", F.lit(0))).otherwise(own)


def _with_entry(docs: DataFrame, list_kind: str) -> DataFrame:
    return docs.withColumn("entry", _entry(list_kind))


def _well_formed() -> Column:
    """What an item cannot be placed without: kind, an entry with an id and snippet, a playlist, a readable date if any."""
    written = F.col("entry.snippet.publishedAt")
    return (F.col("kind").isNotNull() & F.col("entry.id").isNotNull() & F.col("entry.snippet").isNotNull()
            & F.col("playlist").isNotNull() & (written.isNull() | F.try_to_timestamp(written).isNotNull()))


def flatten_items(docs: DataFrame, list_kind: str = LIST_KIND, url_prefix: str = URL_PREFIX) -> DataFrame:
    """One flat row per well-formed document, whichever of the two shapes it has."""
    snippet = "entry.snippet"
    return _with_entry(docs, list_kind).where(_well_formed()).select(
        F.col("entry.id").alias("item_id"),
        F.col(f"{snippet}.channelId").alias("grp_id"),
        F.coalesce(F.col("playlist.snippet.title"), F.lit("")).alias("playlist"),
        F.try_to_timestamp(F.col(f"{snippet}.publishedAt")).alias("published_at"),
        F.col(f"{snippet}.title").alias("title"),
        F.col(f"{snippet}.description").alias("description"),
        F.concat(F.lit(url_prefix), F.col("entry.id")).alias("url"),
    )


def malformed_items(docs: DataFrame, list_kind: str = LIST_KIND) -> DataFrame:
    """The documents that ``flatten_items`` leaves out, for a quarantine table.

    Parse with ``keep`` for the key and the raw text: of a text that is no JSON nothing else is left.
    """
    kept = F.coalesce(_well_formed(), F.lit(False))
    return _with_entry(docs, list_kind).where(~kept).drop("entry")


def group_lookup(items: DataFrame, groups: DataFrame) -> DataFrame:
    """Attach the group name of a dictionary ``(grp_id, grp)``; an unknown id becomes null.

    No hint: Spark broadcasts the dictionary whenever its measured size allows and shuffles otherwise.
    """
    return items.join(groups, "grp_id", "left")


def ingest_recent(items: DataFrame, as_of: dt.datetime, days: int, limit: int | None = 100,
                  ts: str = "ts", key: str = "event_id", loaded_at: dt.datetime | None = None) -> DataFrame:
    """Items newer than ``as_of`` minus ``days``, newest first, at most ``limit`` (None keeps all), stamped."""
    kind = items.schema[ts].dataType  # a literal of the column's own type lets the scan skip row groups
    since, until = F.lit(as_of - dt.timedelta(days=days)).cast(kind), F.lit(as_of).cast(kind)
    recent = items.where((F.col(ts) >= since) & (F.col(ts) <= until))
    if limit is not None:
        recent = recent.orderBy(F.desc(ts), key).limit(limit)
    return recent.withColumn("loaded_at", F.lit(loaded_at or as_of))


def attach_parent(items: DataFrame, parents: DataFrame, item_key: str, parent_key: str,
                  name: str = "parent") -> DataFrame:
    """Every item with its parent record as one struct column, null when the parent is unknown."""
    boxed = parents.select(F.col(parent_key).alias(item_key), F.struct(*parents.columns).alias(name))
    return items.join(boxed, item_key, "left")
