"""Passage rows: schema, construction, validation, migration of older layouts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import MAX_FIELD_CHARS, present

SCHEMA_VERSION = 3
KEY_SEPARATOR = "\u001f"

# Asset kinds, their container kinds, optional attributes.
ASSET_TYPES = ("episode", "video", "post", "file", "doc", "repo", "snippet")
PARENT_OF = {
    "episode": "podcast", "video": "channel", "post": "blog", "file": "repository", "doc": "manual",
}
PARENT_TYPES = tuple(PARENT_OF.values())
TOP_LEVEL = ("repo", "snippet")
ATTR_KEYS = (
    "itunes_id", "apple_track_id", "spotify_episode_id", "anchor_id", "duration",
    "youtube_video_id", "youtube_channel_id", "host", "full_name", "path", "ref", "language",
    "slug", "channel", "locale", "sitemap_lastmod", "start_line", "product", "heading", "anchor",
)
# Columns of the older flat layout.
LEGACY_COLUMNS = (
    "podcast_id", "podcast_title", "podcast_author", "episode_id", "episode_title",
    "episode_url", "source_kind", "source_id", "source_title", "source_author", "item_id",
    "item_title", "item_url", "media_kind", "source", "spotify_episode_id", "apple_track_id",
    "itunes_id", "youtube_video_id", "anchor_id", "duration",
)

NODE_FIELDS = ("type", "id", "title", "url", "author")
NODE = T.StructType([T.StructField(name, T.StringType()) for name in NODE_FIELDS])
ATTRS = T.StructType(
    [T.StructField(k, T.IntegerType() if k == "start_line" else T.StringType()) for k in ATTR_KEYS]
)
PASSAGE = T.StructType(
    [
        T.StructField("passage_id", T.StringType()),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("asset", NODE),
        T.StructField("parent", NODE),
        T.StructField("published_at", T.TimestampType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("start_ms", T.LongType()),
        T.StructField("end_ms", T.LongType()),
        T.StructField("audio_url", T.StringType()),
        T.StructField("attrs", ATTRS),
        T.StructField("attrs_extra", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ingest_source", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("ingest_complete", T.BooleanType()),
        T.StructField("text", T.StringType()),
        T.StructField("code", T.StringType()),
    ]
)


def node(type_: Column | str, id_: Column, title: Column, url: Column | None = None, author: Column | None = None) -> Column:
    """Asset or parent struct; blank members become null."""
    none = F.lit(None)
    kind = F.lit(type_) if isinstance(type_, str) else type_
    parts = (kind, id_, title, none if url is None else url, none if author is None else author)
    return F.struct(
        *[present(c.cast("string")).alias(name) for name, c in zip(NODE_FIELDS, parts)]
    )


def attrs(**known: Column) -> Column:
    """Attribute struct from the given members; blank ones become null."""
    unknown = set(known) - set(ATTR_KEYS)
    if unknown:
        raise ValueError(f"unknown attributes: {sorted(unknown)}")
    return F.struct(
        *[
            (
                known.get(f.name, F.lit(None)).cast("int")
                if f.name == "start_line"
                else present(known.get(f.name, F.lit(None)).cast("string"))
            ).alias(f.name)
            for f in ATTRS.fields
        ]
    )


def passage_id(asset: Column, chunk_index: Column) -> Column:
    return F.concat_ws(KEY_SEPARATOR, asset["type"], asset["id"], chunk_index.cast("string"))


def passage_filter(df: DataFrame, asset_type: str, asset_id: str, chunk_index: int | None = None) -> DataFrame:
    """Rows of one asset, or one of its chunks."""
    rows = df.filter((F.col("asset.type") == asset_type) & (F.col("asset.id") == asset_id))
    return rows if chunk_index is None else rows.filter(F.col("chunk_index") == chunk_index)


def to_passages(df: DataFrame) -> DataFrame:
    """Give ``df`` the passage columns in order; what it lacks is null.

    Text and code stay whole; ``validation_errors`` names those that are too long.
    """
    have = set(df.columns)
    columns = []
    for field in PASSAGE.fields:
        if field.name == "passage_id":
            value = passage_id(F.col("asset"), F.col("chunk_index"))
        elif field.name == "schema_version":
            value = F.lit(SCHEMA_VERSION)
        elif field.name not in have:
            value = F.lit(None)
        elif field.name in ("text", "code"):
            value = present(F.col(field.name))
        elif field.name in ("audio_url", "ingest_source"):
            value = present(F.col(field.name))
        else:
            value = F.col(field.name)
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def construction_errors() -> Column:
    """Names of the construction rules a row breaks."""
    asset, parent = F.col("asset"), F.col("parent")
    kinds = F.create_map(*[F.lit(x) for pair in PARENT_OF.items() for x in pair])
    expected = F.try_element_at(kinds, asset["type"])
    top_level = asset["type"].isin(*TOP_LEVEL)
    has_parent = parent.isNotNull()
    rules = {
        "unknown asset type": asset["type"].isNull() | ~asset["type"].isin(*ASSET_TYPES),
        "asset id and title required": present(asset["id"]).isNull() | present(asset["title"]).isNull(),
        "text required": present(F.col("text")).isNull(),
        "parent not allowed": top_level & has_parent,
        "parent required": expected.isNotNull() & ~has_parent,
        "wrong parent type": expected.isNotNull() & has_parent & ~parent["type"].eqNullSafe(expected),
        "parent id and title required": expected.isNotNull()
        & has_parent
        & (present(parent["id"]).isNull() | present(parent["title"]).isNull()),
    }
    return _broken(rules)


def validation_errors() -> Column:
    """Names of the table rules a row breaks: required fields, enums, lengths."""
    asset, parent = F.col("asset"), F.col("parent")
    has_parent = parent.isNotNull()

    def blank(c: Column) -> Column:
        return F.coalesce(F.length(c) < 1, F.lit(True))

    rules = {
        "schema_version": F.col("schema_version").isNull(),
        "asset": asset.isNull(),
        "asset.type": asset.isNotNull() & F.coalesce(~asset["type"].isin(*ASSET_TYPES), F.lit(True)),
        "asset.id": asset.isNotNull() & blank(asset["id"]),
        "asset.title": asset.isNotNull() & blank(asset["title"]),
        "parent.type": has_parent & F.coalesce(~parent["type"].isin(*PARENT_TYPES), F.lit(True)),
        "parent.id": has_parent & blank(parent["id"]),
        "parent.title": has_parent & blank(parent["title"]),
        "chunk_index": F.coalesce(F.col("chunk_index") < 0, F.lit(True)),
        "text": F.coalesce(~F.length("text").between(1, MAX_FIELD_CHARS), F.lit(True)),
        "code": F.coalesce(~F.length("code").between(1, MAX_FIELD_CHARS), F.lit(False)),
    }
    return _broken(rules)


def _broken(rules: Mapping[str, Column]) -> Column:
    return F.array_compact(
        F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()])
    )


def split_valid(df: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without errors, rejected rows with ``reject_reasons``)."""
    marked = df.withColumn("reject_reasons", errors)
    return marked.filter(F.size("reject_reasons") == 0).drop("reject_reasons"), marked.filter(F.size("reject_reasons") > 0)


def from_legacy(df: DataFrame) -> DataFrame:
    """Rewrite rows of any older layout as passages; passages stay as they are.

    The first present value of the new and then the older names wins; attributes are
    pulled up, legacy columns disappear and unknown columns go to ``attrs_extra``.
    """
    types = dict(df.dtypes)

    def old(name: str) -> Column:
        return present(F.col(name).cast("string")) if name in types else F.lit(None).cast("string")

    def member(struct: str, name: str) -> Column:
        if struct in types and name in getattr(df.schema[struct].dataType, "names", []):
            return present(F.col(f"{struct}.{name}").cast("string"))
        return F.lit(None).cast("string")

    kind = F.coalesce(old("source_kind"), old("media_kind"))
    video_key = F.coalesce(old("youtube_video_id"), member("attrs", "youtube_video_id"))
    asset_type = (
        F.when(member("asset", "type").isin(*ASSET_TYPES), member("asset", "type"))
        .when((kind == "youtube") | video_key.isNotNull(), F.lit("video"))
        .when(kind.isin("github", "repo"), F.lit("repo"))
        .when(kind == "snippet", F.lit("snippet"))
        .otherwise(F.lit("episode"))
    )
    asset_id = F.coalesce(member("asset", "id"), old("item_id"), old("episode_id"))
    title = F.coalesce(member("asset", "title"), old("item_title"), old("episode_title"), asset_id)
    url = F.coalesce(member("asset", "url"), old("item_url"), old("episode_url"))
    found = {key: F.coalesce(member("attrs", key), old(key)) for key in ATTR_KEYS}
    found["youtube_video_id"] = F.coalesce(found["youtube_video_id"], F.when(asset_type == "video", asset_id))
    kinds = F.create_map(*[F.lit(x) for pair in PARENT_OF.items() for x in pair])
    parent_id = F.coalesce(member("parent", "id"), old("source_id"), old("podcast_id"))
    parent_title = F.coalesce(member("parent", "title"), old("source_title"), old("podcast_title"), parent_id)
    parent = node(
        F.coalesce(member("parent", "type"), F.try_element_at(kinds, asset_type)),
        parent_id,
        parent_title,
        member("parent", "url"),
        F.coalesce(member("parent", "author"), old("source_author"), old("podcast_author")),
    )
    known = {f.name for f in PASSAGE.fields} | set(LEGACY_COLUMNS) | set(ATTR_KEYS)
    extras = [c for c in df.columns if c not in known]
    extra = F.create_map(*[x for c in extras for x in (F.lit(c), F.col(c).cast("string"))]) if extras else F.create_map().cast("map<string,string>")
    if "attrs_extra" in types:
        extra = F.map_concat(F.coalesce(F.col("attrs_extra"), F.create_map().cast("map<string,string>")), extra)
    extra = F.map_filter(extra, lambda _, v: v.isNotNull())
    passthrough = ("published_at", "chunk_index", "start_ms", "end_ms", "ingested_at", "ingest_complete", "text", "code", "audio_url")
    columns = {
        "asset": F.when(
            asset_id.isNotNull() & title.isNotNull(), node(asset_type, asset_id, title, url, member("asset", "author"))
        ),
        "parent": F.when(~asset_type.isin(*TOP_LEVEL) & parent_id.isNotNull(), parent),
        "attrs": attrs(**found),
        "attrs_extra": F.when(F.size(extra) > 0, extra),
        "ingest_source": F.coalesce(old("ingest_source"), old("source")),
    }
    return to_passages(
        df.select(*[c.alias(name) for name, c in columns.items()], *[F.col(c) for c in passthrough if c in types])
    )


def drop_legacy(df: DataFrame) -> DataFrame:
    return df.drop(*LEGACY_COLUMNS)


# --- projections ----------------------------------------------------------------------

HIT_COLUMNS = (
    "schema_version", "asset", "parent", "audio_url", "attrs", "start_ms", "end_ms",
    "published_at", "chunk_index", "text", "code",
)


def hit_projection(df: DataFrame, *extra: str) -> DataFrame:
    """The eleven passage columns a ranked hit carries, plus ``extra``."""
    return df.select("passage_id", *HIT_COLUMNS, *extra)


def wide_projection(df: DataFrame) -> DataFrame:
    """Hit columns and the older names, null where a table lacks them."""
    names = [n for n in (*HIT_COLUMNS, *LEGACY_COLUMNS) if n not in ("schema_version", "code", "source", "anchor_id", "duration")]
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])


def shape_hit(df: DataFrame) -> DataFrame:
    """Hit columns for output: ISO date, float score, defaults instead of nulls."""
    return df.withColumns(
        {
            "published_at": F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ssXXX"),
            "score": F.coalesce(F.col("score").cast("double"), F.lit(0.0)),
            "audio_url": F.coalesce(F.col("audio_url"), F.lit("")),
            "match_types": F.coalesce(F.col("match_types"), F.array().cast("array<string>")),
        }
    )


def lookup_asset(df: DataFrame, asset_id: str) -> DataFrame:
    """Asset, parent, audio and attributes of an id; first kind and chunk when several."""
    keys = [c for c in ("episode_id", "item_id") if c in df.columns]
    wanted = F.col("asset.id") == asset_id
    for key in keys:
        wanted = wanted | (F.col(key) == asset_id)
    found = from_legacy(df.filter(wanted))
    return (
        found.orderBy("asset.type", "chunk_index")
        .limit(1)
        .select("asset", "parent", F.coalesce("audio_url", F.lit("")).alias("audio_url"), "attrs")
    )
