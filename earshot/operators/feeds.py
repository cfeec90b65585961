"""Feeds: rows of series and items, date cutoffs, upserts of episodes and the messages that follow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.compat import feed_date, first_present, leading_int, plain_duration, present

# What an item without a title is called.
UNTITLED = "Untitled Episode"

#: A feed's item as its XML has it.
ITEM = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("guid", "link", "title", "pubDate", "description", "content")],
        T.StructField("enclosure", T.StructType([T.StructField(f"_{n}", T.StringType()) for n in ("url", "type", "length")])),
        *[T.StructField(f"itunes:{n}", T.StringType()) for n in ("duration", "episode", "season", "episodeType", "explicit")],
        T.StructField("itunes:image", T.StructType([T.StructField("_href", T.StringType())])),
    ]
)


#: A feed's header as its XML has it.
HEADER = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("title", "description", "link", "language", "copyright", "lastBuildDate")],
        T.StructField("image", T.StructType([T.StructField("url", T.StringType())])),
        *[T.StructField(f"itunes:{n}", T.StringType()) for n in ("author", "explicit", "type", "subtitle", "summary")],
        T.StructField("itunes:owner", T.StructType([T.StructField("itunes:name", T.StringType()), T.StructField("itunes:email", T.StringType())])),
        T.StructField("itunes:image", T.StructType([T.StructField("_href", T.StringType())])),
    ]
)


def category_names(xml: Column) -> Column:
    """The names of a feed's categories nested to any depth, a parent before its children, for that is their order in the text; empty ones are left out."""
    found = F.regexp_extract_all(xml, F.lit(r"<(?:itunes:)?category\b[^>]*?\btext\s*=\s*(\"[^\"]*\"|'[^']*')"), F.lit(1))
    plain = lambda t: F.replace(F.replace(F.replace(F.replace(F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&apos;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    return F.filter(F.transform(found, plain), lambda t: t != "")


def category_type(depth: int = 4) -> T.StructType:
    """A category with its children to a fixed depth; Spark has no recursive types."""
    fields = [T.StructField("_text", T.StringType()), T.StructField("_VALUE", T.StringType())]
    if depth > 1:
        fields.append(T.StructField("category", T.ArrayType(category_type(depth - 1))))
    return T.StructType(fields)


def flatten_categories(categories: Column, depth: int = 4) -> Column:
    """The categories' own names and their children's, a parent before its children; empty names are left out.

    ``depth`` is that of the columns' type (see :func:`category_names` for text that nests to any depth).
    """
    if depth < 1:
        return F.array().cast("array<string>")

    def one(x: Column) -> Column:
        own = F.filter(F.array(first_present(x["_text"], x["_VALUE"])), lambda t: t.isNotNull())
        return own if depth == 1 else F.concat(own, F.coalesce(flatten_categories(x["category"], depth - 1), F.array().cast("array<string>")))

    return F.flatten(F.transform(categories, one))


def series_row(feed: Mapping[str, Column], old_title: Column) -> list[Column]:
    """A series as its feed has it; only the fields that ``feed`` names come out.

    The title falls back to the old one, the description to the summary, the picture to the feed's
    plain one; no categories are null, not an empty list; explicit is "yes" or "true"; a type that
    isn't "serial" is "episodic".
    """
    get = lambda n: feed.get(n, F.lit(None).cast("string"))
    made = {
        "title": lambda: first_present(get("title"), old_title),
        "description": lambda: first_present(get("description"), get("summary")),
        "image_url": lambda: first_present(get("itunes_image"), get("image_url")),
        "categories": lambda: F.when(F.size(feed["categories"]) > 0, feed["categories"]),
        "explicit": lambda: F.coalesce(feed["explicit"].isin("yes", "true"), F.lit(False)),
        "series_type": lambda: F.when(feed["series_type"] == "serial", F.lit("serial")).otherwise(F.lit("episodic")),
    }
    plain = ("subtitle", "author", "owner_name", "owner_email", "language", "website_url", "copyright", "last_build_date")
    return [make().alias(n) for n, make in made.items() if n in feed] + [present(feed[n]).alias(n) for n in plain if n in feed]


def first_of(values: Column) -> Column:
    """The first element of what may come once or several times."""
    return F.get(values, F.lit(0))


def episode_row(item: Mapping[str, Column]) -> list[Column]:
    """An item as an episode's metadata.

    The guid falls back to the link, the title and at last the empty text; explicit is only "yes";
    a duration is in seconds and null unless it is a whole number or a clock.
    """
    return [
        F.coalesce(first_present(item["guid"], item["link"], item["title"]), F.lit("")).alias("guid"),
        first_present(item["title"], F.lit(UNTITLED)).alias("title"),
        present(item["description"]).alias("description"),
        present(item["enclosure_url"]).alias("enclosure_url"),
        present(item["enclosure_type"]).alias("enclosure_type"),
        leading_int(item["enclosure_length"]).alias("enclosure_length"),
        present(item["link"]).alias("link"),
        present(item["image_url"]).alias("image_url"),
        plain_duration(item["duration"]).alias("duration_sec"),
        feed_date(item["pub_date"]).alias("published_at"),
        leading_int(item["episode"]).alias("episode_number"),
        leading_int(item["season"]).alias("season_number"),
        first_present(item["episode_type"], F.lit("full")).alias("episode_type"),
        F.coalesce(item["explicit"] == "yes", F.lit(False)).alias("explicit"),
    ]


def after_cutoff(published: Column, cutoff: Column) -> Column:
    """Not before the cutoff; an unknown date or cutoff passes. An unreadable date passes too and is routed by the caller, it doesn't fail the feed."""
    return F.coalesce(published >= cutoff, F.lit(True))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], optional: Sequence[str], nullable: Sequence[str], inserted: Mapping[str, Column]) -> DataFrame:
    """Old rows updated by new ones with the same key, and new rows inserted.

    An ``optional`` column that is null in the new row keeps its old value, a ``nullable`` one takes
    the null. Other columns of ``old`` are kept, and take their value from ``inserted`` in a new row.
    Both sides need unique keys without nulls. ``action`` tells 'inserted', 'updated' or 'kept'.
    Applying the same rows again changes nothing.
    """
    n = new.select(*[F.col(k).alias(f"_n_{k}") for k in keys], *[F.col(c).alias(f"_n_{c}") for c in (*optional, *nullable)], F.lit(True).alias("_new"))
    o = old.withColumn("_old", F.lit(True))
    condition = F.lit(True)
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"_n_{k}"))
    both = o.join(n, condition, "full")
    is_new, is_old = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    out = []
    for c in old.columns:
        if c in keys:
            value = F.coalesce(F.col(c), F.col(f"_n_{c}"))
        elif c in optional:
            value = F.coalesce(F.col(f"_n_{c}"), F.col(c))
        elif c in nullable:
            value = F.when(is_new, F.col(f"_n_{c}")).otherwise(F.col(c))
        else:
            value = F.when(is_old, F.col(c)).otherwise(inserted.get(c, F.lit(None)))
        out.append(value.alias(c))
    return both.select(*out, F.when(is_new & is_old, F.lit("updated")).when(is_new, F.lit("inserted")).otherwise(F.lit("kept")).alias("action"))
