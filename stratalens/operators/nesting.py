"""Markup as a table of tags, and its elements as intervals of it (a nested set).

A text is cut at its tags by two native expressions; tags are rows, and everything else is windows and equi-joins by text. The level of a
tag is a running sum over those of its name, so a name that is never closed (`p`, `br`) disturbs no other; the k-th opening tag of
a level belongs to the k-th closing one. Names that do not balance in a text have no elements there. An interval that
another overlaps without holding it is told by its depths, which differ at its ends.

Comments, declarations, instructions, and scripts and styles with all they hold, are single tags that open nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is one tag. The elements whose content is no markup.
TAG = r"""(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[!?][^>]*>|</?[a-z][^<>"']*(?:"[^"]*"[^<>"']*|'[^']*'[^<>"']*)*>"""
NAME = r"(?i)^</?([a-z][a-z0-9:_-]*)"


def tag_name(tag: Column) -> Column:
    """Its name in lower case, empty for comments, declarations and instructions."""
    return F.lower(F.regexp_extract(tag, NAME, 1))


def tag_kind(tag: Column) -> Column:
    """open, close, or empty for one that opens nothing."""
    raw = tag.rlike(r"(?is)^<(script|style)\b.*</") | tag_name(tag).isin("") | tag.endswith("/>")
    return F.when(raw, "empty").when(tag.startswith("</"), "close").otherwise("open")


def found(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TAG), F.lit(0))


def between(text: Column) -> Column:
    """What stands around the tags: one string more than there are tags."""
    return F.split(F.coalesce(text, F.lit("")), TAG, -1)


def tokens(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, name, kind, after): the tags of each text in order, and the text up to the next one. A null text has none."""
    both = F.arrays_zip(found(F.col(text)).alias("tag"), F.slice(between(F.col(text)), 2, F.greatest(F.size(between(F.col(text))) - 1, F.lit(0))).alias("after"))
    each = rows.select(key, F.posexplode(both).alias("no", "t")).select(key, "no", F.col("t.tag").alias("tag"), F.col("t.after").alias("after"))
    return each.select(key, "no", tag_name(F.col("tag")).alias("name"), tag_kind(F.col("tag")).alias("kind"), "after")


def _level(kind: Column, over) -> Column:
    """How many elements are open at a tag, its own among them."""
    step = F.when(kind == "open", 1).when(kind == "close", -1).otherwise(0)
    return F.sum(step).over(over.rowsBetween(Window.unboundedPreceding, 0)) + F.when(kind == "close", 1).otherwise(0)


def elements(tags: DataFrame, key: str) -> DataFrame:
    """(key, name, open_no, close_no, depth, nests): elements of names that balance. depth counts such elements only, from 1."""
    own, whole = Window.partitionBy(key, "name"), Window.partitionBy(key)
    tags = tags.where("kind <> 'empty'").select(key, "no", "name", "kind", _level(F.col("kind"), own.orderBy("no")).alias("level"))
    balanced = (F.min("level").over(own) >= 1) & (F.count_if(F.col("kind") == "open").over(own) == F.count_if(F.col("kind") == "close").over(own))
    tags = tags.withColumn("balanced", balanced).where("balanced").drop("balanced")
    tags = tags.withColumns({"rank": F.row_number().over(Window.partitionBy(key, "name", "kind", "level").orderBy("no")), "depth": _level(F.col("kind"), whole.orderBy("no"))})
    opened = tags.where("kind = 'open'").select(key, "name", "level", "rank", F.col("no").alias("open_no"), "depth")
    closed = tags.where("kind = 'close'").select(key, "name", "level", "rank", F.col("no").alias("close_no"), F.col("depth").alias("__depth"))
    out = opened.join(closed, [key, "name", "level", "rank"])
    return out.select(key, "name", "open_no", "close_no", F.col("depth").cast("int").alias("depth"), (F.col("depth") == F.col("__depth")).alias("nests"))


def parents(nested: DataFrame, key: str) -> DataFrame:
    """elements with parent_no: open_no of the innermost element around each, null at the top. Only those that nest take part.

    A parent is the last element of the depth above that opens before: one window over each text's elements, no range join.
    """
    rows = nested.where("nests")
    above = rows.select(key, (F.col("depth") + 1).alias("depth"), F.col("open_no").alias("at"), F.lit(1).alias("side"))
    marks = above.unionByName(rows.select(key, "depth", F.col("open_no").alias("at"), F.lit(0).alias("side")))
    last = F.last(F.when(F.col("side") == 1, F.col("at")), ignorenulls=True).over(Window.partitionBy(key, "depth").orderBy("at", "side"))
    parent = marks.withColumn("parent_no", last).where("side = 0").select(key, F.col("at").alias("open_no"), "parent_no")
    return rows.join(parent, [key, "open_no"])


def inside(tags: DataFrame, key: str, name: str) -> DataFrame:
    """The tags that stand inside an element of a name, the element's own tags not among them: a running sum, whatever else is not closed."""
    own = F.col("name") == name
    step = F.when(own & (F.col("kind") == "open"), 1).when(own & (F.col("kind") == "close"), -1).otherwise(0)
    before = F.coalesce(F.sum(step).over(Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return tags.withColumn("__in", before).where((F.col("__in") > 0) & ~(own & (F.col("kind") == "close") & (F.col("__in") == 1))).drop("__in")


def elements_with_text(tags: DataFrame, key: str) -> DataFrame:
    """(key, no, name, text): elements that hold text and no tag."""
    after = Window.partitionBy(key).orderBy("no")
    following = {c: F.lead(c).over(after) for c in ("name", "kind")}
    rows = tags.withColumns({f"__{c}": x for c, x in following.items()})
    held = (F.col("kind") == "open") & (F.col("__kind") == "close") & (F.col("name") == F.col("__name")) & (F.trim("after") != "")
    return rows.where(held).select(key, "no", "name", F.col("after").alias("text"))


def drop_tags(text: Column, names: list[str]) -> Column:
    """A text without the tags of some names; what they hold stays."""
    kept = F.transform(found(text), lambda t: F.when(tag_name(t).isin(*names) & (tag_kind(t) != "empty"), "").otherwise(t))
    return F.array_join(F.flatten(F.zip_with(between(text), kept, lambda s, t: F.array(s, F.coalesce(t, F.lit(""))))), "")
