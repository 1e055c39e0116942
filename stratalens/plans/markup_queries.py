"""Queries over the markup of pages: nested elements, what holds text, what stands inside, and texts without some tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nesting
from .queries import query, table

_TAG = nesting.TAG.replace("'", "''")
_NAME = r"lower(regexp_extract(tag, '(?i)^</?([a-z][a-z0-9:_-]*)', 1))"
_KIND = rf"CASE WHEN regexp_matches(tag, '(?is)^<(script|style)\b.*</') OR {_NAME} = '' OR tag LIKE '%/>' THEN 'empty' WHEN tag LIKE '</%' THEN 'close' ELSE 'open' END"
_TOKENS = f"""l AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '{_TAG}') AS tags, string_split_regex(coalesce(html, ''), '{_TAG}') AS texts FROM pages),
  s AS (SELECT page_id, tags[i] AS tag, texts[i + 1] AS after, (i - 1)::INT AS no FROM (SELECT *, unnest(range(1, len(tags) + 1)) AS i FROM l)),
  t AS (SELECT page_id, no, {_NAME} AS name, {_KIND} AS kind, after FROM s)"""


def _level(over: str) -> str:
    return f"sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER ({over} ORDER BY no) + CASE kind WHEN 'close' THEN 1 ELSE 0 END"


def _tokens(spark, sf_dir):
    return nesting.tokens(table(spark, sf_dir, "pages"), "page_id", "html")


_ELEMENTS = f"""{_TOKENS}, a AS (SELECT page_id, no, name, kind, {_level("PARTITION BY page_id, name")} AS level FROM t WHERE kind <> 'empty'),
  b AS (SELECT *, {_level("PARTITION BY page_id")} AS depth, row_number() OVER (PARTITION BY page_id, name, kind, level ORDER BY no) AS k FROM
    (SELECT a.* FROM a JOIN (SELECT page_id, name FROM a GROUP BY ALL HAVING min(level) >= 1 AND sum(CASE kind WHEN 'open' THEN 1 ELSE -1 END) = 0) USING (page_id, name))),
  e AS (SELECT o.page_id, o.name, o.no AS open_no, c.no AS close_no, o.depth::INT AS depth, o.depth = c.depth AS nests FROM b o JOIN b c
    ON o.page_id = c.page_id AND o.name = c.name AND o.level = c.level AND o.k = c.k AND o.kind = 'open' AND c.kind = 'close')"""


@query("nested_elements", f"""WITH {_ELEMENTS}, n AS (SELECT * FROM e WHERE nests)
  SELECT x.page_id, x.name, x.open_no, x.close_no, x.depth, coalesce(max(y.open_no), -1)::INT AS parent_no FROM n x LEFT JOIN n y ON x.page_id = y.page_id AND y.open_no < x.open_no AND y.close_no > x.close_no GROUP BY ALL""")  # fmt: skip
def nested_elements(spark, sf_dir):
    found = nesting.parents(nesting.elements(_tokens(spark, sf_dir), "page_id"), "page_id")
    return found.select("page_id", "name", "open_no", "close_no", "depth", F.coalesce("parent_no", F.lit(-1)).alias("parent_no"))


@query("unbalanced_names", f"""WITH {_TOKENS} SELECT page_id, name, count(*) FILTER (kind = 'open') AS opened, count(*) FILTER (kind = 'close') AS closed FROM t WHERE kind <> 'empty'
  GROUP BY page_id, name HAVING opened <> closed""")  # fmt: skip
def unbalanced_names(spark, sf_dir):
    per = _tokens(spark, sf_dir).where("kind <> 'empty'").groupBy("page_id", "name").agg(F.count_if(F.col("kind") == "open").alias("opened"), F.count_if(F.col("kind") == "close").alias("closed"))
    return per.where("opened <> closed")


@query("elements_with_text", f"""WITH {_TOKENS} SELECT page_id, no, name, after AS text FROM (SELECT *, lead(name) OVER w AS n2, lead(kind) OVER w AS k2 FROM t WINDOW w AS (PARTITION BY page_id ORDER BY no))
  WHERE kind = 'open' AND k2 = 'close' AND name = n2 AND trim(after, ' ') <> ''""")  # fmt: skip
def elements_with_text(spark, sf_dir):
    return nesting.elements_with_text(_tokens(spark, sf_dir), "page_id")


@query("inside_lists", f"""WITH {_TOKENS} SELECT page_id, name, kind, count(*) AS n FROM (SELECT *, coalesce(sum(CASE WHEN name = 'ul' AND kind = 'open' THEN 1 WHEN name = 'ul' AND kind = 'close' THEN -1 ELSE 0 END)
  OVER (PARTITION BY page_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM t) WHERE d > 0 AND NOT (name = 'ul' AND kind = 'close' AND d = 1) GROUP BY ALL""")  # fmt: skip
def inside_lists(spark, sf_dir):
    return nesting.inside(_tokens(spark, sf_dir), "page_id", "ul").groupBy("page_id", "name", "kind").agg(F.count("*").alias("n"))


@query("pages_without_links", f"""WITH {_TOKENS.split(", s AS")[0].split("," + chr(10) + "  s AS")[0]} SELECT page_id, md5(array_to_string(list_transform(range(1, len(texts) + 1), lambda i: texts[i] || coalesce(CASE WHEN
  regexp_matches(tags[i], '(?i)^</?(a|b)([^a-z0-9:_-]|$)') AND NOT ends_with(tags[i], '/>') THEN '' ELSE tags[i] END, '')), '')) AS digest FROM l""")  # fmt: skip
def pages_without_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(nesting.drop_tags(F.col("html"), ["a", "b"])).alias("digest"))
