"""Operator 8, secret scans by a trigram inverted index. DataFrame functions only.

Every rule is a regular expression; its Boolean trigram query is derived from its syntax tree: a disjunction of the strings
of which each match holds one, each the conjunction of its trigrams (lower-cased for rules that ignore case). The index
holds postings (trigram, document) of the trigrams that some query names; a query is answered by intersecting postings,
and only its candidates are verified with the expression. Rules without a mandatory trigram scan every text.

The index is restricted to named trigrams, so a document gives a bounded number of postings whatever its length, and
postings of a document meet through one aggregation that combines before the shuffle. The candidates are written and
joined back: their size on disk is then known, and the planner broadcasts them below its threshold and joins by shuffle
beyond it.

Defined results: null and empty texts have no spans; rows that repeat an id share their postings and are each verified on
their own text; null ids are matched null-safe; other columns pass through (columns named like the results are
replaced); an empty table gives an empty result. Spans count code points, the end is exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, texts_of


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def factors(pattern: str, fold: bool, most: int = 64) -> list[frozenset[str]]:
    """Sets of strings derived from a regular expression: every match holds, of each set, at least one string.

    Runs of literals, small classes, options and alternatives multiply out to strings; anything else ends the run.
    """
    from re import _parser as parser

    def low(c: int) -> str:
        return chr(c).lower() if fold else chr(c)

    def exact(node) -> frozenset[str] | None:
        """All strings that this node can match, if they are few."""
        op, arg = node
        if op is parser.LITERAL:
            return frozenset([low(arg)])
        if op is parser.IN and all(o is parser.LITERAL for o, _ in arg):
            return frozenset(low(c) for _, c in arg)
        if op is parser.SUBPATTERN:
            return product(arg[3])
        if op is parser.BRANCH:
            each = [product(b) for b in arg[1]]
            return None if None in each else frozenset().union(*each)
        if op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and arg[1] == 1:
            once = product(arg[2])
            return None if once is None else once | (frozenset() if arg[0] else {""})
        return None

    def product(nodes) -> frozenset[str] | None:
        out = frozenset([""])
        for node in nodes:
            each = exact(node)
            if each is None or len(out) * len(each) > most:
                return None
            out = frozenset(a + b for a in out for b in each)
        return out

    found, run = [], frozenset([""])
    for node in parser.parse(pattern):
        each = exact(node)
        if each is not None and len(run) * len(each) <= most:
            run = frozenset(a + b for a in run for b in each)
        else:
            found.append(run)
            run = each if each is not None and len(each) <= most else frozenset([""])
            op, arg = node
            if each is None and op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and arg[0] and len(arg[2]) == 1 and exact(arg[2][0]):
                found.append(exact(arg[2][0]))
    return [f for f in [*found, run] if f != {""}]


@dataclass(frozen=True)
class Rule:
    """kind; pattern; the group whose length counts and its least length; fold: its letters are looked up in lower case."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    fold: bool = False

    def query(self) -> list[frozenset[str]]:
        """The Boolean trigram query: a match holds all trigrams of one of these sets. Empty: no trigram is mandatory.

        Of the pattern's factors the one whose shortest string is longest is used; a set that holds another is dropped.
        """
        usable = [f for f in factors(self.pattern, self.fold) if min(map(len, f)) >= 3]
        if not usable:
            return []
        best = max(usable, key=lambda f: min(map(len, f)))
        sets = {frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in best}
        return sorted((x for x in sets if not any(y < x for y in sets)), key=sorted)


_NAMES = ("password", "passwd", "secret", "token")
_ASSIGN = "(" + "|".join(map(_any_case, _NAMES)) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"

#: The base rules, in the order in which they are listed.
BASE = (
    Rule("assign", _ASSIGN + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]{32,}", 0, 32),
)
#: What the method adds: kinds of key that are known by a fixed prefix or header.
ADDED = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
)
RULES = BASE + ADDED

SPAN = "struct<start:int,nth:int,kind:string,end:int>"
#: Elements of an array that are folded at once: an append copies no more than these, so a fold is linear in the array.
FOLD = 256


def folded(array: Column, state: Column, kind: str, step) -> Column:
    """The arrays (of type `kind`) that step(state, element) -> struct(state, out) gives for each element, in one array.

    The array is folded in chunks of FOLD: outputs are appended within a chunk, and chunks to the array of chunks.
    """
    none, nested = F.array().cast(kind), F.array().cast(f"array<{kind}>")
    starts = F.when(F.size(array) > 0, F.sequence(F.lit(1), F.greatest(F.size(array), F.lit(1)), F.lit(FOLD)))
    chunks = F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda at: F.slice(array, at, F.lit(FOLD)))

    def one(acc, x):
        made = step(acc["state"], x)
        return F.struct(made["state"].alias("state"), F.concat(acc["out"], made["out"]).alias("out"))

    def many(acc, chunk):
        inner = F.aggregate(chunk, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return F.struct(inner["state"].alias("state"), F.array_append(acc["out"], inner["out"]).alias("out"))

    return F.aggregate(chunks, F.struct(state.alias("state"), nested.alias("out")), many, lambda acc: F.flatten(acc["out"]))


def trigrams(rules=RULES) -> list[tuple[str, bool]]:
    """(trigram, looked up in lower case) of all queries."""
    return sorted({(g, r.fold) for r in rules for s in r.query() for g in s})


def postings(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The inverted index: (trigram, folded, doc_id), one row for each document and named trigram that it holds."""
    plain = docs.select("doc_id", texts_of(docs, text).alias("t")).where(F.length("t") > 2)
    plain = plain.withColumn("l", F.lower("t"))
    held = [F.when(F.contains(F.col("l" if fold else "t"), F.lit(g)), F.struct(F.lit(g).alias("trigram"), F.lit(fold).alias("folded"))) for g, fold in trigrams(rules)]
    if not held:
        return plain.select(F.lit("").alias("trigram"), F.lit(False).alias("folded"), "doc_id").limit(0)
    hits = plain.select("doc_id", F.explode(F.array_compact(F.array(*held))).alias("p"))
    return hits.select("p.trigram", "p.folded", "doc_id")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, kinds): the rules whose Boolean query the document's postings satisfy. One aggregation intersects all of them."""
    named = trigrams(rules)
    words = -(-len(named) // 62)
    held = []
    for w in range(words):
        mask = F.lit(0).cast("long")
        for i, (g, fold) in enumerate(named):
            if i // 62 == w:
                mask = F.when((F.col("trigram") == g) & (F.col("folded") == fold), F.lit(1 << (i % 62)).cast("long")).otherwise(mask)
        held.append(F.bit_or(mask).alias(f"m{w}"))
    met = index.groupBy("doc_id").agg(*held)

    def whole(conjunct: frozenset[str], fold: bool) -> Column:
        out = F.lit(True)
        for w in range(words):
            mask = sum(1 << (i % 62) for i, (g, f) in enumerate(named) if f == fold and g in conjunct and i // 62 == w)
            if mask:
                out = out & (F.col(f"m{w}").bitwiseAND(F.lit(mask)) == mask)
        return out

    kinds = []
    for r in rules:
        if r.query():
            hit = F.lit(False)
            for conjunct in r.query():
                hit = hit | whole(conjunct, r.fold)
            kinds.append(F.when(hit, F.lit(r.kind)))
    return met.select("doc_id", F.array_compact(F.array(*kinds)).alias("kinds")).where(F.size("kinds") > 0)


def spans(text: Column, rule: Rule, nth: int) -> Column:
    """The rule's matches in a text: leftmost, non-overlapping, those with a too short group dropped.

    What split() leaves between matches and the matches themselves give the positions.
    """
    between = F.split(text, rule.pattern, -1)
    match = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else match
    pieces = F.arrays_zip(between.alias("b"), match.alias("m"), group.alias("g"))  # one value: none of the three is made again for each element
    none = F.array().cast(f"array<{SPAN}>")

    def step(at, p):
        start = at + F.char_length(p["b"])
        end = start + F.char_length(p["m"])
        span = F.struct(start.alias("start"), F.lit(nth).alias("nth"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        kept = F.when(F.char_length(p["g"]) >= rule.least, F.array(span)).otherwise(none)
        return F.struct(F.coalesce(end, at).alias("state"), kept.alias("out"))

    found = folded(pieces, F.lit(0), f"array<{SPAN}>", step)
    return F.when(F.rlike(text, F.lit(rule.pattern)), found).otherwise(none)


def _listed(array: Column) -> Column:
    return F.concat_ws(",", F.transform(F.array_sort(array), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, rules=RULES, n_base: int = len(BASE), text: str = "text") -> DataFrame:
    """docs with n_<kind> of each base rule, base (its spans listed), spans (all spans listed) and found (an array of spans)."""
    made = [f"n_{r.kind}" for r in rules[:n_base]] + ["base", "spans", "found"]
    docs = docs.select(*[c for c in docs.columns if c not in made])
    met = materialize(candidates(postings(docs, rules, text), rules), "secret-candidates").withColumnsRenamed({"doc_id": "__id", "kinds": "__kinds"})
    rows = docs.join(met, docs["doc_id"].eqNullSafe(met["__id"]), "left").drop("__id")
    t, none = texts_of(rows, text), F.array().cast(f"array<{SPAN}>")
    rows = rows.withColumns({f"__{r.kind}": F.when(F.array_contains("__kinds", r.kind), spans(t, r, i)).otherwise(none) if r.query() else spans(t, r, i) for i, r in enumerate(rules)})
    base = F.concat(*[F.col(f"__{r.kind}") for r in rules[:n_base]])
    found = F.concat(*[F.col(f"__{r.kind}") for r in rules])
    counts = [F.size(f"__{r.kind}").cast("long").alias(f"n_{r.kind}") for r in rules[:n_base]]
    return rows.select(*docs.columns, *counts, _listed(base).alias("base"), _listed(found).alias("spans"), F.array_sort(found).alias("found"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the secrets of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span's characters replaced by its kind in brackets; spans that overlap are one."""
    rows = scan(docs, text=text)

    def step(at, s):
        start, end = F.greatest(s["start"], at), F.greatest(s["end"], at)
        keep = F.substring(F.col(text), at + 1, start - at)
        mark = F.when(s["start"] >= at, F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(end.alias("state"), F.array(keep, mark).alias("out"))

    after = F.array_max(F.transform("found", lambda s: s["end"]))
    tail = F.substring(F.col(text), after + 1, F.char_length(F.col(text)))
    clean = F.concat(F.array_join(folded(F.col("found"), F.lit(0), "array<string>", step), ""), tail)
    cleaned = F.when(F.size("found") > 0, clean).otherwise(F.col(text))
    return rows.select(*[cleaned.alias(text) if c == text else F.col(c) for c in docs.columns])


def _sql_spans(r: Rule, nth: int) -> str:
    p = r.pattern.replace("'", "''")
    group = f"regexp_extract_all(t, '{p}', {r.group})"
    return f"""
  SELECT rid, doc_id, '{r.kind}' AS kind, {nth} AS nth, s AS start_, s + len(m) AS end_ FROM (
    SELECT rid, doc_id, unnest(ms) AS m, unnest(gs) AS g, unnest(list_transform(range(len(ms)), lambda i: (list_sum(list_transform(bs[1:i + 1], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i], lambda x: len(x))), 0))::BIGINT)) AS s
    FROM (SELECT rid, doc_id, regexp_extract_all(t, '{p}') AS ms, {group} AS gs, regexp_split_to_array(t, '{p}') AS bs FROM d WHERE regexp_matches(t, '{p}'))
  ) WHERE len(g) >= {r.least}"""


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_sql_spans(r, i) for i, r in enumerate(RULES))}),
a AS (
  SELECT rid, count(*) FILTER (WHERE nth = 0) AS n_assign, count(*) FILTER (WHERE nth = 1) AS n_access, count(*) FILTER (WHERE nth = 2) AS n_hex,
         string_agg(kind || ':' || start_ || ':' || end_, ',' ORDER BY start_, nth) FILTER (WHERE nth < {len(BASE)}) AS base,
         string_agg(kind || ':' || start_ || ':' || end_, ',' ORDER BY start_, nth) AS spans
  FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""
