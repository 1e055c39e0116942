"""Operator 11, phrase collocations by SETM relational mining.

The occurrence relation R_k has, for each document, where its frequent phrases of k words begin and which they are, sorted by
position; pieces are set apart by a gap, so phrases never cross them. R_k is written, merge-joined with itself at adjacent
positions (a phrase and the one that begins a word later make one of k + 1 words), counted by group, and semi-joined
with the frequent groups to give R_(k+1). Nothing is lost by going on from frequent phrases only: no phrase is more
frequent than its parts.

Documents never meet in a join, so the relations are not shuffled; what is shuffled are counts, combined in each task. The
frequent groups are broadcast while they are at most `few`; beyond, occurrences are joined to them by a shuffle and gathered
by document again.

Defined results: null and empty texts have no words; a null language is `und`, together with texts marked so; repeated rows count
each time; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize, prefix_sums, release, ship, small_batches, to_bytes

ship(__name__)

#: What ends a piece, and what stands between the words of one.
ENDS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
_UPPER = bytes(range(65, 91))
#: A-Z in lower case, every end of a piece as byte 255, which UTF-8 never holds.
_FOLD = bytes.maketrans(_UPPER + ENDS + b"\t", _UPPER.lower() + b"\xff" * len(ENDS) + b" ")

RELATION = "doc long, gap array<int>, id array<int>"


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in order, with a byte 255 for each end of a piece."""
    return text.translate(_FOLD).replace(b"\xff", b" \xff ").split()


def _count_words(batches):
    """(lang, word, n) of a task, given out whenever many are held."""
    import pyarrow as pa

    def out():
        for lang, c in held.items():
            c.pop(b"\xff", None)
            words = pa.array(c.keys(), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), words, pa.array(c.values(), pa.int64())], names=["lang", "word", "n"])

    held: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), to_bytes(batch.column("text")), strict=True):
            held.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, held.values())) > 300_000:
            yield from out()
            held = {}
    yield from out()


class _Ids(dict):
    def __missing__(self, word):
        return -1


def _relation_batch(docs, lens, gaps, ids):
    """Documents with any occurrences, as a batch of the relation."""
    import numpy as np
    import pyarrow as pa

    some = lens > 0
    offsets = pa.array(np.concatenate([[0], np.cumsum(lens[some])]).astype("i4"))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype("i4"))) for x in (gaps, ids)]
    return pa.RecordBatch.from_arrays([pa.array(docs[some], pa.int64()), *lists], names=["doc", "gap", "id"])


def _first_relation(known):
    """R_1 from texts and the ids of the frequent words by language."""

    def make(batches):
        import numpy as np

        ids_of = {lang: _Ids(words) for lang, words in known.value.items()}
        for batch in batches:
            lens, gaps, ids = [], [], []
            for lang, text in zip(batch.column("lang").to_pylist(), to_bytes(batch.column("text")), strict=True):
                words = words_of(text)
                found = np.fromiter(map(ids_of.get(lang, _Ids()).__getitem__, words), "i4", len(words))
                at = np.flatnonzero(found >= 0)
                lens.append(len(at))
                gaps.append(np.diff(at, prepend=-1))
                ids.append(found[at])
            if lens:
                yield _relation_batch(batch.column("doc").to_numpy(), np.array(lens), np.concatenate(gaps), np.concatenate(ids))

    return make


def _flat_words(batches):
    """(doc, pos, lang, word) of every word: what a dictionary too large for broadcast is joined to."""
    import pyarrow as pa

    for batch in batches:
        docs = zip(batch.column("doc").to_pylist(), batch.column("lang").to_pylist(), to_bytes(batch.column("text")), strict=True)
        for doc, lang, text in docs:
            rows = [(i, w) for i, w in enumerate(words_of(text)) if w != b"\xff"]
            for k in range(0, len(rows), 100_000):
                pos, words = zip(*rows[k : k + 100_000], strict=True)
                columns = [pa.array([doc] * len(pos), pa.int64()), pa.array(pos, pa.int32()), pa.array([lang] * len(pos), pa.string()), pa.array(words, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "pos", "lang", "word"])


def _joined(batch):
    """The merge join of a batch of R_k with itself at adjacent positions: row number, position, left << 32 | right.

    Both sides are sorted by document and position, so the partner of an occurrence can only be the next one.
    """
    import numpy as np

    gap, ids = (batch.column(c).flatten().to_numpy() for c in ("gap", "id"))
    lens = np.diff(batch.column("gap").offsets.to_numpy()).astype("i8")
    row = np.repeat(np.arange(len(lens)), lens)
    if len(gap) < 2:
        none = np.zeros(0, "i8")
        return none, none, none
    at = np.cumsum(gap, dtype="i8")
    at -= np.repeat(np.concatenate([[0], at])[np.cumsum(lens) - lens], lens) + 1  # positions begin anew with each document
    adjacent = np.flatnonzero((row[1:] == row[:-1]) & (gap[1:] == 1))
    return row[adjacent], at[adjacent], ids[adjacent].astype("i8") << 32 | ids[adjacent + 1]


def _count_pairs(batches):
    """(l, r, n) of a task, combined while it runs and given out whenever many are held."""
    import numpy as np
    import pyarrow as pa

    def combined():
        pair, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(pair, kind="stable")
        pair, n = pair[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        return pair[first], np.add.reduceat(n, first)

    def out(pair, n):
        for k in range(0, len(pair), 100_000):
            p = pair[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array((p >> 32).astype("i4")), pa.array((p & 0xFFFFFFFF).astype("i4")), pa.array(n[k : k + 100_000])], names=["l", "r", "n"])

    held, size = [], 0
    for batch in batches:
        pair, n = np.unique(_joined(batch)[2], return_counts=True)
        held.append((pair, n))
        size += len(pair)
        if size > 3_000_000:
            held = [combined()]
            size = len(held[0][0])
            if size > 1_500_000:
                yield from out(*held[0])
                held, size = [], 0
    if size:
        yield from out(*combined())


def _next_relation(known):
    """R_(k+1): the adjacent pairs of R_k that are frequent groups, by the groups' sorted keys."""

    def make(batches):
        import numpy as np

        keys, numbers = known.value
        for batch in batches:
            row, at, pair = _joined(batch)
            k = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
            hit = np.flatnonzero(keys[k] == pair) if len(keys) else k[:0]
            row, at = row[hit], at[hit]
            first = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
            gaps = np.where(first, at + 1, np.diff(at, prepend=0))
            yield _relation_batch(batch.column("doc").to_numpy(), np.bincount(row, minlength=batch.num_rows), gaps, numbers[k[hit]])

    return make


def _flat_pairs(batches):
    """(doc, pos, l, r) of every adjacent pair: what groups too many for broadcast are joined to."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        row, at, pair = _joined(batch)
        columns = [batch.column("doc").to_numpy()[row], at.astype("i4"), (pair >> 32).astype("i4"), (pair & 0xFFFFFFFF).astype("i4")]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["doc", "pos", "l", "r"])


def _gathered(flat: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """The relation from single occurrences semi-joined with the frequent groups by a shuffle; adaptive handling splits frequent ones."""
    rows = flat.join(groups.select(*keys, "id").hint("merge"), keys).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("o"))
    earlier = F.concat(F.array(F.lit(-1)), F.slice(F.col("o.pos"), 1, F.size("o") - 1))
    return rows.select("doc", F.zip_with(F.col("o.pos"), earlier, lambda x, y: x - y).alias("gap"), F.col("o.id").alias("id"))


def _numbered(groups: DataFrame, keys: list[str], name: str) -> DataFrame:
    """groups with dense int ids in the order of their keys."""
    out = prefix_sums(groups.withColumn("one", F.lit(1).cast("long")), keys, {"id": "one"}, name)
    return out.drop("one").withColumn("id", F.expr("cast(id as int)"))


def mine(docs: DataFrame, support: int = 100, longest: int = 5, first: int = 2000, percent: int = 100, few: int = 500_000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `first` best phrases of 2 to `longest` words.

    A phrase that lies in a longer one with at least `percent` in 100 of its occurrences is left out. The score is that of the
    cut that explains the phrase best: floor(1000 * a * n / (l * r)), in exact decimals of 38 digits. At most 2^31 phrases
    of one length may be frequent (a larger number ends the job with an error).
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).withColumn("doc", F.monotonically_increasing_id())
    counts = texts.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("a"))
    counts = materialize(counts, "words")
    totals = counts.groupBy("lang").agg(F.sum("a").alias("n"))

    groups = _numbered(counts.where(F.col("a") >= support), ["lang", "word"], "frequent-words")
    alone = F.array("a")
    groups = materialize(groups.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", alone.alias("heads"), alone.alias("tails")), "groups-1")
    if groups.count() <= few:
        ids: dict = {}
        for row in groups.select("lang", "phrase", "id").toLocalIterator():
            ids.setdefault(row[0], {})[row[1].encode()] = row[2]
        known = spark.sparkContext.broadcast(ids)
        relation = texts.mapInArrow(_first_relation(known), RELATION)
    else:
        relation = _gathered(texts.mapInArrow(_flat_words, "doc long, pos int, lang string, word string"), groups.withColumnRenamed("phrase", "word"), ["lang", "word"])
    relation = materialize(relation, "relation-1")

    levels: list[DataFrame] = []
    for k in range(2, longest + 1):
        pairs = relation.select("gap", "id").mapInArrow(_count_pairs, "l int, r int, n long").groupBy("l", "r").agg(F.sum("n").alias("a")).where(F.col("a") >= support)
        found = _numbered(pairs, ["l", "r"], "frequent-pairs")
        head, tail = groups.alias("h"), groups.alias("t")
        made = found.alias("f").join(head, F.col("f.l") == F.col("h.id")).join(tail, F.col("f.r") == F.col("t.id"))
        heads, tails = (F.concat(F.col(f"{x}.{y}"), F.array("f.a")) for x, y in (("h", "heads"), ("t", "tails")))
        made = made.select("f.id", "h.lang", F.concat_ws(" ", "h.phrase", "t.last").alias("phrase"), F.col("t.last").alias("last"), "f.a", heads.alias("heads"), tails.alias("tails"), "f.l", "f.r")
        groups = materialize(made, f"groups-{k}")
        levels.append(groups)
        n = groups.count()
        if not n or k == longest:
            break
        if n <= few:
            table = groups.select("l", "r", "id").toArrow()
            known = spark.sparkContext.broadcast(_sorted_keys(table))
            following = relation.mapInArrow(_next_relation(known), RELATION)
        else:
            following = _gathered(relation.mapInArrow(_flat_pairs, "doc long, pos int, l int, r int"), groups, ["l", "r"])
        following = materialize(following, f"relation-{k}")
        release(relation)
        relation = following
    return _ranked(levels, totals, first, percent)


def _sorted_keys(table):
    import numpy as np

    pair = table["l"].to_numpy().astype("i8") << 32 | table["r"].to_numpy()
    order = np.argsort(pair)
    return pair[order], table["id"].to_numpy()[order]


def _ranked(levels: list[DataFrame], totals: DataFrame, first: int, percent: int) -> DataFrame:
    out = None
    for i, groups in enumerate(levels):
        rows = groups.select("id", "lang", "phrase", "a", "heads", "tails")
        if i + 1 < len(levels):
            longer = levels[i + 1].select(F.explode(F.array("l", "r")).alias("id"), F.col("a").alias("b")).groupBy("id").agg(F.max("b").alias("b"))
            rows = rows.join(longer, "id", "left").where(F.col("b").isNull() | (100 * F.col("b") < percent * F.col("a"))).drop("b")
        rows = rows.drop("id")
        out = rows if out is None else out.unionByName(rows)
    cut = """array_min(transform(sequence(1, size(heads) - 1), j -> named_struct(
        'score', (cast(1000 as decimal(38,0)) * a * n) div (cast(element_at(heads, j) as decimal(38,0)) * element_at(tails, size(heads) - j)),
        'cut', j, 'l', element_at(heads, j), 'r', element_at(tails, size(heads) - j))))"""
    out = out.join(totals, "lang").withColumn("c", F.expr(cut)).select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return out.withColumn("rank", rank).where(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the first 2,000 collocations of each language over all documents."""
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


ORACLE = r"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces WHERE len(w) > 0),
spans AS (SELECT lang, w[i : i + k - 1] AS p FROM (SELECT *, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM starts)),
f AS MATERIALIZED (SELECT lang, array_to_string(p, ' ') AS phrase, any_value(p) AS p, any_value(len(p)) AS k, count(*) AS c FROM spans GROUP BY ALL),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
g AS MATERIALIZED (SELECT * FROM f WHERE c >= 100),
parts AS (SELECT lang, phrase, c AS a, j, array_to_string(p[1 : j], ' ') AS head, array_to_string(p[j + 1 : k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM g WHERE k >= 2)),
cuts AS (SELECT t.lang, t.phrase, t.a, n.n, t.j, x.c AS l, y.c AS r, ((1000::HUGEINT * t.a * n.n) // (x.c::HUGEINT * y.c))::BIGINT AS score
  FROM parts t JOIN n ON n.lang = t.lang JOIN g x ON x.lang = t.lang AND x.phrase = t.head JOIN g y ON y.lang = t.lang AND y.phrase = t.tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
within AS (SELECT lang, array_to_string(p[i : i + m - 1], ' ') AS phrase, max(c) AS b
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM g WHERE k >= 3)) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN within USING (lang, phrase) WHERE b IS NULL OR 100 * b < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
