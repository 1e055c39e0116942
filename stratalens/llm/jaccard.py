"""Operator 10, exact n-gram Jaccard join by a token-group matrix.

A document's set is its distinct word shingles, as 64-bit hashes. Equal sets are one class, named by its least id.

Tokens. For sets in a band of sizes, no two sets that reach the similarity differ in more than d shingles. The shingle
space is dealt into d + spare(d) parts by hash; a set's token for a part is the hash of its shingles in that part. Two similar
sets then share at least spare(d) tokens: each differing shingle can spoil one part only. A set whose similar larger sets may
lie in the next band has tokens for that band too. Unlike single shingles, a token is shared by sets that agree in a whole
part, so a passage, line or word pair that many documents hold makes no token frequent.

Groups. Sets that share enough tokens, directly or over others, form a group: see shared_tokens. So similar documents are
partitioned, and no link leaves a group. The token-group matrix stores each group's token union, with the number of holders of
each token in the group. A member's overlap with its group is the number of its tokens that another member holds: an upper bound
of what it shares with any of them. Only members with at least what similar sets share (less where parts of their own are
empty) open their group; the others are done.

Pivots. What is open is first compared with the group's pivot, the member whose tokens are held most: one row a member, plus the
pivot once for each task. Those that link with it are one component and are never compared among themselves. The others have a
second pivot. What is then not with the first pivot queries the group's blocks: parts of what a pivot has gathered, and parts of
what none has. Blocks are groups of the matrix again: an overlap with a block's union below what similar sets share leaves it
shut. A task holds one block and the queries that open it; intersections are counted by an inverted list, and links come out
as a spanning forest. So a large group costs rows in proportion to its members, and comparisons only between what its
pivots have not gathered and the rest.

Rows stay bounded: a token's holders give one row each towards its least holder, equal sets were merged before, and a task
opens one block for a bounded number of queries. Every path is the same at every size; all joins by id are merge joins.

Defined results: a null text or one without words has no set and links with nothing; with fewer words than a shingle the
whole sequence is the shingle; rows that share an id are one document, with the links of all its texts; a row with a null id
links with nothing and has a null component; repeated rows each get the same result; other columns pass through (columns
named like the results are replaced); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release, ship, small_batches, to_bytes
from .components import components

ship(__name__)



def spare(d: int) -> int:
    """Parts beyond the d that differences can spoil: tokens that two similar sets share at least."""
    return 2 + d // 5


#: Members and shingles of a block (16 MB of hashes), which one task holds, and queries and their shingles that it answers.
MOST, MOST_SHINGLES = 4096, 2_000_000


def word_hashes(words: list[bytes], table: dict):
    """64-bit hashes of words; the table of those seen is emptied when it is large."""
    import numpy as np
    import xxhash

    if len(table) > 150_000:
        table.clear()
    for w in set(words).difference(table):
        table[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


def mixed(x):
    """A 64-bit finaliser over an array (shifts and odd multipliers)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, n: int, table: dict):
    """Sorted distinct hashes of a text's n-word shingles (A-Z lower-cased), or None without words."""
    import numpy as np

    words = text.lower().split()
    if not words:
        return None
    h = word_hashes(words, table)
    out = np.zeros(max(1, len(h) - n + 1), np.uint64)
    for i in range(min(n, len(h))):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    return np.unique(mixed(out + np.uint64(min(n, len(h)))))


def bands(share: int, n: int) -> list[tuple[int, int]]:
    """(band, most differing shingles in it) for a set of n: its own band and, where a similar larger set may be there, the next.

    A band ends where its start is times 1 / share squared (share in hundredths). Bands of tiny sets, in which any difference
    is too much, need no tokens: such sets are similar only when equal.
    """
    found, b, start = [], 0, 1
    while True:
        end = max(start + 1, start * 10_000 // share**2 + 1)  # one past the band's last size
        if n < end:
            break
        b, start = b + 1, end
    for _ in range(2):
        last = end - 1
        # |x| + |y| - 2 * intersection, with intersection >= share / (100 + share) * (|x| + |y|), at the largest sizes
        found.append((b, (100 - share) * 2 * last // (100 + share)))
        if share * end > 100 * n:  # the smallest set of the next band is too large for this one
            break
        b, start = b + 1, end
        end = max(start + 1, start * 10_000 // share**2 + 1)
    return found


def tokens_and_need(h, share: int):
    """The tokens of a set of shingle hashes, the least that it shares with a similar set, and, by the band's parity, how many it may go without.

    A token's lowest bit is its band's parity. An empty part has no token (it would be held by many) unless too many are
    empty; it lowers what is sure instead.
    """
    import numpy as np

    out, need, drops = [], None, [0, 0]
    spread = mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    value = mixed(h + np.uint64(0x632BE59BD9B4E019))
    for band, d in bands(share, len(h)):
        if d <= 0:
            continue
        parts = d + spare(d)
        part = (spread % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        held, first = np.unique(part[order], return_index=True)
        tag = np.uint64((band << 32) + 1) + held.astype(np.uint64)
        made = [np.add.reduceat(value[order], first) + tag * np.uint64(0x9E3779B97F4A7C15)]
        sure = spare(d) - (parts - len(held))
        if sure < 1:  # what two such sets share may be empty parts alone
            empty = np.setdiff1d(np.arange(parts), held).astype(np.uint64)
            made.append((np.uint64((band << 32) + 1) + empty) * np.uint64(0x9E3779B97F4A7C15))
            sure = 1
        out.append(mixed(np.concatenate(made)) & ~np.uint64(1) | np.uint64(band & 1))
        need, drops[band & 1] = min(sure, need or sure), sure - 1
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), need or 1, drops


SETS = "doc_id long, n long, fp binary, low long, need int, even int, odd int, tokens array<long>"
#: Lists of holders up to this length are compared pair by pair.
FEW = 16
#: Pivots that a group's members are compared with before its blocks are.
PIVOTS = 2


def _sets(n: int, share: int):
    """Rows (doc_id, text) -> SETS: the size, digest and least hash of each text's set, and its tokens."""

    def make(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        table: dict = {}
        for batch in batches:
            sizes, fps, lows, needs, drops, tokens = [], [], [], [], [], []
            for text in to_bytes(batch.column("text")):
                h = shingle_set(text, n, table)
                t, need, drop = (np.zeros(0, np.uint64), 1, [0, 0]) if h is None else tokens_and_need(h, share)
                sizes.append(0 if h is None else len(h))
                fps.append(None if h is None else hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                lows.append(None if h is None else int(h[:1].view(np.int64)[0]))
                needs.append(need)
                drops.append(drop)
                tokens.append(t.view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64)))
            small = [pa.array(x, pa.int32()) for x in (needs, [x for x, _ in drops], [x for _, x in drops])]
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array(lows, pa.int64()), *small, flat]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "fp", "low", "need", "even", "odd", "tokens"])

    return make


def _hashes(n: int):
    """Rows (id, text) -> (id, set): the sorted shingle hashes as bytes."""

    def make(batches):
        import pyarrow as pa

        table: dict = {}
        for batch in batches:
            sets = [shingle_set(text, n, table) for text in to_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([None if h is None else h.tobytes() for h in sets], pa.binary())], names=["id", "set"])

    return make


def shared_tokens(own: DataFrame) -> tuple[DataFrame, DataFrame, tuple]:
    """own (SETS) -> all tokens with two holders or more (token, id, need), links (a, b) that join similar sets into groups, and what to release after both.

    Similar sets share at least as many tokens of a band as the drop of either says, and one more. Of a set's tokens some
    have few holders, the rest many. Few holders: each pair of them is counted, and linked if it shares as many as the
    drops require when all tokens of many holders are granted. Many holders: sets whose drop such tokens could fill alone
    are linked to the token's least holder of that sort, by those tokens only that are left when each set goes without its
    most held ones; one order for all sets leaves any two of them a common one. So what many documents hold joins no group
    by itself, and pairs are emitted within lists of FEW at most.
    """
    by_token = Window.partitionBy("token")
    drop = F.when(F.col("token") % 2 != 0, F.col("odd")).otherwise(F.col("even"))
    held = own.select(F.explode("tokens").alias("token"), F.col("doc_id").alias("id"), "need", "even", "odd").withColumn("drop", drop)
    shared = held.select("token", "id", "need", "drop").withColumn("holders", F.count("*").over(by_token)).where("holders > 1")
    shared = materialize(shared, "shared-tokens")

    band = Window.partitionBy("id", "odd_band")
    ranked = shared.withColumn("odd_band", F.col("token") % 2 != 0)
    ranked = ranked.withColumns({"nth": F.row_number().over(band.orderBy(F.col("holders").desc(), "token")), "much": F.sum((F.col("holders") > FEW).cast("int")).over(band)})
    ranked = materialize(ranked.select("token", "id", "holders", "drop", "nth", "much"), "ranked-tokens")

    few = ranked.where(F.col("holders") <= FEW).groupBy("token").agg(F.collect_set(F.struct("id", (F.col("drop") + 1 - F.col("much")).alias("least"))).alias("h"))
    pair = lambda x, y: F.struct(F.greatest(x["id"], y["id"]).alias("a"), F.least(x["id"], y["id"]).alias("b"), F.greatest(x["least"], y["least"]).alias("least"))
    each = F.flatten(F.transform("h", lambda x: F.transform(F.filter("h", lambda y: y["id"] < x["id"]), lambda y: pair(x, y))))
    pairs = few.select((F.col("token") % 2 != 0).alias("odd_band"), F.explode(each).alias("p")).groupBy("p.a", "p.b", "odd_band").agg(F.count("*").alias("c"), F.max("p.least").alias("least"))
    near = pairs.where(F.col("c") >= F.col("least")).select("a", "b")

    hot = ranked.where((F.col("holders") > FEW) & (F.col("much") > F.col("drop")) & (F.col("nth") > F.col("drop")))
    stars = hot.select("token", "id").withColumn("head", F.min("id").over(by_token)).where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    return shared.select("token", "id", "need"), near.unionByName(stars).distinct(), (shared, ranked)


def _pairs(out: list[tuple]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def _task_rows(batches):
    """(task, side, id, label, set) of rows sorted by task and side; a batch's end is None."""
    import numpy as np

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("task", "side", "id", "label", "set")]
        for task, side, node, label, h in zip(*columns, strict=True):
            if h is not None:
                yield task, side, node, label, np.frombuffer(h, np.uint64)
        yield None


def _verified(share: int):
    """Rows of tasks, the pivot's first (side 0) -> (a, b): a member and the pivot that it links with."""

    def verified(batches):
        import numpy as np

        task, pivots, out = None, [], []
        for row in _task_rows(batches):
            if row is None:
                yield _pairs(out)
                out = []
                continue
            key, side, node, _, h = row
            if key != task:
                task, pivots = key, []
            if side == 0:
                pivots.append((node, h))
                continue
            for pivot, p in pivots:
                at = np.minimum(np.searchsorted(p, h), len(p) - 1)
                both = int((p[at] == h).sum())
                if 100 * both >= share * (len(p) + len(h) - both):
                    out.append((node, pivot))
                    break
        yield _pairs(out)

    return verified


class Block:
    """The sets of a block, as lists of holders by shingle."""

    def __init__(self, ids: list, labels: list, sets: list):
        import numpy as np

        self.ids, self.labels, self.sizes = ids, labels, np.array([len(s) for s in sets], np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        flat, self.owner = flat[order], owner[order]
        self.first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        self.length = np.diff(np.concatenate([self.first, [len(flat)]]))
        self.shingles = flat[self.first]

    def similar(self, h, share: int):
        """Places of the sets that reach the similarity with the set h."""
        import numpy as np

        at = np.minimum(np.searchsorted(self.shingles, h), len(self.shingles) - 1)
        at = at[self.shingles[at] == h]
        n = self.length[at]
        held = self.owner[np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        shared = np.bincount(held, minlength=len(self.ids))
        return np.flatnonzero((shared > 0) & (100 * shared >= share * (self.sizes + len(h) - shared)))


def _opened(share: int):
    """Rows of tasks, a block's members (side 0) before the queries that open it (side 1) -> (a, b): a spanning forest of their links."""

    def opened(batches):
        task, members, block, parent, out = None, [], None, {}, []

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for row in _task_rows(batches):
            if row is None:
                yield _pairs(out)
                out = []
                continue
            key, side, node, label, h = row
            if key != task:
                task, members, block, parent = key, [], None, {}
            if side == 0:
                members.append((node, label, h))
                continue
            if block is None:
                if not members:
                    continue
                block, members = Block(*map(list, zip(*members, strict=True))), []
            for j in block.similar(h, share):
                x, y = root(label), root(block.labels[j])
                if x != y:
                    parent[y] = x
                    out.append((node, block.ids[j]))
        yield _pairs(out)

    return opened


def _sizes(named: DataFrame) -> DataFrame:
    return named.groupBy(F.col("doc_id").alias("id")).agg(F.min("low").alias("low"), F.sum("n").alias("n"))


def _parts(most: int, shingles: str = "n"):
    """Parts into which a group's rows are cut, so that each is what a task can hold."""
    return F.greatest(F.ceil(F.count("*") / F.lit(most)), F.ceil(F.sum(shingles) / F.lit(MOST_SHINGLES))).cast("int")


def _loaded(tasks: DataFrame, hashes: DataFrame) -> DataFrame:
    """tasks (task, side, id, label) with their sets, each task's rows together and in order of side."""
    return hashes.join(tasks.hint("merge"), "id").repartition("task").sortWithinPartitions("task", "side", "id").select("task", "side", "id", "label", "set")


def qualified(holds: DataFrame) -> DataFrame:
    """holds (token, id, need, grp) -> (id, grp, popular): the members whose overlap with their group's token union opens it.

    popular: how many members hold their tokens, in sum.
    """
    matrix = holds.groupBy("grp", "token").agg(F.count("*").alias("holders"))
    overlap = holds.join(matrix.where("holders > 1").hint("merge"), ["grp", "token"])
    overlap = overlap.groupBy("id", "grp").agg(F.count("*").alias("overlap"), F.min("need").alias("need"), F.sum("holders").alias("popular"))
    return overlap.where("overlap >= need").select("id", "grp", "popular")


def contracted(members: DataFrame, hashes: DataFrame, share: int, most: int) -> tuple[DataFrame, DataFrame]:
    """members (id, grp, popular, low, n) -> labels (id, grp, low, n, label, first), and links (a, b) to pivots.

    label: the pivot that a member links with, else its own id. first: its group's first pivot, which all members were compared with.
    """
    best = F.max_by("id", F.struct("popular", F.bitwise_not("id")))
    labels, found, held = members.withColumn("label", F.col("id")).withColumn("first", F.lit(None).cast("long")), None, []
    for turn in range(PIVOTS):
        rest = labels if turn == 0 else labels.where("label = id and id <> first")
        heads = materialize(rest.groupBy("grp").agg(best.alias("pivot"), F.count("*").alias("size"), _parts(most).alias("parts")).where("size > 1").drop("size"), "pivots")
        each = rest.select("id", "grp").join(heads.hint("merge"), "grp").where("id <> pivot")
        task = lambda part: F.concat_ws("/", F.col("grp").cast("string"), part.cast("string")).alias("task")
        rows = each.select(task(F.pmod(F.xxhash64("id"), "parts")), F.lit(1).alias("side"), "id", F.col("id").alias("label"))
        parts = heads.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.unionByName(parts.select(task(F.col("part")), F.lit(0).alias("side"), F.col("pivot").alias("id"), F.col("pivot").alias("label")))
        links = materialize(_loaded(rows, hashes).mapInArrow(_verified(share), "a long, b long"), "pivot-links")
        found = links if found is None else found.unionByName(links)
        met = links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("pivot"))
        if turn == 0:
            labels = labels.drop("first").join(heads.select("grp", F.col("pivot").alias("first")).hint("merge"), "grp")
        labels = labels.join(met.hint("merge"), "id", "left")
        labels = materialize(labels.select("id", "grp", "popular", "low", "n", F.coalesce("pivot", "label").alias("label"), "first"), "labels")
        release(*held)
        held = [labels]
    return labels, found


def opened_blocks(labels: DataFrame, holds: DataFrame, hashes: DataFrame, share: int, most: int) -> DataFrame:
    """Links (a, b) between members that the first pivot has not gathered and the blocks that their overlaps open.

    A block holds members of one label, or members that no pivot has gathered. First pivots are in none: all were compared with them.
    """
    queries = labels.where("label <> first")
    asked = queries.select("grp").distinct()
    blocked = labels.where("id <> first").join(asked.hint("merge"), "grp", "left_semi")
    # Null: no pivot has gathered it.
    blocked = materialize(blocked.select("id", "grp", "low", "n", "label", F.when(F.col("label") != F.col("id"), F.col("label")).alias("core")), "blocked")
    whole = ["grp", "core"]
    parts = blocked.groupBy(*whole).agg(_parts(most).alias("parts"))
    # Near sets have the same least hash more often than not. A least hash that fills half a block has blocks of its own, by id; the others share blocks.
    many = (F.greatest(F.count("*") / F.lit(most), F.sum("n") / F.lit(MOST_SHINGLES)) > 0.5).alias("many")
    lows = blocked.groupBy(*whole, "low").agg(_parts(most).alias("own"), many).where("many")
    same = lambda other, *keys: [F.col(f"b.{k}").eqNullSafe(F.col(f"{other}.{k}")) for k in keys]
    at = blocked.alias("b").join(parts.alias("p").hint("merge"), same("p", *whole)).join(lows.alias("w").hint("merge"), same("w", *whole, "low"), "left")
    cut = F.when(F.col("p.parts") == 1, F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")))
    cut = cut.when(F.col("w.many"), F.struct(F.col("b.low").alias("x"), F.pmod(F.xxhash64("b.id"), "w.own").alias("y")))
    cut = cut.otherwise(F.struct(F.pmod(F.xxhash64("b.low"), "p.parts").alias("x"), F.lit(-1).cast("long").alias("y")))
    key = F.xxhash64(F.col("b.grp"), F.col("b.core").isNull(), F.coalesce("b.core", F.lit(0)), cut["x"], cut["y"])
    blocked = materialize(at.select("b.id", "b.grp", "b.core", "b.label", "b.n", key.alias("block")), "blocks")

    # The matrix of these blocks, and the overlaps of the queries with them.
    of = holds.select("token", "id", "need").join(blocked.select("id", "grp", "core", "block").hint("merge"), "id")
    of = materialize(of, "block-tokens")
    matrix = of.groupBy("grp", "token", "block", F.col("core").alias("other")).agg(F.count("*").alias("holders")).withColumnRenamed("block", "with")
    asks = of.join(queries.select("id", "label").hint("merge"), "id")
    # What a pivot has gathered asks only what another has: the rest asks it.
    foreign = F.when(F.col("other").isNull(), F.col("label") == F.col("id")).otherwise(F.col("other") != F.col("label"))
    overlap = asks.join(matrix.hint("merge"), ["grp", "token"]).where(foreign & ((F.col("block") != F.col("with")) | (F.col("holders") > 1)))
    opens = overlap.groupBy("id", "label", "with").agg(F.count("*").alias("overlap"), F.min("need").alias("need")).where("overlap >= need")
    opens = materialize(opens.join(blocked.select("id", "n").hint("merge"), "id").select("id", "label", "n", F.col("with").alias("block")), "opens")

    chunks = opens.groupBy("block").agg(_parts(most).alias("parts"))
    task = lambda part: F.concat_ws("/", F.col("block").cast("string"), part.cast("string")).alias("task")
    asking = opens.join(chunks.hint("merge"), "block").select(task(F.pmod(F.xxhash64("id"), "parts")), F.lit(1).alias("side"), "id", "label")
    held = blocked.join(chunks.hint("merge"), "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = materialize(asking.unionByName(held.select(task(F.col("part")), F.lit(0).alias("side"), "id", "label")), "tasks")
    links = materialize(_loaded(tasks, hashes).mapInArrow(_opened(share), "a long, b long"), "block-links")
    release(tasks, opens, of, blocked)
    return links


def join(docs: DataFrame, n: int = 5, share: int = 80, text: str = "text", most: int = MOST) -> DataFrame:
    """docs without the text, with n_shingles and component_id. share: the least Jaccard similarity, in hundredths."""
    small_batches(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c not in ("n_shingles", "component_id")])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = materialize(texts.mapInArrow(_sets(n, share), SETS), "sets")

    # Equal sets: one class each, named by its least id. The other rows of a class are copies and go no further.
    named = sets.where(F.col("fp").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialize(named.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "classes")
    copies = named.select("doc_id", "fp").join(classes.where(F.col("copies") > 1).select("fp", "id").hint("merge"), "fp").where(F.col("doc_id") != F.col("id")).select("doc_id").distinct()
    # An id that has a text of its own besides a copy stays.
    owners = classes.select(F.col("id").alias("doc_id")).distinct()
    copies = materialize(copies.join(owners.hint("merge"), "doc_id", "left_anti"), "copies")
    own = named.join(copies.hint("merge"), "doc_id", "left_anti")
    shared, links, used = shared_tokens(own)

    groups = components(links).select(F.col("node").alias("id"), F.col("component").alias("grp"))
    holds = shared.groupBy("token", "id").agg(F.min("need").alias("need")).join(groups.hint("merge"), "id")
    holds = materialize(holds, "holds")
    release(*used)
    members = materialize(qualified(holds).join(_sizes(named).hint("merge"), "id"), "members")
    texts = texts.where(F.col("text").isNotNull()).withColumnRenamed("doc_id", "id")
    hashes = texts.join(members.select("id").hint("merge"), "id").mapInArrow(_hashes(n), "id long, set binary")
    hashes = materialize(hashes, "member-sets")

    labels, found = contracted(members, hashes, share, most)
    links = found.unionByName(opened_blocks(labels, holds, hashes, share, most))
    release(labels, holds, hashes, members)
    linked = components(links)

    of_class = classes.join(linked, classes["id"] == linked["node"], "left").select("fp", F.coalesce("component", "id").alias("__c"))
    of_class = materialize(of_class, "class-components")
    # A document with several texts is one node: its classes are joined over it.
    met = named.select("doc_id", "fp").join(of_class, "fp").groupBy("doc_id").agg(F.min("__c").alias("__least"), F.max("__c").alias("__most"))
    met = materialize(met, "document-components")
    rest = components(met.select(F.col("__most").alias("a"), F.col("__least").alias("b")).where(F.col("a") != F.col("b")))
    met = met.join(rest, met["__least"] == rest["node"], "left").select(F.col("doc_id").alias("__id"), F.coalesce("component", "__least").alias("__comp"))

    if text in docs.columns and set(docs.columns) <= {"doc_id", text}:
        out = sets.select("doc_id", F.col("n").alias("n_shingles"))
    else:
        out = docs.mapInArrow(_counts(n, docs.columns.index(text), [c for c in docs.columns if c != text] + ["n_shingles"]), _without(docs.schema, text))
    return out.join(met, out["doc_id"].cast("long") == met["__id"], "left").select(*out.columns, F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("__comp"), F.col("doc_id").cast("long"))).alias("component_id"))


def _without(schema: T.StructType, text: str) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != text] + [T.StructField("n_shingles", T.LongType())])


def _counts(n: int, column: int, names: list[str]):
    def count(batches):
        import pyarrow as pa

        table: dict = {}
        for batch in batches:
            sizes = [0 if (h := shingle_set(t, n, table)) is None else len(h) for t in to_bytes(batch.column(column))]
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != column] + [pa.array(sizes, pa.int64())], names=names)

    return count


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document's component under 3-word shingles and a similarity of 90 in 100."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join(docs, 3, 90)
