"""Collocations, shards and alignment against brute-force versions, on rows with every awkward case."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("stratalens.llm")
import public_tokenizers  # noqa: E402

from stratalens.llm import alignment, collocations, sharding  # noqa: E402
from tests.llm.test_text_operators import TEXTS, pairs  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, n_a string, shard string, slot int, doc string, extra int"
MORE = ["New York, new york; NEW YORK!new york", "a a a a a", "x.y:z\x0bw\x0cv\rn\tm", "the big apple\nthe big apple", "É É", "ab" * 400 + "!" * 300, "don't  can't 's ' s", "\r\n \r\n a", "a\x00b", " nbsp x", "🙂" * 60, "aaaa aaa aa a", " a", "a ", " "]


@pytest.fixture(scope="module")
def rows():
    texts = [*TEXTS, *MORE]
    out = [(i, t, ["en", "de", None, "und"][i % 4], "x", "x", 1, "x", 7) for i, t in enumerate(texts)]
    return out + [out[5], out[5], (None, "one two three", None, None, None, None, None, None), (None, None, "en", None, None, None, None, None)] + [(100 + i, "New York is new york", "en", None, None, None, None, None) for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def brute_collocations(rows, support, longest, first):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = r[2] if r[2] is not None else "und"
        piece: list[str] = []
        for part in (r[1] or "").translate(lower).translate(str.maketrans(dict.fromkeys(".,;:!?\n\x0b\x0c\r", "\n"))).split("\n"):
            piece = [w for w in part.replace("\t", " ").split(" ") if w]
            n[lang] += len(piece)
            for k in range(1, longest + 1):
                f[lang].update(tuple(piece[i : i + k]) for i in range(len(piece) - k + 1))
    out = []
    for lang, c in f.items():
        good = {p: a for p, a in c.items() if len(p) >= 2 and a >= support}
        held = []
        for p, a in good.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in good.items()):
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            held.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(held)[:first], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out, key=repr)


@pytest.mark.parametrize("few", [500_000, 0])
@pytest.mark.parametrize(("support", "first"), [(2, 2000), (5, 7)])
def test_collocations(rows, docs, few, support, first):
    got = collocations.mine(docs, support=support, first=first, few=few)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_collocations(rows, support, 5, first)


def test_collocations_of_nothing(docs):
    assert collocations.mine(docs.limit(0)).count() == 0 and collocations.mine(docs.where("text IS NULL")).count() == 0


def brute_shards(rows, shards, points, spark):
    """Rows in turn to the first shard with room clockwise, round by round."""
    from pyspark.sql import functions as F

    made = [(i, "k%d" % r[0] if r[0] is not None else "t" + hashlib.sha256((r[1] or "").encode()).hexdigest()) for i, r in enumerate(rows)]
    hashed = spark.createDataFrame(made, "i int, own string").select("i", F.xxhash64("own", F.lit("place")), F.xxhash64("own", F.lit("turn"))).collect()
    places, owner = sharding.ring(shards, points)
    room = sharding.capacities("rows", len(rows), shards, 0)
    waiting = {i: (turn, next((k for k, p in enumerate(places) if p >= place), 0)) for i, place, turn in hashed}
    loads, full = [0] * shards, [False] * shards
    per: dict[int, int] = {}
    while waiting:
        came = defaultdict(list)
        for i, (turn, k) in waiting.items():
            while full[owner[k % len(owner)]]:
                k += 1
            came[owner[k % len(owner)]].append((turn, i))
        for s, who in came.items():
            for _, i in sorted(who)[: room[s]]:
                per[i] = s
                del waiting[i]
                loads[s] += 1
            room[s] -= min(room[s], len(who))
        full = [r == 0 for r in room]
    return loads, per


def test_shards_by_rows(spark, rows, docs):
    out = sharding.assign(docs, shards=7, points=16).collect()
    loads, per = brute_shards(rows, 7, 16, spark)
    assert len(out) == len(rows) and set(Counter(r.shard for r in out).values()) <= {len(rows) // 7, len(rows) // 7 + 1}
    assert [Counter(r.shard for r in out)[s] for s in range(7)] == loads
    unique = {i: r[0] for i, r in enumerate(rows) if r[0] is not None and sum(x[0] == r[0] for x in rows) == 1}
    got = {r.doc_id: r.shard for r in out}
    assert all(got[d] == per[i] for i, d in unique.items())
    for s in range(7):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(loads[s]))
    facts = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode()), r[7]) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.extra) for r in out) == facts
    assert sharding.assign(docs.limit(0)).count() == 0


def test_shards_by_bytes_and_few_rows_move(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', cast(id % 97 as int)) AS text")
    out = sharding.assign(docs, shards=10, law="bytes", slack=0.02).groupBy("shard").sum("size").collect()
    total = sum(r[1] for r in out)
    assert len(out) == 10 and max(r[1] for r in out) <= total / 10 * 1.02 + 105
    before, after = ({r.doc_id: r.shard for r in sharding.assign(docs, shards=n).collect()} for n in (10, 11))
    assert sum(before[d] != after[d] for d in before) < 0.2 * len(before)  # one in eleven must; all but one would by remainders
    assert before == {r.doc_id: r.shard for r in sharding.assign(docs.repartition(5), shards=10).collect()}


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = alignment.byte_level()
    docs = []
    for t in texts:
        s, a, b = f" {t}".encode(), tk.encode(f" {t}", add_special_tokens=False).ids, sp.encode(t or "")
        left = [bytes(letters[c] for c in tk.id_to_token(i)) for i in a]
        right = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(left) != s or b"".join(right) != s:
            docs.append(None)
            continue
        ends = [[sum(map(len, x[: i + 1])) for i in range(len(x))] for x in (left, right)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        group = lambda ids, at: [[i for i, e in zip(ids, at, strict=True) if lo < e <= hi] for lo, hi in zip([0, *cuts], cuts, strict=False)]
        docs.append((len(a), len(b), list(zip(group(a, ends[0]), group(b, ends[1]), strict=True))))
    df = Counter(x for d in docs if d for x in {(p, q) for x, y in d[2] for p in x for q in y})
    best = defaultdict(int)
    for (p, _), n in df.items():
        best[p] = max(best[p], n)
    out = []
    for d in docs:
        links = [(p, q) for x, y in d[2] for p in x for q in y] if d else []
        digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in d[2]).encode()).hexdigest() if d else ""
        out.append((*((d[0], d[1], len(d[2])) if d else (0, 0, 0)), len(links), sum(df[x] == best[x[0]] for x in links), sum(df[x] for x in links), digest))
    return out, df


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_alignment(rows, docs, few):
    rows = [r if r[1] is None or len(r[1]) < 5000 else (r[0], r[1][:3000], *r[2:]) for r in rows]
    docs = docs.sparkSession.createDataFrame(rows, SCHEMA).repartition(3)
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    out, links = alignment.align(docs, *paths, few=few)
    want, df = brute_alignment([r[1] for r in rows])
    assert pairs(out, "doc_id", *alignment.MADE) == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=repr)
    assert {(r.a, r.b): r.n for r in links.collect()} == dict(df) and "extra" in out.columns


def test_alignment_of_nothing_and_of_large_groups(spark, docs):
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    assert alignment.align(docs.limit(0), *paths)[0].count() == 0
    texts = ["9" * 5000 + "é" * 100, "=-" * 900, "x" * 4000, "0123456789" * 300]
    out, _ = alignment.align(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), *paths)
    want, _ = brute_alignment(texts)
    assert pairs(out, *alignment.MADE) == sorted(want, key=repr)
