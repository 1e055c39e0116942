"""Operator 13, alignment of two tokenizers with a fast path for tokens that both have.

Both encode the same bytes; offsets where tokens of both end cut them into groups. Most groups hold one token of each, whose
bytes are then the same: an array over A's vocabulary gives B's id of the same bytes, so these links are one number each and
are counted in vectors of the vocabulary's length. Only links of other groups become pairs, which are counted by a shuffle
of what each task has combined.

A text is cut before spaces that follow something else than white space. Neither tokenizer joins across such a place (A's words hold
white space only in front, B's pieces hold markers only in front), so each distinct part is aligned once in a worker's table.
Per document its distinct links with their numbers are written; totals need the corpus-wide counts and are joined to them.

Defined results: a text that is null or empty, or that either tokenizer does not give back byte by byte, has zeros and an empty
digest and counts for no link; repeated rows are documents of their own; other columns pass through, those named like the
results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ChunkTable, materialize, ship, slices, small_batches, to_bytes, worker_table
from .sentencepiece_codec import MARK, markers_lead
from .tokens import load_file

ship(__name__)

MADE = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
#: Links of one group up to which they are listed one by one; larger groups give each distinct link with its number.
LISTED = 256


def byte_level() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin characters stand for themselves, the others for 256 upwards."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def splits_before_spaces(raw: bytes) -> bool:
    """Whether A is byte-level, changes no text, and cuts by the usual pattern, in which words hold white space only in front."""
    spec = json.loads(raw)
    pre = spec.get("pre_tokenizer") or {}
    return not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


class Pair:
    """Both tokenizers in a worker: ids, each id's bytes, and the identity map."""

    def __init__(self, raw: bytes, model: bytes):
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        tk = Tokenizer.from_buffer(raw)
        tk.no_truncation()
        tk.no_padding()
        tk.encode_special_tokens = True
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters = byte_level()
        vocab = tk.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(sp.vocab_size())]
        self.length_a, self.length_b = (np.array([len(x) for x in t], "i8") for t in (self.bytes_a, self.bytes_b))
        of_bytes = {x: i for i, x in reversed([*enumerate(self.bytes_b)])} | {x: i for i, x in enumerate(self.bytes_b) if not sp.is_byte(i)}
        self.same = np.array([of_bytes.get(x, -1) for x in self.bytes_a], "i8")
        a, b = ([b"%d" % i for i in range(len(t))] for t in (self.bytes_a, self.bytes_b))
        self.words = [*(x + b"," for x in a), *(x + b"|" for x in a), *(x + b"," for x in b), *(x + b";" for x in b)]
        self.encode_a = lambda text: tk.encode_batch_fast([text], add_special_tokens=False)[0].ids
        mark = sp.piece_to_id(MARK)
        self.encode_b = lambda text: sp.encode(text) if text else [mark]  # the space in front is the library's own

    def align(self, parts: list[str]) -> list:
        """What each part (without its first space) gives, None for one that is not given back byte by byte."""
        import numpy as np

        text = "".join([f" {p}" for p in parts])
        whole = text.encode()
        a, b = np.array(self.encode_a(text), "i8"), np.array(self.encode_b(text[1:]), "i8")
        end_a, end_b = self.length_a[a].cumsum(), self.length_b[b].cumsum()
        cuts = np.cumsum([len(p.encode()) + 1 for p in parts]) if not text.isascii() else np.cumsum([len(p) + 1 for p in parts])
        right = b"".join([self.bytes_a[i] for i in a.tolist()]) == whole == b"".join([self.bytes_b[i] for i in b.tolist()])
        if not right or not (np.isin(cuts, end_a).all() and np.isin(cuts, end_b).all()):
            return [None] if len(parts) == 1 else [self.align([p])[0] for p in parts]
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        n_a, n_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        first_a, first_b, n = n_a.cumsum() - n_a, n_b.cumsum() - n_b, n_a * n_b

        # the groups in words: A's ids, a bar, B's ids, a semicolon
        code_a, code_b = a.copy(), b + 2 * len(self.bytes_a)
        code_a[first_a + n_a - 1] += len(self.bytes_a)
        code_b[first_b + n_b - 1] += len(self.bytes_b)
        code = np.empty(len(a) + len(b), "i8")
        code[np.arange(len(a)) + first_b[group_a]] = code_a
        code[np.arange(len(b)) + (first_a + n_a)[group_b]] = code_b
        words = [self.words[i] for i in code.tolist()]

        # links of groups of one token each that the identity map knows, and of the others
        plain = n == 1
        plain[plain] = self.same[a[first_a[plain]]] == b[first_b[plain]]
        at_plain = np.flatnonzero(plain)
        ids = a[first_a[at_plain]].astype("i4")
        listed = np.flatnonzero(~plain & (n <= LISTED))
        of = np.repeat(listed, n[listed])
        k = np.arange(len(of)) - np.repeat(n[listed].cumsum() - n[listed], n[listed])
        pairs = a[first_a[of] + k // n_b[of]] << 32 | b[first_b[of] + k % n_b[of]]
        large: dict[int, list] = {}
        ends = np.searchsorted(common, cuts) + 1  # groups of the parts so far
        for g in np.flatnonzero(~plain & (n > LISTED)).tolist():
            (x, c), (y, d) = (np.unique(t[s : s + m], return_counts=True) for t, s, m in ((a, first_a[g], n_a[g]), (b, first_b[g], n_b[g])))
            large.setdefault(int(np.searchsorted(ends, g, "right")), []).append(((x[:, None] << 32 | y).ravel(), (c[:, None] * d).ravel()))

        at = np.concatenate([[0], ends])
        token_a, token_b, links = (np.concatenate([[0], x.cumsum()])[at] for x in (n_a, n_b, n))
        at_ids, at_pairs = np.searchsorted(at_plain, at) * 4, np.searchsorted(of, at) * 8
        counted = zip(np.diff(token_a).tolist(), np.diff(token_b).tolist(), np.diff(at).tolist(), np.diff(links).tolist(), strict=True)
        at_words, at_ids, at_pairs = (token_a + token_b).tolist(), at_ids.tolist(), at_pairs.tolist()
        ids, pairs = ids.tobytes(), pairs.tobytes()
        return [
            (*c, b"".join(words[at_words[i] : at_words[i + 1]]), ids[at_ids[i] : at_ids[i + 1]], pairs[at_pairs[i] : at_pairs[i + 1]], large.get(i))
            for i, c in enumerate(counted)
        ]

    def make(self, parts: list[str]) -> list:
        """Many parts in one call; those that end in white space go alone, as the next part's space would belong to it."""
        out: list = [None] * len(parts)
        joined = [i for i, p in enumerate(parts) if p and not p[-1].isspace()]
        for k in range(0, len(joined), 200):
            few = joined[k : k + 200]
            for i, x in zip(few, self.align([parts[i] for i in few]), strict=True):
                out[i] = x
        for i, p in enumerate(parts):
            if not p or p[-1].isspace():
                out[i] = self.align([p])[0]
        return out


def parts_of(text: str) -> list[str]:
    """Space and text, cut before each space that follows something else than white space; the parts without their first space."""
    if "  " not in text and text[0] != " " and not re.search(r"[^\S ] ", text):
        return text.split(" ")
    return [p[1:] for p in re.split(r"(?<=\S)(?= )", f" {text}")]


class PartTable(ChunkTable):
    """Part -> what Pair.align gives for it."""

    def __init__(self, pair: Pair, most: int):
        super().__init__(pair.make, most)
        self.same = pair.same

    def ready(self, parts: list) -> None:
        new = {p for p in parts if p not in self}
        if len(self) + len(new) > self.most:
            self.clear()
            new = set(parts)
        super().update(zip(new, self.make(list(new)), strict=True))


def _links(rows: list, same):
    """Distinct links of a document's parts: A's ids of identity links with their numbers, other pairs with theirs."""
    import numpy as np

    ids, n_ids = np.unique(np.frombuffer(b"".join([r[5] for r in rows]), "i4"), return_counts=True)
    pairs, n_pairs = np.unique(np.frombuffer(b"".join([r[6] for r in rows]), "i8"), return_counts=True)
    if large := [x for r in rows if r[7] for x in r[7]]:
        pairs, n_pairs = _summed([pairs, *(p for p, _ in large)], [n_pairs, *(n for _, n in large)])
    also = same[pairs >> 32] == pairs & 0xFFFFFFFF  # the same bytes, but in a group of more tokens
    if also.any():
        ids, n_ids = _summed([ids.astype("i8"), pairs[also] >> 32], [n_ids, n_pairs[also]])
        pairs, n_pairs = pairs[~also], n_pairs[~also]
    return ids.astype("i4"), n_ids.astype("i4"), pairs, n_pairs.astype("i8")


def _summed(keys: list, counts: list):
    import numpy as np

    found, where = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.zeros(len(found), "i8")
    np.add.at(n, where, np.concatenate(counts))
    return found, n


def cut_and_ready(texts: list[bytes], table: PartTable):
    """The parts of each text, which the table then has; none of a text that holds what B takes for a space."""
    for a, b in slices(texts):
        cut = [parts_of(t.decode()) if t and MARK.encode() not in t else [] for t in texts[a:b]]
        table.ready([p for parts in cut for p in parts])
        yield from cut


def _aligner(raw: bytes, model: bytes, column: int, names: list[str]):
    def encode(batches):
        import numpy as np
        import pyarrow as pa

        table = worker_table((hashlib.sha256(raw + model).hexdigest(), "align"), lambda: PartTable(Pair(raw, model), 500_000))
        for batch in batches:
            texts, numbers, digests, lists = to_bytes(batch.column(column)), [], [], []
            for parts in cut_and_ready(texts, table):
                rows = [table[p] for p in parts]
                if not rows or None in rows:
                    numbers.append((0, 0, 0, 0))
                    digests.append("")
                    rows = []
                else:
                    numbers.append([sum(x) for x in list(zip(*rows, strict=True))[:4]])
                    digests.append(hashlib.sha256(b"".join([r[4] for r in rows])[:-1]).hexdigest())
                lists.append(_links(rows, table.same))
            out = [batch.column(i) for i in range(batch.num_columns) if i != column]
            out += [pa.array(x, pa.int64()) for x in zip(*numbers, strict=True)] if numbers else [pa.array([], pa.int64())] * 4
            out.append(pa.array(digests, pa.string()))
            for k in range(4):
                values = [x[k] for x in lists]
                offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype("i4")
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, "i8"))))
            yield pa.RecordBatch.from_arrays(out, names=names)

    return encode


def _vectors(vocabulary: int):
    """How many documents hold each identity link: a vector of A's vocabulary for each task, of which what is not zero is given out."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        vector = np.zeros(vocabulary, "i8")
        for batch in batches:
            vector += np.bincount(batch.column("ids").flatten().to_numpy(), minlength=vocabulary)
        a = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype("i4")), pa.array(vector[a])], names=["a", "n"])

    return count


def _pair_counts(batches):
    """How many documents hold each other pair, combined in the task and given out whenever many are held."""
    import numpy as np
    import pyarrow as pa

    held, size = [], 0

    def out():
        pair, n = _summed(*zip(*held, strict=True))
        for k in range(0, len(pair), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(pair[k : k + 100_000]), pa.array(n[k : k + 100_000])], names=["pair", "n"])

    for batch in batches:
        pair, n = np.unique(batch.column("pairs").flatten().to_numpy(), return_counts=True)
        held.append((pair, n))
        size += len(pair)
        if size > 2_000_000:
            held = [_summed(*zip(*held, strict=True))]
            size = len(held[0][0])
            if size > 1_000_000:
                yield from out()
                held, size = [], 0
    if held:
        yield from out()


def align(docs: DataFrame, tokenizer: str, model_path: str, text: str = "text", few: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """docs without text, with the columns of MADE; and the table of links: a, b, n (documents that hold the link), best.

    tokenizer: path of a byte-level `tokenizers` file (A); model_path: of a SentencePiece model (B). Pair counts are broadcast while they
    are at most `few`, else joined to the documents' pairs by a shuffle; the counts of identity links are at most A's
    vocabulary and always broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    (raw, _), (model, _) = load_file(tokenizer), load_file(model_path)
    if not splits_before_spaces(raw) or not markers_lead(model):
        raise ValueError("these tokenizers may join across spaces; parts of texts cannot be aligned alone")
    rest = [c for c in docs.columns if c not in MADE and c != text]
    source = docs.select(*rest, F.col(text).alias("__text"))
    schema = T.StructType(source.schema.fields[:-1])
    for c in ("n_a", "n_b", "n_groups", "n_links"):
        schema = schema.add(c, T.LongType())
    schema = schema.add("groups_sha256", T.StringType())
    for c, kind in (("ids", T.IntegerType()), ("n_ids", T.IntegerType()), ("pairs", T.LongType()), ("n_pairs", T.LongType())):
        schema = schema.add(f"__{c}", T.ArrayType(kind))
    held = source.mapInArrow(_aligner(raw, model, len(rest), schema.names), schema).withColumn("__row", F.monotonically_increasing_id())
    held = materialize(held, "alignments")

    pair = Pair(raw, model)
    same = spark.createDataFrame([(a, int(b)) for a, b in enumerate(pair.same) if b >= 0], "a int, b int")
    vector = held.select(F.col("__ids").alias("ids")).mapInArrow(_vectors(len(pair.bytes_a)), "a int, n long").groupBy("a").agg(F.sum("n").alias("n"))
    vector = materialize(vector.join(F.broadcast(same), "a"), "identity-links")
    counts = held.select(F.col("__pairs").alias("pairs")).mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "n")
    counts = materialize(counts, "pair-links")
    best = vector.select("a", "n").unionByName(counts.select("a", "n")).groupBy("a").agg(F.max("n").alias("m"))  # at most A's vocabulary
    best = F.broadcast(materialize(best, "best-links"))
    judged = [x.join(best, "a").select(*x.columns, (F.col("n") == F.col("m")).cast("long").alias("best")) for x in (vector, counts)]
    vector, counts = judged
    by_pair = F.broadcast(counts) if counts.count() <= few else counts.hint("merge")

    def summed(keys: str, numbers: str, key: str, table: DataFrame) -> DataFrame:
        links = held.select("__row", F.explode(F.arrays_zip(F.col(keys).alias("k"), F.col(numbers).alias("t"))).alias("x")).select("__row", F.col("x.k").alias(key), F.col("x.t").alias("t"))
        links = links.join(table.select(key, "n", "best"), key)
        return links.groupBy("__row").agg(F.sum(F.col("t") * F.col("best")).alias("n_best"), F.sum(F.col("t") * F.col("n")).alias("count_sum"))

    totals = summed("__ids", "__n_ids", "a", F.broadcast(vector)).unionByName(summed("__pairs", "__n_pairs", "pair", by_pair))
    totals = totals.groupBy("__row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    out = held.drop("__ids", "__n_ids", "__pairs", "__n_pairs").join(totals, "__row", "left")
    out = out.select(*rest, "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
    return out, vector.select("a", "b", "n", "best").unionByName(counts.select("a", "b", "n", "best"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every document's groups and links between the ids of two tokenizers."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
