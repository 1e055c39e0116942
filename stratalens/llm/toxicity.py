"""Operator 4, toxicity by a weighted finite-state pattern grammar.

Words are mapped to classes by lexical transducers: insult, threat, target, negation, reported speech. Small transducers
for the scope of a negation, of reported speech and for nearness of a target are composed into one automaton, which reads
each clause and emits weighted events: an insult or a threat, aimed or not, negated or not, reported or not. A document's
score comes from its matched clauses, never from words alone: a logistic function of what the automaton emitted.

The insult lexicon has fixed seeds and stems learned from labelled rows: word beginnings, up to the whole word, far more
frequent in toxic than in clean documents; a word is looked up by its longest beginning. Stems and the logistic weights are
fitted on a sample of at most about `sample` labelled rows (a bound on fitting only, by hash of the id); every document is
scored whole. Rows with crc32(id) mod 5 = 0 are never learned from, and
only the text is an input of a score.

Defined results: null and empty texts are scored as texts without a matched clause; a null id is not held out and matches
no label; repeated rows get equal scores; several labels of an id each count; without any label of either kind the fixed
weights score alone; other columns pass through (columns named like the results are replaced); empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ChunkTable, materialize, ship, slices, small_batches, texts_of, to_bytes

ship(__name__)

# The seed lexicon of each class.
SEEDS = {
    "insult": "idiot moron stupid scum trash loser pathetic worthless disgusting clown dumb imbecile jerk fool trottel dummkopf abschaum idiota imbécile connard ordure estúpido basura imbécil",
    "threat": "kill hurt destroy attack beat shoot stab murder töten umbringen verprügeln tuer frapper matar golpear",
    "target": "you your yours yourself he she they them him his her du dich dir dein ihr euch tu toi vous tú usted ustedes",
    "negation": "not never without nicht kein keine nie pas jamais nunca jamás ni",
    "report": "said says wrote writes called calls reported quoted claims claimed according sagte schrieb dit écrit dijo escribió",
}
CLASSES = ("none", "insult", "threat", "target", "negation", "report")
#: A word's code is its class, plus this if a clause ends with it.
END = 8
#: Words that a negation reaches, and the distance at which a target still is the aim.
REACH, NEAR = 3, 4


def scope(kind: str) -> dict:
    """One small transducer: (state, class) -> (state, output). States count down the words that the scope still reaches."""
    arcs = {}
    for state in range(NEAR + 1):
        for c in CLASSES:
            if kind == "report":
                arcs[state, c] = (1 if c == "report" or state else 0, bool(state))
            else:
                reach = REACH if kind == "negation" else NEAR
                arcs[state, c] = (reach if c == kind else max(0, state - 1), state > 0)
    return arcs


def composed() -> dict:
    """The product of the scopes with the pattern transducer: (state, class) -> (state, event or None). State 0 begins a clause.

    An event is (kind, aimed, negated, reported); a target soon after an insult or threat emits ("aim", ...) for it.
    """
    scopes = [scope("negation"), scope("report"), scope("target")]
    start = (0, 0, 0, 0)
    number, arcs, todo = {start: 0}, {}, [start]
    while todo:
        state = todo.pop()
        for c in CLASSES:
            (neg, negated), (rep, reported), (aim, aimed) = (s[state[i], c] for i, s in enumerate(scopes))
            event = (c, aimed, negated, reported) if c in ("insult", "threat") else ("aim", True, negated, reported) if c == "target" and state[3] else None
            to = (neg, rep, aim, NEAR if c in ("insult", "threat") else 0 if event else max(0, state[3] - 1))
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            arcs[number[state], CLASSES.index(c)] = (number[to], event)
    return arcs


#: What a clause's events add: plain, aimed, negated and reported weight, threats, matched clauses, the heaviest clause, share of words.
N_FEATURES = 8
#: The weights before any fit, the first for the constant.
PRIOR = (-3.5, 2.0, 0.6, -0.6, -0.4, 1.0, 1.0, 0.5, 0.3)


def classify(word: bytes, stems: dict[str, float], lengths: list[int]) -> tuple[int, float]:
    """(code, weight) of a word with what clings to it. lengths: those of the stems, longest first."""
    text = word.decode("utf-8", "replace").lower()
    core = text.strip("\"'`*#$%&|<>()[]{}.,;:!?…«»“”„-_/\\=+~^@0123456789")
    end = END if text[-1:] in ".;:!?|" or text.endswith((".\"", "!\"", "?\"", ".)", "!)", "?)")) else 0
    for i, c in enumerate(CLASSES[1:], 1):
        if core in _WORDS[c]:
            return i + end, stems.get(core, 4.0)
    if core.isalpha():
        for n in lengths:
            if n <= len(core) and (w := stems.get(core[:n])) is not None:
                return 1 + end, w
    return end, 0.0


_WORDS = {c: frozenset(w.split()) for c, w in SEEDS.items()}


def reader(stems: dict[str, float]):
    """A function from a list of texts to their features."""
    import math

    arcs = composed()
    lengths = sorted({len(s) for s in stems}, reverse=True)
    table = ChunkTable(lambda words: [classify(w, stems, lengths) for w in words], 400_000)
    # No word but an insult or threat gives an event by itself, so clauses without one are passed over.
    hits = {1, 2, 1 + END, 2 + END}

    def clause_weight(codes, weights, sums) -> float:
        state, total, matched = 0, 0.0, 0.0
        for c, w in zip(codes, weights, strict=True):
            state, event = arcs[state, c % END]
            if event is None:
                continue
            kind, aimed, negated, reported = event
            w = 2.0 if kind == "aim" else w
            total += w * (0.3 if negated else 1.0) * (0.5 if reported else 1.0)
            sums[0] += w if kind == "insult" else 0
            sums[1] += w if aimed else 0
            sums[2] += w if negated else 0
            sums[3] += w if reported else 0
            sums[4] += w if kind == "threat" else 0
            matched += kind != "aim"
        sums[7] += matched
        return total

    def one(words: list[bytes]) -> tuple:
        sums = [0.0] * N_FEATURES
        rows = [table[w] for w in words]
        codes = bytes([r[0] for r in rows])
        if hits.isdisjoint(codes):
            return tuple(sums)
        a = 0
        for b in [i + 1 for i, c in enumerate(codes) if c >= END] + [len(codes)]:
            clause = codes[a:b]
            if not hits.isdisjoint(clause):
                w = clause_weight(clause, [r[1] for r in rows[a:b]], sums)
                sums[5] += w > 0
                sums[6] = max(sums[6], w)
            a = b
        sums[7] = 100 * sums[7] / len(words)
        return tuple(math.log1p(max(0.0, x)) for x in sums)

    def read(texts: list[bytes]) -> list[tuple]:
        out = []
        for a, b in slices(texts):
            words = [t.split() for t in texts[a:b]]
            table.ready([w for ws in words for w in ws])
            out += [one(ws) for ws in words]
        return out

    return read


#: Words of more letters have their beginnings up to here, and themselves: runs of thousands of letters would have as many.
LETTERS = 40


def beginnings(word: str) -> set[str]:
    """The beginnings of a word from 4 letters on, itself the last."""
    return {word[:k] for k in range(4, min(len(word), LETTERS) + 1)} | {word}


def _stem_counts(only: frozenset | None):
    """Documents that hold each word beginning (of `only`, if given), counted by task."""

    def count(batches):
        import re
        from collections import Counter

        import pyarrow as pa

        letters = re.compile(r"[^\W\d_]{4,}").findall
        for batch in batches:
            n: Counter = Counter()
            for text in to_bytes(batch.column("text")):
                found = set().union(*map(beginnings, set(letters(text.decode("utf-8", "replace").lower()))))
                n.update(found if only is None else found & only)
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["stem", "n"])

    return count


def learn_stems(sample: DataFrame, least: float = 0.01, odds: float = 4.5) -> dict[str, float]:
    """Stem -> log odds. Their number is bounded by what holds `least` of the sample's toxic documents."""
    import math

    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return {}
    most = max(4, math.ceil(least * n[1]))
    toxic = sample.where("toxic = 1").select("text").mapInArrow(_stem_counts(None), "stem string, n long").groupBy("stem").agg(F.sum("n").alias("a")).where(F.col("a") >= most)
    held = {r["stem"]: r["a"] for r in toxic.collect()}
    clean = sample.where("toxic = 0").select("text").mapInArrow(_stem_counts(frozenset(held)), "stem string, n long").groupBy("stem").agg(F.sum("n").alias("b"))
    other = {r["stem"]: r["b"] for r in clean.collect()}
    found: dict[str, float] = {}
    for s in sorted(held, key=lambda s: (len(s), s)):
        w = math.log((held[s] + 0.5) / (n[1] + 1)) - math.log((other.get(s, 0) + 0.5) / (n[0] + 1))
        if w >= odds and found.keys().isdisjoint(beginnings(s)):
            found[s] = round(w, 6)
    return found


def fit(rows: list[tuple], toxic: list[int], ridge: float = 1.0, rounds: int = 25) -> list[float]:
    """Logistic weights by Newton's method, drawn towards PRIOR."""
    import numpy as np

    prior = np.array(PRIOR)
    if not toxic or len(set(toxic)) < 2:
        return list(PRIOR)
    x = np.column_stack([np.ones(len(rows)), np.array(rows, float)])
    y, w = np.array(toxic, float), prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - prior)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in np.round(w, 6)]


def _features(stems: dict[str, float]):
    def features(batches):
        import pyarrow as pa

        read = reader(stems)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([list(r) for r in read(to_bytes(batch.column("text")))], pa.list_(pa.float64())), batch.column("toxic").cast(pa.int32())], names=["f", "toxic"])

    return features


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 8000, text: str = "text") -> tuple[dict[str, float], list[float]]:
    """The stems and the logistic weights, from labelled rows that are not held out."""
    small_batches(docs.sparkSession)
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    total = rows.count()
    if total > sample:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(total)) < sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), texts_of(docs, text).alias("text"))
    rows = materialize(texts.join(materialize(rows, "toxic-rows"), "doc_id").select("text", "toxic"), "toxic-sample")
    stems = learn_stems(rows)
    got = rows.mapInArrow(_features(stems), "f array<double>, toxic int").collect()  # eight numbers for each row of the bounded sample
    got.sort(key=lambda r: (r["toxic"], r["f"]))
    return stems, fit([tuple(r["f"]) for r in got], [r["toxic"] for r in got])


def _scorer(stems: dict[str, float], weights: list[float], column: int, names: list[str]):
    def score(batches):
        import math

        import pyarrow as pa

        read = reader(stems)
        for batch in batches:
            z = [weights[0] + sum(w * x for w, x in zip(weights[1:], f, strict=True)) for f in read(to_bytes(batch.column(column)))]
            scores = [1 / (1 + math.exp(-min(max(v, -30.0), 30.0))) for v in z]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=names)

    return score


def score(docs: DataFrame, model: tuple[dict[str, float], list[float]], text: str = "text") -> DataFrame:
    """docs with score and predicted. Nothing is shuffled."""
    small_batches(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    schema = T.StructType(list(docs.schema.fields)).add("score", T.DoubleType()).add("predicted", T.IntegerType())
    return docs.mapInArrow(_scorer(*model, docs.columns.index(text), schema.names), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document's toxicity."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score(docs, learn(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
