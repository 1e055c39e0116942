"""Toxicity and the pipeline's stages against plain versions that read the rules anew, on rows with every awkward case."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("stratalens.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402

from stratalens.llm import secrets, toxicity  # noqa: E402

from .test_text_operators import TEXTS, jaccard_brute, words  # noqa: E402

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEXICON = {c: set(w.split()) for c, w in toxicity.SEEDS.items()}
CLING = "\"'`*#$%&|<>()[]{}.,;:!?…«»“”„-_/\\=+~^@0123456789"


def class_of(word, stems):
    """insult, threat, target, negation, report or none, its weight, and whether a clause ends with the word."""
    low = word.lower()
    core = low.strip(CLING)
    ends = bool(re.search(r"([.;:!?|]|[.!?]\"|[.!?]\))\Z", low))
    for c in ("insult", "threat", "target", "negation", "report"):
        if core in LEXICON[c]:
            return c, stems.get(core, 4.0), ends
    if core.isalpha():
        held = [s for s in stems if core.startswith(s)]
        if held:
            return "insult", stems[max(held, key=len)], ends
    return "none", 0.0, ends


def plain_features(text, stems):
    """The eight numbers of a text, clause by clause, by looking back from each word."""
    found = words(text)
    clauses, now = [], []
    for w in found:
        c, weight, ends = class_of(w, stems)
        now.append((c, weight))
        if ends:
            clauses.append(now)
            now = []
    clauses.append(now)
    sums = [0.0] * 8
    for clause in clauses:
        kinds = [c for c, _ in clause]
        total, aim_from = 0.0, 0
        for i, (c, weight) in enumerate(clause):
            negated, aimed, reported = "negation" in kinds[max(0, i - 3) : i], "target" in kinds[max(0, i - 4) : i], "report" in kinds[:i]
            if c == "target":
                near = [j for j in range(max(0, i - 4, aim_from), i) if kinds[j] in ("insult", "threat")]
                if not near:
                    continue
                aim_from, weight, aimed = i, 2.0, True
            elif c not in ("insult", "threat"):
                continue
            total += weight * (0.3 if negated else 1) * (0.5 if reported else 1)
            sums[0] += weight * (c == "insult")
            sums[1] += weight * aimed
            sums[2] += weight * negated
            sums[3] += weight * reported
            sums[4] += weight * (c == "threat")
            sums[7] += c != "target"
        sums[5] += total > 0
        sums[6] = max(sums[6], total)
    sums[7] = 100 * sums[7] / max(1, len(found))
    return [math.log1p(max(0.0, x)) for x in sums]


def plain_stems(rows, least=0.01, odds=4.5):
    """rows (text, toxic) -> word beginnings that are far more frequent in toxic texts, none beginning with another."""

    def held(text):
        return {w[:k] for w in re.findall(r"[^\W\d_]{4,}", text.lower()) for k in [*range(4, min(len(w), 40) + 1), len(w)]}

    n = Counter(t for _, t in rows)
    a, b = Counter(), Counter()
    for text, toxic in rows:
        (a if toxic else b).update(held(text))
    weight = {s: math.log((x + 0.5) / (n[1] + 1)) - math.log((b[s] + 0.5) / (n[0] + 1)) for s, x in a.items() if x >= max(4, math.ceil(least * n[1]))}
    good = {s: w for s, w in weight.items() if w >= odds}
    return {s: w for s, w in good.items() if not any(s != t and s.startswith(t) for t in good)}


def predicted(docs, labels):
    """doc -> probability, from a model fitted on labelled rows that are not held out; docs: (doc_id, text)."""
    import numpy as np

    marks = [(d, t) for d, t in labels if d is not None and t in (0, 1) and zlib.crc32(str(d).encode()) % 5]
    texts = {}
    for d, t in docs:
        texts.setdefault(d, []).append(t or "")
    rows = [(x, t) for d, t in marks for x in texts.get(d, [])]
    stems = plain_stems(rows)
    x = np.array([[1.0, *plain_features(t, stems)] for t, _ in rows])
    y, prior = np.array([t for _, t in rows], float), np.array(toxicity.PRIOR)
    w = prior.copy()
    for _ in range(200):  # plain Newton steps to the minimum of the ridge-penalised loss
        p = 1 / (1 + np.exp(-(x @ w)))
        w = w - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(9), x.T @ (p - y) + w - prior)
    return stems, [1 / (1 + math.exp(-sum(a * b for a, b in zip(w, [1.0, *plain_features(t or "", stems)], strict=True)))) for _, t in docs]


@pytest.fixture(scope="module")
def corpus(spark, sf):
    """The rows of the small table with awkward ones among them, and its labels."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*COLUMNS).collect()]
    rows += [(5000 + i, t, ["en", None][i % 2], ["a", None, ""][i % 3], None) for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[0], (None, "a null id", "en", "a", 9), (None, None, None, None, None), (6000, rows[3][1], "en", "b", 1), (6001, rows[3][1], "en", None, 1)]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()] + [(None, 1, 1)]
    return rows, labels


def test_toxicity_equals_plain_scoring(spark, corpus):
    rows, labels = corpus
    marks = [(d, t) for d, _, t in labels]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    stems, scores = predicted([r[:2] for r in rows], marks)
    assert set(model[0]) == set(stems) and all(math.isclose(model[0][s], w, abs_tol=1e-6) for s, w in stems.items())
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", round(r.score, 4)) for r in toxicity.score(docs, model).collect())
    want = sorted((d is None, d or 0, t or "", s) for (d, t, *_), s in zip(rows, scores, strict=True))
    assert len(got) == len(want)
    for (*a, x), (*b, y) in zip(got, want, strict=True):
        assert a == b and abs(x - y) < 2e-3, (a, x, y)


def redacted(text):
    """The text with its secrets named: spans of all rules in order, those that overlap as one."""
    spans = []
    for nth, r in enumerate(secrets.RULES):
        for m in re.finditer(r.pattern.replace("\\x20", " "), text):
            if len(m[r.group]) >= r.least:
                spans.append((m.start(), nth, r.kind, m.end()))
    out, at = "", 0
    for start, _, kind, end in sorted(spans):
        if start >= at:
            out += text[at:start] + f"[{kind}]"
        at = max(at, end)
    return out + text[at:]


def mixed(rows):
    """Each row as often as the mix takes it: the queue read plainly."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    weight, queue = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}, []
    size = [len(words(r[1] or "")) for r in rows]
    for s in sources:
        mine = sorted((md5("mix:" + (md5(rows[i][1] or "") if rows[i][0] is None else str(rows[i][0]))), size[i], md5(rows[i][1] or ""), i) for i in range(len(rows)) if rows[i][3] == s)
        total = sum(x[1] for x in mine)
        for copy in (0, 1):
            at = copy * total
            for *_, i in mine:
                at += size[i]
                queue.append((at / weight[s], s is None, s or "", copy, at, i))
    left, taken, words_of = math.floor(1.5 * sum(size)), Counter(), Counter()
    for *_, i in sorted(queue):
        n = min(size[i], left)
        left -= n
        taken[rows[i][0], rows[i][3], rows[i][1] or ""] += n
    for r, n in zip(rows, size, strict=True):
        words_of[r[0], r[3], r[1] or ""] += n
    key = lambda r: (r[0], r[3], r[1] or "")
    return [r for r, n in zip(rows, size, strict=True) if n for _ in range(math.floor(taken[key(r)] / words_of[key(r)] + 0.5))]


def test_pipeline_stages_equal_plain_versions(spark, corpus, tmp_path):
    rows, labels = corpus
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    _, scores = predicted([r[:2] for r in rows], [(d, t) for d, _, t in labels])
    want = [r for r, s in zip(rows, scores, strict=True) if s < 0.5]

    def check(out, rows_wanted):
        got = sorted(map(repr, (tuple(r[c] for c in COLUMNS) for r in out.collect())))
        assert got == sorted(map(repr, rows_wanted))
        return spark.createDataFrame(rows_wanted, docs.schema)

    stages = dict(corpus_pipeline.STAGES)
    docs = check(stages["toxicity"](spark, docs, folder), want)

    copies = {d for d, _, c in jaccard_brute([r[:2] if r[1] is not None else (r[0], "") for r in want], 5, 80) if d is not None and d != c}
    want = [r for r in want if r[0] not in copies]
    docs = check(stages["n-gram Jaccard join"](spark, docs, folder), want)

    want = [(d, t if t is None else redacted(t), lang, s, None if t is None else len(redacted(t))) for d, t, lang, s, _ in want]
    docs = check(stages["secret scans"](spark, docs, folder), want)

    want = mixed(want)
    docs = check(stages["mixing sources to target weights"](spark, docs, folder), want)

    model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = stages["SentencePiece encoding and decoding"](spark, docs, folder).collect()
    lines = []
    for d, t, _, s, _ in want:
        ids = model.encode(t or "")
        lines.append((d, s, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))))
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, lines))


def test_pipeline_of_an_empty_table_and_of_extra_columns(spark, corpus, tmp_path):
    rows, labels = corpus
    folder = str(tmp_path)
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], kinds).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    few = [(*r, "x", 1, 2.0) for r in rows[:12]]
    wide = spark.createDataFrame(few, kinds + ", component_id string, taken int, score double")
    for _, stage in corpus_pipeline.STAGES[:4]:
        wide = stage(spark, wide, folder)
        assert wide.columns == list(COLUMNS)
