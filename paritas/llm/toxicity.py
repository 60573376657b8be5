"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens get log-odds under a Dirichlet prior from labelled documents, a linear scan finds all maximal
segments of a text, and extreme-value statistics turn their scores into a document score.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches, settled
from .tokens import CACHE_WORDS, WORD, resident, slices

#: Weight of the prior: pseudo-counts as a share of a token's own count in all training texts.
PRIOR = 0.01
#: A token's score is its log-odds, moved towards zero by so many standard deviations.
CAUTION = 1.0
#: What a token without evidence costs a segment.
DRIFT = 0.08
#: Most labelled ids to learn from, those of the least hashes. Bounds what is sent to the executors to find their
#: texts; all texts are scored, in full.
TRAINING_TEXTS = 40_000
#: A word is charged anew once it comes so many words behind its last charge.
REPEAT_WORDS = 200
#: Lengths of the word beginnings that count as tokens beside the word itself.
BEGINNINGS = (8, 7, 6, 5, 4, 3)
#: Expected number of chance segments in a text below which a passage is significant.
SIGNIFICANT = 0.05
#: Grid of the summed evidence for the calibration, and where it ends.
EVIDENCE_STEP, EVIDENCE_LEAST, EVIDENCE_MOST = 0.25, -10.0, 100.0

_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…¡¿"


def core_tokens(core: str) -> list[str]:
    """The tokens of one lower-cased word without its marks, most specific first."""
    return [core] + [f"{core[:n]}*" for n in BEGINNINGS if len(core) >= n]


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, text_hash, text, toxic of the texts to learn from: labelled, not held out, equal texts once.

    At most ``most`` (``TRAINING_TEXTS``) labelled ids are used, so their list may be broadcast and no text moves
    before it is known to be one of them. An id on rows with different texts labels each of these; a label
    above zero is toxic.
    """
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_TEXTS if most is None else most))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return (texts.join(F.broadcast(known), "doc_id").groupBy("text_hash")
            .agg(F.min(F.struct("doc_id", "toxic", "text")).alias("_first"))
            .select("_first.doc_id", "text_hash", "_first.text", "_first.toxic"))


_COUNTS = {"token": pa.string(), "toxic_count": pa.int64(), "clean_count": pa.int64()}


def token_counts(training: DataFrame) -> DataFrame:
    """Per token how often it comes in toxic and in clean training texts. A text counts each of its
    different words once, so that no single text can make a word toxic; the token "" counts words."""

    def run(rows: pa.RecordBatch):
        found = (Counter(), Counter())
        labels = rows.column("toxic").to_pylist()
        at = 0
        for texts in slices(rows.column("text").to_pylist()):
            for text in texts:
                cores = {w.strip(_EDGES) for w in set(WORD.findall(text.lower()))} - {""}
                counter = found[labels[at]]
                for core in cores:
                    counter.update(core_tokens(core))
                counter[""] += len(cores)
                at += 1
        clean, toxic = found
        tokens = list(toxic.keys() | clean.keys())
        yield batch(_COUNTS, token=tokens, toxic_count=[toxic[t] for t in tokens],
                    clean_count=[clean[t] for t in tokens])

    partial = map_batches(training.select("text", "toxic"), run,
                          "token string, toxic_count long, clean_count long")
    return partial.groupBy("token").agg(F.sum("toxic_count").alias("toxic_count"),
                                        F.sum("clean_count").alias("clean_count"))


def log_odds(counts: DataFrame, toxic_words: int, clean_words: int) -> DataFrame:
    """token, score, certainty: log-odds of toxic against clean texts under a Dirichlet prior in
    proportion to the token's frequency in both, moved towards zero by its standard deviation."""
    y1, y0 = F.col("toxic_count"), F.col("clean_count")
    share = toxic_words / max(toxic_words + clean_words, 1)
    prior1, prior0 = PRIOR * share * (y1 + y0), PRIOR * (1 - share) * (y1 + y0)
    n1, n0 = max(toxic_words, 1) * (1 + PRIOR), max(clean_words, 1) * (1 + PRIOR)
    delta = F.log((y1 + prior1) / n1) - F.log((y0 + prior0) / n0)
    deviation = F.sqrt(1 / (y1 + prior1) + 1 / (y0 + prior0))
    kept = F.greatest(F.abs(delta) - CAUTION * deviation, F.lit(0.0)) * F.signum(delta)
    return (counts.where((y1 + y0 >= 2) & (F.col("token") != ""))
            .select("token", kept.alias("score"), (F.abs(delta) / deviation).alias("certainty"))
            .where(F.col("score") != 0))


class Scorer:
    def __init__(self, scores: dict[str, tuple[float, float]]):
        self._model = scores
        self._words: dict[str, float] = {}

    def scores(self, texts: list[str]) -> list[np.ndarray]:
        """Score of each word of each text: that of its most certain token, less the drift. A word speaks
        for toxicity once within ``REPEAT_WORDS`` words, so that mere repetition is no evidence and a
        later passage of the same words is found all the same."""
        words = [WORD.findall(t.lower()) for t in texts]
        seen = set().union(*words)
        if len(self._words) + len(seen) > CACHE_WORDS:
            self._words.clear()
        model = self._model
        for word in seen.difference(self._words):
            found = [model[t] for t in core_tokens(word.strip(_EDGES)) if t in model]
            self._words[word] = max(found, key=lambda f: f[1])[0] - DRIFT if found else -DRIFT
        return [self._damped(w) for w in words]

    def _damped(self, words: list[str]) -> np.ndarray:
        scores = np.fromiter(map(self._words.__getitem__, words), dtype=np.float64, count=len(words))
        charged: dict[str, int] = {}
        for i in np.flatnonzero(scores > 0).tolist():
            if i - charged.get(words[i], -REPEAT_WORDS) < REPEAT_WORDS:
                scores[i] = -DRIFT
            else:
                charged[words[i]] = i
        return scores


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) in one pass (Ruzzo and Tompa 1999).

    Only words with a positive score are visited; what lies between them is in the running sums.
    """
    if not len(scores):
        return []
    after = np.cumsum(scores)
    held: list[list] = []  # begin, end, sum before, sum after
    for i in np.flatnonzero(scores > 0).tolist():
        new = [i, i + 1, float(after[i] - scores[i]), float(after[i])]
        while held:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j -= 1
            if j < 0 or held[j][3] >= new[3]:
                break
            new = [held[j][0], new[1], held[j][2], new[3]]
            del held[j:]
        held.append(new)
    return [(b, e, r - l) for b, e, l, r in held]


def _scorer(model) -> Scorer:
    """The scorer of a broadcast (name, scores); a worker keeps it under a name made for that model alone, since
    workers are used again and the address of a broadcast may be, too."""
    name, scores = model.value
    return resident(("scorer", name), lambda: Scorer(scores))


def score_histogram(training: DataFrame, model) -> dict[float, int]:
    """How often each word score comes in the clean training texts, on a grid of hundredths."""
    kinds = {"grid": pa.int32(), "n": pa.int64()}

    def run(rows: pa.RecordBatch):
        found: Counter = Counter()
        for texts in slices(rows.column("text").to_pylist()):
            for scores in _scorer(model).scores(texts):
                found.update(dict(zip(*(x.tolist() for x in np.unique(
                    np.rint(scores * 100).astype(np.int32), return_counts=True)))))
        yield batch(kinds, grid=list(found), n=list(found.values()))

    cells = map_batches(training.where("toxic = 0").select("text"), run, "grid int, n long")
    return {r.grid / 100: r.n for r in cells.groupBy("grid").agg(F.sum("n").alias("n")).collect()}


def decay_rate(histogram: dict[float, int]) -> float:
    """The positive solution of sum(p * exp(rate * score)) = 1, which governs how fast the best
    segment of a clean text thins out (Karlin and Altschul 1990)."""
    scores = np.array([*histogram, 1.0, 3.0])  # a trace of positive scores that no text may show
    shares = np.array([*histogram.values(), 0.5, 0.5], dtype=np.float64)
    shares /= shares.sum()
    if (scores * shares).sum() >= 0:
        return 1.0
    low, high = 1e-6, 10.0
    for _ in range(100):
        middle = (low + high) / 2
        if (shares * np.exp(np.minimum(middle * scores, 700))).sum() > 1:
            high = middle
        else:
            low = middle
    return low


_SEGMENTS = {
    "doc_id": pa.int64(), "text_hash": pa.int64(), "n_words": pa.int64(), "evidence": pa.float64(),
    "passages": pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64()),
                                    ("expected", pa.float64())])),
}
_SEGMENT_SCHEMA = ("doc_id long, text_hash long, n_words long, evidence double, "
                   "passages array<struct<begin:long,end:long,score:double,expected:double>>")


def find_passages(docs: DataFrame, model, decay: float) -> DataFrame:
    """Per text its significant passages (word places, score, expected number of such segments in
    a clean text of its length) and the evidence: the sum of -ln(expected) over them, or without any
    that of the best segment."""

    def run(rows: pa.RecordBatch):
        at = 0
        for texts in slices(rows.column("text").to_pylist()):
            n_words, passages, evidence = [], [], []
            for scores in _scorer(model).scores(texts):
                found = [(b, e, s, min(len(scores) * math.exp(-decay * s), 1e9))
                         for b, e, s in maximal_segments(scores)]
                best = min((f[3] for f in found), default=math.inf)
                found = [f for f in found if f[3] < SIGNIFICANT]
                n_words.append(len(scores))
                passages.append([dict(zip(("begin", "end", "score", "expected"), f)) for f in found])
                evidence.append(sum(-math.log(max(f[3], 1e-300)) for f in found) if found
                                else -min(math.log(max(best, 1e-300)), -EVIDENCE_LEAST))
            part = rows.slice(at, len(texts))
            yield batch(_SEGMENTS, doc_id=part.column("doc_id"), text_hash=part.column("text_hash"),
                        n_words=n_words, evidence=evidence, passages=passages)
            at += len(texts)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                   F.xxhash64("text").alias("text_hash"),
                                   F.col("text").cast("string").alias("text")), run, _SEGMENT_SCHEMA)


def _bounded(evidence):
    return F.greatest(F.least(evidence, F.lit(EVIDENCE_MOST)), F.lit(EVIDENCE_LEAST))


def _grid(evidence):
    return F.round(_bounded(evidence) / EVIDENCE_STEP).cast("int")


def logistic_fit(cells: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope of label 1 against x from (x, n of label 0, n of label 1), by damped Newton
    steps with a weak penalty; one row of either label is added at the ends."""
    x = np.array([c[0] for c in cells] + [0.0, 20.0])
    n0 = np.array([c[1] for c in cells] + [1.0, 0.0])
    n1 = np.array([c[2] for c in cells] + [0.0, 1.0])
    def loss(t: np.ndarray) -> float:
        z = t[0] + t[1] * x
        return float((n1 * np.logaddexp(0, -z) + n0 * np.logaddexp(0, z)).sum() + 0.005 * (t ** 2).sum())

    t = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(t[0] + t[1] * x, -500, 500)))
        w = (n0 + n1) * p * (1 - p)
        miss = n1 - (n0 + n1) * p
        g = np.array([miss.sum(), (miss * x).sum()]) - 0.01 * t
        h = np.array([[w.sum() + 0.01, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.01]])
        step = np.linalg.solve(h, g)
        while loss(t + step) > loss(t) and np.abs(step).max() > 1e-9:
            step /= 2
        t = t + step
        if np.abs(step).max() < 1e-9:
            break
    return float(t[0]), max(float(t[1]), 1e-3)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every whole text of ``docs`` (doc_id, text; other columns are ignored).

    Learns from the rows of ``labels`` (doc_id, toxic) that are not held out, equal texts once, of at
    most ``TRAINING_TEXTS`` ids. Returns one row per input row: doc_id, held_out, score (0 to 1), predicted (score of
    at least 0.5), n_words, evidence, the significant passages and a hash of the text. Null and empty texts have no
    passages and get the score of least evidence; a null doc_id is not held out. Without any labels of
    one kind no token has a score. To the driver come the model (the tokens of the texts learned from whose
    log-odds exceed their deviation), score and evidence histograms on fixed grids.
    """
    spark = docs.sparkSession
    training = settled(training_rows(docs, labels), "toxicity-training")
    counts = settled(token_counts(training), "toxicity-tokens")
    words = counts.where("token = ''").first()
    scores = {}
    if words and words.toxic_count and words.clean_count:
        scores = {r.token: (r.score, r.certainty)
                  for r in log_odds(counts, words.toxic_count, words.clean_count).collect()}
    model = spark.sparkContext.broadcast((uuid.uuid4().hex, scores))
    decay = decay_rate(score_histogram(training, model))
    found = settled(find_passages(docs, model, decay), "toxicity-passages")
    learned = found.select("doc_id", "text_hash", "evidence").join(
        training.select("doc_id", "text_hash", "toxic"), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    cells = learned.groupBy(_grid(F.col("evidence")).alias("cell")).agg(
        F.count_if(F.col("toxic") == 0).alias("n0"), F.count_if(F.col("toxic") > 0).alias("n1")).collect()
    a, b = logistic_fit([(c.cell * EVIDENCE_STEP, c.n0, c.n1) for c in cells])
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * _bounded(F.col("evidence")))))
    return found.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"), "n_words", "evidence", "passages", "text_hash")
