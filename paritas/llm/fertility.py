"""Quality rules from tokeniser fertility.

A public vocabulary splits every word; characters per token, the share of byte-fallback tokens and
the entropy of the tokens are compared with bands of texts of the same language and like length, or of
the same script where a language has too few texts to tell.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches, settled
from .tokens import CACHE_WORDS, WORD, resident, slices

SYMBOLS = "#*$%&|<>"
#: Quantiles between which the middle of a band lies. Junk gathers at the low end of the measures,
#: so the lower one stands near the median.
QUANTILES = (0.4, 0.8)
#: A band reaches this many times the middle's width beyond it on either side.
REACH = 3.5
#: Least width of the middle: a share of the median (characters per token), bits, a share of tokens.
LEAST_WIDTH = {"chars_per_token": 0.04, "token_entropy": 0.1, "fallback_share": 0.003}
#: Texts of so many tokens (as powers of two) share the outermost length classes.
LENGTHS = (7, 11)
#: A class needs so many different texts for bands of its own: below, its quantiles say little, and a class
#: that is mostly junk would take the junk for its measure.
LEAST_TEXTS = 40
#: Where bands come from, nearest first: language and length, script and length, script, all texts.
LEVELS = (("lang", "length_class"), ("script", "length_class"), ("script",), ())

# First code point of each run of blocks, and the script that it belongs to.
SCRIPTS = (
    (0x0000, "none"), (0x0041, "latin"), (0x005B, "none"), (0x0061, "latin"), (0x007B, "none"), (0x00C0, "latin"),
    (0x0250, "none"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "none"), (0x3040, "kana"), (0x3100, "none"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "none"), (0xF900, "han"), (0xFB00, "none"), (0xFB50, "arabic"), (0xFE00, "none"),
    (0x10000, "other"), (0x1F000, "none"), (0x20000, "han"), (0x323B0, "none"),
)
_STARTS = np.array([start for start, _ in SCRIPTS], dtype="<u4")
_NAMES = list(dict.fromkeys(name for _, name in SCRIPTS))
_PLACES = np.array([_NAMES.index(name) for _, name in SCRIPTS])

_MEASURES = {
    "doc_id": pa.int64(), "lang": pa.string(), "script": pa.string(), "_text_hash": pa.int64(), "n_words": pa.int64(),
    "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(), "n_tokens": pa.int64(), "chars_per_token": pa.float64(),
    "fallback_share": pa.float64(), "token_entropy": pa.float64(),
}
_SCHEMA = ("doc_id long, lang string, script string, _text_hash long, n_words long, word_chars long, n_symbols long, "
           "n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, "
           "fallback_share double, token_entropy double")


class WordPieces:
    """Ids of single words for a vocabulary with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.GetPieceSize()
        self.is_fallback = np.array([self.model.IsByte(i) for i in range(size)])
        self._ids: dict[str, bytes] = {}

    def encode(self, words: list[list[str]]) -> list[np.ndarray]:
        seen = set().union(*words)
        if len(self._ids) + len(seen) > CACHE_WORDS:
            self._ids.clear()
        new = list(seen.difference(self._ids))
        if new:
            self._ids.update((w, np.array(ids, dtype="<u4").tobytes())
                             for w, ids in zip(new, self.model.encode(new, num_threads=1)))
        return [np.frombuffer(b"".join(map(self._ids.__getitem__, w)), dtype="<u4") for w in words]


def _pieces(path: str) -> WordPieces:
    return resident(("pieces", path), lambda: WordPieces(path))


def repeated_words(words: list[str]) -> int:
    """Words in three-word windows that occur more than once."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    inside = [False] * len(words)
    for i, window in enumerate(windows):
        if counts[window] > 1:
            inside[i] = inside[i + 1] = inside[i + 2] = True
    return sum(inside)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def entropy(ids: np.ndarray) -> float:
    """Bits per token of the text's own token frequencies; 0 for no tokens."""
    if not len(ids):
        return 0.0
    counts = np.unique(ids, return_counts=True)[1]
    return float(np.log2(len(ids)) - (counts * np.log2(counts)).sum() / len(ids))


def script_of(text: str) -> str:
    """The script of most letters of ``text``, "none" without letters; ASCII texts are latin."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letters = np.bincount(_PLACES[np.searchsorted(_STARTS, points, side="right") - 1], minlength=len(_NAMES))
    letters[_NAMES.index("none")] = 0
    return _NAMES[int(letters.argmax())] if letters.any() else "none"


def measure(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The counts and measures of every whole text, one row per input row."""

    def run(rows: pa.RecordBatch):
        pieces = _pieces(vocabulary)
        at = 0
        for texts in slices(rows.column("text").to_pylist()):
            words = [WORD.findall(t) for t in texts]
            chars = [sum(map(len, w)) for w in words]
            ids = pieces.encode(words)
            part = rows.slice(at, len(texts))
            yield batch(
                _MEASURES, doc_id=part.column("doc_id"), lang=part.column("lang"),
                script=[script_of(t) for t in texts],
                _text_hash=part.column("_text_hash"), n_words=[len(w) for w in words],
                word_chars=chars, n_symbols=[sum(map(t.count, SYMBOLS)) for t in texts],
                n_dup_lines=[repeated_lines(t) for t in texts],
                n_repeat_words=[repeated_words(w) for w in words],
                n_tokens=[len(i) for i in ids],
                chars_per_token=[c / len(i) if len(i) else 0.0 for c, i in zip(chars, ids)],
                fallback_share=[float(pieces.is_fallback[i].mean()) if len(i) else 0.0 for i in ids],
                token_entropy=[entropy(i) for i in ids])
            at += len(texts)

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    inputs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"),
                         F.xxhash64(F.col("text")).alias("_text_hash"),
                         F.col("text").cast("string").alias("text"))
    return map_batches(inputs, run, _SCHEMA)


def length_class():
    return F.greatest(F.lit(LENGTHS[0]), F.least(F.lit(LENGTHS[1]),
                      F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))))).cast("int")


def _level_keys():
    """The keys of a row's class on every level, nearest first."""
    return F.array(*[
        F.struct(F.lit(level).alias("level"), *[
            (F.col(name) if name in names else F.lit(None).cast(kind)).alias(f"_{name}")
            for name, kind in (("lang", "string"), ("script", "string"), ("length_class", "int"))])
        for level, names in enumerate(LEVELS)])


def bands(measured: DataFrame) -> DataFrame:
    """The bounds of the three measures per class of every level, with the number of texts behind them.

    All texts that pass the base rules count, equal texts of a language once. Values are rounded to a fixed grid
    first, which bounds what an exact quantile must hold for a class, however many texts it has.
    """
    texts = measured.where(~F.col("base_failed")).select(
        "lang", "script", "length_class", "_text_hash", F.round("chars_per_token", 3).alias("chars_per_token"),
        F.round("token_entropy", 3).alias("token_entropy"),
        F.round("fallback_share", 4).alias("fallback_share")).distinct()
    quantiles = F.array(*map(F.lit, QUANTILES))
    middle = texts.select(F.explode(_level_keys()).alias("_key"), *LEAST_WIDTH).groupBy("_key").agg(
        F.count(F.lit(1)).alias("n_texts"), *(F.percentile(m, quantiles).alias(m) for m in LEAST_WIDTH))
    low, high = {}, {}
    for name, least in LEAST_WIDTH.items():
        a, b = F.col(name)[0], F.col(name)[1]
        width = F.greatest(b - a, F.lit(least) * (a if name == "chars_per_token" else F.lit(1.0)))
        low[name], high[name] = a - REACH * width, b + REACH * width
    return middle.select(
        "_key.*", "n_texts",
        low["chars_per_token"].alias("least_chars_per_token"),
        high["chars_per_token"].alias("most_chars_per_token"),
        low["token_entropy"].alias("least_token_entropy"),
        high["fallback_share"].alias("most_fallback_share"))


def class_limits(measured: DataFrame) -> DataFrame:
    """Per language, script and length class the bands of the nearest level with ``LEAST_TEXTS`` texts; those of all
    texts, however few, where no other has as many."""
    enough = bands(measured).where((F.col("n_texts") >= LEAST_TEXTS) | (F.col("level") == len(LEVELS) - 1))
    classes = measured.where(~F.col("base_failed")).select("lang", "script", "length_class").distinct()
    asked = classes.select("*", F.explode(_level_keys()).alias("_asked"))
    same = F.col("_asked.level") == enough.level
    for name in ("lang", "script", "length_class"):
        same &= F.col(f"_asked._{name}").eqNullSafe(enough[f"_{name}"])
    limits = ("least_chars_per_token", "most_chars_per_token", "least_token_entropy", "most_fallback_share")
    found = asked.join(enough, same).groupBy("lang", "script", "length_class").agg(
        F.min_by(F.struct("level", *limits), "level").alias("_band"))
    return found.select(F.col("lang").alias("_lang"), F.col("script").alias("_script"),
                        F.col("length_class").alias("_length_class"), F.col("_band.level").alias("band_level"),
                        *[F.col(f"_band.{name}") for name in limits])


def fertility_verdicts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Whether each text of ``docs`` is worth keeping.

    ``docs`` needs doc_id and text; ``lang`` is used when there, other columns are ignored. One row
    per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
    (fewer than 50 words, or more than half of them in repeated windows), kept, the measures, and
    band_level, the place in ``LEVELS`` of the bands that judged it. A text is kept if it passes the base
    rules and its characters per token, fallback share and token entropy lie in the bands of its
    language (null is one of its own) and length class, if these hold ``LEAST_TEXTS`` different texts, or
    else in those of its script. A null text has no words and fails; what fails has no band_level. Nothing but Spark's own join of the small table of bands is broadcast.
    """
    counted = measure(docs, vocabulary).withColumn("length_class", length_class()).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    counted = settled(counted, "fertility")
    limits = class_limits(counted)
    joined = counted.join(
        limits, ~counted.base_failed & counted.lang.eqNullSafe(limits._lang) & (counted.script == limits._script)
        & (counted.length_class == limits._length_class), "left")
    inside = (
        F.col("chars_per_token").between(F.col("least_chars_per_token"), F.col("most_chars_per_token"))
        & (F.col("token_entropy") >= F.col("least_token_entropy"))
        & (F.col("fallback_share") <= F.col("most_fallback_share")))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
        "n_tokens", "chars_per_token", "fallback_share", "token_entropy", "band_level")
