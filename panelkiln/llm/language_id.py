"""Language spans by script ranges and Viterbi over per-word scores.

Words are runs of letters. The script of a word (from code point ranges) leaves the languages that were seen with it;
a word of a script that no language was seen with leaves all. A word's score in a language is the sum of log
probabilities of its character trigrams, word bounds included, in 2 ** BITS hashed buckets. Viterbi with a penalty for
each change of language labels the words of a text; runs of one label are its spans. The language with the most letters
wins, and its score is its share of the letters.

Training counts the trigrams of every training text. Null texts and texts without a letter are `und` with score 0 and
have no spans. Rows without language are not learned from. Without any training row every text is `und`. At most
MOST_LANGUAGES languages are learned (an error above), which bounds what the tasks receive.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.llm.sparkops import bounded_rows, crc_mod, map_batches, table
from panelkiln.llm.textops import pieces, utf8

BITS = 15
MOST_LANGUAGES = 256
PENALTY = 25.0
CELLS = 1 << 23
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
#: Scripts by code point ranges; what is in none of them is the last one.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "indic": [(0x900, 0xDFF)],
    "thai": [(0xE00, 0xEFF)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
N_SCRIPTS = len(SCRIPTS) + 1
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Script number + 1 of each letter (0: no letter), and its lower case."""
    script, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if unicodedata.category(x)[0] == "L":
            script[c] = N_SCRIPTS
            low = x.lower()
            lower[c] = ord(low) if len(low) == 1 else c
    for k, spans in enumerate(SCRIPTS.values()):
        for first, last in spans:
            own = script[first : last + 1]
            own[own > 0] = k + 1
    return script, lower


class Letters:
    """Words of several texts: script (of the first letter), letter counts, text of each word, trigrams of all letters."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        script_of, lower_of = _letters()
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        script = script_of[points]
        letter = script > 0
        begin = letter.copy()
        begin[1:] &= ~letter[:-1]
        begin[bounds[:-1][bounds[:-1] < len(points)]] = True
        begin &= letter
        at = np.flatnonzero(letter)
        starts = np.flatnonzero(begin[at])
        n = len(at)
        x = lower_of[points[at]]
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        first[starts] = True
        last[np.append(starts[1:], n)[: len(starts)] - 1] = True
        with np.errstate(over="ignore"):
            before, after = np.roll(x, 1), np.roll(x, -1)
            before[first], after[last] = 0, 0
            h = before * _FACTORS[0] + x * _FACTORS[1] + after * _FACTORS[2]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
        self.trigrams = (h >> np.uint32(32 - BITS)).astype(np.int64)
        self.starts = starts
        self.scripts = script[at[starts]].astype(np.int64) - 1
        self.sizes = np.diff(np.append(starts, n))
        self.char_starts = at[starts]
        self.docs = np.searchsorted(bounds, self.char_starts, side="right") - 1
        self.of_doc = np.searchsorted(self.docs, np.arange(len(offsets)))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    scores: np.ndarray  # (languages, buckets) log probabilities
    allowed: np.ndarray  # (scripts, languages)


def _train_batches(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: k for k, x in enumerate(languages)}
        width = (1 << BITS) + N_SCRIPTS
        counts = np.zeros(len(languages) * width, np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = Letters(*utf8(piece.column(0)))
                if not len(words.starts):
                    continue
                lang = np.array([number[x] for x in piece.column(1).to_pylist()])[words.docs]
                counts += np.bincount(np.repeat(lang, words.sizes) * width + words.trigrams, minlength=len(counts))
                counts += np.bincount(lang * width + (1 << BITS) + words.scripts, words.sizes, len(counts)).astype(np.int64)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["cell", "n"])

    return run


def train(documents: DataFrame) -> Model:
    """A model from all rows of `documents` (text, lang) that have both."""
    known = documents.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    languages = sorted(r[0] for r in bounded_rows(known.select("lang").distinct(), MOST_LANGUAGES, "languages"))
    width = (1 << BITS) + N_SCRIPTS
    counts = np.zeros(len(languages) * width)
    if languages:
        found = map_batches(known, _train_batches(languages), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        rows = found.toArrow()  # at most languages * width rows
        counts[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    counts = counts.reshape(len(languages), width)
    grams, scripts = counts[:, : 1 << BITS] + 0.5, counts[:, 1 << BITS :].T
    total = scripts.sum(axis=0)
    allowed = scripts >= np.maximum(SCRIPT_SHARE * total, 1)
    allowed[~allowed.any(axis=1)] = True
    return Model(languages, np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32), allowed)


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label of each word: most score, less `penalty` for each change inside a text. scores: (words, labels).

    Most texts need no recursion. Let b be the label with the most score over a text. In a path of k >= 2 runs, the first
    run's gain over b is at most A (the best start of the text), the last one's at most Z (the best end) and each one's
    between at most M (the best stretch). If M <= penalty and A + Z <= penalty, A + Z + (k - 2) M <= (k - 1) penalty: no
    path beats b throughout.
    """
    words, labels = scores.shape
    out = np.zeros(words, np.int64)
    counts = np.diff(bounds)
    full = np.flatnonzero(counts)
    if labels < 2 or not len(full):
        return out
    heads = bounds[:-1][full]
    best = np.add.reduceat(scores, heads, axis=0).argmax(axis=1)
    own = np.repeat(best, counts[full])
    out[:] = own
    gain = scores - scores[np.arange(words), own][:, None]
    sums = np.zeros((words + 1, labels))
    np.cumsum(gain, axis=0, out=sums[1:])
    part = np.repeat(np.arange(len(full)), counts[full])
    step = float(np.abs(sums).max()) * 2 + 1  # moves each text below the ones before it, so that one minimum serves all
    low = np.minimum.accumulate(sums[:-1] - (part * step)[:, None], axis=0) + (part * step)[:, None]
    between = np.maximum.reduceat((sums[1:] - low).max(axis=1), heads)
    first = np.maximum.reduceat((sums[1:] - sums[heads][part]).max(axis=1), heads)
    last = np.maximum.reduceat((sums[heads + counts[full]][part] - sums[:-1]).max(axis=1), heads)
    rest = full[(between > penalty) | (np.maximum(first, 0) + np.maximum(last, 0) > penalty)]
    rest = rest[np.argsort(-counts[rest], kind="stable")]
    while len(rest):  # texts of about one length at once, as many as fit into CELLS cells
        many = max(1, CELLS // (int(counts[rest[0]]) * labels))
        _recursion(scores, bounds, rest[:many], penalty, out)
        rest = rest[many:]
    return out


def _recursion(scores: np.ndarray, bounds: np.ndarray, texts: np.ndarray, penalty: float, out: np.ndarray) -> None:
    """Viterbi over some texts, longest first, a word of each at a time. Writes the labels of their words to out."""
    starts, sizes = bounds[:-1][texts], np.diff(bounds)[texts]
    labels = scores.shape[1]
    back = np.empty((int(sizes[0]), len(texts), labels), np.int16)
    value = scores[starts].astype(float)
    for t in range(1, int(sizes[0])):
        n = int(np.searchsorted(-sizes, -t, side="left"))  # texts of more than t words
        now = value[:n]
        top = now.argmax(axis=1)
        moved = now[np.arange(n), top][:, None] - penalty
        back[t, :n] = np.where(moved > now, top[:, None], np.arange(labels))
        value[:n] = np.maximum(now, moved) + scores[starts[:n] + t]
    label = value.argmax(axis=1)
    for t in range(int(sizes[0]) - 1, -1, -1):
        n = int(np.searchsorted(-sizes, -t, side="left"))
        out[starts[:n] + t] = label[:n]
        if t:
            label[:n] = back[t, np.arange(n), label[:n]]


def label_words(words: Letters, model: Model) -> np.ndarray:
    """The language number of each word.

    A language that is not allowed for a word's script scores so little there that leaving it for one word, at two
    changes, is always better: the script leaves only its candidates.
    """
    each = np.stack([np.add.reduceat(row[words.trigrams], words.starts) for row in model.scores], axis=1)
    each = np.where(model.allowed[words.scripts], each, each.min(axis=1, keepdims=True) - 2 * PENALTY - 1)
    return viterbi(each, words.of_doc)


def _predict_batches(model: Model, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(model.languages)
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = Letters(*utf8(piece.column(1)))
                texts = piece.num_rows
                share, spans = np.zeros((texts, n + 1)), [[] for _ in range(texts)]
                if n and len(words.starts):
                    label = label_words(words, model)
                    share = np.bincount(words.docs * (n + 1) + label, words.sizes, texts * (n + 1)).reshape(texts, n + 1)
                    if with_spans:
                        new = np.ones(len(label), bool)
                        new[1:] = (label[1:] != label[:-1]) | (words.docs[1:] != words.docs[:-1])
                        first = np.flatnonzero(new)
                        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(label)], strict=True):
                            spans[words.docs[a]].append({"first_word": a - int(words.of_doc[words.docs[a]]), "n_words": b - a, "lang": names[label[a]]})
                total = share.sum(axis=1)
                won = np.where(total > 0, share[:, :n].argmax(axis=1) if n else n, n)
                score = np.divide(share.max(axis=1), total, out=np.zeros(texts), where=total > 0)
                kind = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string())]))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(names[won], pa.string()), pa.array(score), *([pa.array(spans, kind)] if with_spans else [])], ["doc_id", "lang_pred", "score", *(["spans"] if with_spans else [])])

    return run


def predict(documents: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score of each row of `documents` (doc_id, text); spans: first_word, n_words and lang of runs."""
    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<first_word: long, n_words: long, lang: string>>" * with_spans
    return map_batches(documents.select("doc_id", "text"), _predict_batches(model, with_spans), schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned outside the held-out third."""
    documents = table(spark, sf_dir, "documents")
    model = train(documents.where(F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(False))))
    found = predict(documents, model)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
