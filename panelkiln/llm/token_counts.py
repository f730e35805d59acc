"""Token counts under a sentencepiece BPE model by rank-synchronous array merging.

The model file supplies the pieces and their scores; the counting is done here. A text is given a leading space mark and
has its spaces turned into marks (the model's own rules; others are refused). It is cut into pre-tokens, runs of space
marks with the characters behind them, and further at character pairs that no piece contains, where no merge can
reach. The distinct pre-tokens of a buffer are held as ragged arrays and merged together; the surviving symbols are counted,
an unknown character as one symbol for each of its bytes.

A null or empty text has no token. The vocabulary is broadcast inside the task's function: at most MOST_PIECES pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panelkiln.llm.pair_merging import PairTable, merge_all
from panelkiln.llm.sparkops import map_batches, table
from panelkiln.llm.textops import distinct_spans, pieces, ranges, utf8

MARK = 0x2581
MOST_PIECES = 1_000_000
CONTEXT = 4096


class Pieces:
    """What is needed of a model: ids of single characters, pairs that merge, and character pairs inside pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        if size > MOST_PIECES:
            raise ValueError(f"more than {MOST_PIECES} pieces")
        if model.normalize("") or model.normalize("①  a\n ") != "▁①▁▁a\n▁":
            raise ValueError("only models with an identity normaliser, a leading space mark and kept white space are counted")
        usual = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        ids = {model.id_to_piece(i): i for i in usual}
        scores = {i: model.get_score(i) for i in usual}
        order = {i: k for k, i in enumerate(sorted(usual, key=lambda i: -scores[i]))}
        if len(set(scores.values())) != len(scores):
            levels = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
            order = {i: levels[scores[i]] for i in usual}
        # Symbols: a piece by its id, an unknown character by size + code point.
        self.size = size
        pairs, inside = [], set()
        self.symbol = np.arange(0x110000, dtype=np.int32) + size
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
            inside.update(zip(piece, piece[1:], strict=False))
        of = {**ids}
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                a, b = piece[:k], piece[k:]
                a_id = of.get(a, size + ord(a) if len(a) == 1 else None)
                b_id = of.get(b, size + ord(b) if len(b) == 1 else None)
                if a_id is not None and b_id is not None:
                    pairs.append((a_id, b_id, order[i], i))
        self.pairs = PairTable(*(np.array(x, np.int64) for x in zip(*pairs, strict=True)))
        keys = np.array(sorted((ord(a) << 21) | ord(b) for a, b in inside), np.int64)
        self.inside = PairTable(keys >> 21, keys & 0x1FFFFF, np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64))
        if any(chr(MARK) in p.lstrip(chr(MARK)) for p in ids):
            raise ValueError("pieces with a space mark behind other characters")

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each UTF-8 text."""
        texts = len(offsets) - 1
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int32)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        points = np.where(points == 32, MARK, points)
        full = np.flatnonzero(np.diff(chars) > 0)
        if not len(full):
            return np.zeros(texts, np.int64)
        begins = chars[:-1][full]
        points = np.insert(points, begins, MARK)  # the leading mark
        begins = begins + np.arange(len(full))
        mark = points == MARK
        cut = np.zeros(len(points), bool)
        cut[1:] = mark[1:] & ~mark[:-1]
        cut[1:] |= ~mark[1:] & ~mark[:-1] & (self.inside.find(points[:-1], points[1:]) == len(self.inside.rank) - 1)
        cut[begins] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(points))
        first, which = distinct_spans(points, starts, ends)
        own = ends[first] - starts[first]
        bounds = np.concatenate([[0], np.cumsum(own)])
        merged, merged_bounds = merge_all(self.symbol[points[ranges(starts[first], own)]], bounds, self.pairs)
        unknown = np.maximum(merged - self.size, 0)
        weight = np.where(merged < self.size, 1, 1 + (unknown > 0x7F) + (unknown > 0x7FF) + (unknown > 0xFFFF))
        total = np.concatenate([[0], np.cumsum(weight)])
        each = (total[merged_bounds[1:]] - total[merged_bounds[:-1]])[which]
        per_text = np.add.reduceat(each, np.searchsorted(starts, begins))
        out = np.zeros(texts, np.int64)
        out[full] = per_text
        return out


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    """Once in each worker process."""
    return Pieces(path)


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, offsets = utf8(piece.column(1))
                n = model.counts(data, offsets)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(offsets)), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of each row of `documents` (doc_id, text)."""
    return map_batches(documents.select("doc_id", "text"), _count_batches(model_path), "doc_id long, n_bytes long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; over_limit marks those that do not fit a context of 4096."""
    import public_tokenizers

    found = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumn("over_limit", found.n_tokens > CONTEXT)
