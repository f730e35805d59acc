"""BPE encoding and decoding with forced-boundary splitting.

The tokenizer file supplies vocabulary, merges and rules; encoding and decoding are done here, on arrays. A text is
normalised (NFC, lower case) and cut into pre-tokens as the file's pattern says. Byte pairs that occur inside no
vocabulary token mark certain cuts, since no merge can join across them: each pre-token is cut there, the distinct
fragments of a buffer are encoded independently (by pair_merging), and the ids are concatenated. Special strings inside
a text become their special ids. Letters and numbers are those of Python's Unicode tables; texts with code points that
these do not know are normalised by the file's own normaliser, and its pattern is asked, once for each, what they are.

Null texts count as empty; an empty text has no ids and decodes to the empty text. Decoding joins the token strings with
spaces, as the library does for a file without a decoder. The vocabulary lives in each task: at most MOST_TOKENS tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panelkiln.llm.pair_merging import PairTable, merge_all
from panelkiln.llm.sparkops import map_batches, returning, table
from panelkiln.llm.textops import binary_column, distinct_spans, pieces, ranges, utf8

MOST_TOKENS = 1_000_000
#: Unicode's White_Space property, the pattern and the normaliser of the files that are supported.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPACE, _LETTER, _NUMBER, _OTHER, _SPECIAL, _UNKNOWN = range(6)
_FIRST_SPECIAL = 0xD800  # special strings become lone surrogates, which no UTF-8 text holds
_SUFFIX = "</w>"


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, lower case and UTF-8 length of every code point."""
    kind, lower = np.full(0x110000, _OTHER, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        x = chr(c)
        category = unicodedata.category(x)[0]
        if category == "L":
            kind[c] = _LETTER
        elif category == "N":
            kind[c] = _NUMBER
        elif unicodedata.category(x) == "Cn":
            kind[c] = _UNKNOWN
        low = x.lower()
        if low != x and len(low) == 1:
            lower[c] = ord(low)
    kind[_SPACES] = _SPACE
    kind[_FIRST_SPECIAL : _FIRST_SPECIAL + 0x800] = _SPECIAL
    points = np.arange(0x110000)
    return kind, lower, (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int8)


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one after the other, and their bounds."""
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


class Codec:
    """A BPE tokenizer file with word ends."""

    def __init__(self, path: str):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        known = spec["normalizer"]["normalizers"] == _NORMALIZERS and split["pattern"] == {"Regex": _PATTERN} and split["invert"] and not level["add_prefix_space"]
        if not known or model["type"] != "BPE" or model["end_of_word_suffix"] != _SUFFIX or spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError("a tokenizer file of another kind")
        vocab = model["vocab"]
        if len(vocab) > MOST_TOKENS:
            raise ValueError(f"more than {MOST_TOKENS} tokens")
        self.special = [(t["content"], t["id"]) for t in spec["added_tokens"]]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("special tokens of another kind")
        chars = _byte_chars()
        self.first, self.last = np.empty(256, np.int32), np.empty(256, np.int32)
        for c, b in chars.items():
            self.first[b], self.last[b] = vocab[c], vocab[c + _SUFFIX]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = PairTable(np.array([vocab[a] for a, _ in merges]), np.array([vocab[b] for _, b in merges]), np.arange(len(merges)), np.array([vocab[a + b] for a, b in merges]))
        #: joined[a, b]: some token holds byte b right behind byte a. Everywhere else a cut is certain.
        self.joined = np.zeros((256, 256), bool)
        for token in vocab:
            data = [chars[c] for c in token.removesuffix(_SUFFIX)]
            self.joined[data[:-1], data[1:]] = True
        size = max([*vocab.values(), *(i for _, i in self.special)]) + 1
        strings = [b""] * size
        for token, i in [*vocab.items(), *self.special]:
            strings[i] = token.encode() + b" "
        self.string = np.frombuffer(b"".join(strings), np.uint8)
        self.string_bounds = np.concatenate([[0], np.cumsum([len(x) for x in strings])])

    def _points(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised code points of the texts, and their bounds."""
        out, given = [], []
        for text in texts:
            text = text or ""
            for k, (content, _) in enumerate(self.special):
                if content in text:
                    text = text.replace(content, chr(_FIRST_SPECIAL + k))
            given.append(text)
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("İ", "i̇")
            out.append(text)
        points, bounds = _flat(out)
        kind = _classes()[0]
        unknown = np.flatnonzero(kind[points] == _UNKNOWN)
        if len(unknown):
            for k in np.unique(np.searchsorted(bounds, unknown, side="right") - 1).tolist():
                parts = re.split(r"([\ud800-\udfff])", given[k])  # not yet normalised: marks behind a letter that grows would change places
                out[k] = "".join(x if i % 2 else self._library().normalizer.normalize_str(x) for i, x in enumerate(parts))
            points, bounds = _flat(out)
            for c in np.unique(points[kind[points] == _UNKNOWN]).tolist():
                kind[c] = self._asked(c)
        return points, bounds

    def _library(self):
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return self.library

    def _asked(self, point: int) -> int:
        """The class of a code point: a letter joins letters, signs join each other, a number stands alone."""
        found = len(self._library().pre_tokenizer.pre_tokenize_str(f"a{chr(point) * 2}a"))
        return {1: _LETTER, 3: _OTHER, 4: _NUMBER}.get(found, _SPACE)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their bounds."""
        kind_of, lower_of, bytes_of = _classes()
        points, bounds = self._points(texts)
        n = len(points)
        if n == 0:
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        kind, points = kind_of[points], lower_of[points]
        begin = np.ones(n, bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER) | (kind[1:] == _SPECIAL)
        begin[bounds[:-1][bounds[:-1] < n]] = True
        # An apostrophe alone before letters takes s, t, m, d, re, ve or ll with it.
        at = np.flatnonzero((points == 39) & begin)
        doc_end = bounds[1:][np.searchsorted(bounds, at, side="right") - 1]
        at, doc_end = at[at + 1 < doc_end], doc_end[at + 1 < doc_end]
        if len(at):
            one = np.isin(points[at + 1], [ord(c) for c in "stmd"])
            third = points[np.minimum(at + 2, n - 1)]
            two = (at + 2 < doc_end) & (((third == 101) & np.isin(points[at + 1], [114, 118])) | ((third == 108) & (points[at + 1] == 108)))
            for hit, size in ((one, 2), (two & ~one, 3)):
                begin[at[hit] + 1] = False
                after = at[hit] + size
                begin[after[after < n]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], n)
        word = kind[starts] != _SPACE
        starts, ends = starts[word], ends[word]
        special = kind[starts] == _SPECIAL
        first, which = distinct_spans(points, starts, ends)
        ids, id_bounds = self._encode_words(points, starts[first], ends[first], special[first], bytes_of)
        own = np.diff(id_bounds)[which]
        out = ids[ranges(id_bounds[:-1][which], own)]
        before = np.concatenate([[0], np.cumsum(own)])
        return out, before[np.searchsorted(starts, bounds)]

    def _encode_words(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, special: np.ndarray, bytes_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens and their bounds."""
        own = ends - starts
        flat = points[ranges(starts, own)]
        data = np.frombuffer(flat.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        byte_at = np.concatenate([[0], np.cumsum(bytes_of[flat], dtype=np.int64)])
        bounds = byte_at[np.concatenate([[0], np.cumsum(own)])]
        symbols = self.first[data]
        symbols[bounds[1:] - 1] = self.last[data[bounds[1:] - 1]]
        cut = np.ones(len(data), bool)
        cut[1:] = ~self.joined[data[:-1], data[1:]]
        cut[bounds[:-1]] = True
        fragments = np.flatnonzero(cut)
        stops = np.append(fragments[1:], len(data))
        first, which = distinct_spans(symbols, fragments, stops)
        sizes = stops[first] - fragments[first]
        ids, id_bounds = merge_all(symbols[ranges(fragments[first], sizes)], np.concatenate([[0], np.cumsum(sizes)]), self.pairs)
        each = np.diff(id_bounds)[which]
        out = ids[ranges(id_bounds[:-1][which], each)]
        before = np.concatenate([[0], np.cumsum(each)])
        word_bounds = before[np.searchsorted(fragments, bounds)]
        if special.any():
            counts = np.diff(word_bounds)
            code = flat[np.concatenate([[0], np.cumsum(own)])[:-1][special]] - _FIRST_SPECIAL
            parts = np.split(out, word_bounds[1:-1])
            for k, c in zip(np.flatnonzero(special).tolist(), code.tolist(), strict=True):
                parts[k], counts[k] = np.array([self.special[c][1]], out.dtype), 1
            out, word_bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])
        return out.astype(np.uint32), word_bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of the texts of ids, and starts and ends of the texts."""
        sizes = np.diff(self.string_bounds)[ids]
        data = self.string[ranges(self.string_bounds[:-1][ids], sizes)]
        at = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        return data, np.stack([at[:-1], np.maximum(at[1:] - 1, at[:-1])])


@lru_cache(maxsize=4)
def load(path: str) -> Codec:
    """Once in each worker process."""
    return Codec(path)


def _encode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids, bounds = codec.encode(piece.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column(0), binary_column(ids, bounds)], ["doc_id", "ids"])

    return run


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers) of each row of `documents` (doc_id, text)."""
    return map_batches(documents.select("doc_id", "text"), returning(_encode_batches(path)), "doc_id long, ids binary")


def _decode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        for batch in batches:
            for piece in pieces(batch, "ids"):
                data, offsets = utf8(piece.column(1))
                text, (starts, ends) = codec.decode(np.frombuffer(data.tobytes(), np.uint32), offsets // 4)
                texts = [text[s:e].tobytes().decode(errors="replace") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of each row of `encoded` (doc_id, ids)."""
    return map_batches(encoded.select("doc_id", "ids"), returning(_decode_batches(path)), "doc_id long, text string")


def _digest_batches(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids, bounds = codec.encode(piece.column(1).to_pylist())
                text, (starts, ends) = codec.decode(ids, bounds)
                id_digests = [hashlib.sha256(ids[s:e]).hexdigest() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                text_digests = [hashlib.sha256(text[s:e]).hexdigest() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [piece.column(0), pa.array(np.diff(bounds)), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *([binary_column(ids, bounds)] * with_ids)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] * with_ids)])

    return run


def round_trip_digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: encoded, decoded and hashed in one pass."""
    return map_batches(documents.select("doc_id", "text"), returning(_digest_batches(path, False)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded_with_digests(documents: DataFrame, path: str) -> DataFrame:
    """The columns of round_trip_digests, and ids."""
    return map_batches(documents.select("doc_id", "text"), returning(_digest_batches(path, True)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests."""
    import public_tokenizers

    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
