"""Removal of repeated passages by sliding sentence spans.

A sentence ends after a word with a final `.`, `!` or `?`, or at a line break. Sentences of over LONG words are cut
further after words whose hash is a multiple of CUT, so that a passage in the middle of a run-on text is cut at the same
places wherever it stands, and FORCED words after the last cut. Every run of SPAN consecutive sentences is hashed (two
independent sums over its lower-cased words, 96 bits); a run of fewer than LEAST_WORDS words is lengthened at its end, and another one at its
start, until it has as many.

Where sentences end depends on what stands around a passage, so runs of sentences alone can miss one. Anchors do not
miss it: of every WINDOW consecutive runs of ANCHOR words the one with the least hash is a run too. Two places that share
ANCHOR + WINDOW - 1 words (51) share a whole window, hence an anchor, wherever the passage begins and ends.

Runs are joined globally. Of each run the first occurrence, by doc_id and place, stays; the words that any other
occurrence covers are cut out, with the white space behind them. All other bytes stay as they are. Only hashes that two
rows have are joined with their places. They are found from the hashes alone: these go in blocks to ranges of the hash
space, of which a task sorts one at a time, and come back as 2 ** FILTER_BITS bits; the bits can let through too many
runs, never too few.

Null texts stay null, texts without a run (fewer than SPAN sentences or LEAST_WORDS words) are not changed. Rows
without doc_id are not compared and stay. Rows that repeat a doc_id are one place in the order: they do not count as
repetitions of each other, and each is cut by the runs of its own text. Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.llm.sparkops import map_batches, returning, table
from panelkiln.llm.textops import NON_SPACE, PIECE_BYTES, Words, binary_column, mix, packed_pieces, pieces, sequence_hashes, sequence_sums, utf8

SPAN = 3
LEAST_WORDS = 10
LONG = 10
CUT = 5
FORCED = 12
ANCHOR = 26
WINDOW = 26
FILTER_BITS, MOST_FILTERED = 28, 1 << 36
#: Hashes that a task holds before it sends them out, and the text for which the hash space gets one more range.
HELD = 1 << 20
RANGE_BYTES = 1 << 24
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?"])


def sentence_starts(words: Words, data: np.ndarray) -> np.ndarray:
    """The first words of all sentences, in order; the number of words comes last."""
    n = len(words.starts)
    if n == 0:
        return np.zeros(1, np.int64)
    ends = _ENDS[data[words.ends - 1]]
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    ends[:-1] |= breaks[words.starts[1:]] > breaks[words.ends[:-1]]
    last = words.of_doc[1:][words.of_doc[1:] > 0] - 1
    ends[last] = True
    sentence = np.concatenate([[0], np.cumsum(ends)[:-1]])
    long = np.bincount(sentence) > LONG
    long = long[sentence]
    ends |= long & (words.hashes % np.uint64(CUT) == 0)
    starts = np.concatenate([[0], np.flatnonzero(ends) + 1])[:-1]
    since = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    ends |= long & (since % FORCED == FORCED - 1)
    return np.concatenate([[0], np.flatnonzero(ends) + 1])


def runs(words: Words, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 sentence of every run, in the order of the first."""
    units = len(starts) - 1
    doc = np.searchsorted(words.of_doc, starts[:-1], side="right") - 1
    first = np.arange(units)
    last = np.maximum(first + SPAN, np.searchsorted(starts, starts[:-1] + LEAST_WORDS))
    forward = last <= units
    forward[forward] = doc[last[forward] - 1] == doc[first[forward]]
    end = np.arange(1, units + 1)
    begin = np.minimum(end - SPAN, np.searchsorted(starts, starts[1:] - LEAST_WORDS, side="right") - 1)
    back = begin >= 0
    back[back] = doc[begin[back]] == doc[end[back] - 1]
    back[back] = last[begin[back]] != end[back]
    s, e = np.concatenate([first[forward], begin[back]]), np.concatenate([last[forward], end[back]])
    order = np.argsort(s, kind="stable")
    return s[order], e[order]


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least or greatest of every `width` consecutive values."""
    pick, done = (np.minimum if least else np.maximum), 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


def anchors(words: Words) -> np.ndarray:
    """First words of the runs of ANCHOR words that have the least hash in a window of their text."""
    n, reach = len(words.hashes), ANCHOR + WINDOW - 1
    if n < reach:
        return np.empty(0, np.int64)
    first = np.arange(n - ANCHOR + 1)
    h = sequence_hashes(sequence_sums(words.hashes), first, first + ANCHOR, 33) | np.uint64(1)
    doc = words.docs()
    least = np.where(doc[: n - reach + 1] == doc[reach - 1 :], _sliding(h, WINDOW, True), np.uint64(0))
    around = np.zeros(WINDOW - 1, np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate([around, least, around]), WINDOW, False) == h)
    # in a stretch of one repeated word all runs are equal: each WINDOW-th and the last are in every window of it
    fresh = np.ones(len(chosen), bool)
    fresh[1:] = (np.diff(chosen) > 1) | (h[chosen[1:]] != h[chosen[:-1]])
    heads = np.flatnonzero(fresh)
    place = np.arange(len(chosen)) - np.repeat(heads, np.diff(np.append(heads, len(chosen))))
    return chosen[(place % WINDOW == 0) | np.append(fresh[1:], True)]


def _piece_runs(piece: pa.RecordBatch):
    """Hashes, text, first and end byte of all runs, and whether their text has them before."""
    data, offsets = utf8(piece.column(1))
    words = Words(data, offsets, NON_SPACE)
    starts = sentence_starts(words, data)
    s, e = runs(words, starts)
    more = anchors(words)
    first, end = np.concatenate([starts[s], more]), np.concatenate([starts[e], more + ANCHOR])
    h = sequence_hashes(sequence_sums(words.hashes), first, end, 31)
    g = sequence_hashes(sequence_sums(mix(words.hashes, 34)), first, end, 32)
    doc = np.searchsorted(words.of_doc, first, side="right") - 1
    from_byte = words.starts[first] - offsets[doc]
    within = end < words.of_doc[doc + 1]
    to_byte = np.where(within, np.append(words.starts, 0)[np.where(within, end, 0)], offsets[doc + 1]) - offsets[doc]
    order = np.lexsort((from_byte, h, doc))
    equal = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    moved = from_byte[order[1:]] != from_byte[order[:-1]]
    again, once = np.zeros(len(h), bool), np.ones(len(h), bool)
    again[order[1:]] = equal & moved
    once[order[1:]] = ~equal | moved  # an anchor can be a run of sentences too
    h, g, doc, from_byte, to_byte, again = (x[once] for x in (h, g, doc, from_byte, to_byte, again))
    return h, g, doc, from_byte, to_byte, again


def _hash_batches(range_bits: int):
    """Rows part, block: sorted hashes of one range of the hash space; of equal ones two stay."""

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        h = np.sort(np.concatenate(held))
        more = np.ones(len(h), bool)
        more[2:] = h[2:] != h[:-2]
        h = h[more]
        part = (h >> np.uint64(64 - range_bits)).astype(np.int64)
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]) if len(h) else [])
        return pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int64()), binary_column(h, np.append(starts, len(h)))], ["part", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES // 2):
                h, _, _, _, _, again = _piece_runs(piece)
                held.append(h[~again])
                size += len(held[-1])
                if size >= HELD:
                    yield sent(held)
                    held, size = [], 0
        if size:
            yield sent(held)

    return run


def _bits(h: np.ndarray, filter_bits: int) -> np.ndarray:
    """The place of each hash in the filter."""
    return (h >> np.uint64(64 - filter_bits)).astype(np.int64)


def _filter_batches(range_bits: int, filter_bits: int):
    """Rows part, bits: the filter's bits of one range, compressed. Rows come sorted by part."""
    size = 1 << (filter_bits - range_bits)

    def sent(part: int, blocks: list[bytes]) -> pa.RecordBatch:
        h = np.sort(np.frombuffer(b"".join(blocks), np.uint64))
        marks = np.zeros(size, bool)
        marks[_bits(h[1:][h[1:] == h[:-1]], filter_bits) & (size - 1)] = True
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([zstandard.compress(np.packbits(marks).tobytes())], pa.binary())], ["part", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        for batch in batches:
            for part, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now and blocks:
                    yield sent(now, blocks)
                    blocks = []
                now = part
                blocks.append(block)
        if blocks:
            yield sent(now, blocks)

    return run


def repeated_filter(texts: DataFrame) -> bytes | None:
    """Bits of the hashes that several rows have, and of those that fall on the same bits, compressed.

    Its size follows the text, up to 2 ** FILTER_BITS bits. Text of more than MOST_FILTERED bytes would set them nearly all:
    then there is no filter, and every run is dealt out.
    """
    amount = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    if amount > MOST_FILTERED:
        return None
    filter_bits = min(FILTER_BITS, max(16, int(amount).bit_length() - 2))
    range_bits = min(filter_bits - 3, max(6, (amount // RANGE_BYTES).bit_length()))
    blocks = map_batches(texts, returning(_hash_batches(range_bits)), "part long, block binary")
    dealt = blocks.repartition(1 << (range_bits - 2), "part").sortWithinPartitions("part")
    bits = np.zeros(1 << (filter_bits - 3), np.uint8)
    size = 1 << (filter_bits - 3 - range_bits)
    for part, found in map_batches(dealt, returning(_filter_batches(range_bits, filter_bits)), "part long, bits binary").collect():
        bits[part * size : (part + 1) * size] = np.frombuffer(zstandard.decompress(found), np.uint8)
    return zstandard.compress(bits.tobytes())


def _run_batches(packed: bytes | None, inner: bool):
    """Runs that pass the filter; inner: the places of runs that the same text has before, joined, without hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(zstandard.decompress(packed), np.uint8) if packed else np.full(1 << 13, 0xFF, np.uint8)
        filter_bits = (len(bits) * 8).bit_length() - 1
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES // 2):
                h, g, doc, from_byte, to_byte, again = _piece_runs(piece)
                at = _bits(h, filter_bits)
                keep = np.flatnonzero(~again & (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 > 0))
                place = pa.array((from_byte[keep] << 32) | to_byte[keep])
                rows = pa.array(doc[keep])
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array((g[keep] >> np.uint64(32)).astype(np.uint32).view(np.int32)), piece.column(0).take(rows), piece.column(2).take(rows), place], ["h", "g", "doc", "tag", "at"])
                if inner and again.any():
                    own, start, stop = doc[again], from_byte[again], to_byte[again]
                    order = np.lexsort((start, own))
                    own, start, stop = own[order], start[order], stop[order]
                    reach = np.maximum.accumulate(stop + (own << 40)) - (own << 40)  # no text has 2^40 bytes
                    new = np.ones(len(own), bool)
                    new[1:] = (own[1:] != own[:-1]) | (start[1:] > reach[:-1])
                    first = np.flatnonzero(new)
                    last = np.append(first[1:], len(own)) - 1
                    rows = pa.array(own[first])
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.int32()), piece.column(0).take(rows), piece.column(2).take(rows), pa.array((start[first] << 32) | reach[last])], ["h", "g", "doc", "tag", "at"])

    return run


def cut_text(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without some byte ranges, which may overlap."""
    data, kept, done = text.encode(), [], 0
    for start, end in sorted(ranges):
        if start > done:
            kept.append(data[done:start])
        done = max(done, end)
    kept.append(data[done:])
    return b"".join(kept).decode()


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first column's texts compressed; a null text stays null."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for piece in pieces(batch, "__text"):
            packed = [None if x is None else pack.compress(x.encode()) for x in piece.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), *piece.columns[1:]], piece.schema.names)


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for piece in packed_pieces(batch, ["__text"]):
            out, spans = [], []
            for packed, marks in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                text = None if packed is None else unpack.decompress(packed).decode()
                if text and marks:
                    text = cut_text(text, [(at >> 32, at & 0xFFFFFFFF) for at in marks])
                out.append(text)
                spans.append(len(marks or ()))
            yield pa.RecordBatch.from_arrays([*piece.columns[2:], pa.array(out, pa.string()), pa.array(spans, pa.int64())], [*piece.schema.names[2:], "__new", "__spans"])


def repeated_spans(documents: DataFrame) -> DataFrame:
    """doc, tag (xxhash64 of the text), cuts (array of first byte * 2^32 + end byte): runs of a text that occur before."""
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("tag")).where("doc_id IS NOT NULL")
    bits = repeated_filter(texts.select("doc_id", "text"))
    schema = "h long, g int, doc long, tag long, at long"
    first = map_batches(texts, returning(_run_batches(bits, False)), schema).groupBy("h", "g").agg(F.min("doc").alias("first"))
    found = map_batches(texts, returning(_run_batches(bits, True)), schema)
    # Left: runs without a hash have no first row.
    later = found.join(first, ["h", "g"], "left").where("h IS NULL OR doc > first")
    return later.groupBy("doc", "tag").agg(F.collect_set("at").alias("cuts"))


def remove_repeated(documents: DataFrame) -> DataFrame:
    """`documents` with repeated passages cut out of text, and span_hits (long): repeated runs found in the text."""
    names = [c for c in documents.columns if c != "text"]
    cuts = repeated_spans(documents)
    inner = documents.select(F.col("text").alias("__text"), F.xxhash64("text").alias("__tag"), *(F.col(c).alias(f"__{i}") for i, c in enumerate(names)))
    kinds = [f"__{i} {kind}" for i, (_, kind) in enumerate(documents.select(*names).dtypes)]
    packed = map_batches(inner, returning(_pack_batches), ", ".join(["__text binary", "__tag long", *kinds]))
    same = (packed[f"__{names.index('doc_id')}"] == cuts.doc) & (packed["__tag"] == cuts.tag)
    joined = packed.join(cuts, same, "left").select("__text", F.col("cuts").alias("__cuts"), *(f"__{i}" for i in range(len(names))))
    done = map_batches(joined, returning(_cut_batches), ", ".join([*kinds, "__new string", "__spans long"]))
    back = {c: F.col(f"__{i}") for i, c in enumerate(names)} | {"text": F.col("__new")}
    return done.select(*(back[c].alias(c) for c in documents.columns), F.col("__spans").alias("span_hits"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages: doc_id, text, n_chars (of the new text), cut_chars, span_hits."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").cast("long").alias("was"))
    done = remove_repeated(documents)
    return done.select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.coalesce(F.col("was") - F.length("text"), F.lit(0)).cast("long").alias("cut_chars"), "span_hits")
