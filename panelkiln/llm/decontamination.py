"""Benchmark decontamination over a distributed positional inverted index.

The index has a row for each shard, a run of documents of at most SHARD_BYTES of text (or one longer document): its
distinct words (64-bit hashes, sorted), and for each word its ascending positions in the shard. It is written once to
the shared folder; each later search reads it without a shuffle. A search takes windows of `width` consecutive words of
every test item (an item of fewer words is one window). In a shard, windows with an absent word are dropped, the
others start from the positions of their rarest word and intersect the lists of the next rarer ones, moved by their
offset. What is left are exact phrase matches. With `slack`, windows without an exact match whose words all stand within
width + slack words of one document, in any order, give proximity matches.

Test items are packed into blocks of at most BLOCK_BYTES of text; a longer item is cut into pieces that share width - 1
words, so that it has the same windows. The driver holds one block at a time: the matches of a block are written to the
shared folder before the next one is read.
Null texts and texts without words have no words and no matches; rows without doc_id or item_id are left out of the
matches. Repeated item_ids count as one item, repeated doc_ids as one document whose words are those of all its rows.
Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkiln.llm.sparkops import cut, map_batches, returning, table
from panelkiln.llm.textops import ALPHANUMERIC, Words, binary_column, pieces, ranges, utf8

WIDTH = 13
SHARD_BYTES = 1 << 21
BLOCK_BYTES = 2_000_000
_INDEX = "ids binary, firsts binary, terms binary, bounds binary, places binary"
#: The same words as those of ALPHANUMERIC.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_MATCH = "doc_id long, item_id long, kind string, start long, stop long"


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text", SHARD_BYTES):
            words = Words(*utf8(piece.column(1)), ALPHANUMERIC)
            order = np.argsort(words.hashes, kind="stable")
            h = words.hashes[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = h[1:] != h[:-1]
            at = np.flatnonzero(fresh)
            row = [piece.column(0).to_numpy(zero_copy_only=False), words.of_doc.astype(np.int64), h[at], np.append(at, len(h)).astype(np.int64), order.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([binary_column(x, np.array([0, len(x)])) for x in row], ["ids", "firsts", "terms", "bounds", "places"])


def build_index(documents: DataFrame) -> DataFrame:
    """The index of `documents` (doc_id, text), stored in the shared folder."""
    return cut(map_batches(documents.select("doc_id", "text").where("doc_id IS NOT NULL"), returning(_index_batches), _INDEX))


class Shard:
    """A row of the index."""

    def __init__(self, row: dict):
        self.ids, self.firsts, self.bounds = (np.frombuffer(row[k], np.int64) for k in ("ids", "firsts", "bounds"))
        self.terms, self.places = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["places"], np.int32)

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term in the shard, -1 if it is absent."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def postings(self, term: int) -> np.ndarray:
        return self.places[self.bounds[term] : self.bounds[term + 1]]

    def doc(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, places, side="right") - 1


def _among(values: np.ndarray, sorted_list: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_list, values), len(sorted_list) - 1)
    return sorted_list[at] == values


class Windows:
    """The windows of a block of test items, ready to be searched in any shard."""

    def __init__(self, rows: list[tuple[int, str]], width: int):
        self.items = np.array([r[0] for r in rows], np.int64)
        words = Words(*utf8(pa.array([r[1] for r in rows], pa.string())), ALPHANUMERIC)
        n = words.counts()
        windows = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
        self.item = np.repeat(np.arange(len(rows)), windows)
        self.first = ranges(words.of_doc[:-1], windows)
        self.length = np.minimum(width, n)[self.item]
        self.terms, self.term_of = np.unique(words.hashes, return_inverse=True)

    def search(self, shard: Shard, slack: int | None) -> Iterator[tuple[int, str, np.ndarray, int]]:
        """Window, kind, places and the length of what stands there."""
        own = shard.find(self.terms)
        of_word = own[self.term_of]
        absent = np.concatenate([[0], np.cumsum(of_word < 0)])
        for w in np.flatnonzero(absent[self.first + self.length] == absent[self.first]).tolist():
            terms = of_word[self.first[w] : self.first[w] + self.length[w]]
            sizes = shard.bounds[terms + 1] - shard.bounds[terms]
            order = np.argsort(sizes, kind="stable")
            starts = shard.postings(terms[order[0]]) - order[0]
            for k in order[1:]:
                if not len(starts):
                    break
                starts = starts[_among(starts + k, shard.postings(terms[k]))]
            if len(starts):  # a phrase that runs over the end of a document is none
                starts = starts[(starts >= 0) & (shard.doc(starts) == shard.doc(starts + len(terms) - 1))]
            if len(starts):
                yield w, "phrase", starts, len(terms)
            elif slack is not None and len(terms) > 1:
                found = self._near(shard, terms, order, len(terms) + slack)
                if len(found):
                    yield w, "near", found, len(terms) + slack

    @staticmethod
    def _near(shard: Shard, terms: np.ndarray, order: np.ndarray, reach: int) -> np.ndarray:
        """Places of the rarest word around which some `reach` words of the same document hold all the others.

        For each start of such a run near the rarest word, every distinct term must stand in it as often as needed.
        """
        rare = shard.postings(terms[order[0]])
        distinct, needed = np.unique(terms, return_counts=True)
        lists = [shard.postings(t) for t in distinct]
        for places, often in zip(lists, needed.tolist(), strict=True):  # quick: enough of each term on either side
            if not len(rare):
                return rare
            rare = rare[np.searchsorted(places, rare + reach) - np.searchsorted(places, rare - reach + 1) >= often]
        found = []
        for place in rare.tolist():
            doc = int(shard.doc(np.array([place]))[0])
            low, high = max(int(shard.firsts[doc]), place - reach + 1), min(int(shard.firsts[doc + 1]) - 1, place)
            starts = np.arange(low, high + 1)
            stops = np.minimum(starts + reach, shard.firsts[doc + 1])
            good = np.ones(len(starts), bool)
            for places, often in zip(lists, needed.tolist(), strict=True):
                good &= np.searchsorted(places, stops) - np.searchsorted(places, starts) >= often
            if good.any():
                found.append(int(starts[good.argmax()]))
        return np.array(sorted(set(found)), np.int64)


def _search_batches(rows: list[tuple[int, str]], width: int, slack: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(rows, width)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                spans: dict[tuple[int, str, int], list[tuple[int, int]]] = {}
                for w, kind, starts, length in windows.search(shard, slack):
                    docs = shard.doc(starts)
                    stops = np.minimum(starts + length, shard.firsts[docs + 1]) - shard.firsts[docs]
                    for doc, start, stop in zip(docs.tolist(), (starts - shard.firsts[docs]).tolist(), stops.tolist(), strict=True):
                        spans.setdefault((doc, kind, int(windows.item[w])), []).append((start, stop))
                out: list[tuple] = []
                for (doc, kind, item), found in spans.items():
                    found.sort()
                    joined = [list(found[0])]
                    for start, stop in found[1:]:
                        if start <= joined[-1][1]:
                            joined[-1][1] = max(stop, joined[-1][1])
                        else:
                            joined.append([start, stop])
                    out += [(int(shard.ids[doc]), int(windows.items[item]), kind, a, b) for a, b in joined]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["doc_id", "item_id", "kind", "start", "stop"])

    return run


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, firsts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), pa.array(np.diff(np.frombuffer(firsts, np.int64)))], ["doc_id", "n_words"])


def word_counts(index: DataFrame) -> DataFrame:
    """doc_id, n_words of every indexed row."""
    return map_batches(index.select("ids", "firsts"), returning(_count_batches), "doc_id long, n_words long")


def _item_pieces(text: str, width: int, limit: int) -> Iterator[str]:
    """The text itself, or if it is longer than `limit` bytes, pieces that together have the same windows."""
    size = len(text.encode())
    words = [m.span() for m in _WORD.finditer(text)] if size > limit else []
    if len(words) <= width:
        yield text if size <= limit else " ".join(text[a:b] for a, b in words)
        return
    first = 0
    while first + width <= len(words):
        last = first + width  # as many words as fit, at least one window
        while last < len(words) and 4 * (words[last][1] - words[first][0]) <= limit:
            last += 1
        yield text[words[first][0] : words[last - 1][1]]
        first = last - width + 1


def _block_batches(width: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece in _item_pieces(text, width, limit):
                    size = len(piece.encode())
                    if held and held + size > limit:
                        block, held = block + 1, 0
                    held += size
                    out.append((block, item, piece))
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["block", "item_id", "text"])

    return run


def item_blocks(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """block, item_id, text: the test items packed into blocks of bounded size, stored in the shared folder."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    packed = map_batches(items.repartition(max(1, -(-size // BLOCK_BYTES))), returning(_block_batches(width, BLOCK_BYTES)), "block long, item_id long, text string")
    return cut(packed)


def matches(index: DataFrame, benchmark: DataFrame, width: int = WIDTH, slack: int | None = None) -> DataFrame:
    """doc_id, item_id, kind (phrase or near), start and stop: matched words of documents, windows of an item joined."""
    items = item_blocks(benchmark, width)
    blocks = sorted(r[0] for r in items.select("block").distinct().collect())  # one number for each BLOCK_BYTES
    found = None
    for block in blocks:
        rows = [(r[0], r[1]) for r in items.where(F.col("block") == block).select("item_id", "text").collect()]
        part = map_batches(index, returning(_search_batches(rows, width, slack)), _MATCH)
        if len(blocks) > 1:
            part = cut(part)
        found = part if found is None else found.union(part)
    return index.sparkSession.createDataFrame([], _MATCH) if found is None else found


def judged(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, slack: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit (words in phrase matches), items (sorted as text), near_items and contaminated of each row.

    contaminated: some words are hit, and at least one in twenty.
    """
    index = build_index(documents)
    found = cut(matches(index, benchmark, width, slack))
    before = Window.partitionBy("doc_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    phrases = found.where("kind = 'phrase'").withColumn("before", F.coalesce(F.max("stop").over(before), F.lit(0)))
    hits = phrases.groupBy("doc_id").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "before"))).alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    near = found.where("kind = 'near'").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("near_items"))
    empty = F.array().cast("array<string>")
    counted = word_counts(index).groupBy("doc_id").agg(F.sum("n_words").alias("n_words"))
    rows = documents.select("doc_id").join(counted, "doc_id", "left").join(hits, "doc_id", "left").join(near, "doc_id", "left")
    rows = rows.select("doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", empty).alias("items"), F.coalesce("near_items", empty).alias("near_items"))
    return rows.withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that stand in windows of 13 words of benchmark items."""
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
