"""Document fingerprints by content-defined chunking.

A gear hash of the last 16 bytes sets the chunk bounds, with the normalised rule: a stricter mask up to NORMAL bytes, a
looser one behind, none before LEAST and a forced one at MOST. A fingerprint is the set of the distinct chunks' 64-bit
digests with their lengths. Its likeness to another is the length of the shared chunks divided by that of the smaller
set: an insertion moves bounds only near itself. Equal texts have equal fingerprints and likeness 1; an empty text has
an empty fingerprint, whose likeness is 1 to another empty one and else 0. Null texts count as empty.

As text a fingerprint has 19 hexadecimal digits for each chunk, digest and length, in ascending order.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.llm.sparkops import map_batches, table
from panelkiln.llm.textops import mix, pieces, ranges, sequence_hashes, sequence_sums, utf8

LEAST, NORMAL, MOST = 16, 32, 128
#: Stands for a missing doc_id: below all ids.
_NOWHERE = -1.7e308
_STRICT, _LOOSE = np.uint32(25), np.uint32(29)  # shifts that leave 7 and 3 bits
_GEAR = (mix(np.arange(256, dtype=np.uint64), 61) >> np.uint64(32)).astype(np.uint32)
_HEX = np.frombuffer(b"".join(f"{b:02x}".encode() for b in range(256)), np.uint8).reshape(256, 2)


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of all chunks, in order."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):  # the sum over 1, 2, 4, 8, 16 bytes; LEAST keeps it inside a text
        moved = np.zeros_like(h)
        moved[step:] = h[:-step] << np.uint32(step)
        h = h + moved
    end_of_data = np.array([len(data) + MOST + 1])
    strict = np.append(np.flatnonzero(h >> _STRICT == 0) + 1, end_of_data)
    loose = np.append(np.flatnonzero(h >> _LOOSE == 0) + 1, end_of_data)
    doc = np.flatnonzero(np.diff(offsets) > 0)
    now, stop = offsets[:-1][doc], offsets[1:][doc]
    docs, starts, ends = [], [], []
    while len(doc):  # the next chunk of every text at once
        a = strict[np.searchsorted(strict, now + LEAST)]
        b = loose[np.searchsorted(loose, now + NORMAL)]
        cut = np.where(a < now + NORMAL, a, np.minimum(b, now + MOST))
        cut = np.minimum(cut, stop)
        docs.append(doc)
        starts.append(now)
        ends.append(cut)
        more = cut < stop
        doc, now, stop = doc[more], cut[more], stop[more]
    if not docs:
        return (np.empty(0, np.int64),) * 3
    doc, start, end = (np.concatenate(x) for x in (docs, starts, ends))
    order = np.argsort(start, kind="stable")
    return doc[order], start[order], end[order]


class Fingerprints:
    """The fingerprints of several texts: digests and lengths of distinct chunks, sorted in each text, and bounds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        doc, start, end = chunk_bounds(data, offsets)
        digest = sequence_hashes(sequence_sums(data.astype(np.uint64) + np.uint64(1)), start, end, 62)
        order = np.lexsort((digest, doc))
        doc, digest, length = doc[order], digest[order], (end - start)[order]
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])
        self.digests, self.lengths, doc = digest[fresh], length[fresh], doc[fresh]
        self.bounds = np.searchsorted(doc, np.arange(len(offsets)))

    def texts(self) -> list[str]:
        n = len(self.digests)
        out = np.empty((n, 19), np.uint8)
        out[:, :16] = _HEX[self.digests.byteswap().view(np.uint8).reshape(n, 8)].reshape(n, 16)
        out[:, 16:] = _HEX[np.stack([self.lengths >> 8, self.lengths & 255], axis=1)].reshape(n, 4)[:, 1:]
        whole = out.tobytes().decode()
        return [whole[19 * s : 19 * e] for s, e in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)]


def likeness(a: Fingerprints, x: np.ndarray, b: Fingerprints, y: np.ndarray) -> np.ndarray:
    """Shared chunk length of a's texts x and b's texts y, pairwise, over the smaller of the two."""
    n = len(x)
    sides = []
    for side, at in ((a, x), (b, y)):
        own = np.diff(side.bounds)[at]
        rows = ranges(side.bounds[:-1][at], own)
        sides.append((np.repeat(np.arange(n), own), side.digests[rows], side.lengths[rows]))
    pair, digest, length = (np.concatenate(v) for v in zip(*sides, strict=True))
    order = np.lexsort((digest, pair))
    pair, digest, length = pair[order], digest[order], length[order]
    twice = np.flatnonzero((pair[1:] == pair[:-1]) & (digest[1:] == digest[:-1]))
    shared = np.bincount(pair[twice], length[twice], n)
    totals = [np.bincount(p, size, n) for p, _, size in sides]
    least = np.minimum(*totals)
    out = np.divide(shared, least, out=np.zeros(n), where=least > 0)
    out[(totals[0] == 0) & (totals[1] == 0)] = 1.0
    return np.minimum(out, 1.0)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(Fingerprints(*utf8(piece.column(1))).texts(), pa.string())], ["doc_id", "fingerprint"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row of `documents` (doc_id, text)."""
    return map_batches(documents.select("doc_id", "text"), _fingerprint_batches, "doc_id long, fingerprint string")


def with_successors(documents: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text, bucket, guest: each document stands before its successor in descending order of doc_id.

    Rows are sorted within buckets of adjacent ids. Each bucket ends with a guest, a copy of the first row of the next
    bucket (after the last: of the first), so that no global order is needed. Equal doc_ids stand in descending order of
    a hash of their texts, rows without doc_id come last; where one id (or none) fills several buckets, that hash
    divides its rows among them.
    """
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(_NOWHERE))
    keyed = documents.select(
        "doc_id", "text", place.alias("place"), F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("key"), F.xxhash64("text").alias("digest"),
    )
    cuts = keyed.approxQuantile("place", [k / buckets for k in range(1, buckets)], 0.25 / buckets)
    # An id that is a cut more than once gets buckets of its own. From 2 ** 53 on a double may stand for several ids.
    hot = {v: n for v, n in Counter(cuts).items() if n > 1 and (abs(v) < 2.0**53 or v == _NOWHERE)}
    splits = sorted({*cuts, *(math.nextafter(v, math.inf) for v in hot)})
    if splits:
        numbered = Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol="place", outputCol="number").transform(keyed)
    else:
        numbered = keyed.withColumn("number", F.lit(0))
    share = F.lit(0)
    if hot:  # at most buckets / 2 of them
        parts = F.element_at(F.create_map(*(F.lit(x) for v, n in hot.items() for x in (v, n))), F.col("place"))
        share = F.coalesce(F.floor((F.col("digest") / 2.0**64 + 0.5) * parts), F.lit(0))
    bucket = F.col("number").cast("int") * buckets + F.least(share, F.lit(buckets - 1)).cast("int")
    bucketed = numbered.select("doc_id", "text", "known", "key", "digest", bucket.alias("bucket"))
    order = ("known", "key", "digest")
    firsts = sorted(bucketed.groupBy("bucket").agg(F.max(F.struct(*order)).alias("first")).collect(), reverse=True)  # a row for each bucket
    guests = [(*firsts[(k + 1) % len(firsts)][1], firsts[k][0]) for k in range(len(firsts))]
    guest_rows = documents.sparkSession.createDataFrame(guests or [(False, 0, 0, -1)], "known boolean, key long, digest long, target int")
    copies = bucketed.join(F.broadcast(guest_rows), list(order)).drop("bucket").dropDuplicates(["target"]).withColumnRenamed("target", "bucket")
    both = bucketed.withColumn("guest", F.lit(False)).unionByName(copies.withColumn("guest", F.lit(True)))
    return both.repartition("bucket").sortWithinPartitions("bucket", "guest", *(F.col(c).desc() for c in order)).select("doc_id", "text", "bucket", "guest")


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by the start of the next one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _edited_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held: list[tuple] = []

    def results(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[1] or "" for r in rows]
        pairs = [k for k in range(len(rows) - 1) if not rows[k][3] and rows[k + 1][2] == rows[k][2]]
        changed = [edited(texts[k], texts[k + 1]) for k in pairs]
        a, b = (Fingerprints(*utf8(pa.array(x, pa.string()))) for x in (texts, changed))
        own, own_texts = np.array(pairs, np.int64), a.texts()
        columns = [
            pa.array([rows[k][0] for k in pairs], pa.int64()), pa.array([len(texts[k]) for k in pairs], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()), pa.array([own_texts[k] for k in pairs], pa.string()), pa.array(b.texts(), pa.string()),
            pa.array(likeness(a, own, b, np.arange(len(pairs)))), pa.array(likeness(a, own, a, own + 1)),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        for piece in pieces(batch, "text", 1 << 20):
            rows = held + list(zip(*(piece.column(i).to_pylist() for i in range(4)), strict=True))
            yield results(rows)
            held = rows[-1:]


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_successors(table(spark, sf_dir, "documents").select("doc_id", "text"), buckets)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_batches(rows, _edited_batches, schema)
