"""Near duplicates by HyperMinHash sketches, banding, estimation and exact verification.

A document's set holds the distinct runs of `width` words. Its sketch has REGISTERS buckets. In each of the first THROWS
rounds one hash deals all elements of the set to the buckets; a bucket that is still empty keeps the smallest hash that
falls into it. What is empty after them takes the smallest of one more hash of all elements. So every bucket is filled, also
from a small set, and two sets agree in a bucket with the probability of their similarity. A bucket's register has 16
bits: the leading-zero count of its hash (6 bits) and the 10 bits behind the first one. Documents that agree in all
registers of a band share a band's bucket. Only links between different sets are searched: equal sets are grouped by their digest first
and count as linked.

Each member of a bucket is first compared with the bucket's hub, the member that shares buckets with most others; that is
linear in the bucket. Buckets whose members then still lie in different components are searched completely: those of
at most SMALL members pair by pair, larger ones through differences from the head, the strongest hub of the component that
the bucket's hub is in. See `_through_differences`: pairs are found through the rare elements that both have and the
head has not, and bounds from set sizes show where there can be none. Candidates whose Jaccard estimate, corrected for
register collisions, lies six standard errors below the threshold are dropped; the others are compared on their full
sets. At 0.8 a pair misses all bands with a probability below 1e-8, and is dropped by its estimate with one of about 1e-8.

Null and empty texts have empty sets and are linked with nothing. Rows without doc_id are returned as they are: kept,
component null. Rows that repeat a doc_id are one document with the links of any of them. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkiln.llm.components import connected_components
from panelkiln.llm.sparkops import cut, map_batches, returning, table
from panelkiln.llm.textops import NON_SPACE, PIECE_BYTES, Words, binary_column, mix, packed_pieces, pieces, ranges, sequence_hashes, sequence_sums, utf8

BANDS, ROWS = 48, 5
REGISTERS = BANDS * ROWS
THROWS = 8
MANTISSA_BITS = 10
SMALL = 8
_BAND_FACTORS = mix(np.arange(ROWS, dtype=np.uint64), 12) | np.uint64(1)
_BAND_SEEDS = mix(np.arange(BANDS, dtype=np.uint64), 13)
_BUCKET_FACTORS = mix(np.arange(REGISTERS, dtype=np.uint64), 11) | np.uint64(1)
#: A bucket's register also says, in its last bits, in which round the bucket was filled.
_ROUND_MARKS = (mix(np.arange(THROWS + 1, dtype=np.uint64), 14) & np.uint64((1 << MANTISSA_BITS) - 1)).astype(np.uint16)
_ONLY_HEAD = np.uint64(0x5851F42D4C957F2D)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: The estimate compares the last PACKED bits of each register, side by side in WORDS 64-bit integers.
PACKED = 4
WORDS = REGISTERS * PACKED // 64
_LAST_BITS = 0x1111111111111111
_DIFFERENCES = "hub long, element long, extra boolean, doc long, n long, label long, open boolean, w long, slack long"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, and their offsets.

    A text of fewer words than `width`, but at least one, has its whole sequence as one shingle.
    """
    words = Words(data, offsets, NON_SPACE)
    counts = words.counts()
    n = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    first = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - words.of_doc[:-1], n)
    last = np.minimum(first + width, np.repeat(words.of_doc[1:], n))
    h = sequence_hashes(sequence_sums(words.hashes), first, last)
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        h[s:e].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[bounds[:-1][n > 0]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return h[fresh], kept[bounds]


def registers(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The register matrix of sets that are not empty, (sets, REGISTERS) of uint16."""
    sets = len(bounds) - 1
    least = np.full(sets * REGISTERS, _EMPTY, np.uint64)
    rounds = np.full(sets * REGISTERS, THROWS, np.uint8)
    sizes = np.diff(bounds)
    own, base = h, np.repeat(np.arange(sets) * REGISTERS, sizes)
    for r in range(THROWS):
        if not len(own):
            break
        x = mix(own, 50 + r)
        at = base + (((x >> np.uint64(40)) * np.uint64(REGISTERS)) >> np.uint64(24)).astype(np.int64)
        free = rounds[at] == THROWS
        at, x = at[free], x[free] << np.uint64(24)
        np.minimum.at(least, at, x)
        rounds[at] = r
        empty = (rounds.reshape(sets, REGISTERS) == THROWS).any(axis=1)
        more = empty[base // REGISTERS]
        own, base = own[more], base[more]
    left = np.flatnonzero(rounds == THROWS)
    step = 1 << 16
    for s in range(0, len(left), step):
        at = left[s : s + step]
        who = at // REGISTERS
        n = sizes[who]
        with np.errstate(over="ignore"):
            x = mix(h[ranges(bounds[:-1][who], n)] * np.repeat(_BUCKET_FACTORS[at % REGISTERS], n), 49)
        least[at] = np.minimum.reduceat(x, np.cumsum(n) - n)
    # A double's exponent holds the leading zeros and its first fraction bits are those after the first one.
    found = (np.maximum(least, np.uint64(1)).astype(np.float64).view(np.uint64) >> np.uint64(52 - MANTISSA_BITS)) & np.uint64(0xFFFF)
    return (found.astype(np.uint16) ^ _ROUND_MARKS[rounds]).reshape(sets, REGISTERS)


def packed(sketch: np.ndarray) -> np.ndarray:
    """The last PACKED bits of all registers, (sets, WORDS) of int64."""
    shifts = np.arange(0, 64, PACKED, dtype=np.uint64)
    low = (sketch & np.uint16((1 << PACKED) - 1)).astype(np.uint64).reshape(-1, WORDS, 64 // PACKED)
    return (low << shifts).sum(axis=2, dtype=np.uint64).view(np.int64)


def _sketch_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES // 2):
                h, bounds = shingle_sets(*utf8(piece.column(1)), width)
                n = np.diff(bounds)
                full = n > 0
                low, high = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if full.any():
                    low[full], high[full] = (np.add.reduceat(mix(h, seed), bounds[:-1][full]) for seed in (21, 22))
                    sketch = registers(h, np.append(bounds[:-1][full], bounds[-1]))
                else:
                    sketch = np.empty((0, REGISTERS), np.uint16)
                at = np.concatenate([[0], np.cumsum(full)]) * REGISTERS
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n.astype(np.int64)), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), binary_column(sketch.ravel(), at)], ["doc_id", "n_shingles", "low", "high", "sketch"])

    return run


def _band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "sketch"):
            data, _ = utf8(piece.column(1))
            bands = np.frombuffer(data.tobytes(), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            with np.errstate(over="ignore"):
                keys = mix((bands * _BAND_FACTORS).sum(axis=2, dtype=np.uint64) + _BAND_SEEDS)
            ids = np.repeat(piece.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], ["key", "doc"])


def _packed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "sketch"):
            bits = packed(np.frombuffer(utf8(piece.column(2))[0].tobytes(), np.uint16).reshape(-1, REGISTERS))
            columns = [pa.array(np.ascontiguousarray(bits[:, k])) for k in range(WORDS)]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *columns], ["doc_id", "n", *(f"r{k}" for k in range(WORDS))])


def estimate(same, bits: int = PACKED):
    """The Jaccard estimate from the share of registers whose last bits are equal, less those that are equal by chance.

    The last bits of a mantissa are even, so registers that were filled from different elements collide with 2 ** -bits.
    """
    return (same - 0.5**bits) / (1 - 0.5**bits)


def _likely(percent: int) -> Column:
    """Whether `estimate` of a pair lies at most six standard errors below the threshold, as a bound on unequal registers."""
    differ = F.lit(0)
    for k in range(WORDS):
        x = F.col(f"r{k}_a").bitwiseXOR(F.col(f"r{k}_b"))
        for step in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(_LAST_BITS)))
    collide, level = 0.5**PACKED, percent / 100
    same = level + (1 - level) * collide
    least = same - 6.0 * (same * (1 - same) / REGISTERS) ** 0.5
    return differ <= int((1 - least) * REGISTERS)


def _verify_batches(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in packed_pieces(batch, ["text_a", "text_b"]):
                (h, x), (g, y) = (shingle_sets(*unpacked(piece.column(i)), width) for i in (2, 3))
                linked = np.zeros(piece.num_rows, bool)
                for i in range(piece.num_rows):
                    both = np.concatenate([h[x[i] : x[i + 1]], g[y[i] : y[i + 1]]])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    linked[i] = len(both) > 0 and 100 * shared >= percent * (len(both) - shared)
                chosen = pa.array(linked)
                yield pa.RecordBatch.from_arrays([piece.column(0).filter(chosen), piece.column(1).filter(chosen)], ["a", "b"])

    return run


def _difference_batches(width: int, percent: int):
    """The elements that only one of a head (text_a) and a document (text_b) has, a row each.

    With a elements only in the head, which has n, and e only in the document: w = 100 a + percent e and
    slack = (100 - percent) n. The two are linked if w <= slack; open marks the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in packed_pieces(batch, ["text_a", "text_b"]):
                (h, x), (g, y) = (shingle_sets(*unpacked(piece.column(i)), width) for i in (2, 3))
                elements, extras, sizes, ws, slacks = [], [], [], [], []
                for i in range(piece.num_rows):
                    head, own = h[x[i] : x[i + 1]], g[y[i] : y[i + 1]]
                    extra, missing = np.setdiff1d(own, head, assume_unique=True), np.setdiff1d(head, own, assume_unique=True)
                    elements += [extra, missing ^ _ONLY_HEAD]
                    extras += [np.ones(len(extra), bool), np.zeros(len(missing), bool)]
                    sizes.append(len(extra) + len(missing))
                    ws.append(100 * len(missing) + percent * len(extra))
                    slacks.append((100 - percent) * len(head))
                at = np.repeat(np.arange(piece.num_rows), sizes)
                w, slack = np.array(ws, np.int64)[at], np.array(slacks, np.int64)[at]
                hub, doc, n, label = (piece.column(k).take(pa.array(at)) for k in (0, 1, 4, 5))
                yield pa.RecordBatch.from_arrays(
                    [hub, pa.array(np.concatenate(elements).view(np.int64)), pa.array(np.concatenate(extras)), doc, n, label, pa.array(w > slack), pa.array(w), pa.array(slack)],
                    ["hub", "element", "extra", "doc", "n", "label", "open", "w", "slack"],
                )

    return run


def _through_differences(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents of one head that may be linked, at least one of them open, by bounds on their sets.

    Two documents with w, w' are linked only if they share T = (w + w' - slack) / (100 + percent) elements of their
    differences, or more. Only elements that two components share, one of them with an open document, can count; of
    these a document has e that are extra and a that are missing. Then:
    1. An open document can have a link only if percent a + 100 e >= w - slack, another only if (100 + percent) (a + e) > w.
    2. Let g = (100 + percent) a - w, and G the greatest g of a head's documents. A pair of an open document shares at
       least s = (w - slack - G) / (100 + percent) extra elements; a partner shares (M - g) / (100 + percent) of them, M
       being the least w - slack of the open ones. Where s is positive, the pair meets in one of the e - s + 1 rarest
       extra elements of each side (prefix filter). Missing elements are needed only where s is not positive.
    """
    both, doc = 100 + percent, ["hub", "doc", "w"]
    for _ in range(2):
        often = rows.groupBy("hub", "element").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.bool_or("open").alias("opened"), F.count("*").alias("often"))
        shared = rows.drop("often", "e", "a").join(often.where("low < high AND opened").select("hub", "element", "often"), ["hub", "element"])
        own = shared.groupBy(*doc).agg(F.count_if("extra").alias("e"), F.count_if(~F.col("extra")).alias("a"), F.max("slack").alias("most_slack"), F.bool_or("open").alias("opens"))
        own = own.where(f"CASE WHEN opens THEN {percent} * a + 100 * e >= w - most_slack ELSE {both} * (a + e) > w END")
        rows = cut(shared.join(own.select(*doc, "e", "a"), doc))
    docs = rows.groupBy(*doc).agg(F.max("slack").alias("slack"), F.bool_or("open").alias("open"), F.max("e").alias("e"), F.max("a").alias("a"))
    most = docs.groupBy("hub").agg(F.max(both * F.col("a") - F.col("w")).alias("most"), F.min(F.when(F.col("open"), F.col("w") - F.col("slack"))).alias("least"))
    need = docs.join(most, "hub").select(*doc, F.expr(f"CASE WHEN open THEN ceil((w - slack - most) / {both}) ELSE ceil((least - {both} * a + w) / {both}) END").alias("need"))
    place = Window.partitionBy(*doc, "extra").orderBy("often", "element")
    kept = rows.join(need, doc).withColumn("place", F.row_number().over(place))
    kept = cut(kept.where("CASE WHEN extra THEN place <= e - greatest(need, 1) + 1 OR need <= 0 ELSE need <= 0 END"))
    a, b = (kept.where(side).select("hub", "element", F.col("doc").alias(i), *(F.col(c).alias(f"{c}_{i}") for c in ("n", "label", "e", "a", "w", "slack"))) for i, side in (("a", "open"), ("b", "true")))
    enough = (F.least("e_a", "e_b") + F.least("a_a", "a_b")) * both >= F.col("w_a") + F.col("w_b") - F.col("slack_a")
    met = a.join(b, ["hub", "element"]).where((F.col("label_a") != F.col("label_b")) & _size_ok(percent) & enough)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed UTF-8."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for piece in pieces(batch, "text"):
            data, offsets = utf8(piece.column(1))
            view = memoryview(data.tobytes())
            packed = [pack.compress(view[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(packed, pa.binary())], ["doc_id", "text"])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of compressed texts, and the offsets of the texts."""
    unpack = zstandard.ZstdDecompressor()
    texts = [unpack.decompress(x) for x in column.to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)


def sketches(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, low, high (a 128-bit digest of the set) and sketch (empty for an empty set) of each text."""
    return map_batches(documents.select("doc_id", "text"), returning(_sketch_batches(width)), "doc_id long, n_shingles long, low long, high long, sketch binary")


def _size_ok(percent: int) -> Column:
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b and more) with text_a and text_b."""
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar: sizes, then the estimate, then the full sets."""
    bits = map_batches(sets.select("doc_id", "n_shingles", "sketch"), returning(_packed_batches), "doc_id long, n long, " + ", ".join(f"r{k} long" for k in range(WORDS)))
    a, b = (bits.select(*(F.col(c).alias(x if c == "doc_id" else f"{c}_{x}") for c in bits.columns)) for x in "ab")
    near = pairs.distinct().join(b, "b").join(a, "a").where(_size_ok(percent)).where(_likely(percent)).select("a", "b")
    with_texts = _with_texts(near.distinct(), texts).select("a", "b", "text_a", "text_b")
    return cut(map_batches(with_texts, returning(_verify_batches(width, percent)), "a long, b long").distinct())


def _labels(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """doc, n, label of every set's representative."""
    found = connected_components(edges)
    return sets.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n")).join(found, F.col("doc") == F.col("node"), "left").select("doc", "n", F.coalesce("component", "doc").alias("label"))


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `documents` (doc_id, text).

    component_id is the smallest doc_id that can be reached over links, a document's own included; kept marks the rows
    with doc_id = component_id. Two documents are linked if 100 * shared shingles >= percent * shingles of both.
    """
    found = cut(sketches(documents, width))
    full = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = cut(full.groupBy("n_shingles", "low", "high").agg(F.min("doc_id").alias("doc_id"), F.min_by("sketch", "doc_id").alias("sketch")))

    buckets = map_batches(sets.select("doc_id", "sketch"), returning(_band_batches), "key long, doc long")
    sizes = buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(buckets.join(sizes, "key").select("key", "doc", "size"))
    members = members.join(members.groupBy("doc").agg(F.sum("size").alias("score")), "doc")
    hubs = members.groupBy("key").agg(F.expr("max_by(doc, score * 1048576L + (xxhash64(doc) & 1048575L))").alias("hub"))
    members = cut(members.join(hubs, "key").select("key", "doc", "size", "score", "hub"))
    # Only documents that share a bucket are ever compared; their texts are dealt once, compressed.
    texts = map_batches(documents.select("doc_id", "text"), returning(_pack_batches), "doc_id long, text binary")
    texts = cut(texts.join(members.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    to_hubs = members.where("doc <> hub").select(F.col("hub").alias("a"), F.col("doc").alias("b"))
    edges = _verified(to_hubs, sets, texts, width, percent)

    labelled = members.join(_labels(edges, sets), "doc")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    left = cut(labelled.join(mixed, "key", "left_semi"))
    a, b = (left.where(F.col("size") <= SMALL).select("key", F.col("doc").alias(i), F.col("n").alias(f"n_{i}"), F.col("label").alias(f"label_{i}")) for i in "ab")
    pairs = a.join(b, "key").where((F.col("label_a") != F.col("label_b")) & _size_ok(percent) & (F.col("a") < F.col("b"))).select("a", "b")
    large = left.where(F.col("size") > SMALL)
    hubs = large.where("doc = hub").select("key", "hub", "label", "score")
    heads = hubs.groupBy("label").agg(F.expr("max_by(hub, score * 1048576L + (xxhash64(hub) & 1048575L))").alias("head"))
    heads = hubs.join(heads, "label").select("key", "head").distinct()
    of_heads = large.join(heads, "key").where("doc <> head").select(F.col("head").alias("a"), F.col("doc").alias("b"), "n", "label").distinct()
    differences = cut(map_batches(_with_texts(of_heads, texts).select("a", "b", "text_a", "text_b", "n", "label"), returning(_difference_batches(width, percent)), _DIFFERENCES))
    to_heads = differences.where("NOT open").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct()
    more = _through_differences(differences, percent)
    edges = cut(edges.union(to_heads).union(_verified(pairs.union(more), sets, texts, width, percent)))

    # Labels meet the groups, one row each, before they meet the rows, of which one group may hold very many.
    components = connected_components(edges)
    labels = sets.join(components, sets.doc_id == components.node, "left").select("n_shingles", "low", "high", F.coalesce("component", "doc_id").alias("label"))
    rows = found.select("doc_id", "n_shingles", "low", "high")
    of_doc = rows.join(labels, ["n_shingles", "low", "high"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"))
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if repeated:
        of_doc = of_doc.join(_merged(of_doc), "doc_id", "left").withColumn("component_id", F.coalesce("merged", "component_id")).drop("merged")
    return of_doc.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _merged(of_doc: DataFrame) -> DataFrame:
    """Components over rows that repeat a doc_id: their components are one."""
    nodes = connected_components(of_doc.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")))
    return nodes.select(F.col("node").alias("doc_id"), F.col("component").alias("merged"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents on two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
