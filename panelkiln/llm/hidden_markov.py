"""A hidden Markov language model, trained by Baum-Welch sums over all partitions.

Tokens are the lower-cased words of a text and one end. A state emits a class of tokens, and a class its tokens. Words with at
least 1/FREQUENT of all training tokens, of which there can't be more than FREQUENT, and the end are classes of their own. The others
share REST classes by their last three letters (bytes); a class gives each of its words (count + 1) and an unknown word 1 of
(tokens + words + 1) shares, so that the model is a distribution over texts. Counts of words cover the whole training corpus and stay on
executors: they meet the texts through the distinct words of blocks of texts. Only class tables, whose size is fixed, reach the driver and the tasks.

Each round of training runs the scaled forward and backward recursions over all training texts. Tasks add up expected emissions
and transitions, these sums meet in a shuffle by class, and the driver divides a table of classes by states. All texts of a
block move on by one token at a time, the longest first. A text of more than CHUNK tokens is cut; products of the
transition and emission matrices over each piece give the exact vectors at the cuts, so that the likelihood is that of the whole text.

Null and empty texts are one end. Texts that repeat a doc_id are rows of their own. Rows without doc_id get no held_out and are
scored, but not learned from. With no training rows, all classes are equally likely. Other columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.llm.sparkops import bounded_rows, crc_mod, cut, map_batches, table
from panelkiln.llm.textops import NON_SPACE, Words, mix, pieces, ranges, utf8

STATES, ROUNDS = 8, 4
FREQUENT, REST = 1 << 15, 1 << 12
CHUNK = 4096
BLOCK_BYTES = 8 << 20
END = 0
#: Weight of the corpus-wide class shares in a state's emissions, in tokens.
PRIOR = 50.0
_COUNT_BITS = 36
_BLOCKS = "block long, docs array<long>, held binary, sizes binary, tokens binary, words binary, tails binary, trained binary"
_KNOWN = "docs array<long>, held binary, sizes binary, classes binary, base binary, rest binary, known binary"


@dataclass(frozen=True)
class Vocabulary:
    """Totals of the training tokens, the words with a class of their own, and the shared classes.

    own: sorted hashes; own_class, own_count: by the same places; rest_tokens, rest_words: of each shared class.
    """

    tokens: int
    kinds: int
    ends: int
    own: np.ndarray
    own_class: np.ndarray
    own_count: np.ndarray
    rest_tokens: np.ndarray
    rest_words: np.ndarray

    @property
    def classes(self) -> int:
        return 1 + len(self.own) + len(self.rest_tokens)

    def class_tokens(self) -> np.ndarray:
        own = np.zeros(len(self.own), np.int64)
        own[self.own_class - 1] = self.own_count
        return np.concatenate([[self.ends], own, self.rest_tokens])

    def shares(self) -> np.ndarray:
        """The probability of each class, none 0."""
        n = self.class_tokens() + 1.0
        return n / n.sum()


@dataclass(frozen=True)
class Model:
    """start: by state; move: state to state; emit: class by state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


# Blocks of texts


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, held, parts, size = [], [], [], 0
    for batch in batches:
        for piece in pieces(batch, "text"):
            data, offsets = utf8(piece.column(2))
            words = Words(data, offsets, NON_SPACE)
            letters, tail = NON_SPACE[data], np.zeros(len(words.starts), np.uint32)
            for back in (1, 2, 3):
                at = words.ends - back
                tail = (tail << np.uint32(8)) | np.where(at >= words.starts, letters[np.maximum(at, 0)], 0).astype(np.uint32)
            docs.append(piece.column(0))
            held.append(piece.column(1).fill_null(2).to_numpy(zero_copy_only=False).astype(np.uint8))
            parts.append((words.hashes, tail, words.counts().astype(np.int32)))
            size += len(data) + 64 * piece.num_rows
            if size >= BLOCK_BYTES:
                yield _block(docs, held, parts)
                docs, held, parts, size = [], [], [], 0
    if docs:
        yield _block(docs, held, parts)


def _block(docs: list, held: list, parts: list) -> pa.RecordBatch:
    hashes, tails, sizes = (np.concatenate([p[i] for p in parts]) for i in range(3))
    held = np.concatenate(held)
    words, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    learned = np.repeat(held == 0, sizes)
    # Frequent words get small numbers, whose high bytes are 0 and compress well.
    order = np.argsort(-np.bincount(which, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.int32)
    rank[order] = np.arange(len(words), dtype=np.int32)
    words, first, which = words[order], first[order], rank[which]
    trained = np.bincount(which[learned], minlength=len(words)).astype(np.int32)
    ids = pa.concat_arrays([d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d for d in docs])
    blobs = (held.tobytes(), sizes.tobytes(), _packed(which), words.tobytes(), (mix(tails[first].astype(np.uint64), 31) % np.uint64(REST)).astype(np.uint16).tobytes(), trained.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([b], pa.binary()) for b in blobs)], [c.split()[0] for c in _BLOCKS.split(", ")])


def _packed(numbers: np.ndarray) -> bytes:
    """Compressed integers, all first bytes before all second ones and so on."""
    return zstandard.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, place, word, tail, trained: the distinct words of each block."""
    for batch in batches:
        for block, w, tail, trained in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            words, tails, counts = np.frombuffer(w, np.int64), np.frombuffer(tail, np.uint16), np.frombuffer(trained, np.int32)
            for s in range(0, len(words), 50_000):
                e = min(s + 50_000, len(words))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(e - s, block)), pa.array(np.arange(s, e)), pa.array(words[s:e]), pa.array(tails[s:e].astype(np.int32)), pa.array(counts[s:e])], ["block", "place", "word", "tail", "trained"])


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """From (word, tail, n) rows of the training corpus, of which FREQUENT and REST rows at most come to the driver."""
    tokens, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    tokens += ends
    often = F.col("n") * FREQUENT >= tokens
    own = sorted(bounded_rows(counts.where(often).select("word", "n"), FREQUENT, "frequent words"), key=lambda r: (-r.n, r.word))
    words = np.array([r.word for r in own], np.int64).view(np.uint64)
    order = np.argsort(words)
    rest_tokens, rest_words = np.zeros(REST, np.int64), np.zeros(REST, np.int64)
    for r in counts.where(~often).groupBy("tail").agg(F.sum("n").alias("tokens"), F.count("*").alias("words")).collect():
        rest_tokens[r.tail], rest_words[r.tail] = r.tokens, r.words
    return Vocabulary(int(tokens), int(kinds) + (ends > 0), ends, words[order], order + 1, np.array([r.n for r in own], np.int64)[order], rest_tokens, rest_words)


def _known_batches(v: Vocabulary):
    """Blocks with the counts of their words to blocks of classes, and what each text's words add to its scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(k)[i] for k in range(8)]
                held, sizes = row[1].as_py(), np.frombuffer(row[2].as_py(), np.int32)
                local = _unpacked(row[3].as_py(), np.int32)
                words, tails = np.frombuffer(row[4].as_py(), np.uint64), np.frombuffer(row[5].as_py(), np.uint16).astype(np.int64)
                counts = np.zeros(len(words), np.int64)
                if row[6].is_valid:
                    sent = row[6].values.to_numpy(zero_copy_only=False)
                    counts[sent >> _COUNT_BITS] = sent & ((1 << _COUNT_BITS) - 1)
                at = np.minimum(np.searchsorted(v.own, words), max(len(v.own) - 1, 0))
                own = v.own[at] == words if len(v.own) else np.zeros(len(words), bool)
                of = (1 + len(v.own) + tails).astype(np.int64)
                inside = np.log10((counts + 1) / (v.rest_tokens[tails] + v.rest_words[tails] + 1))
                of[own], counts[own], inside[own] = v.own_class[at[own]], v.own_count[at[own]], 0.0
                total = np.log10(v.tokens + v.kinds + 1)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                base = np.bincount(doc, np.log10(counts + 1)[local], len(sizes)) + np.log10(v.ends + 1) - (sizes + 1) * total
                rest = np.bincount(doc, inside[local], len(sizes))
                known = np.bincount(doc[counts[local] > 0], minlength=len(sizes)) + (v.ends > 0)
                classes = np.full(len(local) + len(sizes), END, np.uint16)
                classes[np.arange(len(local)) + doc] = of[local]
                blobs = (held, (sizes + 1).tobytes(), _packed(classes), base.tobytes(), rest.tobytes(), known.astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([b], pa.binary()) for b in blobs)], [c.split()[0] for c in _KNOWN.split(", ")])

    return run


# Recursions


class Pieces:
    """Texts cut into pieces of at most `chunk` tokens, and the order in which all pieces move on, token by token.

    doc, place: the text of each piece and its place there; active: pieces that reach each step; steps: the token of each (step, piece).
    """

    def __init__(self, sizes: np.ndarray, chunk: int = CHUNK):
        n = -(-sizes // chunk)
        doc = np.repeat(np.arange(len(sizes)), n)
        place = ranges(np.zeros(len(n), np.int64), n)
        length = np.minimum(sizes[doc] - place * chunk, chunk)
        order = np.argsort(-length, kind="stable")
        self.doc, self.place, self.length = doc[order], place[order], length[order]
        self.start = (np.cumsum(sizes) - sizes)[self.doc] + self.place * chunk
        self.last = self.place == n[self.doc] - 1
        self.many = n[self.doc] > 1
        self._plan()

    def _plan(self) -> None:
        steps = int(self.length.max(initial=0))
        self.active = len(self.length) - np.cumsum(np.bincount(self.length, minlength=steps + 1))[:steps]
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        step = np.repeat(np.arange(steps), self.active)
        self.steps = self.start[np.arange(len(step)) - self.offset[step]] + step

    def part(self, chosen: np.ndarray) -> Pieces:
        """Only some of the pieces, in the same order."""
        out = object.__new__(Pieces)
        for name in ("doc", "place", "length", "start", "last", "many"):
            setattr(out, name, getattr(self, name)[chosen])
        out._plan()
        return out


def _transfers(model: Model, tokens: np.ndarray, cut_up: Pieces) -> np.ndarray:
    """For each piece, up to a factor, the probability of its tokens and of the state after it, given the state it starts in."""
    k = len(model.start)
    now = np.tile(np.eye(k), (len(cut_up.doc), 1, 1))
    done = now.copy()
    at = tokens[cut_up.steps]
    for t, m in enumerate(cut_up.active.tolist()):
        now = now[:m] * model.emit[at[cut_up.offset[t] : cut_up.offset[t] + m]][:, None, :]
        now /= now.max(axis=(1, 2), keepdims=True)
        now = (now.reshape(-1, k) @ model.move).reshape(m, k, k)
        done[:m] = now
    return done


def _ends(model: Model, tokens: np.ndarray, cut_up: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The state distribution with which each piece starts, and the likelihood of what follows it by the next piece's first state.

    The second is up to a factor, and 0 for last pieces, after which nothing follows.
    """
    k = len(model.start)
    before, after = np.tile(model.start, (len(cut_up.doc), 1)), np.zeros((len(cut_up.doc), k))
    own = np.flatnonzero(cut_up.many)
    if len(own):
        part = cut_up.part(own)
        moves = _transfers(model, tokens, part)
        rank = np.lexsort((part.doc, part.place))
        bounds = np.searchsorted(part.place[rank], np.arange(part.place.max() + 2))
        row = {}
        for j in range(len(bounds) - 1):  # the j-th pieces of all long texts
            here = rank[bounds[j] : bounds[j + 1]]
            if j:
                found = np.einsum("ni,nij->nj", before[own[row_of(row, part.doc[here])]], moves[row_of(row, part.doc[here])])
                before[own[here]] = found / found.sum(axis=1, keepdims=True)
            row = dict(zip(part.doc[here].tolist(), here.tolist(), strict=True))
        follows: dict[int, np.ndarray] = {}
        for j in range(len(bounds) - 2, -1, -1):
            here = rank[bounds[j] : bounds[j + 1]]
            ahead = np.array([follows.get(d, np.zeros(k)) for d in part.doc[here].tolist()]).reshape(-1, k)
            after[own[here]] = ahead
            ahead[part.last[here]] = 1.0
            found = np.einsum("nij,nj->ni", moves[here], ahead)
            follows |= dict(zip(part.doc[here].tolist(), found / found.sum(axis=1, keepdims=True), strict=True))
    return before, after


def row_of(row: dict[int, int], docs: np.ndarray) -> np.ndarray:
    return np.array([row[d] for d in docs.tolist()], np.int64)


def _forward(model: Model, tokens: np.ndarray, cut_up: Pieces, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State distributions after each token, in the order of `steps`, and the probability of each token given those before."""
    kind, k = model.emit.dtype, len(model.start)
    ahead, total = before.astype(kind), np.ones(k, kind)
    states, scale = np.empty((len(tokens), k), kind), np.empty(len(tokens), kind)
    for t, m in enumerate(cut_up.active.tolist()):
        s = slice(cut_up.offset[t], cut_up.offset[t] + m)
        now = states[s]
        np.multiply(ahead[:m], model.emit.take(tokens[s], axis=0), out=now)
        scale[s] = now @ total
        now /= scale[s, None]
        ahead = now @ model.move
    return states, scale


def likelihoods(model: Model, tokens: np.ndarray, sizes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """log10 of the probability of each text's classes."""
    cut_up = Pieces(sizes, chunk)
    before, _ = _ends(model, tokens, cut_up)
    _, scale = _forward(model, tokens[cut_up.steps], cut_up, before)
    doc = cut_up.doc[np.arange(len(tokens)) - np.repeat(cut_up.offset[:-1], cut_up.active)]
    return np.bincount(doc, np.log10(scale), len(sizes))


def expectations(model: Model, tokens: np.ndarray, sizes: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected emissions (class by state), transitions, first states, and the sum of log10 likelihoods."""
    cut_up, k = Pieces(sizes, chunk), len(model.start)
    before, after = _ends(model, tokens, cut_up)
    kind = model.emit.dtype
    at = tokens[cut_up.steps]
    states, scale = _forward(model, at, cut_up, before)
    follow, moves, total = after.astype(kind), np.zeros((k, k)), np.ones(k, kind)
    back, reached = np.ascontiguousarray(model.move.T), 0
    for t in range(len(cut_up.active) - 1, -1, -1):
        m = int(cut_up.active[t])
        s = slice(cut_up.offset[t], cut_up.offset[t] + m)
        now, ahead = states[s], follow[:m]
        rest = ahead @ back
        rest[reached:][cut_up.last[reached:m]] = 1.0  # texts that end here
        reached = m
        both = now * rest
        weight = both @ total
        moves += (now / weight[:, None]).T @ ahead
        np.divide(both, weight[:, None], out=now)
        ahead = rest * model.emit.take(at[s], axis=0)
        ahead /= (ahead @ total)[:, None]
        follow[:m] = ahead
    emissions = np.stack([np.bincount(at, states[:, i], len(model.emit)) for i in range(k)], axis=1)
    first = states[: cut_up.active[0]][cut_up.place == 0].sum(axis=0) if len(at) else np.zeros(k)
    return emissions, moves * model.move, first, float(np.log10(scale).sum(dtype=np.float64))


# Training


def _sum_batches(model: Model):
    """Sums of a task's training texts: a row for each class, then transitions, first states and the likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, k = model.emit.shape
        total = np.zeros((classes + k + 2, k))
        for batch in batches:
            for held, sizes, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                sizes = np.frombuffer(sizes, np.int32).astype(np.int64)
                tokens = _unpacked(packed, np.uint16)
                learned = np.frombuffer(held, np.uint8) == 0
                tokens = tokens[np.repeat(learned, sizes)]
                if learned.any():
                    emissions, moves, first, score = expectations(model, tokens.astype(np.int64), sizes[learned])
                    total[:classes] += emissions
                    total[classes : classes + k] += moves
                    total[classes + k] += first
                    total[classes + k + 1, 0] += score
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[at, i]) for i in range(k))], ["cell", *(f"s{i}" for i in range(k))])

    return run


def first_model(shares: np.ndarray, states: int, seed: int = 11) -> Model:
    """States that stay, with emissions spread about the corpus-wide shares."""
    emit = shares[:, None] * np.exp(0.5 * np.random.default_rng(seed).standard_normal((len(shares), states)))
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def improved(sums: np.ndarray, shares: np.ndarray) -> Model:
    """The model of highest likelihood for expected sums, each state with PRIOR tokens of the corpus-wide shares."""
    classes, k = len(shares), sums.shape[1]
    emit, move, start = sums[:classes] + PRIOR * shares[:, None], sums[classes : classes + k] + 1, sums[classes + k] + 1
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def train(known: DataFrame, v: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The model after some rounds over the training texts, and the log10 likelihood of their classes before each."""
    shares = v.shares()
    model, curve = first_model(shares, states), []
    schema = ", ".join(["cell long", *(f"s{i} double" for i in range(states))])
    for _ in range(rounds):
        light = Model(*(x.astype(np.float32) for x in (model.start, model.move, model.emit)))
        rows = map_batches(known.select("held", "sizes", "classes"), _sum_batches(light), schema)
        found = rows.groupBy("cell").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(states))).toArrow()
        sums = np.zeros((v.classes + states + 2, states))
        sums[found.column(0).to_numpy()] = np.stack([found.column(i + 1).to_numpy() for i in range(states)], axis=1)
        curve.append(float(sums[-1, 0]))
        model = improved(sums, shares)
    return model, curve


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held, sizes, packed, base, rest, known = (batch.column(k)[i].as_py() for k in range(1, 7))
                sizes, held = np.frombuffer(sizes, np.int32), np.frombuffer(held, np.uint8)
                tokens = _unpacked(packed, np.uint16).astype(np.int64)
                score = likelihoods(model, tokens, sizes.astype(np.int64)) + np.frombuffer(rest)
                columns = [batch.column(0)[i].values, pa.array(held == 1, mask=held == 2), pa.array(sizes.astype(np.int64)), pa.array(np.frombuffer(known, np.int32).astype(np.int64)), pa.array(np.frombuffer(base)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def encoded(documents: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """Blocks of class sequences of `documents` (doc_id, held, text), and the vocabulary of those that are not held."""
    blocks = map_batches(documents.select("doc_id", F.col("held").cast("int").alias("held"), "text"), _blocks, _BLOCKS)
    blocks = cut(blocks.withColumn("block", F.monotonically_increasing_id()))
    words = map_batches(blocks.select("block", "words", "tails", "trained"), _word_rows, "block long, place long, word long, tail int, trained int")
    counts = cut(words.where("trained > 0").groupBy("word").agg(F.min("tail").alias("tail"), F.sum("trained").alias("n")))
    ends = documents.where("NOT held").count()
    v = vocabulary(counts, ends)
    rare = counts.where(F.col("n") * FREQUENT < v.tokens).select(F.col("word").alias("of"), "n")
    sent = words.select("block", "place", "word").join(rare, F.col("word") == F.col("of")).select(F.col("block").alias("of_block"), (F.shiftleft("place", _COUNT_BITS) + F.col("n")).alias("sent"))
    sent = sent.groupBy("of_block").agg(F.collect_list("sent").alias("sent"))  # the distinct words of one block
    joined = blocks.join(sent, blocks.block == sent.of_block, "left").select("docs", "held", "sizes", "tokens", "words", "tails", "sent", "block")
    return cut(map_batches(joined, _known_batches(v), _KNOWN)), v


def scored(documents: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of all `documents` (doc_id, held, text).

    The rows for which `held` is false are learned from; held_out is `held`.
    """
    known, v = encoded(documents)
    model, _ = train(known, v, states, rounds)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    found = map_batches(known, _score_batches(model), schema)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op11_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id) mod 7 is not 2."""
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", 7) == 2).alias("held")))
