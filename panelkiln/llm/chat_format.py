"""Chat formatting into budgeted windows.

A turn is written as `### role: text</turn>` and a line break. Inside roles and texts a backslash stands before each
backslash, `###`, `</turn>` and (in roles) colon, so that a window can be read back without loss.

Running sums of turn tokens choose the windows of a conversation. A window holds the leading system turn, then the last
turns before it as far as they have at most `history` tokens, then new turns; all of them together have at most `budget`
tokens. History gives way to the first new turn, and so does the system turn if both together would pass the budget. Only a
turn that alone has more than `budget` tokens passes it, in a window of its own. The loss mask covers the texts of
assistant turns where they are new; repeated turns are masked, so that each assistant text counts once. Tokens are
counted over whole written turns, by a BPE tokenizer file (see bpe_codec) or, without one, as a fourth of their bytes.

A conversation's turns pass through one task in order; the task holds a window and a history of them, not the
conversation. Null texts and roles count as empty. Turns follow the column turn (nulls first), ties role and text.
Repeated rows are turns of their own. Rows with a null conv_id are one conversation without id. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.llm import bpe_codec
from panelkiln.llm.sparkops import map_batches, table
from panelkiln.llm.textops import pieces

BUDGET, HISTORY = 1024, 256
TURN_BEGIN, ROLE_END, TURN_END = "### ", ": ", "</turn>\n"
_ESCAPE = re.compile(r"(\\|###|</turn>)")
_ESCAPE_ROLE = re.compile(r"(\\|###|</turn>|:)")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|:)")
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text) if "\\" in text else text


def written(role: str, text: str) -> tuple[str, str]:
    """What stands before a turn's text, and the text, escaped."""
    return TURN_BEGIN + _ESCAPE_ROLE.sub(r"\\\1", role) + ROLE_END, _ESCAPE.sub(r"\\\1", text)


class _Conversation:
    """The open window of a conversation. Turns: head, body, tokens, whether the body is learned."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history, self.window = budget, history, 0
        self.system, self.first = None, True
        self.before: deque = deque()  # the last turns, of at most `history` tokens
        self.before_tokens, self.tokens = 0, 0
        self.repeated: list = []
        self.new: list = []

    def add(self, turn: tuple, role: str) -> dict | None:
        """The window that this turn closes, if it does."""
        closed = None
        if self.new and self.tokens + turn[2] > self.budget:
            closed = self.close()
        if not self.new:
            self._open(turn[2])
        self.new.append(turn)
        self.tokens += turn[2]
        if self.first and role == "system":
            self.system = turn
        else:
            self.before.append(turn)
            self.before_tokens += turn[2]
            while self.before_tokens > self.history:
                self.before_tokens -= self.before.popleft()[2]
        self.first = False
        return closed

    def _open(self, tokens: int) -> None:
        self.repeated, self.tokens = [], 0
        if self.system and self.system[2] + tokens <= self.budget:
            self.repeated, self.tokens = [self.system], self.system[2]
        kept, room = [], self.budget - self.tokens - tokens
        for turn in reversed(self.before):
            if turn[2] > room:
                break
            kept.append(turn)
            room -= turn[2]
            self.tokens += turn[2]
        self.repeated += reversed(kept)

    def close(self) -> dict:
        parts, loss, size = [], [], 0
        for k, (head, body, _, learn) in enumerate([*self.repeated, *self.new]):
            start = size + len(head)
            size = start + len(body) + len(TURN_END)
            parts += [head, body, TURN_END]
            if learn and k >= len(self.repeated):
                loss.append({"start": start, "stop": start + len(body)})
        row = {"window": self.window, "formatted": "".join(parts), "tokens": self.tokens, "repeated": len(self.repeated), "loss": loss}
        self.window += 1
        self.new = []
        return row


def _window_batches(budget: int, history: int, tokenizer: str | None):
    kinds = {"conv_id": pa.int64(), "window": pa.int64(), "formatted": pa.string(), "tokens": pa.int64(), "repeated": pa.int64(), "loss": _LOSS}

    def rows(out: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in kinds.items()], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe_codec.load(tokenizer) if tokenizer else None
        now, talk = None, None
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids, roles, texts = (piece.column(i).to_pylist() for i in range(3))
                turns = [written(role, text) for role, text in zip(roles, texts, strict=True)]
                whole = [head + body + TURN_END for head, body in turns]
                if codec:
                    bounds = codec.encode(whole)[1]
                    tokens = (bounds[1:] - bounds[:-1]).tolist()
                else:
                    tokens = [-(-len(x.encode()) // 4) for x in whole]
                out = []
                for conv, role, (head, body), n in zip(ids, roles, turns, tokens, strict=True):
                    if talk is None or conv != now:
                        if talk is not None:
                            out.append(talk.close() | {"conv_id": now})
                        now, talk = conv, _Conversation(budget, history)
                    if closed := talk.add((head, body, n, role == "assistant"), role):
                        out.append(closed | {"conv_id": now})
                yield rows(out)
        if talk is not None:
            yield rows([talk.close() | {"conv_id": now}])

    return run


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None) -> DataFrame:
    """conv_id, window, formatted, tokens, repeated (turns in front that are context only), loss (array of start, stop).

    One row for each window of `conversations` (conv_id, turn, role, text), in order within the partition that holds its
    conversation. start and stop count code points of formatted.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be less than the budget")
    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))]
    ordered = conversations.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    schema = "conv_id long, window long, formatted string, tokens long, repeated long, loss array<struct<start: long, stop: long>>"
    return map_batches(ordered.select("conv_id", "role", "text"), _window_batches(budget, history, tokenizer), schema)


def _mark(text: str, mark: str, at: int) -> int:
    """The first place of a mark from `at` on that no backslash escapes."""
    while True:
        at = text.find(mark, at)
        if at < 0:
            raise ValueError("not a formatted window")
        first = at
        while first and text[first - 1] == "\\":
            first -= 1
        if (at - first) % 2 == 0:
            return at
        at += len(mark)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a window."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(TURN_BEGIN, at):
            raise ValueError("not a formatted window")
        role_end = _mark(formatted, ROLE_END, at + len(TURN_BEGIN))
        text_end = _mark(formatted, TURN_END, role_end + len(ROLE_END))
        turns.append((unescape(formatted[at + len(TURN_BEGIN) : role_end]), unescape(formatted[role_end + len(ROLE_END) : text_end])))
        at = text_end + len(TURN_END)
    return turns


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation; its windows come in order, and only running digests are held."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    now, state = None, None

    def row() -> tuple:
        return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    for batch in batches:
        for piece in pieces(batch, "formatted"):
            out = []
            for conv, text, repeated, loss in zip(*(piece.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        out.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_back(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    learned = unescape(text[span["start"] : span["stop"]])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row(), kinds, strict=True)], names)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What the windows of each conversation hold, read back from them. formatted: as `windows` gives it, in its order."""
    rows = formatted.select("conv_id", "formatted", "repeated", "loss")
    return map_batches(rows, _digest_batches, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, formatted and read back."""
    import public_tokenizers

    said = "\\### Assistant: </turn> ok"
    odd = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return conversation_digests(windows(own.unionByName(odd), tokenizer=public_tokenizers.path("word_bpe_49k.json")))
