r"""Chat formatting at the token level: segments encoded one by one, reserved ids spliced in, masks from prefix sums.

A turn reads ``<turn>role<says>text</turn>``. The three control strings are single reserved ids behind the vocabulary's
own; role and text are encoded each by itself as ordinary text, so that no token spans a border and no content can
yield a reserved id. A formatted conversation is the array of its ids beside a loss mask: +1 where a trained text
starts, -1 behind its end, summed up along the ids. The mask covers the texts of the trained roles and nothing else.

A control string inside a role or text gets a backslash behind its "<", and one that already has backslashes there gets
one more; reading back takes one away. Formatted content thus holds no control string, also as plain text.

Conversations come in parts: all turns of one in one part, but for those of more than ``HOT_TURNS`` turns, which are
put in order over range partitions and cut into blocks of that many turns. No task holds more than a part, however many
rows one conv_id has. Parts are rows (conv_id, part, parts, n_turns, token_ids, loss_mask).

Turns are ordered by turn, null first, equal ones by role and text. Null role and text are empty ones; an empty
segment has no token. Rows with a null conv_id are one conversation of that id. Repeated rows are turns of their own.
Long segments are encoded in slices. An empty table has no conversations. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmill.lineage import cut_lineage
from riskmill.llm.common import global_index, match, small_side

TURN, SAYS, END = "<turn>", "<says>", "</turn>"
CONTROLS = (TURN, SAYS, END)
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public byte-level vocabulary cuts texts before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TRAINED = ("assistant",)
HOT_TURNS = 4096
SLICE = 1 << 15

_OUTSIDE = re.compile(r"<(\\*)(turn>|says>|/turn>)")
_INSIDE = re.compile(r"<\\(\\*)(turn>|says>|/turn>)")


def escape(text: str) -> str:
    return _OUTSIDE.sub(r"<\\\1\2", text) if "<" in text else text


def unescape(text: str) -> str:
    return _INSIDE.sub(r"<\1\2", text) if "<" in text else text


@dataclass
class ChatVocabulary:
    """Token bytes by id, the file's own; the reserved ids follow."""

    spelled: list[bytes]

    @property
    def reserved(self) -> dict[str, int]:
        return {control: len(self.spelled) + k for k, control in enumerate(CONTROLS)}

    def encoder(self):
        import tiktoken
        return tiktoken.Encoding("chat", pat_str=WORDS, mergeable_ranks={s: i for i, s in enumerate(self.spelled)}, special_tokens={})


def load_vocabulary(path: str = DEFAULT_RANKS) -> ChatVocabulary:
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return ChatVocabulary([ranks[i] for i in range(len(ranks))])


def slices(text: str) -> Iterator[str]:
    """Pieces of bounded length, cut in front of a space where there is one in the second half."""
    while len(text) > SLICE:
        cut = text.rfind(" ", SLICE // 2, SLICE)
        cut = cut if cut > 0 else SLICE
        yield text[:cut]
        text = text[cut:]
    yield text


def loss_mask(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True from each start up to its end."""
    steps = np.zeros(length + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


class _Formatter:
    """Streams turns sorted by conversation and part; one row per part."""

    def __init__(self, vocabulary: ChatVocabulary, trained: tuple[str, ...]):
        self.vocabulary, self.trained = vocabulary, frozenset(trained)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = self.vocabulary.encoder()
        turn, says, end = self.vocabulary.reserved.values()

        def encode(text: str) -> np.ndarray:
            return np.array([i for piece in slices(escape(text)) for i in encoder.encode_ordinary(piece)], np.int32)
        key, pieces, starts, ends, length, turns = None, [], [], [], 0, 0
        done: list[tuple] = []
        ready = 0
        for batch in batches:
            for conv_id, part, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if key != (conv_id, part):
                    if key is not None:
                        done.append((*key, turns, np.concatenate(pieces), starts, ends))
                        ready += length
                        if ready > 1 << 20:
                            yield self._rows(done)
                            done, ready = [], 0
                    key, pieces, starts, ends, length, turns = (conv_id, part), [], [], [], 0, 0
                head, body = encode(role), encode(text)
                pieces += [np.array([turn], np.int32), head, np.array([says], np.int32), body, np.array([end], np.int32)]
                if role in self.trained:
                    starts.append(length + 2 + len(head))
                    ends.append(length + 2 + len(head) + len(body))
                length += 3 + len(head) + len(body)
                turns += 1
        if key is not None:
            done.append((*key, turns, np.concatenate(pieces), starts, ends))
        yield self._rows(done)

    @staticmethod
    def _rows(done: list[tuple]) -> pa.RecordBatch:
        offsets = np.zeros(len(done) + 1, np.int32)
        np.cumsum([len(d[3]) for d in done], out=offsets[1:])
        ids = np.concatenate([d[3] for d in done]) if done else np.zeros(0, np.int32)
        first = [(np.array(d[4 + k], np.int64) + at) for k in (0, 1) for d, at in zip(done, offsets[:-1])]
        some = len(done)
        starts = np.concatenate(first[:some]) if done else np.zeros(0, np.int64)
        ends = np.concatenate(first[some:]) if done else np.zeros(0, np.int64)
        mask = loss_mask(len(ids), starts, ends)
        return pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
             pa.array([d[2] for d in done], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
             pa.ListArray.from_arrays(offsets, pa.array(mask, pa.bool_()))],
            ["conv_id", "part", "n_turns", "token_ids", "loss_mask"])


def format_conversations(rows: DataFrame, trained: tuple[str, ...] = TRAINED, hot_turns: int = HOT_TURNS,
                         ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(conv_id, part, parts, n_turns, token_ids, loss_mask) for rows (conv_id, turn, role, text)."""
    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    formatter = _Formatter(load_vocabulary(ranks), trained)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]

    def assembled(dealt: DataFrame) -> DataFrame:
        placed = dealt.repartition("conv_id", "part").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", *order[1:])
        return placed.select("conv_id", "part", "role", "text").mapInArrow(
            formatter, "conv_id bigint, part bigint, n_turns bigint, token_ids array<int>, loss_mask array<boolean>")
    hot = cut_lineage(turns.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > hot_turns).select("conv_id"))
    if hot.isEmpty():
        return assembled(turns.withColumn("part", F.lit(0).cast("bigint"))).withColumn("parts", F.lit(1).cast("bigint"))
    hot = small_side(hot)
    usual = assembled(match(turns, hot, ["conv_id"], "left_anti").withColumn("part", F.lit(0).cast("bigint")))
    ordered = cut_lineage(global_index(match(turns, hot, ["conv_id"], "left_semi"), *order, name="at"))
    blocks = ordered.withColumn("part", F.floor(F.col("at") / hot_turns))
    # Blocks count on over all hot conversations; each one's are numbered from its first.
    spans = ordered.groupBy("conv_id").agg(F.floor(F.min("at") / hot_turns).alias("low"), F.floor(F.max("at") / hot_turns).alias("high"))
    cut = assembled(blocks)
    numbered = match(cut, small_side(spans), ["conv_id"], "inner").withColumn("part", F.col("part") - F.col("low")) \
        .withColumn("parts", F.col("high") - F.col("low") + 1)
    names = ["conv_id", "part", "parts", "n_turns", "token_ids", "loss_mask"]
    return usual.withColumn("parts", F.lit(1).cast("bigint")).select(*names).unionByName(numbered.select(*names))


class _Reader:
    """Streams parts sorted by conversation and part: the turns and the trained text that their ids spell, as digests."""

    def __init__(self, vocabulary: ChatVocabulary):
        self.vocabulary = vocabulary

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = self.vocabulary.spelled + [c.encode() for c in CONTROLS]
        key, row = None, None
        for batch in batches:
            done = []
            for conv_id, ids, mask in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if row is None or key != conv_id:
                    if row is not None:
                        done.append(row.values())
                    key, row = conv_id, _Read(conv_id)
                row.add(ids.values.to_numpy(), mask.values.to_numpy(zero_copy_only=False), spelled)
            yield self._rows(done)
        if row is not None:
            yield self._rows([row.values()])

    @staticmethod
    def _rows(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)], names)


class _Read:
    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.trained, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray, mask: np.ndarray, spelled: list[bytes]) -> None:
        turn, says, end = (len(spelled) - len(CONTROLS) + k for k in range(3))
        for role_at, text_at, stop in zip(*(np.flatnonzero(ids == control) for control in (turn, says, end))):
            role = b"".join([spelled[i] for i in ids[role_at + 1:text_at].tolist()]).decode()
            text = b"".join([spelled[i] for i in ids[text_at + 1:stop].tolist()]).decode()
            self.chars += len(role) + len(text) + sum(map(len, CONTROLS))
            self.all.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            self.turns += 1
        edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
        for start, stop in zip(edges[::2], edges[1::2]):
            text = unescape(b"".join([spelled[i] for i in ids[start:stop].tolist()]).decode())
            self.trained += len(text)
            self.loss.update(text.encode())

    def values(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.trained, self.loss.hexdigest(), self.chars


def read_back(parts: DataFrame, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """What the ids and masks say: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    A digest runs over a whole conversation, so the parts of one are streamed by one task, one part in memory.
    """
    reader = _Reader(load_vocabulary(ranks))
    kinds = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    columns = ["conv_id", "token_ids", "loss_mask"]
    whole = parts.where("parts = 1").select(*columns).mapInArrow(reader, kinds)
    cut = parts.where("parts > 1").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part")
    return whole.unionByName(cut.select(*columns).mapInArrow(reader, kinds))
