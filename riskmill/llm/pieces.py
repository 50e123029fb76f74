"""A SentencePiece vocabulary as a unigram model, and the cuts at which texts may be encoded in parts.

The model file holds pieces of a merge-trained vocabulary, whose scores are merge ranks and no probabilities. Zipf's
law turns ranks into them: the piece of rank r has the log probability -ln(r + 1) - ln(H), H being the sum of all
1 / (r + 1). A text is encoded as the pieces with the largest sum, at equal sums with the longest last piece. A
character that no piece holds becomes the pieces of its UTF-8 bytes, at the unknown penalty of unigram models. Nothing
is trained here; pieces and ids are those of the file.

A space is written as U+2581, with one more in front of the text. No piece has U+2581 after another character, and a
character outside the vocabulary stands alone, so texts can be cut before runs of spaces and around such characters
without changing the best sum. A U+2581 of the text itself counts as outside, so decoding returns it unchanged.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# Bytes that a task spends on remembering words, and of text that it works on at once.
KEPT_BYTES = 1 << 27
WORD_OVERHEAD = 200
BYTES_AT_ONCE = 1 << 22
WORDS_AT_ONCE = 1 << 16


@dataclass
class Vocabulary:
    """Pieces that texts can contain with ids and scores, and the ids of the 256 byte pieces. Read on the driver."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: tuple[int, ...]
    spelled: tuple[bytes, ...]
    longest: int = 0
    unknown: float = 0.0
    cuts: str = field(default="", repr=False)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.ids))
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        inside = "".join(re.escape(c) for c in sorted({c for piece in self.ids for c in piece} - {SPACE_MARK}))
        self.cuts = f" *[{inside}]+| +|[^ ]"
        self.known = frozenset(c for piece in self.ids for c in piece) - {SPACE_MARK}

    def pre_tokens(self, text: str) -> list[str]:
        """The text in parts that can be encoded one by one, spaces still as spaces; an empty text has none."""
        return _pattern(self.cuts).findall(" " + text) if text else []

    def pre_token_runs(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text of any length, so many at a time."""
        found = (match.group() for match in _pattern(self.cuts).finditer(" " + text)) if text else iter(())
        while run := list(islice(found, WORDS_AT_ONCE)):
            yield run

    def is_outside(self, part: str) -> bool:
        return len(part) == 1 and part != " " and part not in self.known

    def best_path(self, part: str) -> list[int]:
        """One part's piece ids by plain forward scores, position by position."""
        if self.is_outside(part):
            return [self.byte_ids[b] for b in part.encode("utf-8", "surrogatepass")]
        marked = part.replace(" ", SPACE_MARK)
        best, back = [0.0], [0]
        for end in range(1, len(marked) + 1):
            top, at = -math.inf, end - 1
            for start in range(max(0, end - self.longest), end):
                score = self.scores.get(marked[start:end])
                if score is None and start == end - 1:
                    score = self.unknown
                if score is not None and best[start] + score > top:
                    top, at = best[start] + score, start
            best.append(top)
            back.append(at)
        out, end = [], len(marked)
        while end:
            piece = marked[back[end]:end]
            out.append([self.ids[piece]] if piece in self.ids
                       else [self.byte_ids[b] for b in piece.replace(SPACE_MARK, " ").encode("utf-8", "surrogatepass")])
            end = back[end]
        return [i for ids in reversed(out) for i in ids]


def bounded_slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of at most ``BYTES_AT_ONCE`` of text; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + BYTES_AT_ONCE, "right")))
        yield batch.slice(at, stop - at)
        at = stop


class Remembered(dict):
    """What was found for words, forgotten as a whole once the words exceed the bytes allowed."""

    held = 0

    def make_room(self, new: set[str]) -> bool:
        """Whether the memory was emptied for the new words."""
        size = sum(map(len, new)) + WORD_OVERHEAD * len(new)
        emptied = self.held + size > KEPT_BYTES and bool(self)
        if emptied:
            self.clear()
            self.held = 0
        self.held += size
        return emptied


_PATTERNS: dict[str, re.Pattern] = {}


def _pattern(source: str) -> re.Pattern:
    """Compiled once in each Python process; the class has thousands of characters."""
    if source not in _PATTERNS:
        _PATTERNS[source] = re.compile(source, re.S)
    return _PATTERNS[source]


def load_vocabulary(path: str = DEFAULT_MODEL) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
    whole = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
    pieces = {model.id_to_piece(i): (i, -math.log(r + 1) - whole) for r, i in enumerate(ranked)}
    byte_ids = tuple(model.piece_to_id(f"<0x{b:02X}>") for b in range(256))
    spelled = [b""] * size
    for piece, (i, _) in pieces.items():
        spelled[i] = piece.replace(SPACE_MARK, " ").encode()
    for b, i in enumerate(byte_ids):
        spelled[i] = bytes([b])
    return Vocabulary({p: i for p, (i, _) in pieces.items()}, {p: s for p, (_, s) in pieces.items()}, byte_ids, tuple(spelled))
