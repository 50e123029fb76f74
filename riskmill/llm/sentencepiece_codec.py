"""SentencePiece encoding and decoding by batched Viterbi in numpy.

A batch's distinct pre-tokens of one length advance together, character by character. Polynomial hashes of all
substrings that end at the character probe the sorted keys of the pieces of that length; the best sum over all of them
is one vectorised maximum, whose argument is the backpointer. Following the backpointers gives each word's pieces.
A word is accepted when its pieces spell it; a hash collision would show there, and the plain path is taken.

Decoding gathers the bytes of the pieces and takes away the space that encoding put in front.

A batch is worked through in slices of bounded bytes, a longer text by runs of its pre-tokens, so that memory depends on
neither the batch nor the longest text beyond the text itself. Encodings of words are remembered up to a bound in bytes,
after which the memory starts anew. Encoding and decoding in one pass share one Python worker. Null texts have a null encoding and empty ones an empty one, and decoding returns
them so: decoding an encoding gives the text back, byte by byte. Further columns stay; a column named like the result
is replaced. Repeated rows are encoded each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskmill.llm.pieces import (BYTES_AT_ONCE, DEFAULT_MODEL, SPACE_MARK, Remembered, Vocabulary, bounded_slices,
                                 load_vocabulary)
from riskmill.llm.token_counts import schema_with, with_column

BASE = np.uint64(0x9E3779B97F4A7C15)
# Longer words are few; they take the plain path instead of one batch for each length.
LONGEST_BATCHED = 48
WORDS_AT_ONCE = 1 << 14
IDS_AT_ONCE = 1 << 16


class Speller:
    """The bytes of all pieces in a row, from which those of any ids are gathered."""

    def __init__(self, spelled: tuple[bytes, ...]):
        self.sizes = np.array([len(s) for s in spelled], np.int32)
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)

    def spell(self, ids: np.ndarray) -> bytes:
        parts = []
        for at in range(0, len(ids), IDS_AT_ONCE):
            some = ids[at:at + IDS_AT_ONCE]
            long = self.sizes[some]
            first = np.cumsum(long, dtype=np.int32) - long
            parts.append(self.letters[np.arange(int(long.sum()), dtype=np.int32) + np.repeat(self.starts[some] - first, long)].tobytes())
        return b"".join(parts)


def _cut(table: np.ndarray) -> list[bytes]:
    """The ids of each row, -2 left out, as bytes."""
    kept = table != -2
    flat = table[kept].tobytes()
    ends = 4 * np.cumsum(kept.sum(axis=1))
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


class PieceKeys:
    """Pieces of each length as sorted hashes, with their scores and ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.speller = vocabulary, Speller(vocabulary.spelled)
        by_length: dict[int, list[str]] = {}
        for piece in vocabulary.ids:
            by_length.setdefault(len(piece), []).append(piece)
        self.powers = [np.uint64(1)]
        with np.errstate(over="ignore"):
            for _ in range(vocabulary.longest):
                self.powers.append(self.powers[-1] * BASE)
        self.tables = {}
        for length, pieces in by_length.items():
            keys = prefix_hashes(characters(pieces, length))[-1]
            order = np.argsort(keys)
            self.tables[length] = (keys[order], np.array([vocabulary.scores[p] for p in pieces])[order],
                                   np.array([vocabulary.ids[p] for p in pieces], np.int32)[order])

    def encode_words(self, words: list[str]) -> list[bytes]:
        """int32 ids of words of one length that hold no outside character."""
        marked = [w.replace(" ", SPACE_MARK) for w in words]
        length, n = len(marked[0]), len(marked)
        hashes = prefix_hashes(characters(marked, length))
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0.0
        step = np.zeros((length + 1, n), np.int8)
        piece = np.full((length + 1, n), -1, np.int32)
        for end in range(1, length + 1):
            # From the longest piece down: an equal sum doesn't replace a longer one.
            for size in range(min(end, self.vocabulary.longest), 0, -1):
                if size not in self.tables:
                    continue
                keys, scores, ids = self.tables[size]
                with np.errstate(over="ignore"):
                    wanted = hashes[end] - hashes[end - size] * self.powers[size]
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                total = np.where(keys[at] == wanted, best[end - size] + scores[at], -np.inf)
                better = total > best[end]
                best[end] = np.where(better, total, best[end])
                step[end] = np.where(better, size, step[end])
                piece[end] = np.where(better, ids[at], piece[end])
            alone = best[end - 1] + self.vocabulary.unknown
            better = alone > best[end]
            best[end] = np.where(better, alone, best[end])
            step[end] = np.where(better, 1, step[end])
            piece[end] = np.where(better, -1, piece[end])
        # Walk back all words at once: one row a step, -2 where a word has ended.
        rows, end, lane = [], np.full(n, length), np.arange(n)
        while end.any():
            rows.append(np.where(end > 0, piece[end, lane], -2))
            end = end - step[end, lane]
        table = np.array(rows[::-1], np.int32).T
        strange = (table == -1).any(axis=1)
        if not strange.any() and self._spell(table, words):
            return _cut(table)
        plain = np.flatnonzero(strange | ~self._spells_each(table, words))
        out = _cut(table)
        for place in plain.tolist():
            out[place] = np.array(self.vocabulary.best_path(words[place]), np.int32).tobytes()
        return out

    def _spell(self, table: np.ndarray, words: list[str]) -> bool:
        """Whether all pieces together spell all words together, each word as many bytes as it has."""
        ids = table[table != -2]
        points = characters(words, len(words[0]))
        wanted = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).sum(axis=0)
        sizes = np.where(table == -2, 0, self.speller.sizes[np.maximum(table, 0)]).sum(axis=1)
        return bool((sizes == wanted).all()) and self.speller.spell(ids) == "".join(words).encode("utf-8", "surrogatepass")

    def _spells_each(self, table: np.ndarray, words: list[str]) -> np.ndarray:
        spelled = self.vocabulary.spelled
        return np.array([b"".join([spelled[i] for i in ids[ids >= 0].tolist()]) == word.encode("utf-8", "surrogatepass")
                         for word, ids in zip(words, table)])

    def encode_new(self, words: set[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        lengths: dict[int, list[str]] = {}
        for word in words:
            if len(word) > LONGEST_BATCHED or self.vocabulary.is_outside(word):
                out[word] = np.array(self.vocabulary.best_path(word), np.int32).tobytes()
            else:
                lengths.setdefault(len(word), []).append(word)
        for group in lengths.values():
            for at in range(0, len(group), WORDS_AT_ONCE):
                some = group[at:at + WORDS_AT_ONCE]
                out.update(zip(some, self.encode_words(some)))
        return out


def characters(words: list[str], length: int) -> np.ndarray:
    """Code points, one row a position."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.ascontiguousarray(flat.reshape(len(words), length).T).astype(np.uint64)


def prefix_hashes(points: np.ndarray) -> list[np.ndarray]:
    hashes = [np.zeros(points.shape[1], np.uint64)]
    with np.errstate(over="ignore"):
        for row in points:
            hashes.append(hashes[-1] * BASE + row + np.uint64(1))
    return hashes


class _Encoder:
    def __init__(self, vocabulary: Vocabulary, text: str, name: str):
        self.vocabulary, self.text, self.name = vocabulary, text, name

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, known = PieceKeys(self.vocabulary), Remembered()
        for batch in batches:
            for some in bounded_slices(batch, self.text):
                texts = some.column(self.text).to_pylist()
                if len(texts) == 1 and len(texts[0] or "") > BYTES_AT_ONCE // 4:
                    encoded = [b"".join([ids for run in self.vocabulary.pre_token_runs(texts[0])
                                         for ids in self._encoded([run], keys, known)])]
                else:
                    encoded = self._encoded([self.vocabulary.pre_tokens(t or "") for t in texts], keys, known)
                offsets = np.zeros(len(texts) + 1, np.int32)
                np.cumsum([len(e) // 4 for e in encoded], out=offsets[1:])
                none = pa.array([t is None for t in texts], pa.bool_())
                values = pa.array(np.frombuffer(b"".join(encoded), np.int32))
                yield with_column(some, self.name, pa.ListArray.from_arrays(pa.array(offsets), values, mask=none))

    @staticmethod
    def _encoded(parts: list[list[str]], keys: PieceKeys, known: Remembered) -> list[bytes]:
        every = set().union(*parts)
        new = every.difference(known)
        if known.make_room(new):
            new = every
        known.update(keys.encode_new(new))
        return [b"".join(map(known.__getitem__, words)) for words in parts]


class _Decoder:
    def __init__(self, spelled: tuple[bytes, ...], ids: str, name: str):
        self.spelled, self.ids, self.name = spelled, ids, name

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(self.spelled)
        for batch in batches:
            column = batch.column(self.ids)
            texts: list[str | None] = []
            for row in range(len(column)):
                ids = column[row].values
                if ids is None:
                    texts.append(None)
                    continue
                texts.append(speller.spell(ids.to_numpy(zero_copy_only=False))[1:].decode("utf-8", "replace"))
            yield with_column(batch, self.name, pa.array(texts, pa.string()))


class _Both:
    """One worker for both directions: each slice is decoded as soon as it is encoded."""

    def __init__(self, encoder: _Encoder, decoder: _Decoder):
        self.encoder, self.decoder = encoder, decoder

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return self.decoder(self.encoder(batches))


def encode(docs: DataFrame, text: str = "text", name: str = "piece_ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """The rows with their text as an array of piece ids."""
    return docs.mapInArrow(_Encoder(load_vocabulary(model), text, name),
                           schema_with(docs, name, T.ArrayType(T.IntegerType(), False)))


def decode(rows: DataFrame, ids: str = "piece_ids", name: str = "decoded", model: str = DEFAULT_MODEL) -> DataFrame:
    """The rows with the text that their piece ids spell."""
    return rows.mapInArrow(_Decoder(load_vocabulary(model).spelled, ids, name), schema_with(rows, name, T.StringType()))


def encode_and_decode(docs: DataFrame, text: str = "text", ids: str = "piece_ids", decoded: str = "decoded",
                      model: str = DEFAULT_MODEL) -> DataFrame:
    """The rows with their text as an array of piece ids, and the text that these spell."""
    vocabulary = load_vocabulary(model)
    both = _Both(_Encoder(vocabulary, text, ids), _Decoder(vocabulary.spelled, ids, decoded))
    with_ids = schema_with(docs, ids, T.ArrayType(T.IntegerType(), False))
    kinds = T.StructType([f for f in with_ids.fields if f.name != decoded] + [T.StructField(decoded, T.StringType())])
    return docs.mapInArrow(both, kinds)
