"""Token counts by dynamic programming over a trie of pre-tokens.

A batch's distinct pre-tokens form a trie; the forward score of a trie node is the best sum of piece scores that ends
at its prefix, with the number of pieces that make it up, and is computed once for all pre-tokens that share the
prefix. The sorted pre-tokens visit the nodes depth first, so only the path to the current node is in memory. The count
at a terminal node is the pre-token's; it is remembered for later batches, up to a bound in bytes, after which the memory
starts anew. A batch is worked through in slices of bounded bytes, a longer text by runs of its pre-tokens. A text's count
is the sum over its pre-tokens.

Counts are those of ``sentencepiece_codec.encode``. Null and empty texts have none; every other row gets its count, repeated
rows each their own. Further columns stay; a column named like the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskmill.llm.pieces import (BYTES_AT_ONCE, DEFAULT_MODEL, SPACE_MARK, Remembered, Vocabulary, bounded_slices,
                                 load_vocabulary)


def terminal_counts(words: Iterable[str], vocabulary: Vocabulary) -> dict[str, int]:
    """Pieces of each distinct word; words hold no character that would have to stand alone."""
    scores, longest, unknown = vocabulary.scores, vocabulary.longest, vocabulary.unknown
    found: dict[str, int] = {}
    before = ""
    best, counts = [0.0], [0]  # by depth, along the path from the root
    for word in sorted(words):
        marked = word.replace(" ", SPACE_MARK)
        shared, most = 0, min(len(before), len(marked))
        while shared < most and before[shared] == marked[shared]:
            shared += 1
        del best[shared + 1:], counts[shared + 1:]
        for end in range(shared + 1, len(marked) + 1):
            top, count = None, 0
            for start in range(end - longest if end > longest else 0, end):
                score = scores.get(marked[start:end])
                if score is not None and (top is None or best[start] + score > top):
                    top, count = best[start] + score, counts[start] + 1
            if marked[end - 1:end] not in scores and (top is None or best[end - 1] + unknown > top):
                top, count = best[end - 1] + unknown, counts[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
            best.append(top)
            counts.append(count)
        found[word] = counts[-1]
        before = marked
    return found


class _Counter:
    def __init__(self, vocabulary: Vocabulary, text: str, name: str):
        self.vocabulary, self.text, self.name = vocabulary, text, name

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered()
        for batch in batches:
            for some in bounded_slices(batch, self.text):
                texts = some.column(self.text).to_pylist()
                if len(texts) == 1 and len(texts[0] or "") > BYTES_AT_ONCE // 4:
                    counts = [sum(n for run in self.vocabulary.pre_token_runs(texts[0]) for n in self._counted([run], known))]
                else:
                    counts = self._counted([self.vocabulary.pre_tokens(t or "") for t in texts], known)
                yield with_column(some, self.name, pa.array(counts, pa.int64()))

    def _counted(self, parts: list[list[str]], known: Remembered) -> list[int]:
        every = set().union(*parts)
        new = every.difference(known)
        if known.make_room(new):
            new = every
        outside = {w for w in new if self.vocabulary.is_outside(w)}
        known.update((w, len(w.encode("utf-8", "surrogatepass"))) for w in outside)
        known.update(terminal_counts(new - outside, self.vocabulary))
        return [sum(map(known.__getitem__, words)) for words in parts]


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with the column last; one of that name before goes."""
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != name]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + [values], [n for n, _ in kept] + [name])


def schema_with(rows: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in rows.schema.fields if f.name != name] + [T.StructField(name, kind)])


def count_tokens(docs: DataFrame, text: str = "text", name: str = "n_tokens", model: str = DEFAULT_MODEL) -> DataFrame:
    """The rows with their number of pieces."""
    return docs.mapInArrow(_Counter(load_vocabulary(model), text, name), schema_with(docs, name, T.LongType()))
