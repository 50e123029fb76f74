"""Token counts and the codec: round trips, plain forward scores, and the library's own unigram encoder."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from riskmill.llm import pieces, sentencepiece_codec, token_counts

TEXTS = ["", " ", "   ", "one", " Hello  world\nfoo\tbar é漢 ", "▁ stays ▁▁", "x" * 300, "a" * 7 + "\U0001f600" * 3,
         "Der Ausdruck, gewiß: 1,234.5 %%% ***", "\r\n\r\n", "tab\tand\x00null\x7f", " " * 40 + "deep"]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary()


def test_pre_tokens_are_the_text(vocabulary):
    for text in TEXTS:
        assert "".join(vocabulary.pre_tokens(text)) == (" " + text if text else "")


def test_batched_encoding_and_trie_counts_equal_plain_forward_scores(vocabulary):
    words = {w for text in TEXTS for w in vocabulary.pre_tokens(text)} | {f" wort{k}schön" for k in range(50)}
    encoded = sentencepiece_codec.PieceKeys(vocabulary).encode_new(words)
    inside = {w for w in words if not vocabulary.is_outside(w)}
    counts = token_counts.terminal_counts(inside, vocabulary)
    for word in words:
        ids = np.frombuffer(encoded[word], np.int32).tolist()
        assert ids == vocabulary.best_path(word)
        if word in inside:
            assert counts[word] == len(ids)


def test_best_sums_equal_the_library_in_unigram_mode(vocabulary):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.DEFAULT_MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    for piece in model.pieces:
        if piece.piece in vocabulary.scores and piece.type == piece.NORMAL:
            piece.score = vocabulary.scores[piece.piece]
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    by_id = {i: vocabulary.scores[p] for p, i in vocabulary.ids.items()}
    same = 0
    texts = [t for t in TEXTS if "▁" not in t and "\x00" not in t]
    for text in texts:
        mine = [i for w in vocabulary.pre_tokens(text) for i in vocabulary.best_path(w)]
        theirs = library.encode(text)
        same += mine == theirs
        assert sum(by_id.get(i, 0) for i in mine) == pytest.approx(sum(by_id.get(i, 0) for i in theirs), abs=1e-2)
        assert len(mine) == len(theirs)
    assert same >= len(texts) - 3  # equal sums may be met by other pieces


def test_codec_round_trip_with_odd_rows(documents, odd_rows):
    docs = documents(odd_rows + [(100 + k, t, "s") for k, t in enumerate(TEXTS)])
    found = sentencepiece_codec.decode(sentencepiece_codec.encode(docs))
    assert found.columns == [*docs.columns, "piece_ids", "decoded"]
    rows = found.collect()
    assert len(rows) == docs.count()
    assert all(r.text == r.decoded for r in rows)
    assert {len(r.piece_ids) for r in rows if r.text == ""} == {0}
    assert all((r.piece_ids is None) == (r.text is None) for r in rows)
    again = sentencepiece_codec.encode(found.drop("decoded"))  # its own column is replaced
    assert again.columns == [*docs.columns, "piece_ids"]
    counted = token_counts.count_tokens(docs)  # replaces the clashing column
    assert counted.dtypes[-1] == ("n_tokens", "bigint")
    sizes = sorted(len(r.piece_ids or []) for r in rows)
    assert sorted(r.n_tokens for r in counted.collect()) == sizes


def test_empty_tables(documents):
    docs = documents([])
    assert token_counts.count_tokens(docs).collect() == []
    assert sentencepiece_codec.decode(sentencepiece_codec.encode(docs)).collect() == []


def test_words_whose_hashes_deceive_are_encoded_plainly(vocabulary):
    keys = sentencepiece_codec.PieceKeys(vocabulary)
    words = ["Haus", "Baum", "Wald", "漢字漢字"]
    plain = [np.array(vocabulary.best_path(w), np.int32).tobytes() for w in words]
    assert keys.encode_words(words) == plain
    for length, (hashes, scores, ids) in keys.tables.items():
        keys.tables[length] = (hashes, scores, np.roll(ids, 1))  # every probe finds a wrong piece
    assert keys.encode_words(words) == plain


def texts_batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])


@pytest.mark.parametrize("at_once, kept, run", [(1 << 22, 1 << 27, 1 << 16), (40, 1 << 27, 3), (64, 900, 2), (1, 1, 1)])
def test_slices_runs_and_forgetting_change_nothing(vocabulary, monkeypatch, at_once, kept, run):
    for module in (pieces, token_counts, sentencepiece_codec):
        monkeypatch.setattr(module, "BYTES_AT_ONCE", at_once)
    monkeypatch.setattr(pieces, "KEPT_BYTES", kept)
    monkeypatch.setattr(pieces, "WORDS_AT_ONCE", run)
    texts = TEXTS + [None] + [" ".join(f"wort{k % 13}schön" for k in range(40)), None, "tail"]
    both = sentencepiece_codec._Both(sentencepiece_codec._Encoder(vocabulary, "text", "ids"),
                                     sentencepiece_codec._Decoder(vocabulary.spelled, "ids", "decoded"))
    rows = [r for b in both(iter([texts_batch(texts)])) for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(len(texts))) and [r["decoded"] for r in rows] == texts
    wanted = [None if t is None else [i for w in vocabulary.pre_tokens(t) for i in vocabulary.best_path(w)] for t in texts]
    assert [r["ids"] for r in rows] == wanted
    counted = token_counts._Counter(vocabulary, "text", "n")(iter([texts_batch(texts)]))
    assert [r["n"] for b in counted for r in b.to_pylist()] == [len(w or []) for w in wanted]


PEAK = """
import random, resource, sys
import pyarrow as pa
from riskmill.llm import pieces, sentencepiece_codec, token_counts
rng = random.Random(1)
words = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(4000)]
base = [" ".join(rng.choices(words, k=400)) for _ in range(200)]
texts = [base[k % 200] for k in range(18_000)] + [" ".join(base * 6)]
batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
assert batch.nbytes > 60_000_000
del texts
vocabulary = pieces.load_vocabulary()
both = sentencepiece_codec._Both(sentencepiece_codec._Encoder(vocabulary, "text", "ids"),
                                 sentencepiece_codec._Decoder(vocabulary.spelled, "ids", "decoded"))
tool = {"codec": both, "counts": token_counts._Counter(vocabulary, "text", "n")}[sys.argv[1]]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rows = sum(b.num_rows for b in tool(iter([batch])))
assert rows == 18_001
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize("tool", ["codec", "counts"])
def test_memory_of_a_full_batch_is_bounded(tool):
    root = Path(__file__).resolve().parents[2]
    found = subprocess.run([sys.executable, "-c", PEAK, tool], capture_output=True, text=True, cwd=root, timeout=600)
    assert found.returncode == 0, found.stderr[-2000:]
    assert int(found.stdout) < 300
