"""Work of the piece encoder: merging is worked out by piece, not by pair; limits don't change ids."""

import random

import numpy as np
import public_tokenizers
import sentencepiece

from churnlake.llm import piece_suffix
from churnlake.llm.piece_suffix import Encoder, PieceModel

PATH = public_tokenizers.path("piece_bpe_32k.model")


def _texts(n=300):
    r = random.Random(12)
    letters = "etaoinshrdlu" * 3 + "äéß日 .,-1'\0😀"
    return ["".join(r.choice(letters) for _ in range(r.randrange(1, 120))) for _ in range(n)] + [
        "", "   ", "x" * 64, "x" * 65, "lorem" * 90, "日本" * 70]


def _ids(texts):
    encoder = Encoder(PieceModel(PATH))
    return [np.frombuffer(x, "<u4").tolist() for at in range(0, len(texts), 50) for x in encoder.encode(texts[at: at + 50])]


def test_merging_is_worked_out_once_a_piece(monkeypatch):
    calls, merged = [], PieceModel._merged
    monkeypatch.setattr(PieceModel, "_merged", lambda self, text, *a: calls.append(text) or merged(self, text, *a))
    encoder = Encoder(PieceModel(PATH))
    encoder.encode(_texts())
    pieces = encoder.model.score
    assert calls and all(len(x) == 1 or x in pieces or not x.strip(piece_suffix.SPACE) for x in calls)
    assert len(calls) <= 3 * len(set(calls))


def test_small_limits_give_the_librarys_ids(monkeypatch):
    texts = _texts()
    for name, value in (("_LEVELS", 3), ("_PAIRS", 8), ("_CHARS_AT_ONCE", 40), ("_CACHED_WORDS", 5), ("_CACHED_PARTS", 7)):
        monkeypatch.setattr(piece_suffix, name, value)
    assert _ids(texts) == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(texts)


def test_pairs_kept_apart_are_those_of_merging():
    model = PieceModel(PATH)
    r, ids = random.Random(2), list(model.names)
    ids = [i for i in ids if len(model.names[i]) <= 3]
    pairs = [(r.choice(ids), r.choice(ids)) for _ in range(4000)] + [(model.number("\U0001f600"), ids[0])]
    text = [(model.names[a], model.names[b]) for a, b in pairs]
    want = [x + y not in model.score and model._merged(x + y) == (x, y) for x, y in text]
    a, b = np.array(pairs).T
    assert model.all_neighbours(a, b).tolist() == want == model.all_neighbours(a, b).tolist()
    assert len(set(want)) == 2
