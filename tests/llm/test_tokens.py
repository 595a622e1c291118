"""Packing and SentencePiece encoding against the libraries."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlake.llm.packing import best_fill, pack_documents, pack_histogram
from churnlake.llm.piece_suffix import Encoder, PieceModel, decode, decode_pieces, encode_pieces, occurrences
from churnlake.llm.queries import tokenizer_path
from helpers import awkward, docs_frame

WORDS = tokenizer_path("word_bpe_49k.json")
PIECES = tokenizer_path("piece_bpe_32k.model")
ODD = ["don't stop<|endoftext|>now", "ΟΔΟΣ Σ ΣΑ", "é é ﬁ", "a b c　d", "1234 5,6!?", "İstanbul"]


def test_pack_documents(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(WORDS)
    texts = awkward() + ODD + ["same words here"] * 300
    got = pack_documents(spark, docs_frame(spark, texts), WORDS, capacity=512, with_ids=True).collect()
    sequences = {}
    for i, t in enumerate(texts, 1):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted((x for x in got if x.doc_id == i), key=lambda x: x.piece)
        assert [x.start for x in mine] == list(range(0, len(ids), 512))
        for x in mine:
            cut = ids[x.start: x.start + 512]
            assert x.length == len(cut) and x.ids == cut
            assert x.ids_crc32 == zlib.crc32(np.array(cut, "<u4").tobytes())
            sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    total = 0
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 512
        total += at
    assert len(sequences) <= -(-total // 512) + 1


def test_pack_empty_and_null_ids(spark):
    df = docs_frame(spark, ["a", "a"])
    assert pack_documents(spark, df.limit(0), WORDS).count() == 0
    rows = pack_documents(spark, df.withColumn("doc_id", F.lit(None).cast("long")), WORDS).collect()
    assert sorted((x.sequence_id, x.offset, x.length) for x in rows) == [(0, 0, 2), (0, 2, 2)]


@pytest.mark.parametrize("seed", range(6))
def test_histogram_is_covered_near_the_bound(seed):
    r = random.Random(seed)
    lengths = [min(4096, max(1, int(r.lognormvariate(6.2, 1.0)))) for _ in range(3000)] + [4096] * 50
    histogram = {}
    for n in lengths:
        histogram[n] = histogram.get(n, 0) + 1
    held = {}
    patterns = pack_histogram(histogram)
    for counts, times in patterns:
        assert times > 0 and sum(n * c for n, c in counts.items()) <= 4096
        for n, c in counts.items():
            held[n] = held.get(n, 0) + c * times
    assert held == histogram
    assert sum(t for _, t in patterns) <= 1.005 * -(-sum(lengths) // 4096) + 1


def test_histogram_without_small_pieces():
    # no two fit together, then exact thirds
    assert sum(t for _, t in pack_histogram({3000: 7})) == 7
    assert sum(t for _, t in pack_histogram({1365: 30, 1: 10})) == 10
    assert pack_histogram({}) == []


def test_best_fill_is_optimal():
    r = random.Random(2)
    for _ in range(20):
        lengths = np.array(sorted(r.sample(range(2, 30), 5)))
        price = np.array([r.random() * n for n in lengths])
        value, _ = best_fill(lengths, price, 60)
        best = [0.0] * 61
        for c in range(1, 61):
            best[c] = max([best[c - 1]] + [best[c - n] + p for n, p in zip(lengths.tolist(), price) if n <= c])
        assert np.allclose(value, best)


def test_pieces_match_the_library(spark):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(4)
    noise = ["".join(r.choice("abest \n\t▁é世😀0'") for _ in range(r.randrange(60))) for _ in range(300)]
    texts = [t for t in awkward() if t is None or len(t) < 60_000] + ODD + noise + [" " * 40 + "x" + " " * 33, "\x00a b"]
    encoded = encode_pieces(docs_frame(spark, texts), PIECES)
    got = {x.doc_id: x for x in encoded.collect()}
    back = {x.doc_id: x.text for x in decode_pieces(encoded, PIECES).collect()}
    for i, t in enumerate(texts, 1):
        ids = sp.encode(t or "")
        assert got[i].ids == ids
        assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert back[i] == (t or "").replace("▁", " ")
    assert encode_pieces(docs_frame(spark, ["a"]).limit(0), PIECES).count() == 0


def test_occurrences_are_all_occurrences():
    model = PieceModel(PIECES)
    text = "▁the\0▁banana\0▁世界é"
    at, piece = occurrences(model, np.array([ord(c) if c != "\0" else 0 for c in text]))
    want = {(i, model.ids[text[i:j]]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)
            if text[i:j] in model.ids}
    assert set(zip(at.tolist(), piece.tolist())) == want and (np.diff(at) >= 0).all()


def test_cache_limit_does_not_change_ids(monkeypatch):
    from churnlake.llm import piece_suffix
    monkeypatch.setattr(piece_suffix, "_CACHED_WORDS", 3)
    model = PieceModel(PIECES)
    encoder = Encoder(model)
    texts = ["one two three four five", "two six", "seven one two"]
    for t in texts + [" ".join(texts)]:
        ids = np.frombuffer(encoder.encode([t])[0], "<u4").tolist()
        assert decode(model, ids) == t
