"""Texts whose segments are put aside while they are aligned."""

from vellumflow.llm import token_alignment as ta
from vellumflow.llm.tokens import default_piece_model, default_tokenizer


def test_known_segments_outlive_a_full_cache(monkeypatch):
    paths = default_tokenizer(), default_piece_model()
    monkeypatch.setattr(ta, "_CHARS", 0)
    own, texts = ta.Aligner(*paths), ["the cat sat on 12 mats,  twice", "", "the ▁ cat", "a cat ran"]
    own.align(texts[:1])
    monkeypatch.setattr(ta, "_CHARS", 1 << 30)
    right = ta.Aligner(*paths).align(texts)
    monkeypatch.setattr(ta, "_CHARS", 0)
    assert own.align(texts) == right and own.align(texts[::-1]) == right[::-1]
    assert right[0][0] and right[3][0] and not right[1][0] and not right[2][0]


def test_released_segments_are_made_again():
    own = ta.Aligner(default_tokenizer(), default_piece_model())
    first = own.align(["the cat sat, 1 + 2"])
    own.release()
    assert not own and not own.old and own.align(["the cat sat, 1 + 2"]) == first
