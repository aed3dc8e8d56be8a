"""What encoders remember: each word once, and the younger generation only between tasks."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lexmill.llm import bpe, tokenfile

TEXTS = ["a word. word, word wordy", "don't word", "h\u00e9llo h\u00e9llo! \u4e2d\u6587. \u4e2d", " a  b ", "x\u3000 y", "tab\tx word", "\x1c word", "", "a.b. c!!", "<|endoftext|> word"]


def test_a_word_with_a_blank_before_it_is_kept_with_the_pieces_alone():
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    code, lib = tokenfile.Encoder(path), Tokenizer.from_file(path)
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in code.encode(TEXTS)]
        assert got == [lib.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert {"word", "word.", "h\u00e9llo", "h\u00e9llo!"} <= code.young.keys() and " word" not in code.known and " h\u00e9llo" not in code.known


def test_an_encoder_forgets_its_older_generation(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    code = bpe.Codec(str(public_tokenizers.path("word_bpe_49k.json")))
    want = [code.encode(t) for t in TEXTS]
    assert code.old and code.before
    code.forget()
    assert not code.old and not code.before and [code.encode(t) for t in TEXTS] == want
