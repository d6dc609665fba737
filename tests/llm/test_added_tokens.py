"""Texts with the string of an added token have the ids that the named file gives with add_special_tokens=False."""

import random

import numpy as np
import pytest

from sluice.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name, kind, want", [("word_bpe_49k.json", "word", [320, 49407, 321]), ("byte_bpe_50k.json", "byte", [64, 220, 50256, 275])])
def test_added_tokens_count_as_tokens(name, kind, want):
    from tokenizers import Tokenizer

    enc, fresh, rnd = tokens.PieceEncoder(public_tokenizers.path(name), kind, most=5), Tokenizer.from_file(public_tokenizers.path(name)), random.Random(8)
    texts = ["a <|endoftext|> b", None, "", "A <|ENDOFTEXT|> b", "a<|endoftext|>", "<|startoftext|>x\n\n<|endoftext|> ", "<|endoftext |>"]
    texts += ["".join(rnd.choice(["a", " ", "B,", "\n", "é", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|"]) for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    got = [np.frombuffer(b, "<u4").tolist() for _, b in tokens.encode_slices(texts, enc, 200)]
    assert got[0] == want and got == [e.ids for e in fresh.encode_batch([t or "" for t in texts], add_special_tokens=False)]
