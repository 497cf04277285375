"""Strings of added tokens in a text, against an unmodified Tokenizer."""

import numpy as np

from gridloom.llm import packing


def test_added_tokens_in_texts():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary_path())
    texts = ["a <|endoftext|> b", "one<|startoftext|>two<|endoftext|>", "<|ENDOFTEXT|> Upper", "<|endof text|> broken", "<|endoftext|", "", "Plain words, here.", "x\n<|endoftext|>\n<|endoftext|>y"]
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.WordEncoder(packing.vocabulary_path()).encode(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert plain.token_to_id("<|endoftext|>") in got[0]
