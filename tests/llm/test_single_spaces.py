"""Texts parted by single spaces and newlines are cut without the pattern; ids stay those of the tokenizer."""

from itertools import product

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lodestone.llm import tokens

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_every_short_mix_of_white_space_is_exact():
    plain, code = Tokenizer.from_file(BYTE), tokens.WordEncoder(BYTE, False)
    odd = ["a\0b c", "\0", "a　b c", "é è\nü", "a\xa0b", "a\x85 b", "a\tb c", "it's we'll\n\"x\", 1.2", "a\x1cb c"]
    for text in [*("".join(x) for n in range(6) for x in product("aé,' \n", repeat=n)), *odd]:
        assert np.frombuffer(code.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_plain_texts_need_no_pattern(monkeypatch):
    monkeypatch.setattr(tokens, "_RUNS", None)
    assert [x for x in tokens.keep_space("one two\nthrée, four.") if x] == ["one", " two", "\n", "thrée,", " four."]
