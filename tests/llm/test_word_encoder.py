"""Ids put together from words and their parts against the library's."""

from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barloom.llm.packing import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["it's", "IT'S", "'s's", "''s", "don't'll", "a1b22", "x" * 300, "<|endoftext|>", "A<|startoftext|>b", "<|END", "...", "-'-", "é", "É1's", "日本", "\x00", "\x1c\x1d", "\x85", " a", "a_b", "'re", "'D", "I'M", " ", "İ", "0x1F"]


@pytest.mark.parametrize("limit", [400_000, 30])
def test_ids_equal_the_library(rnd, limit):
    library, mine = Tokenizer.from_file(PATH), WordEncoder(PATH, limit)
    letters = "abcXYZ019'’\"_-.,;:!?#<|>/\\éß日 \t"
    for i in range(1500):
        text = " ".join(rnd.choice(PIECES) for _ in range(rnd.randrange(12))) if i % 2 else "".join(rnd.choice(letters) for _ in range(rnd.randrange(80)))
        assert mine(text.encode()) == array("I", library.encode(text, add_special_tokens=False).ids).tobytes(), text
