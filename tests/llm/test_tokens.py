import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortry.llm.tokens import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def agrees(text):
    want = WHOLE.encode(text, add_special_tokens=False).ids
    return np.frombuffer(encoder(PATH).ids(text), dtype="<u4").tolist() == want


@pytest.mark.parametrize(
    "text",
    [
        "", " ", "It's WE'LL don't 'S 1²3 a\tb\n ÅØ ŉ ſ İ", "'re're''s", "ab <|endoftext|> cd", "x\x7fy", "中文 и Σας ΣΑΣ",
        "é combining", "no break space", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 30,
    ],
)
def test_same_ids_as_the_library(text):
    assert agrees(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=9, max_codepoint=0x2FF), max_size=60))
def test_same_ids_on_any_latin_text(text):
    assert agrees(text)


def test_null_is_empty():
    assert encoder(PATH).ids(None) == b""
