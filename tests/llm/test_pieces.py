"""New pieces of the encoder."""

import time

import pyarrow as pa
import pytest

from flowgraph.llm.queries import tokenizer_path
from flowgraph.llm.tokens import Encoder


@pytest.mark.parametrize("word", [" ción", " İx", "ß", " Ǳɏ", " ɐé", " é", " ªº", " a²", "naïve"])
def test_words_of_latin_letters_are_encoded_as_the_library_does(word):
    own = Encoder(tokenizer_path("byte_bpe_50k.json"), True)
    for text in (word, f"a{word}{word} b", word.strip()):
        assert own.encode([text]) == [own.direct(text)]


def test_signs_of_bytes():
    from flowgraph.llm.tokens import _byte_signs

    assert isinstance(_byte_signs(), str) and len(set(_byte_signs())) == 256  # a table without gaps: no look-up raises
    assert (_byte_signs()[32], _byte_signs()[0], _byte_signs()[65], _byte_signs()[173]) == ("Ġ", "Ā", "A", "Ń")


def test_pieces_become_strings_without_a_scalar_each():
    """A fifth of the encoder's time went into to_pylist()."""
    from flowgraph.llm.tokens import strings

    values = pa.array([f" wörd{i}" for i in range(200_000)] + ["", "🙂"], pa.large_string())
    took = {}
    for make in (strings, pa.Array.to_pylist):
        began = time.process_time()
        took[make] = make(values), time.process_time() - began
    assert took[strings][0] == took[pa.Array.to_pylist][0]
    assert took[strings][1] < took[pa.Array.to_pylist][1] / 2
