"""Plain stretches are read by their pieces: few distinct ones, with the ids of the whole text."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from riskframe.llm import packing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n\t", "Aerwh, aerwh. AERWH!! (aerwh)", "École ÉCOLE, école... Straße ÷×ñ ÀÉ", "don't I'M x's 's '' 'tis o'l'l",
    "a<|endoftext|>b <|ENDOFTEXT|> <| endoftext |>", "12a34 3½ ² __init__ a_b", "漢字 x é É. İ ẞ ΑΣ ﬁ", "\x0b\x0c\x1c a\x1fb \x7f \x85\xa0z",
    "end", "begin", "<", "|x", "é", "\x80", "tab\tline\r\nend",
]


def test_ids_by_pieces_equal_ids_of_whole_texts():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u2").tobytes() for t in TEXTS]
    assert packing.word_encoder(TOKENIZER)(TEXTS) == want
    assert packing.word_encoder(TOKENIZER)(pa.array(["x", *TEXTS]).slice(1)) == want


def test_marks_and_cases_make_no_new_units():
    words, numbers, bounds = packing.units(pa.array(["Aerwh, aerwh. AERWH!! (aerwh)", None, "É é Éa's"]))
    assert sorted(words) == sorted([b"aerwh", b",", b".", b"!!", b"(", b")", "é".encode(), "Éa's".encode()])
    assert (len(numbers), bounds.tolist()) == (12, [0, 9, 9, 12])
