"""Words with signs after them are looked up by the word."""

from __future__ import annotations

import random

import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from duolume.llm.token_output import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


class Counted:
    def __init__(self, model):
        self.model, self.names = model, []

    def tokenize(self, name):
        self.names.append(name)
        return self.model.tokenize(name)


def test_a_word_goes_to_the_model_once_whatever_signs_follow():
    e = Encoder(PATH)
    e.model = Counted(e.model)
    text = "x thorelan thorelan, thorelan. thorelan*** thorelan,*** thorelan x"
    at, ids = e.encode(pa.array([text, text]))
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want * 2 and at.tolist() == [0, len(want), 2 * len(want)]
    assert sum("thorelan" in x for x in e.model.names) == 1


def test_words_and_signs_encode_as_the_whole():
    rng = random.Random(3)
    letters, signs = [*"abÉñüøƀǃɏ×÷ɐжª'sllt"], [*"!,.*'`~_^|[]{}@#«»…½1"]
    word = lambda: "".join(rng.choices(letters, k=rng.randint(0, 4))) + "".join(rng.choices(signs, k=rng.randint(0, 3)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(2_000)]
    at, ids = Encoder(PATH).encode(pa.array(texts))
    t = Tokenizer.from_file(PATH)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
