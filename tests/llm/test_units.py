"""Words of letters in token files: many at a time, and the same ids as from whole texts."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import tokens

with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
    MODEL = json.load(file)
LETTERS = "etaoinshrdluETAéñüßØøÿĀőɏ"
ENDS = ["", ",", ".", "'s", "'", "''t", "!!", "###", "3", "́", "×", "÷", "ɐ", "ʰ", "ª", "Ж", "’s", " ", "\x0b", "\x1c", "\0", "\n", "\t"]


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **kw):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **kw)


def made(**changes):
    tokenizer = Tokenizer.from_str(json.dumps(MODEL | changes))
    tokenizer.encode_special_tokens = True
    return tokenizer


def texts(n, seed=5):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices(LETTERS, k=rnd.randint(1, 9)))
    return ["".join(rnd.choice(["", " ", " ", "  ", "\n "]) + word() + rnd.choice(ENDS if i % 2 else ENDS[:12]) for _ in range(60)) for i in range(n)]


def ids(encoder, found):
    return [np.frombuffer(x, encoder.kind).tolist() for x in found]


def test_new_words_do_not_go_out_one_by_one():
    plain, rnd = made(), random.Random(1)
    words = sorted({"".join(rnd.choices(LETTERS, k=8)) for _ in range(1200)})
    encoder = tokens.UnitEncoder(plain)
    encoder.tokenizer = Counted(plain)
    found = encoder.encode([", ".join(words)])
    assert ids(encoder, found) == [plain.encode(", ".join(words)).ids]
    assert encoder.tokenizer.texts < 10


@pytest.mark.parametrize("most", [2, 300, 348_000])
def test_same_ids_as_whole_texts(most):
    plain, some = made(), texts(300)
    encoder = tokens.UnitEncoder(plain, most)
    assert encoder.words
    for k in range(0, len(some), 7):
        assert ids(encoder, encoder.encode(some[k : k + 7])) == [plain.encode(t).ids for t in some[k : k + 7]]
    assert len(encoder.known) + len(encoder.older) <= max(most, 2 * 7 * 60 * 3)


def test_other_tokenizers_get_each_unit():
    added = [{**MODEL["added_tokens"][0], "id": 50257, "content": "eta", "special": False}]
    joined = {**MODEL["model"], "vocab": {**MODEL["model"]["vocab"], "Āt": 50257}, "merges": [["Ā", "t"], *MODEL["model"]["merges"]]}
    for changes in ({"added_tokens": MODEL["added_tokens"] + added}, {"model": joined}, {"model": {**MODEL["model"], "ignore_merges": True}}):
        plain, some = made(**changes), texts(40)
        encoder = tokens.UnitEncoder(plain)
        assert encoder.words is None
        assert ids(encoder, encoder.encode(["eta", "\0t"])) == [plain.encode(t).ids for t in ("eta", "\0t")]
        if "added_tokens" not in changes:
            assert ids(encoder, encoder.encode(some)) == [plain.encode(t).ids for t in some]


def test_each_unit_is_looked_up_once_and_new_ones_fill_their_places():
    units = tokens.Units({"old": b"a"})
    found = list(map(units.__getitem__, ["old", "new", "old", "new"]))
    units.places["new"] += b"bc"
    assert b"".join(found) == b"abcabc" and list(units) == ["old", "new"] and list(units.places) == ["new"]


def test_units_with_other_white_space_are_not_kept():
    plain, some = made(), ["one\x0btwo three", "three", "one\x0btwo three one\x0btwo"]
    encoder = tokens.UnitEncoder(plain)
    for _ in range(2):
        assert ids(encoder, encoder.encode(some)) == [plain.encode(t).ids for t in some]
    assert " three" in encoder.known and not any("\x0b" in u for u in encoder.known)
