"""Ids of words with punctuation behind, and what is remembered of them."""

import random
import string

import public_tokenizers

from bayesloom.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_those_of_whole_texts():
    rng = random.Random(2)
    letters = string.ascii_letters + "éÜßłŽñİſ"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(0, 7)))
    marks = lambda: "".join(rng.choice(string.punctuation) for _ in range(rng.choice([0, 0, 1, 1, 2, 5])))
    texts = [" ".join(rng.choice([word() + marks(), marks() + word(), word() + "'s" + marks(), word() + "7" + marks(), "<|endoftext|>" + marks(), word() + marks() + word()]) or "x" for _ in range(40)) for _ in range(150)]
    texts += ["Grumpfen grumpfen, GRUMPFEN!! grumpfen### grumpfen'", "don't 'tis we'll!! they'd're", "a\x01 \x7f !!! ### it's### ...", ""]
    for remembered in (tokens.REMEMBERED, 3000):
        ids = tokens.WordIds(PATH)
        kept, tokens.REMEMBERED = tokens.REMEMBERED, remembered
        try:
            for t in texts * 2:
                assert ids(t.encode()) == tokens.as_ids(ids.tokenizer.encode(t, add_special_tokens=False).ids)
        finally:
            tokens.REMEMBERED = kept


def test_words_that_occur_once_take_one_entry():
    ids = tokens.WordIds(PATH)
    once = [f"Quib{a}{b}{c}###" for a in "aeiou" for b in "lmnpr" for c in "stvz"]
    ids(" ".join(once).encode())
    assert len(ids.young) == len(once)
    calls = []
    ids._encode = lambda text: calls.append(text)
    ids(" ".join(once).encode() + b" QUIBALS###")
    assert not calls and len(ids.young) == 2 * len(once) + 1
