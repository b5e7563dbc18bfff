"""Ids of single words against the library's ids of whole texts."""

import random

import numpy as np
import pytest


@pytest.mark.parametrize("seed", range(4))
def test_ids_are_the_library_s_in_any_order(seed):
    import public_tokenizers
    from tokenizers import Tokenizer

    from corpusloom.llm.token_ids import Encoder

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    library, coder, draw = Tokenizer.from_file(path), Encoder(path), random.Random(seed)
    gaps = [chr(x) for x in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
    marks = [*map(chr, range(0x300, 0x370)), "̧", "ְ", "゙"]
    letters = [*"abcdefghjtwyHJTWYIİıſKÅßé中文ñ0129'.,-_!<>|²½\U0001d49c\U0001f600", "'s", "don't", "ᄀ", "ᅡ"]
    texts = ["café   x y", "z   k", "x y"]
    texts += ["".join(draw.choice(draw.choice((gaps, marks, letters, letters))) for _ in range(draw.randint(0, 40))) for _ in range(400)]
    while texts:
        own, texts = texts[: (n := draw.randint(1, 9))], texts[n:]
        ids, size = coder(own)
        at = np.concatenate(([0], np.cumsum(size)))
        for i, t in enumerate(own):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, ascii(t)


def test_remembered_words_are_bounded_by_bytes(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from corpusloom.llm import token_ids

    monkeypatch.setattr(token_ids, "REMEMBERED_BYTES", 1_000_000, raising=False)
    path, draw = str(public_tokenizers.path("word_bpe_49k.json")), random.Random(5)
    library, coder = Tokenizer.from_file(path), token_ids.Encoder(path)
    for letters in ("abcdefgh", "абвгдежз"):
        for _ in range(40):
            text = " ".join("".join(draw.choices(letters, k=1000)) for _ in range(50))
            ids, _ = coder([text])
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
            assert sum(map(len, coder.known)) < 1_000_000  # 2,000 and 4,000 KB came by


def test_ids_of_every_latin_1_character_are_the_library_s():
    import public_tokenizers
    from tokenizers import Tokenizer

    from corpusloom.llm.token_ids import Encoder

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    library, coder = Tokenizer.from_file(path), Encoder(path)
    for c in map(chr, range(1, 0x180)):
        for text in (f"a{c}B {c} {c}{c}1{c}'s", f"\xc9{c}\xdf'{c} X{c}\u0301 \xf7{c}"):
            assert coder([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)
