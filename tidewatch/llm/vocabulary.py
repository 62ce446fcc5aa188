"""Public vocabulary files: where they are, and what of them the tokenizing operators use."""

from __future__ import annotations

import json


def vocabulary_path(name: str) -> str:
    """Place of a vocabulary file; the package that holds them is on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Bytes that print stand for themselves; the others take code points from 256 on, in order.
    """
    prints = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


def read_word_bpe(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
