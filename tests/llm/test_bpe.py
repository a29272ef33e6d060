"""Merge replay on long words without a break, and on words of few letters, against the tokenizer library."""

import base64
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from httploom.llm import bpe

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def both(name):
    with open(public_tokenizers.path(name), "rb") as file:
        vocab = bpe.vocabulary(file.read(), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    return vocab, library


def long_texts():
    rng = random.Random(3)
    yield "one letter", "a" * 10**6
    yield "signs", "=" * 10**6
    yield "two signs", "=-" * 500_000
    yield "base64", base64.b64encode(rng.randbytes(750_000)).decode()
    yield "letters", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=10**6))
    yield "few letters", "".join(rng.choices("aeinrst", k=10**6))
    yield "unspaced", "".join(rng.choices("日本語の文字漢字仮名交", k=330_000))


@pytest.mark.parametrize("name", FILES)
def test_long_words(name):
    vocab, library = both(name)
    for kind, text in long_texts():
        started = time.perf_counter()
        ids = np.frombuffer(bpe.encode_slice([text], vocab)[0], "<u4").tolist()
        assert time.perf_counter() - started < 15, kind  # a second or two on an idle core
        assert ids == library.encode_ordinary(text), kind


@pytest.mark.parametrize("name", FILES)
def test_words_of_few_letters(name):
    """Many overlapping places of one rank, some of which make pairs of lower ranks."""
    vocab, library = both(name)
    rng = random.Random(1)
    texts = ["".join(rng.choices(letters, k=rng.randrange(1, 70))) for letters in ("ab", "=-*", "aeinorst", "the", "0x. ", "éèñ", "日本語の文字") for _ in range(300)]
    encoded = bpe.encode_slice(texts, vocab)
    assert [np.frombuffer(i, "<u4").tolist() for i in encoded] == [library.encode_ordinary(t) for t in texts]
