"""Merge replay against the tiktoken library, and edge cases."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken

from ledgerloom.llm.bpe import LONG_WORD, decode, encode_block, encode_documents, load

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ours(texts):
    v = load(PATH)
    split, spelled = encode_block(texts, regex.compile(public_tokenizers.PATTERN), v)
    for words in split:
        joined = ",".join(spelled[w] for w in words)
        yield [int(x) for x in joined.split(",")] if joined else []


def test_against_library(library):
    rng = random.Random(5)
    alphabets = ["ab", "aab ", "etaoin shrdlu'  ", "éèßñ çü", "漢字かな交じり文 ", "🎈👩‍👩‍👧 ", "0123456789 ,.", "\x1c\x1d\x1f\u200b\u180e a", "\t\n\r\x0b\x0c\x1c\x85   x", "'s't're'll "]
    texts = ["", " ", "\n\n  x", "<|endoftext|>", "a" * 3000, "abab" * 400, "the theatre of the thing"]
    for alphabet in alphabets:
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(60)) for _ in range(100)]
    for text, ids in zip(texts, ours(texts), strict=True):
        assert ids == library.encode_ordinary(text), repr(text)
        assert decode(ids, load(PATH)) == text.encode()


@pytest.mark.parametrize("word", ["a" * 150_000, "ab" * 60_000, "0123456789" * 9_000, "漢字" * 20_000, "zqxjk" * 20_000, "abcabd" * 300 + "é" * 999])
def test_long_words_against_library(library, word):
    text = f"so {word} it"
    (ids,) = ours([text])
    assert ids == library.encode_ordinary(text)


def test_words_around_the_long_bound(library):
    rng = random.Random(8)
    texts = ["".join(rng.choice("etaoinshr") for _ in range(n)) for n in range(LONG_WORD - 5, LONG_WORD + 40)]
    for text, ids in zip(texts, ours(texts), strict=True):
        assert ids == library.encode_ordinary(text)


def test_documents(spark, library):
    rows = [(1, None, "a"), (2, "", "b"), (2, "twice twice", "c"), (2, "twice twice", "c"), (None, "été " * 50_000, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = encode_documents(df, PATH, public_tokenizers.PATTERN).collect()
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert encode_documents(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
