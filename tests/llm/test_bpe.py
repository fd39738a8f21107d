"""Token ids against the public library's, and the check of neighbours against exact merging."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm.bpe import Bpe, encode_texts

PATH = "/opt/tokenizers/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@pytest.fixture(scope="module")
def bpe():
    with open(PATH, "rb") as f:
        return Bpe(f.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def split(bpe, texts):
    ids, count = bpe.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_any_text(bpe, library, texts):
    assert split(bpe, texts) == library(texts)


def test_odd_texts(bpe, library):
    rng = random.Random(0)
    parts = ["a", "b", " ", "the", "ing", "é", "ก", "1", "\n", "!", "<|endoftext|>", "'s", "​", "qu", "  ", "\x00", "𝔠", "👩🏽‍🚒"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(2000)] + ["a" * 20_000, "ab" * 9000, "x" * 257 + " " * 300, "", " "]
    assert split(bpe, texts) == library(texts)


def test_neighbours_agree_with_merging(bpe):
    rng = random.Random(1)
    names = sorted(bpe.tokens)
    a, b = [bpe.tokens[rng.choice(names)] for _ in range(4000)], [bpe.tokens[rng.choice(names)] for _ in range(4000)]
    joint = {r: t for t, r in bpe.tokens.items()}
    good = bpe.compatible(np.array(a), np.array(b))
    for x, y, g in zip(a, b, good):
        assert g == (bpe.merge(joint[x] + joint[y]) == [x, y])
    for t in names[::50]:
        assert bpe.merge(t) == [bpe.tokens[t]]


def test_operator(spark, library):
    rows = [(1, "hello  world", 1), (1, "hello  world", 1), (2, None, None), (3, "", 2), (None, " \n", 3), (4, "word " * 50_000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = encode_texts(df, "doc_id", "text", PATH).collect()
    want = library([r[1] or "" for r in rows])
    assert sorted((r.doc_id or 0, list(r.ids)) for r in got) == sorted((r[0] or 0, w) for r, w in zip(rows, want))
    assert encode_texts(df.limit(0), "doc_id", "text", PATH).count() == 0
