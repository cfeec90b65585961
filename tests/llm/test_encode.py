import base64
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from earshot.llm import encode as E

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


@lru_cache
def public():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ours(texts):
    flat, counts, offsets = E.encode(texts, E.Vocabulary.load(E.BYTE_BPE_50K))
    bounds = np.concatenate(([0], np.cumsum(counts)))
    return [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)], [offsets[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]


TEXTS = st.text(alphabet=st.one_of(st.sampled_from("aslvredmtLLI''  \n\t\r12é😀.,?!\xa0　​अ़"), st.characters(exclude_categories=["Cs"])), max_size=80)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXTS), max_size=12))
def test_same_as_public_encoder(texts):
    assert ours(texts)[0] == [public().encode_ordinary(t) if t else [] for t in texts]


def test_edges():
    texts = [None, "", " ", "   ", "it's they'll 'tis ''s x'LL we've", "<|endoftext|>", "a" * 20_000, "word " * 5000, "\r\n\r\n x", "don't\n't"]
    assert ours(texts)[0] == [public().encode_ordinary(t) if t else [] for t in texts]


def test_scan_is_the_running_product():
    rng = np.random.default_rng(1)
    elements = rng.integers(0, len(E._AT_NONE), 5000).astype(np.uint8)
    total, want = 0, []
    for e in elements.tolist():
        total = int(E._PRODUCT[total, e])
        want.append(total)
    for width in (2, 16, 256):
        assert E.scan(elements, width).tolist() == want


def test_offsets_and_decoding():
    text = "Erm— the 🎧 isn't on, is it?"
    (ids,), (starts,) = ours([text])
    assert E.decode(ids) == text
    assert starts == sorted(starts) and starts[0] == 0
    for cut in sorted(set(starts)):  # what stands before a piece's begin is decoded by the ids before it
        assert E.decode([i for i, s in zip(ids, starts, strict=True) if s < cut]) == text[:cut]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXTS), max_size=6))
def test_offsets_of_ids(texts):
    words = E.Vocabulary.load(E.BYTE_BPE_50K)
    flat, counts, starts = E.encode(texts, words, inside=True)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        size = np.cumsum([0] + [len(ch.encode()) for ch in text or ""])
        before = np.cumsum([0] + [len(words.names[i]) for i in flat[at : at + n].tolist()])[:-1]
        assert starts[at : at + n].tolist() == (np.searchsorted(size, before, "right") - 1).tolist()
        at += n


def test_operator(spark):
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in E.token_ids(df).collect())
    want = public().encode_ordinary("hello world")
    assert got == [(1, want), (1, want), (2, []), (3, [])]
    assert E.token_ids(df, offsets=True, part_bytes=1).where("doc_id = 1").first().starts == [0, 5]
    assert sorted((r.doc_id, r.n_tokens) for r in E.token_counts(df).collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert E.token_ids(df.limit(0)).count() == 0
