"""Byte-level BPE against the library, on texts, on odd pieces and on vocabularies whose merges come out of order."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from sessionlens.llm import byte_bpe
from sessionlens.llm.text import utf8_chunks

BITS = ["a", "b", "s", "t", "re", "'", "'s", "'ll", "'d", " ", "  ", "\n", "\t", " ", "é", "ß", "1", "²", "!", ".", "日本", "😀", "\x1c", "\x85", "​", "LL", "the ", "ing", "\r\n"]


@pytest.fixture(scope="module")
def tokens():
    return byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.RANKS))


def library(tokens):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})


def check(encoder, theirs, texts):
    for lo, buf, offsets in utf8_chunks(pa.array(texts), byte_bpe.BLOCK):
        ids, cut = encoder.encode(buf, offsets)
        data, _ = encoder.decode(ids, cut)
        assert data.tobytes() == buf.tobytes()
        for k in range(len(cut) - 1):
            assert ids[cut[k] : cut[k + 1]].tolist() == theirs.encode_ordinary(texts[lo + k] or ""), texts[lo + k]


def test_pieces_and_ids_equal_the_library(tokens):
    rng = random.Random(1)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))) for _ in range(5000)] + [None, "", "'s", " 's", "x've's've'llama'red", "a" * 5000, "ab" * 3000]
    check(byte_bpe.Encoder(tokens, byte_bpe.character_runs()), library(tokens), texts)


def test_merges_that_a_later_merge_makes_possible():
    """Random tokens, not learned ones: a merge often makes a pair of an earlier rank."""
    runs, odd = byte_bpe.character_runs(), 0
    for seed in range(60):
        rng = random.Random(seed)
        more = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))) for _ in range(40)}
        tokens = [bytes([k]) for k in range(256)] + rng.sample(sorted(more), len(more))
        encoder = byte_bpe.Encoder(tokens, runs)
        plain, encoder.merges.greedy = encoder.merges.greedy, lambda w, f=encoder.merges.greedy: calls.append(w) or f(w)
        calls = []
        check(encoder, library(tokens), [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(60))])
        odd += len(calls)
        assert plain(b"abcabcabc") == library(tokens).encode_ordinary("abcabcabc")
    assert odd > 50


def test_query_with_and_without_a_lexicon(spark, tokens, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(BITS) for _ in range(60)) for _ in range(80)] + [None, "", "word " * 20_000, "same text", "same text"]
    df = spark.createDataFrame([(k, x, "n") for k, x in enumerate(texts)] + [(7, texts[7], "n"), (None, "x", "n")], "doc_id long, text string, token_ids string")
    theirs = library(tokens)
    want = sorted((str(r["doc_id"]), len(ids := theirs.encode_ordinary(r["text"] or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest(), True) for r in df.collect())
    for most in (byte_bpe.LEXICON_WORDS, 3, 0):
        monkeypatch.setattr(byte_bpe.corpus_lexicon, "__defaults__", (most, "text"))
        assert sorted((str(a), *rest) for a, *rest in byte_bpe.transcode_digest(df).collect()) == want
    back = byte_bpe.decode(byte_bpe.encode(df)).collect()
    assert all(r["decoded"] == r["text"] for r in back) and len(back) == len(want)
    assert byte_bpe.transcode_digest(df.limit(0)).count() == 0


def test_replay_in_small_parts(tokens, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REPLAYED", 50)
    check(byte_bpe.Encoder(tokens, byte_bpe.character_runs()), library(tokens), ["Antidisestablishmentarianism qzxv " * 9 + "ωμέγα" * 30])


def test_ranks_are_read_by_rank(tmp_path):
    path = tmp_path / "r"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([k])) + b" " + str(k).encode() for k in reversed(range(256))))
    assert byte_bpe.read_ranks(str(path))[65] == b"A"
