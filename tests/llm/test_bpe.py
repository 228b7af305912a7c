from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlens.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, ids string, decoded string"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.vocabulary(PATH).ranks, special_tokens={})


def texts():
    rng = random.Random(2)
    made = ["".join(rng.choice("abcdefgh ABC 123,.!\n\té漢字🙂'") for _ in range(rng.randrange(200))) for _ in range(200)]
    return [None, "", " ", "\n\n  x", "<|endoftext|>", "a" * 300_000, "ab " * 50_000, "word" * 256, "é" * 700, "x" * 1024, "x" * 1025, *made]


def test_equals_the_library_and_comes_back(spark, library):
    rows = [(i if i % 9 else None, t, "x", "y") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows + rows[5:8], SCHEMA).repartition(4)
    got = bpe.digests(bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH))

    def want(doc_id, text):
        ids = library.encode_ordinary(text or "")
        return doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert sorted(map(tuple, got.collect()), key=repr) == sorted((want(d, t) for d, t, *_ in rows + rows[5:8]), key=repr)
    assert bpe.encode(docs.limit(0), PATH, PATTERN).collect() == []


def test_decoding_unknown_ids(spark):
    rows = spark.createDataFrame([(1, [72, 10**6]), (2, None), (3, []), (4, [None]), (5, [39])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(rows, PATH).collect()}
    assert got[1] is None and got[2] is None and got[3] == b"" and got[4] is None and bytes(got[5]) == bpe.vocabulary(PATH).tokens[39]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=20))
def test_pieces_merge_as_in_the_library(pieces):
    vocab = bpe.vocabulary(PATH)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    for piece, ids in zip(pieces, vocab.encode_many(pieces), strict=True):
        want = library._encode_single_piece(piece.encode()) if piece else []
        assert np.frombuffer(ids, "<i4").tolist() == want
        assert vocab.merged_by_heap(piece.encode()) == (np.array(want, "<i4").tobytes() if piece else b"") or piece.encode() in vocab.ranks


def test_all_widths_and_the_heap_agree():
    vocab, rng = bpe.vocabulary(PATH), random.Random(4)
    for n in (1, 2, 3, 5, 17, 100, 255, 700, 1024):
        octets = [bytes(rng.choice(b"abth e\xc3\xa9") for _ in range(n)) for _ in range(20)]
        width = next(w for w in bpe.WIDTHS if w >= n)
        assert vocab.merged_in_matrix(octets, width) == [vocab.merged_by_heap(o) for o in octets]


def test_pair_table_holds_every_pair_and_no_other():
    vocab = bpe.vocabulary(PATH)
    pairs = np.array(list(vocab.pairs), np.int64)
    assert (vocab.table.lookup(pairs[:, 0], pairs[:, 1]) == list(vocab.pairs.values())).all()
    other = [(a, b) for a in range(0, 50_000, 997) for b in range(0, 50_000, 991) if (a, b) not in vocab.pairs]
    assert (vocab.table.lookup(*np.array(other, np.int64).T) == bpe.NONE).all()
