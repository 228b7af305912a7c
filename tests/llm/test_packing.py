from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from flowlens.llm import packing

SCHEMA = "doc_id long, text string"


def ids_of(text):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, out, size=4096):
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == {i for i, _ in rows}
    for i, text in rows:
        ids, at = ids_of(text), 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            part = np.array(ids[at : at + r["length"]], dtype="<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
            at += r["length"]
            assert r["length"] == size or at == len(ids)
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(by_seq), sum(r["length"] for r in out)


def test_pieces_and_offsets(spark):
    rng = random.Random(2)
    words = ["the", "Straße", "naïve", "<|endoftext|>", "it's", "42", "ﬁne", "a b", "é́", "Σίσυφος", "ΟΔΟΣ", "...", "日本語"]
    rows = [(i, rng.choice([" ", "\n", "\t"]).join(rng.choice(words) for _ in range(rng.choice([1, 30, 900, 9000])))) for i in range(40)]
    rows += [(100, ""), (101, None), (102, "   "), (103, "x" * 5000)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA)).collect()
    n, total = check(rows, out)
    assert n <= -(-total // 4096) + 2
    assert {tuple(r) for r in out} == {tuple(r) for r in packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}


def test_empty_table_repeats_and_sequences(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b"), (1, "a b"), (None, "c")]
    df = spark.createDataFrame([(*r, "s", 7) for r in rows], SCHEMA + ", sequence_id string, length int")
    assert packing.pack(df).count() == 3
    seqs = packing.sequences(spark.createDataFrame([(1, "a b"), (2, "c d e")], SCHEMA)).collect()
    assert len(seqs) == 1 and seqs[0]["n_tokens"] == 7
    got = np.frombuffer(seqs[0]["ids"], dtype="<u4").tolist()
    assert got in ([*ids_of("a b"), *ids_of("c d e")], [*ids_of("c d e"), *ids_of("a b")])


def test_open_bins_take_the_fullest_that_fits():
    bins = packing.OpenBins(10, 2)
    assert bins.place(6) == (0, 0)
    assert bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)  # bin 1 has exactly 3 left
    assert bins.place(5) == (2, 0)
    assert bins.place(9) == (3, 0)  # bin 0 (4 left) is the fullest of the two open ones and closes
    assert bins.place(4) == (2, 5)


def test_sequences_hold_rows_without_ids_and_equal_ids(spark):
    texts = [(1, "alpha beta"), (None, "gamma delta epsilon"), (None, None), (1, "alpha beta"), (1, "zeta eta theta")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    total = packing.pack(docs).agg({"length": "sum"}).first()[0]
    rows = packing.sequences(docs).collect()
    assert sum(r["n_tokens"] for r in rows) == total
    want = b"".join(sorted(ids for ids in (bytes(r["ids"]) for r in packing.token_pieces(docs, with_ids=True).collect())))
    assert sorted(b"".join(bytes(r["ids"]) for r in rows)) == sorted(want)
