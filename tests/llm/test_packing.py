from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prefixlake.llm import packing
from tests.llm.conftest import ODD

PATH = public_tokenizers.path(packing.TOKENIZER)


def test_pieces_and_packing(spark, documents):
    texts = [*ODD, "It's. a,b, x.. y., é. Ü á. don't. WE'LL, 1.2, 3.", "<|endoftext|> <|ENDOFTEXT|>.", *[f"some words {i}, and more." * (i + 1) for i in range(40)]]
    docs = documents(texts).selectExpr("*", "7 as offset", "'z' as piece")
    pieces = packing.tokenized(docs, PATH).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("crc"))
    got = packing.pack(pieces, len(texts)).toPandas()
    tokenizer = Tokenizer.from_file(PATH)
    want = set()
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], np.uint32)
        want |= {(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)}
    assert set(zip(got.doc_id, got.piece, got.start, got.length, got.crc, strict=True)) == want and len(got) == len(want)
    packed = got.sort_values(["sequence_id", "offset"])
    assert (packed.groupby("sequence_id").length.cumsum() - packed.length == packed.offset).all()
    fills = packed.groupby("sequence_id").length.sum()
    assert fills.max() <= 4096 and len(fills) <= -(-fills.sum() // 4096) + 1


def test_empty(documents):
    assert packing.pack(packing.tokenized(documents([]), PATH).drop("ids"), 0).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_every_item_once_and_never_worse_than_best_fit(lengths):
    where, offset = packing.pack_lengths(lengths, 20)
    fills = {}
    for n, b, o in sorted(zip(lengths, where, offset, strict=True), key=lambda x: (x[1], x[2])):
        assert o == fills.get(b, 0)
        fills[b] = o + n
    assert all(f <= 20 for f in fills.values()) and len(fills) <= len(packing.best_fit(lengths, 20))


def test_exchanges_empty_a_bin_that_best_fit_leaves():
    lengths = [6, 6, 5, 5, 5, 3]  # best fit decreasing: 6+3, 6, 5+5, 5; two bins of 15 hold them
    bins = packing.best_fit(lengths, 15)
    better = packing.local_search([[0, 1], [2, 3], [4, 5]], lengths, 15)
    assert len(better) == 2 <= len(bins) and sorted(i for b in better for i in b) == list(range(6))
