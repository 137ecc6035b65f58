from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefixlake.llm import linededup
from tests.llm.conftest import ODD

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(texts, least, chars=1):
    count = Counter()
    for t in texts:
        count.update({key(x) for x in (t or "").split("\n")})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < chars or count[key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("bound", [linededup.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("chars", [1, 6])
def test_against_brute_force(spark, documents, bound, chars):
    rng = np.random.default_rng(3)
    lines = ["Common line", " common LINE\t", "other", "", "é", "É", "long enough line", "x" * 50]
    texts = [*ODD, *["\n".join(rng.choice(lines, rng.integers(0, 6))) for _ in range(60)]]
    got = linededup.drop_repeated_lines(documents(texts), 5, chars, bound).orderBy("doc_id").collect()
    assert [(r["n_lines"], r["n_dropped"], r["text"]) for r in got] == brute(texts, 5, chars)


def test_empty_and_clashing_columns(spark, documents):
    assert linededup.drop_repeated_lines(documents([])).count() == 0
    docs = documents(["a\nb"] * 12).selectExpr("*", "1 as n_lines", "'k' as h", "2 as shard")
    for bound in (linededup.BROADCAST_BYTES, 0):
        out = linededup.drop_repeated_lines(docs, broadcast_bytes=bound)
        r = out.first()
        assert out.columns == [*docs.columns, "_n_lines", "n_dropped"]
        assert (r["_n_lines"], r["n_dropped"], r["text"], r["h"], r["shard"], r["n_lines"]) == (2, 2, "", "k", 2, 1)


@pytest.mark.parametrize("bound", [linededup.BROADCAST_BYTES, 0])
def test_no_name_is_taken(spark, documents, bound):
    names = ["_id", "id", "row", "hits", "_hits", "h", "salt", "n", "N_Dropped", "doc.id", "odd `name`", "size"]
    docs = documents([*["a\nb\nc"] * 12, None]).select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    out = linededup.drop_repeated_lines(docs, broadcast_bytes=bound)
    assert out.columns == [*docs.columns, "n_lines", "_n_dropped"]
    rows = out.collect()
    assert len(rows) == 13 and all([r[c] for c in names] == list(range(len(names))) and r["text"] == "" for r in rows)


def test_perfect_hash_finds_all_and_only_its_keys():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    counts = np.arange(len(keys)) + 1
    shard = linededup.Shard(**linededup.build_shard(keys, counts))
    assert (shard.probe(keys) == counts).all() and not shard.probe(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)].any()
