from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    def make(texts, lang="en", source="s"):
        rows = [(i, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


#: Texts that every operator must take: null, empty, blank, one word, repeats, other scripts, a very long one.
ODD = [None, "", "   \n\t ", "word", "word", "same text here again", "same text here again", "Ünïcödé ﬁ ２ 漢字\x1c\x85 x", "a b " * 30_000, "line\n\n line \nLINE"]
