from __future__ import annotations

import pytest

pytest.importorskip("cohortlake.llm")

#: Columns that operators use inside, under the same names.
CLASHES = ["row", "fp", "size", "key", "score", "kept_text", "ids", "length", "rank", "task", "shuffle", "target", "p", "label", "component_id", "taken"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes documents of (doc_id, text[, source]) rows; clash adds columns with the operators' own names."""

    def make(rows, clash=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1]) if r[1] else 0) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.selectExpr("*", *(f"'x' AS `{c}`" for c in CLASHES)) if clash else df

    return make


#: Null, empty and blank texts, one word, odd characters, repeated rows, a null id, and a long text.
ODD = [
    (1, None), (2, ""), (3, "   \n\n "), (4, "word"), (5, "Ünïcödé ✓ 你好 🎉 \x00   x"), (6, "same row"), (6, "same row"), (None, "no id"),
    (7, "the quick brown fox " * 6000), (8, "<|endoftext|> inside <|im_end|>"), (9, "tab\tand\r\nfeed  two  blanks"),
]
