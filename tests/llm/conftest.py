import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, part int, size long, kept boolean"
WORD = re.compile("[^\x20\x09-\x0d]+")


def lower_az(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="session")
def documents(spark):
    """A function from rows of (doc_id, text[, lang, source]) to documents with extra columns whose names operators use inside."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), 1, 2, 3, True) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(40_000))
#: Nulls, empty and very long texts, ties and repeated rows.
ODD = [(1, None), (2, ""), (3, " \t\n\r "), (4, LONG), (5, "one"), (6, "one two three"), (7, "one two three"), (8, "One TWO three four five six"), (8, "One TWO three four five six"), (9, "é😀 ß\x0b ñ"), (10, None)]
