from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows, over several partitions."""

    def make(rows, *, extra: str = "", partitions: int = 3):
        full = [
            (
                r[0],
                r[1],
                r[2] if len(r) > 2 else "en",
                r[3] if len(r) > 3 else "src",
                None if r[1] is None else len(r[1]),
            )
            for r in rows
        ]
        frame = spark.createDataFrame(full, DOCUMENTS).repartition(partitions)
        for name in extra.split():
            frame = frame.selectExpr("*", f"'kept' AS {name}")
        return frame

    return make
