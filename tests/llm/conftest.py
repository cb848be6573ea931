import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text) as documents, in three partitions."""

    def make(rows):
        full = [(i, t, None if t is None else "en", None, None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, COLUMNS).repartition(3)

    return make


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks of a few texts, so that small inputs have many."""
    from sunledger.llm import blocks

    real = blocks.in_blocks
    monkeypatch.setattr(blocks, "in_blocks", lambda docs, block_bytes=0: real(docs, 3000))


ODD = [(None, "no id at all, but words"), (1, None), (2, ""), (3, " \n\t "), (4, "same text twice\nin two rows"),
       (4, "same text twice\nin two rows"), (4, "another text of that id"), (5, "日本語 ünï ́ 😀"), (6, "x" * 5000), (7, "ab " * 3000)]
