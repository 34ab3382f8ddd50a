import os
import tempfile

import pytest

SF = os.environ.get("VEILSCAN_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with further columns that operators use as names of their own."""

    def build(rows, kind="doc_id long, text string, id string, n long, h long, lang string, source string, n_chars long, kept int, label long"):
        return spark.createDataFrame([(i, t, "x", 1, 2, "en", "s", len(t or ""), 3, 4) for i, t in rows], kind)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, ties, repeated rows, a long text and a null id."""
    base = " ".join(f"word{k % 97}x{k * k % 101}" for k in range(400))
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, base),
        (5, base),
        (5, base),
        (None, "no id here at all"),
        (7, "short"),
        (8, (base + " é\n") * 40),
        (9, "ﬂ 中文 don't <|endoftext|> a1b2  　 !!"),
    ]


@pytest.fixture(scope="session")
def folder():
    with tempfile.TemporaryDirectory() as path:
        yield path
