import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"

#: Texts of every odd kind: null, empty, blanks and signs only, one word, ties, very long, no spaces at all.
ODD = [None, "", " \n\t", "!!! ###", "word", "word", "a b c d", "a b c d", "x" * 50_000, "long " * 30_000, "é ▁ 日本 \x00 \r\n z", "the end. " * 3]


@pytest.fixture
def odd(spark):
    """Documents with nulls, repeated rows and columns whose names clash with the operators' own."""
    rows = [(i if i != 5 else 4, t, "en", None, 0, "k") for i, t in enumerate(ODD)] + [(None, "nothing to see", None, "s", None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, ledger string")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF
