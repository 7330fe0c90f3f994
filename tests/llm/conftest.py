from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def make(spark):
    def docs(rows, extra=True):
        names = "doc_id bigint, text string" + (", score string, `key` int, rank int, part int, text_ string, klass string, curve int" if extra else "")
        return spark.createDataFrame([(*r, *(("s", 1, 2, 3, "t", "k", 4) if extra else ())) for r in rows], names)

    return docs
