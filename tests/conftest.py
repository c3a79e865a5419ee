import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpuslens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4)


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents of very different length, one of them empty, one word dominating."""
    docs = [
        (i, ["the" if j % 3 == 0 else f"w{(i * j) % 17}" for j in range((i * 7) % 40)]) for i in range(30)
    ]
    return spark.createDataFrame(docs, "doc_id long, tokens array<string>")
