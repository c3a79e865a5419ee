"""Word-level column functions: the portable word rule and stop-word tests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions import stopwords

WORD_RULE = r"\p{L}+"


def words(text: Column | str) -> Column:
    """Lower-cased runs of letters, in order."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_RULE), F.lit(0))


def is_stopword(token: Column | str, extra: Iterable[str] = ()) -> Column:
    """Case-insensitive membership in the stop list (and `extra`)."""
    token = F.col(token) if isinstance(token, str) else token
    return F.lower(token).isin(*sorted(set(stopwords.ENGLISH) | set(extra)))
