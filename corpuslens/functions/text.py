"""Text column functions: tokenizer, token classes, replacements and repairs.

Everything is an expression on a column, evaluated inside the JVM; replacement rules
and filters are functions from Column to Column that callers can supply.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions import patterns as P
from corpuslens.functions.words import is_stopword

SHY = "­"
Rule = tuple[Callable[[Column], Column], str]

# One alternation in rule order; the last branch takes any single character, so the
# matches are contiguous and extracting all of them walks the text like a cursor.
TOKEN_PATTERN = "|".join(f"(?:{pattern})" for _, pattern in P.TOKEN_RULES) + "|(?s:.)"
_HYPHENATED = f"^(?:{P.NUMERIC}|{P.CENSORED}|{P.WORD})$"


def starts_with(token: Column, pattern: str) -> Column:
    return token.rlike(f"^(?:{pattern})")


def clean_soft_hyphens(token: Column) -> Column:
    """Soft hyphens vanish inside words and numbers; a single one becomes '-'."""
    return (
        F.when(F.instr(token, SHY) == 0, token)
        .when(token == SHY, "-")
        .when(token.rlike(_HYPHENATED), F.replace(token, F.lit(SHY), F.lit("")))
        .otherwise(token)
    )


def strip_soft_hyphen(token: Column) -> Column:
    """The same for tokens known to be words or numbers."""
    return F.when(token == SHY, "-").otherwise(F.replace(token, F.lit(SHY), F.lit("")))


def tokenize(text: Column | str, drop_space: bool = False) -> Column:
    """Tokens in order, runs of white space included unless `drop_space`."""
    text = F.col(text) if isinstance(text, str) else text
    tokens = F.transform(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)), clean_soft_hyphens)
    return F.filter(tokens, lambda t: ~is_space(t)) if drop_space else tokens


def classify(token: Column | str) -> Column:
    """Name of the first rule that matches at the start of the token, null if none does."""
    token = F.col(token) if isinstance(token, str) else token
    (first, pattern), *rest = P.TOKEN_RULES
    kind = F.when(starts_with(token, pattern), first)
    for name, pattern in rest:
        kind = kind.when(starts_with(token, pattern), name)
    return kind


def is_numeric(token: Column) -> Column:
    return starts_with(token, P.NUMERIC)


def is_word(token: Column) -> Column:
    return starts_with(token, P.WORD)


def is_space(token: Column) -> Column:
    return starts_with(token, P.SPACES)


def is_punct(token: Column) -> Column:
    return starts_with(token, P.PUNCT)


def is_parens_bracket(token: Column) -> Column:
    return starts_with(token, P.BRACKET)


def is_quote(token: Column) -> Column:
    return starts_with(token, P.QUOTE)


def is_url(token: Column) -> Column:
    return starts_with(token, P.URL)


def is_email(token: Column) -> Column:
    return starts_with(token, P.EMAIL)


def is_currency(token: Column) -> Column:
    return starts_with(token, P.CURRENCY)


def is_copyright(token: Column) -> Column:
    return starts_with(token, P.COPYRIGHT)


PREDICATES: dict[str, Callable[[Column], Column]] = {
    "is_numeric": is_numeric,
    "is_word": is_word,
    "is_space": is_space,
    "is_punct": is_punct,
    "is_parens_bracket": is_parens_bracket,
    "is_quote": is_quote,
    "is_url": is_url,
    "is_email": is_email,
    "is_currency": is_currency,
    "is_stopword": is_stopword,
    "is_copyright": is_copyright,
}

ENTITY_RULES: tuple[Rule, ...] = ((is_url, "T_URL"), (is_email, "T_EMAIL"), (is_currency, "T_CURRENCY"))
MARKUP = ("@card", "@ord")
MARKUP_EXTRA = ("@card@", "@ord@", "'s")


def replace_token(token: Column, rules: Iterable[Rule] = ENTITY_RULES) -> Column:
    """The value of the first rule that accepts the token, else the token."""
    out = None
    for accepts, value in rules:
        out = F.when(accepts(token), value) if out is None else out.when(accepts(token), value)
    return token if out is None else out.otherwise(token)


def replace_entities(tokens: Column, rules: Iterable[Rule] = ENTITY_RULES) -> Column:
    rules = tuple(rules)
    return F.transform(tokens, lambda t: replace_token(t, rules))


def is_invalid(token: Column, markup: Iterable[str] = MARKUP) -> Column:
    return is_punct(token) | is_space(token) | is_copyright(token) | token.isin(*markup)


def drop_invalid_tokens(tokens: Column, markup: Iterable[str] = MARKUP) -> Column:
    """Without punctuation, white space, copyright signs and markup tokens."""
    markup = tuple(markup)
    return F.filter(tokens, lambda t: ~is_invalid(t, markup))


def remove_stopwords(tokens: Column, extra: Iterable[str] = ()) -> Column:
    extra = tuple(extra)
    return F.filter(tokens, lambda t: ~is_stopword(t, extra))


def normalize(tokens: Column, rules: Iterable[Rule] = ENTITY_RULES, markup: Iterable[str] = MARKUP) -> Column:
    """Valid tokens, entities replaced, lower case."""
    return F.transform(replace_entities(drop_invalid_tokens(tokens, markup), rules), F.lower)


def split_contractions(text: Column) -> Column:
    """A blank between stem and contraction: do n't, he 'll, y' all, 't was."""
    out = F.regexp_replace(text, f"(?i)([a-z]+)({P.CONTRACTION}++)", "$1 $2")
    out = F.regexp_replace(out, f"(?i)\\b(y{P.APOSTROPHE})({P.LETTER}{{3,}})", "$1 $2")
    return F.regexp_replace(out, f"(?i)({P.APOSTROPHE}t)(is|was)", "$1 $2")


# Code points 0x80-0x9F of latin-1 and the windows-1252 characters for the same bytes.
C1_CHARS = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
C1_UNDEFINED = r"[\x{81}\x{8D}\x{8F}\x{90}\x{9D}]"
NOT_PRINTABLE = r"[^\t-\r -~]"


def repair_charset(token: Column) -> Column:
    """Words read as latin-1 whose bytes are windows-1252.

    A word with a byte that windows-1252 does not define keeps its printable ASCII
    characters; such a byte alone becomes a blank.
    """
    broken = token.rlike(C1_UNDEFINED)
    fallback = F.when(F.length(token) > 1, F.regexp_replace(token, NOT_PRINTABLE, "")).otherwise(" ")
    return F.when(broken, fallback).otherwise(F.translate(token, C1_CHARS, CP1252_CHARS))
