"""Token counts of a byte-level BPE tokenizer with a whole-token shortcut.

The tokenizer cuts a text into pre-tokens and merges each one for itself, so a text's count is
the sum over its pre-tokens.  ``prove`` finds out beforehand, with the library, which strings of
the vocabulary stand alone as one pre-token and come out as exactly their own token.  A
pre-token of this list counts 1 wherever it stands; only the others are merged.

White space never belongs to a pre-token (``prove`` refuses other tokenizers), so texts are
counted by the pieces between ASCII white space, and a piece's count is remembered in a table of
bounded size.  A piece of printable ASCII is cut by the tokenizer's own pattern in Python, if
that agrees with the library on all pairs of such characters; any other piece goes through the
library's normalizer and pre-tokenizer.  Special strings inside a text are one token each, as
the library has it, and part the text before it is normalized.

Nothing is shuffled: rows keep their columns and partitions.  The tokenizer file (parameter)
travels with the tasks; its size is that of the file, whatever the documents are.

Rows: a null text counts as the empty text, with no tokens; repeated rows and repeated or null
ids are rows like any other; an empty table gives an empty result; the added columns replace
columns of the same name; a text is taken whole, whatever its length.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from corpuslens.llm.common import portions, unpacked, whole

PRINTABLE = [chr(c) for c in range(0x21, 0x7F)]
SPACES = " \t\n\r\x0b\x0c"
SPACE_BYTE = re.compile(rb"\s")
REMEMBERED = 1 << 18  # pieces whose counts a task keeps
LONG_PIECE = 64  # bytes; longer pieces are seldom met twice and are not kept
COUNTS = "n_tokens long, n_direct long, n_merged long"


@dataclass(frozen=True)
class Proof:
    """What is known of a tokenizer before any text is read."""

    source: bytes  # the tokenizer file
    direct: frozenset[str]  # pre-tokens, byte-level, that are one token each
    specials: tuple[str, ...]  # strings that are taken out of a text as one token each
    pattern: str | None  # cuts printable ASCII as the library does


def _layout(source: bytes) -> tuple[str, tuple[str, ...]]:
    """The split pattern and the special strings; ValueError for layouts that this method does not cover."""
    config = json.loads(source)
    steps = (config["pre_tokenizer"] or {}).get("pretokenizers", [])
    first = steps[0] if steps else {}
    plain = (
        config["model"]["type"] == "BPE"
        and not config["model"].get("dropout")
        and [s["type"] for s in steps] == ["Split", "ByteLevel"]
        and first["behavior"] == "Removed" and first["invert"] and "Regex" in first["pattern"]
        and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    )
    added = config["added_tokens"]
    if not plain or any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
        raise ValueError("needs a byte-level BPE whose pre-tokens are cut by one pattern, and plain special strings")
    specials = sorted((a["content"] for a in added), key=len, reverse=True)
    if any(s.split() != [s] for s in specials):
        raise ValueError("special strings must not hold white space")
    return first["pattern"]["Regex"], tuple(specials)


def _proven_strings(tokenizer: Tokenizer) -> frozenset[str]:
    """Byte-level pre-tokens that are one token: each vocabulary string is cut and encoded alone."""
    suffix = tokenizer.model.end_of_word_suffix or ""
    byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    byte_of = {byte_level.pre_tokenize_str(chr(c))[0][0]: c for c in range(0x80)}
    # The other bytes occur only inside characters of several bytes: read them off such characters.
    for c in [*range(0x80, 0x800), *range(0x800, 0xD800, 0x40), *range(0x10000, 0x110000, 0x1000)]:
        byte_of |= dict(zip(byte_level.pre_tokenize_str(chr(c))[0][0], chr(c).encode(), strict=True))
    found = {}
    for entry, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if not entry.endswith(suffix):
            continue
        body = entry[: len(entry) - len(suffix)]
        try:
            text = bytes(byte_of[c] for c in body).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        found[text] = (body, number)
    encoded = tokenizer.encode_batch(list(found), add_special_tokens=False)
    alone = zip(found.items(), encoded, strict=True)
    return frozenset(
        body
        for (text, (body, number)), e in alone
        if e.ids == [number] and [w for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)] == [body]
    )


def prove(path: str) -> Proof:
    """Reads a tokenizer file and proves its whole-token strings, once, before the job."""
    with open(path, "rb") as file:
        source = file.read()
    pattern, specials = _layout(source)
    tokenizer = Tokenizer.from_buffer(source)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
    for left in (*PRINTABLE, "é", "1", "　"):
        for space in SPACES:
            cut = [w for w, _ in split.pre_tokenize_str(f"{left}{space}{left}")]
            if "".join(cut) != left * 2 and left.strip():
                raise ValueError("white space must not belong to pre-tokens")
    own = regex.compile(pattern)
    pairs = [a + b for a in PRINTABLE for b in PRINTABLE] + [f"{a}'{b}" for a in PRINTABLE for b in "strevmldx"]
    agrees = all(own.findall(p) == [w for w, _ in split.pre_tokenize_str(p)] for p in pairs)
    agrees = agrees and all(tokenizer.normalizer.normalize_str(c) == c.lower() for c in PRINTABLE)
    return Proof(source, _proven_strings(tokenizer), specials, pattern if agrees else None)


class Counter(dict):
    """Counts of pieces between white space as (tokens, direct, merged); remembers short ones."""

    def __init__(self, proof: Proof):
        super().__init__()
        self.tokenizer = Tokenizer.from_buffer(proof.source)
        self.direct = proof.direct
        self.specials = re.compile("(?:" + "|".join(map(re.escape, proof.specials)) + ")") if proof.specials else None
        self.lowered = tuple(s.lower().encode() for s in proof.specials)
        self.plain = regex.compile(proof.pattern).findall if proof.pattern else None
        self.printable = re.compile("[!-~]*").fullmatch

    def __missing__(self, piece: bytes) -> tuple[int, int, int]:
        text = piece.decode()
        if len(self) >= REMEMBERED:
            self.clear()
        counts = self._counted(text)
        if len(piece) <= LONG_PIECE:
            self[piece] = counts
        return counts

    def _counted(self, text: str) -> tuple[int, int, int]:
        parts = self.specials.split(text) if self.specials else [text]
        direct = merged = 0
        for part in parts:
            for word in self._pre_tokens(part) if part else ():
                if word in self.direct:
                    direct += 1
                else:
                    merged += len(self.tokenizer.model.tokenize(word))
        return len(parts) - 1 + direct + merged, direct, merged

    def _pre_tokens(self, text: str) -> list[str]:
        if self.plain and self.printable(text):
            return self.plain(text.lower())
        normal = self.tokenizer.normalizer.normalize_str(text)
        return [word for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def of(self, text: str | None) -> tuple[int, int, int]:
        """(tokens, tokens counted directly, tokens of merged pre-tokens) of a whole text."""
        data = (text or "").encode()
        if data.isascii():
            low = data.lower()  # fewer different pieces; special strings keep their case
            data = data if any(s in low for s in self.lowered) else low
        tokens = direct = merged = 0
        for portion in portions(data, SPACE_BYTE):
            for piece in portion.split():  # exactly the ASCII white space
                t, d, m = self[piece]
                tokens, direct, merged = tokens + t, direct + d, merged + m
        return tokens, direct, merged


def token_counts(docs: DataFrame, proof: Proof, limit: int | None = None, text: str = "text") -> DataFrame:
    """`docs` with n_bytes, n_tokens, n_direct (whole-token pre-tokens), n_merged (tokens of the others),
    and over_limit where a limit is given."""

    @F.pandas_udf(COUNTS)
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = Counter(proof)
        for texts in batches:
            rows = [counter.of(t) for t in texts]
            yield pd.DataFrame(rows, columns=["n_tokens", "n_direct", "n_merged"], dtype="int64")

    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    rows = docs.select(whole(docs), size.alias("_bytes"), counted(F.col(text)).alias("_n"))
    added = {"n_bytes": F.col("_bytes")} | {c: F.col("_n")[c] for c in ("n_tokens", "n_direct", "n_merged")}
    if limit is not None:
        added["over_limit"] = F.col("_n")["n_tokens"] > limit
    return unpacked(rows, **added)
