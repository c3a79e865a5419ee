"""Toxicity by compression: zstandard dictionaries of the two classes, compared window by window.

Passages: one dictionary is trained on windows of ordinary texts, one of the same size on
all windows of the toxic texts.  Windows are runs of words of at least `PASSAGE_BYTES`
bytes, taken twice with borders half a window apart, so that a phrase is whole in one.

Words: each word is a window of its own, too, under the ordinary dictionary and the same one
with a lexicon before it: all words that recur in toxic documents and that ordinary ones
hardly have, however many.  Words of many toxic documents and words of few are two
lexicons, since more of the second are there by chance.  Ordinary words compress alike
with and without a lexicon, so the difference is what the lexicon explains.

A fixed frame around a window, known to all dictionaries, keeps the overhead of so short a
block out of the comparison.  Dictionaries are used as content only, since entropy tables
would shift all lengths.  A document's differences are counted by size for each comparison,
and a logistic calibration turns the counts into a score.  The calibration is fitted
crosswise: documents of one half are compared by dictionaries of the other half.

The model is fitted on the driver on at most `TOXIC_DOCS` and `ORDINARY_DOCS` labelled
documents and `SAMPLE_BYTES` bytes of text (a stated sample; beyond the bytes fewer
documents are taken, each whole).  Every document is scored by its whole text, in place.

Rows: null and empty texts have no windows and get the score of such a document; without
labels of both classes every score is the share of toxic labels, 0 if there are none.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate, islice

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.labelled import Logistic, held_out, labelled_texts

FOLDS, HELD_OUT = 4, 2
TOXIC_DOCS, ORDINARY_DOCS = 4000, 8000
SAMPLE_BYTES = 64 << 20
THRESHOLD = 0.3
LEVEL, PASSAGE_LEVEL = 9, 3
WINDOW_BYTES = 1
PASSAGE_BYTES = 48
DICTIONARY_BYTES = 1 << 16  # size of each trained dictionary
TRAINING_WINDOWS = 40_000  # of ordinary texts
COMMON = 200  # a word is in the first lexicon if one in so many toxic documents has it
FRAME = b"\x01\x02 window \x03\x04"
LOWEST, HIGHEST = -2, 7  # differences are counted between these
VALUES = np.arange(LOWEST, HIGHEST + 1)
TOGETHER = 1 << 18  # characters of texts whose windows are compressed in one call
HELD = 400_000  # window lengths remembered by a task
_TO_SPACE = bytes.maketrans(b".,!?#$%&*|", b" " * 10)


def windows(text: str | None, size: int) -> list[bytes]:
    """Runs of lower-cased words of at least `size` bytes, split at white space and sentence marks."""
    words = (text or "").encode().lower().translate(_TO_SPACE).split()
    if size <= 1:
        return words
    out, held, length = [], [], 0
    for word in words:
        held.append(word)
        length += len(word) + 1
        if length >= size:
            out.append(b" ".join(held))
            held, length = [], 0
    return out + ([b" ".join(held)] if held else [])


def passages(text: str | None, size: int = PASSAGE_BYTES) -> list[bytes]:
    """The windows of at least `size` bytes and those that begin half a window later."""
    return _passages(windows(text, 1), size)


def _passages(words: list[bytes], size: int = PASSAGE_BYTES) -> list[bytes]:
    """The passages of a text's words, cut from the joined words at the borders of half windows."""
    joined, ends, half = b" ".join(words), list(accumulate(len(w) + 1 for w in words)), max(size // 2, 1)
    borders = [0]
    while words and borders[-1] < ends[-1]:
        borders.append(ends[min(bisect_left(ends, borders[-1] + half), len(ends) - 1)])
    if len(borders) == 2:
        return [joined]
    return [joined[start : end - 1] for start, end in zip(borders, borders[2:], strict=False)]


def train(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of few samples, which cannot be trained on, their joined bytes."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def _chosen(texts: list[str], count: int) -> list[bytes]:
    """At most `count` training windows of the texts, chosen at random by their numbers; only these are kept."""
    numbers = list(range(sum(len(windows(text, 96)) for text in texts)))
    np.random.default_rng(0).shuffle(numbers)
    place = {number: i for i, number in enumerate(numbers[:count])}
    found, number = [b""] * len(place), 0
    for text in texts:
        for window in windows(text, 96):
            if number in place:
                found[place[number]] = b" " + window + b" "
            number += 1
    return found


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    parameters = zstandard.ZstdCompressionParameters.from_level(
        level, source_size=64, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    raw.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=raw, compression_params=parameters)


def _gains(compressors: list[zstandard.ZstdCompressor], found: list[bytes]) -> np.ndarray:
    """Bytes by which each framed window is shorter under each compressor than under the first, a row for each."""
    before, after = FRAME + b" ", b" " + FRAME
    framed = [before + window + after for window in found]
    lengths = lambda c: map(len, c.multi_compress_to_buffer(framed) if framed else [])
    ordinary, *others = [np.fromiter(lengths(c), np.int64, len(framed)) for c in compressors]
    return np.array([ordinary - other for other in others]).clip(LOWEST, HIGHEST)


class Dictionaries:
    """The dictionaries, trained on (label, text) pairs: ordinary, with each of two lexicons, toxic."""

    def __init__(self, rows: list[tuple[int, str]], window: int = WINDOW_BYTES):
        self.window = window
        seen, elsewhere, toxic, ordinary = Counter(), Counter(), 0, 0
        for label, text in rows:
            if label:
                seen.update(set(windows(text, 1)))
                toxic += 1
        for label, text in rows:
            if not label:
                elsewhere.update(seen.keys() & windows(text, 1))  # other words are never asked for
                ordinary += 1
        telling = [w for w, c in seen.items() if c >= 2 and c / toxic > 8 * (elsewhere[w] + 0.5) / max(ordinary, 1)]
        common = {w for w in telling if seen[w] >= max(2, toxic // COMMON)}
        lexicons = common, set(telling) - common
        ordinary_part = train(_chosen([text for label, text in rows if not label], TRAINING_WINDOWS), DICTIONARY_BYTES)
        hostile = train([b" " + w + b" " for label, text in rows if label for w in windows(text, 96)], DICTIONARY_BYTES)
        joined = [b" " + b"  ".join(sorted(lexicon, key=lambda w: (seen[w], w))) + b" " for lexicon in lexicons]
        with_words = [words + ordinary_part + FRAME for words in joined]
        self.contents = [ordinary_part + FRAME, *with_words], [ordinary_part + FRAME, hostile + FRAME]
        self._ready()

    def _ready(self) -> None:
        self.held: dict[bytes, tuple[int, int]] = {}
        self.by_word = [_compressor(content, LEVEL) for content in self.contents[0]]
        self.by_passage = [_compressor(content, PASSAGE_LEVEL) for content in self.contents[1]]

    def __getstate__(self) -> dict:
        return {"window": self.window, "contents": self.contents}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def differences(self, found: list[bytes]) -> np.ndarray:
        """Bytes by which each window is shorter with each of the two lexicons, a row for each window."""
        missed = list(dict.fromkeys(w for w in found if w not in self.held))
        new = dict(zip(missed, zip(*_gains(self.by_word, missed).tolist(), strict=True), strict=True))
        out = np.array([new.get(w) or self.held[w] for w in found], np.int64).reshape(-1, 2)
        self.held.update(islice(new.items(), max(HELD - len(self.held), 0)))
        return out

    def difference(self, window: bytes) -> int:
        """Bytes by which the window is shorter with the lexicon that explains more of it."""
        return max(self.differences([window])[0].tolist(), key=abs)

    def features(self, text: str | None) -> list[float]:
        """For each comparison logarithms of the counts of differences, their shares, the largest and their sum; the number of windows."""
        return self.all_features([text])[0]

    def all_features(self, texts: list[str | None]) -> list[list[float]]:
        """The features of each text; about `TOGETHER` characters are compared at once, since short blocks compress faster by the thousand."""
        out, batch, size = [], [], 0
        for text in texts:
            batch.append(text)
            size += len(text or "")
            if size >= TOGETHER:
                out += self._features(batch)
                batch, size = [], 0
        return out + list(self._features(batch))

    def _features(self, texts: list[str | None]) -> Iterator[list[float]]:
        found = [windows(text, self.window) for text in texts]
        parts = [_passages(words if self.window <= 1 else windows(text, 1)) for words, text in zip(found, texts, strict=True)]
        seen = [Counter(words) for words in found]  # a word of a text is looked up once
        by_passage = _gains(self.by_passage, [part for own in parts for part in own])[0]
        by_word = self.differences([word for own in seen for word in own])
        w = p = 0
        for words, times, own in zip(found, seen, parts, strict=True):
            yield _counted(by_word[w : w + len(times)], np.fromiter(times.values(), np.int64, len(times)), by_passage[p : p + len(own)], len(words))
            w, p = w + len(times), p + len(own)


def _counted(by_word: np.ndarray, times: np.ndarray, by_passage: np.ndarray, n_words: int) -> list[float]:
    out = [float(np.log1p(n_words))]
    for gains, weights, n in ((by_word[:, 0], times, n_words), (by_word[:, 1], times, n_words), (by_passage, None, len(by_passage))):
        counts = np.bincount(gains - LOWEST, weights, HIGHEST - LOWEST + 1)
        gain = (counts * VALUES)[VALUES >= 2].sum()
        largest = VALUES[counts > 0].max() if n else 0
        out += [*np.log1p(counts).tolist(), *(counts / max(n, 1))[1 - LOWEST :].tolist(), float(largest), float(np.log1p(gain))]
    return out


class Classifier:
    """Dictionaries and calibration; `constant` is the score where nothing could be learned."""

    def __init__(self, rows: list[tuple[int, int, str]], window: int = WINDOW_BYTES, featured: Callable | None = None):
        """`rows`: (label, half, text); ``featured(dictionaries, half)``: (label, features) of the rows of one half, in their order."""
        labels = [label for label, _, _ in rows]
        self.constant = None
        if len(set(labels)) < 2:
            self.constant = float(labels[0]) if labels else 0.0
            return
        features, wanted = [], []
        for half in (0, 1):
            other = Dictionaries([(label, text) for label, h, text in rows if h != half], window)
            if featured:
                own = featured(other, half)
            else:
                own = [(label, other.features(text)) for label, h, text in rows if h == half]
            features += [values for _, values in own]
            wanted += [label for label, _ in own]
        self.calibration = Logistic(np.array(features), np.array(wanted, float))
        self.dictionaries = Dictionaries([(label, text) for label, _, text in rows], window)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if not texts:
            return np.zeros(0)
        return self.calibration.scores(np.array(self.dictionaries.all_features(texts)))


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """The classifier of a bounded sample of the labelled documents outside the held-out fold.

    The driver trains the dictionaries; the sample is compared by them in tasks, so the
    driver holds no compressed windows.
    """
    sample = labelled_texts(docs, labels, "toxic", FOLDS, HELD_OUT, {1: TOXIC_DOCS, 0: ORDINARY_DOCS})
    size = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > SAMPLE_BYTES:
        sample = sample.where(F.crc32(F.col("text").cast("binary")) < (1 << 32) * SAMPLE_BYTES / size / 2)
    place = F.md5("text").alias("place")  # rows that agree in it have the same text

    def featured(dictionaries: Dictionaries, half: int) -> list[tuple[int, list[float]]]:
        own = sample.where(F.col("half") == half).select("label", place, _features_column(dictionaries)("text").alias("features"))
        return [(r.label, r.features) for r in sorted(own.collect(), key=lambda r: (r.label, r.place))]

    rows = sample.select("label", "half", "text", place).toPandas().sort_values(["label", "half", "place"])
    return Classifier(list(rows[["label", "half", "text"]].itertuples(index=False, name=None)), featured=featured)


def _features_column(dictionaries: Dictionaries):
    """The comparison by `dictionaries` as a function of a text column."""

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(dictionaries.features(t), float) for t in texts.tolist()], dtype=object)

    return features


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents' columns are left out but for doc_id: held_out, score, predicted."""
    score = score_column(fit(docs, labels))
    rows = docs.select("doc_id", held_out(FOLDS, HELD_OUT).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def score_column(classifier: Classifier):
    """The classifier as a function of a text column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(classifier.scores(texts.tolist()))

    return score


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold."""
    return docs.where(score_column(fit(docs, labels))(F.col("text")) < THRESHOLD)
