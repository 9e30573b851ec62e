"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from codexlake.llm.common import distinct_by_row, lowered, mix, slices, table, word_hashes, word_spans
from codexlake.llm.linear import Ftrl, Model, chosen, score, train

SETTINGS = Ftrl(bits=22, alpha=2.0, l1=3.0, l2=0.5, epochs=3, train_rows=12000, prior=0.05)
THRESHOLD = 0.5
#: What a pair of words counts against a single word.
PAIR_VALUE = 0.3

#: Bytes that a word may begin and end with: letters, digits and what is beyond ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[128:] = True


def trimmed_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word without the punctuation around it; a word of punctuation stays whole."""
    hashes, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi in slices(offsets):
        low = lowered(raw[offsets[lo] : offsets[hi]])
        starts, ends, rows = word_spans(low, offsets[lo : hi + 1] - offsets[lo])
        if len(starts):
            letters = np.flatnonzero(_LETTER[low])
            a, b = np.searchsorted(letters, starts), np.searchsorted(letters, ends)
            some = b > a
            starts[some], ends[some] = letters[a[some]], letters[b[some] - 1] + 1
            hashes.append(word_hashes(low, starts, ends))
            own.append(rows + lo)
    return np.concatenate(hashes), np.concatenate(own)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words, word pairs and pairs with one word between occur in each text, hashed to indices; each counts once."""
    h, rows = trimmed_words(raw, offsets)
    grams, own = [h], [rows]
    with np.errstate(over="ignore"):
        for gap, factor in ((1, 0xD6E8FEB86659FD93), (2, 0xA5A3564E27F8862B)):
            same = rows[:-gap] == rows[gap:]
            grams.append(mix(h[:-gap] * np.uint64(factor) + h[gap:])[same])
            own.append(rows[:-gap][same])
    # the lowest bit tells single words from pairs, so that either keeps its value
    tagged = [(g >> np.uint64(64 - SETTINGS.bits) << np.uint64(1) | np.uint64(k > 0)) & np.uint64((1 << SETTINGS.bits) - 1) for k, g in enumerate(grams)]
    index, rows = distinct_by_row(np.concatenate(tagged), np.concatenate(own))
    return rows, index.astype(np.int64), np.where(index & np.uint64(1), PAIR_VALUE, 1).astype(np.float32)


def fit_toxicity(docs: DataFrame, labels: DataFrame, settings: Ftrl = SETTINGS) -> Model:
    """A model of labels.toxic; see `linear.train` for nulls, repeats and missing labels."""
    return train(docs, labels, "toxic", features, settings)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns; see `linear.chosen`. A model without labels drops none."""
    return chosen(docs, model, features, lambda s: s < threshold)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text in `documents`. Null and empty texts score the model's bias; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")), features, THRESHOLD)
