"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL, scored as sparse dot products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from codexlake.llm.common import lowered, mix, slices, table, word_hashes, word_spans
from codexlake.llm.linear import Ftrl, Model, chosen, score, train

SETTINGS = Ftrl(bits=20, alpha=0.3, l1=0.3, l2=0.5, epochs=5, train_rows=8000)
THRESHOLD = 0.3

#: Classes of bytes in a word's shape: lower case, upper case, digit, beyond ASCII; others stand for themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 1


def _shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word with letters and digits replaced by their class and runs cut to one."""
    kinds = _CLASS[raw]
    lens = ends - starts
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    place = np.arange(int(lens.sum())) - np.repeat(first, lens) + np.repeat(starts, lens)
    body = kinds[place]
    fresh = np.empty(len(body), bool)
    fresh[:1], fresh[1:] = True, body[1:] != body[:-1]
    fresh[first] = True
    kept = np.add.reduceat(fresh.astype(np.int64), first)
    ends2 = np.cumsum(kept)
    return word_hashes(body[fresh], ends2 - kept, ends2)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of words and of their shapes, and repeats of the word before; log counts over the text's length."""
    out = []
    with np.errstate(over="ignore"):
        for lo, hi in slices(offsets):
            low = raw[offsets[lo] : offsets[hi]]
            starts, ends, rows = word_spans(low, offsets[lo : hi + 1] - offsets[lo])
            if not len(starts):
                continue
            w, s = word_hashes(lowered(low), starts, ends), _shapes(low, starts, ends)
            same = rows[1:] == rows[:-1]
            again = mix((w[1:] == w[:-1]).astype(np.uint64) + np.uint64(77))[same]
            grams = [w, mix(s + np.uint64(1)), mix(s[:-1] * np.uint64(0xD6E8FEB86659FD93) + s[1:])[same], again]
            own = [rows, rows, rows[1:][same], rows[1:][same]]
            key = (np.concatenate(own).astype(np.uint64) << np.uint64(SETTINGS.bits)) | (np.concatenate(grams) >> np.uint64(64 - SETTINGS.bits))
            uniq, count = np.unique(key, return_counts=True)
            r = (uniq >> np.uint64(SETTINGS.bits)).astype(np.int64)
            n_words = np.bincount(rows, minlength=hi - lo)
            out.append((r + lo, (uniq & np.uint64((1 << SETTINGS.bits) - 1)).astype(np.int64), np.sqrt(count / n_words[r]).astype(np.float32)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def fit_quality(docs: DataFrame, labels: DataFrame, settings: Ftrl = SETTINGS) -> Model:
    """A model of labels.quality; see `linear.train` for nulls, repeats and missing labels."""
    return train(docs, labels, "quality", features, settings)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, with all their columns; see `linear.chosen`. A model without labels keeps all."""
    return chosen(docs, model, features, lambda s: s >= threshold)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text in `documents`. Null and empty texts score the model's bias; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit_quality(docs, table(spark, sf_dir, "labels")), features, THRESHOLD)
