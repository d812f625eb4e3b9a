"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted and the raw corpus, and plain base rules.

Words and word pairs of all documents fall into hashed buckets. Two multinomials over the buckets, smoothed, are
counted: one over every document, one over trusted documents (those that labels call good). A document's score is
the mean over its n-grams of ``log p(trusted) - log p(raw)``; a document is kept if no base rule fails and its
score reaches a fixed threshold.

Both multinomials count whole texts of all their documents: every document of the corpus, and every one that a label
calls good, which a merge join with the labels finds.

Edge cases: null and empty texts have no words and fail the base rules; a document without n-grams scores 0;
without trusted documents every score is 0; repeated ids are documents of their own; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veltra.llm.common import mix, shingle_hashes, slices, small_batches, tidy, word_hashes

#: What the base rules count as symbols, and ASCII white space.
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"

BUCKETS = 1 << 16
SMOOTHING = 20.0
THRESHOLD = -0.15


def buckets(words: np.ndarray, n_buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all words and pairs of words."""
    pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:], 1) if len(words) > 1 else words[:0]
    return (np.concatenate([mix(words), pairs]) & np.uint64(n_buckets - 1)).astype(np.int64)


def repeat_words(words: np.ndarray, window: int = 8) -> int:
    """How many words lie in a window of 8 words that the text holds twice or more."""
    if len(words) < window:
        return 0
    h = shingle_hashes(words, window)
    _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    many = count[inverse] > 1
    if not many.any():
        return 0
    delta = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(many)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + window, -1)
    return int((np.cumsum(delta[:-1]) > 0).sum())


def dup_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def ratios(docs: DataFrame, labels: DataFrame, n_buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """For each bucket log p(trusted) - log p(raw). Counts are added up in tasks, then by bucket."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long")).distinct()
    raw_texts = docs.select("text", F.lit(False).alias("trusted"))
    trusted_texts = docs.select(F.col("doc_id").cast("long"), "text").hint("merge").join(good.hint("merge"), "doc_id", "left_semi").select("text", F.lit(True).alias("trusted"))

    def count(batches):
        total = np.zeros((2, n_buckets), np.int64)
        for b in slices(batches):
            held = [[], []]
            for t, y in zip(b["text"].to_pylist(), b["trusted"].to_pylist(), strict=True):
                if t:
                    held[y].append(buckets(word_hashes(t.encode()), n_buckets))
            for y in (0, 1):
                if held[y]:
                    total[y] += np.bincount(np.concatenate(held[y]), minlength=n_buckets)
        used = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])], ["bucket", "raw", "trusted"])

    rows = raw_texts.unionByName(trusted_texts)
    found = rows.mapInArrow(tidy(count), "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toArrow()  # a row for each bucket at most
    trusted, raw = np.zeros(n_buckets), np.zeros(n_buckets)
    at = found["bucket"].to_numpy()
    trusted[at] = found["trusted"].to_numpy()
    raw[at] = found["raw"].to_numpy()
    if not trusted.sum():
        return np.zeros(n_buckets)
    # the trusted corpus is smaller: smoothing in proportion, so that a bucket both lack gives no score
    share = trusted.sum() / raw.sum()
    p = (trusted + smoothing * share) / (trusted.sum() + smoothing * share * n_buckets)
    q = (raw + smoothing) / (raw.sum() + smoothing * n_buckets)
    return np.log(p) - np.log(q)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, n_buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and score of every document."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(ratios(docs, labels, n_buckets))

    def judge(batches):
        ratio = sent.value
        for b in slices(batches):
            out = []
            for t in b["text"].to_pylist():
                t = t or ""
                raw = t.encode()
                words = word_hashes(raw)
                n = len(words)
                chars = len(t) - (len(raw) - len(raw.translate(None, SPACE)))
                repeats = repeat_words(words)
                failed = n < 20 or 100 * repeats > 30 * n
                score = float(ratio[buckets(words, n_buckets)].mean()) if n else 0.0
                out.append((n, chars, len(raw) - len(raw.translate(None, SYMBOLS)), dup_lines(raw), repeats, failed, not failed and score >= threshold, score))
            types = (pa.int64(),) * 5 + (pa.bool_(), pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(judge), schema)
