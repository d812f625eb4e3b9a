"""Toxicity: a linear-chain conditional random field tags toxic tokens; documents are scored from its marginals.

Token labels come from document labels: a word form or stem that toxic training documents hold far more often
than clean ones (by the log-likelihood ratio of its document counts) labels its tokens in toxic documents; all
other tokens are clean. The chain has two labels, hashed features of the word (form, stems, character 4-grams) and transitions, and is fitted by the exact gradient from forward-backward. A document's score is a
logistic function of its largest marginals and its expected number of toxic tokens; tokens at or over one half are
the offending offsets.

The fit uses at most ``most_rows`` labelled documents of each class, and ``most_bytes`` of text, outside fold 2 of
crc32(doc_id) mod 4; labels, language, source and id are no inputs of a score. All documents are scored over their whole text.

Tokens are cut at ASCII white space and at every inner character that is no letter, mark, digit, format character or
apostrophe in Unicode. A form longer than 15 characters may be text without spaces: each of its characters may begin a
word, features are those of the 15 characters from there, and the beginning that favours toxic most gives its score.

Fitting cuts documents into runs of 64 tokens and uses all runs of clean documents, and all runs with a labelled token
of toxic ones; their other runs are left out, since what is toxic there is not known.

Edge cases: null and empty texts score the logistic's value for no toxic token; with no toxic or no clean label
to learn from every score is 0; a null id has no label and is not held out; repeated ids are scored one by one,
and of repeated labels the higher counts; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veltra.llm.common import BLANK, mix, release, slices, small_batches, tidy

FEATURE_BITS = 18
DOCUMENT_FEATURES = 5
GRAMS = 12  # 4-grams of a word, from its beginning
NONE = 1 << FEATURE_BITS  # a feature that weighs nothing


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


# ---------------------------------------------------------------- features


def _joins(c: str) -> bool:
    return c in "'\u2019" or unicodedata.category(c)[0] in "LMN" or unicodedata.category(c) == "Cf"


def cuts_of(word: str) -> list[tuple[int, int]]:
    """Where the tokens of a word between ASCII white space start and end; what is at its ends stays with them."""
    if word.isalnum():
        return [(0, len(word))]
    runs, start = [], None
    for i, c in enumerate(word):
        if not _joins(c):
            start = None
        elif start is None:
            start = i
            runs.append([i, i + 1])
        else:
            runs[-1][1] = i + 1
    runs = [r for r in runs if any(c.isalnum() for c in word[r[0] : r[1]])]
    if len(runs) < 2:
        return [(0, len(word))]
    runs[0][0], runs[-1][1] = 0, len(word)
    return [(a, b) for a, b in runs]


_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def form(token: str) -> str:
    """The token in lower case without what is no letter or digit at its ends."""
    return _EDGES.sub("", token.lower())


def tokens(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Forms, which form each token of the texts has, and how many tokens each text has.

    Words are found all at once, and each distinct one is cut and brought to its form once.
    """
    raw = "\n".join(texts).encode()
    u = np.frombuffer(raw, np.uint8)
    blank = BLANK[u]
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(u[~blank].tobytes())]).dictionary_encode()
    forms, count = [], []
    for w in b"\n".join(words.dictionary.to_pylist()).decode().split("\n"):
        if w.isalnum():
            forms.append(w.lower())
            count.append(1)
        else:
            cuts = cuts_of(w)
            forms += [form(w[i:j]) for i, j in cuts]
            count.append(len(cuts))
    which, n = words.indices.to_numpy(), np.array(count, np.int64)
    each = n[which]
    end = np.cumsum(each)
    ids = np.repeat((np.cumsum(n) - n)[which] - (end - each), each) + np.arange(int(end[-1]))
    size = np.fromiter((len(t.encode()) + 1 for t in texts), np.int64, len(texts))
    until = np.concatenate([[0], end])[np.searchsorted(starts, np.cumsum(size))]
    return forms, ids, np.diff(until, prepend=0)


class Hashes:
    """64-bit hashes of forms: ``whole``, and ``run[k]`` of the k = 4, 5 and 6 characters from each place of all forms put
    end to end; ``first`` and ``length`` say where each form stands there."""

    def __init__(self, forms: list[str]):
        c = np.frombuffer("".join(forms).encode("utf-32-le"), "<u4").astype(np.uint64)
        self.length = np.fromiter(map(len, forms), np.int64, len(forms))
        self.first = np.cumsum(self.length) - self.length
        ahead = np.concatenate([c, np.zeros(6, np.uint64)])
        self.run: dict[int, np.ndarray] = {}
        h = np.zeros(len(c) + 1, np.uint64)
        for k in range(1, 7):
            h = h * np.uint64(0x100000001B3) + ahead[k - 1 : len(c) + k] + np.uint64(1)
            if k > 3:
                self.run[k] = h
        # a form: the sum of its characters, each mixed with its place in it
        place = np.arange(len(c)) - np.repeat(self.first, self.length)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(c + np.uint64(1) + (place.astype(np.uint64) << np.uint64(32)), 21))])
        self.whole = sums[self.first + self.length] - sums[self.first]


class Features:
    """Hashed features of forms: the form, beginnings of 4 to 6 characters, and 4-grams, by each place a word may begin."""

    def __init__(self, forms: list[str]):
        hashes = Hashes(forms)
        first, length, runs = hashes.first, hashes.length, hashes.run
        slot = lambda x, seed: (mix(x, seed) & np.uint64(NONE - 1)).astype(np.int32)
        at = np.arange(len(forms))
        self.whole = np.where(length > 0, slot(hashes.whole, 22), NONE).astype(np.int32)
        n = np.maximum(1, length - 3)  # grams, or one place for what is shorter
        last = np.cumsum(n)
        own = np.repeat(at, n)
        place = np.repeat(first - (last - n), n) + np.arange(len(own))
        self.grams = np.full(len(own), NONE, np.int32)
        long = length[own] > 3
        self.grams[long] = slot(runs[4][place[long]], 23)
        size = np.where(n > GRAMS, n, 1)
        self.start = np.cumsum(size) - size  # of each form's beginnings
        self.owner = np.repeat(at, size)
        shift = np.arange(len(self.owner)) - self.start[self.owner]
        self.prefixes = np.full((len(self.owner), 3), NONE, np.int32)
        for j, k in enumerate((4, 5, 6)):
            fits = length[self.owner] >= shift + k
            self.prefixes[fits, j] = slot(runs[k][(first[self.owner] + shift)[fits]], 24 + j)
        self.at = (last - n)[self.owner] + shift  # the first gram of a beginning
        self.end = np.minimum(self.at + GRAMS, last[self.owner])
        self.several = bool((size > 1).any())

    def scores(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of each form, and the beginning that gives it."""
        sums = np.concatenate([[0.0], np.cumsum(weights[self.grams])])
        by_place = weights[self.prefixes].sum(1) + sums[self.end] - sums[self.at]
        best = self.start
        if self.several:
            top = np.maximum.reduceat(by_place, self.start)
            hits = np.flatnonzero(by_place == top[self.owner])
            best = hits[np.searchsorted(self.owner[hits], np.arange(len(self.start)))]
        return weights[self.whole] + by_place[best], best

    def used(self, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features of each form from the given beginning, and their forms."""
        n = self.end[best] - self.at[best]
        forms = np.arange(len(best))
        owner = np.repeat(forms, n)
        grams = self.grams[self.at[best][owner] + np.arange(len(owner)) - (np.cumsum(n) - n)[owner]]
        return np.concatenate([self.whole, self.prefixes[best].ravel(), grams]), np.concatenate([forms, np.repeat(forms, 3), owner])


# ---------------------------------------------------------------- the chain


def marginals(scores: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(toxic) of every token: exact forward-backward over many texts side by side.

    ``scores``: for each token how much its features favour the toxic label; ``sizes``: tokens in each text;
    ``trans``: log weights [from][to]. Messages are log ratios, so nothing under- or overflows.
    """
    out = np.zeros(len(scores))
    if not len(scores):
        return out
    order = np.argsort(-sizes, kind="stable")
    start, n = (np.cumsum(sizes) - sizes)[order], sizes[order]
    longest = int(n[0])
    active = np.searchsorted(-n, -np.arange(longest), "left")  # texts with more than t tokens
    (t00, t01), (t10, t11) = trans

    def step(m: np.ndarray, a: float, b: float, c: float, d: float) -> np.ndarray:
        """The log ratio behind a transition, of the log ratio before it."""
        return np.logaddexp(a, b + m) - np.logaddexp(c, d + m)

    f = np.zeros(len(scores))
    m = scores[start].copy()
    m[n == 0] = 0
    f[start[: active[0]]] = m[: active[0]]
    for t in range(1, longest):
        k = active[t]
        m = scores[start[:k] + t] + step(m[:k], t01, t11, t00, t10)
        f[start[:k] + t] = m
    back = np.zeros(len(n))
    out[:] = f
    for t in range(longest - 2, -1, -1):
        k = active[t + 1]
        at = start[:k] + t
        back[:k] = step(back[:k] + scores[at + 1], t10, t11, t00, t01)
        out[at] += back[:k]
    return 1 / (1 + np.exp(-np.clip(out, -700, 700)))


@dataclass
class Model:
    weights: np.ndarray  # by hashed feature, and 0 for NONE
    bias: float
    trans: np.ndarray
    document: np.ndarray  # intercept, and factors of document_features()

    def word_scores(self, forms: list[str]) -> np.ndarray:
        """How much each form's features favour the toxic label."""
        return Features(forms).scores(self.weights)[0] + self.bias if forms else np.zeros(0)


# ---------------------------------------------------------------- fitting


def stem_ids(forms: list[str]) -> np.ndarray:
    """What token labels are learned for: numbers of each form itself and of its beginnings of 4 to 6 characters; -1: none.

    Equal stems have equal numbers, by 64 bits of hash.
    """
    h = Hashes(forms)
    own = [h.whole, *(mix(h.run[k][h.first], 30 + k) for k in (4, 5, 6))]
    _, ids = np.unique(np.stack(own, 1), return_inverse=True)
    there = np.stack([h.length > k for k in (0, 4, 5, 6)], 1)
    return np.where(there, ids.reshape(-1, 4), -1)


def marking_forms(docs: list[np.ndarray], forms: list[str], labels: np.ndarray, rows: int = 3) -> np.ndarray:
    """Which forms have a stem that marks toxic documents, by the log-likelihood ratio of its document counts.

    ``docs``: the forms of each document's tokens. The ratio must exceed what the largest of as many chance stems would reach.
    """
    n1, n0 = int(labels.sum()), int(len(labels) - labels.sum())
    if not n1 or not n0 or not forms:
        return np.zeros(len(forms), bool)
    stems = stem_ids(forms)
    size = int(stems.max()) + 1
    hits = np.zeros((2, size), np.int64)
    for ws, y in zip(docs, labels.tolist(), strict=True):
        own = np.unique(stems[np.unique(ws)])
        hits[y][own[own >= 0]] += 1
    a, b = hits[1].astype(float), hits[0].astype(float)
    p = (a + b) / (n1 + n0)
    term = lambda n, share, of: np.where(n > 0, n * np.log(np.maximum(share, 1e-300) / np.maximum(of, 1e-300)), 0.0)
    ratio = 2 * (term(a, a / n1, p) + term(b, b / n0, p) + term(n1 - a, 1 - a / n1, 1 - p) + term(n0 - b, 1 - b / n0, 1 - p))
    least = 2 * np.log(max(2, np.count_nonzero(a))) + 2
    marked = (a >= rows) & (a / n1 > 10 * b / n0) & (ratio >= least)
    return ((stems >= 0) & marked[stems]).any(1) & np.fromiter(map(bool, forms), bool, len(forms))


def fit(texts: list[str], labels: np.ndarray, rates: tuple[float, float] = (1.0, 1.0), epochs: int = 12, span: int = 64) -> Model | None:
    """The chain and the document function. ``rates``: how many documents a clean and a toxic row stand for."""
    vocabulary: dict[str, int] = {}
    words: list[np.ndarray] = []  # of each text the numbers of its tokens' forms
    for i in range(0, len(texts), 256):
        forms, which, sizes = tokens(texts[i : i + 256])
        number = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in forms], np.int32)
        words += np.split(number[which] if len(forms) else np.zeros(0, np.int32), np.cumsum(sizes)[:-1])
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    names = list(vocabulary)
    del vocabulary
    bad = marking_forms(words, names, labels)
    if not bad.any():
        return None
    feats = Features(names)
    # runs of tokens around toxic ones, and all of clean documents
    ids, gold, cuts = [], [], []
    for ws, y in zip(words, labels.tolist(), strict=True):
        g = bad[ws] & bool(y)
        for s in sorted({int(k) // span * span for k in np.flatnonzero(g)}) if y else range(0, len(ws), span):
            ids.append(ws[s : s + span])
            gold.append(g[s : s + span])
            cuts.append(len(ids[-1]))
    ids, gold, cuts = np.concatenate(ids), np.concatenate(gold).astype(float), np.array(cuts)
    first = np.zeros(len(ids), bool)
    first[np.cumsum(cuts) - cuts] = True
    model = Model(np.zeros(NONE + 1), -2.0, np.zeros((2, 2)), np.zeros(1 + DOCUMENT_FEATURES))
    squares, s_bias, s_trans = np.full(NONE + 1, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    goal = np.zeros((2, 2))
    a, b = gold[:-1][~first[1:]].astype(int), gold[1:][~first[1:]].astype(int)
    np.add.at(goal, (a, b), 1)
    for _ in range(epochs):
        by_word, best = feats.scores(model.weights)
        flat, owner = feats.used(best)
        scores = by_word[ids] + model.bias
        p = marginals(scores, cuts, model.trans)
        g_word = np.bincount(ids, weights=gold - p, minlength=len(names))
        g = np.bincount(flat, weights=g_word[owner], minlength=NONE + 1) - 0.05 * model.weights
        g[NONE] = 0
        squares += g * g
        model.weights += 0.5 * g / np.sqrt(squares)
        s_bias += (gb := float((gold - p).sum())) ** 2
        model.bias += 0.3 * gb / np.sqrt(s_bias)
        # expected transitions: the pair's weight given both neighbours' marginals, from one more pass
        expected = _expected_pairs(scores, cuts, model.trans, first)
        gt = goal - expected - 0.05 * model.trans
        s_trans += gt * gt
        model.trans = model.trans + 0.2 * gt / np.sqrt(s_trans)
    # the document function, by Newton steps on the weighted logistic loss
    by_word = model.word_scores(names)
    x = document_features(np.concatenate([by_word[ws] for ws in words]), sizes, model)[0]
    x = np.column_stack([np.ones(len(x)), x])
    w = np.where(labels == 1, rates[1], rates[0]) / max(rates)
    beta = np.zeros(1 + DOCUMENT_FEATURES)
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(1 + DOCUMENT_FEATURES)
        beta += np.linalg.solve(h, x.T @ (w * (labels - q)) - 0.05 * beta)
    model.document = beta
    return model


def _expected_pairs(scores: np.ndarray, sizes: np.ndarray, trans: np.ndarray, first: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Expected counts of the four transitions, from forward ratios and those of the rest of each text."""
    flip = np.repeat(2 * np.cumsum(sizes) - sizes - 1, sizes) - np.arange(len(scores))  # each text backwards
    f = _forward(scores, sizes, trans)
    b = _forward(scores[flip], sizes, trans.T)[flip]  # with the token's own score
    total = np.zeros(4)
    for i in range(0, len(scores) - 1, step):
        here = np.flatnonzero(~first[i + 1 : i + 1 + step]) + i
        w = np.stack([np.full(len(here), trans[0, 0]), trans[0, 1] + b[here + 1], trans[1, 0] + f[here], trans[1, 1] + f[here] + b[here + 1]])
        w = np.exp(w - w.max(0))
        total += (w / w.sum(0)).sum(1)
    return total.reshape(2, 2)


def _forward(scores: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> np.ndarray:
    out = scores.copy()
    start = (np.cumsum(sizes) - sizes)[np.argsort(-sizes, kind="stable")]
    n = np.sort(sizes)[::-1]
    for t in range(1, int(n[0]) if len(n) else 0):
        at = start[: np.searchsorted(-n, -t, "left")] + t
        m = out[at - 1]
        out[at] = scores[at] + np.logaddexp(trans[0, 1], trans[1, 1] + m) - np.logaddexp(trans[0, 0], trans[1, 0] + m)
    return out


def document_features(scores: np.ndarray, sizes: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For each text its largest marginal, log(1 + expected toxic tokens), the same of 100 words, the second and third
    largest marginals; and all marginals. ``scores``: of all tokens; ``sizes``: how many each text has."""
    p = marginals(scores, sizes, model.trans)
    x = np.zeros((len(sizes), DOCUMENT_FEATURES))
    some = sizes > 0
    if some.any():
        first = np.cumsum(sizes) - sizes
        start = first[some]
        total = np.add.reduceat(p, start)
        x[some, 0] = np.maximum.reduceat(p, start)
        x[some, 1] = np.log1p(total)
        x[some, 2] = np.log1p(100 * total / sizes[some])
        for i in np.flatnonzero(sizes > 2).tolist():
            own = p[first[i] : first[i] + sizes[i]]
            x[i, 3:] = np.partition(own, (len(own) - 3, len(own) - 2))[-2:-4:-1]
    return x, p


def fitted(docs: DataFrame, labels: DataFrame, most_rows: int = 1500, most_bytes: int = 1 << 25) -> Model | None:
    """Fits on at most ``most_rows`` documents of each class, chosen by a hash of their ids, outside fold 2.

    ``most_bytes`` bounds the text of the sample on the driver: of each class, whole documents in that order up to half of it.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not rows.get(0) or not rows.get(1):
        return None
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most twice most_rows
    order = W.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id")
    sample = sample.withColumn("held", F.sum(F.octet_length("text")).over(order)).withColumn("k", F.row_number().over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    sample = sample.where((F.col("held") <= most_bytes // 2) & (F.col("k") <= most_rows)).orderBy(F.xxhash64("doc_id"), "doc_id", "text").select("text", "toxic").toArrow()
    y = sample["toxic"].to_numpy().astype(np.int64)
    if not len(y) or y.min() == y.max():
        return None
    texts = sample["text"].to_pylist()
    del sample
    try:
        return fit(texts, y, (rows[0] / max(1, (y == 0).sum()), rows[1] / max(1, (y == 1).sum())))
    finally:  # the driver goes on with other work
        del texts
        release()


def scored(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score, predicted and toxic_spans (code points start:end of toxic tokens, comma-joined); columns of
    these names are replaced."""
    docs = docs.drop("score", "predicted", "toxic_spans")
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        own = sent.value
        word = re.compile(r"[^\x20\x09-\x0D]+").finditer
        for b in slices(batches, 4096, 1 << 22):
            texts = [t or "" for t in b["text"].to_pylist()]
            s, spans = np.zeros(len(texts)), [""] * len(texts)
            if own:
                forms, which, sizes = tokens(texts)
                x, p = document_features(own.word_scores(forms)[which], sizes, own)
                s = 1 / (1 + np.exp(-np.clip(own.document[0] + x @ own.document[1:], -700, 700)))
                start = np.cumsum(sizes) - sizes
                for i in np.flatnonzero(x[:, 0] >= 0.5).tolist():
                    at = [(m.start() + j, m.start() + k) for m in word(texts[i]) for j, k in cuts_of(m.group())]
                    spans[i] = ",".join("%d:%d" % at[k] for k in np.flatnonzero(p[start[i] : start[i] + sizes[i]] >= 0.5).tolist())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in b.schema.names), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(spans)], [*b.schema.names, "score", "predicted", "toxic_spans"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("toxic_spans", T.StringType())])
    return docs.mapInArrow(tidy(score), schema)
