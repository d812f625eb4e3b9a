import hashlib
import io
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veltra.llm import common, embeddings, mixing, neardup, packing, quality, secrets, substrings, tokenfiles, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = common.default_tokenizer()


def documents(spark, texts, sources=None, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[k], None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def ids_of():
    t = Tokenizer.from_file(TOKENIZER)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(5)
    long = words(rng, 6000)
    texts = [None, "", " \n ", "one", "one", long, long, words(rng, 30), "é" * 150, "é" * 150, "a\tb\x0bc"]
    d = documents(spark, texts, ["a", None, "a", "b", "b", "b", None, "c", "a", "a", "c"], [1, 2, 3, 4, 4, 5, 6, None, 8, 9, None])
    return d.withColumn("score", F.lit(1)).withColumn("secrets", F.lit("x")).withColumn("length", F.lit(2)).withColumn("bucket", F.lit(3))


# ---------------------------------------------------------------- shared parts


def test_pieces_are_the_librarys(ids_of):
    rng = random.Random(1)
    known = common.TokenIds(TOKENIZER, most=200)
    alphabet = list(" \n\t.,!abzéñß's'll012-_#$\x1c\xa0　漢\U0001f600ʼ\r\x85²ªk̈") + ["<|endoftext|>", "don't", " We'll", "  "]
    alphabet += [" word", "Été", " naïve", "***", "(", ")", "abcж", "e\u0301", "A"]
    narrow = [c for c in alphabet if c not in ("\xa0", "\u3000", "\x85", "<|endoftext|>")] + [chr(c) for c in range(0xC0, 0x180)] + ["'s", "\n\n", "a1b2", "×", "÷", "\x00", "İ"]
    for some in (alphabet, narrow):
        for _ in range(60):
            xs = ["".join(rng.choice(some) if rng.random() < 0.95 else chr(rng.choice([rng.randrange(0xA0, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randint(0, 30))) for _ in range(100)]
            for x, got in zip(xs, known.of(xs), strict=True):
                assert np.frombuffer(got, "<u4").tolist() == ids_of(x), repr(x)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2060)]
    parent = {x: x for p in links for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for p in links if p[0] != p[1] for x in p}


# ---------------------------------------------------------------- packing


@pytest.mark.parametrize("seed", range(4))
def test_solver(seed):
    rng = np.random.default_rng(seed)
    sizes = np.clip(rng.lognormal(3 + seed / 3, 0.8, 300), 1, 100).astype(int)
    counts = np.bincount(sizes, minlength=101)
    found = packing.pack(counts, 100, 500)
    used = np.zeros(101, int)
    for lengths, q in found:
        assert sum(lengths) <= 100
        for x in lengths:
            used[x] += q
    assert (used == counts).all()
    n, least = sum(q for _, q in found), packing.lower_bound(counts, 100)
    assert least <= n <= sum(q for _, q in packing.best_fit(counts, 100)) and n <= least * 1.03 + 1


def test_fillings_are_all_the_undominated_ones():
    rng = random.Random(24)
    for _ in range(150):
        counts, room = np.zeros(16, int), rng.randint(0, 15)
        for _ in range(rng.randint(0, 7)):
            counts[rng.randint(1, 12)] += 1
        pieces = [x for x in range(16) for _ in range(counts[x])]
        every = {tuple(sorted(c, reverse=True)) for n in range(len(pieces) + 1) for c in itertools.combinations(pieces, n) if sum(c) <= room}
        bigger = lambda f: any(y < x <= y + room - sum(f) and counts[x] > f.count(x) for y in (0, *f) for x in range(1, 16))
        got = [f for f in packing.fillings(counts, room) if f is not None]
        assert set(got) == {f for f in every if not bigger(f)} and len(got) == len(set(got))
        assert [sum(f) for f in got] == sorted(map(sum, got), reverse=True)


def test_solver_is_optimal_on_small_cases():
    rng = random.Random(3)
    for _ in range(40):
        sizes = [rng.randint(2, 10) for _ in range(8)]

        def least(rest, bins=()):
            if not rest:
                return len(bins)
            best = len(bins) + len(rest)
            for i in {b: i for i, b in enumerate(bins) if b >= rest[0]}.values():
                best = min(best, least(rest[1:], (*bins[:i], bins[i] - rest[0], *bins[i + 1 :])))
            return min(best, least(rest[1:], (*bins, 10 - rest[0])))

        want = least(sorted(sizes, reverse=True))
        assert sum(q for _, q in packing.pack(np.bincount(sizes, minlength=11), 10)) == want


def test_packed(spark, odd, ids_of):
    rows = packing.packed(odd, TOKENIZER, capacity=64).collect()
    want = sorted((r["doc_id"] or 0, len(ids_of(r["text"])) + 1) for r in odd.collect())
    assert sum(r["length"] for r in rows) == sum(n for _, n in want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    long = [*ids_of(next(r["text"] for r in odd.collect() if r["doc_id"] == 5)), 0]
    mine = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == 5)
    assert [p for p, *_ in mine] == list(range(len(mine))) and all(n == 64 for _, _, n, _ in mine[1:])
    for _, start, n, crc in mine:
        assert crc == zlib.crc32(np.array(long[start : start + n], "<u4").tobytes())
    assert packing.packed(odd.limit(0), TOKENIZER).count() == 0


# ---------------------------------------------------------------- near-duplicates


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    e = rng.integers(1, 2**63, 300).astype(np.uint64)
    w = rng.choice([0.3, 1.0, 2.5, 7.0], 300)
    for change in (1.0, 1.5, 4.0):
        v = w.copy()
        v[:120] *= change
        sig = neardup.dart_minhash(np.concatenate([e, e]), np.concatenate([w, v]), np.repeat([0, 1], 300), 2, 2048)
        assert abs((sig[0] == sig[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.05


def family(rng, size, n=120, edits=6):
    base = [f"b{rng.randrange(10**6)}" for _ in range(n)]
    out = [" ".join(base)]
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def brute_components(texts, weights="binary", ids=None):
    """Components by plain Counters of word tuples, without the operator's functions."""
    ids = list(range(len(texts))) if ids is None else ids
    sets = []
    for t in texts:
        ws = (t or "").encode().split()
        c = Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else Counter()
        sets.append(c if weights == "count" else Counter(set(c)))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "") or ids[i] == ids[j]
            if same or sets[i] and sets[j] and 10 * (sets[i] & sets[j]).total() >= 8 * (sets[i] | sets[j]).total():
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(root(i), []).append(ids[i])
    return {ids[i]: min(groups[root(i)]) for i in range(len(texts))}


@pytest.mark.parametrize(("weights", "block"), [("binary", 1024), ("count", 8)])
def test_near_duplicates_match_brute_force(spark, weights, block):
    rng = random.Random(6)
    texts = family(rng, 60) + family(rng, 5) + family(rng, 25, 40, 3) + family(rng, 40, 300, 25) + [words(rng, 80) for _ in range(20)] + ["too short", "too short", "", None, words(rng, 9) * 3, words(rng, 40_000)]
    rng.shuffle(texts)
    got = neardup.near_duplicates(documents(spark, texts), weights=weights, block=block).collect()
    want = brute_components(texts, weights)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == want[r["doc_id"]]) for r in got) and len(got) == len(texts)


def test_word_hashes():
    rng = random.Random(19)
    words_ = [bytes(rng.choice(b"ab\xc3\xa9") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    raw = b"".join(w + rng.choice([b" ", b"\n", b" \t", b"\x0b\r "]) for w in words_)
    by = {}
    for step in (64, 1 << 20):
        got = common.word_hashes(b" " + raw, step).tolist()
        assert len(got) == len(words_) and all(by.setdefault(w, h) == h for w, h in zip(words_, got, strict=True))
    assert len(set(by.values())) == len(by) and not len(common.word_hashes(b"")) and not len(common.word_hashes(b" \n "))


def test_near_duplicates_odd(spark, odd):
    got = neardup.near_duplicates(odd).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 0), (1, 1), (2, 1), (3, 3), (4, 4), (4, 4), (5, 5), (6, 5), (8, 8), (9, 8)]
    left = neardup.without_near_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 0, 1, 3, 4, 5, 8]
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


# ---------------------------------------------------------------- WARC


def test_reader_owns_each_record_once():
    rng = random.Random(8)
    parts, starts, at = [], [], 0
    for i in range(60):
        if rng.random() < 0.2:
            junk = rng.choice([b"junk", warc.GZIP + b"\0" * 20, warc.GZIP * 3, b"\x1f"])
            parts.append(junk)
            at += len(junk)
        block = rng.randbytes(rng.choice([0, 10, 5000])) + warc.GZIP * rng.randint(0, 5)
        raw = warc.record([("WARC-Type", "response"), ("X-Page-Id", str(i))], block)
        starts.append((at, str(i), block))
        parts.append(raw)
        at += len(raw)
    data = b"".join(parts)
    for split in (1, 7, 100, 4096, len(data)):
        got = [(o, h["x-page-id"], b) for s in range(0, len(data), split) for o, h, b in warc.records(io.BytesIO(data), len(data), s, min(len(data), s + split), chunk=64 if split > 7 else 4096)]
        assert got == starts, split


def test_archives(spark):
    rng = random.Random(25)
    body = "<p>" + "x" * 200
    rows = [(1, "http://a", body), (2, None, None), (3, "b", body), (4, "c d", "short"), (5, "e", "short"), (None, "n", body), (6, "f", ""), (0, "late", body), (7, "é", "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    files = warc.write_archives(pages, file_bytes=300)
    got = {r["page_id"]: r for r in warc.read_archives(files, split_bytes=64).collect()}
    assert len(got) == len(rows) and files.count() > 1
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {i: r["refers_to"] for i, r in got.items() if r["record_type"] == "revisit"} == {1: 0, 3: 0}
    assert {i: r["url"] for i, r in got.items()} == {i: u for i, u, _ in rows}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    # long payloads and repeated ids; then a damaged record is told
    long = "".join(chr(rng.randrange(32, 126)) for _ in range(3_000_000))
    rows = [(1, "a\n b", long), (1, "b", long), (2, None, long), (2, "c", None), (2, "d", "")]
    files = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted(((r["page_id"], r["url"] or "", r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_archives(files, split_bytes=100_000).collect()), key=str)
    assert got == sorted([(1, "a\n b", 3_000_000, "response", None), (1, "b", 3_000_000, "response", None), (2, "", 3_000_000, "revisit", 1), (2, "c", 0, "response", None), (2, "d", 0, "response", None)], key=str)
    path = files.orderBy(F.desc("bytes")).first()["path"].removeprefix("file:")
    with open(path, "r+b") as f:
        f.seek(1000)
        f.write(b"\0\0\0\0")
    with pytest.raises(ValueError, match="were written"):
        warc.read_archives(files)


# ---------------------------------------------------------------- substrings


def brute_substrings(rows, least):
    seen, out = set(), {}
    for k, (i, t) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or ""))):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - least + 1):
            w = raw[s : s + least]
            if w in seen:
                gone[s : s + least] = b"\1" * least
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(raw)) if gone[j] and not (j and gone[j - 1]))
        out[k] = (i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return sorted(out.values(), key=str)


@pytest.mark.parametrize(("batch", "chunk"), [(1 << 16, 1 << 20), (5, 40)])
def test_substrings_match_brute_force(spark, batch, chunk):
    rng = random.Random(9)
    common_part, other = words(rng, 40, 10**6), words(rng, 60, 10**6)
    texts = ["ab" * 300, "aaaa" * 200, "x" * 99, None, "", common_part, "\0" * 150, "é漢" * 80]
    for _ in range(30):
        cut = rng.randrange(len(other))
        texts.append(words(rng, 20, 10**6) + rng.choice([common_part, other[cut:], other[:cut], "ab" * 80, "\0" * 120]) + words(rng, 10, 10**6))
    texts += texts[10:13]
    rows = list(enumerate(texts)) + [(3, "tie " + common_part), (3, "tie " + common_part), (None, other)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("ord", F.lit(2))
    got = substrings.deduplicated(d, batch_contexts=batch, chunk=chunk).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_substrings(rows, 100)
    assert substrings.deduplicated(d.limit(0)).count() == 0


# ---------------------------------------------------------------- toxicity


def test_marginals_are_exact():
    rng = np.random.default_rng(10)
    sizes = np.array([4, 0, 1, 6])
    scores, trans = rng.normal(size=11), rng.normal(size=(2, 2))
    got, at = toxicity.marginals(scores, sizes, trans), 0
    for n in sizes:
        total, hit = 0.0, np.zeros(n)
        for path in range(2**n):
            tags = [path >> i & 1 for i in range(n)]
            w = np.exp(sum(scores[at + i] * t for i, t in enumerate(tags)) + sum(trans[a, b] for a, b in zip(tags, tags[1:], strict=False)))
            total += w
            hit += w * np.array(tags, float)
        assert np.allclose(got[at : at + n], hit / total)
        at += n


def test_toxicity_on_held_out_documents(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fitted(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    clean = [got[r["doc_id"]] for r in held if not r["toxic"]]
    toxic = [got[r["doc_id"]] for r in held if r["toxic"]]
    assert sum(r["predicted"] for r in clean) <= 0.03 * len(clean)
    assert sum(r["predicted"] for r in toxic) >= 0.5 * len(toxic)
    hit = next(r for r in got.values() if r["toxic_spans"])
    a, b = map(int, hit["toxic_spans"].split(",")[0].split(":"))
    assert not any(c.isspace() for c in hit["text"][a:b]) and b > a
    rows = toxicity.scored(odd, model).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows) and set(odd.columns) <= set(rows[0].asDict())
    assert all(r["score"] == 0 for r in toxicity.scored(odd, toxicity.fitted(odd, labels.limit(0))).collect())


def test_toxic_words_count_anywhere_in_a_text(spark):
    rng = random.Random(18)
    clean = [words(rng, 80) for _ in range(120)]
    toxic = [f"{words(rng, 40)} worthless idiot {words(rng, 40)}" for _ in range(120)]
    model = toxicity.fit(clean + toxic, np.array([0] * 120 + [1] * 120))
    said = ["this", "much", "longer", "beginning", "says", "worthless", "idiot"]
    cases = [s.join(said) for s in " \u00a0\u3000-_/\u2014."] + ["".join(said)]
    cases += [x.replace("worthless", "wonderful").replace("idiot", "w17") for x in cases]
    rows = [r for r in sorted(toxicity.scored(documents(spark, cases), model).collect(), key=lambda r: r["doc_id"])]
    assert [r["predicted"] for r in rows] == [1] * 9 + [0] * 9
    for r in rows[:8]:
        a, b = map(int, r["toxic_spans"].split(",")[-1].split(":"))
        assert r["text"][a:b] == "idiot"
    # features by the rule, one by one: the form, its beginnings and 4-grams, each hashed for itself
    for w in ["", "a", "wor", "word", "worthless", "x" * 15, "é日" * 5]:
        f = toxicity.Features(["before", w, "behind"])
        alone = toxicity.Features([w])
        ids, whose = f.used(f.start)
        mine = sorted(i for i, k in zip(ids.tolist(), whose.tolist(), strict=True) if k == 1 and i < toxicity.NONE)
        assert mine == sorted(i for i in alone.used(alone.start)[0].tolist() if i < toxicity.NONE)
        assert len(mine) == (len(w) > 0) + sum(len(w) >= k for k in (4, 5, 6)) + max(0, len(w) - 3)
        shared = toxicity.Features([w + "q" * 3])
        assert len(w) < 6 or set(mine) & set(shared.used(shared.start)[0].tolist())
    # a mark behind many others is learned from too
    late = [" ".join(f"worthless {words(rng, 70)}" for _ in range(10)) + " scoundrel" for _ in range(120)]
    model = toxicity.fit([words(rng, 80) for _ in range(120)] + late, np.array([0] * 120 + [1] * 120))
    assert model.word_scores(["scoundrel"])[0] > 0 > model.word_scores(["w17"])[0]


def test_scores_by_enumeration(spark):
    """Score, prediction and spans of short texts from all label sequences and plain arithmetic on the fitted weights."""
    rng = random.Random(26)
    clean = [words(rng, 30) for _ in range(80)]
    model = toxicity.fit(clean + [f"{words(rng, 12)} worthless idiot {words(rng, 12)}" for _ in range(80)], np.array([0] * 80 + [1] * 80))
    texts = ["", "worthless", "you worthless idiot w1 w2", "w5 w6", "w1 (worthless)-w2 idiotic w3 w4 w5 w6"] + [" ".join(rng.choice(["worthless", "idiot", "w3", "w9", "fine"]) for _ in range(7)) for _ in range(12)]
    for r in toxicity.scored(documents(spark, texts), model).collect():
        forms = [f for w in texts[r["doc_id"]].split() for f in [toxicity.form(w[a:b]) for a, b in toxicity.cuts_of(w)]]
        emit = [float(x) for x in model.word_scores(forms)]
        total, hit = 0.0, [0.0] * len(emit)
        for tags in itertools.product((0, 1), repeat=len(emit)):
            w = math.exp(sum(e for e, t in zip(emit, tags, strict=True) if t) + sum(model.trans[a][b] for a, b in zip(tags, tags[1:], strict=False)))
            total += w
            hit = [h + w * t for h, t in zip(hit, tags, strict=True)]
        p = [h / total for h in hit]
        top = sorted(p, reverse=True) + [0.0, 0.0, 0.0]
        x = [top[0], math.log1p(sum(p)), math.log1p(100 * sum(p) / max(1, len(p))), *(top[1:3] if len(p) > 2 else (0.0, 0.0))]
        want = 1 / (1 + math.exp(-(model.document[0] + sum(a * b for a, b in zip(model.document[1:], x, strict=True)))))
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == (want >= 0.3)
        assert (len(r["toxic_spans"].split(",")) if r["toxic_spans"] else 0) == (sum(v >= 0.5 for v in p) if x[0] >= 0.5 else 0)


# ---------------------------------------------------------------- mixing


def brute_targets(sizes, limit=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = float(sum(sizes.values())), {}
    while True:
        rest = [s for s in names if s not in full]
        left, w = total - sum(full.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / w > limit * sizes[s] + 1e-9]
        if not over:
            return {**full, **{s: left * weight[s] / w for s in rest}}
        full |= {s: limit * sizes[s] for s in over}


def test_mix(spark, odd):
    rng = random.Random(11)
    texts = [words(rng, rng.choice([1, 5, 50, 400])) for _ in range(300)] + ["only", None, ""]
    sources = [rng.choice(["big"] * 8 + ["a", "b", "c", None]) for _ in range(300)] + ["tiny", "none", "none"]
    d = documents(spark, texts, sources)
    rows = mixing.mix_documents(d).collect()
    sizes = {}
    for r in rows:
        assert r["size"] == len((texts[r["doc_id"]] or "").split()) and 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = brute_targets(sizes)
    for s, n in sizes.items():
        mine = [r for r in rows if r["source"] == s]
        assert all(r["source_size"] == n and abs(r["target"] - want[s]) < 1e-6 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 130
    assert sorted(rows) == sorted(mixing.mix_documents(d).collect())
    mixed = mixing.mixed_documents(d).collect()
    took = {}
    for r in mixed:
        took[r["doc_id"]] = took.get(r["doc_id"], 0) + len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert took == {r["doc_id"]: r["taken"] for r in rows if r["taken"]}
    # the mix as shards: its blocks make up what is taken, and every shard has a draw of its own
    blocks = mixing.mixed_blocks(d, shard=50).collect()
    by_shard, by_source = {}, Counter()
    for r in blocks:
        assert r["words"] == len(r["text"].split()) and 0 < r["words"] <= 64
        by_shard.setdefault(r["shard"], []).append(r["place"])
        by_source[r["source"]] += r["words"]
    assert all(sorted(p) == list(range(len(p))) for p in by_shard.values()) and len(by_shard) > 3
    same = {s: sum(r["taken"] for r in mixing.mix_documents(d, shard=50).collect() if r["source"] == s) for s in sizes}
    assert {s: n for s, n in same.items() if n} == dict(by_source)
    assert sorted(blocks, key=str) == sorted(mixing.mixed_blocks(d, shard=50).collect(), key=str)
    assert mixing.mix_documents(odd).count() == 11 and mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix_documents(odd.limit(0)).count() == 0


def test_draws_are_multinomial_given_the_totals(spark):
    plan = spark.createDataFrame([("a", 70, 9000), ("b", 10, 900), (None, 5, 100), ("none", 0, 0)], "source string, blocks long, slots long")
    rows = mixing.draws(plan, 50, 3).collect()
    n_shards = 200
    for name, total in (("a", 9000), ("b", 900), (None, 100)):
        mine = sorted((r["shard"], r["first"], r["n"]) for r in rows if r["source"] == name)
        at = 0
        for _, first, n in mine:  # ranks follow the counts, shard after shard, without a gap
            assert first == at
            at += n
        assert at == total and mine[-1][0] < n_shards
        counts = np.zeros(n_shards)
        counts[[s for s, _, _ in mine]] = [n for *_, n in mine]
        mean = total / n_shards
        assert 0.7 < counts.var() / (mean * (1 - 1 / n_shards)) < 1.4
    # taken, by brute force from the draws and the permutations
    for r in mixing.slots(mixing.draws(plan, 50, 3), 3).groupBy("source", "epoch").agg(F.count("*").alias("n"), F.count_distinct("index").alias("k"), F.max("index").alias("top")).collect():
        blocks = {"a": 70, "b": 10, None: 5}[r["source"]]
        assert r["n"] == r["k"] <= blocks and r["top"] < blocks


def test_taken_by_brute_force(spark):
    rng = random.Random(23)
    texts = [words(rng, rng.choice([0, 1, 7, 64, 200])) for _ in range(60)]
    sources = [rng.choice(["x", "x", "x", "y", None]) for _ in texts]
    d = documents(spark, texts, sources)
    sizes = mixing.sized(d)
    plan = mixing.planned(mixing.source_targets(sizes), 16)
    slots = mixing.slots(mixing.draws(plan, 8, 17), 17).collect()
    want = Counter()
    for name in {"x", "y", None}:
        owner = [i for i, t in enumerate(texts) if sources[i] == name for _ in t.split()]
        for s in slots:
            if s["source"] == name:
                want.update(owner[16 * s["index"] : 16 * s["index"] + 16])
    got = {r["doc_id"]: r["taken"] for r in mixing.mix_documents(d, block=16, shard=8).collect()}
    assert got == {i: want[i] for i in range(len(texts))}
    totals = {r["source"]: (r["target"], r["slots"], r["blocks"]) for r in plan.collect()}
    assert all(abs(sum(s["source"] == n for s in slots) - k) == 0 for n, (_, k, _) in totals.items())


# ---------------------------------------------------------------- quality


def test_quality(spark, odd):
    rng = random.Random(12)
    texts = ["a b c d e f g h " * 5, words(rng, 100) + "\n# | <x>\n# | <x>\n \n \n", "é ü\x85x $$", None, ""] + [words(rng, 60) for _ in range(40)] + [" ".join(f"z{rng.randrange(50)}" for _ in range(60)) for _ in range(10)]
    labels = spark.createDataFrame([(i, 1) for i in range(5, 45)] + [(i, 0) for i in range(45, 55)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.judged(documents(spark, texts), labels).collect()}
    space = " \t\n\x0b\x0c\r"
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        ws = raw.split()
        windows = [tuple(ws[k : k + 8]) for k in range(len(ws) - 7)]
        hit = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if x.strip(space)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == (len(ws) < 20 or 100 * len(hit) > 30 * len(ws))
    # scores, by plain counting over buckets of own making: words and pairs of words by their hashes
    wants = {}
    grams = {i: [int(x) for x in quality.buckets(common.word_hashes((t or "").encode()))] for i, t in enumerate(texts)}
    raw_n, good_n = Counter(g for x in grams.values() for g in x), Counter(g for i in range(5, 45) for g in grams[i])
    share = good_n.total() / raw_n.total()
    for i, x in grams.items():
        ratio = [math.log((good_n[g] + 20 * share) / (good_n.total() + 20 * share * 65536)) - math.log((raw_n[g] + 20) / (raw_n.total() + 20 * 65536)) for g in x]
        wants[i] = sum(ratio) / len(ratio) if ratio else 0.0
        assert abs(got[i]["score"] - wants[i]) < 1e-9 and got[i]["kept"] == (not got[i]["base_failed"] and wants[i] >= quality.THRESHOLD)
        assert len(x) == max(0, 2 * got[i]["n_words"] - 1)
    assert all(got[i]["kept"] for i in range(5, 45)) and not any(got[i]["kept"] for i in range(45, 55))
    assert quality.judged(odd, labels).count() == 11 and quality.judged(odd.limit(0), labels.limit(0)).count() == 0


# ---------------------------------------------------------------- vectors


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(13)
    centers = rng.normal(size=(12, 16))
    rows = []
    for i in range(260):
        v = centers[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.2])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1, 3])], int(rng.integers(2)) if i % 13 else None))
    rows += [(400 + i, [1.0, i / 40, 0.5], 1) for i in range(40)] + [(460, [2.0], 1), (461, [3.0], 1), (462, [-3.0], 1), (463, [1.0, 0.0], 1)]  # other lengths, few and many
    rows += [(500, [3e38] * 16, 0), (501, [3e38] * 15 + [2.9e38], 0), (502, [1e-42] * 16, 0)]  # squares beyond single precision
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] * 16, 1), (304, [float("inf")] * 16, 1), (305, rows[1][1], rows[1][2]), (306, [1.0], 1), (307, [-0.0, 0.0] + [1.0] * 14, 1), (308, [0.0, -0.0] + [1.0] * 14, 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cells", F.lit(1))
    good = [r for r in rows if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    links = {r[0]: set() for r in rows}
    for a in good:
        for b in good:
            x, y = np.float32(a[1]).astype(float), np.float32(b[1]).astype(float)
            if a[0] < b[0] and a[2] == b[2] and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                links[a[0]].add(b[0])
                links[b[0]].add(a[0])
    for interval in (None, 16):
        got = {r["vec_id"]: r for r in embeddings.near_vectors(d, interval=interval, most_sample=50).collect()}
        assert {i: r["n_links"] for i, r in got.items()} == {i: len(s) for i, s in links.items()}
        for i in links:
            seen, todo = {i}, [i]
            while todo:
                todo += [y for y in links[todo.pop()] - seen if not seen.add(y)]
            assert got[i]["component_id"] == min(seen) and got[i]["kept"] == (i == min(seen))
    assert embeddings.near_vectors(d.limit(0)).count() == 0


def test_repeated_ids_and_great_numbers(spark):
    """Rows with one id are vectors of their own: their groups do not meet through the id."""
    rows = [(20, [1.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0]), (21, [1.0, 0.01, 0.0]), (22, [0.0, 1.0, 0.01]), (19, [0.0, 0.0, 1e200]), (23, [0.0, 0.0, 1e-200]), (24, [1e200, 1e200, 0.0]), (25, [2e-300, 2e-300, 0.0]), (None, [1.0, 0.0, 0.0])]
    d = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(d).collect()), key=str)
    assert got == sorted([(20, 1, 20, True), (20, 1, 20, True), (21, 1, 20, False), (22, 1, 20, False), (19, 1, 19, True), (23, 1, 19, False), (24, 1, 24, True), (25, 1, 24, False), (0, 0, None, True)], key=str)


# ---------------------------------------------------------------- token files


def test_code_lengths():
    rng = np.random.default_rng(14)
    for counts in ([5], [0, 0, 3, 1], [1] * 8, (rng.pareto(0.6, 300) * 10).astype(int) + 1, [2**i for i in range(20)]):
        counts = np.array(counts)
        n = tokenfiles.code_lengths(counts, 9)
        assert ((n > 0) == (counts > 0)).all() and n.max() <= 9 and sum(2.0 ** -n[n > 0].astype(float)) <= 1
    assert tokenfiles.code_lengths(np.array([1, 1, 2, 4]), 16).tolist() == [3, 3, 2, 1]
    with pytest.raises(ValueError):
        tokenfiles.code_lengths(np.ones(9), 3)


def test_token_file_round_trip():
    rng = np.random.default_rng(15)
    docs = [(i, rng.integers(0, 50, rng.integers(0, 300)).astype(np.uint16)) for i in [*range(40), None]]
    n = tokenfiles.code_lengths(np.bincount(np.concatenate([x for _, x in docs]), minlength=60), 8)
    out = io.BytesIO()
    w = tokenfiles.FileWriter(out, n, tokenfiles.canonical_codes(n), block=16, segment=500)
    for i, x in docs:
        w.add(i, x)
    w.flush()
    got = []
    for ids, sizes, flat in tokenfiles.read_file(io.BytesIO(out.getvalue())):
        got += zip(ids.tolist(), [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])], strict=True)
    assert got == [(tokenfiles.NO_ID if i is None else i, x.tolist()) for i, x in docs]


def test_token_tables(spark, odd, ids_of):
    odd = odd.unionByName(documents(spark, ["a <|endoftext|> b", "x" * 5000], ids=[20, 21]), allowMissingColumns=True)
    segments = tokenfiles.write_token_files(odd, TOKENIZER, segment=500, file_ids=40_000)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenfiles.read_token_files(segments).collect())
    assert segments.count() > segments.select("path").distinct().count() > 1
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    assert [i for _, i, *_ in got] == [None, None, 1, 2, 3, 4, 4, 5, 6, 8, 9, 20, 21]
    want = sorted(zlib.crc32(np.array([*ids_of(r["text"]), 0], "<u4").tobytes()) for r in odd.collect())
    assert sorted(c for *_, c in got) == want
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(odd.limit(0), TOKENIZER)).count() == 0


# ---------------------------------------------------------------- secrets


def brute_entropy(s, alphabet, window, bits):
    spans = []
    for i in range(len(s) - window + 1):
        w = s[i : i + window]
        if all(c in alphabet for c in w):
            p = np.array([w.count(c) for c in set(w)]) / window
            if -(p * np.log2(p)).sum() >= bits - 1e-9:
                if spans and spans[-1][1] >= i:
                    spans[-1][1] = i + window
                else:
                    spans.append([i, i + window])
    return [tuple(x) for x in spans]


def test_secrets(spark, odd):
    rng = random.Random(16)
    pick = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    cases = [
        'é token = "abcdef"', "secret:token:abcdefg", "PASSWORD=short", "api-key: zzzzzzzz apiKEY='zzzzzzzz'", "AKIA" + "A" * 16 + " AKIAAKIA" + "9" * 11,
        "deadbeef" * 3, "x" + "0" * 24 + "g", pick("0123456789abcdef", 40) + " " + pick(secrets.TEXT_ALPHABET, 60) + "\U0001f600" + pick(secrets.TEXT_ALPHABET, 25),
        "123e4567-e89b-12d3-a456-426614174000 some/path/with/words/in_it abcdefghijklmnopqrstuvwxyz", "a" * 30 + pick(secrets.TEXT_ALPHABET, 30) + "a" * 30,
    ]
    import re

    got = {r["doc_id"]: r for r in secrets.secret_report(documents(spark, cases)).collect()}
    allowed = re.compile("|".join(f"(?:{a})" for a in secrets.ALLOWED))
    for i, t in enumerate(cases):
        base = [(m.start(), 0, m.end(), "assign") for m in re.finditer(secrets.ASSIGN, t, re.A) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end(), "access") for m in re.finditer(secrets.ACCESS, t) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        more = []
        for m in re.finditer(secrets.CANDIDATE, t):
            if not allowed.fullmatch(m[0]):
                hexed = re.fullmatch("[0-9a-f]+", m[0])
                k, a, b = (3, secrets.HEX_ALPHABET, secrets.HEX_BITS) if hexed else (4, secrets.TEXT_ALPHABET, secrets.TEXT_BITS)
                more += [(m.start() + x, k, m.start() + y, secrets.KINDS[k]) for x, y in brute_entropy(m[0], a, secrets.WINDOW, b)]
        text = lambda s: ",".join(f"{k}:{x}:{y}" for x, _, y, k in sorted(s))
        assert got[i]["spans"] == text(base + more), t
        assert got[i]["base_sha256"] == hashlib.sha256(text(base).encode()).hexdigest()
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(b[1] == k for b in base) for k in range(3))
    assert any("entropy_text" in r["spans"] for r in got.values()) and any("entropy_hex" in r["spans"] for r in got.values())
    red = {r["doc_id"]: r["text"] for r in secrets.redacted(documents(spark, [*cases, None, "clean text"])).collect()}
    assert red[0] == 'é [SECRET]"' and red[5] == "[SECRET]" and red[10] is None and red[11] == "clean text"
    assert secrets.redacted(odd).columns == odd.columns and secrets.secret_report(odd).count() == 11
    assert secrets.secret_report(odd.limit(0)).count() == 0


def test_random_keys_of_each_alphabet_are_found(spark):
    rng = random.Random(17)
    pick = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    digits, low = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    classes = {
        "upper hex": (digits + "ABCDEF", 32, 3, ""), "mixed hex": (digits + "abcdefABCDEF", 24, 3, ""), "prefixed hex": (digits + "abcdef", 23, 3, "key_"), "0x": (digits + "ABCDEF", 40, 3, "0x"),
        "base32": (low.upper() + "234567", 32, 5, ""), "lower": (low + digits, 32, 5, "sk_"), "base62": (low + low.upper() + digits, 24, 6, ""),
    }
    keys = [(name, k, before, pick(a, n)) for name, (a, n, k, before) in classes.items() for _ in range(60)]
    allowed = re.compile("|".join(f"(?:{a})" for a in secrets.ALLOWED))
    keys = [x for x in keys if not allowed.fullmatch(x[3])]
    got = {r["doc_id"]: r for r in secrets.secret_report(documents(spark, [f"see {before}{key} there" for _, _, before, key in keys])).collect()}
    clear = {r["doc_id"]: r["text"] for r in secrets.redacted(documents(spark, [f"see {before}{key} there" for _, _, before, key in keys])).collect()}
    limits = {3: (secrets.HEX_ALPHABET, secrets.HEX_BITS), 5: (secrets.BASE62, secrets.ONE_CASE_BITS), 6: (secrets.BASE62, secrets.BASE62_BITS)}
    missed = dict.fromkeys(classes, 0)
    for i, (name, k, before, key) in enumerate(keys):
        at = 4 + len(before)
        want = [f"{secrets.KINDS[k]}:{at + x}:{at + y}" for x, y in brute_entropy(key, *limits[k][:1], secrets.WINDOW, limits[k][1])]
        assert [s for s in got[i]["spans"].split(",") if s.startswith(secrets.KINDS[k])] == want, key
        missed[name] += not want or key in clear[i]
    assert max(missed.values()) <= 1, missed
    words = ["see /usr/lib/some_path-with/words_in here", "id_20231105123456789012 there", "internationalizations2024 x", "DEADBEEF" * 4]
    assert [r["spans"] for r in secrets.secret_report(documents(spark, words)).orderBy("doc_id").collect()] == [""] * 4


def test_allowed_shapes():
    rng = random.Random(21)
    plain = (r"[A-Za-z]+([+/_=-]+[A-Za-z]+)*[+/_=-]*", r"[/]?([a-z0-9_-]+/)+[a-z0-9_-]*")
    for _ in range(20_000):
        x = "".join(rng.choice("aB1/-") for _ in range(rng.randint(0, 9)))
        for simple, repeated in zip((secrets.ALLOWED[1], secrets.ALLOWED[3]), plain, strict=True):
            assert bool(re.fullmatch(simple, x)) == bool(re.fullmatch(repeated, x)), x


def test_long_texts_of_every_shape(spark):
    """200 kB of runs that allow-lists, entropy windows or very many matches cover: seconds each, like the short ones."""
    rng = random.Random(22)
    pick = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    mixed = "".join(pick(secrets.BASE62, 40) + "a" * 40 for _ in range(500))
    texts = ["a-" * 100_000, "ab/" * 70_000, pick(secrets.TEXT_ALPHABET, 200_000), "token=abcdef " * 15_000, "é " * 50_000 + pick("0123456789abcdef", 5_000), mixed]
    got = {r["doc_id"]: r for r in secrets.secret_report(documents(spark, texts)).collect()}
    assert got[0]["spans"] == got[1]["spans"] == "" and got[3]["n_assign"] == 15_000 and got[4]["n_hex"] == 1
    for i, t in ((2, texts[2]), (5, mixed)):
        want = brute_entropy(t, secrets.TEXT_ALPHABET, secrets.WINDOW, secrets.TEXT_BITS)
        assert [s for s in got[i]["spans"].split(",") if s.startswith("entropy_text")] == [f"entropy_text:{a}:{b}" for a, b in want] and want
    clear = {r["doc_id"]: r["text"] for r in secrets.redacted(documents(spark, texts)).collect()}
    assert clear[0] == texts[0] and clear[3] == "[SECRET] " * 15_000 and clear[4] == "é " * 50_000 + "[SECRET]"


# ---------------------------------------------------------------- long texts


def test_texts_of_megabytes(spark, ids_of):
    """One text of 400,000 words, one word of 300,000 letters, and a copy of the first: whole, in every operator."""
    rng = random.Random(27)
    long, word = words(rng, 400_000, 50_000), "".join(rng.choice("abcdé") for _ in range(300_000))
    texts = [long, word, long, "short one"]
    d = documents(spark, texts, ["a", "b", "a", "b"])
    count = [len(t.split()) for t in texts]
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    q = by(quality.judged(d, spark.createDataFrame([(3, 1)], "doc_id long, quality int")))
    assert [q[i]["n_words"] for i in range(4)] == count and q[1]["word_chars"] == 300_000
    near = by(neardup.near_duplicates(d))
    assert [near[i]["component_id"] for i in range(4)] == [0, 1, 0, 3]
    cut = by(substrings.deduplicated(d))
    assert (cut[2]["n_removed"], cut[2]["n_spans"], cut[0]["n_bytes"]) == (len(long), 1, len(long)) and cut[0]["kept_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    want = {i: [*ids_of(t), 0] for i, t in enumerate(texts)}
    files = by(tokenfiles.read_token_files(tokenfiles.write_token_files(d, TOKENIZER)))
    assert all((files[i]["n_tokens"], files[i]["ids_crc32"]) == (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items())
    pieces = packing.packed(d, TOKENIZER).collect()
    assert Counter({i: len(x) for i, x in want.items()}) == sum((Counter({r["doc_id"]: r["length"]}) for r in pieces), Counter())
    mix = by(mixing.mix_documents(d))
    assert [mix[i]["size"] for i in range(4)] == count
    model = toxicity.fit([words(rng, 60) for _ in range(60)] + [f"{words(rng, 30)} worthless idiot" for _ in range(60)], np.array([0] * 60 + [1] * 60))
    scores = by(toxicity.scored(documents(spark, [long, word, f"{long} worthless idiot"]), model))
    assert all(0 <= scores[i]["score"] <= 1 for i in range(3)) and scores[2]["toxic_spans"].endswith(f"{len(long) + 11}:{len(long) + 16}")
    assert by(secrets.secret_report(d))[0]["n_hex"] == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, ids_of):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"] and P.ORACLE_SQL is None
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for name, stage in P.STAGES:
        before = docs
        docs = common.staged(stage(spark, docs, sf), f"test-{name}")
        seen.append(docs.collect())
        if name != "packing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    first, second, third, mixed, packed = seen
    by = {r["doc_id"]: r["text"] for r in first}
    want = brute_components(list(by.values()), ids=list(by))
    assert {r["doc_id"] for r in second} == {i for i, c in want.items() if i == c}
    assert {r["doc_id"]: r["text"] for r in third} == {r["doc_id"]: r["text"] for r in secrets.redacted(spark.createDataFrame(second)).collect()}
    sizes = sum(len((r["text"] or "").split()) for r in third)
    assert abs(sum(len(r["text"].split()) for r in mixed) - sizes) < 70 * 20
    assert sum(r["length"] for r in packed) == sum(len(ids_of(r["text"])) + 1 for r in mixed)
    assert isinstance(packed[0], Row)


def test_pipeline_on_odd_tables(spark, odd, tmp_path):
    """Nulls, empty texts, repeated rows and ids, clashing columns; then no row at all."""
    import corpus_pipeline as P

    names = {"score", "secrets", "length", "bucket"}
    docs = odd.withColumn("predicted", F.lit("mine")).withColumn("size", F.lit(3)).withColumn("first", F.lit("f")).withColumn("words", F.array(F.lit(1)))
    for d, labels in ((docs, [(1, 1, 0), (5, 0, 1)]), (docs.limit(0), [])):
        folder = tmp_path / str(len(labels))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        d.write.parquet(f"{folder}/documents.parquet")
        at = spark.read.parquet(f"{folder}/documents.parquet")
        sizes = []
        for name, stage in P.STAGES:
            before, at = at, common.staged(stage(spark, at, str(folder)), f"odd-{name}")
            sizes.append(at.count())
            if name != "packing":
                assert at.dtypes == before.dtypes and names <= set(at.columns)
        assert (sizes[0] >= sizes[1] == sizes[2] > 0 and sizes[4] >= sizes[3] > 0) if labels else not any(sizes)
        assert sorted(P.run(spark, str(folder)).collect(), key=str) == sorted(at.collect(), key=str)
