"""The operators against brute-force versions, on small tables with nulls, ties, empty and repeated rows."""

import hashlib
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tidemark.llm import common, fingerprints, lm, mixing, near_dedup, packing, paragraph_dedup, quality, suffix_dedup, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"
WORDS = [f"w{k}" for k in range(400)]


def text(seed, n=60):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


ROWS = [
    (1, text(1), "en", "a", 0, "x"), (2, text(1), "en", "a", 0, "x"), (3, text(1) + " more", "en", "b", 0, "x"), (4, None, None, None, 0, "x"),
    (5, "", "en", "b", 0, "x"), (6, "  \n\t ", "de", "c", 0, "x"), (7, text(7, 3000), "de", "a", 0, "x"), (8, text(8) + ". " + text(9), "fr", "a", 0, "x"),
    (9, text(10, 30) + ".\n" + text(9) + ". " + text(11, 20), "fr", "b", 0, "x"), (10, "é" * 120, "fr", "c", 0, "x"), (11, "a" * 300, "es", "c", 0, "x"), (11, "a" * 300, "es", "c", 0, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 40), (40, 45), (60, 60)], "a long, b long")
    got = dict(common.components(edges).collect())
    assert got == {**{k: 0 for k in range(31)}, 40: 40, 45: 40, 50: 40}


def test_fingerprints(docs, none):
    rows = sorted((r[0], r[1] or "") for r in ROWS)
    got = sorted(fingerprints.fingerprints(docs).collect(), key=lambda r: r.doc_id)
    for k, ((i, t), g) in enumerate(zip(rows, got)):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        assert (g.doc_id, g.n_chars, g.edited_sha256) == (i, len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
    assert got[0].fingerprint == got[1].fingerprint
    assert fingerprints.fingerprints(none).count() == 0


def test_packing(docs, none):
    rows = packing.pack(docs, packing.public_tokenizers.path(packing.MODEL)).collect()
    t = packing.encoder(packing.public_tokenizers.path(packing.MODEL)).tokenizer
    for i, x in {r[0]: r[1] or "" for r in ROWS}.items():
        assert sum(r.length for r in rows if r.doc_id == i) == (len(t.encode(x, add_special_tokens=False).ids) + 1) * sum(r[0] == i for r in ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) == math.ceil(sum(r.length for r in rows) / 2048)
    assert packing.pack(none, packing.public_tokenizers.path(packing.MODEL)).count() == 0


def test_pattern_plan():
    hist = np.zeros(65, np.int64)
    hist[1:] = np.random.default_rng(1).integers(0, 50, 64)
    used = Counter()
    for pattern, n in packing.plan(hist, 64):
        assert sum(pattern) <= 64
        for k in pattern:
            used[k] += n
    assert all(used[k] == hist[k] for k in range(65))


def test_toxicity(spark, none):
    r = np.random.default_rng(3)
    rows = [(i, " ".join([*r.choice(WORDS, 40), *(["vile"] * (i % 2)), *r.choice(WORDS, 40)])) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (5000, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).toPandas()
    held = got[got.held_out & (got.doc_id < 300)]
    assert len(got) == 302 and got.score.between(0, 1).all()
    assert ((held.doc_id % 2) == held.predicted).mean() > 0.9
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).count() == 302
    for few in (labels.limit(0), labels.where("toxic = 1"), labels.where("doc_id > 4000 or doc_id % 2 = 1")):  # nothing tells two kinds apart
        assert toxicity.without_toxic(docs, few).count() == 302


def test_toxicity_samples_a_repeated_id_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c d"), (1, "c d"), (2, None), (3, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, id_col="doc_id", text_col="text", label_col="toxic").collect()
    assert len({r.doc_id for r in got}) == len(got) > 0


def test_near_duplicates(docs, none):
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(1, 1), (2, 1), (3, 1)] + [(i, i) for i in range(4, 11)] + [(11, 11)] * 2
    assert near_dedup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("n,more,size", [(20, 3, 150), (90, 10, 150), (130, 25, 1024), (700, 90, 1024)])
def test_signatures_of_texts_of_different_lengths(n, more, size):
    seen = []
    for t in range(60):
        keys = np.random.default_rng(t).integers(0, 2**63, n + more).astype(np.uint64)
        a, b = near_dedup.signature(keys[:n], np.ones(n, int), size), near_dedup.signature(keys, np.ones(n + more, int), size)
        seen.append((a == b).mean())
    assert abs(np.mean(seen) - n / (n + more)) < 0.02


def test_signature_is_unbiased():
    r = np.random.default_rng(1)
    keys = r.integers(0, 2**63, 300).astype(np.uint64)
    a = r.integers(1, 9, 300)
    b = np.where(r.random(300) < 0.3, r.integers(1, 9, 300), a)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    seen = [(near_dedup.signature(k, a) == near_dedup.signature(k, b)).mean() for k in (common.mix64(keys + np.uint64(t)) for t in range(40))]
    assert abs(np.mean(seen) - want) < 0.03


def kneser_ney(train):
    """An interpolated modified Kneser-Ney model of pairs, plainly: ``p(word, before)``."""
    pairs, words = Counter(), Counter()
    for t in train:
        w = [*t, None]
        words.update(w)
        pairs.update(zip(["^", *t], w))
    spread, totals = Counter(w for _, w in pairs), Counter()
    for (u, _), n in pairs.items():
        totals[u] += n

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in range(5)]
        return lm.discounts(np.array(n[1:]))

    d2, d1 = discounts(pairs.values()), discounts(spread.values())
    left = sum(d1[min(n, 3)] for n in spread.values())

    def p(w, u):
        low = (max(spread[w] - d1[min(spread[w], 3)], 0) + left / (len(words) + 1)) / len(pairs)
        if not totals[u]:
            return low
        n = pairs[u, w]
        return max(n - d2[min(n, 3)], 0) / totals[u] + sum(d2[min(k, 3)] for (x, _), k in pairs.items() if x == u) / totals[u] * low

    return p, words


def test_kneser_ney(spark, docs, none):
    held = {1, 9}
    rows = [(i, t or "") for i, t, *_ in ROWS]
    split = {t: [w.decode() for w in t.lower().encode().split()] for _, t in rows}
    p, words = kneser_ney([split[t] for i, t in rows if i not in held])
    n, v = sum(words.values()), len(words)
    model = lm.train(docs.where("doc_id not in (1, 9)").select("text"))
    for r in lm.score(docs, model, held_out="doc_id in (1, 9)").collect():
        t = split[next(x for i, x in rows if i == r.doc_id)]
        tokens = [*t, None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(tokens), sum(words[w] > 0 for w in tokens), n)
        assert abs(r.base_score - sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens)) < 1e-6
        assert abs(r.score - sum(math.log10(p(w, u)) for u, w in zip(["^", *t], tokens))) < 1e-6
    for u in ("^", "w1", "w2", "never"):  # one place is left for the words that are not known
        assert abs(sum(p(w, u) for w in words) + p("never seen", u) - 1) < 1e-9
    assert lm.score(none, lm.train(none.select("text"))).count() == 0
    assert all(r.n_known == 0 and r.score <= 0 for r in lm.score(docs, lm.train(none.select("text"))).collect())


def shares(sizes, copies=3, weights=(1, 2, 3)):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, full, out = float(sum(sizes.values())), set(), {}
    while True:
        free = [s for s in names if s not in full]
        out |= {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if out[s] > copies * sizes[s]]
        if not over:
            return out
        for s in over:
            out[s] = float(copies * sizes[s])
            left -= out[s]
        full |= set(over)


def test_mixing(spark, docs, none):
    more = [(100 + i, text(i, 5 + 7 * i % 300), "en", None if i % 9 == 0 else f"s{i % 7}", 0, "x") for i in range(300)] + [(700, text(1, 6000), "en", "s3", 0, "x")]
    for rows in (ROWS, [*ROWS, *more]):
        got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).toPandas()
        want = Counter((r[0], len((r[1] or "").encode().split())) for r in rows)
        assert Counter(zip(got.doc_id.tolist(), got["size"].tolist())) == want
        assert (got.copies.between(0, 3)).all() and (got.taken == got.copies * got["size"]).all()
        sizes = Counter()
        for r in rows:
            sizes[r[3]] += len((r[1] or "").encode().split())
        aims = shares(sizes)
        for source, part in got.groupby("source", dropna=False):
            source = None if source != source else source
            assert part.source_size.iloc[0] == sizes[source] and abs(part.target.iloc[0] - aims[source]) < 1e-6
            assert abs(part.taken.sum() - aims[source]) <= max(0.02 * aims[source], part["size"].min(), 200 if rows is ROWS else 0)
    again = mixing.mix(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert got.sort_values("key").taken.tolist() == again.sort_values("key").taken.tolist()
    assert mixing.mix(none).count() == 0


def test_mixed_rows_keep_all_columns(spark):
    rows = [(i, text(i, 20), "a" if i % 3 else "b", i, -i, f"k{i}", 7) for i in range(40)] + [(3, text(3, 20), "b", 3, -3, "k3", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _n long, _i long, _key string, `_copies` int")
    got = Counter(map(tuple, mixing.mixed_rows(docs).collect()))
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.copies
    assert set(got) <= set(rows)
    counted = Counter()
    for r, n in got.items():
        counted[r[0]] += n
    assert counted == +taken


def test_token_counts(docs, none):
    c = token_counts.counter(token_counts.public_tokenizers.path(token_counts.MODEL))
    for t in ("", " ", "a  b ", "▁x▁ y", "</s> <s>", "é" * 90, text(1), "the" * 60, "a\n\nb\tc", "日本語" * 25):
        assert c.table(t).tolist() == [len(c.model.encode(t[:p])) for p in range(len(t) + 1)]
    got = token_counts.token_counts(docs, token_counts.public_tokenizers.path(token_counts.MODEL), 100).collect()
    for r in got:
        t = next(x[1] for x in ROWS if x[0] == r.doc_id) or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(c.model.encode(t)), len(c.model.encode(t)) > 100)
        assert len(c.model.encode(t[: r.fit_chars])) <= 100
    assert token_counts.prefix_counts(none, token_counts.public_tokenizers.path(token_counts.MODEL)).count() == 0


def test_quality(spark, docs, none):
    got = quality.quality(docs).collect()
    assert len(got) == len(ROWS) and all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert quality.rules("a b c a b c x\n\na b c a b c x\n#$") == (15, 16, 2, 1, 14)
    model = quality.train(spark.createDataFrame([("=en", "abracadabra"), ("=en", "abcab")], "lang string, text string"))
    signs = sorted(set("abracadabra")) + [chr(quality.END), "?"]
    for before in ("abr", "zzz"):
        g = np.array([sum(ord(x) << (16 * (3 - i)) for i, x in enumerate(before + a)) for a in signs], np.uint64)
        assert abs((10 ** model.log_probabilities("=en", g)).sum() - 1) < 1e-9
    assert quality.quality(none).count() == 0


def removed(rows, length=50):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            first.setdefault(b[s : s + length], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            gone[s : s + length] |= first[b[s : s + length]] < i
        out.append((i, len(b), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0))
    return sorted(out)


def test_suffix_dedup(docs, none):
    got = suffix_dedup.remove_repeats(docs)
    assert {"lang", "score", "kept_text"} <= set(got.columns)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got.collect()) == removed([r[:2] for r in ROWS])
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_paragraphs(docs, none):
    got = paragraph_dedup.paragraph_classes(docs).collect()
    assert {(r.doc_id, r.place, r.removed) for r in got} >= {(1, 0, False), (2, 0, True), (8, 1, False), (9, 1, True)}
    assert paragraph_dedup.paragraph_classes(none).count() == 0
    kept = {r.doc_id: r.kept_text for r in paragraph_dedup.remove_paragraphs(docs).collect()}
    assert kept[2] == "" and text(9) not in kept[9] and kept[8] == ROWS[7][1]


def test_toxicity_scores_every_window():
    net, r = toxicity.Network(3), np.random.default_rng(5)
    net.p["word"], net.p["known"] = r.normal(0, 0.5, net.p["word"].shape).astype(np.float32), np.ones_like(net.p["known"])
    texts = ["", "w1", text(2, 32), text(3, 33), text(4, 200), text(5, 3000)]
    import pyarrow as pa

    got = toxicity.judge_of(net)(pa.array(texts))
    for t, score in zip(texts, got):
        w = t.split()
        cuts = [w[s : s + 32] for s in range(max(1, len(w) - 31))]
        alone = toxicity.judge_of(net)(pa.array([" ".join(c) for c in cuts]))
        assert abs(score - alone.max()) < 1e-4


def test_toxicity_learns_from_every_window(spark):
    r = np.random.default_rng(4)
    labelled = [(i, i % 2, " ".join(np.insert(r.choice(WORDS, 1500).astype(object), r.integers(1500), ["vile", "scum"] if i % 2 else []))) for i in range(6)]
    net = toxicity.Network(3)
    vile = toxicity.xxhash.xxh3_64_intdigest("vile") % toxicity.WORD_ROWS
    net.p["known"][vile], net.p["word"][vile] = 1, 5
    got = toxicity.highest(spark.createDataFrame(labelled, "doc_id long, y int, text string"), net)
    import pyarrow as pa

    judge = lambda texts: toxicity.judge_of(net)(pa.array(texts))
    for (_, y, t), (label, logit, words) in zip(labelled, got):
        w = t.split()
        every = judge([" ".join(w[s : s + 32]) for s in range(len(w) - 31)])
        assert label == y and abs(1 / (1 + np.exp(-logit)) - every.max()) < 1e-4 and abs(judge([" ".join(words)])[0] - every.max()) < 1e-4


def test_paragraphs_of_any_length(spark):
    line = " ".join(WORDS[:60]).replace("w11 ", "w11. ").replace("w23 ", "w23. ").replace("w35 ", "w35. ").replace("w47 ", "w47. ")
    like = line.replace("w29 ", "other ")  # a word in the middle of the third sentence
    short = "He said no. She  left!\n* one two\nMIT License"
    rows = [(1, line + "\n" + text(1)), (2, text(2) + ".\n" + like), (3, short), (4, text(3) + ".\n" + short.lower()), (5, "He said yes.\n" + text(4)), (6, text(5) + ". w24 w25 w26 w27 w28 other w30 w31 w32 w33 w34 w35. " + text(6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.kept_text for r in paragraph_dedup.remove_paragraphs(docs).collect()}
    assert kept == {**dict(rows), 2: text(2) + ".\n", 4: text(3) + ".\n"}
    counts = {r.doc_id: (r.n_repeated, r.n_removed) for r in paragraph_dedup.by_document(paragraph_dedup.paragraph_classes(docs)).collect()}
    assert counts == {1: (5, 0), 2: (5, 5), 3: (4, 0), 4: (4, 4), 6: (1, 0)}


def test_fingerprints_of_a_hot_group_and_of_rare_terms(spark):
    r = np.random.default_rng(9)
    hot = [f"h{k}" for k in range(300)]
    other = [(100 + i, " ".join([*r.choice(WORDS, 30), *r.choice(hot, 4)])) for i in range(120)]
    rows = [(i, " ".join(hot)) for i in range(60)] + other + [(500, " ".join(f"rare{k}" for k in range(200)))]
    got = {x.doc_id: x for x in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # the hot group's terms are in few of the distinct texts, and stay in the lexicon; the copies' edited text is the text again
    assert not got[0].fingerprint.startswith("~") and "-" not in got[0].fingerprint
    assert got[59].near_edited > 0.4 and got[58].near_next == 1
    assert got[500].fingerprint.startswith("~") and got[500].near_edited > 0.15 and got[500].near_next < 0.2


@pytest.mark.parametrize("copies", [140, 1060])  # a third and four fifths of the rows
def test_quality_bands_with_copies_and_gibberish(spark, copies):
    r = np.random.default_rng(2)
    clean = [(i, " ".join(r.choice(WORDS, 150))) for i in range(200)]
    hot = [(1000 + i, " ".join(r.permutation([f"{w}x" for w in WORDS[:150]]) if not i else [])) for i in range(1)]
    rows = clean + [(1000 + i, hot[0][1]) for i in range(copies)]
    rows += [(5000 + i, " ".join("".join(map(chr, r.integers(0x4E00, 0x9000, 6))) for _ in range(150))) for i in range(3)]
    rows += [(6000 + i, "junk junk " * 400 + str(i)) for i in range(60)]
    got = {x.doc_id: x for x in quality.quality(spark.createDataFrame([(*x, "en") for x in rows], "doc_id long, text string, lang string")).collect()}
    assert sum(got[i].kept for i in range(200)) >= 195
    assert not any(got[5000 + i].kept for i in range(3)) and all(got[6000 + i].base_failed for i in range(60))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(3000)], "a long, b long")
    got = common.components(edges).agg({"node": "count", "root": "max"}).first()
    assert tuple(got) in ((3001, 0), (0, 3001))


def test_pairs_of_equal_hashes_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(common, "pair_hash", lambda a, b: np.zeros(len(a), np.uint64))
    a, b = np.array([1, 1, 2, 9]), np.array([5, 6, 5, 9])
    common.write_pairs(str(tmp_path), 0, a, b)
    files = common.PairFiles(str(tmp_path), 2)
    found = files.find(np.array([1, 2, 2, 9, 7]), np.array([6, 5, 6, 9, 7]))
    assert (found >= 0).tolist() == [True, True, False, True, False] and len(set(found[found >= 0])) == 3


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 10, None, "b" * 50, "", "c" * 5, "d" * 5])], names=["i", "t"])
    cut = [b.column(0).to_pylist() for b in common.slices([batch, batch.slice(0, 0)], 2, 20)]
    assert cut == [[0, 1], [2], [3, 4], [5]]


def test_words_are_told_apart_by_a_mark():
    """Ids are those of the whole text, without offsets; words that hold the mark are told apart by offsets."""
    enc = packing.WordIds(public_tokenizers.path(packing.MODEL))
    whole = enc.tokenizer

    class Watched:
        asked = 0

        def encode(self, *args, **more):
            self.asked += 1
            return whole.encode(*args, **more)

        def __getattr__(self, name):
            return getattr(whole, name)

    enc.tokenizer = Watched()
    plain = ["It's 1st, don't; Don'T", "é ́x ǅ東京 a\tb c\x0b\r\n\n d", "<|endoftext|>x <|startoftext|> …``", None, "", " "]
    odd = [f"a{packing.MARK}b {packing.MARK} c", packing.MARK * 3]
    for texts, often in ((plain, 0), (odd, 1)):
        ids, begins = enc.encode(pa.array(texts))
        for text, a, b in zip(texts, begins, begins[1:]):
            assert ids[a:b].tolist() == whole.encode(text or "", add_special_tokens=False).ids, text
        assert enc.tokenizer.asked == often
