"""Operators 11, 12 and 13 against versions that do everything one by one."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import divergence, manifest, vector_dedup


def near(x, cosine, rng):
    z = rng.normal(size=x.shape)
    z -= (z @ x) * x / (x @ x)
    return cosine * x / np.linalg.norm(x) + (1 - cosine**2) ** 0.5 * z / np.linalg.norm(z)


def vector_rows():
    """Copies, scaled copies, groups of near copies, chains, pairs on both sides of the threshold, and what links with nothing."""
    r = np.random.default_rng(1)
    rows = [(k, r.normal(size=24)) for k in range(150)]
    rows += [(200 + k, rows[k % 5][1] * (1 if k % 2 else 3.5)) for k in range(30)]
    rows += [(300 + k, near(rows[7][1], 0.99, r)) for k in range(60)]
    rows += [(400 + k, near(rows[k][1], c, r)) for k in range(10, 140) for c in (0.9505, 0.94, 0.97)[k % 3 : k % 3 + 1]]
    chain = [rows[8][1]]
    for _ in range(12):
        chain.append(near(chain[-1], 0.955, r))
    rows += [(600 + k, x) for k, x in enumerate(chain)]
    rows = [(k, [float(v) for v in x]) for k, x in rows]
    tiny, huge = [v * 1e-200 for v in rows[3][1]], [v * 1e200 for v in rows[3][1]]
    odd = [(900, None), (901, []), (902, [0.0] * 24), (903, [1.0] * 23 + [None]), (904, [1.0] * 23 + [float("nan")]), (905, [1.0] * 23 + [float("inf")])]
    odd += [(906, [1.0, 0.0]), (907, [1.0, 0.1]), (908, [2.0]), (909, [3.0]), (910, tiny), (911, huge), (12, rows[12][1]), (12, rows[13][1]), (None, rows[14][1]), (None, [9.0, -9.0, 9.0]), (None, [8.0, -8.0, 8.0])]
    return rows + odd


def plain_links(rows):
    usable = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in usable}
    unit = {k: x / np.linalg.norm(x) for k, x in unit.items()}
    links = defaultdict(set)
    for a in usable:
        for b in usable:
            if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95:
                links[a].add(b)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, open_ = {k}, [k]
        while open_:
            for b in links[open_.pop()] - seen:
                seen.add(b)
                open_.append(b)
        known = [rows[x][0] for x in seen if rows[x][0] is not None]
        least = min(known) if known else None
        out.append((i, len(links[k]), least, i == least))
    return out


@pytest.mark.parametrize("block", [7, 2048])
def test_vectors_lose_no_link(spark, monkeypatch, block):
    """Also where buckets are compared block by block, and with columns of clashing names."""
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, node int, key string")
    got = [tuple(r) for r in vector_dedup.linked_vectors(df).collect()]
    key = lambda x: tuple(map(str, x))
    want = plain_links(rows)
    assert sorted(got, key=key) == sorted(want, key=key) and sum(n for _, n, *_ in want) > 4000
    assert vector_dedup.linked_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim, n", [(64, 50_000), (64, 10**9), (100, 10**6), (3, 1000), (2, 50)])
def test_recall_at_the_threshold(dim, n):
    """Pairs at the threshold itself share a bucket, with the setting of any number of vectors; other pairs hardly do."""
    r, setting = np.random.default_rng(dim), vector_dedup.setting(dim, n)
    x = r.normal(size=(1000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.stack([near(v, 0.95, r) for v in x])
    a, b = vector_dedup.bucket_keys(x, *setting), vector_dedup.bucket_keys(y, *setting)
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist())]) >= 0.997
    if dim > 3:
        keys = Counter(a.ravel().tolist())  # a thousand vectors apart from each other share few buckets
        assert sum(v - 1 for v in keys.values()) < a.size / 20


@pytest.mark.parametrize("few", [0, 30, 10**6])
def test_pairs_met_in_a_lesser_bucket(few):
    r = np.random.default_rng(3)
    keys = np.stack([r.permutation(60)[:12] for _ in range(50)]).astype(np.uint64)
    wanted = r.random((50, 50)) < 0.7
    got = vector_dedup.met_before(keys, np.uint64(25), wanted, few)
    want = np.array([[bool({x for x in a if x < 25} & set(b)) for b in keys.tolist()] for a in keys.tolist()])
    assert (got == want)[wanted].all() and want[wanted].any() and not want[wanted].all()


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, fan=16):
    def leaf(row, text):
        values = [str(v) if v is not None else None for v in (row[0], row[2], row[3], row[4])] + [text]
        return H(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])

    def up(nodes):
        """All levels, and for each node of the lowest one its steps: what is left and right of it."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k in range(len(at)):
                i = at[k]
                run = nodes[i - i % fan : i - i % fan + fan]
                paths[k].append((run[: i % fan], run[i % fan + 1 :]))
                at[k] = i // fan
            nodes = [H(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
        return nodes[0], paths

    first = lambda i: (i is not None, i or 0)
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in order:
        groups[s].sort(key=lambda row: (first(row[0]), leaf(row, row[1])))
        subs[s] = up([leaf(row, row[1]) for row in groups[s]])
    root, high = up([subs[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for row, path in zip(groups[s], subs[s][1]):
            whole = path + high[k]
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[1] is not None
            fold = leaf(row, re.sub("[A-Z]", lambda m: m[0].lower(), row[1]) if changed else row[1])
            for left, right in whole:
                fold = H(*left, fold, *right)
            out.append((row[0], leaf(row, row[1]), subs[s][0], root, H(*[d for left, right in whole for d in left + right]), fold, fold == root))
    return out


@pytest.mark.parametrize("n, fan", [(700, 16), (70, 2), (1, 16), (17, 16), (0, 16)])
def test_manifest(spark, n, fan):
    """One source holds most rows; nulls everywhere, repeated ids and rows, texts in other scripts, a clashing column."""
    r = np.random.default_rng(n)
    names = [None, "", "a", "B", "é", "src"]
    rows = []
    for k in range(n):
        source = "hot" if k % 3 else names[int(r.integers(6))]
        rows.append((None if k % 97 == 5 else int(k - k % 11 * (k % 7 == 0)), None if k % 53 == 3 else f"Text ÄB {k} " * int(r.integers(0, 9)), source, None if k % 31 == 0 else "en", None if k % 29 == 0 else k, "g"))
    rows += rows[:2] if n > 50 else []
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, g string")
    from pyspark.sql import functions as F

    every_fifth = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = manifest.manifest(df, fan=fan, tampered=F.translate("text", manifest.UPPER, manifest.LOWER), when=every_fifth).collect()
    key = lambda x: tuple(map(str, x))
    want = plain_manifest(rows, fan) if rows else []
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert n < 50 or {r.verified for r in got} == {True, False}


def plain_divergence(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    terms = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in term.findall(text or "")]) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in terms}:
        mine = [x for x in terms if x[0] == lang]
        docs, every = Counter(t for x in mine for t in set(x[2])), Counter(t for x in mine for t in x[2])
        kept = [t for t, d in docs.items() if d >= least]
        groups = {s: Counter(t for x in mine if x[1] == s for t in x[2] if docs[t] >= least) for s in {x[1] for x in mine}}
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c[u] for u in kept) + 2 * len(kept))
        value = {s: {t: p(c, t) for t in kept} for s, c in groups.items()}
        whole = {t: p(every, t) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in groups.items():
            pairs = [(-sum(f(value[s][t], value[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            words = [(-f(value[s][t], whole[t]), t.encode(), t) for t in kept if c[t] and value[s][t] > whole[t]]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(words)[:top])]
    return out


@pytest.mark.parametrize("block_rows, block_columns", [(32, 2048), (3, 8), (1, 1)])
def test_divergence(spark, block_rows, block_columns):
    """Tiles of all sizes, a source with most texts, sources and languages without terms, nulls, ties, a clashing column."""
    r = np.random.default_rng(7)
    words = [f"{a}{b}" for a in "aBcÄ東" for b in ("x", "Yz", "qq", "é")]
    rows = []
    for k in range(260):
        source = "hot" if k % 3 == 0 else ["s1", "s2", "S2", "é", None, "s9", "t"][k % 7]
        some = [words[int(i)] for i in (r.integers(0, len(words), 9) * (0.3 + 0.1 * (k % 7))).astype(int)]
        rows.append((" ".join(some) + " 12_3[x]" if k % 13 else None, ["en", "de", None][k % 3 if k % 5 else 0], source))
    rows += [("", "xx", "a"), ("only few terms", "xx", "b"), ("123", "yy", None)] + rows[:3]
    df = spark.createDataFrame([(*x, 1) for x in rows], "text string, lang string, source string, term int")
    got = [tuple(x) for x in divergence.divergence(df, rows=block_rows, columns=block_columns, least_docs=4, top=5).collect()]
    want = plain_divergence(rows, 4, 5)
    assert sorted(got) == sorted(want) and len(want) > 100
    assert divergence.divergence(df.limit(0)).count() == 0


def test_counts_are_sent_when_many_are_held(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 10)
    df = spark.createDataFrame([(f"w{'abcdefghij'[k % 10]} w{'klmnopqrst'[k % 10]} same", "en", f"s{k % 3}") for k in range(90)], "text string, lang string, source string")
    got = {(x.source, x.term): (x.n, x.docs) for x in divergence.counts(df).collect()}
    assert got["s0", "same"] == (30, 30) and got["s1", "wa"] == (3, 3) and got["s2", None] == (0, 0)
