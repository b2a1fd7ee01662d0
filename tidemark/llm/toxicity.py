"""Toxicity scores by a bidirectional gated recurrent network with attention pooling (operator 3).

A word's input is a hashed word embedding beside the mean of hashed character-trigram embeddings. The network reads
windows of ``WINDOW`` words that start at every word (a shorter text is one window), pools its states by attention, and
gives a logit. A text's score is the logistic of its highest window's logit. Training, in numpy on the driver, is
multiple-instance: a labelled text's loss goes through the highest of all its windows, which Spark tasks find anew every
few epochs. It uses at most ``SAMPLE`` texts of each label, chosen by hash; the threshold's place is set on all windows
of the fifth of these texts that training holds back. Scoring reads every word of every text.

Null, empty and blank texts get the score of a window without words; repeated rows score alike; a null doc_id is scored
and not held out; rows of labels that are null or name no document are not used; an empty table gives no rows. Without
both labels the score is the share of label 1 (0 without any label). Other columns of the input are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 32
#: Bound of what is learned from: texts of each label.
SAMPLE = 1500
THRESHOLD = 0.3
#: Texts of label 1 that it takes to weigh them against those of label 0.
FEW = 4
#: Standard errors of a word's log odds ratio that count as chance.
CHANCE = 1.5
WORD_ROWS, GRAM_ROWS, WORD_DIM, GRAM_DIM, HIDDEN = 1 << 15, 1 << 13, 8, 8, 8
#: Texts that are scored together, and windows of them in one call.
SLICE, BLOCK = 500, 4096
#: Words whose projections a worker keeps; beyond this the store is begun anew.
KEPT = 150_000


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding rows of the words, trigram rows of all their characters, and where each word's trigrams begin."""
    rows = np.fromiter((xxhash.xxh3_64_intdigest(w) % WORD_ROWS for w in words), np.int64, len(words))
    points = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) + np.repeat(2 * np.arange(len(words)), lengths)
    with np.errstate(over="ignore"):
        grams = common.mix64((points[at] << np.uint64(42)) ^ (points[at + 1] << np.uint64(21)) ^ points[at + 2]) % np.uint64(GRAM_ROWS)
    return rows, grams.astype(np.int64), begins


class Network:
    """Parameters, inputs of words, and the passes forward and backward."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + GRAM_DIM, HIDDEN
        self.p = {
            "word": np.zeros((WORD_ROWS, WORD_DIM)), "gram": r.normal(0, 0.3, (GRAM_ROWS, GRAM_DIM)),
            "wf": r.normal(0, d**-0.5, (d, 3 * h)), "uf": r.normal(0, h**-0.5, (h, 3 * h)), "bf": np.zeros(3 * h),
            "wb": r.normal(0, d**-0.5, (d, 3 * h)), "ub": r.normal(0, h**-0.5, (h, 3 * h)), "bb": np.zeros(3 * h),
            "known": np.zeros(WORD_ROWS), "att": r.normal(0, 0.5, 2 * h), "out": r.normal(0, 0.5, 2 * h), "bias": np.full(1, -2.0),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def inputs(self, features: tuple) -> np.ndarray:
        rows, grams, begins = features
        n = np.diff(np.append(begins, len(grams)))
        means = np.add.reduceat(self.p["gram"][grams], begins, axis=0) / n[:, None].astype(np.float32) if len(rows) else np.zeros((0, GRAM_DIM), np.float32)
        return np.concatenate([self.p["word"][rows] * self.p["known"][rows, None], means], axis=1).astype(np.float32)

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]

    def direction(self, proj: np.ndarray, u: np.ndarray, ids: np.ndarray, mask: np.ndarray, back: bool, keep: list | None, states: np.ndarray) -> None:
        """Run one direction; ``proj`` has the input part of the gates by word. Gates are hard sigmoids."""
        h, n = np.zeros((len(ids), HIDDEN), np.float32), HIDDEN
        for t in range(ids.shape[1])[:: -1 if back else 1]:
            a, m = proj[ids[:, t]], mask[:, t, None]
            s = h @ u
            g = np.clip(0.25 * (a[:, : 2 * n] + s[:, : 2 * n]) + 0.5, 0, 1)
            c = np.tanh(a[:, 2 * n :] + g[:, n:] * s[:, 2 * n :])
            new = c + g[:, :n] * (h - c)
            if keep is not None:
                keep.append((t, h, s, g, c))
            h = h + m * (new - h)
            states[:, t] = h

    def forward(self, projs: tuple, ids: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple:
        """Logits of windows of word numbers; ``mask``: 1 where there is a word."""
        b, t = ids.shape
        hf, hb = np.empty((b, t, HIDDEN), np.float32), np.empty((b, t, HIDDEN), np.float32)
        kf, kb = ([], []) if keep else (None, None)
        self.direction(projs[0], self.p["uf"], ids, mask, False, kf, hf)
        self.direction(projs[1], self.p["ub"], ids, mask, True, kb, hb)
        n = HIDDEN
        e = hf @ self.p["att"][:n] + hb @ self.p["att"][n:] - 1e4 * (1 - mask)
        w = np.exp(e - e.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        pooled = np.concatenate([np.matmul(w[:, None], hf)[:, 0], np.matmul(w[:, None], hb)[:, 0]], axis=1)
        return pooled @ self.p["out"] + self.p["bias"][0], (hf, hb, w, pooled, kf, kb)

    def backward(self, x: np.ndarray, features: tuple, ids: np.ndarray, mask: np.ndarray, state: tuple, grad: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of all parameters from those of the logits."""
        hf, hb, w, pooled, kf, kb = state
        g, n = {"out": pooled.T @ grad, "bias": np.array([grad.sum()], np.float32)}, HIDDEN
        dp = grad[:, None] * self.p["out"]
        dx = np.zeros_like(x)
        da = np.matmul(hf, dp[:, :n, None])[..., 0] + np.matmul(hb, dp[:, n:, None])[..., 0]
        de = w * (da - (w * da).sum(axis=1, keepdims=True))
        g["att"] = np.concatenate([np.einsum("bt,bth->h", de, hf), np.einsum("bt,bth->h", de, hb)])
        for half, keep, wk, uk, bk in ((0, kf, "wf", "uf", "bf"), (1, kb, "wb", "ub", "bb")):
            part = slice(half * n, half * n + n)
            dstates = w[..., None] * dp[:, None, part] + de[..., None] * self.p["att"][part]
            u, du, dh = self.p[uk], np.zeros_like(self.p[uk]), np.zeros((len(ids), n), np.float32)
            dproj = np.zeros((len(x), 3 * n), np.float32)
            for t, h, s, gate, c in reversed(keep):
                dh = dh + dstates[:, t]
                m = mask[:, t, None]
                dnew = m * dh
                z, r = gate[:, :n], gate[:, n:]
                dc = dnew * (1 - z) * (1 - c * c)
                dgate = np.concatenate([dnew * (h - c), dc * s[:, 2 * n :]], axis=1) * 0.25 * ((gate > 0) & (gate < 1))
                ds = np.concatenate([dgate, dc * r], axis=1)
                np.add.at(dproj, ids[:, t], np.concatenate([dgate, dc], axis=1))
                du += h.T @ ds
                dh = (1 - m) * dh + dnew * z + ds @ u.T
            g[uk], g[wk], g[bk] = du, x.T @ dproj, dproj.sum(axis=0)
            dx += dproj @ self.p[wk].T
        rows, grams, begins = features
        g["word"], g["gram"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["gram"])
        np.add.at(g["word"], rows, dx[:, :WORD_DIM] * self.p["known"][rows, None])
        count = np.diff(np.append(begins, len(grams)))
        np.add.at(g["gram"], grams, np.repeat(dx[:, WORD_DIM:] / count[:, None], count, axis=0))
        return g


def split_words(texts: pa.Array) -> pa.ListArray:
    """The words of each text in lower case; null is empty, white space at the ends leaves empty strings."""
    return pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))


def word_lists(texts: pa.Array) -> list[list[str]]:
    return [[w for w in words if w] for words in split_words(texts).to_pylist()]


def windows(n: int) -> range:
    """Where the windows over n words start."""
    return range(max(1, n - WINDOW + 1))


def train(examples, known: np.ndarray, prior: np.ndarray, *, steps: int = 700, batch: int = 24, rate: float = 0.05, decay: float = 0.1, seed: int = 7) -> tuple[Network, np.ndarray, np.ndarray]:
    """Fit a network; also gives the held-back fifth of the texts, which tells when to stop, as logits and labels.

    ``examples(net)`` gives ``(label, logit, words)`` of every text's highest window among all its windows under ``net``, in
    the same order at each call; ``examples(None)`` takes the windows that hold most of the words that speak for label 1. It is
    called up to 17 times. ``known``: rows of words that have an embedding of their own, others have only their characters';
    ``prior``: how much each of them speaks for label 1, with which the embeddings begin.
    """
    net, r = Network(seed), np.random.default_rng(seed)
    net.p["known"][known] = 1
    net.p["word"][known, 0] = prior / 2
    now = examples(None)
    labels = np.array([y for y, *_ in now], np.float32)
    held = r.permutation(len(now)) % 5 == 0
    names = [k for k in net.p if k != "known"]
    m1, m2 = ({k: np.zeros_like(net.p[k]) for k in names} for _ in range(2))
    epochs = min(60, max(8, steps * batch // max(1, int((~held).sum()))))
    every = -(-epochs // 15)
    best, kept, kept_high, step, epoch = np.inf, dict(net.p), None, 0, 0
    while epoch < epochs:
        words = [".", *sorted({x for _, _, w in now for x in w})]
        number = {w: k for k, w in enumerate(words)}
        ids = np.array([[number[x] for x in w] + [0] * (WINDOW - len(w)) for *_, w in now], np.int64)
        mask = np.array([[1] * len(w) + [0] * (WINDOW - len(w)) for *_, w in now], np.float32)
        for _ in range(every if epoch else 1):
            epoch += 1
            top = np.flatnonzero(~held)
            for some in np.array_split(r.permutation(top), max(1, len(top) // batch)):
                used, local = np.unique(ids[some], return_inverse=True)
                f = word_features([words[k] for k in used])
                x = net.inputs(f)
                out, state = net.forward(net.project(x), local.reshape(ids[some].shape), mask[some], keep=True)
                grad = ((1 / (1 + np.exp(-out)) - labels[some]) / len(some)).astype(np.float32)
                grads = net.backward(x, f, local.reshape(ids[some].shape), mask[some], state, grad)
                step += 1
                for k in names:
                    m1[k] += 0.1 * (grads[k] - m1[k])
                    m2[k] += 0.01 * (grads[k] * grads[k] - m2[k])
                    net.p[k] = net.p[k] - (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
                    if k in ("word", "gram"):
                        net.p[k] *= np.float32(1 - rate * decay)
        now = examples(net)
        high = np.array([logit for _, logit, _ in now])
        loss = float(np.mean(np.logaddexp(0, np.where(labels > 0, -high, high))[held]))
        if loss < best:
            best, kept, kept_high = loss, {k: v.copy() for k, v in net.p.items()}, high
    net.p = kept
    return net, kept_high[held], labels[held]


def moved_bias(net: Network, logits: np.ndarray, labels: np.ndarray, weight: float) -> None:
    """Move the bias so that ``THRESHOLD`` is where the F-half of these texts is best (precision counts more), a text of
    label 0 counting ``weight`` times; with less than ``FEW`` texts of label 1, above all texts of label 0."""
    if not 0 < labels.sum() < len(labels):
        return
    order = np.argsort(-logits)
    y = labels[order]
    good, bad = np.cumsum(y), np.cumsum((1 - y) * weight)
    k = int(np.argmax(1.25 * good / (good + bad + 0.25 * y.sum())))
    cut = (logits[order][k] + logits[order][min(k + 1, len(order) - 1)]) / 2
    if y.sum() < FEW:
        cut = max(cut, logits[labels == 0].max())
    net.p["bias"] = net.p["bias"] - np.float32(cut - np.log(THRESHOLD / (1 - THRESHOLD)))


def usable_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``(doc_id, y)`` of rows to learn from: one a document, never held out."""
    rows = labels.selectExpr(f"cast({id_col} as long) doc_id", f"cast({label_col} as int) y")
    return rows.where("doc_id is not null and y in (0, 1) and pmod(crc32(cast(doc_id as string)), 4) != 2").groupBy("doc_id").agg(F.max("y").alias("y"))


def sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, most: int = SAMPLE) -> DataFrame:
    """``(doc_id, y, text)`` of at most ``most`` labelled texts of each label, none of them held out; the least hashes are taken, of ids as
    of the texts of a repeated id."""
    usable = usable_labels(labels, id_col, label_col)
    picked = None
    for y in (0, 1):  # a sort with a limit keeps a bounded heap in each task
        some = usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(most)
        picked = some if picked is None else picked.union(some)
    rows = docs.selectExpr(f"cast({id_col} as long) doc_id", f"coalesce({text_col}, '') text").join(F.broadcast(picked), "doc_id")  # at most 2 * most ids
    rows = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # one a sampled id
    return common.materialize(rows.select("doc_id", "y", "text").repartition(docs.sparkSession.sparkContext.defaultParallelism))


def known_rows(texts: DataFrame, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The embedding rows of words in at least ``least`` of ``texts(y, text)``, and how far the ratio of their odds under the two
    labels is from chance: its logarithm in standard errors, less what chance gives to most words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, SLICE):
            seen = Counter((w, y) for words, y in zip(word_lists(b.column(1)), b.column(0).to_pylist()) for w in set(words))
            h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w, _ in seen), np.uint64, len(seen)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([y for _, y in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["h", "y", "n"])

    own = texts.select("y", "text").mapInArrow(run, "h long, y int, n long").groupBy("h").agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n1"))
    rows = own.where(F.col("n0") + F.col("n1") >= least).groupBy(F.pmod("h", F.lit(WORD_ROWS)).alias("row")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect()  # at most WORD_ROWS
    at, n0, n1 = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    total = {0: 1, 1: 1} | dict(texts.groupBy("y").count().collect())
    odds = np.log((n1 + 0.5) / (np.maximum(total[1] - n1, 0) + 0.5)) - np.log((n0 + 0.5) / (np.maximum(total[0] - n0, 0) + 0.5))
    z = odds / np.sqrt(sum(1 / (n + 0.5) for n in (n0, n1, np.maximum(total[0] - n0, 0), np.maximum(total[1] - n1, 0))))
    return at, (np.sign(z) * np.maximum(np.abs(z) - CHANCE, 0)).astype(np.float32)


def highest(texts: DataFrame, net: Network | None, prior: np.ndarray | None = None) -> list[tuple[int, float, list[str]]]:
    """``(y, logit, words)`` of the highest of all windows of each text of ``texts(doc_id, y, text)``; without a network, of the
    window whose words' ``prior``, by embedding row, has the largest sum. Tasks send one window a text."""
    scorer = scorer_of(net) if net else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, SLICE):
            split = word_lists(b.column(2))
            if scorer:
                logits, at = scorer().top(b.column(2))
            else:
                logits, at = np.zeros(len(split)), []
                for words in split:
                    sums = np.concatenate([[0], np.cumsum(np.maximum(prior[[xxhash.xxh3_64_intdigest(w) % WORD_ROWS for w in words]], 0) if words else [])])
                    at.append(int(np.argmax(sums[WINDOW:] - sums[:-WINDOW])) if len(words) > WINDOW else 0)
            cut = [w[s : s + WINDOW] for w, s in zip(split, at)]
            hashes = [xxhash.xxh3_64_hexdigest(" ".join(w)) for w in split]
            kinds = (pa.float64(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, t) for x, t in zip((logits, cut, hashes), kinds))], names=["doc_id", "y", "logit", "words", "hash"])

    got = texts.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, logit double, words array<string>, hash string").collect()
    return [(r.y, r.logit, r.words) for r in sorted(got, key=lambda r: (r.doc_id, r.hash))]


class Scorer:
    """A network with the projections of the words that this worker has met."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.net = Network()
        self.net.p = params
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.projs = tuple(np.zeros((0, 3 * HIDDEN), np.float32) for _ in range(2))
        self.room = 0
        self.learn(["."])

    def learn(self, new: list[str]) -> None:
        n = len(self.number)
        if n + len(new) > self.room:
            self.room = max(2 * self.room, n + len(new), 4096)
            grown = tuple(np.zeros((self.room, 3 * HIDDEN), np.float32) for _ in range(2))
            for a, b in zip(grown, self.projs):
                a[:n] = b[:n]
            self.projs = grown
        for k, p in zip(range(2), self.net.project(self.net.inputs(word_features(new)))):
            self.projs[k][n : n + len(new)] = p
        self.number.update(zip(new, range(n, n + len(new))))

    def sliding(self, ids: np.ndarray) -> np.ndarray:
        """Logits of the windows that start at each of the word numbers but the last ``WINDOW - 1``.

        Neighbours' inputs at a step are neighbours in memory, so that a step is a few operations on whole arrays.
        """
        n, h, p = len(ids) - WINDOW + 1, HIDDEN, self.net.p
        scale = np.repeat(np.float32([0.25, 1]), [2 * h, h])
        shift = np.repeat(np.float32([0.5, 0]), [2 * h, h])
        out = np.empty(n, np.float32)
        for i in range(0, n, BLOCK):
            b, some = min(BLOCK, n - i), ids[i : i + BLOCK + WINDOW - 1]
            e, v = np.zeros((WINDOW, b), np.float32), np.zeros((WINDOW, b), np.float32)
            for proj, u, part, steps in ((self.projs[0], p["uf"], slice(0, h), range(WINDOW)), (self.projs[1], p["ub"], slice(h, None), range(WINDOW)[::-1])):
                a = np.ascontiguousarray((proj[some] * scale + shift).T)
                m = np.concatenate([(u * scale).T, [p["att"][part], p["out"][part]]]).astype(np.float32)
                states = np.zeros((h, b), np.float32)
                s = np.zeros((3 * h + 2, b), np.float32)
                g, c = np.empty((2 * h, b), np.float32), np.empty((h, b), np.float32)
                for t in steps:
                    np.add(a[: 2 * h, t : t + b], s[: 2 * h], out=g)
                    np.clip(g, 0, 1, out=g)
                    np.multiply(g[h:], s[2 * h : 3 * h], out=c)
                    c += a[2 * h :, t : t + b]
                    np.tanh(c, out=c)
                    states -= c
                    states *= g[:h]
                    states += c
                    np.matmul(m, states, out=s)
                    e[t] += s[3 * h]
                    v[t] += s[3 * h + 1]
            e -= e.max(axis=0)
            np.exp(e, out=e)
            out[i : i + b] = np.einsum("tb,tb->b", e, v) / e.sum(axis=0) + p["bias"][0]
        return out

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The word numbers of all texts, one after another, and how many each has."""
        words = split_words(texts)
        told = words.flatten().dictionary_encode()
        distinct = told.dictionary.to_pylist()
        new = [w for w in distinct if w and w not in self.number]
        if len(self.number) + len(new) > KEPT:
            self.reset()
            new = [w for w in distinct if w and w != "."]
        if new:
            self.learn(sorted(new))
        known = np.array([self.number[w] if w else -1 for w in distinct], np.int64)
        ids = known[told.indices.to_numpy()] if len(distinct) else np.zeros(0, np.int64)
        full = np.concatenate([[0], np.cumsum(ids >= 0)])
        return ids[ids >= 0], np.diff(full[np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])])

    def top(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The logit of the highest of all windows of each text, and where it starts."""
        numbers, n = self.numbers(texts)
        ends = np.cumsum(n)
        best, start = np.empty(len(n)), np.zeros(len(n), np.int64)
        short, long = np.flatnonzero(n <= WINDOW), np.flatnonzero(n > WINDOW)
        if len(short):
            ids, mask = np.zeros((len(short), WINDOW), np.int64), (np.arange(WINDOW) < n[short, None]).astype(np.float32)
            for row, k in zip(ids, short.tolist()):
                row[: n[k]] = numbers[ends[k] - n[k] : ends[k]]
            best[short] = self.net.forward(self.projs, ids, mask)[0]
        if len(long):
            logits = self.sliding(np.concatenate([numbers[ends[k] - n[k] : ends[k]] for k in long.tolist()]))
            begins = np.cumsum(n[long]) - n[long]
            for k, b in zip(long.tolist(), begins.tolist()):
                own = logits[b : b + len(windows(int(n[k])))]
                start[k] = own.argmax()
                best[k] = own[start[k]]
        return best, start

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-self.top(texts)[0]))


def scorer_of(net: Network):
    """A function that gives the scorer in a task; a worker keeps what it has learned about words."""
    params = net.p
    name = xxhash.xxh3_64_hexdigest(b"".join(v.tobytes() for v in params.values()))

    return lambda: common.stored(("scorer", name), lambda: Scorer(params))


def judge_of(net: Network):
    """A function that scores texts in a task."""
    scorer = scorer_of(net)
    return lambda texts: scorer().scores(texts)


def score(docs: DataFrame, net: Network | None, share: float = 0.0, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row; without a network the score is ``share``."""
    judge = judge_of(net) if net else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, SLICE):
            s = judge(b.column(2)).astype(float) if judge else np.full(b.num_rows, share)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.selectExpr(f"cast({id_col} as long) doc_id", f"coalesce(pmod(crc32(cast(cast({id_col} as long) as string)), 4) = 2, false) held_out", f"{text_col} text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def fitted(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str) -> tuple[Network | None, float]:
    """A network, or none and the share of label 1."""
    usable = usable_labels(labels, id_col, label_col)
    n = {0: 0, 1: 0} | dict(usable.groupBy("y").count().collect())
    share = n[1] / max(1, n[0] + n[1])
    if not 0 < share < 1:
        return None, share
    texts = sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    got = dict(texts.groupBy("y").count().collect())
    if len(got) < 2:
        return None, share
    known, speaks = known_rows(texts)
    prior = np.zeros(WORD_ROWS, np.float32)
    prior[known] = speaks
    net, logits, held = train(lambda net: highest(texts, net, prior), known, speaks)
    moved_bias(net, logits, held, (n[0] / n[1]) / (got[0] / got[1]))
    return net, share


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Fit on the labelled rows that aren't held out and score every row."""
    return score(docs, *fitted(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col), id_col=id_col, text_col=text_col)


def without_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows, with all their columns, whose score is below ``THRESHOLD``; all rows if the labels don't tell two kinds apart."""
    net, _ = fitted(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    if net is None:
        return docs
    judge, at = judge_of(net), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, SLICE):
            yield b.filter(pa.array(judge(b.column(at)) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op3_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
