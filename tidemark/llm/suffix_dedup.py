"""Exact removal of repeated passages by a column-wise multi-document construction (operator 9).

A byte goes if a ``length``-byte string that covers it also starts in a document with a smaller id:

0. Equal texts. A text that equals one of a smaller document goes whole and takes no part in what follows.
1. Anchors. In every window of ``length`` bytes the 16-byte string with the least hash is its anchor, so equal windows
   have equal anchors at equal places. Spark finds the anchor hashes that occur more than once (packed, in files).
2. Columns. Around each repeated anchor a task cuts a context of ``2 * length - 16`` bytes; equal contexts of a task are
   asked about once, for their least document. Spark deals the contexts by anchor, and each bucket takes them as the
   documents of one collection: every round inserts one symbol of each, and updates the collection's order by preceding
   symbols (its Burrows-Wheeler permutation) and the lengths of the common stretches between neighbours. From round
   ``length`` on, runs of neighbours that share the last ``length`` symbols are equal windows; their least document
   keeps them. The shuffled, packed buckets are the sequential external files.
3. The spans of a document meet by its id, are written as arrays to the shared folder and cut out; texts are never
   shuffled.

Nulls count as empty texts; a null doc_id counts as the greatest; rows that repeat a doc_id don't remove from each
other; texts below ``length`` bytes stay; an empty table gives no rows; all columns of the input are kept, of ``remove_repeats``
but those named like a result column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM = 50, 16
#: Bytes that a task works on at once; a longer text is worked on alone.
CHUNK = 1 << 20
LAST = (1 << 63) - 1

_table = common.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers = common.mix64(np.arange(901, 905, dtype=np.uint64)) | np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes that begin at each place."""
    h = _table[data]
    with np.errstate(over="ignore"):
        for k, p in enumerate(_powers):
            h = h[: -(1 << k)] * p + h[1 << k :]
    return common.mix64(h)


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over each ``width`` neighbours, by doubling."""
    out, w = x, 1
    while 2 * w <= width:
        out = op(out[:-w], out[w:])
        w *= 2
    return op(out[: len(out) - (width - w)], out[width - w :]) if width > w else out


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows inside documents; ``ends``: each byte's document's end."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width = length - GRAM + 1
    g = gram_hashes(data)
    least = sliding(g, width, np.minimum)
    n = len(least)
    least = np.where(ends[:n] - np.arange(n) >= length, least, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    most = sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    at = np.flatnonzero((most == g) & (most > 0))
    return at, g[at]


def chunks(batches: Iterator[pa.RecordBatch], length: int, copies: common.PairFiles, gone: list | None = None) -> Iterator[tuple]:
    """``(doc ids, text hashes, starts, data, owner, ends)`` of some documents' bytes, joined, without those of copies;
    ``gone`` takes these up as ``(doc id, text hash, bytes)``."""
    common.forget()
    for b in common.slices(batches, 5000):
        ids, hashes, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), common.bytes_of(b.column(2))
        copied = copies.find(np.array(ids, np.int64), np.array(hashes, np.int64)) >= 0
        for k in np.flatnonzero(copied).tolist():
            if gone is not None:
                gone.append((ids[k], hashes[k], len(texts[k])))
            texts[k] = b""
        held, size = [], 0
        for k, t in enumerate(texts):
            if len(t) >= length:
                held.append(k)
                size += len(t)
            if held and (size >= CHUNK or k == len(texts) - 1):  # the batch's last row, long or short, ends a chunk
                lengths = np.array([len(texts[i]) for i in held])
                starts = np.cumsum(lengths) - lengths
                owner = np.repeat(np.arange(len(held)), lengths)
                data = np.frombuffer(b"".join([texts[i] for i in held]), np.uint8)
                yield np.array([ids[i] for i in held], np.int64), np.array([hashes[i] for i in held], np.int64), starts, data, owner, (starts + lengths)[owner]
                held, size = [], 0


def anchor_hashes(length: int, copies: common.PairFiles):
    """For the first pass: each document's anchor hashes, once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for ids, _, _, data, owner, ends in chunks(batches, length, copies):
            at, g = anchors(data, ends, length)
            with np.errstate(over="ignore"):
                mixed = common.mix64(g + common.mix64(ids.astype(np.uint64))[owner[at]])
            yield g[np.unique(mixed, return_index=True)[1]]

    return run


def shared_windows(groups: np.ndarray, docs: np.ndarray, contexts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window (-1 if none) of each context that also occurs, at the same place of a context of the same
    group, in a smaller document.

    ``order`` lists the contexts by group and then by what precedes the current column, read backwards; ``since`` is the
    column from which a context agrees with the one before it in ``order``. Byte 255, never part of UTF-8, marks places
    beyond a document; windows with it don't count.
    """
    n, columns = contexts.shape
    order = np.argsort(groups, kind="stable")
    group = groups[order]
    new = np.concatenate([[True], group[1:] != group[:-1]])
    since = np.where(new, columns + 1, 0)
    number = np.zeros(n, np.int64)
    number[order] = np.cumsum(new)
    first, last = np.full(n, -1), np.full(n, -1)
    outside = np.full(n, -1)
    for k in range(columns):
        symbol = contexts[:, k]
        key = (number[order] << 8) | symbol[order]
        if (key[1:] < key[:-1]).any():
            to = np.argsort(key, kind="stable")
            key = key[to]
            a, b = to[:-1], to[1:]
            together = key[1:] == key[:-1]
            before = np.full(n, columns + 1)
            near = together & (b == a + 1)
            before[1:][near] = since[b[near]]
            far = np.flatnonzero(together & ~near)
            if len(far):
                pairs = np.empty(2 * len(far), np.int64)
                pairs[0::2], pairs[1::2] = a[far] + 1, b[far] + 1
                padded = np.append(since, 0)
                before[1:][far] = np.maximum.reduceat(padded, pairs)[0::2]
            order, since = order[to], before
        else:
            together = key[1:] == key[:-1]
            since[1:][~together] = columns + 1
        since[1:][~together] = k + 1
        since[0] = k + 1
        outside[symbol == 255] = k
        if (j := k - length + 1) >= 0:
            starts = np.flatnonzero(since > j)
            low = np.repeat(np.minimum.reduceat(docs[order], starts), np.diff(np.append(starts, n)))
            hit = order[(low < docs[order]) & (outside[order] < j)]
            last[hit] = j
            first[hit[first[hit] < 0]] = j
    return first, last


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint spans that don't touch."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    starts = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[starts, 0], reach[np.append(starts[1:], len(spans)) - 1]], axis=1)


def packed_spans(docs: np.ndarray, hashes: np.ndarray, spans: np.ndarray) -> Iterator[tuple]:
    """``(doc, hash, merged spans)`` of each document."""
    order = np.lexsort((hashes, docs))
    docs, hashes, spans = docs[order], hashes[order], spans[order]
    cut = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])])) if len(docs) else np.zeros(0, int)
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(docs)]):
        yield int(docs[i]), int(hashes[i]), merged(spans[i:j]).astype("<i8").tobytes()


def squeezed(*columns: np.ndarray) -> list[bytes]:
    return [zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(c).tobytes()) for c in columns]


def unsqueezed(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x) for x in column if x is not None), kind)


def equal_texts(rows: DataFrame) -> common.PairFiles:
    """The ``(doc, hash)`` of texts that equal a smaller document's: 64 and 32 bits of two hashes and the length agree."""
    ids = rows.select("doc", "hash", F.octet_length("text").alias("n"), F.crc32("text").alias("c"))
    firsts = ids.groupBy("hash", "n", "c").agg(F.min("doc").alias("first"), F.count("*").alias("k")).where("k > 1")
    return common.pair_files(ids.join(firsts, ["hash", "n", "c"]).where("doc > first").select(F.col("doc").alias("a"), F.col("hash").alias("b")))


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc, hash, spans)``: byte spans, packed pairs of 64-bit numbers, to be removed from ``rows(doc, hash, text)``.
    A document may come more than once."""
    spark = rows.sparkSession
    rows = rows.where(f"octet_length(text) >= {length}")
    copies = equal_texts(rows)
    repeated = common.repeated_hashes(rows, anchor_hashes(length, copies), spark)
    bits = repeated.bits
    left = length - GRAM
    width = left + length
    names = ["bucket", "doc", "hash", "spans", "keys", "docs", "hashes", "places", "contexts"]
    kinds = (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)

    def ready(doc: int, text: int, spans: bytes) -> tuple:
        return (doc ^ text) & ((1 << bits) - 1), doc, text, spans, None, None, None, None, None

    def flush(held: list[tuple]) -> pa.RecordBatch:
        key, doc, text, place, context = (np.concatenate(x) for x in zip(*held))
        with np.errstate(over="ignore"):
            h = key.copy()
            for k in range(0, width, 8):
                word = np.zeros((len(key), 8), np.uint8)
                word[:, : min(8, width - k)] = context[:, k : k + 8]
                h = common.mix64(h * np.uint64(0x9E3779B97F4A7C15) + word.view("<u8").ravel())
        order = np.lexsort((doc, h))
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        least = np.empty(len(doc), np.int64)
        least[order] = np.repeat(doc[order][new], np.diff(np.append(np.flatnonzero(new), len(doc))))
        later = np.flatnonzero(doc > least)  # a smaller document of this task has all of these windows
        inside = context[later] != 255
        a = place[later] - left + np.argmax(inside, axis=1)
        b = place[later] - left + width - np.argmax(inside[:, ::-1], axis=1)
        out = [ready(*x) for x in packed_spans(doc[later], text[later], np.stack([a, b], axis=1))]
        asked = np.flatnonzero(doc == least)
        asked = asked[np.lexsort((h[asked], key[asked]))]
        cut = np.searchsorted(key[asked], np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(48 - bits)).tolist()
        for bucket, (i, j) in enumerate(zip(cut[:-1], cut[1:])):
            if j > i:
                r = asked[i:j]
                out.append((bucket, 0, 0, None, *squeezed(key[r], doc[r], text[r], place[r], context[r])))
        return batch(out)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, gone = [], 0, []
        for ids, hashes, starts, data, owner, ends in chunks(batches, length, copies, gone):
            at, g = anchors(data, ends, length)
            at, g = at[hit := repeated.contains(g)], g[hit]
            if len(at):
                own = owner[at]
                index = at[:, None] + np.arange(-left, length)[None, :]
                good = (index >= starts[own][:, None]) & (index < ends[at][:, None])
                context = np.where(good, data[np.clip(index, 0, len(data) - 1)], np.uint8(255))
                held.append((g & np.uint64(0xFFFFFFFFFFFF), ids[own], hashes[own], at - starts[own], context))
                n += len(at)
            if n > 250_000:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)
        if gone:
            yield batch([ready(d, t, np.array([0, n], "<i8").tobytes()) for d, t, n in gone])

    def answer(key, group):
        out = list(group.loc[group["spans"].notna(), ["doc", "hash", "spans"]].itertuples(index=False, name=None))
        keys, docs_, hashes, places = (unsqueezed(group[c], t) for c, t in (("keys", np.uint64), ("docs", np.int64), ("hashes", np.int64), ("places", np.int64)))
        if len(keys):
            first, last = shared_windows(keys, docs_, unsqueezed(group["contexts"], np.uint8).reshape(-1, width), length)
            hit = np.flatnonzero(first >= 0)
            spans = np.stack([places[hit] - left + first[hit], places[hit] - left + last[hit] + length], axis=1)
            out += packed_spans(docs_[hit], hashes[hit], spans)
        return pd.DataFrame(out, columns=["doc", "hash", "spans"])

    schema = "bucket int, doc long, hash long, spans binary, keys binary, docs binary, hashes binary, places binary, contexts binary"
    return rows.select("doc", "hash", "text").mapInArrow(ask, schema).groupBy("bucket").applyInPandas(answer, "doc long, hash long, spans binary")


class SpanFiles(common.PairFiles):
    """Merged spans by ``(doc, hash)``, in arrays of the shared folder."""

    def spans_of(self, docs: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
        out = [np.zeros((0, 2), np.int64)] * len(docs)
        places = self.find(docs, hashes)
        buckets = (common.pair_hash(docs, hashes) >> np.uint64(64 - self.bits)).astype(np.int64)
        for i in np.flatnonzero(places >= 0).tolist():
            k = int(buckets[i])
            if ("spans", k) not in self._open:
                self._open["spans", k] = [np.load(f"{self.folder}/{x}-{k:06d}.npy", mmap_mode="r") for x in ("begins", "spans")]
            begins, spans = self._open["spans", k]
            out[i] = np.array(spans[begins[places[i]] : begins[places[i] + 1]])
        return out


def stored_spans(found: DataFrame) -> SpanFiles:
    """Write ``found(doc, hash, spans)`` into files by the hash of the document."""
    bits = common.buckets_for(found.sparkSession).bit_length() - 1
    files = SpanFiles(common.local_path(common.shared_dir(found.sparkSession)), bits)
    folder = files.folder

    def keyed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(part=(common.pair_hash(p["doc"].to_numpy(), p["hash"].to_numpy()) >> np.uint64(64 - bits)).astype(np.int32))

    def store(key, group):
        group = group.sort_values(["doc", "hash"])
        docs, hashes, raw = (group[c].to_numpy() for c in ("doc", "hash", "spans"))
        new = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])])).tolist()
        spans = [merged(np.frombuffer(b"".join(raw[i:j]), "<i8").reshape(-1, 2)) for i, j in zip(new, [*new[1:], len(raw)])]
        order = np.lexsort((hashes[new], docs[new], common.pair_hash(docs[new], hashes[new])))
        spans = [spans[i] for i in order.tolist()]
        common.write_array(folder, f"spans-{key[0]:06d}", np.concatenate(spans))
        common.write_array(folder, f"begins-{key[0]:06d}", np.cumsum([0, *map(len, spans)]))
        common.write_pairs(folder, int(key[0]), docs[new], hashes[new])
        return pd.DataFrame({"n": [len(new)]})

    found.mapInPandas(keyed, "doc long, hash long, spans binary, part int").groupBy("part").applyInPandas(store, "n long").agg(F.sum("n")).collect()
    return files


RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def with_cut(docs: DataFrame, results: list[str], length: int = LENGTH, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns and, under the names ``results`` that none of them has, the columns of ``RESULTS`` as far as asked."""
    names, (doc, text_hash) = docs.columns, common.fresh(docs, "_doc", "_hash")
    keyed = docs.withColumns({doc: F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), text_hash: F.coalesce(F.xxhash64(text_col), F.lit(0))})
    files = stored_spans(repeated_spans(keyed.select(F.col(doc).alias("doc"), F.col(text_hash).alias("hash"), F.col(text_col).alias("text")), length))
    text_at = names.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        for b in common.slices(batches, 1000):
            size, removed, count, digest, kept = [], [], [], [], []
            spans = files.spans_of(*(b.column(len(names) + k).to_numpy() for k in range(2)))
            for t, m in zip(common.bytes_of(b.column(text_at)), spans):
                parts, at = [], 0
                for i, j in m.tolist():
                    parts.append(t[at:i])
                    at = j
                rest = b"".join([*parts, t[at:]]) if len(m) else t
                size.append(len(t))
                removed.append(len(t) - len(rest))
                count.append(len(m))
                digest.append(hashlib.sha256(rest).hexdigest())
                if len(results) > 4:
                    kept.append(rest.decode("utf-8", "ignore"))
            more = [pa.array(x, t) for x, t in zip((size, removed, count, digest, kept), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(names))), *more[: len(results)]], names=[*names, *results])

    kinds = ("long", "long", "long", "string", "string")
    return keyed.mapInArrow(cut, ", ".join(f"`{c}` {t}" for c, t in [*docs.dtypes, *zip(results, kinds)]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """The input's columns with ``n_bytes, n_removed, n_spans, kept_sha256`` and, on demand, ``kept_text``: what is left, without
    the characters of which only a part is."""
    results = list(RESULTS if keep_text else RESULTS[:4])
    return with_cut(docs.drop(*results), results, length, id_col=id_col, text_col=text_col)


def without_repeats(docs: DataFrame, length: int = LENGTH, *, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The input with what is left as its texts; ``count_col``, if given, becomes their numbers of code points."""
    results = common.fresh(docs, *RESULTS)
    cut = with_cut(docs, results, length, id_col=id_col, text_col=text_col)
    new = {text_col: F.col(results[4])} | ({count_col: F.char_length(results[4])} if count_col else {})
    return cut.select(*[new.get(c, F.col(f"`{c}`")).cast(t).alias(c) for c, t in docs.dtypes])


def op9_column_wise_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return remove_repeats(docs, keep_text=False).select("doc_id", *RESULTS[:4])
