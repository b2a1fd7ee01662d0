"""Exact token counts at every prefix of a text, by dynamic programming over prefixes (operator 7).

A byte-pair model whose pieces hold the word mark only at their start never merges across a mark that follows another
character. So the count of a prefix is the count of the chunks before it plus the count of the begun chunk, and the
prefix counts of a chunk are worked out once and kept. The table of a text answers any truncation or budget question
without encoding again.

A chunk is worked out in time and memory linear in its length; should the library's count of the whole chunk not be met, its
prefixes are encoded one by one, in bounded calls.

Nulls count as empty texts (0 tokens); repeated rows give repeated results; an empty table gives no rows. Other columns
of the input are left out, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from . import common

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Longest chunk, in code points, whose prefix counts fit bytes (up to four byte tokens a code point).
SHORT = 60
#: Chunks, and pairs of pieces, kept by a worker; beyond this a store is begun anew.
KEPT = 600_000


class PrefixCounter:
    """Prefix token counts under a sentencepiece byte-pair model."""

    def __init__(self, model_file: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("the model has pieces that go beyond a word")
        self.pieces = set(pieces)
        self.longest = max(map(len, pieces))
        self.counts: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.slow = 0  # chunks whose prefixes were encoded one by one

    def _encoded(self, chunks: list[str]) -> list[int]:
        """Token counts of chunks that begin with the mark, which the library adds to what it is given."""
        out = self.model.encode([c[1:].replace(MARK, " ") for c in chunks], num_threads=1)
        return [len(x) if len(c) > 1 else 1 for c, x in zip(chunks, out)]

    def learn(self, parts: set[str]) -> None:
        """Work out the prefix counts of the marked, short chunks ``mark + part``; in order, so that what a part begins with is
        taken from the part before it."""
        new = [p for p in parts if p not in self.counts]
        if len(self.counts) + len(new) > KEPT:
            self.counts = {}
            new = list(parts)
        new.sort()
        for at in range(0, len(new), 5000):
            block, last, same = new[at : at + 5000], "", []
            for p in block:
                n = 0
                for a, b in zip(last, p):
                    if a != b:
                        break
                    n += 1
                same.append(n)
                last = p
            n = list(map(len, self.model.encode([p[:i] for p, k in zip(block, same) for i in range(k + 1, len(p) + 1)], num_threads=1)))
            k, last = 0, b"\x01"  # the mark alone is a token
            for p, begin in zip(block, same):
                end = k + len(p) - begin
                self.counts[p] = last = last[: begin + 1] + bytes(n[k:end])
                k = end

    def _stable(self, left: str, right: str) -> bool:
        """Whether the tokens left and right stay as they are where they meet; nothing merges across an empty left."""
        if (left, right) not in self.pairs:
            if len(self.pairs) > KEPT:
                self.pairs = {}
            text = (left + right).replace(MARK, " ")
            lead = "" if left.startswith(MARK) else "\n"  # a piece of its own, so that the library's mark stands apart
            got = self.model.encode(lead + (text[1:] if left.startswith(MARK) else text), out_type=str)
            got = got[got.index("<0x0A>") + 1 :] if lead else got
            self.pairs[left, right] = got == ([left, right] if left else [right])
        return self.pairs[left, right]

    def long_chunk(self, chunk: str) -> np.ndarray:
        """Counts of the prefixes 1..len of a marked chunk of any length: the last token of each prefix follows from
        the last token of an earlier prefix with which it is stable. A character outside the vocabulary becomes bytes,
        which merge with nothing: what follows it begins anew. Checked against the library's whole count."""
        n, last, count = len(chunk), [""], np.zeros(len(chunk) + 1, np.int64)
        for i in range(1, n + 1):
            found = ""
            for k in range(1, min(i, self.longest) + 1):
                t = chunk[i - k : i]
                if t in self.pieces and (i == k or last[i - k] is not None and self._stable(last[i - k], t)):
                    found = t
            if found:
                count[i] = count[i - len(found)] + 1
                last.append(found)
            elif chunk[i - 1] in self.pieces:
                last.append(None)  # no prefix of this length ends in a token of its own; the check below decides
            else:
                count[i] = count[i - 1] + len(chunk[i - 1].encode())
                last.append("")
        if None not in last and count[n] == self._encoded([chunk])[0]:
            return count[1:]
        self.slow += 1
        step = max(1, (1 << 21) // n)  # prefixes in a call: memory stays bounded
        return np.array([x for a in range(1, n + 1, step) for x in self._encoded([chunk[:i] for i in range(a, min(a + step, n + 1))])], np.int64)

    def table(self, text: str) -> np.ndarray:
        """``t[p]``: the exact token count of ``text[:p]``, for p from 0 to len(text)."""
        if not text:
            return np.zeros(1, np.int64)
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts and max(map(len, parts)) <= SHORT:
            try:
                inner = [self.counts[p] for p in parts]
            except KeyError:
                self.learn(set(parts))
                inner = [self.counts[p] for p in parts]
            lengths = np.fromiter(map(len, inner), np.int64, len(parts))
            inner = np.frombuffer(b"".join(inner), np.uint8)
        else:
            chunks, lead = [], MARK
            for k, p in enumerate(parts):
                if p:
                    chunks.append(lead + p)
                    lead = MARK
                elif k < len(parts) - 1:
                    lead += MARK
                else:
                    chunks.append(lead)
            short = {c[1:] for c in chunks if len(c) <= SHORT and not c.startswith(MARK * 2)}
            self.learn(short)
            rows = [np.frombuffer(self.counts[c[1:]], np.uint8).astype(np.int64) if c[1:] in short else self.long_chunk(c) for c in chunks]
            lengths = np.fromiter(map(len, rows), np.int64, len(rows))
            inner = np.concatenate(rows)
        before = np.cumsum(inner[np.cumsum(lengths) - 1], dtype=np.int64)
        out = np.repeat(before - inner[np.cumsum(lengths) - 1], lengths) + inner
        out[0] = 0
        return out

    def warm(self, texts: list[str]) -> None:
        """Learn the chunks of many texts at once, which saves calls."""
        known = self.counts
        self.learn({p for t in texts for p in t.split(" ") if p not in known and p and len(p) <= SHORT and MARK not in p})


def counter(model: str) -> PrefixCounter:
    """This process's counter for a model file."""
    return common.stored(("prefixes", model), lambda: PrefixCounter(model))


def prefix_counts(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, prefix_tokens array<int>)``: the whole table of each text, its length in code points plus one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for b in common.slices(batches, 200):
            rows = [c.table(t).astype(np.int32) for t in common.texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "prefix_tokens"])

    return docs.selectExpr(f"cast({id_col} as long) doc_id", f"{text_col} text").mapInArrow(run, "doc_id long, prefix_tokens array<int>")


def token_counts(docs: DataFrame, model: str, limit: int = 4096, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``n_bytes``, ``n_tokens``, ``over_limit`` and ``fit_chars``, the longest prefix (code points) of
    at most ``limit`` tokens, all read off the prefix table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for b in common.slices(batches, 500):
            texts = common.texts_of(b.column(1))
            c.warm(texts)
            n, fit = [], []
            for t in texts:
                table = c.table(t)
                n.append(int(table[-1]))
                fit.append(len(t) if n[-1] <= limit else int(np.flatnonzero(table <= limit)[-1]))
            sizes = [len(x) for x in common.bytes_of(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(fit, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    return docs.selectExpr(f"cast({id_col} as long) doc_id", f"{text_col} text").mapInArrow(run, schema)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.documents(spark, sf_dir), public_tokenizers.path(MODEL))
