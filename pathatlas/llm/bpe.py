"""Byte-level BPE over length-bucketed, padded numpy matrices.

The distinct pieces of an Arrow batch that are not yet known to the worker become rows of matrices by length class. In
each round every row merges its leftmost pair of minimum rank; pairs are found in a hashed table of (left, right) -> merged
id, rows shift left over the freed cell and finished rows leave the matrix. Ranks are token ids, as in the rank file.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, table

NONE = np.int32(2**31 - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)
LONG = 256  # bytes of a piece from which disjoint equal pairs are merged in one round
BLOCK = 500_000  # characters whose new pieces are encoded together
MEMORY = 24 << 20  # bytes of pieces and ids that a worker remembers; the memory is emptied when it is full
KEPT = 32  # characters of the longest piece that is remembered
COST = 180  # bytes that an entry takes beside its characters and ids


class PairTable:
    """Open addressing from (left id, right id) to the id of the joined token."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(2 * len(left)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.vals = np.full(1 << bits, NONE, np.int32)
        key = left.astype(np.int64) << 32 | right
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            at = slot[todo]
            free = self.keys[at] == -1
            self.keys[at[free]] = key[todo[free]]  # of several rows for one slot the last stays
            done = self.keys[at] == key[todo]
            self.vals[at[done]] = merged[todo[done]]
            todo = todo[~done]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * MIX) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of each pair, NONE where the pair does not merge (negative ids are padding)."""
        shape = left.shape
        key = (left.astype(np.int64) << 32 | right).ravel()
        out = np.full(len(key), NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(key[todo])
        while len(todo):
            have = self.keys[slot]
            hit = have == key[todo]
            out[todo[hit]] = self.vals[slot[hit]]
            on = ~hit & (have != -1)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out.reshape(shape)


class Bpe:
    """Encoder and decoder for one rank file (base64 token, blank, id per line)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.pattern = regex.compile(pattern)
        tokens = [b""] * (max(ranks.values()) + 1)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            tokens[rank] = token
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.ranks = ranks
        self.bytes_to_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.table = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int32))
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.known: dict[str, bytes] = {}  # piece -> its ids as little-endian unsigned 32-bit integers
        self.held = 0  # bytes that ``known`` takes

    def _matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of one length class; one merge per row and round."""
        sizes = np.array([len(p) for p in pieces])
        width = int(sizes.max())
        cells = np.full((len(pieces), width), -1, np.int32)
        cells[np.arange(width) < sizes[:, None]] = self.bytes_to_id[np.frombuffer(b"".join(pieces), np.uint8)]
        best = self.table.find(cells[:, :-1], cells[:, 1:])
        out: list[np.ndarray] = [None] * len(pieces)
        rows = np.arange(len(pieces))
        while True:
            at = best.argmin(axis=1) if best.shape[1] else np.zeros(len(rows), np.int64)
            low = best[np.arange(len(rows)), at] if best.shape[1] else np.full(len(rows), NONE)
            over = low == NONE
            for i in np.flatnonzero(over):
                out[rows[i]] = cells[i, : sizes[i]].copy()
            if over.all():
                return out
            go = ~over
            rows, cells, best, at, low, sizes = rows[go], cells[go], best[go], at[go], low[go], sizes[go]
            n, width = cells.shape
            cells[np.arange(n), at] = low
            cells = cells[np.arange(width) != (at + 1)[:, None]].reshape(n, width - 1)
            best = best[np.arange(width - 1) != at[:, None]].reshape(n, width - 2)
            sizes -= 1
            cells = cells[:, : max(1, int(sizes.max()))]
            best = best[:, : cells.shape[1] - 1]
            for side in (at - 1, at):  # the pairs on both sides of the merged cell are new
                ok = np.flatnonzero((side >= 0) & (side < best.shape[1]))
                best[ok, side[ok]] = self.table.find(cells[ok, side[ok]], cells[ok, side[ok] + 1])

    def _long(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece. Equal minimum pairs merge together as long as that changes nothing: when a merge
        would open a pair of lower or equal rank, only the leftmost pair merges in that round."""
        cells = self.bytes_to_id[np.frombuffer(piece, np.uint8)]
        while len(cells) > 1:
            best = self.table.find(cells[:-1], cells[1:])
            low = best.min()
            if low == NONE:
                break
            at = np.flatnonzero(best == low)
            step = np.diff(at, prepend=at[0] - 2) == 1  # overlapping pairs of a run: every second one merges
            if step.any():
                start = np.flatnonzero(~step)
                at = at[(np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))) % 2 == 0]
            new = cells.copy()
            new[at] = low
            new = np.delete(new, at + 1)
            where = at - np.arange(len(at))
            left, right = where[where > 0], at[at + 2 < len(cells)]
            opened = np.concatenate([self.table.find(new[left - 1], new[left]), self.table.find(np.full(len(right), low), cells[right + 2]),
                                     self.table.find(new[where[where + 1 < len(new)]], new[where[where + 1 < len(new)] + 1])])
            if len(at) > 1 and (opened <= low).any():
                new = cells.copy()
                new[at[0]] = low
                new = np.delete(new, at[0] + 1)
            cells = new
        return cells

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of the pieces; short ones are remembered."""
        out, classes = {}, {}
        for p in pieces:
            ids = self.known.get(p)
            if ids is not None:
                out[p] = ids
                continue
            raw = p.encode("utf-8")
            whole = self.ranks.get(raw)
            if whole is not None:
                out[p] = whole.to_bytes(4, "little")
            elif len(raw) >= LONG:
                out[p] = self._long(raw).astype("<u4").tobytes()
            else:
                classes.setdefault(len(raw).bit_length(), []).append((p, raw))
        for rows in classes.values():
            for at in range(0, len(rows), 4096):
                part = rows[at:at + 4096]
                for (p, _), ids in zip(part, self._matrix([raw for _, raw in part]), strict=True):
                    out[p] = ids.astype("<u4").tobytes()
        for p, ids in out.items():
            if len(p) <= KEPT and p not in self.known:
                self.held += COST + len(p) + len(ids)
                if self.held > MEMORY:
                    self.known, self.held = {}, COST + len(p) + len(ids)
                self.known[p] = ids
        return out

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, in order. The new pieces of about BLOCK characters are encoded together, also within a long text."""
        split: list[list[str]] = [[]]  # pieces of the texts that are held; the last one is open
        done: list[np.ndarray] = []  # ids of the open text's earlier blocks
        size = 0
        for text in texts:
            for pieces in self._split(text or ""):
                split[-1] += pieces
                size += sum(map(len, pieces))
                if size >= BLOCK:
                    *whole, part = self._block(split)
                    for ids in whole:
                        yield np.concatenate([*done, ids])
                        done = []
                    done.append(part)
                    split, size = [[]], 0
            split.append([])
        for ids in self._block(split)[:-1]:
            yield np.concatenate([*done, ids])
            done = []

    def _split(self, text: str) -> Iterator[list[str]]:
        if len(text) < BLOCK:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(found, BLOCK // 8)):
            yield part

    def _block(self, split: list[list[str]]) -> list[np.ndarray]:
        ids = self.learn(set().union(*split))
        return [np.frombuffer(b"".join(map(ids.__getitem__, pieces)), "<u4") for pieces in split]

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids: one gather from the joined token bytes."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes)):
            raise ValueError("unknown token id")
        n = self.sizes[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(ids) else 0)].tobytes()


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Bpe:
    """One coder for each worker process and rank file."""
    return Bpe(path, pattern)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_column(path: str, pattern: str):
    """Column function text -> array of ids; a null or empty text has no ids."""
    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        bpe = coder(path, pattern)
        return pd.Series([ids.astype(np.int32) for ids in bpe.encode_all(texts)], dtype=object)
    return run


def decode_column(path: str, pattern: str):
    """Column function array of ids -> bytes; null reads as no ids. An id outside the vocabulary is an error."""
    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        bpe = coder(path, pattern)
        return pd.Series([bpe.decode(np.zeros(0, np.int64) if r is None else r) for r in rows], dtype=object)
    return run


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row: encoded, then decoded from the ids.

    A null text counts as empty (no ids). Repeated rows and null ids keep a row each; other columns are not read; an empty
    table gives an empty result. Texts of any length are encoded whole.
    """
    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: pd.Series) -> pd.DataFrame:
        bpe = coder(path, pattern)
        rows = []
        for ids in bpe.encode_all(texts):
            rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select(F.col(id_col).alias("id"), run(F.col(text_col)).alias("_d")).select("id", "_d.*")


@query("op5_byte_bpe")
def op5(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), *vocabulary()).withColumnRenamed("id", "doc_id")
