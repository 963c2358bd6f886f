"""Masked pseudo-likelihood of documents under a small bidirectional network.

Words are hashed to 2^18 buckets, counted over the whole corpus. The most frequent buckets are word classes of their own, the
others share classes by hash. A network reads the two words on both sides of each position (a vector of the class plus one of the
bucket) and predicts the class in between by a softmax, then the bucket inside its class by the decisions of a Huffman tree, each a
logistic unit of the same hidden values. So every bucket is told apart on both sides; untrained trees give the corpus shares.
A bounded number of distinct texts gives start values of the class network, then every task fits all weights to all of its
documents, and the tasks' weights are averaged by their numbers of words, those of a bucket or a decision by its numbers of uses.
A document's score sums the log-probability of each of its words given both sides.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOTS, per_text, query, saved, table, word_hashes

BUCKETS = 1 << 18
OWN, SHARED = 32, 32
CLASSES = OWN + SHARED
SIDE, EMBED, HIDDEN = 2, 8, 16
BATCH = 2048
WARM_DOCS, WARM_EPOCHS = 400, 3
SEEN = 7  # hidden values that the decisions inside a class read
STEP = 0.2  # longest step of a bucket's or a decision's weights
PIECE_ROWS = 1024  # buckets whose weights are averaged in one place
OFFSETS = [o for o in range(-SIDE, SIDE + 1) if o]


def buckets_of(text: str | None) -> np.ndarray:
    return word_hashes(text) & np.uint32(BUCKETS - 1)


@dataclass
class Lexicon:
    """Class of each bucket and log-probability of the bucket inside its class (add-one smoothed over all buckets).

    ``up`` has the decision that leads to each bucket and, from BUCKETS on, to each decision: twice its number, plus the side; -1 at the
    top of a class. ``odds`` are the log-odds of side 1 by the counts.
    """
    classes: np.ndarray
    inside: np.ndarray
    up: np.ndarray | None = None
    odds: np.ndarray | None = None


def trees(n: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``up`` and ``odds`` of a Huffman tree over the buckets of each class, whose counts are ``n``."""
    up, odds, made = np.full(2 * BUCKETS, -1, np.int32), np.zeros(BUCKETS, np.float32), 0
    for c in range(CLASSES):
        held = np.flatnonzero(classes == c)
        heap = list(zip(n[held].tolist(), held.tolist()))
        heapq.heapify(heap)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            up[i], up[j], odds[made] = 2 * made, 2 * made + 1, np.log(b / a)
            heapq.heapreplace(heap, (a + b, BUCKETS + made))
            made += 1
    return up, odds


def paths(up: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, decision, side) of all decisions that lead to the buckets ``words``."""
    place, at = np.arange(len(words)), up[words]
    out = []
    while len(place):
        inner = at >= 0
        place, at = place[inner], at[inner]
        out.append((place, at))
        at = up[BUCKETS + (at >> 1)]
    place, at = (np.concatenate([o[i] for o in out] or [np.zeros(0, np.int64)]) for i in (0, 1))
    return place, at >> 1, (at & 1).astype(bool)


def depths(up: np.ndarray) -> np.ndarray:
    """How many decisions lead to each bucket."""
    n, at, place = np.zeros(BUCKETS, np.uint8), up[:BUCKETS], np.arange(BUCKETS)
    while len(place):
        place, at = place[at >= 0], at[at >= 0]
        n[place] += 1
        at = up[BUCKETS + (at >> 1)]
    return n


def lexicon(words: DataFrame) -> Lexicon:
    """From all words of the corpus: partial counts per task, summed by bucket in Spark; at most 2^18 sums are returned."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for pdf in batches:
            held = np.frombuffer(b"".join(pdf["words"]), np.uint32)
            for at in range(0, len(held), 1 << 22):
                total += np.bincount(held[at:at + (1 << 22)], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some.astype(np.int32), "n": total[some]})

    got = words.mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(BUCKETS, np.int64)
    n[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    classes = (OWN + (np.arange(BUCKETS, dtype=np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(16)) % SHARED).astype(np.uint8)
    top = np.argsort(-n, kind="stable")[:OWN]
    classes[top[n[top] > 0]] = np.flatnonzero(n[top] > 0)
    mass = np.bincount(classes, n + 1, CLASSES)
    return Lexicon(classes, (np.log(n + 1) - np.log(mass[classes])).astype(np.float32), *trees(n + 1, classes))


class Words:
    """Weights of every decision inside the classes (the last one its bias) and the vector of every bucket in a context."""

    WIDTHS = (SEEN + 1, EMBED)

    def __init__(self, lex: Lexicon):
        self.up, self.depth = lex.up, depths(lex.up)
        # the last column sums the squares of the row's steps so far; row BUCKETS is the outside and has no weights
        self.tables = [np.zeros((BUCKETS + 1, width + 1), np.float32) for width in self.WIDTHS]
        self.tables[0][:BUCKETS, SEEN] = lex.odds
        # equal vectors would never part, as decisions without weights hand nothing back
        self.tables[1][:BUCKETS, :-1] = np.random.default_rng(11).standard_normal((BUCKETS, EMBED), np.float32) * np.float32(0.3)
        for t in self.tables:
            t[:, -1] = 1

    def start(self) -> None:
        """Space for learning."""
        self.slot = np.zeros(BUCKETS + 1, np.int64)

    def around(self, near: np.ndarray) -> np.ndarray:
        """The vectors of the buckets in some contexts."""
        return self.tables[1].take(near, axis=0)[..., :-1]

    def decisions(self, h: np.ndarray, words: np.ndarray) -> tuple:
        """Of the decisions that lead to some buckets, level by level: their numbers, the sign of the side taken, their weights, the
        hidden values they read and their log-odds of that side; the order of the buckets, deep ones first, and where levels begin and end.

        So the decisions of a level belong to the first buckets in that order.
        """
        order = np.argsort(self.depth.take(words), kind="stable")[::-1]
        read = np.ones((len(h), SEEN + 1), np.float32)
        read[:, :SEEN] = h.take(order, axis=0)[:, :SEEN]
        levels, at = [], self.up.take(words.take(order))
        while n := np.count_nonzero(at >= 0):
            levels.append(at[:n])
            at = self.up.take(BUCKETS + (at[:n] >> 1))
        at = np.concatenate([np.zeros(0, np.int32), *levels])
        node, sign = at >> 1, np.float32(2) * (at & 1).astype(np.float32) - np.float32(1)
        v = self.tables[0].take(node, axis=0)
        seen = np.concatenate([read[:0], *[read[:len(x)] for x in levels]])
        ends = np.cumsum([0, *map(len, levels)]).tolist()
        return node, sign, v, seen, np.einsum("ij,ij->i", v[:, :-1], seen) * sign, order, list(zip(ends, ends[1:]))

    def logs(self, h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each bucket inside its class, and how many decisions it sums."""
        *_, s, order, levels = self.decisions(h, words)
        each = np.minimum(s, 0) - np.log1p(np.exp(-np.abs(s)))
        total, out = np.zeros(len(words)), np.empty(len(words))
        for a, b in levels:
            total[:b - a] += each[a:b]
        out[order] = total
        return out, self.depth.take(words)

    def learn(self, h: np.ndarray, words: np.ndarray) -> np.ndarray:
        """One step of the decisions that lead to some buckets; returns the gradient of the loss by the hidden values."""
        node, sign, v, seen, s, order, levels = self.decisions(h, words)
        g = -sign / (1 + np.exp(np.minimum(s, 80)))
        flow = v[:, :SEEN] * g[:, None]
        total, back = np.zeros((len(h), SEEN), np.float32), np.zeros(h.shape, np.float32)
        for a, b in levels:
            total[:b - a] += flow[a:b]
        back[order, :SEEN] = total
        self.move(0, node, np.multiply(seen.T, g, dtype=np.float64, order="C"))
        return back

    def move(self, which: int, at: np.ndarray, columns: np.ndarray) -> None:
        """A step of the rows ``at`` of a table against the sums of their gradients, shorter for rows that have moved much."""
        each = np.arange(len(at))
        self.slot[at] = each
        rows = at[self.slot.take(at) == each]  # every row once
        self.slot[rows] = each[:len(rows)]
        at = self.slot.take(at)
        sums = np.empty((len(rows), len(columns)), np.float32)
        for d, c in enumerate(columns):
            sums[:, d] = np.bincount(at, c, len(rows))
        sums[rows == BUCKETS] = 0
        held = self.tables[which].take(rows, axis=0)
        held[:, -1] += np.einsum("ij,ij->i", sums, sums)
        sums *= (STEP / np.sqrt(held[:, -1]))[:, None]
        held[:, :-1] -= sums
        self.tables[which][rows] = held

    def uses(self, n: np.ndarray) -> np.ndarray:
        """How often each decision and each bucket was used if the buckets occurred ``n`` times."""
        some = np.flatnonzero(n)
        place, node, _ = paths(self.up, some)
        return np.stack([np.bincount(node, n[some][place], BUCKETS), n.astype(np.float64)], axis=1)


PARTS = "lot int, piece int, at binary, uses binary, v binary"


def parts_of(net: Net, n: np.ndarray) -> Iterator[pd.DataFrame]:
    """A task's weights as rows that ``averaged`` takes: piece -1 is the class network, the others are PIECE_ROWS buckets each.
    ``n`` counts its words by bucket."""
    task = TaskContext.get()
    lot = task.partitionId() // 32 % LOTS if task else 0
    rows = [(lot, -1, np.int32([0]).tobytes(), np.float64([n.sum()]).tobytes(), net.flat().astype(np.float32).tobytes())]
    uses = net.words.uses(n)
    for first in range(0, BUCKETS, PIECE_ROWS):
        at = np.flatnonzero(uses[first:first + PIECE_ROWS].any(axis=1))
        if len(at):
            v = np.concatenate([t[first + at, :-1] for t in net.words.tables], axis=1)
            rows.append((lot, first // PIECE_ROWS, at.astype(np.int32).tobytes(), uses[first + at].tobytes(), v.tobytes()))
        if len(rows) >= 32:
            yield pd.DataFrame(rows, columns=["lot", "piece", "at", "uses", "v"])
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=["lot", "piece", "at", "uses", "v"])


def averaged(df: DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(piece, rows, uses, mean weights by uses) over all tasks: first over the tasks of a lot, then over the at most LOTS lots."""
    def read(at, uses, v):
        at = np.frombuffer(at, np.int32)
        return at, np.frombuffer(uses, np.float64).reshape(len(at), -1), np.frombuffer(v, np.float32).reshape(len(at), -1)

    def mean(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = used = None
        for pdf in parts:
            for at, uses, v in map(read, pdf["at"], pdf["uses"], pdf["v"]):
                widths = Words.WIDTHS if uses.shape[1] == 2 else v.shape[1:]
                if total is None:
                    size = PIECE_ROWS if uses.shape[1] == 2 else 1
                    total, used = np.zeros((size, v.shape[1])), np.zeros((size, uses.shape[1]))
                total[at] += v * np.repeat(uses, widths, axis=1)
                used[at] += uses
        at = np.flatnonzero(used.any(axis=1))
        v = total[at] / np.repeat(np.maximum(used[at], 1), widths, axis=1)
        yield pd.DataFrame({"lot": np.int32(0), "piece": [key[-1]], "at": [at.astype(np.int32).tobytes()], "uses": [used[at].tobytes()],
                            "v": [v.astype(np.float32).tobytes()]})

    got = df.groupBy("lot", "piece").applyInPandas(mean, PARTS).groupBy("piece").applyInPandas(mean, PARTS).toPandas()
    for piece, *raw in zip(got["piece"], got["at"], got["uses"], got["v"]):
        yield piece, *read(*raw)


class Net:
    """embed -> concatenated context -> tanh -> softmax over classes; class CLASSES stands for the outside of a document."""

    SHAPES = [(CLASSES + 1, EMBED), (len(OFFSETS) * EMBED, HIDDEN), (1, HIDDEN), (HIDDEN, CLASSES), (1, CLASSES)]

    def __init__(self, flat: np.ndarray | None = None, seed: int = 11):
        self.words: Words | None = None  # none: classes only
        if flat is None:
            rng = np.random.default_rng(seed)
            self.parts = [(rng.standard_normal(s) / max(1, s[0]) ** 0.5 if i in (1, 3) else rng.standard_normal(s) if i == 0 else np.zeros(s)).astype(np.float32)
                          for i, s in enumerate(self.SHAPES)]
        else:
            cuts = np.cumsum([a * b for a, b in self.SHAPES])
            self.parts = [p.reshape(s).astype(np.float32) for p, s in zip(np.split(np.asarray(flat), cuts[:-1]), self.SHAPES, strict=True)]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts]).astype(np.float64)

    def hidden(self, context: np.ndarray, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, hidden values and logits (0 at most) of all classes for rows of context classes (and context buckets)."""
        e, w, b, u, c = self.parts
        x = e.take(context, axis=0)
        if near is not None:
            x += self.words.around(near)
        x = x.reshape(len(context), -1)
        h = np.tanh(x @ w + b)
        z = h @ u + c
        top = z.max(initial=0)
        z -= top if top - z.min(initial=0) < 60 else z.max(axis=1, keepdims=True)
        return x, h, z

    def forward(self, context: np.ndarray, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, hidden values and log-probabilities of all classes."""
        x, h, z = self.hidden(context, near)
        z -= np.log(np.exp(z) @ np.ones((CLASSES, 1), np.float32))
        return x, h, z

    def step(self, context: np.ndarray, target: np.ndarray, rate: float, embed: bool = True,
             near: np.ndarray | None = None, word: np.ndarray | None = None) -> None:
        """One gradient step on a batch, of the embedding too if ``embed``, and of the weights of ``words`` if there are buckets."""
        e, w, b, u, c = self.parts
        x, h, z = self.hidden(context, near)
        g = np.exp(z, out=z)
        g /= g @ np.ones((CLASSES, 1), np.float32)
        g[np.arange(len(target)), target] -= 1
        g *= rate / len(target)
        gh = g @ u.T
        if near is not None:
            gh += self.words.learn(h, word) * np.float32(rate / len(target))
        gh *= 1 - h * h
        if embed:
            flow = (gh @ w.T).reshape(-1, EMBED).T.astype(np.float64, order="C")
            at = context.ravel().astype(np.int64)
            for d in range(EMBED):
                e[:, d] -= np.bincount(at, flow[d], CLASSES + 1).astype(np.float32)
            if near is not None:
                flow *= len(target) / rate
                self.words.move(1, near.ravel(), flow)
        u -= h.T @ g
        c -= g.sum(axis=0)
        w -= x.T @ gh
        b -= gh.sum(axis=0)


def contexts(docs: list[np.ndarray], outside: int = CLASSES, kind: type = np.uint8) -> tuple[np.ndarray, np.ndarray]:
    """(context classes, class) of every word of some documents given as class arrays; likewise of buckets with another ``outside``."""
    sizes = np.array([len(d) for d in docs], np.int64)
    if not sizes.sum():
        return np.zeros((0, len(OFFSETS)), kind), np.zeros(0, kind)
    padded = np.full(int(sizes.sum()) + SIDE * (len(docs) + 1), outside, kind)
    at = np.arange(int(sizes.sum())) + np.repeat(SIDE * (np.arange(len(docs)) + 1), sizes)
    padded[at] = np.concatenate(docs)
    return np.stack([padded[at + o] for o in OFFSETS], axis=1), padded[at]


def _grouped(batches: Iterator[pd.DataFrame], size: int = 50_000) -> Iterator[list[np.ndarray]]:
    """Lists of bucket arrays with about ``size`` words."""
    held, n = [], 0
    for pdf in batches:
        for raw in pdf["words"]:
            held.append(np.frombuffer(raw, np.uint32))
            n += len(held[-1])
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held


def start_texts(words: DataFrame) -> DataFrame:
    """At most WARM_DOCS distinct texts with words, chosen by hash; only hashes of the others are dealt out."""
    at = words.where(F.length("words") > 0).select(F.xxhash64("words").alias("at")).distinct().orderBy("at").limit(WARM_DOCS)
    return words.join(F.broadcast(at), F.xxhash64("words") == F.col("at"), "left_semi").dropDuplicates(["words"]).orderBy(F.xxhash64("words"), "words")


def train(words: DataFrame, lex: Lexicon, rate: float = 5.0) -> Net:
    """Weights fitted to every document: start values of the class network from at most WARM_DOCS distinct texts (chosen by hash, in one
    task), then one pass of each task over its documents and the average of the tasks. Without words the start values remain."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(lex)  # fixed size

    def learn(net: Net, batches: Iterator[pd.DataFrame], rate: float, epochs: int = 1) -> np.ndarray:
        rng, n = np.random.default_rng(5), np.zeros(BUCKETS, np.int64)
        classes = np.append(shared.value.classes, np.uint8(CLASSES))
        for docs in _grouped(batches):
            near, word = contexts(docs, BUCKETS, np.int32)
            context, target = classes[near], classes[word]
            n += np.bincount(word, minlength=BUCKETS)
            for _ in range(epochs):
                order = rng.permutation(len(target))
                for at in range(0, len(order), BATCH):
                    some = order[at:at + BATCH]
                    inner = (near[some], word[some]) if net.words else ()
                    net.step(context[some], target[some], rate, True, *inner)
        return n

    def warm(batches):
        net = Net()
        learn(net, batches, rate, WARM_EPOCHS)
        yield pd.DataFrame({"v": [net.flat().tobytes()]})

    first = [r["v"] for r in start_texts(words).coalesce(1).mapInPandas(warm, "v binary").collect()]
    start = np.frombuffer(first[0]) if first else Net().flat()

    def every(batches):
        net = Net(start)
        net.words = Words(shared.value)
        net.words.start()
        n = learn(net, batches, rate / 5)
        if n.any():
            yield from parts_of(net, n)

    inner = Words(lex)
    for piece, at, uses, v in averaged(words.mapInPandas(every, PARTS)):
        if piece < 0:
            start = v[0]
            continue
        for i, (mine, some) in enumerate(zip(inner.tables, np.split(v, [Words.WIDTHS[0]], axis=1))):
            used = uses[:, i] > 0
            mine[piece * PIECE_ROWS + at[used], :-1] = some[used]
    net = Net(start)
    net.words = inner
    return net


def log_probs(net: Net, lex: Lexicon, docs: list[np.ndarray]) -> list[float]:
    """Summed log-probabilities of documents given as bucket arrays."""
    near, words = contexts(docs, BUCKETS, np.int32)
    classes = np.append(lex.classes, np.uint8(CLASSES))
    if net.words:  # words of equal depth together
        order = np.argsort(net.words.depth.take(words), kind="stable")
        near, words = near[order], words[order]
    each = lex.inside[words].astype(np.float64)
    for at in range(0, len(words), BATCH):
        some, word = near[at:at + BATCH], words[at:at + BATCH]
        _, h, z = net.hidden(classes[some], some if net.words else None)
        if net.words:
            each[at:at + BATCH] = net.words.logs(h, word)[0]
        each[at:at + BATCH] += z[np.arange(len(z)), classes[word]]
        each[at:at + BATCH] -= np.log(np.exp(z, out=z) @ np.ones(CLASSES, np.float32))
    if net.words:
        each[order] = each.copy()
    sums = np.append(0, np.cumsum(each))
    ends = np.cumsum([len(d) for d in docs])
    return (sums[ends] - sums[ends - np.array([len(d) for d in docs])]).tolist()


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob, pseudo_perplexity) per row, under a network trained on ``docs``.

    A text without words (null, empty) has log_prob 0 and null for the two means. Repeated rows and null ids keep a row each
    and repeated texts count as often as they occur; an empty table gives an empty result; other columns are not read.
    """
    words = saved(docs.select(F.col(id_col).alias("doc_id"), per_text(lambda t: buckets_of(t).tobytes(), "binary")(F.col(text_col)).alias("words")))
    lex = lexicon(words.select("words"))
    net = train(words.select("words"), lex)
    shared = docs.sparkSession.sparkContext.broadcast((net, lex))  # fixed size

    def apply(batches):
        for pdf in batches:
            logs: list[float] = []
            for group in _grouped(iter([pdf])):
                logs += log_probs(*shared.value, group)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_words": [len(w) // 4 for w in pdf["words"]], "log_prob": logs})

    out = words.mapInPandas(apply, "doc_id long, n_words long, log_prob double")
    mean = F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words"))
    return out.select("*", mean.alias("mean_log_prob"), F.exp(-mean).alias("pseudo_perplexity"))


@query("op8_lm_scoring")
def op8(spark, sf_dir):
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
