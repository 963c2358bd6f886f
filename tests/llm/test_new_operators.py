"""Importance resampling, the conversation trie and the similarity join: brute force and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pathatlas.llm import licenses, prefix_join, resample, trie
from pathatlas.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (2, ""), (None, "word"), (None, "word"), (3, "x" * 30_000), (4, "Tie one two"), (5, "tie ONE two"), (6, "\n\n \n"), (7, "é 日本 🎉")]


@pytest.fixture
def odd(spark):
    rows = [(i, t, "x", 7, 7, 7, "y") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n long, rank long, node long, key string")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- 11: importance resampling ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("depth", [64, 3])
def test_crc_of_spans_equals_zlib(monkeypatch, depth):
    """Spans of no, few and very many bytes, also such of many blocks, whatever fits the table."""
    monkeypatch.setattr(resample, "DEPTH", depth)
    resample._tables.cache_clear()
    resample._constants.cache_clear()
    monkeypatch.setattr(resample, "CHUNK", 1000)
    rng = random.Random(1)
    for n in (1, 2, 63, 64, 65, 129, 1000, 20_000):
        raw = np.frombuffer(rng.randbytes(n), np.uint8)
        start = np.array([0, 0, *[rng.randrange(n) for _ in range(8)]])
        end = np.array([n, 0, *[rng.randrange(a, n + 1) for a in start[2:]]])
        want = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(start, end, strict=True)]
        assert resample.crc_of_spans(raw, start, end).tolist() == want
    resample._tables.cache_clear()
    resample._constants.cache_clear()


def brute_features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(text))
    return [*words, *map(" ".join, zip(words, words[1:], strict=False))], len(words)


def test_buckets_equal_the_definition(monkeypatch):
    rng = random.Random(5)
    texts = [t for _, t in ODD] + ["".join(rng.choice("aB é9_-.\x7f日\n ") for _ in range(rng.randrange(60))) for _ in range(200)]
    for chunk in (1 << 18, 50):
        monkeypatch.setattr(resample, "CHUNK", chunk)
        got = list(resample.buckets(texts))
        assert len(got) == len(texts)
        for t, (at, words) in zip(texts, got, strict=True):
            features, n = brute_features(t)
            assert words == n and sorted(at.tolist()) == sorted(zlib.crc32(f.encode()) % 10_000 for f in features)


def test_resampling_equals_brute_force(spark, odd):
    rng = random.Random(2)
    rows = [(100 + i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60)))) for i in range(60)] + [r for r in ODD if r[0] is not None]
    target = [(1, "a b a b A B"), (2, None), (3, "c-d")]
    s, t = (Counter(zlib.crc32(f.encode()) % 10_000 for _, x in side for f in brute_features(x)[0]) for side in (rows, target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in {*s, *t}}
    want, able = [], []
    for i, x in rows:
        features, n = brute_features(x)
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
        if n >= 20:
            able.append(want[-1])
    for rank, row in enumerate(sorted(able, key=lambda r: (-r[3], r[0]))[: 25 * len(able) // 100], 1):
        row[4] = rank
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    goal = spark.createDataFrame(target, "item_id long, text string")
    assert sorted(map(list, resample.resample(docs, goal).collect()), key=repr) == sorted(want, key=repr)
    many = resample.resample(odd, goal.limit(0), least_words=1, share=100).collect()
    assert len(many) == len(ODD) and sorted(r["rank"] for r in many if r["rank"]) == list(range(1, 7))
    assert resample.resample(odd.limit(0), goal).count() == 0


# ---- 12: conversation trie -------------------------------------------------------------------------------------------

def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            digest = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            turns[c].append((t is not None, t, digest, role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v, key=lambda x: (x[0], x[1] or 0, x[2]))] for c, v in turns.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(turns.get(int(math.fmod(c, 20) * -1 + c), [])[:h] + turns[c][h:])
    members, kids, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for p in members:
        kids[p[:-1]] += bool(p)
    for p, m in members.items():
        words = len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * words
            leaves[p[:d]] += not kids[p]
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
             hashlib.sha256(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p)).encode()).hexdigest()) for p, m in members.items()}


def test_trie_equals_brute_force_over_many_shards(spark):
    """Hot first turns, equal conversations, long ones beyond a block, nulls, ties, repeated rows, negative and missing ids."""
    rng = random.Random(4)
    rows = []
    for c in [*range(260), *range(-30, 0), 2**40, 2**40 + 13]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 8, 70])):
            rows.append((c, t, rng.choice(["u", None]) if t % 2 else "a", rng.choice(["x", "y y", "z\x85 z z", "", None]) if t else "hello there"))
    rows += [(400 + i, t, "r", f"same {t}") for i in range(60) for t in range(4)]
    rows += [(900, None, "r", "b"), (900, None, "r", "a"), (900, 1, "r", "a"), (900, 1, "r", "a"), (None, 1, "r", "lost"), (901, 0, None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int")
    want = brute_trie(rows)
    got = [tuple(r) for r in trie.prefix_trie(df, shard=25).collect()]
    assert len(got) == len(want) and set(got) == want
    assert trie.prefix_trie(df.limit(0)).count() == 0


def test_a_shard_has_the_same_nodes_in_one_or_in_two(spark):
    rng = random.Random(6)
    seqs = sorted({tuple(x for _ in range(rng.randrange(6)) for x in (rng.randrange(3), 0)) for _ in range(60)})
    table = lambda part: ([np.array(s, np.int64) for s in part], [np.ones(len(s) // 2, np.int64) for s in part],
                          np.arange(1, len(part) + 1), np.array([seqs.index(s) for s in part]), ["e"] * len(part))
    whole = trie.shard_nodes(*table(seqs), None, None)
    assert (whole["depth"] == 0).sum() == 1 and whole["n_leaves"].max() == whole.loc[whole["depth"] == 0, "n_leaves"].item()
    for cut in range(1, len(seqs)):
        a, b = trie.shard_nodes(*table(seqs[:cut]), None, seqs[cut]), trie.shard_nodes(*table(seqs[cut:]), seqs[cut], None)
        for c in ("n_children", "n_leaves"):
            root = sum(x.loc[x["depth"] == 0, c].item() for x in (a, b))
            assert root == whole.loc[whole["depth"] == 0, c].item()


# ---- 13: similarity join ---------------------------------------------------------------------------------------------

def brute_set(text, words=3):
    found = re.findall("[^\x20\x09-\x0d]+", low(text))
    return {" ".join(found[i:i + words]) for i in range(len(found) - words + 1)} or ({" ".join(found)} if found else set())


def near_copies(rng, groups, longest):
    texts = []
    for _ in range(groups):
        words = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(1, longest))]
        for _ in range(rng.randrange(1, 6)):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 60)):
                words[rng.randrange(len(words))] = rng.choice(["changed", "Q"])
    return texts


@pytest.mark.parametrize("rule", [prefix_join.Rule(), prefix_join.Rule(words=2, num=1, den=2)])
def test_similar_sets_share_tokens_of_their_prefixes(monkeypatch, rule):
    """Whatever number of tokens each set requires, a similar pair shares the smaller one of the two."""
    rng = random.Random(9)
    monkeypatch.setattr(prefix_join, "CELLS", 1 << 10)
    texts = near_copies(rng, 60, 250)
    sets = [rule.shingles(t) for t in texts]
    counts = np.bincount(np.concatenate([prefix_join._cells(s) for s in sets]), minlength=1 << 10).astype(float)
    heads = [(len(s), *prefix_join.head(s, counts, rng.random() * 20, rule)) for s in sets]
    pairs, taken = 0, set()
    for x, (n, k, hx) in enumerate(heads):
        taken.add(k)
        for y, (m, j, hy) in enumerate(heads[:x]):
            same = len(np.intersect1d(sets[x], sets[y]))
            if same * rule.den >= (n + m - same) * rule.num:
                pairs += 1
                big, small = ((n, k, hx), (m, j, hy)) if n >= m else ((m, j, hy), (n, k, hx))
                assert len(np.intersect1d(big[2], small[2][: rule.missing_of_larger(small[0]) + small[1]])) >= min(k, j)
    assert pairs > 50 and len(taken) > 2


def test_join_equals_brute_force(spark, monkeypatch):
    """Chains about the bound, sets that are equal though texts are not, one large group of near-copies in several blocks."""
    monkeypatch.setattr(prefix_join, "BLOCK", 16)
    rng = random.Random(3)
    base = [f"b{k}" for k in range(150)]
    texts = near_copies(rng, 40, 200) + [" ".join(w if j % 70 != k else f"x{k}" for j, w in enumerate(base)) for k in range(70)]
    texts += ["One  two\nthree", "one TWO three", "one two", "ONE two", "one", "", " \t", "", None, texts[0], texts[0].upper()]
    sets = [brute_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for x, a in enumerate(sets):
        for y, b in enumerate(sets[:x]):
            if a and 100 * len(a & b) >= 90 * len(a | b):
                p, q = sorted((find(x), find(y)))
                root[q] = p
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    got = sorted(map(tuple, prefix_join.jaccard_join(df).collect()))
    assert got == [(i, len(sets[i]), find(i)) for i in range(len(texts))]


@pytest.mark.parametrize("size", [50, 300])
def test_texts_that_share_half_their_blocks_do_not_meet(spark, size):
    """Large sets below the similarity, all of common tokens; maps of 256 bits let every pair of them meet."""
    rng = random.Random(5)
    blocks = [" ".join(f"w{b}_{i}" for i in range(size)) for b in range(20)]
    texts = [" ".join(blocks[b] for b in rng.sample(range(20), 12)) for _ in range(30)]
    texts.append(texts[0] + " one more word at the end")
    rule = prefix_join.Rule(words=5, num=80, den=100)
    sets = [set(prefix_join.shingles(t, 5).tolist()) for t in texts]
    similar = {(j, i) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 100 * len(a & b) >= 80 * len(a | b)}
    nodes = prefix_join.heads(spark.createDataFrame([(t,) for t in texts], "text string"), "text", rule)
    rows = nodes.selectExpr("node", "n", "k", "node as root", "posexplode(head) as (at, token)")
    met = {(r["u"], r["v"]) for r in prefix_join.meetings(rows, nodes, rule).select("u", "v").distinct().collect()}
    named = {r["node"]: [hashlib.md5(t.encode()).digest() for t in texts].index(bytes(r["key"])) for r in nodes.collect()}
    met = {tuple(sorted((named[u], named[v]))) for u, v in met}
    assert similar and similar <= met and len(met) <= len(similar) + 30


def test_join_of_odd_rows(spark, odd):
    got = sorted(map(tuple, prefix_join.jaccard_join(odd).collect()), key=repr)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (2, 0, 2), (None, 1, None), (None, 1, None), (3, 1, 3), (4, 1, 4), (5, 1, 4), (6, 0, 6), (7, 1, 7)], key=repr)
    assert prefix_join.jaccard_join(odd.limit(0)).count() == 0


def test_equal_licence_files_of_a_directory_go_by_name(spark):
    rows = [("a/LICENSE", "MIT", 0.9), ("a/COPYING", "BSD", 0.9), ("a/x/f.py", None, 0.0), ("b/LICENSE", "MIT", 0.95), ("b/COPYING", "BSD", 0.9), ("b/f", None, 0.1)]
    out = licenses.inherit(spark.createDataFrame(rows, "path string, own_license string, own_score double"))
    assert {r["path"]: r["license"] for r in out.collect() if r["inherited_from"]} == {"a/x/f.py": "BSD", "b/f": "MIT"}


# ---- queries ---------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["op11_resample", "op12_prefix_trie"])
def test_queries_match_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    df = QUERIES[name](spark, SF)
    assert sorted(cols) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted(cur.fetchall(), key=repr)
