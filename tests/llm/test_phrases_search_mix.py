"""Small tests of operators 11 to 13: brute force, odd rows, ties, repeats, empty tables and clashing columns."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corvane.llm import collocations, mixing, ranked
from corvane.llm.perfect_hash import PerfectHash

SCHEMA = "doc_id long, text string, lang string, source string, k int, at string, q string, rank int"


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def frame(spark, rows):
    """rows of (doc_id, text, lang, source), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 7, "x", "y", 3) for r in rows], SCHEMA)


def plain(rows):
    return sorted(map(repr, rows))


def test_perfect_hash_is_minimal_and_verifies():
    keys = np.unique(np.random.default_rng(3).integers(0, 300, (4000, 2)).astype(np.uint64), axis=0)
    h = PerfectHash.load(PerfectHash(keys[:, 0], keys[:, 1]).dump())
    assert sorted(h.slots(keys[:, 0], keys[:, 1]).tolist()) == list(range(len(keys)))
    assert (h.slots(keys[:, 0] + np.uint64(1000), keys[:, 1]) == -1).all()
    assert PerfectHash(keys[:0, 0], keys[:0, 1]).slots(keys[:2, 0], keys[:2, 1]).tolist() == [-1, -1]


def brute_collocations(rows, least, longest, top):
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for p in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", p)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    f = {g: a for g, a in f.items() if a >= least}
    out = defaultdict(list)
    for g, a in f.items():
        lang, w = g[0], g[1:]
        if len(w) < 2 or any(len(h) > len(g) and h[0] == lang and f[h] >= a and any(h[i : i + len(w)] == w for i in range(1, len(h))) for h in f):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w)))
        out[lang].append((" ".join(w), a, f[lang, *w[:k]], f[lang, *w[k:]], n[lang], score))
    for lang, found in out.items():
        found.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        yield from ((lang, rank, *r) for rank, r in enumerate(found[:top], 1))


def test_collocations_on_odd_rows(spark, none, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 40)
    monkeypatch.setattr(collocations, "SEGMENT_KEYS", 5)
    monkeypatch.setattr(collocations, "SHARE_BLOCKS", 2)
    rng = np.random.default_rng(5)
    words = ["a", "A", "b", "b,", "É", "é", "\x00", "c\x1fd", "\t", "x.y", "z!", " "]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60))), [None, "en", "und", "a\tb", ""][i % 5], None) for i in range(60)]
    rows += [(None, None, "en", None), (1, "", None, None), (2, "a a a a a a a a a a a a", "en", None), (3, "b a " * 500, "en", None), (3, "b a " * 500, "en", None)]
    for least, top in ((3, 5),):
        got = collocations.collocations(frame(spark, rows), least=least, top=top).collect()
        assert plain(tuple(r) for r in got) == plain(brute_collocations(rows, least, 5, top))
    assert collocations.collocations(none).collect() == []
    assert collocations.collocations(frame(spark, [(1, None, None, None)])).collect() == []


def brute_search(docs, items, k):
    split = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    tf = [(i, Counter(split(t))) for i, t in docs]
    n, total, df = sum(1 for _, c in tf if c), sum(sum(c.values()) for _, c in tf), Counter(w for _, c in tf for w in c)
    for item, text in items:
        found = []
        for i, c in tf:
            m = 50 + 50 * sum(c.values()) * n // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(split(text)) if c[w])
            if score > 0:
                found.append((-score, i is None, i or 0))
        yield from ((item, rank, None if no_id else i, -score) for rank, (score, no_id, i) in enumerate(sorted(found)[:k], 1))


def test_search_on_odd_rows(spark, none, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 300)
    monkeypatch.setattr(ranked, "DEPTH", 2)
    rng = np.random.default_rng(6)
    words = [f"w{int(x)}" for x in rng.zipf(1.4, 400) % 60] + ["É", "é", "Q-q", "\x7f", "_"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 80)))) for i in range(200)]
    docs += [(None, docs[3][1]), (3, docs[3][1]), (7, None), (8, ""), (9, "w1 w2 É " * 3000), (10, "w5"), (11, "w5"), (12, "w5"), (-4, "w5")]
    items = [(1, "w1 w2 w3"), (2, "w5"), (2, "w5"), (None, "É q"), (4, None), (5, ""), (6, "nowhere"), (7, docs[5][1])]
    table = frame(spark, [(i, t, None, None) for i, t in docs])
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, q int")
    for k in (3, 50):
        got = ranked.search(table, asked, k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert plain(tuple(r) for r in got.collect()) == plain(brute_search(docs, items, k))
    monkeypatch.setattr(ranked, "QUERIES_AT_ONCE", 3)
    assert plain(tuple(r) for r in ranked.search(table, asked, 3).collect()) == plain(brute_search(docs, items, 3))
    assert ranked.search(none, asked).collect() == [] and ranked.search(table, asked.limit(0)).collect() == []


def test_threshold_stops_early():
    """A query whose best documents stand first in its lists doesn't look all of them up."""
    n = 4000
    tf = np.concatenate([np.full(60, 40), np.ones(n - 60, np.int64)])
    got = {"ids": np.stack([np.ones(n, np.int64), np.arange(n)], 1).tobytes(), "lengths": ranked.packed(np.full(n, 100)), "each": ranked.packed(np.full(n, 1, np.uint32)), "term": ranked.packed(np.zeros(n, np.uint32)), "tf": ranked.packed(tf.astype(np.uint32))}
    block, best = ranked.Block(got, 2 * n, 200 * n, 1), ranked.Best(50)
    assert ranked.threshold(block, np.array([0]), np.array([600]), best) < 100 and best.id.tolist() == list(range(50))


def water(sizes, weights, most):
    target, total, closed = {}, sum(sizes.values()), set()
    while True:
        rest, open_ = total - sum(most * sizes[s] for s in closed), [s for s in sizes if s not in closed]
        target = {s: most * sizes[s] if s in closed else rest * weights[s] / sum(weights[x] for x in open_) for s in sizes}
        if not (over := [s for s in open_ if target[s] > most * sizes[s]]):
            return target
        closed |= set(over)


def test_mix(spark, none):
    rng = np.random.default_rng(7)
    sources = ["b", "a", None, "é", "Z", "tiny", "no words"]
    rows = [(i, "w " * int(rng.integers(0, 40)), None, sources[int(rng.choice(5, p=[0.5, 0.2, 0.1, 0.1, 0.1]))]) for i in range(600)]
    rows += [(900, "long " * 9000, None, "a"), (901, "x", None, "tiny"), (902, "", None, "no words"), (903, None, None, None), (None, "n n n", None, "b"), (5, *rows[5][1:]), (5, *rows[5][1:])]
    docs = frame(spark, rows)
    for shards in (1, 7):
        mix = mixing.Mix(docs, shards=shards)
        got = mix.documents().collect()
        assert len(got) == len(rows)
        size = Counter()
        for r in rows:
            size[r[3]] += len((r[1] or "").split())
        ordered = sorted(size, key=lambda s: (s is None, (s or "").encode()))
        want = water(size, {s: (1, 2, 3)[i % 3] for i, s in enumerate(ordered)}, 3)
        taken = Counter()
        for r in got:
            assert r["source_size"] == size[r["source"]] and math.isclose(r["target"], want[r["source"]], abs_tol=1e-6) and 0 <= r["taken"] <= 3 * r["size"]
            taken[r["source"]] += r["taken"]
        assert all(abs(taken[s] - want[s]) <= max(1, 0.001 * want[s] + 0.0004 * size[s]) for s in size)
        pieces = [tuple(r) for r in mix.pieces.collect()]
        assert plain(pieces) == plain(tuple(r) for r in mixing.Mix(docs.repartition(3), shards=shards).pieces.collect())
        copies, per_shard = Counter(), defaultdict(set)
        for p in pieces:
            copies[p[2], p[3] + p[5]] += 0
            per_shard[p[0]].add((p[1], p[2]))
        drawn = [len(per_shard[s]) for s in range(shards)]
        assert max(drawn) - min(drawn) <= 2 * math.ceil(math.log2(shards) + 1)
    assert mixing.Mix(none).documents().collect() == [] and mixing.Mix(none).shuffled().count() == 0
    assert [tuple(r) for r in mixing.Mix(frame(spark, [(1, None, None, None)])).documents().select("size", "target", "taken").collect()] == [(0, 0.0, 0)]


def test_permutations_and_hypergeometric_draws(spark):
    for n in (1, 2, 7, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted("id", f"{n}L", "5L").alias("p")).collect()]
        assert sorted(got) == list(range(n)) and (n < 100 or got != list(range(n)))
    draw = mixing._hypergeometric("60L", "20L", "30L", "((id + 0.5D) / 20000)")
    got = Counter(r[0] for r in spark.range(20000).selectExpr(f"{draw} as x").collect())
    for x in range(4, 17):
        assert abs(got[x] / 20000 - math.comb(20, x) * math.comb(40, 30 - x) / math.comb(60, 30)) < 2e-4
    odd = spark.sql(f"select {mixing._hypergeometric('0L', '0L', '0L', '0.5D')} as a, {mixing._hypergeometric('9L', '9L', '4L', '0.9D')} as b, {mixing._hypergeometric('9L', '0L', '4L', '0.9D')} as c").first()
    assert tuple(odd) == (0, 4, 0)
