"""Divergence of sources, the prefix trie and language-model scores against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from maskwright.llm import divergence, lm_scoring, prefix_trie

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def divergences_by_hand(rows, min_docs, top):
    docs = [(lang or "", source or "", TERM.findall(lower(text))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = collections.Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in seen.items() if n >= min_docs}
        counts = {s: collections.Counter() for s in {d[1] for d in own}}
        for _, s, terms in own:
            counts[s].update(t for t in terms if t in kept)
        every = sum(counts.values(), collections.Counter())
        price = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // q
        for s, c in counts.items():
            pairs = [(sum(f(price(c, t), price(counts[o], t)) for t in kept), o) for o in counts if o != s]
            terms = [(f(price(c, t), price(every, t)), t) for t in kept if c[t] and price(c, t) > price(every, t)]
            for part, values, limit in (("pair", pairs, None), ("term", terms, top)):
                values.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(values[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "top"), [(1 << 16, 200), (16, 3)])
def test_divergences(docs, rows, empty, block, top):
    expected = divergences_by_hand([r[1:4] for r in rows], 3, top)
    got = sorted(tuple(r) for r in divergence.divergences(docs, top=top, block=block).collect())
    assert got == expected and any(r[4] for r in got)
    assert divergence.divergences(empty).collect() == []


def test_divergence_without_kept_terms(spark):
    docs = spark.createDataFrame([("one two", "en", "a"), (None, "en", "b"), ("", None, None), ("x" * 10, "de", None)], "text string, lang string, source string")
    got = sorted(tuple(r) for r in divergence.divergences(docs).collect())
    assert got == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_gallop():
    draw = np.random.default_rng(5)
    for n, m in ((0, 5), (5, 0), (3, 4000), (900, 1000), (1, 1)):
        short, long = (np.unique(draw.integers(0, 3000, k)) for k in (n, m))
        at = divergence.gallop(short, long)
        assert [x if x in set(long.tolist()) else None for x in short.tolist()] == [long[i] if i >= 0 else None for i in at]


def test_prices_of_large_counts():
    n = np.array([0, 5, 9_500_000_000], np.int64)
    assert divergence.prices(n, 10**11).tolist() == [1 + 10**9 * (x + 1) // 10**11 for x in n.tolist()]


def trie_by_hand(turns_of):
    """Nodes from ``{conv_id: [(role, text)]}`` of rebuilt conversations."""
    members = collections.defaultdict(list)
    for c, turns in turns_of.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    saved = {p: (len(m) - 1) * len(p[-1][1].encode()) if p else 0 for p, m in members.items()}
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, total = collections.Counter(), collections.Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            total[p[:d]] += saved[p]
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], total[p],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if len(turns_of[c]) == len(p)).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def rebuilt_by_hand(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [x[1:] for x in sorted(t, key=lambda x: x[0])] for c, t in own.items()}
    out = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + t[h:]
    return out


CONVERSATIONS = "turn int, conv_id bigint, text string, role string, key string, code string, size string, shard string"


def conversation_rows():
    draw = random.Random(11)
    out = []
    for c in [*range(120), -7, 10**12 + 3]:
        kind = draw.choice(["same", "random", "random", "long"])
        n = {"same": 6, "long": 40}.get(kind, draw.randint(1, 8))
        for t in range(n):
            text = f"turn {t}" if kind == "same" else draw.choice(["hello", "wie geht's", "über", None, "", "x" * 30])
            out.append((c, t if draw.random() < 0.98 or t else None, draw.choice(["user", None]) if kind == "random" else "user", text))
    out += [(500 + i, t, "user", f"turn {t}") for i in range(400) for t in range(3)]  # a large group of equal conversations
    return out


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_prefix_trie(spark, shards):
    rows = conversation_rows()
    frame = spark.createDataFrame([(t, c, x, r, "k", "c", "s", "h") for c, t, r, x in rows] + [(1, None, "lost", "user", None, None, None, None)], CONVERSATIONS).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        nodes = prefix_trie.prefix_trie(prefix_trie.with_shared_heads(prefix_trie.sequences(prefix_trie.coded_turns(frame))))
        got = sorted((*(v if v is not None else -1 for v in r[:3]), *r[3:]) for r in nodes.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert got == trie_by_hand(rebuilt_by_hand(rows))


def test_prefix_trie_of_nothing(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert prefix_trie.prefix_trie(prefix_trie.sequences(prefix_trie.coded_turns(none))).collect() == []
    # Conversation 3 takes its only turns from conversation 0, which does not exist: it ends in the root.
    assert zlib.crc32(b"3") % 9 > 1
    one = spark.createDataFrame([(1, 3, "text", "user", "", "", "", "")], CONVERSATIONS)
    nodes = prefix_trie.prefix_trie(prefix_trie.with_shared_heads(prefix_trie.sequences(prefix_trie.coded_turns(one))))
    assert [tuple(r) for r in nodes.collect()] == [(3, 0, None, 1, 0, 1, 0, hashlib.sha256(b"3").hexdigest())]


def test_tree_is_balanced():
    ordered = [([i, 5], [1, 1]) for i in range(1023)]
    tree = prefix_trie.TernaryTree.of(ordered)
    assert len(tree.parents_first()) == 1 + 2 * 1023

    def height(node):
        return 0 if node < 0 else 1 + max(height(tree.lo[node]), height(tree.hi[node]))

    assert height(tree.eq[0]) == 10


def scores_by_hand(rows, order, mass):
    """Counts in dictionaries, probabilities by recursion."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda text: [0, *WORD.findall(lower(text)), 1]  # noqa: E731  0 starts a text, 1 ends it
    grams = collections.Counter()
    for i, text in rows:
        if not held(i):
            seq = tokens(text)
            for n in range(1, order + 1):
                grams.update(tuple(seq[k : k + n]) for k in range(len(seq) - n + 1))
    single = {g[0]: c for g, c in grams.items() if len(g) == 1 and g[0] != 0}
    total, types = sum(single.values()), len(single)

    def p(history, w):
        if not history:
            return (single.get(w, 0) + 0.5) / (total + 0.5 * (types + 1))
        m = mass[len(history) + 1]
        return (grams[(*history, w)] + m * p(history[1:], w)) / (grams[history] + m)

    out = []
    for i, text in rows:
        seq = tokens(text)
        base = sum(math.log10(p((), w)) for w in seq[1:])
        score = sum(math.log10(p(tuple(seq[max(0, k - order + 1) : k]), seq[k])) for k in range(1, len(seq)))
        out.append((i, held(i), len(seq) - 1, sum(w in single for w in seq[1:]), total, base, score))
    return out


@pytest.mark.parametrize(("order", "slice_tokens"), [(1, 10**6), (2, 10**6), (3, 3000)])
def test_scores(docs, rows, empty, monkeypatch, order, slice_tokens):
    monkeypatch.setattr(lm_scoring, "LANE", 50)  # the long text and many others are cut into lanes
    mass = {2: 20.0, 3: 5.0}
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    expected = sorted(scores_by_hand([r[:2] for r in rows], order, mass), key=key)
    got = sorted(map(tuple, lm_scoring.scored(docs, order, mass, slice_tokens).collect()), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    for mine, theirs in zip(got, expected, strict=True):
        assert mine[5:] == pytest.approx(theirs[5:], rel=1e-9)
    assert lm_scoring.scored(empty).collect() == []


def test_model_beats_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in lm_scoring.scored(docs).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * tokens


def test_nothing_to_learn_from(spark):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    docs = spark.createDataFrame([(i, "a b c") for i in held], "doc_id bigint, text string")
    for r in lm_scoring.scored(docs).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 4, 0, 0, 0.0)
        assert r.score == pytest.approx(0.0)


def test_packing():
    for numbers in ([], [0], [1, 2, 3], [2**40, 7, 2**63]):
        assert lm_scoring.unpacked(lm_scoring.packed(np.array(numbers, np.uint64))).tolist() == numbers
