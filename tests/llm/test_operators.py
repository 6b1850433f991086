"""Every operator against a brute-force version, on rows with every odd case, and on no rows."""

import base64
import collections
import hashlib
import re
import types
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from maskwright.llm import byte_bpe, exact_dedup, language_id, mixing, near_dedup, repetition, sharding, token_files, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def by_id(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_repetition(docs, rows, empty):
    def brute(text):
        words = WORD.findall(text or "")
        n, windows = len(words), collections.Counter(zip(words, words[1:], words[2:], strict=False))
        inside = {j for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [line for line in (text or "").split("\n") if WORD.search(line)]
        return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)

    got = repetition.repetition(docs).collect()
    assert len(got) == len(rows)
    expected = collections.Counter((r[0], *brute(r[1])) for r in rows)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == expected
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert repetition.repetition(empty).count() == 0


def test_repeated_passage_is_rejected():
    passage = [f"w{i}" for i in range(150)]
    text = " ".join([*passage, *[f"x{i}" for i in range(300)], *passage])
    got = repetition.score_batch([text.encode()])
    assert (got["covered_words"][0], got["longest_repeat"][0]) == (300, 150)
    assert repetition.repeat_spans(text) == [(0, 150), (450, 600)]
    assert repetition.repeat_spans("a " * 20) == [(0, 20)]


def test_covered_fraction_alone_rejects(spark):
    def text(n_other):
        passages = [[f"p{k}w{i}" for i in range(60)] for k in range(3)]  # each twice: 360 words
        other = [[f"x{k}y{i}" for i in range(n_other // 6)] for k in range(6)]
        return " ".join(w for k in range(6) for w in passages[k % 3] + other[k])

    docs = spark.createDataFrame([(1, text(480)), (2, text(1800))], "doc_id bigint, text string")
    many, few = sorted(repetition.repetition(docs).collect())
    assert (many.n_words, many.covered_words, few.n_words, few.covered_words) == (840, 360, 2160, 360)
    assert [r.longest_repeat for r in (many, few)] == [60, 60] and not many.base_failed and not few.base_failed
    assert (many.kept, few.kept) == (False, True)


def test_mixing(docs, rows, empty):
    got = mixing.taken(docs, block=8).collect()
    assert len(got) == len(rows)
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    sizes, targets, taken = collections.Counter(), {}, collections.Counter()
    for r in got:
        sizes[r.source] += r.size
        targets[r.source] = r.target
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights, expected, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, sum(sizes.values())
    left, free = total, set(order)
    while True:  # reshare what caps leave over
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        expected |= {s: 3 * sizes[s] for s in over}
        left, free = left - sum(3 * sizes[s] for s in over), free - over
    expected |= share
    for s in order:
        assert targets[s] == pytest.approx(expected[s])
        assert abs(taken[s] - targets[s]) <= 32
    assert by_id(mixing.taken(docs, block=8)) == sorted((tuple(r) for r in got), key=repr)
    assert mixing.taken(empty).count() == 0
    blocks = mixing.mixed_blocks(docs, block=8).collect()
    assert sum(len(b.tokens) for b in blocks) == sum(taken.values())
    assert mixing.repeat_documents(docs).columns == docs.columns
    assert mixing.repeat_documents(empty).count() == 0


def test_repeated_documents_keep_source_sums(spark):
    sizes = {s: [20 + 37 * (i * i % (n + 1)) % 400 for i in range(n)] for s, n in (("a", 300), ("b", 150), ("c", 200), (None, 120))}
    sizes["b"].append(sum(sizes["b"]) // 2)  # a third of its source's words
    data = [(1000 * k + i, " ".join([f"w{k}"] * n), s) for k, (s, own) in enumerate(sizes.items()) for i, n in enumerate(own)]
    data += [(None, "x " * 50, "c"), (5, "y " * 30, "b"), (5, "y " * 30, "b"), (6, None, "a"), (7, " ", None)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, source string").repartition(4)
    want, got, longest = collections.Counter(), collections.Counter(), collections.Counter()
    rate = collections.defaultdict(lambda: [0, 0])
    for r in mixing.taken(docs).collect():
        want[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
        rate[r.source, r.doc_id, r.size][0] += r.taken
        rate[r.source, r.doc_id, r.size][1] += r.size
    mix = mixing.repeat_documents(docs).collect()
    times = collections.Counter()
    for r in mix:
        n = len(WORD.findall(r.text))
        got[r.source] += n
        times[r.source, r.doc_id, n] += n
    for s in sizes:
        assert abs(got[s] - want[s]) <= longest[s] / 2 + 1, s
    for unit, (words, size) in rate.items():
        assert not size or abs(times[unit] - words) < size
    assert by_id(mixing.repeat_documents(docs)) == sorted(map(tuple, mix), key=repr)
    # A source of documents of one size comes within half a document of its sum.
    even = spark.createDataFrame([(i, "w " * 100, s) for i, s in enumerate(["a"] * 600 + ["b"] * 400 + ["c"] * 300)], "doc_id bigint, text string, source string")
    want = {r.source: r.n for r in mixing.taken(even).groupBy("source").agg({"taken": "sum"}).toDF("source", "n").collect()}
    got = {r.source: 100 * r["count"] for r in mixing.repeat_documents(even).groupBy("source").count().collect()}
    assert all(abs(got[s] - want[s]) <= 51 for s in want)


def test_permutation(spark):
    from pyspark.sql import functions as F

    for size in (1, 2, 7, 100):
        got = spark.range(size).select(mixing.permuted(F.col("id"), F.lit(size), F.lit(3)).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(size))


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(docs, rows, empty, width):
    sets, parent = collections.defaultdict(set), {}
    texts = collections.defaultdict(list)
    for r in rows:
        words = lower(r[1]).split()
        words = WORD.findall(lower(r[1]))
        own = frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()
        if r[0] is not None:
            sets[r[0]] = own
            parent[r[0]] = r[0]
        texts[r[0]].append(len(own))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = near_dedup.near_groups(docs, width=width).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles in texts[r.doc_id]
        assert r.component_id == (None if r.doc_id is None else root(r.doc_id))
        assert r.kept == (r.doc_id == r.component_id)
    kept = near_dedup.drop_near_copies(docs, width)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in got)
    assert near_dedup.near_groups(empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 200), (300, 200), (9, 9)], "u bigint, v bigint")
    got = {r.node: r.root for r in near_dedup.components(edges).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 200: 100, 300: 100}


def test_toxicity(spark, empty):
    text = lambda i: " ".join(f"w{(i * 7 + j * j) % 50}" for j in range(40))
    data = [(i, text(i) + (" Blorg!" if i % 4 == 0 else "") + (" blorgish snarf" if i % 8 == 0 else "")) for i in range(400)] + [(None, None), (900, ""), (5, text(5))]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (3, 0, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(data)
    held_out = [r for r in got if r.doc_id is not None and 200 <= r.doc_id < 400]
    assert all(r.toxic == (r.doc_id % 4 == 0) and r.kept != r.toxic for r in held_out)
    assert not any(r.toxic for r in got if r.doc_id in (None, 900))
    severe, mild = ([r.severity for r in held_out if r.doc_id % 8 == k] for k in (0, 4))
    assert min(severe) > max(mild)
    assert by_id(toxicity.drop_toxic(docs, model).select("doc_id")) == by_id(toxicity.scored(docs, model).filter("kept").select("doc_id"))
    for nothing in (toxicity.learn(docs, labels.limit(0)), toxicity.learn(empty, labels)):
        assert toxicity.scored(docs, nothing).filter("toxic").count() == 0
    assert toxicity.drop_toxic(empty, model).columns == empty.columns


def test_sharding(docs, rows, empty, tmp_path):
    limit = 600
    got = sharding.shards(docs, limit).collect()
    assert len(got) == len(rows)
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    for name, members in shards.items():
        assert sum(r.bytes for r in members) <= limit or len({r.doc_id for r in members}) == 1
        parent = sum(r.bytes for other, o in shards.items() if other.startswith(name[:-1]) for r in o)
        assert not name or "+" in name or parent > limit
    assert {r.shard for r in sharding.shards(docs, 1 << 40).collect()} == {""}
    assert sharding.shards(empty).count() == 0
    entries = sharding.directory(sharding.shards(docs.limit(40), limit).filter("shard NOT LIKE '%+%'")).collect()
    assert sum(e.entries for e in entries) <= 1 << max(e.depth for e in entries)
    sharding.write_shards(docs.limit(30), str(tmp_path / "shards"), limit)


def test_exact_dedup(docs, rows, empty):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    got = exact_dedup.mark_copies(docs).select("doc_id", "text", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert len(got) == len(rows)
    for r in got:
        ids = groups[lower(r.text)]
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert r.group_size == len(ids)
        assert r.text_sha256 == hashlib.sha256(lower(r.text).encode()).hexdigest()
    assert sum(r.kept for r in got) == len(groups)  # of repeated rows one stays
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.mark_copies(docs, filter_bits=64).filter("kept").count() == len(groups)  # a filter too small
    assert exact_dedup.mark_copies(empty).count() == 0


def test_token_files(spark, docs, rows, empty, tmp_path, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(token_files, "BLOCK", 5000)  # the longest text runs over several blocks
    token_files.write_files(docs, str(tmp_path / "t"), path, end=2)
    got = sorted(map(tuple, token_files.read_files(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    expected, start = [], 0
    for doc, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected
    token_files.write_files(empty, str(tmp_path / "e"), path, end=2)
    assert token_files.read_files(spark, str(tmp_path / "e")).count() == 0


def test_token_files_added_tokens(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b x<|startoftext|>y", "<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <| endoftext |>", "<|endoftext|>\u0338 e<|startoftext|>\u0301", "it<|endoftext|>'s\u00a0<|endoftext|>", "after"]
    assert library.encode(texts[0], add_special_tokens=False).ids == [320, 49407, 321, 343, 49406, 344]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(1)
    token_files.write_files(docs, str(tmp_path / "t"), path, end=2)
    expected, start = [], 0
    for i, text in enumerate(texts):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert by_id(token_files.read_files(spark, str(tmp_path / "t"))) == expected


def test_tokenizer_equals_the_library_on_every_character():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    ours = token_files.WordTokenizer(library.to_str())
    chars = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c <= 0xDFFF] + [chr(c) for c in range(0x20000, 0x110000, 257)]
    texts = ["".join(f"a{c}b x{c} " for c in chars[i : i + 500]) for i in range(0, len(chars), 500)]
    texts += ["\u0130\u05bf", "\u0e49\U00011d45", "\u0595\U00011a47", "a\u0558b", "e\u0301 E\u0301 \u1e9b\u0323"]
    draw = np.random.default_rng(1)
    some = ["a", "'s", "1", " ", "\u0301", "\u0130", "\u03a3", "\u0085", "\u05bf", "\U00011d45", "<|endoftext|>", "\u0558", "\ufb03", "Z"]
    texts += ["".join(draw.choice(some, 12)) for _ in range(3000)]
    got = ours.encode([t.encode() for t in texts], 2)
    for text, found in zip(library.encode_batch(texts, add_special_tokens=False), got, strict=True):
        assert np.frombuffer(found, "<u4").tolist() == [*text.ids, 2]


def test_rans_blocks():
    rng = np.random.default_rng(0)
    for n in (1, 2, 1000, 5000, 300_000):
        ids = np.minimum(rng.zipf(1.3, n), 40_000)
        table = token_files.Table(np.bincount(ids))
        data = token_files.encode_block(ids, table)
        assert (token_files.decode_block(data, table) == ids).all()
        parts = -(-(-(-n // min(1024, n))) // 128)
        assert (np.concatenate([token_files.decode_block(data, table, k, 1) for k in range(parts)]) == ids).all()
    damaged = bytearray(data)
    damaged[-5] ^= 1
    with pytest.raises(ValueError):
        token_files.decode_block(bytes(damaged), table)
    assert token_files.combined_crc(zlib.crc32(b"one "), zlib.crc32(b"two"), 3) == zlib.crc32(b"one two")


def test_language_id(spark, docs, rows, empty):
    letters = {"aa": "abcdefg", "bb": "mnopqrs", "cc": "tuvwxyz"}
    text = lambda lang, i, n=40: " ".join(letters[lang][(i + j) % 7] + letters[lang][(i * j) % 7] + letters[lang][j % 7] for j in range(n))
    data = [(i, text(lang, i), lang) for i in range(90) for lang in [("aa", "bb", "cc")[i % 3]]]
    model = language_id.learn(spark.createDataFrame(data[:60] + [(1, None, "aa"), (2, "abc", None)], "doc_id bigint, text string, lang string"))
    assert model.languages == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(data, "doc_id bigint, text string, lang string"), model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in data[60:])
    best, score, chosen = language_id.infer(model, [text("aa", 1, 80) + " " + text("bb", 2, 60), "12 ?", ""])
    assert (best[0], set(chosen[0]), best[1:]) == ("aa", {"aa", "bb"}, ["und", "und"]) and 0.4 < score[0] < 0.8
    letters |= {"dd": "hijkl", "ee": "yzäöü"}
    many = lambda lang, i, n=60: " ".join(letters[lang][(i + j) % 5] + letters[lang][(i * j) % 5] + letters[lang][j % 5] for j in range(n))
    five = [(i, many(lang, i), lang) for i in range(100) for lang in [sorted(letters)[i % 5]]]
    of_five = language_id.learn(spark.createDataFrame(five, "doc_id bigint, text string, lang string"))
    _, share, sets = language_id.infer(of_five, [" ".join(many(lang, sorted(letters).index(lang)) for lang in ("aa", "bb", "dd", "ee")), many("cc", 2)])
    assert [set(s) for s in sets] == [{"aa", "bb", "dd", "ee"}, {"cc"}] and share[0] < 0.4 and share[1] == 1.0
    odd = language_id.predict(docs, model).collect()
    assert len(odd) == len(rows)
    for r in odd:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    nothing = language_id.learn(empty)
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def test_url_filter(spark):
    urls = ["http://a.net/x", "http://a.net", "https://Example.NET/en/1?q", "http://notexample.net/en/", "http://m.example.com/de/", "x.org/fr/", None, "", "http://a.org/fr/#x",
            "http://a.org/fr", "http://free-bets.example.com/en/1", "http://xexample.com/de/a", "a://b://c", "http://u@example.com:80/de/", "http://porn.example.com/"]
    named = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

    def brute(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
        hits = [(len(h + p), h + p, v) for h, p, v in named if (lower(host) == h or lower(host).endswith("." + h)) and path.startswith(p)]
        if hits:
            return lower(host), path, max(hits)[1], max(hits)[2]
        blocked = any(re.search(r.pattern, lower(host) + path) for r in url_filter.PATTERNS)
        return lower(host), path, None, "block" if blocked else "allow"

    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://a.net/")], "page_id bigint, url string")
    got = url_filter.judged(pages, url_filter.NAMED + url_filter.PATTERNS).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id]), urls[r.page_id]
    assert url_filter.judged(pages.limit(0), url_filter.NAMED).count() == 0


def test_byte_bpe(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        raw = file.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def brute(text):
        ids = np.array(library.encode_ordinary(text or ""), "<u4")
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    got = byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter((r[0], *brute(r[1])) for r in rows)
    assert byte_bpe.encode_documents(empty, path, public_tokenizers.PATTERN).count() == 0
    codec = byte_bpe.Codec(raw, public_tokenizers.PATTERN)
    for text in ("a\x1cb \x1f \x85\u2028 x", "\n\n a  b\n c \n", "日本語 🙂🙂 ½ ²³ Ⅷ", "a" * 3000, "don't WE'LL 's", "é\u0301", " ", "   x", "<|endoftext|>"):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()


def test_byte_bpe_white_space_runs():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        raw = file.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.Codec(raw, public_tokenizers.PATTERN)
    assert np.frombuffer(codec.encode("word \xa0 \xa0 word"), "<u4").tolist() == [4775, 11504, 1573]
    spaces = ["\xa0 " * n for n in (1, 2, 4, 8)] + [" \xa0" * n for n in (1, 2, 4, 8)] + ["\n ", " \n", "\u3000 \t ", "\x1c \x1f ", "  ", " \u2028 ", "\x85 "]
    for run in spaces:
        for text in (f"word {run}word", f"word{run} word", f"word{run}word", f"{run}a b{run}", f"a b {run} c's {run}"):
            assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text), text
            assert codec.decode(codec.encode(text)) == text.encode()


def test_plain_words_are_learned_without_offsets_and_letters_without_the_pattern():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own = token_files.WordTokenizer(library.to_str())
    texts = ["Été naïve", "end. (start) it's 'tis a,b 12x x12 don't'", "ªº ÀÉ... __a__ a_ $5 ...", "ſt ﬁn日本 x<|endoftext|>Y. <b", "", " \t "]
    want = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode([t.encode() for t in texts], 2)] == want
    plain, split = token_files.WordTokenizer(library.to_str()), []
    find = plain.split
    plain.split = lambda word: split.append(word) or find(word)
    plain.library = types.SimpleNamespace(encode_batch_fast=library.encode_batch_fast, encode_batch=library.encode_batch)
    assert [np.frombuffer(x, "<u4").tolist() for x in plain.encode([t.encode() for t in texts[:3]], 2)] == want[:3]
    assert split and not {"été", "naïve", "end.", "àé..."} & set(split)
