"""The training-data operators against brute force, and their defined cases:
nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DDL = "doc_id long, text string, source string, kept string, ids string, taken string, n_words string, fp string"


def _corpus():
    rng = random.Random(4)
    vocab = ["w%d" % i for i in range(300)] + ["Été", "naïve", "Don't", "we'll", "42", "#", "漢字"]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = make(60)
    texts = [make(rng.randint(0, 120)) for _ in range(60)]
    texts += [make(20) + "\n" + passage + " \t" + make(15) for _ in range(5)]
    texts += [texts[3]] * 4 + [texts[7] + " end"] * 2
    texts += [None, "", " \n\t ", "one", "a b c", make(6000), "spam " * 40, "same line here now\n" * 30, "x" * 3000,
              "*** &&& ### %%% $$$ ### *** &&& ### %%% $$$ ###", None]
    rows = [(i, t, f"s{i % 4}" if i % 9 else None, "k", "i", "t", "n", "f") for i, t in enumerate(texts)]
    rows.append(rows[5])                                   # a repeated row
    rows += [(None, passage + " tail", "s1", "k", "i", "t", "n", "f"), (None, None, "s0", "k", "i", "t", "n", "f")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return _corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def vocab():
    from ledgerlens.llm.queries import vocabulary
    return vocabulary()


def _tiktoken(vocab):
    import public_tokenizers as P
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocab, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_tokenizer_library(spark, docs, none, vocab):
    from ledgerlens.llm import bpe
    ref = _tiktoken(vocab)
    got = bpe.decode(bpe.encode(docs, vocab), vocab).collect()
    assert len(got) == docs.count()
    for r in got:
        text = r.text or ""
        assert r.ids == ref.encode_ordinary(text) and bytes(r.decoded) == text.encode()
        assert r.starts == [len(ref.decode_bytes(r.ids[:k])) for k in range(len(r.ids))][:len(r.ids)]
        assert r.kept == "k"
    assert bpe.decode(bpe.encode(none, vocab), vocab).count() == 0


def test_bpe_boundaries_on_odd_texts(vocab):
    from ledgerlens.llm import bpe
    ref, enc, rng = _tiktoken(vocab), bpe.encoder(vocab), random.Random(1)
    alphabet = list("  \t\n\r\x0b\x0c\x1c\x85\xa0''''stmdrevelSTMDL12'#é漢字́a\U00010d40\U0001f600_.") + ["'ll", "'re"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 5000, " " * 3000 + "x", "'" * 500, "\n" * 700, "ab" * 900, ""]
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    rng.shuffle(points)
    texts += ["".join(points[i:i + 500]) for i in range(0, 200_000, 500)]
    ids, upto = enc.encode(texts)
    lo = 0
    for text, hi in zip(texts, upto):
        assert ids[lo:hi].tolist() == ref.encode_ordinary(text), text[:80]
        lo = hi


def test_length_histogram(spark, docs, rows, none, vocab):
    from ledgerlens.llm import lengths
    ref = _tiktoken(vocab)
    n = sorted(len(ref.encode_ordinary(r[1] or "")) for r in rows)
    sums = lengths.suffix_sums(lengths.histogram(docs, vocab)).cache()
    got = {r.n_tokens: r for r in sums.collect()}
    assert {k: r.n_docs for k, r in got.items()} == collections.Counter(n)
    for k, r in got.items():
        assert r.docs_at_least == sum(x >= k for x in n) and r.tokens_at_least == sum(x for x in n if x >= k)
        assert r.truncated_total == sum(min(x, k) for x in n) and r.total_tokens == sum(n)
    for r in lengths.answers(sums, [0, 7, 64, 10**6]).collect():
        assert r.truncated_total == sum(min(x, r.context_limit) for x in n)
        assert r.docs_that_fit == sum(x <= r.context_limit for x in n)
    q = {r.share: r.n_tokens for r in lengths.quantiles(sums, [0.5, 0.9]).collect()}
    assert q == {s: n[math.ceil(s * len(n)) - 1] for s in (0.5, 0.9)}
    assert lengths.suffix_sums(lengths.histogram(none, vocab)).count() == 0


def test_substring_dedup(spark, docs, rows, none):
    from ledgerlens.llm import substrings
    first = {}
    words = [(r[0], (r[1] or "").encode().split()) for r in rows]
    for i, w in words:
        for k in range(len(w) - 12):
            if i is not None:
                key = tuple(w[k:k + 13])
                first[key] = min(first.get(key, i), i)
    want = collections.Counter()
    for i, w in words:
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k:k + 13])] < i:
                gone |= set(range(k, k + 13))
        want[i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()] += 1
    got = collections.Counter()
    for r in substrings.remove_repeats(docs).collect():
        assert sum(b - a for a, b in r.removed) == r.n_removed and r.kept == "k"
        got[r.doc_id, r.n_words, r.n_removed, " ".join((r.text or "").encode().decode().split())] += 1
    assert got == want
    assert substrings.remove_repeats(none).count() == 0


def test_packed_lists_round_trip():
    from ledgerlens.llm import exchange as E
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 50000):
        for top in (2**64 - 1, 2**40, 2**20):
            keys = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
            assert (E.unpack(E.pack(keys)) == keys).all()
            assert (E.distinct(np.concatenate([keys, keys[::2]])) == keys).all()
    for kind in (np.uint8, np.uint32, np.uint64):
        x = rng.integers(0, 200, 100).astype(kind)
        assert (E.stretch(E.squeeze(x), kind) == x).all() and len(E.stretch(E.squeeze(x[:0]), kind)) == 0


def test_buckets_of_sorted_keys():
    from ledgerlens.llm import exchange as E
    rng = np.random.default_rng(1)
    for n, buckets in ((0, 5), (1, 1), (300, 7), (300, 100000), (5000, 64)):
        keys = np.unique(rng.integers(0, 2**64 - 1, n, dtype=np.uint64, endpoint=True))
        own, edges = E.bucket_edges(keys, buckets)
        assert len(own) <= min(n, buckets) and (np.diff(own) > 0).all() and len(edges) == len(own) + 1
        want = [min(int(k) // (2**64 // buckets), buckets - 1) for k in keys]
        got = np.concatenate([np.full(b - a, o) for o, a, b in zip(own, edges, edges[1:])]) if n else np.zeros(0)
        assert got.tolist() == want
        begin, end = E.spans(keys, buckets, np.arange(buckets) if buckets < 200 else own)
        assert (end - begin).sum() == len(keys)


def test_rows_of_packed_lists_grow_with_the_input():
    """Chunks times buckets, bounded by the keys: a row for 64 keys and more
    up to terabytes, never more rows than keys beyond."""
    from ledgerlens.llm import exchange as E
    for size in (1 << 26, 1 << 30, 1 << 35, 1 << 40):
        chunk, bucket = E.sizes(size)
        assert (size / chunk) * (size / bucket) <= size / E.BYTES_A_KEY / E.KEYS_A_ROW or chunk == E.CHUNK_BYTES
        assert chunk <= E.MOST_BYTES and bucket <= E.MOST_BYTES
    per_byte = [(s / E.sizes(s)[0]) * (s / E.sizes(s)[1]) / s for s in (1 << 39, 1 << 40, 1 << 41)]
    assert max(per_byte) <= 1.01 * min(per_byte)


def _chunks(spark, rows, monkeypatch, chunk_bytes):
    from ledgerlens.llm import exchange as E
    monkeypatch.setattr(E, "sizes", lambda n: (chunk_bytes, chunk_bytes))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    layout = E.Layout(df, "doc_id", "text")
    return E.dealt(df, "text", layout.place).select("doc_id", "text", E.CHUNK, E.RANK).collect()


def test_chunks_are_even_in_bytes(spark, monkeypatch):
    """Long texts among short ones, a third of the rows under one id, equal rows:
    no chunk is much larger than wanted, order of ids is kept."""
    long = [(i * 50, "y" * 4000) for i in range(20)]
    rows = [(i, "x" * 40) for i in range(1000)] + long + [(500, f"hot {i % 7} " + "z" * 60) for i in range(700)]
    got = _chunks(spark, rows, monkeypatch, 4000)
    assert sorted((r.doc_id, _text(r.text).decode()) for r in got) == sorted(rows)
    held = collections.Counter()
    ranks = collections.defaultdict(set)
    for r in got:
        held[r[2]] += len(_text(r.text))
        ranks[r.doc_id].add(r[3])
    assert max(held.values()) <= 3 * 4000 and len({r[2] for r in got if r.doc_id == 500}) >= 8
    assert all(len(v) == 1 for v in ranks.values())                       # chunks of one id have one rank
    order = [min(ranks[i]) for i in sorted(ranks)]
    assert order == sorted(order)


def _text(packed):
    import zstandard
    return zstandard.ZstdDecompressor().decompress(bytes(packed))


def test_substring_dedup_with_hot_and_missing_ids(spark, monkeypatch):
    """A third of the rows without an id, a third under one id, a few huge
    texts, many chunks: equal to brute force."""
    from ledgerlens.llm import exchange as E
    from ledgerlens.llm import substrings
    monkeypatch.setattr(E, "sizes", lambda n: (3000, 3000))
    rng = random.Random(9)
    make = lambda n: " ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(n))
    passage = make(20)
    rows = [(None, passage + " " + make(5)) for _ in range(60)]
    rows += [(30, make(10) + " " + passage + " " + make(rng.randint(0, 5))) for _ in range(60)]
    rows += [(i, make(15) + (" " + passage if i % 5 == 0 else "") + " " + make(4)) for i in range(60)]
    rows += [(100 + i, make(2500)) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = t.split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k:k + 13]), i)
    want = collections.Counter()
    for i, t in rows:
        w, gone = t.split(), set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k:k + 13])] < i:
                gone.update(range(k, k + 13))
        want[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, " ".join(r.text.split()))
                              for r in substrings.remove_repeats(df).collect())
    assert got == want


def test_katz_scores_do_not_depend_on_the_chunks(spark, docs, monkeypatch):
    """Many small chunks and buckets, most of them without a key, and a third of
    the rows equal: the same scores as in one chunk."""
    from ledgerlens.llm import exchange as E
    from ledgerlens.llm import katz
    same = spark.createDataFrame([(7, "w1 w2 w3 hot", "s", "k", "i", "t", "n", "f")] * 40, docs.schema)
    df = docs.unionAll(same).withColumn("train", F.coalesce(F.col("doc_id") % 5 != 1, F.lit(True)))
    scores = lambda: sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.score, 9), r.text or "")
                            for r in katz.score(df, "train", order=3).collect())
    one = scores()
    monkeypatch.setattr(katz, "sizes", lambda n: (-(-n // 17), -(-n // 500)))
    assert scores() == one


def test_quality_cascade(spark, docs, rows, none):
    from ledgerlens.llm import quality
    costs = quality.rule_costs(docs)
    assert set(costs) == set(quality.RULES) and all(0 <= s <= 1 for _, s in costs.values())
    one = quality.cascade(docs, measures=True).drop("text", "source", "ids", "taken", "fp").collect()
    other = quality.cascade(docs, order=list(quality.RULES)[::-1]).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.kept)
    assert [key(r) for r in sorted(one, key=key)] == [key(r) for r in sorted(other, key=key)]
    texts = {r[0]: (r[1] or "") for r in rows if r[0] is not None}
    for r in one:
        if r.doc_id is None:
            continue
        w = texts[r.doc_id].encode().split()
        win = collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        cov = {k + j for k in range(len(w) - 4) if win[tuple(w[k:k + 5])] > 1 for j in range(5)}
        lines = [x for x in texts[r.doc_id].split("\n") if x.strip(" \t\r\x0b\x0c")]
        assert (r.n_words, r.word_chars) == (len(w), sum(len(x.decode()) for x in w))
        assert r.n_symbols == sum(texts[r.doc_id].count(c) for c in "#*$%&|<>")
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == len(cov)
        assert r.base_failed == (len(w) < 10 or 100 * len(cov) > 20 * len(w))
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in one if r.kept}
    assert kept and not kept & {i for i, t in texts.items() if "***" in t or t.startswith("spam")}
    assert quality.filter_quality(docs).columns == docs.columns and quality.filter_quality(none).count() == 0


def _fingerprint(text):
    import xxhash
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _groups(fps, bits):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    fl = list(parent)
    a = np.array(fl, np.uint64)
    for i in range(len(fl)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= bits):
            x, y = find(fl[i]), find(fl[i + 1 + j])
            parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fl}


@pytest.mark.parametrize("hot", [1000, 8, 1])               # all fingerprints are joined as frequent ones, some, none
def test_simhash_components(spark, docs, rows, none, hot, monkeypatch):
    from ledgerlens.llm import simhash
    monkeypatch.setattr(simhash, "HOT", hot)
    fps = [_fingerprint(r[1]) for r in rows]
    root = _groups(fps, 4)
    low = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            low[root[f]] = min(low.get(root[f], r[0]), r[0])
    want = collections.Counter((r[0], f, low.get(root[f])) for r, f in zip(rows, fps))
    got = collections.Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.keep_one(docs).collect()
    lone = {f for f in fps if root[f] not in low}           # nothing in the group has an id
    assert collections.Counter(r.doc_id for r in kept) == collections.Counter([*low.values(), *[None] * len(lone)])
    assert simhash.near_duplicates(none).count() == 0


def test_one_row_of_each_group_stays(spark):
    from ledgerlens.llm import simhash
    rng = random.Random(9)
    make = lambda: " ".join("w%d" % rng.randint(0, 9999) for _ in range(400))
    a, b, c, e = make(), make(), make(), make()
    near = lambda t: next(x for k in range(400) if (x := " ".join(t.split()[:-1] + [f"z{k}"]))
                          and 0 < (_fingerprint(x) ^ _fingerprint(t)).bit_count() <= 4)
    near_b, near_c = near(b), near(c)
    # 1: two texts under one id; 2: near to one of them; no id: linked copies; 5: repeated rows
    data = [(1, a), (1, b), (2, near_b), (2, near_b), (None, c), (None, c), (None, near_c), (5, e), (5, e), (6, None), (7, "")]
    got = simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    lone = min((c, near_c), key=lambda t: _fingerprint(t) - (_fingerprint(t) >> 63 << 64))
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(
        [(1, a), (1, b), (None, lone), (5, e), (6, None)])


def test_vantage_point_links_are_exact(spark):
    from ledgerlens.llm import simhash
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    near = base[:600].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)
    crowd = np.array([base[0] ^ np.uint64(1 << i) ^ np.uint64(1 << j) for i in range(64) for j in range(i)], np.uint64)
    points = np.unique(np.concatenate([base, near, crowd]))
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long").repartition(4)
    labels = {r.node % 2**64: r.root % 2**64
              for r in simhash.components(simhash.links(df, shard_points=256)).collect()}
    want = _groups([int(x) for x in points], 4)
    groups = collections.defaultdict(set)
    for x, r in want.items():
        groups[r].add(labels.get(x, x))
    assert all(len(v) == 1 for v in groups.values())
    assert len({next(iter(v)) for v in groups.values()}) == len(groups)


def test_sharding(spark, docs, rows, none):
    from ledgerlens.llm import sharding
    hot = spark.createDataFrame([(1000 + i, "hot text", None, "", "", "", "", "") for i in range(60)], DDL)
    got = sharding.shard_documents(docs.unionByName(hot), 8).collect()
    texts = [(r[0], r[1]) for r in rows] + [(1000 + i, "hot text") for i in range(60)]
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    counts = collections.Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    where = collections.defaultdict(set)
    text_of = dict(x for x in texts if x[0] is not None)
    for r in got:
        if r.doc_id is not None:
            where[text_of[r.doc_id]].add(r.shard)
    assert all(len(v) == 1 for t, v in where.items() if t != "hot text")
    assert len(where["hot text"]) <= 5                      # 60 rows, shards of 18: four at least
    assert sharding.shard_documents(none, 8).count() == 0


def test_word_keys_tell_words_apart():
    from ledgerlens.llm import katz
    rng = random.Random(4)
    docs = ["", " \n ", "One one ONE", "\u00c9t\u00e9 \u00e9t\u00e9", "x" * 40 + " " + "x" * 41, "a\x00b a\x00 \x00"]
    docs += [" ".join("".join(rng.choice("ab\x01\u00e9Z") for _ in range(rng.randint(1, 36))) for _ in range(400))
             for _ in range(30)]
    keys, counts = katz.word_keys([d.encode() for d in docs])
    words = [w for d in docs for w in d.encode().lower().split()]
    assert counts.tolist() == [len(d.encode().split()) for d in docs] and len(keys) == len(words)
    assert len(set(zip(words, keys.tolist()))) == len(set(words)) == len(set(keys.tolist()))
    assert [len(x) for x in katz.word_keys([])] == [0, 0]


def test_katz_scores(spark, docs, rows, none):
    from ledgerlens.llm import katz
    flagged = docs.withColumn("train", F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    got = collections.defaultdict(list)
    for r in katz.score(flagged, "train").collect():
        got[r.doc_id].append(r)
    toks = [(r[0], [*(r[1] or "").encode().lower().split(), None]) for r in rows]
    c, b = collections.Counter(), collections.Counter()
    for i, t in toks:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(t)
            b.update(zip(["start", *t[:-1]], t))
    n, v = sum(c.values()), len(c)
    d = katz.discounts(np.array([0] + [sum(x == r for x in b.values()) for r in range(1, 7)]))
    base = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    seen, spread, total = collections.Counter(), collections.Counter(), collections.Counter()
    for (h, w), k in b.items():
        seen[h] += (d[k] if k <= 5 else 1) * k
        spread[h] += base(w)
        total[h] += k

    def p(h, w):
        if not total[h]:
            return base(w)
        z = total[h] if total[h] - seen[h] > 1e-9 * total[h] else total[h] + 1
        k = b[h, w]
        return (d[k] if k <= 5 else 1) * k / z if k else (1 - seen[h] / z) / (1 - spread[h]) * base(w)

    for h in ("start", b"w1", b"w250"):                     # exactly normalised
        assert abs(sum(p(h, w) for w in c) + p(h, b"never seen") - 1) < 1e-9
    for i, t in toks:
        if i is None:
            continue
        r = got[i][0]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10(base(w)) for w in t))
        assert r.score == pytest.approx(sum(math.log10(p(h, w)) for h, w in zip(["start", *t[:-1]], t)))
    assert katz.score(none.withColumn("train", F.lit(True)), "train").count() == 0
    untrained = katz.score(docs.withColumn("train", F.lit(None).cast("boolean")), "train")
    assert untrained.where("n_known > 0 OR score <> base_score").count() == 0


def test_katz_backs_off_through_all_orders(spark, docs, rows, tmp_path):
    from ledgerlens.llm import katz
    flagged = docs.withColumn("train", F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    toks = [(r[0], [*(r[1] or "").encode().lower().split(), None]) for r in rows]
    on = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    for order in (3, 4):
        folder = str(tmp_path / f"counts{order}")
        got = {r.doc_id: r for r in katz.score(flagged, "train", order=order, tables=folder).collect()}
        c = [collections.Counter() for _ in range(order + 1)]
        for i, t in toks:
            padded = ["start"] * (order - 1) + t
            for k in range(order - 1, len(padded) if on(i) else 0):
                for n in range(1, order + 1):
                    c[n][tuple(padded[k - n + 1:k + 1])] += 1
        written = collections.defaultdict(list)
        for r in spark.read.parquet(folder).collect():
            written[r.n].append(r["count"])
        for n in range(1, order + 1):
            assert sorted(written[n]) == sorted(c[n].values())
        d = [katz.discounts(np.array([0] + [sum(x == r for x in b.values()) for r in range(1, 7)])) for b in c]
        n_all, v = sum(c[1].values()), len(c[1])
        after = collections.defaultdict(list)
        for b in c[2:]:
            for g in b:
                after[g[:-1]].append(g[-1])

        def direct(h, w):
            own = [c[len(h) + 1][*h, x] for x in after[h]]
            held = sum((1 - d[len(h) + 1][k]) * k for k in own if k <= 5)
            z = sum(own) + (held <= 1e-9 * sum(own))
            k = c[len(h) + 1][*h, w]
            return (d[len(h) + 1][k] if k <= 5 else 1) * k / z

        def p(h, w):
            if not h:
                return (c[1][w,] + 0.5) / (n_all + 0.5 * (v + 1))
            if not after[h]:
                return p(h[1:], w)
            if c[len(h) + 1][*h, w]:
                return direct(h, w)
            if h not in alpha:
                alpha[h] = (1 - sum(direct(h, x) for x in after[h])) / (1 - sum(p(h[1:], x) for x in after[h]))
            return alpha[h] * p(h[1:], w)

        alpha = {}
        for h in (("start", "start"), ("start", b"spam"), (b"w1", b"w250"), (b"spam", b"spam"), (b"line", b"here")):
            assert abs(sum(p(h, w) for (w,) in c[1]) + p(h, b"never seen") - 1) < 1e-9
        for i, t in toks:
            if i is not None:
                padded = ["start"] * (order - 1) + t
                want = sum(math.log10(p(tuple(padded[k - order + 1:k]), padded[k])) for k in range(order - 1, len(padded)))
                assert got[i].score == pytest.approx(want), (order, i)


def test_mixing(spark, docs, rows, none):
    from ledgerlens.llm import mixing
    got = mixing.mix(docs).collect()
    size = lambda t: len((t or "").encode().split())
    own = collections.Counter()
    for r in rows:
        own[r[2]] += size(r[1])
    order = sorted(own, key=lambda s: (s is None, s or ""))
    quota = dict(zip(order, mixing.targets([own[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])))
    taken = collections.Counter()
    for r in got:
        assert r.size == size(r.text) and 0 <= r.taken <= 2 * r.size and r.source_size == own[r.source]
        assert r.target == pytest.approx(quota[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - quota[s]) <= 1 for s in order)
    assert sum(quota.values()) == pytest.approx(1.5 * sum(own.values()))
    again = collections.Counter((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5)).collect())
    assert again == collections.Counter((r.doc_id, r.taken) for r in got)
    assert mixing.mix(none).count() == 0
    assert mixing.repeat_rows(mixing.mix(docs), docs.columns).columns == docs.columns


def test_mixing_of_rows_without_an_id_can_be_repeated(spark):
    from ledgerlens.llm import mixing
    rng = random.Random(5)
    table = [(None if k % 2 else 7, "s", f"t{k} " + "word " * rng.randint(0, 40), "k") for k in range(600)]
    df = spark.createDataFrame(table, "doc_id long, source string, text string, kept string")
    runs = []
    for parts in (1, 3, 7):
        rng.shuffle(table)
        df = spark.createDataFrame(table, df.schema).repartition(parts)
        runs.append(collections.Counter((r.text, r.taken) for r in mixing.mix(df).collect()))
    assert runs[0] == runs[1] == runs[2]
    order = df.select(mixing.seeded_order("doc_id", 11, F.xxhash64("text")).alias("o"))
    assert order.distinct().count() == len(table)           # no block or window task holds all of them


def test_flow_over_overlapping_sources():
    from ledgerlens.llm import mixing
    # b can be served by the overlap only; a first uses its own documents once
    flow = mixing.min_cost_flow({"a": 10, "ab": 10}, {"a": ["a"], "ab": ["a", "b"]}, {"a": 10, "b": 15})
    assert flow == {("a", "a"): 10, ("ab", "b"): 15}
    assert mixing.targets([10, 100], [1, 1], share=1.0) == [20.0, 90.0]
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0]


def test_flow_is_the_largest_and_cheapest_of_all():
    """Small overlapping sources: the routed words and their cost equal the best
    of every possible routing."""
    import itertools

    from ledgerlens.llm import mixing
    rng = random.Random(12)
    for _ in range(40):
        members = {"a": ["a"], "ab": ["a", "b"], "b": ["b"]}
        sizes = {p: rng.randint(0, 3) for p in members}
        quotas = {"a": rng.randint(0, 6), "b": rng.randint(0, 6)}
        ways = [(p, s) for p in members for s in members[p]]

        def cost(flow):
            total = {p: sum(v for (q, _), v in flow.items() if q == p) for p in sizes}
            if any(total[p] > 2 * sizes[p] for p in sizes) or any(
                    sum(v for (_, t), v in flow.items() if t == s) > quotas[s] for s in quotas):
                return None
            return -sum(total.values()), sum(min(t, sizes[p]) + 2 * max(0, t - sizes[p]) for p, t in total.items())

        every = (cost(dict(zip(ways, v))) for v in itertools.product(*[range(2 * sizes[p] + 1) for p, _ in ways]))
        assert cost(mixing.min_cost_flow(sizes, members, quotas, 2)) == min(c for c in every if c)


def test_sharding_cuts_as_few_links_as_possible(spark):
    """Tiny tables: no more than one link more than the best even placement."""
    import itertools

    from ledgerlens.llm import sharding
    for groups in ([3, 2, 1, 1, 1], [5, 2, 1]):
        rows = [(10 * g + i, f"text {g}") for g, n in enumerate(groups) for i in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        # a column named like one of the result's is not read
        got = sharding.shard_documents(df.withColumn("shard", F.lit("x")), 2)
        report = sharding.cut_links(got.join(df, "doc_id"), "text").first()

        def cut(where):
            parts = collections.Counter((t, w) for (_, t), w in zip(rows, where))
            return sum(n - max(parts[f"text {g}", 0], parts[f"text {g}", 1]) for g, n in enumerate(groups))

        best = min(cut(w) for w in itertools.product((0, 1), repeat=len(rows)) if sum(w) == len(rows) // 2)
        assert report.groups == len(groups) and best <= report.cut_links <= best + 1


def test_slices_that_a_worker_keeps_are_bounded(vocab):
    from ledgerlens.llm import bpe
    enc = bpe.Encoder(vocab, most=3000)
    for k in range(200):
        enc.encode(["%x" % (k * 7919 + 10 ** 9) * 3, "y" * 5000 + str(k)])
        assert all(len(piece) <= enc.LONGEST for piece in enc)
        assert enc.held <= 3000 + 1000 * enc.ENTRY and (enc.held > 0 or not enc)
    ref = _tiktoken(vocab)
    text = "z" * 3000 + " again " * 50
    assert enc.encode([text])[0].tolist() == ref.encode_ordinary(text)


def test_one_of_equal_rows_stays_whatever_the_partitions(spark):
    """Rows of equal id and text but other columns: always the same one."""
    from ledgerlens.llm import simhash
    rows = [(1, "the same text of these rows here", f"s{i}") for i in range(30)] + [(2, "quite another text of one row", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [sorted(map(tuple, simhash.keep_one(df.repartition(n)).collect())) for n in (1, 5)]
    assert got[0] == got[1] and [r[0] for r in got[0]] == [1, 2]


def test_neighbours(spark):
    from ledgerlens.llm import neighbours
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    x[100:160] = x[100]                                     # a common vector, all ties
    table = [(i, v.tolist()) for i, v in enumerate(x)]
    table += [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [None] * 24), (2004, [1.0]),
              (None, x[3].tolist()), (2020, [float("inf")] * 24)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>").repartition(3)
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), 20, block_rows=400).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    hits, y = 0, x.astype(float)
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(s == pytest.approx(float(y[v] @ y[q]), abs=1e-12) for _, v, s in found)
        score = y @ y[q]
        best = [i for i in np.lexsort((np.arange(1500), -score.round(12))) if i != q][:20]
        hits += len({v for _, v, _ in found} & set(best))
    assert hits / (20 * len(got)) >= 0.9
    assert [v for _, v, _ in got[100]][:19] == list(range(101, 120))
    share = neighbours.nearest(df, df.where("vec_id % 20 = 0"), 20, block_rows=400, counts=True).agg(
        F.sum("n_verified") / F.sum("n_rows"), F.sum("n_rows")).first()
    assert share[0] < 0.6 and share[1] == 75 * 1500          # windows leave vectors out; every row is indexed
    few = spark.createDataFrame(table[:5], "vec_id long, embedding array<float>")
    assert neighbours.nearest(few, few.where("vec_id = 0"), 20).count() == 4
    assert neighbours.nearest(few.where("false"), few, 20).count() == 0


def test_neighbours_of_repeated_rows(spark):
    """A query row that is in the table twice is one query; an id with two
    vectors is two; of a row that repeats often no more than k are candidates."""
    from ledgerlens.llm import neighbours
    rng = np.random.default_rng(7)
    x = rng.standard_normal((120, 8))
    rows = [(i, v.tolist(), "r") for i, v in enumerate(x)]
    rows += [rows[20]] * 3 + [(40, x[41].tolist(), "r")] + [rows[7]] * 300
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string").repartition(3)
    got = neighbours.nearest(df, df.where("vec_id % 20 = 0"), 20, block_rows=100).collect()
    by_query = collections.Counter(r.query_id for r in got)
    assert by_query == {i: 40 if i == 40 else 20 for i in range(0, 120, 20)}
    for i in (20, 60):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i)
        ids, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        want = sorted(((-float(y[j] @ x[i]), ids[j]) for j in range(len(rows)) if ids[j] != i))[:20]
        assert [v for _, v, _ in mine] == [v for _, v in want]
    kept = neighbours._Candidates(3)
    kept.add(np.array([1, 1, 1]), np.zeros((3, 2)))
    kept.add(np.array([1, 1, 2]), np.array([[0, 0], [1, 1], [0, 0]], float))
    assert [len(a) for a in kept.arrays()] == [5, 5]


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a="</p>";</script></head>
<body class="has-sidebar"><header><h2>Site name</h2></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<!-- x --><div class="ad">Buy this now please</div><div id="cookie-notice">We use cookies</div>
<article><h1>The   title</h1><p>First <b>bold</b>text &amp; more&nbsp;words of the <i>article</i>.<br>After break
<div class="ad-box">Advert inside</div><p>Second paragraph with many words in it, as articles have.</p>
<form><input><button>Send</button></form><aside>Aside words</aside>
<section class="comments"><p>I disagree with all of this</p></section></article>
<div class="sidebar"><p>Related things to read</p></div><footer>&copy; someone</footer></body></html>"""


def test_main_text_of_pages(spark):
    from ledgerlens.llm import html
    want = ("The title First boldtext & more words of the article. After break "
            "Second paragraph with many words in it, as articles have.")
    pages = [(1, "u", PAGE, "old"), (2, "u", None, "old"), (3, "u", "", "old"), (4, "u", "<div></div><p", "old"),
             (5, "u", "plain words only", "old"), (5, "u", "plain words only", "old"), (6, "u", "<a 'x" * 2000, "old")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = collections.defaultdict(list)
    for r in html.extract(df).collect():
        got[r.page_id].append(r.text)
    assert got[1] == [want] and got[2] == got[3] == [""] and got[5] == ["plain words only"] * 2
    assert html.extract(df.where("false")).count() == 0
    assert html.main_text(PAGE, html.DEFAULT) == want


def test_best_run_equals_all_intervals():
    from ledgerlens.llm import html
    rng = random.Random(6)
    for _ in range(300):
        values = [rng.choice([-3, -2, -1, -0.5, 0.5, 1, 2]) for _ in range(rng.randint(0, 25))]
        a, b = html.best_run(values)
        every = [sum(values[i:j]) for i in range(len(values) + 1) for j in range(i, len(values) + 1)]
        assert sum(values[a:b]) == pytest.approx(max(every, default=0.0))
        ends = [j for j in range(len(values) + 1) for i in range(j + 1) if sum(values[i:j]) == pytest.approx(max(every))]
        assert not a < b or b == min(ends)                     # ties: the run that ends first


def test_the_scan_leaves_out_containers_that_no_list_knows(spark):
    """Containers with names of their own lie outside of the labelled content;
    what the labels say ends the region, on pages without a label too."""
    from ledgerlens.llm import html
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(n))

    def page(tag, i):
        return (f"<body><div class='zorp'><p>{words(30)} before{i}</p></div><{tag}><h1>T{i}</h1><p>{words(60)}</p>"
                f"<p>{words(50)} end{i}</p></{tag}><div class='blick'><p>{words(25)} after{i}</p></div></body>")

    pages = [(i, page("article" if i % 3 else "section", i)) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, html string").repartition(3)
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    for i, text in got.items():
        assert text.startswith(f"T{i} ") and text.endswith(f"end{i}"), i
    # the list alone keeps them
    weights = {k: 0.0 for k in html.DEFAULT} | {"#word": 1.0}
    assert "before1" in html.main_text(page("article", 1), weights)


def test_very_long_and_deep_pages():
    from ledgerlens.llm import html
    long_page = "<article>" + "<p>some words here</p>" * 40000 + "</article>"
    assert html.main_text(long_page, html.DEFAULT).count("words") == 40000
    deep = "<div class=a>" * 3000 + "<p>inner words of the page</p>" + "</div>" * 3000
    assert html.main_text(deep, html.DEFAULT) == "inner words of the page"


def test_weights_come_from_the_labelled_pages(spark):
    from ledgerlens.llm import html
    some = "<body><p>Some words</p><article><p>Words of a text</p><zz>More words</zz></article></body>"
    several = some + "<aside><article>Card</article></aside>"
    few = [(some if i % 700 == 3 else "<body><p>No label here</p></body>",) for i in range(2000)]
    cards = [(several if i % 700 == 3 else None,) for i in range(2000)]
    for table in (few, cards):
        df = spark.createDataFrame(table, "html string").repartition(4)
        assert "zz" in html.fit_weights(df, labelled_pages=5), table[3]
    assert html.fit_weights(spark.createDataFrame([("<p>x</p>",)], "html string")) == html.DEFAULT


def test_attributes_are_parsed_one_by_one():
    from ledgerlens.llm import html
    kept = ['style="overflow:hidden"', 'title="hidden gems"', "data-x='a id=ad b'", 'href="/p?id=ad"', 'data-id="share"',
            "data-hidden", 'data-class="menu"', 'x-role=banner', "href=/p?class=menu&id=ad", 'alt=" hidden " id=story',
            "title = 'role=\"menu\"'", 'aria-hidden="false"', 'class="story" data-role="navigation"', '/hiddenx']
    gone = ["hidden", "HIDDEN", "hidden=''", 'title="x"hidden', 'aria-hidden="true"', "ID = 'ad-1'", "class=menu", 'role="menu"',
            "id=x/ hidden", "data-x='>' class=\"main menu\"", 'a=1 class="x\nshare"', 'title="a=b" id=\'cookie\'']
    for attrs in kept + gone:
        page = (f"<body><article><h1>Title of it</h1><p>First words of the text</p><div {attrs}><p>Second words in a div</p>"
                "</div><p>Third words of the text</p></article></body>")
        text = html.main_text(page, html.DEFAULT)
        assert ("Second words in a div" in text) == (attrs in kept), attrs
        assert "First words" in text and "Third words" in text, attrs


def test_embedded_elements_end_where_they_end():
    from ledgerlens.llm import html
    want = "Title of it First words of the text Second words of the text Third words of the text"
    for x in ("<svg-icon name=a></svg-icon>", "<title-bar></title-bar>", "<style-guide/>", "<math-field>", "<object-x>",
              "<svg width='1'/>", "<svg/>", "<SVG viewBox='0 0 1 1' />", "<math/>", "<object data='a'/>", "<canvas/>",
              "<svg><g><svg><text>no</text></svg><text>no</text></g></svg>", "<svg><title>no</title><path/></svg>",
              "<svg><title/><style/><text>no</text></svg>", "<svg><path/><svg/><text>no</text></svg>", "<canvas>no</canvas>",
              "<object><object>no</object>no</object>", "<math><mi>no</mi></math>", "<svg>", "<canvas id=c>", "<object>",
              "<script>var no = '<svg>';</script>", "<script >no</script>", "<style/>no</style>", "<title\n>no</title>"):
        for page in (f"<body>{x}<article><h1>Title of it</h1><p>First words of the text</p>",
                     f"<body><article><h1>Title of it</h1>{x}<p>First words of the text</p>"):
            page += "<p>Second words of the text</p><p>Third words of the text</p></article></body>"
            weights = html.DEFAULT | {"#tag": -0.5, "article": -0.05, "/article": -0.05}
            assert html.main_text(page, weights) == want, page


def test_pipeline_stages(spark, rows, tmp_path):
    import corpus_pipeline as C
    from ledgerlens.llm import quality
    names = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(r[0], r[1], "en", r[2], len(r[1] or "")) for r in rows]
    spark.createDataFrame(data, names).write.parquet(str(tmp_path / "documents.parquet"))
    kept = [r for r in data if not any(f(quality.Measures((r[1] or "").encode())) for f in quality.RULES.values())]
    fps = [_fingerprint(r[1]) for r in kept]
    root, low = _groups(fps, 4), {}
    for r, f in zip(kept, fps):
        if r[0] is not None:
            low[root[f]] = min(low.get(root[f], r[0]), r[0])
    stages, docs_ = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, f) in enumerate(C.STAGES):
        f(spark, docs_, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs_ = spark.read.parquet(str(tmp_path / name))
        stages.append(docs_)
        if k < 4:
            assert docs_.dtypes == spark.createDataFrame([], names).dtypes, name
    assert stages[0].count() == len(kept)
    lone = {f for r, f in zip(kept, fps) if root[f] not in low}
    assert collections.Counter(r.doc_id for r in stages[1].collect()) == collections.Counter(
        [*low.values(), *[None] * len(lone)])
    seen = set()
    for r in sorted((r for r in stages[2].collect() if r.doc_id is not None), key=lambda r: r.doc_id):
        w = r.text.split()
        assert r.n_chars == len(r.text)
        seen |= {tuple(w[k:k + 13]) for k in range(len(w) - 12)}
    copies = collections.Counter(r.doc_id for r in stages[3].collect())
    assert copies and max(v for i, v in copies.items() if i is not None) <= 2
    ref = _tiktoken(C.vocabulary())
    assert all(r.ids == ref.encode_ordinary(r.text or "") for r in stages[4].collect())
    digest = lambda df: sorted(hashlib.md5(repr(r).encode()).hexdigest() for r in df.collect())
    assert digest(C.run(spark, str(tmp_path)).select("doc_id", "text")) == digest(stages[4].select("doc_id", "text"))


def test_queries_are_registered():
    import __spark_entry__ as E
    names = E.queries()
    assert sum(n.startswith("op") and n[2].isdigit() for n in names) == 13 and "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)}
