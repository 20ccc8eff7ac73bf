"""The first ten operators against brute force, exact round trips or held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.llm import embedding_dedup, minhash, mixing, pieces, queries, simhash, suffix_dedup, token_file, toxicity, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, source=lambda k: f"s{k % 3}"):
    return spark.createDataFrame([(k, t, "en", source(k), len(t or "")) for k, t in enumerate(texts)], DOCS)


ODD = [None, "", "   ", "one", "one", "é\u4e2d😀 \x00 tab\t", "a" * 3000, "word " * 2000, "▁▁ a  b \n\n c ", "<|endoftext|> x"]


def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [(k, t, None if k % 2 else "s", k) for k, t in enumerate(ODD)]
    rows += [rows[3], rows[3], (None, "one", None, 0), (None, "null id", "s", 1), (3, "other text", None, 2)]
    df = spark.createDataFrame([(a, t, "en", s, n, "x", n, n) for a, t, s, n in rows], DOCS + ", key string, copies int, begin int")
    return df


# 1 ------------------------------------------------------------------------------------------------


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    grams = [tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []
    return {g: 1 + int(math.log2(n)) for g, n in Counter(grams).items()}


def likeness(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys) if keys else 1.0


def classes_of(sets, least=0.8):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if likeness(sets[i], sets[j]) >= least:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(k) for k in range(len(sets))]


def near_texts(seed=5):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [[r.choice(vocabulary) for _ in range(r.randrange(30, 200))] for _ in range(12)]
    out = [" ".join(w) for w in base]
    for w in base[:6]:
        for share in (0.0, 0.01, 0.03, 0.1, 0.5):
            out.append(" ".join(x if r.random() >= share else "zz" for x in w))
    return [*out, "", None, "tiny text", "Tiny  text!"]


def test_signature_estimates_weighted_jaccard():
    texts = [t for t in near_texts() if t][:30]
    text, shingle, weight = minhash.weighted_shingles(texts)
    signed = minhash.signatures(text, shingle, weight, len(texts), 512)
    for a, b in [(0, 12), (0, 13), (0, 14), (0, 15), (0, 16), (1, 2)]:
        assert abs((signed[a] == signed[b]).mean() - likeness(shingles(texts[a]), shingles(texts[b]))) < 0.09


def test_near_duplicates_match_brute_force(spark):
    texts = near_texts()
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == classes_of([shingles(t) for t in texts])
    kept = minhash.drop_near_duplicates(docs(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values())) and kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")


def test_large_bucket_keeps_links(spark):
    r = random.Random(2)
    base = [f"v{k}" for k in range(120)]
    texts = [" ".join(base[:110] + [f"u{n}x{k}" for k in range(10)]) for n in range(90)] + [" ".join(r.sample(base, 60)) for _ in range(5)]
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == classes_of([shingles(t) for t in texts])


def template_group(n=2500, planted=250, seed=4):
    """Texts of one template that are mostly not similar, and copies of some with similarities around 0.8."""
    r = random.Random(seed)
    base = [f"v{k}" for k in range(100)]
    own = [[f"u{x}x{k}" for k in range(30)] for x in range(n)]
    texts = [base + o for o in own]
    for x in range(planted):
        copy = texts[x] + []
        for k in r.sample(range(100, 130), 1 + x % 4):
            copy[k] = f"c{x}x{k}"
        texts.append(copy)
    return [" ".join(t) for t in texts]


def classes_by_matrix(texts, least=0.8):
    """classes_of for many texts whose shingles all have weight one."""
    sets = [list(shingles(t)) for t in texts]
    seen = Counter(g for s in sets for g in s)
    number = {g: k for k, g in enumerate(g for g, n in seen.items() if n > 1)}
    held = np.zeros((len(sets), len(number)), np.float32)
    for k, s in enumerate(sets):
        held[k, [number[g] for g in s if g in number]] = 1
    both = held @ held.T
    size = np.array([len(s) for s in sets])
    root = list(range(len(sets)))
    for a, b in np.argwhere(np.triu(both >= least * (size[:, None] + size - both) - 1e-6, 1)).tolist():
        low, high = sorted((root[a], root[b]))
        root = [low if x == high else x for x in root]
    return root


def test_template_group_keeps_every_link(spark):
    texts = template_group()
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(docs(spark, texts)).collect()}
    want = classes_by_matrix(texts)
    assert 2500 < len(set(want)) < 2700
    assert [got[k] for k in range(len(texts))] == want


# 2 ------------------------------------------------------------------------------------------------


def water(sizes, weights):
    total, target, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while free:
        share = {k: left * weights[k] / sum(weights[j] for j in free) for k in free}
        full = {k for k in free if share[k] > 3 * sizes[k]}
        if not full:
            for k in free:
                target[k] = share[k]
            return target
        for k in full:
            target[k] = 3.0 * sizes[k]
            left -= target[k]
        free -= full
    return target


def test_mix(spark):
    r = random.Random(1)
    sizes = {"a": 3000, "b": 500, "c": 40_000, None: 9000}
    rows = [(k, " ".join("w" for _ in range(n // 25)), s) for s, n in sizes.items() for k in range(25)]
    r.shuffle(rows)
    df = spark.createDataFrame([(k, t, s) for k, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    out = mixing.mix(df, shard_words=8000).collect()
    again = mixing.mix(df, shard_words=8000).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    total = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in sizes}
    target = dict(zip(sizes, water(list(total.values()), [5, 2, 1, 5]), strict=True))
    taken = defaultdict(int)
    for x in out:
        assert x.source_size == total[x.source] and abs(x.target - target[x.source]) < 1e-6 and x.taken <= 3 * x.size
        taken[x.source] += x.taken
    assert all(abs(taken[s] - target[s]) <= 130 for s in sizes)


def test_quotas_of_many_sources(spark):
    """Targets and quotas of sources, in distributed passes, against one quotient at a time; equal quotients too."""
    r = np.random.default_rng(8)
    for sizes in ([10] * 7, [0, 0, 5], r.integers(1, 1000, 40).tolist(), [1] * 30 + [100_000], (r.pareto(1.0, 200) * 50).astype(int).tolist()):
        df = spark.createDataFrame([(k, f"{k:04d}", int(n)) for k, n in enumerate(sizes)], "doc_id long, source string, size long")
        sources = mixing.source_targets(df)
        want = water(sizes, [[5, 2, 1][k % 3] for k in range(len(sizes))])
        rows = {x.place: x for x in sources.collect()}
        assert np.allclose([rows[k].target for k in range(len(sizes))], want) and [rows[k].source_size for k in range(len(sizes))] == sizes
        votes = [rows[k].target for k in range(len(sizes))]
        for seats in (1, 17, 400):
            got = {x.place: x.quota for x in mixing.source_quotas(sources, seats).collect()}
            assert [got[k] for k in range(len(sizes))] == mixing.sainte_lague(np.array(votes), seats).tolist()


def test_sainte_lague():
    r = np.random.default_rng(3)
    for _ in range(30):
        votes, seats = r.integers(1, 1000, r.integers(1, 9)), int(r.integers(0, 60))
        want = np.zeros(len(votes), int)
        for _ in range(seats):
            want[np.argmax(votes / (2 * want + 1))] += 1
        assert mixing.sainte_lague(votes, seats).tolist() == want.tolist()


# 3 ------------------------------------------------------------------------------------------------


def repeats(texts):
    seen = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    out = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                mask[k : k + 200] = True
        out.append(mask)
    return out


@pytest.mark.parametrize("most", [2048, 2])
def test_repeats_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_KINDS", most)
    r = random.Random(3)
    rnd = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    p, q = rnd(260), rnd(900)
    texts = [rnd(400) + p + rnd(200), p + rnd(9), rnd(50) + q[100:600] + rnd(80), q, "a" * 350, "ab" * 160, rnd(150), "", q[:200], q, rnd(40) * 8, rnd(300) + "xyz" * 90]
    texts += [rnd(r.randrange(300)) + q[a : a + r.randrange(180, 420)] + rnd(r.randrange(200)) for a in range(0, 500, 60)]
    got = {x.doc_id: x for x in suffix_dedup.repeat_digest(docs(spark, [*texts, None])).collect()}
    data = [t.encode() for t in texts]
    for k, (t, m) in enumerate(zip(data, repeats(data), strict=True)):
        runs = int(m[0]) + int((m[1:] & ~m[:-1]).sum()) if len(m) else 0
        assert tuple(got[k])[1:] == (len(t), int(m.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~m])).hexdigest())
    assert got[len(texts)].n_bytes == 0


@pytest.mark.parametrize("gram", [100, 150, 200])
def test_slices_and_cut_runs_hold_every_window(gram):
    r = random.Random(gram)
    texts = [bytes(r.choice(b"ab") for _ in range(n)) for n in (3000, 150, 200, 701, 0)] + [b"a" * 2500, b"xyz" * 400]

    def windows(pieces, most):
        found = suffix_dedup.anchored_runs([p for _, _, p in pieces], gram, most)
        for t, anchor, begin, n in zip(*(found[c].tolist() for c in ("text", "anchor", "begin", "windows")), strict=True):
            assert n <= most
            yield from ((pieces[t][0], pieces[t][1] + begin + k, anchor) for k in range(n))

    whole = list(windows([(k, 0, t) for k, t in enumerate(texts)], 10**9))
    assert len(whole) == sum(max(0, len(t) - 199) for t in texts)
    small = [w for group in suffix_dedup.sliced(texts, 700) for w in windows(group, 90)]
    assert sorted(small) == sorted(whole)


def test_hot_anchors_and_long_runs_match_brute_force(spark, monkeypatch):
    """Anchors that are hot by bytes, runs of one letter of many lengths."""
    monkeypatch.setattr(suffix_dedup, "MOST_BYTES", 900)
    r = random.Random(13)
    rnd = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    q = rnd(900)
    texts = [rnd(2000) + q + rnd(1500), rnd(690) + q + rnd(10), "a" * 5000, "a" * 199, "a" * 200, "ab" * 900 + rnd(500)]
    texts += ["a" * n for n in range(201, 1000, 97)] + [rnd(150) + q[200:500] + rnd(150) for _ in range(12)]
    got = {x.doc_id: x for x in suffix_dedup.repeat_digest(docs(spark, texts)).collect()}
    for k, (t, m) in enumerate(zip([t.encode() for t in texts], repeats([t.encode() for t in texts]), strict=True)):
        runs = int(m[0]) + int((m[1:] & ~m[:-1]).sum())
        assert tuple(got[k])[1:] == (len(t), int(m.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~m])).hexdigest()), k


def test_windows_of_crowded_snippets_match_brute_force(spark):
    """Windows that are repeated in a snippet, a task, across tasks or by a snippet's own count, and windows that are not."""
    r = random.Random(31)
    rnd = lambda n: bytes(r.choice(b"abcdefgh") for _ in range(n))
    q = rnd(700)
    snippets = [rnd(r.randrange(90)) + q[a : a + r.randrange(150, 400)] + rnd(r.randrange(90)) for a in range(0, 400, 8)]
    snippets = [x + rnd(200) for x in snippets[:10]] + [x for x in snippets[10:] if len(x) >= 200] + [b"ab" * 300, b"a" * 200, b"a" * 201, rnd(200), rnd(450), rnd(300)]
    times = [2 if k % 17 == 3 else 1 for k in range(len(snippets))]
    seen = Counter(t[k : k + 200] for t, n in zip(snippets, times, strict=True) for k in range(len(t) - 199) for _ in range(n))
    want = {}
    for k, t in enumerate(snippets):
        mask = np.zeros(len(t), bool)
        for at in range(len(t) - 199):
            mask[at : at + 200] |= seen[t[at : at + 200]] > 1
        if mask.any():
            want[b"%d" % k] = mask.tolist()
    rows = [(bytearray(b"%d" % k), bytearray(t), n) for k, (t, n) in enumerate(zip(snippets, times, strict=True))]
    df = spark.createDataFrame(rows, "snippet binary, data binary, times long")
    for parts in (1, 4, len(rows)):
        got = {}
        for x in suffix_dedup.repeats_by_window(df.repartition(parts)).collect():
            mask = np.zeros(len(snippets[int(bytes(x.snippet))]), bool)
            for a, n in zip(x.starts, x.sizes, strict=True):
                mask[a : a + n] = True
            assert bytes(x.snippet) not in got
            got[bytes(x.snippet)] = mask.tolist()
        assert got == want and 0 < len(want) < len(rows), parts


def test_windows_of_a_hot_anchor_are_not_rows(spark, monkeypatch):
    """A common passage in different surroundings: no step has a row for each window of each text, and none joins as many."""
    monkeypatch.setattr(suffix_dedup, "MOST_KINDS", 8)
    rows, real = [], suffix_dedup.stored

    def counted(df, label):
        out = real(df, label)
        rows.append((label, out.count()))
        return out

    monkeypatch.setattr(suffix_dedup, "stored", counted)
    r = random.Random(37)
    rnd = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    texts = [rnd(60) + "ab cd " * r.randrange(150, 250) + rnd(60) for _ in range(60)]
    got = {x.doc_id: x for x in suffix_dedup.repeat_digest(docs(spark, texts)).collect()}
    data = [t.encode() for t in texts]
    for k, (t, m) in enumerate(zip(data, repeats(data), strict=True)):
        assert tuple(got[k])[1:3] == (len(t), int(m.sum())) and got[k].kept_sha256 == hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~m])).hexdigest()
    windows = sum(len(t) - 199 for t in data)
    assert sum(label == "hot-anchors" and n > 0 for label, n in rows) == 2 and max(n for _, n in rows) < windows / 4, rows


def test_a_text_of_one_letter_takes_little_memory():
    """25 MB of one letter: slices bound what is held, and all its snippets but the ends are one."""
    import tracemalloc

    text = b"a" * 25_000_000
    tracemalloc.start()
    kinds, windows = set(), 0
    for group in suffix_dedup.sliced([text]):
        found = suffix_dedup.anchored_runs([piece for _, _, piece in group])
        windows += int(found["windows"].sum())
        kinds |= set(found["windows"].tolist())
    (_, peak), _ = tracemalloc.get_traced_memory(), tracemalloc.stop()
    assert windows == len(text) - 199 and len(kinds) <= 3 and peak < 600e6


def test_common_prefixes_are_exact():
    """The merged order and its common prefixes against sorted suffixes."""
    r = random.Random(21)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(200, 420))) for _ in range(9)] * 2
    stream = b"\0".join(texts) + b"\0"
    sizes = np.array([len(t) + 1 for t in texts])
    place = np.arange(len(stream)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    live = (np.repeat(sizes - 1, sizes) - place).astype(np.int32)
    rank = {g: k + 1 for k, g in enumerate(sorted({stream[k : k + 50] for k in range(len(stream)) if live[k] >= 50}))}
    symbol = np.array([rank[stream[k : k + 50]] if live[k] >= 50 else 0 for k in range(len(stream))], np.int32)
    edges = np.append(0, np.cumsum(sizes))[::3]
    built = [suffix_dedup.ShardTransform(symbol[a:b], live[a:b], place[a:b].astype(np.int32), int(a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    suffix, prefix = suffix_dedup.merge_transforms(built)

    def key(at):
        out = []
        while len(out) < 4:
            out.append(int(symbol[at]))
            if live[at] < 50:
                break
            at += 50
        return out + [0] * (4 - len(out))

    keys = [key(at) for at in suffix.tolist()]
    assert sorted(suffix.tolist()) == list(range(len(stream))) and keys == sorted(keys)
    for k in range(1, len(keys)):
        same = next((n for n in range(4) if keys[k][n] != keys[k - 1][n]), 4)
        assert prefix[k] == same or (prefix[k] > same - 1 and 0 in keys[k][: same + 1])


def test_merged_transform_is_sorted():
    r = random.Random(8)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(200, 330))) for _ in range(20)]
    who, start = suffix_dedup.repeated_windows(texts, np.ones(20, np.int64), shards=5)
    seen = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    assert sorted(zip(who.tolist(), start.tolist(), strict=True)) == [(n, k) for n, t in enumerate(texts) for k in range(len(t) - 199) if seen[t[k : k + 200]] > 1]


# 4 ------------------------------------------------------------------------------------------------


def test_fingerprints(spark):
    texts = near_texts()[:40] + ["", None]
    got = {x.doc_id: x for x in simhash.fingerprint_digest(docs(spark, texts)).collect()}
    plain = [t or "" for t in texts]
    order = list(range(len(texts) - 1, -1, -1))
    for at, k in enumerate(order):
        n = plain[order[(at + 1) % len(order)]]
        half = len(plain[k]) // 2
        edited = plain[k][: len(plain[k]) - half] + n[:half]
        assert (got[k].n_chars, got[k].edited_sha256) == (len(plain[k]), hashlib.sha256(edited.encode()).hexdigest())
    same = defaultdict(set)
    for k, t in enumerate(plain):
        same[t].add(got[k].fingerprint)
    assert all(len(v) == 1 for v in same.values())
    long = [k for k in range(12)]
    assert np.mean([got[k].near_edited for k in long]) > np.mean([got[k].near_next for k in long]) + 0.05
    bits = lambda f: int(f, 16)
    for k in range(0, len(texts), 20):
        want = sum(bin(bits(got[k].fingerprint) ^ bits(got[j].fingerprint)).count("1") <= 3 for j in range(len(texts)) if j != k)
        assert got[k].near_rows == want
    assert all(got[k].near_rows is None for k in range(len(texts)) if k % 20)


def plain_prints(spark, texts):
    """The fingerprint of each text, one vote after another; only the terms' hashes are Spark's."""
    import regex

    terms = []
    for t in texts:
        w = [x for x in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if x]
        terms.append([tuple(w[k : k + 3]) + (None,) * (3 - len(w[k : k + 3])) for k in range(max(1, len(w) - 2))] if w else [])
    distinct = list({x for own in terms for x in own})
    h0 = F.xxhash64("a", "b", "c")
    rows = spark.createDataFrame(list(enumerate(distinct)), "k long, t struct<a: string, b: string, c: string>").select("k", "t.*").select("k", h0.alias("h0"), F.xxhash64(h0, F.lit(1)).alias("h1")).collect()
    hashed = {distinct[r.k]: (r.h0 % 2**64) << 64 | r.h1 % 2**64 for r in rows}
    out = []
    for own in terms:
        votes = [0] * 128
        for x in own:
            weight = 1 + min(3, sum(len(p or "") for p in x) // 8)
            for b in range(128):
                votes[b] += weight if hashed[x] >> b & 1 else -weight
        out.append(sum(1 << b for b in range(128) if votes[b] > 0))
    return out


def test_fingerprints_match_brute_force(spark):
    texts = [*near_texts(), "Éa 中文 ÉA, one!", "one two", "a", "a a a a a a a a", " ,. "]
    plain = [t or "" for t in texts]
    edited = []
    for k, t in enumerate(plain):
        half = len(t) // 2
        edited.append(t[: len(t) - half] + plain[k - 1][:half])  # descending ids: the next one is the one before
    own, other = plain_prints(spark, plain), plain_prints(spark, edited)
    like = lambda a, b: 1 - bin(a ^ b).count("1") / 128
    got = {x.doc_id: x for x in simhash.fingerprint_digest(docs(spark, texts)).collect()}
    for k in range(len(texts)):
        x = got[k]
        assert (x.fingerprint, x.edited_fingerprint) == (f"{own[k]:032x}", f"{other[k]:032x}"), texts[k]
        assert abs(x.near_edited - like(own[k], other[k])) < 1e-12 and abs(x.near_next - like(own[k], own[k - 1])) < 1e-12


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 6])
def test_radius_search_finds_all(spark, radius):
    r = random.Random(9)
    prints = [r.getrandbits(128) for _ in range(30)]
    prints += [p ^ sum(1 << b for b in r.sample(range(128), r.randrange(1, 8))) for p in prints for _ in range(3)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(p >> 64), signed(p & (1 << 64) - 1)) for p in prints], "hi long, lo long")
    want = sum(bin(a ^ b).count("1") <= radius for a in set(prints) for b in set(prints))
    assert simhash.within_radius(df, df, radius).count() == want


# 5 ------------------------------------------------------------------------------------------------


def test_embeddings(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 32))
    v = np.concatenate([centres[k % 12] + r.normal(size=32) * s for k, s in enumerate(r.choice([0.05, 0.2, 0.35], 400))] ).reshape(400, 32)
    v[10] = v[22] = v[34]
    labels = [int(k) for k in r.integers(0, 3, 400)]
    rows = [(k, [float(x) for x in v[k].astype(np.float32)], labels[k]) for k in range(400)]
    rows += [(400, None, 1), (401, [0.0] * 32, 1), (402, [float("nan")] * 32, 1), (403, [None] * 32, 1), (404, rows[0][1], None), (405, [], 1), (None, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {x.vec_id: x for x in embedding_dedup.near_vectors(df, shard_rows=40, block_rows=16).collect()}
    u = np.array([x[1] for x in rows[:400]], np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels))
    np.fill_diagonal(linked, False)
    found = sum(got[k].n_links for k in range(400))
    assert linked.sum() * 0.97 <= found <= linked.sum() and all(got[k].n_links <= linked[k].sum() for k in range(400))
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k in (400, 401, 402, 403, 404, 405, None))
    component = np.arange(400)
    for _ in range(400):
        new = np.minimum(component, np.where(linked, component[None, :], 400).min(axis=1))
        if (new == component).all():
            break
        component = new
    assert np.mean([got[k].component_id == component[k] for k in range(400)]) > 0.97


def test_odd_embeddings(spark):
    """Repeated rows, ties, null ids, labels and components, several lengths, clashing column names, an empty table."""
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 1), (4, [1.0, 0.0], None), (None, [1.0, 0.1], 1), (5, None, 1), (6, [0.0, -0.0], 1), (7, [1e308, 1e308], 2), (8, [1e-300, 1e-300], 2), (9, [float("inf"), 1.0], 2)]
    df = spark.createDataFrame([(*r, "x", 0, 0) for r in rows], "vec_id long, embedding array<double>, label int, node string, shard int, n_links int")
    out = embedding_dedup.near_vectors(df)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect()), key=repr)
    want = [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 1, 7, True), (8, 1, 7, False), (9, 0, 9, True), (None, 3, 1, False)]
    assert got == sorted(want, key=repr) and out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_links_do_not_depend_on_shards_and_blocks(spark):
    """One shard and block, or several of each in rounds."""
    r = np.random.default_rng(2)
    v = r.normal(size=(600, 8))
    df = spark.createDataFrame([(k, v[k].tolist(), 1) for k in range(600)], "vec_id long, embedding array<double>, label int")
    one, many, rounds = (sorted(map(tuple, embedding_dedup.near_vectors(df, block_rows=b, shard_rows=s, round_blocks=n).collect())) for b, s, n in ((1024, 32_768, 256), (40, 150, 256), (40, 150, 3)))
    assert one == many == rounds


def clusters(n, side=64, seed=6):
    """Unit vectors of which half lie in clusters of 1 to 300 around the threshold of 0.93."""
    r = np.random.default_rng(seed)
    parts, made = [], 0
    while made < n:
        k = int(r.choice([1, 2, 3, 10, 40, 300]))
        centre = r.normal(size=side)
        parts.append(centre / np.linalg.norm(centre) + r.normal(size=(k, side)) * r.uniform(0.01, 0.04))
        made += k
    v = np.concatenate(parts)[:n]
    return r.permutation(v / np.linalg.norm(v, axis=1, keepdims=True))


def linked_pairs(v, least=0.93):
    return np.argwhere(np.triu(v @ v.T >= least, 1))


def test_walks_find_the_links_of_a_large_shard(monkeypatch):
    """8,000 nodes of one shard: the walks' own recall against brute force, without a comparison with the whole shard."""
    v = clusters(8_000)
    graph = embedding_dedup.Graph(v.astype(np.float32))
    walked, search = [], embedding_dedup.Graph.search
    monkeypatch.setattr(embedding_dedup.Graph, "search", lambda self, q, beam, *a, **k: walked.append(len(q)) or search(self, q, beam, *a, **k))
    q, found = embedding_dedup.matches(graph, v[:1024].astype(np.float32), 0.93)
    want = {(a, b) for a, b in np.argwhere(v[:1024] @ v.T >= 0.93).tolist()}
    got = set(zip(q.tolist(), found.tolist(), strict=True))
    assert walked[0] == 1024 and len(want) > 20_000
    assert len(want & got) >= 0.99 * len(want)


def test_links_of_walked_shards(spark):
    """12,000 vectors of a label in two shards of 6,000: at least 0.99 of all links, none that is none, components from them."""
    v = clusters(12_000)
    df = spark.createDataFrame([(k, x, 1) for k, x in enumerate(v.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df, shard_rows=6_000).collect()}
    pairs = linked_pairs(v)
    want = np.bincount(pairs.reshape(-1), minlength=len(v))
    links = np.array([got[k].n_links for k in range(len(v))])
    assert want.sum() > 200_000 and links.sum() >= 0.99 * want.sum() and (links <= want).all()
    root = list(range(len(v)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert np.mean([got[k].component_id == find(k) for k in range(len(v))]) >= 0.99


def test_graph_survives_packing():
    v = np.random.default_rng(1).normal(size=(700, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = embedding_dedup.Graph(v)
    same = embedding_dedup.unpack_graph(embedding_dedup.pack_graph(graph), v)
    top = np.argsort(-(v[:100] @ v.T), axis=1)[:, :5]
    found, _ = same.search(v[:100], 48)
    assert np.mean([len(set(a) & set(b[:5])) / 5 for a, b in zip(top, found, strict=True)]) > 0.9


# 6 ------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    out = toxicity.judge_toxicity(df, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((out.predicted == 1) & (out.toxic == 1)).sum() / (out.toxic == 1).sum() > 0.9
    assert ((out.predicted == 1) & (out.toxic == 0)).sum() <= 0.01 * len(out)


def test_toxicity_folding():
    assert toxicity.fold("Mоrоn 1d10t st##$ 2024 $5") == " moron idiot st 2024 5 "
    lexicon = toxicity.Lexicon({" clown ": 5.0, " idi": 4.0}, ("clown fish",), 2.0, -2.0)
    assert lexicon.matches(toxicity.fold("A clown fish, an idiot, a CLOWN")) == {lexicon_at: w for lexicon_at, w in zip((16, 24), (4.0, 5.0), strict=True)}
    assert lexicon.score("") == lexicon.score(None) == lexicon.score("fine words") < 0.5 < lexicon.score("you idiot clown")
    assert toxicity.Lexicon().score("anything") < 0.5


def plain_score(lexicon, text):
    """The score by trying every entry at every place."""
    folded = toxicity.fold(text)
    phrases = [toxicity.fold(p) for p in lexicon.exceptions]
    spared = {k for p in phrases for at in range(len(folded)) if folded.startswith(p, at) for k in range(at, at + len(p) - 1)}
    total = 0.0
    for at in (k for k, c in enumerate(folded) if c == " "):  # entries begin with a space
        fits = [w for e, w in lexicon.weights.items() if folded.startswith(e, at)]
        total += max(fits) if fits and at not in spared else 0.0
    words = len(folded.split())
    density = math.log1p(100 * total / max(words, 10)) if total else 0.0
    return 1 / (1 + math.exp(-(lexicon.slope * density + lexicon.offset)))


def test_scores_match_brute_force(spark):
    r = random.Random(7)
    words = ["clown", "clowns", "idiot", "1diot", "id", "fish", "fine", "trash", "can", "idle", "moron", "the", "a", "cl0wn"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 40))) for _ in range(300)] + ["", None, "clown fish", "trash can clown fish idiot"]
    lexicon = toxicity.Lexicon({" clown ": 5.0, " clow": 2.0, " idi": 4.0, " idiot ": 3.0, " moron ": 1.5, " fish ": 0.7}, ("clown fish", "trash can", "fine idiot"), 2.0, -4.0)
    got = {x.doc_id: x for x in toxicity.score_toxicity(docs(spark, texts), lexicon).collect()}
    for k, t in enumerate(texts):
        want = plain_score(lexicon, t)
        assert abs(got[k].score - want) < 1e-12 and got[k].predicted == int(want >= 0.5)
    assert {got[k].predicted for k in got} == {0, 1}


def test_every_significant_term_is_looked_at(spark):
    """A term that many toxic and few harmless documents have, among thousands that three toxic ones alone have."""
    noise = [" ".join(f"n{k}x{j}" for j in range(400)) for k in range(60)]
    toxic = [f"{noise[k // 3]} blockhead" for k in range(180)]
    fine = ["plain words of no harm", *["plain words"] * 2000, *["a blockhead of sorts"] * 60]
    df = docs(spark, [*toxic, *fine])
    labels = spark.createDataFrame([(k, 1, int(k < 180)) for k in range(180 + len(fine))], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit_lexicon(df, labels, entries=20)
    assert any(e.startswith(" block") for e in lexicon.weights) and len(lexicon.weights) <= 20


def test_toxicity_without_labels(spark):
    df = docs(spark, ["a b", None])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.judge_toxicity(df, labels).collect()} == {0}


# 7 ------------------------------------------------------------------------------------------------


def test_archives(spark):
    rows = [(5, "u\r\nx%41", "h"), (3, "v", "h"), (7, None, None), (9, "é", ""), (None, "q", "h"), (8, "z", "t\r\n\r\nWARC/1.1\r\n"), (10, "z", "é" * 70_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = warc.scratch_path(spark, "test")
    warc.archived(df, folder)
    back = {r.page_id: r for r in warc.read_archives(spark, folder).collect()}
    first = {}
    for p, _, h in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        first.setdefault(h or "", p)
    for p, u, h in rows:
        data = (h or "").encode()
        role = ("response", None) if first[h or ""] == p else ("revisit", first[h or ""])
        r = back[p]
        assert (r.target_uri, r.payload_bytes, r.record_type, r.refers_to) == (u, len(data), *role)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r.payload is None if role[0] == "revisit" else bytes(r.payload) == data
    some = warc.read_archives(spark, folder).filter("record_type = 'revisit' and page_id in (5, 9)")
    assert sorted(r.page_id for r in some.collect()) == [5, 9] and "Filter (" not in some._jdf.queryExecution().executedPlan().toString()
    assert warc.archive_digest(df.limit(0)).count() == 0


def test_appends_add_up_and_overwriting_replaces(spark):
    rows = lambda *ids: spark.createDataFrame([(k, " u v ", f"h{k}") for k in ids], "page_id long, url string, html string")
    folder = warc.scratch_path(spark, "test")
    warc.archived(rows(1, 2), folder)
    warc.archived(rows(3), folder)
    back = warc.read_archives(spark, folder).collect()
    assert sorted(r.page_id for r in back) == [1, 2, 3] and {r.target_uri for r in back} == {" u v "}
    fs, path = warc.open_fs(folder)
    other = warc.scratch_path(spark, "foreign")
    fs.create_dir(warc.open_fs(other)[1])
    for f in fs.get_file_info(warc_files(path)):
        if f.base_name.endswith(".gz"):
            fs.copy_file(f.path, f"{warc.open_fs(other)[1]}/{f.base_name}")
    assert sorted(tuple(r) for r in warc.read_archives(spark, other).collect()) == sorted(tuple(r) for r in back)
    again = rows(7, 8).select("page_id", F.col("url").alias("target_uri"), F.encode("html", "utf-8").alias("payload"), F.lit("D").alias("payload_digest"), F.lit(None).cast("long").alias("refers_to"))
    again.write.format("warc").mode("overwrite").save(folder)
    assert sorted(r.page_id for r in warc.read_archives(spark, folder).collect()) == [7, 8]
    fs, path = warc.open_fs(folder)
    assert len(warc.lists_below(fs, path)) == 1 and sum(f.base_name.endswith(".warc.gz") for f in fs.get_file_info(warc_files(path))) <= 2


def warc_files(path):
    from pyarrow.fs import FileSelector

    return FileSelector(path)


class Counting:
    """A file that counts the bytes that are read."""

    def __init__(self, data):
        self.data, self.at, self.n = data, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        out = self.data[self.at : self.at + n]
        self.at, self.n = self.at + len(out), self.n + len(out)
        return out


def test_unwanted_members_are_not_read():
    from pyspark.sql.datasource import EqualTo

    noise = np.random.default_rng(1).bytes(100_000)
    members, data = [], b""
    for k in range(20):
        packed = warc.zlib.compress(warc.record(k, f"u{k}", noise if k % 2 else b"", "D", None if k % 2 else 1), 4, 31)
        members.append(warc.Member(len(data), len(packed), "response" if k % 2 else "revisit", k, None if k % 2 else 1))
        assert warc.Member.of(members[-1].line()[:-1]) == members[-1]
        data += packed

    def read(columns, *filters):
        source = Counting(data)
        reader = warc.WarcReader("", columns, 1)
        assert not list(reader.pushFilters(list(filters)))
        return list(reader.rows(source, members)), source.n

    rows, n = read(["page_id", "payload"], EqualTo(("page_id",), 5))
    assert rows == [(5, noise)] and n == members[5].size
    rows, n = read(["page_id"], EqualTo(("record_type",), "revisit"))
    assert [r[0] for r in rows] == list(range(0, 20, 2)) and n == sum(m.size for m in members[::2])
    rows, n = read(["page_id", "target_uri"])  # headers only: payloads are passed over unread
    assert rows == [(k, f"u{k}") for k in range(20)] and n < 20 * 4096 + 1 and n < len(data) / 10
    rows, n = read(["target_uri"], EqualTo(("target_uri",), "u7"))
    assert rows == [("u7",)] and n < len(data) / 10
    # the same without an index, packed or plain
    for plain in (False, True):
        file = data if not plain else b"".join(warc.zlib.decompress(data[m.offset : m.offset + m.size], 31) for m in members)
        reader = warc.WarcReader("", ["page_id", "payload"], 1)
        list(reader.pushFilters([EqualTo(("page_id",), 5)]))
        assert list(reader.walked(warc.Walk(io.BytesIO(file)))) == [(5, noise)]
        assert len(list(warc.WarcReader("", ["page_id"], 1).walked(warc.Walk(io.BytesIO(file))))) == 20
    rows, n = read(["payload_bytes"])
    assert [r[0] for r in rows] == [100_000 if k % 2 else 0 for k in range(20)] and n == len(data)


# 8 ------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library_without_dropout():
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["Hello world", " lead", "two  gaps   here ", "tab\tline\nbreak\n\nend\n", "é漢字😀 naïve", "1,2.3?!", "x" * 500, "", "aaaa bbbb aaaa"]
    own = pieces.Encoder(path, 0.0, 1, 1)
    ids, n = own.encode(texts, np.zeros(len(texts), np.uint64))
    ends = np.concatenate([[0], np.cumsum(n)])
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == library.encode(t)


def scrambled(x):
    """The 64-bit mix of the draws, in plain integers."""
    for _ in range(2):
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 % 2**64
    return x ^ (x >> 32)


def agenda(model, segment, draw, dropout, seed):
    """Ids of one segment: the best merge that is not skipped, again and again."""
    import xxhash

    key = scrambled((xxhash.xxh3_64_intdigest(segment.encode()) + scrambled((draw + seed * 0x9E3779B97F4A7C15) % 2**64)) % 2**64)
    live = [(n, n + 1, -1 if c == "▁" else model.ids.get("▁" if c == " " else c, -1)) for n, c in enumerate(segment)]
    formed = dict(zip(model.keys.tolist(), model.results.tolist(), strict=True)) if not hasattr(model, "formed") else model.formed
    model.formed = formed
    while True:
        offers = []
        for n, ((a, b, x), (_, c, y)) in enumerate(zip(live, live[1:], strict=False)):
            made = formed.get(x * model.size + y, -1) if x >= 0 and y >= 0 else -1
            if made >= 0 and scrambled((key + a * 0xA0761D6478BD642F + b * 0xE7037ED1A0B428DB + c * 0x8EBC6AF09C88C6E3) % 2**64) >= int(dropout * 2.0**64):
                offers.append((-model.score[made], a, n, made))
        if not offers:
            return [i for a, b, x in live for i in ([x] if x >= 0 else [int(model.byte_ids[v]) for v in segment[a:b].encode()])]
        _, _, n, made = min(offers)
        live[n : n + 2] = [(live[n][0], live[n + 1][1], made)]


def plain_ids(model, text, key, dropout=0.1, seed=7):
    """Ids of a text, one segment after another; ``key`` is that of its document."""
    if not text:
        return []
    if re.search(r"  |^ | $|\x01", text):
        segments = re.findall(r" +[^ ]*|[^ ]+", " " + text)
    else:
        segments = [part if part[:1] == "\n" else part for part in re.findall(r"\n+| ?[^ \n]+| (?=\n)", " " + text)]
    out = []
    for place, segment in enumerate(segments):
        out += agenda(model, segment, scrambled((key + place * 0x9E3779B97F4A7C15) % 2**64), dropout, seed)
    return out


def test_dropout_follows_the_agenda():
    """The vectorised agendas against one agenda a segment."""
    model = pieces.PieceModel(queries.tokenizer_path("piece_bpe_32k.model"))
    words = [" internationalisation", " tokenization", "ééa", " a▁b", " 12345"]
    flat, sizes = pieces.encode_segments(model, words, np.zeros(5, np.int64), 0.3, 11)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for k, w in enumerate(words):
        assert flat[ends[k] : ends[k + 1]].tolist() == agenda(model, w, 0, 0.3, 11)


def test_dropout_of_every_occurrence():
    """Each occurrence against an agenda of its own; a word's segmentations are not bounded."""
    path = queries.tokenizer_path("piece_bpe_32k.model")
    word, n = "internationalisation", 400
    own = pieces.Encoder(path, 0.1, 7, 0)
    keys = np.array([5, 6], np.uint64)
    ids, totals = own.encode([" ".join([word] * n)] * 2, keys)
    draws = np.concatenate([pieces.mixed(k + np.arange(n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in keys])
    want, sizes = pieces.encode_segments(own.model, [" " + word] * 2 * n, draws, 0.1, 7)
    assert ids.tolist() == want.tolist() and totals.sum() == sizes.sum()
    assert len({tuple(x) for x in np.split(want, np.cumsum(sizes)[:-1])}) > 20


def test_default_dropout_is_not_bounded(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    rows = pieces.encode_documents(docs(spark, ["internationalisation"] * 300), path).collect()
    assert len({tuple(r.ids) for r in rows}) > 2


def test_pieces_round_trip(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    df = odd(spark).filter("doc_id is not null")
    out = pieces.piece_digest(df, path, dropout=0.3)
    assert out.filter("not round_trip").count() == 0 and out.count() == df.count()
    back = pieces.decode_documents(pieces.encode_documents(df, path), path)
    assert sorted(map(repr, (r.text for r in back.collect()))) == sorted(map(repr, (r.text for r in df.collect())))
    varied = pieces.encode_documents(docs(spark, ["internationalisation tokenization"] * 30), path, dropout=0.5, variants=8)
    assert len({tuple(r.ids) for r in varied.collect()}) > 3
    assert pieces.piece_digest(df.limit(0), path).count() == 0


# 9 ------------------------------------------------------------------------------------------------


def test_rules(spark):
    rows = [(1, "a://B.Net/x"), (2, None), (3, "foo"), (4, "http://example.net/en/q?x://y"), (5, "x://h\n/p\nq#"), (6, "://org/fr/"), (7, "http://notnet/a"), (8, "http://Ünet.example.com/de/x"), (9, "http://example.com/de"), (10, "http://net")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert {k: (v.host, v.path, v.rule) for k, v in got.items()} == {1: ("b.net", "/x", "net/"), 2: ("", "", None), 3: ("", "", None), 4: ("example.net", "/en/q", "example.net/en/"), 5: ("h\n", "/p\nq", None), 6: ("org", "/fr/", "org/fr/"), 7: ("notnet", "/a", None), 8: ("Ünet.example.com", "/de/x", "example.com/de/"), 9: ("example.com", "/de", None), 10: ("net", "", None)}
    assert {got[k].verdict for k in (1, 2, 3, 4, 5, 6)} == {"allow", "block"} and got[2].verdict == "allow"
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_ratio_on_held_out_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    split = pages.select(url_filter.host_of(F.col("url")).alias("h"), url_filter.path_of(F.col("url")).alias("p"))
    rows = split.withColumn("rule", url_filter.matched_rule(F.col("h"), F.col("p"))).filter("rule is not null").collect()
    verdict = {rule: v for v, rule in url_filter.RULES}
    texts = {v: [url_filter.features(r.h, r.p) for r in rows if verdict[r.rule] == v] for v in ("allow", "block")}
    ratio = url_filter.Ratio(texts["allow"][::2], texts["block"][::2])
    good, bad = ratio.scores(texts["allow"][1::2]) > ratio.threshold, ratio.scores(texts["block"][1::2]) > ratio.threshold
    assert good.mean() > 0.9 and bad.mean() < 0.1


def witten_bell(texts, order):
    """P(character | what stands before it), by counting substrings."""
    texts = [t.encode() + b"\0" for t in texts]

    def p(before, c):
        out = 1 / 256
        for n in range(min(order, len(before)) + 1):
            context = before[len(before) - n :]
            after = Counter(t[k + n] for t in texts for k in range(len(t) - n) if t[k : k + n] == context)
            if not after:
                continue
            out = (after[c] + len(after) * out) / (sum(after.values()) + len(after))
        return out

    return p


def likelihood(p, text):
    data = text.encode() + b"\0"
    return [math.log(p(data[:k], data[k])) for k in range(len(data))]


def test_probabilities_match_brute_force():
    r = random.Random(6)
    texts = ["".join(r.choice("abé/.") for _ in range(r.randrange(12))) for _ in range(40)]
    for order in (0, 2, 5):
        own, p = url_filter.Markov(texts, order), witten_bell(texts, order)
        for text in (*texts[:8], "", "zz", "abababé"):
            assert np.allclose(own.log_probabilities(*url_filter.encode([text])), likelihood(p, text))


def test_verdicts_match_brute_force(spark):
    """Every verdict from the rules, or from models and a threshold computed plainly; nine accepted URLs are learnt from."""
    r = random.Random(12)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randrange(3, 8)))
    urls = [f"http://{word('abcd')}.org/fr/{word('abcd')}" for _ in range(9)] + [f"http://{word('wxyz')}.net/{word('wxyz')}" for _ in range(60)]
    urls += [f"http://{word(letters)}.com/{word(letters)}" for letters in ("abcd", "wxyz") for _ in range(15)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: x for x in url_filter.judge_urls(df).collect()}
    draws = {x.page_id: x.draw for x in df.select("page_id", F.xxhash64("url", F.lit(5)).alias("draw")).collect()}
    texts = {"allow": [], "block": []}
    for k in sorted((k for k in got if got[k].rule), key=lambda k: (draws[k], got[k].host, got[k].path)):
        texts[got[k].verdict].append(url_filter.features(got[k].host, got[k].path))
    assert (len(texts["allow"]), len(texts["block"])) == (9, 60)

    def scores(accepted, rejected, rows):
        a, b = witten_bell(accepted, 5), witten_bell(rejected, 5)
        return [float(np.mean(np.array(likelihood(a, t)) - likelihood(b, t))) for t in rows]

    rest, held = ([[t for k, t in enumerate(texts[v]) if (k % 5 == 0) == h] for v in ("allow", "block")] for h in (False, True))
    good, bad = (scores(*rest, h) for h in held)
    cuts = sorted({*good, *bad})
    mids = [cuts[0] - 1e-6, *((x + y) / 2 for x, y in zip(cuts, cuts[1:], strict=False))]
    wrong = [np.mean([x < m for x in good]) + np.mean([x >= m for x in bad]) for m in mids]
    threshold = min((m for m, w in zip(mids, wrong, strict=True) if w <= min(wrong) + 1e-12), key=abs)
    open_ = [k for k in got if not got[k].rule]
    want = scores(texts["allow"], texts["block"], [url_filter.features(got[k].host, got[k].path) for k in open_])
    assert len(open_) == 30 and np.allclose([got[k].score for k in open_], np.array(want) - threshold)
    assert [got[k].verdict for k in open_] == ["allow" if w >= threshold else "block" for w in want]
    assert {got[k].verdict for k in open_} == {"allow", "block"}


def test_one_url_of_a_class_is_learnt_from(spark):
    urls = ["http://abcd.org/fr/abab", *[f"http://zz{k}.net/zyzy" for k in range(30)], "http://zz.com/zyzy", "http://abcd.com/abab"]
    got = {x.page_id: x.verdict for x in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert (got[31], got[32]) == ("block", "allow")


def test_all_ruled_urls_are_learnt_from(spark):
    """More rows than the 40,000 that were once sampled: what only the others hold is learnt, each count being of all rows."""
    n = 60_000
    letters = F.translate(F.conv((F.col("id") % 7).cast("string"), 10, 7), "0123456", "abcdefg")
    known = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("http://x.org/fr/"), letters)).otherwise(F.concat(F.lit("http://"), letters, F.lit(".net/q"))).alias("url"))
    draw = F.xxhash64("url", F.lit(5))
    late = [r.url for r in spark.range(4000).select(F.concat(F.lit("http://x.org/fr/zzz"), F.translate(F.col("id").cast("string"), "0123456789", "hijklmnopr")).alias("url")).orderBy(draw.desc()).limit(3).collect()]
    pages = known.union(spark.createDataFrame([(n + k, u) for k, u in enumerate(late)], "id long, url string"))
    split = pages.select(url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"), draw.alias("draw"))
    ruled = split.withColumn("accepted", url_filter.matched_rule(F.col("host"), F.col("path")) == "org/fr/")
    ratio = url_filter.learnt(ruled, 5)
    assert [m.contexts[0][1].sum() for m in ratio.models] == [sum(len(url_filter.features(r.host, r.path).encode()) + 1 for r in ruled.filter(F.col("accepted") == a).collect()) for a in (True, False)]
    z = np.frombuffer(b"/fr/zz", ">u1")
    code = np.uint64(int.from_bytes(z.tobytes(), "big"))
    assert url_filter.find(*ratio.models[0].grams[5], np.array([code]))[0] == 3


def test_best_cut_matches_sorting(spark):
    r = random.Random(3)
    rows = [(r.choice([r.gauss(g, 1), round(r.gauss(g, 1), 1)]), g > 0) for g in (1, -1) for _ in range(500)]
    good, bad = (np.sort([x for x, g in rows if g == which]) for which in (True, False))
    cuts = np.unique([x for x, _ in rows])
    mids = np.concatenate([[cuts[0] - 1e-6], (cuts[1:] + cuts[:-1]) / 2])
    wrong = np.searchsorted(good, mids) / len(good) + 1 - np.searchsorted(bad, mids) / len(bad)
    best = mids[wrong <= wrong.min() + 1e-12]
    assert url_filter.best_cut(spark.createDataFrame(rows, "score double, accepted boolean")) == best[np.argmin(np.abs(best))]


# 10 -----------------------------------------------------------------------------------------------


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    df = odd(spark).filter("doc_id is not null")
    start, want = 0, []
    for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).orderBy("doc_id", "h").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in token_file.token_digest(df, path).orderBy("start").collect()] == want
    assert token_file.token_digest(df.limit(0), path).count() == 0


PLAIN = ["a", "b", "Word", "one", "\n", "\n\n", "\n\n\n", " x", " y", "\t", "\r\n", "\r", ".", ",", ", ", ",\n", "'s", "12", "é", "-"]
ODD_PARTS = [*PLAIN, " ", "  ", "\f", "\x0b", "\u0085", "\u2003", "\xa0", "😀", "\x1c", "\x01", "<|endoftext|>"]


@pytest.mark.parametrize(("parts", "n"), [(PLAIN, 25_000), (ODD_PARTS, 25_000)])
def test_ids_equal_the_library(parts, n):
    """Paragraph breaks, tabs, CR LF and odd spaces in any order, and texts of whole paragraphs."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_file.WordEncoder(path)
    r = random.Random(n + len(parts))
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(n)]
    texts += [r.choice(["\n\n", "\r\n\r\n", "\n \n"]).join(" ".join(r.choice(["Some", "words,", "of", "a", "line.", "x\ny", "3"]) for _ in range(40)) for _ in range(9)) for _ in range(200)]
    for at in range(0, len(texts), 500):
        ids, lengths = [], []
        for _, some, sizes in own.encode(texts[at : at + 500], 2):
            ids.append(some)
            lengths += sizes.tolist()
        got = np.split(np.concatenate(ids), np.cumsum(lengths)[:-1])
        for text, want, x in zip(texts[at : at + 500], library.encode_batch_fast(texts[at : at + 500], add_special_tokens=False), got, strict=True):
            assert [*want.ids, 2] == x.tolist(), repr(text)


@pytest.mark.parametrize("top", [0, 1, 255, 50_000, 2**32 - 1])
def test_blocks(top):
    v = np.random.default_rng(top).integers(0, top + 1, (5, 1024), dtype=np.uint32)
    v[2, 7], v[3] = 2**32 - 1, top
    blocks = token_file.pack_blocks(v, 0.9)
    at = np.cumsum([0, *map(len, blocks)])[:-1]
    assert (token_file.unpack_blocks(b"".join(blocks), at) == v).all()


# odd tables -----------------------------------------------------------------------------------------


def test_odd_tables(spark):
    df = odd(spark)
    n = df.count()
    path = queries.tokenizer_path("piece_bpe_32k.model")
    labels = spark.createDataFrame([(k, k % 2, 1 if k == 6 else 0) for k in range(10)] + [(None, None, None), (1, None, None)], "doc_id long, quality int, toxic int")
    ways = (minhash.near_duplicates, mixing.mix, suffix_dedup.repeat_digest, simhash.fingerprint_digest, lambda d: toxicity.judge_toxicity(d, labels), lambda d: pieces.piece_digest(d, path), lambda d: token_file.token_digest(d, queries.tokenizer_path("byte_bpe_50k.json")))
    for f in ways:
        out = f(df)
        assert out.count() == n and out.filter("doc_id is null").count() == 2 and f(df.limit(0)).count() == 0
    pages = spark.createDataFrame([(None, None, None, "x"), (1, "http://a.net/", "h", None), (1, "http://a.net/", "h", None)], "page_id long, url string, html string, host string")
    for f in (url_filter.judge_urls, warc.archive_digest):
        out = f(pages)
        assert out.count() == 3 and out.filter("page_id is null").count() == 1 and f(pages.limit(0)).count() == 0
