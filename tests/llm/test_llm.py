"""Operators on text against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import itertools
import math
import os
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import components, exact_dedup, gru, langid, line_dedup, lm, mixing, packing, secrets, simhash, token_output, tokens, topk
from tallyloom.llm.queries import BYTE_BPE, WORD_BPE, vocabulary

SPACE, WORD = re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[^\x20\x09-\x0D]+")
#: A clashing and an extra column go along in every table.
SCHEMA = "doc_id long, text string, lang string, source string, id string, `h` long, size string"


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "tion", "ré", "über", "niño", "a1", "x", "Data", "model."]) + rng.choice(["", "s", "ing", ","]) for _ in range(n))


def rows():
    """Documents with what may go wrong."""
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "one two", "A  b\tc", "A b c", "a b c", "漢字 кот x", "é́ é 　 z", "long " * 5000]
    base = [words(rng, n) for n in (3, 30, 200, 700)]
    texts += base + base[1:3] + [base[2] + " tail", base[3].replace("the", "thy", 1), "line\n" * 40 + base[0], base[1] + "\n" + base[2], "x" * 3000]
    texts += [words(rng, rng.randint(1, 60)) for _ in range(60)]
    out = [(i, t, ["en", "fr", None, ""][i % 4], ["a", "b", "é", None][i % 4] if i % 3 else "a", "z", 1, "s") for i, t in enumerate(texts)]
    return out + [out[12], out[12]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1 exact dedup


@pytest.mark.parametrize("digest", [True, False])
def test_exact_dedup(docs, digest):
    norm = [(r[0], SPACE.sub(" ", r[1] or "")) for r in rows()]
    ids = {t: [i for i, x in norm if x == t] for _, t in norm}
    want = Counter((i, min(ids[t]), len(ids[t]), i == min(ids[t]), *([hashlib.sha256(t.encode()).hexdigest()] if digest else [])) for i, t in norm)
    assert Counter(tuple(r) for r in exact_dedup.exact_dedup(docs, digest=digest).collect()) == want


def test_exact_dedup_edges(spark, empty):
    assert exact_dedup.exact_dedup(empty, digest=True).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b"), (4, "b")], "doc_id long, text string")
    got = Counter(tuple(r) for r in exact_dedup.exact_dedup(nulls).collect())
    assert got == Counter({(None, None, 2, True): 2, (None, 4, 2, False): 1, (4, 4, 2, True): 1})
    plan = exact_dedup.exact_dedup(nulls)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 2 token output


def test_parts_equal_whole_encoding():
    rng = random.Random(5)
    alphabet = ["a", "b", "é", " ", "  ", "\n", "\t", " ", "　", "'s", "1", "2", "!", "'", '"', "\x1c", "\u0085", "漢", "😀", "́", "<|endoftext|>", "<|ENDOFTEXT|>", "Σ", "İ", "'LL", "\r\n", "The", ",", "×", "ß"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(3000)] + [r[1] or "" for r in rows()]
    for name, by_word in ((WORD_BPE, True), (BYTE_BPE, False)):
        t = tokens.PartTokenizer(vocabulary(name), by_word)
        want = [e.ids for e in t.tokenizer.encode_batch(texts, add_special_tokens=False)]
        got = []
        for text in (texts[:1500], texts[1500:]):  # the second time with a filled cache
            for ids, ends in t.encode(pa.array(text)):
                got += [x.tolist() for x in np.split(ids, ends[:-1])] if len(ends) else []
        assert got == want


def encoded(name, end):
    t = tokens.PartTokenizer(vocabulary(name), False).tokenizer
    return [(r[0], t.encode(r[1] or "", add_special_tokens=False).ids + [end]) for r in sorted(rows(), key=lambda r: r[0])]


def test_token_output(docs, tmp_path):
    shards = token_output.write_tokens(docs, f"file://{tmp_path}/t", vocabulary(WORD_BPE), 2, seq_len=64, batch_rows=4)
    got = sorted(tuple(r) for r in token_output.read_documents(shards, "bigint").collect())
    want, start = [], 0
    for i, ids in encoded(WORD_BPE, 2):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)
    stream = [x for _, ids in encoded(WORD_BPE, 2) for x in ids]
    for shard in shards.collect():
        f = token_output.SequenceFile(shard.uri)
        assert f.schema.field("ids").type == pa.list_(pa.uint16(), 64)
        n = 0
        for i in range(shard.sequences):
            ids, mask = f.sequence(i)
            assert len(ids) == 64 and ids[mask].tolist() == stream[shard.base + n : shard.base + n + int(mask.sum())]
            assert mask.all() or i == shard.sequences - 1
            n += int(mask.sum())
        assert n == shard.ids


def test_token_output_empty(empty, tmp_path):
    shards = token_output.write_tokens(empty, f"file://{tmp_path}/t", vocabulary(WORD_BPE), 2)
    assert shards.count() == 0 and token_output.read_documents(shards, "bigint").count() == 0


# 3 top-k


def brute_topk(vectors, k):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(256 * x) for x in v)]
    out = []
    for q, a in fine:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in fine if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 3e5, 1e9, 1e200])
def test_topk(spark, scale):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(np.float32(x)) * scale for x in rng.normal(0, 1, 8)]) for i in range(400)]
    vectors += [(400 + i, vectors[7][1]) for i in range(60)] + [(1000, None), (1050, []), (1100, [1.0, None] * 4), (1150, [float("inf")] * 8), (1200, [float("nan")] * 8), (1250, [1.0, 2.0]), (1300, [0.0] * 8), (None, [1.0] * 8), (1350, [1.7e308] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in vectors], "vec_id long, embedding array<double>, id long, v double, bucket string").repartition(5)
    got = sorted(tuple(r) for r in topk.exact_topk(df, 5, F.col("vec_id") % 50 == 0, scale=256.0).collect())
    assert got == brute_topk(vectors, 5)


def test_topk_large_components(spark):
    df = spark.createDataFrame([(0, [5000.0, 1.0]), (1, [6000.0, 0.0]), (2, [7000.0, 0.0]), (3, [4100.0, 2.0])], "vec_id int, embedding array<float>")
    got = topk.exact_topk(df, 3, F.col("vec_id") == 0)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(0, 1, 2, 2293760000000), (0, 2, 1, 1966080000000), (0, 3, 3, 1343488131072)]
    assert got.schema["vec_id"].dataType.simpleString() == "int"
    with pytest.raises(TypeError):
        topk.exact_topk(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<float>"), 1, F.lit(True))


def test_topk_edges(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.exact_topk(df, 5, F.col("vec_id") == 0).collect()) == [(0, 1, 1, 131072), (0, 2, 2, 131072)]
    assert topk.exact_topk(df, 5, F.lit(False)).count() == 0 and topk.exact_topk(df.limit(0), 5, F.lit(True)).count() == 0


# 4 packing


def test_packing(docs, spark):
    pieces = packing.pack(docs, vocabulary(BYTE_BPE), 1, with_ids=True).cache()
    got = [r.asDict() for r in pieces.collect()]
    whole = encoded(BYTE_BPE, 1)
    want = Counter((i, tuple(ids)) for i, ids in whole)
    by_doc = Counter()
    for i, own in itertools.groupby(sorted(got, key=lambda r: (r["doc_id"], r["start"])), key=lambda r: r["doc_id"]):
        own = list(own)
        n = sum(1 for j, _ in whole if j == i)
        ids = [x for r in own[::n] for x in r["ids"]]
        assert {r["doc_tokens"] for r in own} == {len(ids)}
        by_doc[(i, tuple(ids))] += n
    assert by_doc == want
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"] for r in got)
    used = {}
    for _, own in itertools.groupby(sorted(got, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        used[r["sequence_id"]] = at
    total = sum(used.values())
    assert max(used.values()) <= 2048 and len(used) <= total / 2048 + 2 and total == sum(len(ids) for _, ids in whole)
    for s in packing.sequences(pieces, 0).collect():
        assert s.used == used[s.sequence_id] and len(s.ids) == (s.used if s.used & (s.used - 1) == 0 else 2048)


def test_cutting_patterns():
    rng = np.random.default_rng(4)
    sizes = packing.length_classes(2048)
    for n in (0, 1, 7, 300, 100_000):
        demand = np.bincount(rng.integers(0, len(sizes), n), minlength=len(sizes))
        patterns = packing.cutting_patterns(sizes, demand, 2048)
        assert (sum((p * t for p, t in patterns), np.zeros(len(sizes), int)) == demand).all()
        assert all((p * sizes).sum() <= 2048 for p, _ in patterns)
        if n == 100_000:
            assert sum(t for _, t in patterns) <= 1.005 * (demand * sizes).sum() / 2048


def test_packing_small(spark, empty):
    assert packing.pack(empty, vocabulary(BYTE_BPE), 1).count() == 0
    one = packing.pack(spark.createDataFrame([(5, None)], "doc_id long, text string"), vocabulary(BYTE_BPE), 1).collect()
    assert [tuple(r) for r in one] == [(5, 0, 1, zlib.crc32(b"\1\0\0\0"), 1, 0, 0)]


# 5 mixing


def targets(sizes, weights, total):
    out, live, left = {}, set(sizes), total
    while live:
        w = sum(weights[s] for s in live)
        over = [s for s in live if left * weights[s] / w > 3 * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / w for s in live}
        for s in over:
            out[s] = 3 * sizes[s]
            left -= out[s]
            live.discard(s)
    return out


def test_mixing(docs):
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows()}
    sources = sorted({r[3] for r in rows()} - {None}) + [None]
    sums = {s: sum(size[r[0]] for r in rows() if r[3] == s) for s in sources}
    want = targets(sums, {s: i % 3 + 1 for i, s in enumerate(sources)}, sum(sums.values()))
    got = mixing.mix(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows())
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sums[r.source] and r.target == pytest.approx(want[r.source]) and r.taken == r.copies * r.size <= 3 * r.size
    for s in sources:
        short = want[s] - sum(r.taken for r in got if r.source == s)
        assert abs(short) <= max(60, 0.02 * want[s]) or max(r.size for r in got if r.source == s) > want[s]
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)


def test_mixing_caps(spark, empty):
    assert mixing.mix(empty).count() == 0
    df = spark.createDataFrame([(1, "w " * 10, "a"), (2, "w " * 1000, "b"), (3, None, "c")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.target, r.taken) for r in mixing.mix(df, weights=(100, 1, 1)).collect()}
    assert got == {1: (30.0, 30), 2: (980.0, 1000), 3: (0.0, 0)}


# 6 simhash


def plain_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum((2 * sum(v >> b & 1 for v in h) > len(h)) << b for b in range(64)) if h else 0


def plain_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {n: root(n) for n in nodes}


def test_simhash(docs, empty):
    fps = {r[0]: plain_fingerprint(r[1]) for r in rows()}
    want = plain_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    got = simhash.simhash_groups(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((r[0], f"{fps[r[0]]:016x}", want[r[0]]) for r in rows())
    assert simhash.simhash_groups(empty).count() == 0


def test_fuzzy_keys_lose_no_link():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(a)):
        for p in rng.choice(64, i % 4, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(p)
    sets = []
    for x in (a, b):
        of, keys = simhash.fuzzy_keys(x)
        sets.append([set(k.tolist()) for k in np.split(keys, np.flatnonzero(np.diff(of)) + 1)])
    assert all(x & y for x, y in zip(*sets, strict=True))


def test_golay_covers_all_words():
    x = np.random.default_rng(1).integers(0, 1 << 23, 5000).astype(np.uint64)
    near = simhash.near_codewords(x)
    for k in range(23):
        other = simhash.near_codewords(x ^ np.uint64(1 << k))
        assert (near == other[:, :1]).any(axis=1).all()


def test_links_of_a_large_group(spark):
    rng = np.random.default_rng(9)
    base = int(rng.integers(0, 2**63))
    fps = {base}
    while len(fps) < 600:  # a chain of neighbours, dense and with far ends
        x = random.Random(len(fps)).choice(sorted(fps))
        for p in rng.choice(64, 2, replace=False):
            x ^= 1 << int(p)
        fps.add(x)
    fps |= {int(v) for v in rng.integers(0, 2**63, 200)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4)
    links = simhash.near_links(df).cache()
    found = {r.node: r.root for r in components.components(links).collect()}
    want = plain_components(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert {x: found.get(x, x) for x in signed} == want
    assert links.count() < 40 * len(fps)


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(70)] + [(5, 5), (None, 3), (1, 0)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    nodes = sorted({x for e in edges if None not in e for x in e})
    linked = {frozenset(e) for e in edges}
    want = plain_components(nodes, lambda a, b: frozenset((a, b)) in linked)
    got = {r.node: r.root for r in components.components(df).collect()}
    assert {n: got.get(n, n) for n in nodes} == want
    assert components.components(df.limit(0)).count() == 0


# 7 language model


def test_lm_base_scores(docs, empty):
    held = F.col("doc_id") % 7 == 2
    got = lm.lm_scores(docs, held, top=20).collect()
    token = {r[0]: (r[1] or "").encode().lower().split() for r in rows()}
    train = [r[0] for r in rows() if r[0] % 7 != 2]
    c = Counter(w for i in train for w in token[i])
    n, v = sum(c.values()) + len(train), len(c) + 1
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows())
    for r in got:
        w = token[r.doc_id]
        base = sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w) + np.log10((len(train) + 1) / (n + v + 1))
        assert r.base_score == pytest.approx(base) and r.n_tokens == len(w) + 1 and r.n_known == sum(c[x] > 0 for x in w) + 1
        assert r.train_tokens == n and r.held_out == (r.doc_id % 7 == 2) and r.score < 0
    assert lm.lm_scores(empty, held).count() == 0


def test_lm_without_training(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.lm_scores(df, F.lit(True)).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 and np.isfinite(r.score) for r in got)


def test_lm_learns(spark):
    rng = random.Random(1)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(a if i % 2 else b) for _ in range(60))) for i in range(400)], "doc_id long, text string").repartition(4)
    held = lm.lm_scores(df, F.col("doc_id") % 7 == 2).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert held[1] > held[0]


def test_lm_learns_from_the_corpus(spark):
    """On documents held out, the trained network is better than its first weights, which know the words' frequencies."""
    import zlib

    from tallyloom.llm.common import documents

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    docs = documents(spark, "/root/testdata/sf0.001")
    texts = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.select("doc_id", "text").collect()]
    held = {i for i, _ in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(w for i, x in texts if i not in held for w in x)
    top = [w for w, _ in sorted(counts.items(), key=lambda p: (-p[1], p[0]))[:256]]
    place = {w: k for k, w in enumerate(top)}
    shape = gru.Shape(len(top), 1)
    rest = sum(c for w, c in counts.items() if w not in place)
    first = gru.initial(shape, np.array([*(counts[w] for w in top), len(texts) - len(held), rest], float), 7)
    stream = lambda keep: (np.array([place.get(w, len(top) + 1) if w is not None else len(top) for i, x in texts if keep(i) for w in [*x, None]]), np.array([len(x) + 1 for i, x in texts if keep(i)]))
    model, symbols, lengths = gru.Model(first, shape), *stream(lambda i: i in held)
    before = model.score(symbols, lengths).sum() / len(symbols)
    model.train(*stream(lambda i: i not in held))
    after = model.score(symbols, lengths).sum() / len(symbols)
    assert np.exp(-after) < 0.9 * np.exp(-before)


def plain_gru(model, doc):
    """Natural log probability of a document, one symbol and one state at a time."""
    p, s = {k: v.astype(float) for k, v in model.p.items()}, model.shape
    h, n, out, before = np.zeros(s.hidden), s.hidden, 0.0, s.top
    sig = lambda x: 1 / (1 + np.exp(-x))
    for y in doc:
        g, x = h @ p["u"], p["x"][before]
        z, r = sig(x[:n] + g[:n]), sig(x[n : 2 * n] + g[n : 2 * n])
        c = np.tanh(x[2 * n :] + r * g[2 * n :])
        h = z * h + (1 - z) * c
        logits = h @ p["wc"] + p["bc"]
        k = s.class_of[y]
        out += logits[k] - np.log(np.exp(logits).sum())
        if k < s.word_classes:
            inner = h @ p["ww"][k] + p["bw"][k]
            out += inner[y - k * s.per_class] - np.log(np.exp(inner).sum())
        before = y
    return out


def test_gru_scores_equal_a_plain_network():
    rng = np.random.default_rng(4)
    shape = gru.Shape(11, 3, hidden=5, per_class=4)
    model = gru.Model(gru.initial(shape, np.arange(1, 16), 3), shape)
    docs = [rng.integers(0, shape.symbols, n) for n in (1, 3, 70, 45, 20, 1)]
    model.train(np.concatenate(docs), np.array([len(d) for d in docs]))
    got = model.score(np.concatenate(docs), np.array([len(d) for d in docs]))
    assert got == pytest.approx([plain_gru(model, d) for d in docs], rel=1e-4)


def test_lm_score_sums_to_one_over_words_and_unknown(spark):
    """Documents of one word each, for every trained word, and one unknown word for all others: their chances add up to one."""
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(40)]
    train = [(i, " ".join(rng.choice(vocab[: 5 + i % 36]) for _ in range(30))) for i in range(60)]
    probes = [(1000 + k, w) for k, w in enumerate([*vocab, "neverseen"])] + [(2000, "")]
    df = spark.createDataFrame(train + probes, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm.lm_scores(df, F.col("doc_id") >= 1000, top=12).filter("held_out").collect()}
    # A document is a word and an end; its chance is the word's times the end's after it, so sums are at most one, less the empty one's.
    total = sum(10 ** got[i] for i, _ in probes)
    assert 0 < total < 1 + 1e-3 and all(got[1040] < got[1000 + k] for k in range(5))


def test_chunks_gather_batches():
    small = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([False, True]), pa.array(["a" * 1000, "b"])], names=["id", "held", "text"])
    whole = list(lm._gathered([small] * 5))
    assert len(whole) == 1 and [len(x) for x in whole[0]] == [10, 10, 10]
    large = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([False]), pa.array(["a" * lm.CHUNK_BYTES])], names=["id", "held", "text"])
    assert [len(x[0]) for x in lm._gathered([small, large, small, large])] == [3, 3]


def test_gru_gradients():
    shape = gru.Shape(7, 2, hidden=3, per_class=4)
    flat = gru.initial(shape, np.arange(1, 11), 1)
    symbols, lengths = np.array([0, 3, 8, 7, 5, 9, 1, 2, 7, 7]), np.array([4, 5, 1])

    def loss(w):
        m = gru.Model(w, shape)
        m.flat, m.p = w.astype(np.float64), gru.unpack(w.astype(np.float64), shape)
        return -m.score(symbols, lengths).sum()

    m = gru.Model(flat, shape)
    seen = {}
    step = np.sqrt
    kept = m.flat.copy()
    m.train(symbols, lengths, rate=1e-3)
    moved = m.flat - kept
    for i in np.random.default_rng(2).choice(len(flat), 40, replace=False):
        e = np.zeros(len(flat))
        e[i] = 1e-5
        seen[i] = (loss(flat.astype(float) + e) - loss(flat.astype(float) - e)) / 2e-5
    # The first step of Adam goes against the sign of each gradient.
    assert all(abs(g) < 1e-3 or moved[i] * g < 0 for i, g in seen.items()) and step(4) == 2


def test_gru_probabilities_and_state():
    shape = gru.Shape(5, 1, hidden=4, per_class=2)
    m = gru.Model(gru.initial(shape, np.ones(7), 3), shape)
    logp, _ = m._outputs(np.repeat(np.random.default_rng(1).normal(size=(1, 4)).astype(np.float32), 7, axis=0), np.arange(7))
    assert np.exp(logp).sum() == pytest.approx(1, abs=1e-5)
    doc = np.random.default_rng(2).integers(0, 7, 100)
    alone = m.score(doc, np.array([100]))
    both = m.score(np.concatenate([doc[:30], doc]), np.array([30, 100]))
    assert both[1] == pytest.approx(alone[0], rel=1e-5)


# 8 secrets


@pytest.fixture(scope="module")
def scanner():
    return secrets.train_scanner(["model", "data", "thing", "house", "table", "value", "number", "other"])


def test_forest_on_held_out_findings(scanner):
    held = secrets.generated_findings(["model", "data", "thing", "house", "table"], 1000, seed=99)
    guess = scanner.probability(scanner.features([f for f, _ in held])) >= 0.5
    truth = np.array([y for _, y in held])
    assert (guess == truth).mean() > 0.95 and (guess & truth).sum() / truth.sum() > 0.93


def test_scan(spark, scanner, empty):
    secret = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    texts = {1: f'é the token = "{secret}" here', 2: f"commit {secret} of the table", 3: None, 4: "", 5: "the internationalisationofthings word", 6: 'password = "hunter2!x"', 7: "-----BEGIN RSA PRIVATE KEY-----\nabc", 8: "x" * 2000, 9: f'token = "{secret}"', 10: "id 1234567890123456 thing"}
    df = spark.createDataFrame([(i, t, "p") for i, t in texts.items()], "doc_id long, text string, path string").repartition(3)
    got = {(r.doc_id, r.rule): r for r in secrets.scan(df, scanner, path=F.col("path")).collect()}
    assert got[1, "token"].is_secret and got[9, "token"].is_secret and not got[2, "token"].is_secret and not got[10, "token"].is_secret
    r = got[1, "token"]
    assert texts[1][r.start : r.start + r.length] == secret and r.sha256 == hashlib.sha256(secret.encode()).hexdigest()
    assert got[7, "private_key"].is_secret and (6, "named") in got and not {3, 4, 5, 8} & {i for i, _ in got}
    assert secrets.scan(empty, scanner).count() == 0


def test_scan_drops_no_candidate(spark, scanner):
    secret = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    long = "".join(random.Random(8).choice(string.ascii_letters + string.digits) for _ in range(1600))
    named = ['DB_PASSWORD = "p@ss!w0rd$24"', '"client_secret": "p@ss!w0rd$24"', 'api_key = "p@ss!w0rd$24"', "password: p@ss!w0rd$24", "x password: secret_token=p@ss!w0rd$24, y"]
    texts = [f'private_key = "{long}"', "=" * 600 + secret, "some/path/" * 80 + secret, 'password = "' + "p@" * 60 + '"', 'password = "correcthorsebatterystaple"', *named, "password:"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, texts[r.doc_id][r.start : r.start + r.length]) for r in secrets.scan(df, scanner).collect()}
    want = [long, secret, secret, "p@" * 60, "correcthorsebatterystaple", *["p@ss!w0rd$24"] * len(named)]
    assert {(i, x) for i, x in enumerate(want)} <= got


def test_labelled_findings(spark):
    made = secrets.generated_findings(["model"], 400)
    df = spark.createDataFrame([(*f, bool(y)) for f, y in made] + [(None, "", "", "", True)], "candidate string, before string, after string, path string, label boolean")
    s = secrets.train_scanner(["model"], df, trees=5)
    assert len(s.trees) == 5
    assert s.probability(s.features([made[1][0]]))[0] > 0.5


# 9 line dedup


def line_key(line):
    return SPACE.sub(" ", line).strip(" ").lower()


def gram_set(line):
    b = line.encode()
    return {b[i : i + 8] for i in range(max(1, len(b) - 7))}


def test_lines(spark, empty):
    rng = random.Random(11)
    base = [words(rng, rng.randint(8, 40)) for _ in range(60)]
    near = [b[: len(b) // 2] + "q" + b[len(b) // 2 + 1 :] for b in base[:30]]
    crowd = [base[50] + f" {i}" for i in range(60)]
    pool = base + near + crowd + ["", "  ", "OK", "ok", "short"]
    made = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(80)] + [(200, "\n".join(crowd)), (201, None), (202, ""), (203, base[0] + "\n" + base[0])]
    made += [made[5]]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    lines = {(i, k): line_key(x) for i, t in made for k, x in enumerate((t or "").split("\n")) if line_key(x)}
    different = sorted(set(lines.values()))
    sets = {x: gram_set(x) for x in different}
    root = plain_components(different, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    first = {}
    for at, x in sorted(lines.items()):
        first.setdefault(root[x], at)
    got = {(r.doc_id, r.pos): (r.keep_id, r.keep_pos) for r in line_dedup.line_groups(df).collect()}
    assert set(got) == set(lines)
    assert sum(got[at] == first[root[x]] for at, x in lines.items()) >= 0.99 * len(lines)
    kept = line_dedup.drop_lines(df, line_dedup.line_groups(df)).collect()
    assert {r.doc_id for r in kept} >= {201, 202} and all(r.text is None for r in kept if r.doc_id == 201)
    text = {r.doc_id: r.text for r in kept}
    assert sum(len([x for x in (t or "").split("\n") if line_key(x)]) for t in text.values()) == sum(got[at] == at for at in got)
    assert line_dedup.line_groups(empty).count() == 0


# 10 language identification


def test_language(spark, empty):
    rng = random.Random(2)
    vocab = {"en": ["the", "house", "with", "thing", "that", "where"], "de": ["der", "über", "nicht", "sch", "ein", "auch"], "fr": ["les", "été", "pour", "eau", "avec", "où"]}
    train = spark.createDataFrame([(" ".join(rng.choice(v) for _ in range(60)), k) for k, v in vocab.items() for _ in range(30)] + [("zzz", None), (None, "en"), ("x", "")], "text string, lang string")
    model = langid.train_text_model(train)
    assert model.languages == ("de", "en", "fr")
    page = lambda lang, text: f'<html lang="{lang}"><script>var the="x"</script><body><p>{text}</p></body></html>'
    made = [(i, f"https://www.h{i % 4}.example.{['com', 'de'][i % 2]}/x", page(k, " ".join(rng.choice(vocab[k]) for _ in range(30)))) for i, k in enumerate(list(vocab) * 20)]
    made += [(100, None, None), (101, "", ""), (102, "bad url", page("en", "12345 !!!")), (103, "http://h.example.com", page("fr", "qwxz kqzx wqkx zzqk xqwz kkqx qqzw xkzq wzqx"))]
    pages = spark.createDataFrame(made, "page_id long, url string, html string").repartition(3)
    got = {r.id: r for r in langid.identify(langid.page_evidence(pages), model).collect()}
    assert all(got[i].language == k for i, k in enumerate(list(vocab) * 20))
    assert all(got[i].language == langid.UNKNOWN and got[i].probability == 1 for i in (100, 101, 102)) and got[103].language == langid.UNKNOWN
    short = spark.createDataFrame([(1, "u", "de", "h", "d", "s")] + [(i, "der über nicht ein auch der", "de", "h", "d", "s") for i in range(2, 12)], "id long, text string, declared string, host string, domain string, suffix string")
    assert {r.id: r.language for r in langid.identify(short, model).collect()}[2] == "de"
    none = langid.train_text_model(train.limit(0))
    assert none.languages == () and langid.identify(short, none).filter("language <> 'unknown'").count() == 0
    assert langid.identify(short.limit(0), model).count() == 0
