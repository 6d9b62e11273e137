"""The pipeline's stages one by one, on a small table."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import mixing, near_documents, simhash

from test_langid import VOCAB, plain

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    vocab = {"en": ["the", "house", "with", "thing", "that", "where"], "de": ["der", "über", "nicht", "sch", "ein", "auch"]}
    made = [(i, "\n".join(" ".join(rng.choice(vocab[k]) for _ in range(rng.randint(8, 15))) for _ in range(6)), k, f"s{i % 3}", 1) for i, k in enumerate(["en", "de"] * 30)]
    made += [(100, "12 34 !! ??", "en", "s0", 1), (101, None, "en", None, None), (102, made[3][1], "de", "s1", 1), made[5], (103, "qqzx xxqz zqxw kkzq wqzx xqkz qzwx", None, "s2", 1)]
    return spark.createDataFrame(made, COLUMNS).repartition(3)


def test_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "mixing", "packing"]
    now, kept = docs, [set(r.doc_id for r in docs.collect())]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, "").cache()
        assert out.columns == docs.columns
        kept.append({r.doc_id for r in out.collect()})
        if name == "mixing":
            want = mixing.mix(now.select(F.struct("doc_id").alias("key"), "source", "text"), id_col="key").agg(F.sum("copies")).first()[0]
            assert out.count() == want
        now = out
    assert kept[0] - kept[1] == {100, 101, 103}
    assert kept[1] - kept[2] == {102}  # all of its lines are another's
    assert kept[3] <= kept[2] and kept[4] <= kept[3]
    name, stage = corpus_pipeline.STAGES[-1]
    pieces = stage(spark, now, "")
    assert {r.doc_id for r in pieces.collect()} == kept[4]
    assert pieces.filter("start = 0").count() == now.count()


def test_lines_leave_clean_documents_alone(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    clean = spark.createDataFrame([(i, "\n".join(" ".join(word() for _ in range(rng.randint(6, 14))) for _ in range(5)), "en", "s", 1) for i in range(80)], COLUMNS).repartition(3)
    out = corpus_pipeline.line_dedup(spark, clean, "")
    assert sorted(map(tuple, out.select("doc_id", "text").collect())) == sorted(map(tuple, clean.select("doc_id", "text").collect()))


def test_first_stage_is_the_plain_posterior(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(VOCAB[k]) for _ in range(25)), k, f"s{i % 4}", 1) for i, k in enumerate(["en", "de", "fr"] * 15)]
    texts += [(100, "qxzw wqkx zzqk xqwz kkqx qzwx xkqz zqxw wzqx kxqz jqxv vxqj qjvz xvzq zvxk kvqz vqkz zkvx xjqk qkjx", None, "s0", 1), (101, "12 34 !!", "en", None, 1), (102, None, "xx", "s1", 1), (103, "the nicht", "de", "s2", 1)]
    docs = spark.createDataFrame(texts, COLUMNS).repartition(3)
    want = plain([(i, t, (k or "").lower(), s or "", s or "", "") for i, t, k, s, _ in texts], [(t, k) for _, t, k, _, _ in texts])
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept == {i for i, (language, *_) in want.items() if language != "unknown"} and {101, 102} & kept == set()


def grams(line):
    b = line.encode()
    return {b[i : i + 8] for i in range(max(1, len(b) - 7))}


def test_line_stage_is_the_plain_union(spark):
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(10_000)}"
    base = [" ".join(word() for _ in range(rng.randint(8, 20))) for _ in range(40)]
    near = [x + " " + word() for x in base[:15]]
    docs = [(i, "\n".join(rng.choice(base + near + ["", " ", "OK"]) for _ in range(rng.randint(1, 6))), "en", "s", 1) for i in range(60)]
    lines = [(i, k, " ".join(x.split()).lower()) for i, t, *_ in docs for k, x in enumerate(t.split("\n"))]
    different = sorted({x for *_, x in lines if x})
    sets, parent = {x: grams(x) for x in different}, {x: x for x in different}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(different):
        for b in different[i + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    first, want = set(), {}
    for i, k, x in sorted(lines):
        keep = not x or root(x) not in first
        first |= {root(x)} if x else set()
        want.setdefault(i, []).append((docs[i][1].split("\n")[k], keep, bool(x)))
    gone = {i for i, parts in want.items() if any(real for *_, real in parts) and not any(keep and real for _, keep, real in parts)}
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(docs, COLUMNS).repartition(3), "").collect()}
    plain_texts = {i: "\n".join(x for x, keep, _ in parts if keep) for i, parts in want.items() if i not in gone}
    assert set(got) == set(plain_texts) and sum(got[i] == plain_texts[i] for i in got) >= 0.98 * len(got)


def test_mixing_and_packing_stages(spark):
    rng = random.Random(9)
    docs = [(i, " ".join("word" for _ in range(rng.randint(1, 60))), "en", ["a", "b", None][i % 3] if i % 5 else "a", 1) for i in range(300)]
    docs += [docs[4], docs[4]]  # repeats
    size = {}
    for _, t, _, s, _ in docs:
        size[s] = size.get(s, 0) + len(t.split())
    total, weight = sum(size.values()), {"a": 1, "b": 2, None: 3}
    target = {s: total * w / 6 for s, w in weight.items()}
    assert all(target[s] <= 3 * size[s] for s in size)  # no cap is met
    mixed = corpus_pipeline.mixing(spark, spark.createDataFrame(docs, COLUMNS).repartition(3), "").cache()
    took = {r.source: r.words for r in mixed.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("words")).collect()}
    assert all(abs(took[s] - target[s]) <= 30 for s in size)
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect() if r.doc_id != 4) <= 3
    pieces = corpus_pipeline.packing(spark, mixed, "").collect()
    length = {}
    for r in pieces:
        length[r.sequence_id] = length.get(r.sequence_id, 0) + r.length
    assert max(length.values()) <= 2048
    assert sum(length.values()) == sum(r.doc_tokens for r in pieces if r.start == 0) and sum(r.start == 0 for r in pieces) == mixed.count()


def test_near_copies_of_cut_documents_are_judged_as_they_are(spark):
    """Line dedup leaves of a near copy only the lines that are its own: those are no near copies for the stage after it."""
    rng = random.Random(30)
    line = lambda: " ".join(f"w{rng.randrange(100_000)}" for _ in range(12))
    base = [line() for _ in range(12)]
    other = [*base[:11], line()]
    docs = spark.createDataFrame([(1, "\n".join(base), "en", "s", 1), (2, "\n".join(other), "en", "s", 1), (3, "\n".join(x.replace("\n", " ") for x in [" ".join(base)]), "en", "s", 1)], COLUMNS)
    direct = {r.doc_id for r in corpus_pipeline.simhash(spark, docs, "").collect()}
    assert direct == {1}
    cut = corpus_pipeline.line_dedup(spark, docs, "")
    assert {r.doc_id: r.text for r in cut.collect()}[2] == other[11]
    assert {r.doc_id for r in corpus_pipeline.simhash(spark, cut, "").collect()} == {1, 2}


def test_columns_of_any_name_stay(spark, docs):
    names = ["__gone", "__key", "__c", "__m", "__n", "__copy", "__id", "__t", "__drop", "__h", "key", "of", "gone", "row", "rows", "copies", "n", "id", "host", "text2", "a.b"]
    wide = docs.select("*", *[F.concat(F.lit(n), "doc_id").alias(n) for n in names])
    now = wide
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "").cache()
        assert now.columns == wide.columns, name
    got = now.collect()
    assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
    assert corpus_pipeline.packing(spark, now, "").count() > 0


def test_near_copies_go(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(100_000)}"
    made = []
    for k in range(20):  # pairs at 0.8 and above that 3 bits of 64 don't link, and pairs just below
        base = [word() for _ in range(94)]
        made += [(10 * k, base), (10 * k + 1, base[:40] + [word()] + base[41:70] + [word()] + base[71:]), (10 * k + 2, [word() for _ in range(94)])]
        made += [(10 * k + 3, made[-1][1][:20] + [word()] + made[-1][1][21:40] + [word()] + made[-1][1][41:60] + [word()] + made[-1][1][61:])]
    base = [word() for _ in range(94)]
    for k in range(40):  # a crowd, of which not all pairs are similar
        at = rng.randrange(94)
        made.append((1000 + k, base[:at] + [word()] + base[at + 1 :]))
    docs = spark.createDataFrame([(i, " ".join(x), "en", "s", 1) for i, x in made] + [(2000, " ", "en", "s", 1), (2001, None, "en", "s", 1), (2002, "One two", "en", "s", 1), (2003, "one  TWO", "en", "s", 1)], COLUMNS)
    docs = docs.repartition(3)
    sets = {r.doc_id: {tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} if (x := (r.text or "").lower().split()) else set() for r in docs.collect()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    kept = {r.doc_id for r in corpus_pipeline.simhash(spark, docs, "").collect()}
    assert kept == {i for i in sets if root(i) == i}
    assert all({10 * k, 10 * k + 2, 10 * k + 3} <= kept and 10 * k + 1 not in kept for k in range(20))


def test_wide_fingerprints_are_majorities():
    rng = np.random.default_rng(3)
    n = np.array([1, 2, 15, 16, 17, 255, 256, 4000, 1, (1 << 17) + 5])
    hashes = rng.integers(0, 1 << 64, n.sum(), np.uint64)
    got = simhash.wide_fingerprints(hashes, n, 3)
    seeds = np.random.default_rng(64).integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
    for row, own in zip(got, np.split(hashes, np.cumsum(n)[:-1]), strict=True):
        for k in range(3):
            x = own * seeds[0, k]
            x = (x ^ (x >> np.uint64(32))) * seeds[1, k]
            x = own if k == 0 else x ^ (x >> np.uint64(29))
            assert int(row[k]) == sum(int(2 * ((x >> np.uint64(b)) & np.uint64(1)).sum() > len(x)) << b for b in range(64))
    text = " ".join(f"w{i}" for i in range(200))
    _, (packed,) = near_documents.signatures(pa.array([text]))
    assert np.frombuffer(packed, "<u8")[0] == simhash.fingerprints(pa.array([text]), 5)[0]  # no shingle is repeated


def test_near_candidates_are_of_simhash_keys():
    """Pairs at five-word similarity 0.8 share a key of their fingerprints and have near sketches; others hardly ever do."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(1_000_000)}"
    for words, replaced in ((8, None), (16, None), (94, (40, 70)), (454, tuple(range(10, 450, 44)))):  # 0.8, and above where shorter by the last word
        hit = stray = 0
        for _ in range(200):
            base = [word() for _ in range(words)]
            near = base + [word()] if replaced is None else [word() if i in replaced else x for i, x in enumerate(base)]
            _, packed = near_documents.signatures(pa.array([" ".join(x) for x in (base, near, [word() for _ in range(words)])]))
            rows = [np.frombuffer(x, "<u8") for x in packed]
            same = [(near_documents.band_keys(rows[0][None]) == near_documents.band_keys(x[None])).any() for x in rows[1:]]
            close = [np.bitwise_count(rows[0][:2] ^ x[:2]).sum() <= near_documents.SKETCH_BITS for x in rows[1:]]
            hit += same[0] and close[0]
            stray += same[1] and close[1]
        assert hit >= 199 and stray == 0, words


def test_sketch_groups():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, (40, 2), np.uint64)
    of = rng.integers(0, 40, 3000)
    x, y = base[of].T.copy()
    x ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    keys = np.sort(rng.integers(0, 9, 3000))
    got = near_documents.sketch_groups(keys, x, y)
    first = {}
    assert got.tolist() == [first.setdefault((k, o), i) for i, (k, o) in enumerate(zip(keys.tolist(), of.tolist(), strict=True))]


def test_empty(spark, docs):
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
    assert now.count() == 0
