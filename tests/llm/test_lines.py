"""Line and crowd comparison: recall by length, crowds under one key, clashing columns, long texts."""

import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import components, crowds, line_dedup, near_documents

SIMILARITY = 0.8


def grams(line):
    b = line.encode()
    return {b[i : i + 8] for i in range(max(1, len(b) - 7))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def plain_roots(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if root(a) != root(b) and linked(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("low, high", [(20, 60), (60, 150), (150, 400), (400, 1500)])
def test_recall_of_pairs_by_length(spark, low, high):
    rng = random.Random(low)
    letter = lambda: rng.choice(string.ascii_lowercase + "     ")
    pairs = []
    while len(pairs) < 250:
        base = [letter() for _ in range(rng.randint(low, high))]
        other = list(base)
        for _ in range(max(1, rng.randint(0, len(base) // 70))):
            other[rng.randrange(len(other))] = letter()
        a, b = (" ".join("".join(x).split()) for x in (base, other))
        if a != b and SIMILARITY <= jaccard(grams(a), grams(b)) < 0.9:
            pairs.append((a, b))
    rows = [(2 * i + k, pair[k]) for i, pair in enumerate(pairs) for k in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.keep_id for r in line_dedup.line_groups(df).collect()}
    assert all(got[2 * i] == 2 * i for i in range(len(pairs)))
    assert sum(got[2 * i + 1] == 2 * i for i in range(len(pairs))) >= 0.97 * len(pairs)


def crowd(rng, n):
    """Lines under one key: mostly unlike, some near copies of each other, some chains."""
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(6))
    lines = ["the same beginning " + " ".join(word() for _ in range(8)) for _ in range(n)]
    for i in range(0, n - 1, 7):
        lines[i + 1] = lines[i][:-1] + rng.choice(string.ascii_uppercase)
    return lines


def test_crowds_are_whole(spark, tmp_path):
    rng = random.Random(5)
    lines = crowd(rng, 1200)
    lines[600:640] = [lines[600] + f" {i}" for i in range(40)]
    h = list(range(len(lines)))
    texts = spark.createDataFrame([(i, x.encode()) for i, x in enumerate(lines)], "h long, text binary").repartition(4)
    held = spark.createDataFrame([(k, i) for i in h for k in ((1, 2) if i % 3 else (1,))] + [(9, 3), (9, 5)], "key long, h long")
    known = spark.createDataFrame([(5, 3)], "node long, root long")
    found = crowds.crowd_links(held, known, texts, lambda x: line_dedup._sets(x)[:2], 80, f"file://{tmp_path}/a")
    roots = {r.node: r.root for r in components.components(found.union(spark.createDataFrame([(3, 5)], "u long, v long"))).collect()}
    sets = [grams(x) for x in lines]
    want = plain_roots(h, lambda a, b: {a, b} == {3, 5} or jaccard(sets[a], sets[b]) >= SIMILARITY)
    assert {i: roots.get(i, i) for i in h} == want
    blocks = spark.read.parquet(f"file://{tmp_path}/a/blocks").collect()
    assert {r.key: r.blocks for r in blocks} == {1: 3, 2: 2}  # key 9 has one root
    assert crowds.crowd_links(held.filter("key = 9"), known, texts, lambda x: line_dedup._sets(x)[:2], 80, f"file://{tmp_path}/b") is None


def test_blocks_are_bounded_by_bytes_too(spark, tmp_path):
    texts = spark.createDataFrame([(i, bytes([65 + i]) * (1 << 20)) for i in range(12)], "h long, text binary")
    held = texts.select(F.lit(1).cast("long").alias("key"), "h")
    assert crowds.crowd_links(held, spark.createDataFrame([], "node long, root long"), texts, lambda x: line_dedup._sets(x)[:2], 80, f"file://{tmp_path}/c").count() == 0
    assert spark.read.parquet(f"file://{tmp_path}/c/blocks").first().blocks == 3


def test_common_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 20_000, n)).astype(np.uint64) for n in (5, 0, 9_000, 300, 12_000, 1)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    left, right = np.array([0, 2, 4]), np.array([1, 2, 3, 5])
    got = crowds.common_counts(np.concatenate(sets), bounds, left, right)
    assert got.tolist() == [[len(np.intersect1d(sets[a], sets[b])) for b in right] for a in left]


def test_crowded_lines_and_documents(spark):
    """Templates whose variants share keys, some near enough, some not."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(100_000)}"
    base = [word() for _ in range(60)]
    rows = []
    for i in range(120):
        mine = list(base)
        for _ in range(rng.choice([1, 1, 2, 6])):
            mine[rng.randrange(60)] = word()
        rows.append((i, " ".join(mine)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = {i: grams(x) for i, x in rows}
    want = plain_roots(sorted(sets), lambda a, b: jaccard(sets[a], sets[b]) >= SIMILARITY)
    got = {r.doc_id: r.keep_id for r in line_dedup.line_groups(df).collect()}
    assert sum(got[i] == want[i] for i in sets) >= 0.97 * len(sets)
    fives = {i: {tuple(x.split()[k : k + 5]) for k in range(56)} for i, x in rows}
    want = plain_roots(sorted(fives), lambda a, b: jaccard(fives[a], fives[b]) >= SIMILARITY)
    assert {r.doc_id: r.component_id for r in near_documents.near_groups(df).collect()} == want


def test_clashing_columns_and_long_texts(spark):
    names = ["drop", "t", "n", "row", "key", "pos", "kept", "gone_id", "gone_t", "__id", "__t", "__drop", "__n", "__h", "id", "a.b"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    long = " ".join(f"word{i}" for i in range(200_000))
    texts = [long, long + "\nanother line of the text here", "another line of the text here\nand one more of its own", None, "", long]
    df = spark.createDataFrame([(i, t, *names) for i, t in enumerate(texts)], schema).repartition(2)
    out = line_dedup.drop_lines(df, line_dedup.line_groups(df))
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert {i: r.text for i, r in got.items()} == {0: long, 1: "another line of the text here", 2: "and one more of its own", 3: None, 4: ""}
    assert all([r[n] for n in names] == names for r in got.values())


def test_pairs_are_judged_exactly():
    """The bit maps turn away no pair that is similar enough, and what they leave is judged exactly."""
    rng = random.Random(8)
    lines = []
    for k in range(60):
        base = "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([5, 12, 40, 200, 900, 9000])))
        lines += [base, base[: len(base) - len(base) // 8], base[: len(base) // 2] + "X" + base[len(base) // 2 :], base * 2]
    a, b = (np.array(x) for x in zip(*((i, j) for i in range(len(lines)) for j in range(i // 4 * 4, i // 4 * 4 + 4)), strict=True))
    sets = [grams(x) for x in lines]
    want = [jaccard(sets[i], sets[j]) >= SIMILARITY for i, j in zip(a, b, strict=True)]
    assert line_dedup.similar_pairs([x.encode() for x in lines], a, b).tolist() == want


def test_components_at_once_and_in_rounds(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(-500, 500), rng.randrange(-500, 500)) for _ in range(400)] + [(i, i + 1) for i in range(2000, 2200)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(3)
    once, rounds = ({tuple(r) for r in components.components(df, few=n).collect()} for n in (components.FEW, 0))
    assert once == rounds and (2200, 2000) in once
