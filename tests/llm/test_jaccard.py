import collections
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from threadloom.llm.jaccard import bit_width, by_bitmap, by_set, connected, dealt_blocks, group_links, one_of_each, op5_signature_tree_jaccard, signature, similar_components, tree_join, with_first

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, num=80, den=100):
    """The least id reachable from each row, over all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    return sorted(((i, len(s), least[root(n)]) for n, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def text_with(rng, base, changes):
    words = list(base)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"c{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(rng):
    rows = [(None, "only one here"), (3, "Only ONE\there "), (4, None), (5, ""), (5, ""), (6, " \n"), (7, "Ünder ünder"), (8, "ünder ünder")]
    n = 10
    passage = [f"p{i}" for i in range(60)]
    for g in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 12, 40, 150, 400]))]
        for _ in range(rng.randrange(1, 9)):
            body = text_with(rng, base, rng.randrange(0, 1 + len(base) // 25))
            rows.append((n, body + " " + " ".join(passage) if g % 3 == 0 else body))
            n += rng.randrange(1, 3)
    hot = [f"h{i}" for i in range(100)]
    rows += [(n + i, text_with(rng, hot, rng.randrange(0, 4))) for i in range(60)]
    rows += [rows[-1], rows[20]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 2048), (2, 8)])  # with and without large buckets and clusters
def test_components_against_all_pairs(spark, seed, block):
    rows = corpus(random.Random(seed))
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, node string")
    got = similar_components(docs, block=block, sample_docs=50, most_bits=16)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute_components(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert similar_components(docs).count() == 0
    assert one_of_each(docs).count() == 0


def test_one_row_of_each_component_stays(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (2, "a b c d e f", "s"), (3, "", "s"), (4, None, "s"), (5, "x y", "s")], "doc_id long, text string, component_id string")
    got = one_of_each(docs)
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 5]
    assert got.columns == docs.columns


def test_rows_without_id_and_unlike_rows_of_one_id_stay(spark):
    rows = [(None, "no id a b c d e", 1), (None, "no id v w x y z", 2), (None, "no id a b c d e", 3), (7, "seven one two three four", 4), (7, "quite another text of that id", 5), (8, "quite another text of that id", 6), (9, "", 7), (9, "", 8), (None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key long").withColumn("_id", F.lit("x")).withColumn("key", F.lit("y"))
    got = one_of_each(docs)
    assert got.columns == docs.columns
    kept = sorted((r._key for r in got.collect()))
    assert kept[0] in (1, 3) and kept[1:] == [2, 4, 5, 7, 8, 9] if kept[0] == 1 else kept == [2, 3, 4, 5, 7, 8, 9]
    assert {(r._id, r.key) for r in got.collect()} == {("x", "y")}


def test_a_very_long_text_and_its_copies(spark):
    rng = random.Random(2)
    long = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    rows = [(1, " ".join(long)), (2, text_with(rng, long, 2000)), (3, " ".join(reversed(long))), (4, "short one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar_components(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_a_large_bucket_is_dealt_in_proportion_to_its_size(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    sets = []
    for i in range(1000):
        s = base.copy()
        s[i % 200] = rng.integers(0, 2**63, dtype=np.uint64)
        sets.append(np.unique(s))
    rows = [(1, i, len(s), bytearray(s.tobytes())) for i, s in enumerate(sets)]
    schema = "bucket long, node long, n long, payload binary"
    for n in (500, 1000):
        dealt = dealt_blocks(spark.createDataFrame(rows[:n], schema), 100, 1 << 30)
        assert with_first(dealt).count() < 2.5 * n
    members = spark.createDataFrame(rows, schema)
    assert dealt_blocks(members, 1 << 20, 200 * 1600).select("blocks").first()[0] == 5
    found = group_links(members, by_set(80, 100), 80, 100, 100)
    assert {r.label for r in connected(found).collect()} == {0}
    maps = spark.createDataFrame([(1, i, len(s), bytearray(signature(s).tobytes())) for i, s in enumerate(sets)], schema)
    assert {r.label for r in connected(group_links(maps, by_bitmap, 80, 100, 100)).collect()} == {0}


def test_op5_against_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op5_signature_tree_jaccard(spark, sf_dir)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_components(rows)


@pytest.mark.parametrize("leaf", [2, 8])
def test_tree_finds_every_link(leaf):
    rng = np.random.default_rng(leaf)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, rng.choice([1, 3, 20, 90, 700]), dtype=np.uint64)
        for _ in range(6):
            s = base.copy()
            change = rng.random(len(s)) < rng.choice([0.0, 0.05, 0.12])
            s[change] = rng.integers(0, 2**63, int(change.sum()), dtype=np.uint64)
            sets.append(np.unique(s))
    sizes = np.array(list(map(len, sets)))
    bitmaps, alike = by_set(80, 100)([s.view(np.uint8) for s in sets], sizes)
    assert all(len(b) * 8 == bit_width(len(s)) for b, s in zip(bitmaps, sets, strict=True))
    for sides in (np.zeros(len(sets), int), np.arange(len(sets)) % 2 + 1):
        found = tree_join(sizes, bitmaps, sides, alike, 80, 100, leaf=leaf).labels()
        up = np.arange(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                if (sides[i] != sides[j] or not sides[i]) and alike(i, j):
                    up[up == max(up[i], up[j])] = min(up[i], up[j])
        assert (found == up).all()
    assert signature(sets[0]).dtype == np.uint8


def test_connected_on_chains_stars_and_rings(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200}
