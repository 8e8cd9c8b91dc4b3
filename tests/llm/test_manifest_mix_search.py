import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from threadloom.llm import lexical, merkle
from threadloom.llm.lexical import OP13_SQL, Queries, index_documents, op13_block_max_search, search
from threadloom.llm.merkle import FIELDS, OP11_SQL, folded, merkle_manifest, op11_merkle_manifest, proof_digest
from threadloom.llm.mixing import mix, n_words, op12_source_mix, route

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(nodes):
    """The root, and for each node the siblings of each level as (left, right)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for n, p in enumerate(at):
            run = p - p % 3
            paths[n].append(("".join(level[run:p]), "".join(level[p + 1 : run + 3])))
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        at = [p // 3 for p in at]
    return (level[0] if level else None), paths


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        changed = [v.replace("\n", "") if c == "text" and v else v for c, v in zip(FIELDS, r, strict=True)]
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        groups[r[1]].append((r[0] is not None, r[0] or 0, brute_leaf(r), brute_leaf(changed) if hit else brute_leaf(r), r[0]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    root, ways = brute_tree([trees[s][0] for s in order])
    for s, way in zip(order, ways, strict=True):
        for x, path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            node = x[3]
            for left, right in path + way:
                node = sha(left + node + right)
            yield x[4], x[2], trees[s][0], root, sha("".join(a + b for a, b in path + way)), node, node == root


def odd_documents(n=60):
    rng = random.Random(4)
    rows = [(i * 7, f"src{rng.randrange(3)}", rng.choice(["en", None]), rng.randrange(9), rng.choice(["a\nb", "\n", "", None, "é\u0000x", "plain", "y" * 70000])) for i in range(n)]
    rows += [(500, "lone", "en", 1, "a\n"), (501, None, None, None, None), (None, None, "x", 1, "n\n"), (None, "", "x", 1, "n\n"), (3, "src1", "en", 1, "one"), (3, "src1", "en", 1, "two"), rows[0], rows[0]]
    return rows


def test_manifest_of_odd_rows_in_blocks_of_several_rounds(spark, monkeypatch):
    rows = odd_documents()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", leaf string, `g.x` int")
    want = sorted(brute_manifest(rows), key=str)
    for depth in (2, 6):
        monkeypatch.setattr(merkle, "DEPTH", depth)
        monkeypatch.setattr(merkle, "BLOCK", 3**depth)
        changed = merkle.leaf([F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS])
        got = merkle_manifest(df, also={"changed": F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, changed)})
        node = folded(F.coalesce("changed", "leaf"), F.col("path"))
        got = got.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")), node, node == F.col("root"))
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert merkle_manifest(df.limit(0)).count() == 0
    one = merkle_manifest(df.where("source = 'lone'")).collect()
    assert [(r.leaf, r.path) for r in one] == [(one[0].root, [])]


def test_op11_against_sql_and_brute_force(spark, sf_dir, tmp_path):
    import duckdb

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS).collect()]
    got = sorted(map(tuple, op11_merkle_manifest(spark, sf_dir).collect()))
    assert got == sorted(brute_manifest(rows))
    odd = [r for r in odd_documents() if r[0] is not None and "\0" not in (r[4] or "")]
    spark.createDataFrame(odd, DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        found = db.execute(OP11_SQL)
        names = [c[0] for c in found.description]
        place = [names.index(c) for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")]
        assert sorted(tuple(r[i] for i in place) for r in found.fetchall()) == sorted(brute_manifest(odd))


def cost_of(flow, patterns):
    used = Counter()
    for (p, k, _), words in flow.items():
        used[p, k] += words
    assert all(words <= patterns[p][0] for (p, _), words in used.items())
    return sum(k * words for (_, k), words in used.items())


def test_flow_meets_quotas_with_fewest_repetitions():
    rng = random.Random(1)
    for _ in range(60):
        patterns = [(rng.randrange(1, 4), sorted(rng.sample(range(3), rng.randrange(1, 4)))) for _ in range(rng.randrange(1, 4))]
        quotas = {s: rng.randrange(0, 7) for s in range(3)}
        got = route(patterns, quotas, 3)
        reached = Counter()
        for (p, _, s), words in got.items():
            assert s in patterns[p][1]
            reached[s] += words
        assert all(reached[s] <= quotas[s] for s in quotas)
        # every way to send words from patterns to sources
        best = (0, 0)
        choices = [[(p, s, n) for n in range(0, min(3 * w, quotas[s]) + 1)] for p, (w, ss) in enumerate(patterns) for s in ss]
        if math.prod(map(len, choices)) > 60_000:
            continue
        for way in itertools.product(*choices):
            by_p, by_s = Counter(), Counter()
            for p, s, n in way:
                by_p[p] += n
                by_s[s] += n
            if all(by_p[p] <= 3 * w for p, (w, _) in enumerate(patterns)) and all(by_s[s] <= quotas[s] for s in quotas):
                cost = sum(max(0, by_p[p] - w) + max(0, by_p[p] - 2 * w) for p, (w, _) in enumerate(patterns))
                best = max(best, (sum(by_s.values()), -cost))
        assert (sum(reached.values()), -cost_of(got, patterns)) == best


def brute_targets(sizes, weights, total):
    target, open_ = {}, set(sizes)
    while True:
        left, weight = total - sum(target.values()), sum(weights[s] for s in open_)
        above = [s for s in open_ if left * weights[s] / weight > 3 * sizes[s]]
        if not above:
            return target | {s: left * weights[s] / weight for s in open_}
        for s in above:
            target[s] = 3.0 * sizes[s]
            open_.remove(s)


def test_words_are_counted_like_runs(spark):
    texts = ["", None, " ", "a", " a\tb\n", " ", "a b c", "\x0b\x0c\rz", "x" * 100000, "é è"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", n_words(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_mix_of_overlapping_sources(spark):
    rng = random.Random(3)
    sets = [["a"], ["b"], ["a", "b"], ["b", "c"], ["d"], [None], [None, "d"], [], None, ["e", "e"], ["tiny"]]
    weights = [0.2, 0.2, 0.1, 0.05, 0.05, 0.1, 0.05, 0.02, 0.02, 0.2, 0.01]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 12, 40, 200])), s) for i, s in enumerate(rng.choices(sets, weights, k=900))]
    rows += [(None, "n n n", ["a"]), (5, None, ["a"]), rows[7], rows[7]] + [(2000 + i, "same words here", ["a"]) for i in range(300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, sources array<string>, size int")
    docs, sources = mix(df, F.when(F.col("number") == 0, 6).otherwise(1))
    got, named = docs.collect(), sources.collect()
    assert len(got) == len(rows) and [r.source for r in sorted(named, key=lambda r: r.number)] == ["a", "b", "c", "d", "e", "tiny", None]
    total = sum(r.size for r in got)
    size = Counter()
    for r in got:
        for s in set(r.sources):
            size[s] += r.size
    want = brute_targets(size, defaultdict(lambda: 1, a=6), total)
    assert {r.source: pytest.approx(r.target) for r in named} == want
    of = {r.number: r.source for r in named}
    reached = Counter()
    for r in got:
        assert r.taken == r.size * len(r.passes) and len(r.passes) <= 3
        assert len({p["pass"] for p in r.passes}) == len(r.passes)
        for p in r.passes:
            assert of[p.number] in r.sources
            reached[of[p.number]] += r.size
    for s, t in want.items():
        assert abs(reached[s] - t) <= max(0.03 * t, 8), (s, reached[s], t)
    again = mix(df.repartition(7), F.when(F.col("number") == 0, 6).otherwise(1))[0].collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken, str(r.passes))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mix(df.limit(0))[0].count() == 0


def test_op12_comes_near_its_targets(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op12_source_mix(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        s = docs[r.doc_id].source
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or "")) and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
    assert all(r.source_size == sizes[docs[r.doc_id].source] for r in got)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert target == {s: pytest.approx(t) for s, t in brute_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, sum(sizes.values())).items()}
    assert all(abs(taken[s] - t) <= 0.06 * t for s, t in target.items())


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k):
    texts = [(i, Counter(terms(t))) for i, t in docs]
    texts = [(i, c) for i, c in texts if c]
    n_docs, n_terms, df = len(texts), sum(sum(c.values()) for _, c in texts), Counter(t for _, c in texts for t in c)
    for item, text in sorted(set(items), key=str):
        scores = []
        for i, c in texts:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1):
            yield item, rank, i, -s


def odd_search(n=400):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["Äpfel", "ÄPFEL", "x_y", "日本", "a1"]
    text = lambda m: " ".join(rng.choices(words, [1 / (1 + i) for i in range(len(words))], k=m))
    docs = [(i, text(rng.choice([1, 5, 30, 200]))) for i in range(n)]
    docs += [(1000 + i, "w1 w2 copy") for i in range(150)] + [(None, "w1 w2 copy"), (None, "w59 alone"), (7, docs[7][1]), (2000, None), (2001, ""), (2002, "... !!"), (2003, "w3 " * 50000), (2004, "zebra\u0000W59.w59\x7fZEBRA")]
    items = [(i, text(6)) for i in range(12)] + [(20, "copy w1"), (21, "unknown words"), (22, None), (23, "..."), (24, "w0 w0 w0 Zebra"), (24, "W1"), (24, "W1"), (None, "Äpfel ÄPFEL"), (25, text(3000))]
    return docs, items


@pytest.mark.parametrize(("k", "block", "group"), [(1, 3, 8), (500, 128, 1000)])
def test_search_of_odd_rows(spark, k, block, group):
    docs, items = odd_search()
    index = index_documents(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, term int").repartition(3), block)
    queries = spark.createDataFrame(items, "item_id long, text string")
    got = search(index, queries, k, first=2, group_items=group)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_search(docs, items, k), key=str)
    if k == 1:
        assert search(index.limit(0), queries, k).count() == 0
        assert search(index, queries.limit(0), k).count() == 0


def test_index_has_few_blocks_in_a_row_group(spark):
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(200)], "doc_id long, text string").coalesce(1)
    index = index_documents(docs, 2)
    groups = [m.row_group(g).num_rows for m in (pq.read_metadata(f.removeprefix("file://")) for f in index.inputFiles()) for g in range(m.num_row_groups)]
    assert sum(groups) == index.count() == 100
    assert max(groups) <= 16


def test_search_leaves_out_blocks_below_the_threshold():
    rng = random.Random(2)
    docs = [(i, " ".join(f"t{rng.randrange(3000)}" for _ in range(40)).encode()) for i in range(2000)]
    for i in (5, 300, 900, 1700):
        docs[i], docs[i + 1] = (i, docs[77][1] + b" t1"), (i + 1, docs[1500][1] + b" t2")
    q = Queries.of([(0, docs[77][1]), (1, docs[1500][1])])
    rows = [lexical.packed_block(b, docs[b * 20 : b * 20 + 20]) for b in range(100)]
    names = [c.split()[0] for c in f"{lexical.LIGHT}, {lexical.FORWARD}".split(", ")]
    import numpy as np
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(len(names))], names=names)
    df = np.zeros(len(q.terms), np.int64)
    blocks = list(lexical._read([batch], q, names))
    for b in blocks:
        np.add.at(df, b.known, b.df())
    q.weigh(df, sum(r[1] for r in rows), sum(r[2] for r in rows))
    best, scored = lexical.Best(3, np.zeros(2, np.int64)), 0
    for b in sorted(blocks, key=lambda b: -b.bounds().max()):
        bounds = b.bounds()
        _, exact = b.scores(np.arange(2))
        assert (exact.max(axis=1) <= bounds).all()
        items = np.flatnonzero((bounds > 0) & (bounds >= best.least))
        scored += len(items)
        best.add(b, items)
    assert scored < 0.6 * 200


def test_op13_against_sql_and_brute_force(spark, sf_dir, tmp_path):
    import duckdb

    read = lambda t, i: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(i, "text").collect()]
    got = sorted(map(tuple, op13_block_max_search(spark, sf_dir).collect()))
    assert got == sorted(brute_search(read("documents", "doc_id"), read("benchmark", "item_id"), 20))
    docs, items = odd_search(50)
    docs, items = [d for d in docs if d[0] is not None and "\0" not in (d[1] or "")], [i for i in items if i[0] is not None]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    with duckdb.connect() as db:
        for t in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        found = db.execute(OP13_SQL)
        names = [c[0] for c in found.description]
        place = [names.index(c) for c in ("item_id", "rank", "doc_id", "score")]
        assert sorted(tuple(r[i] for i in place) for r in found.fetchall()) == sorted(brute_search(docs, items, 20))
