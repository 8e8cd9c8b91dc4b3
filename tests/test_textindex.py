import itertools
import random
from dataclasses import replace

from graphs import graph, names, node
from pyspark.sql import functions as F

from threadloom.operators import search, textindex
from threadloom.operators.textindex import BlockSearch

WORDS = ["fold", "folder", "row", "rows", "Mill", "mill_race", "é"]


def symbols(spark, rng, n):
    pick = lambda k: "_".join(rng.choice(WORDS) for _ in range(k))
    rows = [node(i, pick(rng.randint(1, 4)), kind=rng.choice(["function", "class"]), qualified_name=rng.choice([None, pick(3), f"m::{pick(2)}"])) for i in range(1, n + 1)]
    return graph(spark, rows, [(1, 2, "calls")])


def with_names(g):
    return replace(g, names=textindex.stored(textindex.name_places(g.nodes), "t", "token", "id"))


def test_places_of_names_answer_like_the_scan(spark):
    g = symbols(spark, random.Random(3), 300)
    h = with_names(g)
    for q, kind in [("fold", None), ("fold row", None), ("row row", None), ("row row row", "class"), ("mill race fo", None), ("m fold", "function"), ("Fold-ROW", None), ("é ro", None), ("--", None), ("nothing here", None), ("e", None), ('f"', None), ("row fold fol", None)]:
        assert search.search_names(h, q, kind, 50).collect() == search.search_names(g, q, kind, 50).collect(), q
    one = with_names(graph(spark, [node(1, "ab ab ab abc", qualified_name=None)], [(1, 1, "calls")]))
    assert names(search.search_names(one, "ab ab ab")) == ["ab ab ab abc"]  # tokens that fit several places
    assert names(search.search_names(one, "ab ab ab ab ab")) == []
    none = with_names(replace(g, nodes=g.nodes.limit(0)))
    assert names(search.search_names(none, "fold")) == []


def scanned_rows(df):
    """Rows that the scans of a query gave out, after it ran."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    if "AdaptiveSparkPlan" in plan.nodeName():
        plan = plan.executedPlan()
    todo = [plan]
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("Scan parquet"):
            total += p.metrics().get("numOutputRows").get().value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return total


def test_a_phrase_reads_the_pages_of_its_tokens(spark):
    spread = spark.range(40000).select("id", F.lit("function").alias("kind"), F.lit(None).cast("string").alias("qualified_name"), F.format_string("w%05d of", "id").alias("name"))
    index = textindex.stored(textindex.name_places(spread), "t", "token", "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for words in (["w01234"], ["w0123"], ["w31234"]):
            assert textindex.phrase_hits(index, words).count() >= 1
            assert scanned_rows(index.where(F.col("token").startswith(words[-1])).select("token", "id")) <= 2 * textindex.PAGE_ROWS
        assert scanned_rows(index.where("token >= ''").select("token", "id")) == 80000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def table_of(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id long, t string").select("id", F.filter(F.split("t", " "), lambda x: x != "").alias("tokens"))


def compare(spark, texts, queries, limit=20, first=1):
    docs = table_of(spark, texts)
    flat, totals = textindex.postings(docs), textindex.totals_of(docs)
    blocks = textindex.stored(textindex.posting_blocks(docs), "t", "token", "block")
    assert blocks.where(F.size("at") > 1 << textindex.BLOCK).isEmpty()
    for q in queries:
        want = [(r.id, r.score) for r in search.bm25(flat, totals, q.split(), limit).collect()]
        got = [(r.id, r.score) for r in BlockSearch(blocks, totals, q.split(), limit, first).rows().collect()]
        assert [i for i, _ in got] == [i for i, _ in want], q
        assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, want, strict=True))
    return blocks, totals


def test_blocks_rank_like_the_sum_of_all_postings(spark):
    rng = random.Random(9)
    texts = {i * 40 - 2000: " ".join(rng.choices("a b c d e f".split(), [9, 5, 3, 2, 1, 1], k=rng.randint(0, 30))) for i in range(400)}
    texts |= {100000 + i: "a b" for i in range(30)}  # ties
    queries = ["a", "f", "a b", "b a b", "e f", "a b c d e f", "x", "a x", ""]
    for limit, first in itertools.product((1, 20), (1, 4)):
        compare(spark, texts, queries, limit, first)
    compare(spark, {}, ["a"])
    compare(spark, {1: ""}, ["a"])


def test_weak_blocks_are_left_out(spark):
    texts = {i: "b " * 20 + "a" for i in range(20 << textindex.BLOCK)}
    texts |= {(7 << textindex.BLOCK) + i: "a a a" for i in range(30)}
    blocks, totals = compare(spark, texts, ["a"], 20, 1)
    search_ = BlockSearch(blocks, totals, ["a"], 20, 1)
    assert [r.block for r in search_.needed().collect()] == [7]
    assert search_.bounds().count() == 20
