"""Mixing sources to target weights by min-cost flow, for documents that may lie in several sources.

Documents with the same sources form a membership pattern, of which only the sum of words is kept. Words flow from patterns
to the quotas of their sources: the first pass over a pattern costs nothing, every further one more than the one before, so
that the flow repeats as little as it can. The flow is solved for each connected part of patterns and sources alone.
Then documents are drawn to the amounts: a seeded hash orders the documents of a pattern, by classes of size, largest first;
running sums cut the order where a source's amount ends, and each class makes up for what the cuts before it rounded.

Targets: sources share the words of all documents by weight; a target stops at ``most`` times its source, and the rest is
shared again by weight until none is above.

Running sums are taken by ranges (``running``), so a pattern with a third of all documents is many tasks. Through one task
goes a connected part of patterns: a row for each set of sources that occurs, never documents. The driver sees sums alone.

Defined cases: a null text has no words; a null source is one of its own and the last; a null or empty list of sources is
no source, and its documents are not taken; equal names in a list count once; repeated rows are documents each, and such as
are alike in everything are interchangeable; a document without words is taken no word of; sources without a weight have
target 0; an empty table gives an empty one; other columns are left out, whatever their names. A very long text is taken
whole or not, so a target may be missed by half the size of a document in the last class that a pattern has.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .jaccard import connected
from .shared import running, written

#: Documents are drawn by classes of this power of their size.
CLASS_BITS = 4


def n_words(text: Column) -> Column:
    """Runs of characters other than space and \\x09-\\x0D."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "a"), " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, total: int, most: int = 3) -> DataFrame:
    """sizes(number, source, source_size, weight) with target: total shared by weight, at most most times the size."""
    cap = (F.col("source_size") * most).cast("double")
    state = sizes.withColumn("target", F.lit(None).cast("double"))
    while True:
        open_ = F.col("target").isNull() & (F.coalesce("weight", F.lit(0)) > 0)
        left, weight = state.agg(F.lit(float(total)) - F.coalesce(F.sum("target"), F.lit(0.0)), F.sum(F.when(open_, F.col("weight")))).first()
        if not weight:
            return state.fillna(0.0, ["target"])
        share = F.lit(left) * F.col("weight") / F.lit(weight)
        if not state.where(open_ & (share > cap)).take(1):
            return state.withColumn("target", F.when(open_, share).otherwise(F.coalesce("target", F.lit(0.0))))
        state = written(state.withColumn("target", F.when(open_ & (share > cap), cap).otherwise(F.col("target"))), "mix-targets")


def route(patterns: list[tuple[int, list[int]]], quotas: dict[int, int], most: int) -> dict[tuple[int, int, int], int]:
    """Min-cost flow: (pattern, pass, source) -> words, for patterns of (words, sources); successive shortest ways with potentials.

    Every word that a way carries is worth the cost of the pass it opens, 0, 1, 2, ...; so quotas are met as far as the
    patterns reach, with the fewest repetitions. Ways go by the least pattern and source at ties.
    """
    begin, end = 0, 1
    node_of = {s: 2 + len(patterns) + i for i, s in enumerate(sorted(quotas))}
    ways: list[list[int]] = [[] for _ in range(2 + len(patterns) + len(quotas))]
    to, room, cost = [], [], []

    def edge(a: int, b: int, most_words: int, price: int) -> int:
        ways[a].append(len(to))
        ways[b].append(len(to) + 1)
        to.extend((b, a)), room.extend((most_words, 0)), cost.extend((price, -price))
        return len(to) - 2

    passes, members = {}, {}
    for p, (words, sources) in enumerate(patterns):
        for k in range(most):
            passes[p, k] = edge(begin, 2 + p, words, k)
        for s in sources:
            members[p, s] = edge(2 + p, node_of[s], most * words, 0)
    for s, quota in sorted(quotas.items()):
        edge(node_of[s], end, quota, 0)
    height = [0] * len(ways)
    while True:
        best, came = {begin: 0}, {}
        heap, done = [(0, begin)], set()
        while heap:
            d, a = heapq.heappop(heap)
            if a in done:
                continue
            done.add(a)
            for e in ways[a]:
                if room[e] and (x := d + cost[e] + height[a] - height[to[e]]) < best.get(to[e], x + 1):
                    best[to[e]], came[to[e]] = x, e
                    heapq.heappush(heap, (x, to[e]))
        if end not in best:
            break
        far = max(best.values())
        height = [h + best.get(v, far) for v, h in enumerate(height)]
        v, way = end, []
        while v != begin:
            way.append(came[v])
            v = to[came[v] ^ 1]
        words = min(room[e] for e in way)
        for e in way:
            room[e] -= words
            room[e ^ 1] += words
    # a pattern's passes, filled in order, are dealt to its sources in order
    out = {}
    for p, (_, sources) in enumerate(patterns):
        wanted = [(s, room[members[p, s] ^ 1]) for s in sources]
        for k in range(most):
            free = room[passes[p, k] ^ 1]
            for i, (s, words) in enumerate(wanted):
                if take := min(words, free):
                    out[p, k, s] = take
                    wanted[i], free = (s, words - take), free - take
    return out


def flows(patterns: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """pattern, pass, source (number), words: what goes from patterns(pattern, words, numbers) to the sources, part by part."""
    each = patterns.select("pattern", "words", F.explode("numbers").alias("number"))
    pairs = patterns.where(F.size("numbers") > 1).select(F.explode(F.transform(F.slice("numbers", F.lit(2), F.size("numbers") - 1), lambda n: F.struct(F.element_at("numbers", 1).alias("a"), n.alias("b")))).alias("x")).select("x.a", "x.b")
    if pairs.take(1):
        parts = written(connected(pairs), "mix-parts")
        each = each.join(parts.withColumnRenamed("node", "number"), "number", "left").withColumn("part", F.coalesce("label", "number")).drop("label")
    else:
        each = each.withColumn("part", F.col("number"))
    rows = each.join(targets.select("number", F.round("target").cast("long").alias("quota")), "number")

    def solve(key, table):
        import pandas as pd

        names = sorted(set(table["pattern"]))
        place = {name: i for i, name in enumerate(names)}
        sizes, sources = [0] * len(names), [[] for _ in names]
        for r in table.sort_values(["pattern", "number"]).itertuples():
            sizes[place[r.pattern]] = int(r.words)
            sources[place[r.pattern]].append(int(r.number))
        quotas = dict(zip(map(int, table["number"]), map(int, table["quota"]), strict=True))
        found = route(list(zip(sizes, sources, strict=True)), quotas, most)
        return pd.DataFrame([(names[p], k, s, words) for (p, k, s), words in found.items()], columns=["pattern", "pass", "number", "words"])

    return rows.groupBy("part").applyInPandas(solve, "pattern string, pass int, number long, words long")


def drawn(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs(id, size, pattern, draw, mark) with passes: of each pass that takes the document, the number of the source it goes to.

    plan: pattern, words, cuts(pass, number, upto): how many words of the order of a pass end with a source's part.
    """
    group = F.floor(F.log2(F.greatest("size", F.lit(1))) / CLASS_BITS).cast("int")
    rows = docs.withColumn("smallness", -group)
    rows = running(rows, ["pattern", "smallness"], ["draw", "id", "size", "mark"], {"ahead": "size"}, "mix-order")
    rows = written(rows.withColumn("middle", F.col("ahead") + F.col("size") / 2), "mix-drawn")
    shares = rows.groupBy("pattern", "smallness").agg(F.first("ahead_all").alias("class_words"))
    # cuts inside of a pass; those at its ends take all or nothing
    cuts = plan.select("pattern", "words", F.explode("cuts").alias("c")).select("pattern", "words", "c.*")
    state = written(cuts.withColumn("carry", F.lit(0.0)), "mix-cuts")
    ends = None
    for (smallness,) in sorted(shares.select("smallness").distinct().collect()):  # a handful of powers
        here = state.join(shares.where(F.col("smallness") == smallness), "pattern").withColumn("end", F.col("upto") * (F.col("class_words") / F.col("words")) + F.col("carry"))
        here = written(here.select("pattern", "pass", "number", "smallness", "end"), "mix-ends")
        taken = rows.where(F.col("smallness") == smallness).select("pattern", "middle", "size").join(here, "pattern").where(F.col("middle") < F.col("end")).groupBy("pattern", "pass", "number").agg(F.sum("size").alias("taken"))
        ends = here if ends is None else ends.unionByName(here)
        rest = here.join(taken, ["pattern", "pass", "number"], "left").select("pattern", "pass", "number", (F.col("end") - F.coalesce("taken", F.lit(0))).alias("over"))
        state = written(state.join(rest, ["pattern", "pass", "number"], "left").withColumn("carry", F.coalesce("over", "carry")).drop("over"), "mix-cuts")
    if ends is None:
        return rows.withColumn("passes", F.array().cast("array<struct<pass:int,number:long>>"))
    lists = ends.groupBy("pattern", "smallness").agg(F.array_sort(F.collect_list(F.struct("pass", "end", "number"))).alias("ends"))
    mine = F.filter("ends", lambda e: F.col("middle") < e["end"])
    # of the cuts of a pass beyond the document's middle the first counts
    first = F.filter(mine, lambda e: ~F.exists(mine, lambda o: (o["pass"] == e["pass"]) & ((o["end"] < e["end"]) | ((o["end"] == e["end"]) & (o["number"] < e["number"])))))
    found = rows.join(lists, ["pattern", "smallness"], "left")
    return found.withColumn("passes", F.coalesce(F.transform(first, lambda e: F.struct(e["pass"].alias("pass"), e["number"].alias("number"))), F.array().cast("array<struct<pass:int,number:long>>")))


def planned(flow: DataFrame, patterns: DataFrame) -> DataFrame:
    """The plan of ``drawn`` for what flows: in each pass over a pattern its sources come one after the other."""
    upto = F.sum("words").over(Window.partitionBy("pattern", "pass").orderBy("number"))
    cuts = flow.select("pattern", "pass", "number", upto.alias("upto")).groupBy("pattern").agg(F.collect_list(F.struct("pass", "number", "upto")).alias("cuts"))
    return written(cuts.join(patterns.select("pattern", "words"), "pattern").where("words > 0"), "mix-plan")


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """sizes(source, source_size) with number: the rank by code point, null last."""
    ranked = running(sizes.select("source", "source_size", F.col("source").isNull().alias("last"), F.lit("").alias("all")), ["all"], ["last", "source"], {"number": "1"}, "mix-sources")
    return ranked.select("source", "source_size", "number")


def mix(docs: DataFrame, weight: Column | None = None, most: int = 3, seed: int = 12, tolerance: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """Of docs(doc_id, text, sources): documents (doc_id, size, sources, taken, passes), and sources (source, source_size, weight, target).

    weight: the weight of a source as a column over source, source_size and number (its rank by code point, null last);
    equal for all if left out. tolerance: what a source may fall short of before more is drawn in a further pass. passes: for each time that the mix takes a document, the number of the source it counts for.
    """
    sources = F.array_sort(F.array_distinct(F.coalesce("sources", F.array().cast("array<string>"))))
    pattern = F.to_json(sources)
    items = docs.select(F.col("doc_id").alias("id"), n_words(F.col("text")).alias("size"), pattern.alias("pattern"), F.xxhash64(F.lit(seed), "doc_id").alias("draw"), F.xxhash64("text").alias("mark"))
    items = written(items, "mix-items")
    patterns = written(items.groupBy("pattern").agg(F.sum("size").alias("words")).withColumn("sources", F.from_json("pattern", "array<string>")), "mix-patterns")
    each = patterns.select("pattern", "words", F.explode("sources").alias("source"))
    numbers = written(numbered_sources(each.groupBy("source").agg(F.sum("words").alias("source_size"))), "mix-numbers")
    total = patterns.agg(F.sum("words")).first()[0] or 0
    targets = written(source_targets(numbers.withColumn("weight", (F.lit(1) if weight is None else weight).cast("double")), total, most), "mix-sources")
    known = each.join(numbers, each["source"].eqNullSafe(numbers["source"])).groupBy("pattern", "words").agg(F.array_sort(F.collect_list("number")).alias("numbers"))
    flow = written(flows(written(known, "mix-known"), targets, most), "mix-flow")
    rows = drawn(items, planned(flow, patterns))
    # where documents are larger than what is wanted of them, the next pass over the smaller ones makes up for it
    taken = rows.select("pattern", "size", F.explode("passes").alias("p")).groupBy("pattern", F.col("p.number").alias("number")).agg(F.sum("size").alias("taken"))
    wanted = flow.groupBy("pattern", "number").agg(F.sum("words").alias("wanted"), F.max("pass").alias("last"))
    short = wanted.join(taken, ["pattern", "number"], "left").withColumn("short", F.col("wanted") - F.coalesce("taken", F.lit(0)))
    short = written(short.where((F.col("short") > F.col("wanted") * tolerance) & (F.col("last") + 1 < most)), "mix-short")
    if short.take(1):
        more = short.join(patterns.select("pattern", F.col("words").alias("all")), "pattern").select("pattern", (F.col("last") + 1).alias("pass"), "number", F.least("short", "all").cast("long").alias("words"))
        rows = drawn(items, planned(flow.unionByName(more), patterns))
    out = rows.select(F.col("id").alias("doc_id"), "size", F.from_json("pattern", "array<string>").alias("sources"), (F.col("size") * F.size("passes")).alias("taken"), "passes")
    return out, targets


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.array("source").alias("sources"))
    weight = F.when(F.col("number") % 3 == 0, 5).when(F.col("number") % 3 == 1, 2).otherwise(1)
    rows, sources = mix(docs, weight)
    source = F.element_at("sources", 1)
    return rows.join(sources, source.eqNullSafe(sources["source"])).select("doc_id", "size", "source_size", "target", "taken")
