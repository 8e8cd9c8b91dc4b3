"""N-gram Jaccard join with signature trees: components of documents whose shingle sets are alike, exactly.

1. Each document's set of hashed word shingles; equal sets are one node of the graph (``row`` of the first of them).
2. Two sets with Jaccard >= t share one of the first n - ceil(t n) + 1 shingles in any common order. The order here: first
   shingles that only one set has, as a merged count-min sketch of part of all shingles can tell for sure; then by hash;
   last, those that are frequent in a bounded sample. Sketch and sample decide speed, not results. Lone shingles need no
   partner, so unlike documents hardly send anything. The others are counted exactly. Nodes that share a shingle form a
   bucket; buckets with the same members are one.
3. In a bucket a signature tree (nodes with OR-combined bitmaps and size ranges) is traversed against
   itself; pairs of tree nodes go when even the largest possible overlap is too small. What stays may be alike; a spanning
   forest of it is enough. Its components are the clusters.
4. In a cluster, sets meet each other: the same tree, now with exact intersections, and union-find, which spares pairs
   already connected.
Large buckets and clusters are dealt in blocks, by number and by bytes: each block by itself and with the first block, and
only if several components are left, all members of the smaller ones with every block.

So no task holds more than two blocks, and a group of many near copies costs about its size, not its square.
Shingle hashes have 64 bits and sets are told apart by 128 bits.

Defined cases: fewer words than ``k`` make one shingle; no words (or null): an empty set, linked with nothing; equal sets
are linked; repeated rows are rows of one node; a null doc_id never is a component's id unless all its members have none;
a very long text is one set, which one worker holds; other columns are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_rows, batches, forget, fresh, hashed_words, named, spread, windows, written
from .sketch import may_hold, merged_sketch

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
UNIT = ["bucket", "i", "j"]
#: Shingles below this hash (three of eight) are counted by the sketch: more of a set than its prefix has places.
COUNTED = np.uint64(3 << 61)


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """A sorted array of distinct hashes for each text."""
    ids, counts = hashed_words([t.translate(LOWER) if t else t for t in texts])
    first = np.cumsum(counts) - counts
    hashes = windows(ids, k)
    out = []
    for n, at in zip(counts.tolist(), first.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(hashes[at : at + n - k + 1]))
        else:
            out.append(windows(ids[at : at + n], n, salt=8 * n) if n else np.empty(0, np.uint64))
    return out


def bit_width(n: int) -> int:
    """Bits of the signature of a set of n: two to four for each, 64 at least and 2**17 at most."""
    return 1 << min(max(int(2 * n - 1).bit_length(), 6), 17)


def signature(tokens: np.ndarray) -> np.ndarray:
    width = bit_width(len(tokens))
    bits = np.zeros(width, np.uint8)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def folded(bitmap: np.ndarray, width: int) -> np.ndarray:
    """The signature at a smaller width, as uint64 words."""
    words = bitmap.view(np.uint64)
    while len(words) * 64 > width:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return words


class Forest:
    """Union-find that keeps the links it made."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))

    def labels(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))], np.int64)


def tree_join(sizes: np.ndarray, bitmaps: list[np.ndarray], sides: np.ndarray, alike, num: int, den: int, forest: Forest | None = None, leaf: int = 8, fan: int = 4) -> Forest:
    """Connects members that may reach Jaccard num / den and for which alike(i, j) holds.

    sides: members of sides 1 and 2 are compared across only; members of side 0 with all.
    """
    n = len(sizes)
    forest = forest or Forest(n)

    def test(i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if forest.root(a) != forest.root(b) and alike(a, b):
                forest.link(a, b)

    widths = np.array([bit_width(int(s)) for s in sizes])
    for width in np.unique(widths).tolist():
        # a set can be like one of its own width, or of the next, whose signature is folded
        mine = np.flatnonzero((widths == width) | (widths == 2 * width))
        if len(mine) < 2 or not (widths[mine] == width).any():
            continue
        bits = np.stack([folded(bitmaps[i], width) for i in mine])
        extra = sizes[mine] - np.bitwise_count(bits).sum(axis=1).astype(np.int64)  # shingles without a bit of their own
        order = np.lexsort((bits[:, 0], sizes[mine]))
        mine, bits, extra = mine[order], bits[order], extra[order]
        size, side, own = sizes[mine], sides[mine], widths[mine] == width

        def bound(a: np.ndarray, b: np.ndarray, level) -> np.ndarray:
            """Whether members under tree nodes a and b can be alike: overlap * (num + den) >= num * (sum of sizes)."""
            lo, hi, ex, ors = level
            fits = (hi[a] * den >= lo[b] * num) & (hi[b] * den >= lo[a] * num)
            out = np.zeros(len(a), bool)
            at = np.flatnonzero(fits)
            for c in range(0, len(at), 1 << 14):
                x, y = a[at[c : c + (1 << 14)]], b[at[c : c + (1 << 14)]]
                most = np.bitwise_count(ors[x] & ors[y]).sum(axis=1).astype(np.int64) + np.minimum(ex[x], ex[y])
                most = np.minimum(most, np.minimum(hi[x], hi[y]))
                out[at[c : c + (1 << 14)]] = most * (num + den) >= num * (lo[x] + lo[y])
            return out

        members = (size, size, extra, bits)
        if len(mine) > 2 * leaf:
            # near copies are neighbours in this order or like the first; that connects most of a group at once
            near = np.r_[np.arange(len(mine) - 1), np.zeros(len(mine) - 1, np.int64)], np.r_[np.arange(1, len(mine)), np.arange(1, len(mine))]
            good = bound(*near, members) & (own[near[0]] | own[near[1]]) & ~((side[near[0]] == side[near[1]]) & (side[near[0]] > 0))
            test(mine[near[0][good]], mine[near[1][good]])
        levels, starts = [members], np.arange(len(mine))
        groups = [np.arange(len(mine))]
        step = leaf
        while len(levels[-1][0]) > 1:
            cut = np.arange(0, len(levels[-1][0]), step)
            lo, hi, ex, ors = levels[-1]
            levels.append((np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(ex, cut), np.bitwise_or.reduceat(ors, cut, axis=0)))
            groups.append(cut)
            step = fan
        label = forest.labels()[mine]
        uniform = [label]  # the one component of all members, or -1
        for at in range(1, len(levels)):
            cut = groups[at]
            lo, hi = np.minimum.reduceat(uniform[-1], cut), np.maximum.reduceat(uniform[-1], cut)
            uniform.append(np.where(lo == hi, lo, -1))
        top = len(levels) - 1
        todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            at, a, b = todo.pop()
            one = uniform[at]
            keep = ~((one[a] == one[b]) & (one[a] >= 0))
            a, b = a[keep], b[keep]
            ok = bound(a, b, levels[at])
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            if at == 0:
                good = (a < b) & (own[a] | own[b]) & ~((side[a] == side[b]) & (side[a] > 0))
                test(mine[a[good]], mine[b[good]])
                continue
            ends = np.r_[groups[at][1:], len(levels[at - 1][0])]
            for c in range(0, len(a), 4096):
                x, y = a[c : c + 4096], b[c : c + 4096]
                nx, ny = ends[x] - groups[at][x], ends[y] - groups[at][y]
                pair = spread(nx * ny)
                k = np.arange(len(pair)) - np.repeat(np.cumsum(nx * ny) - nx * ny, nx * ny)
                i, j = groups[at][x][pair] + k // ny[pair], groups[at][y][pair] + k % ny[pair]
                once = (x[pair] != y[pair]) | (i <= j)
                todo.append((at - 1, i[once], j[once]))
    return forest


def document_sets(docs: DataFrame, k: int, num: int, den: int, sample_docs: int, most_bits: int) -> DataFrame:
    """Written: row, doc_id, key, n, digest, bitmap and prefix.

    prefix: of the first n - ceil(t n) + 1 shingles, in the common order, those that another set may have.
    """
    docs = docs.select("doc_id", "text")
    total = docs.count()
    # about eight cells of the sketch for each counted shingle, up to a broadcast of 2**most_bits / 8 bytes
    width_bits = min(most_bits, max(14, int(1024 * total).bit_length()))

    def counted(record_batches):
        for part in batches(arrow_rows(record_batches, "text"), lambda r: len(r[0] or b""), 4 << 20):
            tokens = np.concatenate(shingle_sets([r[0] for r in part], k))
            yield tokens[tokens < COUNTED]

    sketch = merged_sketch(docs.select("text"), counted, 1, width_bits)

    def sampled(record_batches):
        import pyarrow as pa

        for part in batches(arrow_rows(record_batches, "text"), lambda r: len(r[0] or b""), 4 << 20):
            tokens, n = np.unique(np.concatenate(shingle_sets([r[0] for r in part], k)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n)], names=["token", "n"])

    share = min(1.0, sample_docs / max(total, 1))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # frequent in the sample: in one of 200 of its documents; a bounded list, as the sample is
    hot = drawn.select("text").mapInArrow(sampled, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= max(8, int(share * total) // 200)).orderBy(F.desc("n"), "token").limit(1 << 17)
    frequent = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r.token for r in hot.collect()], np.int64).view(np.uint64)))

    def run(record_batches):
        import pyarrow as pa
        import xxhash

        late = frequent.value
        for part in batches(arrow_rows(record_batches, "doc_id", "text", "_key"), lambda r: len(r[1] or b""), 4 << 20):
            sets = shingle_sets([r[1] for r in part], k)
            tokens = np.concatenate(sets)
            lone = tokens < COUNTED
            lone[lone] = ~may_hold(sketch.value, tokens[lone], width_bits)
            common = np.zeros(len(tokens), bool)
            if len(late):
                common = late[np.minimum(np.searchsorted(late, tokens), len(late) - 1)] == tokens
            digests, bitmaps, prefixes, sizes, at = [], [], [], [], 0
            for s in sets:
                n = len(s)
                sizes.append(n)
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                bitmaps.append(signature(s).tobytes() if n else None)
                # no other set has a lone shingle: it takes a place, first, and goes to no bucket
                own, rare = lone[at : at + n], ~(lone[at : at + n] | common[at : at + n])
                places = n - -(-num * n // den) + 1 - int(own.sum())
                prefixes.append(np.r_[s[rare], s[~own & ~rare]][:places].tobytes() if n and places > 0 else None)
                at += n
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bitmaps, pa.binary()), pa.array(prefixes, pa.binary())], names=["doc_id", "key", "n", "digest", "bitmap", "prefix"])

    made = docs.withColumn("_key", F.xxhash64("text")).mapInArrow(run, "doc_id long, key long, n long, digest binary, bitmap binary, prefix binary")
    return written(made.withColumn("row", F.monotonically_increasing_id()), "jaccard-sets")


def buckets(nodes: DataFrame) -> DataFrame:
    """Members of the distinct buckets of two or more nodes: bucket, node."""

    def tokens_of(record_batches):
        import pyarrow as pa

        for rb in record_batches:
            parts = [np.frombuffer(x, np.int64) for x in rb.column("prefix").to_pylist()]
            node = rb.column("node").to_numpy()[spread(np.array([len(p) for p in parts], np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *parts])), pa.array(node)], names=["token", "node"])

    postings = written(nodes.where("prefix IS NOT NULL").select("node", "prefix").mapInArrow(tokens_of, "token long, node long"), "jaccard-postings")
    counted = postings.groupBy("token").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2")).where("members > 1")
    # buckets with the same members (told by 128 bits of commutative hashes) are looked at once
    distinct = counted.groupBy("members", "h1", "h2").agg(F.min("token").alias("token")).select("token")
    return postings.join(distinct, "token").withColumnRenamed("token", "bucket")


def joined_units(members: DataFrame, payload: str, make, num: int, den: int) -> DataFrame:
    """Runs tree_join in each unit (bucket, i, j) of members(bucket, i, j, side, node, n, payload): links a, b."""

    def run(record_batches):
        import pyarrow as pa

        def rows():
            for rb in record_batches:
                yield from zip(*(rb.column(c).to_pylist() for c in (*UNIT, "side", "node", "n", payload)), strict=True)

        def links(unit):
            # a block paired with itself comes as side 0, and with another as 1 or 2
            sides = np.array([u[3] for u in unit])
            sizes, items = np.array([u[5] for u in unit], np.int64), [np.frombuffer(u[6], np.uint8) for u in unit]
            bitmaps, alike = make(items, sizes)
            return [(unit[i][4], unit[j][4]) for i, j in tree_join(sizes, bitmaps, sides, alike, num, den).links]

        at, unit, out = None, [], []
        for r in rows():
            if r[:3] != at:
                if len(unit) > 1:
                    out += links(unit)
                at, unit = r[:3], []
                if len(out) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                    out = []
            unit.append(r)
        if len(unit) > 1:
            out += links(unit)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return members.select(*UNIT, "side", "node", "n", payload).repartition(*UNIT).sortWithinPartitions(*UNIT, "node").mapInArrow(run, "a long, b long")


def by_bitmap(items, sizes):
    return items, lambda i, j: True


def by_set(num: int, den: int):
    def make(items, sizes):
        sets = [x.view(np.uint64) for x in items]

        def alike(i: int, j: int) -> bool:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            return both * den >= num * (len(sets[i]) + len(sets[j]) - both)

        return [signature(s) for s in sets], alike

    return make


def connected(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each component, for the nodes of links(a, b); by alternating stars."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    while True:
        before = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        # large star: every neighbour above a node goes to the least around it
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every neighbour below a node, and the node, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = written(small, "stars")
        forget(edges)
        edges = after
        if edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first() == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def similar_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, block: int = 2048, sample_docs: int = 4000, most_bits: int = 28) -> DataFrame:
    """docs(doc_id, text) -> row-wise doc_id, n_shingles, component_id, key (xxhash64 of the text) and component.

    component: a number of the component itself, whatever the ids; null for an empty set.
    """
    rows = document_sets(docs, k, num, den, sample_docs, most_bits)
    classes = written(rows.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("first")), "jaccard-classes")
    nodes = written(rows.select("row", "doc_id", "key", "n", "bitmap", "prefix").join(classes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node"), "jaccard-nodes")
    members = written(buckets(nodes).join(nodes.select("node", "n", F.col("bitmap").alias("payload")), "node"), "jaccard-buckets")
    maybe = written(group_links(members, by_bitmap, num, den, 2 * block), "jaccard-candidates")
    clusters = written(connected(maybe).withColumnRenamed("label", "bucket"), "jaccard-clusters")
    links = group_links(cluster_sets(docs, k, nodes, clusters), by_set(num, den), num, den, block)
    labels = connected(links)
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = named.join(named.groupBy("label").agg(F.min("first").alias("component_id")), "label").select("digest", "component_id", F.col("label").alias("component"))
    out = rows.select("doc_id", "key", "n", "digest").join(ids, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "key", "component")


def cluster_sets(docs: DataFrame, k: int, nodes: DataFrame, clusters: DataFrame, width_bits: int = 24) -> DataFrame:
    """Written: bucket (the cluster), node, n and payload, the whole set of each node of a cluster, from the texts again."""
    wanted = written(clusters.join(nodes.select("node", "doc_id", "key"), "node").select("bucket", "node", F.col("doc_id").alias("_id"), F.col("key").alias("_key")), "jaccard-wanted")

    def keys(record_batches):
        for rb in record_batches:
            yield rb.column("_key").to_numpy(zero_copy_only=False).view(np.uint64)

    sketch = merged_sketch(wanted.select("_key"), keys, 1, width_bits, at_least=1)

    def run(record_batches):
        import pyarrow as pa

        for part in batches(arrow_rows(record_batches, "_id", "_key", "text"), lambda r: len(r[2] or b""), 4 << 20):
            maybe = may_hold(sketch.value, np.array([r[1] for r in part], np.int64).view(np.uint64), width_bits)
            part = [r for r, m in zip(part, maybe, strict=True) if m]
            if part:
                sets = shingle_sets([r[2] for r in part], k)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["_id", "_key", "n", "tokens"])

    found = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), "text").mapInArrow(run, "_id long, _key long, n long, tokens binary")
    same = (found["_key"] == wanted["_key"]) & found["_id"].eqNullSafe(wanted["_id"])
    # of equal rows, one is enough
    return written(found.join(wanted, same).select("bucket", "node", "n", F.col("tokens").alias("payload")).dropDuplicates(["node"]), "jaccard-cluster-sets")


def dealt_blocks(members: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """members(bucket, node, n, payload) with blocks (of the bucket) and b, the node's: by number and by bytes."""
    sizes = members.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / block, F.sum(F.octet_length("payload")) / block_bytes)).cast("int").alias("blocks"))
    return members.join(sizes, "bucket").withColumn("b", F.pmod(F.xxhash64("node", F.lit(9)), F.col("blocks")).cast("int"))


def with_first(dealt: DataFrame) -> DataFrame:
    """Units of each block by itself and with the first: about two rows for each member, and the first block for each block."""
    to = F.when((F.col("b") == 0) & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("b"))
    return dealt.withColumn("j", F.explode(to)).select("bucket", F.lit(0).alias("i"), "j", F.lit(0).alias("side"), "node", "n", "payload")


def group_links(members: DataFrame, make, num: int, den: int, block: int, block_bytes: int = 64 << 20) -> DataFrame:
    """A spanning forest of the links within the groups of members(bucket, node, n, payload), a written table.

    Large groups: each block by itself and with the first; then what is not in a group's greatest component by now meets
    every block. So a group whose members are alike costs about its size.
    """
    dealt = dealt_blocks(members, block, block_bytes)
    links = written(joined_units(with_first(dealt), "payload", make, num, den), "jaccard-links")
    large = written(dealt.where("blocks > 1").select("bucket", "node", "blocks", "b"), "jaccard-large")
    if not large.take(1):
        return links
    names = written(connected(links), "jaccard-names")
    parts = written(large.join(names, "node", "left").withColumn("label", F.coalesce("label", "node")), "jaccard-parts")
    count = parts.groupBy("bucket", "label").agg(F.count("*").alias("members"))
    greatest = count.groupBy("bucket").agg(F.max(F.struct("members", F.col("label"))).alias("most")).select("bucket", F.col("most.label").alias("greatest"))
    rest = parts.join(greatest, "bucket").where(F.col("label") != F.col("greatest"))
    # as many parts of the rest as its share of the blocks
    n_rest = rest.groupBy("bucket").agg(F.count("*").alias("left"), F.first("blocks").alias("blocks")).join(parts.groupBy("bucket").agg(F.count("*").alias("all")), "bucket").select("bucket", F.ceil(F.col("blocks") * F.col("left") / F.col("all")).cast("int").alias("rests"))
    left = rest.join(n_rest, "bucket").withColumn("i", F.pmod(F.xxhash64("node", F.lit(13)), F.col("rests")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", "i", "j", F.lit(1).alias("side"), "node")
    right = parts.join(n_rest, "bucket").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rests") - 1))).select("bucket", "i", F.col("b").alias("j"), F.lit(2).alias("side"), "node")
    units = left.unionByName(right).join(members.select("bucket", "node", "n", "payload"), ["bucket", "node"])
    return links.unionByName(written(joined_units(units, "payload", make, num, den), "jaccard-links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, that with the least doc_id (null: the greatest); rows with an empty set stay too.

    Components are told by themselves, not by ids: documents without an id, or unlike ones with the same id, are kept apart.
    Of equal ids the least hash of the text goes first, and of rows with equal id and text any.
    """
    key, shared = fresh(docs.columns, "_key", "_id")
    words = F.coalesce(F.regexp_like(F.col("text"), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    found = similar_components(docs.where(words).select("doc_id", "text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")
    keep = written(found.groupBy("component").agg(first).select(F.col("first.doc_id").alias(shared), F.col("first.key").alias(key)).distinct(), "jaccard-kept")
    keyed = docs.where(words).withColumn(key, F.xxhash64("text"))
    one = keyed.join(keep, keyed["doc_id"].eqNullSafe(keep[shared]) & (keyed[key] == keep[key]), "left_semi").dropDuplicates(["doc_id", key])
    return one.select(*named(docs.columns)).unionByName(docs.where(~words))


def op5_signature_tree_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(ws[t.i : t.i + 4], ' ') AS g FROM w, unnest(range(1, len(ws) - 3)) AS t(i) WHERE len(ws) >= 5
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""
