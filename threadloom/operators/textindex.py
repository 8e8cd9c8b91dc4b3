"""Stored text indexes: places of tokens for phrase search, and blocks of postings with bounds for ranked search.

Both are tables sorted by token and written in small pages, so that a query reads the pages of its own tokens alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import shared_dir

#: Rows of a page of a stored index: what a look-up of a token reads at least.
PAGE_ROWS = 2000
#: A block holds the postings of 2^BLOCK ids in a row; a file's symbols are in blocks of their own.
BLOCK = 10
#: Blocks of the best bounds that are scored first, for the threshold.
FIRST_BLOCKS = 32
#: What no token holds.
SEPARATOR = "\x00"
#: Blocks up to this number are given to the scan by number, more by a join.
LISTED_BLOCKS = 500


def write_sorted(table: DataFrame, path: str, *keys: str) -> None:
    """Writes a table in files and pages ordered by these keys."""
    table.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("parquet.page.row.count.limit", str(PAGE_ROWS)).parquet(path)


def stored(table: DataFrame, name: str, *keys: str) -> DataFrame:
    """The table written in this order in the shared folder, and read back."""
    spark = table.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write_sorted(table, path, *keys)
    return spark.read.schema(table.schema).parquet(path)


# Phrases


def name_places(nodes: DataFrame) -> DataFrame:
    """token, place, field (0 name, 1 qualified name), id, name, kind: a row for each token of a symbol's names."""
    fields = F.array(F.struct(F.lit(0).alias("field"), tokens(F.col("name")).alias("words")), F.struct(F.lit(1).alias("field"), tokens(F.coalesce("qualified_name", F.lit(""))).alias("words")))
    each = nodes.select("id", "name", "kind", F.explode(fields).alias("f"))
    return each.select(F.posexplode("f.words").alias("place", "token"), F.col("f.field").alias("field"), "id", "name", "kind").select("token", "place", "field", "id", "name", "kind")


def phrase_hits(index: DataFrame, words: list[str]) -> DataFrame:
    """id, name, kind, once each, of the symbols with a name in which the words stand in a row, the last as a prefix.

    index: name_places. Reads the rows of whole words and of the prefix. No words: no symbols.
    """
    shown = ("id", "name", "kind")
    if not words:
        return index.select(*shown).limit(0)
    *whole, last = words
    token = F.col("token")
    wanted = token.startswith(last)
    if not whole:
        return index.where(wanted).select(*shown).distinct()
    wanted = wanted | token.isin(*whole)
    # a token can stand at several places of the phrase
    fits = F.array(*(F.when(token == w, i) for i, w in enumerate(whole)), F.when(token.startswith(last), len(whole)))
    fitting = index.where(wanted).select(*shown, "field", "place", F.explode(F.array_compact(fits)).alias("nth"))
    starts = fitting.groupBy(*shown, "field", (F.col("place") - F.col("nth")).alias("start")).agg(F.count("*").alias("found"))
    return starts.where(F.col("found") == len(words)).select(*shown).distinct()


def words_of(spark: SparkSession, query: str) -> list[str]:
    """The tokens of a query, as those of the index are made."""
    return spark.sql("SELECT 1").select(tokens(F.lit(query))).first()[0]


# Ranked search


def postings(texts: DataFrame) -> DataFrame:
    """texts(id, tokens array) -> id, token, tf, len."""
    return texts.select("id", F.size("tokens").alias("len"), F.explode("tokens").alias("token")).groupBy("id", "len", "token").agg(F.count("*").alias("tf"))


def posting_blocks(texts: DataFrame) -> DataFrame:
    """texts(id, tokens array) -> token, block, n (documents), most (largest tf), least (smallest len), and in the order of ids
    the arrays at (id less the first of the block), tf and len.

    A block is bounded by its ids, however frequent the token. Texts are dealt by block once; tokens are counted in their row.
    """
    block = F.shiftright("id", BLOCK)
    # a text travels as one string
    dealt = texts.select("id", block.alias("block"), F.array_join("tokens", SEPARATOR).alias("text"), F.size("tokens").alias("len")).where("len > 0").repartition("block")
    dealt = dealt.select("id", "block", "len", F.array_sort(F.split("text", SEPARATOR)).alias("tokens"))
    tokens_, places = F.col("tokens"), F.sequence(F.lit(0), F.col("len") - 1)
    first = F.filter(places, lambda i: (i == 0) | (F.get(tokens_, i) != F.get(tokens_, i - 1)))  # of each run of equal tokens
    runs = F.transform("first", lambda i, nth: F.struct(F.get(tokens_, i).alias("token"), (F.coalesce(F.get(F.col("first"), nth + 1), F.col("len")) - i).alias("tf")))
    counted = dealt.withColumn("first", first).select("id", "block", "len", F.inline(runs))
    docs = F.sort_array(F.collect_list(F.struct((F.col("id") - F.shiftleft("block", BLOCK)).cast("int").alias("at"), "tf", "len"))).alias("docs")
    grouped = counted.groupBy("token", "block").agg(F.count("*").alias("n"), F.max("tf").alias("most"), F.min("len").alias("least"), docs)
    return grouped.select("token", "block", "n", "most", "least", F.col("docs.at").alias("at"), F.col("docs.tf").alias("tf"), F.col("docs.len").alias("len"))


def totals_of(texts: DataFrame) -> DataFrame:
    """One row with the numbers n of documents with tokens and total of their tokens."""
    return texts.where(F.size("tokens") > 0).agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("total"))


def token_weight(n: Column, df: Column) -> Column:
    """What a token weighs that df of n documents hold."""
    idf = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)


def token_score(weight: Column, times: Column, tf: Column, length: Column, n: Column, total: Column) -> Column:
    """A token's part of a document's score: it grows with tf and falls with the length."""
    return weight * times * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (total / n)))


class BlockSearch:
    """Ranked search for a query over stored blocks: documents with all its tokens, those of weak blocks unread.

    A block's bound is the score of a document with its largest tf and smallest length of each token. Blocks with the best
    bounds are scored first; their limit-th score is a threshold below which no block has to be read. Equal scores (to nine
    digits) are within the threshold, so the rows are those of scoring everything. The driver holds a row for each token of
    the query and FIRST_BLOCKS bounds.
    """

    def __init__(self, blocks: DataFrame, totals: DataFrame, query: list[str], limit: int = 20, first: int = FIRST_BLOCKS):
        self.limit, self.first = limit, first
        self.asked = {t: query.count(t) for t in query}
        self.blocks = blocks.where(F.col("token").isin(*self.asked)) if self.asked else blocks.limit(0)
        all_ = totals.first()
        self.n, self.total = F.lit(all_["n"]), F.lit(all_["total"])
        counted = self.blocks.groupBy("token").agg(F.sum("n").alias("df"))
        weights = {r["token"]: r["weight"] for r in counted.select("token", token_weight(self.n, F.col("df")).alias("weight")).collect()}
        self.possible = bool(self.asked) and weights.keys() == self.asked.keys()
        if self.possible:
            self.weights = F.create_map(*(F.lit(x) for t in weights for x in (t, weights[t])))
            self.times = F.create_map(*(F.lit(x) for t, k in self.asked.items() for x in (t, k)))

    def _part(self, tf: Column, length: Column) -> Column:
        return token_score(self.weights[F.col("token")], self.times[F.col("token")], tf, length, self.n, self.total)

    def bounds(self) -> DataFrame:
        """block, bound of the blocks that have all tokens; reads no documents."""
        parts = self.blocks.select("token", "block", self._part(F.col("most"), F.col("least")).alias("part"))
        return parts.groupBy("block").agg(F.count("*").alias("terms"), F.sum("part").alias("bound")).where(F.col("terms") == len(self.asked)).select("block", "bound")

    def scored(self, blocks: DataFrame) -> DataFrame:
        """id, score (smaller is better) of the documents with all tokens in these rows."""
        docs = blocks.select("token", "block", F.inline(F.arrays_zip("at", "tf", "len"))).withColumn("id", F.shiftleft("block", BLOCK) + F.col("at"))
        each = docs.groupBy("id").agg(F.count("*").alias("terms"), (-F.sum(self._part(F.col("tf"), F.col("len")))).alias("score"))
        return each.where(F.col("terms") == len(self.asked)).select("id", "score")

    def best(self, scored: DataFrame) -> DataFrame:
        return scored.orderBy(F.round("score", 9), "id").limit(self.limit)

    def needed(self) -> DataFrame:
        """block of those whose bound reaches the threshold."""
        bounds = self.bounds()
        first = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(self.first).collect()]
        scores = [r.score for r in self.best(self.scored(self.blocks.where(F.col("block").isin(first)))).collect()] if first else []
        if len(scores) < self.limit:
            return bounds.select("block")
        return bounds.where(F.col("bound") >= -scores[-1] - 1e-8).select("block")

    def rows(self) -> DataFrame:
        """id, score of the best documents, best first."""
        if not self.possible:
            return self.blocks.select(F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score")).limit(0)
        needed = self.needed()
        listed = [r.block for r in needed.limit(LISTED_BLOCKS + 1).collect()]
        few = len(listed) <= LISTED_BLOCKS
        rest = self.blocks.where(F.col("block").isin(listed)) if few else self.blocks.join(needed, "block", "left_semi")
        return self.best(self.scored(rest))
