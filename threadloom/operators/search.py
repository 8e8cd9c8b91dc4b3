"""Name search, semantic search (BM25) and task context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import has_phrase_prefix, semantic_text, task_keywords, tokens
from ..schema import Graph
from .coupling import related_rank
from .textindex import BlockSearch, phrase_hits, posting_blocks, postings, token_score, token_weight, totals_of, words_of


#: Keywords of a task that are searched for in one pass.
MOST_KEYWORDS = 1000


def search_names(g: Graph, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Symbols whose name or qualified name holds the query's tokens in a row, the last as a prefix; short names first.

    A query of one byte, or with a double quote in it, is a prefix pattern of lower-cased names (% and _ are wild).
    """
    nodes = g.nodes if kind is None else g.nodes.where(F.col("kind") == kind)
    order = (F.length("name"), "name", "id")
    if len(query.encode()) < 2 or '"' in query:
        hit = F.lower("name").like(query.lower() + "%")
    elif g.names is not None:  # stored with the index, sorted by token
        hits = phrase_hits(g.names, words_of(g.nodes.sparkSession, query))
        best = (hits if kind is None else hits.where(F.col("kind") == kind)).orderBy(*order).limit(limit)
        return nodes.join(best.select("id"), "id").orderBy(*order)
    else:
        q = F.lit(query)
        hit = has_phrase_prefix(F.col("name"), q) | has_phrase_prefix(F.coalesce("qualified_name", F.lit("")), q)
    return nodes.where(hit).orderBy(*order).limit(limit)


def postings_of(texts: DataFrame, asked: list[str]) -> DataFrame:
    """As postings, of the asked tokens alone: without a shuffle."""

    def counted(token: str):
        return F.struct(F.lit(token).alias("token"), F.size(F.filter("tokens", lambda x: x == token)).cast("long").alias("tf"))

    each = F.array(*map(counted, dict.fromkeys(asked)))
    return texts.select("id", F.size("tokens").alias("len"), F.inline(each)).where("tf > 0")


def semantic_texts(g: Graph) -> DataFrame:
    """id, tokens of each symbol in the semantic index."""
    return g.nodes.select("id", tokens(semantic_text(F.col("name"), F.coalesce("qualified_name", F.lit("")), F.coalesce("docstring", F.lit("")))).alias("tokens"))


def semantic_index(g: Graph) -> tuple[DataFrame, DataFrame]:
    """The semantic index of symbols: blocks of postings, and one row with the numbers n of symbols and total of tokens."""
    texts = semantic_texts(g)
    return posting_blocks(texts), totals_of(texts)


def bm25(index: DataFrame, n_docs: DataFrame, query: list[str], limit: int | None = 20) -> DataFrame:
    """id, score of the documents that hold all tokens of the query; smaller is better.

    index: postings; n_docs(n, total): number of documents and of tokens. A token given twice counts twice.
    """
    spark: SparkSession = index.sparkSession
    asked: dict[str, int] = {}
    for t in query:
        asked[t] = asked.get(t, 0) + 1
    if not asked:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    terms = spark.createDataFrame(list(asked.items()), "token string, times long")
    hits = index.where(F.col("token").isin(*asked)).join(F.broadcast(terms), "token")
    df = hits.groupBy("token").agg(F.count("*").alias("df"))  # a row for each asked token
    part = token_score(token_weight(F.col("n"), F.col("df")), F.col("times"), F.col("tf"), F.col("len"), F.col("n"), F.col("total"))
    scored = hits.join(F.broadcast(df), "token").join(F.broadcast(n_docs)).groupBy("id").agg(F.count("*").alias("terms"), (-F.sum(part)).alias("score"))
    out = scored.where(F.col("terms") == len(asked)).select("id", "score")
    return out.orderBy(F.round("score", 9), "id").limit(limit) if limit else out


def semantic_search(g: Graph, query: str, limit: int = 20) -> DataFrame:
    """Symbols for the words of a query, best first: id, score and the node's columns; from stored postings where there are."""
    import re

    words = [w for w in re.split(r"[\W_]+", query.lower()) if w]
    if g.postings is not None and g.totals is not None:  # stored with the index, sorted by token
        best = BlockSearch(g.postings, g.totals, words, limit).rows()
    else:
        texts = semantic_texts(g)
        best = bm25(postings_of(texts, words or [""]), totals_of(texts), words, limit)
    return best.join(g.nodes, "id").orderBy("score", "id")


def keyword_hits(g: Graph, keywords: DataFrame, each: int = 5) -> DataFrame:
    """For keywords(place, keyword): the first symbols of each by name search: place, rank, id, kind.

    All keywords meet all names in one pass. Keywords with tokens only; more than MOST_KEYWORDS are an error.
    """
    names = g.nodes.select("id", "kind", "name", F.array_join(tokens(F.col("name")), " ").alias("a"), F.array_join(tokens(F.coalesce("qualified_name", F.lit(""))), " ").alias("b"))
    found = keywords.select("place", F.array_join(tokens(F.col("keyword")), " ").alias("q")).where("q <> ''").limit(MOST_KEYWORDS + 1).collect()
    if len(found) > MOST_KEYWORDS:
        raise ValueError(f"more than {MOST_KEYWORDS} keywords")
    pad = lambda c: F.concat(F.lit(" "), c)
    words = F.array(*(F.struct(F.lit(r.place).alias("place"), F.lit(r.q).alias("q")) for r in found)) if found else F.lit(None).cast("array<struct<place:int,q:string>>")
    hit = F.filter(words, lambda w: F.contains(pad(F.col("a")), pad(w["q"])) | F.contains(pad(F.col("b")), pad(w["q"])))
    hits = names.select("id", "kind", "name", F.explode(hit).alias("w")).select("id", "kind", "name", "w.place")
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.length("name"), "name", "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= each).select("place", "rank", "id", "kind")


def entry_points(g: Graph, keywords: DataFrame, most: int = 10) -> DataFrame:
    """Symbols to begin with, in order: functions, then types, then interfaces, then others; once each. nth, id."""
    first = F.when(F.col("kind").isin("function", "method"), 0).when(F.col("kind").isin("class", "struct"), 1).when(F.col("kind").isin("interface", "trait"), 2).otherwise(3)
    hits = keyword_hits(g, keywords).withColumn("priority", first)
    best = hits.groupBy("id").agg(F.min(F.struct("priority", "place", "rank")).alias("best")).orderBy("best").limit(most)
    return best.select(F.row_number().over(Window.orderBy("best")).alias("nth"), "id")


def build_context(g: Graph, task: str, max_nodes: int = 20, max_code: int = 5, max_chars: int = 1500, around: int = 3) -> dict[str, DataFrame]:
    """Tables for a task: entries (nth and node), related (score and node), edges between them, code (nth, id, code).

    Needs g.sources for code.
    """
    from ..sources.slices import slice_lines

    spark = g.nodes.sparkSession
    words = spark.createDataFrame([(task,)], "task string").select(F.posexplode(task_keywords(F.col("task"))).alias("place", "keyword"))
    entries = entry_points(g, words, max_nodes // 2)
    related = related_rank(g, entries, max_nodes // 2)
    ids = entries.select("id").unionByName(related.select("id"))
    out = {
        "entries": entries.join(g.nodes, "id").orderBy("nth"),
        "related": related.join(g.nodes, "id").orderBy(F.desc("score"), "id"),
        "edges": g.edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi"),
    }
    if g.sources is not None:
        spans = entries.where(F.col("nth") <= max_code).join(g.nodes.select("id", F.col("file_path").alias("path"), "start_line", "end_line"), "id")
        out["code"] = slice_lines(g.sources, spans, around).select("nth", "id", F.substring("text", 1, max_chars).alias("code")).orderBy("nth")
    return out
