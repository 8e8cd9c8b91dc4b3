"""Tokens of identifiers and task texts, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a task that are no keywords.
STOP_WORDS = """the a an is are was were be been being have has had do does did will would could should may might must shall
can need to of in for on with at by from as into through during before after above below between under again further then once
here there when where why how all each few more most other some such no nor not only own same so than too very just and but if or
because until while this that these those what which who whom find get look see use make want fix add update change modify
implement create delete remove""".split()

#: Lower-case Latin letters with marks, and the letters without.
_BASE = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xE0, 0x180)) if c.islower()}
MARKED = "".join(c for c, b in _BASE.items() if b.isascii())
PLAIN = "".join(b for b in _BASE.values() if b.isascii())


def folded(text: Column) -> Column:
    """Lower case, Latin letters without their marks."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of a text, folded."""
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def split_case(name: Column) -> Column:
    return F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2")


def semantic_text(name: Column, qualified: Column, docstring: Column) -> Column:
    """What the semantic index holds of a symbol: whole identifiers and their fragments, and the docstring."""
    return F.lower(F.concat_ws(" ", name, split_case(name), qualified, split_case(qualified), docstring))


def has_phrase_prefix(text: Column, query: Column) -> Column:
    """Whether the query's tokens stand in a row in the text, the last as a prefix. A query without tokens: false."""
    q = tokens(query)
    return (F.size(q) > 0) & F.contains(F.concat(F.lit(" "), F.array_join(tokens(text), " ")), F.concat(F.lit(" "), F.array_join(q, " ")))


def task_keywords(task: Column) -> Column:
    """Words of more than two bytes that are no stop words; case, order and repeats stay."""
    words = F.split(task, r"[^\p{L}\p{N}_]+")
    return F.filter(words, lambda w: (F.octet_length(w) > 2) & ~F.lower(w).isin(*STOP_WORDS))
