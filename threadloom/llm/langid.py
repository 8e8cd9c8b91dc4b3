"""Language identification by compression.

For each language, letters of sampled labelled texts become a zstandard raw-content dictionary. A text goes to the language
whose dictionary makes it smallest; the relative lead over the second is its score. A narrow lead means rejection.
Before compression a text is lower-cased and runs of anything but letters and marks become one space.
Whole texts are compressed in pieces of a fixed size, each against each dictionary, and sizes are summed by language: a
dictionary helps only at the beginning of what it compresses, so in one piece the lead of a long text would shrink away.

The fit uses a bounded sample: about ``dictionary_bytes`` of letters for each language, less when there are more than
``max_languages``, from pieces of ``sample_chars`` characters, drawn by their hash from all places of all texts with a label;
equal pieces count once. No language is left out. Prediction sees whole texts and nothing else.

Defined cases: ``und`` with score 0 for null texts and texts without letters (marks alone are none); ties go to the language with most labelled
rows, then by name; without any labelled row everything is ``und``; repeated rows get equal answers; an empty table gives an
empty one; a very long text is held by one worker and classified whole; columns of docs named as the answers are replaced by
``predict`` and kept by ``keep_confident``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .shared import arrow_rows, batches, by_place, named, sliced

NOT_LETTERS = r"[^\p{L}\p{M}]+"


def letters(text: str) -> bytes:
    """Letters and marks of a text; nothing if it has no letter."""
    global _cut, _letter
    if _cut is None:
        import regex

        _cut, _letter = regex.compile(NOT_LETTERS), regex.compile(r"\p{L}")
    body = _cut.sub(" ", text.lower()).strip()
    return body.encode() if _letter.search(body) else b""


_cut = _letter = None


@dataclass(frozen=True)
class Profile:
    """Dictionaries in order of preference at ties."""

    dictionaries: tuple[tuple[str, bytes], ...]
    level: int = 5
    min_margin: float = 0.005
    piece_bytes: int = 1 << 14


class Classifier:
    def __init__(self, profile: Profile):
        import zstandard

        self.profile, self.models = profile, []
        # small tables for the small dictionaries of many languages
        sizes = {"dict_size": max(len(c) for _, c in profile.dictionaries), "source_size": profile.piece_bytes} if len(profile.dictionaries) > 64 else {}
        params = zstandard.ZstdCompressionParameters.from_level(profile.level, **sizes, write_content_size=False, write_checksum=False, write_dict_id=False)
        for lang, content in profile.dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.models.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress))

    def __call__(self, text: bytes | None) -> tuple[str, float, bool]:
        body = letters(text.decode("utf-8", "replace")) if text else b""
        if not body or not self.models:
            return "und", 0.0, True
        step = self.profile.piece_bytes
        pieces = [body[a : a + step] for a in range(0, len(body), step)]
        sizes = [(sum(len(compress(p)) for p in pieces), i) for i, (_, compress) in enumerate(self.models)]
        (best, at), *others = sorted(sizes)
        score = 1.0 if not others else (others[0][0] - best) / max(others[0][0], 1)
        return self.models[at][0], score, score < self.profile.min_margin


def fit(labelled: DataFrame, dictionary_bytes: int = 1 << 18, max_languages: int = 64, sample_chars: int = 2000) -> Profile:
    """From labelled(text, lang); all languages share max_languages * dictionary_bytes.

    The driver gets at most twice dictionary_bytes characters and one piece more of each language.
    """
    spark = labelled.sparkSession
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != "und"))
    top = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).orderBy(F.desc("n"), "lang").collect()  # a row for each language
    dictionary_bytes = max(1, min(dictionary_bytes, max_languages * dictionary_bytes // max(len(top), 1)))
    wanted = 2 * dictionary_bytes // sample_chars + 1
    # four times the wanted pieces go on from where they are; copies among them then go, and the least hashes stay
    shares = {r.lang: min(1.0, 4 * max(wanted, 16) * sample_chars / max(r.chars, 1)) for r in top}
    share = F.element_at(F.create_map(*(F.lit(x) for kv in shares.items() for x in kv)), F.col("lang")) if shares else F.lit(0.0)
    begins = F.explode(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(sample_chars)))
    pieces = labelled.select("lang", "text", begins.alias("begin")).select("lang", F.substring("text", F.col("begin"), F.lit(sample_chars)).alias("piece"))
    drawn = pieces.withColumn("draw", F.xxhash64("piece")).where(F.pmod(F.xxhash64("draw", F.lit(11)), F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["lang", "draw"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    parts: dict[str, list[bytes]] = {r.lang: [] for r in top}
    for r in sorted(drawn.withColumn("nth", nth).where(F.col("nth") <= wanted).collect(), key=lambda r: (r.lang, r.nth)):
        if sum(map(len, parts[r.lang])) < dictionary_bytes:
            parts[r.lang].append(letters(r.piece))
    return Profile(tuple((r.lang, b" ".join(parts[r.lang])[:dictionary_bytes]) for r in top if any(parts[r.lang])))


def held_out(doc_id="doc_id"):
    """A fifth of documents, by crc32 of the id as text, that a fit never sees."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def classified(record_batches, profile: Profile, text: str):
    """(record batch, language, score and rejection of each of its rows), in slices."""
    classify = None
    for rb in sliced(record_batches):
        found: list[tuple] = []
        for part in batches(arrow_rows([rb], text), lambda r: len(r[0] or b""), 8 << 20, caching=classify is not None):
            classify = classify or Classifier(profile)
            found += [classify(t) for (t,) in part]
        yield rb, *(list(zip(*found, strict=True)) or [(), (), ()])


def predict(docs: DataFrame, profile: Profile) -> DataFrame:
    """docs with lang_pred, score and rejected; columns of these names in docs are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(profile)  # at most max_languages * dictionary_bytes
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    plain, text = by_place(docs.select(*named(kept))), f"c{kept.index('text')}"

    def run(record_batches):
        import pyarrow as pa

        for rb, langs, scores, rejected in classified(record_batches, shared.value, text):
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*rb.schema.names, "lang_pred", "score", "rejected"])

    schema = StructType([*plain.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    return plain.mapInArrow(run, schema).toDF(*kept, "lang_pred", "score", "rejected")


def keep_confident(docs: DataFrame, profile: Profile) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(profile)
    plain, text = by_place(docs), f"c{docs.columns.index('text')}"

    def run(record_batches):
        import pyarrow as pa

        for rb, _, _, rejected in classified(record_batches, shared.value, text):
            yield rb.filter(pa.array([not x for x in rejected], pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op8_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profile = fit(docs.where(~held_out()).select("text", "lang"))
    out = predict(docs.select("doc_id", "text", held_out().alias("held_out")), profile)
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
