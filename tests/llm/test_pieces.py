import itertools
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm.pieces import Pieces, op7_shared_prefix_viterbi, piece_encoder, piece_ids

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ODD = ["", None, " ", "  a  b ", "a\nb\n\nc", "tab\tx", "<s>x</s>", "▁x", "Ａé ﬁ", "नमस्ते 日本語 𝔘𝔫𝔦", "\0 nul", "don't STOP", "x" * 300, "aaaaaaaaaaaaa bbbbbbbbb", "http://a.b/c?d=1&e=22", " nbsp  "]


def test_ids_and_texts_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(0, "again", 1), (None, "none", 1)], "doc_id long, text string, ids int")
    for r in piece_ids(docs, MODEL).collect():
        text = ODD[r.doc_id] if r.doc_id and r.doc_id < len(ODD) else None
        if text is not None:
            assert r.ids == LIBRARY.encode(text), text
            assert r.decoded == LIBRARY.decode(r.ids)
    assert piece_ids(docs.limit(0), MODEL).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aeinrst hTHE\n'日é")), max_size=30), max_size=6))
def test_ids_of_random_texts(texts):
    for t, ids in zip(texts, piece_encoder(MODEL)([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == LIBRARY.encode(t)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(alphabet="abc", min_size=1, max_size=4), st.floats(-9, 0), min_size=3, max_size=12), st.lists(st.text(alphabet="abc", min_size=1, max_size=7), min_size=1, max_size=5))
def test_unigram_scores_are_the_best(scores, words):
    scores = {"a": -8.0, "b": -9.5, "c": -9.0} | scores
    pieces = Pieces(scores, bpe=False)
    for word, found in zip(sorted(words), pieces.segment(sorted(words)), strict=True):
        assert "".join(found) == word
        cuts = itertools.chain.from_iterable(itertools.combinations(range(1, len(word)), n) for n in range(len(word)))
        every = ([word[a:b] for a, b in itertools.pairwise((0, *c, len(word)))] for c in cuts)
        best = max(sum(scores[p] for p in parts) for parts in every if all(p in scores for p in parts))
        assert abs(sum(scores[p] for p in found) - best) < 1e-9


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=2, max_size=5), min_size=1, max_size=10, unique=True), st.lists(st.text(alphabet="abx", min_size=1, max_size=12), min_size=1, max_size=6))
def test_bpe_by_pairs_equals_merging(vocabulary, words):
    pieces = Pieces({p: -float(i) for i, p in enumerate(vocabulary)}, bpe=True)
    for word, found in zip(sorted(words), pieces.segment(sorted(words)), strict=True):
        assert found == pieces.merged(word)


def test_op7_against_the_library(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op7_shared_prefix_viterbi(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
