"""SentencePiece encoding and decoding by a Viterbi pass with shared prefixes.

A text becomes marked words (a word with the space mark before it); no piece of the model reaches over these cuts. The
distinct words of a batch are sorted, so that they come in the depth-first order of their trie, and each word keeps the
forward states of the prefix it shares with the word before.

Forward states. Unigram models: the best score of each prefix and its last piece. BPE models: the one piece that ends each
prefix's encoding. A segmentation is what merging by score gives exactly if each neighbouring pair of pieces, merged alone,
gives just that pair; and a prefix of an encoding is the encoding of that prefix. (Merges act on neighbours and the best
goes first; up to the first merge over a cut, both sides go as they would alone.) So the same pass serves both.

Characters without a piece become byte pieces, or the unknown piece where the model has none. Defined cases: null and empty
texts have no ids; repeated rows are encoded each; of equally good segmentations the one with the longest last piece counts;
a very long text is held by one worker, and a long word costs its length times that of the longest piece; other columns are
left out, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .encoding import Encoder
from .shared import CACHES, arrow_rows, batches

MARK = "▁"
WORDS = re.compile(rb" *[^ ]+| +")


#: Bytes of white space other than space and line feed, or the beginning of its UTF-8 form; and NUL, at which pieces are cut.
ODD = (b"\t", b"\r", b"\x0b", b"\x0c", b"\0", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


def plain(text: bytes) -> bool:
    """Whether all white space is single spaces and line feeds, each between two other characters."""
    return len(text.split()) == text.count(b" ") + text.count(b"\n") + 1 and not any(x in text for x in ODD)


class Pieces:
    """The pieces of a model and the forward pass over sorted words."""

    def __init__(self, scores: dict[str, float], bpe: bool):
        self.scores, self.bpe = scores, bpe
        self.longest = max(map(len, scores), default=1)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.least = min(scores.values(), default=0.0) - 10.0

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: the neighbours of best score first, the leftmost among equals."""
        symbols = list(text)
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = self.scores.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def stands(self, piece: str) -> bool:
        if piece not in self.alone:
            self.alone[piece] = self.merged(piece) == [piece]
        return self.alone[piece]

    def fits(self, a: str, b: str) -> bool:
        if (a, b) not in self.pairs:
            if len(self.pairs) > 1 << 19:
                self.pairs.clear()
            self.pairs[a, b] = self.merged(a + b) == [a, b]
        return self.pairs[a, b]

    def segment(self, words: list[str]):
        """The pieces of each word; words must be sorted."""
        scores, longest, bpe = self.scores, self.longest, self.bpe
        states: list[tuple[float, int, str]] = [(0.0, 0, "")]  # of each prefix: score, where its last piece starts, the piece
        before = ""
        for word in words:
            common, most = 0, min(len(word), len(before))
            while common < most and word[common] == before[common]:
                common += 1
            del states[common + 1 :]
            for end in range(common + 1, len(word) + 1):
                found = None
                for start in range(max(0, end - longest), end):
                    piece = word[start:end]
                    score = scores.get(piece)
                    if score is None:
                        if start < end - 1:
                            continue
                        score = self.least
                    if bpe:
                        last = states[start][2]
                        if self.stands(piece) and (not last or self.fits(last, piece)):
                            found = (0.0, start, piece)
                            break
                    else:
                        total = states[start][0] + score
                        if found is None or total > found[0]:
                            found = (total, start, piece)
                states.append(found)
            before, out, end = word, [], len(word)
            while end:
                _, end, piece = states[end]
                out.append(piece)
            yield out[::-1]


class PieceEncoder(Encoder):
    """Ids as the sentencepiece library gives them; see encoding.Encoder for the cache."""

    def __init__(self, path: str, limit: int = 300_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, n = self.model, self.model.get_piece_size()
        names = [m.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.number = {names[i]: i for i in normal}
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.unknown = m.unk_id()
        # merges by rank have the scores 0, -1, -2 ...; unigram scores are logarithms of shares
        scores = {names[i]: m.get_score(i) for i in normal}
        self.pieces = Pieces(scores, all(float(s).is_integer() for s in scores.values()))
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.number):
            raise ValueError("a piece of this model reaches over a space or a line feed")
        if m.normalize("Ａ  b ") != MARK + "Ａ" + 2 * MARK + "b" + MARK:
            raise ValueError("only models without normalisation of texts are supported")
        self.limit, self.cache, self.older = limit, {}, {}
        self.type = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.raw = [bytes([int(names[i][3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else (" ⁇ " if m.is_unknown(i) else names[i].replace(MARK, " ")).encode() for i in range(n)]

    def _pieces(self, texts):
        import pyarrow as pa

        out, begins = [], [0]
        for t in texts:
            if t and plain(t):
                out += (b" " + t).replace(b" ", b"\0 ").replace(b"\n", b"\0\n\0")[1:].split(b"\0")
            elif t:
                out += WORDS.findall(b" " + t)
            begins.append(len(out))
        return pa.array(out, pa.large_binary()), np.array(begins)

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        words = [p.decode("utf-8", "replace").replace(" ", MARK) for p in pieces]
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=words.__getitem__)
        for i, found in zip(order, self.pieces.segment([words[i] for i in order]), strict=True):
            ids: list[int] = []
            for piece in found:
                k = self.number.get(piece)
                if k is not None:
                    ids.append(k)
                elif self.bytes:
                    ids += [self.bytes[b] for b in piece.encode()]
                elif not ids or ids[-1] != self.unknown:
                    ids.append(self.unknown)
            out[i] = np.array(ids, self.type).tobytes()
        return out

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


CACHES.append(piece_encoder)


def piece_ids(docs: DataFrame, model: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids (array<int>), decoded (the text that the ids give)."""

    def run(record_batches):
        import pyarrow as pa

        for part in batches(arrow_rows(record_batches, "doc_id", "text"), lambda r: len(r[1] or b""), 4 << 20, caching=True):
            encode = piece_encoder(model)
            ids = encode([r[1] for r in part])
            offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in ids])], pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), lists, pa.array([encode.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op7_shared_prefix_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by piece_bpe_32k and back: doc_id, n_tokens, ids_crc32 (as little-endian uint32), round_trip."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")

    def run(record_batches):
        import pyarrow as pa

        for part in batches(arrow_rows(record_batches, "doc_id", "text"), lambda r: len(r[1] or b""), 4 << 20, caching=True):
            encode = piece_encoder(model)
            ids = encode([r[1] for r in part])
            same = [encode.decode(x).encode() == (r[1] or b"") for r, x in zip(part, ids, strict=True)]
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
