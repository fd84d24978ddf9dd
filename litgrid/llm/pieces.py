"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text is marked (a mark before it and for each space) and cut into marked words, which no piece crosses. The distinct
words of a batch are sorted, so that they are a trie read depth-first: each word keeps the forward state of the prefix it
shares with the one before it and goes on from there. For a model of the unigram kind the state of a prefix is the best
sum of scores and the piece it ends with (Viterbi). For one of the BPE kind sums of scores do not give the library's
pieces; there the state is the piece with which the encoding of the prefix ends, and a piece may follow another if the
merges of the two together give just these two: an encoding all of whose neighbours may follow each other is the encoding
of the whole, so every prefix has one such state.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litgrid.llm.batches import give_back, map_texts
from litgrid.llm.bytesops import as_bytes, spread, word_hashes

MARK = "▁"
#: Words remembered in one Python worker since the memory was last full, and as many from before; pairs of pieces, whose
#: memory starts anew when it is full.
KEPT_WORDS = 200_000
KEPT_PAIRS = 400_000
UNIGRAM, BPE = 1, 2


class PieceModel:
    """The tables of a model file; read on the driver."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, self.kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces) or proto.trainer_spec.treat_whitespace_as_suffix or not proto.trainer_spec.byte_fallback:
            raise ValueError(f"{path}: only unigram and BPE models with byte fallback, a prefix mark and no normalisation are supported")
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        if any(p.startswith(MARK) != (MARK in p) or (p.lstrip(MARK) and p.startswith(MARK * 2)) for p, s in zip(self.pieces, special, strict=True) if not s):
            raise ValueError(f"{path}: a piece crosses marked words")
        self.ids = {p: i for i, (p, s) in enumerate(zip(self.pieces, special, strict=True)) if not s}
        self.scores = [sp.get_score(i) for i in range(n)]
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = min(self.scores[i] for i in self.ids.values()) - 10
        #: Of the last four characters of longer pieces: the lengths of the pieces that end so, the longest first.
        sizes: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) >= 4:
                sizes.setdefault(p[-4:], set()).add(len(p))
        self.sizes = {k: (*sorted(v, reverse=True), 3, 2, 1) for k, v in sizes.items()}
        raw = [b"" if s else p.replace(MARK, " ").encode() for p, s in zip(self.pieces, special, strict=True)]
        for b, i in enumerate(self.bytes):
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_lens = np.array([len(x) for x in raw])
        self.raw_starts = np.cumsum(self.raw_lens) - self.raw_lens


class Encoder:
    def __init__(self, model: PieceModel) -> None:
        self.m = model
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.kind = np.dtype("<u2" if len(model.pieces) < 1 << 16 else "<u4")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.spaces: dict[int, list[int]] = {}
        self.reachable: set[int] = set()  # pieces that their own merges give

    def merged(self, symbols: list[str]) -> list[int]:
        """The pieces of a short string of known characters by its merges themselves, best score first and then leftmost."""
        ids, scores = self.m.ids, self.m.scores
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        symbols = list(symbols)
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            k = ids.get(s := symbols[i] + symbols[j])
            if k is not None:
                heapq.heappush(heap, (-scores[k], i, s))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, s = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != s:
                continue
            symbols[i], symbols[j] = s, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        return [ids[s] for s in symbols if s]

    def follows(self, a: int, b: int) -> bool:
        """Whether pieces a and b stay as they are next to each other."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            p = self.m.pieces
            known = self.pairs[a, b] = self.merged(list(p[a] + p[b])) == [a, b]
        return known

    def whole(self, piece: int) -> bool:
        known = self.merged(list(self.m.pieces[piece])) == [piece]
        if known:
            self.reachable.add(piece)
        return known

    def run_of_marks(self, n: int) -> list[int]:
        if n not in self.spaces:
            if len(self.spaces) > 10_000:
                self.spaces.clear()
            self.spaces[n] = self.merged([MARK] * n)
        return self.spaces[n]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The pieces of each marked word (with spaces for marks), as numbers of the encoder's kind."""
        older, code = self.older, self.kind.char
        found: list[bytes | None] = [self.words.get(w) or older.get(w) for w in words]
        new = sorted((w.lstrip(b" ").decode(), i) for i, w in enumerate(words) if found[i] is None)
        if len(self.words) + len(new) > KEPT_WORDS:
            self.older, self.words = self.words, {}
        for (_, i), (own, rest) in zip(new, self._depth_first([w for w, _ in new]), strict=True):
            w = words[i]
            marks = len(w) - len(w.lstrip(b" "))
            # the last mark belongs to the word unless it is a piece of its own there
            if self.m.kind == BPE:
                alone = not own or own[0] == self.m.ids.get(MARK)
                lead = marks if alone else marks - 1
                own = (self.run_of_marks(lead) if lead > 0 else []) + (own[1:] if alone else own)
            elif marks > 1:
                own = next(self._depth_first([MARK * (marks - 1) + rest], prefix=False))[0]
            found[i] = array(code, own).tobytes()
            if len(self.words) < KEPT_WORDS:
                self.words[w] = found[i]
        return found

    def _depth_first(self, words: list[str], prefix: bool = True):
        """For each of these sorted words: its pieces with one mark before it, and the marked word."""
        m = self.m
        ids, sizes, bpe, pairs, whole, short = m.ids, m.sizes, m.kind == BPE, self.pairs, self.reachable, (3, 2, 1)
        # of each prefix: the piece it ends with (-1: bytes), where that begins, the sum of scores
        last, start, total = [-1], [0], [0.0]
        prev = ""
        for word in words:
            w = MARK + word if prefix else word
            n = 0
            for a, b in zip(prev, w, strict=False):
                if a != b:
                    break
                n += 1
            del last[n + 1 :], start[n + 1 :], total[n + 1 :]
            for end in range(n + 1, len(w) + 1):
                best, at = -1, end - 1
                if bpe:
                    for size in sizes.get(w[end - 4 : end] if end > 3 else "", short):
                        if size > end:
                            continue
                        i = end - size
                        k = ids.get(w[i:end])
                        if k is not None:
                            a = last[i]
                            ok = a < 0 or pairs.get((a, k))
                            if (ok or ok is None and self.follows(a, k)) and (k in whole or self.whole(k)):
                                best, at = k, i
                                break
                else:
                    score = total[end - 1] + m.unknown
                    for size in sizes.get(w[end - 4 : end] if end > 3 else "", short):
                        i = end - size
                        if i >= 0 and (k := ids.get(w[i:end])) is not None and total[i] + m.scores[k] > score:
                            best, at, score = k, i, total[i] + m.scores[k]
                    total.append(score)
                last.append(best)
                start.append(at)
            out: list[int] = []
            i = len(w)
            while i > 0:
                if last[i] >= 0:
                    out.append(last[i])
                else:
                    out.extend(m.bytes[b] for b in reversed(w[i - 1].encode()))
                i = start[i]
            out.reverse()
            prev = w
            yield out, w

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The piece numbers of all texts one after the other, and how many each has."""
        marked = [b" " + t.replace(MARK.encode(), b" ") if t else b"" for t in texts]
        sizes = np.array([len(x) for x in marked], np.int64)
        raw = b"".join(marked)
        if not raw:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        buf = np.frombuffer(raw, np.uint8)
        new = buf == 0x20
        new[1:] &= buf[:-1] != 0x20
        bounds = np.cumsum(sizes) - sizes
        new[bounds[sizes > 0]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(buf))
        h = word_hashes(buf, ends - starts)
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        coded = self.encode_words(words)
        lens = np.array([len(c) for c in coded], np.int64) // self.kind.itemsize
        flat = np.frombuffer(b"".join(coded), self.kind).astype(np.int32)
        offset = np.cumsum(lens) - lens
        _, place = spread(lens[inverse])
        out = flat[np.repeat(offset[inverse], lens[inverse]) + place]
        doc = np.searchsorted(bounds[sizes > 0], starts, side="right") - 1
        counts = np.zeros(len(texts), np.int64)
        counts[np.flatnonzero(sizes > 0)] = np.bincount(doc, weights=lens[inverse], minlength=int((sizes > 0).sum())).astype(np.int64)
        return out, counts


def decode(ids: np.ndarray, counts: np.ndarray, m: PieceModel) -> list[bytes]:
    """The texts of these piece numbers: their bytes without the first mark's space; invalid UTF-8 is replaced."""
    lens = m.raw_lens[ids]
    _, place = spread(lens)
    raw = m.raw[np.repeat(m.raw_starts[ids], lens) + place].tobytes()
    at = np.r_[0, np.cumsum(lens)]
    cuts = at[np.r_[0, np.cumsum(counts)]].tolist()
    parts = [raw[a + (raw[a : a + 1] == b" ") : b] for a, b in zip(cuts, cuts[1:], strict=False)]
    try:
        raw.decode()
    except UnicodeDecodeError:
        return [x.decode(errors="replace").encode() for x in parts]
    return parts


ENCODED = "doc_id long, ids array<int>, n_pieces long, ids_sha256 string"
DECODED = "doc_id long, text string"
BOTH = "doc_id long, ids array<int>, n_pieces long, ids_sha256 string, text string, text_sha256 string, lossless boolean"


def _ids_column(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids, pa.int32()))


def encode_decode(docs: DataFrame, model: str, decoded: bool = True) -> DataFrame:
    """Each row's piece numbers and, unless decoded is False, the text they decode to.

    docs: doc_id, text; other columns, whatever their names, are not read; a very long text is worked on whole in one task.
    model: a model file that the driver can read; its tables go to the
    executors. Returns doc_id, ids, n_pieces, ids_sha256 (of the numbers as little-endian 32-bit integers), text,
    text_sha256, lossless (the decoded text is the original; only marks inside a text become spaces). Numbers are those of
    the model's library without begin and end. Null and empty texts have no pieces and decode to an empty text. Repeated
    rows each give a row; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(PieceModel(model))

    def run(batch: pa.RecordBatch, encoder: Encoder) -> pa.RecordBatch:
        give_back()
        texts = as_bytes(batch.column("text"))
        ids, counts = encoder.encode(texts)
        cuts = np.r_[0, np.cumsum(counts)].tolist()
        data = ids.astype("<i4").tobytes()
        sums = [hashlib.sha256(data[4 * a : 4 * b]).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)]
        columns = [batch.column("doc_id"), _ids_column(ids, counts), pa.array(counts, pa.int64()), pa.array(sums, pa.string())]
        names = ["doc_id", "ids", "n_pieces", "ids_sha256"]
        if decoded:
            back = decode(ids, counts, encoder.m)
            columns += [pa.array(back, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()), pa.array([a == b for a, b in zip(back, texts, strict=True)], pa.bool_())]
            names += ["text", "text_sha256", "lossless"]
        return pa.record_batch(columns, names=names)

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, BOTH if decoded else ENCODED, lambda: _worker_encoder(shared))


def decode_pieces(rows: DataFrame, model: str) -> DataFrame:
    """doc_id, text of rows with doc_id, ids; null ids decode to an empty text, a null number to nothing."""
    shared = rows.sparkSession.sparkContext.broadcast(PieceModel(model))

    def run(batches):
        for batch in batches:
            ids = [[x for x in r or [] if x is not None] for r in batch.column("ids").to_pylist()]
            flat = np.array([x for r in ids for x in r], np.int64)
            texts = decode(flat, np.array([len(r) for r in ids], np.int64), shared.value)
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, DECODED)


_ENCODERS: dict[int, Encoder] = {}


def _worker_encoder(shared) -> Encoder:
    """The encoder of this Python worker; later tasks of the same broadcast find what earlier ones remembered."""
    if not _ENCODERS or _ENCODERS[0].m is not shared.value:
        _ENCODERS[0] = Encoder(shared.value)
    return _ENCODERS[0]


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_pieces", "ids_sha256", "text_sha256", "lossless")
