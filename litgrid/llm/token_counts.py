"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE tokenizer is compiled to a deterministic transducer with two layers. The outer one reads classes of
characters and marks on each transition where stretches of the splitting pattern begin. It has a dozen states, so a text is
cut into short chunks, each chunk's map from every state to the state after it is computed for all chunks in step, and the
maps are composed by a parallel prefix scan; with every chunk's true first state known, one more pass marks the boundaries.

The inner one reads the bytes of one stretch. Its state after a byte is the pending token, with which the encoding of what has
been read ends: the longest token that ends at this byte and may follow the state where it begins. A token may follow
another if the merges of the two together give just these two, which is compiled from the merges' ranks (`Tokens.follows`);
an encoding all of whose neighbours may follow each other is the encoding of the whole, so every prefix has one state. The
transition carries the number of tokens emitted so far, one more than where the pending token begins. Counts of stretches
are added up along the text by prefix sums. No merge is made at count time.

A state reaches back as far as its token, so maps of inner states are not composed; instead a stretch that was met before is
one transition, from a table of bounded size in each worker.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litgrid.llm.batches import map_texts
from litgrid.llm.bytesops import as_bytes, word_hashes

LIMIT = 512
CHUNK = 48
#: Slots of the table of known stretches in one Python worker (12 bytes each); it starts anew when half are taken.
SLOTS = 1 << 22
#: Longer stretches are read one by one.
LONG = 64
#: Pairs of tokens remembered in one worker; the memory starts anew when it is full.
KEPT_PAIRS = 2_000_000
NEVER = 1 << 40

# states: in letters, digits or other characters; in white space of one or several characters that ends in a space or
# in something else; after an apostrophe that can begin a contraction, and after its first letter; at a boundary
LETTERS, DIGITS, OTHER, SPACE1, SPACES, WHITE1, WHITES, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, FRESH = range(12)
# classes of characters; END stands after each text
C_LETTER, C_STMD, C_R, C_V, C_L, C_E, C_DIGIT, C_SPACE, C_WHITE, C_OTHER, C_QUOTE, C_END = range(12)
HERE, BEFORE = 1, 2  # a token begins at this character, at the one before it


@cache
def character_classes() -> np.ndarray:
    t = np.full(0x110000, C_OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            t[c] = C_LETTER
        elif k == "N":
            t[c] = C_DIGIT
    t[[*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = C_WHITE
    for chars, k in ((" ", C_SPACE), ("'", C_QUOTE), ("stmd", C_STMD), ("r", C_R), ("v", C_V), ("l", C_L), ("e", C_E)):
        t[[ord(c) for c in chars]] = k
    return t


@cache
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks by state and class."""
    letters = (C_LETTER, C_STMD, C_R, C_V, C_L, C_E)
    go, mark = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)
    fresh = {**dict.fromkeys(letters, LETTERS), C_DIGIT: DIGITS, C_SPACE: SPACE1, C_WHITE: WHITE1, C_OTHER: OTHER, C_QUOTE: QUOTE, C_END: FRESH}

    def put(state: int, changes: dict[int, tuple[int, int]], before: int = 0) -> None:
        for c, to in fresh.items():
            go[state, c], mark[state, c] = changes.get(c, (to, HERE | before))

    put(FRESH, {})
    put(LETTERS, {c: (LETTERS, 0) for c in letters})
    put(DIGITS, {C_DIGIT: (DIGITS, 0)})
    put(OTHER, {C_OTHER: (OTHER, 0), C_QUOTE: (OTHER, 0)})
    more = {C_SPACE: (SPACES, 0), C_WHITE: (WHITES, 0)}
    # a single space belongs to what follows; of a longer run only the last space does
    for state, m in ((SPACE1, 0), (SPACES, BEFORE)):
        put(state, {**more, **{c: (LETTERS, m) for c in letters}, C_DIGIT: (DIGITS, m), C_OTHER: (OTHER, m), C_QUOTE: (OTHER, m)})
    put(WHITE1, more)
    put(WHITES, {**more, C_END: (FRESH, HERE)}, BEFORE)
    put(QUOTE, {C_STMD: (FRESH, 0), C_R: (QUOTE_R, 0), C_V: (QUOTE_V, 0), C_L: (QUOTE_L, 0), C_OTHER: (OTHER, 0), C_QUOTE: (OTHER, 0)})
    for state, close in ((QUOTE_R, C_E), (QUOTE_V, C_E), (QUOTE_L, C_L)):
        put(state, {**{c: (LETTERS, BEFORE) for c in letters}, close: (FRESH, 0)}, BEFORE)
    return go, mark


def stretch_starts(classes: np.ndarray) -> np.ndarray:
    """Flags of the characters at which a stretch begins. The last class must be END."""
    go, mark = transducer()
    n = len(classes)
    k = -(-n // CHUNK)
    grid = np.full(k * CHUNK, C_END, np.uint8)
    grid[:n] = classes
    steps = np.ascontiguousarray(grid.reshape(k, CHUNK).T)
    flat, flat_mark = go.ravel(), mark.ravel()
    maps = np.repeat(np.arange(12, dtype=np.uint8)[:, None], k, axis=1)
    for row in steps:
        maps = flat[maps * np.uint8(12) + row]
    # inclusive scan of the composed maps
    d = 1
    while d < k:
        later = maps[:, d:]
        maps = np.concatenate([maps[:, :d], np.take_along_axis(later, maps[:, :-d].astype(np.int64), axis=0)], axis=1)
        d *= 2
    state = np.full(k, FRESH, np.uint8)
    state[1:] = maps[FRESH, :-1]
    marks = np.empty((CHUNK, k), np.uint8)
    for j, row in enumerate(steps):
        at = state * np.uint8(12) + row
        marks[j] = flat_mark[at]
        state = flat[at]
    marks = marks.T.ravel()[:n]
    out = (marks & HERE) > 0
    out[:-1] |= (marks[1:] & BEFORE) > 0
    return out


class Tokens:
    """The tables of a byte-level BPE tokenizer: tokens as paths of bytes read backwards, and which token may follow which."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"{path}: only byte-level BPE with its own splitting pattern is compiled")
        vocab = model["vocab"]
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        odd = [b for b in range(256) if b not in plain]
        sign = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}
        back = {c: b for b, c in sign.items()}
        self.byte_ids = np.array([vocab[sign[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        n = max(vocab.values()) + 1
        #: Of each token the rank of the merge that makes it (-1 for a byte) and its two parts.
        self.born, self.left, self.right = np.full(n, -1, np.int64), np.arange(n), np.arange(n)
        for rank, (a, b) in reversed([*enumerate(pairs)]):
            t = vocab[a + b]
            self.born[t], self.left[t], self.right[t] = rank, vocab[a], vocab[b]
        bits = 18
        self.shift, self.maybe = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.maybe[self._slot(self.keys)] = True
        self.specials = [t["content"].encode() for t in spec["added_tokens"]]
        self._compile([(bytes(back[c] for c in text), t) for text, t in vocab.items() if all(c in back for c in text) and (self.born[t] >= 0 or len(text) == 1)])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair; NEVER where there is none."""
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        out = np.full(len(key), NEVER, np.int64)
        maybe = np.flatnonzero(self.maybe[self._slot(key)])
        at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
        ok = self.keys[at] == key[maybe]
        out[maybe[ok]] = self.ranks[at[ok]]
        return out

    def follows(self, a: np.ndarray, b: np.ndarray, joined: bool = False) -> np.ndarray:
        """Whether each pair of tokens stays as it is; joined: or gives the token that is made of the two.

        The merges within both are taken back, the latest first (of the same rank the right one, as the left one is made
        first). The parts x and y that stand at the border until some merge takes one of them would have merged with each
        other instead if the rank of their merge is less, or equal where the part on the right is taken.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        until, out, live = np.full(len(x), NEVER, np.int64), np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            bad = (self.rank(x[live], y[live]) < until[live]) & ~((until[live] == NEVER) & joined)
            out[live[bad]] = False
            live = live[~bad]
            bx, by = self.born[x[live]], self.born[y[live]]
            more = (bx >= 0) | (by >= 0)
            live, bx, by = live[more], bx[more], by[more]
            on_left = bx > by
            who = live[on_left]
            until[who], x[who] = bx[on_left], self.right[x[who]]
            who = live[~on_left]
            until[who], y[who] = by[~on_left] + 1, self.left[y[who]]
        return out

    def _compile(self, tokens: list[tuple[bytes, int]]) -> None:
        """The paths of all tokens read from their last byte: sorted keys of node and byte, the next nodes, and the token of each node. Tokens that their own merges don't give have none."""
        ids = np.array([t for _, t in tokens])
        sound = {int(t) for t, ok in zip(ids, (self.born[ids] < 0) | self.follows(self.left[ids], self.right[ids], True), strict=True) if ok}
        nodes: dict[tuple[int, int], int] = {}
        token = [-1]
        for raw, t in tokens:
            node = 0
            for byte in reversed(raw):
                key = (node, byte)
                if key not in nodes:
                    nodes[key] = len(token)
                    token.append(-1)
                node = nodes[key]
            if t in sound:
                token[node] = t
        self.paths = {(node << 8) | byte: to for (node, byte), to in nodes.items()}
        keys = np.array(sorted(self.paths), np.int64)
        self.path_keys, self.path_to, self.token_at = keys, np.array([self.paths[k] for k in keys.tolist()]), np.array(token)


class Reader:
    """Runs the inner transducer, and remembers which tokens may follow which."""

    def __init__(self, tokens: Tokens) -> None:
        self.t = tokens
        self.pairs: dict[int, bool] = {}

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token b may follow state a (-1: the beginning)."""
        key = ((a + 1) << 32) | b
        new, inverse = np.unique(key, return_inverse=True)
        known = [self.pairs.get(k) for k in new.tolist()]
        todo = np.array([i for i, k in enumerate(known) if k is None], np.int64)
        if len(todo):
            x, y = (new[todo] >> 32) - 1, new[todo] & ((1 << 32) - 1)
            ok = x < 0
            ok[~ok] = self.t.follows(x[~ok], y[~ok])
            if len(self.pairs) + len(todo) > KEPT_PAIRS:
                self.pairs.clear()
            self.pairs.update(zip(new[todo].tolist(), ok.tolist(), strict=True))
            for i, k in zip(todo.tolist(), ok.tolist(), strict=True):
                known[i] = k
        return np.array(known, bool)[inverse]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word; all words are read in step."""
        out = np.array([len(w) for w in words], np.int64)
        for i in np.flatnonzero(out > LONG):
            out[i] = self._one(words[i])
        short = np.flatnonzero((out > 1) & (np.array([len(w) for w in words]) <= LONG)) if len(words) else np.zeros(0, np.int64)
        short = short[np.argsort(-out[short], kind="stable")]  # those still being read are the first ones
        if not len(short):
            return out
        size = out[short]
        width = int(size[0])
        grid = np.zeros((len(short), width), np.int64)
        grid[np.arange(width) < size[:, None]] = np.frombuffer(b"".join([words[i] for i in short]), np.uint8)
        state, emitted = np.full((len(short), width + 1), -1, np.int64), np.zeros((len(short), width + 1), np.int64)
        t = self.t
        for end in range(1, width + 1):
            rows = int(np.searchsorted(-size, -end, side="right"))
            # all tokens that end here, by the number of bytes they reach back
            who, node, found = np.arange(rows), np.zeros(rows, np.int64), []
            for back in range(1, end + 1):
                key = (node << 8) | grid[who, end - back]
                at = np.minimum(np.searchsorted(t.path_keys, key), len(t.path_keys) - 1)
                on = t.path_keys[at] == key
                who, node = who[on], t.path_to[at[on]]
                if not len(who):
                    break
                token = t.token_at[node]
                some = token >= 0
                found.append((who[some], token[some], end - back))
            todo = np.ones(rows, bool)
            for who, token, begin in reversed(found):
                open_ = todo[who]
                who, token = who[open_], token[open_]
                if len(who):
                    ok = self.allowed(state[who, begin], token)
                    who, token = who[ok], token[ok]
                    state[who, end], emitted[who, end], todo[who] = token, emitted[who, begin] + 1, False
        out[short] = emitted[np.arange(len(short)), size]
        return out

    def _one(self, word: bytes) -> int:
        """The same for a long word."""
        paths, token_at, pairs = self.t.paths, self.t.token_at.tolist(), self.pairs
        state, emitted = [-1], [0]
        for end in range(1, len(word) + 1):
            node, found = 0, []
            for begin in range(end - 1, -1, -1):
                node = paths.get((node << 8) | word[begin])
                if node is None:
                    break
                if token_at[node] >= 0:
                    found.append((begin, token_at[node]))
            for begin, token in reversed(found):
                key = ((state[begin] + 1) << 32) | token
                ok = pairs.get(key)
                if ok is None:
                    ok = bool(self.allowed(np.array([state[begin]]), np.array([token]))[0])
                if ok:
                    state.append(token)
                    emitted.append(emitted[begin] + 1)
                    break
        return emitted[-1]


class Counter:
    """Counts the tokens of texts; keeps the counts of stretches already met, by 64 bits of hash. With the half of SLOTS that are
    taken at most, a stretch that was not met is taken for another with a chance of 1 in 10 ** 13."""

    def __init__(self, tokens: Tokens, slots: int = SLOTS) -> None:
        self.tokens, self.reader, self.slots = tokens, Reader(tokens), slots
        self._clear()

    def _clear(self) -> None:
        self.keys, self.values, self.taken = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slots of these hashes: their own, or the free one where each would go."""
        mask = self.slots - 1
        at = (h & np.uint64(mask)).astype(np.int64)
        todo = np.flatnonzero((self.keys[at] != h) & (self.keys[at] != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            k = self.keys[at[todo]]
            todo = todo[(k != h[todo]) & (k != 0)]
        return at

    def _learn(self, h: np.ndarray, words: list[bytes]) -> None:
        counts = self.reader.counts(words)
        todo = np.arange(len(h))
        while len(todo):
            at = self._find(h[todo])
            _, first = np.unique(at, return_index=True)
            won = todo[first]
            self.keys[at[first]], self.values[at[first]] = h[won], counts[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
        self.taken += len(h)

    def stretch_counts(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = word_hashes(buf, ends - starts) | np.uint64(1)
        at = self._find(h)
        missing = np.flatnonzero(self.keys[at] != h)
        if len(missing):
            new, first = np.unique(h[missing], return_index=True)
            if self.taken + len(new) > self.slots // 2:
                self._clear()
                new, first = np.unique(h, return_index=True)
                missing = np.arange(len(h))
                while self.slots < 4 * len(new):
                    self.slots *= 2
                    self._clear()
            raw = buf.tobytes()
            places = missing[first]
            self._learn(new, [raw[a:b] for a, b in zip(starts[places].tolist(), ends[places].tolist(), strict=True)])
            at = self._find(h)
        return self.values[at]

    def count(self, texts: list[bytes]) -> np.ndarray:
        specials = self.tokens.specials
        out = np.zeros(len(texts), np.int64)
        parts, own = texts, np.arange(len(texts))
        for s in specials:
            if any(s in x for x in parts):
                cut = [x.split(s) for x in parts]
                sizes = np.array([len(c) for c in cut])
                out += np.bincount(own, weights=sizes - 1, minlength=len(texts)).astype(np.int64)
                own = np.repeat(own, sizes)
                parts = [y for c in cut for y in c]
        buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        if len(buf) > 1 or parts:
            lead = (buf & 0xC0) != 0x80
            at = np.flatnonzero(lead)
            if lead.all():
                classes = character_classes()[buf]
            else:
                classes = character_classes()[np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)]
            bounds = np.cumsum([len(x) + 1 for x in parts]) - 1
            classes[np.searchsorted(at, bounds)] = C_END
            starts = at[stretch_starts(classes)]
            ends = np.r_[starts[1:], len(buf)]
            n = self.stretch_counts(buf, starts, ends).astype(np.int64)
            n[np.searchsorted(starts, bounds)] = 0  # the separators
            doc = np.searchsorted(bounds, starts)
            out += np.bincount(own[doc], weights=n, minlength=len(texts)).astype(np.int64)
        return out


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row.

    docs: doc_id, text; other columns, whatever their names, are not read. tokenizer: a tokenizer file that the driver can read (byte-level BPE in
    JSON); its tables go to the executors. Counts are those of its library without added tokens; strings of special
    tokens inside texts are one token each. Null and empty texts have no tokens; a very long text is counted whole in one
    task, with some 60 bytes of memory for each of its bytes; repeated rows each give a row; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Tokens(tokenizer))

    def run(batch: pa.RecordBatch, counter: Counter) -> pa.RecordBatch:
        texts = as_bytes(batch.column("text"))
        n = counter.count(texts)
        return pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", lambda: _worker_counter(shared))


_COUNTERS: dict[int, Counter] = {}


def _worker_counter(shared) -> Counter:
    """The counter of this Python worker; later tasks of the same broadcast find what earlier ones compiled."""
    if shared.value not in [c.tokens for c in _COUNTERS.values()]:
        _COUNTERS.clear()
        _COUNTERS[0] = Counter(shared.value)
    return _COUNTERS[0]


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
