"""A hierarchical Pitman-Yor language model: training, Gibbs sampling and scoring in one pass of messages between buckets.

Tokens are words and an end of each text. The restaurant of a context (the word before, or the beginning of a text) has
the words that follow it as dishes; its tables are customers of the restaurant of single words, which all contexts share,
and whose base is uniform over the known words and one unknown. A state of the sampler is the number of tables of each
dish in each restaurant; a sweep draws it anew for every dish given the others, exactly by the generalised Stirling numbers.
Dishes with more than EXACT customers, for which those numbers would need tables that grow with the square, are seated in turn
instead, in blocks, which favours more tables than the exact draw. While a bucket sweeps, the tables of a context are those
here now and those elsewhere when buckets last told each other, which they do after BURN_IN sweeps that are left out of the
result. Then follow SAMPLES sweeps whose seatings are kept, and the buckets tell each other the totals of every one of them; so
each sample's predictive probabilities come from totals that are true of it and sum to one, and the scores are those of
their mean.

Where things are: texts are read once. A bucket holds all occurrences of its words, each with the word before and the
document; so what the restaurant of single words knows of a word is there, and the texts' sums go back from there. What a
bucket needs of a context, its customers and tables in all buckets, it asks of the bucket that has the context as a word.
Later rounds only send numbers in the order of the first question. A word that may be over 1/64 of all tokens (there are
at most 128) is dealt to all buckets by the word before it. What holds for all buckets, the totals and what is known of those
words as a whole, each bucket sends in one row of bounded length to one place, which sends the sums back to each. A bucket
writes to those alone that it has a context or a document of, and holds nothing longer than its own occurrences. The draws
are seeded by bucket and sweep, so a task that runs again draws the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litgrid.llm.batches import pieces
from litgrid.llm.bytesops import Words, as_bytes, mix
from litgrid.llm.exchange import pack, small, unpack
from litgrid.session import ready_checkpoints, ready_workers

FOLDS = 10
#: Discounts and strengths of the contexts' restaurants and of that of single words.
D2, S2, D1, S1 = 0.75, 1.0, 0.7, 1.0
#: Sweeps of burn-in, and sweeps whose predictions are averaged.
BURN_IN, SAMPLES = 6, 10
PIECE = 4 << 20
BUCKET_BYTES = 12 << 20
#: Words with at least this share of all tokens are dealt by context.
HOT_SHARE = 1 / 64
#: The name of the end of a text; as a context it is the beginning of one.
END = np.uint64(0x5DEECE66D1234567)
#: Contexts go by the leading bits of their words' hashes; words that agree in them share a restaurant (among 10 million words some 45 pairs).
NAME_BITS = 40
#: Dishes with more customers are seated in turn instead of by Stirling numbers, whose table grows with the square.
EXACT = 512
#: Where all totals go, and who sends the sums; who keeps a bucket's own seating for its next round. Messages to owners and the
#: root have their round and TOLD, so that a bucket tells them from the answers.
ROOT, KEPT, TOLD = -(1 << 62), -(1 << 61), 100
MESSAGE = "dest long, src long, round int, payload binary"
ARROW = pa.schema([("dest", pa.int64()), ("src", pa.int64()), ("round", pa.int32()), ("payload", pa.binary())])
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _fold(doc_ids: list[int | None], folds: int) -> np.ndarray:
    import zlib

    return np.array([d is not None and zlib.crc32(str(d).encode()) % folds == 0 for d in doc_ids], bool)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens, text after text, and how many each text has."""
    w = Words(texts, lower=True)
    n = w.counts + 1
    ends = np.cumsum(n) - 1
    word = np.empty(int(n.sum()), np.uint64)
    inner = np.ones(len(word), bool)
    inner[ends] = False
    word[inner], word[ends] = w.hash, END
    return word, n


def survey(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Bytes of all texts, and the words that may have HOT_SHARE of all tokens, sorted.

    A piece of text names the words with half that share of it; a word with the share overall gets half of it from such
    pieces. So those with half the share by these counts are all of them, and at most 2 / HOT_SHARE.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for piece in pieces(whole, limit=PIECE):
                texts = as_bytes(piece.column("text"))
                word, counts = np.unique(tokens(texts)[0], return_counts=True)
                often = counts >= counts.sum() * HOT_SHARE / 2
                n = int(often.sum()) + 1
                yield pa.record_batch([pa.array(np.r_[word[often].view(np.int64), 0]), pa.array(np.r_[counts[often], 0]), pa.array(np.r_[np.zeros(n - 1, np.int64), counts.sum()]), pa.array(np.r_[np.zeros(n - 1, np.int64), sum(map(len, texts))])], names=["word", "n", "tokens", "bytes"])

    found = docs.mapInArrow(run, "word long, n long, tokens long, bytes long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes")).checkpoint()
    total = found.agg(F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes")).first()
    hot = found.where(F.col("n") >= max(1, (total["tokens"] or 0) * HOT_SHARE / 2)).limit(int(2 / HOT_SHARE)).collect()
    return total["bytes"] or 0, np.sort(np.array([r["word"] for r in hot], np.int64).view(np.uint64))


def occurrences(bits: int, folds: int, hot: np.ndarray):
    """For mapInArrow over (doc_id, text): a message to each bucket, and one of the documents themselves to dest -1 - batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = TaskContext.get().partitionId() << 32
        for whole in batches:
            for piece in pieces(whole, limit=PIECE):
                rows = _occurrences(piece, batch, bits, folds, hot)
                for k in range(0, len(rows), 32):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 32], schema=ARROW)
                batch += 1

    return run


def _occurrences(piece: pa.RecordBatch, batch: int, bits: int, folds: int, hot: np.ndarray) -> list[dict]:
    ids = piece.column("doc_id").to_pylist()
    held = _fold(ids, folds)
    word, n = tokens(as_bytes(piece.column("text")))
    doc = np.repeat(np.arange(len(n)), n)
    before = np.r_[END, word[:-1]] >> np.uint64(64 - NAME_BITS)  # after an end comes a beginning
    none = pa.array(ids, pa.int64())
    meta = pack(np.array([x if x is not None else 0 for x in ids], np.int64), np.array(none.is_null()).astype(np.uint8), held.astype(np.uint8), n.astype(np.int64))
    rows = [{"dest": -1 - batch, "src": batch, "round": 0, "payload": meta}]
    shift = np.uint64(64 - bits)
    bucket = word >> shift
    common = np.isin(word, hot)
    bucket[common] = mix(word[common] ^ before[common]) >> shift
    order = np.lexsort((word, bucket))
    word, before, doc = word[order], before[order], doc[order]
    to, cuts = np.unique(bucket[order], return_index=True)
    cuts = [*cuts.tolist(), len(order)]
    train = np.packbits(~held)
    for b, a, z in zip(to.tolist(), cuts, cuts[1:], strict=False):
        if z > a:
            new = np.flatnonzero(np.r_[True, word[a + 1 : z] != word[a : z - 1]])
            names, at = np.unique(before[a:z], return_inverse=True)
            steps = np.diff(names, prepend=np.uint64(0))
            rows.append({"dest": b, "src": batch, "round": 0, "payload": pack(word[a:z][new], small(np.diff(new, append=z - a)), small(steps), small(at), small(doc[a:z]), train, np.array([len(n)], np.int64))})
    return rows


class Bucket:
    """All occurrences of a bucket's words, as types (word, context)."""

    def __init__(self, messages: pa.Table, hot: np.ndarray) -> None:
        got = sorted(zip(messages["src"].to_pylist(), messages["payload"].to_pylist(), strict=True))
        words, repeats, names, docs, train, self.batches, offset = [], [], [], [], [], [], 0
        for src, payload in got:
            w, counts, steps, at, doc, bits, n = unpack(payload)
            words.append(w)
            repeats.append(counts.astype(np.int64))
            names.append(np.cumsum(steps.astype(np.uint64))[at])
            train.append(np.unpackbits(bits, count=int(n[0])).astype(bool)[doc])
            own, at_doc = np.unique(doc, return_inverse=True)  # the batch's documents that have words here
            docs.append(at_doc + offset)
            self.batches.append((src, offset, own))
            offset += len(own)
        self.n_docs, self.doc = offset, np.concatenate(docs)
        self.words, index = np.unique(np.concatenate(words), return_inverse=True)
        index = np.repeat(index, np.concatenate(repeats))  # a message has a word once
        del words, repeats
        key = (index.astype(np.uint64) << np.uint64(NAME_BITS)) | np.concatenate(names)
        del names, index
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        self.type_of = np.empty(len(key), np.int32)
        self.type_of[order] = (np.cumsum(new) - 1).astype(np.int32)
        types = key[new]
        self.word = (types >> np.uint64(NAME_BITS)).astype(np.int64)
        self.c = np.bincount(self.type_of, weights=np.concatenate(train), minlength=len(types)).astype(np.int64)
        self.contexts, self.context = np.unique(types & np.uint64((1 << NAME_BITS) - 1), return_inverse=True)
        self.c_word = np.bincount(self.word, weights=self.c, minlength=len(self.words)).astype(np.int64)
        self.n_hot, self.hot_words = len(hot), hot
        self.hot = np.flatnonzero(np.isin(self.words, hot))  # the bucket's common words, and which of all they are
        self.hot_of = np.searchsorted(hot, self.words[self.hot])

    def of_hot(self, values: np.ndarray) -> np.ndarray:
        """Values of the bucket's words as those of all common words."""
        out = np.zeros(self.n_hot, np.int64)
        out[self.hot_of] = values[self.hot]
        return out

    def totals(self, tables: np.ndarray, word_tables: np.ndarray, first: bool) -> np.ndarray:
        """What all buckets are told: tokens, known words, seats, tables, and the counts and seats of common words; words and tables without those of common words."""
        rare = np.ones(len(self.words), bool)
        rare[self.hot] = False
        seats = np.bincount(self.word, weights=tables, minlength=len(self.words)).astype(np.int64)
        head = [self.c.sum() if first else 0, (self.c_word[rare] > 0).sum() if first else 0, tables.sum(), word_tables[rare].sum()]
        return np.concatenate([np.array(head, np.int64), self.of_hot(self.c_word), self.of_hot(seats)])

    def by_context(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, weights=values, minlength=len(self.contexts)).astype(np.int64)

    def segments(self, bits: int) -> Iterator[tuple[int, slice]]:
        """The buckets that own some of this one's contexts, and which those are."""
        owners, cuts = np.unique(self.contexts >> np.uint64(NAME_BITS - bits), return_index=True)
        cuts = [*cuts.tolist(), len(self.contexts)]
        for b, a, z in zip(owners.tolist(), cuts, cuts[1:], strict=False):
            yield b, slice(a, z)


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], ARROW.field(n).type) for i, n in enumerate(ARROW.names)}, schema=ARROW)


def questions(bits: int, hot: np.ndarray):
    """Round 0 of a bucket: the contexts of its words with their tables here, to the contexts' owners."""

    def run(table: pa.Table) -> pa.Table:
        b = table["dest"][0].as_py()
        if b < 0:
            return ARROW.empty_table()
        own = Bucket(table, hot)
        seated = (own.c > 0).astype(np.int64)
        tables = own.by_context(seated)
        totals = own.totals(seated, (own.c_word > 0).astype(np.int64), True)
        return _rows([(ROOT, b, 0, pack(totals)), *((to, b, 0, pack(small(np.diff(own.contexts[s], prepend=np.uint64(0))), small(tables[s]))) for to, s in own.segments(bits))])

    return run


def _names(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps.astype(np.uint64))


def _sums(rows: pa.Table, turn: int) -> pa.Table:
    """The sums of all totals, to every bucket."""
    total = sum(unpack(p)[0] for p in rows["payload"].to_pylist())
    return _rows([(src, ROOT, turn, pack(total)) for src in rows["src"].to_pylist()])


def series(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """Arrays of whole numbers that are much alike, as the first one and the steps from each to the next."""
    steps = (b.astype(np.int64) - a for a, b in zip(arrays, arrays[1:], strict=False))
    return [small(arrays[0]), *(small((d << 1) ^ (d >> 63)) for d in steps)]


def unseries(parts: list[np.ndarray]) -> Iterator[np.ndarray]:
    now = parts[0].astype(np.int64)
    yield now
    for p in parts[1:]:
        p = p.astype(np.int64)
        now = now + ((p >> 1) ^ -(p & 1))
        yield now


def _replies(b: int, turn: int, asked: dict[int, np.ndarray], tables: dict[int, np.ndarray], customers=None) -> pa.Table:
    names, at = np.unique(np.concatenate(list(asked.values())), return_inverse=True)
    sums = np.bincount(at, weights=np.concatenate([tables[k] for k in asked]), minlength=len(names)).astype(np.int64)
    c = customers(names) if customers else None
    rows, a = [], 0
    for src, own in asked.items():
        i = at[a : a + len(own)]
        a += len(own)
        rows.append((src, b, turn, pack(small(sums[i]), *([small(c[i])] if c is not None else []))))
    return _rows(rows)


def first_replies(hot: np.ndarray):
    """Customers and tables of the contexts asked for, by the bucket that has them as words; those of common words are in the totals."""

    def run(words: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return ARROW.empty_table()
        here = asked["dest"][0].as_py()
        if here == ROOT:
            return _sums(asked, 0)
        got = sorted(zip(asked["src"].to_pylist(), asked["payload"].to_pylist(), strict=True))
        parts = {src: unpack(p) for src, p in got}
        names, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if words.num_rows:
            own = Bucket(words, hot)
            names, at = np.unique(own.words >> np.uint64(64 - NAME_BITS), return_inverse=True)
            count = np.bincount(at, weights=own.c_word, minlength=len(names)).astype(np.int64)

        def customers(of: np.ndarray) -> np.ndarray:
            if not len(names):
                return np.zeros(len(of), np.int64)
            i = np.minimum(np.searchsorted(names, of), len(names) - 1)
            return np.where(names[i] == of, count[i], 0)

        return _replies(here, 0, {k: _names(p[0]) for k, p in parts.items()}, {k: p[1].astype(np.int64) for k, p in parts.items()}, customers)

    return run


def later_replies(turn: int):
    """Tables of the contexts in each of the seatings told; the names are those of the first question."""

    def run(asked: pa.Table, now: pa.Table) -> pa.Table:
        told = [(s, unpack(p)) for s, p in zip(now["src"].to_pylist(), now["payload"].to_pylist(), strict=True) if s != KEPT]
        if not asked.num_rows or not told:
            return ARROW.empty_table()
        b = now["dest"][0].as_py()
        if b == ROOT:
            total = sum(p[0] for _, p in told)
            return _rows([(src, ROOT, turn, pack(total)) for src, _ in told])
        names = {s: _names(unpack(p)[0]) for s, p in sorted(zip(asked["src"].to_pylist(), asked["payload"].to_pylist(), strict=True))}
        parts = dict(told)
        _, at = np.unique(np.concatenate(list(names.values())), return_inverse=True)
        sums = [np.bincount(at, weights=np.concatenate(each)).astype(np.int64) for each in zip(*(unseries(parts[k]) for k in names), strict=True)]
        rows, first = [], 0
        for src, own in names.items():
            i = at[first : first + len(own)]
            first += len(own)
            rows.append((src, b, turn, pack(*series([x[i] for x in sums]))))
        return _rows(rows)

    return run


@cache
def log_stirling(n: int, d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of c customers at t tables, for c and t up to n."""
    s = np.full((n + 1, n + 1), -np.inf)
    s[0, 0] = 0.0
    t = np.arange(n + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(n):
            stay = s[c] + np.log(np.maximum(c - d * t, 0))
            s[c + 1] = np.logaddexp(np.r_[-np.inf, s[c][:-1]], stay)
    return s


def alike(c: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The numbers of customers from 2 to EXACT that occur, by size, and the dishes that have them, in their order; found by one sort instead of a look at all dishes for each number."""
    some = np.flatnonzero((c > 1) & (c <= EXACT))
    some = some[np.argsort(c[some].astype(np.int16), kind="stable")]
    cuts = [0, *(np.flatnonzero(np.diff(c[some])) + 1).tolist(), len(some)]
    for a, z in zip(cuts, cuts[1:], strict=False):
        if z > a:
            yield int(c[some[a]]), some[a:z]


def draw_tables(c: np.ndarray, t: np.ndarray, log_parent: np.ndarray, others: np.ndarray, d: float, strength: float, rng: np.random.Generator, stirling: np.ndarray) -> np.ndarray:
    """New numbers of tables for dishes with c customers; others: the tables of the other dishes of the restaurant."""
    t = t.copy()
    for n, who in alike(c):
        k = np.arange(1, n + 1)
        # a table more: the parent's chance of the dish, and the chance to open it in this restaurant
        open_one = np.cumsum(np.log(strength + d * (others[who][:, None] + k - 1)), axis=1)
        score = stirling[n, 1 : n + 1] + k * log_parent[who][:, None] + open_one
        t[who] = 1 + np.argmax(score + rng.gumbel(size=score.shape), axis=1)
    who = np.flatnonzero(c > EXACT)
    if len(who):
        t[who] = _seat(c[who], np.exp(log_parent[who]), others[who], d, strength, rng)
    return t


def _seat(c: np.ndarray, parent: np.ndarray, others: np.ndarray, d: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes whose c customers sit down in blocks that grow by a tenth, within each of which the chance of a new table stays; each block is given those before but not those after."""
    seats, tables = np.ones(len(c)), np.ones(len(c))
    while (seats < c).any():
        block = np.where(seats < c, np.minimum(np.maximum(1, np.floor(seats * 0.1)), c - seats), 0)
        new = (strength + d * (others + tables)) * parent
        p = new / (new + np.maximum(seats - d * tables, 1e-12))
        tables += rng.binomial(block.astype(np.int64), np.clip(p, 0, 1))
        seats += block
    return tables.astype(np.int64)


class State:
    """The seating of a bucket's words, swept from the replies of round after round."""

    def __init__(self, own: Bucket, b: int, replies: dict[int, dict[int, list[np.ndarray]]]) -> None:
        self.own, self.b, self.replies = own, b, replies
        totals = replies[0][ROOT][0]
        self.hot_counts = totals[4 : 4 + own.n_hot]
        self.train_tokens, self.vocabulary = int(totals[0]), int(totals[1] + (self.hot_counts > 0).sum())
        self.c_context = self._told(0, 1)
        names = own.hot_words >> np.uint64(64 - NAME_BITS)
        for name in np.unique(names):  # of a common word only a part is where its contexts are owned
            self.c_context[own.contexts == name] = self.hot_counts[names == name].sum()
        self.t = (own.c > 0).astype(np.int64)
        self.t_word = (own.c_word > 0).astype(np.int64)
        self.tables2, self.tables1 = log_stirling(EXACT, D2), log_stirling(EXACT, D1)
        own.c_word[own.hot] = self.hot_counts[own.hot_of]
        self.read(totals, self._told(0, 0), (0,))

    def _told(self, turn: int, which: int) -> np.ndarray:
        """What the owners said of this bucket's contexts, in their order."""
        parts = [p[which] for src, p in sorted(self.replies[turn].items()) if src not in (ROOT, KEPT)]
        return np.concatenate(parts).astype(np.int64)

    def series_told(self, turn: int) -> Iterator[np.ndarray]:
        """What the owners said of this bucket's contexts, for each of the seatings they were told."""
        parts = [unseries(p) for src, p in sorted(self.replies[turn].items()) if src not in (ROOT, KEPT)]
        for each in zip(*parts, strict=True):
            yield np.concatenate(each)

    def read(self, totals: np.ndarray, told: np.ndarray, seed: tuple[int, ...]) -> None:
        """Takes over what all buckets hold together: totals, and the tables of this bucket's contexts."""
        self.away = told - self.own.by_context(self.t)
        seats = totals[4 + self.own.n_hot :]
        # every bucket draws the tables of common words from the same numbers in the same way
        base = np.full(len(seats), -math.log(self.vocabulary + 1))
        drawn = draw_tables(seats, (seats > 0).astype(np.int64), base, np.full(len(seats), int(totals[3])), D1, S1, np.random.default_rng(seed), self.tables1)
        self.customers, self.tables = int(totals[2]), int(totals[3] + drawn.sum())
        self.t_word[self.own.hot] = drawn[self.own.hot_of]
        self.elsewhere = np.zeros(len(self.own.words), np.int64)
        self.elsewhere[self.own.hot] = seats[self.own.hot_of] - self.seats_here()[self.own.hot]

    def kept(self, turn: int) -> list[np.ndarray]:
        return self.replies[turn][KEPT]

    def context_tables(self) -> np.ndarray:
        return self.away + self.own.by_context(self.t)

    def seats_here(self) -> np.ndarray:
        return np.bincount(self.own.word, weights=self.t, minlength=len(self.own.words)).astype(np.int64)

    def parent(self) -> np.ndarray:
        """The chance of each word in the restaurant of single words."""
        seated = self.seats_here() + self.elsewhere
        base = 1 / (self.vocabulary + 1)
        return (np.maximum(seated - D1 * self.t_word, 0) + (S1 + D1 * self.tables) * base) / (S1 + self.customers)

    def sweep(self, n: int, rng: np.random.Generator) -> None:
        own = self.own
        many = np.flatnonzero(own.c > 1)
        for _ in range(n):
            log_parent = np.log(self.parent()[own.word[many]])
            others = np.maximum(self.context_tables()[own.context[many]] - self.t[many], 0)
            self.t[many] = draw_tables(own.c[many], self.t[many], log_parent, others, D2, S2, rng, self.tables2)
            rare = np.ones(len(own.words), bool)
            rare[own.hot] = False
            seated = self.seats_here()[rare]
            base, t = np.full(len(seated), -math.log(self.vocabulary + 1)), self.t_word[rare]
            self.t_word[rare] = draw_tables(seated, np.minimum(seated, 1), base, np.maximum(self.tables - t, 0), D1, S1, rng, self.tables1)

    def predictive(self) -> np.ndarray:
        """The chance of each type's word after its context."""
        own = self.own
        c, t = self.c_context[own.context], self.context_tables()[own.context]
        back = np.where(c > 0, (S2 + D2 * t) / (S2 + c), 1.0)
        return np.maximum(own.c - D2 * self.t, 0) / (S2 + c) + back * self.parent()[own.word]


def _state(words: pa.Table, replies: pa.Table, hot: np.ndarray) -> State:
    rounds: dict[int, dict] = {}
    for turn, src, p in zip(replies["round"].to_pylist(), replies["src"].to_pylist(), replies["payload"].to_pylist(), strict=True):
        if turn < TOLD:
            rounds.setdefault(turn, {})[src] = unpack(p)
    return State(Bucket(words, hot), words["dest"][0].as_py(), rounds)


def burn_in(sweeps: int, bits: int, hot: np.ndarray):
    """Round 1 of a bucket: its tables after the burn-in to the contexts' owners, its totals to the root, its seating to itself."""

    def run(words: pa.Table, replies: pa.Table) -> pa.Table:
        if not words.num_rows or not replies.num_rows:
            return ARROW.empty_table()
        s = _state(words, replies, hot)
        s.sweep(sweeps, np.random.default_rng([s.b, 1]))
        tables = s.own.by_context(s.t)
        rows = [(ROOT, s.b, TOLD + 1, pack(s.own.totals(s.t, s.t_word, False))), (s.b, KEPT, 1, pack(small(s.t), small(s.t_word)))]
        return _rows([*rows, *((to, s.b, TOLD + 1, pack(small(tables[part]))) for to, part in s.own.segments(bits))])

    return run


def sample(samples: int, bits: int, hot: np.ndarray):
    """Round 2: the same of each of the seatings after further sweeps."""

    def run(words: pa.Table, replies: pa.Table) -> pa.Table:
        if not words.num_rows or not replies.num_rows:
            return ARROW.empty_table()
        s = _state(words, replies, hot)
        s.t, s.t_word = (x.astype(np.int64) for x in s.kept(1))
        s.read(s.replies[1][ROOT][0], next(s.series_told(1)), (1,))
        rng, seats, words_, tables, totals = np.random.default_rng([s.b, 2]), [], [], [], []
        for _ in range(samples):
            s.sweep(1, rng)
            seats.append(small(s.t))
            words_.append(small(s.t_word))
            tables.append(s.own.by_context(s.t))
            totals.append(s.own.totals(s.t, s.t_word, False))
        rows = [(ROOT, s.b, TOLD + 2, pack(np.concatenate(totals))), (s.b, KEPT, 2, pack(*series(seats), *series(words_)))]
        return _rows([*rows, *((to, s.b, TOLD + 2, pack(*series([x[part] for x in tables]))) for to, part in s.own.segments(bits))])

    return run


def sampled(s: State) -> Iterator[State]:
    """The state in each of the seatings, with the totals of all buckets."""
    kept, totals = s.kept(2), s.replies[2][ROOT][0]
    n = len(kept) // 2
    for k, (t, t_word, told) in enumerate(zip(unseries(kept[:n]), unseries(kept[n:]), s.series_told(2), strict=True)):
        s.t, s.t_word = t, t_word.copy()
        s.read(totals.reshape(n, -1)[k], told, (2, k))
        yield s


def scores(hot: np.ndarray):
    """The sums over each document's tokens in a bucket, to the batch of the document; the documents themselves pass."""

    def run(words: pa.Table, replies: pa.Table) -> pa.Table:
        if not words.num_rows:
            return ARROW.empty_table()
        if words["dest"][0].as_py() < 0:
            return _rows([(words["src"][0].as_py(), -1, 0, words["payload"][0].as_py())])
        s = _state(words, replies, hot)
        total, samples = np.zeros(len(s.own.word)), 0
        for each in sampled(s):
            total += each.predictive()
            samples += 1
        own = s.own
        score = np.log10(total / samples)
        base = np.log10(own.c_word + 0.1) - math.log10(s.train_tokens + 0.1 * (s.vocabulary + 1))
        kinds = own.word[own.type_of]
        sums = [np.bincount(own.doc, weights=x, minlength=own.n_docs) for x in (score[own.type_of], base[kinds], own.c_word[kinds] > 0)]
        rows = []
        for src, a, docs in own.batches:
            part = [x[a : a + len(docs)] for x in sums]
            rows.append((src, s.b, 1, pack(np.array([s.train_tokens], np.int64), small(np.diff(docs.astype(np.int64), prepend=0)), part[0], part[1], small(part[2].astype(np.int64)))))
        return _rows(rows)

    return run


def _documents(table: pa.Table) -> pa.Table:
    ids = none = held = n = None
    parts = []
    for turn, src, p in sorted(zip(table["round"].to_pylist(), table["src"].to_pylist(), table["payload"].to_pylist(), strict=True)):
        if turn == 0:
            ids, none, held, n = unpack(p)
        else:
            parts.append(unpack(p))
    score, base, known, train = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64), 0
    for total, some, s, b, k in parts:
        train = int(total[0])
        some = np.cumsum(some.astype(np.int64))
        score[some] += s
        base[some] += b
        known[some] += k.astype(np.int64)
    return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=none.astype(bool)), "held_out": pa.array(held.astype(bool)), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([train] * len(ids), pa.int64()), "base_score": pa.array(base), "score": pa.array(score)})


def score(docs: DataFrame, folds: int = FOLDS, sweeps: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """Log10 probabilities of every text under the model learned from the rows whose fold is not 0.

    docs: doc_id, text; other columns, whatever their names, are not read. Texts are lower-cased (A-Z), words are runs without ASCII white space.
    The fold is crc32(doc_id as text) modulo `folds`; fold 0 is held out. Returns doc_id, held_out, n_tokens (words and the
    end), n_known (tokens that training has), train_tokens, base_score (smoothed single words) and score (the model).

    A null or empty text is its end alone; a very long text is worked on whole in one task. A row with a null doc_id is learned from. Repeated rows each count and each
    give a row; an empty table gives none. If every row is held out all words are unknown and equally likely. A pair of words
    that is a large part of all tokens is worked on in one task.
    """
    ready_workers(docs.sparkSession)
    ready_checkpoints(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total, hot = survey(docs)
    # about nine bytes a word and its occurrence in the exchange
    bits = min(NAME_BITS, max(2, math.ceil(math.log2(max(1, total * 1.2 / BUCKET_BYTES)))))
    rows = docs.mapInArrow(occurrences(bits, folds, hot), MESSAGE)
    words = rows.groupBy("dest")
    asked = words.applyInArrow(questions(bits, hot), MESSAGE).repartition("dest")
    replies = words.cogroup(asked.groupBy("dest")).applyInArrow(first_replies(hot), MESSAGE).repartition("dest")
    told = lambda now, turn: asked.groupBy("dest").cogroup(now.groupBy("dest")).applyInArrow(later_replies(turn), MESSAGE).repartition("dest")
    # what a round has sent goes on as it is: a filter of it would be worked out apart, with the sweeps
    settled = words.cogroup(replies.groupBy("dest")).applyInArrow(burn_in(sweeps, bits, hot), MESSAGE).repartition("dest")
    known = replies.unionAll(told(settled, 1)).unionAll(settled)
    seated = words.cogroup(known.groupBy("dest")).applyInArrow(sample(samples, bits, hot), MESSAGE).repartition("dest")
    known = replies.unionAll(told(seated, 2)).unionAll(seated)
    sums = words.cogroup(known.groupBy("dest")).applyInArrow(scores(hot), MESSAGE)
    return sums.groupBy("dest").applyInArrow(_documents, OUT)


def perplexity(scored: DataFrame) -> DataFrame:
    """held_out, base_perplexity, perplexity: of all tokens of either part."""
    n = F.sum("n_tokens")
    return scored.groupBy("held_out").agg(F.pow(10.0, -F.sum("base_score") / n).alias("base_perplexity"), F.pow(10.0, -F.sum("score") / n).alias("perplexity"))


def op10_pitman_yor_lm(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
