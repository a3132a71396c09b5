"""Language-model scoring with a probabilistic suffix tree over words.

The tree's states are contexts of one to ``ORDER`` words. The root is the add-one unigram model over all
training tokens. Every context that occurs at least twice in training is tested, at any size of the corpus: it is
retained when its next-word counts diverge from its parent's distribution by more than they cost to describe.
Next words seen at least twice after a context have a smoothed probability of their own; the others share what is
left in the parent's proportions, so every state's distribution sums to one. A token is scored by the state of the
longest retained suffix before it. Words after a context that always has the same next word, or never the
same one twice, need no longer context: none can tell more about training.

Texts are read and split once, in blocks. All longer contexts of a place end with its context, so whoever has all places
of a context can test that one and all that extend it: a block sends its distinct windows (context, the words
before it, next word) with their training counts, packed by bucket of the context, and a bucket tests ``NEAR`` lengths at once
and answers each window. Few places are left for longer contexts then; a second round tests all of them. Blocks keep
only the words around places that ask again. Contexts with more than a bucket's share of the tokens are tested before, a
round a length: their distinct (context, next word) pairs are dealt over buckets by next word, and their sums, one row a
context, meet on the driver (at most 1 / HOT rows a round). Nothing else leaves the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from quarry.llm.packed import BLOCK_BYTES, numbered
from quarry.llm.tables import kept, remove
from quarry.llm.words import mix, split_words, text_pieces

#: Words of the longest contexts: the order of the model.
ORDER = 8
#: Context lengths of the first round of windows.
NEAR = 3
#: Least share of all training tokens from which a context's next words are dealt over several buckets.
HOT = 2.0 ** -14
#: Weight of the parent's distribution in a state's, in tokens.
PRIOR = 20.0
#: Buckets per partition of the texts.
PER_PARTITION = 3
#: Windows that are made, and tested, at once (and the rest of a context). What a task holds of the others is a few numbers each.
AT_ONCE = 1 << 17
_END = b" "  # no word holds white space
_SHIFT = 32  # bits of a word code in the key of a context and its next word
_MULT = np.uint64(0x9E3779B97F4A7C15)
_UNSEEN = np.uint32(0xFFFFFFFF)  # the number of all words that don't occur in training
_RETAINED, _OPEN = 1, 2  # of a context: a state; longer ones may differ
_DEAD, _ASKS, _SURE = 0, 1, 2  # of a place: no longer context is dealt; asks; its dealt context has this next word only
_HASHED = np.uint64(1 << 63)  # marks a context that is a hash, not one or two numbers of words

def word_hash(word: bytes) -> int:
    """64-bit hash of a word as a signed integer."""
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


class _States:
    """Finds the state of the ``depth`` words before a token."""

    def __init__(self, contexts: np.ndarray, depth: int, n_words: int):
        self.contexts, self.depth = contexts, depth
        if depth == 1:
            self.of_word = np.full(n_words + 1, -1)
            self.of_word[contexts] = np.arange(len(contexts))

    def before(self, c: np.ndarray) -> np.ndarray:
        """For each token from place ``depth`` on: number of the state before it, or -1."""
        if self.depth == 1:
            return self.of_word[np.maximum(c[:-1], -1)]
        out = np.full(len(c) - 2, -1)
        if len(self.contexts):
            some = np.flatnonzero((c[:-2] >= 0) & (c[1:-1] >= 0))
            key = (c[some] << _SHIFT) | c[some + 1]
            at = np.minimum(np.searchsorted(self.contexts, key), len(self.contexts) - 1)
            out[some] = np.where(self.contexts[at] == key, at, -1)
        return out


class Layer:
    """The retained states of one depth: sorted context keys, log10 of what a state leaves to its parent's
    other words per unit of the parent's probability, and sorted (state, next word) keys with log10 probabilities."""

    def __init__(self, contexts: np.ndarray, rest: np.ndarray, keys: np.ndarray, logs: np.ndarray):
        self.contexts, self.rest, self.keys, self.logs = contexts, rest, keys, logs

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.contexts, self.rest, self.keys, self.logs

    def apply(self, c: np.ndarray, below: np.ndarray, states: _States) -> np.ndarray:
        """log10 probabilities of the tokens, given those by shorter contexts."""
        depth = states.depth
        if len(c) <= depth or not len(self.contexts):
            return below
        state = states.before(c)
        some = np.flatnonzero(state >= 0)
        to, s = c[depth:][some], state[some]
        out = below.copy()
        value = below[depth:][some] + self.rest[s]
        if len(self.keys):
            key = np.where(to >= 0, (s << _SHIFT) | to, -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            value = np.where(self.keys[at] == key, self.logs[at], value)
        out[depth + some] = value
        return out


def _sums(k: int, state: np.ndarray, n: np.ndarray, q: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each of k contexts: next words, their counts, their parent's probability, and what they add to the
    divergence (in nats). These add up over parts of a context's next words."""
    gain = np.bincount(state, n * np.log(n / totals[state] / q), k).astype(float)  # no counts at all: integer zeros
    return np.bincount(state, minlength=k), np.bincount(state, n, k), np.bincount(state, q, k), gain


def _retained(totals, words, seen, q_seen, gain) -> tuple[np.ndarray, np.ndarray]:
    """Which contexts diverge from the parent's distribution by more than half a log of their total per next
    word (in nats), and the parent's probability of their other words."""
    others = 1 - np.minimum(q_seen, 1 - 1e-9)
    rest = np.maximum(totals - seen, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gain + np.where(rest > 0, rest * np.log(rest / totals / others), 0.0)
    return gain > 0.5 * (words + 1) * np.log(np.maximum(totals, 2)), others


def _rest(totals, seen, q_seen, others, prior: float) -> np.ndarray:
    """log10 of what a state leaves to its parent's other words per unit of the parent's probability."""
    left = 1 - np.minimum((seen + prior * q_seen) / (totals + prior), 1 - 1e-9)
    return np.log10(left / others)


def _layer(contexts: np.ndarray, totals: np.ndarray, key: np.ndarray, n: np.ndarray, parent, prior: float) -> Layer:
    """Retain the contexts whose counts diverge enough from the parent's distribution; smooth what is retained
    towards the parent."""
    order = np.argsort(key)
    key, n = key[order], n[order].astype(float)
    state, to = key >> _SHIFT, key & ((1 << _SHIFT) - 1)
    q = np.minimum(parent(contexts[state], to), 1 - 1e-9)  # the parent's probability of the next word
    words, seen, q_seen, gain = _sums(len(contexts), state, n, q, totals)
    good, others = _retained(totals, words, seen, q_seen, gain)
    kept_ = np.flatnonzero(good)
    new = np.full(len(contexts), -1)
    new[kept_] = np.arange(len(kept_))
    some = new[state] >= 0
    return Layer(contexts[kept_], _rest(totals, seen, q_seen, others, prior)[kept_],
                 (new[state[some]] << _SHIFT) | to[some],
                 np.log10((n + prior * q) / (totals[state] + prior))[some])


class _Book(dict):
    """word -> its number in a block."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


#: What a block holds, packed: of its documents (``here``: places left), of its distinct words, of its places.
_DOCS = {"train": "?", "n_tokens": "<i8", "n_known": "<i8", "here": "<i8", "base": "<f8", "score": "<f8"}
_WORDS = {"hash": "<u8", "count": "<i8", "id": "<u4"}
#: Word; log10 above the unigram model so far; training count of the dealt context; _DEAD, _ASKS or _SURE; length of the
#: shortest context that is to be tested in windows (0: none).
_PLACES = {"code": "<i4", "delta": "<f4", "total": "<u4", "status": "u1", "start": "u1"}
_BLOCK = _DOCS | _WORDS | _PLACES
_COUNTED, _NUMBERED = {"hash": "<u8", "n": "<u4"}, {"count": "<i8", "id": "<u4"}
_PAIRS = {"context": "<u8", "total": "<u4", "next": "<u4", "n": "<u4", "q": "<f4"}
_REPLY = {"count": "<u4"}
_FOUND = {"delta": "<f4", "open": "?"}
_HOT = "hot array<struct<context: long, total: double, words: double, seen: double, q: double, gain: double, most: double>>"


def _columns(kinds: dict) -> str:
    return ", ".join(f"{name} binary" for name in kinds)


def _pack(x: np.ndarray, kind: str) -> bytes:
    """An array as compressed bytes, all first bytes of its values first. Of a kind in ``steps`` (signed numbers), what is
    added or taken from value to value (the sign last), which is little where neighbours are alike."""
    kind, _, steps = kind.partition(" ")
    if steps:
        x = np.diff(x.astype(kind), prepend=np.zeros(1, kind))
        x = (x << 1) ^ (x >> (8 * x.itemsize - 1))
    planes = np.ascontiguousarray(x, kind).view(np.uint8).reshape(len(x), np.dtype(kind).itemsize).T
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    kind, _, steps = kind.partition(" ")
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * size, "zstd"), np.uint8)
    x = np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(n)
    return np.cumsum((x >> 1 & ~(-1 << (8 * size - 1))) ^ -(x & 1), dtype=kind) if steps else x


def _held(table: pa.Table | pa.RecordBatch, row: int) -> dict:
    b = {name: _unpack(table.column(name)[row].as_py(), kind) for name, kind in _BLOCK.items()}
    return b | {"doc": np.repeat(np.arange(len(b["here"]), dtype=np.int32), b["here"])}


def _first_totals(b: dict) -> np.ndarray:
    """Counts of the contexts of one word."""
    before = b["code"][:-1]
    return np.append(0, np.where(before != 0, b["count"][before], 0))  # an end (0) is in no context


def _row(block: int, doc_ids: pa.Array, held: dict) -> dict:
    """A block as columns; ``asks``, ``waits``: its places that ask in the next round of pairs, and of windows."""
    ids = pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)
    return {"block": pa.array([block], pa.int64()), "asks": pa.array([int((held["status"] == _ASKS).sum())], pa.int64()),
            "waits": pa.array([int(np.count_nonzero(held["start"]))], pa.int64()), "doc_id": ids} | {name: pa.array([_pack(held[name], kind)], pa.binary()) for name, kind in _BLOCK.items()}


def _blocks(size: int):
    """Map function: (doc_id, train, text) -> blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in numbered(batches, size):
            book, parts, lengths = _Book(), [], []
            end = np.array([book[_END]], np.int32)
            for text in table.column(2):
                n = 1
                for words in map(split_words, text_pieces(text.as_py() or "")):
                    parts.append(np.fromiter(map(book.__getitem__, words), np.int32, len(words)))
                    n += len(words)
                parts.append(end)
                lengths.append(n)
            code, docs = np.concatenate(parts), len(lengths)
            held = {name: np.zeros(docs if name in _DOCS else 0, kind) for name, kind in _BLOCK.items()}
            held |= {"code": code, "n_tokens": np.array(lengths), "here": np.array(lengths),
                     "train": table.column(1).combine_chunks().fill_null(False).to_numpy(zero_copy_only=False),
                     "hash": np.array([word_hash(w) for w in book], np.int64).view(np.uint64)}
            yield pa.RecordBatch.from_pydict(_row(block, table.column(0).combine_chunks(), held))

    return run


def _by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of values by bucket, and where each bucket ends."""
    order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")
    return order, np.append(0, np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets)))


def _dealt(block: int, bucket: np.ndarray, buckets: int, values: dict, kinds: dict) -> pa.RecordBatch:
    """Arrays cut by bucket, one row each."""
    order, ends = _by_bucket(bucket, buckets)
    some = np.flatnonzero(ends[1:] > ends[:-1])
    columns = {"bucket": pa.array(some.astype(np.int32)), "block": pa.array(np.full(len(some), block, np.int64))}
    for name, kind in kinds.items():
        x = values[name][order]
        columns[name] = pa.array([_pack(x[ends[b]:ends[b + 1]], kind) for b in some], pa.binary())
    return pa.RecordBatch.from_pydict(columns)


def _returned(answers: pa.Table, bucket: np.ndarray, buckets: int, kinds: dict) -> dict:
    """What came back for values that ``_dealt`` cut, in their order."""
    order, ends = _by_bucket(bucket, buckets)
    out = {name: np.zeros(len(bucket), kind) for name, kind in kinds.items()}
    numbers = answers.column("bucket").to_pylist()
    for name, kind in kinds.items():
        for b, x in zip(numbers, answers.column(name).to_pylist(), strict=True):
            out[name][order[ends[b]:ends[b + 1]]] = _unpack(x, kind)
    return out


def _cuts(table: pa.Table, name: str) -> np.ndarray:
    """Where each row's array starts when a bucket's are laid end to end."""
    return np.cumsum([0, *(int.from_bytes(x.as_buffer()[:8], "little") for x in table.column(name))])


def _column(table: pa.Table, name: str, kind: str, cuts: np.ndarray, to: type | None = None) -> np.ndarray:
    """The arrays of a bucket's rows end to end."""
    out = np.empty(cuts[-1], to or kind.partition(" ")[0])
    for a, b, x in zip(cuts[:-1], cuts[1:], table.column(name), strict=True):
        out[a:b] = _unpack(x.as_py(), kind)
    return out


def _joined(table: pa.Table, kinds: dict) -> tuple[dict, np.ndarray]:
    """All arrays of a bucket's rows end to end, and where each row starts."""
    cuts = _cuts(table, next(iter(kinds)))
    return {name: _column(table, name, kind, cuts) for name, kind in kinds.items()}, cuts


def _cut(x: np.ndarray, kind: str, cuts: np.ndarray) -> pa.Array:
    return pa.array([_pack(x[a:b], kind) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())


def _ask_words(buckets: int):
    """Map function: a block's distinct words with their training counts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _held(batch, i)
                n = np.bincount(b["code"], b["train"][b["doc"]], len(b["hash"]))
                yield _dealt(batch.column("block")[i].as_py(), mix(b["hash"]) % np.uint64(buckets), buckets,
                             {"hash": b["hash"], "n": n}, _COUNTED)

    return run


def _answer_words(buckets: int):
    """Group function: the rows of a bucket -> each word's training count and number, tokens and distinct words."""

    def run(table: pa.Table) -> pa.Table:
        x, cuts = _joined(table, _COUNTED)
        words, place = np.unique(x["hash"], return_inverse=True)
        counts = np.bincount(place, x["n"], len(words)).astype("<i8")
        number = np.empty(len(words), np.int64)  # small ones for frequent words: they pack well
        number[np.argsort(-counts, kind="stable")] = np.arange(len(words)) * buckets + table.column("bucket")[0].as_py()
        if len(number) and number.max() >= _UNSEEN:
            raise OverflowError("more distinct words than 32 bits number")
        first = np.arange(table.num_rows) == 0
        return pa.table({"bucket": table.column("bucket"), "block": table.column("block"),
                         "count": _cut(counts[place], "<i8", cuts),
                         "id": _cut(np.where(counts > 0, number, _UNSEEN)[place], "<u4", cuts),
                         "total": pa.array(np.where(first, counts.sum(), 0)),
                         "words": pa.array(np.where(first, (counts > 0).sum(), 0))})

    return run


def _learn_words(buckets: int, scale: int, floor: float, hot: float):
    """Cogroup function: a block and its words' answers -> the block, scored by the unigram model."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        b = _held(table, 0)
        b |= _returned(answers, mix(b["hash"]) % np.uint64(buckets), buckets, _NUMBERED)
        code, doc = b["code"], b["doc"]
        docs = len(b["train"])
        b["base"] = np.bincount(doc, np.log10((b["count"] + 1) / scale)[code], docs)
        b["n_known"] = np.bincount(doc, b["count"][code] > 0, docs)
        total = _first_totals(b)
        b["status"] = np.where(total >= hot, _ASKS, _DEAD)
        b["total"], b["start"] = np.where(total >= hot, total, 0), (total >= floor) & (total < hot)
        b["hash"], b["delta"] = b["hash"][:0], np.zeros(len(code))
        return pa.table(_row(table.column("block")[0].as_py(), table.column("doc_id").combine_chunks().flatten(), b))

    return run


def _hash(b: dict, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Hashes of the contexts of ``depth`` words before places."""
    number = b["id"].astype(np.uint64)
    h = depth.astype(np.uint64)
    for back in range(1, int(depth.max(initial=0)) + 1):
        some = np.flatnonzero(depth >= back)
        h[some] = mix(h[some] * _MULT + number[b["code"][at[some] - back]])
    return h


def _logs(b: dict, at: np.ndarray, scale: int) -> np.ndarray:
    """log10 probabilities of places so far."""
    return np.log10((b["count"] + 1) / scale)[b["code"][at]] + b["delta"][at]


def _further(b: dict, at: np.ndarray, depth: np.ndarray, order: int, floor: float) -> np.ndarray:
    """``depth`` where the document has a context of so many words that may be repeated before the place, else 0."""
    back = np.maximum(at - depth, 0)
    there = (depth <= order) & (at >= depth) & (b["doc"][back] == b["doc"][at]) & (b["count"][b["code"][back]] >= floor)
    return np.where(there, depth, 0)


def _pairs_of(b: dict, depth: int, scale: int, buckets: int):
    """The distinct (context, next word) pairs of a block's asking places: (the places, the pair of each, its log10
    probability so far, the pairs, their buckets)."""
    at = np.flatnonzero(b["status"] == _ASKS)
    h, logs = _hash(b, at, np.full(len(at), depth)), _logs(b, at, scale)
    which = b["code"][at - 1].astype(np.int64) if depth == 1 else np.unique(h, return_inverse=True)[1]
    _, first, pair = np.unique(which * len(b["id"]) + b["code"][at], return_index=True, return_inverse=True)
    pairs = {"context": h[first], "total": b["total"][at][first], "next": b["id"][b["code"][at]][first],
             "n": np.bincount(pair, b["train"][b["doc"][at]], len(first)).astype("<u4"),
             "q": (10.0 ** logs[first]).astype("<f4")}
    return at, pair, logs, pairs, mix(pairs["context"] * _MULT + pairs["next"]) % np.uint64(buckets)


def _ask_pairs(depth: int, scale: int, buckets: int):
    """Map function: a block's distinct pairs by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("asks")[i].as_py():
                    *_, pairs, bucket = _pairs_of(_held(batch, i), depth, scale, buckets)
                    yield _dealt(batch.column("block")[i].as_py(), bucket, buckets, pairs, _PAIRS)

    return run


def _answer_pairs(least: float):
    """Group function: the rows of a bucket -> per pair its count over all blocks; of its contexts, their sums here."""

    def run(table: pa.Table) -> pa.Table:
        x, cuts = _joined(table, _PAIRS)
        order = np.lexsort((x["next"], x["context"]))
        context, to = x["context"][order], x["next"][order]
        new_context = np.append(True, context[1:] != context[:-1])
        new_pair = new_context | np.append(True, to[1:] != to[:-1])
        starts, pair_of = np.flatnonzero(new_pair), np.cumsum(new_pair) - 1
        state = (np.cumsum(new_context) - 1)[starts]  # of each pair
        n = np.add.reduceat(x["n"][order], starts, dtype=np.int64)
        totals = x["total"][order][new_context].astype(float)
        own = np.flatnonzero(n >= least)
        q = np.minimum(x["q"][order][starts[own]].astype(float), 1 - 1e-9)
        words, seen, q_seen, gain = _sums(len(totals), state[own], n[own].astype(float), q, totals)
        most = np.zeros(len(totals))
        np.maximum.at(most, state, n)
        count_of = np.empty(len(order), _REPLY["count"])
        count_of[order] = n[pair_of]
        fields = ("total", "words", "seen", "q", "gain", "most")
        sums = [dict(zip(("context", *fields), v, strict=True)) for v in zip(
            context[new_context].view(np.int64).tolist(),
            *(y.astype(float).tolist() for y in (totals, words, seen, q_seen, gain, most)), strict=True)]
        kind = pa.struct([("context", pa.int64()), *((f, pa.float64()) for f in fields)])
        return pa.table({"bucket": table.column("bucket"), "block": table.column("block"),
                         "count": _cut(count_of, _REPLY["count"], cuts),
                         "hot": pa.array([sums] + [[]] * (table.num_rows - 1), pa.list_(kind))})

    return run


def _decided(totals, words, seen, q_seen, gain, most, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The rest and the flags of contexts, given the sums over all their next words."""
    good, others = _retained(totals, words, seen, q_seen, gain)
    good &= words > 0
    flags = np.where(good, _RETAINED, 0) | np.where((words > 0) & (most < totals), _OPEN, 0)
    return np.where(good, _rest(totals, seen, q_seen, others, prior), 0.0), flags.astype(np.uint8)


def _learnt_row(table: pa.Table, b: dict, order: int) -> pa.Table:
    """A block after a round: what no longer asks goes to its document's sum."""
    alive = (b["status"] == _ASKS) | (b["start"] > 0)
    b["score"] = b["score"] + np.bincount(b["doc"], np.where(alive, 0, b["delta"]), len(b["score"]))
    b["delta"] = np.where(alive, b["delta"], 0)
    return pa.table(_row(table.column("block")[0].as_py(), table.column("doc_id").combine_chunks().flatten(),
                         _around(b, alive, order)))


def _learn_pairs(depth: int, order: int, scale: int, hot: float, buckets: int, dealt, floor: float, least: float, prior: float):
    """Cogroup function: a block and its pairs' answers -> the block, scored by dealt contexts up to this length.
    ``dealt``: the contexts (sorted), their rests and flags."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        b = _held(table, 0)
        code, doc, status = b["code"], b["doc"], b["status"].copy()
        if (status == _ASKS).any():
            at, pair, logs, pairs, bucket = _pairs_of(b, depth, scale, buckets)
            count = _returned(answers, bucket, buckets, _REPLY)["count"]
            contexts, rests, kinds = dealt.value
            where = np.searchsorted(contexts, pairs["context"])
            n, flags, total = count[pair].astype(float), kinds[where][pair], b["total"][at].astype(float)
            q = np.minimum(10.0 ** logs, 1 - 1e-9)
            value = np.where(n >= least, np.log10((n + prior * q) / (total + prior)) - logs, rests[where][pair])
            b["delta"] = b["delta"].copy()
            b["delta"][at] += np.where(flags & _RETAINED, value, 0.0)
            after = np.where(status == _SURE, b["total"], 0).astype(np.int64)  # count of context and word
            after[at] = n
            status[at] = np.where(flags & _OPEN, _ASKS, np.where(n == total, _SURE, _DEAD))
            follows = np.append(False, (doc[1:] == doc[:-1]) & (code[:-1] != 0))
            context = np.where(follows, np.append(0, after[:-1]), 0)
            # what is too rare to be dealt isn't known here
            rare = np.flatnonzero((status == _ASKS) & ((context < hot) | (depth == order)))
            b["start"] = b["start"].copy()
            b["start"][rare] = _further(b, rare, np.full(len(rare), depth + 1), order, floor)
            status[rare] = _DEAD
            b |= {"total": np.where(status == _DEAD, 0, context), "status": status}
        return _learnt_row(table, b, order)

    return run


def _windows_of(b: dict, levels: int, order: int, floor: float, least: float, buckets: int):
    """The distinct windows of a block's waiting places: (the places, the window of each, the first of the places with each
    window, what the windows of the places have, the windows' buckets).
    A window has the shortest context to test, the words before it that the other ``levels`` take, and the next word;
    words that are too rare to be in a repeated context, or a repeated next word, are all the same. Counts and log10
    probabilities so far follow from these."""
    code, doc = b["code"], b["doc"]
    number = np.where(b["count"] >= floor, b["id"], _UNSEEN)
    follows = np.where(b["count"] >= least, b["id"], _UNSEEN)
    places = np.flatnonzero(b["start"])
    names = ("next", *(f"word{i}" for i in range(1, levels)))
    x = {"context": np.empty(len(places), np.uint64)} | {name: np.empty(len(places), np.uint32) for name in names}
    key = np.empty(len(places), np.uint64)
    for part in (slice(i, i + AT_ONCE) for i in range(0, len(places), AT_ONCE)):
        at = places[part]
        start = b["start"][at].astype(np.int64)
        context = number[code[at - 1]].astype(np.uint64)
        two = np.flatnonzero((start == 2) & (context < np.uint64((1 << 31) - 1)))
        long = np.flatnonzero((start > 1) & ((start > 2) | (context >= np.uint64((1 << 31) - 1))))
        context[two] = ((context[two] + np.uint64(1)) << np.uint64(_SHIFT)) | number[code[at[two] - 2]]
        context[long] = _hash(b, at[long], start[long]) | _HASHED
        values = {"context": context, "next": follows[code[at]]}
        there = np.ones(len(at), bool)
        for i in range(1, levels):
            back = np.maximum(at - start - i, 0)
            there &= (start + i <= order) & (at >= start + i) & (doc[back] == doc[at])
            values[f"word{i}"] = np.where(there, number[code[back]], _UNSEEN)
            there &= values[f"word{i}"] != _UNSEEN
        h = np.zeros(len(at), np.uint64)
        for name, y in values.items():
            x[name][part] = y
            h = mix(h * _MULT + y)
        # by next word: frequent words have small numbers, so counts change little from one to the next
        key[part] = (values["next"].astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32))
    ranked = np.argsort(key, kind="stable")
    del key
    new = np.zeros(len(places), bool)
    new[:1] = True
    for y in x.values():
        y = y[ranked]
        new[1:] |= y[1:] != y[:-1]
    window = np.empty(len(places), np.int32)
    window[ranked] = np.cumsum(new, dtype=np.int32) - 1
    first = ranked[new]
    return places, window, first, x, (mix(x["context"][first]) % np.uint64(buckets)).astype(np.int32)


def _window_kinds(levels: int) -> dict:
    return {"context": "<u8", "next": "<i8 steps", "count": "<i8 steps", "delta": "<f4", "n": "<u4"} | {f"word{i}": "<u4" for i in range(1, levels)}


def _ask_windows(levels: int, order: int, floor: float, least: float, buckets: int):
    """Map function: a block's distinct windows by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("waits")[i].as_py():
                    b = _held(batch, i)
                    at, window, first, x, bucket = _windows_of(b, levels, order, floor, least, buckets)
                    n = np.bincount(window[b["train"][b["doc"][at]]], minlength=len(first)).astype("<u4")
                    at = at[first]
                    del window
                    for name, y in x.items():
                        x[name] = y[first]
                    some = x["next"] != _UNSEEN
                    x |= {"n": n, "count": np.where(some, b["count"][b["code"][at]], 0), "delta": np.where(some, b["delta"][at], np.float32(0))}
                    yield _dealt(batch.column("block")[i].as_py(), bucket, buckets, x, _window_kinds(levels))

    return run


def _ordered(state: np.ndarray, word: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and a word of each in one number, and what has it, in order."""
    key = state.astype(np.int64) << _SHIFT
    key |= word
    order = np.argsort(key)
    return key[order], some[order]


def _tested(x: dict, state: np.ndarray, levels: int, floor: float, least: float, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of whole contexts, numbered by ``state``: the next words' probabilities by up to ``levels`` lengths of
    context, and whether longer ones may change them. Words after a context have the same one so far in all its windows."""
    p, open_ = x["below"].copy(), np.zeros(len(state), bool)
    some = np.arange(len(state), dtype=state.dtype)  # the windows that have a context of this length
    for i in range(1, levels + 1):
        totals = np.bincount(state, x["n"][some])
        repeated = totals[state] >= floor
        some, state = some[repeated], state[repeated]
        if not len(some):
            break
        key, some = _ordered(state, x["next"][some], some)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))  # of each pair of a context and a next word
        times = np.diff(np.append(first, len(some)))
        of, to = key[first] >> _SHIFT, key[first] & ((1 << _SHIFT) - 1)
        del key
        n = np.add.reduceat(x["n"][some], first, dtype=np.float64)
        own = (n >= least) & (to != _UNSEEN)
        above = p[some[first]]
        q = np.minimum(above, 1 - 1e-9)
        words, seen, q_seen, gain = _sums(len(totals), of[own], n[own], q[own], np.maximum(totals, 1))
        most = np.zeros(len(totals))
        np.maximum.at(most, of, np.where(own, n, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            rest, flags = _decided(totals, words, seen, q_seen, gain, most, prior)
        smoothed = np.where(own, (n + prior * q) / (totals[of] + prior), above * 10.0 ** rest[of])
        p[some] = np.repeat(np.where(flags[of] & _RETAINED, smoothed, above), times)
        longer = (flags[of] & _OPEN) > 0
        some, state = some[np.repeat(longer, times)], np.repeat(of[longer].astype(state.dtype), times[longer])
        if i == levels:
            open_[some] = True
        else:
            word = x[f"word{i}"][some]
            there = word != _UNSEEN
            key, some = _ordered(state[there], word[there], some[there])
            state = np.cumsum(np.append(False, key[1:] != key[:-1])[:len(key)], dtype=state.dtype)
    return p, open_


def _answer_windows(levels: int, scale: int, floor: float, least: float, prior: float):
    """Group function: the rows of a bucket -> per window what its contexts add to the log10 probability of the next
    word, and whether longer ones may add more."""

    def run(table: pa.Table) -> pa.Table:
        kinds, cuts = _window_kinds(levels), _cuts(table, "context")
        context = _column(table, "context", kinds["context"], cuts)
        order = np.argsort(context).astype(np.uint32 if len(context) < 1 << 32 else np.int64)
        context = context[order]
        new = np.append(True, context[1:] != context[:-1])
        del context
        starts = np.flatnonzero(new)
        ends = np.searchsorted(starts, np.arange(0, len(new), AT_ONCE))
        ends = np.unique(np.append(starts[ends[ends < len(starts)]], len(new)))  # no context has windows on both sides
        del starts
        to = {"next": np.uint32, "count": np.float64}
        x = {name: _column(table, name, kind, cuts, to.get(name))[order] for name, kind in kinds.items() if name != "context"}
        open_ = np.empty(len(new), _FOUND["open"])
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            here = {name: y[a:b] for name, y in x.items()}
            # the parent's probability; of words that are too rare to be a repeated next word, any
            here["below"] = np.where(here["next"] == _UNSEEN, 1.0, (here["count"] + 1.0) / scale * 10.0 ** here["delta"].astype(float))
            p, open_[a:b] = _tested(here, np.cumsum(new[a:b], dtype=np.int32) - 1, levels, floor, least, prior)
            x["delta"][a:b] = np.log10(p / here["below"])
        out = {"delta": x["delta"], "open": open_}
        del x
        for name, y in out.items():
            out[name] = np.empty_like(y)
            out[name][order] = y
        return pa.table({"bucket": table.column("bucket"), "block": table.column("block")}
                        | {name: _cut(y, _FOUND[name], cuts) for name, y in out.items()})

    return run


def _learn_windows(levels: int, order: int, floor: float, least: float, buckets: int):
    """Cogroup function: a block and its windows' answers -> the block, scored by contexts of ``levels`` more lengths."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        b = _held(table, 0)
        at, window, *_, bucket = _windows_of(b, levels, order, floor, least, buckets)
        del _
        got = _returned(answers, bucket, buckets, _FOUND)
        delta, start = b["delta"].copy(), b["start"].copy()
        delta[at] += got["delta"][window]
        start[at] = np.where(got["open"][window], _further(b, at, start[at].astype(np.int64) + levels, order, floor), 0)
        return _learnt_row(table, b | {"delta": delta, "start": start}, order)

    return run


def _around(b: dict, alive: np.ndarray, order: int) -> dict:
    """The block with only those places that an ``alive`` one has among the ``order`` before it. (A wrong context count
    at a place after a gap moves on by one place a round, so it doesn't get to the places that ask.)"""
    ahead = np.cumsum(np.concatenate([[False], alive, np.zeros(order, bool)]), dtype=np.int32)
    keep = ahead[order + 1:] > ahead[:-order - 1]
    b = b | {name: b[name][keep] for name in _PLACES} | {"here": np.bincount(b["doc"][keep], minlength=len(b["here"]))}
    used = np.zeros(len(b["count"]), bool)
    used[:1] = used[b["code"]] = True  # the end stays 0
    number = (np.cumsum(used) - 1).astype(np.int32)
    return b | {"code": number[b["code"]], "count": b["count"][used], "id": b["id"][used]}


def _scores(total: int):
    """Map function: blocks -> a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _held(batch, i)
                more = b["score"] + np.bincount(b["doc"], b["delta"], len(b["score"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, 1).flatten(), pa.array(b["n_tokens"]), pa.array(b["n_known"]),
                     pa.array(np.full(len(more), total)), pa.array(b["base"]), pa.array(b["base"] + more)],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _kept(df: DataFrame) -> tuple[DataFrame, str]:
    """``kept``, and what was shuffled for it is deleted with the job, not when the driver collects garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return kept(df)
    finally:
        conf.set(name, before)


def score_texts(df: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", p_min: float = 0.0,
                p_next: float = 0.0, prior: float = PRIOR, order: int = ORDER, hot: float | None = None,
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, train_tokens, base_score, score. Learns from the rows for
    which ``train`` holds (null: not); scores all rows.

    Tokens are lower-cased (A-Z) words between ASCII white space and one end per text. base_score sums
    log10((c + 1) / (N + V + 1)) over the tokens (c: the token's training count, N: all training tokens, V: distinct
    ones), n_known counts tokens with c > 0, score is the tree's log10 probability of the text.

    Contexts have up to ``order`` words. Every context and every next word of it that occur twice count;
    ``p_min`` and ``p_next`` ask for a higher share of the training tokens. ``hot`` (share of the tokens
    from which a context's next words are dealt over several buckets; None: a bucket's share, at least ``HOT``) and
    ``block_bytes`` change how the work is dealt, not what comes out.

    Null and empty texts are one end. A null doc_id is scored like any other; repeated rows are
    documents each, learnt from and scored; very long texts are split into words piece by piece. Without
    training rows, N and V are 0: every token scores 0. Ties at a threshold are kept. An empty table gives no
    rows. Other columns are not looked at.
    """
    spark = df.sparkSession
    texts = df.select(df[doc_id].alias("doc_id"), train.alias("train"), df[text].alias("text"))
    buckets = PER_PARTITION * texts.rdd.getNumPartitions() + 8
    kind = texts.schema["doc_id"].dataType
    schema = (Ty.StructType().add("block", "long").add("asks", "long").add("waits", "long").add("doc_id", Ty.ArrayType(kind)))
    for name in _BLOCK:
        schema = schema.add(name, "binary")
    blocks, path = _kept(texts.mapInArrow(_blocks(block_bytes), schema))
    paths = [path]

    def learnt(answers: DataFrame, work) -> tuple[DataFrame, int, int]:
        """The blocks after a round, and how many of their places ask and wait; what the round read is removed."""
        nonlocal paths
        both = blocks.groupBy("block").cogroup(answers.groupBy("block"))
        out, path = _kept(both.applyInArrow(work, schema))
        for old in paths:
            remove(spark, old)
        paths = [path]
        return out, *(x or 0 for x in out.agg(F.sum("asks"), F.sum("waits")).first())

    asked = blocks.mapInArrow(_ask_words(buckets), f"bucket int, block long, {_columns(_COUNTED)}")
    answers, path = _kept(asked.groupBy("bucket").applyInArrow(
        _answer_words(buckets), f"bucket int, block long, {_columns(_NUMBERED)}, total long, words long"))
    paths.append(path)
    total, distinct = (x or 0 for x in answers.agg(F.sum("total"), F.sum("words")).first())
    scale, floor, least = total + distinct + 1, max(2.0, p_min * total), max(2.0, p_next * total)
    share = max(floor, total * (max(HOT, 1 / buckets) if hot is None else hot))
    blocks, asks, waits = learnt(answers, _learn_words(buckets, scale, floor, share))
    for depth in range(1, order + 1):
        if not asks:
            break
        asked = blocks.mapInArrow(_ask_pairs(depth, scale, buckets), f"bucket int, block long, {_columns(_PAIRS)}")
        answers, path = _kept(asked.groupBy("bucket").applyInArrow(
            _answer_pairs(least), f"bucket int, block long, {_columns(_REPLY)}, {_HOT}"))
        paths.append(path)
        parts = answers.select(F.explode("hot").alias("x")).select("x.*").groupBy("context")
        t = parts.agg(F.max("total"), *(F.sum(x) for x in ("words", "seen", "q", "gain")), F.max("most")).toArrow()
        context, *sums = (t.column(i).to_numpy() for i in range(7))
        ranked = np.argsort(context.view(np.uint64))
        rest, flags = _decided(*(x[ranked].astype(float) for x in sums), prior)
        dealt = spark.sparkContext.broadcast((context.view(np.uint64)[ranked], rest, flags))
        blocks, asks, waits = learnt(answers.drop("hot"), _learn_pairs(
            depth, order, scale, share, buckets, dealt, floor, least, prior))
    for levels in (min(NEAR, order), order - NEAR):
        if not waits:
            break
        asked = blocks.mapInArrow(_ask_windows(levels, order, floor, least, buckets),
                                  f"bucket int, block long, {_columns(_window_kinds(levels))}")
        answers, path = _kept(asked.groupBy("bucket").applyInArrow(
            _answer_windows(levels, scale, floor, least, prior), f"bucket int, block long, {_columns(_FOUND)}"))
        paths.append(path)
        blocks, _, waits = learnt(answers, _learn_windows(levels, order, floor, least, buckets))
    out = Ty.StructType().add("doc_id", kind)
    for name, of in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")):
        out = out.add(name, of)
    return blocks.mapInArrow(_scores(int(total)), out)
