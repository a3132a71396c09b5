"""Order-preserving packing of token streams into sequences of a fixed length.

Documents are tokenised, ended by a separator id and laid end to end in table
order; each sequence is one window of that stream. Where to cut is a shortest
path over cut places (document ends, sentence ends, and evenly spaced places
inside sentences): a window costs its padding plus the price of cutting at its
end (nothing at a document end, little after a sentence, more inside one). As
padding is linear in the window's start, the cheapest start of all those in
reach is the head of a monotone queue, so the pass is linear in the cut places.
Windows of a power-of-two length need no padding; the starts of the three largest such
lengths below the full one are looked at directly.

Each task packs the rows of its own input partition, so no text is shuffled and a
hot source or a long document is nobody's bottleneck; only the last window of a
partition may stay part empty.
"""

from __future__ import annotations

import os
import re
import struct
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as Ty

from quarry.llm.words import per_process, text_pieces

#: Chunks (white-space separated) whose ids a worker remembers; tokens packed at once.
MEMO_CHUNKS, MEMO_BYTES, BLOCK_TOKENS = 600_000, 64, 1 << 20
SENTENCE_COST, INNER_COST, INNER_STEP = 8, 48, 64
_SENTENCE_ENDS = frozenset(".!?")
_MARKS = b".,;:!?"
_LETTERS = re.compile("[a-zß-öø-ÿ]+\\Z")
#: Below U+0300 no character combines with another, so lower-casing first changes nothing else.
_COMPOSABLE = re.compile("[\u0300-\U0010ffff]")


class _Chunks(dict):
    """White-space separated chunk (UTF-8) -> its ids as little-endian unsigned 32-bit integers.

    The tokenizer drops white space, and none of its steps looks across it (composition and
    lower-casing of characters don't either), so a chunk has the same ids alone as in its text.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab()
        self.ends_sentence = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends_sentence[i] = token.removesuffix("</w>")[-1:] in _SENTENCE_ENDS
        self.model, self.letters = self.tokenizer.model, {}
        self._find_letters()

    def _find_letters(self) -> None:
        """How the tokenizer writes each lower-case letter below U+0100 for its model: a word of such letters
        can go straight to the model. Left empty if that doesn't give this tokenizer's ids."""
        from tokenizers import pre_tokenizers

        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0x61, 0x100) if _LETTERS.match(chr(c))]
        table = {ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in letters}
        probes = letters + [a + b for a in letters for b in letters] + ["the", "straße", "élève", "mañana"]
        if all([t.id for t in self.model.tokenize(w.translate(table))]
               == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probes):
            self.letters = table

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= MEMO_CHUNKS:
            self.clear()
        text = chunk.decode("utf-8", "replace")
        word = chunk.rstrip(_MARKS)
        if self.letters and _LETTERS.match(text):
            found = [t.id for t in self.model.tokenize(text.translate(self.letters))]
            ids = struct.pack(f"<{len(found)}I", *found)
        elif word and len(word) < len(chunk) and word.decode("utf-8", "replace").lower()[-1].isalpha():
            ids = self[word] + self[chunk[len(word):]]  # letters and marks are never in one piece
        else:
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(chunk) <= MEMO_BYTES:
            self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        parts = []
        for piece in text_pieces(text or "", 1 << 19):
            raw = piece.encode("utf-8", "replace")
            if not _COMPOSABLE.search(piece):
                raw = raw.lower()  # A-Z; the tokenizer lower-cases all letters, so fewer chunks differ
            parts.append(b"".join([self[c] for c in raw.split()]))
        return np.frombuffer(b"".join(parts), "<u4")


def cut_windows(places: np.ndarray, costs: np.ndarray, length: int) -> list[int]:
    """The cheapest increasing chain of cut places from the first to the last, with gaps of at
    most ``length``: padding (none where a gap is one of the three largest smaller
    powers of two) plus the cost of each place.
    The places must include a way: no two neighbours further apart than ``length``."""
    place, price = places.tolist(), costs.tolist()
    n = len(place)
    at = {p: i for i, p in enumerate(place)}
    powers = [w for w in (length >> 1, length >> 2, length >> 3) if w and w & (w - 1) == 0]
    best, came = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(place[0], 0)])  # best[i] + place[i], increasing
    for j in range(1, n):
        p = place[j]
        while place[queue[0][1]] < p - length:
            queue.popleft()
        value, i = queue[0]
        value += length - p
        for w in powers:
            k = at.get(p - w)
            if k is not None and best[k] < value:
                value, i = best[k], k
        best[j], came[j] = value + price[j], i
        key = best[j] + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    chain = [n - 1]
    while chain[-1]:
        chain.append(came[chain[-1]])
    return [place[i] for i in reversed(chain)]


def _cut_places(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray,
                length: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut places of a stream (0, document ends, sentence ends, spaced places) and their costs."""
    n = len(ids)
    sentence = np.flatnonzero(ends_sentence[np.minimum(ids, len(ends_sentence) - 1)]) + 1
    places = np.unique(np.concatenate([[0, n], doc_ends, sentence]))
    places = places[places <= n]
    step = max(1, min(INNER_STEP, length))
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > step)
    if len(wide):
        count = (gaps[wide] - 1) // step
        first = np.repeat(places[wide], count)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1
        inner = first + nth * step
        places = np.union1d(places, inner)
        costs = np.where(np.isin(places, inner), float(INNER_COST), float(SENTENCE_COST))
    else:
        costs = np.full(len(places), float(SENTENCE_COST))
    costs[np.isin(places, doc_ends)] = 0.0
    costs[0] = 0.0
    return places, costs


def pack(df: DataFrame, tokenizer_file: str, length: int = 2048, separator: int = 1,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``length`` ids.

    Returns per piece: doc_id, start (its document's ids before it), length, ids (little-endian
    unsigned 32-bit, binary), doc_tokens (with the separator), sequence_id, offset (place in the
    sequence, gapless from 0). Documents keep their order inside an input partition, and each id
    lies in exactly one piece.

    A null or empty text is the separator alone; a null doc_id stays null; repeated rows are
    documents of their own; a long document is cut into many pieces (its ids are held once, 4
    bytes each); an empty table gives no rows; other columns are not looked at.
    ``sequence_id`` is the input partition's number times 2^33 plus a running number.
    """
    schema = Ty.StructType([
        Ty.StructField("doc_id", df.schema[doc_id].dataType), Ty.StructField("start", Ty.LongType()),
        Ty.StructField("length", Ty.LongType()), Ty.StructField("ids", Ty.BinaryType()),
        Ty.StructField("doc_tokens", Ty.LongType()), Ty.StructField("sequence_id", Ty.LongType()),
        Ty.StructField("offset", Ty.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, sequence = TaskContext.get().partitionId() << 33, 0
        chunks = None
        key_type = None
        held: list[tuple[object, int, int, np.ndarray]] = []  # doc_id, start, doc_tokens, ids

        def windows(last: bool) -> Iterator[pa.RecordBatch]:
            """Cuts the held stream; all but its last window go out, unless it's the end."""
            nonlocal held, sequence
            ids = np.concatenate([h[3] for h in held])
            ends = np.cumsum([len(h[3]) for h in held])
            places, costs = _cut_places(ids, ends, chunks.ends_sentence, length)
            cuts = cut_windows(places, costs, length)
            if not last:
                cuts.pop()
            stop = cuts[-1]
            borders = np.unique(np.concatenate([cuts, ends[ends < stop]]).astype(np.int64))
            starts, stops = borders[:-1], borders[1:]
            doc = np.searchsorted(ends, starts, "right")
            window = np.searchsorted(cuts, starts, "right") - 1
            doc_from = np.concatenate([[0], ends[:-1]])
            raw = ids.astype("<u4").tobytes()
            rows = {
                "doc_id": pa.array([held[d][0] for d in doc], key_type),
                "start": pa.array(starts - doc_from[doc] + np.array([held[d][1] for d in doc], np.int64)),
                "length": pa.array(stops - starts),
                "ids": pa.array([raw[4 * a:4 * b] for a, b in zip(starts, stops, strict=True)], pa.binary()),
                "doc_tokens": pa.array([held[d][2] for d in doc], pa.int64()),
                "sequence_id": pa.array(window + (base + sequence)),
                "offset": pa.array(starts - np.array(cuts, np.int64)[window]),
            }
            sequence += len(cuts) - 1
            out = pa.RecordBatch.from_pydict(rows)
            for at in range(0, out.num_rows, 4096):
                yield out.slice(at, 4096)
            d = int(np.searchsorted(ends, stop, "right"))
            rest = held[d:]
            if rest and stop > doc_from[d]:
                k, start, total, own = rest[0]
                rest[0] = (k, start + stop - int(doc_from[d]), total, own[stop - int(doc_from[d]):])
            held = rest

        total = 0
        for batch in batches:
            chunks = chunks or per_process(("chunks", tokenizer_file), lambda: _Chunks(tokenizer_file))
            key_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(chunks.encode(t), np.array([separator], "<u4"))
                    held.append((k, 0, len(ids), ids))
                    total += len(ids)
                    if total >= BLOCK_TOKENS:
                        yield from windows(False)
                        total = sum(len(h[3]) for h in held)
        if held:
            yield from windows(True)

    return df.select(df[doc_id].alias("doc_id"), df[text].alias("text")).mapInArrow(run, schema)
