"""Order-preserving packing: sequences are windows over the documents' tokens as they stand, cut where it costs least.

Every task lays its documents' ids, each with an end id, one after the other and chooses where to cut. Cuts may be at
ends of documents, at ends of sentences (after a token that ends with sentence punctuation) and, where neither comes for
FILL tokens, at every STEP-th token. A window of n tokens costs its padding (none at a power of two, else length - n),
one for being a sequence of its own, and one for what its end cuts through. Dynamic programming over the cuts finds the
cheapest chain: the best window that is padded to the full length is the least of cost + position among the cuts less
than a length back, which a monotone queue holds; windows of a power of two are looked up.

A task works on stretches of STRETCH tokens: of a stretch's best chain the windows up to LOOK_AHEAD tokens before its end
stand, and the next stretch begins there. So memory is bounded whatever a task or a document holds, and each stretch's
chain is the best there is for it. There is no shuffle. Documents stay in the order of the input splits; other splits
give other windows at the splits' ends, and reruns over the same files the same ones.

Defined results: a null text is empty, and an empty document is its end id alone. Repeated rows are packed each; a null
id stays null. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.bpe import Bpe, byte_alphabet, loaded, slices
from loomspark.llm.common import small_batches, text_or_empty

LENGTH, END = 2048, 1
#: What a sequence costs, and cuts after a sentence and inside one, in tokens of padding.
SEQUENCE, SENTENCE, INSIDE = 16, 4, 32
#: Without a sentence's end for FILL tokens, each STEP-th token may be cut after.
FILL, STEP = 256, 64
STRETCH, LOOK_AHEAD = 1 << 18, 1 << 15
#: Sequences that are handed on at a time.
OUT = 256


def padding(n: int, length: int) -> int:
    """How many tokens of padding a sequence of n gets."""
    return 0 if n & (n - 1) == 0 else length - n


def best_cuts(ends: np.ndarray, cost: np.ndarray, length: int) -> list[int]:
    """Places that may be cut, ascending from above 0 and never more than `length` apart, and what each costs -> the
    chain of cuts up to the last place for which the sum of costs is least."""
    place = np.r_[0, ends]
    powers = [1 << k for k in range(length.bit_length()) if 1 << k <= length]
    exact: list[tuple[int, ...]] = [()] * len(place)
    for p in powers:
        at = np.searchsorted(place, ends - p)
        hit = np.flatnonzero((ends >= p) & (place[at] == ends - p))
        for j, i in zip((hit + 1).tolist(), at[hit].tolist()):
            exact[j] += (i,)
    where, costs = place.tolist(), [0, *(cost + SEQUENCE).tolist()]
    total, came, keyed = [0] * len(where), [0] * len(where), [0] * len(where)
    queue: deque[int] = deque()
    for j in range(1, len(where)):
        i = j - 1
        k = keyed[i]
        while queue and keyed[queue[-1]] >= k:
            queue.pop()
        queue.append(i)
        here = where[j]
        while where[queue[0]] < here - length:
            queue.popleft()
        i = queue[0]
        least = keyed[i] + length - here
        for e in exact[j]:
            if total[e] < least:
                i, least = e, total[e]
        total[j] = least = least + costs[j]
        keyed[j], came[j] = least + here, i
    cuts, j = [], len(where) - 1
    while j:
        cuts.append(where[j])
        j = came[j]
    return cuts[::-1]


def sentence_ends(bpe: Bpe) -> np.ndarray:
    """For each id whether its token ends a sentence."""
    byte = {c: b for b, c in enumerate(byte_alphabet())}
    out = np.zeros(max(bpe.tokens) + 1, bool)
    for i, token in bpe.tokens.items():
        text = bytes(byte.get(c, 0) for c in token.removesuffix(bpe.end)).decode("utf-8", "ignore")
        out[i] = re.fullmatch(r"""[.!?…。！？]+["')\]»”’]*""", text) is not None
    return out


class Packer:
    """The documents of one task that are not handed on yet."""

    def __init__(self, ends_sentence: np.ndarray, length: int):
        self.ends_sentence, self.length = ends_sentence, length
        self.docs: deque[list] = deque()  # [id, tokens in all, first token here, the ids from there on]
        self.tokens = self.sequences = 0

    def add(self, doc, ids: np.ndarray) -> None:
        self.docs.append([doc, len(ids), 0, ids])
        self.tokens += len(ids)

    def places(self, ids: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ids may be cut, and what it costs."""
        at = np.union1d(np.flatnonzero(self.ends_sentence[ids]) + 1, doc_ends)
        at = np.union1d(at, [len(ids)])
        fill, step = min(FILL, self.length), min(STEP, self.length)
        before = np.r_[0, at[:-1]]
        wide = np.flatnonzero(at - before > fill)
        more = [np.arange(a + step, b, step) for a, b in zip(before[wide].tolist(), at[wide].tolist())]
        cost = np.where(np.isin(at, doc_ends), 0, SENTENCE)
        if more:
            more = np.concatenate(more)
            order = np.argsort(np.r_[at, more], kind="stable")
            at, cost = np.r_[at, more][order], np.r_[cost, np.full(len(more), INSIDE)][order]
        return at, cost

    def windows(self, last: bool) -> Iterator[list[tuple]]:
        """Pieces (doc, start, ids, tokens of the document, sequence, offset) of the windows that stand by now."""
        while self.tokens >= STRETCH or last and self.tokens:
            taken, size = [], 0
            while self.docs and size < STRETCH:
                doc = self.docs.popleft()
                if size + len(doc[3]) > STRETCH:
                    rest = [doc[0], doc[1], doc[2] + STRETCH - size, doc[3][STRETCH - size :]]
                    self.docs.appendleft(rest)
                    doc[3] = doc[3][: STRETCH - size]
                taken.append(doc)
                size += len(doc[3])
            ids = np.concatenate([d[3] for d in taken])
            ends = np.cumsum([len(d[3]) for d in taken])
            whole = np.array([d[2] + len(d[3]) == d[1] for d in taken])
            cuts = np.array(best_cuts(*self.places(ids, ends[whole]), self.length))
            if self.docs or not last:
                cuts = cuts[: max(1, int(np.searchsorted(cuts, size - LOOK_AHEAD, side="right")))]
            yield from self._pieces(taken, ids, ends, cuts)
            done = int(cuts[-1])
            self.tokens -= done
            for doc, end in zip(reversed(taken), ends[::-1].tolist()):
                if end > done:
                    skip = max(0, done - end + len(doc[3]))
                    left = [doc[0], doc[1], doc[2] + skip, doc[3][skip:]]
                    if self.docs and left[2] + len(left[3]) < left[1]:  # its own rest is the next one
                        self.docs[0][2:] = [left[2], np.concatenate([left[3], self.docs[0][3]])]
                    else:
                        self.docs.appendleft(left)

    def _pieces(self, docs: list, ids: np.ndarray, ends: np.ndarray, cuts: np.ndarray) -> Iterator[list[tuple]]:
        ids = ids[: cuts[-1]].astype("<u4")
        stops = np.union1d(cuts, ends[ends < cuts[-1]])
        starts = np.r_[0, stops[:-1]]
        of, sequence = np.searchsorted(ends, starts, side="right"), np.searchsorted(cuts, starts, side="right")
        offset = starts - np.r_[0, cuts][sequence]
        begin = np.r_[0, ends[:-1]]
        out = []
        for a, b, d, s, o in zip(starts.tolist(), stops.tolist(), of.tolist(), sequence.tolist(), offset.tolist()):
            doc = docs[d]
            out.append((doc[0], doc[2] + a - int(begin[d]), ids[a:b].tobytes(), doc[1], self.sequences + s, o))
            if len(out) >= OUT:
                yield out
                out = []
        yield out
        self.sequences += len(cuts)


def pack_in_order(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: its document, start (tokens of the document before it), length, ids (little-endian
    unsigned integers of 32 bits), doc_tokens (of the whole document, its end included), sequence_id and offset there."""
    if length < 1:
        raise ValueError("length must be positive")
    id_field = docs.schema[id_col]
    id_type = pa.int64() if id_field.dataType.simpleString() == "bigint" else None
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer, part, kind = loaded(tokenizer), None, 0, id_type

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, tokens, sequence, offset = list(zip(*pieces)) or [()] * 6
            numbers = [np.array(c, np.int64) for c in (start, [len(i) // 4 for i in ids], tokens, sequence, offset)]
            return pa.RecordBatch.from_arrays([pa.array(doc, kind), pa.array(numbers[0]), pa.array(numbers[1]), pa.array(ids, pa.binary()), pa.array(numbers[2]), pa.array(numbers[3] + (part << 40)), pa.array(numbers[4])], names=names)

        for batch in batches:
            if packer is None and batch.num_rows:
                packer, part, kind = Packer(sentence_ends(bpe), length), batch.column(0)[0].as_py(), batch.schema.field(1).type
            for some in slices(batch, 2):
                for doc, ids in zip(some.column(1).to_pylist(), bpe.encode_all(some.column(2).to_pylist())):
                    packer.add(doc, np.append(ids, np.array(end, ids.dtype)))
                for pieces in packer.windows(last=False):
                    yield rows(pieces)
        for pieces in packer.windows(last=True) if packer else ():
            yield rows(pieces)

    small_batches(docs.sparkSession)
    kinds = ["long", "long", "binary", "long", "long", "long"]
    schema = f"`{id_col}` {id_field.dataType.simpleString()}, " + ", ".join(f"`{n}` {k}" for n, k in zip(names[1:], kinds))
    return docs.select(F.spark_partition_id().alias("part"), F.col(f"`{id_col}`"), text_or_empty(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = 0, id_col: str = "doc_id") -> DataFrame:
    """The packed sequences themselves: sequence_id, n_used, doc_ids, cu_seqlens and the padded ids. A sequence has at
    most `length` pieces."""
    piece = F.struct("offset", "length", F.col(f"`{id_col}`").alias("doc_id"), "ids")
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("p"), F.sum("length").alias("n_used"))
    rest = F.when(F.col("n_used").bitwiseAND(F.col("n_used") - 1) == 0, 0).otherwise(length - F.col("n_used"))
    blank = F.lit(np.full(length, pad, "<u4").tobytes())
    ids = F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return rows.select("sequence_id", "n_used", F.col("p.doc_id").alias("doc_ids"), F.concat("p.offset", F.array("n_used")).alias("cu_seqlens"), F.concat(ids, F.substring(blank, F.lit(1), (rest * 4).cast("int"))).alias("ids"))
