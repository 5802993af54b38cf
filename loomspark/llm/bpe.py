"""Byte-pair encoding and decoding with a contiguous rank array.

A word's parts are held in one contiguous array and, beside it, the rank of each adjacent pair. The lowest rank is found
by a scan; its boundary is deleted and the ranks of the two pairs next to it are looked up anew, until no pair has a
rank. The new words of a batch that have the same length take these turns together, as the rows of one matrix. Words of
more than LONG parts would make the scan quadratic; for these the same merges are found by a heap over a linked list.
Results of distinct words are kept in a bounded cache, so common words are merged once.

The tokenizer file is read by every Python worker from a path that is a parameter. Its form: normalization by NFC,
white space and lower case; a split into words by a pattern; bytes as characters; merges with a word end. Special
tokens in a text are found first, in the text as it stands.

Defined results: null and empty texts have no ids and decode to an empty text. Whole texts are encoded, however long.
Repeated rows and other columns are left alone.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from loomspark.llm.common import small_batches

LONG = 64
#: A worker keeps at most about twice so many words, each of at most so many bytes: some 45 MB.
CACHE_WORDS, CACHE_BYTES = 120_000, 64
#: Ids have at most so many bits.
SHIFT = 20
MASK, NONE = (1 << SHIFT) - 1, 1 << 62
SLOTS = 1 << 17
#: Fixed value: the pattern of the tokenizer file that the next lines hold for. Texts of ASCII (but for the separators
#: 1C to 1F) and precomposed Latin letters are split as UTF-8 by a plain expression: among these characters NFC changes
#: nothing, lower case is plain, and all that isn't ASCII is a letter.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
beyond_plain = re.compile("[^\x00-\x1b\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]").search
plain_words = re.compile(rb"[a-z\x80-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t-\r a-z0-9\x80-\xff]+").findall
#: Texts of so many bytes are handed on at a time, about so many words looked up, so many characters split.
SLICE, SLICE_WORDS, PIECE = 512_000, 100_000, 1_000_000

# Where the tables of the tokenizers library are of another Unicode version than Python's or regex's.
#: Letters and digits to regex, but neither to the library.
UNASSIGNED = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CF, 0xA7CF),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81),
    (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Marks that NFC orders or composes in Python, but leaves as they stand in the library.
UNORDERED = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715),
    (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50),
    (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x11938, 0x11938),
    (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42),
    (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE),
    (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
#: Capitals (first, last) to the library alone, with the first one's lower case.
CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)


def _in_class(ranges) -> str:
    return "".join(f"{chr(lo)}-{chr(hi)}" for lo, hi, *_ in ranges)


#: Classes of a pattern, and the same ones by the library's tables.
CLASSES = (
    (r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{_in_class(UNASSIGNED)}]]"),
    (r"[\p{L}]", rf"[\p{{L}}--[{_in_class(UNASSIGNED)}]]"),
    (r"[\p{N}]", rf"[\p{{N}}--[{_in_class(UNASSIGNED)}]]"),
)
unordered = re.compile(f"([{_in_class(UNORDERED)}])")
capitals = re.compile(f"[{_in_class(CAPITALS)}]")


def byte_alphabet() -> list[str]:
    """The character for each byte: printable ones stand for themselves, the others for code points from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Known(dict):
    """Words and their packed ids. When there are too many, they become the older ones, of which only those that are
    met again are taken over; the ones older than these go."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe, self.older, self.long = bpe, {}, []

    def learn(self, new: set[bytes]) -> None:
        """Merges words that aren't there, all at once."""
        for word in self.long:
            self.pop(word, None)
        if len(self) > CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        again = {w for w in new if w in self.older}  # intersection() would go through all the older ones
        self.update((w, self.older[w]) for w in again)
        self.update(self.bpe.merge_words(list(new - again)))
        self.long = [w for w in new if len(w) > CACHE_BYTES]


class Pairs:
    """Ranks of pairs of ids, looked up by arrays: hash tables of SLOTS places, the pairs that collide in the next one."""

    def __init__(self, merges: dict[int, int]):
        self.tables, left = [], np.array(sorted(merges), np.int64)
        value = np.array([merges[p] for p in left.tolist()], np.int64)
        factor = np.random.default_rng(1)
        while len(left):
            by = int(factor.integers(1 << 62)) * 2 + 1
            _, first = np.unique(self._slot(left, by), return_index=True)
            keys, values = np.full(SLOTS, -1), np.full(SLOTS, NONE)
            keys[self._slot(left[first], by)], values[self._slot(left[first], by)] = left[first], value[first]
            self.tables.append((by, keys, values))
            left, value = np.delete(left, first), np.delete(value, first)

    @staticmethod
    def _slot(pair: np.ndarray, by: int) -> np.ndarray:
        return (pair.view(np.uint64) * np.uint64(by) >> np.uint64(64 - SLOTS.bit_length() + 1)).view(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair its rank and what it becomes, as one number, or NONE."""
        pair = left << SHIFT | right
        out = np.full(len(pair), NONE)
        for by, keys, values in self.tables:
            at = self._slot(pair, by)
            out = np.where(keys[at] == pair, values[at], out)
        return out


class Bpe:
    """One tokenizer file, ready to encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        #: Ids are kept and handed on as little-endian numbers of this kind.
        self.width, self.code = ("<u2", "H") if max(self.tokens) < 1 << 16 else ("<u4", "I")
        self.end = model["end_of_word_suffix"] or ""
        self.first = np.array([vocab[c] for c in byte_alphabet()])
        self.last = np.array([vocab[c + self.end] for c in byte_alphabet()])
        #: For a pair of ids as one number, its rank and the id that it becomes, as one number.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[a] << SHIFT | vocab[b], rank << SHIFT | vocab[a + b])
        self.ranks = Pairs(self.merges).ranks
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.plain = split == SPLIT
        for theirs, ours in CLASSES:
            split = split.replace(theirs, ours)
        self.words = regex.compile(split, regex.V1).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known = Known(self)

    def normal(self, text: str) -> str:
        """NFC and lower case, each character by itself (no final form of sigma). White space only parts words."""
        if not text.isascii():
            text = "".join([unicodedata.normalize("NFC", part) for part in unordered.split(text)])
            if capitals.search(text):
                text = capitals.sub(lambda m: chr(next(to + ord(m[0]) - lo for lo, hi, to in CAPITALS if lo <= ord(m[0]) <= hi)), text)
        return text.replace("Σ", "σ").lower()

    def merge_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each word, as packed numbers."""
        short = [w for w in words if len(w) <= LONG]
        out = dict(zip(short, self._by_scan(short)))
        for word in words:
            if len(word) > LONG:
                ids = self.first[list(word)].tolist()
                ids[-1] = int(self.last[word[-1]])
                out[word] = array(self.code, self._by_heap(ids)).tobytes()
        for text, i in self.special.items():
            if text.encode() in out:
                out[text.encode()] = array(self.code, [i]).tobytes()
        return out

    def _by_scan(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word. All words' parts stand in one array, one after the other; in every turn each
        word merges its pair of the lowest rank, and words without such a pair leave."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        parts = np.frombuffer(b"".join(words), np.uint8)
        ids = self.first[parts]
        ids[np.cumsum(sizes) - 1] = self.last[parts[np.cumsum(sizes) - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        ranks = np.r_[self.ranks(ids[:-1], ids[1:]), NONE]
        ranks[np.cumsum(sizes) - 1] = NONE  # no pair reaches into the next word
        done_ids, done_words = [], []
        while True:
            low = np.repeat(np.minimum.reduceat(ranks, np.cumsum(sizes) - sizes), sizes)
            going = low < NONE
            done_ids.append(ids[~going])
            done_words.append(word[~going])
            ids, ranks, word, low = ids[going], ranks[going], word[going], low[going]
            if not len(ids):
                break
            at = np.flatnonzero(ranks == low)
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]  # of equal pairs of a word the first
            ids[at] = low[at] & MASK
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            ids, word, ranks = ids[stays], word[stays], np.delete(ranks, at)
            at -= np.arange(len(at))
            begins = np.r_[True, word[1:] != word[:-1], True]
            sizes = np.diff(np.flatnonzero(begins))
            changed = np.r_[at[~begins[at]] - 1, at[~begins[at + 1]]]  # the pairs that end and begin with what was merged
            ranks[changed] = self.ranks(ids[changed], ids[changed + 1])
        word = np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        packed = np.concatenate(done_ids)[order].astype(self.width)
        ends = (np.cumsum(np.bincount(word, minlength=len(words))) * packed.itemsize).tolist()
        packed = packed.tobytes()
        return [packed[i:j] for i, j in zip([0, *ends], ends)]

    def _by_heap(self, ids: list[int]) -> list[int]:
        rank_of, n = self.merges.get, len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        pairs = [a << SHIFT | b for a, b in zip(ids, ids[1:])]
        heap = [(rank_of(p), i, p) for i, p in enumerate(pairs) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            low, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or ids[i] << SHIFT | ids[j] != pair:
                continue
            ids[i], ids[j], after[i] = low & MASK, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (p := ids[left] << SHIFT | ids[right]) in self.merges:
                    heapq.heappush(heap, (rank_of(p), left, p))
        return [x for x in ids if x >= 0]

    def words_of(self, text: str) -> Iterator[list[bytes]]:
        """The words of a text, special tokens among them, part by part, as UTF-8."""
        for piece in self.specials.split(text) if self.specials and "<|" in text else (text,):
            if piece in self.special:
                yield [piece.encode()]
                continue
            for part in _parts(piece):
                if self.plain and not beyond_plain(part):
                    yield plain_words(part.lower().encode())
                else:
                    yield [w.encode() for w in self.words(self.normal(part))]

    def encode_all(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The ids of whole texts."""
        packed: list[list[bytes]] = []
        held: list[tuple[list[bytes], list[bytes]]] = []
        size = 0

        def flush() -> None:
            found = [list(map(self.known.get, words)) for _, words in held]
            gaps = [[k for k, ids in enumerate(of) if ids is None] for of in found]
            self.known.learn({words[k] for at, (_, words) in zip(gaps, held) for k in at})
            for of, at, (parts, words) in zip(found, gaps, held):
                for k in at:
                    of[k] = self.known[words[k]]
                parts.append(b"".join(of))
            held.clear()

        for text in texts:
            packed.append([])
            for words in self.words_of(text):
                held.append((packed[-1], words))
                size += len(words)
                if size > SLICE_WORDS:
                    flush()
                    size = 0
        flush()
        return [np.frombuffer(p[0] if len(p) == 1 else b"".join(p), self.width) for p in packed]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The tokens' texts, joined by spaces, as the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


def _parts(text: str) -> Iterator[str]:
    """The text in parts of about PIECE characters, each but the first one beginning with a space, which joins nothing."""
    start = 0
    while len(text) - start > PIECE and (end := text.find(" ", start + PIECE)) > 0:
        yield text[start:end]
        start = end
    yield text[start:] if start else text


@lru_cache(maxsize=4)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose texts (column number at) have about SLICE bytes together."""
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False)).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + SLICE)))
        yield batch.slice(start, end - start)
        start = end


def encode_table(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """df with the ids of each text and, if decoded_col names a column, the text that the ids decode to. Columns of
    these names that df has are replaced."""
    new = {ids_col: ArrayType(IntegerType())} | ({decoded_col: StringType()} if decoded_col else {})
    kept = [f for f in df.schema if f.name not in new]
    out = StructType([*kept, *[StructField(n, t) for n, t in new.items()]])
    rows = df.select(F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{f.name}`") for f in kept])
    small_batches(df.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for piece in slices(batch, 0):
                ids = bpe.encode_all([t or "" for t in piece.column(0).to_pylist()])
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                arrays = [*piece.columns[1:], pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).astype(np.int32)))]
                if decoded_col:
                    arrays.append(pa.array([bpe.decode(i.tolist()) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return rows.mapInArrow(encode, out)


def decode_table(df: DataFrame, path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """df with the text that each array of ids decodes to; null stays null."""
    kept = [f for f in df.schema if f.name != decoded_col]
    out = StructType([*kept, StructField(decoded_col, StringType())])
    at = [f.name for f in kept].index(ids_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [None if i is None else bpe.decode(i) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=out.names)

    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(decode, out)
