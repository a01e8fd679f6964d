"""Packing by minimum bin slack: a bitset subset-sum picks for each window the remaining lengths that fill it best."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.base import checkpointed, read, slices

CAPACITY = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Pieces that wait to be packed together (at most 16 KB of ids each); windows are full long before they run out.
BUFFER = 4096
#: A window with more slack than this share of its capacity gets part of one more piece.
SLACK_SHARE = 1 / 256
#: Pieces of text whose ids a task remembers.
CACHE = 500_000
#: Bytes of text that are cut into pieces at once.
STRETCH = 4 << 20

_SPACE, _LETTER, _NUMBER, _SYMBOL = range(4)
#: Characters from here on are left to the library, with all of the token that holds them.
_BEYOND = 0x250


def _character_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each character below U+0280 its kind, its lower case and whether the library must see it: those beyond, those
    whose lower case has another length, and separators on whose being white space libraries differ."""
    kind, lower, odd = np.full(0x280, _SYMBOL, np.uint8), np.arange(0x280), np.zeros(0x280, bool)
    for c in range(0x280):
        x = chr(c)
        category, small = unicodedata.category(x), x.lower()
        kind[c] = _LETTER if category[0] == "L" else _NUMBER if category[0] == "N" else _SPACE if x.isspace() and not 0x1C <= c <= 0x1F else _SYMBOL
        odd[c] = c >= _BEYOND or 0x1C <= c <= 0x1F or len(small.encode()) != len(x.encode())
        if not odd[c]:
            lower[c] = ord(small)
    return kind, lower, odd


_KIND, _LOWER, _ODD = _character_tables()
_BYTE_KIND = np.concatenate((_KIND[:128], np.full(128, _LETTER, np.uint8)))
_BYTE_LOWER = np.concatenate((_LOWER[:128], np.arange(128, 256))).astype(np.uint8)
_BYTE_ODD = np.concatenate((_ODD[:128], np.arange(128, 256) >= 0xCA))
_STRANGE = re.compile("<\\||[" + "".join(map(chr, np.flatnonzero(_ODD[:_BEYOND]))) + chr(_BEYOND) + "-\U0010ffff]")
#: What a vocabulary file must say for the arrays to stand for the library (fixed values); others are left to the library.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: How byte-level vocabularies write a byte: printable ones as themselves, the others from U+0100 on, in order.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_WRITTEN = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


def pieces_of(raw: bytes | pa.Buffer) -> tuple[pa.Array, np.ndarray]:
    """The vocabulary's pieces of a UTF-8 text, in lower case, and where each begins: contractions, runs of letters,
    single digits, runs of other signs. A token with a character that the tables don't cover is one piece, as it is.

    No piece holds white space, and the vocabulary's pattern looks at nothing beyond a piece, so pieces can be told
    from the kinds of neighbouring characters alone.
    """
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    kind, lower, odd = _BYTE_KIND[data], _BYTE_LOWER[data], _BYTE_ODD[data]
    two = np.flatnonzero((data >= 0xC2) & (data < 0xCA))
    if len(two):
        code = (data[two].astype(np.int32) & 0x1F) << 6 | data[two + 1] & 0x3F
        kind[two] = kind[two + 1] = _KIND[code]
        small = _LOWER[code]
        lower[two], lower[two + 1] = 0xC0 | small >> 6, 0x80 | small & 0x3F
        odd[two] |= _ODD[code]
    angle = np.flatnonzero(data[:-1] == ord("<"))
    odd[angle[data[angle + 1] == ord("|")]] = True  # a special token may begin here
    begins = np.empty(len(data), bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= (kind == _NUMBER) & (data & 0xC0 != 0x80)
    begins &= kind != _SPACE
    quote = np.flatnonzero((data == ord("'")) & begins)
    if len(quote):
        after = np.concatenate((lower, np.zeros(3, np.uint8)))
        a, b = after[quote + 1], after[quote + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        both = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for at, size in ((quote[one], 2), (quote[both], 3)):
            begins[at + 1] = False
            rest = at + size
            rest = rest[rest < len(data)]
            begins[rest] = kind[rest] != _SPACE
    strange = np.flatnonzero(odd)
    if len(strange):
        blank = np.flatnonzero(kind == _SPACE)
        token = np.unique(np.searchsorted(blank, strange))
        low, high = np.concatenate(([-1], blank))[token] + 1, np.concatenate((blank, [len(data)]))[token]
        edge = np.zeros(len(data) + 1, np.int8)
        edge[low] += 1
        edge[high] -= 1
        within = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
        begins[within] = False
        begins[low] = True
        lower[within] = data[within]
    at = np.flatnonzero(begins)
    keep = kind != _SPACE
    text = lower[keep]
    places = np.append(np.cumsum(keep, dtype=np.int32)[at] - 1, np.int32(len(text))).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(places), pa.py_buffer(text)), at


def arrays_stand_for(path: str) -> bool:
    """Whether ``pieces_of`` cuts texts as the vocabulary file says: its normaliser and its pre-tokeniser are those, its
    model is plain BPE, and its special tokens begin with ``<|``, which the arrays look out for."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    model = said["model"]
    plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "byte_fallback", "unk_token", "continuing_subword_prefix"))
    special = all(t["content"].startswith("<|") and not any(t[x] for x in ("single_word", "lstrip", "rstrip", "normalized")) for t in said["added_tokens"])
    return plain and special and (said["normalizer"], said["pre_tokenizer"]) == (_NORMALIZER, _PRE_TOKENIZER)


class Encoder:
    """Ids of texts, the end id last; equal to the library's own, for any vocabulary file that the library reads.

    Where ``arrays_stand_for`` the vocabulary, the library's cutting of texts is done by arrays; else it does all. A
    batch is cut into pieces by array operations and its distinct pieces are looked up; only pieces not met before go
    to the library's model. Of more than CACHE pieces those are kept that were met in several batches.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.by_arrays = arrays_stand_for(path)
        self.end_id = end_id
        self._forget([])

    def _forget(self, kept: list[tuple[str, np.ndarray]]) -> None:
        """Only ``kept`` pieces, and at place 0 the end id, are remembered."""
        self.places = {p: i + 1 for i, (p, _) in enumerate(kept)}
        ids = [np.array([self.end_id], np.uint32), *(x for _, x in kept)]
        self.ids = np.concatenate(ids)
        self.count = np.array([len(x) for x in ids])
        self.first = np.cumsum(self.count) - self.count
        self.met = np.zeros(len(ids), np.int32)

    def _learnt(self, piece: str) -> list[int]:
        if piece.isascii() and piece.isprintable() and "<|" not in piece:
            return [t.id for t in self.model.tokenize(piece)]
        if _STRANGE.search(piece):
            return self.library.encode(piece, add_special_tokens=False).ids
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_WRITTEN))]

    def _looked_up(self, pieces: list[str]) -> np.ndarray:
        known = self.places
        at = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(at < 0).tolist()
        if new and len(known) + len(new) > CACHE:
            often = self.met >= 2
            often[at[at > 0]] = True  # and those of this batch
            often &= often.sum() <= CACHE // 2
            self._forget([(p, self.ids[self.first[i] : self.first[i] + self.count[i]]) for p, i in known.items() if often[i]])
            known = self.places
            at = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
            new = np.flatnonzero(at < 0).tolist()
        if new:
            unseen = [pieces[i] for i in new]
            made = list(map(self._learnt, unseen))
            count = np.fromiter(map(len, made), np.int64, len(made))
            at[new] = own = np.arange(len(self.count), len(self.count) + len(new))
            known.update(zip(unseen, own.tolist()))
            self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(count) - count))
            self.count = np.concatenate((self.count, count))
            self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(made), np.uint32)))
            self.met = np.concatenate((self.met, np.zeros(len(new), np.int32)))
        self.met[at] += 1
        return at

    def _joined(self, raw: bytes | pa.Buffer, ends: np.ndarray, last: bool = True) -> list[np.ndarray]:
        """The ids of texts that stand one after another in ``raw``, each up to one of ``ends``."""
        found, begin = pieces_of(raw)
        if len(found):
            coded = found.dictionary_encode()
            at = self._looked_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy(zero_copy_only=False)]
        else:
            at = np.zeros(0, np.int64)
        cuts = np.searchsorted(begin, ends)
        if last:
            at = np.insert(at, cuts, 0)
            cuts = cuts + np.arange(1, len(cuts) + 1)
        count = self.count[at]
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.ids[np.repeat(self.first[at] - total[:-1], count) + np.arange(total[-1])]
        stops = total[cuts].tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (null: none but the end id). Very long texts are cut at white space as they go."""
        texts = pc.fill_null(texts, "")
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        out, first = [], 0
        while first < len(texts):
            many = max(1, int(np.searchsorted(np.cumsum(size[first:]), STRETCH, side="right")))
            if not self.by_arrays:
                made = self.library.encode_batch(texts.slice(first, many).to_pylist(), add_special_tokens=False)
                out += [np.array([*x.ids, self.end_id], np.uint32) for x in made]
            elif many == 1 and size[first] > STRETCH:
                out.append(self._long(texts[first].as_py().encode()))
            else:
                part = pa.ListArray.from_arrays(pa.array([0, many], pa.int32()), texts.slice(first, many))
                out += self._joined(pc.binary_join(part, "\n")[0].as_buffer(), np.cumsum(size[first : first + many] + 1) - 1)
            first += many
        return out

    def _long(self, raw: bytes) -> np.ndarray:
        made, first = [], 0
        while first < len(raw):
            last = min(len(raw), first + STRETCH)
            while last < len(raw) and raw[last] not in b" \t\n\v\f\r":
                last += 1
            made += self._joined(raw[first:last], np.array([last - first]), last=False)
            first = last
        return np.concatenate([*made, np.array([self.end_id], np.uint32)])


@cache
def encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def fill(lengths: Counter, capacity: int, sizes: list[int] | None = None) -> list[tuple[int, int]]:
    """(length, how many) of a multiset within ``lengths`` whose sum comes closest to ``capacity`` from below; it holds
    the longest length that fits, so that long pieces don't pile up. ``sizes``: the lengths there are, in order.

    Bit s of ``reach`` says that sum s can be made. Counts are split into powers of two; each step's bits are kept,
    and walking back through them gives the counts. It stops as soon as the capacity itself can be made.
    """
    sizes = sorted(x for x, n in lengths.items() if n) if sizes is None else sizes
    fit = bisect_left(sizes, capacity + 1)
    if not fit:
        return []
    first = sizes[fit - 1]
    room = capacity - first
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for i in range(fit - 1, -1, -1):
        if reach >> room & 1:
            break
        size = sizes[i]
        n, part = min(lengths[size] - (size == first), room // size), 1
        while n > 0 and not reach >> room & 1:
            k = min(part, n)
            steps.append((size, k, reach))
            reach |= (reach << (size * k)) & full
            n, part = n - k, part * 2
    left = reach.bit_length() - 1
    counts: Counter = Counter({first: 1})
    for size, k, before in reversed(steps):
        if not before >> left & 1:
            left -= size * k
            counts[size] += k
    return list(counts.items())


class Waiting:
    """Pieces that wait for a window, by length. A piece is a tuple, whose length ``length`` tells."""

    def __init__(self, capacity: int, length: Callable[[tuple], int]):
        self.capacity, self.length = capacity, length
        self.by_length: dict[int, list[tuple]] = defaultdict(list)
        self.counts: Counter = Counter()
        self.sizes: list[int] = []
        self.pieces = self.tokens = 0

    def add(self, piece: tuple) -> None:
        size = self.length(piece)
        if not self.counts[size]:
            self.sizes.insert(bisect_left(self.sizes, size), size)
        self.counts[size] += 1
        self.by_length[size].append(piece)
        self.pieces += 1
        self.tokens += size

    def take(self, size: int) -> tuple:
        self.counts[size] -= 1
        if not self.counts[size]:
            del self.counts[size]
            del self.sizes[bisect_left(self.sizes, size)]
        self.pieces -= 1
        self.tokens -= size
        return self.by_length[size].pop()

    def window(self) -> list[tuple]:
        """The pieces of the next window, taken out: those whose sum comes closest to the capacity."""
        return [self.take(size) for size, n in fill(self.counts, self.capacity, self.sizes) for _ in range(n)]


_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_KINDS = [pa.int64()] * 6


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece of each row of ``docs``.

    A document's ids are cut into whole windows and a remainder, and remainders are packed where they are read, with
    no text shuffled. Whenever BUFFER of them wait, windows of least slack are taken until half are left; where the
    best window still lacks more than SLACK_SHARE of its capacity (no waiting piece is that short), the longest piece
    is cut to fill it. So each task is left with less than one window. Those rests go, as narrow rows, to a second
    round that packs those of 64 tasks together, and only there can more padding arise.

    A null or empty text has the end id alone; an empty table gives no rows; repeated rows are pieces of their own,
    also under a null doc_id. Of pieces of one length the last read goes first. Ids of windows are unique, and the same
    on a retry over the same partitions.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    schema = T.StructType([docs.schema["doc_id"]] + T._parse_datatype_string(_PIECE).fields)
    names = schema.names

    def batch_of(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, [id_type, *_KINDS])], names=names)

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, made, id_type = encoder(path, end_id), TaskContext.get().partitionId(), 0, pa.int64()
        waiting = Waiting(capacity, lambda p: len(p[2]))  # doc_id, start, ids, tokens of the document
        spare = int(capacity * SLACK_SHARE)

        def windows(until: int) -> Iterator[list[tuple]]:
            while waiting.pieces > until and waiting.tokens >= capacity:
                window = waiting.window()
                slack = capacity - sum(len(p[2]) for p in window)
                if slack > spare:
                    doc, start, ids, n = waiting.take(waiting.sizes[-1])
                    window.append((doc, start, ids[:slack], n))
                    waiting.add((doc, start + slack, ids[slack:], n))
                yield window

        def rows(window: list[tuple], sequence: int | None) -> Iterator[tuple]:
            offset = 0
            for doc, start, ids, n in window:
                yield doc, start, len(ids), zlib.crc32(ids.tobytes()), n, sequence, offset if sequence is not None else task
                offset += len(ids)

        def numbered(found: Iterator[list[tuple]]) -> Iterator[tuple]:
            nonlocal made
            for window in found:
                yield from rows(window, (task << 40) + made)
                made += 1

        for batch in slices(batches, 1):
            id_type, out = batch.column(0).type, []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                n = len(ids)
                whole = n - n % capacity
                out += numbered([(doc, at, ids[at : at + capacity], n)] for at in range(0, whole, capacity))
                if whole < n:
                    waiting.add((doc, whole, ids[whole:].copy(), n))
                    if waiting.pieces >= BUFFER:
                        out += numbered(windows(BUFFER // 2))
            yield batch_of(out, id_type)
        # what fills no window goes on, marked by a null sequence
        out = list(numbered(windows(0)))
        rest = [waiting.take(size) for size in list(waiting.sizes) for _ in range(waiting.counts[size])]
        yield batch_of(out + list(rows(rest, None)), id_type)

    def rests(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("offset", "doc_id", "start", "length", "ids_crc32")])
        waiting, out, made = Waiting(capacity, lambda p: p[2]), [], (1 << 62) + (int(key[0].as_py()) << 40)
        for piece in zip(*(table.column(c).to_pylist() for c in names[:5])):
            waiting.add(piece)
        while waiting.pieces:
            offset = 0
            for p in waiting.window():
                out.append((*p, made, offset))
                offset += p[2]
            made += 1
        return pa.Table.from_batches([batch_of(out, table.column(0).type)])

    found = checkpointed(docs.select("doc_id", "text").mapInArrow(here, schema))
    again = found.filter("sequence_id IS NULL").groupBy(F.floor(F.col("offset") / 64).alias("group")).applyInArrow(rests, schema)
    return found.filter("sequence_id IS NOT NULL").unionByName(again)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
