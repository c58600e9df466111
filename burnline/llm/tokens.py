"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The vocabulary writes bytes as printable characters. ``byte_chars`` is that
table; encoding maps a text's pre-tokens to ids and character offsets, decoding
joins the bytes that the characters of the ids stand for, so that a character
split over several ids comes out whole.

Pre-tokens never reach across a lone space, so a text is cut at those, and the
ids of each distinct piece (those of its pre-tokens, each encoded by itself)
are remembered in a cache of bounded size.

Nulls and edge cases: a null text is empty and has no ids. Strings that look
like special tokens are ordinary text. An id outside the vocabulary is an
error in decoding. Texts of any length are read in bounded lists of pre-tokens.
Repeated rows are encoded each, extra columns are carried along only if asked
for by name, and an empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import held, slices, texts

#: Entries of each of the two generations of a worker process's cache (an entry takes about 200 bytes), and the
#: longest piece it holds.
CACHE_ENTRIES, CACHED_CHARS = 120_000, 64
#: Bytes of text encoded at a time.
SLICE_BYTES = 2 << 20
#: No letters, digits or white space: a run of them after a word is one pre-token.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


@cache
def byte_chars() -> dict[int, str]:
    """The character that stands for each byte: printable bytes for themselves,
    the others, in order, for the code points from 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)}


@lru_cache(1)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids of a vocabulary, one after the other, and where each id's bytes start (and the last end)."""
    from tokenizers import Tokenizer
    of = {c: b for b, c in byte_chars().items()}
    vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = bytes(of[c] for c in token)
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum([0, *map(len, table)])


def decoded(ids: np.ndarray, path: str, block: int = 1 << 18) -> tuple[bytes, np.ndarray]:
    """The bytes of a sequence of ids, and how many each id has."""
    data, start = byte_table(path)
    sizes = start[ids + 1] - start[ids]
    out = []
    for at in range(0, len(ids), block):
        part, n = ids[at:at + block], sizes[at:at + block]
        shift = start[part] - (np.cumsum(n) - n)  # from a place in the output to its place in the table
        out.append(data[np.arange(n.sum()) + np.repeat(shift, n)].tobytes())
    return b"".join(out), sizes


#: Pieces of up to this many bytes are compared; longer ones each count as distinct.
_COMPARED = 24
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def _cut(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the pieces between spaces."""
    ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 32), len(data))
    return np.concatenate([[0], ends[:-1] + 1]), ends


def _distinct(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the number of its content, and for each content one piece
    that has it. Pieces are sorted by a hash of their bytes and compared with
    their neighbours; a content may have several numbers if hashes collide."""
    window = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data + bytes(_COMPARED + 8), np.uint8), 8)
    keys = []
    for at in range(0, _COMPARED, 8):
        bytes_ = window[starts + at].view("<u8").ravel()
        keys.append(bytes_ & _LOW_BYTES[np.clip(sizes - at, 0, 8)])
    with np.errstate(over="ignore"):
        mixed = keys[0] * _MIX[0] ^ keys[1] * _MIX[1] ^ keys[2] * _MIX[2]
    order = np.argsort(mixed)
    fresh = np.ones(len(order), bool)
    fresh[1:] = sizes[order[1:]] > _COMPARED
    for key in [*keys, sizes]:
        key = key[order]
        fresh[1:] |= key[1:] != key[:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return number, order[fresh]


class ByteBpe:
    """A byte-level BPE vocabulary file, with a cache of encoded pre-tokens."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._split = regex.compile(public_tokenizers.PATTERN)
        self._entries = entries
        # The ids of each piece with a space before it, and those in use before the cache last filled up; of pre-tokens
        # of pieces that are more than a word.
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {}
        self._sizes = np.diff(byte_table(path)[1])

    def matches(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, in lists of bounded length."""
        if len(text) <= 1 << 20:
            yield self._split.findall(text)
            return
        found = self._split.finditer(text)
        while part := [m.group() for m in islice(found, 200_000)]:
            yield part

    def _whole(self, text: str) -> bytes:
        if not text:
            return b""
        return b"".join(np.array(e.ids, "<u4").tobytes() for part in self.matches(text)
                        for e in self._tokenizer.encode_batch_fast(part, add_special_tokens=False))

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """The ids of each word of letters with a space before it. Every such
        space starts a pre-token, so the words are encoded as one text and its
        ids dealt to them by the bytes they stand for."""
        ids = np.array(self._tokenizer.encode_batch_fast(["".join(f" {w}" for w in words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        cuts = 4 * (np.searchsorted(np.cumsum(self._sizes[ids]), ends) + 1)
        data, at = ids.tobytes(), 0
        for cut in cuts.tolist():
            yield data[at:cut]
            at = cut

    def _learn(self, pieces: set[str], firsts: list[str]) -> tuple[set[str], list[bytes]]:
        """Remember the ids of each piece, with the space before it. Returns the
        pieces that cannot be remembered: too long ones, and those with white
        space beside the space of the cut, as pre-tokens may reach across it;
        and the ids of the texts' first pieces, which have no space before them."""
        if len(self._known) > self._entries:
            self._known, self._older = {}, self._known
        if len(self._parts) > self._entries // 4:
            self._parts = {}
        known, older, parts = self._known, self._older, self._parts
        new = pieces.difference(known)
        if older:
            again = new.intersection(older)
            known.update(zip(again, map(older.__getitem__, again)))
            new -= again
        words = [p for p in new if p.isalpha()]
        left = {p for p in words if len(p) > CACHED_CHARS}
        if left:
            words = [p for p in words if p not in left]
        tailed, others = [], []
        for p in new.difference(words, left):
            stem = p.rstrip(_MARKS)
            if len(p) > CACHED_CHARS or not p or p[0].isspace() or p[-1].isspace():
                left.add(p)
            elif stem.isalpha():  # marks after a word are one match
                tailed.append((p, stem, p[len(stem):]))
            else:
                others.append(p)
        matches = [self._split.findall(" " + p) for p in others]
        begun = [self._split.findall(p) if len(p) <= CACHED_CHARS else None for p in firsts]
        rest = [*{t for _, _, t in tailed}.union(*matches, *filter(None, begun)).difference(parts)]
        for m, e in zip(rest, self._tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            parts[m] = np.array(e.ids, "<u4").tobytes()
        words = [*{w for _, w, _ in tailed}.difference(known).union(words)]
        if words:
            known.update(zip(words, self._words(words)))
        for p, word, tail in tailed:
            known[p] = known[word] + parts[tail]
        for p, ms in zip(others, matches):
            known[p] = b"".join([parts[m] for m in ms])
        return left, [self._whole(p) if ms is None else b"".join([parts[m] for m in ms]) for p, ms in zip(firsts, begun)]

    def ids(self, whole: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        if not whole:
            return
        encoded = [t.encode() for t in whole]
        data = b" ".join(encoded)
        starts, ends = _cut(data)
        first = np.searchsorted(starts, np.cumsum([0, *(len(e) + 1 for e in encoded[:-1])]))  # piece of each text
        piece, example = _distinct(data, starts, ends - starts)
        used = np.ones(len(piece), bool)
        used[first] = False
        seen = np.zeros(len(example), bool)
        seen[piece[used]] = True
        example = example[seen]
        words = [data[a:b].decode() for a, b in zip(starts[example].tolist(), ends[example].tolist())]
        firsts = [data[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        left, begun = self._learn(set(words), firsts)
        # Texts with white space beside a cut, or with pieces that are not remembered, are read piece by piece.
        text = np.repeat(np.arange(len(whole)), np.diff([*first, len(piece)]))
        apart = np.array([not p or p[-1].isspace() for p in firsts])
        if left:
            ids = [self._known.get(w, b"") for w in words]
            kept_out = np.zeros(len(seen), bool)
            kept_out[seen] = [w in left for w in words]
            apart[text[used & kept_out[piece]]] = True
        else:
            ids = [*map(self._known.__getitem__, words)]
        sizes = np.zeros(len(seen), np.int64)
        sizes[seen] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        offset, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), "<u4")
        n = np.where(used & ~apart[text], sizes[piece], 0)
        total = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat(offset[piece] - total[:-1], n) + np.arange(total[-1])]
        bounds = total[[*first, len(piece)]].tolist()
        for i, begin in enumerate(begun):
            if apart[i]:
                yield b"".join(self._grouped(whole[i].split(" "), left))
            else:
                yield begin + out[bounds[i]:bounds[i + 1]].tobytes()

    def _grouped(self, parts: list[str], left: set[str]) -> Iterator[bytes]:
        """The ids of a text from its pieces, those that white space joins taken together."""
        group, space = [parts[0]], ""
        for p in [*parts[1:], None]:
            q = group[-1]
            if p is not None and not (p and q and not p[0].isspace() and not q[-1].isspace()):
                group.append(p)
                continue
            if space and len(group) == 1 and q not in left:
                yield self._known[q]
            else:
                yield self._whole(space + " ".join(group))
            group, space = [p], " "

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """The first and past-the-end character of each id; ids that share a
        character all cover it."""
        out, at = [], 0
        for part in self.matches(text):
            for word, e in zip(part, self._tokenizer.encode_batch(part, add_special_tokens=False)):
                out += [(at + a, at + b) for a, b in e.offsets]
                at += len(word)
        return out


def bpe(path: str, entries: int = CACHE_ENTRIES) -> ByteBpe:
    """The vocabulary at ``path``, kept in the worker process."""
    return held(("bpe", path, entries), lambda: ByteBpe(path, entries))


def encode(docs: DataFrame, path: str, columns: list[str] | None = None, with_offsets: bool = False) -> DataFrame:
    """The ``columns`` of ``docs`` with ``ids`` and, if asked for, ``starts`` and ``ends`` of the ids in characters."""
    columns = docs.columns if columns is None else columns
    source = docs.select(*dict.fromkeys([*columns, "text"]))
    new = ["ids", "starts", "ends"] if with_offsets else ["ids"]
    schema = StructType([*(source.schema[c] for c in columns), *(StructField(n, ArrayType(IntegerType())) for n in new)])

    def run(batches):
        for batch in slices(batches, max_bytes=SLICE_BYTES, keep_held=True):
            whole, coder = texts(batch), bpe(path)
            made = [_lists([np.frombuffer(b, "<u4") for b in coder.ids(whole)])]
            if with_offsets:
                spans = [np.array(coder.offsets(t), np.int32).reshape(-1, 2) for t in whole]
                made += [_lists([s[:, k] for s in spans]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made], [*columns, *new])

    return source.mapInArrow(run, schema)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate([*parts, np.empty(0, np.int32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def decode(encoded: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """The ``columns`` of ``encoded`` with ``decoded``, the bytes of its ``ids`` (null: none)."""
    source = encoded.select(*dict.fromkeys([*columns, "ids"]))
    schema = StructType([*(source.schema[c] for c in columns), StructField("decoded", BinaryType())])

    def run(batches):
        for batch in batches:
            for part in _ids_slices(batch):
                lists = part.column("ids")
                lengths = np.array(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
                data, sizes = decoded(np.asarray(lists.flatten()), path)
                ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(lengths)])]
                out = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), out], [*columns, "decoded"])

    return source.mapInArrow(run, schema)


def _ids_slices(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``most`` ids (one row at least)."""
    total = np.cumsum(np.array(pc.fill_null(pc.list_value_length(batch.column("ids")), 0), np.int64))
    at = 0
    while at < len(total):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end
