"""Hierarchical multi-length packing of tokenised documents (operator 1)."""

from __future__ import annotations

import ctypes
import heapq
import os
import re
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import blocks, small_batches, texts_of

TIERS = (256, 512, 1024, 2048, 4096)
#: Tokens that are tokenised and packed together in one worker before pieces leave it.
BLOCK_TOKENS = 1 << 21
#: Text bytes that are tokenised in one step, which takes some sixteen times as much memory.
ENCODE_BYTES = 2 << 20
#: Words whose ids a task remembers, half of them as long as they keep occurring: speed alone.
CACHE_WORDS = 200_000

_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "!-/:-@[-`{-~"
#: Precomposed Latin letters, which the normaliser only lower-cases, and ASCII marks after them.
_SIMPLE = f"^[{_LETTERS}]+[{_MARKS}]*$"
_LOWER_LETTERS = "".join(map(chr, (*range(ord("a"), ord("z") + 1), *range(ord("ß"), ord("ö") + 1), *range(ord("ø"), ord("ÿ") + 1))))
_ASCII_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: The byte-level alphabet's characters for bytes above ASCII: the bytes that Latin-1 does not print
#: stand, in order, from 256 + 33 + 1 on.
_BYTE_CHARS = dict(zip([*range(128, 161), 173], [*range(256 + 34, 256 + 67), 256 + 67], strict=True))
#: What a tokenizer is tried on before a shorter way than its own is taken.
_PROBES = ("The", "quick", "BROWN", "Größe", "señor", "ÿ", "crème", "don't", "stop-me", "x9", "東京", "naïve", "e\u0301", "'s", "ﬁne", "Straße", "übergrößenträger", "antidisestablishmentarianism", "aé", "Ñandú")

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
    "offset long, sequence_length long, tier int, step_group long"
)


class WordEncoder:
    """Token ids of whole texts by way of their distinct words.

    No token of a tokenizer that drops white space spans any of it, so a text's ids are those of its
    white-space-separated words in order, and each distinct word of a block is encoded once. Runs of
    Latin letters, each of which is one pre-token, go straight to the model. Both ways are tried on
    probes first: a tokenizer that does not bear one out does without it.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are dealt out by Spark
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.end = np.uint32(end_id).tobytes()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        each = b"".join(map(self._whole, _PROBES))
        self.by_words = all(self._whole(space.join(_PROBES)) == each for space in (" ", "\n", " \t\r\x0b\x0c "))
        probes = [p + m for p in _PROBES for m in ("", ",", "...", "'", "&&&", '")', *(_ASCII_MARKS if p == "The" else ""))]
        simple = [p for p in probes if re.fullmatch(_SIMPLE[1:-1], p)]
        self.by_runs = self.by_words and all(self._run(x.rstrip(_ASCII_MARKS).lower()) + self._whole(x[len(x.rstrip(_ASCII_MARKS)) :]) == self._whole(x) for x in simple)
        self.young.clear()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _run(self, letters: str) -> bytes:
        """Ids of a run of lower-case Latin letters straight from the model."""
        mapped = letters if letters.isascii() else letters.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def _known(self, words: pa.Array, encode) -> pa.Array:
        """The ids of distinct words, each a binary value; what is not remembered comes from encode.

        Two generations are kept: a word that occurs again moves to the young one, and when that is
        full, what has not occurred since the last time is forgotten."""
        out, young, old = [], self.young, self.old
        for word in words.to_pylist():
            if (ids := young.get(word)) is None:
                if (ids := old.get(word)) is None:
                    ids = encode(word)
                young[word] = ids
            out.append(ids)
        if len(young) > CACHE_WORDS // 2:
            self.old, self.young = young, {}
        return pa.array(out, pa.large_binary())

    def _words(self, words: pa.Array) -> pa.Array:
        if not self.by_runs:
            return self._known(words, self._whole)
        simple = pc.match_substring_regex(words, _SIMPLE)
        low = pc.utf8_lower(words.filter(simple))
        runs = pc.utf8_rtrim(low, _ASCII_MARKS)
        marks = pc.utf8_ltrim(low, _LOWER_LETTERS)
        parts = []
        for part, encode in ((runs, self._run), (marks, self._whole)):
            coded = part.dictionary_encode()
            parts.append(self._known(coded.dictionary, encode).take(coded.indices))
        near = pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.large_binary()))
        odd = self._known(words.filter(pc.invert(simple)), self._whole)
        place = np.empty(len(words), np.int64)
        is_simple = simple.to_numpy(zero_copy_only=False)
        place[is_simple], place[~is_simple] = np.arange(len(near)), len(near) + np.arange(len(odd))
        return pa.concat_arrays([near, odd]).take(pa.array(place))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's closed by the end id, and the number of ids of each text."""
        if not self.by_words:
            found = [self._whole(t) + self.end for t in texts.to_pylist()]
            return np.frombuffer(b"".join(found), np.uint32), np.array([len(x) // 4 for x in found], np.int64)
        split = pc.ascii_split_whitespace(texts)
        ends = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        each = pa.concat_arrays([self._words(coded.dictionary), pa.array([self.end], pa.large_binary())])
        at = np.insert(coded.indices.to_numpy(), ends[1:] - ends[0], len(each) - 1)
        taken = each.take(pa.array(at))
        until = np.frombuffer(taken.buffers()[1], np.int64)[: len(at) + 1]
        last = until[np.cumsum(np.diff(ends) + 1)]
        return np.frombuffer(taken.buffers()[2] or b"", np.uint32, int(until[-1]) // 4), np.diff(last, prepend=0) // 4


def _give_back() -> None:
    """Returns to the system what a task has freed: idle workers wait beside those at work."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


class Packer:
    """Packs pieces (document, start, length) into windows that are all full.

    A document longer than the top tier gives full top windows and a rest. What is at most the top
    tier is routed to the smallest tier that holds it. From the longest tier down, each piece opens
    a window of its tier; the gap is filled with whole pieces of the longest shorter tier that fits
    and last with a part cut from a shorter piece. What finds no filler is joined and cut into top
    windows; under one top window is carried to the next block. The end is cut at powers of two, so
    no window ever needs padding.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers))
        if any(t & (t - 1) for t in self.tiers):
            raise ValueError("tiers must be powers of two")
        self.queues = [deque() for _ in self.tiers]
        self.windows: list[tuple[int, list]] = []

    def _route(self, piece) -> None:
        for tier, queue in zip(self.tiers, self.queues, strict=True):
            if piece[2] <= tier:
                queue.append(piece)
                return

    def add(self, doc: int, length: int) -> None:
        top, start = self.tiers[-1], 0
        while length - start > top:
            self.windows.append((top, [(doc, start, top)]))
            start += top
        self._route((doc, start, length - start))

    def _shorter(self, below: int, gap: int):
        """A whole piece that fits the gap, else a part cut to it, from the tiers under ``below``."""
        for k in range(below - 1, -1, -1):
            if self.queues[k] and self.tiers[k] <= gap:
                return self.queues[k].popleft()
        for k in range(below):
            if self.queues[k]:
                doc, start, length = piece = self.queues[k].popleft()
                if length <= gap:
                    return piece
                self._route((doc, start + gap, length - gap))
                return doc, start, gap
        return None

    def pack(self, last: bool = False) -> None:
        rest = []
        for k in range(len(self.tiers) - 1, -1, -1):
            tier, queue = self.tiers[k], self.queues[k]
            while queue:
                window, gap = [first := queue.popleft()], tier - first[2]
                while gap and (piece := self._shorter(k if k else 1, gap)):
                    window.append(piece)
                    gap -= piece[2]
                if gap:
                    rest += window
                else:
                    self.windows.append((tier, window))
        self._join(rest, last)

    def _join(self, rest: list, last: bool) -> None:
        total, at, top = sum(p[2] for p in rest), 0, self.tiers[-1]
        sizes = [top] * (total // top)
        if last:
            sizes += [1 << b for b in range(top.bit_length() - 2, -1, -1) if total % top >> b & 1]
        rest = deque(rest)
        for size in sizes:
            window, gap = [], size
            while gap:
                doc, start, length = rest.popleft()
                if length > gap:
                    rest.appendleft((doc, start + gap, length - gap))
                    length = gap
                window.append((doc, start, length))
                gap -= length
            self.windows.append((size, window))
        for piece in rest:
            self._route(piece)

    def take(self) -> list[tuple[int, list]]:
        out, self.windows = self.windows, []
        return out

    def pending(self) -> set[int]:
        return {p[0] for q in self.queues for p in q}


def balanced(sizes: list[int], budget: int) -> list[int]:
    """A step group for each sequence: longest first, to the group with the fewest tokens so far."""
    heap = [(0, g) for g in range(max(1, -(-sum(sizes) // budget)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (load + sizes[i], g))
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, *, tiers: tuple[int, ...] = TIERS, end_id: int = 2, step_tokens: int = 32_768, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece of a document in a packed sequence.

    docs needs ``doc_id`` and ``text``; other columns are not read. Each task packs the documents of
    its own partition, block by block, so there is no shuffle and a worker holds one block. ``ids``
    are the piece's token ids as little-endian unsigned 32-bit numbers. Windows of a tier are full;
    the last few of a task have a smaller power of two as length, so nothing is padded. A sequence
    id is the task's partition number times 2**40 plus a running number; step groups are numbered
    likewise and hold about ``step_tokens`` tokens each.

    Null text counts as empty, and an empty text has its end id alone. Repeated rows are packed each
    for itself, and a null doc_id stays null. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        coder, packer = WordEncoder(tokenizer_path, end_id), Packer(tiers)
        held: dict[int, tuple] = {}
        n_docs = n_seq = n_groups = tokens = 0

        def out():
            nonlocal n_seq, n_groups
            windows = packer.take()
            groups = balanced([w[0] for w in windows], step_tokens)
            columns: list[list] = [[] for _ in range(10)]
            for (size, window), group in zip(windows, groups, strict=True):
                offset = 0
                for doc, start, length in window:
                    doc_id, ids = held[doc]
                    row = (doc_id, start, length, ids[start : start + length].tobytes(), len(ids), base + n_seq, offset, size, size, base + n_groups + group)
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
                    offset += length
                n_seq += 1
            n_groups += max(groups, default=-1) + 1
            keep = packer.pending()
            for doc in [d for d in held if d not in keep]:
                del held[doc]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            yield from pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names).to_batches(4096)

        _give_back()  # what an earlier stage has left in this worker
        for batch in batches:
            for part in blocks(batch, limit=ENCODE_BYTES):
                ids, counts = coder.encode(texts_of(part))
                at = 0
                for doc_id, n in zip(part.column(0).to_pylist(), counts.tolist(), strict=True):
                    held[n_docs] = (doc_id, ids[at : at + n])
                    packer.add(n_docs, n)
                    n_docs, at = n_docs + 1, at + n
                tokens += at
                if tokens >= block_tokens:
                    packer.pack()
                    yield from out()
                    tokens = 0
                    for doc, (doc_id, own) in held.items():
                        held[doc] = (doc_id, own.copy())
        packer.pack(last=True)
        yield from out()
        del coder, packer
        held.clear()
        _give_back()

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, SCHEMA)
