"""Ids from the tokenizers library, with the work for repeated words done once.

Both tokenizers cut a text into words before they look for merges, and no merge
crosses a word. So a slice of texts is cut at spaces and numbered by its distinct
chunks in Arrow, a chunk is cut where signs follow its last letter, and only the
distinct parts that a bounded memory doesn't hold go to the library. The ids of the
texts are then put together in numpy from those of the parts. Where the cut could
change a result (special strings, runs of white space, text that normalisation
could join) the library gets the whole text.

Bounds: a slice has ``SLICE_BYTES`` of text or one text; the memory holds two
generations, and one ends at ``MOST`` parts or ``CHARS`` characters. Each task has
an encoder of its own, so a worker process holds none between tasks.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import tokenizer_path

MOST = 250_000
CHARS = 8 << 20
SLICE_BYTES = 2 << 20
#: White space other than a space or a line end, and the characters that mark a text's or line's first chunk and a line end.
OTHER_SPACE = r"\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
FIRST, LINE = "\x02", "\x01"
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``chosen`` of ``values`` one after the other, and where each ends."""
    size = lengths[chosen]
    ends = np.cumsum(size)
    at = np.repeat(starts[chosen] - (ends - size), size)
    at += np.arange(len(at))
    return values[at], ends


def listed(strings: pa.Array) -> list[str]:
    """The strings, none of which has a NUL or else each is fetched by itself."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings), "\0")[0].as_py()
    out = joined.split("\0")
    return out if len(out) == len(strings) else strings.to_pylist()


def parts_of(chunks: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each chunk up to its last letter and the signs after it; a chunk that doesn't end so is a stem as a whole."""
    stems = pc.utf8_rtrim(chunks, SIGNS)
    letter = pc.utf8_is_alpha(pc.utf8_slice_codeunits(stems, -1)).to_numpy(zero_copy_only=False)
    ends = np.frombuffer(chunks.buffers()[1], dtype="<i4")[chunks.offset : chunks.offset + len(chunks) + 1]
    sizes = np.where(letter, pc.binary_length(stems).to_numpy(), np.diff(ends))
    offsets = np.empty(2 * len(chunks) + 1, dtype="<i4")
    offsets[0::2], offsets[1::2] = ends, ends[:-1] + sizes
    halves = pa.StringArray.from_buffers(2 * len(chunks), pa.py_buffer(offsets), chunks.buffers()[2])
    at = np.arange(0, 2 * len(chunks), 2)
    return halves.take(pa.array(at)), halves.take(pa.array(at + 1))


class Memory:
    """The ids of parts, one after the other in an array that grows by doubling."""

    def __init__(self) -> None:
        self.places: dict[str, int] = {}
        self.ids, self.starts = np.empty(1 << 16, dtype="<u4"), np.zeros(1 << 14, dtype=np.int64)
        self.n = 0
        self.chars = 0

    def find(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.places.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))

    def add(self, keys: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        held, n = int(self.starts[self.n]), len(keys)
        while len(self.ids) < held + len(ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while len(self.starts) <= self.n + n:
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[held : held + len(ids)] = ids
        self.starts[self.n + 1 : self.n + 1 + n] = held + ends
        self.places.update(zip(keys, range(self.n, self.n + n), strict=True))
        self.n += n
        self.chars += sum(map(len, keys))

    def ids_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gather(self.ids, self.starts[:-1], np.diff(self.starts), places)


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes; slices(array) gives them in one array a slice."""

    def __init__(self, name: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(tokenizer_path(name))
        self.lower = self.library.normalizer is not None
        special = "|".join(re.escape(str(t)) for t in self.library.get_added_tokens_decoder().values())
        odd = r"[\x02\x1c-\x1f\x{130}]" if self.lower else rf"  | \n|\n |\A | \z|\n\n\n|\n\n\z|[\x01\x02{OTHER_SPACE}]"
        self.unsafe = f"{special}|{odd}" if special else odd
        # parts are asked for in lines; the mark between them is one id that no part without the mark has
        self.mark = " | " if self.lower else "\n"
        (self.mark_id,) = self.library.encode(self.mark, add_special_tokens=False).ids
        # what is used often outlives a change of generation
        self.memory, self.old = Memory(), Memory()

    def ask(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, keys: list[str]) -> list[str]:
        """The texts that parts stand for."""
        if self.lower:
            return [k[1:] if k[:1] == FIRST else k for k in keys]
        return ["\n" if k == LINE else k[1:] if k[:1] == FIRST else " " + k for k in keys]

    def ask_parts(self, keys: list[str], a_line: int = 20) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The keys in a new order, all their ids and where each one's end."""
        words, mark = self.words(keys), self.mark.strip(" ")
        odd = [not w or mark in w or self.lower and not (w.isascii() or "Σ" not in w and unicodedata.is_normalized("NFC", w)) for w in words]
        even = [w for w, o in zip(words, odd, strict=True) if not o]
        alone = self.ask([w for w, o in zip(words, odd, strict=True) if o])
        lines = self.ask([self.mark.join([*even[i : i + a_line], ""]).rstrip(" ") for i in range(0, len(even), a_line)])
        flat = np.concatenate([np.zeros(0, "<u4"), *lines])
        marks = np.flatnonzero(flat == self.mark_id)
        ends = np.concatenate([marks - np.arange(len(marks)), np.cumsum([len(a) for a in alone], dtype=np.int64) + len(flat) - len(marks)])
        order = [k for k, o in zip(keys, odd, strict=True) if not o] + [k for k, o in zip(keys, odd, strict=True) if o]
        return order, np.concatenate([np.delete(flat, marks), *alone]), ends

    def look_up(self, keys: list[str]) -> np.ndarray:
        """The place of each part in the memory, which asks for what it lacks; keys are distinct."""
        if self.memory.n > MOST or self.memory.chars > CHARS:
            self.memory, self.old = Memory(), self.memory
        found = self.memory.find(keys)
        for source in (self.recall, self.ask_parts):
            lacking = np.flatnonzero(found < 0)
            if len(lacking):
                wanted = [keys[i] for i in lacking]
                self.memory.add(*source(wanted))
                found[lacking] = self.memory.find(wanted)
        return found

    def recall(self, keys: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """What the older generation knows of ``keys``."""
        places = self.old.find(keys)
        known = np.flatnonzero(places >= 0)
        ids, ends = self.old.ids_of(places[known])
        return [keys[i] for i in known], ids, ends

    def chunks(self, texts: pa.Array) -> pa.ListArray:
        if self.lower:
            return pc.utf8_split_whitespace(pc.ascii_lower(texts))
        marked = pc.binary_join_element_wise(pa.scalar(FIRST), pc.replace_substring(texts, "\n", f" {LINE} {FIRST}"), "")
        return pc.split_pattern(marked, " ")

    def encode_safe(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts that may be cut, by their distinct chunks and the distinct parts of these."""
        lists = self.chunks(texts)
        offsets = lists.offsets.to_numpy()
        numbered = lists.values.dictionary_encode()
        stems, rests = parts_of(numbered.dictionary)
        stems, rests = stems.dictionary_encode(), rests.dictionary_encode()
        keys = listed(stems.dictionary)
        known = set(keys)
        ends = [FIRST + r for r in rests.dictionary.to_pylist()]
        both = self.look_up(keys + [e for e in ends if e not in known])
        ends = self.memory.find(ends)
        memory, kept = self.memory, both[: len(keys)]
        chunks = np.empty(2 * len(numbered.dictionary), dtype=np.int64)
        chunks[0::2], chunks[1::2] = kept[stems.indices.to_numpy()], ends[rests.indices.to_numpy()]
        ids, ends = memory.ids_of(chunks)
        ends = ends[1::2]
        lengths = np.diff(ends, prepend=0)
        ids, ends = gather(ids, ends - lengths, lengths, numbered.indices.to_numpy())
        return ids, np.concatenate([[0], ends])[offsets[1:] - offsets[0]]

    def encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        unsafe = pc.match_substring_regex(texts, self.unsafe).to_numpy(zero_copy_only=False)
        if not unsafe.any():
            return self.encode_safe(texts)
        ids, ends = self.encode_safe(texts.filter(pa.array(~unsafe)))
        own = self.ask(texts.filter(pa.array(unsafe)).to_pylist())
        lengths, starts = np.empty(len(texts), dtype=np.int64), np.empty(len(texts), dtype=np.int64)
        lengths[~unsafe], lengths[unsafe] = np.diff(ends, prepend=0), [len(o) for o in own]
        starts[~unsafe] = ends - lengths[~unsafe]
        starts[unsafe] = len(ids) + np.cumsum(lengths[unsafe]) - lengths[unsafe]
        return gather(np.concatenate([ids, *own]), starts, lengths, np.arange(len(texts)))

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for _, ids, ends in self.slices(pa.array(texts, pa.string())):
            out += [part.tobytes() for part in np.split(ids, ends[:-1])]
        return out

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, ends) of slices of ``texts``, an Arrow array of strings without nulls."""
        held = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            before = held[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(held, before + SLICE_BYTES, side="right")))
            yield (at, *self.encode_slice(texts.slice(at, end - at)))
            at = end
