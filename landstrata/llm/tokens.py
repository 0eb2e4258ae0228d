"""Token ids of whole texts by the tokenizers library."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The pre-tokenizer of byte-level BPE never joins what stands before and after a single space, or a single newline, between
# two non-space characters, so each "space and word" and "newline and word" has the same ids wherever it stands.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_SPACE = re.compile(r"\s")
#: Pieces remembered per Python worker, and ids for each of them on average: about 250 MB at most.
REMEMBERED, MEAN_IDS = 1_200_000, 8


def _strings(texts: pa.Array) -> list[str]:
    """What ``to_pylist`` gives for texts without nulls, in a tenth of the time."""
    return texts.to_numpy(zero_copy_only=False).tolist()


class _Lists:
    """Lists of ids end to end, each known by its number."""

    def __init__(self):
        self.ids, self.starts, self.sizes = np.empty(1 << 16, np.uint32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32)
        self.n = self.used = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Add lists; gives the number of the first one."""
        first, n, used = self.n, self.n + len(sizes), self.used + len(ids)
        if used > len(self.ids):
            self.ids = np.resize(self.ids, max(used, 2 * len(self.ids)))
        if n > len(self.starts):
            room = max(n, 2 * len(self.starts))
            self.starts, self.sizes = np.resize(self.starts, room), np.resize(self.sizes, room)
        self.ids[self.used:used], self.sizes[first:n] = ids, sizes
        self.starts[first:n] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = n, used
        return first

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the lists one after another, and where each ends."""
        sizes = self.sizes[numbers].astype(np.int64)
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[numbers] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.ids[at], ends


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes. The library encodes each distinct piece of the texts once.

    Texts are cut before each single space and each newline. A piece is kept without its space but with its newline, so a
    piece that begins with a newline stands for itself and any other for a space and itself. Arrow finds the distinct pieces
    of many texts; only these are looked up one by one.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their names inside a text are ordinary text
        self.remembered = remembered
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.lists = _Lists()
        self.later: dict[str, int] = {}  # pieces as they stand inside a text
        self.apart: dict[str, int] = {}  # without a space before them

    def _library(self, texts: list[str]) -> int:
        """Ids of texts, as lists; gives the number of the first one."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return self.lists.add(np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int32, len(ids)))

    def _lines(self, words: list[str], lead: str) -> int:
        """The same for words without white space, each after ``lead`` (a space or a newline).

        They go to the library as lines: a newline is a pre-token of its own between them.
        """
        text = "\n".join(words) if lead == "\n" else " " + "\n ".join(words)
        ids = np.array(self.tokenizer.encode_batch_fast(["\n" + text + "\n"], add_special_tokens=False)[0].ids, np.uint32)
        breaks = np.flatnonzero(ids == self.newline[0])
        if len(self.newline) != 1 or len(breaks) != len(words) + 1:
            raise ValueError("the tokenizer joins pieces over newlines")
        if lead == "\n":
            return self.lists.add(ids[:-1], np.diff(breaks))
        return self.lists.add(ids[ids != self.newline[0]], np.diff(breaks) - 1)

    def _learn_apart(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.apart]
        if new:
            first = self._library(new)
            self.apart.update(zip(new, range(first, first + len(new))))

    def _learn_stems(self, stems: list[str]) -> None:
        spaced, broken, rest = [], [], []
        for s in stems:
            if s[:1] == "\n" and len(s) > 1 and not _SPACE.search(s, 1):
                broken.append(s)
            else:
                (rest if not s or _SPACE.search(s) else spaced).append(s)
        for words, lead in ((spaced, " "), (broken, "\n")):
            for a in range(0, len(words), 4096):
                part = words[a:a + 4096]
                first = self._lines([w[1:] for w in part] if lead == "\n" else part, lead)
                self.later.update(zip(part, range(first, first + len(part))))
        if rest:
            first = self._library([s if s[:1] == "\n" else " " + s for s in rest])
            self.later.update(zip(rest, range(first, first + len(rest))))

    def _learn(self, new: list[str]) -> None:
        """Note the ids of pieces that are not known.

        A run of punctuation at the end of a piece, after a letter or digit, is a pre-token of its own, so what
        stands before it is looked up alone: "word," and "word." cost one encoding.
        """
        words = pa.array(new, pa.string())
        stems = pc.utf8_rtrim(words, characters=punctuation)
        stems = pc.if_else(pc.utf8_is_alnum(pc.utf8_slice_codeunits(stems, -1)), stems, words)
        self._learn_stems([s for s in _strings(pc.unique(stems)) if s not in self.later])
        ended = pc.not_equal(pc.binary_length(stems), pc.binary_length(words))
        words, stems = _strings(words.filter(ended)), _strings(stems.filter(ended))
        if not words:
            return
        tails = [w[len(s):] for w, s in zip(words, stems)]
        self._learn_apart(tails)
        both = np.empty(2 * len(words), np.int64)
        both[::2] = [self.later[s] for s in stems]
        both[1::2] = [self.apart[t] for t in tails]
        ids, ends = self.lists.joined(both)
        first = self.lists.add(ids, np.diff(ends[1::2], prepend=0))
        self.later.update(zip(words, range(first, first + len(words))))

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """Numbers of pieces, which may be new."""
        get = self.later.get
        found = [get(w, -1) for w in pieces]
        new = [w for w, n in zip(pieces, found) if n < 0]
        if new:
            self._learn(list(dict.fromkeys(new)))
            found = [self.later[w] for w in pieces]
        return np.array(found, np.int64)

    def _wide(self, text: str) -> np.ndarray:
        """Numbers of the pieces of a text with wider white space. A piece may hold white space here."""
        head, *rest = [p[1:] if i else p for i, p in enumerate(_CUT.split(text))]
        # Such pieces stand apart, as they never begin with a newline that was put before a cut.
        self._learn_apart([head, *(" " + p for p in rest)])
        return np.array([self.apart[head], *(self.apart[" " + p] for p in rest)], np.int64)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text ends."""
        if len(self.later) + len(self.apart) > self.remembered or self.lists.used > MEAN_IDS * self.remembered:
            self._forget()
        texts = pc.fill_null(texts, "")
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        heads, counts = offsets[:-1], np.diff(offsets)
        kinds = cut.flatten().dictionary_encode()
        which, pieces = kinds.indices.to_numpy(), _strings(kinds.dictionary)
        # A piece that is empty, or has white space at an end, stands by white space wider than one space or newline.
        known = self.later
        odd = np.array([w not in known and (not w or w[-1].isspace() or (w[0].isspace() and (w[0] != "\n" or w[1].isspace()))) for w in pieces], bool)
        wide = odd[which]
        first = [pieces[i] for i in which[heads]]
        wide[heads] = [w[-1:].isspace() for w in first]
        wide = np.add.reduceat(wide, heads, dtype=np.int64) > 0
        inside = np.ones(len(which), bool)
        inside[heads] = False
        inside &= ~np.repeat(wide, counts)
        used = np.zeros(len(pieces), bool)
        used[which[inside]] = True
        at = np.flatnonzero(used)
        number = np.zeros(len(pieces), np.int64)
        number[at] = self._numbers([pieces[i] for i in at.tolist()])
        numbers = number[which]
        plain = np.flatnonzero(~wide).tolist()
        self._learn_apart([first[i] for i in plain])
        numbers[heads[plain]] = [self.apart[first[i]] for i in plain]
        if wide.any():
            parts = np.split(numbers, heads[1:])
            for i in np.flatnonzero(wide).tolist():
                parts[i] = self._wide(texts[i].as_py())
            numbers, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        ids, ends = self.lists.joined(numbers)
        return ids, ends[np.cumsum(counts) - 1]

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """One value per text; a null text has no ids."""
        if not len(texts):
            return []
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        ids, ends = self._encode(texts)
        data, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def encoder(path: str, remembered: int) -> Encoder:
    """The encoder of this Python worker."""
    return Encoder(path, remembered)


def encoded(batches, path: str, columns: list[str], remembered: int = REMEMBERED, chars: int = 1 << 22):
    """Over Arrow batches with a ``text`` column: yields (rows of ``columns`` as lists, ids), about ``chars`` bytes at a time."""
    enc = encoder(path, remembered)
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + chars, "right")))
            part = batch.slice(at, end - at)
            yield [part.column(c).to_pylist() for c in columns], enc.encode(part.column("text"))
            at = end
