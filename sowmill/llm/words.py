"""Token ids of texts by a memo of their words."""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sowmill.llm.common import WORKER_CACHES

#: Texts that must be encoded whole: white space other than a blank or a line feed, two of these in a row, or the byte that marks cuts.
_ODD = r"[\x00\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]| $"
#: New parts that are encoded at a time.
STEP = 20_000
#: Bytes of texts that are encoded whole at a time, but for a longer text.
WHOLE_BYTES = 1 << 18
#: A full stop or comma that may join what stands before it.
_JOINED = r"[^\pL\pN][.,]"


def byte_level_bytes(token: str) -> bytes:
    """Bytes of a byte-level token: printable Latin-1 letters are themselves, the other bytes follow from 256 on in their order."""
    return bytes(_BYTE_OF[c] for c in token)


_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _PLAIN} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


def cut_texts(texts: pa.Array, finer: bool = False) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Cuts texts before each blank: rows that may be cut, their parts as places in the list of distinct parts, that list, and parts of each row.

    ``finer`` also cuts before line feeds, and before full stops and commas of
    texts in which each follows a letter or digit. A tokenizer that takes runs
    of letters, of digits, of signs and of white space apart never joins across
    these cuts.
    """
    rows = np.flatnonzero(~pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False))
    marked = pc.replace_substring(texts.take(pa.array(rows)), " ", "\0 ")
    if finer:
        joined = pc.match_substring_regex(marked, _JOINED)
        marked = pc.replace_substring(marked, "\n", "\0\n")
        marked = pc.if_else(joined, marked, pc.replace_substring(pc.replace_substring(marked, ".", "\0."), ",", "\0,"))
    parts = pc.split_pattern(marked, "\0")
    flat = parts.flatten().dictionary_encode()
    return rows, flat.indices.to_numpy(), flat.dictionary.to_pylist(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)


class Ragged:
    """A growing list of number lists, in two arrays."""

    def __init__(self, dtype):
        self.values, self.ends, self.rows = np.zeros(1 << 16, dtype=dtype), np.zeros(1 << 12, dtype=np.int64), 0

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        base = int(self.ends[self.rows - 1]) if self.rows else 0
        while base + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while self.rows + len(lengths) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.values[base:base + len(values)] = values
        self.ends[self.rows:self.rows + len(lengths)] = base + np.cumsum(lengths)
        self.rows += len(lengths)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the rows, one after the other, and how many each has."""
        ends = self.ends[rows]
        lengths = ends - np.where(rows > 0, self.ends[rows - 1], 0)
        stops = np.cumsum(lengths)
        return self.values[np.repeat(ends - stops, lengths) + np.arange(stops[-1] if len(stops) else 0)], lengths


class Memo:
    """Remembers for up to ``most`` parts what ``learn`` says of them: for each column the values of all parts, and how many each has.

    ``whole`` says the same of texts that must not be cut.
    """

    def __init__(self, learn: Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]], whole: Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]],
                 dtypes: list, most: int, finer: bool = False):
        self.learn, self.whole, self.most, self.finer = learn, whole, most, finer
        self.code: dict[str, int] = {}
        self.columns = [Ragged(d) for d in dtypes]

    def rows(self, parts: list[str]) -> np.ndarray:
        """Rows of distinct parts; those of parts beyond ``most`` hold until the next call."""
        known = len(self.code)
        if known > self.most:
            for part in list(self.code)[self.most:]:
                del self.code[part]
            known = self.most
            for c in self.columns:
                c.rows = known
        places = np.fromiter(map(self.code.get, parts, repeat(-1)), dtype=np.int64, count=len(parts))
        unknown = np.flatnonzero(places < 0)
        new = [parts[i] for i in unknown.tolist()]
        for at in range(0, len(new), STEP):
            some = new[at:at + STEP]
            for column, (values, lengths) in zip(self.columns, self.learn(some), strict=True):
                column.add(values, lengths)
            self.code.update(zip(some, range(known + at, known + at + len(some)), strict=True))
        places[unknown] = np.arange(known, known + len(new))
        return places

    def of_texts(self, texts: pa.Array) -> list[list[np.ndarray]]:
        """For each column the values of every text; the parts of a text are put together, a text that must not be cut is encoded whole."""
        rows, place, parts, counts = cut_texts(texts, self.finer)
        out: list[list] = [[None] * len(texts) for _ in self.columns]
        if len(rows):
            own = self.rows(parts)[place]
            ends = np.cumsum(counts)
            for column, found in zip(self.columns, out, strict=True):
                values, lengths = column.take(own)
                stops = np.cumsum(lengths)[ends - 1]
                for row, start, stop in zip(rows.tolist(), np.append(0, stops[:-1]).tolist(), stops.tolist(), strict=True):
                    found[row] = values[start:stop]
        rest = np.setdiff1d(np.arange(len(texts)), rows, assume_unique=True)
        # A tokenizer keeps some 100 bytes a token while it encodes, so whole texts go in small groups.
        sizes = pc.binary_length(texts.take(pa.array(rest))).fill_null(0).to_numpy(zero_copy_only=False)
        groups = np.split(rest, np.flatnonzero(np.diff(np.cumsum(sizes) // WHOLE_BYTES)) + 1) if len(rest) else []
        for group in groups:
            for (values, lengths), found in zip(self.whole(texts.take(pa.array(group)).to_pylist()), out, strict=True):
                stops = np.cumsum(lengths)
                for row, start, stop in zip(group.tolist(), (stops - lengths).tolist(), stops.tolist(), strict=True):
                    found[row] = values[start:stop]
        return out


def flat_ids(encoded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
    return np.fromiter(chain.from_iterable(encoded), dtype=np.int32, count=int(lengths.sum())), lengths


def as_list(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of number arrays."""
    lengths = np.fromiter(map(len, arrays), dtype=np.int64, count=len(arrays))
    values = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(values, kind))


def ids_of_parts(tokenizer, size: np.ndarray, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of parts by a byte-level tokenizer, and how many each has; ``size`` has the bytes of each id.

    Parts that start with a blank are encoded as one text, and cut by the bytes
    of its tokens.
    """
    blank = np.fromiter((p[:1] == " " for p in parts), dtype=bool, count=len(parts))
    line, rest = [p for p, b in zip(parts, blank.tolist(), strict=True) if b], [p for p, b in zip(parts, blank.tolist(), strict=True) if not b]
    others, other_counts = flat_ids([e.ids for e in tokenizer.encode_batch_fast(rest, add_special_tokens=False)])
    ids = np.array(tokenizer.encode_batch_fast(["".join(line)], add_special_tokens=False)[0].ids, dtype=np.int32)
    ends, cuts = np.cumsum(size[ids]), np.cumsum(np.fromiter((len(p.encode()) for p in line), dtype=np.int64, count=len(line)))
    stops = np.searchsorted(ends, cuts, side="right")
    if not np.array_equal(ends[stops - 1], cuts):
        return flat_ids([e.ids for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)])
    counts = np.zeros(len(parts), dtype=np.int64)
    counts[blank], counts[~blank] = np.diff(stops, prepend=0), other_counts
    flat, of_blank = np.zeros(counts.sum(), dtype=np.int32), np.repeat(blank, counts)
    flat[of_blank], flat[~of_blank] = ids, others
    return flat, counts


#: Words a worker remembers at most, with their ids. Others are encoded again in each batch, to the same ids.
MEMO_WORDS = 400_000

_MEMOS: dict[tuple[str, int], Memo] = {}
WORKER_CACHES[__name__] = _MEMOS


def byte_memo(path: str, most: int = MEMO_WORDS) -> Memo:
    """Ids of texts by a byte-level tokenizer; a special token's string in a text is that token."""
    if (path, most) not in _MEMOS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        specials = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
        if any(" " in s for s in specials.values()):
            raise ValueError("a special token with a blank inside cannot be found by parts")
        names = [specials.get(i) or tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
        size = np.array([len(n.encode()) if i in specials else len(byte_level_bytes(n)) for i, n in enumerate(names)])

        def whole(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
            return [flat_ids([e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])]

        _MEMOS[path, most] = Memo(lambda parts: [ids_of_parts(tokenizer, size, parts)], whole, [np.int32], most, finer=True)
    return _MEMOS[path, most]
