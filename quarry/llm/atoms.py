"""Texts cut into atoms that tokenizers encode independently, many at once.

A cut lies before a blank that stands between two characters other than white
space, and around a line end that does. Byte-level BPE with the usual pattern
starts a token there, and so does piece BPE whose pieces hold a blank only in
front and no line end. The atoms of a block
of texts are dictionary-encoded in one call, so whatever is worked out for an
atom (its ids, its alignment) is worked out once for a block and found again
in the worker's memory; a text is then a run of numbers.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

from quarry.llm.textbytes import chunks, text_buffer

BLOCK = 2 << 20              # bytes of text in a block (a longer text is one of its own)
MEMORY = 250_000             # atoms that a worker remembers
ROWS = 1000                  # texts taken from an Arrow batch at a time
# Fixed value: the splitting pattern that byte-level BPE files of this kind imply.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PLAIN = np.ones(256, dtype=bool)                # bytes that are surely no part of white space
_PLAIN[:0x21] = False
_PLAIN[[0xC2, 0xE1, 0xE2, 0xE3]] = False         # lead bytes of wider blanks
_WIDE = np.zeros(256, dtype=bool)
_WIDE[[0xE1, 0xE2, 0xE3]] = True


def cuts(buf: np.ndarray) -> np.ndarray:
    """True at every blank with a character other than white space on both
    sides, at every line end like that and behind it. Characters that share a lead byte with a wide blank count as white
    space: a cut too few is never wrong."""
    n = len(buf)
    out = np.zeros(n, dtype=bool)
    if n < 3:
        return out
    b = np.flatnonzero((buf[1:-1] == 0x20) | (buf[1:-1] == 0x0A)) + 1
    left, right = buf[b - 1], buf[b + 1]
    wide = (left >= 0x80) & ((buf[b - 2] == 0xC2) | _WIDE[buf[np.maximum(b - 3, 0)]])
    ok = (left > 0x20) & (left != 0x7F) & ~wide & _PLAIN[right]
    out[b[ok]] = True
    out[b[ok & (buf[b] == 0x0A)] + 1] = True
    return out


class Block:
    """Some texts: ``of`` has the number of each atom in ``atoms`` (Arrow
    binary, distinct), text i owns ``of[first[i]:first[i + 1]]``. With
    ``lead`` every text begins with one more blank."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lead: bool = False):
        buf, off = buf[off[0]:off[-1]], off - off[0]
        size = np.diff(off)
        if lead:
            size = np.where(size > 0, size + 1, 0)
            to = np.concatenate([[0], np.cumsum(size)])
            wide = np.full(to[-1], 0x20, np.uint8)
            wide[np.repeat(to[1:] - off[1:], np.diff(off)) + np.arange(off[-1])] = buf
            buf, off = wide, to
        begin = cuts(buf)
        begin[off[1:-1][off[1:-1] < len(buf)]] = True                  # a text begins with an atom
        if len(buf):
            begin[0] = True
        start = np.flatnonzero(begin)
        self.first = np.searchsorted(start, off).astype(np.int64)
        ends = np.concatenate([start, [len(buf)]]).astype(np.int64)
        flat = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(buf))])
        code = flat.dictionary_encode()
        self.of, self.atoms, self.bytes = code.indices.to_numpy(), code.dictionary, np.diff(off)

    def rows(self) -> np.ndarray:
        """The text that each entry of ``of`` belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def blocks(batches, size: int = BLOCK, lead: bool = False):
    """(block, its rows) of batches with a column ``text``."""
    for batch in batches:
        for r in range(0, batch.num_rows, ROWS):
            b = batch.slice(r, ROWS)
            buf, off = text_buffer(b.column("text"))
            for i, j in chunks(off, size):
                yield Block(buf, off[i:j + 1], lead), b.slice(i, j - i)


_ASCII_WORD = re.compile(" ?[!-~]+").fullmatch


def _simple(t: str) -> bool:
    """One run without white space, after at most one blank."""
    return len(t.split()) == 1 and t.strip() == (t[1:] if t[:1] == " " else t)


def flat_ids(encode, one, end: int, texts: list[str], lines: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many of each) of atoms: the simple ones in one call on their
    lines, behind a line end each, whose id is ``end`` (what comes before the
    first is the encoder's own), the others by ``one``."""
    simple = np.fromiter([_ASCII_WORD(t) is not None or _simple(t) for t in texts], bool, len(texts))
    parts, sizes, order = [], [], []

    def lone(i):
        parts.append(np.array(one(texts[i]), np.int64))
        sizes.append([len(parts[-1])])
        order.append([i])
    at = np.flatnonzero(simple)
    for k in range(0, len(at), lines):
        some = at[k:k + lines]
        ids = np.array(encode("\n" + "\n".join([texts[i] for i in some.tolist()])), np.int64)
        ends = np.flatnonzero(ids == end)
        if len(ends) == len(some):
            keep = ids != end
            keep[:ends[0]] = False
            parts.append(ids[keep])
            sizes.append(np.diff(np.append(ends, len(ids))) - 1)
            order.append(some)
        else:
            for i in some.tolist():
                lone(i)
    for i in np.flatnonzero(~simple).tolist():
        lone(i)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, size, order = np.concatenate(parts), np.concatenate(sizes), np.concatenate(order)
    lists = Ragged(np.int64)
    lists.extend(ids, size)
    back = np.argsort(order)
    return lists.take(back), size[back]


class ByteBpe:
    """A byte-level BPE file: ids of atoms. Files whose merges stand in the
    order of their ids are run by the faster library; others, and texts with
    the string of a special token where these count, by their own."""

    def __init__(self, path: str, special: bool):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not special
        spec = json.loads(self.tok.to_str())
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [t for t in added if special]
        self.bytes = self._bytes(spec["model"]["vocab"], added)
        self.fast = self._fast(spec, added)

    @staticmethod
    def _bytes(vocab: dict[str, int], added: dict[str, int]) -> list[bytes]:
        """The bytes of every id. Printable bytes stand for themselves, the
        others, in order, for the characters from 256 on."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        out = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for t, i in vocab.items():
            out[i] = t.encode() if t in added else bytes(char[c] for c in t)
        return out

    def _fast(self, spec, added):
        pre, vocab = spec["pre_tokenizer"] or {}, spec["model"]["vocab"]
        if (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex"), spec["normalizer"]) != ("ByteLevel", False, True, None):
            return None
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if made != sorted(made):
            return None
        import tiktoken
        ranks = {self.bytes[i]: i for t, i in vocab.items() if t not in added}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def own(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encode = self.own if self.fast is None or any(s in t for s in self.strings for t in texts) else self.fast.encode_ordinary
        end = self.own("\n")
        if len(end) != 1:
            raise ValueError("a line end is no token of its own: atoms are not independent")
        return flat_ids(encode, encode, end[0], texts)


class Ragged:
    """Lists of numbers that only grow, by number."""

    def __init__(self, dtype):
        self.data, self.at, self.n = np.zeros(1024, dtype), np.zeros(1024, np.int64), 0

    def extend(self, data, size) -> None:
        """One more list for each of ``size``, their numbers in ``data``."""
        k = len(size)
        ends = self.at[self.n] + np.cumsum(size)
        need = int(ends[-1]) if k else 0
        if need > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(need, len(self.data)) - len(self.data) // 2, self.data.dtype)])
        if self.n + k + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(k + len(self.at) // 2, np.int64)])
        if k:
            self.data[self.at[self.n]:need] = data
            self.at[self.n + 1:self.n + 1 + k] = ends
        self.n += k

    def size(self, i: np.ndarray) -> np.ndarray:
        return self.at[i + 1] - self.at[i]

    def all(self) -> np.ndarray:
        return self.data[:self.at[self.n]]

    def take(self, i: np.ndarray) -> np.ndarray:
        """The lists of the numbers ``i``, one behind the other."""
        size = self.size(i)
        ends = np.cumsum(size)
        return self.data[np.repeat(self.at[i] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Known:
    """What a worker has worked out for atoms: ``work(atoms)`` adds the new
    ones; number i of ``number(block)`` stands for its atom i."""

    def __init__(self):
        self.number_of: dict[bytes, int] = {}

    def reset(self) -> None:
        raise NotImplementedError

    def work(self, atoms: list[bytes]) -> None:
        raise NotImplementedError

    def number(self, block: Block) -> np.ndarray:
        atoms = block.atoms.to_pylist()
        if len(self.number_of) + len(atoms) > MEMORY and self.number_of:
            self.number_of.clear()
            self.reset()
        new = [a for a in atoms if a not in self.number_of]
        self.work(new)
        n = len(self.number_of)
        self.number_of.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(self.number_of.__getitem__, atoms), np.int64, len(atoms))
