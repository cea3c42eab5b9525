"""Token ids of whole texts by a byte-level BPE file, with reuse of chunks.

A byte-level pre-tokenizer always ends a token before a space that is
followed by a non-space, so a text is the concatenation of its chunks cut
there.  Chunks seen before are looked up; the new chunks of a batch are
encoded together.  Plain Latin chunks go through the faster BPE library with
the same vocabulary (checked when the file is loaded), all others through the
tokenizer file's own library.  With ``added`` the tokenizer is used as it is
loaded, so the text of an added token is that token: rows that hold such text
go to the library whole.  Without it such text is text like any other.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .common import BYTE_KEYS, mix64, powers, process_cache, text_slices

SLICE = 1 << 20  # bytes of text encoded together
KEPT = 300_000  # chunks whose ids a worker keeps; others are encoded once per slice
_B = np.arange(256)
#: bytes of plain Latin text: printable ASCII, and letters from U+00C0 to U+024F in UTF-8
_PLAIN_START = ((_B >= 33) & (_B <= 126)) | ((_B >= 0xC3) & (_B <= 0xC9))
_PLAIN = _PLAIN_START | ((_B >= 0x80) & (_B <= 0xBF))
#: the public pre-tokenizer pattern of byte-level BPE
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _fast(path: str, model):
    """The same vocabulary in the other library, or None if it differs."""
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))  # noqa: SIM115 - a library file beside the code on every host
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {x["content"] for x in spec.get("added_tokens", [])}
    try:
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        fast = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        probe = "It's 'll go: thinéßñ 12,345!! &&& *** token_x\n www.a-b.example\n Zeitungen | AbCdEf%%%\n 0f3a9c7e"
        return fast if fast.encode_ordinary(probe) == model.encode(probe, add_special_tokens=False).ids else None
    except (KeyError, ValueError):
        return None


def _load(path: str, added: bool):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = not added
    return model, _fast(path, model)


class Encoder:
    """Ids of the texts of a slice.  Chunks are compared by a 64-bit hash."""

    def __init__(self, path: str, added: bool = False):
        self.model, self.fast = _load(path, added)
        tokens = self.model.get_added_tokens_decoder().values()
        self.added = [t.content.encode() for t in tokens if added or not t.special]
        self.tab = np.uint32(self.model.encode("\t", add_special_tokens=False).ids[0])
        self.known = np.zeros(0, np.uint64)
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def chunks(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the chunks, and whether each is plain."""
        start = np.zeros(len(data) + 1, dtype=bool)
        cut = (data[:-1] == 32) & _PLAIN_START[data[1:]]
        start[: len(data) - 1] = cut
        start[offs[1:] - 1] = False  # the space ends a text
        plain = _PLAIN[data]
        plain[:-1] |= cut
        line = np.flatnonzero(data[1:-1] == 10) + 1
        line = line[_PLAIN[data[line - 1]] & _PLAIN_START[data[line + 1]]]
        plain[line] = True
        start[offs] = True
        plain[offs[1:-1]] &= data[offs[1:-1]] != 32
        plain[offs[1:-1]] &= data[offs[1:-1]] != 10
        plain[offs[1:] - 1] &= (data[offs[1:] - 1] != 32) & (data[offs[1:] - 1] != 10)
        start[len(data)] = False
        at = np.flatnonzero(start)
        odd = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(~plain, out=odd[1:])
        ends = np.append(at[1:], len(data))
        return at, odd[ends] == odd[at]

    def encode_new(self, data: np.ndarray, at: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given chunks one after another, and where each ends."""
        raw = data.tobytes()
        own = np.flatnonzero(plain) if self.fast else np.zeros(0, np.int64)
        parts: list = [None] * len(at)
        if len(own):
            joined = b"\t".join([raw[a:e] for a, e in zip(at[own].tolist(), ends[own].tolist(), strict=True)])
            ids = self.fast.encode_to_numpy(joined.decode(), disallowed_special=())
            tabs = np.flatnonzero(ids == self.tab)
            if len(tabs) != len(own) - 1:
                raise ValueError("chunks and tabs differ")
            if len(own) == len(at):
                return np.delete(ids, tabs), np.append(tabs - np.arange(len(tabs)), len(ids) - len(tabs))
            for c, piece in zip(own.tolist(), np.split(ids, tabs), strict=True):
                parts[c] = piece[1:]
            parts[own[0]] = ids[: tabs[0]] if len(tabs) else ids
        for c, done in enumerate(parts):
            if done is None:
                text = raw[at[c] : ends[c]].decode("utf-8", "surrogatepass")
                parts[c] = np.array(self.model.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.concatenate(parts).astype(np.uint32), np.cumsum([len(x) for x in parts])

    def rows_with_added(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """True for the rows that hold the text of an added token."""
        held, raw = np.zeros(len(offs) - 1, dtype=bool), data.tobytes() if self.added else b""
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offs, at, side="right")) - 1
                inside = at + len(token) <= offs[row + 1]
                held[row] |= inside
                at = raw.find(token, int(offs[row + 1]) if inside else at + 1)
        return held

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice, and the rows' offsets in them."""
        held = self.rows_with_added(data, offs)
        if not held.any():
            return self.encode_chunks(data, offs)
        size = np.diff(offs)
        others = np.where(held, 0, size)
        ids, at = self.encode_chunks(data[np.repeat(~held, size)], np.append(0, np.cumsum(others)))
        n, whole = np.diff(at), []
        for row in np.flatnonzero(held).tolist():
            text = data[offs[row] : offs[row + 1]].tobytes().decode("utf-8", "surrogatepass")
            whole.append(np.array(self.model.encode(text, add_special_tokens=False).ids, dtype=np.uint32))
            n[row] = len(whole[-1])
        own = np.repeat(held, n)
        out = np.empty(len(own), dtype=np.uint32)
        out[own], out[~own] = np.concatenate(whole), ids
        return out, np.append(0, np.cumsum(n))

    def encode_chunks(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for rows without added tokens, by chunks."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        full = np.append(np.flatnonzero(np.diff(offs)), len(offs) - 1)  # rows that have text
        at, plain = self.chunks(data, offs[full])
        ends = np.append(at[1:], len(data))
        p, q = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(BYTE_KEYS[data] * p[: len(data)], out=total[1:])
        h = mix64((total[ends] - total[at]) * q[at] + (ends - at).astype(np.uint64))
        h, first, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        place = np.searchsorted(self.known, h)
        old = np.zeros(len(h), dtype=bool)
        if len(self.known):
            old = self.known[np.minimum(place, len(self.known) - 1)] == h
        new = np.flatnonzero(~old)
        ids, new_ends = self.encode_new(data, at[first[new]], ends[first[new]], plain[first[new]]) if len(new) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        all_ids = np.concatenate([self.ids, ids])
        old_starts, new_starts = np.append(0, self.ends[:-1])[: len(self.ends)], np.append(0, new_ends[:-1])[: len(new_ends)]
        begin, size = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        begin[old], size[old] = old_starts[place[old]], (self.ends - old_starts)[place[old]]
        begin[new], size[new] = new_starts + len(self.ids), new_ends - new_starts
        each = size[back]
        done = np.cumsum(each)
        out = all_ids[np.repeat(begin[back] - (done - each), each) + np.arange(done[-1])]
        rows = np.append(0, done)[np.searchsorted(at, offs)]
        if len(self.known) < KEPT:
            again = n[new] > 1
            keep_h = np.concatenate([self.known, h[new][again]])
            keep_b = np.concatenate([old_starts, begin[new][again]])
            keep_n = np.concatenate([self.ends - old_starts, size[new][again]])
            order = np.argsort(keep_h)
            self.known, keep_b, keep_n = keep_h[order], keep_b[order], keep_n[order]
            self.ends = np.cumsum(keep_n)
            self.ids = all_ids[np.repeat(keep_b - (self.ends - keep_n), keep_n) + np.arange(self.ends[-1] if len(self.ends) else 0)]
        return out, rows


def encode_column(column, path: str, added: bool = False):
    """Yield (first row, last row, ids, offsets of the rows in ids) over an
    Arrow string column, null as empty."""
    kept, key = process_cache("encoders"), (path, added)
    if key not in kept:
        kept[key] = Encoder(path, added)
    for i, j, data, offs in text_slices(column, SLICE):
        yield i, j, *kept[key].encode(data, offs)
