"""Byte-level BPE encoding and decoding by tree concatenation.

A text is halved down to leaves. Leaves are cut into the pieces of the vocabulary's pre-tokenizer, each for itself, and
neighbours are joined up the tree: a window of pieces around the join is cut anew, and grows until it begins where the left
side has a break that what follows can't move, and breaks off where the right side does too. From a common break on both
go on alike, as the pattern never looks back; so the joined pieces are those of the whole.

Tasks run beside each other, and within a task leaves come one after another: threads that share an interpreter spend more
on handing it over than the leaves cost.

Pieces are encoded by merges, each distinct one once, and new ones of one length together. One too long for a leaf (text
without any break) is halved in the same way, and a window of tokens around each join is encoded anew, until its first token
is the left side's and its last the right side's own. A token sequence is a BPE encoding exactly if each two neighbours are, so the joined sequence is the
encoding of the whole: tokens outside the window keep their neighbours, and those at its edges have agreed.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import unicodedata
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from .common import id_text, slices

#: The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts over this many characters, and pieces over this many bytes, go through the tree; leaves are at most as long.
LEAF = 4096
#: Pieces from the end that a text going on may change: a match looks at two characters behind it and at three at least.
UNSURE = 4
#: Encoded pieces that a worker remembers, beside those of the texts at hand: about so many bytes, of a longer text so many pieces.
REMEMBERED = 300_000
AT_ONCE, PIECES = 1 << 20, 1 << 17
#: Pieces of one length, from so many on, are merged as the rows of a matrix if they have at most so many bytes.
FEW, WIDE = 32, 64
_NEVER = 1 << 30


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_chars() -> dict[str, int]:
    """The printable stand-in for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _strangers() -> dict[int, str]:
    """Characters that the pattern's engine puts in another class than the vocabulary's library (newer scripts), each with
    a character of the right class."""
    new: list[str] = []
    of: dict[str, str] = {}
    for a in range(0, 0x110000, 0x1000):
        every = "".join(chr(c) for c in range(a, a + 0x1000) if not 0xD800 <= c < 0xE000)
        here = {c: k for k in "LN" for c in regex.findall(rf"\p{{{k}}}", every)}
        some = [c for c in every if (k := unicodedata.category(c)[0]) != here.get(c) and (k in "LN" or c in here)]
        of |= {c: here[c] for c in some if c in here}
        new += some
    library, out = pre_tokenizers.ByteLevel(add_prefix_space=False), {}
    for c in new:
        # Of a letter, a digit and a mark, the character stands with its own kind.
        ends = {b for _, (_, b) in library.pre_tokenize_str(f"x{c}x7{c}7")}
        kind = "L" if 1 not in ends and 2 not in ends else "N" if 5 not in ends and 4 not in ends else ""
        if kind != of.get(c, ""):
            out[ord(c)] = {"L": "x", "N": "7", "": "!"}[kind]
    return out


def _spelled_out(stand_in: dict[int, str]) -> re.Pattern:
    """PATTERN with its classes spelled out up to U+FFFF, strangers in their right ones: the standard engine has no such
    classes, and takes less than half the time."""
    codes = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    every = "".join(stand_in.get(c, chr(c)) for c in codes)

    def members(kind: str) -> str:
        runs: list[list[int]] = []
        for m in regex.finditer(kind, every):
            c = codes[m.start()]
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)

    s, l, n = members(r"\s"), members(r"\p{L}"), members(r"\p{N}")  # noqa: E741
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?(?:[{l}]++|[{n}]++|[^{s}{l}{n}]++)|[{s}]+(?![^{s}])|[{s}]++")


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


class Encoder:
    """Encodes and decodes as the vocabulary file's own library does, without special tokens added around a text."""

    def __init__(self, path: str, leaf: int = LEAF):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, back = spec["model"], _byte_chars()
        as_bytes = lambda t: bytes(back[c] for c in t)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {as_bytes(t): i for t, i in model["vocab"].items() if t not in self.special}
        merged = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        if [vocab[as_bytes(a + b)] for a, b in merged] != list(range(256, 256 + len(merged))):
            raise ValueError("the vocabulary's ids don't follow its merges")
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("not a plain byte-level vocabulary")
        #: What two tokens merge into; the smaller, the earlier.
        self.merges = {(vocab[as_bytes(a)], vocab[as_bytes(b)]): i for i, (a, b) in enumerate(merged, 256)}
        self.byte = [vocab[bytes([i])] for i in range(256)]
        self.size = size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for t, i in [*vocab.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.bytes_of[i] = t
        self.decimal = [b"%d," % i for i in range(size)]
        # The same for arrays: sorted keys of two tokens.
        self.byte_ids = np.array(self.byte, np.int32)
        pairs = sorted((a * size + b, i) for (a, b), i in self.merges.items())
        self.keys, self.values = np.array(pairs, np.int64).reshape(-1, 2).T.copy()
        self.values = self.values.astype(np.int32)
        self.pattern = regex.compile(PATTERN)
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.stand_in = _strangers()
        self.spelled_out = _spelled_out(self.stand_in)
        self.leaf = leaf
        #: Ids of pieces, 32 bits each.
        self.known: dict[str, bytes] = {}

    def __getstate__(self):
        raise TypeError("made where it is used")

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; of a long one, which should be alone, a run of pieces at a time."""
        parts = [self.parts(t) for t in texts]
        if len(parts) > 1 or not parts or len(parts[0]) <= PIECES:
            return self._ids(parts)
        return [np.concatenate([self._ids([parts[0][k : k + PIECES]])[0] for k in range(0, len(parts[0]), PIECES)])]

    def _ids(self, parts: list[list[str]]) -> list[np.ndarray]:
        """The ids of each list of pieces; those that none had before are merged together."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        known.update((t, _packed([i])) for t, i in self.special.items())
        new = list(set().union(*parts).difference(known))
        known.update(zip(new, self.merge_all([p.encode() for p in new]), strict=True))
        out = [np.frombuffer(b"".join(map(known.__getitem__, p)), np.int32) for p in parts]
        for p in new:
            if len(p) >= 64:
                del known[p]
        return out

    def parts(self, text: str) -> list[str]:
        """The pieces, and the special tokens between them (no piece is spelled like one: it would have been found)."""
        out: list[str] = []
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            out += self.pieces(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.pieces(text[at:]) if at else self.pieces(text)

    def cut(self, text: str) -> list[str]:
        """The pre-tokenizer's pieces in one go."""
        if text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text):
            return self.spelled_out.findall(text)
        found, at = [], 0
        for p in self.pattern.findall(text.translate(self.stand_in)):
            found.append(text[at : at + len(p)])
            at += len(p)
        return found

    def _tree(self, whole, one, join) -> list:
        """Halves down to leaves, one() of each, and join() of neighbours, level by level."""
        leaves = [whole]
        while max(map(len, leaves)) > self.leaf:
            leaves = [h for x in leaves for h in (x[: len(x) // 2], x[len(x) // 2 :])]
        row = list(map(one, leaves))
        while len(row) > 1:
            row = list(map(join, row[0::2], row[1::2]))
        return row[0]

    def pieces(self, text: str) -> list[str]:
        """The pre-tokenizer's pieces of a text of any length."""
        return self._tree(text, self.cut, self.join_pieces)

    def join_pieces(self, a: list[str], b: list[str]) -> list[str]:
        """The pieces of two cut texts put together."""
        k = 2 * UNSURE
        while True:
            begin = max(0, len(a) - k)
            head, tail = "".join(a[begin:]), b[:k]
            window = self.cut(head + "".join(tail))
            breaks, at = {len(head): 0}, len(head)
            for i, p in enumerate(tail, 1):
                at += len(p)
                breaks[at] = i
            at = 0
            for i, p in enumerate([*window, ""] if k >= len(b) else window[:-UNSURE]):
                if at in breaks:
                    return a[:begin] + window[:i] + b[breaks[at] :]
                at += len(p)
            k *= 2

    def piece(self, raw: bytes) -> list[int]:
        """Encodes one piece of the pre-tokenizer, of any length."""
        return self._tree(raw, self.merge, self.join)

    def merge_all(self, raws: list[bytes]) -> list[bytes]:
        """piece() of each, 32 bits an id. Those of one length are rows of a matrix, and a round merges one place of each row,
        the one that merge() would take; rows that have none left are done."""
        of_length: dict[int, list[int]] = defaultdict(list)
        for i, raw in enumerate(raws):
            of_length[len(raw)].append(i)
        out = [b""] * len(raws)
        for n, rows in of_length.items():
            if n > min(WIDE, self.leaf) or len(rows) < FEW:
                for i in rows:
                    out[i] = _packed(self.piece(raws[i]))
                continue
            ids = self.byte_ids[np.frombuffer(b"".join(map(raws.__getitem__, rows)), np.uint8)].reshape(-1, n)
            into, at = self.into(ids[:, :-1], ids[:, 1:]), np.array(rows)
            while True:
                done = into.min(1, initial=_NEVER) == _NEVER
                packed, width = ids[done].tobytes(), 4 * ids.shape[1]
                for k, i in enumerate(at[done].tolist()):
                    out[i] = packed[k * width : (k + 1) * width]
                if done.all():
                    break
                ids, into, at = ids[~done], into[~done], at[~done]
                ids, into = self._merge_rows(ids, into, into.argmin(1))
        return out

    def _merge_rows(self, ids: np.ndarray, into: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's tokens at its place and behind it become one; with that, what it merges into with its neighbours."""
        row = np.arange(len(ids))
        ids[row, place] = low = into[row, place]
        stay = np.ones(ids.shape, bool)
        stay[row, place + 1] = False
        ids = ids[stay].reshape(len(row), -1)
        stay = np.ones(into.shape, bool)
        stay[row, place] = False
        into = into[stay].reshape(len(row), -1)
        r = np.flatnonzero(place > 0)
        into[r, place[r] - 1] = self.into(ids[r, place[r] - 1], low[r])
        r = np.flatnonzero(place < into.shape[1])
        into[r, place[r]] = self.into(low[r], ids[r, place[r] + 1])
        return ids, into

    def into(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What tokens a and b merge into, or _NEVER."""
        if not len(self.keys):
            return np.full(a.shape, _NEVER, np.int32)
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], np.int32(_NEVER))

    def merge(self, raw: bytes) -> list[int]:
        """Merges a leaf: of all neighbours the earliest merge first, and the leftmost of its places."""
        ids, get = list(map(self.byte.__getitem__, raw)), self.merges.get
        if len(ids) > 64:
            return self._merge_long(ids)
        # What each token and the next merge into.
        into = [get(x, _NEVER) for x in zip(ids, ids[1:], strict=False)]
        while into and (low := min(into)) != _NEVER:
            i = into.index(low)
            ids[i] = low
            del ids[i + 1], into[i]
            if i:
                into[i - 1] = get((ids[i - 1], low), _NEVER)
            if i < len(into):
                into[i] = get((low, ids[i + 1]), _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same over a heap of merges and a linked list of tokens."""
        merges, n = self.merges, len(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(m, i) for i, x in enumerate(zip(ids, ids[1:], strict=False)) if (m := merges.get(x)) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or merges.get((ids[i], ids[j])) != m:
                continue
            ids[i], ids[j] = m, -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if (x := merges.get((m, ids[j]))) is not None:
                    heapq.heappush(heap, (x, i))
            h = before[i]
            if h >= 0 and (x := merges.get((ids[h], m))) is not None:
                heapq.heappush(heap, (x, h))
        return [x for x in ids if x >= 0]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of two encoded byte strings put together."""
        k = 4
        while True:
            ka, kb = min(k, len(a)), min(k, len(b))
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, a[len(a) - ka :] + b[:kb])))
            if (ka == len(a) or window[0] == a[-ka]) and (kb == len(b) or window[-1] == b[kb - 1]):
                return a[: len(a) - ka] + window + b[kb:]
            k *= 2

    def decode_bytes(self, ids: list[int]) -> bytes:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw.decode("utf-8", "replace").encode()

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode()


_READY: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary."""
    if path not in _READY:
        _READY[path] = Encoder(path)
    return _READY[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every text. A null text is encoded as the empty one; rows with a null or a
    repeated id stay rows of their own. No shuffle: a text is encoded where it is read."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for part in slices(batches, AT_ONCE):
            ids = bpe.encode_all([t or "" for t in part.column("text").to_pylist()])
            ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)))], ["doc_id", "ids"])
        bpe.known.clear()

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of rows made by encode(); null ids give a null text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for part in batches:
            texts = [None if x is None else bpe.decode(x) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """encode() and decode() of every text in one pass, with what identifies both results: doc_id, n_tokens,
    ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded text in UTF-8)."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for part in slices(batches, AT_ONCE):
            n, of_ids, of_text = [], [], []
            for ids in map(np.ndarray.tolist, bpe.encode_all([t or "" for t in part.column("text").to_pylist()])):
                n.append(len(ids))
                of_ids.append(sha(b"".join(map(bpe.decimal.__getitem__, ids))[:-1]))
                of_text.append(sha(bpe.decode_bytes(ids)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.known.clear()

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
