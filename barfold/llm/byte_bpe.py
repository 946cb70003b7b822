"""Byte-level BPE as a monoid: encoded halves are joined, never encoded again as a whole.

A text is split by the tokenizer's pattern into pieces and each piece is merged
by rank. Both steps run on halves:

* A piece's halves are joined by encoding a window of tokens around the seam
  anew. A token sequence is the BPE encoding of its bytes exactly if each two
  neighbours, encoded together, stay as they are; the window doubles until that
  holds at both of its edges, which proves that no token outside can change.
* A text's halves are joined by matching the pattern anew from the last piece of
  the left half that cannot see the seam, until a match ends where a piece of the
  right half ends. The pattern looks forward only, so everything after that
  point stays.

Decoding concatenates the bytes of halves up the same tree.
"""

import base64
import heapq
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import regex
from pyspark.sql import DataFrame

from barfold.llm.common import map_rows

#: Bytes up to which a piece is merged directly; longer ones are halved.
LEAF_BYTES = 6
#: Bytes up to which merges are remembered, and above which a heap is used.
SHORT_BYTES = 64
#: Characters of a text that are matched in one go.
LEAF_CHARS = 16_384
#: Entries of each of a worker's three memos, about 200 bytes each; one that is full is emptied.
MEMO = 150_000
#: Stands for the rank of a pair that is no token.
NONE = 1 << 62


_BEYOND_LATIN = re.compile("[^\\x00-\\u024f]")


@cache
def latin_form(pattern: str) -> str:
    """The pattern for texts below U+0250, with Unicode classes spelled out for the faster matcher of ``re``."""
    below = [chr(i) for i in range(0x250)]
    spelled = {
        r"\p{L}": "".join(c for c in below if unicodedata.category(c)[0] == "L"),
        r"\p{N}": "".join(c for c in below if unicodedata.category(c)[0] == "N"),
        r"\s": r"\t-\r \x85\xa0",
    }
    out, inside = "", False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part == r"\S":
            part = f"[^{spelled[chr(92) + 's']}]"
        elif part in spelled:
            part = spelled[part] if inside else f"[{spelled[part]}]"
        elif part in "[]":
            inside = part == "["
        out += part
    return out


class ByteBpe:
    """Encoder and decoder for one vocabulary of byte strings and ranks.

    ``pattern`` must match every character, as those of byte-level tokenizers do.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._any, self._latin = regex.compile(pattern), re.compile(latin_form(pattern))
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._merged: dict[bytes, list[int]] = {}
        self._stable: dict[tuple[int, int], bool] = {}

    def encode(self, text: str) -> "array[int]":
        """The token ids of a whole text."""
        out = array("I")
        if len(text) > LEAF_CHARS:
            for _, ids in self._text(text, 0, len(text)):
                out.extend(ids)
            return out
        memo, extend = self._pieces, out.extend
        for piece in self._split(text, 0, len(text)):
            extend(memo.get(piece) or self._learn(piece))
        return out

    def decode(self, ids) -> bytes:
        if len(ids) <= LEAF_CHARS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    # -- texts ---------------------------------------------------------------

    def _text(self, text: str, low: int, high: int) -> list[tuple[int, tuple[int, ...]]]:
        """(end, token ids) of each piece of ``text[low:high]``, matched as if the text were no longer."""
        if high - low <= LEAF_CHARS:
            return list(self._matches(text, low, high))
        seam = (low + high) // 2
        return self._join_texts(text, low, self._text(text, low, seam), seam, self._text(text, seam, high), high)

    def _matches(self, text: str, low: int, high: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        memo, end = self._pieces, low
        for piece in self._split(text, low, high):
            end += len(piece)
            yield end, memo.get(piece) or self._learn(piece)

    def _split(self, text: str, low: int, high: int) -> list[str]:
        pattern = self._any if _BEYOND_LATIN.search(text, low, high) else self._latin
        return pattern.findall(text, low, high)

    def _learn(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.piece(piece.encode("utf-8")))
        if len(piece) <= SHORT_BYTES:
            if len(self._pieces) >= MEMO:
                self._pieces.clear()
            self._pieces[piece] = ids
        return ids

    def _join_texts(self, text: str, low: int, left: list, seam: int, right: list, high: int) -> list:
        # A match sees at most one character past its end.
        keep = len(left)
        while keep and left[keep - 1][0] > seam - 2:
            keep -= 1
        start = left[keep - 1][0] if keep else low
        reach = 256
        while True:
            stop = min(high, seam + reach)
            redone: list = []
            for end, ids in self._matches(text, start, stop):
                if end > stop - 2 and stop < high:
                    break
                redone.append((end, ids))
                if end >= seam:
                    at = 0 if end == seam else bisect_left(right, end, key=lambda p: p[0]) + 1
                    if end == seam or (at <= len(right) and right[at - 1][0] == end):
                        return left[:keep] + redone + right[at:]
            if stop == high:
                return left[:keep] + redone
            reach *= 2

    # -- pieces --------------------------------------------------------------

    def piece(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        if len(raw) <= LEAF_BYTES:
            return self._merge(raw)
        half = len(raw) // 2
        return self.join(self.piece(raw[:half]), self.piece(raw[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded byte strings put together."""
        if not left or not right:
            return left + right
        a = b = 1
        while True:
            window = self._merge(b"".join(map(self.bytes_of.__getitem__, left[-a:] + right[:b])))
            left_done = a == len(left) or self._stays(left[-a - 1], window[0])
            right_done = b == len(right) or self._stays(window[-1], right[b])
            if left_done and right_done:
                return left[: len(left) - a] + window + right[b:]
            if not left_done:
                a = min(len(left), 2 * a)
            if not right_done:
                b = min(len(right), 2 * b)

    def _stays(self, first: int, second: int) -> bool:
        known = self._stable.get((first, second))
        if known is None:
            known = self._merge(self.bytes_of[first] + self.bytes_of[second]) == [first, second]
            if len(self._stable) >= MEMO:
                self._stable.clear()
            self._stable[first, second] = known
        return known

    def _merge(self, raw: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        if len(raw) > SHORT_BYTES:
            return self._merge_long(raw)
        known = self._merged.get(raw)
        if known is None:
            if len(self._merged) >= MEMO:
                self._merged.clear()
            known = self._merged[raw] = self._merge_short(raw)
        return known

    def _merge_short(self, raw: bytes) -> list[int]:
        rank = self.ranks.get
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pairs = [rank(raw[i : i + 2], NONE) for i in range(len(raw) - 1)]
        while pairs and (best := min(pairs)) < NONE:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], NONE)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], NONE)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same by a heap of (rank, place) for windows that grew long."""
        ranks, n = self.ranks, len(raw)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (rank := ranks.get(raw[i : end[j]])) is not None:
                heapq.heappush(heap, (rank, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != j or not alive[j] or end[j] != stop:
                continue
            end[i], alive[j] = stop, False
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out


@cache
def load(path: str, pattern: str) -> ByteBpe:
    """One encoder per worker process; ``path`` is a rank file present on every worker."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return ByteBpe({base64.b64decode(p[0]): int(p[1]) for p in pairs if p}, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids``: the token ids of every whole text.

    ``ids`` is binary, little-endian unsigned 32-bit integers. One output row per
    input row, repeats included; a null text counts as empty (0 tokens, empty
    ids). No shuffle: each text is encoded where it is read. Other columns of
    ``docs`` are not read.
    """
    def one(key, text):
        ids = load(path, pattern).encode(text or "")
        return [(key, len(ids), ids.tobytes())]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), one, f"`{id_col}` {kind}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_tokens, ids, decoded``: the bytes that the ids stand for (null ids: empty)."""
    def one(key, n, ids):
        raw = array("I")
        raw.frombytes(ids or b"")
        return [(key, n, ids, load(path, pattern).decode(raw))]

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_rows(
        encoded.select(id_col, "n_tokens", "ids"), one,
        f"`{id_col}` {kind}, n_tokens bigint, ids binary, decoded binary",
    )


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one pass: each task has one Python worker with one vocabulary, not one for each way."""
    def one(key, text):
        codec = load(path, pattern)
        ids = codec.encode(text or "")
        return [(key, len(ids), ids.tobytes(), codec.decode(ids))]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), one, f"`{id_col}` {kind}, n_tokens bigint, ids binary, decoded binary")
