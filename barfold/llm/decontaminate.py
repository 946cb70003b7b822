"""Benchmark decontamination by edit distance: CGK embedding, bit-sampling LSH, exact verification.

A benchmark item counts as contained in a document if some run of the document's
words is within ``max_share`` of the item's length of it in word edit distance.

* Windows. Only windows as long as an item are looked at, at every word. A run
  within k edits keeps at least W - 1 - 2k of the item's W - 1 word pairs, so
  windows with fewer known pairs than that are left out without loss.
* CGK random walk. A window is written out along a walk that repeats or
  advances at each step as a random bit of (step, word) says. Two walks over similar
  windows fall into step again soon after an edit, so a small edit distance
  becomes a small Hamming distance. The first steps depend on the first words only:
  one walk serves windows of all lengths.
* LSH. Each of ``WALKS`` walks is sampled at ``BITS`` random steps, ``TABLES`` times;
  windows and items that agree in one sample are candidates.
* Parts. Walks drift apart with the number of edits, so items of more than ``PART_WORDS`` words are
  looked for by parts of about equal length. The edits of a run within the bound are
  spread over the parts, so one part at least is within its own bound. With this, and
  as every near-by start is tried too, planted runs at the full edit bound are found
  at a rate measured in the tests (0.99 or more, from 5 to 1,000 words).
* Candidates are verified by the exact edit distance of the item to the best run.

Items are small and are shipped to the tasks in blocks of bounded size; a larger
benchmark takes more passes over the documents.
"""

import re
from functools import reduce
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barfold.llm.common import map_rows

#: Share of an item's words that may be edited: a similarity of 0.8 or more.
MAX_SHARE = 0.2
#: Items with fewer words take no part: they say nothing about where a text comes from.
MIN_WORDS = 5
WALKS, TABLES, BITS = 8, 8, 3
#: Longer items are looked for by parts of at most so many words.
PART_WORDS = 40
#: Items of nearly the same length share their samples.
STEP = 4
#: Bytes of item text that one pass ships to the tasks.
BLOCK_BYTES = 4 << 20
#: Low bits of a word pair's code by which unknown pairs are sifted out first.
SIEVE = (1 << 22) - 1
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class ItemIndex:
    """The known words, word pairs and LSH samples of a block of items."""

    def __init__(self, items: list[tuple], max_share: float = MAX_SHARE, seed: int = 11):
        worded = [(key, w) for key, text in items if len(w := words_of(text)) >= MIN_WORDS]
        self.keys = [key for key, _ in worded]
        self.vocabulary: dict[str, int] = {}
        self.items = [
            np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], dtype=np.int64) for _, w in worded
        ]
        self.edits = [int(max_share * len(w)) for w in self.items]
        #: (item, first word in it, words) of what is looked for.
        self.parts = [(i, at, part) for i, w in enumerate(self.items) for at, part in _parts(w)]
        pairs = [w[:-1] * len(self.vocabulary) + w[1:] for w in self.items]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.sieve = np.zeros(SIEVE + 1, dtype=bool)
        self.sieve[self.pairs & SIEVE] = True
        lengths = sorted({len(w) for _, _, w in self.parts})
        #: For parts of nearly one length: words a run may have, and known pairs it must have.
        self.needs = {}
        for n in lengths:
            k = int(max_share * n)
            span, need = self.needs.get(n // STEP * STEP, (0, n))
            self.needs[n // STEP * STEP] = max(span, n + k), min(need, n - 1 - 2 * k)
        self.steps = 2 * max(lengths, default=0)
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(0, 1 << 63, (max(self.steps, 1), WALKS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.mix = rng.integers(0, 1 << 62, BITS, dtype=np.int64) * 2 + 1
        self.samples: dict[int, np.ndarray] = {}
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({n // STEP * STEP for n in lengths}):
            self.samples[size] = rng.integers(0, 2 * size, (WALKS, TABLES, BITS))
            own = [i for i, (_, _, w) in enumerate(self.parts) if len(w) // STEP * STEP == size]
            flat = np.concatenate([np.r_[self.parts[i][2], np.full(self.steps + 1, -2)] for i in own])
            starts = np.cumsum([0] + [len(self.parts[i][2]) + self.steps + 1 for i in own[:-1]])
            signs, real = self.signatures(self.walk(flat, starts), size)
            at = np.broadcast_to(np.array(own)[:, None, None], signs.shape)[real]
            signs = signs[real]
            order = np.argsort(signs, kind="stable")
            self.tables[size] = signs[order], at[order]

    def walk(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Words met at each step of each walk: (steps, starts, walks)."""
        at = np.repeat(starts[:, None], WALKS, axis=1)
        out = np.empty((self.steps, len(starts), WALKS), dtype=np.int64)
        for step in range(self.steps):
            out[step] = words[at]
            z = (out[step] + 5).astype(np.uint64) * self.odd[step]
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            at += (z >> np.uint64(63)).astype(np.int64)
        return out

    def signatures(self, walks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, walks, tables) sample hashes, and which of them hold known words only."""
        steps = self.samples[size]
        seen = walks[steps, :, np.arange(WALKS)[:, None, None]]
        real = (seen >= 0).all(axis=2)
        table = np.arange(WALKS * TABLES, dtype=np.int64).reshape(WALKS, TABLES, 1)
        with np.errstate(over="ignore"):
            signs = (seen * self.mix[:, None]).sum(axis=2) * 73 + table * np.int64(0x1F3D5B79A2C4E687)
        return signs.transpose(2, 0, 1), real.transpose(2, 0, 1)

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """(parts, starts) of windows that share a sample with a part of an item; ``words`` ends with steps of padding."""
        place = np.flatnonzero((words[:-1] >= 0) & (words[1:] >= 0))
        codes = words[place] * len(self.vocabulary) + words[place + 1]
        likely = self.sieve[codes & SIEVE]
        place, codes = place[likely], codes[likely]
        slot = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        place = place[self.pairs[slot] == codes]
        # Only where the least number of pairs lies in the widest window can anything start.
        widest, least = max(s for s, _ in self.needs.values()), min(n for _, n in self.needs.values())
        group = place[least - 1 :] if least > 1 else place
        dense = np.flatnonzero(group - place[: len(group)] < widest)
        none, found = np.zeros((2, 0), dtype=np.int64), []
        if not len(dense):
            return none
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edge, np.maximum(group[dense] - widest + 1, 0), 1)
        np.add.at(edge, place[dense] + 1, -1)
        some = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (words >= 0))
        total = np.zeros(len(words) + 1, dtype=np.int64)
        total[place + 1] = 1
        total = np.cumsum(total)
        last = len(total) - 1
        for begin in range(0, len(some), 2_000):
            starts = some[begin : begin + 2_000]
            fits = {
                size: total[np.minimum(starts + span, last)] - total[starts] >= need
                for size, (span, need) in self.needs.items()
            }
            any_fit = reduce(np.logical_or, fits.values())
            if not any_fit.any():
                continue
            walks, starts = self.walk(words, starts[any_fit]), starts[any_fit]
            for size, fit in fits.items():
                rows = np.flatnonzero(fit[any_fit])
                if not len(rows):
                    continue
                signs, real = self.signatures(walks[:, rows], size)
                row = np.broadcast_to(rows[:, None, None], signs.shape)[real]
                signs = signs[real]
                table, owner = self.tables[size]
                left, right = np.searchsorted(table, signs, "left"), np.searchsorted(table, signs, "right")
                each = right - left
                pick = np.repeat(np.arange(len(each)), each)
                place = left[pick] + np.arange(len(pick)) - np.repeat(np.cumsum(each) - each, each)
                found.append(np.unique(np.stack([owner[place], starts[row[pick]]]), axis=1))
        return np.unique(np.concatenate(found, axis=1), axis=1) if found else none

    def matches(self, text: str | None) -> list[tuple]:
        """(item key, edits, first word, words) of every item within its bound, at its best run."""
        found = words_of(text)
        if len(found) < MIN_WORDS or not self.items:
            return []
        known = self.vocabulary.get
        ids = np.array(list(map(known, found, repeat(-1))), dtype=np.int64)
        at: dict[int, list[int]] = {}
        padded = np.concatenate([ids, np.full(self.steps + 1, -1)])
        for part, start in self.candidates(padded).T.tolist():
            item, offset, _ = self.parts[part]
            at.setdefault(item, []).append(start - offset)
        out = []
        for item, starts in sorted(at.items()):
            size, k, best = len(self.items[item]), self.edits[item], None
            begin = prior = None
            for start in [*sorted(starts), None]:
                if begin is not None and (start is None or start > prior + size):
                    low = max(0, begin - size)
                    run = ids[low : prior + 2 * size]
                    if np.isin(self.items[item], run).sum() >= size - k:
                        edits, first, n = best_run(self.items[item], run)
                        if edits <= k and (best is None or (edits, low + first) < best[:2]):
                            best = edits, low + first, n
                    begin = None
                if start is not None:
                    begin, prior = start if begin is None else begin, start
            if best:
                out.append((self.keys[item], *best))
        return out


def _parts(words: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(first word, words) of the parts of an item."""
    n = -(-len(words) // PART_WORDS)
    ends = [len(words) * i // n for i in range(n + 1)]
    return [(a, words[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def best_run(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(edits, first word, words) of the run of ``words`` nearest to ``item``; the leftmost of the best."""
    n = len(words)
    column = np.arange(n + 1)
    cost, first = np.zeros(n + 1, dtype=np.int64), column.copy()
    diagonal, before = np.empty(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    for i, word in enumerate(item, 1):
        diagonal[0] = i
        np.add(cost[:-1], words != word, out=diagonal[1:])
        before[1:] = first[:-1]
        up = cost + 1
        new = np.minimum(diagonal, up)
        origin = np.where(diagonal <= up, before, first)
        # A word of the text that the item lacks: cost of the best earlier column plus the way from it.
        packed = (new - column) * (n + 1) + column
        source = np.minimum.accumulate(packed) % (n + 1)
        cost, first = new[source] + column - source, origin[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(first[end]), end - int(first[end])


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", max_share: float = MAX_SHARE,
) -> DataFrame:
    """``doc_id, item_id, edits, first_word, n_words``: the items that each document contains.

    One row for each document row and item, at the run with the fewest edits
    (the leftmost of equals). Words are runs of letters, digits and ``_`` in lower case.
    Null and empty texts contain nothing; items under ``MIN_WORDS`` words or with
    a null text take no part; repeated documents give repeated rows, repeated item
    ids count once with their smallest text.
    """
    known = items.where(F.col(item_text_col).isNotNull()).groupBy(F.col(item_col).alias("item_id")).agg(
        F.min(item_text_col).alias("item_text")
    )
    size = known.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    doc_kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, edits bigint, first_word bigint, n_words bigint"
    parts = []
    for block in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).sort("item_id").collect()
        parts.append(_search(docs.select(id_col, text_col), [(r.item_id, r.item_text) for r in rows], max_share, schema))
    return reduce(DataFrame.unionByName, parts)


def _search(docs: DataFrame, items: list[tuple], max_share: float, schema: str) -> DataFrame:
    made: list[ItemIndex] = []

    def search(key, text):
        if not made:
            made.append(ItemIndex(items, max_share))
        return [(key, *match) for match in made[0].matches(text)]

    return map_rows(docs, search, schema)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text contains a benchmark item; rows with a null id stay.

    Rows with one id and different texts are judged apart.
    """
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("_of")).alias("row"), "text")
    bad = contamination(keyed, items, id_col="row").select("doc_id.*").distinct()
    return docs.withColumn("_of", F.xxhash64("text")).join(bad, ["doc_id", "_of"], "left_anti").select(*docs.columns)
