"""Scoring texts with a bigram model by deleted interpolation.

The probability of a token after its context mixes three maximum-likelihood estimates: of the
word pair, of the word, and an even share for each of the V + 1 words. The weights depend on how often the
context was seen (buckets of powers of two). They are learned by expectation-maximisation on held-out
counts: a part of the training texts is deleted from the counts, and the weights are
those that explain the deleted part best. The scores then use the counts of all training texts.

Every text starts after the end of another one, so the end token is the first context.

How it runs: tokens never become rows. Texts are packed into blocks of about a million tokens (local word
numbers and the words' hashes). A block sends each distinct word and word pair once, with its own
counts, to the part of the counts that the key's hash names (packed arrays, one row per block and
part); there equal keys of all blocks are summed and the sums go back to the
blocks that asked. A very frequent word is one entry per block. Words are told apart by 64-bit hashes.
"""

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barfold.llm.common import stored

#: Tokens of a block; text bytes per part of the counts.
BLOCK_TOKENS, PART_BYTES = 1_000_000, 16 << 20
#: Of the remainders of crc32(id) by ``FOLDS``: not learned from at all, and deleted from the counts while weights are learned.
FOLDS, HELD_OUT, DELETED = 5, 1, 2
#: Buckets of context frequency: unseen, then by the power of two.
BUCKETS = 40
#: Steps per octave in which estimates are binned while weights are learned, and rounds of that.
STEPS, ROUNDS = 8, 60
_END = b"\n"
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def tokens_of(text: str | None) -> list[bytes]:
    """Words, with A-Z in lower case; the end token is not among them."""
    return (text or "").encode("utf-8").lower().split()


def fold_of(key) -> int:
    return zlib.crc32(("" if key is None else str(key)).encode()) % FOLDS


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of texts: ids, tokens of each text, local word numbers (the end is 0) and hashes of the words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def close(id_type: pa.DataType, ids: list, sizes: list[int], words: _Numbers, numbers: list[np.ndarray]) -> pa.RecordBatch:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
        return pa.RecordBatch.from_arrays([
            pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(id_type)), pa.array([sizes], pa.list_(pa.int64())),
            pa.array([hashes.tobytes()], pa.binary()), pa.array([np.concatenate(numbers).tobytes()], pa.binary()),
        ], names=["block", "ids", "sizes", "words", "numbers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None
        ids, sizes, words, numbers, held = [], [], _Numbers({_END: 0}), [], 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = tokens_of(text.as_py())
                own = np.zeros(len(found) + 1, np.int32)
                own[:-1] = list(map(words.__getitem__, found))
                ids.append(key)
                sizes.append(len(own))
                numbers.append(own)
                held += len(own)
                if held >= BLOCK_TOKENS:
                    yield close(id_type, ids, sizes, words, numbers)
                    ids, sizes, words, numbers, held = [], [], _Numbers({_END: 0}), [], 0
        if ids:
            yield close(id_type, ids, sizes, words, numbers)

    return docs.select(id_col, text_col).mapInArrow(
        run, f"block string, ids array<{kind}>, sizes array<bigint>, words binary, numbers binary"
    )


def _packed(counts: np.ndarray) -> bytes:
    """A byte per count; those of 255 or more follow in full."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw[n:], np.int64)
    return counts


class Block:
    """One packed block: its tokens, contexts, folds, and distinct words and word pairs as keys."""

    def __init__(self, row: dict):
        self.ids, self.sizes = row["ids"], np.array(row["sizes"], dtype=np.int64)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.token = np.frombuffer(row["numbers"], np.int32)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.context = np.zeros_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[self.starts] = 0
        self.fold = np.repeat(np.array([fold_of(k) for k in self.ids], dtype=np.int8), self.sizes)
        codes, pair = np.unique(self.context.astype(np.int64) * len(self.words) + self.token, return_inverse=True)
        self.pair = pair.astype(np.int32)
        first, second = self.words[codes // len(self.words)], self.words[codes % len(self.words)]
        mixed = (first * _GOLD ^ (first >> np.uint64(31))) + second
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.keys = {"word": self.words, "pair": mixed ^ (mixed >> np.uint64(32))}
        self.at = {"word": self.token, "pair": self.pair}

    def counts(self, what: str) -> tuple[np.ndarray, np.ndarray]:
        """How often each key occurs in the training texts, and in the deleted ones among them."""
        at, n = self.at[what], len(self.keys[what])
        return tuple(np.bincount(at[mask], minlength=n).astype(np.int64) for mask in (self.fold != HELD_OUT, self.fold == DELETED))

    def by_part(self, what: str, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of the keys by part, and where each part begins in it."""
        part = (self.keys[what] % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        return order, np.searchsorted(part[order], np.arange(parts + 1))


_ASKED = "what string, part int, block string, keys binary, trained binary, deleted binary"
_TOLD = "what string, part int, block string, trained binary, deleted binary, n_keys bigint, n_tokens bigint"


def gather(blocks: DataFrame, parts: int) -> DataFrame:
    """Corpus counts of each block's keys, by part; rows with a null block sum up a part."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                block = Block(one)
                for what in ("word", "pair"):
                    order, ends = block.by_part(what, parts)
                    keys, counts = block.keys[what][order], [c[order] for c in block.counts(what)]
                    live = [p for p in range(parts) if ends[p] < ends[p + 1]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([what] * len(live)), pa.array(live, pa.int32()), pa.array([one["block"]] * len(live)),
                        pa.array([keys[ends[p] : ends[p + 1]].tobytes() for p in live], pa.binary()),
                        *(pa.array([_packed(c[ends[p] : ends[p + 1]]) for p in live], pa.binary()) for c in counts),
                    ], names=["what", "part", "block", "keys", "trained", "deleted"])

    def tell(asked: pa.Table) -> pa.Table:
        what, part = asked.column("what")[0].as_py(), asked.column("part")[0].as_py()
        keys = [np.frombuffer(k, np.uint64) for k in asked.column("keys").to_pylist()]
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = []
        for name in ("trained", "deleted"):
            raw = asked.column(name).to_pylist()
            own = np.concatenate([_unpacked(x, len(k)) for x, k in zip(raw, keys, strict=True)])
            sums.append(np.bincount(at, weights=own, minlength=len(found)).astype(np.int64))
        ends = np.cumsum([0, *(len(k) for k in keys)])
        n = len(keys)
        back = [[_packed(s[at[a:b]]) for a, b in zip(ends, ends[1:], strict=False)] for s in sums]
        return pa.table({
            "what": [what] * (n + 1), "part": pa.array([part] * (n + 1), pa.int32()),
            "block": pa.array([*asked.column("block").to_pylist(), None], pa.string()),
            "trained": pa.array([*back[0], None], pa.binary()), "deleted": pa.array([*back[1], None], pa.binary()),
            "n_keys": pa.array([None] * n + [int((sums[0] > 0).sum())], pa.int64()),
            "n_tokens": pa.array([None] * n + [int(sums[0].sum())], pa.int64()),
        })

    return blocks.mapInArrow(ask, _ASKED).groupBy("what", "part").applyInArrow(tell, _TOLD)


def _told(block: Block, table: pa.Table, parts: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Corpus counts per distinct key of a block: what -> (trained, deleted)."""
    rows = {(r["what"], r["part"]): r for r in table.select(["what", "part", "trained", "deleted"]).to_pylist()}
    out = {}
    for what in ("word", "pair"):
        order, ends = block.by_part(what, parts)
        both = np.zeros((2, len(order)), np.int64)
        for p in range(parts):
            if ends[p] < ends[p + 1]:
                for i, name in enumerate(("trained", "deleted")):
                    both[i, order[ends[p] : ends[p + 1]]] = _unpacked(rows[what, p][name], ends[p + 1] - ends[p])
        out[what] = both[0], both[1]
    return out


def bucket_of(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, 1 + np.log2(np.maximum(count, 1)).astype(np.int64), 0).clip(0, BUCKETS - 1)


def _binned(p: np.ndarray) -> np.ndarray:
    """Estimates in steps of an octave; 1 stands for zero."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-300)) * STEPS), 1).astype(np.int32)


def learn_weights(bins: np.ndarray, n_words: int) -> np.ndarray:
    """(BUCKETS, 3) weights of pair, word and even share, from rows (bucket, pair bin, word bin, count)."""
    value = lambda b: np.where(b > 0, 0.0, 2.0 ** (b / STEPS))
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    for bucket in range(BUCKETS):
        own = bins[bins[:, 0] == bucket]
        if bucket == 0:
            weights[bucket] = [0.0, 0.9, 0.1]
        if not len(own):
            continue
        p = np.stack([value(own[:, 1]), value(own[:, 2]), np.full(len(own), 1.0 / (n_words + 1))], axis=1)
        for _ in range(ROUNDS):
            share = p * weights[bucket]
            share *= (own[:, 3] / share.sum(axis=1))[:, None]
            # One imagined event of each kind keeps every weight above zero.
            new = share.sum(axis=0) + (weights[bucket] > 0)
            weights[bucket] = new / new.sum()
    return weights


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    Scores are log10 probabilities, ``base_score`` of the words alone with one half added to
    their counts. Null and empty texts consist of the end token. A null id counts as the empty id when
    folds are dealt; repeated rows are counted and scored as often as they occur; an
    empty table gives no rows. Without training texts both scores are those of an even share.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(8, -(-size // PART_BYTES))
    blocks = stored(pack(docs, id_col, text_col), "blocks")
    told = stored(gather(blocks, parts), "counts")
    sums = told.where("block is null and what = 'word'").agg(F.sum("n_keys"), F.sum("n_tokens")).first()
    n_words, n_tokens = sums[0] or 0, sums[1] or 0
    told = told.where("block is not null").select("block", "what", "part", "trained", "deleted")

    def estimates(block: Block, counts: dict, kept: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Context counts, pair counts over context, word counts; without the deleted texts if ``kept``."""
        word = counts["word"][0] - counts["word"][1] * kept
        pair = counts["pair"][0] - counts["pair"][1] * kept
        context = word[block.context]
        return context, pair[block.pair] / np.maximum(context, 1), word[block.token], word

    def bins_of(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = np.zeros((0, 4), np.int64)
        for one in left.to_pylist():
            block = Block(one)
            context, pair, word, _ = estimates(block, _told(block, right, parts), True)
            mine = block.fold == DELETED
            cells = np.stack([
                bucket_of(context[mine]), _binned(pair[mine]), _binned(word[mine] / max(n_tokens, 1)),
            ], axis=1)
            found, n = np.unique(cells, axis=0, return_counts=True)
            rows = np.concatenate([rows, np.concatenate([found, n[:, None]], axis=1)])
        return pa.table(dict(zip(("bucket", "pair", "word", "n"), (pa.array(c) for c in rows.T), strict=True)))

    both = lambda: blocks.groupBy("block").cogroup(told.groupBy("block"))
    bins = both().applyInArrow(bins_of, "bucket bigint, pair bigint, word bigint, n bigint")
    bins = stored(bins.groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")), "bins")
    # At most BUCKETS x (steps of an estimate) ^ 2 rows, whatever the corpus.
    weights = learn_weights(bins.toPandas().to_numpy(dtype=np.int64).reshape(-1, 4), n_words)

    def scores_of(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for one in left.to_pylist():
            block = Block(one)
            context, pair, word, _ = estimates(block, _told(block, right, parts), False)
            weight = weights[bucket_of(context)]
            p = weight[:, 0] * pair + weight[:, 1] * (word / max(n_tokens, 1)) + weight[:, 2] / (n_words + 1)
            if not n_tokens:
                p = np.full(len(p), 1.0 / (n_words + 1))
            base = np.log10((word + 0.5) / (n_tokens + 0.5 * (n_words + 1)))
            out += zip(
                block.ids, (block.fold[block.starts] == HELD_OUT).tolist(), block.sizes.tolist(),
                np.add.reduceat((word > 0).astype(np.int64), block.starts).tolist(), [n_tokens] * len(block.ids),
                np.add.reduceat(base, block.starts).tolist(), np.add.reduceat(np.log10(p), block.starts).tolist(),
                strict=True,
            )
        names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        types = (left.schema.field("ids").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})

    return both().applyInArrow(
        scores_of,
        f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )
