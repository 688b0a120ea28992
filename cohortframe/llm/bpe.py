"""Token counts by rank-synchronous byte-pair merging of ragged numpy arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.plans.ship import ship

#: The pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_NONE = np.int64(1 << 60)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves; the others take the letters from 256 on, in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return [chr(b if b in set(printable) else 256 + others.index(b)) for b in range(256)]


class Merger:
    """Counts the symbols that survive the merges of a byte-level BPE vocabulary."""

    def __init__(self, vocabulary: str) -> None:
        """``vocabulary``: the content of a tokenizers .json file with a byte-level BPE model."""
        spec = json.loads(vocabulary)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.first = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order, made
        # the first rank that uses a merge's result: a merge may act on all its places at once if that comes after it
        use = np.full(self.size, len(pairs), np.int64)
        np.minimum.at(use, left, np.arange(len(pairs)))
        np.minimum.at(use, right, np.arange(len(pairs)))
        self.use = use[made]
        self.safe = self.use > np.arange(len(pairs))
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.seen: dict[str, int] = {}
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == key, self.rank[at], _NONE)

    def count(self, words: list[bytes]) -> np.ndarray:
        """How many symbols are left of each word when no pair can be merged.

        Each round merges in every word the pairs of its lowest rank, and beside them those of higher ranks that no merge of this
        round can forestall: up to the rank below the least one that any present pair's result could give rise to.
        Of overlapping pairs the lower rank goes first, so the others wait.
        """
        length = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int64)
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), length)
        while len(sym):
            rank = np.full(len(sym), _NONE)
            same = word[1:] == word[:-1]
            at = np.flatnonzero(same)
            rank[at] = self.ranks(sym[at], sym[at + 1])
            start = np.flatnonzero(np.concatenate(([True], ~same)))
            n = np.diff(np.append(start, len(sym)))
            low = np.minimum.reduceat(rank, start)
            some = rank != _NONE
            later = np.full(len(sym), _NONE)
            later[some] = np.maximum(rank[some], self.use[rank[some]])
            top = np.maximum(low, np.minimum.reduceat(later, start) - 1)
            done = low == _NONE
            out[word[start[done]]] = n[done]
            live = np.repeat(~done, n)
            p = np.flatnonzero(live & (rank <= np.repeat(top, n)) & some)
            if not len(p):
                break
            r = rank[p]
            # runs of one rank at places that follow one another: of these every second one from the left
            joined = np.concatenate(([False], (p[1:] == p[:-1] + 1) & (word[p[1:]] == word[p[:-1]])))
            begins = ~joined | np.concatenate(([True], r[1:] != r[:-1]))
            run = np.cumsum(begins) - 1
            first = np.flatnonzero(begins)
            last = np.append(first[1:] - 1, len(p) - 1)
            # a run waits if a lower rank overlaps it on the left; on the right only its last place does
            waits = joined[first] & (r[np.maximum(first - 1, 0)] < r[first])
            after = np.minimum(last + 1, len(p) - 1)
            cut = (last + 1 < len(p)) & joined[after] & (r[after] < r[last])
            go = ((np.arange(len(p)) - first[run]) % 2 == 0) & ~waits[run]
            go[last[cut]] = False
            # of the lowest rank, where its result ranks before it, the leftmost place only
            unsafe = ~self.safe[r] & go
            if unsafe.any():
                here = np.flatnonzero(unsafe)
                again = np.concatenate(([False], word[p[here[1:]]] == word[p[here[:-1]]]))
                go[here[again]] = False
            p = p[go]
            sym[p] = self.made[rank[p]]
            live[p + 1] = False
            sym, word = sym[live], word[live]
        return out

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text, and how many special tokens stand in it."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.find(text), 0
        parts = self.cut.split(text)
        return list(chain.from_iterable(map(self.find, parts))), len(parts) - 1

    def texts(self, texts: list[str], keep: int = 400_000) -> list[int]:
        """Token counts of texts.  Pre-tokens are merged once and remembered, up to ``keep`` of them."""
        if len(self.seen) > keep:
            self.seen.clear()
        split = [self.pieces(t) for t in texts]
        new = list(set(chain.from_iterable(p for p, _ in split)).difference(self.seen))
        if new:
            self.seen.update(zip(new, self.count([w.encode() for w in new]).tolist(), strict=True))
        return [sum(map(self.seen.__getitem__, p)) + k for p, k in split]


def chunks(texts: list[str], size: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``size`` letters."""
    out, n = [], 0
    for t in texts:
        out.append(t)
        n += len(t)
        if n >= size:
            yield out
            out, n = [], 0
    if out:
        yield out


#: One merger per Python worker, by its vocabulary: tasks that follow find its pieces counted.
_kept: dict[int, Merger] = {}


def _merger(vocabulary: str) -> Merger:
    name = hash(vocabulary)
    if name not in _kept:
        _kept.clear()
        _kept[name] = Merger(vocabulary)
    return _kept[name]


def token_counts(docs: DataFrame, vocabulary_file: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    Counts equal those of the vocabulary's own library without added special tokens; a
    special token's string inside a text is one token.  Null texts count as empty.
    Whole texts are counted, row by row, in one pass without a shuffle; the vocabulary
    (a file of fixed size) goes to the executors once.  Repeated rows are counted each; a null doc_id stays; other
    columns are ignored; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    with open(vocabulary_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = list(chain.from_iterable(map(merger.texts, chunks(texts))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return out.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
