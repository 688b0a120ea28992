"""Token-ID output: frequency-ranked ids in bytes of variable length with separate control bytes.

A token file is a folder of two tables.  ``ranks`` has one row: the ids by falling frequency.  ``blocks``
has one row per block of documents: its place (part, seq), the documents' ids and token counts, the control
bytes and the data bytes.  A control byte holds four lengths less one, two bits each, lowest bits first;
the data bytes hold the ranks, lowest byte first.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortframe.llm.bpe import byte_letters
from cohortframe.llm.common import doc_key, drop, give_back, materialize, real_id, shared_dir
from cohortframe.plans.ship import ship

_RAW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary()), ("tally", pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())])))])
_BLOCK = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("control", pa.binary()), ("data", pa.binary())])
_sql = "part int, seq int, {}docs binary, counts binary, {}".format


# --- the code ------------------------------------------------------------------------


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    if not len(v):
        return b"", b""
    length = 1 + (v >= 1 << 8).astype(np.uint8) + (v >= 1 << 16) + (v >= 1 << 24)
    fours = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    fours[: len(v)] = length - 1
    control = (fours.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    keep = np.arange(4) < length[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


#: The four lengths that each control byte stands for.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of :func:`encode`: lengths by table lookup, places by their running sum."""
    length = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    at = np.cumsum(length) - length
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(length > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# --- tokens ----------------------------------------------------------------------------


class Pieces:
    """Token ids of texts (UTF-8 bytes), piece by piece.

    The normaliser and the pre-tokeniser of the vocabulary never look across ASCII white space and put all in
    lower case, so the ids of a text are those of its pieces in turn, and ASCII capitals may go first.  Stops after
    a letter are pre-tokens of their own, so they are encoded apart.  A piece is encoded by the
    library once and remembered; beyond ``keep`` pieces those are forgotten that were not met again.

    A piece of small Latin letters only is one pre-token that the normaliser leaves as it is, so such pieces go to a second
    encoder without those steps; the token that ends a word tells them apart.
    """

    def __init__(self, vocabulary: str, keep: int = 300_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_str(vocabulary)
        self.keep = keep
        #: Parts pieces that are encoded together: a control letter, if it is one token and so not part of another.
        mark = self._ids("\x01")
        self.mark = mark[0] if len(mark) == 1 else None
        self.words, self.ends = self._word_encoder(json.loads(vocabulary))
        self.clear()

    def _word_encoder(self, spec: dict):
        """The encoder of plain words and which ids end one; None where the vocabulary does not mark ends of words."""
        from tokenizers import Tokenizer

        suffix = spec["model"].get("end_of_word_suffix")
        if not suffix:
            return None, None
        spec |= {"normalizer": None, "added_tokens": [], "post_processor": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}
        ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        return Tokenizer.from_str(json.dumps(spec)), ends

    def _ids(self, text: str) -> list[int]:
        return self.encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat = np.empty(1 << 20, np.uint32)
        self.end = np.zeros(1 << 18, np.int64)
        self.again = np.zeros(1 << 18, bool)

    def forget(self) -> None:
        """Keep only pieces that were met again."""
        met = np.flatnonzero(self.again[: len(self.index)])
        names = list(self.index)
        ids, size = self._gather(met)
        self.clear()
        if len(met) <= self.keep // 2:
            self._add([names[i] for i in met.tolist()], ids, size)

    def _add(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, used = len(self.index), int(self.end[len(self.index)])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while n + len(pieces) >= len(self.end):
            self.end = np.concatenate((self.end, np.zeros_like(self.end)))
            self.again = np.concatenate((self.again, np.zeros_like(self.again)))
        self.flat[used : used + len(ids)] = ids
        self.end[n + 1 : n + 1 + len(pieces)] = used + np.cumsum(sizes)
        self.index.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def _encode_words(self, words: list[bytes]) -> bool:
        """Encode plain words together; False, and nothing done, if their ends cannot be told."""
        text = b" ".join(words).decode("latin-1")
        for byte, letter in _LETTER_OF_BYTE:
            text = text.replace(byte, letter)
        ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words):
            return False
        self._add(words, ids, np.diff(np.concatenate(([-1], last))))
        return True

    def _encode_pieces(self, words: list[bytes], pieces: list[bytes]) -> None:
        for i in range(0, len(words), 8192):
            if self.words is None or not self._encode_words(words[i : i + 8192]):
                pieces = pieces + words[i : i + 8192]
        plain = [p for p in pieces if self.mark is not None and b"\x01" not in p and b"<|" not in p]
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            ids = np.array(self._ids(b" \x01 ".join(part).decode()), np.uint32)
            cut = np.flatnonzero(ids == self.mark)
            edge = np.concatenate(([-1], cut, [len(ids)]))
            self._add(part, np.delete(ids, cut), np.diff(edge) - 1)
        for p in set(pieces).difference(plain):
            ids = np.array(self._ids(p.decode()), np.uint32)
            self._add([p], ids, np.array([len(ids)]))

    def _learn(self, new: list[bytes]) -> None:
        words = set(filter(_SMALL, new))
        single, cores, ends = [], [], []
        for p in new:
            if p in words:
                continue
            core = p.rstrip(_STOPS)
            if len(core) != len(p) and core and (core[-1] in _LETTERS or (core[-1] >= 128 and core.decode()[-1].isalpha())):
                cores.append(core)
                ends.append(p[len(core) :])
            else:
                single.append(p)
        more = set(cores).difference(self.index, words)
        words.update(filter(_SMALL, more))
        self._encode_pieces(list(words), list(set(single).union(more, ends).difference(self.index, words)))
        if cores:
            at = self.index.__getitem__
            both = np.empty(2 * len(cores), np.int64)
            both[0::2], both[1::2] = np.fromiter(map(at, cores), np.int64, len(cores)), np.fromiter(map(at, ends), np.int64, len(ends))
            ids, size = self._gather(both)
            self._add([c + e for c, e in zip(cores, ends, strict=True)], ids, size.reshape(-1, 2).sum(1))

    def _gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, size = self.end[which], self.end[which + 1] - self.end[which]
        total = np.cumsum(size)
        at = np.repeat(start - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)
        return self.flat[at], size

    def _split(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The different pieces of the texts, which of them stand where, and how many each text has."""
        letters = texts.view(pa.string())
        # capitals of what might be a special token stay as they are
        if not pc.any(pc.match_substring(letters, "<|")).as_py():
            letters = pc.ascii_lower(letters)
        else:
            letters = pa.array([t if b"<|" in t else t.lower() for t in texts.to_pylist()], pa.binary()).view(pa.string())
        parts = pc.ascii_split_whitespace(letters)
        coded, count = parts.flatten().dictionary_encode(), parts.value_lengths().to_numpy()
        pieces, which = _slices(coded.dictionary), coded.indices.to_numpy()
        if b"" in pieces:  # before the first piece of a text or after its last
            blank = which == pieces.index(b"")
            sums = np.concatenate(([0], np.cumsum(blank)))[np.concatenate(([0], np.cumsum(count)))]
            which, count = which[~blank], count - np.diff(sums)
        return pieces, which, count

    def encode(self, texts: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, and how many each text has."""
        texts = pa.array(texts, pa.binary()) if isinstance(texts, list) else texts
        if len(self.index) > self.keep:
            self.forget()
        pieces, places, count = self._split(texts)
        known = np.fromiter(map(self.index.get, pieces, repeat(-1)), np.int64, len(pieces))
        self.again[known[known >= 0]] = True
        unknown = np.flatnonzero(known < 0).tolist()
        if unknown:
            self._learn([pieces[i] for i in unknown if pieces[i]])
            known[unknown] = [self.index.get(pieces[i], 0) for i in unknown]
        ids, size = self._gather(known[places])
        sums = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(count)))]
        return ids, np.diff(sums)


def _slices(strings: pa.Array) -> list[bytes]:
    """The bytes of each string, cut from one buffer."""
    _, at, data = strings.buffers()
    if data is None or not len(strings):
        return [b""] * len(strings)
    edge, data = np.frombuffer(at, np.int32)[strings.offset : strings.offset + len(strings) + 1].tolist(), data.to_pybytes()
    return [data[a:z] for a, z in zip(edge, edge[1:], strict=False)]


#: Bytes of a row group: a writer holds one for every task.
ROW_GROUP = 16 << 20
#: Bytes of text that are encoded together.
CHUNK = 4 << 20
#: Stops that follow words, and the ASCII letters in lower case.
_STOPS = b".,;:!?"
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")
#: Small letters of Latin-1, in UTF-8, which are their own lower case and composed form.
_SMALL = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: Bytes of such letters that stand for other letters in a byte-level vocabulary, and those.
_LETTER_OF_BYTE = [(chr(b), c) for b, c in enumerate(byte_letters()) if 0x9F <= b <= 0xC3 and chr(b) != c]
_kept: dict[str, Pieces] = {}


def pieces_of(vocabulary: str) -> Pieces:
    """The pieces of a vocabulary, which all tasks of a worker share.

    A task is pickled with copies of the variables it names, so it must come here by the name of this function.
    """
    name = hashlib.sha256(vocabulary.encode()).hexdigest()
    if name not in _kept:
        _kept.clear()
        _kept[name] = Pieces(vocabulary)
        give_back()
    return _kept[name]


def _tokenise(shared, end_id: int, block_tokens: int, size: int):
    """Blocks of token ids, and a last row of each task with how often it met each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(shared.value)
        part, seq = TaskContext.get().partitionId(), 0
        docs, counts, ids, held, total = [], [], [], 0, np.zeros(size, np.int64)

        def block() -> pa.RecordBatch:
            row = {"part": part, "seq": seq, "docs": np.concatenate(docs).tobytes(), "counts": np.concatenate(counts).tobytes(), "ids": np.concatenate(ids).astype("<u4").tobytes(), "tally": None}
            return pa.RecordBatch.from_pylist([row], schema=_RAW)

        for b in batches:
            keys = b.column(0).to_numpy()
            sums = np.cumsum(pc.binary_length(b.column(1)).to_numpy())
            at = 0
            while at < len(sums):
                # a few megabytes of text at a time
                n = max(1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + CHUNK, "right")) - at)
                got, lengths = pieces.encode(b.column(1).slice(at, n))
                docs.append(keys[at : at + n].astype("<i8"))
                counts.append(lengths + 1)
                ids.append(np.insert(got, np.cumsum(lengths), end_id))
                held += len(ids[-1])
                total += np.bincount(ids[-1], minlength=size)
                at += n
                if held >= block_tokens:
                    yield block()
                    seq, held = seq + 1, 0
                    docs, counts, ids = [], [], []
        if docs:
            yield block()
        docs, counts, ids, got, lengths = [], [], [], None, None
        give_back()
        seen = np.flatnonzero(total)
        if len(seen):
            tally = pa.ListArray.from_arrays(pa.array([0, len(seen)], pa.int32()), pa.StructArray.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"]))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.nulls(1, f.type) for f in list(_RAW)[1:5]), tally], schema=_RAW)

    return run


def _recode(ranks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], "<u4")
                control, data = encode(ranks[ids])
                yield pa.RecordBatch.from_pylist([{"part": r["part"], "seq": r["seq"], "n_tokens": len(ids), "docs": r["docs"], "counts": r["counts"], "control": control, "data": data}], schema=_BLOCK)
        give_back()

    return run


def write_token_file(docs: DataFrame, path: str, vocabulary_file: str, end_id: int = 1, block_tokens: int = 1 << 18, range_bytes: int = 32 << 20) -> str:
    """Encode every text, append ``end_id`` to each, and write a token file to ``path`` in order of doc_id.

    Null texts are empty; a null doc_id comes last; rows of one doc_id are in the order of their texts' hashes, and repeated
    rows stay repeated.  Other columns are ignored; an empty table gives a file without blocks.
    Texts are dealt out by ranges of (doc_id, hash) of about ``range_bytes``, tokenised once into blocks of about
    ``block_tokens`` ids, counted, and recoded by rank.  Counts are one number per vocabulary entry, so the driver
    may hold them.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary_file, encoding="utf-8") as f:
        text = f.read()
    shared = spark.sparkContext.broadcast(text)
    size = max(Pieces(text).encoder.get_vocab_size(with_added_tokens=True), end_id + 1)
    rows = docs.select(doc_key().alias("key"), F.xxhash64("text").alias("text_key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes), 1)
    rows = rows.repartitionByRange(n, "key", "text_key").sortWithinPartitions("key", "text_key", "text").select("key", "text")
    raw = materialize(rows.mapInArrow(_tokenise(shared, end_id, block_tokens, size), _sql("", "ids binary, tally array<struct<id: long, n: long>>")), "tokens", "snappy")
    counts = raw.select(F.explode("tally").alias("t")).groupBy("t.id").agg(F.sum("t.n").alias("n")).collect()
    total = np.zeros(size, np.int64)
    for r in counts:
        total[r["id"]] = r["n"]
    order = np.lexsort((np.arange(size), -total)).astype("<u4")
    ranks = np.empty(size, np.uint32)
    ranks[order] = np.arange(size, dtype=np.uint32)
    raw.where("ids is not null").drop("tally").mapInArrow(_recode(ranks), _sql("n_tokens long, ", "control binary, data binary")).write.option("compression", "none").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/blocks")
    # as an Arrow table, which needs no Python worker; those of rows would be others than the tasks above have
    spark.createDataFrame(pa.table({"ids": pa.array([order.tobytes()], pa.binary())})).write.parquet(f"{path}/ranks")
    drop(raw)
    return path


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids binary) of a token file: little-endian unsigned 32-bit ids; ``start`` counts the ids before."""
    ship(spark)
    order = np.frombuffer(bytes(spark.read.parquet(f"{path}/ranks").first()[0]), "<u4")
    blocks = spark.read.parquet(f"{path}/blocks")
    # places: one row per part, then the blocks of a part
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    at = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("part", "seq", at.alias("at")).join(parts, "part").select("part", "seq", (F.col("base") + F.col("at")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = order[decode(r["control"], r["data"], r["n_tokens"])]
                count = np.frombuffer(r["counts"], np.int64)
                end = np.cumsum(count)
                own = [ids[e - c : e].tobytes() for e, c in zip(end.tolist(), count.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["docs"], "<i8")), pa.array(r["start"] + end - count), pa.array(own, pa.binary())], ["doc_id", "start", "ids"])
        give_back()

    out = blocks.join(starts, ["part", "seq"]).select("start", "n_tokens", "docs", "counts", "control", "data").mapInArrow(run, "doc_id long, start long, ids binary")
    return out.withColumn("doc_id", real_id())


def token_digest(docs: DataFrame, vocabulary_file: str, path: str | None = None, end_id: int = 1) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per row of ``docs``, read back from a token file in the shared folder.

    Nulls, repeated rows, other columns and empty tables are treated as :func:`write_token_file` says.
    """
    spark = docs.sparkSession
    path = write_token_file(docs, path or f"{shared_dir(spark)}/cohortframe-tokenfile-{uuid.uuid4().hex}", vocabulary_file, end_id)
    out = read_token_file(spark, path)
    return out.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
