"""Token ids in binary blocks coded by a static range asymmetric numeral system.

One frequency table, counted over the whole corpus, is shared by all blocks. A
block is coded by ``LANES`` interleaved coders in numpy, stands alone, and keeps
the coders' states and stream position every ``CHECKPOINT`` rounds: the
stretches between checkpoints are decoded side by side, or one without the
others. Each block has a CRC-32 of its ids.

File format: Parquet rows, one a block, sorted by the documents' order. Columns:
part, block (its place), before (ids of the part before it), n_ids, doc_id and
n_tokens (lists, in order), crc32, payload.
The table lies beside them. A payload holds, little-endian: "RAN1", the number
of ids and of words (u4), the lanes (u4), LANES states (u8), then checkpoints
(round, word u4; LANES states u8 each, their number first), then the words (u4).
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.llm.bpe import WordBpe, byte_symbols, default_path
from trustloom.llm.common import SEPARATORS, Memo, only, shared_dir

#: Bits of the shared table's total.
BITS = 20
LANES = 1024
#: Rounds (of LANES ids) between checkpoints.
CHECKPOINT = 128
#: Ids of a block, about: it is closed after the document that reaches it.
BLOCK_IDS = 1 << 19
LOW = np.uint64(1 << 31)
END_ID = 2
#: Ids that the vocabulary file can give, special tokens included.
SYMBOLS = 49408


def shared_table(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to 2 ** bits, at least 1 for each symbol, so that any id can be coded."""
    n, total = len(counts), 1 << bits
    if n > total:
        raise ValueError(f"{n} symbols need more than {bits} bits")
    whole = max(1, int(counts.sum()))
    f = 1 + np.floor(counts.astype(np.float64) * (total - n) / whole).astype(np.int64)
    f[int(counts.argmax())] += total - int(f.sum())  # what rounding left
    return f


class Coder:
    def __init__(self, freq: np.ndarray, bits: int = BITS) -> None:
        self.bits = np.uint64(bits)
        self.mask = np.uint64((1 << bits) - 1)
        self.f = freq.astype(np.uint64)
        self.c = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.top = (LOW >> self.bits) << np.uint64(32)

    def encode(self, ids: np.ndarray, lanes: int = LANES) -> bytes:
        n = len(ids)
        rounds = -(-n // lanes)
        s = np.zeros(rounds * lanes, np.int64)
        s[:n] = ids
        s = s.reshape(rounds, lanes)
        x = np.full(lanes, LOW, np.uint64)
        words, marks, count = [], [], 0
        live_last = n - (rounds - 1) * lanes if rounds else 0
        for r in range(rounds - 1, -1, -1):
            live = live_last if r == rounds - 1 else lanes
            f, c = self.f[s[r, :live]], self.c[s[r, :live]]
            y = x[:live]
            over = y >= self.top * f
            if over.any():
                out = y[over]
                words.append((out & np.uint64(0xFFFFFFFF)).astype("<u4"))
                count += len(out)
                y = np.where(over, y >> np.uint64(32), y)
            q = y // f
            x[:live] = (q << self.bits) + (y - q * f) + c
            if r and r % CHECKPOINT == 0:
                marks.append((r, count, x.copy()))
        stream = np.concatenate(words[::-1]) if words else np.empty(0, "<u4")
        head = b"RAN1" + np.array([n, count, lanes], "<u4").tobytes() + x.astype("<u8").tobytes()
        body = [np.array([len(marks)], "<u4").tobytes()]
        for r, done, state in marks[::-1]:
            body.append(np.array([r, count - done], "<u4").tobytes() + state.astype("<u8").tobytes())
        return head + b"".join(body) + stream.tobytes()

    def decode(self, data: bytes, first_mark: int = 0, last_mark: int | None = None) -> np.ndarray:
        """All ids, or those between two checkpoints: mark 0 is the start, mark k the k-th checkpoint.

        The stretches between checkpoints are rows of one array: a round of all
        of them is decoded at once.
        """
        if data[:4] != b"RAN1":
            raise ValueError("not a block")
        n, count, lanes = np.frombuffer(data, "<u4", 3, 4).tolist()
        at = 16
        states, words = [np.frombuffer(data, "<u8", lanes, at)], [0]
        at += 8 * lanes
        k = int(np.frombuffer(data, "<u4", 1, at)[0])
        at += 4
        for _ in range(k):
            words.append(int(np.frombuffer(data, "<u4", 2, at)[1]))
            states.append(np.frombuffer(data, "<u8", lanes, at + 8))
            at += 8 + 8 * lanes
        stream = np.frombuffer(data, "<u4", count, at)
        rounds, last_mark = -(-n // lanes), k + 1 if last_mark is None else min(last_mark, k + 1)
        ends_block = last_mark == k + 1
        x = np.array(states[first_mark:last_mark], np.uint64)
        word = np.array(words[first_mark:last_mark], np.int64)
        if not len(x) or not rounds:
            return np.empty(0, np.uint32)
        # All stretches have CHECKPOINT rounds, but for the block's last.
        tail = rounds - k * CHECKPOINT if ends_block else CHECKPOINT
        depth = CHECKPOINT if len(x) > 1 else tail
        out = np.zeros((len(x), depth, lanes), np.uint32)
        for r in range(depth):
            rows = len(x) if r < tail else len(x) - 1
            y = x[:rows]
            slot = y & self.mask
            s = self.symbol[slot]
            out[:rows, r] = s
            y = self.f[s] * (y >> self.bits) + slot - self.c[s]
            low = y < LOW
            if ends_block and r == tail - 1:
                low[-1, n - (rounds - 1) * lanes :] = False  # lanes without an id in the last round
            if low.any():
                taken = np.cumsum(low, axis=1)
                y[low] = y[low] << np.uint64(32) | stream[(word[:rows, None] + taken - 1)[low]]
                word[:rows] += taken[:, -1]
            x[:rows] = y
        return out.reshape(-1)[: n - first_mark * CHECKPOINT * lanes if ends_block else None]


def _coder(data: bytes) -> Coder:
    return only(lambda: Coder(np.frombuffer(data, np.int64)), "coder", data)


def id_kind(symbols: int) -> str:
    """Ids between tokeniser and files: 16 bits where all symbols fit, else 32."""
    return "<u2" if symbols <= 1 << 16 else "<u4"


def write_blocks(ids: DataFrame, path: str, symbols: int, block_ids: int = BLOCK_IDS, partitions: int | None = None) -> None:
    """Write ``ids`` (doc_id, ids: binary of :func:`id_kind`) in ascending doc_id order below ``path``.

    Null ids sort first; rows of one doc_id follow the CRC-32 of their ids, so
    that their order is fixed and a doc_id that very many rows share is dealt to
    many tasks. Two passes: one counts all ids, one deals documents out by
    ranges and codes them; a part's rows stay in order.
    """
    spark = ids.sparkSession
    kind_of_id = id_kind(symbols)
    stage = f"{path}/ids"
    ids.select("doc_id", "ids", F.crc32("ids").alias("crc")).write.option("compression", "zstd").parquet(stage)
    kept = spark.read.parquet(stage)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(symbols, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind_of_id), minlength=symbols)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counts = np.zeros(symbols, np.int64)
    for r in kept.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most one row a symbol
        counts[r["id"]] = r["n"]
    table = shared_table(counts)
    spark.createDataFrame([(bytearray(table.tobytes()),)], "freq binary").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(table.tobytes())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = _coder(shared.value), TaskContext.get().partitionId()
        block, docs, lens, parts, size, before = 0, [], [], [], 0, 0

        def close():
            raw = np.frombuffer(b"".join(parts), kind_of_id).astype("<u4")
            rows = [[part], [block], [before], [len(raw)], [docs], [lens], [zlib.crc32(raw.tobytes())], [coder.encode(raw)]]
            return pa.record_batch([pa.array(r, t) for r, t in zip(rows, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(kind), pa.list_(pa.int32()), pa.int64(), pa.binary()))], ["part", "block", "before", "n_ids", "doc_id", "n_tokens", "crc32", "payload"])

        kind, width = None, np.dtype(kind_of_id).itemsize
        for batch in batches:
            kind = batch.schema.field(0).type
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append(d)
                lens.append(len(x) // width)
                parts.append(x)
                size += lens[-1]
                if size >= block_ids:
                    yield close()
                    block, docs, lens, parts, size, before = block + 1, [], [], [], 0, before + size
        if docs:
            yield close()

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    doc_kind = ids.schema["doc_id"].dataType.simpleString()
    blocks = kept.repartitionByRange(n, "doc_id", "crc").sortWithinPartitions("doc_id", "crc", "ids").select("doc_id", "ids").mapInArrow(code, f"part int, block int, before long, n_ids long, doc_id array<{doc_kind}>, n_tokens array<int>, crc32 long, payload binary")
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    _remove(spark, stage)


def _remove(spark: SparkSession, path: str) -> None:
    """Delete what was only needed on the way, in whatever store it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens (long), ids_crc32 (long), ids (binary, unsigned 32-bit) of each document, from the files.

    ``start`` counts the ids of all documents before it: sums over the parts go
    through the driver (one number a part); blocks know the ids of their part
    before them. A block whose checksum fails raises.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    table = bytes(spark.read.parquet(f"{path}/table").first()["freq"])
    shared = spark.sparkContext.broadcast(table)
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.max(F.col("before") + F.col("n_ids")).alias("n")).collect())
    ids_before, sofar = {}, 0
    for part, n in totals:
        ids_before[part] = sofar
        sofar += n
    kind = blocks.schema["doc_id"].dataType.elementType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            for part, before, docs, lens, crc, payload in zip(*[batch.column(k) for k in range(6)]):
                start = ids_before[part.as_py()] + before.as_py()
                raw = coder.decode(payload.as_py())
                if zlib.crc32(raw.astype("<u4").tobytes()) != crc.as_py():
                    raise ValueError("a block's checksum fails")
                lens = np.array(lens.as_py(), np.int64)
                ends = np.cumsum(lens)
                cut = [raw[e - n : e] for e, n in zip(ends.tolist(), lens.tolist())]
                yield pa.record_batch(
                    [
                        docs.values,
                        pa.array(start + ends - lens, pa.int64()),
                        pa.array(lens, pa.int64()),
                        pa.array([zlib.crc32(c.astype("<u4").tobytes()) for c in cut], pa.int64()),
                        pa.array([c.astype("<u4").tobytes() for c in cut], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    rows = blocks.select("part", "before", "doc_id", "n_tokens", "crc32", "payload")
    return rows.mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, ids binary")


#: Entries of a generation of the encoder's memos: this query's workers hold nothing else.
MEMO = 400_000


class Encoder:
    """Ids of whole texts by the tokenizers library's model, as bytes.

    Pieces between blanks and words are looked up in bounded tables, so the
    library's merges run for words that a worker hasn't met of late.
    """

    def __init__(self, path: str, kind: str) -> None:
        from tokenizers import Tokenizer

        self.rules, self.library, self.kind = WordBpe(path), Tokenizer.from_file(path), kind
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.code = self.library.model, np.dtype(kind).char
        self.bytes = {b: c for b, c in enumerate(byte_symbols()) if chr(b) != c}
        self.words = Memo(self.word, MEMO)
        self.pieces = Memo(lambda p: b"".join([self.words[w] for w in self.rules.cut(p)]), MEMO)

    def word(self, w: str) -> bytes:
        symbols = w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.bytes)
        return array(self.code, [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def encode(self, text: str) -> bytes:
        if "<|" in text:  # perhaps special tokens
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        text = self.rules.normalised(text)
        if any(c in text for c in SEPARATORS):
            return b"".join([self.words[w] for w in self.rules.word.findall(text)])
        return b"".join(map(self.pieces.__getitem__, text.split()))


def encoder(path: str, kind: str) -> Encoder:
    return only(lambda: Encoder(path, kind), "encoder", path, kind)


def token_ids(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, symbols: int = SYMBOLS) -> DataFrame:
    """doc_id, ids (binary of :func:`id_kind`) with ``end_id`` after each document; null texts count as empty."""
    kind_of_id = id_kind(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path or default_path(), kind_of_id).encode, np.array([end_id], kind_of_id).tobytes()
        for batch in batches:
            out = [encode(x or "") + end for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary")


def token_files(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", out: str | None = None, end_id: int = END_ID, symbols: int = SYMBOLS) -> DataFrame:
    """Tokenise, write the files below ``out`` (a fresh shared folder by default) and read them back.

    A row per input row, as :func:`read_blocks` gives it. Null and empty texts
    are the end id alone; texts of any length stay whole, in one block. Null
    doc_ids come first; rows of one doc_id, repeats too, follow one another by
    the CRC-32 of their ids. Extra columns, whatever their names, are ignored;
    an empty table gives no rows.
    """
    out = out or f"{shared_dir(docs.sparkSession)}/tokens"
    write_blocks(token_ids(docs, path, doc_id, text, end_id, symbols), out, symbols)
    return read_blocks(docs.sparkSession, out)
