"""Fixed-width bit packing of token ids, and a store of packed blocks.

An id takes ``width`` bits, the fewest that hold every id of the vocabulary, least bit
first.  A block holds the ids of whole documents laid end to end; its row gives the
documents' offsets, so one document or any range of ids is cut out of a block without
reading the rest, and numpy unpacks all ids of a block in one step.  Blocks are rows of
Parquet files written by Spark, so the store works on any file system Spark reads.

    shard, block        position of the block in the store's order
    first               ids of the shard before this block
    doc_ids, ends       the documents, and the end of each in the block (in ids)
    width, data         bits per id, packed ids
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship, staged, steps, text_rows, trimmed
from .tokenize import END, ENCODE_BYTES, path_of, word_encoder

#: Ids after which a block is closed; a longer document is a block of its own.
BLOCK_IDS = 1 << 16

BLOCKS = "shard int, block int, first long, doc_ids array<long>, ends array<long>, width int, data binary"
_BLOCKS = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("width", pa.int32()), ("data", pa.large_binary())]
)


def width_for(n_ids: int) -> int:
    """Bits that hold ids 0 to n_ids - 1."""
    return max(1, (n_ids - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    ids = np.ascontiguousarray(ids, "<u4")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(data: bytes, width: int, first: int = 0, end: int | None = None) -> np.ndarray:
    """Ids first to end of a packed block; only their bytes are touched."""
    n = len(data) * 8 // width
    end = n if end is None else min(end, n)
    if end <= first:
        return np.zeros(0, "<u4")
    raw = np.frombuffer(data, np.uint8)
    if width in (8, 16, 32):
        return raw.view(f"<u{width // 8}")[first:end].astype("<u4")
    low, high = first * width, end * width
    bits = np.unpackbits(raw[low // 8 : -(-high // 8)], bitorder="little")[low % 8 :][: high - low]
    wide = np.zeros((end - first, 32), np.uint8)
    wide[:, :width] = bits.reshape(-1, width)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def _writer(vocabulary: str, width: int, block_ids: int):
    def run(batches):
        encoder, shard, block, first = word_encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        doc_ids, ends, held, size = [], [], [], 0

        def closed():
            row = [[shard], [block], [first], [doc_ids], [ends], [width], [pack(np.concatenate(held), width)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _BLOCKS)], schema=_BLOCKS)

        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for at, values in steps(batch.column("text"), ENCODE_BYTES):
                ids, offsets = encoder.encode(values, END)
                for k in range(len(values)):
                    own = ids[offsets[k] : offsets[k + 1]]
                    if size and size + len(own) > block_ids:
                        yield closed()
                        block, first = block + 1, first + size
                        doc_ids, ends, held, size = [], [], [], 0
                    size += len(own)
                    doc_ids.append(ids_of[at + k])
                    ends.append(size)
                    held.append(own)
        if held:
            yield closed()

    return run


def write(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode every text, append the end id, and store the ids in ascending id order.

    A null text is empty (the end id alone); null ids come first; documents with one id are
    ordered by a hash of the text and equal rows are stored as often as they occur.  The
    texts move once, by range of the id.  Returns the stored blocks, read from the files."""
    from tokenizers import Tokenizer

    ship(docs.sparkSession)
    vocabulary = vocabulary or path_of("word_bpe_49k.json")
    width = width_for(Tokenizer.from_file(vocabulary).get_vocab_size())
    rows = text_rows(docs, id_col, text_col)
    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(rows.mapInArrow(trimmed(_writer(vocabulary, width, block_ids)), BLOCKS), "token-ids")


def _reader(with_ids: bool):
    import zlib

    names = ["shard", "start_in_shard", "doc_id", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for row in batch.to_pylist():
                ids, start = unpack(row["data"], row["width"], 0, row["ends"][-1]), 0
                for doc_id, end in zip(row["doc_ids"], row["ends"]):
                    out["shard"].append(row["shard"])
                    out["start_in_shard"].append(row["first"] + start)
                    out["doc_id"].append(doc_id)
                    out["n_tokens"].append(end - start)
                    out["ids_crc32"].append(zlib.crc32(ids[start:end].tobytes()))
                    if with_ids:
                        out["ids"].append(ids[start:end].tolist())
                    start = end
            kinds = {"shard": pa.int32(), "ids": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()], names=names)

    return run


def read(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per stored document: doc_id, start in the whole store, n_tokens, ids_crc32
    (and its ids, where wanted).  Only one number per shard goes through the driver."""
    spark = blocks.sparkSession
    ship(spark)
    totals = blocks.groupBy("shard").agg(F.sum(F.element_at("ends", -1)).alias("n")).orderBy("shard").collect()
    before, base = 0, []
    for shard, n in totals:
        base.append((shard, before))
        before += n
    starts = spark.createDataFrame(base, "shard int, base long")
    kinds = "shard int, start_in_shard long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = blocks.mapInArrow(_reader(with_ids), kinds).join(starts, "shard")
    return rows.select("doc_id", (F.col("base") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
