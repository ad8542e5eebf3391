"""Token ids as compressed binary blocks: static range asymmetric numeral systems.

Documents are range-partitioned by id and tokenised in order. One frequency table
over all ids is quantised to 2^SCALE and shared by every block. A block holds whole
documents and is coded for itself by LANES interleaved rANS states (64-bit states,
32-bit words), so blocks decode in parallel; checkpoints of all states every few
steps let a reader start inside a block, and checksums cover payload and ids.

On disk a file set is a folder with ``table`` (one row) and ``blocks`` (one row a
block: part, number, bytes), written and read with Spark so that any store works.

Block bytes, little-endian: magic ``MLB1``; uint32 header length; JSON header
(start, n_tokens, lanes, steps, checkpoint steps and word positions, number of
documents, checksums); document ids int64; tokens per document uint32; checkpoint
states uint64; payload uint32 words in decoding order.
"""

from __future__ import annotations

import json
import os
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, new_path, read, removed

SCALE = 18
LANES = 2048
LOW = np.uint64(1 << 31)
#: A block is closed at the first document end after so many ids.
BLOCK = 1 << 18
CHECKPOINT_STEPS = 64
END = 0
#: About how many bytes of texts are tokenised at once.
TEXT_BYTES = 24 << 20
NO_ID = -(1 << 63)
MAGIC = b"MLB1"


# -- coding -------------------------------------------------------------------------------------


def quantised(counts: dict[int, int], scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """``(symbols, frequencies)``: each seen id gets at least 1 of 2^scale."""
    if not counts:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint32)
    symbols = np.array(sorted(counts), dtype=np.uint32)
    n = np.array([counts[int(s)] for s in symbols], dtype=float)
    whole = 1 << scale
    if len(symbols) > whole:
        raise ValueError("more symbols than the scale can hold")
    f = np.maximum(1, np.floor(n / n.sum() * (whole - len(symbols)))).astype(np.int64)
    f[int(f.argmax())] += whole - f.sum()
    return symbols, f.astype(np.uint32)


class Coder:
    """Encoder and decoder of one shared table."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray, scale: int = SCALE):
        self.scale, self.symbols = np.uint64(scale), symbols
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.rank = np.zeros(int(symbols.max()) + 1 if len(symbols) else 1, dtype=np.uint32)
        self.rank[symbols] = np.arange(len(symbols), dtype=np.uint32)

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT_STEPS):
        """``(words, checkpoints)``; a checkpoint is (step, word position, states)."""
        lanes = max(1, min(lanes, len(ids)))
        steps = -(-len(ids) // lanes)
        r = self.rank[np.append(ids, np.repeat(ids[:1], steps * lanes - len(ids)))].reshape(steps, lanes)
        freq, start = self.freq[r], self.start[r]
        limit = freq * ((LOW >> self.scale) << np.uint64(32))
        x, groups, marks = np.full(lanes, LOW), [None] * steps, {}
        for t in range(steps - 1, -1, -1):
            f = freq[t]
            over = x >= limit[t]
            groups[t] = (x[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            x = np.where(over, x >> np.uint64(32), x)
            q = x // f
            x = (q << self.scale) + (x - q * f) + start[t]
            if t % every == 0:
                marks[t] = x.copy()
        at = np.cumsum([0] + [len(g) for g in groups])
        words = np.concatenate(groups) if steps else np.zeros(0, dtype=np.uint32)
        return words, [(t, int(at[t]), marks[t]) for t in sorted(marks)], lanes

    def decode(self, words: np.ndarray, states: np.ndarray, position: int, step: int, stop: int) -> np.ndarray:
        """Ids of the steps from ``step`` up to ``stop``, begun at a checkpoint."""
        x, out = states.copy(), np.empty((max(0, stop - step), len(states)), dtype=np.uint32)
        mask = np.uint64((1 << int(self.scale)) - 1)
        for t in range(stop - step):
            low = x & mask
            s = self.slot[low]
            out[t] = self.symbols[s]
            x = self.freq[s] * (x >> self.scale) + low - self.start[s]
            under = x < LOW
            k = int(under.sum())
            if k:
                x[under] = (x[under] << np.uint64(32)) | words[position : position + k]
                position += k
        return out.reshape(-1)


def block_bytes(coder: Coder, ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, start: int) -> bytes:
    words, marks, lanes = coder.encode(ids)
    payload, raw = words.astype("<u4").tobytes(), ids.astype("<u4").tobytes()
    states = np.concatenate([s for _, _, s in marks]).astype("<u8").tobytes()
    header = json.dumps({
        "start": int(start), "n_tokens": len(ids), "lanes": lanes, "steps": -(-len(ids) // lanes), "docs": len(doc_ids),
        "marks": [[t, p] for t, p, _ in marks], "payload_crc": zlib.crc32(states + payload), "ids_crc": zlib.crc32(raw),
    }).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), states, payload])


def read_block(coder: Coder, data: bytes, first_mark: int = 0):
    """``(header, doc_ids, lengths, ids)``; ``first_mark`` > 0 decodes from that checkpoint on
    (ids only from there; checksums of ids are for whole blocks)."""
    if data[:4] != MAGIC:
        raise ValueError("not a block")
    n = int.from_bytes(data[4:8], "little")
    h, at = json.loads(data[8 : 8 + n]), 8 + n
    doc_ids = np.frombuffer(data, "<i8", h["docs"], at)
    at += 8 * h["docs"]
    lengths = np.frombuffer(data, "<u4", h["docs"], at)
    at += 4 * h["docs"]
    lanes = h["lanes"]
    if zlib.crc32(data[at:]) != h["payload_crc"]:
        raise ValueError("payload checksum differs")
    states = np.frombuffer(data, "<u8", lanes * len(h["marks"]), at).reshape(-1, lanes)
    at += states.nbytes
    words = np.frombuffer(data, "<u4", offset=at).astype(np.uint64)
    step, position = h["marks"][first_mark]
    ids = coder.decode(words, states[first_mark].astype(np.uint64), position, step, h["steps"])[: h["n_tokens"] - step * lanes]
    if not first_mark and zlib.crc32(ids.astype("<u4").tobytes()) != h["ids_crc"]:
        raise ValueError("id checksum differs")
    return h, doc_ids, lengths, ids


# -- files --------------------------------------------------------------------------------------

#: Pieces that the library encodes as one text.
RUN = 50
_WHITE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts in which some space is not between two visible characters.
_ODD = rf"{_WHITE}{_WHITE}|^{_WHITE}|{_WHITE}$"
#: Pieces that begin with a space and hold no other white space at their ends.
_PLAIN = rf"(?s)^ [^{_WHITE[1:]}(.*[^{_WHITE[1:]})?$"
#: A space between two visible characters always begins a new piece of a byte-level tokenizer.
_CUT = rf"([^{_WHITE[1:]}) ([^{_WHITE[1:]})"


class Tokens:
    """Ids of whole texts by the tokenizers library.

    A byte-level tokenizer looks at each word with the space before it on its own, so a
    text is cut at single spaces, each distinct piece of a batch of texts is encoded once by
    the library, and a text's ids are its pieces' ids in a row. Pieces are told apart by
    Arrow and ids gathered by numpy. Texts that hold one of
    the tokenizer's added tokens or a NUL, which marks the cuts, are encoded whole, as are
    all texts of other tokenizers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.added = [x.content for x in self.encoder.get_added_tokens_decoder().values()]
        spec = json.loads(self.encoder.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        vocabulary = self.encoder.get_vocab()
        self.size = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        for token, k in vocabulary.items():
            self.size[k] = len(token)  # the byte-level alphabet has a character for each byte

    @staticmethod
    def of(path: str) -> Tokens:
        """The tokenizer of this Python worker, kept from task to task."""
        state = sys.modules.setdefault("_metalith_worker_state", types.ModuleType("_metalith_worker_state"))
        kept = state.__dict__.setdefault("tokens", {})
        if path not in kept:
            kept[path] = Tokens(path)
        return kept[path]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.encoder.encode_batch(texts, add_special_tokens=False)]

    def _runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that begin with the only space at their ends, and where each piece's
        end. They are encoded in runs, whose ids are dealt back by their lengths in bytes."""
        n = len(runs)
        heads = np.append(np.arange(0, n, RUN, dtype=np.int32), np.int32(n))
        texts = pc.binary_join(pa.ListArray.from_arrays(heads, runs), pa.scalar("", runs.type)).to_pylist()
        ids = np.fromiter((k for x in self.encoder.encode_batch_fast(texts, add_special_tokens=False) for k in x.ids), dtype=np.uint32)
        ends = np.cumsum(pc.binary_length(runs).to_numpy())
        return ids, np.searchsorted(np.cumsum(self.size[ids]), ends) + 1

    def pieces(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, first, size)``: ids of distinct pieces, where each piece's begin and how many they are."""
        plain = pc.match_substring_regex(new, _PLAIN)
        runs, rest = new.filter(plain), new.filter(pc.invert(plain)).to_pylist()
        ids, ends = self._runs(runs) if len(runs) else (np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))
        more = [np.frombuffer(x, dtype="<u4") for x in self.whole(rest)]
        ends = np.concatenate([ends, len(ids) + np.cumsum([len(x) for x in more], dtype=np.int64)])
        mask = plain.to_numpy(zero_copy_only=False)
        place = np.where(mask, np.cumsum(mask) - 1, len(runs) + np.cumsum(~mask) - 1)
        size = np.diff(ends, prepend=0)
        return np.concatenate([ids, *more]), (ends - size)[place].astype(np.int32), size[place].astype(np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, sizes)``: ids of all texts in a row, and how many each text has."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, _ODD)
        apart = pc.match_substring(texts, "\0") if self.by_piece else pa.array([True] * len(texts), pa.bool_())
        for t in self.added if self.by_piece else ():
            apart = pc.or_(apart, pc.match_substring(texts, t))
        cut = pc.if_else(odd, pc.replace_substring_regex(pc.if_else(odd, texts, ""), _CUT, "\\1\0 \\2"), pc.replace_substring(texts, " ", "\0 "))
        lists = pc.split_pattern(pc.if_else(apart, "", cut), "\0")
        pieces = lists.flatten().dictionary_encode()
        ids, first, size = self.pieces(pieces.dictionary)
        piece = pieces.indices.to_numpy()
        first, size = first[piece], size[piece]
        total = np.concatenate([np.zeros(1, dtype=np.int32), np.cumsum(size, dtype=np.int32)])
        ids = ids[np.repeat(first - total[:-1], size) + np.arange(total[-1], dtype=np.int32)]
        offsets = lists.offsets.to_numpy()
        ends = total[offsets - offsets[0]]
        sizes = np.diff(ends).astype(np.int64)
        if whole := np.flatnonzero(apart.to_numpy(zero_copy_only=False)).tolist():
            parts = np.split(ids, ends[1:-1])
            for i, x in zip(whole, self.whole([texts[i].as_py() for i in whole]), strict=True):
                parts[i] = np.frombuffer(x, dtype="<u4")
                sizes[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, sizes


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts of as many batches as TEXT_BYTES take."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= TEXT_BYTES:
            yield pa.concat_arrays([x.column(0) for x in held]).to_pylist(), pa.concat_arrays([x.column(1) for x in held])
            held, size = [], 0
    if held:
        yield pa.concat_arrays([x.column(0) for x in held]).to_pylist(), pa.concat_arrays([x.column(1) for x in held])


def _tokenised(path: str, end: int):
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before, held = TaskContext.get().partitionId(), 0, 0, 0
        docs, lengths, chunks = [], [], []
        counts = np.zeros(0, dtype=np.int64)

        def row(counts=None):
            ids = np.concatenate(chunks) if chunks else np.zeros(0, dtype=np.uint32)
            seen = np.flatnonzero(counts) if counts is not None else []
            return pa.RecordBatch.from_pylist(
                [{"part": part, "number": number, "before": before, "n": len(ids), "docs": docs, "lengths": lengths, "ids": ids.astype("<u4").tobytes(),
                  "seen": list(map(int, seen)), "counts": [int(counts[k]) for k in seen]}],
                schema=_CHUNK,
            )

        encode = Tokens.of(path)
        for names, texts in _gathered(batches):
            ids, sizes = encode.encode(texts)
            del texts
            ends = np.cumsum(sizes)
            ids, sizes, ends = np.insert(ids, ends, end), sizes + 1, ends + np.arange(1, len(ends) + 1)
            names, a = [NO_ID if x is None else x for x in names], 0
            while a < len(names):  # as many documents as the open block takes
                before_a = int(ends[a] - sizes[a])
                b = min(len(names), int(np.searchsorted(ends, before_a + BLOCK - held)) + 1)
                docs += names[a:b]
                lengths += sizes[a:b].tolist()
                chunks.append(ids[before_a : ends[b - 1]])
                held += len(chunks[-1])
                a = b
                if held >= BLOCK:
                    counts = _added(counts, chunks)
                    yield row()
                    number, before, held, docs, lengths, chunks = number + 1, before + held, 0, [], [], []
        if chunks or len(counts):
            counts = _added(counts, chunks)
            yield row(counts)

    return run


def _added(counts: np.ndarray, chunks: list[np.ndarray]) -> np.ndarray:
    if not chunks:
        return counts
    more = np.bincount(np.concatenate(chunks))
    if len(more) > len(counts):
        more[: len(counts)] += counts
        return more
    counts[: len(more)] += more
    return counts


_CHUNK = pa.schema([
    ("part", pa.int32()), ("number", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("ids", pa.binary()), ("seen", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())),
])
_BLOCK = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary())])
_CHUNK_DDL = "part int, number int, before long, n long, docs array<long>, lengths array<long>, ids binary, seen array<int>, counts array<long>"


def write(docs: DataFrame, out: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> str:
    """Tokenise ``docs`` and write them to folder ``out`` in ascending order of id (nulls
    first, equal ids by text hash). Null and empty texts have the end id alone; repeated
    rows are written each; an empty table gives an empty file set. Ids are whole numbers
    above -2^63 (which stands for null in the files); other types are refused. Other
    columns are not read."""
    spark = docs.sparkSession
    batched(spark)
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids must be whole numbers: {id_col}")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    # many documents of one id are dealt by their texts, and by row where these are equal too
    rows = rows.withColumns({"_hash": F.xxhash64("_text"), "_row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("_id", "_hash", "_row").sortWithinPartitions("_id", "_hash").drop("_hash", "_row")
    chunks_path = new_path(spark, "tokens")
    rows.mapInArrow(_tokenised(tokenizer_path, end), _CHUNK_DDL).write.option("compression", "zstd").parquet(chunks_path)
    chunks = spark.read.schema(_CHUNK_DDL).parquet(chunks_path)
    seen = chunks.where(F.size("seen") > 0).select(F.explode(F.arrays_zip("seen", "counts")).alias("x"))
    # one row for each id of the vocabulary at most
    counts = {r["s"]: r["c"] for r in seen.groupBy(F.col("x.seen").alias("s")).agg(F.sum("x.counts").alias("c")).collect()}
    symbols, freq = quantised(counts)
    table = [(SCALE, symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes())]
    spark.createDataFrame(table, "scale int, symbols binary, freq binary").coalesce(1).write.parquet(f"{out}/table")
    # a row for each chunk, of which there are a few per task; running sums go by part first
    sizes = chunks.groupBy("part").agg(F.sum("n").alias("n")).collect()
    base, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        base[r["part"]], total = total, total + r["n"]
    held = spark.sparkContext.broadcast((symbols, freq, base))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, freq, base = held.value
        coder = None
        for batch in batches:
            coder = coder or Coder(symbols, freq)
            for r in range(batch.num_rows):
                x = {k: batch.column(j)[r] for j, k in enumerate(("part", "number", "before", "docs", "lengths", "ids"))}
                part, number = x["part"].as_py(), x["number"].as_py()
                ids = np.frombuffer(x["ids"].as_buffer(), dtype="<u4")
                if len(ids):
                    start = base[part] + x["before"].as_py()
                    data = block_bytes(coder, ids, x["docs"].values.to_numpy(), x["lengths"].values.to_numpy(), start)
                    yield pa.RecordBatch.from_pylist([{"part": part, "number": number, "start": start, "n": len(ids), "bytes": data}], schema=_BLOCK)

    blocks = chunks.select("part", "number", "before", "docs", "lengths", "ids")
    blocks.mapInArrow(coded, "part int, number int, start long, n long, bytes binary").write.option("compression", "none").parquet(f"{out}/blocks")
    removed(spark, chunks_path)
    return out


def read_back(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode a file set in parallel by blocks: ``doc_id, start, n_tokens, ids_crc32``
    and, if asked for, ``ids``."""
    t = spark.read.parquet(f"{path}/table").first()
    held = spark.sparkContext.broadcast((t["scale"], np.frombuffer(t["symbols"], "<u4"), np.frombuffer(t["freq"], "<u4")))
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, symbols, freq = held.value
        coder = None
        for batch in batches:
            coder = coder or Coder(symbols, freq, scale)
            for data in batch.column(0):
                h, docs, lengths, ids = read_block(coder, data.as_buffer().to_pybytes())
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                raw = ids.astype("<u4").tobytes()
                out = {
                    "doc_id": pa.array(docs, pa.int64(), mask=docs == NO_ID),
                    "start": pa.array(starts + h["start"], pa.int64()),
                    "n_tokens": pa.array(lengths.astype(np.int64), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(out)

    return spark.read.parquet(f"{path}/blocks").select("bytes").mapInArrow(decoded, ddl)


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = new_path(spark, "token-files")
    write(read(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"))
    return read_back(spark, out)
