"""Token files: ids as blocks of a static range asymmetric numeral system.

A folder holds `table`, the frequencies that all blocks share, and `blocks`, a Parquet table with
one row for each block: where it starts among all ids, its documents and their lengths, and the
coded ids. A block is coded on its own, its ids dealt over interleaved lanes whose states move
together as one NumPy vector. Every STRIDE steps a checkpoint keeps the lanes' states and the place
in the words, so that the stretches of a block are decoded side by side, or one of them alone.
Checksums of the coded bytes, of the ids and of the table tell damage and mistaken tables.

Layout of a block, little-endian: magic, version, lanes, steps from checkpoint to checkpoint, ids,
place of the first id among all, checkpoints, words, crc32 of the ids, of the table and of the rest
of the block; then the checkpoints' places in the words (64 bits each), their states (64 bits for
each lane) and the words (32 bits each).

Ids follow the ascending doc_id. Documents are dealt by ranges of it, each range is tokenized in
order with a running count, and the ranges' totals, one row each, give the places among all ids.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Generations, discard, materialize, regrouped, relax, ship, small_batches, table, work_dir

EOS = 2
#: Frequencies sum to 2 to this power; ids of a block, from which on it is closed; its lanes at most; steps from checkpoint to checkpoint.
PRECISION, BLOCK_IDS, LANES, STRIDE = 20, 1 << 19, 1024, 256
#: Words whose ids a worker keeps, bytes of text handled at once.
KEEP, SLICE_BYTES = 400_000, 5_000_000
#: Units that the library gets as one text; marks that are cut from words.
JOINED, MARKS = 64, ".,;:!?"

MAGIC, VERSION = b"LFTK", 1
MISSING = "an id that the table of frequencies doesn't have"
_HEAD = struct.Struct("<4sHHIQQIIIII")
#: States lie in [LOW, LOW << 32).
LOW = np.uint64(1 << 31)
_WORD, _MASK = np.uint64(32), np.uint64((1 << 32) - 1)

_STATE: dict = {}


# ---- ids of texts


class ByteTokenizer:
    """Ids by a tokenizers file with a byte-level pre-tokenizer.

    Its pattern never matches across a place between a character that isn't white space and a
    space. So texts are cut there, and the library encodes each distinct word with its space once.
    A text with one of the file's special strings, and any text where the file's pre-tokenizer is
    another one, goes to the library whole.
    """

    #: White space by any of the engines' definitions; where in doubt a place is not cut.
    SPACES = "\\s\x0b\x1c-\x1f\x85\\p{Z}\u180e"

    def __init__(self, path: str) -> None:
        import json

        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        told = json.loads(self.whole.to_str())
        pre = told["pre_tokenizer"] or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and told["normalizer"] is None
        self.specials = [t["content"] for t in told["added_tokens"]]
        self.units = regex.compile(f"(?<=[^{self.SPACES}])(?= )", regex.V1).split
        self.spaced = np.zeros(max(self.whole.get_vocab().values(), default=0) + 1, bool)
        self.spaced[[i for t, i in self.whole.get_vocab().items() if t.startswith("\u0120")]] = True  # a space, byte-level
        self.known = Generations(KEEP)

    def _coded(self, units: list[str]) -> list[bytes]:
        """Ids of units, all by the library. Those that start with their only space and don't end in
        white space are put in a row and cut again where an id's token starts with a space."""
        out: list[bytes] = [b""] * len(units)
        row = [k for k, u in enumerate(units) if u[:1] == " " and not u[-1:].isspace() and " " not in u[1:]]
        texts = ["".join(units[k] for k in row[at : at + JOINED]) for at in range(0, len(row), JOINED)]
        if row:
            ids = np.array(list(chain.from_iterable(e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False))), "<u4")
            begins = np.flatnonzero(self.spaced[ids])
            if len(begins) != len(row):
                raise ValueError("the tokenizer doesn't cut at spaces")
            raw, ends = ids.tobytes(), [*(4 * begins[1:]).tolist(), 4 * len(ids)]
            for k, i, j in zip(row, (4 * begins).tolist(), ends, strict=True):
                out[k] = raw[i:j]
        taken = set(row)
        rest = [k for k in range(len(units)) if k not in taken]
        for k, e in zip(rest, self.whole.encode_batch_fast([units[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, "<u4").tobytes()
        return out

    def _ids(self, units: list[str]) -> list[bytes]:
        """Of distinct units, remembered."""
        fresh, stale = self.known.fresh, self.known.stale
        out = list(map(fresh.get, units))
        missing = [k for k, got in enumerate(out) if got is None]
        old = list(map(stale.get, [units[k] for k in missing]))
        new = [units[k] for k, got in zip(missing, old, strict=True) if got is None]
        coded = iter(self._coded(new))
        for k, got in zip(missing, old, strict=True):
            out[k] = fresh[units[k]] = next(coded) if got is None else got
        return out

    def _words(self, words: pa.Array, lead: str) -> pa.Array:
        """Ids of words behind `lead`. Marks behind a letter are coded apart, as no token spans the two."""
        stems = pc.utf8_rtrim(words, MARKS)
        cut = pc.and_(pc.not_equal(pc.binary_length(stems), pc.binary_length(words)), pc.match_substring_regex(stems, r"\p{L}\z"))
        marks = pc.replace_substring_regex(words.filter(cut), f"(?s)^.*[^{MARKS}]", "")
        ids = self._of(pc.if_else(cut, stems, words), lead)
        at = np.cumsum(np.asarray(cut)) - 1
        behind = self._of(marks, "").take(pa.array(at, mask=~np.asarray(cut)))
        return pc.if_else(cut, pc.binary_join_element_wise(ids, pc.fill_null(behind, b""), b""), ids)

    def _of(self, words: pa.Array, lead: str) -> pa.Array:
        d = words.dictionary_encode()
        return pa.array(self._ids([lead + x for x in d.dictionary.to_pylist()]), pa.binary()).take(d.indices)

    @staticmethod
    def _split(texts: pa.Array, without: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
        """Texts at their spaces: offsets of each one's words, and the words; some texts are taken as empty."""
        split = pc.split_pattern(pc.if_else(pa.array(without), "", texts) if without.any() else texts, " ")
        offsets = np.asarray(split.offsets)
        return offsets - offsets[0], split.flatten().dictionary_encode()

    def _odd(self, offsets: np.ndarray, coded: pa.DictionaryArray) -> np.ndarray:
        """Whether a space of a text follows white space, so that it can't be cut there: a word before the
        last one is empty but at the start, or ends with white space."""
        ends = np.asarray(pc.match_substring_regex(coded.dictionary, f"(^|[{self.SPACES}])\\z"))
        if not ends.any():
            return np.zeros(len(offsets) - 1, bool)
        marked = ends[np.asarray(coded.indices)]
        marked[offsets[1:] - 1] = False
        starts = offsets[:-1]
        empty = np.asarray(pc.equal(coded.dictionary, ""))[np.asarray(coded.indices)[starts]]
        marked[starts[empty]] = False
        return np.add.reduceat(marked, starts) > 0

    def encode(self, texts: pa.Array) -> pa.Array:
        """Little-endian unsigned 32-bit ids of each text; null: none."""
        self.known.turn()
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)
        for s in self.specials:
            whole |= np.asarray(pc.match_substring(texts, s))
        if not self.cuts:
            whole[:] = True
        offsets, coded = self._split(texts, whole)
        odd = self._odd(offsets, coded)
        apart = np.flatnonzero(whole | odd)
        if odd.any():
            offsets, coded = self._split(texts, whole | odd)
        index = np.asarray(coded.indices).astype(np.int64)
        words = coded.dictionary
        # a text's first word has no space before it
        first = offsets[:-1]
        heads, place = np.unique(index[first], return_inverse=True)
        index[first] = len(words) + place
        ids = pa.concat_arrays([self._words(words, " "), self._words(words.take(pa.array(heads)), "")])
        out = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids.take(pa.array(index))), b"")
        if not len(apart):
            return out
        out = out.to_pylist()
        for k in apart:
            t = texts[k].as_py()
            out[k] = np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if whole[k] else b"".join(self._ids(self.units(t)))
        return pa.array(out, pa.binary())


def _tokenizer(path: str) -> ByteTokenizer:
    if path not in _STATE:
        _STATE[path] = ByteTokenizer(path)
    return _STATE[path]


def _narrow(ids: np.ndarray) -> np.ndarray:
    """Two bytes an id where they are enough for a batch."""
    return ids.astype("<u2") if not len(ids) or int(ids.max()) < 1 << 16 else ids


def tokens(docs: DataFrame, tokenizer_path: str, eos: int = EOS) -> DataFrame:
    """(doc_id, ids, width, n, part, local_start): ids of `width` bytes each, in ascending order of
    doc_id from part to part and within a part."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, tok = TaskContext.get().partitionId(), 0, _tokenizer(tokenizer_path)
        tail = int(eos).to_bytes(4, "little")
        for b in regrouped(batches, "text", SLICE_BYTES):
            joined = pc.binary_join_element_wise(tok.encode(b.column("text")), tail, b"")
            n = np.asarray(pc.binary_length(joined), dtype=np.int64) // 4
            ids = _narrow(_bytes(joined).view("<u4"))
            width, ends = ids.dtype.itemsize, np.cumsum(n)
            places = np.concatenate([[0], ends * width]).astype(np.int32)
            cut = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(ids))])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), cut, pa.array(np.full(len(n), width, np.int32)), pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(at + ends - n)],
                ["doc_id", "ids", "width", "n", "part", "local_start"],
            )
            at += int(ends[-1])
        for t in _STATE.values():
            t.known = Generations(KEEP)
        relax()

    return dealt.mapInArrow(run, f"doc_id {kind}, ids binary, width int, n long, part int, local_start long")


def _bytes(a: pa.Array) -> np.ndarray:
    """All bytes of a binary array in a row."""
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]


def _joined_ids(b: pa.RecordBatch) -> np.ndarray:
    """The ids of a batch's rows in a row."""
    widths, ids = np.unique(np.asarray(b.column("width"))), b.column("ids")
    if len(widths) == 1:
        return _bytes(ids).view(f"<u{widths[0]}")
    parts = [np.frombuffer(x, f"<u{w}").astype("<u4") for x, w in zip(ids.to_pylist(), b.column("width").to_pylist(), strict=True)]
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


# ---- the shared table


@dataclass(frozen=True)
class Frequencies:
    """ids ascending, their frequencies (summing to 2^PRECISION), and what coding looks up."""

    ids: np.ndarray
    freq: np.ndarray

    @property
    def crc(self) -> int:
        return zlib.crc32(np.concatenate([self.ids, self.freq]).astype("<u8").tobytes())

    @cached_property
    def _places(self) -> np.ndarray:
        """By id, where ids are those of a vocabulary and so below its size: its place, or -1."""
        out = np.full(int(self.ids[-1]) + 1, -1, np.int32)
        out[self.ids.astype(np.int64)] = np.arange(len(self.ids))
        return out

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        """Places of ids in the table."""
        if not len(ids):
            return np.zeros(0, np.int64)
        if not len(self.ids) or int(ids.max()) > int(self.ids[-1]):
            raise ValueError(MISSING)
        out = self._places[ids] if int(self.ids[-1]) < 1 << 24 else np.searchsorted(self.ids, ids)
        if (out < 0).any() or (self.ids[out] != ids).any():
            raise ValueError(MISSING)
        return out

    @cached_property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.freq) - self.freq


def frequencies(counts: dict[int, int]) -> Frequencies:
    """Every id that occurs has a frequency of one at least; what rounding leaves goes to the most
    frequent ids, and what it takes too much comes from them."""
    whole = 1 << PRECISION
    ids = np.array(sorted(counts), np.uint64)
    if not len(ids):
        return Frequencies(ids, ids.copy())
    if len(ids) > whole // 2:
        raise ValueError(f"{len(ids)} different ids are too many for {PRECISION} bits")
    n = [counts[int(i)] for i in ids]
    total = sum(n)
    freq = np.array([max(1, k * whole // total) for k in n], np.int64)
    rest = whole - int(freq.sum())
    for k in np.lexsort((ids, -freq)):
        if not rest:
            break
        step = rest if rest > 0 else -min(-rest, int(freq[k]) // 2)
        freq[k] += step
        rest -= step
    if rest:
        raise ValueError("the frequencies can't be rounded")
    return Frequencies(ids, freq.astype(np.uint64))


def count_ids(coded: DataFrame) -> DataFrame:
    """(id, n) over all documents; each task sends a row for each id it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            got = np.bincount(_joined_ids(b)) if b.num_rows else total[:0]
            if len(got) > len(total):
                got[: len(total)] += total
                total = got
            else:
                total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return coded.select("ids", "width").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# ---- one block


def lanes_of(n: int) -> int:
    """A power of two, so that a lane has some 64 ids or there are LANES of them."""
    return min(LANES, 1 << max(0, (n // 64).bit_length() - 1))


def encode_block(ids: np.ndarray, start: int, table: Frequencies, stride: int = STRIDE) -> bytes:
    n, lanes = len(ids), lanes_of(len(ids))
    steps = -(-n // lanes)
    symbols = table.symbols(np.asarray(ids))
    if steps * lanes > n:  # the last step is filled with the commonest id
        symbols = np.concatenate([symbols, np.full(steps * lanes - n, int(table.freq.argmax()))])
    symbols = symbols.reshape(steps, lanes)
    starts, shift = table.starts, np.uint64(PRECISION)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []  # from the last step to the first
    sizes = np.zeros(steps + 1, np.int64)
    states = []
    for begin in range((max(steps, 1) - 1) // stride * stride, -1, -stride):
        rows = symbols[begin : begin + stride]
        f, c = table.freq[rows], starts[rows]
        top = f << np.uint64(63 - PRECISION)
        for t in range(len(rows) - 1, -1, -1):
            full = state >= top[t]
            if full.any():
                out = state[full]
                words.append((out & _MASK).astype("<u4"))
                sizes[begin + t] = len(out)
                state[full] = out >> _WORD
            q = state // f[t]
            state = (q << shift) + (state - q * f[t]) + c[t]
        states.append(state.copy())
    states = np.array(states[::-1], "<u8").reshape(-1, lanes)
    places = (np.cumsum(sizes) - sizes)[: max(steps, 1) : stride].astype("<u8")
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    body = places.tobytes() + states.tobytes() + stream.tobytes()
    head = (MAGIC, VERSION, lanes, stride, n, start, len(places), len(stream), zlib.crc32(np.asarray(ids, "<u4").tobytes()), table.crc)
    return _HEAD.pack(*head, zlib.crc32(struct.pack("<4sHHIQQIIII", *head) + body)) + body


class Decoder:
    """Blocks of one table."""

    def __init__(self, table: Frequencies) -> None:
        self.crc, self.ids = table.crc, table.ids.astype("<u4")
        slots = np.arange(len(table.ids), dtype=np.uint32)
        self.slot = np.repeat(slots, table.freq.astype(np.int64))
        self.freq, self.starts = table.freq, table.starts

    def decode(self, block: bytes, first: int = 0, last: int | None = None) -> tuple[int, np.ndarray]:
        """(place among all ids, ids) of the block, or of its ids from `first` to before `last` and
        what shares their stretches. Stretches are decoded side by side, each from its checkpoint."""
        if len(block) < _HEAD.size or block[:4] != MAGIC:
            raise ValueError("not a block of a token file")
        *head, crc = _HEAD.unpack_from(block)
        _, version, lanes, stride, n, start, marks, n_words, ids_crc, table_crc = head
        if version != VERSION:
            raise ValueError(f"version {version} of a token file")
        if zlib.crc32(block[_HEAD.size :], zlib.crc32(block[: _HEAD.size - 4])) != crc:
            raise ValueError(f"the block at {start} is damaged")
        if table_crc != self.crc:
            raise ValueError(f"the block at {start} belongs to another table of frequencies")
        if not n:
            return start, np.zeros(0, "<u4")
        at = _HEAD.size
        places = np.frombuffer(block, "<u8", marks, at).astype(np.int64)
        states = np.frombuffer(block, "<u8", marks * lanes, at + 8 * marks).reshape(marks, lanes)
        words = np.frombuffer(block, "<u4", n_words, at + 8 * marks * (1 + lanes))
        per = stride * lanes
        low, high = max(0, first) // per, -(-min(n, n if last is None else last) // per)
        out = self._stretches(states[low:high], places[low:high], words, -(-n // lanes) - low * stride, stride)
        out = out[: min(n - low * per, len(out))]
        if (low, high) == (0, marks) and zlib.crc32(out.tobytes()) != ids_crc:
            raise ValueError(f"the ids of the block at {start} aren't those written")
        return start + low * per, out

    def _stretches(self, states: np.ndarray, places: np.ndarray, words: np.ndarray, steps: int, stride: int) -> np.ndarray:
        count, lanes = states.shape
        if not count:
            return np.zeros(0, "<u4")
        state, at = states.astype(np.uint64), places.copy()
        words = np.append(words.astype(np.uint64), np.uint64(0))
        mask, shift = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION)
        final = min(stride, steps - (count - 1) * stride)  # steps of the last stretch
        got = np.zeros((stride, count, lanes), np.uint32)
        for t in range(stride if count > 1 else final):
            if t == final:
                state, at = state[:-1], at[:-1]
            low = state & mask
            s = self.slot[low]
            got[t, : len(s)] = s
            state = self.freq[s] * (state >> shift) + low - self.starts[s]
            dry = state < LOW
            if dry.any():
                place = dry.cumsum(1)
                taken = words[np.minimum(at[:, None] + place - 1, len(words) - 1)]
                state = np.where(dry, (state << _WORD) | taken, state)
                at = at + place[:, -1]
        return self.ids[got.transpose(1, 0, 2).reshape(-1)[: ((count - 1) * stride + final) * lanes]]


# ---- files


def write_tokens(coded: DataFrame, path: str, block_ids: int = BLOCK_IDS) -> None:
    """Write documents' ids (a written table of tokens()) to a folder, in blocks of whole documents
    that are closed once they hold block_ids."""
    spark = coded.sparkSession
    counts = count_ids(coded)
    table = frequencies({r["id"]: r["n"] for r in counts.collect()})  # one row for each id of the vocabulary
    rows = [(int(i), int(f)) for i, f in zip(table.ids, table.freq, strict=True)]
    spark.createDataFrame(rows, "id long, freq long").coalesce(1).write.parquet(f"{path}/table")
    totals = coded.groupBy("part").agg(F.max(F.col("local_start") + F.col("n")).alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    placed = coded.join(F.broadcast(bases), "part").select("doc_id", "ids", "width", "n", (F.col("base") + F.col("local_start")).alias("start"))
    shared = spark.sparkContext.broadcast(table)
    kind = coded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        held: list[pa.RecordBatch] = []
        size, end = 0, None

        def block() -> pa.RecordBatch:
            b = pa.concat_batches(held)
            ids, start = _joined_ids(b).astype("<u4"), b.column("start")[0].as_py()
            list_of = lambda c, kind: pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c).cast(kind))
            return pa.RecordBatch.from_arrays(
                [pa.array([start]), pa.array([len(ids)], pa.int64()), list_of("doc_id", b.column("doc_id").type), list_of("n", pa.int64()), pa.array([encode_block(ids, start, table)], pa.binary())],
                ["start", "n_ids", "doc_ids", "lengths", "block"],
            )

        for b in batches:
            starts, n = np.asarray(b.column("start")), np.asarray(b.column("n"))
            at = 0
            for k in range(b.num_rows):
                if end is not None and starts[k] != end or size >= block_ids:  # another stretch of documents, or full
                    if k > at:
                        held.append(b.slice(at, k - at))
                    yield block()
                    held, size, at = [], 0, k
                size, end = size + int(n[k]), starts[k] + n[k]
            if b.num_rows > at:
                held.append(b.slice(at))
        if held:
            yield block()

    placed.mapInArrow(run, f"start long, n_ids long, doc_ids array<{kind}>, lengths array<long>, block binary").write.option("compression", "none").parquet(f"{path}/blocks")


def _decoder(spark: SparkSession, path: str):
    rows = spark.read.schema("id long, freq long").parquet(f"{path}/table").orderBy("id").collect()  # the vocabulary
    ids = np.array([r["id"] for r in rows], np.uint64)
    return spark.sparkContext.broadcast(Frequencies(ids, np.array([r["freq"] for r in rows], np.uint64)))


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document of a folder; ids: little-endian
    unsigned 32-bit, left out unless asked for."""
    blocks = spark.read.parquet(f"{path}/blocks")
    shared = _decoder(spark, path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for b in batches:
            for k in range(b.num_rows):
                decoder = decoder or Decoder(shared.value)
                one = b.slice(k, 1)
                start, ids = decoder.decode(one.column("block")[0].as_py())
                n = np.asarray(one.column("lengths").flatten())
                ends = np.cumsum(n)
                raw = memoryview(ids.tobytes())
                each = [raw[4 * (e - m) : 4 * e] for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                columns = [one.column("doc_ids").flatten(), pa.array(start + ends - n), pa.array(n), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                if keep_ids:
                    columns.append(pa.array([bytes(x) for x in each], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return blocks.select("doc_ids", "lengths", "block").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(start, ids): the ids at places first to before last among all, in pieces; blocks elsewhere
    aren't read, nor stretches of a block decoded that hold none of them."""
    blocks = spark.read.parquet(f"{path}/blocks").where((F.col("start") < last) & (F.col("start") + F.col("n_ids") > first))
    shared = _decoder(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for b in batches:
            for begin, block in zip(b.column("start").to_pylist(), b.column("block").to_pylist(), strict=True):
                decoder = decoder or Decoder(shared.value)
                start, ids = decoder.decode(block, first - begin, last - begin)
                ids = ids[max(0, first - start) : last - start]
                yield pa.RecordBatch.from_arrays([pa.array([max(first, start)]), pa.array([ids.tobytes()], pa.binary())], ["start", "ids"])

    return blocks.select("start", "block").mapInArrow(run, "start long, ids binary")


def write_documents(docs: DataFrame, tokenizer_path: str, path: str, eos: int = EOS, block_ids: int = BLOCK_IDS) -> None:
    """Tokenize whole documents (null text: empty, so its end id alone) and write them to a folder.

    Repeated rows are documents of their own; documents of one doc_id follow one another, a null one
    comes first. An empty table gives a folder without blocks; other columns are ignored.
    """
    coded = materialize(tokens(docs, tokenizer_path, eos), "token-rows")
    write_tokens(coded, path, block_ids)
    discard(coded)


def op13_token_files(spark, sf_dir: str) -> DataFrame:
    """Write all documents' ids to token files and read them back."""
    import public_tokenizers

    path = f"{work_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_tokens(spark, path, keep_ids=False)
