"""Packing: concatenate and cut.

First pass: tokenize once, each task writing its documents' ids with a running token count. The
partitions' totals (one row each) give every partition its global offset by a prefix sum. Second
pass, JVM only: a document's global range is cut at multiples of the window; pieces at a cut are
the boundary records. All sequences but the last are full.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Generations, materialize, regrouped, relax, ship, small_batches, table

WINDOW, EOS = 2048, 1
#: Pre-tokens and words whose ids a worker keeps.
CACHE = 200_000
#: Characters of text handled at once.
SLICE_CHARS = 4_000_000

_STATE: dict = {}


def _byte_level() -> list[str]:
    """The character that stands for each byte, by the library's alphabet: a byte whose own character
    is in it stands for itself, the rest follow in order."""
    from tokenizers.pre_tokenizers import ByteLevel

    alphabet = sorted(ByteLevel.alphabet())
    others = iter([c for c in alphabet if ord(c) > 255])
    return [chr(b) if chr(b) in alphabet else next(others) for b in range(256)]


class WordTokenizer:
    """Ids by a tokenizers file whose pre-tokenizer drops white space, so that no token spans an
    ASCII space or line feed: texts are split there and each distinct word is encoded once.

    A Latin-1 word is lower-cased and split into pre-tokens here, so that the library's model sees
    each pre-token once; any other word goes through the whole library pipeline.
    """

    def __init__(self, path: str) -> None:
        import json

        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        steps = json.loads(self.whole.to_str())["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(next(x["pattern"]["Regex"] for x in steps if x["type"] == "Split")).findall
        self.byte_level = {b: c for b, c in zip(range(256), _byte_level(), strict=True)}
        self.known = Generations(CACHE)

    def piece(self, p: str) -> bytes:
        got = self.known.get(p)
        if got is None:
            mapped = p if p.isascii() and p.isprintable() else "".join(self.byte_level[b] for b in p.encode())
            got = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
            self.known.put(p, got)
        return got

    def words(self, words: list[str]) -> list[bytes]:
        self.known.turn()
        out, piece = [], self.piece
        fresh, stale = self.known.fresh, self.known.stale
        for w in words:
            if not (w.isascii() or max(w) <= "\u00ff") or "<|" in w:
                out.append(array("I", self.whole.encode(w, add_special_tokens=False).ids).tobytes())
                continue
            w = w.lower()
            got = fresh.get(w)
            if got is None:
                got = stale.get(w)
                if got is None:
                    got = piece(w) if w.isalpha() else b"".join(map(piece, self.pieces(w)))
                fresh[w] = got
            out.append(got)
        return out

    def encode(self, texts: pa.Array) -> pa.Array:
        """Little-endian unsigned 32-bit ids of each text; null: none."""
        import pyarrow.compute as pc

        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        split = pc.split_pattern(texts, " ")
        coded = split.values.dictionary_encode()
        ids = pa.array(self.words(coded.dictionary.to_numpy(zero_copy_only=False)), pa.binary())
        return pc.binary_join(pa.ListArray.from_arrays(split.offsets, ids.take(coded.indices)), b"")


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _STATE:
        _STATE[path] = WordTokenizer(path)
    return _STATE[path]


def _forget() -> None:
    """Between tasks a worker keeps the tokenizer, not the words."""
    for t in _STATE.values():
        t.known = Generations(CACHE)
    relax()


def tokenize_partitions(docs: DataFrame, tokenizer_path: str, eos: int = EOS, make: Callable = word_tokenizer) -> DataFrame:
    """(doc_id, ids binary, doc_tokens, part, local_start) in scan order, one pass."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, at, tok = TaskContext.get().partitionId(), 0, make(tokenizer_path)
        tail = int(eos).to_bytes(4, "little")
        for b in regrouped(batches, "text", SLICE_CHARS):
            joined = pc.binary_join_element_wise(tok.encode(b.column("text")), tail, b"")
            n = np.asarray(pc.binary_length(joined), dtype=np.int64) // 4
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), joined, pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n)],
                ["doc_id", "ids", "doc_tokens", "part", "local_start"],
            )
            at = int(ends[-1])
        _forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, doc_tokens long, part int, local_start long")


def cut(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces of tokenized documents: start, length, sequence_id, offset, ids of the piece.

    tokens is read twice, so it must be a written table. The totals have one row per partition.
    """
    totals = tokens.groupBy("part").agg(F.max(F.col("local_start") + F.col("doc_tokens")).alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(bases), "part").withColumn("g", F.col("base") + F.col("local_start"))
    last = F.floor((F.col("g") + F.col("doc_tokens") - 1) / window)
    pieces = placed.withColumn("sequence_id", F.explode(F.sequence(F.floor(F.col("g") / window), last)))
    begin = F.greatest(F.col("g"), F.col("sequence_id") * window)
    end = F.least(F.col("g") + F.col("doc_tokens"), (F.col("sequence_id") + 1) * window)
    pieces = pieces.withColumn("start", begin - F.col("g")).withColumn("length", end - begin).withColumn("offset", begin - F.col("sequence_id") * window)
    piece = F.substring(F.col("ids"), (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return pieces.select("doc_id", "start", "length", piece.alias("piece_ids"), "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, eos: int = EOS) -> DataFrame:
    """Pack whole documents (null text: empty, so its end id alone) into windows of token ids.

    Every id lies in exactly one piece, sequences are gapless from 0 and all but the last are full,
    so nothing is padded but the last. Repeated rows are documents of their own; an empty table
    gives no pieces; other columns are ignored.
    """
    tokens = materialize(tokenize_partitions(docs, tokenizer_path, eos), "tokens")
    return cut(tokens, window)


def piece_rows(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    return pack(docs, tokenizer_path).select(
        "doc_id", "start", "length", F.crc32("piece_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """Pack all documents by the word tokenizer into windows of 2048."""
    import public_tokenizers

    return piece_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
