"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database per partition.

A partition's distinct words become rows (word, position, token). A recursive query joins each
token and its right neighbour with the merge table and contracts each word's leftmost pair of
least rank, until no word has a pair left. Words that are tokens themselves need no step, and very
long ones are contracted in windows whose seams are then settled.
Decoding joins tokens with their bytes and puts them in order by an ordered aggregate. Texts keep
their words as codes, so a word that occurs a million times is encoded and decoded once.
"""

from __future__ import annotations

import base64
import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import Generations, regrouped, relax, ship, small_batches, table

#: Words a worker keeps, bytes of text handled at once. Bytes of a word that the recursion contracts
#: whole, tokens beside a seam of longer ones, squares of word lengths that a query works on.
KEEP, SLICE_CHARS = 400_000, 8_000_000
WIDEST, SEAM, SQUARES = 256, 4, 30_000_000

_CODERS: dict[tuple[str, str], Coder] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: New tokens of each step; a token's place tells its word, and nxt is the place of its right
#: neighbour. The least (id, place) of a word's pairs is its leftmost pair of least rank.
_CONTRACT = """
with recursive t as (
  select 0 as step, w, pos, nxt, id from start
  union all
  (with pair as (
     select a.w, b.pos as gone, b.nxt as after, m.id::bigint * 4294967296 + a.pos as k
     from t a join t b on a.nxt = b.pos join merges m on m.l = a.id and m.r = b.id),
   best as (select w, min(k) as k, arg_min(gone, k) as gone, arg_min(after, k) as after from pair group by w)
   select t.step + 1, t.w, t.pos, case when t.pos = m.k & 4294967295 then m.after else t.nxt end,
     case when t.pos = m.k & 4294967295 then (m.k >> 32)::int else t.id end
   from t join best m on t.w = m.w where t.pos <> m.gone))
select w, list(id order by pos) as ids from t join (select w, max(step) as step from t group by w) using (w, step) group by w
"""

_DECODE = """
select w, string_agg(id::varchar, ' ' order by x.at) as shown, string_agg(v.hex, '' order by x.at) as hex
from (select w, unnest(ids) as id, generate_subscripts(ids, 1) as at from found) x join vocabulary v using (id)
group by w
"""


class Coder:
    """The merge table of a rank file in a DuckDB database of its own, and words coded so far."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        spill = os.path.join(tempfile.gettempdir(), "duckdb")
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": spill, "max_temp_directory_size": "4GB"})
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (self.ranks[t[:i]], self.ranks[t[i:]], r)
            for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        l, r, m = np.array(pairs, np.int32).T
        self._load("merges", {"l": pa.array(l), "r": pa.array(r), "id": pa.array(m)})
        self._load("vocabulary", {"id": pa.array(list(self.ranks.values()), pa.int32()), "hex": pa.array([t.hex() for t in self.ranks])})
        # by pre-token: (decimal ids joined by a space, decoded bytes)
        self.known = Generations(KEEP)

    def _load(self, name: str, columns: dict[str, pa.Array]) -> None:
        t = pa.table(columns)
        self.db.register("incoming", t)
        self.db.execute(f"create or replace temp table {name} as select * from incoming")
        self.db.unregister("incoming")

    def _contract(self, words: list[bytes], first: int = 0) -> None:
        """Add (w, ids) of each word (not empty), numbered from `first`, to found, by the recursive query."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        w = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = np.arange(int(sizes.sum()), dtype=np.int64)
        last = np.zeros(len(pos), bool)
        last[np.cumsum(sizes) - 1] = True
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        self._load("start", {"w": pa.array(w + np.int32(first)), "pos": pa.array(pos), "nxt": pa.array(np.where(last, -1, pos + 1)), "id": pa.array(ids)})
        self.db.execute(f"insert into found {_CONTRACT}")

    def _found(self, words: list[bytes]) -> None:
        """Make found, (w, ids) of each word, in queries of bounded size."""
        self.db.execute("create or replace temp table found (w int, ids int[])")
        # squares of the lengths bound the rows of the recursion
        work = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) ** 2) // SQUARES
        cuts = [0, *(np.flatnonzero(np.diff(work)) + 1).tolist(), len(words)] if words else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            self._contract(words[a:b], a)

    def contract(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word (not empty)."""
        self._found(words)
        out: list[list[int]] = [[]] * len(words)
        for i, got in self.db.execute("select w, ids from found").fetchall():
            out[i] = got
        return out

    def contract_long(self, word: bytes) -> list[int]:
        """Token ids of a word of any length, at a cost that grows with the length.

        Tokens are the encoding of their bytes if each two neighbours are that of theirs. So windows
        are coded apart and only the tokens around each seam anew; where the new ones don't fit
        their neighbours, more tokens are taken in on that side.
        """
        known: dict[bytes, list[int]] = {}

        def codes(texts: list[bytes]) -> list[list[int]]:
            new = [x for x in dict.fromkeys(texts) if x not in known]
            if new:
                known.update(zip(new, self.contract(new), strict=True))
            return [known[x] for x in texts]

        join = lambda ids: b"".join(map(self.bytes_of.__getitem__, ids))
        windows = codes([word[i : i + WIDEST] for i in range(0, len(word), WIDEST)])
        # most seams settle at once: what they need is coded together
        seams = list(zip(windows, windows[1:], strict=False))
        around = codes([join(a[-SEAM:] + b[:SEAM]) for a, b in seams])
        codes([join([a[-SEAM - 1], m[0]]) for (a, _), m in zip(seams, around, strict=True) if len(a) > SEAM])
        codes([join([m[-1], b[SEAM]]) for (_, b), m in zip(seams, around, strict=True) if len(b) > SEAM])
        fit = lambda a, b: codes([join([a, b])])[0] == [a, b]
        out = list(windows[0])
        for b in windows[1:]:
            l = r = SEAM
            while True:
                m = codes([join(out[-l:] + b[:r])])[0]
                left, right = len(out) <= l or fit(out[-l - 1], m[0]), len(b) <= r or fit(m[-1], b[r])
                if left and right:
                    out[-l:] = m + b[r:]
                    break
                l, r = l if left else 2 * l, r if right else 2 * r
        return out

    def _shown(self) -> pa.Table:
        """(w, shown, hex) of found: decimal ids and decoded bytes, by an ordered aggregate."""
        return self.db.sql(_DECODE).to_arrow_table()

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """Bytes of each list of ids."""
        self._load("found", self._lists(range(len(ids)), ids))
        out, got = [b""] * len(ids), self._shown()
        for i, text in zip(got["w"].to_pylist(), got["hex"].to_pylist(), strict=True):
            out[i] = bytes.fromhex(text)
        return out

    def _lists(self, w, ids: list[list[int]]) -> dict[str, pa.Array]:  # noqa: ANN001
        flat = pa.array(np.fromiter((i for x in ids for i in x), np.int32))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        return {"w": pa.array(np.fromiter(w, np.int32, len(ids))), "ids": pa.ListArray.from_arrays(pa.array(offsets), flat)}

    def learn(self, words: list[str]) -> None:
        """Code the words that aren't known yet."""
        known = self.known.get
        new = [x for x in words if known(x) is None]
        if not new:
            return
        raw = [x.encode("utf-8", "surrogatepass") for x in new]
        ranks = [self.ranks.get(b) for b in raw]
        short = [i for i, r in enumerate(ranks) if r is None and len(raw[i]) <= WIDEST]
        rest = [i for i, r in enumerate(ranks) if r is not None or len(raw[i]) > WIDEST]
        ids = [[ranks[i]] if ranks[i] is not None else self.contract_long(raw[i]) for i in rest]
        self._found([raw[i] for i in short])
        at = np.array(short + rest, np.int64)
        if rest:
            self.db.register("incoming", pa.table(self._lists(range(len(short), len(at)), ids)))
            self.db.execute("insert into found select * from incoming")
            self.db.unregister("incoming")
        got = self._shown()
        put, fromhex = self.known.put, bytes.fromhex
        for i, shown, hexed in zip(at[got["w"].to_numpy()].tolist(), got["shown"].to_pylist(), got["hex"].to_pylist(), strict=True):
            put(new[i], (shown, fromhex(hexed)))

    def code(self, pieces: list[str]) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """Decimal ids, their number and the decoded bytes of each piece of text."""
        self.known.turn()
        flat: list[str] = []
        ends = np.zeros(len(pieces) + 1, np.int32)
        split = self.split
        for i, p in enumerate(pieces, 1):
            if p.isascii() and p[1:].isalpha() and p[0] == " ":
                flat.append(p)
            else:
                flat += split(p)
            ends[i] = len(flat)
        words = pa.array(flat, pa.string()).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(distinct)
        got = [self.known.get(w) for w in distinct]
        ids, raw = pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.binary())
        offsets = pa.array(ends)
        n = np.concatenate([[0], np.cumsum(np.asarray(pc.count_substring(ids, " "), dtype=np.int64)[np.asarray(words.indices)] + 1)])
        join = lambda v, sep: pc.binary_join(pa.ListArray.from_arrays(offsets, v.take(words.indices)), sep)
        return join(ids, " "), n[ends[1:]] - n[ends[:-1]], join(raw, b"")


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def coded(c: Coder, texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Decimal ids joined by a space, number of ids and decoded bytes of each text.

    A match of the pattern never holds a space behind another character, so a text may be cut in
    front of every space that has no white space before it; the pieces are coded one by one.
    """
    texts = pc.fill_null(texts, "")
    marked = pc.replace_substring_regex(texts, r"([^\s\x0b\x1c-\x1f\x{85}\x{a0}\p{Z}]) ", "\\1\x00 ")
    split = pc.split_pattern(marked, "\x00")
    odd = pc.match_substring(texts, "\x00")
    if pc.any(odd).as_py():  # a text with the mark in it is coded in one piece
        lists = [[t] if o else m.split("\x00") for t, m, o in zip(texts.to_pylist(), marked.to_pylist(), odd.to_pylist(), strict=True)]
        split = pa.array(lists, pa.list_(pa.string()))
    flat = split.flatten().dictionary_encode()
    piece_ids, piece_n, piece_raw = c.code(flat.dictionary.to_numpy(zero_copy_only=False).tolist())
    codes, offsets = flat.indices, np.asarray(split.offsets) - split.offsets[0].as_py()
    n = np.concatenate([[0], np.cumsum(piece_n[np.asarray(codes)])])
    join = lambda v, sep: pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), v.take(codes)), sep)
    return join(piece_ids, " "), n[offsets[1:]] - n[offsets[:-1]], join(piece_raw, b"")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, null being empty.

    Repeated rows give repeated rows, an empty table none; other columns are ignored.
    """
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in regrouped(batches, "text", SLICE_CHARS):
            ids, n, raw = coded(c, b.column("text"))
            sha = lambda col: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in col])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), sha(ids), sha(raw)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        relax()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Add ids (array of int) of every text; a null text has none. A column named ids is replaced."""
    from pyspark.sql import functions as F

    ship(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def of(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        ids, _, _ = coded(coder(path, pattern), pa.array(texts, pa.string(), from_pandas=True))
        return pd.Series([[int(i) for i in x.split()] for x in ids.to_pylist()])

    return docs.withColumn("ids", of(F.col("text")))


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """Add decoded (binary) of column ids; null ids give null. A column named decoded is replaced."""
    from pyspark.sql import functions as F

    ship(rows.sparkSession)

    @F.pandas_udf("binary")
    def of(ids):  # noqa: ANN001, ANN202
        import pandas as pd

        held = coder(path, pattern).decode([[] if x is None else list(x) for x in ids])
        return pd.Series([None if x is None else b for x, b in zip(ids, held, strict=True)], dtype=object)

    return rows.withColumn("decoded", of(F.col("ids")))


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode and decode all documents by the byte-level ranks."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
