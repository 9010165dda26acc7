"""Vector code compression: product quantization in exact integers.

Vectors become blocks: rows of a written table that hold the integer components of some thousand
vectors, one NumPy row for each dimension. Every round is one treeAggregate over the blocks: in a
block the distances of a part to all entries of its codebook accumulate dimension by dimension,
np.add.at adds the part to the sums and counts of its nearest entry, and these int64 tensors, whose
size doesn't depend on the data, merge through the reduction tree. The codebooks alone reach the
driver. All is integer arithmetic, so neither the order of rows nor a lost task changes a result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import discard, materialize, ship, table

#: Parts of a vector, entries of a part's codebook (256 at most), rounds, factor before rounding down.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block at most; labels that are broadcast at most.
BLOCK, FEW = 4096, 10_000


def finite(x):
    """Whether a vector is not null and all its components are numbers."""
    return F.coalesce(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def largest(dim: int) -> int:
    """Components up to this size keep every sum of squared distances within a long."""
    return math.isqrt((1 << 62) // max(1, dim)) // 2


def to_blocks(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(dim, n, top, ids, labels, x) of vec_id, embedding, label: x holds int32 rows, one for each
    dimension, of n vectors of one length; top is the largest absolute component.

    Vectors that are null or hold null or non-finite components are dropped. A component that is
    beyond what a long can hold squared and summed raises an ArithmeticError.
    """
    ship(vectors.sparkSession)
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", "label", x.alias("x")).where(finite(F.col("x")))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("x")
            ends = np.asarray(column.offsets)
            sizes, values = np.diff(ends), np.asarray(column.values)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                for at in range(0, len(rows), BLOCK):
                    take = rows[at : at + BLOCK]
                    real = np.floor(values[ends[take][:, None] + np.arange(dim)] * float(scale)).T
                    top = int(np.abs(real).max(initial=0))
                    if top > largest(dim):
                        raise ArithmeticError(f"a component of {top} / {scale} is beyond the exact range")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([dim], pa.int32()), pa.array([len(take)], pa.int32()), pa.array([top], pa.int64()),
                            *[pa.ListArray.from_arrays(pa.array([0, len(take)], pa.int32()), b.column(c).take(pa.array(take))) for c in ("vec_id", "label")],
                            pa.array([np.ascontiguousarray(real, np.int32).tobytes()], pa.binary()),
                        ],
                        ["dim", "n", "top", "ids", "labels", "x"],
                    )

    return rows.mapInArrow(cut, f"dim int, n int, top long, ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, x binary")


def components(block: Row) -> np.ndarray:
    """dim x n."""
    return np.frombuffer(block["x"], np.int32).reshape(block["dim"], block["n"])


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each part (rows) of each vector (columns); ties: the lower index.
    x: dim x n; books: parts x entries x dimensions of a part."""
    parts, entries, width = books.shape
    n = x.shape[1]
    index, distance = np.zeros((parts, n), np.int64), np.zeros((parts, n), np.int64)
    for p in range(parts):
        far = np.zeros((entries, n), np.int64)
        for j in range(width):
            gap = x[p * width + j].astype(np.int64)[None, :] - books[p, :, j, None]
            far += gap * gap
        index[p] = far.argmin(0)
        distance[p] = far[index[p], np.arange(n)]
    return index, distance


def _smallest(pairs: list[tuple], entries: int) -> list[tuple]:
    """(id, vector) of the smallest ids; of an id's vectors the smallest."""
    best: dict = {}
    for i, v in pairs:
        if i not in best or v < best[i]:
            best[i] = v
    return [(i, best[i]) for i in sorted(best)[:entries]]


def look(blocks: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> tuple[int, int, np.ndarray] | None:
    """(dim, rows, first codebooks) of the commonest length that can be cut into the parts (ties: the
    shorter); None if there are no such vectors with an id."""

    def add(acc: dict, block: Row) -> dict:
        n, top, seeds = acc.get(block["dim"], (0, 0, []))
        ids, x = block["ids"], components(block)
        known = sorted({i for i in ids if i is not None})[:entries]
        worst = set(known)
        new = [(i, tuple(x[:, k].tolist())) for k, i in enumerate(ids) if i in worst]
        acc[block["dim"]] = n + block["n"], max(top, block["top"]), _smallest(seeds + new, entries)
        return acc

    def merge(a: dict, b: dict) -> dict:
        for dim, (n, top, seeds) in b.items():
            m, t, s = a.get(dim, (0, 0, []))
            a[dim] = m + n, max(t, top), _smallest(s + seeds, entries)
        return a

    seen = blocks.rdd.treeAggregate({}, add, merge)
    fits = [(-n, dim) for dim, (n, _, seeds) in seen.items() if dim % parts == 0 and seeds]
    if not fits:
        return None
    dim = min(fits)[1]
    n, top, seeds = seen[dim]
    if n * max(1, top) >= 1 << 63:
        raise ArithmeticError(f"sums of {n} components of up to {top} don't fit a long")
    start = np.array([v for _, v in seeds], np.int64).reshape(len(seeds), parts, dim // parts)
    return dim, n, np.ascontiguousarray(start.transpose(1, 0, 2))


def learn(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after the rounds: an entry becomes the mean, rounded down, of the parts nearest to
    it; one without parts stays. Ends early where a round changes nothing, as the next ones then
    wouldn't either."""
    rdd = blocks.rdd
    for _ in range(rounds):
        now = books

        def add(acc: tuple, block: Row, books: np.ndarray = now) -> tuple:
            sums, counts = acc
            x = components(block)
            index, _ = nearest(x, books)
            width = books.shape[2]
            for p in range(books.shape[0]):
                np.add.at(sums[p], index[p], x[p * width : (p + 1) * width].T)
                np.add.at(counts[p], index[p], 1)
            return sums, counts

        def merge(a: tuple, b: tuple) -> tuple:
            return a[0] + b[0], a[1] + b[1]

        sums, counts = rdd.treeAggregate((np.zeros_like(books), np.zeros(books.shape[:2], np.int64)), add, merge)
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], now)
        if (books == now).all():
            break
    return books


def encode(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of each vector; code and error are null where the length is not
    that of the codebooks."""
    kinds = {c: blocks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels")}
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                n, dim = one.column("n")[0].as_py(), one.column("dim")[0].as_py()
                if dim == parts * width:
                    index, distance = nearest(np.frombuffer(one.column("x")[0].as_py(), np.int32).reshape(dim, n), books)
                    text = np.ascontiguousarray(index.T.astype(np.uint8)).tobytes().hex()
                    codes = pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string())
                    errors = pa.array(distance.sum(0))
                else:
                    codes, errors = pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([one.column("ids").flatten(), one.column("labels").flatten(), codes, errors], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id {kinds['ids']}, label {kinds['labels']}, code string, error long")


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The integer components that a code stands for."""
    return np.concatenate([books[p, i] for p, i in enumerate(bytes.fromhex(code))])


def digest(books: np.ndarray) -> str:
    """Of all decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, code, error, label_error) and the codebooks.

    vectors: vec_id, embedding, label; other columns are ignored, whatever their names. Vectors that
    are null or hold null or non-finite components are dropped. The commonest length that can be cut
    into equal parts is coded; vectors of other lengths have neither code nor error and teach
    nothing. A null vec_id is coded but never starts a codebook; a repeated one starts one entry, by
    its smallest vector. With fewer ids than entries, or none, the codebooks are shorter. label_error
    sums the errors of equal labels, nulls together. An empty table gives no rows.
    """
    blocks = materialize(to_blocks(vectors, scale), "blocks")
    start = look(blocks, entries, parts)
    books = np.zeros((parts, 0, 0), np.int64)
    if start is not None:
        dim, _, first = start
        books = learn(blocks.where(F.col("dim") == dim), first, rounds)
    coded = encode(blocks, books) if start is not None else encode(blocks.where("false"), books.reshape(parts, 0, 0))
    if start is None:  # vectors, but none that can be coded
        bare = blocks.select(F.explode(F.arrays_zip("ids", "labels")).alias("v"))
        coded = bare.select(F.col("v.ids").alias("vec_id"), F.col("v.labels").alias("label"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = materialize(coded, "coded")
    discard(blocks)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    if sums.limit(FEW + 1).count() <= FEW:
        sums = F.broadcast(sums)
    out = coded.join(sums, coded["label"].eqNullSafe(sums["__label"]), "left")
    return out.select("vec_id", "code", "error", "label_error"), books


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes, errors and the digest of the codebooks of all embeddings."""
    rows, books = compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return rows.withColumn("codebooks_sha256", F.lit(digest(books)))


def _sql() -> str:
    near = """
a{k} as materialized (
  select vec_id, part, arg_min(entry, (d, entry)) as entry, min(d) as d from (
    select v.vec_id, v.part, c.entry, sum((v.x - c.x) * (v.x - c.x))::bigint as d
    from v join c{k} c on c.part = v.part and c.pos = v.pos group by all) group by vec_id, part)"""
    mean = """
c{n} as materialized (
  select c.part, c.entry, c.pos, coalesce(m.x, c.x) as x from c{k} c left join (
    select part, entry, pos, ((s - ((s % n) + n) % n) // n)::bigint as x from (
      select a.part, a.entry, v.pos, sum(v.x)::bigint as s, count(*) as n from a{k} a join v on v.vec_id = a.vec_id and v.part = a.part group by all)
    ) m on m.part = c.part and m.entry = c.entry and m.pos = c.pos)"""
    steps = "".join("," + near.format(k=k) + "," + mean.format(k=k, n=k + 1) for k in range(ROUNDS)) + "," + near.format(k=ROUNDS)
    return f"""
with kept as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
v as materialized (
  select vec_id, (i - 1) // (n // {PARTS}) as part, (i - 1) % (n // {PARTS}) as pos, q[i] as x
  from (select vec_id, q, len(q) as n, unnest(range(1, len(q) + 1)) as i from kept)),
c0 as materialized (
  select part, entry, pos, x from v join (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept order by vec_id limit {ENTRIES}) using (vec_id))
{steps},
coded as (
  select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from a{ROUNDS} group by vec_id),
book as (select sha256(string_agg(x::varchar, ',' order by part, entry, pos)) as digest from c{ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select digest from book) as codebooks_sha256
from coded join kept using (vec_id)
"""


OP11_SQL = _sql()
