"""Spelling variants: words one edit apart, by two-dimensional range reporting.

A word with position i edited keeps what stands before i and what stands behind it. In the order of
the words the former is an interval, in the order of the reversed words the latter; the words in
both are those wanted. Words of one length are points (rank in one order, rank in the other), and a
wavelet tree over them reports the points of a rectangle.

Words meet in tasks by what an edit leaves: the edit positions of a length are cut into ranges, and
a word goes, for each range, to the key of its letters before and behind the range. Words that one
edit in the range makes equal share that key. A task holds many keys and builds its trees over all
words that came to it. A key with very many words is replaced by keys for each of its positions,
which the alphabet bounds. So every pair is found, once, and no key is one task's load.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, ship, table

#: Code points of a word and occurrences at least; an altered run's crc32 is a multiple of MARK; how
#: many times as frequent a word's form is at least.
LEAST_LENGTH, LEAST_COUNT, MARK, TIMES = 5, 3, 97, 2
#: Ranges of edit positions; words of a key from which it is split; rows of a task (in expectation);
#: keys that are broadcast at most.
RANGES, HOT, TASK, FEW = 3, 20_000, 200_000, 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"


def words(docs: DataFrame) -> DataFrame:
    """(word, n): distinct results of at least LEAST_LENGTH code points and LEAST_COUNT occurrences.

    Runs of letters, A-Z lower-cased; a run loses one code point where MARK divides its crc32 with
    the doc_id (a null one: empty). Counts are partial sums before anything is shuffled.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= LEAST_LENGTH)  # none gets longer
    plain = F.length("run") == F.octet_length("run")
    runs = runs.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    found = runs.select(F.when(h % MARK == 0, cut).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return found.where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


# ---- a task's words


class WaveletTree:
    """Points (i, values[i]) of a permutation: level by level the values' bits, the zeros' values
    before the ones', each level with running counts of zeros."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, (len(values) - 1).bit_length()) if len(values) else 1
        self.zeros: list[np.ndarray] = []
        now = np.asarray(values, np.int64)
        for level in range(self.bits - 1, -1, -1):
            one = (now >> level) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            now = np.concatenate([now[~one], now[one]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of the points with left <= i < right and low <= value < high of each
        rectangle. All descend together; those without points, or whose values lie elsewhere, end."""
        q = np.flatnonzero((left < right) & (low < high))
        left, right, prefix = left[q], right[q], np.zeros(len(q), np.int64)
        for level, zeros in enumerate(self.zeros):
            rest = self.bits - 1 - level
            l0, r0, ones = zeros[left], zeros[right], zeros[-1]
            q, prefix = np.concatenate([q, q]), np.concatenate([2 * prefix, 2 * prefix + 1])
            left, right = np.concatenate([l0, ones + left - l0]), np.concatenate([r0, ones + right - r0])
            keep = (left < right) & (prefix << rest < high[q]) & (((prefix + 1) << rest) > low[q])
            q, prefix, left, right = q[keep], prefix[keep], left[keep], right[keep]
        return q, prefix


class _Order:
    """Rows of letters in sorted order, and the runs of rows that share a number of leading letters."""

    def __init__(self, letters: np.ndarray) -> None:
        width = letters.shape[1]
        text = np.ascontiguousarray(letters).view(f"<U{width}").ravel()
        self.rows = np.argsort(text, kind="stable")
        self.rank = np.empty(len(text), np.int64)
        self.rank[self.rows] = np.arange(len(text))
        held = letters[self.rows]
        apart = np.concatenate([held[1:] != held[:-1], np.ones((max(0, len(held) - 1), 1), bool)], axis=1)
        self.shared = np.concatenate([[-1], apart.argmax(1)]) if len(held) else np.zeros(0, np.int64)

    def runs(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """By rank: where the run of rows with the same `depth` letters starts and ends."""
        begins = np.flatnonzero(self.shared < depth) if depth else np.zeros(1, np.int64)
        number = np.zeros(len(self.rows), np.int64)
        number[begins] = 1
        number = np.cumsum(number) - 1
        return begins[number], np.append(begins[1:], len(self.rows))[number]


def _letters(texts: list[str], width: int) -> np.ndarray:
    return np.array(texts, f"<U{width}").view("<u4").reshape(len(texts), width)


def _reversed(letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each row's letters backwards, filled up at the end."""
    at = lengths[:, None] - 1 - np.arange(letters.shape[1])
    return np.where(at >= 0, np.take_along_axis(letters, np.maximum(at, 0), 1), 0).astype("<u4")


def pairs_of_length(length: int, same: list[str], longer: list[str], query: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of places in same + longer: words of `length` letters and of one more, distinct.

    query: places of words in `same`; first, last: which edit positions of each are asked for (last
    excluded). A pair of `same` is found from either side, one with a longer word from the shorter;
    there the edit position is the first at which the two differ.
    """
    n = len(same)
    letters = _letters(same + longer, length + 1)
    lengths = np.repeat([length, length + 1], [n, len(longer)])
    forward, backward = _Order(letters), _Order(_reversed(letters, lengths))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for low, high, more in ((0, n, 0), (n, n + len(longer), 1)):
        if high - low < (1 if more else 2):
            continue
        member = np.zeros(n + len(longer), bool)
        member[low:high] = True
        # ranks among the words of this length alone
        before = [np.concatenate([[0], np.cumsum(member[o.rows])]) for o in (forward, backward)]
        x, y = before[0][forward.rank[low:high]], before[1][backward.rank[low:high]]
        values, by_y = np.empty(high - low, np.int64), np.empty(high - low, np.int64)
        values[x], by_y[y] = y, np.arange(low, high)
        tree = WaveletTree(values)
        for i in range(length + more):
            q = query[(first <= i) & (i < last)]
            if not len(q):
                continue
            box = []
            for order, counts, depth in ((forward, before[0], i), (backward, before[1], length + more - 1 - i)):
                begin, end = order.runs(depth)
                at = order.rank[q]
                box += [counts[begin[at]], counts[end[at]]]
            least = 1 if more else 2  # the word itself lies in its own rectangle
            some = (box[1] - box[0] >= least) & (box[3] - box[2] >= least)
            which, value = tree.report(*[b[some] for b in box])
            left, right = q[some][which], by_y[value]
            keep = letters[left, i] != letters[right, i] if more else left != right
            found.append((left[keep], right[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the key of the letters before and behind the range of edit positions."""
    kept = F.greatest(F.lit(0), F.col("length") - F.col("last"))
    size = F.length("word")
    behind = F.substring(F.col("word"), size - kept + 1, kept)
    return rows.withColumn("key", F.xxhash64("length", "first", "last", F.substring(F.col("word"), F.lit(1), F.col("first")), behind))


def near_pairs(words: DataFrame, ranges: int = RANGES, hot: int = HOT, task: int = TASK) -> DataFrame:
    """(word, near, near_n) for every ordered pair of words that differ by one inserted, deleted or
    replaced code point. words: word (distinct, not null), n; an empty word has no pair."""
    ship(words.sparkSession)
    spark = words.sparkSession
    # as a word that is edited, and as the longer one of a pair, where the edited one's length counts
    roles = F.explode(F.array(F.lit(0), F.lit(1))).alias("longer")
    rows = words.where("word <> ''").select("word", "n", roles).withColumn("length", F.length("word") - F.col("longer")).where("length > 0")
    edge = lambda k: F.floor(k * (F.col("length") + 1) / ranges).cast("int")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)))).withColumns({"first": edge(F.col("k")), "last": edge(F.col("k") + 1)})
    rows = materialize(_keyed(rows.where("first < last")).drop("k"), "routes")
    many = rows.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > hot).select("key", F.lit(True).alias("many"))
    many = materialize(many, "hot-keys")
    n_many = many.count()
    if n_many:
        known = F.broadcast(many) if n_many <= FEW else many
        marked = rows.join(known, "key", "left")
        split = marked.where("many").withColumn("first", F.explode(F.sequence("first", F.col("last") - 1))).withColumn("last", F.col("first") + 1)
        columns = ["word", "n", "longer", "length", "first", "last", "key"]
        parted = materialize(marked.where("many is null").select(*columns).unionByName(_keyed(split).select(*columns)), "routes")
        discard(rows)
        rows = parted
    discard(many)
    schema = "word string, near string, near_n long"

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), schema=None) if (batches := [b for b in batches if b.num_rows]) else None
        if held is None:
            return
        length = np.asarray(held["length"].combine_chunks())
        longer, first, last, n = (np.asarray(held[c].combine_chunks()) for c in ("longer", "first", "last", "n"))
        texts = held["word"].combine_chunks()
        for size in np.unique(length).tolist():
            lists, counts, places = [], [], None
            for role in (0, 1):
                at = np.flatnonzero((length == size) & (longer == role))
                coded = texts.take(pa.array(at)).dictionary_encode()
                index = np.asarray(coded.indices)
                of = np.zeros(len(coded.dictionary), np.int64)
                of[index] = n[at]
                lists.append(coded.dictionary.to_pylist()), counts.append(of)
                if role == 0:
                    places, asked = index.astype(np.int64), at
            if not lists[0] or len(lists[0]) + len(lists[1]) < 2:
                continue
            i, j = pairs_of_length(size, *lists, places, first[asked], last[asked])
            back = j >= len(lists[0])  # a longer word learns of the shorter one here
            i, j = np.concatenate([i, j[back]]), np.concatenate([j, i[back]])
            every, of = pa.array(lists[0] + lists[1], pa.string()), np.concatenate(counts)
            for k in range(0, len(i), 100_000):
                a, b = i[k : k + 100_000], j[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([every.take(pa.array(a)), every.take(pa.array(b)), pa.array(of[b])], ["word", "near", "near_n"])

    dealt = rows.select("word", F.col("n").cast("long").alias("n"), "longer", "length", "first", "last", "key")
    out = materialize(dealt.repartition(max(1, -(-rows.count() // task)), "key").drop("key").mapInArrow(meet, schema), "near")
    discard(rows)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: each round doubles how far a word has followed forms,
    which grow more frequent at every step and so never come round."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("__at"), F.col("root").alias("__on"))
        moved = now.join(on, now["root"] == on["__at"], "left").select("word", F.coalesce("__on", "root").alias("root"), F.col("__on").isNotNull().alias("moved"))
        nxt = materialize(moved, "roots")
        discard(now)
        now = nxt
        if now.where("moved").isEmpty():
            return now.drop("moved")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of the documents.

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that is
    TIMES its own n at least, else null; root is where forms lead, the word itself without one.

    docs: doc_id, text; other columns are ignored, whatever their names. A null text, or one without
    letters, has no words; a null doc_id counts as an empty one; repeated rows count as often as
    they stand there. An empty table gives no rows.
    """
    found = materialize(words(docs.select("doc_id", "text")), "words")
    near = near_pairs(found)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("b"))
    best = best.select(F.col("word").alias("__of"), "n_near", F.col("b.w").alias("w"), (-F.col("b.n")).alias("m"))
    out = found.join(best, found["word"] == best["__of"], "left")
    formed = F.col("m") >= TIMES * F.col("n")
    out = out.select("word", F.when(formed, F.col("w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("m")).alias("form_n"))
    out = materialize(out, "formed")
    discard(found), discard(near)
    roots = _roots(out.where("form is not null")).withColumnRenamed("word", "__of")
    out = out.join(roots, out["word"] == roots["__of"], "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Words of all documents with their forms and roots."""
    return variants(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
with recursive crc(t) as materialized (
  select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))),
runs as materialized (
  select doc_id, translate(r, '{UPPER}', '{LOWER}') as r, count(*) as c
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as r from documents) where length(r) >= {LEAST_LENGTH} group by all),
hashed as materialized (
  select r, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i:
    (position(h[2 * i + 1] in '0123456789ABCDEF') - 1) * 16 + position(h[2 * i + 2] in '0123456789ABCDEF') - 1)),
    lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) as crc
  from (select r, c, hex(coalesce(doc_id::varchar, '') || ':' || r) as h from runs), crc),
w as materialized (
  select word, sum(c)::bigint as n from (
    select case when crc % {MARK} = 0 then left(r, (crc % length(r))::int) || substr(r, (crc % length(r))::int + 2) else r end as word, c from hashed)
  where length(word) >= {LEAST_LENGTH} group by word having sum(c) >= {LEAST_COUNT}),
gaps as materialized (
  select word, n, unnest(range(length(word))) as i from w),
cut as materialized (
  select word, n, i, left(word, i::int) || substr(word, i::int + 2) as rest from gaps),
near as materialized (
  select distinct a.word, b.word as near, b.n as m from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select distinct c.word, w.word, w.n from cut c join w on w.word = c.rest
  union select distinct w.word, c.word, c.n from cut c join w on w.word = c.rest),
best as (
  select word, count(*) as n_near, max(m) as m, arg_min(near, (-m, near)) as f from near group by word),
formed as materialized (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= {TIMES} * w.n then f end as form, case when m >= {TIMES} * w.n then m end as form_n
  from w left join best using (word)),
up as (
  select word, word as root, form as nxt from formed
  union all select u.word, u.nxt, f.form from up u join formed f on f.word = u.nxt)
select formed.word, form, root, n, n_near::bigint as n_near, form_n::bigint as form_n
from formed join (select word, root from up where nxt is null) r on r.word = formed.word
"""
