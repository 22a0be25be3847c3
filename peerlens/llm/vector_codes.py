"""Vector codes: product quantisation of integer vectors by exact k-means.

Components become integers, floor(``SCALE`` * x), and a vector is cut into
``PARTS`` equal parts with a codebook each.  A codebook starts from the vectors
with the ``ENTRIES`` smallest ids; a round assigns every part to its nearest
entry and replaces the entries by the floors of their parts' means.

Distances come from per-dimension value dictionaries: the distinct integers of
each dimension are found once and vectors are stored as codes into them.  For a
round, a table holds the squared difference of every dictionary value to every
entry, and a part's distances are rows of the table gathered by its codes and
added: no subtraction or product is made per vector.  The tables' size is known
before they are built; where they would pass ``TABLE_BYTES`` (dimensions with
very many values), the dictionaries are those of a batch's rows instead, with
the same results.  A round sends the driver one sum per entry and dimension,
``ENTRIES`` times the width in all; each task adds up its own rows first.

Arithmetic is exact: 32-bit or 64-bit integers where the largest component
allows, else unbounded ones; sums travel as 30-bit limbs.  Cases: rows whose
vector is null or holds null or non-finite components (or one beyond
2^1023 / ``SCALE``) are dropped; shorter vectors count as padded with zeros, and
a width that the parts do not divide is padded too; an empty vector has error 0
with itself; ties go to the lower entry; rows without an id are coded, but come
last among the ids; repeated rows each count; with fewer rows than ``ENTRIES``
there are as many entries as rows; errors beyond a long are the largest long;
an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.session import stored

SCALE = 1024.0
PARTS, ENTRIES, ROUNDS = 4, 256, 4
TABLE_BYTES = 256 << 20     # of all parts' tables in a Python worker
ROWS = 512                  # whose distances are held at once
BATCH = 8192                # rows that share dictionaries where these are a batch's
LABELS = 100_000            # label sums that are broadcast, a row each
SALTS = 64                  # of a label, above that
LIMB = 30
LONG = 2 ** 63 - 1


def integers(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v, top) of the kept rows: ``v`` holds the integer components
    as little-endian doubles, ``top`` is the largest in size."""
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
                       F.col(vector_col).alias("x"))
    label = source.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, out, top = [], [], []
            for k, row in enumerate(batch.column("x")):
                if not row.is_valid or row.values.null_count:
                    continue
                with np.errstate(over="ignore"):
                    v = np.floor(SCALE * np.asarray(row.values.cast(pa.float64()))) + 0.0
                if np.isfinite(v).all():
                    kept.append(k)
                    out.append(v.astype("<f8").tobytes())
                    top.append(float(np.abs(v).max(initial=0)))
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), rows.column("label"), pa.array(out, pa.binary()),
                 pa.array(top, pa.float64())], names=["id", "label", "v", "top"])

    return source.mapInArrow(run, f"id long, label {label}, v binary, top double")


class Shape:
    """Width of a vector and of a part, and the numbers that hold distances."""

    def __init__(self, width: int, top: float):
        self.part = -(-width // PARTS)
        self.width = self.part * PARTS
        most = 4 * top * top * max(1, self.part)
        self.kind = np.int32 if most < 2.0 ** 31 else np.int64 if most < 2.0 ** 62 else object

    def matrix(self, rows: list[bytes]) -> np.ndarray:
        """Vectors as rows, padded; every value is a whole number."""
        out = np.zeros((len(rows), self.width))
        for k, r in enumerate(rows):
            out[k, :len(r) // 8] = np.frombuffer(r, "<f8")
        return out

    def whole(self, values: np.ndarray) -> np.ndarray:
        """Doubles that hold whole numbers as integers."""
        if self.kind is not object:
            return values.astype(np.int64)
        flat = [int(x) for x in values.ravel()]
        out = np.empty(len(flat), object)
        out[:] = flat
        return out.reshape(values.shape)


class Tables:
    """Per dimension, the squared differences of its dictionary's values to all
    entries (dimension by entry: ``book``), built when a part is first used."""

    def __init__(self, shape: Shape, values: list[np.ndarray], books: list[np.ndarray]):
        self.shape, self.values, self.books = shape, values, books
        self.built: dict[int, list[np.ndarray]] = {}

    def part(self, p: int) -> list[np.ndarray]:
        if p not in self.built:
            out = []
            for d in range(self.shape.part):
                difference = (self.shape.whole(self.values[p * self.shape.part + d])[:, None]
                              - self.books[p][:, d][None, :])
                out.append((difference * difference).astype(self.shape.kind))
            self.built[p] = out
        return self.built[p]

    def nearest(self, p: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of every row's part, ties to the lower entry;
        ``codes`` are places in the part's dictionaries."""
        tables, entries = self.part(p), len(self.books[p])
        entry, error = np.zeros(len(codes), np.int64), np.zeros(len(codes), self.shape.kind)
        for i in range(0, len(codes), ROWS):
            total = np.zeros((len(codes[i:i + ROWS]), entries), self.shape.kind)
            for d, table in enumerate(tables):
                total += table[codes[i:i + ROWS, d]]
            at = total.argmin(1)
            entry[i:i + ROWS], error[i:i + ROWS] = at, total[np.arange(len(at)), at]
        return entry, error


class Coder:
    """Batches of stored vectors as dictionaries and codes into them."""

    def __init__(self, shape: Shape, values: list[np.ndarray] | None):
        self.shape, self.values = shape, values

    def read(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
        """(first row, end, dictionaries, codes): global dictionaries, or the rows' own."""
        column = batch.column("codes")
        for i in range(0, batch.num_rows, BATCH):
            raw = column.slice(i, BATCH).to_pylist()
            if self.values is None:
                m = self.shape.matrix(raw)
                found = [np.unique(m[:, d], return_inverse=True) for d in range(self.shape.width)]
                codes = (np.stack([f[1] for f in found], 1) if found
                         else np.zeros((len(raw), 0), np.int64))
                yield i, i + len(raw), [f[0] for f in found], codes
            else:
                codes = np.frombuffer(b"".join(raw), "<i4").reshape(len(raw), self.shape.width)
                yield i, i + len(raw), self.values, codes

    def tables(self, values: list[np.ndarray], books: list[np.ndarray], ready: list) -> Tables:
        """The tables of ``values``; those of global dictionaries are built once."""
        if values is not self.values:
            return Tables(self.shape, values, books)
        if not ready:
            ready.append(Tables(self.shape, values, books))
        return ready[0]


def _dictionaries(rows: DataFrame, shape: Shape) -> list[np.ndarray] | None:
    """The sorted distinct values of every dimension, None if the tables would be
    larger than ``TABLE_BYTES``."""
    width = shape.width

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0)] * width

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(width, dtype=np.int32), [len(s) for s in seen])),
                 pa.array(np.concatenate([np.zeros(0), *seen]))], names=["dim", "value"])

        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                m = shape.matrix(batch.column("v").slice(i, BATCH).to_pylist())
                seen = [np.union1d(seen[d], m[:, d]) for d in range(width)]
                if sum(map(len, seen)) > 1 << 18:       # what a task holds
                    yield out()
                    seen = [np.zeros(0)] * width
        yield out()

    bytes_each = ENTRIES * (8 if shape.kind is object else np.dtype(shape.kind).itemsize)
    most = TABLE_BYTES // bytes_each
    found = stored(rows.select("v").mapInArrow(distinct, "dim int, value double").distinct(),
                   "codes-values")
    if shape.kind is object or found.count() > most:
        return None
    table = found.toArrow()
    dims, values = table.column("dim").to_numpy(), table.column("value").to_numpy()
    by = np.lexsort((values, dims))
    ends = np.cumsum(np.bincount(dims, minlength=width))[:-1] if width else []
    return np.split(values[by], ends) if width else []


def _update(coded: DataFrame, shared, coder: Coder, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round over all rows."""
    shape = coder.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, books = shared.value
        ready: list[Tables] = []
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, object if shape.kind is object else np.int64) for b in books]
        for batch in batches:
            for _, _, values, codes in coder.read(batch):
                tables = coder.tables(values, books, ready)
                for p in range(PARTS):
                    mine = codes[:, p * shape.part:(p + 1) * shape.part]
                    entry, _ = tables.nearest(p, mine)
                    count[p] += np.bincount(entry, minlength=len(count[p]))
                    for d in range(shape.part):
                        v = values[p * shape.part + d][mine[:, d]]
                        if shape.kind is object:
                            np.add.at(total[p][:, d], entry, shape.whole(v))
                        else:       # below 2^30 in size: a batch's sums are exact as doubles
                            total[p][:, d] += np.bincount(entry, v, len(count[p])).astype(np.int64)
        for p in range(PARTS):
            used = np.flatnonzero(count[p])
            yield sums_of(p, used, np.array([-1]), count[p][used, None])
            yield sums_of(p, used, np.arange(shape.part), total[p][used])

    def sums_of(p: int, entries: np.ndarray, dims: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        entry, dim = np.repeat(entries, len(dims)), np.tile(dims, len(entries))
        out, place, x = [], 0, x.ravel()
        while len(x):
            more = x != -1 if place else np.ones(len(x), bool)      # -1 is a sign without digits
            low, rest = np.where(more, x & ((1 << LIMB) - 1), x), np.where(more, x >> LIMB, 0)
            out.append((entry, dim, np.full(len(x), place), low))
            going = np.flatnonzero(rest)
            entry, dim, x, place = entry[going], dim[going], rest[going], place + 1
        entry, dim, place, low = (np.concatenate([np.zeros(0, np.int64), *(o[k] for o in out)])
                                  for k in range(4))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(low), p, np.int32)), pa.array(entry.astype(np.int32)),
             pa.array(dim.astype(np.int32)), pa.array(place.astype(np.int32)),
             pa.array(low.astype(np.int64))], names=["part", "entry", "dim", "place", "x"])

    sums = (coded.select("codes").mapInArrow(add, "part int, entry int, dim int, place int, x long")
            .groupBy("part", "entry", "dim", "place").agg(F.sum("x").alias("x")).toArrow().to_pydict())
    total: dict[tuple, int] = defaultdict(int)
    for p, e, d, place, x in zip(*(sums[c] for c in ("part", "entry", "dim", "place", "x"))):
        total[p, e, d] += x << (LIMB * place)
    out = [b.copy() for b in books]
    for (p, e, d), n in list(total.items()):
        if d == -1:
            for k in range(shape.part):
                out[p][e, k] = total.get((p, e, k), 0) // n
    return out


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
             label_col: str = "label") -> DataFrame:
    """Id, label, code (two hex digits a part), error (final squared distances),
    label_error (their sum over equal labels, nulls together) and the SHA-256 of
    the final codebooks, for every kept row."""
    spark = df.sparkSession
    rows = stored(integers(df, id_col, vector_col, label_col), "codes-vectors")
    width, top = rows.agg(F.max(F.length("v")) / 8, F.max("top")).first()
    shape = Shape(int(width or 0), top or 0.0)
    seeds = (rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).collect())
    start = shape.whole(shape.matrix([bytes(r["v"]) for r in seeds]))
    books = [start[:, p * shape.part:(p + 1) * shape.part] for p in range(PARTS)]

    coder = Coder(shape, _dictionaries(rows, shape))
    if coder.values is None:
        coded = rows.select("id", "label", F.col("v").alias("codes"))
    else:
        known = spark.sparkContext.broadcast(coder)
        label = rows.schema["label"].dataType.simpleString()

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder = known.value
            for batch in batches:
                for i in range(0, batch.num_rows, BATCH):
                    part = batch.slice(i, BATCH)
                    m = coder.shape.matrix(part.column("v").to_pylist())
                    codes = np.zeros(m.shape, "<i4")
                    for d, values in enumerate(coder.values):
                        codes[:, d] = np.searchsorted(values, m[:, d])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), part.column("label"),
                         pa.array([c.tobytes() for c in codes], pa.binary())],
                        names=["id", "label", "codes"])

        coded = stored(rows.select("id", "label", "v")
                       .mapInArrow(encode, f"id long, label {label}, codes binary"), "codes-coded")
        known.destroy()

    for _ in range(ROUNDS if seeds else 0):
        shared = spark.sparkContext.broadcast((coder, books))
        books = _update(coded, shared, coder, books)
        shared.destroy()
    digest = sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()

    shared = spark.sparkContext.broadcast((coder, books))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, books = shared.value
        ready: list[Tables] = []
        for batch in batches:
            for i, j, values, codes in coder.read(batch):
                tables = coder.tables(values, books, ready)
                found = [tables.nearest(p, codes[:, p * shape.part:(p + 1) * shape.part])
                         for p in range(PARTS)]
                text = ["".join(f"{e:02x}" for e in row) for row in zip(*(e.tolist() for e, _ in found))]
                error = [min(LONG, sum(map(int, row))) for row in zip(*(x.tolist() for _, x in found))]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), pa.array(text, pa.string()),
                     pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    label = coded.schema["label"].dataType.simpleString()
    out = stored(coded.mapInArrow(assign, f"id long, label {label}, code string, error long"), "codes-out")
    shared.destroy()
    return (with_label_error(out)
            .select(F.col("id").alias(id_col), "label", "code", "error", "label_error",
                    F.lit(digest).alias("codebooks_sha256")))


def with_label_error(out: DataFrame) -> DataFrame:
    """Adds the sum of ``error`` over the rows with the same label.  A label's
    rows are summed in their tasks first; a bounded number of sums is broadcast,
    more are joined with every label spread over ``SALTS`` keys."""
    exact = F.sum(F.col("error").cast("decimal(20,0)"))
    sums = stored(out.groupBy("label").agg(F.least(exact, F.lit(LONG).cast("decimal(20,0)"))
                                           .cast("long").alias("label_error")), "codes-labels")
    sums = sums.withColumnRenamed("label", "of")

    def same(a: Column, b: Column) -> Column:
        return a.eqNullSafe(b)

    if sums.count() <= LABELS:
        return out.join(F.broadcast(sums), same(F.col("label"), F.col("of")))
    salt = F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int")
    spread = sums.withColumn("to_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (out.withColumn("salt", salt)
            .join(spread, same(F.col("label"), F.col("of")) & (F.col("salt") == F.col("to_salt"))))
