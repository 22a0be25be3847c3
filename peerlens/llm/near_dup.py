"""MinHash near-duplicates with sequential Bayesian verification.

A document's set is its distinct shingles of ``SHINGLE`` words; documents with
a Jaccard similarity of ``THRESHOLD`` % or more are linked, and components are
the groups.  Links are confirmed on the full sets.

1. One pass over the texts gives every document a digest of its words, its set
   size and a signature of ``HASHES`` minima.  Equal texts collapse to their
   smallest id, so a text that a third of the rows share is one node.
2. Signatures are cut into ``BANDS`` bands; nodes that agree on a band are
   candidates.  A pair at the threshold misses all bands with a chance of
   5 in a million.
3. A bucket does not emit its pairs but a star: its smallest node with every
   other one.  Surviving candidates are verified and linked.
4. Nodes that their bucket's star left in another component than its centre
   are then joined, on the rare prefixes of their full sets, with the nodes of
   other components, so no link between different texts is lost to the stars.

Verification compares signatures batch by batch and gives a pair up as soon
as the posterior chance (uniform prior) that its similarity reaches the
threshold falls below ``MISS``; survivors are decided exactly.

Cases: null and empty texts have size 0 and are linked with nothing; fewer
than ``SHINGLE`` words form one shingle; a null id stays alone (component
null, kept); rows that repeat an id belong to one node; an empty table gives
an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.llm.components import components
from peerlens.llm.text import chunks, mix, owners, words
from peerlens.session import stored

SHINGLE, THRESHOLD = 5, 75
HASHES, BANDS = 128, 32
MISS = 1e-7                     # per checkpoint of the sequential test
CHECKPOINTS = (16, 32, 64, 128)
SLOTS = 1 << 16                 # counters that order shingles from rare to common
BEFORE = 6                      # preceding shingles that a prefix row carries
BROADCAST_IDS = 1_000_000       # ids (8 MB) up to which a filter is broadcast

_RNG = np.random.default_rng(75)
_MUL = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_WORD = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(1, 2**63, HASHES // BANDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Hashes of the shingles of every text as they come (with repeats), the
    document offsets, and a digest of each text's words."""
    w = words(column)
    h, n = w.hashes, np.diff(w.offsets)
    owner = owners(w.offsets)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, 0)
    count[short] = 1
    offsets = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(offsets[-1], np.uint64)
    if len(h) >= SHINGLE:
        starts = len(h) - SHINGLE + 1
        whole = owner[:starts] == owner[SHINGLE - 1:]
        acc = np.zeros(starts, np.uint64)
        for k in range(SHINGLE):
            acc += h[k:k + starts] * _WORD[k]
        full = np.repeat(n >= SHINGLE, count)
        out[full] = mix(acc[whole])
    for d in short:
        own = h[w.offsets[d]:w.offsets[d + 1]]
        out[offsets[d]] = mix((own * _WORD[:len(own)]).sum(dtype=np.uint64, keepdims=True)
                              + np.uint64(len(own)))[0]
    raw = h.tobytes()
    digests = [blake2b(raw[8 * a:8 * b], digest_size=16).digest()
               for a, b in zip(w.offsets[:-1], w.offsets[1:])]
    return out, offsets, digests


def distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes per document, with their offsets."""
    owner = owners(offsets)
    by = np.argsort(hashes)
    kind = np.uint16 if len(offsets) < 1 << 16 else np.int64
    by = by[np.argsort(owner[by].astype(kind), kind="stable")]      # radix sort of small ints
    h, o = hashes[by], owner[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], np.searchsorted(o[new], np.arange(len(offsets)))


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minima (documents x HASHES, 32 bits) of non-empty sets; zeros otherwise."""
    n = len(offsets) - 1
    out = np.zeros((n, HASHES), np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        starts = offsets[full]
        step = 1 << 16          # hashes at once, to stay in the processor's cache
        for lo, hi in _spans(starts, len(hashes), step):
            part, at = hashes[starts[lo]:(starts[hi] if hi < len(starts) else len(hashes))], \
                starts[lo:hi] - starts[lo]
            for k in range(HASHES):
                low = np.minimum.reduceat(part * _MUL[k] + _ADD[k], at)
                out[full[lo:hi], k] = low >> np.uint64(32)
    return out


def _spans(starts: np.ndarray, end: int, step: int) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``step`` hashes."""
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + step)))
        yield lo, hi
        lo = hi


def profile(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, digest, sig) of every row: set size, words digest, signature."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                hashes, offsets, digests = shingles(part.column("text"))
                hashes, offsets = distinct(hashes, offsets)
                sig = signatures(hashes, offsets)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(offsets)), pa.array(digests, pa.binary()),
                     pa.array([s.tobytes() for s in sig], pa.binary())],
                    names=["id", "n", "digest", "sig"])

    return source.mapInArrow(run, "id long, n long, digest binary, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, HASHES)


def band_keys(nodes: DataFrame) -> DataFrame:
    """(key, node) per band of every signature."""
    rows = HASHES // BANDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                sig = _matrix(part.column("sig")).astype(np.uint64).reshape(-1, BANDS, rows)
                key = (sig * _BAND[:rows]).sum(2, dtype=np.uint64)
                key = mix(key + np.arange(BANDS, dtype=np.uint64) * _BAND[rows])
                node = np.repeat(np.asarray(part.column("node")), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)),
                                                  pa.array(node)], names=["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


@cache
def least_matches(seen: int, chance: float, similarity: float = THRESHOLD / 100) -> int:
    """The fewest matches among ``seen`` hashes with which the posterior chance
    of reaching ``similarity`` is still ``chance``: under a uniform prior that
    chance is P(Bin(seen + 1, similarity) <= matches)."""
    total = 0.0
    for m in range(seen + 1):
        total += comb(seen + 1, m) * similarity ** m * (1 - similarity) ** (seen + 1 - m)
        if total >= chance:
            return m
    return seen


def plausible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sequential test of signature pairs: which ones survive every checkpoint."""
    alive = np.arange(len(a))
    matches, done = np.zeros(len(a), np.int64), 0
    for stop in CHECKPOINTS:
        matches = matches + (a[alive, done:stop] == b[alive, done:stop]).sum(1)
        ok = matches >= least_matches(stop, MISS)
        alive, matches, done = alive[ok], matches[ok], stop
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _survivors(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and the sequential test leave."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    sized = (pairs.join(right, "b").join(left, "a")
             .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * THRESHOLD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = pa.array(plausible(_matrix(batch.column("sa")), _matrix(batch.column("sb"))))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok),
                                                  batch.column("b").filter(ok)], names=["a", "b"])

    return sized.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def linked(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Exact decision for pairs of texts, on their full sets."""
    sets = [distinct(*shingles(c)[:2]) for c in (a, b)]
    na, nb = (np.diff(s[1]) for s in sets)
    h = np.concatenate([s[0] for s in sets])
    o = np.concatenate([owners(s[1]) for s in sets])
    by = np.lexsort((h, o))
    h, o = h[by], o[by]
    twice = np.flatnonzero((h[1:] == h[:-1]) & (o[1:] == o[:-1]))
    both = np.bincount(o[twice], minlength=len(na))
    return (na > 0) & (nb > 0) & (100 * both >= THRESHOLD * (na + nb - both))


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are linked.  ``docs``: (id, text)."""
    pairs = stored(pairs, "candidates")
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidate-ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = stored(docs.join(wanted, "id", "left_semi"), "candidate-texts")
    both = (pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
            .join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "ta"):
                ok = pa.array(linked(part.column("ta"), part.column("tb")))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(ok),
                                                  part.column("b").filter(ok)], names=["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept of every row."""
    rows = stored(profile(docs, id_col, text_col), "profiles")
    usable = rows.where("n > 0 AND id IS NOT NULL")
    nodes = stored(usable.groupBy("digest").agg(F.min("id").alias("node"), F.first("n").alias("n"),
                                                F.first("sig").alias("sig")), "nodes")
    keys = band_keys(nodes)
    shared = (keys.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last"))
              .where("centre < last").select("key", "centre"))
    members = stored(keys.join(shared, "key"), "members")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    stars = (members.where("node <> centre")
             .select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
    links = stored(_verified(_survivors(stars, nodes), texts), "links")
    groups = stored(components(links), "groups")

    rest = _unresolved(members, groups, texts)
    more = _verified(_survivors(rest, nodes), texts)
    edges = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
    final = components(edges)

    by_digest = (nodes.select("digest", "node").join(final, "node", "left")
                 .select("digest", F.coalesce("component", "node").alias("component")))
    out = rows.select("id", "n", "digest").join(by_digest, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each group left (its smallest id), with all
    their columns; of rows that repeat a kept id one stays, null ids stay."""
    own = "kept_id"
    while own in {c.lower() for c in docs.columns}:     # the caller's columns are kept as they are
        own += "_"
    found = stored(near_duplicates(docs, id_col, text_col).select(F.col(id_col).alias(own), "kept"),
                   "kept")

    def sized(ids: DataFrame) -> DataFrame:
        ids = stored(ids, "ids")
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    same = F.col(id_col) == F.col(own)
    out = docs.join(sized(found.where("NOT kept").select(own).distinct()), same, "left_anti")
    again = found.where(F.col("kept") & F.col(own).isNotNull()).groupBy(own).count().where("count > 1")
    again = sized(again.select(own))
    if again.isEmpty():
        return out
    return out.join(again, same, "left_anti").unionByName(
        out.join(again, same, "left_semi").dropDuplicates([id_col]))


def _slot_counts(texts: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each of ``SLOTS`` hash slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in chunks(batch):
                hashes, _ = distinct(*shingles(part.column("text"))[:2])
                counts += np.bincount((hashes % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(counts[slot])], names=["slot", "n"])

    rows = (texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot")
            .agg(F.sum("n").alias("n")).toPandas())      # SLOTS rows at most
    out = np.zeros(SLOTS, np.int64)
    out[rows["slot"]] = rows["n"]
    return out


def _before(hashes: np.ndarray, rows: np.ndarray, place: np.ndarray) -> pa.Array:
    """Per row the up to ``BEFORE`` hashes that precede it in its document."""
    n = np.minimum(place, BEFORE)
    offsets = np.concatenate([[0], np.cumsum(n)])
    index = np.repeat(rows - n - offsets[:-1], n) + np.arange(offsets[-1])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)),
                                    pa.array(hashes[index].view(np.int64)))


def _prefixes(texts: DataFrame) -> DataFrame:
    """(shingle, node, c, stray, rest, size, s0, s1, before): of every set the
    rarest quarter of its shingles.  ``rest`` is the number of shingles from
    this one on, in the order from rare to common (estimated by slot, then by
    hash, the same in all sets); ``s0`` and ``s1`` are the lowest bits of the
    signature; ``before`` holds the shingles just before this one."""
    shared = texts.sparkSession.sparkContext.broadcast(_slot_counts(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                h, offsets = distinct(*shingles(part.column("text"))[:2])
                if len(h) == 0:
                    continue
                owner, size = owners(offsets), np.diff(offsets)
                common = shared.value[(h % np.uint64(SLOTS)).astype(np.int64)]
                by = np.lexsort((h, common, owner))
                place = np.arange(len(h)) - offsets[owner]      # owners stay in order
                # a partner has at least THRESHOLD % of the set
                most = size - -(-size * THRESHOLD // 100) + 1
                take = place < most[owner]
                o = pa.array(owner[take])
                bits = np.packbits((signatures(h, offsets) & 1).astype(np.uint8), axis=1)
                bits = np.ascontiguousarray(bits).view(np.int64)[owner[take]]
                h = h[by]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[take].view(np.int64)), part.column("node").take(o),
                     part.column("c").take(o), part.column("stray").take(o),
                     pa.array((size[owner] - place)[take]), pa.array(size[owner][take]),
                     pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy()),
                     _before(h, np.flatnonzero(take), place[take])],
                    names=["shingle", "node", "c", "stray", "rest", "size", "s0", "s1", "before"])

    return texts.mapInArrow(run, "shingle long, node long, c long, stray boolean, rest long, "
                                 "size long, s0 long, s1 long, before array<long>")


def _unresolved(members: DataFrame, groups: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) that the stars did not settle: strays, nodes that
    are not in the component of a bucket's centre, with the nodes of other
    components in such buckets.

    A pair can only be linked if the rarest shingle that both sets hold leaves
    both of them enough of the rest: |A and B| >= t / (1 + t) (|A| + |B|).  So
    an equality join on the rare prefixes finds every such pair, and a family
    whose members keep their distance does not emit its pairs.  A row whose
    sets share one of the shingles just before it is not the rarest one of its
    pair, which has a row of its own, so it is left out; a pair of strays comes
    from its smaller node only."""
    placed = (members.join(groups.select("node", F.col("component").alias("c")), "node", "left")
              .join(groups.select(F.col("node").alias("centre"), F.col("component").alias("cc")),
                    "centre", "left")
              .select("key", "node", F.coalesce("c", "node").alias("c"),
                      F.coalesce("cc", "centre").alias("cc")))
    placed = stored(placed, "placed")
    keys = placed.where("c <> cc").select("key").distinct()
    nodes = stored(placed.join(keys, "key", "left_semi").groupBy("node", "c")
                   .agg(F.max(F.col("c") != F.col("cc")).alias("stray")), "open-nodes")
    wanted = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes
    texts = stored(docs.join(wanted, docs["id"] == nodes["node"]).select("node", "c", "stray", "text"),
                   "open-texts")
    prefixes = stored(_prefixes(texts), "prefixes")
    left = prefixes.where("stray").select("shingle", F.col("node").alias("x"), F.col("c").alias("cx"),
                                          F.col("rest").alias("rx"), F.col("size").alias("nx"),
                                          F.col("s0").alias("x0"), F.col("s1").alias("x1"),
                                          F.col("before").alias("bx"))
    right = prefixes.select("shingle", F.col("node").alias("y"), F.col("c").alias("cy"), "stray",
                            F.col("rest").alias("ry"), F.col("size").alias("ny"),
                            F.col("s0").alias("y0"), F.col("s1").alias("y1"),
                            F.col("before").alias("by"))
    enough = (F.least("rx", "ry") * (100 + THRESHOLD) >= (F.col("nx") + F.col("ny")) * THRESHOLD)
    # a first look at the signatures: a bit agrees with chance (1 + similarity) / 2
    differ = (F.bit_count(F.col("x0").bitwiseXOR(F.col("y0")))
              + F.bit_count(F.col("x1").bitwiseXOR(F.col("y1"))))
    most = HASHES - least_matches(HASHES, MISS, (1 + THRESHOLD / 100) / 2)
    once = ~F.col("stray") | (F.col("x") < F.col("y"))
    first = ~F.arrays_overlap("bx", "by")
    pairs = left.join(right, "shingle").where((F.col("cx") != F.col("cy")) & once & enough
                                              & (differ <= most) & first)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
