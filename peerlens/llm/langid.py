"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of ``ORDER`` characters over the letter runs of
words (a run's start and end are symbols of their own).  The models of
``BLOCK`` languages share one sorted array of n-gram hashes per order; a row
holds the languages' values.  A text gets the language whose model codes it with the
fewest bits per symbol.  A text is *rejected* when even that is more than the
language's own texts need: more than their mean by ``MARGIN`` times the excess
that a share of ``MISS`` of a held-out part of the sample passes, and by
``SIGMAS`` standard errors of the text's own length.

Models are fitted on a bounded sample: per language at most ``TRAIN_ROWS``
texts, those with the smallest id hash, of each the first ``TRAIN_CHARS``
characters; every language that occurs gets a model.  A task fits and
calibrates a language, counting ``FIT_SYMBOLS`` at a time; the driver gets only
the tables.  Every text is judged whole, by one block of languages after the other.

Cases: a null text or one without a letter is ``und`` with score 0, and
rejected; ties go to the alphabetically first language; null ids and null
languages are no training rows; repeated rows are judged one by one; without
training rows all texts are ``und``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from peerlens.llm.text import chunks, mix, owners, words

ORDER = 4
TRAIN_ROWS, TRAIN_CHARS = 400, 20_000
PIECE_BYTES = 1 << 19       # text scored at once
BLOCK = 16                  # languages that share a table
SPARE = 4                   # rows per training row that the window ranks
FIT_SYMBOLS = 1 << 18       # symbols counted at once
MISS, MARGIN, SIGMAS = 0.001, 1.5, 4.0
LEAST_LIMIT = 1.5           # bits per symbol
UNKNOWN_SYMBOLS = 2000      # symbols that share the mass of unseen ones
SHARPNESS = 40              # symbols at most that the score counts as evidence
UNDETERMINED = "und"

_LETTER = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False
                    for c in range(0x10000)])
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                             0xD6E8FEB86659FD93)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def symbols(points: np.ndarray) -> np.ndarray:
    """Code points of lower-cased text with 0 for all but letters."""
    letter = _LETTER[np.minimum(points, 0xFFFF)]
    if len(high := np.flatnonzero(points > 0xFFFF)):
        letter = letter.copy()
        letter[high] = [chr(c).isalpha() for c in points[high]]
    return np.where(letter, points, 0).astype(np.uint64)


def events(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols to be coded: positions (letters, and the end of each run)
    and hashes [order][position], the context before each symbol included.
    A context reaches back to the start of its run."""
    before = np.zeros(len(c), np.uint64)
    before[1:] = c[:-1]
    at = np.flatnonzero((c > 0) | (before > 0))
    back = [c[at]]
    for k in range(1, ORDER):
        prev = np.where(at >= k, c[np.maximum(at - k, 0)], 0)
        if k > 1:
            prev = np.where(back[-1] > 0, prev, 0)
        back.append(prev)
    hashes, acc = [], np.zeros(len(at), np.uint64)
    for k in range(ORDER):
        acc = acc + (back[k] + np.uint64(1)) * _K[k]
        hashes.append(mix(acc + np.uint64(k)))
    return at, np.array(hashes)


def contexts(c: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes [order][position] of the contexts alone (order 1: one context)."""
    out, acc = [np.zeros(len(at), np.uint64)], np.zeros(len(at), np.uint64)
    prev = None
    for k in range(1, ORDER):
        here = np.where(at >= k, c[np.maximum(at - k, 0)], 0)
        if prev is not None:
            here = np.where(prev > 0, here, 0)
        prev = here
        acc = acc + (here + np.uint64(1)) * _K[k]
        out.append(mix(acc + np.uint64(97 + k)))
    return np.array(out)


class Table(NamedTuple):
    """Sorted hashes with one row of values per hash."""

    keys: np.ndarray
    values: np.ndarray

    def rows(self, wanted: np.ndarray, absent: float) -> np.ndarray:
        if len(self.keys) == 0:
            return np.full((len(wanted), self.values.shape[1]), absent, np.float32)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted)[:, None], self.values[at], np.float32(absent))


class Models(NamedTuple):
    langs: list[str]
    seen: list[Table]       # discounted share of an n-gram in its context
    left: list[Table]       # mass a context leaves to the shorter order
    mean: np.ndarray        # bits per symbol of a language's own texts
    spread: np.ndarray      # standard deviation of the bits of a symbol
    limit: np.ndarray       # calibrated excess, bits per symbol

    def bits(self, grams: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """Code length of each symbol under each language."""
        p = np.full((grams.shape[1], len(self.langs)), 1 / UNKNOWN_SYMBOLS, np.float32)
        for k in range(ORDER):
            p = self.seen[k].rows(grams[k], 0.0) + self.left[k].rows(ctx[k], 1.0) * p
        return -np.log2(p)


def _batches(texts: list[str]) -> Iterator[np.ndarray]:
    """The symbols of the texts, some ``FIT_SYMBOLS`` (a text at least) at once."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text) + 1
        if size >= FIT_SYMBOLS:
            yield symbols(code_points("\n".join(held)))
            held, size = [], 0
    if held:
        yield symbols(code_points("\n".join(held)))


def _longest(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the n-grams of the longest order, and per such n-gram its
    hashes and its contexts' hashes [order][n-gram]."""
    grams = ctx = np.zeros((ORDER, 0), np.uint64)
    count = np.zeros(0, np.int64)
    for c in _batches(texts):
        at, new = events(c)
        around = contexts(c, at)
        _, first, n = np.unique(new[-1], return_index=True, return_counts=True)
        grams = np.concatenate([grams, new[:, first]], axis=1)
        ctx = np.concatenate([ctx, around[:, first]], axis=1)
        _, first, inverse = np.unique(grams[-1], return_index=True, return_inverse=True)
        count = np.bincount(inverse, weights=np.r_[count, n], minlength=len(first)).astype(np.int64)
        grams, ctx = grams[:, first], ctx[:, first]
    return count, grams, ctx


def _kneser_ney(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per order: n-gram hashes, their discounted shares, contexts, masses left."""
    count, grams, ctx = _longest(texts)
    keys, first, out = grams[-1], np.arange(len(count)), []
    for k in range(ORDER - 1, -1, -1):
        if k < ORDER - 1:       # continuation counts: distinct longer n-grams that end in it
            keys, pick, count = np.unique(grams[k][first], return_index=True, return_counts=True)
            first = first[pick]
        n1, n2 = (count == 1).sum(), (count == 2).sum()
        d = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.05
        own, inverse = np.unique(ctx[k][first], return_inverse=True)
        total = np.bincount(inverse, weights=count, minlength=len(own))
        types = np.bincount(inverse, minlength=len(own))
        out.append((keys, (count - d) / total[inverse], own, d * types / total))
    return out[::-1]


def pooled(every: list[Models]) -> Models | None:
    """The models of some languages as one, each with the values it had alone."""
    every = sorted(every, key=lambda m: m.langs)
    if not every:
        return None

    def table(parts: list[Table], absent: float) -> Table:
        keys = np.unique(np.concatenate([t.keys for t in parts]))
        values = np.full((len(keys), len(parts)), absent, np.float32)
        for col, t in enumerate(parts):
            values[np.searchsorted(keys, t.keys), col] = t.values[:, 0]
        return Table(keys, values)

    return Models([m.langs[0] for m in every],
                  [table([m.seen[k] for m in every], 0.0) for k in range(ORDER)],
                  [table([m.left[k] for m in every], 1.0) for k in range(ORDER)],
                  *(np.concatenate([m[k] for m in every]) for k in (3, 4, 5)))


def fit_language(lang: str, texts: list[str]) -> Models | None:
    """The model of one language, fitted on three of four texts; the fourth
    ones calibrate the rejection (all, if there are fewer than four).  None
    if no text has a letter."""
    texts = [t for t in texts if symbols(code_points(t)).any()]
    if not texts:
        return None
    orders = _kneser_ney([t for k, t in enumerate(texts) if k % 4 or len(texts) < 4])
    tables = [[Table(o[k], o[k + 1].astype(np.float32)[:, None]) for o in orders] for k in (0, 2)]
    model = Models([lang], *tables, *np.zeros((3, 1)))
    texts = texts[::4]
    bits, n = code_lengths(model, pa.array(texts, pa.string()))
    model.mean[0] = bits.sum() / n.sum()
    coded = [model.bits(grams, contexts(c, at))[:, 0]
             for c in _batches(texts) for at, grams in [events(c)]]
    model.spread[0] = np.concatenate(coded).std()
    excess = bits[:, 0] / n - model.mean[0]
    model.limit[0] = max(LEAST_LIMIT, MARGIN * np.quantile(excess, 1 - MISS))
    return model


def blocks(every: list[Models]) -> list[Models]:
    """The models of all languages in blocks, in alphabetical order."""
    every = sorted(every, key=lambda m: m.langs)
    return [pooled(every[i:i + BLOCK]) for i in range(0, len(every), BLOCK)]


def fit(samples: dict[str, list[str]]) -> Models | None:
    """Models of the languages of a sample."""
    found = [fit_language(lang, texts) for lang, texts in samples.items()]
    return pooled([m for m in found if m])


def code_lengths(models: Models | list[Models], column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bits of every text under every language (of one block or several),
    and its number of symbols.

    Equal words are coded once: a run's code depends on the run alone."""
    w = words(column)
    docs = len(column)
    every = models if isinstance(models, list) else [models]
    total, n = np.zeros((docs, sum(len(m.langs) for m in every))), np.zeros(docs, np.int64)
    if len(w.hashes) == 0:
        return total, n
    # the word hash folds A-Z, and so does lower-casing
    _, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
    size = w.ends[first] - w.starts[first] + 1          # with a separator
    stop = np.cumsum(size)
    at = np.arange(stop[-1]) - np.repeat(stop - size - w.starts[first], size)
    raw = w.data[np.minimum(at, len(w.data) - 1)].copy()
    raw[stop - 1] = 10
    points = code_points(raw.tobytes().decode("utf-8", "replace"))
    c, gap = symbols(points), points == 10
    word = np.cumsum(gap)
    at, grams = events(c)
    if len(at) == 0:
        return total, n
    ctx = contexts(c, at)
    _, one, back = np.unique(grams[-1], return_index=True, return_inverse=True)
    # an event at a separator ends the word before it
    of = word[at] - gap[at]
    owner = owners(w.offsets)
    col = 0
    for m in every:
        for b in np.ascontiguousarray(m.bits(grams[:, one], ctx[:, one]).T):
            per_word = np.bincount(of, weights=b[back], minlength=len(first))
            total[:, col] = np.bincount(owner, weights=per_word[inverse], minlength=docs)
            col += 1
    length = np.bincount(of, minlength=len(first))
    n = np.bincount(owner, weights=length[inverse], minlength=docs).astype(np.int64)
    return total, n


def identify(models: Models | list[Models] | None, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it is rejected, of every text."""
    docs = len(column)
    if not models:
        return [UNDETERMINED] * docs, np.zeros(docs), np.ones(docs, bool)
    total, n = code_lengths(models, column)
    every = models if isinstance(models, list) else [models]
    langs = [lang for m in every for lang in m.langs]
    mean, spread, limit = (np.concatenate([m[k] for m in every]) for k in (3, 4, 5))
    rate = total / np.maximum(n, 1)[:, None]
    best = rate.argmin(1)
    low = rate[np.arange(docs), best]
    odds = 2.0 ** -((rate - low[:, None]) * np.minimum(n, SHARPNESS)[:, None])
    none = n == 0
    score = np.where(none, 0.0, 1 / odds.sum(1))
    error = spread[best] / np.sqrt(np.maximum(n, 1))
    allowed = mean[best] + limit[best] + SIGMAS * error
    names = np.array([*langs, UNDETERMINED], dtype=object)
    lang = list(names[np.where(none, len(langs), best)])
    return lang, score, none | (low > allowed)


def sample(docs: DataFrame, use: F.Column, id_col: str = "doc_id", text_col: str = "text",
           lang_col: str = "lang") -> DataFrame:
    """(lang, h, text): the training texts, from rows for which ``use`` holds.

    Only rows with a hash below a language's bound, ``SPARE`` times the sample
    on average, reach the window, so no task ranks a language's rows."""
    usable = docs.where(use & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull()
                        & (F.length(text_col) > 0)).select(
        F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"))
    # a row per language, like the models
    langs = F.broadcast(usable.groupBy(F.col("lang").alias("_lang")).agg(F.count("h").alias("_all")))
    share = SPARE * TRAIN_ROWS / F.col("_all")
    below = usable.join(langs, F.col("lang") == F.col("_lang")).where(
        (share >= 1) | (F.col("h").cast("double") <= share * 2.0**64 - 2.0**63)).select(
        "lang", "h", F.substring("text", 1, TRAIN_CHARS).alias("text"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    return (below.groupBy("lang", "h").agg(F.min("text").alias("text"))
            .withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= TRAIN_ROWS)
            .select("lang", "h", "text"))


def _fitted(table: pa.Table) -> pa.Table:
    """A language's sample as a row of its model's arrays."""
    table = table.sort_by("h")
    lang = table.column("lang")[0].as_py()
    model = fit_language(lang, table.column("text").to_pylist())
    row = {"lang": lang}
    if model:
        row["numbers"] = [float(x[0]) for x in model[3:]]
        row["keys"] = [t.keys.tobytes() for t in [*model.seen, *model.left]]
        row["shares"] = [t.values.tobytes() for t in [*model.seen, *model.left]]
    return pa.Table.from_pylist([row] if model else [], pa.schema([
        ("lang", pa.string()), ("numbers", pa.list_(pa.float64())),
        ("keys", pa.list_(pa.binary())), ("shares", pa.list_(pa.binary()))]))


def _model(row: Row) -> Models:
    tables = [Table(np.frombuffer(k, np.uint64), np.frombuffer(v, np.float32)[:, None])
              for k, v in zip(row["keys"], row["shares"])]
    return Models([row["lang"]], tables[:ORDER], tables[ORDER:],
                  *(np.array([x]) for x in row["numbers"]))


def train(docs: DataFrame, use: F.Column | None = None, **columns):
    """Broadcast models in blocks, bounded by the sample of each language."""
    use = F.lit(True) if use is None else use
    rows = (sample(docs, use, **columns).groupBy("lang")
            .applyInArrow(_fitted, "lang string, numbers array<double>, keys array<binary>, "
                                   "shares array<binary>").collect())    # a row per language
    return docs.sparkSession.sparkContext.broadcast(blocks([_model(r) for r in rows]))


def _pieces(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of about ``PIECE_BYTES`` (a row at least): scoring holds some
    hundred bytes for each byte of text."""
    for part in chunks(batch, column):
        todo = [part]
        while todo:
            part = todo.pop()
            half = part.num_rows // 2
            if half and part.nbytes > PIECE_BYTES:
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def predict(docs: DataFrame, models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and rejected of every text."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                lang, score, rejected = identify(models.value, part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(lang, pa.string()), pa.array(score),
                     pa.array(rejected)], names=["id", "lang_pred", "score", "rejected"])

    return source.mapInArrow(run, f"id {id_type}, lang_pred string, score double, rejected boolean"
                             ).withColumnRenamed("id", id_col)


def keep(docs: DataFrame, models, text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, text_col):
                column = part.column(part.schema.get_field_index(text_col))
                yield part.filter(pa.array(~identify(models.value, column)[2]))

    return docs.mapInArrow(run, docs.schema)
