"""Toxicity by two class-conditional Kneser-Ney models.

Both models read words letter by letter: the probability of a letter after up to ``CONTEXT`` letters of its word.
Counts of a letter after its whole context are kept per class (toxic, ordinary) and discounted; what the discount
frees goes to shared lower orders, whose continuation counts come from the words of all texts, labelled or not.
An expression that the labelled texts hold rarely, such as an unseen ending of a known stem, is thereby smoothed
alike in both models and moves their ratio only as far as its known part does.

A text is compared by its toxic and ordinary log-likelihoods, normalised by its number of words: as they are, and
counting only what words exceed ``EXCESS`` by. The log ratios of its three most toxic words and its length come
beside them. A logistic curve turns these into a score. Its few coefficients are fitted on labelled rows that the models have not seen (``calibration``
fold), on at most ``CALIBRATION_ROWS`` of them in an order by hash.

All entries are kept. Where there are at most ``MODEL_ENTRIES`` of them, the workers get two arrays, the 64-bit hashes
of context and letter in order and their log ratios; a key that is absent backs off. With more entries nothing is broadcast: the
ratio of each distinct word is summed by joins, and the words of the texts, counted per text, are joined with it.
Both ways give the same features.

Labels are broadcast while there are at most ``BROADCAST_LABELS`` of them, else joined by a shuffle.

Defined cases: null and empty texts hold no words and are scored from zero features; null labels are no labels;
several labels of one id count as toxic if any is; with labels of one class only, every text gets the smoothed
share of that class; an empty table gives an empty result; repeated rows are scored alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Workspace, at_most
from . import batches
from .bpe import _slices

CONTEXT = 7
BACKOFF = (3, 1, 0)  # context lengths of the shared lower orders
DISCOUNT = 0.75
EXCESS = 2.0
MODEL_ENTRIES = 5_000_000  # 16 bytes each
CACHE_WORDS = 200_000  # words a worker remembers
FLUSH_WORDS = 200_000
SLICE_BYTES = 1_000_000  # of text that is split into words at once
CALIBRATION_ROWS = 20_000
BROADCAST_LABELS = 2_000_000
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W_]+")
_OFFSET, _PRIME = np.uint64(14695981039346656037), np.uint64(1099511628211)
FEATURES = ("mean", "excess", "word1", "word2", "word3", "length")


def _word_counts(df: DataFrame) -> DataFrame:
    """``word, toxic, ordinary``: occurrences in the texts of each class; ``df`` has ``text`` and ``toxic``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_class, unlabelled = (Counter(), Counter()), set()

        def flush() -> pa.RecordBatch:
            ordinary, toxic = of_class
            words = list(unlabelled.union(ordinary, toxic))
            out = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(map(toxic.__getitem__, words), pa.int64()),
                 pa.array(map(ordinary.__getitem__, words), pa.int64())], names=["word", "toxic", "ordinary"])
            for kept in (ordinary, toxic, unlabelled):
                kept.clear()
            return out

        for whole in parts:
            for batch in _slices(whole, "text", SLICE_BYTES):
                for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = _WORD.findall((text or "").lower())
                    if label is None:
                        unlabelled.update(words)
                    else:
                        of_class[label].update(words)
                if len(unlabelled) + sum(map(len, of_class)) > FLUSH_WORDS:
                    yield flush()
        yield flush()

    return df.select("text", F.col("toxic").cast("int")).mapInArrow(run, "word string, toxic long, ordinary long")


def _letters(counts: DataFrame) -> DataFrame:
    """``ctx, ch`` of every letter of each word, with up to ``CONTEXT`` letters before it; ``^`` and ``$`` bound a word."""
    s = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    at = counts.withColumn("s", s).withColumn("k", F.explode(F.sequence(F.lit(1), F.length(s) - 1)))
    ctx = F.substring(F.col("s"), F.greatest(F.col("k") - CONTEXT, F.lit(0)) + 1, F.least(F.col("k"), F.lit(CONTEXT)))
    return at.select("*", ctx.alias("ctx"), F.substring(F.col("s"), F.col("k") + 1, F.lit(1)).alias("ch")).drop("s", "k")


def _grams(counts: DataFrame) -> DataFrame:
    """``ctx, ch, toxic, ordinary``: each letter after its context."""
    return _letters(counts).groupBy("ctx", "ch").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _shared(grams: DataFrame, work: Workspace) -> DataFrame:
    """``ctx, ch, p``: probability of each letter after the last ``BACKOFF[0]`` letters, over all texts."""
    levels, types = [], grams.select("ctx", "ch")
    for n in BACKOFF:  # how many different longer contexts a letter continues
        types = types.groupBy(F.expr(f"right(ctx, {n})").alias("ctx"), "ch").agg(F.count("*").alias("c"))
        types = work.save(types, f"order{n}")
        levels.append(types)
    letters = levels[-1].count() + 1
    p = None
    for n, level in reversed(list(zip(BACKOFF, levels, strict=True))):
        total = level.groupBy("ctx").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
        rows = level.join(total, "ctx")
        if p is None:
            rows = rows.withColumn("low", F.lit(1.0 / letters))
        else:
            short = BACKOFF[BACKOFF.index(n) + 1]
            low = p.select(F.col("ctx").alias("short"), "ch", F.col("p").alias("low"))
            rows = rows.withColumn("short", F.expr(f"right(ctx, {short})")).join(low, ["short", "ch"])
        kept = F.greatest(F.col("c") - DISCOUNT, F.lit(0.0))
        p = rows.select("ctx", "ch", ((kept + DISCOUNT * F.col("kinds") * F.col("low")) / F.col("total")).alias("p"))
    return p


def _ratios(grams: DataFrame, work: Workspace) -> DataFrame:
    """``ctx, ch, ratio``: log of toxic over ordinary probability of a letter in its context, and, with a null ``ch``, of
    any letter not seen there."""
    seen = grams.filter("toxic + ordinary > 0")
    per = seen.groupBy("ctx").agg(
        F.sum("toxic").alias("n_t"), F.sum("ordinary").alias("n_o"),
        F.count_if(F.col("toxic") > 0).alias("k_t"), F.count_if(F.col("ordinary") > 0).alias("k_o"))
    per = work.save(per, "contexts")

    def freed(kinds: str, n: str):
        return F.when(F.col(n) > 0, DISCOUNT * F.col(kinds) / F.col(n)).otherwise(F.lit(1.0))

    def probability(count: str, kinds: str, n: str):
        own = F.when(F.col(n) > 0, F.greatest(F.col(count) - DISCOUNT, F.lit(0.0)) / F.col(n)).otherwise(F.lit(0.0))
        return own + freed(kinds, n) * F.col("p")

    low = _shared(grams, work).select(F.col("ctx").alias("short"), "ch", "p")
    rows = seen.join(per, "ctx").withColumn("short", F.expr(f"right(ctx, {BACKOFF[0]})")).join(low, ["short", "ch"])
    letters = rows.select("ctx", "ch",
                          F.log(probability("toxic", "k_t", "n_t") / probability("ordinary", "k_o", "n_o")).alias("ratio"))
    unseen = per.select("ctx", F.lit(None).cast("string").alias("ch"), F.log(freed("k_t", "n_t") / freed("k_o", "n_o")).alias("ratio"))
    return letters.union(unseen)


def _mixed(context: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """64-bit key of a letter (0: any) after a context hash."""
    h = (context ^ letter) * _PRIME
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _context(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of the letters of a context, the farthest first; 0 where the word has not begun."""
    h = np.full(len(columns[0]), _OFFSET, np.uint64)
    for letters in columns:
        h = (h ^ letters) * _PRIME
    return h


def _letters_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _keys(contexts: list[str], letters: list[str | None]) -> np.ndarray:
    """Keys of entries of the model."""
    rows = "".join(c.rjust(CONTEXT, "\0") + (x or "\0") for c, x in zip(contexts, letters, strict=True))
    matrix = _letters_of(rows).reshape(-1, CONTEXT + 1)
    return _mixed(_context([matrix[:, i] for i in range(CONTEXT)]), matrix[:, CONTEXT])


def _arrays(ratios: DataFrame) -> dict:
    """The entries as the workers get them: their keys, ascending, and the ratios."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            keys = _keys(b.column(0).to_pylist(), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column(2)], names=["key", "ratio"])

    rows = ratios.select("ctx", "ch", "ratio").mapInArrow(run, "key long, ratio double").toArrow()
    keys = rows.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return {"keys": keys[order], "ratios": rows.column("ratio").to_numpy()[order]}


class WordRatios(dict):
    """Log ratio of each word, computed for many new words at once."""

    def __init__(self, keys: np.ndarray, ratios: np.ndarray):
        self.keys_, self.ratios = keys, ratios

    def _find(self, wanted: np.ndarray) -> np.ndarray:
        """Ratio of each key, NaN where the model has none."""
        if not len(self.keys_):
            return np.full(len(wanted), np.nan)
        wanted, where = np.unique(wanted, return_inverse=True)  # ascending, so the search stays in cache
        at = np.minimum(np.searchsorted(self.keys_, wanted), len(self.keys_) - 1)
        return np.where(self.keys_[at] == wanted, self.ratios[at], np.nan)[where]

    def learn(self, words: set[str]) -> None:
        """Make the ratios of ``words`` known; may forget others."""
        if len(self) > CACHE_WORDS:
            self.clear()
        new = [w for w in words if w not in self]
        for start in range(0, len(new), 20_000):
            some = new[start:start + 20_000]
            size = np.fromiter(map(len, some), np.int64, len(some)) + 2
            letters = _letters_of("".join(f"^{w}$" for w in some))
            place = np.arange(len(letters)) - np.repeat(np.cumsum(size) - size, size)
            before = [np.where(place >= j, np.roll(letters, j), np.uint64(0)) for j in range(CONTEXT, 0, -1)]
            context, inner = _context(before), place > 0  # the mark of the beginning is no letter
            context, letters, owner = context[inner], letters[inner], np.repeat(np.arange(len(some)), size)[inner]
            found = self._find(_mixed(context, letters))
            absent = np.flatnonzero(np.isnan(found))
            found[absent] = np.nan_to_num(self._find(_mixed(context[absent], np.uint64(0))))
            self.update(zip(some, np.bincount(owner, found, len(some)).tolist(), strict=True))


def features(words: list[str], ratios: dict[str, float]) -> tuple[float, ...]:
    """Features of a text from its words and their log ratios."""
    if not words:
        return (0.0,) * len(FEATURES)
    r = np.fromiter(map(ratios.__getitem__, words), np.float64, len(words))
    top = [0.0] * 3
    best = np.sort(np.partition(r, len(r) - min(3, len(r)))[-3:])[::-1]
    top[:len(best)] = best.tolist()
    return float(r.mean()), float(np.maximum(r - EXCESS, 0).mean()), *top, math.log1p(len(r))


_FEATURES = T.StructType([T.StructField(n, T.DoubleType()) for n in FEATURES])


def _features_by_arrays(df: DataFrame, text: str, shared) -> DataFrame:
    """Add ``features`` of ``text`` to ``df``; only the text travels to Python."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # A worker keeps a broadcast value over its tasks, and with it the words it has met.
        model = shared.value
        ratios = model.get("words") or model.setdefault("words", WordRatios(model["keys"], model["ratios"]))
        for whole in texts:
            rows = []
            for part in _slices(pa.RecordBatch.from_arrays([whole], names=["text"]), "text", SLICE_BYTES):
                words = [_WORD.findall((t or "").lower()) for t in part.column(0).to_pylist()]
                ratios.learn(set().union(*words))
                rows += [features(w, ratios) for w in words]
            columns = list(zip(*rows, strict=True)) or [()] * len(FEATURES)
            yield pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], names=list(FEATURES))

    return df.withColumn("features", F.arrow_udf(run, _FEATURES)(F.col(text)))


def _word_ratios(counts: DataFrame, grams: DataFrame, ratios: DataFrame, work: Workspace) -> DataFrame:
    """``word, ratio`` of every distinct word, by joins."""
    backed = ratios.filter("ch IS NULL").select("ctx", F.col("ratio").alias("back"))
    each = grams.select("ctx", "ch").join(ratios.filter("ch IS NOT NULL"), ["ctx", "ch"], "left").join(backed, "ctx", "left")
    each = work.save(each.select("ctx", "ch", F.coalesce("ratio", "back", F.lit(0.0)).alias("ratio")), "letters")
    met = _letters(counts.select("word")).join(each, ["ctx", "ch"])
    return work.save(met.groupBy("word").agg(F.sum("ratio").alias("ratio")), "ratios")


def _text_key(text: str) -> list:
    return [F.xxhash64(text).alias("t1"), F.crc32(text).alias("t2")]


def _features_by_join(df: DataFrame, text: str, words: DataFrame) -> DataFrame:
    """Add ``features`` of ``text`` to ``df``: words are counted per text (equal texts count as one) and joined."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for part in _slices(whole, "text", SLICE_BYTES):
                for t1, t2, t in zip(*[part.column(i).to_pylist() for i in range(3)], strict=True):
                    found = Counter(_WORD.findall(t.lower()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t1] * len(found), pa.int64()), pa.array([t2] * len(found), pa.int64()),
                         pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["t1", "t2", "word", "n"])

    texts = df.filter(F.col(text).isNotNull()).select(*_text_key(text), F.col(text).alias("text"))
    uses = texts.mapInArrow(run, "t1 long, t2 long, word string, n long").groupBy("t1", "t2", "word").agg(F.max("n").alias("n"))
    met = uses.join(words, "word").select("t1", "t2", "n", "ratio")
    sums = met.groupBy("t1", "t2").agg(
        (F.sum(F.col("n") * F.col("ratio")) / F.sum("n")).alias("mean"),
        (F.sum(F.col("n") * F.greatest(F.col("ratio") - EXCESS, F.lit(0.0))) / F.sum("n")).alias("excess"),
        F.log1p(F.sum("n").cast("double")).alias("length"))
    place = F.row_number().over(Window.partitionBy("t1", "t2").orderBy(F.desc("ratio"), F.desc("n")))
    best = met.withColumn("place", place).filter("place <= 3").groupBy("t1", "t2").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "ratio", "n"))),
                              lambda x: F.array_repeat(x["ratio"], F.least(x["n"], F.lit(3)).cast("int")))).alias("top"))
    top = [F.coalesce(F.get("top", F.lit(i)), F.lit(0.0)).alias(f"word{i + 1}") for i in range(3)]
    found = sums.join(best, ["t1", "t2"]).select("t1", "t2", F.struct("mean", "excess", *top, "length").alias("found"))
    keyed = df.withColumns({"_t1": F.xxhash64(text), "_t2": F.crc32(text)})
    none = F.struct(*[F.lit(0.0).alias(n) for n in FEATURES])
    keyed = keyed.join(found, (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2")), "left")
    return keyed.withColumn("features", F.coalesce("found", none)).drop("_t1", "_t2", "t1", "t2", "found")


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Coefficients, intercept first, by Newton steps on standardised features; returned on the raw scale."""
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    w = np.zeros(z.shape[1])
    w[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = ridge * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    raw = w[1:] / sd
    return np.concatenate([[w[0] - raw @ mean], raw])


class Model:
    """A fitted model: ``score`` applies it."""

    def __init__(self, add_features, weights: np.ndarray):
        self.add_features, self.weights = add_features, weights

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``df`` with ``score`` and ``predicted`` added; a column named like a result is replaced."""
        row = F.struct(*[c for c in df.columns if c not in ("score", "predicted")]).alias("row")
        found = self.add_features(df.select(row, F.col(text).alias("text")), "text")
        z = F.lit(float(self.weights[0]))
        for name, w in zip(FEATURES, self.weights[1:], strict=True):
            z = z + F.lit(float(w)) * F.col("features")[name]
        score = 1 / (1 + F.exp(-z))
        return found.select("row.*", score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))


def fold(doc_id: str = "doc_id"):
    """0 to 3. The models learn from rows of folds 0 and 1, the calibration from fold 3, and fold 2 is held out."""
    return F.crc32(F.col(doc_id).cast("string")) % 4


def fit(docs: DataFrame, labels: DataFrame, work: Workspace, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic", model_entries: int = MODEL_ENTRIES) -> Model:
    """Learn from ``docs`` (all their words) and ``labels`` (``doc_id`` and ``label``)."""
    spark = docs.sparkSession
    batches.bound(spark)
    marked = (labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id"))
              .agg((F.max(label) > 0).cast("int").alias("toxic")).withColumn("fold", fold("id")).filter("fold <> 2"))
    marked = work.save(marked, "labels")
    small = at_most(marked, BROADCAST_LABELS)
    side = F.broadcast(marked) if small else marked
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(side, "id", "left")
    learn = rows.select("text", F.when(F.col("fold") < 2, F.col("toxic")).alias("toxic"))
    counts = work.save(_word_counts(learn).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "words")
    grams = work.save(_grams(counts), "grams")
    ratios = work.save(_ratios(grams, work), "entries")
    if at_most(ratios, model_entries):
        shared = spark.sparkContext.broadcast(_arrays(ratios))
        add_features = lambda df, text: _features_by_arrays(df, text, shared)
    else:
        words = _word_ratios(counts, grams, ratios, work)
        add_features = lambda df, text: _features_by_join(df, text, words)
    ids = marked.filter("fold = 3").orderBy(F.xxhash64("id"), "id").limit(CALIBRATION_ROWS).select("id", "toxic")
    check = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), "id")
    sample = add_features(check.select("text", "toxic"), "text").select("toxic", "features.*").toPandas()
    x, y = sample[list(FEATURES)].to_numpy(float), sample["toxic"].to_numpy(float)
    if len(y) and 0 < y.sum() < len(y):
        weights = _logistic(x, y)
    else:
        share = marked.agg(F.sum("toxic"), F.count("*")).first()
        share = ((share[0] or 0) + 0.5) / (share[1] + 1)
        weights = np.array([math.log(share / (1 - share))] + [0.0] * len(FEATURES))
    return Model(add_features, weights)
