"""Language identification with interpolated Kneser-Ney character models.

One model per language over the letters of words (a word is a maximal run of letters, lower-cased, between
boundary marks). Every order is a sorted array of 64-bit n-gram hashes with a column of probabilities per language;
contexts are a second sorted array with their back-off weights. A document's cross-entropy is the mean over its character
events, so a word's score is computed once per distinct word and task, and looked up for each occurrence.

Rejection is calibrated on labelled rows that the models have not seen: a document is rejected if its cross-entropy,
with every word taken in that word's best language, lies more than `z` standard deviations above the mean of its
language's documents of similar length. So a text in several known languages stays.

Defined results: null text or text without a letter gives `und`, score 0, rejected. Repeated rows give repeated
results. An empty table gives no rows; without any labelled row every document gets `und`. Ties between
languages go to the first in alphabetical order. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import composed, slices, table

UNKNOWN = "und"
ORDER = 5
BUCKETS = 1024
WORD = re.compile(r"[^\W\d_]+")
PAD = "\0" * (ORDER - 1)
LONGEST = 48  # longer runs of letters are scored like any other, but not kept in the cache
CACHED_WORDS = 120_000
LEAST_SPREAD = 0.15  # bits; long texts vary so little that a word repeated over and over would be rejected
STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """One sorted hash array per order beside a column of log2 values per language.

    grams[k] has the n-grams of order k + 1 that any language has seen, with every language's interpolated
    probability; contexts[k] their contexts, with every language's back-off weight (0 where it has not seen one).
    """

    languages: list[str]
    alphabet: int
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    limits: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))  # language x length band


def words_of(text: str) -> list[str]:
    return WORD.findall(composed(text).lower())


def has_letter(words: list[str]) -> bool:
    return any(any(map(str.isalpha, w)) for w in words)


def padded_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the padded words in one array, and the length of each padded word."""
    padded = [PAD + w + "\0" for w in words]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes.astype(np.uint64), np.fromiter(map(len, padded), np.int64, len(padded))


def gram_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """hashes[k][t]: the hash of the k symbols that end at t (k = 0: the empty context)."""
    hashes = [np.zeros(len(codes), np.uint64)]
    for k in range(1, ORDER + 1):
        last = np.zeros(len(codes), np.uint64)
        last[k - 1:] = codes[:max(0, len(codes) - k + 1)]
        mixed = (hashes[-1] + last + np.uint64(k)) * STEP
        hashes.append(mixed ^ (mixed >> np.uint64(29)))
    return hashes


def _look_up(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is there, and its place."""
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    return hashes[at] == keys, at


def _language_tables(grams: np.ndarray, counts: np.ndarray, alphabet: int) -> list[tuple[np.ndarray, ...]]:
    """grams: one row of ORDER code points per distinct n-gram. Highest order: counts; lower ones: continuations.

    Per order: n-gram hashes, log2 probabilities, hashes of suffix and context; context hashes, log2 weights.
    """
    levels: list[tuple[np.ndarray, np.ndarray]] = [(grams, counts.astype(np.float64))]
    for _ in range(ORDER - 1):
        shorter, types = np.unique(levels[0][0][:, 1:], axis=0, return_counts=True)
        levels.insert(0, (shorter, types.astype(np.float64)))
    lower_hash, lower_probability = np.zeros(1, np.uint64), np.array([1 / alphabet])
    tables = []
    for k, (rows, n) in enumerate(levels, start=1):
        flat = rows.astype(np.uint64).ravel()
        hashes = gram_hashes(flat)
        ends = np.arange(k - 1, len(flat), k)
        own, suffix = hashes[k][ends], hashes[k - 1][ends]
        context = hashes[k - 1][ends - 1] if k > 1 else np.zeros(len(rows), np.uint64)
        names, group = np.unique(context, return_inverse=True)
        total = np.bincount(group, weights=n)
        once, twice = (n == 1).sum(), (n == 2).sum()
        discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
        gamma = discount * np.bincount(group) / total
        lower = lower_probability[np.searchsorted(lower_hash, suffix)]
        probability = (n - discount) / total[group] + gamma[group] * lower
        order = np.argsort(own, kind="stable")
        lower_hash, lower_probability = own[order], probability[order]
        tables.append((lower_hash, np.log2(lower_probability), suffix[order], context[order], names, np.log2(gamma)))
    return tables


def build_model(rows: pd.DataFrame) -> Model:
    """rows: lang, gram (ORDER characters), n."""
    languages = sorted(rows["lang"].unique())
    alphabet = len({c for g in rows["gram"] for c in g}) + 1
    per_language = []
    for language in languages:
        own = rows[rows["lang"] == language].sort_values("gram")
        codes = np.frombuffer("".join(own["gram"]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        per_language.append(_language_tables(codes.reshape(-1, ORDER), own["n"].to_numpy(), alphabet))
    grams, contexts = [], []
    lower = np.zeros(1, np.uint64), np.full((1, len(languages)), -np.log2(alphabet))
    for k in range(ORDER):
        tables = [t[k] for t in per_language]
        names = np.unique(np.concatenate([t[4] for t in tables]))
        weights = np.zeros((len(names), len(languages)))
        for l, t in enumerate(tables):
            weights[np.searchsorted(names, t[4]), l] = t[5]
        hashes, first = np.unique(np.concatenate([t[0] for t in tables]), return_index=True)
        suffix = np.concatenate([t[2] for t in tables])[first]
        context = np.concatenate([t[3] for t in tables])[first]
        values = lower[1][np.searchsorted(lower[0], suffix)] + weights[np.searchsorted(names, context)]
        for l, t in enumerate(tables):
            values[np.searchsorted(hashes, t[0]), l] = t[1]
        lower = hashes, values
        grams.append((hashes, values.astype(np.float32)))
        contexts.append((names, weights.astype(np.float32)))
    return Model(languages, alphabet, grams, contexts)


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """log2 probability of every word (its letters and its end) in every language, from the highest order down."""
    codes, lengths = padded_codes(words)
    hashes = gram_hashes(codes)
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    inside = np.ones(len(codes), bool)
    inside[(firsts[:, None] + np.arange(ORDER - 1)).ravel()] = False
    events = np.flatnonzero(inside)
    starts = np.concatenate(([0], np.cumsum(lengths - (ORDER - 1))[:-1]))
    value = np.zeros((len(events), len(model.languages)), np.float32)
    open_ = np.arange(len(events))
    for k in range(ORDER, 0, -1):
        seen, at = _look_up(model.grams[k - 1][0], hashes[k][events[open_]])
        value[open_[seen]] += model.grams[k - 1][1][at[seen]]
        open_ = open_[~seen]
        known, at = _look_up(model.contexts[k - 1][0], hashes[k - 1][events[open_] - 1])
        value[open_[known]] += model.contexts[k - 1][1][at[known]]
    value[open_] -= np.float32(np.log2(model.alphabet))
    return np.add.reduceat(value, starts, axis=0)


class Scorer:
    """Cross-entropies of texts; keeps the scores of words it has met, up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model, self.index = model, {}
        self.table = np.empty((0, len(model.languages)), np.float32)
        self.best = np.empty(0, np.float32)

    def _learn(self, batches: list[list[str]]) -> None:
        fresh = [w for w in set().union(*batches) if w not in self.index]
        if len(self.table) + len(fresh) > CACHED_WORDS:
            self.index, self.table = {}, self.table[:0]
            fresh = set().union(*batches)
        fresh = sorted(fresh)
        if fresh:
            self.index.update(zip(fresh, range(len(self.table), len(self.table) + len(fresh))))
            self.table = np.concatenate([self.table, word_scores(self.model, fresh)])
            self.best = self.table.max(axis=1)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: bits per event in each language, the same with every word in its own best language, number of
        events, whether it has a letter."""
        words = [words_of(t) if t else [] for t in texts]
        entropy = np.zeros((len(texts), len(self.model.languages)))
        blend = np.zeros(len(texts))
        events = np.zeros(len(texts), np.int64)
        lettered = np.fromiter((has_letter(w) for w in words), bool, len(words))
        self._learn(words)
        for i, own in enumerate(words):
            if own:
                ids = np.fromiter(map(self.index.__getitem__, own), np.int64, len(own))
                events[i] = sum(map(len, own)) + len(own)
                entropy[i] = -self.table[ids].sum(axis=0, dtype=np.float64) / events[i]
                blend[i] = -self.best[ids].sum(dtype=np.float64) / events[i]
        for word in {w for own in words for w in own if len(w) > LONGEST}:
            del self.index[word]
        return entropy, blend, events, lettered


def bands(events: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(events, 1)).astype(np.int64)


def _gram_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            words = Counter(words_of(text))
            own = counts.setdefault(lang, Counter())
            for word, n in words.items():
                padded = PAD + word + "\0"
                for i in range(len(word) + 1):
                    own[padded[i:i + ORDER]] += n
    for lang, own in counts.items():
        yield pd.DataFrame({"lang": lang, "gram": list(own), "n": list(own.values())})


def labelled(docs: DataFrame, learn: Column) -> DataFrame:
    return (docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
            .select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket"),
                    (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)).alias("thin")))


def _shares(rows: DataFrame, train_chars: int) -> tuple[DataFrame, DataFrame]:
    """Training and calibration rows: hash buckets of each language up to the bound, and as many after them.

    A language whose first bucket holds more than its bound takes the same share of every bucket chosen, by another
    hash, so that a sample stays about as large whatever the input. Only sums of lengths per language and bucket reach
    the driver.
    """
    sizes = rows.groupBy("lang", "bucket").agg(F.sum(F.length("text")).alias("chars")).collect()
    by_lang: dict[str, list[tuple[int, int]]] = {}
    for r in sizes:
        by_lang.setdefault(r["lang"], []).append((r["bucket"], r["chars"] or 0))
    train, check = F.lit(False), F.lit(False)
    for lang, own in by_lang.items():
        most, spent, chosen = train_chars // len(by_lang), 0, []
        own.sort()
        for bucket, chars in own[:max(1, len(own) * 3 // 4)]:
            if spent + chars <= most or not chosen:
                chosen.append(bucket)
                spent += chars
        rest = [b for b, _ in own if b not in set(chosen)]
        held = rest[:max(1, len(chosen) // 2)] or chosen
        taken = (F.col("lang") == lang) & (F.col("thin") < min(1.0, most / max(1, spent)))
        train = train | (taken & F.col("bucket").isin(chosen))
        check = check | (taken & F.col("bucket").isin(held))
    return rows.where(train), rows.where(check)


def fit(docs: DataFrame, learn: Column, train_chars: int = 4_000_000, z: float = 8.0) -> Model | None:
    """Models of the languages in `lang`, from a sample of about train_chars characters in all, and their rejection limits from other labelled rows."""
    rows = labelled(docs, learn)
    train, check = _shares(rows, train_chars)
    grams = (train.select("lang", "text").mapInPandas(_gram_rows, "lang string, gram string, n long")
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())
    if not len(grams):
        return None
    model = build_model(grams)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def own_entropy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, place = Scorer(shared.value), {l: i for i, l in enumerate(shared.value.languages)}
        for batch in (b.iloc[i:i + 500] for b in batches for i in range(0, len(b), 500)):
            batch = batch[batch["lang"].isin(place)]
            entropy, _, events, lettered = scorer.score(list(batch["text"]))
            own = entropy[np.arange(len(batch)), [place[l] for l in batch["lang"]]] if len(batch) else np.empty(0)
            yield pd.DataFrame({"lang": batch["lang"].to_numpy(), "band": bands(events), "bits": own})[lettered]

    spread = (check.select("lang", "text").mapInPandas(own_entropy, "lang string, band long, bits double")
              .groupBy("lang", "band").agg(F.count("*").alias("n"), F.avg("bits").alias("mean"),
                                           F.coalesce(F.stddev("bits"), F.lit(0.0)).alias("sd")).collect())
    model.limits = _limits(model, spread, z)
    return model


def _limits(model: Model, spread: list, z: float) -> np.ndarray:
    """Limits per language and length band; a band of under 20 rows takes that of the nearest one with more, or the
    pooled one if none has."""
    limits = np.full((len(model.languages), 64), np.inf)
    for l, lang in enumerate(model.languages):
        rows = [r for r in spread if r["lang"] == lang]
        own = {r["band"]: r["mean"] + z * max(r["sd"], LEAST_SPREAD) for r in rows if r["n"] >= 20}
        if rows and not own:
            n = sum(r["n"] for r in rows)
            mean = sum(r["n"] * r["mean"] for r in rows) / n
            square = sum(r["n"] * (r["sd"] ** 2 + r["mean"] ** 2) for r in rows) / n
            own = {max(r["band"] for r in rows): mean + z * max((max(square - mean * mean, 0)) ** 0.5, LEAST_SPREAD)}
        for band in range(64 if own else 0):
            limits[l, band] = own[min(own, key=lambda b: (abs(b - band), b))]
            if band < min(own):  # shorter than anything calibrated: only far beyond the alphabet's own entropy
                limits[l, band] = max(limits[l, band], 2 * np.log2(model.alphabet))
    return limits


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (share of the best language among all, by bits per event), bits, rejected."""
    rows = docs.select("doc_id", "text")
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(None).cast("double").alias("bits"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        names = np.array(shared.value.languages, dtype=object)
        for batch in (part for whole in batches for part in slices(whole)):
            entropy, blend, events, lettered = scorer.score(batch.column(1).to_pylist())
            best = entropy.argmin(axis=1)
            bits = entropy[np.arange(len(batch)), best]
            # likelihood ratio of the shortest texts at most 32 events long, so that long texts stay comparable
            weight = np.exp2(-(entropy - bits[:, None]) * np.minimum(events, 32)[:, None])
            over = blend > shared.value.limits[best, bands(events)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.where(lettered, names[best], UNKNOWN), pa.string()),
                 pa.array(np.where(lettered, 1 / weight.sum(axis=1), 0.0)), pa.array(bits, mask=~lettered),
                 pa.array(over | ~lettered)], ["doc_id", "lang_pred", "score", "bits", "rejected"])

    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, bits double, rejected boolean")


def known(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, all columns, that identify() does not reject."""
    if model is None:
        return docs.where(F.lit(False))
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in (part for whole in batches for part in slices(whole, place)):
            entropy, blend, events, lettered = scorer.score(batch.column(place).to_pylist())
            within = blend <= shared.value.limits[entropy.argmin(axis=1), bands(events)]
            yield batch.filter(pa.array(within & lettered))

    return docs.mapInArrow(keep, docs.schema)


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """Language of every document; learns only from rows outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out())
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits",
                                        "rejected")
