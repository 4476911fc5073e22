"""Toxicity by a classifier chain.

Categories are predicted in order; each linear model sees the text's features and
the log-odds of the categories before it. In training, those log-odds are
out-of-fold: they come from models that did not see the row. The models are fitted
on a bounded sample of labelled rows and applied to every row.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, stage, working_names
from .linear import Rows, fit_logistic, logit, sigmoid

SAMPLE = 6_000  # labelled rows that the chain is fitted on, at most
FEATURES = 20_000  # columns kept, by document frequency in the sample
HASHED = 2**20
FOLDS = 3
EDGES = b".,;:!?\"'()[]{}<>*-_"

#: Seed words of the weak categories that precede the labelled one.
SEEDS = {"insult": ("idiot", "moron", "loser", "clown", "stupid", "fool", "dumb"), "contempt": ("scum", "trash", "worthless", "pathetic", "disgusting", "vermin", "filth")}


def word_features(word: bytes) -> tuple[int, ...]:
    """Hashed columns of a lower-cased word: itself and its beginnings of 4, 5 and 6 bytes."""
    word = word.strip(EDGES)
    if not word:
        return ()
    parts = {b"w" + word, *(b"%d" % n + word[:n] for n in (4, 5, 6))}
    return tuple(zlib.crc32(p) % HASHED for p in parts)


def feature_lists(texts: pd.Series, known: dict[int, int] | None, cache: dict[bytes, tuple[int, ...]]) -> list[np.ndarray]:
    """Distinct columns of each text; ``known`` renumbers columns and drops the others."""
    out = []
    for text in texts:
        found: set[int] = set()
        for w in set(bytes(text).lower().split()):
            f = cache.get(w)
            if f is None:
                if len(cache) > 300_000:
                    cache.clear()
                f = word_features(w)
                f = cache[w] = f if known is None else tuple(known[x] for x in f if x in known)
            found.update(f)
        out.append(np.fromiter(sorted(found), np.int32, len(found)))
    return out


@dataclass
class Chain:
    """A fitted chain: column of each kept feature, weights by category, and the last category's threshold."""

    categories: list[str]
    known: dict[int, int]
    weights: list[np.ndarray]
    threshold: float = math.inf

    def score(self, lists: list[np.ndarray]) -> np.ndarray:
        before = np.empty((len(lists), 0))
        for w in self.weights:
            p = sigmoid(Rows(lists, len(self.known), before).dot(w))
            before = np.column_stack([before, logit(p)])
        return sigmoid(before)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Threshold of highest F1 on out-of-fold probabilities, halfway (in log-odds) to the next lower one.

    Rows of one class teach nothing: the threshold is infinite and nothing is flagged.
    """
    if not y.any() or y.all():
        return math.inf
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = -1  # no cut between equal probabilities
    i = int(np.argmax(f1))
    after = p[order][i + 1] if i + 1 < len(p) else 0.0
    return float(sigmoid((logit(p[order][i : i + 1]) + logit(np.array([after]))) / 2)[0])


def train_chain(lists: list[np.ndarray], labels: np.ndarray, categories: list[str], l2: float = 0.2) -> Chain:
    """Fit a chain on rows of hashed columns; labels has a 0/1 column for each category."""
    number, times = np.unique(np.concatenate([*lists, np.empty(0, np.int32)]), return_counts=True)
    often = number[np.lexsort((number, -times))][:FEATURES]
    known = {int(x): i for i, x in enumerate(often)}
    return train_known([np.array([known[x] for x in row.tolist() if x in known], np.int32) for row in lists], known, labels, categories, l2)


def train_known(lists: list[np.ndarray], known: dict[int, int], labels: np.ndarray, categories: list[str], l2: float = 0.2) -> Chain:
    """The same on rows of kept columns."""
    fold = np.arange(len(lists)) % FOLDS
    before, weights = np.empty((len(lists), 0)), []
    for c in range(len(categories)):
        rows, y, out = Rows(lists, len(known), before), labels[:, c].astype(float), np.zeros(len(lists))
        for k in range(FOLDS):
            w = fit_logistic(rows, y, l2, steps=30, use=fold != k)
            out[fold == k] = rows.dot(w)[fold == k]
        weights.append(fit_logistic(rows, y, l2))
        before = np.column_stack([before, logit(sigmoid(out))])
    return Chain(categories, known, weights, best_threshold(sigmoid(out), y))


def fit_chain(labelled: DataFrame, categories: list[str], text_col: str = "text", id_col: str = "doc_id") -> Chain:
    """Fit on all given rows - a bounded sample - but those with a null label.

    Features are computed and their document frequencies counted where the rows are;
    only lists of the FEATURES most frequent columns come to the driver.
    """
    rows = labelled.dropna(subset=categories).select(F.xxhash64(F.col(id_col)).alias("_h"), text_bytes(text_col).alias("_text"), *(F.col(c).cast("int") for c in categories))

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(_f=feature_lists(pdf.pop("_text"), None, {}))

    kinds = "_h long, " + "".join(f"`{c}` int, " for c in categories) + "_f array<int>"
    some = stage(rows.mapInPandas(lists, kinds).repartition(8), "chain-sample")
    often = some.select(F.explode("_f").alias("f")).groupBy("f").count().where("count > 2").orderBy(F.desc("count"), "f").limit(FEATURES)
    known = {r["f"]: i for i, r in enumerate(often.collect())}
    sent = labelled.sparkSession.sparkContext.broadcast(known)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(_f=[np.array(sorted(sent.value[x] for x in row.tolist() if x in sent.value), np.int32) for row in pdf["_f"]])

    got = some.mapInPandas(keep, kinds).toPandas().sort_values("_h", kind="stable")
    labels = got[categories].to_numpy() if len(got) else np.zeros((0, len(categories)))
    return train_known([np.asarray(x, np.int32) for x in got.pop("_f")], known, labels, categories)


def text_bytes(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit("")).cast("binary")


def score_chain(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """``docs`` plus a probability p_<category> (double) for each category, and ``flagged``.

    flagged: the last category's probability reaches ``threshold`` (None: the chain's own,
    of highest out-of-fold F1). A chain that saw no rows of both classes flags nothing.
    A null text is scored as an empty one; repeated rows score alike; columns of the same
    names are replaced, others stay; no rows: no rows.
    """
    names = [f"p_{c}" for c in chain.categories]
    (scores,) = working_names(docs, "_p")
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # bounded: FEATURES rows
    cache: dict[bytes, tuple[int, ...]] = {}

    @F.pandas_udf("struct<" + ",".join(f"`{n}`:double" for n in names) + ">")
    def probabilities(texts: pd.Series) -> pd.DataFrame:
        model = sent.value
        parts = [model.score(feature_lists(texts.iloc[a : a + TEXT_ROWS], model.known, cache)) for a in range(0, len(texts), TEXT_ROWS)]
        return pd.DataFrame(np.concatenate([np.empty((0, len(names))), *parts]), columns=names)

    least = chain.threshold if threshold is None or math.isinf(chain.threshold) else threshold
    out = docs.withColumn(scores, probabilities(text_bytes(text_col)))
    return out.withColumns({n: F.col(scores)[n] for n in names}).drop(scores).withColumn("flagged", F.col(names[-1]) >= F.lit(least))


def weak_categories(docs: DataFrame, seeds: dict[str, tuple[str, ...]], text_col: str = "text", toxic_col: str = "toxic") -> DataFrame:
    """Labels of the seed categories: toxic rows with a seed word of theirs."""
    has = lambda words: F.lower(F.coalesce(F.col(text_col), F.lit(""))).rlike(r"(?<![a-z])(" + "|".join(words) + ")(?![a-z])")
    return docs.withColumns({c: F.when(F.col(toxic_col).isNotNull(), ((F.col(toxic_col) == 1) & has(words)).cast("int")) for c, words in seeds.items()})


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float | None = None, sample: int = SAMPLE, id_col: str = "doc_id", categories: tuple[str, ...] = ("toxic",), seeds: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """A chain over all ``docs``, fitted on the labelled rows; the last category flags.

    ``labels`` has the id column and a 0/1 column for each of ``categories``, which form
    the chain in their order. ``seeds`` (default: SEEDS) names weak categories that go
    before them, labelled by words in toxic texts, for tables of one label; {}: none.
    Of several labels of an id the highest counts; ids with a null label are left out.
    The sampled ids are chosen from ``labels`` first, so that one narrow pass finds
    their texts. No labels, or labels of one class: nothing is flagged. Null, empty and
    very long texts, repeated rows, no rows and other columns: see score_chain.
    """
    seeds = SEEDS if seeds is None else seeds
    one = labels.dropna(subset=list(categories)).groupBy(id_col).agg(*(F.max(c).cast("int").alias(c) for c in categories))
    ids = one.orderBy(F.xxhash64(F.col(id_col)), id_col).limit(sample)
    some = docs.select(id_col, F.col("text")).join(F.broadcast(ids), id_col)  # at most ``sample`` rows
    chain = fit_chain(weak_categories(some, seeds, toxic_col=categories[-1]), [*seeds, *categories], id_col=id_col)
    return score_chain(docs, chain, threshold=threshold)
