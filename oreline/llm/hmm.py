"""Hidden Markov language model over words.

Frequent words are symbols of their own; any other word is a symbol of its spelling
class and, within the class, has add-one probability - the same in every state, so a
text's likelihood is the forward recursion over symbols times the words' shares of
their classes. Counts of words come from all training texts. Symbols and classes grow
with the square root of the vocabulary V: OWN and CLASSES times it. So the state-bound
part of the model grows with the corpus, and yet fits a task: at a billion distinct
words it has 760 thousand words of their own and 63 thousand classes, 53 MB.

Baum-Welch starts from seeded random states; in each pass expected counts are summed
over all training texts, partition by partition, until their likelihood gains little.
The forward recursion is scaled and runs over many texts at once, step by step.

Counts of the HEAD most frequent words (more, if more have symbols of their own) are
sent to the tasks; rarer words are joined with the table of counts, so no key of that
join is frequent in the training texts. HEAD moves work between the two ways only.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

HEAD = 150_000  # most frequent words whose counts the tasks hold
OWN, LEAST_OWN = 24, 20_000  # words that are symbols of their own: times the root of the vocabulary, and at least
CLASSES = 2  # spelling classes of all other words, times the root of the vocabulary
STATES = 8
PASSES = 14  # Baum-Welch passes at least, for the likelihood gains little before the states part
GAIN = 1e-3  # relative gain of log-likelihood below which passes end after these
PRIOR = 200.0  # weight of the corpus distribution in a state's emissions
END = b"\n"  # the end token: no word holds white space
EVERY = 16  # steps between scalings: their product of probabilities stays far above the least double
GROUP_TOKENS = 800_000  # tokens that are worked on at once, if a text is no longer
BLOCK_TOKENS = 8_192  # tokens of the steps that are worked on within a core's cache
FLUSH = 1_000_000  # counts that a task merges; if half of them are left, it passes them on
TEXTS = 4_000  # texts that are split at once
PART = 128  # symbols whose expected counts make one row


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """ASCII-lower-cased words of binary texts, split at ASCII white space only: each text's number of words, their places among the distinct ones, and these."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    coded = lists.flatten().dictionary_encode()
    words, sizes, places = coded.dictionary.view(pa.binary()), lists.value_lengths().to_numpy(), coded.indices.to_numpy()
    blank = pc.index(words, pa.scalar(b"", pa.binary())).as_py()
    if blank >= 0:  # beside white space at either end, and of blank texts
        real = places != blank
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
        places = places[real]
        places = places - (places > blank)
        words = words.filter(pa.array(np.arange(len(words)) != blank))
    return sizes.astype(np.int64), places, words


def class_of(word: bytes, classes: int) -> int:
    return zlib.crc32(word[:2] + b"|" + word[-2:]) % classes


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows of ``_text`` (binary), with the end token once a row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda words, c: pa.table({"word": words, "c": pa.array(c, pa.int64())})
        merged = lambda tables: pa.concat_tables(tables).group_by("word").aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])
        found, ends = [made(pa.array([], pa.binary()), [])], 0
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS):
                part = batch.column(0).slice(a, TEXTS)
                _, places, words = split_words(part)
                found.append(made(words, np.bincount(places, minlength=len(words))))
                ends += len(part)
                if sum(map(len, found)) > FLUSH:
                    found = [merged(found)]
                    if len(found[0]) > FLUSH // 2:
                        yield from found.pop().to_batches()
                        found = [made(pa.array([], pa.binary()), [])]
        yield from merged(found).to_batches()
        if ends:
            yield from made(pa.array([END], pa.binary()), [ends]).to_batches()

    return texts.mapInArrow(count, "word binary, c long").groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What tasks know of the words: place of each head word, and arrays by place and symbol."""

    n_tokens: int
    n_words: int
    place: dict[bytes, int]
    symbol: np.ndarray  # by place
    log_count: np.ndarray  # log10(c + 1) by place
    own: int  # symbols that are words; classes follow
    class_size: np.ndarray  # tokens + words + 1 of each class


def build_vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).collect()[0]
    rank = F.floor(16 * F.log2(F.col("c"))).cast("int")
    histogram = sorted(((r[0], r[1]) for r in counts.groupBy(rank).count().collect()), reverse=True)  # at most 16 * 63 rows
    root = math.sqrt(total[1])
    wanted, n_classes = max(LEAST_OWN, math.ceil(OWN * root)), math.ceil(CLASSES * root) + 16
    most = max(HEAD, wanted)
    least, taken = 10**6, 0
    for r, n in histogram:
        taken += n
        if taken > most:
            break
        least = r
    head = [(bytes(r[0], "utf-8"), r[1]) for r in counts.where((rank >= least) | (F.col("word") == END.decode())).collect()]  # at most HEAD or OWN rows and the end
    head.sort(key=lambda x: (-x[1], x[0]))
    own = min(wanted, len(head))
    mine = {w for w, _ in head[:own]}
    sent = counts.sparkSession.sparkContext.broadcast(mine)

    def classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, words = np.zeros(n_classes, np.int64), np.zeros(n_classes, np.int64)
        for pdf in batches:
            for w, c in zip(pdf["word"], pdf["c"], strict=True):
                w = w.encode()
                if w not in sent.value:
                    g = class_of(w, n_classes)
                    tokens[g] += c
                    words[g] += 1
        used = np.flatnonzero(tokens + words)
        yield pd.DataFrame({"g": used, "n": (tokens + words)[used]})

    size = np.ones(n_classes)
    for g, n in counts.mapInPandas(classes, "g int, n long").groupBy("g").agg(F.sum("n")).collect():
        size[g] += n
    symbol = np.array([i if i < own else own + class_of(w, n_classes) for i, (w, _) in enumerate(head)], np.int32)
    return Vocabulary(int(total[0]), int(total[1]), {w: i for i, (w, _) in enumerate(head)}, symbol, np.log10(np.array([c for _, c in head], float) + 1), own, size)


@dataclass
class Hmm:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # by symbol, then state
    background: np.ndarray = field(repr=False)  # corpus distribution of symbols

    @classmethod
    def random(cls, background: np.ndarray, states: int, seed: int = 11) -> Hmm:
        rng = np.random.Generator(np.random.PCG64(seed))
        emit = background[:, None] * rng.gamma(2.0, 1.0, (len(background), states))
        step = np.full((states, states), 0.05 / states) + np.eye(states) * 0.95
        return cls(np.full(states, 1 / states), step / step.sum(1, keepdims=True), emit / emit.sum(0), background)

    def refit(self, emit: np.ndarray, step: np.ndarray, start: np.ndarray) -> Hmm:
        """Maximisation from expected counts, smoothed by the corpus distribution."""
        e = emit + PRIOR * self.background[:, None]
        s = step + 0.1
        p = start + 0.1
        return Hmm(p / p.sum(), s / s.sum(1, keepdims=True), e / e.sum(0), self.background)


@dataclass
class Group:
    """Texts worked on at once, by falling length and step by step: step t holds the texts that are longer than t, in order.

    So no place is padded, and a step's rows are the first rows of the step before.
    """

    rows: np.ndarray  # places of the texts
    symbols: np.ndarray  # of all steps, one after the other
    starts: np.ndarray  # where each step begins, and the end
    last: np.ndarray  # the place of each text's last symbol

    def blocks(self) -> list[tuple[int, int]]:
        """Ranges of steps of some BLOCK_TOKENS symbols, or of one step."""
        cuts = [0]
        while cuts[-1] < len(self.starts) - 1:
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(self.starts, self.starts[cuts[-1]] + BLOCK_TOKENS, side="right")) - 1))
        return list(zip(cuts, cuts[1:], strict=False))


def groups(texts: list[np.ndarray]) -> Iterator[Group]:
    """Groups of GROUP_TOKENS symbols, or of one text."""
    lengths = np.array([len(x) for x in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    a = 0
    while a < len(order):
        total = np.cumsum(lengths[order[a:]])
        b = a + max(1, int(np.searchsorted(total, GROUP_TOKENS, side="right")))
        rows = order[a:b]
        size = lengths[rows]
        running = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
        starts = np.concatenate([[0], np.cumsum(running)])
        symbols = np.empty(starts[-1], np.int32)
        for j, i in enumerate(rows):
            symbols[starts[: len(texts[i])] + j] = texts[i]
        yield Group(rows, symbols, starts, starts[size - 1] + np.arange(len(rows)))
        a = b


def forward(model: Hmm, g: Group, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Scaled forward recursion: natural log-likelihood by text, what its scales have left of it, and the scales of every EVERY-th step.

    What is left is an alpha's sum over states at the text's last place. ``kept`` receives the alphas of all places.
    """
    likelihood, left, scales = np.zeros(len(g.rows)), np.empty(len(g.rows)), []
    starts, running, before, ones = g.starts.tolist(), [*np.diff(g.starts).tolist(), 0], None, np.ones(len(model.start))
    for first, end in g.blocks():
        base, limit = starts[first], starts[end]
        emitted = model.emit.take(g.symbols[base:limit], axis=0)
        alpha = np.empty_like(emitted) if kept is None else kept[base:limit]
        a = 0
        for t in range(first, end):
            b = starts[t + 1] - base
            now = alpha[a:b]
            if before is None:
                np.multiply(model.start, emitted[a:b], out=now)
            else:
                np.dot(before[: b - a], model.step, out=now)
                np.multiply(now, emitted[a:b], out=now)
            if t % EVERY == 0:
                c = now @ ones
                now /= c[:, None]
                likelihood[: b - a] += np.log(c)
                scales.append(c)
            before, a = now, b
        over = slice(running[end], running[first])
        left[over] = alpha[g.last[over] - base] @ ones  # of the texts that end in the block
    return likelihood + np.log(left), left, scales


class Expected:
    """Expected counts of a Baum-Welch pass.

    A group's alphas are kept; emissions and betas only for a block of steps, which stays in a core's cache.
    """

    def __init__(self, n_symbols: int, states: int):
        self.emit, self.step, self.start = np.zeros((n_symbols, states)), np.zeros((states, states)), np.zeros(states)
        self.likelihood = 0.0
        self.flat = self.emit.reshape(-1).view(float if states % 2 else complex)  # the same counts, added two states at a time if these are even
        self.places = np.arange(len(self.flat)).reshape(n_symbols, -1)
        self.room = np.empty((0, states))

    def add(self, model: Hmm, texts: list[np.ndarray]) -> None:
        states = len(model.start)
        back_step, moved = model.step.T.copy(), np.zeros((states, states))
        for g in groups(texts):
            if len(self.room) < len(g.symbols):
                self.room = np.empty((len(g.symbols), states))
            alpha = self.room[: len(g.symbols)]
            likelihood, left, scales = forward(model, g, alpha)
            self.likelihood += likelihood.sum()
            starts, running, after = g.starts.tolist(), [*np.diff(g.starts).tolist(), 0], None
            narrower = np.flatnonzero(np.diff(running))  # steps after which texts end
            for first, end in reversed(g.blocks()):
                base, limit = starts[first], starts[end]
                symbols, here = g.symbols[base:limit].astype(np.intp), alpha[base:limit]
                back, beta = model.emit.take(symbols, axis=0), np.empty((limit - base, states))  # back: emissions, and in the loop times beta
                over = slice(running[end], running[first])
                beta[g.last[over] - base] = 1 / left[over, None]
                b = limit - base
                if after is not None:
                    moved += here[starts[end - 1] - base :][: len(after)].T @ after
                for t in range(end - 1, first - 1, -1):
                    a = starts[t] - base
                    if after is not None:
                        np.dot(after, back_step, out=beta[a : a + len(after)])
                    after = back[a:b]
                    np.multiply(after, beta[a:b], out=after)
                    if t % EVERY == 0:
                        after /= scales[t // EVERY][:, None]
                    b = a
                a = first
                for t in [*narrower[np.searchsorted(narrower, first) : np.searchsorted(narrower, end - 1)].tolist(), end - 1]:
                    u, v, w = starts[a] - base, starts[t] - base, starts[t + 1] - base
                    if t > a:  # moves within steps of the same texts, at once
                        moved += here[u:v].T @ back[starts[a + 1] - base : w]
                    if t < end - 1:
                        moved += here[v : v + running[t + 1]].T @ back[w : w + running[t + 1]]
                    a = t + 1
                after = after.copy()
                beta *= here
                if first == 0:
                    self.start += beta[: running[0]].sum(0)
                np.add.at(self.flat, self.places.take(symbols, axis=0).ravel(), beta.reshape(-1).view(self.flat.dtype))
        self.step += model.step * moved


def encode(docs: DataFrame, vocabulary, held: Column, id_col: str, text_col: str) -> DataFrame:
    """A staged row for each text: symbols, sums over what the head covers, and the other words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        whole = np.log10(v.n_tokens + v.n_words + 1.0)
        class_log = np.log10(v.class_size)
        share = np.where(np.arange(len(v.symbol)) < v.own, 0.0, v.log_count - class_log[np.maximum(0, v.symbol - v.own)]) if len(v.symbol) else np.zeros(0)
        head_base, head_share, head_symbol = np.append(v.log_count, 0.0) - whole, np.append(share, 0.0), np.append(v.symbol, 0)  # the last is of words outside
        head = pa.array(list(v.place), pa.binary())
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS):
                part = batch.slice(a, TEXTS)
                sizes, places, words = split_words(part.column(2))
                n, end = len(sizes), len(words)
                at = np.append(pc.index_in(words, value_set=head).fill_null(-1).to_numpy().astype(np.int64), v.place.get(END, -1))
                base, lost, symbol = head_base[at], head_share[at], head_symbol[at]
                outside = np.flatnonzero(at < 0)
                g = np.array([class_of(w, len(class_log)) for w in [*words.filter(pa.array(at[:end] < 0)).to_numpy(zero_copy_only=False), END][: len(outside)]], np.int64)
                lost[outside], symbol[outside] = -class_log[g], v.own + g
                cuts = np.concatenate([[0], np.cumsum(sizes + 1)])
                tokens = np.full(cuts[-1], end)
                tokens[np.arange(len(places)) + np.repeat(np.arange(n), sizes)] = places
                known = at[tokens] >= 0
                rare = np.flatnonzero(~known & (tokens != end))
                listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, cuts), pa.int32()), words.take(pa.array(tokens[rare])).view(pa.string()))
                total = lambda of, cuts=cuts: pa.array(np.add.reduceat(of, cuts[:-1]))
                coded = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((cuts * 4).astype("<i4")), pa.py_buffer(symbol[tokens].astype("<i4"))])
                columns = [pa.array(np.arange(number, number + n)), part.column(0), part.column(1), pa.array(sizes + 1), total(known.astype(np.int64)), total(base[tokens]), total(lost[tokens]), coded, pc.binary_join(listed, " ")]
                number += n
                yield pa.RecordBatch.from_arrays(columns, ["row", "id", "held", "n_tokens", "n_head", "base", "share", "symbols", "rare"])

    slim = docs.select(F.col(id_col).cast("string").alias("_id"), held.alias("_held"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    return stage(slim.mapInArrow(work, "row long, id string, held boolean, n_tokens long, n_head long, base double, share double, symbols binary, rare string"), "lm-encoded")


def as_symbols(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(bytes(x), "<i4") for x in column]


def baum_welch(encoded: DataFrame, model: Hmm, passes: int, figures: dict | None = None) -> Hmm:
    """``passes`` or more over all rows of ``encoded``, until one gains little: counts per partition, summed by PART symbols."""
    spark, states = encoded.sparkSession, len(model.start)
    tasks = max(2 * spark.sparkContext.defaultParallelism, encoded.rdd.getNumPartitions() // 3)  # each sends counts of all its symbols
    symbols = encoded.select("symbols").coalesce(tasks)
    done, last, now = 0, -np.inf, -np.inf
    while done < passes or now - last > GAIN * abs(last):
        sent = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            m = sent.value
            total = Expected(len(m.emit), states)
            for pdf in batches:  # all of a batch at once: the longest texts set the number of steps
                total.add(m, as_symbols(pdf["symbols"]))
            rows = np.vstack([total.emit, total.step, total.start[None], np.full((1, states), total.likelihood)])
            parts = [(i // PART, rows[i : i + PART]) for i in range(0, len(rows), PART)]
            yield pd.DataFrame([(i, x.tobytes()) for i, x in parts if x.any()], columns=["part", "counts"])

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[int, np.ndarray] = {}
            for pdf in batches:
                for i, x in zip(pdf["part"], pdf["counts"], strict=True):
                    if i in total:
                        total[i] += np.frombuffer(x)
                    else:
                        total[i] = np.frombuffer(x).copy()
            yield pd.DataFrame([(i, x.tobytes()) for i, x in total.items()], columns=["part", "counts"])

        kind = "part int, counts binary"
        summed = symbols.mapInPandas(expect, kind).repartition("part").mapInPandas(add, kind)
        total = np.zeros((len(model.emit) + states + 2, states))
        for i, x in summed.collect():  # all parts together: symbols + states + 2 rows of counts
            total[i * PART : (i + 1) * PART] = np.frombuffer(x).reshape(-1, states)
        k = len(model.emit)
        model = model.refit(total[:k], total[k : k + states], total[k + states])
        done, last, now = done + 1, now, total[k + states + 1, 0]
        sent.unpersist()
        if figures is not None:
            figures.setdefault("likelihoods", []).append(now)
    return model


def hmm_scores(docs: DataFrame, held: Column, text_col: str = "text", id_col: str = "doc_id", states: int = STATES, passes: int = PASSES, figures: dict | None = None) -> DataFrame:
    """Train on the rows where ``held`` is false and score all rows.

    Returns the id column, held_out, n_tokens (words and the end), n_known (tokens
    seen in training), train_tokens, base_score (add-one unigrams) and score (the
    model's log10 probability of the text). A null text is empty: its only token is
    the end. A null ``held`` counts as false. Repeated rows score alike. Nothing to
    train on: every token is unknown. Null ids are ids like others. Other columns are
    not carried; no rows: no rows. ``figures`` receives the model, the vocabulary and
    the log-likelihood of the training texts before each pass.
    """
    spark = docs.sparkSession
    held = F.coalesce(held, F.lit(False))
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    counts = stage(count_words(docs.where(~held).select(text.alias("_text"))), "lm-counts")
    v = build_vocabulary(counts)
    sent = spark.sparkContext.broadcast(v)
    encoded = encode(docs, sent, held, id_col, text_col)
    training = encoded.where(~F.col("held"))

    background = np.concatenate([10 ** v.log_count[: v.own] - 1, v.class_size]) + 1
    model = baum_welch(training, Hmm.random(background / background.sum(), states), passes, figures)
    if figures is not None:
        figures.update(model=model, vocabulary=v)
    final = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            value = np.zeros(len(pdf))
            for g in groups(as_symbols(pdf["symbols"])):
                value[g.rows] = forward(final.value, g)[0] / np.log(10)
            yield pdf.drop(columns=["symbols"]).assign(share=pdf["share"] + value)

    names = ["row", "id", "held", "n_tokens", "n_head", "base", "share"]
    scored = encoded.select(*names, "symbols").mapInPandas(score, "row long, id string, held boolean, n_tokens long, n_head long, base double, share double")
    rare = encoded.where("rare <> ''").select("row", F.explode(F.split("rare", " ")).alias("word"))
    rare = rare.join(counts.hint("shuffle_hash"), "word", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))).alias("more"), F.count("c").alias("n_rare"))
    out = scored.join(rare.hint("shuffle_hash"), "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(v.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("share") + more).alias("score"),
    )
