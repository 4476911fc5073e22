"""Source divergence audit by a two-pass vocabulary automaton.

Pass 1 counts in how many documents of a language each term occurs, exactly; terms of
at least ``min_docs`` documents are kept. Pass 2 reads the texts again with an
Aho-Corasick automaton over the kept terms, each padded with a delimiter on either side
so that only whole terms match, and counts their occurrences by source. Both passes add
up within a task before anything is shuffled. The counts are sparse postings (language,
term, source); from them come the distances between all sources of a language and the
terms that each source has more of than its language.

The kept terms grow with the corpus, so they are dealt into blocks of bounded size, each
with an automaton of its own and a pass over the texts. Distances are added up in blocks
of sources and chunks of terms: a term that a block of sources lacks adds the same
constant to all its pairs, so only postings are read.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup_join, quoted, stage

MIN_DOCS = 30
TOP = 50  # ranks of a source's terms
SCALE, SMOOTHING = 1_000_000_000, 5
LONG = 64  # bytes of a term from which on its digest stands for it in the automaton
BLOCK_TERMS, BLOCK_BYTES = 200_000, 2_000_000  # of an automaton, on average
FLUSH, HITS = 400_000, 8_000_000  # different terms, and occurrences, that a task holds before it passes their counts on
SOURCES, TERMS = 128, 4096  # of a block of the distance matrix, on average

#: Letters a-z for A-Z, blanks for all other ASCII; other bytes stay.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
TOO_LONG = re.compile(rb"[^ ]{%d,}" % (LONG + 1))
AUTOMATA: dict = {}  # of the last block that this worker has read


def digest(term: bytes) -> bytes:
    """Stands for a long term; terms never hold the first character."""
    return b"\x01" + hashlib.sha256(term).hexdigest().encode()


def key_of(term: Column) -> Column:
    """The term, or the digest of a long one."""
    return F.when(F.octet_length(term) > LONG, F.concat(F.lit("\x01"), F.sha2(term.cast("binary"), 256))).otherwise(term)


def count_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pass 1: (lang, term, n), the documents of the task by term."""
    held: dict[str, Counter] = defaultdict(Counter)

    def taken() -> pd.DataFrame:
        rows = [(lang, t.decode(), n) for lang, c in held.items() for t, n in c.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["lang", "term", "n"], dtype=object)

    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            held[lang].update(set(text.encode().translate(FOLD).split()))
        if sum(map(len, held.values())) > FLUSH:
            yield taken()
    yield taken()


def automata(name: str, rows: list[tuple[int, str, str]]) -> tuple[dict, np.ndarray]:
    """By language: the automaton over its padded terms; and the terms' numbers. Built once a worker."""
    import ahocorasick

    if name not in AUTOMATA:
        AUTOMATA.clear()
        made: dict = {}
        for i, (_, lang, key) in enumerate(rows):
            if lang not in made:
                made[lang] = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            made[lang].add_word(f" {key} ", i)
        for a in made.values():
            a.make_automaton()
        AUTOMATA[name] = made, np.array([k for k, _, _ in rows], np.int64)
    return AUTOMATA[name]


def padded(text: str) -> str:
    """The text as the automaton reads it: terms with blanks around them."""
    raw = text.encode().translate(FOLD)
    if TOO_LONG.search(raw):
        raw = TOO_LONG.sub(lambda m: digest(m[0]), raw)
    return f" {raw.decode()} "


def recount(docs: DataFrame, terms: list[tuple[int, str, str]]) -> DataFrame:
    """Pass 2 for one block of kept terms (number, language, key): (source, k, n), occurrences by number."""
    sent, name = docs.sparkSession.sparkContext.broadcast(terms), uuid.uuid4().hex

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machines, numbers = automata(name, sent.value)
        held: dict[tuple[str, str], array] = defaultdict(lambda: array("i"))

        def taken() -> pd.DataFrame:
            counted = [(source, *np.unique(np.frombuffer(hits, np.int32), return_counts=True)) for (_, source), hits in held.items() if hits]
            held.clear()
            names = np.repeat(np.array([s for s, *_ in counted], object), [len(at) for _, at, _ in counted])
            every = lambda i: np.concatenate([x[i] for x in counted] or [np.empty(0, np.int64)])
            return pd.DataFrame({"source": pd.Series(names, dtype=object), "k": numbers[every(1)], "n": every(2)})

        for pdf in batches:
            for lang, source, text in zip(pdf["lang"], pdf["source"], pdf["text"], strict=True):
                if lang in machines:
                    held[lang, source].extend(map(itemgetter(1), machines[lang].iter(padded(text))))
            if sum(map(len, held.values())) > HITS:
                yield taken()
        yield taken()

    return docs.mapInPandas(work, "source string, k long, n long").groupBy("source", "k").agg(F.sum("n").alias("n"))


def share(count: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (N + SMOOTHING * V)) in exact arithmetic; null without kept terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    above, below = F.lit(SCALE).cast("decimal(10,0)") * wide(count + SMOOTHING), wide(F.col("_total") + SMOOTHING * F.col("_v"))
    return 1 + F.call_function("div", above, F.nullif(below, F.lit(0).cast("decimal(19,0)")))


def distances(postings: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """What the postings of one chunk of terms add to the distances of two blocks of sources.

    ``postings``: source, k, p; ``sources``: source, side (first or second block, or both), z.
    The sum over the terms of |p - q| - |z - z'|.
    """
    out = []
    if len(postings) and len(sources):
        term = postings["k"].factorize()[0]
        n = int(term.max()) + 1

        def side(letter: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            own = sources[sources["side"].isin([letter, "both"])].sort_values("source")
            place = {s: i for i, s in enumerate(own["source"])}
            p = np.tile(own["z"].to_numpy(np.int64), (n, 1))
            at = postings["source"].map(place).to_numpy(dtype=float, na_value=np.nan)
            use = ~np.isnan(at)
            p[term[use], at[use].astype(int)] = postings["p"].to_numpy(np.int64)[use]
            return own["source"].to_numpy(), own["z"].to_numpy(np.int64), p

        names, z, p = side("first")
        others, zo, po = side("second")
        for i, name in enumerate(names):
            value = np.abs(p[:, [i]] - po).sum(0) - n * np.abs(z[i] - zo)
            out.append(pd.DataFrame({"source": name, "item": others, "value": value}))
    found = pd.concat(out) if out else pd.DataFrame({"source": [], "item": [], "value": []})
    found = found[found["source"] != found["item"]]
    if len(sources) and not (sources["side"] == "both").any():
        found = pd.concat([found, found.rename(columns={"source": "item", "item": "source"})])
    return found.assign(lang=sources["lang"].iloc[0] if len(sources) else "")[["lang", "source", "item", "value"]].astype({"lang": object, "source": object, "item": object, "value": "int64"})


def source_distances(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed |p - q| over all kept terms for each two sources of a language.

    ``postings``: lang, source, k, p; ``groups``: lang, source, _v (kept terms of the language), z (share of a term that it lacks).
    """
    sizes = groups.groupBy("lang").agg(F.count("*").alias("_s"), F.max("_v").alias("_terms"))
    n_langs = sizes.count()
    sizes = sizes.select("lang", F.ceil(F.col("_s") / SOURCES).cast("int").alias("_blocks"), F.greatest(F.lit(1), F.ceil(F.col("_terms") / TERMS)).cast("int").alias("_chunks"))
    block = F.pmod(F.xxhash64("source"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_o")
    pair = lambda df: df.withColumns({"_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o")})
    keys = ["lang", "_i", "_j", "_chunk"]
    read = lookup_join(postings, sizes, ["lang"], n_langs, "inner").withColumn("_b", block)
    read = pair(read.select("*", other)).withColumn("_chunk", F.pmod(F.xxhash64("k"), F.col("_chunks")).cast("int")).select(*keys, "source", "k", "p")
    place = F.when(F.col("_i") == F.col("_j"), "both").when(F.col("_b") == F.col("_i"), "first").otherwise("second")
    told = pair(lookup_join(groups, sizes, ["lang"], n_langs, "inner").withColumn("_b", block).select("*", other)).withColumn("side", place)
    told = told.select("*", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk")).select(*keys, "source", "side", "z")
    found = read.groupBy(*keys).cogroup(told.groupBy(*keys)).applyInPandas(distances, "lang string, source string, item string, value long")
    found = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("_more"))
    pairs = groups.select("lang", "source", "_v", "z").join(groups.select("lang", F.col("source").alias("item"), F.col("z").alias("_z")), "lang").where("source <> item")
    both = pairs.join(found, ["lang", "source", "item"], "left")
    return both.select("lang", "source", "item", (F.coalesce(F.col("_v") * F.abs(F.col("z") - F.col("_z")), F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("value"))


def audit_sources(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources of the language and over-used terms.

    Terms are runs of A-Z, a-z and characters beyond ASCII, with only A-Z in lower case;
    those in at least ``min_docs`` documents of a language are kept there (V terms). A
    group's or a language's share of a term is 1 + floor(10^9 * (count + 5) / (N + 5 V)).
    Part ``pair``: every other source with the sum of |p - q| over all kept terms, all
    ranks; part ``term``: terms of the group with a share above the language's, with the
    difference, up to rank ``top``. Ranks go by value, greatest first, then item in UTF-8 order.

    Null texts, languages and sources count as ''; texts of any length are read whole.
    Every (lang, source) that occurs is a group, even without terms; a language with one
    source has no pairs, one without kept terms has distances of 0 and no terms. Repeated
    rows each count. Other columns are not read, whatever their names; no rows: no rows.
    The staged counts are kept in the shared folder, as the lazy result reads them.
    """
    name = lambda c, to: F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")).alias(to)
    texts = docs.select(name(lang_col, "lang"), name(source_col, "source"), name(text_col, "text"))
    found = texts.select("lang", "text").mapInPandas(count_documents, "lang string, term string, n long")
    kept = found.groupBy("lang", "term").agg(F.sum("n").alias("_docs")).where(F.col("_docs") >= min_docs)
    kept = stage(kept.select(F.monotonically_increasing_id().alias("k"), "lang", "term"), "audit-terms")
    n, size = kept.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(key_of(F.col("term"))) + F.octet_length("lang")), F.lit(0))).collect()[0]
    blocks = max(1, math.ceil(n / BLOCK_TERMS), math.ceil(size / BLOCK_BYTES))
    counts = []
    for b in range(blocks):
        of = kept.where(F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)) == b).select("k", "lang", key_of(F.col("term")))
        terms = [tuple(r) for r in of.collect()]  # BLOCK_TERMS terms of at most LONG bytes, on average
        if terms:
            counts.append(stage(recount(texts, terms), "audit-counts"))
    spark = docs.sparkSession
    counted = reduce(DataFrame.unionByName, counts) if counts else spark.createDataFrame([], "source string, k long, n long")
    counted = lookup_join(counted, kept.select("k", "lang"), ["k"], n, "inner")

    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("_v"))
    totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("_total"))
    groups = texts.select("lang", "source").distinct().join(vocabulary, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["_v", "_total"])
    groups = stage(groups.withColumn("z", share(F.lit(0))), "audit-groups")
    langs = groups.groupBy("lang").agg(F.max("_v").alias("_v"), F.sum("_total").alias("_total"))
    n_groups = groups.count()
    postings = lookup_join(counted, groups, ["lang", "source"], n_groups, "inner").select("lang", "source", "k", share(F.col("n")).alias("p"))

    of_lang = lookup_join(counted.groupBy("lang", "k").agg(F.sum("n").alias("_n")), langs, ["lang"], n_groups, "inner")
    of_lang = stage(of_lang.select("k", share(F.col("_n")).alias("q")), "audit-shares")
    over = lookup_join(postings, of_lang, ["k"], n, "inner").where("p > q").join(kept.select("k", "term"), "k")
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    pairs = source_distances(postings, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).unionByName(over.select("*", rank).where(F.col("rank") <= top))
