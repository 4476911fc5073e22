"""Entity matching: exact and fuzzy candidate joins and greedy one-to-one assignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lineage import cut
from .similar import similar_sets


BLOCK, MOST_BLOCK = 4096, 500_000  # rows of wanted keys that one task walks through, on average, at least and at most
BLOCKS = 32  # wished for between these, for rounds are as many as blocks at worst
SLICE = 1024  # documents of a key that are fetched together


def ranked(offered: DataFrame, doc: str) -> DataFrame:
    """(key, doc, rank from 0 within the key), without one task for a hot key: ranks of parts plus the parts' offsets."""
    spark = offered.sparkSession
    parts = cut(offered.select("key", doc).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", doc).withColumn("_part", F.spark_partition_id()))
    earlier = F.sum("_n").over(Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.groupBy("key", "_part").agg(F.count("*").alias("_n")).select("key", "_part", F.coalesce(earlier, F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("key", "_part").orderBy(doc)) - 1
    return parts.withColumn("_own", own).join(offsets.hint("merge"), ["key", "_part"]).select("key", doc, (F.col("_own") + F.col("_offset")).alias("rank"))


def walk_block(sources: pd.DataFrame, documents: pd.DataFrame, src: str, doc: str) -> pd.DataFrame:
    """The walk over one block's sources, on the documents that its counters leave."""
    free = {k: rows[::-1] for k, rows in documents.sort_values("rank").groupby("key", sort=False)[doc].agg(list).items()}
    out = []
    ordered = sources.sort_values(src, kind="stable")
    live = None
    for s, key, prefer in zip(ordered[src], ordered["key"], ordered["prefer"], strict=True):
        if live is not None and s != live[0]:
            if live[1]:
                out.append((live[0], free[live[1][2]].pop(), live[1][2]))
            live = None
        best = live[1] if live else None
        if free.get(key) and (best is None or prefer > best[0] or (prefer == best[0] and free[key][-1] < best[1])):
            best = prefer, free[key][-1], key
        live = s, best
    if live and live[1]:
        out.append((live[0], free[live[1][2]].pop(), live[1][2]))
    return pd.DataFrame(out, columns=[src, doc, "key"])


def assign_keys(wanted: DataFrame, offered: DataFrame, src: str = "src", doc: str = "doc", figures: dict | None = None) -> DataFrame:
    """One-to-one matches as of a walk over sources in order: each takes the free document it prefers most.

    ``wanted`` has src, key and prefer (higher first; at most one row a source and key),
    ``offered`` doc and key (one row a document). Of equally preferred documents the
    smallest is taken. Null keys match nothing. Returns src, doc, key.

    A key's documents are always taken in order, so all that a source needs to know of
    those before it is how many documents of each of its keys are gone. Sources are cut
    into blocks in order. Each block is walked in a task of its own from a guess of these
    counters: at first what the blocks before would take if each source got its best
    key, then what they did take. Only blocks whose counters turned out otherwise are
    walked again. When none is left, every block was walked from true counters (by
    induction from the first), so the result is the walk's. A round settles at least one
    more block, and as many as the misguesses do not reach. A task holds a block's rows
    and as many documents. ``figures`` receives the number of blocks and, for each
    round, how many of them were walked.
    """
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"`{src}` {kind(wanted, src)}, `{doc}` {kind(offered, doc)}, key {kind(wanted, 'key')}, _block int"
    documents = cut(ranked(offered.where("key is not null"), doc))
    keys = documents.select("key").distinct()
    asked = wanted.select(src, "key", "prefer").join(keys.hint("merge"), "key", "left_semi")
    n = asked.count()
    blocks = max(1, -(-n // min(MOST_BLOCK, max(BLOCK, -(-n // BLOCKS)))))
    asked = cut(asked.repartitionByRange(blocks, src).withColumn("_block", F.spark_partition_id()))
    room = cut(asked.groupBy("_block", "key").agg(F.count("*").alias("_room")))
    first = asked.groupBy("_block", src).agg(F.max_by("key", "prefer").alias("key"))
    before = F.sum("_n").over(Window.partitionBy("key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))

    def counters(taken: DataFrame) -> DataFrame:
        """(_block, key, _room, _gone): how many documents of a key the blocks before took."""
        counts = room.join(taken.groupBy("_block", "key").agg(F.count("*").alias("_n")).hint("merge"), ["_block", "key"], "left")
        return cut(counts.select("_block", "key", "_room", F.coalesce(before, F.lit(0)).alias("_gone")))

    guess, found, rounds = counters(first), None, 0
    while rounds < blocks:  # after as many rounds as there are blocks, all of them are settled
        rounds += 1
        now = guess if found is None else counters(found)
        stale = now if found is None else now.join(guess.select("_block", "key", F.col("_gone").alias("_was")).hint("merge"), ["_block", "key"]).where("_gone <> _was")
        stale = cut(stale.select("_block").distinct())
        walked = blocks if found is None else stale.count()
        if figures is not None:
            figures["blocks"] = blocks
            figures.setdefault("walked", []).append(walked)
        if not walked or not n:
            break
        need = now.join(F.broadcast(stale), "_block", "left_semi")  # a row a block at most
        spans = need.select("_block", "key", "_room", "_gone", F.explode(F.sequence(F.floor(F.col("_gone") / SLICE), F.floor((F.col("_gone") + F.col("_room") - 1) / SLICE))).alias("_slice"))
        rows = spans.hint("merge").join(documents.withColumn("_slice", F.floor(F.col("rank") / SLICE)), ["key", "_slice"]).where("rank >= _gone and rank < _gone + _room").select(F.col("_block").alias("_of"), F.col("key").alias("key"), doc, "rank")

        def steps(block: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return walk_block(a, b, src, doc).assign(_block=block[0])

        again = asked.join(F.broadcast(stale), "_block", "left_semi").groupBy("_block").cogroup(rows.groupBy("_of")).applyInPandas(steps, schema)
        found = cut(again if found is None else again.unionByName(found.join(F.broadcast(stale), "_block", "left_anti")))
        guess = now
    if found is None:
        return wanted.select(src, "key").join(offered.select(doc, "key"), "key").limit(0).select(src, doc, "key")
    return found.select(src, doc, "key")


def greedy_assign(candidates: DataFrame, src: str = "src", doc: str = "doc", score: str = "score") -> DataFrame:
    """The same walk where each document is a key of its own and the score decides; ``candidates`` has one row a pair."""
    wanted = candidates.select(src, F.col(doc).alias("key"), F.col(score).alias("prefer"))
    found = assign_keys(wanted, candidates.select(doc).distinct().withColumn("key", F.col(doc)), src, doc)
    return found.select(src, doc).join(candidates, [src, doc]).select(src, doc, score)


def pair_by_rank(left: DataFrame, right: DataFrame, score: float, key: str = "key", src: str = "src", doc: str = "doc") -> DataFrame:
    """Greedy one-to-one matches by a single key: its k-th source takes its k-th document."""
    rank = lambda df, i: df.select(i, key, F.row_number().over(Window.partitionBy(key).orderBy(i)).alias("_k"))
    return rank(left, src).join(rank(right, doc), [key, "_k"]).select(src, doc, F.lit(score).alias("score"))


def token_key(tokens: Column) -> Column:
    """Name of a token set."""
    return F.array_join(F.array_sort(F.array_distinct(tokens)), "\u0001")


def token_pairs(left: DataFrame, right: DataFrame, threshold: float, tokens: str = "tokens", left_id: str = "src", right_id: str = "doc") -> DataFrame:
    """All pairs whose token sets have Jaccard similarity of ``threshold`` or more: (left_id, right_id, score). Empty sets match nothing."""
    side = lambda df, c: df.select(c, F.array_distinct(tokens).alias("tokens"))
    return similar_sets(side(left, left_id), side(right, right_id), threshold).select(left_id, right_id, "score")


def still_free(df: DataFrame, found: DataFrame | None, column: str) -> DataFrame:
    return df if found is None else df.join(found.select(column).hint("merge"), column, "left_anti")


def staged_matches(stages: list[tuple[str, DataFrame, DataFrame]], src: str = "src", doc: str = "doc") -> DataFrame:
    """Assignment stage by stage, each on what the stages before left free: src, doc, score, method.

    A stage is (method, wanted, offered): wanted has src, key, prefer and score, offered doc and key.
    """
    found = None
    for method, wanted, offered in stages:
        wanted = cut(still_free(wanted, found, src))
        got = assign_keys(wanted, still_free(offered, found, doc), src, doc)
        got = got.join(wanted.select(src, "key", "score").hint("merge"), [src, "key"]).select(src, doc, "score", F.lit(method).alias("method"))
        found = cut(got if found is None else found.unionByName(got))
    return found


def in_order(keys: Column) -> Column:
    """(key, position) of distinct non-empty keys, in order."""
    return F.posexplode(F.array_distinct(F.filter(keys, lambda k: F.coalesce(k, F.lit("")) != ""))).alias("position", "key")


def similar_keys(variants: DataFrame, offered: DataFrame, threshold: float) -> DataFrame:
    """(src, key, prefer, score): the token sets among ``offered`` (key: see token_key) similar to a variant (src, tokens), best score first.

    Equal token sets on either side are compared once.
    """
    a = variants.select("src", token_key(F.col("tokens")).alias("mine")).where("mine <> ''").distinct()
    left = a.select(F.col("mine").alias("src")).distinct().withColumn("tokens", F.split("src", "\u0001"))
    right = offered.select(F.col("key").alias("doc")).where("doc <> ''").distinct().withColumn("tokens", F.split("doc", "\u0001"))
    pairs = token_pairs(left, right, threshold).select(F.col("src").alias("mine"), F.col("doc").alias("key"), "score")
    return a.hint("merge").join(pairs, "mine").groupBy("src", "key").agg(F.max("score").alias("score")).withColumn("prefer", F.col("score"))


def match_endpoints(sources: DataFrame, docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Match endpoints by path: equal normalised paths (1.0, other spellings 0.9), equal resources (0.85), similar words.

    ``sources`` has src, path, method (name) and alternatives (array); ``docs`` has doc and path. Where
    alternatives are null, path/method is the other spelling. All spellings count for
    resources and words. Sources go in order of src; of equal documents the smallest is taken.
    """
    other = F.coalesce(F.col("alternatives"), F.array(F.concat(F.col("path"), F.lit("/"), F.col("method"))))
    spellings = F.concat(F.array("path"), F.coalesce(F.col("alternatives"), F.array().cast("array<string>")))
    exact = sources.select("src", in_order(F.transform(F.concat(F.array("path"), other), T.normalize_path)))
    exact = exact.select("src", "key", (-F.col("position")).cast("double").alias("prefer"), F.when(F.col("position") == 0, 1.0).otherwise(0.9).alias("score"))
    resource = sources.select("src", in_order(F.transform(spellings, lambda p: T.resource_path(p)))).select("src", "key", F.lit(0.0).alias("prefer"), F.lit(0.85).alias("score"))
    words = sources.select("src", F.explode(spellings).alias("p")).select("src", T.path_tokens(F.col("p")).alias("tokens"))
    told = docs.select("doc", token_key(T.path_tokens(F.col("path"))).alias("key"))
    return staged_matches([
        ("exact", exact, docs.select("doc", T.normalize_path(F.col("path")).alias("key"))),
        ("resource", resource, docs.select("doc", T.resource_path(F.col("path")).alias("key"))),
        ("fuzzy", similar_keys(words, told, threshold), told),
    ])


def match_tables(sources: DataFrame, docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Match tables by name: equal (1.0), within two edits (0.8), similar words. Columns src/doc and name."""
    left = sources.select("src", T.normalize_table(F.col("name")).alias("key"))
    right = docs.select("doc", T.normalize_table(F.col("name")).alias("key"))
    a, b = left.select(F.col("key").alias("a")).distinct().withColumn("src", F.col("a")), right.select(F.col("key").alias("b")).distinct().withColumn("doc", F.col("b"))
    near = edit_pairs(a, b).select("src", "doc", F.lit(0.8).alias("score"))
    words = lambda df, i, c: df.select(i, F.filter(F.split(c, "_"), lambda w: w != "").alias("tokens"))
    alike = token_pairs(words(a, "src", "a"), words(b, "doc", "b"), threshold)
    # Two edits decide before words do: a pair of both scores 0.8.
    fuzzy = near.withColumn("_near", F.lit(1)).unionByName(alike.withColumn("_near", F.lit(0))).groupBy("src", "doc").agg(F.max_by("score", "_near").alias("score"))
    fuzzy = left.join(fuzzy.select(F.col("src").alias("key"), F.col("doc").alias("_k"), "score").hint("merge"), "key").select("src", F.col("_k").alias("key"), F.col("score").alias("prefer"), "score")
    same = left.select("src", "key", F.lit(0.0).alias("prefer"), F.lit(1.0).alias("score"))
    return staged_matches([("exact", same, right), ("fuzzy", fuzzy, right)])


def edit_pairs(left: DataFrame, right: DataFrame, edits: int = 2) -> DataFrame:
    """Pairs of different strings within ``edits`` edits (src, a, doc, b), found by shared parts.

    Of ``edits`` + 1 parts of a, one is whole in b, shifted by at most ``edits``.
    Strings shorter than that many characters are paired by length alone.
    """
    parts = edits + 1
    n = F.length("a")
    start = lambda i: F.floor(n * i / parts).cast("int")
    pieces = F.array(*(F.struct(F.lit(i).alias("i"), F.substr(F.col("a"), start(i) + 1, start(i + 1) - start(i)).alias("p"), start(i).alias("at"), n.alias("n")) for i in range(parts)))
    x = left.where(n >= parts).select("src", "a", F.explode(pieces).alias("x")).select("src", "a", "x.*")
    m = F.length("b")
    lengths = F.explode(F.sequence(F.greatest(F.lit(parts), m - edits), m + edits)).alias("n")
    y = right.where(m > 0).select("doc", "b", lengths)
    size = lambda i: (F.floor(F.col("n") * (i + 1) / parts) - F.floor(F.col("n") * i / parts)).cast("int")
    at = lambda i: F.floor(F.col("n") * i / parts).cast("int")
    part = lambda i: lambda s: F.struct(F.lit(i).alias("i"), F.substr(F.col("b"), s + 1, size(i)).alias("p"))
    spots = F.flatten(F.array(*(F.transform(F.sequence(F.greatest(F.lit(0), at(i) - edits), at(i) + edits), part(i)) for i in range(parts))))
    y = y.select("doc", "b", "n", F.explode(F.array_distinct(spots)).alias("y")).select("doc", "b", "n", "y.*")
    long = x.hint("merge").join(y, ["i", "p", "n"]).select("src", "a", "doc", "b").distinct()
    near = right.where(m <= parts - 1 + edits).select("doc", "b", F.explode(F.sequence(F.greatest(F.lit(0), m - edits), m + edits)).alias("n"))
    short = left.where(n < parts).withColumn("n", n).join(near.hint("merge"), "n").select("src", "a", "doc", "b")
    return long.unionByName(short).where((F.col("a") != F.col("b")) & (F.levenshtein("a", "b") <= edits))


def match_columns(pairs: DataFrame, source_columns: DataFrame, doc_columns: DataFrame) -> DataFrame:
    """First document column of the same name for each column of matched tables: src, doc, column, doc_column."""
    s = source_columns.select("src", F.col("column"), F.explode(F.array_distinct(F.array(F.lower("column"), T.camel_to_snake(F.col("column"))))).alias("k"), F.lower("column").alias("low"))
    t = doc_columns.select("doc", F.col("column").alias("doc_column"), "position", F.explode(F.array_distinct(F.array(F.lower("column"), T.camel_to_snake(F.col("column"))))).alias("k"))
    j = pairs.select("src", "doc").join(s.hint("merge"), "src").join(t.hint("merge"), ["doc", "k"]).where(T.same_column(F.col("column"), F.col("doc_column")))
    return j.groupBy("src", "doc", "column").agg(F.min_by("doc_column", "position").alias("doc_column"))


def overlap_pairs(rows: DataFrame, threshold: float, tokens: str = "tokens", id_col: str = "id") -> DataFrame:
    """Ordered pairs (i < j) with |A & B| >= threshold * |A|, A the words of i: (i, j, overlap)."""
    side = lambda c: rows.select(F.col(id_col).alias(c), F.array_distinct(tokens).alias("tokens"))
    return similar_sets(side("i"), side("j"), threshold, contained=True).where("i < j").select("i", "j", F.col("score").alias("overlap"))


def held_in(names: DataFrame, texts: DataFrame, scope: list[str] | None = None, gram: int = 3) -> DataFrame:
    """(scope, s, l): each name (scope, s) with the texts (scope, l) of its scope that hold it, once each.

    Where the names and texts of all scopes make fewer pairs than the texts have grams, names
    and texts of a scope are compared. Otherwise a name is sought by that of its character grams which the fewest texts of the scope
    hold; names shorter than ``gram`` are grams of their own length. A name with a gram
    that no text holds is in none. Empty and null names and texts match nothing.

    Exploded rows are more than Spark takes them for; hints keep it from sending them to all.
    """
    scope = scope or []

    def cut_up(df: DataFrame, c: str, lengths: list[Column]) -> DataFrame:
        grams = lambda k: F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substr(F.col(c), i, k))
        some = [F.when(F.length(c) >= k, grams(k)) for k in lengths]
        return df.select(*scope, c, F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*some))))).alias("_g"))

    short, long = names.select(*scope, "s").where("s <> ''").distinct(), texts.select(*scope, "l").where("l <> ''").distinct()
    if scope:
        short, long = cut(short), cut(long)
        each = short.groupBy(*scope).agg(F.count("*").alias("_n")).hint("merge").join(long.groupBy(*scope).agg(F.count("*").alias("_m"), F.sum(F.length("l")).alias("_c")), scope)
        all_ = each.agg(F.coalesce(F.sum(F.col("_n").cast("double") * F.col("_m")), F.lit(0.0)).alias("pairs"), F.coalesce(F.sum("_c"), F.lit(0)).alias("chars")).first()
        if all_["pairs"] <= gram * all_["chars"]:
            return short.hint("merge").join(long, scope).where(F.col("l").contains(F.col("s"))).select(*scope, "s", "l")
    held = cut_up(long, "l", [F.lit(k) for k in range(1, gram + 1)])
    often = held.groupBy(*scope, "_g").agg(F.count("*").alias("_n"))
    keys = cut_up(short, "s", [F.least(F.length("s"), F.lit(gram))]).hint("merge").join(often, [*scope, "_g"], "left")
    rare = keys.groupBy(*scope, "s").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_g")).alias("r")).where("r.n > 0").select(*scope, "s", F.col("r._g").alias("_g"))
    return rare.hint("merge").join(held, [*scope, "_g"]).where(F.col("l").contains(F.col("s"))).select(*scope, "s", "l")


def contains_pairs(left: DataFrame, right: DataFrame, gram: int = 3) -> DataFrame:
    """Pairs (src, doc) in which one name contains the other (``left``: src, a; ``right``: doc, b)."""
    a, b = left.select("src", F.col("a").alias("s")), right.select("doc", F.col("b").alias("s"))
    one = held_in(a, b.withColumnRenamed("s", "l"), gram=gram).join(a.hint("merge"), "s").join(b.withColumnRenamed("s", "l").hint("merge"), "l").select("src", "doc")
    two = held_in(b, a.withColumnRenamed("s", "l"), gram=gram).join(b.hint("merge"), "s").join(a.withColumnRenamed("s", "l").hint("merge"), "l").select("src", "doc")
    return one.union(two).distinct()
