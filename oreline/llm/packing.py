"""Best-fit packing of tokenized documents with swap-based local search.

Pieces of one length are alike, so packing works on the number of pieces of each
length - at most ``capacity`` numbers at any input size - and on groups of bins with
equal contents. Best fit, longest first, gives the first packing; then local search
changes underfull bins: it moves pieces and swaps one for one or two for one, always
raising the sum of squared fills, until no change does or the fewest bins that could
hold all pieces are left. Pieces are numbered within
their length by Spark, and a piece's number decides its bin.
"""

from __future__ import annotations

import bisect
import heapq
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

PARTS, PART = 64, 500_000  # parts into which the pieces of one length are dealt while they are numbered, at least, and pieces of a part, on average at most
#: Texts of these characters go through the cache; all others through the tokenizer as they are.
WESTERN = "".join(map(chr, range(0xA1, 0x180)))
LETTERS = "a-z" + "".join(c for c in WESTERN if unicodedata.category(c)[0] == "L")
NUMBERS = "0-9" + "".join(c for c in WESTERN if unicodedata.category(c)[0] == "N")
PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{WESTERN}]*")
#: How word_bpe_49k.json cuts a lower-case text of those characters into words.
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
CACHED = 400_000


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, with a cache of words.

    The tokenizer cuts texts into words that are encoded on their own, so a word's
    ids are kept and joined. Texts with characters outside PLAIN, or with what may be
    a special token, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path = path
        self.by_word = Tokenizer.from_file(path)  # for words that are cut and lower-cased already
        self.by_word.normalizer = normalizers.Sequence([])
        self.by_word.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words: dict[str, bytes] = {}
        names = self.by_word.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, dtype=bool)  # ids that end a word
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True

    @cached_property
    def tokenizer(self):
        """Loaded with the first text that is encoded whole: tens of MB in every worker."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def learn(self, words: list[str]) -> None:
        """Encode new words in one go; the ids that end words tell them apart."""
        ids = np.array(self.by_word.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):  # a word without an end of its own
            self.words.update(zip(words, self.whole(words), strict=True))
            return
        data, at = ids.tobytes(), 0
        for word, end in zip(words, (ends * 4).tolist(), strict=True):
            self.words[word] = data[at:end]
            at = end

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > CACHED:
            self.words.clear()
        known, new, cut = self.words, set(), []
        for x in texts:
            words = WORDS.findall(x.lower()) if "<|" not in x and PLAIN.fullmatch(x) else None
            cut.append(words)
            if words:
                new |= set(words).difference(known)
        if new:
            self.learn(list(new))
        return [self.whole([x])[0] if words is None else b"".join(map(known.__getitem__, words)) for x, words in zip(texts, cut, strict=True)]


ENCODERS: dict[str, Encoder] = {}


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Pieces of at most ``capacity`` ids: id column, piece, start, length, ids (little-endian unsigned 32-bit).

    A document is its ids and then ``end_id``; a null or empty text is ``end_id``
    alone. Only longer documents are cut, and only their last piece is shorter.
    Repeated rows give pieces each; other columns are not carried; no rows: no rows.
    ``tokenizer_path`` is opened on the executors.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = ENCODERS.get(tokenizer_path) or ENCODERS.setdefault(tokenizer_path, Encoder(tokenizer_path))
        for pdf in batches:
            for a in range(0, len(pdf), 500):
                rows = []
                part = pdf.iloc[a : a + 500]
                for key, ids in zip(part["_id"].tolist(), encode(part["_text"].tolist()), strict=True):
                    ids += end
                    rows += [(key, i, i * capacity, min(capacity, len(ids) // 4 - i * capacity), ids[4 * i * capacity : 4 * (i + 1) * capacity]) for i in range(-(-len(ids) // (4 * capacity)))]
                yield pd.DataFrame(rows, columns=["_id", "piece", "start", "length", "ids"])

    slim = docs.select(F.col(id_col).cast("string").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = slim.mapInPandas(pieces, "_id string, piece int, start long, length long, ids binary")
    return out.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), "piece", "start", "length", "ids")


class Bins:
    """``count`` bins with the same pieces; items: number of pieces by length."""

    __slots__ = ("items", "fill", "count")

    def __init__(self, items: dict[int, int], count: int):
        self.items = {k: v for k, v in items.items() if v}
        self.fill = sum(k * v for k, v in self.items.items())
        self.count = count


def best_fit(lengths: dict[int, int], capacity: int) -> list[Bins]:
    """Best fit, longest first: a piece goes where it leaves the least room, else to a new bin."""
    by_room: dict[int, list[Bins]] = {}
    rooms: list[int] = []  # sorted keys of by_room
    done: list[Bins] = []

    def put(b: Bins) -> None:
        room = capacity - b.fill
        if not room:
            done.append(b)
        elif room in by_room:
            by_room[room].append(b)
        else:
            by_room[room] = [b]
            bisect.insort(rooms, room)

    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                bins = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[i]
            else:
                room, bins = capacity, Bins({}, left)
            each = room // length
            full = min(bins.count, left // each)
            if full:
                put(Bins(bins.items | {length: bins.items.get(length, 0) + each}, full))
            left -= full * each
            rest = bins.count - full
            if rest and left and left < each:  # fewer pieces than fit into one more bin
                put(Bins(bins.items | {length: bins.items.get(length, 0) + left}, 1))
                left, rest = 0, rest - 1
            if rest and bins.items:
                put(Bins(bins.items, rest))
    return done + [b for r in rooms for b in by_room[r]]


def few_pieces(items: dict[int, int]) -> dict[int, tuple[int, ...]]:
    """By sum: the fewest pieces of a bin, two at most, that have that sum."""
    out: dict[int, tuple[int, ...]] = {0: ()}
    out.update((p, (p,)) for p in items)
    lengths = list(items)
    for i, p in enumerate(lengths):
        for q in lengths[i:]:
            if p != q or items[p] > 1:
                out.setdefault(p + q, (p, q))
    return out


class Search:
    """Groups of underfull bins, and flat arrays of the pieces that each may give or take.

    An exchange moves ``come`` pieces from a bin of the giver and ``leave`` pieces back,
    three together at most, so that the receiver gains and the squares of both fills
    rise in sum. An entry of the arrays is one sum of a group's few pieces. Entries of
    groups without bins have a top that no piece is below and a fill that none reaches.
    """

    NEVER = 1 << 40

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.groups: list[Bins] = []
        self.few: list[dict[int, tuple[int, ...]]] = []
        self.at: list[slice] = []
        self.known: dict[frozenset, int] = {}
        self.used = 0
        self.sums, self.sizes, self.owner, self.fill, self.top = (np.zeros(1024, np.int64) for _ in range(5))

    def add(self, items: dict[int, int], count: int) -> int:
        """The group of those contents, with ``count`` bins more."""
        content = frozenset(items.items())
        g = self.known.get(content)
        if g is None:
            g = self.known[content] = len(self.groups)
            self.groups.append(Bins(items, 0))
            self.few.append(few_pieces(self.groups[g].items))
            self.at.append(slice(0, 0))
        if not self.groups[g].count:
            self.enter(g)
        self.groups[g].count += count
        return g

    def enter(self, g: int) -> None:
        few, fill = self.few[g], self.groups[g].fill
        if self.used + len(few) > len(self.sums):
            self.make_room(len(few))
        at = self.at[g] = slice(self.used, self.used + len(few))
        self.used = at.stop
        self.sums[at] = list(few)
        self.sizes[at] = [len(x) for x in few.values()]
        self.owner[at], self.fill[at] = g, fill
        self.top[at] = self.sums[at] + self.capacity - fill

    def make_room(self, n: int) -> None:
        """Leave out entries of groups without bins; the rest may fill half of the arrays at most."""
        alive = np.flatnonzero(self.top[: self.used] >= 0)
        size = max(1024, 2 * (len(alive) + n))
        for name in ("sums", "sizes", "owner", "fill", "top"):
            old, new = getattr(self, name), np.zeros(size, np.int64)
            new[: len(alive)] = old[alive]
            setattr(self, name, new)
        self.used = len(alive)
        first = np.flatnonzero(np.diff(self.owner[: self.used], prepend=-1))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), self.used], strict=True):
            self.at[int(self.owner[a])] = slice(a, b)

    def take(self, g: int, count: int) -> None:
        self.groups[g].count -= count
        if not self.groups[g].count:
            at = self.at[g]
            self.top[at], self.fill[at] = -1, self.NEVER

    def exchange(self, x: int) -> tuple[int, int, tuple[int, ...], tuple[int, ...]] | None:
        """(giver, receiver, come, leave): the best change of ``x`` with any group, None if no change raises the squares.

        As giver, x fills the fullest receiver as far as any change does; as
        receiver, it is filled from the emptiest giver.
        """
        n, own = self.used, self.at[x]
        sums, sizes, fill, top = self.sums[:n], self.sizes[:n], self.fill[:n], self.top[:n]
        mine, full = self.groups[x].fill, self.capacity + 1
        hidden = None
        if self.groups[x].count < 2:  # a single bin has no other of its kind
            hidden = top[own].copy()
            top[own], fill[own] = -1, self.NEVER
        best = None
        low = sums + np.maximum(0, mine - fill)
        for s, come in self.few[x].items():
            if s:
                i = np.flatnonzero((low < s) & (top >= s) & (sizes <= 3 - len(come)))
                if len(i):
                    k = i[np.argmax(fill[i] * full + s - sums[i])]
                    rank = (int(fill[k]), s - int(sums[k]))
                    if best is None or rank > best[0]:
                        best = rank, x, int(self.owner[k]), come, int(sums[k])
        found = best and (*best[1:4], self.few[best[2]][best[4]])
        if best is None:
            high = sums - np.maximum(0, fill - mine)
            for s, leave in self.few[x].items():
                i = np.flatnonzero((high > s) & (sums <= s + self.capacity - mine) & (sizes <= 3 - len(leave)))
                if len(i):
                    k = i[np.argmax(sums[i] - s - fill[i] * full)]
                    rank = (-int(fill[k]), int(sums[k]) - s)
                    if best is None or rank > best[0]:
                        best = rank, int(self.owner[k]), x, int(sums[k]), leave
            found = best and (best[1], x, self.few[best[1]][best[3]], best[4])
        if hidden is not None:
            top[own], fill[own] = hidden, mine
        return found


def local_search(bins: list[Bins], capacity: int, least: int) -> list[Bins]:
    """Empty the emptiest bins into fuller ones until ``least`` bins are left or no exchange raises the squared fills.

    A change between two groups is made in as many bins as both have. Groups that
    were found to have no change with each other are settled; only new contents, and
    groups that grow from one bin to more, are tried again, each with all groups.
    """
    total = sum(b.count for b in bins)
    if total <= least:
        return bins
    done: Counter = Counter()
    search, waiting = Search(capacity), []
    tried: set[int] = set()  # groups that have no change with each other

    def put(items: dict[int, int], count: int) -> None:
        items = {k: v for k, v in items.items() if v}
        fill = sum(k * v for k, v in items.items())
        if fill == capacity:
            done[frozenset(items.items())] += count
        else:
            g = search.add(items, count)
            if g not in tried:
                heapq.heappush(waiting, (fill, g))
            elif search.groups[g].count - count <= 1:
                tried.discard(g)
                heapq.heappush(waiting, (fill, g))

    for b in bins:
        put(b.items, b.count)
    while waiting and total > least:
        x = heapq.heappop(waiting)[1]
        while x not in tried and search.groups[x].count and total > least:
            found = search.exchange(x)
            if found is None:
                tried.add(x)
                break
            giver, receiver, come, leave = found
            a, b = Counter(search.groups[receiver].items), Counter(search.groups[giver].items)
            a.subtract(leave)
            a.update(come)
            b.subtract(come)
            b.update(leave)
            if giver == receiver:
                n = search.groups[x].count // 2
                search.take(x, 2 * n)
            else:
                n = min(search.groups[giver].count, search.groups[receiver].count)
                search.take(giver, n)
                search.take(receiver, n)
            for g in (giver, receiver):
                if not search.groups[g].count:
                    tried.discard(g)
            put(a, n)
            if +b:
                put(b, n)
            else:
                total -= n
    return [Bins(dict(c), n) for c, n in done.items()] + [b for b in search.groups if b.count]


def pack_lengths(lengths: dict[int, int], capacity: int) -> list[Bins]:
    least = -(-sum(k * v for k, v in lengths.items()) // capacity)
    return local_search(best_fit(lengths, capacity), capacity, least)


def pack_pieces(pieces: DataFrame, capacity: int = 4096, length_col: str = "length", order: list[str] | None = None) -> DataFrame:
    """All columns of ``pieces`` plus sequence_id (long, from 0) and offset (long, gapless in its sequence).

    Pieces of null length or of lengths outside 1..capacity are not packed: both
    columns are null. Pieces of one length are interchangeable and are numbered by
    ``order`` (default: all columns). Repeated rows are packed each; columns of the
    result's names are replaced; no rows: no rows.
    """
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    order = order or keep
    length = F.col(length_col).cast("long")
    rows = stage(pieces.select(*keep, F.when(length.between(1, capacity), length).alias("_l")), "pack-pieces")
    lengths = {r[0]: r[1] for r in rows.where("_l is not null").groupBy("_l").count().collect()}  # at most ``capacity`` rows
    spread = max(PARTS, -(-max(lengths.values(), default=0) // PART))
    rows = rows.withColumn("_sub", F.pmod(F.xxhash64(*order), F.lit(spread)).cast("int"))
    parts = rows.where("_l is not null").groupBy("_l", "_sub").agg(F.count("*").alias("_n"))

    slots: dict[int, list[tuple[int, int, int]]] = {}  # by length: first piece number, first sequence, offset
    taken: Counter = Counter()
    sequence = 0
    for b in pack_lengths(lengths, capacity):
        at = 0
        for n, times in sorted(b.items.items(), reverse=True):
            for _ in range(times):
                slots.setdefault(n, []).append((taken[n], sequence, at))
                taken[n] += b.count
                at += n
        sequence += b.count
    table = np.array([(n, *s) for n in sorted(slots) for s in slots[n]], dtype=np.int64).reshape(-1, 4)
    sent = pieces.sparkSession.sparkContext.broadcast(table)  # groups of bins times their pieces, not pieces

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(lengths: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        t = sent.value
        n, r = lengths.to_numpy(dtype=np.int64), numbers.to_numpy(dtype=np.int64)
        out = np.zeros((len(n), 2), dtype=np.int64)
        for value in np.unique(n):
            own = t[np.searchsorted(t[:, 0], value) : np.searchsorted(t[:, 0], value, side="right")]
            at = np.flatnonzero(n == value)
            i = np.searchsorted(own[:, 1], r[at], side="right") - 1
            out[at, 0] = own[i, 2] + r[at] - own[i, 1]
            out[at, 1] = own[i, 3]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    before = parts.withColumn("_from", F.sum("_n").over(Window.partitionBy("_l").orderBy("_sub")) - F.col("_n")).select("_l", "_sub", "_from")
    numbered = rows.where("_l is not null").withColumn("_rn", F.row_number().over(Window.partitionBy("_l", "_sub").orderBy(*order)))
    packed = numbered.join(before, ["_l", "_sub"]).withColumn("_p", place("_l", F.col("_from") + F.col("_rn") - 1))
    out = packed.select(*keep, F.col("_p.sequence_id").alias("sequence_id"), F.col("_p.offset").alias("offset"))
    return out.unionByName(rows.where("_l is null").select(*keep, F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset")))
