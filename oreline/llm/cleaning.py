"""Quality rules, line first: bad lines go, then documents that lost too much.

A line with a word is judged by three rules, the first that it fails counts:

- ``punctuation``: no sentence ends in it, or marks and symbols crowd its words;
- ``navigation``: a menu or trail (separators between few words), or a short line of
  a link text;
- ``boilerplate``: a notice (licence, cookies, script warnings), a repetition of an
  earlier line, or a line that says few words over and over.

Lines without a word stay. A document is kept unless its words are too few, its
three-word windows repeat too much (the base rules), or the lines removed held more
than ``max_lost`` per cent of its words. All rules read one document only, so there is
no shuffle and a lost executor costs its own tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import compress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, text_or_empty

MIN_WORDS = 50  # fewer fail the base rules
MAX_REPEATED = 50  # per cent of the words in repeated three-word windows, from which on documents fail
MAX_LOST = 50  # per cent of the words in removed lines, above which a document is rejected

MARKS = "#*$%&|<>"
ENDS = r"[.!?:;…。！？\"”’»)\]][\x20\x09-\x0D]*$"
INNER = r"[.!?…。！？][\x20\x09-\x0D]"
SEPARATORS = "|»›·•>"
SHORT, NOTICE = 6, 30  # words of a link text and of a notice, at most
LINKS = ("home", "next", "previous", "read more", "click here", "back to top", "skip to", "log in", "sign in", "sign up", "share this", "menu", "contact us")
NOTICES = (
    "all rights reserved", "copyright", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy", "cookie",
    "enable javascript", "requires javascript", "lorem ipsum", "subscribe to our", "your browser",
)

RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, lost_words long, removed array<struct<line:int,rule:string>>, clean string"
ENDS_RE, INNER_RE = re.compile(ENDS), re.compile(INNER)
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def failed_rule(line: str, words: list[bytes]) -> str | None:
    """The first rule that a line with words fails, repetition of earlier lines aside."""
    n = len(words)
    if 2 * (sum(map(line.count, MARKS)) + line.count("!")) > n or not (ENDS_RE.search(line) or INNER_RE.search(line)):
        return "punctuation"
    separators = sum(map(line.count, SEPARATORS))
    low = line.translate(FOLD)
    if (separators >= 2 and 4 * separators >= n) or (n <= SHORT and any(x in low for x in LINKS)):
        return "navigation"
    if (n <= NOTICE and any(x in low for x in NOTICES)) or (n >= 10 and 10 * len(set(words)) < 3 * n):
        return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    hit = bytearray(len(words))
    for i in compress(range(len(windows)), (counts[x] > 1 for x in windows)):
        hit[i : i + 3] = b"\1\1\1"
    return sum(hit)


def judge(text: str, min_words: int, max_repeated: int, max_lost: int) -> tuple:
    raw = text.encode()
    words = raw.split()
    n = len(words)
    repeated = repeated_words(words)
    lines = text.split("\n")
    seen: set[str] = set()
    removed, stay, filled, dups, lost = [], [], 0, 0, 0
    for i, line in enumerate(lines):
        own = line.encode().split()
        if own:
            filled += 1
            again = line in seen
            dups += again
            seen.add(line)
            rule = failed_rule(line, own) or ("boilerplate" if again else None)
            if rule:
                removed.append({"line": i, "rule": rule})
                lost += len(own)
                continue
        stay.append(line)
    base = n < min_words or 100 * repeated > max_repeated * n
    chars = len(text) - len(raw) + sum(map(len, words))
    return n, chars, sum(map(raw.count, map(str.encode, MARKS))), dups, repeated, base, not base and 100 * lost <= max_lost * n, filled, lost, removed, "\n".join(stay)


def clean_lines(docs: DataFrame, text_col: str = "text", out: str = "cleaned", min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED, max_lost: int = MAX_LOST) -> DataFrame:
    """``docs`` with a struct ``out``: the counts, verdicts, removed lines (number from 0, rule) and the text without them.

    Lines are what newlines part; words are what ASCII blanks part; code points count as
    characters. A null text counts as an empty one, which has no words and fails the base
    rules; texts of any length are read whole. A line fails by its own words or, if it
    equals an earlier line of the text, as boilerplate. All other columns stay, whatever
    their names (a column called like ``out`` is replaced); null ids and repeated rows are
    rows like others; no rows: no rows.
    """

    @F.pandas_udf(RESULT)
    def cleaned(texts: pd.Series) -> pd.DataFrame:
        names = [part.split(" ")[0] for part in RESULT.replace("<line:int,rule:string>", "").split(", ")]
        return pd.DataFrame([judge(t, min_words, max_repeated, max_lost) for t in texts], columns=names)

    others = [F.col(quoted(c)) for c in docs.columns if c.lower() != out.lower()]
    return docs.select(*others, cleaned(text_or_empty(quoted(text_col))).alias(out))
