"""Secret scans: fixed patterns, and guess costs of values in a credential context.

Base kinds are found by pattern (leftmost, non-overlapping per kind; a match that
fails its length test is dropped without a retry). The method then looks at every
value that stands after a credential word and estimates how many guesses an
attacker needs: the cheapest segmentation of the value into known words, dates,
repeats, keyboard walks and brute-force spans, found by dynamic programming over
its positions. Values that cost at least `min_log10_guesses` become `guess` spans.

The dictionary holds common passwords and, by rank, the words that make up at least
`WORD_SHARE` of all words of the table's texts (so at most 1 / `WORD_SHARE` of them,
whatever the table's size); a word's place in it is what its guess costs.

Defined results: null and empty texts have no spans; repeated rows get equal results;
texts are scanned whole and values costed whole; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from volspan.llm import wordhash
from volspan.llm.arrowmap import append_struct, quoted
from volspan.llm.shared import WorkTables

KINDS = ("assign", "access", "hex")
ALL_KINDS = (*KINDS, "guess")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The same matches as `[0-9a-f]+` of 24 characters or more, without making the short ones.
HEX = re.compile(r"[0-9a-f]{24,}")
_HEX_BYTE = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))
#: A wider credential context than `assign`: more words, more separators, any value without white space.
CONTEXT = re.compile(
    r"""(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|credentials?|auth)["']?\s{0,3}(?::=|=>|[:=]|\bis\b)\s{0,3}["']?([^\s"'<>]{6,})"""
)

#: A corpus word is in the dictionary from this share of all words on.
WORD_SHARE = 1 / 200_000
#: Common passwords and the words they are made of, most frequent first.
WORDS = (
    "password 123456 12345678 qwerty 12345 letmein dragon baseball football monkey abc123 mustang access shadow master "
    "michael superman batman trustno1 iloveyou sunshine princess welcome admin login root user test guest default secret "
    "changeme pass hello love summer winter spring autumn flower cheese computer internet server system database office "
    "company security manager support service account money freedom whatever nothing ginger pepper purple orange yellow "
    "silver golden black white green blue red happy lucky magic star angel devil ninja hunter killer soccer hockey tiger "
    "eagle horse puppy kitty family mother father sister brother baby girl boy king queen prince lord lady sweet honey "
    "cookie coffee water fire earth wind rain snow night light house home city world country english january february "
    "march april june july august september october november december monday friday sunday token key value example "
    "sample demo temp dummy placeholder none null true false string number your my the and"
).split()
KEYBOARD_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("013457@$!", "oleastasi")

FOUND = StructType(
    [StructField(f"n_{k}", LongType()) for k in ALL_KINDS]
    + [
        StructField(
            "spans",
            ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])),
        )
    ]
)


def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for y, row in enumerate(KEYBOARD_ROWS):
        for x, c in enumerate(row):
            around = [(y, x - 1), (y, x + 1), (y - 1, x), (y - 1, x + 1), (y + 1, x - 1), (y + 1, x)]
            near[c] = {KEYBOARD_ROWS[j][i] for j, i in around if 0 <= j < len(KEYBOARD_ROWS) and 0 <= i < len(KEYBOARD_ROWS[j])}
    return near


NEAR = _neighbours()
DATE = re.compile(r"(?a:(?:19|20)\d\d(?:[-/.]?(?:1[0-2]|0?[1-9])(?:[-/.]?(?:[12]\d|3[01]|0?[1-9]))?)?|(?:[12]\d|3[01]|0?[1-9])[-/.]?(?:1[0-2]|0?[1-9])[-/.]?(?:19|20)\d\d)")


def brute_log10(value: str) -> float:
    """log10 of the guesses that try every string of the alphabet of `value`."""
    if re.fullmatch(r"(?a:\d+)", value):
        alphabet = 10
    elif re.fullmatch(r"[0-9a-f]+", value):
        alphabet = 16
    else:
        alphabet = 26 * bool(re.search(r"[a-z]", value)) + 26 * bool(re.search(r"[A-Z]", value)) + 10 * bool(re.search(r"(?a:\d)", value)) + 33 * bool(re.search(r"[^A-Za-z0-9]", value))
    return len(value) * math.log10(alphabet)


def corpus_words(df: DataFrame, text_col: str = "text", least_share: float = WORD_SHARE) -> tuple[str, ...]:
    """Words of 3 ASCII letters or more that make up at least `least_share` of all such words, most frequent first.

    Counted over all texts, before the shuffle within each task; at most 1 / `least_share` words come to the driver.
    """
    with WorkTables(df.sparkSession) as work:
        words = df.select(F.explode(F.split(F.lower(F.col(quoted(text_col)).cast("string")), "[^a-z]+")).alias("word")).where(F.length("word") >= 3)
        counted = work.stored(words.groupBy("word").agg(F.count("*").alias("n")), "corpus_words")
        total = counted.agg(F.sum("n").alias("n")).first().n or 0
        often = counted.where(F.col("n") >= max(2.0, least_share * total)).select("word", "n").collect()
    return tuple(r.word for r in sorted(often, key=lambda r: (-r.n, r.word)))


@lru_cache(maxsize=1)
def word_ranks(words: tuple[str, ...]) -> tuple[dict[str, float], int]:
    ranks: dict[str, float] = {}
    for i, w in enumerate(words):
        ranks.setdefault(w, math.log10(i + 2))
    return ranks, max(map(len, ranks), default=0)


LONGEST_UNIT, LONGEST_DATE = 8, 10
BOUNDARY = 0.3


class Starts:
    """The cheapest start of a segment that goes on growing: least of base[i] + log10(j - i) over the starts so far.

    Of two starts the earlier one gains on the later one as j grows, and once ahead stays ahead. So starts form a stack, the
    latest on top, each with the place from which on the one below it is cheaper: those places fall towards the
    top, or the start between is never the cheapest. Every start is pushed and popped once at most.
    """

    def __init__(self) -> None:
        self.starts: list[tuple[int, float]] = []
        self.until: list[float] = []  # from there on, the start below is cheaper

    @staticmethod
    def overtakes(early: tuple[int, float], late: tuple[int, float]) -> float:
        if late[1] <= early[1]:
            return math.inf
        gap = 10 ** min(300.0, late[1] - early[1])
        return (gap * late[0] - early[0]) / (gap - 1) if gap > 1 else math.inf

    def push(self, i: int, base: float) -> None:
        new = (i, base)
        while self.starts:
            place = self.overtakes(self.starts[-1], new)
            if self.until[-1] > place:
                break
            self.starts.pop()
            self.until.pop()
        self.until.append(self.overtakes(self.starts[-1], new) if self.starts else math.inf)
        self.starts.append(new)

    def least(self, j: int) -> float:
        while len(self.starts) > 1 and self.until[-1] <= j:
            self.starts.pop()
            self.until.pop()
        i, base = self.starts[-1]
        return base + math.log10(j - i)


def guess_log10(value: str, words: tuple[str, ...] = tuple(WORDS), enough: float = math.inf) -> float:
    """log10 of the guesses of the cheapest segmentation of `value`, whatever its length.

    best[j] is the least cost of value[:j]. Every segment but the first costs the
    attacker a factor of two more for not knowing where it begins. Segments are words (in
    any case, or with signs for letters), dates, walks over neighbouring keys, runs of
    consecutive characters, repeats of a unit of at most `LONGEST_UNIT` characters, and single
    characters of the value's alphabet. A run or repeat may begin anywhere within its stretch: `Starts` holds the
    cheapest place, so that the work grows with the length.

    As soon as no segmentation can stay below `enough`, some cost of at least that is returned.
    """
    ranks, longest = word_ranks(words)
    n, low = len(value), value.lower()
    if len(low) != n:  # a few capitals become two characters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    per_char = brute_log10(value) / n if n else 0.0
    best = [0.0] * (n + 1)
    after = [0.0] * (n + 1)  # the cost of a segment that begins here, before its own
    date_ends: dict[int, list[int]] = {}
    for m in (DATE.match(value, i) for i in range(n) if value[i] in "0123456789"):
        if m:
            date_ends.setdefault(m.end(), []).append(m.start())
    walk_start, walk_least = 0, math.inf  # least of after[i] - i / 4 over the places where this walk may begin
    run_start, step, run = 0, 0, Starts()
    same = [0] * (LONGEST_UNIT + 1)  # characters before j that equal the one a unit earlier
    repeats: list[dict[int, Starts]] = [{} for _ in same]  # of each unit, by the place of the start modulo the unit
    for j in range(1, n + 1):
        cost = best[j - 1] + per_char
        for i in range(max(0, j - longest), j - 1):
            rank, extra = ranks.get(low[i:j]), 0.0
            if rank is None and (rank := ranks.get(plain[i:j])) is not None:
                extra = 0.6
            if rank is not None:
                part = value[i:j]
                shape = 0.0 if part.islower() or part.isdigit() else 0.3 if part.istitle() or part.isupper() else 0.9
                cost = min(cost, after[i] + rank + extra + shape)
        for i in date_ends.get(j, ()):
            cost = min(cost, after[i] + math.log10(36_500))
        if j >= 2:
            if low[j - 1] not in NEAR.get(low[j - 2], ()):
                walk_start, walk_least = j - 1, math.inf
            elif j - 3 >= walk_start:
                walk_least = min(walk_least, after[j - 3] - 0.25 * (j - 3))
                cost = min(cost, walk_least + math.log10(47 * 2) + 0.25 * j)
            now = ord(low[j - 1]) - ord(low[j - 2])
            if now not in (1, -1) or now != step:
                run_start, step, run = j - 2 if now in (1, -1) else j - 1, now, Starts()
            if j - run_start >= 3:
                run.push(j - 3, after[j - 3])
                cost = min(cost, run.least(j) + math.log10(8))
        for unit in range(1, min(LONGEST_UNIT, j - 1) + 1):
            if value[j - 1] != value[j - 1 - unit]:
                if same[unit]:
                    same[unit] = 0
                    repeats[unit].clear()
                continue
            same[unit] += 1
            i = j - max(2 * unit, 3)  # the latest start: two copies, and three characters
            if same[unit] + unit >= j - i:
                starts = repeats[unit].setdefault(i % unit, Starts())
                starts.push(i, after[i])
                cost = min(cost, starts.least(j) - math.log10(unit) + unit * per_char)
        best[j], after[j] = cost, cost + BOUNDARY
        if cost >= enough and j % 64 == 0:
            # a segment that goes on past j begins at one of these places, if not after j
            first = min(j - longest, j - LONGEST_DATE, walk_start, run_start, *(j - same[u] - u for u in range(1, LONGEST_UNIT + 1)))
            if min(best[max(0, first - LONGEST_UNIT) : j + 1]) >= enough:
                return cost
    return best[n]


#: One of these (in either case) is in every text with a match of ASSIGN or CONTEXT.
MARKS = (b"pass", b"secret", b"token", b"key", b"pwd", b"credential", b"auth")


def marked(text: str) -> bool:
    low = text.encode().lower()
    return any(m in low for m in MARKS)


def long_hex(texts: pa.Array, least: int = 24) -> np.ndarray:
    """Which texts have a run of `least` characters of 0-9a-f."""
    raw, at = wordhash.text_bytes(texts)
    starts, ends = wordhash.word_spans(raw, at, _HEX_BYTE[raw])
    out = np.zeros(len(texts), bool)
    out[np.searchsorted(at, starts[ends - starts >= least], side="right") - 1] = True
    return out


def base_spans(text: str, may_assign: bool = True, may_hex: bool = True) -> dict[str, list[tuple[int, int]]]:
    """Start and end of the matches of each base kind, in code points."""
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[1]) >= 6] if may_assign else [],
        "access": [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else [],
        "hex": [m.span() for m in HEX.finditer(text)] if may_hex else [],
    }


def guess_spans(text: str, min_log10_guesses: float, words: tuple[str, ...]) -> list[tuple[int, int]]:
    found = []
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        while end > start and text[end - 1] in ".,;:!?)]}*#%&$|":
            end -= 1
        if end - start >= 6 and guess_log10(text[start:end], words, min_log10_guesses) >= min_log10_guesses:
            found.append((start, end))
    return found


def all_spans(texts: pa.Array, min_log10_guesses: float, words: tuple[str, ...]) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, kind, end), by start, then kind as listed."""
    out = []
    for text, may_hex in zip(texts.to_pylist(), long_hex(texts).tolist(), strict=True):
        may_assign = marked(text or "")
        found = base_spans(text or "", may_assign, may_hex)
        found["guess"] = guess_spans(text or "", min_log10_guesses, words) if may_assign else []
        out.append(sorted((s, k, e) for k, kind in enumerate(ALL_KINDS) for s, e in found[kind]))
    return out


def secret_spans(
    df: DataFrame,
    text_col: str = "text",
    out: str = "secrets",
    keep: Sequence[str] | None = None,
    min_log10_guesses: float = 9.0,
    words: Sequence[str] | None = None,
) -> DataFrame:
    """Append a struct with the number of spans of each kind and all spans, by start, then kind as listed.

    `words`, most frequent first, is the dictionary behind the common passwords; by default that of the table itself.
    """
    words = (*WORDS, *(corpus_words(df, text_col) if words is None else words))

    def run(texts: pa.Array) -> list[pa.Array]:
        found = all_spans(texts, min_log10_guesses, words)
        counts = ([sum(k == kind for _, k, _ in spans) for spans in found] for kind in range(len(ALL_KINDS)))
        return [*counts, [[{"kind": ALL_KINDS[k], "start": s, "end": e} for s, k, e in spans] for spans in found]]

    return append_struct(df, text_col, out, FOUND, run, keep, finish=word_ranks.cache_clear)


REDACTED = StructType([StructField("text", StringType()), StructField("n_spans", LongType())])


def redact_secrets(
    df: DataFrame,
    text_col: str = "text",
    out: str = "redacted",
    keep: Sequence[str] | None = None,
    replacement: str = "[secret]",
    min_log10_guesses: float = 9.0,
    words: Sequence[str] | None = None,
) -> DataFrame:
    """Append a struct with the text whose spans (overlapping ones together) are replaced, and their number.

    A null text stays null. `words` as in `secret_spans`.
    """
    words = (*WORDS, *(corpus_words(df, text_col) if words is None else words))

    def run(texts: pa.Array) -> list[pa.Array]:
        clean, counts = [], []
        for text, spans in zip(texts.to_pylist(), all_spans(texts, min_log10_guesses, words), strict=True):
            counts.append(len(spans))
            if spans:
                parts, at = [], 0
                for s, _, e in spans:
                    if s >= at:
                        parts += [text[at:s], replacement]
                    at = max(at, e)
                text = "".join(parts) + text[at:]
            clean.append(text)
        return [pa.array(clean, pa.string()), counts]

    return append_struct(df, text_col, out, REDACTED, run, keep, finish=word_ranks.cache_clear)
