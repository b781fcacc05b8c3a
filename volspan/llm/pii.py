"""Personal data: fixed patterns, and a semi-Markov conditional random field.

Base kinds (email, ip, card, phone) are found by pattern, leftmost and
non-overlapping per kind; a match that fails its test is dropped without a retry.

Tokens are runs of digits, runs of letters and single signs, so that entities in JSON, CSV,
HTML and other texts without blanks have boundaries too. The random field segments the
tokens around every trigger (a run of digits, an at sign, or a spelled-out "at"/"dot"
sign) into entities of at most `MOST_TOKENS` tokens and `MOST_CHARS` characters, and single
outside tokens. A candidate lies within a stretch: between two words, around quotes,
colons and the like (`breaks`) no entity goes on; it begins with a letter, digit, plus sign or
parenthesis, and ends with a letter or digit; it holds one at sign, or no word and either four
runs of digits or, without commas, `FEW_DIGITS` to `MANY_DIGITS` digits. Features describe whole spans: how many digits, which
separators, which tests (octets, Luhn, digit counts) the span passes once spelled-out signs
are undone, and what stands beside it; outside tokens and neighbouring labels have weights
of their own. Dynamic programming over segment ends and
labels picks boundaries and types together, so its cost is tokens x MOST_TOKENS x labels
squared. Entities that overlap no base span are added, with the kinds `crf_email` and so on.

The weights are fitted here, by gradient steps on the segmentation likelihood, on
windows around base matches of a bounded sample of rows, each also in disguised
forms (signs spelled out, plus sign left out, other separators), between blanks and inside
quotes, tags, brackets and separated fields, and on windows around near misses (dates, amounts,
versions) and other triggers.

Defined results: null and empty texts have no spans; repeated rows get equal results;
texts are read whole (the windows of a text are disjoint and cover every trigger);
other columns pass through; without any base match in the sample nothing is added.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cached_property
from itertools import accumulate, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from volspan.llm.arrowmap import append_struct, quoted

KINDS = ("email", "ip", "card", "phone")
#: An email is searched from its at sign: the longest run of LOCAL before it, then HOST. Searched from
#: its beginning, a long run without an at sign would be read again from each of its characters.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can begin only where a run of digits does: what follows the run is the same for all of its digits.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Longest entity in tokens and in characters, and tokens of context on both sides of a trigger.
MOST_TOKENS, MOST_CHARS = 24, 120
CONTEXT = 8
#: Fewest and most digits of an entity without an at sign; an address may have fewer.
FEW_DIGITS, MANY_DIGITS = 8, 19
#: Windows that fit the weights: at most so many.
FIT_WINDOWS = 1000

TOKEN = re.compile(r"[0-9]+|[^\W0-9_]+|[^\w\s]|_")
#: Each match begins where a token does.
TRIGGER = re.compile(r"[0-9]++|@|(?i:[\[({<](?:at|dot)[\])}>])|(?i:(?<!\S)dot(?!\S))|(?i:(?<!\S)at(?=\s+[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2}))")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of LOCAL+@HOST, in time linear in the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        free = at  # a local part holds no at sign
        if start < at and (m := HOST.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(free, at + 1))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


# whole-span features

_GLUE = frozenset("._%+-@")
FEATURES = (
    "one", "tokens", "email_shape", "email_spelled", "at_count1", "host_tail", "local_ok", "ip_shape", "ip_spelled", "octets",
    "digits16", "luhn", "digits8_9", "digits10_15", "digits_only", "plus", "paren", "grouped3", "grouped4", "letters", "other_sign", "no_digit",
    "glued_before", "glued_after", "edge_letter", "before_digit", "after_digit", "short_digits", "long_digits", "sign_edge",
)
NF = len(FEATURES)
_NO_DIGITS = str.maketrans("", "", "0123456789")
_GROUPS, _OCTETS = re.compile(r"[0-9]+"), re.compile(r"\s*[.,]\s*")
_AT_WORD = re.compile(r"(?i)\s*(?:[\[({<]\s*at\s*[\])}>]|\bat\b)\s*")
_DOT_WORD = re.compile(r"(?i)\s*(?:[\[({<]\s*dot\s*[\])}>]|\bdot\b)\s*")


def span_features(s: str, tokens: int, before: str, after: str) -> np.ndarray:
    """The features of one candidate span; `before` and `after` are the two characters on its sides."""
    rest = s.translate(_NO_DIGITS)
    if any(c.isalpha() for c in rest):
        signs = _DOT_WORD.sub(".", _AT_WORD.sub("@", s))
        rest = signs.translate(_NO_DIGITS)
    else:
        signs = s
    spelled = signs != s
    groups = _GROUPS.findall(signs)
    d = "".join(groups)
    n = len(d)
    four = len(groups) == 4 and n <= 12 and all(int(g) <= 255 for g in groups)
    octets = _OCTETS.split(signs.replace("[.]", ".")) if four else ()
    ip = len(octets) == 4 and all(o.isascii() and o.isdigit() and len(o) <= 3 and int(o) <= 255 for o in octets)
    email = "@" in signs and re.fullmatch(r"[A-Za-z0-9._%+-]+\s?@\s?[A-Za-z0-9-]+(?:\s?\.\s?[A-Za-z0-9-]+)+", signs) is not None
    return np.array(
        [
            1.0, tokens / MOST_TOKENS, email and not spelled, email and spelled, signs.count("@") == 1, re.search(r"\.[a-z]{2,6}$", signs) is not None,
            re.match(r"[A-Za-z0-9._%+-]+\s?@", signs) is not None, ip and not spelled, ip and spelled, four,
            16 <= n <= 19, 16 <= n <= 19 and luhn(d), 8 <= n <= 9, 10 <= n <= 15, bool(n) and not rest, signs.startswith("+"), "(" in signs and ")" in signs,
            len(groups) >= 3 and len(groups[-1]) == 4 and len(groups[-2]) == 3, len(groups) == 4 and all(len(g) == 4 for g in groups),
            any(c.isalpha() for c in rest), any(c in "=/\\_#*$|<>" for c in rest), n == 0,
            before[-1:].isalnum() or before[-1:] in _GLUE, after[:1].isalnum() or after[:1] in _GLUE and after[1:].isalnum(), s[:1].isalpha() and s[-1:].isalpha(),
            any("0" <= c <= "9" for c in before), any("0" <= c <= "9" for c in after), 0 < n < 7, n > 19, signs[:1] in (".", "@") or signs[-1:] in (".", "@"),
        ],
        np.float32,
    )


OUTSIDE = len(KINDS)
OUTSIDE_FEATURES = ("digit", "at sign", "plus", "spelled-out sign", "four digits")
_SIGN_WORD = re.compile(r"(?i)[\[({<]?(?:at|dot)[\])}>]?")


class Field(NamedTuple):
    """Weights: of whole spans (kinds x features), of single outside tokens, and of neighbours (from, to)."""

    spans: np.ndarray
    outside: np.ndarray
    moves: np.ndarray

    @staticmethod
    def zeros() -> Field:
        return Field(np.zeros((len(KINDS), NF)), np.zeros(len(OUTSIDE_FEATURES)), np.zeros((OUTSIDE + 1, OUTSIDE + 1)))


def outside_features(word: str) -> np.ndarray:
    n = len(digits_of(word))
    return np.array([n > 0, "@" in word, word.startswith("+"), _SIGN_WORD.fullmatch(word) is not None, n >= 4], np.float32)


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


SPELLED = frozenset(("at", "dot"))
_STOPS = frozenset("\"'`:;=&?!*|$")
_OPENING, _CLOSING = frozenset("<[{"), frozenset(">]}")


def breaks(words: Sequence[str], spans: Sequence[tuple[int, int]]) -> list[bool]:
    """Before which tokens no entity goes on: between words with a blank between them, unless one is a
    spelled-out sign, and around stops. Brackets stop unless they hold a sign: `[at]`, `<dot>`, `[.]`."""
    n = len(words)
    spelled = [w.lower() in SPELLED or w in (".", "@") for w in words]
    stop = [
        w in _STOPS or w in _OPENING and not (i + 1 < n and spelled[i + 1]) or w in _CLOSING and not (i and spelled[i - 1])
        for i, w in enumerate(words)
    ]
    plain = [w[0].isalnum() for w in words]
    out = [True]
    for i in range(1, n):
        apart = spans[i][0] > spans[i - 1][1] and plain[i] and plain[i - 1] and not (spelled[i] or spelled[i - 1])
        out.append(stop[i] or stop[i - 1] or apart and not (words[i][0] in "0123456789" and words[i - 1][0] in "0123456789"))
    return out


class Window:
    """The tokens around triggers. A labelling cuts them into entities and single outside tokens."""

    def __init__(self, text: str, tokens: list[tuple[int, int]], triggers: Sequence[bool]):
        self.text, self.tokens = text, tokens
        self.word = words = [text[a : min(b, a + MOST_CHARS)] for a, b in tokens]
        self.first = first = []  # where the stretch of each token begins
        for i, new in enumerate(breaks(words, tokens)):
            first.append(i if new else first[-1])
        digits = [b - a if w[0] in "0123456789" else 0 for w, (a, b) in zip(words, tokens, strict=True)]
        self.opens = [w.isascii() and (w.isalnum() or w in "+(") for w in words]
        self.closes = [w.isascii() and w.isalnum() for w in words]
        sums = (triggers, digits, map(bool, digits), [w == "," for w in words], [w == "@" or w.lower() == "at" for w in words], [w[0].isalpha() and w.lower() not in SPELLED for w in words])
        self.hot, self.digits, self.runs, self.commas, self.ats, self.letters = ([0, *accumulate(map(int, x))] for x in sums)

    def candidate(self, i: int, j: int) -> bool:
        """Whether tokens `i` to `j` can be an entity; both lie in one stretch."""
        if not self.opens[i] or self.hot[j] == self.hot[i] or self.tokens[j - 1][1] - self.tokens[i][0] > MOST_CHARS:
            return False
        if self.ats[j] > self.ats[i]:
            return self.ats[j] == self.ats[i] + 1
        if self.letters[j] > self.letters[i]:
            return False
        n = self.digits[j] - self.digits[i]
        return self.runs[j] == self.runs[i] + 4 and n <= MANY_DIGITS or FEW_DIGITS <= n <= MANY_DIGITS and self.commas[j] == self.commas[i]

    def ending(self, j: int) -> tuple[list[int], np.ndarray]:
        """Where the candidate entities that end before token `j` begin, and their features."""
        last, text = self.tokens[j - 1][1], self.text
        starts = [i for i in range(max(self.first[j - 1], j - MOST_TOKENS), j) if self.candidate(i, j)] if self.closes[j - 1] else []
        made = []
        for i in starts:
            a = self.tokens[i][0]
            made.append(span_features(text[a:last], j - i, text[max(0, a - 2) : a], text[last : last + 2]))
        return starts, np.stack(made) if made else np.zeros((0, NF), np.float32)

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and features of all candidates, and the features of all tokens: for fitting."""
        begins, ends, made = [], [], []
        for j in range(1, len(self.tokens) + 1):
            starts, features = self.ending(j)
            begins += starts
            ends += [j] * len(starts)
            made.append(features)
        return np.array(begins, int), np.array(ends, int), np.concatenate(made), np.stack([outside_features(w) for w in self.word])

    def best(self, field: Field) -> list[tuple[int, int, int]]:
        """The best labelling's entities: start, end, kind. Only the features of one end are held at a time."""
        n, k = len(self.tokens), OUTSIDE
        value = np.full((n + 1, k + 1), -np.inf)
        value[0, k] = 0.0  # before the window is outside
        back = np.zeros((n + 1, k + 1, 2), np.int32)  # where the segment begins, and the label before it
        enter = np.empty((n + 1, k + 1))  # best way to begin a label here
        source = np.empty((n + 1, k + 1), np.int32)
        for j in range(n + 1):
            if j:
                value[j, k] = enter[j - 1, k] + float(outside_features(self.word[j - 1]) @ field.outside)
                back[j, k] = j - 1, source[j - 1, k]
                starts, features = self.ending(j)
                if starts:
                    scores = features @ field.spans.T + enter[starts, :k]
                    top = scores.argmax(axis=0)
                    value[j, :k] = scores[top, np.arange(k)]
                    back[j, :k, 0] = np.array(starts)[top]
                    back[j, :k, 1] = source[back[j, :k, 0], np.arange(k)]
            ways = value[j][:, None] + field.moves
            source[j], enter[j] = ways.argmax(axis=0), ways.max(axis=0)
        out, j, label = [], n, int(value[n].argmax())
        while j:
            i, before = back[j, label]
            if label < k:
                out.append((int(i), j, label))
            j, label = int(i), int(before)
        return out[::-1]

    def gradient(self, field: Field, gold: dict[tuple[int, int], int]) -> tuple[float, Field]:
        """Log likelihood of the gold labelling, and its gradient: its own counts less the expected ones."""
        begins, ends, features, tokens = self.table
        n, k = len(self.tokens), OUTSIDE
        scores, outside = features @ field.spans.T, tokens @ field.outside
        ending, beginning = ([np.flatnonzero(x == j) for j in range(n + 1)] for x in (ends, begins))
        # forward[j]: all ways to label the tokens before j, by the last label; enter[j]: and to go on with a label
        forward, backward = np.full((n + 1, k + 1), -np.inf), np.zeros((n + 1, k + 1))
        enter, leave = np.empty((n + 1, k + 1)), np.full((n + 1, k + 1), -np.inf)
        forward[0, k] = 0.0
        enter[0] = logsum(forward[0][:, None] + field.moves, 0)
        for j in range(1, n + 1):
            forward[j, k] = enter[j - 1, k] + outside[j - 1]
            if len(at := ending[j]):
                forward[j, :k] = logsum(scores[at] + enter[begins[at], :k], 0)
            enter[j] = logsum(forward[j][:, None] + field.moves, 0)
        whole = float(logsum(forward[n], 0))
        for i in range(n - 1, -1, -1):
            leave[i, k] = outside[i] + backward[i + 1, k]
            if len(at := beginning[i]):
                leave[i, :k] = logsum(scores[at] + backward[ends[at], :k], 0)
            backward[i] = logsum(field.moves + leave[i], 1)
        spans = np.exp(scores + enter[begins, :k] + backward[ends, :k] - whole) if len(begins) else np.zeros((0, k))
        singles = np.exp(enter[:n, k] + outside + backward[1:, k] - whole)
        moves = np.exp(forward[:n, :, None] + field.moves + leave[:n, None, :] - whole).sum(axis=0)
        # the gold labelling
        total, label, at = 0.0, k, 0
        own = {(b, e): x for x, (b, e) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True))}
        entity = {b: (e, kind) for (b, e), kind in gold.items()}
        spans, singles, moves = -spans, -singles, -moves
        while at < n:
            e, kind = entity.get(at, (at + 1, k))
            total += field.moves[label, kind] + (scores[own[at, e], kind] if kind < k else outside[at])
            moves[label, kind] += 1
            if kind < k:
                spans[own[at, e], kind] += 1
            else:
                singles[at] += 1
            label, at = kind, e
        return total - whole, Field(spans.T @ features, singles @ tokens, moves)


def windows(text: str) -> list[Window]:
    """Disjoint windows that cover every trigger with its context; tokens are looked up only near triggers."""
    out: list[Window] = []
    held: list[tuple[int, int]] = []
    hot: list[bool] = []

    def close() -> None:
        held.extend(m.span() for m in islice(TOKEN.finditer(text, held[-1][1]), CONTEXT))
        out.append(Window(text, list(held), hot + [False] * (len(held) - len(hot))))
        held.clear()
        hot.clear()

    for trigger in TRIGGER.finditer(text):
        t = trigger.start()
        if held:
            left = [m.span() for m in islice(TOKEN.finditer(text, held[-1][1], t), MOST_TOKENS + 1)]
            if len(left) > MOST_TOKENS:  # more than twice the context, so the windows stay disjoint
                close()
        if not held:
            since = max(0, t - 2 * MOST_CHARS)
            left = [m.span() for m in TOKEN.finditer(text, since, t)]
            if since and left and left[0][0] == since:  # it may begin earlier
                left = left[1:]
            left = left[-CONTEXT:]
        held += [*left, TOKEN.match(text, t).span()]
        hot += [False] * len(left) + [True]
    if held:
        close()
    return out


def disguises(kind: str, s: str) -> list[str]:
    if kind == "email":
        return [s.replace("@", " at ").replace(".", " dot "), s.replace("@", " [at] ").replace(".", "[dot]"), s.replace("@", "[at]"), s.replace("@", " @ ")]
    if kind == "ip":
        return [s.replace(".", " dot "), s.replace(".", "[.]"), s.replace(".", " . ")]
    if kind == "card":
        return [s.replace(" ", ".").replace("-", ".")]
    return [s.lstrip("+"), s.lstrip("+").replace(" ", "."), "00" + s.lstrip("+")]


#: What a match is set into besides its own words: quotes, tags, brackets, separated fields.
SETTINGS = ('"{}"', "={};", ">{}<", ",{},", "({})", ":{}", "'{}',", "[{}]")


def ordinary(rng: np.random.Generator) -> str:
    """A near miss of the kinds: dates, times, amounts, versions, lists, "at" and "dot" as words."""
    n = lambda most: int(rng.integers(1, most))
    forms = (
        f"{1900 + n(130)}-{n(13):02}-{n(29):02} at {n(24)}:{n(60):02}", f"{n(29)}.{n(13)}.{1900 + n(130)}", f"{n(24):02}:{n(60):02}:{n(60):02}",
        f"{n(900)},{n(1000):03},{n(1000):03}", f"${n(900)},{n(1000):03}.{n(100):02}", f"v{n(9)}.{n(20)}.{n(20)}", f"[{n(9)}, {n(99)}, {n(99)}]", f"[{n(9)},{n(99)},{n(99)}]",
        f"meet at {n(12)} there", "look at it", f"at {n(90)} . {n(9)} percent", f"number {n(10**8)}", f"{n(99)} {n(99)} {n(99)}", f"{n(29)}/{n(13)}/{1900 + n(130)}",
    )
    return forms[int(rng.integers(len(forms)))]


def training_windows(texts: Sequence[str], most: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Snippets around base matches, plain and disguised, around near misses and other triggers; with gold spans."""
    out: list[tuple[str, list[tuple[int, int, int]]]] = []
    rng = np.random.Generator(np.random.PCG64(7))
    for text in texts:
        spans = base_spans(text)
        taken = [s for k in KINDS for s in spans[k]]
        for k, kind in enumerate(KINDS):
            for a, b in spans[kind][:4]:
                if any(x < b and a < y for x, y in taken if (x, y) != (a, b)):
                    continue
                left, right = " ".join(text[max(0, a - 80) : a].split()[-3:]), " ".join(text[b : b + 80].split()[:3])
                glue = "" if a == 0 or text[a - 1].isspace() else None
                if glue is None or TRIGGER.search(left + right):
                    continue
                for s in (text[a:b], *disguises(kind, text[a:b])):
                    for setting in ("{}", SETTINGS[len(out) // 2 % len(SETTINGS)]):
                        before, behind = setting.split("{}")
                        head = f"{left} {before}" if left else before
                        out.append((f"{head}{s}{behind} {right}", [(len(head), len(head) + len(s), k)]))
                out += [(f"{left} {ordinary(rng)} {right}", []) for _ in range(3)]
        for m in list(TRIGGER.finditer(text))[:3]:
            if not any(x <= m.start() < y for x, y in taken):
                a, b = max(0, m.start() - 40), m.end() + 40
                if not any(x < b and a < y for x, y in taken):
                    out.append((" ".join(text[a:b].split()[1:-1]), []))
        if len(out) >= most:
            break
    return out[:most]


def fit_weights(texts: Sequence[str], most: int = FIT_WINDOWS, rounds: int = 4) -> Field:
    """Weights by averaged Adagrad steps on the likelihood of whole labellings."""
    field = Field.zeros()
    field.spans[:, 0] = -4.0
    examples = []
    for text, gold in training_windows(texts, most):
        for w in windows(text):
            found = {}
            for a, b, k in gold:
                i = next((i for i, t in enumerate(w.tokens) if t[0] == a), None)
                j = next((j for j, t in enumerate(w.tokens) if t[1] == b), None)
                if i is not None and j is not None and i in w.ending(j + 1)[0]:
                    found[(i, j + 1)] = k
            if not gold or found:
                examples.append((w, found))
    if not any(found for _, found in examples):  # nothing to learn from: everything is outside
        field.spans[:, 0] = -100.0
        return field
    squares, total, steps = Field(*(np.full_like(x, 0.1) for x in field)), Field.zeros(), 0
    order = np.random.Generator(np.random.PCG64(3))
    for _ in range(rounds):
        for k in order.permutation(len(examples)):
            w, gold = examples[k]
            _, step = w.gradient(field, gold)
            for x, g, s, t in zip(field, step, squares, total, strict=True):
                g = g - 1e-4 * x
                s += g * g
                x += 0.5 * g / np.sqrt(s)
                t += x
            steps += 1
    return Field(*(t / steps for t in total))


def added_spans(text: str, weights: Field, taken: Sequence[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Entities of the random field that overlap no base span: start, end, kind."""
    out = []
    for w in windows(text):
        for i, j, k in w.best(weights):
            a, b = w.tokens[i][0], w.tokens[j - 1][1]
            if not any(x < b and a < y for x, y in taken):
                out.append((a, b, k))
    return out


ALL_KINDS = (*KINDS, *(f"crf_{k}" for k in KINDS))
FOUND = StructType(
    [StructField(f"n_{k}", LongType()) for k in ALL_KINDS]
    + [StructField("spans", ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])))]
)


def sample_texts(docs: DataFrame, text_col: str, rows: int) -> list[str]:
    """Texts with a trigger, about `rows` of them at most, cut to the part around it before they travel.

    Texts are picked by their hash, so that each run takes the same, and equal parts count once: the
    driver gets about `rows` short texts whatever the table's size and however many copies it holds.
    """
    text = F.col(quoted(text_col)).cast("string")
    at = F.regexp_instr(text, F.lit(r"@|\+[0-9]|[0-9]{4}[ -]?[0-9]{4}|[0-9]\.[0-9]"))
    share = min(1.0, rows / max(1, docs.where(at > 0).count()))
    picked = docs.where(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < round(share * (1 << 30))).where(at > 0)
    near = picked.select(F.substring(text, F.greatest(at - 300, F.lit(1)), F.lit(700)).alias("near")).distinct()
    return sorted(r.near for r in near.collect())


def personal_data(
    df: DataFrame,
    text_col: str = "text",
    out: str = "pii",
    keep: Sequence[str] | None = None,
    weights: Field | None = None,
    fit_rows: int = 600,
) -> DataFrame:
    """Append a struct with the number of spans of each kind and all spans, by kind as listed, then start.

    `weights` of the random field are fitted on about `fit_rows` rows of `df` unless given.
    """
    if weights is None:
        weights = fit_weights(sample_texts(df, text_col, fit_rows))

    def run(texts: pa.Array) -> list[pa.Array]:
        counts, spans = [], []
        for text in texts.to_pylist():
            found: dict[str, list[tuple[int, int]]] = {k: [] for k in ALL_KINDS}
            if text and TRIGGER.search(text):
                found |= base_spans(text)
                taken = [s for k in KINDS for s in found[k]]
                for a, b, k in added_spans(text, weights, taken):
                    found[f"crf_{KINDS[k]}"].append((a, b))
            counts.append([len(found[k]) for k in ALL_KINDS])
            spans.append([{"kind": k, "start": a, "end": b} for k in ALL_KINDS for a, b in sorted(found[k])])
        return [*([c[i] for c in counts] for i in range(len(ALL_KINDS))), spans]

    return append_struct(df, text_col, out, FOUND, run, keep)


