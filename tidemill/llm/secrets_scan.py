"""Secrets in texts: fixed patterns, and values in a credential's place that are costly to guess.

The patterns find assignments, access keys and long hexadecimal runs. Beyond them a value that stands where a
credential would (after ``pwd:``, ``Authorization: Bearer``, ``login =`` and the like) is judged by what an attacker
would need: dynamic programming finds the cheapest way to write it as words, separators, dates, digits, repeats,
keyboard walks and brute-force spans, in log10 guesses, and values over a threshold are reported as ``guess``. Words are
ranked by a tokenizer's vocabulary, which was learned by frequency. Where only white space stands between name and value
the threshold is higher and words are cheaper, for that is how running text looks; addresses are no secrets. Values of any
length are priced whole, also those that stand within others or within addresses.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import scratch

# The three patterns and the lengths below which their matches are dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that reach the length
ASSIGN_VALUE, ACCESS_LENGTH = 12, 18
KINDS = ("assign", "access", "hex", "guess")

#: A credential's name; what may stand between, and where the value begins, is looked ahead at, so that contexts may overlap.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|authorization|bearer|(?:api|access|private|secret)[ _-]?key|login)(?=["']?(?:\x20*(?:=>|->|[:=])\x20*(?:bearer\x20+)?|\x20+is\x20+|\x20+)["']?([^\s"'<>,;]{8}))""", re.IGNORECASE | re.ASCII)
VALUE_END = re.compile(r"""[\s"'<>,;]|\Z""")
REMEMBERED = 256  # characters; the costs of values up to that are remembered from text to text
_ASSIGN_NAMES = ("passw", "secret", "token", "api")
_CONTEXT_NAMES = ("pass", "pwd", "secret", "token", "credential", "authorization", "bearer", "key", "login")
#: A name, and nothing but white space (or ``is``) up to the value: running text as a rule.
PROSE = re.compile(r"\s+(?:is\s+)?[\"']?", re.IGNORECASE)
#: Addresses of pages and people stand where credentials do, and are none.
ADDRESS = re.compile(r"[a-z][a-z0-9+.-]*://|www\.|[^\s@:/]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+\W*\Z", re.IGNORECASE)
ONE_CASE = re.compile(r"(?<![^\W\d_])(?:[^\W\d_])(?:[^\W\d_A-Z]+|[A-Z]+)?(?![^\W\d_])")
THRESHOLD, PROSE_MORE = 13.0, 5.0  # log10 guesses
SEPARATORS, SEPARATOR = frozenset("-_./ "), 0.3
NEW_SPAN = 0.3  # where the next span begins is itself a guess
EXPECTED_WORD, UNLISTED_WORD = 2.0, 5.5

# Common words of passwords, most common first.
WORDS = {w: i for i, w in enumerate("password admin welcome letmein login secret token user test guest master dragon monkey qwerty love hello sunshine princess football baseball shadow superman batman michael jordan summer winter spring autumn monday friday january march april august changeme default root pass key value example sample demo my your the is for required must none null true false string".split(), 1)}
# Keyboard rows.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("4301$57@", "aeoissta")
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
LEAST_WORD, LONGEST_WORD = 4, 20  # letters of a word taken from the vocabulary
LONGEST_PERIOD = 16  # characters that are repeated
# From a repeated run to a place within it, then on by another span: past NEAR_START characters more of the run costs less
# than any such span (log10(1 + 20 / 8) < NEW_SPAN + log10(2), the commonest word), and farther than NEAR_END from the
# run's end none leads out: words, rows and dates are shorter, two runs that share 32 characters have a common period.
NEAR_START, NEAR_END = 8, 2 * LONGEST_PERIOD
STRIDE = 27  # longer than any span but repeats and, in prose, runs of letters
LETTERS = re.compile(rf"[^\W\d_]{{{STRIDE}}}")


@lru_cache(maxsize=1)
def _ranks() -> dict[str, int]:
    """WORDS, and behind them the words that the tokenizer's vocabulary holds, in its order of frequency."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    ranks = dict(WORDS)
    for token in sorted(vocabulary, key=vocabulary.get):
        word = token.lstrip("\u0120").lower()
        # Pieces of words are listed too; the shortest only where they are words of their own.
        if (LEAST_WORD <= len(word) <= LONGEST_WORD or 2 <= len(word) and token == f"\u0120{word}") and word.isascii() and word.isalpha():
            ranks.setdefault(word, len(ranks) + 1)
    return ranks


CHARSETS = (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10), ("[^A-Za-z0-9]", 33))


def _charset(value: str) -> int:
    return sum(size for chars, size in CHARSETS if re.search(chars, value)) or 1


def _spans_by_start(value: str, each: float, prose: bool) -> Iterator[tuple[int, list[tuple[int, float]], bool]]:
    """From the last character to the first: start, (end, log10 guesses) of the spans that are cheaper to write than
    character by character, and whether spans from further ahead may reach over the next STRIDE characters.

    In ``prose`` (the value follows a credential's name in running text) listed words are as good as expected, and a run
    of letters in one case is a word of some large dictionary. Of a long run of repeats only those ends are given that
    the cheapest way can use: what lies between costs less as more of the run (see NEAR_START, NEAR_END).
    """
    n = len(value)
    ranks = _ranks()
    lower = value.replace("\u0130", "i").lower()  # the only letter that grows in lower case
    plain = lower.translate(LEET)
    same = [0] * (LONGEST_PERIOD + 1)  # by period: characters from here on that come again that much later
    for i in range(n - 1, -1, -1):
        spans = []
        for j in range(i + 2, min(n, i + LONGEST_WORD) + 1):
            if rank := ranks.get(plain[i:j]):
                cost = math.log10(rank + 1)
                changed = (0.6 if value[i:j] != lower[i:j] else 0) + (0.6 if plain[i:j] != lower[i:j] else 0)
                spans.append((j, (min(cost, EXPECTED_WORD) if prose and not changed else cost) + changed))
        for row in ROWS:
            for way in (row, row[::-1]):
                at, j = way.find(lower[i]), i + 1
                if at >= 0:
                    while j < n and at + j - i < len(way) and lower[j] == way[at + j - i]:
                        j += 1
                    spans += [(k, 1.7 + math.log10(k - i)) for k in range(i + 3, j + 1)]
        repeated: list[int] = []
        far = prose and LETTERS.match(value, i) is not None
        for period in range(1, min(LONGEST_PERIOD, n - 1 - i) + 1):
            same[period] = same[period] + 1 if value[i] == value[i + period] else 0
            j = i + period + same[period]
            far = far or j - i >= STRIDE
            # A multiple of a shorter period reaches as far, for more.
            if same[period] < period or any(period % p == 0 and p + same[p] >= 2 * period for p in repeated):
                continue
            repeated.append(period)
            first, near = i + max(2 * period, 3), i + NEAR_START
            spans += [(k, period * each + math.log10(k - i)) for k in (*range(first, min(near, j) + 1), *range(max(first, near + 1, j - NEAR_END), j + 1))]
        if m := DATE.match(value, i):
            spans.append((m.end(), math.log10(120) if m.end() - i == 4 else math.log10(120 * 366)))
        if prose and (m := ONE_CASE.match(value, i)):
            spans.append((m.end(), UNLISTED_WORD))
        yield i, spans, far


def rest_costs(value: str, charset: int, prose: bool = False, enough: float = math.inf) -> array[float]:
    """By position: log10 of the guesses that the cheapest segmentation of the rest of ``value`` needs.

    Infinity stands for costs that were not worked out since they are sure to be ``enough`` or more: every way from
    further ahead comes by one of STRIDE positions in a row that cost as much.
    """
    n = len(value)
    letter = math.log10(charset)
    each = array("d", (SEPARATOR if c in SEPARATORS else letter for c in value))
    for m in re.finditer(r"[0-9]{3,}", value):
        each[m.start() : m.end()] = array("d", [1.0]) * (m.end() - m.start())
    best = array("d", [math.inf]) * n
    best.append(0.0)
    in_a_row = 0
    for i, spans, far in _spans_by_start(value, letter, prose):
        cheapest = each[i] + best[i + 1]
        for j, cost in spans:
            cheapest = min(cheapest, cost + NEW_SPAN + best[j])
        best[i] = cheapest
        in_a_row = in_a_row + 1 if cheapest >= enough else 0
        if in_a_row >= STRIDE and not far:
            break
    return best


@lru_cache(maxsize=65_536)
def guess_cost(value: str, prose: bool = False) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` needs."""
    return rest_costs(value, _charset(value), prose)[0]


class _Values:
    """The values that end at one place of a text, asked for from the longest to the shortest.

    Long ones are priced together, whole: one pass from the end gives the cost of every value that has the same kinds of
    characters, so many values in one cost no more than a few passes.
    """

    def __init__(self, text: str, start: int, end: int) -> None:
        self.text, self.end = text, end
        self.last: list[tuple[int, int]] = []  # last place of each kind of characters, and their number
        self.passes: dict[tuple[bool, int], tuple[int, array[float]]] = {}
        if end - start > REMEMBERED:
            back = text[start:end][::-1]
            self.last = [(end - 1 - m.start(), size) for chars, size in CHARSETS if (m := re.search(chars, back))]

    def costly(self, start: int, threshold: float, prose: bool) -> bool:
        """Whether the whole value from ``start`` costs the threshold or more; in prose PROSE_MORE more."""
        enough = threshold + PROSE_MORE * prose
        if self.end - start <= REMEMBERED:
            return guess_cost(self.text[start : self.end], prose) >= enough
        key = prose, sum(size for at, size in self.last if at >= start)
        if key not in self.passes:
            self.passes[key] = start, rest_costs(self.text[start : self.end], key[1], prose, enough)
        first, costs = self.passes[key]
        return costs[start - first] >= enough


def _guesses(text: str, base: list[tuple[int, int]], threshold: float) -> Iterator[tuple[int, int]]:
    """Values in a credential's place that are costly and reach beyond the base spans."""
    merged: list[list[int]] = []
    for a, b in sorted(base):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]
    seen, stop, given = -1, -1, -1
    for m in CONTEXT.finditer(text):
        a = m.start(1)
        if a <= seen or a < given:
            continue
        if a >= stop:  # else it ends with a value that was looked at before
            b = stop = VALUE_END.search(text, a).start()
            while b > a and text[b - 1] in ".:!?)":
                b -= 1
            values = _Values(text, a, b)
        seen = a
        at = bisect_right(starts, a) - 1
        if b - a < 8 or (at >= 0 and b <= merged[at][1]):
            continue
        if ADDRESS.match(text, a, b):
            continue
        if values.costly(a, threshold, PROSE.fullmatch(text, m.end(), a) is not None):
            given = b
            yield a, b


def scan(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by start and then by kind. No text: none."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(k in low for k in _ASSIGN_NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    if any(k in low for k in _CONTEXT_NAMES):
        out += [("guess", a, b) for a, b in _guesses(text, [(a, b) for _, a, b in out], threshold)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span, overlapping ones merged, replaced by ``[secret]``."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256 and spans for every row of ``docs`` (doc_id, text).

    Null and empty texts have no spans. Rows are judged one by one, so repeated rows give repeated results; other
    columns are ignored.
    """
    scratch.prepare(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in batch.column(1):
                spans = scan(t.as_py(), threshold)
                kinds = [s[0] for s in spans]
                for c, v in zip(cols, (*map(kinds.count, KINDS), hashlib.sha256(_joined([s for s in spans if s[0] != "guess"]).encode()).hexdigest(), _joined(spans)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scratch.tidy(run), "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def redact_column(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the secrets of its ``text`` masked; null texts stay null and all other columns stay as they are."""
    scratch.prepare(docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [None if (t := v.as_py()) is None else redact(t, scan(t, threshold)) for v in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(new, batch.column(at).type), *batch.columns[at + 1 :]], schema=batch.schema)

    return docs.mapInArrow(scratch.tidy(run), docs.schema)
