"""Secret scans: three base patterns, and values in a credential context
whose guess cost is high.

The guess cost of a value is the cheapest way to split it into dictionary
words, dates, repeats, keyboard walks and brute-force characters, found by
dynamic programming over its characters (log10 of guesses).  The dictionary
holds common words of passwords and the most frequent words of the corpus, by
rank.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import task

# The base patterns and their least lengths.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS, ACCESS_CHARS = 12, 18

# Words before a value in a credential context, and common words of passwords.
_CONTEXT = re.compile(
    r"""(?:
        (?:passphrase|passcode|password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|credentials?|bearer)
        ["']?[\x20\t]*(?:[:=]|[\x20\t]is[\x20\t])[\x20\t]*
      | authorization["']?[\x20\t]*[:=][\x20\t]*["']?bearer[\x20\t]+
      | \bbearer[\x20\t]+(?!(?-i:[A-Z]?[a-z]+)[^\w\s]*(?:\s|$))    # without the header's name, not before a plain word
    )
    (?:"(?P<double>[^\s"]{6,})" | '(?P<single>[^\s']{6,})'
      | ["']?(?P<bare>(?:[^\s"'<>,;&|]
          | [,;&|](?=[^\s"'<>,;&|])(?!(?:amp;)?[a-z_][\w.-]{0,40}["']?[\x20\t]*[:=])    # not before the next key
          | [<>](?=[^\s"'<>a-z/!?])){6,}))                                               # not a tag
    """,
    re.IGNORECASE | re.ASCII | re.VERBOSE,
)
_CUES = ("pass", "pwd", "secret", "token", "key", "credential", "bearer")
WORDS = (
    "password pass admin root user login welcome letmein master secret test demo example sample changeme default guest hello love monkey dragon shadow "
    "sunshine princess football baseball soccer hockey summer winter spring autumn monday friday january december money flower freedom whatever trust "
    "super star hunter ranger thomas michael jennifer jordan robert daniel andrew joshua matthew george charlie computer internet server database "
    "access token key value string true false null none your my the this that here xxxx todo placeholder redacted company office house home"
).split()
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "1qaz2wsx3edc4rfv5tgb6yhn7ujm")
LEET = str.maketrans("013457@$!", "oleastasi")

LEAST_COST = 8.0  # log10 of guesses from which a context value is a secret
_RANK = {w: math.log10(i + 2) for i, w in enumerate(dict.fromkeys(WORDS))}
DICTIONARY = 5000  # words of the corpus in the dictionary, at most
LEAST_DOCS = 5  # documents that such a word stands in
LONGEST = 20  # letters of such a word
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d")
PART_COST = 0.2  # of choosing how many parts there are
_KEYS = sum(len(r) for r in KEYBOARD)


def _date_cost(date: str) -> float:
    """A whole date, a year, or a day and month."""
    if len(date) == 4:
        return math.log10(120) if date.startswith(("19", "20")) else math.log10(365)
    return math.log10(365 * 120)


def _char_cost(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() and c.isascii() else math.log10(33) if c.isascii() else 2.0


def _walk(text: str, i: int) -> int:
    """End of the longest keyboard walk from i, either direction."""
    best = i + 1
    for row in KEYBOARD:
        at = row.find(text[i])
        for step in (1, -1) if at >= 0 else ():
            j, p = i + 1, at + step
            while j < len(text) and 0 <= p < len(row) and text[j] == row[p]:
                j, p = j + 1, p + step
            best = max(best, j)
    return best


def corpus_words(docs: DataFrame, *, text: str = "text", most: int = DICTIONARY, least_docs: int = LEAST_DOCS) -> list[str]:
    """The ``most`` lower-case words of 3 to ``LONGEST`` letters a-z that
    stand, between blanks and marks, in most texts (``least_docs`` at least),
    most frequent first, ties by word.  Repeated rows count each."""
    found = F.array_distinct(F.expr(f"regexp_extract_all(`{text}`, '(?<![^ \\t\\n\\r])[a-z]{{3,{LONGEST}}}+(?=[.,;!?]?(?:[ \\t\\n\\r]|$))', 0)"))
    words = docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_docs)
    return [r.word for r in words.orderBy(F.desc("n"), "word").limit(most).collect()]


def ranked(words: list[str]) -> dict[str, float]:
    """log10 of the guesses of the fixed words and of these, by rank."""
    out = {w: math.log10(i + 2) for i, w in enumerate(words)}
    return out | {w: min(cost, out.get(w, cost)) for w, cost in _RANK.items()}


def guess_cost(value: str, rank: dict[str, float] = _RANK) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of guesses of the cheapest segmentation, and its parts
    ``(kind, start, end)``.  Each part after the first costs ``PART_COST``;
    neighbouring brute-force characters are one part."""
    n, low = len(value), value.lower()
    if len(low) != n:
        low = value
    plain = low.translate(LEET)
    # cheapest way to each place, by whether its last part is brute force
    best = [[math.inf, math.inf] for _ in range(n + 1)]
    came: list[list] = [[None, None] for _ in range(n + 1)]
    best[0][0] = -PART_COST if n else 0.0

    def offer(i: int, j: int, cost: float, kind: str) -> None:
        brute = int(kind == "brute")
        for last in (0, 1):
            total = best[i][last] + cost + (0.0 if brute and last else PART_COST)
            if total < best[j][brute]:
                best[j][brute], came[j][brute] = total, (kind, i, last)

    repeat_end, stop = 0, [0] * 5
    for i in range(n):
        offer(i, i + 1, _char_cost(value[i]), "brute")
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            cost = rank.get(plain[i:j])
            if cost is not None:
                odd = sum(a != b for a, b in zip(value[i:j], plain[i:j], strict=True))
                offer(i, j, cost + 0.3 + 0.3 * min(odd, 4), "word")
        if date := _DATE.match(value, i):
            offer(i, date.end(), _date_cost(date[0]), "date")
        if (j := _walk(low, i)) - i >= 3:
            offer(i, j, math.log10(2 * _KEYS) + math.log10(j - i), "walk")
        if i >= repeat_end:
            for size in (1, 2, 3, 4):
                k = max(stop[size], i)  # first place that differs from the one size on
                while k + size < n and value[k] == value[k + size]:
                    k += 1
                stop[size] = k
                j = i + (k + size - i) // size * size
                if j <= n and j - i >= max(3, 2 * size):
                    offer(i, j, sum(map(_char_cost, value[i : i + size])) + math.log10((j - i) // size), "repeat")
                    if size == 1:
                        repeat_end = j - 1
    parts, j, last = [], n, int(best[n][1] < best[n][0])
    total = best[n][last]
    while j:
        kind, i, before = came[j][last]
        if parts and kind == "brute" and parts[-1][0] == "brute":
            parts[-1] = ("brute", i, parts[-1][2])
        else:
            parts.append((kind, i, j))
        j, last = i, before
    return total, parts[::-1]


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, kind's rank, kind, end) of the base patterns."""
    out = []
    low = text.lower() if (":" in text or "=" in text) else ""
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(m.start(), 1, "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    out += [(m.start(), 2, "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def context_values(text: str) -> list[tuple[int, int]]:
    """(start, end) of the values in a credential context."""
    low = text.lower()
    if not any(c in low for c in _CUES):
        return []
    out = []
    for m in _CONTEXT.finditer(text):
        a, e = m.span(m.lastgroup)
        if m.lastgroup == "bare":
            e = a + len(m["bare"].rstrip(".)]}"))
        if e - a >= 6:
            out.append((a, e))
    return out


def scored_values(text: str, rank: dict[str, float] = _RANK) -> list[tuple[int, int, float]]:
    """(start, end, guess cost) of the values in a credential context."""
    return [(a, e, guess_cost(text[a:e], rank)[0]) for a, e in context_values(text)]


def costly_spans(scored: list, base: list, least: float = LEAST_COST) -> list[tuple[int, int, str, int]]:
    """Scored values that cost at least ``least`` to guess and that no single
    base span covers whole."""
    costly = [(a, e) for a, e, cost in scored if cost >= least]
    return [(a, 3, "guess", e) for a, e in costly if not any(s <= a and e <= x for s, _, _, x in base)]


def _joined(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{e}" for a, _, kind, e in spans)


def _scan(text: str, least: float, sent):
    @task
    def run(batches):
        rank = sent.value
        for batch in batches:
            rows = []
            for value in batch.column(batch.schema.get_field_index(text)):
                whole = value.as_py() or ""
                base = base_spans(whole)
                n = [sum(k == kind for _, _, k, _ in base) for kind in ("assign", "access", "hex")]
                scored = scored_values(whole, rank)
                costs = ",".join(f"{a}:{e}:{cost:.2f}" for a, e, cost in scored)
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + costly_spans(scored, base, least))), costs))
            keep = [c for c in batch.schema.names if c != text]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            cols += [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "costs"])

    return run


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_cost: float = LEAST_COST, words: list[str] | None = None) -> DataFrame:
    """One row per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans,
    costs (start:end:cost of every value in a credential context, cost being
    log10 of guesses, also of those that a base span covers).

    Null text counts as empty and has no spans; repeated rows each get their
    row; other columns are ignored.  Spans are matches of the base patterns,
    leftmost and not overlapping within a kind, and ``guess`` spans: a whole
    value alone, also where base spans cover parts of it.  Values of any length
    are scored whole.  ``words`` are the corpus's words of the dictionary, most
    frequent first; if None, they are counted in ``docs``.  An empty table
    gives an empty one.
    """
    base = docs.select(doc_id, text)
    rank = ranked(corpus_words(docs, text=text) if words is None else words)
    sent = docs.sparkSession.sparkContext.broadcast(rank)  # DICTIONARY words and the fixed ones
    kind = base.schema[doc_id].dataType.simpleString()
    return base.mapInArrow(_scan(text, least_cost, sent), f"`{doc_id}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, costs string")
