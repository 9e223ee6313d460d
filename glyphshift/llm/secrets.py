"""Secret scans: base patterns, and guess-cost dynamic programming on values in credential contexts.

Three base patterns (assignments, access ids, hex strings) give spans of characters, end exclusive. Beyond them, the
value in each credential context (more key names than the base, authorization headers, passwords in addresses) is priced: the
cheapest way to cut it into dictionary words and their endings, separators, dates, repeats, keyboard walks and brute-force spans
gives the guesses, in powers of ten, that an attacker needs. A value that costs at least `min_guesses` is a span of kind `guess`;
cheap values ("password", "aaaaaaaa", "qwerty123") are placeholders and add none. Nor do values that only refer to a secret
(`${NAME}`, `NAME_OF_WORDS`, calls, indexed names, rooted paths), if words cut the price of the name to three fifths of brute
force or less: a reference needs no guessing. Base spans always stay.

A null or empty text has no spans. Long texts are scanned whole. Of the places where a repeat or walk may begin only those
are kept that can still win, so that long values are priced in about linear time. Repeated rows are scanned each for itself; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glyphshift.llm._shared import id_and_text, map_batches, texts
from glyphshift.llm.bpe import RANKS, read_ranks

#: log10 of the guesses from which on a value counts as a secret.
MIN_GUESSES = 8.0
KINDS = ("assign", "access", "hex", "guess")

# Words that people build passwords of, most frequent first; those of the public vocabulary come after them.
COMMON_WORDS = """password admin welcome login master secret letmein dragon monkey shadow sunshine princess football
baseball superman batman trustno starwars whatever freedom hello charlie jordan hunter ranger buster soccer hockey
killer george michael jennifer thomas robert daniel andrew joshua pepper ginger summer winter spring autumn monday
friday sunday january february march april june july august september october november december love money test user
guest root default change changeme example sample dummy temp demo token pass key api null none true false your my the
here insert replace todo value string name server database""".split()
# Rows of a keyboard, along which fingers walk.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
# Digits and signs that stand for letters.
LEET = str.maketrans("4301$57@", "aeoissta")
# Signs that join words.
SEPARATORS = "_-./"


def any_case(words: str) -> str:
    """A pattern for `words` with ASCII letters in either case and nothing folded beyond ASCII."""
    return "".join(f"[{c.upper()}{c}]" if c.isascii() and c.isalpha() else c for c in words)


VALUE = "[A-Za-z0-9+/_.=-]+"
ASSIGN = re.compile(f"({any_case('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?({VALUE})")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")  # a run that fails the length is followed by no other start in it, so this equals + and a check
CONTEXTS = [
    ASSIGN,
    # The base key names again, with a value of any signs up to the closing quote or white space.
    re.compile(f"({any_case('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?((?<=\")[^\"\\s]+|(?<=')[^'\\s]+|[^\"'\\s]\\S*)"),
    re.compile(f"({any_case('pwd|passphrase|passcode|credential|private_?key|access_?key|auth')})[\"']?\\x20*[:=]\\x20*[\"']?([!-~]+)"),
    re.compile(f"({any_case('authorization')})[\"']?\\x20*[:=]\\x20*[\"']?(?:{any_case('bearer|basic')})\\x20+({VALUE})"),
    re.compile("(?<=[A-Za-z0-9])://([^\\s/:@]+):([^\\s/@]+)@"),
]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start, then kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return in_order(found)


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


@lru_cache(maxsize=1)
def lexicon() -> tuple[dict[str, float], int]:
    """log10 of the guesses for each word, and the longest word's length: the common words, then the words of three letters or
    more in the public vocabulary, by its rank; and pieces of words in it that are no words, such as endings, by their own rank."""
    pieces = [p.decode("utf-8", "replace") for p, _ in sorted(read_ranks(RANKS).items(), key=lambda x: x[1])]
    vocabulary = [w[1:].lower() for w in pieces if w[:1] == " " and len(w) >= 4 and w[1:].isalpha()]
    words = list(dict.fromkeys([*COMMON_WORDS, *vocabulary]))
    endings = dict.fromkeys(w for w in pieces if len(w) >= 4 and w.isalpha() and w.islower())
    costs = {w: math.log10(rank) for rank, w in enumerate(endings, 1)}
    costs |= {w: math.log10(rank) for rank, w in enumerate(words, 1)}
    return costs, max(map(len, costs))


@lru_cache(maxsize=1)
def next_keys() -> set[str]:
    """Pairs of keys that are neighbours on a row, both ways."""
    pairs = {a + b for row in KEY_ROWS for a, b in zip(row, row[1:])}
    return pairs | {p[::-1] for p in pairs}


CENTURY, YEAR, MONTH, DAY, PART = "(?:19|20)", "\\d\\d", "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12]\\d|3[01])", "[-./]?"
#: Years and dates, each of one length at one place, and the guesses that they take.
DATES = [
    (re.compile(CENTURY + YEAR, re.ASCII), 150),
    (re.compile(CENTURY + YEAR + PART + MONTH + PART + DAY, re.ASCII), 150 * 366),
    (re.compile(DAY + PART + MONTH + PART + CENTURY + YEAR, re.ASCII), 150 * 366),
    (re.compile(DAY + PART + MONTH + PART + YEAR, re.ASCII), 150 * 366),
]


def brute_cost(char: str) -> float:
    """log10 of the alphabet that one character is guessed from."""
    if char in SEPARATORS:
        return math.log10(len(SEPARATORS))
    if char.isdigit():
        return 1.0
    if char.isalpha():
        return math.log10(26)
    return math.log10(33) if char.isascii() else 2.0


class Starts:
    """Places where a piece that ends here may begin, whose cost grows by log10 of its length: only those that can still win.
    A place that loses to an earlier one has lost for good, as the later one's lead by length only shrinks."""

    def __init__(self):
        self.places: list[tuple[int, float]] = []

    def least(self, end: int) -> float:
        """The cheapest of the pieces of three characters or more."""
        best, kept = math.inf, []
        for at, cost in self.places:
            if end - at < 3:
                kept.append((at, cost))
            elif (own := cost + math.log10(end - at)) < best:
                best = own
                while kept and kept[-1][1] >= cost:  # earlier and no cheaper to come to
                    kept.pop()
                kept.append((at, cost))
        self.places = kept
        return best


def guess_cost(value: str) -> float:
    """log10 of the guesses for `value` at the cheapest segmentation. best[i] is that of the first i characters."""
    words, longest = lexicon()
    walks, low = next_keys(), value.lower()
    if len(low) != len(value):  # a letter whose small form is longer stays as it is
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    n = len(value)
    best = [0.0] + [math.inf] * n
    repeats, strolls = Starts(), Starts()
    dates: dict[int, list[tuple[int, int]]] = {}
    for start in range(n):
        if value[start].isdigit():
            for pattern, guesses in DATES:
                if m := pattern.match(value, start):
                    dates.setdefault(m.end(), []).append((start, guesses))
    # A piece costs its own guesses, and a little for there being one more piece.
    piece = math.log10(2)
    for end in range(1, n + 1):
        at = end - 1
        if at and low[at] != low[at - 1]:
            repeats = Starts()
        if at and low[at - 1 : end] not in walks:
            strolls = Starts()
        repeats.places.append((at, best[at]))
        strolls.places.append((at, best[at]))
        cost = best[at] + brute_cost(value[at])
        for start in range(max(0, end - longest), end - 2):
            for word, leet in ((low[start:end], False), (plain[start:end], True)):
                if (rank := words.get(word)) is not None and not (leet and word == low[start:end]):
                    cost = min(cost, best[start] + piece + rank + 0.5 * (value[start:end] != low[start:end]) + 0.5 * leet)
        cost = min(cost, repeats.least(end) + piece + brute_cost(value[at]), strolls.least(end) + piece + math.log10(len(KEY_ROWS) * 12))
        for start, guesses in dates.get(end, ()):
            cost = min(cost, best[start] + piece + math.log10(guesses))
        best[end] = cost
    return best[n]


NAME = "[A-Za-z_][A-Za-z0-9_]*"
#: A value that says where a secret stands; group 1 is a name that must be readable, if there is one.
REFERENCES = [
    re.compile(f"{NAME}(?:(?:\\.|::|->){NAME})*[(\\[](?:\"[^\"\\n]*\"|'[^'\\n]*')[^)\\]\\n]*[)\\]]"),  # a key that is read by its name
    re.compile("\\$\\{[^}\\s]*\\}|\\$\\([^)\\n]*\\)|\\{\\{[^}\\n]*\\}\\}"),
    re.compile(f"\\$({NAME})(?![!-~])|%({NAME})%|<([A-Za-z0-9_ .-]+)>"),
    re.compile("([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)(?![!-+/-~])"),
    re.compile(f"({NAME}(?:(?:\\.|::|->){NAME})*)(?:\\([^\\n]*\\)|\\[[^\\n]*\\])"),
    re.compile("((?:~|\\.{1,2})?(?:/[A-Za-z0-9_.-]+)+/?)(?![!-+:-~])"),
]


def readable(name: str) -> bool:
    """Whether words cut the price of a name to three fifths of that by brute force or less."""
    low = name.lower()
    return guess_cost(low) <= 0.6 * sum(map(brute_cost, low))


def refers(text: str, start: int) -> bool:
    """Whether the value that begins here only refers to a secret."""
    for pattern in REFERENCES:
        if m := pattern.match(text, start):
            name = next((g for g in m.groups() if g is not None), None)
            if name is None or readable(name):
                return True
    return False


def guess_spans(text: str, min_guesses: float = MIN_GUESSES) -> list[tuple[int, int, str]]:
    """Values of credential contexts that cost at least `min_guesses`; of those that start at one place the longest."""
    found: dict[int, int] = {}
    for context in CONTEXTS:
        for m in context.finditer(text):
            start, end = m.span(2)
            quoted = text[start - 1] in "\"'" and text[end : end + 1] == text[start - 1]
            value = m[2] if quoted else m[2].rstrip("\"',;.)]}")
            end = start + len(value)
            if len(value) >= 6 and end > found.get(start, 0) and guess_cost(value) >= min_guesses and not refers(text, start):
                found[start] = end
    return [(start, end, "guess") for start, end in sorted(found.items())]


HINTS = ("pass", "secret", "token", "key", "pwd", "credential", "auth", "bearer", "basic", "://")
#: Every byte to 1 if it is a lower-case hex digit, else to 0.
HEX_BYTES = bytes(0x31 if chr(b) in "0123456789abcdef" else 0x30 for b in range(256))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_spans(text: str, min_guesses: float = MIN_GUESSES) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans."""
    low = text.lower()
    hinted = any(h in low for h in HINTS)
    if not hinted and "AKIA" not in text and b"1" * 24 not in text.encode().translate(HEX_BYTES):
        return [], []
    base = base_spans(text)
    return base, in_order(base + guess_spans(text, min_guesses)) if hinted else base


def scan(docs: DataFrame, min_guesses: float = MIN_GUESSES) -> DataFrame:
    """doc_id and spans: an array of (kind, start, end)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        found = [[{"kind": k, "start": a, "end": b} for a, b, k in find_spans(t, min_guesses)[1]] for t in texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return map_batches(id_and_text(docs), work, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, mark: str = "[secret]", min_guesses: float = MIN_GUESSES) -> DataFrame:
    """`docs`, all columns, with each span (overlapping ones together) replaced by `mark`."""

    def hide(text: str) -> str:
        out, at = [], 0
        for start, end, _ in find_spans(text, min_guesses)[1]:
            if end <= at:
                continue
            if start >= at:
                out += [text[at:start], mark]
            at = end
        return "".join(out) + text[at:]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hidden = pa.array([t if t is None else hide(t) for t in batch.column("text").to_pylist()], batch.column("text").type)
        return batch.set_column(batch.schema.get_field_index("text"), "text", hidden)

    return map_batches(docs, work, docs.schema)


def report(docs: DataFrame, min_guesses: float = MIN_GUESSES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (joined as kind:start:end), n_guess."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spans = np.zeros((batch.num_rows, len(KINDS)), dtype=np.int64), [], []
        for i, text in enumerate(texts(batch)):
            base, every = find_spans(text, min_guesses)
            for _, _, kind in every:
                counts[i, KINDS.index(kind)] += 1
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(every))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(3)), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(counts[:, 3])],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"],
        )

    return map_batches(id_and_text(docs), work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")
