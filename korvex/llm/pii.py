"""Personal data: fixed base patterns, and spans added by a semi-Markov conditional random field.

Base spans are the leftmost, non-overlapping matches of four patterns, each match checked and dropped if it fails
(:func:`base_spans`). The field then reads windows of tokens around places that could hold personal data in another
spelling ("(988) 555-2485", "jo at mail dot com", "4111.1111.1111.1111"). Candidate segments of at most ``MAX_TOKENS``
tokens get features of the whole span and of its neighbours; weights score (segment, type), and a dynamic programme over
positions and bounded segment lengths picks boundaries and types together. Decoded spans that overlap no base span are
added; base spans always stay.

The field is trained here, by gradient ascent on the segment-level likelihood, on sentences made up by a seeded
generator: entities in many spellings among numbers that are none (dates, versions, prices, hex strings, failing cards).

Defined cases: null and empty texts have no spans; rows that repeat are each answered; an empty table gives no rows;
extra columns are ignored; texts of any length are read whole, and windows bound the memory of decoding.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

KINDS = ["email", "ip", "card", "phone"]
MAX_TOKENS = 14
CONTEXT = 3
MAX_WINDOW = 160

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The same matches as without the lookbehind and possessive marks, without their backtracking.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) in the order of kinds, then of starts."""
    out: list[Span] = []
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start():
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


# --- the field -------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
_CUES = {
    "phone": {"tel", "phone", "call", "mobile", "cell", "fax", "telephone"},
    "email": {"mail", "email", "e", "contact", "write", "correo"},
    "card": {"card", "visa", "mastercard", "credit", "payment"},
    "ip": {"ip", "host", "address", "server", "addr"},
}
_DOMAIN_ENDS = {"com", "org", "net", "edu", "info", "io", "de", "fr", "es", "uk", "example"}
FEATURES = [
    "one", "tokens_1", "tokens_2_4", "tokens_5_8", "tokens_9",
    "digits_0", "digits_1_6", "digits_7", "digits_8_9", "digits_10", "digits_11_15", "digits_16_19", "digits_20",
    "luhn", "luhn_fails", "groups_1", "groups_2", "groups_3", "groups_4", "groups_5", "four_bytes", "fours",
    "plus", "bracket_pair", "bracket_odd", "dashes", "dots", "slashes", "other_signs", "at_sign", "at_word",
    "dot_word", "domain_end", "letters", "only_digits", "starts_word", "starts_digit", "ends_digit", "ends_word",
    "glued_left", "glued_right", "number_left", "number_right", "cue_phone", "cue_email", "cue_card", "cue_ip",
    "groups_334", "groups_34", "one_separator", "mixed_separators", "dateish", "sign_left", "sign_right", "spaced_letters", "whole_address", "currency_left",
]
_INDEX = {f: i for i, f in enumerate(FEATURES)}


def tokens_of(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    return [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]


def _is_at(tokens, k: int) -> bool:
    return tokens[k][0].lower() in ("at", "arroba")


def segment_features(tokens, i: int, j: int) -> list[int]:
    """Of the span of tokens i .. j-1 among ``tokens``: indices of the features that hold."""
    own = tokens[i:j]
    words = [t for t, _, _ in own]
    text_digits = "".join(t for t in words if t.isdigit() and t.isascii())
    groups = [len(t) for t in words if t.isdigit() and t.isascii()]
    n, d, lowered = j - i, len(text_digits), [t.lower() for t in words]
    on = ["one", "tokens_1" if n == 1 else "tokens_2_4" if n < 5 else "tokens_5_8" if n < 9 else "tokens_9"]
    on.append(
        "digits_0" if not d else "digits_1_6" if d < 7 else "digits_7" if d == 7 else "digits_8_9" if d < 10
        else "digits_10" if d == 10 else "digits_11_15" if d < 16 else "digits_16_19" if d < 20 else "digits_20"
    )
    if 16 <= d <= 19:
        on.append("luhn" if luhn(text_digits) else "luhn_fails")
    if groups:
        on.append(f"groups_{min(len(groups), 5)}")
    if len(groups) == 4 and max(groups) <= 3 and all(int(t) <= 255 for t in words if t.isdigit() and t.isascii()):
        on.append("four_bytes")
    if len(groups) == 4 and set(groups) == {4}:
        on.append("fours")
    if groups[-3:] == [3, 3, 4]:
        on.append("groups_334")
    elif groups == [3, 4]:
        on.append("groups_34")
    if groups in ([4, 2, 2], [2, 2, 4], [1, 2, 4], [2, 1, 4], [1, 1, 4]):
        on.append("dateish")
    signs = [t for t in words if not t[0].isalnum()]
    if len(groups) > 1 and len(groups) + len(signs) == n:
        gaps = {a[2] < b[1] for a, b in zip(own, own[1:], strict=False)}
        on.append("one_separator" if len(set(signs)) <= 1 and (not signs or len(gaps) == 1) else "mixed_separators")
    for name, sign in (("plus", "+"), ("dashes", "-"), ("dots", "."), ("slashes", "/"), ("at_sign", "@")):
        if sign in signs:
            on.append(name)
    if "(" in signs or ")" in signs or "[" in signs or "]" in signs:
        even = signs.count("(") == signs.count(")") and signs.count("[") == signs.count("]")
        on.append("bracket_pair" if even else "bracket_odd")
    if any(s not in "+-./@()[]" for s in signs):
        on.append("other_signs")
    letters = [t for t in lowered if t[0].isalpha()]
    at = [k for k in range(i, j) if _is_at(tokens, k)]
    if at:
        on.append("at_word")
    if "dot" in letters or "punto" in letters:
        on.append("dot_word")
    if lowered[-1] in _DOMAIN_ENDS:
        on.append("domain_end")
        if ("@" in signs or len(at) == 1) and lowered[0] not in ("at", "dot", "@") and n >= 4:
            plain = [t for t in lowered if t[0].isalpha() and t not in ("at", "dot", "arroba", "punto")]
            on.append("whole_address" if 3 <= len(plain) <= 6 and not _bare_gap(own) else "spaced_letters")
    if letters:
        on.append("letters")
    else:
        on.append("only_digits")
    on.append("starts_word" if own[0][0][0].isalpha() else "starts_digit" if own[0][0][0].isdigit() else "one")
    on.append("ends_digit" if own[-1][0][-1].isdigit() else "ends_word" if own[-1][0][-1].isalpha() else "one")
    if i:
        before = tokens[i - 1]
        if before[2] == own[0][1]:
            on.append("glued_left" if before[0][-1].isalnum() else "sign_left")
        if before[0].isdigit():
            on.append("number_left")
        if before[0] in "$€£%#":
            on.append("currency_left")
        for cue, names in _CUES.items():
            if any(t[0].lower() in names for t in tokens[max(0, i - 3) : i]):
                on.append(f"cue_{cue}")
    if j < len(tokens):
        after = tokens[j]
        if after[1] == own[-1][2]:
            on.append("glued_right" if after[0][0].isalnum() else "sign_right")
        if after[0].isdigit():
            on.append("number_right")
    return sorted({_INDEX[f] for f in on})


def _bare_gap(own) -> bool:
    """Whether two plain words of a span stand side by side, only a space between them."""
    joints = ("at", "dot", "arroba", "punto")
    return any(
        a[0][0].isalpha() and b[0][0].isalpha() and a[0].lower() not in joints and b[0].lower() not in joints and a[2] < b[1]
        for a, b in zip(own, own[1:], strict=False)
    )


_NEVER_WITHIN = frozenset(",;:!?\"'|<>=*&#$%{}")


def lattice(tokens, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate segments: starts, ends, and their features as a matrix. A segment begins and ends at a token that is
    a letter run or a digit run; a plus or an opening bracket before digits may begin one. Only segments that begin at
    tokens first .. last - 1 are made."""
    starts, ends, rows = [], [], []
    for i in range(first, len(tokens) if last is None else min(last, len(tokens))):
        opens = tokens[i][0] in "+(" and i + 1 < len(tokens) and (tokens[i + 1][0].isdigit() or tokens[i + 1][0] == "+")
        if not (tokens[i][0][0].isalnum() or opens):
            continue
        digits = marks = 0
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            t = tokens[j - 1][0]
            if t in _NEVER_WITHIN:
                break
            digits += len(t) * t.isdigit()
            marks += t == "@" or _is_at(tokens, j - 1)
            if not (digits >= 4 or marks) or not (t[-1].isalnum()):
                continue
            starts.append(i)
            ends.append(j)
            rows.append(segment_features(tokens, i, j))
    matrix = np.zeros((len(rows), len(FEATURES)))
    for r, on in enumerate(rows):
        matrix[r, on] = 1
    return np.array(starts, np.int64), np.array(ends, np.int64), matrix


def _forward(n: int, starts, ends, scores) -> np.ndarray:
    """log of the total weight of all segmentations of each prefix; tokens outside segments weigh 1."""
    alpha = np.full(n + 1, -np.inf)
    alpha[0] = 0
    by_end: dict[int, list[int]] = {}
    for s, e in enumerate(ends):
        by_end.setdefault(int(e), []).append(s)
    for p in range(1, n + 1):
        terms = [alpha[p - 1]]
        for s in by_end.get(p, ()):
            terms += [alpha[starts[s]] + v for v in scores[s]]
        top = max(terms)
        alpha[p] = top + np.log(sum(np.exp(t - top) for t in terms))
    return alpha


def marginals(n: int, starts, ends, scores) -> np.ndarray:
    """Probability of every (segment, type)."""
    alpha = _forward(n, starts, ends, scores)
    beta = _forward(n, n - ends, n - starts, scores)[::-1]
    return np.exp(alpha[starts][:, None] + scores + beta[ends][:, None] - alpha[n])


def decode(n: int, starts, ends, scores) -> list[tuple[int, int]]:
    """(segment, type) of the best segmentation."""
    best, back = np.zeros(n + 1), [None] * (n + 1)
    by_end: dict[int, list[int]] = {}
    for s, e in enumerate(ends):
        by_end.setdefault(int(e), []).append(s)
    for p in range(1, n + 1):
        best[p] = best[p - 1]
        for s in by_end.get(p, ()):
            k = int(np.argmax(scores[s]))
            if (v := best[starts[s]] + scores[s][k]) > best[p]:
                best[p], back[p] = v, (s, k)
    out, p = [], n
    while p > 0:
        if back[p] is None:
            p -= 1
        else:
            out.append(back[p])
            p = int(starts[back[p][0]])
    return out[::-1]


def _made_up(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A sentence and its entities (kind, start, end)."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    syllables = ["an", "the", "re", "on", "ti", "mo", "le", "ver", "que", "ein", "ou", "ra", "sh", "ent", "as"]
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
    number = lambda n: "".join(str(int(rng.integers(10))) for _ in range(n))

    def card(valid: bool) -> str:
        body = pick("45") + number(14)
        check = next(c for c in "0123456789" if luhn(body + c) == valid)
        return body + check

    def entity() -> tuple[int, str]:
        kind = int(rng.integers(4))
        if kind == 0:
            user, host, end = word(), word(), pick(["com", "org", "net", "de", "fr", "es", "info"])
            at, dot = pick([" at ", " [at] ", " (at) ", "@", " @ ", "[at]", "(at)"]), pick([" dot ", " [dot] ", ".", " (dot) "])
            user += pick(["", "", "." + number(2), number(2), pick([".", "_"]) + word()])
            host = pick([host, host, f"mail{rng.integers(1, 10)}{dot}example", word() + dot + word()])
            return 0, user + at + host + dot + end
        if kind == 1:
            sep = pick([".", ".", " . ", "[.]"])
            return 1, sep.join(str(int(rng.integers(1, 256))) for _ in range(4))
        if kind == 2:
            c = card(True)
            sep = pick(["", " ", "-", ".", "  ", " - "])
            return 2, sep.join(c[k : k + 4] for k in range(0, 16, 4))
        area, a, b = str(int(rng.integers(200, 990))), number(3), number(4)
        return 3, pick(["+1 ({}) {}-{}", "({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "+1 {} {} {}", "1-{}-{}-{}", "({}){}-{}"]).format(area, a, b)

    def other() -> str:
        return pick([
            lambda: number(int(rng.integers(1, 7))), lambda: f"{rng.integers(1900, 2100)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}",
            lambda: f"{rng.integers(1, 9)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}", lambda: card(False),
            lambda: f"$ {rng.integers(1, 999)}.{number(2)}", lambda: hashlib.md5(word().encode()).hexdigest(),
            lambda: f"{number(3)}.{rng.integers(300, 999)}.{number(3)}.{rng.integers(300, 999)}", lambda: f"{rng.integers(10, 24)}:{number(2)}:{number(2)}",
            lambda: number(int(rng.integers(8, 16))), lambda: "at " + word() + " dot", lambda: f"{word()} at {word()} {word()}",
            lambda: f"{word()} at {rng.integers(10, 9999)} {word()}", lambda: f"{number(3)} {number(3)} {number(3)} {number(3)}", lambda: "@" + word(),
            lambda: f"{number(1)},{number(3)},{number(3)}", lambda: f"{word()} at the {word()}. {word().title()}", lambda: f"{rng.integers(1, 28)}/{rng.integers(1, 12)}/{rng.integers(1990, 2030)}",
        ])()

    text, gold = "", []
    for _ in range(int(rng.integers(2, 6))):
        text += " ".join(word() for _ in range(int(rng.integers(1, 5)))) + " "
        if rng.random() < 0.5:
            kind, span = entity()
            if rng.random() < 0.2:
                text += pick(["tel ", "phone: ", "mail ", "card ", "ip ", "call "])
            gold.append((kind, len(text), len(text) + len(span)))
            text += span + pick([" ", ", ", ". ", " "])
        else:
            text += other() + " "
    return text + word(), gold


@lru_cache(maxsize=1)
def trained_weights(sentences: int = 300, epochs: int = 10, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Weights (feature, kind), by gradient ascent with per-weight step sizes; the same in every process."""
    rng = np.random.default_rng(11)
    data = []
    for _ in range(sentences):
        text, gold = _made_up(rng)
        tokens = tokens_of(text, 0, len(text))
        starts, ends, x = lattice(tokens)
        if not len(starts):
            continue
        target = np.zeros((len(starts), len(KINDS)))
        places = {(tokens[s][1], tokens[e - 1][2]): k for k, (s, e) in enumerate(zip(starts, ends, strict=True))}
        for kind, a, b in gold:
            if (a, b) in places:
                target[places[a, b], kind] = 1
        data.append((len(tokens), starts, ends, x, target))
    w, squares = np.zeros((len(FEATURES), len(KINDS))), np.full((len(FEATURES), len(KINDS)), 1e-2)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            n, starts, ends, x, target = data[k]
            gradient = x.T @ (target - marginals(n, starts, ends, x @ w)) - decay * w
            squares += gradient**2
            w += rate * gradient / np.sqrt(squares)
    return w


#: Where the field looks: wherever a segment can hold four digits, and at written-out or spaced addresses.
_DIGIT_TOKEN = re.compile(r"[0-9]+|[\d\u00b2\u00b3\u00b9\u2070-\u2079\u2080-\u2089]")
_BREAK = re.compile("[" + re.escape("".join(sorted(_NEVER_WITHIN))) + "]")
_WRITTEN = re.compile(r"@|[\[(]\s?at\s?[\])]|\b(?:at|arroba)\b(?=\s+\w+\s*(?:dot|punto|\.|[\[(]\s?dot)\b)", re.IGNORECASE)


def digit_spots(text: str) -> list[tuple[int, int]]:
    """From each digit run to the last one that a segment from there can reach, if they hold four digits or more."""
    runs = [(m.start(), m.end()) for m in _DIGIT_TOKEN.finditer(text)]
    steps = []  # tokens from a run to the next, too many if no segment holds both
    for (_, a), (b, _) in zip(runs, runs[1:], strict=False):
        apart = _BREAK.search(text, a, b) is not None
        steps.append(MAX_TOKENS if apart else 1 + sum(1 for _ in islice(_TOKEN.finditer(text, a, b), MAX_TOKENS)))
    out = []
    for i, (start, end) in enumerate(runs):
        digits, used, j = end - start, 1, i
        while j < len(steps) and used + steps[j] <= MAX_TOKENS:
            used += steps[j]
            j += 1
            digits += runs[j][1] - runs[j][0]
        if digits >= 4:
            out.append((start, runs[j][1]))
    return out


def windows(text: str) -> list[tuple[int, int]]:
    """Disjoint stretches of the text that the field decodes, cut at white space."""
    spots = digit_spots(text)
    if "@" in text or "at" in text.lower() or "arroba" in text.lower():
        spots += [(m.start(), m.end()) for m in _WRITTEN.finditer(text)]
    out: list[list[int]] = []
    for a, b in sorted(spots):
        a, b = max(0, a - 40), min(len(text), b + 40)
        while a > 0 and b - a < 400 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and b - a < 400 and not text[b].isspace():
            b += 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def added_spans(text: str, base: list[Span], weights: np.ndarray, margin: float = 1.0) -> list[Span]:
    """Spans that the field finds beside the base ones. A window is decoded as a whole; its lattice is scored
    ``MAX_WINDOW`` beginnings at a time, so features of long windows are not held at once."""
    out: list[Span] = []
    taken = sorted((a, b) for _, a, b in base)
    for a, b in windows(text):
        tokens = tokens_of(text, a, b)
        parts = []
        for k in range(0, len(tokens), MAX_WINDOW):
            starts, ends, x = lattice(tokens, k, k + MAX_WINDOW)
            parts.append((starts, ends, x @ weights - margin))
        if not parts:
            continue
        starts, ends, scores = (np.concatenate(p) for p in zip(*parts, strict=True))
        for s, kind in decode(len(tokens), starts, ends, scores):
            span = (tokens[starts[s]][1], tokens[ends[s] - 1][2])
            if not any(p < span[1] and span[0] < q for p, q in taken):
                out.append((kind, *span))
    return out


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added)."""
    weights = trained_weights()
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                value = text.as_py()
                base = base_spans(value)
                spans = sorted(base + added_spans(value, base, weights))
                counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(work, schema)
