"""Personal data (operator 10): base formats, and further spans chosen by boosted trees among overlapping candidates.

Base spans follow fixed formats and always stay.  High-recall generators then propose spans that the formats miss
(spelled-out addresses, colon-grouped IP addresses, national phone numbers, card numbers among other numbers or with
other separators, keys and tokens), which may overlap.  Boosted trees score each from its format and the words around
it; a threshold for each kind, calibrated to a precision, selects; of overlapping spans the higher score stays, and
none may touch a base span.

The trees are fitted on the driver to sentences that this module makes up from a seed (no personal data is labelled in
the tables); ``examples`` is the documented bound of that sample.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import BoostedTrees
from .common import kept_columns, kept_texts, unkept

KINDS = ("email", "ip", "card", "phone")
#: In the order in which spans are listed; a secret has no base format.
EVERY = (*KINDS, "secret")
EXAMPLES, SEED, PRECISION = 8000, 7, 0.98

# ---- base formats ---------------------------------------------------------------------------------------------------
# A match that starts inside a run of digits has a match that starts with the run, so looking behind saves the
# quadratic search in long runs and changes nothing.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the longest local part before it (not into the last match) and a dotted domain after it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the base formats, leftmost without overlap for each kind, by kind and start."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) < 4 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


# ---- candidates -----------------------------------------------------------------------------------------------------
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}+[\x20]?[\[({<]?[\x20]?(?:at|AT|@)[\x20]?[\])}>]?[\x20]?[A-Za-z0-9-]{1,63}+(?:[\x20]?[\[({<]?[\x20]?(?:dot|DOT|\.)[\x20]?[\])}>]?[\x20]?[A-Za-z0-9-]{2,63}+){1,4}")
_COLONS = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_GROUPS = re.compile(r"(?<![0-9])[(]?[0-9][0-9().\x20/_ ‐-—-]{5,30}[0-9](?![0-9])")
_RUN = re.compile("[0-9]+")
_BETWEEN = re.compile(r"[\x20\t./_ ‐-—-]{1,2}")
_KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=-])")
_MIXED = re.compile(r"[A-Za-z][^0-9]*[0-9]|[0-9][^A-Za-z]*[A-Za-z]")
_AT = re.compile(r"(?:\b|[\[({<])(?:at|AT)(?:\b|[\])}>])")
_WORD = re.compile(r"[^\W\d_]+")
CUES = {
    "email": frozenset("email mail contact write reach address correo courriel".split()),
    "ip": frozenset("ip ipv server host address client gateway from login".split()),
    "card": frozenset("card credit debit visa mastercard payment pay account karte carte tarjeta".split()),
    "phone": frozenset("phone call tel telephone mobile fax cell telefon ring sms dial telefono".split()),
    "secret": frozenset("token secret key apikey password passwd pwd passphrase bearer authorization auth credential credentials private access".split()),
}
AGAINST = frozenset("version order isbn page section date price total id serial build invoice issue chapter item ratio score commit checksum sha md5 digest hash uuid etag revision".split())
AROUND = 40


def _cards(text: str) -> list[tuple[int, int]]:
    """Every row of whole digit groups, with one or two separators between them, of 13 to 19 digits that pass Luhn; single digits are no group."""
    out, row = [], []
    for m in _RUN.finditer(text):
        a, b = m.span()
        if row and not (a - row[-1][1] <= 2 and _BETWEEN.fullmatch(text, row[-1][1], a)):
            row = []
        if not 2 <= b - a <= 19:
            row = []
            continue
        row = [*row[-8:], (a, b)]
        digits = ""
        for start, end in reversed(row):  # what ends here
            digits = text[start:end] + digits
            if len(digits) > 19:
                break
            if len(digits) >= 13 and luhn(digits):
                out.append((start, b))
    return out


def candidates(text: str) -> list[Span]:
    """Proposed spans, which may overlap each other."""
    out: list[Span] = []
    if _AT.search(text) or "@" in text:
        for m in _SPELLED.finditer(text):
            if re.search(r"[\[({<]|\bdot\b|\bDOT\b|@", m[0]):
                out.append(("email", *m.span()))
    if ":" in text:
        out += [("ip", *m.span()) for m in _COLONS.finditer(text)]
    if _DIGIT.search(text):
        out += [("phone", *m.span()) for m in _GROUPS.finditer(text) if 7 <= len(digits_of(m[0])) <= 15]
        out += [("card", a, b) for a, b in _cards(text)]
        out += [("secret", *m.span()) for m in _KEY.finditer(text) if _MIXED.search(m[0])]
    return out


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, start, end = span
    s = text[start : min(end, start + 256)]
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND // 2]
    left = [w.lower() for w in _WORD.findall(before)]
    words = set(left) | {w.lower() for w in _WORD.findall(after)}
    digits = digits_of(s)
    groups = _RUN.findall(s)
    letters = [c for c in s if c.isalpha()]
    near = before[-4:]
    return [
        float(EVERY.index(kind)),
        float(end - start),
        float(len(digits)),
        len(digits) / len(s),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        float(len(set(digits))),
        float(luhn(digits)) if digits else -1.0,
        float(s.count("-")),
        float(s.count(".")),
        float(s.count(" ")),
        float("(" in s),
        float(s.count(":")),
        float("@" in s),
        float(bool(re.search(r"[\[({<]\s?(?:at|AT|@)", s))),
        float(bool(re.search(r"\b(?:dot|DOT)\b", s))),
        float(bool(re.search(r"[a-fA-F]", s))) if kind == "ip" else -1.0,
        float(any(w in CUES[kind] for w in left[-6:])),
        float(len(words & CUES[kind])),
        float(len(words & AGAINST)),
        float(any(w in AGAINST for w in left[-2:])),
        float(start > 0 and text[start - 1].isalnum()),
        float(end < len(text) and text[end].isalnum()),
        float(start > 0 and text[start - 1] in "#$=.:/-_"),
        float(len(groups[0])) if groups else 0.0,
        float(len(groups[-1])) if groups else 0.0,
        float(digits[:1] or -1),
        float(any(w in CUES[kind] for w in left[-1:])),
        float("=" in near or ":" in near),
        float(near[-1:] in "\"'") if near else 0.0,
        float(all(c in "0123456789abcdefABCDEF" for c in s)) if kind == "secret" else -1.0,
        float(len(set(s))),
        float(sum(map(str.isupper, letters)) / len(letters)) if letters else -1.0,
        float(s.count("/") + s.count("_")),
    ]


def _card(r: random.Random) -> str:
    """A number as cards have it: a known first digit, 15 or 16 digits, Luhn."""
    head, n = r.choice((("4", 16), ("5", 16), ("2", 16), ("34", 15), ("37", 15), ("6011", 16)))
    body = head + "".join(r.choice("0123456789") for _ in range(n - 1 - len(head)))
    return next(body + c for c in "0123456789" if luhn(body + c))


def _made_up(r: random.Random) -> tuple[str, list[tuple[int, int]], bool]:
    """A sentence, where its values are, and whether they are personal data."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(2, 9)))
    of = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    kind, personal, link = r.choice(EVERY), r.random() < 0.5, " "
    values: list[str] = []
    if kind == "email":
        a, b = r.choice(((" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), ("(at)", "."), (" @ ", ".")))
        values = [f"{w()}{r.choice(('.', '_', ''))}{w()}{a}{w()}{b}{w() + b if r.random() < 0.3 else ''}{r.choice(('com', 'org', 'net', 'de', 'example'))}" if personal else f"{w()} at {w()} {r.choice(('dot', '.'))} {w()}"]
    elif kind == "ip":
        h = lambda: f"{r.getrandbits(16):x}"
        values = [r.choice((":".join(h() for _ in range(8)), f"{h()}:{h()}::{h()}", f"2001:db8::{h()}:{h()}")) if personal else r.choice((f"{d(2)}:{d(2)}:{d(2)}", f"{d(1)}:{d(2)}:{d(1)}", ":".join(d(1) for _ in range(4))))]
    elif kind == "card":
        digits = _card(r)
        if not personal:
            digits = r.choice((d(16), d(16), d(15), d(13), d(19), "20" + d(12)))
        sep = r.choice((".", "/", "–", "_", "", "", "", " ", "-") if personal else ("", "", "", ".", "/", " "))
        values = [sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))]
        if not personal and r.random() < 0.3:
            values = [" ".join(d(n) for _ in range(16 // n + 1)) for n in (r.choice((2, 3)),)]
        if personal and r.random() < 0.4:  # beside another number, which hides it from the base format
            values = r.choice((values * 2, [*values, _card(r)]))
            link = r.choice((" ", " ", "-"))
    elif kind == "phone":
        values = [r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)}/{d(6)}")) if personal else r.choice((d(r.randint(7, 12)), f"20{d(2)}-{d(2)}-{d(2)}", f"{d(1)}.{d(2)}.{d(3)}.{d(2)}", f"{d(3)} {d(3)} {d(3)} {d(3)}", f"{d(1)}-{d(3)}-{d(5)}-{d(1)}", f"{d(4)}-{d(4)}"))]
    elif personal:
        values = [r.choice((of(r.choice((32, 40, 64)), "0123456789abcdef"), of(r.choice((32, 40)), "0123456789ABCDEF"), of(r.randint(20, 44), "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), f"{w()}_{of(24, '0123456789abcdefghijklmnopqrstuvwxyz')}"))]
    else:
        values = [r.choice((of(r.choice((32, 40, 64)), "0123456789abcdef"), "-".join(of(n, "0123456789abcdef") for n in (8, 4, 4, 4, 12)), f"{w()}/{w()}/{w()}{d(4)}/{w()}", f"{w()}-{w()}-{w()}-{d(4)}-{w()}", f"{w()}_{w()}_{w()}_{d(2)}"))]
    chance = 0.85 if kind == "secret" else 0.4 if kind == "card" else 0.6
    cue = r.choice(sorted(CUES[kind])) if personal and r.random() < chance else r.choice(sorted(AGAINST)) if not personal and r.random() < 0.6 else w()
    if r.random() < 0.15:
        cue = cue.upper()
    quote = r.choice(("", '"', '"', "'")) if kind == "secret" else ""
    head = " ".join(w() for _ in range(r.randint(0, 6))) + f" {cue}{r.choice((' = ', '=', ': ')) if quote else r.choice((': ', ' ', ' is ', ' no. '))}{quote}"
    text, spans = head, []
    for i, value in enumerate(values):
        text += link * (i > 0)
        spans.append((len(text), len(text) + len(value)))
        text += value
    return text + quote + r.choice((" ", ". ", ", ", "\n", "!! ")) + " ".join(w() for _ in range(r.randint(0, 5))), spans, personal


@lru_cache(maxsize=4)
def train(examples: int = EXAMPLES, seed: int = SEED, precision: float = PRECISION) -> BoostedTrees:
    """Trees fitted to the candidates of ``examples`` made-up sentences; a fourth of them calibrates a threshold for each kind."""
    r = random.Random(seed)
    x, y = [], []
    for _ in range(examples):
        text, values, personal = _made_up(r)
        for span in candidates(text):
            x.append(features(text, span))
            y.append(personal and any(abs(span[1] - a) <= 1 and abs(span[2] - b) <= 1 for a, b in values))
    x, y = np.array(x), np.array(y, float)
    held = np.arange(len(y)) % 4 == 0
    return BoostedTrees().fit(x[~held], y[~held]).calibrate(x[held], y[held], precision, x[held][:, 0])


def all_spans(text: str, model: BoostedTrees) -> tuple[list[Span], list[Span]]:
    """(base spans, base and selected spans), each by kind as in EVERY, then start."""
    base = base_spans(text)
    proposed = [s for s in candidates(text) if s not in base]
    if proposed:
        taken = sorted((a, b) for _, a, b in base)
        starts = np.array([a for a, _ in taken], np.int64)
        upto = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else starts
        free = [s for s in proposed if not (k := int(np.searchsorted(starts, s[2]))) or upto[k - 1] <= s[1]]
        if free:
            score = model.score(np.array([features(text, s) for s in free]))
            least = np.array([model.thresholds.get(float(EVERY.index(s[0])), 2.0) for s in free])
            best = sorted(np.flatnonzero(score >= least).tolist(), key=lambda i: (-score[i], free[i][1], EVERY.index(free[i][0])))
            kept: list[Span] = []
            used = bytearray(len(text))
            for s in map(free.__getitem__, best):
                if not any(used[s[1] : s[2]]):
                    kept.append(s)
                    used[s[1] : s[2]] = b"\1" * (s[2] - s[1])
            return base, sorted(base + kept, key=lambda s: (EVERY.index(s[0]), s[1], s[2]))
    return base, base


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, model: BoostedTrees | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: doc_id), base and spans (array<struct<kind, start, end>>, code points, end exclusive), redacted.

    A null text counts as empty: no spans, and redacted stays null.  Rows are kept as they are (repeats, null ids, any
    length of text); other columns are not read; of a kept column that is called like a new one, the new one gets
    underscores (``own_names``).  An empty table gives an empty result.
    """
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model or train())  # a few dozen small trees
    given, schema = kept_columns(docs, keep, text)
    read = kept_texts(docs, keep, text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, texts in read(batches):
            bases, spans, clean = [], [], []
            for t in texts:
                base, every = all_spans(t or "", shared.value)
                bases.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in base])
                spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in every])
                clean.append(redact(t, every) if every else t)
            yield pa.RecordBatch.from_arrays([kept, pa.array(bases, kind), pa.array(spans, kind), pa.array(clean, pa.string())], names=["kept", "base", "spans", "redacted"])

    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    found = given.mapInArrow(run, f"kept {schema}, base {span}, spans {span}, redacted string")
    return unkept(found, keep, "base", "spans", "redacted")
