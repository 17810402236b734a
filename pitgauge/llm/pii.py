"""Personal data by fixed patterns and a semi-Markov conditional random field for what they miss.

The patterns' spans always stay. Around the places between them that could hold more (digits, @, spelled-out @ and dots), the field
chooses segments jointly: each candidate span of up to ``LONGEST`` tokens is scored whole, by features of all of it and of the words
beside it, and a dynamic program over end positions and types takes the best segmentation. Everything else is plain text.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field as plain

from pyspark.sql import DataFrame

from pitgauge.llm.common import append_columns, col, field

#: The kinds in the order in which equal starts are listed, and the patterns of the contract.
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Candidates have at most so many tokens, and so many digits unless they have an @; no kind of the contract has more than 19 digits.
LONGEST, MOST_DIGITS = 18, 24
TRIGGER = re.compile(r"[0-9]+|@|[\[({<]\s?(?:at|AT|dot|DOT)\s?[\])}>]")
SPELLED = re.compile(TRIGGER.pattern + r"|\b(?:at|AT)\b(?=.{1,40}\b(?:dot|DOT)\b)")
DOT = re.compile(r"\b(?:dot|DOT)\b")
INSIDE = frozenset("[](){}<>.-_+@/%")
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Matches of local part, @ and dotted domain, found from each @ so that long words cost nothing twice."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_SIGNS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end(), "email"
            done = m.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """The contract's spans, by start and kind; matches that fail their check are dropped."""
    out = list(emails(text)) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            if m.end() - m.start() < 12:
                continue
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdecimal() for c in m.group()) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def span_features(tokens: list[str], gaps: list[bool], i: int, j: int) -> list[str] | None:
    """Features of the candidate tokens[i:j]; none if it can't be an entity (no digit and no sign or word for @)."""
    part = tokens[i:j]
    text = "".join((" " if gaps[k] and k > i else "") + tokens[k] for k in range(i, j))
    digits = [c for c in text if c.isdecimal() and c.isascii()]
    low = [t.lower() for t in part]
    ats = low.count("@") + sum(t == "at" for t in low)
    if (not digits and not ats) or not (part[0][0].isalnum() or part[0] in "+(") or not (part[-1][0].isalnum() or part[-1] == ")"):
        return None
    dots = low.count(".") + low.count("dot")
    groups = [len(t) for t in part if t.isdecimal()]
    words = [t for t in part if t.isalpha()]
    signs = "".join(sorted({t for t in part if not t.isalnum()}))[:6]
    n = len(digits)
    out = ["bias", f"signs={signs}", f"digits={n if n < 5 else 5 if n < 9 else 9 if n < 12 else 12 if n < 20 else 20}", f"groups={min(len(groups), 7)}", f"words={min(len(words), 5)}",
           f"ats={min(ats, 2)}", f"dots={min(dots, 4)}", f"length={min(j - i, 12)}"]
    if ats == 1 and dots and n * 2 < len(text):
        k = next(k for k, t in enumerate(low) if t in ("@", "at"))
        after = [t for t in low[k + 1:] if t not in "[](){}<>"]
        out.append("address" if k and after and "dot" not in after[:1] and ("." in after or "dot" in after) and after[-1].isalpha() and 2 <= len(after[-1]) <= 6 else "no address")
        out.append(f"bracketed={any(c in '[({<' for c in part)}")
        out.append(f"loose={sum(gaps[i + 1:j]) - sum(t in ('at', 'dot') for t in low) * 2}")
    if not words and n:
        out.append(f"start={'+' if part[0] == '+' else '(' if part[0] == '(' else '00' if part[0].startswith('00') else '0' if part[0][0] == '0' else 'digit'}")
        out.append("shape=" + "-".join(str(min(g, 6)) for g in groups[:6]))
        if 12 <= n <= 19:
            out.append(f"luhn={luhn(''.join(digits))}")
        if len(groups) == 4:
            out.append(f"octets={all(t == '0' or (t[0] != '0' and int(t) <= 255) for t in part if t.isdecimal() and len(t) < 9) and max(groups) <= 3}")
    for name, k in (("before", i - 1), ("before2", i - 2), ("after", j)):
        t = tokens[k].lower() if 0 <= k < len(tokens) else ""
        kind = CUES.get(t) or ("digits" if t.isdecimal() else "word" if t.isalpha() else t or "edge")
        out.append(f"{name}={kind}")
    return out


#: Words that announce personal data, in the languages at hand.
CUES = {w: kind for kind, words in {
    "email": "email mail e-mail correo courriel contact write adresse", "ip": "ip host server address login from", "card": "card visa mastercard carte tarjeta karte credit",
    "phone": "phone tel call mobile fax cell telefon teléfono téléphone whatsapp", "other": "order invoice id version date isbn page token no nr total price year"}.items() for w in words.split()}


@dataclass
class Field:
    """Weights of (kind, feature); ``cost`` is what a span has to beat the plain reading by."""

    weights: dict[tuple[str, str], float] = plain(default_factory=dict)
    cost: float = 2.0

    def scores(self, feats: list[str]) -> list[float]:
        get = self.weights.get
        return [sum(get((k, f), 0.0) for f in feats) for k in KINDS]

    def scorer(self) -> Callable[[list[str]], list[float]]:
        """``scores`` of a fitted field, with the weights of each feature side by side."""
        rows: dict[str, list[float]] = {}
        for (k, f), w in self.weights.items():
            rows.setdefault(f, [0.0] * len(KINDS))[KINDS.index(k)] = w
        none = [0.0] * len(KINDS)
        return lambda feats: [sum(x) for x in zip(*[rows.get(f, none) for f in feats])]


def candidates(tokens: list[str], gaps: list[bool], j: int) -> list[tuple[int, list[str]]]:
    """Lengths and features of the candidates that end before token ``j``.

    A candidate has no sign outside ``INSIDE``, has a digit or an @ (spelled out or not), and has letters only if it has an @.
    """
    out = []
    digits, letter, at = 0, False, False
    for i in range(j - 1, max(-1, j - 1 - LONGEST), -1):
        t = tokens[i]
        if t.isalpha():
            letter, at = True, at or t in ("at", "AT")
        elif t.isdecimal():
            digits += len(t)
        elif t not in INSIDE:
            break
        else:
            at |= t == "@"
        if digits > MOST_DIGITS and not at:
            break
        if (at or digits and not letter) and (f := span_features(tokens, gaps, i, j)) is not None:
            out.append((j - i, f))
    return out


def cells(stream: Iterable[tuple[str, bool]]) -> Iterator[list[tuple[int, list[str]]]]:
    """``candidates`` by end position, from the first token's on. Few tokens are held: those that the longest candidate and its context can reach."""
    tokens, gaps = [], []
    for token, gap in stream:
        tokens.append(token)
        gaps.append(gap)
        if len(tokens) > 1:
            yield candidates(tokens, gaps, len(tokens) - 1)
        if len(tokens) > 1_000:
            del tokens[:-LONGEST - 3], gaps[:-LONGEST - 3]
    if tokens:
        yield candidates(tokens, gaps, len(tokens))


def lattice(tokens: list[str], gaps: list[bool]) -> list[list[tuple[int, list[str]]]]:
    """By end position: starts and features of the candidates that end there."""
    return [[], *[[(j - n, f) for n, f in cell] for j, cell in enumerate(cells(zip(tokens, gaps)), 1)]]


def segment(model: Field, stream: Iterable[tuple[str, bool]]) -> list[tuple[int, int, str]]:
    """Best segmentation of a window: token ranges and kinds. Of equal scores the plain reading, then the earlier kind, wins.

    The program keeps the scores of the last ``LONGEST`` positions and two bytes a token to trace back by, so a window may be a whole long text.
    """
    score, m = model.scorer(), LONGEST + 1
    best, length, kind = [0.0] * m, bytearray(1), bytearray(1)
    for j, cell in enumerate(cells(stream), 1):
        top, n_top, k_top = best[(j - 1) % m], 0, 0
        for n, f in cell:
            before = best[(j - n) % m]
            for k, s in enumerate(score(f)):
                if before + s - model.cost > top + 1e-12:
                    top, n_top, k_top = before + s - model.cost, n, k
        best[j % m] = top
        length.append(n_top)
        kind.append(k_top)
    out, j = [], len(length) - 1
    while j > 0:
        if length[j]:
            out.append((j - length[j], j, KINDS[kind[j]]))
        j -= max(1, length[j])
    return out[::-1]


def decode(model: Field, tokens: list[str], gaps: list[bool]) -> list[tuple[int, int, str]]:
    return segment(model, zip(tokens, gaps))


def example(rng: random.Random) -> tuple[list[str], list[bool], list[tuple[int, int, str]]]:
    """A training sentence: invented words with personal data in strict and loose forms, and with numbers that are none."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda n=None: "".join(rng.choice(letters) for _ in range(n or rng.randint(2, 9)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    octets = lambda: [str(rng.randint(1, 255)) for _ in range(4)]

    def card() -> str:
        body = num(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def entity() -> tuple[str, str]:
        kind = rng.choice(KINDS)
        if kind == "email":
            at, dot = rng.choice([("@", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), ("(at)", "."), (" [at] ", "."), (" @ ", " . "), ("[at]", "[dot]")])
            host = dot.join([word() for _ in range(rng.randint(1, 2))] + [rng.choice(["com", "org", "net", "de", "fr", "es", "io"])])
            return word() + rng.choice(["", "." + word(), num(2), "_" + word()]) + at + host, kind
        if kind == "ip":
            return rng.choice([".", " . ", "[.]", "(.)"]).join(octets()), kind
        if kind == "card":
            c = card()
            return rng.choice(["", " ", "-", ".", "  ", " - "]).join(c[k:k + 4] for k in range(0, 16, 4)), kind
        a, b, c = num(3), num(3), num(4)
        return rng.choice([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"00{rng.randint(1, 99)} {a} {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.randint(1, 99)} {a} / {b} {c}", f"0{num(3)} / {num(7)}"]), kind

    def decoy() -> str:
        body = num(16)
        return rng.choice([
            num(rng.randint(1, 8)), f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(2)}:{num(2)}", f"{num(3)}.{num(2)}", f"v{num(1)}.{num(2)}.{num(1)}", f"{num(1)}.{num(1)}.{num(1)}", f"{num(1)},{num(3)},{num(3)}",
            f'token = "{word(1)}{num(3)}{word(2)}{num(5)}{word(1)}{num(9)}"', body if not luhn(body) else body + num(6), f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{word()} at {word()} {word()}", f"at {num(2)}:{num(2)}", f"@{word()}", num(rng.randint(20, 30)),
            f"{num(2)} {num(2)} {num(3)}", f"{num(4)} {num(4)}", f"1{num(2)}.{word()}", f"{word()}{num(3)}", f"#{num(6)}", f"{num(2)} %", f"{word()} dot {word()}"])

    text, spans = "", []
    for _ in range(rng.randint(2, 4)):
        text += " ".join(word() for _ in range(rng.randint(1, 4))) + rng.choice([" ", ". ", ": ", ", "])
        if rng.random() < 0.55:
            e, kind = entity()
            if rng.random() < 0.3:
                cues = [w for w, k in CUES.items() if k == kind]
                text += rng.choice(cues) + rng.choice([" ", ": "])
            spans.append((len(text), len(text) + len(e), kind))
            text += e
        else:
            text += decoy()
        text += rng.choice([" ", ". ", ", "])
    text += word()
    tokens, at = tokenise(text, 0, len(text))
    starts, ends = {a: k for k, (a, _) in enumerate(at)}, {b: k + 1 for k, (_, b) in enumerate(at)}
    gold = [(starts[a], ends[b], k) for a, b, k in spans if a in starts and b in ends]
    return tokens, [k > 0 and at[k - 1][1] < at[k][0] for k in range(len(at))], gold


def tokenise(text: str, start: int, end: int) -> tuple[list[str], list[tuple[int, int]]]:
    found = list(TOKEN.finditer(text, start, end))
    return [m.group() for m in found], [m.span() for m in found]


def log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def learn(sentences: int = 250, epochs: int = 6, rate: float = 0.3, penalty: float = 1e-3, seed: int = 5) -> Field:
    """Fit on invented sentences by the field's own likelihood: forward and backward sums over all segmentations (AdaGrad).

    There is no labelled personal data to learn from; the sentences are a fixed number of draws of ``example``.
    """
    rng = random.Random(seed)
    data = []
    for _ in range(sentences):
        tokens, gaps, gold = example(rng)
        data.append((len(tokens), lattice(tokens, gaps), {(i, j): k for i, j, k in gold if j - i <= LONGEST}))
    model, squares = Field(), {}
    for _ in range(epochs):
        rng.shuffle(data)
        for n, cells, gold in data:
            scored = [[(i, f, model.scores(f)) for i, f in cell] for cell in cells]
            ahead = [0.0] * (n + 1)
            for j in range(1, n + 1):
                ahead[j] = log_sum([ahead[j - 1]] + [ahead[i] + s for i, _, ss in scored[j] for s in ss])
            behind = [-math.inf] * (n + 1)
            behind[n] = 0.0
            for j in range(n, 0, -1):
                behind[j - 1] = log_sum([behind[j - 1], behind[j]]) if behind[j - 1] > -math.inf else behind[j]
                for i, _, ss in scored[j]:
                    v = log_sum([behind[j] + s for s in ss])
                    behind[i] = log_sum([behind[i], v]) if behind[i] > -math.inf else v
            grad: dict[tuple[str, str], float] = {}
            for j in range(1, n + 1):
                for i, f, ss in scored[j]:
                    for k, s in zip(KINDS, ss):
                        g = (gold.get((i, j)) == k) - math.exp(min(0.0, ahead[i] + s + behind[j] - ahead[n]))
                        if abs(g) > 1e-3:
                            for name in f:
                                grad[k, name] = grad.get((k, name), 0.0) + g
            for name, g in grad.items():
                g -= penalty * model.weights.get(name, 0.0)
                squares[name] = squares.get(name, 0.0) + g * g
                model.weights[name] = model.weights.get(name, 0.0) + rate * g / math.sqrt(squares[name] + 1e-8)
    return model


def added_spans(text: str, base: list[Span], model: Field) -> list[Span]:
    """Spans of the field outside the patterns' spans, in windows around what could hold personal data; a window is read token by token."""
    triggers = (m.span() for m in (SPELLED if DOT.search(text) else TRIGGER).finditer(text))
    found = next(triggers, None)
    out, k = [], 0
    for a, b in [*sorted((a, b) for a, b, _ in base), (len(text), len(text))]:  # the places between base spans
        lo, hi = k, a
        k = max(k, b)
        while found and found[0] < lo:
            found = next(triggers, None)
        while found and found[0] < hi:
            start, end = found
            found = next(triggers, None)
            while found and found[0] < min(hi, end + 40):
                end = max(end, found[1])
                found = next(triggers, None)
            left, right = text[max(lo, start - 200):start], text[min(end, hi):min(hi, end + 200)]
            before = [m.start() for m in TOKEN.finditer(left)][-LONGEST:]
            after = [m.end() for m in TOKEN.finditer(right)][:LONGEST]
            first = max(lo, start - 200) + (before[0] if before else len(left))
            last = min(end, hi) + (after[-1] if after else 0)
            starts, ends = array("q"), array("q")

            def tokens():
                for m in TOKEN.finditer(text, first, last):
                    gap = len(ends) > 0 and ends[-1] < m.start()
                    starts.append(m.start())
                    ends.append(m.end())
                    yield m.group(), gap

            for i, j, kind in segment(model, tokens()):
                if not out or starts[i] >= out[-1][1]:
                    out.append((starts[i], ends[j - 1], kind))
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find_personal_data(docs: DataFrame, model: Field, text: str = "text", keep=None, spans_only: bool = False) -> DataFrame:
    """``docs`` with ``base`` and ``added``: arrays of (start, end, kind) in code points, end exclusive, over whole texts.

    Base spans of different kinds may overlap; added ones overlap nothing. A null or empty text has none. Repeated rows repeat
    their spans; columns of ``docs`` with the new names are replaced.
    """
    kind = "array<struct<start:bigint,end:bigint,kind:string>>"

    def make():
        def run(texts):
            base = [base_spans(t) for t in texts]
            more = [added_spans(t, b, model) for t, b in zip(texts, base)]
            return [[[dict(zip(("start", "end", "kind"), s)) for s in spans] for spans in found] for found in (base, more)]

        return run

    return append_columns(docs, text, [field("base", kind), field("added", kind)], make, keep=keep)


def digest_personal_data(docs: DataFrame, model: Field, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Counts of base spans by kind, sha256 of their list, and the list of all spans."""

    def make():
        def run(texts):
            counts, digests, lists = {k: [] for k in KINDS}, [], []
            for t in texts:
                base = base_spans(t)
                for k in KINDS:
                    counts[k].append(sum(s[2] == k for s in base))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                lists.append(listed(base + added_spans(t, base, model)))
            return [*counts.values(), digests, lists]

        return run

    fields = [field(f"n_{k}", "long") for k in KINDS] + [field("base_sha256", "string"), field("spans", "string")]
    return append_columns(docs, text, fields, make, keep=list(keep))


def redact(docs: DataFrame, model: Field, text: str = "text") -> DataFrame:
    """``docs`` with each span of its texts replaced by its kind in angle brackets; spans that overlap become one, named by the first. A null text stays null."""

    def clean(t):
        base = base_spans(t)
        parts, at = [], 0
        for a, b, k in sorted(base + added_spans(t, base, model), key=lambda s: (s[0], KINDS.index(s[2]))):
            if a >= at:
                parts += [t[at:a], f"<{k}>"]
            at = max(at, b)
        return "".join([*parts, t[at:]])

    def make():
        return lambda texts: [[None if t is None else clean(t) for t in texts]]

    return append_columns(docs, text, [field(text, "string")], make, nulls=True).select(*[col(c) for c in docs.columns])
