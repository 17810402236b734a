"""Toxicity by a weighted lexicon: folded text, one Aho-Corasick pass, exception phrases, normalised by length.

Folding maps homoglyphs to Latin letters, drops invisible characters, and reads digits and signs inside a word as the letters that
they stand for. Terms are beginnings of words or whole words; an exception phrase takes back the terms that lie inside it.
"""

from __future__ import annotations

import math
import re
import string
import unicodedata
from collections import Counter
from dataclasses import dataclass, field as plain

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from pitgauge.llm.common import append_columns, field
from pitgauge.llm.labelled import constant

#: Look-alikes of Latin letters, and what digits and signs stand for inside words.
HOMOGLYPHS = str.maketrans(dict(zip("авекмнорстухіјѕԁɡոһԛԝαβεικνορτυχ", "abekmhopctyxijsdgnhqwabeikvoptux")))
INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
DIGITS = bytes.maketrans(b"0134578@$!|+", b"oieastbasiit")
#: ``l`` and ``i`` are one letter here, as 1 and | stand for both.
LETTERS = bytes.maketrans((string.punctuation + string.whitespace + "l").encode(), b" " * len(string.punctuation + string.whitespace) + b"i")

STRANGE = re.compile(r"[^\x00-ɏḀ-ỿ‐-‧]|\xad").search
MIXED = re.compile(rb"[a-z\x80-\xff][0-9@$!|+]+[a-z\x80-\xff]|[a-z\x80-\xff][0-9$]|[0-9@$][a-z\x80-\xff]")
WORD = re.compile(rb"[a-z0-9\x80-\xff@$!|+]+")
LETTER = re.compile(rb"[a-z\x80-\xff]").search


def _letters(match: re.Match) -> bytes:
    word = match.group()
    core = word.rstrip(b"!|+@$").lstrip(b"!|+")
    if core[:1] in (b"@", b"$") and not LETTER(core[1:2]):  # ornament, unlike a single sign before a letter
        core = core.lstrip(b"@$")
    if not LETTER(core):
        return word
    at = word.index(core)
    return word[:at] + core.translate(DIGITS) + word[at + len(core):]


def fold(text: str) -> str:
    """The text as the automaton sees it: UTF-8 bytes as Latin-1, words apart by one space, a space at both ends."""
    text = text.lower()
    if STRANGE(text):
        text = unicodedata.normalize("NFKC", text).translate(INVISIBLE).lower().translate(HOMOGLYPHS)
    data = text.encode()
    if MIXED.search(data):
        data = WORD.sub(_letters, data)
    data = b" " + data.translate(LETTERS) + b" "
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data.decode("latin-1")


@dataclass
class Lexicon:
    """Terms with weights, exception phrases, and the three numbers that turn a sum into a probability."""

    terms: dict[str, float] = plain(default_factory=dict)
    exceptions: list[str] = plain(default_factory=list)
    shape: tuple[float, float, float] = (0.0, 0.0, 0.0)
    always: float | None = None

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            a.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), None))
        if len(a):
            a.make_automaton()
        return a


def hits(folded: str, automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of terms outside exception phrases; of terms that overlap, the heaviest counts."""
    if not len(automaton):
        return []
    found = [(end + 1 - n, end + 1, w) for end, (n, w) in automaton.iter(folded)]
    if not found:
        return found
    shields = sorted((s, e) for s, e, w in found if w is None)
    out: list[tuple[int, int, float]] = []
    k, reach = 0, -1  # phrases that have begun, and how far the farthest of them goes
    for s, e, w in sorted((x for x in found if x[2] is not None), key=lambda x: (x[0], -x[2])):
        while k < len(shields) and shields[k][0] <= s + 1:
            reach = max(reach, shields[k][1])
            k += 1
        if e - 1 <= reach:
            continue
        if out and s + 1 < out[-1][1]:
            if w > out[-1][2]:
                out[-1] = (s, e, w)
            continue
        out.append((s, e, w))
    return out


def measures(folded: str, automaton) -> tuple[float, float, int]:
    """Logarithms of the summed weights and of their share of the words, and the number of hits."""
    found = hits(folded, automaton)
    total = sum(w for _, _, w in found)
    words = max(1, folded.count(" ") - 1)
    return math.log1p(total), math.log1p(100 * total / words), len(found)


def probability(x: tuple[float, float], shape: tuple[float, float, float]) -> float:
    z = shape[0] + shape[1] * x[0] + shape[2] * x[1]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> tuple[float, ...]:
    """Newton's method with a small ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty * np.eye(len(w)), a.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn(texts: list[str], labels: list[int], min_texts: int = 6, min_ratio: float = 12.0, max_terms: int = 5000,
          prefixes: tuple[int, int] = (4, 12)) -> Lexicon:
    """A lexicon from labelled texts.

    A term has to be in ``min_texts`` different toxic texts, at ``min_ratio`` times the rate of the others. Of the
    beginnings of a word, the shortest that qualifies is kept. Its weight is its smoothed log odds. A word beside a term makes
    an exception phrase if at least three clean texts and no toxic text have the two together.
    Without both labels the lexicon is empty and every score is the constant of the labels there are.
    """
    rows = list({fold(t): y for t, y in zip(texts, labels)}.items())
    if (always := constant([y for _, y in rows])) is not None:
        return Lexicon(always=always)
    count = (Counter(), Counter())
    seen = [sum(1 for _, y in rows if y == k) for k in (0, 1)]
    for folded, y in rows:
        words = set(folded.split())
        terms = {f" {w} " for w in words}
        for w in words:
            terms.update(" " + w[:k] for k in range(prefixes[0], min(len(w), prefixes[1]) + 1))
        count[y].update(terms)
    floor = 0.5 / seen[0]

    def odds(term: str) -> float:
        return (count[1][term] / seen[1]) / (count[0][term] / seen[0] + floor)

    good = {t for t, n in count[1].items() if n >= min_texts and odds(t) >= min_ratio}
    kept = [t for t in good if not any(t[:k] in good for k in range(prefixes[0] + 1, len(t)))]
    kept = sorted(kept, key=lambda t: (-count[1][t] * math.log(odds(t)), t))[:max_terms]
    lexicon = Lexicon({t: math.log(odds(t)) for t in kept})
    automaton = lexicon.automaton()
    beside = (Counter(), Counter())
    for folded, y in rows:
        phrases = set()
        for s, e, _ in hits(folded, automaton):
            end = folded.index(" ", e - 1)
            if s > 0:
                phrases.add(folded[folded.rindex(" ", 0, s):end + 1])
            if end + 1 < len(folded):
                phrases.add(folded[s:folded.index(" ", end + 1) + 1])
        beside[y].update(phrases)
    lexicon.exceptions = sorted(p for p, n in beside[0].items() if n >= 3 and not beside[1][p])
    automaton = lexicon.automaton()
    x = np.array([measures(folded, automaton)[:2] for folded, _ in rows])
    lexicon.shape = _logistic(x, np.array([float(y) for _, y in rows]))
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text", keep=None) -> DataFrame:
    """``docs`` with ``score`` (probability that the text is toxic), ``predicted`` and ``n_hits``, over whole texts.

    A null or empty text has no hits and gets the score of a text without any. Repeated rows repeat their
    score. Columns of ``docs`` with the new names are replaced.
    """

    def make():
        automaton = lexicon.automaton()

        def run(texts):
            score, n = [], []
            for t in texts:
                a, b, k = measures(fold(t), automaton)
                score.append(lexicon.always if lexicon.always is not None else probability((a, b), lexicon.shape))
                n.append(k)
            return score, [int(s >= 0.5) for s in score], n

        return run

    return append_columns(docs, text, [field("score", "double"), field("predicted", "int"), field("n_hits", "int")], make, keep=keep)
