"""Reading level of each document, 1 to 4.

Each word gets the grade at which it is acquired: the median of its spread over the levels
of graded texts, where every level counts alike. A stretch of prose gets the level in
whose calibrated band a weighted quantile of the grades of its known words lies; words
that all levels use alike weigh little. A document gets the level at which most of its
words stand.

Graded texts are mixed and raters err, so the grades are estimated in ROUNDS rounds: at
first each stretch counts at its document's rated level, then at the level the last
round's grades give it.

The fit uses a bounded sample: at most MAX_RATED ratings (the first by a hash of the id)
of documents of at most MAX_RATED_CHARS code points, and at most MAX_WORDS words. All
documents, whole, get a level: those in English with MIN_WORDS or more words of prose,
outside code and links. Null and empty texts have no level, nor has anything without
a single rating to learn from; ties go to the lower level.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 4
MIN_WORDS = 50
MAX_RATED = 4000
MAX_RATED_CHARS = 20_000
MAX_WORDS = 20_000
ROUNDS = 4
STRETCH_WORDS = 14
QUANTILE = 0.5
MARGIN = 0.6

# Frequent function words by which the language of a text is told.
FUNCTION_WORDS = {
    "en": "the a an and or of to in is it was are be that this for with on at by from as not i you we he she they my your our have has had do does can if but when which so too then because than there what why how",
    "de": "der die das den dem des ein eine einen einem einer und oder ist sind war nicht ich du er sie es wir ihr mein dein auf mit von zu für als auch bei nach aus wenn dass aber wie man muss habe hat wird noch mehr warum bitte",
    "fr": "le la les un une des du de et ou est sont était ne pas je tu il elle nous vous ils mon ma sur avec pour dans que qui au aux ce cette mais plus si par faut pourquoi chez moi ai a été vont",
    "es": "el la los las un una unos de del y o es son era no yo tú él ella nosotros mi su en con por para que al se lo como más pero si esta este está cuando hay ha he por qué porque antes ya me",
}
_LANGUAGES = tuple(FUNCTION_WORDS)
_FUNCTION = {w: tuple(k for k in _LANGUAGES if w in FUNCTION_WORDS[k].split()) for v in FUNCTION_WORDS.values() for w in v.split()}

# Patterns with the signs or lower-case words, one of which a text must hold for them to match.
_BLOCKS = [
    ("<", re.compile(r"<pre\b[^>]*>.*?(?:</pre\s*>|\Z)", re.S | re.I)),
    ("<", re.compile(r"<code\b[^>]*>.*?(?:</code\s*>|\Z)", re.S | re.I)),
    ("[", re.compile(r"\[code[^\]]*\].*?(?:\[/code\]|\Z)", re.S | re.I)),
    ("`~", re.compile(r"^[ \t>]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t>]*\1[ \t]*$|\Z)", re.S | re.M)),
    ("`", re.compile(r"```.*?```", re.S)),
    ("`", re.compile(r"`[^`\n]*`")),
]
_LINKS = [
    ("<", re.compile(r"<a\b[^>]*>.*?</a\s*>", re.S | re.I)),
    ("[", re.compile(r"!?\[[^\]\n]*\]\([^)\n]*\)")),
    ("[", re.compile(r"!?\[[^\]\n]*\]\[[^\]\n]*\]")),
    ("[", re.compile(r"^[ \t]*\[[^\]\n]+\]:[^\n]*$", re.M)),
    ("[(", re.compile(r"\[(?:dead link|broken link|image missing|image|link removed)\]|\((?:404|dead link)\)", re.I)),
    (("://",), re.compile(r"(?:https?|ftp)\s?://\S+", re.I)),
    (("www.",), re.compile(r"www\.\S+", re.I)),
]
_TAG = re.compile(r"</?[a-zA-Z!][^<>]{0,300}>")
_CODE = re.compile(
    r"::|\(\)|!=|==|->|=>|\);|\{\}|[\w\])]\s=\s[\w\"'(\[]|\b\w+_\w+\b|\b[a-z]+[A-Z]\w*\(|\w\(\w+,|\blambda\b|\b0x[0-9a-f]+|^\s*\$ |^\s*(?:for|if|while|def|class|elif)\b.*:\s*$|^\s*(?:throw|return|import|#include)\b.*[;(]|^\s*SELECT\b.*\bFROM\b|^\s*E\d{3,}:",
)
_MAYBE_CODE = re.compile(r"[:(=>){_$;]|lambda|0x|SELECT")  # one of these is in all that _CODE matches
_END = re.compile(r"[.!?;:…]+\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")


def _without(text: str, patterns: list, by: str) -> str:
    low = text.lower()
    for signs, p in patterns:
        if any(s in low for s in signs):
            text = p.sub(by, text)
    return text


def prose(text: str) -> str:
    """The text without code, links and markup."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace(" ", " ")
    for _ in range(2):
        text = _without(_without(text, _BLOCKS, "\n"), _LINKS, " ")
        if "&" not in text:
            break
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not _MAYBE_CODE.search(text):
        return text
    return "\n".join(line for line in text.splitlines() if len(line) > 400 or not _MAYBE_CODE.search(line) or not _CODE.search(line))


def stretches(text: str) -> list[list[str]]:
    """The prose's words in sentences; long and unpunctuated ones in parts of STRETCH_WORDS."""
    out = []
    for s in _END.split(prose(text).replace("’", "'").lower()):
        words = _WORD.findall(s)
        parts = round(len(words) / STRETCH_WORDS)
        if parts > 1:
            out += [words[len(words) * k // parts : len(words) * (k + 1) // parts] for k in range(parts)]
        elif words:
            out.append(words)
    return out


def has_english_words(parts: list[list[str]]) -> bool:
    """Whether the words hold more function words of English than of each other language listed, and enough of them."""
    hits = dict.fromkeys(_LANGUAGES, 0)
    for found, n in Counter(map(_FUNCTION.get, chain.from_iterable(parts))).items():
        for k in found or ():
            hits[k] += n
    return hits["en"] > max(v for k, v in hits.items() if k != "en") and hits["en"] >= 0.08 * sum(map(len, parts))


SIGNS = 28  # a blank, the letters a to z, and any other
_SIGN = np.full(256, SIGNS - 1, dtype=np.int64)
_SIGN[ord(" ")] = 0
_SIGN[ord("a") : ord("z") + 1] = np.arange(1, 27)


class Spelling:
    """A character model of English: mean log-probability of a sign after the two before it, from the texts fitted on.

    It tells English from languages of which no word is listed. A text is unlike English if
    its mean lies MARGIN below that of all but a hundredth of the texts fitted on; a model
    fitted on nothing lets all pass.
    """

    def __init__(self, docs: list[list[list[str]]]):
        counts = np.full(SIGNS**3, 0.1)
        made = [self._runs(d) for d in docs]
        for r in made:
            np.add.at(counts, r, 1)
        table = counts.reshape(-1, SIGNS)
        self.table = np.log(table / table.sum(axis=1, keepdims=True)).ravel()
        self.least = float(np.quantile([self.table[r].mean() for r in made], 0.01)) - MARGIN if made else -np.inf

    def _runs(self, parts: list[list[str]]) -> np.ndarray:
        text = " " + " ".join(chain.from_iterable(parts)) + "  "
        s = _SIGN[np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8)]
        return (s[:-2] * SIGNS + s[1:-1]) * SIGNS + s[2:]

    def fits(self, parts: list[list[str]]) -> bool:
        return float(self.table[self._runs(parts)].mean()) >= self.least


@dataclass
class Grades:
    """Grades (1 to LEVELS) and weights (0 to 1) of known words, the bands' upper ends, and what English looks like."""

    grade: dict[str, float] = field(default_factory=dict)
    weight: dict[str, float] = field(default_factory=dict)
    bands: tuple[float, ...] = (1.5, 2.5, 3.5)
    spelling: Spelling = field(default_factory=lambda: Spelling([]))

    @cached_property
    def _arrays(self) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        return {w: i for i, w in enumerate(self.grade)}, np.array(list(self.grade.values())), np.array([self.weight[w] for w in self.grade])

    def quantiles(self, parts: list[list[str]]) -> np.ndarray:
        """The weighted quantile of the known words' grades in each stretch, nan where none is known."""
        out = np.full(len(parts), np.nan)
        number, grade, weight = self._arrays
        if not number:
            return out
        at = np.array(list(map(number.get, chain.from_iterable(parts), repeat(-1))), dtype=np.int64)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])[at >= 0]
        g, w = grade[at[at >= 0]], weight[at[at >= 0]]
        if not len(owner):
            return out
        order = np.lexsort((g, owner))
        owner, g, upto = owner[order], g[order], np.cumsum(w[order])
        last = np.flatnonzero(np.r_[np.diff(owner) > 0, True])
        before = np.r_[0.0, upto[last[:-1]]]
        half = before + QUANTILE * (upto[last] - before)
        out[owner[last]] = g[np.minimum(np.searchsorted(upto, half - 1e-9, side="left"), last)]
        return out

    def band(self, q: np.ndarray) -> np.ndarray:
        """The level of each quantile, 0 of nan."""
        return np.where(np.isnan(q), 0, 1 + np.searchsorted(np.array(self.bands), np.nan_to_num(q), side="left"))

    def levels(self, docs: list[list[list[str]]]) -> np.ndarray:
        """The level at which most words of each document's stretches stand, 0 if no word is known; ties go to the lower level."""
        flat = [p for d in docs for p in d]
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        at = owner * (LEVELS + 1) + self.band(self.quantiles(flat))
        sums = np.bincount(at, weights=[len(p) for p in flat], minlength=len(docs) * (LEVELS + 1)).reshape(-1, LEVELS + 1)[:, 1:]
        return np.where(sums.any(axis=1), 1 + sums.argmax(axis=1), 0)


def is_english(parts: list[list[str]], spelling: Spelling) -> bool:
    return has_english_words(parts) and spelling.fits(parts)


def _estimate(parts: list[list[str]], levels: np.ndarray, owner: np.ndarray) -> Grades:
    """Grades from stretches, each at a level and of a document."""
    docs: dict[str, set[int]] = {}
    counts: dict[str, np.ndarray] = {}
    total = np.zeros(LEVELS)
    for p, k, d in zip(parts, levels, owner):
        total[k - 1] += len(p)
        for w in p:
            if w not in counts:
                counts[w], docs[w] = np.zeros(LEVELS), set()
            counts[w][k - 1] += 1
            if len(docs[w]) < 2:
                docs[w].add(d)
    known = sorted((w for w in counts if len(docs[w]) >= 2), key=lambda w: (-counts[w].sum(), w))[:MAX_WORDS]
    out = Grades()
    for w in known:
        rate = (counts[w] + 0.02) / (total + 1)
        share = rate / rate.sum()
        upto = np.cumsum(share)
        k = int(np.searchsorted(upto, 0.5))
        before = upto[k - 1] if k else 0.0
        out.grade[w] = float(k + 0.5 + (0.5 - before) / share[k])
        out.weight[w] = float(1 + (share * np.log(share + 1e-12)).sum() / np.log(LEVELS)) ** 2 + 1e-6
    return out


def _calibrate(grades: Grades, docs: list[list[list[str]]], rated: np.ndarray) -> tuple[float, ...]:
    """Bands under which most documents get their rated level, found one boundary after the other on a grid."""
    flat = [p for d in docs for p in d]
    at, q, n = np.repeat(np.arange(len(docs)), [len(d) for d in docs]), grades.quantiles(flat), np.array([len(p) for p in flat], dtype=float)
    at, q, n = at[~np.isnan(q)], q[~np.isnan(q)], n[~np.isnan(q)]
    if not len(q):
        return grades.bands
    bands = list(grades.bands)

    def right(b: list[float]) -> float:
        sums = np.bincount(at * LEVELS + np.searchsorted(np.array(b), q, side="left"), weights=n, minlength=len(docs) * LEVELS)
        found = sums.reshape(-1, LEVELS).argmax(axis=1) + 1
        return float((found == rated).sum()) - 0.01 * float(np.abs(np.array(b) - np.array((1.5, 2.5, 3.5))).sum())

    for _ in range(2):
        for k in range(LEVELS - 1):
            low, high = (bands[k - 1] if k else 1.0), (bands[k + 1] if k < LEVELS - 2 else float(LEVELS))
            grid = [x for x in np.arange(k + 1.1, k + 2.0, 0.1) if low < x < high]
            bands[k] = max([bands[k], *grid], key=lambda x: right([*bands[:k], x, *bands[k + 1 :]]))
    return tuple(float(b) for b in bands)


def fit(rated: pd.DataFrame, rounds: int = ROUNDS) -> Grades:
    """Grades from (text, reading_level) rows."""
    docs, levels = [], []
    for text, level in zip(rated["text"], rated["reading_level"]):
        parts = stretches(text)
        if parts and has_english_words(parts):
            docs.append(parts)
            levels.append(int(level))
    if not docs:
        return Grades()
    flat = [p for d in docs for p in d]
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    rating = np.array(levels)
    own = rating[owner]
    grades = _estimate(flat, own, owner)
    for _ in range(rounds):
        band = grades.band(grades.quantiles(flat))
        own = np.where(band > 0, band, own)
        grades = _estimate(flat, own, owner)
    grades.bands = _calibrate(grades, docs, rating)
    grades.spelling = Spelling(docs)
    return grades


def learn(docs: DataFrame, ratings: DataFrame) -> Grades:
    """Grades fitted on the bounded sample that the module describes."""
    usable = ratings.where(F.col("reading_level").between(1, LEVELS)).select("doc_id", "rater", "reading_level")
    sample = usable.orderBy(F.xxhash64("doc_id", "rater"), "doc_id", "rater", "reading_level").limit(MAX_RATED)
    short = docs.where(F.length("text").between(1, MAX_RATED_CHARS)).select("doc_id", "text")
    return fit(short.join(F.broadcast(sample), "doc_id").orderBy("doc_id", "rater", "reading_level").select("text", "reading_level").toPandas())


def levels(docs: DataFrame, grades: Grades) -> DataFrame:
    """(doc_id, reading_level, n_words) of the English documents with enough prose."""

    def assign(batches):
        for pdf in batches:
            made = [(doc, p, n) for doc, text in zip(pdf["doc_id"], pdf["text"]) if (n := sum(map(len, p := stretches(text)))) >= MIN_WORDS and is_english(p, grades.spelling)]
            found = zip(made, grades.levels([p for _, p, _ in made]).tolist()) if made else ()
            yield pd.DataFrame([(doc, k, n) for (doc, _, n), k in found if k], columns=["doc_id", "reading_level", "n_words"])

    return docs.where("text <> '' AND doc_id IS NOT NULL").select("doc_id", "text").mapInPandas(
        assign, "doc_id bigint, reading_level bigint, n_words bigint"
    )
