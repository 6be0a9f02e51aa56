"""Variant spellings of names typed by people.

1. Canonical form. A name becomes tokens without case, accents, markup and look-alike
   digits. Legal forms fall away. Tokens that occur in many names (*common words*: trades,
   places, given names) are brought to one spelling: abbreviations and nicknames as learned
   from names of one id that differ in nothing else (``learn``), and by a table of usual ones
   for words too rare to learn; typing errors by a look-up of near common words. Rare tokens
   stay as typed. Names with the same canonical form are one node from here on.
2. Candidates. Within blocks of nodes that agree in their common words, a prefix-filtered
   join on the q-grams of the rare tokens, rarest first. A prefix is as long as the typing
   errors that verification accepts can break grams, and one more (``most_broken``), so that
   every pair that it accepts meets; positions, lengths and plain edits, which are bounded
   by the same errors, thin out those that do.
3. Verification. Soft weighted token similarity: tokens are matched one to one by typing
   distance, and weigh their inverse document frequency, so that rare tokens count more.
   Every token needs a partner.
4. Groups. Connected components over the ids; ids that share a node or an accepted pair of
   nodes are one. All counts of words and grams are taken over all names.

An initial stands for a given name only where the names that match it hold one such given
name. Names that are null, stand-ins or cut short aren't used, and ids without another name
are left out. Null and empty ids are no ids. Empty tables give empty results.
"""

from __future__ import annotations

import html
import math
import unicodedata
from dataclasses import dataclass
from functools import cached_property, lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.llm.components import components
from siltwork.llm.survivor import name_lines
from siltwork.operators.salted import heavy_hashes, salted_join
from siltwork.session import by_merge, cut, release

Q = 3
GRAM_BUCKETS = 1 << 16
MIN_SIMILARITY = 0.8
HOT_SHARE = 0.002  # of all grams
LARGE_SHARE = 0.01  # of all linked ids
LONG_WORD = 7  # letters from which a word may hold two typing errors
COMMON_SHARE = 0.0004
COMMON_LEAST = 6
SHORT_SHARE = 0.00004
SHORT_LEAST = 2
MOST_GROUPS = 0.5  # of a short form's groups, those with the word that it stands for
ALTERNATE_SHARE = 0.02  # of a short form's names, those that are also written out
GIVEN_SHARE = 0.003  # of a given name's names, those that are also cut to its letter

# Words of legal forms, lower case and without accents and points.
LEGAL = frozenset(
    """ltd limited bv nv co company pty proprietary sa inc incorporated corp corporation oy oyj osakeyhtio ag aktiengesellschaft
    gmbh mbh ges gesellschaft mit beschrankter haftung llc liability llp lp plc kg ohg srl spa sas sarl se ab as aps kft
    besloten vennootschap societe anonyme sociedad anonima""".split()
)

# Words that join the parts of a name.
JOINING = frozenset("and und et y e the of no nr num number nummer numero".split())

# Usual abbreviations of words of trades.
ABBREVIATIONS = dict(
    p.split("=")
    for p in """assoc=associates bky=bakery bros=brothers bro=brothers cer=ceramics chem=chemicals conslt=consulting cons=consulting
    constr=construction const=construction elec=electric engg=engineering eng=engineering engr=engineering fds=foods frt=freight
    furn=furniture hydr=hydraulics ind=industries inds=industries ins=insurance instr=instruments intl=international labs=laboratories
    lab=laboratories log=logistics mar=marine mfg=manufacturing mfr=manufacturing nurs=nurseries opt=optics pkg=packaging prtg=printing
    publ=publishing pub=publishing refrig=refrigeration svcs=services svc=services serv=services sw=software tech=technologies
    tex=textiles tmbr=timber transp=transport trans=transport intnl=international mgmt=management dept=department""".split()
)

# Usual short forms of given names.
NICKNAMES = dict(
    p.split("=")
    for p in """abby=abigail alex=alexander andy=andrew becky=rebecca bella=isabella ben=benjamin beppe=giuseppe bill=william
    billy=william bob=robert bobby=robert chris=christopher chuck=charles charlie=charles dan=daniel dave=david debbie=deborah deb=deborah
    dick=richard rick=richard dot=dorothy dottie=dorothy ed=edward ned=edward ted=theodore theo=theodore eddie=edward fred=frederick
    greg=gregory hans=johann harry=henry hank=henry heinz=heinrich jim=james jimmy=james joe=joseph jon=jonathan kate=katherine
    kathy=katherine katya=yekaterina larry=lawrence liz=elizabeth beth=elizabeth betty=elizabeth maggie=margaret peggy=margaret
    meg=margaret matt=matthew mike=michael misha=mikhail nell=eleanor nellie=eleanor nick=nicholas paco=francisco pancho=francisco
    patty=patricia pat=patricia sam=samuel steve=stephen sue=susan susie=susan tilly=matilda tom=thomas tommy=thomas tony=anthony
    vicky=victoria vicki=victoria walt=walter will=william ron=ronald sasha=aleksandr kolya=nikolai pepe=jose lena=elena""".split()
)

# Usual given names beside those of which NICKNAMES has a short form.
GIVEN = frozenset(NICKNAMES.values()) | frozenset(
    """john mary anna peter paul george helen karl maria laura julia martin simon stefan ivan olga pierre jean claude marie carlos
    juan luis pedro antonio marco luca sofia emma oliver lucas hugo jan piet klaas kari lars sven ingrid astrid erik""".split()
)

SUFFIXES = frozenset("sons daughters brothers sisters partners".split())

_KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_LOOK = str.maketrans({"0": "o", "1": "l", "5": "s", "3": "e", "8": "b"})
_FOLD = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th"})
_TOKEN = regex.compile(r"[^\W_]+")
_DOTTED = regex.compile(r"\b(?:[a-z]\.\s?){2,}")
_POINTS = regex.compile(r"[.\s]")
_CAMEL = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})")
_HIDDEN = regex.compile(r"[\p{M}\p{Cf}]+")


def _near_keys() -> frozenset[tuple[str, str]]:
    """Pairs of letters on keys that touch."""
    at = {ch: (r, c + r * 0.5) for r, row in enumerate(_KEYS) for c, ch in enumerate(row)}
    return frozenset((a, b) for a, (r, c) in at.items() for b, (s, d) in at.items() if a != b and abs(r - s) <= 1 and abs(c - d) <= 1)


NEAR = _near_keys()


def typing_distance(a: str, b: str, most: int = 2) -> int:
    """Typing errors between two words: a letter left out, put in, swapped with the next, or taken from a near key; most + 1 for more.

    Words that differ in nothing but one letter from a far key, or in two letters that
    aren't swapped, aren't typing errors of each other: short words would meet by chance.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    if ("rn" in a or "rn" in b) and a.replace("rn", "m") == b.replace("rn", "m"):  # looks alike
        return 1
    if len(a) == len(b):
        off = [i for i in range(len(a)) if a[i] != b[i]]
        if len(off) == 1:
            return 1 if (a[off[0]], b[off[0]]) in NEAR else most + 1
        if len(off) == 2:
            i, j = off
            return 1 if j == i + 1 and a[i] == b[j] and a[j] == b[i] else most + 1
    far, m = most + 1, len(b)
    before, row = None, list(range(m + 1))
    for i, x in enumerate(a, 1):  # cells further than ``most`` from the diagonal hold more errors than that
        older, before, row = before, row, [far] * (m + 1)
        if i <= most:
            row[0] = i
        least = row[0]
        for j in range(max(1, i - most), min(m, i + most) + 1):
            y = b[j - 1]
            d = before[j - 1] + (0 if x == y else 1 if (x, y) in NEAR else 3)
            if before[j] < d:
                d = before[j] + 1
            if row[j - 1] < d:
                d = row[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and older[j - 2] + 1 < d:
                d = older[j - 2] + 1
            row[j] = d
            if d < least:
                least = d
        if least > most:
            return far
    return min(row[-1], far)


def plain_text(text: str) -> str:
    text = html.unescape(html.unescape(text)) if "&" in text else text
    plain = text.isascii()
    if not plain:
        text = _HIDDEN.sub("", unicodedata.normalize("NFC", text))
    if _CAMEL.search(text):
        text = _TOKEN.sub(lambda m: m.group() if m.group().casefold() in LEGAL else _CAMEL.sub(" ", m.group()), text)
    if plain:
        return text.lower()
    return _HIDDEN.sub("", unicodedata.normalize("NFKD", text.casefold().translate(_FOLD)))


def tokens(name: str) -> list[str]:
    """The name's tokens in plain letters; look-alike digits within words become letters."""
    text = plain_text(name)
    if "." in text:
        text = _DOTTED.sub(lambda m: (j + " " if (j := _POINTS.sub("", m.group())) in LEGAL else m.group()), text)
    out = []
    for t in _TOKEN.findall(text):
        if not t.isdigit():
            if not t.isalpha():
                t = t.translate(_LOOK)
        out.append(t)
    return out


def _spelled(words) -> dict[str, str]:
    """Each fixed word in the spelling that tokens() gives it."""
    return {(tokens(w) or [w])[0]: w for w in words}


_LEGAL, _JOINING, _SUFFIXES, _GIVEN = (frozenset(_spelled(x)) for x in (LEGAL, JOINING, SUFFIXES, GIVEN))
_LONG_LEGAL = frozenset(f for f in _LEGAL if len(f) >= 6)


@dataclass(frozen=True)
class Lexicon:
    """Short forms with what they stand for, and which of those are given names."""

    short: dict[str, str]
    given: frozenset[str]

    @cached_property
    def trades(self) -> frozenset[str]:
        """Words with short forms that are no given names: who has one is no person."""
        return frozenset(v for v in self.short.values() if v not in self.given) - _SUFFIXES

    @cached_property
    def initials(self) -> dict[str, tuple[str, ...]]:
        """What a given name could be cut to, by way of its short forms too."""
        out = {g: {g[0]} for g in self.given}
        for k, v in self.short.items():
            if v in out:
                out[v].add(k[0])
        return {g: tuple(sorted(x)) for g, x in out.items()}

    def with_usual(self, usual: Lexicon) -> Lexicon:
        """This lexicon, and of the other one what it doesn't say otherwise."""
        return Lexicon({**usual.short, **self.short}, self.given | usual.given)


USUAL = Lexicon({tokens(k)[0]: tokens(v)[0] for k, v in {**ABBREVIATIONS, **NICKNAMES}.items()}, _GIVEN)


@dataclass(frozen=True)
class Canonical:
    """A name's canonical form.

    block: the common words, which must agree for two names to be compared. letters: the
    initials that its given name could be cut to, of short forms too; empty for firms.
    """

    block: str
    given: str
    letters: tuple[str, ...]
    middle: str
    rare: tuple[str, ...]


class Canon:
    """Brings names to canonical forms, given the common words and how many names each occurs in."""

    def __init__(self, common: dict[str, int], lexicon: Lexicon = USUAL):
        self.lexicon = lexicon
        fixed = set(lexicon.short.values()) | lexicon.given | _SUFFIXES
        words = {w: n for w, n in common.items() if len(w) > 1 and not w.isdigit() and w not in _LEGAL and w not in _JOINING}
        self.count = {w: words.get(w, 0) for w in set(words) | fixed}
        near: dict[int, list[str]] = {}
        for w in sorted(self.count):
            if len(w) >= 4:
                for n in range(len(w) - 2, len(w) + 3):
                    near.setdefault(n, []).append(w)
        self.by_length = {n: (ws, np.array([_letters(w) for w in ws], dtype=np.uint64)) for n, ws in near.items()}
        self.word = lru_cache(200_000)(self._word)

    def _near(self, t: str, least: int) -> str | None:
        """The common word, found in at least so many names, that t most likely mistypes.

        One typing error is allowed, two in words of eight letters or more. Two errors
        change at most four kinds of letters, which spares most words the comparison.
        """
        words, letters = self.by_length.get(len(t), ((), None))
        if not words:
            return None
        best = None
        for i in np.flatnonzero(np.bitwise_count(letters ^ np.uint64(_letters(t))) <= 4).tolist():
            w = words[i]
            if w != t and self.count[w] >= least:
                most = 2 if min(len(t), len(w)) >= 8 else 1
                d = typing_distance(t, w, most)
                if d <= most and (best is None or (d, -self.count[w], w) < best):
                    best = (d, -self.count[w], w)
        return best[2] if best else None

    def _word(self, t: str) -> tuple[str, ...]:
        """The canonical spelling of a token, in parts if it holds a common word; common parts begin with '='."""
        if t in _LEGAL or t in _JOINING:
            return ()
        short = self.lexicon.short
        if t in short:
            return ("=" + short[t],)
        if t.isdigit():
            return ("=#" + (t.lstrip("0") or "0"),)
        if len(t) == 1:
            return (t,)
        if len(t) >= 4:
            near = self._near(t, 8 * self.count.get(t, 1))
            if near:
                return ("=" + short.get(near, near),)
            if len(t) >= 6 and _is_near(t, _LONG_LEGAL):
                return ()
        if t in self.count:
            return ("=" + t,)
        if len(t) <= 3:
            return () if _is_near(t, _LEGAL) else (t,)
        for k in range(len(t) - 1, 3, -1):
            if k >= 5 and t[:k] in self.count and len(t) - k != 2 and len(t) - k != 3:
                return ("=" + t[:k], *self._word(t[k:]))
            if len(t) - k >= 5 and t[k:] in self.count:
                return (*self._word(t[:k]), "=" + t[k:])
        return (t,)

    def form(self, name: str) -> Canonical | None:
        return self.form_of(tokens(name))

    def form_of(self, words: list[str]) -> Canonical | None:
        parts = [p for t in words for p in self.word(t)]
        common = [p[1:] for p in parts if p.startswith("=")]
        letters = [p for p in parts if len(p) == 1]
        rare = tuple(sorted(p for p in parts if not p.startswith("=") and len(p) > 1))
        lexicon = self.lexicon
        given = [w for w in common if w in lexicon.given]
        others = sorted(w for w in common if w not in lexicon.given)
        if not rare and not common:
            return None
        person = bool(given) or (bool(letters) and not [w for w in others if w in lexicon.trades])
        if not person:
            return Canonical("|".join(others), "", (), "", rare)
        first, rest = (given[0], given[1:]) if given else ("", [])
        initials = lexicon.initials[first] if first else (letters[0],)
        middle = "".join(sorted(letters if first else letters[1:]))
        return Canonical("|".join(sorted(others + rest)), first, initials, middle, rare)


@lru_cache(100_000)
def _letters(w: str) -> int:
    """The kinds of letters of a word as bits; kinds may share one."""
    out = 0
    for ch in w:
        out |= 1 << (ord(ch) & 31)
    return out


@lru_cache(100_000)
def _is_near(t: str, words: frozenset[str]) -> bool:
    """Whether t is at most one typing error from one of the words; one error changes at most two kinds of letters."""
    mine = _letters(t)
    return any(abs(len(t) - len(w)) <= 1 and (_letters(w) ^ mine).bit_count() <= 2 and typing_distance(t, w, 1) <= 1 for w in words)


def most_errors(x: int, y: int) -> int:
    """The typing errors with which words of x and y letters are at least MIN_SIMILARITY alike."""
    return min(max(x, y) * (100 - round(100 * MIN_SIMILARITY)) // 100, 2 if min(x, y) >= LONG_WORD else 1)


@lru_cache(1000)
def most_broken(n: int) -> int:
    """How many of a word's n padded grams the typing errors of a word alike break at most.

    A letter put in breaks Q - 1 of them, one left out or mistyped Q, two swapped Q + 1.
    The other word is up to two letters longer or shorter, which takes as many errors.
    """
    out = 0
    for longer in range(-2, 3):
        e = most_errors(n, n + longer)
        if e >= abs(longer):
            out = max(out, abs(longer) * (Q if longer < 0 else Q - 1) + (e - abs(longer)) * (Q + 1))
    return out


def bucket_of(gram: str) -> int:
    return crc32(gram.encode()) % GRAM_BUCKETS


def _grams(nodes: DataFrame, *others: Column) -> DataFrame:
    """(others, g): each gram of each rare token."""
    word = nodes.where("rare <> ''").select(*others, F.explode(F.split("rare", " ")).alias("w")).withColumn("p", F.concat(F.lit("^"), "w", F.lit("$"))).drop("w")
    gram = F.transform(F.sequence(F.lit(1), F.length("p") - (Q - 1)), lambda i: F.substring(F.col("p"), i, F.lit(Q)))
    return word.withColumn("g", F.explode(gram)).drop("p")


def letters_of(letters: Column) -> Column:
    """The letters by which a node is keyed, one a row; a firm has one empty one."""
    return F.explode(F.when(letters == "", F.array(F.lit(""))).otherwise(F.split(letters, "")))


def join_key(letter: str, key: str) -> Column:
    return F.xxhash64("block", letter, key)


def hot_keys(nodes: DataFrame, n_grams: int) -> list[int]:
    """Hashes of join keys under which at least HOT_SHARE of the grams may lie, whichever are in a prefix; at most 1 / HOT_SHARE + 1.

    No more nodes lie under a key than there are in its block, so blocks are looked at first.
    """
    blocks = nodes.where("rare <> ''").select(F.xxhash64("block").alias("block"), letters_of(F.col("letters")).alias("letter"), F.size(F.split("rare", " ")).alias("n"), "rare")
    largest = blocks.groupBy("block", "letter").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest < HOT_SHARE * n_grams:
        return []
    keyed = _grams(blocks, F.col("block"), F.col("letter"), F.col("n"))
    return heavy_hashes(keyed.withColumn("k", F.concat_ws(" ", "n", "g")).select(join_key("letter", "k").alias("key")), [F.col("key")], HOT_SHARE)


def gram_counts(nodes: DataFrame) -> np.ndarray:
    """How often the grams of all nodes' rare tokens fall into each of GRAM_BUCKETS buckets, which is what bounds it."""
    gram = _grams(nodes)
    counts = np.zeros(GRAM_BUCKETS, dtype=np.int64)
    for b, n in gram.groupBy(F.pmod(F.crc32("g"), F.lit(GRAM_BUCKETS)).alias("b")).count().collect():
        counts[b] = n
    return counts


class Ranks(dict):
    """Places of grams in the common order, rarest first, worked out as they are asked for."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.tolist()

    def __missing__(self, g: str) -> tuple[int, str]:
        self[g] = out = (self.counts[bucket_of(g)], g)
        return out


def prefix(t: str, ranks: Ranks) -> list[tuple[str, int]]:
    """(gram, position) of the rarest grams of a token: one more than typing errors break.

    Two tokens that are at least MIN_SIMILARITY alike by typing distance share one of them,
    at positions no more than two apart: of either token's prefix one gram stays whole,
    and of the two that stay the one that comes first in the common order is in both.
    """
    padded, k = f"^{t}$", most_broken(len(t)) + 1
    if k == 1:  # too short to be mistyped
        return []
    order = sorted((ranks[padded[i : i + Q]], i) for i in range(len(t)))
    while k < len(order) and order[k][0] == order[k - 1][0]:
        k += 1
    return [(r[1], i) for r, i in order[:k]]


def plain_keys(tokens: Column, n: Column) -> Column:
    """Keys by which names meet without a gram: the joined name, and of names of several tokens each of these.

    m typed as rn counts as one error however often, so words meet with m written for rn.
    """
    plain = lambda c: F.replace(c, F.lit("rn"), F.lit("m"))
    joined = F.array(F.concat(F.lit("= "), plain(F.array_join(tokens, ""))))
    return F.when(n == 1, joined).otherwise(F.concat(joined, F.transform(tokens, lambda t: F.concat(n.cast("string"), F.lit("= "), plain(t)))))


def kinds_of(token: Column) -> Column:
    """The kinds of letters of a token as bits; kinds may share one."""
    bits = F.transform(F.split(token, ""), lambda c: F.call_function("shiftleft", F.lit(1), F.ascii(c).bitwiseAND(F.lit(31))))
    return F.aggregate(bits, F.lit(0), lambda a, x: a.bitwiseOR(x))


def keyed_nodes(nodes: DataFrame, counts: np.ndarray) -> DataFrame:
    """(key, node, token, kinds, at): two nodes that ``similarity`` accepts share a key, see ``may_be_alike``.

    Names of equally many tokens have a pair of tokens that is at least as alike as the
    names on average, and meet by a gram of their prefixes; others must be the same when
    joined. A person's node is keyed by each of its letters.
    """

    @F.pandas_udf("array<string>")
    def grams(words: pd.Series) -> pd.Series:
        ranks = Ranks(counts)
        return pd.Series([[f"{g}{i}" for g, i in prefix(t, ranks)] for t in words], dtype=object)

    split = F.split("rare", " ")
    named = nodes.where("rare <> ''").select("node", F.xxhash64("block").alias("block"), "letters", split.alias("words"), F.size(split).alias("n"))
    words = named.select("node", "block", "letters", "n", F.explode(F.array_distinct("words")).alias("token"))
    # the outer explode keeps Spark from asking for the grams a second time, to see whether there are any
    held = words.select("*", grams("token").alias("grams"), kinds_of(F.col("token")).alias("kinds")).withColumn("g", F.explode_outer("grams")).where("g IS NOT NULL")
    by_gram = held.select("node", "block", "letters", "token", "kinds", F.concat_ws(" ", "n", F.substring("g", 1, Q)).alias("k"), F.substring("g", Q + 1, 9).cast("int").alias("at"))
    plain = named.select("node", "block", "letters", F.lit("").alias("token"), F.lit(0).alias("kinds"), F.explode(plain_keys(F.col("words"), F.col("n"))).alias("k"), F.lit(-1).alias("at"))
    lettered = by_gram.unionByName(plain).withColumn("letter", letters_of(F.col("letters")))
    return lettered.select(join_key("letter", "k").alias("key"), "node", "token", "kinds", "at")


def may_be_alike(a: str, b: str) -> Column:
    """Whether tokens that share a gram can be alike, of columns with these prefixes: exact bounds.

    An error shifts by one place, changes two kinds of letters, and is two plain edits, as a swap is.
    """
    of = lambda c: (F.col(a + c), F.col(b + c))
    (s, t), (i, j), (x, y) = of("token"), of("at"), of("kinds")
    longer = F.greatest(F.length(s), F.length(t))
    edits = F.levenshtein(s, t, 4)  # -1 for more
    near = (F.abs(i - j) <= 2) & (F.abs(F.length(s) - F.length(t)) <= 2) & (F.bit_count(x.bitwiseXOR(y)) <= F.when(longer >= 10, 4).otherwise(2))
    return (i < 0) | (near & (edits >= 0) & ((edits <= 2) | (longer >= 10)))


def similarity(a: list[str], b: list[str], wa: list[float], wb: list[float]) -> float:
    """Soft weighted similarity of two lists of tokens with their weights; 0 if a token has no partner.

    Tokens are matched one to one by typing distance; each pair weighs as its rarer token.
    """
    if a == b:
        return 1.0
    if len(a) != len(b) or len(wa) != len(a) or len(wb) != len(b):
        return 1.0 if "".join(a) == "".join(b) else 0.0
    if len(a) == 1:
        most = 2 if min(len(a[0]), len(b[0])) >= LONG_WORD else 1
        d = typing_distance(a[0], b[0], most)
        return 1 - d / max(len(a[0]), len(b[0])) if d <= most else 0.0
    left, right, got, all_ = list(a), list(b), 0.0, 0.0
    pairs = sorted((typing_distance(x, y, 2 if min(len(x), len(y)) >= LONG_WORD else 1), i, j) for i, x in enumerate(a) for j, y in enumerate(b))
    for d, i, j in pairs:
        if left[i] is None or right[j] is None:
            continue
        x, y = left[i], right[j]
        if d > (2 if min(len(x), len(y)) >= LONG_WORD else 1):
            return 0.0
        w = max(wa[i], wb[j])
        got, all_ = got + w * (1 - d / max(len(x), len(y))), all_ + w
        left[i] = right[j] = None
    return got / all_ if all_ else 1.0


FORM = "block string, given string, letters string, middle string, rare string"


def usable_names(*tables: DataFrame) -> DataFrame:
    """(id, tokens) of the distinct names that are no stand-ins and not cut short; tokens are joined by blanks."""
    rows = tables[0].select("id", "name")
    for t in tables[1:]:
        rows = rows.unionByName(t.select("id", "name"))
    lines = name_lines(rows.where("id <> ''"), [F.count(F.lit(1)).alias("n")]).where("NOT stand_in AND NOT cut_short")

    def split(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "tokens": [" ".join(tokens(n)) for n in pdf["name"]]})

    return lines.select("id", "name").mapInPandas(split, "id string, tokens string")


def word_counts(names: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """(common, frequent): words in at least COMMON_SHARE and SHORT_SHARE of the names, with their counts.

    There are at most (words in a name) / share of them, whatever the data.
    """
    words = names.select(F.explode(F.array_distinct(F.split("tokens", " "))).alias("w"))
    total = names.count()
    held = words.groupBy("w").count().where(F.col("count") >= max(SHORT_LEAST, SHORT_SHARE * total)).collect()
    frequent = {r[0]: r[1] for r in held}
    return {w: n for w, n in frequent.items() if n >= max(COMMON_LEAST, COMMON_SHARE * total)}, frequent


def learn(names: DataFrame, common: dict[str, int], frequent: dict[str, int]) -> Lexicon:
    """Short forms and given names, from how names that are alike but for one word differ.

    Names of one id that agree in all other words spell the same thing in two ways; in each
    such group the least frequent word stands for the most frequent one, so no pairs are made. A word is a
    short form if it is rarer than its partner, has it in most of its groups, and isn't a
    mistyped spelling of it. A common word is a given name if it is found cut to its first
    letter: in names, of whatever ids, that agree in all other words, an uncommon one among them.
    """
    order = sorted(frequent, key=lambda w: (-frequent[w], w))
    number = {w: i for i, w in enumerate(order)}
    schema = "own bigint, every bigint, certain boolean, word bigint, letter bigint"

    def letter_of(w: str) -> int:
        return ord(w[0]) & 31

    def digest(text: str) -> int:
        return xxhash.xxh3_64_intdigest(text) - 2**63

    def holes(batches):
        for pdf in batches:
            out = []
            for i, s in zip(pdf["id"], pdf["tokens"]):
                words = sorted(t for t in s.split() if t not in _LEGAL and t not in _JOINING)
                if len(words) < 2:
                    continue
                uncommon = sum(len(t) > 1 and t not in common and not t.isdigit() for t in words)
                for k, w in enumerate(words):
                    if len(w) == 1 and uncommon and w.isalpha() or len(w) > 1 and w in number and not w.isdigit():
                        rest = " ".join(words[:k] + words[k + 1 :])
                        if len(w) == 1:
                            said = True, None, 1 << letter_of(w)
                        else:
                            said = uncommon > (w not in common), number[w] * 32 + letter_of(w), 0
                        out.append((digest(f"{i}\n{rest}"), digest(rest), *said))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")]).astype({"word": "Int64"})

    # a group is the names of an id, or of all ids, that agree in all words but one; words go by number, most frequent first
    own, any_ = (F.struct(F.lit(c == "own").alias("own"), F.col(c).alias("key")) for c in ("own", "every"))
    keyed = names.mapInPandas(holes, schema).select(F.explode(F.when(F.col("certain"), F.array(own, any_)).otherwise(F.array(own))).alias("g"), "word", "letter")
    groups = keyed.groupBy("g.own", "g.key").agg(F.min("word").alias("top"), F.max("word").alias("low"), F.bit_or("letter").alias("letters"))
    cut_short = F.col("letters").bitwiseAND(F.expr("shiftleft(1L, CAST(top & 31 AS INT))")) != 0
    said = groups.where(F.when(F.col("own"), F.col("low") > F.col("top")).otherwise(cut_short))
    pairs = said.groupBy(F.when(F.col("own"), F.col("low")).otherwise(F.lit(-1) - F.col("top")).alias("w"), "top").agg(F.count(F.lit(1)).alias("n"))
    best = pairs.groupBy("w").agg(F.max(F.struct("n", "top")).alias("b"), F.sum("n").alias("groups")).select("w", "b.n", "b.top", "groups")
    short, count = {}, {}
    for r in best.collect():  # at most two for each frequent word
        y = order[r.top // 32]
        if r.w < 0:
            count[y] = r.n
            continue
        w = order[r.w // 32]
        if y in common and frequent[w] < frequent[y] and r.n >= max(ALTERNATE_SHARE * frequent[w], MOST_GROUPS * r.groups):
            if typing_distance(w, y, 2) > (2 if min(len(w), len(y)) >= 8 else 1):
                short[w] = y
    for w, y in short.items():
        if w in count:
            count[y] = count.get(y, 0) + count[w]
    return Lexicon({k: short.get(v, v) for k, v in short.items()}, frozenset(w for w, n in count.items() if w in common and w not in short and n >= GIVEN_SHARE * common[w]))


def forms_of(names: DataFrame, common: dict[str, int], lexicon: Lexicon = USUAL) -> DataFrame:
    """(id, node, block, given, letters, middle, rare) of each name; node is the hash of the canonical form."""

    def canon(batches):
        made = Canon(common, lexicon)
        for pdf in batches:
            rows = [
                (i, f.block, f.given, "".join(f.letters), f.middle, " ".join(f.rare))
                for i, n in zip(pdf["id"], pdf["tokens"])
                if (f := made.form_of(n.split()))
            ]
            yield pd.DataFrame(rows, columns=["id", *(c.split()[0] for c in FORM.split(", "))])

    return names.mapInPandas(canon, "id string, " + FORM).withColumn("node", F.xxhash64("block", "given", "letters", "middle", "rare"))


def similar_nodes(nodes: DataFrame) -> DataFrame:
    """(a, b, weak, a_given, b_given) of node pairs that name the same; weak: one has an initial for the other's given name.

    nodes: forms, distinct by node.
    """

    named = nodes.where("rare <> ''")
    counts = gram_counts(nodes)

    keyed = keyed_nodes(nodes, counts)
    side = lambda s: keyed.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "token", "kinds", "at")])
    met = salted_join(side("a"), side("b"), "key", F.col("a_node"), hot_keys(nodes, int(counts.sum()))).where(F.col("a_node") < F.col("b_node"))
    met = met.where(may_be_alike("a_", "b_")).select("a_node", "b_node").distinct()
    of = lambda s: named.select(*[F.col(c).alias(f"{s}_{c}") for c in ("node", "given", "middle", "rare")])
    given_ok = (F.col("a_given") == F.col("b_given")) | (F.col("a_given") == "") | (F.col("b_given") == "")
    middle_ok = (F.col("a_middle") == F.col("b_middle")) | (F.col("a_middle") == "") | (F.col("b_middle") == "")
    close = met.join(by_merge(of("a")), "a_node").join(by_merge(of("b")), "b_node").where(given_ok & middle_ok)
    close = close.select(*[F.col(f"{s}_{c}") for s in "ab" for c in ("node", "given", "rare")])
    # a single token's weight falls out of the similarity; only names of several need the words' frequencies
    parts = nodes.where("rare LIKE '% %'").select("node", F.posexplode(F.split("rare", " ")).alias("k", "w"))
    every = nodes.select(F.explode(F.split("rare", " ")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    weights = parts.join(by_merge(every), "w").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "df"))).alias("s"))
    weight = lambda s: weights.select(F.col("node").alias(f"{s}_node"), F.col("s.df").alias(f"{s}_df"))
    total = nodes.count()

    @F.pandas_udf("double")
    def verify(a: pd.Series, b: pd.Series, da: pd.Series, db: pd.Series) -> pd.Series:
        idf = lambda df: [1.0] if df is None else [math.log((total + 1) / n) for n in df]
        return pd.Series([similarity(x.split(), y.split(), idf(u), idf(v)) for x, y, u, v in zip(a, b, da, db)], dtype="float64")

    both = close.join(by_merge(weight("a")), "a_node", "left").join(by_merge(weight("b")), "b_node", "left")
    weak = (F.col("a_given") != F.col("b_given")).alias("weak")
    return both.where(verify("a_rare", "b_rare", "a_df", "b_df") >= MIN_SIMILARITY).select(
        F.col("a_node").alias("a"), F.col("b_node").alias("b"), weak, "a_given", "b_given"
    )


def accepted(pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs but for weak ones whose initial could stand for several given names."""
    strong = pairs.where("NOT weak").select("a", "b")
    initial = F.when(F.col("a_given") == "", F.col("a")).otherwise(F.col("b"))
    weak = pairs.where("weak").select(initial.alias("short"), F.when(F.col("a_given") == "", F.col("b")).otherwise(F.col("a")).alias("full"), F.concat("a_given", "b_given").alias("given"))
    one = weak.groupBy("short").agg(F.min("given").alias("lo"), F.max("given").alias("hi")).where("lo = hi").select("short")
    return strong.unionByName(weak.join(by_merge(one), "short", "left_semi").select(F.col("short").alias("a"), F.col("full").alias("b")))


def _linked(*tables: DataFrame, usual: Lexicon = USUAL) -> tuple[DataFrame, DataFrame]:
    """(spoken, found): (id, node) of all ids with a usable name, and (vertex, component) of those that are linked."""
    names = cut(usable_names(*tables))
    common, frequent = word_counts(names)
    forms = cut(forms_of(names, common, learn(names, common, frequent).with_usual(usual)))
    release(names)
    # a given name says more than an initial: an id that has one doesn't speak through its initials
    short = (F.col("given") == "") & (F.col("letters") != "")
    full = forms.where("given <> ''").select("id").distinct()
    alone = forms.where(short).select("id", "node").join(by_merge(full), "id", "left_anti")
    spoken = cut(forms.where(~short).select("id", "node").unionByName(alone))
    nodes = cut(forms.drop("id").distinct())
    release(forms)
    similar = cut(similar_nodes(nodes))
    release(nodes)
    leader = cut(spoken.groupBy("node").agg(F.min("id").alias("leader")))
    same = spoken.join(by_merge(leader), "node").where("id <> leader").select(F.col("id").alias("u"), F.col("leader").alias("v"))
    first = leader.select(F.col("node").alias("a"), F.col("leader").alias("u"))
    second = leader.select(F.col("node").alias("b"), F.col("leader").alias("v"))
    near = accepted(similar).join(by_merge(first), "a").join(by_merge(second), "b").where("u <> v").select("u", "v")
    found = components(same.unionByName(near))
    release(similar, leader)
    return spoken, found


def groups(*tables: DataFrame, usual: Lexicon = USUAL) -> DataFrame:
    """(id, group_id) of every id with a usable name; group_id is the smallest id of the group."""
    spoken, found = _linked(*tables, usual=usual)
    return spoken.select("id").distinct().join(by_merge(found), F.col("id") == F.col("vertex"), "left").select(
        "id", F.coalesce("component", "id").alias("group_id")
    )


def linked(*tables: DataFrame, usual: Lexicon = USUAL) -> DataFrame:
    """groups without the ids that are alone in theirs."""
    spoken, found = _linked(*tables, usual=usual)
    release(spoken)
    return found.select(F.col("vertex").alias("id"), F.col("component").alias("group_id"))


def pairs_of(grouped: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of all ids in a group: the form that TESTDATA.md asks for. A large group is dealt to several tasks."""
    a = grouped.select("group_id", F.col("id").alias("id_a"))
    b = grouped.select("group_id", F.col("id").alias("id_b"))
    heavy = heavy_hashes(a, [F.col("group_id")], LARGE_SHARE)
    return salted_join(a, b, "group_id", F.col("id_a"), heavy).where("id_a < id_b").select("id_a", "id_b")
