"""Evaluation texts leaking into training text.

1. Texts become words: entities decoded, tags, accents, invisible characters, case and
   punctuation dropped.
2. Every run of SEED_WORDS words of a test item is a seed, of fewer words in items so short
   that a leak needn't leave one whole. The seeds are joined with the corpus where the
   texts are read: items are held by every task in blocks of at most BLOCK_WORDS words, so
   that neither texts nor seeds are ever shuffled, however common a seed is. More items
   make more blocks, each of which reads the corpus once.
3. A pair of document and item goes on if its seeds leave a leak possible. That is exact:
   either they cover as many words as a whole item does with CHANGED_SHARE of it changed
   or added, or RUN_WORDS consecutive words can be read off the document at a seed, across
   one remark of up to REMARK_WORDS words. Seeds that many items or documents share, such as
   templates, rarely pass this; of rare ones the pairs that remain are made.
4. Smith-Waterman alignment of the words, with an affine gap on the document's side so
   that a remark costs little, gives the longest run of the item's words, the share of it
   that is covered, and the words changed or added.

Null and empty texts hold nothing. Repeated rows give one pair. Very long texts are
aligned in windows around their seeds only, and seeded whole.
"""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED_WORDS = 5
RUN_WORDS = 12
CHANGED_SHARE = 0.15
REMARK_WORDS = 10
BLOCK_WORDS = 2_000_000
PADDING = RUN_WORDS + REMARK_WORDS
MATCH, MISS, SKIP, OPEN, EXTEND = 2.0, -1.0, -1.0, -1.0, -0.05

_TAG = regex.compile(r"</?[a-zA-Z!][^<>]{0,300}>")
_WORD = regex.compile(r"[^\W_]+")
_PLAIN_WORD = re.compile(r"[a-z0-9]+")
_HIDDEN = regex.compile(r"[\p{M}\p{Cf}]+")


def plain_words(text: str | None) -> list[str]:
    """The text's words."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if text.isascii():
        return _PLAIN_WORD.findall(text.lower())
    return _WORD.findall(_HIDDEN.sub("", unicodedata.normalize("NFKD", text)).casefold())


def align(item: np.ndarray, doc: np.ndarray) -> tuple[float, int, int, int]:
    """(score, longest run, changed, added) of the best local alignment of two arrays of word numbers.

    A run is of consecutive words of the item, found in order, which at most one remark
    of up to REMARK_WORDS interrupts. changed counts the item's words that aren't found;
    added the words put in, of which a remark counts as one.
    """
    m, n = len(item), len(doc)
    best, base = np.zeros((m + 1, n + 1)), np.zeros((m + 1, n + 1))
    ramp = -EXTEND * np.arange(n + 1)
    gain = np.where(item[:, None] == doc[None, :], MATCH, MISS)
    for i in range(1, m + 1):
        row = base[i]
        np.maximum(best[i - 1, :-1] + gain[i - 1], 0, out=row[1:])
        np.maximum(row[1:], best[i - 1, 1:] + SKIP, out=row[1:])
        gap = np.maximum.accumulate(row + ramp)[:-1] - ramp[1:] + OPEN
        best[i] = row
        np.maximum(best[i, 1:], gap, out=best[i, 1:])
    i, j = divmod(int(best.argmax()), n + 1)
    score, last = float(best[i, j]), i
    pairs: list[tuple[int, int]] = []
    changed = added = 0
    while i and j and best[i, j] > 1e-9:
        here, same = best[i, j], doc[j - 1] == item[i - 1]
        if abs(here - (best[i - 1, j - 1] + (MATCH if same else MISS))) < 1e-6:
            i, j = i - 1, j - 1
            if same:
                pairs.append((i, j))
            else:
                changed += 1
        elif abs(here - (best[i - 1, j] + SKIP)) < 1e-6:
            i, changed = i - 1, changed + 1
        else:
            k = int((base[i, :j] + ramp[:j]).argmax())
            added += j - k if j - k <= 2 or j - k > REMARK_WORDS else 1
            j = k
    changed += i + (m - last)
    pairs.reverse()
    longest = run = since = 0
    for at, (a, b) in enumerate(pairs):
        jump = b - pairs[at - 1][1] - 1 if at and a == pairs[at - 1][0] + 1 else -1
        if jump == 0:
            run, since = run + 1, since + 1
        elif 0 < jump <= REMARK_WORDS:
            # one interruption: what came before it since the last one still counts
            run, since = since + 1, 1
        else:
            run = since = 1
        longest = max(longest, run)
    return score, longest, changed, added


@dataclass
class Item:
    """A test item as word numbers, with what a leak of it leaves at least.

    changes: the words that may be changed or added in a whole leak. seed: words of a seed.
    cover: words that the seeds of a whole leak cover. Of c changes at most c + 1 runs are
    left, of all words but c; the longest holds a seed, and each other one loses at most
    seed - 1 words.
    """

    item_id: int
    words: np.ndarray
    changes: int = field(init=False)
    seed: int = field(init=False)
    cover: int = field(init=False)

    def __post_init__(self) -> None:
        m = len(self.words)
        self.changes = int(CHANGED_SHARE * m + 1e-9)
        whole = m - self.changes
        self.seed = max(1, min(SEED_WORDS, -(-whole // (self.changes + 1))))
        self.cover = max(self.seed, whole - (self.seed - 1) * self.changes)


def _hashes(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n word numbers that begin at the places given."""
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(n):
        out = (out + words[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Block:
    """A block of items with its seeds: for each seed length the sorted hashes, and the item and position of each."""

    def __init__(self, texts: list[tuple[int, str]]):
        self.number: dict[str, int] = {}
        self.items: list[Item] = []
        for item_id, text in texts:
            words = plain_words(text)
            if words:
                self.items.append(Item(item_id, np.array([self.number.setdefault(w, len(self.number) + 1) for w in words])))
        self.words = np.concatenate([i.words for i in self.items]) if self.items else np.empty(0, dtype=np.int64)
        self.size, self.seed, self.cover = (np.array([f(i) for i in self.items], dtype=np.int64) for f in (lambda i: len(i.words), lambda i: i.seed, lambda i: i.cover))
        self.start = np.r_[0, np.cumsum(self.size)[:-1]].astype(np.int64)
        self.seeds = {}
        for n in sorted({i.seed for i in self.items}):
            at = [(k, np.arange(len(i.words) - n + 1)) for k, i in enumerate(self.items) if i.seed == n]
            h = np.concatenate([_hashes(self.items[k].words, p, n) for k, p in at])
            order = np.argsort(h, kind="stable")
            owner = np.repeat([k for k, _ in at], [len(p) for _, p in at])[order]
            self.seeds[n] = h[order], owner, np.concatenate([p for _, p in at])[order]

    def hits(self, words: np.ndarray) -> np.ndarray:
        """Rows (item, position in words, position in the item) of all seeds in words, in which 0 is any other word."""
        out = []
        known = np.r_[0, np.cumsum(words > 0)]
        for n, (h, owner, pos) in self.seeds.items():
            if len(words) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            asked = _hashes(words, at, n)
            lo = np.searchsorted(h, asked, side="left")
            many = np.searchsorted(h, asked, side="right") - lo
            some = np.flatnonzero(many)
            at, lo, many = at[some], lo[some], many[some]
            if len(at):
                which = np.repeat(lo - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
                out.append(np.stack([owner[which], np.repeat(at, many), pos[which]], axis=1))
        return np.concatenate(out) if out else np.empty((0, 3), dtype=np.int64)


def _follows(words: np.ndarray, items: np.ndarray, at: np.ndarray, of: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each row, whether the n words at ``at`` of words are those at ``of`` of items."""
    left = np.flatnonzero(words[at] == items[of])
    for k in range(1, int(n.max(initial=0))):
        left = left[(n[left] <= k) | (words[np.minimum(at[left] + k, len(words) - 1)] == items[np.minimum(of[left] + k, len(items) - 1)])]
    out = np.zeros(len(at), dtype=bool)
    out[left] = True
    return out


def _promising(block: Block, words: np.ndarray, group: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Which groups of hits can be a leak: exact, so that nothing that is one is lost.

    hits are sorted by group, which is one document and item, and by the position in the
    item. words holds PADDING zeros at its ends and between documents. Of RUN_WORDS words
    that one remark interrupts, the longer part holds a seed, as it has half of them or
    more; the rest is looked for on the other side of each possible remark.
    """
    item, at, of = hits.T
    first = np.r_[True, np.diff(group) > 0]
    n_seed = block.seed[item]
    step = np.r_[np.where(first[1:], n_seed[:-1], np.minimum(n_seed[:-1], np.diff(of))), n_seed[-1:]]
    covered = np.add.reduceat(step, np.flatnonzero(first))
    good = covered >= block.cover[item[first]]
    order = np.lexsort((at, at - of, group))
    g, item, at, of = group[order], item[order], at[order], of[order]
    begins = np.flatnonzero(np.r_[True, (np.diff(g) > 0) | (np.diff(at - of) != 0) | (np.diff(at) != 1)])
    n = np.diff(np.r_[begins, len(g)]) + block.seed[item[begins]] - 1
    g, item, at, of = g[begins], item[begins], at[begins], of[begins]
    good[g[n >= RUN_WORDS]] = True
    some = np.flatnonzero(~good[g])
    g, item, at, of, n = g[some], item[some], at[some], of[some], n[some]
    rest, start, size = RUN_WORDS - n, block.start[item], block.size[item]
    after, before = np.flatnonzero(of + n + rest <= size), np.flatnonzero(of >= rest)
    for gap in range(1, REMARK_WORDS + 1):
        for rows, there, mine in ((after, at + n + gap, of + n), (before, at - gap - rest, of - rest)):
            hit = _follows(words, block.words, there[rows], (start + mine)[rows], rest[rows])
            good[g[rows[hit]]] = True
    return good


def _windows(hits: np.ndarray, size: int, n: int) -> list[tuple[int, int]]:
    """Stretches of the document around hits, so wide that a whole item with remarks fits in."""
    reach = size + 4 * REMARK_WORDS
    at = np.sort(hits)
    cuts = np.flatnonzero(np.diff(at) > reach)
    begins, ends = np.r_[at[0], at[cuts + 1]], np.r_[at[cuts], at[-1]]
    return [(max(0, int(a) - reach), min(n, int(b) + SEED_WORDS + reach)) for a, b in zip(begins, ends)]


def is_leak(run: int, changed: int, added: int, item: Item) -> bool:
    """RUN_WORDS consecutive words, or the whole item with few words changed or added."""
    return run >= RUN_WORDS or changed + added <= item.changes


LEAKS = "doc_id bigint, item_id bigint, score double, longest_run int, changed int, added int, item_words int"


def find(block: Block, doc_ids: list, texts: list[str | None]) -> list[tuple]:
    """LEAKS rows of some documents: the best alignment of each pair of document and item that is a leak."""
    number, gap = block.number.get, [0] * PADDING
    flat, begins, ends = list(gap), [], []
    for t in texts:
        begins.append(len(flat))
        flat += [number(w, 0) for w in plain_words(t)]
        ends.append(len(flat))
        flat += gap
    words = np.array(flat, dtype=np.int64)
    hits = block.hits(words)
    if not len(hits):
        return []
    doc = np.searchsorted(begins, hits[:, 1], side="right") - 1
    order = np.lexsort((hits[:, 2], hits[:, 0], doc))
    hits, doc = hits[order], doc[order]
    group = np.r_[0, np.cumsum((np.diff(doc) != 0) | (np.diff(hits[:, 0]) != 0))]
    cuts = np.searchsorted(group, np.arange(group[-1] + 2))
    out = []
    for k in np.flatnonzero(_promising(block, words, group, hits)):
        lo, hi = cuts[k], cuts[k + 1]
        d, item = doc[lo], block.items[hits[lo, 0]]
        mine, at = words[begins[d] : ends[d]], hits[lo:hi, 1] - begins[d]
        best = max(
            (align(item.words, mine[a:b]) for a, b in _windows(at, len(item.words), len(mine))),
            key=lambda x: (is_leak(*x[1:], item), x[0]),
        )
        if is_leak(*best[1:], item):
            out.append((doc_ids[d], item.item_id, *best, len(item.words)))
    return out


def leaks(docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """LEAKS rows of all documents that hold an item, or a part of one that counts."""
    some = items.where("text <> '' AND item_id IS NOT NULL").select("item_id", "text").distinct()
    size = some.agg(F.coalesce(F.sum(F.size(F.split(F.col("text"), r"\s+"))), F.lit(0))).first()[0]
    n = max(1, -(-size // block_words))
    texts = docs.where("text <> '' AND doc_id IS NOT NULL").select("doc_id", "text")
    out = None
    for k in range(n):
        mine = some.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "text").collect()  # about block_words words
        block = Block([(r.item_id, r.text) for r in mine])

        def search(batches, block=block):
            for pdf in batches:
                for lo in range(0, len(pdf), 500):
                    part = pdf.iloc[lo : lo + 500]
                    rows = find(block, part["doc_id"].tolist(), part["text"].tolist())
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in LEAKS.split(", ")])

        found = texts.mapInPandas(search, LEAKS)
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("score", "longest_run", (-F.col("changed")).alias("c"), (-F.col("added")).alias("a"), "item_words")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "b.score", "b.longest_run", (-F.col("b.c")).alias("changed"), (-F.col("b.a")).alias("added"), "b.item_words"
    )
