"""Filling containers of fixed capacity with texts: bounded-space online best fit.

Sizes are tokens of a public tokenizer. Texts are dealt to shards by a hash of their id,
about SHARD_TOKENS tokens each; a shard packs its texts in one pass, in the order of
their ids, with at most OPEN_BINS open bins. Open bins are a bitset keyed by free space:
the best fit is its lowest set bit at or above the size, and when one bin too many is
open, the fullest (the lowest bit) closes. A shard's memory is its open bins, and its
waste at the end at most OPEN_BINS bins in SHARD_TOKENS tokens.

A text is split only if it is longer than the capacity: into full containers and a rest
that is packed as other texts are. Null and empty texts have no tokens and are put
nowhere. Kinds with a null capacity, or one below 1, hold nothing. Repeated rows are
packed as often as they occur.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN_BINS = 64
SHARD_TOKENS = 4_000_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECES = "container_kind string, shard int, bin int, doc_id bigint, piece int, n_tokens int"

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a .tiktoken file, kept for each worker."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


STRETCH = 20_000


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """The text in parts of about ``size`` code points, cut before a blank that follows a non-blank.

    The tokenizer's pattern starts a new word there, so the sum of tokens is that of the
    whole text; one very long run without blanks is one part. Encoding in parts keeps
    the encoder's time in proportion to the text.
    """
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and not (text[end] == " " and not text[end - 1].isspace() and end + 1 < len(text) and not text[end + 1].isspace()):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def token_sizes(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of the documents with a text."""

    def sizes(batches):
        enc = encoder(vocabulary)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [sum(len(enc.encode_ordinary(s)) for s in stretches(t)) for t in pdf["text"]]})

    return docs.where("text <> '' AND doc_id IS NOT NULL").select("doc_id", "text").mapInPandas(sizes, "doc_id bigint, n_tokens bigint")


def pack(items: Iterator[tuple[int, int]], capacity: int, open_bins: int = OPEN_BINS) -> Iterator[tuple[int, int, int, int]]:
    """(item, piece, size, bin) for (item, size) pairs, in one pass over them."""
    free_bits, by_free, n_open, n_bins = 0, {}, 0, 0
    for item, size in items:
        piece = 0
        while size > capacity:
            yield item, piece, capacity, n_bins
            n_bins, piece, size = n_bins + 1, piece + 1, size - capacity
        if size == 0:
            continue
        fits = free_bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            held = by_free[free]
            b = held.pop()
            if not held:
                del by_free[free]
                free_bits ^= 1 << free
        else:
            free, b = capacity, n_bins
            n_bins, n_open = n_bins + 1, n_open + 1
        yield item, piece, size, b
        left = free - size
        if left == 0:
            n_open -= 1
            continue
        by_free.setdefault(left, []).append(b)
        free_bits |= 1 << left
        if n_open > open_bins:
            fullest = (free_bits & -free_bits).bit_length() - 1
            by_free[fullest].pop()
            if not by_free[fullest]:
                del by_free[fullest]
                free_bits ^= 1 << fullest
            n_open -= 1


def packed(sizes: DataFrame, kinds: DataFrame, shard_tokens: int = SHARD_TOKENS, open_bins: int = OPEN_BINS) -> DataFrame:
    """PIECES rows: where each piece of each text lies; (container_kind, shard, bin) names a container.

    kinds (container_kind, capacity_tokens) is a small table of settings, which is
    checked: more than 1,000 kinds raise.
    """
    holds = [(r[0], int(r[1])) for r in kinds.where("capacity_tokens >= 1").select("container_kind", "capacity_tokens").limit(1001).collect()]
    if len(holds) > 1000:
        raise ValueError("at most 1000 kinds of containers")
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    by_kind = dict(holds)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, shard = pdf["container_kind"].iloc[0], int(pdf["shard"].iloc[0])
        pdf = pdf.sort_values(["doc_id", "n_tokens"], kind="stable")
        rows = list(pack(zip(pdf["doc_id"].tolist(), pdf["n_tokens"].tolist()), by_kind[kind], open_bins))
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "n_tokens", "bin"])
        return out.assign(container_kind=kind, shard=shard)[[c.split()[0] for c in PIECES.split(", ")]]

    if not holds:
        return sizes.sparkSession.createDataFrame([], PIECES)
    dealt = sizes.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).withColumn(
        "container_kind", F.explode(F.array(*[F.lit(k) for k, _ in holds]))
    )
    return dealt.groupBy("container_kind", "shard").applyInPandas(fill, PIECES)


def fill_report(pieces: DataFrame, kinds: DataFrame) -> DataFrame:
    """(container_kind, capacity_tokens, n_containers, n_pieces, n_tokens, fill): how full the containers are."""
    bins = pieces.groupBy("container_kind", "shard", "bin").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces"))
    sums = bins.groupBy("container_kind").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n_pieces").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens")
    )
    return kinds.join(sums, "container_kind").select(
        "container_kind", "capacity_tokens", "n_containers", "n_pieces", "n_tokens",
        (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill"),
    )
