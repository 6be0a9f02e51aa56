"""Has this key been seen before? Fingerprint filters of sealed batches.

Earlier keys are kept as immutable xor filters: three-slot tables of fingerprints that
are built by peeling a random hypergraph, at 1.23 x ``bits`` bits a key, with no false
negatives and a false positive rate of 2^-bits a filter. Each sealed batch (a
*generation*) gets one filter for each shard of the key space; a shard holds about
``SHARD_KEYS`` distinct keys, so no task or filter grows with the data or with the number
of rows of one key.

An arriving row is seen if a filter of an earlier generation has its key, or if its key
occurred earlier within its own, still open batch. Within a batch keys are compared as they
are, which is exact. Filters know keys by a 64-bit hash: a new key is taken for a seen one if
a filter errs, or if its hash is that of one of the n earlier keys. So the rate of wrong
answers compounds over the generations probed: 1 - (1 - 2^-bits)^g (1 - 2^-64)^n. A seen
key is always found.

Null and empty keys are no keys: never stored, never seen. Repeated rows count as rows
that arrive one after the other. Rows without arrival time arrive last. Empty tables give
empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltwork.session import cut

BITS = 24
MEASURED_BITS = 8  # so few that errors can be counted
SHARD_KEYS = 50_000
SLOTS_A_KEY = 1.23
FILTER_SCHEMA = "generation int, shard int, seed bigint, segment int, n_keys bigint, bits int, slots binary"


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; uint64 arithmetic wraps."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _places(keys: np.ndarray, seed: int, segment: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key, one in each segment, and its fingerprint."""
    h = _mix(keys + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
    g = _mix(h ^ np.uint64(0xD6E8FEB86659FD93))
    low = np.uint64(0xFFFFFFFF)
    size = np.uint64(segment)
    parts = [h & low, h >> np.uint64(32), g & low]
    slots = np.stack([((p * size) >> np.uint64(32)).astype(np.int64) + i * segment for i, p in enumerate(parts)])
    prints = _mix(g) >> np.uint64(64 - bits)
    return slots, prints


def build_filter(keys: np.ndarray, bits: int = BITS) -> tuple[int, int, np.ndarray]:
    """(seed, segment, slots) of a filter over distinct 64-bit keys, by peeling in rounds; bits is 8, 16, 24 or 32.

    A round takes all slots that hold one remaining key. The keys of a round don't share
    their chosen slots, so a round is assigned at once, last round first.
    """
    n = len(keys)
    segment = max(2, int(np.ceil((SLOTS_A_KEY * n + 32) / 3)))
    for seed in range(1, 200):
        slots, prints = _places(keys, seed, segment, bits)
        count = np.bincount(slots.ravel(), minlength=3 * segment)
        owner = np.zeros(3 * segment, dtype=np.int64)
        for row in slots:
            np.bitwise_xor.at(owner, row, np.arange(n))
        rounds, peeled = [], 0
        free = np.flatnonzero(count == 1)
        while len(free):
            who, at = np.unique(owner[free], return_index=True)
            rounds.append((who, free[at]))
            peeled += len(who)
            touched = slots[:, who]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, who)
            near = np.unique(touched)
            free = near[count[near] == 1]
        if peeled == n:
            table = np.zeros(3 * segment, dtype=np.uint64)
            for who, at in reversed(rounds):
                a, b, c = slots[:, who]
                table[at] = prints[who] ^ table[a] ^ table[b] ^ table[c]
            return seed, segment, table.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : bits // 8]
    raise RuntimeError("no seed peels these keys: they aren't distinct")


def probe_filter(keys: np.ndarray, seed: int, segment: int, bits: int, slots: bytes) -> np.ndarray:
    wide = np.zeros((3 * segment, 8), dtype=np.uint8)
    wide[:, : bits // 8] = np.frombuffer(slots, dtype=np.uint8).reshape(3 * segment, -1)
    table = wide.view("<u8").ravel()
    (a, b, c), prints = _places(keys, seed, segment, bits)
    return table[a] ^ table[b] ^ table[c] == prints


def error_rate(generations: int, bits: int = BITS, keys: int = 0) -> float:
    """The rate of wrong answers for a new key after so many generations of so many keys together."""
    return float(-np.expm1(generations * np.log1p(-(2.0**-bits)) + keys * np.log1p(-(2.0**-64))))


def key_hash(key: Column) -> Column:
    return F.xxhash64(key)


def build_filters(keys: DataFrame, shards: int, bits: int = BITS) -> DataFrame:
    """FILTER_SCHEMA rows for keys (generation int, h bigint); repeated keys count once."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h = pdf["h"].to_numpy(dtype=np.int64).view(np.uint64)
        seed, segment, slots = build_filter(h, bits)
        g, s = int(pdf["generation"].iloc[0]), int(pdf["shard"].iloc[0])
        return pd.DataFrame([[g, s, seed, segment, len(h), bits, slots.tobytes()]], columns=[c.split()[0] for c in FILTER_SCHEMA.split(", ")])

    sharded = keys.select("generation", "h").distinct().withColumn("shard", shard_of(F.col("h"), shards))
    return sharded.groupBy("generation", "shard").applyInPandas(build, FILTER_SCHEMA)


def shard_of(h: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(h), F.lit(shards)).cast("int")


def probe(asked: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """asked (generation int, h bigint, distinct) with n_hits: filters of earlier generations that have h."""

    def check(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        hits = np.zeros(len(left), dtype=np.int32)
        h = left["h"].to_numpy(dtype=np.int64).view(np.uint64)
        mine = left["generation"].to_numpy()
        for f in right.itertuples():
            later = np.flatnonzero(mine > f.generation)
            if len(later):
                hits[later] += probe_filter(h[later], f.seed, f.segment, f.bits, f.slots)
        return pd.DataFrame({"generation": left["generation"], "h": left["h"], "n_hits": hits})

    sharded = asked.select("generation", "h", shard_of(F.col("h"), shards).alias("shard"))
    return sharded.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(check, "generation int, h bigint, n_hits int")


def generations(rows: DataFrame, arrived: str, n: int) -> DataFrame:
    """rows with a generation from 1 to n: equal shares of the arrival times. Any cut gives the same answers."""
    at = F.unix_micros(F.col(arrived).cast("timestamp"))
    cuts = rows.agg(F.percentile_approx(at, [i / n for i in range(1, n)], 1000)).first()[0] if n > 1 else []
    later = [F.when(at > c, 1).otherwise(0) for c in sorted(set(cuts or []))]
    number = sum(later, F.lit(1))
    return rows.withColumn("generation", F.when(at.isNull(), F.lit(len(later) + 1)).otherwise(number).cast("int"))


def seen_before(
    rows: DataFrame, earlier: DataFrame, key: str, row_id: str, arrived: str, n_batches: int = 8, bits: int = BITS
) -> tuple[DataFrame, DataFrame]:
    """(found, filters): ids of the rows whose key occurred before, and the filters that were probed.

    earlier: the keys sealed before any row arrived, generation 0. Rows of one key are
    first brought to one line for each batch, with the first row in it, so that a key
    that holds a third of all rows costs no more than another. All rows with a key are
    found but the first of the batch in which no earlier filter has it; row_id is unique.
    """
    known = rows.where((F.col(key) != "")).select(F.col(row_id).alias("row_id"), F.col(arrived).alias("arrived"), F.col(key).alias("key"))
    batched = generations(known, "arrived", n_batches)
    first = F.min(F.struct(F.col("arrived").isNull(), F.col("arrived"), F.col("row_id"))).getField("row_id")
    lines = cut(batched.groupBy("generation", "key").agg(first.alias("first_row")).select("generation", key_hash(F.col("key")).alias("h"), "first_row"))
    sealed = earlier.where(F.col(key) != "").select(F.lit(0).alias("generation"), key_hash(F.col(key)).alias("h"))
    keys = lines.select("generation", "h").unionByName(sealed)
    shards = max(1, -(-keys.count() // SHARD_KEYS))
    filters = cut(build_filters(keys, shards, bits))
    fresh = probe(lines.select("generation", "h").distinct(), filters, shards).where("n_hits = 0").join(lines, ["generation", "h"])
    found = known.select("row_id").join(fresh.select(F.col("first_row").alias("row_id")), "row_id", "left_anti")
    return found.select(F.col("row_id").alias(row_id)), filters


def error_report(filters: DataFrame, trials: int = 4) -> DataFrame:
    """For each generation: keys, bits a key, stated rates, and the rate measured with keys that aren't stored.

    The rate of filters of MEASURED_BITS can be told from 0 with few keys; that of wider ones follows the same law.

    Absent keys are drawn for each filter: as many as trials x its keys, from a counter
    that is mixed; an absent key equals a stored one in 2^-64 of the cases.
    """

    def measure(batches):
        for pdf in batches:
            out = []
            for f in pdf.itertuples():
                n = max(1000, trials * f.n_keys)
                absent = _mix(np.arange(n, dtype=np.uint64) + np.uint64((f.generation * 1_000_003 + f.shard + 1) << 24))
                wrong = int(probe_filter(absent, f.seed, f.segment, f.bits, f.slots).sum())
                out.append((f.generation, f.bits, f.n_keys, len(f.slots), n, wrong))
            yield pd.DataFrame(out, columns=["generation", "bits", "n_keys", "n_bytes", "asked", "wrong"])

    measured = filters.mapInPandas(measure, "generation int, bits int, n_keys bigint, n_bytes bigint, asked bigint, wrong bigint")
    by = measured.groupBy("generation", "bits").agg(*[F.sum(c).alias(c) for c in ("n_keys", "n_bytes", "asked", "wrong")])
    upto = Window.orderBy("generation").rowsBetween(Window.unboundedPreceding, 0)  # one row for each generation
    single = F.pow(F.lit(2.0), -F.col("bits"))
    hashes = F.sum("n_keys").over(upto) * F.log1p(F.lit(-(2.0**-64)))
    return by.select(
        "generation",
        "bits",
        "n_keys",
        (F.col("n_bytes") * 8 / F.col("n_keys")).alias("bits_a_key"),
        single.alias("stated_rate"),
        (-F.expm1(F.sum(F.log1p(-single)).over(upto) + hashes)).alias("compounded_rate"),
        (F.col("wrong") / F.col("asked")).alias("measured_rate"),
        "asked",
        "wrong",
    )
