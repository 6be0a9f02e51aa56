"""Best representative of each duplicate group.

``surviving_rows`` picks, field by field, the row that gives the surviving value under
fixed rules (trust, recency, usability). ``fuse`` weighs the values against each other:
Bayesian fusion with copy detection. Source accuracies and the dependence between
sources are estimated from the values they share, above all the false ones; copied votes
are discounted; the value with the largest posterior survives.

Rows of one id are brought to one line for each distinct value, with a map-side combine,
before anything compares the values of an id. Null and empty ids are no ids. Ties go to
the smallest row id (rules) or the smallest value (fusion). Ids without a usable value
of a field give no line for it. Empty tables give empty results; other columns, whatever
their names, aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltwork.session import cut

USABLE_FROM, USABLE_TO = 946684800, 1767225599

# Stand-ins for a missing name, in lower case. Names without any letter or
# digit are stand-ins too.
STAND_INS = (
    "n/a", "na", "n.a.", "none", "null", "(null)", "<null>", "nil", "no name", "noname", "unknown", "(unknown)", "not known",
    "unnamed", "tbd", "tba", "todo", "test", "xxx", "xx", "x", "missing", "empty", "undefined", "nan", "anonymous", "not available",
)

BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2028\u2029\u202f\u205f\u2060\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200C)))


def usable_epoch(c: Column) -> Column:
    return F.when(c.between(USABLE_FROM, USABLE_TO), c)


def trimmed(name: Column) -> Column:
    return F.btrim(name, F.lit(BLANKS))


def is_stand_in(name: Column) -> Column:
    """Of a trimmed name: blank, a stand-in, or without letters and digits."""
    return F.lower(name).isin(*STAND_INS) | ~name.rlike(r"[\p{L}\p{N}]")


def is_ellipsis(name: Column) -> Column:
    return name.rlike(r"(\.\.\.|…)$")


def name_lines(rows: DataFrame, others: list[Column]) -> DataFrame:
    """One line for each distinct (id, trimmed name), with the aggregates given and the flag cut_short.

    Cut short are names ended by an ellipsis, and proper beginnings of a longer name of
    the same id. In byte order, a beginning of any later name is one of the next name
    too, so one look ahead is enough, and no pairs are built.
    """
    lines = rows.withColumn("name", trimmed(F.col("name"))).groupBy("id", "name").agg(*others)
    lines = lines.withColumn("stand_in", F.col("name").isNull() | is_stand_in(F.col("name")))
    ahead = F.lead("name").over(Window.partitionBy("id", F.col("stand_in"), F.substring("name", 1, 1)).orderBy("name"))
    begins = ~F.col("stand_in") & F.coalesce(ahead.startswith(F.col("name")), F.lit(False))
    return lines.withColumn("cut_short", begins | (~F.col("stand_in") & is_ellipsis(F.col("name"))))


def surviving_rows(company: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, field_name, obs_id) by the fixed rules, for ids with two or more rows.

    sources (import_source, trust) is joined by its cleaned name; the largest trust wins
    if one name is listed twice.
    """
    clean = F.lower(trimmed(F.col("import_source")))
    trust = sources.select(clean.alias("src"), "trust").where("src IS NOT NULL").groupBy("src").agg(F.max("trust").alias("trust"))
    first, last, upd = [usable_epoch(F.col(c)) for c in ("first_seen", "last_seen", "updated_at")]
    sane = F.coalesce(last >= first, F.lit(True))
    by_source = (
        company.where("id <> ''")
        .select(
            "id", "name", "obs_id", F.coalesce(clean, F.lit("")).alias("src"), upd.alias("upd"), F.when(sane, first).alias("first"), F.when(sane, last).alias("last")
        )
        .withColumn("neg", -F.col("obs_id"))
    )
    best = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(c, "neg")))
    # by source too: the few sources' trust is then joined to lines, not to rows
    lines = by_source.withColumn("name", trimmed(F.col("name"))).groupBy("id", "name", "src").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("first").isNotNull(), F.struct("first", "obs_id"))).alias("first"),
        best("last").alias("last"),
        best("upd").alias("upd"),
        F.max(F.struct(F.coalesce("upd", F.lit(-1)).alias("upd"), "neg")).alias("vote"),
    )
    weighed = lines.join(trust, "src", "left").withColumn(
        "vote", F.struct(F.coalesce("trust", F.lit(-(2**62))).alias("trust"), F.col("vote.upd"), F.col("vote.neg"))
    )
    named = name_lines(
        weighed,
        [F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("upd").alias("upd"), F.max("vote").alias("vote")],
    )
    good = ~F.col("stand_in") & ~F.col("cut_short")
    out = (
        named.groupBy("id")
        .agg(
            F.sum("n").alias("n"),
            F.max(F.when(good, F.col("vote"))).alias("vote"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.max("upd").alias("upd"),
        )
        .where("n >= 2")
    )
    picks = F.array(
        F.struct(F.lit("name").alias("field_name"), (-F.col("vote.neg")).alias("obs_id")),
        F.struct(F.lit("first_seen").alias("field_name"), F.col("first.obs_id").alias("obs_id")),
        F.struct(F.lit("last_seen").alias("field_name"), (-F.col("last.neg")).alias("obs_id")),
        F.struct(F.lit("updated_at").alias("field_name"), (-F.col("upd.neg")).alias("obs_id")),
    )
    return out.select("id", F.explode(picks).alias("p")).select("id", "p.field_name", "p.obs_id").where("obs_id IS NOT NULL")


# --- Bayesian fusion ---------------------------------------------------------------

ROUNDS = 5
FIRST_ACCURACY = 0.8
FALSE_VALUES = 20.0  # how many false values an item may have
COPY_RATE = 0.8  # the share of its values that a copier copies
COPY_PRIOR = 0.1
MODEL_NUMBERS = 20_000_000  # fields x sources squared, the size of the model itself: 2,236 sources of 4 fields


def claims(company: DataFrame) -> DataFrame:
    """(id, field_name, value, src): usable values as strings; names as trimmed."""
    clean = F.coalesce(F.lower(trimmed(F.col("import_source"))), F.lit(""))
    name = trimmed(F.col("name"))
    fields = [
        ("name", F.when(~is_stand_in(name) & ~is_ellipsis(name), name)),
        *[(c, usable_epoch(F.col(c)).cast("string")) for c in ("first_seen", "last_seen", "updated_at")],
    ]
    made = F.array(*[F.struct(F.lit(f).alias("field_name"), v.alias("value")) for f, v in fields])
    long = company.where("id <> ''").select("id", clean.alias("src"), F.explode(made).alias("c"))
    return long.select("id", "c.field_name", "c.value", "src").where("value IS NOT NULL")


def _vote_weights(accuracy: np.ndarray) -> np.ndarray:
    a = np.clip(accuracy, 0.02, 0.98)
    return np.log(FALSE_VALUES * a / (1 - a))


def _score(says: np.ndarray, accuracy: np.ndarray, copied: np.ndarray) -> float:
    """The votes of sources that say the same. One's vote counts in so far as it doesn't copy a better one of them."""
    says = says[np.argsort(-accuracy[says], kind="stable")]
    alone = np.tril(1 - COPY_RATE * copied[np.ix_(says, says)], -1)
    alone[np.triu_indices(len(says))] = 1
    return float((_vote_weights(accuracy[says]) * alone.prod(axis=1)).sum())


def _numbers(says: str) -> np.ndarray:
    return np.array(says.split(","), dtype=np.int64)


def _dependence(same_true: np.ndarray, same_false: np.ndarray, differ: np.ndarray, accuracy: np.ndarray) -> np.ndarray:
    """The posterior that two sources depend on each other, from the values they share."""
    a = np.clip(accuracy, 0.02, 0.98)
    mean = (a[:, None] + a[None, :]) / 2
    true, false = a[:, None] * a[None, :], (1 - a[:, None]) * (1 - a[None, :]) / FALSE_VALUES
    rest = np.clip(1 - true - false, 1e-6, None)
    true_c, false_c, rest_c = mean * COPY_RATE + true * (1 - COPY_RATE), (1 - mean) * COPY_RATE + false * (1 - COPY_RATE), rest * (1 - COPY_RATE)
    ratio = same_true * np.log(true_c / true) + same_false * np.log(false_c / false) + differ * np.log(rest_c / rest)
    out = 1 / (1 + (1 - COPY_PRIOR) / COPY_PRIOR * np.exp(-np.clip(ratio, -500, 500)))
    np.fill_diagonal(out, 0)
    return out


def _blind_dependence(agree: np.ndarray, differ: np.ndarray, accuracy: float) -> np.ndarray:
    """The same before anything is known to be true: from how often two sources agree, against what their accuracy explains.

    Without it, a lie that copies have made the majority would make honest sources look
    like copies of each other.
    """
    alone = accuracy**2 + (1 - accuracy) ** 2 / FALSE_VALUES
    ratio = agree * np.log(COPY_RATE / alone + 1 - COPY_RATE) + differ * np.log(1 - COPY_RATE)
    out = 1 / (1 + (1 - COPY_PRIOR) / COPY_PRIOR * np.exp(-np.clip(ratio, -500, 500)))
    np.fill_diagonal(out, 0)
    return out


class Fusion:
    """The fitted model and the values: ``values`` has (id, field_no, value, says), says the numbers of the sources that say it.

    accuracy[f, s] is that of source s in field f, copied[f, s, t] the probability that s and
    t depend on each other there: a source may be right about names and wrong about dates.
    Dependence has no direction: of two sources that depend on each other, the less accurate
    one's votes are discounted.
    """

    def __init__(self, fields: list[str], sources: list[str], values: DataFrame):
        self.fields, self.sources, self.values = fields, sources, values
        self.accuracy = np.full((len(fields), len(sources)), FIRST_ACCURACY)
        self.copied = np.zeros((len(fields), len(sources), len(sources)))

    def scorer(self):
        """A function of (field number, says) that gives the votes."""
        accuracy, copied, known = self.accuracy, self.copied, {}

        def score(f: int, says: str) -> float:
            if (f, says) not in known:
                known[f, says] = min(_score(_numbers(says), accuracy[f], copied[f]), 300.0)
            return known[f, says]

        return score

    def posteriors(self) -> DataFrame:
        """(id, field_no, value, posterior), the posterior against the item's other values and unseen false ones."""
        score = self.scorer()

        @F.pandas_udf("double")
        def weigh(field_no: pd.Series, says: pd.Series) -> pd.Series:
            return pd.Series([np.exp(score(f, s)) for f, s in zip(field_no, says)], dtype="float64")

        scored = self.values.withColumn("weight", weigh("field_no", "says"))
        total = scored.groupBy("id", "field_no").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n_values"))
        unseen = F.greatest(F.lit(FALSE_VALUES) + 1 - F.col("n_values"), F.lit(0.0))
        return scored.join(total, ["id", "field_no"]).select("id", "field_no", "value", (F.col("weight") / (F.col("total") + unseen)).alias("posterior"))

    def survivors(self) -> DataFrame:
        """(id, field_name, value, posterior): the most probable value of each field."""
        top = self.posteriors().groupBy("id", "field_no").agg(
            F.max("posterior").alias("posterior"), F.min_by("value", F.struct(-F.col("posterior"), "value")).alias("value")
        )
        name = F.element_at(F.array(*[F.lit(f) for f in self.fields or [""]]), F.col("field_no") + 1)
        return top.select("id", name.alias("field_name"), "value", "posterior")

    def report(self) -> DataFrame:
        """(field_name, src, accuracy, depends_on, dependence), with the source it depends on most."""
        rows = []
        for f, field in enumerate(self.fields):
            for i, s in enumerate(self.sources):
                j = int(self.copied[f, i].argmax())
                rows.append((field, s, float(self.accuracy[f, i]), self.sources[j] if j != i else None, float(self.copied[f, i, j])))
        return self.values.sparkSession.createDataFrame(rows, "field_name string, src string, accuracy double, depends_on string, dependence double")


def fuse(made: DataFrame, rounds: int = ROUNDS) -> Fusion:
    """Fits a Fusion to claims (id, field_name, value, src).

    What an item's values weigh depends on nothing but which sources say each of them. So
    items are brought to the list of their values' sets of sources, with how many values
    each set has, and equal lists are counted: the rounds run over distinct lists, and
    shuffle nothing but sums of pairs of sources. A list is as long as the item has
    different sets of sources, however many values or rows it has. The model is of the
    square of the sources; one of more than MODEL_NUMBERS numbers is refused.
    """
    fields, sources = [[r[0] for r in made.select(c).distinct().orderBy(c).limit(int(MODEL_NUMBERS**0.5) + 1).collect()] for c in ("field_name", "src")]
    n = len(sources)
    if len(fields) * n * n > MODEL_NUMBERS:
        raise ValueError(f"a model of {len(fields)} fields and {n} sources has more than {MODEL_NUMBERS} numbers")
    spark = made.sparkSession
    numbers = [spark.createDataFrame(list(enumerate(x)), f"{no} int, {c} string") for x, no, c in ((fields, "field_no", "field_name"), (sources, "src_no", "src"))]
    numbered = made.join(F.broadcast(numbers[0]), "field_name").join(F.broadcast(numbers[1]), "src")  # at most MODEL_NUMBERS rows, mostly a handful
    says = F.array_join(F.array_sort(F.collect_set("src_no")).cast("array<string>"), ",")
    values = cut(numbered.groupBy("id", "field_no", "value").agg(says.alias("says")))
    model = Fusion(fields, sources, values)
    classes = values.groupBy("id", "field_no", "says").agg(F.count(F.lit(1)).alias("n"))
    lists = classes.groupBy("id", "field_no").agg(F.array_sort(F.collect_list(F.struct("says", "n"))).alias("held"))
    items = cut(lists.groupBy("field_no", F.col("held.says").alias("says"), F.col("held.n").alias("n")).agg(F.count(F.lit(1)).alias("items")))
    together = None
    for k in range(rounds if n else 0):
        true, every, met = _pair_sums(items, model, together is None)
        together = met if together is None else together
        for f in range(len(fields)):
            differ = np.clip(together[f] - every[f], 0, None)
            if not k:  # copies must be discounted before they can make their source look right
                model.copied[f] = _blind_dependence(every[f], differ, FIRST_ACCURACY)
                continue
            model.accuracy[f] = (np.diag(true[f]) + FIRST_ACCURACY) / (np.diag(every[f]) + 1)
            model.copied[f] = _dependence(true[f], every[f] - true[f], differ, model.accuracy[f])
    return model


def _pair_sums(items: DataFrame, model: Fusion, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By field and pair of sources: the true values that both say, all that both say, and (if first) the items of which both say something."""
    shape = model.copied.shape
    score = model.scorer()

    def pairs(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}

        def add(k: int, f: int, says: np.ndarray, w: float) -> None:
            if (k, f) not in sums:
                sums[k, f] = np.zeros(shape[1:])
            sums[k, f][np.ix_(says, says)] += w

        for pdf in batches:
            for f, says, n, many in zip(pdf["field_no"], pdf["says"], pdf["n"], pdf["items"]):
                weight = np.exp([score(f, s) for s in says])
                total = float((weight * n).sum()) + max(FALSE_VALUES + 1 - float(sum(n)), 0.0)
                sets = [_numbers(s) for s in says]
                for s, w, c in zip(sets, weight, n):
                    add(0, f, s, many * c * w / total)
                    add(1, f, s, many * c)
                if first:
                    add(2, f, np.unique(np.concatenate(sets)), many)
        for (k, f), s in sums.items():
            i, j = np.nonzero(s)
            yield pd.DataFrame({"k": k, "f": f, "i": i, "j": j, "s": s[i, j]})

    out = np.zeros((3, *shape))
    for r in items.mapInPandas(pairs, "k int, f int, i int, j int, s double").groupBy("k", "f", "i", "j").agg(F.sum("s").alias("s")).toLocalIterator():
        out[r.k, r.f, r.i, r.j] = r.s
    return out[0], out[1], out[2]
