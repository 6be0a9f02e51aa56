import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltwork.llm import catalogue, leakage, names, packing, reading, seen, survivor
from siltwork.llm.components import components

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, name):
    from tests_support import compare

    compare(spark, name, SF)


# --- seen keys ------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
@pytest.mark.parametrize("n", [1, 2, 3, 1000, 20000])
def test_filter(bits, n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n * 2, dtype=np.uint64))[:n]
    seed, segment, slots = seen.build_filter(keys, bits)
    assert seen.probe_filter(keys, seed, segment, bits, slots.tobytes()).all()
    absent = np.random.default_rng(n + 1).integers(2**63, 2**64 - 1, 40000, dtype=np.uint64)
    rate = seen.probe_filter(absent, seed, segment, bits, slots.tobytes()).mean()
    assert rate <= 2.0**-bits * 1.5 + 0.0005
    if n >= 20000:
        assert 8 * len(slots.tobytes()) / n < 1.24 * bits + 1


def test_error_rate():
    assert seen.error_rate(0) == 0 and abs(seen.error_rate(3, 8) - (1 - (1 - 1 / 256) ** 3)) < 1e-12


def brute_seen(rows, earlier):
    known, out = {k for k in earlier if k}, set()
    for t, i, k in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        if k:
            if k in known:
                out.add(i)
            known.add(k)
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(0, 9), st.sampled_from(["", None, "a", "b", "c", " a", "A"])), max_size=40), st.lists(st.sampled_from(["a", "", None, "z"]), max_size=3), st.integers(1, 5))
def test_seen_equals_brute_force(spark, rows, earlier, batches):
    made = [(t, i, k) for i, (t, k) in enumerate(rows)]
    df = spark.createDataFrame(made, "t int, i long, k string").select(F.timestamp_seconds("t").alias("arrived"), "i", "k", F.lit(1).alias("h"), F.lit(2).alias("generation"))
    found, filters = seen.seen_before(df, spark.createDataFrame([(k,) for k in earlier], "k string"), "k", "i", "arrived", batches)
    assert {r.i for r in found.collect()} == brute_seen(made, earlier)
    assert seen.error_report(filters).where("measured_rate > 0.01").isEmpty()


def test_keys_of_one_hash_in_an_open_batch(spark, monkeypatch):
    """Within a batch keys are compared as they are: two keys of one hash are both new, and each is seen again."""
    monkeypatch.setattr(seen, "key_hash", lambda c: F.xxhash64(F.lower(c)))
    df = spark.createDataFrame([(0, 1, "a"), (0, 2, "A"), (0, 3, "a"), (0, 4, "A"), (0, 5, "b")], "t int, i long, k string").select(F.timestamp_seconds("t").alias("arrived"), "i", "k")
    found, _ = seen.seen_before(df, df.limit(0).select("k"), "k", "i", "arrived", 1)
    assert {r.i for r in found.collect()} == {3, 4}


def test_measured_errors_fit_the_stated_rate(spark):
    keys = spark.range(40_000).select((F.col("id") % 4).cast("int").alias("generation"), F.xxhash64("id").alias("h"))
    rates = seen.error_report(seen.build_filters(keys, 3, seen.MEASURED_BITS)).collect()
    assert len(rates) == 4 and all(abs(r.wrong - r.asked / 256) < 5 * math.sqrt(r.asked / 256) and r.wrong > 0 for r in rates)
    assert abs(rates[3].compounded_rate - (1 - (1 - 1 / 256) ** 4)) < 1e-9


# --- survivors -------------------------------------------------------------------------------

COMPANY = "obs_id long, id string, name string, import_source string, first_seen long, last_seen long, updated_at long"
SOURCES = [("High", 9), ("low", 1), (None, 5)]
OK = 1_500_000_000


def survivors(spark, rows):
    df = spark.createDataFrame(rows, COMPANY).withColumn("n", F.lit("clash")).withColumn("src", F.lit(1)).withColumn("vote", F.lit(1))
    src = spark.createDataFrame(SOURCES, "import_source string, trust long")
    return {(r.id, r.field_name): r.obs_id for r in survivor.surviving_rows(df, src).collect()}


def test_survivors(spark):
    got = survivors(
        spark,
        [
            (1, "a", "Short", " HIGH ", OK + 5, OK + 9, OK),
            (2, "a", " Short Name", "low", OK + 5, OK + 8, OK + 7),
            (3, "a", "Short Name", "low", OK + 9, OK + 3, OK + 7),  # contradictory epochs
            (4, "a", "Other Na…", "high", None, 0, 5),
            (5, "a", "UNKNOWN name it", None, 10**12, OK + 9, None),
            (6, "a", "n/a", "high", None, None, OK + 99),
            (7, "b", "alone", "high", OK, OK, OK), (8, None, "x", "high", OK, OK, OK), (9, None, "x", "high", OK, OK, OK), (10, "", "x", "high", OK, OK, OK),
            (11, "c", None, None, None, None, None), (12, "c", " ", None, None, None, None),
        ],
    )
    assert got == {("a", "name"): 2, ("a", "first_seen"): 1, ("a", "last_seen"): 1, ("a", "updated_at"): 6}
    assert survivors(spark, []) == {}


def test_survivor_ties_and_repeated_rows(spark):
    got = survivors(spark, [(5, "a", "N", "high", OK, OK, OK), (3, "a", "M", "HIGH", OK, OK, OK), (3, "a", "M", "HIGH", OK, OK, OK)])
    assert set(got.values()) == {3}


def test_trimming():
    assert survivor.BLANKS.strip() == "" or set(survivor.BLANKS) >= set(" \t\n 　")


def test_fusion_discounts_copies(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        truth = f"v{i}"
        for s in ("good1", "good2", "good3"):
            rows.append((f"e{i}", "name", truth if rng.random() < 0.85 else f"w{i}{rng.randint(0, 9)}", s))
        lie = truth if rng.random() < 0.3 else f"lie{i}"
        rows += [(f"e{i}", "name", lie, s) for s in ("bad", "copy1", "copy2", "copy3")]
    df = spark.createDataFrame(rows, "id string, field_name string, value string, src string")
    model = survivor.fuse(df)
    acc = dict(zip(model.sources, model.accuracy[0]))
    assert min(acc[s] for s in ("good1", "good2", "good3")) > 0.6 > max(acc[s] for s in ("bad", "copy1"))
    k = {s: i for i, s in enumerate(model.sources)}
    assert model.copied[0, k["copy1"], k["bad"]] > 0.9 and model.copied[0, k["good1"], k["good2"]] < 0.1
    right = model.survivors().where(F.col("value") == F.concat(F.lit("v"), F.substring("id", 2, 9))).count()
    votes = df.groupBy("id", "value").count().groupBy("id").agg(F.max_by("value", "count").alias("value"))
    majority = votes.where(F.col("value") == F.concat(F.lit("v"), F.substring("id", 2, 9))).count()
    assert right > 320 > 200 > majority
    assert model.report().count() == 7


def test_fusion_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, field_name string, value string, src string")
    assert survivor.fuse(empty).survivors().count() == 0
    many = spark.createDataFrame([("a", "f", "v", f"s{i}") for i in range(4500)], empty.schema)
    with pytest.raises(ValueError):
        survivor.fuse(many)


def planted_claims(rng, items=300, honest=60, liars=5, copiers=3):
    """Claims of honest sources of several accuracies, and of liars with copiers, which lie alike in 70 of 100 items."""
    rows = []
    for i in range(items):
        for s in range(honest):
            if rng.random() < 0.3:
                rows.append((f"e{i}", "f", f"v{i}" if rng.random() < 0.6 + 0.3 * s / honest else f"w{i}-{rng.randint(0, 15)}", f"h{s:02d}"))
        for g in range(liars):
            lie = f"v{i}" if rng.random() < 0.3 else f"lie{i}-{g % 2}"
            rows += [(f"e{i}", "f", lie if rng.random() < 0.9 else f"own{i}-{g}-{c}", f"l{g}{c}") for c in range(1 + copiers)]
    return rows


def test_fusion_of_planted_truth_with_many_sources(spark):
    """80 sources, 20 of which are liars and their copiers: measured accuracy of values, and recall and precision of the copying found."""
    rows = planted_claims(random.Random(3))
    model = survivor.fuse(spark.createDataFrame(rows, "id string, field_name string, value string, src string"))
    right = sum(r.value == "v" + r.id[1:] for r in model.survivors().collect()) / 300
    k = {s: i for i, s in enumerate(model.sources)}
    pair = lambda a, b: model.copied[0, k[a], k[b]] > 0.5
    found = [pair(f"l{g}{a}", f"l{g}{b}") for g in range(5) for a in range(4) for b in range(a)]
    wrong = [pair(f"h{a:02d}", f"h{b:02d}") for a in range(60) for b in range(a)]
    print(f"\nfusion: right {right:.3f}, copying found {np.mean(found):.3f}, found among honest {np.mean(wrong):.4f}")
    assert right > 0.97 and np.mean(found) > 0.95 and np.mean(wrong) < 0.01


def test_fusion_by_lists_equals_fusion_by_items(spark):
    """A fit over items written twice has the same survivors: lists are counted, whatever the number of values or rows."""
    rows = planted_claims(random.Random(9), items=40, honest=8, liars=2)
    schema = "id string, field_name string, value string, src string"
    one = {(r.id, r.value) for r in survivor.fuse(spark.createDataFrame(rows, schema)).survivors().collect()}
    again = {(r.id, r.value) for r in survivor.fuse(spark.createDataFrame(rows * 3, schema)).survivors().collect()}
    assert one == again and len(one) == 40


# --- packing ------------------------------------------------------------------------------------


@settings(max_examples=60)
@given(st.lists(st.integers(0, 60), max_size=60), st.integers(1, 25), st.integers(1, 6))
def test_pack_is_whole(sizes, capacity, bins):
    out = list(packing.pack(enumerate(sizes), capacity, bins))
    fill, by_item = {}, {}
    for item, piece, size, b in out:
        assert 0 < size <= capacity
        fill[b] = fill.get(b, 0) + size
        by_item.setdefault(item, []).append((piece, size))
    assert all(v <= capacity for v in fill.values())
    for item, size in enumerate(sizes):
        pieces = by_item.get(item, [])
        assert sum(s for _, s in pieces) == size and [p for p, _ in pieces] == list(range(len(pieces)))
        assert len(pieces) == -(-size // capacity)  # split only where it must be
    assert sorted(fill) == list(range(len(fill)))


def test_pack_takes_the_best_fit_and_bounds_open_bins():
    assert [b for *_, b in packing.pack(enumerate([6, 7, 3, 4]), 10, 9)] == [0, 1, 1, 0]
    # with one open bin the fullest closes first: 9 of 10 closes, and 4 stays open for 6
    assert [b for *_, b in packing.pack(enumerate([9, 4, 6, 1]), 10, 1)] == [0, 1, 1, 2]


def test_packed_texts(spark):
    docs = spark.createDataFrame([(1, "hello world " * 200, "x"), (2, "", "x"), (3, None, "x"), (4, "short", "x"), (4, "short", "x"), (5, "w" * 60_000, "x")], "doc_id long, text string, bin string")
    kinds = spark.createDataFrame([("a", 16), ("b", 1000), ("zero", 0), ("none", None)], "container_kind string, capacity_tokens long")
    sizes = packing.token_sizes(docs)
    want = {r.doc_id: r.n_tokens for r in sizes.collect()}
    enc = packing.encoder(packing.VOCABULARY)
    assert want[1] == len(enc.encode_ordinary("hello world " * 200)) and set(want) == {1, 4, 5}
    got = packing.packed(sizes, kinds)
    sums = {(r.container_kind, r.doc_id): r.s for r in got.groupBy("container_kind", "doc_id").agg(F.sum("n_tokens").alias("s")).collect()}
    assert sums == {(k, d): n * (2 if d == 4 else 1) for k in "ab" for d, n in want.items()}
    assert got.groupBy("container_kind", "shard", "bin").agg(F.sum("n_tokens").alias("s")).join(kinds, "container_kind").where("s > capacity_tokens").count() == 0
    assert packing.fill_report(got, kinds).count() == 2
    assert packing.packed(sizes, kinds.limit(0)).count() == 0 and packing.packed(sizes.limit(0), kinds).count() == 0


def test_long_texts_are_sized_in_parts():
    rng = random.Random(2)
    text = "".join(rng.choice(["word ", "two  blanks ", "\n", "x1, ", "  ", "été "]) for _ in range(30_000))
    enc = packing.encoder(packing.VOCABULARY)
    parts = list(packing.stretches(text, 500))
    assert "".join(parts) == text and len(parts) > 50
    assert sum(len(enc.encode_ordinary(p)) for p in parts) == len(enc.encode_ordinary(text))


# --- leakage --------------------------------------------------------------------------------------

ITEM = " ".join(f"w{i}" for i in range(60))


def leaks(spark, docs, items=((1, ITEM), (2, " ".join(f"v{i}" for i in range(60))), (3, None), (4, ""))):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("item_id", F.lit(9))
    i = spark.createDataFrame(list(items), "item_id long, text string").withColumn("doc_id", F.lit(9))
    return {(r.doc_id, r.item_id) for r in leakage.leaks(d, i).collect()}


def test_leaks(spark):
    w = ITEM.split()
    noise = [f"n{i}" for i in range(40)]
    near = [x if i % 11 else f"changed{i}" for i, x in enumerate(w)]
    docs = [
        (1, " ".join(noise + w + noise)), (2, " ".join(noise + w[10:22] + noise)), (3, " ".join(noise + w[10:21] + noise)), (4, " ".join(near)),
        (5, " ".join(noise + w[20:26] + ["image", "missing"] + w[26:32] + noise)),  # a remark interrupts
        (6, " ".join(noise + w[20:29] + ["edit", "posted", "by", "phone"] + w[29:32] + noise)),
        (7, " ".join(noise + w[20:26] + noise[:20] + w[26:32])),  # too long for a remark
        (8, "> " + "\n// ".join(" ".join(w[i : i + 6]).upper() for i in range(0, 60, 6))), (9, "<b>" + "</b> &amp; <i>".join(w[5:20]) + "</i>"),
        (10, "​".join(", ".join(w[:15]))), (11, None), (12, ""), (13, " ".join(x if i % 4 else "z" for i, x in enumerate(w))),
        (14, " ".join(["pad"] * 30_000 + w[3:20])), (1, " ".join(noise + w + noise)),
    ]
    assert leaks(spark, docs) == {(d, 1) for d in (1, 2, 4, 5, 6, 8, 9, 10, 14)}
    assert leaks(spark, []) == set() and leaks(spark, docs, [(3, None)]) == set()


def test_promising_loses_no_run():
    rng = random.Random(4)
    for _ in range(300):
        words = [f"w{i}" for i in range(40)]
        a = rng.randint(0, 28)
        cut = rng.randint(1, 11)
        gap = rng.randint(0, leakage.REMARK_WORDS)
        doc = ["x"] * 3 + words[a : a + cut] + ["y"] * gap + words[a + cut : a + 12] + ["x"] * 3
        found = leakage.find(leakage.Block([(1, " ".join(words))]), [5, 6, 7], ["q " * 3, " ".join(doc), None])
        assert [r[:2] for r in found] == [(6, 1)] and found[0][3] >= 12
        assert not leakage.find(leakage.Block([(1, " ".join(words))]), [6], [" ".join(w for w in doc if w != words[a])])


def test_short_items_are_found_whatever_words_are_changed():
    """Items of any length, with as many words changed or added as a leak may have."""
    rng = random.Random(11)
    for m in range(1, 70):
        words = [f"w{i}" for i in range(m)]
        block = leakage.Block([(m, " ".join(words))])
        for _ in range(12):
            doc = list(words)
            for i in sorted(rng.sample(range(1, m - 1), min(block.items[0].changes, max(0, m - 2))), reverse=True) if m > 2 else []:
                if rng.random() < 0.5:
                    doc[i] = "z"
                else:
                    doc.insert(i, "z")
            found = leakage.find(block, [7], [" ".join(["x"] * 30 + doc + ["x"] * 30)])
            assert [r[:2] for r in found] == [(7, m)], (m, doc)


def test_blocks_of_items_change_nothing(spark):
    texts = [f"{' '.join(f'{c}{i}' for i in range(30))}" for c in "abcdefgh"]
    docs = spark.createDataFrame([(k, f"x y {t[:60]} z {texts[(k + 1) % 8]}") for k, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    one, many = (sorted(map(tuple, leakage.leaks(docs, items, n).collect())) for n in (leakage.BLOCK_WORDS, 60))
    assert one == many and len(one) == 16


def test_alignment_counts():
    a = np.arange(30)
    assert leakage.align(a, a) == (60.0, 30, 0, 0)
    b = np.r_[a[:10], [-1], a[11:20], [-1, -1], a[20:]]
    _, run, changed, added = leakage.align(a, b)
    assert (run, changed, added) == (19, 1, 2)


# --- reading level -----------------------------------------------------------------------------

LEVEL_WORDS = {k: [f"{c}{a}{b}" for a in "bdfgk" for b in ("an", "it", "om", "up")] for k, c in zip(range(1, 5), ("sh", "tr", "pl", "gr"))}


def level_text(rng, k, n=90, share=0.0):
    out = []
    while sum(len(s.split()) for s in out) < n:
        level = rng.choice([x for x in range(1, 5) if x != k]) if rng.random() < share else k
        out.append("the " + " ".join(rng.choice(LEVEL_WORDS[level]) for _ in range(6)) + " and it is of them.")
    return " ".join(out)


def test_levels_held_out(spark):
    rng = random.Random(6)
    rated, docs = [], []
    for i in range(240):
        k = 1 + i % 4
        docs.append((i, level_text(rng, k, share=0.25), "x"))
        rated.append((i, "r", min(4, max(1, k + (rng.choice([-1, 1]) if rng.random() < 0.15 else 0)))))
    test = [(1000 + i, "```\ncode_here = 1;\n```\r\n" + level_text(rng, 1 + i % 4, share=0.25), "x") for i in range(200)]
    extra = [(5000, None, "x"), (5001, "", "x"), (5002, "the short text", "x"), (5003, "der die das und ist nicht ein von mit auf " * 20, "x"), (5004, level_text(rng, 3, 40_000), "x")]
    df = spark.createDataFrame(docs + test + extra, "doc_id long, text string, reading_level string")
    ratings = spark.createDataFrame([*rated, (0, None, None), (1, "r", 9)], "doc_id long, rater string, reading_level long")
    got = {r.doc_id: r.reading_level for r in reading.levels(df, reading.learn(df, ratings)).collect()}
    right = sum(got.get(1000 + i) == 1 + i % 4 for i in range(200))
    assert right >= 190 and got[5004] == 3 and not {5000, 5001, 5002, 5003} & set(got)


OTHER = {
    "da": "Jeg har en bil som er for stor til byen og jeg ved ikke hvad jeg skal gøre med den. Kan man parkere den ved stationen i weekenden eller er det bedre at tage toget? "
    "Min kone siger at vi bør sælge den, men jeg tror at vi får brug for den når vi skal på ferie til sommer med børnene.",
    "nl": "Ik heb een auto die te groot is voor de stad en ik weet niet wat ik ermee moet doen. Kan men in het weekend bij het station parkeren of is het beter om de trein te "
    "nemen? Mijn vrouw zegt dat we hem moeten verkopen, maar ik denk dat we hem nodig hebben in de zomer.",
    "sv": "Jag har en bil som är för stor för staden och jag vet inte vad jag ska göra med den. Kan man parkera den vid stationen i helgen eller är det bättre att ta tåget? "
    "Min fru säger att vi borde sälja den men jag tror att vi behöver den i sommar.",
}
ENGLISH = (
    "I have a car that is too large for the town and I do not know what I should do with it. May one park it at the station on weekends, or is it better to take the train? "
    "My wife says that we should sell it, but I believe that we shall need it when we go on holiday in summer with the children."
)


def test_languages_that_no_list_names_are_told_from_english(spark):
    docs, ratings = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "reading_label"))
    grades = reading.learn(docs, ratings)
    # with English words put in, so that the list of function words lets them pass
    assert all(reading.has_english_words(reading.stretches(t + " the and is of it for a to" * 2)) for t in OTHER.values())
    assert not [k for k, t in OTHER.items() if reading.is_english(reading.stretches(t + " the and is of it for a to" * 2), grades.spelling)]
    assert reading.is_english(reading.stretches(ENGLISH), grades.spelling)


def test_levels_without_ratings(spark):
    df = spark.createDataFrame([(1, "the cat is in the hat and it is fun " * 10)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, rater string, reading_level long")
    assert reading.levels(df, reading.learn(df, none)).count() == 0


def test_prose():
    text = "One.\r\n```py\r\nx = f(1)\r\n```\r\nTwo `code` &amp; <a href='u'>link</a> [t](http://x.test) three.\n    if a[0] != None: return b\n<pre><code>std::map&lt;int></code></pre>http://a.test/b\nfour"
    assert reading._WORD.findall(reading.prose(text)) == ["One", "Two", "three", "four"]


# --- names -----------------------------------------------------------------------------------------


def test_typing_distance():
    d = names.typing_distance
    assert d("furniture", "furnitre") == 1 and d("transport", "tranpsort") == 1 and d("consulting", "consultung") == 1 and d("abc", "abc") == 0
    assert d("logistics", "logiztics") == 1 and d("kapola", "katola") == 3 and d("a", "abcd") == 3


@given(st.text("abcdefg", max_size=8), st.text("abcdefg", max_size=8))
def test_typing_distance_is_symmetric(a, b):
    assert names.typing_distance(a, b) == names.typing_distance(b, a)


def test_forms():
    c = names.Canon({"optics": 50, "skogen": 40, "kettel": 30, "marine": 50})
    form = lambda n: c.form(n)
    assert form("Skøgen Marine Kelezurihon Ltd") == form("KELEZURIHON MARINE LIMITED (Skoegen)") == form("Kelezurihon  Mar. L.t.d., Skogen")
    assert form("KelezurihonOptcs GmbH") == form("Kelezurihon Optics Ges. mbH") and form("Kelezurihon Marine").block != form("Kelezurihon Optics").block
    assert form("Becky Rolufo & Sons") == form("Rolufo, Rebecca and Sons") and form("Rolufo Optics No. 7").block != form("Rolufo Optics #8").block
    assert set(form("K. Rolufo").letters) <= set(names.Canon({}).form("Katya Rolufo").letters)
    assert form("") is None and form("  &. ") is None


ROWS = [
    ("a1", "Kelezurihon Optics Ltd"), ("a2", "KELEZURIHON OPTCS LIMITED"), ("a3", "Optics Kelezurihom"), ("b1", "Kelezurihon Marine Ltd"),
    ("c1", "Robert Rolufo & Sons"), ("c2", "R. Rolufo & Sons"), ("c3", "Bob Rolufo and Sons"), ("c4", "Eleanor Rolufo & Sons"),
    ("d1", "B. Kanimuso"), ("d2", "Benjamin Kanimuso"), ("d3", "Barbara Kanimuso"), ("e1", "unknown"), ("e2", "Kelezuri..."), ("e3", None), ("", "Kelezurihon Optics"), (None, "Kelezurihon Optics"),
    ("f1", "Zotamelufi & Bakoripuna Optics"), ("f2", "Bakoripnua and Zotamelufi Optics AG"), ("g1", "Zotamelufi & Other Optics"),
]


def test_groups(spark):
    filler = [(f"z{i}", f"{w} {p}{i}amido") for i in range(40) for w, p in (("Optics", "Q"), ("Marine", "X"), ("Barbara", "W"))]
    df = spark.createDataFrame([*ROWS, *ROWS, *filler], "id string, name string").withColumn("rare", F.lit(1)).withColumn("node", F.lit("x"))
    got = {(r.id_a, r.id_b) for r in names.pairs_of(names.groups(df, df.limit(0))).collect() if not r.id_a.startswith("z")}
    want = {("a1", "a2"), ("a1", "a3"), ("a2", "a3"), ("c1", "c2"), ("c1", "c3"), ("c2", "c3"), ("f1", "f2")}
    assert {p for p in got if not p[0].startswith("d")} == want
    assert names.groups(df.limit(0)).count() == 0


def test_similar_nodes_equal_brute_force(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("bdkmnrst") + rng.choice("aeiou") for _ in range(4)) for _ in range(25)]
    made = []
    for w in base:
        for _ in range(4):
            t = list(w)
            if rng.random() < 0.7:
                i = rng.randrange(len(t) - 1)
                t[i], t[i + 1] = t[i + 1], t[i]
            made.append("".join(t))
    made = sorted(set(made))
    nodes = spark.createDataFrame([(i, "x", "", "", "", w) for i, w in enumerate(made)], "node long, block string, given string, letters string, middle string, rare string")
    got = {(r.a, r.b) for r in names.similar_nodes(nodes).collect()}
    all_ = {(i, j) for i in range(len(made)) for j in range(i + 1, len(made)) if names.similarity([made[i]], [made[j]], [1.0], [1.0]) >= names.MIN_SIMILARITY}
    assert got == all_


@settings(max_examples=400, deadline=None)
@given(st.text("abrnm", min_size=4, max_size=13), st.lists(st.tuples(st.sampled_from("swap drop put near".split()), st.integers(0, 12), st.sampled_from("abrnm")), min_size=1, max_size=2), st.integers(0, 3))
def test_prefixes_meet_whatever_the_order_of_grams(word, errors, order):
    other = list(word)
    for kind, at, letter in errors:
        at = min(at, len(other) - 2)
        if kind == "swap":
            other[at], other[at + 1] = other[at + 1], other[at]
        elif kind == "drop":
            del other[at]
        elif kind == "put":
            other.insert(at, letter)
        else:
            other[at] = next((y for x, y in sorted(names.NEAR) if x == other[at]), other[at])
    other = "".join(other)
    counts = names.Ranks(np.random.default_rng(order).integers(0, 5, names.GRAM_BUCKETS))
    if word != other and names.similarity([word], [other], [1.0], [1.0]) >= names.MIN_SIMILARITY:
        a, b = names.prefix(word, counts), names.prefix(other, counts)
        assert word.replace("rn", "m") == other.replace("rn", "m") or any(g == h and abs(i - j) <= 2 for g, i in a for h, j in b)


def test_similar_nodes_find_all_that_verification_accepts(spark):
    made = ["smith", "simth", "parker", "pakrer", "tubakaapal", "tuabkabapal", "barnarnet", "bamamet", "abc kelezurihon", "abd kelezurihon", "abdkelezurihon",
            "ezkleurihon loz", "kelezurihon olz", "ozotamelufi pakrer", "parker zotamelufi", "smith zotamelufi"]
    rng = random.Random(5)
    for w in list(made):
        t = list(w)
        for i in rng.sample(range(0, len(t) - 1, 2), 2):
            t[i], t[i + 1] = t[i + 1], t[i]
        made.append(" ".join(sorted("".join(t).split())))
    made = sorted(set(made))
    nodes = spark.createDataFrame([(i, "x", "", "", "", w) for i, w in enumerate(made)], "node long, block string, given string, letters string, middle string, rare string")
    got = {(r.a, r.b) for r in names.similar_nodes(nodes).collect()}
    split, df = [w.split() for w in made], {}
    for t in (t for w in split for t in w):
        df[t] = df.get(t, 0) + 1
    idf = lambda w: [math.log((len(made) + 1) / df[t]) for t in w] if len(w) > 1 else [1.0]
    want = {(i, j) for i, a in enumerate(split) for j, b in enumerate(split) if i < j and names.similarity(a, b, idf(a), idf(b)) >= names.MIN_SIMILARITY}
    at = made.index
    assert {(at("simth"), at("smith")), (at("pakrer"), at("parker")), (at("tuabkabapal"), at("tubakaapal"))} <= want
    assert got == want


MADE_UP = {"zembraxes": "zbx", "ploriquants": "plq", "quorilda": "lidi", "branomund": "mundo"}


def test_short_forms_and_given_names_are_learned(spark):
    """Words that no table holds, and names like those of persons and firms."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bdgklmnprstvz") + rng.choice("aeiou") for _ in range(5))
    rows = []
    for i in range(400):
        w, long = word(), rng.choice(list(MADE_UP))
        person = long in ("quorilda", "branomund")
        for k in range(3):
            v = rng.choice([long, long, MADE_UP[long], *([long[0] + "."] if person else [])])
            rows.append((f"i{i}-{k if rng.random() < 0.3 else 0}", f"{v} {w} & Sons" if person else f"{w} {v} Ltd"))
    names_of = spark.createDataFrame(rows, "id string, name string")
    usable = names.usable_names(names_of)
    common, frequent = names.word_counts(usable)
    got = names.learn(usable, common, frequent)
    assert {k: v for k, v in got.short.items()} == {v: k for k, v in MADE_UP.items()}
    assert got.given == {"quorilda", "branomund"} and got.trades == {"zembraxes", "ploriquants"}
    assert names.learn(usable.limit(0), {}, {}) == names.Lexicon({}, frozenset())


def test_groups_need_no_tables_of_words(spark):
    """At sf0.01, where words are rare, learning finds nine tenths of what it finds with the tables of usual forms."""
    t = [spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("company", "company_main")]
    full, bare = ({tuple(r) for r in names.pairs_of(names.linked(*t, usual=u)).collect()} for u in (names.USUAL, names.Lexicon({}, frozenset())))
    assert len(full & bare) >= 0.9 * len(full) and len(bare - full) <= 0.01 * len(full)


@pytest.mark.parametrize("name", ["p2_found", "p2_groups"])
def test_variant_names_broadcast_no_table(spark, monkeypatch, name):
    """The driver holds no side of a join, however small Spark takes its files to be."""
    from siltwork.llm import components as module

    plans, cut = [], names.cut

    def seen_cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    for m in (names, module):
        monkeypatch.setattr(m, "cut", seen_cut)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    plans.append(catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 5
    assert [p for p in plans if "Broadcast" in p] == []


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=25))
def test_components(spark, edges):
    parent = list(range(15))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    df = spark.createDataFrame([*edges, (None, 1)], "u long, v long")
    got = {r.vertex: r.component for r in components(df).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]} | {}


def test_hubs_are_dealt_to_several_tasks(spark, monkeypatch):
    from siltwork.llm import components as module

    monkeypatch.setattr(module, "FEW_EDGES", 0)
    edges = [(0, i) for i in range(1, 300)] + [(500 + i, 501 + i) for i in range(20)] + [(299, 900)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in [*range(300), 900]} | {500 + i: 500 for i in range(21)}


def test_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    assert {r.component for r in components(df).collect()} == {0}


def test_catalogue_is_complete():
    assert {q.split("_")[0] for q in catalogue.queries()} == {"p2", "p4", "p5", "p6", "p7", "p8"}
