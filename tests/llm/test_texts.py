"""Sharding, language, decontamination, toxicity and fingerprints."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.llm import decontaminate, lang_id, lz_fingerprint, sharding, toxicity


def test_shards_match_the_mixture(spark, docs):
    rows = sharding.stratified_shards(docs, 5).collect()
    assert len(rows) == docs.count()
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r)
    sizes = [len(by_shard[s]) for s in range(5)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by_shard.values())
    for source, total in Counter(r.source for r in rows).items():  # interleaving: each shard within one or two rows of its share
        for s in range(5):
            assert abs(sum(r.source == source for r in by_shard[s]) - total / 5) <= 2
    given = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == given
    again = sharding.stratified_shards(docs.repartition(7), 5).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))  # partitioning doesn't matter


def test_shards_of_nothing(empty_docs):
    assert sharding.stratified_shards(empty_docs, 4).count() == 0


SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "und", "ei"], "cc": ["ção", "nho", "ês"]}


def language_rows(n, seed=2):
    rng = random.Random(seed)
    return [(i, " ".join("".join(rng.choices(SYLLABLES[l], k=3)) for _ in range(12)), l) for i, l in enumerate(rng.choices(list(SYLLABLES), k=n))]


def test_languages_are_told_apart(spark):
    rows = language_rows(240)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    profiles = lang_id.language_profiles(df.where("doc_id % 4 <> 2"))
    out = lang_id.identify_languages(df.where("doc_id % 4 = 2"), profiles).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in out)


def test_profile_is_the_rank_order_of_counts(spark):
    texts = ["abba ab", "Ab!"]
    profiles = lang_id.language_profiles(spark.createDataFrame([(t, "x") for t in texts], "text string, lang string"))
    codes = lang_id.letter_codes()
    counts = Counter()
    for t in texts:
        s = [1, *(int(codes[ord(c)]) for c in t.lower()), 1]
        s = [c for i, c in enumerate(s) if c != 1 or i == 0 or s[i - 1] != 1]
        for n in (1, 2, 3):
            for i in range(len(s) - n + 1):
                gram = s[i : i + n]
                if gram != [1]:
                    counts[sum(c << lang_id.BITS * (n - 1 - k) for k, c in enumerate(gram))] += 1
    assert {int(c) for c in profiles["x"]} >= {c for c, n in counts.items() if n > 1}
    assert counts[int(profiles["x"][0])] == max(counts.values())


def test_prediction_is_the_least_out_of_place_distance(spark, docs):
    profiles = lang_id.language_profiles(docs)
    rank = {name: {int(c): i for i, c in enumerate(p)} for name, p in profiles.items()}
    for r in lang_id.identify_languages(docs, profiles).collect():
        counts = Counter(lang_id.grams([r.text])[1].tolist())
        mine = sorted(counts, key=lambda c: (-counts[c], c))[: lang_id.PROFILE]
        if not mine:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        away = {name: sum(abs(known[c] - i) if c in known else lang_id.PROFILE for i, c in enumerate(mine)) for name, known in rank.items()}
        assert r.lang_pred == min(away, key=lambda name: (away[name], list(profiles).index(name)))
        assert r.score == pytest.approx(1 - away[r.lang_pred] / (len(mine) * lang_id.PROFILE))


def test_language_of_awkward_rows(docs, empty_docs):
    profiles = lang_id.language_profiles(docs)
    out = {(r.doc_id, r.text): r for r in lang_id.identify_languages(docs, profiles).collect()}
    assert all(r.lang_pred == "und" and r.score == 0 for (d, _), r in out.items() if d in (0, 1, 2))
    assert all(r.lang_pred in profiles for (d, _), r in out.items() if d not in (0, 1, 2))
    nothing = lang_id.language_profiles(empty_docs)
    assert nothing == {}
    assert {r.lang_pred for r in lang_id.identify_languages(docs, nothing).collect()} == {"und"}


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(40)) for i in range(12)]
    rows, planted = [], {}
    for i, text in items:
        edited = [w if rng.random() > 0.15 else rng.choice(words) for w in text.split()]
        for k, body in enumerate((text, text.upper() + "!!", " ".join(edited))):
            rows.append((len(rows), prose(60) + "\n" + body + " " + prose(30)))
            planted[rows[-1][0]] = i
    rows += [(len(rows) + i, prose(150)) for i in range(60)]
    rows += [(1000, None), (1001, ""), (None, items[0][1])]
    return items, rows, planted


def test_exact_shouted_and_edited_leaks_are_found_and_clean_texts_left(spark, leaks):
    items, rows, planted = leaks
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([*items, (99, None), (98, ""), (97, "two words")], "item_id bigint, text string")
    out = decontaminate.contamination(df, bench).collect()
    for r in out:
        if r.doc_id is None:
            assert r.leaks[0].item_id == 0
        elif r.doc_id in planted:
            assert r.leaks[0].item_id == planted[r.doc_id]
        else:
            assert not r.contaminated
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


def plain_words(text):
    return "".join(c.lower() if c.isalnum() or ord(c) > 127 else " " for c in text).split()


def test_seeds_are_the_rarest_by_counts_over_all_documents(spark, leaks):
    items, rows, _ = leaks
    items = [*items, (50, "only two"), (51, items[0][1]), (52, " ".join(items[1][1].split()[:20])), (None, items[2][1])]  # short, repeated and shared seeds, no id
    docs = spark.createDataFrame([(t,) for _, t in rows] * 2, "_text string").repartition(5)
    loaded = decontaminate.load_items(spark.createDataFrame(items, "item_id bigint, text string"), "item_id", "text")
    found = decontaminate.with_seeds(loaded, docs)
    counts = Counter()
    for _, text in rows:
        words = plain_words(text or "")
        counts.update({g: 2 * n for g, n in Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2)).items()})
    expected = []
    for number, (_, text) in enumerate(sorted(i for i in items if i[0] is not None)):
        words = plain_words(text)
        grams = [tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        for at in range(0, len(grams), decontaminate.STRETCH):
            stretch = range(at, min(at + decontaminate.STRETCH, len(grams)))
            expected.append((number, min(stretch, key=lambda i: (counts[grams[i]], i))))
    assert sorted(zip(found.seed_item.tolist(), found.seed_place.tolist(), strict=True)) == expected
    assert (np.diff(found.seed.astype(object)) >= 0).all()


def plain_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = decontaminate.MATCH if a[i - 1] == b[j - 1] else -decontaminate.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] - decontaminate.GAP, h[i, j - 1] - decontaminate.GAP)
    return h.max()


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(4)
    query = rng.integers(1, 6, (30, 12)).astype(np.uint64)
    target = rng.integers(1, 6, (30, 20)).astype(np.uint64)
    lengths = rng.integers(1, 13, 30)
    for i, n in enumerate(lengths):
        query[i, n:] = 0
    best, _ = decontaminate.align(query, lengths, target)
    assert best.tolist() == [plain_alignment(q[:n], t) for q, n, t in zip(query, lengths, target, strict=True)]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("klmnop", k=rng.randint(3, 7))) for _ in range(300)]
    rows = []
    for i in range(900):
        body = [rng.choice(words) for _ in range(rng.randint(10, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 6)):
                body.insert(rng.randrange(len(body)), rng.choice(["rotten", "filth", "scoundrel", "vermin" + rng.choice(["s", "ous", "like"])]))
        rows.append((i, " ".join(body), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark, labelled):
    df = spark.createDataFrame(labelled, "doc_id bigint, text string, toxic int")
    labels = df.select("doc_id", "toxic").where("doc_id % 3 > 0")
    model = toxicity.fit_toxicity(df.drop("toxic"), labels)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    out = toxicity.toxicity_scores(df, model).where("doc_id % 3 = 0").collect()
    wrong = [r for r in out if (r.severity >= toxicity.REJECT) != bool(r.toxic)]
    assert len(wrong) <= 0.02 * len(out)
    much = [r.severity for r in out if sum(w in r.text for w in ("rotten", "filth", "scoundrel", "vermin")) >= 4]
    assert np.mean(much) > np.mean([r.severity for r in out if r.toxic])  # more of it, higher grade


def test_severity_equals_a_plain_sum_over_the_thresholds(spark, labelled):
    df = spark.createDataFrame(labelled, "doc_id bigint, text string, toxic int")
    model = toxicity.fit_toxicity(df.drop("toxic"), df.select("doc_id", "toxic"))
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    assert weight

    def hashes(word):
        data = np.frombuffer(word.encode(), np.uint8)
        return set(toxicity.word_features(data, np.array([0, len(data)]))[1].tolist())

    for r in toxicity.toxicity_scores(df, model).collect():
        found = set().union(*map(hashes, r.text.lower().split()))  # a feature counts once a text
        eta = sum(weight.get(h, 0.0) for h in found)
        assert r.severity == pytest.approx(sum(1 / (1 + np.exp(t - eta)) for t in model.thresholds))
        assert r.grade == int(r.severity + 0.5)


def test_toxicity_without_labels_and_on_awkward_rows(spark, docs, empty_docs, labelled):
    none = spark.createDataFrame([(1, None)], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs, none)
    assert all(r.severity == 0 for r in toxicity.toxicity_scores(docs, model).collect())
    df = spark.createDataFrame(labelled, "doc_id bigint, text string, toxic int")
    model = toxicity.fit_toxicity(df, df.select("doc_id", "toxic"))
    scored = toxicity.toxicity_scores(docs.withColumn("severity", F.lit("x")), model)
    assert scored.count() == docs.count() and scored.where("severity is null").count() == 0
    assert toxicity.toxicity_scores(empty_docs, model).count() == 0


def test_toxicity_learns_once_from_repeated_rows_and_within_its_bytes(spark, labelled, monkeypatch):
    df = spark.createDataFrame(labelled, "doc_id bigint, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    key = lambda m: (m.features.tolist(), m.weights.tolist(), m.thresholds.tolist())
    once = key(toxicity.fit_toxicity(df, labels))
    assert key(toxicity.fit_toxicity(df.unionByName(df).unionByName(df), labels.unionByName(labels))) == once
    lower = labels.where("toxic = 1").withColumn("toxic", F.lit(0))
    assert key(toxicity.fit_toxicity(df, lower.unionByName(labels))) == once  # the higher label counts
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 4000)
    some, total = set(), 0
    for _, doc in sorted((r.h, r.doc_id) for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()):
        total += len(dict((d, t) for d, t, _ in labelled)[doc].encode())
        if total <= 4000:
            some.add(doc)
    assert 0 < len(some) < len(labelled)
    assert key(toxicity.fit_toxicity(df, labels)) == key(toxicity.fit_toxicity(df.where(F.col("doc_id").isin(some)), labels))


def test_ordinal_fit_recovers_ordered_grades():
    rng = np.random.default_rng(1)
    x = rng.random((600, 5)) < 0.4
    eta = x @ np.array([3.0, 1.5, -2.0, 0.0, 0.0]) + rng.logistic(size=600) * 0.7
    grades = (eta > 1).astype(int) + (eta > 3)
    rows, columns = np.nonzero(x)
    w, theta = toxicity.fit_ordinal(rows, columns, grades, 5, 3)
    assert w[0] > w[1] > 0 > w[2] and abs(w[3]) < 0.5 and theta[0] < theta[1]


def lz78(text):
    phrases, start = set(), 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in phrases:
            phrases.add(text[start:end])
            start = end
    return phrases


def test_fingerprints_follow_the_phrase_sets():
    a = "the cat sat on the mat and the dog sat on the log " * 6
    b = a.replace("dog", "fox")
    x, y = lz_fingerprint.fingerprint(a), lz_fingerprint.fingerprint(b)
    exact = len(lz78(a) & lz78(b)) / len(lz78(a) | lz78(b))
    assert abs(lz_fingerprint.likeness(x, y) - exact) < 0.25
    assert lz_fingerprint.likeness(x, x) == 1 and lz_fingerprint.likeness(x, lz_fingerprint.fingerprint("zzz qqq")) < 0.3
    assert lz_fingerprint.to_hex(x) == lz_fingerprint.to_hex(lz_fingerprint.fingerprint(a))


def test_edited_fingerprint_equals_a_fresh_parse(texts):
    for text, following in zip(texts, texts[1:], strict=False):
        own, other, edited = lz_fingerprint.both_fingerprints(text, following)
        third = len(text) // 3
        assert edited == text[: len(text) - third] + following[:third]
        assert np.array_equal(own, lz_fingerprint.fingerprint(text)) and np.array_equal(other, lz_fingerprint.fingerprint(edited))


@pytest.mark.parametrize("partitions", ["1", "4", "13"])
def test_neighbours_in_descending_order(spark, docs, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = {r.doc_id: r for r in lz_fingerprint.neighbour_fingerprints(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    order = sorted(texts, reverse=True)
    assert set(out) == set(order)
    for doc, following in zip(order, order[1:] + order[:1], strict=True):
        text, r = texts[doc], out[doc]
        third = len(text) // 3
        edited = text[: len(text) - third] + texts[following][:third]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha256(edited.encode()).hexdigest())
        assert r.fingerprint == lz_fingerprint.to_hex(lz_fingerprint.fingerprint(text))
        assert r.near_next == lz_fingerprint.likeness(lz_fingerprint.fingerprint(text), lz_fingerprint.fingerprint(texts[following]))
        assert r.near_edited == lz_fingerprint.likeness(lz_fingerprint.fingerprint(text), lz_fingerprint.fingerprint(edited))


@pytest.mark.parametrize("partitions", [1, 3, 16])
@pytest.mark.parametrize("copies", [1, 40])
def test_neighbours_among_hot_ids(spark, partitions, copies):
    rows = [(7, f"seven {i}" * 5) for i in range(90)] + [(None, f"none {i}" * 5) for i in range(60)] + [(i, f"own {i}" * 5) for i in range(30)] + [(7, "same")] * copies
    rows += [(-(2**63), "least"), (2**63 - 1, "most"), (2**53 + 1, "odd"), (2**53, "even"), (None, None)]
    given = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    hashed = [(r.doc_id, r.text or "", r.h) for r in given.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()]
    order = sorted(hashed, key=lambda r: (r[0] is not None, r[0] or 0, r[2]), reverse=True)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        out = Counter((r.doc_id, r.fingerprint, r.edited_sha256) for r in lz_fingerprint.neighbour_fingerprints(given).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    expected = Counter()
    for (doc, text, _), (_, following, _) in zip(order, order[1:] + order[:1], strict=True):
        third = len(text) // 3
        expected[doc, lz_fingerprint.to_hex(lz_fingerprint.fingerprint(text)), sha256((text[: len(text) - third] + following[:third]).encode()).hexdigest()] += 1
    assert out == expected


def test_items_with_a_shared_seed_go_in_blocks(docs, spark, monkeypatch):
    shared = "one two three four five six seven eight"
    items = spark.createDataFrame([(i, f"{shared} item{i} ends here {i}") for i in range(40)] + [(None, shared)], "item_id bigint, text string")
    given = spark.createDataFrame([(i, f"before {shared} item{i} ends here {i} after it") for i in range(0, 40, 3)] + [(99, None), (98, "plain")], "doc_id bigint, text string")
    whole = sorted(map(repr, decontaminate.contamination(given, items).collect()))
    monkeypatch.setattr(decontaminate, "PAIRS", 5)
    assert sorted(map(repr, decontaminate.contamination(given, items).collect())) == whole
    assert sum("contaminated=True" in r for r in whole) == 14


def test_neighbours_with_null_and_repeated_ids(docs, empty_docs):
    assert lz_fingerprint.neighbour_fingerprints(docs).count() == docs.count()
    assert lz_fingerprint.neighbour_fingerprints(docs.limit(1)).collect()[0].near_next == 1
    assert lz_fingerprint.neighbour_fingerprints(empty_docs).count() == lz_fingerprint.fingerprints(empty_docs).count() == 0
    assert lz_fingerprint.fingerprints(docs).columns == [*docs.columns, "fingerprint"]
