import random
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as p
from furrow.llm import langid, mixing, packing, pii, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_their_columns_and_take_effect(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    extra = spark.createDataFrame([(7001, None, None, None, 0), (7002, "!!! 12", "en", "s", 6)], SCHEMA)
    docs = docs.unionByName(extra)
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, d).cache()
        assert out.columns == p.COLUMNS
        if stage is p.language:
            assert out.where("doc_id in (7001, 7002)").count() == 0 and out.count() >= 0.9 * docs.count()
        if stage is p.near_duplicates:
            groups = simhash.near_duplicates(docs).select("root").distinct().count()
            assert out.count() == groups
        if stage is p.private:
            assert out.count() == docs.count() and out.where("text rlike '[a-z0-9.]+@[a-z0-9]+[.]com'").count() == 0
        if stage is p.mix:
            assert 0 < out.count() <= 3 * docs.count()
        docs = out
    assert p.pack(spark, docs, d).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_near_duplicates_without_ids(spark):
    t = "one two three four five six seven eight"
    rows = [(None, t, "en", "a", 1), (None, t, "en", "a", 1), (None, "else", "en", "a", 1), (5, "else", "en", "a", 1), (5, "else", "en", "a", 1)]
    out = p.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, t), (5, "else")]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in p.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_the_mix_takes_no_more_than_its_budget(spark):
    """Rows of one id with other texts, and rows that are alike, count each for themselves."""
    r = random.Random(9)
    rows = [(i % 7 if i % 3 else None, " ".join(f"w{r.randint(0, 9)}" for _ in range(r.randint(0, 9))), r.choice(["en", None]), r.choice(["a", "b", None]), 3) for i in range(90)]
    rows += [(1, "two words", "en", "a", 9)] * 5 + [(1, "two words", None, "a", 9)] * 2 + [(None, None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = Counter()
    for x in mixing.mixed(docs).collect():
        want[x.doc_id, x.text_hash, x.source] += x.copies
    out = p.mix(spark, docs, "")
    key = [F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.col("source")]
    got = Counter(tuple(x) for x in out.select(*key).collect())
    assert got == +want
    words = lambda x: len((x or "").split())
    assert sum(words(x.text) for x in out.collect()) <= sum(words(x[1]) for x in rows)
    alike = Counter(x.lang for x in out.where("text = 'two words'").collect())
    n = alike.total()
    assert all(abs(alike[lang] - n * k / 7) <= k for lang, k in (("en", 5), (None, 2)))


def test_stages_equal_brute_force(spark):
    """Each stage on its predecessor's rows, against plain loops over all of them."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select(*p.COLUMNS)
    model = langid.Classifier(langid.train(docs))
    rows = docs.collect()
    want = []
    for x in rows:
        lang, _, margin = model.predict(x.text)
        if margin >= langid.MARGIN:
            want.append((x.doc_id, x.text, lang, x.source, x.n_chars))
    docs = p.language(spark, docs, d)
    assert sorted(map(tuple, docs.collect()), key=str) == sorted(want, key=str)

    fps, parent = [simhash.fingerprint(x[1]) for x in want], list(range(len(want)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(want)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    low = {}
    for i, x in enumerate(want):
        low[find(i)] = min(low.get(find(i), x), x)
    want = sorted(low.values())
    docs = p.near_duplicates(spark, docs, d)
    assert sorted(map(tuple, docs.collect())) == want

    # Personal data: every base span goes; what goes besides looks like its kind.
    out = {x.doc_id: x for x in p.private(spark, docs, d).collect()}
    assert set(out) == {x[0] for x in want}
    for i, t, lang, source, _ in want:
        spans = sorted((a, b, k) for k, a, b in pii.base_spans(t))
        at, rest = 0, out[i].text
        for a, b, k in spans:
            if a < at:
                continue
            before = t[at:a]
            if rest.startswith(before):
                rest = rest[len(before) :]
                assert rest.startswith(f"<{k}>"), (i, k)
                rest = rest[len(k) + 2 :]
            else:  # something found by its context lies before it
                rest = rest[rest.index(f"<{k}>") + len(k) + 2 :]
            at = b
        assert (out[i].lang, out[i].source, out[i].n_chars) == (lang, source, len(out[i].text))
    docs = p.private(spark, docs, d)

    # The mix: all copies in the order of their finish times, as far as the budget goes.
    rows = docs.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = {x.source: (x.target, x.source_size) for x in mixing.mixed(docs).collect()}
    h = {x.doc_id: x.h for x in mixing.sized(docs).collect()}
    copies = []
    for s, (goal, whole) in target.items():
        end = 0
        for x in sorted((x for x in rows if x.source == s), key=lambda x: (h[x.doc_id], x.doc_id)):
            end += size(x.text)
            copies += [((end + k * whole) / goal if goal else 0.0, s is None, s, h[x.doc_id], x.doc_id, k, size(x.text)) for k in range(3)]
    total, budget, taken = 0, sum(size(x.text) for x in rows), Counter()
    for c in sorted(copies):
        total += c[-1]
        if total <= budget:
            taken[c[4]] += 1
    docs = p.mix(spark, docs, d)
    assert Counter(x.doc_id for x in docs.collect()) == taken

    got = p.pack(spark, docs, d).collect()
    assert Counter(x.doc_id for x in got if x.piece == 0) == taken
    bins = {}
    for x in got:
        bins.setdefault(x.bin_id, []).append(x)
    for b in bins.values():
        assert sum(x.length for x in b) + b[0].bin_free == packing.CAPACITY
        assert len({x.source for x in b}) == len(b) == len({x.cluster for x in b})


def test_clashing_columns_ties_and_long_texts(spark):
    text = "the house is " + "very " * 100_000 + "old"
    rows = [(i, text if i % 2 else f"a short text {i}", "en", "s", 5, 1, "x", "y", 2) for i in range(6)]
    docs = spark.createDataFrame(rows, SCHEMA + ", text_hash long, root string, spans string, copies int")
    for _, stage in p.STAGES:
        out = stage(spark, docs, "")
        assert stage is p.pack or out.columns == p.COLUMNS
        assert out.count() >= 0
