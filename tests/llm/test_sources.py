import random
import re
import time

from furrow.llm import langid, mixing, packing


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def mixture(spark, seed, n=400):
    r = random.Random(seed)
    names = ["a", "B", "é", "zz", None, "𐀀", "￮"]
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.choice([0, 1, 5, 30, 60]))), r.choices(names, [9, 3, 2, 1, 2, 1, 1])[0], 1) for i in range(n)]
    rows += [(n, None, "a", 1), (None, "no id", "B", 1), (3, rows[3][1], rows[3][2], 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(4)


def brute_targets(sizes):
    """By resharing the excess until none is above; sizes by source in order."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 3 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        free -= over
    return target


def test_mixing(spark):
    rows, docs = mixture(spark, 3)
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed(docs.repartition(2)).collect()), key=str)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * want[r.source]
        assert r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 130, s
    assert sum(taken.values()) <= sum(sizes.values())
    assert mixing.mixed(docs.limit(0)).count() == 0
    alone = mixing.mixed(docs.where("text is null")).collect()
    assert [(r.size, r.target, r.taken) for r in alone] == [(0, 0.0, 0)]


def test_packing(spark):
    rows, docs = mixture(spark, 5)
    docs = docs.unionByName(spark.createDataFrame([(900, "long " * 333, "zz", 1)], docs.schema))
    got = packing.packed(docs, capacity=100, shard=150).collect()
    bins, whole = {}, {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
        if r.doc_id is not None and r.doc_id != 3:
            whole.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, t, _, _ in [*rows, (900, "long " * 333, "zz", 1)]:
        if i is not None and i != 3:
            parts = sorted(whole[i])
            assert sum(n for _, n in parts) == size(t) and [a for a, _ in parts] == [100 * k for k in range(len(parts))]
    for rs in bins.values():
        used = sum(r.length for r in rs)
        assert used <= 100 and all(r.bin_free == 100 - used for r in rs)
        names = [r.source for r in rs if r.source is not None]
        kinds = [r.cluster for r in rs if r.cluster is not None]
        assert len(set(names)) == len(names) and len(set(kinds)) == len(kinds)
        spans = sorted((r.position, r.position + r.length) for r in rs if r.length)
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    assert packing.packed(docs.limit(0)).count() == 0


def test_best_fit_equals_a_plain_search():
    r = random.Random(8)
    items = [(r.randint(0, 130), r.choice([None, "a", "b", "c", "d"]), r.choice([None, *range(30)])) for _ in range(300)]
    placed, left = packing.pack(items, 50)
    bins = []  # left, sources, clusters
    rest = [n - 50 * ((n - 1) // 50) if n else 0 for n, _, _ in items]
    at = iter(placed)
    for i in sorted(range(len(items)), key=lambda i: -rest[i]):
        n, s, c = items[i]
        for k in range((n - rest[i]) // 50):
            bins.append([0, {s} - {None}, {c} - {None}])
            assert next(at) == (i, k, 50, len(bins) - 1, 0)
        fit = [(b[0], j) for j, b in enumerate(bins) if b[0] >= rest[i] and s not in b[1] and c not in b[2]]
        j = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append([50, set(), set()])
        assert next(at) == (i, (n - rest[i]) // 50, rest[i], j, 50 - bins[j][0])
        bins[j][0] -= rest[i]
        bins[j][1] |= {s} - {None}
        bins[j][2] |= {c} - {None}
    assert left == [b[0] for b in bins]


def test_language_by_compression(spark):
    r = random.Random(1)
    parts = {"xx": ["ka", "lo", "mi", "ter"], "yy": ["oué", "ch", "enn", "ßi"], "zz": ["pra", "stu", "vyx", "omo"]}

    def text(lang, n):
        return " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))

    rows = [(i, text(lang, 80), lang, 1.0) for i in range(240) for lang in [r.choice(list(parts))]]
    want = {i: lang for i, _, lang, _ in rows}
    rows += [(1000, None, "xx", 1.0), (1001, "", None, 1.0), (1002, "123 !!", "xx", 1.0), (1003, text("yy", 4000), None, 1.0), (None, text("zz", 80), "zz", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = langid.train(docs)
    assert set(model) == set(parts)
    got = {r.doc_id: r for r in langid.identified(docs, model, ["doc_id"]).withColumn("held_out", langid.held_out()).collect()}
    assert len(got) == len(rows)
    import zlib

    held = [i for i in want if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i in want) and sum(got[i].lang_pred == want[i] for i in held) >= 0.97 * len(held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "yy" and got[None].lang_pred == "zz"
    assert all(0 <= r.score <= 1 for r in got.values()) and not got[1000].accepted
    empty = docs.limit(0)
    assert langid.identified(empty, langid.train(empty), ["doc_id"]).count() == 0
    assert {r.lang_pred for r in langid.identified(docs, {}, ["doc_id"]).collect()} == {"und"}


def test_languages_of_short_or_long_texts_are_learned(spark):
    r = random.Random(2)
    parts = {"xx": ["ka", "lo", "mi", "ter"], "yy": ["oué", "ch", "enn", "ßi"], "zz": ["pra", "stu", "vyx", "omo"], "ww": ["guh", "bja", "fep", "rul"]}

    def text(lang, n):
        return " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))

    words = {"xx": 80, "yy": 10, "zz": 3000}
    rows = [(i, "0 " * 5000 * (lang == "zz") + text(lang, words[lang]), lang) for i in range(240) for lang in ["xx", "yy", "yy", "zz"][i % 4 : i % 4 + 1]]
    rows += [(500 + i, "é" if i % 2 else "12 34", "vv") for i in range(8)] + [(600, text("ww", 20), "ww"), (603, text("ww", 3000), "ww")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert set(model) == {*words, "vv", "ww"}
    # Short texts together make up as much as documents of usual length do, not SAMPLE of them.
    few = langid.sample(docs, 5).where("lang = 'yy'")
    lengths = [len(x.text) for x in few.collect()]
    assert len(lengths) > 5 and 5 * 200 <= sum(lengths) < 6 * 200
    assert max(len(x.text) for x in langid.sample(docs).where("lang = 'zz'").collect()) <= langid.LONG
    got = langid.identified(docs, model, ["doc_id", "lang"]).where("lang <> 'vv'").collect()
    assert sum(x.lang_pred == x.lang for x in got) >= 0.97 * len(got)
    # With usual texts enough, no others are taken.
    assert {len(x.text) >= langid.SHORT for x in langid.sample(docs, 5).where("lang = 'xx'").collect()} == {True}


def test_numerals_are_not_letters_and_results_replace_columns(spark):
    r = random.Random(4)
    text = lambda parts, n: " ".join("".join(r.choice(parts) for _ in range(3)) for _ in range(n))
    rows = [(i, text(["ka", "lo"], 60) if i % 2 else text(["zü", "rr"], 60), "xy"[i % 2], 0.5, "m") for i in range(60)]
    odd = ["½ ² Ⅷ", "Ⅷ", "٣٤", "___", "①②", "\u0301", "²" + text(["ka", "lo"], 20)]
    rows += [(100 + i, t, None, 0.5, "m") for i, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, margin string")
    got = {x.doc_id: x for x in langid.identified(docs, langid.train(docs), ["doc_id", "score", "margin", "lang"]).collect()}
    assert [got[100 + i].lang_pred for i in range(6)] == ["und"] * 6 and got[106].lang_pred == "y"
    assert all(got[100 + i].score == 0 and not got[100 + i].accepted for i in range(6))


def test_predictions_equal_brute_force(spark):
    """The language whose dictionary makes a text's pieces smallest, worked out row by row from the sample alone."""
    import math

    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {}
    for x in langid.sample(docs).collect():
        texts.setdefault(x.lang, []).append((x.nth, x.text))
    clean = lambda t: (" " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in t.lower())) + " ").encode()
    model = {k: zstandard.ZstdCompressionDict(b"\n".join(clean(t) for _, t in sorted(v, reverse=True))[-langid.DICTIONARY :], dict_type=zstandard.DICT_TYPE_RAWCONTENT) for k, v in texts.items()}
    for d in model.values():
        d.precompute_compress(level=langid.LEVEL)
    got = {x.doc_id: x for x in langid.query(spark, "/root/testdata/sf0.001").collect()}
    right = held = 0
    for x in docs.collect():
        raw = clean(x.text or "")
        if not raw.strip():
            assert got[x.doc_id].lang_pred == "und"
            continue
        pieces = [raw[i : i + langid.PIECE] for i in range(0, len(raw), langid.PIECE)]
        size = {k: sum(len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(p)) for p in pieces) for k, d in model.items()}
        best = min(sorted(size), key=size.get)
        assert got[x.doc_id].lang_pred == best
        assert abs(got[x.doc_id].score - 1 / sum(math.exp((size[best] - n) / langid.SCALE) for n in size.values())) < 1e-9
        if got[x.doc_id].held_out and x.lang is not None:
            held += 1
            right += best == x.lang
    assert held > 20 and right >= 0.95 * held


def test_rows_without_ids_are_spread(spark):
    """9,000 rows without an id: no shard or slice has them all, and the results keep their promises."""
    rows = [(None, f"word {i} " + "x " * (i % 40), "abc"[i % 3]) for i in range(9000)] + [(None, "same text", "d")] * 900
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = packing.packed(docs, capacity=100, shard=256).collect()
    assert len(got) == len(rows)
    bins, shards = {}, {}
    for x in got:
        bins.setdefault(x.bin_id, []).append(x)
        shards[x.bin_id >> 32] = shards.get(x.bin_id >> 32, 0) + 1
    assert len(shards) > 30 and sorted(shards.values())[-2] < 500
    for b in bins.values():
        assert sum(x.length for x in b) + b[0].bin_free == 100 and len({x.bin_free for x in b}) == 1
        assert len({x.source for x in b}) == len(b) == len({x.cluster for x in b})
    slices = mixing.sized(docs).selectExpr("substring(h, 1, 3) AS s").groupBy("s").count().orderBy("count", ascending=False).head(2)
    assert slices[1]["count"] < 20
    assert sum(x.taken for x in mixing.mixed(docs).collect()) <= sum(size(t) for _, t, _ in rows)


def test_letters_cost_about_a_plain_pattern():
    """Words are runs of letters, of all characters; numerals that the pattern has no class for don't slow it down."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for text in ("".join(chars), "".join(f"a{c}B " for c in chars if c.isalnum()), "", "½", "x²𐄇y", "_é1"):
        low = text.lower()
        spaced = "".join(c if c.isalpha() else " " for c in low)
        assert langid.letters(text) == f" {re.sub(' +', ' ', spaced)} ".encode()
    plain = re.compile(r"[\W\d_]+")

    def least(f, text):
        took = []
        for _ in range(5):
            start = time.process_time()
            f(text)
            took.append(time.process_time() - start)
        return min(took)

    text = "ein schöner Text, 12 mots écrits avec soin; " * 5000
    usual = least(lambda t: plain.sub(" ", t.lower()).encode(), text)
    assert least(langid.letters, text) < 6 * usual
    assert least(langid.letters, "𐄇" + text + "½ Ⅷ") < 6 * usual
