import hashlib
import random
import re

from pyspark.sql import Row

from furrow.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = digits(m[0])
        s = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    r = random.Random(5)
    for _ in range(4000):
        t = "".join(r.choice("a.@-+ 12590(%_é") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == brute(t), t
    for _ in range(2000):
        t = "".join(r.choice("0123456789 -.+") for _ in range(r.randint(10, 60)))
        assert pii.base_spans(t) == brute(t), t


def test_long_runs_are_linear():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" + " " * 300_000, "a@" * 100_000, "é" * 300_000 + " 4"):
        pii.occurrences(t, pii.base_spans(t))


def rows(spark, texts, first=0):
    return spark.createDataFrame([Row(doc_id=i + first, text=t, source="s", n_email=1) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_email int")


def test_patterns_discover_unseen_identifiers(spark):
    texts = [f"you can mail me at box user{i}.x@mail{i}.example.com today" for i in range(12)]
    texts += ["please mail me at box jane(at)example.org today", "and the box the room(at)noon we meet", None, "", "plain 12 34 words"]
    docs = rows(spark, texts)
    got = {r.doc_id: r for r in pii.extracted(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = brute(t or "")
        assert got[i].base_sha256 == hashlib.sha256(pii.joined_spans(base).encode()).hexdigest()
        assert got[i].n_email == len([1 for b in base if b[0] == "email"])
    a = texts[12].index("jane")
    assert got[12].spans == f"email:{a}:{a + len('jane(at)example.org')}"
    assert got[13].spans == "" and got[14].spans == "" and got[16].spans == ""
    out = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    assert out[12] == "please mail me at box <email> today" and out[0] == "you can mail me at box <email> today"
    assert out[14] is None and out[15] == "" and out[16] == texts[16]


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = rows(spark, ["call +1 314 555 6532 now"]).unionByName(rows(spark, ["call +1 314 555 6532 now"]))
    docs = docs.unionByName(spark.createDataFrame([(None, "ip 10.0.0.1", None, None)], docs.schema))
    got = pii.extracted(docs).collect()
    assert sorted((r.doc_id is None, r.spans) for r in got) == [(False, "phone:5:20")] * 2 + [(True, "ip:3:11")]
    assert pii.masked(docs).count() == 3
    assert pii.extracted(docs.limit(0)).count() == 0


def test_identifiers_with_spaces_are_one_candidate():
    for text, own in (
        ("please ring me (314) 555-6532 soon", "(314) 555-6532"),
        ("please ring me 0314 555 6532.", "0314 555 6532"),
        ("card of mine 4111 1111 1111 1112, paid", "4111 1111 1111 1112"),
        ("card of mine 4111 1111 1111 1111, paid", None),
        ("a b 0314 555 6532x", None),
        ("on the 12 34 of", None),
    ):
        got = [o for o in pii.occurrences(text, pii.base_spans(text)) if o[3] is None and " " in o[1]]
        assert [(o[1], text[o[4] : o[5]].lower()) for o in got] == ([(own, own)] if own else []), text
        spans = sorted(o[4:] for o in pii.occurrences(text, pii.base_spans(text)))
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_long_spaced_runs_are_linear():
    for t in ("1 " * 150_000 + "a", "(1) " * 100_000, "a1 1" * 100_000, "1  " * 100_000):
        pii.occurrences(t, pii.base_spans(t))


def test_spaced_identifiers_are_masked_and_found_ones_induce_patterns(spark):
    texts = [f"just call me +1 314 555 6{i}32 now" for i in range(12)] + [f"just call me 0314 555 7{i}32 now" for i in range(10, 16)]
    # No seed follows "tel number"; the numbers found above do, and one that is nowhere else.
    texts += [f"the tel number 0314 555 7{i}32 is" for i in range(10, 16)] + ["the tel number (0314) 555 9999 is", "one of us 0314 555 8888 is"]
    docs = rows(spark, texts)
    out = [r.text for r in pii.masked(docs).orderBy("doc_id").collect()]
    assert out[:18] == ["just call me <phone> now"] * 18
    assert out[18:] == ["the tel number <phone> is"] * 7 + texts[-1:]


def test_no_occurrence_is_left_out_for_its_length():
    long = "x" * 120 + "1(at)example.org"
    word = "w" * 80
    for text in (f"write to {long} now", f"{word} {word} mail@example.org now", "mail@example.org", f"a b{' ' * 500}mail@example.org", f"{word}:mail@example.org"):
        assert len(pii.occurrences(text, pii.base_spans(text))) == 1, text
    pattern = lambda t: pii.occurrences(t, pii.base_spans(t))[0][0]
    assert pattern("Send it, please: mail@example.org") == "it, please:"
    assert pattern("mail@example.org") == "^ ^" and pattern("to mail@example.org") == "^ to"
    assert pattern(f"to {word} mail@example.org") == "w" * 64 and pattern(f"{word} to mail@example.org") == "w" * 64 + " to"
    assert pattern(f"a b{' ' * 500}mail@example.org") == "a b"
    for t in ("(at)" * 100_000, "a(at)" * 100_000 + "@x@", "é@" * 100_000, "x@y.z," * 50_000, " " * 300_000 + "x@y.z"):
        pii.occurrences(t, pii.base_spans(t))


def test_each_round_adds_patterns_until_none_is_new(spark):
    """Seeds induce the first pattern; what it finds induces the second, that the third, that the fourth."""
    name = lambda k, i: f"{k}{i}(at)example.org"
    texts = [f"mail me at s{i}@example.org now" for i in range(30)] + [f"mail me at {name('a', i)} now" for i in range(6)]
    texts += [f"write us via {name('a', i)} now" for i in range(6)] + [f"write us via {name('b', i)} now" for i in range(1)]
    for k, before, then in (("c", "a", "reach them under"), ("d", "c", "she answers from"), ("e", "d", "post goes through")):
        old = [f"{then} {name(before, i)} now" for i in range(6)]
        # Five that are found in this pattern only carry the next one.
        texts += old + [f"{then} {name(k, 0)} now"]
        texts += [f"{then} {name(k, i)} now" for i in range(1, 2)] + [f"mail me at {name(k, i)} now" for i in range(2, 6)]
    texts += ["elsewhere we saw z9(at)example.org now"]
    docs = rows(spark, texts)
    out = [r.text for r in pii.masked(docs).orderBy("doc_id").collect()]
    assert all("<email>" in t and "(at)" not in t for t in out[:-1]) and out[-1] == texts[-1]


def test_clashing_names_and_long_texts(spark):
    text = "call +1 314 555 6532 now " + "word " * 200_000 + "ip 10.0.0.1"
    docs = spark.createDataFrame([(1, text, "a", 5, "b", "k"), (1, "other", None, None, None, None)], "doc_id long, text string, spans string, text_hash int, _doc string, kind string")
    got = {r.spans: r for r in pii.masked(docs).collect()}
    assert len(got) == 2 and got["a"].text_hash == 5 and got["a"]._doc == "b" and got["a"].kind == "k"
    assert got["a"].text == "call <phone> now " + "word " * 200_000 + "ip <ip>" and got[None].text == "other"
    assert pii.masked(docs).columns == docs.columns and pii.masked(docs.limit(0)).count() == 0
