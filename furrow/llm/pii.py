"""Personal data: base patterns, and contextual extraction that bootstraps from them.

Base: the leftmost matches of each kind that don't overlap, dropped (not retried) where the digits, the
parts or the Luhn sum fail. Every match, and every other token of four characters or more with a digit, an @ or an (at) in it
(a candidate), is an occurrence of an instance (its text) in a lexical pattern: the two words before it, lower-cased (``^`` where the
text begins; of a word of more than ``WORD`` characters its end, and then no word before it).
A run of digits with spaces and the other separators of ``SHAPE`` that looks like a card or a phone is one candidate in
place of its tokens. Seeds are the instances of the base patterns. Patterns and instances make a graph that Spark scores in turn:
a pattern's confidence for a kind is the mean confidence of its distinct instances (others count 0), with at least
``SUPPORT`` distinct instances among them that are seeds of the kind or were found: they look like it and were believed in the round
before. An instance's is 1 - prod(1 - confidence of its patterns) and 1 for seeds; below one half it is a doubt and counts 0. So found
identifiers induce patterns that no seed is in, and these find others. Confidences only rise, and rounds end when no pattern
is new and none has risen by ``STEP``. Then candidates whose own pattern has at least ``CONFIDENT`` and that look like the
kind become spans, unless they touch a base span.

Null texts count as empty. Texts may be of any length: an occurrence is read with its context alone. Offsets are code points, ends
exclusive. Repeated rows each have their own (equal) result; repeated or null ids are told apart by the text's hash. Counts and the
digest are of the base spans; ``spans`` holds all. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import documents, dropped, emit, joined, sliced, small_batches, written

KINDS = ("email", "ip", "card", "phone")
SUPPORT, CONFIDENT, STEP = 5, 0.8, 0.01
WORDS, WORD = 2, 64

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: No match can begin inside a run of digits where none begins at its start; so each run is read once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<!\S)(?:[^\s0-9@(\[]|[(\[](?!at[)\]]))*+[0-9@(\[]\S*+")
#: A run of digits, its separators as in the shapes of cards and phones; possessive, so each is read once.
_RUN = re.compile(r"(?<![\w@])\(?[0-9](?:[\x20()./-]{0,2}+[0-9])*+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EDGE = "\"'()[]{}<>,;:!?."
_QUOTES = "\"'()"
#: What a candidate must look like at the least, beside e-mail addresses (see shapes()).
SHAPE = {
    "ip": r"^[0-9]{1,3}([.,:-][0-9]{1,3}){3,}$",
    "card": r"^[0-9]([ ./-]?[0-9]){11,18}$",
    "phone": r"^\(?[0-9]([ ()./-]{0,2}[0-9]){5,14}$",
}
_SHAPES = {k: re.compile(v) for k, v in SHAPE.items()}
_SPACED = re.compile(f"{SHAPE['card']}|{SHAPE['phone']}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base matches, by kind as listed, then start."""
    text = text or ""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() < 64 else ""
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def joined_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def spaced_runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of digits with spaces among them that look like a card or a phone, in order."""
    for m in _RUN.finditer(text):
        a, b = m.span()
        # 19 digits with two separators between any two and a bracket: 56 characters.
        if b - a <= 56 and " " in m[0] and not text[b : b + 1].isalnum() and text[b : b + 1] not in ("_", "@") and _SPACED.match(m[0]):
            yield a, b


def context(text: str, at: int) -> str:
    """The pattern that what starts at ``at`` occurs in."""
    reach = 3 * WORD
    while True:
        low = max(0, at - reach)
        words = text[low:at].rstrip(_QUOTES).split()
        # The first word may go on to the left of what is read; that doesn't matter if it is long already.
        if not low or len(words) > WORDS or any(len(w) > WORD for w in words[-WORDS:]):
            break
        reach *= 2
    out: list[str] = []
    for w in reversed(words[-WORDS:]):
        out.append(w if len(w) <= WORD else w[-WORD:])
        if len(w) > WORD:
            break
    else:
        out += ["^"] * (WORDS - len(out))
    return " ".join(reversed(out)).lower()


def instance(found: str) -> str:
    """A name for the identifier: itself in lower case, or a digest of a long one."""
    found = found.lower()
    return found if len(found) <= WORD else "#" + hashlib.blake2b(found.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def shapes(found: str) -> str:
    """The kinds that it looks like, each followed by a space."""
    found = found.lower()
    # One @, or none and an (at), with something on both sides: linear where a pattern would try them all.
    if "@" in found:
        mail = found.count("@") == 1 and "@" not in (found[0], found[-1])
    else:
        mail = any(0 < found.find(at, 1) < len(found) - len(at) for at in ("(at)", "[at]"))
    return "email " * mail + "".join(f"{k} " for k, shape in _SHAPES.items() if shape.match(found))


def occurrences(text: str | None, base: list[tuple[str, int, int]]) -> list[tuple[str, str, str, str | None, int, int]]:
    """(pattern, instance, shapes, kind or None, start, end) of the base spans and the candidates of a text."""
    text = text or ""
    found = [(a, b, k) for k, a, b in base]
    taken = sorted((a, b) for a, b, _ in found)
    runs, i = [], 0
    for a, b in spaced_runs(text):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if not (i < len(taken) and taken[i][0] < b):
            runs.append((a, b))
    found += [(a, b, None) for a, b in runs]
    taken, i = sorted(taken + runs), 0
    for m in _TOKEN.finditer(text):
        raw = m[0]
        a = m.start() + len(raw) - len(raw.lstrip(_EDGE))
        b = m.end() - (len(raw) - len(raw.rstrip(_EDGE)))
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if b - a >= 4 and not (i < len(taken) and taken[i][0] < m.end()):
            found.append((a, b, None))
    return [(context(text, a), instance(text[a:b]), f"{k} " if k else shapes(text[a:b]), k, a, b) for a, b, k in found]


_SEEN = ("pattern", "instance", "shapes", "kind", "start", "end")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct([(n, pa.int64() if n in ("start", "end") else pa.string()) for n in _SEEN])
    for b in sliced(batches):
        base, seen = [], []
        for t in b.column("text").to_pylist():
            base.append(base_spans(t))
            seen.append([dict(zip(_SEEN, o, strict=True)) for o in occurrences(t, base[-1])])
        counts = {f"n_{k}": pa.array([sum(1 for s in x if s[0] == k) for x in base], pa.int64()) for k in KINDS}
        text = [joined_spans(x) for x in base]
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in text]
        yield emit(
            {"doc_id": b.column("doc_id"), "text_hash": b.column("text_hash")}
            | counts
            | {"base_sha256": pa.array(sha, pa.string()), "base": pa.array(text, pa.string()), "seen": pa.array(seen, pa.list_(item))}
        )


SCANNED = (
    "doc_id long, text_hash long, "
    + ", ".join(f"n_{k} long" for k in KINDS)
    + ", base_sha256 string, base string, seen array<struct<pattern: string, instance: string, shapes: string, kind: string, start: long, end: long>>"
)


def scanned(docs: DataFrame) -> DataFrame:
    """Base spans and occurrences of every row, written to the shared folder."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(_scan, SCANNED), "pii")


def patterns(seen: DataFrame, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that qualify; seen: pattern, instance, shapes, kind of occurrences."""
    edges = seen.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.max("shapes").alias("shapes"))
    edges = written(edges, "edges")
    # A seed anywhere is a seed everywhere.
    seeds = edges.where("kind is not null").groupBy("instance").agg(F.max("kind").alias("target")).withColumns({"belief": F.lit(1.0), "found": F.lit(True)})
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size"))
    known, before = seeds, None
    while True:
        votes = joined(edges.drop("kind", "shapes"), known, ["instance"]).groupBy("pattern", "target").agg(F.sum("belief").alias("belief"), F.count_if("found").alias("n")).where(F.col("n") >= support)
        scores = written(joined(votes, sizes, ["pattern"]).select("pattern", "target", (F.col("belief") / F.col("size")).alias("confidence")), "scores")
        if before is None:
            risen = not scores.isEmpty()
        else:
            risen = not joined(scores, before.withColumnRenamed("confidence", "was"), ["pattern", "target"], "left").where((F.col("confidence") - F.coalesce("was", F.lit(-1.0))) >= STEP).isEmpty()
            dropped(before)
        if not risen:
            return scores.where(F.col("confidence") >= confident).select("pattern", F.col("target").alias("kind"), "confidence")
        before = scores
        told = joined(edges, scores, ["pattern"]).groupBy("instance", "target").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999999)))))).alias("belief"), F.max(_shaped("target")).alias("found"))
        # Beliefs below one half are doubts, not evidence.
        told = told.where(F.col("belief") >= 0.5).select("instance", "target", "belief", "found").unionByName(seeds)
        known = told.groupBy("instance", "target").agg(F.max("belief").alias("belief"), F.max("found").alias("found"))


def _shaped(kind: str = "kind") -> Column:
    return F.contains(F.col("shapes"), F.concat(F.col(kind), F.lit(" ")))


def extracted(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, the base counts and digest, and all spans of every row."""
    rows = scanned(docs)
    seen = rows.select("doc_id", "text_hash", F.inline("seen"))
    good = patterns(seen.select("pattern", "instance", "shapes", "kind"))
    new = joined(seen.where("kind is null").drop("kind"), good, ["pattern"]).where(_shaped())
    best = new.groupBy("doc_id", "text_hash", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    added = best.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    out = joined(rows.drop("seen"), added, ["doc_id", "text_hash"], "left")
    parts = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct(F.split(s, ":")[0].alias("kind"), F.split(s, ":")[1].cast("long").alias("start"), F.split(s, ":")[2].cast("long").alias("end")))
    every = F.concat(parts, F.coalesce(F.col("added"), F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")))
    order = F.array(*[F.lit(k) for k in KINDS])
    every = F.array_sort(F.transform(every, lambda s: F.struct(F.array_position(order, s["kind"]).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    out = out.withColumn("spans", F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","))
    return out.select("doc_id", "text_hash", *[f"n_{k}" for k in KINDS], "base_sha256", "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(documents(spark, sf_dir)).drop("text_hash")


def _masker(name: str):
    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = []
            for t, spans in zip(b.column("text").to_pylist(), b.column(name).to_pylist(), strict=True):
                if t and spans:
                    cut = sorted((int(a), int(e), k) for k, a, e in (s.split(":") for s in spans.split(",")))
                    parts, at = [], 0
                    for a, e, k in cut:
                        if a >= at:
                            parts += [t[at:a], f"<{k}>"]
                        at = max(at, e)
                    t = "".join(parts) + t[at:]
                out.append(t)
            yield emit({n: pa.array(out, pa.string()) if n == "text" else b.column(n) for n in b.schema.names if n != name})

    return mask


def masked(docs: DataFrame) -> DataFrame:
    """``docs``, every column, with each span of text replaced by its kind in angle brackets; where spans of
    two kinds overlap, the union goes and the first kind is named."""
    # Names that no column of the caller's has.
    free = "_" * max((len(c) - len(c.lstrip("_")) + 1 for c in docs.columns), default=1)
    found = extracted(docs).where("spans <> ''").select(F.col("doc_id").alias(free + "doc"), F.col("text_hash").alias(free + "hash"), F.col("spans").alias(free + "spans")).distinct()
    keyed = docs.withColumns({free + "doc": F.col("doc_id").cast("long"), free + "hash": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    got = joined(keyed, found, [free + "doc", free + "hash"], "left").select(*[F.col(f"`{c}`") for c in docs.columns], free + "spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return got.mapInArrow(_masker(free + "spans"), schema)
