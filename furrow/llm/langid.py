"""Language identification by compression.

For each language, whole texts of a bounded sample make up a raw-content zstandard dictionary. A whole text,
lower-cased and with one space for whatever isn't letters, in pieces of ``PIECE`` bytes, is compressed with each dictionary; the language whose total is smallest is
chosen (ties: by name). The score is the softmax share of the chosen language, its loss of bytes
against others measured on the scale of ``SCALE`` bytes; the margin is how much smaller, relatively, the
best total is than the second. A margin under ``MARGIN`` is narrow: the text isn't accepted.

Trained on at most ``SAMPLE`` documents a language (the first by a hash of doc_id, 200 to 8,192
characters long) whose crc32(doc_id as text) mod 4 is not 2, whose lang is not null and that have a letter; only text and
lang are learned from. A language with fewer of them is filled up with its other texts: of longer ones the first 8,192
letters count as a document, and shorter ones count by their length, 200 characters a document. Of a language's sample the last
``DICTIONARY`` bytes, with its first documents at the end, are the dictionary. At most ``LANGUAGES`` languages are learned, those with
the most labelled documents.
With no such document every prediction is ``und``. Texts that are null or
have no letter (numerals such as fractions aren't letters) are ``und`` with score 0 and are not accepted. Texts are predicted whole, however
long. Null ids are never held out and never trained on. Every row, repeated or not, has its own result, an empty table none; other
columns are ignored, and of columns that are passed on, those called lang_pred, score, margin or accepted give way to the results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.llm.common import documents, emit, sliced, small_batches

SAMPLE, DICTIONARY, PIECE, LEVEL = 48, 110_000, 1024, 6
SCALE, MARGIN = 8.0, 0.005
LANGUAGES = 512
#: Characters of a text of usual length.
SHORT, LONG = 200, 8192
UNKNOWN = "und"
#: What isn't letters, except numerals that aren't digits: they count as word characters.
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The lower-case words of a text, a space on each side."""
    text = text.lower()
    words = _OTHER.split(text)
    rest = "".join(words)
    if not rest.isalpha():
        # Only numerals that the text has: in the pattern, those beyond 16 bits would be held against each letter one by one.
        for c in set(rest):
            if not c.isalpha():
                text = text.replace(c, " ")
        words = _OTHER.split(text)
    return f" {' '.join(words)} ".encode()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(lang, text) of at most ``size`` documents a language."""
    named = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    # A row a language, LANGUAGES at most: bounded.
    most = named.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "lang").limit(LANGUAGES).select(F.col("lang").alias("_most"))
    named = named.where(F.col("text").rlike(r"\p{L}")).join(F.broadcast(most), F.col("lang") == F.col("_most"), "left_semi")
    able = named.where(F.length("text").between(SHORT, LONG))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = able.select("doc_id", "lang").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= size)
    ids = ids.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "nth")
    # SAMPLE rows of three short columns for each language: bounded.
    texts = able.join(F.broadcast(ids), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    return texts.select("lang", "text", "nth").unionByName(_filling(named, ids, size))


def _filling(named: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(lang, text, nth) of shorter and longer texts for languages with fewer than ``size`` of usual length."""
    have = ids.groupBy(F.col("_lang").alias("lang")).agg(F.count(F.lit(1)).alias("have"))
    other = named.where(~F.length("text").between(SHORT, LONG)).join(F.broadcast(have), "lang", "left")
    other = other.withColumn("have", F.coalesce("have", F.lit(0))).where(F.col("have") < size)
    # Letters alone, as in letters(), before a long text is cut: its first characters may have none.
    text = F.substring(F.regexp_replace("text", r"[^\p{L}]+", " "), 1, LONG)
    other = other.select("doc_id", "lang", "have", text.alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    share = F.least(F.length("text") / SHORT, F.lit(1.0))
    # The shortest texts count for a 200th of a document: more than these rows never fit.
    ids = other.select("doc_id", "lang", "have", share.alias("share")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= size * SHORT)
    before = F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ids = ids.withColumn("before", F.coalesce(before, F.lit(0.0))).where(F.col("have") + F.col("before") < size)
    ids = ids.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), (F.col("have") + F.col("nth")).cast("int").alias("nth"))
    # Rows of three short columns, SAMPLE * SHORT for each language at most: bounded.
    texts = other.join(F.broadcast(ids), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    return texts.select("lang", "text", "nth")


def train(docs: DataFrame, size: int = SAMPLE) -> dict[str, bytes]:
    """The dictionary of each language; what fits last matters most, so the first texts come last."""
    by: dict[str, dict[int, bytes]] = {}
    for r in sample(docs, size).collect():
        by.setdefault(r.lang, {})[r.nth] = letters(r.text)
    out = {}
    for lang, texts in sorted(by.items()):
        out[lang] = b"\n".join(texts[k] for k in sorted(texts, reverse=True))[-DICTIONARY:]
    return out


class Classifier:
    def __init__(self, model: dict[str, bytes]):
        self.langs = sorted(model)
        self.coders = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(model[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin of a whole text."""
        raw = letters(text or "")
        if not self.langs or not raw.strip():
            return UNKNOWN, 0.0, 0.0
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        totals = [sum(len(c.compress(p)) for p in pieces) for c in self.coders]
        best = min(range(len(totals)), key=totals.__getitem__)
        score = 1 / sum(math.exp(max(-700.0, (totals[best] - t) / SCALE)) for t in totals)
        others = [t for i, t in enumerate(totals) if i != best]
        margin = 1 - totals[best] / min(others) if others else 1.0
        return self.langs[best], score, margin


def _predictor(model: dict[str, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(model)
        for b in sliced(batches):
            got = [c.predict(t) for t in b.column("text").to_pylist()]
            lang, score, margin = zip(*got, strict=True) if got else ((), (), ())
            rest = {n: b.column(n) for n in b.schema.names}
            yield emit(rest | {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "margin": pa.array(margin, pa.float64())})

    return run


def identified(docs: DataFrame, model: dict[str, bytes], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` (text among them or not), with lang_pred, score, margin and accepted."""
    small_batches(docs.sparkSession)
    keep = [k for k in keep if k not in ("lang_pred", "score", "margin", "accepted")]
    rows = docs.select(*keep, *([] if "text" in keep else [F.col("text").cast("string").alias("text")]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "lang_pred string, score double, margin double"])
    out = rows.mapInArrow(_predictor(model), schema).withColumn("accepted", F.col("margin") >= MARGIN)
    return out if "text" in keep else out.drop("text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identified(docs, train(docs), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "accepted")
