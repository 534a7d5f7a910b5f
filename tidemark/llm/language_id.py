"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence are added as log likelihoods: the text (byte trigrams of its words, a naive
Bayes model), the language that the markup declares, the language that the address suffix suggests,
and a prior of the host.  Host priors come from grouped aggregation over all rows and are smoothed
hierarchically: host towards its parent domain, parent towards the whole table.  A further class
with a flat distribution stands for text in no known language: trigrams that a language's labelled texts hardly ever have
speak for it.

The model is fitted on labelled rows only, at most PER_LANGUAGE of each language; labels are evidence for no row.
Everything else covers all rows.  Texts are read once; priors are joined to rows of a few numbers, not to texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import html_text
from tidemark.llm.common import after_scheme, drop_rows, few_files, host_of, stash, text_of

#: Labelled rows of each language for the text model: the rows with the least hash of their id.
PER_LANGUAGE = 400
#: Buckets of byte trigrams.
BUCKETS = 1 << 15
#: Weight of the parent, in rows, in a host's prior; and of the whole in a parent's.
SMOOTHING = 20.0
#: Probability that markup and address suffix tell the truth.
DECLARED_TRUE, SUFFIX_TRUE = 0.9, 0.75
#: A row is kept if its best language has so much of the posterior.
CONFIDENCE = 0.5

# Languages that a country's address suffix suggests.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh"}

_LETTER = np.zeros(256, np.int64)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray) -> np.ndarray:
    """Buckets of the trigrams of a text's UTF-8 bytes; whatever is no letter counts as one gap between words."""
    x = np.concatenate(([0], _LETTER[data], [0]))
    x = x[(x != 0) | np.concatenate(([True], x[:-1] != 0))]
    if x.size < 3:
        return x[:0]
    a, b, c = x[:-2], x[1:-1], x[2:]
    mixed = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
    return ((mixed * 0x27D4EB2F & 0xFFFFFFFF) >> 17)[b != 0]


@dataclass
class Model:
    """Languages, and the log probability of each trigram bucket (row) in each (column), the flat class last."""

    languages: list[str]
    table: np.ndarray


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = np.bincount(trigrams(np.frombuffer(text.as_buffer(), np.uint8)), minlength=BUCKETS)
            sums[label] = sums[label] + found if label in sums else found
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.string()), pa.array([s.astype("<i8").tobytes() for s in sums.values()], pa.binary())], ["label", "counts"]
    )


def fit(docs: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id") -> Model:
    """The model of docs' labels, from at most PER_LANGUAGE rows of each: two reads of the labels, one of the sampled texts."""
    named = docs.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("l"), F.xxhash64(F.col(doc_id).cast("string")).alias("o"), text_of(text).alias("body"))
    sizes = {r["l"]: r["count"] for r in named.groupBy("l").count().collect()}  # a row for each language
    labels = sorted(sizes)
    if not labels:
        return Model([], np.zeros((BUCKETS, 1), np.float32))
    # a hash threshold leaves about four times the rows wanted, so that ranking moves few whatever the table's size
    thin = F.lit(False)
    for one in labels:
        share = min(1.0, 4.0 * PER_LANGUAGE / sizes[one])
        thin = thin | ((F.col("l") == one) & (F.col("o") <= F.lit(int(-(2**63) + share * (2**64 - 2048)))))
    ranked = named.where(thin).withColumn("rank", F.row_number().over(Window.partitionBy("l").orderBy("o", "body")))
    sample = ranked.where(F.col("rank") <= PER_LANGUAGE).select("l", "body")
    counts = {one: np.zeros(BUCKETS) for one in labels}
    for row in sample.mapInArrow(_count, "label string, counts binary").toLocalIterator():  # a row for each task and language
        counts[row.label] += np.frombuffer(row.counts, "<i8")
    table = np.stack([counts[one] + 0.1 for one in labels] + [np.ones(BUCKETS)])
    return Model(labels, np.log(table / table.sum(axis=1, keepdims=True)).T.astype(np.float32))


def _weigh(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = []
        for text in batch.column(batch.num_columns - 1):
            grams = trigrams(np.frombuffer(text.as_buffer(), np.uint8))
            total = np.zeros(table.shape[1])
            for lo in range(0, grams.size, 1 << 16):
                total += table[grams[lo : lo + (1 << 16)]].sum(axis=0, dtype=np.float64)
            sums.append(total)
        n = len(sums)
        ends = np.arange(n + 1, dtype=np.int32) * table.shape[1]
        weights = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sums) if n else np.zeros(0)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], weights], [*batch.schema.names[:-1], "weights"])


def _voice(said: Column, languages: list[str], true: float) -> Column:
    """Log likelihood of a statement under each language and the flat class; nothing said weighs nothing."""
    n = len(languages)
    right, wrong = float(np.log(true)), float(np.log((1 - true) / max(1, n - 1)))
    known = F.coalesce(said.isin(languages), F.lit(False))
    return F.array(*[F.when(~known, 0.0).when(said == one, right).otherwise(wrong) for one in languages], F.lit(float(np.log(1 / n))) * known.cast("int"))


def identify(rows: DataFrame, model: Model, text: Column, host: Column, declared: Column, suffix: Column, keys: list[str]) -> DataFrame:
    """keys, language (null if none), confidence, text_language, host, kept, reason (why not kept): a row for each row.

    text, host, declared and suffix are columns of rows; null is no evidence, as is a declared language that the model doesn't have.  Not
    kept are texts without letters ('no letters': no language), texts for which the flat class speaks ('foreign': no language),
    and those whose best language has less than CONFIDENCE of the posterior ('uncertain').  Languages are those of the
    model.  keys are columns of rows that are handed on.
    """
    languages, table = model.languages, model.table
    n = len(languages)
    spec = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    if not languages:  # nothing labelled: nothing is known
        empty = rows.select(*keys, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_language"), host.alias("host"))
        return empty.withColumn("kept", F.lit(False)).withColumn("reason", F.lit("foreign"))
    given = rows.select(*keys, F.coalesce(host, F.lit("")).alias("host"), declared.alias("declared"), suffix.alias("suffix"), F.coalesce(text, F.lit("")).alias("body"))
    weighed = stash(given.mapInArrow(lambda b: _weigh(b, table), f"{spec}, host string, declared string, suffix string, weights array<double>"), "weights")

    names = F.array(*[F.lit(x) for x in languages], F.lit(None).cast("string"))
    best = lambda a: F.array_position(a, F.array_max(a)).cast("int")
    seen = F.exists("weights", lambda w: w != 0)
    said = weighed.select("*", F.when(seen, F.element_at(names, best(F.col("weights")))).alias("text_language"), F.substring_index("host", ".", -2).alias("parent"))
    # priors: what the texts alone say, counted by host, parent and in all
    counts = stash(few_files(said.where("text_language is not null").groupBy("parent", "host", "text_language").agg(F.count(F.lit(1)).alias("n"))), "counts")
    each = [F.sum(F.when(F.col("text_language") == x, F.col("n")).otherwise(0)).alias(f"c{i}") for i, x in enumerate(languages)]
    whole = counts.agg(*[F.coalesce(e, F.lit(0)) for e in each]).first()
    overall = [(float(c or 0) + 1.0) / (float(sum(c or 0 for c in whole)) + n) for c in whole]
    by_parent, by_host = counts.groupBy("parent").agg(*each), counts.groupBy("parent", "host").agg(*each)

    def smoothed(own: str, above: list[Column]) -> list[Column]:
        total = sum((F.col(f"{own}.c{i}") for i in range(n)), F.lit(0))
        return [(F.col(f"{own}.c{i}") + SMOOTHING * above[i]) / (total + SMOOTHING) for i in range(n)]

    middle = smoothed("p", [F.lit(x) for x in overall])
    priors = by_host.alias("h").join(by_parent.alias("p"), F.expr("h.parent = p.parent"))
    priors = stash(few_files(priors.select(F.col("h.host").alias("host"), F.array(*[F.log(x) for x in smoothed("h", middle)]).alias("prior"))), "priors")
    plain = F.array(*[F.lit(float(np.log(x))) for x in overall])
    flat = float(np.log(0.01))  # prior of a text in no known language
    fused = said.join(priors, "host", "left").withColumn("prior", F.concat(F.coalesce("prior", plain), F.array(F.lit(flat))))
    total = F.col("weights")
    for voice in (F.col("prior"), _voice(F.col("declared"), languages, DECLARED_TRUE), _voice(F.col("suffix"), languages, SUFFIX_TRUE)):
        total = F.zip_with(total, voice, lambda a, b: a + b)
    fused = fused.withColumn("total", total)
    top = F.array_max("total")
    share = 1.0 / F.aggregate("total", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    fused = fused.withColumn("language", F.when(seen, F.element_at(names, best(F.col("total"))))).withColumn("confidence", F.when(seen, share).otherwise(0.0))
    reason = F.when(~seen, "no letters").when(F.col("language").isNull(), "foreign").when(F.col("confidence") < CONFIDENCE, "uncertain")
    return fused.select(*keys, "language", "confidence", "text_language", "host", reason.isNull().alias("kept"), reason.alias("reason"))


def suffix_language(host: Column) -> Column:
    """What the last label of a host suggests, or null."""
    last = F.substring_index(host, ".", -1)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair]), last)


def identify_pages(pages: DataFrame, model: Model, page: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, url, declared, language, confidence, text_language, host, kept, reason: a row for each page.

    The text is the page's main text, declared what its html element says (the part before the first '-' or '_', null if
    nothing), the host and its suffix come from the url.  Null or empty html: no letters, not kept.  A null url has the empty host.
    Repeated pages give repeated rows; other columns are ignored.
    """
    read = html_text.extract(pages, page, url, page_id).withColumn("declared", F.nullif(F.split("lang", "[-_]")[0], F.lit("")))
    read = read.withColumn("site", host_of(after_scheme(F.col("url")))).withColumn("label", F.col("declared"))
    found = identify(read, model, F.col("text"), F.col("site"), F.col("declared"), suffix_language(F.col("site")), ["page_id", "url", "label"])
    return found.withColumnRenamed("label", "declared")


def identify_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "lang", source: str = "source", model: Model | None = None) -> DataFrame:
    """k1, k2 (keys of the row), doc_id, language, confidence, text_language, host, kept, reason: a row for each document.

    The model is fitted on the label column unless one is given; a row's own label isn't evidence for it.  source takes the
    host's place; documents have no markup, so nothing is declared.  Null or empty text: no language, not kept.  Null source: the
    empty host.  Nothing labelled at all: nothing is kept.  Repeated rows give repeated rows; other columns are ignored.
    """
    model = model or fit(docs, text, label, doc_id)
    id_ = F.col(doc_id).cast("long")
    keyed = docs.select(
        F.xxhash64(id_, text_of(text)).alias("k1"), F.xxhash64(text_of(text), id_, F.lit(7)).alias("k2"), id_.alias("doc_id"),
        text_of(text).alias("body"), F.lower(F.col(source).cast("string")).alias("site"),
    )
    return identify(keyed, model, F.col("body"), F.col("site"), F.lit(None).cast("string"), suffix_language(F.col("site")), ["k1", "k2", "doc_id"])


def drop_foreign(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "lang", source: str = "source", model: Model | None = None) -> DataFrame:
    """The rows of docs, all columns, less those that identify_documents() doesn't keep: without letters, foreign to the
    labelled languages, or uncertain.  Repeated rows share their fate."""
    rejected = identify_documents(docs, text, doc_id, label, source, model).where("not kept").select("k1", "k2").distinct()
    return drop_rows(docs, stash(few_files(rejected), "rejected"), text, doc_id)
