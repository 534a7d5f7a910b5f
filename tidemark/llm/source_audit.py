"""Source divergence audit: how far the vocabulary of each source of a language lies from that of the others.

Documents become partial counts of terms in Arrow batches, a row for each group and term that a task has met, so a hot source
sends its vocabulary and not its tokens.  The terms of a language are dealt into blocks of about BLOCK.  A block is one dense int64
matrix, sources by terms; all pairs of its rows are compared by broadcasting, and each source keeps its foremost terms.  The pairs'
partial sums are added, and the blocks' foremost terms merged, by grouping.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import drop_stash, stash, text_of

#: Terms of a block, cells of the matrices that one step of a block's comparison makes, and distinct terms that a task holds before it
#: sends them on.  They bound memory; no result depends on them.
BLOCK, CELLS, HELD = 2048, 1 << 20, 400_000
#: Rows up to which the table of languages is broadcast; beyond it Spark joins by shuffle.
FEW = 20_000
#: One part in a thousand millions: the unit of a term's share.
UNIT = 1_000_000_000

#: UTF-8 bytes of letters (A-Z in lower case) and of everything outside ASCII stay; all others part terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, body) to (lang, source, term, uses, docs): occurrences of a term and documents with it."""
    uses: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    held = 0

    def send() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in uses.items():
            n, seen = len(counts), docs[lang, source]
            terms = list(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array(counts.values(), pa.int64()), pa.array([seen[t] for t in terms], pa.int64()),
                ],
                ["lang", "source", "term", "uses", "docs"],
            )
        uses.clear()
        docs.clear()

    for batch in batches:
        for lang, source, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            terms = body.as_py().translate(_TERMS).split()
            if not terms:
                continue
            group = uses.setdefault((lang, source), Counter())
            before = len(group)
            group.update(terms)
            docs.setdefault((lang, source), Counter()).update(set(terms))
            held += len(group) - before
            if held > HELD:
                yield from send()
                held = 0
    yield from send()


def shares(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / (total + terms)), in int64, or in Python's integers where that would overflow."""
    if counts.size and counts.max() >= 2**63 // UNIT - 1:
        counts, totals = counts.astype(object), totals.astype(object)
    return 1 + UNIT * (counts + 1) // (totals + terms)


def pair_sums(p: np.ndarray) -> np.ndarray:
    """Sums over terms of floor((p - q)**2 / q), p from each row of the matrix and q from each.

    The shares of a row add up to UNIT and one for each term, so int64 holds any sum as long as a language has under 500 million terms.
    """
    n, terms = p.shape
    out = np.zeros((n, n), p.dtype)
    rows = max(1, CELLS // max(1, n * terms))
    for lo in range(0, n, rows):
        gap = p[lo : lo + rows, None, :] - p[None, :, :]
        out[lo : lo + rows] = (gap * gap // p[None, :, :]).sum(axis=2)
    return out


def _tile(top: int, key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
    """One block of terms of a language: the pairs' partial sums and the foremost terms of each source."""
    names = np.array(groups["source"].to_pylist(), object)
    order = np.argsort(names)
    names, totals = names[order], groups["total"].to_numpy()[order]
    vocabulary, whole = groups["terms"][0].as_py(), groups["whole"][0].as_py()
    # terms in the order of their UTF-8 bytes, which breaks ties
    texts = np.array(sorted(counts["term"].unique().to_pylist(), key=str.encode), object)
    place = {t: i for i, t in enumerate(texts)}
    at = {s: i for i, s in enumerate(names)}
    grid = np.zeros((len(names), len(texts)), np.int64)
    grid[[at[s] for s in counts["source"].to_pylist()], [place[t] for t in counts["term"].to_pylist()]] = counts["uses"].to_numpy()

    part, source, item, value = [], [], [], []
    if len(names) > 1:
        sums = pair_sums(shares(grid, totals[:, None], vocabulary)) if len(texts) else np.zeros((len(names), len(names)), np.int64)
        a, b = np.nonzero(~np.eye(len(names), dtype=bool))
        part += ["pair"] * len(a)
        source += names[a].tolist()
        item += names[b].tolist()
        value += sums[a, b].tolist()
    if len(texts):
        q = shares(grid.sum(axis=0), np.int64(whole), vocabulary)
        for i, name in enumerate(names):
            p = shares(grid[i], totals[i], vocabulary)
            ahead = np.flatnonzero((grid[i] > 0) & (p > q))
            gain = (p[ahead] - q[ahead]) ** 2 // q[ahead]
            best = np.argsort(-gain, kind="stable")[:top]
            part += ["term"] * len(best)
            source += [name] * len(best)
            item += texts[ahead[best]].tolist()
            value += gain[best].tolist()
    n = len(part)
    return pa.table({
        "lang": pa.array([key[0].as_py()] * n, pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()),
        "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64()),
    })


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200, block: int = BLOCK, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: the divergence of each source from each other one of its language, and its own terms.

    A term is a run of ASCII letters (A-Z in lower case) and of characters outside ASCII; a language keeps the terms of at least
    min_docs of its documents.  A group's share of a term is p = 1 + floor(UNIT * (count + 1) / (N + V)), N its occurrences of
    kept terms and V their number.  part 'pair': every other source of the language with the sum over its kept terms of
    floor((p - q)**2 / q), q the other's shares; all of them are ranked.  part 'term': kept terms that the group has, and more of
    than the language (p > q), with floor((p - q)**2 / q); ranks up to `top`.  Higher values come first, ties by the item's UTF-8 bytes.

    Null texts, languages and sources read as ''.  Repeated rows count as documents of their own.  Groups without terms have pairs
    (of value 0 where the language keeps no term) and no 'term' rows; a language's only source has no pairs.  No rows, no result.
    Other columns are not read.
    """
    own = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).cast("binary").alias("body"))
    partial = own.mapInArrow(_count, "lang string, source string, term string, uses long, docs long")
    # one exchange by language and term serves both the groups' sums and the terms' documents
    met = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    met = met.withColumn("all_docs", F.sum("docs").over(same)).withColumn("nth", F.row_number().over(same.orderBy("source")))
    kept = stash(met.where(F.col("all_docs") >= min_docs).select("lang", "source", "term", "uses", (F.col("nth") == 1).cast("long").alias("is_first")), "audit-terms")

    sums = kept.groupBy("lang", "source").agg(F.sum("uses").alias("total"), F.sum("is_first").alias("firsts"))
    groups = own.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0, ["total", "firsts"])
    groups = stash(groups, "audit-groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("whole"), F.sum("firsts").alias("terms"))
    langs = langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / block)).cast("int"))
    if langs.count() <= FEW:
        langs = F.broadcast(langs)
    dealt = kept.join(langs.select("lang", "blocks"), "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "uses")
    sides = groups.join(langs, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "total", "terms", "whole")

    tiles = dealt.groupBy("lang", "block").cogroup(sides.groupBy("lang", "block")).applyInArrow(
        lambda key, counts, names: _tile(top, key, counts, names), "lang string, source string, part string, item string, value long"
    )
    # partial pair matrices are summed; a term stands in one block only
    found = stash(tiles.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "audit-tiles")
    drop_stash(kept)
    drop_stash(groups)
    best = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = found.where("part = 'pair'").withColumn("rank", best)
    terms = found.where("part = 'term'").withColumn("rank", best).where(F.col("rank") <= top)  # Spark keeps each task's foremost before it deals them
    return pairs.unionByName(terms)
