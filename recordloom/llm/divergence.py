"""How sources of a language differ in their terms, audited in cells of a cube.

1. Tasks count terms by language and source, pre-aggregated before the shuffle.
   A language keeps the terms of at least ``min_docs`` of its documents.
2. The counts of a language's (source, term) pairs lie on a grid of source
   blocks and term blocks. A cell of the cube is (source block, source block,
   term block): it owns the partial divergences of its pairs of sources over its
   terms, from two slices of the grid, each replicated to all cells that need it.
3. The partial sums are reduced along the term axis.

A slice holds only counts above 0. Terms that neither source of a pair has all
give the same value, so they are only counted: a cell adds up what at least one
of the two has, and how many that were.

Shares are whole numbers: 1 + floor(scale x (count + 1) / (N + V)), with N the
source's occurrences of kept terms and V their number; a term's value is
floor((p - q)^2 / q). Products stay in 64 bits, larger ones are decimals.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import stored

#: Entries that a task holds before it passes its counts on.
HELD_TERMS = 200_000
PART = 1 << 20

#: Bytes of terms as they are, A-Z in lower case, all others as spaces.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text, some at a time: runs of A-Z, a-z and all that isn't ASCII."""
    at = 0
    while at < len(text):
        part = text[at : at + PART].translate(_LETTERS)
        if at + PART < len(text):
            end = part.rfind(b" ") + 1
            if not end:  # a term longer than a part
                whole = text[at:].translate(_LETTERS)
                end = whole.find(b" ") + 1 or len(whole)
                part = whole
            part = part[:end]
        yield part.split()
        at += len(part)


def _counted(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences), ``docs``; a row with an empty term marks each pair of lang and source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def passed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (counts, inside) in held.items():
                names = [b"", *counts]
                columns = [
                    pa.array([lang] * len(names), pa.string()), pa.array([source] * len(names), pa.string()), pa.array(names, pa.binary()).cast(pa.string()),
                    pa.array([0, *counts.values()], pa.int64()), pa.array([0, *[inside[t] for t in counts]], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            held.clear()

        size = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for lang, source, text in zip(*(c.to_pylist() for c in part.columns)):
                    if (lang, source) not in held:
                        held[lang, source] = Counter(), Counter()
                    counts, inside = held[lang, source]
                    before, once = len(counts), set()
                    for found in terms(text):
                        counts.update(found)
                        once.update(found)
                    inside.update(once)
                    size += len(counts) - before
                    if size > HELD_TERMS:
                        yield from passed()
                        size = 0
        yield from passed()

    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(filled("lang").alias("lang"), filled("source").alias("source"), F.encode(filled("text"), "UTF-8").alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(count: Column, total: str, kept: str, scale: int) -> Column:
    """1 + floor(scale * (count + 1) / (total + kept)), through a decimal; 1 where there are no terms at all."""
    above = (count.cast("decimal(18,0)") + F.lit(1).cast("decimal(18,0)")) * F.lit(scale).cast("decimal(11,0)")
    below = F.nullif(F.col(total) + F.col(kept), F.lit(0)).cast("decimal(18,0)")
    return F.lit(1) + F.coalesce(F.call_function("div", above, below), F.lit(0))


def _by_row(values: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    total = np.zeros(count, np.int64)
    np.add.at(total, rows, values)
    return total


def partial_divergence(own: np.ndarray, has: np.ndarray, rest: int, others: np.ndarray, have: np.ndarray, rests: np.ndarray):
    """Sums of floor((p - q)^2 / q) of one source against others, both ways, over terms that either has, and their number.

    ``own`` and ``others`` are shares by term, ``has`` and ``have`` tell where they are real; elsewhere a source has its ``rest``.
    """
    rows, at = np.nonzero(have)
    mine = np.flatnonzero(has)
    lone, k = np.nonzero(~have[:, mine])
    p = np.concatenate([np.where(has[at], own[at], rest), own[mine][k]])
    q = np.concatenate([others[rows, at], rests[lone]])
    rows = np.concatenate([rows, lone])
    square = (p - q) ** 2
    return _by_row(square // q, rows, len(rests)), _by_row(square // p, rows, len(rests)), np.bincount(rows, minlength=len(rests))


def _cell(table: pa.Table) -> pa.Table:
    """Partial divergences of the pairs of one cell; rows without a term bring a source with its rest."""
    source, term = (table.column(c).combine_chunks().dictionary_encode() for c in ("source", "term"))
    names = source.dictionary.to_pylist()
    row = source.indices.to_numpy(zero_copy_only=False)
    column = term.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    p, block = (table.column(c).to_numpy() for c in ("p", "block"))
    first, second = table.column("a")[0].as_py(), table.column("b")[0].as_py()
    real = column >= 0
    rests, blocks = np.ones(len(names), np.int64), np.zeros(len(names), np.int64)
    rests[row[~real]], blocks[row[~real]] = p[~real], block[~real]
    shares, have = np.zeros((len(names), max(len(term.dictionary), 1)), np.int64), np.zeros((len(names), max(len(term.dictionary), 1)), bool)
    shares[row[real], column[real]], have[row[real], column[real]] = p[real], True
    made: dict[str, list] = {c: [] for c in ("source", "item", "value", "terms", "other")}

    def add(sources: list[str], items: list[str], values: np.ndarray, counts: np.ndarray, others: np.ndarray) -> None:
        for name, new in zip(made, (sources, items, values.tolist(), counts.tolist(), others.tolist())):
            made[name] += new

    for g in np.flatnonzero(blocks == first):
        to = np.flatnonzero(blocks == second)
        to = to[to > g] if first == second else to
        if not len(to):
            continue
        ahead, back, counts = partial_divergence(shares[g], have[g], rests[g], shares[to], have[to], rests[to])
        mine, theirs = [names[g]] * len(to), [names[k] for k in to]
        square = (rests[g] - rests[to]) ** 2
        add(mine, theirs, ahead, counts, square // rests[to])
        add(theirs, mine, back, counts, square // rests[g])
    lang = pa.array([table.column("lang")[0].as_py()] * len(made["source"]), pa.string())
    kinds = {"source": pa.string(), "item": pa.string()}
    return pa.table({"lang": lang, **{c: pa.array(v, kinds.get(c, pa.int64())) for c, v in made.items()}})


def divergence(
    docs: DataFrame, min_docs: int = 3, scale: int = 1_000_000_000, top: int = 200, source_block: int = 32, term_block: int = 8_192
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank`` for every pair of lang and source in ``docs``.

    Part ``pair``: each other source of the language, with its divergence summed
    over all kept terms. Part ``term``: the ``top`` terms that the source has and
    uses more than its language does. Ranks start at 1 for each source and part,
    by value from the highest, then by the item's bytes.

    A null text, lang or source is an empty one; groups without kept terms take
    part, and without kept terms in the language their pairs have the value 0.
    Very long texts are counted whole. Ties go by item; repeated rows count as
    documents of their own; an empty table gives an empty result; other columns
    are ignored, whatever their names.
    """
    counts = stored(_counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    real = counts.filter("term <> ''")
    kept = real.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).filter(F.col("docs") >= min_docs)
    kept = stored(kept.drop("docs"), "divergence-kept")
    found = stored(real.drop("docs").join(kept, ["lang", "term"]), "divergence-found")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_total"))
    sources = counts.filter("term = ''").select("lang", "source")
    langs = sources.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(langs, "lang", "left").na.fill(0)
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = sources.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(langs, "lang")
    groups = stored(groups, "divergence-groups")
    shares = found.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), "total", "terms", scale))

    value = F.expr("((p - q) * (p - q)) div q")
    over = shares.withColumn("q", _share(F.col("all"), "lang_total", "terms", scale)).filter("p > q")
    words = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    blocks = F.ceil(F.col("sources") / source_block)
    slabs = F.greatest(F.ceil(F.col("terms") / term_block), F.lit(1))
    block = F.pmod(F.xxhash64("source"), blocks)
    entries = shares.select("lang", "source", "term", "p", block.alias("block"), blocks.alias("blocks"), F.pmod(F.xxhash64("term"), slabs).alias("slab"))
    marks = groups.select(
        "lang", "source", F.lit(None).cast("string").alias("term"), _share(F.lit(0), "total", "terms", scale).alias("p"), block.alias("block"),
        blocks.alias("blocks"), F.explode(F.sequence(F.lit(0).cast("bigint"), slabs - 1)).alias("slab"),
    )
    dealt = entries.union(marks).withColumn("to", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.select("lang", "source", "term", "p", "block", F.least("block", "to").alias("a"), F.greatest("block", "to").alias("b"), "slab")
    partial = dealt.groupBy("lang", "a", "b", "slab").applyInArrow(_cell, "lang string, source string, item string, value long, terms long, other long")
    summed = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("terms").alias("seen"), F.first("other").alias("other"))
    summed = summed.join(langs.select("lang", "terms"), "lang")
    pairs = summed.select(
        "lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + (F.col("terms") - F.col("seen")) * F.col("other")).alias("value")
    )
    return ranked(pairs).unionByName(ranked(words).filter(F.col("rank") <= top))
