"""Records that are no lines, from files cut anywhere: CSV with quoted line breaks, JSON objects.

A file is read in splits, each a run of pieces (CSV: lines; JSON: what lies
between closing braces). Whether a piece ends a record depends on what the
pieces before it left open: a quote, or braces. Within a split that is worked
out from both states in which the quotes could begin; each split's result is one
row, and these rows, followed in order, tell every split how it begins. Then
each split puts its pieces together on its own. Only the records that lie over
the edges of splits, at most two fragments a split, are joined by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.plans.store import keep


@dataclass(frozen=True)
class CsvCut:
    """Lines; a record ends with a line that leaves no quote open. A quote opens at the start of a value alone."""

    delimiter: str = ","
    quote: str = '"'
    escape: str = '"'
    trim: bool = True
    separator: str = "\n"
    closing: str = "\n"
    _close: re.Pattern = field(init=False)

    def __post_init__(self) -> None:
        q, e = re.escape(self.quote), re.escape(self.escape)
        inner = rf"(?:[^{q}]|{q}{q})*+{q}" if self.quote == self.escape else rf"(?:[^{q}{e}]|{e}.)*+{q}"
        object.__setattr__(self, "_close", re.compile(inner, re.DOTALL))

    def step(self, text: str, inside: int) -> tuple[int, int, int]:
        """Whether a quote is open after a line, nothing about depth, and the delimiters outside quotes."""
        if not inside and self.quote not in text:
            return 0, 0, text.count(self.delimiter)
        at = found = 0
        while True:
            if inside:
                closed = self._close.match(text, at)
                if not closed:
                    return 1, 0, found
                at, inside = closed.end(), 0
            elif text.startswith(self.quote, begun := self._begin(text, at)):
                at, inside = begun + len(self.quote), 1
                continue
            at = text.find(self.delimiter, at)
            if at < 0:
                return 0, 0, found
            at, found = at + len(self.delimiter), found + 1

    def _begin(self, text: str, at: int) -> int:
        while self.trim and at < len(text) and text[at] in " \t" and not text.startswith(self.delimiter, at):
            at += 1
        return at

    def record(self, text: str) -> str:
        return text.removesuffix("\n").removesuffix("\r")


@dataclass(frozen=True)
class JsonCut:
    """Pieces before closing braces; a record ends where no brace is open. What surrounds the outermost objects doesn't matter."""

    separator: str = "}"
    closing: str = "}"

    def step(self, text: str, inside: int) -> tuple[int, int, int]:
        """Whether a string is open after the piece and its brace, how many more braces are, and nothing about width."""
        if "\\" in text:
            text = re.sub(r"\\.", "", text, flags=re.DOTALL)
        parts = text.split('"')
        end = (inside + len(parts) - 1) % 2
        return end, sum(p.count("{") for p in parts[inside::2]) - (not end), 0

    def record(self, text: str) -> str:
        return text[text.find("{") :] if "{" in text else ""


def records(spark: SparkSession, path: str | list[str], cut: CsvCut | JsonCut) -> DataFrame:
    """``value`` (a record's text), ``width`` (its delimiters), and ``_file``, ``_block``, ``_line``, which order the records.

    A record that a file's end leaves open ends there.
    """
    pieces = spark.read.option("lineSep", cut.separator).text(path)
    pieces = pieces.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))

    def sections(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
        """Runs of pieces of one split; a split's runs follow each other."""
        for batch in batches:
            texts, files, blocks = (c.to_pylist() for c in batch.columns)
            at = 0
            for k in range(1, len(texts) + 1):
                if k == len(texts) or (files[k], blocks[k]) != (files[at], blocks[at]):
                    yield (files[at], blocks[at]), texts[at:k]
                    at = k

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}
        for place, texts in sections(batches):
            state = held.setdefault(place, [0, 0, 1, 0])
            for text in texts:
                for k in (0, 2):
                    bit, deeper, _ = cut.step(text, state[k])
                    state[k], state[k + 1] = bit, state[k + 1] + deeper
        rows = [(*place, *state) for place, state in held.items()]
        kinds = [pa.string(), *[pa.int64()] * 5]
        names = ["_file", "_block", "bit0", "depth0", "bit1", "depth1"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    found = pieces.mapInArrow(summary, "_file string, _block long, bit0 long, depth0 long, bit1 long, depth1 long").collect()  # one row a split
    begun: dict[tuple[str, int], tuple[int, int]] = {}
    file, bit, depth = None, 0, 0
    for row in sorted(found):
        if row["_file"] != file:
            file, bit, depth = row["_file"], 0, 0
        begun[row["_file"], row["_block"]] = bit, depth
        bit, depth = row[f"bit{bit}"], max(depth + row[f"depth{bit}"], 0)
    starts = spark.sparkContext.broadcast(begun)
    csv = isinstance(cut, CsvCut)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows = None, []
        bit = depth = width = line = 0
        parts: list[str] = []
        opened = head = False

        def made() -> pa.RecordBatch:
            names = ["value", "width", "_file", "_block", "_line", "whole", "opens"]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        def put(whole: bool) -> None:
            text = "".join(parts)
            rows.append((cut.record(text) if whole else text, width, *place, line, whole, not head))

        for now, texts in sections(batches):
            if now != place:
                if opened:
                    put(False)
                place, line, parts, width = now, 0, [], 0
                bit, depth = starts.value[now]
                opened = head = bool(bit or depth)
            for text in texts:
                if csv and not opened and not text.strip("\r"):
                    continue  # an empty line is no record
                bit, deeper, wide = cut.step(text, bit)
                depth, width = max(depth + deeper, 0), width + wide
                parts.append(text + cut.closing)
                opened = bool(bit or depth)
                if not opened:
                    put(not head)
                    parts, width, line, head = [], 0, line + 1, False
            if len(rows) >= 4096:
                yield made()
                rows.clear()
        if opened:
            put(False)
        yield made()

    kind = "value string, width long, _file string, _block long, _line long, whole boolean, opens boolean"
    held = keep(pieces.mapInArrow(joined, kind), "split-records")
    across = Window.partitionBy("_file").orderBy("_block", "_line")  # at most two fragments a split
    edges = held.filter("not whole").withColumn("record", F.sum(F.col("opens").cast("int")).over(across))
    place = F.struct("_block", "_line", "value")
    merged = edges.groupBy("_file", "record").agg(F.array_sort(F.collect_list(place)).alias("f"), F.sum("width").alias("width"))
    text = F.array_join(F.transform("f", lambda x: x["value"]), "")
    if csv:
        text = F.regexp_replace(text, r"\r?\n\z", "")
    else:
        text = F.regexp_extract(text, r"(?s)(\{.*)", 1)
    columns = ["width", "_file", "_block", "_line"]
    merged = merged.select(text.alias("value"), "width", "_file", F.col("f")[0]["_block"].alias("_block"), F.col("f")[0]["_line"].alias("_line"))
    return held.filter("whole").select("value", *columns).union(merged).filter("value <> ''")
