"""Approximate search for a set of passages: pigeonhole pieces, then Myers' bit-parallel distance.

A passage of m characters with an error budget of k edits is cut into k + 1
pieces. A text that holds the passage with at most k edits holds one of the
pieces unchanged, at the place where it belongs, so the exact hits of all
pieces (one Aho-Corasick pass over a text) give windows that miss nothing.
Each window is then settled by Myers' algorithm (1999), which moves a whole
column of the edit table in a few operations on integers of m bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.sources.columns import Carried

#: Everything but letters and digits counts as one space.
GAP = re.compile(r"[\W_]+")
ERROR_RATE = 0.08
#: Items of fewer letters and digits are no queries.
LEAST_LETTERS = 8
#: Characters of scripts that are written without spaces between words.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Characters of passages in one broadcast; larger sets are searched block by block.
BLOCK_CHARS = 4_000_000


def plain(text: str | None) -> str:
    """Lower case, letters and digits, single spaces."""
    return GAP.sub(" ", (text or "").lower()).strip()


def pieces(passage: str, budget: int) -> list[tuple[int, str]]:
    """``budget`` + 1 pieces of nearly equal length with their offsets."""
    cuts = [i * len(passage) // (budget + 1) for i in range(budget + 2)]
    return [(a, passage[a:b]) for a, b in zip(cuts, cuts[1:])]


class Myers:
    """Least edit distance of a fixed pattern to any substring of a text."""

    def __init__(self, pattern: str) -> None:
        self.m = len(pattern)
        self.where: dict[str, int] = {}
        for i, ch in enumerate(pattern):
            self.where[ch] = self.where.get(ch, 0) | 1 << i

    def least(self, text: str) -> int:
        full, top = (1 << self.m) - 1, 1 << self.m - 1
        up, down, score, best = full, 0, self.m, self.m
        where = self.where
        for ch in text:
            eq = where.get(ch, 0)
            diagonal = ((eq & up) + up ^ up) | eq
            plus = (down | ~(diagonal | up)) & full
            minus = up & diagonal
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
                if score < best:
                    best = score
            plus, minus = plus << 1 & full, minus << 1 & full
            vertical = eq | down
            up = (minus | ~(vertical | plus)) & full
            down = plus & vertical
        return best


class Matcher:
    """Search for all of a block of (id, passage) at once; passages without letters or digits match nothing."""

    def __init__(self, passages: list[tuple], rate: float) -> None:
        self.automaton = ahocorasick.Automaton()
        self.patterns: dict[int, tuple[int, int, Myers]] = {}
        at: dict[str, list[tuple[int, int]]] = {}
        for number, (item, text) in enumerate(passages):
            passage = plain(text)
            if not passage:
                continue
            budget = int(len(passage) * rate)
            if budget == 0:  # too short for errors: whole words only, where the script has spaces
                before, after = ("" if UNSPACED.match(ch) else " " for ch in (passage[0], passage[-1]))
                passage = before + passage + after
            self.patterns[number] = (item, budget, Myers(passage))
            for offset, piece in pieces(passage, budget):
                at.setdefault(piece, []).append((number, offset))
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple]:
        """(item id, least distance) of the passages found in ``text``, by id."""
        body = f" {plain(text)} "
        if not self.patterns or len(body) < 3:
            return []
        windows: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.automaton.iter(body):
            for number, offset in places:
                _, budget, myers = self.patterns[number]
                start = end + 1 - length - offset
                low, high = max(0, start - budget), min(len(body), start + myers.m + budget)
                own = windows.setdefault(number, [])
                if own and low <= own[-1][1]:
                    own[-1] = [min(low, own[-1][0]), max(high, own[-1][1])]
                else:
                    own.append([low, high])
        found: dict[int, int] = {}
        for number, spans in windows.items():
            item, budget, myers = self.patterns[number]
            for low, high in spans:
                distance = myers.least(body[low:high])
                if distance <= budget and distance < found.get(item, budget + 1):
                    found[item] = distance
        return sorted(found.items())


def _search(block, rate: float, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = None
        for batch in batches:
            matcher = matcher or Matcher(block.value, rate)
            at = batch.schema.get_field_index("text")
            before = batch.column(batch.schema.get_field_index("found")).to_pylist()
            found = [old + [{"item_id": i, "distance": d} for i, d in matcher.find(text.as_py())] for old, text in zip(before, batch.column(at))]
            kind = pa.list_(pa.struct([("item_id", item_type), ("distance", pa.int32())]))
            columns = [pa.array(found, kind) if n == "found" else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def _blocks(items: DataFrame, least_letters: int) -> Iterator[list[tuple]]:
    block, size = [], 0
    for row in items.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        if len(plain(row["text"]).replace(" ", "")) < least_letters:
            continue
        if size and size + len(row["text"]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if block:
        yield block


def contamination(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """All rows and columns of ``docs`` with found (item ids and distances), n_items and contaminated.

    A passage is found where some stretch of the text is within ``rate`` times
    its length of it in edits, both in the form of ``plain``. Null and empty
    texts hold nothing; repeated rows are marked alike, long texts searched
    whole, in time that grows with their length and, where pieces hit, with that
    of the items. Items with a null id or text, and those of fewer than
    ``least_letters`` letters and digits in any script, are no queries; ids may
    be of any type; of items with the same id the nearest counts. The items are the
    stated queries: they reach the tasks in blocks of at most BLOCK_CHARS
    characters, every block against all rows. An empty table stays empty.
    Columns of the three names are replaced, all others pass under any name.
    """
    item = items.schema["item_id"].dataType
    empty = F.array().cast(f"array<struct<item_id:{item.simpleString()},distance:int>>")
    carried = Carried(docs, ["text"], ["found", "n_items", "contaminated"])
    rows = carried.df.withColumn("found", empty)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields])
    for block in _blocks(items, least_letters):
        rows = rows.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(block), rate, to_arrow_type(item)), schema)
    distinct = F.aggregate(
        F.array_sort("found"),
        empty,
        lambda out, hit: F.when(F.get(out, F.size(out) - 1)["item_id"] == hit["item_id"], out).otherwise(F.concat(out, F.array(hit))),
    )
    marked = (
        rows.withColumn("found", F.when(F.size("found") > 1, distinct).otherwise(F.col("found")))
        .withColumn("n_items", F.size("found").cast("long"))
        .withColumn("contaminated", F.col("n_items") > 0)
    )
    return carried.back(marked, "found", "n_items", "contaminated")
