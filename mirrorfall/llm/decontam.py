"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import re
import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import map_text

#: Edits allowed for each character of an item.
ERROR_RATE = 0.06
#: An item with fewer characters matches only where it stands word for word.
MIN_CHARS = 32
#: An item with fewer characters than this matches a text that equals it as a whole, and nothing else.
WHOLE_CHARS = 10
#: Most items and most characters of them that are sent to the executors at once; a larger benchmark is searched in blocks.
BLOCK_ITEMS, BLOCK_CHARS = 50_000, 16 << 20
_HITS = "hits array<struct<item_id:long,distance:int,budget:int,end:int>>"
_HIT_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("budget", pa.int32()), ("end", pa.int32())]))
_GAP = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    """Lower case, every run of other than letters and digits one space, none at the ends."""
    return _GAP.sub(" ", (text or "").lower()).strip()


def budget(size: int) -> int:
    """Edits allowed for an item of `size` normalised characters."""
    return int(size * ERROR_RATE)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item in errors + 1 pieces of nearly equal length, with their places; one of them survives any such edits."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def best_match(masks: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of the pattern to any substring of `text`, and where the first such substring ends.

    Myers' bit-parallel recurrence: one arbitrarily wide integer holds a column of vertical differences.
    """
    ones, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, now = ones, 0, size
    best, end = size, 0
    get = masks.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (ones & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            now += 1
        elif down & top:
            now -= 1
            if now < best:
                best, end = now, i + 1
        up <<= 1
        down <<= 1
        plus = (down & ones) | (ones & ~(vertical | up))
        minus = up & vertical & ones
    return best, end


class Matcher:
    """The automaton of all pieces of a block of items, and the items' bit masks."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items, self.whole = [], {}
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if len(text) < WHOLE_CHARS:
                if text:
                    self.whole.setdefault(text, []).append(item_id)
                continue
            masks: dict[str, int] = {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            errors = budget(len(text)) if len(text) >= MIN_CHARS else 0
            for place, piece in pieces(text, errors):
                found.setdefault(piece, []).append((len(self.items), place))
            self.items.append((item_id, text, errors, masks))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()

    def search(self, text: str | None) -> list[dict]:
        """One hit, the best, for each item that some stretch of the text is within the item's budget of."""
        text = normalise(text)
        out = [{"item_id": i, "distance": 0, "budget": 0, "end": len(text)} for i in self.whole.get(text, ())]
        windows: dict[int, list[list[int]]] = {}
        for last, (size, uses) in self.automaton.iter(text) if self.items else ():
            for k, place in uses:
                _, item, errors, _ = self.items[k]
                begin = last + 1 - size - place - errors
                end = begin + len(item) + 2 * errors
                spans = windows.setdefault(k, [])
                if spans and begin <= spans[-1][1] and end >= spans[-1][0]:
                    spans[-1] = [min(begin, spans[-1][0]), max(end, spans[-1][1])]
                else:
                    spans.append([begin, end])
        for k, spans in windows.items():
            item_id, item, errors, masks = self.items[k]
            best, end = errors + 1, 0
            at = text.find(item) if len(item) >= MIN_CHARS else f" {text} ".find(f" {item} ")
            if at >= 0:
                best, end = 0, at + len(item)
            elif len(item) < MIN_CHARS:
                continue
            else:
                for a, b in _joined(spans):
                    got, stop = best_match(masks, len(item), text[max(a, 0) : b])
                    if got < best:
                        best, end = got, max(a, 0) + stop
            if best <= errors:
                out.append({"item_id": item_id, "distance": best, "budget": errors, "end": end})
        return sorted(out, key=lambda x: x["item_id"])


def _joined(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def benchmark_blocks(benchmark: DataFrame):
    """The normalised items (item_id, text) in blocks of bounded size; null ids and empty items match nothing."""
    block, chars = [], 0
    for row in benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        text = normalise(row.text)
        if block and (len(block) >= BLOCK_ITEMS or chars + len(text) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((row.item_id, text))
        chars += len(text)
    if block:
        yield block


_matchers: dict[str, Matcher] = {}


def _matcher(token: str, shared) -> Matcher:
    """This worker's automaton of a broadcast block; a worker keeps one block's at a time."""
    if token not in _matchers:
        _matchers.clear()
        _matchers[token] = Matcher(shared.value)
    return _matchers[token]


def match(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adds `hits`: the benchmark items that the whole text holds within their edit budgets, with the least distance.

    Texts and items are compared in normalised form. An item of m characters may differ by ERROR_RATE * m edits: it is cut
    into one piece more than that, every exact occurrence of a piece in the text opens a window, and windows are verified
    with Myers' recurrence. Overlapping windows are merged, so a text is verified at most once for each item. A null or
    empty text holds nothing; repeated rows have the same hits; a column `hits` of docs gives way. The items go to the
    executors in blocks of bounded size and each block is one pass over the texts, so time grows with the benchmark.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "hits"]
    blocks = [(uuid.uuid4().hex, spark.sparkContext.broadcast(items)) for items in benchmark_blocks(benchmark)]
    out, names = docs.select(*dict.fromkeys([*keep, "text"])), [f"__hits{i}" for i in range(len(blocks))]
    for i, (token, shared) in enumerate(blocks):

        def compute(column: pa.Array, token=token, shared=shared) -> list[pa.Array]:
            matcher = _matcher(token, shared)
            return [pa.array([matcher.search(x) for x in column.to_pylist()], _HIT_TYPE)]

        last = i == len(blocks) - 1
        out = map_text(out, "text", _HITS.replace("hits", names[i], 1), compute, [*keep, *names[:i]] if last else None)
    none = F.from_json(F.lit("[]"), _HITS.removeprefix("hits "))
    hits = F.concat(*names) if names else none
    return out.select(*keep, hits.alias("hits"))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row (doc_id, item_id, distance, budget) for each document and benchmark item that it contains; none for null or
    empty texts. Rows that repeat an id give a row each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hits = match(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    return hits.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.item_id", "hit.distance", "hit.budget")
