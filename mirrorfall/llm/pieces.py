"""SentencePiece encoding and decoding with a batched numpy Viterbi.

The vocabulary is a byte-pair model: its ids follow from merges, not from a sum of scores, so the recurrence that a
unigram model would run over scores runs here over admissible pairs. For every prefix of a word exactly one last piece is
possible: a piece t ends the prefix's encoding if the encoding before it ends in a piece u, and merging u and t side by
side leaves both whole. Words of one length advance together, one character a step. Hashes of the substrings that end
there probe the sorted piece keys, the admissible candidate of greatest length is kept, and its length is the backpointer.
"""

from __future__ import annotations

import hashlib
import heapq
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from ._shared import map_text, mix, powers, prefix_hashes, ship, sorted_unique

#: Where the public vocabulary lies; a parameter of every function that loads one.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
_BLANK = 0x2581
_PAIR_SLOTS = 1 << 20
#: Distinct words whose ids a process remembers; it starts anew beyond them.
_SEEN_WORDS = 1_000_000
_FILTER_BITS = 22
_FAR = np.iinfo(np.int64).max


class Pieces:
    """A vocabulary's arrays: piece keys in order, merge ranks, spines of the merge trees, and bytes for decoding."""

    def __init__(self, data: bytes) -> None:
        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.size = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(self.size)]
        self.byte_ids = np.full(256, -1, np.int64)
        self.special = np.zeros(self.size, bool)
        for i, name in enumerate(self.names):
            if model.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
            self.special[i] = model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        # The merge order: greater scores first. Pieces of equal score are runs of blanks only; their ties go by place.
        scores = np.array([model.get_score(i) for i in range(self.size)])
        self.rank = np.searchsorted(np.unique(-scores), -scores)
        self.ids = {name: i for i, name in enumerate(self.names) if not self.special[i]}
        self.outputs = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else b"" if self.special[i] else n.replace(chr(_BLANK), " ").encode() for i, n in enumerate(self.names)]
        self._trees()
        self._keys()
        self.pair_keys = np.full(_PAIR_SLOTS, -1, np.int64)
        self.pair_fits = np.zeros(_PAIR_SLOTS, bool)
        self._forget()

    def merge(self, text: str) -> list[tuple[str, object]]:
        """The merges' result on one word, by the definition: (piece, its tree); used for the vocabulary's own pieces."""
        parts: list = [(c, None) for c in text]
        after, before, live = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1)), [True] * len(text)
        queue: list[tuple[int, int, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(text):
                joined = parts[i][0] + parts[after[i]][0]
                if joined in self.ids:
                    heapq.heappush(queue, (int(self.rank[self.ids[joined]]), i, after[i], joined))

        for i in range(len(text)):
            offer(i)
        while queue:
            _, i, j, joined = heapq.heappop(queue)
            if not (live[i] and live[j]) or after[i] != j or parts[i][0] + parts[j][0] != joined:
                continue
            parts[i] = (joined, (parts[i], parts[j]))
            live[j] = False
            after[i] = after[j]
            if after[j] < len(text):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p, on in zip(parts, live, strict=True) if on]

    def _trees(self) -> None:
        """Spines from the outermost character up to the piece: of a piece's last characters (right) and first (left)."""
        self.whole = np.zeros(self.size + 1, bool)
        rights, lefts = [[] for _ in range(self.size + 1)], [[] for _ in range(self.size + 1)]
        for i, name in enumerate(self.names):
            if self.special[i]:
                continue
            parts = self.merge(name)
            self.whole[i] = len(parts) == 1
            if len(parts) == 1:
                for side, spine in ((1, rights[i]), (0, lefts[i])):
                    node = parts[0]
                    while node is not None:
                        spine.append(self.ids[node[0]])
                        node = node[1] and node[1][side]
                    spine.reverse()
        self.right_at, self.right = _ragged(rights)
        self.left_at, self.left = _ragged(lefts)

    def _keys(self) -> None:
        names = [(n, i) for n, i in self.ids.items()]
        self.longest = max(len(n) for n, _ in names)
        sums = np.zeros(len(names), np.uint64)
        up, _ = powers(self.longest + 1)
        for k, (name, _) in enumerate(names):
            units = np.frombuffer(name.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
            sums[k] = (units * up[: len(units)]).sum(dtype=np.uint64)
        keys, ids = mix(sums), np.array([i for _, i in names])
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], ids[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.sums = np.zeros(self.size + 1, np.uint64)  # raw sums, to hash two pieces side by side
        self.lengths = np.zeros(self.size + 1, np.int64)
        for k, (name, i) in enumerate(names):
            self.sums[i], self.lengths[i] = sums[k], len(name)

    def find(self, sums: np.ndarray) -> np.ndarray:
        """Piece ids of raw substring sums, -1 where there is no such piece."""
        keys = mix(sums)
        out = np.full(len(keys), -1, np.int64)
        near = np.flatnonzero(self.filter[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, keys[near]), len(self.keys) - 1)
        same = self.keys[at] == keys[near]
        out[near[same]] = self.key_ids[at[same]]
        return out

    def fits(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether merging leaves u and t whole side by side; a pair's answer is kept in a table of fixed size."""
        code = u * (self.size + 1) + t
        slot = (mix(code.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
        fresh = np.flatnonzero(self.pair_keys[slot] != code)
        out = self.pair_fits[slot]
        if len(fresh):
            asked = sorted_unique(code[fresh])
            answers = self._fits(asked // (self.size + 1), asked % (self.size + 1))
            got = answers[np.searchsorted(asked, code[fresh])]
            out[fresh] = got
            where = (mix(asked.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
            self.pair_keys[where], self.pair_fits[where] = asked, answers
            stale = self.pair_keys[where] != asked  # several pairs of one slot: the last written pair's own answer stays
            if stale.any():
                last = np.searchsorted(asked, self.pair_keys[where[stale]])
                self.pair_fits[where[stale]] = answers[last]
        return out

    def _fits(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Replays both merge trees along the border in merge order and looks for a merge across it that comes sooner."""
        out = np.ones(len(u), bool)
        i, j = self.right_at[u].copy(), self.left_at[t].copy()
        i_end, j_end = self.right_at[u + 1] - 1, self.left_at[t + 1] - 1
        up, _ = powers(2 * self.longest + 2)
        open_ = np.flatnonzero((i <= i_end) & (j <= j_end))
        while len(open_):
            a, b = self.right[i[open_]], self.left[j[open_]]
            joined = self.find(self.sums[a] + up[self.lengths[a]] * self.sums[b])
            across = np.where(joined >= 0, self.rank[joined], _FAR)
            more_i, more_j = i[open_] < i_end[open_], j[open_] < j_end[open_]
            own_u = np.where(more_i, self.rank[self.right[np.minimum(i[open_] + 1, i_end[open_])]], _FAR)
            own_t = np.where(more_j, self.rank[self.left[np.minimum(j[open_] + 1, j_end[open_])]], _FAR)
            # Of equal merges the leftmost goes first: u's own lies left of the border, t's own right of it.
            crossed = (across < own_u) & (across <= own_t) & (across < _FAR)
            out[open_[crossed]] = False
            step_u = ~crossed & more_i & (own_u <= own_t)
            step_t = ~crossed & more_j & ~step_u
            i[open_[step_u]] += 1
            j[open_[step_t]] += 1
            open_ = open_[step_u | step_t]
        return out

    def viterbi(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the words in the rows of a matrix of code points: (ids, -1 - code point for unknown characters; counts)."""
        n, length = words.shape
        up, down = powers(length + 1)
        sums = np.zeros((length + 1, n), np.uint64)
        np.cumsum((words.T.astype(np.uint64) + np.uint64(1)) * up[:length, None], axis=0, out=sums[1:])
        last = np.full((length + 1, n), self.size, np.int64)  # the last piece of each prefix; self.size where it is unknown
        back = np.zeros((length + 1, n), np.int16)
        for j in range(1, length + 1):
            todo = np.arange(n)
            for size in range(min(j, self.longest), 0, -1):
                piece = self.find((sums[j, todo] - sums[j - size, todo]) * down[j - size])
                hit = np.flatnonzero(piece >= 0)
                hit = hit[self.whole[piece[hit]]]
                if j > size and len(hit):
                    before = last[j - size, todo[hit]]
                    ok = (before == self.size) | (back[j - size, todo[hit]] == 0)
                    known = np.flatnonzero(~ok)
                    ok[known] = self.fits(before[known], piece[hit[known]])
                    ok &= back[j - size, todo[hit]] > 0
                    hit = hit[ok]
                if len(hit):
                    last[j, todo[hit]], back[j, todo[hit]] = piece[hit], size
                    rest = np.ones(len(todo), bool)
                    rest[hit] = False
                    todo = todo[rest]
                if not len(todo):
                    break
            if len(todo):
                back[j, todo] = 1  # a character outside the vocabulary
        at, steps = np.full(n, length), []
        live = np.arange(n)
        while len(live):
            piece, size = last[at[live], live], back[at[live], live]
            steps.append((live, np.where(piece < self.size, piece, -1 - words[live, at[live] - 1].astype(np.int64))))
            at[live] -= size
            live = live[at[live] > 0]
        counts = np.bincount(np.concatenate([s[0] for s in steps]), minlength=n)
        ends = np.cumsum(counts)
        ids, taken = np.zeros(ends[-1], np.int64), np.zeros(n, np.int64)
        for rows, found in steps:
            ids[ends[rows] - 1 - taken[rows]] = found
            taken[rows] += 1
        return ids, counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one behind the other, and the count of each; an empty text has none."""
        blank = chr(_BLANK)
        units = np.frombuffer("".join(blank + x.replace(" ", blank) if x else "" for x in texts).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(x) + 1 if x else 0 for x in texts], np.int64)
        if not len(units):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        # No piece holds a blank behind another character, a line break or two digits: words end before and after these.
        is_blank = units == _BLANK
        alone = (units == 10) | ((units >= 48) & (units <= 57))
        begins = np.zeros(len(units) + 1, bool)
        begins[1:-1] = (is_blank[1:] & ~is_blank[:-1]) | alone[1:] | alone[:-1]
        begins[np.cumsum(sizes) - sizes] = True
        starts = np.flatnonzero(begins[:-1])
        lengths = np.diff(np.append(starts, len(units)))
        sums = prefix_hashes(units.astype(np.uint64) + np.uint64(1))
        _, down = powers(len(units) + 1)
        keys = mix((sums[starts + lengths] - sums[starts]) * down[starts]) ^ lengths.astype(np.uint64)
        order = np.argsort(keys, kind="stable")
        first = np.ones(len(order), bool)
        first[1:] = keys[order][1:] != keys[order][:-1]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(first) - 1
        shown = order[first]  # a place of each distinct word, in the order of keys
        pool, pool_at, counts = self._words(keys[shown], units, starts[shown], lengths[shown])
        per_word = counts[which]
        ends = np.cumsum(per_word)
        ids = pool[np.arange(ends[-1]) - np.repeat(ends - per_word - pool_at[which], per_word)]
        rows = np.searchsorted(np.cumsum(sizes), starts, "right")
        return ids, np.bincount(rows, per_word, len(texts)).astype(np.int64)

    def _words(self, keys: np.ndarray, units: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words in one array, with each word's place in it and count. Words seen before are remembered."""
        at = np.minimum(np.searchsorted(self.seen, keys), max(len(self.seen) - 1, 0))
        known = self.seen[at] == keys if len(self.seen) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        if len(new):
            pool, pool_at, counts = self._encode_words(units, starts[new], lengths[new])
            if len(self.seen) + len(new) > _SEEN_WORDS and len(self.seen):
                self._forget()
                return self._words(keys, units, starts, lengths)
            place = np.searchsorted(self.seen, keys[new])
            self.seen = np.insert(self.seen, place, keys[new])
            self.seen_at = np.insert(self.seen_at, place, pool_at + len(self.seen_pool))
            self.seen_count = np.insert(self.seen_count, place, counts)
            self.seen_pool = np.append(self.seen_pool, pool)
            at = np.searchsorted(self.seen, keys)
        return self.seen_pool, self.seen_at[at], self.seen_count[at]

    def _forget(self) -> None:
        self.seen = np.zeros(0, np.uint64)
        self.seen_at = self.seen_count = np.zeros(0, np.int64)
        self.seen_pool = np.zeros(0, np.int32)

    def _encode_words(self, units: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts = np.zeros(len(starts), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        by_length = np.argsort(lengths, kind="stable")
        for group in np.split(by_length, np.flatnonzero(np.diff(lengths[by_length])) + 1):
            size = int(lengths[group[0]])
            for part in np.array_split(group, max(1, len(group) * size >> 21)):
                words = units[starts[part][:, None] + np.arange(size)]
                runs = (words[:, :2] == _BLANK).sum(axis=1) == 2  # runs of blanks, whose merges tie
                for k in np.flatnonzero(runs):
                    text = words[k].tobytes().decode("utf-32-le")
                    ids = np.array([self.ids.get(p, -1 - ord(p) if len(p) == 1 else -1) for p, _ in self.merge(text)])
                    found.append((part[k : k + 1], ids))
                    counts[part[k]] = len(ids)
                if not runs.all():
                    ids, got = self.viterbi(words[~runs])
                    found.append((part[~runs], ids))
                    counts[part[~runs]] = got
        pool_at = np.zeros(len(starts), np.int64)
        place = 0
        for rows, ids in found:
            pool_at[rows] = place + np.cumsum(counts[rows]) - counts[rows]
            place += len(ids)
        pool = np.concatenate([ids for _, ids in found])
        unknown = np.flatnonzero(pool < 0)
        if len(unknown):  # characters outside the vocabulary become the ids of their UTF-8 bytes
            spelled = [self.byte_ids[list(chr(-1 - c).encode("utf-8", "surrogatepass"))] for c in pool[unknown]]
            grown = np.ones(len(pool), np.int64)
            grown[unknown] = [len(s) for s in spelled]
            ends = np.cumsum(grown)
            wide = np.zeros(ends[-1], np.int64)
            known = pool >= 0
            wide[ends[known] - 1] = pool[known]
            for k, s in zip(unknown, spelled, strict=True):
                wide[ends[k] - len(s) : ends[k]] = s
            totals = np.append(0, ends)
            counts_from, pool_from = counts, pool_at
            pool_at = totals[pool_from]
            counts = totals[pool_from + counts_from] - pool_at
            pool = wide
        return pool.astype(np.int32), pool_at, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ids: the pieces' bytes, without the blank that encoding puts in front."""
        if not hasattr(self, "byte_pool"):
            self.byte_at, _ = _ragged([list(x) for x in self.outputs])
            self.byte_pool = np.frombuffer(b"".join(self.outputs), np.uint8)
        lengths = self.byte_at[ids + 1] - self.byte_at[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        data = self.byte_pool[np.arange(total) - np.repeat(ends - lengths - self.byte_at[ids], lengths)].tobytes()
        stops = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        out = []
        for a, b in zip(stops[:-1], stops[1:], strict=True):
            text = data[a:b].decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
        return out


def _ragged(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows], np.int64)
    return np.append(0, np.cumsum(sizes)), np.array([x for r in rows for x in r], np.int64)


_loaded: dict[str, Pieces] = {}


def load(path: str = MODEL_PATH) -> Pieces:
    """The vocabulary in this process."""
    return _from_bytes(Path(path).read_bytes())


def _from_bytes(data: bytes) -> Pieces:
    key = hashlib.sha256(data).hexdigest()
    if key not in _loaded:
        _loaded[key] = Pieces(data)
    return _loaded[key]


def encode(docs: DataFrame, keep: list[str] | None = None, path: str = MODEL_PATH, text: str = "text") -> DataFrame:
    """Adds `ids` (array<int>), `n_tokens` and `round_trip`: whether decoding the ids gives the text back.

    A null text has null ids, no tokens and a null round trip; an empty text has an empty list. A text with the blank mark
    U+2581 decodes to one with spaces in its place, so its round_trip is false. The vocabulary (a few MB at most) is
    broadcast. Columns of docs with these names give way; repeated rows get equal ids. A word is encoded character by
    character, all words of one length at once, so a single word of many thousand characters takes seconds.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Path(path).read_bytes())

    def compute(column: pa.Array) -> list[pa.Array]:
        pieces = _from_bytes(shared.value)
        texts = column.to_pylist()
        ids, counts = pieces.encode(texts)
        back = pieces.decode(ids, counts)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))
        nulls = pa.array([x is None for x in texts])
        same = pa.array([None if x is None else x == y for x, y in zip(texts, back, strict=True)], pa.bool_())
        if column.null_count:
            lists = pc.if_else(nulls, None, lists)
        return [lists, pa.array(counts, pa.int64()), same]

    return map_text(docs, text, "ids array<int>, n_tokens long, round_trip boolean", compute, keep)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids: doc_id, n_tokens, ids, round_trip. A null text has null ids; repeated rows are encoded alike."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, ["doc_id"]).select("doc_id", "n_tokens", "ids", "round_trip")
