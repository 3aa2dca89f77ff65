"""Evaluation texts that occur in training text.

The evaluation items are put into an inverted index of character n-grams with BM25 weights and
block maxima. Each passage of a training text is a query; block-max WAND returns every item whose
score reaches that item's threshold. The threshold of an item is the least score that any stretch
of ``run`` characters of it has, so no leak is missed; what is returned is verified character by
character against the whole document. Passages overlap by ``run`` - 1 characters, so each run of a
leak lies whole within one of them.

Only letters and digits count, in one case and width.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.codepoints import TOP, Hashes, decode, sliced
from millrace.session import Stored

RUN, GRAM, PASSAGE = 40, 12, 240
K1, B = 1.2, 0.75
#: Postings per block.
BLOCK = 8
#: Characters of evaluation items in one index; more items make more indexes, built, shipped and passed over one after the other.
INDEX_CHARS = 2_000_000
#: Pairs of equal runs held at a time while a document is compared with an item.
PAIRS = 1 << 20


@lru_cache(1)
def folding() -> np.ndarray:
    """Each character's letter or digit in lower case and plain width, or 0."""
    out = np.zeros(TOP, np.uint32)
    for c in (*range(0x3134B), *range(0xE0000, 0xE0001)):
        ch = chr(c)
        if 0xD800 <= c < 0xE000:
            continue
        to = ch if 0x4E00 <= c < 0xA000 or 0x20000 <= c else unicodedata.normalize("NFKC", ch).casefold()
        if len(to) == 1 and to.isalnum():
            out[c] = ord(to)
        elif len(to) > 1 and to[0].isalnum() and ch.isalnum():
            out[c] = ord(to[0]) if len(ch.lower()) > 1 or not ch.lower().isalnum() else ord(ch.lower())
    return out


def fold(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = folding()[points]
    keep = out > 0
    before = np.zeros(len(points) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return out[keep], before[offsets]


def grams(points: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places where n characters of one row begin, and their hashes."""
    size = np.diff(offsets)
    room = np.repeat(offsets[1:], size) - np.arange(len(points))
    at = np.flatnonzero(room >= n)
    return at, Hashes(points).of(at, at + n)


def _least(item: np.ndarray, weight: np.ndarray, before: np.ndarray, n: int, wide: int) -> np.ndarray:
    """Per item the least sum of weights of ``wide`` n-grams in a row, those that are equal counted once; infinite for shorter items."""
    out = np.full(n, np.inf)
    size = np.bincount(item, minlength=n)
    start = np.cumsum(size) - size
    total = np.concatenate([[0], np.cumsum(weight)])
    again = np.flatnonzero((before >= 0) & (np.arange(len(item)) - before < wide))
    change = np.zeros(len(item) + 1)  # by the first place of a window: the weights that it counts again
    np.add.at(change, np.maximum(again - wide + 1, start[item[again]]), weight[again])
    np.add.at(change, before[again] + 1, -weight[again])
    at = np.arange(len(item) - wide + 1) if len(item) >= wide else np.zeros(0, np.int64)
    sums = total[at + wide] - total[at] - np.cumsum(change)[at]
    good = at + wide <= (start + size)[item[at]]
    np.minimum.at(out, item[at[good]], sums[good])
    return out


class Index:
    """Items by number, their postings by n-gram with BM25 weights in blocks, and their thresholds."""

    def __init__(self, ids: list[int], passages: list[str | None], questions: list[str | None], run: int = RUN):
        self.ids, self.run = ids, run
        points, offsets = decode(pa.array([p or "" for p in passages], pa.string()))
        self.points, self.offsets = fold(points, offsets)
        q_points, q_offsets = decode(pa.array([q or "" for q in questions], pa.string()))
        self.question_size = np.diff(fold(q_points, q_offsets)[1])
        at, h = grams(self.points, self.offsets, GRAM)
        item = np.searchsorted(self.offsets, at, "right") - 1
        n = max(len(ids), 1)
        length = np.bincount(item, minlength=n).astype(float)
        average = max(length[length > 0].mean() if (length > 0).any() else 1.0, 1.0)
        order = np.lexsort((item, h))
        own_h, own_item = h[order], item[order]
        fresh = np.concatenate([[True], (own_h[1:] != own_h[:-1]) | (own_item[1:] != own_item[:-1])])[: len(order)]
        head = np.flatnonzero(fresh)
        tf = np.diff(np.append(head, len(order)))
        terms, self.items = own_h[head], own_item[head]
        first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])[: len(terms)])
        self.terms, self.start = terms[first], np.append(first, len(terms))
        df = np.diff(self.start)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        self.weights = np.repeat(idf, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.items] / average))
        self.most = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        # the least score of any run of an item: its n-grams, each counted once as in a query
        weight = np.zeros(len(h))
        weight[order] = self.weights[np.cumsum(fresh) - 1]
        before = np.full(len(h), -1)  # where the same n-gram of the item stands last before
        before[order[1:]] = np.where(fresh[1:], -1, order[:-1])
        self.least = _least(item, weight, before, n, run - GRAM + 1) * (1 - 1e-8)
        self.floor = self.least.min() if len(self.least) else np.inf
        bits = 20
        self.sieve = np.zeros(1 << bits, bool)
        self.sieve[(self.terms >> np.uint64(64 - bits)).astype(np.int64)] = True

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The term's number of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.terms):
            return out
        maybe = np.flatnonzero(self.sieve[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, hashes[maybe]), len(self.terms) - 1)
        hit = self.terms[at] == hashes[maybe]
        out[maybe[hit]] = at[hit]
        return out

    def search(self, terms: np.ndarray) -> list[int]:
        """All items whose score over the distinct ``terms`` reaches their threshold, by block-max WAND."""
        cursors = [[int(self.start[t]), int(self.start[t + 1]), float(self.most[t])] for t in terms]
        items, weights, floor = self.items, self.weights, self.floor
        found = []
        while cursors:
            cursors.sort(key=lambda c: items[c[0]])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[2]
                if bound >= floor:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = items[cursors[pivot][0]]
            while pivot + 1 < len(cursors) and items[cursors[pivot + 1][0]] == item:
                pivot += 1
            near, until = 0.0, None
            for c in cursors[: pivot + 1]:  # the maxima of the blocks that may hold the item
                a = c[0]
                end = min(a - (a % BLOCK) + BLOCK, c[1])
                while end < c[1] and items[end - 1] < item:
                    a, end = end, min(end + BLOCK, c[1])
                near += float(weights[a:end].max())
                last = int(items[end - 1])
                until = last if until is None else min(until, last)
            if near >= floor:
                if items[cursors[0][0]] == item:
                    score = sum(float(weights[c[0]]) for c in cursors[: pivot + 1])
                    if score >= self.least[item]:
                        found.append(int(item))
                    target = item + 1
                else:
                    target = item
            else:
                target = max(int(item) + 1, until + 1) if pivot + 1 >= len(cursors) else max(int(item) + 1, min(until + 1, int(items[cursors[pivot + 1][0]])))
            moved = []
            for k, c in enumerate(cursors):
                if k <= pivot and items[c[0]] < target:
                    c[0] += int(np.searchsorted(items[c[0] : c[1]], target))
                if c[0] < c[1]:
                    moved.append(c)
            cursors = moved
        return found

    def stretches(self, text: np.ndarray, there: np.ndarray, item: int) -> list[tuple[int, int]]:
        """(length, start in the item) of every stretch of at least ``run`` characters that the text shares with the item; ``there`` has the hashes of the text's runs."""
        own = self.points[self.offsets[item] : self.offsets[item + 1]]
        n = self.run
        if len(own) < n or not len(there):
            return []
        b = np.arange(len(own) - n + 1)
        here = Hashes(own).of(b, b + n)
        order = np.argsort(here, kind="stable")
        low, high = (np.searchsorted(here[order], there, side) for side in ("left", "right"))
        hit = np.flatnonzero(high > low)
        many = (high - low)[hit]
        total = np.cumsum(many)
        found: list[tuple[int, int]] = []

        def close(first: int, last: int, shift: int) -> None:
            same = np.concatenate([[False], text[first : last + n] == own[first + shift : last + shift + n], [False]])
            edges = np.flatnonzero(same[1:] != same[:-1])  # more than one stretch only where hashes collide
            found.extend((int(e - s), first + shift + int(s)) for s, e in zip(edges[::2], edges[1::2]) if e - s >= n)

        open_, before, at = {}, -2, 0  # by shift the stretches that reach the end of the part before
        while at < len(hit):  # a bounded number of pairs of places at a time
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
            k = many[at:stop]
            p = np.repeat(hit[at:stop], k)
            q = order[np.repeat(low[hit[at:stop]], k) + np.arange(len(p)) - np.repeat(np.cumsum(k) - k, k)]
            by = np.lexsort((p, q - p))
            p, shift = p[by], (q - p)[by]
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(shift) != 0) | (np.diff(p) != 1)]))
            ends = np.append(starts[1:], len(p)) - 1
            now = {}
            for a, z in zip(starts, ends):
                first, last, s = int(p[a]), int(p[z]), int(shift[a])
                if first == before + 1 and s in open_:
                    first = open_.pop(s)
                if last == hit[stop - 1]:
                    now[s] = first
                else:
                    close(first, last, s)
            for s, first in open_.items():
                close(first, before, s)
            open_, before, at = now, int(hit[stop - 1]), stop
        for s, first in open_.items():
            close(first, before, s)
        return found


def _search_batch(texts: pa.Array, index: Index) -> list[tuple[int, int, int, bool, bool]]:
    """(row, item, longest shared stretch, whether any touches the question, the answer) of each leak in a batch of texts."""
    points, offsets = fold(*decode(texts))
    at, h = grams(points, offsets, GRAM)
    term = index.lookup(h)
    hit = term >= 0
    at, term = at[hit], term[hit]
    if not len(at):
        return []
    row = np.searchsorted(offsets, at, "right") - 1
    step = PASSAGE - index.run + 1
    inside = at - offsets[row]
    out: dict[tuple[int, int], tuple[int, bool, bool] | None] = {}
    hashed, there = -1, np.zeros(0, np.uint64)
    # the passages that a place belongs to: the one it falls in and, near its start, the one before
    number = inside // step
    keys = [row * (1 << 32) + number]
    early = (inside % step + GRAM <= index.run - 1 + 0) & (number > 0)
    places = np.concatenate([np.arange(len(at)), np.flatnonzero(early)])
    key = np.concatenate([keys[0], keys[0][early] - 1])
    order = np.lexsort((places, key))
    key, places = key[order], places[order]
    cut = np.flatnonzero(np.diff(key, prepend=-1))
    bound = np.add.reduceat(index.most[term[places]], cut)
    ends = np.append(cut[1:], len(key))
    for g in np.flatnonzero(bound >= index.floor):
        r = int(key[cut[g]] >> 32)
        for item in index.search(np.unique(term[places[cut[g] : ends[g]]])):
            if (r, item) in out:
                continue
            text = points[int(offsets[r]) : int(offsets[r + 1])]  # all of it: a leak may be longer than a passage, or come in parts
            if hashed != r:
                a = np.arange(max(0, len(text) - index.run + 1))
                hashed, there = r, Hashes(text).of(a, a + index.run)
            shared = index.stretches(text, there, item)
            size = index.question_size[item]
            out[(r, item)] = (max(n for n, _ in shared), any(q < size for _, q in shared), any(q + n > size for n, q in shared)) if shared else None
    return [(r, i, *found) for (r, i), found in out.items() if found]


def indexes(items: DataFrame, run: int = RUN, most: int = INDEX_CHARS) -> Iterator[Index]:
    """The items in as many indexes as their size needs, one at a time."""
    block, size = [], 0
    for r in items.select("item_id", "passage", "question").where("passage is not null").orderBy("item_id").toLocalIterator():
        block.append(r)
        size += len(r.passage)
        if size >= most:
            yield Index(*map(list, zip(*block)), run)
            block, size = [], 0
    if block:
        yield Index(*map(list, zip(*block)), run)


def leaked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, most: int = INDEX_CHARS) -> DataFrame:
    """One row per document and item that share at least ``run`` characters in a row: key, item_id, the longest shared stretch and whether any touches the item's question and its answer. Null and short texts and passages leak nothing, a null key or item_id is a key like others; repeated rows count once; other columns are not looked at."""
    wanted = docs.select(key, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL("item_id bigint, shared int, in_question boolean, in_answer boolean").fields])

    def pass_over(shipped) -> DataFrame:

        def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for batch in sliced(batches, "__text"):
                rows = _search_batch(batch.column("__text"), index)
                size, question, answer = ([r[k] for r in rows] for k in (2, 3, 4))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([r for r, *_ in rows], pa.int64())), pa.array([index.ids[i] for _, i, *_ in rows], pa.int64()), pa.array(size, pa.int32()), pa.array(question, pa.bool_()), pa.array(answer, pa.bool_())],
                    names=[key, "item_id", "shared", "in_question", "in_answer"],
                )

        return wanted.mapInArrow(run_batches, schema)

    context, blocks, parts = docs.sparkSession.sparkContext, indexes(items, run, most), []
    index = next(blocks, None)
    while index is not None:
        shipped, index = context.broadcast(index), None  # the driver holds one index at a time
        index = next(blocks, None)
        if index is None and not parts:
            parts.append(pass_over(shipped))
        else:
            parts.append(Stored(pass_over(shipped)).rows)
            shipped.destroy()
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found.groupBy(key, "item_id").agg(F.max("shared").alias("shared"), F.bool_or("in_question").alias("in_question"), F.bool_or("in_answer").alias("in_answer"))
