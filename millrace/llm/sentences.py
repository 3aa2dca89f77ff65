"""Sentence boundaries across languages and scripts.

Candidates are end marks with the closing quotes and brackets behind them, semicolons and colons
before an enumerator, and spaces in Thai. Each is classified by a maximum-entropy model whose
features are the neighbouring tokens, their case, length, digits and script; only the end of a
paragraph needs no model. It is fitted on boundaries that are reliable without it: the end of a
paragraph, followed by the start of the next one, and line breaks before an enumerator. How sure it
must be of a kind is fitted, too, on reliable boundaries that it has not seen.

Everything works on code-point arrays of whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.codepoints import Hashes, decode, mix, row_of, scripts, sliced, spaces, table
from millrace.llm.maxent import MaxEnt, hashed

#: Rows, and characters, that the model is fitted on at most.
SAMPLE, SAMPLE_CHARS = 8000, 3_000_000
#: Kinds of candidates: a dot; a mark with closers behind it; a space in Thai; another mark; a semicolon before an item; a colon before the first item.
DOT, CLOSED, THAI, HARD, ITEM, LEAD = range(6)
#: The chance that is enough for each kind where too few reliable boundaries of it are known to fit one.
LEAST = np.array([0.2, 0.1, 0.15, 0, 0, 0], np.float32)
HAN, LATIN, DIGIT, THAI_SCRIPT = 1, 4, 9, 8


@lru_cache(1)
def tables() -> dict[str, np.ndarray]:
    lower = np.arange(0x3000, dtype=np.uint32)
    for c in range(0x3000):
        if len(low := chr(c).lower()) == 1:
            lower[c] = ord(low)
    script = scripts()
    upper = table(*(c for c in range(0x2000) if chr(c).isupper()))
    return {
        "space": spaces(),
        "line": table("\n\x0b\x0c\x85\u2028\u2029"),
        "dot": table(".．"),
        "hard": table("。｡！？!?।॥؟۔‼⁇⁈⁉"),
        "open": table("“‘「『（(《〈【〔[{„«｢"),
        "close": table("”’」』）)》〉】〕]}»｣"),
        "comma": table("，、,;；:：…·-—%％"),
        "numeral": table("一二三四五六七八九十0123456789０１２３４５６７８９"),
        "han_numeral": table("一二三四五六七八九十"),
        "circled": table((0x2460, 0x2473), (0x2474, 0x2487)),
        "script": script,
        "upper": upper,
        "word": np.isin(script, (4, 5, 6, 7, 3, 13)),
        "cjk": np.isin(script, (1, 2)),
        "lower": lower,
    }


class Layout:
    """The characters of a batch without white space: ``c`` their code points, ``at`` their places, ``gap`` what follows each (0 nothing, 1 space, 2 line break, 3 end of paragraph, 4 end of text)."""

    def __init__(self, points: np.ndarray, offsets: np.ndarray):
        t = tables()
        self.offsets, self.size = offsets, len(points)
        self.at = at = np.flatnonzero(~t["space"][points])
        self.c = c = points[at]
        self.row = row = row_of(offsets)[at]
        n = len(c)
        self.gap = gap = np.full(n, 4, np.int8)
        if n > 1:
            lines = np.zeros(len(points) + 1, np.int32)
            np.cumsum(t["line"][points], out=lines[1:])
            breaks = lines[at[1:]] - lines[at[:-1]]
            gap[:-1] = np.where(row[1:] != row[:-1], 4, np.where(breaks > 1, 3, np.where(breaks == 1, 2, np.diff(at) > 1)))
        ends = gap >= 3
        self.paragraph = np.cumsum(ends) - ends
        self.last = np.flatnonzero(ends)
        self.first = np.concatenate([[0], self.last[:-1] + 1]) if n else self.last
        self.small = np.where(c < 0x3000, t["lower"][np.minimum(c, 0x2FFF)], c)
        self.hash = Hashes(self.small)
        self.script = t["script"][c]
        self.index = np.arange(n)
        self.padded = np.concatenate([c, np.zeros(6, c.dtype)])
        self.joined = np.zeros(n, bool)  # with the character before it
        self.joined[1:] = gap[:-1] == 0
        word = t["word"][c]
        kind = np.where(self.script == DIGIT, 2, np.where(word, 1, 0))
        same = np.zeros(n, bool)
        same[1:] = (kind[1:] == kind[:-1]) & (kind[1:] > 0) & self.joined[1:]
        self.token_from = np.maximum.accumulate(np.where(same, 0, self.index)) if n else self.index
        until = np.concatenate([~same[1:], [True]]) if n else same
        self.token_to = np.minimum.accumulate(np.where(until, self.index, n)[::-1])[::-1] + 1 if n else self.index
        self._quotes()

    def _quotes(self) -> None:
        """closer: characters that close; depth: open quotes and brackets behind each character."""
        t, c, n = tables(), self.c, len(self.c)
        opens, closes = t["open"][c], t["close"][c]
        if n == 0:
            self.closer, self.depth = closes, np.zeros(0, np.int32)
            return
        apostrophe = np.flatnonzero((c == ord("’")) & self.joined & (self.script[np.maximum(self.index - 1, 0)] == LATIN))
        closes[apostrophe[(self.script[np.minimum(apostrophe + 1, n - 1)] == LATIN) & (self.gap[apostrophe] == 0)]] = False
        pair = np.flatnonzero((c == ord("„")) | (c == ord("“")))
        ends = pair[1:][(c[pair[1:]] == ord("“")) & (c[pair[:-1]] == ord("„")) & (self.paragraph[pair[1:]] == self.paragraph[pair[:-1]])]
        opens[ends], closes[ends] = False, True
        straight = np.flatnonzero(c == ord('"'))
        if len(straight):
            first = np.flatnonzero(np.diff(self.paragraph[straight], prepend=-1))
            rank = np.arange(len(straight)) - np.repeat(first, np.diff([*first, len(straight)]))
            opens[straight[rank % 2 == 0]], closes[straight[rank % 2 == 1]] = True, True
        step = opens.astype(np.int32) - closes
        depth = np.cumsum(step)
        depth -= (depth - step)[self.first][self.paragraph]
        wrong = (np.minimum.reduceat(depth, self.first) < 0) | (depth[self.last] != 0)
        for p in np.flatnonzero(wrong):  # only matched pairs count
            a, b = self.first[p], self.last[p] + 1
            stack: list[int] = []
            own = np.zeros(b - a, np.int32)
            for k in np.flatnonzero(opens[a:b] | closes[a:b]):
                if opens[a + k]:
                    stack.append(k)
                elif stack:
                    own[stack.pop()], own[k] = 1, -1
            depth[a:b] = np.cumsum(own)
        self.closer, self.depth = closes, depth

    def marker(self, k: np.ndarray) -> np.ndarray:
        """Whether an enumerator such as (2), （二）, 二是, ②, 2. or 二、 begins at k."""
        t, c = tables(), self.padded
        x = [c[np.minimum(k + i, len(c) - 1)] for i in range(4)]
        opened = (x[0] == ord("(")) | (x[0] == ord("（"))
        shut = [(y == ord(")")) | (y == ord("）")) for y in x]
        num = [t["numeral"][y] for y in x]
        stop = [np.isin(y, [ord(s) for s in ".．、)）"]) for y in x]
        digit = [t["script"][y] == DIGIT for y in x]
        return (opened & num[1] & (shut[2] | (num[2] & shut[3]))) | (t["han_numeral"][x[0]] & ((x[1] == ord("是")) | (x[1] == ord("、")))) | t["circled"][x[0]] | (digit[0] & ((stop[1] & ~digit[2]) | (digit[1] & stop[2] & ~digit[3])))


def candidates(x: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The candidates to classify within paragraphs: end, place of the mark and kind. Places are those of the last character of a unit."""
    t, c, gap, n = tables(), x.c, x.gap, len(x.c)
    term = t["hard"][c] | t["dot"][c]
    either = term | x.closer
    more = np.zeros(n, bool)  # the run of marks and closers goes on
    more[:-1] = either[:-1] & either[1:] & (gap[:-1] == 0)
    ends = np.flatnonzero(either & ~more)
    mark = np.maximum.accumulate(np.where(term, x.index, -1))[ends]
    starts = np.maximum.accumulate(np.where(either & ~np.concatenate([[False], more[:-1]]), x.index, 0))[ends]
    keep = (mark >= starts) & (gap[ends] < 3)
    ends, mark = ends[keep], mark[keep]
    after = c[ends + 1]
    before = np.maximum(mark - 1, 0)
    dot = t["dot"][c[mark]] & ~(t["cjk"][c[before]] & x.joined[mark])
    inside = x.depth[ends] > 0
    glued = (gap[ends] == 0) & dot & (np.isin(x.script[ends + 1], (LATIN, DIGIT, 5, 6)))
    keep = ~inside & ~glued & ~t["comma"][after]
    ends, mark, dot = ends[keep], mark[keep], dot[keep]
    plain = ends == mark
    kind = np.where(plain, np.where(dot, DOT, HARD), CLOSED)
    numbering = (mark - x.first[x.paragraph[mark]] < 4) & (kind != HARD)  # such as "1." or "##" before a heading
    found = [(ends[~numbering], mark[~numbering], kind[~numbering])]
    # enumerations of Chinese: items closed by a semicolon, and the words before the first item
    semi = np.flatnonzero(((c == ord("；")) | ((c == ord(";")) & t["cjk"][c[np.maximum(x.index - 1, 0)]])) & (gap < 3) & (x.depth == 0))
    semi = semi[x.marker(semi + 1)]
    found.append((semi, semi, np.full(len(semi), ITEM)))
    if len(semi):
        colon = np.flatnonzero(((c == ord("：")) | (c == ord(":"))) & (gap < 3) & (x.depth == 0))
        colon = colon[x.marker(colon + 1) & np.isin(x.paragraph[colon], x.paragraph[semi])]
        first = np.isin(x.padded[colon + 1], [ord(s) for s in "一1①"]) | np.isin(x.padded[colon + 2], [ord(s) for s in "一1"])
        found.append((colon[first], colon[first], np.full(int(first.sum()), LEAD)))
    thai = np.flatnonzero((gap[:-1] > 0) & (gap[:-1] < 3) & (x.script[1:] == THAI_SCRIPT) & (x.depth[:-1] == 0) & ~term[:-1])
    if len(thai):
        share = np.bincount(x.paragraph, x.script == THAI_SCRIPT) / np.bincount(x.paragraph)
        thai = thai[share[x.paragraph[thai]] > 0.5]
        thai = thai[thai - x.first[x.paragraph[thai]] >= 4]
        found.append((thai, thai, np.full(len(thai), THAI)))
    return tuple(np.concatenate(v) for v in zip(*found))


def features(x: Layout, ends: np.ndarray, mark: np.ndarray, kind: np.ndarray, right: np.ndarray | None = None) -> np.ndarray:
    """Features of candidates; right: the first character of what follows, by default the next one."""
    t, c, n = tables(), x.c, len(x.c)
    left = np.where(kind == THAI, mark, np.maximum(mark - 1, 0))
    right = np.minimum(ends + 1, n - 1) if right is None else right
    begin, stop = x.first[x.paragraph[left]], x.last[x.paragraph[right]] + 1
    k = kind.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    token = x.hash.of(x.token_from[left], left + 1)
    length = np.minimum(left + 1 - x.token_from[left], 7)
    digits = x.script[left] == DIGIT
    token = np.where(digits, np.uint64(7), token)
    case = t["upper"][c[x.token_from[left]]] * 2 + t["upper"][c[left]]
    shape = x.script[left] * 64 + length * 4 + case
    following = x.hash.of(right, np.maximum(x.token_to[right], right + 1))
    after = x.script[right] * 4 + t["upper"][c[right]] * 2 + t["upper"][c[np.minimum(right + 1, n - 1)]]
    ahead = [x.hash.of(right, np.minimum(right + i, stop)) for i in (1, 2, 4, 8)]
    behind = [x.hash.of(np.maximum(left + 1 - i, begin), left + 1) for i in (2, 4)]
    u = lambda v: np.asarray(v).astype(np.uint64)
    columns = [u(c[mark]), token, u(shape), u(after), following, *ahead, u(shape // 64 * 1000 + after), *behind, u(c[ends]) * np.uint64(0x10001) + ahead[0], mix(u(digits)) + following]
    shared = [following, *ahead[1:], u(after)]  # what sentences begin with, whatever ends the one before
    return hashed([*(mix(v + k) for v in columns), *shared])


def fit(texts: pa.Array) -> MaxEnt:
    """Fitted on the texts of a sample; each row may hold several paragraphs."""
    x = Layout(*decode(texts))
    if len(x.c) < 2:
        return MaxEnt.untrained(LEAST)
    t = tables()
    ends, mark, kind = candidates(x)
    # reliable: a body paragraph that ends with a mark, or is Thai, and the start of another one
    size = x.last - x.first + 1
    final = t["hard"][x.c[x.last]] | t["dot"][x.c[x.last]] | x.closer[x.last] | (x.script[x.last] == THAI_SCRIPT)
    body = (size >= 30) & final
    p = np.flatnonzero(body)
    p = p[np.argsort(x.script[x.first[p]], kind="stable")]  # within a script, as the left and the right must be of one language
    p, after = p[:-1], p[1:]
    same = x.script[x.first[p]] == x.script[x.first[after]]
    p, after = p[same], after[same]
    end = x.last[p]
    term = t["hard"][x.c] | t["dot"][x.c]
    last_mark = np.maximum.accumulate(np.where(term, x.index, -1))[end]
    only_closers = np.maximum.accumulate(np.where(term | x.closer, -1, x.index))[end] < last_mark
    thai = (x.script[end] == THAI_SCRIPT) & ~term[end]
    dot = t["dot"][x.c[last_mark]] & ~t["cjk"][x.c[np.maximum(last_mark - 1, 0)]]
    use = thai | (only_closers & (last_mark >= x.first[p]))
    good_end, good_mark = end[use], np.where(thai, end, last_mark)[use]
    good_kind = np.where(thai, THAI, np.where(last_mark < end, CLOSED, np.where(dot, DOT, HARD)))[use]
    all_kinds = np.concatenate([good_kind, kind])
    right = np.concatenate([x.first[after[use]], ends + 1])
    all_features = features(x, np.concatenate([good_end, ends]), np.concatenate([good_mark, mark]), all_kinds, right)
    broken = (kind >= ITEM) & (x.gap[ends] == 2)
    return MaxEnt.fit(all_features, np.concatenate([np.ones(len(good_kind), bool), broken]), all_kinds, LEAST)


def units(points: np.ndarray, offsets: np.ndarray, model: MaxEnt) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each sentence unit, positions counted from the row's start."""
    x = Layout(points, offsets)
    if not len(x.c):
        return (np.zeros(0, np.int64),) * 3
    ends, mark, kind = candidates(x)
    is_end = np.zeros(len(x.c), bool)
    is_end[x.last] = True
    if len(ends):
        is_end[ends[model.accepts(features(x, ends, mark, kind), kind)]] = True
    last = np.flatnonzero(is_end)
    first = np.concatenate([[0], last[:-1] + 1])
    base = offsets[x.row[last]]
    return x.row[last], x.at[first] - base, x.at[last] + 1 - base


def sample_texts(df: DataFrame, key: Column | str, text: str, rows: int = SAMPLE) -> pa.Array:
    """About ``rows`` texts, but not above about SAMPLE_CHARS characters, chosen by the hash of their key."""
    total, chars = df.agg(F.count("*"), F.coalesce(F.sum(F.char_length(text)), F.lit(0))).first()
    share = min(1.0, rows / max(total, 1), SAMPLE_CHARS / max(chars, 1))
    picked = df.where((F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20)) + 1) & F.col(text).isNotNull())
    return picked.select(F.col(text).cast("string").alias("t")).toArrow().column("t").combine_chunks()


def train(df: DataFrame, key: str, text: str, rows: int = SAMPLE) -> MaxEnt:
    texts = sample_texts(df, key, text, rows)
    return fit(texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks))


def with_units(df: DataFrame, text: str, model: MaxEnt, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and two arrays, ``starts`` and ``ends``, of the units of each text.

    Null and blank texts have no unit. Positions are 0-based code points, end exclusive.
    """
    wanted = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = wanted.drop("__text").schema.add("starts", T.ArrayType(T.IntegerType())).add("ends", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "__text"):
            points, offsets = decode(batch.column("__text"))
            row, start, end = units(points, offsets, model)
            at = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(at, pa.array(v.astype(np.int32))) for v in (start, end)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], names=[*keep, "starts", "ends"])

    return wanted.mapInArrow(run, schema)


def sentence_units(df: DataFrame, key: str, text: str, model: MaxEnt | None = None) -> DataFrame:
    """One row per unit: key, start_pos, end_pos. Repeated rows count once; null and blank texts have no row, null keys keep theirs; other columns are not looked at."""
    model = model or train(df, key, text)
    spans = with_units(df, text, model, [key]).distinct()
    return spans.select(key, F.inline(F.arrays_zip("starts", "ends"))).select(key, F.col("starts").alias("start_pos"), F.col("ends").alias("end_pos"))
