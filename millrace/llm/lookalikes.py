"""Visually identical text with different characters, brought to one form.

Arrow text is copied to code-point arrays. Single characters go through lookup tables (a gather);
those that stand for several are spread by expansion offsets; letters of another alphabet are
replaced where their word shows that they stand in for Latin ones. Letters that bear further marks
are taken apart, the marks of a letter are brought to their canonical order by one sort, and
letters and marks are composed by a search in a sorted table of pairs, Korean letters by
arithmetic. No row is touched by a string call.

Left as they are: the usual punctuation of Chinese and Japanese, joiners and signs that a script
needs, real words in Cyrillic or Greek, composed accents, and signs that differ visibly.
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

from millrace.functions.codepoints import TOP, decode, encode, sliced, table

#: Letters of Cyrillic and Greek, each with the Latin letter of the same appearance.
CYRILLIC = ("АВЕКМНОРСТУХаеорсухіјѕһԁԛԝЅІЈԌԚԜ", "ABEKMHOPCTYXaeopcyxijshdqwSIJGQW")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj")
#: The same of Armenian, Cherokee and the phonetic letters.
ARMENIAN = ("օոսհցՕՍՏ", "onuhgOUS")
CHEROKEE = ("ᎠᎡᎢᎥᎪᎫᎬᎷᎻᏀᏃᏎᏒᏔᏙᏚᏞᏟᏢᏦᏮᏳᏴ", "DRTiAJEMHGZ4RWVSLCPK6GB")
PHONETIC = ("ɑɡɩʏꞌ", "agiY'")
#: Punctuation of Chinese and Japanese that is usual in its wide form.
USUAL_WIDE = "！（），：；？～"
#: Invisible characters outside the general category Cf, and spaces that are usual.
ALSO_INVISIBLE = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)


@lru_cache(1)
def tables() -> dict[str, np.ndarray]:
    """one: the character that each stands for (itself if ordinary, 0 if it is to vanish); many: for those that stand for several, their place in ``spread``."""
    one = np.arange(TOP, dtype=np.uint32)
    several: dict[int, str] = {}
    wide = {ord(c) for c in USUAL_WIDE}
    ranges = ((0xFF01, 0xFF5E), (0xFFE0, 0xFFE6), (0xFF61, 0xFFDC), (0x2F00, 0x2FD5), (0x2E80, 0x2EF3), (0xF900, 0xFAD9), (0xFB00, 0xFB06), (0x2000, 0x200A), (0x202F, 0x205F), (0x1D400, 0x1D7FF), (0x2F800, 0x2FA1D), (0xFB50, 0xFDFB), (0xFE70, 0xFEFC), (0xFE30, 0xFE6F), (0x2160, 0x217F))
    for a, b in ranges:
        for c in range(a, b + 1):
            to = unicodedata.normalize("NFKC", chr(c))
            if c in wide or to == chr(c) or not unicodedata.name(chr(c), ""):
                continue
            if len(to) == 1:
                one[c] = ord(to)
            elif to.strip() == to:
                several[c] = to
    for c in (0xA0, 0x1680, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)):
        one[c] = 0x20
    for c, to in ((0x2010, "-"), (0x2011, "-"), (0x2212, "-"), (0x2024, "."), (0x2215, "/"), (0x2044, "/"), (0x37E, ";"), (0x2126, "Ω"), (0x212A, "K"), (0x212B, "Å"), (0xB5, "μ"), (0x3007, "〇"), (0x2CD, "_")):
        one[c] = ord(to)
    gone = [c for c in range(0x10000) if unicodedata.category(chr(c)) == "Cf" and not 0x600 <= c <= 0x8FF] + list(ALSO_INVISIBLE) + list(range(0xFE00, 0xFE10)) + list(range(0xE0100, 0xE01F0)) + list(range(0xE0000, 0xE0080))
    one[gone] = 0
    one[0] = 0
    many = np.full(TOP, -1, np.int32)
    spread = np.zeros((len(several) + 1, max([1, *map(len, several.values())])), np.uint32)
    for k, (c, to) in enumerate(several.items()):
        many[c] = k
        spread[k, : len(to)] = [ord(x) for x in to]
    latin = np.zeros(TOP, np.uint32)
    for there, here in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, PHONETIC):
        latin[[ord(c) for c in there]] = [ord(c) for c in here]
    first, second, composed = [], [], []
    apart, place = [], np.full(TOP, -1, np.int32)
    for c in range(0xC0, 0x1D200):
        parts = unicodedata.normalize("NFD", chr(c))
        if len(parts) < 2 or 0xAC00 <= c < 0xD7A4 or 0xD800 <= c < 0xE000:
            continue
        if unicodedata.normalize("NFC", chr(c)) == chr(c):
            place[c] = len(apart)
            apart.append(parts)
            head = unicodedata.normalize("NFC", parts[:-1])
            if len(head) == 1:
                first.append(ord(head)), second.append(ord(parts[-1])), composed.append(c)
        elif many[c] < 0 and one[c] == c:  # never written as one
            place[c] = len(apart)
            apart.append(parts)
    parted = np.zeros((len(apart), max(map(len, apart))), np.uint32)
    for k, parts in enumerate(apart):
        parted[k, : len(parts)] = [ord(x) for x in parts]
    always = np.zeros(TOP, bool)
    always[[c for c in np.flatnonzero(place >= 0).tolist() if unicodedata.normalize("NFC", chr(c)) != chr(c)]] = True
    rank = np.zeros(TOP, np.uint8)
    for c in (*range(0x300, 0x20000), *range(0xE0100, 0xE01F0)):
        if r := unicodedata.combining(chr(c)):
            rank[c] = r
    key = np.array(first, np.uint64) << np.uint64(32) | np.array(second, np.uint64)
    order = np.argsort(key)
    letters = table((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A))
    foreign = table((0x370, 0x3FF), (0x400, 0x52F), (0x531, 0x587), (0x13A0, 0x13F4), PHONETIC[0])
    needs_joiner = table((0x600, 0x6FF), (0x750, 0x77F), (0x900, 0xDFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x180B, 0x18AF))
    joins_after = table((0x620, 0x6FF), (0x750, 0x77F), *(range_ for base in range(0x900, 0xE00, 0x80) for range_ in ((base + 0x04, base + 0x4D),)), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1820, 0x18AF))
    emoji = table((0x1F300, 0x1FAFF), (0x2600, 0x27BF), 0xFE0F)
    return {
        "one": one, "many": many, "spread": spread, "length": (spread > 0).sum(1), "latin": latin, "letters": letters, "foreign": foreign,
        "digits": table((0x30, 0x39), "-"), "joiner": needs_joiner, "joins_after": joins_after, "emoji": emoji,
        "pair": key[order], "composed": np.array(composed, np.uint32)[order], "mark": table(*np.unique(second).tolist(), (0x1161, 0x1175), (0x11A8, 0x11C2)) | (rank > 0) | always, "rank": rank, "parted": parted, "place": place, "parts": (parted > 0).sum(1), "always": always, "virama": table(*(b + 0x4D for b in range(0x900, 0xE00, 0x80))),
    }


def normalise(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts in their one form, their offsets, and which rows had a character to replace."""
    t, n = tables(), len(points)
    rows = len(offsets) - 1
    if n == 0:
        return points, offsets, np.zeros(rows, bool)
    to = t["one"][points]
    many = t["many"][points]
    special = np.flatnonzero((to != points) | (points == 0) | (many >= 0) | t["foreign"][points] | t["mark"][points])
    if not len(special):
        return points, offsets, np.zeros(rows, bool)
    # joiners that a script needs: between letters of it
    joiner = special[(points[special] == 0x200C) | (points[special] == 0x200D)]
    before, after = points[np.maximum(joiner - 1, 0)], points[np.minimum(joiner + 1, n - 1)]
    row = np.searchsorted(offsets, joiner, "right") - 1
    within = (joiner > offsets[row]) & (joiner + 1 < offsets[row + 1])
    needed = within & ((t["joins_after"][before] & t["joiner"][after] & ((points[joiner] == 0x200C) | t["virama"][before])) | (t["emoji"][before] & t["emoji"][after]))
    to = to.copy()
    to[joiner[needed]] = points[joiner[needed]]
    pictured = special[(points[special] == 0xFE0F) & t["emoji"][points[np.maximum(special - 1, 0)]]]
    to[pictured] = 0xFE0F
    # letters of another alphabet: by words of letters, digits and hyphens
    foreign = special[t["foreign"][points[special]]]
    if len(foreign):
        word = t["letters"][points] | t["foreign"][points] | t["digits"][points] | (to == 0)
        start = np.zeros(n, bool)
        start[offsets[:-1][offsets[:-1] < n]] = True
        start[1:] |= word[1:] != word[:-1]
        number = np.cumsum(start) - 1
        total = number[-1] + 1
        has_latin = np.zeros(total, bool)
        has_latin[number[t["letters"][points]]] = True
        own = np.zeros(total, bool)  # a letter that no Latin one looks like
        own[number[foreign[t["latin"][points[foreign]] == 0]]] = True
        size = np.bincount(number[foreign], minlength=total)
        of = number[foreign]
        near = own | False  # a word between words of its own alphabet is a real one
        near[:-2] |= own[2:]
        near[2:] |= own[:-2]
        stands_in = (t["latin"][points[foreign]] > 0) & ((has_latin[of] & ~(own[of] & (size[of] > 2))) | (~has_latin[of] & ~near[of]))
        to[foreign[stands_in]] = t["latin"][points[foreign[stands_in]]]
    width = (to > 0).astype(np.int64)
    spread = many >= 0
    width[spread] = t["length"][many[spread]]
    place = np.zeros(n + 1, np.int64)
    np.cumsum(width, out=place[1:])
    out = np.zeros(place[-1], np.uint32)
    single = (width == 1) & ~spread
    out[place[:-1][single]] = to[single]
    for k in range(t["spread"].shape[1]):
        has = spread & (width > k)
        out[place[:-1][has] + k] = t["spread"][many[has], k]
    out, ends = composed(out, place[offsets])
    return out, ends, ~same_rows(points, offsets, out, ends)


def same_rows(a: np.ndarray, a_offsets: np.ndarray, b: np.ndarray, b_offsets: np.ndarray) -> np.ndarray:
    """Which rows of two batches are equal."""
    size = np.diff(a_offsets)
    same = size == np.diff(b_offsets)
    rows = np.flatnonzero(same & (size > 0))
    if len(rows):
        own = np.repeat(np.arange(len(rows)), size[rows])
        step = np.arange(len(own)) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows])
        apart = a[a_offsets[rows][own] + step] != b[b_offsets[rows][own] + step]
        same[rows[np.unique(own[apart])]] = False
    return same


def composed(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and marks in canonical order and composed, as the standard's form C has them."""
    t = tables()
    if not t["mark"][points].any():
        return points, offsets
    # a letter before a mark is taken apart, so that all its marks can be ordered
    followed = np.zeros(len(points), bool)
    followed[:-1] = t["rank"][points[1:]] > 0
    followed[offsets[1:][offsets[1:] > 0] - 1] = False
    at = t["place"][points]
    split = (at >= 0) & (followed | t["always"][points])
    width = np.where(split, t["parts"][np.maximum(at, 0)], 1)
    to = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=to[1:])
    out = np.zeros(to[-1], np.uint32)
    out[to[:-1][~split]] = points[~split]
    for k in range(t["parted"].shape[1]):
        has = split & (width > k)
        out[to[:-1][has] + k] = t["parted"][at[has], k]
    points, offsets = out, to[offsets]
    rank = t["rank"][points]
    starts = np.zeros(len(points) + 1, bool)
    starts[offsets] = True
    run = np.cumsum((rank == 0) | starts[:-1])
    marks = np.flatnonzero(rank > 0)
    points[marks] = points[marks[np.lexsort((rank[marks], run[marks]))]]
    while True:  # the first mark that each letter can take up, again and again, as a letter may bear several
        n = len(points)
        rank = t["rank"][points].astype(np.int16)
        index = np.arange(n)
        mark = np.flatnonzero(t["mark"][points])
        mark = mark[(mark > 0) & ~starts[mark]]
        letter = np.maximum.accumulate(np.where((rank == 0) | starts[:n], index, 0))
        base = np.where(rank[mark] > 0, letter[mark], mark - 1)
        free = (rank[base] == 0) & ((base == mark - 1) | (rank[mark - 1] < rank[mark]))
        mark, base = mark[free], base[free]
        a, b = points[base].astype(np.int64), points[mark].astype(np.int64)
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        k = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
        made = np.where(t["pair"][k] == key, t["composed"][k].astype(np.int64), 0)
        vowel = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)  # Korean: fixed values of the standard's arithmetic
        made = np.where(vowel, 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28, made)
        final = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
        made = np.where(final, a + b - 0x11A7, made)
        hit = made > 0
        mark, base, made = mark[hit], base[hit], made[hit]
        first = np.concatenate([[True], base[1:] != base[:-1]])[: len(base)] & ~np.isin(base, mark)
        mark, base, made = mark[first], base[first], made[first]
        if not len(mark):
            return points, offsets
        points[base] = made
        keep = np.ones(n, bool)
        keep[mark] = False
        before = np.zeros(n + 1, np.int64)
        np.cumsum(keep, out=before[1:])
        points, offsets = points[keep], before[offsets]
        starts = np.zeros(len(points) + 1, bool)
        starts[offsets] = True


def one_form(df: DataFrame, text: str, key: list[str]) -> DataFrame:
    """``key``, the text in its one form (``text``) and whether it was stored otherwise (``changed``), a row for each row. Null stays null and unchanged; other columns are not looked at."""
    wanted = df.select(*key, F.col(text).cast("string").alias("text"))
    schema = T.StructType([*wanted.schema.fields, T.StructField("changed", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            column = batch.column("text")
            points, offsets, changed = normalise(*decode(column))
            missing = column.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], encode(points, offsets, missing).cast(pa.string()), pa.array(changed)], names=[*key, "text", "changed"])

    return wanted.mapInArrow(run, schema)
