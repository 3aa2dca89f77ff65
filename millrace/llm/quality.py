"""Per-document text quality statistics, and whether a document is prose, a list, a table or junk.

Huge texts are split into chunks that are spread over tasks. A chunk gives counts of what it holds
and a boundary state: the characters at its ends and its open first and last line. Two neighbours
are merged by adding their counts, correcting them by what only shows around the seam, and joining
the last line of the one with the first of the other; the merge is associative and runs as a tree.
Repetition is found by counting the distinct hashes of lines and sequences over the document. So
every count is that of the whole text, however it is cut. Texts of one chunk need no merge. Ratios
and rules follow from the counts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.codepoints import Hashes, decode, mix, row_of, scripts, sliced, spaces, table
from millrace.session import Stored

#: Bytes of a chunk; texts up to this size are counted as one.
CHUNK = 1 << 16
#: Neighbouring chunks, or groups of them, that are merged at a time.
FAN = 64
#: Characters from which on a word is long, and those of a sequence that may repeat.
LONG, GRAM = 24, 10
#: Cell separators of tables: bar, tab, comma, semicolon, several spaces.
SEPARATORS = ("bar", "tab", "comma", "semicolon", "wide")
#: What can be told from the characters nearby, so that the sum over two chunks is corrected by what is seen around their seam.
LOCAL = ("chars", "visible", "words", "word_chars", "common", "signs", "odd_signs", "digits", "han", "rare_han", "broken", "sentence_marks", "pieces", "single_pieces", "long_pieces_chars", "items", "numbers", "grams")
#: What is counted by line; the open lines at the ends of a chunk are part of its boundary state.
BY_LINE = ("lines", "ended_lines", "short_lines", "short_chars", "bullet_lines", "leader_lines", *(f"{s}_{k}" for s in SEPARATORS for k in ("lines", "sum", "square")))
COUNTS = (*LOCAL, *BY_LINE, "repeated_lines", "repeated_grams")


@lru_cache(1)
def tables() -> dict[str, np.ndarray]:
    script = scripts()
    known = np.zeros(0x110000, bool)
    for name, leads in (("gb2312", range(0xB0, 0xF8)), ("big5", range(0xA4, 0xC7)), ("shift_jis", range(0x88, 0x99))):
        for lead in leads:
            for trail in range(0x40, 0xFF):
                try:
                    known[ord(bytes([lead, trail]).decode(name))] = True
                except (UnicodeDecodeError, TypeError):
                    pass
    return {
        "space": spaces(),
        "script": script,
        "known": known,
        "end": table("。！？!?.।॥；;”’」』）)…．"),
        "sentence": table("。！？!?।॥｡"),
        "dot": table(".．"),
        "sign": np.isin(script, (11, 12)) | table((0x2000, 0x206F), (0xA1, 0xBF)),
        "odd": table("\\{}[]<>=_~^`@$&丨亅乚丿"),
        "bullet": table("-*•·□■●○◆◇▪►▶☐✓–—"),
        "item": table("、／/|｜·•,，;；\t"),
        "broken": table((0x80, 0x9F), 0xFFFD, (0xE000, 0xF8FF), (0x2500, 0x259F)),
        "spaced": np.isin(script, (3, 4, 5, 6, 7, 13)),
        "numeral": table("一二三四五六七八九十0123456789"),
    }


class Vocabulary:
    """Common words: hashes of those that are written between spaces, and of those that are found anywhere in a text without spaces."""

    def __init__(self, words: list[str]):
        spaced, inside = set(), {}
        for w in {w.lower() for w in words if w}:
            points = np.array([ord(c) for c in w], np.uint32)
            h = int(Hashes(points).of(np.array([0]), np.array([len(w)]))[0])
            if tables()["spaced"][points[0]]:
                spaced.add(h)
            else:
                inside.setdefault(len(w), []).append((int(points[0]), h))
        self.spaced = np.array(sorted(spaced), np.uint64)
        #: Characters around a seam that LOCAL needs to see on either side.
        self.reach = max([LONG + 8, *(len(w) + 2 for w in words if w)])
        self.inside = {n: (np.array(sorted({a for a, _ in ws}), np.uint32), np.array(sorted(h for _, h in ws), np.uint64)) for n, ws in inside.items()}


class View:
    """What the counts need of a batch of texts, by character."""

    def __init__(self, points: np.ndarray, offsets: np.ndarray):
        self.points, self.offsets = points, offsets
        self.n, self.rows = len(points), len(offsets) - 1
        t = self.t = tables()
        self.row = row_of(offsets)
        self.first = np.zeros(self.n + 1, bool)
        self.first[offsets] = True
        self.space, self.script = t["space"][points], t["script"][points]
        self.hashes = Hashes(lowered(points))

    def before(self, mask: np.ndarray, steps: int = 1) -> np.ndarray:
        """The mask of the character so many places before, within the same text."""
        out = np.zeros(self.n, bool)
        if self.n > steps:
            out[steps:] = mask[:-steps] & (self.row[steps:] == self.row[:-steps])
        return out

    def runs(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = mask & ~self.before(mask)
        ends = mask.copy()
        if self.n:
            ends[:-1] &= ~mask[1:] | self.first[1 : self.n]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def lowered(points: np.ndarray) -> np.ndarray:
    return np.where((points >= 0x41) & (points <= 0x5A), points + 32, points)


def local(v: View, words: Vocabulary) -> np.ndarray:
    """A matrix of LOCAL by text."""
    t, n, points, space, script = v.t, v.n, v.points, v.space, v.script
    out: dict[str, np.ndarray] = {"chars": np.diff(v.offsets)}

    def add(name: str, mask: np.ndarray) -> None:
        out[name] = np.bincount(v.row[mask], minlength=v.rows)

    def tally(name: str, places: np.ndarray, weights: np.ndarray | None = None) -> None:
        out[name] = np.bincount(v.row[places], weights, v.rows).astype(np.int64)

    han = script == 1
    add("visible", ~space)
    add("digits", script == 9)
    add("han", han)
    add("rare_han", han & ~t["known"][points])
    add("broken", t["broken"][points])
    add("signs", t["sign"][points])
    add("odd_signs", t["odd"][points])
    add("items", t["item"][points])
    # words: runs of letters and digits, and each character of a script without spaces
    alone = han | (script == 2) | (script == 8)
    letter = t["spaced"][points] | (script == 9)
    start, end = v.runs(letter)
    tally("words", np.concatenate([start, np.flatnonzero(alone)]))
    add("word_chars", letter | alone)
    common = [start[np.isin(v.hashes.of(start, end), words.spaced)]]
    for length, (initial, known) in words.inside.items():
        places = np.flatnonzero(np.isin(points[: max(0, n - length + 1)], initial))
        places = places[v.offsets[v.row[places] + 1] >= places + length]
        common.append(places[np.isin(v.hashes.of(places, places + length), known)])
    tally("common", np.concatenate(common))
    long = end - start > LONG
    tally("long_pieces_chars", start[long], (end - start)[long])
    # pieces between spaces
    start, end = v.runs(~space)
    tally("pieces", start)
    tally("single_pieces", start[(end - start == 1) & (letter | alone)[start]])
    # a dot ends a sentence before a space or the end, and not after a digit, another dot or nothing
    mark = t["sentence"][points]
    dots = np.flatnonzero(t["dot"][points])
    ahead, behind = np.minimum(dots + 1, max(n - 1, 0)), np.maximum(dots - 1, 0)
    mark[dots] = (v.first[dots + 1] | space[ahead]) & ~v.first[dots] & (script[behind] != 9) & ~t["dot"][points[behind]]
    add("sentence_marks", mark)
    number = script == 9
    add("numbers", number & ~v.before(number | np.isin(points, [ord(x) for x in ".-%:"])))
    out["grams"] = np.maximum(out["chars"] - (GRAM - 1), 0)
    return np.stack([out[k] for k in LOCAL], 1).astype(np.int64)


#: Of a line or a part of one: characters; whether any is visible; the first visible and the two after it; the last visible; the characters at its ends; hash and length of the space before, of what is between the first and last visible ones, and of the space behind; how often each separator stands in it; whether it has a row of dots.
PART = ("size", "full", "opening", "last", "head", "tail", "before", "core", "behind", "separators", "leader")


class Lines:
    """Lines, or parts of them, of a batch: text[start:end] without the line break."""

    def __init__(self, v: View, start: np.ndarray, end: np.ndarray):
        points, n, visible = v.points, v.n, ~v.space
        self.v, self.start, self.end = v, start, end
        seen = _sums(visible)
        self.full = seen[end] > seen[start]
        index = np.arange(n)
        first_after = np.append(np.minimum.accumulate(np.where(visible, index, n)[::-1])[::-1], n)
        last_before = np.concatenate([[-1], np.maximum.accumulate(np.where(visible, index, -1))])
        self.head = np.where(self.full, first_after[start], end)
        self.last = np.where(self.full, last_before[end], start - 1)
        newline = points == 10
        wide = v.space & v.before(v.space) & ~newline & ~v.before(newline)
        wide &= ~v.before(wide)
        masks = (points == ord("|"), points == 9, points == ord(","), (points == ord(";")) | (points == ord("；")), wide)
        self.separators = np.stack([_sums(m)[end] - _sums(m)[start] for m in masks], 1) if len(start) else np.zeros((0, len(masks)), np.int64)
        dotted = np.isin(points, [ord(x) for x in DOTS])
        leads = _sums(dotted & v.before(dotted) & v.before(dotted, 2) & v.before(dotted, 3))
        self.leader = leads[end] > leads[start]

    def opening(self) -> np.ndarray:
        at = self.head[:, None] + np.arange(3)
        return np.where(at < self.end[:, None], np.append(self.v.points, 10)[np.minimum(at, self.v.n)], 10)

    def parts(self) -> list[dict]:
        """As PART, one by one."""
        out, h, points = [], self.v.hashes, self.v.points
        opening = self.opening()
        for k, (a, b, i, j) in enumerate(zip(self.start.tolist(), self.end.tolist(), self.head.tolist(), (self.last + 1).tolist())):
            stretch = lambda x, y: (int(h.raw(np.array([x]), np.array([y]))[0]), y - x)
            full = bool(self.full[k])
            values = (b - a, full, opening[k][: max(0, min(3, b - i))].tolist() if full else [], int(points[j - 1]) if full else 0, points[a : min(b, a + 3)].tolist(), points[max(a, b - 3) : b].tolist(), stretch(a, i), stretch(i, j) if full else (0, 0), stretch(j, b) if full else (0, 0), self.separators[k].tolist(), bool(self.leader[k]))
            out.append(dict(zip(PART, values)))
        return out


DOTS = ".…·"


def _sums(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def by_line(opening: np.ndarray, last: np.ndarray, length: np.ndarray, separators: np.ndarray, leader: np.ndarray) -> np.ndarray:
    """A matrix of BY_LINE by line; the lines have a visible character."""
    t = tables()
    ended = t["end"][last]
    short = (length <= 40) & ~ended
    stop = lambda c: np.isin(c, [ord(x) for x in ".、)）．"])
    numeral = t["numeral"][opening]
    bullet = (t["bullet"][opening[:, 0]] & t["space"][opening[:, 1]]) | (numeral[:, 0] & (stop(opening[:, 1]) | (numeral[:, 1] & stop(opening[:, 2]))))
    led = leader & (t["script"][last] == 9) & (t["script"][opening[:, 0]] != 11)
    columns = [np.ones(len(last)), ended, short, short * length, bullet, led]
    for k in range(len(SEPARATORS)):
        columns += [separators[:, k] >= 2, separators[:, k], separators[:, k] ** 2]
    return np.stack(columns, 1).astype(np.int64)


def _join(a: dict, b: dict) -> dict:
    """Two neighbouring parts of one line as one."""
    both = lambda x, y: ((x[0] + y[0] * pow(Hashes.BASE, x[1], 1 << 64)) % (1 << 64), x[1] + y[1])
    seam = a["tail"] + b["head"]
    out = {"size": a["size"] + b["size"], "full": a["full"] or b["full"], "head": (a["head"] + b["head"])[:3] if a["size"] < 3 else a["head"], "tail": (a["tail"] + b["tail"])[-3:] if b["size"] < 3 else b["tail"]}
    wide = _wide(seam) - _wide(a["tail"]) - _wide(b["head"])
    out["separators"] = [x + y for x, y in zip(a["separators"], b["separators"])]
    out["separators"][SEPARATORS.index("wide")] += wide
    out["leader"] = a["leader"] or b["leader"] or "dddd" in "".join("d" if chr(c) in DOTS else "-" for c in seam)
    if a["full"] and b["full"]:
        out |= {"before": a["before"], "core": both(both(a["core"], a["behind"]), both(b["before"], b["core"])), "behind": b["behind"], "last": b["last"]}
    elif a["full"]:
        out |= {"before": a["before"], "core": a["core"], "behind": both(a["behind"], b["before"]), "last": a["last"]}
    else:
        out |= {"before": both(a["before"], b["before"]), "core": b["core"], "behind": b["behind"], "last": b["last"]}
    out["opening"] = (a["opening"] + b["head"])[:3] if a["full"] else b["opening"]
    return out


def _wide(points: list[int]) -> int:
    """Runs of two or more spaces that are not line breaks."""
    t = tables()["space"]
    kinds = "".join("s" if t[c] and c != 10 else "-" for c in points)
    return sum(len(x) > 1 for x in kinds.split("-"))


def _closed(parts: list[dict]) -> tuple[np.ndarray, list[int]]:
    """BY_LINE of lines that are now whole, and their hashes."""
    parts = [p for p in parts if p["full"]]
    if not parts:
        return np.zeros(len(BY_LINE), np.int64), []
    arrays = [np.array([p["opening"] + [10] * (3 - len(p["opening"])) for p in parts]), np.array([p["last"] for p in parts]), np.array([p["core"][1] for p in parts]), np.array([p["separators"] for p in parts]), np.array([p["leader"] for p in parts])]
    return by_line(*arrays).sum(0), mix(np.array([p["core"][0] for p in parts], np.uint64)).view(np.int64).tolist()


def counts(points: np.ndarray, offsets: np.ndarray, words: Vocabulary) -> np.ndarray:
    """A matrix of COUNTS by text, of whole texts."""
    v = View(points, offsets)
    out = np.zeros((v.rows, len(COUNTS)), np.int64)
    out[:, : len(LOCAL)] = local(v, words)
    cuts = np.flatnonzero((points == 10) | v.first[1:])
    lines = Lines(v, np.concatenate([[0], cuts[:-1] + 1])[: len(cuts)], cuts + (points[cuts] != 10))
    lines = Lines(v, lines.start[lines.full], lines.end[lines.full])
    if len(lines.start):
        last = lines.last
        of = v.row[lines.head]
        np.add.at(out[:, len(LOCAL) : len(LOCAL) + len(BY_LINE)], of, by_line(lines.opening(), points[last], last + 1 - lines.head, lines.separators, lines.leader))
        out[:, -2] = np.bincount(of[_repeats(of, v.hashes.of(lines.head, last + 1))], minlength=v.rows)
    places = np.flatnonzero(np.repeat(offsets[1:], np.diff(offsets)) - np.arange(v.n) >= GRAM)
    own = v.row[places]
    out[:, -1] = np.bincount(own[_repeats(own, v.hashes.of(places, places + GRAM))], minlength=v.rows)
    return out


def partial(points: np.ndarray, words: Vocabulary) -> dict:
    """Of one chunk: the counts of what it holds, its boundary state, and the hashes of its lines and sequences."""
    v = View(points, np.array([0, len(points)]))
    cuts = np.flatnonzero(points == 10)
    out = {"local": local(v, words)[0], "head": points[: words.reach], "tail": points[-words.reach :] if len(points) else points, "size": len(points)}
    edges = [0, *(cuts[:1].tolist() or [len(points)])], [*(cuts[-1:] + 1).tolist(), len(points)]
    ends = [(edges[0][0], edges[0][1])] + ([(edges[1][0], edges[1][1])] if len(cuts) else [])
    out["open"] = Lines(v, np.array([a for a, _ in ends]), np.array([b for _, b in ends])).parts()
    whole = Lines(v, cuts[:-1] + 1, cuts[1:])
    good = whole.full
    out["by_line"] = by_line(whole.opening()[good], points[whole.last[good]], (whole.last + 1 - whole.head)[good], whole.separators[good], whole.leader[good]).sum(0)
    out["line_hashes"] = np.unique(v.hashes.of(whole.head[good], whole.last[good] + 1)).view(np.int64).tolist()
    at = np.arange(max(0, len(points) - GRAM + 1))
    grams = np.sort(v.hashes.of(at, at + GRAM))
    out["gram_hashes"] = grams[np.concatenate([[True], grams[1:] != grams[:-1]])[: len(grams)]].view(np.int64).tolist()
    return out


def merged(a: dict, b: dict, words: Vocabulary) -> dict:
    """Two neighbours as one; of the hashes only those that the seam gives rise to."""
    sides = [a["tail"], b["head"]]
    seam = np.concatenate([*sides, np.concatenate(sides)])
    cut = np.cumsum([0, len(sides[0]), len(sides[1]), len(sides[0]) + len(sides[1])])
    part = local(View(seam, cut), words)
    out = {"local": a["local"] + b["local"] + part[2] - part[0] - part[1], "size": a["size"] + b["size"]}
    out["head"] = np.concatenate([a["head"], b["head"]])[: words.reach] if a["size"] < words.reach else a["head"]
    out["tail"] = np.concatenate([a["tail"], b["tail"]])[-words.reach :] if b["size"] < words.reach else b["tail"]
    middle = _join(a["open"][-1], b["open"][0])
    done, hashes = _closed([middle] if len(a["open"]) == 2 == len(b["open"]) else [])
    out["open"] = [*a["open"][:-1], *([middle] if len(a["open"]) + len(b["open"]) < 4 else []), *b["open"][1:]]
    out["by_line"] = a["by_line"] + b["by_line"] + done
    out["line_hashes"] = hashes
    near = lowered(np.concatenate([a["tail"][-(GRAM - 1) :], b["head"][: GRAM - 1]]))
    at = np.arange(max(0, len(near) - GRAM + 1))
    at = at[(at < len(a["tail"][-(GRAM - 1) :])) & (at + GRAM > len(a["tail"][-(GRAM - 1) :]))]
    out["gram_hashes"] = Hashes(near).of(at, at + GRAM).view(np.int64).tolist()
    return out


def finished(a: dict) -> tuple[np.ndarray, list[int]]:
    """LOCAL and BY_LINE of a text whose chunks are all merged, and the hashes of its outer lines."""
    done, hashes = _closed(a["open"])
    return np.concatenate([a["local"], a["by_line"] + done]), hashes


def _repeats(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which entries have an equal hash earlier within the same owner."""
    key = hashes ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[order[1:]] = key[order[1:]] == key[order[:-1]]
    return same


def ratio(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def statistics(df: DataFrame, key: str, text: str, words: list[str], chunk: int = CHUNK) -> DataFrame:
    """One row per key with the counts of its texts, ratios and ``kind`` (prose, list, table, junk; null where there is no visible character).

    Several rows of a key add up. A null text counts as empty; an empty table gives none. Other
    columns are not looked at. Texts of more than ``chunk`` bytes are cut into chunks.
    """
    vocabulary = Vocabulary(words)
    wanted = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("__text"))
    schema = T.StructType([wanted.schema["key"], *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "__text", 1 << 20):
            matrix = counts(*decode(batch.column("__text")), vocabulary)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(matrix[:, k]) for k in range(matrix.shape[1]))], names=["key", *COUNTS])

    size = F.octet_length("__text")
    short = wanted.where(F.coalesce(size, F.lit(0)) <= chunk).mapInArrow(run, schema)
    long = Stored(chunked(wanted.where(size > chunk), vocabulary, chunk))
    parts = short if long.rows.isEmpty() else short.unionByName(_huge(long.rows, vocabulary).select("key", *COUNTS))
    whole = parts.groupBy("key").agg(*(F.sum(c).alias(c) for c in COUNTS))
    return with_kind(whole).withColumnRenamed("key", key)


def chunked(texts: DataFrame, vocabulary: Vocabulary, chunk: int) -> DataFrame:
    """The texts cut into chunks, which are spread over tasks, each with its partial counts: key, text_no, no, state, line_hashes, gram_hashes."""
    numbered = texts.withColumn("text_no", F.monotonically_increasing_id())
    cut_schema = T.StructType([texts.schema["key"], T.StructField("text_no", T.LongType()), T.StructField("no", T.IntegerType()), T.StructField("piece", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "__text"):
            for k in range(batch.num_rows):
                data = memoryview(batch.column("__text")[k].as_buffer())
                edges = [0]
                while edges[-1] < len(data):
                    at = min(edges[-1] + max(chunk, 4), len(data))
                    while at < len(data) and data[at] & 0xC0 == 0x80:  # not within a character
                        at -= 1
                    edges.append(at)
                for first in range(0, len(edges) - 1, FAN):
                    some = list(zip(edges, edges[1:]))[first : first + FAN]
                    repeat = lambda c: pa.concat_arrays([batch.column(c).slice(k, 1)] * len(some))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([repeat("key"), repeat("text_no"), pa.array(range(first, first + len(some)), pa.int32()), pa.array([bytes(data[a:b]) for a, b in some], pa.binary())], names=cut_schema.names)

    return numbered.mapInArrow(cut, cut_schema).repartition("text_no", "no").mapInArrow(_states(vocabulary, lambda b: [partial(np.frombuffer(x.decode("utf-8").encode("utf-32-le"), np.uint32), vocabulary) for x in b.column("piece").to_pylist()]), _state_schema(texts.schema["key"]))


def _state_schema(key: T.StructField) -> T.StructType:
    return T.StructType([key, *T.StructType.fromDDL("text_no bigint, no int, state binary, line_hashes array<bigint>, gram_hashes array<bigint>").fields])


def _states(vocabulary: Vocabulary, of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FAN):
                part = batch.slice(at, FAN)
                yield _packed([part.column(n) for n in ("key", "text_no", "no")], of(part))

    return run


def _packed(columns: list[pa.Array], states: list[dict]) -> pa.RecordBatch:
    lists = [pa.array([s[n] for s in states], pa.list_(pa.int64())) for n in ("line_hashes", "gram_hashes")]
    slim = [pickle.dumps({k: v for k, v in s.items() if not k.endswith("hashes")}) for s in states]
    return pa.RecordBatch.from_arrays([*columns, pa.array(slim, pa.binary()), *lists], names=["key", "text_no", "no", "state", "line_hashes", "gram_hashes"])


def _huge(chunks: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """COUNTS of each text from the states of its chunks: merged as a tree, FAN at a time; what repeats by distinct hashes."""

    def level(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(groups)).sort_by("no").combine_chunks()  # at most FAN states, each of bounded size
        states = [pickle.loads(x) for x in rows.column("state").to_pylist()]  # noqa: S301 - written by this job
        lines, grams, whole = [], [], states[0]
        for s in states[1:]:
            whole = merged(whole, s, vocabulary)
            lines += whole["line_hashes"]
            grams += whole["gram_hashes"]
        whole |= {"line_hashes": lines, "gram_hashes": grams}
        yield _packed([rows.column("key").chunk(0).slice(0, 1), pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int32())], [whole])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [finished(pickle.loads(x)) for x in batch.column("state").to_pylist()]  # noqa: S301
            matrix = np.array([c for c, _ in ends], np.int64).reshape(len(ends), -1)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("text_no"), *(pa.array(matrix[:, k]) for k in range(matrix.shape[1])), pa.array([h for _, h in ends], pa.list_(pa.int64()))], names=["key", "text_no", *COUNTS[:-2], "line_hashes"])

    key = chunks.schema["key"]
    seen = lambda df, kind: df.select("text_no", F.lit(kind).alias("kind"), F.explode(f"{kind}_hashes").alias("h"))
    every = seen(chunks, "line").union(seen(chunks, "gram"))
    states, most = chunks.drop("line_hashes", "gram_hashes"), chunks.agg(F.max("no")).first()[0]
    while most > 0:
        up = Stored(states.select("key", "text_no", F.expr(f"no div {FAN}").cast("int").alias("group"), "no", "state").groupBy("text_no", "group").applyInArrow(level, _state_schema(key)))
        every = every.union(seen(up.rows, "line")).union(seen(up.rows, "gram"))
        states, most = up.rows.drop("line_hashes", "gram_hashes"), most // FAN
    last = Stored(states.mapInArrow(close, T.StructType([key, *T.StructType.fromDDL("text_no bigint, " + ", ".join(f"{c} bigint" for c in COUNTS[:-2]) + ", line_hashes array<bigint>").fields])))
    every = every.union(seen(last.rows, "line"))
    distinct = every.distinct().groupBy("text_no").agg(F.count_if(F.col("kind") == "line").alias("own_lines"), F.count_if(F.col("kind") == "gram").alias("own_grams"))
    both = last.rows.join(distinct, "text_no", "left")
    return both.withColumn("repeated_lines", F.col("lines") - F.coalesce("own_lines", F.lit(0))).withColumn("repeated_grams", F.col("grams") - F.coalesce("own_grams", F.lit(0)))


def with_kind(whole: DataFrame) -> DataFrame:
    ratios = {
        "mean_word_length": ratio("word_chars", "words"),
        "symbol_ratio": ratio("signs", "visible"),
        "odd_ratio": ratio("odd_signs", "visible"),
        "digit_ratio": ratio("digits", "visible"),
        "ended_share": ratio("ended_lines", "lines"),
        "short_share": ratio("short_chars", "visible"),
        "bullet_share": ratio("bullet_lines", "lines"),
        "repeated_line_share": ratio("repeated_lines", "lines"),
        "repeated_gram_share": ratio("repeated_grams", "grams"),
        "common_share": ratio("common", "words"),
        "rare_share": ratio("rare_han", "han"),
        "broken_share": ratio("broken", "visible"),
        "mark_rate": ratio("sentence_marks", "visible"),
        "single_share": ratio("single_pieces", "pieces"),
        "letter_share": ratio("word_chars", "visible"),
        "long_share": ratio("long_pieces_chars", "visible"),
        "item_rate": ratio("items", "visible"),
        "number_rate": ratio("numbers", "lines"),
    }
    out = whole.withColumns(ratios)
    even = F.lit(False)
    for s in SEPARATORS:  # most lines have the separator, about equally often
        mean, square = ratio(f"{s}_sum", "lines"), ratio(f"{s}_square", "lines")
        even |= (ratio(f"{s}_lines", "lines") >= 0.7) & (square - mean * mean <= 0.12 * mean * mean + 0.1)
    c = F.col
    marks_low = c("mark_rate") < 0.004
    junk = (
        ((c("lines") >= 4) & (c("repeated_line_share") >= 0.6))
        | (c("repeated_gram_share") >= 0.6)
        | (c("letter_share") < 0.35)
        | ((c("han") >= 20) & (c("rare_share") >= 0.25))
        | (c("broken_share") >= 0.05)
        | (c("long_share") >= 0.5)
    )
    table_rule = (c("lines") >= 2) & even & (c("number_rate") >= 1) & (c("mark_rate") < 0.006)
    code = c("odd_ratio") >= 0.03
    contents = (ratio("leader_lines", "lines") >= 0.6) & (c("lines") >= 2)
    items = (c("lines") >= 3) & (c("short_share") >= 0.7)
    chain = (c("item_rate") >= 0.08) & (c("lines") <= 3)
    list_rule = marks_low & (items | chain) | ((c("bullet_share") >= 0.7) & (c("lines") >= 3) & (c("mark_rate") < 0.012) & (ratio("visible", "lines") < 40))
    return out.withColumn("kind", F.when(c("visible") == 0, F.lit(None)).when(table_rule & (c("repeated_line_share") < 0.6), "table").when(contents, "list").when(junk | code, "junk").when(list_rule, "list").otherwise("prose"))
