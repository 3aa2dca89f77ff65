"""Text that was decoded with the wrong character encoding.

A hidden Markov model has one clean state and one state per pair of the encoding a text was
written in and the one it was read with. Each state emits characters given the kind of the
character before. The emissions are fitted by garbling the whole corpus itself in every way and
adding up the counts of all tasks; the clean state also expects, at a low rate, unusual but
rightly decoded characters (other widths, look-alike letters, invisible signs). Viterbi's
algorithm labels the characters, and each labelled span gets its state's inverse transform.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.codepoints import TOP, decode, sliced
from millrace.session import Stored, spread

ENTER, START, LEAVE = -9.0, -5.0, -3.0
#: A span with fewer characters outside ASCII is short. A short span that no inverse turns into characters of the corpus is one all the same if its gain pays for entering it twice.
SHORT, CERTAIN = 12, 18.0
#: Characters that a pair's emissions are fitted on, from which on they count more than the expectation that the pair does not occur.
FIRM = 500

SINGLE = ("cp1252", "latin-1", "cp1250", "cp1251", "koi8-r", "cp437", "cp850", "cp866", "mac_roman", "iso8859-15")
MULTI = ("gb18030", "big5", "shift_jis", "euc_kr", "euc_jp")
#: (written in, read with), and how often the same mistake was made.
PAIRS = (
    *(("utf-8", x, 1) for x in SINGLE),
    *(("utf-8", x, 1) for x in MULTI),
    ("utf-8", "cp1252", 2),
    ("utf-8", "latin-1", 2),
    *(("gb18030", x, 1) for x in ("latin-1", "cp1252", "utf-8", "big5", "shift_jis", "koi8-r", "cp1251", "cp437", "mac_roman", "euc_kr")),
    *(("big5", x, 1) for x in ("gb18030", "latin-1", "utf-8")),
    *(("shift_jis", x, 1) for x in ("gb18030", "latin-1", "utf-8")),
    ("utf-8", "lost", 1),  # replacement characters written out and read again with gb18030
)
#: The encodings that the texts were written in.
WRITTEN = tuple(dict.fromkeys(pair[0] for pair in PAIRS))


@lru_cache(None)
def byte_table(name: str) -> tuple[str, dict[str, int]]:
    """The character of each byte of a single-byte encoding; undefined bytes stand for themselves."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return "".join(chars), {c: b for b, c in enumerate(chars)}


def read(data: bytes, name: str) -> str:
    if name in SINGLE:
        points = np.array([ord(c) for c in byte_table(name)[0]], np.uint32)[np.frombuffer(data, np.uint8)]
        return points.tobytes().decode("utf-32-le", "replace")
    return data.decode(name, "replace")


def write(text: str, name: str, errors: str = "ignore") -> bytes:
    if name in SINGLE:
        inverse = byte_table(name)[1]
        if errors == "strict":
            return bytes([inverse[c] for c in text])
        return bytes([inverse[c] for c in text if c in inverse])
    return text.encode(name, errors)


def garble(text: str, pair: tuple[str, str, int]) -> str:
    true, wrong, times = pair
    for _ in range(times):
        if wrong == "lost":
            text = text.encode("gb18030", "ignore").decode("utf-8", "replace").encode("utf-8").decode("gb18030", "replace")
        else:
            text = read(write(text, true), wrong)
    return text


def restore(text: str, pair: tuple[str, str, int]) -> tuple[str, bool]:
    """The original and whether all of it came back; parts that were lost stay as they are."""
    true, wrong, times = pair
    if wrong == "lost":
        return text, False
    whole = True
    for _ in range(times):
        try:
            text = write(text, wrong, "strict").decode(true)
        except (UnicodeError, KeyError):
            whole = False
            text = write(text, wrong).decode(true, "replace")
    return text, whole


def restored_span(text: str, pair: tuple[str, str, int], known: frozenset[str], gain: float) -> tuple[str, bool, tuple[str, str, int]] | None:
    """The restored span, whether it is whole, and the pair used. Where the label's own inverse fails though reading loses nothing, the pair whose inverse succeeds. A short span must turn into characters that the corpus is written with, or have a gain that leaves no doubt: it is then kept as not restored."""
    out, whole = restore(text, pair)
    if pair[1] not in SINGLE:
        return out, whole, pair
    short = sum(c >= "\x80" for c in text) < SHORT

    def plausible(x: str) -> bool:
        foreign = [c in known for c in x if c >= "\x80"]
        return not short or not foreign or sum(foreign) >= 0.7 * len(foreign)

    if whole and plausible(out):
        return out, whole, pair
    for other in PAIRS:
        if other[1] in SINGLE and other != pair:
            again, good = restore(text, other)
            if good and again != text and plausible(again):
                return again, True, other
    if short:
        return (text, False, pair) if gain >= CERTAIN else None
    return out, False, pair


@lru_cache(1)
def kinds() -> np.ndarray:
    """0 ASCII but letters, 1 Latin signs and general punctuation, 2 other Latin letters, 3 Han, 4 CJK signs and kana, 5 other scripts, 6 figures and boxes, 7 not a character, 8 ASCII letter, 9 full-width form, 10 half-width kana, 11 Greek or Cyrillic."""
    out = np.full(TOP, 5, np.int8)
    out[:0x80] = 0
    out[0x41:0x5B] = out[0x61:0x7B] = 8
    out[0x80:0xC0] = out[0x2000:0x2190] = 1
    out[0xC0:0x250] = 2
    out[0x3400:0xA000] = out[0x20000:0x33480] = out[0xF900:0xFB00] = out[0x2E80:0x2FE0] = 3
    out[0x370:0x530] = 11
    out[0x3000:0x3400] = out[0xFF00:0xFFF0] = 4
    out[0xFF10:0xFF1A] = out[0xFF21:0xFF3B] = out[0xFF41:0xFF5B] = 9
    out[0xFF61:0xFFA0] = 10
    out[0x2190:0x2C00] = 6
    out[0xE000:0xF900] = out[0xFFF0:0x10000] = out[0xF0000:] = 7
    return out


KINDS = 12
#: Unusual characters of well decoded text, by the kind they belong to, and the share of the clean state that they have.
UNUSUAL = ((3, (*range(0x2F00, 0x2FD6), *range(0xF900, 0xFA6E))), (11, (*range(0x391, 0x3CA), *range(0x400, 0x460))), (9, (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B))), (10, range(0xFF61, 0xFFA0)), (1, (0xA0, 0xAD, *range(0x2000, 0x2010), 0x202F, 0x2060)), (7, (0xFEFF,)))
UNUSUAL_SHARE = 0.15


class Model:
    """``gain[state, kind of the character before, symbol]``: log of the emission over that of the clean state."""

    def __init__(self, points: np.ndarray, gain: np.ndarray):
        self.points, self.gain = points, gain.astype(np.float16)  # small to ship

    @lru_cache(1)  # noqa: B019 - one model lives in a worker
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbol of each character; the gains of all states by kind before and symbol; the most of each."""
        steps = np.ascontiguousarray(self.gain.reshape(len(self.gain), -1).T).astype(np.float32)
        return symbols(self.points), steps, steps.max(1)


def symbols(points: np.ndarray) -> np.ndarray:
    """A number for each character: 0 to 7 for ASCII and unseen ones of each kind, then the seen ones."""
    symbol = kinds().astype(np.int32)
    symbol[points] = np.arange(len(points)) + KINDS
    return symbol


def _chances(counts: np.ndarray) -> np.ndarray:
    """P(symbol | kind before); unseen symbols share the mass of new types, by kind of symbol."""
    total, types = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    spread = 0.5 * types / (total + types + 1) / np.maximum(counts.shape[1], 1)
    return np.maximum(counts / (total + types + 1), np.maximum(spread, 1e-8))


#: Characters, or bytes, that are counted at a time.
PIECE = 1 << 15
#: Put behind the last text, as readers look some bytes ahead: so a text counts the same wherever it stands.
AHEAD = "\n\n\n"


class Tally:
    """Counts over texts. Slot 0: how often each character follows each kind (kind << 16 | character; above U+FFFF the kind's unseen one). Slot 1 + k: the same of the texts garbled by ``PAIRS[k]``, each text with a line end behind it. What a single-byte encoding reads follows from how often each byte follows each byte (before << 8 | byte), so only that is counted, in slot -1 - t for ``WRITTEN[t]``."""

    SCHEMA = "slot int, part int, keys array<int>, counts array<bigint>"
    #: Keys of a row that is sent.
    WIDTH = 2048

    def __init__(self) -> None:
        self.slots: dict[int, np.ndarray] = {}

    def slot(self, number: int) -> np.ndarray:
        if number not in self.slots:
            self.slots[number] = np.zeros(KINDS << 16 if number >= 0 else 1 << 16, np.int64)
        return self.slots[number]

    def clean(self, points: np.ndarray, offsets: np.ndarray) -> None:
        self.slot(0)[:] += np.bincount(_pair_keys(points, offsets), minlength=KINDS << 16)

    def found(self, points: np.ndarray, offsets: np.ndarray, model: Model) -> list[int]:
        """Counts the spans that a model leaves no doubt about; the rows of all its spans."""
        spans = label(points, offsets, model, suspects(points, offsets, model))
        keys = _pair_keys(points, offsets) if spans else []
        for (row, start, end, _), gain in zip(spans, gain_of(points, offsets, model, spans)):
            at = slice(offsets[row] + start, offsets[row] + end)
            if gain >= CERTAIN and (points[at] >= 0x80).sum() >= SHORT:
                np.add.at(self.slot(0), keys[at], 1)
        return sorted({row for row, *_ in spans})

    def garbled(self, texts: list[str]) -> None:
        """All ways of garbling, over some texts at a time, so that what they become stays in the processor's cache."""
        group = np.cumsum([len(t) for t in texts]) // PIECE
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        for start, end in zip(cuts, cuts[1:]):
            self._garbled(texts[start:end])

    def _garbled(self, texts: list[str]) -> None:
        for t, true in enumerate(WRITTEN):
            fitting = texts if true in ("utf-8", "gb18030") else [x for x in texts if _writable(x, true)]
            if not fitting:
                continue
            text = "".join([*(x + "\n" for x in fitting), AHEAD])
            data = write(text, true)
            _count_bytes(data[: -len(AHEAD)], self.slot(-1 - t))
            for k, pair in enumerate(PAIRS):
                if pair[0] == true and pair[1] not in SINGLE:
                    out = garble(text, pair) if pair[1] == "lost" or pair[2] > 1 else read(data, pair[1])
                    _count(out[: -len(AHEAD)], self.slot(1 + k))

    def rows(self) -> pa.RecordBatch:
        """What is not zero, in rows of some neighbouring keys."""
        slots, parts, ends, keys, counts = [], [], [0], [], []
        for number, dense in self.slots.items():
            own = np.flatnonzero(dense)
            part, size = np.unique(own // self.WIDTH, return_counts=True)
            slots.append(np.full(len(part), number, np.int32))
            parts.append(part.astype(np.int32))
            ends += (ends[-1] + np.cumsum(size)).tolist()
            keys.append(own.astype(np.int32))
            counts.append(dense[own])
        joined = [np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((slots, np.int32), (parts, np.int32), (keys, np.int32), (counts, np.int64))]
        at = pa.array(ends, pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(joined[0]), pa.array(joined[1]), pa.ListArray.from_arrays(at, pa.array(joined[2])), pa.ListArray.from_arrays(at, pa.array(joined[3]))], names=["slot", "part", "keys", "counts"])

    def gather(self, batch: pa.RecordBatch) -> None:
        """Adds rows that another tally gave."""
        keys, counts = (batch.column(k).flatten().to_numpy() for k in (2, 3))
        ends = np.cumsum(batch.column(2).value_lengths().to_numpy())
        for number, start, end in zip(batch.column(0).to_pylist(), [0, *ends], ends):
            self.slot(number)[keys[start:end]] += counts[start:end]  # the keys of a row are distinct

    def less(self, other: Tally) -> Tally:
        out = Tally()
        out.slots = {k: x - other.slots[k] if k in other.slots else x for k, x in self.slots.items()}
        return out

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of the texts (0) or of those garbled by ``PAIRS[k - 1]``."""
        dense = self.slots.get(k)
        if k and PAIRS[k - 1][1] in SINGLE and (follow := self.slots.get(-1 - WRITTEN.index(PAIRS[k - 1][0]))) is not None:
            dense = _read_singly(follow, PAIRS[k - 1])
        keys = np.zeros(0, np.int64) if dense is None else np.flatnonzero(dense)
        return keys, np.zeros(0, np.int64) if dense is None else dense[keys]


def _count(text: str, into: np.ndarray) -> None:
    """How often each character follows each kind, with a line end before the first."""
    shifted, last = _shifted_kinds(), 0
    for i in range(0, len(text), PIECE):
        part = text[i : i + PIECE]
        points = np.frombuffer(part.encode("utf-16-le", "surrogatepass"), np.uint16)
        if len(points) > len(part):
            points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = shifted[points]
        keys = np.empty(len(points), np.int64)
        keys[0], keys[1:], last = last, kind[:-1], kind[-1]
        keys += np.minimum(points, 0xFFFF)
        np.add.at(into, keys, 1)


def _count_bytes(data: bytes, into: np.ndarray) -> None:
    """How often each byte follows each byte, with a line end before the first."""
    every = np.frombuffer(b"\n" + data, np.uint8)
    for i in range(0, len(data), PIECE):
        part = every[i : i + PIECE + 1].astype(np.int64)
        np.add.at(into, part[:-1] << 8 | part[1:], 1)


def _read_singly(follow: np.ndarray, pair: tuple[str, str, int]) -> np.ndarray:
    """How often each character follows each kind, if each byte is read as a character; for more than one time, if each of these is garbled again."""
    true, wrong, times = pair
    spelt = [read(bytes([b]), wrong) for b in range(256)]
    for _ in range(times - 1):
        spelt = [read(write(x, true), wrong) for x in spelt]
    points = [np.array([ord(c) for c in x]) for x in spelt]
    kind, follow = kinds().astype(np.int64), follow.reshape(256, 256)
    out = np.zeros(KINDS << 16, np.int64)
    first, last = np.array([x[0] for x in points]), np.array([x[-1] for x in points])
    np.add.at(out, (kind[last][:, None] << 16) + first, follow)
    for x, n in zip(points, follow.sum(0)):
        np.add.at(out, (kind[x[:-1]] << 16) + x[1:], n)
    return out


@lru_cache(1)
def _shifted_kinds() -> np.ndarray:
    return kinds().astype(np.int64) << 16


def fit(texts: list[str]) -> Model:
    """Fitted on texts that may themselves be garbled here and there. Texts found garbled by a first fit are left out of those that are garbled for the second, as garbling can undo itself; the clean state keeps all but the long and certain spans, else it would learn the garbled characters of a large corpus."""
    texts = [t for t in texts if t]
    flat, every, bad = _flat(texts), Tally(), Tally()
    every.clean(*flat)
    every.garbled(texts)
    bad.garbled([texts[row] for row in bad.found(*flat, _fit(every))])
    return _fit(every.less(bad))


def train(df: DataFrame, key: str, paragraphs: str) -> Model:
    """``fit`` on the entries of all records, whatever their ``key``: each task counts its own, and the counts are added up; no text goes to the driver."""
    lists = spread(df.select(paragraphs))
    every = _tallied(lists)
    return _fit(every.less(_tallied(lists, _fit(every))))


def _tallied(lists: DataFrame, first: Model | None = None) -> Tally:
    """The counts of all entries; with a model, of the spans it is certain about and the garbled forms of the entries that it finds garbled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in sliced(batches, lambda b: b.nbytes):
            values = batch.column(0).flatten().cast(pa.string())
            flat = decode(values)
            if first is None:
                tally.clean(*flat)
            else:
                values = values.take(pa.array(tally.found(*flat, first), pa.int64()))
            tally.garbled([t for t in values.to_pylist() if t])
        yield tally.rows()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            tally.gather(batch)
        yield tally.rows()

    out = Tally()
    for batch in lists.mapInArrow(count, Tally.SCHEMA).repartition("slot", "part").mapInArrow(add, Tally.SCHEMA).toArrow().to_batches():  # a number for each key at most, however large the corpus
        out.gather(batch)
    return out


def _fit(tally: Tally) -> Model:
    counted = [tally.of(k) for k in range(len(PAIRS) + 1)]
    seen = np.unique(np.concatenate([*(np.unique(k & 0xFFFF) for k, _ in counted), *(np.array(list(r)) for _, r in UNUSUAL)])).astype(np.uint32)
    seen = seen[seen >= 0x80]
    symbol, n = symbols(seen), len(seen) + KINDS
    expected = np.log(_chances(_table(*counted[0], symbol, n)) * (1 - UNUSUAL_SHARE) + UNUSUAL_SHARE * _unusual(symbol, n)).astype(np.float32)
    gain = np.empty((len(PAIRS), KINDS, n), np.float16)
    for k, (keys, counts) in enumerate(counted[1:]):
        own = np.clip(np.log(_chances(_table(keys, counts, symbol, n))) - expected, -9, 9)
        weight = counts.sum() / (counts.sum() + FIRM)
        gain[k] = weight * own + (1 - weight) * -1
    for a in (0, 8):
        gain[:, a, [0, 8]] = -0.02  # ASCII after ASCII tells nothing
    return Model(seen, gain)


def gain_of(points: np.ndarray, offsets: np.ndarray, model: Model, spans: list[tuple[int, int, int, int]]) -> list[float]:
    """What each span's state explains better than the clean one."""
    symbol, steps, _ = model.tables()
    keys = _keys(points, offsets, symbol, len(steps) // KINDS)
    return [float(steps[keys[offsets[row] + start : offsets[row] + end], pair].sum()) for row, start, end, pair in spans]


def _pair_keys(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The kind before each character and the character: kind << 16 | character; above U+FFFF the kind's unseen one."""
    kind = kinds()[points].astype(np.int32)
    before = np.zeros(len(points), np.int32)
    before[1:] = kind[:-1]
    before[offsets[:-1][offsets[:-1] < len(points)]] = 0
    return before << 16 | np.where(points < 0x10000, points, 0xFFFF).astype(np.int32)


def _table(keys: np.ndarray, counts: np.ndarray, symbol: np.ndarray, n: int) -> np.ndarray:
    return np.bincount((keys >> 16) * n + symbol[keys & 0xFFFF], counts, KINDS * n).reshape(KINDS, n)


def _writable(text: str, name: str) -> bool:
    try:
        text.encode(name)
    except UnicodeError:
        return False
    return True


def _unusual(symbol: np.ndarray, n: int) -> np.ndarray:
    """After any character: ASCII, more of the same kind, or another unusual character."""
    out = np.zeros((KINDS, n))
    out[:, 0], out[:, 8] = 0.15, 0.15
    for kind, points in UNUSUAL:
        at = symbol[np.array(list(points))]
        out[:, at] += 0.2 / len(UNUSUAL) / len(at)
        out[kind, at] += 0.5 / len(at)
    return out


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def _keys(points: np.ndarray, offsets: np.ndarray, symbol: np.ndarray, n: int) -> np.ndarray:
    kind = kinds()[points]
    before = np.zeros(len(points), np.int32)
    before[1:] = kind[:-1]
    starts = offsets[:-1]
    before[starts[starts < len(points)]] = 0
    return before * n + symbol[points]


def suspects(points: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Rows whose best path can leave the clean state: some stretch, each character with the most that any state gains there, pays for entering. All others are clean for certain."""
    symbol, steps, best = model.tables()
    if not len(points):
        return np.zeros(0, np.int64)
    gain = best[_keys(points, offsets, symbol, len(steps) // KINDS)].astype(np.float64)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    starts = offsets[:-1][size > 0]
    total, swing = np.zeros(len(points) + 1), np.zeros(len(points) + 1)
    np.cumsum(gain, out=total[1:])
    gain = np.abs(gain)
    gain[starts] += START - ENTER
    np.cumsum(gain, out=swing[1:])
    lower = (swing[offsets[:-1]] + swing[offsets[1:]])[row]  # puts each row below all that is before it, so that a minimum so far is one of the row
    before = total[:-1] - lower
    before[starts] -= START - ENTER
    gained = total[1:] - lower - np.minimum.accumulate(before)
    return np.unique(row[gained > -ENTER - 1e-3])


def label(points: np.ndarray, offsets: np.ndarray, model: Model, rows: np.ndarray, room: int = 60_000) -> list[tuple[int, int, int, int]]:
    """(row, start, end, pair) of each span outside the clean state, by Viterbi's algorithm over many rows at once."""
    symbol, flat, _ = model.tables()
    states = flat.shape[1]
    keys = _keys(points, offsets, symbol, len(flat) // KINDS)
    size = np.diff(offsets)[rows]
    order = rows[np.argsort(size, kind="stable")]
    out: list[tuple[int, int, int, int]] = []
    at = 0
    while at < len(order):
        group = 1
        while at + group < len(order) and (group + 1) * int(offsets[order[at + group] + 1] - offsets[order[at + group]]) <= room:
            group += 1
        part = order[at : at + group]
        at += group
        length = (offsets[part + 1] - offsets[part]).astype(np.int64)
        wide = int(length.max())
        place = offsets[part][:, None] + np.minimum(np.arange(wide), np.maximum(length - 1, 0)[:, None])
        key = keys[place]
        inside = np.arange(wide) < length[:, None]
        clean = np.zeros(group)
        garbled = np.full((group, states), START)
        came_in = np.zeros((wide, group, states), bool)
        came_out = np.full((wide, group), -1, np.int16)
        for t in range(wide):
            step = flat[key[:, t]]
            leave = garbled.argmax(1)
            left = garbled[np.arange(group), leave] + LEAVE
            enter = clean[:, None] + ENTER
            out_now, in_now = left > clean, enter > garbled
            live = inside[:, t]
            new_garbled = np.where(in_now, enter, garbled) + step
            new_clean = np.where(out_now, left, clean)
            if t == 0:
                new_garbled, new_clean = garbled + step, clean.copy()
                in_now[:], out_now[:] = False, False
            came_in[t] = in_now
            came_out[t] = np.where(out_now, leave, -1)
            garbled = np.where(live[:, None], new_garbled, garbled)
            clean = np.where(live, new_clean, clean)
        for b, row in enumerate(part):
            state = int(garbled[b].argmax())
            if clean[b] >= garbled[b, state]:
                state = -1
            end = int(length[b])
            for t in range(int(length[b]) - 1, -1, -1):
                if state < 0:
                    state = int(came_out[t, b])
                    if state >= 0:
                        end = t
                elif came_in[t, b, state]:
                    out.append((int(row), t, end, state))
                    state = -1
            if state >= 0:
                out.append((int(row), 0, end, state))
    return out


def garbled_paragraphs(df: DataFrame, key: str, paragraphs: str, model: Model | None = None) -> DataFrame:
    """One row per affected entry of a list of texts: key, para_no (0-based), restored, whole, encodings.

    ``restored`` has the inverse transform of each labelled span and all else unchanged; ``whole``
    tells whether every span came back without loss. Null lists and entries are not affected.
    Repeated rows count once; other columns are not looked at.
    """
    model = model or train(df, key, paragraphs)
    found = Stored(labelled(df, key, paragraphs, model))
    seen = found.rows.where("chars is not null").select(F.explode(F.arrays_zip("chars", "counts")).alias("c")).groupBy("c.chars").agg(F.sum("c.counts").alias("n")).where("n > 1")
    known = frozenset(chr(r.chars) for r in seen.collect())  # at most as many as there are characters
    schema = f"`{key}` string, para_no int, restored string, whole boolean, encodings string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, restored, whole, names = [], [], [], []
            for k, (text, spans) in enumerate(zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())):
                parts, done, at, used = [], True, 0, set()
                for span in sorted(spans, key=lambda s: s["start"]):
                    start, end = span["start"], span["end"]
                    if (fixed := restored_span(text[start:end], PAIRS[span["pair"]], known, span["gain"])) is not None:
                        parts += [text[at:start], fixed[0]]
                        done, at = done and fixed[1], end
                        used.add("x".join(map(str, fixed[2])) if fixed[2][2] > 1 else ">".join(fixed[2][:2]))
                if used:
                    good.append(k)
                    restored.append("".join([*parts, text[at:]]))
                    whole.append(done)
                    names.append(",".join(sorted(used)))
            rows = batch.take(pa.array(good, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(restored, pa.string()), pa.array(whole, pa.bool_()), pa.array(names, pa.string())], names=[key, "para_no", "restored", "whole", "encodings"])

    return found.rows.where("chars is null").select(key, "para_no", "text", "spans").mapInArrow(run, schema).distinct()


def labelled(df: DataFrame, key: str, paragraphs: str, model: Model) -> DataFrame:
    """The entries with labelled spans; and, in rows of their own, the characters of those that are clean for certain and their counts."""
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("pair", pa.int32()), ("gain", pa.float32())]))
    schema = f"`{key}` string, para_no int, text string, spans array<struct<start: int, end: int, pair: int, gain: float>>, chars array<int>, counts array<bigint>"
    names = [key, "para_no", "text", "spans", "chars", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TOP, np.int64)
        for batch in sliced(batches, lambda b: b.nbytes):
            lists = batch.column(1)
            values = lists.flatten().cast(pa.string())
            counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            parent = np.repeat(np.arange(batch.num_rows), counts)
            first = np.cumsum(counts) - counts
            points, offsets = decode(values)
            doubtful = suspects(points, offsets, model)
            clean = np.ones(len(values), bool)
            clean[doubtful] = False
            total += np.bincount(points[np.repeat(clean, np.diff(offsets))], minlength=TOP)
            spans: dict[int, list[dict]] = {}
            found = label(points, offsets, model, doubtful)
            for (row, start, end, pair), gain in zip(found, gain_of(points, offsets, model, found)):
                spans.setdefault(row, []).append({"start": start, "end": end, "pair": pair, "gain": gain})
            at = np.array(sorted(spans), np.int64)
            owner = parent[at] if len(at) else at
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array((at - first[owner]).astype(np.int32)), values.take(pa.array(at)), pa.array([spans[r] for r in at.tolist()], spans_type), pa.nulls(len(at), pa.list_(pa.int32())), pa.nulls(len(at), pa.list_(pa.int64()))], names=names)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, spans_type), pa.array([seen.tolist()], pa.list_(pa.int32())), pa.array([total[seen].tolist()], pa.list_(pa.int64()))], names=names)

    return df.select(F.col(key).cast("string").alias(key), paragraphs).mapInArrow(run, schema)


def restored_texts(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """The texts with an affected line, restored: key, restored, whole. Null texts are not affected; repeated rows count once, and a key with several texts has a row for each."""
    own = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).distinct().withColumn("own", F.concat_ws(":", F.xxhash64("text").cast("string"), F.col("key").cast("string")))
    lines = own.withColumn("lines", F.split("text", "\n"))
    bad = garbled_paragraphs(lines, "own", "lines", model)
    mended = bad.groupBy("own").agg(F.map_from_entries(F.collect_list(F.struct("para_no", "restored"))).alias("mended"), F.bool_and("whole").alias("whole"))  # the lines of one text
    joined = lines.join(mended, "own")
    return joined.select(F.col("key").alias(key), F.array_join(F.transform("lines", lambda x, i: F.coalesce(F.element_at("mended", i.cast("int")), x)), "\n").alias("restored"), "whole")
