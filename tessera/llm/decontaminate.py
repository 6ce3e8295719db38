"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

Texts are compared lower-cased (each character whose lower case has as many UTF-8
bytes), with every run of other ASCII characters than letters and digits as one space. A part of a benchmark item counts as a leak from WORDS
whole words or LONGEST bytes on, so an item is searched as windows of that size
from each of its words on, and as wider ones that forgive more edits in one
place. A window of m characters within e edits shares
at least m - q + 1 - q * e of its q-grams with the place, and all of them lie in
a band of e + 1 diagonals. So shared q-grams are counted in overlapping diagonal
bands, the regions that reach the bound are kept, and a banded alignment decides.

The benchmark is a stated query set: it goes to the workers in parts of bounded
size, and every part is held against every whole text.

Items of fewer than Q bytes have no q-gram; they are found where they stand
exactly, between word borders.

Defined results: null and empty texts hold nothing; null items and items without
a letter or digit are not searched; repeated rows and items are each reported; further columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import scan
from tessera.llm.scan import U, extend, utf8
from tessera.runtime import Scratch, ship, table

Q = 10
WINDOW, STEP = 128, 64
#: The shortest excerpt that counts as a leak has so many whole words; of longer words, so many bytes.
WORDS, LONGEST = 13, 96
#: Bytes between excerpts that begin within a long word, as in text without spaces.
STRIDE = 16
#: Edits allowed, as a share of a window's characters.
EDITS = 0.08
#: Bytes of benchmark text that go to the workers at once; an index has some 60 times as many.
PART = 1 << 19
#: Bytes of text that a worker searches at once; its arrays are some hundred times as large.
BLOCK = 1 << 18
_BITS = 22


def normalise(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Comparable bytes, the place of each in ``buf``, and the texts' new offsets."""
    word = scan.ALNUM[buf]
    before = np.zeros(len(buf), bool)
    before[1:] = word[:-1]
    inner = off[1:-1]
    before[inner[inner < len(buf)]] = False
    at = np.flatnonzero(word | before)
    low = _lowered(buf)
    low = np.where(word, low, 0x20).astype(np.uint8)
    return low[at], at, np.searchsorted(at, off)


@lru_cache(1)
def _lower_points() -> np.ndarray:
    """Of each code point below 0x20000: its lower case, if that is one character of as many UTF-8 bytes, else itself."""
    out = np.arange(0x20000, dtype=np.uint32)
    for i in range(0x80, 0x20000):
        if not 0xD800 <= i < 0xE000:
            c = chr(i).lower()
            if len(c) == 1 and ord(c) != i and len(c.encode()) == len(chr(i).encode()):
                out[i] = ord(c)
    return out


def _lowered(buf: np.ndarray) -> np.ndarray:
    """UTF-8 bytes in lower case, each character in its place."""
    out = scan.LOWER[buf]
    for lead, mask, size in ((0xC0, 0x1F, 2), (0xE0, 0x0F, 3), (0xF0, 0x07, 4)):
        at = np.flatnonzero((buf & (0xFF ^ mask)) == lead)
        if not len(at):
            continue
        cp = (buf[at] & mask).astype(np.uint32)
        for k in range(1, size):
            cp = cp << 6 | buf[at + k] & 0x3F
        cp = np.where(cp < 0x20000, _lower_points()[np.minimum(cp, 0x1FFFF)], cp)
        for k in range(size - 1, 0, -1):
            out[at + k] = 0x80 | cp & 0x3F
            cp = cp >> 6
        out[at] = lead | cp
    return out


def grams(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q bytes from each place on."""
    n = len(b) - Q + 1
    if n <= 0:
        return np.zeros(0, U)
    x = b.astype(U)
    two = x[:-1] | x[1:] << U(8)
    four = two[:-2] | two[2:] << U(16)
    eight = four[:-4] | four[4:] << U(32)
    return scan.mix(eight[:n] * U(0x9E3779B97F4A7C15) + two[8 : 8 + n] * U(0xD6E8FEB86659FD93))


def _runs(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of n[0], n[1], ... places, one after another: the run of each place, and its number in the run."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _excerpts(t: bytes) -> list[tuple[int, int]]:
    """(start, end) of the shortest parts of an item that are searched; both rise."""
    space = np.flatnonzero(np.frombuffer(t, np.uint8) == 0x20)
    begins, ends = [0, *(space + 1).tolist()], [*space.tolist(), len(t)]
    out = []
    for i, (s, e) in enumerate(zip(begins, ends, strict=True)):
        stop = ends[min(i + WORDS, len(ends)) - 1]
        for a in range(s, e, STRIDE):  # only words beyond STRIDE bytes have several
            out.append((a, min(stop, a + LONGEST)))
            if out[-1][1] == len(t):
                # The last one reaches back to its full length.
                first = min(begins[max(len(begins) - WORDS, 0)], a)
                out[-1] = (max(first, len(t) - LONGEST), len(t))
                return out if len(out) < 2 or out[-2] < out[-1] else [x for x in out[:-1] if x[0] < out[-1][0]] + out[-1:]
    return out


@dataclass
class Index:
    """The windows of a part of the benchmark, and where each q-gram occurs in its items."""

    items: list[tuple[int, bytes]]

    def __post_init__(self):
        long = [(i, t) for i, (_, t) in enumerate(self.items) if len(t) >= Q]
        self.bytes = np.frombuffer(b"".join(t for _, t in long), np.uint8)
        self.base = np.concatenate([[0], np.cumsum([len(t) for _, t in long])]).astype(np.int64)
        number, start, size, wide = [], [], [], []
        for n, (_, t) in enumerate(long):
            m = len(t)
            spans = [(a, z, False) for a, z in _excerpts(t)]
            if m > WINDOW + STEP // 2:
                spans += [(a, a + WINDOW, True) for a in [*range(0, m - WINDOW, STEP), m - WINDOW]]
            elif spans != [(0, m, False)]:
                spans.append((0, m, True))
            number += [n] * len(spans)
            start += [x[0] for x in spans]
            size += [x[1] - x[0] for x in spans]
            wide += [x[2] for x in spans]
        self.number, self.start, self.size, self.wide = np.array(number, np.int64), np.array(start, np.int64), np.array(size, np.int64), np.array(wide, bool)
        self.item = [long[n][0] for n in number]
        edits = (self.size * EDITS).astype(np.int64)
        self.edits = np.maximum(np.minimum(edits, (self.size - Q) // Q), 0)
        self.least = self.size - Q + 1 - Q * self.edits
        with np.errstate(over="ignore"):
            each = [grams(np.frombuffer(t, np.uint8)) for _, t in long]
        g = np.concatenate([np.zeros(0, U), *each])
        place = np.stack([np.repeat(np.arange(len(long)), [len(x) for x in each]), np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x in each)])]).astype(np.int64)
        order = np.argsort(g, kind="stable")
        self.place = place[:, order]
        self.gram, self.first, self.count = np.unique(g[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.gram >> U(64 - _BITS)).astype(np.int64)] = True
        # Short and wide windows are counted apart, each in bands as broad as their edits ask for.
        self.kinds = []
        for kind in (False, True):
            w = np.flatnonzero(self.wide == kind)
            if len(w):
                lowest = np.full(len(long), 1 << 40)
                np.minimum.at(lowest, self.number[w], self.least[w])
                self.kinds.append((w, int(self.edits[w].max()) + 1, lowest))
        longest = int(np.diff(self.base).max(initial=0))
        self.span = longest + 1
        self.gap = longest + 4 * max((half for _, half, _ in self.kinds), default=1)
        # Items below Q bytes, by length: their texts in order, and the items of each.
        self.short = []
        tiny: dict[bytes, list[int]] = {}
        for i, (_, t) in enumerate(self.items):
            if 0 < len(t) < Q:
                tiny.setdefault(t, []).append(i)
        for n in sorted({len(t) for t in tiny}):
            texts = sorted(t for t in tiny if len(t) == n)
            code = self._code(np.array([list(t) for t in texts], np.uint8))
            order = np.argsort(code, kind="stable")
            self.short.append((n, code[order], np.array([list(texts[k]) for k in order], np.uint8), [tiny[texts[k]] for k in order]))

    @property
    def text(self) -> list[np.ndarray]:
        return [self.bytes[a : a + n] for a, n in zip((self.base[self.number] + self.start).tolist(), self.size.tolist(), strict=True)]

    @staticmethod
    def _code(rows: np.ndarray) -> np.ndarray:
        """A number for each row of fewer than Q bytes; up to 8 bytes, its own."""
        out = np.zeros(len(rows), U)
        with np.errstate(over="ignore"):
            for j in range(rows.shape[1]):
                out = (out << U(8) | out >> U(56)) ^ rows[:, j].astype(U)
        return out

    def search(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) for each window found; start and end are bytes of the text."""
        b, at, to = normalise(buf, off)
        return self._exact(b, at, to, off) + self._near(b, at, to, off)

    def _exact(self, b, at, to, off):
        """The items below Q bytes, between word borders."""
        if not self.short or not len(b):
            return []
        edge = np.zeros(len(b) + 1, bool)  # where a word may begin, or end before
        edge[to] = True
        begin, end = edge.copy(), edge
        begin[1:] |= b == 0x20
        end[:-1] |= b == 0x20
        begin = np.flatnonzero(begin[:-1] & (b != 0x20))
        doc = np.searchsorted(to, begin, side="right") - 1
        out = []
        for n, code, texts, items in self.short:
            ok = begin + n <= to[doc + 1]
            pos, of = begin[ok], doc[ok]
            ok = end[pos + n]
            pos, of = pos[ok], of[ok]
            rows = b[pos[:, None] + np.arange(n)]
            h = self._code(rows)
            # Nine bytes may share a number with others: all that do are compared.
            lo, hi = np.searchsorted(code, h, side="left"), np.searchsorted(code, h, side="right")
            who, nth = _runs(hi - lo)
            which = lo[who] + nth
            ok = (rows[who] == texts[which]).all(axis=1)
            for i, k in zip(who[ok].tolist(), which[ok].tolist(), strict=True):
                first, last = int(at[pos[i]] - off[of[i]]), int(at[pos[i] + n - 1] - off[of[i]]) + 1
                out += [(int(of[i]), x, first, last, 0) for x in items[k]]
        return out

    def _near(self, b, at, to, off):
        """The windows of all other items, within their edits."""
        if not len(self.gram):
            return []
        with np.errstate(over="ignore"):
            h = grams(b)
        pos = np.flatnonzero(self.maybe[(h >> U(64 - _BITS)).astype(np.int64)])
        row = np.minimum(np.searchsorted(self.gram, h[pos]), len(self.gram) - 1)
        ok = self.gram[row] == h[pos]
        pos, row = pos[ok], row[ok]
        doc = np.searchsorted(to, pos, side="right") - 1
        ok = pos + Q <= to[doc + 1]
        pos, row, doc = pos[ok], row[ok], doc[ok]
        # Texts with fewer hits than any window needs are out.
        ok = np.bincount(doc, minlength=len(off))[doc] >= self.least.min()
        pos, row, doc = pos[ok], row[ok], doc[ok]
        if not len(pos):
            return []
        each, nth = _runs(self.count[row])
        number, inside = self.place[:, self.first[row][each] + nth]
        # Diagonals of the item, with a gap between texts so that no band holds two.
        diagonal = pos[each] + doc[each] * self.gap - inside + self.gap
        of = doc[each]
        out = []
        for windows, half, lowest in self.kinds:
            out += self._bands(b, to, windows, half, lowest, number, inside, diagonal, of, at, off)
        return out

    def _bands(self, b, to, windows, half, lowest, number, inside, diagonal, of, at, off):
        """Counts shared q-grams in bands of 2 * half diagonals, each half over the next, and aligns the windows that reach their bound."""
        bins = int(diagonal.max()) // half + 2
        key = number * bins + diagonal // half
        order = np.argsort(key, kind="stable")
        bin_, cut, n = np.unique(key[order], return_index=True, return_counts=True)
        # A band is a bin and the next, or begins one before where that one is empty.
        follows = np.zeros(len(bin_), bool)
        follows[:-1] = (bin_[1:] == bin_[:-1] + 1) & (bin_[1:] // bins == bin_[:-1] // bins)
        both = n + np.where(follows, np.append(n[1:], 0), 0)
        band = np.flatnonzero(both >= lowest[bin_ // bins])
        if not len(band):
            return []
        # The hits of a bin and the next lie one after another.
        who, nth = _runs(both[band])
        hit = order[cut[band][who] + nth]
        place = np.sort(who * self.span + inside[hit])
        item, doc = bin_[band] // bins, of[order[cut[band]]]
        # Windows of the item with a q-gram between the band's first and last.
        ends = np.cumsum(both[band])
        low, high = place[ends - both[band]] % self.span, place[ends - 1] % self.span
        starts = self.number[windows] * self.span + self.start[windows]
        stops = starts + self.size[windows] - Q
        a = np.maximum(np.searchsorted(stops, item * self.span + low), np.searchsorted(starts, item * self.span))
        z = np.searchsorted(starts, item * self.span + high, side="right")
        who, nth = _runs(np.maximum(z - a, 0))
        w = windows[a[who] + nth]
        from_ = who * self.span + self.start[w]
        count = np.searchsorted(place, from_ + self.size[w] - Q, side="right") - np.searchsorted(place, from_)
        ok = count >= self.least[w]
        who, w, whole = who[ok], w[ok], (count >= self.size[w] - Q + 1)[ok]
        # The band's first diagonal, in places of b, at the window's start.
        low = (bin_[band] % bins)[who] * half - self.gap - doc[who] * self.gap + self.start[w]
        out = []
        for i in range(0, len(w), 4096):
            s = slice(i, i + 4096)
            out += self._align(b, to, half, w[s], doc[who[s]], low[s], whole[s], at, off)
        return out

    def _align(self, b, to, half, window, doc, low, whole, at, off):
        """Least edits of each window against its band, free to begin and end anywhere in it.

        ``whole`` tells windows of which the band has every q-gram: those stand there as they are, as a rule, and are looked for first.
        """
        size, most = self.size[window], int(self.size[window].max())
        width = 4 * half
        begin = low - half
        inner = np.arange(most)
        pattern = self.bytes[np.minimum((self.base[self.number[window]] + self.start[window])[:, None] + inner, len(self.bytes) - 1)]
        pattern = np.where(inner < size[:, None], pattern, 254)
        cols = begin[:, None] + np.arange(most + width)
        ok = (cols >= to[doc][:, None]) & (cols < to[doc + 1][:, None])
        region = np.where(ok, b[np.clip(cols, 0, len(b) - 1)], 255).astype(np.uint8)
        best, end, start = np.full(len(window), most + 1), np.zeros(len(window), np.int64), np.zeros(len(window), np.int64)
        same = np.flatnonzero(whole)
        pattern, beyond = pattern.astype(np.uint8), inner >= size[:, None]
        for j in range(width):
            if not len(same):
                break
            there = ((region[same, j : j + most] == pattern[same]) | beyond[same]).all(axis=1)
            best[same[there]], start[same[there]], end[same[there]] = 0, j, j + size[same[there]]
            same = same[~there]
        todo = np.flatnonzero(best > 0)
        if len(todo):
            best[todo], start[todo], end[todo] = _least_edits(pattern[todo], region[todo], size[todo], self.edits[window[todo]], width)
        out = []
        for i in np.flatnonzero(best <= self.edits[window]):
            first, last = int(begin[i] + start[i]), int(begin[i] + end[i]) - 1
            first, last = max(first, int(to[doc[i]])), min(max(last, first), int(to[doc[i] + 1]) - 1)
            out.append((int(doc[i]), self.item[window[i]], int(at[first] - off[doc[i]]), int(at[last] - off[doc[i]]) + 1, int(best[i])))
        return out


def _least_edits(pattern: np.ndarray, region: np.ndarray, size: np.ndarray, allowed: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of each pattern against the diagonals of its region, row by row; those beyond the edits allowed are given up.

    All windows take a row at once: a row's cells lie one after another, and each cell's windows side by side.
    """
    rows, most = pattern.shape
    cells = np.arange(width, dtype=np.int16)[:, None]
    d = np.zeros((width, rows), np.int16)
    where = np.broadcast_to(cells, d.shape).copy()  # where the alignment began, less its row
    best, end, start = np.full(rows, most + 1), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    region, pattern = np.ascontiguousarray(region.T), np.ascontiguousarray(pattern.T)
    row = np.arange(rows)  # of each column that is still worked on
    skip, moved = np.empty_like(d), np.empty_like(where)
    for i in range(most + 1):
        done = np.flatnonzero(size[row] == i)
        if len(done):
            j = d[:, done].argmin(axis=0)
            best[row[done]], end[row[done]], start[row[done]] = d[j, done], j + i, where[j, done]
        if i % 4 == 0 and i:
            on = (d.min(axis=0) <= allowed[row]) & (size[row] > i)
            if on.sum() < 0.8 * len(row):
                row, d, where, region, pattern = row[on], d[:, on], where[:, on], region[:, on], pattern[:, on]
                skip, moved = np.empty_like(d), np.empty_like(where)
        if i == most or not len(row):
            break
        e = d + (region[i : i + width] != pattern[i])
        skip[:-1] = d[1:] + 1
        skip[-1] = 1 << 14
        moved[:-1] = where[1:]
        moved[-1] = where[-1]
        from_skip = skip < e
        np.copyto(e, skip, where=from_skip)
        np.copyto(where, moved, where=from_skip)
        run = np.minimum.accumulate(e - cells, axis=0) + cells
        changed = run != e
        if changed.any():
            # A run of inserted characters keeps the beginning of the cell it starts from.
            source = np.maximum.accumulate(np.where(changed, np.int16(0), cells), axis=0)
            where = np.take_along_axis(where, source, axis=0)
        d = run
    return best, start, end


def item_parts(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", part: int = PART):
    """The benchmark's items, normalised, as indexes of bounded size."""
    size = benchmark.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    parts = max(1, -(-size // part))
    for k in range(parts):
        rows = benchmark.where(F.col(text).isNotNull()).where(F.pmod(F.xxhash64(text), F.lit(parts)) == k).select(item_id, text).collect()
        items = []
        for r in rows:
            raw = np.frombuffer(r[1].encode(), np.uint8)
            t = normalise(raw, np.array([0, len(raw)]))[0].tobytes().strip() if len(raw) else b""
            if t:
                items.append((r[0], t))
        if items:
            yield Index(sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])))


FOUND = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("first_byte", T.LongType()), T.StructField("end_byte", T.LongType()), T.StructField("windows", T.IntegerType()), T.StructField("edits", T.IntegerType())])
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("first_byte", pa.int64()), ("end_byte", pa.int64()), ("windows", pa.int32()), ("edits", pa.int32())]))


def with_leaks(docs: DataFrame, index: Index, name: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with an array of the items found in each text: the span from the first window to the last, and the least edits."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def one(b: pa.RecordBatch) -> list[pa.Array]:
        rows: list = []
        for lo, hi, buf, off in scan.blocks(utf8(b.column(b.schema.get_field_index(text))), BLOCK):
            found: dict[int, dict[int, list[int]]] = {}
            if len(buf):
                for doc, item, first, end, edits in shared.value.search(buf, off):
                    f = found.setdefault(doc, {}).setdefault(item, [first, end, 0, edits])
                    f[:] = [min(f[0], first), max(f[1], end), f[2] + 1, min(f[3], edits)]
            for i in range(hi - lo):
                rows.append([{"item_id": shared.value.items[x][0], "first_byte": f[0], "end_byte": f[1], "windows": f[2], "edits": f[3]} for x, f in sorted(found.get(i, {}).items())])
        return [pa.array(rows, _ARROW)]

    return extend(docs, [T.StructField(name, T.ArrayType(FOUND), False)], one, keep)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_byte, end_byte, windows, edits): a row for each item found in each text."""
    out = None
    for index in item_parts(benchmark):
        found = with_leaks(docs.select("doc_id", "text"), index, "found", keep=["doc_id"]).select("doc_id", F.inline("found"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FOUND)
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {fields}")
    return out


def clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` in whose text no item is found; their columns as they are. What a part of the benchmark leaves is written before the next."""
    columns = docs.columns
    name = "found"
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    for k, index in enumerate(item_parts(benchmark)):
        docs = scratch.write(docs, f"without {k}") if k else docs
        docs = with_leaks(docs, index, name).where(F.size(name) == 0).select(*columns)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document, whole or in part, within the edit budget."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
