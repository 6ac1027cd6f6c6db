"""Benchmark decontamination by template windows.

A text's tokens are runs of ASCII letters and digits and of bytes above ASCII, lower-cased. A
token that starts with a digit is a number (several in a row are one), a unit word after a
number a unit, a capitalised word inside a sentence a name; these become typed placeholders. A
capitalised word that opens a sentence, unless it is one of OPENERS, may be a name: windows with
it are looked up in both readings.

Items of one template, whose slots repeat values at the same places, are one class. Runs of
WINDOW template tokens (a class with fewer: all of them) are hashed and joined with those of the
classes; items come last. Each alignment (text position minus item position) is judged by itself: it
counts if its windows cover at least COVER of the tokens and its slots are consistent, each
value of the item replaced by one and the same value throughout. Only where no alignment suffices, runs
on several of them that rise in both item and text are chained under the same two conditions.

An alignment that repeats every token of an item is verbatim and names the items that it repeats;
where a text has no verbatim one of a class, its smallest item_id (null last) stands for the
class, whose items the text re-parameterises all alike. Items of one id are judged each, the best counts.

The benchmark is a query set: it meets all documents in blocks of at most BLOCK windows, each
broadcast; the items of a class that fall into two blocks are two classes. Defined results:
null and empty texts and items match nothing; repeated rows are judged each; a null doc_id is
kept; columns beside those named are not read, and clean() returns them as they are.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from basketflow.llm import shingles

WINDOW = 6
COVER = 0.6
BLOCK = 1 << 20
#: Unit words.
UNITS = "mm cm m km in ft yd mi mile miles meter meters metre metres inch inches foot feet mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros kmh mph kph degrees"
#: Words that open sentences and are no names.
OPENERS = "the this that these those there here an and but or nor so yet if when while where what which who whom whose why how he she it we they you his her its our their your my in on at by for from of to with without into over under after before during since until through between about against as than then now once each every all any some no not none both either neither one two three is are was were be been do does did has have had can could should would shall must let given suppose assume find write explain consider calculate compute determine also however because although though"
#: States kept for one run of a chain over several alignments.
STATES = 64
_U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".!?\n"]] = True
NUMBER, UNIT, NAME = (shingles.mixed(np.array([x], np.uint64))[0] for x in (11, 22, 33))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hash, own hash and slot type (0: none, 4: possible name) of all tokens; each row's first token's index (one more at the end)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.uint64)
        return z, z, np.zeros(0, np.int8), np.zeros(len(offsets), np.int64)
    word = _WORD[data]
    rows = offsets[:-1][offsets[:-1] < n]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[rows] = word[rows]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = rows[rows > 0] - 1
    last[ends] = word[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        z = np.zeros(0, np.uint64)
        return z, z, np.zeros(0, np.int8), np.zeros(len(offsets), np.int64)
    low = data
    accent = np.flatnonzero(data[:-1] == 0xC3) + 1
    accent = accent[(data[accent] >= 0x80) & (data[accent] <= 0x9E) & (data[accent] != 0x97)]
    if len(accent):
        low = data.copy()
        low[accent] += 0x20
    power, inverse = shingles._power(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(shingles._BYTE[low] * power[:n], out=total[1:])
        own = shingles.mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * shingles._P)
    at = np.searchsorted(start, offsets)
    head = data[start]
    second = data[np.minimum(start + 1, n - 1)]
    upper = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    after = data[np.minimum(start + np.where(head == 0xC3, 2, 1), n - 1)]
    lower_next = (end - start > 1) & (((after >= 97) & (after <= 122)) | (after >= 128))
    stops = np.zeros(n + 1, np.int32)
    np.cumsum(_STOP[data], out=stops[1:])
    opens = np.ones(len(start), bool)
    opens[1:] = stops[start[1:]] > stops[end[:-1]]
    opens[at[:-1][at[:-1] < len(start)]] = True
    kind = np.zeros(len(start), np.int8)
    kind[upper & lower_next] = 3
    kind[upper & lower_next & opens & ~np.isin(own, _hashes(OPENERS))] = 4
    kind[opens & (kind == 3)] = 0
    number = (head >= 48) & (head <= 57)
    kind[number] = 1
    begins = np.zeros(len(start), bool)
    begins[at[:-1][at[:-1] < len(start)]] = True
    follows = np.zeros(len(start), bool)
    follows[1:] = number[:-1]
    follows &= ~begins
    kind[follows & ~number & np.isin(own, _hashes(UNITS))] = 2
    template = np.where(kind == 1, NUMBER, np.where(kind == 2, UNIT, np.where(kind == 3, NAME, own)))
    keep = ~(number & follows)
    if not keep.all():  # a run of numbers has the value of all of them
        head_at = np.flatnonzero(keep)
        place = np.arange(len(keep)) - head_at[np.cumsum(keep) - 1]
        with np.errstate(over="ignore"):
            whole = np.add.reduceat(shingles.mixed(own + place.astype(np.uint64) * shingles._P), head_at)
        alone = np.diff(np.append(head_at, len(keep))) == 1
        return template[keep], np.where(alone, own[keep], whole), kind[keep], np.concatenate([[0], np.cumsum(keep)])[at]
    return template, own, kind, at


_known: dict[str, np.ndarray] = {}


def _hashes(words: str) -> np.ndarray:
    if words not in _known:
        raw = np.frombuffer(words.encode(), np.uint8)
        _known[words] = np.sort(shingles.word_hashes(raw, np.array([0, len(raw)]))[0])
    return _known[words]


def readings(t: np.ndarray, kind: np.ndarray, width: int):
    """(first tokens, hashes) of windows in which some or all possible names are read as names."""
    n = max(0, len(t) - width + 1)
    bits = np.zeros(n, np.int64)
    for x in range(width):
        bits |= (kind[x : x + n] == 4).astype(np.int64) << x
    at = np.flatnonzero(bits)
    bits = bits[at]
    there = np.unique(bits).tolist()
    for mask in range(1, 1 << width):
        if any(b & mask == mask for b in there):
            p = at[bits & mask == mask]
            w = t[p[:, None] + np.arange(width)]
            w[:, [x for x in range(width) if mask >> x & 1]] = NAME
            yield p, shingles.windows(w.reshape(-1), width)[::width]


class Template:
    """A class of items: tokens n, label of each slot (the first place of its value; -1: no slot), items by their own tokens."""

    def __init__(self, kind: np.ndarray, label: np.ndarray):
        self.n, self.kind, self.label, self.least, self.items = len(kind), kind, label, None, defaultdict(list)
        self.slots = {named: [(i, x) for i, (k, x) in enumerate(zip(kind.tolist(), label.tolist(), strict=True)) if k in (1, 2, 3) or (named and k == 4)] for named in (False, True)}

    def filled(self, places, q: int, own: np.ndarray, named: bool) -> dict[int, int] | None:
        """What the text has for each value in the slots of places, item place 0 being text place q; None if one has two."""
        got: dict[int, int] = {}
        for i, x in self.slots[named]:
            if i in places and got.setdefault(x, b := int(own[q + i])) != b:
                return None
        return got


class Index:
    """Template windows of benchmark items (item_id, text)."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.window, self.classes, rows, known = window, [], defaultdict(list), {}
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            t, own, kind, _ = tokens(raw, np.array([0, len(raw)]))
            if not len(t):
                continue
            first: dict = {}
            label = np.array([first.setdefault((min(k, 3), o), i) if k else -1 for i, (k, o) in enumerate(zip(kind.tolist(), own.tolist(), strict=True))], np.int32)
            key = (np.where(kind == 4, NAME, t).tobytes(), kind.tobytes(), label.tobytes(), own[kind == 4].tobytes())
            k = known.get(key)
            if k is None:
                k = known[key] = len(self.classes)
                self.classes.append(Template(kind, label))
                width = min(window, len(t))
                rows[width] += [(h, k, i, True) for i, h in enumerate(shingles.windows(t, width).tolist())]
                rows[width] += [(h, k, i, False) for p, hs in readings(t, kind, width) for i, h in zip(p.tolist(), hs.tolist(), strict=True)]
            c = self.classes[k]
            c.items[own.tobytes()].append(item)
            c.least = item if c.least is None else c.least if item is None else min(c.least, item)
        self.sizes = np.array([c.n for c in self.classes], np.int64)
        self.by = {}
        for width, r in rows.items():
            h, k, i, plain = (np.array(x, t) for x, t in zip(zip(*r, strict=True), (np.uint64, np.int64, np.int64, bool), strict=True))
            o = np.argsort(h, kind="stable")
            u, first, many = np.unique(h[o], return_index=True, return_counts=True)
            self.by[width] = (u, first, many, k[o], i[o], plain[o])

    def found(self, texts: pa.Array, cover: float = COVER):
        """(row, item_id, tokens covered, tokens of the item, verbatim) of what counts, the best of each item."""
        for at, data, offsets in shingles.pieces(texts):
            t, own, kind, words = tokens(data, offsets)
            best: dict = {}
            for width, table in self.by.items():
                hits = self._hits(t, kind, words, width, table)
                for r, k, covered, exact in self._judged(hits, own, words, width, cover):
                    c = self.classes[k]
                    for item in (x for e in exact for x in c.items[e]) if exact else (c.least,):
                        got = (covered, bool(exact), c.n)
                        best[r, item] = max(best.get((r, item), got), got)
            for (r, item), (covered, exact, n) in sorted(best.items(), key=lambda x: (x[0][0], x[0][1] is None, x[0][1] or 0)):
                yield at + r, item, covered, n, exact

    @staticmethod
    def _hits(t, kind, words, width, table):
        """Arrays (row, class, text place minus item place, item place, both read plainly) of all matching windows, in that order."""
        u, first, many, k, i, plain = table
        cols = [[] for _ in range(5)]
        own_windows = shingles.windows(t, width)
        for own_reading, at_token, h in ((True, np.arange(len(own_windows)), own_windows), *((False, *x) for x in readings(t, kind, width))):
            if not len(h):
                continue
            j = np.minimum(np.searchsorted(u, h), len(u) - 1)
            same = np.flatnonzero(u[j] == h)
            p, j = at_token[same], j[same]
            row = np.searchsorted(words, p, "right") - 1
            inside = p + width <= words[row + 1]
            p, j, row = p[inside], j[inside], row[inside]
            n = many[j]
            x = np.repeat(first[j] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            for c, v in zip(cols, (np.repeat(row, n), k[x], np.repeat(p, n) - i[x], i[x], plain[x] & own_reading), strict=True):
                c.append(v)
        if not cols[0]:
            return [np.zeros(0, np.int64)] * 5
        cols = [np.concatenate(c) for c in cols]
        order = np.lexsort((~cols[4], cols[3], cols[2], cols[1], cols[0]))
        cols = [c[order] for c in cols]
        new = np.ones(len(order), bool)
        new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1]) | (cols[3][1:] != cols[3][:-1])
        return [c[new] for c in cols]

    def _judged(self, hits, own, words, width, cover):
        """(row, class, tokens covered, own tokens of the items repeated verbatim) of every text and class that counts."""
        row, k, d, i, plain = hits
        if not len(row):
            return
        edge = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (k[1:] != k[:-1])]))
        many = np.diff(np.append(edge, len(row)))
        enough = many * width >= cover * self.sizes[k[edge]]
        for a, n in zip(edge[enough].tolist(), many[enough].tolist(), strict=True):
            r, c = int(row[a]), self.classes[k[a]]
            s = slice(a, a + n)
            got = self._best(c, d[s], i[s], plain[s], own, int(words[r]), int(words[r + 1]), width, cover)
            if got:
                yield r, int(k[a]), *got

    def _best(self, c, d, i, plain, own, lo, hi, width, cover):
        edge = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        runs = list(zip(d[edge].tolist(), edge.tolist(), np.append(edge[1:], len(d)).tolist(), strict=True))
        exact = {e for q, _, _ in runs if lo <= q and q + c.n <= hi and (e := own[q : q + c.n].tobytes()) in c.items}
        if exact:
            return c.n, sorted(exact)
        best = 0
        for named in (False, True):
            if named and plain.all():
                break
            for q, a, b in runs:
                at = i[a:b] if named else i[a:b][plain[a:b]]
                if len(at) * width < cover * c.n:
                    continue
                places = np.unique(at[:, None] + np.arange(width)).tolist()
                if len(places) >= cover * c.n and len(places) > best and c.filled(set(places), q, own, named) is not None:
                    best = len(places)
        if best >= cover * c.n:
            return best, []
        for named in (False, True):
            if named and plain.all():
                break
            some = slice(None) if named else plain
            if len(np.unique(i[some][:, None] + np.arange(width))) >= cover * c.n:
                best = max(best, self._chain(c, d[some], i[some], own, named, width))
        return (best, []) if best >= cover * c.n else None

    def _chain(self, c, d, i, own, named, width):
        """Tokens covered by the best consistent chain of runs that rise in item and text."""
        runs: list[list[int]] = []  # first item token, first text token, tokens
        for at, x in zip(d.tolist(), i.tolist(), strict=True):
            if runs and at == runs[-1][1] - runs[-1][0] and x <= runs[-1][0] + runs[-1][2]:
                runs[-1][2] = x + width - runs[-1][0]
            else:
                runs.append([x, at + x, width])
        runs.sort(key=lambda x: (x[1] + x[2], x[0] + x[2]))
        best, held = 0, []
        for i, q, m in runs:
            own_slots = c.filled(range(i, i + m), q - i, own, named)
            states = [] if own_slots is None else [(m, q, own_slots)]  # covered, start, slots
            for i0, q0, m0, before in reversed(held):
                if q - (q0 + m0 - width) > 2 * self.window:
                    if q - (q0 + m0) > 2 * (c.n + self.window):
                        break
                    continue
                skip = max(0, i0 + m0 - i, q0 + m0 - q)
                if skip >= m or not before:
                    continue
                more = own_slots if not skip else c.filled(range(i + skip, i + m), q - i, own, named)
                for covered, start, slots in before if more is not None else ():
                    if q + m - width - start <= 2 * c.n and all(slots.get(a, b) == b for a, b in more.items()):
                        states.append((covered + m - skip, start, slots | more))
            states.sort(key=lambda x: -x[0])
            kept, seen = [], set()
            for s in states:
                key = (s[1], frozenset(s[2].items()))
                if key not in seen and len(kept) < STATES:
                    seen.add(key)
                    kept.append(s)
            best = max([best, *(s[0] for s in kept)])
            held.append((i, q, m, kept))
        return best


def blocks(benchmark: DataFrame, most: int = BLOCK):
    """Indexes of the benchmark's items (item_id, text), each of about `most` windows."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len((r["text"] or "").split())
        if size >= most:
            yield Index(held)
            held, size = [], 0
    if held:
        yield Index(held)


def leaks(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """(doc_id, item_id, n_covered, n_tokens, verbatim) of every document and item, or class of items, that it contains."""
    docs = docs.select("doc_id", "text")
    names = ("item_id", "n_covered", "n_tokens")
    schema = f"doc_id long, {', '.join(f'{x} long' for x in names)}, verbatim boolean"
    out = None
    for index in blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            for b in batches:
                got = list(held.value.found(b.column(1), cover))
                ids = b.column(0).cast(pa.int64()).take(pa.array([x[0] for x in got], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[i + 1] for x in got], pa.int64()) for i in range(len(names))), pa.array([x[4] for x in got], pa.bool_())], ["doc_id", *names, "verbatim"])

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", cover: float = COVER) -> DataFrame:
    """docs without those that contain a benchmark item; no shuffle."""
    at, schema = docs.columns.index(text), docs.schema
    for index in blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            for b in batches:
                bad = {x[0] for x in held.value.found(b.column(at), cover)}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_())) if bad else b

        docs = docs.mapInArrow(run, schema)
    return docs
