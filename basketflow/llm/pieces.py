"""SentencePiece encoding and decoding of a byte-fallback BPE model by suffix-array matching.

The distinct space-delimited parts of a batch are concatenated and indexed by an array of their
suffixes, sorted as far as the longest piece reaches, INDEXED code points at a time (a longer part
in blocks that overlap by the longest piece). Every piece is found by binary search as
one range of that array; the ranges' suffixes are edges (position, length, piece), sorted by
position. They are then relaxed in the model's order: in each part, again and again, the pair
of neighbours whose joint edge has the best score (ties: the leftmost) becomes one. (The models of
this kind join by score; the best sum over edges would be another segmentation.) All parts go at once; in
a long one so do all pairs that are the best within the reach of the longest piece to both sides: a piece
scores worse than those it is joined from, so nothing beyond can come before. Parts end before a run of spaces, which no piece crosses. A character without
an edge becomes its UTF-8 bytes' pieces.

Defined results: a null or empty text has no pieces and decodes to an empty text; U+2581
decodes as a space, as in the model's own tools; texts of any length are encoded whole, in memory
of some 60 bytes for each character of a part without spaces. Repeated rows come back each; a column
that has the name of an added one is replaced by it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Code points of distinct parts that are indexed together, parts that a worker remembers, and the longest it does.
INDEXED = 1 << 18
REMEMBERED = 200_000
SHORT = 32
_NONE = np.int32((1 << 31) - 1)


class Model:
    def __init__(self, path: str = DEFAULT_MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes, self.text, found = {}, [], []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            self.text.append(p)
            if sp.is_byte(i):
                self.bytes[int(p[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                found.append((p, i, sp.get_score(i)))
        byte_of = {i: b for b, i in self.bytes.items()}
        written = [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([byte_of[i]]) if i in byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.text)]
        self.sizes = np.array([len(x) for x in written], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(written), np.uint8)
        if len(self.bytes) != 256 or any(SPACE in p.lstrip(SPACE) for p, _, _ in found):
            raise ValueError("the model needs byte pieces and pieces that have spaces at their start only")
        self.longest = max(len(p) for p, _, _ in found)
        if self.longest > 31:
            raise ValueError("a piece is longer than 31 characters")
        self.powers = 2.0 ** np.arange(32)
        self.lower = (self.powers - 1).astype(np.uint32)
        self.alphabet = np.array(sorted({ord(c) for p, _, _ in found for c in p}), np.uint32)
        self.width = int(len(self.alphabet) + 1).bit_length()
        scores = sorted({-s for _, _, s in found})
        rank = {s: k for k, s in enumerate(scores)}
        keys = self.keys(np.array([[ord(c) for c in p] + [0] * (self.longest - len(p)) for p, _, _ in found], np.uint32))
        over = self.keys(np.array([[ord(c) for c in p] + [0xFFFFFFFF] * (self.longest - len(p)) for p, _, _ in found], np.uint32))
        self.pieces = (keys, over, np.array([len(p) for p, _, _ in found]), np.array([i for _, i, _ in found], np.int32))
        self.ranks = np.full(sp.get_piece_size() + 1, _NONE, np.int32)  # by id; the last is no piece
        self.ranks[self.pieces[3]] = [rank[-s] for _, _, s in found]

    def letters(self, cp: np.ndarray) -> np.ndarray:
        """Alphabet numbers from 1; 0 for characters outside, the largest for the code 0xFFFFFFFF."""
        i = np.minimum(np.searchsorted(self.alphabet, cp), len(self.alphabet) - 1)
        out = np.where(self.alphabet[i] == cp, i + 1, 0)
        return np.where(cp == 0xFFFFFFFF, (1 << self.width) - 1, out).astype(np.uint64)

    def keys(self, rows: np.ndarray) -> list[np.ndarray]:
        """Rows of code points packed into a few 64-bit numbers that sort alike."""
        return self.packed(self.letters(rows))

    def packed(self, x: np.ndarray) -> list[np.ndarray]:
        per = 64 // self.width
        out = []
        for at in range(0, self.longest, per):
            k = np.zeros(len(x), np.uint64)
            for j in range(at, at + per):
                k = k << np.uint64(self.width) | (x[:, j] if j < self.longest else np.uint64(0))
            out.append(k)
        return out

    def edges(self, cp: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges sorted by position, then length: of each position the bits of their lengths and where its first is, and all edges' pieces.

        ends: of each position, the end of its part; no edge reaches beyond.
        """
        n, bits, ids = len(cp), [], []
        for lo in range(0, n, INDEXED):
            hi = min(n, lo + INDEXED)
            letters = np.zeros(hi - lo + self.longest, np.uint64)
            letters[: min(n, hi + self.longest) - lo] = self.letters(cp[lo : hi + self.longest])
            keys = self.packed(np.lib.stride_tricks.sliding_window_view(letters, self.longest)[: hi - lo])
            order = np.lexsort(keys[::-1])
            keys = [k[order] for k in keys]
            low, high = self._range(keys, self.pieces[0], "left"), self._range(keys, self.pieces[1], "right")
            many = np.maximum(high - low, 0)
            piece = np.repeat(np.arange(len(many), dtype=np.int32), many)
            at = order[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            length = self.pieces[2][piece]
            fits = at + lo + length <= ends[lo + at]
            at, piece, length = at[fits], piece[fits], length[fits]
            own = np.bincount(at, weights=self.powers[length], minlength=hi - lo).astype(np.uint32)
            many = np.bitwise_count(own).astype(np.int64)  # a counting sort by position and length
            place = np.empty(len(at), np.int32)
            place[(np.cumsum(many) - many)[at] + np.bitwise_count(own[at] & self.lower[length])] = self.pieces[3][piece]
            bits.append(own)
            ids.append(place)
        bits, ids = np.concatenate(bits or [np.zeros(0, np.uint32)]), np.concatenate(ids or [np.zeros(0, np.int32)])
        many = np.bitwise_count(bits).astype(np.int64)
        return bits, np.cumsum(many) - many, ids

    def _looked_up(self, edges, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The pieces at these positions that are so long; -1 where there is none."""
        bits, first, ids = edges
        own, length = bits[at], length.astype(np.uint32)
        there = np.flatnonzero(own >> length & np.uint32(1))
        out = np.full(len(at), -1, np.int32)
        out[there] = ids[first[at[there]] + np.bitwise_count(own[there] & self.lower[length[there]])]
        return out

    @staticmethod
    def _range(sorted_keys, wanted, side):
        """Binary search of many keys of several words at once."""
        n, m = len(sorted_keys[0]), len(wanted[0])
        lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
        while (open_ := lo < hi).any():
            mid = np.minimum((lo + hi) >> 1, n - 1)
            less, equal = np.zeros(m, bool), np.ones(m, bool)
            for s, w in zip(sorted_keys, wanted, strict=True):
                x = s[mid]
                less |= equal & (x < w)
                equal &= x == w
            go = open_ & (less | (equal if side == "right" else False))
            lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
        return lo

    def _pairs(self, edges, start, end, part) -> np.ndarray:
        """Of each token with the next one of its part: the rank of the piece they make."""
        out = np.full(len(start), _NONE, np.int32)
        ok = np.flatnonzero((part[1:] == part[:-1]) & (end[1:] - start[:-1] <= self.longest))
        out[ok] = self.ranks[self._looked_up(edges, start[ok], end[ok + 1] - start[ok])]
        return out

    def _safe(self, pair: np.ndarray) -> np.ndarray:
        """Pairs that nothing in reach comes before; of pairs of one rank in a row every second from the first on."""
        least, width = pair.copy(), 1
        while width <= self.longest:  # the least of each 2 * longest + 1 or more around
            step = min(width, self.longest + 1 - width) or 1
            wider = least.copy()
            np.minimum(wider[step:], least[:-step], out=wider[step:])
            np.minimum(wider[:-step], least[step:], out=wider[:-step])
            least, width = wider, width + step
        good = (pair == least) & (pair < _NONE)
        first = np.ones(len(pair), bool)
        first[1:] = pair[1:] != pair[:-1]
        place = np.arange(len(pair))
        run = np.maximum.accumulate(np.where(first, place, 0))
        bad = np.maximum.accumulate(np.where(good, -1, place))  # the last one before that is not safe
        return np.flatnonzero(good & (bad < run) & ((place - run) % 2 == 0))

    def encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all parts in order, and how many each has."""
        lengths = np.array([len(p) for p in parts], np.int64)
        cp = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        stops = np.cumsum(lengths)
        part = np.repeat(np.arange(len(parts)), lengths)
        edges = self.edges(cp, stops[part])
        start, end = np.arange(len(cp)), np.arange(1, len(cp) + 1)
        pair = self._pairs(edges, start, end, part)
        done_s, done_e = [], []
        while len(start):
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            best = np.minimum.reduceat(pair, first)
            many = np.diff(np.append(first, len(start)))
            live = np.repeat(best < _NONE, many)
            if not live.all():
                done_s.append(start[~live])
                done_e.append(end[~live])
            at = np.flatnonzero(live & (pair == np.repeat(best, many)))
            at = at[np.concatenate([[True], part[at][1:] != part[at][:-1]])] if len(at) else at
            if many.max() > 2 * self.longest:
                at = np.union1d(at, self._safe(pair))
            end[at] = end[at + 1]
            live[at + 1] = False
            changed = np.zeros(len(start), bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            changed[np.maximum(at - 2, 0)[~live[np.maximum(at - 1, 0)]]] = True  # the one before, where the token between has gone
            start, end, part, pair, changed = start[live], end[live], part[live], pair[live], np.flatnonzero(changed[live])
            if len(start):
                both = np.minimum(changed + 1, len(start) - 1)
                ok = (part[both] == part[changed]) & (both > changed) & (end[both] - start[changed] <= self.longest)
                pair[changed] = _NONE
                pair[changed[ok]] = self.ranks[self._looked_up(edges, start[changed[ok]], end[both[ok]] - start[changed[ok]])]
        s, e = np.concatenate(done_s), np.concatenate(done_e)
        by = np.argsort(s)
        s, e = s[by], e[by]
        got = self._looked_up(edges, s, e - s).astype(np.int64)
        if (missing := np.flatnonzero(got < 0)).size:
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in cp[s[missing]].tolist()]
            counts = np.ones(len(s), np.int64)
            counts[missing] = [len(x) for x in raw]
            at = np.concatenate([[0], np.cumsum(counts)])
            flat = np.repeat(got, counts)
            flat[flat < 0] = [self.bytes[b] for x in raw for b in x]
            return flat.astype(np.int32), np.diff(at[np.searchsorted(s, stops)], prepend=0)
        return got.astype(np.int32), np.diff(np.searchsorted(s, stops), prepend=0)

    def decoded(self, ids: np.ndarray) -> str:
        """The text of piece ids; control pieces are left out, bytes that are no UTF-8 become U+FFFD each."""
        many = self.sizes[ids]
        raw = self.raw[np.repeat(self.starts[ids] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())] if len(ids) else np.zeros(0, np.uint8)
        try:
            text = raw.tobytes().decode()
        except UnicodeDecodeError:
            text = self._repaired(raw.tobytes())
        return text[1:] if text.startswith(" ") else text

    @staticmethod
    def _repaired(raw: bytes) -> str:
        out = []
        while raw:
            try:
                out.append(raw.decode())
                break
            except UnicodeDecodeError as e:
                out.append(raw[: e.start].decode() + "\ufffd")
                raw = raw[e.start + 1 :]
        return "".join(out)


@lru_cache(maxsize=2)
def model(path: str = DEFAULT_MODEL) -> Model:
    return Model(path)


_PART = re.compile(rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class Encoder:
    """Encodes texts batch by batch and remembers the parts it has met, up to REMEMBERED."""

    def __init__(self, path: str = DEFAULT_MODEL):
        self.model = model(path)
        self._empty()

    def _empty(self) -> None:
        self.ids: dict[str, int] = {}
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def batches(self, texts: list[str | None], most: int = 1 << 21) -> Iterator[list[np.ndarray]]:
        """Ids of runs of texts of about so many characters."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= most):
                size += len(texts[to] or "")
                to += 1
            yield self.encode(texts[at:to])
            at = to

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.ids) > REMEMBERED:
            self._empty()
        rows, new, ids, long = [], [], self.ids, []
        for t in texts:
            row = []
            for p in _PART.findall(SPACE + t.replace(" ", SPACE)) if t else ():
                i = ids.get(p)
                if i is None:
                    if len(p) > SHORT:  # not remembered
                        long.append(p)
                        i = -len(long)
                    else:
                        i = ids[p] = len(ids)
                        new.append(p)
                row.append(i)
            rows.append(np.array(row, np.int64))
        got = [self._indexed(new), self._indexed(long)]
        self.flat, self.sizes = (np.concatenate([a, *(x[i] for x in got[0])]) for i, a in enumerate((self.flat, self.sizes)))
        flat, sizes = (np.concatenate([a, *(x[i] for x in got[1])]) for i, a in enumerate((self.flat, self.sizes))) if long else (self.flat, self.sizes)
        starts, out = np.cumsum(sizes) - sizes, []
        for row in rows:
            row = np.where(row < 0, len(self.sizes) - 1 - row, row)
            many = sizes[row]
            out.append(flat[np.repeat(starts[row] - (np.cumsum(many) - many), many) + np.arange(many.sum())])
        return out

    def _indexed(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        while at < len(parts):
            to, size = at, 0
            while to < len(parts) and (to == at or size < INDEXED):
                size += len(parts[to])
                to += 1
            out.append(self.model.encoded(parts[at:to]))
            at = to
        return out


def encoded(docs: DataFrame, path: str = DEFAULT_MODEL, text: str = "text") -> DataFrame:
    """Adds pieces (array of ids) and decoded (the text they give back) to docs; other columns stay, but for ones of these names."""
    docs = docs.drop("pieces", "decoded")
    at, names = docs.columns.index(text), [*docs.columns, "pieces", "decoded"]
    schema = docs.select("*", F.lit(None).cast("array<int>").alias("pieces"), F.lit("").cast("string").alias("decoded")).schema

    def run(batches):
        e = Encoder(path)
        for whole in batches:
            done = 0
            for got in e.batches(whole.column(at).to_pylist()):
                b = whole.slice(done, len(got))
                done += len(got)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.int32())), pa.array([e.model.decoded(x) for x in got], pa.string())], names)

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, path: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, n_pieces, pieces_sha256 of the ids as little-endian 32-bit numbers, decoded_sha256, round_trip)."""
    schema = "doc_id long, n_pieces long, pieces_sha256 string, decoded_sha256 string, round_trip boolean"

    def run(batches):
        e = Encoder(path)
        for b in batches:
            texts, ids = b.column(1).to_pylist(), b.column(0).cast(pa.int64())
            n, one, two, same = [], [], [], []
            for got in e.batches(texts):
                for x in got:
                    back = e.model.decoded(x)
                    same.append(back == (texts[len(same)] or ""))
                    n.append(len(x))
                    one.append(hashlib.sha256(x.astype("<i4").tobytes()).hexdigest())
                    two.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "pieces_sha256", "decoded_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
