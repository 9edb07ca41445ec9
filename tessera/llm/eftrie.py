"""Elias-Fano sequences and the levels of an n-gram trie made of them.

A monotone sequence keeps the low bits of its numbers packed and the high
bits in unary. A directory counts the ones before each BLOCK bits of the
unary half, and a smaller one those before each word of a block, so selects and
searches read a few words where they lie; nothing is ever decoded whole. A level holds, for each context, its successors' ids
(level 2: word ids; level 3: positions among the successors of the context's
last word, so that ids stay small), made monotone by adding what all contexts
before have used up (the bases), with pointers to where each context begins,
and 16-bit codes of log probabilities and back-off weights. A level is a few
segments, each a file that is opened when it is first asked, and mapped into
memory where the shared folder is a file system.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np

from tessera.llm._common import filesystem

#: Codes of a log10 value x between -16 and 0: round(-x * STEPS).
STEPS = 4095
#: Bits of the unary half between two entries of the directory.
BLOCK = 512
#: Queries answered together, so that what is made of them stays in the processor's cache.
CHUNK = 1 << 15


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-log10 * STEPS), 0, 65_535).astype(np.uint16)


def restored(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) / -STEPS


def ones(n: int) -> np.uint64:
    """n low bits set."""
    return np.uint64((1 << n) - 1)


#: For a byte and a number below 8: the place of that one bit, of those set in the byte.
PLACE = np.array([[next((k for k in range(8) if b >> k & 1 and (b & (1 << k) - 1).bit_count() == n), 0) for n in range(8)] for b in range(256)], np.int64).ravel()


def groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of the Elias-Fano code of a monotone uint64 sequence below `universe`."""
    n = len(values)
    width = max(0, (universe // max(n, 1)).bit_length() - 1)
    v = values.astype(np.uint64)
    packed = np.zeros(n * width // 64 + 2, np.uint64)
    if width and n:
        low = v & ones(width)
        bit = np.arange(n, dtype=np.uint64) * np.uint64(width)
        word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        first = groups(word)
        packed[word[first]] = np.bitwise_or.reduceat(low << off, first)
        over = off + np.uint64(width) > 64
        packed[word[over] + 1] |= low[over] >> (np.uint64(64) - off[over])
    top = (universe - 1 >> width) + 1 if universe else 1
    upper = np.zeros(-(-(n + top + 1) // BLOCK) * (BLOCK // 64), np.uint64)
    if n:
        at = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        first = groups(at >> 6)
        upper[at[first] >> 6] = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
    inner = np.cumsum(np.bitwise_count(upper).reshape(-1, BLOCK // 64), axis=1, dtype=np.uint16)
    before = np.concatenate([[0], np.cumsum(inner[:, -1], dtype=np.int64)])
    inner = np.concatenate([np.zeros((len(inner), 1), np.uint16), inner[:, :-1]], axis=1).ravel()
    return {"low": packed, "upper": upper, "inner": inner, "before": before.astype(np.uint32 if n < 1 << 32 else np.int64), "shape": np.array([n, width, top], np.int64)}


class EliasFano:
    """A stored sequence, read in place."""

    def __init__(self, low: np.ndarray, upper: np.ndarray, inner: np.ndarray, before: np.ndarray, shape: np.ndarray):
        self.low, self.upper, self.inner, self.before = low, upper, inner, before
        self.n, self.width, self.top = (int(x) for x in shape)

    @cached_property
    def zeros_before(self) -> np.ndarray:
        return np.arange(len(self.before)) * BLOCK - self.before.astype(np.int64)

    def low_at(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.width)
        word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        got = self.low[word] >> off
        over = np.flatnonzero(off + np.uint64(self.width) > 64)
        got[over] |= self.low[word[over] + 1] << (np.uint64(64) - off[over])
        return got & ones(self.width)

    def select(self, i: np.ndarray, zeros: bool = False) -> np.ndarray:
        """Bit position of the i-th one (or zero) of the unary half, from 0."""
        directory = self.zeros_before if zeros else self.before
        block = np.searchsorted(directory, i, side="right") - 1
        left = i - directory[block].astype(np.int64)
        word = block * (BLOCK // 64)
        for half in (4, 2, 1):
            have = self.inner[word + half]
            if zeros:
                have = (((word & 7) + half) << 6) - have
            word += (left >= have) * half
        left -= ((word & 7) << 6) - self.inner[word] if zeros else self.inner[word]
        w = ~self.upper[word] if zeros else self.upper[word]
        at = word << 6
        for half in (32, 16, 8):
            have = np.bitwise_count(w & ones(half))
            on = left >= have
            left -= have * on
            step = on * half
            at += step
            w >>= step.astype(np.uint64)
        return at + PLACE[((w & np.uint64(255)) << np.uint64(3)).astype(np.int64) + left]

    def at(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers, as uint64."""
        return ((self.select(i) - i).astype(np.uint64) << np.uint64(self.width)) | self.low_at(i)

    def at_both(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The i-th numbers and those after them."""
        p = self.select(i)
        rest = (self.upper[p >> 6] >> (p & 63).astype(np.uint64)) >> np.uint64(1)
        q = p + 1 + np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1))
        far = np.flatnonzero(rest == 0)
        q[far] = self.select(i[far] + 1)
        low = np.uint64(self.width)
        return ((p - i).astype(np.uint64) << low) | self.low_at(i), ((q - i - 1).astype(np.uint64) << low) | self.low_at(i + 1)

    def search(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each target how many numbers are at or below it, and whether the last of them equals it: its bucket by the high bits, then successor search in the low ones."""
        t = targets.astype(np.uint64)
        if not self.n:
            return np.zeros(len(t), np.int64), np.zeros(len(t), bool)
        high = np.minimum(t >> np.uint64(self.width), np.uint64(self.top)).astype(np.int64)
        want = t & ones(self.width)
        lo = np.zeros(len(t), np.int64)
        inner = np.flatnonzero(high > 0)
        lo[inner] = self.select(high[inner] - 1, zeros=True) - high[inner] + 1
        # the ones from there on are the bucket: mostly a few bits of one word
        start = lo + high
        off = (start & 63).astype(np.uint64)
        free = ~(self.upper[np.minimum(start >> 6, len(self.upper) - 1)] >> off)
        run = np.bitwise_count((free & (~free + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        hi = lo + run
        long = np.flatnonzero((run + off.astype(np.int64) >= 64) & (high < self.top))
        hi[long] = self.select(high[long], zeros=True) - high[long]
        beyond = high >= self.top
        lo[beyond] = hi[beyond] = self.n
        count, equal = lo.copy(), np.zeros(len(t), bool)
        live = np.flatnonzero(lo < hi)
        lo, hi, want = lo[live], hi[live], want[live]
        while len(live):
            mid = (lo + hi) >> 1
            got = self.low_at(mid)
            under = got <= want
            equal[live] |= got == want
            lo, hi = np.where(under, mid + 1, lo), np.where(under, hi, mid)
            count[live] = lo
            go = np.flatnonzero(lo < hi)
            live, lo, hi, want = live[go], lo[go], hi[go], want[go]
        return count, equal


def save(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Write arrays to a new file of the folder, one after the other behind a header; returns its path."""
    at, head = 0, {}
    for name, a in arrays.items():
        head[name] = [str(a.dtype), at, len(a)]
        at += -(-a.nbytes // 64) * 64
    front = json.dumps(head).encode()
    front = len(front).to_bytes(8, "little") + front
    front += bytes(-len(front) % 64)
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}.ef"
    with fs.open_output_stream(f"{path}/{name}") as f:
        f.write(front)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes())
            f.write(bytes(-a.nbytes % 64))
    return f"{folder}/{name}"


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file: mapped where the store is a file system, else read."""
    from pyarrow import fs as pafs

    fs, at = filesystem(path)
    if isinstance(fs, pafs.LocalFileSystem):
        raw = np.asarray(np.memmap(at, np.uint8, "r"))
    else:
        with fs.open_input_file(at) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    n = int(raw[:8].view(np.uint64)[0])
    base = -(-(8 + n) // 64) * 64
    return {k: raw[base + at : base + at + np.dtype(t).itemsize * m].view(t) for k, (t, at, m) in json.loads(bytes(raw[8 : 8 + n])).items()}


def stored(name: str, values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": x for k, x in encode(values, universe).items()}


def sequence(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano(*(arrays[f"{name}.{k}"] for k in ("low", "upper", "inner", "before", "shape")))


class Segments:
    """Files of a structure by number, opened when first asked."""

    def __init__(self, segments: tuple):
        self.files, self.starts, at = {}, {}, 0
        for k, path, n in sorted(segments):
            self.files[k], self.starts[k] = path, at
            at += n
        self.size = at
        self.order = np.array(sorted(self.files), np.int64)
        self.firsts = np.array([self.starts[k] for k in self.order.tolist()], np.int64)
        self.opened: dict[int, dict] = {}

    def part(self, k: int) -> dict:
        if k not in self.opened:
            arrays = load(self.files[k])
            names = {n.partition(".")[0] for n in arrays if "." in n}
            self.opened[k] = {n: sequence(arrays, n) for n in names} | {n: a for n, a in arrays.items() if "." not in n}
        return self.opened[k]

    def chunks(self, number: np.ndarray, live: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(segment, some of the places in `live`) that lie in a stored segment, for a segment number at each of these places."""
        if len(live) and (np.diff(number) < 0).any():
            # short numbers are sorted in linear time
            order = np.argsort(number.astype(np.uint16) if number.max() < 1 << 16 and number.min() >= 0 else number, kind="stable")
            number, live = number[order], live[order]
        cuts = groups(number).tolist() + [len(number)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if int(number[lo]) in self.files:
                for at in range(lo, hi, CHUNK):
                    yield int(number[lo]), live[at : min(hi, at + CHUNK)]

    def holding(self, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(segment, places) of the entries at these positions; -1 is nowhere."""
        live = np.flatnonzero(at >= 0)
        yield from self.chunks(self.order[np.searchsorted(self.firsts, at[live], side="right") - 1] if len(live) else live, live)


class Vocabulary(Segments):
    """Words by the 64-bit hashes in order; a word's id is its hash's position. Segments part the hashes by their top bits."""

    def __init__(self, segments: tuple, bits: int):
        super().__init__(segments)
        self.bits = bits

    @staticmethod
    def build(folder: str, bits: int, hashes: np.ndarray, counts: np.ndarray) -> str:
        """A segment from its sorted hashes; their top bits are dropped."""
        rest = hashes & ones(64 - bits)
        return save(folder, stored("hash", rest, 1 << 64 - bits) | {"count": counts.astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.int64)})

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The id of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        top = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        for k, here in self.chunks(top, np.arange(len(hashes))):
            count, equal = self.part(k)["hash"].search(hashes[here] & ones(64 - self.bits))
            out[here] = np.where(equal, self.starts[k] + count - 1, -1)
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts; 0 for -1."""
        out = np.zeros(len(ids), np.int64)
        for k, here in self.holding(ids):
            out[here] = self.part(k)["count"][ids[here] - self.starts[k]]
        return out


class Level(Segments):
    """Successors of contexts. Contexts are numbered from 0 on and parted into ranges of `width`, the segments."""

    def __init__(self, segments: tuple, width: int):
        super().__init__(segments)
        self.width = width

    @staticmethod
    def build(folder: str, width: int, segment: int, context: np.ndarray, follower: np.ndarray, prob: np.ndarray, back: np.ndarray, last: bool = False) -> str:
        """A segment from entries sorted by context and follower; `back` is the back-off of each distinct context. The last level, which nothing hangs on, needs no pointers."""
        own = context - segment * width
        first = groups(own)
        own, n = own[first], np.diff(np.append(first, len(own)))
        used, taken = np.zeros(width + 1, np.int64), np.zeros(width + 1, np.uint64)
        used[own + 1] = n
        taken[own + 1] = follower[first + n - 1].astype(np.uint64) + np.uint64(1)
        pointers, bases = np.cumsum(used), np.cumsum(taken, dtype=np.uint64)
        ids = np.repeat(bases[own], n) + follower.astype(np.uint64)
        top = int(bases[-1]) + 1
        full = np.zeros(width, np.uint16)
        full[own] = quantised(back)
        arrays = {"prob": quantised(prob), "back": full} | stored("ids", ids, top) | stored("bases", bases, top)
        return save(folder, arrays if last else arrays | stored("pointers", pointers, len(ids) + 1))

    def contexts(self, context: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        live = np.flatnonzero(context >= 0)
        yield from self.chunks(context[live] // self.width, live)

    def find(self, context: np.ndarray, follower: np.ndarray) -> np.ndarray:
        """Position of each entry in the level, or -1; quickest when sorted by context. Contexts or followers of -1 are nowhere."""
        out = np.full(len(context), -1, np.int64)
        for k, here in self.contexts(np.where(follower >= 0, context, -1)):
            part = self.part(k)
            c = context[here] - k * self.width
            first = groups(c)
            base, following = part["bases"].at_both(c[first])
            room = following - base
            which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(c))))
            f = follower[here].astype(np.uint64)
            # a follower beyond the context's last one would fall into the next context's numbers
            fits = np.flatnonzero(f < room[which])
            count, equal = part["ids"].search(base[which[fits]] + f[fits])
            out[here[fits]] = np.where(equal, self.starts[k] + count - 1, -1)
        return out

    def begin(self, context: np.ndarray) -> np.ndarray:
        """Where the successors of each context begin in the level."""
        out = np.zeros(len(context), np.int64)
        for k, here in self.contexts(context):
            c = context[here] - k * self.width
            first = groups(c)
            out[here] = np.repeat(self.starts[k] + self.part(k)["pointers"].at(c[first]).astype(np.int64), np.diff(np.append(first, len(c))))
        return out

    def codes(self, at: np.ndarray) -> np.ndarray:
        """The code of each entry's log10 probability; 0 for -1."""
        out = np.zeros(len(at), np.int64)
        for k, here in self.holding(at):
            out[here] = self.part(k)["prob"][at[here] - self.starts[k]]
        return out

    def prob(self, at: np.ndarray) -> np.ndarray:
        """log10 probability of each entry; 0 for -1."""
        return restored(self.codes(at))

    def back(self, context: np.ndarray) -> np.ndarray:
        """Back-off weight (log10) of each context; 0, that is one, for contexts without successors."""
        out = np.zeros(len(context))
        for k, here in self.contexts(context):
            out[here] = restored(self.part(k)["back"][context[here] - k * self.width])
        return out
