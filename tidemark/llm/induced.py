"""Suffix sorting by external induced sorting, with prefix values.

Suffixes are S- or L-type (smaller or greater than the next one); the leftmost
S-type ones (LMS) are sorted first and all others are induced from them: a scan
in ascending order sends each suffix's L-type predecessor to a priority queue, a
scan in descending order the S-type ones. A queue's key is the suffix's first
letter; entries of one letter leave in the order in which they came. An entry is
a tuple: position, the next few preceding letters, and the prefix value (the
number of letters shared with the entry before it in its letter's queue, up to
the wanted depth). So a scan seldom looks into the text, and the prefix values
of the sorted suffixes follow from those of the LMS ones: one more than the
least value passed since the letter's last entry.

LMS suffixes are sorted by their substrings (up to the next LMS place): packed
letters go through a priority queue of sorted runs, equal ones again with the
letters that follow. Substrings' ranks are the letters of a reduced text, a third
as long or less; while ranks are tied, it is sorted by the same procedure,
recursively, or, once it is not far larger than memory, by doubling, in memory or
through sorted runs. Its prefix values, in ranks, tell from which letter on LMS
neighbours must be compared.

All that grows with the text (queues, runs, ranks, positions) is held in memory
up to a bound and in files beyond it, and is worked on in blocks, so a text may
be far larger than memory. Files go with their task.
"""

from __future__ import annotations

import heapq
import tempfile

import numpy as np

#: Preceding letters that an entry carries; when they are used up, the next ones are read from the text.
CARRIED = 4
#: Bytes that an entry of a sort takes in memory, all its transient arrays included.
_ENTRY = 64
#: A reduced text of up to so many times what memory holds is sorted by doubling in files; recursion, slow over a wide alphabet, sorts larger ones.
DOUBLED = 8


def scratch(n: int, kind, limit: int) -> np.ndarray:
    """An array of n zeros: in memory, if it is small beside the limit, else in a file."""
    size = n * np.dtype(kind).itemsize
    if size <= limit // 8:
        return np.zeros(n, kind)
    file = tempfile.TemporaryFile()
    file.truncate(size)
    return np.memmap(file, kind, "r+", shape=(n,))


class Spill:
    """Keeps tuples of arrays: in memory up to a number of bytes, then in a file."""

    def __init__(self, limit: int):
        self.limit, self.held, self.file, self.end = limit, 0, None, 0

    def keep(self, arrays: tuple):
        size = sum(a.nbytes for a in arrays)
        if self.held + size <= self.limit:
            self.held += size
            return arrays
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.end
        self.file.seek(at)
        for a in arrays:
            self.file.write(np.ascontiguousarray(a).data)
        self.end = at + size
        return at, len(arrays[0]), [a.dtype for a in arrays]

    def back(self, kept) -> tuple:
        if isinstance(kept[0], np.ndarray):
            self.held -= sum(a.nbytes for a in kept)
            return kept
        at, n, kinds = kept
        self.file.seek(at)
        return tuple(np.frombuffer(self.file.read(n * k.itemsize), k) for k in kinds)


class Queues:
    """A monotone priority queue of tuples: the least letter first (sign 1) or the greatest (sign -1); first in, first out within a letter.

    Letters are kept apart from `width` to `width`; only when the first of them
    is wanted are a stretch's tuples dealt to the letters. So a wide alphabet
    costs no queue for each letter.
    """

    def __init__(self, sign: int, limit: int, width: int = 1):
        self.sign, self.store, self.width = sign, Spill(limit), width
        self.letters, self.blocks = [], {}  # of the stretches dealt: letters as a heap, and each one's blocks
        self.far, self.stretches, self.dealt = {}, [], set()

    def _near(self, letters: np.ndarray, arrays: tuple) -> None:
        for a, b in _cuts(letters):
            letter = int(letters[a])
            if letter not in self.blocks:
                self.blocks[letter] = []
                heapq.heappush(self.letters, self.sign * letter)
            self.blocks[letter].append(self.store.keep(tuple(x[a:b] for x in arrays)))

    def deal(self, letters: np.ndarray, arrays: tuple) -> None:
        """Tuples, sorted by letter, to their letters' queues."""
        if not len(letters):
            return
        if self.width == 1:
            self._near(letters, arrays)
            return
        which = letters // self.width
        for a, b in _cuts(which):
            stretch, part = int(which[a]), tuple(x[a:b] for x in arrays)
            if stretch in self.dealt:
                self._near(letters[a:b], part)
                continue
            if stretch not in self.far:
                self.far[stretch] = []
                heapq.heappush(self.stretches, self.sign * stretch)
            self.far[stretch].append(self.store.keep((letters[a:b], *part)))

    def first(self) -> int | None:
        while self.stretches and (not self.letters or self.stretches[0] <= self.sign * (self.sign * self.letters[0] // self.width)):
            stretch = self.sign * heapq.heappop(self.stretches)
            self.dealt.add(stretch)
            for kept in self.far.pop(stretch):
                letters, *arrays = self.store.back(kept)
                by = np.argsort(letters, kind="stable")
                self._near(letters[by], tuple(x[by] for x in arrays))
        return self.sign * self.letters[0] if self.letters else None

    def done(self, letter: int) -> None:
        """The letter, which has no entries left, leaves the queue."""
        if self.letters and self.sign * self.letters[0] == letter and not self.blocks[letter]:
            heapq.heappop(self.letters)
            del self.blocks[letter]

    def take(self, letter: int, most: int) -> tuple | None:
        """About `most` tuples of the letter; None if there are none."""
        held, out, n = self.blocks.get(letter, ()), [], 0
        while len(out) < len(held) and n < most:
            out.append(self.store.back(held[len(out)]))
            n += len(out[-1][0])
        if not out:
            return None
        del held[: len(out)]
        return out[0] if len(out) == 1 else tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Stack:
    """Tuples in the order of their letters, last in, first out, in blocks of a size."""

    def __init__(self, limit: int, block: int):
        self.store, self.block, self.kept, self.buffer, self.held, self.top_ = Spill(limit), block, [], [], 0, None

    def push(self, letter: int, arrays: tuple) -> None:
        self.buffer.append((np.full(len(arrays[0]), letter, np.int64 if letter >> 16 else np.uint16), *arrays))
        self.held += len(arrays[0])
        if self.held >= self.block:
            self._flush()

    def _flush(self) -> None:
        self.kept.append(self.store.keep(tuple(np.concatenate(x) for x in zip(*self.buffer, strict=True))))
        self.buffer, self.held = [], 0

    def letter(self) -> int | None:
        """The letter of the tuple that came last; None if there is none."""
        if self.buffer:
            self._flush()
        if self.top_ is None or not len(self.top_[0]):
            if not self.kept:
                return None
            self.top_ = self.store.back(self.kept.pop())
        return int(self.top_[0][-1])

    def pop(self) -> tuple:
        """A block of tuples of that letter, the last one first."""
        letters = self.top_[0]
        other = np.flatnonzero(letters != letters[-1])
        a = int(other[-1]) + 1 if len(other) else 0
        out = tuple(x[a:][::-1] for x in self.top_[1:])
        self.top_ = tuple(x[:a] for x in self.top_)
        return out


def _cuts(values: np.ndarray):
    """Begins and ends of runs of equal values."""
    inner = (np.flatnonzero(values[1:] != values[:-1]) + 1).tolist()
    return zip([0, *inner], [*inner, len(values)], strict=True)


class Runs:
    """A priority queue that is filled first and emptied then: keys and values in sorted runs, on disk beyond the limit."""

    def __init__(self, limit: int):
        self.limit, self.held, self.buffer, self.runs = limit, 0, [], []

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.buffer.append((keys, values))
        self.held += keys.nbytes + values.nbytes
        if self.held > self.limit:
            self._flush()

    def _sorted(self):
        keys, values = (np.concatenate(x) for x in zip(*self.buffer, strict=True))
        self.buffer, self.held = [], 0
        order = np.argsort(keys, kind="stable")
        return keys[order], values[order]

    def _flush(self) -> None:
        run = []
        for a in self._sorted():
            run.append(np.memmap(tempfile.TemporaryFile(), a.dtype, "w+", shape=a.shape))
            run[-1][:] = a
        self.runs.append(run)

    def take(self, most: int):
        """All (keys, values) in ascending order, about `most` at a time."""
        if not self.runs:
            if self.buffer:
                keys, values = self._sorted()
                for k in range(0, len(keys), most):
                    yield keys[k : k + most], values[k : k + most]
            return
        if self.buffer:
            self._flush()
        at, share = [0] * len(self.runs), max(1, most // len(self.runs))
        while True:
            live = [r for r in range(len(at)) if at[r] < len(self.runs[r][0])]
            if not live:
                return
            # up to the least of the keys at which the runs' shares end, all are there
            bound = min(self.runs[r][0][min(at[r] + share, len(self.runs[r][0])) - 1] for r in live)
            parts = []
            for r in live:
                keys, values = self.runs[r]
                stop = at[r] + int(np.searchsorted(keys[at[r] : at[r] + share], bound, side="right"))
                parts.append((np.asarray(keys[at[r] : stop]), np.asarray(values[at[r] : stop])))
                at[r] = stop
            keys, values = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(keys, kind="stable")
            yield keys[order], values[order]


class Sort:
    """Sorts the suffixes of a text, exactly in the first `depth` letters at least.

    text: non-negative integers (an array, in memory or mapped), of which the
    last is 0 and no other is. depth: 1 to 254. limit: bytes that the sort
    holds in memory, about.
    """

    def __init__(self, text: np.ndarray, depth: int, limit: int, letters: int):
        self.text, self.depth, self.limit = text, depth, limit
        self.bits = int(letters + 1).bit_length()
        self.mask = (1 << self.bits) - 1  # greater than all letters
        self.carried = max(1, min(CARRIED, 62 // self.bits))
        self.block = max(64, limit // (4 * _ENTRY))
        self.place = np.int32 if len(text) < 1 << 31 else np.int64
        #: Letters that a queue keeps together until they are wanted.
        self.width = 1 if letters < 1024 else -(-letters // 512)
        #: Texts sorted: this one, and those of the recursion.
        self.levels = 1

    def descending(self):
        """(positions, prefix values) of all suffixes, greatest first, in blocks; a value tells how many letters a suffix shares with the one given before it."""
        order, links = self._lms_order(self._lms())
        yield from self._descend(self._ascend(order, links))

    # ------------------------------------------------------------- LMS suffixes

    def _lms(self) -> np.ndarray:
        """Positions of the LMS suffixes, ascending; the last letter's is one."""
        n = len(self.text)
        out = scratch(n // 2 + 1, self.place, self.limit)
        at, smaller = len(out) - 1, True  # the type of the suffix right of a block
        out[at] = n - 1
        for b in range(n - 1, 0, -self.block):
            a = max(0, b - self.block)
            t = self.text[a : b + 1].astype(np.int64)
            rises = np.sign(t[1:] - t[:-1])
            nearest = np.minimum.accumulate(np.where(rises != 0, np.arange(b - a), b - a)[::-1])[::-1]
            s = np.where(nearest < b - a, rises[np.minimum(nearest, b - a - 1)] > 0, smaller)
            smaller = bool(s[0])
            before = np.concatenate([self.text[a - 1 : a].astype(np.int64) if a else t[:1], t[:-2]])
            found = np.flatnonzero(s & (before > t[:-1])) + a
            out[at - len(found) : at] = found
            at -= len(found)
        return out[at:]

    def _packed(self, at: np.ndarray, left: np.ndarray, n: int) -> np.ndarray:
        """The n letters from `at` as one number each; those beyond the `left` ones of the substring count as greater than all letters."""
        key, last = np.zeros(len(at), np.uint64), len(self.text) - 1
        for k in range(n):
            letter = np.where(left > k, self.text[np.minimum(at + k, last)], self.mask)
            key = (key << np.uint64(self.bits)) | letter.astype(np.uint64)
        return key

    def _substrings(self, lms: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Begins and sizes of the LMS substrings a to b."""
        begin = np.asarray(lms[a:b], np.int64)
        following = np.asarray(lms[a + 1 : b + 1], np.int64)
        if len(following) < len(begin):
            following = np.append(following, begin[-1])
        return begin, following - begin + 1

    def _ranks(self, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """For each LMS substring the number of those that are smaller; for each such rank, how many have it; whether some are tied. Letters beyond the depth don't count."""
        m = len(lms)
        rank, size = scratch(m, self.place, self.limit), scratch(m, self.place, self.limit)
        queue, read = Runs(self.limit // 4), max(1, 63 // self.bits)
        for a in range(0, m, self.block):
            begin, n = self._substrings(lms, a, min(m, a + self.block))
            queue.put(self._packed(begin, n, read), np.arange(a, a + len(begin), dtype=self.place))
        count, group, last = 0, 0, None
        for keys, which in queue.take(self.block):
            new = np.concatenate([[last is None or keys[0] != last], keys[1:] != keys[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(count, count + len(keys)), group))
            rank[which] = first
            np.add.at(size, first, 1)
            count, group, last = count + len(keys), int(first[-1]), keys[-1]
        # ties among substrings that go on are told apart by the letters that follow
        if m >= 1 << 32:
            raise ValueError("a text of more than 2^32 LMS suffixes")
        more = max(1, min(read, 32 // self.bits))
        while read < self.depth:
            queue, any_ = Runs(self.limit // 4), False
            for a in range(0, m, self.block):
                begin, n = self._substrings(lms, a, min(m, a + self.block))
                r = np.asarray(rank[a : a + len(begin)], np.int64)
                on = np.flatnonzero((n >= read) & (np.asarray(size[r]) > 1))
                if len(on):
                    any_ = True
                    key = (r[on].astype(np.uint64) << np.uint64(more * self.bits)) | self._packed(begin[on] + read, n[on] - read, more)
                    queue.put(key, (on + a).astype(self.place))
            if not any_:
                break
            self._regrouped(queue, more * self.bits, rank, size)
            read += more
        tied = any(bool((np.asarray(size[a : a + self.block]) > 1).any()) for a in range(0, m, self.block))
        return rank, size, tied

    def _regrouped(self, queue: Runs, bits: int, rank: np.ndarray, size: np.ndarray) -> None:
        """New ranks of tied entries, and how many each rank has: the queue's keys are ranks with `bits` bits that tell them apart."""
        base, place, group, last = -1, 0, 0, None  # the rank at hand, entries of it seen, rank of the subgroup at hand
        for keys, which in queue.take(self.block):
            old = (keys >> np.uint64(bits)).astype(np.int64)
            fresh = np.concatenate([[old[0] != base], old[1:] != old[:-1]])
            index = np.arange(len(keys))
            start = np.maximum.accumulate(np.where(fresh, index, 0))
            seen = index - start + np.where(start == 0, 0 if fresh[0] else place, 0)
            new = np.concatenate([[last is None or keys[0] != last], keys[1:] != keys[:-1]])
            begins = np.flatnonzero(new)
            value = old + seen
            current = np.where(np.cumsum(new) > 0, value[begins[np.maximum(np.cumsum(new) - 1, 0)]] if len(begins) else 0, group)
            size[value[begins]] = 0
            np.add.at(size, current, 1)
            rank[which] = current
            base, place, group, last = int(old[-1]), int(seen[-1]) + 1, int(current[-1]), keys[-1]

    def _doubled(self, rank: np.ndarray, size: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """_told_apart and _equal_names by sorted runs, in blocks: the reduced text's suffixes in order, and how many ranks each shares with the one before."""
        m, step = len(rank), 1
        kept = scratch(m, self.place, self.limit)
        for a in range(0, m, self.block):
            kept[a : a + self.block] = rank[a : a + self.block]
        while step < m:
            queue, any_ = Runs(self.limit // 4), False
            for a in range(0, m, self.block):
                r = np.asarray(rank[a : a + self.block], np.int64)
                tied = np.flatnonzero(np.asarray(size[r]) > 1)
                far = np.minimum(a + tied + step, m - 1)
                on = (np.asarray(lms[far], np.int64) - lms[a + tied] < self.depth) & (a + tied + step < m)  # ties beyond the depth don't matter
                tied, far = tied[on], far[on]
                if len(tied):
                    any_ = True
                    queue.put((r[tied].astype(np.uint64) << np.uint64(32)) | np.asarray(rank[far]).astype(np.uint64), (a + tied).astype(self.place))
            if not any_:
                break
            self._regrouped(queue, 32, rank, size)
            step *= 2
        queue, order, at = Runs(self.limit // 4), scratch(m, self.place, self.limit), 0
        for a in range(0, m, self.block):
            part = np.array(rank[a : a + self.block])
            queue.put(part, np.arange(a, a + len(part), dtype=self.place))
        for _, which in queue.take(self.block):
            order[at : at + len(which)] = which
            at += len(which)
        shared = scratch(m, np.uint8, self.limit)
        for a in range(1, m, self.block):
            one, two = np.asarray(order[a - 1 : a - 1 + self.block], np.int64)[: m - a], np.asarray(order[a : a + self.block], np.int64)
            shared[a : a + self.block] = _equal_names(kept, one[: len(two)], two, lms, self.depth)
        return order, shared

    def _lms_order(self, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """LMS suffixes in ascending order, and how many letters each shares with the one before."""
        m = len(lms)
        rank, size, tied = self._ranks(lms)
        order, shared = scratch(m, self.place, self.limit), None
        if not tied:
            for a in range(0, m, self.block):
                order[rank[a : a + self.block]] = np.arange(a, min(m, a + self.block))
        elif m * _ENTRY <= self.limit:
            order[:] = np.argsort(_told_apart(np.asarray(rank, np.int64), np.asarray(lms), self.depth), kind="stable")
            shared = np.zeros(m, np.int64)
            shared[1:] = _equal_names(rank, order[:-1], order[1:], lms, self.depth)
        elif m * _ENTRY <= self.limit * DOUBLED:
            order, shared = self._doubled(rank, size, lms)
        else:
            inner = Sort(rank, min(254, self.depth // 2 + 1), self.limit, m)
            shared, at = scratch(m, np.uint8, self.limit), m
            for places, links in inner.descending():
                order[at - len(places) : at] = places[::-1]
                # a value tells of the suffix given before, the greater one, which stands one place on
                shared[at - len(places) + 1 : at] = links[1:][::-1]
                if at < m:
                    shared[at] = links[0]
                at -= len(places)
            self.levels = 1 + inner.levels
        sorted_, links = scratch(m, self.place, self.limit), scratch(m, np.uint8, self.limit)
        for a in range(0, m, self.block):
            part = np.asarray(order[max(0, a - 1) : a + self.block], np.int64)
            skip = np.asarray(shared[a : a + self.block], np.int64) if shared is not None else np.zeros(len(part) - (a > 0), np.int64)
            places = np.asarray(lms[part], np.int64)
            if a == 0:
                sorted_[: self.block] = places
                skip, one, two, at = skip[1:], part[:-1], part[1:], 1
            else:
                sorted_[a : a + self.block] = places[1:]
                one, two, at = part[:-1], part[1:], a
            far = np.asarray(lms[np.minimum(two + skip, m - 1)], np.int64) - np.asarray(lms[two], np.int64)
            links[at : at + len(two)] = self._compared(np.asarray(lms[one], np.int64), np.asarray(lms[two], np.int64), far)
        return sorted_, links

    def _compared(self, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> np.ndarray:
        """How many letters the suffixes at a and b share, up to the depth, of which `known` are known."""
        out = np.minimum(known, self.depth)
        left = np.flatnonzero(out < self.depth)
        while len(left):
            k = out[left]
            left = left[self.text[a[left] + k] == self.text[b[left] + k]]  # the last letter is unique: no place is passed
            out[left] += 1
            left = left[out[left] < self.depth]
        return out

    # ----------------------------------------------------------------- induction

    def _before(self, at: np.ndarray) -> np.ndarray:
        """The letters before `at`, nearest lowest; what lies above them are ones, which stand for letters not carried."""
        word = np.full(len(at), -1, np.int64)
        for k in range(self.carried, 0, -1):
            letter = np.where(at >= k, self.text[np.maximum(at - k, 0)], self.mask).astype(np.int64)
            word = (word << self.bits) | letter
        return word

    def _induced(self, scan: _Scan, sign: int, letter: int, at, word, link, own: bool):
        """(letters, tuples) of the predecessors that a block of one letter induces, by letter. own: also those with the same letter."""
        before = word & self.mask
        out = np.flatnonzero((before == self.mask) & (at > 0))
        if len(out):
            word = word.copy()
            word[out] = self._before(at[out])
            before[out] = word[out] & self.mask
        keep = (at > 0) & ((before >= letter if own else before > letter) if sign > 0 else (before <= letter if own else before < letter))
        kept = np.flatnonzero(keep)
        letters = before[kept].astype(np.uint16 if self.bits <= 16 else np.int64)
        by = np.argsort(letters, kind="stable")
        kept, letters = kept[by], letters[by]
        values = scan.values(link, kept, letters)
        return letters, ((at[kept] - 1).astype(self.place), word[kept] >> self.bits, values)

    def _ascend(self, order: np.ndarray, links: np.ndarray) -> Stack:
        """L-type suffixes from the LMS ones: (position, letters before, prefix value), ascending."""
        queue, scan, large = Queues(1, self.limit // 4, self.width), _Scan(self), Stack(self.limit // 4, self.block)
        m, k = len(order), 0
        while k < m or queue.first() is not None:
            letter = queue.first()
            seed = int(self.text[order[k]]) if k < m else None
            if letter is None or (seed is not None and seed < letter):
                letter = seed
            last = None
            while (found := queue.take(letter, self.block)) is not None:
                at, word, link = found
                at = at.astype(np.int64)
                last = int(at[-1])
                large.push(letter, found)
                queue.deal(*self._induced(scan, 1, letter, at, word, link, True))
            queue.done(letter)
            while k < m and seed == letter:
                at = np.asarray(order[k : k + self.block], np.int64)
                other = np.flatnonzero(self.text[at] != letter)
                at = at[: other[0]] if len(other) else at
                link = np.array(links[k : k + len(at)])
                if last is not None:
                    link[0] = self._compared(np.array([last]), at[:1], np.zeros(1, np.int64))[0]
                    last = None
                queue.deal(*self._induced(scan, 1, letter, at, self._before(at), link, True))
                k += len(at)
                seed = int(self.text[order[k]]) if k < m else None
        return large

    def _descend(self, large: Stack):
        """All suffixes, greatest first: S-type ones are induced, L-type ones taken back."""
        queue, scan = Queues(-1, self.limit // 4, self.width), _Scan(self)
        while queue.first() is not None or large.letter() is not None:
            letter = max(x for x in (queue.first(), large.letter()) if x is not None)
            last, later = None, 0
            while (found := queue.take(letter, self.block)) is not None:
                at, word, link = found
                at = at.astype(np.int64)
                last = int(at[-1])
                yield at, link
                queue.deal(*self._induced(scan, -1, letter, at, word, link, True))
            while large.letter() == letter:
                at, word, link = large.pop()
                at = at.astype(np.int64)
                if last is not None:
                    later = self._compared(np.array([last]), at[:1], np.zeros(1, np.int64))[0]
                    last = None
                # a value tells of the entry before in ascending order: it belongs to the next one here
                shifted = np.concatenate([np.array([later], np.uint8), link[:-1]])
                later = link[-1]
                yield at, shifted
                queue.deal(*self._induced(scan, -1, letter, at, word, shifted, False))
            queue.done(letter)
        yield np.array([len(self.text) - 1]), np.zeros(1, np.uint8)


class _Scan:
    """Prefix values of induced entries: one more than the least value scanned since the letter's last entry."""

    def __init__(self, sort: Sort):
        self.depth, self.at = sort.depth, 0
        self.entry = scratch(sort.mask + 1, np.int64, sort.limit)
        self.entry[:] = -1
        #: For each value, the last place of the scan with that value or less.
        self.last = np.full(sort.depth + 1, -1, np.int64)

    def values(self, link: np.ndarray, kept: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """link: values of the block scanned; kept: places in it that induce an entry, by letter. The values of those entries."""
        n = len(link)
        least = np.zeros(len(kept), np.int64)
        if len(kept):
            first = np.concatenate([[True], letters[1:] != letters[:-1]])
            within = np.flatnonzero(~first)
            if len(within):
                least[within] = _range_min(link, kept[within - 1] + 1, kept[within])
            begin = np.flatnonzero(first)
            known = letters[begin]
            before = self.entry[known]
            earlier = np.searchsorted(self.last, before, side="right")  # the least value since, in the blocks before
            value = np.minimum(earlier, np.minimum.accumulate(link)[kept[begin]])
            least[begin] = np.where(before < 0, -1, value)
            ends = np.concatenate([begin[1:], [len(kept)]]) - 1
            self.entry[known] = self.at + kept[ends]
        seen = np.full(self.depth + 1, -1, np.int64)
        seen[link] = np.arange(self.at, self.at + n)
        self.last = np.maximum(self.last, np.maximum.accumulate(seen))
        self.at += n
        return np.minimum(least + 1, self.depth).astype(np.uint8)


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo..hi], both included, for each pair: minima of stretches of doubling length."""
    span = hi - lo + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out, table = np.empty(len(lo), values.dtype), values
    for k in range(int(level.max()) + 1):
        mine = np.flatnonzero(level == k)
        out[mine] = np.minimum(table[lo[mine]], table[hi[mine] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def _equal_names(rank: np.ndarray, one: np.ndarray, two: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """How many ranks the reduced text's suffixes at one and two share, as far as the depth asks."""
    m = len(rank)
    out = np.zeros(len(two), np.int64)
    left = np.arange(len(two))
    while len(left):
        a, b = one[left] + out[left], two[left] + out[left]
        same = (a < m) & (b < m)
        left, a, b = left[same], a[same], b[same]
        left = left[rank[a] == rank[b]]
        out[left] += 1
        far = np.minimum(two[left] + out[left], m - 1)
        left = left[lms[far] - lms[two[left]] < depth]
    return out


def _told_apart(rank: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the reduced text's suffixes, in memory: ranks of twice as many names at each level, of tied suffixes only."""
    m, step = len(rank), 1
    while True:
        tied = np.flatnonzero(np.bincount(rank, minlength=m + 1)[rank] > 1)
        far = np.minimum(tied + step, m - 1)
        tied = tied[(lms[far] - lms[tied] < depth) & (tied + step < m)]  # ties beyond the depth don't matter
        if not len(tied) or step >= m:
            return rank
        follow = rank[tied + step]
        at = np.argsort(rank[tied] * np.int64(m + 1) + follow + 1, kind="stable")
        a, f, r = tied[at], follow[at], rank[tied][at]
        new_group = np.concatenate([[True], r[1:] != r[:-1]])
        first = np.maximum.accumulate(np.where(new_group, np.arange(len(a)), 0))
        changed = np.concatenate([[True], (r[1:] != r[:-1]) | (f[1:] != f[:-1])])
        place = np.maximum.accumulate(np.where(changed, np.arange(len(a)), 0))
        rank = rank.copy()
        rank[a] = r + (place - first)
        step *= 2


def suffix_array(text: np.ndarray, depth: int = 64, limit: int = 256 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all suffixes of a text in order, exact in `depth` letters, and how many letters (up to depth) each shares with the one before."""
    t = np.concatenate([text.astype(np.int64) + 1, [0]])
    found = list(Sort(t.astype(np.uint16 if t.max() < 1 << 16 else np.int64), depth, limit, int(t.max())).descending())
    order = np.concatenate([x for x, _ in found])[::-1]
    later = np.concatenate([x for _, x in found])[::-1]
    return order[1:], np.concatenate([[0], later[1:-1]])[: len(order) - 1]
