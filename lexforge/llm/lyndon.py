"""Suffix arrays in linear time by Lyndon-prefix groups, for many strings at once.

Suffixes are grouped by their longest Lyndon prefixes.  Pass one takes a string's groups in
descending order: each member points to the nearest suffix before it in a smaller group, and
suffixes pointed to move to new groups right above their own, the more pointers the higher.  Pass
two emits the order from its lowest place: the suffixes whose Lyndon prefix ends where an emitted
suffix begins go to the next places of their groups.  Nothing is renamed or sorted again.

The passes are sequential within a string, so all strings take their steps together: a round
handles the highest open group of every string by a handful of array operations.
"""

from __future__ import annotations

import numpy as np

from lexforge.llm.bytesview import ragged

#: Symbols that are worked on at once: enough that a round's calls pay, few enough for the cache.
BATCH = 1 << 21


def suffix_arrays(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The order of the suffixes of each of the strings that stand one after another in ``symbols`` (whole numbers below 2**16); suffixes are named by their places there.

    A suffix ends with its string; a shorter suffix comes before its extensions.
    """
    sizes = np.asarray(sizes, np.int64)
    start = np.cumsum(sizes) - sizes
    out = np.zeros(len(symbols), np.int32 if len(symbols) < 1 << 31 else np.int64)
    # Strings of like size go together: the last rounds of a batch are those of its longest string.
    by_size = np.argsort(sizes, kind="stable")
    by_size = by_size[sizes[by_size] > 0]
    batch = np.cumsum(sizes[by_size]) // BATCH
    for mine in np.split(by_size, np.flatnonzero(np.diff(batch)) + 1) if len(by_size) else []:
        places = ragged(start[mine], sizes[mine])
        state = _Groups(symbols[places], sizes[mine])
        state.group_all()
        out[places] = places[state.emitted()]
    return out


class _Groups:
    """Groups are ranges of ``order``, named by their first place; ``top`` is one past their last.  Every string has an empty place before it, of a group below all others."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray):
        self.strings, n = len(sizes), int(sizes.sum())
        string = np.repeat(np.arange(self.strings), sizes)
        if self.strings > 65536:
            raise ValueError("too many strings in a batch")
        self.where = np.arange(n) + string + 1  # from the places of symbols to those in here
        self.begin = np.cumsum(sizes) - sizes + np.arange(self.strings) + 1
        self.end = self.begin + sizes
        total = n + self.strings
        # By string, then symbol: two stable sorts of 16 bits, which count instead of comparing.
        sort = np.argsort(symbols.astype(np.uint16), kind="stable")
        sort = sort[np.argsort(string.astype(np.uint16)[sort], kind="stable")]
        key = string[sort] * 65536 + symbols[sort]
        head = np.ones(n, bool)
        head[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(head)
        first = self.where[starts]
        run = np.diff(np.append(starts, n))
        self.order, self.place = np.zeros(total, np.int32), np.zeros(total, np.int32)
        self.group, self.top = np.full(total, -1, np.int32), np.zeros(total, np.int32)
        self.order[self.where] = self.where[sort]
        self.place[self.where[sort]] = self.where
        self.group[self.where[sort]] = np.repeat(first, run)
        self.top[first] = first + run
        self.smaller = np.zeros(total, np.int32)
        self.targeted = np.zeros(total, bool)

    def group_all(self) -> None:
        """Pass one."""
        begin, end = self.begin, self.end.astype(np.int64)
        order, group = self.order, self.group
        while len(end):
            at = group.take(order.take(end - 1)).astype(np.int64)
            several = np.flatnonzero(end - at > 1)
            if len(several):
                single = np.ones(len(at), bool)
                single[several] = False
                low, size = at[several], (end - at)[several]
                single = at[single]
                self._move_one(self._point(order.take(single), single))
                members, floor = order.take(ragged(low, size)), np.repeat(low, size)
                self._move(self._point(members, floor, peers=True))
            else:
                self._move_one(self._point(order.take(at), at))
            end = at
            left = np.flatnonzero(end > begin)
            if len(left) < len(end):
                begin, end = begin[left], end[left]

    def _point(self, members: np.ndarray, floor: np.ndarray, peers: bool = False) -> np.ndarray:
        """Sets each member's nearest place before it in a group below its own; those of them that aren't before the string."""
        group, smaller = self.group, self.smaller
        to = members.astype(np.int64)
        to -= 1
        held = group.take(to)
        open_ = np.flatnonzero(held > floor)
        while len(open_):
            nxt = smaller.take(to[open_])
            to[open_] = nxt
            there = group.take(nxt)
            held[open_] = there
            open_ = open_[there > floor[open_]]
        smaller[members] = to
        if peers:  # a pointer may have met a member of the same group: follow that one's
            open_ = np.flatnonzero(held == floor)
            while len(open_):
                nxt = smaller.take(to[open_])
                to[open_] = nxt
                smaller[members[open_]] = nxt
                there = group.take(nxt)
                held[open_] = there
                open_ = open_[there == floor[open_]]
        return to[held >= 0]

    def _move_one(self, target: np.ndarray) -> None:
        """Targets of as many strings: each to the last place of its group, which becomes a group."""
        if not len(target):
            return
        order, place, top = self.order, self.place, self.top
        g = self.group.take(target)
        to, here = top.take(g), place.take(target)
        top[to - 1] = to  # the new group's end; of a group of one, this is the group itself
        to -= 1
        other = order.take(to)
        order[here], place[other] = other, here
        order[to], place[target] = target, to
        top[g] = np.where(g == to, to + 1, to)
        self.group[target] = to

    def _move(self, target: np.ndarray) -> None:
        """Targets to the ends of their groups, in order of their pointers; equal numbers make a group."""
        if not len(target):
            return
        target, pointers = np.unique(target, return_counts=True)
        g = self.group[target]
        sort = np.lexsort((pointers, g))
        target, pointers, g = target[sort], pointers[sort], g[sort]
        head = np.ones(len(g), bool)
        head[1:] = g[1:] != g[:-1]
        first = np.flatnonzero(head)
        moved = np.diff(np.append(first, len(g)))
        low = self.top[g[first]] - moved
        to, here = ragged(low, moved), self.place[target]
        self.targeted[target] = True
        there = self.order[to]
        out, holes = there[~self.targeted[there]], here[here < np.repeat(low, moved)]
        self.targeted[target] = False
        self.order[holes], self.place[out] = out, holes
        self.order[to], self.place[target] = target, to
        self.top[g[first]] = low
        head[1:] |= pointers[1:] != pointers[:-1]
        first = np.flatnonzero(head)
        fresh, size = to[first], np.diff(np.append(first, len(g)))
        self.group[target] = np.repeat(fresh, size)
        self.top[fresh] = fresh + size

    def emitted(self) -> np.ndarray:
        """Pass two."""
        group, smaller = self.group, self.smaller
        out, free = np.zeros(len(group), np.int32), np.arange(len(group), dtype=np.int32)
        done = np.zeros(len(group), bool)
        done[self.begin - 1] = True
        at, stop, suffix = self.begin - 1, self.end, self.end - 1
        while len(at):
            placed = done.take(suffix)
            placing = np.flatnonzero(~placed)
            if len(placing):
                s = suffix.take(placing)
                g = group.take(s).astype(np.int64)
                to = free.take(g).astype(np.int64)
                out[to] = s
                free[g] = to + 1
                done[s] = True
                before = smaller.take(s)
                suffix[placing] = before
                placed[placing] = done.take(before)
            nexts = np.flatnonzero(placed)
            if len(nexts):
                on = at.take(nexts)
                on += 1
                at[nexts] = on
                open_ = on < stop.take(nexts)
                if open_.all():
                    suffix[nexts] = out.take(on) - 1
                else:
                    suffix[nexts[open_]] = out.take(on[open_]) - 1
                    left = np.flatnonzero(at < stop)
                    at, stop, suffix = at[left], stop[left], suffix[left]
        back = np.zeros(len(group), np.int32)
        back[self.where] = np.arange(len(self.where), dtype=np.int32)
        return back[out[self.where]]
