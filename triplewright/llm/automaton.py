"""Suffix automata over words, and the matching statistics of a text against one."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator


class SuffixAutomaton:
    """Accepts every run of words within any of its passages, and none across two."""

    def __init__(self, passages: Iterable[list[Hashable]] = ()) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size, self.last = [-1], [0], 0
        for i, words in enumerate(passages):
            for w in words:
                self._extend(w)
            self._extend((i,))  # a mark that is no word

    def _extend(self, w: Hashable) -> None:
        nxt, link, size = self.next, self.link, self.size
        new, p = len(nxt), self.last
        nxt.append({})
        link.append(0)
        size.append(size[p] + 1)
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(nxt)
                nxt.append(nxt[q].copy())
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = copy
                    p = link[p]
                link[q] = link[new] = copy
        self.last = new

    def statistics(self, words: Iterable[Hashable]) -> Iterator[int]:
        """At each word, the length of the longest run ending there that some passage holds."""
        nxt, link, size = self.next, self.link, self.size
        at = length = 0
        for w in words:
            while at and w not in nxt[at]:
                at = link[at]
                length = size[at]
            if w in nxt[at]:
                at = nxt[at][w]
                length += 1
            yield length

    def spans(self, words: list[Hashable], least: int) -> list[tuple[int, int]]:
        """The maximal runs of ``least`` or more words that some passage holds, overlapping ones merged: [start, end)."""
        out: list[tuple[int, int]] = []
        for i, n in enumerate(self.statistics(words)):
            if n >= least:
                start = i + 1 - n
                if out and out[-1][1] >= start:
                    out[-1] = (min(out[-1][0], start), i + 1)
                else:
                    out.append((start, i + 1))
        return out
