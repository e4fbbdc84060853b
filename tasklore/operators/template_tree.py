"""Fixed-depth template tree (He et al., "Drain: An Online Log Parsing Approach with Fixed Depth Tree", ICWS 2017).

A small in-task helper: Spark partitions the lines, and one tree only ever sees the lines of one task or try. A tree can be forked (copies share
what neither changes), fed with texts and the positions at which they occur, saved, and grown further.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Sequence
from heapq import heapify, heappop, heappush
from operator import eq

WILDCARD = "<*>"
CREATED, CHANGED, NONE = "created", "changed", "none"
FEW_REPEATS = 4


class _Node:
    __slots__ = ("owner", "children", "members")

    def __init__(self, owner: object, children: dict | None = None, members: list[int] | None = None) -> None:
        self.owner = owner
        self.children: dict = {} if children is None else children
        self.members: list[int] = [] if members is None else members


class TemplateTree:
    """Feed token lists in order; each line lands in exactly one template.

    ``max_clusters`` bounds the number of templates by dropping the one not met for longest, counted in ``evicted``; by default none is dropped.
    """

    def __init__(self, depth: int = 4, similarity: float = 0.4, max_children: int = 100, max_clusters: int | None = None):
        self._settings = [depth, similarity, max_children, max_clusters]
        self._levels, self._similarity, self._fixed_children, self._max_clusters = depth - 3, similarity, max_children - 1, max_clusters
        self._owner = object()
        self._root = _Node(self._owner)
        self._next_id = 0
        self.evicted = 0
        self._shared: dict[int, tuple[list[str], int]] = {}  # id: (tokens, size), as at the last fork; never changed
        self._own: dict[int, tuple[list[str], int]] = {}  # those met since; in the order of their last line if the number is bounded

    def fork(self) -> TemplateTree:
        """An independent tree in the same state. Both copy a node or an entry when they first change it."""
        twin = TemplateTree.__new__(TemplateTree)
        if self._max_clusters is None and self._own:
            self._shared, self._own = {**self._shared, **self._own}, {}
        twin.__dict__.update(self.__dict__)
        twin._own = dict(self._own)
        self._owner, twin._owner = object(), object()
        return twin

    def add(self, tokens: list[str], weight: int = 1) -> tuple[str, int]:
        """Outcome of a line (or of so many equal ones in a row) and the id of its template."""
        match = self._best(self._leaf(tokens), tokens)
        if match is None:
            return CREATED, self._create(tokens, weight)
        old, size = self._entry(match)
        merged = old if old == tokens else [one if one == new else WILDCARD for one, new in zip(old, tokens, strict=True)]
        self._put(match, merged, size + weight)
        return NONE if merged == old else CHANGED, match

    def feed(self, lines: Iterable[tuple[str, Sequence[int]]]) -> list[int]:
        """Add texts that occur at the given ascending positions, as if line by line in the order of positions.

        Returns the positions of the lines that opened a template. What a text does depends on the templates of its leaf alone, so
        it is looked at again only after one of them has changed, or after the way to its leaf has; the occurrences in
        between are counted. A bounded tree depends on the order of all lines and takes them one by one, as does one whose texts
        hardly repeat: keeping account of what to look at again would cost more than it saves.
        """
        texts = [(text.split(" ") if text else [], places) for text, places in lines]
        if self._max_clusters is not None or sum(len(places) for _, places in texts) <= FEW_REPEATS * len(texts):
            ordered = sorted((place, number) for number, (_, places) in enumerate(texts) for place in places)
            return [place for place, number in ordered if self.add(texts[number][0])[0] == CREATED]
        created: list[int] = []
        counted, template = [0] * len(texts), [-1] * len(texts)
        at_leaf: dict[tuple, set[int]] = defaultdict(set)
        by_wildcard: dict[tuple, set[int]] = defaultdict(set)  # (way to a node, token): texts that lack a child of their own there
        due = [(places[0], number) for number, (_, places) in enumerate(texts) if len(places)]
        heapify(due)
        while due:
            place, number = heappop(due)
            tokens, places = texts[number]
            before = self._way(tokens)
            outcome, template[number] = self.add(tokens)
            counted[number] += 1
            way = self._way(tokens)
            at_leaf[way].add(number)
            for level, token in enumerate(tokens[: self._levels]):
                if way[level + 1] != token:
                    by_wildcard[way[: level + 1], token].add(number)
            if outcome == NONE:
                continue
            stirred = at_leaf.pop(way)
            if outcome == CREATED:
                created.append(place)
                known = next((level for level, (old, new) in enumerate(zip(before, way)) if old != new), len(before))
                for level in range(known, len(way)):  # the new children
                    stirred |= by_wildcard.pop((way[:level], way[level]), set())
            for other in stirred:
                self._count(template[other], texts[other][1], counted, other, place)
                if counted[other] < len(texts[other][1]):
                    heappush(due, (texts[other][1][counted[other]], other))
                self._forget(other, texts[other][0], at_leaf, by_wildcard)
        for number, (_, places) in enumerate(texts):
            if len(places):
                self._count(template[number], places, counted, number, places[-1])
        return created

    def templates(self) -> list[tuple[int, str, int]]:
        """(id, template, size) in creation order."""
        return [(key, " ".join(tokens), size) for key, (tokens, size) in sorted({**self._shared, **self._own}.items())]

    def save(self) -> bytes:
        """The whole state; a loaded tree goes on as this one would."""
        def nodes(node: _Node) -> list:
            return [[[key, nodes(child)] for key, child in node.children.items()], node.members]

        entries = [[key, " ".join(tokens), size] for key, (tokens, size) in {**self._shared, **self._own}.items()]
        return zlib.compress(json.dumps([self._settings, self._next_id, self.evicted, entries, nodes(self._root)]).encode())

    @classmethod
    def load(cls, state: bytes) -> TemplateTree:
        settings, next_id, evicted, entries, root = json.loads(zlib.decompress(state))
        tree = cls(*settings)

        def node(saved: list) -> _Node:
            children, members = saved
            return _Node(tree._owner, {key: node(child) for key, child in children}, members)

        tree._next_id, tree.evicted, tree._root = next_id, evicted, node(root)
        tree._own = {key: (text.split(" ") if text else [], size) for key, text, size in entries}
        return tree

    def _count(self, key: int, places: Sequence[int], counted: list[int], number: int, upto: int) -> None:
        """Count the occurrences of a text up to a position for its template."""
        now = bisect_right(places, upto)
        if now > counted[number]:
            tokens, size = self._entry(key)
            self._put(key, tokens, size + now - counted[number])
            counted[number] = now

    def _forget(self, number: int, tokens: list[str], at_leaf: dict, by_wildcard: dict) -> None:
        # A new child may lie on the way by now; the old way differs from it in wildcards only.
        ways: list[tuple] = [(len(tokens),)]
        for token in tokens[: self._levels]:
            for way in ways:
                if (way, token) in by_wildcard:
                    by_wildcard[way, token].discard(number)
            ways = [(*way, name) for way in ways for name in {token, WILDCARD}]
        for way in ways:
            if way in at_leaf:
                at_leaf[way].discard(number)

    def _entry(self, key: int) -> tuple[list[str], int] | None:
        return self._own.get(key) or self._shared.get(key)

    def _put(self, key: int, tokens: list[str], size: int) -> None:
        if self._max_clusters is not None:
            self._own.pop(key, None)
        self._own[key] = (tokens, size)

    def _way(self, tokens: list[str]) -> tuple:
        """Names of the nodes to the leaf of a line, as far as they exist."""
        node, way = self._root.children.get(len(tokens)), ()
        if node is not None:
            way = (len(tokens),)
            for token in tokens[: self._levels]:
                name = token if token in node.children else WILDCARD
                node = node.children.get(name)
                if node is None:
                    break
                way = (*way, name)
        return way

    def _leaf(self, tokens: list[str]) -> _Node | None:
        node = self._root.children.get(len(tokens))
        for token in tokens[: self._levels]:
            if node is None:
                return None
            node = node.children.get(token) or node.children.get(WILDCARD)
        return node

    def _best(self, leaf: _Node | None, tokens: list[str]) -> int | None:
        best, best_rank, literal = None, (self._similarity, -1), WILDCARD in tokens
        for key in leaf.members if leaf else ():
            entry = self._entry(key)
            if entry is None:
                continue
            template = entry[0]
            same = sum(map(eq, template, tokens))
            if literal:
                same -= sum(1 for old, new in zip(template, tokens, strict=True) if old == new == WILDCARD)
            share = same / len(tokens) if tokens else 1.0
            if share < best_rank[0]:
                continue
            rank = (share, template.count(WILDCARD))
            if rank > best_rank:
                best, best_rank = key, rank
        return best

    def _owned(self, parent: _Node, key) -> _Node:
        """A child that this tree may change."""
        child = parent.children.get(key)
        if child is None:
            child = parent.children[key] = _Node(self._owner)
        elif child.owner is not self._owner:
            child = parent.children[key] = _Node(self._owner, dict(child.children), list(child.members))
        return child

    def _create(self, tokens: list[str], weight: int) -> int:
        if self._root.owner is not self._owner:
            self._root = _Node(self._owner, dict(self._root.children), list(self._root.members))
        node = self._owned(self._root, len(tokens))
        for token in tokens[: self._levels]:
            node = self._owned(node, self._name(node, token))
        key = self._next_id
        self._next_id += 1
        if self.evicted:
            node.members = [member for member in node.members if self._entry(member) is not None]
        node.members.append(key)
        self._put(key, list(tokens), weight)
        if self._max_clusters is not None and len(self._own) > self._max_clusters:
            del self._own[next(iter(self._own))]
            self.evicted += 1
        return key

    def _name(self, node: _Node, token: str) -> str:
        if token in node.children:
            return token
        fixed = len(node.children) - (WILDCARD in node.children)
        has_digit = any(ch.isdigit() for ch in token)
        return token if not has_digit and fixed < self._fixed_children else WILDCARD
