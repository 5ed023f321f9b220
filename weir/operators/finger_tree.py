"""A finger B-tree of partial aggregates keyed by event time.

Leaves hold sorted keys, each with its partial (sum, count). Every inner node holds the partial of
its whole subtree. A finger points at the rightmost leaf, so keys in order are appended without a
descent; a late key descends from the root and updates the partials on its path. ``evict_below``
drops whole subtrees left of the cut-off by their totals and descends only along the boundary.

``insert`` tells what became of a key: refused below the cut-off, late below what was closed, or taken
in order.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

FANOUT = 32
TAKEN, LATE, REFUSED = 0, 1, 2


class _Node:
    __slots__ = ("children", "count", "counts", "keys", "leaf", "sums", "total")

    def __init__(self, leaf: bool) -> None:
        self.leaf = leaf
        self.keys: list[int] = []  # leaf: the keys; inner: the lowest key of each child
        self.children: list[_Node] = []
        self.sums: list[int] = []
        self.counts: list[int] = []
        self.total = 0
        self.count = 0

    def recount(self) -> None:
        if self.leaf:
            self.total, self.count = sum(self.sums), sum(self.counts)
        else:
            self.total = sum(c.total for c in self.children)
            self.count = sum(c.count for c in self.children)


class FingerBTree:
    """Partial aggregates (sum, count) of whole numbers by key."""

    def __init__(self) -> None:
        self._root = _Node(leaf=True)
        self._spine: list[_Node] = [self._root]  # from the root to the finger leaf
        self.floor: int | None = None  # keys below were cut off
        self.closed: int | None = None  # keys below lie in what was closed

    def __len__(self) -> int:
        return self._root.count

    @property
    def total(self) -> tuple[int, int]:
        return self._root.total, self._root.count

    @property
    def least(self) -> int | None:
        return self._root.keys[0] if self._root.keys else None

    def cut_off(self, low: int) -> None:
        """Keys below ``low`` are refused from now on; those held stay until ``evict_below``."""
        if self.floor is None or low > self.floor:
            self.floor = low

    def close(self, below: int) -> None:
        """Keys below ``below`` are late from now on."""
        if self.closed is None or below > self.closed:
            self.closed = below

    def insert(self, key: int, amount: int, count: int = 1) -> int:
        """Adds a partial at ``key``: TAKEN, LATE (taken below what was closed) or REFUSED."""
        if self.floor is not None and key < self.floor:
            return REFUSED
        finger = self._spine[-1]
        if not finger.keys or key >= finger.keys[0]:
            path = self._spine
        else:
            path = self._descend(key)
        for node in path:
            node.total += amount
            node.count += count
        leaf = path[-1]
        at = bisect_left(leaf.keys, key)
        if at < len(leaf.keys) and leaf.keys[at] == key:
            leaf.sums[at] += amount
            leaf.counts[at] += count
        else:
            leaf.keys.insert(at, key)
            leaf.sums.insert(at, amount)
            leaf.counts.insert(at, count)
            if at == 0:
                self._lower(path, key)
            if len(leaf.keys) > FANOUT:
                self._split(path)
        return LATE if self.closed is not None and key < self.closed else TAKEN

    def range(self, low: int, high: int) -> tuple[int, int]:
        """The (sum, count) of low <= key < high."""
        total, count, todo = 0, 0, [(self._root, None)]
        while todo:
            node, upper = todo.pop()
            if not node.keys or node.keys[0] >= high:
                continue
            if node.keys[0] >= low and upper is not None and upper <= high:
                total += node.total
                count += node.count
            elif node.leaf:
                for i in range(bisect_left(node.keys, low), bisect_left(node.keys, high)):
                    total += node.sums[i]
                    count += node.counts[i]
            else:
                first = max(0, bisect_right(node.keys, low) - 1)
                for i in range(first, bisect_left(node.keys, high)):
                    todo.append((node.children[i], node.keys[i + 1] if i + 1 < len(node.keys) else upper))
        return total, count

    def evict_below(self, low: int) -> tuple[int, int]:
        """Removes keys < ``low``, refuses them from now on, and returns the (sum, count) that left.

        Subtrees wholly below the cut-off leave in one step, by their totals.
        """
        self.cut_off(low)
        node, path = self._root, []
        if not node.keys or node.keys[0] >= low:
            return 0, 0
        held = self.total
        while True:
            path.append(node)
            if node.leaf:
                cut = bisect_left(node.keys, low)
                del node.keys[:cut], node.sums[:cut], node.counts[:cut]
                break
            keep = max(0, bisect_right(node.keys, low) - 1)
            del node.children[:keep], node.keys[:keep]
            node = node.children[0]
        for above in range(len(path) - 1, -1, -1):
            node = path[above]
            if not node.leaf:
                if not path[above + 1].keys:
                    del node.children[0], node.keys[0]
                elif node.keys:
                    node.keys[0] = path[above + 1].keys[0]
            node.recount()
        while not self._root.leaf and len(self._root.children) <= 1:
            self._root = self._root.children[0] if self._root.children else _Node(leaf=True)
        self._find_finger()
        return held[0] - self._root.total, held[1] - self._root.count

    def _descend(self, key: int) -> list[_Node]:
        node, path = self._root, [self._root]
        while not node.leaf:
            node = node.children[max(0, bisect_right(node.keys, key) - 1)]
            path.append(node)
        return path

    @staticmethod
    def _lower(path: list[_Node], key: int) -> None:
        for i in range(len(path) - 2, -1, -1):
            at = next(j for j, c in enumerate(path[i].children) if c is path[i + 1])
            path[i].keys[at] = key
            if at:
                break

    def _split(self, path: list[_Node]) -> None:
        for depth in range(len(path) - 1, -1, -1):
            node = path[depth]
            if len(node.keys) <= FANOUT:
                break
            half = len(node.keys) // 2
            right = _Node(node.leaf)
            right.keys = node.keys[half:]
            del node.keys[half:]
            if node.leaf:
                right.sums, right.counts = node.sums[half:], node.counts[half:]
                del node.sums[half:], node.counts[half:]
            else:
                right.children = node.children[half:]
                del node.children[half:]
            node.recount()
            right.recount()
            if depth:
                parent = path[depth - 1]
                at = next(j for j, c in enumerate(parent.children) if c is node) + 1
                parent.children.insert(at, right)
                parent.keys.insert(at, right.keys[0])
            else:
                root = _Node(leaf=False)
                root.children, root.keys = [node, right], [node.keys[0], right.keys[0]]
                root.recount()
                self._root = root
        self._find_finger()

    def _find_finger(self) -> None:
        node, self._spine = self._root, [self._root]
        while not node.leaf:
            node = node.children[-1]
            self._spine.append(node)

