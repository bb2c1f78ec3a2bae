"""A compressed radix trie over byte strings whose terminal nodes merge what equal keys bring."""

from __future__ import annotations

from collections.abc import Callable, Iterator


class _Node:
    __slots__ = ("label", "children", "value")

    def __init__(self, label: bytes, value=None) -> None:
        self.label, self.children, self.value = label, {}, value


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``, by halving."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """``add(key, value)`` merges the values of equal keys; ``bytes_held`` is the size of its labels."""

    def __init__(self, merge: Callable) -> None:
        self.root, self.merge, self.bytes_held, self.keys = _Node(b""), merge, 0, 0

    def add(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = _Node(key[at:], value)
                self._grown(len(key) - at)
                return
            shared = len(child.label) if key.startswith(child.label, at) else _common(child.label, key, at)
            if shared < len(child.label):
                above = _Node(child.label[:shared])
                child.label = child.label[shared:]
                above.children[child.label[0]] = child
                node.children[key[at]] = child = above
            node, at = child, at + shared
        if node.value is None:
            node.value = value
            self._grown(0)
        else:
            node.value = self.merge(node.value, value)

    def _grown(self, size: int) -> None:
        self.keys += 1
        self.bytes_held += size + 200

    def items(self) -> Iterator[tuple[bytes, object]]:
        """Every key with its merged value, subtree after subtree."""
        stack = [(self.root, b"")]
        while stack:
            node, prefix = stack.pop()
            key = prefix + node.label
            if node.value is not None:
                yield key, node.value
            stack.extend((child, key) for child in node.children.values())
