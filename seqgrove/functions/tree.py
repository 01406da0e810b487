"""Trees of the paths from the root to terms through their common ancestor."""

from __future__ import annotations

from collections import deque


def path_from_root(parents: dict[str, list[str]], target: str, root: str) -> list[str]:
    """A shortest path, parents tried in order of id."""
    came: dict[str, str | None] = {target: None}
    todo = deque([target])
    while todo:
        t = todo.popleft()
        if t == root:
            out = []
            while t is not None:
                out.append(t)
                t = came[t]
            return out
        for p in sorted(parents.get(t, ())):
            if p not in came:
                came[p] = t
                todo.append(p)
    return [target]


def render(paths: list[list[str]], label, style: str = "unicode") -> list[str]:
    """The union of paths as a tree; label(term) gives a line's text."""
    tee, last, bar, gap = ("├── ", "└── ", "│   ", "    ") if style == "unicode" else ("|- ", "`- ", "|  ", "   ")
    tree: dict = {}
    for path in paths:
        at = tree
        for t in path:
            at = at.setdefault(t, {})

    def lines(node: dict, lead: str):
        for i, (t, below) in enumerate(node.items()):
            end = i == len(node) - 1
            yield f"{lead}{last if end else tee}{label(t)}"
            yield from lines(below, lead + (gap if end else bar))

    return list(lines(tree, ""))
