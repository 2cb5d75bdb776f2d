"""What a build has left behind: listings of a class path and folders of compiled classes. One walk finds candidates,
one merge makes them a class path. This engine reads sources only; the class path tells how much of what they refer
to is at hand, and goes to tools that want it."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

DEEPEST = 3
# Where build tools put what they make, and how a listing in there may be called.
BUILD_FOLDERS = ("target", "build")
OUTPUTS = ("classes", "test-classes", "classes/java/main", "classes/java/test")
LISTING = re.compile(r"(?:.*\.)?classpath(?:\.txt)?$")


@dataclass(frozen=True)
class ClassPath:
    entries: tuple[str, ...] = ()
    listings: tuple[str, ...] = ()

    def report(self, root: str) -> str:
        told = ", ".join(os.path.relpath(x, root) for x in self.listings) or "output folders only"
        return f"class path: {len(self.entries)} entries ({told})" if self.entries else "class path: none; let the build write one to build/classpath.txt for the types of its libraries"


def candidates(root: str) -> Iterator[tuple[int, str, str]]:
    """(depth, what, path) of listings and folders of classes, DEEPEST folders down, in order of path."""
    for folder, inner, files in os.walk(root):
        depth = 0 if folder == root else os.path.relpath(folder, root).count(os.sep) + 1
        for build in [x for x in BUILD_FOLDERS if x in inner]:
            own = os.path.join(folder, build)
            yield from ((depth, "listing", os.path.join(own, f)) for f in sorted(os.listdir(own)) if LISTING.match(f))
            yield from ((depth, "classes", p) for o in OUTPUTS if os.path.isdir(p := os.path.join(own, o)))
        inner[:] = sorted(x for x in inner if depth < DEEPEST and x not in BUILD_FOLDERS and x != "src" and not x.startswith("."))


def discover(root: str) -> ClassPath:
    """The class path of a repository: what its own listing says or, without one, its modules' listings, and all
    folders of classes; entries that don't exist are left out."""
    found = sorted(candidates(root))
    nearest = min((d for d, what, _ in found if what == "listing"), default=0)
    listings = [p for d, what, p in found if what == "listing" and (nearest > 0 or d == 0)]
    entries: list[str] = []
    for path in listings:
        with open(path, encoding="utf-8") as f:
            entries += re.split(rf"[{re.escape(os.pathsep)}\r\n]+", f.read().strip())
    entries += [p for _, what, p in found if what == "classes"]
    return ClassPath(tuple(e for e in dict.fromkeys(x.strip() for x in entries) if e and os.path.exists(e)), tuple(listings))
