"""Selection of links within one component: small state machines over the component's candidates.

Names in different components share no rank, so components are selected independently, each
in one task. Orders are fixed: names by (size descending, name), candidates by (coverage
descending, add descending, first source rank).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from typing import NamedTuple


class Link(NamedTuple):
    name: int
    add: int
    src_lo: int
    src_hi: int
    covered: tuple[int, ...]

    @property
    def cov(self) -> int:
        return len(self.covered)

    @property
    def source(self) -> range:
        return range(self.src_lo, self.src_hi)


class Component:
    """Candidates by name, sizes of names, names of source ranks, and the state of a selection."""

    def __init__(self, links: list[Link], sizes: dict[int, int], source_name: dict[int, int], least: int):
        self.sizes, self.source_name, self.least = sizes, source_name, least
        self.options: dict[int, list[Link]] = defaultdict(list)
        for link in sorted(links, key=lambda x: (x.name, -x.cov, -x.add, x.src_lo)):
            self.options[link.name].append(link)
        self.order = sorted(self.options, key=lambda n: (-sizes[n], n))
        self.chosen: dict[int, Link] = {}
        self.removed: set[int] = set()
        self.pins: dict[int, set[int]] = defaultdict(set)

    def accept(self, link: Link):
        self.chosen[link.name] = link
        self.removed.update(link.covered)
        for r in link.source:
            self.pins[r].add(link.name)

    def revoke(self, name: int) -> Link:
        link = self.chosen.pop(name)
        self.removed.difference_update(link.covered)
        for r in link.source:
            self.pins[r].discard(name)
        return link

    def available(self, link: Link) -> bool:
        return not any(r in self.removed for r in link.source) and not any(r in self.removed or self.pins.get(r) for r in link.covered)

    def best(self, name: int) -> Link | None:
        return next((x for x in self.options.get(name, ()) if self.available(x)), None)

    def take_best(self, names):
        for name in names:
            if name not in self.chosen and (link := self.best(name)):
                self.accept(link)


def greedy(c: Component, **_):
    """Largest interval first, its best candidate that is still available."""
    c.take_best(c.order)


def _preferences(c: Component, least_size: int = 3) -> dict[int, Link]:
    return {n: c.options[n][0] for n in sorted(c.options) if c.sizes[n] >= least_size}


def dependency_order(c: Component, generations: int = 100, **_):
    """Dependents before their sources: reverse topological order of the preferences, cycles by size."""
    prefer = _preferences(c)
    source = {n: c.source_name[x.src_lo] for n, x in prefer.items()}
    nodes = sorted(set(c.options) | set(source.values()))
    serves, missing = defaultdict(list), Counter()
    for n, s in source.items():
        if s != n:
            serves[s].append(n)
            missing[n] += 1
    order = [n for n in nodes if not missing[n]]
    for n in order:  # grows while it is read
        for dependent in serves[n]:
            missing[dependent] -= 1
            if not missing[dependent]:
                order.append(dependent)
    placed = set(order)
    order += sorted((n for n in nodes if n not in placed), key=lambda n: (-c.sizes[n], n))
    c.take_best(n for n in reversed(order) if n in prefer)
    retarget(c, generations)


def _retargeted(dependent: Link, via: Link) -> Link | None:
    """The dependent reading from via's source instead, if its source is a slice of what via covers."""
    try:
        at = via.covered.index(dependent.src_lo)
    except ValueError:
        return None
    n = dependent.src_hi - dependent.src_lo
    if via.covered[at : at + n] != tuple(dependent.source):
        return None
    return dependent._replace(add=dependent.add + via.add, src_lo=via.src_lo + at, src_hi=via.src_lo + at + n)


def _try_retarget(c: Component, link: Link) -> bool:
    if any(r in c.removed for r in link.source) or any(r in c.removed for r in link.covered):
        return False
    owners = {n for r in link.covered for n in c.pins.get(r, ())}
    moved = {n: _retargeted(c.chosen[n], link) for n in owners}
    if link.name in owners or not all(moved.values()):
        return False
    if link.name in c.chosen:
        c.revoke(link.name)
    for n in owners:
        c.revoke(n)
    c.accept(link)
    for n in sorted(owners):
        c.accept(moved[n])
    return True


def retarget(c: Component, generations: int = 100):
    """Accept larger candidates, letting links that read what they cover read from their source; until nothing grows."""
    for _ in range(generations):
        grown = False
        for name in c.order:
            if c.sizes[name] < 3:
                continue
            have = c.chosen[name].cov if name in c.chosen else 0
            for link in c.options[name]:
                if link.cov <= have:
                    break
                if _try_retarget(c, link):
                    grown = True
                    break
        if not grown:
            return


def _forest(c: Component, prefer: dict[int, Link], repair: bool, least_gain: int = 1) -> dict[int, int]:
    """Parent (preferred source) of each name, in order of names; an edge that closes a cycle is dropped,
    or with repair the cycle's edge of least coverage."""
    parent: dict[int, int] = {}

    def above(n):
        while n in parent:
            n = parent[n]
            yield n

    for n, link in prefer.items():
        s = c.source_name[link.src_lo]
        if s == n:
            continue
        if n not in above(s):
            parent[n] = s
            continue
        if repair:
            cycle = [s, *above(s)]
            cycle = cycle[: cycle.index(n)]
            victim = min((u for u in cycle if u in prefer), key=lambda u: prefer[u].cov, default=n)
            if victim != n and link.cov - prefer[victim].cov >= least_gain:
                del parent[victim]
                parent[n] = s
    return parent


def tree_dp(c: Component, generations: int = 100, repair: bool = False, **_):
    """On the preference forest, the cheapest choice of names to compress such that no compressed name's source is
    compressed too; then what is left by size, then retargeting."""
    prefer = _preferences(c)
    parent = _forest(c, prefer, repair)
    children = defaultdict(list)
    for n, s in parent.items():
        children[s].append(n)
    nodes = sorted(set(prefer) | set(parent.values()))
    roots = [n for n in nodes if n not in parent]
    down = [n for n in roots]
    for n in down:
        down += children[n]
    gain: dict[tuple[int, bool], int] = {}
    for n in reversed(down):  # saved positions of the subtree, by whether n's source stays
        keep = sum(gain[w, True] for w in children[n])
        compress = prefer[n].cov + sum(gain[w, False] for w in children[n]) if n in prefer else -1
        gain[n, False], gain[n, True] = keep, max(keep, compress)
    wanted, allowed = {}, {}
    for n in down:
        if n in roots:
            s = c.source_name[prefer[n].src_lo] if n in prefer else n
            inside, at = False, s
            while not inside and at in parent:
                at = parent[at]
                inside = at == n
            allowed[n] = n in prefer and s != n and not inside
        wanted[n] = allowed[n] and gain[n, True] > sum(gain[w, True] for w in children[n])
        for w in children[n]:
            allowed[w] = not wanted[n]
    for n in _deepest_first(roots, children):
        if wanted[n]:
            link = prefer[n] if c.available(prefer[n]) else c.best(n)
            if link:
                c.accept(link)
    c.take_best(c.order)
    retarget(c, generations)


def _deepest_first(roots, children):
    """Each name after its dependents, in the order of the forest."""
    todo = [(r, False) for r in reversed(roots)]
    while todo:
        n, done = todo.pop()
        if done:
            yield n
        else:
            todo.append((n, True))
            todo += [(w, False) for w in reversed(children[n])]


def tree_dp_repaired(c: Component, **options):
    tree_dp(c, repair=True, **options)


def pseudoforest(c: Component, generations: int = 100, **_):
    """One candidate per name; a name depends on its source's name only if that one's candidate would remove source ranks.
    Each name has one dependency at most, so a component has one cycle at most: it is solved for both states of one
    name on the cycle, as a forest each time."""
    prefer = _preferences(c, 2)
    needs = {}
    for n, link in prefer.items():
        s = c.source_name[link.src_lo]
        if s != n and s in prefer and any(link.src_lo <= r < link.src_hi for r in prefer[s].covered):
            needs[n] = s
    children, seen = defaultdict(list), {}
    for n, s in needs.items():
        children[s].append(n)
    for start in sorted(prefer):
        path, n = [], start
        while n not in seen and n in needs:
            seen[n] = start
            path.append(n)
            n = needs[n]
        on_cycle = n in needs and seen.get(n) == start
        if n not in needs and n not in seen or on_cycle:
            seen[n] = start
            for m in sorted(_solve(n, needs if on_cycle else {}, children, prefer), key=lambda m: (-c.sizes[m], m)):
                if c.available(prefer[m]):
                    c.accept(prefer[m])
    c.take_best(c.order)
    retarget(c, generations)


def _solve(root: int, needs: dict[int, int], children, prefer) -> set[int]:
    """Best set of compressed names below root; with needs, root also depends on a name below it."""
    down = [root]
    for n in down:
        down += [w for w in children[n] if w != root]
    back = needs.get(root)
    best, best_gain = set(), -1
    for forced in (False, True):
        gain: dict[tuple[int, bool], int] = {}
        for n in reversed(down):
            kids = [w for w in children[n] if w != root]
            keep = sum(max(gain[w, False], gain[w, True]) for w in kids)
            compress = prefer[n].cov + sum(gain[w, False] for w in kids)
            if n == root:
                keep, compress = (keep, -1) if not forced else (-1, compress)
            if n == back and forced:
                compress = -(10**12)
            gain[n, False], gain[n, True] = keep, compress
        if max(gain[root, False], gain[root, True]) > best_gain:
            best_gain, best, state = max(gain[root, False], gain[root, True]), set(), {root: forced}
            for n in down:
                if state[n]:
                    best.add(n)
                for w in children[n]:
                    if w != root:
                        state[w] = not state[n] and gain[w, True] > gain[w, False]
    return best


def _search(c: Component, names: list[int], options: dict[int, list[Link]], nodes: int) -> tuple[dict[int, Link], bool]:
    """Branch and bound over the names' options, beside the links already chosen. Whether it ran to its end."""
    names = sorted(names, key=lambda n: -max((x.cov for x in options[n]), default=0))
    rest = [0] * (len(names) + 1)
    for i in range(len(names) - 1, -1, -1):
        rest[i] = rest[i + 1] + max((x.cov for x in options[names[i]]), default=0)
    best, best_gain, left, gain = {}, -1, nodes, 0
    open_names: list = []  # what is left to try for each name decided on, by place
    taken: list[Link | None] = []

    def enter(i: int):
        nonlocal best, best_gain, left
        if left <= 0 or gain + rest[i] <= best_gain:
            return
        left -= 1
        if i < len(names):
            open_names.append(iter([*options[names[i]], None]))
        else:
            best, best_gain = {x.name: x for x in taken if x}, gain

    enter(0)
    while open_names:
        if len(taken) == len(open_names):  # the last choice for this name is done with
            if link := taken.pop():
                gain -= link.cov
                c.revoke(link.name)
        link = next((x for x in open_names[-1] if x is None or c.available(x)), False)
        if link is False:
            open_names.pop()
            continue
        if link:
            gain += link.cov
            c.accept(link)
        taken.append(link)
        enter(len(taken))
    return best, left > 0


def tree_dp_search(c: Component, generations: int = 100, cluster: int = 8, options: int = 8, nodes: int = 20_000, **_):
    """tree_dp, then exact search inside clusters of names that share ranks; a cluster never gets worse."""
    tree_dp(c, generations)
    near = defaultdict(set)
    by_rank = defaultdict(set)
    for n, some in c.options.items():
        for link in some[:options]:
            for r in (*link.source, *link.covered):
                by_rank[r].add(n)
    for some in by_rank.values():
        for n in some:
            near[n] |= some - {n}
    for start in c.order:
        names = [start]
        for n in names:
            names += [w for w in sorted(near[n], key=lambda w: (-c.sizes[w], w)) if w not in names][: cluster - len(names)]
        before = {n: c.revoke(n) for n in names if n in c.chosen}
        gain = sum(x.cov for x in before.values())
        most = sum(c.options[n][0].cov for n in names)
        if most > gain:
            found, _ = _search(c, names, {n: list(dict.fromkeys([*c.options[n][:options], *([before[n]] if n in before else [])])) for n in names}, nodes)
            if sum(x.cov for x in found.values()) > gain:
                before = found
        for link in before.values():
            c.accept(link)


def exact(c: Component, nodes: int = 200_000, **_) -> bool:
    """The best selection of all, unless the node budget ends first (then at least as good as greedy's)."""
    greedy(c)
    start = {n: c.revoke(n) for n in list(c.chosen)}
    found, whole = _search(c, list(c.options), c.options, nodes)
    if sum(x.cov for x in found.values()) < sum(x.cov for x in start.values()):
        found = start
    for link in found.values():
        c.accept(link)
    return whole


ALGORITHMS = {
    "greedy": greedy, "dep-order": dependency_order, "tree-dp": tree_dp, "tree-dp3": tree_dp_search,
    "tree-dp4": tree_dp_repaired, "pseudoforest-dp": pseudoforest, "exact": exact,
}
#: Other accepted spellings.
ALIASES = {"dep": "dep-order", "dp": "tree-dp", "dp3": "tree-dp3", "dp4": "tree-dp4", "pf-dp": "pseudoforest-dp", "pfdp": "pseudoforest-dp"}


def algorithm(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {name!r}; one of {', '.join(ALGORITHMS)}")
    return name
