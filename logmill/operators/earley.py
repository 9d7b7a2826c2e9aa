"""A weighted Earley parser whose charts are shared between inputs.

A grammar's terminals are token classes. The chart column after some classes depends on these classes alone, so the first
columns are kept in a trie: an input walks it, and only a class sequence not met before is parsed. Rules have no empty
right sides. Two terminals stand for no token: REST takes the remaining input whatever it is, END needs its end.

Weights add up over a derivation; the highest sum wins, of equal ones that which takes REST first. Items that can't beat
what is found already are left out. Items carry the spans they captured, so a column is needed only while an item began there
or waits there; of an input of any length, with left-recursive rules, only a few columns are held.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import inf

REST, END = "REST", "END"


@dataclass
class Rule:
    left: str
    right: tuple[str, ...]
    weight: float


class Grammar:
    """Rules from lines such as ``Ts 1.5 = d4 '-' d2 Frac?``.

    A symbol with ? may be absent; a left side repeated, or |, gives alternatives; names with a rule are nonterminals, all
    others terminals.
    """

    def __init__(self, text: str, start: str = "Line"):
        self.start = start
        self.rules: list[Rule] = []
        for line in text.splitlines():
            line = line.strip()
            if not line or line.startswith("# "):
                continue
            head, _, body = line.partition(" = ")
            left, _, weight = head.strip().partition(" ")
            for choice in body.split(" | "):
                for right in self._optional(choice.split()):
                    self.rules.append(Rule(left, right, float(weight or 0)))
        self.by_left: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            self.by_left.setdefault(r.left, []).append(i)
        most = self._most()
        #: Of each rule and dot, the most that the rule's weight and what follows the dot can give.
        self.to_come = [[r.weight + sum(most.get(s, 0.0) for s in r.right[dot:]) for dot in range(len(r.right) + 1)] for r in self.rules]

    @staticmethod
    def _optional(symbols: list[str]) -> list[tuple[str, ...]]:
        out: list[tuple[str, ...]] = [()]
        for s in symbols:
            optional = s.endswith("?")
            s = s.removesuffix("?")
            symbol = s[1:-1] if len(s) > 2 and s[0] == s[-1] == "'" else s
            out = [*(x + (symbol,) for x in out), *(out if optional else [])]
        return out

    def _most(self) -> dict[str, float]:
        """The highest weight of a derivation of each nonterminal, inf where recursion adds to it."""
        most = dict.fromkeys(self.by_left, -inf)
        for i in range(2 * len(most) + 2):
            changed = False
            for r in self.rules:
                w = r.weight + sum(most.get(s, 0.0) for s in r.right)
                if w > most[r.left]:
                    most[r.left], changed = inf if i > len(most) else w, True
            if not changed:
                break
        return most


#: Captured spans: None, (name, first token, end), or a pair of these.
Found = tuple | None


@dataclass(slots=True)
class Node:
    """A chart column: items by (rule, dot, origin) with score, captured spans, and the most a line that has it can score."""

    depth: int
    #: The best score of REST up to here.
    best: float = -inf
    items: dict = field(default_factory=dict)
    by_terminal: dict[str, list] = field(default_factory=dict)
    by_nonterminal: dict[str, list] = field(default_factory=dict)
    next: dict[str, "Node | None"] = field(default_factory=dict)
    rest: tuple | None = None
    end: tuple | None = None
    live: bool = True


def _join(a: Found, b: Found) -> Found:
    return b if a is None else a if b is None else (a, b)


def _spans(found: Found) -> list[tuple[str, int, int]]:
    out, todo = [], [found]
    while todo:
        f = todo.pop()
        if f is not None:
            if len(f) == 3:
                out.append(f)
            else:
                todo += f
    return sorted(out, key=lambda s: (s[1], -s[2]))


class Parser:
    """Charts are kept of the first `shared` tokens of inputs, most_nodes columns about; neither bounds what is parsed."""

    def __init__(self, grammar: Grammar, captures: frozenset[str], most_nodes: int = 60_000, shared: int = 512):
        self.g, self.captures, self.most_nodes, self.shared = grammar, captures, most_nodes, shared
        self.classes = self._classes()
        self.by_left = {n: rules for n, rules in grammar.by_left.items() if n not in self.classes}
        #: For each terminal, itself and the classes it belongs to.
        self.symbols: dict[str, list[str]] = {}
        for name, kinds in self.classes.items():
            for k in kinds:
                self.symbols.setdefault(k, [k]).append(name)
        self._reset()

    def _classes(self) -> dict[str, set[str]]:
        """Nonterminals that stand for one token of several kinds, without weight or capture: they are scanned, not predicted."""
        out: dict[str, set[str]] = {}
        while True:
            n = len(out)
            for name, rules in self.g.by_left.items():
                rights = [self.g.rules[i].right for i in rules]
                plain = name not in self.captures and not any(self.g.rules[i].weight for i in rules) and all(len(r) == 1 for r in rights)
                if name not in out and plain and all(r[0] in out or r[0] not in self.g.by_left and r[0] not in (REST, END) for r in rights):
                    out[name] = set().union(*(out.get(r[0], {r[0]}) for r in rights))
            if len(out) == n:
                return out

    def _reset(self) -> None:
        self.nodes = 1
        self.root = Node(0)
        self._close({0: self.root}, self.root, [(i, 0, 0, 0.0, None, inf) for i in self.by_left[self.g.start]])

    def _close(self, path: dict[int, Node], col: Node, seeds: list) -> None:
        """Complete and predict until the column, the last one of path, doesn't change any more."""
        rules, by_left, to_come, captures, start = self.g.rules, self.by_left, self.g.to_come, self.captures, self.g.start
        items, agenda, wanted, at = col.items, [], {}, col.depth

        def add(rule: int, dot: int, origin: int, score: float, found: Found, bound: float) -> None:
            r = rules[rule]
            if origin == 0 and r.left == start:
                bound = score + to_come[rule][dot]
            key = (rule, dot, origin)
            old = items.get(key)
            if old is None:
                if bound <= col.best:
                    return
                if dot < len(r.right):
                    s = r.right[dot]
                    (col.by_nonterminal if s in by_left else col.by_terminal).setdefault(s, []).append(key)
                items[key] = (score, found, bound)
            elif score > old[0]:
                items[key] = (score, found, max(bound, old[2]))
            elif bound > old[2]:
                items[key] = (old[0], old[1], bound)
            else:
                return
            agenda.append(key)

        for s in seeds:
            add(*s)
        while agenda:
            key = agenda.pop()
            rule, dot, origin = key
            score, found, bound = items[key]
            r = rules[rule]
            if dot == len(r.right):
                begun = path[origin]
                for parent in begun.by_nonterminal.get(r.left, ()):
                    p = begun.items[parent]
                    # Of a recursive rule only the outermost span is told.
                    own = (r.left, origin, at) if r.left in captures and rules[parent[0]].left != r.left else None
                    add(parent[0], parent[1] + 1, parent[2], p[0] + score + r.weight, _join(p[1], _join(own, found)), p[2])
            elif (s := r.right[dot]) in by_left and bound > wanted.get(s, -inf):
                wanted[s] = bound
                for i in by_left[s]:
                    add(i, 0, at, 0.0, None, bound)
        col.rest, col.end = self._best(col, REST), self._best(col, END)
        if col.rest is not None and col.rest[0] > col.best:
            col.best = col.rest[0]
        col.live = any(t not in (REST, END) and any(items[k][2] > col.best for k in keys) for t, keys in col.by_terminal.items())

    def _best(self, col: Node, symbol: str) -> tuple | None:
        """The best derivation of a whole line that takes REST or END here: (score, captured spans, tokens)."""
        best = None
        for key in col.by_terminal.get(symbol, ()):
            r = self.g.rules[key[0]]
            if key[2] == 0 and key[1] == len(r.right) - 1 and r.left == self.g.start:
                score, found, _ = col.items[key]
                if best is None or score + r.weight > best[0]:
                    best = (score + r.weight, found)
        return best and (*best, col.depth)

    def step(self, path: dict[int, Node], node: Node, kind: str) -> Node | None:
        """The column after one more token of this class, or None if no rule goes on that can still win."""
        try:
            return node.next[kind]
        except KeyError:
            pass
        seeds = []
        for symbol in self.symbols.get(kind, (kind,)):
            for key in node.by_terminal.get(symbol, ()):
                score, found, bound = node.items[key]
                if bound > node.best:
                    seeds.append((key[0], key[1] + 1, key[2], score, found, bound))
        new = None
        if seeds:
            new = path[node.depth + 1] = Node(node.depth + 1, node.best)
            self._close(path, new, seeds)
        if node.depth < self.shared:
            self.nodes += new is not None
            node.next[kind] = new
        return new

    @staticmethod
    def _forget(path: dict[int, Node], node: Node) -> None:
        """Drop the columns of path that no derivation goes back to."""
        needed, todo = {node.depth}, [key[2] for key in node.items]
        while todo:
            o = todo.pop()
            if o not in needed:
                needed.add(o)
                todo += [key[2] for keys in path[o].by_nonterminal.values() for key in keys]
        for depth in [d for d in path if d not in needed]:
            del path[depth]

    def parse(self, tokens) -> tuple | None:
        """(score, spans, tokens before REST) of the best derivation of an iterator of token classes."""
        if self.nodes > self.most_nodes:
            self._reset()
        node = self.root
        path, best, whole, most = {0: node}, node.rest, True, 2 * self.shared
        for kind in tokens:
            node = self.step(path, node, kind)
            if node is None:
                whole = False
                break
            path[node.depth] = node
            if node.rest is not None and (best is None or node.rest[0] > best[0]):
                best = node.rest
            if not node.live and node.end is None:
                whole = False
                break
            if len(path) > most:
                self._forget(path, node)
                most = 2 * max(self.shared, len(path))
        if whole and (e := node.end) is not None and (best is None or e[0] > best[0]):
            best = e
        return best and (best[0], _spans(best[1]), best[2])
