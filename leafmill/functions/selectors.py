"""CSS selectors: a text is compiled once into steps, and a tree is asked by its index of tags, classes and ids.

A selector is a list of chains; a chain is compounds with combinators between them (descendant, `>`, `+`, `~`). A compound's tests are its type, ids,
classes, attributes (with the operators `=`, `~=`, `|=`, `^=`, `$=`, `*=`, `!=` and the flags i and s) and pseudo-classes: `:not`, `:is`, `:where`, `:has`, `:nth-child` and its
kin (with `of`), `:first-child` and its kin, `:empty`, `:root`, `:contains`. Chains are matched from their last compound, whose candidates the index
gives; what a node's ancestors and siblings answered is kept for the others. Pseudo-classes that depend on a user (`:hover`) match nothing. Anything else is a
SelectorError, which says what is wrong with the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

TAG, ATTRS, PARENT, CHILDREN = range(4)
#: Selectors within selectors, at most.
DEEPEST = 20


class SelectorError(ValueError):
    """A text that is no selector."""


_IDENT = r"(?:--|-?(?:[A-Za-z_]|[^\x00-\x7f]|\\(?:[0-9a-fA-F]{1,6}[ \t\r\n\f]?|[^\r\n\f0-9a-fA-F])))(?:[\w-]|[^\x00-\x7f]|\\(?:[0-9a-fA-F]{1,6}[ \t\r\n\f]?|[^\r\n\f0-9a-fA-F]))*"
_NAME = re.compile(_IDENT)
_HASH = re.compile(r"#((?:[\w-]|[^\x00-\x7f]|\\(?:[0-9a-fA-F]{1,6}[ \t\r\n\f]?|[^\r\n\f0-9a-fA-F]))+)")
_SPACE = re.compile(r"(?:[ \t\r\n\f]|/\*.*?\*/)*", re.S)
_COMBINE = re.compile(r"(?:[ \t\r\n\f]|/\*.*?\*/)*([>+~])(?:[ \t\r\n\f]|/\*.*?\*/)*|(?:[ \t\r\n\f]|/\*.*?\*/)+", re.S)
_QUOTED = re.compile(r"\"((?:[^\"\\\n]|\\[\s\S])*)\"|'((?:[^'\\\n]|\\[\s\S])*)'")
_ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})[ \t\r\n\f]?|(\r\n|[\n\r\f])|([\s\S]))")
_NTH = re.compile(r"[ \t\r\n\f]*(?:(even)|(odd)|([+-]?\d*)n(?:[ \t\r\n\f]*([+-])[ \t\r\n\f]*(\d+))?|([+-]?\d+))[ \t\r\n\f]*(of(?=[ \t\r\n\f]))?", re.I)
_USER = frozenset("hover active focus focus-visible focus-within visited target target-within current past future paused playing local-link user-invalid".split())


def _plain(text: str) -> str:
    """Without escapes."""

    def one(m: re.Match) -> str:
        if m[1]:
            code = int(m[1], 16)
            return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
        return "" if m[2] else m[3]

    return _ESCAPE.sub(one, text)


Test = Callable[["Index", list], bool]


@dataclass
class Compound:
    tests: list[Test] = field(default_factory=list)
    #: What the index can look up: ("tag" | "id" | "class", name).
    keys: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Chain:
    """compounds[0] combined by joins[0] with compounds[1] and so on; lead joins the first with an anchor."""

    compounds: list[Compound]
    joins: list[str]
    lead: str | None = None


class Index:
    """A tree's elements in order, by tag, class and id, and their places among their siblings."""

    def __init__(self, elements: list[list]):
        self.order = {id(n): i for i, n in enumerate(elements)}
        self.elements = elements
        self.by: dict[tuple[str, str], list[list]] = {}
        for n in elements:
            self.by.setdefault(("tag", n[TAG]), []).append(n)
            for c in dict.fromkeys(n[ATTRS].get("class", "").split()):
                self.by.setdefault(("class", c), []).append(n)
            if n[ATTRS].get("id"):
                self.by.setdefault(("id", n[ATTRS]["id"]), []).append(n)
        self._siblings: dict[int, tuple[list[list], dict[int, int]]] = {}
        self._places: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
        self._held: list[object] = []  # what the keys of the answers below name stays alive
        self.known: dict[tuple, bool] = {}
        self.kept: dict[int, set[int]] = {}

    def siblings(self, node: list) -> tuple[list[list], int]:
        """All elements of a node's parent, and its place among them."""
        up = node[PARENT]
        found = self._siblings.get(id(up))
        if found is None:
            own = [x for x in up[CHILDREN] if not isinstance(x, str)]
            found = self._siblings[id(up)] = own, {id(x): i for i, x in enumerate(own)}
        return found[0], found[1][id(node)]

    def place(self, node: list, alike: Alike) -> tuple[int, int]:
        """A node's place among its siblings that are alike, from 1, and how many they are; 0 for one that isn't counted."""
        up = node[PARENT]
        found = self._places.get((id(up), id(alike)))
        if found is None:
            counts: dict[object, int] = {}
            at = {}
            for x in self.siblings(node)[0]:
                kind = alike(self, x)
                if kind is not None:
                    counts[kind] = counts.get(kind, 0) + 1
                    at[id(x)] = kind, counts[kind]
            found = self._places[(id(up), id(alike))] = {k: (n, counts[kind]) for k, (kind, n) in at.items()}
        return found.get(id(node), (0, 0))

    def beside(self, node: list, join: str) -> list[list]:
        """What may stand left of a combinator whose right side is node."""
        if join in "+~":
            own, at = self.siblings(node)
            return own[:at][::-1] if join == "~" else own[at - 1 : at] if at else []
        out, up = [], node[PARENT]
        while up is not None and up[PARENT] is not None:
            out.append(up)
            if join == ">":
                break
            up = up[PARENT]
        return out

    def fits(self, node: list, compound: Compound) -> bool:
        return all(test(self, node) for test in compound.tests)

    def matches(self, node: list, chain: Chain, last: int) -> bool:
        """Whether node is the `last` compound of the chain, with what stands left of it."""
        key = (id(chain), last, id(node))
        found = self.known.get(key)
        if found is None:
            found = self.fits(node, chain.compounds[last]) and (not last or self._left(node, chain, last))
            self.known[key] = found
        return found

    def _left(self, node: list, chain: Chain, last: int) -> bool:
        join = chain.joins[last - 1]
        if join in ">+":
            return any(self.matches(x, chain, last - 1) for x in self.beside(node, join))
        # an ancestor's or an elder sibling's own answer says what stands beyond it
        key = (id(chain), last, id(node), join)
        todo = [node]
        while todo:
            n = todo[-1]
            near = n[PARENT] if join == " " else next(iter(self.beside(n, "+")), None)
            if near is None or near[PARENT] is None:
                answer = False
            elif self.matches(near, chain, last - 1):
                answer = True
            else:
                beyond = self.known.get((id(chain), last, id(near), join))
                if beyond is None:
                    todo.append(near)
                    continue
                answer = beyond
            self.known[(id(chain), last, id(n), join)] = answer
            todo.pop()
        return self.known[key]

    def any(self, node: list, chains: list[Chain]) -> bool:
        return any(self.matches(node, c, len(c.compounds) - 1) for c in chains)

    def candidates(self, compound: Compound) -> list[list]:
        return min((self.by.get(k, []) for k in compound.keys), key=len, default=self.elements)

    def anchors(self, chain: Chain) -> set[int]:
        """Nodes from which a relative chain leads to some node."""
        found = self.kept.get(id(chain))
        if found is None:
            found, seen = set(), set()
            top = len(chain.compounds) - 1
            todo = [(n, top) for n in self.candidates(chain.compounds[top]) if self.fits(n, chain.compounds[top])]
            while todo:
                node, at = todo.pop()
                if (id(node), at) in seen:
                    continue
                seen.add((id(node), at))
                for x in self.beside(node, chain.joins[at - 1] if at else chain.lead):
                    if not at:
                        found.add(id(x))
                    elif self.fits(x, chain.compounds[at - 1]):
                        todo.append((x, at - 1))
            self.kept[id(chain)] = found
        return found

    def select(self, chains: list[Chain]) -> list[list]:
        """All matches, each once, in document order."""
        out: dict[int, list] = {}
        self._held.append(chains)
        for c in chains:
            for n in self.candidates(c.compounds[-1]):
                if id(n) not in out and self.matches(n, c, len(c.compounds) - 1):
                    out[id(n)] = n
        return sorted(out.values(), key=lambda n: self.order[id(n)])


#: What counts siblings together: the class of a node, None for one that isn't counted.
Alike = Callable[[Index, list], object]


def _nth(a: int, b: int, backwards: bool, alike: Alike) -> Test:
    """Place a * k + b, k from 0, among the siblings that are alike."""

    def test(index: Index, node: list) -> bool:
        place, of = index.place(node, alike)
        if not place:
            return False
        place = of - place + 1 if backwards else place
        return (place - b) % a == 0 and (place - b) // a >= 0 if a else place == b

    return test


def _same_type(index: Index, node: list) -> object:
    return node[TAG]


def _everything(index: Index, node: list) -> object:
    return True


#: Pseudo-classes without arguments that are places among siblings: a, b, backwards, of the same type.
_PLACES = {
    "first-child": [(0, 1, False, _everything)],
    "last-child": [(0, 1, True, _everything)],
    "only-child": [(0, 1, False, _everything), (0, 1, True, _everything)],
    "first-of-type": [(0, 1, False, _same_type)],
    "last-of-type": [(0, 1, True, _same_type)],
    "only-of-type": [(0, 1, False, _same_type), (0, 1, True, _same_type)],
}


def _text_of(node: list) -> str:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        else:
            todo.extend(reversed(n[CHILDREN]))
    return "".join(out)


def _empty(index: Index, node: list) -> bool:
    return not any(not isinstance(x, str) or x.strip() for x in node[CHILDREN])


def _root(index: Index, node: list) -> bool:
    up = node[PARENT]
    return up is not None and up[PARENT] is None and len(index.siblings(node)[0]) == 1


class _Reader:
    """A cursor over the text of a selector."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def wrong(self, what: str) -> SelectorError:
        return SelectorError(f"selector not understood: {what} at {self.at} of {self.text!r}")

    def take(self, pattern: re.Pattern) -> re.Match | None:
        m = pattern.match(self.text, self.at)
        if m:
            self.at = m.end()
        return m

    def skip(self) -> None:
        self.take(_SPACE)

    def eat(self, what: str) -> bool:
        if self.text.startswith(what, self.at):
            self.at += len(what)
            return True
        return False

    def need(self, what: str) -> None:
        if not self.eat(what):
            raise self.wrong(f"no {what!r}")

    def name(self, of: str) -> str:
        m = self.take(_NAME)
        if not m:
            raise self.wrong(f"no name of {of}")
        return _plain(m[0])

    def chains(self, depth: int, relative: bool = False, closing: bool = False) -> list[Chain]:
        if depth > DEEPEST:
            raise self.wrong("nested too deeply")
        out = []
        while True:
            self.skip()
            out.append(self.chain(depth, relative))
            self.skip()
            if not self.eat(","):
                break
        if closing:
            self.need(")")
        elif self.at < len(self.text):
            raise self.wrong("something is left")
        return out

    def chain(self, depth: int, relative: bool) -> Chain:
        lead = None
        if relative:
            lead = next((x for x in ">+~" if self.eat(x)), " ")
            self.skip()
        compounds, joins = [self.compound(depth)], []
        while True:
            before = self.at
            m = self.take(_COMBINE)
            if not m:
                break
            if not m[1] and (self.at >= len(self.text) or self.text[self.at] in ",)"):
                self.at = before
                break
            joins.append(m[1] or " ")
            compounds.append(self.compound(depth))
        return Chain(compounds, joins, lead)

    def compound(self, depth: int) -> Compound:
        out, start = Compound(), self.at
        if m := self.take(_NAME):
            tag = _plain(m[0]).lower()
            out.tests.append(lambda index, n: n[TAG] == tag)
            out.keys.append(("tag", tag))
        else:
            self.eat("*")
        while self.at < len(self.text):
            if m := self.take(_HASH):
                own = _plain(m[1])
                out.tests.append(lambda index, n, own=own: n[ATTRS].get("id") == own)
                out.keys.append(("id", own))
            elif self.eat("."):
                cls = self.name("a class")
                out.tests.append(lambda index, n, cls=cls: cls in n[ATTRS].get("class", "").split())
                out.keys.append(("class", cls))
            elif self.eat("["):
                out.tests.append(self.attribute())
            elif self.text.startswith("::", self.at):
                raise self.wrong("a pseudo-element")
            elif self.eat(":"):
                out.tests.extend(self.pseudo(depth))
            else:
                break
        if self.at == start:
            raise self.wrong("nothing to select")
        return out

    def attribute(self) -> Test:
        self.skip()
        name = self.name("an attribute").lower()
        if self.eat("|") and not self.text.startswith("=", self.at):
            name = f"{name}:{self.name('an attribute').lower()}"
        elif self.text[self.at - 1] == "|":
            self.at -= 1
        self.skip()
        if self.eat("]"):
            return lambda index, n: name in n[ATTRS]
        op = next((x for x in ("=", "~=", "|=", "^=", "$=", "*=", "!=") if self.eat(x)), None)
        if op is None:
            raise self.wrong("no operator")
        self.skip()
        if m := self.take(_QUOTED):
            want = _plain(m[1] if m[1] is not None else m[2])
        else:
            want = self.name("a value") if not self.text[self.at : self.at + 1].isdigit() else self.take(re.compile(r"[\w.-]+"))[0]
        self.skip()
        fold = self.take(re.compile(r"[iIsS](?=[ \t\r\n\f]*\])"))
        self.skip()
        self.need("]")
        ready = (lambda x: x.lower()) if fold and fold[0] in "iI" else (lambda x: x)
        want = ready(want)
        holds = {
            "=": lambda got: got == want,
            "!=": lambda got: got != want,
            "~=": lambda got: bool(want) and want in got.split(),
            "|=": lambda got: got == want or got.startswith(want + "-"),
            "^=": lambda got: bool(want) and got.startswith(want),
            "$=": lambda got: bool(want) and got.endswith(want),
            "*=": lambda got: bool(want) and want in got,
        }[op]
        if op == "!=":
            return lambda index, n: name not in n[ATTRS] or holds(ready(n[ATTRS][name]))
        return lambda index, n: name in n[ATTRS] and holds(ready(n[ATTRS][name]))

    def pseudo(self, depth: int) -> list[Test]:
        name = self.name("a pseudo-class").lower()
        if not self.eat("("):
            if name in _PLACES:
                return [_nth(*x) for x in _PLACES[name]]
            if name in _USER:
                return [lambda index, n: False]
            simple = {"empty": _empty, "root": _root, "link": _linked, "any-link": _linked, "checked": _with("checked", "selected"), "disabled": _with("disabled"), "required": _with("required")}
            if name in simple:
                return [simple[name]]
            raise self.wrong(f"no pseudo-class :{name}")
        if name in ("not", "is", "where", "matches", "any"):
            chains = self.chains(depth + 1, closing=True)
            return [(lambda index, n: not index.any(n, chains)) if name == "not" else (lambda index, n: index.any(n, chains))]
        if name == "has":
            chains = self.chains(depth + 1, relative=True, closing=True)
            return [lambda index, n: any(id(n) in index.anchors(c) for c in chains)]
        if name in ("contains", "-soup-contains"):
            self.skip()
            m = self.take(_QUOTED)
            said = _plain(m[1] if m[1] is not None else m[2]) if m else self.name("a text")
            self.skip()
            self.need(")")
            return [lambda index, n: said in _text_of(n)]
        if name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
            m = self.take(_NTH)
            if not m:
                raise self.wrong("no place")
            if m[1] or m[2]:
                a, b = 2, 1 if m[2] else 0
            elif m[6]:
                a, b = 0, int(m[6])
            else:
                a = int(m[3] + "1") if m[3] in ("", "+", "-") else int(m[3])
                b = int((m[4] or "+") + (m[5] or "0"))
            alike = _same_type if name.endswith("type") else _everything
            if m[7]:
                if alike is _same_type:
                    raise self.wrong("'of' beside a type")
                chains = self.chains(depth + 1, closing=True)
                return [_nth(a, b, "last" in name, lambda index, x: True if index.any(x, chains) else None)]
            self.need(")")
            return [_nth(a, b, "last" in name, alike)]
        raise self.wrong(f"no pseudo-class :{name}()")


def _linked(index: Index, node: list) -> bool:
    return node[TAG] in ("a", "area") and "href" in node[ATTRS]


def _with(*names: str) -> Test:
    return lambda index, n: any(x in n[ATTRS] for x in names)


@lru_cache(1024)
def compiled(selector: str) -> list[Chain]:
    """The chains of a selector; SelectorError if it is none."""
    if not selector.strip():
        raise SelectorError("selector not understood: it is empty")
    return _Reader(selector).chains(0)


def fault(selector: str | None) -> str | None:
    """What is wrong with a selector, None if nothing."""
    try:
        if selector is not None:
            compiled(selector)
    except SelectorError as e:
        return str(e)
    return None
