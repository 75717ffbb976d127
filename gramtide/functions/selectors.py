"""Extraction of a page by its site's rules: a small matcher of selectors on the tree that ``markup`` parses.

A selector is made of steps ``tag.class#id[attribute]`` that stand for a descendant (space) or a child (``>``); attributes
take ``=``, ``^=``, ``$=``, ``*=`` and ``~=``; alternatives are parted by commas. Anything else is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .markup import HIDDEN, META, VOID, _squash, _Tree, article_node, article_text, node_meta

Node = tuple[str, dict]

_TESTS = {
    None: lambda held, want: True,
    "=": lambda held, want: held == want,
    "^=": lambda held, want: bool(want) and held.startswith(want),
    "$=": lambda held, want: bool(want) and held.endswith(want),
    "*=": lambda held, want: bool(want) and want in held,
    "~=": lambda held, want: want in held.split(),
}
_PART = re.compile(r"""(?P<tag>[a-zA-Z][\w-]*|\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[\^$*~]?=)\s*(?P<q>["']?)(?P<want>.*?)(?P=q)\s*)?\]""")
_TOKEN = re.compile(r"""\s*(?P<comma>,)\s*|\s*(?P<child>>)\s*|(?P<space>\s+)|(?P<step>(?:\[(?:"[^"]*"|'[^']*'|[^\]"'])*\]|[^\s,>\[])+)""")


@lru_cache(maxsize=4096)
def compiled(selector: str) -> tuple:
    """The alternatives of a selector, each its steps from the last to the first: (tag, attribute tests, child of the next)."""
    ways, steps, child = [], [], False
    selector, at = selector.strip(), 0
    while at < len(selector):
        m = _TOKEN.match(selector, at)
        if not m:
            raise ValueError(f"not a selector: {selector!r}")
        at = m.end()
        if m["comma"]:
            ways.append(steps)
            steps = []
        elif m["child"]:
            child = True
        elif m["step"]:
            steps.append((*_step(m["step"]), child))
            child = False
    ways.append(steps)
    if child or not all(ways) or any(w[0][2] for w in ways):
        raise ValueError(f"not a selector: {selector!r}")
    return tuple(tuple(w[::-1]) for w in ways)


def _step(text: str) -> tuple[str, tuple]:
    tag, tests, at = "*", [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m or (m["tag"] and at):
            raise ValueError(f"not a step of a selector: {text!r}")
        if m["tag"]:
            tag = m["tag"].lower()
        elif m["cls"]:
            tests.append(("class", "~=", m["cls"]))
        elif m["id"]:
            tests.append(("id", "=", m["id"]))
        else:
            tests.append((m["attr"].lower(), m["op"], m["want"]))
        at = m.end()
    return tag, tuple(tests)


def _fits(node: Node, tag: str, tests: tuple) -> bool:
    return tag in ("*", node[0]) and all(a in node[1] and _TESTS[op](node[1][a], want) for a, op, want in tests)


def matches(path: list[Node], selector: str) -> bool:
    """Whether the last node of a path from the root is what a selector asks for."""

    def up(at: int, steps: tuple) -> bool:
        tag, tests, child = steps[0]
        if at < 0 or not _fits(path[at], tag, tests):
            return False
        rest = steps[1:]
        return not rest or any(up(i, rest) for i in ([at - 1] if child else range(at - 1, -1, -1)))

    return any(up(len(path) - 1, way) for way in compiled(selector))


class _Picked(_Tree):
    """The tree, and the elements that the selectors of some fields ask for, in the order of the page."""

    def __init__(self, wanted: dict[str, str]):
        super().__init__()
        self.wanted = wanted
        self.found: dict[str, list[tuple[Node, list[str]]]] = {name: [] for name in wanted}
        self.live: list[tuple[int, Node, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        node = (tag, self.attributes(attrs)) if tag in VOID else self.open[-1]
        path = [*self.open, node] if tag in VOID else self.open
        parts: list[str] | None = None
        for name, selector in self.wanted.items():
            if matches(path, selector):
                parts = [] if parts is None else parts
                self.found[name].append((node, parts))
        if parts is not None and tag not in VOID:
            self.live.append((len(self.open) - 1, node, parts))

    def handle_data(self, data):
        super().handle_data(data)
        data = data.replace(self.sign, "")
        self.live = [e for e in self.live if len(self.open) > e[0] and self.open[e[0]] is e[1]]
        if not any(t in HIDDEN for t, _ in self.open):
            for _, _, parts in self.live:
                parts.append(data)

    def inside(self, node: Node) -> list[list[str]]:
        return [p for path, p in self.paragraphs if any(n is node for n in path)]


#: What a site's rules say where they are silent.
DEFAULT = {"strategy": "json_ld", "body": "article", "titre": "h1", "auteur": "", "date": "time"}


def extract(text: str | None, rule: dict[str, str]) -> dict[str, str]:
    """Title, author, date, section, access and text of a page by rules.

    ``strategy``: ``json_ld`` (selectors fill what it leaves empty) or ``tags`` (selectors only). ``body``: ``json_ld``;
    ``article``, the paragraphs of the first one; or a selector: the paragraphs of its one element, or else the elements
    themselves. A ``datetime`` goes before a date's text. Null or empty pages give empty fields.
    """
    fields = {f: rule[f] for f in ("titre", "auteur", "date") if rule[f]}
    page = _Picked(fields | ({"body": rule["body"]} if rule["body"] != "json_ld" else {}))
    page.read(text or "")
    node = article_node(page.jsonld) if "json_ld" in (rule["strategy"], rule["body"]) else {}
    meta = node_meta(node if rule["strategy"] == "json_ld" else {})
    for f in fields:
        if not meta[f] and page.found[f]:
            (_, attrs), parts = page.found[f][0]
            meta[f] = (f == "date" and attrs.get("datetime")) or _squash(parts)
    if rule["body"] == "json_ld":
        return meta | {"contenu": article_text(node)}
    chosen = page.found["body"][: 1 if rule["body"] == "article" else None]
    one = len(chosen) == 1 and chosen[0][0][0] != "p"
    texts = page.inside(chosen[0][0]) if one else [parts for _, parts in chosen]
    return meta | {"contenu": "\n".join(s for s in map(_squash, texts) if s)}


@F.pandas_udf(StructType(META.fields))
def by_rule(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Columns: the page, then the rule in the order of ``DEFAULT``."""
    for page, *rule in columns:
        rows = [extract(text, dict(zip(DEFAULT, of))) for text, *of in zip(page, *rule)]
        yield pd.DataFrame(rows, columns=META.names)
