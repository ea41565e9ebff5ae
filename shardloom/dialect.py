"""From MySQL-flavoured text to Spark SQL, token by token.

Strings, quoted names and comments are tokens of their own, so nothing is
rewritten inside them. Also here: hints, and the small parser that reads the
predicates pruning can use.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from . import prune as P

_TOKEN = re.compile(
    r"""(?P<space>\s+)
      |(?P<hint>/\*A!.*?\*/)
      |(?P<comment>/\*.*?\*/|--[^\n]*|\#[^\n]*)
      |(?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")
      |(?P<quoted>`(?:[^`]|``)*`)
      |(?P<number>\d+\.\d*(?:[eE][-+]?\d+)?|\.\d+|\d+(?:[eE][-+]?\d+)?)
      |(?P<word>@{0,2}[A-Za-z_\x80-\U0010ffff][\w$\x80-\U0010ffff]*)
      |(?P<op><=>|<>|!=|<=|>=|\|\||&&|:=|.)""",
    re.S | re.X,
)


@dataclass
class Token:
    kind: str
    text: str

    @property
    def up(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text

    @property
    def name(self) -> str:
        return self.text[1:-1].replace("``", "`") if self.kind == "quoted" else self.text


def tokenize(sql: str) -> list[Token]:
    return [Token(m.lastgroup, m.group()) for m in _TOKEN.finditer(sql)]


def text_of(tokens: list[Token]) -> str:
    return "".join(t.text for t in tokens)


def code(tokens: list[Token]) -> list[int]:
    """Positions of tokens that mean something."""
    return [i for i, t in enumerate(tokens) if t.kind not in ("space", "comment", "hint")]


def split_statements(sql: str) -> list[str]:
    out, own = [], []
    for t in tokenize(sql):
        if t.text == ";":
            out.append(text_of(own))
            own = []
        else:
            own.append(t)
    return [s for s in [*out, text_of(own)] if s.strip()]


# ---------------------------------------------------------------- hints


class HintError(ValueError):
    pass


@dataclass
class Hints:
    route: list[str] = field(default_factory=list)
    fullscan: bool = False
    direct: bool = False
    master: bool = False
    slave: bool = False
    trace: str | None = None


def hints_of(tokens: list[Token]) -> Hints:
    """Hints of all `/*A! name(a, k=v) … */` comments; routing hints exclude each other, so do master and slave."""
    out = Hints()
    seen = set()
    for t in tokens:
        if t.kind != "hint":
            continue
        for name, args in re.findall(r"(\w+)\s*\(([^)]*)\)", t.text[4:-2]):
            name, items = name.lower(), [a.strip() for a in args.split(",") if a.strip()]
            seen.add(name)
            if name == "route":
                if not items or any(not re.fullmatch(r"[^.\s]+\.[^.\s]+", x) for x in items):
                    raise HintError(f"route hint wants db.table items: {args!r}")
                out.route += items
            elif name in ("fullscan", "direct", "master", "slave"):
                setattr(out, name, True)
            elif name == "trace":
                out.trace = items[0] if items else ""
            else:
                raise HintError(f"unknown hint {name}")
    if len(seen & {"route", "fullscan", "direct"}) > 1 or {"master", "slave"} <= seen:
        raise HintError("hint type conflict")
    return out


# ---------------------------------------------------------------- rewriting

#: Functions whose results differ from Spark's of that name: they get ours (see functions.sqlfunctions).
RENAMED = {"mod": "try_mod"} | {n: f"sl_{n}" for n in ("truncate", "power", "pow", "length", "substring", "substr", "lpad", "rpad", "strcmp", "format_bytes", "pi")}
_TYPES = {"SIGNED": "sl_cast_signed", "UNSIGNED": "sl_cast_unsigned", "DATE": "sl_cast_date", "DATETIME": "sl_cast_datetime", "TIME": "sl_cast_time"}


def normalize(tokens: list[Token]) -> list[Token]:
    """Rewrite what Spark's parser does not take or takes otherwise."""
    toks = [t for t in tokens if t.kind not in ("hint",) and not (t.kind == "comment" and not t.text.startswith("/*+"))]
    toks = _strip(toks)
    toks = _group_order(_xor(_calls(_casts(toks))))
    toks = _divisors(_limits(toks))
    out: list[Token] = []
    pos = code(toks)
    nxt = {a: b for a, b in zip(pos, pos[1:], strict=False)}
    for i, t in enumerate(toks):
        after = toks[nxt[i]] if i in nxt else None
        if t.kind == "word" and after is not None and after.text == "(" and t.text.lower() in RENAMED:
            t = Token("word", RENAMED[t.text.lower()])
        elif t.text == "!" and t.kind == "op":
            t = Token("word", "NOT ")
        elif t.text == "&&":
            t = Token("op", " AND ")
        elif t.kind == "string" and t.text[0] == '"':
            t = Token("string", "'" + t.text[1:-1].replace('""', '"').replace("'", "\\'") + "'")
        elif t.kind == "string" and "''" in t.text[1:-1]:
            t = Token("string", "'" + t.text[1:-1].replace("''", "\\'") + "'")
        out.append(t)
    return out


def _strip(toks: list[Token]) -> list[Token]:
    """FOR UPDATE, LOCK IN SHARE MODE, index hints, PARTITION (…) and statement priorities mean nothing here."""
    pos = code(toks)
    gone: set[int] = set()
    up = [toks[p].up for p in pos]
    i = 0
    while i < len(pos):
        n = 0
        if up[i : i + 2] == ["FOR", "UPDATE"]:
            n = 2
        elif up[i : i + 4] == ["LOCK", "IN", "SHARE", "MODE"]:
            n = 4
        elif up[i] in ("USE", "FORCE", "IGNORE") and up[i + 1 : i + 2] and up[i + 1] in ("INDEX", "KEY"):
            n = up.index(")", i) - i + 1
        elif up[i] == "PARTITION" and up[i + 1 : i + 2] == ["("] and i and up[i - 1] != "OVER" and "OVER" not in up[max(0, i - 2) : i]:
            n = up.index(")", i) - i + 1
        elif up[i] in ("SQL_CACHE", "SQL_NO_CACHE", "SQL_CALC_FOUND_ROWS", "HIGH_PRIORITY", "STRAIGHT_JOIN", "LOW_PRIORITY", "DELAYED") and i < 3:
            n = 1
        if n:
            gone |= {pos[j] for j in range(i, i + n)}
        i += max(1, n)
    return [t for i, t in enumerate(toks) if i not in gone]


def _close(toks: list[Token], at: int) -> int:
    depth = 0
    for i in range(at, len(toks)):
        if toks[i].text == "(":
            depth += 1
        elif toks[i].text == ")":
            depth -= 1
            if not depth:
                return i
    raise ValueError("unbalanced parentheses")


def _casts(toks: list[Token]) -> list[Token]:
    """CAST(x AS t) and CONVERT(x, t) / CONVERT(x USING cs) with MySQL's type names, innermost first."""
    i = len(toks) - 1
    while i >= 0:
        t = toks[i]
        if t.kind == "word" and t.up in ("CAST", "CONVERT"):
            pos = [j for j in code(toks) if j > i]
            if pos and toks[pos[0]].text == "(":
                end = _close(toks, pos[0])
                depth, cut = 0, None
                for j in range(pos[0] + 1, end):
                    depth += {"(": 1, ")": -1}.get(toks[j].text, 0)
                    if depth == 0 and (toks[j].up == ("AS" if t.up == "CAST" else ",") or (t.up == "CONVERT" and toks[j].up == "USING")):
                        cut = j
                if cut is not None:
                    inner, kind = toks[pos[0] + 1 : cut], toks[cut + 1 : end]
                    toks[i : end + 1] = _cast(inner, kind, toks[cut].up == "USING")
        i -= 1
    return toks


def _arguments(toks: list[Token], start: int, end: int) -> list[list[Token]]:
    out, own, depth = [], [], 0
    for t in toks[start:end]:
        depth += {"(": 1, ")": -1}.get(t.text, 0)
        if t.text == "," and depth == 0:
            out.append(own)
            own = []
        else:
            own.append(t)
    return [*out, own]


def _calls(toks: list[Token]) -> list[Token]:
    """IF takes numbers as conditions; SQRT, ASIN and ACOS take texts and are NULL outside their domain; GROUP_CONCAT is LISTAGG."""
    for i in range(len(toks) - 1, -1, -1):
        t = toks[i]
        if t.kind != "word" or t.up not in ("IF", "SQRT", "ASIN", "ACOS", "GROUP_CONCAT"):
            continue
        pos = [j for j in code(toks) if j > i][:1]
        if not pos or toks[pos[0]].text != "(":
            continue
        end = _close(toks, pos[0])
        w = lambda text: Token("word", text)
        args = _arguments(toks, pos[0] + 1, end)
        if t.up == "IF":
            first = args[0]
            toks[pos[0] + 1 : pos[0] + 1 + len(first)] = [w("CAST(("), *first, w(") AS BOOLEAN)")]
        elif t.up == "GROUP_CONCAT":
            toks[i : end + 1] = _listagg(toks[pos[0] + 1 : end])
        else:
            x = args[0]
            toks[i : end + 1] = [w(f"nullif({t.text}(nvl2("), *x, w(", coalesce(try_cast("), *x, w(" AS DOUBLE), 0D), NULL)), double('NaN'))")]
    return toks


def _listagg(inner: list[Token]) -> list[Token]:
    """[DISTINCT] x, .. [ORDER BY ..] [SEPARATOR 's']"""
    depth, at = 0, {}
    for j, t in enumerate(inner):
        depth += {"(": 1, ")": -1}.get(t.text, 0)
        if depth == 0 and t.kind == "word" and t.up in ("ORDER", "SEPARATOR", "DISTINCT"):
            at[t.up] = j
    last = at.get("SEPARATOR", len(inner))
    order = inner[at["ORDER"] : last] if "ORDER" in at else None
    values = _arguments(inner, at.get("DISTINCT", -1) + 1, at.get("ORDER", last))
    joined: list[Token] = []
    for k, v in enumerate(values):
        joined += [*tokenize(", " if k else ""), *tokenize("CAST(("), *v, *tokenize(") AS STRING)")]
    if len(values) > 1:
        joined = [*tokenize("concat("), *joined, *tokenize(")")]
    by = inner[last + 1 :] if "SEPARATOR" in at else tokenize("','")
    if order and "DISTINCT" in at and len(values) == 1:
        # LISTAGG takes no other order than that of its own text; values order as they are
        x = text_of(values[0]).strip()
        by_text = text_of([t for t in order if not (t.kind == "word" and t.up in ("ORDER", "BY", "ASC", "DESC"))]).strip()
        if x.lower() == by_text.lower():
            up = "false" if any(t.up == "DESC" for t in order) else "true"
            return [*tokenize("nullif(array_join(transform(sort_array(collect_set("), *values[0], *tokenize(f"), {up}), sl_v -> CAST(sl_v AS STRING)), "), *by, *tokenize("), '')")]
    out = [*tokenize("listagg(" + ("DISTINCT " if "DISTINCT" in at else "")), *joined, *tokenize(", "), *by, *tokenize(")")]
    return [*out, Token("word", " WITHIN GROUP "), *tokenize("("), *order, *tokenize(")")] if order else out


_LOWER = {"OR", "XOR", "WHERE", "ON", "HAVING", "SELECT", "WHEN", "THEN", "ELSE", "DISTINCT", "ALL", "GROUP", "ORDER", "BY", "LIMIT", "FROM", "END", "AS", "UNION", "ASC", "DESC", "SET"}


def _xor(toks: list[Token]) -> list[Token]:
    """a XOR b, which binds less than AND and more than OR, as a comparison of two conditions."""
    while True:
        at = next((i for i, t in enumerate(toks) if t.kind == "word" and t.up == "XOR"), None)
        if at is None:
            return toks

        def edge(step: int, opens: str, closes: str, at=at) -> int:
            depth, i = 0, at + step
            while 0 <= i < len(toks):
                t = toks[i]
                depth += {opens: 1, closes: -1}.get(t.text, 0)
                if depth < 0 or (depth == 0 and (t.text in (",", "||", ";") or (t.kind == "word" and t.up in _LOWER))):
                    break
                i += step
            return i

        left, right = edge(-1, ")", "(") + 1, edge(1, "(", ")")
        w = lambda text: Token("word", text)
        toks = [*toks[:left], w(" (CAST(("), *toks[left:at], w(") AS BOOLEAN) <> CAST(("), *toks[at + 1 : right], w(") AS BOOLEAN)) "), *toks[right:]]


def _group_order(toks: list[Token]) -> list[Token]:
    """GROUP BY x DESC groups by x and, without an ORDER BY, orders by it."""
    pos, depth, start = code(toks), 0, None
    for k, p in enumerate(pos):
        t = toks[p]
        depth += {"(": 1, ")": -1}.get(t.text, 0)
        if depth == 0 and t.up == "GROUP" and k + 1 < len(pos) and toks[pos[k + 1]].up == "BY":
            start = pos[k + 1] + 1
    if start is None:
        return toks
    depth, stops = 0, {}
    for p in range(start, len(toks)):
        depth += {"(": 1, ")": -1}.get(toks[p].text, 0)
        if depth == 0 and toks[p].kind == "word" and toks[p].up in ("HAVING", "ORDER", "LIMIT", "UNION", "WITH", ";"):
            stops.setdefault(toks[p].up, p)
    end = min(stops.values(), default=len(toks))
    items = _arguments(toks, start, end)
    if not any(t.kind == "word" and t.up in ("ASC", "DESC") for item in items for t in item):
        return toks
    bare = [[t for t in item if not (t.kind == "word" and t.up in ("ASC", "DESC"))] for item in items]
    comma = lambda xs: [y for k, x in enumerate(xs) for y in ([Token("op", ","), *x] if k else x)]
    tail = min((p for w, p in stops.items() if w in ("LIMIT", "UNION")), default=len(toks))
    order = [] if "ORDER" in stops else [*tokenize(" ORDER BY "), *comma(items), *tokenize(" ")]
    return [*toks[:start], *comma(bare), *toks[end:tail], *order, *toks[tail:]]


def _cast(inner: list[Token], kind: list[Token], using: bool) -> list[Token]:
    word = [k for k in kind if k.kind not in ("space", "comment")]
    name = word[0].up if word else ""
    size = [w.text for w in word if w.kind == "number"]
    call = lambda f, *more: [Token("word", f), Token("op", "("), *inner, *[Token("op", f", {m}") for m in more], Token("op", ")")]
    if using:
        return call("trim") if name.startswith("UTF8") else call(f"sl_charset_{name.lower()}")
    if name in _TYPES:
        return call(_TYPES[name])
    if name in ("CHAR", "NCHAR"):
        return [Token("word", "left("), Token("word", "CAST("), *inner, Token("word", " AS STRING)"), Token("op", f", {size[0]})")] if size else [Token("word", "CAST("), *inner, Token("word", " AS STRING)")]
    if name == "BINARY":
        return [Token("word", "CAST("), *inner, Token("word", " AS BINARY)")]
    if name == "DECIMAL":
        p, s = (size + ["10", "0"][len(size) :])[:2] if size else ("10", "0")
        return [Token("word", "coalesce(try_cast("), *inner, Token("word", f" AS DECIMAL({p},{s})), CASE WHEN ("), *inner, Token("word", f") IS NOT NULL THEN CAST(0 AS DECIMAL({p},{s})) END)")]
    return [Token("word", "CAST("), *inner, Token("word", " AS "), *kind, Token("op", ")")]


def _divisors(toks: list[Token]) -> list[Token]:
    """A zero divisor gives NULL: the operand after `/ % DIV MOD` is wrapped, unless it is a plain number."""
    i = len(toks) - 1
    while i >= 0:
        t = toks[i]
        operator = (t.kind == "op" and t.text in "/%") or (t.kind == "word" and t.up in ("DIV", "MOD"))
        pos = [j for j in code(toks) if j > i][:1]
        if operator and pos and not (t.up == "MOD" and toks[pos[0]].text == "("):
            first = toks[pos[0]]
            if first.kind != "number" or not re.search(r"[1-9]", first.text):
                end = pos[0]
                if first.text == "-":
                    end = [j for j in code(toks) if j > end][0]
                while True:  # a name with dots, its call or a parenthesis
                    after = [j for j in code(toks) if j > end][:1]
                    if toks[end].text == "(":
                        end = _close(toks, end)
                        break
                    if toks[end].text == "." or (after and toks[end].kind in ("word", "quoted") and toks[after[0]].text in ("(", ".")):
                        end = after[0]
                    else:
                        break
                toks[pos[0] : end + 1] = [Token("word", "nullif("), *toks[pos[0] : end + 1], Token("op", ", 0)")]
        i -= 1
    return toks


def _limits(toks: list[Token]) -> list[Token]:
    """LIMIT o, n becomes LIMIT n OFFSET o."""
    i = 0
    while i < len(toks):
        if toks[i].up == "LIMIT":
            pos = [j for j in code(toks) if j > i][:3]
            if len(pos) == 3 and toks[pos[1]].text == ",":
                first, second = toks[pos[0]], toks[pos[2]]
                if first.text == second.text == "?":
                    raise ValueError("LIMIT ?, ? cannot be reordered: write LIMIT ? OFFSET ?")
                toks[i : pos[2] + 1] = [Token("word", "LIMIT "), second, Token("word", " OFFSET "), first]
        i += 1
    return toks


# ---------------------------------------------------------------- blocks and predicates

_ENDS = {"GROUP", "HAVING", "ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "OFFSET", "WINDOW"}
_NOT_ALIAS = _ENDS | {"WHERE", "ON", "USING", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "SEMI", "ANTI", "AS", "SET", "OUTER"}


@dataclass
class TableUse:
    at: int  # position of the (last) name token
    first: int  # position of the first token of a qualified name
    name: str
    alias: str
    has_alias: bool
    database: str | None = None


@dataclass
class Block:
    tables: list[TableUse]
    where: tuple[int, int] | None


def blocks(toks: list[Token]) -> list[Block]:
    """Each SELECT with the tables of its FROM and the span of its WHERE."""
    out = []
    pos = code(toks)
    depth_at, depth = {}, 0
    for p in pos:
        if toks[p].text == ")":
            depth -= 1
        depth_at[p] = depth
        if toks[p].text == "(":
            depth += 1
    for k, p in enumerate(pos):
        if toks[p].up != "SELECT":
            continue
        d, start, where, stop = depth_at[p], None, None, None
        for q in pos[k + 1 :]:
            if depth_at[q] < d:
                stop = q
                break
            if depth_at[q] != d or toks[q].kind != "word":
                continue
            up = toks[q].up
            if up == "FROM" and start is None:
                start = q
            elif up == "WHERE" and where is None:
                where = q
            elif up in _ENDS:
                stop = q
                break
        stop = len(toks) if stop is None else stop
        if start is not None:
            end = where if where is not None else stop
            out.append(Block(_tables(toks, [q for q in pos if start < q < end], depth_at, d), (where + 1, stop) if where is not None else None))
    return out


def _tables(toks: list[Token], pos: list[int], depth_at: dict[int, int], d: int) -> list[TableUse]:
    out, expect, k = [], True, 0
    while k < len(pos):
        t = toks[pos[k]]
        if expect and depth_at[pos[k]] == d and t.kind in ("word", "quoted") and t.up not in _NOT_ALIAS:
            first, names = pos[k], [t.name]
            while k + 2 < len(pos) and toks[pos[k + 1]].text == ".":
                names.append(toks[pos[k + 2]].name)
                k += 2
            at, alias, has = pos[k], names[-1], False
            if k + 1 < len(pos) and toks[pos[k + 1]].up == "AS":
                alias, has = toks[pos[k + 2]].name, True
                k += 2
            elif k + 1 < len(pos) and toks[pos[k + 1]].kind in ("word", "quoted") and toks[pos[k + 1]].up not in _NOT_ALIAS:
                alias, has = toks[pos[k + 1]].name, True
                k += 1
            out.append(TableUse(at, first, names[-1], alias, has, names[-2] if len(names) > 1 else None))
            expect = False
        elif depth_at[pos[k]] == d and (t.text == "," or t.up == "JOIN"):
            expect = True
        else:
            expect = False if t.kind != "word" or t.up not in ("LEFT", "RIGHT", "INNER", "CROSS", "OUTER", "NATURAL", "FULL") else expect
        k += 1
    return out


class PredicateReader:
    """Reads a WHERE span into a predicate of one table; what it can't read is UNKNOWN.

    `columns`: whether a (qualifier, column) is a column of the table in question.
    `constant`: value of constant text (evaluated by Spark), or LookupError.
    """

    def __init__(self, toks: list[Token], belongs: Callable[[str | None, str], bool], constant: Callable[[str], Any], params: list[Any] | None = None):
        self.toks = [t for t in toks if t.kind not in ("space", "comment", "hint")]
        self.belongs, self.constant, self.params = belongs, constant, list(params or [])
        self.at = 0

    def read(self) -> Any:
        try:
            got = self.or_()
            return got if self.at == len(self.toks) else P.UNKNOWN
        except (IndexError, LookupError):
            return P.UNKNOWN

    def up(self, k: int = 0) -> str:
        return self.toks[self.at + k].up if self.at + k < len(self.toks) else ""

    def or_(self):
        parts = [self.and_()]
        while self.up() in ("OR", "||"):
            self.at += 1
            parts.append(self.and_())
        return parts[0] if len(parts) == 1 else P.Or(tuple(parts))

    def and_(self):
        parts = [self.not_()]
        while self.up() in ("AND", "&&"):
            self.at += 1
            parts.append(self.not_())
        return parts[0] if len(parts) == 1 else P.And(tuple(parts))

    def not_(self):
        if self.up() in ("NOT", "!"):
            self.at += 1
            return P.Not(self.not_())
        if self.up() == "(":
            end = _close(self.toks, self.at)
            after = self.toks[end + 1].up if end + 1 < len(self.toks) else ""
            if self.up(1) != "SELECT" and after in ("", "AND", "OR", "||", "&&", ")"):
                inner = PredicateReader(self.toks[self.at + 1 : end], self.belongs, self.constant, self.params)
                self.at = end + 1
                return inner.read()
        return self.leaf()

    _STOP = {"AND", "OR", "||", "&&", "=", "<>", "!=", "<", ">", "<=", ">=", "<=>", "IN", "BETWEEN", "LIKE", "REGEXP", "RLIKE", "IS", "NOT"}

    def operand(self) -> list[Token]:
        start, depth = self.at, 0
        while self.at < len(self.toks):
            t = self.toks[self.at]
            if depth == 0 and (t.up in self._STOP or t.text in (")", ",")):
                break
            if t.up == "CASE":
                depth += 1
            elif t.up == "END":
                depth -= 1
            depth += {"(": 1, ")": -1}.get(t.text, 0)
            self.at += 1
        return self.toks[start : self.at]

    def value(self, toks: list[Token]) -> tuple[str, Any]:
        """("column", name), ("constant", value) or ("other", None)."""
        if not toks:
            return "other", None
        if toks[0].kind in ("word", "quoted") and len(toks) in (1, 3) and (len(toks) == 1 or toks[1].text == "."):
            if toks[0].up in ("NULL", "TRUE", "FALSE") and len(toks) == 1:
                return "constant", {"NULL": None, "TRUE": True, "FALSE": False}[toks[0].up]
            q, c = (toks[0].name, toks[2].name) if len(toks) == 3 else (None, toks[0].name)
            return ("column", c) if self.belongs(q, c) else ("other", None)
        if len(toks) == 1 and toks[0].kind == "number":
            return "constant", float(toks[0].text) if re.search(r"[.eE]", toks[0].text) else int(toks[0].text)
        if len(toks) == 2 and toks[0].text == "-" and toks[1].kind == "number":
            return "constant", -float(toks[1].text) if re.search(r"[.eE]", toks[1].text) else -int(toks[1].text)
        for k, t in enumerate(toks):
            if t.text == "?" or t.kind == "quoted" or t.text.startswith("@") or t.up == "SELECT":
                return "other", None
            if t.kind == "word" and t.up not in ("NULL", "TRUE", "FALSE", "DIV", "MOD", "CASE", "WHEN", "THEN", "ELSE", "END", "AND", "OR", "NOT") and not (k + 1 < len(toks) and toks[k + 1].text == "("):
                return "other", None
        try:
            return "constant", self.constant(" ".join(t.text for t in toks))
        except LookupError:
            return "other", None

    def leaf(self):
        left = self.operand()
        kind, what = self.value(left)
        up = self.up()
        negated = up == "NOT"
        if negated:
            self.at += 1
            up = self.up()
        if up in ("=", "<>", "!=", "<", ">", "<=", ">="):
            self.at += 1
            rkind, rwhat = self.value(self.operand())
            op = "<>" if up == "!=" else up
            if kind == "constant" and rkind == "column":
                kind, what, rkind, rwhat = rkind, rwhat, kind, what
                op = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
            if kind == "column" and rkind == "constant":
                return P.Cmp(what, op, rwhat)
            if kind == rkind == "constant" and isinstance(what, (int, float)) and isinstance(rwhat, (int, float)):
                return P.Const({"=": what == rwhat, "<>": what != rwhat, "<": what < rwhat, ">": what > rwhat, "<=": what <= rwhat, ">=": what >= rwhat}[op])
            return P.UNKNOWN
        if up == "IN":
            self.at += 1
            end = _close(self.toks, self.at)
            inner = self.toks[self.at + 1 : end]
            self.at = end + 1
            if kind != "column" or (inner and inner[0].up == "SELECT"):
                return P.UNKNOWN
            values, own, depth = [], [], 0
            for t in [*inner, Token("op", ",")]:
                if t.text == "," and depth == 0:
                    vkind, v = self.value(own)
                    if vkind != "constant":
                        return P.UNKNOWN
                    values.append(v)
                    own = []
                else:
                    depth += {"(": 1, ")": -1}.get(t.text, 0)
                    own.append(t)
            return P.In(what, tuple(values), negated)
        if up == "BETWEEN":
            self.at += 1
            lkind, low = self.value(self.operand())
            if self.up() != "AND":
                raise LookupError
            self.at += 1
            hkind, high = self.value(self.operand())
            if kind == "column" and lkind == hkind == "constant":
                p = P.between(what, low, high)
                return P.Not(p) if negated else p
            return P.UNKNOWN
        if up in ("LIKE", "REGEXP", "RLIKE"):
            self.at += 1
            right = self.operand()
            rkind, pattern = self.value(right)
            if up == "LIKE" and kind == "column" and rkind == "constant" and isinstance(pattern, str) and not re.search(r"[%_\\]", pattern):
                return P.Cmp(what, "<>" if negated else "=", pattern)
            return P.UNKNOWN
        if up == "IS":
            self.at += 1
            while self.up() in ("NOT", "NULL", "TRUE", "FALSE"):
                self.at += 1
            return P.UNKNOWN
        if up == "<=>":
            self.at += 1
            self.operand()
            return P.UNKNOWN
        if kind == "constant":
            return P.Const(bool(what) if not isinstance(what, str) else True) if what is not None else P.Const(False)
        return P.UNKNOWN
