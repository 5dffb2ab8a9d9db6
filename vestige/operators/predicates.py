"""Filter documents compiled to one Column.

A document is a leaf ``{"col", "op", "value", ...}`` or ``{"and": [...]}``,
``{"or": [...]}``, ``{"not": doc}``. Conditions are two-valued: a leaf that
can't be decided is false, so ``not`` is an exact complement.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestige.relation import Relation

# Limits of a document.
MAX_DEPTH, MAX_LEAVES, MAX_REGEX, MAX_IN = 8, 200, 1000, 10_000
#: Marks of a row; ``none`` is the absence of any.
MARKS = ("suspicious", "malicious", "agent_malicious", "none")
MARK_COLUMN = "_mark"
RANGE_OPS = {"gt", "gte", "lt", "lte", "between"}


class FilterError(ValueError):
    pass


def compile_filter(doc: dict, relation: Relation) -> Column:
    """The condition of ``doc`` over the rows of ``relation``; a bad document raises ``FilterError``."""
    leaves = [0]
    out = _node(doc, relation, 1, leaves)
    return out


def _node(doc: dict, relation: Relation, depth: int, leaves: list[int]) -> Column:
    if depth > MAX_DEPTH:
        raise FilterError("nested too deeply")
    if "and" in doc or "or" in doc:
        is_and = "and" in doc
        out = F.lit(is_and)
        for part in doc["and" if is_and else "or"]:
            inner = _node(part, relation, depth + 1, leaves)
            out = out & inner if is_and else out | inner
        return out
    if "not" in doc:
        return ~_node(doc["not"], relation, depth + 1, leaves)
    leaves[0] += 1
    if leaves[0] > MAX_LEAVES:
        raise FilterError("too many conditions")
    return _leaf(doc, relation)


def _leaf(doc: dict, relation: Relation) -> Column:
    column, op, value = doc["col"], doc["op"], doc.get("value")
    if column == MARK_COLUMN:
        return _mark(op, value, relation)
    if column not in relation.df.columns:
        raise FilterError(f"no column {column}")
    folded = not doc.get("case_sensitive", False)
    text = F.coalesce(relation.text_of(column), F.lit(""))
    shown = F.lower(text) if folded else text

    def needle(v: object) -> str:
        if not isinstance(v, str):
            raise FilterError(f"{op} needs text")
        return v.lower() if folded else v

    if op in ("eq", "ne"):
        test = shown == needle(value)
    elif op in ("contains", "not_contains"):
        test = F.contains(shown, F.lit(needle(value)))
    elif op == "starts_with":
        test = F.startswith(shown, F.lit(needle(value)))
    elif op == "ends_with":
        test = F.endswith(shown, F.lit(needle(value)))
    elif op == "regex":
        test = text.rlike(safe_regex(value, folded))
    elif op in ("in", "not_in"):
        if len(value) > MAX_IN:
            raise FilterError("too many values")
        test = shown.isin([needle(v) for v in value]) if value else F.lit(False)
    elif op in RANGE_OPS:
        test = _range(op, value, column, relation, shown, folded)
    elif op in ("is_empty", "not_empty"):
        test = text == ""
    elif op == "conversion_failed":
        test = F.col(column).isNull() & (text != "") if column in relation.typed else F.lit(False)
    else:
        raise FilterError(f"no operation {op}")
    test = F.coalesce(test, F.lit(False))
    return ~test if op in ("ne", "not_contains", "not_in", "not_empty") else test


def _mark(op: str, value: object, relation: Relation) -> Column:
    """A test of the row's mark, the column that ``records.with_marks`` adds."""
    wanted = [value] if op in ("eq", "ne") else list(value) if op in ("in", "not_in") else None
    if wanted is None or any(v not in MARKS for v in wanted):
        raise FilterError(f"{MARK_COLUMN} is one of {', '.join(MARKS)}")
    if MARK_COLUMN not in relation.df.columns:
        raise FilterError("the rows have no marks")
    test = F.coalesce(MARK_COLUMN, F.lit("none")).isin(wanted) if wanted else F.lit(False)
    return ~test if op in ("ne", "not_in") else test


def _range(op: str, value: object, column: str, relation: Relation, shown: Column, folded: bool) -> Column:
    bounds = list(value) if op == "between" else [value]
    numeric = [isinstance(b, (int, float)) and not isinstance(b, bool) for b in bounds]
    if op == "between" and (len(bounds) != 2 or numeric[0] != numeric[1]):
        raise FilterError("between needs two bounds of one kind")
    if column in relation.typed:
        left, limits = F.col(column), [F.lit(b) for b in bounds]
    elif numeric[0]:
        left, limits = shown.try_cast("double"), [F.lit(float(b)) for b in bounds]
    else:
        left, limits = shown, [F.lit(b.lower() if folded else b) for b in bounds]
    if op == "between":
        return left.between(limits[0], limits[1])
    return {"gt": left > limits[0], "gte": left >= limits[0], "lt": left < limits[0], "lte": left <= limits[0]}[op]


def safe_regex(pattern: str, folded: bool, most: int = MAX_REGEX) -> str:
    """A pattern whose matching takes no exponential time.

    Refused: look-around, back-references, possessive repeats, repeats of what
    ends in a repeat, and unbounded repeats of alternatives of which two may start
    alike or one may be empty.
    """
    if not isinstance(pattern, str) or len(pattern) > most:
        raise FilterError("pattern too long")
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\\k<|\(\?>|[+*?}]\+", pattern):
        raise FilterError("look-around, back-references and possessive repeats aren't allowed")
    if re.search(r"[+*}]\??\)+(?:[+*]|\{\d+,)", pattern):
        raise FilterError("a repeat of what ends in a repeat isn't allowed: matching it may take exponential time")
    if _ambiguous(pattern):
        raise FilterError("an unbounded repeat of alternatives that may start alike isn't allowed: matching it may take exponential time")
    return ("(?iu)" if folded else "") + pattern


def _ambiguous(pattern: str) -> bool:
    """Whether an unbounded repeat holds alternatives that one character can choose between in two ways."""
    repeated = r"\)(?:[+*]|\{\d+,\})"
    for closing in re.finditer(repeated, pattern):
        depth, at, parts, end = 1, closing.start() - 1, [], closing.start()
        while at >= 0 and depth:
            if pattern[at] in "()|" and _bare(pattern, at):
                depth += {")": 1, "(": -1}.get(pattern[at], 0)
                if pattern[at] == "|" and depth == 1 or not depth:
                    parts.append(pattern[at + 1 : end])
                    end = at
            at -= 1
        firsts = [re.sub(r"^(?:\?:|\?P?<\w+>)", "", p) for p in parts]
        if len(firsts) > 1 and (not all(firsts) or any(_start_alike(x, y) for i, x in enumerate(firsts) for y in firsts[:i])):
            return True
    return False


def _bare(pattern: str, at: int) -> bool:
    """Whether the character at a place is neither escaped nor in a class."""
    slashes = len(pattern[:at]) - len(pattern[:at].rstrip("\\"))
    before = re.sub(r"\\.", "__", pattern[:at], flags=re.S)
    return slashes % 2 == 0 and before.rfind("[") <= before.rfind("]")


def _start_alike(x: str, y: str) -> bool:
    """Whether two alternatives may start with one character: literals are compared, anything else may."""
    literal = re.compile(r"(\w|[ _/:;,@#%&=<>!~\"'-])(?![?*{])|\\([^\w])(?![?*{])")
    one, other = literal.match(x), literal.match(y)
    return not (one and other) or (one[1] or one[2]).lower() == (other[1] or other[2]).lower()


def apply_filter(relation: Relation, doc: dict) -> DataFrame:
    return relation.df.where(compile_filter(doc, relation))


def pick_hosts(known: list[str], wanted: list[str]) -> list[str]:
    """The known names of ``wanted``: matched exactly, else ignoring case; an unknown host is an error."""
    out = []
    for name in wanted:
        hits = [h for h in known if h == name] or [h for h in known if h.lower() == name.lower()]
        if not hits:
            raise FilterError(f"no host {name}")
        out += hits
    return out


def group_filter(keys: dict[str, str | None]) -> dict:
    """A filter document that picks exactly one group; a key of ``_mark`` is a mark, null is none."""

    def leaf(c: str, v: str | None) -> dict:
        if c == MARK_COLUMN:
            return {"col": c, "op": "eq", "value": v or "none"}
        return {"col": c, "op": "is_empty"} if v in (None, "") else {"col": c, "op": "eq", "value": v, "case_sensitive": True}

    return {"and": [leaf(c, v) for c, v in keys.items()]}


def colour(rules: list[tuple[int, dict]], relation: Relation) -> Column:
    """The id of the first rule whose document a row matches."""
    return F.coalesce(*[F.when(compile_filter(doc, relation), F.lit(i)) for i, doc in rules])


# The search box -------------------------------------------------------------


#: Characters and terms of one search.
MAX_SEARCH, MAX_TERMS = 2000, 50
#: White space that parts terms; U+001C to U+001F don't.
_BETWEEN = r"[^\S\x1c-\x1f]"
_TERM = re.compile(rf'(?:"[^"]*"?|(?!{_BETWEEN})[^"])+')


@dataclass(frozen=True)
class Term:
    """``sign``: ``+`` all, ``-`` none, else any; ``column``: the one that may hold the text, or None for every searchable one."""

    sign: str
    column: str | None
    text: str


def parse_search(text: str, columns: list[str]) -> list[Term]:
    """The terms of a search over a relation with ``columns``.

    White space parts terms, but not inside double quotes, which are left out; a
    quote without its end reaches to the end. ``+`` and ``-`` are signs if something follows.
    ``name:rest`` asks one column only if the name has no quote, names a column of the relation, in
    either case of letters, and the rest has text; any other term is text as a whole. Terms without text are left out.
    """
    if len(text) > MAX_SEARCH:
        raise FilterError(f"a search has at most {MAX_SEARCH} characters")
    by_name = {c.lower(): c for c in reversed(columns)}
    out = []
    for found in _TERM.findall(text):
        sign = found[0] if found[0] in "+-" and len(found) > 1 else ""
        body = found[len(sign) :]
        name, _, rest = body.partition(":")
        column = by_name.get(name.lower()) if rest.replace('"', "") else None  # a name with a quote is none of them
        term = (rest if column else body).replace('"', "")
        if term:
            out.append(Term(sign, column, term))
    if len(out) > MAX_TERMS:
        raise FilterError(f"a search has at most {MAX_TERMS} terms")
    return out


def search(text: str, relation: Relation, regex: bool = False, case_sensitive: bool = False) -> Column:
    """Any of the plain terms, all of ``+`` terms, none of ``-`` terms; a term without column may be in any data cell or the host.

    ``regex``: the whole text is one pattern, tested on each of these cells by itself. A blank search picks every row.
    """
    columns = [*relation.data, *([relation.host] if relation.host else [])]

    def anywhere(test) -> Column:
        out = F.lit(False)
        for c in columns:
            out = out | test(F.coalesce(relation.text_of(c), F.lit("")))
        return out

    if len(text) > MAX_SEARCH:
        raise FilterError(f"a search has at most {MAX_SEARCH} characters")
    if regex:
        if not text.strip():
            return F.lit(True)
        try:
            re.compile(text)
        except re.error as e:
            raise FilterError(f"not a pattern: {e}") from e
        return anywhere(lambda cell: cell.rlike(safe_regex(text, not case_sensitive, MAX_SEARCH)))

    def hit(term: Term) -> Column:
        wanted = F.lit(term.text if case_sensitive else term.text.lower())
        test = lambda cell: F.contains(cell if case_sensitive else F.lower(cell), wanted)
        return test(F.coalesce(relation.text_of(term.column), F.lit(""))) if term.column else anywhere(test)

    every, anything, has_any = F.lit(True), F.lit(False), False
    for term in parse_search(text, relation.df.columns):
        if term.sign == "+":
            every = every & hit(term)
        elif term.sign == "-":
            every = every & ~hit(term)
        else:
            anything, has_any = anything | hit(term), True
    return every & anything if has_any else every


def registry_pattern(glob: str) -> str:
    """A key-path glob as an anchored pattern: ``*`` stays inside its segment, a prefix of segments matches."""
    segments = ["".join(r"[^\\]*" if p == "*" else re.escape(p) for p in re.split(r"(\*)", s)) for s in glob.split("\\")]
    return r"(?iu)^" + r"\\".join(segments) + r"(\\.*)?$"
