"""One template at a time: the edits that ``rewrite.edit_plans`` finds with windows, and the text they give.

Tags are paired by a stack per name, what lies in what is found by counting open ends, both in one pass. Patterns are
those of ``rewrite`` with the character classes of Spark's regular expressions.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from shiftwright.functions.text import WHITE_SPACE
from shiftwright.operators import rewrite

# (?U) in Java: \s is Unicode's White_Space; \w is Alphabetic, marks, digits, connectors, joiners.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD_CATEGORIES = ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Mn", "Mc", "Me", "Nd", "Pc")
MORE_WORD_CHARACTERS = r"\u200c\u200d\u24b6-\u24e9\U0001f130-\U0001f149\U0001f150-\U0001f169\U0001f170-\U0001f189"
# What ends no word for Java's \b, besides the underscore.
LETTER_CATEGORIES = ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd", "Mn")

PARTNERLESS, EDITED = frozenset(rewrite.VOID), frozenset(rewrite.EDITED)
ALWAYS_WANTED = frozenset(["template", "case", "default"])
SWITCH_MARKERS, CASES = frozenset(["switch", "case", "default"]), frozenset(["case", "default"])
SLOT, CUT = rewrite.SLOT, rewrite.CUT


@cache
def _class(categories: tuple[str, ...]) -> str:
    """The characters of some categories, as ranges."""
    ranges: list[list[int]] = []
    for code in range(0x110000):
        if unicodedata.category(chr(code)) in categories:
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def _compiled(java: str, plain: bool, group: bool = False) -> re.Pattern:
    """A pattern of ``rewrite`` in Python's dialect; with ``plain``, for texts of ASCII characters only."""
    flags, body = re.match(r"(?s)(?:\(\?(\w+)\))?(.*)", java).groups(default="")
    body = body.replace(r"\z", r"\Z")
    if "U" in flags and not plain:
        word = _class(WORD_CATEGORIES) + MORE_WORD_CHARACTERS
        body = body.replace(r"[\w", f"[{word}").replace(r"\w", f"[{word}]").replace(r"\s", f"[{SPACES}]")
    elif not plain:
        body = body.replace(r"\b", f"(?![_{_class(LETTER_CATEGORIES)}])")  # stands behind a letter everywhere
    options = re.A | (re.S if "s" in flags else 0) | (re.I if "i" in flags else 0)
    return re.compile(f"({body})" if group else body, options)


class _Patterns:
    def __init__(self, plain: bool):
        self.split = _compiled(rewrite.TAG, plain, group=True).split
        self.opaque = _compiled(rewrite.OPAQUE, plain).match
        self.name = _compiled(rewrite.NAME, plain).match
        self.template = _compiled(rewrite.TEMPLATE, plain).match
        self.if_value = _compiled(rewrite.IF_VALUE, plain).search
        self.for_value = _compiled(rewrite.FOR_VALUE, plain).search
        self.switch_value = _compiled(rewrite.SWITCH_VALUE, plain).search
        self.case_value = _compiled(rewrite.CASE_VALUE, plain).search
        self.then_else = _compiled(rewrite.THEN_ELSE, plain).match
        self.else_ = _compiled(rewrite.ELSE, plain).match
        self.async_alias = _compiled(rewrite.ASYNC_ALIAS, plain).search
        self.for_ = _compiled(rewrite.FOR, plain).match
        self.any_ref = _compiled(rewrite.ANY_REF, plain).findall
        self.around = _compiled(rewrite.AROUND_DIRECTIVE, plain).match
        self.track_by = _compiled(rewrite.TRACK_BY, plain).match
        self.local = _compiled(rewrite.LOCAL, plain).match


_patterns = cache(_Patterns)


class _Span:
    """A directive tag or a template and what is known of it."""

    __slots__ = (
        "pos", "tag", "name", "close", "kind", "value", "parts", "wanted", "editable", "removed", "inside", "in_switch",
        "is_child", "moved", "moved_default", "previous", "is_last", "dropped_depth", "owner", "shown",
    )

    def __init__(self, pos: int, tag: str, name: str):
        self.pos, self.tag, self.name = pos, tag, name
        self.close = self.value = self.parts = self.moved_default = self.previous = self.owner = None
        self.removed = self.moved = self.is_last = False
        self.dropped_depth = 0


_directive = re.compile("|".join(re.escape(d) for d in rewrite.DIRECTIVES)).search


def _spans(tokens: list[str], p: _Patterns) -> list[_Span]:
    """Opening tags with directives and templates, in order, with their closing tags."""
    tags, names = [], set()
    for pos in range(1, len(tokens), 2):
        tag = tokens[pos]
        if tag[1] in "!sS" and p.opaque(tag):
            continue
        name, marked = p.name(tag)[1], "ng" in tag and (tag.startswith("<ng-template") or _directive(tag))
        if marked:
            names.add(name)
        tags.append((pos, tag, name, marked))
    found, opened = [], {name: [] for name in names}
    for pos, tag, name, marked in tags:
        if name not in names:
            continue
        if tag.startswith("</"):
            begun = opened[name].pop() if opened[name] else None
            if begun:
                begun.close = pos
            continue
        span = None
        if marked:
            span = _Span(pos, tag, name)
            found.append(span)
        if not (tag.endswith("/>") or name in PARTNERLESS):
            opened[name].append(span)
    return found


def _kind(s: _Span, p: _Patterns) -> str | None:
    """As ``rewrite._kind``. Leaves the value of ``*ngIf``, and the parts of what is edited or referred to."""
    tag = s.tag
    if s.name == "ng-template" and (m := p.template(tag)):
        s.parts = m[1]
        return "template"
    held = [d for d in rewrite.DIRECTIVES if d in tag]
    if "*ngIf" in held and (m := p.if_value(tag)):
        s.value = m[1]
    if len(held) != 1:
        return "several" if held else None
    if held[0] == "*ngIf":
        if s.value is None:
            return "invalid"
        for kind, pattern in (("then_else", p.then_else), ("else", p.else_)):
            if m := pattern(s.value):
                s.parts = m.groups()
                return kind
        if p.async_alias(s.value):
            return "async"
        s.parts = (s.value,)
        return "if"
    if held[0] == "*ngFor":
        value = p.for_value(tag)
        m = value and p.for_(value[1])
        if not m:
            return "invalid"
        s.parts = m.groups(default="")
        return "for_with" if s.parts[2] else "for"
    if held[0] == "*ngSwitchDefault":
        return "default"
    m = (p.switch_value if held[0] == "[ngSwitch]" else p.case_value)(tag)
    if not m:
        return "invalid"
    s.parts = m.groups()
    return "switch" if held[0] == "[ngSwitch]" else "case"


def _around(spans: list[_Span], markers: list[bool]) -> list[_Span | None]:
    """For each span the innermost marker around it: the last one opened before it at its level, as in ``_innermost``."""
    if True not in markers:
        return [None] * len(spans)
    closes = sorted(s.close for s, marker in zip(spans, markers, strict=True) if marker)
    found, at_level, opened, closed = [], {}, 0, 0
    for s, marker in zip(spans, markers, strict=True):
        while closed < len(closes) and closes[closed] <= s.pos:
            closed += 1
        found.append(at_level.get(opened - closed))
        if marker:
            opened += 1
            at_level[opened - closed] = s
    return found


def _cross(paired: list[_Span]) -> bool:
    ends = []
    for s in paired:
        while ends and ends[-1] < s.pos:
            ends.pop()
        if ends and ends[-1] < s.close:
            return True
        ends.append(s.close)
    return False


def _order_children(spans: list[_Span]) -> None:
    """The cases of each switch, the first default last (see ``rewrite._with_children``)."""
    cases: dict[int, list[_Span]] = {s.pos: [] for s in spans if s.kind == "switch" and s.editable}
    for s in spans if cases else ():
        if s.is_child:
            cases[s.inside.pos].append(s)
    for s in spans if cases else ():
        if s.pos not in cases:
            continue
        children = cases[s.pos]
        default = next((c for c in children if c.kind == "default"), None)
        last = children[-1] if children else None
        moved_default = default if default is not last else None
        previous = s
        for c in children:
            c.moved = c.kind == "default" and (c is not last or c is not default)
            c.moved_default = moved_default
            if not c.moved:
                c.previous, previous = previous, c
        s.moved_default = moved_default
        previous.is_last = True


def _drop_depths(spans: list[_Span]) -> None:
    """How many then/else elements, whose content goes, each span lies in."""
    closes = sorted(s.close for s in spans if s.editable and s.kind == "then_else")
    opened = closed = 0
    for s in spans if closes else ():
        while closed < len(closes) and closes[closed] <= s.pos:
            closed += 1
        s.dropped_depth = opened - closed
        opened += s.editable and s.kind == "then_else"


def _opening(s: _Span, p: _Patterns) -> str:
    """The opening tag without its directive; attributes on both sides stay."""
    m = p.around(s.tag)
    attributes = (m[1] + m[2] if m else s.tag).strip(WHITE_SPACE)
    return f"<{s.name} {attributes}>" if attributes else f"<{s.name}>"


def _head(s: _Span, p: _Patterns) -> str:
    """The start of the block an element turns into."""
    if s.kind in ("if", "else", "then_else"):
        return f"@if ({s.parts[0].strip(WHITE_SPACE)}) {{\n"
    if s.kind in ("for", "for_with"):
        return f"{_for_head(*s.parts, p)} {{\n"
    if s.kind == "switch":
        return f"@switch ({s.parts[0].strip(WHITE_SPACE)}) {{\n"
    return f"  @case ({s.parts[0].strip(WHITE_SPACE)}) {{\n" if s.kind == "case" else "  @default {\n"


def _for_head(item: str, collection: str, rest: str, p: _Patterns) -> str:
    clauses = [c.strip(WHITE_SPACE) for c in rest.split(";")]
    tracks = [m[1] for c in clauses if (m := p.track_by(c))]
    track = f"{tracks[-1]}($index, {item})" if tracks else item
    names = "".join(f"; let {m[1]} = ${m[2]}" for c in clauses if (m := p.local(c)))
    return f"@for ({item} of {collection}; track {track}{names})"


def _slot(ref: str, templates: dict[str, int]) -> str:
    return f"{SLOT}{templates[ref]}{SLOT}" if ref in templates else f"<!-- WARNING: ng-template #{ref} not found -->"


def _moved(default: _Span, p: _Patterns) -> str:
    """A default written after the other cases, whose content is a fragment."""
    return f"  @default {{\n    {_opening(default, p)}{SLOT}{default.pos}{SLOT}</{default.name}>\n  }}"


def _edits(s: _Span, templates: dict[str, int], p: _Patterns) -> tuple[tuple, ...]:
    """The edits of a span (see ``rewrite._edit_list``): ranges of tokens, what tells them apart, and what to write there."""
    kind, pos, close = s.kind, s.pos, s.close
    if not s.shown:
        return ()
    if s.removed:
        return ((pos, close, "cut", pos, CUT),)
    if s.is_child:
        if s.moved:
            return ()
        # A child writes everything since the child before it, or since the switch began.
        before, text = s.previous, f"{_head(s, p)}    {_opening(s, p)}"
        if before.is_child:
            child = before.close, pos, "next child", pos, f"</{before.name}>\n  }}\n{text}"
        else:
            child = before.pos, pos, "first child", pos, _head(before, p) + text
        if not s.is_last:
            return (child,)
        block = f"\n{_moved(s.moved_default, p)}" if s.moved_default else ""
        return child, (close, s.inside.close, "children end", pos, f"</{s.name}>\n  }}{block}\n}}")
    if not s.editable:
        return ()
    if kind == "switch":
        block = _moved(s.moved_default, p) if s.moved_default else ""
        return ((pos, close, "no children", pos, f"{_head(s, p)}{block}\n}}"),) if s.is_last else ()
    if kind == "then_else":
        then, other = (_slot(ref, templates) for ref in s.parts[1:])
        return ((pos, close, "both", pos, f"{_head(s, p)}  {then}\n}} @else {{\n  {other}\n}}"),)
    if kind in CASES:
        return ()
    closing = f"</{s.name}>\n}}"
    if kind == "else":
        closing += f" @else {{\n  {_slot(s.parts[1], templates)}\n}}"
    return (pos, pos, "open", pos, f"{_head(s, p)}  {_opening(s, p)}"), (close, close, "close", pos, closing)


def _spliced(tokens: list[str], start: int, end: int, edits: list[tuple]) -> str:
    """Tokens ``start`` up to ``end`` with the edits' ranges replaced."""
    out, at = [], start
    edits.sort()
    for first, last, _, _, text in edits:
        out += tokens[at:first]
        out.append(text)
        at = last + 1
    return "".join(out + tokens[at:end])


def _filled(pieces: list[str], done: dict[str, str]) -> str | None:
    """A text cut at its slots, with the slots filled; None if a fragment is not complete."""
    out = pieces[:]
    for i in range(1, len(out), 2):
        if out[i] not in done:
            return None
        out[i] = done[out[i]]
    return "".join(out)


def _assembled(tokens: list[str], spans: list[_Span], templates: dict[str, int], p: _Patterns) -> str | None:
    """The text from its tokens and edits; None if templates refer to each other in a circle."""
    fragments = [s for s in spans if s.removed or s.moved]
    edits: dict[int, list] = {-1: []} | {s.pos: [] for s in fragments}
    for s in spans:
        edits[s.owner.pos if s.owner else -1] += _edits(s, templates, p)
    main = _spliced(tokens, 0, len(tokens), edits[-1]).split(SLOT)
    # From the inside out: each round completes the fragments whose own slots are all filled.
    done: dict[str, str] = {}
    todo = {}
    for s in fragments:
        text = _spliced(tokens, s.pos + 1, s.close, edits[s.pos])
        todo[str(s.pos)] = (text.strip(WHITE_SPACE) if s.removed else text).split(SLOT)
    while todo:
        fresh = {number: text for number, pieces in todo.items() if (text := _filled(pieces, done)) is not None}
        if not fresh:
            break
        done |= fresh
        todo = {number: pieces for number, pieces in todo.items() if number not in fresh}
    text = _filled(main, done)
    if text is None or CUT not in text:
        return text
    first, *middle, last = text.split(CUT)
    middle = [x for x in (part.strip(WHITE_SPACE) for part in middle) if x]
    return "\n".join([first.rstrip(WHITE_SPACE), *middle, last.lstrip(WHITE_SPACE)])


def rewritten(text: str, pattern_id: str | None = None) -> tuple[str | None, list[str], list[str], int, str | None]:
    """(after, applied, skipped, unresolved, error) of a text whose marks are escaped; ``after`` is None where it stays."""
    p = _patterns(text.isascii())
    tokens = p.split(text)
    spans = []
    for s in _spans(tokens, p):
        s.kind = kind = _kind(s, p)
        if kind:
            s.wanted = pattern_id is None or kind in ALWAYS_WANTED or rewrite.PATTERN.get(kind) == pattern_id
            s.editable = s.wanted and kind in EDITED and s.close is not None
            spans.append(s)
    if not spans:
        return None, [], [], 0, None

    # Templates by name; those referred to are written where they are used, and removed.
    templates: dict[str, int] = {}
    used, kept = set(), set()
    for s in spans:
        if s.kind == "template":
            if s.close is not None:
                templates.setdefault(s.parts, s.pos)
        elif s.editable:
            if s.kind in ("else", "then_else"):
                used.update(s.parts[1:])
        elif s.value is not None:
            kept.update(p.any_ref(s.value))
    conflict = False
    for s in spans if used else ():
        if s.kind == "template" and s.close is not None and s.parts in used:
            s.removed = True
            conflict |= s.parts in kept

    nested_switch = False
    for s, inside in zip(spans, _around(spans, [s.removed or (s.editable and s.kind in SWITCH_MARKERS) for s in spans]), strict=True):
        s.inside = inside
        s.in_switch = inside is not None and inside.kind == "switch"
        s.is_child = s.in_switch and s.editable and s.kind in CASES
        nested_switch |= s.in_switch and s.editable and s.kind == "switch"
    skipped = [rewrite.PATTERN["async"]] if any(s.kind == "async" and s.wanted for s in spans) else []
    unresolved = sum(
        (not s.editable and s.wanted and s.kind not in ("template", "async")) or (s.editable and s.kind in CASES and not s.is_child)
        for s in spans
    )
    spoiled = [_cross([s for s in spans if s.editable or s.removed]), nested_switch, conflict]
    if any(spoiled):
        return None, [], skipped, unresolved, rewrite.SPOILED[spoiled.index(True)]

    _order_children(spans)
    _drop_depths(spans)
    for s, owner in zip(spans, _around(spans, [s.removed or s.moved for s in spans]), strict=True):
        s.owner = owner
        dropped = s.dropped_depth > (owner.dropped_depth if owner else 0)
        s.shown = not (dropped or (s.in_switch and not s.is_child))
    after = _assembled(tokens, spans, templates, p)
    if after is None:
        return None, [], skipped, unresolved, "template reference cycle"
    return after, [rewrite.PATTERN[s.kind] for s in spans if s.editable and s.shown and s.kind not in CASES], skipped, unresolved, None
