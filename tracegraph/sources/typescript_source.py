"""Facts of one TypeScript file, read with patterns over text whose strings and comments are blanked."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from types import SimpleNamespace

ID = r"[A-Za-z_$][\w$]*"
MASKED = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
FUNCTION = re.compile(rf"(export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*({ID})?\s*(?:<[^()]*>)?\s*\(")
CLASS = re.compile(rf"(export\s+(?:default\s+)?)?(?<!abstract )\bclass\s+({ID})([^{{]*)\{{")
SHAPE = re.compile(rf"(export\s+)?\b(interface|enum|type)\s+({ID})\b")
ARROW_CONST = re.compile(rf"(export\s+)?\b(const|let)\s+({ID})\s*(?::[^=;]+)?=\s*(?=(?:async\s+)?(?:function\b|\(|{ID}\s*=>))")
METHOD = re.compile(rf"(?:(?:public|private|protected|static|readonly|override|async|get|set)\s+)*\*?\s*({ID})\s*(?:<[^()]*>)?\s*\(")
DECLARATION = re.compile(r"\b(const|let|var)\s+")
CALL = re.compile(rf"({ID})\s*(?:<[\w\s,.\[\]]*>)?\s*\(")
IMPORT = re.compile(r"import\s+(?:type\s+)?([^'\";]+?)\s+from\s*['\"]([^'\"]+)['\"]")
NOT_CALLS = set("if for while switch catch return function typeof await new super import constructor async of in do else case throw".split())
CLOSING = {"(": ")", "[": "]", "{": "}"}


def blank(match: re.Match) -> str:
    s = match.group(0)
    if s.startswith("/"):
        return re.sub(r"[^\n]", " ", s)
    return s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1]


def match_brackets(text: str) -> dict[int, int]:
    close, stack = {}, []
    for i, c in enumerate(text):
        if c in "([{":
            stack.append(i)
        elif c in ")]}" and stack:
            close[stack.pop()] = i
    return close


def split_top(text: str, start: int, end: int, close: dict[int, int]) -> list[tuple[int, int]]:
    """Spans between top-level commas."""
    spans, at, i = [], start, start
    while i < end:
        if text[i] in "([{" and i in close:
            i = close[i]
        elif text[i] == ",":
            spans.append((at, i))
            at = i + 1
        i += 1
    spans.append((at, end))
    return [(a, b) for a, b in spans if text[a:b].strip()]


def argument_kind(s: str) -> str:
    if re.fullmatch(ID, s):
        return "literal" if s in ("true", "false", "null", "undefined") else "identifier"
    if re.match(r"^(['\"`]).*\1$", s, re.S) or re.fullmatch(r"\d[\w.]*", s) or re.match(r"^/.+/\w*$", s):
        return "literal"
    if s.startswith("..."):
        return "spread"
    if re.match(rf"^(new\s+)?{ID}(\??\.{ID})*\(.*\)$", s, re.S):
        return "call"
    if re.fullmatch(rf"{ID}(\??\.{ID}|\[[^\]]*\])+", s):
        return "member"
    return "other"


CONTINUES = re.compile(r"\s*[.,?:+\-*/&|=]")
FOR_HEAD = re.compile(r"\bfor\s*(?:await\s*)?\($")


def binding_names(pattern: str) -> list[str]:
    """Names bound by an identifier, object or array pattern."""
    pattern = pattern.strip()
    if re.fullmatch(ID, pattern):
        return [pattern]
    if not pattern or pattern[0] not in "{[":
        return []
    names = []
    close = match_brackets(pattern)
    for a, b in split_top(pattern, 1, close.get(0, len(pattern)), close):
        part = pattern[a:b].strip().removeprefix("...")
        if pattern[0] == "{" and re.match(rf"^{ID}\s*:", part):
            part = part.split(":", 1)[1]
        names += binding_names(re.split(r"=(?!>)", part, maxsplit=1)[0])
    return names


def typescript_facts(source: str) -> SimpleNamespace:
    text = MASKED.sub(blank, source)
    close = match_brackets(text)
    lines = source.split("\n")
    out = SimpleNamespace(symbols=[], edges=[], imports=[], params=[])
    ranges: list[tuple[int, int, int]] = []           # (start, end, symbol) that may own calls
    bodies: list[tuple[int, int, str | None]] = []    # function bodies with their name
    declared: set[int] = set()                        # positions of names that are declarations, not calls
    breaks = [m.start() for m in re.finditer("\n", source)]
    line_of = lambda pos: bisect_left(breaks, pos) + 1

    def add(name, kind, start, end, exported=False, parent=None, type_text=None, end_line=None):
        first = lines[line_of(start) - 1][start - (breaks[line_of(start) - 2] + 1 if line_of(start) > 1 else 0) :].strip()[:200]
        out.symbols.append(
            dict(idx=len(out.symbols), name=name, kind=kind, parent_idx=parent, start_line=line_of(start), end_line=end_line or line_of(end),
                 signature=first, exported=exported, type_text=type_text)
        )
        return len(out.symbols) - 1

    def body_after(paren_close: int) -> tuple[int, int] | None:
        """Braces that follow a parameter list and an optional return type."""
        i = paren_close + 1
        m = re.compile(r"\s*(?::\s*[^{};=]*(?:\{[^{}]*\}[^{};=]*)?)?\{").match(text, i)
        if not m:
            return None
        start = m.end() - 1
        return (start, close[start]) if start in close else None

    def add_params(open_paren: int, owner: int):
        if open_paren not in close:
            return
        for position, (a, b) in enumerate(split_top(text, open_paren + 1, close[open_paren], close)):
            raw = re.sub(r"^\s*(?:(?:public|private|protected|readonly)\s+)*", "", source[a:b]).strip()
            m = re.match(rf"^(\.\.\.)?({ID}|\{{.*?\}}|\[.*?\])(\?)?\s*(?::\s*([^=]+?(?:=>[^=]+)?))?\s*(=(?!>).*)?$", raw, re.S)
            if m:
                kind_text = (m.group(4) or "").strip()[:200] or None
                out.params.append(
                    dict(owner_idx=owner, position=position, name=m.group(2)[:100], type_text=kind_text, has_default=bool(m.group(3) or m.group(5)))
                )

    for m in CLASS.finditer(text):
        start = m.start() + len(m.group(1) or "")
        open_brace = m.end() - 1
        end = close.get(open_brace, len(text) - 1)
        idx = add(m.group(2), "class", start, end, bool(m.group(1)))
        ranges.append((start, end, idx))
        heritage = m.group(3)
        base = re.search(rf"\bextends\s+({ID}(?:\.{ID})*)", heritage)
        targets = [(base.group(1).split(".")[-1], "EXTENDS")] if base else []
        impl = re.search(r"\bimplements\s+(.+)$", heritage, re.S)
        if impl:
            targets += [(n, "IMPLEMENTS") for n in re.findall(rf"(?:^|,)\s*({ID})\s*(?=,|<|$|\s)", impl.group(1))]
        for name, kind in targets:
            out.edges.append(dict(from_idx=idx, to_name=name, kind=kind, call_line=line_of(m.start(3)), line_text="", args=[]))
        i = open_brace + 1
        while i < end:
            mm = None if text[i].isspace() else METHOD.match(text, i)
            if mm and mm.group(1) not in NOT_CALLS - {"constructor"} and text[i - 1] in " \n\t;{}":
                paren = mm.end() - 1
                body = body_after(close.get(paren, len(text)))
                declared.add(mm.start(1))
                if body:
                    method = add(mm.group(1), "method", i, body[1], parent=idx)
                    ranges.append((i, body[1], method))
                    bodies.append((body[0], body[1], mm.group(1)))
                    add_params(paren, method)
                    i = body[1] + 1
                    continue
                i = close.get(paren, mm.end()) + 1
                continue
            i = close[i] + 1 if text[i] in "([{" and i in close else i + 1
    for m in FUNCTION.finditer(text):
        paren = m.end() - 1
        body = body_after(close.get(paren, len(text)))
        if m.group(2):
            declared.add(m.start(2))
        if body and m.group(2):
            start = m.start() + len(m.group(1) or "")
            idx = add(m.group(2), "function", start, body[1], bool(m.group(1)))
            ranges.append((start, body[1], idx))
            add_params(paren, idx)
        if body:
            bodies.append((body[0], body[1], m.group(2)))
    for m in SHAPE.finditer(text):
        brace = text.find("{", m.end())
        if m.group(2) == "type":
            m_eq = re.compile(r"\s*(?:<[^=]*>)?\s*=").match(text, m.end())
            if not m_eq:
                continue
            end = m.end()
            while end < len(text) and text[end] != ";":
                end = close[end] + 1 if text[end] in "([{" and end in close else end + 1
        elif brace < 0:
            continue
        else:
            end = close.get(brace, len(text) - 1)
        add(m.group(3), m.group(2), m.start() + len(m.group(1) or ""), min(end, len(text) - 1), bool(m.group(1)))
    for m in ARROW_CONST.finditer(text):
        rest = re.compile(rf"(?:async\s+)?(?:(function\b[^(]*)?\(|({ID})\s*=>)").match(text, m.end())
        if not rest:
            continue
        open_paren = rest.end() - 1 if rest.group(2) is None else None
        after = close.get(open_paren, m.end()) + 1 if open_paren is not None else rest.end()
        if open_paren is not None and rest.group(1) is None:
            arrow = re.compile(r"\s*(?::\s*[^=;{]*)?=>").match(text, after)
            if not arrow:
                continue
            after = arrow.end()
        brace = re.compile(r"[^{;\n]*?\{" if rest.group(1) else r"\s*\{").match(text, after)
        end = close.get(brace.end() - 1, after) if brace else next((i for i in range(after, len(text)) if text[i] in ";\n"), len(text) - 1)
        start = m.start() + len(m.group(1) or "")
        idx = add(m.group(3), "const", start, end, bool(m.group(1)))
        ranges.append((start, end, idx))
        bodies.append((after, end, m.group(3)))
        if open_paren is not None:
            add_params(open_paren, idx)
    known = {b[0] for b in bodies}
    for m in re.finditer(r"=>\s*\{", text):
        if m.start() + 2 not in known and m.end() - 1 not in known:
            known.add(m.end() - 1)
            bodies.append((m.end() - 1, close.get(m.end() - 1, len(text)), None))

    def nested(spans):
        """Spans by start, and for each the one around it."""
        order, around, open_spans = sorted(spans, key=lambda s: (s[0], -s[1])), [], []
        for k, s in enumerate(order):
            while open_spans and order[open_spans[-1]][1] < s[0]:
                open_spans.pop()
            around.append(open_spans[-1] if open_spans else None)
            open_spans.append(k)
        return [s[0] for s in order], order, around

    def enclosing(pos, index):
        """The smallest span around a position."""
        starts, order, around = index
        k, best = bisect_right(starts, pos) - 1, None
        while k is not None and k >= 0:
            start, end = order[k][:2]
            if end >= pos and (best is None or end - start < best[1] - best[0]):
                best = order[k]
            k = around[k]
        return best

    def text_before(pos):
        """The last characters before a position, without the white space in between."""
        while pos and text[pos - 1].isspace():
            pos -= 1
        return text[max(0, pos - 300) : pos]

    in_bodies, in_ranges = nested(bodies), nested(ranges)

    for m in DECLARATION.finditer(text):
        body = enclosing(m.start(), in_bodies)
        if body is None or body[2] is None:
            continue
        end = m.end()
        while end < len(text) and text[end] not in ";)}" and not (text[end] == "\n" and not CONTINUES.match(text, end)):
            end = close[end] + 1 if text[end] in "([{" and end in close else end + 1
        for a, b in split_top(text, m.end(), end, close):
            piece = text[a:b]
            loop = re.match(r"\s*(.+?)\s+(?:of|in)\s+", piece, re.S) if FOR_HEAD.search(text_before(m.start())) else None
            left = loop.group(1) if loop else re.split(r"=(?![>=])", piece, maxsplit=1)[0]
            typed = re.match(rf"^\s*({ID})\s*:\s*(.+)$", left, re.S)
            names = [typed.group(1)] if typed else binding_names(left)
            for name in names:
                add(name, "local", m.start(), b, type_text=typed.group(2).strip()[:200] if typed else None, end_line=line_of(body[1]))
    for m in CALL.finditer(text):
        name, pos = m.group(1), m.start(1)
        before = text_before(pos)
        if name in NOT_CALLS or pos in declared or re.search(r"\b(new|function)$", before):
            continue
        if before.endswith("."):
            receiver = re.search(rf"({ID}|\)|\])\s*\??\.$", before)
            if not receiver or receiver.group(1) in (")", "]") or (receiver.group(1) == "this" and not before[: receiver.start()].endswith(".")):
                continue
        owner = enclosing(pos, in_ranges)
        if owner is None:
            continue
        paren = m.end() - 1
        spans = split_top(text, paren + 1, close.get(paren, paren + 1), close)
        args = [dict(position=i, source_kind=argument_kind(source[a:b].strip()), source_text=source[a:b].strip()[:200]) for i, (a, b) in enumerate(spans)]
        line = line_of(pos)
        out.edges.append(dict(from_idx=owner[2], to_name=name, kind="CALLS", call_line=line, line_text=lines[line - 1], args=args))
    for m in IMPORT.finditer(source):
        clause, module = m.group(1), m.group(2)
        named = re.search(r"\{([^}]*)\}", clause)
        for part in (named.group(1).split(",") if named else []):
            words = part.replace("type ", "").split()
            if words:
                out.imports.append(dict(local_name=words[-1], source_module=module, source_name=words[0], kind="named"))
        space = re.search(rf"\*\s+as\s+({ID})", clause)
        if space:
            out.imports.append(dict(local_name=space.group(1), source_module=module, source_name="*", kind="namespace"))
        default = re.match(rf"^({ID})\s*(?:,|$)", clause.strip())
        if default:
            out.imports.append(dict(local_name=default.group(1), source_module=module, source_name="default", kind="default"))
    return out
