"""Facts of one Python file, read from its syntax tree."""

from __future__ import annotations

import ast
import re

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def bound_names(target) -> list[ast.Name]:
    """Names a target binds; attributes and subscripts bind none."""
    if isinstance(target, ast.Name):
        return [target]
    if isinstance(target, (ast.Tuple, ast.List)):
        return [n for e in target.elts for n in bound_names(e)]
    if isinstance(target, ast.Starred):
        return bound_names(target.value)
    return []


def argument_kind(node) -> str:
    if isinstance(node, ast.Name):
        return "identifier"
    if isinstance(node, (ast.Constant, ast.JoinedStr)):
        return "other" if getattr(node, "value", None) is Ellipsis else "literal"
    if isinstance(node, (ast.Attribute, ast.Subscript)):
        return "member"
    if isinstance(node, ast.Call):
        return "call"
    return "spread" if isinstance(node, ast.Starred) else "other"


class Facts(ast.NodeVisitor):
    """Collects symbols, edges, imports and parameters while walking down."""

    def __init__(self, source: str):
        self.source, self.lines = source, source.splitlines()
        self.symbols, self.edges, self.imports, self.params = [], [], [], []
        self.owner: list[int] = []       # enclosing function, method or class symbols
        self.functions: list[tuple[str, int]] = []  # (name, last line) of enclosing functions

    def text(self, node) -> str:
        return (ast.get_source_segment(self.source, node) or "")[:200]

    def add_symbol(self, node, name, kind, parent=None, end=None, type_text=None, start=None) -> int:
        line = self.lines[node.lineno - 1] if node.lineno <= len(self.lines) else ""
        first = line.encode()[node.col_offset:].decode(errors="ignore").strip()[:200]
        self.symbols.append(
            dict(idx=len(self.symbols), name=name, kind=kind, parent_idx=parent, start_line=node.lineno, end_line=end or node.end_lineno,
                 signature=first, exported=False, type_text=type_text)
        )
        return len(self.symbols) - 1

    def add_locals(self, statement, targets, type_text=None):
        if not self.functions:
            return
        names = [n for t in targets for n in bound_names(t)]
        for n in names:
            if n.id != "_":
                self.add_symbol(statement, n.id, "local", end=self.functions[-1][1], type_text=type_text if len(names) == 1 else None)

    def add_edge(self, node, name, kind, args=()):
        if self.owner:
            line = self.lines[node.lineno - 1] if node.lineno <= len(self.lines) else ""
            self.edges.append(dict(from_idx=self.owner[-1], to_name=name, kind=kind, call_line=node.lineno, line_text=line, args=list(args)))

    def visit_ClassDef(self, node):
        for d in node.decorator_list:
            self.visit(d)
        idx = self.add_symbol(node, node.name, "class")
        self.owner.append(idx)
        for base in node.bases:
            if isinstance(base, (ast.Name, ast.Attribute)):
                self.add_edge(base, base.id if isinstance(base, ast.Name) else base.attr, "EXTENDS")
            self.visit(base)
        for child in node.body:
            self.visit_function(child, idx, node.name) if isinstance(child, FUNCTIONS) else self.visit(child)
        self.owner.pop()

    def visit_FunctionDef(self, node):
        self.visit_function(node, None, None)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_function(self, node, class_idx, class_name):
        for d in node.decorator_list:
            self.visit(d)
        idx = self.add_symbol(node, node.name, "function" if class_idx is None else "method", class_idx)
        self.add_params(node.args, idx, class_name)
        self.owner.append(idx)
        self.functions.append((node.name, node.end_lineno))
        for default in [*node.args.defaults, *[d for d in node.args.kw_defaults if d]]:
            self.visit(default)
        for child in node.body:
            self.visit(child)
        self.functions.pop()
        self.owner.pop()

    def add_params(self, a, idx, class_name):
        slots = [(p, False) for p in a.posonlyargs + a.args]
        for i in range(len(a.defaults)):
            slots[-1 - i] = (slots[-1 - i][0], True)
        if a.posonlyargs:
            slots.insert(len(a.posonlyargs), (None, False))
        if a.vararg or a.kwonlyargs:
            slots.append((a.vararg, False))
        slots += [(p, d is not None) for p, d in zip(a.kwonlyargs, a.kw_defaults)]
        if a.kwarg:
            slots.append((a.kwarg, False))
        for position, (p, has_default) in enumerate(slots):
            if p is None:
                continue
            type_text = self.text(p.annotation) if p.annotation else None
            if type_text is None and position == 0 and class_name and p.arg in ("self", "cls"):
                type_text = class_name
            self.params.append(dict(owner_idx=idx, position=position, name=p.arg, type_text=type_text, has_default=has_default))

    def visit_Assign(self, node):
        self.add_locals(node, node.targets)
        self.generic_visit(node)

    def visit_AnnAssign(self, node):
        self.add_locals(node, [node.target], self.text(node.annotation))
        self.generic_visit(node)

    def visit_For(self, node):
        self.add_locals(node, [node.target])
        self.generic_visit(node)

    visit_AsyncFor = visit_For

    def visit_With(self, node):
        for item in node.items:
            if isinstance(item.optional_vars, ast.Name):
                type_text = item.context_expr.id if isinstance(item.context_expr, ast.Name) else None
                self.add_locals(item.optional_vars, [item.optional_vars], type_text)
        self.generic_visit(node)

    visit_AsyncWith = visit_With

    def visit_ExceptHandler(self, node):
        if node.name and self.functions and node.name != "_":
            type_text = node.type.id if isinstance(node.type, ast.Name) else None
            self.add_symbol(node, node.name, "local", end=self.functions[-1][1], type_text=type_text)
        self.generic_visit(node)

    def visit_Call(self, node):
        name = None
        if isinstance(node.func, ast.Name):
            name, at = node.func.id, node.func
        elif isinstance(node.func, ast.Attribute) and isinstance(node.func.value, (ast.Name, ast.Attribute)):
            name, at = node.func.attr, node.func
        if name:
            values = [(v, argument_kind(v)) for v in node.args]
            values += [(k.value, argument_kind(k.value) if k.arg else "spread") for k in node.keywords]
            values.sort(key=lambda v: (v[0].lineno, v[0].col_offset))
            args = [dict(position=i, source_kind=kind, source_text=self.text(v)) for i, (v, kind) in enumerate(values)]
            line = dict(lineno=at.end_lineno, col_offset=0)
            self.add_edge(type("At", (), line), name, "CALLS", args)
        self.generic_visit(node)

    def visit_ImportFrom(self, node):
        module = "." * node.level + (node.module or "")
        for alias in node.names:
            if alias.name != "*":
                self.imports.append(
                    dict(local_name=alias.asname or alias.name, source_module=module, source_name=alias.name, kind="from")
                )

    def visit_Import(self, node):
        for alias in node.names:
            if alias.asname:
                self.imports.append(dict(local_name=alias.asname, source_module=alias.name, source_name="*", kind="namespace"))


def python_facts(source: str) -> Facts:
    """Facts of a file. Where it does not parse as a whole, of the top-level statements that do."""
    facts = Facts(source)
    try:
        facts.visit(ast.parse(source))
        return facts
    except (SyntaxError, ValueError, RecursionError):
        facts = Facts(source)
    lines = source.split("\n")
    # A line that begins in the first column opens a statement, unless it only closes or continues one.
    heads = [i for i, line in enumerate(lines) if line[:1].strip() and not re.match(r"[)\]}#]|(else|elif|except|finally)\b", line)]
    heads = [h for k, h in enumerate(heads) if k == 0 or not lines[heads[k - 1]].startswith("@") or heads[k - 1] + 1 != h]
    for start, stop in zip(heads, [*heads[1:], len(lines)]):
        try:
            block = ast.parse("\n".join(lines[start:stop]))
            ast.increment_lineno(block, start)
            facts.visit(block)
        except (SyntaxError, ValueError, RecursionError):
            continue
    return facts
