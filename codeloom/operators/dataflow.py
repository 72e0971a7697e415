"""Data-flow edges of a Python text by reaching definitions (per-row helper of the code metrics).

An edge ``target <- source`` says that a definition is computed from another
one that can reach it: through both branches of a condition, around a loop, out
of a ``try`` or past a ``match``.  Two definitions of one name are different,
so a variable that is shadowed or overwritten does not lend its edges to the
next one.  Definitions, and names that nothing in the text defines, are
numbered as they appear, so renaming changes nothing.
"""

from __future__ import annotations

import ast

#: Where a name may come from: the definitions that reach a place, by name.
Reach = dict[str, frozenset]


def _merged(*sides: Reach | None) -> Reach | None:
    """What reaches a place that several paths lead to (None: a path that ends before)."""
    sides = [s for s in sides if s is not None]
    if not sides:
        return None
    out = dict(sides[0])
    for side in sides[1:]:
        for name, found in side.items():
            out[name] = out.get(name, frozenset()) | found
    return out


class _Loop:
    """Paths that leave a loop's body early."""

    def __init__(self):
        self.breaks: list[Reach] = []
        self.continues: list[Reach] = []


class _Flow:
    def __init__(self):
        self.numbers: dict = {}
        self.edges: dict = {}  # (place, target, source), in order
        self.loops: list[_Loop] = []

    def number(self, definition) -> str:
        return f"var_{self.numbers.setdefault(definition, len(self.numbers))}"

    def edge(self, place: ast.AST, target: str, source) -> None:
        self.edges[id(place), target, self.number(source)] = None

    # expressions -------------------------------------------------------
    def sources(self, expr: ast.AST | None, reach: Reach) -> list:
        """Definitions an expression is computed from; inner scopes and ``:=`` are followed on the way."""
        out, work = [], [(expr, reach)] if expr is not None else []
        at = 0
        while at < len(work):  # breadth first, so that names are numbered from the outside in
            node, env = work[at]
            at += 1
            if isinstance(node, ast.Name):
                if isinstance(node.ctx, ast.Load):
                    out += sorted(env.get(node.id, {("free", node.id)}), key=str)
                continue
            if isinstance(node, ast.NamedExpr):
                found = self.sources(node.value, env)
                self.define(node.target, found, reach, node)
                out += found
                continue
            if isinstance(node, ast.Lambda):
                env = env | {a.arg: frozenset([(id(a), a.arg)]) for a in _arguments(node.args)}
            elif isinstance(node, ast.ListComp | ast.SetComp | ast.GeneratorExp | ast.DictComp):
                env = dict(env)
                for part in node.generators:
                    self.define(part.target, self.sources(part.iter, env), env, part)
                made = [node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]
                work += [(x, env) for x in [*made, *(x for part in node.generators for x in part.ifs)]]
                continue
            work += [(x, env) for x in ast.iter_child_nodes(node)]
        return out

    def define(self, target: ast.AST, sources: list, reach: Reach, place: ast.AST) -> None:
        """A target takes the value of ``sources``; a part of a name's value is a new value made of the old one."""
        if isinstance(target, ast.Name):
            definition = (id(target), target.id)
            for s in sources:
                self.edge(place, self.number(definition), s)
            reach[target.id] = frozenset([definition])
        elif isinstance(target, ast.Tuple | ast.List):
            for x in target.elts:
                self.define(x, sources, reach, place)
        elif isinstance(target, ast.Starred):
            self.define(target.value, sources, reach, place)
        elif isinstance(target, ast.Attribute | ast.Subscript):
            inner = self.sources(target.slice, reach) if isinstance(target, ast.Subscript) else []
            base = target.value
            while isinstance(base, ast.Attribute | ast.Subscript):
                base = base.value
            if isinstance(base, ast.Name):
                old = sorted(reach.get(base.id, {("free", base.id)}), key=str)
                definition = (id(base), base.id)
                for s in [*sources, *inner, *old]:
                    self.edge(place, self.number(definition), s)
                reach[base.id] = frozenset([definition])

    # statements ----------------------------------------------------------
    def block(self, body: list[ast.stmt], reach: Reach | None) -> Reach | None:
        for statement in body:
            if reach is None:
                return None  # nothing gets here
            reach = self.statement(statement, reach)
        return reach

    def statement(self, node: ast.stmt, reach: Reach) -> Reach | None:
        reach = dict(reach)
        kind = getattr(self, f"on_{type(node).__name__.lower()}", None)
        if kind:
            return kind(node, reach)
        for x in ast.iter_child_nodes(node):  # whatever only reads
            self.sources(x, reach)
        return reach

    def on_assign(self, node, reach):
        found = self.sources(node.value, reach)
        for target in node.targets:
            self.define(target, found, reach, node)
        return reach

    def on_annassign(self, node, reach):
        if node.value is not None:
            self.define(node.target, self.sources(node.value, reach), reach, node)
        return reach

    def on_augassign(self, node, reach):
        found = self.sources(node.value, reach)
        if isinstance(node.target, ast.Name):
            found = found + sorted(reach.get(node.target.id, {("free", node.target.id)}), key=str)
        self.define(node.target, found, reach, node)
        return reach

    def on_return(self, node, reach):
        for s in self.sources(node.value, reach):
            self.edge(node, "return", s)
        return None

    def on_raise(self, node, reach):
        for x in (node.exc, node.cause):
            self.sources(x, reach)
        return None

    def on_break(self, node, reach):
        if self.loops:
            self.loops[-1].breaks.append(reach)
        return None

    def on_continue(self, node, reach):
        if self.loops:
            self.loops[-1].continues.append(reach)
        return None

    def on_if(self, node, reach):
        self.sources(node.test, reach)
        return _merged(self.block(node.body, reach), self.block(node.orelse, reach))

    def loop(self, node, reach, head):
        """Until nothing new comes around: ``head`` reads the condition or takes the next item."""
        start, loop = reach, _Loop()
        self.loops.append(loop)
        while True:
            inside = dict(start)
            head(inside)
            loop.breaks, loop.continues = [], []
            around = _merged(start, self.block(node.body, inside), *loop.continues)
            if around == start:
                break
            start = around
        self.loops.pop()
        after = dict(start)
        if isinstance(node, ast.While):
            self.sources(node.test, after)
        return _merged(self.block(node.orelse, after), *loop.breaks)

    def on_while(self, node, reach):
        return self.loop(node, reach, lambda env: self.sources(node.test, env))

    def on_for(self, node, reach):
        found = self.sources(node.iter, reach)
        return self.loop(node, reach, lambda env: self.define(node.target, found, env, node))

    on_asyncfor = on_for

    def on_with(self, node, reach):
        for item in node.items:
            found = self.sources(item.context_expr, reach)
            if item.optional_vars is not None:
                self.define(item.optional_vars, found, reach, node)
        return self.block(node.body, reach)

    on_asyncwith = on_with

    def on_try(self, node, reach):
        seen, env = [reach], reach
        for statement in node.body:  # an exception may come after any of them
            if env is None:
                break
            env = self.statement(statement, env)
            seen.append(env)
        caught = _merged(*seen)
        ends = [self.block(node.orelse, env) if env is not None else None]
        for handler in node.handlers:
            inner = dict(caught)
            self.sources(handler.type, inner)
            if handler.name:
                inner[handler.name] = frozenset([(id(handler), handler.name)])
            ends.append(self.block(handler.body, inner))
        after = _merged(*ends)
        if node.finalbody:
            self.block(node.finalbody, _merged(after, caught))
            after = None if after is None else self.block(node.finalbody, after)
        return after

    on_trystar = on_try

    def on_match(self, node, reach):
        found = self.sources(node.subject, reach)
        ends = [reach]
        for case in node.cases:
            inner = dict(reach)
            for x in ast.walk(case.pattern):
                name = getattr(x, "name", None) or getattr(x, "rest", None)
                if isinstance(name, str):
                    definition = (id(x), name)
                    for s in found:
                        self.edge(x, self.number(definition), s)
                    inner[name] = frozenset([definition])
            self.sources(case.guard, inner)
            ends.append(self.block(case.body, inner))
        return _merged(*ends)

    def on_import(self, node, reach):
        for alias in node.names:
            name = alias.asname or alias.name.split(".")[0]
            reach[name] = frozenset([(id(alias), name)])
        return reach

    on_importfrom = on_import

    def on_delete(self, node, reach):
        for target in node.targets:
            if isinstance(target, ast.Name):
                reach.pop(target.id, None)
        return reach

    def on_functiondef(self, node, reach):
        for x in (*node.decorator_list, *node.args.defaults, *(d for d in node.args.kw_defaults if d is not None)):
            self.sources(x, reach)
        reach[node.name] = frozenset([(id(node), node.name)])
        inner = dict(reach)
        for a in _arguments(node.args):
            definition = (id(a), a.arg)
            self.number(definition)
            inner[a.arg] = frozenset([definition])
        outer, self.loops = self.loops, []
        self.block(node.body, inner)
        self.loops = outer
        return reach

    on_asyncfunctiondef = on_functiondef

    def on_classdef(self, node, reach):
        for x in (*node.decorator_list, *node.bases, *node.keywords):
            self.sources(x, reach)
        outer, self.loops = self.loops, []
        self.block(node.body, dict(reach))
        self.loops = outer
        reach[node.name] = frozenset([(id(node), node.name)])
        return reach


def _arguments(args: ast.arguments) -> list[ast.arg]:
    return [*args.posonlyargs, *args.args, *args.kwonlyargs, *(x for x in (args.vararg, args.kwarg) if x)]


def dataflow_edges(tree: ast.Module) -> list[str]:
    """``target<-source`` for every definition, and every ``return``, that a definition reaches."""
    flow = _Flow()
    flow.block(tree.body, {})
    return [f"{target}<-{source}" for _, target, source in flow.edges]
