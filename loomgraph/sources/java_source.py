"""Java sources as emissions of nodes and edges.

One file is parsed on its own, in Arrow batches, by a small declaration parser over tokens; method bodies are
scanned for calls, creations, exceptions and field accesses. What a name means across files is left to joins
(operators.resolve): a reference to a type carries the names that it may stand for, in order.
"""

from __future__ import annotations

import bisect
import re
import string
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import in_test_tree

SYNTAX, UNRESOLVED = ("SYNTAX", 1.0), ("SYNTAX_UNRESOLVED", 0.55)
_TOKEN = re.compile(  # without groups, so that all matches come as text at once and cover it; the first character tells the kind
    r"""\s*+(?:[A-Za-z_$][\w$]*|::|->|\+\+|--|\.\.\.|(?!/[/*])[-+*/%&|^!=<>]=|(?!/[/*])[{}()\[\];,.@<>=?:&|!+\-*/%^~]|\d[\w.]*"""
    r"""|/\*\*(?!/).*?\*/|//[^\n]*|/\*.*?\*/|\"{3}.*?\"{3}|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|.)|\s+""",
    re.S,
)
_FIRST = dict.fromkeys(string.ascii_letters + "_$", "id") | dict.fromkeys("{}()[];,.@<>=?:&|!+-*%^~", "op") | dict.fromkeys(string.digits, "num")
MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed", "non"}
PRIMITIVES = {"int", "long", "short", "byte", "char", "boolean", "float", "double", "void", "var"}
NOT_CALLS = {"if", "for", "while", "switch", "catch", "synchronized", "return", "throw", "new", "super", "this", "assert", "try", "else", "do", "case", "yield", "instanceof"}
NAMES_TYPE = {"class", "interface", "enum", "record"}
LITERALS = {"null", "true", "false"}  # no field can have such a name
# Annotations that make a stereotype, in order of precedence.
STEREOTYPES = (("RestController", "CONTROLLER"), ("Controller", "CONTROLLER"), ("Service", "SERVICE"), ("Repository", "REPOSITORY_COMPONENT"), ("Entity", "ENTITY"), ("Configuration", "CONFIGURATION"))
VERBS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
EMISSION = "record string, id string, kind string, name string, src string, refs array<string>, attributes map<string,string>, resolver string, confidence double, file string, line int, col int, phase int, ord int, settled boolean"
# Relations whose target a name stands for, which other files may declare, and those that bodies alone emit.
NAMED = ("EXTENDS", "IMPLEMENTS", "DEPENDS_ON", "CREATES", "THROWS", "CATCHES", "READS", "WRITES")
IN_BODIES = ("CALLS", "CREATES", "THROWS", "CATCHES", "READS", "WRITES")
# Kinds that come from the head of a file or a type, and not from members.
HEAD_NODES = ("FILE", "PACKAGE", "TYPE", "INTERFACE", "CONTROLLER", "SERVICE", "REPOSITORY_COMPONENT", "ENTITY", "CONFIGURATION", "DATABASE_TABLE")
HEAD_EDGES = ("IMPORTS", "EXTENDS", "IMPLEMENTS", "PERSISTS")
# Nodes and edges that annotations' members tell something of.
TOLD_EDGES = ("PERSISTS", "EXPOSES", "CONSUMES")
FILES_A_BATCH = 2000
# Patterns over texts find at least what the parser would. What it drops between two tokens: anything that is no
# operator and begins no name, and comments.
_GAP = r"(?:[^A-Za-z0-9_$/(){}\[\];,.@<>=?:&|!+*%^~-]++|/\*.*?\*/|//[^\n]*+|/)*+"
_NAMED = r"(?s)(?:class|interface|enum|record)(?=(?:[^A-Za-z_$/]++|/\*.*?\*/|//[^\n]*+|/)*+([A-Za-z_$][A-Za-z0-9_$]*))"
_NAMED_HERE, _CALLED = re.compile(_NAMED), re.compile(rf"(?s){_GAP}\((?!{_GAP}\))")  # called: with something between the parentheses
_BODY = r"(?s)\A[^)]*+\).*\{"  # a brace after a parenthesis
# Words of which one stands in every file that emits the kind. Any file may emit the other kinds.
WORDS = {
    "PACKAGE": ("package",), "IMPORTS": ("import",), "DATABASE_TABLE": ("Entity",), "PERSISTS": ("Entity",), "ENDPOINT": ("Mapping",), "EXPOSES": ("Mapping",),
    "TOPIC": ("KafkaListener",), "CONSUMES": ("KafkaListener",), "TRANSACTION": ("Transactional",), "PARTICIPATES_IN": ("Transactional",),
    "EXTENDS": ("extends",), "IMPLEMENTS": ("implements", "new"), "CREATES": ("new",), "THROWS": ("throw",), "CATCHES": ("catch",),
}


def names_held(text: str | Column) -> Column:
    """The names of types that a text may declare, as far as they are in ASCII."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_NAMED), F.lit(1)))


def names_asked(ref: str | Column) -> Column:
    """Of which of names_held a text has one that declares the id `type:...`; an anonymous type is held by the one around."""
    name = F.regexp_extract(F.substring_index(F.substring_index(ref, ".field:", 1), ":", -1), r"([^.]*)\z", 1)
    return F.array_distinct(F.transform(F.array(name, F.regexp_replace(name, r"(\$\d+)+\z", "")), lambda x: F.regexp_extract(x, "^[A-Za-z_$][A-Za-z0-9_$]*", 0)))


def may_inject(text: str) -> bool:
    """Whether a text may have a constructor with parameters, or methods that are injected into: where names can't be told
    without the parser, or are many, it may."""
    if "Autowired" in text or "Inject" in text or not text.isascii() or "$" in text and re.search(r"\$\d", text):
        return True
    names = set(_NAMED_HERE.findall(text))
    return len(names) > 16 or any(_CALLED.match(text, m.end()) for name in names for m in re.finditer(re.escape(name), text))


def first_sentence(doc: str) -> str:
    """The first sentence of a Javadoc comment's description, without markup, 240 characters at most."""
    body = re.sub(r"^\s*\*+ ?", "", doc[3:-2], flags=re.M)
    body = re.split(r"^\s*@\w", body, maxsplit=1, flags=re.M)[0]
    body = re.sub(r"\{@\w+\s*([^}]*)\}", r"\1 ", body)
    body = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", body)).strip()
    if m := re.search(r"\.(\s|$)", body):
        body = body[: m.start()]
    return body.strip()[:240].strip()


def join_paths(base: str, path: str) -> str:
    base, path = base.strip(), path.strip()
    if not base:
        return path or "/"
    if not path or path == "/":
        return base
    return base.removesuffix("/") + (path if path.startswith("/") else "/" + path)


def _kind(token: str) -> str:
    """The kind of a token whose first character leaves it open; what is none, as a comment, has none."""
    if token[0] == "/":  # a comment that never ends is an operator and what follows
        return "op" if token in ("/", "/=") else "doc" if token.startswith("/**") and token != "/**/" else ""
    if token[0] in "\"'":
        return "str" if len(token) > 1 else ""
    return "num" if token[0].isdecimal() else ""


class _Parser:
    def __init__(self, text: str, file: str, nodes=None, ids=(), edges=None, keys=None):
        self.text, self.file, self.keys = text, file, keys
        self.nodes, self.ids, self.edges, self.declared = nodes, ids, edges, set()
        self.members_too = nodes is None or edges is None or any(k not in HEAD_NODES for k in (*nodes, *ids)) or any(k not in HEAD_EDGES for k in edges)
        self.bodies = edges is None or any(k in edges for k in IN_BODIES) or nodes is None or "EXTERNAL_SYMBOL" in nodes
        self.told = nodes is None or bool(nodes) or edges is None or any(k in edges for k in TOLD_EDGES)
        found = _TOKEN.findall(text)
        # (kind, text, place)
        self.tokens = [(k, t, end - len(t)) for s, end in zip(found, accumulate(map(len, found))) if (t := s.lstrip()) and (k := _FIRST.get(t[0]) or _kind(t))]
        self.n = len(self.tokens)
        self.news = "new" in text
        self.lines = [0, *accumulate([len(x) + 1 for x in text.split("\n")[:-1]])]
        self.at, self.out, self.ord = 0, [], 0
        self.package, self.imports, self.wide = "", {}, []
        self.anonymous = 0

    # -- tokens
    def peek(self, k: int = 0) -> str:
        i = self.at + k
        return self.tokens[i][1] if i < self.n else ""

    def kind(self, k: int = 0) -> str:
        i = self.at + k
        return self.tokens[i][0] if i < self.n else ""

    def pos(self) -> int:
        return self.tokens[min(self.at, len(self.tokens) - 1)][2] if self.tokens else 0

    def take(self) -> str:
        self.at += 1
        return self.peek(-1)

    def past(self, opening: str, closing: str) -> int:
        """Index after the bracket that closes the one at the cursor."""
        depth, tokens = 0, self.tokens
        for i in range(self.at, self.n):
            k, t, _ = tokens[i]
            if k == "op":
                if t == opening:
                    depth += 1
                elif t == closing:
                    depth -= 1
                if depth == 0:
                    return i + 1
        return self.n

    def words(self, start: int, end: int) -> str:
        if end - start == 1:
            return self.tokens[start][1]
        return re.sub(r"(?<=\w) (?=\w)", " ", "".join(("" if i == start or not (self.tokens[i][0] == "id" and self.tokens[i - 1][0] == "id") else " ") + self.tokens[i][1] for i in range(start, end)))

    # -- emissions
    def emit(self, record, node_id, kind, name, src, refs, attributes, phase, pos, tier):
        line = bisect.bisect_right(self.lines, pos)
        self.out.append({
            "record": record, "id": node_id, "kind": kind, "name": name, "src": src, "refs": refs, "attributes": attributes, "phase": phase, "ord": self.ord, "settled": True,
            "resolver": tier[0], "confidence": tier[1], "file": self.file, "line": line, "col": pos - self.lines[line - 1] + 1,
        })

    def node(self, node_id, kind, name, pos, attributes=None, declared=True, tier=SYNTAX):
        self.ord += 1
        if declared and node_id.startswith("type:"):
            self.declared.add(node_id)
        if self.nodes is None or kind in self.nodes:
            if self.keys is None or attributes and not self.keys.isdisjoint(attributes):
                self.emit("node", node_id, kind, name, None, None, attributes or {}, int(declared), pos, tier)
            else:
                self.emit("bare", node_id, kind, None, None, None, None, int(declared), pos, tier)
        elif declared and kind in self.ids:
            self.emit("id", node_id, kind, None, None, None, None, 1, pos, tier)

    def edge(self, src, refs, kind, pos, attributes=None, tier=SYNTAX):
        self.ord += 1
        if self.edges is None or kind in self.edges:
            self.emit("edge", None, kind, None, src, [refs] if isinstance(refs, str) else refs, attributes or {}, 2, pos, tier)

    def wants(self, relation: str) -> bool:
        return self.edges is None or relation in self.edges

    def settled(self) -> list[dict]:
        """The emissions, with references settled as far as this file alone can: one that it declares is known, and
        what comes after a known one is never asked for. Edges at a place where none is left to other files
        lose their repeats here, and need neither a join nor a window later."""
        if self.edges is not None and not self.edges:
            return self.out
        places: dict[tuple, list[dict]] = {}
        for e in self.out:
            if e["record"] != "edge" or not e["refs"]:
                continue
            if e["kind"] == "CALLS":
                e["refs"] = e["refs"][:1]
            else:
                for i, ref in enumerate(e["refs"]):
                    bare = ref[1:].removeprefix("field:") if ref[:1] == "?" else ref
                    if bare is ref or bare in self.declared:
                        e["refs"] = [*e["refs"][:i], bare]
                        break
            places.setdefault((e["src"], e["kind"], e["line"], e["col"]), []).append(e)
        for group in places.values():
            if any(e["refs"][0][:1] == "?" for e in group):
                for e in group:
                    e["settled"] = False
            elif len(group) > 1:
                seen = set()
                for e in group:
                    if e["refs"][0] in seen:
                        e["record"] = ""
                    seen.add(e["refs"][0])
        return [e for e in self.out if e["record"] and (e["record"] != "edge" or e["refs"])]

    def names_of(self, written: str) -> list[str]:
        """What a written type may be, in order, with the unresolved form last."""
        bare = re.sub(r"<.*>|\[\]|\.\.\.|@\w+", "", written).strip()
        if not bare or bare in PRIMITIVES or bare == "?":
            return []
        head, _, rest = bare.partition(".")
        rest = "." + rest if rest else ""
        if head in self.imports:
            return [f"type:{self.imports[head]}{rest}"]
        if head[:1].islower() and rest:
            return [f"type:{bare}"]
        own = [".".join(x for x in (p, bare) if x) for p in (*self.enclosing(), self.package)]
        return [f"?type:{x}" for x in (*own, *(f"{w}.{bare}" for w in self.wide), f"java.lang.{bare}")] + [f"external:type:{bare}"]

    def enclosing(self):
        return [t[len("type:") :] for t in reversed(self.types) if t.startswith("type:") and "$" not in t]

    types: list[str]

    # -- declarations
    def unit(self):
        self.types, self.paths = [], []
        fid = f"file:{self.file}"
        self.node(fid, "FILE", self.file, 0)
        doc = ""
        while self.at < len(self.tokens):
            if self.kind() == "doc":
                doc = self.take()
                continue
            t = self.peek()
            if t == "package":
                pos = self.pos()
                self.take()
                self.package = self.until(";")
                self.node(f"package:{self.package}", "PACKAGE", self.package, pos)
                self.edge(fid, f"package:{self.package}", "DECLARES", pos)
            elif t == "import":
                pos = self.pos()
                self.take()
                static = self.peek() == "static"
                if static:
                    self.take()
                name = self.until(";")
                self.node(f"external:{name}", "EXTERNAL_SYMBOL", name, pos, {"reason": "import"}, declared=False)
                self.edge(fid, f"external:{name}", "IMPORTS", pos, {"static": str(static).lower()})
                if name.endswith(".*"):
                    self.wide.append(name[:-2])
                elif not static:
                    self.imports[name.rpartition(".")[2]] = name
            elif not self.declaration(fid, doc):
                self.take()
            doc = ""
        return self.out

    def until(self, stop: str) -> str:
        start = at = self.at
        tokens, n = self.tokens, self.n
        while at < n and tokens[at][1] != stop:
            at += 1
        self.at = at
        text = "".join([x[1] for x in tokens[start:at]])
        self.take()
        return text

    def modifiers(self):
        """Annotations [(name, members)] and plain modifiers at the cursor."""
        annotations, plain = [], []
        while True:
            t = self.peek()
            if t == "@" and self.peek(1) != "interface":
                self.take()
                name = self.take()
                while self.peek() == ".":
                    self.take()
                    name = self.take()
                members = {}
                if self.peek() == "(":
                    end = self.past("(", ")")
                    members = self.members(self.at + 1, end - 1) if self.told else members
                    self.at = end
                annotations.append((name, members))
            elif t in MODIFIERS and not (t == "default" and self.peek(1) in (":", "->")):
                plain.append(self.take())
                if t == "non" and self.peek() == "-":
                    self.at += 2
            elif self.kind() == "doc":
                self.take()
            else:
                return annotations, plain

    def split(self, start: int, end: int, mark: str = ","):
        depth, parts, begin = 0, [], start
        for i in range(start, end):
            t = self.tokens[i][1] if self.tokens[i][0] == "op" else ""
            depth += (t in ("(", "[", "{", "<")) - (t in (")", "]", "}", ">"))
            if t == mark and depth == 0:
                parts.append((begin, i))
                begin = i + 1
        if begin < end:
            parts.append((begin, end))
        return parts

    def literal(self, start: int, end: int) -> str | None:
        """The value of a constant: strings joined, arrays by comma, else the text."""
        if start >= end:
            return None
        if self.tokens[start][1] == "{":
            parts = [self.literal(a, b) for a, b in self.split(start + 1, end - 1)]
            return ",".join(p for p in parts if p is not None) or None
        own = self.tokens[start:end]
        if all(k == "str" or v == "+" for k, v, _ in own):
            return "".join(v.strip('"') if v.startswith('"""') else v[1:-1] for k, v, _ in own if k == "str")
        return self.words(start, end)

    def members(self, start: int, end: int):
        found = {}
        for a, b in self.split(start, end):
            if b - a > 2 and self.tokens[a][0] == "id" and self.tokens[a + 1][1] == "=":
                found[self.tokens[a][1]] = (self.literal(a + 2, b), self.tokens[a + 2][0] == "str" or self.tokens[a + 2][1] == "{")
            else:
                found["value"] = (self.literal(a, b), self.tokens[a][0] == "str" or self.tokens[a][1] == "{")
        return found

    def annotated(self, annotations):
        if not self.told:
            return {}
        found = {"annotations": ",".join(n for n, _ in annotations)}
        for n, members in annotations:
            for k, (v, _) in members.items():
                if v is not None:
                    found[f"annotation.{n}.{k}"] = v
            found.setdefault(f"annotation.{n}", "")
        return found

    @staticmethod
    def argument(annotations, name, member="value") -> str | None:
        for n, members in annotations:
            if n == name and member in members:
                v, text = members[member]
                return v.split(",")[0] if text and v else v if member == "method" else None
        return None

    def declaration(self, owner: str, doc: str) -> bool:
        start = self.at
        annotations, _ = self.modifiers()
        t = self.peek()
        if t in ("class", "interface", "enum") or t == "record" and self.kind(1) == "id" and self.peek(2) in ("(", "<") or t == "@" and self.peek(1) == "interface":
            if t == "@":
                self.take()
            self.type(owner, "annotation" if t == "@" else t, annotations, doc)
            return True
        if not self.types:
            self.at = start
            return False
        return self.member(annotations, doc)

    def type_text(self) -> str:
        """A written type at the cursor."""
        start = self.at
        self.modifiers()
        start = self.at
        while self.kind() == "id":
            self.take()
            if self.peek() == "<":
                self.at = self.past("<", ">")
            if self.peek() != ".":
                break
            self.take()
        while self.peek() == "[" and self.peek(1) == "]":
            self.at += 2
        if self.peek() == "...":
            self.take()
        return self.words(start, self.at)

    def type(self, owner: str, flavour: str, annotations, doc: str):
        self.take()
        pos, simple = self.pos(), self.take()
        outer = self.types[-1][len("type:") :] if self.types else self.package
        name = f"{outer}.{simple}" if outer else simple
        tid, names = f"type:{name}", [n for n, _ in annotations]
        if self.peek() == "<":
            self.at = self.past("<", ">")
        components = None
        if flavour == "record" and self.peek() == "(":
            end = self.past("(", ")")
            components, self.at = (self.at + 1, end - 1), end
        above = []
        while self.peek() not in ("{", "") and self.peek() != ";":
            word = self.take()
            if word in ("extends", "implements", "permits"):
                while True:
                    written = self.type_text()
                    if word != "permits" and written:
                        above.append((written, "EXTENDS" if word == "extends" else "IMPLEMENTS"))
                    if self.peek() != ",":
                        break
                    self.take()
        kind = next((k for a, k in STEREOTYPES if a in names), "TYPE")
        if flavour in ("interface", "annotation"):
            repository = flavour == "interface" and any(re.sub(r"<.*", "", w).endswith("Repository") for w, _ in above)
            kind = "REPOSITORY_COMPONENT" if repository else "INTERFACE"
        attributes = {"type": flavour, **self.annotated(annotations)}
        if doc and self.told and (said := first_sentence(doc)):
            attributes["doc"] = said
        self.types.append(tid)
        self.node(tid, kind, name, pos, attributes)
        self.edge(owner, tid, "DECLARES", pos)
        for written, relation in above:
            if self.wants(relation):
                self.edge(tid, self.names_of(written), relation, pos, {"resolution": "name"})
        if "Entity" in names:
            table = self.argument(annotations, "Table", "name") or self.argument(annotations, "Table") or self.argument(annotations, "Entity", "name") or simple
            self.node(f"table:{table}", "DATABASE_TABLE", table, pos, {"inferred": str("Table" not in names).lower()})
            self.edge(tid, f"table:{table}", "PERSISTS", pos)
        self.paths.append(self.argument(annotations, "RequestMapping") or "")
        if components:
            for a, b in self.split(*components):
                self.at = a
                marks, _ = self.modifiers()
                written = self.type_text()
                at, part = self.pos(), self.take()
                self.field(tid, part, written, at, {"recordComponent": "true"})
                accessor = f"{tid}#{part}()"
                self.node(accessor, "METHOD", part, at, {"arity": "0", "annotations": "", "synthesized": "record-accessor"})
                self.edge(tid, accessor, "DECLARES", at)
            self.at = components[1] + 1
            while self.peek() not in ("{", ""):
                self.take()
        if self.peek() == "{":
            end = self.past("{", "}")
            self.take()
            if flavour == "enum":
                while self.at < end - 1 and self.peek() != ";":
                    if self.peek() in ("(", "{"):
                        self.at = self.past(self.peek(), ")" if self.peek() == "(" else "}")
                    else:
                        self.take()
            # Where only types are wanted, members matter if a type may stand in them.
            if self.members_too or any(t[1] in NAMES_TYPE for t in self.tokens[self.at : end]) or self.anonymous_in(end):
                self.body(end - 1)
            self.at = end
        self.types.pop()
        self.paths.pop()

    def body(self, end: int):
        doc = ""
        while self.at < end:
            if self.kind() == "doc":
                doc = self.take()
                continue
            before = self.at
            if self.peek() == "{":
                self.at = self.past("{", "}")
            elif self.peek() == "static" and self.peek(1) == "{":
                self.take()
                self.at = self.past("{", "}")
            elif not self.declaration(self.types[-1], doc):
                self.at = max(before, self.at) + 1
            doc = ""

    def field(self, tid, name, written, pos, extra):
        fid = f"{tid}.field:{name}"
        self.node(fid, "FIELD", name, pos, {**extra, "declaredType": written})
        self.edge(tid, fid, "DECLARES", pos)
        if self.wants("DEPENDS_ON") and (names := self.names_of(written)):
            self.edge(tid, names, "DEPENDS_ON", pos, {"resolution": "name"})

    def member(self, annotations, doc: str) -> bool:
        if self.peek() == "<":
            self.at = self.past("<", ">")
        tid = self.types[-1]
        simple = tid.rpartition(".")[2].rpartition(":")[2]
        if self.kind() == "id" and self.peek() == simple and self.peek(1) in ("(", "{"):
            pos, name = self.pos(), "<init>"
            self.take()
            if self.peek() == "{":  # a record's compact constructor
                self.at = self.past("{", "}")
                return True
        else:
            written = self.type_text()
            if not written or self.kind() != "id":
                return False
            pos, name = self.pos(), self.take()
        if self.peek() == "(":
            self.method(name, pos, annotations, doc)
            return True
        if name == "<init>":
            return False
        self.field(tid, name, written, pos, self.annotated(annotations))
        while self.at < len(self.tokens) and self.peek() != ";":  # initializer
            if self.peek() in ("(", "{", "["):
                self.at = self.past(self.peek(), {"(": ")", "{": "}", "[": "]"}[self.peek()])
            else:
                self.take()
        self.take()
        return True

    def method(self, name, pos, annotations, doc):
        tid, end = self.types[-1], self.past("(", ")")
        parameters = []
        for a, b in self.split(self.at + 1, end - 1):
            self.at = a
            marks, _ = self.modifiers()
            at = self.pos()
            written = self.type_text()
            parameters.append((written, self.peek(), at))
        self.at = end
        erased = [re.sub(r"<.*>", "", w).replace("...", "[]") for w, _, _ in parameters]
        mid = f"{tid}#{name}({','.join(erased)})"
        names = [n for n, _ in annotations]
        attributes = {"arity": str(len(parameters)), **self.annotated(annotations)}
        if doc and self.told and (said := first_sentence(doc)):
            attributes["doc"] = said
        self.node(mid, "METHOD", name, pos, attributes)
        self.edge(tid, mid, "DECLARES", pos)
        injected = "constructor" if name == "<init>" else "setter" if {"Autowired", "Inject"} & set(names) else None
        for written, variable, at in parameters if self.wants("DEPENDS_ON") else ():
            if refs := self.names_of(written):
                self.edge(tid, refs, "DEPENDS_ON", at, {"resolution": "name"})
                if injected:
                    self.edge(mid, refs, "DEPENDS_ON", at, {"resolution": "name", "injection": injected, "parameter": variable})
        if mapping := next((n for n in names if n.endswith("Mapping")), None):
            method = self.argument(annotations, mapping, "method")
            verb = VERBS.get(mapping) or (method or "REQUEST").rpartition(".")[2]
            path = join_paths(self.paths[-1], self.argument(annotations, mapping) or self.argument(annotations, mapping, "path") or "/")
            self.node(f"endpoint:{verb}:{path}", "ENDPOINT", f"{verb} {path}", pos, {"httpMethod": verb, "path": path})
            self.edge(f"endpoint:{verb}:{path}", mid, "EXPOSES", pos)
        if "KafkaListener" in names:
            topic = self.argument(annotations, "KafkaListener") or "<dynamic-topic>"
            self.node(f"topic:{topic}", "TOPIC", topic, pos)
            self.edge(mid, f"topic:{topic}", "CONSUMES", pos)
        if "Transactional" in names:
            self.node(f"transaction:{mid}", "TRANSACTION", f"{name} transaction", pos)
            self.edge(mid, f"transaction:{mid}", "PARTICIPATES_IN", pos)
        while self.at < len(self.tokens) and self.peek() not in ("{", ";"):
            if self.take() == "throws":
                while True:
                    at = self.pos()
                    self.edge(mid, self.names_of(self.type_text()), "THROWS", at, {"resolution": "name", "reason": "throws-clause"})
                    if self.peek() != ",":
                        break
                    self.take()
        if self.peek() == "{":
            end = self.past("{", "}")
            self.take()
            if self.bodies or self.anonymous_in(end):  # anonymous types declare, too
                self.statements(mid, end - 1, {v for _, v, _ in parameters})
            self.at = end
        else:
            self.take()

    # -- bodies
    def anonymous_in(self, end: int) -> bool:
        """Whether a creation between the cursor and end may have a body of its own: arguments and then a brace. One
        without makes no type."""
        if not self.news:
            return False
        resume, tokens = self.at, self.tokens
        for i in range(resume, end):
            if tokens[i][1] == "new":
                self.at = i + 1
                self.type_text()
                if self.peek() == "(" and (stop := self.past("(", ")")) < self.n and tokens[stop][1] == "{":
                    self.at = resume
                    return True
        self.at = resume
        return False

    def receiver(self, i: int) -> tuple[str, int]:
        """The expression before the dot at i, as text, and where it begins."""
        j = i - 1
        while j >= 0:
            t, k = self.tokens[j][1], self.tokens[j][0]
            if t in (")", "]"):
                depth = 0
                while j >= 0:
                    depth += (self.tokens[j][1] in (")", "]")) - (self.tokens[j][1] in ("(", "["))
                    if depth == 0:
                        break
                    j -= 1
                if j > 0 and self.tokens[j - 1][0] == "id" and self.tokens[j - 1][1] not in NOT_CALLS:
                    j -= 1
            elif k not in ("id", "str", "num"):
                return self.words(j + 1, i), j + 1
            if j > 0 and self.tokens[j - 1][1] == ".":
                j -= 2
                continue
            if j > 0 and self.tokens[j - 1][1] == "new":
                j -= 1
            return self.words(max(j, 0), i), max(j, 0)
        return "", 0

    def statements(self, mid: str, end: int, local: set[str]):
        tid = self.types[-1]
        while self.at < end:
            i, (k, t, pos) = self.at, self.tokens[self.at]
            if t == "new" and self.kind(1) == "id":
                self.take()
                written = self.type_text()
                if self.peek() == "(":
                    stop = self.past("(", ")")
                    arity = len(self.split(self.at + 1, stop - 1))
                    refs = self.names_of(written)
                    if refs:
                        self.edge(mid, refs, "CREATES", pos, {"resolution": "name"})
                        self.call(mid, pos, "new", re.sub(r"<.*>", "", written), "<init>", arity, {"via": "constructor"})
                    if stop < len(self.tokens) and self.tokens[stop][1] == "{":
                        resume, self.at = self.at, stop
                        inner = self.past("{", "}")
                        self.anonymous += 1
                        aid = f"{tid}${self.anonymous}"
                        self.node(aid, "TYPE", "<anonymous>", pos, {"type": "anonymous"})
                        self.edge(tid, aid, "DECLARES", pos)
                        self.edge(aid, refs, "IMPLEMENTS", pos, {"resolution": "name"})
                        self.types.append(aid)
                        self.paths.append("")
                        self.take()
                        self.body(inner - 1)
                        self.types.pop()
                        self.paths.pop()
                        tail, self.at = inner, resume + 1
                        self.statements(mid, stop - 1, local)
                        self.at = tail
                    else:
                        self.take()
                continue
            if t == "throw" and self.peek(1) == "new":
                self.at += 2
                written = self.type_text()
                self.edge(mid, self.names_of(written), "THROWS", pos, {"resolution": "name", "reason": "throw"})
                self.at = i + 1
                continue
            if t == "catch" and self.peek(1) == "(":
                self.at += 2
                while True:
                    self.modifiers()
                    self.edge(mid, self.names_of(self.type_text()), "CATCHES", pos, {"resolution": "name", "reason": "catch"})
                    if self.peek() != "|":
                        break
                    self.take()
                continue
            if t == "::" and (self.kind(1) == "id"):
                name = self.peek(1)
                on, _ = self.receiver(i)
                self.call(mid, pos, "reference", on, "<init>" if name == "new" else name, -1, {"via": "method-reference"})
                self.at += 2
                continue
            if k == "id" and t not in NOT_CALLS and self.peek(1) == "(":
                stop = None
                self.take()
                stop = self.past("(", ")")
                parts = self.split(self.at + 1, stop - 1)
                literals = {f"arg{n}": v for n, (a, b) in enumerate(parts[:3]) if all(x[0] in ("str", "num") or x[1] in ("+", "true", "false", "-") for x in self.tokens[a:b]) and (v := self.literal(a, b)) is not None}
                on, begin = self.receiver(i - 1) if i and self.tokens[i - 1][1] == "." else ("", i)
                self.call(mid, self.tokens[begin][2], "call", on, t, len(parts), {"via": "super"} if on == "super" else literals)
                self.take()
                continue
            if k == "id" and t not in NOT_CALLS and t not in PRIMITIVES and t not in LITERALS:
                after, before = self.peek(1), self.tokens[i - 1][1] if i else ""
                through = before == "." and i > 1 and self.tokens[i - 2][1] == "this"
                if (before != "." or through) and (t not in local or through) and after not in ("::", "->"):
                    if self.kind(1) == "id" and before in ("{", "}", ";", "(", "final"):
                        local.add(self.peek(1))  # a local variable of this type
                    else:
                        write = after in ("=", "+=", "-=", "*=", "/=", "++", "--") or before in ("++", "--")
                        self.edge(mid, [f"?field:{tid}.field:{t}"], "WRITES" if write else "READS", pos, {"resolution": "name"})
            self.take()

    def call(self, mid, pos, how, on, name, arity, attributes):
        count = "?" if arity < 0 else str(arity)
        target = f"{on + '.' if on else ''}{name}/{count}"
        cid = f"external:call:{target}"
        self.node(cid, "EXTERNAL_SYMBOL", target, pos, {"reason": "unresolved-call", "receiver": on, "method": name, "arity": count, "how": how}, declared=False, tier=UNRESOLVED)
        receiver = self.names_of(on) if re.fullmatch(r"[\w$.]*\b[A-Z][\w$]*", on or "") else []
        self.edge(mid, [cid, *[r for r in receiver if "type:" in r and not r.startswith("external:")]], "CALLS", pos, attributes, tier=UNRESOLVED)


def parse(text: str, file: str, nodes=None, ids=(), edges=None, keys=None) -> list[dict]:
    """The emissions of one file; a file that can't be read through gives what was found until then. nodes and edges
    are the kinds that are wanted (None: all), ids those of nodes of which only the declared id is. keys: attributes of which
    a node needs one; others are emitted as `bare`, with id and place only, as they may stand before one that has. Kinds whose
    words the text hasn't got are not looked for."""
    nodes, edges = (x if x is None else {k for k in x if k not in WORDS or any(w in text for w in WORDS[k])} for x in (nodes, edges))
    if nodes is not None and edges is not None and not (nodes or edges or ids):
        return []
    p = _Parser(text, file, nodes, ids, edges, keys)
    try:
        p.unit()
    except (IndexError, RecursionError):
        pass
    return p.settled()


def source_files(spark: SparkSession, root: str, include_tests: bool = True) -> DataFrame:
    """(path, text) of the .java files under root, with paths relative to it. The reader is Spark's own, so any
    store it knows will do."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.java").load(base)
    tail = F.regexp_replace(F.regexp_replace("path", "^[a-zA-Z]+:/*", "/"), "^.*?" + re.escape("/" + re.sub("^[a-zA-Z]+:/*", "", base).strip("/")) + "/", "")
    rows = files.select(tail.alias("path"), F.decode("content", "UTF-8").alias("text"))
    return rows if include_tests else rows.where(~in_test_tree(F.col("path")))


def emissions(files: DataFrame, nodes=None, ids=(), edges=None, keys=None, may=None) -> DataFrame:
    """All emissions of files (path, text), of the wanted kinds (as in parse). A path is one file's. Where all that is
    wanted has words, or stands in bodies, texts without any of them don't leave Spark's own memory.
    may: tells of a text whether it is to be parsed."""
    nodes, ids, edges, keys = (x if x is None else frozenset(x) for x in (nodes, ids, edges, keys))
    if nodes is not None and not nodes and not ids and edges and edges <= {"READS", "WRITES"}:
        files = files.where(F.col("text").rlike(_BODY))
    elif nodes is not None and edges is not None and not ids and all(k in WORDS for k in nodes | edges):
        words = sorted({w for k in nodes | edges for w in WORDS[k]})
        files = files.where(reduce(Column.__or__, [F.contains("text", F.lit(w)) for w in words], F.lit(False)))

    def run(batches):
        import gc

        gc.disable()  # emissions hold no cycles, and walking over them takes time
        try:
            yield from built(batches)
        finally:
            gc.enable()

    def built(batches):
        import pyarrow as pa

        text = pa.string()
        kinds = {"refs": pa.list_(text), "attributes": pa.map_(text, text), "confidence": pa.float64(), "settled": pa.bool_(), **dict.fromkeys(("line", "col", "phase", "ord"), pa.int32())}
        names = [c.split()[0] for c in EMISSION.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, FILES_A_BATCH):
                some = batch.slice(at, FILES_A_BATCH)
                rows = [e for path, text_ in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True) if may is None or may(text_ or "") for e in parse(text_ or "", path, nodes, ids, edges, keys)]
                columns = []
                for c in names:
                    values = [e[c] for e in rows]
                    if c == "attributes":  # from flat columns: many times as fast as from pairs
                        starts = [None if v is None else begin for v, begin in zip(values, accumulate([len(v or ()) for v in values], initial=0))]
                        flat = [[x for v in values if v for x in part(v)] for part in (dict.keys, dict.values)]
                        columns.append(pa.MapArray.from_arrays(pa.array([*starts, len(flat[0])], pa.int32()), *[pa.array(x, text) for x in flat]))
                    else:
                        columns.append(pa.array(values, kinds.get(c, text)))
                yield pa.RecordBatch.from_arrays(columns, names)

    return files.select("path", "text").mapInArrow(run, EMISSION)
