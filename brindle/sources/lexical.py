"""Events and structure of Python texts by patterns alone, for texts that no parser takes.

One pattern finds every comment and string of a whole text, so strings that run over several lines are blanked like all
others. What is left is read line by line: imports and plain assignments bind names, deeper indentation belongs to the
definition above it, and the calls of a line come from the right, as arguments run first.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame

from brindle.functions import vocabulary as V
from brindle.sources import frontend, syntax

QUOTED = re.compile(
    r"""\#[^\n]* | (?P<three>\"{3}|'{3}) (?P<long>.*?) (?:(?P<closed>(?P=three)) | \Z)
    | (?P<one>["']) (?P<short>(?:\\[^\n] | (?!(?P=one))[^\\\n])*) (?:(?P=one) | \\?(?=\n|\Z))""",
    re.S | re.X,
)
NAME = r"[A-Za-z_]\w*"
DOTTED = rf"{NAME}(?:\.{NAME})*"
IMPORT = re.compile(r"import\s+(.+)$")
FROM = re.compile(rf"from\s+({DOTTED})\s+import\s+(.+)$")
ALIASED = re.compile(rf"({DOTTED})(?:\s+as\s+({NAME}))?$")
SYMBOL = re.compile(rf"({NAME})(?:\s+as\s+({NAME}))?$")
BINDING = re.compile(rf"({NAME})\s*=\s*({NAME}(?:\.{NAME})+)\s*(?:\(|$)")
DEFINITION = re.compile(rf"(?:async\s+)?def\s+({NAME})\s*\(")
CALL = re.compile(rf"\b({DOTTED})\s*\(")
ENVIRON = re.compile(r"\b(?:os\.)?environ\s*\[")
PAYLOAD = re.compile(rf"\b(?:{'|'.join(V.LEXICAL_PAYLOAD)})\s*=")
MODE = re.compile(r"[rwaxtb+]+")
MODULE = re.compile(rf"""\s*\(\s*[rRuUbBfF]{{0,2}}(["'])({DOTTED})\1""")
GUARD = re.compile(r"""if\s+__name__\s*==\s*(["'])__main__\1\s*:""")
# Structures that tell of code transformation, by the name that counts.
ANCHORS = (
    ("ast-api", re.compile(r"\s*(?:import\s+ast\b|from\s+ast\s+import\b)")), ("ast-visitor", re.compile(r".*\b(?:ast\.)?(?:NodeVisitor|NodeTransformer)\b")),
    ("ast-api", re.compile(r".*\bast\.(?:parse|unparse)\s*\(")), ("runtime-compiler", re.compile(r".*\b(?:builtins\.)?compile\s*\(")),
)


def masked(text: str) -> tuple[list[str], dict[int, list[str]]]:
    """Lines with comments and strings blanked, and the strings that begin and end in each line (from 0)."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    strings: dict[int, list[str]] = {}

    def blank(m: re.Match) -> str:
        whole = m[0]
        if "\n" not in whole and (m["closed"] or m["one"]):
            value = m["long"] if m["three"] else re.sub(r"\\(.)", r"\1", m["short"])
            strings.setdefault(bisect_left(breaks, m.start()), []).append(value)
        return re.sub(r"[^\n]", " ", whole)

    return QUOTED.sub(blank, text).split("\n"), strings


def _indent(line: str) -> int:
    lead = line[: len(line) - len(line.lstrip(" \t"))]
    return len(lead) + 3 * lead.count("\t")


class Lines:
    """Reads one text; events, defined functions, main guards, what they call, and anchors are its results."""

    def __init__(self, text: str, path: str, most: int = 2000):
        self.raw = text.replace("\r\n", "\n").split("\n")
        self.code, self.strings = masked("\n".join(self.raw))
        self.setup = re.split(r"[\\/]", path)[-1].lower() == "setup.py"
        self.names: dict[str, str] = {}
        self.open: list[tuple[int, str]] = []
        self.functions: list[str] = []
        found, seen = [], set()
        for n, code in enumerate(self.code):
            if not code.strip():
                continue
            self._enter(code)
            line = [e for e in self._line(n, code) if self._new(e, seen)]
            found += sorted(line, key=lambda e: -e["column"])
        self.limited = len(found) > most
        self.events = [{"event_index": i, "path": path} | e for i, e in enumerate(found[:most])]

    def _enter(self, code: str) -> None:
        depth = _indent(code)
        while self.open and depth <= self.open[-1][0]:
            self.open.pop()
        if m := DEFINITION.match(code.strip()):
            self.open.append((depth, m[1]))
            self.functions.append(m[1])

    @staticmethod
    def _new(e: dict, seen: set) -> bool:
        keys = {(e["op"], e["line"], e["target"], e["function"])} | ({("", e["phase"], e["target"], e["function"])} if e["op"] == "IMPORT" else set())
        if keys & seen:
            return False
        seen |= keys
        return True

    def _line(self, n: int, code: str) -> Iterator[dict]:
        inner = self.open[-1][1] if self.open else "<module>"
        install = self.setup and not self.open or inner in V.INSTALL_FUNCTIONS
        place = {"line": n + 1, "function": inner, "phase": "install" if install else "runtime" if self.open else "import"}
        event = lambda op, category, detail, target, column: place | {"op": op, "category": category, "detail": detail, "target": target[: syntax.LITERAL], "column": column}
        words, strings = code.strip(), self.strings.get(n, [])
        first = lambda other: next((s for s in strings if s), other)
        if m := IMPORT.match(words):
            for a in filter(None, (ALIASED.match(x.strip()) for x in m[1].split(","))):
                self.names[a[2] or a[1].split(".")[0]] = a[1]
                yield event("IMPORT", "context", "module import", a[1], code.find(a[1]))
        if m := FROM.match(words):
            for a in filter(None, (SYMBOL.match(x.strip()) for x in m[2].split(","))):
                self.names[a[2] or a[1]] = whole = f"{m[1]}.{a[1]}"
                yield event("IMPORT", "context", "symbol import", whole, code.find(a[1]))
        if m := BINDING.match(words):
            self.names[m[1]] = self._resolved(m[2])
        for m in ENVIRON.finditer(code):
            yield event("ENV_READ", "source", "environment variable access", first("environment"), m.start())
        for m in reversed(list(CALL.finditer(code))):
            name = self._resolved(m[1])
            if kind := self._kind(name, m, n, code, strings, first(name)):
                yield event(*kind, m.start())

    def _resolved(self, name: str) -> str:
        head, dot, rest = name.partition(".")
        return self.names.get(head, head) + dot + rest

    def _kind(self, name: str, m: re.Match, n: int, code: str, strings: list[str], target: str) -> tuple[str, str, str, str] | None:
        """Operation, category, detail and target of a call."""
        last = name.rpartition(".")[2]
        if name in syntax.OPENERS:
            mode = next((s for s in strings if MODE.fullmatch(s)), "r")
            op, category, detail = ("FILE_WRITE", "sink", "file write") if set(mode) & set("wax+") else ("FILE_READ", "source", "file read")
        elif name == "urllib.request.urlopen" and not PAYLOAD.search(code):
            op, category, detail = "NETWORK_RECEIVE", "source", "remote communication"
        elif found := syntax.classify(name) or syntax.classify(f".{name}"):
            op, category, detail = found
        else:
            return None
        if op == "FILE_DELETE":
            detail = V.RECURSIVE_DELETE if name == "shutil.rmtree" else "directory deletion" if last == "rmdir" else "file deletion"
        if op == "DYNAMIC_IMPORT" and (literal := MODULE.match(self.raw[n], m.start() + len(m[1]))):
            return "IMPORT", "context", "literal module import", literal[2]
        if op == "BROWSER_COOKIE_READ" or op == "FILE_WRITE" and last in ("write_text", "write_bytes"):
            target = name
        if op == "FILE_READ" and syntax.has_marker(target, V.SENSITIVE_PATH):
            return "SENSITIVE_FILE_READ", "source", "sensitive file access", target
        if op == "FILE_WRITE" and syntax.persistent(target):
            return "PERSISTENCE_WRITE", "sink", "autostart location write", target
        return op, category, detail, target

    def guards(self) -> list[dict]:
        """First and last lines of main guards."""
        out = []
        for n, code in enumerate(self.code):
            if code.strip().startswith("if __name__") and GUARD.match(self.raw[n].strip()):
                depth = _indent(code)
                after = (k for k in range(n + 1, len(self.code)) if self.code[k].strip() and _indent(self.code[k]) <= depth)
                out.append({"first": n + 1, "last": next(after, len(self.code))})
        return out

    def called(self, guards: list[dict]) -> list[str]:
        """Names that are called inside guards."""
        inside = {n for g in guards for n in range(g["first"], g["last"])}
        return sorted({m[1] for n in inside for m in re.finditer(rf"\b({NAME})\s*\(", self.code[n])})

    def anchors(self) -> tuple[list[str], list[int]]:
        hits = [(name, n + 1) for n, code in enumerate(self.code) for name, pattern in ANCHORS if pattern.match(code)]
        return sorted({name for name, _ in hits}), sorted({n for _, n in hits})


def analyse(text: str, path: str, most: int = 2000) -> dict:
    """Events and structure of one text, in the fields of the syntax frontend; there are no exact paths."""
    t = Lines(text, path, most)
    guards = t.guards()
    anchors, lines = t.anchors()
    return {"parse_error": None, "event_limit_reached": t.limited, "events": t.events, "exact": [], "guards": guards, "functions": sorted(set(t.functions)), "main_functions": t.called(guards), "anchors": anchors, "anchor_lines": lines}


def extract(sources: DataFrame, max_bytes: int = 1_000_000, max_events: int = 2000) -> DataFrame:
    """One analysis row per source row (target_id, path, content binary), as frontend.extract gives them."""
    return frontend.analysed(sources, max_bytes, lambda text, path: analyse(text, path, max_events))


def events(sources: DataFrame, max_events: int = 2000) -> DataFrame:
    return frontend.events_of(extract(sources, max_events=max_events))

