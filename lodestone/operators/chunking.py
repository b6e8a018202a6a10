"""Chunks of files under a token cap: by lines, or by the units of a program, with overlap and diagnostics; and the names a program declares.

Everything works on whole texts with offsets in code points. A file is chunked by one task in Arrow batches: the rules are sequential
within a file and independent between files.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize as pytokens
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters after which a long line may be cut, besides white space (fixed values).
BOUNDARY = frozenset(".,;:!?()[]{}<>+-*/=|&%")
#: Program units inside units are opened this deep.
DEEPEST = 32
Range = tuple[int, int]


def byte_tokens(text: str) -> int:
    return -(-len(text.encode()) // 4)


def combined(*counters: Callable[[str], int]) -> Callable[[str], int]:
    """The token count that satisfies several models: the largest."""
    return lambda text: max(c(text) for c in counters)


def token_cap(asked: int | None, *limits: int) -> int:
    """The effective cap: the smallest of what is asked for and what the models take."""
    return min([x for x in (asked, *limits) if x is not None])


@dataclass
class Source:
    """A text with its lines; ``count`` tokens, ``cap`` at most in a chunk."""

    text: str
    cap: int
    count: Callable[[str], int] = byte_tokens
    dropped: list[tuple[int, int, int]] = field(default_factory=list)  # start, end, tokens of what no cut could save

    def __post_init__(self) -> None:
        self.starts = [0, *(m.end() for m in re.finditer("\n", self.text))]

    def lines(self, a: int = 0, b: int | None = None) -> list[Range]:
        """Lines with their line feeds within a range."""
        b = len(self.text) if b is None else b
        cuts = [a, *self.starts[bisect_right(self.starts, a) : bisect_left(self.starts, b)], b]
        return [(x, y) for x, y in zip(cuts, cuts[1:], strict=False) if x < y]

    def line_of(self, offset: int) -> int:
        return bisect_right(self.starts, offset)

    def fits(self, a: int, b: int) -> bool:
        return self.count(self.text[a:b]) <= self.cap

    def safe_prefix(self, a: int, b: int) -> int | None:
        """End of the longest prefix that fits and ends after a boundary character."""
        low, high = a, b
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.fits(a, mid) else (low, mid - 1)
        return next((at for at in range(low, a, -1) if self.text[at - 1] in BOUNDARY or self.text[at - 1].isspace()), None)

    def cut(self, a: int, b: int) -> list[Range]:
        """A range that is too long, cut at boundaries; what can't be cut is noted and left out with all that follows in the range."""
        out = []
        while a < b:
            reach = min(b, a + 64)
            while reach < b and self.fits(a, reach):  # so a long line isn't counted anew for each of its chunks
                reach = min(b, 2 * reach - a)
            if reach == b and self.fits(a, b):
                return [*out, (a, b)]
            end = self.safe_prefix(a, reach)
            if end is None:
                self.dropped.append((a, b, self.count(self.text[a:b])))
                return out
            out.append((a, end))
            a = end
        return out

    def packed(self, parts: list[Range]) -> list[Range]:
        """Neighbouring ranges joined as long as they fit together."""
        out: list[Range] = []
        for a, b in parts:
            if out and out[-1][1] <= a and self.fits(out[-1][0], b):
                out[-1] = out[-1][0], b
            else:
                out.append((a, b))
        return out

    def by_lines(self, a: int = 0, b: int | None = None) -> list[Range]:
        """Greedy packing of lines; a line that is too long is cut and shares no chunk with others."""
        out: list[Range] = []
        run: list[Range] = []
        for line in self.lines(a, b):
            if self.fits(*line):
                run.append(line)
                continue
            out += self.packed(run) + self.cut(*line)
            run = []
        return out + self.packed(run)

    def overlapped(self, ranges: list[Range], lines: int) -> list[Range]:
        """Each start but the first moved back by up to so many lines, as far as the chunk still fits."""
        out = ranges[:1]
        for a, b in ranges[1:]:
            at = bisect_left(self.starts, a)
            back = [s for s in self.starts[max(0, at - lines) : at] if self.fits(s, b)] if lines > 0 and at < len(self.starts) else []
            out.append((back[0] if back else a, b))
        return out

    def by_units(self, units: list[Range], inner: Callable[[int, int], list[Range]], depth: int = 0) -> list[Range]:
        """Units packed greedily; one that is too long is opened, then cut by lines."""
        out: list[Range] = []
        run: list[Range] = []
        for a, b in units:
            if self.fits(a, b):
                run.append((a, b))
                continue
            out += self.packed(run)
            run = []
            parts = inner(a, b) if depth < DEEPEST else []
            out += self.by_units(parts, inner, depth + 1) if len(parts) > 1 else self.by_lines(a, b)
        return out + self.packed(run)

    def record(self, a: int, b: int) -> tuple[int, int, int, int]:
        """(start, end, start_line, end_line); a line feed at the end belongs to its own line."""
        last = b - 1 if b > a and self.text[b - 1] == "\n" else b
        return a, b, self.line_of(a), self.line_of(max(a, last))


def python_units(text: str) -> list[Range] | None:
    """Top-level statements of Python source with the comments right above them; lone comments are units too. None if it doesn't parse."""
    try:
        tree = ast.parse(text)
        comments = [t.start[0] for t in pytokens.generate_tokens(io.StringIO(text).readline) if t.type == pytokens.COMMENT and t.line[: t.start[1]].strip() == ""]
    except (SyntaxError, ValueError, RecursionError, pytokens.TokenError):
        return None
    own = [(min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]), n.end_lineno or n.lineno) for n in tree.body]
    inside = [c for c in comments if not any(a <= c <= b for a, b in own)]
    rows = sorted([(a, b, False) for a, b in own] + [(c, c, True) for c in inside])
    groups: list[list[int]] = []
    open_ = False  # the last group is comments only
    for a, b, comment in rows:
        if groups and a <= groups[-1][1] or open_ and a - groups[-1][1] <= 1:
            groups[-1][1] = max(b, groups[-1][1])
        else:
            groups.append([a, b])
            open_ = False
        open_ = comment and (open_ or groups[-1] == [a, b])
    return _rows_to_offsets(text, groups)


def brace_units(text: str) -> list[Range]:
    """Top-level parts of source with braces: each ends with the line on which its braces are closed and a blank line or a new head follows."""
    groups, depth, start, at = [], 0, None, 0
    quoted = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
    plain = quoted.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    for number, line in enumerate(plain.split("\n"), 1):
        blank = not text[at : at + len(line)].strip()
        if start is None and not blank:
            start = number
        depth = max(0, depth + sum(line.count(c) for c in "{([") - sum(line.count(c) for c in "})]"))
        if start is not None and depth == 0 and (blank or line.rstrip().endswith(("}", ";", "})", "});"))):
            groups.append([start, number - 1 if blank else number])
            start = None
        at += len(line) + 1
    if start is not None:
        groups.append([start, plain.count("\n") + 1])
    return _rows_to_offsets(text, groups)


def _rows_to_offsets(text: str, groups: list[list[int]]) -> list[Range]:
    starts = [0, *(m.end() for m in re.finditer("\n", text)), len(text) + 1]
    return [(starts[a - 1], min(len(text), starts[b] - 1)) for a, b in groups]


def units_of(text: str, extension: str) -> list[Range] | None:
    if extension == ".py":
        return python_units(text)
    return brace_units(text) if extension in NAMES else None


def _inner(source: Source, extension: str) -> Callable[[int, int], list[Range]]:
    """What a unit is made of: its head and the units of its body."""

    def parts(a: int, b: int) -> list[Range]:
        lines = source.lines(a, b)
        if len(lines) < 2:
            return []
        body = source.text[lines[1][0] : b]
        indent = len(body) - len(body.lstrip(" \t"))
        cut = re.sub(rf"(?m)^[ \t]{{1,{max(indent, 1)}}}", lambda m: "" if extension == ".py" else " " * len(m[0]), body)
        if extension == ".py":
            found = python_units(cut)
            if not found:
                return []
            rows = [(cut.count("\n", 0, x), cut.count("\n", 0, y)) for x, y in found]
            inner = source.lines(lines[1][0], b)
            found = [(inner[x][0], inner[min(y, len(inner) - 1)][1]) for x, y in rows]
        else:
            found = [(lines[1][0] + x, lines[1][0] + y) for x, y in brace_units(cut.rstrip().removesuffix("}"))]
        return [(a, found[0][0]), *found[:-1], (found[-1][0], b)] if found else []

    return parts


def chunks(text: str, extension: str = "", cap: int | None = None, overlap: int = 0, count: Callable[[str], int] = byte_tokens) -> tuple[list[tuple], list[tuple]]:
    """([(start, end, start_line, end_line)], [(start_line, end_line, tokens)] of what was left out).

    Without a cap the units of the program as they are, or the whole file; with one, units under the cap, or lines where there are no units.
    """
    if not text:
        return [], []
    source = Source(text, cap if cap is not None else 1 << 62, count)
    units = units_of(text, extension)
    if cap is None:
        return [source.record(a, b) for a, b in units or [(0, len(text))]], []
    if units is None:
        found = source.overlapped(source.by_lines(), overlap)
    else:
        found = source.by_units(units, _inner(source, extension))
    lost = [(*source.record(a, b)[2:], n) for a, b, n in source.dropped]
    return [source.record(a, b) for a, b in found], lost


CHUNK = "file string, idx int, start int, end int, start_line int, end_line int, text string, message string"
ARROW = pa.schema(
    [("file", pa.string()), *[(c, pa.int32()) for c in ("idx", "start", "end", "start_line", "end_line")], ("text", pa.string()), ("message", pa.string())]
)


def chunk_files(files: DataFrame, cap: int | None = 256, overlap: int = 10, count: Callable[[str], int] = byte_tokens, diagnostics: bool = False) -> DataFrame:
    """(file, idx, start, end, start_line, end_line, text) of (file, text); with ``diagnostics`` the parts left out instead (file, start_line, end_line, message)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, lost = chunks(text or "", extension_of(file), cap, overlap, count)
                if diagnostics:
                    out += [
                        {"file": file, "start_line": a, "end_line": b, "message": f"Cannot safely split {file}:{a}-{b}; {n} tokens exceed the limit of {cap}"}
                        for a, b, n in lost
                    ]
                    continue
                for idx, (a, b, x, y) in enumerate(found):
                    out.append({"file": file, "idx": idx, "start": a, "end": b, "start_line": x, "end_line": y, "text": text[a:b]})
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    got = files.select("file", "text").mapInArrow(run, CHUNK)
    return got.select("file", "start_line", "end_line", "message") if diagnostics else got.drop("message")


def extension_of(file: str | None) -> str:
    name = re.split(r"[/\\]", file or "")[-1]
    return "." + name.rsplit(".", 1)[1].lower() if "." in name else name.lower()


_TYPESCRIPT = {
    "function": r"\bfunction\s*\*?\s+(\w+)|^\s+(?:(?:public|private|protected|static|async|override|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(\w+)\s*\([^;{}]*\)\s*(?::[^;{}=]+)?\{",
    "type": r"\b(?:class|interface|enum)\s+(\w+)|^\s*(?:export\s+)?type\s+(\w+)\s*(?:<[^=]*>)?\s*=",
    "value": r"\b(?:const|let|var)\s+(\w+)",
}
#: Declarations by extension, as patterns; Python is parsed.
NAMES = {
    **dict.fromkeys((".ts", ".tsx", ".js", ".jsx"), _TYPESCRIPT),
    ".rs": {"function": r"\bfn\s+(\w+)", "type": r"\b(?:struct|enum|union|trait|type)\s+(\w+)", "value": r"\b(?:const|static)\s+(?:mut\s+)?(\w+)\s*:"},
    ".java": {
        "function": r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)+(?:<[^>]*>\s*)?(?:[\w.<>\[\], ?]+\s+)?(\w+)\s*\(",
        "type": r"(?:\b(?:class|interface|enum|record)|@interface)\s+(\w+)",
        "value": r"^\s*(?:(?:public|private|protected|static|final|volatile)\s+)*[\w.<>\[\]]+\s+(\w+)\s*(?:=[^=]|;)",
    },
    **dict.fromkeys(
        (".kt", ".kts"),
        {"function": r"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*\(", "type": r"\b(?:class|interface|object)\s+(\w+)", "value": r"\b(?:val|var)\s+(\w+)"},
    ),
}


def _python_names(tree: ast.AST) -> Iterator[tuple[str, str]]:
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            yield node.name, "function"
        elif isinstance(node, ast.ClassDef):
            yield node.name, "type"
        elif isinstance(node, ast.TypeAlias):
            yield node.name.id, "type"
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                yield from ((n.id, "value") for n in _bound(target))


def _bound(target: ast.expr) -> Iterator[ast.Name]:
    """Names that a target binds: attributes and items bind none."""
    if isinstance(target, ast.Name):
        yield target
    elif isinstance(target, ast.Tuple | ast.List):
        for part in target.elts:
            yield from _bound(part)
    elif isinstance(target, ast.Starred):
        yield from _bound(target.value)


def identifiers(text: str, extension: str) -> list[tuple[str, str]]:
    """(name, kind) of the declarations in a text, each once, by name: kind is function, type or value."""
    if extension == ".py":
        cut = re.sub(r"(?m)^[ \t]+", lambda m: m[0].expandtabs(), text)
        try:
            return sorted(set(_python_names(ast.parse(cut))))
        except (SyntaxError, ValueError, RecursionError):
            found = re.findall(r"(?m)^\s*(?:async\s+)?(def|class)\s+(\w+)", text)
            return sorted({(name, "function" if kind == "def" else "type") for kind, name in found})
    out = set()
    for kind, pattern in NAMES.get(extension, {}).items():
        out |= {(next(g for g in m.groups() if g), kind) for m in re.finditer(pattern, text, re.M)}
    return sorted(out)


def identifier_table(chunked: DataFrame) -> DataFrame:
    """(name, kind, ordinal) of (file, ordinal, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (name, kind, ordinal)
                for file, ordinal, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for name, kind in identifiers(text or "", extension_of(file))
            ]
            cols = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["name", "kind", "ordinal"]
            )

    return chunked.selectExpr("file", "cast(ordinal as long) ordinal", "text").mapInArrow(run, "name string, kind string, ordinal long")
