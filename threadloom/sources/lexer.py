"""Source text as statements: what the columns of ``extract`` find declarations in.

A file goes through two small machines. ``blanked`` carries the state of comments, strings, raw strings and templates through
the text and puts spaces where they are, so that places and lines stay. ``statements`` keeps a stack of open brackets and
blocks over what is left and cuts it where a statement ends: at a block, a semicolon, a line's end (by language) or, between
members, a comma. So a declaration may span lines, share one with others, or stand in a group.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame

# What is no code, by language.
TRIPLE = r'"""(?:\\.|(?!""").)*(?:"""|\Z)'
TRIPLE_SINGLE = r"'''(?:\\.|(?!''').)*(?:'''|\Z)"
DOUBLE = r'"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)'
SINGLE = r"'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)"
SLASHES, BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
NESTED, TEMPLATE = r"(?P<nested>/\*)", r"(?P<template>`)"
CHARACTER = r"'(?:\\u\{[0-9a-fA-F]*\}|\\x..|\\[^\n]|[^'\\\n])'"
LITERAL = r"(?<=[(,=:\[!&|?{};\n])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*"
SCRIPT = (SLASHES, BLOCK, LITERAL, DOUBLE, SINGLE, TEMPLATE)
NO_CODE = {
    "rust": (SLASHES, NESTED, r'b?r(?P<hashes>#*)"(?:.*?)"(?P=hashes)', r'"(?:[^"\\]|\\.)*(?:"|\Z)', CHARACTER),
    "typescript": SCRIPT, "tsx": SCRIPT, "javascript": SCRIPT, "jsx": SCRIPT,
    "python": (r"#[^\n]*", TRIPLE, TRIPLE_SINGLE, DOUBLE, SINGLE),
    "go": (SLASHES, BLOCK, r"`[^`]*(?:`|\Z)", DOUBLE, CHARACTER),
    "java": (SLASHES, BLOCK, TRIPLE, DOUBLE, CHARACTER),
    "c": (SLASHES, BLOCK, DOUBLE, CHARACTER),
    "cpp": (SLASHES, BLOCK, r'R"(?P<mark>[^ ()\\\n]{0,16})\(.*?\)(?P=mark)"', DOUBLE, CHARACTER),
    "csharp": (SLASHES, BLOCK, r'\$*"""+.*?"""+', r'(?:\$@|@\$|@)"(?:[^"]|"")*(?:"|\Z)', DOUBLE, CHARACTER),
    "kotlin": (SLASHES, NESTED, r'""".*?(?:"""+|\Z)', DOUBLE, CHARACTER),
    "scala": (SLASHES, NESTED, r'""".*?(?:"""+|\Z)', DOUBLE, CHARACTER),
    "groovy": (SLASHES, BLOCK, TRIPLE, TRIPLE_SINGLE, DOUBLE, SINGLE),
    "ruby": (r"(?m:^=begin\b).*?(?:^=end\b[^\n]*|\Z)", r"#(?!\{)[^\n]*", r"<<[~-]?(?P<quote>['\"]?)(?P<here>[A-Z_]+)(?P=quote).*?\n[ \t]*(?P=here)\b", DOUBLE, SINGLE),
}
#: Blocks by indentation; statements that end with a line; that only semicolons and blocks end.
INDENTED = ("python", "ruby")
BY_LINES = ("typescript", "tsx", "javascript", "jsx", "go", "kotlin", "scala", "groovy")
SCRIPTS = ("typescript", "tsx", "javascript", "jsx")
#: Braces after these words belong to the statement.
BRACED_IMPORT = re.compile(r"(?:pub(?:\([^)]*\))?\s+)?(?:import|use|export)\b(?!.*\b(?:class|function|default|interface|enum|abstract|const|let|var|async|namespace)\b)", re.S)
#: Members of such blocks end with commas.
BY_COMMAS = re.compile(r"\b(?:enum|struct|union)\b(?!.*\bfn\b)", re.S)
GROUPED = re.compile(r"(?:const|type|var|import)")
GOES_ON = re.compile(r"\s*(?:[.?:=&|+*/%<>^){\]]|->|(?:extends|implements|where|with|by|throws|else|catch|finally)\b)")
UNFINISHED = re.compile(r"(?:[=(,\[+*/%&|<>?:.^~-]|\b(?:extends|implements|with|by|throws|return|in|is|as|new))\Z")
MARKS = re.compile(r"\s*(?:#!?\[(?:[^\[\]]|\[[^\]]*\])*\]|@(?!interface\b)[\w.]+(?:\s*\((?:[^()]|\([^()]*\))*\))?|\[(?:[^\[\]]|\[[^\]]*\])*\](?=\s*[\w\[])|(?:public|private|protected)\s*:(?!:))")
TOKENS = re.compile(r"[{}()\[\];\n,<>]|#")


@lru_cache(maxsize=32)
def scanner(language: str) -> re.Pattern:
    return re.compile("|".join(f"(?:{p})" for p in NO_CODE[language]) + (r"|(?P<open>\{)|(?P<close>\})" if language in SCRIPTS else ""), re.S)


def _spaces(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def _without(piece: str) -> str:
    """Spaces for a comment or string; a string keeps its quotes, as a sign that something is there."""
    quoted = re.search(r"[\"'`/]\Z", piece) and not piece.startswith(("//", "/*", "#", "=begin"))
    if not quoted or len(piece) < 2:
        return _spaces(piece)
    lead = len(piece) - len(piece.lstrip(" \t"))
    return " " * lead + '"' + _spaces(piece[lead + 1 : -1]) + '"'


def blanked(text: str, language: str) -> str:
    """The text with spaces for comments and for what strings hold; lines and places are the same."""
    find, out, at = scanner(language).search, [], 0
    holes: list[int] = []  # open braces in each open substitution of a template

    def template(start: int) -> int:
        """Past a template's next substitution or its end."""
        m = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(?:`|\$\{|\Z)", re.S).match(text, start)
        if text.startswith("${", m.end() - 2) and m.end() - 2 >= start:
            holes.append(0)
        return m.end()

    while m := find(text, at):
        out.append(text[at : m.start()])
        end = m.end()
        kind = m.lastgroup if m.lastgroup in ("nested", "template", "open", "close") else None
        if kind == "nested":
            depth = 1
            while depth and (n := re.compile(r"/\*|\*/").search(text, end)):
                depth += 1 if n[0] == "/*" else -1
                end = n.end()
            end = len(text) if depth else end
            out.append(_spaces(text[m.start() : end]))
        elif kind == "template":
            end = template(end)
            out.append(_spaces(text[m.start() : end]))
        elif kind == "open" or kind == "close":
            if kind == "close" and holes and not holes[-1]:
                holes.pop()
                end = template(end)
                out.append(_spaces(text[m.start() : end]))
            else:
                if holes:
                    holes[-1] += 1 if kind == "open" else -1
                out.append(m[0])
        else:
            out.append(_without(m[0]))
        at = end
    return "".join([*out, text[at:]])


class Block:
    """An open block: the number of its statement, and where in it the current statement began."""

    def __init__(self, number: int | None, by_commas: bool = False, prefix: str = "", round_: bool = False):
        self.number, self.by_commas, self.prefix, self.round = number, by_commas, prefix, round_
        self.start: int | None = None
        self.brackets: list[str] = []
        self.angles = 0


#: number, parent, line, end_line, column, head (on one line, without marks), opens, from and to (places in the text), marks
Statement = list


def statements(code: str, language: str) -> list[Statement]:
    return indented(code, language) if language in INDENTED else braced(code, language)


def _lines(code: str):
    """From a place to the number of its line."""
    from bisect import bisect_left

    ends = [m.start() for m in re.finditer("\n", code)]
    return (lambda at: bisect_left(ends, at) + 1), (lambda at: at - (ends[n - 1] + 1 if (n := bisect_left(ends, at)) else 0))


def braced(code: str, language: str) -> list[Statement]:
    line_of, column_of = _lines(code)
    by_lines, out = language in BY_LINES, []
    stack = [Block(None)]

    def emit(top: Block, end: int, opens: bool) -> Statement | None:
        """The statement from its start to end; none if there is only space."""
        start = top.start
        if start is None:
            return None
        begin = start
        while (m := MARKS.match(code, begin, end)) and m.end() > begin and code[m.end() : end].strip():
            begin = m.end()
        while begin < end and code[begin].isspace():
            begin += 1
        head = " ".join(code[begin:end].split())
        if not head and not opens:
            return None
        s = [len(out), top.number, line_of(begin), line_of(max(begin, end - 1)), column_of(begin), f"{top.prefix} {head}" if top.prefix else head, opens, begin, end, " ".join(code[start:begin].split())]
        out.append(s)
        return s

    for m in TOKENS.finditer(code + "\n"):
        c, at, top = m[0], m.start(), stack[-1]
        if top.start is None:  # the first character since the last statement
            since = getattr(top, "since", 0)
            gap = re.compile(r"\s*").match(code, since).end()
            if gap < at or (gap == at and c in "([{<#"):
                top.start = gap
        if c == "#":
            line = code[code.rfind("\n", 0, at) + 1 : at]
            if language in ("c", "cpp", "csharp") and not line.strip() and not top.brackets:
                end = at
                while (end := (code.find("\n", end) + 1 or len(code) + 1)) and code[end - 2 : end - 1] == "\\" and end <= len(code):
                    pass
                top.start = at
                emit(top, end - 1, False)
                top.start, top.since = None, end - 1
                top.skip = end - 1
            continue
        if at < getattr(top, "skip", 0):
            continue
        if c in "([":
            if c == "(" and language == "go" and top.start is not None and not top.brackets and GROUPED.fullmatch(code[top.start : at].strip()):
                group = Block(top.number, False, code[top.start : at].strip(), True)
                group.since = at + 1
                stack.append(group)
            else:
                top.brackets.append(c)
        elif c in ")]":
            if top.brackets:
                top.brackets.pop()
            elif top.round and c == ")":
                emit(top, at, False)
                stack.pop()
                stack[-1].start, stack[-1].since = None, at + 1
        elif c == "{":
            head = code[top.start : at] if top.start is not None else ""
            if BRACED_IMPORT.match(head.strip()) and not top.brackets or top.brackets[-1:] == ["{"]:
                top.brackets.append("{")
                continue
            if top.start is None:
                top.start = at
            s = emit(top, at, True)
            literal = language in SCRIPTS and re.search(r"(?:[=(,:?\[&|]|\breturn|\bdefault|\A)\s*\Z", head)
            members = language != "go" and language != "c" and BY_COMMAS.search(head) or (top.by_commas and language == "rust") or (language == "c" and re.search(r"\benum\b", head))
            if language in ("cpp", "csharp", "java") and members and not re.search(r"\benum\b", head):
                members = None
            block = Block(s[0] if s else top.number, bool(literal or members))
            block.since = at + 1
            stack.append(block)
        elif c == "}":
            if top.brackets[-1:] == ["{"]:
                top.brackets.pop()
                continue
            if len(stack) == 1 or top.round:
                top.start, top.since = None, at + 1
                continue
            emit(top, at, False)
            stack.pop()
            outer = stack[-1]
            if top.number is not None:
                out[top.number][3] = line_of(at)
            if not outer.brackets and not re.match(r"\s*typedef\b", code[outer.start : at] if outer.start is not None else ""):
                outer.start, outer.since, outer.angles = None, at + 1, 0
        elif c in "<>":
            if top.by_commas and not top.brackets and code[at - 1 : at] not in ("-", "="):
                top.angles = max(0, top.angles + (1 if c == "<" else -1))
        elif c == ";" or c == ",":
            if top.brackets or (c == "," and (not top.by_commas or top.angles)):
                continue
            emit(top, at, False)
            top.start, top.since, top.angles = None, at + 1, 0
        elif by_lines and not top.brackets and top.start is not None:  # a line's end
            head = code[top.start : at].rstrip()
            only_marks = MARKS.fullmatch(head) is not None
            if not only_marks and not UNFINISHED.search(head) and not (language != "go" and GOES_ON.match(code, at)):
                emit(top, at, False)
                top.start, top.since, top.angles = None, at + 1, 0
    for top in reversed(stack):
        emit(top, len(code), False)
        if top.number is not None and out[top.number][6]:
            out[top.number][3] = max(out[top.number][3], line_of(len(code.rstrip())))
    return out


def indented(code: str, language: str) -> list[Statement]:
    """Logical lines: joined inside of brackets and by backslashes; a block lasts while lines are further in."""
    out, stack, at, number = [], [], 0, 0  # stack of (indent, number)
    lines = code.split("\n")
    places, place = [], 0
    for x in lines:
        places.append(place)
        place += len(x) + 1
    last = 0
    while at < len(lines):
        first = at
        if not lines[at].strip():
            at += 1
            continue
        depth, quotes, whole = 0, 0, []
        while at < len(lines):
            x = lines[at].rstrip()
            # a string that spans lines keeps its quotes alone
            depth += x.count("(") + x.count("[") + x.count("{") - x.count(")") - x.count("]") - x.count("}")
            quotes += x.count('"')
            whole.append(x.removesuffix("\\"))
            at += 1
            if depth <= 0 and quotes % 2 == 0 and not x.endswith("\\"):
                break
        indent = len(lines[first]) - len(lines[first].lstrip())
        head = " ".join(" ".join(whole).split())
        closing = language == "ruby" and re.match(r"end\b", head)
        while stack and (stack[-1][0] > indent or (stack[-1][0] == indent and not closing)):
            out[stack.pop()[1]][3] = last
        last = at if language != "ruby" else at
        if closing:
            if stack and stack[-1][0] == indent:
                out[stack.pop()[1]][3] = at
            continue
        opens = head.endswith(":") if language == "python" else True
        out.append([number, stack[-1][1] if stack else None, first + 1, at, indent, head, opens, places[first] + indent, places[at - 1] + len(lines[at - 1]), ""])
        stack.append((indent, number))
        number += 1
    for _, n in stack:
        out[n][3] = max(out[n][3], last)
    return out


SCHEMA = "path string, language string, number int, parent int, line int, end_line int, column int, head string, opens boolean, raw string, marks string, above array<int>, first string, inner string, plain boolean, code string, content string"
#: A lone string as a statement.
LONE = re.compile(r'[rRuU]?"\s*"')
RAW = ("import", "export", "from", "use", "pub", "using", "require", "#", "package", '"')
#: Characters of a line that statements carry along.
SHORT = 1000
#: Rows and characters of text in a batch.
BATCH_ROWS, BATCH_TEXT = 4096, 1 << 22


def _has_comment_lines(code: str, content: str) -> bool:
    return code != content and any(not c.strip(" ") and t.strip(" ") for c, t in zip(code.split("\n"), content.split("\n"), strict=True))


def file_rows(path: str, language: str, content: str, marked: bool) -> list[tuple]:
    """A row with code and content, and one for each statement."""
    content = content.replace("\r\n", "\n")
    code = blanked(content, language)
    lines = content.split("\n")
    plain = not marked and max(map(len, lines)) <= SHORT and not _has_comment_lines(code, content)
    found = statements(code, language)
    raws = [content[s[7] : s[8]][:20000] if s[5].startswith(RAW) else None for s in found]
    above: list[list[int]] = []  # the statements around each
    rows: list[tuple] = [(path, language, *[None] * 12, plain, code, content)]
    for i, s in enumerate(found):
        above.append([] if s[1] is None else [*above[s[1]], s[1]])
        within = language == "python" and i + 1 < len(found) and found[i + 1][1] == i and LONE.fullmatch(found[i + 1][5])
        rows.append((path, language, *s[:7], raws[i], s[9], above[i], lines[s[2] - 1][s[4] :] if plain else None, raws[i + 1] if within else None, plain, None, None))
    return rows


def scanned(files: DataFrame) -> DataFrame:
    """For each of files(path, language, content, marked) a row with code and content (number is null), and one for each statement.

    above: the statements around it; inner: the lone string that it begins with; plain: the file isn't marked and has neither
    long lines nor lines of comments alone; first: in such files, the statement's first line from its column on.
    """

    def run(record_batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
        schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in SCHEMA.split(", "))])

        def batch(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        rows, text = [], 0
        for rb in record_batches:
            for path, language, content, marked in zip(*(rb.column(n).to_pylist() for n in ("path", "language", "content", "marked")), strict=True):
                rows += file_rows(path, language, content, marked)
                text += len(content)
                if len(rows) >= BATCH_ROWS or text >= BATCH_TEXT:
                    yield from (batch(rows[at : at + BATCH_ROWS]) for at in range(0, len(rows), BATCH_ROWS))
                    rows, text = [], 0
        if rows:
            yield batch(rows)

    return files.select("path", "language", "content", "marked").mapInArrow(run, SCHEMA)
