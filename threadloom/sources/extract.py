"""Symbols and references of source files, found in statements with DataFrame functions.

``lexer`` turns a file into statements without comments and strings, each with the statement that it stands in. A statement
is a declaration by the first rule of its language that matches; members are told by what they stand in. References are
found line by line in what is code; those inside a symbol's lines belong to it and to every symbol around it. This is no
parser: what macros expand to is out of reach, and so is code that only a grammar can tell (types of expressions, say).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .lexer import NO_CODE, scanned
from .scan import MANIFESTS, file_name, language

W = r"([A-Za-z_$][\w$]*)"
# How languages declare symbols: (kind, rule, kinds around it). A rule reads a statement on one line, with " {"
# behind it if it opens a block and ";" if not; the first that matches counts. Kinds around: none asked for; or one of these.
_VIS = r"^(?:pub(?:\s*\([^)]*\))?\s+)?"
RUST = [
    ("function", rf"{_VIS}(?:(?:default|const|async|unsafe|extern(?:\s*\"[^\"]*\")?)\s+)*fn\s+{W}.*\{{$", ()), ("struct", rf"{_VIS}struct\s+{W}", ()), ("enum", rf"{_VIS}enum\s+{W}", ()), ("interface", rf"{_VIS}(?:unsafe\s+)?trait\s+{W}", ()),
    ("type_alias", rf"{_VIS}type\s+{W}", ()), ("constant", rf"{_VIS}(?:const|static)\s+(?:mut\s+)?{W}\s*:", ()), ("module", rf"{_VIS}mod\s+{W}", ()),
    ("enum_member", r"^([A-Z]\w*)\s*(?:[({=;]|$)", ("enum",)), ("field", r"^(?:pub(?:\s*\([^)]*\))?\s+)?(?:r#)?([a-z_]\w*)\s*:(?!:)", ("struct", "enum_member")),
]
_EXPORT = r"^(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
_SCRIPT_METHOD = r"^(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*\*?\s*(?!(?:if|for|while|switch|catch|return|function|with|super|new|await|do)\b)(#?[A-Za-z_$][\w$]*)\s*\??\s*(?:<[^>]*>)?\("
JAVASCRIPT = [
    ("class", rf"{_EXPORT}(?:abstract\s+)?class\s+{W}", ()), ("function", rf"\bfunction\s*\*?\s*{W}.*\{{$", ()), ("function", rf"^(?:export\s+)?(?:const|let|var)\s+{W}\s*(?::[^=]*)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>", ()),
    ("method", rf"{_SCRIPT_METHOD}.*\{{$", ("class", "literal")),
]
TYPESCRIPT = [
    ("interface", rf"{_EXPORT}interface\s+{W}", ()), ("enum", rf"{_EXPORT}(?:const\s+)?enum\s+{W}", ()), ("type_alias", rf"{_EXPORT}type\s+{W}\s*[=<]", ()), ("module", rf"{_EXPORT}(?:namespace|module)\s+([\w.$]+)", ()), *JAVASCRIPT,
    ("method", rf"{_SCRIPT_METHOD}.*;$", ("class", "interface")), ("enum_member", rf"^{W}\s*=(?![=>])", ("enum",)),
    ("field", r"^(?:(?:public|private|protected|static|readonly|declare|override|accessor|abstract)\s+)*(#?[A-Za-z_$][\w$]*)\s*[?!]?\s*(?::|=(?![=>])|;$)", ("class", "interface")),
]
_MOD = r"^(?:(?:public|private|protected|internal|static|final|abstract|sealed|non-sealed|partial|readonly|synchronized|native|default|strictfp|transient|volatile|async|override|virtual|extern|unsafe|new|const|required|ref)\s+)*"
_TYPE = r"(?!(?:return|throw|new|else|case|goto|await|yield|package|import|using|namespace|class|record|interface|enum|struct|delegate|event)\b)[\w.<>\[\],?&\s]*?[\w>\]?]"
_CLASSES = ("class", "struct", "enum", "interface")
JAVA = [
    ("class", rf"{_MOD}class\s+{W}", ()), ("interface", rf"{_MOD}@?\s*interface\s+{W}", ()), ("enum", rf"{_MOD}enum\s+{W}", ()), ("module", r"^package\s+([\w.]+)", ()),
    ("method", rf"{_MOD}(?:<.*?>\s*)?{_TYPE}\s+{W}\s*\(.*[{{;]$", _CLASSES), ("method", rf"{_MOD}(?:<.*?>\s*)?{W}\s*\((?:[^()]*\s[^()]*)?\).*\{{$", ("class", "enum")), ("constant", rf"{_MOD}{_TYPE}\s+{W}\s*(?:\[\s*\]\s*)?(?:=(?!>)|;$|,)", ("class", "enum")),
]
CSHARP = [
    ("class", rf"{_MOD}(?:class|record(?:\s+(?:class|struct))?)\s+{W}", ()), ("struct", rf"{_MOD}struct\s+{W}", ()), ("interface", rf"{_MOD}interface\s+{W}", ()), ("enum", rf"{_MOD}enum\s+{W}", ()), ("module", r"^namespace\s+([\w.]+)", ()),
    ("type_alias", rf"{_MOD}delegate\s+.*?{W}\s*(?:<[^>]*>)?\(", ()), ("method", rf"{_MOD}{_TYPE}\s+(?:\w+\.)*{W}\s*(?:<[^>]*>)?\(.*[{{;]$", ("class", "struct", "interface")), ("method", rf"{_MOD}(~?\w+)\s*\(.*[{{;]$", ("class", "struct")),
    ("constant", rf"{_MOD}{_TYPE}\s+{W}\s*(?:=(?!>)|;$|,)", ("class", "struct")),
]
_C_NAME = r"(?!(?:if|for|while|switch|catch|return|else|do|case|goto|typedef|namespace|using|new|delete|throw|defined)\b)"
C = [
    ("type_alias", r"^typedef\b.*\(\s*\*\s*(\w+)\s*\)\s*\(.*;$", ()), ("type_alias", r"^typedef\b.*?(\w+)\s*(?:\[[^\]]*\]\s*)*;$", ()), ("constant", r"^#\s*define\s+(\w+)(?![\w(])", ()),
    ("struct", r"\bstruct\s+(?:\w+\s+(?!final\b))?(\w+)\s*(?:final\s*)?(?::[^:].*)?\{$", ()), ("enum", r"\benum\s+(?:class\s+|struct\s+)?(\w+)[^()]*\{$", ()),
    ("function", rf"^{_C_NAME}[\w:<>,*&~\[\]\s]*?[\s*&>](?:\w+(?:<[^<>]*>)?::)*{_C_NAME}(~?[A-Za-z_]\w*)\s*\(.*\{{$", ()),
]
CPP = [
    ("class", r"^(?:template\s*<.*>\s*)?class\s+(?:\w+\s+(?=(?!final\b)\w+\s*(?:final\s*)?[:{]))?(\w+)\s*(?:final\s*)?(?::[^:].*)?\{$", ()), ("module", r"^(?:inline\s+)?namespace\s+([\w:]+)", ()), ("type_alias", rf"^(?:template\s*<.*>\s*)?using\s+{W}\s*=", ()), *C,
    ("function", r"^(?:\w+(?:<[^<>]*>)?::)+(~?\w+)\s*\(.*\{$", ()), ("function", rf"^(?:(?:explicit|inline|virtual|constexpr|public:|private:|protected:)\s+)*{_C_NAME}(~?\w+)\s*\(.*\{{$", ("class", "struct")),
]
RULES = {
    "rust": RUST, "typescript": TYPESCRIPT, "tsx": TYPESCRIPT, "javascript": JAVASCRIPT, "jsx": JAVASCRIPT, "java": JAVA, "csharp": CSHARP, "c": C, "cpp": CPP,
    "python": [("function", rf"^(?:async\s+)?def\s+{W}", ()), ("class", rf"^class\s+{W}", ())],
    "go": [("function", rf"^func\s+{W}.*\{{$", ()), ("method", rf"^func\s*\([^)]*\)\s*{W}.*\{{$", ()), ("struct", rf"^type\s+{W}(?:\[[^\]]*\])?\s+struct\b", ()), ("interface", rf"^type\s+{W}(?:\[[^\]]*\])?\s+interface\b", ()), ("type_alias", rf"^type\s+{W}", ()), ("constant", rf"^const\s+{W}", ()), ("module", rf"^package\s+{W}", ())],
    "groovy": [*JAVA[:4], ("function", rf"{_MOD}def\s+{W}\s*\(.*\{{$", ("none",)), ("method", rf"{_MOD}def\s+{W}\s*\(.*\{{$", _CLASSES), *JAVA[4:]],
    "kotlin": [("function", rf"^(?:[a-z]+\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)*{W}\s*\(", ()), ("class", rf"^(?:[a-z]+\s+)*(?:class|interface|object)\s+{W}", ()), ("type_alias", rf"^(?:[a-z]+\s+)*typealias\s+{W}", ()), ("constant", rf"^(?:[a-z]+\s+)*const\s+val\s+{W}", ()), ("module", r"^package\s+([\w.]+)", ())],
    "scala": [("function", rf"^(?:[a-z]+\s+)*def\s+{W}", ()), ("class", rf"^(?:[a-z]+\s+)*(?:class|object)\s+{W}", ()), ("interface", rf"^(?:[a-z]+\s+)*trait\s+{W}", ()), ("enum", rf"^(?:[a-z]+\s+)*enum\s+{W}", ()), ("type_alias", rf"^(?:[a-z]+\s+)*type\s+{W}", ()), ("constant", rf"^(?:[a-z]+\s+)*val\s+{W}", ()), ("module", r"^package\s+([\w.]+)", ())],
    "ruby": [("function", rf"^def\s+(?:self\.)?{W}", ()), ("class", rf"^class\s+{W}", ()), ("interface", rf"^module\s+{W}", ()), ("constant", r"^([A-Z][A-Z0-9_]*)\s*=(?![=~])", ())],
}
#: Braces after this are an object, whose members are methods too.
LITERAL = r"(?:[=(,:?\[&|]|\breturn|\bdefault) \{$"
IMPORT_NAMES = {"rust": r"^(?:pub\s+)?use\s+(\w+)\s*;", "python": r"^(?:from\s+[\w.]+\s+)?import\s+\(?\s*([A-Za-z_][\w.]*)", "typescript": rf"^import\s+(?:type\s+)?{W}\s*(?:,|from\b)", "tsx": rf"^import\s+(?:type\s+)?{W}\s*(?:,|from\b)", "csharp": r"^using\s+(\w+)\s*;", "go": r"^import\s+([A-Za-z_]\w*)\s+\""}
PREPROCESSED = ("c", "cpp", "csharp")
ANNOTATED = ("java", "kotlin", "scala", "groovy")
TEST_MARKS = r"#\[test\]|#\[tokio::test\]|#\[cfg\(test\)\]|@Test|@pytest\."
FIELD_LANGUAGES = ("rust", "typescript", "tsx", "javascript", "jsx", "python")
NOT_IMPORTED = ("use", "import", "from", "as", "pub", "crate", "self", "super")
TEST_DIRS = ("/tests/", "/test/", "/__tests__/", "/spec/")
TEST_ENDS = ("_test.go", ".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".spec.ts", ".spec.js", "_spec.rb", "_test.rb")
GENERATED_DIRS = ("/generated/", "/.generated/", "/gen/")
GENERATED_ENDS = (".pb.go", ".pb.cc", ".pb.h", "_pb2.py", ".g.dart", ".freezed.dart")
GENERATED_MARKS = ("do not edit", "auto-generated", "autogenerated", "generated by", "@generated")


IMPORT = r"^\s*(?:(?:pub(?:\s*\([^)]*\))?\s+)?use\b(?!\s*\()|import\b(?!\s*\()|from\s+\S+\s+import\b|require(?:_relative)?\s+[\"']|#\s*include\b|using\s+(?!.*=)[\w.]+\s*;)"
KEYWORDS = "if for while switch match return catch function fn def class elif else and or not new await async sizeof typeof super constructor let const var func defer select with lambda assert del yield print_ except raise unless until type import package interface struct chan map range foreach lock fixed checked unchecked nameof synchronized when do try using defined decltype alignof noexcept static_assert __attribute__ where int void char float double bool long short unsigned signed pub".split()
#: A declaration that such a word marks isn't read as a call.
DECLARED = r"\b(?:fn|def|function|func|fun)\s+(?:\([^)]*\)\s*)?(?:<[^>]*>\s*)?(?:[\w?]+\.)?[\w$]+\s*(?:<[^<>]*>\s*)?\("


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def is_test_name(name: Column) -> Column:
    """Whether a symbol is named like a test."""
    return F.lower(name).rlike(r"^(tests?|test_.*|.*_tests?)$") | name.rlike(r"^[Tt]est[A-Z]") | name.rlike(r"^.+Test$")


def is_test_path(path: Column) -> Column:
    p = F.concat(F.lit("/"), F.lower(F.translate(path, "\\", "/")))
    return _any(F.contains(p, F.lit(d)) for d in TEST_DIRS) | _any(p.endswith(e) for e in TEST_ENDS)


def generated(path: Column, content: Column) -> Column:
    p, head = F.lower(F.translate(path, "\\", "/")), F.lower(F.substring(content, 1, 512))
    return _any(F.contains(p, F.lit(d)) for d in GENERATED_DIRS) | _any(p.endswith(e) for e in GENERATED_ENDS) | _any(F.contains(head, F.lit(m)) for m in GENERATED_MARKS)

@dataclass(frozen=True)
class Code:
    """lines(path, language, plain, line, text, code), the same without text (codes), statements(path, language, plain, number, parent, above, line, end_line, column, head, ruled, opens, raw, marks, first, inner) and the languages that are there."""

    lines: DataFrame
    codes: DataFrame
    statements: DataFrame
    languages: tuple[str, ...]


def read_code(files: DataFrame) -> Code:
    """The code of files(path, content) in languages that have rules."""
    lang = language(F.col("path"))
    source = files.where(F.col("content").isNotNull() & ~file_name(F.col("path")).isin(*MANIFESTS)).select("path", lang.alias("language"), "content").where(F.col("language").isin(*NO_CODE))
    worded = _any(F.contains("content", F.lit(f" {w} ")) for w in ("async", "static"))
    found = written(scanned(source.withColumn("marked", worded | F.col("content").rlike(TEST_MARKS))), "code")  # read by many steps below
    there = {r[0] for r in found.where("number IS NULL").select("language").distinct().collect()}  # as many as have rules, at most
    texts = found.where("number IS NULL")
    pairs = F.arrays_zip(F.split("content", "\n").alias("text"), F.split("code", "\n").alias("code"))
    line = (F.col("pos") + 1).cast("int").alias("line")
    lines = texts.select("path", "language", "plain", F.posexplode(pairs)).select("path", "language", "plain", line, "col.text", "col.code")
    codes = texts.select("path", "language", F.posexplode(F.split("code", "\n")).alias("pos", "code")).select("path", "language", line, "code")
    statements = found.where("number IS NOT NULL").drop("code", "content").withColumn("ruled", F.concat("head", F.when(F.col("opens"), " {").otherwise(";")))
    return Code(lines, codes, statements, tuple(x for x in NO_CODE if x in there))


def declared(code: Code) -> DataFrame:
    """Statements with kind and name, as far as they declare something: by what they say, then by what they stand in.

    Only rules of languages that are there are planned for, and only statements of those with rules for members meet what
    they stand in.
    """
    nothing = F.lit(None).cast("struct<kind: string, name: string>")

    def choice(cases: list[tuple[Column, Column]]) -> Column:
        out = F
        for condition, value in cases:
            out = out.when(condition, value)
        return out.otherwise(nothing) if cases else nothing

    def named(kind: str, pattern: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.regexp_extract("ruled", pattern, 1).alias("name"))

    def rule(free: bool) -> Column:
        by_language = []
        for lang in code.languages:
            cases = [((F.lit(True) if free else F.col("around").isin(*around)) & F.col("ruled").rlike(pattern), named(kind, pattern)) for kind, pattern, around in RULES[lang] if free != bool(around)]
            by_language += [(F.col("language") == lang, choice(cases))] if cases else []
        return choice(by_language)

    is_import = F.col("ruled").rlike(IMPORT)
    names = choice([((F.col("language") == lang) & F.col("ruled").rlike(IMPORT_NAMES[lang]), named("import", IMPORT_NAMES[lang])) for lang in code.languages if lang in IMPORT_NAMES])
    every = code.statements.withColumn("found", F.coalesce(F.when(~is_import, rule(True)), names))
    held = [lang for lang in code.languages if any(around for _, _, around in RULES[lang])]
    if not held:
        return every
    every = written(every, "declared")
    rows, rest = every.where(F.col("language").isin(*held)), every.where(~F.col("language").isin(*held))
    literal = F.col("language").isin("typescript", "tsx", "javascript", "jsx") & F.col("ruled").rlike(LITERAL)
    for _ in range(2):  # what stands in a member, as fields of a variant do, comes after it
        around = rows.select("path", F.col("number").alias("parent"), F.coalesce("found.kind", F.when(literal, "literal"), F.lit("block")).alias("around"))
        rows = rows.join(around, ["path", "parent"], "left").withColumn("around", F.coalesce("around", F.lit("none"))).withColumn("found", F.coalesce("found", F.when(~is_import, rule(False)))).drop("around")
    return rows.unionByName(rest)


def symbols(code: Code) -> DataFrame:
    """path, language, number, above, head, kind, name, start_line, end_line, start_column, signature, visibility, flags and docstring.

    In plain files no line says more about a symbol than its statement does; symbols of others meet what is told of lines.
    """
    columns = ["path", "language", "plain", "number", "above", "line", "end_line", "column", "head", "opens", "marks", "first", "inner"]
    every = written(declared(code).where("found.name <> ''").select(*columns, "found.*"), "symbols")
    lines = code.lines.where("NOT plain")
    # a text alone at the beginning of a block tells what it is about
    body = F.array_join(F.filter(F.transform(F.split("inner", "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    by_path = Window.partitionBy("path").orderBy("line")
    # words anywhere in a symbol's lines: how many lines up to each have them
    so_far = by_path.rowsBetween(Window.unboundedPreceding, 0)
    ahead = by_path.rowsBetween(Window.unboundedPreceding, -1)
    attribute = F.col("text").rlike(r"^\s*(?:#!?\[[^\]]*\]\s*$|#(?!!?\[)|@[\w.]+(?:\([^)]*\))?\s*$|//|/\*|\*)")
    counts = lines.select(
        "path", "line", "text", *(F.sum(F.contains("text", F.lit(f" {w} ")).cast("int")).over(so_far).alias(f"{w}_upto") for w in ("async", "static")),
        (F.coalesce(F.last(F.when(F.col("text").rlike(TEST_MARKS), F.col("line")), ignorenulls=True).over(ahead), F.lit(0)) > F.coalesce(F.last(F.when(~attribute & (F.trim("text") != ""), F.col("line")), ignorenulls=True).over(ahead), F.lit(0))).alias("test_above"),
    )
    at_end = counts.select("path", F.col("line").alias("end_line"), F.col("async_upto").alias("async_end"), F.col("static_upto").alias("static_end"))
    told = every.where("NOT plain").join(counts, ["path", "line"]).join(at_end, ["path", "end_line"], "left").join(comments(lines), ["path", "line"], "left").withColumn("first", F.expr("substring(text, column + 1)")).drop("text")
    none = {f"{w}_{x}": F.lit(None).cast("long") for w in ("async", "static") for x in ("upto", "end")}
    full = told.unionByName(every.where("plain").withColumns(none | {"test_above": F.lit(False), "comment": F.lit(None).cast("string")}))
    first = F.col("first")
    head = F.trim(F.regexp_replace(first, F.when(F.col("opens"), r"\{.*$").otherwise(r"\{.*$|\s*\}\s*$"), F.lit("")))
    cut = F.when(F.length(head) > 200, F.concat(F.substring(head, 1, 200), F.lit("..."))).otherwise(head)
    signature = F.when(F.col("kind").isin("function", "method"), cut).when(F.col("kind").isin("class", "struct", "interface"), head)
    lang = F.col("language")
    word = _text(F.regexp_extract("head", r"^(?:export\s+)?(pub|public|private|protected)\b", 1))
    visibility = F.coalesce(F.when(word == "pub", "public").otherwise(word), F.when(F.col("head").rlike(r"^export\b"), "public"), F.when(lang.isin("go", "python"), "public").when(lang.isin("rust", "typescript", "tsx", "javascript", "jsx"), "private").otherwise("unknown"))
    has = lambda w: F.col("head").rlike(rf"^(?:.* )?{w} ") | F.coalesce(F.coalesce(f"{w}_end", f"{w}_upto") > F.col(f"{w}_upto"), F.lit(False))
    marked = F.col("test_above") | F.concat_ws(" ", "marks", first).rlike(TEST_MARKS)
    return full.select(
        "path", "language", "number", "above", "kind", "name", "head", F.col("line").alias("start_line"), "end_line", F.col("column").alias("start_column"), signature.alias("signature"), visibility.alias("visibility"), F.coalesce("comment", body).alias("docstring"),
        has("async").alias("is_async"), has("static").alias("is_static"), F.col("head").rlike(r"^(?:export\b|pub )").alias("is_exported"), (is_test_path(F.col("path")) | (F.col("kind").isin("function", "method", "class") & (is_test_name(F.col("name")) | marked))).alias("is_test"),
    )


def comments(lines: DataFrame) -> DataFrame:
    """path, line, comment: the run of comment lines that ends right above the line, without its marks and blank lines."""
    is_comment = (F.trim("code") == "") & F.when(F.col("language").isin("python", "ruby"), F.col("text").rlike(r"^\s*#")).otherwise(F.trim("text") != "")
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.trim("text"), r"^(?:///)*(?://!)*(?://)*(?:/\*\*)*(?:/\*)*\**", ""), r"(?:\*/)+$", ""))
    rows = lines.where(is_comment).select("path", "line", clean.alias("t")).withColumn("run", F.col("line") - F.row_number().over(Window.partitionBy("path").orderBy("line")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("line", "t")))), lambda x: x["t"]), "\n")
    return rows.groupBy("path", "run").agg((F.max("line") + 1).alias("line"), text.alias("comment")).select("path", "line", _text(F.col("comment")).alias("comment"))


def _text(column: Column) -> Column:
    return F.when(column != "", column)


def matched_lines(code: Code) -> DataFrame:
    """The lines of code with in_match: whether a match of Rust is around them or on them."""
    none = code.codes.withColumn("in_match", F.lit(False))
    if "rust" not in code.languages:
        return none
    is_rust = F.col("language") == "rust"
    spans = code.statements.where(is_rust & F.col("head").rlike(r"\bmatch\b"))
    steps = spans.select("path", "line", F.lit(1).alias("step")).unionByName(spans.select("path", (F.col("end_line") + 1).alias("line"), F.lit(-1).alias("step"))).groupBy("path", "line").agg(F.sum("step").alias("step"))
    so_far = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    matched = code.codes.where(is_rust).join(steps, ["path", "line"], "left").withColumn("in_match", F.coalesce(F.sum("step").over(so_far), F.lit(0)) > 0).drop("step")
    return matched.unionByName(none.where(~is_rust))


def without_declared(rows: DataFrame, found: DataFrame, code: Code) -> DataFrame:
    """References less, of calls, the names of declarations without a word that marks them: of each the first place from its line on."""
    name = F.regexp_replace("name", "^~", "")
    names = found.where(F.col("kind").isin("function", "method", "class", "enum_member", "type_alias") & (F.contains("head", F.concat(name, F.lit("("))) | F.contains("head", F.concat(name, F.lit(" (")))) & ~F.col("head").rlike(DECLARED)).select("path", F.col("start_line").alias("line"), name.alias("reference_name"))
    promising = [x for x in ("c", "cpp", "go", "java", "csharp") if x in code.languages]
    if promising:
        # what a header, an interface or an enum only promises
        promise = rf"^(?!(?:return|throw|new|delete|goto|else|case|typedef|using)\b)(?:[\w\s*&:<>,~\[\]]*?[\s*&>~])?{W}\s*\([^=]*\)[^=]*;$"
        holders = found.where(F.col("kind").isin("class", "struct", "interface", "enum") & F.col("language").isin(*promising)).select("path", F.col("number").alias("parent"), F.lit(True).alias("held"))
        outside = F.col("parent").isNull() & F.col("language").isin("c", "cpp") & F.col("ruled").rlike(r"^[\w:~]+[\s*&<]")
        promised = code.statements.where(F.col("language").isin(*promising)).join(holders, ["path", "parent"], "left").where(~F.col("opens") & (F.col("held") | outside) & F.col("ruled").rlike(promise)).select("path", "line", F.regexp_extract("ruled", promise, 1).alias("reference_name"))
        names = names.unionByName(promised.join(names, ["path", "line", "reference_name"], "left_anti"))
    names = written(names, "bare-names")
    if names.isEmpty():
        return rows
    order = Window.partitionBy("path", "kind", "reference_name").orderBy("line", "nth")
    rows = rows.unionByName(names.select("*", F.lit("calls").alias("kind"), F.lit(-1).alias("nth")), allowMissingColumns=True).withColumn("after", F.lag("nth").over(order))
    return rows.where((F.col("nth") >= 0) & ~F.coalesce(F.col("after") < 0, F.lit(False))).drop("after")


def references(code: Code, found: DataFrame) -> DataFrame:
    """path, line, reference_name, kind, detail: calls, field reads and writes, matched variants, imports, changed parameters; found: the symbols."""
    lang, text = F.col("language"), F.col("code")
    body = matched_lines(code).where((F.trim("code") != "") & ~text.rlike(IMPORT) & ~(lang.isin(*PREPROCESSED) & text.rlike(r"^\s*#")))
    plain = F.when(lang == "rust", F.regexp_replace("code", r"#!?\[[^\]]*\]", "")).when(lang.isin(*ANNOTATED), F.regexp_replace("code", r"@[\w.]+", "")).when(lang == "csharp", F.regexp_replace("code", r"^\s*\[[^\]]*\]", "")).otherwise(text)
    kinds = []

    def each(kind: str, mark: str, languages: tuple[str, ...] | None, rule: str, detail: str | None = None, source: Column = plain, where: Column = F.lit(True)) -> None:
        """One more kind of names on a line, if its languages (none: all) are there; no match is without the mark."""
        if languages is None or not set(languages).isdisjoint(code.languages):
            at = F.contains("code", F.lit(mark)) & (where if languages is None else lang.isin(*languages) & where)
            kinds.append(F.struct(F.lit(kind).alias("kind"), F.lit(detail).cast("string").alias("detail"), F.when(at, F.regexp_extract_all(source, F.lit(rule), F.lit(1))).alias("names")))

    each("calls", "(", None, rf"(?<![\w$]){W}\s*(?:::<[^>]*>|<[\w\s,.:*&?\[\]]*>)?\(", source=F.regexp_replace(plain, DECLARED, ""))
    each("macros", "!", ("rust",), rf"(?<![\w$]){W}!\s*[(\[{{]")
    each("mutates", ".", FIELD_LANGUAGES, rf"\.{W}\s*(?:[-+*/%|&^]|<<|>>)?=(?![=>])")
    each("accesses", ".", FIELD_LANGUAGES, rf"(?<=[\w)\]])\.(?![\d.]){W}\b(?!\s*(?:\(|::|!|(?:[-+*/%|&^]|<<|>>)?=(?![=>])))")
    each("references", "::", ("rust",), r"\b\w+::(\w+)\b(?!::)", "dispatch", F.regexp_replace(plain, r"<[^<>]*>", ""), F.col("in_match"))
    each("references", ".", ("typescript", "tsx", "javascript", "jsx", "python"), r"\b[A-Z]\w*\.([A-Z]\w*)", "dispatch", where=text.rlike(r"^\s*case\b"))
    wanted = (F.col("kind") != "calls") | ~F.col("reference_name").isin(*KEYWORDS) & ((F.col("reference_name") != "in") | ~F.regexp_extract("path", r"\.(\w+)$", 1).isin("py", "pyi", "js", "jsx", "ts", "tsx", "mjs", "cjs", "kt", "kts", "groovy", "gradle"))
    rows = body.select("path", "line", F.inline(F.array(*kinds))).select("path", "line", F.posexplode("names").alias("nth", "reference_name"), "kind", "detail").where(wanted)
    # macros are calls that no declaration looks like
    out = without_declared(rows, found, code).drop("nth").withColumn("kind", F.when(F.col("kind") == "macros", "calls").otherwise(F.col("kind")))
    # parameters may stand on any line of a declaration
    heads = found.where("language = 'rust' AND kind = 'function'")
    changed = heads.select("path", F.col("start_line").alias("line"), F.explode(F.regexp_extract_all("head", F.lit(r":\s*&(?:\s*'\w+)?\s*mut\s+(?:\w+::)*([A-Z]\w*)"), F.lit(1))).alias("reference_name"), F.lit("mutates").alias("kind"), F.lit("mut_param").alias("detail"))
    words = F.filter(F.regexp_extract_all(F.regexp_replace(F.coalesce("raw", "head"), r"[\"';]", " "), F.lit(r"(\w+)"), F.lit(1)), lambda w: ~w.isin(*NOT_IMPORTED))
    # the module of 'from x import y' comes first and the name last; braces hold several
    brought = code.statements.where(F.col("ruled").rlike(IMPORT) & (lang != "csharp") | (lang == "csharp") & F.col("ruled").rlike(r"^using\s+(?!.*[=(])"))
    imports = brought.select("path", "line", F.element_at(F.when(F.size(words) > 0, words), -1).alias("reference_name"), F.lit("imports").alias("kind"), F.when(F.contains("head", F.lit("*")), "glob").alias("detail")).where("reference_name IS NOT NULL")
    return (out.unionByName(changed) if "rust" in code.languages else out).unionByName(imports)
