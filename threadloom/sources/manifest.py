"""Symbols of package manifests, with DataFrame functions: files(path, content) -> path, kind, name, signature, line.

JSON is read as maps; TOML and the line formats line by line, with the section and the key that a line stands under carried
forward within its file; XML by its elements. What can't be read gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import MANIFESTS, file_name

OUT = ("path", "kind", "name", "signature", "line")
# Where dependencies stand.
NPM_DEPENDENCIES = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
COMPOSER_DEPENDENCIES = ("require", "require-dev")
CARGO_DEPENDENCIES = ("dependencies", "dev-dependencies", "build-dependencies")
GRADLE_CONFIGURATIONS = "implementation api compileOnly runtimeOnly testImplementation testCompileOnly testRuntimeOnly annotationProcessor kapt ksp classpath".split()


def _text(column: Column) -> Column:
    return F.when(column != "", column)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _pair(left: Column, mark: str, right: Column) -> Column:
    """'left<mark>right', or null where there is no right."""
    return F.when(right.isNotNull(), F.concat(left, F.lit(mark), right))


def _rows(table: DataFrame, kind: str, name: Column, signature: Column | None = None, line: Column | None = None) -> DataFrame:
    signature = F.lit(None).cast("string") if signature is None else signature
    return table.select("path", F.lit(kind).alias("kind"), name.alias("name"), signature.alias("signature"), (F.lit(1) if line is None else line).cast("int").alias("line")).where(F.col("name").isNotNull() & (F.col("name") != ""))


def _named(files: DataFrame, *names: str) -> DataFrame:
    return files.where(file_name(F.col("path")).isin(*names)).select("path", "content")


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def json_manifest(files: DataFrame, dependencies: tuple[str, ...]) -> DataFrame:
    """package.json and composer.json: the package, its dependencies and its scripts."""
    maps = ", ".join(f"`{d}` map<string,string>" for d in dependencies)
    data = files.withColumn("j", F.from_json("content", f"name string, version string, {maps}, scripts map<string,string>", {"mode": "PERMISSIVE"}))
    out = [_rows(data, "module", F.col("j.name"), _pair(F.col("j.name"), "@", F.col("j.version")))]
    for d in dependencies:
        each = data.select("path", F.explode(F.col("j")[d]))
        out.append(_rows(each, "import", F.col("key"), _pair(F.lit(d), ": ", F.col("value"))))
    out.append(_rows(data.select("path", F.explode("j.scripts")), "function", F.col("key"), F.col("value")))
    return _union(*out)


def lines_of(files: DataFrame) -> DataFrame:
    """path, line (from 1), text."""
    return files.select("path", F.posexplode(F.split("content", r"\r?\n"))).select("path", (F.col("pos") + 1).alias("line"), F.col("col").alias("text"))


def toml_lines(files: DataFrame) -> DataFrame:
    """path, line, section, key, value of the lines of TOML files; lines of a list come under the key that begins it."""
    line = lines_of(files).withColumn("text", F.regexp_replace("text", r"^((?:[^#\"']|\"[^\"]*\"|'[^']*')*)#.*$", "$1"))
    so_far = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    section = _text(F.regexp_extract("text", r"^\s*\[\[?\s*([^\]]+?)\s*\]?\]\s*$", 1))
    key = F.when(F.col("new").isNotNull(), "").otherwise(_text(F.regexp_extract("text", r"^\s*\"?([\w.-]+)\"?\s*=", 1)))
    line = line.withColumn("new", section).withColumn("own", key)
    return line.select("path", "line", F.coalesce(F.last("new", True).over(so_far), F.lit("")).alias("section"), F.last("own", True).over(so_far).alias("key"), F.col("own").isNotNull().alias("begins"), "text").where(~F.col("text").rlike(r"^\s*(\[.*\]\s*)?$"))


def _quoted(text: Column) -> Column:
    return F.regexp_extract(text, "[\"']([^\"']*)[\"']", 1)


def _value(line: DataFrame, section: str, key: str, alias: str) -> DataFrame:
    return line.where(F.col("begins") & (F.col("section") == section) & (F.col("key") == key)).groupBy("path").agg(F.min(_quoted(F.col("text"))).alias(alias))


def _module(line: DataFrame, section: str) -> DataFrame:
    both = _value(line, section, "name", "name").join(_value(line, section, "version", "version"), "path", "left")
    return _rows(both, "module", F.col("name"), _pair(F.col("name"), "@", F.col("version")))


def _version(text: Column) -> Column:
    """Of 'name = "1"' or 'name = { version = "1" }'."""
    table = F.regexp_extract(text, r"=\s*\{.*?\bversion\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.coalesce(_text(table), _text(F.regexp_extract(text, r"=\s*[\"']([^\"']*)[\"']", 1)))


def cargo(files: DataFrame) -> DataFrame:
    line = toml_lines(files)
    own = line.where("begins")
    deps = own.where(F.col("section").isin(*CARGO_DEPENDENCIES))
    tables = line.select("path", F.regexp_extract("section", r"^(" + "|".join(CARGO_DEPENDENCIES) + r")\.(.+)$", 2).alias("name"), F.regexp_extract("section", r"^([^.]+)", 1).alias("part"), F.when(F.col("begins") & (F.col("key") == "version"), _quoted(F.col("text"))).alias("version")).where("name <> ''").groupBy("path", "part", "name").agg(F.max("version").alias("version"))
    features = own.where("section = 'features'")
    return _union(_module(line, "package"), _rows(deps, "import", F.col("key"), _pair(F.col("section"), ": ", _version(F.col("text")))), _rows(tables, "import", F.col("name"), _pair(F.col("part"), ": ", F.col("version"))), _rows(features, "constant", F.col("key"), F.lit("feature")))


def requirement_name(spec: Column) -> Column:
    """The name before a version, an extra or a marker."""
    return F.trim(F.regexp_extract(spec, r"^\s*([^><=!~\[; ]*)", 1))


def requirement_version(spec: Column) -> Column:
    return _text(F.trim(F.regexp_extract(F.regexp_replace(spec, r";.*$", ""), r"^\s*[^><=!~\[; ]*(?:\[[^\]]*\])?\s*(.*)$", 1)))


def pyproject(files: DataFrame) -> DataFrame:
    line = toml_lines(files)
    specs = line.select("path", "section", "key", F.explode(F.regexp_extract_all("text", F.lit(r"\"([^\"]+)\"|'([^']+)'"), F.lit(0))).alias("q")).withColumn("spec", F.expr("substring(q, 2, length(q) - 2)"))
    pep = specs.where("section = 'project' AND key = 'dependencies' OR section = 'project.optional-dependencies' OR section = 'tool.uv' AND key = 'dev-dependencies'")
    poetry = line.where(F.col("begins") & F.col("section").rlike(r"^tool\.poetry\.(dependencies|dev-dependencies|group\.[^.]+\.dependencies)$") & (F.col("key") != "python"))
    main, other = _module(line, "project"), _module(line, "tool.poetry")
    return _union(main, other.join(main, "path", "left_anti"), _rows(pep, "import", requirement_name(F.col("spec")), requirement_version(F.col("spec"))), _rows(poetry, "import", F.col("key"), _version(F.col("text"))))


def requirements(files: DataFrame) -> DataFrame:
    line = lines_of(files).withColumn("text", _strip(F.col("text"))).where((F.col("text") != "") & ~F.col("text").rlike("^[#-]"))
    return _rows(line, "import", requirement_name(F.col("text")), requirement_version(F.col("text")), F.col("line"))


def go_mod(files: DataFrame) -> DataFrame:
    line = lines_of(files).withColumn("text", _strip(F.regexp_replace("text", r"//.*$", "")))
    so_far = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("text").rlike(r"^require\s*\("), True).when(F.col("text").rlike(r"^\)|^\w+\s*\("), False)
    line = line.withColumn("inside", F.coalesce(F.last(mark, True).over(so_far), F.lit(False)))
    one = F.regexp_extract("text", r"^require\s+(\S+)\s+\S+", 1)
    dep = F.when(one != "", one).otherwise(F.when(F.col("inside"), F.regexp_extract("text", r"^(\S+)\s+v\S+", 1)))
    return _union(
        _rows(line, "module", F.regexp_extract("text", r"^module\s+(\S+)", 1), None, F.col("line")),
        _rows(line.where(F.col("text").rlike(r"^go\s+\S+")), "constant", F.lit("go"), F.regexp_extract("text", r"^go\s+(\S+)", 1), F.col("line")),
        _rows(line, "import", dep, F.regexp_extract("text", r"\s(v\S+)", 1), F.col("line")),
    )


def gemfile(files: DataFrame) -> DataFrame:
    line = lines_of(files).withColumn("text", _strip(F.col("text")))
    value = lambda word: F.regexp_extract("text", rf"^{word}\s*\(?\s*[\"']([^\"']+)[\"']", 1)
    version = _text(F.regexp_extract("text", r"^gem\s*\(?\s*[\"'][^\"']+[\"']\s*,\s*[\"']([^\"']+)[\"']", 1))
    return _union(_rows(line.where(value("source") != ""), "constant", F.lit("source"), value("source"), F.col("line")), _rows(line.where(value("ruby") != ""), "constant", F.lit("ruby"), value("ruby"), F.col("line")), _rows(line, "import", value("gem"), version, F.col("line")))


def pom(files: DataFrame) -> DataFrame:
    tag = lambda text, name: _text(F.trim(F.regexp_extract(text, rf"(?s)<{name}>(.*?)</{name}>", 1)))
    full = lambda text: F.concat_ws(":", tag(text, "groupId"), tag(text, "artifactId"))
    own = F.regexp_replace("content", r"(?s)<(dependencies|build|parent|plugins|dependencyManagement|profiles)>.*?</\1>", "")
    c = F.col("own")
    data = files.withColumn("own", own)
    parts = lambda name: files.select("path", F.explode(F.regexp_extract_all("content", F.lit(rf"(?s)<{name}>.*?</{name}>"), F.lit(0))).alias("x"))
    x = F.col("x")
    version, scope = tag(x, "version"), tag(x, "scope")
    return _union(
        _rows(data.where(tag(c, "artifactId").isNotNull()), "module", full(c), _pair(full(c), "@", tag(c, "version"))),
        _rows(parts("dependency").where(tag(x, "artifactId").isNotNull()), "import", full(x), F.coalesce(_pair(scope, ": ", version), version, scope)),
        _rows(parts("plugin").where(tag(x, "artifactId").isNotNull()), "import", full(x), _pair(F.lit("plugin"), ": ", version)),
    )


def gradle(files: DataFrame) -> DataFrame:
    line = lines_of(files).withColumn("text", _strip(F.col("text"))).where(~F.col("text").startswith("//"))
    plugin = F.regexp_extract("text", r"^id\s*\(?\s*[\"']([^\"']+)[\"']", 1)
    version = _text(F.regexp_extract("text", r"\bversion\s*\(?\s*[\"']([^\"']+)[\"']", 1))
    configuration = "|".join(GRADLE_CONFIGURATIONS)
    spec = F.regexp_extract("text", rf"^(?:{configuration})\s*\(?\s*(?:platform\()?[\"']([^\"']+)[\"']", 1)
    scope = F.regexp_extract("text", rf"^({configuration})\b", 1)
    name, number = F.regexp_extract(spec, r"^([^:]+(?::[^:]+)?)", 1), _text(F.regexp_extract(spec, r"^[^:]+:[^:]+:(.+)$", 1))
    return _union(
        _rows(line, "module", F.regexp_extract("text", r"^group\s*=?\s*[\"']([^\"']+)[\"']", 1), None, F.col("line")),
        _rows(line, "import", plugin, _pair(F.lit("plugin"), ": ", version), F.col("line")),
        _rows(line, "import", name, _pair(scope, ": ", number), F.col("line")),
    )


def sbt(files: DataFrame) -> DataFrame:
    line = lines_of(files).where(~_strip(F.col("text")).startswith("//"))
    version = line.groupBy("path").agg(F.max(_text(F.regexp_extract("text", r"\bversion\s*:=\s*\"([^\"]+)\"", 1))).alias("version"))
    name = F.regexp_extract("text", r"(?:^|[\s,(])name\s*:=\s*\"([^\"]+)\"", 1)
    dep = r"\"([^\"]+)\"\s*%%?%?\s*\"([^\"]+)\"\s*%\s*\"([^\"]+)\"(?:\s*%\s*\"([^\"]+)\")?"
    got = lambda i: _text(F.regexp_extract("x", dep, i))
    deps = line.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(dep), F.lit(0))).alias("x"))
    scala = F.regexp_extract("text", r"\bscalaVersion\s*:=\s*\"([^\"]+)\"", 1)
    return _union(
        _rows(line.join(version, "path"), "module", name, _pair(name, "@", F.col("version")), F.col("line")),
        _rows(line.where(scala != ""), "constant", F.lit("scalaVersion"), scala, F.col("line")),
        _rows(deps, "import", F.concat_ws(":", got(1), got(2)), F.coalesce(_pair(got(4), ": ", got(3)), got(3)), F.col("line")),
    )


def manifest_symbols(files: DataFrame) -> DataFrame:
    """Symbols of all manifests among files(path, content); only the kinds that are there are planned for."""
    named = F.col("file_name")
    there = {r[0] for r in files.select(file_name(F.col("path")).alias("file_name")).where(named.isin(*MANIFESTS)).distinct().collect()}  # at most eleven names
    kinds = {
        ("package.json",): lambda t: json_manifest(t, NPM_DEPENDENCIES),
        ("composer.json",): lambda t: json_manifest(t, COMPOSER_DEPENDENCIES),
        ("Cargo.toml",): cargo,
        ("pyproject.toml",): pyproject,
        ("requirements.txt",): requirements,
        ("go.mod",): go_mod,
        ("Gemfile",): gemfile,
        ("pom.xml",): pom,
        ("build.gradle", "build.gradle.kts"): gradle,
        ("build.sbt",): sbt,
    }
    parts = [read(_named(files, *names)) for names, read in kinds.items() if not there.isdisjoint(names)]
    return _union(*parts) if parts else files.sparkSession.createDataFrame([], "path string, kind string, name string, signature string, line int")
