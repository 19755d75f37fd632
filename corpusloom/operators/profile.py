"""Profiles of files and source code: kinds, languages, line counts, declarations, technology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# File extensions by language and by kind of document, and the names of build files.
LANGUAGES = {
    "typescript": ["ts", "tsx", "mts", "cts"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "python": ["py", "pyw"],
    "java": ["java"],
    "go": ["go"],
    "rust": ["rs"],
    "c": ["c", "h"],
    "cpp": ["cc", "cpp", "cxx", "hpp", "hh"],
    "csharp": ["cs"],
    "php": ["php"],
    "ruby": ["rb"],
    "kotlin": ["kt", "kts"],
    "swift": ["swift"],
    "sql": ["sql"],
    "shell": ["sh", "bash", "zsh", "ps1", "bat"],
    "vue": ["vue"],
    "html": ["html", "htm"],
    "css": ["css", "scss", "less"],
}
OFFICE = {"docx": ["docx", "docm"], "xlsx": ["xlsx", "xlsm"], "pptx": ["pptx", "pptm"], "pdf": ["pdf"]}
TEXT = ["md", "markdown", "txt", "csv", "tsv", "json", "yaml", "yml", "bib", "ris", "html", "htm"]
LEGACY = ["doc", "xls", "ppt"]
MANIFESTS = ["package.json", "pnpm-lock.yaml", "yarn.lock", "package-lock.json", "requirements.txt", "pyproject.toml", "pipfile", "environment.yml", "go.mod", "cargo.toml", "pom.xml", "build.gradle", "build.gradle.kts", "composer.json", "gemfile", "dockerfile", "docker-compose.yml", "makefile"]
SKIP_DIRS = ["node_modules", ".git", "产出", ".paper", "dist", "lib", "__pycache__", ".venv", "venv"]
# How declarations begin, by language: kind and pattern, the first that fits counts.
NAME = r"([A-Za-z_$][\w$]*)"
WORD = r"([A-Za-z_]\w*)"
DECLARATIONS = {
    "typescript": [("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+{NAME}"), ("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{NAME}"), ("interface", rf"^\s*export\s+interface\s+{NAME}"), ("type", rf"^\s*export\s+type\s+{NAME}"), ("enum", rf"^\s*export\s+enum\s+{NAME}"), ("const", rf"^\s*export\s+const\s+{NAME}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\(|<)"), ("route", r"\.\s*(?:get|post|put|patch|delete)\s*\(\s*['\"`]([^'\"`]+)['\"`]")],
    "javascript": [("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+{NAME}"), ("class", rf"^\s*(?:export\s+)?class\s+{NAME}"), ("route", r"\.\s*(?:get|post|put|patch|delete)\s*\(\s*['\"`]([^'\"`]+)['\"`]")],
    "python": [("class", rf"^\s*class\s+{WORD}"), ("function", rf"^\s*(?:async\s+)?def\s+{WORD}"), ("route", r"@\w+\.(?:route|get|post|put|delete)\s*\(\s*['\"]([^'\"]+)['\"]")],
    "java": [("class", rf"^\s*(?:public|protected|private)?\s*(?:final\s+|abstract\s+)?(?:class|interface|enum)\s+{WORD}"), ("method", rf"^\s*(?:public|protected|private)\s+(?:static\s+|final\s+|synchronized\s+)*[\w<>\[\],.\s]+\s+{WORD}\s*\(")],
    "go": [("function", rf"^func\s+(?:\([^)]*\)\s*)?{WORD}"), ("struct", rf"^type\s+{WORD}\s+struct"), ("interface", rf"^type\s+{WORD}\s+interface")],
    "rust": [("function", rf"^\s*(?:pub\s+)?(?:async\s+)?fn\s+{WORD}"), ("struct", rf"^\s*(?:pub\s+)?struct\s+{WORD}"), ("enum", rf"^\s*(?:pub\s+)?enum\s+{WORD}"), ("trait", rf"^\s*(?:pub\s+)?trait\s+{WORD}")],
    "c": [("struct", rf"^\s*(?:typedef\s+)?struct\s+{WORD}"), ("function", rf"^[A-Za-z_][\w\s*]*\s+{WORD}\s*\([^;]*\)\s*\{{")],
    "cpp": [("class", rf"^\s*class\s+{WORD}"), ("struct", rf"^\s*(?:typedef\s+)?struct\s+{WORD}"), ("function", rf"^[A-Za-z_][\w:<>*&\s]*\s+{WORD}\s*\([^;]*\)\s*\{{")],
    "csharp": [("class", rf"^\s*(?:public|internal|private|protected)?\s*(?:sealed\s+|abstract\s+|partial\s+)*(?:class|interface|enum|record)\s+{WORD}"), ("method", rf"^\s*(?:public|private|protected|internal)\s+(?:static\s+|async\s+|virtual\s+|override\s+)*[\w<>\[\],.\s]+\s+{WORD}\s*\(")],
    "php": [("class", rf"^\s*(?:final\s+|abstract\s+)?class\s+{WORD}"), ("function", rf"^\s*(?:public\s+|private\s+|protected\s+|static\s+)*function\s+{WORD}")],
    "ruby": [("class", rf"^\s*class\s+{WORD}"), ("function", r"^\s*def\s+([A-Za-z_]\w*[?!=]?)")],
    "kotlin": [("class", rf"^\s*(?:data\s+|sealed\s+|open\s+|abstract\s+)?class\s+{WORD}"), ("function", rf"^\s*(?:private\s+|internal\s+|public\s+)?fun\s+{WORD}")],
    "swift": [("class", rf"^\s*(?:final\s+|open\s+)?(?:class|struct|enum|protocol)\s+{WORD}"), ("function", rf"^\s*(?:public\s+|private\s+|internal\s+)?func\s+{WORD}")],
    "sql": [("table", r"(?i)^\s*CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"\[]?([A-Za-z_]\w*)"), ("view", r"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?VIEW\s+[`\"\[]?([A-Za-z_]\w*)")],
    "shell": [("function", r"^\s*(?:function\s+)?([A-Za-z_]\w*)\s*\(\s*\)\s*\{")],
    "vue": [("component", r"^\s*defineComponent\s*\(\s*\{?\s*name:\s*['\"]([^'\"]+)['\"]"), ("function", rf"^\s*(?:export\s+)?(?:async\s+)?function\s+{NAME}"), ("const", rf"^\s*const\s+{NAME}\s*=\s*(?:ref|reactive|computed|defineProps|defineEmits)\b")],
    "html": [("script", r"(?i)<script[^>]*src=[\"']([^\"']+)[\"']"), ("link", r"(?i)<link[^>]*href=[\"']([^\"']+)[\"']")],
    "css": [("selector", r"^([.#][A-Za-z_][\w-]*)\s*\{")],
}
# Comment marks by language; all others use the marks of C.
COMMENTS = {"python": "#", "shell": "#", "ruby": "#", "sql": "--", "html": "<!--", "css": r"/\*|\*"}
# Technologies and the pattern in a build file that shows them.
STACK = {
    "Node.js / npm": r'"(?:dependencies|devDependencies)"\s*:', "React": r'"react"\s*:', "Vue": r'"vue"\s*:', "Angular": r'"@angular/core"\s*:', "Express": r'"express"\s*:', "Koa": r'"koa"\s*:', "NestJS": r'"@nestjs/core"\s*:',
    "TypeScript": r'"typescript"\s*:', "Vite": r'"vite"\s*:', "Webpack": r'"webpack"\s*:', "Next.js": r'"next"\s*:', "FastAPI": "(?i)fastapi", "Flask": "(?i)flask", "Django": "(?i)django", "PyTorch": "(?i)torch",
    "TensorFlow": "(?i)tensorflow", "NumPy": "(?i)numpy", "Pandas": "(?i)pandas", "OpenCV": "(?i)opencv", "Spring Boot": "(?i)spring-boot", "MyBatis": "(?i)mybatis", "Maven": "<groupId>", "Gradle": r"plugins\s*\{|dependencies\s*\{",
    "Go Modules": r"(?m)^module\s+\S+", "Gin": "gin-gonic/gin", "Cargo / Rust": r"(?m)^\[package\]", "MySQL": "(?i)mysql", "PostgreSQL": "(?i)postgres", "SQLite": "(?i)sqlite", "Redis": "(?i)redis", "MongoDB": "(?i)mongo",
    "Docker": r"(?i)FROM\s+\S+|services:", "Composer / PHP": r'"require"\s*:',
}


def base_name(path: Column) -> Column:
    return F.lower(F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1))


def extension(path: Column) -> Column:
    """The extension in lower case without its dot; empty for none and for names that only begin with a dot."""
    return F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1)


def _lookup(value: Column, table: dict[str, list[str]]) -> Column:
    pairs = [F.lit(x) for name, exts in table.items() for e in exts for x in (e, name)]
    return F.element_at(F.create_map(*pairs), value)


def language(path: Column) -> Column:
    """Programming language by extension, or null."""
    return _lookup(extension(path), LANGUAGES)


def file_kind(path: Column) -> Column:
    """docx, xlsx, pptx, pdf, text, code or unsupported, in this order of precedence."""
    is_text = base_name(path).isin(MANIFESTS) | extension(path).isin(TEXT)
    return F.coalesce(_lookup(extension(path), OFFICE), F.when(is_text, "text"), F.when(language(path).isNotNull(), "code"), F.lit("unsupported"))


def unsupported_reason(path: Column) -> Column:
    """Why a file cannot be read: legacy_office or unknown_format; null for files that can."""
    return F.when(file_kind(path) == "unsupported", F.when(extension(path).isin(LEGACY), "legacy_office").otherwise("unknown_format"))


def line_counts(files: DataFrame, most: int | None = 20_000) -> DataFrame:
    """``(rel, language, lines, blank_lines, comment_lines, code_lines, truncated)`` per source file ``(rel, text)``.

    Lines after the first ``most`` are not read (None reads all). A file of unknown language is left out, a null text counts as empty.
    """
    rows = files.withColumn("language", language(F.col("rel"))).filter("language IS NOT NULL")
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = rows.withColumn("all_lines", split).withColumn("head", F.slice("all_lines", 1, most) if most else F.col("all_lines"))
    mark = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in COMMENTS.items() for x in (k, v))), F.col("language")), F.lit(r"//|/\*|\*"))
    blank = F.size(F.filter("head", lambda x: x.rlike(r"^\s*$")))
    comment = F.size(F.filter("head", lambda x: F.regexp_like(x, F.concat(F.lit(r"^\s*(?:"), mark, F.lit(")")))))
    return rows.select("rel", "language", F.size("all_lines").alias("lines"), blank.alias("blank_lines"), comment.alias("comment_lines"), (F.size("head") - blank - comment).alias("code_lines"), (F.size("all_lines") > most if most else F.lit(False)).alias("truncated"))


def declarations(files: DataFrame, most: int | None = 40, most_lines: int | None = 20_000) -> DataFrame:
    """``(rel, language, kind, name, line)``: the first ``most`` distinct declarations per file, in order of line.

    None for either limit keeps all.
    """
    rows = files.withColumn("language", language(F.col("rel"))).filter("language IS NOT NULL")
    lines = rows.select("rel", "language", F.posexplode(F.slice(F.split("text", "\n"), 1, most_lines) if most_lines else F.split("text", "\n")).alias("pos", "code"))
    mark = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in COMMENTS.items() for x in (k, v))), F.col("language")), F.lit(r"//|/\*|\*"))
    lines = lines.filter(~F.regexp_like("code", F.concat(F.lit(r"^\s*(?:"), mark, F.lit(")"))))
    hit = F.lit(None).cast("struct<kind:string,name:string>")
    for lang, patterns in DECLARATIONS.items():
        tries = [F.when((F.col("language") == lang) & F.col("code").rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("code", p, 1).alias("name"))) for kind, p in patterns]
        hit = F.coalesce(hit, *tries)
    found = lines.withColumn("hit", hit).filter("hit.name <> ''").groupBy("rel", "language", F.col("hit.kind").alias("kind"), F.col("hit.name").alias("name")).agg((F.min("pos") + 1).alias("line"))
    if most is None:
        return found
    place = W.partitionBy("rel").orderBy("line", "kind", "name")
    return found.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= most).drop("place")


def tech_stack(manifests: DataFrame) -> DataFrame:
    """``(name, evidence)``: each technology with the first build file ``(rel, text)`` that shows it, by path."""
    shown = F.array(*(F.when(F.col("text").rlike(p), F.lit(n)) for n, p in STACK.items()))
    return manifests.select("rel", F.explode(F.filter(shown, lambda x: x.isNotNull())).alias("name")).groupBy("name").agg(F.min("rel").alias("evidence"))


def language_rollup(counts: DataFrame) -> DataFrame:
    """``(language, files, lines, code_lines)`` per language and in total (null language)."""
    return counts.rollup("language").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.coalesce(F.sum("code_lines"), F.lit(0)).alias("code_lines"))


def largest(counts: DataFrame, most: int) -> DataFrame:
    """``(rel, lines, place)``: the ``most`` longest files, ties by name."""
    top = counts.select("rel", F.col("lines").cast("bigint").alias("lines")).orderBy(F.desc("lines"), "rel").limit(most)
    # ``most`` rows are left: one small window
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("lines"), "rel")).cast("bigint"))
