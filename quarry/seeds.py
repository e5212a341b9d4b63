"""Small reference tables: languages, frameworks, vulnerability keywords, kinds of sinks.

Authored for this engine; a project replaces or extends them with its own frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: id, extensions, interpreters, app types, entry patterns, sink patterns.
LANGUAGES = [
    ("python", [".py", ".pyw"], ["python"], ["web"], ["@app.route", "def main"], ["eval(", "exec(", "os.system", "subprocess"]),
    ("javascript", [".js", ".mjs", ".jsx"], ["node"], ["web"], ["app.get(", "exports."], ["eval(", "innerHTML", "child_process"]),
    ("php", [".php"], ["php"], ["web"], ["$_GET", "$_POST"], ["shell_exec(", "include(", "unserialize("]),
    ("ruby", [".rb"], ["ruby"], ["web"], ["def index"], ["system(", "send(", "Marshal.load"]),
    ("bash", [".sh"], [], ["binary"], ["getopts"], ["eval ", "curl "]),
    ("c", [".c", ".h"], [], ["binary", "firmware"], ["int main"], ["strcpy(", "system(", "gets("]),
    ("go", [".go"], [], ["binary", "web"], ["func main"], ["exec.Command(", "template.HTML("]),
    ("java", [".java"], [], ["web", "mobile"], ["@RequestMapping"], ["Runtime.exec", "readObject("]),
    ("solidity", [".sol"], [], ["contract"], ["external", "public"], ["tx.origin", ".call{", "selfdestruct("]),
]

#: id, language, further languages, markers, entry patterns, sinks, sources, sanitizers.
FRAMEWORKS = [
    ("flask", "python", [], ["from flask", "import flask"], ["@app.route"], ["render_template_string"], ["request.args", "request.form"], ["escape("]),
    ("django", "python", [], ["from django"], ["def get"], ["mark_safe", ".raw("], ["request.GET", "request.POST"], ["escape("]),
    ("express", "javascript", [], ["require('express')"], ["app.get("], ["res.send("], ["req.query", "req.body"], ["validator.escape"]),
    ("spring", "java", ["kotlin"], ["org.springframework"], ["@GetMapping"], ["JdbcTemplate.query"], ["@RequestParam"], ["HtmlUtils.htmlEscape"]),
]

#: Vulnerability class to lower-case keywords of the first filter layer.
VULN_KEYWORDS = {
    "command_injection": ["system(", "exec(", "popen", "subprocess"],
    "sql_injection": ["select ", "execute(", "cursor"],
    "xss": ["innerhtml", "document.write", "render"],
    "path_traversal": ["open(", "../", "readfile"],
    "deserialization": ["pickle", "unserialize", "readobject"],
}

#: Keyword of a sink to its class; the default is "unknown".
SINK_TYPES = [
    ("system", "command_injection"), ("exec", "command_injection"), ("popen", "command_injection"),
    ("query", "sql_injection"), ("innerHTML", "xss"), ("open", "path_traversal"), ("load", "deserialization"),
]

#: Names whose calls bring outside data in, and those that make it harmless.
PY_SOURCES = ["input", "request", "sys.argv", "os.environ", "recv", "read"]
PY_SANITIZERS = ["escape", "quote", "int", "float", "sanitize", "clean", "parameterize"]

#: Order of the kinds of application, most specific first.
APP_ORDER = ["firmware", "binary", "web", "mobile", "contract"]

#: Severity in falling order.
SEVERITIES = ["critical", "high", "medium", "low", "info"]


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        LANGUAGES,
        "id string, extensions array<string>, interpreters array<string>, app_types array<string>, "
        "entry_patterns array<string>, sink_patterns array<string>",
    )


def frameworks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        FRAMEWORKS,
        "id string, language string, also array<string>, markers array<string>, entry_patterns array<string>, "
        "sinks array<string>, sources array<string>, sanitizers array<string>",
    )


def keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v, k) for v, ks in VULN_KEYWORDS.items() for k in ks], "vuln string, keyword string")
