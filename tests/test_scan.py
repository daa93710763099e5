"""Files, rules, verdicts, linking, reports and exports."""

import json

import pytest

from siftstone.analyze import engine, rules
from siftstone.plans import scan
from siftstone.sinks import exports
from siftstone.sources import code, config, reports

HEAD = "import os, sqlite3, hashlib, subprocess, shlex\nfrom flask import request\nLIMIT = '10'\n"
#: source line -> (rule, status, suppression) of the finding on it, or None
CASES = [
    ("def a(): os.system('ls ' + input())", ("HS-CMDI-001", "confirmed", None)),
    ("def a(): os.system('ls ' + LIMIT)", ("HS-CMDI-001", "suppressed", "taint:constant_input")),
    ("def a(): os.system('ls')", None),
    ("def a(x): os.system('ls ' + x)", ("HS-CMDI-001", "candidate", None)),
    ("def a(): os.system('ls ' + shlex.quote(request.args['q']))", ("HS-CMDI-001", "suppressed", "taint:sanitized")),
    ("def a(): eval(shlex.quote(request.args['q']))", ("HS-CODEI-001", "confirmed", None)),
    ("def a(): eval(request.form['x'])  # tool: ignore", ("HS-CODEI-001", "suppressed", "inline:ignore")),
    ("def a(): eval(request.form['x'])  # tool: ignore[OTHER]", ("HS-CODEI-001", "confirmed", None)),
    ("def a(): subprocess.run(request.args['c'], shell=True)", ("HS-CMDI-001", "confirmed", None)),
    ("def a(): subprocess.run(request.args['c'], shell=False)", None),
    ("def a(): sqlite3.connect('x').execute(f\"select * from t where n = {int(input())}\")", ("HS-SQLI-001", "suppressed", "taint:sanitized")),
    ("def a(cur): cur.execute('select ' + request.args['q'])", ("HS-SQLI-001", "confirmed", None)),
    ("def a(cur): cur.execute('select ?', (request.args['q'],))", None),
    ("def a(p): hashlib.md5(p)", ("HS-CRYPTO-001", "candidate", None)),
    ("def a(p): hashlib.md5(p, usedforsecurity=False)", None),
    ("def a(p): hashlib.sha256(p)", None),
    ("from psycopg2.extensions import encrypt_password as e; e('a', 'b')", ("HS-CRYPTO-001", "candidate", None)),
    ("from psycopg2.extensions import encrypt_password as e; e('a', 'b', None, 'scram-sha-256')", None),
    ("def a(c): c.pgconn.encrypt_password(b'a', b'b', b'md5')", ("HS-CRYPTO-001", "candidate", None)),
    ("def a(os): os.system(input())", None),
]


def found(source, path="app.py"):
    return [json.loads(v) for k, v in engine.analyze(path, source.encode(), rules.validated(rules.BUILT_IN)) if k == "finding"]


@pytest.mark.parametrize("line,expected", CASES)
def test_labelled_lines(line, expected):
    got = [(f["rule_id"], f["status"], f["suppression"]) for f in found(HEAD + line + "\n") if f["start_line"] == 4]
    assert got == ([expected] if expected else [])


def test_credentials_make_a_weak_hash_high():
    source = HEAD + "def a(password):\n    h = hashlib.md5()\n    h.update(password)\ndef b(x):\n    h = hashlib.md5()\n    h.update(x)\n"
    assert [f["severity"] for f in found(source)] == ["high", "low"]


def test_paths_join():
    source = HEAD + "def a(n):\n    x = 'a'\n    if n:\n        x = input()\n    os.system(x)\ndef b():\n    x = 'a'\n    for i in range(3):\n        x = x + 'b'\n    os.system(x)\n"
    assert [(f["function"], f["status"]) for f in found(source)] == [("a", "confirmed"), ("b", "suppressed")]


def test_bad_files_are_error_rows():
    for content in (b"def (", b"\xff\xfe\x00", b"# coding: nonsense\nx = 1\n"):
        assert [k for k, _ in engine.analyze("x.py", content, [])] == ["error"]

    class Broken(rules.Rule):
        rule_id, name, description = "X-1", "x", "x"

        def check(self, node, file):
            raise KeyError("no")

    assert [k for k, _ in engine.analyze("x.py", b"f()\n", [Broken()])][0] == "error"


def test_soundness_on_generated_programs():
    """Programs are run with a recording sink: what receives the marked input is never suppressed."""
    import random

    rng, reached, suppressed = random.Random(3), 0, 0
    for _ in range(300):
        body, names = [], ["x", "y", "z"]
        for _ in range(rng.randrange(3, 8)):
            a, b = rng.choice(names), rng.choice(names)
            body.append(rng.choice([f"{a} = {b} + 'k'", f"{a} = 'c'", f"{a} = input()", f"if flag:\n        {a} = {b}", f"for i in range(2):\n        {a} = {b} + {a}", f"{a} = [{b}, 'q'][flag]", f"{a} = str({b})"]))
        sink = rng.choice(names)
        source = "import os\ndef f(flag):\n    x = y = z = 'i'\n    " + "\n    ".join(body) + f"\n    os.system({sink})\n"
        marked = False
        for flag in (0, 1):
            seen = []
            scope = {"input": lambda: "MARK", "__import__": None}
            run = source.replace("import os\n", "").replace("os.system", "sink")
            exec(run, scope | {"sink": seen.append}, scope := {})  # generated here, nothing from outside
            scope["f"].__globals__.update({"sink": seen.append, "input": lambda: "MARK"})
            scope["f"](flag)
            marked |= any("MARK" in s for s in seen)
        status = [f["status"] for f in found(source)]
        reached += marked
        suppressed += status == ["suppressed"]
        assert not (marked and status == ["suppressed"]), source
    assert reached > 50 and suppressed > 20


@pytest.fixture
def project(tmp_path):
    files = {
        "pkg/__init__.py": "",
        "pkg/helper.py": "import os\n\ndef run(name):\n    os.system('echo ' + name)\n\ndef relay(v):\n    return v\n\ndef loop(v):\n    return loop(v)\n",
        "main.py": "from pkg.helper import run, relay\n\ndef go():\n    run(relay(input()))\n",
        "safe.py": "import os\n\ndef quiet(name):\n    os.system('echo ' + name)\n\ndef use():\n    quiet('x')\n",
        "venv/bad.py": "import os\nos.system(input())\n",
        ".h.py": "x = 1\n",
    }
    for name, source in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(source)
    return tmp_path


def test_listing_keeps_init_and_prunes(project):
    assert code.listed(str(project)) == [".h.py", "main.py", "pkg/__init__.py", "pkg/helper.py", "safe.py"]
    assert code.listed(str(project), ("pkg/",)) == [".h.py", "main.py", "safe.py"]


def test_scan_links_across_files(spark, project, tmp_path):
    findings, errors = scan.scan(spark, str(project))
    rows = {(r.path, r.rule_id): r for r in findings.collect()}
    assert errors.count() == 0
    assert rows["pkg/helper.py", "HS-CMDI-001"].status == "confirmed" and "main.py" in rows["pkg/helper.py", "HS-CMDI-001"].note
    assert rows["safe.py", "HS-CMDI-001"].status == "candidate"
    unlinked = {r.path: r.status for r in scan.scan(spark, str(project), link=False)[0].collect()}
    assert unlinked["pkg/helper.py"] == "candidate"
    out = tmp_path / "out.sarif"
    exports.export_sarif(findings, errors, str(out))
    log = json.loads(out.read_text())
    assert [r["ruleId"] for r in log["runs"][0]["results"]] == ["HS-CMDI-001", "HS-CMDI-001"] and log["runs"][0]["invocations"][0]["executionSuccessful"]
    exports.export_sarif(findings, errors, str(out))  # an earlier report may be replaced
    (tmp_path / "other.txt").write_text("mine")
    with pytest.raises(ValueError):
        exports.export_json(findings, errors, str(tmp_path / "other.txt"))
    exports.export_json(findings, errors, str(tmp_path / "out.json"))
    assert json.loads((tmp_path / "out.json").read_text())["stats"]["by_status"] == {"suppressed": 0, "candidate": 1, "confirmed": 1}
    assert exports.text_lines(findings).first().line.startswith("HIGH HS-CMDI-001 pkg/helper.py:4:")


@pytest.mark.parametrize(
    "files",
    [
        {"app/a.py": "from .helper import run\n\ndef go():\n    run(input())\n"},
        {"app/a.py": "from . import helper\n\ndef go():\n    helper.run(input())\n"},
        {"app/sub/a.py": "from ..helper import run\n\ndef go():\n    run(input())\n"},
        {"app/__init__.py": "from .helper import run\n", "a.py": "from app import run\n\ndef go():\n    run(input())\n"},
        {"app/__init__.py": "from .mid import act\n", "app/mid.py": "from .helper import run as act\n", "a.py": "from app import act\n\ndef go():\n    act(input())\n"},
    ],
)
def test_relative_imports_and_reexports_link(spark, tmp_path, files):
    for path, content in ({"app/helper.py": "import os\n\ndef run(name):\n    os.system('echo ' + name)\n"} | files).items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    findings, _ = scan.scan(spark, str(tmp_path))
    assert [(r.path, r.status) for r in findings.collect()] == [("app/helper.py", "confirmed")]


def test_relative_imports_mean_no_outside_module():
    """A sibling named as a library's module is not that module; nothing lies above the root."""
    for line in ("from .subprocess import run", "from ...subprocess import run", "from .subprocess import *"):
        rows = engine.analyze("a.py", (line + "\nrun(input(), shell=True)\n").encode(), list(rules.BUILT_IN))
        assert not [v for k, v in rows if k == "finding"], line


@pytest.mark.parametrize("source", ["import pkg.helper\npkg.helper.run = print\n", "import pkg.helper\nsetattr(pkg.helper, 'run', print)\n", "import sys\nsys.modules['x'] = 1\n", "import sys\nsys.modules[str(1)] = 2\n", "import pkg.helper\nsetattr(pkg.helper, str(1), 2)\n", "import pkg.helper\nvars(pkg.helper)[str(1)] = 2\n"])
def test_replaced_functions_link_nothing(spark, project, source):
    (project / "patch.py").write_text(source)
    assert {r.path: r.status for r in scan.scan(spark, str(project))[0].collect()}["pkg/helper.py"] == "candidate"


def test_imported_rows_get_function_and_call(spark, tmp_path):
    """The innermost call at the column; of whole lines the last that starts there; else the line and the function around it. Secrets in the code stay masked."""
    source = "import os\n\n\nclass A:\n    def run(self, x):\n        os.system(str(x)); print(\n            x)\n        y = 1\n        api_key = wrap('s3cr3t-0042')\n\n\nz = 2\n"
    (tmp_path / "a.py").write_text(source)
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "b.py").write_text("x = 1\n")
    region = "struct<start_line:int,start_column:int,end_line:int,end_column:int>"
    rows = [("a.py", (6, 21, 6, 22)), ("a.py", (6, 10, 6, 12)), ("a.py", (6, 1, 6, None)), ("a.py", (8, 1, 8, None)), ("a.py", (12, 1, 12, 2)), ("a.py", (9, 1, 9, None)), ("gone.py", (1, 1, 1, 2)), ("a.py", (99, 1, 99, 2))]
    imported = spark.createDataFrame(rows, f"path string, region {region}")
    got = [(r.path, *r.region[:2], r.sink, r.function) for r in scan.enriched(imported, code.python_files(spark, str(tmp_path))).collect()]
    assert sorted(got) == sorted([
        ("a.py", 6, 21, "str(x)", "A.run"), ("a.py", 6, 10, "os.system(str(x))", "A.run"), ("a.py", 6, 1, "print(\n            x)", "A.run"), ("a.py", 8, 1, "y = 1", "A.run"),
        ("a.py", 12, 1, "z = 2", None), ("a.py", 9, 1, "wrap(*************)", "A.run"), ("gone.py", 1, 1, "", None), ("a.py", 99, 1, "", None),
    ])
    # a scan takes them in, and ignores what it does not scan itself
    full = imported.selectExpr("path", "region", "'t:r' AS rule_id", "'other:t:r' AS vuln_class", "array('x') AS cwe", "'low' AS severity", "10 AS confidence", "'m' AS message", "'t' AS source").unionByName(
        spark.createDataFrame([("build/b.py", (1, 1, 1, 2), "t:r", "other:t:r", ["x"], "low", 10, "m", "t")], f"path string, region {region}, rule_id string, vuln_class string, cwe array<string>, severity string, confidence int, message string, source string"))
    found = scan.scan(spark, str(tmp_path), imported=full)[0].filter("array_contains(sources, 't')").collect()
    assert len(found) == len(rows) and {r.function for r in found} == {"A.run", None} and all("s3cr3t" not in str(r) for r in found)


def test_settings_decide_what_is_shown_and_what_fails(spark, tmp_path):
    (tmp_path / "a.py").write_text("import os, hashlib\n\n\ndef a(p):\n    os.system(input())\n    hashlib.md5(p)\n    eval(input())  # x: ignore\n")
    (tmp_path / "b.py").write_text("eval(input())\n")
    settings = config.Config(ignore=("b.py",), fail_on="high")
    show = lambda c: sorted((r.path, r.rule_id, r.failing) for r in scan.scan_by_settings(spark, str(tmp_path), c)[0].collect())
    assert show(settings) == [("a.py", "HS-CMDI-001", True), ("a.py", "HS-CRYPTO-001", False)]
    assert show(config.Config(ignore=("b.py",), min_severity="high", show_suppressed=True, link=False)) == [("a.py", "HS-CMDI-001", True), ("a.py", "HS-CODEI-001", False)]
    assert not any(failing for *_, failing in show(config.Config(fail_on="critical")))


def test_reports_are_collected_and_a_lost_one_is_an_error(spark, tmp_path):
    log = {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "CodeQL"}}, "results": [{"ruleId": "r", "message": {"text": "has tok-123456 in it"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a.py"}, "region": {"startLine": 1}}}]}]}]}
    (tmp_path / "a.sarif").write_text(json.dumps(log))
    (tmp_path / "bad.sarif").write_text("{")
    (tmp_path / "leaks.json").write_text(json.dumps([{"RuleID": "k", "File": "a.py", "StartLine": 1, "EndLine": 1, "StartColumn": 5, "EndColumn": 9, "Secret": "tok-123456", "Description": "d"}]))
    (tmp_path / "a.py").write_text("x = 1\n")
    got, said, secrets = reports.collected(spark, [("sarif", f"{tmp_path}/a.sarif"), ("mytool", f"{tmp_path}/a.sarif"), ("sarif", f"{tmp_path}/bad.sarif"), ("gitleaks", f"{tmp_path}/leaks.json"), ("sarif", f"{tmp_path}/gone.sarif")], root=str(tmp_path))
    assert sorted(r.rule_id for r in got.collect()) == ["codeql:r", "gitleaks:k", "mytool:r"]
    assert sorted((r.report.rpartition("/")[2], r.error) for r in said.collect()) == [("bad.sarif", True), ("gone.sarif", True)]
    assert [r.value for r in secrets.collect()] == ["tok-123456"]
    found = scan.scan(spark, str(tmp_path), imported=got, tool_secrets=secrets)[0].collect()
    assert len(found) == 3 and all("tok-123456" not in str(r) for r in found)  # a class that no tool shares is merged with none
    none = reports.collected(spark, [])
    assert [df.count() for df in none] == [0, 0, 0]


def test_merged_rows_keep_what_each_tool_says(spark):
    """Two tools and the scan on one sink: the own finding leads, evidence stays with its repetitions, the region covers all, suppressed only together."""
    schema = "vuln_class string, path string, rule_id string, cwe array<string>, severity string, confidence int, status string, suppression string, message string, note string, start_line int, start_column int, end_line int, end_column int, function string, sink string, sources array<string>, trace array<string>, via array<string>"
    own = [("sqli", "a.py", "HS-SQLI-001", ["CWE-89"], "high", 80, "suppressed", "taint:sanitized", "m", "n", 3, 5, 3, 20, None, "", ["siftstone"], ["step 2", "step 1"], [])]
    own += [("sqli", "b.py", "HS-SQLI-001", ["CWE-89"], "high", 80, "suppressed", s, "m", "", 3, c, 3, 20, "f", "x", ["siftstone"], [], []) for s, c in (("taint:sanitized", 5), ("inline:ignore", 6))]
    region = "struct<start_line:int,start_column:int,end_line:int,end_column:int>"
    other = [("a.py", "t:r2", "sqli", ["cwe-0564"], "low", 90, "t said", (3, 1, 3, 8), "t", "q(x)", "A.f"), ("a.py", "t:r1", "sqli", ["CWE-89"], "critical", 10, "t said", (3, 7, 4, None), "u", "q(y)", None)]
    imported = spark.createDataFrame(other, f"path string, rule_id string, vuln_class string, cwe array<string>, severity string, confidence int, message string, region {region}, source string, sink string, function string")
    rows = {r.path: r for r in scan.merged(spark.createDataFrame(own, schema), imported).collect()}
    a, b = rows["a.py"], rows["b.py"]
    assert (a.rule_id, a.related_rules, a.severity, a.confidence, a.status, a.suppression) == ("HS-SQLI-001", ["t:r1", "t:r2"], "critical", 90, "candidate", None)
    assert (a.start_line, a.start_column, a.end_line, a.end_column) == (3, 1, 4, None) and a.sources == ["siftstone", "t", "u"] and a.cwe == ["CWE-89", "CWE-564"]
    assert a.evidence == ["siftstone: n", "step 1", "step 2", "t: t said", "u: t said"] and (a.function, a.sink) == ("A.f", "q(y)")
    assert (b.status, b.suppression, b.evidence) == ("suppressed", "inline:ignore;taint:sanitized", ["siftstone: m", "siftstone: m"])


def test_linked_findings_tell_how_input_gets_there(spark, tmp_path):
    """A chain over nine files: the last steps of the way are told, the sink's value first; of seven inputs the first five."""
    for k in range(9):
        (tmp_path / f"m{k}.py").write_text(f"from m{k + 1} import f{k + 1}\n\n\ndef f{k}(x{k}):\n    return f{k + 1}(x{k})\n" if k < 8 else "def f8(x8):\n    eval(x8)\n")
    (tmp_path / "top.py").write_text("from m0 import f0\n\n\ndef main():\n    f0(input())\n")
    for k in range(6):
        (tmp_path / f"in{k}.py").write_text("import sys\nfrom m8 import f8\n\n\ndef main():\n    f8(sys.argv)\n")
    row = scan.scan(spark, str(tmp_path))[0].filter("path = 'm8.py'").first()
    assert row.status == "confirmed" and len(row.trace) == 5 and row.trace == sorted(row.trace) and all("reaches parameter `x8` of `f8` (m8.py)" in t for t in row.trace)
    assert row.via == ["parameter `x8` of `f8` (m8.py)"]  # the least origin comes straight
    for k in range(6):
        (tmp_path / f"in{k}.py").unlink()
    row = scan.scan(spark, str(tmp_path))[0].filter("path = 'm8.py'").first()
    assert row.via == [f"parameter `x{k}` of `f{k}` (m{k}.py)" for k in (8, 7, 6, 5, 4)] and len(row.trace) == 1 and "top.py: input" in row.trace[0]


def test_any_name_of_a_module_is_that_module_s_alone(spark, project):
    """A file that may set any name of its own stops the links of its own calls and functions, not those of others."""
    (project / "patch.py").write_text("globals()[str(1)] = 2\n")
    assert {r.path: r.status for r in scan.scan(spark, str(project))[0].collect()}["pkg/helper.py"] == "confirmed"
    helper = project / "pkg" / "helper.py"
    helper.write_text(helper.read_text() + "\n\nglobals()[str(1)] = 2\n")
    assert {r.path: r.status for r in scan.scan(spark, str(project))[0].collect()}["pkg/helper.py"] == "candidate"


@pytest.mark.parametrize("source", [
    "import os, shlex\nsetattr(shlex, 'quote', str)\nos.system('echo ' + shlex.quote(input()))\n",
    "import os, sys\nX = 'a'\nsetattr(sys.modules[__name__], 'X', input())\nos.system(X)\n",
    "import os, app\nX = 'a'\napp.X = input()\nos.system(X)\n",
    "import os, shlex\nvars(shlex)['quote'] = str\nos.system('echo ' + shlex.quote(input()))\n",
    "import os, sys\nX = 'a'\nsys.modules[__name__].__dict__[input()] = input()\nos.system(X)\n",
])
def test_what_a_file_replaces_is_not_trusted(source):
    assert [f["status"] for f in found(source)] != ["suppressed"] and len(found(source)) == 1


def test_library_functions_that_other_files_replace(spark, tmp_path):
    """A sanitizer and a modelled call count only while nothing scanned replaces them; where something does, the place is told."""
    (tmp_path / "run.py").write_text("import os, shlex\n\n\ndef a():\n    os.system('echo ' + shlex.quote(input()))\n")
    (tmp_path / "load.py").write_text("import json\n\n\ndef b():\n    eval(json.loads(input()))\n")
    (tmp_path / "via.py").write_text("import json\nfrom use import go\n\n\ndef c():\n    go(json.loads(input()))\n")
    (tmp_path / "use.py").write_text("def go(x):\n    eval(x)\n")
    status = lambda: {r.path: (r.status, r.note) for r in scan.scan(spark, str(tmp_path))[0].collect()}
    before = status()
    assert {p: s for p, (s, _) in before.items()} == {"run.py": "suppressed", "load.py": "confirmed", "use.py": "confirmed"}
    (tmp_path / "zz.py").write_text("import shlex, json\nshlex.quote = str\n")
    (tmp_path / "json.py").write_text("def loads(x):\n    return 'safe'\n")
    after = status()
    assert {p: s for p, (s, _) in after.items()} == {"run.py": "candidate", "load.py": "candidate", "use.py": "candidate"}
    assert "`shlex.quote`, which scanned code may replace (zz.py:2)" in after["run.py"][1] and "(json.py:1)" in after["load.py"][1] and "(json.py:1)" in after["use.py"][1]


def test_replacement_ways(spark):
    """Each way that a model may be hit, the order of the ways, and the earliest place."""
    from siftstone.operators import replacement

    files = spark.createDataFrame([("src/app.py", "src.app"), ("src/pkg/__init__.py", "src.pkg"), ("src/pkg/json.py", "src.pkg.json"), ("lib/yaml.py", "lib.yaml"), ("urllib.py", "urllib")], "path string, module string")
    e = lambda *rows: spark.createDataFrame([("z.py", 9, "attr", "nothing", "nothing"), *rows], replacement.ENTRY)

    def place(model, *rows):
        got = replacement.decided(spark.createDataFrame([(model,), (model,)], "model string"), e(*rows), files).collect()
        assert len(got) <= 1
        return got[0].place if got else None

    call = "json.loads@src/app.py@json"
    assert place(call) is None  # a namesake inside a package is no library
    assert place(call, ("b.py", 3, "attr", "json", "loads"), ("a.py", 8, "attr", "other", "loads"), ("a.py", 7, "attr", "x", "loads")) == "a.py:7"
    assert place(call, ("a.py", 1, "module", "json", "")) == "a.py:1" and place(call, ("a.py", 1, "module", "js", "")) is None
    assert place("os.path.join@src/app.py@os", ("a.py", 2, "module", "os", "")) == "a.py:2" and place("os.path.join@src/app.py@os", ("a.py", 2, "attr", "os", "path")) == "a.py:2"
    assert place(call, ("src/app.py", 5, "own", "", "")) == "src/app.py:5" and place(call, ("src/other.py", 5, "own", "", "")) is None
    assert place(call, ("a.py", 2, "module", "src.app", "")) == "a.py:2" and place(call, ("a.py", 2, "attr", "app", "json")) == "a.py:2" and place(call, ("a.py", 2, "attr", "app", "yaml")) is None
    assert place("yaml.load@src/app.py@yaml") == "lib/yaml.py:1" and place("urllib.parse.unquote@src/app.py@urllib", ("a.py", 1, "attr", "x", "unquote")) == "urllib.py:1"
    assert place("int@src/app.py@int", ("a.py", 4, "attr", "builtins", "int")) == "a.py:4" and place("int@src/app.py@int", ("a.py", 4, "module", "builtins", "")) == "a.py:4"
    assert place(call, ("src/app.py", 5, "own", "", ""), ("y.py", 6, "any", "", ""), ("x.py", 7, "any", "", "")) == "x.py:7"


def test_other_stores_keep_links(spark, project):
    (project / "patch.py").write_text("import pkg.helper\npkg.helper.other = print\nclass A:\n    pass\na = A()\na.run = 1\n")
    assert {r.path: r.status for r in scan.scan(spark, str(project))[0].collect()}["pkg/helper.py"] == "confirmed"


SARIF = {
    "version": "2.1.0",
    "runs": [
        {"tool": {"driver": {"name": "Semgrep OSS", "rules": [{"id": "r1", "properties": {"tags": ["CWE-89: SQL"], "security-severity": "7.5"}}]}}, "originalUriBaseIds": {"SRC": {"uri": "file:///p/"}}, "results": [
            {"ruleId": "r1", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a%20b.py", "uriBaseId": "SRC"}, "region": {"startLine": 3, "startColumn": 2}}}]},
            {"ruleId": "r1", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "../../out.py"}}}]},
            {"ruleId": "r2", "message": {"text": "no place"}},
        ]},
        {"tool": None, "results": "nothing"},
    ],
}


def test_sarif_import(spark):
    logs = spark.createDataFrame([(json.dumps(SARIF),), ("{}",), ("not json",)], "value string")
    rows, warnings = reports.sarif(logs, root="/p")
    r = rows.collect()
    assert [(x.path, x.rule_id, x.vuln_class, x.severity, x.confidence) for x in r] == [("a b.py", "semgrep:r1", "sqli", "high", 60)]
    assert (r[0].region.start_line, r[0].region.end_line, r[0].region.end_column) == (3, 3, 2)
    assert warnings.count() == 5


def test_leak_import(spark):
    item = {"Description": "token abcd", "StartLine": 2, "EndLine": 2, "StartColumn": 1, "EndColumn": 4, "Secret": "abcd", "File": "x.py", "RuleID": "tok"}
    rows, warnings = reports.leaks(spark.createDataFrame([(json.dumps([item, {"RuleID": "r"}]),), ("",)], "value string"), root="/p")
    (r,) = rows.collect()
    assert (r.path, r.message, r.region.end_column, r.sink) == ("x.py", "token <REDACTED>", 5, "gitleaks:tok@x.py@L2")
    assert warnings.count() == 1


def test_imports_merge_with_own(spark, project):
    log = {"runs": [{"tool": {"driver": {"name": "bandit", "rules": []}}, "results": [{"ruleId": "B605", "level": "error", "message": {"text": "m"}, "properties": {"issue_severity": "HIGH", "issue_confidence": "HIGH"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "safe.py"}, "region": {"startLine": 4}}}]}]}]}
    rows, _ = reports.sarif(spark.createDataFrame([(json.dumps(log),)], "value string"), root=str(project))
    findings, _ = scan.scan(spark, str(project), imported=rows)
    (r,) = findings.filter("path = 'safe.py'").collect()
    assert r.rule_id == "HS-CMDI-001" and r.sources == ["bandit", "siftstone"] and r.rules == ["HS-CMDI-001", "bandit:B605"] and r.confidence == 80


def test_config(tmp_path):
    (tmp_path / config.NAME).write_text("ignore: [a]\nfail_on: medium\n")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / config.NAME).write_text("ignore: [b]\nfail_on: low\n")
    c = config.load(str(tmp_path / "d"))
    assert c.ignore == ("a", "b") and c.fail_on == "low"
    for bad in ("nope: 1\n", "min_confidence: true\n", "fail_on: worst\n", "- a\n"):
        (tmp_path / "d" / config.NAME).write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load(str(tmp_path / "d"))


def test_user_rules_are_checked():
    class Taken(rules.Rule):
        rule_id, name, description = "HS-MINE-1", "n", "d"

    with pytest.raises(ValueError):
        rules.validated([Taken])


def test_streaming_counts(spark, sf):
    from siftstone.streaming import incremental

    batch = spark.read.parquet(f"{sf}/events.parquet")
    assert incremental.event_counts(batch).agg({"n": "sum"}).first()[0] == batch.count()
    seen = spark.createDataFrame([("a.py", "x")], "path string, sha256 string")
    files = spark.createDataFrame([("a.py", bytearray(b"1")), ("b.py", bytearray(b"2"))], "path string, content binary")
    assert incremental.changed_files(files, seen).count() == 2


def test_files_of_one_split_are_dealt_over_tasks(spark):
    """A table of many small files is one split by its bytes; its files are analysed by many tasks all the same."""
    from pyspark.sql import functions as F

    from siftstone.plans import scan

    files = spark.range(400).select(F.concat(F.lit("m"), "id", F.lit(".py")).alias("path"), F.encode(F.lit("import os\nos.system(input())\n"), "UTF-8").alias("content")).coalesce(1)
    rows = scan.analyzed(files).filter("kind = 'file'")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows.count() == 400
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > tasks // 2
