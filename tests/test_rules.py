import pytest

from tessera.functions import rule_table as T
from tessera.operators.rules import CHECKS, arguments, masked, scan, scan_table, secret_name, secret_value

FIRES = [
    ("<?php eval($x);", "RX-PHP-EVAL"), ("char b[8];\ngets(b);", "RX-C-GETS"), ('scanf("%s", b);}', "RX-C-SCANF-S"), ("void f() {\nsystem(cmd);\n}", "RX-C-SYSTEM"),
    ("char b[8];\nstrcpy(b, src);", "RX-C-STRCPY-FIXED"), ('char b[8];\nsprintf(b, "%s", src);', "RX-C-SPRINTF-FIXED"), ("char b[8];\nmemcpy(b, p, n);", "RX-C-MEMCPY-FIXED"),
    ('var a;\nel.innerHTML = "<b>" + q;', "RX-JS-INNERHTML"), ('try { stmt.executeQuery("SELECT a FROM t WHERE id=" + id); }', "RX-SQL-CONCAT"),
    ('{ spawn("sh", ["-c", cmd]); }', "RX-SHELL-DASH-C"), ('var db_password = "hunter2x9";', "RX-HARDCODED-SECRET"), ("char *p;\np = malloc(n);\nx = 1;\np->y = 2;", "RX-C-NULL-DEREF"), ("echo $_GET['a'];", "RX-PHP-ECHO-INPUT"),
    ('{ out.println(request.getParameter("x")); }', "RX-JSP-XSS"), ("new ObjectInputStream(in);", "RX-JAVA-OBJECTINPUTSTREAM"),
    ("eval(x)", "PY-EVAL"), ("e = eval\ne(x)", "PY-EVAL"), ("import os as o\no.system('ls ' + d)", "PY-OS-COMMAND"), ("import subprocess\nsubprocess.run(cmd, shell=True)", "PY-SUBPROCESS-SHELL"),
    ("import subprocess\nsubprocess.run(['/bin/sh', '-c', cmd])", "PY-SUBPROCESS-SHELL"), ("import pickle\npickle.loads(b)", "PY-PICKLE-LOAD"), ("import yaml as y\ny.load(d)", "PY-YAML-LOAD"),
    ("cur.execute('SELECT a FROM t WHERE id=' + x)", "PY-SQL-CONCAT"), ("cur.execute(f'SELECT a FROM t WHERE id={x}')", "PY-SQL-CONCAT"), ("cur.execute('DELETE FROM t WHERE a=%s' % x)", "PY-SQL-CONCAT"),
    ("q = 'SELECT a FROM t'\nq += ' WHERE id=' + x\ncur.execute(q)", "PY-SQL-CONCAT"), ("db.execute(text('SELECT a FROM t WHERE b={}'.format(x)))", "PY-SQL-CONCAT"),
    ("import requests\nrequests.get(u, verify=False)", "PY-TLS-VERIFY-OFF"), ("import ssl\nctx.verify_mode = ssl.CERT_NONE", "PY-TLS-VERIFY-OFF"), ("ctx.check_hostname = False", "PY-TLS-VERIFY-OFF"),
    ("import hashlib\ndef f(password):\n    return hashlib.new('md5', password)", "PY-WEAK-HASH"), ("import jwt\njwt.decode(t, options={'verify_signature': False})", "PY-JWT-NO-VERIFY"),
    ("Environment(autoescape=False)", "PY-JINJA-AUTOESCAPE"), ("render_template_string(x)", "PY-TEMPLATE-INJECTION"), ("mark_safe(x)", "PY-MARK-SAFE"), ("HttpResponse('<b>' + x)", "PY-HTML-CONCAT"),
    ("DB_PASSWORD = 'hunter2x9'", "PY-HARDCODED-SECRET"), ("connect(api_key='AKIA12345')", "PY-HARDCODED-SECRET"), ("d = {'secret_token': 'ab12cd34'}", "PY-HARDCODED-SECRET"), ("    cur.execute('SELECT a FROM t WHERE id=' + x)\n    y = 1", "PY-SQL-CONCAT"),
]
SILENT = [
    'system("ls");', "fgets(b, 8, f);", 'strcpy(b, "x");', 'char b[8];\nstrcpy(b, "x");', "char b[8];\nmemcpy(b, p, sizeof(b));", 'el.innerHTML = "<b>" + "static";', "var q;\nel.innerHTML = DOMPurify.sanitize(q);",
    "yaml.load(d, Loader=yaml.SafeLoader)", "mgr.take(idx, verify=False)", "cache_key = hashlib.md5(u)", "// gets(b);", "/* eval($x) */", 'password = "changeme"', 'token_header = "X-Access-Token"',
    "char *p;\np = malloc(n);\nif (!p) return;\np->y = 2;", "int system(const char *c);\nsystem(cmd);", "", "   \n", "\x00\x01", 'execute("SELECT a FROM t WHERE id=?", x)', "echo htmlspecialchars($_GET['a']);", "def eval(x): pass",
    "eval('1 + 2')", "X = '1'\neval(X)", "import pickle\npickle.loads(pickle.dumps(x))", "import subprocess\nsubprocess.run(['ls', d])", "cur.execute('SELECT a FROM t WHERE id=%s', (x,))", "Q = 'SELECT a FROM t'\ncur.execute(Q)",
    "import hashlib\ncache_key = hashlib.md5(password, usedforsecurity=False)", "mark_safe('<b>')", "HttpResponse('<b>' + escape(x))", '"""eval(x) el.innerHTML = q"""\nx = 1', "q = 'SELECT a FROM t' + x\nq = 'none'\ncur.execute(q)",
]


@pytest.mark.parametrize(("code", "rule"), FIRES)
def test_fires(code, rule):
    assert rule in {f["rule_id"] for f in scan(code)}


@pytest.mark.parametrize("code", SILENT)
def test_silent(code):
    assert scan(code) == []


def test_table_contract():
    assert len({r[0] for r in T.RULES}) == len(T.RULES) == 48 and {r[4] for r in T.RULES} == set(CHECKS) and all(0.5 <= r[2] <= 0.95 for r in T.RULES)


def test_masking_keeps_places():
    code = 'a = "http://x" // c\n`t // ${x}` # d\n"""\n# in\n""" /* e\nf */ g\n\'open // \n// z'
    got = masked(code)
    assert len(got) == len(code) and got.count("\n") == code.count("\n") and '"http://x"' in got and "// c" not in got and "`t // ${x}`" in got and "# in" in got and "f */" not in got and "'open //" in got and "z" not in got


def test_order_and_best():
    found = scan("x = 1\neval($y); gets(b);\n" + "k" * 200 + " gets(b)")
    assert [(f["line"], f["rule_id"]) for f in found] == [(2, "RX-PHP-EVAL"), (2, "RX-C-GETS"), (3, "RX-C-GETS")] and len(found[2]["evidence"]) == 160
    assert scan("gets(b);}", 0.95) == [] != scan("gets(b);}") and scan(None) == []


def test_helpers():
    assert arguments("a, f(b, c), \"x,y\", [1, 2]") == ["a", "f(b, c)", '"x,y"', "[1, 2]"] and arguments("") == [""]
    assert secret_name("DB_PASSWORD") and secret_name("apiKey") and not secret_name("password_field") and not secret_name("key")
    assert secret_value("AKIA1234567") and secret_value("correcthorsebatterystaple") and not secret_value("https://x.y/zz1") and not secret_value("aaaaaa1"[:6])


def test_long_tokens_end():
    import time

    t = time.time()
    scan("x = '" + "A" * 60_000 + "'")
    assert time.time() - t < 10


def test_table(spark):
    df = spark.createDataFrame([(1, "gets(b);}"), (2, None), (3, "ok"), (4, "{ eval(x);\ngets(b); }")], "doc_id long, code string")
    got = sorted((r.doc_id, r.line, r.rule_id) for r in scan_table(df, "doc_id", "code").collect())
    assert got == [(1, 1, "RX-C-GETS"), (4, 1, "RX-EVAL"), (4, 2, "RX-C-GETS")]


def test_evidence_of_a_built_query():
    found = scan("q = 'SELECT a FROM t WHERE id=' + x\ncur.execute(q)")
    assert [(f["line"], f["confidence"], f["evidence"]) for f in found] == [(2, 0.9, "q = 'SELECT a FROM t WHERE id=' + x -> cur.execute(q)")]


def test_column_function(spark):
    from tessera.operators.rules import findings_of

    df = spark.createDataFrame([(1, "gets(b);}"), (2, None), (3, "x")], "i int, code string")
    got = {r.i: [f.rule_id for f in r.f] for r in df.select("i", findings_of("code").alias("f")).collect()}
    assert got == {1: ["RX-C-GETS"], 2: [], 3: []}


def test_diff_table_function(spark):
    from tessera.operators.findings import DiffLines
    from tessera.plans.reviews import DIFFS

    spark.udtf.register("diff_lines", DiffLines)
    df = spark.createDataFrame(list(enumerate(d for d, _ in DIFFS)), "i int, diff string")
    df.createOrReplaceTempView("some_diffs")
    rows = spark.sql("SELECT i, t.* FROM some_diffs, LATERAL diff_lines(diff) t").collect()
    for i, (_, shown) in enumerate(DIFFS):
        assert [(r.line, r.text, r.is_added) for r in rows if r.i == i] == [x[1:] for x in shown]
