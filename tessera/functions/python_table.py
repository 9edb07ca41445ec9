"""Fixed vocabularies of the Python syntax rules."""

# They define what the rules find.
EVAL = frozenset({"eval", "exec", "builtins.eval", "builtins.exec"})
SHELL_CALLS = frozenset({"os.system", "os.popen", "subprocess.getoutput", "subprocess.getstatusoutput", "commands.getoutput", "commands.getstatusoutput"})
SUBPROCESS_CALLS = frozenset({"subprocess.run", "subprocess.call", "subprocess.Popen", "subprocess.check_output", "subprocess.check_call"})
PICKLES = frozenset({"pickle", "cPickle", "_pickle", "dill", "cloudpickle", "marshal"})
OTHER_UNPICKLERS = frozenset({"jsonpickle.decode", "shelve.open"})
SAFE_LOADERS = frozenset({"SafeLoader", "CSafeLoader", "BaseLoader", "CBaseLoader"})
UNSAFE_YAML = frozenset({"yaml.unsafe_load", "yaml.full_load", "ruamel.yaml.unsafe_load"})
YAML_LOAD = frozenset({"yaml.load", "ruamel.yaml.load"})
SHELLS = frozenset({"sh", "bash", "zsh", "ksh", "dash", "csh", "tcsh", "cmd", "cmd.exe", "powershell", "powershell.exe", "pwsh"})
SHELL_FLAGS = frozenset({"-c", "/c", "/C", "-Command", "-command"})
MARKUP = ("markupsafe", "jinja2", "flask", "django.utils.safestring", "webhelpers.html")
WEAK_HASHES = frozenset({"md5", "sha1", "md4", "sha"})
ESCAPES = frozenset({"escape", "escape_html", "conditional_escape", "clean", "sanitize", "bleach", "quote", "quoteattr", "striptags"})
SQL_SINKS = frozenset({"execute", "executemany", "executescript", "execute_sql", "executequery", "executeupdate", "exec_driver_sql", "raw", "query", "read_sql", "read_sql_query", "execute_string"})
HTML_SINKS = frozenset({"httpresponse", "htmlresponse", "make_response", "response"})
HTTP_VERBS = frozenset({"get", "post", "put", "delete", "patch", "head", "options", "request", "session", "client", "asyncclient"})
HTTP_MODULES = frozenset({"requests", "httpx", "aiohttp", "urllib3"})
UNVERIFIED = frozenset({"ssl._create_unverified_context", "ssl._https_verify_certificates"})
HTML_TAG = r"(?i)<\s*(?:script|iframe|img|svg|div|span|p|h[1-6]|a|body|table|tr|td|li|ul|ol|input|form|button|br|b|i|strong|em|pre|code)\b|</\s*[a-z][a-z0-9]*\s*>"
PYTHON_HINT = r"(?m)^\s*(?:def|class|import|from|elif|except|async\s+def|@)\b|\bself\s*\.|\bNone\b|\bTrue\b|\bFalse\b|:\s*$"
OTHER_HINT = r"(?m)^\s*#include\b|\{\s*$|^\s*\}|;\s*$|\bfunction\b|\bvar\s|\blet\s|\bconst\s|\bpublic\s|\bnew\s+\w+\s*\(|\$\w|#\{|=>|::|<%|\bend\s*$"
MAX_PARSE_CHARS, MAX_DEPTH = 2_000_000, 12
