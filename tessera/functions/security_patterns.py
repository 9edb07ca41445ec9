"""Patterns of the security features."""

# These patterns define the features, and are stated as they are,
# in the features' order. `(?i)`, `(?s)` and `(?m)` stand where a pattern
# ignores case, lets the dot match line feeds, or anchors at lines.
UNSAFE_STRING_CALL = r"\b(?:strcpy|strcat|sprintf|vsprintf|gets|stpcpy|wcscpy|wcscat|lstrcpy|StrCpy|StrCat|scanf)\s*\("
SAFE_STRING_CALL = r"\b(?:strncpy|strncat|snprintf|vsnprintf|_snprintf|strlcpy|strlcat|strnlen|fgets|strncmp|g_strlcpy)\s*\("
MEMORY_COPY = r"\b(?:memcpy|memmove|memset|bcopy|bzero|wmemcpy|CopyMemory|RtlCopyMemory|__builtin_memcpy)\s*\("
STACK_ALLOCATION = r"\b(?:alloca|_alloca|_malloca)\s*\("
ALLOCATION = r"\b(?:malloc|calloc|realloc|kmalloc|kzalloc|vmalloc|xmalloc|g_malloc|g_new0?|HeapAlloc)\s*\(|\bnew\s+[A-Za-z_]\w*\s*[\(\[]"
RELEASE = r"\b(?:free|kfree|vfree|g_free|xfree|HeapFree)\s*\(|\bdelete\s*(?:\[\s*\])?\s*[A-Za-z_]"
SIZEOF = r"\bsizeof\s*[\(\w]"
ARROW = r"->"
DEREFERENCE = r"\*\s*\("
NULL_LITERAL = r"\b(?:NULL|nullptr|Py_None)\b"
NULL_CHECK = r"(?:[!=]=\s*(?:NULL|nullptr|0)\b)|(?:\b(?:NULL|nullptr)\s*[!=]=)|(?:\bif\s*\(\s*!\s*[A-Za-z_])|(?:\b(?:IS_ERR|IS_ERR_OR_NULL|unlikely|likely)\s*\(\s*!)|(?:\bis\s+(?:not\s+)?None\b)"
INDEX_ARITHMETIC = r"\[[^\]\n]*[+\-][^\]\n]*\]"
LOOP_UP_TO = r"\b(?:for|while)\b[^\n]{0,120}<="
FORMAT_NOT_LITERAL = r'''\b(?:printf|vprintf|syslog|vsyslog)\s*\(\s*(?![\"'L)])|\b(?:fprintf|vfprintf|sprintf|asprintf)\s*\([^,()\n]{0,60},\s*(?![\"'L])|\b(?:snprintf|vsnprintf)\s*\([^,()\n]{0,60},[^,()\n]{0,60},\s*(?![\"'L])'''
FORMAT_WRITES = r"%[0-9.*\-+ #]*n(?![A-Za-z0-9_])"
EVALUATION = r'''\b(?:eval|exec|execfile)\s*\(|\bnew\s+Function\s*\(|\b(?:instance_eval|class_eval|module_eval|create_function)\b|\bsetTimeout\s*\(\s*[\"']|\bexecScript\s*\('''
OS_COMMAND = r"\bos\.(?:system|popen|spawn\w*|exec\w*)\s*\(|\bsubprocess\.(?:call|run|Popen|check_output|check_call|getoutput)\s*\(|\b(?:popen|_popen|system|shell_exec|passthru|proc_open|pcntl_exec)\s*\(|\bexec[lv][pe]{0,2}\s*\(|Runtime\.getRuntime\s*\(\s*\)\s*\.\s*exec\s*\(|\bProcessBuilder\s*\(|\bchild_process\b|\bexecSync\s*\(|\bspawnSync\s*\("
SHELL_TRUE = r'''shell\s*=\s*True|shell\s*:\s*true|[\"']/bin/(?:sh|bash)[\"']\s*,\s*[\"']-c[\"']'''
SQL_STATEMENT = r"(?i)\bSELECT\b[^\n;]{0,200}?\bFROM\b|\bINSERT\s+INTO\b|\bUPDATE\b[^\n;]{0,200}?\bSET\b|\bDELETE\s+FROM\b|\bDROP\s+TABLE\b|\bUNION\b(?:\s+ALL)?\s+\bSELECT\b"
DYNAMIC_STRING = r'''[\"']\s*\+|\+\s*[\"']|\.\s*format\s*\(|\bf[\"']|[\"']\s*%\s*[\(\w]|\$\{|[\"']\s*\.\s*\$|`[^`\n]{0,200}\$\{|\.\s*(?:append|concat)\s*\(\s*[\"']?'''
SQL_PARAMETERS = r'''\b(?:execute|executemany|query|prepare|prepareStatement|createQuery)\s*\([^;\n]{0,200},|\b(?:PreparedStatement|bindParam|bindValue|setString|setInt|setLong)\b|Parameters\.Add\w*\s*\(|[\"'][^\"'\n]{0,200}\?[^\"'\n]{0,200}[\"']\s*,'''
UNSAFE_DESERIALISATION = r"\b(?:pickle|cPickle|_pickle|dill|cloudpickle)\.(?:loads?|Unpickler)\s*\(|\bmarshal\.loads?\s*\(|\btorch\.load\s*\(|\bObjectInputStream\b|\breadObject\s*\(|\bXMLDecoder\b|\bunserialize\s*\(|\bBinaryFormatter\b|\bNetDataContractSerializer\b|\bTypeNameHandling\b|\bjsonpickle\b|\bYAML\.(?:load|unsafe_load)\b|\bMarshal\.load\s*\("
YAML_LOAD = r"\byaml\.(?:load|unsafe_load|full_load)\s*\("
SAFE_LOADER = r"(?i)SafeLoader|CSafeLoader|BaseLoader"
SAFE_DESERIALISATION = r"\byaml\.safe_load\s*\(|SafeLoader|\bjson\.loads?\s*\(|\bJSON\.parse\s*\(|\bhmac\.compare_digest\s*\(|\bDataContractJsonSerializer\b"
XSS_SINK = r"\.innerHTML\s*[+]?=|\.outerHTML\s*[+]?=|document\.write(?:ln)?\s*\(|insertAdjacentHTML\s*\(|dangerouslySetInnerHTML|\.\s*html\s*\(\s*[A-Za-z_$]|\bv-html\b|\bng-bind-html\b|\brender_template_string\s*\(|\bmark_safe\s*\(|\|\s*safe\b|\bHtml\.Raw\s*\(|\becho\s+[^;\n]{0,80}\$|\bResponse\.Write\s*\(|autoescape\s*=\s*False"
XSS_ESCAPE = r"(?i)\bhtmlspecialchars\s*\(|\bhtmlentities\s*\(|\bescapeHtml\b|\bescape_html\b|\bDOMPurify\b|\bsanitiz\w*\s*\(|\bencodeURIComponent\s*\(|\bhtml\.escape\s*\(|\bcgi\.escape\s*\(|\bbleach\.clean\s*\(|\bstrip_tags\s*\(|\bHtmlEncode\s*\(|\bAntiXss\b"
TAINT_SOURCE = r"\$_(?:GET|POST|REQUEST|COOKIE|SERVER|FILES|ENV)\b|\brequest\.(?:args|form|GET|POST|values|params|data|json|body|query|cookies|headers)\b|\breq\.(?:query|body|params|headers|cookies)\b|\bgetParameter\s*\(|\bgetHeader\s*\(|\bgetQueryString\s*\(|\bsys\.argv\b|\bprocess\.argv\b|\bargv\s*\[|\binput\s*\(|\braw_input\s*\(|\breadLine\s*\(|\bConsole\.ReadLine\s*\(|\bgetenv\s*\(|\bos\.environ\b|\bscanf\s*\(|\brecv(?:from)?\s*\(|\bRequest\.(?:QueryString|Form|Params)\b"
PARENT_PATH = r"\.\.[\\/]"
CONDITION = r"\b(?:if|while|elif|assert|require)\b"
COMPARISON = r"[<>]=?|==|!="
SIZE_TOKEN = r"\b(?:len|strlen|wcslen|sizeof|size|length|count|capacity|nmemb|bufsize|buflen|remaining)\b|\.length\b|\.size\s*\(\s*\)|\b(?:MAX|MIN|LIMIT|LEN|SIZE)_?[A-Z0-9_]*\b"
TRY_CATCH = r"\b(?:try|catch|except|finally|rescue)\b"
REGEX_VALIDATION = r"\bre\.(?:match|fullmatch|search|compile)\s*\(|\bpreg_match\s*\(|\.matches\s*\(|Pattern\.compile\s*\(|\bnew\s+Regex\s*\(|\bRegex\.IsMatch\s*\(|\bstartsWith\s*\(|\bendswith\s*\("
UNCHECKED_PARSE = r"\b(?:atoi|atol|atoll|atof|strtoul?|strtoll?)\s*\(|\bparseInt\s*\(|\bparseFloat\s*\(|\bInteger\.parse\w+\s*\(|\b(?:int|float)\s*\(\s*[A-Za-z_]|\bConvert\.To\w+\s*\("
WEAK_HASH = r"(?i)\b(?:md5|md4|md2|sha1|sha-1)\b"
WEAK_CIPHER = r"\b(?:DES|3DES|TripleDES|RC2|RC4|ARCFOUR|Blowfish|ECB)\b"
STRONG_CRYPTO = r"(?i)\b(?:sha256|sha384|sha512|sha3|blake2\w*|bcrypt|scrypt|argon2|pbkdf2\w*|hmac|AES|GCM|ChaCha20|Ed25519|X25519)\b"
TLS_OFF = r"verify\s*=\s*False|CERT_NONE|_create_unverified_context|InsecureSkipVerify\s*:\s*true|rejectUnauthorized\s*:\s*false|SSL_VERIFY_NONE|ALLOW_ALL_HOSTNAME_VERIFIER|TrustAllCerts|setHostnameVerifier\s*\(|ServerCertificateValidationCallback|CURLOPT_SSL_VERIFY\w*\s*,\s*(?:0|false|FALSE)"
HARDCODED_SECRET = r'''(?i)\b(?:pass(?:wo?rd)?|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|credential\w*|auth[_-]?token|bearer|salt|encryption[_-]?key)\b\s*(?:=|:|=>|:=)\s*[\"'][^\"'\n]{4,}[\"']'''
STRING_LITERAL = r"""\"([^\"\\\n]{12,})\"|'([^'\\\n]{12,})'"""
WEAK_RANDOM = r"\brandom\.(?:random|randint|randrange|choice|seed|shuffle|sample)\s*\(|\bMath\.random\s*\(|\brand\s*\(\s*\)|\bsrand\s*\(|\bmt_rand\s*\(|\bnew\s+Random\s*\("
INFORMATION_LEAK = r"\bprintStackTrace\s*\(|\btraceback\.(?:print_exc|format_exc)\s*\(|\.getMessage\s*\(\s*\)|\bconsole\.(?:log|debug|error|warn)\s*\(|\bSystem\.(?:out|err)\.print\w*\s*\(|\bvar_dump\s*\(|\bprint_r\s*\(|\bphpinfo\s*\(|\b(?:debug|DEBUG)\s*=\s*(?:True|true|1)\b|\bdisplay_errors\b"
COMMENT = r'(?sm)//[^\n]*|/\*.*?\*/|^[ \t]*#(?!\s*(?:include|define|ifdef|ifndef|endif|pragma|if\b|else|elif|undef|error|import))[^\n]*|\"\"\".*?\"\"\"'
SYNTAX_C = r"#include\b|#define\b|->|::|\b(?:struct|unsigned|size_t|uint\d+_t|const\s+char|void\s*\*)\b"
SYNTAX_SCRIPT = r"\bdef\s+\w+\s*\(|\bself\b|\belif\b|\bimport\s+\w|\bfrom\s+\w+\s+import\b|<\?php|\$\w+\s*=|\bfunction\s*\(|=>|\b(?:var|let|const)\s+\w+\s*=|\becho\b|\brequire\s*\("
SYNTAX_JVM = r"\b(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\]]+\s+\w+\s*\(|\bSystem\.|\busing\s+System\b|\bnamespace\s+\w|\bpackage\s+[\w.]+;|\bnew\s+[A-Z]\w*\s*\("
