"""The rules: for each a language, what marks a sink, what marks data from outside near it, and what makes it safe.

Patterns are of the kind that Java's and RE2's regular expressions read alike. Written from common knowledge of
the APIs and of the weakness classes.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    rule_id: str
    language: str
    sink: str
    source: str
    safe: str
    kind: str
    level: str
    cwe: str
    within: int = 50


_INPUT = {
    "java": r"getParameter|getHeader|getQueryString|getCookies|getInputStream|readLine|@RequestParam|@PathVariable|request\.",
    "c": r"argv|getenv|scanf|fgets|recv|fread|getchar|read\(",
    "cpp": r"argv|getenv|std::cin|getline|recv|scanf|fgets",
    "python": r"request\.|input\(|sys\.argv|os\.environ|\.GET|\.POST|stdin",
    "javascript": r"req\.|request\.|location\.|document\.cookie|process\.argv|window\.name",
    "php": r"\$_GET|\$_POST|\$_REQUEST|\$_COOKIE|\$_SERVER|\$_FILES|php://input",
}

#: family -> (kind, level, weakness, {language: (sink, safe)})
_FAMILIES: dict[str, tuple[str, str, str, dict[str, tuple[str, str]]]] = {
    "command": ("命令注入", "high", "CWE-78", {
        "java": (r"Runtime\.getRuntime\(\)\.exec\(|new ProcessBuilder\(", r"Pattern\.matches|allowList|whitelist"),
        "c": (r"\b(?:system|popen|execl|execlp|execle|execv|execvp)\s*\(", r"isalnum|strpbrk"),
        "cpp": (r"\b(?:system|popen|execl|execlp|execv|execvp)\s*\(", r"isalnum|find_first_of"),
        "python": (r"os\.system\(|os\.popen\(|subprocess\.\w+\(|\beval\(|\bexec\(", r"shlex\.quote|shell=False"),
        "javascript": (r"\b(?:exec|execSync|spawn|spawnSync)\(|\beval\(|new Function\(", r"escapeShell|shell-quote"),
        "php": (r"\b(?:exec|system|passthru|shell_exec|popen|proc_open|eval|assert)\s*\(", r"escapeshellarg|escapeshellcmd"),
    }),
    "sql": ("SQL注入", "high", "CWE-89", {
        "java": (r"(?i)(?:select|insert|update|delete)\b.*\"\s*\+|createQuery\(.*\+|\.executeQuery\(.*\+", r"PreparedStatement|setString|setInt"),
        "c": (r"\b(?:sqlite3_exec|mysql_query|mysql_real_query|PQexec)\s*\(", r"_prepare|_bind_|PQexecParams"),
        "cpp": (r"\b(?:sqlite3_exec|mysql_query|mysql_real_query|PQexec|executeQuery)\s*\(", r"_prepare|_bind_|prepareStatement"),
        "python": (r"\.execute\(\s*f[\"']|\.execute\(.*(?:%|\+|\.format\()|\.raw\(", r"\.execute\([^%+]*,\s*[\(\[]"),
        "javascript": (r"(?i)\.(?:query|execute|raw)\(.*(?:\+|\$\{)", r"escape\(|\?\s*,\s*\["),
        "php": (r"(?i)mysqli_query\(.*\.|->query\(.*\.|mysql_query\(.*\.", r"prepare\(|bind_param|real_escape_string"),
    }),
    "path": ("路径遍历", "high", "CWE-22", {
        "java": (r"new File(?:InputStream|OutputStream|Reader|Writer)?\(|Paths\.get\(", r"getCanonicalPath|normalize\(\)"),
        "c": (r"\b(?:fopen|open|creat|freopen|remove|unlink)\s*\(", r"realpath|strncmp|O_NOFOLLOW"),
        "cpp": (r"\b(?:fopen|open|ifstream|ofstream|remove)\s*\(", r"realpath|canonical|weakly_canonical"),
        "python": (r"\bopen\(|os\.path\.join\(|send_file\(", r"realpath|abspath|secure_filename"),
        "javascript": (r"fs\.\w+\(|sendFile\(|path\.join\(", r"path\.resolve|path\.normalize"),
        "php": (r"\b(?:fopen|readfile|file_get_contents|include|require|unlink)\s*\(", r"realpath|basename"),
    }),
    "xss": ("反射型XSS", "medium", "CWE-79", {
        "java": (r"getWriter\(\)\.(?:print|write)|out\.print", r"escapeHtml|encodeForHTML"),
        "cpp": (r"std::cout\s*<<.*<", r"escape"),
        "python": (r"render_template_string\(|Markup\(|HttpResponse\(", r"escape\("),
        "javascript": (r"innerHTML|document\.write\(|res\.send\(|outerHTML", r"textContent|DOMPurify|escape"),
        "php": (r"\becho\b|\bprint\b", r"htmlspecialchars|htmlentities|strip_tags"),
    }),
    "ssrf": ("SSRF服务端请求伪造", "high", "CWE-918", {
        "java": (r"new URL\(|HttpClient|openConnection\(|RestTemplate", r"allowedHosts|InetAddress"),
        "c": (r"curl_easy_setopt\s*\(.*CURLOPT_URL", r"allowed_host"),
        "cpp": (r"curl_easy_setopt\s*\(.*CURLOPT_URL", r"allowed_host"),
        "python": (r"requests\.\w+\(|urlopen\(|httpx\.\w+\(", r"allowed_hosts|urlparse"),
        "javascript": (r"\b(?:axios|fetch|request|got)\b[.(]", r"allowedHosts|new URL\("),
        "php": (r"curl_setopt\(.*CURLOPT_URL|curl_init\(|file_get_contents\(\s*\$", r"filter_var|parse_url"),
    }),
    "redirect": ("开放重定向", "medium", "CWE-601", {
        "java": (r"sendRedirect\(|\"redirect:", r"startsWith\(\"/|allowedUrls"),
        "python": (r"\bredirect\(|HttpResponseRedirect\(", r"is_safe_url|url_has_allowed_host"),
        "javascript": (r"res\.redirect\(|location\.(?:href|assign|replace)", r"startsWith\('/|allowedHosts"),
        "php": (r"(?i)header\(.*location", r"parse_url|in_array"),
    }),
    "header": ("HTTP响应拆分", "medium", "CWE-113", {
        "java": (r"\.(?:setHeader|addHeader)\(", r"replaceAll\(|encode\("),
        "javascript": (r"res\.(?:setHeader|header|set)\(", r"encodeURIComponent"),
        "php": (r"\bheader\(", r"urlencode|str_replace"),
        "python": (r"\.headers\[.*\]\s*=", r"quote\("),
    }),
    "log": ("日志伪造", "low", "CWE-117", {
        "java": (r"\b(?:log|logger|LOG)\.(?:info|warn|error|debug)\(", r"replaceAll\(|encode"),
        "c": (r"\bsyslog\s*\(|fprintf\s*\(\s*log", r"sanitize"),
        "cpp": (r"\bsyslog\s*\(|LOG\(", r"sanitize"),
        "python": (r"\b(?:logging|logger|log)\.(?:info|warning|error|debug)\(", r"replace\("),
        "javascript": (r"console\.(?:log|error|warn)\(|logger\.\w+\(", r"JSON\.stringify|replace\("),
        "php": (r"\berror_log\(", r"str_replace|addslashes"),
    }),
    "deserialization": ("不安全的反序列化", "high", "CWE-502", {
        "java": (r"readObject\(|XMLDecoder|parseObject\(|fromXML\(", r"ObjectInputFilter|setAutoTypeSupport\(false"),
        "python": (r"pickle\.loads?\(|yaml\.load\(|marshal\.loads?\(", r"SafeLoader|safe_load"),
        "javascript": (r"unserialize\(|node-serialize", r"JSON\.parse"),
        "php": (r"\bunserialize\(", r"allowed_classes"),
    }),
    "xml": ("XML外部实体注入", "high", "CWE-611", {
        "java": (r"DocumentBuilderFactory|SAXParserFactory|XMLInputFactory|SAXReader", r"disallow-doctype-decl|FEATURE_SECURE_PROCESSING|SUPPORT_DTD"),
        "c": (r"xmlReadFile|xmlParseFile|xmlReadMemory", r"XML_PARSE_NONET"),
        "cpp": (r"xmlReadFile|xmlParseFile|XercesDOMParser", r"XML_PARSE_NONET|setDisableDefaultEntityResolution"),
        "python": (r"etree\.(?:parse|fromstring)\(|minidom\.parse", r"defusedxml|resolve_entities=False"),
        "javascript": (r"libxmljs|parseXml\(", r"noent:\s*false"),
        "php": (r"simplexml_load_\w+\(|loadXML\(", r"libxml_disable_entity_loader|LIBXML_NONET"),
    }),
    "template": ("SSTI模板注入", "high", "CWE-1336", {
        "java": (r"VelocityEngine|Template\(|SpelExpressionParser|parseExpression\(", r"SimpleEvaluationContext"),
        "python": (r"render_template_string\(|Template\(|from_string\(", r"SandboxedEnvironment"),
        "javascript": (r"ejs\.render\(|pug\.compile\(|_\.template\(|Handlebars\.compile\(", r"escape"),
        "php": (r"createTemplate\(|->render\(\s*\$", r"SandboxExtension"),
    }),
    "format": ("格式化字符串", "high", "CWE-134", {
        "c": (r"\b(?:printf|fprintf|sprintf|snprintf|syslog)\s*\(\s*(?:[a-z_]+\s*,\s*)?[a-z_]+\s*\)", r"\"%s\""),
        "cpp": (r"\b(?:printf|fprintf|sprintf|snprintf|syslog)\s*\(\s*(?:[a-z_]+\s*,\s*)?[a-z_]+\s*\)", r"\"%s\""),
    }),
    "memory": ("缓冲区溢出", "high", "CWE-120", {
        "c": (r"\b(?:strcpy|strcat|gets|sprintf|vsprintf)\s*\(", r"strlcpy|snprintf"),
        "cpp": (r"\b(?:strcpy|strcat|gets|sprintf|vsprintf)\s*\(", r"strlcpy|snprintf"),
    }),
    "dos": ("拒绝服务", "medium", "CWE-400", {
        "java": (r"while\s*\(\s*true\s*\)|Thread\.sleep\(\s*[a-z]", r"break;|timeout"),
        "c": (r"while\s*\(\s*1\s*\)|for\s*\(\s*;\s*;\s*\)|\bmalloc\s*\(\s*[a-z]", r"break;|MAX_"),
        "cpp": (r"while\s*\(\s*true\s*\)|for\s*\(\s*;\s*;\s*\)|\bnew\s+\w+\[\s*[a-z]", r"break;|MAX_"),
        "python": (r"while True:|range\(\s*int\(", r"break|timeout"),
        "javascript": (r"while\s*\(\s*true\s*\)|for\s*\(\s*;\s*;\s*\)|new RegExp\(", r"break;|timeout"),
        "php": (r"while\s*\(\s*(?:true|1)\s*\)|\brange\s*\(", r"break;|set_time_limit"),
    }),
    "mail": ("邮件头注入", "medium", "CWE-93", {
        "python": (r"sendmail\(|EmailMessage\(|\.send_message\(", r"parseaddr|splitlines"),
        "php": (r"\bmail\(", r"FILTER_VALIDATE_EMAIL|str_replace"),
        "java": (r"Transport\.send\(|setRecipients?\(", r"InternetAddress\.parse"),
        "javascript": (r"sendMail\(", r"validator\.isEmail"),
    }),
    "code": ("动态代码注入", "high", "CWE-94", {
        "java": (r"ScriptEngine|GroovyShell|\.eval\(", r"allowList|Pattern\.matches"),
        "c": (r"\bdlopen\s*\(|\bdlsym\s*\(", r"realpath|strncmp"),
        "cpp": (r"\bdlopen\s*\(|LoadLibrary\w*\s*\(", r"realpath|canonical"),
        "python": (r"\bexec\(|\bcompile\(|__import__\(|importlib\.import_module\(", r"literal_eval|allow_list"),
        "javascript": (r"\beval\(|new Function\(|vm\.runIn\w+\(|setTimeout\(\s*['\"]", r"JSON\.parse|allowList"),
        "php": (r"\beval\s*\(|create_function\s*\(|\bassert\s*\(", r"in_array|ctype_alnum"),
    }),
    "spring": ("Spring表达式注入", "high", "CWE-94", {
        "java": (r"StandardEvaluationContext|parseExpression\(|@Value\(\"#\{", r"SimpleEvaluationContext|forReadOnlyDataBinding"),
    }),
    "resource": ("资源注入", "medium", "CWE-99", {
        "java": (r"new (?:Server)?Socket\(|InetSocketAddress\(", r"allowedPorts|allowedHosts"),
        "c": (r"\bconnect\s*\(|\bbind\s*\(", r"allowed_port|inet_pton"),
        "cpp": (r"\bconnect\s*\(|\bbind\s*\(", r"allowed_port|inet_pton"),
        "python": (r"\.connect\(\s*\(|create_connection\(", r"allowed_hosts|ip_address\("),
        "javascript": (r"net\.(?:connect|createConnection)\(", r"allowedHosts|net\.isIP"),
        "php": (r"\bfsockopen\s*\(|stream_socket_client\s*\(", r"in_array|filter_var"),
    }),
    "expansion": ("XML实体扩展注入", "medium", "CWE-776", {
        "java": (r"DocumentBuilderFactory|SAXParserFactory|XMLReaderFactory", r"setExpandEntityReferences\(false|disallow-doctype-decl"),
        "c": (r"XML_PARSE_HUGE|XML_PARSE_NOENT", r"xmlCtxtSetMaxAmplification|XML_PARSE_NONET"),
        "cpp": (r"XML_PARSE_HUGE|XML_PARSE_NOENT|setEntityExpansionLimit\(\s*0", r"XML_PARSE_NONET|setEntityExpansionLimit\(\s*[1-9]"),
        "javascript": (r"noent:\s*true|huge:\s*true", r"huge:\s*false|noent:\s*false"),
        "python": (r"huge_tree\s*=\s*True|xml\.sax\.", r"defusedxml|huge_tree\s*=\s*False"),
        "php": (r"LIBXML_NOENT|LIBXML_PARSEHUGE", r"LIBXML_NONET"),
    }),
    "json_object": ("不安全的JSON反序列化", "high", "CWE-502", {
        "java": (r"JSON\.parse(?:Object)?\(|enableDefaultTyping\(|\.readValue\(", r"setSafeMode\(true|PolymorphicTypeValidator"),
        "python": (r"jsonpickle\.decode\(", r"safe=True"),
        "javascript": (r"Object\.assign\(.*JSON\.parse|_\.merge\(.*JSON\.parse", r"Object\.create\(null|schema\.validate"),
        "php": (r"json_decode\(", r"JSON_THROW_ON_ERROR|json_last_error"),
        "cpp": (r"json::parse\(|Json::Reader", r"accept\(|schema"),
        "c": (r"cJSON_Parse\s*\(|json_tokener_parse\s*\(", r"cJSON_IsObject|json_object_is_type"),
    }),
    "json": ("JSON注入", "medium", "CWE-91", {
        "java": (r"\"\{\\\"\w+\\\"\s*:[^+]*\"\s*\+", r"JSONObject\(|ObjectMapper"),
        "python": (r"['\"]\{\\?\"\w+\\?\"\s*:[^'%+]*['\"]\s*(?:%|\+)", r"json\.dumps"),
        "javascript": (r"['\"`]\{\\?\"\w+\\?\"\s*:[^'`+$]*(?:['\"]\s*\+|\$\{)", r"JSON\.stringify"),
        "php": (r"['\"]\{\\?\"\w+\\?\"\s*:[^'.]*['\"]\s*\.", r"json_encode"),
        "c": (r"printf\s*\(.*\{\\\"\w+\\\"\s*:[^,]*%s", r"cJSON_Create|json_object_new"),
        "cpp": (r"\"\{\\\"\w+\\\"\s*:[^+<]*\"\s*(?:\+|<<)", r"json::object|dump\("),
    }),
    "setting": ("设置篡改", "medium", "CWE-15", {
        "java": (r"System\.setProperty\(|\.setCatalog\(", r"allowedKeys|allowList"),
        "c": (r"\b(?:setenv|putenv|sethostid)\s*\(", r"allowed_key|strcmp"),
        "cpp": (r"\b(?:setenv|putenv)\s*\(|SetEnvironmentVariable", r"allowed_key|allowedKeys"),
        "python": (r"os\.environ\[.*\]\s*=|os\.putenv\(|setattr\(\s*settings", r"allowed_keys|allow_list"),
        "javascript": (r"process\.env(?:\.\w+|\[.*\])\s*=[^=]|app\.set\(", r"allowedKeys"),
        "php": (r"\bini_set\s*\(|\bputenv\s*\(", r"in_array"),
    }),
    "ldap": ("LDAP注入", "high", "CWE-90", {
        "java": (r"(?:ctx|context|ldapTemplate)\.search\(|DirContext", r"encodeForLDAP|LdapEncoder"),
        "python": (r"\.search_s\(|\.search_ext\(", r"escape_filter_chars"),
        "php": (r"\bldap_(?:search|list|read)\s*\(", r"ldap_escape"),
        "javascript": (r"ldapClient\.search\(|client\.search\(", r"ldap-escape|EqualityFilter"),
    }),
    "xpath": ("XPath注入", "high", "CWE-643", {
        "java": (r"[xX][pP]ath\.(?:evaluate|compile)\(|selectNodes\(", r"setXPathVariableResolver"),
        "python": (r"\.xpath\(|\.findall\(.*\+", r"XPathEvaluator|variables="),
        "php": (r"->xpath\(|DOMXPath", r"htmlspecialchars|addslashes"),
        "javascript": (r"xpath\.(?:select|parse|evaluate)\(", r"variables:"),
    }),
    "xquery": ("XQuery注入", "high", "CWE-652", {"java": (r"XQ(?:Prepared)?Expression|xqc?\.executeQuery\(", r"bindString\(|bindItem\(")}),
    "ognl": ("OGNL表达式注入", "high", "CWE-917", {"java": (r"Ognl\.(?:getValue|setValue|parseExpression)\(|OgnlUtil", r"SecurityMemberAccess|excludedClasses")}),
    "nosql": ("NoSQL注入", "high", "CWE-943", {
        "java": (r"new BasicDBObject\(|BasicQuery\(|Document\.parse\(", r"Filters\.eq|Criteria\.where"),
        "python": (r"\.find(?:_one)?\(|\$where", r"isinstance\(|ObjectId\("),
        "javascript": (r"\.(?:find|findOne|updateOne|aggregate)\(|\$where", r"mongo-sanitize|String\("),
        "php": (r"->(?:find|findOne|executeQuery)\(", r"is_string|\(string\)"),
    }),
    "jsonp": ("JSONP劫持", "low", "CWE-346", {
        "java": (r"callback\s*\+\s*\"\(|JSONPObject\(", r"Referer|matches\("),
        "python": (r"callback\s*\+\s*['\"]\(", r"referer|isidentifier"),
        "javascript": (r"res\.jsonp\(|callback\s*\+\s*['\"]\(", r"referer|/\^"),
        "php": (r"\$callback\s*\.\s*['\"]\(", r"HTTP_REFERER|preg_match"),
    }),
    "upload": ("任意文件上传", "high", "CWE-434", {
        "java": (r"\.transferTo\(|MultipartFile", r"getContentType|endsWith\("),
        "python": (r"\.save\(.*filename|request\.FILES|request\.files", r"secure_filename|ALLOWED_EXTENSIONS"),
        "javascript": (r"\bmulter\(|\.mv\(", r"fileFilter|mimetype"),
        "php": (r"move_uploaded_file\s*\(", r"pathinfo|getimagesize"),
    }),
    "formula": ("公式注入", "low", "CWE-1236", {
        "java": (r"\.setCellValue\(|\.setCellFormula\(", r"escapeFormula|startsWith\(\"="),
        "python": (r"\.writerow\(|\.cell\(", r"lstrip\(|escape_formula"),
        "javascript": (r"\.addRow\(|aoa_to_sheet\(", r"escapeFormula"),
        "php": (r"\bfputcsv\s*\(|setCellValue\(", r"ltrim\("),
    }),
    "parameter": ("HTTP参数污染", "medium", "CWE-235", {
        "python": (r"getlist\(|urlencode\(", r"set\("),
        "javascript": (r"querystring\.stringify\(|URLSearchParams\(", r"Array\.isArray"),
        "php": (r"http_build_query\(|parse_str\(", r"array_unique"),
        "java": (r"getParameterValues\(|getParameterMap\(", r"distinct\("),
    }),
}

#: Rules that need no data from outside: what they name is wrong by itself.
_ALWAYS: dict[str, tuple[str, str, str, dict[str, tuple[str, str]]]] = {
    "cookie_http": ("Cookie未设置HttpOnly", "low", "CWE-1004", {
        "java": (r"new Cookie\(", r"setHttpOnly\(true"),
        "python": (r"set_cookie\(", r"(?i)httponly=True"),
        "javascript": (r"res\.cookie\(|document\.cookie\s*=", r"(?i)httponly"),
        "php": (r"\bsetcookie\(", r"(?i)httponly|true\s*\)"),
    }),
    "cookie_secure": ("Cookie未设置Secure", "low", "CWE-614", {
        "java": (r"new Cookie\(", r"setSecure\(true"),
        "python": (r"set_cookie\(", r"(?i)secure=True"),
        "javascript": (r"res\.cookie\(|document\.cookie\s*=", r"(?i)secure"),
        "php": (r"\bsetcookie\(", r"(?i)secure|true\s*,"),
    }),
    "random": ("不安全的随机数", "low", "CWE-330", {
        "java": (r"new Random\(|Math\.random\(", r"SecureRandom"),
        "c": (r"\brand\s*\(|\bsrand\s*\(", r"getrandom|arc4random"),
        "cpp": (r"\brand\s*\(|\bsrand\s*\(", r"random_device"),
        "python": (r"\brandom\.(?:random|randint|choice)\(", r"secrets\.|SystemRandom"),
        "javascript": (r"Math\.random\(", r"crypto\.randomBytes|getRandomValues"),
        "php": (r"\b(?:rand|mt_rand)\s*\(", r"random_int|random_bytes"),
    }),
    "crypto": ("弱加密算法", "medium", "CWE-327", {
        "java": (r"getInstance\(\"(?:MD5|SHA-?1|DES|RC4|DESede|AES/ECB)", r"AES/GCM"),
        "c": (r"\b(?:MD5|SHA1|DES_\w+|RC4)\s*\(", r"EVP_aes_256_gcm"),
        "cpp": (r"\b(?:MD5|SHA1|DES_\w+|RC4)\s*\(", r"EVP_aes_256_gcm"),
        "python": (r"hashlib\.(?:md5|sha1)\(|MODE_ECB|DES\.new\(", r"MODE_GCM"),
        "javascript": (r"createHash\(['\"](?:md5|sha1)|createCipher\(", r"aes-256-gcm"),
        "php": (r"\b(?:md5|sha1)\s*\(|mcrypt_", r"password_hash"),
    }),
    "certificate": ("证书校验缺失", "high", "CWE-295", {
        "java": (r"ALLOW_ALL_HOSTNAME_VERIFIER|checkServerTrusted\(.*\{\s*\}", r"HttpsURLConnection\.getDefault"),
        "python": (r"verify\s*=\s*False|_create_unverified_context", r"verify=True"),
        "javascript": (r"rejectUnauthorized:\s*false", r"rejectUnauthorized:\s*true"),
        "php": (r"CURLOPT_SSL_VERIFYPEER\s*,\s*(?:false|0)", r"VERIFYPEER\s*,\s*(?:true|1)"),
        "c": (r"CURLOPT_SSL_VERIFYPEER\s*,\s*0", r"VERIFYPEER\s*,\s*1"),
        "cpp": (r"CURLOPT_SSL_VERIFYPEER\s*,\s*0|SSL_VERIFY_NONE", r"SSL_VERIFY_PEER"),
    }),
    "debug": ("调试信息泄露", "low", "CWE-489", {
        "java": (r"printStackTrace\(", r"logger\."),
        "python": (r"debug\s*=\s*True|traceback\.print_exc\(", r"debug=False"),
        "javascript": (r"console\.trace\(|debugger;", r"NODE_ENV"),
        "php": (r"\b(?:phpinfo|var_dump|print_r)\s*\(", r"error_reporting\(0"),
        "c": (r"__LINE__.*printf", r"NDEBUG"),
        "cpp": (r"__LINE__.*cout", r"NDEBUG"),
    }),
    "csrf": ("跨站请求伪造", "medium", "CWE-352", {
        "java": (r"csrf\(\)\.disable\(|csrf\.disable\(|AbstractHttpConfigurer::disable", r"CookieCsrfTokenRepository"),
        "python": (r"@csrf_exempt|WTF_CSRF_ENABLED\s*=\s*False", r"csrf_protect"),
        "javascript": (r"csrf:\s*false|csrfProtection:\s*false", r"csurf\("),
        "php": (r"VerifyCsrfToken.*except|csrf_protection\s*=\s*FALSE", r"csrf_token\("),
    }),
    "cors": ("跨域资源共享配置过宽", "medium", "CWE-942", {
        "java": (r"addAllowedOrigin\(\"\*|allowedOrigins\(\"\*|Access-Control-Allow-Origin\",\s*\"\*", r"allowedOriginPatterns"),
        "python": (r"CORS_ORIGIN_ALLOW_ALL\s*=\s*True|Access-Control-Allow-Origin['\"]\]?\s*[=:,]\s*['\"]\*", r"CORS_ALLOWED_ORIGINS"),
        "javascript": (r"origin:\s*['\"]\*|Access-Control-Allow-Origin['\"]\s*[,:]\s*['\"]\*", r"allowedOrigins"),
        "php": (r"Access-Control-Allow-Origin:\s*\*", r"in_array"),
    }),
    "forwarded": ("X-Forwarded-For伪造", "low", "CWE-348", {
        "java": (r"(?i)getHeader\(\"x-forwarded-for", r"trustedProxies|isTrustedProxy"),
        "python": (r"HTTP_X_FORWARDED_FOR|X-Forwarded-For", r"ProxyFix|trusted_proxies"),
        "javascript": (r"(?i)x-forwarded-for", r"trust proxy|trustedProxies"),
        "php": (r"HTTP_X_FORWARDED_FOR", r"trusted_proxies|filter_var"),
    }),
    "permission": ("文件权限过宽", "medium", "CWE-732", {
        "java": (r"set(?:Readable|Writable|Executable)\(true,\s*false|rwxrwxrwx", r"rw-------"),
        "c": (r"\bchmod\s*\([^)]*0?777|\bumask\s*\(\s*0+\s*\)", r"S_IRUSR|0600"),
        "cpp": (r"\bchmod\s*\([^)]*0?777|\bumask\s*\(\s*0+\s*\)|perms::all", r"owner_read|0600"),
        "python": (r"os\.chmod\([^)]*0o?777|os\.umask\(\s*0\s*\)", r"0o600|S_IRUSR"),
        "javascript": (r"chmod(?:Sync)?\([^)]*0o?777", r"0o600"),
        "php": (r"\bchmod\s*\([^)]*0?777", r"0600"),
    }),
    "bundle": ("构建配置泄露源码", "low", "CWE-540", {
        "javascript": (r"devtool:\s*['\"](?:eval|source-map|inline)|sourcemap:\s*true|productionSourceMap:\s*true|disableHostCheck:\s*true|host:\s*['\"]0\.0\.0\.0", r"hidden-source-map|NODE_ENV"),
    }),
    "boot": ("Spring Boot配置不当", "medium", "CWE-16", {
        "properties": (r"exposure\.include\s*=\s*\*|h2\.console\.enabled\s*=\s*true|include-stacktrace\s*=\s*always|shutdown\.enabled\s*=\s*true", r"exposure\.exclude|security\.user"),
        "yaml": (r"^\s*include:\s*['\"]?\*|include-stacktrace:\s*always", r"(?m)^\s*exclude:|security:"),
    }),
    "robots": ("robots配置泄露路径", "low", "CWE-200", {"text": (r"(?i)^\s*disallow:\s*/\S*(?:admin|backup|private|config|secret)", r"(?im)^\s*disallow:\s*/\s*$")}),
    "conversion": ("不安全的类型转换", "low", "CWE-704", {
        "cpp": (r"reinterpret_cast<|const_cast<|\(\s*(?:unsigned\s+)?(?:char|int|short|long|void|float|double)\s*\*\s*\)", r"static_assert|bit_cast"),
    }),
    "coding": ("编码规范违反", "low", "CWE-710", {"cpp": (r"\bgoto\s+\w+\s*;|\bsetjmp\s*\(|\blongjmp\s*\(|#define\s+\w+\([^)]*\)", r"NOLINT|#undef")}),
    "condition": ("条件中赋值", "low", "CWE-481", {"cpp": (r"\b(?:if|while)\s*\(\s*\w+\s*=\s*[^=]", r"NOLINT|\(\(")}),
    "mybatis": ("MyBatis拼接", "high", "CWE-89", {"xml": (r"(?i)(?:order by|like|from|where|in)\b[^<]*\$\{", r"#\{")}),
    "secret": ("硬编码密码", "medium", "CWE-798", {
        lang: (r"(?i)(?:passw(?:or)?d|passwd|pwd|secret|token|api_?key)[\"']?\]?\s*(?:=>|=|:)\s*[\"'][^\"'$<{]{8,}[\"']", r"(?i)getenv|environ|example|placeholder|changeme")
        for lang in ("java", "c", "cpp", "python", "javascript", "php")
    }),
}

RULES: tuple[Rule, ...] = (
    *(Rule(f"{family}-{lang}", lang, sink, _INPUT[lang], safe, kind, level, cwe) for family, (kind, level, cwe, by) in _FAMILIES.items() for lang, (sink, safe) in by.items()),
    *(Rule(f"{family}-{lang}", lang, sink, "", safe, kind, level, cwe) for family, (kind, level, cwe, by) in _ALWAYS.items() for lang, (sink, safe) in by.items()),
)
