"""Patterns, word lists and limits that decide which rows come out.

They are plain data. Patterns are written in the browser's regular expression
syntax; ``regex.jvm`` and ``regex.re2`` turn them into what Spark and DuckDB run.
"""

# --- fixed values: endpoint patterns over page and script text, in order ------
TEXT_PATTERNS = [
    ("fetch", r"""\bfetch\s*\(\s*['"`]((?:https?:\/\/[^\s'"`]{4,}|\/[^\s'"`]{1,500}|(?:api|rest|graphql|gql|rpc|v\d+|service|services)\/[^\s'"`]{1,300}))[`'"]"""),
    ("axios", r"""\baxios\s*\.\s*(?:request|get|post|put|delete|patch|head|options)\s*\(\s*['"`]((?:https?:\/\/[^\s'"`]{4,}|\/[^\s'"`]{1,500}|(?:api|rest|graphql|gql|rpc|v\d+|service|services)\/[^\s'"`]{1,300}))[`'"]"""),
    ("jquery", r"""\$\s*\.\s*(?:ajax|get|post|put|delete|patch)\s*\(\s*['"`]((?:https?:\/\/[^\s'"`]{4,}|\/[^\s'"`]{1,500}))[`'"]"""),
    ("xhr", r"""\.open\s*\(\s*['"`](GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)['"`]\s*,\s*['"`]((?:https?:\/\/[^\s'"`]{4,}|\/[^\s'"`]{1,500}))[`'"]"""),
    ("route", r"""(?:router|app|server|Route)\s*\.\s*(?:get|post|put|delete|patch|use|all)\s*\(\s*['"`](\/[^\s'"`]{1,300})[`'"]"""),
    ("property", r"""(?:url|URL|endpoint|uri|URI|baseUrl|baseURL|apiUrl|apiURL|actionUrl|requestUrl|action)\s*[:=]\s*['"`]((?:https?:\/\/[^\s'"`]{4,}|\/[^\s'"`]{1,500}|(?:api|rest|graphql|gql|rpc|v\d+|service|services)\/[^\s'"`]{1,300}))[`'"]"""),
    ("apiprefix", r"""['"`]((?:api|rest|graphql|gql|rpc|v\d+|service|services)\/[^\s'"`<>\\]{2,})[`'"]"""),
    ("path", r"""['"`](\/[a-zA-Z0-9_\-\.~][a-zA-Z0-9_\-\.~\/]*(?:\?[^\s'"`]{0,200})?)[`'"]"""),
    ("absolute", r"""['"`](https?:\/\/[^\s'"`<>\\]{4,})[`'"]"""),
]

# --- fixed values: patterns over inline script blocks, in order ---------------
INLINE_PATTERNS = [
    r"""https?:\/\/[^\s"'`<>\\]{4,}""",
    r"""["'`]((?:\/|\.\.\/|\.\/)[^"'`\s<>\\]{2,})["'`]""",
    r"""(?i)["'`]((?:api|rest|graphql|gql|rpc|v\d+|service|services)\/[^"'`\s<>\\]{2,})["'`]""",
    r"""(?i)["'`](\/(?:api|rest|graphql|gql|rpc|v\d+|service|services)[^"'`\s<>\\]*)["'`]""",
    r"""(?i)(?:fetch|axios(?:\.\w+)?|open|post|get|put|delete|patch)\s*\(\s*["'`]([^"'`]{2,})["'`]""",
    r"""(?i)(?:url|endpoint|uri|path|baseURL|baseUrl|apiUrl|actionUrl)\s*[:=]\s*["'`]([^"'`]{2,})["'`]""",
]

# --- fixed values: script file names quoted inside inline scripts -------------
CHUNK_PATTERN = r"""['"`]([^'"`\s]{4,}\.(?:js|json)(?:\?[^'"`\s]*)?)['"`]"""
SCRIPT_HREF = r"""(?i)\.(js|json)(\?|$)"""
TEXT_CONTENT_TYPE = r"""(?i)javascript|json|text"""

# --- fixed values: endpoint false positives -----------------------------------
STATIC_DIR = r"""(?i)^\/(img|image|images|static|assets|dist|build|fonts?|icons?|media|svg|uploads?|thumbs?|avatars?|vendor|node_modules|bower_components|__webpack|_next|\.next|nuxt)\b"""
STATIC_EXT = r"""(?i)\.(?:png|jpe?g|gif|svg|webp|ico|bmp|avif|woff2?|ttf|eot|otf|otc|css|scss|less|map|pdf|zip|gz|tar|exe|dmg|apk)(?:\?.*)?$"""
SCRIPT_ASSET = r"""(?i)\.(?:min\.js|bundle\.js|chunk\.[a-f0-9]+\.js|[a-f0-9]{8,}\.js)(?:\?.*)?$"""
SINGLE_NOISE = r"""(?i)^\/(?:index|home|main|app|root|default|base|page|layout|wrapper|container)$"""
PATH_NOISE = r"""^\/[#?*]"""

# --- fixed values: schemes and shapes that are no endpoint candidates ---------
DOM_SKIP = r"""^(?:#|javascript:|data:|mailto:|tel:)"""
INLINE_SKIP = r"""^(?:data:|javascript:|#)"""
BARE_WORD = r"""^[a-zA-Z0-9_-]+$"""

# --- fixed values: request parameters around a match --------------------------
QUERY_STRING = r"""\?([a-zA-Z0-9_%+\-]+=(?:[^&'"`\s]*)(?:&[a-zA-Z0-9_%+\-]+=(?:[^&'"`\s]*))*)"""
OBJECT_LITERAL = r"""(?:params|body|data|payload|query|qs|fields)\s*:\s*\{([^}]{1,400})\}"""
SEARCH_PARAMS = r"""URLSearchParams\s*\(\s*\{([^}]{1,400})\}"""
# A key of an object literal is a name, quoted or not, then a colon. The engines here know no
# back-reference from closing to opening quote, so each kind of quote is a branch of its own.
OBJECT_KEY = r"""(?:'([a-zA-Z_][a-zA-Z0-9_]{1,39})'|"([a-zA-Z_][a-zA-Z0-9_]{1,39})"|([a-zA-Z_][a-zA-Z0-9_]{1,39}))\s*:"""
PARAM_NAME = r"""^[a-zA-Z_][a-zA-Z0-9_]{1,39}$"""
JS_KEYWORDS = [
    "true", "false", "null", "undefined", "const", "let", "var", "if", "else",
    "return", "new", "this", "function", "async", "await", "class", "import",
    "export",
]
METHOD_WORDS = ["POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"]

# --- fixed values: placeholder secrets ----------------------------------------
SECRET_PLACEHOLDERS = [
    r"""\$\{""", r"""\{\{""", r"""<[A-Z_]{3,}>""", r"""\.\.\.""",
    r"""(?i)(?:YOUR|INSERT|REPLACE|CHANGE|ENTER|PLACEHOLDER|EXAMPLE|SAMPLE|DUMMY|FAKE)[_\-]""",
    r"""\*{4,}""", r"""(?i)x{6,}""", r"""0{12,}""",
    r"""^[a-z_]{3,30}$""", r"""^[A-Z_]{3,30}$""", r"""(?i)<\/?[a-z]+[^>]*>""",
]

# --- fixed values: high-entropy strings ---------------------------------------
QUOTED_TOKEN = r"""["'`]([A-Za-z0-9+/\-_=]{24,})["'`]"""
ENTROPY_ID = "high-entropy"
ENTROPY_NAME = "High Entropy String"
ENTROPY_SEVERITY = "medium"
HEX_ENTROPY = 3.5
HEX_LENGTH = 32
MIXED_ENTROPY = 3.6

# --- fixed values: severities, best first -------------------------------------
SEVERITIES = ["critical", "high", "medium", "low"]
LOG_UNKNOWN_RANK = 99
VIEW_UNKNOWN_RANK = 9

# --- limits: None is no limit and builds no window; set one to cut what a small store could not hold ---
RULE_MATCHES: int | None = None         # per rule and source, before filtering
RULE_FINDINGS: int | None = None        # per source
ENTROPY_FINDINGS: int | None = None     # per source
PARAMS_PER_ENDPOINT: int | None = None
BODY_CHARS: int | None = None
LOG_SECRETS: int | None = None
LOG_ENDPOINTS: int | None = None
LOG_SOURCES: int | None = None
LOG_PAGES: int | None = None
LOG_PARAMS: int | None = None
LOG_QUERIES: int | None = None
LOG_RULES: int | None = None
LOG_KINDS: int | None = None
CAPTURE_ROWS: int | None = None

# --- fixed values: text shown around a match, in characters, and the debounce ---------
DOM_CONTEXT = 900
SECRET_MARGIN = 240
INLINE_MARGIN = 220
TEXT_MARGIN = 260
PARAM_BEFORE, PARAM_AFTER = 150, 500
METHOD_BEFORE, METHOD_AFTER = 120, 40
DEBOUNCE = "120 milliseconds"

# Values of one list in one row of the host log and the merged view; longer lists take more rows.
LIST_PAGE = 1000

# --- fixed values: lookup pages per host --------------------------------------
LOOKUPS = [
    ("dns", "https://securitytrails.com/domain/", "host", "/dns"),
    ("history", "https://securitytrails.com/domain/", "host", "/history/a"),
    ("subdomains", "https://securitytrails.com/list/apex_domain/", "root", ""),
    ("webcheck", "https://web-check.xyz/check/", "host", ""),
]
