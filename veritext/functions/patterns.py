"""Fixed values of the text rules: caps, character classes, word lists. Patterns are Java regexes."""

from __future__ import annotations

# Longest lengths of reported fields, in characters.
TITLE, URL, HEADING, ERROR, META, LANG, SNIPPET, PUBLISHED, ENGINE, EXCERPT, LOCATION, REASON = 300, 2048, 200, 200, 300, 35, 500, 40, 60, 80, 120, 80
THREATS_PER_PAGE, THREATS_PER_SOURCE = 50, 10
CHARS_PER_TOKEN, DEFAULT_TOKENS = 4, 20_000
MARKER = "\n\n[... truncated]"
# What is said of failed fetches.
REFUSED, TOO_LATE = "address refused by policy", "no answer before the deadline"

# Invisible characters by class.
ZERO_WIDTH = r"\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{AD}\x{E0100}-\x{E01EF}"
SPACE_LIKE = r"\x{3164}\x{2800}\x{180E}\x{2028}\x{2029}"
BIDI = r"\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}"
TAG = r"\x{E0000}-\x{E007F}"
INVISIBLE = f"[{ZERO_WIDTH}{SPACE_LIKE}{BIDI}{TAG}]"
CONTROLS = r"[\x00-\x1F\x7F-\x{9F}]"
SPACE = r"(?U)[\s\x1C-\x1F]"
EDGES = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"
TAIL = r"(?U)[\s\x1C-\x1F]+$"
LINE_ENDS = r"(?<=\n)|(?<=\r)(?!\n)|(?<=[\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}])"
HEAD = r"(?U)^#{1,6}[\s\x1C-\x1F]+"

# Signs of challenge pages.
MITIGATION_VALUES = {"cf-mitigated": ("challenge",), "x-vercel-mitigated": ("challenge",), "x-amzn-waf-action": ("challenge", "captcha")}
MITIGATION_PRESENT = ("x-dd-b", "x-datadome-cid")
CHALLENGE_ASSETS = (("/cdn-cgi/challenge-platform/", "/orchestrate/"), ("captcha-delivery.com",), ("captcha.px-cdn.net",), ("client.px-cdn.net",), ("_incapsula_resource",))
HUMAN_SIGNS = ("verify you are human", "verifying you are human", "are you a robot")
TITLE_SIGNS = (*HUMAN_SIGNS, "just a moment", "attention required", "checking if the site connection is secure")
BODY_SIGNS = (
    *HUMAN_SIGNS,
    "checking your browser before accessing",
    "ddos protection by cloudflare",
    "performance & security by cloudflare",
    "please stand by, while we are checking your browser",
    "verify you are human by completing the action",
)
INTERSTITIAL_CHARS, SCAN_CHARS = 600, 4000
TEXT_TYPES = (
    "application/xml",
    "application/json",
    "application/javascript",
    "application/x-javascript",
    "application/ecmascript",
    "application/ndjson",
    "application/x-ndjson",
    "application/yaml",
    "application/x-yaml",
    "application/toml",
    "application/graphql",
)
NOT_CONTENT = ("challenge", "blocked", "rate_limited", "not_found", "server_error", "unsupported_content")

# IPv4 ranges that must not be fetched; 192.0.0.9 and 192.0.0.10 are public.
BLOCKED_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.8/32", "192.0.0.11/32", "192.0.0.12/30",
    "192.0.0.16/28", "192.0.0.32/27", "192.0.0.64/26", "192.0.0.128/25", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
# Public suffixes known without a table of one's own; a longer list is a parameter.
SUFFIXES = (
    "com", "net", "org", "edu", "gov", "mil", "int", "info", "biz", "io", "dev", "app", "ai", "co", "me", "tv", "cc", "xyz", "site", "online", "blog", "news",
    "ar", "com.ar", "at", "co.at", "or.at", "au", "com.au", "net.au", "org.au", "edu.au", "gov.au", "be", "bg", "br", "com.br", "org.br", "gov.br", "ca", "ch",
    "cl", "cn", "com.cn", "org.cn", "net.cn", "gov.cn", "edu.cn", "com.co", "cz", "de", "dk", "ee", "es", "com.es", "org.es", "eu", "fi", "fr", "gouv.fr", "gr",
    "hk", "com.hk", "org.hk", "hr", "hu", "id", "co.id", "or.id", "go.id", "ie", "il", "co.il", "org.il", "ac.il", "in", "co.in", "net.in", "org.in", "gov.in",
    "ac.in", "ir", "is", "it", "gov.it", "jp", "co.jp", "or.jp", "ne.jp", "ac.jp", "go.jp", "ke", "co.ke", "kr", "co.kr", "or.kr", "go.kr", "ac.kr", "lt", "lu",
    "lv", "mx", "com.mx", "org.mx", "gob.mx", "my", "com.my", "ng", "com.ng", "nl", "no", "nz", "co.nz", "org.nz", "govt.nz", "ac.nz", "pe", "com.pe", "ph", "com.ph",
    "pk", "com.pk", "pl", "com.pl", "pt", "com.pt", "ro", "rs", "ru", "com.ru", "sa", "com.sa", "se", "sg", "com.sg", "si", "sk", "th", "co.th", "or.th", "tr",
    "com.tr", "org.tr", "gov.tr", "tw", "com.tw", "org.tw", "ua", "com.ua", "uk", "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "us", "vn", "com.vn", "za",
    "co.za", "org.za", "github.io", "gitlab.io", "blogspot.com", "wordpress.com", "netlify.app", "vercel.app", "pages.dev", "web.app", "herokuapp.com", "fly.dev",
)
# Metadata names, first match wins.
AUTHOR_KEYS = ("author", "article:author", "dc.creator")
PUBLISHED_KEYS = ("article:published_time", "datepublished", "dc.date")
MODIFIED_KEYS = ("article:modified_time", "datemodified", "og:updated_time")
# Elements that end a line.
BREAKS = frozenset(
    "address article aside blockquote br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend "
    "li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
