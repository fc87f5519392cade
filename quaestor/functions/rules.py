"""Word lists, patterns, weights and defaults.

Everything in this module is data that results depend on.  The lists are written out plainly, in their natural
order, because several operators are order-sensitive (first match wins).
"""

# --------------------------------------------------------------------------------------------------------------
# Text classes.  Tokens are Unicode letters, digits and underscore; white space includes the Unicode
# separators.  Both classes are written so that Java and RE2 read them the same way.
TOKEN = r"[\p{L}\p{N}_]+"
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"
# The same white space as single characters.
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
SPACE_CHARS += "\u2028\u2029\u202f\u205f\u3000"

# The 33 English stop words of the standard Lucene analyser.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they "
    "this to was will with"
).split()

# --------------------------------------------------------------------------------------------------------------
# Synonym file (term -> canonical name), in file order.
SYNONYMS = [
    ("csu", "Customer Summary Utility"),
    ("customer summary", "Customer Summary Utility"),
    ("gcp", "Global Customer Platform"),
    ("etu", "Enhanced Transaction Utility"),
    ("transaction utility", "Enhanced Transaction Utility"),
    ("au", "Account Utility"),
    ("ciu", "Customer Interaction Utility"),
    ("de", "Digital Events"),
    ("pcu", "Product Catalog Utility"),
    ("digev", "Digital Events"),
    ("apg", "APG"),
]

# API catalogue (product, group, acronym, API names).
API_CATALOG = [
    (
        "Utilities",
        "Account Utility",
        "AU",
        [
            "AU Merchant Services - Account Summary Experience API",
            "AU Switch State Services API",
            "AU Card Account Promo Balance Services",
            "AU Credit Account Statement Information Service",
            "Account Utility Card Rewards API",
            "AU Card Account Balance Summary Digital Channel",
            "AU Card Statement Recon API",
            "AU Auto Lease Details v2",
            "AU Auto Loan Details V2",
            "AU Card AutoPay Messaging API",
            "AU Merchant Account Services API",
            "AU Merchant Service AllTransaction",
            "AU Merchant Services - Card Summary & Card Types",
            "AU Merchant Service Card Type API",
            "AU Merchant Account Card Summary-Disputes Summary-API",
            "AU Merchant Service DDA",
            "AU Merchant Service Deposits",
            "AU Card Lookup SVC API",
        ],
    ),
    ("Utilities", "Customer Interaction Utility", "CIU", ["CIU Short Term History"]),
    ("Utilities", "Customer Summary Utility", "CSU", ["CSU Inquiry Service V2"]),
    ("Utilities", "Digital Events", "DE", ["DIGEV Nucleus SLOT API", "DIGEV Trace API", "DIGEV SLOT WEB API"]),
    (
        "Utilities",
        "Enhanced Transaction Utility",
        "ETU",
        [
            "ETU Card Update Activity Service API",
            "ETU Credit Card Transaction Reference Look Up API",
            "ETU Merchant Reference API",
            "ETU DDA Update Activity",
            "Card Account Expense Summary Offline Report",
            "Card Account Expense Summary",
            "ETU DDA Fee Refund Update",
            "ETU Cross Product Transaction Aggregation",
            "Nucleus Etu Bulk Access Activity",
            "ETU Credit Card Enhanced Transaction Detail API",
        ],
    ),
    ("Utilities", "Product Catalog Utility", "PCU", ["PCU Product Catalog Utility API"]),
    ("Communications", "Vader", None, ["Subscription Device Management API"]),
    ("Communications", "Vader", None, ["Aggregation Update Activity API"]),
    ("P&I", "Customer Eligibility Engine", None, ["Customer Eligibility Engine"]),
    ("P&I", "Personalization & Insights Data Hub", None, ["PI Data Feature API"]),
    ("P&I", "Personalization & Insights Recommendation Engine", None, ["PI Recommendations Engine API"]),
]

# Utility name -> acronym used by the query expansion of the lexical match.
CLAUSE_UTILITIES = [
    ("Customer Interaction Utility", "CIU"),
    ("Enhanced Transaction Utility", "ETU"),
    ("Customer Summary Utility", "CSU"),
    ("Account Utility", "AU"),
    ("Product Catalog Utility", "PCU"),
]
# Clause suffix -> boost for each recognised utility ("" is the acronym alone).
CLAUSE_BOOSTS = [("", 2.0), (" utility", 1.5), (" data", 1.2), (" interaction", 1.2), (" field", 1.1)]
TITLE_BOOST, CONTENT_BOOST = 6.0, 2.0
BM25_K1, BM25_B = 1.2, 0.75

# Semantic cache-key rewrites, applied in order.
SEMANTIC_REWRITES = [
    (r"\bguide\b", "documentation"),
    (r"\bdocs?\b", "documentation"),
    (r"\btutorial\b", "documentation"),
    (r"\bhelp\b", "documentation"),
    (r"\bsetup\b", "configure"),
    (r"\bconfig\b", "configure"),
    (r"\bonboard\b", "onboarding"),
    (r"\bon-board\b", "onboarding"),
]
EMBEDDING_SUFFIX = "site:Utilities onboarding runbook documentation"

# --------------------------------------------------------------------------------------------------------------
# Router.  Rules are tried in this order; the first match wins.
ROUTER_ACRONYMS = ["ciu", "etu", "csu", "au", "pcu"]
ROUTES = [
    (
        "api",
        0.8,
        [
            r"\b(?:GET|POST|PUT|DELETE|PATCH)\s+/\S+",
            r"\bendpoint|swagger|openapi\b",
            r"\bapi\s+(?:documentation|docs|spec|reference)\b",
            r"\brest\s+api\b",
        ],
    ),
    (
        "list",
        0.9,
        [
            r"^(?:list|show me|what are all|how many)\b",
            r"\ball\s+(?:available|existing)\b",
            r"\blist\s+(?:of\s+)?(?:apis|utilities|services|endpoints)\b",
        ],
    ),
    (
        "compare",
        0.8,
        [
            r"\b(?:vs|versus|compare|difference|which is better)\b",
            r"\b\w+\s+vs\s+\w+\b",
            r"\bdifference between\b",
        ],
    ),
    (
        "procedure",
        0.7,
        [
            r"\bhow do i|how to|can i\b",
            r"\bsetup|configure|install|onboard\b",
            r"\bsteps|guide|tutorial|walkthrough\b",
            r"\btroubleshoot|fix|resolve|solve\b",
            r"\bcreate|submit|open\s+(?:a\s+)?(?:ticket|request)\b",
        ],
    ),
]
COMPARE_ENTITIES = [
    r"\b(\w+(?:\s+\w+)?)\s+(?:vs|versus)\s+(\w+(?:\s+\w+)?)\b",
    r"\bdifference\s+between\s+(\w+(?:\s+\w+)?)\s+and\s+(\w+(?:\s+\w+)?)\b",
    r"\bcompare\s+(\w+(?:\s+\w+)?)\s+(?:and|with)\s+(\w+(?:\s+\w+)?)\b",
]
COMPARE_QUERY_SUFFIX = " utility service api documentation"

# --------------------------------------------------------------------------------------------------------------
# Query characteristics.
SPECIFICITY_KEYWORDS = [
    "ciu", "customer interaction utility", "customer interaction", "customer utility",
    "etu", "enhanced transaction utility", "transaction utility",
    "au", "account utility", "accounts utility",
    "csu", "customer summary utility", "customer summary",
    "pcu", "payment card utility", "payment utility",
]
GENERIC_API_PATTERNS = [
    r"\bapi\s*(?:s|es)?\s*(?:available|list|all)\b",
    r"\b(?:what|which|show|list)\s+api\s*(?:s|es)?\b",
    r"\b(?:available|existing)\s+api\s*(?:s|es)?\b",
    r"\ball\s+api\s*(?:s|es)?\b",
]
PROCEDURE_PATTERNS = [
    r"\bhow\s+to\b",
    r"\bsteps?\s+to\b",
    r"\bguide\s+(?:to|for)\b",
    r"\bonboard(?:ing)?\b",
    r"\bsetup?\b",
    r"\bconfigure?\b",
    r"\bintegrat\w+\b",
    r"\bimplement\w*\b",
    r"\binstall\w*\b",
    r"\benable\b",
    r"\bstart\w+\b",
]
API_INDICATORS = [
    r"\bapi\b", r"\bendpoint\s*(?:s)?\b", r"\bswagger\b", r"\brest\b", r"\bhttp\b", r"\brequest\s*(?:s)?\b",
]
TROUBLE_WORDS = ["error", "fix", "troubleshoot", "not working", "issue"]
# Query type -> (main index threshold, API index threshold).
TYPE_THRESHOLDS = {
    "generic_api": (0.10, 0.02),
    "specific_utility": (0.20, 0.08),
    "procedure": (0.15, 0.05),
    "troubleshoot": (0.12, 0.03),
    "info": (0.15, 0.05),
}

# Utility recognition (name -> phrases), order-sensitive.
UTILITY_PATTERNS = [
    (
        "Customer Interaction Utility",
        ["ciu", "customer interaction utility", "customer interaction", "customer utility", "interaction utility"],
    ),
    (
        "Enhanced Transaction Utility",
        ["etu", "enhanced transaction utility", "transaction utility", "enhanced transaction",
         "transaction processing"],
    ),
    ("Account Utility", ["au", "account utility", "accounts utility", "account management"]),
    ("Customer Summary Utility", ["csu", "customer summary utility", "customer summary", "summary utility"]),
    ("Payment Card Utility", ["pcu", "payment card utility", "payment utility", "card utility"]),
]
UTILITY_QUERY_TERMS = [
    "ciu", "customer interaction utility", "etu", "enhanced transaction", "utility", "utilities",
]
UTILITY_TOPICS = {
    "Customer Interaction Utility": ["customer", "interaction", "crm", "contact"],
    "Enhanced Transaction Utility": ["transaction", "payment", "processing", "financial"],
    "Account Utility": ["account", "user", "profile", "management"],
    "Customer Summary Utility": ["summary", "report", "overview", "dashboard"],
    "Payment Card Utility": ["card", "payment", "billing", "checkout"],
}

# List requests (words -> list type), first match wins, default "apis".
LIST_TYPES = [
    (["api"], "apis"),
    (["apg", "api group"], "apgs"),
    (["product"], "products"),
    (["utility", "service"], "utilities"),
    (["field", "parameter"], "fields"),
]
LIST_HEADINGS = {
    "apis": "I have knowledge of the following APIs:\n\n",
    "apgs": "I have knowledge of the following APGs:\n\n",
    "products": "I have knowledge of the following Products:\n\n",
}
LIST_PREFIXES = {"apgs": "- APG: ", "products": "- Product Name: "}
LIST_FOLLOW_UPS = {
    "apgs": "\n**Follow-up questions:**\n- Which specific APG do you want to know more about?\n"
    "- What APIs are in a particular APG?\n- How do these APGs relate to specific Products?",
    "apis": "\n**Follow-up questions:**\n- Which API do you want detailed information about?\n"
    "- What parameters does a specific API accept?\n- Which APG does a particular API belong to?",
    "products": "\n**Follow-up questions:**\n- Which Product do you want to explore?\n"
    "- What APGs are part of a specific Product?\n- What APIs are available in a particular Product?",
}

# Query decomposition.
DECOMPOSE_VERBS = r"\b(onboard|enable|configure|setup|migrate|create|request)\b"
DECOMPOSE_ASPECTS = ["Prerequisites", "Jira", "Owner", "Endpoints", "Steps", "Sla"]
# Aspect plan.
PLAN_ASPECTS = ["overview", "steps", "api"]
PLAN_TROUBLE_WORDS = ["error", "issue", "debug", "fix"]
PLAN_BUDGETS = {"overview": 500, "steps": 900, "api": 500, "troubleshoot": 600}
PLAN_STRATEGY = {"overview": "fusion", "steps": "bm25", "api": "bm25", "troubleshoot": "bm25"}

# --------------------------------------------------------------------------------------------------------------
# Passage features and hints.
ACTION_PATTERNS = {
    "steps": r"(?m)^\s*(?:\d+\.|[-*])\s+\S+",
    "endpoint": r"\b(GET|POST|PUT|DELETE|PATCH)\s+/[^\s#]+",
    "jira": r"(?i)\b(jira|servicenow|request\s+form|intake|project\s*key)\b",
    "owner": r"(?i)\b(owner|team|contact|dl|email|slack|channel)\b",
    "table": r"\n\|[^\n]+\|\n\|[- :|]+\|\n",
}
ACTION_WEIGHTS = {"steps": 0.20, "endpoint": 0.15, "jira": 0.15, "owner": 0.10, "table": 0.05}
HINT_PATTERNS = [
    ("text", r"(?m)^\s*(\d+[\.\)]|\(\d+\)|[-–•*])\s+\S", 0.4),
    ("text", r"(?i)\b(jira|servicenow|intake|request\s+(?:form|ticket)|project\s+key)\b", 0.3),
    ("title", r"(?i)\b(onboard|enable|request|configure)\b", 0.2),
]
STEP_INDICATORS = [
    r"\b\d+\.",
    r"\bStep \d+",
    r"\b(First|Second|Third|Next|Then|Finally|Lastly)\b",
    r"^\s*[-*]\s",
    r"\b(Before|After|Once|When)\b.*\b(complete|finish|done)\b",
]
GENERIC_SECTIONS = ["global", "overview", "platform"]
GENERIC_TITLES = ["overview", "introduction", "welcome"]

# Answer checks.
ERROR_PHRASES = [
    "i don't have information", "i cannot find", "no information available", "unable to provide", "i don't know",
    "insufficient information", "cannot determine", "not enough context", "error occurred", "something went wrong",
]
TRUNCATION_MARKS = ["...", "[truncated]", "[cut off]", "more info", "additional details"]
ANCHOR_TERMS = [
    "onboard", "setup", "config", "install", "enable", "start", "getting-started", "quickstart", "tutorial", "guide",
    "procedure", "steps", "how-to",
]

# Evidence sections (key, words), default "info"; display titles.
SECTION_WORDS = {
    "api": ["api", "endpoint", "swagger", "openapi", "rest", "/api/", "get ", "post ", "put ", "delete ",
            "http method"],
    "procedure": ["step", "procedure", "how to", "setup", "configure", "install", "create", "follow", "first",
                  "then", "next"],
    "troubleshoot": ["error", "troubleshoot", "problem", "issue", "fix", "resolve", "failed", "not working",
                     "warning", "exception"],
    "lists": ["list of", "available", "supported", "options", "types", "all ", "following", "include:", "such as"],
}
SECTION_TITLES = {
    "info": "Overview",
    "procedure": "Steps & Procedures",
    "api": "API Reference",
    "troubleshoot": "Troubleshooting",
    "lists": "Available Options",
}
SECTION_ORDER = ["info", "procedure", "api", "troubleshoot", "lists"]

# Content paths tried in order when an index has no reliable profile.
DEFAULT_PATHS = [
    "inner_hits", "sections.content", "sections.text", "body", "content", "text", "description", "summary",
]

# Intent -> default content type; content-type soft filters per view.
INTENT_CONTENT_TYPE = {"confluence": "confluence", "swagger": "api_spec", "api_spec": "api_spec"}
SOFT_FILTERS = {
    "api": (1, [("content_type", "swagger"), ("content_type", "api"), ("title", "api"), ("text", "endpoint")]),
    "procedure": (
        0,
        [
            ("content_type", "runbook"), ("content_type", "guide"), ("content_type", "tutorial"),
            ("content_type", "onboarding"), ("title", "how to"), ("title", "setup"), ("title", "onboarding"),
            ("text", "step"), ("text", "procedure"),
        ],
    ),
    "info": (
        0,
        [
            ("content_type", "confluence"), ("content_type", "documentation"), ("content_type", "overview"),
            ("title", "overview"), ("title", "definition"), ("text", "what is"),
        ],
    ),
}

# --------------------------------------------------------------------------------------------------------------
# Tool suites.  Each suite has hints and extractors (name, capability, weight, patterns, attrs, urls).
SUITES = {
    "jira": {
        "hints": [
            r"(?i)\bjira\b|atlassian\.net",
            r"(?i)\bproject\s*key\b|issue\s*type\b",
            r"(?i)\bticket\b|\bissue\b",
            r"(?i)\bbacklog\b|\bsprint\b",
        ],
        "extractors": [
            (
                "ticket_create", "ticket.create", 3.0,
                [
                    r"(?i)create\s+(?:a\s+)?(?:jira\s+)?ticket",
                    r"(?i)submit\s+(?:an?\s+)?(?:intake|jira)\s+(?:form|ticket)",
                    r"(?i)open\s+(?:a\s+)?(?:new\s+)?(?:jira\s+)?(?:issue|ticket)",
                    r"(?i)file\s+(?:a\s+)?(?:jira\s+)?(?:ticket|issue)",
                    r"(?i)raise\s+(?:a\s+)?(?:jira\s+)?(?:ticket|issue)",
                ],
                {
                    "project_key": r"(?i)project\s*(?:key)?\s*[:=]?\s*([A-Z][A-Z0-9]+)",
                    "issue_type": r"(?i)issue\s*type\s*[:=]?\s*([A-Za-z][A-Za-z\s]+)",
                },
                [r"(https?://[^\s]+\.atlassian\.net/[^\s]*)", r"(https?://[^\s]+/jira/[^\s]*)"],
            ),
            (
                "ticket_view", "ticket.view", 1.5,
                [
                    r"(https?://[^\s]+/browse/[A-Z][A-Z0-9]+-\d+)",
                    r"(?i)view\s+(?:jira\s+)?(?:ticket|issue)\s+([A-Z][A-Z0-9]+-\d+)",
                    r"(?i)check\s+(?:jira\s+)?(?:ticket|issue)\s+([A-Z][A-Z0-9]+-\d+)",
                    r"([A-Z][A-Z0-9]+-\d+)",
                ],
                {"ticket_id": r"([A-Z][A-Z0-9]+-\d+)"},
                [],
            ),
            (
                "project_access", "project.access", 2.0,
                [
                    r"(?i)access\s+(?:to\s+)?(?:jira\s+)?project\s+([A-Z][A-Z0-9]+)",
                    r"(?i)join\s+(?:jira\s+)?project\s+([A-Z][A-Z0-9]+)",
                    r"(?i)request\s+access\s+(?:to\s+)?([A-Z][A-Z0-9]+)",
                ],
                {"project_key": r"([A-Z][A-Z0-9]+)"},
                [],
            ),
        ],
    },
    "servicenow": {
        "hints": [
            r"(?i)\bservicenow\b|\bsnow\b",
            r"(?i)\bcatalog\b|\brequest\b",
            r"(?i)\bincident\b|\bticket\b",
            r"(?i)servicenow\.com|\bitsm\b",
        ],
        "extractors": [
            (
                "request_create", "request.create", 3.0,
                [
                    r"(?i)create\s+(?:a\s+)?(?:servicenow\s+)?(?:request|ticket)",
                    r"(?i)submit\s+(?:a\s+)?(?:servicenow\s+)?(?:request|ticket)",
                    r"(?i)open\s+(?:a\s+)?(?:servicenow\s+)?(?:request|ticket|incident)",
                    r"(?i)raise\s+(?:a\s+)?(?:servicenow\s+)?(?:request|incident)",
                    r"(?i)file\s+(?:a\s+)?(?:servicenow\s+)?(?:request|incident)",
                ],
                {"request_type": r"(?i)(request|ticket|incident)"},
                [],
            ),
            (
                "catalog_browse", "catalog.browse", 2.2,
                [
                    r"(?i)browse\s+(?:the\s+)?(?:servicenow\s+)?catalog",
                    r"(?i)(?:servicenow\s+)?catalog\s+(?:item|request)",
                    r"(?i)request\s+from\s+catalog",
                    r"(?i)service\s+catalog\s+(?:item|request)",
                ],
                {"catalog_item": r"(?i)catalog\s+(?:item\s+)?([\w\s-]+)"},
                [],
            ),
            (
                "incident_view", "request.view", 1.5,
                [
                    r"(?i)view\s+(?:servicenow\s+)?(?:incident|request)\s+(INC\d+|REQ\d+|RITM\d+)",
                    r"(?i)check\s+(?:servicenow\s+)?(?:incident|request)\s+(INC\d+|REQ\d+|RITM\d+)",
                    r"(INC\d{7,}|REQ\d{7,}|RITM\d{7,})",
                ],
                {"incident_number": r"(INC\d{7,}|REQ\d{7,}|RITM\d{7,})"},
                [],
            ),
            (
                "servicenow_link", "request.view", 1.2,
                [r"(https?://[^\s]*servicenow\.com/[^\s]*)", r"(https?://[^\s]*\.service-now\.com/[^\s]*)"],
                {"snow_url": r"(https?://[^\s]*servicenow[^\s]*)"},
                [],
            ),
        ],
    },
    "api": {
        "hints": [
            r"(?i)\bapi\b|\bendpoint\b",
            r"(?i)\brest\b|\bhttp\b",
            r"(?i)\bauthentication\b|\bauth\b",
            r"(?i)/api/|swagger|openapi",
        ],
        "extractors": [
            (
                "http_endpoint", "api.try", 2.5,
                [
                    r"(?i)\b(GET|POST|PUT|DELETE|PATCH)\s+(/\S+)",
                    r"(?i)\b(GET|POST|PUT|DELETE|PATCH)\s+(https?://\S+)",
                    r"(?i)call\s+(?:the\s+)?(/\S+)\s+(?:endpoint|api)",
                    r"(?i)invoke\s+(?:the\s+)?(/\S+)\s+(?:endpoint|api)",
                ],
                {
                    "method": r"\b(GET|POST|PUT|DELETE|PATCH)\b",
                    "path": r"(/\S+)",
                    "full_url": r"(https?://\S+)",
                },
                [],
            ),
            (
                "api_key", "auth.setup", 2.8,
                [
                    r"(?i)api\s+key\s+(?:for\s+)?([\w\s-]+)",
                    r"(?i)authentication\s+(?:for\s+)?([\w\s-]+)\s+(?:api|service)",
                    r"(?i)get\s+(?:an?\s+)?api\s+key\s+(?:for\s+)?([\w\s-]+)",
                    r"(?i)create\s+(?:an?\s+)?api\s+key\s+(?:for\s+)?([\w\s-]+)",
                    r"(?i)generate\s+(?:an?\s+)?api\s+key\s+(?:for\s+)?([\w\s-]+)",
                ],
                {"service_name": r"(?:for\s+)?([\w\s-]+)"},
                [],
            ),
            (
                "swagger_docs", "api.docs", 1.8,
                [
                    r"(?i)swagger\s+(?:docs|documentation)",
                    r"(?i)api\s+(?:docs|documentation)",
                    r"(?i)openapi\s+(?:spec|specification)",
                    r"(https?://[^\s]*swagger[^\s]*)",
                    r"(https?://[^\s]*api[^\s]*docs[^\s]*)",
                ],
                {"docs_url": r"(https?://[^\s]*(?:swagger|api[^\s]*docs)[^\s]*)"},
                [],
            ),
            (
                "client_id", "auth.setup", 2.5,
                [
                    r"(?i)client\s+id\s+(?:for\s+)?([\w\s-]+)",
                    r"(?i)create\s+(?:a\s+)?client\s+id\s+(?:for\s+)?([\w\s-]+)",
                    r"(?i)register\s+(?:a\s+)?client\s+(?:for\s+)?([\w\s-]+)",
                    r"(?i)app\s+registration\s+(?:for\s+)?([\w\s-]+)",
                ],
                {"service_name": r"(?:for\s+)?([\w\s-]+)"},
                [],
            ),
        ],
    },
    "teams": {
        "hints": [
            r"(?i)\bteams\b|microsoft\s+teams",
            r"(?i)\bchannel\b|\bchat\b",
            r"(?i)\bmeeting\b|\bcall\b",
            r"(?i)teams\.microsoft\.com",
        ],
        "extractors": [
            (
                "channel_join", "channel.open", 2.5,
                [
                    r"(?i)join\s+(?:the\s+)?(?:teams\s+)?channel\s+([#@]?[\w\s-]+)",
                    r"(?i)access\s+(?:the\s+)?(?:teams\s+)?channel\s+([#@]?[\w\s-]+)",
                    r"(?i)contact\s+(?:the\s+)?([\w\s-]+)\s+(?:team|channel)",
                    r"(?i)reach\s+out\s+(?:to\s+)?(?:the\s+)?([\w\s-]+)\s+(?:team|channel)",
                ],
                {"channel_name": r"([#@]?[\w\s-]+)"},
                [r"(https?://teams\.microsoft\.com/[^\s]*)"],
            ),
            (
                "meeting_schedule", "meeting.schedule", 2.0,
                [
                    r"(?i)schedule\s+(?:a\s+)?(?:teams\s+)?meeting",
                    r"(?i)set\s+up\s+(?:a\s+)?(?:teams\s+)?(?:meeting|call)",
                    r"(?i)book\s+(?:a\s+)?(?:teams\s+)?(?:meeting|call)",
                    r"(?i)arrange\s+(?:a\s+)?(?:teams\s+)?(?:meeting|call)",
                ],
                {"meeting_type": r"(?i)(meeting|call|standup|review|demo)"},
                [],
            ),
            (
                "contact_team", "contact.open", 1.8,
                [
                    r"(?i)contact\s+(?:the\s+)?([\w\s-]+)\s+team",
                    r"(?i)reach\s+(?:out\s+to\s+)?(?:the\s+)?([\w\s-]+)\s+team",
                    r"(?i)ask\s+(?:the\s+)?([\w\s-]+)\s+team",
                    r"(?i)([\w\s-]+)\s+(?:support|help)\s+(?:team|channel)",
                ],
                {"team_name": r"([\w\s-]+)"},
                [],
            ),
            (
                "teams_link", "channel.open", 1.5,
                [
                    r"(https?://teams\.microsoft\.com/l/[^\s]+)",
                    r"(https?://teams\.microsoft\.com/[^\s]*channel[^\s]*)",
                ],
                {"teams_url": r"(https?://teams\.microsoft\.com/[^\s]+)"},
                [],
            ),
        ],
    },
    "outlook": {
        "hints": [
            r"(?i)\boutlook\b|\bemail\b",
            r"(?i)\bcalendar\b|\bappointment\b",
            r"(?i)\bdl\b|distribution\s+list",
            r"(?i)outlook\.office365\.com|outlook\.live\.com",
        ],
        "extractors": [
            (
                "email_send", "email.send", 2.0,
                [
                    r"(?i)send\s+(?:an?\s+)?email\s+to\s+([\w\s@.-]+)",
                    r"(?i)email\s+(?:the\s+)?([\w\s@.-]+)",
                    r"(?i)contact\s+([\w\s@.-]+)\s+(?:via\s+)?(?:email|outlook)",
                    r"(?i)reach\s+out\s+(?:to\s+)?([\w\s@.-]+)\s+(?:via\s+)?email",
                ],
                {"recipient": r"([\w\s@.-]+)", "email_address": r"([\w.-]+@[\w.-]+\.[a-zA-Z]{2,})"},
                [],
            ),
            (
                "calendar_create", "calendar.create", 2.2,
                [
                    r"(?i)schedule\s+(?:a\s+)?(?:calendar\s+)?(?:meeting|appointment)",
                    r"(?i)book\s+(?:a\s+)?(?:calendar\s+)?(?:meeting|appointment)",
                    r"(?i)create\s+(?:a\s+)?(?:calendar\s+)?(?:event|meeting|appointment)",
                    r"(?i)set\s+up\s+(?:a\s+)?(?:calendar\s+)?(?:meeting|appointment)",
                ],
                {"event_type": r"(?i)(meeting|appointment|event|call|review)"},
                [],
            ),
            (
                "distribution_list", "contact.open", 1.8,
                [
                    r"(?i)contact\s+(?:the\s+)?([\w\s-]+)\s+(?:dl|distribution\s+list)",
                    r"(?i)email\s+(?:the\s+)?([\w\s-]+)\s+(?:dl|distribution\s+list|team)",
                    r"(?i)reach\s+out\s+to\s+(?:the\s+)?([\w\s-]+)\s+(?:dl|team)",
                    r"(?i)([\w\s-]+)[-_]?(dl|team|support)@[\w.-]+",
                ],
                {"dl_name": r"([\w\s-]+)", "dl_email": r"([\w\s-]+[-_]?(?:dl|team|support)@[\w.-]+)"},
                [],
            ),
            (
                "calendar_link", "calendar.create", 1.0,
                [
                    r"(https?://outlook\.office365\.com/[^\s]*calendar[^\s]*)",
                    r"(https?://outlook\.live\.com/[^\s]*calendar[^\s]*)",
                ],
                {"calendar_url": r"(https?://outlook\.[^\s]+)"},
                [],
            ),
        ],
    },
}
GLOBAL_PATTERNS = [
    ("step", r"(?m)^\s*(\d+[\.\)]|\(\d+\)|[-–•*])\s+\S.+"),
    ("step", r"(?im)^\s*step\s*\d+\s*:"),
    ("table", r"(?m)^\|.+\|.+\|"),
    ("owner", r"(?i)\b(owner|team|contact|dl|distribution\s*list|support):\s*([^\n]+)"),
    ("owner", r"(?i)\b(email|contact):\s*([^\n]+)"),
]
GLOBAL_CONFIDENCE = 0.6
CAPABILITY_TYPES = {
    "ticket.create": "jira", "ticket.view": "jira", "request.create": "itsm", "request.view": "itsm",
    "api.try": "endpoint", "form.submit": "form", "runbook.run": "runbook", "pipeline.trigger": "pipeline",
    "repo.create": "repo", "contact.open": "chat", "dashboard.view": "dashboard", "channel.open": "teams",
    "meeting.schedule": "teams", "email.send": "outlook", "calendar.create": "outlook",
}
CAPABILITY_WEIGHTS = {
    "ticket.create": 1.0, "ticket.view": 0.6, "request.create": 1.0, "request.view": 0.6, "api.try": 0.9,
    "form.submit": 0.9, "runbook.run": 1.0, "pipeline.trigger": 1.0, "repo.create": 0.8, "contact.open": 0.5,
    "dashboard.view": 0.7, "channel.open": 0.5, "meeting.schedule": 0.6, "email.send": 0.4, "calendar.create": 0.4,
    "step": 0.4, "owner": 0.3, "table": 0.2,
}
DEFAULT_CAPABILITY_WEIGHT = 0.3
CTA = {
    ("jira", "ticket.create"): "Create ticket",
    ("jira", "ticket.view"): "Open ticket",
    ("jira", "project.access"): "Request access",
    ("servicenow", "request.create"): "Submit request",
    ("servicenow", "request.view"): "View request",
    ("servicenow", "catalog.browse"): "Browse catalog",
    ("api", "api.try"): "Try endpoint",
    ("api", "auth.setup"): "Get API key",
    ("api", "api.docs"): "View docs",
    ("teams", "channel.open"): "Open channel",
    ("teams", "meeting.schedule"): "Schedule meeting",
    ("teams", "contact.open"): "Contact team",
    ("outlook", "email.send"): "Send email",
    ("outlook", "calendar.create"): "Schedule meeting",
    ("outlook", "contact.open"): "Contact DL",
    ("global", "step"): "View step",
    ("global", "owner"): "Contact owner",
    ("global", "table"): "View details",
}
SUITE_NAMES = {
    "jira": "Jira", "servicenow": "ServiceNow", "api": "API", "teams": "Microsoft Teams", "outlook": "Outlook",
    "github": "GitHub", "global": "General",
}
ATTR_LABELS = {
    "project_key": "Project: ", "issue_type": "Type: ", "method": "", "channel_name": "Channel: ",
    "team_name": "Team: ", "dl_name": "DL: ", "service_name": "Service: ", "ticket_id": "#", "incident_number": "#",
}

# --------------------------------------------------------------------------------------------------------------
# Telemetry.
HOT_MS, WARN_MS = 2000.0, 500.0
STAGE_FIXES = {"k_nn": "knn", "kknn": "knn", "bm_25": "bm25"}
# Other spellings of log keys.
LOG_KEYS = {"reg_id": "req_id", "request_id": "req_id"}
BUDGET_MS = {"slotting_regex": 1.0, "slotting_model": 50.0, "fusion": 3.0, "pair_scoring": 1800.0}
IMPORTANT_EVENTS = ["error", "success", "start"]
IMPORTANT_STAGES = ["overall", "bm25", "knn"]
