"""Fixed values.

Everything in this module is a constant of the data model: word lists, labels, patterns and
limits that decide results and therefore have to be exactly these. They are stated plainly and in
one place; the rest of the package takes them as default arguments.
"""

# --- category rules: (category, keywords), checked top to bottom, first hit wins -------------
CATEGORY_RULES = [
    ("AI Assistant", ["genie code", "ai assistant", "agentic coworker"]),
    ("Business Intelligence", [
        "dashboard", "ai/bi", "genie one", "genie agent", "genie space", "lakeview",
        "metric view", "sql alert", "visualization",
    ]),
    ("Data Warehousing", [
        "sql warehouse", "dbsql", "databricks sql", "serverless sql", "statement timeout",
        "query federation", "warehouse",
    ]),
    ("Governance", [
        "unity catalog", "rbac", "role-based access", "access control", "audit", "permission",
        "credential", "secrets", "governed tags", "governance hub", "data classification",
        "volumes", "catalog", "token",
    ]),
    ("Security", [
        "security profile", "encryption", "private link", "ingress control", "compliance",
    ]),
    ("Sharing", ["delta sharing", "clean room", "data sharing"]),
    ("Database", ["lakebase", "postgres"]),
    ("Application Development", [
        "databricks apps", "appkit", "cli", "sdk", "notebook", "bundle", "dab", "rest api",
        "terraform", "git",
    ]),
    ("Artificial Intelligence", [
        "mlflow", "model serving", "foundation model", "ai_query", "ai_classify", "ai_extract",
        "ai_gen", "ai_forecast", "ai function", "llm", "claude", "gpt", "gemini", "glm",
        "inkling", "embedding", "vector search", "rag", "model catalog", "fine-tun", "copilot",
        "anthropic", "openai", "agentic", "agent",
    ]),
    ("Data Engineering", [
        "lakeflow", "pipeline", "streaming", "ingestion", "etl", "structured streaming", "cdc",
        "kafka", "zerobus", "declarative pipeline", "dlt", "delta live table", "auto loader",
        "connector", "orchestrat", "delta lake", "iceberg", "materialized view", "variant",
        "replace where", "checkpoint",
    ]),
    ("Customer Data Platform", ["customer data platform"]),
]
FALLBACK_CATEGORY = "Platform Overview"

# --- repository -> category, overrides the keyword rules -------------------------------------
REPO_CATEGORY_HINTS = {
    "apache/spark": "Data Engineering",
    "delta-io/delta": "Data Engineering",
    "mlflow/mlflow": "Artificial Intelligence",
    "databricks/databricks-sdk-py": "Application Development",
    "databricks/cli": "Application Development",
    "databrickslabs/dqx": "Governance",
}

# --- source names and display labels ----------------------------------------------------------
SOURCE_BLOG = "databricks_blog"
LABEL_BLOG = "Databricks Blog"
SOURCE_RELEASES = "github_release"
LABEL_RELEASES_PREFIX = "GitHub · "
SOURCE_NOTES = "release_notes"
LABEL_NOTES = "Release Notes"
NOTES_SUMMARY_FORMAT = "Databricks platform update — %s %d."
APPROX_DATE_TAG = "approx-date"
UNDATED_MONTH = "undated"

# --- calendar names ---------------------------------------------------------------------------
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

# --- commit trailer names dropped from release bodies ----------------------------------------
TRAILER_NAMES = ["Co-authored-by", "Signed-off-by", "Reviewed-by"]

# --- limits -----------------------------------------------------------------------------------
SUMMARY_MAX_CHARS = 1800
SUMMARY_MIN_CUT = 0.4
ELLIPSIS = "…"
LAST_SECTION_CHARS = 3000
RECENT_MONTHS = 4
FEED_ITEMS = 100
MAX_ITEMS = 600
MAX_AGE_DAYS = 90

# --- whitespace removed by strip / rstrip -----------------------------------------------------
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# --- patterns, in Java syntax -----------------------------------------------------------------
# A word character is a letter, a number of any kind, or the underscore. A word starts after any
# other character, or at the start of the text. (A look-behind would see only half of a character
# beyond the basic plane.)
WORD_START = r"(?:[^\p{L}\p{N}_]|^)"
WS_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

HTML_COMMENT = r"(?s)<!--.*?-->"
HTML_LIST_ITEM = r"(?iu)<li[^>]*>"
HTML_LINE_BREAK = rf"(?iu)<(?:/(?:p|li|h[1-6])|br{WS_CLASS}*/?)>"
HTML_TAG = r"<[^>]+>"

# groups: path, year, month name, slug, inner HTML
NOTE_LINK = (
    r"""(?isu)<a[^>]*href=["']?(/aws/en/release-notes/product/(\d{4})/([a-z]+)#([a-z0-9-]+))"""
    r"""["']?[^>]*>(.*?)</a>"""
)
# group: slug
SECTION_HEADING = (
    r"""(?isu)<h2[^>]*[^\p{L}\p{N}_>]id=["']?([a-z0-9-]+)["']?[^>]*>.*?</h2>"""
)
# groups: year, month name; the page that holds a month's sections
MONTH_PAGE_URL = r"(?iu)/aws/en/release-notes/product/(\d{4})/([a-z]+)/?(?:[?#].*)?$"
# groups: month name, day, year
LEADING_DATE = rf"\A([A-Za-z]+) (\d{{1,2}}), (\d{{4}}){WS_CLASS}*\n+"
# groups: content after name, content before name
META_DESCRIPTION = (
    r'''(?iu)<meta[^>]+name="description"[^>]+content="([^"]*)"|'''
    r'''<meta[^>]+content="([^"]*)"[^>]+name="description"'''
)
