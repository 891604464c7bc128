"""Word lists, lookup tables, thresholds and patterns.

Results depend on these exact values, so they are stated here once, as plain
text. Every operator takes them as defaults and lets the caller override them.
"""

# Stop words of the keyword extractor.
KEYWORD_STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is",
    "was", "are", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "shall", "can", "need", "all", "each", "every", "both", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "just",
    "also", "about", "above", "after", "again", "against", "below", "between", "during", "before", "behind", "into",
    "through", "under", "up", "down", "out", "off", "over", "this", "that", "these", "those", "it", "its", "we",
    "our", "you", "your", "they", "their", "them", "he", "she", "his", "her", "who", "which", "what", "where",
    "when", "why", "how", "able", "get", "use", "using", "used", "work", "working", "new", "including",
]

# Stop words of the similarity tokeniser.
TOKEN_STOPWORDS = [
    "the", "and", "for", "with", "are", "you", "your", "that", "this", "will", "can", "have", "from", "into", "has",
    "our", "who", "what", "where", "when", "how", "why", "about", "been", "but", "was", "were", "not", "all", "any",
    "would", "could", "should", "they", "them", "their", "role", "roles", "team", "apply", "application", "job",
    "company",
]

# Substrings that mark a senior title.
BOARD_SENIOR_WORDS = ["senior", "lead", "staff", "manager", "director"]
REMOTE_SENIOR_WORDS = [
    "senior", "lead", "staff", "principal", "manager", "director", "head of",
]

# Substrings that mark a location as open to the whole world.
WORLDWIDE_WORDS = ["worldwide", "anywhere", "global", "remote"]

# Host substrings of the known boards, in probing order.
BOARD_HOSTS = [
    ("greenhouse.io", "greenhouse"),
    ("lever.co", "lever"),
    ("ashbyhq.com", "ashby"),
    ("smartrecruiters.com", "smartrecruiters"),
    ("myworkdayjobs.com", "workday"),
    ("jobvite.com", "jobvite"),
]

# Board links that may be embedded in a page, and the canonical
# url each one stands for. The first pattern that matches anywhere wins.
EMBEDDED_BOARD_PATTERNS = [
    (
        r"job-boards\.greenhouse\.io/embed/job_app\?for=([a-z0-9_\-]+)&(?:amp;)?token=(\d+)",
        "https://job-boards.greenhouse.io/%s/jobs/%s",
    ),
    (
        r"boards\.greenhouse\.io/([a-z0-9_\-]+)/jobs/(\d+)",
        "https://boards.greenhouse.io/%s/jobs/%s",
    ),
    (
        r"jobs\.lever\.co/([a-z0-9_\-]+)/([a-f0-9\-]{36})",
        "https://jobs.lever.co/%s/%s",
    ),
    (
        r"jobs\.ashbyhq\.com/([a-z0-9_\-]+)/([a-f0-9\-]{36})",
        "https://jobs.ashbyhq.com/%s/%s",
    ),
    (
        r"jobs\.smartrecruiters\.com/([a-z0-9_\-]+)/(\d+)-",
        "https://jobs.smartrecruiters.com/%s/%s",
    ),
]

# Careers sites with their own API, as (host pattern, company).
CAREERS_SITES = [(r"careers\.celonis\.com", "Celonis")]

# Years-of-experience patterns (whitespace is Unicode aware).
YEARS_RANGE_PATTERN = r"(?U)(\d+)\s*[-–to]+\s*(\d+)\s*(?:years?|yrs?)"
YEARS_SINGLE_PATTERN = (
    r"(?U)(?:(\d+)\+?|minimum\s+(\d+)|at\s+least\s+(\d+))\s*(?:years?|yrs?)\s*(?:of\s+)?"
    r"(?:professional\s+)?(?:related\s+)?(?:work\s+)?(?:industry\s+)?experience"
)

# Similarity token pattern.
TOKEN_PATTERN = r"([a-z0-9][a-z0-9-]{2,})"

# Text length limits.
MIN_DESCRIPTION = 100
FULL_DESCRIPTION = 800
MAX_DESCRIPTION = 5000
MANUAL_DESCRIPTION = 1500

# Gates and caps.
SENIOR_YEARS = 3
MIN_SCORE = 6
REMOTE_CAP = 50
BOARD_CAP = 30
RUN_CAP = 50
PAGE_CAP = 5
PAGE_SIZE = 20
KEYWORDS_PER_TEXT = 20
SELECTION_KEYWORDS = 10
MIN_EXPERIENCES = 3
MIN_PROJECTS = 3
TOP_PROJECTS = 2
PRIORITY_BONUS = {"high": 5, "medium": 2, "low": 0}

# Cost model.
CALLS_PER_RESUME = 4
TOKENS_PER_RESUME = 750
INPUT_SHARE = 0.7
OUTPUT_SHARE = 0.3
USD_PER_MILLION_IN = 0.40
USD_PER_MILLION_OUT = 1.60

# Skill groups shown on a tailored resume and their categories.
SKILL_GROUPS = [
    ("Languages", ["Programming Languages"]),
    ("Frameworks & Libraries", ["AI/ML", "Backend", "Frontend"]),
    ("Tools & Platforms", ["DevOps", "Databases"]),
    ("Concepts", ["Core Concepts"]),
]

# Role synonyms.
ROLE_SYNONYMS = {
    "all": [
        "software engineer", "backend engineer", "devops engineer", "ai engineer",
        "full stack engineer", "platform engineer", "sde", "software developer",
        "fullstack", "full-stack", "ai engineer", "machine learning engineer",
        "ml engineer", "llm engineer", "research engineer", "data scientist",
        "devops engineer", "platform engineer", "site reliability engineer", "sre",
        "infrastructure engineer", "data engineer", "data scientist", "data analyst",
    ],
    "software_engineer": [
        "software engineer", "backend engineer", "devops engineer", "ai engineer",
        "full stack engineer", "platform engineer", "sde", "software developer",
        "fullstack", "full-stack",
    ],
    "ai_engineer": [
        "ai engineer", "machine learning engineer", "ml engineer", "llm engineer",
        "research engineer", "data scientist",
    ],
    "devops_engineer": [
        "devops engineer", "platform engineer", "site reliability engineer", "sre",
        "infrastructure engineer",
    ],
    "data_engineer": ["data engineer", "data scientist", "data analyst"],
}

# Company rosters as (name, slug); one value means both are equal.
COMPANIES = [
    "gitlab", "spotify", "perplexity", "quantcast", "deel", ("ashbyhq", "Ashby"),
    ("hume", "humeai"), "intuit",
]
INDIA_COMPANIES = [
    ("razorpay", "razorpaysoftwareprivatelimited"), ("phonepe", "phonepe"), "myntra",
    ("groww", "groww"), ("inmobi", "inmobi"), "dezerv", "alphagrep", "neysa",
    ("paypay", "paypay"), ("sila", "sila"), "podium", "modmed", "ghx", "enzene",
    ("twinhealth", "twinhealth"), "careeredge", "graviton", "go2andaman", "vymo",
    "helium", ("kimbal", "kimbal"), "sada", "acurus", ("glance", "glance"), "quadeye",
    "infuseb2b", ("valpro", "valpro"), ("propstack", "propstack"),
    ("taboola", "taboola"), "axio", ("storable", "storable"), "nk securities",
    "verona matchmaking", ("techgrove by banyan software", "techgrovebybanyansoftware"),
    ("blenheim chalcot india", "blenheimchalcotindia"),
    ("forbes & company limited", "forbes"), ("tru fru", "trufru"), "one digital", "m0",
    "innovative embedded systems pvt ltd siic iit kanpur",
]

# Skills a posting of each role family is known to ask for.
FAMILY_SKILLS = {
    "Software Engineer": ["Python", "Java", "SQL", "REST APIs", "Microservices"],
    "Backend Engineer": ["Python", "Go", "PostgreSQL", "Kafka", "Distributed Systems"],
    "AI Engineer": ["Python", "LLMs", "PyTorch", "RAG", "Vector Databases"],
    "Machine Learning Engineer": [
        "Python", "PyTorch", "scikit-learn", "Feature Engineering", "MLOps",
    ],
    "Full Stack Engineer": ["React", "TypeScript", "Node.js", "PostgreSQL", "AWS"],
    "Data Engineer": ["Python", "Spark", "Airflow", "Snowflake", "ETL"],
    "Platform Engineer": ["Kubernetes", "Terraform", "CI/CD", "Go", "AWS"],
    "DevOps Engineer": ["Docker", "Kubernetes", "Terraform", "GitHub Actions", "AWS"],
    "Site Reliability Engineer": [
        "Kubernetes", "Grafana", "Prometheus", "SLOs", "Incident Response",
    ],
    "Data Scientist": ["Python", "Pandas", "SQL", "Statistical Modeling", "A/B Testing"],
}

# Tags whose content is no part of a page's text.
DROPPED_TAGS = ["script", "style", "noscript", "nav", "footer", "header"]

# Regions of a page that may hold the description, as (tag or *, attribute, value).
DESCRIPTION_REGIONS = [
    ("*", "data-test", "job-description"), ("*", "data-test", "jobDescription"), ("section", "class", "description"),
    ("div", "class", "description"), ("div", "class", "job-details"), ("article", "", ""), ("main", "", ""), ("body", "", ""),
]

# Not a fixed value but our choice: entities resolved with built-in functions, ampersand last so
# that an escaped entity is resolved only one level. Others use the UDF.
NATIVE_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
    ("&#x27;", "'"), ("&#34;", '"'), ("&nbsp;", " "), ("&#160;", " "),
    ("&middot;", "·"), ("&copy;", "©"), ("&reg;", "®"),
    ("&trade;", "™"), ("&bull;", "•"), ("&hellip;", "…"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"),
    ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"),
    ("&eacute;", "é"), ("&egrave;", "è"), ("&uuml;", "ü"),
    ("&ouml;", "ö"), ("&auml;", "ä"), ("&szlig;", "ß"), ("&amp;", "&"),
]
